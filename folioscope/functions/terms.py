"""Columns for terms: plural folding, keys, match patterns, definitions, dependencies, tokens.

Patterns are Java regular expressions in columns, so that terms can be rows. A term matches as whole words, whatever the
case; its last word may be in the plural, its words may be joined by blanks or hyphens but not across a line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.lexicon import english

# Word shapes of patterns.
BLANK = r"(?:[^\S\n]|-)+"
BEFORE, AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
NEVER = r"(?!x)x"
DEFINES = (
    r"(?:(?:is|are|was|were)\s+(?:an?|the|one of|any|when|how|what|called|known as|defined as)"
    r"|refers? to|means?|denotes?|describes?|represents?|can be (?:defined|described) as)"
)
NAMED_AS = r"(?:defined as|known as|called|termed|referred to as)"
IS_A = (
    r"\s+(?:is|are)\s+(?:an?|the)\s+(?:(?:type|kind|form|class|variant|subset|subclass|extension|special case|instance)"
    r"\s+of\s+(?:an?\s+|the\s+)?)?(?:[\w-]+\s+){0,2}?"
)
USES = (
    r"\s+(?:[\w-]+\s+){0,2}?(?:uses?|relies on|rely on|depends on|depend on|builds? on|(?:is|are) built on|(?:is|are) based on"
    r"|extends?|requires?|leverages?|employs?|(?:is|are) derived from|combines?|applies|apply)\s+(?:[\w-]+\s+){0,4}?"
)
USED_FOR = r"\s+(?:is|are)\s+(?:used|required|needed|essential)\s+(?:in|for|by|to)\s+(?:[\w-]+\s+){0,4}?"
TOKEN = r"[a-z0-9]+(?:['-][a-z0-9]+)*"
CASELESS = "(?iU)"


def singular(word: Column) -> Column:
    """Light plural folding: networks and network fold alike."""
    size = F.length(word)
    left = lambda k: F.substr(word, F.lit(1), size - k)
    return (
        F.when(size <= 3, word)
        .when(word.endswith("ies") & (size > 4), F.concat(left(3), F.lit("y")))
        .when(word.rlike("(?:sses|shes|ches|xes|zes)$"), left(2))
        .when(word.rlike("(?:ss|us|is)$"), word)
        .when(word.endswith("s"), left(1))
        .otherwise(word)
    )


def term_key(term: Column) -> Column:
    """Canonical form for comparing terms."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(term), F.lit("[a-z0-9]+"), F.lit(0)), singular), " ")


def concept_key(term: Column) -> Column:
    """Lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(term), r"(?U)\s+", " "))


def pattern_body(term: Column) -> Column:
    """The pattern of a term, to be used inside a larger one; a blank term never matches."""
    words = F.split(concept_key(term), " ")
    quoted = lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))
    last = singular(F.element_at(words, -1))
    size = F.length(last)
    ending = F.when(
        last.endswith("y") & (size > 3) & ~last.rlike("[aeou]y$"), F.concat(quoted(F.substr(last, F.lit(1), size - 1)), F.lit("(?:y|ies)"))
    ).otherwise(F.concat(quoted(last), F.lit("(?:s|es)?")))
    parts = F.concat(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), quoted), F.array(ending))
    return F.when(concept_key(term) == "", F.lit(NEVER)).otherwise(F.concat(F.lit(BEFORE), F.array_join(parts, BLANK), F.lit(AFTER)))


def pattern(term: Column) -> Column:
    """The caseless pattern of a term."""
    return F.concat(F.lit(CASELESS), pattern_body(term))


def definition_pattern(body: Column) -> Column:
    """Of sentences that define the term with this pattern body: by a verb, by naming it, or by a colon."""
    return F.concat(
        F.lit(CASELESS + r"^\W*(?:[^,.;]{0,40},\s*)?(?:an?\s+|the\s+)?"), body, F.lit(r"\s*(?:\([^)]*\)\s*)?,?\s+" + DEFINES + r"\b|" + NAMED_AS + "\\s+(?:an?\\s+|the\\s+)?[\"'“]?"),
        body, F.lit(r"|^\W*"), body, F.lit(r"\s*[:–—-]\s+\S"),
    )


#: What a sentence must have, whatever the term, to define it or to state a dependency: these patterns compile once.
MAY_DEFINE = CASELESS + DEFINES + r"\b|" + NAMED_AS + r"|[:–—-]\s+\S"
MAY_DEPEND = CASELESS + "(?:" + IS_A + "|" + USES + "|" + USED_FOR + ")"


def may_define(sentence: Column) -> Column:
    """Whether a sentence can be a definition of anything."""
    return sentence.rlike(MAY_DEFINE)


def may_depend(sentence: Column) -> Column:
    """Whether a sentence can state a dependency between any terms."""
    return sentence.rlike(MAY_DEPEND)


def defines(sentence: Column, body: Column) -> Column:
    """Whether a sentence reads like a definition. The term's own pattern is only tried where a definition is possible."""
    return F.when(may_define(sentence), F.rlike(sentence, definition_pattern(body))).otherwise(False)


def depends(sentence: Column, dependent: Column, prerequisite: Column) -> Column:
    """Whether a sentence states that one term builds on another (pattern bodies)."""
    return F.when(may_depend(sentence), F.rlike(sentence, dependency_pattern(dependent, prerequisite))).otherwise(False)


def dependency_pattern(dependent: Column, prerequisite: Column) -> Column:
    """Of sentences that state that one term builds on another; both are pattern bodies."""
    b, a = dependent, prerequisite
    return F.concat(F.lit(CASELESS), b, F.lit(IS_A), a, F.lit("|"), b, F.lit(USES), a, F.lit("|"), a, F.lit(USED_FOR), b)


def specialises(general_key: Column, specific_key: Column) -> Column:
    """Whether one key is a longer name with the other as its head."""
    return (general_key != "") & F.endswith(specific_key, F.concat(F.lit(" "), general_key))


def tokens(text: Column) -> Column:
    """Content words for retrieval, folded."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.transform(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*english())), singular)


def spans(text: Column, regex: Column) -> Column:
    """All matches as array<struct<at, stop, surface>>, offsets from 0: the pieces between matches give the places."""
    row = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0)), lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("surface")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,stop:int,surface:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        at = (state["at"] + x["gap"]).cast("int")
        stop = (at + F.length(x["surface"])).cast("int")
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(F.struct(at.alias("at"), stop.alias("stop"), x["surface"].alias("surface")))).alias("out"))

    return F.aggregate(F.filter(row, lambda x: x["surface"].isNotNull()), start, step, lambda s: s["out"])


def mentions_outside(text: Column, term: Column, other: Column) -> Column:
    """Whether a term (pattern) occurs other than inside an occurrence of another one."""
    inner, outer = spans(text, term), spans(text, other)
    return F.exists(inner, lambda m: ~F.exists(outer, lambda o: (o["at"] <= m["at"]) & (m["stop"] <= o["stop"])))
