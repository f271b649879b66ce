"""Columns for lines and pages of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that carry no prose, and signals.
METADATA = (
    r"(?iU)^\s*(?:\d+\s*$|-\s*\d+\s*-\s*$|page\s+\d+(?:\s+of\s+\d+)?\s*$|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\s*$"
    r"|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d"
    r"|\S+@\S+\.\S+\s*$|https?://\S+\s*$|doi[:\s]|(?:figure|fig|table|chapter|module|exercise)\s+\d)"
)
PAGE_REFERENCE = r"(?iU)(?:(?:\.{3,}|…+)\s*\d{1,4}\s*$|\(?\b(?:page|pg\.?|p\.)\s*\d{1,4}\)?\s*$)"
TRAILING_NUMBER = r"(?U)^\D.{2,100}?\s\d{1,4}$"
LIST_ITEM = r"(?U)^(?:[•\-–*▪●◦]|\d+[.)])\s"
SENTENCE_END = "(?U)(?<=[.!?])(?=\\s+[\"'“‘(\\[]?[A-Z0-9])"
FIGURE = r"(?U)\b(?:figure|fig\.|table|diagram)\b"
EXAMPLE = r"(?U)\b(?:for example|for instance|example:|case study)\b"
SMALL_TALK = (
    r"^(?:hi|hello|hey|hiya|yo|thanks|thank you|thank u|thx|ty|ok|okay|cool|great|nice|bye|goodbye"
    r"|good (?:morning|afternoon|evening|night))(?: (?:{name}|there|so much|a lot|again))*$"
)
REPLIES = {
    "thanks": "You're welcome. Ask me anything else about the document whenever you're ready.",
    "goodbye": "Good luck with your studying. Your progress on this document is saved.",
    "agreement": "Sounds good. What would you like to explore next?",
    "greeting": "Hey! I'm {name}, your document analyst. Ask me anything about the document you've uploaded.",
}


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def words(text: Column) -> Column:
    """Number of words between white space of any kind."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def normal_line(line: Column) -> Column:
    """A line for comparing across pages."""
    return strip(F.regexp_replace(F.lower(line), r"(?U)[^a-z0-9\s]", ""))


def is_metadata(line: Column) -> Column:
    """Page numbers, dates, addresses, captions, short labels with digits, entries of contents pages."""
    return is_bare_metadata(strip(line))


def is_bare_metadata(s: Column) -> Column:
    """is_metadata of a line without white space at its ends."""
    short = s.rlike(r"\p{Nd}") & (words(s) <= 3)
    return (s != "") & (s.rlike(METADATA) | short | s.rlike(PAGE_REFERENCE))


def ends_with_number(line: Column) -> Column:
    return bare_ends_with_number(strip(line))


def bare_ends_with_number(s: Column) -> Column:
    return s.rlike(TRAILING_NUMBER)


def _starts(text: Column, kind: str) -> Column:
    return text.rlike(rf"^\p{{{kind}}}")


def ends_segment(buf: Column, line: Column) -> Column:
    """Whether a wrapped line ends where the next begins."""
    last = F.right(buf, F.lit(1))
    closing = last.isin(*".!?:;")
    label = (F.length(buf) < 60) & (words(buf) <= 8) & ~last.isin(",", "(") & _starts(line, "Lu")
    return F.when(closing, ~_starts(line, "Ll")).otherwise(line.rlike(LIST_ITEM) | label)


def reflow(page: Column) -> Column:
    """Hard-wrapped lines joined to segments, one to a line: a fold over the lines, as each step looks at what is joined so far."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(s: Column, line: Column) -> Column:
        buf, done = s["buf"], s["done"]
        out = lambda d, b: F.struct(d.alias("done"), b.alias("buf"))
        pushed = F.concat(done, F.array(buf))
        return (
            F.when((line == "") & (buf != ""), out(pushed, F.lit("")))
            .when(line == "", out(done, buf))
            .when(buf == "", out(done, line))
            .when(buf.endswith("-") & _starts(line, "Ll"), out(done, F.concat(F.substr(buf, F.lit(1), F.length(buf) - 1), line)))
            .when(ends_segment(buf, line), out(pushed, line))
            .otherwise(out(done, F.concat(buf, F.lit(" "), line)))
        )

    end = lambda s: F.array_join(F.when(s["buf"] != "", F.concat(s["done"], F.array(s["buf"]))).otherwise(s["done"]), "\n")
    return F.aggregate(F.transform(F.split(page, "\n", -1), strip), start, step, end)


def section_flags(text: Column) -> Column:
    """Signals of a section: figure, example."""
    low = F.lower(text)
    return F.array_compact(F.array(F.when(low.rlike(EXAMPLE), F.lit("example")), F.when(low.rlike(FIGURE), F.lit("figure"))))


def excerpt(text: Column, most: int = 320) -> Column:
    """At most so many characters, cut at the last blank."""
    head = F.left(text, F.lit(most))
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("…"))).otherwise(text)


def source_label(kind: Column, first: Column, last: Column, index: Column) -> Column:
    """How an excerpt is cited."""
    pages = F.when(first == last, F.format_string("p. %d", first)).otherwise(F.format_string("pp. %d–%d", first, last))
    return F.when(kind != "pdf", F.format_string("Excerpt %d", index + 1)).otherwise(pages)


def is_small_talk(message: Column, name: str = "assistant") -> Column:
    """Whether a whole message is a greeting or thanks."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(message), "[^a-z ]+", " "), " +", " "))
    return clean.rlike(SMALL_TALK.format(name=name))


def small_talk_reply(message: Column, name: str = "assistant") -> Column:
    """The answer to small talk; the first rule that fits."""
    low = F.lower(message)
    return (
        F.when(low.contains("thank") | low.contains("thx") | low.rlike(r"(?U)\bty\b"), F.lit(REPLIES["thanks"]))
        .when(low.contains("bye") | low.contains("night"), F.lit(REPLIES["goodbye"]))
        .when(low.rlike(r"(?U)^\s*(?:ok|okay|cool|great|nice)\b"), F.lit(REPLIES["agreement"]))
        .otherwise(F.lit(REPLIES["greeting"].format(name=name)))
    )
