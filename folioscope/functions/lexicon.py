"""Word lists. The English list is a parameter: a text file of words, by default the one in ``resources``."""

from __future__ import annotations

from functools import cache
from pathlib import Path

ENGLISH = Path(__file__).resolve().parent.parent / "resources" / "english_stop_words.txt"

# Words of academic and layout language that never name a concept.
ACADEMIC = """
page document also may etc using used based one two three four five new like use make said would could get got let see way know need take
come go made well just even back good give much many mr ms dr fig figure table section chapter module ref al exercise problem example note
hint appendix bibliography reference references index abstract introduction conclusion acknowledgement acknowledgements vol volume journal
conference proceedings isbn copyright published publisher press edition university department faculty institute common large small high low
different important general simple main major various several certain possible able better best worse far reduce reduces increase increases
tries try makes shows show gives turn turns moves called known explains explained detail details ways thing things lot lots part parts point
points case cases starting start end next previous following instead usually always
""".split()


@cache
def english(path: str = str(ENGLISH)) -> tuple[str, ...]:
    """The English stop words of a text file, in its order."""
    return tuple(Path(path).read_text(encoding="utf-8").split())


@cache
def content_stops(path: str = str(ENGLISH)) -> tuple[str, ...]:
    """English and academic stop words, each once."""
    return tuple(dict.fromkeys([*english(path), *ACADEMIC]))
