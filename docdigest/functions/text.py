"""Text functions, Column to Column: the cleaning cascade, sentence splitting and quality gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that mean the same to Java, Python and RE2 (Unicode word, digit and space characters).
WORD, DIGIT, SPACE = r"[\p{L}\p{N}_]", r"\p{Nd}", r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"

# The cascade's patterns and replacements, in their order.
CASCADE = {
    "repair_hyphens": (rf"({WORD})-{SPACE}+([a-z])", "$1$2"),
    "strip_section_numbers": (rf"(?<!{WORD}){DIGIT}+(?:\.{DIGIT}+)*{SPACE}+(?=[A-Z])", ""),
    "strip_bracket_citations": (rf"\[(?:{DIGIT}|,|{SPACE}|–|-)+\]", " "),
    "strip_author_year_citations": (rf"\([A-Z][a-z]+(?:{SPACE}+et{SPACE}+al\.|{SPACE}+and{SPACE}+[A-Z][a-z]+|,{SPACE}+[A-Z][a-z]+)?,?{SPACE}*{DIGIT}{{4}}[a-z]?\)", " "),
    "strip_math": (rf"(?<!{WORD})[a-zA-Z0-9_]+{SPACE}*[=<>≤≥+\-×÷/^]{SPACE}*[a-zA-Z0-9_.]+(?!{WORD})", " "),
    "strip_page_numbers": (rf"(?<!{WORD}){DIGIT}{{1,3}}(?!{WORD})(?!{SPACE}*[a-zA-Z])", " "),
    "collapse_whitespace": (rf"{SPACE}+", " "),
    "tighten_punctuation": (rf"{SPACE}+([,;:.!?])", "$1"),
}
# Words that tell forward from reversed text.
STOPWORDS = ["the", "a", "an", "of", "in", "on", "to", "and", "is", "are", "was", "were", "this", "that", "with", "for", "as", "by", "from", "we", "our", "which", "be", "it", "its"]
#: Private characters: a period that ends no sentence, and the end of one.
HELD, MARK = "\ue000", "\ue001"
#: Abbreviations after which a period ends no sentence.
ABBREVIATIONS = ["Dr", "Eq", "Fig", "Figs", "Inc", "Jr", "Mr", "Mrs", "Ms", "No", "Prof", "Sec", "St", "Tab", "Vol", "al", "approx", "cf", "e\\.g", "i\\.e", "pp", "resp", "vs"]


def _step(name: str):
    pattern, replacement = CASCADE[name]

    def step(c: Column) -> Column:
        return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))

    step.__name__ = name
    return step


repair_hyphens = _step("repair_hyphens")
strip_section_numbers = _step("strip_section_numbers")
strip_bracket_citations = _step("strip_bracket_citations")
strip_author_year_citations = _step("strip_author_year_citations")
strip_math = _step("strip_math")
strip_page_numbers = _step("strip_page_numbers")
collapse_whitespace = _step("collapse_whitespace")
tighten_punctuation = _step("tighten_punctuation")


def clean_text(c: Column) -> Column:
    """The whole cascade, trimmed."""
    for name in CASCADE:
        c = _step(name)(c)
    return F.trim(c)


#: An introduction's heading, with or without its number, in any case.
HEADING = rf"(?<!{WORD})(?:[IVX]+\.?|1\.?){SPACE}*INTRODUCTION(?!{WORD})|(?<!{WORD})INTRODUCTION(?!{WORD})"


def extract_abstract(c: Column, search_window: int = 6000, max_len: int = 3000, heading: str = HEADING) -> Column:
    """What follows the first ``abstract`` of the window, up to the introduction's ``heading`` or ``max_len``; empty without the marker.

    Before a heading without a number, the default takes a last word like "vi." for its number.
    """
    mark = rf"(?isu)^.*?(?<!{WORD})abstract(?!{WORD})(?:{SPACE}|[—:.\-])*"
    head = F.regexp_extract(F.substring(c, 1, search_window), mark, 0)
    rest = F.substr(c, F.length(head) + 1)
    before = rf"(?isu)^(.*?)(?:{heading})"
    found = F.regexp_extract(rest, before, 0) != ""
    return F.when(head == "", "").otherwise(F.trim(F.when(found, F.regexp_extract(rest, before, 1)).otherwise(F.substring(rest, 1, max_len))))


def split_sentences(c: Column, abbreviations=ABBREVIATIONS) -> Column:
    """Sentences in order, trimmed: a run of ``.!?`` with closing quotes ends one if white space and a capital or digit follow."""
    names = "|".join(abbreviations)
    c = F.regexp_replace(c, F.lit(rf"(^|[^\p{{L}}\p{{N}}_])({names}|[A-Z])\."), F.lit("$1$2" + HELD))
    c = F.regexp_replace(c, F.lit(rf"([.!?][\"')\]]*){SPACE}+([\"'(\[]*[\p{{Lu}}\p{{Nd}}])"), F.lit("$1" + MARK + "$2"))
    return F.transform(F.split(F.translate(c, HELD, "."), MARK), lambda s: F.trim(s))


def symbol_ratio(c: Column) -> Column:
    """The share of characters that are no letters."""
    return 1.0 - F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.length(c)


def stopword_hits(c: Column) -> Column:
    """Stopwords among the runs of a-z, counted by one compiled pattern."""
    return F.regexp_count(F.lower(c), F.lit(rf"(?<![a-z])(?:{'|'.join(STOPWORDS)})(?![a-z])"))


def is_reversed_text(c: Column) -> Column:
    return stopword_hits(F.reverse(c)) > stopword_hits(c) + 1


def quality_verdict(c: Column, min_chars: int = 40, max_symbol_ratio: float = 0.40) -> Column:
    """The first gate that a sentence fails: short, symbolic or reversed; else keep."""
    return F.when(F.length(c) < min_chars, "short").when(symbol_ratio(c) > max_symbol_ratio, "symbolic").when(is_reversed_text(c), "reversed").otherwise("keep")


def kept_array(c: Column) -> Column:
    """The sentences of a text that pass all gates."""
    return F.filter(split_sentences(c), lambda s: quality_verdict(s) == "keep")
