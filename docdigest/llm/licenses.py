"""License scans: ordered signature rules behind keyword gates, with overlaps resolved by priority, then by containment and length."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docdigest.llm.common import lean, word_bounds
from docdigest.llm.license_rules import ABBREVIATIONS, DENIABLE, GRANT, TAG, TIERS

# The phrases of the base labels, and what they are called.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Rule(NamedTuple):
    tier: int
    number: int
    label: str
    keywords: list[str]
    score: float
    pattern: re.Pattern
    example: str
    #: What of the pattern can stand further on in a list of licenses.
    operand: re.Pattern | None


#: A character between words, and the edge of a word, in lower-cased text.
_GAP, _WORD = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<!{_WORD})(?:" + pattern.replace(" ?", f"{_GAP}*").replace(" ", f"{_GAP}+") + rf")(?!{_WORD})")


def rules() -> list[Rule]:
    """All signatures in order."""
    out = []
    for tier, lines in enumerate(TIERS):
        for line in lines.strip().split("\n"):
            label, keywords, score, pattern, example = line.split(" :: ")
            operand = next((pattern.removeprefix(x) for x in (TAG + " ", GRANT) if pattern.startswith(x)), None)
            out.append(Rule(tier, len(out), label, keywords.split(" "), float(score), _full(pattern), example, operand and _full(operand)))
    return out


def _full(pattern: str) -> re.Pattern:
    for short, long in ABBREVIATIONS.items():
        pattern = pattern.replace(short, long)
    return _compiled(pattern.replace(".", "\\."))


_SPDX = _full(TAG)
#: A parenthesis or a word of an SPDX expression; what stands between two licenses of a grant, and what shows that a name is a license's.
_TOKEN = re.compile(r"[ \t:]*+([()]|[a-z0-9][a-z0-9.+-]*+)")
_JOINT = re.compile(r"(?:\s?,\s?(?:(?:and/or|and|or)\s)?|\s?/\s?|\s(?:and/or|and|or)\s)(?:under\s)?(?:the\s|a\s|an\s)?(?:terms\sof\s(?:the\s)?)?")
_NAMED = re.compile(r"licen[sc]e|[0-9]")
#: What comes before a grant, or the name of a license, that is denied.
_LIST = re.compile(rf"(?<!{_WORD})(?:dual|dually|double|triple|tri|multi)\W\Z|(?<!{_WORD})either(?:\sof)?(?:\sthe)?\W\Z")
_DENIED = re.compile(rf"(?<!{_WORD})(?<!or\s)(?:not|never|no\slonger|isn.t|aren.t|wasn.t|weren.t)(?:\s(?:be|been|being|yet|currently|itself|a|an|the|under|under\sthe))*\s\Z")


def _further(text: str, found: list[tuple[int, int, Rule]], signatures: list[Rule]) -> tuple[list[tuple[int, int, Rule]], set[tuple[int, int]]]:
    """Licenses after the first in SPDX expressions (``A OR (B AND C)``; what follows ``WITH`` is an exception, no license) and in grants (``under A or B``), and which places of them are denied with their grant."""
    out, denied = [], set()
    for tag in _SPDX.finditer(text) if "spdx" in text else ():
        at, operator, first = tag.end(), "", True
        while token := _TOKEN.match(text, at):
            at = token.end()
            if token[1] in "()":
                continue
            if operator is None:
                if token[1] not in ("or", "and", "with"):
                    break
                operator = token[1]
                continue
            a, b = token.start(1), token.start(1) + len(token[1].rstrip("+.-"))
            if operator != "with" and not first:
                out += [(a, b, r) for r in signatures if r.operand and r.tier == 0 and r.operand.fullmatch(text, a, b)][:1]
            operator, first = None, False
    grants = [r for r in signatures if r.operand and r.tier]
    for start, end, rule in found:
        many = rule.operand and rule.tier and (_LIST.search(text, max(0, start - 12), start) or "either" in text[start:end])
        while rule.operand and rule.tier and (joint := _JOINT.match(text, end)):
            a = joint.end()
            ends = [(m.end(), -r.number, r) for r in grants if (m := r.operand.match(text, a)) and (many or _NAMED.search(m[0]))]
            if not ends:
                break
            if _denies(text, start):
                denied |= {(a, max(ends)[0])}
            end, _, rule = max(ends)
            out.append((a, end, rule))
    return out, denied


def _denies(text: str, at: int) -> bool:
    return _DENIED.search(text, max(0, at - 40), at) is not None


def detections(text: str, signatures: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Matches (start, end, rule) in a lower-cased text, in order, none of which overlap: of two that do, the one of the earlier tier stays, then the longer, then the one of the earlier rule.

    Lists of licenses are followed to their end. A grant or a name after "not" and the like is no detection, nor is a weaker one inside it.
    """
    found, open_ = [], []
    gates: dict[str, bool] = {}
    for rule in signatures:
        for word in rule.keywords:
            if word not in gates:
                gates[word] = word in text
            if not gates[word]:
                break
        else:
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(text)]
            open_.append(rule)
    more, denied = _further(text, found, open_)
    found += more
    found.sort(key=lambda x: (x[2].tier, x[0] - x[1], x[2].number, x[0]))
    out: list[tuple[int, int, Rule]] = []
    for x in found:
        i = bisect_right(out, x[0], key=lambda y: y[0])
        if (i == 0 or out[i - 1][1] <= x[0]) and (i == len(out) or out[i][0] >= x[1]):
            out.insert(i, x)
    return [x for x in out if x[2].tier not in DENIABLE or (x[0], x[1]) not in denied and not _denies(text, x[0])]


_LOWER = {x: x + 32 for x in range(65, 91)}
_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string,score:double>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` (but for text) with what its license statements are.

    ``n_base`` places where a base phrase's words stand one after the other, the ``first_word`` and ``last_word`` they start
    at (from 0, else null) and their ``base_labels``; ``labels`` of these and of all detections; ``score``, that of the surest
    detection or base phrase (0: none); the detections' ``spans`` in code points. Labels are sorted and joined by commas.
    Null counts as empty; columns of these names are replaced. Texts are whole, one pass, no shuffle.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    rest = [c for c in docs.columns if c not in (*names, "text")]

    @lean
    def scan(batches):
        signatures = rules()
        base = [(phrase.split(" "), _compiled(phrase), label) for phrase, label in BASE.items()]
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                text = (text or "").translate(_LOWER)
                data = text.encode()
                a, starts, _ = word_bounds(data, alnum=True)
                points = np.cumsum((a & 0xC0) != 0x80)[starts] - 1 if len(starts) else starts
                places, base_labels = [], set()
                for words, pattern, label in base:
                    if all(w in text for w in words):
                        mine = [m.start() for m in pattern.finditer(text)]
                        places += mine
                        base_labels |= {label} if mine else set()
                at = np.searchsorted(points, np.array(sorted(places), np.int64))
                found = detections(text, signatures)
                labels = base_labels | {x[2].label for x in found}
                score = max([0.9] * bool(base_labels) + [x[2].score for x in found], default=0.0)
                spans = [{"start": a, "end": b, "label": r.label, "score": r.score} for a, b, r in found]
                rows.append((len(starts), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64())]))]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(rest).schema]
    return docs.select("text", *rest).mapInArrow(scan, ", ".join([*fields, _OUT]))
