"""How the sources of a language differ in their words, counted through transducer vocabularies."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docdigest.llm.common import cut, lean
from docdigest.llm.transducer import Transducer

#: Documents of its language in which a kept term occurs at least, what is added to each count, scale of the shares, terms listed for a group.
MIN_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of one transducer, and bytes of all transducers that may be sent to every task; larger vocabularies stay where they are and terms are dealt to them.
SHARD_TERMS, SENT_BYTES = 50_000, 16 << 20
#: Occurrences of terms, and bytes of text, that a task counts before it hands the counts on.
HELD_TERMS, HELD_BYTES = 4 << 20, 64 << 20
#: Terms that a task hands on in one batch.
HANDED_TERMS = 1 << 16
#: Terms and sources of one matrix of shares.
BLOCK_TERMS, BLOCK_SOURCES = 512, 256
#: Tasks among which the terms of one transducer are dealt.
SALTS = 16

#: Bytes of text that are cut into terms at a time; longer texts are cut between terms.
_CUT = 1 << 20
_PIECE = re.compile(rb"[\x00-\xff]{1,%d}[a-z\x80-\xff]*" % _CUT)
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: By number of bytes up to 8, the first so many of a big-endian 64-bit value.
_FIRST = np.array([(1 << 64) - (1 << 64 - 8 * n) for n in range(9)], np.uint64)
#: Keys from here on are the bytes of a term (none begins with a zero byte), smaller ones are numbers of longer terms.
_SPELLED = 1 << 56


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, thing) -> int:
        at = self[thing] = len(self)
        return at


def _cuts(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Lower-cased texts, or parts of long ones, about a megabyte at a time, with the places of their texts in the list."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        data = text.encode("utf-8", "replace").lower()
        for part in [data] if len(data) <= _CUT else (m[0] for m in _PIECE.finditer(data)):
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= _CUT:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _keys(parts: list[bytes], longer: _Numbers) -> list[np.ndarray]:
    """A key for each term of each part: its bytes where they are at most eight, else its number in ``longer``. Different terms have different keys."""
    data = b"\0" + b"\0".join(parts) + bytes(8)
    inside = _IN_TERM[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    size = end - start
    ahead = np.ndarray(len(data) - 7, ">u8", data, strides=1)  # the eight bytes from each place on
    keys = ahead[start].astype(np.uint64) & _FIRST[np.minimum(size, 8)]
    far = np.flatnonzero(size > 8)
    keys[far] = np.fromiter((longer[data[a:b]] for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)), np.uint64, len(far))
    return np.split(keys, np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts[:-1]], dtype=np.int64)))


def _spelled(keys: np.ndarray, longer: list[bytes]) -> list[bytes]:
    """The terms of ascending keys."""
    n = int(np.searchsorted(keys, np.uint64(_SPELLED)))
    return [longer[i] for i in keys[:n].tolist()] + keys[n:].astype(">u8").view("S8").tolist()


def _distinct(keys: np.ndarray) -> np.ndarray:
    """As ``np.unique``, which takes twice as long on the few terms of a text."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def _counted(batches: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[tuple[dict[tuple, tuple[np.ndarray, np.ndarray]], list[bytes]]]:
    """Ascending keys of terms and their counts by the columns before the text, and the longer terms, handed on whenever a task holds much; with ``once`` a text counts a term once."""
    held: dict[tuple, list[list[np.ndarray]]] = defaultdict(list)
    longer = _Numbers()
    read = size = 0

    def counts():
        merged = lambda parts: [_distinct(np.concatenate(parts))] if once and len(parts) > 1 else parts
        return {of: np.unique(np.concatenate([p for parts in found for p in merged(parts)]), return_counts=True) for of, found in held.items()}, list(longer)

    for batch in batches:
        *columns, texts = (c.to_pylist() for c in batch.columns)
        of, last, own = list(zip(*columns, strict=True)), None, []
        for rows, parts in _cuts(texts):
            if (read > HELD_BYTES or size > HELD_TERMS) and not (once and rows[0] == last):
                yield counts()
                held.clear()
                longer.clear()
                read, size, last = 0, 0, None
            for row, keys in zip(rows, _keys(parts, longer), strict=True):
                if row != last:
                    last, own = row, []
                if not len(keys):
                    continue
                if not own:
                    held[of[row]].append(own)
                own.append(_distinct(keys) if once else keys)
                if once and len(own) > 1 and sum(map(len, own)) > 2 * len(own[0]) + _CUT:  # a long text
                    own[:] = [_distinct(np.concatenate(own))]
                size += len(own[-1]) + 16
            read += sum(map(len, parts))
    if held:
        yield counts()


def _strings(terms) -> pa.Array:
    return pa.array(terms, pa.binary()).cast(pa.string())


@lean
def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, text), (lang, term, n): texts that have a term."""
    for held, longer in _counted(batches, once=True):
        for (lang,), (keys, n) in held.items():
            for a in range(0, len(keys), HANDED_TERMS):
                some, terms = n[a : a + HANDED_TERMS], _spelled(keys[a : a + HANDED_TERMS], longer)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), _strings(terms), pa.array(some, pa.int64())], ["lang", "term", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


@lean
def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, term) in order, (lang, first, ord, term, transducer): a row for each term, and one with the transducer and its size for each run of terms."""
    lang, run = None, []

    def shard():
        n, first = len(run), run[0].decode()
        made = Transducer.build(run).to_bytes()
        rows = [[lang] * (n + 1), [first] * (n + 1), [*range(n), n], [*(t.decode() for t in run), None], [None] * n + [made]]
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["lang", "first", "ord", "term", "transducer"])

    for batch in batches:
        for name, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if run and (name != lang or len(run) == SHARD_TERMS):
                yield shard()
                run = []
            lang = name
            run.append(term.encode())
    if run:
        yield shard()


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """``(shards, terms)`` of the terms that occur in at least ``min_docs`` documents of their language, written to the checkpoint folder.

    ``shards(lang, shard, first, base, size, transducer)`` are transducers over ranges of at most ``SHARD_TERMS`` sorted terms, ``shard``
    numbers them and ``base`` is the ordinal of a shard's first term in its language; ``terms(lang, ord, term)`` has every term's ordinal.
    """
    found = _texts(docs).select("lang", "text").mapInArrow(_documents_with, "lang string, term string, n long")
    kept = cut(found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term"))
    ranges = kept.count() // SHARD_TERMS + 1
    made = kept.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_build, "lang string, first string, ord long, term string, transducer binary")
    made = cut(made)
    shards = made.where("term is null").select("lang", "first", F.col("ord").alias("size"), "transducer")
    # one narrow row for each SHARD_TERMS terms
    places = shards.select("lang", "first", "size").withColumn("shard", F.row_number().over(Window.orderBy("lang", "first")) - 1)
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    places = cut(places.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))))
    shards = shards.join(places.select("lang", "first", "shard", "base"), ["lang", "first"])
    terms = made.where("term is not null").join(places.select("lang", "first", "base"), ["lang", "first"]).select("lang", (F.col("base") + F.col("ord")).alias("ord"), "term")
    return shards, terms


class _Vocabulary:
    """The transducers of one language in order."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r[0])
        self.first, self.base = [r[0] for r in rows], [r[1] for r in rows]
        self.shards = [Transducer.from_bytes(r[2]) for r in rows]

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        if len(self.shards) == 1:
            return self.shards[0].ordinals(terms)
        out = np.full(len(terms), -1, np.int64)
        where = np.fromiter((bisect_right(self.first, t) - 1 for t in terms), np.int64, len(terms))
        for i in np.unique(where[where >= 0]).tolist():
            own = np.flatnonzero(where == i)
            got = self.shards[i].ordinals([terms[j] for j in own.tolist()])
            out[own] = np.where(got < 0, -1, got + self.base[i])
        return out


_COUNTS = "lang string, source string, ord long, n long"
#: A term's place in its block, and its count by one task.
_PACKED = np.dtype([("at", "<u2"), ("n", "<u4")])


def _by_lang(held: dict[tuple, tuple[np.ndarray, np.ndarray]], longer: list[bytes]) -> Iterator[tuple[str, list[bytes], list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """``(lang, terms, sources, source, term, n)`` of each language: ``source`` and ``term`` are places in the lists."""
    langs = defaultdict(list)
    for (lang, source), (keys, n) in held.items():
        langs[lang].append((source, keys, n))
    for lang, rows in langs.items():
        sources, keys, n = zip(*rows, strict=True)
        distinct, term = np.unique(np.concatenate(keys), return_inverse=True)
        yield lang, _spelled(distinct, longer), list(sources), np.repeat(np.arange(len(sources)), [len(k) for k in keys]), term, np.concatenate(n)


@lean
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, source, block, counts) in order, the rows of ``_COUNTS``."""
    last, total = None, None

    def rows(done):
        found = [np.flatnonzero(t) for _, t in done]
        of = np.repeat(np.arange(len(done)), [len(f) for f in found])
        place = np.concatenate([f + block * BLOCK_TERMS for ((_, _, block), _), f in zip(done, found, strict=True)])
        names = (pa.array([key[i] for key, _ in done], pa.string()).take(pa.array(of)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([*names, pa.array(place), pa.array(np.concatenate([t[f] for (_, t), f in zip(done, found, strict=True)]))], ["lang", "source", "ord", "n"])

    for batch in batches:
        done = []
        for *key, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                if last is not None:
                    done.append((last, total))
                last, total = key, np.zeros(BLOCK_TERMS, np.int64)
            counts = np.frombuffer(counts, _PACKED)
            total[counts["at"]] += counts["n"]
        if done:
            yield rows(done)
    if last is not None:
        yield rows([(last, total)])


def _recounted(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """Occurrences of kept terms where every task can hold all transducers. Tasks hand on a row for each group and block of terms."""
    rows = defaultdict(list)
    for r in shards.select("lang", "first", "base", "transducer").collect():
        rows[r.lang].append((r.first.encode(), r.base, bytes(r.transducer)))
    sent = texts.sparkSession.sparkContext.broadcast(dict(rows))

    @lean
    def run(batches):
        opened: dict[str, _Vocabulary] = {}
        for held in _counted(batches):
            for lang, terms, sources, source, term, n in _by_lang(*held):
                if lang not in sent.value:
                    continue
                if lang not in opened:
                    opened[lang] = _Vocabulary(sent.value[lang])
                place = opened[lang].ordinals(terms)[term]  # each distinct term walks once
                known = np.flatnonzero(place >= 0)
                known = known[np.lexsort((place[known], source[known]))]
                source, block = source[known], place[known] // BLOCK_TERMS
                packed = np.empty(len(known), _PACKED)
                packed["at"], packed["n"] = place[known] % BLOCK_TERMS, n[known]
                start = np.flatnonzero(np.r_[True, (np.diff(source) != 0) | (np.diff(block) != 0)][: len(known)])
                bounds = np.append(start, len(known)) * _PACKED.itemsize
                if len(start):
                    counts = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(packed.tobytes())])
                    names = pa.array(sources, pa.string()).take(pa.array(source[start]))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(start), pa.string()), names, pa.array(block[start]), counts], ["lang", "source", "block", "counts"])

    found = texts.mapInArrow(run, "lang string, source string, block long, counts binary")
    return found.repartition("lang", "source", "block").sortWithinPartitions("lang", "source", "block").mapInArrow(_sums, _COUNTS)


def _dealt(texts: DataFrame, shards: DataFrame) -> DataFrame:
    """Occurrences of kept terms where the transducers are too many to send: each task's counts go to the shard whose range they fall into."""
    bounds = defaultdict(list)
    for r in shards.select("lang", "first", "shard").collect():
        bounds[r.lang].append((r.first.encode(), r.shard))
    bounds = {lang: tuple(zip(*sorted(rows), strict=True)) for lang, rows in bounds.items()}

    @lean
    def route(batches):
        for held in _counted(batches):
            for lang, terms, sources, source, term, n in _by_lang(*held):
                if lang in bounds:
                    first, shard = bounds[lang]
                    to = [bisect_right(first, t) - 1 for t in terms]
                    to = pa.array([shard[i] if i >= 0 else None for i in to], pa.int32())
                    term = pa.array(term)
                    names = pa.array([lang] * len(n), pa.string()), pa.array(sources, pa.string()).take(pa.array(source))
                    yield pa.RecordBatch.from_arrays([to.take(term), *names, _strings(terms).take(term), pa.array(n, pa.int64())], ["shard", "lang", "source", "term", "n"])

    @lean
    def walk(batches):
        base, held = 0, None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                made = part.column(6).drop_null()
                if len(made):
                    base, held = part.column(5).drop_null()[0].as_py(), Transducer.from_bytes(made[0].as_py())
                part = part.filter(part.column(3).is_valid())
                if part.num_rows:
                    place = held.ordinals(part.column(3).cast(pa.binary()).to_pylist())
                    known = pa.array(place >= 0)
                    yield pa.RecordBatch.from_arrays([c.filter(known) for c in (part.column(1), part.column(2), pa.array(place + base), part.column(4))], ["lang", "source", "ord", "n"])

    nothing = lambda kind: F.lit(None).cast(kind)
    terms = texts.mapInArrow(route, "shard int, lang string, source string, term string, n long").where("shard is not null")
    terms = terms.select("shard", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt"), "lang", "source", "term", "n", nothing("long").alias("base"), nothing("binary").alias("transducer"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    held = shards.select("shard", salts, "base", "transducer").select("shard", "salt", *(nothing(k).alias(n) for n, k in (("lang", "string"), ("source", "string"), ("term", "string"), ("n", "long"))), "base", "transducer")
    # nulls sort first: a shard's transducer comes before its terms
    both = terms.union(held).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "term")
    return both.drop("salt").mapInArrow(walk, _COUNTS).groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


def recount(docs: DataFrame, shards: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``(lang, source, ord, n)``: occurrences of each kept term in each group of documents, by ordinal, where there are any."""
    size = shards.agg(F.coalesce(F.sum(F.octet_length("transducer")), F.lit(0))).first()[0]
    return (_recounted if size <= sent_bytes else _dealt)(_texts(docs), shards)


def _share(n, total, v):
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * v)) without rounding; null where there are no terms."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(38, 0)) * ({n} + {ADDED})) div (CAST({total} AS DECIMAL(20, 0)) + {ADDED} * {v})")


@lean
def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of differences of each two groups over a block of terms, from rows (lang, block, bi, bj, ord, g, p, v) in order; the row without ``ord`` has the share of terms that a group lacks."""
    key, held = None, []

    def sums():
        lang, block, bi, bj = key
        ord_, g, p, v = (np.concatenate([h[i] for h in held]) for i in range(4))
        width, plain = int(min(BLOCK_TERMS, v[0] - block * BLOCK_TERMS)), ord_ < 0
        names = np.sort(g[plain])
        share = np.repeat(p[plain][np.argsort(g[plain])][:, None], max(width, 0), axis=1)
        share[np.searchsorted(names, g[~plain]), ord_[~plain] - block * BLOCK_TERMS] = p[~plain]
        out = [[], [], []]
        for i, one in enumerate(names.tolist()):
            other = np.flatnonzero((names > one) & (names // BLOCK_SOURCES == bj)) if one // BLOCK_SOURCES == bi else np.zeros(0, int)
            out[0] += [one] * len(other)
            out[1] += names[other].tolist()
            out[2] += np.abs(share[other] - share[i]).sum(1).tolist()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(out[0]), pa.string()), *(pa.array(o, pa.int64()) for o in out)], ["lang", "a", "b", "f"])

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        rest = [batch.column(4).fill_null(-1).to_numpy(), *(batch.column(i).to_numpy() for i in (5, 6, 7))]
        start = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(start, [*start[1:], len(keys)], strict=True):
            if keys[a] != key:
                if held:
                    yield sums()
                key, held = keys[a], []
            held.append([c[a:b] for c in rest])
    if held:
        yield sums()


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language is from the others, and the terms it has more of than its language.

    Null ``lang``, ``source`` and ``text`` count as empty; each row of ``documents`` is a document, repeated or not; a language
    without kept terms has pairs of the value 0. Only ``lang``, ``source`` and ``text`` are read. Shares are whole numbers computed exactly.

    The first pass over the texts counts documents by term, the second walks each task's terms through the transducers of their
    language. Shares of a block of terms and of two blocks of sources meet in one task as a matrix of bounded size, which hands on
    one sum for each two sources; there are as many of these as the result has rows.
    """
    shards, terms = vocabulary(docs, min_docs)
    counts = cut(recount(docs, shards, sent_bytes))
    sizes = shards.groupBy("lang").agg(F.sum("size").alias("v"))
    groups = _texts(docs).select("lang", "source").distinct()
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = cut(groups.withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")))
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "g", "ord", "v", _share("n", "total", "v").alias("p"))

    last = groups.groupBy("lang").agg(F.max("g").alias("last"))
    block = lambda c, n: F.expr(f"{c} div {n}")
    missing = groups.select("lang", "g", F.explode(F.expr(f"sequence(0L, greatest(v - 1, 0) div {BLOCK_TERMS})")).alias("block"), F.lit(None).cast("long").alias("ord"), "v", F.coalesce(F.when(F.col("v") > 0, _share("0", "total", "greatest(v, 1)")), F.lit(0)).alias("p"))
    rows = shares.select("lang", "g", block("ord", BLOCK_TERMS).alias("block"), "ord", "v", "p").union(missing).join(last, "lang")
    own, other = block("g", BLOCK_SOURCES), F.col("other")
    rows = rows.withColumn("other", F.explode(F.expr(f"sequence(0L, last div {BLOCK_SOURCES})")))
    rows = rows.select("lang", "block", F.least(own, other).alias("bi"), F.greatest(own, other).alias("bj"), "ord", "g", "p", "v")
    rows = rows.repartition("lang", "block", "bi", "bj").sortWithinPartitions("lang", "block", "bi", "bj")
    apart = rows.mapInArrow(_distances, "lang string, a long, b long, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    apart = cut(apart)
    both = apart.union(apart.select("lang", "b", "a", "value"))
    name = lambda c, out: groups.select("lang", F.col("g").alias(c), F.col("source").alias(out))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    whole = counts.groupBy("lang", "ord").agg(F.sum("n").alias("n")).join(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v")), "lang")
    usual = whole.select("lang", "ord", _share("n", "total", "v").alias("q"))
    more = shares.join(usual, ["lang", "ord"]).where("p > q").select("lang", "source", "ord", (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    more = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    more = more.join(terms, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.union(more)
