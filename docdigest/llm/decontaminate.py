"""Benchmark decontamination: suffix arrays of training text, searched for every suffix of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from docdigest.llm.common import lean, word_hashes

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of a shard of texts, and known words for which one suffix array is built.
SHARD, PART = 1 << 20, 1 << 15
#: Words of benchmark items that go to every task at once; a larger benchmark is searched for in several passes.
ITEM_WORDS = 100_000


class Benchmark:
    """Items as numbers of their words (from 1, in order of their hashes), with their suffixes sorted. ``at`` has where each suffix starts in ``flat``."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW) -> None:
        items = [(name, h) for name, h in items if len(h)]
        self.window = window
        self.names = sorted({name for name, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        self.words = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.words >> np.uint64(48)).astype(np.int64)] = True
        sizes = np.array([len(h) for _, h in items], np.int64)
        self.shortest, self.longest = int(min([window, *sizes])), int(max([window, *sizes]))
        end = np.zeros(1, np.int64)
        self.flat = np.concatenate([y for _, h in items for y in (np.searchsorted(self.words, h) + 1, end)] or [end])
        starts = np.cumsum(sizes + 1) - sizes - 1
        wide = np.minimum(sizes, window)
        count = sizes - wide + 1
        at = np.concatenate([s + np.arange(c) for s, c in zip(starts, count, strict=True)] or [end[:0]])
        size, item = np.repeat(wide, count), np.repeat(np.array([number[name] for name, _ in items], np.int64), count)
        key = keys(self.flat, at, window)
        # equal windows are one class; its suffixes stand next to each other, in full order
        order = np.lexsort((sorted_suffixes(self.flat, self.longest)[1][at], key, size))
        self.at, size, item, key = at[order], size[order], item[order], key[order]
        new = np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (key[1:] != key[:-1]))) if len(at) else end[:0]
        self.first, self.last = new, np.append(new[1:], len(at))
        self.size = size[new]
        width = 4 * window
        cut = [k[: 4 * n].ljust(4 * n, b"\0") for k, n in zip(key[new].tolist(), self.size.tolist(), strict=True)]
        self.low, self.high = np.array(cut, f"S{width}"), np.array([x + b"\xff" for x in cut], f"S{width + 1}")
        of = np.repeat(np.arange(len(new)), self.last - self.first)
        pairs = np.unique(of * max(1, len(self.names)) + item)
        self.items = np.split(pairs % max(1, len(self.names)), np.searchsorted(pairs // max(1, len(self.names)), np.arange(1, len(new))))

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Each word's number; 0 for a word that no item has."""
        out = np.zeros(len(h), np.int64)
        if not len(self.words):
            return out
        maybe = np.flatnonzero(self.likely[(h >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.words, h[maybe])
        at[at == len(self.words)] = 0
        same = self.words[at] == h[maybe]
        out[maybe[same]] = at[same] + 1
        return out


def keys(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` words from each position on, up to the first 0, as a byte key: four bytes for each word, highest first, none of them zero."""
    ids = np.append(ids, np.zeros(depth, np.int64))
    out = np.zeros((len(at), depth, 4), np.uint8)
    alive = np.ones(len(at), bool)
    for i in range(depth):
        word = ids[at + i]
        alive &= word > 0
        word = word[alive]
        for j, power in enumerate((254**3, 254**2, 254, 1)):
            out[alive, i, j] = word // power % 254 + 1
    return out.reshape(len(at), 4 * depth).view(f"S{4 * depth}")[:, 0]


def sorted_suffixes(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``ids``, and each suffix's rank, by prefix doubling until ``depth`` words are told apart."""
    rank, k = np.unique(ids, return_inverse=True)[1], 1
    while k < depth and (top := int(rank.max(initial=0)) + 1) < len(ids):
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        rank = np.unique(rank * (top + 1) + after, return_inverse=True)[1]
        k *= 2
    return np.argsort(rank, kind="stable"), rank


def _known_runs(ids: np.ndarray, least: int, overlap: int) -> Iterator[np.ndarray]:
    """Positions of known words that stand in runs of ``least`` at least, in parts of bounded size. -1 ends a run; a run of two parts goes on from ``overlap`` words before the cut."""
    step = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - begin >= least
    held, n = [], 0
    for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        while a < b:
            to = min(b, a + max(PART, 2 * overlap))
            held += [np.arange(a, to), np.full(1, -1)]
            n += to - a
            a = to - overlap if to < b else b
            if n >= PART:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


class _Common:
    """How many words suffixes of two texts have in common, up to the first 0: the first words one by one, longer matches by ranks of stretches of 2, 4, 8 … words."""

    #: Words that are compared one by one.
    SHORT = 64

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = np.append(a, 0), np.append(b, 0)
        self.ranks: list[np.ndarray] = []

    def _rank(self, most: int) -> None:
        """Equal stretches of each size get equal ranks; a 0 is like no other word."""
        both = np.concatenate([self.a, self.b])
        end = np.flatnonzero(both == 0)
        both[end] = -1 - end
        rank, k = np.unique(both, return_inverse=True)[1], 1
        while True:
            self.ranks.append(rank.astype(np.int32))
            if 2 * k > most or (top := int(rank.max()) + 1) == len(both):
                return
            after = np.zeros_like(rank)
            after[:-k] = rank[k:] + 1
            rank = np.unique(rank * (top + 1) + after, return_inverse=True)[1]
            k *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(i), np.int64), np.arange(len(i))
        for _ in range(self.SHORT):
            word = self.a[i[todo] + out[todo]]
            todo = todo[(word == self.b[j[todo] + out[todo]]) & (word > 0)]
            if not len(todo):
                return out
            out[todo] += 1
        if not self.ranks:
            self._rank(min(len(self.a), len(self.b)))
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, x, y = self.ranks[k], i[todo] + out[todo], j[todo] + out[todo] + len(self.a)
            same = (x < len(self.a)) & (y < len(rank))
            same[same] = rank[x[same]] == rank[y[same]]
            out[todo[same]] += 1 << k
        return out


def _longest(bench: Benchmark, text: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The longest match of each text suffix with a benchmark suffix of its class, found next to its place among them by binary search."""
    lo, hi = bench.first[group], bench.last[group]
    best, common = np.zeros(len(at), np.int64), _Common(text, bench.flat)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        x, y = at[open_], bench.at[mid]
        n = common(x, y)
        best[open_] = np.maximum(best[open_], n)
        after = common.a[x + n] >= common.b[y + n]
        lo[open_[after]], hi[open_[~after]] = mid[after] + 1, mid[~after]
    return best


def search(bench: Benchmark, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows occur in a shard: positions, numbers of the classes of windows, and the words that match from there on.

    The suffix array leaves out suffixes that cannot match, those with fewer known words than the shortest window has, and
    is built in parts of bounded size; a window is found in each part by binary search for both ends of its range. Windows of
    one size have ranges that do not meet, so the result has at most one row for each position and size of windows.
    """
    out = [(np.zeros(0, np.int64),) * 3]
    for where in _known_runs(ids, bench.shortest, bench.longest):
        text = np.where(where >= 0, ids[where], 0)
        order = sorted_suffixes(text, bench.window)[0]
        order = order[text[order] > 0]
        k = keys(text, order, bench.window)
        first, last = np.searchsorted(k, bench.low), np.searchsorted(k, bench.high)
        hit = np.flatnonzero(last > first)
        count = (last - first)[hit]
        group = np.repeat(hit, count)
        at = order[np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[hit], count)]
        out.append((where[at], group, _longest(bench, text, at, group)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("hits", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
        StructField("items", ArrayType(StringType())),
        StructField("longest", LongType()),
    ]
)
_ARROW = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.int64()]


def _shards(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """Word hashes of texts, in shards of bounded size."""
    held, n = [], 0
    for x in column:
        held.append(word_hashes(x.as_py().encode().lower(), alnum=True) if x.is_valid else np.zeros(0, np.uint64))
        n += len(held[-1])
        if n > SHARD:
            yield held
            held, n = [], 0
    if held:
        yield held


def _scan(bench: Benchmark):
    @lean
    def scan(batches):
        for batch in batches:
            results = []
            for shard in _shards(batch.column(0)):
                gap = np.zeros(1, np.int64)
                offset = np.cumsum([0, *(len(h) + 1 for h in shard)])
                pos, group, length = search(bench, np.concatenate([y for h in shard for y in (bench.ids(h), gap)]))
                who = np.searchsorted(offset, pos, "right") - 1
                order = np.lexsort((pos, who))
                pos, group, length, who = pos[order], group[order], length[order], who[order]
                edges = np.searchsorted(who, np.arange(len(shard) + 1))
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    results.append(_row(bench, len(shard[i]), pos[a:b] - offset[i], group[a:b], length[a:b]))
            columns = [pa.array([r[i] for r in results], kind) for i, kind in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.StructArray.from_arrays(columns, _FOUND.names)], [*batch.schema.names[1:], "found"])

    return scan


def _row(bench: Benchmark, n: int, pos: np.ndarray, group: np.ndarray, length: np.ndarray) -> tuple:
    if not len(pos):
        return n, [], [], 0
    end = np.maximum.accumulate(pos + bench.size[group])
    new = np.flatnonzero(np.append(True, pos[1:] > end[:-1]))
    spans = zip(pos[new].tolist(), end[np.append(new[1:], len(pos)) - 1].tolist(), strict=True)
    named = np.unique(np.concatenate([bench.items[g] for g in np.unique(group).tolist()]))
    return n, [{"start": a, "end": b} for a, b in spans], [bench.names[i] for i in named.tolist()], int(length.max())


def _blocks(items: DataFrame, window: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items (name, word hashes) in blocks of bounded size; a longer item goes on in further pieces, which share the words of a window."""
    held, n = [], 0
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null").toLocalIterator():
        h = word_hashes(r.text.encode().lower(), alnum=True)
        for a in range(0, max(1, len(h) - window + 1), ITEM_WORDS):
            held.append((r.item, h[a : a + ITEM_WORDS + window - 1]))
            n += len(held[-1][1])
            if n >= ITEM_WORDS:
                yield held
                held, n = [], 0
    if held:
        yield held


def _found(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``(row, found)``: the rows of ``docs`` and what was found in them. Rows are structs, so that names cannot clash."""
    text = F.col("text").alias("text")
    out = docs.select(text, F.struct("*").alias("row"))
    fields = [StructField("row", docs.schema)]
    done = False
    for block in _blocks(items, window):
        if done:
            out = out.select(F.col("row.text").alias("text"), "row", F.col("found").alias("before"))
            fields = [fields[0], StructField("before", _FOUND)]
        out = out.mapInArrow(_scan(Benchmark(block, window)), StructType([*fields, StructField("found", _FOUND)]))
        if done:
            a, b = F.col("before"), F.col("found")
            both = [b["n_words"].alias("n_words"), F.concat(a["hits"], b["hits"]).alias("hits"), F.array_union(a["items"], b["items"]).alias("items"), F.greatest(a["longest"], b["longest"]).alias("longest")]
            out = out.select("row", F.struct(*both).alias("found"))
        done = True
    return out if done else out.mapInArrow(_scan(Benchmark([], window)), StructType([*fields, StructField("found", _FOUND)]))


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (but for its text) with ``n_words``, ``hits`` (word spans under any window of an item), ``items`` and ``longest`` (words of the longest match with a window or more).

    Words are runs of ASCII letters and digits and of other than ASCII characters, A-Z lower-cased. A null text has none. A
    null item id is called ``null``; items of one id are one; items without words have no window. Columns of ``docs`` that have
    these names are replaced. An item's words go to every task, in blocks of bounded size: a benchmark of more than one block
    takes one pass for each. A match is measured inside one piece of ``ITEM_WORDS`` words of an item. There is no shuffle of documents.
    """
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("text", *_FOUND.names)]
    return _found(docs, items, window).select(*rest, "found.*")


def count_hits(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest)`` of what ``find_windows`` found."""
    merged = F.aggregate(F.array_sort("hits"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")))
    names = F.array_join(F.array_sort("items"), ",")
    rows = found.select(F.col(key), "n_words", merged["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "longest")
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns as they were."""
    return _found(docs, items, window).where(F.size("found.hits") == 0).select("row.*")
