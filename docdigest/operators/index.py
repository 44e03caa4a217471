"""Approximate retrieval over the corpus: hashed random projections, several probes of several tables, exact scores for what is left."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docdigest.functions.vectors import cosine_similarity

#: Vectors that projections are fitted on, tables of buckets, bits of a signature.
SAMPLE, TABLES, SIGNATURE = 20_000, 8, 256
#: Vectors that a bucket should have, most bits of a bucket, most probes of a table.
BUCKET, MOST_BITS, MOST_PROBES = 400, 20, 512
#: Vectors whose exact score a question asks for, at most; questions of a pass, and questions that are compared with a batch at once.
CANDIDATES, QUESTIONS, TOGETHER = 1000, 2000, 100
#: Share of the best three of a sampled question that probes have to find in the sample.
TARGET = 0.97


@dataclass(frozen=True)
class Projections:
    """Directions of all signs, the middle that each is cut at, and how a bucket is probed."""

    directions: np.ndarray
    middle: np.ndarray
    bits: int
    probes: int
    sampled_recall: float

    def project(self, x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size == 0, 1, size) @ self.directions - self.middle

    def codes(self, p: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        sign = (p[:, : TABLES * self.bits] > 0).reshape(len(p), TABLES, self.bits)
        return sign @ (1 << np.arange(self.bits, dtype=np.int64))

    @staticmethod
    def signatures(p: np.ndarray) -> np.ndarray:
        """Signs of all directions, packed into 64-bit words."""
        return np.packbits(p > 0, axis=1).view(np.uint64)

    def probed(self, p: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Of each row and table, the buckets most likely to have its neighbours: its own, then those across the signs that are nearest to their middle."""
        probes = min(probes or self.probes, 1 << self.bits)
        out = np.empty((len(p), TABLES, probes), np.int64)
        few = min(self.bits, max(1, int(np.ceil(np.log2(max(probes, 2)))) + 3))
        flips = (np.arange(1 << few)[:, None] >> np.arange(few) & 1).astype(float)
        own = self.codes(p)
        for t in range(TABLES):
            far = np.abs(p[:, t * self.bits : (t + 1) * self.bits])
            near = np.argsort(far, axis=1)[:, :few]
            cost = np.take_along_axis(far, near, 1) ** 2 @ flips.T
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            masks = (np.int64(1) << near) @ flips.T.astype(np.int64)
            out[:, t] = own[:, t, None] ^ np.take_along_axis(masks, best, 1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def fit_projections(vectors: DataFrame, seed: int = 42, sample: int = SAMPLE, target: float = TARGET) -> Projections:
    """Projections for ``vectors``: directions are random, their middles are medians of a bounded sample, so that buckets are even, and the number of
    probes is the least (a power of two) with which 200 sampled questions find ``target`` of their best three in the sample.

    The sample are the ``sample`` vectors of the least hash of document and sentence: the same however the table is dealt.
    """
    n = vectors.count()
    h = F.xxhash64(F.lit(seed), "doc_key", "sent_idx")
    share = min(1.0, 1.2 * sample / max(n, 1))
    rows = vectors.where("embedding is not null").select(h.alias("h"), F.col("embedding").cast("array<double>").alias("e"))
    rows = (rows if share >= 1 else rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))).orderBy("h").limit(sample)
    x = np.array([r.e for r in rows.toLocalIterator()], float)
    if not len(x):
        return Projections(np.zeros((1, SIGNATURE)), np.zeros(SIGNATURE), 1, 1, 1.0)
    x = _unit(x)
    directions = np.random.default_rng(seed).normal(size=(x.shape[1], SIGNATURE))
    middle = np.median(x @ directions, axis=0)
    bits = int(np.clip(np.floor(np.log2(max(n, 2) / BUCKET)), 1, min(MOST_BITS, SIGNATURE // TABLES)))
    made = Projections(directions, middle, bits, 1, 0.0)
    ask = np.arange(0, len(x), max(1, len(x) // 200))[:200]
    exact = x[ask] @ x.T
    least = -np.partition(-exact, min(3, len(x)) - 1, axis=1)[:, min(3, len(x)) - 1] - 1e-9
    p = made.project(x)
    codes, probes = made.codes(p), 1
    while True:
        found = np.zeros(exact.shape, bool)
        for q, tables in enumerate(made.probed(p[ask], probes)):
            for t in range(TABLES):
                found[q] |= np.isin(codes[:, t], tables[t])
        best = exact >= least[:, None]
        recall = float((found & best).sum() / best.sum())
        if recall >= target or probes >= min(MOST_PROBES, 1 << bits):
            return Projections(directions, middle, bits, probes, recall)
        probes *= 2


def build_index(vectors: DataFrame, fitted: Projections) -> DataFrame:
    """``index(doc_key, sent_idx, codes, signature)`` of every vector that is not null: 40 bytes and its bucket in each table."""

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                p = fitted.project(np.stack(pdf["embedding"].to_numpy()).astype(float))
                yield pd.DataFrame({"doc_key": pdf["doc_key"], "sent_idx": pdf["sent_idx"], "codes": list(fitted.codes(p)), "signature": [s.tobytes() for s in fitted.signatures(p)]})

    return vectors.where("embedding is not null").select("doc_key", "sent_idx", "embedding").mapInPandas(encode, "doc_key string, sent_idx int, codes array<long>, signature binary")


def search_index(questions: DataFrame, index: DataFrame, vectors: DataFrame, fitted: Projections, k: int = 3, candidates: int = CANDIDATES) -> DataFrame:
    """``(question_id, rank, doc_key, sent_idx, score, n_candidates)``: the best of the vectors that share a probed bucket with their question.

    Of these, the ``candidates`` whose signatures differ in the fewest signs are scored exactly; every batch keeps no more than that for a
    question, so a bucket of a third of all vectors costs no more than its signatures. Equal scores come in order of document
    and sentence. Questions are searched in blocks, each over the index once.
    """
    q = questions.where("trim(question) != ''").select("question_id", "embedding")
    blocks = -(-q.count() // QUESTIONS) or 1
    near = None
    for i in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i).collect()
        ids = np.array([r.question_id for r in rows], np.int64)
        p = fitted.project(np.array([r.embedding for r in rows], float).reshape(len(rows), -1)) if len(rows) else np.zeros((0, SIGNATURE))
        probes, signs = fitted.probed(p), fitted.signatures(p)

        def seek(batches, ids=ids, probes=probes, signs=signs):
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                pdf = pdf.sort_values(["doc_key", "sent_idx"], na_position="first", kind="stable")
                codes = np.stack(pdf["codes"].to_numpy())
                own = np.frombuffer(b"".join(pdf["signature"]), np.uint64).reshape(len(pdf), -1)
                found = []
                for lo in range(0, len(ids), TOGETHER):
                    hit = np.zeros((len(ids[lo : lo + TOGETHER]), len(pdf)), bool)
                    for t in range(TABLES):
                        names, where = np.unique(codes[:, t], return_inverse=True)
                        asked = probes[lo : lo + TOGETHER, t]
                        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
                        bucket = np.zeros((len(asked), len(names)), bool)
                        one, two = np.nonzero(names[at] == asked)
                        bucket[one, at[one, two]] = True
                        hit |= bucket[:, where]
                    for j, row in enumerate(hit, lo):
                        some = np.flatnonzero(row)
                        if not len(some):
                            continue
                        differ = np.bitwise_count(own[some] ^ signs[j]).sum(1)
                        if len(some) > candidates:
                            keep = np.argsort(differ, kind="stable")[:candidates]
                            some, differ = some[keep], differ[keep]
                        found.append(pd.DataFrame({"question_id": ids[j], "doc_key": pdf["doc_key"].to_numpy()[some], "sent_idx": pdf["sent_idx"].to_numpy()[some], "differ": differ.astype(np.int32)}))
                if found:
                    yield pd.concat(found)

        part = index.mapInPandas(seek, "question_id long, doc_key string, sent_idx int, differ int")
        near = part if near is None else near.union(part)
    order = Window.partitionBy("question_id").orderBy("differ", "doc_key", "sent_idx")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= candidates).select("question_id", "doc_key", "sent_idx")
    known = vectors.select(F.col("doc_key").alias("doc"), F.col("sent_idx").alias("sent"), "embedding")
    both = near.join(known, F.col("doc_key").eqNullSafe(F.col("doc")) & (F.col("sent_idx") == F.col("sent"))).select("question_id", "doc_key", "sent_idx", "embedding")
    scored = both.join(q.select("question_id", F.col("embedding").alias("q")), "question_id").select("question_id", "doc_key", "sent_idx", cosine_similarity(F.col("q"), F.col("embedding")).alias("score"))
    counted = scored.groupBy("question_id").agg(F.count("*").alias("n_candidates"))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_key", "sent_idx")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(counted, "question_id").select("question_id", "rank", "doc_key", "sent_idx", "score", "n_candidates")


def recall(found: DataFrame, exact: DataFrame, k: int = 3) -> DataFrame:
    """``(question_id, recall)``: the share of each question's k best scores that ``found`` reaches; a vector as good as the k-th best counts like it."""
    least = exact.groupBy("question_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = found.join(least, "question_id").where(F.col("score") >= F.col("least") - 1e-9).groupBy("question_id").agg(F.count("*").alias("hits"))
    return least.join(hits, "question_id", "left").select("question_id", (F.least(F.coalesce("hits", F.lit(0)), "n") / F.col("n")).alias("recall"))
