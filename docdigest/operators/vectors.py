"""Embedding, pooling and comparing sentence vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdigest.functions.vectors import cosine_similarity, l2_normalize, norm


#: Words whose places an encoder remembers.
WORDS_HELD = 200_000


def hashing_encoder(dim: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A factory of the default encoder: counts of hashed lower-case words, with a sign bit each."""

    def build():
        import re
        import zlib

        word = re.compile(r"\w+")

        class Places(dict):
            """A word's place twice over: even for +1, odd for -1. Words are hashed once, and forgotten when there are many."""

            def __missing__(self, w: str) -> int:
                h = zlib.crc32(w.encode())
                if len(self) > WORDS_HELD:
                    self.clear()
                at = self[w] = h % dim * 2 + (0 if h & 0x80000000 else 1)
                return at

        places = Places()

        def encode(sentences: list[str]) -> np.ndarray:
            found = [[places[w] for w in word.findall(s.lower())] for s in sentences]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            at = np.fromiter((p for f in found for p in f), np.int64, len(row))
            n = np.bincount(row * 2 * dim + at, minlength=len(found) * 2 * dim).reshape(len(found), dim, 2)
            return (n[:, :, 0] - n[:, :, 1]).astype(np.float32)

        return encode

    return build


def embed_sentences(sentences: DataFrame, encoder_factory=None, normalize: bool = True, pooling: str = "cls", model_name: str = "hashing") -> DataFrame:
    """``vectors`` of ``sentences(doc_key, sent_idx, sentence)``. The factory runs once in each task; batches arrive through Arrow."""
    factory = encoder_factory or hashing_encoder()

    def embed(batches):
        encode = factory()
        for pdf in batches:
            x = np.asarray(encode(pdf["sentence"].tolist()), np.float32).reshape(len(pdf), -1)
            if normalize:
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(n == 0, 1, n)
            yield pd.DataFrame({"doc_key": pdf["doc_key"], "sent_idx": pdf["sent_idx"], "sentence": pdf["sentence"], "embedding": list(x), "pooling": pooling, "model_name": model_name})

    return sentences.select("doc_key", "sent_idx", "sentence").mapInPandas(embed, "doc_key string, sent_idx int, sentence string, embedding array<float>, pooling string, model_name string")


def cls_pool(tokens: DataFrame) -> DataFrame:
    """The first token's vector stands for its sentence."""
    return tokens.where("token_idx = 0").select("doc_key", "sent_idx", F.col("vec").alias("embedding"), F.lit("cls").alias("pooling"))


def mean_pool(tokens: DataFrame, normalize: bool = True) -> DataFrame:
    """The mean of a sentence's unmasked tokens, L2-normalised; a sentence without any gets zeros."""
    masked = F.transform(F.col("vec").cast("array<double>"), lambda x: F.when(F.col("mask") == 1, x).otherwise(0.0))
    total = tokens.groupBy("doc_key", "sent_idx").agg(vector_to_array(Summarizer.sum(array_to_vector(masked))).alias("s"), F.greatest(F.sum(F.col("mask").cast("double")), F.lit(1e-9)).alias("n"))
    mean = F.transform("s", lambda x: x / F.col("n"))
    return total.select("doc_key", "sent_idx", (l2_normalize(mean) if normalize else mean).alias("embedding"), F.lit("mean").alias("pooling"))


def vector_norm_check(vectors: DataFrame) -> DataFrame:
    """One row: count, smallest, largest and mean norm, smallest and largest component."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(norm(e).alias("n"), F.array_min(e).alias("lo"), F.array_max(e).alias("hi"))
    return rows.agg(F.count("*").alias("vectors"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.avg("n").alias("mean_norm"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"))


#: Vectors of a block, on average; two blocks meet as one product of matrices.
BLOCK = 1000


def _products(min_score: float | None):
    """Of (doc_key, a, b, block, sent_idx, embedding) in order, block ``a`` before ``b``: the scores of pairs i < j. A task holds two blocks."""

    def multiply(batches):
        key, held = None, []

        def scores():
            block, i = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            x = np.concatenate([h[2] for h in held])
            x = x / (np.sqrt((x * x).sum(1)) + 1e-8)[:, None]
            left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            for lo in range(0, len(left), 100):
                rows = left[lo : lo + 100]
                s = x[rows] @ x[right].T
                keep = i[rows][:, None] < i[right][None] if key[1] == key[2] else np.ones(s.shape, bool)
                if min_score is not None:
                    keep &= s >= min_score
                p, q = np.nonzero(keep)
                one, two = i[rows[p]], i[right[q]]
                columns = [pa.array([key[0]] * len(p), pa.string()), pa.array(np.minimum(one, two), pa.int32()), pa.array(np.maximum(one, two), pa.int32()), pa.array(s[p, q])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_key", "i", "j", "score"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            block, i = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            x = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1) if keys else None
            start = [n for n in range(len(keys)) if n == 0 or keys[n] != keys[n - 1]]
            for lo, hi in zip(start, [*start[1:], len(keys)], strict=True):
                if keys[lo] != key:
                    if held:
                        yield from scores()
                    key, held = keys[lo], []
                held.append((block[lo:hi], i[lo:hi], x[lo:hi]))
        if held:
            yield from scores()

    return multiply


def all_pairs(vectors: DataFrame, min_score: float | None = None, block: int = BLOCK) -> DataFrame:
    """``(doc_key, i, j, score)`` of all pairs i < j inside each document, of a score of at least ``min_score`` if that is given.

    A document's vectors are dealt by hash into blocks of about ``block``; every two of its blocks, and each with itself, meet in one task. So a vector
    is sent once for each block of its document, however large that is, and no two tasks compare the same pair. ``sent_idx`` must
    tell a document's vectors apart; those of null documents meet nothing.
    """
    v = vectors.where("doc_key is not null").select("doc_key", "sent_idx", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = v.groupBy("doc_key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    v = v.join(blocks, "doc_key").withColumn("block", F.pmod(F.xxhash64("sent_idx"), F.col("blocks")).cast("int"))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    v = v.select("doc_key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", F.col("sent_idx").cast("int").alias("sent_idx"), "embedding")
    v = v.repartition("doc_key", "a", "b").sortWithinPartitions("doc_key", "a", "b")
    return v.mapInArrow(_products(min_score), "doc_key string, i int, j int, score double")


def pairwise_similarity(vectors: DataFrame, pairs: DataFrame | None = None, min_score: float | None = None) -> DataFrame:
    """``(doc_key, i, j, score)`` of given pairs, or of all pairs i < j inside each document."""
    if pairs is None:
        return all_pairs(vectors, min_score)
    v = vectors.select("doc_key", "sent_idx", "embedding")
    left = v.select("doc_key", F.col("sent_idx").alias("i"), F.col("embedding").alias("a"))
    right = v.select("doc_key", F.col("sent_idx").alias("j"), F.col("embedding").alias("b"))
    both = pairs.select("doc_key", "i", "j").join(left, ["doc_key", "i"]).join(right, ["doc_key", "j"])
    scored = both.select("doc_key", "i", "j", cosine_similarity(F.col("a"), F.col("b")).alias("score"))
    return scored if min_score is None else scored.where(F.col("score") >= min_score)
