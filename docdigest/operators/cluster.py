"""Clustering and extractive summaries, document by document or over the corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdigest.functions.vectors import dot, euclidean_distance, l2_normalize
from docdigest.operators import lloyd
from docdigest.operators.kernels import kmeans, silhouette_cosine, starts
from docdigest.sources.lineage import cut

MODES = ("short", "one_page", "full")
SHORT_K, ONE_PAGE_K, FULL_RATIO, FULL_FLOOR = 4, 11, 0.15, 5
#: Sentences of a document that one task clusters; larger documents are clustered by all executors together.
LARGE = 20_000


def resolve_k(mode: Column, n: Column) -> Column:
    """Clusters of a summary: 4, 11 or 15 % of the sentences (half to even, 5 at least), never more than n - 1."""
    full = F.greatest(F.lit(FULL_FLOOR), F.rint(n * FULL_RATIO).cast("int"))
    return F.least(F.when(mode == "short", SHORT_K).when(mode == "one_page", ONE_PAGE_K).when(mode == "full", full), n - 1).cast("int")


def _k(mode: str, n: int) -> int:
    return min({"short": SHORT_K, "one_page": ONE_PAGE_K}.get(mode, max(FULL_FLOOR, round(FULL_RATIO * n))), n - 1)


def _check(modes) -> None:
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown modes: {sorted(unknown)}")


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["embedding"].to_numpy()).astype(float)


def by_document(vectors: DataFrame, fit, schema: str, columns: list[str], most: int | None = None, too_many=None) -> DataFrame:
    """What ``fit`` makes of each document's rows (a pandas frame in order of ``sent_idx``), as tuples of ``schema``.

    A task goes through many documents, sorted by key, and holds the rows of one at a time; of a document of more than ``most``
    rows none, its only tuple is what ``too_many`` makes of its key.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        held: list[pd.DataFrame] = []
        key, out, n = object(), [], 0

        def flush():
            if most is not None and n > most:
                out.append(too_many(key))
            elif held:
                out.extend(fit(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)))

        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf["doc_key"].to_numpy()
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for a, b in zip(start, np.append(start[1:], len(pdf)), strict=True):
                if keys[a] != key:
                    flush()
                    held, key, n = [], keys[a], 0
                n += b - a
                if most is not None and n > most:
                    held = []
                else:
                    held.append(pdf.iloc[a:b])
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        flush()
        if out:
            yield pd.DataFrame(out, columns=names)

    return vectors.select(*columns).repartition("doc_key").sortWithinPartitions("doc_key", "sent_idx").mapInPandas(run, schema)


def _split(vectors: DataFrame, out: DataFrame, mark: str) -> tuple[DataFrame, DataFrame | None]:
    """The tasks' results without the rows of the mark, and the vectors of documents that have one, with the group ``g``, written so that each round reads them; None if there are none."""
    out = cut(out)
    marked = out.where(mark).select("doc_key")
    rest = out.where(f"not ({mark})")
    if marked.isEmpty():
        return rest, None
    said = [c for c in ("sentence",) if c in vectors.columns]
    return rest, cut(vectors.join(marked, "doc_key", "left_semi").select(F.col("doc_key").alias("g"), "doc_key", "sent_idx", *said, "embedding"))


def _large_runs(large: DataFrame, runs) -> lloyd.Runs:
    """By document, what ``runs`` makes of its number of sentences. There is one for each ``LARGE`` rows at most."""
    return {r.g: runs(r["count"]) for r in large.groupBy("g").count().toLocalIterator()}


def cluster_documents(vectors: DataFrame, modes=MODES, seed: int = 42, n_init: int = 1, max_iter: int = 300, large: int = LARGE) -> DataFrame:
    """``assignments(doc_key, mode, sent_idx, cluster_id)``: k-means of each document, all modes together so that vectors shuffle once.

    A document of more than ``large`` sentences is clustered by Lloyd steps over all executors, from starts that are drawn from all
    of its rows; what a task holds of it are the centroids.
    """
    _check(modes)

    def fit(pdf):
        if len(pdf) < 2:
            return []
        x, key = _matrix(pdf), pdf["doc_key"][0]
        labels = {m: kmeans(x, _k(m, len(x)), seed, n_init, max_iter)[0].tolist() for m in modes}
        return [(key, m, i, c) for m in modes for i, c in zip(pdf["sent_idx"].tolist(), labels[m], strict=True)]

    out = by_document(vectors, fit, "doc_key string, mode string, sent_idx int, cluster_id int", ["doc_key", "sent_idx", "embedding"], large, lambda key: (key, None, -1, -1))
    out, rest = _split(vectors, out, "mode is null")
    if rest is None:
        return out
    found = lloyd.fit(rest, _large_runs(rest, lambda n: {f"{m}#{i}": _k(m, n) for m in modes for i in range(n_init)}), seed, max_iter)
    best = {}
    for (g, run), inertia in found.inertia.items():
        key = (g, run.split("#")[0])
        best[key] = min(best.get(key, (np.inf, "")), (inertia, run))
    centroids = {key: found.centroids[key[0], run] for key, (_, run) in best.items()}
    more = lloyd.assign(rest, centroids)
    return out.union(more.select("doc_key", F.col("run").alias("mode"), "sent_idx", "cluster_id"))


def cluster_corpus(vectors: DataFrame, k: int, seed: int = 42):
    """(model, assignments) of one k-means over all vectors."""
    data = vectors.withColumn("features", array_to_vector("embedding"))
    model = KMeans(k=k, seed=seed, maxIter=300, initMode="k-means||").fit(data)
    return model, model.transform(data).withColumnRenamed("prediction", "cluster_id").drop("features")


def elbow_curve(vectors: DataFrame, k_min: int = 2, k_max: int = 20, seed: int = 42, large: int = LARGE) -> DataFrame:
    """``elbow(doc_key, k, inertia)`` for each k below the number of sentences; documents of more than ``large`` sentences over all executors."""

    def fit(pdf):
        x, most = _matrix(pdf), min(k_max, len(pdf) - 1)
        if most < k_min:
            return []
        start = starts(x, most, seed)
        return [(pdf["doc_key"][0], k, kmeans(x, k, seed, start=start[:k])[2]) for k in range(k_min, most + 1)]

    out = by_document(vectors, fit, "doc_key string, k int, inertia double", ["doc_key", "sent_idx", "embedding"], large, lambda key: (key, -1, 0.0))
    out, rest = _split(vectors, out, "k = -1")
    return out if rest is None else out.union(_elbow(rest, k_min, k_max, seed))


def _elbow(rows: DataFrame, k_min: int, k_max: int, seed: int) -> DataFrame:
    runs = _large_runs(rows, lambda n: {str(k): k for k in range(k_min, min(k_max + 1, n))})
    found = [(g, int(run), inertia) for (g, run), inertia in lloyd.fit(rows, runs, seed).inertia.items()]
    return rows.sparkSession.createDataFrame(found, "doc_key string, k int, inertia double")


def corpus_elbow(vectors: DataFrame, k_min: int = 2, k_max: int = 20, seed: int = 42) -> DataFrame:
    """``(k, inertia)`` of all vectors together for each k below their number: one pass a round moves the centroids of every k that still move."""
    rows = cut(vectors.select(F.lit("all").alias("g"), "doc_key", "sent_idx", "embedding"))
    return _elbow(rows, k_min, k_max, seed).select("k", "inertia")


def cluster_centroids(assigned: DataFrame) -> DataFrame:
    """``(doc_key, cluster_id, size, centroid)`` of vectors that have a ``cluster_id``."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))))
    return assigned.groupBy("doc_key", "cluster_id").agg(F.count("*").alias("size"), mean.alias("centroid"))


def with_distance(assigned: DataFrame) -> DataFrame:
    """Rows with the distance to their cluster's mean."""
    both = assigned.join(cluster_centroids(assigned), ["doc_key", "cluster_id"])
    return both.withColumn("distance", euclidean_distance(F.col("embedding"), F.col("centroid"))).drop("centroid")


def nearest_to_centroid(assigned: DataFrame) -> DataFrame:
    """``(doc_key, cluster_id, sent_idx)``: the sentence next to each cluster's mean, the first of equals."""
    return with_distance(assigned).groupBy("doc_key", "cluster_id").agg(F.min_by("sent_idx", F.struct(F.round("distance", 12), "sent_idx")).alias("sent_idx"))


def inertia(assigned: DataFrame) -> DataFrame:
    return with_distance(assigned).groupBy("doc_key").agg(F.sum(F.col("distance") ** 2).alias("inertia"))


def distinct_clusters(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("doc_key").agg(F.count_distinct("cluster_id").alias("n_clusters"))


def silhouette(assigned: DataFrame) -> DataFrame:
    """``(doc_key, silhouette)`` under cosine distance, from each cluster's sum of unit vectors: no pair of rows is formed. Null unless 2 to n - 1 clusters."""
    unit = assigned.withColumn("u", l2_normalize(F.col("embedding")))
    sums = unit.groupBy("doc_key", "cluster_id").agg(F.count("*").alias("size"), vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("total"))
    other = sums.select("doc_key", F.col("cluster_id").alias("other"), F.col("size").alias("m"), "total")
    far = unit.join(other, "doc_key").withColumn("d", F.col("m") - dot(F.col("u"), F.col("total")))
    own = F.col("cluster_id") == F.col("other")
    per = far.groupBy("doc_key", "sent_idx").agg(
        F.max(F.when(own, F.when(F.col("m") == 1, F.lit(None)).otherwise((F.col("d") - (1 - dot(F.col("u"), F.col("u")))) / (F.col("m") - 1)))).alias("a"),
        F.min(F.when(~own, F.col("d") / F.col("m"))).alias("b"),
        F.count("*").alias("clusters"),
    )
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    out = per.groupBy("doc_key").agg(F.avg(s).alias("s"), F.max("clusters").alias("k"), F.count("*").alias("n"))
    return out.select("doc_key", F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), F.col("s")).alias("silhouette"))


SUMMARY = "doc_key string, mode string, k_used int, n_total_sentences int, selected_indices array<int>, sentences array<string>, word_count int, compression_ratio double, silhouette double, status string"


def summarize(vectors: DataFrame, modes=MODES, seed: int = 42, large: int = LARGE) -> DataFrame:
    """``summaries`` of ``vectors(doc_key, sent_idx, sentence, embedding)``: for each cluster the sentence next to its mean, in document order.

    A document of one sentence has rows of the status ``too_few_sentences`` without a summary, all others ``ok``. Documents of
    more than ``large`` sentences are clustered over all executors.
    """
    _check(modes)

    def fit(pdf):
        rows, n, key = [], len(pdf), pdf["doc_key"][0]
        if n < 2:
            return [(key, m, 0, n, [], [], 0, 0.0, None, "too_few_sentences") for m in modes]
        x, said, index = _matrix(pdf), pdf["sentence"].tolist(), pdf["sent_idx"].tolist()
        start = starts(x, max(_k(mode, n) for mode in modes), seed)
        for mode in modes:
            k = _k(mode, n)
            label, c, _ = kmeans(x, k, seed, start=start[:k])
            d = ((x - c[label]) ** 2).sum(1)
            order = np.lexsort((np.arange(n), d, label))
            picked = sorted(order[np.flatnonzero(np.append(True, np.diff(label[order]) > 0))].tolist())
            chosen = [said[i] for i in picked]
            rows.append((key, mode, k, n, [index[i] for i in picked], chosen, sum(len(t.split()) for t in chosen), len(picked) / n, silhouette_cosine(x, label), "ok"))
        return rows

    columns = ["doc_key", "sent_idx", "sentence", "embedding"]
    out = by_document(vectors, fit, SUMMARY, columns, large, lambda key: (key, "", 0, 0, [], [], 0, 0.0, None, "large"))
    out, rest = _split(vectors, out, "status = 'large'")
    return out if rest is None else out.union(_large_summaries(rest, modes, seed))


def _large_summaries(rest: DataFrame, modes, seed: int) -> DataFrame:
    runs = _large_runs(rest, lambda n: {m: _k(m, n) for m in modes})
    size = {r.g: r["count"] for r in rest.groupBy("g").count().toLocalIterator()}
    centroids = lloyd.fit(rest, runs, seed).centroids
    quality = lloyd.silhouettes(rest, centroids)
    about = rest.sparkSession.createDataFrame([(g, m, k, size[g], quality[g, m]) for g, own in runs.items() for m, k in own.items()], "doc_key string, mode string, k_used int, n int, silhouette double")
    near = lloyd.assign(rest, centroids).groupBy("doc_key", F.col("run").alias("mode"), "cluster_id").agg(F.min_by("sent_idx", F.struct("distance", "sent_idx")).alias("sent_idx"))
    chosen = near.join(rest.select("doc_key", "sent_idx", "sentence"), ["doc_key", "sent_idx"])
    words = F.size(F.filter(F.split("sentence", r"\s+"), lambda w: w != ""))
    rows = chosen.groupBy("doc_key", "mode").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))).alias("s"), F.sum(words).cast("int").alias("word_count"))
    ratio = F.size("s") / F.col("n")
    return rows.join(about, ["doc_key", "mode"]).select("doc_key", "mode", "k_used", F.col("n").alias("n_total_sentences"), F.col("s.sent_idx").alias("selected_indices"), F.col("s.sentence").alias("sentences"), "word_count", ratio.alias("compression_ratio"), "silhouette", F.lit("ok").alias("status"))


def summary_stats(selected: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(doc_key, n_selected, word_count, compression_ratio)`` of the sentences selected from each document."""
    words = F.size(F.filter(F.split("sentence", r"\s+"), lambda w: w != ""))
    own = selected.join(sentences, ["doc_key", "sent_idx"]).groupBy("doc_key").agg(F.count("*").alias("n_selected"), F.sum(words).alias("word_count"))
    total = sentences.groupBy("doc_key").agg(F.count("*").alias("n"))
    return own.join(total, "doc_key").select("doc_key", "n_selected", "word_count", (F.col("n_selected") / F.col("n")).alias("compression_ratio"))


def attach_selected_sentences(selected: DataFrame, sentences: DataFrame) -> DataFrame:
    """Texts of selected rows, as one array for each document in document order."""
    both = selected.join(sentences, ["doc_key", "sent_idx"])
    return both.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]).alias("sentences"))
