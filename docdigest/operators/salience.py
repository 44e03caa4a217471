"""Weak salience labels and the classifiers that learn them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docdigest.functions.vectors import cosine_similarity
from docdigest.operators import nets
from docdigest.operators.cluster import LARGE, _matrix, by_document
from docdigest.operators.kernels import mlp
from docdigest.sources.lineage import cut

MIN_SENTENCES, MIN_KEPT = 30, 20


def document_centroid(vectors: DataFrame) -> DataFrame:
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))))
    return vectors.groupBy("doc_key").agg(mean.alias("centroid"))


def salience_scores(vectors: DataFrame) -> DataFrame:
    """Each sentence's cosine to the mean of its document."""
    both = vectors.join(document_centroid(vectors), "doc_key")
    return both.withColumn("similarity", cosine_similarity(F.col("embedding"), F.col("centroid"))).drop("centroid")


def tertile_cuts(scores: DataFrame, lower: float = 33.33, upper: float = 66.67, accuracy: int | None = None) -> DataFrame:
    """``(doc_key, lo, hi)``: exact percentiles with linear interpolation; with ``accuracy`` members of the document from mergeable sketches.

    A sketch's cut stands within n / ``accuracy`` places of the exact one among a document's n scores; tasks merge sketches of bounded size
    in one aggregation, where exact cuts gather a document's distinct scores.
    """
    at = [lower / 100, upper / 100]
    cut = F.percentile("similarity", at) if accuracy is None else F.percentile_approx("similarity", at, accuracy)
    return scores.groupBy("doc_key").agg(cut.alias("c")).select("doc_key", F.col("c")[0].alias("lo"), F.col("c")[1].alias("hi"))


def weak_labels(vectors: DataFrame, lower: float = 33.33, upper: float = 66.67, accuracy: int | None = None) -> DataFrame:
    """``salience``: the top share is labelled 1, the bottom share 0, what is between is not kept."""
    scores = salience_scores(vectors)
    both = scores.join(tertile_cuts(scores, lower, upper, accuracy), "doc_key")
    kept = (F.col("similarity") <= F.col("lo")) | (F.col("similarity") >= F.col("hi"))
    label = F.when(F.col("similarity") >= F.col("hi"), 1).when(F.col("similarity") <= F.col("lo"), 0)
    return both.withColumn("label", label.cast("int")).withColumn("kept", kept).drop("lo", "hi")


def stratified_split(salience: DataFrame, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Kept rows with ``split``: ceil(val * n) of each document go to validation, shared among labels by largest remainder."""
    rows = salience.where("kept")
    doc, label = Window.partitionBy("doc_key"), Window.partitionBy("doc_key", "label")
    rows = rows.withColumn("n", F.count("*").over(doc)).withColumn("c", F.count("*").over(label)).withColumn("v", F.ceil(F.round(F.col("n") * val, 9)))
    rows = rows.withColumn("share", F.col("v") * F.col("c") / F.col("n")).withColumn("base", F.floor("share"))
    groups = rows.select("doc_key", "label", "v", "share", "base").distinct()
    over = groups.withColumn("left", F.col("v") - F.sum("base").over(doc)).withColumn("r", F.row_number().over(doc.orderBy(F.desc(F.col("share") - F.col("base")), "label")))
    quota = over.select("doc_key", "label", (F.col("base") + (F.col("r") <= F.col("left")).cast("long")).alias("quota"))
    order = F.row_number().over(label.orderBy(F.xxhash64(F.lit(seed), "doc_key", "sent_idx"), "sent_idx"))
    ranked = rows.drop("n", "c", "v", "share", "base").withColumn("r", order).join(quota, ["doc_key", "label"])
    return ranked.withColumn("split", F.when(F.col("r") <= F.col("quota"), "val").otherwise("train")).drop("r", "quota")


def _tertiles(x: np.ndarray, lower: float, upper: float) -> np.ndarray:
    """``weak_labels`` of one document's vectors: 1, 0 or, for rows that are not kept, -1."""
    centre = x.mean(0)
    norms = np.sqrt((x * x).sum(1)) + 1e-8
    score = (x * centre).sum(1) / (norms * (math.sqrt((centre * centre).sum()) + 1e-8))
    ranked, cuts = np.sort(score), []
    for p in (lower, upper):
        at = (len(x) - 1) * (p / 100)
        lo, hi = math.floor(at), math.ceil(at)
        cuts.append(ranked[lo] if lo == hi else (hi - at) * ranked[lo] + (at - lo) * ranked[hi])
    return np.where(score >= cuts[1], 1, np.where(score <= cuts[0], 0, -1))


def _held_out(label: np.ndarray, order: np.ndarray, sent_idx: np.ndarray, val: float = 0.2) -> np.ndarray:
    """Which rows ``stratified_split`` sends to validation, from the hash that orders them."""
    sizes = {k: n for k in (0, 1) if (n := int((label == k).sum()))}
    n, out = sum(sizes.values()), np.zeros(len(label), bool)
    if not n:
        return out
    v = math.ceil(round(n * val, 9))
    share = {k: v * c / n for k, c in sizes.items()}
    quota = {k: math.floor(s) for k, s in share.items()}
    for k in sorted(share, key=lambda k: (quota[k] - share[k], k))[: v - sum(quota.values())]:
        quota[k] += 1
    for k, q in quota.items():
        rows = np.flatnonzero(label == k)
        out[rows[np.lexsort((sent_idx[rows], order[rows]))[:q]]] = True
    return out


TRAINING = "doc_key string, n_total int, n_excluded int, n_train int, n_val int, epochs int, val_accuracy double, train_losses array<double>, val_losses array<double>, status string"


def train_salience(vectors: DataFrame, epochs: int = 15, lr: float = 0.005, hidden=(128, 32), dropout: float = 0.3, seed: int = 42, large: int = LARGE) -> DataFrame:
    """``training``: one small net for each document; a document that is too short, keeps too little or fails has a row that says so.

    A document's vectors shuffle once: the task that trains its net also labels and splits its rows, as ``weak_labels`` and ``stratified_split`` do.
    The nets of documents of more than ``large`` sentences are trained over all executors: each epoch adds up gradients by document.
    """
    known = vectors.where("doc_key is not null and embedding is not null").withColumn("__order", F.xxhash64(F.lit(seed), "doc_key", "sent_idx"))

    def fit(pdf):
        x, at, n = _matrix(pdf), pdf["sent_idx"].to_numpy(), len(pdf)
        label = _tertiles(x, 33.33, 66.67)
        val = _held_out(label, pdf["__order"].to_numpy(), at)
        train = (label >= 0) & ~val
        n_train, n_val = int(train.sum()), int(val.sum())
        row = [pdf["doc_key"][0], n, n - n_train - n_val, n_train, n_val, 0, None, None, None]
        if n < MIN_SENTENCES:
            row.append("too_short")
        elif n_train + n_val < MIN_KEPT:
            row.append("too_few_kept")
        else:
            try:
                y = label.astype(float)
                a, b, accuracy = mlp(x[train], y[train], x[val], y[val], epochs, lr, hidden, dropout, seed, rows=at[train])
                row[5:] = [epochs, accuracy, a, b, "trained"]
            except (ValueError, FloatingPointError) as error:
                row.append(f"failed: {error}")
        return [tuple(row)]

    out = cut(by_document(known, fit, TRAINING, ["doc_key", "sent_idx", "__order", "embedding"], large, lambda key: (key, 0, 0, 0, 0, 0, None, None, None, "large")))
    marked = out.where("status = 'large'").select("doc_key")
    if marked.isEmpty():
        return out
    labelled = cut(weak_labels(known.join(marked, "doc_key", "left_semi").drop("__order")))
    split = stratified_split(labelled, seed=seed).select("doc_key", "sent_idx", "label", "embedding", "split")
    rest = labelled.where("not kept").select("doc_key", "sent_idx", F.lit(None).cast("int").alias("label"), F.lit(None).cast(vectors.schema["embedding"].dataType).alias("embedding"), F.lit("none").alias("split"))
    of = split.unionByName(rest)
    about = {r.doc_key: (r.n, r.train, r.val) for r in of.groupBy("doc_key").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val")).toLocalIterator()}
    kept = cut(of.where("split != 'none'").select(F.col("doc_key").alias("g"), "sent_idx", "label", F.col("split").alias("part"), "embedding"))
    trained = {g: v for g, v in about.items() if v[0] >= MIN_SENTENCES and v[1] + v[2] >= MIN_KEPT and v[1] and v[2]}
    found = nets.train(kept, {g: v[1:] for g, v in trained.items()}, epochs, lr, hidden, dropout, seed)
    more = [(g, n, n - a - b, a, b, *((epochs, found[g][2], found[g][0], found[g][1], "trained") if g in found else (0, None, None, None, "too_few_kept"))) for g, (n, a, b) in about.items()]
    return out.where("status != 'large'").union(vectors.sparkSession.createDataFrame(more, TRAINING))


def train_salience_corpus(vectors: DataFrame, hidden: int = 128, last: int = 32, seed: int = 42):
    """(model, report): one net over all documents' kept rows (sigmoid layers, L-BFGS), judged on the held-out rows."""
    rows = stratified_split(weak_labels(vectors), seed=seed).select("split", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    try:
        dim = len(rows.first()["features"])
        model = MultilayerPerceptronClassifier(layers=[dim, hidden, last, 2], seed=seed).fit(rows.where("split = 'train'"))
        accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(rows.where("split = 'val'")))
        n = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    finally:
        rows.unpersist()
    report = vectors.sparkSession.createDataFrame([(n.get("train", 0), n.get("val", 0), accuracy)], "n_train long, n_val long, val_accuracy double")
    return model, report


def loss_curve(training: DataFrame) -> DataFrame:
    """``(doc_key, epoch, train_loss, val_loss)``, epochs from 1."""
    both = training.select("doc_key", F.posexplode(F.arrays_zip("train_losses", "val_losses")).alias("e", "l"))
    return both.select("doc_key", (F.col("e") + 1).alias("epoch"), F.col("l.train_losses").alias("train_loss"), F.col("l.val_losses").alias("val_loss"))


def training_report(training: DataFrame) -> DataFrame:
    return training.groupBy("status").agg(F.count("*").alias("documents"), F.sum("n_train").alias("n_train"), F.sum("n_val").alias("n_val"), F.sum("n_excluded").alias("n_excluded"), F.avg("val_accuracy").alias("val_accuracy"))
