"""Operators on documents, against plain Python or the rules they follow."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docdigest.functions import text as T
from docdigest.functions.stem import porter_stem
from docdigest.operators import cluster, evaluate, kernels, pages, retrieve, salience
from docdigest.operators import vectors as V
from docdigest.plans import catalog
from docdigest.sources import tables
from docdigest.streaming.streams import current, stream_files, stream_ingest, stream_retrieve

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()

# The cascade in Python's syntax.
PYTHON = [
    (r"(\w)-\s+([a-z])", r"\1\2"),
    (r"\b\d+(?:\.\d+)*\s+(?=[A-Z])", ""),
    (r"\[[\d,\s–-]+\]", " "),
    (r"\([A-Z][a-z]+(?:\s+et\s+al\.|\s+and\s+[A-Z][a-z]+|,\s+[A-Z][a-z]+)?,?\s*\d{4}[a-z]?\)", " "),
    (r"(?<!\w)[a-zA-Z0-9_]+\s*[=<>≤≥+\-×÷/^]\s*[a-zA-Z0-9_.]+(?!\w)", " "),
    (r"(?<!\w)\d{1,3}(?!\w)(?!\s*[a-zA-Z])", " "),
    (r"\s+", " "),
    (r"\s+([,;:.!?])", r"\1"),
]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("step", "given", "want"),
    [
        ("repair_hyphens", "dimen- sion", "dimension"),
        ("repair_hyphens", "3-\nAblation", "3-\nAblation"),
        ("strip_section_numbers", "3.2 Scaled", "Scaled"),
        ("strip_section_numbers", "WMT 2014 English", "WMT English"),
        ("strip_bracket_citations", "a[1, 2–4]b", "a b"),
        ("strip_author_year_citations", "x (Devlin et al., 2018) (see Section 3)", "x   (see Section 3)"),
        ("strip_math", "ResNet-50 and BERT-base", "  and  "),
        ("strip_math", "a == b", "a == b"),
        ("strip_page_numbers", "of 41.0, and", "of  . , and"),
        ("strip_page_numbers", "in 2017. 4 We", "in 2017. 4 We"),
    ],
)
def test_cascade_steps(spark, step, given, want):
    assert one(spark, getattr(T, step), given) == want


def test_cascade_is_pythons(spark):
    rng = np.random.default_rng(1)
    pieces = ["a", "B", "é", "²", "1", "23", "2014", ".", ",", "-", "=", "[", "]", "(", ")", " ", " ", "\t", " ", "\u001c", "_", "We", "x", "–", "٣", "\n", "Devlin et al., 2018"]
    rows = ["".join(rng.choice(pieces, int(rng.integers(1, 40)))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = dict(df.select("i", T.clean_text(F.col("t"))).collect())
    for i, t in enumerate(rows):
        for pattern, to in PYTHON:
            t = re.sub(pattern, to, t)
        assert got[i] == t.strip()


@pytest.mark.parametrize(
    ("given", "want"),
    [("no marker", ""), ("Title Abstract: body here 1 INTRODUCTION rest", "body here"), ("abstract " + "y" * 4000, "y" * 3000), ("x " * 3500 + "abstract z", ""), ("Abstraction abstract — q", "q"), ("\U0001f600 abstract ok Introduction", "ok")],
)
def test_abstract(spark, given, want):
    assert one(spark, T.extract_abstract, given) == want


def test_abstract_of_texts_that_end_like_numbers(spark, tmp_path):
    texts = ["Il est vi.", "Part 1.", "Part 1", "King X", "xi", "The introduction says I", "An introduction", "XINTRODUCTIONS", "- dash", "a" * 4000]
    spark.createDataFrame([(i * 2 + odd, t) for i, t in enumerate(texts) for odd in (0, 1)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["abstract"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["abstract"](spark, str(tmp_path)).collect())) == sorted(want)


def test_verdicts(spark):
    said = "We show that the model in this work is better than the others."
    rows = {"a" * 39: "short", "a" * 24 + "1" * 16: "keep", "a" * 23 + "1" * 17: "symbolic", said: "keep", said[::-1]: "reversed"}
    for t, v in rows.items():
        assert one(spark, T.quality_verdict, t) == v
    parts = one(spark, T.split_sentences, 'See Fig. 3 of Dr. A. Smith. It is 3.5 high! "Really?" Yes.')
    assert parts == ["See Fig. 3 of Dr. A. Smith.", "It is 3.5 high!", '"Really?"', "Yes."]


def test_pages(spark):
    words = spark.createDataFrame([("d", 0, 100.0, 1, 10.0, 5.0, "b"), ("d", 0, 100.0, 0, 9.0, 1.0, "a"), ("d", 0, 100.0, 2, 0.0, 60.0, "c"), ("e", 0, 100.0, 0, 0.0, 0.0, "x")], tables.SCHEMAS["words"])
    assert sorted((r.doc_key, r.text) for r in pages.assemble_pages(words).collect()) == [("d", "a b c"), ("e", "x ")]
    rows = spark.createDataFrame([("d", 0, "x" * 99), ("d", 2, "z" * 100), ("d", 1, "y" * 100)], tables.SCHEMAS["pages"])
    assert pages.join_pages(pages.page_length_gate(rows)).first().joined_text == "y" * 100 + ". " + "z" * 100
    docs, said = pages.ingest_documents(rows)
    assert docs.first().abstract == "" and said.count() == 1


def test_k_follows_the_rule(spark):
    for n, want in ((20, (4, 11, 5)), (30, (4, 11, 5)), (50, (4, 11, 8)), (70, (4, 11, 10)), (90, (4, 11, 14)), (210, (4, 11, 32)), (2, (1, 1, 1)), (4, (3, 3, 3))):
        row = spark.range(1).select(*(cluster.resolve_k(F.lit(m), F.lit(n)) for m in cluster.MODES)).first()
        assert tuple(row) == want == tuple(cluster._k(m, n) for m in cluster.MODES)
    with pytest.raises(ValueError, match="unknown"):
        cluster.summarize(None, ("long",))


def test_kmeans_and_silhouette():
    x = np.random.default_rng(3).normal(size=(60, 8))
    label, c, inertia = kernels.kmeans(x, 5)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (label == d.argmin(1)).all() and inertia == pytest.approx(d.min(1).sum())
    assert kernels.kmeans(x, 59)[0].max() == 58 and kernels.kmeans(np.ones((4, 3)), 3)[2] == 0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist, s = 1 - u @ u.T, []
    for i in range(60):
        own = (label == label[i]) & (np.arange(60) != i)
        a, b = dist[i, own].mean() if own.any() else None, min(dist[i, label == k].mean() for k in set(label.tolist()) - {label[i]})
        s.append(0 if a is None else (b - a) / max(a, b))
    assert kernels.silhouette_cosine(x, label) == pytest.approx(np.mean(s))
    assert kernels.silhouette_cosine(x, np.zeros(60)) is None


def test_summaries_do_not_depend_on_partitions(spark):
    v = V.embed_sentences(pages.kept_sentences(catalog._docs(spark, SF).limit(20), "joined_text")).cache()
    one = spark.createDataFrame([("single", 0, "alone", [1.0] * 256, "cls", "m"), (None, 0, "a", [1.0] * 256, "cls", "m"), (None, 1, "b", [0.5] * 256, "cls", "m")], v.schema)
    v = v.union(one)
    a, b = (sorted(map(str, cluster.summarize(v.repartition(n)).collect())) for n in (1, 7))
    assert a == b and a
    rows = cluster.summarize(v).collect()
    assert sorted((r.mode, r.status) for r in rows if r.doc_key == "single") == [(m, "too_few_sentences") for m in ("full", "one_page", "short")]
    assert len([r for r in rows if r.doc_key is None]) == 3 and cluster.summarize(v.limit(0)).count() == 0
    for r in (r for r in rows if r.status == "ok"):
        assert r.selected_indices == sorted(set(r.selected_indices)) and r.compression_ratio == len(r.sentences) / r.n_total_sentences


def test_salience_counts(spark):
    x = np.random.default_rng(0).normal(size=(120, 16))
    rows = [("d", i, e.tolist()) for i, e in enumerate(x)] + [("s", i, e.tolist()) for i, e in enumerate(x[:29])] + [("t", i, e.tolist()) for i, e in enumerate(x[:30])]
    v = spark.createDataFrame(rows, "doc_key string, sent_idx int, embedding array<double>")
    t = {r.doc_key: r for r in salience.train_salience(v, epochs=15).collect()}
    assert (t["d"].n_total, t["d"].n_excluded, t["d"].n_train, t["d"].n_val, t["d"].status) == (120, 40, 64, 16, "trained")
    assert t["s"].status == "too_short" and t["t"].status == "trained" and t["d"].train_losses[-1] < t["d"].train_losses[0]
    split = salience.stratified_split(salience.weak_labels(v.where("doc_key = 'd'"))).groupBy("label", "split").count().collect()
    assert sorted((r.label, r.split, r["count"]) for r in split) == [(0, "train", 32), (0, "val", 8), (1, "train", 32), (1, "val", 8)]


def test_rouge(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a"], ["a", "c", "a", "d"]), (2, ["a"], []), (3, ["a"], ["b"]), (4, None, ["b"]), (5, ["x"] * 30_000, ["x"] * 20_000)], "k int, summary array<string>, reference array<string>")
    both = evaluate.rouge_n(df, 1, ["k"]).join(evaluate.rouge_n(df, 2, ["k"]), "k")
    got = {r.k: (r.rouge1, r.rouge2) for r in both.collect()}
    assert [tuple(None if v is None else round(v, 6) for v in got[k]) for k in range(1, 6)] == [(0.75, 0.333333), (None, None), (0.0, 0.0), (0.0, 0.0), (0.8, round(2 * 19_999 / 49_998, 6))]
    long = {r.k: r.v for r in df.where("k < 5").select("k", evaluate.rouge_l("summary", "reference").alias("v")).collect()}
    assert long == {1: 0.75, 2: None, 3: 0.0, 4: None}
    assert evaluate.rouge_n(df.limit(0), 1, ["k"]).count() == 0


def test_rouge_shuffles_no_grams(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(rng.choice(["motoring", "falls", "sky", "a1", "was"], n))
    said = [(f"d{i}", m, [text(int(rng.integers(0, 9))) for _ in range(3)]) for i in range(30) for m in ("short", "full")]
    summaries = spark.createDataFrame([*said, ("none", "full", ["x"]), ("empty", "full", [])], "doc_key string, mode string, sentences array<string>")
    docs = spark.createDataFrame([*((f"d{i}", text(i)) for i in range(30)), ("empty", "sky")], "doc_key string, abstract string")
    got = evaluate.rouge(summaries, docs)
    assert "Generate" not in (plan := got._jdf.queryExecution().toString()) and "Aggregate" not in plan
    shape, keys = (lambda c: evaluate.stemmed(evaluate.rouge_tokens(c))), ["doc_key", "mode"]
    pairs = summaries.select(*keys, shape(F.array_join("sentences", " ")).alias("summary")).join(docs.select("doc_key", shape(F.col("abstract")).alias("reference")), "doc_key", "left")
    want = evaluate.rouge_n(pairs, 1, keys).join(evaluate.rouge_n(pairs, 2, keys), keys).join(pairs.select(*keys, evaluate.rouge_l("summary", "reference").alias("rougeL")), keys)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 62


def test_training_labels_and_splits_in_one_shuffle(spark):
    """Inside the tasks the same labels and parts as by Spark's windows, also where sentences are equal."""
    rng = np.random.default_rng(8)
    rows = [(f"d{n}", i, rng.normal(size=6).tolist()) for n in (1, 2, 5, 29, 30, 31, 64, 200) for i in range(n)]
    rows += [("same", i, [1.0, float(i % 3), 0.0, 0.0, 0.0, 0.0]) for i in range(40)] + [("zero", i, [0.0] * 6) for i in range(33)]
    v = spark.createDataFrame(rows, "doc_key string, sent_idx int, embedding array<double>")
    split = {(r.doc_key, r.sent_idx): (r.label, r.split) for r in salience.stratified_split(salience.weak_labels(v)).collect()}
    order = {(r.doc_key, r.sent_idx): r.h for r in v.select("doc_key", "sent_idx", F.xxhash64(F.lit(42), "doc_key", "sent_idx").alias("h")).collect()}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        label = salience._tertiles(np.array([r[2] for r in own]), 33.33, 66.67)
        val = salience._held_out(label, np.array([order[key, r[1]] for r in own]), np.array([r[1] for r in own]))
        assert {(key, r[1]): (k, "val" if held else "train") for r, k, held in zip(own, label.tolist(), val, strict=True) if k >= 0} == {k: x for k, x in split.items() if k[0] == key}
    seen = []
    spark_cut, salience.cut = salience.cut, lambda df: seen.append(df._jdf.queryExecution().toString()) or spark_cut(df)
    try:
        assert salience.train_salience(v).count() == 10
    finally:
        salience.cut = spark_cut
    assert "Join" not in seen[0] and "Window" not in seen[0]


def test_starts_are_the_first_of_more():
    rng = np.random.default_rng(2)
    for n in (3, 17, 60):
        x = rng.normal(size=(n, 8))
        x[n // 2 :: 3] = x[0]  # equal rows
        some = kernels.starts(x, n - 1)
        for k in range(2, n):
            own, shared = kernels.kmeans(x, k), kernels.kmeans(x, k, start=some[:k])
            assert (own[0] == shared[0]).all() and own[2] == shared[2]


def test_rouge_stems(spark):
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "feed": "feed", "motoring": "motor", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "valenci": "valenc", "operator": "oper", "hopefulness": "hope", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "was": "wa", "is": "is"}
    assert {w: porter_stem(w) for w in words} == words
    summaries = spark.createDataFrame([("d", "short", ["Agreed motoring!", "Was falling"]), ("e", "short", ["x"])], "doc_key string, mode string, sentences array<string>")
    docs = spark.createDataFrame([("d", "agree motors was fall"), ("e", "")], "doc_key string, abstract string")
    got = {r.doc_key: r for r in evaluate.rouge(summaries, docs).collect()}
    assert (got["d"].rouge1, got["d"].rouge2, got["d"].rougeL) == (1.0, 1.0, 1.0) and got["e"].rouge1 is None
    assert {r.doc_key: r.rouge1 for r in evaluate.rouge(summaries, docs, stem=False).collect()}["d"] == 0.25


def test_pooling_and_retrieval(spark):
    tokens = spark.createDataFrame([("d", 0, 0, 1, [3.0, 0.0]), ("d", 0, 1, 1, [0.0, 4.0]), ("d", 0, 2, 0, [9.0, 9.0]), ("d", 1, 0, 0, [1.0, 1.0])], "doc_key string, sent_idx int, token_idx int, mask int, vec array<double>")
    pooled = {r.sent_idx: r.embedding for r in V.mean_pool(tokens).collect()}
    assert pooled[0] == pytest.approx([0.6, 0.8]) and pooled[1] == [0.0, 0.0] and V.cls_pool(tokens).count() == 2
    v = spark.createDataFrame([("d", i, f"s{i}", [1.0, float(i % 2)]) for i in range(4)], "doc_key string, sent_idx int, sentence string, embedding array<double>")
    q = spark.createDataFrame([(1, "d", " why ", [1.0, 0.0]), (2, "d", "  ", [1.0, 0.0])], "question_id long, doc_key string, question string, embedding array<double>")
    assert [(r.question_id, r.rank, r.sent_idx) for r in retrieve.retrieve_topk(q, v).orderBy("rank").collect()] == [(1, 1, 0), (1, 2, 2), (1, 3, 1)]
    assert retrieve.build_answer_prompts(retrieve.retrieve_topk(q, v), q, "go").first().prompt == "go\n- s0\n- s2\n- s1\nwhy"


def test_corpus_retrieval_orders_ties(spark):
    e = np.random.default_rng(1).normal(size=(2, 64)).tolist()
    rows = [(f"d{i % 7}", 200 - i, e[i % 3 == 0]) for i in range(200)]
    v = spark.createDataFrame(rows, "doc_key string, sent_idx int, embedding array<double>")
    q = spark.createDataFrame([(i, "why", x) for i, x in enumerate(e)], "question_id long, question string, embedding array<double>")
    want = {i: sorted((d, n) for d, n, x in rows if x is e[i])[:3] for i in range(2)}
    for parts in (1, 3):
        got = retrieve.retrieve_topk_corpus(q, v.coalesce(1).repartition(parts)).orderBy("question_id", "rank").collect()
        assert {i: [(r.doc_key, r.sent_idx) for r in got if r.question_id == i] for i in range(2)} == want


def test_files(spark, tmp_path):
    for name, data in (("a.pdf", b"1"), ("b.pdf", b"1"), ("n" * 60 + ".txt", b"2")):
        (tmp_path / name).write_bytes(data)
    files = tables.register_files(spark, str(tmp_path))
    first = {r.stem for r in tables.dedupe_documents(files).collect()}
    assert first == {"a", "n" * 40}
    assert tables.new_documents_only(files, files.where("stem = 'a'")).count() == 1


def test_stage_tables(spark, tmp_path):
    pages_ = spark.createDataFrame([("d", 0, "text"), ("e", 1, None)], tables.SCHEMAS["pages"])
    pages_.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "pages"))
    back = tables.read_table(spark, "pages", str(tmp_path / "pages"))
    assert back.columns == ["doc_key", "page_num", "text"] and sorted(map(str, back.collect())) == sorted(map(str, pages_.collect()))
    rows = [("d", m, 1, 3, [0], ["One two."], 2, 1 / 3, None, "ok") for m in cluster.MODES]
    summaries = spark.createDataFrame(rows, cluster.SUMMARY)
    for fmt in ("parquet", "json"):
        tables.write_summaries(summaries, str(tmp_path / fmt), fmt)
        assert {(r.mode, r.word_count) for r in spark.read.format(fmt).load(str(tmp_path / fmt)).collect()} == {(m, 2) for m in cluster.MODES}
        assert (tmp_path / fmt / "mode=short").is_dir()
    report = {r.mode: r for r in tables.summary_report(summaries).collect()}["short"]
    assert report.file_name == "paper_short_extractive_summary.txt" and "33%" in report.report and report.report.endswith("One two.")
    assert summaries.select(retrieve.numbered(F.array(F.lit("a"), F.lit("b"))).alias("n")).first().n == ["1. a", "2. b"]
    prompt = retrieve.build_polish_prompts(summaries, "go").first()
    assert prompt.prompt == "go\n1. One two." and prompt.fallback == "One two."


def test_corpus_models(spark):
    rng = np.random.default_rng(5)
    rows = [("d", i, (rng.normal(size=4) * 0.05 + np.eye(4)[i % 3]).tolist()) for i in range(90)]
    v = spark.createDataFrame(rows, "doc_key string, sent_idx int, embedding array<double>")
    found = {r.sent_idx: r.cluster_id for r in cluster.cluster_corpus(v, 3)[1].collect()}
    assert all((found[i] == found[j]) == (i % 3 == j % 3) for i in range(90) for j in range(0, 90, 7))
    assert len({r.cluster_id for r in cluster.cluster_documents(v, ("short",)).collect()}) == 4
    elbow = [r.inertia for r in cluster.elbow_curve(v).orderBy("k").collect()]
    assert len(elbow) == 19 and elbow[1] < 2 < elbow[0]
    report = salience.train_salience_corpus(v)[1].first()
    assert report.n_train + report.n_val == 60 and report.n_val == 12 and 0 <= report.val_accuracy <= 1
    every = V.pairwise_similarity(v.where("sent_idx < 5"), min_score=0.9).collect()
    want = {(i, j) for i in range(5) for j in range(i + 1, 5) if np.dot(rows[i][2], rows[j][2]) / np.linalg.norm(rows[i][2]) / np.linalg.norm(rows[j][2]) >= 0.9}
    assert {(r.i, r.j) for r in every} == want
    curve = salience.loss_curve(salience.train_salience(v)).collect()
    assert [r.epoch for r in curve] == list(range(1, 16))
    assert [(r.status, r.documents) for r in salience.training_report(salience.train_salience(v)).collect()] == [("trained", 1)]


def test_streams(spark, tmp_path):
    text = "The first page has one long sentence that is kept by all of the gates. " * 3
    arrivals = [[("d", 0, text), ("d", 0, text), ("e", 0, text)], [("d", 1, text.upper()), ("d", 0, "another " + text)], [("d", 1, text.upper())]]
    for rows in arrivals:
        spark.createDataFrame(rows, tables.SCHEMAS["pages"]).write.mode("append").parquet(str(tmp_path / "in"))
        stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r.doc_key: r.joined_text for r in current(spark, str(tmp_path / "out" / "docs")).collect()}
    assert got == {"d": f"{text}. {text.upper()}", "e": text}
    assert spark.read.parquet(str(tmp_path / "out" / "pages")).count() == 3

    v = spark.createDataFrame([("d", 0, "s", [1.0])], "doc_key string, sent_idx int, sentence string, embedding array<float>")
    for rows in ([(1, "d", "q", [1.0]), (1, "d", "q", [1.0]), (2, "d", " ", [1.0])], [(1, "d", "q", [1.0]), (3, "d", "r", [1.0])]):
        spark.createDataFrame(rows, tables.SCHEMAS["questions"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
        stream_retrieve(spark, str(tmp_path / "q"), v, str(tmp_path / "m"), str(tmp_path / "k")).awaitTermination()
    assert sorted(r.question_id for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [1, 3]

    (tmp_path / "files").mkdir()
    for names in (("a.pdf", "b.pdf"), ("c.pdf", "d.txt")):
        for name in names:
            (tmp_path / "files" / name).write_bytes(b"2" if name == "d.txt" else b"1")
        stream_files(spark, str(tmp_path / "files"), str(tmp_path / "f"), str(tmp_path / "fc")).awaitTermination()
    assert sorted(r.stem for r in spark.read.parquet(str(tmp_path / "f")).collect()) == ["a", "d"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    order = sorted(got.columns)
    assert sorted(names) == order
    shape = lambda row: tuple("None" if row[c] is None or isinstance(row[c], float) and math.isnan(row[c]) else str(row[c]) for c in order)
    assert sorted(shape(r.asDict()) for r in got.collect()) == sorted(shape(dict(zip(names, r, strict=True))) for r in found.fetchall())
