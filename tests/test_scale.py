"""What runs over all executors against the kernels that run in one task."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docdigest.functions import text as T
from docdigest.operators import cluster, index, kernels, lloyd, nets, pages, retrieve, salience
from docdigest.operators import vectors as V
from docdigest.sources import tables


def blobs(n, dim, centres, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 4
    return (c[rng.integers(centres, size=n)] + rng.normal(size=(n, dim))).astype(np.float32)


def vectors(spark, docs, parts=7):
    rows = [(key, i, f"sentence {i} of {key}", v.tolist()) for key, x in docs.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "doc_key string, sent_idx int, sentence string, embedding array<float>").repartition(parts)


def test_lloyd_is_the_kernel(spark):
    docs = {"a": blobs(700, 5, 6), "b": blobs(300, 5, 3, 1), "c": np.zeros((40, 5), np.float32)}
    rows = vectors(spark, docs).withColumn("g", F.col("doc_key"))
    about = lloyd.spread(rows.select("g", "doc_key", F.col("sent_idx").cast("long"), "embedding"))
    for g, x in docs.items():
        n, mean, var = about[g]
        assert n == len(x)
        assert np.allclose(mean, x.mean(0), atol=1e-5)
        assert np.isclose(var, x.astype(float).var(0).mean())
    start = {(g, str(k)): x[:k].astype(float) for g, x in docs.items() for k in (2, 4, 9)}
    start["a", "far"] = np.vstack([docs["a"][:3], np.full((2, 5), 1e3)]).astype(float)  # two clusters that get no rows
    narrow = rows.select("g", "doc_key", F.col("sent_idx").cast("long").alias("sent_idx"), "embedding")
    found = lloyd.lloyd(narrow, start, about)
    labels = {}
    for r in lloyd.assign(rows, found.centroids).collect():
        labels.setdefault((r.g, r.run), {})[r.sent_idx] = r.cluster_id
    quality = lloyd.silhouettes(rows, found.centroids)
    for (g, run), s in start.items():
        label, c, inertia = kernels.kmeans(docs[g].astype(float), len(s), start=s)
        assert [labels[g, run][i] for i in range(len(docs[g]))] == label.tolist()
        assert np.allclose(found.centroids[g, run], c)
        assert np.isclose(found.inertia[g, run], inertia, atol=1e-6)
        want = kernels.silhouette_cosine(docs[g].astype(float), label)
        assert quality[g, run] == want or np.isclose(quality[g, run], want)


def test_starts_are_spread(spark):
    x = blobs(4000, 4, 8, 3)
    rows = vectors(spark, {"a": x}).withColumn("g", F.col("doc_key")).select("g", "doc_key", F.col("sent_idx").cast("long").alias("sent_idx"), "embedding")
    about = lloyd.spread(rows)
    runs = {"a": {"8": 8, "3": 3}}
    got = lloyd.starts(rows, runs, about, 1)
    assert {k: len(c) for k, c in got.items()} == {("a", "8"): 8, ("a", "3"): 3}
    assert all((np.abs(x - row).max(1) < 1e-6).any() for c in got.values() for row in c)
    again = lloyd.starts(rows.repartition(3), runs, about, 1)
    assert all(np.allclose(got[k], again[k]) for k in got)
    fitted = lloyd.fit(rows, runs)
    assert fitted.inertia["a", "8"] < 1.3 * min(kernels.kmeans(x.astype(float), 8, seed)[2] for seed in range(5))


def test_large_documents(spark):
    docs = {"big": blobs(900, 6, 5), "small": blobs(50, 6, 3, 1), "tiny": blobs(1, 6, 1)}
    v = vectors(spark, docs)
    out = {(r.doc_key, r.mode): r for r in cluster.summarize(v, large=100).collect()}
    usual = {(r.doc_key, r.mode): r for r in cluster.summarize(v).collect()}
    assert out.keys() == usual.keys()
    for key, r in out.items():
        u = usual[key]
        if key[0] != "big":
            assert r == u
            continue
        assert (r.k_used, r.n_total_sentences, r.status) == (u.k_used, u.n_total_sentences, "ok")
        assert r.selected_indices == sorted(set(r.selected_indices))
        assert len(r.selected_indices) == r.k_used
        assert r.sentences == [f"sentence {i} of big" for i in r.selected_indices]
        assert r.word_count == 4 * len(r.sentences)
        assert np.isclose(r.compression_ratio, len(r.sentences) / 900)
        assert abs(r.silhouette - u.silhouette) < 0.15
    a = cluster.cluster_documents(v, large=100, n_init=2)
    assert a.where("doc_key = 'big'").groupBy("mode").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("k")).orderBy("mode").collect() == [("full", 900, 135), ("one_page", 900, 11), ("short", 900, 4)]
    assert a.where("cluster_id < 0").isEmpty()
    assert a.where("doc_key = 'small'").count() == 150
    e = cluster.elbow_curve(v, 2, 6, large=100)
    assert sorted((r.doc_key, r.k) for r in e.collect()) == [(d, k) for d in ("big", "small") for k in range(2, 7)]


def test_corpus_elbow(spark):
    docs = {"a": blobs(500, 4, 5), "b": blobs(400, 4, 5, 2)}
    v = vectors(spark, docs)
    curve = {r.k: r.inertia for r in cluster.corpus_elbow(v, 2, 9).collect()}
    assert sorted(curve) == list(range(2, 10))
    assert all(curve[k + 1] < curve[k] * 1.1 for k in range(2, 9))
    assert curve[9] < 0.6 * curve[2]
    # together as apart
    rows = v.withColumn("g", F.lit("all"))
    for k in (2, 5):
        runs = {str(i): i for i in range(2, 10)}
        alone = lloyd.fit(rows, {"all": runs})
        assert np.isclose(alone.inertia["all", str(k)], curve[k])
        about = lloyd.spread(rows.select("g", "doc_key", F.col("sent_idx").cast("long"), "embedding"))
        narrow = rows.select("g", "doc_key", F.col("sent_idx").cast("long").alias("sent_idx"), "embedding")
        start = lloyd.starts(narrow, {"all": runs}, about, 42)["all", str(k)]
        x = np.vstack([docs["a"], docs["b"]]).astype(float)
        assert np.isclose(kernels.kmeans(x, k, start=start)[2], curve[k])
    assert cluster.corpus_elbow(v.limit(0)).count() == 0


def test_series_of_runs(monkeypatch):
    monkeypatch.setattr(lloyd, "SENT_BYTES", 8 * 10 * 10)
    runs = {"a": {"x": 4, "y": 6}, "b": {"x": 1, "y": 9}, "c": {"x": 10}}
    assert list(lloyd.series(runs, 10)) == [{"a": {"x": 4, "y": 6}}, {"b": {"x": 1, "y": 9}}, {"c": {"x": 10}}]
    with pytest.raises(ValueError, match="SENT_BYTES"):
        list(lloyd.series({"a": {"x": 11}}, 10))


def test_all_pairs(spark):
    docs = {"a": blobs(130, 6, 3), "b": blobs(7, 6, 2, 1), "c": blobs(1, 6, 1), "z": np.zeros((3, 6), np.float32)}
    v = vectors(spark, docs)
    for least in (None, 0.8):
        rows = V.all_pairs(v, least, block=25).collect()
        got = {(r.doc_key, r.i, r.j): r.score for r in rows}
        assert len(got) == len(rows)
        want = {}
        for g, x in docs.items():
            u = x.astype(float) / (np.linalg.norm(x.astype(float), axis=1, keepdims=True) + 1e-8)
            want |= {(g, i, j): float(u[i] @ u[j]) for j in range(len(x)) for i in range(j) if least is None or u[i] @ u[j] >= least}
        assert got.keys() == want.keys()
        assert all(np.isclose(got[p], want[p]) for p in want)
    assert V.all_pairs(v.limit(0)).count() == 0
    assert V.all_pairs(v.withColumn("doc_key", F.lit(None).cast("string"))).count() == 0


def test_sketched_cuts(spark):
    rng = np.random.default_rng(4)
    scores = {"even": np.round(rng.random(9001), 6), "skewed": rng.random(500) ** 9, "tied": np.array([0.5] * 70 + [0.7] * 30), "one": np.array([0.3])}
    df = spark.createDataFrame([(k, float(x)) for k, v in scores.items() for x in v], "doc_key string, similarity double").repartition(9)
    for accuracy in (20, 1000):
        for r in salience.tertile_cuts(df, accuracy=accuracy).collect():
            x = np.sort(scores[r.doc_key])
            for cut, share in ((r.lo, 0.3333), (r.hi, 0.6667)):
                assert cut in x
                places = np.searchsorted(x, cut, "left"), np.searchsorted(x, cut, "right")
                assert places[0] - len(x) / accuracy - 1 <= share * len(x) <= places[1] + len(x) / accuracy + 1
    plan = salience.tertile_cuts(df, accuracy=1000)._jdf.queryExecution().toString()
    assert plan.count("Exchange") == salience.tertile_cuts(df)._jdf.queryExecution().toString().count("Exchange")


def test_longest_common_subsequence():
    rng = np.random.default_rng(6)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = step(row, x, b)
        return row[-1]

    def step(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out

    for _ in range(200):
        a, b = ([*map(str, rng.integers(0, int(rng.integers(1, 8)), int(rng.integers(0, 40))))] for _ in range(2))
        assert kernels.lcs_length(a, b) == plain(a, b)
    a, b = ([*map(str, rng.integers(0, 500, 20_000))] for _ in range(2))
    began = time.time()
    assert kernels.lcs_length(a, b) == kernels.lcs_length(b, a) > 1000
    assert time.time() - began < 4


def test_encoder_counts_signed_words():
    encode = V.hashing_encoder(16)()
    said = ["The cat the CAT sat", "", "x", "dog " * 50]
    want = np.zeros((4, 16))
    for row, s in zip(want, said, strict=True):
        for w in s.lower().split():
            h = zlib.crc32(w.encode())
            row[h % 16] += 1 if h >> 31 else -1
    assert (encode(said) == want).all()
    assert encode([]).shape == (0, 16)


def test_written_text(spark, tmp_path):
    v = vectors(spark, {"a": blobs(30, 4, 3), "b": blobs(9, 4, 2, 1)})
    out = cluster.summarize(v)
    tables.write_summaries(out, str(tmp_path / "t"), "text")
    rows = spark.read.text(str(tmp_path / "t"), wholetext=True)
    assert sorted(rows.select("mode").distinct().collect()) == [("full",), ("one_page",), ("short",)]
    text = "".join(r.value for r in rows.collect())
    assert all(r.report in text for r in tables.summary_report(out).collect())
    tables.write_summaries(tables.summary_report(out), str(tmp_path / "u"), "text")
    assert sum(len(r.value) for r in spark.read.text(str(tmp_path / "u"), wholetext=True).collect()) == len(text)


def test_nets_are_the_kernel(spark):
    rng = np.random.default_rng(8)
    docs = {"a": blobs(300, 6, 4), "b": blobs(120, 6, 2, 1)}
    rows, want = [], {}
    for g, x in docs.items():
        y, part = (x[:, 0] > np.median(x[:, 0])).astype(int), np.where(rng.random(len(x)) < 0.25, "val", "train")
        number = rng.permutation(len(x) * 3)[: len(x)]
        rows += [(g, int(i), int(t), str(p), v.tolist()) for i, t, p, v in zip(number, y, part, x, strict=True)]
        t, v = part == "train", part == "val"
        want[g] = kernels.mlp(x[t].astype(float), y[t].astype(float), x[v].astype(float), y[v].astype(float), epochs=6, rows=number[t]), (int(t.sum()), int(v.sum()))
    df = spark.createDataFrame(rows, "g string, sent_idx int, label int, part string, embedding array<float>").repartition(5)
    got = nets.train(df, {g: w[1] for g, w in want.items()}, epochs=6)
    for g, ((train, val, accuracy), _) in want.items():
        assert np.allclose(got[g][0], train, rtol=0, atol=1e-9)
        assert np.allclose(got[g][1], val, rtol=0, atol=1e-9)
        assert got[g][2] == accuracy
        assert train[-1] < train[0]
    # gradients are those of the loss
    net = kernels.Net(6, (5, 3), dropout=0.5)
    x, y, n = docs["a"][:20].astype(float), np.arange(20) % 2.0, np.arange(20)
    g = net.gradients(x, y, n)[1]
    for k in range(len(net.params)):
        for at in [tuple(rng.integers(0, s) for s in net.params[k].shape) for _ in range(3)]:
            net.params[k][at] += 1e-6
            up = net.gradients(x, y, n)[0]
            net.params[k][at] -= 2e-6
            down = net.gradients(x, y, n)[0]
            net.params[k][at] += 1e-6
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4


def test_masks_follow_the_row():
    all_ = kernels.dropout_masks(np.arange(4000), 3, [16, 8], 0.3, 42)
    some = kernels.dropout_masks(np.array([17, 3999]), 3, [16, 8], 0.3, 42)
    assert all((a[[17, 3999]] == b).all() for a, b in zip(all_, some, strict=True))
    assert abs((all_[0] == 0).mean() - 0.3) < 0.01
    assert np.isclose(all_[0].max(), 1 / 0.7)
    assert abs(np.corrcoef((all_[0] == 0).T)[np.triu_indices(16, 1)]).max() < 0.07
    assert (kernels.dropout_masks(np.arange(4000), 4, [16], 0.3, 42)[0] != all_[0]).mean() > 0.3


def test_large_documents_train(spark):
    v = vectors(spark, {"big": blobs(200, 6, 4), "usual": blobs(60, 6, 4, 2), "short": blobs(10, 6, 2, 1)})
    at_once = {r.doc_key: r for r in salience.train_salience(v, epochs=3).collect()}
    apart = {r.doc_key: r for r in salience.train_salience(v, epochs=3, large=100).collect()}
    assert at_once.keys() == apart.keys()
    for key, r in at_once.items():
        assert np.allclose(r.train_losses or [], apart[key].train_losses or [], atol=1e-9)
        assert np.allclose(r.val_losses or [], apart[key].val_losses or [], atol=1e-9)
        assert [x for x in r if not isinstance(x, list)] == [x for x in apart[key] if not isinstance(x, list)]


def exact_top(x, q, k=3):
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    s = (q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-8)) @ u.T
    return s, -np.partition(-s, k - 1, axis=1)[:, k - 1]


@pytest.mark.parametrize("dim", [64, 768])
def test_index_recall(spark, dim):
    """Vectors around topics that vary in sixteen directions, with some noise in all, and a large group of copies."""
    rng = np.random.default_rng(dim)
    n = 6000
    basis = rng.normal(size=(16, dim))
    x = (rng.normal(size=(60, 16))[rng.integers(60, size=n)] + 0.5 * rng.normal(size=(n, 16))) @ basis + 0.3 * rng.normal(size=(n, dim))
    x[:2000] = x[0]
    x = x.astype(np.float32)
    v = vectors(spark, {"d": x}, 5)
    asked = np.r_[[0], rng.integers(2000, n, 60)]
    q = spark.createDataFrame([(int(i), "d", "which?", (x[i] + 0.05 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in np.unique(asked)], "question_id long, doc_key string, question string, embedding array<float>")
    fitted = index.fit_projections(v, sample=3000)
    built = index.build_index(v, fitted)
    assert built.count() == n
    found = index.search_index(q, built, v, fitted, candidates=300)
    rows = found.collect()
    assert max(r.n_candidates for r in rows) <= 300
    asked = {r.question_id: np.array(r.embedding) for r in q.collect()}
    ids = sorted(asked)
    s, least = exact_top(x.astype(float), np.array([asked[i] for i in ids]))
    hits = 0
    for r in rows:
        at = ids.index(r.question_id)
        assert np.isclose(r.score, s[at, r.sent_idx])
        hits += r.score >= least[at] - 1e-9
    assert hits / (3 * len(ids)) >= 0.9
    # copies tie: the first of them come first
    assert [r.sent_idx for r in sorted(rows, key=lambda r: r.rank) if r.question_id == 0] == [0, 1, 2]
    of = {r.question_id: r.recall for r in index.recall(found, retrieve.retrieve_topk_corpus(q, v)).collect()}
    assert np.isclose(np.mean(list(of.values())), hits / (3 * len(ids)))
    # far fewer than all are looked at
    assert fitted.probes < 1 << fitted.bits


def test_index_edges(spark):
    v = vectors(spark, {"d": blobs(5, 4, 2)})
    fitted = index.fit_projections(v)
    q = spark.createDataFrame([(1, "d", "x", [1.0, 0.0, 0.0, 0.0]), (2, "d", " ", [1.0, 0.0, 0.0, 0.0]), (3, "d", "zero", [0.0] * 4)], "question_id long, doc_key string, question string, embedding array<float>")
    assert {r.question_id for r in index.search_index(q, index.build_index(v, fitted), v, fitted).collect()} == {1, 3}
    none = v.limit(0)
    fitted = index.fit_projections(none)
    assert index.build_index(none, fitted).count() == 0
    nulls = v.withColumn("embedding", F.when(F.col("sent_idx") > 1, F.col("embedding")))
    assert index.build_index(nulls, index.fit_projections(nulls)).count() == 3


def test_probes_come_by_distance():
    p = np.random.default_rng(1).normal(size=(3, index.SIGNATURE))
    fitted = index.Projections(np.eye(index.SIGNATURE), np.zeros(index.SIGNATURE), 6, 64, 1.0)
    codes, probed = fitted.codes(p), fitted.probed(p)
    for row in range(3):
        for t in range(index.TABLES):
            far = np.abs(p[row, t * 6 : t * 6 + 6])
            cost = [sum(far[b] ** 2 for b in range(6) if (int(c) ^ int(codes[row, t])) >> b & 1) for c in probed[row, t]]
            assert sorted(probed[row, t]) == list(range(64))
            assert cost[0] == 0
            assert (np.diff(cost) >= -1e-12).all()


def test_learned_abbreviations(spark):
    rng = np.random.default_rng(9)
    usual = "river stone light water house garden morning window paper table music letter field summer".split()
    said = []
    for _ in range(3000):
        w = [str(x) for x in rng.choice(usual, int(rng.integers(4, 9)))]
        if rng.random() < 0.2:
            w.insert(2, str(rng.choice(["approx.", "Dept.", "e.g.", "Mt."])))
        said.append(" ".join(w).capitalize() + ".")
    docs = spark.createDataFrame([(str(i), " ".join(said[i : i + 10])) for i in range(0, 3000, 10)] + [("null", None), ("empty", "")], "doc_key string, text string").repartition(5)
    scored = pages.abbreviation_scores(docs, "text")
    rows = {r.word: r for r in scored.collect()}
    assert rows["dept"].without_period == 0
    assert rows["e.g"].with_period > 50
    assert sum(r.with_period for r in rows.values()) >= 3000
    learned = pages.learn_abbreviations(docs, "text")
    assert set(learned) == {"approx", "dept", "e.g", "mt"}
    text = "It is near Mt. Blanc Today. The Dept. Of Water. See e.g. Rivers. Light window."
    split = lambda names: docs.limit(1).select(T.split_sentences(F.lit(text), names).alias("s")).first().s
    assert split(pages.abbreviation_patterns(learned)) == ["It is near Mt. Blanc Today.", "The Dept. Of Water.", "See e.g. Rivers.", "Light window."]
    assert split(T.ABBREVIATIONS) == ["It is near Mt.", "Blanc Today.", "The Dept.", "Of Water.", "See e.g. Rivers.", "Light window."]
    assert pages.learn_abbreviations(docs.limit(0), "text") == []
