"""Each operator against a brute-force version, over the smallest tables and over rows of edge cases."""

import hashlib
import html
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from docdigest.llm import components as component_steps
from docdigest.llm import jaccard_join, queries
from docdigest.llm.chat_format import describe_conversations, escape, format_conversations, unescape
from docdigest.llm.components import connected_components
from docdigest.llm.common import word_hashes
from docdigest.llm.decontaminate import Benchmark, count_hits, drop_contaminated, find_windows, search
from docdigest.llm.html_text import extract_text, host_paths, read_page
from docdigest.llm.jaccard_join import jaccard_components, one_of_each
from docdigest.llm.language_id import fit_prototypes, keep_known, learnable, predict_language
from docdigest.llm.licenses import detections, rules, scan_licenses
from docdigest.llm.mixing import mix, mixed_blocks, permute
from docdigest.llm.near_vectors import near_vectors
from docdigest.llm.substring_dedup import chunk_ends, drop_repeats, repeated_spans
from docdigest.llm.url_filter import judge, links_of

SF = "/root/testdata/sf0.001"
LOWER = {x: x + 32 for x in range(65, 91)}
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def edge_texts():
    """Nulls, blanks, repeated rows, one very long text, other scripts, control characters."""
    words = [f"w{i * i % 977}" for i in range(60_000)]
    near = words[:400] + ["x"] + words[401:1000]
    texts = [None, "", " \n\t", "one", "One", "one two", "a b c", "日本語 テキスト", "\x00 \x1c", "𝐀𝐁 𝐂", "1234 %%% 5678", " ".join(words), " ".join(words[:1000]), " ".join(near), " ".join(words[:1000]).upper()]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12], (None, "one two", None, None, None)]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = SPACED.findall((text or "").translate(LOWER))
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


@pytest.mark.parametrize("native", [False, True])
def test_components(spark, native):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(5001, 5200)] + [(None, 3), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7), native=native).collect())
    real = [(a, b) for a, b in edges if a is not None]
    want = components({x for e in real for x in e}, real)
    assert {n: got.get(n, n) for n in want} == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), native=native).count() == 0


@pytest.mark.parametrize("most", [10, 60])
def test_components_over_many_tasks(spark, monkeypatch, most):
    """Chains, a hub and repeated edges, where a task holds few nodes at once, so that rounds of stars do the rest."""
    monkeypatch.setattr(component_steps, "LOCAL_EDGES", most)
    edges = [(i * 37 % 150, (i + 1) * 37 % 150) for i in range(149)] + [(2000, i) for i in range(2001, 2100)] + [(3000 + i, 3001 + i) for i in range(0, 60, 2)] * 3
    want = components({x for e in edges for x in e}, edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect())
    assert {n: got.get(n, n) for n in want} == want and len(got) == sum(n != c for n, c in want.items())


def test_language_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in table("documents")}
    rows = queries.op1_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id]["lang"] for r in held]) > 0.95


def test_language_edges(spark):
    docs = spark.createDataFrame(edge_texts(), DOCS)
    prototypes = fit_prototypes(docs.where(learnable()))
    rows = predict_language(docs, prototypes).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in predict_language(docs, prototypes.limit(0)).collect()} == {"und"}
    assert fit_prototypes(docs.limit(0)).count() == 0
    assert {r.doc_id for r in keep_known(docs).collect()} == {r.doc_id for r in rows if r.lang_pred != "und"}
    assert predict_language(docs.limit(0), prototypes).count() == 0


@pytest.mark.parametrize("most", [1000, 2])
def test_language_against_sums_of_vectors(spark, monkeypatch, most):
    """Bundles and cosines against sums of trigram vectors, one by one; pieces of a text and blocks of languages change nothing."""
    from docdigest.llm import language_id as L

    monkeypatch.setattr(L, "CHARS", 50)
    monkeypatch.setattr(L, "LANGUAGES", most)
    rows = [(1, "The cat sat.", "en"), (2, "le chat s'est assis là", "fr"), (3, "Die Katze saß " * 30, "de"), (4, "the cat", "aa"), (5, "The cat sat.", "zz"), (6, "été", None), (7, "???", "en")]
    docs = spark.createDataFrame([(*r, 9.5, "k") for r in rows], "doc_id long, text string, lang string, score double, best string")
    letters = np.random.default_rng(L.SEED).choice(np.array([-1, 1], np.float32), (L.SYMBOLS, L.DIM))

    def bundle(text):
        s = [0, *(L._symbol(ord(c)) for c in text.lower()), 0]
        s = [x for i, x in enumerate(s) if i == 0 or x or s[i - 1]]
        return sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(s, s[1:], s[2:], strict=False) if b), np.zeros(L.DIM))

    sums = {}
    for _, text, lang in rows:
        if lang:
            sums[lang] = sums.get(lang, 0) + bundle(text)
    prototypes = fit_prototypes(docs)
    assert {r.lang: np.allclose(r.vector, sums[r.lang]) for r in prototypes.collect()} == dict.fromkeys(sums, True)
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    got = {r.doc_id: r for r in predict_language(docs, prototypes).collect()}
    for i, text, _ in rows[:-1]:
        v = bundle(text)
        cos = {k: float(v @ u / np.linalg.norm(v)) for k, u in unit.items()}
        best = min(cos, key=lambda k: (-round(cos[k], 9), k))
        assert got[i].lang_pred == best and got[i].score == pytest.approx(max(0, cos[best]))
    assert (got[7].lang_pred, got[7].score) == ("und", 0.0) and got[1].best == "k"
    kept = keep_known(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r.score, r.best) for r in kept.collect()} == {(i, 9.5, "k") for i in range(1, 7)}


def check_jaccard(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_id int, n int, family int")
    got = jaccard_components(docs).collect()
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(i := sets[a] & sets[b]) >= 75 * (len(sets[a]) + len(sets[b]) - len(i)) and i]
    of = components(sets, links)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), of[r.doc_id])
    assert {r.doc_id for r in one_of_each(docs).collect()} == {*of.values()} | {None for r in rows if r[0] is None}


def test_jaccard_edges(spark):
    check_jaccard(spark, [(r[0], r[1], 1, 1, 1) for r in edge_texts()])


def test_jaccard_large_families(spark, monkeypatch):
    for name, value in (("PAIRED", 4), ("BLOCK", 8), ("CHUNK", 4), ("WIDE", 3), ("WIDE_CLASS", 17), ("COMMON", 6), ("DEALT", 900), ("PAIRS", 50), ("PER_BUCKET", 2000)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(11)
    base = [f"v{i}" for i in rng.integers(0, 500, 200)]
    rows = []
    for i in range(150):  # near copies of growing distance, some cut short
        words = list(base[: int(rng.integers(120, 200))])
        for at in rng.integers(0, len(words), int(rng.integers(0, 9))):
            words[at] = f"n{rng.integers(0, 30)}"
        rows.append((i * 3 % 151, " ".join(words), 0, 0, 0))
    check_jaccard(spark, rows)


def test_jaccard_family_without_links_is_sent_in_bounded_passes(spark, monkeypatch):
    """Texts of lines that many have tie one family in which few link: no pass sends much more than the family's sets weigh."""
    for name, value in (("PAIRED", 4), ("BLOCK", 8), ("CHUNK", 4), ("WIDE", 1), ("SENT", 1)):
        monkeypatch.setattr(jaccard_join, name, value, raising=False)
    sent, links = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda rows: sent.append(rows.count()) or links(rows))
    rng = np.random.default_rng(5)
    lines = [" ".join(f"v{x}" for x in rng.integers(0, 900, 12)) for _ in range(40)]
    rows = [(i, "\n".join(lines[k] for k in rng.choice(40, 9, replace=False))) for i in range(198)]
    rows += [(198, rows[3][1] + " end"), (199, "start " + rows[150][1])]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == components(sets, pairs) and got[198] == 3 and got[199] == 150
    assert len(sent) > 5 and max(sent) < 3 * len(rows)


@pytest.mark.parametrize("members", [128, 200])
def test_jaccard_candidates_in_bounded_memory(members):
    """10,000 shingles that many sets share: pairs are counted and tied without holding all of their places at once."""
    import tracemalloc

    import pyarrow as pa

    n = 10_000
    sets = np.arange(members, dtype=np.int64)
    rows = [[7] * members, [np.arange(n, dtype=np.uint64).tobytes()] * members, [np.repeat(s, n).tobytes() for s in sets], [np.full(n, n, np.int32).tobytes()] * members, [b""] * members]
    batch = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], jaccard_join._DEALT)
    tracemalloc.start()
    found = list(jaccard_join._candidates([batch]))
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    shared = {}
    for r in (r for b in found for r in b.to_pylist()):
        shared[(r["a"], r["b"])] = None if r["shared"] is None else shared.get((r["a"], r["b"]), 0) + r["shared"]
    if members <= jaccard_join.PAIRED:
        assert len(shared) == members * (members - 1) // 2 and set(shared.values()) == {n}
    else:
        assert len(shared) == members - 1 and set(shared.values()) == {None}


def test_jaccard_small_table(spark):
    rows = [(r["doc_id"], r["text"], 0, 0, 0) for r in table("documents")]
    check_jaccard(spark, rows)


def test_substring_passages(spark):
    rng = np.random.default_rng(2)
    fresh = lambda n: " ".join(f"q{x}" for x in rng.integers(0, 10**9, n))
    passages = [fresh(51) for _ in range(40)]
    whole = [(i, f"{fresh(30 + i % 7)} {passages[i % 40]} {fresh(40)}", None, None, None) for i in range(80)]
    whole += [(100, None, None, None, None), (101, "", None, None, None), (None, passages[0], None, None, None), (102, fresh(30_000), None, None, None), (103, fresh(60), None, None, None)]
    docs = spark.createDataFrame([*whole, whole[-1], whole[41]], DOCS)
    found = {(r.doc_id, whole[r.doc_id][1][r.start : r.end], r.n_words, r.first_doc_id) for r in repeated_spans(docs).collect()}
    want = {(i, passages[i % 40], 51, i - 40) for i in range(40, 80)}
    assert len(found & want) >= 39 and len(found) == 40 and {r[0] for r in found} == set(range(40, 80))
    kept = {r.doc_id: r.text for r in drop_repeats(docs).collect()}
    assert all(kept[i] == whole[i][1] for i in range(40)) and kept[102] == whole[-2][1] and kept[103] == whole[-1][1]
    assert sum(len(kept[i].split()) == 70 + i % 7 for i in range(40, 80)) >= 39
    assert drop_repeats(docs.limit(0)).count() == 0 and repeated_spans(docs.limit(0)).count() == 0


def test_substring_finds_what_repeats(spark):
    """Nearly all words of runs of 50 that occur before are found, and what is found occurs before."""
    rows = sorted((r["doc_id"], r["text"]) for r in table("documents") if r["text"])
    spans = {}
    for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    seen, short, must, caught, inside, known = set(), set(), 0, 0, 0, 0
    for doc_id, text in rows:
        at = [(m.start(), m.end()) for m in SPACED.finditer(text)]
        words = [text[a:b] for a, b in at]
        own, old, few = {}, set(), set()
        for i in range(len(words)):
            run, five = tuple(words[i : i + 50]), tuple(words[i : i + 5])
            if len(run) == 50 and (run in seen or own.get(run, i) + 50 <= i):
                old.update(range(i, i + 50))
            if five in short or five in own:
                few.update(range(i, i + 5))
            own.setdefault(run, i)
            own.setdefault(five, i)
        covered = {i for i, (a, b) in enumerate(at) if any(s <= a and b <= e for s, e in spans.get(doc_id, ()))}
        must, caught = must + len(old), caught + len(old & covered)
        inside, known = inside + len(covered), known + len(covered & few)
        seen |= {r for r in own if len(r) == 50}
        short |= {r for r in own if len(r) == 5}
    assert must > 1000 and caught >= 0.98 * must and known >= 0.98 * inside


def test_substring_without_spaces(spark):
    rng = np.random.default_rng(8)
    text = "".join(chr(x) for x in rng.integers(0x4E00, 0x9FA0, 2000))
    other = "".join(chr(x) for x in rng.integers(0x4E00, 0x9FA0, 2000))
    docs = spark.createDataFrame([(1, text), (2, other[:700] + text[300:1700] + other[700:]), (3, other), (4, text)], "doc_id long, text string")
    found = sorted((r.doc_id, r.start, r.end) for r in repeated_spans(docs).collect())
    assert found[0] == (2, 700, 2100) and found[-1] == (4, 0, 2000)
    kept = {r.doc_id: r.text for r in drop_repeats(docs).collect()}
    assert kept[1] == text and kept[2] == other and 4 not in kept


def test_substring_copies_of_edited_copies(spark):
    words = [f"z{x}" for x in np.random.default_rng(3).integers(0, 10**9, 300)]
    edited = [w if i % 25 else f"{w}e" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words), None, None, None), (2, " ".join(edited), None, None, None), (3, " ".join(edited), None, None, None)], DOCS)
    third = [r for r in repeated_spans(docs).collect() if r.doc_id == 3]
    assert len(third) == 1 and third[0].n_words == 300 and third[0].first_doc_id == 1
    assert {r.doc_id for r in drop_repeats(docs).collect()} == {1, 2}


def test_chunks_resist_insertions():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    shifted = np.concatenate([h[:50], h[:3] + np.uint64(1), h[50:]])
    assert len(set(chunk_ends(h)[chunk_ends(h) > 70] + 3) - set(chunk_ends(shifted))) == 0
    assert np.diff(chunk_ends(np.ones(1000, np.uint64))).max() <= 64


def test_licenses(spark):
    texts = {1: "Licensed under CC BY-NC 4.0.", 2: "under the GNU General Public License, version 3. All rights reserved.", 3: None, 4: "", 5: "accby cc bye all rights preserved", 6: "é cc by cc-by CC\nBY", 7: "Released under the MIT License."}
    rows = [*texts.items(), *((r["doc_id"] + 100, r["text"]) for r in table("documents"))]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        places = [(j, label) for p, label in phrases.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        at = sorted(j for j, _ in places)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), at[0] if at else None, at[-1] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {*filter(None, r.base_labels.split(","))} <= {*filter(None, r.labels.split(","))} and 0 <= r.score <= 1
    assert got[1].labels == "cc-by,cc-by-nc" and got[7].labels == "mit" and got[2].labels == "gpl,reserved"


def test_license_rules():
    signatures = rules()
    assert len(signatures) > 180 and len({r.pattern.pattern for r in signatures}) == len(signatures)
    for r in signatures:  # each finds its statement, and alone decides on it
        found = detections(f"x {r.example} y".translate(LOWER), signatures)
        assert all(k in r.example.lower() for k in r.keywords), r
        assert (r.label, r.number) in [(x[2].label, x[2].number) for x in found], (r.example, found)
        assert all(b <= c for (_, b, _), (c, _, _) in itertools.pairwise(found))


def test_license_lists_and_denials():
    signatures = rules()
    labels = lambda text: [x[2].label for x in detections(text.translate(LOWER), signatures)]
    tag = "SPDX-License-Identifier: "
    assert labels(tag + "MIT OR Apache-2.0") == ["mit", "apache"]
    assert labels(tag + "(MIT AND (BSD-3-Clause OR GPL-2.0+)) */ isc") == ["mit", "bsd-3-clause", "gpl"]
    assert labels(tag + "GPL-2.0-or-later WITH Classpath-exception-2.0 AND ISC") == ["gpl", "isc"]
    assert labels(tag + "GPL-2.0-only WITH MIT") == ["gpl"]
    assert labels(tag + "MIT\nor ISC") == ["mit"] and labels(tag + "LicenseRef-1 OR ISC") == ["isc"]
    assert labels("dual licensed under MIT and Apache 2.0") == ["mit", "apache"]
    assert labels("Dual-licensed under the MIT, BSD, and GPL v2") == ["mit", "bsd", "gpl"]
    assert labels("licensed under either of Apache License, Version 2.0 or MIT license") == ["apache", "mit"]
    assert labels("under the terms of the GNU GPL v2") == ["gpl"] and labels("released under the GPL v2 or the Mozilla Public License 1.1") == ["gpl", "mpl"]
    assert labels("released under the MIT License and Apache httpd is used") == ["mit"]
    assert labels("not licensed under the GPL") == labels("It is not the MIT license.") == labels("never released under MIT or the Apache License") == []
    assert labels("not only licensed under the GPL") == labels("whether or not licensed under the GPL") == ["gpl"]
    assert labels("Business Source License 1.1, Elastic License 2.0, BlueOak-1.0.0") == ["busl", "elastic", "blueoak"]
    began = time.time()
    assert len(labels(tag + "mit " + "or mit " * 50_000)) == 50_001 and len(labels("licensed under mit" + " or mit license" * 50_000)) == 50_001
    assert labels(tag + " " * 1_000_000) == [] and labels("not " * 200_000 + "licensed under mit") == []
    assert time.time() - began < 20


def test_license_priority_and_speed(spark):
    signatures = rules()
    labels = lambda text: [x[2].label for x in detections(text.lower(), signatures)]
    assert labels("licensed under the gnu lesser general public license v3") == ["lgpl"]
    assert labels("https://creativecommons.org/licenses/by-sa/3.0/ cc by-sa 3.0") == ["cc-by-sa", "cc-by-sa"]
    assert labels("placed in the public domain") == ["public-domain"]
    began = time.time()
    text = "é all rights reserved " * 80_000
    rows = [(1, text, 5), (1, text, 5), (2, "", 5), (3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = scan_licenses(docs).collect()
    assert time.time() - began < 30 and sorted((r.doc_id, r.n_base, r.first_word, r.last_word) for r in got)[:2] == [(1, 80_000, 1, 4 * 79_999 + 1)] * 2
    assert scan_licenses(docs.limit(0)).count() == 0


def hits(text, items):
    words, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    windows, longest = {}, 0
    for name, item in items:
        w = ALNUM.findall((item or "").translate(LOWER))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), []).append((str(name) if name is not None else "null", w, j))
    for n in {len(k) for k in windows}:
        for i in range(len(words) - n + 1):
            seen = set()
            for name, w, j in windows.get(tuple(words[i : i + n]), ()):
                hit.update(range(i, i + n))
                found.add(name)
                if (rest := tuple(w[j:])) not in seen:
                    seen.add(rest)
                    longest = max(longest, next((k for k, (a, b) in enumerate(zip(rest, words[i : i + len(rest)], strict=False)) if a != b), min(len(rest), len(words) - i)))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest


def test_decontamination(spark, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in table("benchmark")] + [(900, "w1 w4 w9"), (901, None), (902, " . "), (None, "one two"), (903, "re " * 60), (904, " ".join(f"w{i * i % 977}" for i in range(100, 300))), (905, "re " * 30 + "x"), (903, "other words of the same item")]
    first = items[0][1]
    rows = [(r["doc_id"], r["text"], "h") for r in table("documents")] + [(r[0], r[1], "h") for r in edge_texts()] + [(500, f"x {first} y {first}", "h"), (501, first[:40], "h"), (502, "re " * 5000 + "x " + "re " * 29, "h")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, hits string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(str(i), *hits(t, items)) for i, t, _ in rows])
    for most, part in ((100_000, 1 << 15), (300, 50)):
        monkeypatch.setattr("docdigest.llm.decontaminate.ITEM_WORDS", most)
        monkeypatch.setattr("docdigest.llm.decontaminate.PART", part)
        got = count_hits(find_windows(docs, bench)).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest) for r in got) == want
    assert max(w[-1] for w in want) >= 200
    assert count_hits(find_windows(docs, bench.limit(0))).where("contaminated").count() == 0
    assert find_windows(docs.limit(0), bench).count() == 0


def test_decontamination_keeps_columns_of_its_names(spark):
    names = ("row", "found", "n_words", "hits", "items", "longest", "before")
    docs = spark.createDataFrame([(1, "a b c", *range(7)), (2, "free text", *range(7))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "free text", *range(7))]
    assert find_windows(docs, bench).where("doc_id = 1").first().n_words == 3


def test_decontamination_memory():
    import tracemalloc

    bench = Benchmark([("a", word_hashes(b"w " * 60)), ("b", word_hashes(b"w " * 300))])
    ids = np.ones(33_000, np.int64)
    tracemalloc.start()
    pos, group, length = search(bench, ids)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert len(set(pos.tolist())) == 33_000 - 9 and length.max() == 300


def test_near_vectors(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table("embeddings")]
    v = rows[0][2]
    rows += [(9001, 1, None), (9002, None, v), (9003, 1, [0.0] * 64), (9004, 1, [float("nan")] * 64), (9005, rows[0][1], [x * 3 for x in v]), (9006, rows[0][1], v[:3]), (9005, rows[0][1], [x * 3 for x in v])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    x = [np.array(e, float) if e and np.isfinite(e).all() and np.linalg.norm(e) else None for _, _, e in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if x[i] is not None and x[j] is not None and rows[i][1] is not None and rows[i][1] == rows[j][1] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93]
    of = components({r[0] for r in rows}, [(rows[i][0], rows[j][0]) for i, j in links])
    n = np.bincount([k for e in links for k in e], minlength=len(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((rows[i][0], int(n[i]), of[rows[i][0]]) for i in range(len(rows)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_recall_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr("docdigest.llm.near_vectors.PER_CELL", 40)
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    links = int(((x @ x.T >= 0.93) & (label[:, None] == label)).sum()) - len(rows)
    found = near_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * links <= found <= links


def test_near_vectors_loses_no_link_between_cells(spark, monkeypatch):
    monkeypatch.setattr("docdigest.llm.near_vectors.PER_CELL", 80)
    random = np.random.default_rng(5)
    x = random.normal(size=(800, 2)) @ random.normal(size=(2, 64)) + 0.3 * random.normal(size=(800, 64))
    rows = [(i, i % 2, v) for i, v in enumerate(x.tolist())]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(800) % 2
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((near.sum(1) - 1).tolist()))
    of = components(range(800), np.argwhere(near).tolist())
    assert {r.vec_id: r.component_id for r in got} == {i: of[i] for i in range(800)}


@pytest.mark.parametrize("effective", [8, 16])
def test_near_vectors_of_few_directions(spark, monkeypatch, effective):
    """768 dimensions that vary in few directions, more than 128 cells: every link is found, and none twice."""
    from docdigest.llm import near_vectors as N

    monkeypatch.setattr(N, "PER_CELL", 15)
    random = np.random.default_rng(effective)
    x = random.normal(size=(2100, effective)) @ random.normal(size=(effective, 768)) + 0.02 * random.normal(size=(2100, 768))
    x[1000:] = x[:1100] + 0.3 * random.normal(size=(1100, 768)) * np.linalg.norm(x[:1100], axis=1, keepdims=True) / 768**0.5
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    assert near.sum() > 500 and [got[i] for i in range(2100)] == near.tolist()
    assert near_vectors(df.limit(0)).count() == 0


def test_centroids_of_large_tables_fit_the_driver():
    import tracemalloc

    from docdigest.llm import near_vectors as N

    tracemalloc.start()
    x = np.random.default_rng(1).normal(size=(5000, 768))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    N._cells({1: N.spherical_kmeans(x, 1024, rounds=1)}, 0.93)
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_urls(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "https://a.example.org/es/1?x", link("https://z.net/one")),
        (2, "http://z.net/one#top", None),
        (3, "http://q.net/", '<META http-equiv="refresh" content="0; url=http://z.net/one">'),
        (4, "HTTPS://EXAMPLE.ORG/en/1", ""),
        (5, "http://n.net/de/", link("/fr/")),
        (6, "http://w.com/de/x", link("http://c.net/b")),
        (7, "http://c.net/b", link("http://x.org/ok")),
        (8, None, None),
        (9, "no scheme/x", None),
        (10, "http://badcom/de/", None),
        (2, "http://z.net/one#top", None),
    ]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=lambda r: r[0])
    assert got == [
        (1, "a.example.org", "/es/1", "example.org/es/", "block"),
        (2, "z.net", "/one", None, "block"),
        (2, "z.net", "/one", None, "block"),
        (3, "q.net", "/", None, "block"),
        (4, "example.org", "/en/1", "example.org/en/1", "block"),
        (5, "n.net", "/de/", None, "allow"),
        (6, "w.com", "/de/x", "com/de/", "block"),
        (7, "c.net", "/b", None, "allow"),
        (8, "", "", None, "allow"),
        (9, "", "", None, "allow"),
        (10, "badcom", "/de/", None, "allow"),
    ]


def test_urls_resolve_targets(spark):
    page = "http://h.net/a/b/c.html?q=1#f"
    cases = {"../x": "http://h.net/a/x", "b.html": "http://h.net/a/b/b.html", "./b?z#y": "http://h.net/a/b/b?z#y", "/r/../s": "http://h.net/s", "//o.net/p": "http://o.net/p", "?p=2": "http://h.net/a/b/c.html?p=2", "../../../..": "http://h.net/", "#top": None, "mailto:x@y": None, "HTTPS://o.net/": "HTTPS://o.net/", "a&amp;b&#47;c&#x2E;d&nope;e&": "http://h.net/a/b/a&b/c.d&nope;e&", "&#1114112;&#xD800;&#0;&#x1F600;": "http://h.net/a/b/\ufffd\ufffd\ufffd\U0001f600"}
    rows = [(i, page, f'<link href="{t}" rel="canonical">') for i, t in enumerate(cases)]
    rows += [(100, page, "<base href='/base/'><link rel='alternate canonical' href='k'>"), (101, page, "<!-- <link rel=canonical href=k> --><link rel=stylesheet href=canonical><link data-href=q rel=canonical href=r>"), (102, page, None), (103, "no url", "<link rel=canonical href=k>"), (104, page, "<meta content=\"3; URL='n/../m'\" http-equiv=Refresh>")]
    df = spark.createDataFrame(rows, "i int, url string, html string")
    got = {r.i: r.t for r in df.select("i", links_of(df.url, df.html).alias("t")).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i] == ([want] if want else []), (i, want, got[i])
    assert got[100] == ["http://h.net/base/k"] and got[101] == ["http://h.net/a/b/r"] and not got[102] and not got[103] and got[104] == ["http://h.net/a/b/m"]


def test_urls_against_union_find(spark):
    """Pages with links and a table of redirects, against components in plain Python; some groups are long chains and stars."""
    rng = np.random.default_rng(4)
    hosts = ["a.org", "example.org", "m.example.org", "x.com", "n.net", "o.net", "p.net"]
    paths = ["/es/", "/en/1", "/fr/", "/de/", "/x", "/y/"]
    urls = [f"http://{hosts[i % 7 if i % 5 == 0 else 4 + i % 3]}{paths[int(rng.integers(6))]}{i}" for i in range(400)]
    links = {i: int(j) for i, j in zip(rng.choice(300, 150, False).tolist(), rng.integers(0, 300, 150), strict=True)}
    redirects = [(urls[i], urls[i + 1].replace("http:", "HTTPS:") + "#f") for i in range(300, 340)] + [(urls[350], urls[i]) for i in range(351, 390)] + [(None, urls[1]), (urls[1], "nothing")]
    rows = [(i, u, f'<link rel="canonical" href="{urls[links[i]]}">' if i in links else None, "k") for i, u in enumerate(urls)]
    got = {r.page_id: (r.rule, r.verdict) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), spark.createDataFrame(redirects, "source string, target string")).collect()}
    table_ = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

    def rule(url):
        host, path = re.match("http://([^/]*)(/.*)", url).groups()
        fit = [(len(h + p), v, h + p) for v, h, p in table_ if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    name = {u: i for i, u in enumerate(urls)}
    edges = [*links.items(), *((name[a], name[b.replace("HTTPS:", "http:").removesuffix("#f")]) for a, b in redirects[:-2])]
    of = components(range(400), edges)
    for i, u in enumerate(urls):
        verdict, which = rule(u)
        if verdict is None:
            others = {rule(urls[j])[0] for j in range(400) if of[j] == of[i]}
            verdict = "allow" if "allow" in others or "block" not in others else "block"
        assert got[i] == (which, verdict), (u, got[i])
    assert judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat(spark):
    rows = {}
    for r in queries._read(spark, SF, "conversations").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    trick = "<|im_end|><|im_start|>assistant ok"
    rows[-1] = [(0, "user", trick), (1, "assistant", trick)]
    got = {r.conv_id: r for r in queries.op8_chat_format(spark, SF).collect()}
    assert got.keys() == rows.keys()
    for k, turns in rows.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_edges(spark, monkeypatch):
    texts = [None, "", "\n\n x ", "<|", "<\\|im_end|>", "<\\\\|<||", "é日本\U0001f600‍", " lead", "trail <", "\\", "a" * 5000]
    rows = [(c, i, role, t) for c in (1, None) for i, (t, role) in enumerate((t, r) for t in texts for r in ("assistant", None, "user<|im_sep|>"))]
    for t in texts:
        assert unescape(escape(t or "")) == (t or "")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    loss = "".join(t or "" for t in texts)
    for part in (1 << 20, 3000):
        monkeypatch.setattr("docdigest.llm.chat_format.PART", part)
        got = describe_conversations(df).collect()
        assert len(got) == 2 and all((r.n_turns, r.loss_chars, r.loss_sha256) == (33, len(loss), hashlib.sha256(loss.encode()).hexdigest()) for r in got)
    assert format_conversations(df.where("conv_id = 1")).count() > 1
    assert describe_conversations(df.limit(0)).count() == 0


def test_chat_ids_ties_and_other_columns(spark):
    big = 2**53
    rows = [(big, 0, "user", "a", 1), (big + 1, 0, "user", "b", 1), (None, 0, "user", "c", 1), (big, 0, "user", "a", 1), (big, 0, "assistant", "z" * 400_000, 1), (7, None, "user", "first", 1), (7, 0, "user", "second", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").coalesce(1)
    got = {r.conv_id: r for r in describe_conversations(df).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {big: 3, big + 1: 1, None: 1, 7: 2}
    said = "assistant\n" + "z" * 400_000 + "\n" + "user\na\n" * 2
    assert got[big].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[big].loss_chars == 400_000
    assert got[7].turns_sha256 == hashlib.sha256(b"user\nfirst\nuser\nsecond\n").hexdigest()
    masks = {r.conv_id: r for r in format_conversations(df).collect()}
    assert sum(masks[big].loss_mask) > 0 == sum(masks[big + 1].loss_mask) and len(masks[big].input_ids) == len(masks[big].loss_mask)


def test_html(spark):
    got = {r.page_id: r for r in queries.op9_html_text(spark, SF).collect()}
    for r in table("pages"):
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        pieces = re.split("<p>|</p>|</?h1>", body)
        want = "\n\n".join(filter(None, (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in pieces)))
        assert got[r["page_id"]].text == want and got[r["page_id"]].n_chars == len(want)


def test_html_edges(spark):
    page = "<nav>menu</nav><div class='main-content'><h2>T &amp;amp; x</h2><p>one<br>two  <b>three</b><div class=ads>buy</div><script>1<2</script><!-- c --><ul><li>a<li>b</ul><div id='comments'>bad</div></div><footer>f</footer>"
    rows = [(1, "http://h/1", page, 1, "k"), (2, None, None, 1, "k"), (3, "x", "", 1, "k"), (4, "http://h/2", "plain &lt;text", 1, "k"), (5, "http://h/3", "<div class='main-content'>cut &am", 1, "k"), (6, "http://h/4", "<p" * 50_000, 1, "k"), (1, "http://h/1", page, 1, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int, __key string")
    got = extract_text(pages).collect()
    assert sorted((r.page_id, r.text) for r in got)[:2] == [(1, "T &amp; x\n\none two three\n\na\n\nb")] * 2
    assert {r.page_id: r.text for r in got if r.page_id != 1} == {2: "", 3: "", 4: "plain <text", 5: "cut &am", 6: ""}
    assert extract_text(pages.limit(0)).count() == 0


LONG = "Plain words of the main text, again and again. " * 12


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<article><h1>Title</h1><div class='entry'><p>{}</p></div></article>", "Title|{}"),
        ("<div><div class=title><h1>Title</h1></div><div class=body>{}</div></div>", "Title|{}"),
        ("<section class=a><p>{}</p></section><section class=b><p>{} {}</p></section>", "{}|{} {}"),
        ("<article><p>{}</p><table><tr><td>{} {}<td>x</table></article>", "{}|{} {}|x"),
        ("<article><h2 id='related-work'>Related</h2><p class='share-price'>{}</p><p title='hidden gem'>seen</p></article>", "Related|{}|seen"),
        ("<body><div id=wrap><div class='cookie-banner'>no</div><div class='post'><h1>T</h1><p>{}</div><div>stray</div></div>", "T|{}|stray"),
        ("<div class=wrap><p>Lead.</p><div class=text><p>{}</p></div><p>Close.</p><div><a href=x>Home</a> <a href=y>Archive</a></div></div>", "Lead.|{}|Close.|Home Archive"),
        ("<div><a href=x>Home</a></div><div class=post><p>{}</p></div>", "{}"),
        ("<body><article class=a><p>{}</p></article><article class=b>Short.</article></body>", "{}|Short."),
        ("<article><p>{}</p><section id=search><p>Search</p></section><table class=related><tr><td>cell</table><div id=menu>dish</div><div class=share>no</div><div id=comments>no</div></article>", "{}|Search|cell|dish"),
        ("<ul><li><a href=x>only</a><li><a href=y>links</a></ul>", "only|links"),
        ("<main><article><p>{}</p><ul class='comment-list'><li>no</ul></article><div class='sidebar left'>no</div></main>", "{}"),
        ("<article><header><h1>T</h1></header><p>{}</p><p class=ad>no</p></article><header>no</header>", "T|{}"),
        ("<div>" * 100_000 + "{}", "{}"),
        ("<article>" + "<p class='a>b" * 20_000 + "<p>{}</article>", None),
        ("<b>" * 50_000 + "<hr>" * 50_000 + "{}", "{}"),
        ("<div>" * 50_000 + "</p>" * 50_000 + "{}", "{}"),
        ("<script>if (a<b) '</p>'</script><article>{}</article>", "{}"),
        ("<form><nav>no</nav><article><h1>T</h1><p>{}</p></article><select><option>no</select></form>", "T|{}"),
        ("<div class='content-sidebar-wrap'><p>{}</p><div class='sidebar-primary'>no</div></div>", "{}"),
    ],
)
def test_html_keeps_the_article(source, want):
    began = time.time()
    page, x = read_page(source.replace("{}", LONG.strip()))
    text = page.text(page.key[x])
    assert time.time() - began < 20
    assert text is not None and (want is None or text == want.replace("{}", LONG.strip()).replace("|", "\n\n"))


def test_html_host_votes(spark):
    usual, odd = f"<article><p>{LONG}</p></article>", f"<article><p>{LONG}</p></article><div><p>{LONG[:200]}</p></div>"
    rows = [(i, "http://a/x", usual) for i in range(5)] + [(9, "http://a/y", odd), (10, "http://b/y", odd), (11, "http://a/z", f"<div>{LONG}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    both = f"{LONG.strip()}\n\n{LONG[:200].strip()}"
    assert got[0] == got[11] == LONG.strip() and got[9] == got[10] == both
    assert {r.host: (r.path, r.votes) for r in host_paths(pages).collect()} == {"a": ("/article", 5), "b": ("/", 1)}


def test_html_loses_nothing(spark):
    """Generated pages of few hosts: what is read is every paragraph outside of marked elements, in order, wherever the hosts' usual containers are."""
    rng, rows, want = random.Random(9), [], {}
    for i in range(150):
        said, n = [], iter(range(10**6))

        def inner(depth, out):
            parts = []
            for _ in range(rng.randint(1, 3)):
                kind = rng.random()
                if depth and kind < 0.45:
                    tag = rng.choice(["div", "section", "div class=text", "div class='body x2'", "article", "article class=b"])
                    parts.append(f"<{tag}>{inner(depth - 1, out)}</{tag.split()[0]}>")
                elif depth and kind < 0.6:
                    tag = rng.choice(["nav", "footer", "div class=sidebar", "aside", "div id=comments", "div class='cookie-banner'", "form"])
                    parts.append(f"<{tag}>{inner(0, True)}</{tag.split()[0]}>")
                else:
                    text = f"page {i} part {next(n)} " + "word " * rng.choice([0, 1, 3, 40, 200])
                    said.extend([] if out else [text.strip()])
                    parts.append(f"<p>{text}</p>")
            return "".join(parts)

        usual = i % 2 == 0
        source = f"<body><div class=content>{inner(0, False)}</div>" + ("" if usual else f"<div class=more>{inner(3, False)}</div>") + "</body>"
        rows.append((i, f"http://h{i % 3}/{i}", source))
        want[i] = "\n\n".join(said)
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, found = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    order = sorted(got.columns)
    assert sorted(names) == order
    shape = lambda row: tuple(str(row[c]) for c in order)
    assert sorted(shape(r.asDict()) for r in got.collect()) == sorted(shape(dict(zip(names, r, strict=True))) for r in found.fetchall())


def test_permutation():
    for n in (1, 2, 3, 100, 4097):
        assert sorted(permute(np.arange(n), n, 12345)) == list(range(n))


def check_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs).collect()
    size = lambda t: len(SPACED.findall(t or ""))
    total = {}
    for _, t, s, _ in rows:
        total[s] = total.get(s, 0) + size(t)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, full = 1.5 * sum(total.values()), {s for s in names if not total[s]}
    while True:
        each = max(0, want - sum(2 * total[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        if not (over := {s for s in names if s not in full and weight[s] * each > 2 * total[s]}):
            break
        full |= over
    target = {s: 2 * total[s] if s in full else weight[s] * each for s in names}
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in got) == sorted((str(i), size(t), total[s]) for i, t, s, _ in rows)
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 64 for s in names)
    again = mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing(spark):
    check_mix(spark, [(r["doc_id"], r["text"], r["source"], 1) for r in table("documents")])


def test_mixing_edges(spark):
    check_mix(spark, [(r[0], r[1], r[3], 1) for r in edge_texts()] + [(77, " ", "empty", 1), (78, "a b", "tiny", 1)])
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mixed_blocks_have_the_words(spark):
    rows = [(r[0], r[1], r[3]) for r in edge_texts()] + [(i, f"a{i} \n b{i}\tc{i}", "s") for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, counted = mixed_blocks(docs).collect(), mix(docs).collect()
    texts = {(i, s): t for i, t, s in rows}
    drawn = {}
    for m in mixed:
        assert m.text == "\n\n".join(p.text for p in m.parts) and m.n_words == len(SPACED.findall(m.text)) <= 64
        for p in m.parts:
            words = SPACED.findall(texts[p.doc_id, m.source])
            assert p.size == len(words) and SPACED.findall(p.text) == words[p.word : p.word + p.words] and p.text in texts[p.doc_id, m.source]
            drawn.setdefault((p.doc_id, m.source), []).append((m.shard, m.slot, p.word, p.text))
    assert len({(m.source, m.slot) for m in mixed}) == len(mixed)
    assert sum(m.n_words for m in mixed) == sum(r.taken for r in counted) > 0
    assert all(r.taken == sum(len(SPACED.findall(p.text)) for p in r.pieces) for r in counted)
    found = {}
    for r in counted:
        found.setdefault((r.doc_id, r.source), []).extend(tuple(p) for p in r.pieces)
    assert {k: sorted(v) for k, v in found.items() if v} == {k: sorted(v) for k, v in drawn.items()}


def test_mixing_draws_shards_multinomially(spark, monkeypatch):
    """Counts of shards have the totals asked for and the spread of a multinomial draw; two draws agree."""
    from docdigest.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 100)
    sources = spark.createDataFrame([("=a", 64 * 6000, 64.0 * 9000), ("=b", 64 * 9000, 64.0 * 9000), ("", 64 * 9000, 64.0 * 2500)], "source_key string, source_size long, target double")
    rows = mixing.draw_blocks(sources).collect()
    slots = {"=a": 9000, "=b": 9000, "": 2500}
    shards = round(sum(slots.values()) / 100)
    for key, n in slots.items():
        mine = [r for r in rows if r.source_key == key]
        assert sorted(r.slot for r in mine) == list(range(n))
        counts = np.bincount([r.shard for r in mine], minlength=shards)
        assert len(counts) == shards
        chi = ((counts - n / shards) ** 2 / (n / shards)).sum()
        assert shards - 5 * (2 * shards) ** 0.5 < chi < shards + 5 * (2 * shards) ** 0.5
        taken = np.bincount([r.block for r in mine], minlength=6000)
        assert taken.max() - taken[taken > 0].min() <= 1
    assert sorted(rows) == sorted(mixing.draw_blocks(sources.repartition(3)).collect())
    names = ["b", None, "a", "é", "", "Z", "\U0001f600", "\uffff"]
    ranked = mixing._ranked(spark.createDataFrame([(x,) for x in names], "source string").repartition(3)).collect()
    assert [r.source for r in sorted(ranked, key=lambda r: r.rank)] == ["", "Z", "a", "b", "é", "\uffff", "\U0001f600", None] and sorted(r.rank for r in ranked) == list(range(1, 9))


def test_pipeline_of_no_rows_and_of_clashing_names(spark):
    import corpus_pipeline

    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    names = ["lang_pred", "score", "row", "best", "found", "n_words", "hits", "items", "longest", "s1", "n", "size", "k", "run", "start", "component", "node"]
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f"{text} {i} tail of its own {'x y z ' * i}", "en", "s", 1, *range(len(names))) for i in range(4)] + [(9, None, None, None, None, *range(len(names)))]
    docs = spark.createDataFrame(rows, f"{DOCS}, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        found = docs.collect()
        assert docs.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), *names], name
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in found) and {r.doc_id for r in found} >= {0}, name
    assert "taken" in corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns


def test_jaccard_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs).count() == 0 and one_of_each(docs).count() == 0


def test_html_vote_ties_and_long_pages(spark):
    """Of paths with equally many votes, the greatest digest wins, however rows are dealt; a page of megabytes is read whole."""
    rows = [(1, "http://t/1", f"<div class=a>{LONG}</div>"), (2, "http://t/2", f"<div class=b>{LONG}</div>"), (3, "http://t/3", "<p>" + "word &amp; " * 300_000 + "end</p>" + "<!-- <p> -->" * 10_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    won = {tuple((r.path, r.votes) for r in host_paths(pages.where("page_id < 3").repartition(n)).collect()) for n in (1, 4)}
    assert len(won) == 1 and won.pop()[0][1] == 1
    got = {r.page_id: r for r in extract_text(pages).collect()}
    assert got[1].text == got[2].text == LONG.strip() and got[3].n_chars == len("word & ") * 300_000 + 3
    verdicts = judge(pages.selectExpr("page_id", "url", "concat(html, repeat('<link ', 100000)) as html")).collect()
    assert {r.verdict for r in verdicts} == {"allow"}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(edge_texts(), DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        docs = stage(spark, docs, SF)
        assert docs.count() >= 0
    raw = {r["doc_id"]: r["text"] for r in table("documents")}
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    sets = {k: shingles(raw[k]) for k in kept}
    for a, b in itertools.combinations(kept, 2):
        i = len(sets[a] & sets[b])
        assert not sets[a] or not i or 100 * i < 75 * (len(sets[a]) + len(sets[b]) - i)
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    assert all(kept[k].taken <= 2 * kept[k].size for k in kept)
    assert not any(hits(raw[k], items)[4] for k in list(kept)[:40])
