"""Source audit, line dedup and conversation trie against brute force, and the structures under them."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from docdigest.llm import decontaminate, divergence, line_dedup
from docdigest.llm.common import cut, forget
from docdigest.llm.conversation_trie import conversation_trie
from docdigest.llm.cuckoo import CuckooFilter
from docdigest.llm.divergence import audit_sources
from docdigest.llm.line_dedup import LineIndex, dedup_lines
from docdigest.llm.transducer import Transducer
from docdigest.llm.url_filter import links_of

LOWER = {x: x + 32 for x in range(65, 91)}


def test_transducer():
    rng = np.random.default_rng(3)
    terms = sorted({bytes(rng.choice([97, 98, 99, 0xC3, 0xA9], int(rng.integers(1, 9))).astype(np.uint8)) for _ in range(3000)})
    t = Transducer.from_bytes(Transducer.build(terms).to_bytes())
    assert t.ordinals(terms).tolist() == list(range(len(terms)))
    known = set(terms)
    others = [x for x in {bytes(rng.integers(97, 100, int(rng.integers(0, 9))).astype(np.uint8)) for _ in range(500)} if x not in known]
    assert others
    assert set(t.ordinals(others).tolist()) == {-1}
    # minimal: as many states as there are different sets of ends
    ends = defaultdict(set)
    for x in terms:
        for i in range(len(x) + 1):
            ends[x[:i]].add(x[i:])
    assert len(t.final) == len({frozenset(e) for e in ends.values()})
    assert Transducer.build([]).ordinals([b"a", b""]).tolist() == [-1, -1]
    assert Transducer.build([b"a" * 5000]).ordinals([b"a" * 5000, b"a" * 4999, b""]).tolist() == [0, -1, -1]
    for bad in ([b"b", b"a"], [b"a", b"a"]):
        with pytest.raises(ValueError):
            Transducer.build(bad)


def audit(rows, min_docs, top=50):
    """The contract, plainly."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), {d[:2] for d in docs}
    for lang, source, w in docs:
        df[lang].update(set(w))
    kept = {lang: sorted((t for t, n in c.items() if n >= min_docs), key=str.encode) for lang, c in df.items()}
    for lang, source, w in docs:
        own = Counter(t for t in w if t in set(kept[lang]))
        count[lang, source].update(own)
        count[lang].update(own)
    share = {}
    for g in [*groups, *kept]:
        terms = kept[g if isinstance(g, str) else g[0]]
        total = sum(count[g].values())
        share[g] = {t: 1 + 10**9 * (count[g][t] + 5) // (total + 5 * len(terms)) for t in terms}
    out = []
    for g in groups:
        pairs = [(-sum(abs(share[g][t] - share[o][t]) for t in kept[g[0]]), o[1].encode(), o[1]) for o in groups if o[0] == g[0] and o != g]
        terms = [(share[g[0]][t] - share[g][t], t.encode(), t) for t in kept[g[0]] if count[g][t] and share[g][t] > share[g[0]][t]]
        out += [(*g, part, item, -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, _, item) in enumerate(sorted(found), 1) if part == "pair" or r <= top]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:  # many transducers, dealt terms, several blocks of terms and of sources, counts handed on often
        for name, value in {"SHARD_TERMS": 7, "BLOCK_TERMS": 16, "BLOCK_SOURCES": 2, "HELD_TERMS": 20, "SALTS": 3}.items():
            monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(5)
    words = [*"Alpha beta GAMMA é É ß 日本 ſ K naïve".split(), *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 40)))) + "-1_x", "en" if i % 3 else "fr", f"s{i % 5}") for i in range(120)]
    rows += [(None, "en", "s0"), ("", "en", "only empty"), ("alpha " * 300_000, "en", None), ("once", None, None), ("lone", "de", "a"), ("none", "de", "b"), ("x" * 70_000, "fr", "s1"), *rows[:5]]
    # a language whose kept terms all tie
    rows += [("aa ab ba", "tie", s) for s in "pq" for _ in range(4)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, source string, term int").repartition(6)
    got = audit_sources(docs, 4, 9, sent_bytes=0 if small else 1 << 20)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = audit(rows, 4, 9)
    assert sorted(map(tuple, got.collect())) == want
    assert {r[2] for r in want if r[0] == "en"} == {"pair", "term"}
    assert ("de", "a", "pair", "b", 0, 1) in want
    assert audit_sources(docs.limit(0)).count() == 0


@pytest.mark.parametrize("held", [1, 1 << 22])
@pytest.mark.parametrize("once", [False, True])
def test_counted_terms(monkeypatch, once, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    spell = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    texts = ["", "a Ab abc", "abc", "same seven eightlet eightlett eightletter EIGHTLETTERS", "\0a\0b-\0", "ééé éééé ééééé 日本 日本語 K ſ\xa0x", "1 2 -", "b" * 20_000, "b" * 20_000]
    texts += [" ".join(spell(i % 90_000 * 7919) for i in range(400_000)), "z" * 3_000_000 + " " + "Ab " * 900_000, "abc"]
    rows = [("en" if i % 4 else "fr", text) for i, text in enumerate(texts)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 5], strict=True)], ["lang", "text"]) for a in range(0, len(rows), 5)]
    got, want = defaultdict(Counter), defaultdict(Counter)
    for counts, longer in divergence._counted(iter(batches), once):
        for (lang,), (keys, n) in counts.items():
            assert len(set(keys.tolist())) == len(keys)
            got[lang].update(dict(zip(divergence._spelled(keys, longer), n.tolist(), strict=True)))
    for lang, text in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOWER))
        want[lang].update(x.encode() for x in (set(terms) if once else terms))
    assert got == want


def test_recount_hands_on_blocks(spark):
    """Tasks shuffle a row for each group and block of terms, not one for each term."""
    words = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    rows = [("en", f"s{i % 3}", " ".join(words[: 590 + i // 3 % 11])) for i in range(48)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4).localCheckpoint()
    shards, terms = divergence.vocabulary(docs, 2)
    name = {r.ord: r.term for r in terms.collect()}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = divergence.recount(docs, shards)
        got = Counter({(r.source, name[r.ord]): r.n for r in found.collect()})
        node, records = found._jdf.queryExecution().executedPlan(), []
        while node is not None:
            if "Exchange" in node.nodeName():
                records.append(node.metrics().apply("shuffleRecordsWritten").value())
            node = node.children().apply(0) if node.children().size() else None
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == Counter((source, x) for _, source, text in rows for x in text.split())
    assert records
    assert sum(records) <= 4 * 3 * 2


def test_audit_counts_beyond_64_bits(spark):
    row = spark.range(1).select(divergence._share("9000000000000000000", "9000000000000000001", "3").alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**18 + 5) // (9 * 10**18 + 1 + 15)


def test_cuckoo():
    rng = np.random.default_rng(7)
    values = np.unique(rng.integers(0, 1 << 63, 60_000).astype(np.uint64))
    f = CuckooFilter.sized(len(values))
    held = set()
    for part in np.array_split(values, 5):
        f.insert(part)
        held |= set(part.tolist())
        assert f.contains(np.array(sorted(held), np.uint64)).all()
    assert len(f) == len(values)
    assert len(f.stash) < 50
    out = values[::3]
    f.delete(out)
    f = CuckooFilter.from_bytes(f.to_bytes())
    left = np.setdiff1d(values, out)
    assert f.contains(left).all()
    assert len(f) == len(left)
    assert f.contains(out).mean() < 0.001
    f.delete(left)
    assert len(f) == 0
    # far too small: the rest is listed, found, and goes again; equal values are there as often as they came
    f = CuckooFilter(4)
    many = np.concatenate([values[:200], values[:20], values[:20]])
    f.insert(many)
    assert f.contains(values[:200]).all()
    assert len(f) == 240
    f.delete(values[:20])
    f.delete(values[20:200])
    assert f.contains(values[:20]).all()
    f.delete(np.concatenate([values[:20], values[:20]]))
    assert len(f) == 0


def line_rows():
    rng = np.random.default_rng(11)
    lines = [f"a line that is shared {i}" for i in range(40)] + ["short", "", "  Padded LINE\t\r", "padded line", "123456789", "1234567890", "äöüäöüäöü", "äöüäöüäöüä", "ÄÖÜÄÖÜÄÖÜÄ", "\x0b\x0cvertical line", "nbsp line one "]
    texts = ["\n".join(rng.choice(lines, int(rng.integers(0, 12)))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "Padded line", "x" * 200_000 + "\nq", "one line of its own\n" * 50_000, "x" * 200_000]
    rows = [(int(i * 7 % 101) - 20, t) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "a line that is shared 1\nnobody else"), (None, "nobody else"), (500, "nobody else")]


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda i: (i is None, i)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in held or min(held[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def hashed(rows):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows.collect()), key=str)


def test_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD_KEYS", 30)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10)
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, digest int").repartition(5)
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert hashed(got) == brute_lines(rows)
    assert dedup_lines(docs.limit(0)).count() == 0
    assert hashed(dedup_lines(spark.createDataFrame([(1, "alone in the world")], "doc_id int, text string"))) == brute_lines([(1, "alone in the world")])


def test_lines_can_go_again(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    schema = "doc_id long, text string"
    rows = [r for r in line_rows() if len(r[1] or "") < 10_000]
    table = lambda part: spark.createDataFrame(part, schema)
    parts = [rows[:9], rows[9:40], rows[40:]]
    index, have = LineIndex.empty(spark), []
    for part in parts:
        index, have = index.insert(table(part)), have + part
        assert hashed(index.apply(table(have))) == brute_lines(have)
    index.save(str(tmp_path / "index"))
    index = LineIndex.load(spark, str(tmp_path / "index"))
    for gone in ([r[0] for r in rows[:20]] + [None, 12345], [r[0] for r in rows[30:50]]):
        index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        have = [r for r in have if r[0] not in gone]
        assert hashed(index.apply(table(have))) == brute_lines(have)
    # the same as one built at once, counts and filters
    once = LineIndex.empty(spark).insert(table(have))
    held = lambda x: sorted((bytes(r.digest), r.n, r.first) for r in x.counts.select("digest", "n", "first").collect())
    assert held(index) == held(once)
    size = lambda x: sum(len(CuckooFilter.from_bytes(bytes(r.filter))) for r in x.filters.collect())
    assert size(index) == size(once) == sum(n >= 2 for _, n, _ in held(once))
    index = index.insert(table(parts[0]))
    assert hashed(index.apply(table(have))) != brute_lines(have) or not parts[0]
    # a hot line, of a third of all documents
    hot = [(i, f"the line of all\nown line number {i}" if i % 3 == 0 else f"own line number {i}") for i in range(600)]
    assert hashed(dedup_lines(table(hot))) == brute_lines(hot)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (own.get(c - c % 20) or [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * words
    ends = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(built[c]) == len(n)))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], ends(n)) for n, m in members.items()), key=str)


def test_trie(spark):
    rng = np.random.default_rng(13)
    said = ["Hello  there", "yes", "no", "", None, " a\tb c\n", "long " * 3000]
    rows = []
    for c in [*range(0, 90), 205, 411, 412, 413]:
        for turn in range(int(rng.integers(0, 6))):
            rows.append((c, turn, ["user", "assistant", None][int(rng.integers(3))], said[int(rng.integers(len(said)))]))
    rows += [(c, t, "user", f"turn {t}") for c in (300, 600, 900) for t in range(60)] + [(1200, t, "user", f"turn {t}" if t < 8 else "other") for t in range(20)]  # long copies, and one that leaves them
    rows += [(41, 3, "user", "tie"), (41, 3, "assistant", "tie"), (41, 3, "user", "tie"), (41, None, "user", "first"), (None, 0, "user", "nobody"), *rows[:9]]
    table = spark.createDataFrame([(*r, b"") for r in rows], "conv_id long, turn long, role string, text string, node binary").repartition(5)
    got = conversation_trie(table)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)
    assert conversation_trie(table.limit(0)).count() == 0


def test_trie_without_turns(spark):
    """Conversations whose few turns are all taken away, as their family has no first."""
    rows = [(c, 0, "user", "only") for c in range(1, 20)]
    assert sum(zlib.crc32(str(c).encode()) % 4 > 0 for c in range(1, 20)) > 1
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert sorted(map(tuple, conversation_trie(table).collect()), key=str) == brute_trie(rows)


def test_long_matches_take_no_squares():
    """Verbatim items of many words, and many equal words, against the time that comparing word by word would take."""
    rng = np.random.default_rng(2)
    item = rng.integers(1, 1 << 62, 20_000).astype(np.uint64)
    text = np.concatenate([item[:500] + np.uint64(7), item, item[:300]])
    began = time.time()
    bench = decontaminate.Benchmark([("a", item)])
    pos, group, length = decontaminate.search(bench, bench.ids(text))
    assert time.time() - began < 5
    assert dict(zip(pos.tolist(), length.tolist(), strict=True)) == {500 + i: 20_000 - i for i in range(19_991)} | {20_500 + i: 300 - i for i in range(291)}
    same = np.full(5_000, 9, np.uint64)
    began = time.time()
    bench = decontaminate.Benchmark([("a", same)])
    pos, group, length = decontaminate.search(bench, bench.ids(np.full(200_000, 9, np.uint64)))
    assert time.time() - began < 20
    best = np.zeros(200_000, np.int64)
    np.maximum.at(best, pos, length)
    assert (best[: 200_000 - 9] == np.minimum(5_000, 200_000 - np.arange(200_000 - 9))).all()


def test_common_words_are_counted():
    rng = np.random.default_rng(3)
    for most in (2, 3, 50):
        a, b = (rng.integers(0, most, 3000) for _ in range(2))
        a[500:1500], b[100:1100] = 1, 1
        b[1500:2500] = a[1800:2800]
        i, j = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
        i[:500], j[:500] = 500 + rng.integers(0, 900, 500), 100 + rng.integers(0, 900, 500)
        i[500:900] = 1800 + np.arange(400)
        j[500:900] = 1500 + np.arange(400)
        got = decontaminate._Common(a, b)(i, j)
        for x, y, n in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
            m = next((k for k in range(min(len(a) - x, len(b) - y)) if a[x + k] != b[y + k] or not a[x + k]), min(len(a) - x, len(b) - y))
            assert n == m


def test_link_plans_stay_small(spark):
    pages = spark.createDataFrame([("http://a.b/c", "<link rel=canonical href=d>")], "url string, html string")
    plan = pages.select(links_of(pages.url, pages.html).alias("t"))
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    assert plan.first().t == ["http://a.b/d"]


def test_forgotten_tables_leave_no_files(spark):
    df = cut(spark.range(10))
    folder = spark.sparkContext.getCheckpointDir()
    files = lambda: {p for p in Path(folder.removeprefix("file:")).rglob("part-*")}
    held = files()
    forget(df)
    assert len(files()) < len(held)
    forget(spark.range(3))
