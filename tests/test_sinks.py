"""Sinks that last: snapshots, their manifest, replays and crashes."""

import pytest

from docdigest.sources import tables
from docdigest.streaming import streams

SCHEMA = "doc_key string, n int"


def rows_of(df):
    return sorted(map(tuple, df.select("doc_key", "n", "batch").collect()))


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(streams, "PARTS", 2)
    monkeypatch.setattr(streams, "TAIL", 5)


def put(spark, path, batch, rows):
    streams._write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, "doc_key", batch)
    streams._settle(spark, path, SCHEMA, batch)


def test_reads_stay_few(spark, tmp_path, few):
    path, want, files = str(tmp_path / "sink"), [], []
    for batch in range(40):
        rows = [(f"k{batch % 7}", batch), (f"only {batch}", batch)]
        put(spark, path, batch, rows)
        want += [(*r, batch) for r in rows]
        files.append(len(streams.stored(spark, path, SCHEMA).inputFiles()))
    assert rows_of(streams.stored(spark, path, SCHEMA)) == sorted(want)
    assert max(files) <= 2 + 2 * 6
    # no more folders than a snapshot, the one before it and what came since
    assert len(list((tmp_path / "sink" / "_snapshots").iterdir())) <= 2
    assert len(list((tmp_path / "sink").glob("batch=*"))) <= 2 * 5 + 2
    newest = {r.doc_key: r.n for r in streams.current(spark, path, schema=SCHEMA).collect()}
    assert newest == {k: n for k, n, _ in want}
    parts = {r.doc_key: r.part for r in streams.stored(spark, path, SCHEMA).collect()}
    some = streams.stored(spark, path, SCHEMA, parts=[parts["k0"]]).collect()
    assert {r.part for r in some} == {parts["k0"]}
    assert sum(r.doc_key == "k0" for r in some) == 6


def test_replays_add_nothing(spark, tmp_path, few):
    path = str(tmp_path / "sink")
    for batch in range(8):
        for _ in range(2):  # each batch twice, as after a crash before its commit
            put(spark, path, batch, [(f"k{batch}", batch)])
    assert rows_of(streams.stored(spark, path, SCHEMA)) == [(f"k{b}", b, b) for b in range(8)]
    assert rows_of(streams.stored(spark, path, SCHEMA, before=7)) == [(f"k{b}", b, b) for b in range(7)]
    with pytest.raises(ValueError, match="folded"):
        streams.stored(spark, path, SCHEMA, before=1)


def test_crash_before_the_manifest(spark, tmp_path, few):
    path = str(tmp_path / "sink")
    for batch in range(5):
        put(spark, path, batch, [(f"k{batch}", batch)])
    before = rows_of(streams.stored(spark, path, SCHEMA))
    # a snapshot that was written in part, and never named
    spark.createDataFrame([("broken", 9, 3, 0)], f"{SCHEMA}, batch long, part int").write.partitionBy("part").parquet(f"{path}/_snapshots/4")
    assert rows_of(streams.stored(spark, path, SCHEMA)) == before
    put(spark, path, 5, [("k5", 5)])
    assert (tmp_path / "sink" / "_manifest" / "4").exists()
    assert rows_of(streams.stored(spark, path, SCHEMA)) == [*before, ("k5", 5, 5)]
    assert streams.stored(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_stream_over_folds(spark, tmp_path, monkeypatch):
    """Documents whose pages come one by one, over several snapshots."""
    monkeypatch.setattr(streams, "PARTS", 2)
    monkeypatch.setattr(streams, "TAIL", 2)
    text = "A page has one long sentence that is kept by all of the gates of it. " * 2
    for number in range(6):
        spark.createDataFrame([("d", number, text), ("e" if number == 3 else "d", 0, text)], tables.SCHEMAS["pages"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert len(list((tmp_path / "out" / "pages" / "_manifest").iterdir())) >= 1
    got = {r.doc_key: r.joined_text for r in streams.current(spark, str(tmp_path / "out" / "docs")).collect()}
    assert got == {"d": ". ".join([text] * 6), "e": text}
    pages = streams.stored(spark, str(tmp_path / "out" / "pages"), tables.SCHEMAS["pages"])
    assert sorted((r.doc_key, r.page_num) for r in pages.collect()) == [*(("d", n) for n in range(6)), ("e", 0)]
