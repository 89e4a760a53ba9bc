import pytest
from pyspark.sql import functions as F

from quern.operators.ingest import Index, corpus_topics, fingerprints
from quern.streaming import tables

SCHEMA = "source string, page int, doc_ord long, content string"


def test_incremental_builds(spark, tmp_path):
    index, stages = Index(spark, f"file://{tmp_path}/index"), []
    say = lambda stage, message: stages.append(stage)
    first = [("a.md", None, 0, "alpha " * 300), ("b.pdf", 1, 0, "one"), ("b.pdf", 2, 1, "two"), ("e.md", None, 0, "")]
    pages = spark.createDataFrame(first, SCHEMA)
    done = index.build(pages, on_stage=say)
    assert (done.changed_files, done.skipped_files, done.removed_files) == (3, 0, 0) and done.indexed_chunks == index.chunks().count() == 5
    assert stages == ["parsing", "indexing", "indexing"]
    assert {r.source: len(r.chunk_ids) for r in index.manifest().collect()} == {"a.md": 3, "b.pdf": 2, "e.md": 0}
    stages.clear()
    again = index.build(pages, on_stage=say)
    assert (again.indexed_chunks, again.changed_files, again.skipped_files) == (0, 0, 3) and stages == ["parsing", "indexing"]
    # An edited page, a removed file, a new one.
    second = [("b.pdf", 1, 0, "one"), ("b.pdf", 2, 1, "three"), ("e.md", None, 0, ""), ("n.md", None, 0, "new")]
    third = index.build(spark.createDataFrame(second, SCHEMA))
    assert (third.indexed_chunks, third.changed_files, third.skipped_files, third.removed_files) == (3, 2, 1, 1)
    assert sorted(r.content for r in index.chunks().collect()) == ["new", "one", "three"]
    full = index.build(spark.createDataFrame(second, SCHEMA), incremental=False)
    assert full.changed_files == 3 and full.skipped_files == 0 and index.ready() == (True, None)


def test_fingerprints_see_order(spark):
    a = spark.createDataFrame([("x", 1, 0, "1"), ("x", 2, 1, "2"), ("y", 1, 0, "2"), ("y", 2, 1, "1")], SCHEMA)
    hashes = {r.source: r.hash for r in fingerprints(a).collect()}
    assert hashes["x"] != hashes["y"]
    import hashlib

    assert hashes["x"] == hashlib.sha256(b"1\x002").hexdigest()
    many = spark.range(2500).select(F.lit("z").alias("source"), F.col("id").cast("int").alias("page"), F.col("id").alias("doc_ord"), F.col("id").cast("string").alias("content"))
    assert fingerprints(many.repartition(7)).first().n_pages == 2500
    # The plain hash at any number of pages, from 1,500 to those numbered apart; null contents are passed over.
    assert fingerprints(many.repartition(7)).first().hash == hashlib.sha256("\0".join(map(str, range(2500))).encode()).hexdigest()
    far = spark.createDataFrame([("f", 1, 10**6, "b"), ("f", 0, 3, "a"), ("f", 2, 10**7, None), ("g", 0, 0, None), (None, 0, 0, "n")], SCHEMA)
    assert {r.source: (r.hash, r.n_pages) for r in fingerprints(far).collect()} == {"f": (hashlib.sha256(b"a\0b").hexdigest(), 3), "g": (hashlib.sha256(b"").hexdigest(), 1), None: (hashlib.sha256(b"n").hexdigest(), 1)}
    assert fingerprints(far.limit(0)).count() == 0


def test_a_run_writes_only_what_is_new(spark, tmp_path, monkeypatch):
    index = Index(spark, f"file://{tmp_path}/index")
    rows = lambda texts: spark.createDataFrame([(s, None, 0, t) for s, t in texts.items()], SCHEMA)
    written = lambda: {d.name: sum(1 for _ in spark.read.parquet(str(d)).collect()) for d in (tmp_path / "index" / "chunks").iterdir()}
    texts = {f"s{i}.md": f"text {i}" for i in range(20)}
    index.build(rows(texts))
    before = set(written())
    texts["s3.md"] = "another"
    del texts["s4.md"]
    assert index.build(rows(texts)).indexed_chunks == 1
    (new,) = set(written()) - before
    assert written()[new] == 1
    assert {r.source: r.content for r in index.chunks().collect()} == texts and {r.source for r in index.manifest().collect()} == set(texts)
    # A source that comes back, and a run that dies before its pointer is there.
    texts["s4.md"] = "text 4"
    with monkeypatch.context() as m:
        m.setattr(Index, "_point_to", lambda self, number, deltas: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.build(rows(texts))
    assert "s4.md" not in {r.source for r in index.chunks().collect()}
    assert index.build(rows(texts)).changed_files == 1 and {r.source: r.content for r in index.chunks().collect()} == texts
    # Two runs at once: the second finds its number taken, and the first stands.
    number, deltas = index.pointer()
    index._point_to(number + 1, deltas)
    with pytest.raises(RuntimeError):
        index._point_to(number + 1, [])
    assert {r.source: r.content for r in index.chunks().collect()} == texts
    # Many deltas become one.
    monkeypatch.setattr(Index, "COMPACT_AT", 3)
    texts["s5.md"] = "five"
    assert index.build(rows(texts)).indexed_chunks == 1
    assert len(index.pointer()[1]) == 1 and {r.source: r.content for r in index.chunks().collect()} == texts
    texts["s6.md"] = "six"
    index.build(rows(texts))
    texts["s7.md"] = "seven"
    index.build(rows(texts))
    assert {r.source: r.content for r in index.chunks().collect()} == texts and len(written()) <= 4


def test_topics(spark):
    assert corpus_topics(spark.createDataFrame([], "source string")).first().topics == "(empty -- no documents indexed yet)"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("first")
    index, results = Index(spark, f"file://{tmp_path}/index"), []
    for text, name in (("second", "b.md"), ("third", "c.md")):
        (tmp_path / "in" / name).write_text(text)
        tables.ingest_stream(tables.file_stream(spark, str(tmp_path / "in")), index, f"{tmp_path}/log", lambda n, r: results.append(r.changed_files)).awaitTermination(120)
    assert results == [2, 1]
    assert sorted(r.content for r in index.chunks().collect()) == ["first", "second", "third"]


def test_live_tasks(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "queued", "m"), (1, 2, "parsing", None), (2, 3, None, "x")], "task_id long, seq long, stage string, message string")
    log.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    q = tables.live_tasks(stream).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("SELECT * FROM live").collect()), key=str) == [(1, "parsing", "m"), (2, None, "x")]
