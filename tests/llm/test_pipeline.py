"""The pipeline's stages: what they keep, and that they stand awkward tables."""

import re
from pathlib import Path

import pytest
from compare import connection, same

import corpus_pipeline
from quern.llm import jaccard_groups, registry, subword_classifier, template_leaks
from quern.llm.common import returning

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def folder(spark, tmp_path, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    text = "The quick brown fox jumps over the lazy dog near the river bank today."
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_awkward_tables(spark, awkward, empty, folder, name):
    out = STAGES[name](spark, awkward, folder)
    assert out.columns == awkward.columns and [t for _, t in out.dtypes] == [t for _, t in awkward.dtypes]
    assert out.count() <= awkward.count() and STAGES[name](spark, empty, folder).count() == 0


def test_last_stage(spark, awkward, empty, folder):
    out = STAGES["encoding"](spark, awkward, folder)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"] and out.count() == awkward.count()
    assert all(r.n_tokens == len(r.ids) for r in out.collect())
    assert STAGES["encoding"](spark, empty, folder).count() == 0


def test_near_duplicates_keep_one(spark, awkward, folder):
    ids = [r.doc_id for r in STAGES["near_duplicates"](spark, awkward, folder).collect()]
    # 2 goes for 1; rows without words or ids stay; rows of one id are one document.
    assert sorted(map(str, ids)) == sorted(map(str, [1, 3, 4, 5, 6, 7, 7, None, None, 8, 9]))


def test_stages_are_their_operators(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(STAGES["quality"](spark, docs, data)) == {r.doc_id for r in subword_classifier.digest(docs, labels).where("predicted = 1").collect()}
    assert ids(STAGES["near_duplicates"](spark, docs, data)) == {r.component_id for r in jaccard_groups.digest(docs).collect()}
    assert ids(STAGES["decontamination"](spark, docs, data)) == ids(docs) - ids(template_leaks.leaks(docs, benchmark))


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert 0 < out.count() < spark.read.parquet(f"{data}/documents.parquet").count()


def test_stages_give_workers_memory_back(spark, awkward, folder, monkeypatch):
    kind, given = type(awkward), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *more: given.append(run.__qualname__) or plain(self, run, *more))
    for name in ("quality", "near_duplicates", "personal_data", "encoding"):
        before = len(given)
        STAGES[name](spark, awkward, folder)
        assert len(given) > before and all(x.startswith("returning.") for x in given), name


def test_memory_goes_back():
    held_mb = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    above = []

    def run(batches):
        for batch in batches:
            used = [bytearray(60_000) for _ in range(3_000)]
            # What stays above them keeps the allocator from giving them back by itself.
            above.append([bytearray(60_000) for _ in range(20)])
            yield batch
            del used

    before = held_mb()
    assert [*returning(run)(iter([1]))] == [1] and held_mb() < before + 60


SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_what_its_sql_says(spark, data, name):
    same(registry.queries()[name](spark, data), connection(data), SQL[name])
