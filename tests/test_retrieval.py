import math

import pytest
from pyspark.sql import functions as F

from quern.operators import decisions, dense, evaluate, fusion, lexical, report
from quern.queries import retrieval

HIT = "question_id long, path string, path_ord int, sub_query_ord int, sub_query string, rank int, content string, source_id string"


def hits(spark, *lists):
    return spark.createDataFrame([(1, p, fusion.PATHS[p], i, "q", r, c, s) for i, (p, docs) in enumerate(lists) for r, (c, s) in enumerate(docs, 1)], HIT)


def test_rrf(spark):
    shared = ("shared", "a")
    rows = fusion.fused(hits(spark, ("vector", [shared, ("solo", "b")]), ("web", [("shared", "w")]))).orderBy("fused_rank").collect()
    assert [(r.content, r.source_id) for r in rows] == [("shared", "a"), ("solo", "b")]
    assert rows[0].rrf_score == pytest.approx(2 / 61) and rows[1].rrf_score == pytest.approx(1 / 62)
    thrice = fusion.fused(hits(spark, *[(p, [shared]) for p in ("vector", "bm25", "web")])).first()
    assert thrice.rrf_score == pytest.approx(3 / 61)
    assert fusion.fused(hits(spark)).count() == 0
    # Twice in one list votes twice; ties keep the order of first sight.
    rows = fusion.fused(hits(spark, ("vector", [shared, shared]), ("bm25", [("x", "c")]), ("web", [("y", "d")]))).orderBy("fused_rank").collect()
    assert rows[0].rrf_score == pytest.approx(1 / 61 + 1 / 62) and [r.content for r in rows[1:]] == ["x", "y"]


def test_fan_out(spark):
    rows = [(1, "q", "both", ["q1", "q2"]), (2, "q", "vector", ["q1"]), (3, "q", "web", []), (4, "q", "none", ["q1"])]
    out = fusion.fan_out(spark.createDataFrame(rows, "question_id long, question string, route string, sub_queries array<string>"))
    assert {r.question_id: r["count"] for r in out.groupBy("question_id").count().collect()} == {1: 6, 2: 2, 3: 1}
    assert out.where("question_id = 3").first().sub_query == "q"


CHUNK = "chunk_id string, chunk_ord long, source string, content string"


def test_bm25(spark):
    texts = ["red fox in the snow", "blue whale in the sea", "green frog in the pond", "the sea is blue, blue, blue"]
    chunks = spark.createDataFrame([(str(i), i, "s", t) for i, t in enumerate(texts)], CHUNK)
    queries = spark.createDataFrame([(1, "Blue SEA"), (2, "zebra"), (3, None), (4, "fox fox")], "query_id long, query string")
    rows = lexical.search(queries, chunks).orderBy("query_id", "rank").collect()
    # Two of four have the terms, so that their idf is zero and nothing is found.
    assert [(r.query_id, r.chunk_id) for r in rows] == [(4, "0")]
    n, dl, avg = 4, 5, (5 + 5 + 5 + 6) / 4
    assert rows[0].score == pytest.approx(2 * (math.log(3.5) - math.log(1.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avg)))


def test_saved_index(spark, tmp_path):
    chunks = spark.createDataFrame([(str(i), i, "s", f"word{i % 7} word{i % 3} the end") for i in range(60)], CHUNK)
    queries = spark.createDataFrame([(i, f"word{i} the word5") for i in range(7)], "query_id long, query string")
    saved = lexical.save_index(chunks, f"{tmp_path}/index")
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert rows(lexical.search_index(queries, saved)) == rows(lexical.search(queries, chunks))


def test_dense(spark):
    texts = spark.createDataFrame([("a", "red fox"), ("b", "blue whale"), ("c", ""), ("d", "red fox")], "id string, text string")
    stored = dense.hash_embeddings(texts, "id", "text")
    assert sum(x * x for x in stored.where("id = 'a'").first().embedding) == pytest.approx(1)
    assert set(stored.where("id = 'c'").first().embedding) == {0.0}
    asked = dense.hash_embeddings(spark.createDataFrame([(1, "RED fox")], "query_id long, q string"), "query_id", "q")
    assert [r.id for r in dense.search(asked, stored, k=2).orderBy("rank").collect()] == ["a", "d"]
    assert dense.search(asked, stored, k=9).count() == 4
    assert dense.search(asked.limit(0), stored).count() == 0


def test_gate(spark):
    questions = spark.createDataFrame([(1, "vector", False), (2, "vector", False), (3, "vector", True), (4, "web", False), (5, "vector", False)], "question_id long, route string, correction_attempted boolean")
    grades = spark.createDataFrame([(1, 1, True, 0.8), (1, 2, True, 0.4), (2, 1, False, 0.1), (3, 1, False, 0.1), (4, 1, True, 0.1)], "question_id long, fused_rank int, relevant boolean, score double")
    out = {r.question_id: (round(r.confidence, 6), r.needs_correction) for r in decisions.gate(questions, grades).collect()}
    assert out == {1: (0.6, False), 2: (0.0, True), 3: (0.0, False), 4: (0.1, False), 5: (0.0, True)}


def test_grades_that_do_not_fit(spark):
    fused = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "question_id long, fused_rank int")
    grades = spark.createDataFrame([(1, 1, False, 0.2), (2, 1, False, 0.3)], "question_id long, fused_rank int, relevant boolean, score double")
    out = sorted(map(tuple, decisions.checked_grades(fused, grades).collect()))
    assert out == [(1, 1, True, 1.0), (1, 2, True, 1.0), (2, 1, False, 0.3)]


def test_providers(spark):
    def broken(rows):
        raise RuntimeError

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, q string")
    out = decisions.provided(df, ["q"], [broken, lambda rows: [q.upper() for (q,) in rows]], "answer", "string", "none")
    assert [r.answer for r in out.orderBy("id").collect()] == ["A", "B"]
    assert [r.answer for r in decisions.provided(df, ["q"], [broken], "answer", "string", "none").collect()] == ["none"] * 2


def test_report(spark):
    rows = [("Known [1][3].", [("[1]", "a.md"), ("[2]", "b.md"), ("[3]", "a.md")]), ("Unknown.", [("[1]", "a.md")])]
    df = spark.createDataFrame(rows, "answer string, citations array<struct<marker:string,source_id:string>>")
    assert [r[0] for r in df.select(report.report_text(F.col("answer"), F.col("citations"))).collect()] == ["Known [1][3].\n\n**Sources:**\n- [1][3] a.md\n", "Unknown.\n"]


def test_latencies(spark):
    rows = [(1, 1, "retrieve_vector", 180.0), (1, 2, "retrieve_bm25", 300.0), (1, 3, "own_node", 250.0), (1, 4, "route_query", 0.25)]
    df = spark.createDataFrame(rows, "run_id long, seq int, node string, latency_ms double")
    assert [(r.label, r.latency_ms) for r in report.latency_by_stage(df).orderBy("stage_ord").collect()] == [("Retrieval", 480.0), ("own_node", 250.0), ("Route", 0.25)]
    assert df.where("seq < 4").agg(report.total_latency(F.col("latency_ms"))).first()[0] == 730.0
    assert df.limit(0).agg(report.total_latency(F.col("latency_ms"))).first()[0] == 0.0


def test_stage_status(spark):
    rows = [(1, i, n, True) for i, n in enumerate(["route_query", "web_search", "grade_and_score", "synthesize_answer"])]
    out = {r.stage: r.status for r in report.stage_status(spark.createDataFrame(rows, "run_id long, seq int, node string, loading boolean")).collect()}
    assert out == {"route_query": "done", "decompose_query": "pending", "retrieve": "done", "fuse_results": "pending", "grade_and_score": "done", "corrective_web_search": "skipped", "synthesize_answer": "active", "format_report": "pending"}


def test_evaluation(spark):
    questions = spark.createDataFrame([(1,), (2,)], "question_id long")
    refs = spark.createDataFrame([(1, 0, "abcd"), (1, 1, "wxyz")], "question_id long, ref_no int, reference string")
    got = spark.createDataFrame([(1, 1, "zzzz"), (1, 2, "abcd"), (1, 3, "abzz")], "question_id long, rank int, retrieved string")
    pairs = evaluate.context_pairs(got, refs)
    assert {r.question_id: r.recall for r in evaluate.context_recall(pairs, questions, refs).collect()} == {1: 0.5, 2: None}
    # The third is half like the first reference: enough for precision, not for recall.
    assert {r.question_id: r.precision for r in evaluate.context_precision(pairs, questions).collect()}[1] == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_context_metrics_of_whole_texts(spark, tmp_path):
    """Against brute force: what follows the first characters counts, in any language."""
    from quern.queries import catalogue

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    items = [(i, f"item {i} " + "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(150 + i))) for i in range(4)]
    docs = [
        (0, items[0][1][:60] + "\u00e9 " * 300, "en"),
        (1, "none", "en"),
        (2, items[2][1].replace("a", "\u00e4"), "de"),
        (3, items[3][1][:70] + "x" * 80, "fr"),
        (4, items[0][1], "de"),
        (5, "\u00fc" * 200, "de"),
        (6, "", "en"),
        (7, items[3][1], "en"),
    ]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    recall, precision = {}, {}
    for i, text in items:
        got = ([f"seen: {text}"] if i % 3 else []) + [t for d, t, _ in docs if d % 4 == i]
        near = [1 - distance(g, text) / max(len(g), len(text)) for g in got]
        recall[i] = float(max(near) > 0.5)
        hits = [x >= 0.5 for x in near]
        precision[i] = sum(sum(hits[: k + 1]) / (k + 1) for k, h in enumerate(hits) if h) / (sum(hits) + 1e-10)
    queries = catalogue()[0]
    assert {r.question_id: r.recall for r in queries["context_recall_whole"](spark, str(tmp_path)).collect()} == recall
    assert {r.question_id: r.precision for r in queries["context_precision_whole"](spark, str(tmp_path)).collect()} == pytest.approx(precision, abs=1e-6)


def test_search_with_vectors_of_mixed_length(spark):
    """A query meets the vectors of its own length, whatever other queries are in its block."""
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0])], "query_id long, embedding array<double>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 3.0, 0.0]), ("d", [1.0, 1.0, 1.0])], "id string, embedding array<double>")
    found = dense.search(queries, vectors, 2).collect()
    assert {(r.query_id, r["rank"]): (r.id, round(r.distance, 6)) for r in found} == {(1, 1): ("a", 0.0), (1, 2): ("b", 1.0), (2, 1): ("c", 0.0), (2, 2): ("d", round(1 - 3**-0.5, 6))}


def test_bm25_shuffles_no_pairs(spark, monkeypatch):
    """What a search shuffles is k rows per query and batch, whatever the number of chunks; it finds what the index finds."""
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    rows = [(f"{i}", i, "s", f"a the word{i % 7} word{i % 3}" + " the" * (i % 5)) for i in range(5, 400)] + [(f"n{i}", i, "s", t) for i, t in enumerate(("", None, "word1 word1", "word1 word1", "Å word6"))]
    chunks = spark.createDataFrame(rows, CHUNK).repartition(3)
    queries = spark.createDataFrame([(i * 10, f"word{i} a WORD5 word5 none{i}") for i in range(8)] + [(None, "word2"), (7, "")], "query_id long, query string")
    plain = lambda df: sorted((r.query_id or -1, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert plain(lexical.search(queries, chunks)) == plain(lexical.search_index(queries, lexical.index(chunks)))
    terms = lexical.term_stats(chunks).join(lexical._asked(queries), "term").selectExpr("query_id", "term", "qtf * idf AS weight")
    listed = chunks.selectExpr("chunk_id", "chunk_ord", "regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+', 0) AS __t")
    scored = lexical._scored(listed, terms, 4.0, "bigint", 2, lexical.DEFAULTS)
    assert 0 < scored.count() <= 2 * 9 * 3
    # Chunks that share an id count together, as in the index.
    twice = chunks.unionByName(chunks.where("chunk_ord < 50"))
    assert plain(lexical.search(queries, twice)) == plain(lexical.search_index(queries, lexical.index(twice)))


def test_hits_are_found_once_and_no_text_is_shuffled(spark, data):
    """corrective_union reads the texts of its hits by two scans, and no scan of texts is dealt out."""
    plan = retrieval.corrective_union(spark, data)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert "SortMergeJoin" not in initial and initial.count("/documents.parquet") <= 4, initial
