import json

from pyspark.sql import functions as F

from quern.operators import decisions, evaluate, tasks
from quern.plans.research import Providers, _through, events, research
from quern.sources.files import golden_questions

CHUNKS = [("a::0", 0, "dams.md", "The tall dam on the river holds water. It was built in 1931."), ("b::0", 1, "ferns.md", "Ferns grow in the shade. They have no flowers."), ("c::0", 2, "owls.md", "Owls hunt at night. The barn owl is pale."), ("d::0", 3, "bees.md", "Bees dance to show the way. Honey keeps for years.")]
PAGES = [(1, "http://x.example/1", "<title>Storms</title><p>The latest storm broke the dam wall.</p>"), (2, "http://x.example/2", "<title>Night</title><p>Many owls were seen hunting.</p>"), (3, "http://x.example/3", "<title>Tea</title><p>Tea is warm.</p>")]
QUESTIONS = [(1, "<b>When was the tall dam built?</b>"), (2, "hello"), (3, "   "), (4, "What is the latest storm news?"), (5, "Where do ferns zxcvb qwert asdfg plokm ijnuh grow, and how do owls hunt?")]


def tables(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, chunk_ord long, source string, content string")
    return spark.createDataFrame(QUESTIONS, "question_id long, question string"), chunks, spark.createDataFrame(PAGES, "page_id long, url string, html string"), chunks.select("source").distinct()


def test_research(spark):
    done = research(*tables(spark))
    state = {r.question_id: r for r in done.summary.collect()}
    assert sorted(state) == [1, 2, 4, 5]
    assert state[2].route == "none" and state[2].fused == 0 and state[4].route == "web" and state[4].vector == 0 and state[4].web > 0
    assert len(state[5].sub_queries) == 2 and not state[1].correction_attempted or state[1].confidence < 0.6
    reports = {r.question_id: r for r in done.reports.collect()}
    assert "dams.md" in reports[1].report and reports[2].report == "Answered without sources.\n"
    ranks = done.fused.groupBy("question_id").agg(F.max("fused_rank").alias("m"), F.count_distinct("fused_rank").alias("n")).collect()
    assert all(r.m == r.n for r in ranks)


def test_many_sub_queries_keep_apart(spark):
    """Nine parts of one question, beside the next question: none is dropped, and none gets another's hits."""
    _, chunks, pages, manifest = tables(spark)
    many = "; ".join(f"owls {i}" for i in range(9))
    done = research(spark.createDataFrame([(1, many), (2, "ferns in the shade")], "question_id long, question string"), chunks, pages, manifest)
    assert {r.question_id: len(r.sub_queries) for r in done.summary.collect()} == {1: 9, 2: 1}
    found = {(r.question_id, r.sub_query, r.source_id) for r in done.hits.where("path = 'bm25'").collect()}
    assert {f for f in found if f[0] == 1} == {(1, f"owls {i}", "owls.md") for i in range(9)}
    assert (2, "ferns in the shade", "ferns.md") in found
    done.release()


def test_providers_with_fallback_and_cache(spark):
    questions, chunks, pages, manifest = tables(spark)
    questions = questions.where("question_id IN (1, 5)")

    def broken(rows):
        raise RuntimeError("no model")

    log = spark.createDataFrame([], "key string, value string, written_at double, seq long, ttl int")
    web = lambda rows: ["web" if "owls" in q else "vector" for q, _ in rows]
    made = Providers(router=(broken, web), decomposer=(lambda rows: [[q, "bees"] for (q,) in rows],), grader=(lambda rows: [{"relevant": True, "score": 0.9} for _ in rows],), synthesizer=(broken, lambda rows: [f"said of {len(p)}" for (p,) in rows]), log=log, now=100.0)
    done = research(questions, chunks, pages, manifest, providers=made)
    rows = {r.question_id: r for r in done.summary.join(done.reports.select("question_id", "answer"), "question_id").collect()}
    assert {k: (r.route, len(r.sub_queries), r.confidence) for k, r in rows.items()} == {1: ("vector", 2, 0.9), 5: ("web", 2, 0.9)}
    assert all(r.answer.startswith("said of ") for r in rows.values())
    writes = done.writes[0].unionByName(done.writes[1]).collect()
    assert len(writes) == 4 and {r.ttl for r in writes} == {300, 1800}
    done.release()


def test_steps_go_through_the_cache(spark):
    """What is in the cache isn't asked for; after its time it is; a key is asked for once; failures aren't written."""
    log = spark.createDataFrame([("k1", "kept", 100.0, 1, 50), ("k2", "gone", 0.0, 2, 50)], "key string, value string, written_at double, seq long, ttl int")
    df = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k2"), (4, "k3")], "id long, q string")
    fails = lambda rows: [None if q == "k3" else f"new {q} {len(rows)}" for (q,) in rows]
    out, (writes,) = _through(df.coalesce(1), F.col("q"), "said", ["q"], [fails], Providers(log=log, now=120.0), 50)
    assert {r.id: (r.said or "")[:6] for r in out.collect()} == {1: "kept", 2: "new k2", 3: "new k2", 4: ""}
    assert [(r.key, r.ttl) for r in writes.collect()] == [("k2", 50)]


def test_all_providers_fail(spark):
    questions, chunks, pages, manifest = tables(spark)

    def broken(rows):
        raise RuntimeError("no model")

    late = research(questions.where("question_id = 1"), chunks, pages, manifest, providers=Providers(router=(broken,), decomposer=(broken,), synthesizer=(broken,)))
    row = late.reports.join(late.summary.select("question_id", "route", "sub_queries"), "question_id").first()
    assert row.route == "both" and len(row.sub_queries) == 1 and "[1]" in row.answer
    late.release()


def test_prompts_leave_braces_alone(spark):
    row = spark.range(1).select(decisions.rendered("{a}-{b}-{c}", a=F.lit("{b}"), b=F.lit(None).cast("string")).alias("p")).first()
    assert row.p == "{b}--{c}"


def test_evaluation_and_its_sink(spark, tmp_path):
    _, chunks, pages, manifest = tables(spark)
    lines = [{"question": "When was the tall dam built?", "ground_truth": "1931", "reference_contexts": [CHUNKS[0][3]], "expected_route": "both", "expected_sources": ["dams.md"]}, {"question": "   ", "ground_truth": "", "reference_contexts": [], "expected_route": "none", "expected_sources": []}, {"question": "Do bees dance?", "ground_truth": "yes", "reference_contexts": ["zzz", CHUNKS[3][3]], "expected_route": "web", "expected_sources": ["bees.md"]}, {"question": "not asked", "ground_truth": "", "reference_contexts": [], "expected_route": "", "expected_sources": []}]
    (tmp_path / "golden.jsonl").write_text("\n".join(map(json.dumps, lines)))
    done = evaluate.run_eval(golden_questions(spark, f"{tmp_path}/golden.jsonl"), lambda questions: research(questions, chunks, pages, manifest))
    done.write(f"{tmp_path}/out")
    rows = {r.question_id: r for r in spark.read.json(f"{tmp_path}/out/results").collect()}
    assert sorted(rows) == [0, 1, 2]
    assert rows[0].source_overlap and rows[0].context_recall == 1.0 and rows[2].context_recall == 0.5 and not rows[1].route_match and rows[1].actual_sources == []
    means = spark.read.json(f"{tmp_path}/out/metrics").first()
    assert means.context_recall == 0.75 and abs(means.source_overlap - 2 / 3) < 1e-9


def test_events(spark):
    said = list(events(*tables(spark), deadline=1e9))
    assert said[-1].kind == "done" and said[-1].result.reports.count() == 4
    assert [e.node for e in said[:3]] == ["route_query", "decompose_query", "retrieve_vector"] and all(e.latency_ms > 0 for e in said[:-1])
    assert list(events(*tables(spark), deadline=0))[-1].message == "deadline passed"
    questions, chunks, pages, manifest = tables(spark)
    assert list(events(questions, chunks.drop("content"), pages, manifest))[-1].kind == "error"


def test_through_cache(spark):
    log = spark.createDataFrame([("k1", "old", 0.0, 1, 10), ("k1", "new", 5.0, 2, 10), ("k2", "gone", 0.0, 3, 10)], "key string, value string, written_at double, seq long, ttl int")
    requests = spark.createDataFrame([("k1",), ("k2",), ("k2",), ("k3",)], "key string")
    answers, writes = tasks.through_cache(requests, log, lambda missing: missing.where("key <> 'k3'").withColumn("value", F.upper("key")), 12.0, 10)
    assert sorted(map(tuple, answers.collect()), key=str) == [("k1", "new"), ("k2", "K2"), ("k2", "K2"), ("k3", None)]
    assert [(r.key, r.value, r.written_at, r.ttl) for r in writes.collect()] == [("k2", "K2", 12.0, 10)]
