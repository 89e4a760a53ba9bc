import json

import pytest

from quern.sources import files, web


def pdf(*pages):
    out = [b"%PDF-1.4\n", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n"]
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    out.append(f"2 0 obj << /Type /Pages /Kids [{kids}] /Count {len(pages)} >> endobj\n".encode())
    for i, text in enumerate(pages):
        shown = f"BT /F1 12 Tf ({text}) Tj ET" if text else ""
        out.append(f"{3 + 2 * i} 0 obj << /Type /Page /Contents {4 + 2 * i} 0 R >> endobj\n{4 + 2 * i} 0 obj << /Length {len(shown)} >> stream\n{shown}\nendstream endobj\n".encode())
    return b"".join(out)


def test_documents(spark, tmp_path):
    (tmp_path / "b.md").write_bytes("# B\r\nLine — two".encode())
    (tmp_path / "a.txt").write_text("A")
    (tmp_path / "notes.json").write_text("{}")
    (tmp_path / "C.MD").write_text("not read")
    (tmp_path / "p.pdf").write_bytes(pdf("First \\(page\\)", "", "Third"))
    (tmp_path / "broken.pdf").write_bytes(b"nothing")
    rows = files.documents(spark, str(tmp_path)).orderBy("source", "doc_ord").collect()
    assert [(r.source, r.page, r.content) for r in rows] == [("a.txt", None, "A"), ("b.md", None, "# B\nLine — two"), ("p.pdf", 1, "First (page)"), ("p.pdf", 3, "Third")]


def test_golden_questions(spark, tmp_path):
    row = {"question": "q", "ground_truth": "g", "reference_contexts": ["c"], "expected_route": "vector", "expected_sources": ["a.md"]}
    path = tmp_path / "g.jsonl"
    path.write_text("\n" + "\n\n".join(json.dumps(row | {"question": f"q{i}"}) for i in range(5)) + "\n")
    assert [r.question for r in files.golden_questions(spark, str(path), 3).collect()] == ["q0", "q1", "q2"]
    path.write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        files.golden_questions(spark, str(path)).collect()


def test_land_file(tmp_path):
    name = files.land_file(tmp_path, "../../etc/pass wd.MD", iter([b"x"]))
    assert name.startswith("pass_wd_") and name.endswith(".md") and (tmp_path / name).read_bytes() == b"x"
    for bad, content, status in (("a.exe", [b"x"], 400), ("a.md", [], 400), ("a.md", [b"x" * 6, b"x" * 6], 413)):
        with pytest.raises(files.UploadError) as e:
            files.land_file(tmp_path, bad, iter(content), most=10)
        assert e.value.status == status
    assert len(list(tmp_path.iterdir())) == 1


def test_web_client(spark):
    def client(query, most):
        if query == "bad":
            raise RuntimeError
        return [{"title": "t", "href": "h", "body": query}, {}]

    queries = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id long, query string")
    rows = web.searched(queries, client).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "t", "h", "good"), (1, 2, "", "", "")]
