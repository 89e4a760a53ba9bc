import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators.chunking import chunked, split

PARAGRAPHS = "# Dam\n\n" + "\n\n".join(f"## Part {i}\n\n" + f"The river — part {i} — runs. " * n for i, n in enumerate((9, 3, 14, 1, 6)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t.", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_chunks_hold(text, size, overlap):
    chunks, at = split(text, size, overlap), 0
    for c in chunks:
        assert c.strip() == c and 0 < len(c) <= size
        at = text.find(c, max(0, at - size))
        assert at >= 0
    assert set(re.sub(r"\s", "", text)) == set(re.sub(r"\s", "", "".join(chunks)))


def test_paragraphs_are_packed():
    chunks = split(PARAGRAPHS)
    assert len(chunks) > 1 and all(len(c) <= 800 for c in chunks)
    assert chunks[0].startswith("# Dam")
    assert set(" ".join(chunks).split()) == set(PARAGRAPHS.split())


def test_overlap_carries_whole_pieces():
    assert split("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert split("aa bb cc dd", 6, 0) == ["aa bb", "cc dd"]
    assert split("", 6, 0) == [] and split("   ", 6, 0) == []
    assert split("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]


def test_ids_count_over_pages(spark):
    rows = [("a", 2, 1, "x " * 500), ("a", 1, 0, "y " * 500), ("b", None, 0, ""), ("c", None, 0, None)]
    out = chunked(spark.createDataFrame(rows, "source string, page int, doc_ord long, content string")).orderBy("source", "chunk_ord").collect()
    assert [r.chunk_id for r in out] == ["a::0", "a::1", "a::2", "a::3"]
    assert [r.page for r in out] == [1, 1, 2, 2]
