"""Every operator over awkward rows and over none: one row per row, defined values, no failure."""

import hashlib

import pytest

from quern.llm import bpe, feistel_shards, jaccard_groups, personal_data, secret_ledger, subword_classifier, template_leaks, weak_quality

DIGESTS = {
    "op4": personal_data.digest,
    "op5": jaccard_groups.digest,
    "op6": weak_quality.digest,
    "op7": bpe.op7_digest,
    "op8": bpe.op8_digest,
    "op9": feistel_shards.digest,
    "op10": secret_ledger.digest,
}
NOTHING = hashlib.sha256(b"").hexdigest()


def by_id(df, doc_id):
    return [r for r in df.collect() if r.doc_id == doc_id]


@pytest.mark.parametrize("name", DIGESTS)
def test_awkward_rows(awkward, empty, name):
    out = DIGESTS[name](awkward).cache()
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in awkward.collect())
    nothing = DIGESTS[name](empty)
    assert nothing.count() == 0 and nothing.columns == out.columns
    # The same text has the same values.
    if name != "op9":
        assert len({tuple(r)[1:] for r in out.where("doc_id in (1, 2)").collect()}) == 1


def test_op3(awkward, empty, labels, no_labels):
    out = subword_classifier.digest(awkward, labels)
    assert out.count() == awkward.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.collect())
    assert {r.score for r in subword_classifier.digest(awkward, no_labels).collect()} == {0.5}
    assert subword_classifier.digest(empty, labels).count() == 0
    assert subword_classifier.kept(awkward, labels).columns == awkward.columns


def test_values_of_nothing(awkward):
    for doc_id in (3, 4):
        (row,) = by_id(personal_data.digest(awkward), doc_id)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256, row.spans) == (0, 0, 0, 0, NOTHING, "")
        (row,) = by_id(jaccard_groups.digest(awkward), doc_id)
        assert (row.n_shingles, row.component_id) == (0, doc_id)
        (row,) = by_id(weak_quality.digest(awkward), doc_id)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed, row.kept) == (0, 0, 0, 0, 0, True, False)
        (row,) = by_id(bpe.op7_digest(awkward), doc_id)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (0, NOTHING, NOTHING)
        (row,) = by_id(bpe.op8_digest(awkward), doc_id)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (0, 0, False)
        (row,) = by_id(feistel_shards.digest(awkward), doc_id)
        assert (row["size"], row.text_crc32) == (16, 0)
        (row,) = by_id(secret_ledger.digest(awkward), doc_id)
        assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256, row.spans) == (0, 0, 0, NOTHING, "")


def test_op2(spark, awkward, empty):
    item = "Tom has 12 red apples and gives 5 of them to Anna before the long train leaves Berlin at 9 h."
    benchmark = spark.createDataFrame([(1, item, "z"), (1, item, "z"), (2, None, "z"), (3, "", "z"), (None, "The quick brown fox jumps over the lazy dog near the river bank today.", "z"), (4, "too short", "z")], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id, r.changed) for r in template_leaks.leaks(awkward, benchmark).collect()}
    assert found == {(1, None, False), (2, None, False)}
    assert template_leaks.leaks(empty, benchmark).count() == 0
    nothing = template_leaks.leaks(awkward, benchmark.limit(0))
    assert nothing.count() == 0 and nothing.columns == template_leaks.leaks(awkward, benchmark).columns
    left = template_leaks.without_leaks(awkward, benchmark)
    assert left.columns == awkward.columns and left.count() == awkward.count() - 3
