"""Operators on single texts against brute force, the tokenizers library and held-out labels."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe, feistel_shards, personal_data, secret_ledger, subword_classifier, weak_quality

tokenizers = pytest.importorskip("tokenizers")

PIECES = ["a", "@", ".", "1", "25", "255", "4", "..", " ", "-", "+", "(", ")", "é", "b.c", "@x.y", "1234 5678 9012 3452", "4111111111111111", "9", "0", "\n", "tel ", "(523) 555-1055", " [at] ", "::1"]


def brute_base(text):
    found = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            if k == 0 or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 16 <= len(digits) <= 19 and doubled % 10 == 0) or (k == 3 and 8 <= len(digits) <= 15):
                found.append((k, m.start(), m.end()))
    return found


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_base_spans(text):
    assert personal_data.base_spans(text) == brute_base(text)
    base = {(a, b) for _, a, b in personal_data.base_spans(text)}
    loose = personal_data.loose_spans(text, personal_data.base_spans(text))
    taken = sorted([*((a, b) for _, a, b in loose)])
    assert all(x[1] <= y[0] for x, y in zip(taken, taken[1:]))  # noqa: B905
    assert not any(a < d and c < b for a, b in taken for c, d in base)


def test_long_runs_are_linear():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "@a" * 100_000, "a@" * 100_000):
        personal_data.candidates(text)


def test_redaction_and_model(spark):
    texts = ["write to ann@mail.example.com or +1 (523) 555-1055", "card 4111 1111 1111 1111", "order 9111 1111 1111 1112 is late", "ip 10.0.0.1, not 10.0.0.256", None, "nothing here", "mail: bob [at] mail.example [dot] com"] * 5
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    out = personal_data.without_personal_data(docs).orderBy("doc_id").collect()
    assert out[0].text == "write to <EMAIL> or <PHONE>" and out[0].n_chars == len(out[0].text)
    assert out[1].text == "card <CARD>" and out[2].text == "order 9111 1111 1111 1112 is late" and out[3].text == "ip <IP>, not 10.0.0.256"
    assert out[4].text is None and out[5].text == "nothing here" and out[6].text == "mail: <EMAIL>"


def test_reliable_labelers_are_found():
    patterns = ["20+++" + "+4", "20--0" + "+4", "20+-0" + "+4", "20-+0" + "+4"]
    p = personal_data.posteriors(patterns, np.array([500.0, 500.0, 10.0, 10.0]))
    assert p[0] > 0.95 and p[1] < 0.05


def test_posteriors_against_plain_expectation_maximisation():
    """Candidate by candidate, kind by kind, without counts of patterns."""
    rng = random.Random(17)
    patterns = [f"{rng.choice('0246')}0{rng.choice('+-0')}{rng.choice('+-0')}{rng.choice('+-0')}{rng.choice('+-')}{rng.randint(0, 3)}" for _ in range(600)]
    counted = sorted({p: patterns.count(p) for p in patterns}.items())
    found = dict(zip([p for p, _ in counted], personal_data.posteriors([p for p, _ in counted], np.array([float(n) for _, n in counted])), strict=True))
    for kind in "0246":
        votes = [[{"+": 1, "0": 0, "-": -1}[c] for c in p[1:6]] for p in patterns if p[0] == kind]
        prior, rate = 0.5, [0.8] * 5
        for _ in range(personal_data.ROUNDS):
            odds = [np.log(prior / (1 - prior)) + sum(x * np.log(r / (1 - r)) for x, r in zip(v, rate, strict=True)) for v in votes]
            p = [1 / (1 + np.exp(-o)) for o in odds]
            for j in range(5):
                cast = [(v[j], q) for v, q in zip(votes, p, strict=True) if v[j]]
                rate[j] = min(0.98, max(0.55, (8 + sum(q if x > 0 else 1 - q for x, q in cast)) / (10 + len(cast))))
            prior = min(0.9, max(0.1, (1 + sum(p)) / (2 + len(p))))
        for pattern, q in zip([x for x in patterns if x[0] == kind], p, strict=True):
            assert abs(found[pattern] - q) < 1e-6


def test_further_kinds_are_decided_by_the_spans(spark):
    """Loose candidates of all kinds, planted among texts that look like them: votes, context and check digits tell them apart."""
    rng = random.Random(30)
    word = lambda: rng.choice("and then the some river house green walk open seldom".split())
    filler = lambda n=8: " ".join(word() for _ in range(n))
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))

    def iban(good):
        bare = f"DE00{number(18)}"
        check = 98 - int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97
        return f"DE{(check if good else (check + 3) % 97):02d}{bare[4:]}"

    yes = {"name": lambda: f"contact Mrs. {rng.choice(['Anna', 'Laura', 'Jane'])} {rng.choice(['Weber', 'Miller'])}", "address": lambda: f"address: {number(2)} {rng.choice(['Long', 'Old'])} Street", "id": lambda: f"iban {iban(True)}", "email": lambda: f"mail {word()}{number(2)} [at] {word()} [dot] com", "phone": lambda: f"call (523) 555-{number(4)}"}
    no = {"id": lambda: f"order {iban(False)}", "card": lambda: f"serial {number(15)}0"}
    texts = [(kind, True, f"{filler()} {make()} {filler()}") for kind, make in yes.items() for _ in range(40)] + [(kind, False, f"{filler()} {make()} {filler()}") for kind, make in no.items() for _ in range(40)]
    texts = [x for x in texts if x[1] or not personal_data.base_spans(x[2])]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.spans for r in personal_data.digest(docs).collect()}
    caught = [texts[i][0] in out[i] for i in out if texts[i][1]]
    false = [bool(out[i]) for i in out if not texts[i][1]]
    assert np.mean(caught) > 0.95 and np.mean(false) < 0.05
    # The spans are where the definition's classifier, applied text by text on the driver, says.
    weights = personal_data.fit(docs)
    for i, (_, _, t) in enumerate(texts):
        assert out[i] == ",".join(f"{personal_data.ALL_KINDS[k]}:{a}:{b}" for k, a, b, _ in personal_data.spans(t, weights))


# ---------------------------------------------------------------- tokenizers

TEXTS = st.text(alphabet="aAbBeé'sStT \n\t.,!123½ΣσςİıßẞЖ漢字かな́ệ\x1c\x85　😀<|>", max_size=60)
SPECIAL = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endoftext", "don't I'LL", "a" * 300])


@pytest.fixture(scope="module")
def library():
    return {name: tokenizers.Tokenizer.from_file(bpe.vocabulary_path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@pytest.fixture(scope="module")
def ours():
    return bpe.RoundEncoder(bpe.file_text(bpe.vocabulary_path("word_bpe_49k.json"))), bpe.HeapCounter(bpe.file_text(bpe.vocabulary_path("byte_bpe_50k.json")))


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.lists(TEXTS | SPECIAL, max_size=4).map("".join), max_size=5))
def test_as_the_library(library, ours, texts):
    encoder, counter = ours
    word, byte = library["word_bpe_49k.json"], library["byte_bpe_50k.json"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        wanted = word.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, wanted))
        assert encoder.decode(ids) == word.decode(wanted, skip_special_tokens=False)
        assert counter.count(text) == len(byte.encode(text, add_special_tokens=False).ids)


def test_long_words_as_the_library(library, ours):
    """Words without a break, of random letters, of one letter and of Han characters: as the library, and in a few seconds."""
    rng = random.Random(12)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 100_000), ("aab", 30_000), ("x", 50_001), ("漢字日本語中文", 30_000), ("etaoin", 501), ("etaoin", 2_001))]
    began = time.monotonic()
    found = [*ours[0].encode(texts)]
    assert time.monotonic() - began < 60
    for text, ids in zip(texts, found, strict=True):
        assert ids == " ".join(map(str, library["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids))


def test_whole_documents(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    word, byte = library["word_bpe_49k.json"], library["byte_bpe_50k.json"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.op7_digest(docs).collect():
        ids = word.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))
    for r in bpe.op8_digest(docs).collect():
        n = len(byte.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "ROUND_BYTES", 8)
    encoder = bpe.RoundEncoder(bpe.file_text(bpe.vocabulary_path("word_bpe_49k.json")))
    texts = ["hello brave new world", "hello again, brave", "w" * 200 + " hello"]
    for _ in range(3):
        assert [*encoder.encode(texts)] == [" ".join(map(str, library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids)) for t in texts]


# ---------------------------------------------------------------- quality


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered, lines, dup = {}, set(), set(), 0
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(i + k for i in places for k in range(8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_measures(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bb", "é", "#", "|>", " ", " ", "\n", "\n\n", "\x0b", "a b a b "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += ["a b c d e f g h " * 3, "x\ny\nx\n\n \nx", "w " * 5000]
    out = weak_quality.measures(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(texts[r.doc_id])


def test_votes_are_weighed(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = weak_quality.digest(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").collect()
    assert not [r for r in rows if r.label == 1 and not r.kept]
    model = weak_quality.fitted([((-1, 0, -1), 50), ((0, 0, 1), 900), ((0, -1, 1), 40), ((-1, 0, 1), 10)], 3)
    assert model.accuracy[0] > model.accuracy[1] and model.accuracy[2] > 0.9


def brute_votes(text):
    """The rules on one text, counted character by character; bounds are those of the rules."""
    n_words, chars, symbols, dup, repeat = brute_measures(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    usual = len(regex.findall(r"(?<!\S)\p{L}[\p{Ll}\p{Lo}\p{M}]*[.,;:?!]?(?!\S)", text))
    counted = {"n_symbols": symbols, "n_words": n_words, "n_marks": sum(c in "!?;:_=+~^@\\/" for c in text), "n_repeat_words": repeat, "n_dup_lines": dup, "n_lines": lines, "n_capitals": sum("A" <= c <= "Z" for c in text), "word_chars": chars, "n_digits": sum("0" <= c <= "9" for c in text), "n_usual": usual}
    out = []
    for r in weak_quality.RULES:
        share = counted[r.part] / counted[r.whole] if counted[r.whole] else None
        if r.good is None:
            out.append(-1 if share is not None and share > r.bad else 0)
        else:
            out.append(0 if share is None else -1 if share < r.bad else 1 if share >= r.good else 0)
    return out, n_words < 20 or 100 * repeat > 30 * n_words


def test_verdicts_against_brute_force(spark, data):
    """Expectation-maximisation document by document, without patterns, and the same documents kept; junk goes."""
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    voted = {i: brute_votes(t) for i, t in texts.items()}
    v = np.array([x[0] for x in voted.values()], float)
    prior, rate = 0.85, np.full(v.shape[1], 0.9)
    for _ in range(40):
        p = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + v @ np.log(rate / (1 - rate)))))
        right = np.where(v > 0, p[:, None], np.where(v < 0, 1 - p[:, None], 0)).sum(0)
        rate = np.clip((9 + right) / (10 + (v != 0).sum(0)), 0.6, 0.98)
        prior = np.clip((0.85 + p.sum()) / (1 + len(v)), 0.5, 0.9)
    p = dict(zip(voted, 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + v @ np.log(rate / (1 - rate))))), strict=True))
    out = weak_quality.digest(docs).collect()
    for r in out:
        assert abs(r.quality - p[r.doc_id]) < 1e-6
        assert r.base_failed == voted[r.doc_id][1] and r.kept == (not r.base_failed and p[r.doc_id] >= 0.5)
    label = {r.doc_id: r.quality for r in labels.collect()}
    junk = [r.kept for r in out if label.get(r.doc_id) == 0]
    good = [r.kept for r in out if label.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(junk) < 0.1 and np.mean(good) > 0.99


def test_scores_are_the_means_of_all_features(spark):
    """Against the model's words: a mean of words, of n-grams and of pairs, each feature looked up by itself."""
    rng = np.random.default_rng(3)
    model = subword_classifier.Model(rng.normal(0, 9, subword_classifier.BUCKETS).astype(np.float32), 0.5)
    draw = random.Random(6)
    texts = ["", " ", "a", "a a", "é😀 b\tc", "x" * 3_000 + " y", *(" ".join(draw.choice(("the", "of", "Straße", "漢字", "###", "q")) for _ in range(draw.randint(0, 40))) for _ in range(60))]
    scorer = subword_classifier.Scorer(model)
    for text, score in zip(texts, scorer.score(texts), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        hashes = [subword_classifier.features([w])[0] for w in words]
        of = lambda buckets: float(np.mean([float(model.weights[int(b)]) for b in buckets])) if len(buckets) else 0.0
        grams = [subword_classifier.features([w])[1] for w in words]
        kinds = [subword_classifier.bucket(np.concatenate(hashes)) if words else [], np.concatenate(grams) if words else [], [subword_classifier.pair_buckets(a, b)[0] for a, b in zip(hashes, hashes[1:])]]  # noqa: B905
        assert abs(score - 1 / (1 + np.exp(-(0.5 + sum(map(of, kinds)) / 3)))) < 1e-6
        ids, shares = subword_classifier.bag(text)
        assert abs(score - 1 / (1 + np.exp(-(0.5 + float(model.weights[ids].astype(float) @ shares))))) < 1e-4


def test_training_is_plain_descent(monkeypatch):
    """Against a slow forward and backward pass over single features."""
    monkeypatch.setattr(subword_classifier, "RATE", 0.5)
    docs = [(np.array([1, 5], np.int32), np.array([0.75, 0.25], np.float32)), (np.array([2, 5], np.int32), np.array([0.5, 0.5], np.float32))] * 3
    labels = np.array([1, 0] * 3)
    model = subword_classifier.trained(docs, labels)
    rng = np.random.default_rng(subword_classifier.SEED)
    dim, rate, epochs = subword_classifier.DIMENSIONS, subword_classifier.RATE, subword_classifier.EPOCHS
    vectors = rng.uniform(-1 / dim, 1 / dim, (subword_classifier.BUCKETS, dim)).astype(np.float32).astype(float)
    out, bias, step = np.zeros((dim, 2)), np.log([0.5, 0.5]), 0
    for _ in range(epochs):
        for i in rng.permutation(range(6)):
            now = rate * (1 - step / (6 * epochs))
            step += 1
            mean = sum(s * vectors[k] for k, s in zip(*docs[i], strict=True))
            likely = np.exp(mean @ out + bias)
            error = np.eye(2)[labels[i]] - likely / likely.sum()
            for k, s in zip(*docs[i], strict=True):
                vectors[k] = vectors[k] + now * s * (out @ error)
            out, bias = out + now * np.outer(mean, error), bias + now * error
    assert np.allclose(model.weights[[1, 2, 5]], (vectors @ (out[:, 1] - out[:, 0]))[[1, 2, 5]], rtol=1e-3, atol=1e-3)


def test_training_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(subword_classifier, "trained", lambda docs, labels: seen.append(len(docs)))
    docs = spark.createDataFrame([(i, "w" * (10 if i else 70_000)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    usable = docs.where("doc_id > 0 AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0").count()
    for rows, size in ((1_000, 1_000_000), (7, 1_000_000), (1_000, 55)):
        subword_classifier.fit(docs, labels, rows, size)
    assert seen == [usable, 7, 5]


def test_classifier_on_held_out_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    out = subword_classifier.digest(docs, labels).join(labels, "doc_id").collect()
    good = [r.score for r in out if r.quality == 1]
    assert np.mean([r.predicted for r in out if r.quality == 1]) > 0.97
    assert np.mean([s > r.score for r in out if r.quality == 0 for s in good]) > 0.8
    again = subword_classifier.digest(docs.repartition(7), labels).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in subword_classifier.digest(docs, labels).collect()}


def test_classifier_on_more_held_out_labels(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    out = subword_classifier.digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in out if r.quality == 1]
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    assert np.mean([s > r.score for r in out if r.quality == 0 for s in good]) > 0.95


# ---------------------------------------------------------------- shards, secrets


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 13, 14, 97])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    steps = feistel_shards.walk_length(spark, n)
    rows = spark.range(n).select("id", feistel_shards.shuffled(F.col("id"), n, steps).alias("p")).select("id", "p", feistel_shards.unshuffled(F.col("p"), n, steps).alias("back")).collect()
    assert sorted(r.p for r in rows) == [*range(n)] and all(r.id == r.back for r in rows)


def test_shards(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 30"))
    out = feistel_shards.digest(docs.repartition(3)).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(out) == docs.count() and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    assert sorted(map(str, out)) == sorted(map(str, feistel_shards.digest(docs).collect()))


def test_shards_of_rows_that_are_alike(spark, monkeypatch):
    """Most rows are one row, without id and text, made again a few at a time: all numbers are there once."""
    docs = spark.createDataFrame([(None, None)] * 300 + [(i, "x") for i in range(50)] + [(1, "x")] * 40, "doc_id long, text string")
    wanted = sorted(map(str, feistel_shards.digest(docs).collect()))
    monkeypatch.setattr(feistel_shards, "COPIES", 7)
    out = feistel_shards.digest(docs).collect()
    assert sorted(map(str, out)) == wanted and sorted(r.row_number for r in out) == [*range(390)]
    assert sum(r.doc_id is None and r["size"] == 16 for r in out) == 300


def brute_secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secrets(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["password", "Token", "api_key", '"', "'", " ", ":", "=", "abc", "12345678", "AKIA", "ABCDEFGH", "0123456789abcdef" * 2, "é", "😀", "\n", "secret"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    out = secret_ledger.digest(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    for r in out:
        wanted = brute_secrets(texts[r.doc_id])
        assert (r.base_sha256, r.spans) == (hashlib.sha256(wanted.encode()).hexdigest(), wanted)


def test_ledger_scans_what_is_new(spark, tmp_path, monkeypatch):
    ledger, seen = secret_ledger.Ledger(spark, f"file://{tmp_path}/ledger"), []
    inner = secret_ledger.scan
    monkeypatch.setattr(secret_ledger, "scan", lambda blobs, rules=secret_ledger.RULES: seen.append(sorted((r.text, len(r.pending)) for r in blobs.collect())) or inner(blobs, rules))
    first = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "0" * 32)], "path string, text string")
    ledger.add(first)
    ledger.add(first.union(spark.createDataFrame([("d", "new")], "path string, text string")))
    newer = (*secret_ledger.RULES[:2], secret_ledger.Rule("hex", 2, "[0-9a-f]{40,}"))
    ledger.add(first, newer)
    every = len(secret_ledger.RULES)
    assert seen == [[("0" * 32, every), ("x", every)], [("new", every)], [("0" * 32, 1), ("x", 1)]]
    paths = secret_ledger.addressed(first, ["path"])
    out = {r.path: [f.kind for f in r.findings] for r in secret_ledger.joined_back(paths, ledger.findings()).collect()}
    assert out == {"a": [], "b": [], "c": ["hex"]}


def test_ledger_follows_rule_versions(spark, tmp_path):
    """More matches, fewer and none under later versions; repeated runs; several versions of one path."""
    ledger = secret_ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    long, short = "ab" * 32, "cd" * 18
    versions = spark.createDataFrame([("a", 1, long), ("a", 2, short), ("a", 3, "nothing"), ("b", 1, long), ("c", 1, None), ("d", 1, f"{short} token={short}")], "path string, at int, text string")

    def found(rules):
        ledger.add(versions, rules)
        paths = secret_ledger.addressed(versions, ["path", "at"])
        return {(r.path, r.at): [(f.kind, f.start, f.end) for f in r.findings] for r in secret_ledger.joined_back(paths, ledger.findings(rules), rules).collect()}

    hex_ = lambda version, pattern: (secret_ledger.RULES[0], secret_ledger.Rule("hex", version, pattern))
    one, two, three, four = hex_(1, "[0-9a-f]{40,}"), hex_(2, "[0-9a-f]{32,}"), hex_(3, "[0-9a-f]{60,}"), hex_(4, "[0-9a-f]{100,}")
    nothing = {("a", 3): [], ("c", 1): []}
    token = [("assign", 37, 79)]
    every = nothing | {("a", 1): [("hex", 0, 64)], ("a", 2): [("hex", 0, 36)], ("b", 1): [("hex", 0, 64)], ("d", 1): [("hex", 0, 36), *token, ("hex", 43, 79)]}
    longest = nothing | {("a", 1): [("hex", 0, 64)], ("a", 2): [], ("b", 1): [("hex", 0, 64)], ("d", 1): token}
    none = nothing | {("a", 1): [], ("a", 2): [], ("b", 1): [], ("d", 1): token}
    assert [found(r) for r in (one, two, three, four)] == [longest, every, longest, none]
    # All versions at once are as the newest; a repeated scan, and one of two runs at a time, change nothing.
    assert found((*one, *two[1:])) == every
    ledger.read().write.mode("append").parquet(f"file://{tmp_path}/twice")
    ledger.read().write.mode("append").parquet(f"file://{tmp_path}/twice")
    again = secret_ledger.Ledger(spark, f"file://{tmp_path}/twice")
    said = lambda x: sorted((r.blob, [tuple(f) for f in sorted(r.findings)]) for r in x.findings(two).collect())
    assert said(again) == said(ledger)
