"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier decides.

Regular expressions, gazetteers and context words vote on every candidate or abstain. Patterns of
votes are counted over all documents; expectation-maximisation estimates each labeler's reliability
from the counts, and gives each pattern a posterior. A logistic classifier of the spans themselves (their shape, check
digits, neighbouring words and place, but no votes) is trained on the posteriors of a bounded sample of candidates.
Strict matches (the base) are always spans; the classifier decides on loose ones, some of further kinds.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import lean_batches, returning, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
#: All kinds, those without a base after the others.
ALL_KINDS = (*KINDS, "name", "address", "id")
LEAST, ROUNDS, CONTEXT = 0.9, 30, 40
#: The classifier learns from at most so many candidates, those of the lowest hash; votes are counted over all.
TRAINING_SPANS = 20_000
FEATURES, EPOCHS, RATE = 1 << 12, 20, 2.0

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Possessive, and only from the start of a run of digits: what fails there fails further on too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# What the loose candidates look like.
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,4}")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9-])")
NAME = re.compile(r"[A-Z][a-zß-öø-ÿ]{1,20}(?:\.? [A-Z][a-zß-öø-ÿ]{1,20}(?:-[A-Z][a-zß-öø-ÿ]{1,20})?){1,2}")
ADDRESS = re.compile(r"(?<![0-9])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Court|Ct|Way)(?![A-Za-z])|[A-ZÄÖÜ][a-zäöüß]{1,20}(?:straße|strasse|platz|allee|weg) [0-9]{1,4}(?![0-9])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
DIGIT = re.compile("[0-9]")

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov int info biz io co eu uk us de fr es it nl be at ch pt pl se no dk fi ie cz ru ua cn jp kr in br mx ar ca au nz za".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CARD_STARTS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Sir Herr Frau Madame Mme Monsieur Sr Sra Don Doña".split())
FIRST_NAMES = frozenset("Anna Maria Peter Paul John James Mary Robert Linda Michael David Thomas Sarah Laura Julia Emma Lucas Felix Hans Karl Klaus Ursula Sabine Jean Pierre Marie Claire Louis Carlos José Juan Carmen Lucía Ana Pedro Pablo Elena Sofia Alice Bob Tom Jane Kate George Henry Susan Karen Daniel Martin Stefan Monika".split())
CONTEXT_WORDS = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|courriel|correo|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|ipv4|ipv6|host|server|addr|address|adresse)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b"),
    "name": re.compile(r"(?i)\b(?:name|named|dear|sincerely|contact|author|nombre|nom|herr|frau|mrs?|dr)\b"),
    "address": re.compile(r"(?i)\b(?:address|adresse|lives?|street|ship|deliver|dirección|wohnt)\b"),
    "id": re.compile(r"(?i)\b(?:ssn|social|security|iban|account|konto|passport|cuenta|compte)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono)\b"),
}
OTHER_NUMBERS = re.compile(r"(?i)\b(?:isbn|issn|doi|order|version|ver|serial|sku|model|page|vol|id|ref)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the base pattern, found from each @ outwards: in linear time on any text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            end = found.end()
        else:
            # What stands between is no start either: it reaches the same @.
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end of the strict matches, by kind as listed, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if len(m[0]) >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, none of which touches a strict match or another candidate."""
    found = []
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        found += [(0, m.start(), m.end()) for m in SPELLED.finditer(text)]
    if " at " in text and " dot " in text:
        found += [(0, m.start(), m.end()) for m in SPOKEN.finditer(text)]
    found += [(4, m.start(), m.end()) for m in NAME.finditer(text) if (first := re.split(r"\.? ", m[0], maxsplit=1)[0]) in TITLES or first in FIRST_NAMES]
    if DIGIT.search(text):
        found += [(5, m.start(), m.end()) for m in ADDRESS.finditer(text)]
        found += [(6, m.start(), m.end()) for m in ACCOUNT.finditer(text)]
        if ":" in text:
            found += [(1, m.start(), m.end()) for m in IPV6.finditer(text)]
        found += [(2, m.start(), m.end()) for m in CARD.finditer(text) if len(m[0]) >= 15 and 15 <= len(digits_of(m[0])) <= 19]
        found += [(3, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    out, taken = [], sorted((a, b) for _, a, b in base)
    at, end = 0, -1
    for kind, a, b in sorted(found, key=lambda x: (x[1], x[0])):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= end and (at == len(taken) or taken[at][0] >= b):
            out.append((kind, a, b))
            end = b
    return sorted(out)


def checks(span: str, kind: int, strict: bool) -> bool | None:
    """Whether the span is sound by itself: check digits, ranges, number of parts; none where there is nothing to check."""
    name, digits = ALL_KINDS[kind], digits_of(span)
    if name == "email":
        return None
    if name == "ip":
        return strict or ":" in span
    if name == "card":
        return luhn(digits)
    if name == "phone":
        return 8 <= len(digits) <= 15
    if name == "name":
        return True if span.count(" ") > 1 else None
    if name == "address":
        return not span.startswith("0")
    if "-" in span:
        return span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00"
    bare = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def votes(text: str, kind: int, a: int, b: int, strict: bool) -> str:
    """The labelers' votes on a span, one of - 0 + each: form, check digits, gazetteer, context, edges; and its size."""
    span, before = text[a:b], text[max(0, a - CONTEXT) : a]
    digits, name, check = digits_of(span), ALL_KINDS[kind], checks(span, kind, strict)
    if name == "email":
        listed = "+" if re.split(r"[.\]) ]+", span)[-1].lower() in TOP_DOMAINS else "-"
    elif name == "ip":
        listed = "-" if span.startswith(("0.", "255.")) else "0"
    elif name == "card":
        listed = "+" if digits.startswith(CARD_STARTS) else "-"
    elif name == "phone":
        listed = "+" if span[0] == "+" and any(digits.startswith(c) for c in CALLING_CODES) else "0" if span[0] == "+" else "-"
    elif name == "name":
        listed = "+" if any(w in FIRST_NAMES for w in re.split(r"\.? |-", span)) else "0"
    else:
        listed = "0"
    context = "+" if CONTEXT_WORDS[name].search(before) else "-" if OTHER_NUMBERS.search(before) else "0"
    edge = "-" if (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()) else "+"
    return f"{kind}{'+' if strict else '0'}{'0' if check is None else '+' if check else '-'}{listed}{context}{edge}{min(9, (b - a) // 4)}"


def features(text: str, kind: int, a: int, b: int, strict: bool) -> list[int]:
    """Hashed features of a span and of what is beside it; the votes, and whether it is strict, are none of them."""
    span = text[a:b]
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", re.sub("[A-Z]", "A", span))))[:24]
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    left, right = before.lower().split(), after.lower().split()
    place = 0 if a == 0 else 1 if b == len(text) else 2 + 4 * a // len(text)
    said = (
        "", f"shape {shape}", f"check {checks(span, kind, strict)}", f"size {min(15, (b - a) // 2)}", f"digits {min(24, len(digits_of(span)))}", f"start {span[:2]}", f"end {span[-3:].lower()}",
        f"before {before[-1:]!r}", f"after {after[:1]!r}", f"left {left[-1].strip('.,:;') if left else ''}", f"left2 {left[-2].strip('.,:;') if len(left) > 1 else ''}", f"right {right[0].strip('.,:;') if right else ''}", f"place {place}",
    )
    return [zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % FEATURES for x in said]


def candidates(text: str) -> list[tuple[int, int, int, bool, str]]:
    """kind, start, end, whether strict, and pattern of every candidate in a text."""
    base = base_spans(text)
    return [(*x, True, votes(text, *x, True)) for x in base] + [(*x, False, votes(text, *x, False)) for x in loose_spans(text, base)]


# ---------------------------------------------------------------- the model


def _votes_of(patterns: list[str]) -> np.ndarray:
    value = {"+": 1.0, "0": 0.0, "-": -1.0}
    return np.array([[value[c] for c in p[1:6]] for p in patterns]).reshape(len(patterns), 5)


def posteriors(patterns: list[str], counts: np.ndarray) -> np.ndarray:
    """Probability that a span of each pattern is personal data, by expectation-maximisation per kind.

    A labeler that votes is right at a rate between 0.55 and 0.98, whatever the truth.
    """
    v, out = _votes_of(patterns), np.zeros(len(patterns))
    kinds = np.array([p[0] for p in patterns])
    for kind in sorted(set(kinds)):
        rows = kinds == kind
        mine, n = v[rows], counts[rows]
        prior, rate = 0.5, np.full(mine.shape[1], 0.8)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + mine @ np.log(rate / (1 - rate)))))
            right = (n[:, None] * np.where(mine > 0, p[:, None], 1 - p[:, None]) * (mine != 0)).sum(0)
            rate = np.clip((right + 8) / ((n[:, None] * (mine != 0)).sum(0) + 10), 0.55, 0.98)
            prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 0.1, 0.9))
        out[rows] = p
    return out


def classifier(examples: list[tuple[str, list[int]]], wanted: dict[str, float]) -> np.ndarray:
    """Weights of the features of spans, trained on (pattern, features) towards the patterns' posteriors by gradient descent.

    Alike spans count together, by the logarithm of their number, so that frequent strict ones don't drown the rest.
    """
    alike: dict[tuple, int] = {}
    for pattern, ids in examples:
        alike[pattern, tuple(ids)] = alike.get((pattern, tuple(ids)), 0) + 1
    weights = np.zeros(FEATURES)
    rows = sorted(alike)
    rng = np.random.default_rng(5)
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            pattern, ids = rows[i]
            p = 1 / (1 + np.exp(-np.clip(weights[list(ids)].sum(), -30, 30)))
            step = RATE / (1 + epoch) * min(3.0, np.log1p(alike[rows[i]]) / np.log(2))
            np.add.at(weights, list(ids), step * (wanted[pattern] - p) / len(ids))
    return weights


def score(weights: np.ndarray, ids: list[int]) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[ids].sum(), -30, 30))))


# ---------------------------------------------------------------- over tables


def _text_rows(docs: DataFrame, make: Callable[[list[str]], list[pa.Array]], kept: list[str], names: list[str], fields: str) -> DataFrame:
    """kept, and what make() gives for the texts, null as empty, of 256 rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = make([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *made], names=[*kept, *names])

    lean_batches(docs.sparkSession)
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return docs.select(*kept, F.col("text").alias("__text")).mapInArrow(returning(run), own + fields)


def fit(docs: DataFrame) -> np.ndarray:
    """The classifier's weights; the votes of all documents are counted, and a bounded sample of candidates is learned from.

    Patterns are few (7 kinds, 5 votes of 3 values, 10 sizes), however many documents there are.
    """

    def make(texts: list[str]) -> list[pa.Array]:
        rows = [[{"pattern": c[4], "key": zlib.crc32(t[max(0, c[1] - CONTEXT) : c[2] + CONTEXT].encode("utf-8", "surrogatepass")), "ids": features(t, *c[:4])} for c in candidates(t)] for t in texts]
        return [pa.array(rows, pa.list_(pa.struct([("pattern", pa.string()), ("key", pa.int64()), ("ids", pa.list_(pa.int32()))])))]

    found = _text_rows(docs, make, [], ["found"], "found array<struct<pattern:string,key:bigint,ids:array<int>>>")
    found = written(found.select(F.inline("found")), "op4-candidates")
    counts = sorted((r["pattern"], r["count"]) for r in found.groupBy("pattern").count().collect())
    sample = [(r["pattern"], list(r["ids"])) for r in found.orderBy("key", "pattern", "ids").limit(TRAINING_SPANS).collect()]
    return model(counts, sample)


def model(counts: list[tuple[str, int]], sample: list[tuple[str, list[int]]]) -> np.ndarray:
    likely = posteriors([p for p, _ in counts], np.array([float(n) for _, n in counts])) if counts else np.zeros(0)
    return classifier(sample, dict(zip([p for p, _ in counts], likely.tolist(), strict=True)))


def spans(text: str, weights: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """kind, start, end, whether base, of all spans of a text: the base, and the loose candidates that the classifier accepts."""
    return sorted((k, a, b, base) for k, a, b, base, _ in candidates(text) if base or score(weights, features(text, k, a, b, base)) >= LEAST)


def redacted(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for k, a, b, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{ALL_KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    """The op4 contract. Null texts are empty; ids may be null or repeated; no candidates leave an empty model.

    Rows that come twice come back twice; an empty table gives an empty one; further columns play no part. Spans of
    kinds without a base come after the others.
    """
    good = fit(docs)

    def make(texts: list[str]) -> list[pa.Array]:
        rows = []
        for t in texts:
            found = spans(t, good)
            said = [[f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b, base in found if base or not only] for only in (True, False)]
            n = [sum(k == i and base for k, _, _, base in found) for i in range(4)]
            rows.append((*n, hashlib.sha256(",".join(said[0]).encode()).hexdigest(), ",".join(said[1])))
        return [pa.array(x, pa.int64() if i < 4 else pa.string()) for i, x in enumerate(zip(*rows, strict=True))]

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    return _text_rows(docs, make, ["doc_id"], names, ", ".join(f"{n} {'long' if n[:2] == 'n_' else 'string'}" for n in names))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs, with the same columns, personal data in `text` replaced by its kind; a null text stays null.

    n_chars, where there is one, follows the text.
    """
    good = fit(docs)
    others = [c for c in docs.columns if c != "text"]

    def make(texts: list[str]) -> list[pa.Array]:
        return [pa.array([redacted(t, spans(t, good)) for t in texts], pa.string())]

    marked = docs.select(*others, F.col("text").isNull().alias("__none"), "text")
    out = _text_rows(marked, make, [*others, "__none"], ["text"], "text string")
    out = out.withColumn("text", F.when(~F.col("__none"), F.col("text")))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("__none"), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return digest(table(spark, sf_dir, "documents"))
