"""Joins against brute force: near duplicates, templates, revisits."""

import itertools
import random
import re
import time

import numpy as np
import regex
from pyspark.sql import functions as F

from quern.llm import jaccard_groups, template_leaks, warc_revisits
from quern.llm.common import CLEANUP, written


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()
    label = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def corpus(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.randint(3, 70))] for _ in range(12)]
    texts = []
    for _ in range(n):
        base = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
            base[rng.randrange(len(base))] = word()
        if rng.random() < 0.3:
            base = passage + base
        texts.append(rng.choice((" ", "\n", "\t ")).join(w.upper() if rng.random() < 0.05 else w for w in base))
    return [*enumerate(texts), (n, ""), (n + 1, None), (n + 2, "aa"), (n + 3, "AA"), (n + 4, "éa b c d e")]


def test_components(spark, monkeypatch):
    for seed, long in ((1, 32), (2, 3)):
        monkeypatch.setattr(jaccard_groups, "LONG_LIST", long)
        rows = corpus(seed)
        out = jaccard_groups.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(rows)


def test_last_round_alone(spark, monkeypatch):
    """With no leader rounds, all links are found by the last; lists meet in parts, and all shingles count as frequent."""
    monkeypatch.setattr(jaccard_groups, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(jaccard_groups, "BLOCK", 3)
    monkeypatch.setattr(jaccard_groups, "HOT_LEVEL", -1)
    monkeypatch.setattr(jaccard_groups, "HOT_ABOVE", -300)
    monkeypatch.setattr(jaccard_groups, "LONG_LIST", 4)
    rows = corpus(3)
    out = jaccard_groups.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(rows)


def test_links_inside_a_group(spark, monkeypatch):
    """Texts of one size and one prefix, whose prefix no other group lists, are still compared; the order of shingles may be any."""
    monkeypatch.setattr(jaccard_groups, "frequency_levels", lambda docs: np.zeros(1 << jaccard_groups.SKETCH_BITS, np.uint8))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for words in (6, 8, 10, 11, 14, 20, 30, 44, 45, 60, 100, 204, 300):
        for _ in range(3):
            base = [word() for _ in range(words - 1)]
            texts += [" ".join([*base, word()]) for _ in range(2)]
    rows = [*enumerate(texts)]
    wanted = brute_components(rows)
    for rounds, long in ((2, 32), (0, 1)):
        monkeypatch.setattr(jaccard_groups, "LEADER_ROUNDS", rounds)
        monkeypatch.setattr(jaccard_groups, "LONG_LIST", long)
        out = jaccard_groups.digest(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == wanted


def test_templates(spark):
    item = "Tom has 12 red apples and gives 5 of them to Anna before the long train leaves Berlin at 9 km per hour."
    rng = random.Random(5)
    noise = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(n))
    docs = {
        1: f"{noise(30)} {item} {noise(20)}",
        2: f"{noise(9)}. " + item.replace("12", "31").replace("Anna", "Maria").replace("Berlin", "London").replace("9 km", "7 miles"),
        3: item.replace("the long train leaves", "a plane departs"),
        4: item.replace(" ", "\n"),
        5: noise(400),
        6: "Tom has 12 red apples",
        7: item.upper(),
        8: noise(200) + " " + item + " " + item,
    }
    twice = "Anna pays 7 dollars for 7 small pears and Anna then walks home along the river with all of the pears."
    docs[9] = twice.replace("7", "8").replace("Anna then", "Anna then")
    docs[10] = twice.replace("for 7", "for 9")
    docs[11] = item.replace("12", "5").replace("9 km", "5 km")
    docs[12] = item.replace("Tom", "Maria")
    found = {(r.doc_id, r.item_id): r.changed for r in template_leaks.leaks(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")).collect()}
    # 10 and 11 fill equal slots with different values, and different slots with equal ones.
    assert {k for k in found if k[0] != 3} == {(1, 1), (2, 1), (4, 1), (7, 1), (8, 1), (9, 2), (12, 1)}
    assert found[2, 1] and found[9, 2] and found[12, 1] and not found[1, 1] and not found[7, 1] and not found[8, 1]


def brute_leaks(docs, items):
    """The definition, place by place, over single texts; the patterns of placeholders are the module's."""
    t = template_leaks
    marks = regex.compile(t.MARKS)

    def words(text):
        numbered = regex.sub(t.AFTER_NUMBER, rf"{t.NUMBER}\g<1>{t.UNIT}", regex.sub(t.NUMBERS, t.NUMBER, text))
        return [regex.findall(r"[^\x20\x09-\x0D]+", x.lower()) for x in (marks.sub("", text), regex.sub(t.NAMES, t.NAME, marks.sub("", numbered)))]

    def windows(own, tmpl, size):
        out = []
        for i in range(len(own) - size + 1):
            literal = sum(not w.startswith("0") for w in tmpl[i : i + size])
            out.append({("own", *own[i : i + size])} | ({("template", *tmpl[i : i + size])} if 4 <= literal < size else set()))
        return out

    found = {}
    for item_id, item in items.items():
        own, tmpl = words(item)
        size, total = min(8, len(own)), len(own) - min(8, len(own)) + 1
        if len(own) < 5:
            continue
        mine, enough = windows(own, tmpl, size), min(6, -(-total // 2))
        for doc_id, text in docs.items():
            theirs_own, theirs_tmpl = words(text)
            theirs = windows(theirs_own, theirs_tmpl, size)
            for offset in range(-len(mine), len(theirs)):
                hits = [k for k in range(len(mine)) if 0 <= k + offset < len(theirs) and mine[k] & theirs[k + offset]]
                runs = [[k for _, k in g] for _, g in itertools.groupby(enumerate(hits), lambda x: x[1] - x[0])]
                for run in (r for r in runs if len(r) >= enough):
                    at = range(run[0], run[-1] + size)
                    slots = {(tmpl[k], own[k], theirs_own[k + offset]) for k in at if regex.match(r"0num|0name|0unit", tmpl[k]) and tmpl[k] == theirs_tmpl[k + offset]}
                    if len(slots) == len({x[:2] for x in slots}) == len({x[::2] for x in slots}):
                        changed = any(v != w for _, v, w in slots)
                        n, c = found.get((doc_id, item_id), (0, True))
                        found[doc_id, item_id] = (max(n, len(run)), c and changed)
    return found


def test_leaks_against_brute_force(spark):
    rng = random.Random(21)
    plain, names, numbers, units = "so the old river runs past many low hills until it meets cold seas".split(), ["Tom", "Anna", "Berlin", "Maria", "Rome"], ["3", "12", "7.5", "40"], ["km", "kg", "hours"]
    word = lambda: rng.choice(plain) if rng.random() < 0.75 else rng.choice(names) if rng.random() < 0.6 else f"{rng.choice(numbers)} {rng.choice(units)}"
    items = {i: " ".join(word() for _ in range(rng.choice((3, 5, 7, 9, 14, 25)))) + "." for i in range(14)}
    docs = {}
    for i in range(90):
        item = rng.choice(items)
        for a in (names, numbers, units):
            if rng.random() < 0.5:
                # Sometimes one value for two, or two for one.
                to = dict(zip(a, rng.sample(a, len(a)), strict=True)) if rng.random() < 0.6 else {x: rng.choice(a) for x in a}
                item = " ".join(to.get(w.rstrip("."), w) for w in item.split())
        parts = item.split()
        if rng.random() < 0.3:
            parts[rng.randrange(len(parts))] = rng.choice((word(), "Zed", "99"))
        text = " ".join([*(word() for _ in range(rng.randrange(12))), *parts, *(word() for _ in range(rng.randrange(12)))])
        docs[i] = rng.choice((text, text, text.upper(), text.lower(), text.replace(" ", "\n")))
    out = template_leaks.leaks(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string"))
    wanted = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): (r.n_windows, r.changed) for r in out.collect()} == wanted
    assert {c for _, c in wanted.values()} == {True, False} and len(wanted) > 20


def test_template_keeps_words_beside_words(spark):
    df = spark.createDataFrame([("Then Bob paid $3.50, or 12-15 km (about 7 mi), to Ann-Marie at 9:30; it's 5kg.",)], "text string")
    row = template_leaks._templated(df.withColumn("k", F.lit(1)), "k").first()
    assert len(row.own) == len(row.words)
    assert row.words[:5] == ["0name", "0name", "paid", "0num", "or"]


def test_canonical_urls(spark):
    wanted = {
        "HTTP://www.Example.com:80/a/./b/../c/?b=%7e1&utm_source=x&a=%2f#f": "example.com/a/c?a=%2F&b=~1",
        "https://example.com/%61%2fb%C3%a9%zz%": "example.com/a%2Fb%C3%A9%zz%",
        "http://example.com/../..": "example.com",
        "http://example.com/a/..b/.c": "example.com/a/..b/.c",
        "": "",
    }
    rows = spark.createDataFrame([(u,) for u in wanted], "url string").select("url", warc_revisits.canonical_url(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in rows} == wanted


def test_revisits_of_a_hot_page(spark, monkeypatch):
    """One URL with most records, most of them at one time or close to it; one record lies far off."""
    monkeypatch.setattr(warc_revisits, "LEAST_SLICES", 5)
    rng = random.Random(8)
    schema = "record_id long, url string, at long, kind string, headers map<string,string>, digest string"
    rows = [(i, "http://h.com/x" if rng.random() < 0.9 else "http://o.com", 10**15 if i == 7 else 500 if rng.random() < 0.5 else rng.randrange(1000), rng.choice(("response", "revisit", "revisit")), {}, "d") for i in range(3_000)]
    out = {r.record_id: r.resolved_id for r in warc_revisits.resolved(spark.createDataFrame(rows, schema)).collect()}
    best, wanted = {}, {}
    for i, url, at, kind, _, _ in sorted(rows, key=lambda r: (r[2], r[3] == "revisit", r[0])):
        if kind == "response":
            best[url] = i
        else:
            wanted[i] = best.get(url)
    assert out == wanted


def test_revisits(spark):
    rng = random.Random(7)
    schema = "record_id long, url string, at long, kind string, headers map<string,string>, digest string"
    variants = ("http://Example.com/a", "https://www.example.com/a/", "http://example.com:80/a?utm_source=x#top", "http://example.com/b?y=1&x=2", "http://example.com/b?x=2&y=1", "", None)
    rows = []
    for i in range(400):
        kind = rng.choice(("response", "revisit"))
        headers = {"etag": rng.choice("AB"), "content-length": str(i), "cache-control": f"max-age={i}"} if rng.random() < 0.9 else None
        rows.append((i, rng.choice(variants), rng.randrange(150) if rng.random() < 0.98 else None, kind, headers, rng.choice(("d1", None)) if kind == "revisit" else "d1"))
    out = {r.record_id: r for r in warc_revisits.resolved(spark.createDataFrame(rows, schema)).collect()}
    canonical = dict(zip(variants, ("example.com/a",) * 3 + ("example.com/b?x=2&y=1",) * 2 + ("", None), strict=True))
    assert len(out) == sum(r[3] == "revisit" for r in rows)
    for i, url, at, kind, headers, digest in rows:
        if kind != "revisit":
            continue
        key = canonical[url]
        before = [r for r in rows if r[3] == "response" and key and at is not None and r[2] is not None and canonical[r[1]] == key and r[2] <= at]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        said = [] if best is None else [(best[5], digest), ((best[4] or {}).get("etag"), (headers or {}).get("etag"))]
        known = [(a, b) for a, b in said if a is not None and b is not None]
        status = "missing" if best is None else "resolved" if known and all(a == b for a, b in known) else "mismatch"
        assert (out[i].canonical_url, out[i].resolved_id, out[i].status) == (key, best[0] if best else None, status)
        if status == "resolved":
            assert out[i].headers == (best[4] or {}) | {k: v for k, v in (headers or {}).items() if k != "content-length"}
    empty = spark.createDataFrame([], schema)
    assert warc_revisits.resolved(empty).count() == 0
    pages = spark.createDataFrame([(1, None, None, 5), (2, "http://a.com", "x", 5), (2, "http://a.com", "x", 5)], "page_id long, url string, html string, status int")
    assert warc_revisits.digest(pages).count() == 3 and warc_revisits.digest(pages.limit(0)).count() == 0


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        found.add(files.next().getName())
    return {f for f in found if f.startswith("shuffle_")}


def test_written_tables_leave_no_shuffles(spark):
    """A shuffle goes with the query that wrote a table, so that a job's shuffles don't add up on disk; the session's setting stays."""
    before = shuffle_files(spark)
    counts = written(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    deadline = time.time() + 20
    while shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(CLEANUP) == "false" and counts.count() == 7


def test_a_group_is_told_by_its_number(spark):
    """Listings carry a group's number alone: sets of n and n + 1 with one prefix are two groups."""
    one = np.arange(1, 21, dtype=np.uint64)
    rows = [(1, 20, 0, 0, bytearray(one.tobytes())), (2, 21, 0, 0, bytearray(np.append(one, np.uint64(99)).tobytes())), (3, 20, 0, 0, bytearray(one.tobytes()))]
    sets = spark.createDataFrame(rows, "doc_id long, n long, set_a long, set_b long, shingles binary")
    cut = {r.doc_id: r for r in jaccard_groups.prefixes(sets, np.zeros(1 << jaccard_groups.SKETCH_BITS, np.uint8)).collect()}
    assert cut[1].prefix == cut[2].prefix and cut[1].group != cut[2].group and cut[1].group == cut[3].group
