"""Exact similarity join on word shingles by a grouped prefix join, and the components of its links.

A document's set are its distinct shingles of five words. With all sets in one global order, rare
shingles first, two sets of similarity t share a shingle within the first n - ceil(t n) + 1 of each.
Documents with equal prefix and size make one group and are listed once under each prefix shingle.
Shingles that one group alone lists make no list, so members of a group also meet in a list of their
own. That list stands for their whole prefix, so no bound on the number of shared lists holds for it.

Pairs of groups come from those lists in rounds. In a round each list offers only its members paired
with one leader; what proves similar is joined into components, and a list whose members are all in
one component is done. The last round offers all pairs that still lie in different components, so that
no link between components is lost, and a group of many near copies costs pairs in proportion to
its size, not to its square. Equal sets are one node throughout.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded, forget, lean_batches, returning, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
#: Similarity as a fraction of 100.
SIMILAR = 75
#: Buckets of the count sketch that orders shingles by frequency; the order may be any, so collisions cost time alone.
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
#: Different sets of one size below this are never similar: n - 1 shared of n + 1 are too few.
LEAST_UNEQUAL = -(-(100 + SIMILAR) // (100 - SIMILAR))
#: Rounds with one leader per list before the last one.
LEADER_ROUNDS = 2
#: Shingles of buckets with more shingles than this, and than 16 times the usual number, go round the search for
#: shingles that one group alone lists: no task sorts all that list them.
HOT_LEVEL, HOT_ABOVE = 8 * 20, 8 * 4
#: A text is worked on in pieces of at most about so many bytes of many documents, or alone.
CHUNK_BYTES = 1 << 18

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The set of every text, as sorted 64-bit hashes; empty for a text without words.

    A word's hash is the sum of its bytes times a random number per place, so it doesn't depend on
    what is beside it; a shingle's adds the words' hashes, each with its own factor.
    """
    coded = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(coded):
        end, size = at + 1, len(coded[at])
        while end < len(coded) and size + len(coded[end]) <= CHUNK_BYTES:
            size += len(coded[end])
            end += 1
        out += _sets(coded[at:end])
        at = end
    return out


def _sets(coded: list[bytes]) -> list[np.ndarray]:
    flat = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    ends = np.cumsum([len(c) + 1 for c in coded])
    inside = ~_SPACES[flat]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(coded)
    length = stops - starts
    chars = flat[inside].astype(np.uint64)
    first = np.cumsum(length) - length
    place = (np.arange(len(chars)) - np.repeat(first, length)).astype(np.uint64)
    factor = _mixed((place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    words = _mixed(np.add.reduceat((chars + np.uint64(1)) * factor, first) + length.astype(np.uint64))
    per = np.diff(np.searchsorted(starts, ends), prepend=0)
    n = len(words)
    sums = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        sums += words[k : n - WORDS + 1 + k] * np.uint64(2 * k + 3 + 0x51ED2700 * (k + 1))
    sums = _mixed(sums + np.uint64(WORDS))
    out, at = [], 0
    for m in per.tolist():
        if m >= WORDS:
            out.append(np.unique(sums[at : at + m - WORDS + 1]))
        elif m:
            few = words[at : at + m] * np.arange(3, 2 * m + 3, 2, dtype=np.uint64)
            out.append(_mixed(few.sum(dtype=np.uint64, keepdims=True) ^ np.uint64(m << 56)))
        else:
            out.append(none)
        at += m
    return out


def _batches(df: DataFrame, of: Callable[[list], list[pa.Array]], keep: list[str], names: list[str], fields: str) -> DataFrame:
    """keep, and what `of` gives for the last column, 256 rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *of(part.column(part.num_columns - 1).to_pylist())], names=[*keep, *names])

    lean_batches(df.sparkSession)
    own = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields[:-1])
    return df.mapInArrow(returning(run), own + fields)


def _signed(xs: list[int]) -> pa.Array:
    return pa.array(np.array(xs, np.uint64).view(np.int64))


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), set_a and set_b (its hash) and shingles (the sorted hashes, eight bytes each) of every document with an id and a word."""

    def of(texts: list[str]) -> list[pa.Array]:
        sets = shingle_sets([t or "" for t in texts])
        hashes = [[int(_mixed(s ^ np.uint64(x)).sum(dtype=np.uint64)) for s in sets] for x in (0x0F0F0F0F, 0x3C3C3C3C)]
        return [pa.array([len(s) for s in sets], pa.int64()), *map(_signed, hashes), pa.array([s.tobytes() for s in sets], pa.binary())]

    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    return _batches(docs, of, ["doc_id"], ["n", "set_a", "set_b", "shingles"], "n long, set_a long, set_b long, shingles binary").where("n > 0")


def _numbers(binary: bytes) -> np.ndarray:
    return np.frombuffer(binary, np.uint64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit hashes, as signed numbers."""
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


def frequency_levels(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of each bucket of the sketch are in all documents, as a level of 0 to 255.

    Each task counts into a fixed number of buckets, so neither what is shuffled per task nor what
    comes back grows with the documents.
    """
    buckets, block = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = map(_numbers, batch.slice(at, 256).column(0).to_pylist())
                total += np.bincount((np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=buckets)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([total[i * block : (i + 1) * block].astype(np.int32).tobytes() for i in range(SKETCH_BLOCKS)], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(c.as_buffer(), np.int32 if len(c.as_buffer()) == 4 * block else np.int64)
                total[b] = total.get(b, 0) + got.astype(np.int64)
        for b, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "counts"])

    lean_batches(sets.sparkSession)
    counts = sets.select("shingles").mapInArrow(returning(count), "block int, counts binary")
    summed = counts.repartition(SKETCH_BLOCKS, "block").mapInArrow(returning(add), "block int, counts binary").collect()
    total = np.zeros(buckets, np.int64)
    for row in summed:
        total[row["block"] * block : (row["block"] + 1) * block] += np.frombuffer(row["counts"], np.int64)
    return np.minimum(255, np.round(8 * np.log2(total + 1.0))).astype(np.uint8)


def prefixes(sets: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, n, set_a, set_b, group (a hash of the prefix and n), prefix, and hot (the part of it in hot buckets) of every set."""
    sent = sets.sparkSession.sparkContext.broadcast(levels)
    hot_from = max(HOT_LEVEL, float(levels.mean()) + HOT_ABOVE)

    def of(shingles: list[bytes]) -> list[pa.Array]:
        level, first, hot, groups = sent.value, [], [], []
        for s in map(_numbers, shingles):
            of_each = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            taken = np.argsort(of_each, kind="stable")[: len(s) + (len(s) * SIMILAR) // -100 + 1]
            is_hot = of_each[taken] >= hot_from
            first.append(s[taken[~is_hot]])
            hot.append(s[taken[is_hot]])
            groups.append(int(_mixed(np.append(s[taken] ^ np.uint64(0xA5A5A5A5), np.uint64(len(s)))).sum(dtype=np.uint64)))
        return [_signed(groups), _lists(first), _lists(hot)]

    return _batches(sets.select("doc_id", "n", "set_a", "set_b", "shingles"), of, ["doc_id", "n", "set_a", "set_b"], ["group", "prefix", "hot"], "group long, prefix array<long>, hot array<long>")


# ---------------------------------------------------------------- components


def components(edges: DataFrame, rows: int) -> DataFrame:
    """node and component (its smallest reachable node) of all nodes in edges (a, b), of which there are `rows` at most.

    Every node takes its neighbours' smallest label, then its label's label, until nothing changes;
    each pass is a table, so lineage and memory stay flat.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "op5-edges", 2 * rows)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "op5-labels", 2 * rows)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("new"))
        far = labels.select(F.col("node").alias("__at"), F.col("component").alias("__to"))
        jumped = hooked.join(far, F.col("new") == F.col("__at")).select("node", F.least("new", "__to").alias("component"), (F.least("new", "__to") != F.col("component")).alias("moved"))
        found = written(jumped, "op5-labels", 2 * rows)
        labels = found.select("node", "component")
        if found.where("moved").isEmpty():
            return labels


# ---------------------------------------------------------------- the join


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a table, whose sets are similar, decided on the whole sets."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (map(_numbers, batch.column(i).to_pylist()) for i in (2, 3))
            found = []
            for s, t in zip(x, y, strict=True):
                shared = len(np.intersect1d(s, t, assume_unique=True))
                found.append(100 * shared >= SIMILAR * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    wanted = bounded(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), 500_000)
    some = sets.select("doc_id", "shingles").join(wanted, "doc_id", "left_semi")
    left = some.select(F.col("doc_id").alias("a"), F.col("shingles").alias("__x"))
    right = some.select(F.col("doc_id").alias("b"), F.col("shingles").alias("__y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "__x", "__y")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(returning(similar), f"a {kind}, b {kind}")


def _alike_in_size(n: str, m: str) -> Column:
    return (100 * F.least(n, m)) >= (SIMILAR * F.greatest(n, m))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document's class (doc_id, n, set_a, set_b, node), and the nodes' components (node, component).

    node is the smallest id with the same set. Documents without words or id aren't among them.
    """
    # The sets are made of the texts once; whatever looks at sets reads this table.
    sets = written(sets_of(docs), "op5-sets")
    cut = written(prefixes(sets, frequency_levels(sets)), "op5-prefixes")
    known = written(cut.drop("prefix", "hot"), "op5-known")
    nodes = written(known.groupBy("n", "set_a", "set_b", "group").agg(F.min("doc_id").alias("node")), "op5-nodes", known.count())
    # One listing per group, whatever the number of its members. The prefixes go before the listings are dealt out.
    groups = written(cut.groupBy("group").agg(F.first(F.struct("prefix", "hot")).alias("listed")).select("group", "listed.prefix", "listed.hot"), "op5-groups")
    forget(cut)
    listed = lambda part: groups.select("group", F.explode(part).alias("shingle"))
    # A shingle that one group alone lists makes no pair; its row goes as soon as its neighbours are seen.
    ordered = listed("prefix").repartition("shingle").sortWithinPartitions("shingle")
    lists = written(_shared(ordered).unionByName(listed("hot")), "op5-lists")
    forget(groups)
    members = nodes.join(nodes.groupBy("n", "group").agg(F.min("node").alias("leader")), ["n", "group"])
    inner = members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))

    # At the level of nodes: lists of prefixes, and a list for each group of more than one.
    entries = lists.join(members.select("n", "group", "node"), "group").select("shingle", "node", "n", F.lit(False).alias("own"))
    crowded = members.where("node != leader").where(F.col("n") >= LEAST_UNEQUAL).select("n", "group").distinct()
    own = members.join(crowded, ["n", "group"], "left_semi").select(F.xxhash64("n", "group", F.lit("group")).alias("shingle"), "node", "n", F.lit(True).alias("own"))
    entries = written(entries.unionByName(own), "op5-entries")

    forget(lists)
    most, n_links = entries.count(), 0
    links = inner.limit(0)
    labels: DataFrame | None = None
    tried: list[DataFrame] = []
    for round_no in range(LEADER_ROUNDS):
        open_ = _open(entries, labels, F.col("node") if round_no == 0 else F.xxhash64("node", F.lit(round_no)))
        lead = open_.where(F.col("component") != F.col("__lead.component")).where(_alike_in_size("n", "__lead.n"))
        offered = lead.select(F.least("node", "__lead.node").alias("a"), F.greatest("node", "__lead.node").alias("b"), F.least("n", "__lead.n").alias("m"), "own")
        # The round may pass over pairs: the last one doesn't. Similar sets share much of their prefixes.
        pairs = offered.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("m").alias("m"), F.max("own").alias("own")).where("own OR 20 * c >= m OR m < 40").select("a", "b")
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = written(pairs, "op5-offered", most)
        if n := pairs.count():
            tried.append(pairs)
            links, n_links = links.unionByName(written(verified(pairs, sets), "op5-links", n)), n_links + n
            # Between the rounds a step along the links will do; components are made when the leaders are through.
            labels = written(_one_step(links), "op5-steps", n_links)
    if n_links:
        labels = components(links, n_links)
    open_ = written(_open(entries, labels, F.col("node")).select("shingle", "node", "n", "own", "component"), "op5-open", most)
    forget(entries)
    every = nodes.select("node").distinct()
    every = every.withColumn("component", F.col("node")) if labels is None else every.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    if still := open_.count():
        pairs = _all_pairs(open_, still, sets)
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = written(pairs, "op5-pairs")
        # What is left joins components: their links are few, whatever the components' sizes.
        ends = verified(pairs, sets)
        for end in ("a", "b") if labels is not None else ():
            of = labels.select(F.col("node").alias("__node"), F.col("component").alias("__of"))
            ends = ends.join(of, F.col(end) == F.col("__node"), "left").withColumn(end, F.coalesce("__of", end)).select("a", "b")
        if n := pairs.count():
            joined = components(ends.where("a <> b").distinct(), n).select(F.col("node").alias("__node"), F.col("component").alias("__to"))
            every = every.join(joined, F.col("component") == F.col("__node"), "left").select("node", F.coalesce("__to", "component").alias("component"))
    every = written(every, "op5-components", known.count())
    forget(sets, open_)
    return known.join(nodes.drop("group"), ["n", "set_a", "set_b"]), every


def _open(entries: DataFrame, labels: DataFrame | None, rank: Column) -> DataFrame:
    """entries with `component` and __lead, the member of least rank, of the lists whose members aren't in one component."""
    now = entries.withColumn("component", F.col("node")) if labels is None else entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sides = now.groupBy("shingle").agg(F.min("component").alias("__low"), F.max("component").alias("__high"), F.min(F.struct(rank.alias("rank"), "node", "n", "component")).alias("__lead"))
    return now.join(sides.where("__low != __high"), "shingle")


def _one_step(links: DataFrame) -> DataFrame:
    """node and component: a smaller node that it is joined with, by one link or two; nodes that have none aren't there."""
    near = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    next_ = near.select(F.col("node").alias("__at"), F.col("component").alias("__to"))
    return near.join(next_, F.col("component") == F.col("__at"), "left").select("node", F.coalesce("__to", "component").alias("component"))


def _shared(ordered: DataFrame) -> DataFrame:
    """Of rows dealt and sorted by shingle, those whose shingle comes more than once."""
    w = Window.partitionBy("shingle").orderBy("shingle")
    around = ordered.withColumn("__before", F.lag("shingle").over(w)).withColumn("__after", F.lead("shingle").over(w))
    return around.where(F.col("__before").isNotNull() | F.col("__after").isNotNull()).drop("__before", "__after")


def _unshared(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and alone: how many of its shingles no other of these nodes has, of those that have some."""
    some = sets.join(bounded(nodes.select(F.col("node").alias("doc_id")), 500_000), "doc_id", "left_semi").select("doc_id", "shingles")
    lists = _batches(some, lambda x: [_lists([*map(_numbers, x)])], ["doc_id"], ["shingles"], "shingles array<long>")
    counts = lists.select("doc_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("__last"))
    return counts.where(F.col("node") == F.col("__last")).groupBy("node").agg(F.count(F.lit(1)).alias("alone"))


def _all_pairs(entries: DataFrame, rows: int, sets: DataFrame) -> DataFrame:
    """All pairs of nodes that share a list, lie in different components and can be similar.

    With c shingles shared within both prefixes, at most c plus what follows one of the prefixes is
    shared at all, so similar sets share several. Nodes of nearly one size share more than 9 n / 140 of
    their lists: it is enough to look for them in the rest of each node's lists, the shortest lists
    first. Others are met in all lists, but by classes of size. In a list no two members of its
    largest component meet; and a node of a long list leaves it if so many of its shingles are its
    own that it is similar to no node of nearly its size there. In a group's own list all members meet
    but those that sets of the same size rule out, whatever other lists they share.
    """
    members = entries.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("__n"))
    sizes = members.groupBy("shingle").agg(F.sum("__n").alias("size"), F.max_by("component", F.struct("__n", "component")).alias("most"))
    by_node = Window.partitionBy("node")
    sized = entries.join(sizes, "shingle").withColumn("long", F.max("size").over(by_node) > LONG_LIST).withColumn("all", F.count(F.lit(1)).over(by_node)).withColumn("rank", F.row_number().over(by_node.orderBy("size", "shingle")))
    sized = written(sized, "op5-sized", rows)
    alone = written(_unshared(sets, sized.where("long").select("node").distinct()), "op5-alone", rows)
    ranked = sized.join(alone, "node", "left").withColumn("most_shared", F.col("n") - F.coalesce("alone", F.lit(0)))
    # Sets of n and 0.9 n or more share 57 n / 70 or more if they are similar.
    hopeless = (F.col("size") > LONG_LIST) & (70 * F.col("most_shared") < 57 * F.col("n"))
    # Similar sets of n both share 6 n / 7 or more.
    apart = (F.col("size") > LONG_LIST) & (7 * F.col("most_shared") < 6 * F.col("n"))
    first = (F.col("rank") < F.col("all") - F.floor(F.col("n") * 9 / 140) + 1) & ~hopeless
    ranked = ranked.withColumn("near", F.when(F.col("own"), ~apart).otherwise(first)).where("near OR NOT own").withColumn("class", F.floor(F.log(F.col("n").cast("double")) / CLASS).cast("int"))
    # Nodes of long lists bring their lists along, so that pairs are judged where they meet.
    brought = entries.groupBy("node").agg(F.collect_list("shingle").alias("lists")).where(F.size("lists") <= MOST_BROUGHT)
    short, long = ranked.where(F.col("size") <= LONG_LIST), ranked.where(F.col("size") > LONG_LIST).join(brought, "node", "left")
    near = _met(short.withColumn("lists", F.lit(None).cast("array<bigint>"))).unionByName(_met(long))
    found = near.groupBy(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).agg(F.min(F.col("x_n") + F.col("y_n")).alias("sum"), F.min(F.greatest("x_n", "y_n")).alias("larger"), F.max("own").alias("own"))
    lists = entries.groupBy("node").agg(F.collect_list("shingle").alias("lists"))
    both = found.join(lists.select(F.col("node").alias("a"), F.col("lists").alias("__x")), "a").join(lists.select(F.col("node").alias("b"), F.col("lists").alias("__y")), "b")
    return both.where(F.col("own") | _can_be_similar(F.size(F.array_intersect("__x", "__y")), F.col("larger"), F.col("sum") - F.col("larger"))).select("a", "b")


def _met(ranked: DataFrame) -> DataFrame:
    """x_node, x_n, y_node, y_n, own (met in their group's own list) of the pairs that meet in some list and pass all bounds; a pair may meet more than once.

    A list of more than BLOCK members is cut into parts, and each pair of parts meets apart, so that no task has a whole long list on both sides.
    """
    columns = ("node", "n", "own", "component", "all", "near", "class", "long", "most_shared", "lists")
    ups = lambda *x: F.array(*map(F.lit, x))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    mine, others = F.pmod(F.xxhash64("node"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
    x = ranked.where(F.col("component") != F.col("most")).select("shingle", *[F.col(c).alias(f"x_{c}") for c in columns], mine.alias("__i"), others.alias("__js"), F.explode(F.when(F.col("own"), ups(0)).when(F.col("near"), ups(*range(-3, 4))).otherwise(ups(-3, -2, -1, 1, 2, 3))).alias("up")).withColumn("class", F.col("x_class") + F.col("up"))
    x = x.withColumn("__j", F.explode("__js")).drop("__js")
    y = ranked.select("shingle", "most", *[F.col(c).alias(f"y_{c}") for c in columns if c != "class"], "class", mine.alias("__j"), F.explode(others).alias("__i"))
    alike = 10 * F.least("x_n", "y_n") >= 9 * F.greatest("x_n", "y_n")
    # A pair of which neither is in the largest component would meet twice.
    met = ((F.col("y_component") == F.col("most")) | (F.col("x_node") < F.col("y_node"))) & (F.col("x_component") != F.col("y_component")) & _alike_in_size("x_n", "y_n")
    own = F.col("x_own") & F.col("y_own")
    met = met & (~alike | (F.col("x_near") & F.col("y_near"))) & (own | _can_be_similar(F.least("x_all", "y_all"), F.col("x_n"), F.col("y_n")))
    met = met & (~(F.col("x_long") & F.col("y_long")) | ((100 + SIMILAR) * F.least("x_most_shared", "y_most_shared") >= SIMILAR * (F.col("x_n") + F.col("y_n"))))
    met = met & F.when(own | F.col("x_lists").isNull() | F.col("y_lists").isNull(), True).otherwise(_can_be_similar(F.size(F.array_intersect("x_lists", "y_lists")), F.col("x_n"), F.col("y_n")))
    return x.join(y, ["shingle", "class", "__i", "__j"]).where(met).select("x_node", "x_n", "y_node", "y_n", own.alias("own"))


#: Sizes of one class differ by a tenth at most.
CLASS = float(np.log(10 / 9))
#: Lists of more members than this are long: pairing them costs more than reading their members again.
LONG_LIST = 32
#: Lists of more members than this meet part by part.
BLOCK = 4_096
#: A node of more lists than this doesn't bring them along; its pairs are judged later.
MOST_BROUGHT = 512


def _can_be_similar(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m that share no more within their prefixes can reach the similarity."""
    after = F.ceil(F.greatest(n, m) * SIMILAR / 100) - 1
    return (100 + SIMILAR) * (shared + after) >= SIMILAR * (n + m)


def digest(docs: DataFrame) -> DataFrame:
    """The op5 contract, and node: the smallest id with the same set.

    Null and wordless texts have no shingles and stand alone. A null id takes no part: its size and
    component are null. Rows that share an id count as one node, with the links of all of them.
    """
    classes, labels = linked(docs)
    found = classes.join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"), "node")
    rest = docs.select("doc_id", "text").where(F.col("doc_id").isNull() | ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    alone = rest.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.lit(0)).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("node"))
    return found.unionByName(alone)


def op5_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of near duplicates they are in."""
    return digest(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM w
), s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM g),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b, n = m AND c = n AS equal FROM p WHERE 100 * c >= 75 * (n + m - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
e AS (SELECT a, min(b) AS twin FROM l WHERE equal GROUP BY a)
SELECT g.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, least(g.doc_id, coalesce(twin, g.doc_id)) AS node FROM g JOIN k ON k.a = g.doc_id LEFT JOIN e ON e.a = g.doc_id"""
