"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Law `rows`: the permuted row number p gives shard p mod k and slot p div k, so that counts are at
most one apart and slots have no gaps; both can be computed from the row number alone, and the row
number from both (`unshuffled`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import table

SEED, ROUNDS = 20_261, 6
#: About so many rows are numbered by one task; the number of buckets is held to these bounds.
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 64, 8_192
#: Rows that are alike in all keys are made again from their number, at most so many at a time.
COPIES = 10_000


def halves(n: int) -> tuple[int, int]:
    """a, b: the least near-square rectangle with a * b >= n."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def _number(text: Column) -> Column:
    """The first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _scrambled(value: Column, round_no: Column, seed: int, modulus: int) -> Column:
    """The round function: MD5 of seed, round and value, which any SQL engine has."""
    said = F.concat_ws(":", F.lit(str(seed)), round_no.cast("string"), value.cast("string"))
    return F.pmod(_number(said), F.lit(modulus).cast("long"))


def _step(x: Column, a: int, b: int, seed: int, forward: bool) -> Column:
    """One pass of the network over [0, a * b): left half modulo a, right half modulo b."""
    state = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))

    def one(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        l, r = s["l"], s["r"]
        by_r, by_l = _scrambled(r, i, seed, a), _scrambled(l, i, seed, b)
        sign = 1 if forward else -1
        return F.struct(F.when(even, F.pmod(l + sign * by_r, F.lit(a).cast("long"))).otherwise(l).alias("l"), F.when(even, r).otherwise(F.pmod(r + sign * by_l, F.lit(b).cast("long"))).alias("r"))

    order = range(ROUNDS) if forward else range(ROUNDS - 1, -1, -1)
    return F.aggregate(F.array(*[F.lit(i) for i in order]), state, one, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])


def _walk(x: Column, n: int, steps: int, seed: int, forward: bool) -> Column:
    a, b = halves(n)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), _step(x, a, b, seed, forward), lambda y, _: F.when(y < n, y).otherwise(_step(y, a, b, seed, forward)))


def walk_length(spark: SparkSession, n: int, seed: int = SEED) -> int:
    """Steps after which every walk, forwards or backwards, is back below n.

    A walk leaves [0, n) only over the fewer than sqrt(n) + 1 numbers from n to a * b. Of these, the ones
    that it can enter by, whose predecessor is below n, are tried: the bound is proven, not probable.
    A cycle that lies wholly at n and above is entered by no walk and never tried.
    """
    a, b = halves(n)
    steps = 4
    for forward in (True, False):
        entries = spark.range(n, a * b).where(_step(F.col("id"), a, b, seed, not forward) < n)
        while a * b > n and not entries.where(_walk(F.col("id"), n, steps, seed, forward) >= n).isEmpty():
            steps *= 2
    return steps


def shuffled(row_number: Column, n: int, steps: int, seed: int = SEED) -> Column:
    """The place of a row number (0 to n - 1) in the shuffle; a bijection. steps: walk_length()."""
    return _walk(row_number.cast("long"), n, steps + 1, seed, True)


def unshuffled(place: Column, n: int, steps: int, seed: int = SEED) -> Column:
    """The row number at a place: the inverse of shuffled(). The row in slot s of shard h of k has place s * k + h."""
    return _walk(place.cast("long"), n, steps + 1, seed, False)


def numbered(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The rows' keys with a global row number, `row_number` from 0, that depends on the keys alone.

    Buckets by a hash of the keys are numbered apart and put behind each other. Rows that are alike
    in all keys are counted before anything is numbered, so that they land in no task together.
    """
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // ROWS_PER_BUCKET))
    alike = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"))
    alike = alike.withColumn("__bucket", F.pmod(_number(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])), F.lit(buckets)))
    # At most MOST_BUCKETS rows, whatever the input.
    sums = sorted(tuple(r) for r in alike.groupBy("__bucket").agg(F.sum("__copies").alias("__n"), F.max("__copies").alias("__most")).collect())
    bases = [(b, sum(x[1] for x in sums[:i])) for i, (b, _, _) in enumerate(sums)]
    within = Window.partitionBy("__bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    placed = alike.withColumn("__first", F.sum("__copies").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__copies"))
    placed = placed.join(F.broadcast(df.sparkSession.createDataFrame(bases, "__bucket long, __base long")), "__bucket")
    first = F.col("__base") + F.col("__first")
    if max((most for _, _, most in sums), default=0) <= COPIES:
        return placed.select(*keys, F.explode(F.sequence(first, first + F.col("__copies") - 1)).alias("row_number"))
    # A row that comes very often is dealt out in parts before it is made again, so that no task and no array has them all.
    parts = placed.select(*keys, (first + F.col("__copies")).alias("__stop"), F.explode(F.sequence(first, first + F.col("__copies") - 1, F.lit(COPIES).cast("long"))).alias("__start"))
    parts = parts.repartition(max(2, -(-n // ROWS_PER_BUCKET)))
    return parts.select(*keys, F.explode(F.sequence("__start", F.least(F.col("__start") + COPIES, "__stop") - 1)).alias("row_number"))


def shards(df: DataFrame, keys: list[str], n_shards: int, seed: int = SEED) -> DataFrame:
    """keys, row_number, shard and slot of every row of df.

    Null keys are values like any other; rows that are alike get row numbers next to each other,
    which of them gets which doesn't matter; an empty table gives an empty one. Columns that aren't
    keys play no part.
    """
    df = df.select(*keys)
    n = df.count()
    if n == 0:
        zero = F.lit(0).cast("long")
        return df.limit(0).select(*keys, zero.alias("row_number"), zero.cast("int").alias("shard"), zero.alias("slot"))
    steps = walk_length(df.sparkSession, n, seed)
    out = numbered(df, keys, n).withColumn("__place", shuffled(F.col("row_number"), n, steps, seed))
    return out.select(*keys, "row_number", F.pmod("__place", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("__place") / n_shards).cast("long").alias("slot"))


def digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """The op9 contract. Null texts count as empty, null ids as values; see shards() for repeated rows and empty tables."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shards(rows, ["doc_id", "size", "text_crc32"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`."""
    return digest(table(spark, sf_dir, "documents"))


# Columns of documents, and a CRC-32 by table over the bytes of a text.
ORACLE_SQL = f"""WITH bits AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(k AS BIGINT)) ORDER BY k) AS crc FROM range(256) t(k)),
d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
y AS (SELECT doc_id, strlen(t) + 16 AS size, list_transform(range(strlen(t)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM d),
k AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c // 256, bits.crc[1 + (xor(c, x) % 256)]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM y, bits),
n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a, least({MOST_BUCKETS}, greatest({LEAST_BUCKETS}, count(*) // {ROWS_PER_BUCKET})) AS buckets FROM k),
m AS (SELECT n, a, (n + a - 1) // a AS b, buckets FROM n),
o AS (SELECT k.*, m.*, row_number() OVER (ORDER BY CAST('0x' || substr(md5(doc_id || ':' || size || ':' || text_crc32), 1, 8) AS BIGINT) % buckets, doc_id, size, text_crc32) - 1 AS row_number FROM k, m),
p AS (SELECT *, list_reduce(range(1, 65), lambda x, s: CASE WHEN s > 1 AND x < n THEN x ELSE {{step}} END, row_number) AS place FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % 40 AS INT) AS shard, place // 40 AS slot, CAST(NULL AS INT) AS grown_shard, row_number FROM p"""


def _step_sql() -> str:
    """One pass over x, in SQL: the halves are packed as l * b + r after each round."""
    x = "x"
    for i in range(ROUNDS):
        hashed = lambda v: f"CAST('0x' || substr(md5('{SEED}:{i}:' || ({v})), 1, 8) AS BIGINT)"  # noqa: B023, E731
        left, right = "q // b", "q % b"
        body = f"((({left}) + {hashed(right)} % a) % a) * b + {right}" if i % 2 == 0 else f"({left}) * b + (({right}) + {hashed(left)} % b) % b"
        x = f"list_transform([{x}], lambda q: {body})[1]"
    return x


ORACLE_SQL = ORACLE_SQL.replace("{step}", _step_sql())
