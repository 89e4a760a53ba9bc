"""Secret scan over an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger, a table, holds one row per blob and
scan: the rule versions that were applied, and the findings of each. A run scans only pairs of blob
and rule version that the ledger lacks, adds them, and joins findings back to every path. Two paths
with the same text cost one scan; a new rule version rescans blobs for that rule alone, and what
older versions of the rule have found is no longer reported, though it stays in the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import broadcast_if, shared_dir, table


@dataclass(frozen=True)
class Rule:
    """pattern is searched leftmost and without overlap; a match counts if group has least characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Runs of one class are as long as they can be, so that the least length may stand in the pattern of
# access and hex: a run that is too short holds no other match. That doesn't hold for assign.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("json_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
FINDING = "array<struct<rule:string,start:bigint,end:bigint>>"
#: Findings are broadcast to the paths up to so many spans and blobs, and joined by a shuffle beyond that.
BROADCAST_SPANS = 200_000


def addressed(versions: DataFrame, paths: list[str]) -> DataFrame:
    """paths, blob (SHA-256 of the text; null: empty) and text of every version."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return versions.select(*paths, F.sha2(text, 256).alias("blob"), text.alias("text"))


def _matches(rule: Rule, pending: Column) -> Column:
    """The matches of a rule in `text`, with the number of characters before each since the last.

    Between two matches lies one piece of the split text, so lengths give all places without a scan
    in another language.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least) if rule.group else F.transform(found, lambda x: F.length(x) >= rule.least)
    gaps, lengths = F.transform(F.split(text, rule.pattern), F.length), F.transform(found, F.length)
    both = F.transform(lengths, lambda n, i: F.struct(F.lit(rule.key).alias("rule"), i.alias("no"), F.get(gaps, i).alias("gap"), n.alias("n"), F.get(kept, i).alias("kept")))
    return F.when(F.array_contains(pending, rule.key) & text.rlike(rule.pattern), both).otherwise(F.array().cast("array<struct<rule:string,no:int,gap:int,n:int,kept:boolean>>"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rules, findings of every blob (blob, text, pending) under its pending rules; some have no findings.

    start and end count code points. Matches become rows only for their running sum of lengths, so
    a text with very many of them costs time in proportion.
    """
    every = F.concat(*[_matches(r, F.col("pending")) for r in rules])
    rows = blobs.select("blob", F.col("pending").alias("rules"), F.explode_outer(every).alias("m"))
    before = Window.partitionBy("blob", "m.rule").orderBy("m.no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("m.gap") + F.col("m.n")).cast("long")).over(before))
    one = F.when(F.col("m.kept"), F.struct(F.col("m.rule").alias("rule"), (F.col("end") - F.col("m.n")).alias("start"), F.col("end").alias("end")))
    return rows.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(one).alias("findings"))


class Ledger:
    """The table of scans in one folder. Rows are only ever added.

    A run that dies adds nothing, as its files count only once they are all there. Two runs at the same time, or a run
    that is repeated, may add the same scan twice; what is read is the same, as findings are pooled by blob and rule version.
    """

    SCHEMA = f"blob string, rules array<string>, findings {FINDING}"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if self.exists() else self.spark.createDataFrame([], self.SCHEMA)

    def add(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what versions (text) has and the ledger hasn't: pairs of blob and rule version."""
        wanted = F.array(*[F.lit(r.key) for r in rules])
        blobs = addressed(versions, []).groupBy("blob").agg(F.first("text").alias("text"))
        if self.exists():
            seen = self.read().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            blobs = blobs.join(seen, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("pending") > 0).drop("seen")
        else:
            blobs = blobs.withColumn("pending", wanted)
        # One row per blob comes back: the text is read once, and what was found rides along.
        found = scan(blobs, rules)
        found.write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, findings (kind, start, end) under the newest of the given versions of each kind, for blobs that have some."""
        wanted = [r.key for r in newest(rules)]
        found = F.filter("findings", lambda x: x["rule"].isin(wanted))
        rows = self.read().select("blob", found.alias("findings")).where(F.size("findings") > 0)
        pooled = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
        return pooled.select("blob", F.transform("findings", lambda x: F.struct(F.substring_index(x["rule"], "@", 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))


def newest(rules: tuple[Rule, ...]) -> list[Rule]:
    """The rules without those of which there is a later version."""
    last = {r.kind: max(x.version for x in rules if x.kind == r.kind) for r in rules}
    return [r for r in dict.fromkeys(rules) if r.version == last[r.kind]]


def joined_back(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path (rows with `blob`) with its findings in order of start, then kind as listed; none: empty.

    Blobs without findings, such as that of empty texts, meet nothing; those with some are broadcast if they are few.
    """
    order = F.create_map(*[x for i, r in enumerate(newest(rules)) for x in (F.lit(r.kind), F.lit(i))])
    ranked = F.transform("findings", lambda x: F.struct(x["start"].alias("start"), F.element_at(order, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    found = broadcast_if(findings.select("blob", F.sort_array(ranked).alias("findings")), BROADCAST_SPANS, F.size("findings"))
    out = paths.join(found, "blob", "left")
    return out.withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")))


def digest(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """The op10 contract. A null id is an id like any other; equal texts share one scan; texts may be empty or null (no findings).

    Rows that come twice come back twice; an empty table gives an empty one; further columns play no part.
    """
    ledger = ledger or Ledger(docs.sparkSession, shared_dir(docs.sparkSession, "op10-ledger"))
    ledger.add(docs.select("text"))
    paths = addressed(docs.select("doc_id", "text"), ["doc_id"]).drop("text")
    out = joined_back(paths, ledger.findings())
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("findings", lambda x: x["rank"] < len(BASE_RULES))
    count = lambda r: F.size(F.filter("findings", lambda x: x["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}")
    return out.select("doc_id", *[count(r) for r in BASE_RULES], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("findings")).alias("spans"), "blob")


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, through a ledger that begins empty."""
    return digest(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    ctes, kinds = [], []
    for i, r in enumerate(RULES):
        pattern, kept = r.pattern.replace("'", "''"), f"len(g[i]) >= {r.least}"
        ctes.append(f"m{i} AS (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g FROM d)")
        kinds.append(f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{i}) WHERE {kept}")
    spans = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(ctes)},
f AS ({' UNION ALL '.join(kinds)}),
a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, {spans} FILTER (WHERE k < {len(BASE_RULES)}) AS base, {spans} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN a USING (doc_id)"""


ORACLE_SQL = _oracle()
