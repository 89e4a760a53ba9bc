"""Quality filter by weak supervision: rules vote or abstain, and their votes are weighed.

Expectation-maximisation estimates how often each rule is right, and a document is kept if its
posterior probability of being good is high enough; no rule alone rejects one.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import WORD_CHARS, table, words_of, written

WINDOW = 8
GOOD, ABSTAIN, BAD = 1, 0, -1


@dataclass(frozen=True)
class VoteRule:
    """Votes bad if part / whole is beyond `bad`, good if it is beyond `good` (where given), else abstains.

    Most rules vote bad or abstain: as most junk is junk in one way, that they don't fire says little.
    """

    name: str
    part: str
    whole: str
    bad: float
    good: float | None = None

    @property
    def vote(self) -> Column:
        share = F.when(F.col(self.whole) > 0, F.col(self.part) / F.col(self.whole))
        if self.good is None:
            return F.when(share > self.bad, BAD).otherwise(ABSTAIN)
        return F.when(share < self.bad, BAD).when(share >= self.good, GOOD).otherwise(ABSTAIN)


RULES = (
    VoteRule("symbols_per_word", "n_symbols", "n_words", 0.4),
    VoteRule("marks_per_word", "n_marks", "n_words", 0.9),
    VoteRule("repeated_words", "n_repeat_words", "n_words", 0.2),
    VoteRule("repeated_lines", "n_dup_lines", "n_lines", 0.2),
    VoteRule("capitals", "n_capitals", "word_chars", 0.4),
    VoteRule("digits", "n_digits", "word_chars", 0.3),
    VoteRule("word_length", "word_chars", "n_words", 20.0),
    VoteRule("usual_words", "n_usual", "n_words", 0.6, 0.85),
)
#: A word of letters, small after the first, with one mark at the end at most.
USUAL = r"(?<!\S)\p{L}[\p{Ll}\p{Lo}\p{M}]*[.,;:?!]?(?!\S)"


def _without(text: Column, pattern: str) -> Column:
    """How many bytes a pattern of ASCII characters covers."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order of place.

    Only a text that has equal hashes pays for the sort. Windows that are repeated cover as many words
    as lie from each start to the next, WINDOW at most.
    """
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda xs: F.sort_array(F.transform(F.filter(F.transform(xs, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(xs, k - 1)["h"] == x["h"]) | (F.get(xs, k + 1)["h"] == x["h"])).alias("t"))), lambda x: F.coalesce(x["t"], F.lit(False))), lambda x: x["i"]))
    covered = lambda starts: F.aggregate(F.transform(starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda n, x: n + x)
    # One-element arrays bind the sorted values to a name, so that nothing is sorted twice.
    bound = F.transform(F.transform(F.array(ranked), twice), covered)
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0).cast("long")).otherwise(F.get(bound, F.lit(0)))


def measures(docs: DataFrame) -> DataFrame:
    """The columns of docs that aren't text, with the measures of the whole text (null: none).

    Windows are told apart by 64-bit hashes of their words.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*others, text.alias("text"), words_of(F.col("text")).alias("__words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHARS)).alias("__lines"))
    windows = F.when(F.size("__words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.size("__words") - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        *others, windows.alias("__windows"), F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"), _without(F.col("text"), "[#*$%&|<>]+").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), F.size("__lines").cast("long").alias("n_lines"),
        _without(F.col("text"), r"[!?;:_=+~^@\\/]+").alias("n_marks"), _without(F.col("text"), "[A-Z]+").alias("n_capitals"), _without(F.col("text"), "[0-9]+").alias("n_digits"), F.regexp_count("text", F.lit(USUAL)).cast("long").alias("n_usual"),
    )
    return step.withColumn("n_repeat_words", _repeated(F.col("__windows"))).drop("__windows")


def votes(rules: tuple[VoteRule, ...] = RULES) -> Column:
    return F.array(*[r.vote for r in rules])


@dataclass(frozen=True)
class Model:
    """prior: share of good documents. accuracy: how often each vote that was cast is right."""

    prior: float
    accuracy: tuple[float, ...]

    @property
    def weights(self) -> list[float]:
        return [log(a / (1 - a)) for a in self.accuracy]

    @property
    def bias(self) -> float:
        return log(self.prior / (1 - self.prior))

    def log_odds(self, votes: Column) -> Column:
        """Of good against bad, for an array of votes."""
        total = F.lit(self.bias)
        for j, w in enumerate(self.weights):
            total = total + F.get(votes, F.lit(j)) * F.lit(w)
        return total


def fitted(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 40) -> Model:
    """Expectation-maximisation over patterns of votes, of which there are 3 ** rules at most.

    Accuracies begin at 0.9, with the weight of ten votes, and stay between 0.6 and 0.98: no rule is
    turned round. The prior stays between 0.5 and 0.9, so that a vote of proven accuracy outweighs it.
    """
    model = Model(0.85, (0.9,) * rules)
    for _ in range(rounds):
        right, cast, good, total = [9.0] * rules, [10.0] * rules, 0.85, 1.0
        for votes, n in patterns:
            odds = model.bias + sum(w * v for w, v in zip(model.weights, votes, strict=True))
            p = 1 / (1 + exp(-odds))
            good, total = good + n * p, total + n
            for j, v in enumerate(votes):
                if v:
                    right[j] += n * (p if v == GOOD else 1 - p)
                    cast[j] += n
        model = Model(min(0.9, max(0.5, good / total)), tuple(min(0.98, max(0.6, r / c)) for r, c in zip(right, cast, strict=True)))
    return model


def fit(voted: DataFrame, rules: tuple[VoteRule, ...] = RULES) -> Model:
    """voted: `votes`, an array per document. All documents are counted; only patterns are gathered."""
    counts = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return fitted(sorted((tuple(r["votes"]), r["n"]) for r in counts), len(rules))


def digest(docs: DataFrame, rules: tuple[VoteRule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """The op6 contract, with the posterior probability of being good.

    A text without words (null, empty, white space) has zeros and fails the base; ids may be null or
    repeated; an empty table gives an empty one.
    """
    measured = measures(docs.select("doc_id", "text"))
    voted = written(measured.withColumn("votes", votes(rules)), "op6-votes")
    odds = fit(voted, rules).log_odds(F.col("votes"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"), "quality")


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, measured, voted on and kept or not."""
    return digest(table(spark, sf_dir, "documents"))
