"""Quality rules as a learned decision list, in DataFrame and SQL functions alone.

`with_statistics` computes interpretable statistics of whole texts. `learn` grows rules
by sequential covering: each rule is a conjunction of thresholds that is extended by the
condition with the best FOIL gain for the rejected class, pruned on held-back rows, and
kept if it is precise there; the rows it covers then leave the training set. Counting
candidates is one aggregate a step, and only those counts reach the driver. The list is
emitted as one ordered Spark conditional expression.

Defined results: null and empty texts have no words and fail the base rule; labels
that are null, that differ for one id, or of documents that don't exist, are not learned from; with no usable
labels the list is empty and keeps whatever passes the base rule. Extra columns are kept,
those named like a result are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisfield.llm.common import checkpoint

WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules test: shares of words, characters or lines, each free of a text's length.
FEATURES = ("symbol_share", "upper_share", "bang_share", "dup_line_share", "repeat_share", "same_word_share")


def _without(text: Column, characters: str) -> Column:
    """What is left of a text's characters; one greedy pattern is faster than counting matches."""
    return F.length(F.regexp_replace(text, characters, "")).cast("long")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base statistics and the features."""
    made = {*BASE, *FEATURES, "base_failed"}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = df.select(*kept, t.alias("__t"), F.array_remove(F.split(t, SPACE + "+"), "").alias("__w"), lines.alias("__l"))
    # five-word windows as hashes, with their places in the low bits: sorted, equal windows are neighbours
    one = one.withColumn("__n", F.size("__w")).withColumn("__bits", F.ceil(F.log2(F.col("__n") + F.lit(1.0))).cast("int"))
    grams = F.expr("case when __n < 5 then cast(array() as array<bigint>) else transform(sequence(0, __n - 5), i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2], __w[i + 3], __w[i + 4]), __bits) | cast(i as bigint)) end")
    one = one.withColumn("__g", F.sort_array(grams))
    twice = F.expr("filter(__g, (x, i) -> (i > 0 and shiftrightunsigned(x, __bits) = shiftrightunsigned(__g[i - 1], __bits)) or (i + 1 < size(__g) and shiftrightunsigned(x, __bits) = shiftrightunsigned(__g[i + 1], __bits)))")
    one = one.withColumn("__d", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.expr("shiftleft(1L, __bits) - 1")))))
    covered = F.expr("aggregate(transform(__d, (x, i) -> if(i + 1 < size(__d), least(5L, __d[i + 1] - x), 5L)), 0L, (a, x) -> a + x)")
    stats = one.select(
        *kept, "__t", F.col("__n").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), _without(F.col("__t"), "[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"), F.size("__l").alias("__lines"), F.size(F.array_distinct("__w")).alias("__kinds"),
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return stats.select(
        *kept, *BASE,
        ((F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (_without(F.col("__t"), "\\P{Lu}+") / chars).alias("upper_share"),
        (_without(F.col("__t"), "[^!]+") / chars).alias("bang_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.lit(1.0) - F.col("__kinds") / words).alias("same_word_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


def _all(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _counts(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(rejected, kept) rows that pass each test, by one aggregate."""
    bad, good = F.col("quality") == 0, F.col("quality") == 1
    sums = [F.count_if(t & side).alias(f"c{i}_{k}") for i, t in enumerate(tests) for k, side in enumerate((bad, good))]
    row = rows.agg(*sums).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(tests))]


def _candidates(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """(rejected, kept) rows of every candidate condition, from one histogram of the rows per feature."""
    below = lambda f, ts: F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: t < F.col(f)))
    tall = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), below(f, ts).alias("bin")) for i, (f, ts) in enumerate(thresholds.items()))))
    found = rows.select("quality", tall.alias("x")).groupBy("x.f", "x.bin", "quality").count().collect()
    out = {}
    for i, (f, ts) in enumerate(thresholds.items()):
        bins = [[0, 0] for _ in range(len(ts) + 1)]
        for r in found:
            if r["f"] == i:
                bins[r["bin"]][int(r["quality"])] += r["count"]
        for k, t in enumerate(ts):
            # thresholds 0..k are below a value whose bin is over k
            for above, part in ((True, bins[k + 1 :]), (False, bins[: k + 1])):
                out[Condition(f, above, t)] = (sum(b for b, _ in part), sum(g for _, g in part))
    return out


def _precision(bad: int, good: int) -> float:
    return (bad + 1) / (bad + good + 2)


def learn(labelled: DataFrame, features: tuple[str, ...] = FEATURES, most_rules: int = 8, most_conditions: int = 3, cuts: int = 32, least_precision: float = 0.9, least_rows: int = 5) -> list[tuple[Condition, ...]]:
    """Rules that reject, in order. `labelled` has the features, quality 0 or 1, and `grow` (false: held back for pruning)."""
    points = [i / cuts for i in range(cuts + 1)]
    # cut points among the rows to reject and among those to keep
    quantiles = labelled.where("grow").agg(*(F.percentile_approx(F.when(F.col("quality") == q, F.col(f)), points, 10_000).alias(f"{f}_{q}") for f in features for q in (0, 1))).first()
    thresholds = {}
    for f in features:
        values = sorted({float(v) for q in (0, 1) for v in quantiles[f"{f}_{q}"] or []})
        # and the middles between them, so that a rule need not lie on a class's edge
        if values := sorted({round(v, 6) for v in (*values, *((a + b) / 2 for a, b in pairwise(values)))}):
            thresholds[f] = values
    rules: list[tuple[Condition, ...]] = []
    while thresholds and len(rules) < most_rules:
        left = labelled
        for r in rules:
            left = left.where(~_all(r))
        growing, rule = left.where("grow"), ()
        bad, good = _counts(growing, [F.lit(True)])[0]
        while good and bad and len(rule) < most_conditions:
            counts = _candidates(growing.where(_all(rule)), thresholds)
            gain = {c: b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good))) if b else 0.0 for c, (b, g) in counts.items()}
            top = max(gain.values())
            if top <= 1e-9:
                break
            # of conditions that are as good, the one in the middle of the first such run
            alike = [c for c, x in gain.items() if x >= top - 1e-9]
            alike = [c for c in alike if (c.feature, c.above) == (alike[0].feature, alike[0].above)]
            best = alike[len(alike) // 2]
            rule, (bad, good) = (*rule, best), counts[best]
        if not rule:
            break
        held = left.where("not grow")
        starts = [rule[:k] for k in range(1, len(rule) + 1)]
        kept = _counts(held, [_all(r) for r in starts])
        grown = _counts(growing, [_all(r) for r in starts])
        score = [_precision(*x) for x in kept]
        best = max(range(len(starts)), key=lambda i: (score[i], -i))
        (bad, good), (grown_bad, grown_good) = kept[best], grown[best]
        if bad + grown_bad < least_rows or _precision(bad + grown_bad, good + grown_good) < least_precision:
            break
        rules.append(starts[best])
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The decision list: false where the first rule that holds rejects, else true."""
    out = None
    for r in rules:
        out = F.when(_all(r), F.lit(False)) if out is None else out.when(_all(r), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def version(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, version of the text, statistics) of all documents, written once to the shared folder."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), version(F.col(f"`{text}`")).alias("version"))
    return checkpoint(with_statistics(own).drop("text"))


def learned(stats: DataFrame, labels: DataFrame) -> list[tuple[Condition, ...]]:
    """The decision list from all labelled documents that pass the base rule."""
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    grow = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 0
    labelled = stats.where("not base_failed").join(marks, "doc_id").select(*FEATURES, "quality", grow.alias("grow"))
    return learn(checkpoint(labelled))


def with_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, statistics, base_failed, kept) per document; the list is learned from the labels of these documents."""
    stats = statistics_of(docs, id_col, text)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(learned(stats, labels)))
