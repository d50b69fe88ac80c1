"""Mixing sources to target weights by Pareto order sampling.

Within a source a document is expected in the mix as often as its importance says: by default in proportion to the binary
digits of its size, so that longer documents are likelier, but never more than `most_copies` times. The common
factor fills the source's target exactly (what the most copies cut off goes to the others). The whole part of
a document's expected copies is certain; the rest is its inclusion probability in a draw without
replacement: documents are ranked by random odds divided by inclusion odds and taken in that order
until the words reach what is left of the target, so a sample has a fixed size in words, to half a document.
The cut is found from a histogram of ranks per source, and only the cut's own bin is
sorted, so that no task sorts a source.

Defined results: null texts have no words; sources are ordered by code point, null
last; a source without words has the target 0; repeated rows are documents of their
own (equal ranks are taken in the order of id and size, and of rows equal in those as many
as fit, by a hash of the other columns); reruns agree because the random odds come from a
hash of the id. Extra columns are kept, those named like a
result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisfield.llm.common import checkpoint

#: Bins of the rank histogram of a source.
BINS = 1 << 11


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    words = F.size(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""), "[\\x20\\x09-\\x0D]+"))
    return F.when(F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]"), words).otherwise(0).cast("long")


def targets(sizes: DataFrame, source: str, weights: Sequence[float], share: float, most_copies: float) -> DataFrame:
    """(source, source_size, target): weights repeat over the ordered sources, targets stop at `most_copies`
    of a source and the excess is reshared by weight. One row a source; the windows are over sources alone."""
    order = Window.orderBy(F.col(source).asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most_copies)))
    # sources reach their caps in the order of cap / weight; the level is what a unit of weight gets once those before are full
    by_cap, everything = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last()), Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", left / open_weight)
    # it rises as long as the next source is full below it and falls after that
    level = F.max("level").over(everything)
    return w.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select(source, "source_size", "target")


def uniform(key: Column) -> Column:
    """A number of (0, 1) from the key's MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**12))


#: Sources (by levels of importance) up to which their targets are broadcast; beyond, they are joined by shuffles.
BROADCAST_SOURCES = 50_000


def _joined(rows: DataFrame, sources: DataFrame, few: bool, key: str, on: str = "__source") -> DataFrame:
    side = F.broadcast(sources) if few else sources
    return rows.join(side, F.col(on).eqNullSafe(F.col(key)), "left").drop(key)


def expected_copies(strata: DataFrame, most_copies: float) -> DataFrame:
    """Adds __whole, __odds and __draw to (__source, __level, __words, target): what each level of importance of a source gets.

    Copies are least(most, factor * level). Levels from the top are full up to some level; the factor that fills the target is the
    greatest of those that each choice of full levels would give, as the filled words grow ever slower with it.
    """
    of = Window.partitionBy("__source").orderBy(F.col("__level").desc())
    above = F.coalesce(F.sum("__words").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("__level") * F.col("__words")).over(of.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    factor = F.when(rest > 0, (F.col("target") - F.lit(float(most_copies)) * above) / rest)
    source = Window.partitionBy("__source")
    copies = F.coalesce(F.least(F.lit(float(most_copies)), F.max("__factor").over(source) * F.col("__level")), F.lit(0.0))
    out = strata.withColumn("__factor", factor).withColumn("__copies", copies).withColumn("__whole", F.floor(F.col("__copies") + F.lit(1e-12)).cast("long"))
    p = F.col("__copies") - F.col("__whole")
    out = out.withColumn("__odds", F.when(p > 1e-12, p / (F.lit(1.0) - p)))
    drawn = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("__whole") * F.col("__words")).over(source))
    return out.withColumn("__draw", drawn).drop("__factor", "__copies")


def _dealt(ties: DataFrame, columns: Sequence[str], few: bool) -> DataFrame:
    """Sets __drawn for exactly __need of each source's equal rows: those of least hash of their columns, rows alike in
    all columns by their place. Each step counts one key a source and keeps the key's cut open for the next, so
    that no task sorts a group."""
    content = F.xxhash64(*(F.col(f"`{c}`").cast("string") if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in ties.dtypes if c in columns))
    rows = checkpoint(ties.withColumn("__hash", content).withColumn("__place", F.monotonically_increasing_id()))
    rows = rows.withColumn("__drawn", F.lit(False)).withColumn("__open", F.lit(True))
    for key in (F.pmod("__hash", F.lit(BINS)), F.col("__hash"), F.pmod(F.xxhash64("__place"), F.lit(BINS)), F.col("__place")):
        rows = rows.withColumn("__key", key)
        counts = rows.where("__open").groupBy("__source", "__key", "__need").agg(F.count(F.lit(1)).alias("__c"))
        before = F.coalesce(F.sum("__c").over(Window.partitionBy("__source").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = counts.withColumn("__before", before).where("__before < __need and __before + __c >= __need")
        at = checkpoint(at.select(F.col("__source").alias("__s"), F.col("__key").alias("__at"), (F.col("__need") - F.col("__before")).alias("__left")))
        rows = _joined(rows, at, few, "__s").withColumn("__drawn", F.col("__drawn") | (F.col("__open") & (F.col("__key") < F.col("__at"))))
        rows = rows.withColumn("__open", F.col("__open") & (F.col("__key") == F.col("__at"))).withColumn("__need", F.col("__left")).drop("__at", "__left", "__key")
    # places are unique: the row still open is the last that is needed
    return rows.withColumn("__drawn", F.col("__drawn") | F.col("__open"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_copies: int = 2, id_col: str = "doc_id", source: str = "source", text: str = "text", importance: Column | None = None) -> DataFrame:
    """Adds size, source_size, target and taken (words the mix takes, repeats counted).

    `importance`: a positive whole number per document, over the columns and `size`, with few values (they are counted per source).
    """
    made = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in made]
    name = lambda c: F.col(f"`{c}`")
    order_id = F.coalesce(name(id_col).cast("long"), F.lit(2**63 - 1))
    sized = docs.select(*map(name, kept), n_words(name(text)).alias("size"), name(source).alias("__source"), uniform(name(id_col)).alias("__u"), order_id.alias("__id"))
    level = F.length(F.bin("size")) if importance is None else importance
    sized = sized.withColumn("__level", level.cast("long")).withColumn("__key", F.struct("__source", "__level"))
    strata = checkpoint(sized.groupBy("__source", "__level").agg(F.sum("size").alias("__words")))
    goal = targets(strata.groupBy("__source").agg(F.sum("__words").alias("source_size")), "__source", weights, share, most_copies)
    goal = strata.join(goal.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    goal = checkpoint(expected_copies(goal, most_copies).select(F.struct("__source", "__level").alias("__s"), "source_size", "target", "__whole", "__odds", "__draw"))
    few = goal.count() <= BROADCAST_SOURCES
    # Pareto ranks (u / (1 - u)) / odds, binned by rank / (1 + rank)
    rank = F.col("__u") / (F.lit(1.0) - F.col("__u")) / F.col("__odds")
    ranked = _joined(sized, goal, few, "__s", "__key").drop("__key", "__level").withColumn("__rank", rank)
    ranked = ranked.withColumn("__bin", F.floor(F.col("__rank") / (F.lit(1.0) + F.col("__rank")) * F.lit(BINS)))
    bins = ranked.where("__rank is not null").groupBy("__source", "__bin", "__draw").agg(F.sum("size").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = bins.withColumn("__ahead", ahead).where("__ahead < __draw and __ahead + __n >= __draw")
    cut = checkpoint(cut.select(F.col("__source").alias("__s"), F.col("__bin").alias("__cut"), "__ahead"))
    # in the cut's bin, documents are taken as long as their middle lies ahead of the target; equal ones are counted together
    inside = _joined(ranked.select("__source", "__rank", "__id", "size", "__bin", "__draw"), cut, few, "__s").where("__bin = __cut")
    inside = inside.groupBy("__source", "__rank", "__id", "size", "__draw", "__ahead").agg(F.count(F.lit(1)).alias("__n"))
    here = Window.partitionBy("__source").orderBy("__rank", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__ahead") + F.coalesce(F.sum(F.col("size") * F.col("__n")).over(here), F.lit(0)) + F.col("size") / F.lit(2.0)
    inside = inside.withColumn("__start", start).where("__start <= __draw")
    fit = F.floor((F.col("__draw") - F.col("__start")) / F.greatest(F.col("size"), F.lit(1)))
    # the quotient may be rounded over a whole number: the comparison itself decides
    fit = F.when(F.col("__start") + fit * F.col("size") > F.col("__draw"), fit).when(F.col("__start") + (fit + 1) * F.col("size") <= F.col("__draw"), fit + 2).otherwise(fit + 1)
    fit = F.when(F.col("size") > 0, F.least(F.col("__n"), fit)).otherwise(F.col("__n"))
    last = inside.groupBy("__source").agg(F.max(F.struct("__rank", "__id", "size", fit.alias("__fit"), "__n")).alias("__last"))
    equal = F.struct(*(F.col(f"__last.{c}").alias(c) for c in ("__rank", "__id", "size")))
    cut = cut.join(last, F.col("__s").eqNullSafe(F.col("__source")), "left").select("__s", "__cut", equal.alias("__equal"), F.col("__last.__fit").alias("__fit"), F.col("__last.__n").alias("__n"), F.col("__last").isNotNull().alias("__some"))
    cut = checkpoint(cut)
    here = F.struct("__rank", "__id", "size")
    drawn = (F.col("__bin") < F.col("__cut")) | ((F.col("__bin") == F.col("__cut")) & F.col("__some") & (here <= F.col("__equal")))
    out = _joined(ranked, cut, few, "__s").withColumn("__drawn", F.coalesce(drawn, F.lit(False)))
    if cut.where("__fit < __n").head(1):
        tied = F.coalesce(F.col("__some") & (F.col("__fit") < F.col("__n")) & (here == F.col("__equal")), F.lit(False))
        shape = [*kept, "size", "source_size", "target", "__whole", "__drawn"]
        ties = out.where(tied).select(*map(name, shape), "__source", F.col("__fit").alias("__need"))
        out = out.where(~tied).select(*map(name, shape)).unionByName(_dealt(ties, kept, few).select(*map(name, shape)))
    out = out.withColumn("taken", F.col("size") * (F.col("__whole") + F.col("__drawn").cast("long")))
    return out.select(*map(name, kept), "size", "source_size", "target", "taken")
