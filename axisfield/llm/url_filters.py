"""Lists of URL rules: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is a host and the beginning of a path; it fits a URL whose host is the rule's or a subdomain of it and whose path begins so.
A URL's candidates are the ends of its host at dots, each with the beginnings of its path that are as long as some listed path.
The filter has one bit in each of the eight words of a 64-byte block, chosen by the candidate's hash, so a look at it is one hash
lookup by block; only candidates whose eight bits are set meet the rules' own strings, which removes false positives. The
longest rule that fits decides (host and path together; then the longer host; block before allow).

The filter is a table of blocks, made with partial aggregation. It is broadcast up to FILTER_BLOCKS blocks, a bound on its size;
a longer list's blocks are joined by hash. Rules that may be hit (as many as are listed, at most) are broadcast
up to BROADCAST_RULES, counted; beyond, they are repeated under SALTS salts, so that a rule that fits a third of all URLs is split.

Defined results: a null URL, or one without "://", has an empty host and path and no candidates; an empty list
judges nothing; a rule with a null or empty host or a null path is left out; a rule listed with both verdicts blocks;
repeated rows are judged one by one; extra columns are kept, those named like a result are replaced; a URL of any length is judged
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisfield.llm.common import checkpoint

#: Blocks of a filter that may be broadcast (64 bytes each).
FILTER_BLOCKS = 1 << 18
#: Rules that may be broadcast, counted beforehand.
BROADCAST_RULES = 100_000
SALTS = 32
BITS_A_KEY = 12

WORDS = range(8)


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered, and path."""
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substr(known, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(host, upper, upper.lower()), path


def canonical(rules: DataFrame) -> DataFrame:
    """(host, path, verdict), each host and path once."""
    upper = "".join(map(chr, range(65, 91)))
    host = F.translate(F.col("host"), upper, upper.lower())
    named = rules.where((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block")).select(host.alias("host"), "path", "verdict")
    return named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def _bit(h: Column, word: int) -> Column:
    """The bit of a word: six bits of a hash of the hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(h, F.lit(word)), F.lit(64)).cast("int"))


def block_count(keys: int, bits_a_key: int = BITS_A_KEY) -> int:
    return max(1, -(-keys * bits_a_key // 512))


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter of a list's hosts and paths."""
    keyed = rules.select(_hash(F.col("host"), F.col("path")).alias("h"))
    return keyed.groupBy(_block(F.col("h"), blocks).alias("block")).agg(*(F.bit_or(_bit(F.col("h"), k)).alias(f"w{k}") for k in WORDS))


def possible(candidates: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The candidates (rule_host, rule_path and others) whose bits are all set."""
    keyed = candidates.withColumn("__h", _hash(F.col("rule_host"), F.col("rule_path"))).withColumn("block", _block(F.col("__h"), blocks))
    met = keyed.join(F.broadcast(filter_) if blocks <= FILTER_BLOCKS else filter_, "block")
    for k in WORDS:
        met = met.where(F.col(f"w{k}").bitwiseAND(_bit(F.col("__h"), k)) != 0)
    return met.drop("block", "__h", *(f"w{k}" for k in WORDS))


def _candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All ends of a host at dots, each with all beginnings of the path of a listed length."""
    labels = F.split(host, r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    starts = F.transform(fits, lambda n: F.substr(path, F.lit(1), n))
    pairs = F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: F.struct(e.alias("rule_host"), s.alias("rule_path")))))
    return F.when(host != "", pairs)


def judge(rows: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, the rule that decides (null: none) and the verdict; `rules` has host, path and verdict.

    Wide columns need not be carried along: select a key and the URL beforehand.
    """
    listed = checkpoint(canonical(rules))
    n = listed.count()
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in rows.columns if c not in made]
    host, path = parts(F.col(f"`{url}`"))
    keyed = rows.select(*(F.col(f"`{c}`") for c in kept), host.alias("host"), path.alias("path"))
    if not n:
        return keyed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # as many as there are different lengths of listed paths: bounded by the longest
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())
    blocks = block_count(n)
    whole = F.struct(*(F.col(f"`{c}`") for c in keyed.columns))
    # written, since it is read twice and the numbers must be the same both times
    numbered = checkpoint(keyed.select(F.monotonically_increasing_id().alias("__row"), whole.alias("__whole")))
    each = numbered.select("__row", F.explode(_candidates(F.col("__whole.host"), F.col("__whole.path"), lengths)).alias("__c")).select("__row", "__c.rule_host", "__c.rule_path")
    passed = possible(each, bloom(listed, blocks), blocks)
    exact = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("__verdict"))
    if n <= BROADCAST_RULES:
        hits = passed.join(F.broadcast(exact), ["rule_host", "rule_path"])
    else:
        # of a long list few rules are met: each candidate once against them, then the met ones under several salts
        met = checkpoint(passed.select("rule_host", "rule_path").distinct().join(exact, ["rule_host", "rule_path"]), n)
        few = met.count() <= BROADCAST_RULES
        salt = F.pmod(F.col("__row"), F.lit(SALTS)).cast("int")
        salted = met.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = passed.join(F.broadcast(met), ["rule_host", "rule_path"]) if few else passed.withColumn("__salt", salt).join(salted, ["rule_host", "rule_path", "__salt"])
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host"), F.concat("rule_host", "rule_path").alias("rule"), F.col("__verdict").alias("verdict"))
    judged = hits.select("__row", F.lit(None).cast(numbered.schema["__whole"].dataType).alias("__whole"), rank.alias("__rank"))
    # one shuffle: each row with the rules that fit it, of which the first pass keeps one a task
    both = numbered.withColumn("__rank", F.lit(None).cast(judged.schema["__rank"].dataType)).unionByName(judged)
    best = both.groupBy("__row").agg(F.first("__whole", ignorenulls=True).alias("__whole"), F.max("__rank").alias("__rank"))
    return best.select("__whole.*", F.col("__rank.rule").alias("rule"), F.coalesce("__rank.verdict", F.lit(default)).alias("verdict"))
