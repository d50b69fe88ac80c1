"""Exact n-gram Jaccard join of all documents with a token-group matrix.

1. Shingle sets. Documents with the same set are one node, so copies cost nothing more. A
   node's number ends in its size class: sizes of a class differ by 6 percent at most.
2. Prefixes. A count sketch of fixed size puts frequent shingles last in the order that all
   nodes share; by it, two sets that reach the threshold share a shingle among their first
   n - ceil(threshold n) + 1, and as many more as their sizes ask for (`_least_shared`).
3. Refutation by class. Per shingle and size class, the least and the greatest node tell whether
   another node is there. A node whose prefix shares too few shingles with all nodes of
   a class together has no partner in that class. This is linear: a list of any length is one
   row a class. What is left posts only its rarest shared shingles: one more than it can miss.
4. Hubs. In a few rounds each node is compared with one node (the least or greatest of the lists
   that it shares most), so that most copies are in one component before any matrix.
5. Matrix. The nodes left in lists of several components are dealt to groups of similar documents:
   a component, or else the longest list a node is in, in parts of bounded size. Rows (list,
   part) say which parts a node meets; the overlap of the node's shingles with the part's token
   union bounds that with all its members at once, and only qualifying parts are opened.
6. Components of all links that the sets themselves confirm.

Every pair that shares a shingle of its prefixes is either compared, or refuted by its class's
or part's union or by its own prefixes, or already in one component, so no link between
different components is lost. No list, group or component is ever whole in one task, but for the
window over a rare shingle; hot keys are met in joins that Spark splits.

Defined results: null or wordless texts have an empty set and link with nothing, each its
own component; a null id never is a component's id while another is there (a component of
null ids only has the id null); repeated rows each get their row. Sets are identified by
64-bit digests. Extra columns are not carried (join on the id).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisfield.llm.common import PrefixHash, checkpoint, mix, row_groups, shuffle_partitions, text_buffer
from axisfield.llm.components import components

#: Cells of the frequency sketch (4 bytes each), cells of a block, rounds of comparing nodes with hubs.
CELLS, BLOCK, ROUNDS = 1 << 18, 1 << 13, 3
#: Members of a group's part: the square root of the group within these bounds. Parts that a frequent shingle's list is dealt to.
PART, SALTS = (16, 1024), 64
#: Nodes that a task remembers, so as not to post one again. Nodes (8 bytes each) up to which those in want of texts are broadcast.
REMEMBERED, BROADCAST_NODES = 100_000, 1_000_000


def _class_starts() -> np.ndarray:
    """Least size of each class: every size its own up to 17, then 6 percent a class."""
    starts = [1]
    while len(starts) < 1 << 9:
        starts.append(max(starts[-1] + 1, int(starts[-1] * 1.06)))
    return np.array(starts, np.int64)


_STARTS = _class_starts()


def reach(percent: int) -> int:
    """How many classes a partner's may be away."""
    ends = np.minimum(np.append(_STARTS[1:], 2**50) - 1, 2**50)
    away = np.searchsorted(_STARTS, ends * 100 // percent, "right") - 1 - np.arange(len(_STARTS))
    if (most := int(away.max())) > 15:
        raise ValueError("percent is too low: sizes of partners are too far apart")
    return most


_STEPS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 2**64) for k in range(64)], np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a buffer and each word's row."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    ends = np.flatnonzero(word & ~after) + 1
    hashes = mix(PrefixHash(data).spans(starts, ends) + (ends - starts).astype(np.uint64) * _STEPS[40])
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; fewer words than the width make one shingle."""
    data, offsets = text_buffer(column)
    for a, b in row_groups(offsets):
        words, rows = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        at = np.searchsorted(rows, np.arange(b - a + 1))
        n = max(0, len(words) - width + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(width):
            grams += words[k : k + n] * _STEPS[k]
        grams = mix(grams)
        for s, e in zip(at[:-1], at[1:], strict=True):
            if e - s >= width:
                yield np.unique(grams[s : e - width + 1])
            elif e > s:
                yield mix((words[s:e] * _STEPS[: e - s]).sum(keepdims=True) + _STEPS[50 + e - s : 51 + e - s])
            else:
                yield np.zeros(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """The set's digest; its last nine bits are the set's size class."""
    size_class = int(np.searchsorted(_STARTS, len(tokens), "right")) - 1
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) & ~511 | size_class


def needed(n: int, percent: int) -> int:
    """The least overlap with any set that reaches the threshold."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    n, m = len(a), len(b)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (n + m - both)


def _nodes(docs: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, n, node) per document; after a task's rows, its part of the frequency sketch in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        names = ["doc_id", "n", "node", "block", "counts"]
        for batch in batches:
            n, node = [], []
            for tokens in shingle_sets(batch.column(1), width):
                n.append(len(tokens))
                node.append(node_of(tokens) if len(tokens) else None)
                cells += np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32) if len(tokens) > CELLS // 8 else 0
                if len(tokens) <= CELLS // 8:
                    cells[(tokens & np.uint64(CELLS - 1)).astype(np.int64)] += 1
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        blocks = [i for i in range(CELLS // BLOCK) if cells[i * BLOCK : (i + 1) * BLOCK].any()]
        k = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(blocks, pa.int32()), pa.array([cells[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes() for i in blocks], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, n long, node long, block int, counts binary")


def _frequency_classes(nodes: DataFrame) -> np.ndarray:
    """A small class per sketch cell: 0 where the count is as by chance, then by its logarithm. At most 1 MB reaches the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), "<u4")
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

    cells = np.zeros(CELLS, np.int64)
    for row in nodes.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        cells[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.counts, "<u4")
    mean = np.median(cells)
    over = np.maximum(0, (cells - mean) / (4 * np.sqrt(mean) + 8))
    return np.minimum(31, np.floor(np.log2(np.maximum(over, 0.5))) + 1).astype(np.uint8)


class _Seen:
    """Nodes met lately by a task: bounded, so one may be met again."""

    def __init__(self) -> None:
        self.nodes: set[int] = set()

    def first(self, node: int) -> bool:
        if node in self.nodes:
            return False
        if len(self.nodes) >= REMEMBERED:
            self.nodes.clear()
        self.nodes.add(node)
        return True


def _prefixes(docs: DataFrame, classes, width: int, percent: int) -> DataFrame:
    """(token, node) rows of every node's prefix, some more than once; the last bit of a token says that it is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = classes.value, _Seen()
        for batch in batches:
            tokens_out, nodes_out = [], []
            for tokens in shingle_sets(batch.column(1), width):
                if not len(tokens) or not seen.first(node := node_of(tokens)):
                    continue
                n = len(tokens) - needed(len(tokens), percent) + 1
                frequency = rank[(tokens & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
                order = (frequency << np.uint64(58)) | (tokens >> np.uint64(6))
                first = np.argpartition(order, n - 1)[:n] if n < len(tokens) else slice(None)
                tokens_out.append((tokens[first] & ~np.uint64(1) | (frequency[first] > 0)).view(np.int64))
                nodes_out.append(np.full(len(tokens_out[-1]), node, np.int64))
            if tokens_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens_out)), pa.array(np.concatenate(nodes_out))], names=["token", "node"])

    return docs.mapInArrow(run, "token long, node long")


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, text) once for each wanted node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            rows, nodes = [], []
            for i, tokens in enumerate(shingle_sets(batch.column(1), width)):
                if len(tokens) and seen.first(node := node_of(tokens)):
                    rows.append(i)
                    nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(1).take(pa.array(rows, pa.int64()))], names=["node", "text"])

    # the wanted nodes alone are sent to the texts as long as they are few; beyond, both are shuffled
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    return docs.mapInArrow(run, "node long, text string").join(wanted, "node").dropDuplicates(["node"])


def _sets_of(texts: list[str], width: int) -> list[np.ndarray]:
    return list(shingle_sets(pa.array(texts, pa.string()), width))


def _compare(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among rows (a, text_a, b, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                known: dict[int, np.ndarray] = {}
                keep = []
                mine = shingle_sets(some.column("text_a"), width)
                for i, (b, tokens) in enumerate(zip(some.column("b").to_pylist(), mine, strict=True)):
                    if b not in known:
                        known[b] = _sets_of([some.column("text_b")[i].as_py()], width)[0]
                    if linked(tokens, known[b], percent):
                        keep.append(i)
                keep = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("a").take(keep), some.column("b").take(keep)], names=["a", "b"])

    return pairs.select("a", "text_a", "b", "text_b").mapInArrow(run, "a long, b long")


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """Shingles that the prefixes of linked sets of sizes n and m share at the least.

    Of two prefixes the one that ends first has every common shingle up to its end in both; the rest of its
    set bounds the others. So the shared ones and the larger rest make up the overlap that the two sizes need.
    """
    up = lambda x, by: F.floor((x + F.lit(by - 1)) / F.lit(by))
    rest = lambda x: up(x * percent, 100) - 1
    return F.greatest(F.lit(1), up((n + m) * percent, 100 + percent) - F.greatest(rest(n), rest(m)))


def _least_of_range(n: Column, low: Column, high: Column, percent: int) -> Column:
    """The same with any size of low..high, null if none of them can be linked with n.

    The need is greatest for equal sizes and falls to both sides, so its least is at an end; one is allowed for rounding.
    """
    low = F.greatest(low, F.ceil(n * percent / 100))
    high = F.least(high, F.floor(n * 100 / percent))
    return F.when(low <= high, F.greatest(F.lit(1), F.least(_least_shared(n, low, percent), _least_shared(n, high, percent)) - 1))


def _size_class(node: str) -> Column:
    return F.col(node).bitwiseAND(F.lit(511)).cast("int")


def _classes(spark: SparkSession) -> DataFrame:
    """(size_class, low, high): as many rows as there are classes, whatever the input."""
    ends = [*(_STARTS[1:] - 1).tolist(), 2**62]
    return F.broadcast(spark.createDataFrame(list(zip(range(len(_STARTS)), _STARTS.tolist(), ends, strict=True)), "size_class int, low long, high long"))


def _lists(prefixes: DataFrame) -> DataFrame:
    """(token, node) of tokens that more than one node has; a frequent token's list is dealt, and kept in any case."""
    frequent = F.col("token").bitwiseAND(F.lit(1)) == 1
    dealt = prefixes.withColumn("deal", F.when(frequent, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0))
    of_list = Window.partitionBy("token", "deal")
    both = dealt.withColumn("first", F.min("node").over(of_list)).withColumn("last", F.max("node").over(of_list))
    return both.where((F.col("first") != F.col("last")) | frequent).select("token", "node").distinct()


def _partnered(lists: DataFrame, far: int) -> DataFrame:
    """Adds df (nodes of the token) and near: a bit for each class, counted from the node's own less `far`, in which another node has the token."""
    by_class = lists.groupBy("token", _size_class("node").alias("c")).agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"))
    entries = by_class.groupBy("token").agg(F.collect_list(F.struct("c", "lo", "hi")).alias("entries"), F.sum("n").alias("df"))

    def bit(e: Column) -> Column:
        away = e["c"] - _size_class("node") + F.lit(far)
        other = (e["lo"] != F.col("node")) | (e["hi"] != F.col("node"))
        return F.when(other & away.between(0, 2 * far), F.call_function("shiftleft", F.lit(1), away)).otherwise(F.lit(0))

    near = F.aggregate("entries", F.lit(0), lambda found, e: found.bitwiseOR(bit(e)))
    return lists.join(entries.where("df > 1"), "token").select("token", "node", "df", near.alias("near")).where("near != 0")


def _hopeful(partnered: DataFrame, sized: DataFrame, percent: int, far: int) -> DataFrame:
    """(node, n, alive, limits): the classes, as bits, of which the prefix meets enough, and for each the number of tokens to post."""
    offsets = range(2 * far + 1)
    has = lambda i: F.call_function("shiftright", F.col("near"), F.lit(i)).bitwiseAND(F.lit(1))
    counts = partnered.groupBy("node").agg(*(F.sum(has(i)).alias(f"k{i}") for i in offsets)).join(sized, "node")
    tall = counts.select("node", "n", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k")) for i in offsets))).alias("x")).where("x.k > 0")
    tall = tall.select("node", "n", "x.i", "x.k", (_size_class("node") + F.col("x.i") - far).alias("size_class"))
    tall = tall.join(_classes(partnered.sparkSession), "size_class").withColumn("least", _least_of_range(F.col("n"), F.col("low"), F.col("high"), percent)).where("k >= least")
    bits = F.sum(F.call_function("shiftleft", F.lit(1), F.col("i"))).cast("int")
    return tall.groupBy("node", "n").agg(bits.alias("alive"), F.map_from_entries(F.collect_list(F.struct("i", (F.col("k") - F.col("least") + 1).alias("limit")))).alias("limits"))


def _postings(useful: DataFrame, far: int) -> DataFrame:
    """(node, own, ask): a node's rarest shared tokens, for each class as many as leave too few others for a link.

    `own` is the list of (token, own class, class sought), `ask` the list of those it seeks, in which any partner is.
    """
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(1 << i).alias("bit")) for i in range(2 * far + 1)))
    sought = F.filter(offsets, lambda o: o["bit"].bitwiseAND(F.col("near")).bitwiseAND(F.col("alive")) != 0)
    rows = useful.select("token", "node", "df", "limits", F.explode(F.transform(sought, lambda o: o["i"])).alias("i"))
    place = F.row_number().over(Window.partitionBy("node", "i").orderBy("df", "token"))
    rows = rows.withColumn("place", place).where(F.col("place") <= F.element_at("limits", F.col("i")))
    own, other = _size_class("node"), _size_class("node") + F.col("i") - far
    return rows.select("node", F.xxhash64("token", own, other).alias("own"), F.xxhash64("token", other, own).alias("ask"))


def _named(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _merged(groups: DataFrame, links: DataFrame, nodes: int, most_links: int | None) -> DataFrame:
    """(node, component) of all nodes but each component's least, after more links; only components that meet are worked on."""
    name = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    met = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = components(met, most_links)
    renamed = groups.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return checkpoint(renamed.unionByName(new), nodes)


def _hub_pairs(postings: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node with the hub, of another component, of the lists it shares most of.

    A list's hub is its most central node (most of its prefix is found elsewhere: an original, of which others are
    copies with changes of their own), later any by a hash of the turn.
    """
    named = _named(postings, groups)
    first = -F.col("central") if turn == 0 else F.xxhash64("node", F.lit(turn))
    order = F.struct(first.alias("first"), "component", "node")
    hubs = named.groupBy("own").agg(F.min(order).alias("hub")).select(F.col("own").alias("ask"), "hub")
    shared = named.join(hubs, "ask").where("component != hub.component").groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("k"))
    best = shared.groupBy("node").agg(F.max(F.struct("k", F.bitwise_not("hub").alias("last"))).alias("best")).select("node", F.bitwise_not("best.last").alias("hub"))
    return best.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def _matrix_pairs(postings: DataFrame, groups: DataFrame, shapes: DataFrame, percent: int, rows_posted: int, nodes: int) -> DataFrame:
    """(a, b): pairs of different components that neither a part's token union nor their own prefixes refute.

    `shapes`: node, n and tokens (the prefix's shared ones).
    """
    named = _named(postings, groups)
    of_list = named.groupBy("own").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    asked = of_list.select(F.col("own").alias("ask"), "lo", "hi", "size")
    rows = checkpoint(named.join(asked, "ask").where("lo != component or hi != component").select("node", "component", "own", "ask", "size"), rows_posted)
    # groups: a component, or the longest list of a node on its own
    of_node = rows.groupBy("node", "component").agg(F.max(F.struct("size", F.least("own", "ask").alias("list"))).alias("longest"))
    linked = rows.select("component").distinct().join(groups.select("component").distinct(), "component").withColumn("linked", F.lit(True))
    dealt = of_node.join(linked, "component", "left")
    dealt = dealt.select("node", "component", F.col("linked").isNotNull().alias("one"), F.when(F.col("linked").isNotNull(), F.col("component")).otherwise(F.col("longest.list")).alias("label"))
    sizes = dealt.groupBy("one", "label").agg(F.count(F.lit(1)).alias("members"))
    members_a_part = F.least(F.greatest(F.sqrt("members"), F.lit(float(PART[0]))), F.lit(float(PART[1])))
    sizes = sizes.select("one", "label", F.ceil(F.col("members") / members_a_part).alias("parts"))
    dealt = dealt.join(sizes, ["one", "label"]).withColumn("part", F.xxhash64("one", "label", F.pmod(F.xxhash64("node"), F.col("parts"))))
    members = checkpoint(dealt.select("node", "component", "one", "part").join(shapes, "node"), 20 * nodes)  # their tokens are long
    unions = members.groupBy("part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"), F.when(F.first("one"), F.first("component")).alias("only"))
    # the matrix: which parts have a list
    own_part = members.select("node", F.col("part").alias("own_part"))
    placed = rows.join(own_part, "node")
    matrix = placed.select(F.col("own").alias("ask"), F.col("own_part").alias("part")).distinct()
    queries = placed.join(matrix, "ask").where("own_part >= part").select("node", "part").distinct()
    about = members.select("node", F.col("component").alias("mine"), F.col("n").alias("size"), F.col("tokens").alias("held"))
    shared = F.size(F.array_intersect("held", "tokens"))
    open_parts = queries.join(about, "node").join(unions, "part").where("only is null or only != mine").where(shared >= _least_of_range(F.col("size"), F.col("low"), F.col("high"), percent)).select("part", F.col("node").alias("asks"), "mine", "size", "held")
    inside = F.col("n").between(F.ceil(F.col("size") * percent / 100), F.floor(F.col("size") * 100 / percent))
    pairs = open_parts.join(members.select("part", "node", "component", "n", "tokens"), "part").where(F.col("mine") != F.col("component")).where(inside & (shared >= _least_shared(F.col("size"), F.col("n"), percent)))
    return pairs.select(F.greatest("asks", "node").alias("a"), F.least("asks", "node").alias("b")).distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    spark, far = docs.sparkSession, reach(percent)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    nodes = checkpoint(_nodes(own, width))
    classes = spark.sparkContext.broadcast(_frequency_classes(nodes))
    lists = checkpoint(_lists(_prefixes(own, classes, width, percent)))
    sized = nodes.where("node is not null").select("node", "n").distinct()
    partnered = checkpoint(_partnered(lists, far))
    useful = partnered.join(_hopeful(partnered, sized, percent, far), "node").where(F.col("near").bitwiseAND(F.col("alive")) != 0)
    useful = checkpoint(useful)
    postings = _postings(useful, far)
    shapes = useful.groupBy("node", "n").agg(F.collect_list("token").alias("tokens"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    central = useful.groupBy("node", "n").agg((F.count(F.lit(1)) / prefix).alias("central")).drop("n")
    # lists that no one seeks are of no use
    postings = postings.join(postings.select(F.col("own").alias("ask")).distinct(), "ask", "left_semi")
    postings = checkpoint(postings.join(central, "node"))
    rows_posted = postings.count()
    wanted = checkpoint(postings.select("node").distinct(), rows_posted)
    n_nodes = wanted.count()
    # bucketed by node, so that only pairs are shuffled to the texts they need
    table = f"shingle_texts_{uuid.uuid4().hex}"
    try:
        _texts(own, wanted, width).write.bucketBy(shuffle_partitions(spark), "node").sortBy("node").saveAsTable(table)
        texts = spark.table(table)
        of_text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        groups = spark.createDataFrame([], "node long, component long")
        tried = None
        for k in range(ROUNDS + 1):
            hubs = k < ROUNDS
            pairs = _hub_pairs(postings, groups, k) if hubs else _matrix_pairs(postings, groups, shapes, percent, rows_posted, n_nodes)
            # a node has one hub in a round; what the matrix leaves is not bounded beforehand
            pairs = checkpoint(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), n_nodes if hubs else None)
            tried = pairs if tried is None else tried.union(pairs)
            links = _compare(pairs.join(of_text("a"), "a").join(of_text("b"), "b"), width, percent)
            groups = _merged(groups, links, n_nodes, n_nodes if hubs else None)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    ids = nodes.where("block is null")
    # named by node first: copies and large components are met as one row each
    least = ids.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = checkpoint(_named(least, groups), ids.count())
    linked = named.join(groups.select("component").distinct(), "component", "left_semi")
    component_ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(component_ids, "component", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    found = ids.where("node is not null").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(ids.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
