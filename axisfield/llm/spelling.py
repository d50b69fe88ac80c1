"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word's letters are counted in 32 places (a to z, and six for the letters from U+00C0 on). One inserted letter adds one to one count,
a replaced letter takes one from a place and adds one to another: near words lie within an L1 distance of one (lengths
that differ by one) or two (equal lengths). Counts are kept in unary, as bit masks, so that the least and greatest counts of a
box are the "and" and "or" of its words, and the distance of a word to a box is two population counts; a count beyond the mask's
levels is cut, which only makes distances smaller, so nothing is missed. Levels grow with the length of the words.

On Spark, each length has its own tree. Lengths of more words than a leaf may hold get an upper tree, whose splits come from at most
SAMPLE_WORDS masks (hashes of the words choose them; only splits depend on them, no word is left out). Words are
dealt to its leaves as stored words, and as asked words to all leaves whose box is within reach. A leaf that holds more than
expected (words of equal counts can't be split) is dealt in blocks, and so are its asked words. Within a task a lower tree
prunes boxes, and what is within reach is verified letter by letter.

Defined results: null and empty texts have no words; a null id is written as an empty one; equal rows count each; text is
taken in parts of STEP bytes that end between words, so memory is bounded but for a single run of letters; an empty table gives
no rows; other columns of the documents are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisfield.llm.common import checkpoint, row_groups, text_buffer

#: Words of a leaf of the upper tree, bytes of their letters, words of a leaf of the lower tree.
LEAF_WORDS, LEAF_BYTES, LOWER_LEAF = 32_768, 32 << 20, 24
#: Masks that the upper trees are made from, for all lengths together.
SAMPLE_WORDS = 200_000
#: Bytes of text counted at a time.
STEP = 4 << 20
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One in so many runs of a document loses a letter; zero turns it off.
DAMAGED = 97

PLACES = 32

# ---- counting


def _crc_table() -> np.ndarray:
    """CRC-32 of single bytes (polynomial of zlib, reflected)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_on(start: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The CRC-32 of what `start` is the CRC-32 of, followed by `length` bytes from each place: all places in step."""
    s = start ^ np.uint32(0xFFFFFFFF)
    for k in range(length):
        s = _CRC[(s ^ data[at + k]) & 255] ^ (s >> np.uint32(8))
    return s ^ np.uint32(0xFFFFFFFF)


def word_counts(data: np.ndarray, offsets: np.ndarray, base: np.ndarray, damaged: int = DAMAGED, least: int = LEAST_LETTERS) -> tuple[list[bytes], list[int]]:
    """Distinct words of rows of UTF-8 bytes as Latin-1, and how often each occurs; `base` is the CRC-32 of each row's key."""
    data = _LOWER[data]
    lead = data == 0xC3
    small = (data - np.uint8(97)) < 26
    letter = small | lead
    letter[1:] |= lead[:-1]
    # one more place, so that a run may end with the data
    inner = np.zeros(len(data) + 1, bool)
    inner[:-1] = letter
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    heads = np.unique(offsets[:-1])
    begins[heads] = inner[heads]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inner[:-1] & ~inner[1:]
    ends[heads[heads > 0]] |= inner[heads[heads > 0] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    doubles = np.zeros(len(data) + 1, np.int32)
    np.cumsum(lead, out=doubles[1:])
    letters = (end - start) - (doubles[end] - doubles[start])
    keep = letters >= least
    start, end, letters = start[keep], end[keep], letters[keep]
    owner = np.searchsorted(offsets, start, "right") - 1
    # the same letters, a byte each
    latin = data + np.uint8(0x40) * np.concatenate(([False], lead[:-1]))
    latin, first = latin[~lead], start - doubles[start]
    crc = np.zeros(len(start), np.uint32)
    size = end - start
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        if n <= 64:
            crc[some] = _crc_on(base[owner[some]], data, start[some], int(n))
        else:
            crc[some] = [zlib.crc32(data[start[k] : end[k]], int(base[owner[k]])) for k in some]
    hit = crc % damaged == 0 if damaged else np.zeros(len(crc), bool)
    words, counts = [], []
    for n in np.unique(letters):
        at = first[(letters == n) & ~hit]
        if n > 64:
            found, times = np.unique(np.array([latin[k : k + n].tobytes() for k in at], object), return_counts=True)
        elif len(at):
            spelt = np.zeros((len(at), 8 if n <= 8 else int(n)), np.uint8)
            for k in range(n):
                spelt[:, k] = latin[at + k]
            if n <= 8:
                found, times = np.unique(spelt.view(np.uint64)[:, 0], return_counts=True)
                found = found.view("S8")
            else:
                found, times = np.unique(spelt.view(f"S{n}")[:, 0], return_counts=True)
        else:
            continue
        words += found.tolist()
        counts += times.tolist()
    for k in np.flatnonzero(hit):
        if letters[k] > least:
            out = int(crc[k]) % int(letters[k])
            spelt = latin[first[k] : first[k] + letters[k]].tobytes()
            words.append(spelt[:out] + spelt[out + 1 :])
            counts.append(1)
    return words, counts


def _parts(data: np.ndarray, offsets: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in groups of about STEP bytes; a longer row in parts that end after an ASCII character that is no letter."""
    for a, b in row_groups(offsets, STEP):
        start, end = int(offsets[a]), int(offsets[b])
        while end - start > 2 * STEP:
            at = start + STEP
            # the next byte that ends a run, looked for a stretch at a time
            while at < end:
                stretch = data[at : min(at + STEP, end)]
                found = np.flatnonzero((stretch < 128) & (((stretch | 0x20) - np.uint8(97)) >= 26))
                if len(found):
                    at += int(found[0]) + 1
                    break
                at += len(stretch)
            yield data[start:at], np.array([0, at - start]), base[a:b]
            start = at
        yield data[start:end], np.maximum(offsets[a : b + 1] - start, 0), base[a:b]


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", damaged: int = DAMAGED, least: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of all words of the documents, counted in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            base = batch.column("base").to_numpy().astype(np.uint32)
            for part in _parts(data, offsets, base):
                words, counts = word_counts(*part, damaged, least)
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    base = F.crc32(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":")).cast("binary"))
    rows = docs.select(F.col(f"`{text}`").alias("text"), base.alias("base")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- trees


def levels_of(length: int) -> int:
    """Counts that a place's mask tells apart; a multiple of two, so that 32 places fill whole words."""
    return min(64, 2 * -(-length // 16))


def masks(letters: np.ndarray, levels: int) -> np.ndarray:
    """Unary letter counts of words of one length (rows of Latin-1 letters), as rows of 64-bit words.

    Bit (level * 32 + place) is set if a letter of the place occurs more than `level` times.
    """
    n, length = letters.shape
    out = np.zeros((n, levels * PLACES // 64), np.uint64)
    step = max(1, (4 << 20) // max(1, length))
    for a in range(0, n, step):
        some = letters[a : a + step]
        place = np.where(some < 128, some - np.uint8(97), 26 + some % 6).astype(np.int64)
        counts = np.bincount((np.arange(len(some))[:, None] * PLACES + place).ravel(), minlength=len(some) * PLACES).reshape(-1, PLACES)
        unary = counts[:, None, :] > np.arange(levels)[None, :, None]
        out[a : a + step] = np.packbits(unary.reshape(len(some), -1), axis=1, bitorder="little").view(np.uint64)
    return out


def _beyond(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The L1 distance of masks to a box."""
    return (np.bitwise_count(low & ~queries) + np.bitwise_count(queries & ~high)).sum(axis=1, dtype=np.int32)


class Tree:
    """A k-d tree over masks: a node splits on whether a place's count exceeds a level, the split nearest to halves."""

    def __init__(self, points: np.ndarray, most: int, cells: bool = False):
        """With `cells`, boxes are the splits' own, so that they hold for masks that are not among the points."""
        self.low, self.high, self.split, self.below, self.items = [], [], [], [], []
        everything = np.uint64(2**64 - 1)
        words = points.shape[1]
        todo = [(np.arange(len(points)), np.zeros(words, np.uint64), np.full(words, everything), -1, 0)]
        while todo:
            own, low, high, parent, side = todo.pop()
            node = len(self.low)
            if parent >= 0:
                self.below[parent][side] = node
            some = points[own]
            self.low.append(low if cells else np.bitwise_and.reduce(some, axis=0))
            self.high.append(high if cells else np.bitwise_or.reduce(some, axis=0))
            self.below.append([-1, -1])
            bits = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little") if len(own) > most else None
            held = bits.sum(axis=0, dtype=np.int64) if bits is not None else np.zeros(1, np.int64)
            bit = int(np.argmin(np.abs(2 * held - len(own))))
            if len(own) <= most or held[bit] in (0, len(own)):
                self.split.append(-1)
                self.items.append(own)
                continue
            self.split.append(bit)
            self.items.append(None)
            has = bits[:, bit].astype(bool)
            # a count above a level is above all lower ones, and one not above it above none higher
            level, place = divmod(bit, PLACES)
            total = 64 * words // PLACES
            more, less = low.copy(), high.copy()
            for k in range(total):
                word, one = divmod(k * PLACES + place, 64)
                if k <= level:
                    more[word] |= np.uint64(1) << np.uint64(one)
                if k >= level:
                    less[word] &= ~(np.uint64(1) << np.uint64(one))
            todo += [(own[has], more, high, node, 1), (own[~has], low, less, node, 0)]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            bit = self.split[node]
            if bit < 0:
                out[own] = node
                continue
            has = (points[own, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
            todo += [(self.below[node][1], own[has]), (self.below[node][0], own[~has])]
        return out

    def reach(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the queries whose distance to the leaf's box is at most the radius."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, own = todo.pop()
            own = own[_beyond(queries[own], self.low[node], self.high[node]) <= radius]
            if not len(own):
                continue
            if self.split[node] < 0:
                yield node, own
            else:
                todo += [(child, own) for child in self.below[node]]


def one_edit(asked: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Which pairs of rows (of letters) differ by exactly one replaced letter, or by one inserted into the asked word."""
    if asked.shape[1] == stored.shape[1]:
        return (asked != stored).sum(axis=1) == 1
    alike, shifted = asked == stored[:, :-1], asked == stored[:, 1:]
    return (np.logical_and.accumulate(alike, axis=1) | shifted).all(axis=1)


def near_pairs(stored: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (of asked, of stored words) of all near pairs, in parts; rows are letters, asked ones as long or one shorter."""
    if not len(stored) or not len(asked):
        return
    length = stored.shape[1]
    radius, levels = (2 if asked.shape[1] == length else 1), levels_of(length)
    own, seen = masks(stored, levels), masks(asked, levels)
    tree = Tree(own, LOWER_LEAF)
    most = max(1, (16 << 20) // length)
    for leaf, who in tree.reach(seen, radius):
        items = tree.items[leaf]
        for b in range(0, len(items), 256):
            part = items[b : b + 256]
            for c in range(0, len(who), 4096):
                few = who[c : c + 4096]
                apart = np.bitwise_count(seen[few][:, None, :] ^ own[part][None]).sum(axis=2, dtype=np.int32)
                i, j = np.nonzero(apart <= radius)
                i, j = few[i], part[j]
                for d in range(0, len(i), most):
                    good = one_edit(asked[i[d : d + most]], stored[j[d : d + most]])
                    if good.any():
                        yield i[d : d + most][good], j[d : d + most][good]


# ---- on Spark


def _letters(words: pa.Array, length: int) -> np.ndarray:
    spelt = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(spelt), np.uint8).reshape(len(spelt), length)


def leaf_words(length: int) -> int:
    return max(1, min(LEAF_WORDS, LEAF_BYTES // length))


def upper_trees(words: DataFrame) -> tuple[dict[int, int], dict[int, Tree]]:
    """Words of each length, and a tree for each length of more words than a leaf may hold."""
    held = {r["size"]: r["count"] for r in words.groupBy(F.length("word").alias("size")).count().collect()}
    big = {k: n for k, n in held.items() if n > leaf_words(k)}
    if not big:
        return held, {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for k in np.unique(sizes):
                some = batch.column("word").filter(pa.array(sizes == k))
                found = masks(_letters(some, int(k)), levels_of(int(k)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array([m.tobytes() for m in found], pa.binary())], names=["size", "mask"])

    # the same share of every length, by a hash of the word
    share = min(1.0, SAMPLE_WORDS / sum(big.values()))
    unit = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = words.select(F.length("word").alias("size"), "word").where(F.col("size").isin(*big) & (unit < share))
    seen: dict[int, list[bytes]] = {k: [] for k in big}
    for r in chosen.mapInArrow(run, "size int, mask binary").orderBy("size", "mask").collect():
        seen[r["size"]].append(bytes(r["mask"]))
    trees = {}
    for k, n in big.items():
        points = np.frombuffer(b"".join(seen[k]), np.uint64).reshape(-1, levels_of(k) // 2)
        if len(points):
            # so many of the sample as a leaf holds of all words
            trees[k] = Tree(points, max(1, leaf_words(k) * len(points) // n), cells=True)
    return held, trees


STORED, ASKED = 0, 1


def placed(words: DataFrame, held: dict[int, int], trees: dict[int, Tree]) -> DataFrame:
    """(size, leaf, role, word, n): each word where it is stored, and where it is asked: in other leaves of its length, and of the next."""
    shared = words.sparkSession.sparkContext.broadcast((held, trees))

    def places(letters: np.ndarray, size: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(row, leaf) of all leaves of a size within reach, and each row's own leaf."""
        tree = shared.value[1].get(size)
        rows = np.arange(len(letters))
        if tree is None:
            return rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        seen = masks(letters, levels_of(size))
        found = [(who, np.full(len(who), leaf)) for leaf, who in tree.reach(seen, radius)]
        return np.concatenate([w for w, _ in found]), np.concatenate([x for _, x in found]), tree.leaf_of(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for k in np.unique(sizes):
                k = int(k)
                some = batch.filter(pa.array(sizes == k))
                letters = _letters(some.column("word"), k)
                rows, leaves, own = places(letters, k, 2)
                other = leaves != own[rows]
                made = [(np.arange(len(letters)), own, k, STORED), (rows[other], leaves[other], k, ASKED)]
                if k + 1 in shared.value[0]:
                    made.append((*places(letters, k + 1, 1)[:2], k + 1, ASKED))
                for who, leaf, size, role in made:
                    for a in range(0, len(who), 50_000):
                        part = some.take(pa.array(who[a : a + 50_000]))
                        n = part.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(leaf[a : a + 50_000].astype(np.int64)), pa.array(np.full(n, role, np.int32)), part.column("word"), part.column("n")], names=["size", "leaf", "role", "word", "n"])

    return words.select(F.length("word").alias("size"), "word", "n").mapInArrow(run, "size int, leaf long, role int, word string, n long")


def _spread(rows: DataFrame) -> DataFrame:
    """Deals the rows of each leaf to blocks (stored, asked), one of each where the leaf is no larger than expected."""
    limit = F.least(F.lit(LEAF_WORDS), F.greatest(F.lit(1), F.lit(LEAF_BYTES) / F.col("size")))
    is_stored = F.col("role") == STORED
    sizes = rows.groupBy("size", "leaf").agg(F.sum(is_stored.cast("long")).alias("stored"), F.sum((~is_stored).cast("long")).alias("asked"))
    over = sizes.withColumns({"stores": F.ceil(F.col("stored") / limit / 4).cast("int"), "asks": F.ceil(F.col("asked") / limit / 16).cast("int")}).where("stores > 1 or asks > 1")
    # at most one row for every 4 x LEAF_WORDS words
    dealt = rows.join(F.broadcast(over.select("size", "leaf", "stores", "asks")), ["size", "leaf"], "left")
    stores, asks = F.coalesce("stores", F.lit(1)), F.greatest(F.lit(1), F.coalesce("asks", F.lit(1)))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    pick = lambda n: F.array(F.pmod(F.xxhash64("word"), n).cast("int"))
    one = dealt.withColumn("store", F.explode(F.when(is_stored, pick(stores)).otherwise(every(stores)))).withColumn("ask", F.explode(F.when(is_stored, every(asks)).otherwise(pick(asks))))
    # stored words are asked in the leaf's other blocks as well
    again = dealt.where(is_stored & (F.col("stores") > 1)).withColumn("store", F.explode(every(stores))).where(F.col("store") != pick(stores)[0]).withColumn("ask", F.lit(0)).withColumn("role", F.lit(ASKED))
    return one.unionByName(again).drop("stores", "asks")


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words one edit apart, both ways; `words` has distinct words and their counts n."""
    held, trees = upper_trees(words)
    rows = checkpoint(placed(words, held, trees))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size, ask = key[0].as_py(), key[3].as_py()
        word, n, role = table.column("word").combine_chunks(), table.column("n").to_numpy(), table.column("role").to_numpy()
        lengths = pa.compute.utf8_length(word).to_numpy()
        stored = np.flatnonzero(role == STORED)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        letters = _letters(word.take(pa.array(stored)), size)
        for shorter in (0, 1):
            asked = np.flatnonzero((role == ASKED) & (lengths == size - shorter))
            if not shorter and not ask:
                asked = np.concatenate((stored, asked))
            for i, j in near_pairs(letters, _letters(word.take(pa.array(asked)), size - shorter)):
                i, j = asked[i], stored[j]
                out += [(i, j), (j, i)] if shorter else [(i, j)]
        i, j = (np.concatenate([p[k] for p in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"word": word.take(pa.array(i)), "near": word.take(pa.array(j)), "near_n": pa.array(n[j], pa.int64())})

    return _spread(rows).groupBy("size", "leaf", "store", "ask").applyInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of words that have a form: forms followed to the last, by doubling the step; `most` bounds the counts.

    A form is at least twice as frequent, so a chain is no longer than the counts have binary digits.
    """
    out = checkpoint(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(max(2, most).bit_length())))):
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        out = checkpoint(out.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root")))
    return out


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", damaged: int = DAMAGED, least: int = LEAST_LETTERS, often: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least `least` letters and `often` occurrences."""
    words = checkpoint(counted(docs, key, text, damaged, least).where(F.col("n") >= often))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    found = links(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    takes = -F.col("best.minus") >= 2 * F.col("n")
    joined = checkpoint(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n")))
    most = joined.agg(F.max("form_n")).first()[0]
    ends = roots(joined.where("form is not null"), most or 1)
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
