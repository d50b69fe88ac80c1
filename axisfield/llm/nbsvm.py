"""Quality classifier: naive Bayes features with a linear support vector machine.

Indicators of n-grams (words, word pairs, three bytes, and which of five neighbouring words
are alike) are hashed to `CELLS` columns. Each is scaled by its log-count ratio between the
classes. A linear hinge-loss model is then fitted to the scaled indicators by dual coordinate
descent, and its margins become probabilities by a logistic fit on the rows left out of each
of three parts.

Bounds of the fit, which are parameters: the ratios count all labelled rows up to about
`COUNT_ROWS` (beyond it a share of the labelled ids, by their hash), the descent takes at most
`FIT_ROWS` of them and `FIT_BYTES` of their columns, those of least hashed id, so that reruns
agree. The labels in use are bounded and therefore broadcast: texts are never shuffled.

Defined results: null and empty texts have no n-grams and get the score of the bias; labels
that are null or not 0 or 1 are left out, and so are ids with both labels; without both classes
the score is the label's share (1 without labels); repeated rows get equal scores. Other columns
are not carried (join on the id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisfield.llm.common import PrefixHash, checkpoint, mix, row_groups, text_buffer
from axisfield.llm.ngram_join import word_hashes

#: Hashed columns, cells of a block of counts.
CELLS, BLOCK = 1 << 17, 1 << 13
#: Labelled ids that the ratios count, rows of a fit, bytes of their columns (4 each) that come to the driver.
COUNT_ROWS, FIT_ROWS, FIT_BYTES = 200_000, 6000, 64 << 20


def ngrams(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's distinct columns."""
    data, offsets = text_buffer(column)
    for a, b in row_groups(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words, rows = word_hashes(part, own)
        at = np.searchsorted(rows, np.arange(b - a + 1))
        pairs = mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(0x9E3779B97F4A7C15))
        shape = np.zeros(max(0, len(words) - 4), np.uint64)
        for bit, (i, j) in enumerate((i, j) for i in range(5) for j in range(i)):
            shape |= (words[i : i + len(shape)] == words[j : j + len(shape)]).astype(np.uint64) << np.uint64(bit)
        shape = mix(shape + np.uint64(0xABCDEF12345))
        three = mix(PrefixHash(part).every(3))
        for k in range(b - a):
            s, e = at[k], at[k + 1]
            found = np.concatenate((words[s:e], pairs[s : max(s, e - 1)], shape[s : max(s, e - 4)], three[own[k] : max(own[k], own[k + 1] - 2)]))
            yield np.unique(found & np.uint64(CELLS - 1)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # per column, the log-count ratio included
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        r = self.ratios[found]
        return float(self.weights[found] @ r / (np.sqrt(r @ r) + 1e-12)) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model (L1 loss) by dual coordinate descent."""
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    values = []
    for r in rows:
        x = ratios[r]
        values.append(x / (np.sqrt(x @ x) + 1e-12))
    square = np.array([x @ x + 1.0 for x in values])
    # the rarer class counts as much as the other
    most = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities, by Newton steps towards smoothed targets."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (p - target) + 1e-6 * theta)
        theta = theta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray, smooth: float = 1.0) -> Model:
    """`counts`: documents of each class that have a column, over all labelled rows."""
    y = np.where(labels == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        share = float((labels == 1).mean()) if len(y) else 1.0
        odds = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Model(np.zeros(CELLS, np.float32), np.zeros(CELLS, np.float32), 0.0, 1.0, float(odds))
    with_prior = counts + smooth
    ratios = np.log(with_prior[1] / with_prior[1].sum()) - np.log(with_prior[0] / with_prior[0].sum())
    margins = np.zeros(len(y))
    part = np.arange(len(y)) % 3
    for k in range(3):
        inside, out = np.flatnonzero(part != k), np.flatnonzero(part == k)
        w, bias = descend([rows[i] for i in inside], y[inside], ratios, epochs=6)
        held = Model(w, ratios, bias, 1.0, 0.0)
        margins[out] = [held.margin(rows[i]) for i in out]
    slope, shift = logistic(margins, y)
    w, bias = descend(rows, y, ratios)
    return Model(w.astype(np.float32), ratios.astype(np.float32), bias, slope, shift)


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """`labelled`: key (any), text, quality 0 or 1."""
    order = F.xxhash64("key")
    bound = labelled.select(order.alias("h")).orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.uint32)
        names, types = ["quality", "h", "found", "block", "counts"], (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        for batch in batches:
            keep = [[], [], []]
            for q, h, found in zip(batch.column("quality").to_pylist(), batch.column("h").to_pylist(), ngrams(batch.column("text")), strict=True):
                counts[q, found] += 1
                if h <= bound:
                    for to, x in zip(keep, (q, h, found.tobytes()), strict=True):
                        to.append(x)
            n = len(keep[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(keep, types, strict=False)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        blocks = [(k, counts[:, k * BLOCK : (k + 1) * BLOCK]) for k in range(CELLS // BLOCK)]
        blocks = [(k, x.astype("<u4").tobytes()) for k, x in blocks if x.any()]
        n = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, types[0]), pa.nulls(n, types[1]), pa.nulls(n, types[2]), pa.array([k for k, _ in blocks], types[3]), pa.array([x for _, x in blocks], types[4])], names=names)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column("counts"))
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    if bound is None:
        return fit([], np.zeros(0), np.zeros((2, CELLS)))
    found = checkpoint(labelled.select("text", F.col("quality").cast("int").alias("quality"), order.alias("h")).mapInArrow(run, "quality int, h long, found binary, block int, counts binary"))
    counts = np.zeros((2, CELLS))
    for row in found.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        counts[:, row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.int64).reshape(2, BLOCK)
    rows = found.where("block is null").select("quality", "h", "found", F.octet_length("found").alias("n"), F.xxhash64("found").alias("x"))
    order = ["h", "quality", "x"]
    taken, room = 0, fit_bytes
    for r in rows.select(*order, "n").orderBy(*order).limit(fit_rows).collect():
        if r.n > room:
            break
        taken, room = taken + 1, room - r.n
    sample = rows.select(*order, "found").orderBy(*order).limit(taken).collect() if taken else []
    return fit([np.frombuffer(r.found, np.int32) for r in sample], np.array([r.quality for r in sample]), counts)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS floats twice: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(x) for x in ngrams(batch.column(1))], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, score double")


def labels_in_use(labels: DataFrame, most: int = COUNT_ROWS) -> DataFrame:
    """(doc_id, quality) of ids that are not held out and have one label: all, or about `most` by the hash of the id."""
    marks = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    marks = checkpoint(marks.where("quality = other").select("doc_id", "quality"))
    if (n := marks.count()) > most:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.lit(most * (1 << 31) // n))
    return marks


def with_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns only from rows that are not held out."""
    # bounded by COUNT_ROWS, whatever the size of the tables
    marks = F.broadcast(labels_in_use(labels))
    labelled = docs.select("doc_id", "text").join(marks, "doc_id").withColumnRenamed("doc_id", "key")
    scored = score(docs, train(labelled))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
