"""Exact removal of repeated byte strings by prefix-free parsing.

1. Parse. A rolling hash of `TRIGGER` bytes is computed at every byte; where it is least
   among the places at which a window of `width` bytes can hold it, it is a trigger. Triggers
   depend on the window alone, so equal windows have the same trigger at the same place, and
   phrases (the text around a trigger that covers all windows it was chosen in) overlap as in
   prefix-free parsing, with a bounded length that a plain modulus would not give.
2. Dictionary and parse. Phrases are grouped by their trigger string and by their whole
   content. All occurrences of a phrase but the first in corpus order repeat it entirely: the
   parse alone settles them. Only the first occurrences make up the dictionary.
3. Suffix order. Dictionary phrases that share a trigger string with another phrase can share
   a part. Their bytes are fetched, the phrase suffixes of `width` bytes or more are sorted
   (suffix array with the longest common prefix cut at `width`), and each run of suffixes that
   agree in `width` bytes keeps its first occurrence in corpus order.
4. The windows found to repeat are joined to their documents, as sorted spans.

Groups are spread by the hash of the trigger string, texts by document, each over as many groups as
spark.sql.shuffle.partitions; a task merges what it sends, so one that reads a phrase a
thousand times sends it once. Phrases are identified by two 64-bit hashes, parts by their bytes.

Defined results: a null text is empty; corpus order is (id, CRC-32 of the text, offset), null
ids last; rows alike in id and text are one document and each get its result; texts shorter
than `width` lose nothing. Other columns are kept, but those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisfield.llm.common import NULL_ID, PrefixHash, mix, row_groups, shuffle_partitions, text_buffer

TRIGGER = 40
#: Bytes of text that are parsed together; a longer text is parsed in overlapping parts.
CHUNK = 1 << 20

_PHRASE = np.dtype([("key", "<u8"), ("whole", "<u8"), ("id", "<i8"), ("ver", "<u4"), ("lo", "<u4"), ("more", "u1"), ("at", "u1")])
_SPAN = np.dtype([("id", "<i8"), ("ver", "<u4"), ("lo", "<u4"), ("end", "<u4")])


def parse(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Phrases of the texts in a buffer: first and last window, trigger, hash of the trigger string and of the whole."""
    span, m = width - TRIGGER + 1, len(data) - width + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    sums = PrefixHash(data)
    h = mix(sums.every(TRIGGER))
    # the leftmost least hash of each window: least so far from the left and from the right within blocks of `span`
    blocks = -(-len(h) // span)
    packed = np.full(blocks * span, 2**64 - 1, np.uint64)
    place = np.tile(np.arange(span, dtype=np.uint64), blocks)
    packed[: len(h)] = (h & ~np.uint64(63)) | place[: len(h)]
    grid = packed.reshape(blocks, span)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:m]
    right = np.minimum.accumulate(grid, axis=1).reshape(-1)[span - 1 : span - 1 + m]
    i = np.arange(m)
    in_left = (left & ~np.uint64(63)) <= (right & ~np.uint64(63))
    trigger = np.where(in_left, i // span * span + (left & np.uint64(63)).astype(np.int64), (i + span - 1) // span * span + (right & np.uint64(63)).astype(np.int64))
    inside = np.flatnonzero(i + width <= np.repeat(offsets[1:], np.diff(offsets))[:m])
    t = trigger[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (inside[1:] != inside[:-1] + 1) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    lo, hi, t = inside[first], inside[np.append(first, len(inside))[1:] - 1], t[first]
    whole = mix(sums.spans(lo, hi + width) + (t - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (hi - lo).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return lo, hi, t, h[t], whole


def _phrases(column: pa.Array, ids: np.ndarray, vers: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Records of all phrases of a column of texts, a few MB of text at a time."""
    data, offsets = text_buffer(column)
    for a, b in row_groups(offsets, CHUNK):
        start, end = offsets[a], offsets[b]
        parts = [(start, end)] if end - start <= CHUNK or b - a > 1 else [(s, min(end, s + CHUNK + width - 1)) for s in range(start, max(start + 1, end - width + 1), CHUNK)]
        for s, e in parts:
            own = offsets[a : b + 1] - start if b - a > 1 or len(parts) == 1 else np.array([0, e - s])
            lo, hi, t, key, whole = parse(data[s:e], own, width)
            row = a + np.searchsorted(own, lo, "right") - 1 if b - a > 1 else np.full(len(lo), a)
            out = np.zeros(len(lo), _PHRASE)
            base = offsets[row] - s
            out["key"], out["whole"], out["id"], out["ver"], out["lo"], out["more"], out["at"] = key, whole, ids[row], vers[row], lo - base, hi - lo, t - lo
            yield out


def _firsts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases sorted by content and then corpus order, and the index of each one's first occurrence."""
    p = p[np.lexsort((p["lo"], p["ver"], p["id"], p["whole"], p["key"]))]
    new = np.ones(len(p), bool)
    new[1:] = (p["key"][1:] != p["key"][:-1]) | (p["whole"][1:] != p["whole"][:-1])
    return p, np.flatnonzero(new)[np.cumsum(new) - 1]


def _repeats(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which phrases repeat an earlier one, not themselves (a row that occurs twice)."""
    f = p[first]
    return (f["id"] != p["id"]) | (f["ver"] != p["ver"]) | (f["lo"] != p["lo"])


def _spans(ids: np.ndarray, vers: np.ndarray, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans in corpus order, those that touch within a document joined."""
    out = np.zeros(len(ids), _SPAN)
    out["id"], out["ver"], out["lo"], out["end"] = ids, vers, lo, end
    if len(out) < 2:
        return out
    out = out[np.lexsort((out["lo"], out["ver"], out["id"]))]
    same = np.append(False, (out["id"][1:] == out["id"][:-1]) & (out["ver"][1:] == out["ver"][:-1]))
    document = np.cumsum(~same)
    # the furthest end so far within a document, by adding a step per document that no end exceeds
    reach = np.maximum.accumulate(out["end"].astype(np.int64) + (document << 33)) - (document << 33)
    new = ~same | (out["lo"] > np.append(0, reach[:-1]))
    starts = np.flatnonzero(new)
    joined = out[starts]
    joined["end"] = reach[np.append(starts[1:], len(out)) - 1]
    return joined


def _by(numbers: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(numbers, kind="stable")
    numbers, records = numbers[order], records[order]
    at = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)])
    for a, b in zip(at, np.append(at, len(numbers))[1:], strict=True):
        yield int(numbers[a]), records[a:b]


def _shelf(records: np.ndarray, n: int) -> np.ndarray:
    """The document group of records, as `pmod(id ^ ver, n)` has it in SQL."""
    return np.mod(records["id"] ^ records["ver"].astype(np.int64), n)


def _joined(blobs: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in blobs.to_pylist() if x), kind)


def _parsed(docs: DataFrame, width: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = text_buffer(batch.column("text"))[1]
            for a, b in row_groups(offsets, 8 * CHUNK):
                part = batch.slice(a, b - a)
                found = list(_phrases(part.column("text"), part.column("id").to_numpy(), part.column("ver").to_numpy().astype(np.uint32), width))
                p, first = _firsts(np.concatenate(found) if found else np.zeros(0, _PHRASE))
                again = p[_repeats(p, first)]
                once = p[first == np.arange(len(p))]
                rows = [(k, r.tobytes(), b"") for k, r in _by((once["key"] % np.uint64(n)).astype(np.int64), once)]
                spans = _spans(again["id"], again["ver"], again["lo"], again["lo"] + again["more"].astype(np.uint32) + np.uint32(width))
                rows += [(k, b"", r.tobytes()) for k, r in _by(_shelf(spans, n), spans)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "phrases", "spans"])

    return docs.select("id", "ver", "text").mapInArrow(run, "bucket int, phrases binary, spans binary")


def _settled(parsed: DataFrame, width: int, n: int) -> DataFrame:
    """By document group: spans the parse alone settles, and dictionary phrases whose bytes are needed."""

    def run(table: pa.Table) -> pa.Table:
        p, first = _firsts(_joined(table.column("phrases"), _PHRASE))
        again = p[_repeats(p, first)]
        once = p[first == np.arange(len(p))]
        new = np.append(True, once["key"][1:] != once["key"][:-1])[: len(once)]
        size = np.diff(np.append(np.flatnonzero(new), len(once)))
        wanted = once[np.repeat(size, size) > 1]
        before = _joined(table.column("spans"), _SPAN)
        spans = _spans(*(np.concatenate(x) for x in zip((before["id"], before["ver"], before["lo"], before["end"]), (again["id"], again["ver"], again["lo"], again["lo"] + again["more"].astype(np.uint32) + np.uint32(width)), strict=True)))
        rows = [(k, r.tobytes(), b"") for k, r in _by(_shelf(spans, n), spans)] + [(k, b"", r.tobytes()) for k, r in _by(_shelf(wanted, n), wanted)]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["shelf", "spans", "wanted"])

    return parsed.groupBy("bucket").applyInArrow(run, "shelf int, spans binary, wanted binary")


def _fetched(texts: DataFrame, settled: DataFrame, width: int, n: int) -> DataFrame:
    """The wanted phrases with their bytes, by the bucket of their trigger string."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = _joined(right.column("wanted"), _PHRASE)
        rows = []
        if len(wanted):
            where = {}
            for i, k in enumerate(zip(left.column("id").to_pylist(), left.column("ver").to_pylist(), strict=True)):
                where.setdefault(k, i)
            column, last, text = left.column("text"), None, b""
            wanted = wanted[np.lexsort((wanted["ver"], wanted["id"]))]
            for bucket, some in _by((wanted["key"] % np.uint64(n)).astype(np.int64), wanted):
                pieces = []
                for d, v, lo, more in zip(some["id"].tolist(), some["ver"].tolist(), some["lo"].tolist(), some["more"].tolist(), strict=True):
                    if (d, v) != last:
                        last, text = (d, v), column[where[d, v]].as_py().encode()
                    pieces.append(text[lo : lo + more + width])
                rows.append((bucket, some.tobytes(), b"".join(pieces)))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "phrases", "bytes"])

    return texts.groupBy("shelf").cogroup(settled.groupBy("shelf")).applyInArrow(run, "bucket int, phrases binary, bytes binary")


def _sorted_suffixes(fetched: DataFrame, width: int, n: int) -> DataFrame:
    """Spans of windows that an earlier dictionary phrase also has, by document group."""

    def run(table: pa.Table) -> pa.Table:
        p = _joined(table.column("phrases"), _PHRASE)
        data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        sizes = p["more"].astype(np.int64) + 1
        base = np.concatenate(([0], np.cumsum(sizes + width - 1)))[:-1]
        phrase = np.repeat(np.arange(len(p)), sizes)
        inner = np.arange(len(phrase)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start, lo = base[phrase] + inner, p["lo"][phrase] + inner.astype(np.uint32)
        # suffixes whose first `width` bytes no other has, by hash, need no sorting
        h = PrefixHash(data).spans(start, start + width)
        order = np.argsort(h)
        equal = h[order][1:] == h[order][:-1]
        shared = order[np.append(equal, False) | np.append(False, equal)] if len(h) else order
        shared = shared[np.lexsort((lo[shared], p["ver"][phrase[shared]], p["id"][phrase[shared]]))]
        if len(shared):
            windows = np.lib.stride_tricks.sliding_window_view(data, width)[start[shared]].view(f"S{width}").reshape(-1)
            by_suffix = np.argsort(windows, kind="stable")
            ranked = windows[by_suffix]
            shared = shared[by_suffix[np.flatnonzero(np.append(False, ranked[1:] == ranked[:-1]))]]
        owner = p[phrase[shared]]
        spans = _spans(owner["id"], owner["ver"], lo[shared], lo[shared] + np.uint32(width))
        rows = [(k, r.tobytes()) for k, r in _by(_shelf(spans, n), spans)]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary()))], names=["shelf", "spans"])

    return fetched.groupBy("bucket").applyInArrow(run, "shelf int, spans binary")


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text outside the spans, each widened to the edges of the characters that it cuts."""
    out, at = [], 0
    for start, end in spans:
        while start > 0 and raw[start] & 0xC0 == 0x80:
            start -= 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        out.append(raw[at : max(at, start)])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 100) -> DataFrame:
    """Adds n_bytes, spans (maximal runs of bytes that repeat, start and end), kept (the bytes that remain) and kept_text
    (the same as text: a character that a run cuts goes with the run)."""
    if not TRIGGER < width <= TRIGGER + 60:
        raise ValueError(f"width must be {TRIGGER + 1} to {TRIGGER + 60}")
    n = shuffle_partitions(docs.sparkSession)
    made = ("n_bytes", "spans", "kept", "kept_text")
    kept_columns = [f for f in docs.schema if f.name not in made]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(NULL_ID))).alias("id"), F.crc32(whole.cast("binary")).alias("ver"), whole.alias("text"), F.struct(*(F.col(f"`{f.name}`") for f in kept_columns if f.name != text)).alias("rest"))
    shelves = keyed.withColumn("shelf", F.pmod(F.col("id").bitwiseXOR(F.col("ver")), F.lit(n)).cast("int"))
    settled = _settled(_parsed(keyed, width, n), width, n)
    more = _sorted_suffixes(_fetched(shelves, settled.select("shelf", "wanted"), width, n), width, n)
    found = settled.select("shelf", "spans").union(more)
    rest_type = keyed.schema["rest"].dataType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = _joined(right.column("spans"), _SPAN)
        got = _spans(got["id"], got["ver"], got["lo"], got["end"])
        key = np.append(True, (got["id"][1:] != got["id"][:-1]) | (got["ver"][1:] != got["ver"][:-1]))[: len(got)]
        at = np.flatnonzero(key)
        of = {(int(got["id"][a]), int(got["ver"][a])): (a, b) for a, b in zip(at, np.append(at, len(got))[1:], strict=True)}
        size, spans, kept, kept_text = [], [], [], []
        for d, v, t in zip(left.column("id").to_pylist(), left.column("ver").to_pylist(), left.column("text"), strict=True):
            raw = t.as_py().encode()
            a, b = of.get((d, v), (0, 0))
            own = list(zip(got["lo"][a:b].tolist(), got["end"][a:b].tolist(), strict=True))
            size.append(len(raw))
            spans.append([{"start": s, "end": e} for s, e in own])
            kept.append(b"".join(raw[s:e] for s, e in zip([0, *(e for _, e in own)], [*(s for s, _ in own), len(raw)], strict=True)))
            kept_text.append(_whole_characters(raw, own) if own else t.as_py())
        return pa.table([left.column("rest"), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(kept_text, pa.string()), left.column("text")], names=["rest", "n_bytes", "spans", "kept", "kept_text", "whole"])

    schema = T.StructType([T.StructField("rest", rest_type), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType()), T.StructField("whole", T.StringType())])
    done = shelves.groupBy("shelf").cogroup(found.groupBy("shelf")).applyInArrow(run, schema)
    return done.select(*(F.col("whole").alias(text) if f.name == text else F.col(f"rest.`{f.name}`") for f in kept_columns), *made)
