"""Fill-in-middle by piece tables: no text is moved until it is written.

A document becomes descriptors (buffer, start, length) over two immutable buffers: its own UTF-8 bytes and the sentinels'.
Cutting splits a descriptor in two, an arrangement is a permutation of descriptors with sentinels put between, and the
inverse permutation restores the document. Hashes are fed the descriptors' bytes one after another, so that an arranged text need
not exist; `written` makes it where it is wanted, in the JVM.

Tokens are runs of ASCII letters and single other characters; both cuts fall between tokens, and the places are draws from a hash
of (seed, id), so reruns agree. Defined results: a null text is an empty one, which stays plain, as does a text that
holds a sentinel (it could not be told from ours); a null id is drawn as an empty one; equal rows are arranged alike;
extra columns are kept, those named like a result are replaced. A text is one row and takes about ten bytes of memory a byte while its
tokens are looked up; shorter ones go in groups of a megabyte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisfield.llm.common import row_groups, text_buffer

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The buffer of sentinels, and where each starts in it.
SENTINELS = PREFIX + SUFFIX + MIDDLE
PLACES = {PREFIX: 0, SUFFIX: 3, MIDDLE: 6}
TEXT, SENTINEL = 0, 1

#: What follows each sentinel in an arrangement: parts 0, 1, 2 are prefix, middle, suffix.
FORMS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}

PIECES = T.ArrayType(T.StructType([T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
RESULTS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("pieces", PIECES),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output_sha256", T.StringType()),
])

Piece = tuple[int, int, int]


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same text with a border at a byte offset: the descriptor that spans it is split; at either end an empty one arises."""
    out, before = [], 0
    for k, (buffer, start, length) in enumerate(pieces):
        if at <= before + length:
            left = at - before
            return [*out, (buffer, start, left), (buffer, start + left, length - left), *pieces[k + 1 :]]
        out.append((buffer, start, length))
        before += length
    raise ValueError("the cut lies behind the text")


def arranged(parts: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of the form, each behind its sentinel."""
    return [x for mark, k in FORMS[form] for x in ((SENTINEL, PLACES[mark], len(mark)), parts[k])]


def inverse(pieces: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix from an arrangement: sentinels out, the permutation undone."""
    kept = pieces[1::2]
    back = [0] * len(kept)
    for place, (_, k) in enumerate(FORMS[form]):
        back[k] = place
    return [kept[place] for place in back]


def sentinel_cuts(output: bytes, form: str) -> list[Piece]:
    """An output as descriptors over itself, with borders on both sides of each sentinel: no two sentinels can overlap."""
    pieces: list[Piece] = [(TEXT, 0, len(output))]
    at, done = 0, []
    for mark, _ in FORMS[form]:
        start = output.index(mark, at)
        at = start + len(mark)
        done += [start, at]
    for place in done[1:]:
        pieces = cut(pieces, place)
    return pieces


def digest(pieces: list[Piece], buffers: tuple) -> str:
    """SHA-256 of the text that descriptors stand for, fed piece by piece."""
    h = hashlib.sha256()
    for buffer, start, length in pieces:
        h.update(buffers[buffer][start : start + length])
    return h.hexdigest()


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens start, and the number of characters that start before each byte (and at the end)."""
    first = (data & 0xC0) != 0x80
    letter = ((data | 0x20) - np.uint8(97)) < 26
    begins = first.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = True
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=chars[1:])
    return np.flatnonzero(begins), chars


def _table(results: list[tuple]) -> list[pa.Array]:
    """Arrow columns of RESULTS: the descriptors as flat numbers behind offsets."""
    lengths = np.array([len(r[2]) for r in results], np.int64)
    flat = np.array([p for r in results for p in r[2]], np.int64).reshape(-1, 3)
    fields = [pa.field("buffer", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64())]
    struct = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1]), pa.array(flat[:, 2])], fields=fields)
    pieces = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), struct)
    column = lambda k, kind: pa.array([r[k] for r in results], kind)
    return [column(0, pa.int64()), column(1, pa.string()), pieces, column(3, pa.int64()), column(4, pa.int64()), column(5, pa.string())]


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit draws: the first groups of SHA-256 of "seed:key"."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _together(kept: list[T.StructField]) -> Column:
    """Columns of any names as one, which Arrow takes whole."""
    return F.struct(*(F.col(f"`{f.name}`") for f in kept)).alias("__kept")


def with_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Adds token count, form, descriptors, characters of prefix and middle and the output's digest.

    Of a hundred texts about `rate` are rearranged, of these `spm` in a hundred with the suffix first.
    """
    made = RESULTS.names
    kept = [f for f in docs.schema if f.name not in made]
    odd = [f"__draw{k}" for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("__text"))
            for a, b in row_groups(offsets):
                part = data[offsets[a] : offsets[b]]
                own = offsets[a : b + 1] - offsets[a]
                begins, chars = _tokens(part, own)
                h1, h2, h3, h4 = (batch.column(c)[a:b].to_numpy() for c in odd)
                lows, highs = np.searchsorted(begins, own[:-1]), np.searchsorted(begins, own[1:])
                n = highs - lows
                first, last = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
                borders = np.append(begins, len(part))
                # a border behind a text's last token is the text's end
                places = [np.where(k < n, borders[np.minimum(lows + k, len(begins))], own[1:]) for k in (first, last)]
                view, results = memoryview(part.tobytes()), []
                for r in range(b - a):
                    raw = view[own[r] : own[r + 1]]
                    whole = bytes(raw)
                    if not whole or PREFIX in whole or SUFFIX in whole or MIDDLE in whole or h3[r] % 100 >= rate:
                        pieces, form, counts = [(TEXT, 0, len(raw))], "plain", (None, None)
                    else:
                        form = "spm" if h4[r] % 100 < spm else "psm"
                        x, y = (int(p[r]) for p in places)
                        pieces = arranged(cut(cut([(TEXT, 0, len(raw))], x - int(own[r])), y - int(own[r])), form)
                        counts = (int(chars[x] - chars[own[r]]), int(chars[y] - chars[x]))
                    results.append((int(n[r]), form, pieces, *counts, digest(pieces, (raw, SENTINELS))))
                yield pa.RecordBatch.from_arrays([batch.column("__kept")[a:b], *_table(results)], names=["__kept", *made])

    rows = docs.select(_together(kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"), *(c.alias(k) for k, c in zip(odd, draws(F.col(f"`{key}`"), seed), strict=True)))
    return rows.mapInArrow(run, T.StructType([rows.schema["__kept"], *RESULTS])).select("__kept.*", *made)


def written(text: Column, pieces: Column) -> Column:
    """The bytes that descriptors stand for."""
    raw, marks = F.coalesce(text, F.lit("")).cast("binary"), F.lit(SENTINELS)
    # a substring of a binary column takes 32-bit places, which a text's length always fits
    one = lambda p: F.substring(F.when(p["buffer"] == SENTINEL, marks).otherwise(raw), (p["start"] + 1).cast("int"), p["length"].cast("int"))
    return F.array_join(F.transform(pieces, lambda p: one(p).cast("string")), "")


def with_restored(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored_sha256", whole: str | None = None) -> DataFrame:
    """Adds the digest of the text that an output and its form give back, and the text itself under the name `whole` if one is given.

    A null output is an empty one. A form that does not fit its output is an error.
    """
    made = [into, *([whole] if whole else [])]
    kept = [f for f in rows.schema if f.name not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("__output"))
            for a, b in row_groups(offsets):
                hashes, texts = [], []
                for r, shape in zip(range(a, b), batch.column("__form")[a:b].to_pylist(), strict=True):
                    raw = data[offsets[r] : offsets[r + 1]].tobytes()
                    pieces = [(TEXT, 0, len(raw))] if shape == "plain" else inverse(sentinel_cuts(raw, shape), shape)
                    hashes.append(digest(pieces, (raw, SENTINELS)))
                    if whole:
                        texts.append(b"".join(raw[s : s + n] for _, s, n in pieces).decode())
                more = [pa.array(hashes, pa.string()), *([pa.array(texts, pa.string())] if whole else [])]
                yield pa.RecordBatch.from_arrays([batch.column("__kept")[a:b], *more], names=["__kept", *made])

    asked = rows.select(_together(kept), F.col(f"`{output}`").alias("__output"), F.col(f"`{form}`").alias("__form"))
    return asked.mapInArrow(run, T.StructType([asked.schema["__kept"], *(T.StructField(c, T.StringType()) for c in made)])).select("__kept.*", *made)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Adds all of `with_pieces` and the `output` text itself."""
    rows = with_pieces(docs, key, text, **options)
    return rows.withColumn("output", written(F.col(f"`{text}`"), F.col("pieces")))
