"""Spelling variants by k-d trees against deletion neighbourhoods."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from axisfield.llm import queries, spelling
from axisfield.llm.common import text_buffer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def table(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_op13(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_kd_spelling(spark, SF).collect()
    assert len(got) == len(table(got)) and table(got) == brute.spelling(docs)


def _noisy(n=400):
    rng = random.Random(3)
    letters = "abcde\u00e9\u00df\u00d7\u00c0"
    base = ["".join(rng.choices(letters, k=rng.randint(5, 12))) for _ in range(n)] + ["abcde" * 30, "edcba" * 30]
    words = []
    for w in base:
        for _ in range(rng.randint(1, 12)):
            k = rng.randrange(len(w))
            words += [rng.choice((w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]))] * rng.randint(1, 4)
    rng.shuffle(words)
    return [(k, " ".join(words[k::40])) for k in range(40)]


def test_leaves_are_split_and_dealt(spark, monkeypatch):
    """Many small leaves, blocks within them, and words of equal letters, which no split tells apart."""
    anagrams = ["".join(random.Random(k).sample("abcdefgh", 8)) for k in range(300)]
    docs = [*_noisy(), (90, " ".join(anagrams * 3)), (91, " ".join(anagrams[:20] * 9))]
    want = brute.spelling(docs)
    for leaf, sample in ((100_000, 10), (40, 500), (4, 100_000)):
        monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
        monkeypatch.setattr(spelling, "SAMPLE_WORDS", sample)
        assert table(spelling.variants(spark.createDataFrame(docs, SCHEMA)).collect()) == want


def test_hostile_rows(spark):
    docs = [(1, None), (None, "Stra\u00dfe stra\u00dfe STRASSE straSSe stra\u00dfe"), (2, ""), (3, "123 \u4e2d\u6587 \u0105\u0107"), (4, "\u00c9cole \u00e9cole ecole \u00c9cole \u00c9COLE")] + [(5, "repeated repeated reepeated")] * 4
    docs += [(6, "x" * 70 + " " + ("x" * 70 + " ") * 3 + ("x" * 71 + " ") * 9), (7, "Word\u00e9word \u00d7\u00f7\u00d7\u00f7\u00d7 \u00d7\u00f7\u00d7\u00f7\u00d7 \u00d7\u00f7\u00d7\u00f7\u00d7")]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA + ", word string, n int")
    for damaged in (97, 2, 0):
        assert table(spelling.variants(df, damaged=damaged).collect()) == brute.spelling(docs, damaged=damaged)
    none = spelling.variants(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_chains_end_at_their_root(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    docs = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)))]
    got = table(spelling.variants(spark.createDataFrame(docs, SCHEMA), damaged=0).collect())
    assert got == brute.spelling(docs, damaged=0) and {v[1] for v in got.values()} == {"bbbbb"}


def test_long_rows_are_taken_in_parts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcd\u00e9", k=rng.randint(3, 9))) for _ in range(3000)), "", "z" * 900 + " tail tails", "\u4e2dabcdef" * 300, None]
    data, offsets = text_buffer(pa.array(texts))
    base = np.array([zlib.crc32(b"%d:" % k) for k in range(len(texts))], np.uint32)
    seen = []
    for step in (1 << 20, 100):
        monkeypatch.setattr(spelling, "STEP", step)
        total = {}
        for part in spelling._parts(data, offsets, base):
            for w, n in zip(*spelling.word_counts(*part), strict=True):
                total[w] = total.get(w, 0) + n
        seen.append(total)
    assert seen[0] == seen[1] and len(seen[0]) > 100


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abz\u00e9\u00f7", min_size=5, max_size=5), min_size=1, max_size=60, unique=True), st.lists(st.text("abz\u00e9\u00f7", min_size=4, max_size=4), min_size=1, max_size=30, unique=True))
def test_near_pairs(stored, shorter):
    rows = lambda words: spelling._letters(pa.array(words), len(words[0]))
    pairs = lambda a: {(int(i), int(j)) for x in spelling.near_pairs(rows(stored), rows(a)) for i, j in zip(*x, strict=True)}
    assert pairs(stored) == {(i, j) for i, a in enumerate(stored) for j, b in enumerate(stored) if sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    assert pairs(shorter) == {(i, j) for i, a in enumerate(shorter) for j, b in enumerate(stored) if any(b[:k] + b[k + 1 :] == a for k in range(5))}


def test_boxes_are_never_nearer_than_their_words():
    rng = np.random.default_rng(2)
    for length in (6, 20, 90):
        letters = rng.integers(97, 103, (400, length)).astype(np.uint8)
        m = spelling.masks(letters, spelling.levels_of(length))
        tree = spelling.Tree(m, 10)
        counts = np.stack([(letters == c).sum(axis=1) for c in range(97, 103)], axis=1)
        apart = np.abs(counts[:, None] - counts[None]).sum(axis=2)
        met = np.zeros((400, 400), bool)
        for leaf, who in tree.reach(m, 2):
            met[np.ix_(who, tree.items[leaf])] = True
        assert met[apart <= 2].all() and not met.all()
        cells = spelling.Tree(m[:100], 10, cells=True)
        own = cells.leaf_of(m)
        seen = {(int(w), leaf) for leaf, who in cells.reach(m, 0) for w in who}
        assert seen == {(k, int(own[k])) for k in range(400)}
