"""Fill-in-middle by descriptors against plain string cutting."""

import hashlib

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axisfield.llm import piece_table as P
from axisfield.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(rows, ids_texts):
    want = sorted(((d, *brute.middle(d, t), t or "") for d, t in ids_texts), key=str)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.whole) for r in rows), key=str)
    assert got == want
    for r in rows:
        assert r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(r.whole)


def test_hostile_texts(spark):
    texts = ["", None, "a", " ", "<", "one two three", "über naïve – 漢字 🙂 e\u0301", "x <P> y", "<S", "a<S", "M>" * 5, "\n\n\t\r", "word" * 2000, "<P" * 50, "é" * 999, "a\0b"]
    rows = [(k, t) for k, t in enumerate(texts * 12)] + [(None, "null id"), (None, None), (3, "twice the same"), (3, "twice the same")]
    out = P.with_restored(P.fill_in_middle(spark.createDataFrame(rows, SCHEMA)), whole="whole").collect()
    check(out, rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_long_text_and_many_pieces(spark):
    rows = [(k, ("some words, " * 200_000) + str(k)) for k in range(3)] + [(k, "é" * 1_500_000) for k in range(3, 5)]
    out = P.with_restored(P.fill_in_middle(spark.createDataFrame(rows, SCHEMA)), whole="whole").collect()
    check(out, rows)


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "some text", "mine", [1])], SCHEMA + ", form string, `n.x` array<int>")
    out = P.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "n.x", *P.RESULTS.names, "output"] and out.count() == 1 and out.first().form in ("plain", "psm", "spm")
    none = P.with_restored(P.fill_in_middle(spark.createDataFrame([], SCHEMA)))
    assert none.count() == 0 and "restored_sha256" in none.columns


def test_forms_that_do_not_fit(spark):
    with pytest.raises(Exception, match="subsection not found|ValueError"):
        P.with_restored(spark.createDataFrame([("no sentinel", "psm")], "output string, form string")).collect()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(sorted(P.FORMS)))
def test_pieces_go_and_come_back(raw, a, b, form):
    a, b = sorted((min(a, len(raw)), min(b, len(raw))))
    parts = P.cut(P.cut([(P.TEXT, 0, len(raw))], a), b)
    assert sum(n for _, _, n in parts) == len(raw) and len(parts) == 3
    order = P.arranged(parts, form)
    assert P.inverse(order, form) == parts and P.digest(parts, (raw, P.SENTINELS)) == hashlib.sha256(raw).hexdigest()
    output = b"".join((raw, P.SENTINELS)[k][s : s + n] for k, s, n in order)
    if not any(m in raw for m in P.PLACES):
        back = P.inverse(P.sentinel_cuts(output, form), form)
        assert b"".join(output[s : s + n] for _, s, n in back) == raw


def test_op11(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_piece_table(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, output = brute.middle(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(output), sha(texts[r.doc_id] or ""))
