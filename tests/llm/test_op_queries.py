"""Each numbered query over the whole smallest tables, against plain versions."""

import hashlib
import html
import re
import zlib

import brute
import pytest

from axisfield.llm import html_paths, queries, warc
from axisfield.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_op1(spark, pages):
    rows = queries.op1_warc_derivatives(spark, SF).collect()
    assert len(rows) == 2 * len(pages) and all(r.digest_holds for r in rows)
    for r in rows:
        assert r.target_uri == pages[r.page_id].url and r.refers_to.startswith("<urn:uuid:")
        if r.record_type == "conversion":
            assert r.text == warc.plain_text(pages[r.page_id].html) and r.content_length == len(r.text.encode()) and r.block_digest == warc.digest(r.text.encode())


def test_op2(spark, texts):
    rows = queries.op2_ogg(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_op4(spark, texts):
    want = {d: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in brute.repeats(list(texts.items()))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, SF).collect()}
    assert got == want


def test_op5(spark, texts):
    assert sorted(map(tuple, queries.op5_ngram_join(spark, SF).collect())) == sorted(brute.link(list(texts.items())))


def test_op6(spark, pages):
    """Against the article of these pages, cut out by patterns that know their form."""
    want = {}
    for k, p in pages.items():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", re.sub(r"<!--.*?-->", "", p.html, flags=re.S), re.S)[1]
        body = re.sub(r"</?(?:b|i|em|strong|a|span|code)\b[^>]*>", "", body.replace("<br>", " "))
        text = "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", body)) if t)
        want[k] = (p.url, text, len(text))
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op6_tag_path_ratios(spark, SF).collect()} == want


def test_op7(spark, texts):
    for r in queries.op7_decision_list(spark, SF).collect():
        words = brute.WORD.findall(texts[r.doc_id] or "")
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen, twice = set(), set()
        for g in grams:
            (twice if g in seen else seen).add(g)
        repeated = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)}
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(repeated), failed) and not (failed and r.kept)


def test_op8(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    for r in queries.op8_token_counts(spark, SF).collect():
        n = len(model.encode(texts[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 4096)


def test_op10(spark, texts):
    rows = queries.op10_nbsvm(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    order = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert order > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_links_of_large_groups(spark):
    """A large group of exact copies, one of near copies around an original, and documents that share most of a passage but do not link."""
    from axisfield.llm import ngram_join

    base = [f"b{k}" for k in range(80)]
    rows = [(k, "the same text in all of these rows, word for word") for k in range(300)]
    rows += [(1000 + k, " ".join([*base[: k % 70], f"own{k}", *base[k % 70 + 1 :]])) for k in range(300)]
    rows += [(2000 + k, " ".join([*(f"p{j}" for j in range(40)), *(f"tail{k}x{j}" for j in range(16))])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.link(df).collect())) == sorted(brute.link(rows))


def test_slopes_of_the_margin_model():
    """The descent reaches the least of its objective, to what random moves of the weights can show."""
    import numpy as np

    from axisfield.llm import nbsvm

    draw = np.random.default_rng(3)
    ratios = draw.standard_normal(30)
    rows = [np.unique(draw.integers(0, 30, 8)) for _ in range(60)]
    y = np.where([ratios[r].sum() + draw.standard_normal() * 0.5 > 0 for r in rows], 1.0, -1.0)
    w, bias = nbsvm.descend(rows, y, ratios, c=1.0, epochs=400)
    most = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def cost(w, bias):
        margins = np.array([w[r] @ (ratios[r] / (np.sqrt(ratios[r] @ ratios[r]) + 1e-12)) + bias for r in rows])
        return (w @ w + bias * bias) / 2 + (most * np.maximum(0, 1 - y * margins)).sum()

    least = cost(w, bias)
    assert all(cost(w + 0.05 * draw.standard_normal(30), bias + 0.05 * draw.standard_normal()) >= least - 1e-6 for _ in range(200))


def test_awkward_tables(spark):
    """Empty tables, clashing and extra columns, nulls, repeated rows."""
    from pyspark.sql import functions as F

    from axisfield.llm import decision_list, mixing, nbsvm, ngram_join, ogg, packing, suffix_dedup, token_counts

    rows = [(1, "one two three four five six seven eight nine ten eleven", "a", b"x", 7, True), (1, "one two three four five six seven eight nine ten eleven", "a", b"x", 7, True), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept binary, n_tokens long, spans boolean")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    pages = spark.createDataFrame([(1, "u", "<p>one</p>", "x"), (1, "u", "<p>one</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    made = {
        "dedup": lambda d: suffix_dedup.remove_repeats(d), "link": ngram_join.link, "mix": mixing.mix, "rules": lambda d: decision_list.with_verdicts(d, labels), "scores": lambda d: nbsvm.with_scores(d, labels),
        "pack": lambda d: packing.best_fit(packing.pieces(d, tokenizer("word_bpe_49k.json"))), "ogg": lambda d: ogg.demux(ogg.with_media(d, "kept")),
    }
    for name, make in made.items():
        assert make(docs).count() == 3, name
        assert make(docs.where("false")).count() == 0, name
    for make in (html_paths.extract, lambda d: warc.derive(d.withColumn("record", warc.response_record(F.col("url"), F.coalesce("html", F.lit("")), "2024-01-01T00:00:00Z")))):
        assert make(pages).count() in (3, 6) and make(pages.where("false")).count() == 0
