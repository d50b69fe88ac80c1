"""The numbered operators against plain versions, on awkward rows."""

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from axisfield.llm import decision_list, html_paths, mixing, nbsvm, ngram_join, ogg, packing, suffix_dedup, token_counts, warc  # noqa: E402
from axisfield.llm.queries import tokenizer  # noqa: E402

LONG = " ".join(f"word{i % 977}x{i}" for i in range(3000))
PASSAGE = "this passage of more than a hundred bytes is found in several of the documents, and only its first place stays as it was. "
TEXTS = [
    (1, LONG), (2, LONG + " and a tail"), (3, None), (4, ""), (5, "one two"), (6, "one  TWO\n"), (7, PASSAGE + "seven ends here"), (8, "eight begins: " + PASSAGE + "é"), (9, PASSAGE * 3),
    (10, "### $$$ " * 30), (11, "a\n\na\na b\n"), (12, "-" * 400), (13, "x" + "-" * 300), (14, "ünï 日本語 " * 20), (5, "one two"), (None, LONG), (16, " \t\r\n "),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", f"s{(d or 0) % 3}" if d != 8 else None, len(t or ""), 1, b"x") for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, kept binary")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_ngram_join(docs, empty):
    got = sorted(map(tuple, ngram_join.link(docs).collect()), key=str)
    assert got == sorted(brute.link(TEXTS), key=str)
    assert ngram_join.link(empty).count() == 0


def test_suffix_dedup(docs, empty):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(rows).collect()}
    want = {d: (n, s, k) for d, n, s, k in brute.repeats([(r.doc_id, r.text) for r in rows.collect()])}
    assert got == want
    twice = suffix_dedup.remove_repeats(docs).where("doc_id = 5").collect()
    assert len(twice) == 2 and all(not r.spans for r in twice)
    gone = suffix_dedup.remove_repeats(docs).where("doc_id is null").first()
    assert gone.kept == b""  # null ids come last, so all of it was there before
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_ogg(docs, spark):
    for payload in (b"", b"a", bytes(range(256)) * 300, b"\xff" * 2304 * 51):
        media = ogg.mux(payload)
        read = ogg.read_pages(media)
        assert not read.bad_pages and not read.skipped
        packets = [ogg.stamped(s["pages"], ogg.codec(s["pages"][0][2][0])[3])[1:] for _, s in sorted(read.streams.items())]
        assert b"".join(p[n][0] for n in range(max(map(len, packets))) for p in packets if n < len(p)) == payload
        assert all(g == sum(len(d) for d, _ in s[: i + 1]) for s in packets for i, (_, g) in enumerate(s))
    media = bytearray(ogg.mux(bytes(200_000)))
    media[70_000] ^= 1
    assert ogg.read_pages(bytes(media)).bad_pages == 1
    out = ogg.demux_samples(ogg.demux(ogg.with_media(docs.withColumn("raw", F.col("text").cast("binary")), "raw")))
    assert {(r.doc_id, bytes(r.samples)) for r in out.collect()} == {(d, (t or "").encode()) for d, t in TEXTS}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    rows = packing.best_fit(packing.pieces(docs, tokenizer("word_bpe_49k.json"), capacity=256), capacity=256, most_open=4).collect()
    plain, of, bins = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for d, t in TEXTS:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            assert any((r.piece, r.start, r.length, r.ids_crc32) == (k, at, len(part), crc) for r in of[d])
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.best_fit(packing.pieces(empty, tokenizer("word_bpe_49k.json"))).count() == 0


def test_token_counts(docs, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    for _ in range(2):  # the second time from the cache
        out = token_counts.with_token_counts(docs, tokenizer("piece_bpe_32k.model"), str(tmp_path / "cache"))
        assert sorted((str(r.doc_id), r.n_tokens) for r in out.collect()) == sorted((str(d), len(model.encode(t or ""))) for d, t in TEXTS)
    stored = docs.sparkSession.read.parquet(str(tmp_path / "cache"))
    assert stored.count() == len({t or "" for _, t in TEXTS})


def test_importance_changes_the_draw(spark):
    """Longer documents are likelier by the factor of their digits; with equal importance they are not."""
    rows = spark.createDataFrame([(i, "a", "w " * (2 if i % 2 else 60)) for i in range(4000)] + [(10_000 + i, "b", "w " * 900) for i in range(100)], "doc_id long, source string, text string")

    def shares(**options):
        out = mixing.mix(rows, weights=(1, 9), share=0.5, **options).where("source = 'a'").groupBy("size").agg(F.avg((F.col("taken") > 0).cast("double")).alias("p"), F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
        assert abs(sum(r.n for r in out) - out[0].t) <= 60
        return {r["size"]: r.p for r in out}

    own, even = shares(), shares(importance=F.lit(1))
    assert own[60] / own[2] == pytest.approx(3.0, rel=0.2) and even[60] / even[2] == pytest.approx(1.0, rel=0.2)


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    goal, taken = {}, defaultdict(int)
    for r in rows:
        assert r.size == len(brute.WORD.findall(r.text or "")) and r.taken in (0, r.size, 2 * r.size)
        goal[r.source] = (r.target, r.source_size)
        taken[r.source] += r.taken
    total = sum(s for _, s in goal.values())
    assert abs(sum(t for t, _ in goal.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-6 for t, s in goal.values())
    assert mixing.mix(empty).count() == 0


def test_statistics(docs):
    def plain(t):
        words = brute.WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(grams) < 2000 else set()
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)

    got = decision_list.with_statistics(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(d), *plain(t)) for d, t in TEXTS)


def test_decision_list(spark):
    clean = [(i, " ".join(f"w{i}a{j}" for j in range(20)), 1) for i in range(60)]
    junk = [(100 + i, " ".join(f"w{i}b{j}###" for j in range(20)), 0) for i in range(60)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, quality int")
    rules = decision_list.learned(decision_list.statistics_of(df), df)
    assert rules
    got = decision_list.with_statistics(df).select("quality", decision_list.verdict(rules).alias("kept")).collect()
    assert all(r.kept == (r.quality == 1) for r in got)
    none = decision_list.learned(decision_list.statistics_of(df.where("false")), df)
    assert none == []


def test_classifier(spark, docs):
    clean = [(i, " ".join(f"good{(i * j) % 17}" for j in range(30)), 1) for i in range(80)]
    junk = [(100 + i, " ".join(f"junk{(i * j) % 17}" for j in range(30)), 0) for i in range(40)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, quality int")
    out = nbsvm.with_scores(df, df).join(df, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == r.quality for r in held)
    assert nbsvm.with_scores(docs, df.where("false")).count() == len(TEXTS)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>home</a></header><nav><ul><li><a href=/a>menu</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do.</div><article><h1>A  title</h1><p>First &amp; foremost, this is the text.<p>Second <b>part</b>,<br>with a break.</article>
<aside>Read this, too.</aside><section class="comments"><p>A comment, with marks.</p></section><form>Name: <input></form><footer>&copy; x</footer></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "no tags &lt; here"), (5, "u", "<p>a<div>b</p></div></span>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_paths.extract(df).collect()}
    assert got[1] == "A title\n\nFirst & foremost, this is the text.\n\nSecond part, with a break."
    assert got[2] == got[3] == "" and got[4] == "no tags < here"


def test_warc(spark):
    df = spark.createDataFrame([("http://a/", PAGE), ("http://b/", "")], "url string, html string")
    source = df.select("url", warc.response_record(F.col("url"), F.col("html"), "2024-01-01T00:00:00Z").alias("record"))
    rows = warc.derive(source).collect()
    assert len(rows) == 4 and all(r.digest_holds for r in rows)
    for r in rows:
        version, fields = warc.headers(bytes(r.record).partition(b"\r\n\r\n")[0])
        fields = dict(fields)
        assert version == "WARC/1.1" and fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Block-Digest"] == warc.digest(bytes(r.block))
        assert int(fields["Content-Length"]) == len(r.block)
    assert warc.derivatives(None) == warc.derivatives(b"WARC/1.1\r\nWARC-Type: request\r\n\r\n") == []
    text = next(bytes(r.block).decode() for r in rows if r.record_type == "conversion" and r.url == "http://a/")
    assert "First & foremost" in text and "var t" not in text


def test_mix_matches_sql(spark):
    import duckdb

    from axisfield.llm import queries

    c = duckdb.connect()
    c.execute("create view documents as from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(c.sql(queries.OP9_SQL).df()[["doc_id", "taken"]].itertuples(index=False, name=None))
    got = sorted((r.doc_id, r.taken) for r in queries.op9_pareto_mix(spark, "/root/testdata/sf0.001").collect())
    assert got == want
