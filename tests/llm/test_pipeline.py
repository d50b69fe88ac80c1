"""The five stages on small fixtures against plain versions, and on awkward rows."""

import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from axisfield.llm import decision_list, packing, queries
from axisfield.llm.queries import tokenizer

PASSAGE = "a passage of well over one hundred bytes, which stands in several of the documents of this small corpus: \u00e9\u00e8\u65e5\u672c. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = []
    for i in range(60):
        text = " ".join(f"w{(i * 7 + j) % 911}x{j}" for j in range(30 + i % 7))
        text = text + " " + PASSAGE + "end" if i % 9 == 0 else text
        out.append((i, text, "en", f"s{i % 3}" if i % 5 else None, len(text)))
    out += [(100 + i, out[i][1], "en", "s0", 1) for i in range(0, 20, 2)]  # exact copies
    out += [(200 + i, out[i][1] + " tail", "en", "s1", 1) for i in range(1, 10, 3)]  # near copies
    out += [(300 + i, "### $$$ %%% " * 12, "en", "s2", 1) for i in range(8)] + [(400, None, "en", "s0", None), (401, "", None, None, 0), (None, "null ids have words and more of them than ten in all here yes", "en", "s0", 9), (5, out[5][1], "en", "s0", 3)]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    labels = [(i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(8)] + [(7, 0, 0), (None, 1, 0), (9, None, 0)]
    import pyarrow.parquet as pq

    pq.write_table(pa.table({k: pa.array([r[n] for r in rows()], t) for n, (k, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())))}), folder / "documents.parquet")
    pq.write_table(pa.table({k: pa.array([r[n] for r in labels], pa.int64()) for n, k in enumerate(("doc_id", "quality", "toxic"))}), folder / "labels.parquet")
    return str(folder)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    # quality rules: the base rule and the learned conditions, row by row
    stats = decision_list.statistics_of(docs)
    rules = decision_list.learned(stats, spark.read.parquet(f"{sf}/labels.parquet"))
    of = {(r.doc_id, r.version): r for r in stats.collect()}
    versions = {(r.doc_id, r.text): r.version for r in docs.withColumn("version", decision_list.version(docs.text)).collect()}

    def passes(r):
        s = of[r[0], versions[r[0], r[1]]]
        assert s.base_failed == (s.n_words < 10 or 100 * s.n_repeat_words > 20 * s.n_words)
        return not s.base_failed and not any(all((s[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)

    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    want = [r for r in map(tuple, rows()) if passes(r)]
    same(kept.collect(), want)
    assert 40 < len(want) < len(rows()) and not any(r[0] and 300 <= r[0] < 402 for r in want)

    # near duplicates: one row of each group's least id
    docs = spark.createDataFrame(want, SCHEMA)
    least = {(d, t): c for (d, t), (_, _, c) in zip([r[:2] for r in want], brute.link([r[:2] for r in want]), strict=True)}
    want = list({r[:2]: r for r in want if least[r[:2]] == r[0]}.values())
    near = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert Counter(r[:2] for r in map(tuple, near)) == Counter(r[:2] for r in want) and len(near) < docs.count()

    # repeated passages: the bytes that stay, without cut characters
    want = [tuple(r) for r in near]
    docs = spark.createDataFrame(want, SCHEMA)
    null_last = [r if r[0] is not None else (2**62, *r[1:]) for r in want]
    plain = {d: b for d, _, _, b in brute.repeats([r[:2] for r in null_last])}
    out = corpus_pipeline.repeated_passages(spark, docs, sf).collect()
    cut = 0
    for r in out:
        left = plain[2**62 if r.doc_id is None else r.doc_id]
        assert r.text == left.decode("utf-8", "ignore") and r.n_chars == len(r.text) and "\ufffd" not in r.text
        cut += PASSAGE not in r.text
    assert len(out) == len(want) and cut

    # source mix: each row as often as SQL says
    want = [tuple(r) for r in out]
    docs = spark.createDataFrame(want, SCHEMA)
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r[0] for r in want], pa.int64()), "source": [r[3] for r in want], "text": [r[1] for r in want]}))
    copies = {d: t // n if n else 0 for d, n, _, _, t in c.execute(queries.OP9_SQL).fetchall()}
    same(corpus_pipeline.source_mix(spark, docs, sf).collect(), [r for r in want for _ in range(copies[r[0]])])

    # packing: each document's pieces, placed without gaps
    want = [r for r in want for _ in range(copies[r[0]])]
    from tokenizers import Tokenizer

    model, expected, placed = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), Counter(), defaultdict(list)
    for r in want:
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[r[0], k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got = corpus_pipeline.packed(spark, spark.createDataFrame(want, SCHEMA), sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_run_applies_all_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "packed"]
    assert not any(r.doc_id and (100 <= r.doc_id < 200 or 300 <= r.doc_id < 402) for r in out)


def test_stages_on_empty_tables(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], SCHEMA), sf)
        assert out.count() == 0, name


def test_packing_fills_nearly_all(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.best_fit(packing.pieces(docs, tokenizer("word_bpe_49k.json"))).collect()
    assert len({r.sequence_id for r in got}) <= 1.1 * sum(r.length for r in got) / 2048 + 1
