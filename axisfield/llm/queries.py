"""The numbered queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.llm import decision_list, html_paths, mixing, nbsvm, ngram_join, ogg, packing, piece_table, spelling, suffix_dedup, token_counts, url_filters, warc
from axisfield.llm.common import documents, shared_folder

WORDS = "[^\\x20\\x09-\\x0D]+"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as response records, and the metadata and conversion records derived from those."""
    html = F.coalesce(F.col("html"), F.lit(""))
    responses = documents(spark, sf_dir, "pages").select("page_id", warc.response_record(F.col("url"), html, "2024-01-01T00:00:00Z").alias("record"))
    out = warc.derive(responses)
    text = F.when(F.col("record_type") == "conversion", F.col("block").cast("string"))
    return out.select("page_id", *(c for c in warc.RECORD.names if c not in ("block", "record")), text.alias("text"), F.sha2("record", 256).alias("record_sha256"))


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as 8-bit samples in an Ogg file, read back through the demultiplexer."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    n = F.octet_length("raw")
    blocks = F.greatest(F.lit(1), F.ceil(n / F.lit(576)).cast("int"))
    padding = F.unhex(F.repeat(F.lit("ff"), blocks * 576 - n))
    samples = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat("raw", padding).alias("samples"))
    media = ogg.with_media(samples, "samples").select("doc_id", "n_bytes", "media")
    read = ogg.demux_samples(ogg.demux(media))
    # everything below is of the bytes that were read back
    return read.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.pieces(documents(spark, sf_dir), tokenizer("word_bpe_49k.json")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(documents(spark, sf_dir))


def op6_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_paths.extract(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decision_list.with_verdicts(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", *decision_list.BASE, "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"))
    # a cache per input, so that every text of a new input is encoded
    cache = posixpath.join(shared_folder(spark), "token-counts", hashlib.sha256(sf_dir.encode()).hexdigest()[:16])
    out = token_counts.with_token_counts(docs, tokenizer("piece_bpe_32k.model"), cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.with_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rearranged by descriptors, and rebuilt from the written output and its form."""
    rows = piece_table.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "pieces")
    return piece_table.with_restored(rows).drop("output")


#: host, path, verdict
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op12_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(documents(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op13_kd_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir).select("doc_id", "text"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, least(cap, (max(level) OVER ()) * weight) AS target FROM levels),
strata AS (
  SELECT s.source, length(bin(size)) AS level, sum(size)::BIGINT AS words, any_value(g.source_size) AS source_size, any_value(g.target) AS target
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source GROUP BY s.source, length(bin(size))),
factors AS (
  SELECT *, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (above ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(level * words) OVER (above ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS factor
  FROM strata WINDOW above AS (PARTITION BY source ORDER BY level DESC)),
copied AS (SELECT *, coalesce(least(2.0::DOUBLE, max(factor) OVER (PARTITION BY source) * level), 0.0) AS copies FROM factors),
parts AS (SELECT *, floor(copies + 1e-12)::BIGINT AS whole FROM copied),
draws AS (SELECT *, copies - whole AS p, greatest(0.0, target - sum(whole * words) OVER (PARTITION BY source)) AS draw FROM parts),
ranked AS (
  SELECT s.doc_id, s.size, d.source_size, d.target, d.whole, d.draw, s.source, CASE WHEN d.p > 1e-12 THEN s.u / (1.0 - s.u) / (d.p / (1.0 - d.p)) END AS rank
  FROM sized s JOIN draws d ON s.source IS NOT DISTINCT FROM d.source AND length(bin(s.size)) = d.level),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle FROM ranked)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN rank IS NOT NULL AND draw > 0 AND middle <= draw THEN 1 ELSE 0 END) AS taken FROM placed
"""


OP11_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(tokens)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle, coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

OP12_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN fits USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc_derivatives, op2_ogg, op3_best_fit_packing, op4_suffix_dedup, op5_ngram_join,
        op6_tag_path_ratios, op7_decision_list, op8_token_counts, op9_pareto_mix, op10_nbsvm,
        op11_piece_table, op12_blocked_bloom, op13_kd_spelling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_pareto_mix": OP9_SQL, "op11_piece_table": OP11_SQL, "op12_blocked_bloom": OP12_SQL}
