"""Named queries of this subpackage: one per operator, over its whole table, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sparkwarden.llm import (chat, hnsw, lexical, line_dedup, merkle, mixing, recompression, resampling, sharding, simhash, tiling,
                             token_files, url_rules)
from sparkwarden.llm.common import fresh, table

c = F.col
SHARDS = 8


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest(rows, rows.where("vec_id % 50 = 0"), 5)


def op3_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op4_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "slot")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh(spark, "tokens")
    files = token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(files, folder)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "text")
    return sharding.sharded(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The contract's rules: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(str(r) for r in URL_RULES) + " as t(host, path, verdict)")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(merkle.manifest(merkle.tampered(table(spark, sf_dir, "documents"))))


def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompression.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(c("text").cast("binary"), 256).alias("kept_sha256"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_hnsw": op2_hnsw,
    "op3_resampling": op3_resampling,
    "op4_tiling": op4_tiling,
    "op5_mixing": op5_mixing,
    "op6_token_files": op6_token_files,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_rules": op9_url_rules,
    "op10_chat": op10_chat,
    "op11_merkle": op11_merkle,
    "op12_recompression": op12_recompression,
    "op13_lexical": op13_lexical,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op5_mixing": mixing.ORACLE,
    "op8_line_dedup": r"""
with cut as (
  select doc_id, row_number() over () as row, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (
  select row, unnest(lines) as line, generate_subscripts(lines, 1) as i from cut),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (select key from keyed where key <> '' group by key having count(distinct row) >= 10),
flagged as (select k.*, c.key is not null as gone from keyed k left join common c on k.key = c.key),
kept as (
  select row, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
         sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
  from flagged group by row)
select doc_id, n_lines, n_dropped, kept_sha256 from cut join kept using (row)
""",
    "op9_url_rules": r"""
with rules(host, path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut as (
  select page_id, row_number() over () as row,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
fits as (
  select c.*, r.host || r.path as rule, r.verdict,
         row_number() over (partition by c.row order by length(r.host) desc nulls last, length(r.path) desc, r.verdict desc) as best
  from cut c left join rules r on (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where best = 1
""",
    "op12_recompression": r"""
with cut as (
  select row_number() over () as row, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
starts as (
  select row, doc_id, unnest(generate_series(1, len(words) - 19)) as i from cut where len(words) >= 20),
windows as (select s.row, s.doc_id, s.i, sha256(array_to_string(words[s.i:s.i + 19], ' ')) as name from starts s join cut using (row)),
ordered as (
  select row, i, (coalesce(doc_id, -9223372036854775808), i) > min((coalesce(doc_id, -9223372036854775808), i)) over (partition by name) as again
  from windows),
gone as (select distinct row, unnest(generate_series(i, i + 19)) as i from ordered where again),
listed as (select row, unnest(words) as word, generate_subscripts(words, 1) as i from cut),
kept as (
  select l.row, count(*) filter (where g.i is not null)::bigint as n_removed,
         coalesce(string_agg(word, ' ' order by l.i) filter (where g.i is null), '') as text
  from listed l left join gone g on g.row = l.row and g.i = l.i group by l.row)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from cut left join kept using (row)
""",
    "op13_lexical": lexical.ORACLE,
}
