"""One query per corpus operator, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import decontam, packing, sharding, simhash, sufdedup, tokenbin, tokens, toxicity, urlrules, vecdedup
from deltaloom.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).drop("text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_records(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sufdedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=51)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", F.col("rest").alias("text"))


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_simhash, op4_url_filters, op5_token_records, op6_decontamination, op7_suffix_dedup, op8_jump_shards, op9_embedding_dedup, op10_packing)}

def _patterns() -> str:
    """The method's patterns as SQL, the longest name first, then by name."""
    tests = {
        **{w: f"regexp_matches(host, '(^|[.-]){w}([.-]|$)')" for w in urlrules.HOST_PARTS},
        **{f"/{w}": f"contains(replace(path, '.', '/') || '/', '/{w}/') and regexp_matches(path, '/{w}([/.]|$)')" for w in urlrules.PATH_STEPS},
        **{f".{w}": f"ends_with(path, '.{w}')" for w in urlrules.PATH_ENDS},
    }
    return " ".join(f"when {tests[n]} then '{n}'" for n in sorted(tests, key=lambda n: (-len(n), n)))


ORACLE_SQL = {
    "op4_url_filters": r"""
with parts as (
  select page_id,
    lower(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)) as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages
), fits as (
  select *,
    case
      when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
      when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/'
    end as rule,
    case {PATTERNS}
    end as word
  from parts
)
select page_id, host, path, rule,
  case when rule in ('example.com/en/', 'net/es/', 'net/fr/') or (rule is null and word is not null) then 'block' else 'allow' end as verdict,
  case when rule is null then word end as pattern
from fits
""".replace("{PATTERNS}", _patterns()),
}
