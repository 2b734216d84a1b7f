"""The registered queries of the training-data operators.

Each query applies its operator, with production parameters, to the whole
table and derives the contract's digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import (decontaminate, embedding_dedup, filter_audit, html_extract, language_id, oracles, packing, quality, resampling, secret_scan,
                            simhash, suffix_dedup, token_output, toxicity)
from rosterlake.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.col("leaks.items").cast("array<string>"))
    return found.select(
        "doc_id", "leaks.n_words", "leaks.n_hit", F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("leaks.n_hit") > 0).alias("contaminated"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.ambiguous")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.labelled(docs.where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "toxicity.score", "toxicity.predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = token_output.round_trip(table(spark, sf_dir, "documents"), byte_tokenizer)
    return ids.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, audit = embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.select("*", F.lit(audit["found"]).cast("long").alias("audit_found"), F.lit(audit["true"]).cast("long").alias("audit_true"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only the arrays leave the scan of the texts.
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = [F.size(secret_scan.of_kind("found", k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *count, F.sha2(secret_scan.joined(F.col("found")).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "main.text", "main.n_chars")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # A merge join at every size: labels need not fit anywhere as a whole.
    model = quality.train(docs.join(labels.hint("merge"), "doc_id"))
    return quality.assess(docs, model).select("doc_id", "quality.*")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_token_output": op6_token_output,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_html_extract": op9_html_extract,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_target_resampling": op12_target_resampling,
    "op13_filter_audit": op13_filter_audit,
}
#: DuckDB SQL over whole tables. The others fit models, follow links, hash by
#: XXH64, tokenize or parse trees.
SQL: dict[str, str] = {
    "op1_decontaminate": f"""
with d as (select row_number() over () as r, doc_id, {oracles.WORDS} as ws from documents),
i as (select item_id, {oracles.WORDS} as ws from benchmark),
iw as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') as p
       from i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as t(k) where len(ws) > 0),
lengths as (select distinct n from iw),
dw as (select r, k, n, array_to_string(ws[k : k + n - 1], ' ') as p from d, lengths, unnest(range(1, len(ws) - n + 2)) as t(k)),
m as (select dw.r, dw.k, dw.n, iw.item_id from dw join iw on iw.n = dw.n and iw.p = dw.p),
hits as (select r, count(distinct pos) as n_hit from (select r, unnest(range(k, k + n)) as pos from m) q group by r),
named as (select distinct r, cast(item_id as varchar) as item from m where item_id is not null),
items as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as h from named group by r)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(hits.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(items.n_items, 0) as bigint) as n_items, coalesce(items.h, sha256('')) as items_sha256,
       coalesce(hits.n_hit, 0) > 0 as contaminated
from d left join hits on hits.r = d.r left join items on items.r = d.r""",
    "op12_target_resampling": oracles.RESAMPLE,
    "op13_filter_audit": oracles.FILTER_AUDIT,
}
