"""The corpus pipeline: five stages over ``documents``, each one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.

Nulls, empty and repeated texts: a null text has no letter, so language ID
rejects it. Rows that repeat whole are copies: one stays. A null doc_id is
kept like any other. Empty input gives empty output with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import decontaminate, language_id, packing, secret_scan, simhash
from rosterlake.llm.common import Scratch, fold
from rosterlake.llm.queries import table, word_tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """Documents with a new text and its length; what is unchanged keeps its
    stated length."""
    new = docs.withColumn("__new", text)
    length = F.when(F.col("__new").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length("__new").cast("long"))
    return new.withColumn("n_chars", length).withColumn("text", F.col("__new")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go: no language can be named for them. An
    ambiguous one stays with its best guess, and ``lang`` becomes what was
    identified."""
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    found = language_id.identify(docs.select(*COLUMNS), model)
    return found.where(F.col("language.lang") != language_id.UNDETERMINED).withColumn("lang", F.col("language.lang")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of
    smallest doc_id. Rows of that id that differ only in columns other than
    id and text are copies too."""
    scratch = Scratch(spark, "pipeline-simhash")
    marked = simhash.add_fingerprints(docs.select(*COLUMNS), shingle=4).withColumn("__fp", F.col("simhash.fingerprint")).drop("simhash")
    marked = scratch.table(marked, "marked")
    prints = marked.select("doc_id", F.col("__fp").alias("fp"))
    classed = simhash.classes(prints, scratch, max_bits=4)
    # A group's document by (id, fingerprint), null ids last. Ids are reduced to
    # one a fingerprint before fingerprints meet their group.
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")).alias("least"))
    order = F.struct("least.unknown", "least.doc_id", "fp")
    first = least.join(classed, "fp").groupBy("root").agg(F.min(order).alias("first"))
    first = scratch.table(first.select("first.doc_id", "first.fp"), "first")
    on = marked["doc_id"].eqNullSafe(first["doc_id"]) & (marked["__fp"] == first["fp"])
    kept = scratch.table(marked.join(first, on, "left_semi"), "kept")
    # Only rows whose id occurs again are compared whole.
    again = scratch.table(kept.groupBy("doc_id", "__fp").count().where("count > 1").drop("count"), "again")
    same = kept["doc_id"].eqNullSafe(again["doc_id"]) & (kept["__fp"] == again["__fp"])
    repeated = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__fp"])
    return kept.join(again, same, "left_anti").unionByName(repeated).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word that lies in an occurrence of a test window is cut out; a
    document that had a hit and has no word left goes."""
    found = decontaminate.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    left = found.where((F.col("leaks.n_hit") == 0) | (F.col("leaks.n_hit") < F.col("leaks.n_words")))
    flat = left.withColumn("__spans", F.col("leaks.spans"))
    return _with_text(flat, secret_scan.mask("text", "__spans", cover=""))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span is replaced by a mark; the document stays."""
    found = secret_scan.scan(docs.select(*COLUMNS))
    return _with_text(found, secret_scan.mask("text", "spans"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, ids included."""
    return packing.pack_documents(docs, word_tokenizer)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Stages fit models, follow links and tokenize: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's result."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
