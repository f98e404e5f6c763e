"""A cleaning pipeline over `documents`: each stage reads what its predecessor wrote.

1. toxicity: documents that the classifier rejects go. It learns from the labelled rows that are not held out.
2. ngram_join: of each component of like documents the one with the smallest id stays, each text of it once.
3. substring_dedup: words in passages of 35 words or more that repeat anywhere go; every document stays.
4. decontaminate: documents that hold a benchmark item go.
5. bpe: token ids of what is left, and the text that they decode to (empty for a null text).

Rows that share an id are one document: they go or stay together where a stage decides by id (2), and rows that repeat
id and text become one row there. A row without an id is a document named by its text, whose name comes after the ids,
so that it goes where a like document has one. Documents with null or empty text are kept by every filter; a null text
stays null until the last stage, where it has no ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphkin.llm.bpe import bpe_encode
from glyphkin.llm.common import held_out, stored, table
from glyphkin.llm.decontam import decontaminate
from glyphkin.llm.ngrams import ngram_components
from glyphkin.llm.substring import substring_dedup
from glyphkin.llm.toxicity import score_toxicity, train_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Names of texts without an id lie from here on.
NAMES = 1 << 62


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    model = train_toxicity(docs.filter(~held_out()), labels, lang_col="lang")
    scored = score_toxicity(docs, model, extra=tuple(c for c in COLUMNS if c != "doc_id"))
    return scored.filter(F.col("predicted") == 0).select(COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = F.when(F.length("text") > 0, F.xxhash64("text").bitwiseAND(F.lit(NAMES - 1)).bitwiseOR(F.lit(NAMES)))
    rows = docs.select(COLUMNS).withColumn("__id", F.coalesce("doc_id", made))
    found = ngram_components(rows, "__id")
    others = found.filter(F.col("__id") != F.col("component_id")).select("__id").distinct()
    key = F.sha2(F.col("text").cast("binary"), 256).alias("__key")
    once = rows.filter(F.col("__id").isNotNull()).groupBy("__id", key).agg(F.min(F.struct(COLUMNS)).alias("row")).select("__id", "row.*")
    kept = once.join(others, "__id", "left_anti").select(COLUMNS)
    return kept.unionByName(rows.filter(F.col("__id").isNull()).select(COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = substring_dedup(docs.select(COLUMNS))
    text = F.when(F.col("text").isNotNull(), F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    done = done.withColumn("text", text)
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe_encode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("substring_dedup", substrings),
    ("decontaminate", benchmarks),
    ("bpe", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
