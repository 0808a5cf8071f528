"""The corpus pipeline: five stages from raw documents to digests of encoded texts.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor left it, and applies one operator to
all of docs. Filtering stages keep documents that their operator doesn't reject.

Cases that hold for every stage: a null text counts as empty; a null id is an id like others; repeated rows are
judged one by one (the join keeps one of them); columns of docs beside those of documents go, whatever their names,
as a stage returns the columns of documents; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, jaccard_join, quality_rules, toxicity
from weftline.llm.common import dropped_but, held_out, n_written, ready, table, written
from weftline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go: null, empty and short texts among them. Repeated rows all stay or all go."""
    ready(spark)
    return quality_rules.keep_good(docs.select(*COLUMNS))


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The network learns from docs' own labelled rows; where
    these have but one label, or none, all documents get the share of toxic labels as their score. Null and empty texts stay."""
    ready(spark)
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), ~held_out(5))
    return toxicity.score(docs.select(*COLUMNS), model, score_col="_toxicity").where(F.col("_toxicity") < 0.5).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, of equal ids the first, a null
    id last. Documents without words are groups of their own, and all stay."""
    ready(spark)
    return jaccard_join.keep_one_of_each(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; n_chars follows, and a document of which no word is left goes. A
    document that had no words, and any without such passages, stays as it is, null text and n_chars included."""
    ready(spark)
    cut = decontaminate.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), cut=True)
    hit = F.aggregate("removal_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end_word"] - x["first_word"])
    n_chars = F.when(F.size("removal_spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.where((hit == 0) | (hit < F.col("n_words"))).withColumn("n_chars", n_chars).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: doc_id, n_tokens and digests of the ids and of the decoded text. A null
    text gives no tokens; every row of docs gives a row."""
    ready(spark)
    return bpe.round_trip(docs.select("doc_id", "text"), tokenizer_path(), keep=["doc_id"])


STAGES = [("quality rules", quality), ("toxicity", nontoxic), ("n-gram Jaccard join", distinct), ("benchmark decontamination", decontaminated), ("BPE encoding and decoding", encoded)]

#: Toxicity scores can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted, with the tables its operator wrote, once the next one is there."""
    docs, since = table(spark, sf_dir, "documents"), n_written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
            dropped_but(spark, docs, since)
    return docs
