"""From documents to packed batches: quality rules, toxicity, line dedup, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written
as Parquet and read again as the next one's docs. All but the last return the columns of docs.
The two filters decide row by row: rows that share an id, or have none, stay or go by their own
text, and columns of docs named like a stage's own keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odata_spark.llm import line_dedup, ngram_join, packing, quality, toxicity
from odata_spark.llm.common import bitmap, materialize, might_hold, read, remove, scratch, write


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A verdict hangs on the text alone. So the votes are written with two hashes of the text, not with the text,
    and only rows that a bitmap of the rejected texts does not rule out meet these in a join.
    """
    keys = {"__key1": F.xxhash64("text"), "__key2": F.xxhash64(F.lit(1), "text")}
    feats = quality.features(docs.select("text").withColumns(keys))
    feats = materialize(feats.select(*keys, "n_words", "n_repeat_words", *quality.VOTES), "quality")
    gone = materialize(quality.verdict(feats, quality.fit(feats)).where("not kept").select(*keys).distinct(), "rejected")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *[key.alias(name) for name, key in keys.items()])
    marked = might_hold(rows, "__key1", materialize(bitmap(gone, "__key1"), "rejected_bits"))
    spared = marked.where("__maybe").join(gone, [*keys], "left_anti")
    return marked.where("not __maybe").select("__row.*").union(spared.select("__row.*"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go."""
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, names=("__score", "__predicted")).where("__predicted = 0").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one of them."""
    return line_dedup.line_dedup(docs).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: length bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", near_stage), ("packing", packing_stage)]

#: EM, a trained classifier and randomised runs are not SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's intermediate tables go when it is written, and its input when the next one is."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = write(stage(spark, docs, sf_dir), name)
        remove(spark, before)
        before = [path]
    return docs
