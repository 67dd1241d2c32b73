"""Line dedup: drop lines that stand in many documents, keeping them in one of these.

Native: DataFrame functions only. Lines are exploded and hashed (two 64-bit hashes of
the normalised line), distinct documents are counted per hash, lines over the threshold
are dropped, and each text is put together again from its kept positions. Only hashes and
positions are shuffled by line, and with a position only lines that a bitmap of the dropped ones
does not rule out; texts move once, by document, and only where a bitmap of the documents that
lose lines does not rule it out.

Defined results: a null or empty text is one empty line. Rows with the same doc_id are one
document for counting, yet each keeps its own text. Null ids are one document below all
others. An empty table gives an empty table. Extra columns stay untouched; only `text` is
replaced, and internal names start with `__ld_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, bitmap, materialize, might_hold, text_or_empty


def lowered(name: str) -> Column:
    """ascii_lower, which makes a string of each character, only for strings that are not ASCII; Spark lowers others by byte."""
    return F.when(F.octet_length(name) == F.length(name), F.lower(name)).otherwise(ascii_lower(F.col(name)))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) with deduplicated text, and n_lines and n_dropped as `__ld_lines`, `__ld_dropped`."""
    text = text_or_empty()
    t1, t2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    occ = (
        docs.select(F.col("doc_id").alias("id"), t1.alias("t1"), t2.alias("t2"), F.split(text, "\n", -1).alias("lines"))
        .select("id", "t1", "t2", F.posexplode("lines").alias("pos", "line"))
        .select("id", "t1", "t2", "pos", F.btrim(F.col("line"), F.lit(WS)).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("id", "t1", "t2", "pos", lowered("line").alias("key"))
        .select("id", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    dups = (
        occ.groupBy("h1", "h2")
        .agg(F.count_distinct("id").alias("n"), F.max(F.col("id").isNull().cast("int")).alias("no_id"), F.max("id").alias("keep"))
        .where(F.col("n") + F.col("no_id") >= min_docs)
        .select("h1", "h2", "keep")
    )
    dups = materialize(dups, "line_dups")
    drops = (
        might_hold(occ, "h1", bitmap(dups, "h1"))
        .where("__maybe")
        .join(dups, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keep")))
        .groupBy("id", "t1", "t2")
        .agg(F.collect_set("pos").alias("gone"))
        .select(F.col("id").alias("__ld_id"), F.col("t1").alias("__ld_t1"), F.col("t2").alias("__ld_t2"), F.col("gone").alias("__ld_gone"))
    )
    drops = materialize(drops, "line_drops")
    marked = might_hold(docs.withColumns({"__ld_k1": t1, "__ld_k2": t2}), "__ld_k1", bitmap(drops, "__ld_t1"))
    some, none = marked.where("__maybe"), marked.where("not __maybe")
    joined = some.join(drops, some["doc_id"].eqNullSafe(drops["__ld_id"]) & (some["__ld_k1"] == drops["__ld_t1"]) & (some["__ld_k2"] == drops["__ld_t2"]), "left")
    joined = joined.select(*[some[c] for c in docs.columns], "__ld_gone").union(none.select(*docs.columns, F.lit(None).cast("array<int>").alias("__ld_gone")))
    n = F.size("__ld_split")  # a column, since a lambda evaluates what it holds for each of its elements
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__ld_gone"))
    rebuilt = F.when(F.col("__ld_gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__ld_split", i)), "\n"))
    return joined.withColumn("__ld_split", F.split(text, "\n", -1)).select(
        *[rebuilt.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        n.cast("long").alias("__ld_lines"),
        F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long").alias("__ld_dropped"),
    )
