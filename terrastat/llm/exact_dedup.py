"""Exact deduplication by progressive refinement [native].

Rows are grouped by length; rows whose length is shared, by the hash of a short prefix; rows that share
both, by full hash.  Texts are read once where every digest is wanted (narrow rows are written and
refined), and once more, by the last survivors alone, where not.  No text is shuffled; hot groups are
aggregated before the shuffle and joined back by joins that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, materialise


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; the row with the largest id stays.
    ``text_sha256`` is the digest of the normalised text: null for rows that an earlier level already
    showed to be unique, unless ``digest_all``.

    Null texts count as empty.  A null id is never preferred over another; a group of null ids only
    keeps one null ``keep_id`` and ``kept`` is true for its rows.  Rows that repeat both id and text
    all count in ``group_size`` and, holding the largest id, are all marked kept.  Other columns of
    ``df`` are ignored, whatever their names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.sha2(lower_ascii(F.col("__text")).cast("binary"), 256)
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("__text"), F.char_length(text).alias("__len"), F.substring(text, 1, prefix_chars).alias("__head"))
    narrow = rows.withColumn("__sha", full) if digest_all else rows
    narrow = materialise(narrow.drop("__text"), "dedup-rows")
    prefix = F.xxhash64(lower_ascii(F.col("__head")))
    # level 1: lengths; level 2: prefixes of the rows whose length is shared
    lengths = materialise(narrow.groupBy("__len").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__len"), "shared-lengths")
    by_prefix = narrow.join(lengths, "__len", "left_semi").groupBy("__len", prefix.alias("__pre")).agg(F.count(F.lit(1)).alias("__n"))
    shared = by_prefix.where("__n > 1").select("__len", "__pre", F.lit(True).alias("__shared"))
    if not digest_all:
        narrow = rows
    met = narrow.withColumn("__pre", prefix).drop("__head").join(shared, ["__len", "__pre"], "left")
    if digest_all:
        met = met.withColumn("__full", F.when(F.col("__shared"), F.col("__sha")))
    else:
        met = met.withColumn("__full", F.when(F.col("__shared"), full)).withColumn("__sha", F.col("__full")).drop("__text")
    # level 3: the full hash, for survivors only
    groups = (
        met.where(F.col("__full").isNotNull())
        .groupBy(F.col("__full").alias("__key"))
        .agg(F.max("doc_id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
        .where("__size > 1")
    )
    # written first, the groups meet the rows in a plain join, whose hot keys AQE splits; rows that are
    # unique already are spread by their prefix hash instead of meeting under the null key
    groups = materialise(groups, "copy-groups")
    met = met.withColumn("__at", F.coalesce("__full", F.col("__pre").cast("string")))
    out = met.join(groups, F.col("__at") == F.col("__key"), "left")
    keep = F.when(F.col("__key").isNull(), F.col("doc_id")).otherwise(F.col("__keep"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )

