"""Line-level deduplication that returns keep bitmaps, not text [native].

Each line becomes a narrow row of hashes, its document and its position.  Those rows are dealt out by ranges of
(hash, document) and sorted by position, so a line that a third of all documents share is spread over many tasks; each
task streams its runs and passes on one row per document and line, the first occurrence, and one partial count per line.
What comes back to a document is the run-length code of its keep bitmap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, materialise

BLANKS = " \t\x0b\x0c\r"  # and \n, which no line holds
BROADCAST_LINES = 500_000  # repeated lines (a hash of 12 bytes each) that are broadcast at most; beyond it they are shuffled


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_bitmaps(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
) -> DataFrame:
    """``doc_id, text_hash, n_lines, n_dropped, kept`` for each document that loses lines.

    ``kept`` is the document's keep bitmap as runs: ``array<struct<first: int, n: int>>``, lines ``first`` to
    ``first + n - 1``, counted from 0.  A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least ``min_chars`` characters in at least ``min_docs`` documents are repeated: with ``keep="none"`` all
    their lines go, with ``keep="first"`` the first line in order of document and position stays.

    A document is what has one id and one text: rows that repeat both count once and share their bitmap, rows that
    share an id alone are documents of their own.  Null texts count as empty, one empty line; null ids are an id.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep}")
    doc, key = ["doc_id", "text_hash"], ["hash", "check"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), _lines(F.col(text_col)).alias("lines"))
    line = split.select(*doc, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    line = line.select(*doc, "n_lines", "pos", lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.char_length("key") >= max(min_chars, 0))
    # 96 bits: a line of one of few repeated keys is as good as never taken for another
    rows = materialise(line.select(*doc, "n_lines", "pos", F.xxhash64("key").alias("hash"), F.hash("key").alias("check")), "line-hashes")
    ordered = rows.repartitionByRange(*key, *doc).sortWithinPartitions(*key, *doc, "pos")
    firsts = ordered.groupBy(*key, *doc).agg(F.min("pos").alias("pos"))  # of each document, in place: no shuffle
    place = F.struct(F.col("doc_id").isNotNull().alias("set"), *doc, "pos")
    repeated = firsts.groupBy(*key).agg(F.count(F.lit(1)).alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= min_docs)
    repeated = materialise(repeated.drop("docs") if keep == "first" else repeated.select(*key), "repeated-lines")
    few = repeated.count() <= BROADCAST_LINES
    met = rows.join(F.broadcast(repeated) if few else repeated, key, "inner")
    if keep == "first":
        met = met.where(~(place == F.col("first")))
    lost = met.groupBy(*doc).agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("lost"))
    ends = F.concat(F.array(F.lit(-1)), F.col("lost"), F.array(F.col("n_lines")))
    lost = lost.withColumn("ends", ends)
    runs = F.transform(F.sequence(F.lit(1), F.size("lost") + 1), lambda i: F.struct((F.get("ends", i - 1) + 1).alias("first"), (F.get("ends", i) - F.get("ends", i - 1) - 1).alias("n")))
    return lost.select(*doc, F.col("n_lines").cast("long"), F.size("lost").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["n"] > 0).alias("kept"))


def kept_lines(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` as ``doc_id, n_lines, n_dropped, text``: the text without the lines that ``bitmaps`` drop.

    Documents without a bitmap keep their text; one whose lines all go is empty.  Rows are matched by id and text hash,
    null ids with null ids; null texts come back empty.  Bitmaps that grow with the input are not broadcast: Spark
    decides by the size of their written table.
    """
    bitmaps = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n_dropped", "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    met = rows.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    lines = met.withColumn("__lines", _lines(F.col("text")))
    cut = F.array_join(F.flatten(F.transform("kept", lambda r: F.slice("__lines", r["first"] + 1, r["n"]))), "\n")
    return lines.select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(cut).alias("text"),
    )
