"""Mixing sources to target weights by hash-threshold histograms [native].

Every source is given a target number of words; a document joins the mix when its hash lies below
its source's threshold.  The threshold is found without sorting documents: words are summed by
(source, hash bucket), the bucket in which the budget runs out is located, and only that bucket is
summed again at a finer level.  Whole repeats come first, so a document is taken at most
``max_repeat`` times.  Where copies of one row share the last bucket, which no hash can split, they are
counted off by their places in the written rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, DIGITS = 3, 4


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """``__source, source_size, target`` from ``__source, size`` rows: one row per source, null last.

    Sources in code-point order get the weights in turn.  Targets are min(cap, level * weight) with
    the level at which they sum to all words (water filling): the limit of resharing the excess of
    capped sources by weight.  The table has a row per source, and its global windows one task: made for
    up to some millions of sources.
    """
    by = sizes.groupBy("__source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    by = by.withColumn("__w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long"))
    by = by.withColumn("__cap", F.col("source_size") * max_repeat)
    every = Window.partitionBy(F.lit(1))
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    by = by.withColumns(
        {
            "__all": F.sum("source_size").over(every),
            "__wsum": F.sum("__w").over(every),
            "__capped": F.coalesce(F.sum("__cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__wdone": F.coalesce(F.sum("__w").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    level = (F.col("__all") - F.col("__capped")).cast("double") / (F.col("__wsum") - F.col("__wdone")).cast("double")
    by = by.withColumn("__level", F.when(level * F.col("__w") <= F.col("__cap"), level))
    # past the first source that its share does not fill, levels only fall: the highest valid one holds
    by = by.withColumn("__at", F.max("__level").over(every))
    target = F.least(F.col("__cap").cast("double"), F.coalesce("__at", F.lit(0.0)) * F.col("__w"))
    return by.select("__source", "source_size", target.alias("target"))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(5, 2, 1),
    max_repeat: int = 3,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, repeats, taken, text_hash``.

    ``size`` counts the words of the text (null: 0), ``repeats`` how often the mix takes the row and
    ``taken = size * repeats`` at most ``max_repeat`` sizes.  A source's taken words differ from its
    target by half of one finest bucket at most, that is about one document.

    Null sources form one source, the last.  The hash is that of id and text (null: empty strings), so
    reruns agree.  Rows that repeat both are alike: where the words run out among them, so many of
    them are taken as come nearest, whichever.  Empty texts have size 0, change no sum and follow
    their hash.  A source without words has target 0 and repeats 0.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    rows = materialise(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("__source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text_col).alias("text_hash"),
            F.monotonically_increasing_id().alias("__at"),
            *[F.substring(h, 1 + DIGITS * k, DIGITS).alias(f"__h{k}") for k in range(LEVELS)],
        ),
        "mix-sizes",
    )
    targets = materialise(source_targets(rows, weights, max_repeat), "mix-targets")
    # whole repeats, then the words still wanted
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(0).cast("long")
    bound = targets.withColumn("__base", whole).withColumn("__left", F.col("target") - F.col("__base") * F.col("source_size"))
    # per level: the bucket in which the words run out; deeper levels look at that bucket alone
    for k in range(LEVELS):
        inside = rows.join(
            bound.select(F.col("__source").alias("__s"), *[F.col(f"__b{j}") for j in range(k)]),
            reduce(lambda a, j: a & (F.col(f"__h{j}") == F.col(f"__b{j}")), range(k), F.col("__source").eqNullSafe(F.col("__s"))),
            "left_semi",
        ) if k else rows
        hist = inside.groupBy("__source", f"__h{k}").agg(F.sum("size").alias("__n"), F.count(F.lit(1)).alias("__m"))
        run = Window.partitionBy("__source").orderBy(f"__h{k}")
        hist = hist.select(F.col("__source").alias("__s"), f"__h{k}", "__n", "__m", F.sum("__n").over(run).alias("__cum"))
        at = (
            bound.select("__source", "__left")
            .join(hist, F.col("__source").eqNullSafe(F.col("__s")))
            .where(F.col("__cum") > F.col("__left"))
            .groupBy("__source")
            .agg(F.min(F.struct(f"__h{k}", (F.col("__cum") - F.col("__n")).alias("before"), "__n", "__m")).alias("__e"))
            .select(F.col("__source").alias("__s"), F.col(f"__e.__h{k}").alias(f"__b{k}"), F.col("__e.before").alias("__before"), F.col("__e.__n").alias("__n"), F.col("__e.__m").alias("__m"))
        )
        bound = bound.join(at, F.col("__source").eqNullSafe(F.col("__s")), "left").withColumn(
            "__left", F.col("__left") - F.coalesce("__before", F.lit(0))
        )
        if k == LEVELS - 1:
            # rows of the last bucket to take: those whose words come nearest to the words left
            bound = bound.withColumn("__take", F.floor(F.col("__left") * F.col("__m") / F.col("__n") + 0.5))
            bound = bound.withColumn("__all", F.coalesce(F.col("__take") >= F.col("__m"), F.lit(False)))
        else:
            bound = bound.drop("__m")
        bound = bound.drop("__s", "__before", "__n")
        bound = materialise(bound, f"mix-level{k}")
    bound = bound.withColumnRenamed("__source", "__s")
    h_all = F.concat(*[F.col(f"__h{k}") for k in range(LEVELS)])
    b_all = F.concat(*[F.col(f"__b{k}") for k in range(LEVELS)])
    # a source whose words never run out has no bucket; it then wants less than nothing more
    out = rows.join(bound, F.col("__source").eqNullSafe(F.col("__s")), "left")
    chosen = F.lit(False)
    if bound.where("__take > 0 and __take < __m").limit(1).count():
        out = out.join(_first_copies(rows, bound, b_all, h_all), "__at", "left")
        chosen = F.coalesce("__chosen", F.lit(False))
    extra = F.when(h_all < b_all, 1).when((h_all == b_all) & (F.col("__all") | chosen), 1).otherwise(0)
    repeats = F.least(F.col("__base") + extra, F.lit(max_repeat)).cast("long")
    return out.select(
        "doc_id",
        F.col("__source").alias("source"),
        "size",
        "source_size",
        "target",
        repeats.alias("repeats"),
        (F.col("size") * repeats).alias("taken"),
        "text_hash",
    )


def _first_copies(rows: DataFrame, bound: DataFrame, b_all, h_all) -> DataFrame:
    """``__at, __chosen``: the first ``__take`` rows of each source's last bucket, counted off by partition, so that
    no task sees all of them."""
    part = F.shiftright("__at", 33)
    inside = rows.join(bound.where("__take > 0 and __take < __m"), F.col("__source").eqNullSafe(F.col("__s"))).where(h_all == b_all)
    inside = inside.select("__s", part.alias("__part"), "__at", "__take")
    before = Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = inside.groupBy("__s", "__part").agg(F.count(F.lit(1)).alias("n")).select(F.col("__s").alias("__t"), F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    ranked = inside.withColumn("__rank", F.row_number().over(Window.partitionBy("__s", "__part").orderBy("__at")))
    met = ranked.join(counts, F.col("__s").eqNullSafe(F.col("__t")) & (F.col("__part") == F.col("__p")))
    return met.where("__before + __rank <= __take").select("__at", F.lit(True).alias("__chosen"))
