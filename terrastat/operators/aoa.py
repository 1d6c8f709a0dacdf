"""Area of applicability: dissimilarity of new rows to the training data, in scaled predictor space."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, all_finite
from .dealing import tasks_of
from .joins import _binned, grow_nearest, quantiles

PART = 200_000  # rows of a part of all pairs
CELLS = 1 << 16  # distances made at once


def scaling(train: DataFrame, predictors: list[str], weights: dict | None = None) -> dict[str, tuple[float, float, float]]:
    """(mean, sd, weight) by predictor; near-constant ones are left out, weights have mean 1 over all."""
    row = train.agg(*[f(c).alias(f"{n}_{c}") for c in predictors for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    w = {c: float((weights or {}).get(c, 1.0)) for c in predictors}
    total = sum(w.values())
    return {c: (row[f"m_{c}"], row[f"s_{c}"], w[c] * len(predictors) / total) for c in predictors if (row[f"s_{c}"] or 0) > math.sqrt(EPS)}


def scaled(df: DataFrame, rules: dict, *keep: str) -> DataFrame:
    return df.select(*keep, *[((F.col(c) - m) / s * w).alias(f"z{k}") for k, (c, (m, s, w)) in enumerate(rules.items())])


def mean_pairwise(z: DataFrame, n: int) -> float:
    """Mean distance over all pairs of training rows.

    Quadratic work, dealt evenly: rows are dealt into parts, each two parts (and each part with itself) meet in a task of their own,
    where distances are made in slices of ``CELLS``.  A part has at most ``PART`` rows.
    """
    rows = z.count()
    parts = max(math.ceil(math.sqrt(4 * tasks_of(z.sparkSession))), math.ceil(rows / PART))
    cols = [f"z{k}" for k in range(n)]

    def summed(f):
        alone = bool(f["__alone"].iloc[0])
        low = (f["__p"] == f["__low"]).to_numpy()
        a, b = (np.ascontiguousarray(f.loc[side, cols].to_numpy(float).T) for side in (low, low if alone else ~low))
        return pd.DataFrame({"s": [_summed_distances(a, b) / (2 if alone else 1)]})

    mine = F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int")
    dealt = z.select(mine.alias("__p"), *cols).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    low, high = F.least("__p", "__q"), F.greatest("__p", "__q")
    met = dealt.select((high * (high + 1) / 2 + low).cast("int").alias("__g"), (F.col("__p") == F.col("__q")).alias("__alone"), "__p", low.alias("__low"), *cols)
    pairs = parts * (parts + 1) // 2
    total = met.repartitionById(pairs, "__g").groupBy("__g").applyInPandas(summed, "s double").agg(F.sum("s")).first()[0]
    if not total:
        raise ValueError("all training rows are alike")
    return total / (rows * (rows - 1) / 2)


def _summed_distances(a: np.ndarray, b: np.ndarray) -> float:
    """Of each column of ``a`` to each of ``b``."""
    wide = max(1, min(b.shape[1], CELLS))
    tall = max(1, CELLS // wide)
    rooms, out = np.empty((2, tall * wide)), 0.0
    for i in range(0, a.shape[1], tall):
        for j in range(0, b.shape[1], wide):
            left, right = a[:, i : i + tall, None], b[:, None, j : j + wide]
            d2, d = (r[: left.shape[1] * right.shape[2]].reshape(left.shape[1], -1) for r in rooms)
            d2[:] = 0.0
            for x, y in zip(left, right, strict=True):
                np.subtract(x, y, out=d)
                d2 += np.multiply(d, d, out=d)
            out += float(np.sqrt(d2, out=d2).sum())
    return out


def nearest_in_features(query: DataFrame, data: DataFrame, n: int, condition: Column | None = None) -> DataFrame:
    """``row_id, d``: distance of each query row (alias a) to its nearest data row (alias b) that meets the condition.
    Rows meet in growing bins of their first two features, in whose plane no distance is larger."""
    y = F.col("z1") if n > 1 else F.lit(0.0)
    a = query.select(F.col("row_id").alias("i"), F.col("z0").alias("x"), y.alias("y"), *query.columns)
    b = data.select(F.col("z0").alias("x"), y.alias("y"), *data.columns)
    x0, x1, y0, y1, m = b.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not m:
        return query.select("row_id", F.lit(None).cast("double").alias("d")).limit(0)
    width = max(math.sqrt((x1 - x0) * (y1 - y0) * 8 / m), max(x1 - x0, y1 - y0) * 8 / m, 1e-9)
    d2 = sum((F.pow(F.col(f"a.z{k}") - F.col(f"b.z{k}"), F.lit(2.0)) for k in range(n)), F.lit(0.0))
    found = grow_nearest(a, lambda w: _binned(b, w).drop("x", "y"), F.struct(F.sqrt(d2).alias("d")), width, (x0, x1, y0, y1), condition)
    return found.select(F.col("i").alias("row_id"), F.col("m.d").alias("d"))


def threshold(di: DataFrame, column="di") -> DataFrame:
    """One row: the largest value not above Q3 + 1.5 IQR; the maximum if there is none."""
    low, high = quantiles(di, column, [0.25, 0.75])
    fence = F.lit(None).cast("double") if low is None else F.lit(high + 1.5 * (high - low))
    return di.agg(F.coalesce(F.max(F.when(F.col(column) <= fence, F.col(column))), F.max(column)).alias("threshold"))


def checked_folds(folds, train: DataFrame) -> DataFrame:
    """``row_id, fold`` of fold labels, if each training row has one label, of at least two; else a ValueError.

    ``folds`` is a relation or ``Folds`` without exclusions: rows near a test row would count as its training rows.
    """
    if getattr(folds, "excluded", None) is not None:
        raise ValueError("folds with excluded rows have no plain labels")
    labels = (folds if isinstance(folds, DataFrame) else folds.assignment).select("row_id", "fold")
    if labels.where("fold is null").limit(1).count():
        raise ValueError("folds contain missing labels")
    if labels.select("fold").distinct().limit(2).count() < 2:
        raise ValueError("folds must define at least two non-empty folds")
    if labels.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a row is in more than one fold")
    if labels.join(train.select("row_id"), "row_id", "left_anti").limit(1).count():
        raise ValueError("folds refer to rows that the training data do not have")
    missing = train.select("row_id").join(labels, "row_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} training rows are in no fold")
    return labels


def describe(new: DataFrame, train_di: DataFrame, limit: float) -> str:
    """A few lines on an area of applicability."""
    n, known, inside, most = new.agg(F.count(F.lit(1)), F.count("DI"), F.sum(F.col("AOA").cast("long")), F.max("DI")).first()
    share = f"{100 * (inside or 0) / known:.1f}%" if known else "none"
    top = "none" if most is None else f"{most:.4g}"
    return f"<area of applicability>\nnew rows: {n} ({n - known} without an index)\ninside: {inside or 0} ({share})\nthreshold: {limit:.4g}, largest index: {top}\ntraining rows: {train_di.count()}"


def area_of_applicability(new: DataFrame, train: DataFrame, predictors: list[str], weights: dict | None = None, folds=None, limit: float | None = None):
    """(``row_id, DI, AOA`` of new rows, train ``row_id, di``, threshold).

    Training rows are compared with rows of other folds (``checked_folds``), or with all others.  Rows
    with a missing predictor get null DI and AOA.
    """
    ok = train.where(all_finite(predictors))
    rules = scaling(ok, predictors, weights)
    n = len(rules)
    if not n:
        raise ValueError("no predictor varies")
    tz = scaled(ok, rules, "row_id")
    norm = mean_pairwise(tz, n)
    if folds is not None:
        tz = tz.join(checked_folds(folds, train), "row_id")
    other = "fold" if folds is not None else "row_id"
    train_di = nearest_in_features(tz, tz, n, F.col(f"a.{other}") != F.col(f"b.{other}")).select("row_id", (F.col("d") / norm).alias("di"))
    top = limit if limit is not None else threshold(train_di).first()[0]
    found = nearest_in_features(scaled(new.where(all_finite(predictors)), rules, "row_id"), tz, n).select("row_id", (F.col("d") / norm).alias("DI"))
    out = new.select("row_id").join(found, "row_id", "left").select("row_id", "DI", (F.col("DI") <= top).alias("AOA"))
    return out, train_di, top
