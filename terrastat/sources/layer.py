"""Point layers: an ordinary DataFrame with ``row_id, x, y`` and a coordinate system known to the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import all_finite
from .crs import NONE, CRS, ensure_projected


@dataclass
class Layer:
    df: DataFrame
    crs: CRS = NONE

    @staticmethod
    def from_xy(df: DataFrame, x: str, y: str, crs: CRS = NONE, row_id: str | None = None, order=None) -> Layer:
        """A layer over any table; without an id column rows are numbered by the declared ``order``."""
        if row_id is None:
            if order is None:
                raise ValueError("rows need an id column, or an order to be numbered by")
            from ..operators.joins import global_rank

            df, row_id = global_rank(df, *order, name="__rank").withColumn("__row_id", F.col("__rank") + 1).drop("__rank"), "__row_id"
        rest = [c for c in df.columns if c not in (x, y, row_id, "row_id", "x", "y")]
        return Layer(df.select(F.col(row_id).alias("row_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *rest), crs)

    def projected(self, target: CRS | None = None) -> Layer:
        return Layer(*ensure_projected(self.df, self.crs, target))


def dedup_points(df: DataFrame, digits: int = 10) -> DataFrame:
    """The first row (by id) of each place, coordinates rounded to ``digits``."""
    order = Window.partitionBy(F.round("x", digits), F.round("y", digits)).orderBy("row_id")
    return df.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def prep_model_data(layer: Layer, response: str | None, predictors: list[str], require_response: bool = True) -> Layer:
    """Project, and drop rows with a missing or non-finite value in any checked column."""
    columns = ([response] if require_response and response else []) + list(predictors)
    missing = [c for c in columns if c not in layer.df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    out = layer.projected()
    return Layer(out.df.where(all_finite(["x", "y", *columns])), out.crs)


def prediction_grid(spark, box, cell_size: float | None = None, n_cells: int = 10_000) -> DataFrame:
    """``row_id, x, y``: centres of whole cells from the lower corner; one centred point along a short axis."""
    x0, x1, y0, y1 = box
    size = cell_size or ((x1 - x0) * (y1 - y0) / n_cells) ** 0.5

    def axis(lo, hi):
        n = int((hi - lo) // size)
        return (max(n, 1), lo + size / 2) if n >= 1 else (1, (lo + hi) / 2)

    (nx, fx), (ny, fy) = axis(x0, x1), axis(y0, y1)
    i = F.col("id")
    return spark.range(nx * ny).select((i + 1).alias("row_id"), (F.lit(fx) + (i % nx) * F.lit(size)).alias("x"), (F.lit(fy) + F.floor(i / nx) * F.lit(size)).alias("y"))
