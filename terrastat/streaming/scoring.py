"""Stateless operators on streams: lattice assignment and scoring against a frozen model.

Both keep rows apart from each other, so they run in append mode without state or watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tessellate import hex_cell_of


def stream_square_cells(stream: DataFrame, box, nx: int, ny: int) -> DataFrame:
    """The stream's rows with the row-major ``cell_id`` of an even grid; outside the box: null."""
    x0, x1, y0, y1 = box
    cx = F.greatest(F.lit(0), F.least(F.ceil((F.col("x") - x0) * nx / (x1 - x0)) - 1, F.lit(nx - 1)))
    cy = F.greatest(F.lit(0), F.least(F.ceil((F.col("y") - y0) * ny / (y1 - y0)) - 1, F.lit(ny - 1)))
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    return stream.withColumn("cell_id", F.when(inside, cy * nx + cx + 1).cast("long"))


def stream_hex_cells(stream: DataFrame, box, size: float) -> DataFrame:
    return stream.withColumn("cell_id", hex_cell_of(F.col("x"), F.col("y"), box, size))
