"""Neighbours of boxes on a page as joins, for tables of boxes without documents around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import below_distance, neighbor_score, right_distance


def _nearest(boxes: DataFrame, distance, most: float, name: str) -> DataFrame:
    """Each box's nearest other of its document by ``distance``, the first of equals.

    Boxes meet through cells of ``most`` on the axis that bounds the reach, so a box is held against
    those of neighbouring cells only, not against its whole document.
    """
    axis = "y0" if name == "below" else "x0"
    far = "y1" if name == "below" else "x1"
    slack = 10.0
    cell = lambda v: F.floor(v / (most + 2 * slack))
    targets = boxes.select("doc_id", "line_idx", F.col("bbox").alias("b")).withColumn("cell", F.explode(F.sequence(cell(F.col(f"b.{far}") - slack), cell(F.col(f"b.{far}") + most))))
    others = boxes.select("doc_id", F.col("line_idx").alias("other_idx"), F.col("bbox").alias("o"), cell(F.col(f"bbox.{axis}")).alias("cell"))
    met = targets.join(others, ["doc_id", "cell"]).filter("line_idx <> other_idx").withColumn("dist", distance(F.col("b"), F.col("o"), most=most)).filter("dist IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("doc_id", "line_idx").orderBy("dist", "other_idx"))
    return met.withColumn("r", first).filter("r = 1").select("doc_id", "line_idx", F.col("other_idx").alias(f"{name}_idx"), "dist", neighbor_score(F.col("dist"), most).alias("score"))


def right_neighbors(boxes: DataFrame, most: float = 600.0) -> DataFrame:
    return _nearest(boxes, right_distance, most, "right")


def below_neighbors(boxes: DataFrame, most: float = 200.0) -> DataFrame:
    return _nearest(boxes, below_distance, most, "below")
