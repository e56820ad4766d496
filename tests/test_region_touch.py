"""Regions of a page: areas are shared out only where a token and a region touch."""

import re

from pyspark.sql import functions as F

from foliant.operators import layout


def test_tokens_at_the_edges_of_regions(spark):
    """Boxes that only touch, have no area, or lie within, by two bounds; 0 takes what doesn't touch too, within the bands."""
    boxes = [(0, 0, 10, 10), (10, 0, 20, 10), (0, 10, 10, 20), (10, 10, 10, 10), (2, 2, 8, 8), (0, 0, 14, 10), (30, 0, 40, 10), (5, 5, 5, 9)]
    ts = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit("w").alias("text"), *(F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), b)), F.lit(0.9).alias("confidence")) for i, b in enumerate(boxes)))
    regions = F.array(F.struct(F.lit(0).cast("long").alias("region_id"), *(F.lit(v).alias(c) for c, v in zip(("rx1", "ry1", "rx2", "ry2"), boxes[0]))))
    pages = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_num"), ts.alias("ts"), regions.alias("regions"))
    found = lambda least: [t.pos for t in layout.in_page_regions(pages, least).first().ts]
    assert sorted(found(0.5)) == [0, 3, 4, 5, 7] and sorted(found(0.0)) == list(range(8))


def test_far_tokens_are_told_by_their_heights_first(spark):
    """The plan compares heights before it makes areas."""
    plan = layout.in_page_regions(spark.range(1).selectExpr(
        "id doc_id", "1 page_num", "array(named_struct('pos', 0, 'text', 'w', 'x1', 0, 'y1', 0, 'x2', 1, 'y2', 1, 'confidence', 0.5D)) ts",
        "array(named_struct('region_id', 0L, 'rx1', 0, 'ry1', 0, 'rx2', 1, 'ry2', 1)) regions"))._jdf.queryExecution().analyzed().toString()
    assert re.search(r"\.y1 <= lambda [^.]*\.ry2", plan)
