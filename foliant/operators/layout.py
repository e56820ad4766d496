"""Reading order, lines, columns, cells and regions."""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import scalars

PAGE = ("doc_id", "page_num")


def gathered(tokens: DataFrame, *columns: str) -> DataFrame:
    """Pages with their tokens as the array `ts`: as they are if they have one (tables.token_pages), else by one shuffle of these columns."""
    return tokens if "ts" in tokens.columns else tokens.groupBy(*PAGE).agg(F.collect_list(F.struct(*columns)).alias("ts"))


def _fields(ts: Column | str, *names: str) -> Column:
    """An array of structs with these fields, sorted by them."""
    return F.sort_array(F.transform(ts, lambda t: F.struct(*(t[n].alias(n) for n in names))))


def page_text(tokens: DataFrame) -> DataFrame:
    """The words of each page in their order."""
    ordered = _fields("ts", "pos", "text")
    return gathered(tokens, "pos", "text").select(*PAGE, F.array_join(F.transform(ordered, lambda t: t.text), " ").alias("page_text"))


def document_text(tokens: DataFrame) -> DataFrame:
    """Pages in order, a space between them."""
    ordered = F.sort_array(F.collect_list(F.struct("page_num", "page_text")))
    return page_text(tokens).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p.page_text), " ").alias("document_text"))


def reading_order(tokens: DataFrame) -> DataFrame:
    """`rank` on the page by (y1, x1), ties by pos."""
    if "ts" in tokens.columns:
        known = [f.name for f in tokens.schema["ts"].dataType.elementType.fields]
        first = ["y1", "x1", "pos"]
        ranked = tokens.select(*PAGE, F.posexplode(_fields("ts", *first, *(c for c in known if c not in first))).alias("i", "t"))
        return ranked.select(*PAGE, *(F.col("t")[c].alias(c) for c in known), (F.col("i") + 1).cast("long").alias("rank"))
    return tokens.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y1", "x1", "pos")).cast("long"))


def merged_engines(*engines: DataFrame) -> DataFrame:
    """Tokens of equal page, text and box: the most confident one, the first engine's on a tie. One aggregation."""
    every = [e.withColumn("engine", F.lit(i + 1)) for i, e in enumerate(engines)]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return best_of_engines(out)


def best_of_engines(tokens: DataFrame) -> DataFrame:
    """Of tokens of several engines (column engine) that agree in page, text and box, the most confident one, the first engine's on a tie."""
    if "ts" in tokens.columns:
        # Equal tokens come to stand together, the best one last: it stays if the next one differs. Numbers are compared before texts.
        same = ("y1", "x1", "x2", "y2", "text")
        ordered = F.sort_array(F.transform("ts", lambda t: F.struct(*(t[c].alias(c) for c in same), t.confidence.alias("confidence"), (-t.engine).alias("first"), t.pos.alias("pos"))))

        def last(ts: Column) -> Column:
            def differs(t: Column, i: Column) -> Column:
                after = F.get(ts, i + 1)
                return reduce(or_, (~t[c].eqNullSafe(after[c]) for c in same), i == F.size(ts) - 1)

            return F.filter(ts, differs)

        found = tokens.select(*PAGE, F.inline(_let(ordered, last)))
        return found.select(*PAGE, "pos", "text", "x1", "y1", "x2", "y2", "confidence", (-F.col("first")).alias("engine"))
    best = F.max(F.struct("confidence", (-F.col("engine")).alias("first"), F.col("pos")))
    merged = tokens.groupBy(*PAGE, "text", "x1", "y1", "x2", "y2").agg(best.alias("b"))
    return merged.select(*PAGE, F.col("b.pos").alias("pos"), "text", "x1", "y1", "x2", "y2", F.col("b.confidence").alias("confidence"), (-F.col("b.first")).alias("engine"))


def adaptive_threshold(tokens: DataFrame, *by: str) -> DataFrame:
    """By page: 0.6 times the median token height, 8 at least."""
    return tokens.groupBy(*(by or PAGE)).agg(F.greatest(F.lit(8), F.floor(F.median(F.col("y2") - F.col("y1")) * 0.6).cast("int")).alias("threshold"))


def line_slices(tokens: DataFrame, threshold: Column | float = 12, *columns: str) -> DataFrame:
    """Lines of a page: line_num (from 1) and `ts`, its tokens in reading order with y1, x1, pos, cy, text and further columns.

    In reading order, a token begins a line if its centre is more than `threshold` from that of the line's first token.
    The anchor depends on the tokens before, so it is a fold over a page's tokens and no window; the fold keeps where
    lines begin, and each line is a slice of the page.
    """
    each = lambda of: F.struct(of("y1").alias("y1"), of("x1").alias("x1"), of("pos").alias("pos"), scalars.centre(of("y1"), of("y2")).alias("cy"), *(of(c).alias(c) for c in ("text", *columns)))
    if isinstance(threshold, Column):
        pages = tokens.groupBy(*PAGE).agg(F.sort_array(F.collect_list(each(F.col))).alias("ts"), F.first(threshold).alias("t"))
    else:
        pages = gathered(tokens, "y1", "x1", "pos", "y2", "text", *columns).select(*PAGE, F.sort_array(F.transform("ts", lambda t: each(t.__getitem__))).alias("ts"))
    most = F.col("t") if isinstance(threshold, Column) else F.lit(threshold)
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(acc: Column, t: Column) -> Column:
        new = acc.anchor.isNull() | (F.abs(t.cy - acc.anchor) > most)
        return F.struct(F.when(new, t.cy).otherwise(acc.anchor).alias("anchor"), (acc.at + 1).alias("at"), F.when(new, F.concat(acc.begins, F.array(acc.at))).otherwise(acc.begins).alias("begins"))

    found = pages.withColumn("begins", F.aggregate("ts", start, step, lambda acc: acc.begins))
    ends = F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("ts") + 1))
    sliced = F.transform(F.arrays_zip(F.col("begins").alias("a"), ends.alias("b")), lambda z: F.slice("ts", z["a"], z["b"] - z["a"]))
    return found.select(*PAGE, F.posexplode(sliced).alias("at", "ts")).select(*PAGE, (F.col("at") + 1).cast("long").alias("line_num"), "ts")


def lines(tokens: DataFrame, threshold: Column | float = 12) -> DataFrame:
    """Lines of a page: line_num (from 1), n, y, line_text."""
    out = line_slices(tokens, threshold)
    return out.select(*PAGE, "line_num", F.size("ts").cast("long").alias("n"), F.get("ts", F.lit(0)).y1.alias("y"), F.array_join(F.transform("ts", lambda t: t.text), " ").alias("line_text"))


def adaptive_lines(tokens: DataFrame) -> DataFrame:
    return lines(tokens.join(adaptive_threshold(tokens), list(PAGE)), F.col("threshold"))


def gap_columns(tokens: DataFrame) -> DataFrame:
    """Columns of a page: column_num (from 1), n, position (the mean of its centres).

    In the order of centres, a gap of more than max(20, 0.04 * span) to the one before begins a column.
    """
    page, w = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE).orderBy("cx", "pos")
    each = tokens.select(*PAGE, "pos", scalars.centre(F.col("x1"), F.col("x2")).alias("cx"))
    span = F.greatest(F.lit(1.0), F.max("cx").over(page) - F.min("cx").over(page))
    gaps = each.withColumn("gap", F.greatest(F.lit(20.0), 0.04 * span)).withColumn("new", F.coalesce((F.col("cx") - F.lag("cx").over(w) > F.col("gap")).cast("int"), F.lit(1)))
    numbered = gaps.withColumn("column_num", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*PAGE, "column_num").agg(F.count("*").alias("n"), F.avg("cx").alias("position"))


def row_groups(cells: DataFrame, least_height: float = 10) -> DataFrame:
    """`row_num` of cells by the gap to the cell before: the fixed rule for detected cells."""
    w = Window.partitionBy(*PAGE).orderBy("y1", "x1", "pos")
    new = F.coalesce((F.col("y1") - F.lag("y1").over(w) > least_height).cast("int"), F.lit(1))
    return cells.withColumn("_new", new).withColumn("row_num", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def cells(tokens: DataFrame, columns: DataFrame) -> DataFrame:
    """Tokens with the column they stand in: bounds halfway between positions, the upper one excluded; equi-joined by page."""
    w = Window.partitionBy(*PAGE).orderBy("position", "column_num")
    bounds = columns.select(
        *PAGE, "column_num", F.coalesce((F.lag("position").over(w) + F.col("position")) / 2, F.lit(float("-inf"))).alias("lo"), F.coalesce((F.lead("position").over(w) + F.col("position")) / 2, F.lit(float("inf"))).alias("hi")
    )
    cx = scalars.centre(F.col("x1"), F.col("x2"))
    return tokens.join(bounds, list(PAGE)).where((cx >= F.col("lo")) & (cx < F.col("hi"))).drop("lo", "hi")


def in_region(tokens: DataFrame, regions: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Pairs of tokens and regions (rx1, ry1, rx2, ry2) of a page: inside, or overlapping by least_iou."""
    t, r = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("rx1", "ry1", "rx2", "ry2")]
    return tokens.join(regions, list(PAGE)).where(scalars.inside(t, r) | (scalars.iou(t, r) >= least_iou))


#: Levels of the grid: cells of 8 pixels, and of twice as many from level to level.
CELL, LEVELS = 8, 14


def _level(width: Column, height: Column) -> Column:
    """The first level whose cells are as wide and high as a box, so that the box covers four of them at most; the last for larger ones."""
    side = F.greatest(width, height, F.lit(1)).cast("double") / CELL
    return F.least(F.greatest(F.ceil(F.log2(side)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def in_region_grid(tokens: DataFrame, regions: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """The pairs of in_region, by a join of grid cells in place of whole pages: rows compared are those near each other.

    A region lies in up to four cells of the level of its size. A token that is inside a region or overlaps it by
    least_iou is no larger than 1 / least_iou of its sides, so that it visits the cells it covers on its own level, as many
    below as that allows, and all above, where a region of the table may be. Each pair is compared in one cell only: that of
    the upper left corner of what both share. Boxes that are inside out, or have a null, are in no region.
    """
    if not 0 < least_iou <= 1:
        raise ValueError("least_iou is above 0 and at most 1")
    keys = [c for c in regions.columns if c not in PAGE]
    below = int(np.ceil(np.log2(1 / least_iou)))

    def cells_of(df: DataFrame, levels: Column, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
        sound = df.where((F.col(x1) <= F.col(x2)) & (F.col(y1) <= F.col(y2)))
        side = F.lit(float(CELL)) * F.pow(F.lit(2.0), F.col("_l"))
        span = lambda a, b: F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side))
        return sound.withColumn("_l", F.explode(levels)).withColumn("_cx", F.explode(span(x1, x2))).withColumn("_cy", F.explode(span(y1, y2)))

    own = lambda a, b, c, d: _level(F.col(c) - F.col(a), F.col(d) - F.col(b))
    r = cells_of(regions, F.array(own("rx1", "ry1", "rx2", "ry2")), "rx1", "ry1", "rx2", "ry2")
    t = cells_of(tokens, F.sequence(F.greatest(own("x1", "y1", "x2", "y2") - below, F.lit(0)), F.lit(LEVELS - 1)), "x1", "y1", "x2", "y2")
    if len(used := regions.select(own("rx1", "ry1", "rx2", "ry2").alias("l")).distinct().collect()) < LEVELS:
        t = t.where(F.col("_l").isin(*[u["l"] for u in used if u["l"] is not None]))
    side = F.lit(float(CELL)) * F.pow(F.lit(2.0), F.col("_l"))
    corner = (F.floor(F.greatest("x1", "rx1") / side) == F.col("_cx")) & (F.floor(F.greatest("y1", "ry1") / side) == F.col("_cy"))
    a, b = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("rx1", "ry1", "rx2", "ry2")]
    met = t.join(r, [*PAGE, "_l", "_cx", "_cy"]).where(corner & (scalars.inside(a, b) | (scalars.iou(a, b) >= least_iou)))
    return met.select(*tokens.columns, *keys)


def in_box(tokens: DataFrame, box: tuple[float, float, float, float], least_iou: float = 0.5) -> DataFrame:
    """Tokens inside one box that is the same on all pages, or overlapping it by least_iou: a filter, no join."""
    t, r = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.lit(v) for v in box]
    return tokens.where(scalars.inside(t, r) | (scalars.iou(t, r) >= least_iou))


def needs_review(tokens: DataFrame, pages: DataFrame, least: float = scalars.REVIEW) -> DataFrame:
    """Pages with a token of less confidence, or without tokens."""
    found = tokens.groupBy(*PAGE).agg(F.bool_or(F.col("confidence") < least).alias("low"), F.count("*").alias("tokens"))
    return pages.join(found, list(PAGE), "left").select(*PAGE, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("low", F.lit(True)).alias("needs_review"))


def extracted_rows(regions: DataFrame, least: float = scalars.REVIEW) -> DataFrame:
    """Rows of a document from its non-blank regions (doc_id, page_num, region_num, region_text, token_ids, least_confidence)."""
    known = regions.where(F.trim("region_text") != "")
    w = Window.partitionBy("doc_id").orderBy("page_num", "region_num")
    confidence = F.coalesce("least_confidence", F.lit(1.0))
    return known.select(
        "doc_id", F.concat(F.lit("row_"), F.row_number().over(w) - 1).alias("row_id"), "page_num", "region_num", F.col("region_text").alias("row_text"),
        F.size(F.array_compact("token_ids")).cast("long").alias("tokens"), confidence.alias("confidence"), (confidence < least).alias("needs_review"),
    )


def large_boxes(boxes: DataFrame, width: Column, height: Column, least: float = 0.01) -> DataFrame:
    """Boxes (x1, y1, x2, y2) of more than a share of the page's area: those that may be tables."""
    return boxes.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) > width * height * F.lit(least))


def wide_boxes(boxes: DataFrame, width: float = 20, height: float = 10) -> DataFrame:
    """Boxes that are wider and higher than a cell is at least."""
    return boxes.where((F.col("x2") - F.col("x1") > width) & (F.col("y2") - F.col("y1") > height))


def line_positions(boxes: DataFrame) -> DataFrame:
    """By page the distinct left edges, in order: the columns that ruled lines tell."""
    return boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_set("x1")).alias("positions"))


def ward_positions(values: np.ndarray, distance: float = 20.0) -> list[float]:
    """Ward's clusters of numbers, cut at a distance: their means in order.

    Of numbers in order, the two clusters that merge are neighbours; neighbours are kept in a chain and merged by least
    distance first, sqrt(2 * n * m / (n + m)) times the difference of means.
    """
    import heapq
    from math import sqrt

    v = np.asarray(values, float)
    if not len(v):
        return []
    # Equal numbers are apart by 0, so they merge before all others.
    v, counts = np.unique(v, return_counts=True)
    mean, size, left, right, version = v.tolist(), counts.tolist(), list(range(-1, len(v) - 1)), [*range(1, len(v)), -1], [0] * len(v)
    apart = lambda a, b: sqrt(2 * size[a] * size[b] / (size[a] + size[b])) * (mean[b] - mean[a])
    # What is further apart than the distance would end the search when it comes: it need not be held.
    heap = [(d, i, i + 1, 0, 0) for i in range(len(v) - 1) if (d := apart(i, i + 1)) <= distance]
    heapq.heapify(heap)
    gone = set()
    while heap:
        d, a, b, va, vb = heapq.heappop(heap)
        if a in gone or b in gone or version[a] != va or version[b] != vb:
            continue
        mean[a], size[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b]), size[a] + size[b]
        gone.add(b)
        version[a] += 1
        right[a] = right[b]
        if right[a] >= 0:
            left[right[a]] = a
            if (d := apart(a, right[a])) <= distance:
                heapq.heappush(heap, (d, a, right[a], version[a], version[right[a]]))
        if left[a] >= 0 and (d := apart(left[a], a)) <= distance:
            heapq.heappush(heap, (d, left[a], a, version[left[a]], version[a]))
    return [mean[i] for i in range(len(v)) if i not in gone]


def _ward_positions(centres: Column, distance: float = 20.0) -> Column:
    @F.pandas_udf("array<double>")
    def cluster(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else ward_positions(v, distance) for v in values], dtype=object)

    return cluster(centres)


def ward_columns(tokens: DataFrame, distance: float = 20.0) -> DataFrame:
    """Columns of a page by hierarchical clustering of token centres; pages are gathered to arrays, one row each."""
    pages = gathered(tokens, "x1", "x2").select(*PAGE, F.transform("ts", lambda t: scalars.centre(t.x1, t.x2)).alias("centres"))
    found = pages.select(*PAGE, _ward_positions(F.col("centres"), distance).alias("positions"))
    return found.select(*PAGE, F.posexplode("positions").alias("i", "position")).select(*PAGE, (F.col("i") + 1).cast("long").alias("column_num"), "position")


#: Tokens of a table from which on its columns are clustered.
CLUSTERED = 8


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once a row: what stands in a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _runs(xs: Column, key: Callable[[Column], Column]) -> Column:
    """A sorted array cut where the key changes."""
    n = F.size(xs)
    begins = F.filter(F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n), lambda i: (i == 1) | ~key(F.get(xs, i - 1)).eqNullSafe(key(F.get(xs, i - 2))))
    return _let(begins, lambda bs: F.transform(bs, lambda b, j: F.slice(xs, b, F.coalesce(F.get(bs, j + 1), n + 1) - b)))


def _at(xs: Column, i: Column) -> Column:
    return F.get(xs, i.cast("int"))


def _median(xs: Column) -> Column:
    return _let(F.sort_array(xs), lambda s: (_at(s, F.floor((F.size(s) - 1) / 2)) + _at(s, F.floor(F.size(s) / 2))) / F.lit(2.0))


def _row_slices(ts: Column, threshold: Column) -> Column:
    """Tokens in reading order, cut where a centre is more than the threshold from that of the row's first token."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(acc: Column, t: Column) -> Column:
        cy = scalars.centre(t.y1, t.y2)
        new = acc.anchor.isNull() | (F.abs(cy - acc.anchor) > threshold)
        return F.struct(F.when(new, cy).otherwise(acc.anchor).alias("anchor"), (acc.at + 1).alias("at"), F.when(new, F.concat(acc.begins, F.array(acc.at))).otherwise(acc.begins).alias("begins"))

    cut = lambda begins: F.transform(begins, lambda b, i: F.slice(ts, b, F.coalesce(F.get(begins, i + 1), F.size(ts) + 1) - b))
    return _let(F.aggregate(ts, start, step, lambda acc: acc.begins), cut)


def _gap_positions(centres: Column) -> Column:
    """Means of runs of sorted centres that are parted by more than max(20, 0.04 * span); none of none."""
    gap = F.greatest(F.lit(20.0), 0.04 * F.greatest(F.lit(1.0), F.get(centres, F.size(centres) - 1) - F.get(centres, F.lit(0))))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<double>").alias("means"))

    def means(most: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            new = acc.last.isNotNull() & (x - acc.last > most)
            return F.struct(
                x.alias("last"), (F.when(new, 0.0).otherwise(acc.sum) + x).alias("sum"), (F.when(new, 0).otherwise(acc.n) + 1).alias("n"), F.when(new, F.concat(acc.means, F.array(F.try_divide(acc.sum, acc.n)))).otherwise(acc.means).alias("means")
            )

        return F.aggregate(centres, start, step, lambda acc: F.when(acc.n > 0, F.concat(acc.means, F.array(F.try_divide(acc.sum, acc.n)))).otherwise(acc.means))

    return _let(gap, means)


def _placed(rows: Column, positions: Column) -> Column:
    """Each token with its column_num: bounds are halfway between positions, a bound belongs to the column it begins."""
    bounds = F.transform(F.arrays_zip(positions.alias("a"), F.slice(positions, 2, F.size(positions)).alias("b")), lambda z: (z["a"] + z["b"]) / 2)
    # A token's centre is worked out once, not for each bound.
    column = lambda cuts, t: _let(scalars.centre(t.x1, t.x2), lambda c: F.size(F.filter(cuts, lambda b: b <= c)).cast("long") + 1)
    place = lambda cuts, t: t.withField("column_num", column(cuts, t))
    return _let(bounds, lambda cuts: F.transform(rows, lambda row: F.transform(row, lambda t: place(cuts, t))))


def tables(tokens: DataFrame, regions: DataFrame | tuple[float, float, float, float] | None, least: float = scalars.REVIEW, hierarchical: bool = True) -> DataFrame:
    """One row for each region: its keys, rows, col_positions, columns (col_0, ...), needs_review.

    regions: a table (doc_id, page_num, region_id if there are several a page, rx1, ry1, rx2, ry2, and lines array<double> if ruled lines are known), or one box
    on every page that has tokens, or None for pages that hold their tokens and regions (in_page_regions). rows: arrays of a row's tokens in reading order, each with column_num (from 1). Rows by
    the adaptive threshold from the row's first token; columns by ruled lines where there are any, else by hierarchical
    clustering if there are CLUSTERED tokens, else, or if it is switched off, by gaps. A table needs review if any of
    its tokens is below `least`, or if it has none. Tokens are shuffled once; all else is done on a region's array.
    """
    token = F.struct(*TOKEN)
    if "regions" in tokens.columns:
        keys, found = (*PAGE, "region_id"), in_page_regions(tokens)
    elif isinstance(regions, DataFrame):
        lines = F.col("lines") if "lines" in regions.columns else F.lit(None).cast("array<double>")
        keys = (*PAGE, *(c for c in regions.columns if c == "region_id"))
        known = regions.select(*keys, "rx1", "ry1", "rx2", "ry2", lines.alias("lines"))
        # The regions go along as rows without a token, so that those without any are there too.
        each = in_region_grid(tokens, known.drop("lines")).select(*keys, token.alias("t"), F.lit(None).cast("array<double>").alias("lines"))
        each = each.unionByName(known.select(*keys, F.lit(None).cast(each.schema["t"].dataType).alias("t"), "lines"))
        found = each.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("ts"), F.max("lines").alias("lines"))
    elif "ts" in tokens.columns:
        keys, found = PAGE, tokens.select(*PAGE, in_box_of("ts", regions).alias("ts"), F.lit(None).cast("array<double>").alias("lines"))
    else:
        keys, t, r = PAGE, [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.lit(v) for v in regions]
        own = scalars.inside(t, r) | (scalars.iou(t, r) >= 0.5)
        found = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(own, token))).alias("ts")).withColumn("lines", F.lit(None).cast("array<double>"))
    n, centres = F.size("ts"), F.sort_array(F.transform("ts", lambda t: scalars.centre(t.x1, t.x2)))
    ruled = F.array_distinct(F.array_sort("lines"))
    is_ruled = (n > 0) & F.coalesce(F.size(ruled) > 0, F.lit(False))
    positions = _let(centres, _gap_positions)
    if hierarchical:
        positions = F.coalesce(_ward_positions(F.when((n >= CLUSTERED) & ~is_ruled, centres)), positions)
    positions = F.when(is_ruled, ruled).otherwise(positions)
    found = found.select(*keys, "ts", _rows_of(F.col("ts")).alias("rows"), positions.alias("col_positions"))
    names = F.transform("col_positions", lambda _, i: F.concat(F.lit("col_"), i.cast("string")))
    review = (n == 0) | F.exists("ts", lambda t: t.confidence < least)
    placed = _let(F.col("rows"), lambda rows: _let(F.col("col_positions"), lambda at: _placed(rows, at)))
    return found.select(*keys, placed.alias("rows"), "col_positions", names.alias("columns"), review.alias("needs_review"))


#: A token of a table, in the order that sorts it for reading.
TOKEN = ("y1", "x1", "pos", "x2", "y2", "text", "confidence")


def in_box_of(ts: Column | str, box: tuple[float, float, float, float]) -> Column:
    """The tokens of a page (an array) that are in a box, in reading order."""
    r = [F.lit(v) for v in box]
    # What lies beside the box shares nothing with it: most of a page's tokens need no shares of areas.
    beside = lambda t: (t.y1 > r[3]) | (t.y2 < r[1]) | (t.x1 > r[2]) | (t.x2 < r[0])
    own = lambda t: (lambda b: scalars.inside(b, r) | (~beside(t) & (scalars.iou(b, r) >= 0.5)))([t.x1, t.y1, t.x2, t.y2])
    return _fields(F.filter(ts, own), *TOKEN)


#: The height of the bands by which a page's regions find its tokens.
BAND = 2 * CELL


def in_page_regions(pages: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """The pairs of in_region_grid for pages that hold their tokens (`ts`) and `regions` (region_id, rx1, ry1, rx2, ry2, lines or none): a row for each
    region with `ts`, its tokens in reading order, and `lines`. No shuffle.

    Tokens are cut into bands by y1; a region looks at those from its top less the highest token's height to its bottom.
    """
    lines = [c.name for c in pages.schema["regions"].dataType.elementType.fields if c.name == "lines"]
    sound = F.filter("ts", lambda t: (t.x1 <= t.x2) & (t.y1 <= t.y2))
    banded = F.sort_array(F.transform(sound, lambda t: F.struct(F.floor(t.y1 / BAND).alias("band"), *(t[c].alias(c) for c in TOKEN))))
    highest = F.coalesce(F.array_max(F.transform(sound, lambda t: t.y2 - t.y1)), F.lit(0))
    bands = pages.select(*PAGE, "regions", _let(banded, lambda ts: _runs(ts, lambda t: t.band)).alias("bands"), highest.alias("highest"))

    def own(r: Column) -> Column:
        box = [r.rx1, r.ry1, r.rx2, r.ry2]
        low, high = F.floor((r.ry1 - F.col("highest")) / BAND), F.floor(r.ry2 / BAND)
        near = F.flatten(F.filter("bands", lambda ts: F.get(ts, F.lit(0)).band.between(low, high)))
        # Heights tell most tokens apart, and of those that touch the region most are inside: few need shares of areas.
        touches = lambda t: (t.y1 <= r.ry2) & (t.y2 >= r.ry1) & (t.x1 <= r.rx2) & (t.x2 >= r.rx1)
        met = lambda t: (touches(t) if least_iou > 0 else F.lit(True)) & (lambda b: scalars.inside(b, box) | (scalars.iou(b, box) >= least_iou))([t.x1, t.y1, t.x2, t.y2])
        return F.when((r.rx1 <= r.rx2) & (r.ry1 <= r.ry2), _fields(F.filter(near, met), *TOKEN))

    empty = F.slice(_fields(F.flatten("bands"), *TOKEN), 1, 0)
    found = F.transform("regions", lambda r: F.struct(r.region_id.alias("region_id"), F.coalesce(own(r), empty).alias("ts"), (r.lines if lines else F.lit(None).cast("array<double>")).alias("lines")))
    return bands.select(*PAGE, F.inline(found))


def _rows_of(ts: Column) -> Column:
    """The rows of a table's tokens, by the adaptive threshold."""
    threshold = F.greatest(F.lit(8), F.floor(_median(F.transform(ts, lambda t: t.y2 - t.y1)) * 0.6).cast("int"))
    return _let(threshold, lambda most: _row_slices(ts, most))


def _cells_of(rows: Column, less: Collection[str] = ()) -> Column:
    """The cells of placed rows: row_num, column_num, cell_text, and unless named in less confidence (the least), token_ids, box."""
    bound = lambda f, run, c: f(F.transform(run, lambda t: t[c]))

    def cell(run: Column, i: Column) -> Column:
        box = F.array(*(bound(f, run, c) for f, c in ((F.array_min, "x1"), (F.array_min, "y1"), (F.array_max, "x2"), (F.array_max, "y2"))))
        text = F.array_join(F.transform(run, lambda t: t.text), " ")
        more = {"confidence": bound(F.array_min, run, "confidence"), "token_ids": F.transform(run, lambda t: t.pos), "box": box}
        return F.struct((i + 1).cast("long").alias("row_num"), F.get(run, F.lit(0)).column_num.alias("column_num"), text.alias("cell_text"), *(c.alias(name) for name, c in more.items() if name not in less))

    by_column = lambda row: _let(_fields(row, "column_num", *TOKEN), lambda ts: _runs(ts, lambda t: t.column_num))
    return F.flatten(F.transform(rows, lambda row, i: F.transform(by_column(row), lambda run: cell(run, i))))


def table_cells_of(ts: Column | str, box: tuple[float, float, float, float], less: Collection[str] = ()) -> Column:
    """The cells of `table` for one page's tokens (an array) and one box, columns by gaps; less as in _cells_of."""
    centres = lambda own: F.sort_array(F.transform(own, lambda t: scalars.centre(t.x1, t.x2)))
    placed = lambda own: _let(_rows_of(own), lambda rows: _let(_let(centres(own), _gap_positions), lambda at: _placed(rows, at)))
    return _let(in_box_of(ts, box), lambda own: _let(placed(own), lambda rows: _cells_of(rows, less)))


def table(tokens: DataFrame, regions: DataFrame | tuple[float, float, float, float], least: float = scalars.REVIEW, hierarchical: bool = True) -> DataFrame:
    """Cells of `tables`: the region's keys, row_num, column_num, cell_text, confidence (the least), token_ids, box, needs_review (of the table).

    Words of a cell in reading order. A region's cells are put together where its tokens are: no further shuffle.
    """
    found = tables(tokens, regions, least, hierarchical)
    keys = [c for c in found.columns if c in (*PAGE, "region_id")]
    out = found.select(*keys, "needs_review", F.inline(_let(F.col("rows"), lambda rows: _cells_of(rows))))
    return out.select(*keys, "row_num", "column_num", "cell_text", "confidence", "token_ids", "box", "needs_review")


def table_columns(found: DataFrame) -> DataFrame:
    """The columns of `tables`, all rows in one: the region's keys, column_num, tokens, confidence (the least), token_ids in order."""
    keys = [c for c in found.columns if c in (*PAGE, "region_id")]
    column = lambda run: F.struct(F.get(run, F.lit(0)).column_num.alias("column_num"), F.size(run).cast("long").alias("tokens"), F.array_min(F.transform(run, lambda t: t.confidence)).alias("confidence"), F.transform(run, lambda t: t.pos).alias("token_ids"))
    return found.select(*keys, F.inline(_let(_fields(F.flatten("rows"), "column_num", "pos", "confidence"), lambda ts: F.transform(_runs(ts, lambda t: t.column_num), column))))


def runs_of(ts: Column | str, length: int = 15) -> Column:
    """A page's tokens (an array) cut into runs of so many places, each in order: region_num, ts."""
    numbered = F.sort_array(F.transform(ts, lambda t: F.struct(F.floor(t.pos / length).alias("region_num"), *(t[c].alias(c) for c in ("pos", *(c for c in TOKEN if c != "pos"))))))
    return _let(numbered, lambda each: F.transform(_runs(each, lambda t: t.region_num), lambda run: F.struct(F.get(run, F.lit(0)).region_num.alias("region_num"), run.alias("ts"))))


def best_rotation(tokens: DataFrame, *by: str) -> DataFrame:
    """Of rotations (column `degrees`), that with the best (mean confidence, tokens); the first on a tie."""
    each = tokens.groupBy(*by, "degrees").agg(F.avg("confidence").alias("mean"), F.count("*").alias("n"))
    best = F.max(F.struct(F.round("mean", 9).alias("mean"), "n", (-F.col("degrees")).alias("less")))
    return each.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.less")).alias("degrees"), F.col("b.mean").alias("mean"), F.col("b.n").alias("n"))
