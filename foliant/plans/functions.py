"""The library in SQL: functions of columns, and table functions that take a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from foliant.functions.scalars import HIGH, LOW

#: A page's tokens as tables.token_pages has them, and its lines.
_TS = "ARRAY<STRUCT<pos: INT, text: STRING, x1: INT, y1: INT, x2: INT, y2: INT, confidence: DOUBLE>>"
_LINES = "ARRAY<STRUCT<line_num: BIGINT, n: BIGINT, y: INT, line_text: STRING>>"
#: Tokens in reading order, where lines begin among them (a fold, as in layout.line_slices), and their slices; each is worked out once a page.
_ORDERED = "sort_array(transform(ts, t -> named_struct('y1', t.y1, 'x1', t.x1, 'pos', t.pos, 'cy', (t.y1 + t.y2) / 2, 'text', coalesce(t.text, ''))))"
_NEW = "(acc.anchor IS NULL OR abs(t.cy - acc.anchor) > threshold)"
_BEGINS = f"""aggregate(s, named_struct('anchor', CAST(NULL AS DOUBLE), 'at', 1, 'begins', CAST(array() AS ARRAY<INT>)), (acc, t) -> named_struct('anchor', if({_NEW}, t.cy, acc.anchor), 'at', acc.at + 1,
  'begins', if({_NEW}, concat(acc.begins, array(acc.at)), acc.begins)), acc -> acc.begins)"""
_LINE = "named_struct('line_num', CAST(i + 1 AS BIGINT), 'n', CAST(size(l) AS BIGINT), 'y', l[0].y1, 'line_text', array_join(transform(l, t -> t.text), ' '))"
_SLICES = f"transform(b, (x, i) -> transform(array(slice(s, x, coalesce(get(b, i + 1), size(s) + 1) - x)), l -> {_LINE})[0])"

#: Column functions: their bodies are SQL, so that the optimizer sees through them.
SCALARS = {
    "quality": ("c DOUBLE", "STRING", f"CASE WHEN c > {HIGH} THEN 'High' WHEN c >= {LOW} THEN 'Medium' WHEN c < {LOW} THEN 'Low' END"),
    "clamped": ("c DOUBLE", "DOUBLE", "greatest(0D, least(1D, c))"),
    "centre": ("a DOUBLE, b DOUBLE", "DOUBLE", "(a + b) / 2"),
    "area": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "greatest(0D, x2 - x1) * greatest(0D, y2 - y1)"),
    "iou": (
        "ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE", "DOUBLE",
        "coalesce(try_divide(area(greatest(ax1, bx1), greatest(ay1, by1), least(ax2, bx2), least(ay2, by2)), area(ax1, ay1, ax2, ay2) + area(bx1, by1, bx2, by2) - area(greatest(ax1, bx1), greatest(ay1, by1), least(ax2, bx2), least(ay2, by2))), 0D)",
    ),
    "lines_of": (f"ts {_TS}, threshold DOUBLE", _LINES, f"get(transform(array({_ORDERED}), s -> get(transform(array({_BEGINS}), b -> {_SLICES}), 0)), 0)"),
    "shard_path": ("digest STRING", "STRING", "concat_ws('/', substring(digest, 1, 2), substring(digest, 3, 2), digest)"),
}


def _pages(table: AnalyzeArgument, needed: tuple[str, ...]) -> list[StructField]:
    """The columns doc_id and page_num of a table that has those needed; what is wrong is told when the query is planned."""
    if not table.isTable:
        raise ValueError("the function takes a table: TABLE(...)")
    if missing := [c for c in ("doc_id", "page_num", *needed) if c not in table.dataType.names]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return [table.dataType["doc_id"], table.dataType["page_num"]]


class Lines:
    """Lines of a page: a token begins one if its centre is more than `threshold` from that of the line's first token.

    The table is parted by page and ordered as it is read, whatever the query says; a worker holds one line.
    """

    @staticmethod
    def analyze(tokens: AnalyzeArgument, threshold: AnalyzeArgument | None = None) -> AnalyzeResult:
        page = _pages(tokens, ("y1", "y2", "x1", "pos", "text"))
        if threshold is not None and not threshold.isConstantExpression:
            raise ValueError("threshold is a constant")
        return AnalyzeResult(
            StructType([*page, StructField("line_num", LongType()), StructField("n", LongType()), StructField("y", tokens.dataType["y1"].dataType), StructField("line_text", StringType())]),
            partitionBy=[PartitioningColumn("doc_id"), PartitioningColumn("page_num")], orderBy=[OrderingColumn("y1"), OrderingColumn("x1"), OrderingColumn("pos")],
        )

    def __init__(self):
        self.page, self.line, self.anchor, self.y, self.words = None, 0, None, None, []

    def _told(self) -> Iterator[tuple]:
        if self.words:
            yield (*self.page, self.line, len(self.words), self.y, " ".join(self.words))

    def eval(self, tokens: Row, threshold: float = 12.0) -> Iterator[tuple]:
        centre = (tokens["y1"] + tokens["y2"]) / 2
        if self.anchor is None or abs(centre - self.anchor) > float(threshold):
            yield from self._told()
            self.page, self.line, self.anchor, self.y, self.words = (tokens["doc_id"], tokens["page_num"]), self.line + 1, centre, tokens["y1"], []
        self.words.append(tokens["text"] or "")

    def terminate(self) -> Iterator[tuple]:
        yield from self._told()


class GapColumns:
    """Columns of a page: in the order of centres, one begins after a gap of more than `gap`."""

    @staticmethod
    def analyze(tokens: AnalyzeArgument, gap: AnalyzeArgument | None = None) -> AnalyzeResult:
        page = _pages(tokens, ("x1", "x2", "pos"))
        return AnalyzeResult(
            StructType([*page, StructField("column_num", LongType()), StructField("n", LongType()), StructField("position", DoubleType())]),
            partitionBy=[PartitioningColumn("doc_id"), PartitioningColumn("page_num")], orderBy=[OrderingColumn("x1 + x2"), OrderingColumn("pos")],
        )

    def __init__(self):
        self.page, self.column, self.last, self.sum, self.n = None, 0, None, 0.0, 0

    def _told(self) -> Iterator[tuple]:
        if self.n:
            yield (*self.page, self.column, self.n, self.sum / self.n)

    def eval(self, tokens: Row, gap: float = 20.0) -> Iterator[tuple]:
        centre = (tokens["x1"] + tokens["x2"]) / 2
        if self.last is None or centre - self.last > float(gap):
            yield from self._told()
            self.page, self.column, self.sum, self.n = (tokens["doc_id"], tokens["page_num"]), self.column + 1, 0.0, 0
        self.last, self.sum, self.n = centre, self.sum + centre, self.n + 1

    def terminate(self) -> Iterator[tuple]:
        yield from self._told()


TABLES = {"lines": Lines, "columns_by_gap": GapColumns}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session, under their names."""
    for name, (arguments, returns, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    for name, function in TABLES.items():
        spark.udtf.register(name, udtf(function))
