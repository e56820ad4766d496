"""One stream to several sinks: each batch is stored once, told by its number, and every sink is made from what was stored."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sink writes a batch to a folder, whole: the folder holds nothing else.
Sink = Callable[[DataFrame, str], None]


def json_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv_sink(*columns: str) -> Sink:
    """CSV with a header: null is blank, and an empty text is quoted, which readers that don't look at quotes take for null."""

    def write(df: DataFrame, path: str) -> None:
        df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

    return write


def text_sink(line: Callable[[], object]) -> Sink:
    """line: makes the column that a row's text is."""

    def write(df: DataFrame, path: str) -> None:
        df.select(line().alias("value")).write.mode("overwrite").text(path)

    return write


def to_all(root: str, sinks: Mapping[str, Sink], schema: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's results as JSON in `<root>/json/batch=<number>`, always, and from there in `<root>/<sink>/batch=<number>`.

    The source is read once, whatever the number of sinks. A batch that is run again, since the stream was stopped
    between its writes and its commit, overwrites what it wrote: the sinks hold it once. schema: of the stored JSON.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        stored = f"{root}/json/batch={number}"
        json_sink(batch, stored)
        again = spark.read.schema(schema).json(stored)
        for name, sink in sinks.items():
            sink(again, f"{root}/{name}/batch={number}")

    return write


def run_to_all(stream: DataFrame, root: str, checkpoint: str, sinks: Mapping[str, Sink]) -> None:
    """Runs a stream over all that is there into all sinks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    stream.writeStream.foreachBatch(to_all(root, sinks, schema)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def regenerated(spark: SparkSession, root: str, schema: str, name: str, sink: Sink) -> None:
    """Makes one sink anew, or one more, from all stored JSON, batch by batch as it was written."""
    stored = spark.read.schema(schema).json(f"{root}/json")
    for number in sorted(r["batch"] for r in stored.select("batch").distinct().collect()):
        sink(stored.where(F.col("batch") == number).drop("batch"), f"{root}/{name}/batch={number}")
