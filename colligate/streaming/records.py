"""Incremental binding: a stream of raw records, bound and filtered as the batch route does it.

A callback sees every record of a micro-batch in turn and answers CONTINUE, STOP (no more callbacks, the
stream goes on), CANCEL (the query stops, and the micro-batch it is in isn't committed) or ERROR (the query
fails). Callbacks run on the driver over one partition at a time; use on_batch for distributed work.
"""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.schema import Contract
from ..plans.selection import row_filter
from ..sources.records import bind_csv, bind_xml, read_json, read_yaml


class Action(enum.Enum):
    CONTINUE = "continue"
    STOP = "stop"
    CANCEL = "cancel"
    ERROR = "error"


@dataclass(frozen=True)
class Limits:
    """Bytes of a record and of a field, and the number of results."""

    record_bytes: int = 8 << 20
    field_bytes: int = 1 << 20
    results: int = 1_000_000


#: Selections that each format supports.
SUPPORTED = {"json": ("root", "all", "path", "path_first"), "yaml": ("root", "all", "path", "path_first"), "csv": ("all",), "xml": ("root",)}


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of text lines, value."""
    return spark.readStream.options(**options).text(path)


def read_csv(spark: SparkSession, path: str, header: list[str], where: str | None = None, **options: str) -> DataFrame:
    """A stream of CSV rows as strings; the filter is on raw fields, before binding."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
    rows = spark.readStream.schema(schema).options(header="true", escape='"', **options).csv(path)
    return rows.where(row_filter(where, header)) if where else rows


def bound(stream: DataFrame, contract: Contract, type_name: str, format: str = "json", column: str = "value", limits: Limits = Limits(), **options) -> DataFrame:
    """Adds record to the stream; records and fields over the limits fail it."""
    select = options.get("select", "all" if format == "csv" else "root")
    if select not in SUPPORTED.get(format, ()):
        raise ValueError(f"{format} streams can't select {select}")
    if format == "csv":
        names = [f.name for f in stream.schema if isinstance(f.dataType, T.StringType)]
        size = sum((F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)) for n in names), F.lit(0))
        stream = stream.withColumns({n: _within(F.col(f"`{n}`"), size, limits.record_bytes, "record") for n in names[:1]})
        return _fields_within(bind_csv(stream, contract, type_name, **options), limits)
    stream = stream.withColumn(column, _within(F.col(column), F.octet_length(column), limits.record_bytes, "record"))
    readers = {"json": read_json, "yaml": read_yaml, "xml": bind_xml}
    return _fields_within(readers[format](stream, column, contract, type_name, **options), limits)


def _within(value: Column, size: Column, most: int, what: str) -> Column:
    return F.when(size > most, F.raise_error(F.lit(f"a {what} is too long")).cast("string")).otherwise(value)


def _fields_within(stream: DataFrame, limits: Limits) -> DataFrame:
    """Fails where a text anywhere in record is longer than a field may be."""

    def longest(x: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.coalesce(F.octet_length(x), F.lit(0))
        if isinstance(kind, T.StructType):
            found = [y for f in kind.fields if (y := longest(x[f.name], f.dataType)) is not None]
            return F.greatest(*found, F.lit(0)) if found else None
        if isinstance(kind, T.MapType):
            return longest(F.map_values(x), T.ArrayType(kind.valueType))
        if isinstance(kind, T.ArrayType) and longest(F.lit(None), kind.elementType) is not None:
            return F.coalesce(F.array_max(F.transform(x, lambda y: longest(y, kind.elementType))), F.lit(0))
        return None

    size = longest(F.col("record"), stream.schema["record"].dataType)
    if size is None:
        return stream
    kind = stream.schema["record"].dataType.simpleString()
    return stream.withColumn("record", F.when(size > limits.field_bytes, F.raise_error(F.lit("a field is too long")).cast(kind)).otherwise(F.col("record")))


def run(stream: DataFrame, callback: Callable[[Row], Action], limits: Limits = Limits(), checkpoint: str | None = None) -> tuple[int, Action]:
    """Feed all that is available to the callback. How many records it saw, and the last action."""
    state = {"seen": 0, "last": Action.CONTINUE, "silent": False}

    def each(batch: DataFrame, _: int) -> None:
        if state["silent"]:
            return
        for row in batch.toLocalIterator():
            state["seen"] += 1
            if state["seen"] > limits.results:
                raise RuntimeError("the stream has too many results")
            state["last"] = callback(row)
            if state["last"] == Action.ERROR:
                raise RuntimeError("the callback failed the stream")
            if state["last"] == Action.CANCEL:
                raise RuntimeError("the callback cancelled the stream")
            if state["last"] == Action.STOP:
                state["silent"] = True
                return

    query = _start(stream, each, checkpoint)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if state["last"] != Action.CANCEL:
            raise
    return state["seen"], state["last"]


def on_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Every micro-batch as a DataFrame; offsets are committed only when write returns."""
    return _start(stream, write, checkpoint)


def retained(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """All results of what is available, kept in memory under a name; for small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


def windowed(stream: DataFrame, time: str, key: str, size: str, late: str) -> DataFrame:
    """Counts by window and key with a watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
