"""Ordered collection operators on rows. Spark's rows have no order, so every operator takes order columns.

Keys are compared without regard to case unless case_sensitive; of equal keys the first row in order wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.values import folded

Order = str | Sequence[str]


def _order(order: Order) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _key(df: DataFrame, name: str, case_sensitive: bool) -> Column:
    return folded(F.col(name), df.schema[name].dataType, case_sensitive)


def _rank(df: DataFrame, order: Order) -> Column:
    return F.struct(*[F.col(o) for o in _order(order)])


def groupby(df: DataFrame, attribute: str, order: Order, default: object = None, case_sensitive: bool = False) -> DataFrame:
    """grouper, items: a row for each key. The grouper has the first row's spelling; items are in order.

    Grouping is by key, so a group is one row; use aggregate for groups that are too large to be a list.
    """
    value = F.coalesce(F.col(attribute), F.lit(default)) if default is not None else F.col(attribute)
    df = df.withColumn("cg_value", value)
    key = _key(df, "cg_value", case_sensitive)
    items = F.array_sort(F.collect_list(F.struct(_rank(df, order).alias("o"), F.struct(*[F.col(c) for c in df.columns if c != "cg_value"]).alias("item"))))
    out = df.groupBy(key.alias("cg_key")).agg(F.min_by("cg_value", _rank(df, order)).alias("grouper"), F.transform(items, lambda x: x["item"]).alias("items"))
    return out.select("cg_key", "grouper", "items").orderBy("cg_key").drop("cg_key")


def aggregate(df: DataFrame, attribute: str, order: Order, case_sensitive: bool = False, **aggregates: Column) -> DataFrame:
    """grouper and the aggregates of each group, which are combined before the shuffle."""
    key = _key(df, attribute, case_sensitive)
    out = df.groupBy(key.alias("cg_key")).agg(F.min_by(attribute, _rank(df, order)).alias("grouper"), *[a.alias(n) for n, a in aggregates.items()])
    return out.orderBy("cg_key").drop("cg_key")


def sort(df: DataFrame, attributes: str, order: Order, reverse: bool = False, case_sensitive: bool = False) -> DataFrame:
    """By one attribute, or several between commas; ties stay in order, also in reverse."""
    keys = [_key(df, a.strip(), case_sensitive) for a in attributes.split(",")]
    return df.orderBy(*[k.desc() if reverse else k.asc() for k in keys], *_order(order))


def unique(df: DataFrame, attribute: str, order: Order, case_sensitive: bool = False) -> DataFrame:
    """The first row of each key. The key is combined before the shuffle, so frequent keys cost no more."""
    firsts = df.groupBy(_key(df, attribute, case_sensitive).alias("cg_key")).agg(F.min(F.struct(_rank(df, order).alias("o"), F.struct(*df.columns).alias("row"))).alias("first"))
    return firsts.select("first.row.*")


def totals(df: DataFrame, **sums: tuple[str, bool]) -> DataFrame:
    """One row with a sum of each attribute, all from one pass: name=(attribute, exact), as total has it."""
    return df.agg(*[_total(df, attribute, 0, exact).alias(name) for name, (attribute, exact) in sums.items()])


def _total(df: DataFrame, attribute: str, start: object, exact: bool) -> Column:
    kind = df.schema[attribute].dataType
    value = F.col(attribute).cast("long") if isinstance(kind, T.BooleanType) else F.col(attribute)
    if exact:
        value = value.cast("decimal(38,12)")
    found = F.coalesce(F.sum(value), F.lit(0)) + F.lit(start)
    return found.cast("double") if exact else found


def total(df: DataFrame, attribute: str, start: object = 0, exact: bool = False) -> DataFrame:
    """One row, total. exact: floating point sums without loss, by way of decimals. Integers raise on overflow."""
    return df.agg(_total(df, attribute, start, exact).alias("total"))


def _extreme(df: DataFrame, attribute: str, order: Order, case_sensitive: bool, largest: bool) -> DataFrame:
    key, row = _key(df, attribute, case_sensitive), F.struct(*df.columns)
    held = df.where(F.col(attribute).isNotNull())
    if not largest:
        return held.agg(F.min_by(row, F.struct(key.alias("k"), _rank(df, order).alias("o"))).alias("row")).where("row is not null").select("row.*")
    # of equal keys the first row wins, so each key has its first row before the keys are compared
    firsts = held.groupBy(key.alias("k")).agg(F.min_by(row, _rank(df, order)).alias("row"))
    return firsts.agg(F.max_by("row", "k").alias("row")).where("row is not null").select("row.*")


def smallest(df: DataFrame, attribute: str, order: Order, case_sensitive: bool = False) -> DataFrame:
    """The row with the least key; none for an empty table."""
    return _extreme(df, attribute, order, case_sensitive, False)


def largest(df: DataFrame, attribute: str, order: Order, case_sensitive: bool = False) -> DataFrame:
    return _extreme(df, attribute, order, case_sensitive, True)


def first(df: DataFrame, order: Order) -> DataFrame:
    return df.orderBy(*_order(order)).limit(1)


def last(df: DataFrame, order: Order) -> DataFrame:
    return df.orderBy(*[F.col(o).desc() for o in _order(order)]).limit(1)


def select(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; NULL is not."""
    return df.where(F.coalesce(condition, F.lit(False)))


def reject(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def mapped(df: DataFrame, attribute: str, name: str = "value", default: object = None) -> DataFrame:
    value = F.coalesce(F.col(attribute), F.lit(default)) if default is not None else F.col(attribute)
    return df.withColumn(name, value)


def _numbered(df: DataFrame, order: Order, partition: Sequence[str] = ()) -> DataFrame:
    """Adds cg_n, the row's number from 0, and cg_all, the number of rows, of the partition or the whole table.

    Where the session has a checkpoint folder, a whole table isn't brought to one task: it is dealt out by ranges
    of the order and kept there, rows are counted in their range, and each range begins where those before it end.
    """
    w = Window.partitionBy(*partition)
    spark = df.sparkSession
    if partition or spark.sparkContext.getCheckpointDir() is None:
        return df.withColumns({"cg_n": F.row_number().over(w.orderBy(*_order(order))) - 1, "cg_all": F.count("*").over(w)})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *_order(order)).sortWithinPartitions(*_order(order))
    ranged = ranged.withColumns({"cg_part": F.spark_partition_id(), "cg_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    counts = ranged.groupBy("cg_part").agg(F.count("*").alias("n"))  # a row a range
    before = Window.orderBy("cg_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("cg_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cg_start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("cg_all"))
    found = ranged.join(F.broadcast(starts), "cg_part")  # at most spark.sql.shuffle.partitions rows
    return found.withColumn("cg_n", F.col("cg_start") + F.col("cg_at")).drop("cg_part", "cg_at", "cg_start")


def _listed(df: DataFrame, number: str, attribute: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(number, attribute))), lambda x: x[attribute])


def batch(df: DataFrame, attribute: str, linecount: int, order: Order, fill_with: Column | None = None, partition: Sequence[str] = ()) -> DataFrame:
    """batch (from 0), items: lists of linecount values, the last one filled up if there is a filler."""
    rows = _numbered(df, order, partition).withColumn("batch", F.floor(F.col("cg_n") / linecount).cast("long"))
    items = rows.groupBy(*partition, "batch").agg(_listed(rows, "cg_n", attribute).alias("items"))
    if fill_with is None:
        return items
    return items.withColumn("items", F.concat("items", F.array_repeat(fill_with, F.lit(linecount) - F.size("items"))))


def slices(df: DataFrame, attribute: str, count: int, order: Order, fill_with: Column | None = None, partition: Sequence[str] = ()) -> DataFrame:
    """slice (from 0), items: count lists, longer ones first; with a filler, shorter ones get one."""
    rows = _numbered(df, order, partition)
    per, more, n = F.floor(F.col("cg_all") / count), F.col("cg_all") % count, F.col("cg_n")
    longer = (per + 1) * more
    rows = rows.withColumn("slice", F.when(n < longer, F.floor(n / (per + 1))).otherwise(more + F.floor((n - longer) / per)).cast("long"))
    items = rows.groupBy(*partition, "slice").agg(_listed(rows, "cg_n", attribute).alias("items"), F.first("cg_all").alias("cg_all"))
    if fill_with is not None:
        short = F.size("items") < F.ceil(F.col("cg_all") / count)
        short = F.when(F.col("cg_all") % count == 0, True).otherwise(short)
        items = items.withColumn("items", F.when(short, F.concat("items", F.array(fill_with))).otherwise(F.col("items")))
    return items.drop("cg_all")


def joined(df: DataFrame, attribute: str, order: Order, separator: str = "", partition: Sequence[str] = ()) -> DataFrame:
    """text: the values in order between separators; NULL is empty."""
    items = F.array_sort(F.collect_list(F.struct(_rank(df, order).alias("o"), F.coalesce(F.col(attribute).cast("string"), F.lit("")).alias("v"))))
    return df.groupBy(*partition).agg(F.array_join(F.transform(items, lambda x: x["v"]), separator).alias("text"))


def sampled(df: DataFrame, seed: int | None = None) -> DataFrame:
    """One row at random; none for an empty table."""
    return df.orderBy(F.rand(seed)).limit(1)


# --- loop context ---------------------------------------------------------------------------------


def loop(df: DataFrame, order: Order, partition: Sequence[str] = (), neighbours: Sequence[str] = (), depth: int = 1, where: Column | None = None) -> DataFrame:
    """Adds loop, a struct of index, index0, revindex, revindex0, first, last, length, depth, depth0 and, for
    the columns of neighbours, previtem and nextitem. Rows that where rejects go before anything is counted."""
    if where is not None:
        df = select(df, where)
    if neighbours:
        w = Window.partitionBy(*partition).orderBy(*_order(order))
        item = F.struct(*neighbours)
        df = df.withColumns({"cg_n": F.row_number().over(w) - 1, "cg_all": F.count("*").over(Window.partitionBy(*partition)), "cg_before": F.lag(item).over(w), "cg_after": F.lead(item).over(w)})
    else:
        df = _numbered(df, order, partition)
    n, length = F.col("cg_n") + 1, F.col("cg_all")
    parts = [
        n.cast("long").alias("index"),
        (n - 1).cast("long").alias("index0"),
        (length - n + 1).alias("revindex"),
        (length - n).alias("revindex0"),
        (n == 1).alias("first"),
        (n == length).alias("last"),
        length.alias("length"),
        F.lit(depth).alias("depth"),
        F.lit(depth - 1).alias("depth0"),
    ]
    if neighbours:
        parts += [F.col("cg_before").alias("previtem"), F.col("cg_after").alias("nextitem")]
    return df.withColumn("loop", F.struct(*parts)).drop("cg_n", "cg_all", "cg_before", "cg_after")


def cycle(df: DataFrame, order: Order, values: Sequence[object], partition: Sequence[str] = (), name: str = "cycle") -> DataFrame:
    at = (F.col("cg_n") % len(values) + 1).cast("int")
    return _numbered(df, order, partition).withColumn(name, F.element_at(F.array(*map(F.lit, values)), at)).drop("cg_n", "cg_all")


def changed(df: DataFrame, order: Order, attributes: Sequence[str], partition: Sequence[str] = (), name: str = "changed") -> DataFrame:
    """True for the first row and where the attributes differ from the row before; NULL equals NULL."""
    w = Window.partitionBy(*partition).orderBy(*_order(order))
    now = F.struct(*attributes)
    return df.withColumn(name, (F.row_number().over(w) == 1) | ~now.eqNullSafe(F.lag(now).over(w)))


def until(df: DataFrame, order: Order, stop: Column, partition: Sequence[str] = ()) -> DataFrame:
    """The rows before the first one for which stop is true (break)."""
    w = Window.partitionBy(*partition).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    gate = F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(w)
    return df.withColumn("cg_gate", gate).where("cg_gate = 0").drop("cg_gate")


def running(df: DataFrame, order: Order, partition: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    """Accumulators over the rows so far, this one included."""
    w = Window.partitionBy(*partition).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: a.over(w) for n, a in aggregates.items()})
