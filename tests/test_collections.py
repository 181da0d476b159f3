import pytest
from pyspark.sql import functions as F, types as T

from colligate.functions import strings, values
from colligate.operators import arrays, rows

S, D = T.StringType(), T.DoubleType()


def one(spark, column, **data):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in data.items()] or ["id"])
    return df.select(column.alias("x")).first().x


def test_array_golden_values(spark):
    xs = F.col("xs")
    assert one(spark, arrays.joined(arrays.sort(xs, S)), xs=["b", "A"]) == "Ab"
    assert one(spark, arrays.joined(arrays.sort(xs, S, case_sensitive=True)), xs=["a", "B"]) == "Ba"
    assert one(spark, arrays.unique(xs, S), xs=["a", "A", "b", "a"]) == ["a", "b"]
    assert one(spark, arrays.smallest(xs, S), xs=["b", "A"]) == "A"
    assert one(spark, arrays.largest(xs, S), xs=["a", "B"]) == "B"
    assert one(spark, arrays.total(xs, D), xs=[1e16, 1.0, -1e16]) == 1.0
    assert one(spark, arrays.total(xs, T.LongType(), 3), xs=[1, 2]) == 6
    assert one(spark, arrays.slices(xs, 2), xs=[0, 1, 2, 3, 4]) == [[0, 1, 2], [3, 4]]
    assert one(spark, arrays.slices(xs, 2, F.lit(0)), xs=[0, 1, 2, 3]) == [[0, 1, 0], [2, 3, 0]]
    assert one(spark, arrays.batch(xs, 2, F.lit(9)), xs=[1, 2, 3]) == [[1, 2], [3, 9]]
    assert one(spark, arrays.sliced(xs, T.ArrayType(T.IntegerType()), step=-1), xs=[0, 1, 2]) == [2, 1, 0]
    assert one(spark, arrays.sliced(xs, T.ArrayType(T.IntegerType()), None, -1, -1), xs=[0, 1, 2]) == []
    assert one(spark, arrays.numbers(0)) == [] and one(spark, arrays.numbers(5, 0, -2)) == [5, 3, 1]
    assert one(spark, arrays.groupby(xs, lambda x: F.substring(x, 1, 1), S)[0]["grouper"], xs=["b", "Ax", "a"]) == "A"
    m = F.create_map(F.lit("b"), F.lit(2), F.lit("A"), F.lit(3), F.lit("c"), F.lit(1))
    assert [r.key for r in one(spark, arrays.dictsort(m, S, T.IntegerType()))] == ["A", "b", "c"]


def test_string_golden_values(spark):
    s = F.col("s")
    cases = [
        (strings.title(s), "foo-bar (BAZ)", "Foo-Bar (Baz)"),
        (strings.capitalize(s), "ßA", "Ssa"),
        (strings.center(s, 6), "abc", " abc  "),
        (strings.center(s, 5), "ab", "  ab "),
        (strings.trim(s, "x"), "xxaxx", "a"),
        (strings.truncate(s, 9, leeway=0), "foo bar baz qux", "foo..."),
        (strings.indent(s, 2), "a\n\nb", "a\n\n  b"),
        (strings.replace(s, "a", "x", 1), "aba", "xba"),
        (strings.replace(s, "", "-"), "ab", "-a-b-"),
        (strings.urlencode(s), "a b/c?~", "a%20b/c%3F~"),
        (strings.escape(s), "<a href='x'>&", "&lt;a href=&#39;x&#39;&gt;&amp;"),
        (strings.striptags(s), "<p>a <!-- x -->&amp;\n b</p>", "a & b"),
        (strings.wordwrap(s, 5), "foo bar", "foo\nbar"),
        (strings.printf("%05d", F.lit(42)), "", "00042"),
        (strings.printf("%r", s), "a", "'a'"),
    ]
    for column, text, wanted in cases:
        assert one(spark, column, s=text) == wanted


def test_numbers(spark):
    assert one(spark, values.rounded(F.lit(2.5))) == 2.0
    assert one(spark, values.rounded(F.lit(2.675), 2)) == 2.67
    assert one(spark, values.floor_div(F.lit(-7), F.lit(2))) == -4
    assert one(spark, values.floor_mod(F.lit(7), F.lit(-3))) == -2
    assert one(spark, values.to_int(F.lit("0x1f"), 0, 16)) == 31
    assert one(spark, values.to_int(F.lit("3.9"))) == 3 and one(spark, values.to_int(F.lit("x"), 5)) == 5
    assert one(spark, values.float_text(F.lit(1e16))) == "1e+16" and one(spark, values.float_text(F.lit(1e15))) == "1000000000000000.0"
    assert one(spark, values.equal(F.lit(float("nan")), F.lit(float("nan")), True)) is False
    assert one(spark, strings.filesizeformat(F.lit(1150))) == "1.1 kB" and one(spark, strings.filesizeformat(F.lit(1))) == "1 Byte"
    assert [one(spark, strings.filesizeformat(F.lit(n))) for n in (8750, 999050, 1275000000)] == ["8.8 kB", "999.0 kB", "1.3 GB"]
    assert one(spark, strings.filesizeformat(F.lit(1275000000), largest="MB")) == "1275.0 MB"
    assert one(spark, values.odd(F.lit(-3))) is True


def test_file_sizes_equal_python(spark):
    sizes = [*range(1000, 100000, 25), *range(10**6, 10**9, 7_250_000), *range(1024, 10**6, 1792)]
    rows_ = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", strings.filesizeformat(F.col("n")).alias("a"), strings.filesizeformat(F.col("n"), binary=True).alias("b")).collect()
    shown = lambda n, base, units: "%.1f %s" % ((n / base, units[0]) if n < base**2 else (n / base**2, units[1]))
    assert [(r.a, r.b) for r in rows_ if r.n >= 1024] == [(shown(n, 1000, ("kB", "MB")), shown(n, 1024, ("KiB", "MiB"))) for n in sizes if n >= 1024]


def test_sizes_of_many_pages_equal_their_sql(spark, tmp_path):
    """Page numbers from 667 on, whose sizes are over 1 GB."""
    import duckdb
    from test_queries import sorted_rows

    from colligate import queries

    duckdb.sql(f"COPY (SELECT range * 97 AS page_id, 'u' || range AS url, repeat('x', range * 125) AS html FROM range(700)) TO '{tmp_path}/pages.parquet'")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert sorted_rows(queries.QUERIES["fmt_printf_filesize"](spark, str(tmp_path)).toPandas()) == sorted_rows(db.sql(queries.SQL["fmt_printf_filesize"]).df())


def test_row_operators(spark):
    df = spark.createDataFrame([(1, "b", 2), (2, "A", 1), (3, "a", 3), (4, "B", 2)], "n long, k string, v int")
    assert [(r.grouper, [i.n for i in r["items"]]) for r in rows.groupby(df, "k", "n").collect()] == [("A", [2, 3]), ("b", [1, 4])]
    assert [r.n for r in rows.sort(df, "k", "n", reverse=True).collect()] == [1, 4, 2, 3]
    assert sorted(r.n for r in rows.unique(df, "k", "n").collect()) == [1, 2]
    assert rows.smallest(df, "k", "n").first().n == 2 and rows.largest(df, "k", "n").first().n == 1
    assert [r.first for r in (rows.loop(df, "n").select("loop.first").orderBy("first")).collect()] == [False, False, False, True]
    assert rows.first(df, "n").first().n == 1 and rows.last(df, "n").first().n == 4
    assert [r["items"] for r in rows.batch(df, "k", 3, "n", F.lit("-")).orderBy("batch").collect()] == [["b", "A", "a"], ["B", "-", "-"]]
    assert [r["items"] for r in rows.slices(df, "n", 3, "n").orderBy("slice").collect()] == [[1, 2], [3], [4]]
    assert [r.n for r in rows.until(df, "n", F.col("v") == 3).collect()] == [1, 2]
    assert [r.changed for r in rows.changed(df, "n", ["v"]).orderBy("n").collect()] == [True, True, True, True]
    assert [r.cycle for r in rows.cycle(df, "n", ["x", "y"]).orderBy("n").collect()] == ["x", "y", "x", "y"]
    assert rows.joined(df, "k", "n", ",").first().text == "b,A,a,B"
    empty = df.where("false")
    assert rows.smallest(empty, "k", "n").count() == rows.unique(empty, "k", "n").count() == rows.groupby(empty, "k", "n").count() == 0
    assert rows.total(empty, "v").first().total == 0


def test_checked_sum_raises(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        one(spark, arrays.total(F.col("xs"), T.LongType()), xs=[2**62, 2**62, 2**62])


def test_numbers_of_a_whole_table_without_one_task(spark):
    """Ranges of the order are numbered where they are, where there is a folder for checkpoints."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.range(50_000).repartition(7).select(F.hash("id").alias("k"), "id", F.create_map(F.lit("a"), "id").alias("m"))
        looped = rows.loop(df, ["k", "id"]).select("k", "id", "loop.*")
        wanted = {i: n for n, (_, i) in enumerate(sorted((r.k, r.id) for r in df.select("k", "id").collect()))}
        assert {r.id: r.index0 for r in looped.collect()} == wanted
        assert looped.where("length <> 50000 or index0 + revindex0 <> 49999 or first <> (index = 1) or last <> (index = 50000)").count() == 0
        sliced = rows.slices(df, "id", 7, ["k", "id"]).select("slice", F.size("items").alias("n")).orderBy("slice").collect()
        assert [r.n for r in sliced] == [7143] * 6 + [7142] and rows.batch(df, "id", 1000, ["k", "id"]).count() == 50
        assert rows.loop(df.where("false"), "k").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
