"""More of the engine's queries: one for each operator that the first ones leave out, in groups of a kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .functions import formats, strings, temporal, values
from .meta import describe
from .operators import arrays, rows
from .plans import columns, projection, validation
from .plans.schema import TypeRef, parse_schema
from .queries import long, query, table
from .sinks import records as sinks
from .sources import records as sources

CONTRACT = parse_schema("""
schema Shop [version(1)];
enum Flag <uint8> { R = 1; A = 2; N = 3; }
flags Traits { Big; Cheap; Even; }
composite Place { int32 number; string side; }
union Amount { int64 whole; string text; }
message Line { @Min(1) @Max(7) int32 line; Flag flag; optional nullable double price; Place at; list<int32> sizes; map<string,int64> keys; Amount amount; optional string note; }
message Order { int64 id; optional date day; @Size(min = 1, max = 20) string priority; }
message Batch { list<Order> orders; }
""")


# --- records with nulls, nested values, lists, maps and unions, there and back ---


def _lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem")
    number = F.col("l_linenumber")
    line = F.struct(
        number.alias("line"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END").alias("flag"),
        F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).alias("price"),
        F.struct(number.alias("number"), F.col("l_linestatus").alias("side")).alias("at"),
        F.array(number, number + 1).alias("sizes"),
        F.create_map(F.lit("part"), F.col("l_partkey"), F.lit("supp"), F.col("l_suppkey")).alias("keys"),
        F.struct(F.when(number % 2 == 0, F.col("l_orderkey")).alias("whole"), F.when(number % 2 == 1, F.concat(F.lit("<o> & "), F.col("l_orderkey").cast("string"))).alias("text")).alias("amount"),
        F.lit(None).cast("string").alias("note"),
    )
    return c.select("l_orderkey", "l_linenumber", "l_partkey", line.alias("held"))


_LINES_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS flag, CASE WHEN l_discount > 0.02 THEN l_extendedprice END AS price, l_linestatus AS side,
CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_linenumber + 1 AS VARCHAR) AS sizes, l_suppkey AS supp, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_orderkey AS VARCHAR) END AS whole, CASE WHEN l_linenumber % 2 = 1 THEN '<o> & ' || CAST(l_orderkey AS VARCHAR) END AS text FROM lineitem"""


def _shown(read: DataFrame) -> DataFrame:
    r = F.col("record")
    return read.select(
        "l_orderkey", "l_linenumber", r["keys"]["part"].alias("l_partkey"), r["flag"].cast("int").alias("flag"), r["price"].alias("price"), r["at"]["side"].alias("side"),
        F.array_join(r["sizes"].cast("array<string>"), ",").alias("sizes"), r["keys"]["supp"].alias("supp"), r["amount"]["whole"].cast("string").alias("whole"), r["amount"]["text"].alias("text"),
    )


@query(_LINES_SQL)
def json_nested_round_trip(spark: SparkSession, d: str) -> DataFrame:
    text = _lines(spark, d).withColumn("raw", sinks.to_json(CONTRACT, "Line", F.col("held")))
    return _shown(sources.read_json(text, "raw", CONTRACT, "Line"))


@query(_LINES_SQL + " WHERE l_orderkey < 2000")
def yaml_nested_round_trip(spark: SparkSession, d: str) -> DataFrame:
    text = _lines(spark, d).where("l_orderkey < 2000").withColumn("raw", sinks.to_yaml(CONTRACT, "Line", F.col("held")))
    return _shown(sources.read_yaml(text, "raw", CONTRACT, "Line"))


# --- JSON selections, strictness, quarantine ---


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    one = F.struct(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("priority"))
    return o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("orders"))


@query("SELECT o_custkey, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS at, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def json_array_of_records(spark: SparkSession, d: str) -> DataFrame:
    raw = _orders(spark, d).select("o_custkey", F.to_json("orders").alias("raw"))
    found = sources.read_json(raw, "raw", CONTRACT, "Order", select="all")
    return found.select("o_custkey", "record.id", long("ordinal").alias("at"), F.col("record.day").cast("string").alias("day"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT 'union' AS path, o_custkey, o_orderkey AS id FROM o WHERE n IN (1, 2) UNION ALL SELECT 'index', o_custkey, o_orderkey FROM o WHERE n = 2
UNION ALL SELECT 'all', o_custkey, o_orderkey FROM o UNION ALL SELECT 'last', o_custkey, o_orderkey FROM o WHERE back = 1 UNION ALL SELECT 'first', o_custkey, o_orderkey FROM o WHERE n = 1
UNION ALL SELECT 'both', o_custkey, o_orderkey FROM o WHERE o_orderkey > 100 AND o_orderkey < 200""")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    raw = _orders(spark, d).select("o_custkey", F.to_json(F.struct("orders")).alias("raw"))
    out = None
    for name, path, first in (("union", "$.orders[0,1]", False), ("index", "$.orders[1]", False), ("all", "$.orders[*]", False), ("last", "$.orders[-1]", False), ("first", "$.orders[*]", True), ("both", "$.orders[?(@.id > 100 && @.id < 200)]", False)):
        found = sources.read_json(raw, "raw", CONTRACT, "Order", select="path_first" if first else "path", path=path)
        found = found.select(F.lit(name).alias("path"), "o_custkey", "record.id")
        out = found if out is None else out.union(found)
    return out


@query("""SELECT o_orderkey, o_orderkey % 3 = 1 AS typed, o_orderkey % 3 = 2 AS known, o_orderkey % 5 = 0 AS missing FROM orders""")
def json_strict_options(spark: SparkSession, d: str) -> DataFrame:
    """A number as text is refused where exact types are asked for, a field too many where fields must be known."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    id_ = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    more = F.when(F.col("o_orderkey") % 3 == 2, ',"zz":1').otherwise("")
    priority = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(',"priority":"x"')
    raw = o.select("o_orderkey", F.concat(F.lit('{"id":'), id_, more, priority, F.lit("}")).alias("raw"))
    read = lambda **options: sources.read_json(raw, "raw", CONTRACT, "Order", mode="quarantine", **options)
    has = lambda path: F.exists("errors", lambda e: e["path"] == path)
    exact = read(exact=True).select("o_orderkey", has("id").alias("typed"), has("priority").alias("missing"))
    known = read(reject_unknown=True).select("o_orderkey", F.exists("errors", lambda e: e["path"] != "priority").alias("known"))
    return exact.join(known, "o_orderkey").select("o_orderkey", "typed", "known", "missing")


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <= 49 GROUP BY event_type")
def bind_drop_invalid_group(spark: SparkSession, d: str) -> DataFrame:
    """Bind, validate, keep what is valid, group."""
    contract = parse_schema("message Props { @Min(0) @Max(49) uint32 k; }")
    bound = sources.read_json(table(spark, d, "events"), "props", contract, "Props", mode="drop")
    return validation.validate(bound, contract, "Props").where("is_valid").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS low FROM lineitem")
def validate_nested_rules(spark: SparkSession, d: str) -> DataFrame:
    contract = parse_schema("message In { @Min(10) int32 q; } message Out { list<In> ins; map<string,In> named; In one; }")
    q = F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(10)
    record = F.struct(F.array(F.struct(F.lit(11).alias("q")), F.struct(q.alias("q"))).alias("ins"), F.create_map(F.lit("k"), F.struct(q.alias("q"))).alias("named"), F.struct(q.alias("q")).alias("one"))
    found = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", validation.violations(contract, "Out", record).alias("v"))
    paths = F.transform("v", lambda x: x["path"])
    low = (F.size("v") == 3) & F.array_contains(paths, "ins[1].q") & F.array_contains(paths, "named.k.q") & F.array_contains(paths, "one.q")
    return found.select("l_orderkey", "l_linenumber", (low & (F.size("v") > 0)).alias("low"))


# --- YAML and XML paths ---


@query("SELECT o_custkey, o_orderkey AS id FROM orders WHERE o_custkey < 200 AND o_orderkey >= 50")
def yaml_paths(spark: SparkSession, d: str) -> DataFrame:
    held = _orders(spark, d).where("o_custkey < 200").select("o_custkey", F.struct("orders").alias("b"))
    raw = held.select("o_custkey", F.concat(F.lit("orders:\n"), F.array_join(F.transform("b.orders", lambda x: F.concat(F.lit("- id: "), x["id"].cast("string"), F.lit("\n  priority: "), x["priority"])), "\n"), F.lit("\n")).alias("raw"))
    return sources.read_yaml(raw, "raw", CONTRACT, "Order", select="path", path="$.orders[?(@.id >= 50)]").select("o_custkey", "record.id")


@query("SELECT o_custkey, o_orderkey AS id, o_orderpriority || ' & <' AS priority FROM orders WHERE o_custkey < 200")
def xml_paths(spark: SparkSession, d: str) -> DataFrame:
    """Nested elements, entities and character data."""
    one = lambda x: F.concat(F.lit('<q><Order id="'), x["id"].cast("string"), F.lit('"><priority>'), x["priority"], F.lit(" &amp; <![CDATA[<]]></priority></Order></q>"))
    raw = _orders(spark, d).where("o_custkey < 200").select("o_custkey", F.concat(F.lit("<r>"), F.array_join(F.transform("orders", one), ""), F.lit("</r>")).alias("raw"))
    return sources.select_xml(raw, "raw", "//Order", CONTRACT, "Order").select("o_custkey", "record.id", "record.priority")


# --- string formats ---


@query("""SELECT event_id, user_id % 40 <= 32 AS cidr, event_id % 3 <> 0 AS email, event_id % 2 = 0 AS mac, user_id % 4 > 0 AS hostname, user_id % 4 > 1 AS domain, event_id % 5 > 0 AS hex, event_id % 4 = 0 AS base64, event_id % 4 <> 1 AS base64url,
event_id % 2 = 0 AS currency, event_id % 2 = 0 AS pointer, event_id % 3 > 0 AS cron, event_id % 3 = 0 AS color, event_id % 2 = 1 AS mime, event_id % 2 = 0 AS ipv6, event_id % 2 = 0 AS jsonpath, event_id % 2 = 1 AS regex FROM events""")
def format_checks_all(spark: SparkSession, d: str) -> DataFrame:
    e, i, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), ((i % n) + 1).cast("int"))
    made = {
        "cidr": F.concat(F.lit("10.0.0.0/"), (u % 40).cast("string")),
        "email": F.concat(F.lit("user"), u.cast("string"), pick(3, "@host", "@a.org", "@b-c.example.net")),
        "mac": F.concat(F.lit("00:1A:2b:33:44:"), pick(2, "0f", "0g")),
        "hostname": F.element_at(F.array(*map(F.lit, ("-bad", "plain", "a.b-c", "x1.y2.z3"))), ((u % 4) + 1).cast("int")),
        "domain": F.element_at(F.array(*map(F.lit, ("-bad", "plain", "a.b-c", "x1.y2.z3"))), ((u % 4) + 1).cast("int")),
        "hex": F.concat(F.hex(i), pick(5, "g", "", "0", "aF", "9")),
        "base64": F.concat(F.lit("QUJD"), pick(4, "QQ==", "Q", "QU", "QUI")),
        "base64url": F.concat(F.lit("Q-_D"), pick(4, "", "Q", "QU", "QUI")),
        "currency": pick(2, "EUR", "eur"),
        "pointer": pick(2, "/a/b~1c/0", "a/b"),
        "cron": pick(3, "* *", "*/5 0 * * 1-5", "0 0 12 * * ?"),
        "color": pick(3, "#a1B2c3", "#12", "red"),
        "mime": pick(2, "text", "text/html; charset=utf-8"),
        "ipv6": pick(2, "2001:db8::1", "2001:db8:::1"),
        "jsonpath": pick(2, "$.a[?(@.b == ')')]", "$.a[1"),
        "regex": pick(2, "[a-", "^a+(b|c)$"),
    }
    names = {"pointer": "json_pointer", "ipv6": "ip"}
    return e.select("event_id", *[formats.matches_format(c, names.get(n, n)).alias(n) for n, c in made.items()])


# --- temporals and values ---


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts, '%H:%M:%S') || '.000' AS clock, event_id % 2 = 0 AS good, CAST((event_id % 25) * 3600000 + 90000 AS BIGINT) AS span FROM events")
def temporal_dates_and_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    day = temporal.parse_date(F.date_format("ts", "yyyy-MM-dd"))
    clock = temporal.parse_time(F.date_format("ts", "H:m:s"))
    good = temporal.parse_date(F.when(F.col("event_id") % 2 == 0, "2024-02-29").otherwise("2023-02-29")).isNotNull()
    span = temporal.parse_duration(F.concat((F.col("event_id") % 25).cast("string"), F.lit("h1m30s")))
    return e.select("event_id", day.cast("string").alias("day"), clock.alias("clock"), good.alias("good"), span.alias("span"))


@query("""SELECT c_custkey, c_nationkey % 2 = 0 AS even, c_acctbal > 0 AS sign, c_nationkey <> 0 AS truth, length(c_name) > 0 AS named, c_nationkey % 3 <> 0 AS held, CAST(c_custkey * c_custkey AS BIGINT) AS squared, CAST(-c_custkey AS BIGINT) AS minus,
CAST(c_acctbal AS VARCHAR) AS shown, CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS flag, c_nationkey IN (1, 2, 3) AS listed, c_mktsegment = 'BUILDING' AS same FROM customer""")
def value_rules(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), F.col("c_nationkey")
    positive = values.less(F.lit(0.0), F.col("c_acctbal"), True)
    sometimes = F.when(n % 3 != 0, F.array(n)).otherwise(F.array().cast("array<int>"))
    return c.select(
        "c_custkey", values.even(n).alias("even"), values.truthy(positive, T.BooleanType()).alias("sign"), values.truthy(n, T.IntegerType()).alias("truth"), values.truthy(F.col("c_name"), T.StringType()).alias("named"),
        values.truthy(sometimes, T.ArrayType(T.IntegerType())).alias("held"), values.power(F.col("c_custkey"), F.lit(2)).alias("squared"), (-F.col("c_custkey")).alias("minus"),
        values.text(F.col("c_acctbal"), T.DoubleType()).alias("shown"), values.text(positive, T.BooleanType()).alias("flag"),
        values.contains(F.array(*map(F.lit, (1, 2, 3))), n, T.ArrayType(T.IntegerType())).alias("listed"), values.test("sameas", F.col("c_mktsegment"), T.StringType(), F.lit("BUILDING")).alias("same"),
    )


@query("""SELECT c_custkey, true AS a, true AS b, true AS c, true AS d, false AS e, true AS f, c_nationkey % 2 = 0 AS g, c_nationkey % 2 = 1 AS h, c_acctbal > 0 AS i, c_nationkey <= 7 AS j, c_nationkey >= 7 AS k, c_nationkey <> 7 AS l FROM customer""")
def value_tests(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), F.col("c_nationkey")
    maybe = F.when(n % 2 == 0, n)
    t = lambda name, x, kind, *args: values.test(name, x, kind, *args)
    i, s = T.IntegerType(), T.StringType()
    found = [
        t("integer", n, i), t("float", F.col("c_acctbal"), T.DoubleType()), t("string", F.col("c_name"), s), t("sequence", F.array(n), T.ArrayType(i)) & t("iterable", F.array(n), T.ArrayType(i)), t("callable", n, i),
        t("mapping", F.create_map(F.lit("a"), n), T.MapType(s, i)) & t("number", n, i), t("defined", maybe, i), t("none", maybe, i), t("true", F.col("c_acctbal") > 0, T.BooleanType()),
        t("le", n, i, F.lit(7)), t("ge", n, i, F.lit(7)), t("ne", n, i, F.lit(7)),
    ]
    return c.select("c_custkey", *[x.alias("abcdefghijkl"[k]) for k, x in enumerate(found)])


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber & 5 AS BIGINT) <> 0 AS any_bit, CAST(l_linenumber & 5 AS BIGINT) = 5 AS all_bits, l_linenumber % 2 = 0 AS same FROM lineitem")
def value_flags_and_hashes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    one = F.create_map(F.lit("a"), n, F.lit("b"), n + 1)
    two = F.create_map(F.lit("b"), n + 1, F.lit("a"), F.when(n % 2 == 0, n).otherwise(0))
    ref = TypeRef("map", (TypeRef("string"), TypeRef("int32")))
    same = projection.same_value(CONTRACT, ref, one, two)
    hashed = projection.value_hash(CONTRACT, ref, one) == projection.value_hash(CONTRACT, ref, two)
    found = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", projection.has_any_bits(n, 5).alias("any_bit"), projection.has_all_bits(n, 5).alias("all_bits"), same.alias("same"), hashed.alias("h"))
    return found.where("same = h").drop("h")


@query("""SELECT l_orderkey, l_linenumber, 'line' AS name, CAST(l_linenumber AS VARCHAR) AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'side', '"' || l_linestatus || '"' FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'sizes', CAST(CAST(p AS INTEGER) + l_linenumber AS VARCHAR) FROM lineitem, (SELECT unnest([0, 1]) AS p) UNION ALL SELECT l_orderkey, l_linenumber, 'part', CAST(l_partkey AS VARCHAR) FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'supp', CAST(l_suppkey AS VARCHAR) FROM lineitem""")
def value_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a record, the values of a list and the entries of a map as rows."""
    held = _lines(spark, d)
    body = lambda x: F.regexp_extract(x, r'^\{"v":(.*)\}$', 1)
    line = held.select("l_orderkey", "l_linenumber", F.explode(projection.fields(CONTRACT, "Line", F.col("held"))).alias("f")).where("f.name = 'line'").select("l_orderkey", "l_linenumber", F.lit("line").alias("name"), body(F.col("f.value")).alias("value"))
    side = held.select("l_orderkey", "l_linenumber", F.explode(projection.fields(CONTRACT, "Place", F.col("held.at"))).alias("f")).where("f.name = 'side'").select("l_orderkey", "l_linenumber", F.lit("side").alias("name"), body(F.col("f.value")).alias("value"))
    sizes = held.select("l_orderkey", "l_linenumber", F.explode(projection.values(F.col("held.sizes"))).alias("v")).select("l_orderkey", "l_linenumber", F.lit("sizes").alias("name"), F.col("v.value").cast("string").alias("value"))
    keys = held.select("l_orderkey", "l_linenumber", F.explode(projection.entries(F.col("held.keys"))).alias("e")).select("l_orderkey", "l_linenumber", F.col("e.key").alias("name"), F.col("e.value").cast("string").alias("value"))
    return line.union(side).union(sizes).union(keys)


# --- collections ---


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber DESC) AS back, string_agg(CAST(l_linenumber * 10 AS VARCHAR), ',' ORDER BY l_linenumber) AS mapped,
coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (WHERE l_linenumber % 2 = 1), '') AS odd, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (WHERE l_linenumber % 2 = 0), '') AS rest,
CAST(ceil(count(*) / 3.0) AS BIGINT) AS batches, arg_min(l_linenumber, l_linenumber) AS head, arg_max(l_linenumber, l_linenumber) AS tail, '0,1,2' AS range FROM lineitem GROUP BY l_orderkey""")
def coll_more_array_forms(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("xs"))
    xs, i = F.col("xs"), T.IntegerType()
    shown = lambda c: arrays.joined(c, ",")
    odd = lambda x: values.odd(x)
    return items.select(
        "l_orderkey", long(arrays.length(xs, T.ArrayType(i))).alias("n"), shown(arrays.reverse(xs)).alias("back"), shown(arrays.mapped(xs, lambda x: x * 10)).alias("mapped"), shown(arrays.select(xs, odd)).alias("odd"), shown(arrays.reject(xs, odd)).alias("rest"),
        long(F.size(arrays.batch(xs, 3))).alias("batches"), arrays.first(arrays.listed(xs, T.ArrayType(i))).alias("head"), arrays.item(xs, -1, T.ArrayType(i)).alias("tail"), shown(arrays.numbers(3)).alias("range"),
    )


@query("""SELECT o_custkey, string_agg(g, ';' ORDER BY o_orderstatus) AS grouped FROM (SELECT o_custkey, o_orderstatus, o_orderstatus || '=' || CAST(count(*) AS VARCHAR) AS g FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey""")
def coll_array_groupby(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("xs"))
    groups = arrays.groupby(F.col("xs"), lambda x: x["o_orderstatus"], T.StringType())
    return held.select("o_custkey", F.array_join(F.transform(groups, lambda g: F.concat(g["grouper"], F.lit("="), F.size(g["list"]).cast("string"))), ";").alias("grouped"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN 'b' ELSE 'A' END AS least, CASE WHEN c_nationkey < 12 THEN 'A' ELSE 'b' END AS most, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS filled FROM customer""")
def coll_dictsort_by_value(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    m = F.create_map(F.lit("A"), F.lit(12), F.lit("b"), F.col("c_nationkey"))
    pairs = arrays.dictsort(m, T.StringType(), T.IntegerType(), by="value")
    filled = rows.mapped(c.withColumn("maybe", F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey").cast("string"))), "maybe", "filled", default="x")
    return filled.select("c_custkey", pairs[0]["key"].alias("least"), pairs[1]["key"].alias("most"), "filled")


@query("""SELECT 'first' AS side, o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1) UNION ALL SELECT 'last', o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""")
def coll_first_last_rows(spark: SparkSession, d: str) -> DataFrame:
    o, order = table(spark, d, "orders"), ["o_orderdate", "o_orderkey"]
    return rows.first(o, order).select(F.lit("first").alias("side"), "o_orderkey").union(rows.last(o, order).select(F.lit("last").alias("side"), "o_orderkey"))


@query("SELECT conv_id, turn, 2 AS depth, 1 AS depth0, row_number() OVER w - 1 AS index0, count(*) OVER (PARTITION BY conv_id) - row_number() OVER w AS rev0, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def loop_depth_and_last(spark: SparkSession, d: str) -> DataFrame:
    c = rows.loop(table(spark, d, "conversations").select("conv_id", "turn"), "turn", ["conv_id"], depth=2)
    return c.select("conv_id", "turn", "loop.depth", "loop.depth0", "loop.index0", F.col("loop.revindex0").alias("rev0"), F.col("loop.last").alias("is_last"))


# --- texts ---


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titled, p_name || chr(10) || '    ' || p_brand AS indented, CASE WHEN length(p_brand || ' ' || CAST(p_size AS VARCHAR)) <= 10 THEN p_brand || ' ' || CAST(p_size AS VARCHAR) ELSE p_brand || chr(10) || CAST(p_size AS VARCHAR) END AS wrapped,
' id="' || CAST(p_partkey AS VARCHAR) || '" name="' || p_name || '"' AS attributes, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE p_type END AS filled, CASE WHEN length(p_name) > 9 THEN regexp_extract(substr(p_name, 1, 6), '^[^ ]+') || '...' ELSE p_name END AS cut, repeat(' ', (21 - length(p_brand)) // 2 + CASE WHEN length(p_brand) % 2 = 0 THEN 1 ELSE 0 END) || p_brand || repeat(' ', (21 - length(p_brand)) // 2) AS middle FROM part""")
def str_title_indent_wrap_attributes(spark: SparkSession, d: str) -> DataFrame:
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    attributes = strings.xmlattr(F.create_map(F.lit("id"), F.col("p_partkey").cast("string"), F.lit("name"), name, F.lit("none"), F.lit(None).cast("string")))
    filled = F.coalesce(F.when(F.col("p_size") % 2 == 1, F.col("p_type")), F.lit("none"))
    return table(spark, d, "part").select(
        "p_partkey", strings.title(name).alias("titled"), strings.indent(F.concat(name, F.lit("\n"), brand)).alias("indented"), strings.wordwrap(F.concat(brand, F.lit(" "), size), 10).alias("wrapped"),
        attributes.alias("attributes"), filled.alias("filled"), strings.truncate(name, 9, leeway=0).alias("cut"), strings.center(brand, 21).alias("middle"),
    )


@query("""SELECT page_id, 'see <a href="' || replace(url, '&', '&amp;') || '" rel="noopener">' || replace(url, '&', '&amp;') || '</a> now' AS linked, '{"url":"' || replace(url, '&', '\\u0026') || '"}' AS json, replace(url_encode(url), '%2F', '/') || '' AS encoded FROM pages""")
def str_urlize_tojson(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", strings.urlize(F.concat(F.lit("see "), url, F.lit(" now"))).alias("linked"), strings.tojson(F.to_json(F.struct("url"))).alias("json"), strings.urlencode(url).alias("encoded"))


# --- templates ---


@query("""SELECT c_custkey, CAST(c_nationkey / 2.0 AS VARCHAR) || '|' || CAST(c_nationkey * c_nationkey AS VARCHAR) || '|' || CASE WHEN c_acctbal > 0 THEN 'has' ELSE 'owes' END || '|' || CASE WHEN 1 < c_nationkey AND c_nationkey < 9 THEN 'True' ELSE 'False' END || '|' || CAST(-c_nationkey AS VARCHAR) || '|' || CASE WHEN c_nationkey IN (1, 2) THEN 'True' ELSE 'False' END AS line FROM customer""")
def render_operators_row(spark: SparkSession, d: str) -> DataFrame:
    template = "{{ c_nationkey / 2 }}|{{ c_nationkey ** 2 }}|{{ 'has' if c_acctbal > 0 else 'owes' }}|{{ 1 < c_nationkey < 9 }}|{{ -c_nationkey }}|{{ c_nationkey in [1, 2] }}"
    return columns.render_rows(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), template, "line").select("c_custkey", "line")


_STATEMENTS = """{%- macro cell(x, end=';') %}[{{ x }}]{{ end }}{% endmacro -%}
{%- set ns = namespace(total=0) -%}
{%- for x in xs %}{% if x == 2 %}{% continue %}{% endif %}{% set ns.total = ns.total + x %}{{ cell(x, end=',' if not loop.last else '.') }}{% else %}none{% endfor -%}
={{ ns.total }}{% with y = c_nationkey %}<{{ y }}>{% endwith %}{% filter upper %}{{ c_name }}{% endfilter %}{% raw %}{{ }}{% endraw %}{# note #}{% set t %}a{{ c_nationkey }}{% endset %}{{ t|e }}{{ missing|default('d') }}"""


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN '[1],[3].=4' ELSE 'none=0' END || '<' || CAST(c_nationkey AS VARCHAR) || '>' || upper(c_name) || '{{ }}a' || CAST(c_nationkey AS VARCHAR) || 'd' AS line FROM customer""")
def render_statements_row(spark: SparkSession, d: str) -> DataFrame:
    xs = F.when(F.col("c_nationkey") % 2 == 0, F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array().cast("array<int>"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", xs.alias("xs"))
    return columns.render_rows(c, _STATEMENTS, "line", by_value=True).select("c_custkey", "line")


# --- metadata ---


@query("""SELECT * FROM (VALUES ('Order', 0, 'id', 'int64', false), ('Order', 1, 'day', 'date', true), ('Order', 2, 'priority', 'string', false), ('Batch', 0, 'orders', 'list<Order>', false), ('Place', 0, 'number', 'int32', false), ('Place', 1, 'side', 'string', false)) AS t(type, position, field, field_type, optional)""")
def reflection_of_fields(spark: SparkSession, d: str) -> DataFrame:
    found = describe.fields(spark, CONTRACT).where(F.col("type").isin("Order", "Batch", "Place"))
    return found.select("type", "position", "field", "field_type", "optional")


@query("SELECT * FROM (VALUES ('Flag', 0, 'R', CAST(1 AS BIGINT), false), ('Flag', 1, 'A', 2, false), ('Flag', 2, 'N', 3, false), ('Traits', 0, 'Big', 1, true), ('Traits', 1, 'Cheap', 2, true), ('Traits', 2, 'Even', 4, true)) AS t(enum, position, item, value, flags)")
def reflection_of_enums(spark: SparkSession, d: str) -> DataFrame:
    return describe.enum_items(spark, CONTRACT).select("enum", "position", "item", "value", "flags")


_TABLES = parse_schema("""
schema Tables [version(1)];
[db_table(customer)] message Customer { [db_primary_key(1)] int64 key; string name; optional double balance; }
[db_table(orders), db_foreign_key(fk_customer, Customer, customer, key)] message Order { [db_primary_key(1)] int64 key; int64 customer; optional string note; }
service Shop { Place: Order -> Customer throws Order; }
""")


@query("""SELECT * FROM (VALUES ('Customer', 'key', 'BIGINT', true), ('Customer', 'name', 'STRING', true), ('Customer', 'balance', 'DOUBLE', false), ('orders', 'key', 'BIGINT', true), ('orders', 'customer', 'BIGINT', true), ('orders', 'note', 'STRING', false)) AS t(owner, name, kind, required) WHERE owner = 'orders' UNION ALL
SELECT 'customer', 'key', 'BIGINT', true UNION ALL SELECT 'customer', 'name', 'STRING', true UNION ALL SELECT 'customer', 'balance', 'DOUBLE', false""")
def ddl_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the tables that the contract's DDL makes, read from its text."""
    text = spark.createDataFrame([(describe.ddl(_TABLES, "spark"),)], "ddl string").select(F.explode(F.split("ddl", ";")).alias("s"))
    made = text.select(F.regexp_extract("s", r"(?s)CREATE TABLE\s+(?:IF NOT EXISTS\s+)?`(\w+)`", 1).alias("owner"), F.regexp_extract_all("s", F.lit(r"`(\w+)` ([A-Z]+)( NOT NULL)?"), F.lit(0)).alias("lines")).where("owner <> ''")
    line = made.select("owner", F.explode("lines").alias("line"))
    part = lambda i: F.regexp_extract("line", r"`(\w+)` ([A-Z]+)( NOT NULL)?", i)
    return line.select("owner", part(1).alias("name"), part(2).alias("kind"), (part(3) != "").alias("required")).where("kind <> 'USING'")


@query("""SELECT * FROM (VALUES ('/Shop/Place', 'post', 'Order')) AS t(path, verb, request)""")
def openapi_paths(spark: SparkSession, d: str) -> DataFrame:
    import json

    doc = describe.openapi(_TABLES)
    found = [(path, verb, json.dumps(op["requestBody"]).rpartition("/")[2].split('"')[0]) for path, verbs in doc["paths"].items() for verb, op in verbs.items()]
    return spark.createDataFrame(found, "path string, verb string, request string")


@query("SELECT * FROM (VALUES ('Shop', 'service', 'Place', 'Order', 'Customer', 'Order')) AS t(service, kind, method, request, response, throws)")
def reflection_of_methods(spark: SparkSession, d: str) -> DataFrame:
    return describe.methods(spark, _TABLES).withColumn("throws", F.array_join("throws", ","))
