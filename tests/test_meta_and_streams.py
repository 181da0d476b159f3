import sqlite3

import pytest

from colligate.meta import describe
from colligate.plans.schema import SchemaError, parse_schema
from colligate.streaming import records as streams

SHOP = """
schema Shop [ version(1), db_init(sqlite, "INSERT INTO customer (c_custkey, c_name, c_acctbal, c_mktsegment) VALUES (1, 'Customer#1', -5, 2)") ];
enum Segment <uint8> { BUILDING = 1; MACHINERY = 2; }
[db_table(customer), db_check(ck_name, sqlite, "c_name LIKE 'Customer#%'")]
message Customer { [db_column(c_custkey), db_primary_key(1), db_generated(identity)] int64 key; [db_unique(1)] string c_name; int16 c_acctbal default 0; optional Segment c_mktsegment; }
[db_table(orders), db_foreign_key(fk_customer, Customer, o_custkey, key), db_index(idx_day, o_orderdate, o_custkey)]
message Order { [db_primary_key(1)] uint32 o_orderkey; int64 o_custkey; string o_orderdate; [db_ignore] optional string note; }
"""


def test_ddl_takes_the_tables_and_refuses_what_breaks_them():
    import duckdb

    db = sqlite3.connect(":memory:")
    db.execute("PRAGMA foreign_keys = ON")
    db.executescript(describe.ddl(parse_schema(SHOP), "sqlite"))
    sf = "/root/testdata/sf0.001"
    customers = duckdb.sql(f"SELECT c_custkey + 2, c_name, CAST(c_acctbal AS INT), CASE c_mktsegment WHEN 'BUILDING' THEN 1 END FROM '{sf}/customer.parquet'").fetchall()
    orders = duckdb.sql(f"SELECT o_orderkey, o_custkey + 2, CAST(o_orderdate AS VARCHAR) FROM '{sf}/orders.parquet'").fetchall()
    db.executemany("INSERT INTO customer (c_custkey, c_name, c_acctbal, c_mktsegment) VALUES (?, ?, ?, ?)", customers)
    db.executemany("INSERT INTO orders VALUES (?, ?, ?)", orders)
    assert db.execute("SELECT count(*) FROM customer").fetchone() == (len(customers) + 1,) and db.execute("SELECT c_mktsegment FROM customer WHERE c_custkey = 1").fetchone() == (2,)
    for wrong in ("INSERT INTO orders VALUES (-1, 1, 'x')", "INSERT INTO orders SELECT max(o_orderkey) + 1, -9, 'x' FROM orders", "INSERT INTO customer (c_name) VALUES ('Nobody')", "INSERT INTO customer (c_name) VALUES ('Customer#1')", "INSERT INTO customer (c_name, c_mktsegment) VALUES ('Customer#x', 3)"):
        with pytest.raises(sqlite3.IntegrityError):
            db.execute(wrong)
    text = describe.ddl(parse_schema(SHOP), "postgresql")
    assert text.index("CREATE TABLE") < text.index("CREATE INDEX") < text.index("ALTER TABLE") and "note" not in text


def test_spark_ddl(spark):
    for statement in describe.ddl(parse_schema("[db_table(cg_t)] message T { int32 a; optional string b; }"), "spark").split(";"):
        if statement.strip():
            spark.sql(statement)
    assert spark.table("cg_t").columns == ["a", "b"]
    spark.sql("DROP TABLE cg_t")


@pytest.mark.parametrize(
    "text",
    [
        "[db_table(t)] message T { list<int32> a; }",
        "[db_table(t)] message T { [db_primary_key(2)] int32 a; }",
        '[db_table(t), db_check(c, sqlite, "1); DROP TABLE x")] message T { int32 a; }',
        "[db_table(t), db_foreign_key(f, U, a, b)] message T { int32 a; } [db_table(u)] message U { int32 b; }",
    ],
)
def test_wrong_tables_are_rejected(text):
    with pytest.raises(SchemaError):
        describe.ddl(parse_schema(text), "sqlite")


def test_openapi_and_declarations():
    c = parse_schema('schema Api [version(1)]; message Req { @Min(1) uint32 id; @Size(min = 2, max = 16) @Pattern("^[a-z]+$") string name; optional nullable string nick; optional string loc default "en"; } message Res { uint32 id; } message Err { string what; } service Users { Create: Req -> Res throws Err; }')
    doc = describe.openapi(c)
    req = doc["components"]["schemas"]["Req"]
    assert req["required"] == ["id", "name"] and req["properties"]["name"] == {"type": "string", "minLength": 2, "maxLength": 16, "pattern": "^[a-z]+$"}
    assert req["properties"]["nick"]["type"] == ["string", "null"] and doc["paths"]["/Users/Create"]["post"]["responses"].keys() == {"200", "default"}
    for language, part in (("python", "nick: str | None"), ("typescript", "nick?: string | null"), ("go", "Id uint32"), ("rust", "pub nick: Option<String>")):
        assert part in describe.declarations(c, language)


def test_reflection_and_keys(spark):
    c = parse_schema(SHOP)
    assert describe.fields(spark, c).count() == 8 and describe.enum_items(spark, c).count() == 2
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1,), (1,)], "p long")
    assert [r.k for r in describe.orphans(child, parent, ["k"], ["p"]).collect()] == [2]
    assert [(r.p, r.n) for r in describe.key_duplicates(parent, "p").collect()] == [(1, 2)]


def test_streams(spark, tmp_path):
    c = parse_schema("message R { int32 a; }")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"a":1}\n{"a":2}\n{"a":3}\n')
    stream = lambda: streams.bound(streams.read_lines(spark, str(tmp_path / "in")), c, "R").select("record.*")
    seen = []
    n, last = streams.run(stream(), lambda r: (seen.append(r.a), streams.Action.STOP if r.a == 2 else streams.Action.CONTINUE)[1])
    assert (seen, n, last) == ([1, 2], 2, streams.Action.STOP)
    seen = []
    n, last = streams.run(stream(), lambda r: (seen.append(r.a), streams.Action.CANCEL)[1], checkpoint=str(tmp_path / "at"))
    assert (seen, n, last) == ([1], 1, streams.Action.CANCEL)
    assert streams.run(stream(), lambda r: streams.Action.CONTINUE, checkpoint=str(tmp_path / "at"))[0] == 3  # nothing was committed
    with pytest.raises(Exception, match="failed the stream"):
        streams.run(stream(), lambda r: streams.Action.ERROR)
    with pytest.raises(Exception, match="too many"):
        streams.run(stream(), lambda r: streams.Action.CONTINUE, streams.Limits(results=1))
    assert sorted(r.a for r in streams.retained(stream(), "cg_kept").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        streams.bound(streams.read_lines(spark, str(tmp_path / "in")), c, "R", "xml", select="path")
    long = parse_schema("message R { optional int32 a; optional list<string> t; }")
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "x.json").write_text('{"t":["x","' + "y" * 50 + '"]}\n')
    for limits, what in ((streams.Limits(field_bytes=49), "field"), (streams.Limits(record_bytes=60), "record")):
        with pytest.raises(Exception, match=f"{what} is too long"):
            streams.retained(streams.bound(streams.read_lines(spark, str(tmp_path / "long")), long, "R", limits=limits).select("record.*"), f"cg_{what}")
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "x.csv").write_text("a,b\n1,x\n2,y\n")
    rows = streams.bound(streams.read_csv(spark, str(tmp_path / "csv"), ["a", "b"], 'b == "y"'), c, "R", "csv")
    assert [r.record.a for r in streams.retained(rows.select("record"), "cg_csv").collect()] == [2]
