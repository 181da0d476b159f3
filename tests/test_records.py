"""Records of the part and events tables, through every format and back."""

import datetime

import pytest
from pyspark.sql import functions as F

from colligate.plans.projection import admit, same_value, value_hash
from colligate.plans.schema import SchemaError, TypeRef, parse_schema
from colligate.plans.selection import Limits, QueryError, QueryLimit, compile_path, row_filter
from colligate.plans.validation import validate
from colligate.sinks import records as sinks
from colligate.sources import records as sources

SF = "/root/testdata/sf0.001"
C = parse_schema(
    """
schema Catalogue [version(1)];
enum Grade <uint8> { ECONOMY = 10; STANDARD = 20; PROMO = 30; MEDIUM = 40; LARGE = 50; SMALL = 60; }
flags Shelf { Top; Front; Sale; }
composite Tag { double retail; }
union Origin { [name(madeBy), alias(maker)] string brand; int32 number; }
message Part {
  [name("part-key"), alias(partkey)] int64 p_partkey; string p_name; Grade p_type; int32 p_size; optional Tag tag;
  optional Shelf shelf default Front; optional nullable string note; optional list<string> words;
  optional map<string,int64> stock; optional Origin origin; optional uint64 code;
}
message Event { int64 event_id; datetime ts; optional date day; optional duration lag; optional decimal value; optional time clock; }
"""
)


@pytest.fixture(scope="module")
def parts(spark):
    """The part table as records: some without a note, some with a NULL one, by number or by brand."""
    p, size = spark.read.parquet(f"{SF}/part.parquet"), F.col("p_size")
    grades = F.create_map(*[F.lit(x) for n, v in C.enums["Grade"].items for x in (n, v)])
    record = F.struct(
        "p_partkey", "p_name", grades[F.col("p_type")].cast("int").alias("p_type"), "p_size", F.struct(F.col("p_retailprice").alias("retail")).alias("tag"), (size % 7 + 1).alias("shelf"),
        F.when(size % 3 == 0, F.concat(F.lit('a "b", <'), "p_name")).alias("note"), F.split("p_name", " ").alias("words"), F.create_map(F.lit("east"), F.col("p_partkey"), F.lit("west"), size.cast("long")).alias("stock"),
        F.struct(F.when(size % 2 == 0, F.col("p_brand")).alias("brand"), F.when(size % 2 == 1, size).alias("number")).alias("origin"), F.lit(None).cast(C.spark_type(TypeRef("uint64"))).alias("code"),
    )
    return p.where(F.col("p_type").isin(*[n for n, _ in C.enums["Grade"].items])).select(record.alias("record"))


def raw(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "raw string")


def shown(df):
    return sorted(df.select(F.to_json("record").alias("j")).toPandas()["j"])


@pytest.mark.parametrize("format", ["json", "yaml", "csv"])
def test_a_table_of_records_survives(spark, parts, format):
    if format == "csv":
        flat = parts.select(*sinks.flattened(C, "Part", F.col("record"), *sinks.csv_shape(parts, C, "Part")))
        assert {"tag.retail", "words[1]", "origin.madeBy"} <= set(flat.columns)
        back = sources.bind_csv(flat, C, "Part")
    else:
        write, read = (sinks.to_json, sources.read_json) if format == "json" else (sinks.to_yaml, sources.read_yaml)
        back = read(parts.select(write(C, "Part", F.col("record")).alias("raw")), "raw", C, "Part")
    assert parts.count() > 20 and shown(back) == shown(parts)


def test_names_enums_flags_defaults_and_unions(spark):
    r = sources.read_json(raw(spark, '{"partkey":9,"p_name":"n","p_type":"PROMO","p_size":1,"shelf":"Top|Sale","origin":{"maker":"x"},"code":18446744073709551615}', '{"part-key":"8","p_name":"","p_type":60,"p_size":-1,"origin":{"number":4}}'), "raw", C, "Part")
    one, two = (x.record for x in r.collect())
    assert (one.p_partkey, one.p_type, one.shelf, one.origin.brand, one.code) == (9, 30, 5, "x", 2**64 - 1)
    assert (two.p_partkey, two.p_type, two.shelf, two.origin.number, two.note) == (8, 60, 2, 4, None)


def test_events_with_times(spark):
    texts = ('{"event_id":1,"ts":"Tue, 31 Dec 2019 23:59:58 GMT","day":"2020-02-29","lag":"2d1h5ms","value":-0.1250,"clock":"7:08:09.5"}', '{"event_id":2,"ts":"2020-01-01T00:00:00Z","lag":"26:00:01"}')
    one, two = (x.record for x in sources.read_json(raw(spark, *texts), "raw", C, "Event").collect())
    assert (one.ts, one.day, one.lag, float(one.value), one.clock) == (datetime.datetime(2019, 12, 31, 23, 59, 58), datetime.date(2020, 2, 29), 176400005, -0.125, "07:08:09.500")
    assert (two.ts, two.lag, two.day) == (datetime.datetime(2020, 1, 1), 93601000, None)


def test_what_is_wrong_is_named(spark):
    rows = ['{"event_id":null,"ts":"2020-01-01"}', '{"ts":"2020-01-01"}', '{"event_id":1.5,"ts":"2020-01-01"}', "{", "[1]", None]
    found = [{e.path for e in r.errors} for r in sources.read_json(raw(spark, *rows), "raw", C, "Event", mode="quarantine").collect()]
    assert found == [{"event_id"}] * 3 + [{"Event"}] * 3
    assert sources.read_json(raw(spark, *rows), "raw", C, "Event", mode="drop").count() == 0
    with pytest.raises(Exception, match="event_id"):
        sources.read_json(raw(spark, rows[0]), "raw", C, "Event").collect()


def test_strict_options(spark):
    rows = raw(spark, '{"event_id":"3","ts":"2020-01-01"}', '{"event_id":3,"ts":"2020-01-01","more":[]}')
    for options, wanted in (({}, [False, False]), ({"exact": True}, [True, False]), ({"reject_unknown": True}, [False, True])):
        assert [bool(r.errors) for r in sources.read_json(rows, "raw", C, "Event", mode="quarantine", **options).collect()] == wanted


@pytest.mark.parametrize(
    "path,ids",
    [("$.log[*]", [4, 5, 6, 7]), ("$.log[3,0]", [7, 4]), ("$.log[2]", [6]), ("$.log[-2]", [6]), ("$.log[1:3]", [5, 6]), ("$.log[@.event_id > 5]", [6, 7]), ('$["log"][?(@["event_id"] >= 5 && @.kind == "b")]', [5, 7])],
)
def test_paths(spark, path, ids):
    log = ",".join(f'{{"event_id":{i},"ts":"2020-01-01","kind":"{"ab"[i % 2]}"}}' for i in range(4, 8))
    assert sorted(r.record.event_id for r in sources.read_json(raw(spark, f'{{"log":[{log}]}}'), "raw", C, "Event", select="path", path=path).collect()) == sorted(ids)


def test_path_errors_and_limits():
    for text in ("$.orders[", "orders", "$.", "$[?(@.a >)]"):
        with pytest.raises(QueryError):
            compile_path(text)


def test_query_limit(spark):
    with pytest.raises(QueryLimit):
        compile_path("$[?(@.id > 0 && @.id < 3)]", Limits(max_steps=1))
    with pytest.raises(QueryError):
        row_filter("nope == 1", ["a"])


def test_csv_files(spark, tmp_path):
    f = tmp_path / "parts.csv"
    f.write_bytes(b'partkey,p_name,p_type,p_size,words[0],words[1],stock.east,origin.number\r\n5,"ring, ""red""",SMALL,3,ring,red,70,12\r\n6,cog,LARGE,4,cog,,,\r\n')
    read = lambda **options: [r.record for r in sources.read_csv(spark, str(f), C, "Part", **options).collect()]
    one, two = read()
    assert (one.p_name, one.words, one.stock, one.origin.number) == ('ring, "red"', ["ring", "red"], {"east": 70}, 12)
    assert (two.words, two.stock or None, two.origin) == (["cog"], None, None)
    assert [r.p_partkey for r in read(row=1)] == [6] and [r.p_partkey for r in read(multi_line=False)] == [5, 6]
    for where, ids in (('p_type == "LARGE"', [6]), (r'p_name == "ring, \"red\""', [5]), ('p_size == 3 || p_name == "cog"', [5, 6])):
        assert [r.p_partkey for r in read(where=where)] == ids


def test_xml_and_yaml(spark):
    x = raw(spark, '<Part part-key="4" p_size="2"><p_name>a &lt; <![CDATA[b & c]]></p_name><p_type>PROMO</p_type><words>u</words><words>v</words><tag><retail>1.5</retail></tag></Part>')
    r = sources.bind_xml(x, "raw", C, "Part").first().record
    assert (r.p_partkey, r.p_name, r.p_type, r.words, r.tag.retail) == (4, "a < b & c", 30, ["u", "v"], 1.5)
    nested = raw(spark, "<day><Event event_id='1'><ts>2020-01-01</ts></Event><hour><Event event_id='2'><ts>2020-01-02</ts></Event></hour></day>")
    assert [r.record.event_id for r in sources.select_xml(nested, "raw", "//Event", C, "Event").collect()] == [1, 2]
    y = raw(spark, "event_id: 3\nts: 2020-01-03\nday: 2020-01-03\n")
    assert sources.read_yaml(y, "raw", C, "Event").first().record.day == datetime.date(2020, 1, 3)


def test_validation_goes_through_nested_values(spark):
    p = parse_schema('message Box { @Max(9) int32 w; } message Crate { @Min(2) uint32 n; @Size(min = 1, max = 3) @Pattern("^[x-z]*$") string mark; optional list<Box> boxes; optional map<string,Box> named; optional Box lid; }')
    rows = raw(spark, '{"n":1,"mark":"abcd","boxes":[{"w":9},{"w":10}],"named":{"q":{"w":11}},"lid":{"w":12}}', '{"n":2,"mark":"xyz"}')
    bad, good = validate(sources.read_json(rows, "raw", p, "Crate"), p, "Crate").collect()
    assert [(v.path, v.rule) for v in bad.violations] == [("n", "min"), ("mark", "size"), ("mark", "pattern"), ("boxes[1].w", "max"), ("named.q.w", "max"), ("lid.w", "max")]
    assert good.is_valid


def test_format_admission():
    flat = parse_schema("message A { int32 a; string b; } message B { list<int32> a; } message N { nullable string a; }")
    for f in ("json", "yaml", "csv", "xml"):
        admit(flat, "A", f)
    for name, f in (("B", "csv"), ("B", "xml"), ("N", "csv"), ("A", "nope")):
        with pytest.raises(SchemaError):
            admit(flat, name, f)
    admit(flat, "B", "csv", typed=False)


def test_deep_equality(spark):
    for ref, pairs in ((TypeRef("set", (TypeRef("string"),)), [(["x", "y"], ["y", "x"], True), (["x"], ["x", "y"], False), (None, None, True)]), (TypeRef("list", (TypeRef("string"),)), [(["x", "y"], ["y", "x"], False)])):
        df = spark.createDataFrame([(a, b, w) for a, b, w in pairs], "a array<string>, b array<string>, wanted boolean")
        same, hashes = same_value(C, ref, F.col("a"), F.col("b")), [value_hash(C, ref, F.col(c)) for c in "ab"]
        assert df.where((same != F.col("wanted")) | ((hashes[0] == hashes[1]) != F.col("wanted"))).count() == 0


def test_a_record_is_parsed_and_bound_once(spark):
    """A filter on what was bound carries no copy of the binding below it, and parts of a record are looked up once."""
    contract = parse_schema("message Inner { int32 n; } message Props { uint32 k; Inner inner; list<int32> sizes; optional Inner more; }")
    text = raw(spark, '{"k":1,"inner":{"n":2},"sizes":[3]}', '{"k":-1,"inner":{"n":2},"sizes":[3]}', '{"k":1,"inner":{"n":"x"},"sizes":[3.5]}', '{"k":4294967295,"inner":{"n":"7"},"sizes":["3",4.0]}', "[]", "no", '{"k":1,"inner":null,"sizes":{}}')
    kept = sources.read_json(text, "raw", contract, "Props", mode="drop").where("record.k > 0")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count('$["k"]') == 1 and plan.count('$["inner"]') == 1
    assert sorted((r.record.k, r.record.inner.n, r.record.sizes) for r in kept.collect()) == [(1, 2, [3]), (4294967295, 7, [3, 4])]
    wrong = {r.raw: [(e.path, e.message) for e in r.errors] for r in sources.read_json(text, "raw", contract, "Props", mode="quarantine").collect()}
    assert wrong['{"k":1,"inner":{"n":"x"},"sizes":[3.5]}'] == [("inner.n", "is no int32"), ("sizes", "is no list<int32>")]
    assert wrong['{"k":1,"inner":null,"sizes":{}}'] == [("inner", "is null"), ("sizes", "is no list<int32>")]
    assert wrong["[]"] == wrong["no"] == [("Props", "is no object")] and wrong['{"k":-1,"inner":{"n":2},"sizes":[3]}'] == [("k", "is no uint32")]
