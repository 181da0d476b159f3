import pytest

from colligate.plans.schema import SchemaError, parse_schema


def test_types_and_aliases():
    c = parse_schema("message P { u64 a; i16[2] b; map<string,i64> m; list<u32> v; bytes(4) h; f32 f; }")
    assert c.struct("P").simpleString() == "struct<a:decimal(20,0),b:array<smallint>,m:map<string,bigint>,v:array<bigint>,h:binary,f:float>"


def test_names_presence_defaults_and_rules():
    c = parse_schema('message O { [name("order-id"), alias("legacy-id"), alias("old-id")] uint32 id; optional nullable @Size(min = 2, max = 8) string s; @Min(1) @Max(120) uint64 age = 5; }')
    o = c.record("O")
    assert o.field("id").inputs == ("order-id", "legacy-id", "old-id")
    assert (o.field("s").optional, o.field("s").nullable) == (True, True)
    assert (o.field("age").default, len(o.field("age").rules)) == (5, 2)


def test_enums_and_flags_count_on():
    c = parse_schema("enum E <uint8> { A; B; C = 7; D; } flags F { R; W; X; }")
    assert c.enums["E"].values == {"A": 0, "B": 1, "C": 7, "D": 8}
    assert c.enums["F"].values == {"R": 1, "W": 2, "X": 4}


@pytest.mark.parametrize(
    "text",
    [
        "message A { X x; }",
        "message A { int32 a; int32 a; }",
        "enum E { A = 1; B = 1; }",
        "enum E <uint8> { A = 300; }",
        "message A { A a; }",
        "message A { map<int32,string> m; }",
        'message A { [alias("b")] int32 a; int32 b; }',
        "message A { int32 a }",
        "message A { @Pattern(3) string a; }",
        "message bool { int32 a; }",
        "service S { M: Nope -> Nope; } ",
    ],
)
def test_wrong_schemas_are_rejected(text):
    with pytest.raises(SchemaError):
        parse_schema(text)


def test_fingerprint_follows_the_shape():
    one, two, three = (parse_schema(t).fingerprint("A") for t in ("message A { int32 a; }", "message A { i32 a; }", "message A { int64 a; }"))
    assert one == two != three
