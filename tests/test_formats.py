import pytest
from pyspark.sql import functions as F

from colligate.functions.formats import matches_format
from colligate.functions.temporal import format_duration, parse_date, parse_duration, parse_time

CASES = {
    "ip": (["1.2.3.4", "255.255.255.255", "::1", "2001:db8::8a2e:370:7334"], ["256.1.1.1", "1.2.3", "01.2.3.4x", ":::1", "12345::"]),
    "cidr": (["10.0.0.0/8", "::/0"], ["10.0.0.0/33", "10.0.0.0", "::/129"]),
    "hostname": (["a", "a-b.c"], ["-a", "a..b", "a_b"]),
    "domain": (["a.b"], ["a", ".a.b"]),
    "email": (["a.b@c.de"], ["a..b@c.de", ".a@c.de", "a@b", "a@@b.c"]),
    "url": (["http://a.b/c?d=e", "mailto:x@y.z"], ["a b", "//x", "http://a b"]),
    "mac": (["00:1A:2b:3c:4d:5e", "00-1A-2b-3c-4d-5e"], ["00:1A-2b:3c:4d:5e", "00:1A"]),
    "semver": (["1.2.3", "1.0.0-alpha.1+b"], ["01.2.3", "1.2", "1.2.3-"]),
    "hex": (["0aF"], ["", "0x"]),
    "base64": (["YQ==", "YWJj"], ["YQ=", "Y*"]),
    "base64url": (["YQ", "a-_b"], ["a+b"]),
    "currency": (["EUR"], ["eur", "EURO"]),
    "json_pointer": (["", "/a/b~1c~0"], ["a", "/a~2"]),
    "jsonpath": (["$.a[0]", "$['a(']"], ["$.a[", "(]"]),
    "cron": (["* * * * *", "0 0 1 1 MON"], ["* * *", "a;b c d e f"]),
    "color": (["#fff", "#a1b2c3", "#a1b2c3d4"], ["fff", "#ffff"]),
    "mime": (["text/html; charset=utf-8"], ["text", "/x"]),
    "regex": (["a+b"], ["(a"]),
    "anything": (["passes"], []),
}


@pytest.mark.parametrize("name", CASES)
def test_format(spark, name):
    good, bad = CASES[name]
    df = spark.createDataFrame([(x,) for x in good + bad], "s string")
    assert [r.ok for r in df.select(matches_format(F.col("s"), name).alias("ok")).collect()] == [True] * len(good) + [False] * len(bad)


def test_temporals(spark):
    df = spark.createDataFrame([("1:30:05.250", "2024-02-30"), ("1d2h3m4s5ms", "2024-02-29"), ("250", "24-1-1"), ("x", None)], "d string, t string")
    rows = df.select(parse_duration(F.col("d")).alias("ms"), format_duration(parse_duration(F.col("d"))).alias("back"), parse_date(F.col("t")).alias("day"), parse_time(F.lit("23:59:60")).alias("leap")).collect()
    assert [(r.ms, r.back) for r in rows] == [(5405250, "1:30:05.250"), (93784005, "26:03:04.005"), (250, "0:00:00.250"), (None, None)]
    assert [str(r.day) for r in rows] == ["None", "2024-02-29", "None", "None"] and rows[0].leap == "23:59:60.000"
