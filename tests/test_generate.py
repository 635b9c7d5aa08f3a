"""Runtime expectations: rules, normal values, containers, uniqueness, replay."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import generate as g

FIELDS = "CaseNo dataId targetId dataRole convModel mirrorX mirrorY mirrorZ validationMin validationMax nullable referenceType fixedValue referenceValues".split()


def row(case="C1", data="a", conv="STRING", x="-", y="-", z="-", low="-1", high="-1", role="TARGET", ref="String", fixed="", values=""):
    return dict(zip(FIELDS, (case, data, "t", role, conv, x, y, z, low, high, "0", ref, fixed, values)))


def one(spark, **kw):
    r = g.scalars(spark.createDataFrame([row(**kw)], ", ".join(f"{c} string" for c in FIELDS))).first()
    return r.valueState, r.actualValue, r.actualLength


def test_number_above_most(spark):
    assert one(spark, conv="NUMBER", y="6:length_max_plus_1", low="1", high="65535") == ("VALUE", "65536", 5)


def test_null_and_empty(spark):
    assert one(spark, y="1:length_null") == ("NULL", None, -1)
    assert one(spark, y="2:length_empty") == ("EMPTY", "", 0)


def test_string_of_most(spark):
    assert one(spark, y="5:length_max", low="1", high="5") == ("VALUE", "AAAAA", 5)


def test_x_text(spark):
    assert one(spark, x="37:hw_alphanum") == ("VALUE", "AbC123", 6)
    assert one(spark, x="9:no_such_rule")[0] == "UNSUPPORTED"


def test_all_y_rules_of_a_string(spark):
    rules = ["length_null", "length_empty", "length_min", "length_min_minus_1", "length_max", "length_max_plus_1", "length_normal_mid"]
    got = [one(spark, y=f"{i}:{r}", low="2", high="6") for i, r in enumerate(rules, 1)]
    assert got[:2] == [("NULL", None, -1), ("EMPTY", "", 0)] and [n for _, _, n in got[2:]] == [2, 1, 6, 7, 4]


def test_y_rules_of_a_number(spark):
    rules = ["length_min", "length_min_minus_1", "length_max", "length_max_plus_1", "length_normal_mid"]
    assert [one(spark, conv="NUMBER", y=f"1:{r}", low="1", high="65535")[1] for r in rules] == ["1", "0", "65535", "65536", "32768"]
    assert one(spark, conv="DECIMAL", y="7:length_normal_mid", low="1", high="2")[1] == "1.5"


@pytest.mark.parametrize("kw,want", [
    (dict(y="3:length_min"), "UNSUPPORTED"), (dict(y="4:length_min_minus_1", low="0"), "UNSUPPORTED"), (dict(conv="BOOLEAN", y="3:length_min", low="1"), "UNSUPPORTED"),
    (dict(x="1:hw_symbol", y="1:length_null"), "UNSUPPORTED"), (dict(conv="OBJECT"), "UNSUPPORTED"), (dict(conv="-"), "NO_VALUE"), (dict(conv="ENUM"), "UNSUPPORTED"),
])
def test_states(spark, kw, want):
    assert one(spark, **kw)[0] == want


def test_normal_and_z_values(spark):
    assert one(spark, conv="ENUM", values="X / Y")[1] == "X" and one(spark, conv="ENUM", fixed="F")[1] == "F"
    assert one(spark, role="FIXED", fixed="v", y="1:length_null")[1] == "v"
    assert one(spark, z="66:html/script")[1] == "<script>alert(1)</script>" and one(spark, z="69:null")[0] == "NULL"
    assert one(spark, z="1:out_of_range", high="9")[1] == "10" and one(spark, z="1:out_of_range", low="9")[1] == "8" and one(spark, z="1:out_of_range")[0] == "UNSUPPORTED"
    assert one(spark, z="61:surrogate_pair") == ("VALUE", "😀", 1)


def elements(spark, rows):
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FIELDS))
    out = g.elements(df).orderBy("dataId", "elementIndex").collect()
    return [(r.dataId, r.elementIndex, r.actualValue) for r in out], g.containers(df).first()


def test_list_map_and_set(spark):
    got, box = elements(spark, [row(conv="COLLECTION", ref="List<String>"), row(data="a[]")])
    assert got == [("a[]", i, "test") for i in range(3)] and box["size"] == 3
    got, _ = elements(spark, [row(conv="MAP", ref="Map<String,Integer>"), row(data="a{key}"), row(data="a{value}", conv="NUMBER")])
    assert [v for d, _, v in got if d == "a{key}"] == ["test", "test_1", "test_2"] and [v for d, _, v in got if d == "a{value}"] == ["1"] * 3
    got, _ = elements(spark, [row(conv="ARRAY", ref="Set<String>"), row(data="a[]")])
    assert [v for *_, v in got] == ["test", "test_1", "test_2"]
    got, box = elements(spark, [row(conv="COLLECTION", y="2:length_empty"), row(data="a[]")])
    assert got == [] and box.valueState == "EMPTY"


def test_unique_siblings_by_model(spark):
    df = spark.createDataFrame([("CHAR", "A"), ("DECIMAL", "1.0"), ("DATE", "2000-01-01"), ("DATETIME", "2000-01-01T00:00:00"), ("ENUM", "X"), ("BOOLEAN", "true")], "c string, v string")
    out = {r.c: r.u for r in df.select("c", g.unique_sibling(F.col("c"), F.col("v"), F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), F.lit(2)).alias("u")).collect()}
    assert out == {"CHAR": "C", "DECIMAL": "3", "DATE": "2000-01-03", "DATETIME": "2000-01-01T00:00:02", "ENUM": "Z", "BOOLEAN": None}


def test_replay_never_generates(spark):
    key = "CaseNo string, dataId string, elementIndex bigint"
    wanted = spark.createDataFrame([("C", "a", 0), ("C", "b", 0)], key)
    evidence = spark.createDataFrame([("C", "a", 0, "VALUE", "777", 3)], key + ", valueState string, actualValue string, actualLength bigint")
    out = {r.dataId: r for r in g.replay(wanted, evidence).collect()}
    assert out["a"].actualValue == "777" and out["b"].valueState == "MISSING" and g.failures(g.replay(wanted, evidence)).count() == 1


def test_conversion(spark):
    df = spark.createDataFrame([("java.lang.Integer", "x"), ("int", "5"), ("com.acme.Thing", "5"), ("LocalDate", "2000-02-30")], "t string, v string")
    assert [r[0] for r in df.select(g.convertible(F.col("t"), F.col("v"))).collect()] == [False, True, None, False]


def test_evidence_stream_is_written_once(spark, tmp_path):
    from loomspan.streaming.evidence import append_evidence

    schema = ", ".join(f"{c} string" for c in FIELDS)
    spark.createDataFrame([row(case=f"C{i}") for i in range(20)], schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        append_evidence(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
