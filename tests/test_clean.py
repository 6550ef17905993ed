import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.functions import clean as c
from mensura.operators import joins


def one(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return df.select(*[v.alias(k) for k, v in cols.items()]).collect()


def test_missing_values(spark):
    rows = [(None,), ("",), ("  ",), ("nan",), ("NaN",), ("7.1",), (" 7.1 ",), ("7.1x",), ("  x\t",), ("7.1d",), ("1e3",), ("inf",)]
    got = one(spark, rows, "v string", t=c.clean_text("v"), n=c.to_number("v"))
    assert [r.t for r in got] == [None, None, None, None, None, "7.1", "7.1", "7.1x", "x", "7.1d", "1e3", "inf"]
    assert [r.n for r in got] == [None] * 5 + [7.1, 7.1, None, None, None, 1000.0, math.inf]


def test_tri_state(spark):
    rows = [("TRUE",), ("1",), ("1.0",), ("yes",), ("y",), ("false",), ("0",), ("no",), ("maybe",), (None,), (" N ",)]
    got = [r.b for r in one(spark, rows, "v string", b=c.parse_bool3("v"))]
    assert got == [True] * 5 + [False] * 3 + [None, None, False]


def test_first_present_and_absent_column(spark):
    got = one(spark, [("a", "b"), (" ", "b"), (None, None)], "x string, y string", f=c.first_present("x", "y"), g=c.first_present(None, "y"))
    assert [(r.f, r.g) for r in got] == [("a", "b"), ("b", "b"), (None, None)]


def test_normalize_text(spark):
    rows = [("A–B — −C\n\td",), ("ﬁve ½",), (None,), ("café \U0001F600",)]
    got = [r.t for r in one(spark, rows, "v string", t=c.normalize_text("v"))]
    assert got == ["a-b - -c d", "five 1⁄2", "", "café \U0001F600"]


def test_censoring(spark):
    rows = [
        ("IC50", "=", 1.0, None), ("IC50", ">", 1.0, None), ("IC50", ">>", None, None), ("IC50", "<=", 1.0, None),
        ("IC50", None, 1.0, None), ("IC50", "=", 1.0, 2.0), ("EC50", "=", 1.0, None), ("IC50", "=", None, None),
    ]
    flags = c.classify_censoring(F.col("k"), F.col("r"), F.col("v"), F.col("u"), "IC50")
    got = one(spark, rows, "k string, r string, v double, u double", **flags)
    names = list(flags)
    assert [[n for n in names if r[n]] for r in got] == [
        ["exact"], ["non_exact", "right_censored"], ["non_exact", "right_censored"], ["non_exact", "left_censored"],
        ["non_exact"], ["non_exact", "interval"], [], ["non_exact"],
    ]
    assert all(r[n] is not None for r in got for n in names)


def test_record_flags(spark):
    flags = c.record_flags(
        [F.col("a"), F.col("b")], F.col("k"), "IC50", F.col("s"), F.col("d"), F.col("v"), F.col("o"), F.col("x")
    )
    rows = [
        ("Not  Active", None, "IC50", "C", "1", None, "Homo sapiens", None),
        ("hyperinactive", "", "INHIBITION", " ", "0", "Outside", "", "Active"),
        (None, "inactive", None, None, None, " ", None, " "),
    ]
    got = one(spark, rows, "a string, b string, k string, s string, d string, v string, o string, x string", **flags)
    assert [[n for n in flags if r[n]] for r in got] == [
        ["text_contains_inactive", "potential_duplicate_true"],
        ["single_point", "missing_structure", "has_validity_comment", "missing_organism", "has_text_value"],
        ["text_contains_inactive", "missing_structure", "missing_organism"],
    ]


def test_conform_schema(spark):
    df = spark.createDataFrame([("1", 2), ("x", 3)], "a string, extra int")
    out = c.conform_schema(df, T.StructType.fromDDL("b double, a int"))
    assert out.columns == ["b", "a"]
    assert [tuple(r) for r in out.collect()] == [(None, 1), (None, None)]


def test_components_and_identity(spark):
    rows = [("ab.abcd.x",), ("salt.salt",), ("abcd.wxyz",), ("",), (None,), ("x.salt2.y",)]
    got = one(spark, rows, "v string", p=c.largest_component("v", r"\.", ["salt", "salt2"]))
    assert [r.p for r in got] == ["abcd", "salt", "abcd", None, None, "x"]
    keys = one(spark, [("A  b",), ("a b ",), ("  ",)], "v string", k=c.identity_key("v"))
    assert keys[0].k == keys[1].k and keys[2].k is None


def test_sentinel_units_and_links(spark):
    got = one(spark, [("", 1), ("g", 2), (None, 3)], "g string, k int", s=c.empty_group_sentinel(F.col("g"), F.col("k")))
    assert [r.s for r in got] == ["UNGROUPED::1", "g", "UNGROUPED::3"]
    got = one(spark, [(100.0, "nM"), (1.0, "uM"), (0.0, "nM"), (1.0, "kg")], "v double, u string", p=c.neg_log10_molar(F.col("v"), F.col("u")))
    assert [None if r.p is None else round(r.p, 9) for r in got] == [7.0, 6.0, None, None]
    got = one(spark, [("a",), (" ",)], "k string", u=c.link_column("https://example.org/%s", F.col("k")))
    assert [r.u for r in got] == ["https://example.org/a", ""]


def test_preserve_annotations_rejects_repeated_keys(spark):
    now = spark.createDataFrame([("a",), ("b",)], "k string")
    prior = spark.createDataFrame([("a", "seen"), ("a", "again")], "k string, review_status string")
    with pytest.raises(RuntimeError):
        joins.preserve_annotations(now, prior, "k", {"review_status": "unreviewed"})
    good = joins.preserve_annotations(now, prior.limit(1), "k", {"review_status": "unreviewed", "manual_notes": ""})
    assert sorted(tuple(r) for r in good.collect()) == [("a", "seen", ""), ("b", "unreviewed", "")]
