import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.operators import aggregate, delta, expect
from mensura.sources import readers, sinks, snapshots

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


def test_csv_with_mark_order_and_extra_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("\ufeffn,extra,id\n1,x,\"a, b\"\nbad,y,c\n".encode())
    got = [tuple(r) for r in readers.read_table_csv(spark, str(path), SCHEMA).collect()]
    assert got == [("a, b", 1), ("c", None)]


def test_jsonl_strict_names_file_and_line(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "a", "n": 1}\n\n   \n{"id": "b", "n": 2}\n[1]\n{"id": \n')
    bad = {(r.line, r.text.strip()) for r in readers.locate_bad_lines(spark, str(path), SCHEMA).collect()}
    assert bad == {(5, "[1]"), (6, '{"id":')}
    with pytest.raises(ValueError, match="x.jsonl, line 5"):
        readers.read_jsonl_strict(spark, str(path), SCHEMA)
    rows = readers.read_jsonl(spark, str(path), SCHEMA)
    assert rows.count() == 4
    with pytest.raises(expect.ExpectationError):
        expect.enforce(expect.parseable(rows))
    path.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    assert readers.read_jsonl_strict(spark, str(path), SCHEMA).count() == 2


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    lines = ['{"id": "%06d", "n": %d}' % (i, i) for i in range(5000)]
    for i in (17, 2500, 4999):
        lines[i] = "broken"
    path.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert readers.read_jsonl(spark, str(path), SCHEMA).rdd.getNumPartitions() > 3
        bad = sorted(r.line for r in readers.locate_bad_lines(spark, str(path), SCHEMA).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bad == [18, 2501, 5000]


def test_keyed_json_and_properties(spark, tmp_path):
    path = tmp_path / "k.json"
    path.write_text('{"A1": {"n": 1},\n "A2": {"n": 2}}')
    got = sorted(tuple(r) for r in readers.read_keyed_json(spark, str(path), T.StructType.fromDDL("n int")).collect())
    assert got == [("A1", 1), ("A2", 2)]
    rows = [(None,), ("",), ("[]",), ('{"a": "1"}',), ('[{"a": "1", "b": " "}, {"a": null}]',)]
    df = spark.createDataFrame(rows, "t string").select(
        readers.property_rows(F.col("t"), T.StructType.fromDDL("a string, b string")).alias("p")
    )
    cover = {r.field: (r.n_present, r.n_property_rows, r.coverage_percent) for r in aggregate.nested_field_coverage(df, "p").collect()}
    assert cover == {"a": (2, 3, 66.667), "b": (0, 3, 0.0)}


def test_snapshot_checks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    good, bad = f"file://{tmp_path}/s1", f"file://{tmp_path}/s2"
    snapshots.write_snapshot(df, good, "k", "v1")
    df.write.parquet(f"{bad}/data")
    assert snapshots.read_snapshot(spark, good, "k").count() == 3
    versions = snapshots.snapshot_versions(spark, [good, bad])
    row = snapshots.latest_complete(versions, "version", "path").first()
    assert (row.version, row.path) == ("v1", good)
    both = spark.createDataFrame([("p1", "v1", True, False), ("p2", "v2", True, True), ("p3", "v3", False, False)],
                                 "path string, version string, complete boolean, failed boolean")
    assert snapshots.latest_complete(both, "version", "path").first().path == "p1"
    spark.createDataFrame([("c", 9)], "k string, n int").write.mode("append").parquet(f"{good}/data")
    with pytest.raises(expect.ExpectationError, match="extra_group"):
        snapshots.read_snapshot(spark, good, "k")


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", ["b", "c"], {"k": 1})], "a string, l array<string>, m map<string,int>")
    sinks.write_csv(df, f"{tmp_path}/o", ["l", "a", "m"], bom=True)
    got = readers.read_table_csv(spark, f"{tmp_path}/o", T.StructType.fromDDL("a string, l string, m string")).first()
    assert tuple(got) == ("x", "b;c", '{"k":1}')


def test_expectations(spark):
    df = spark.createDataFrame([("a", "T"), ("a", "T"), (" ", "U"), (None, None)], "k string, t string")
    reports = [expect.non_blank(df, ["k"]), expect.unique_key(df, ["k"]), expect.domain(df, "t", "T"), expect.domain(df, "t", "T", optional=True)]
    got = [r.n_bad for x in reports for r in x.collect()]
    assert got == [2, 1, 2, 1]
    with pytest.raises(expect.ExpectationError, match="k_blank: 2 bad"):
        expect.enforce(*reports)
    assert expect.required_columns(df, ["k", "zz"]).first().sample == "zz"
    kept, rejected = expect.split_rows(df, {"no_key": F.col("k").isNull()}, {"odd": F.col("t") == "U"})
    assert (kept.count(), rejected.first().reasons, kept.where("warnings = 'odd'").count()) == (3, "no_key", 1)
    folds = spark.createDataFrame([(1, "g", 0, 0), (2, "g", 0, 1), (2, "g", 0, 1)], "k int, g string, partition int, fold int")
    assert [r.n_bad for r in expect.no_leakage(folds, "k", "g", 3).collect()] == [1, 1, 1]


def test_delta_values(spark):
    old = spark.createDataFrame([("same", 1.0, 3), ("tiny", 1.0, 3), ("moved", 1.0, 3), ("null", None, 3), ("lost", 1.0, 3), ("gone", 1.0, 1)], "k string, v double, n int")
    new = spark.createDataFrame([("same", 1.0, 3), ("tiny", 1.0 + 1e-12, 3), ("moved", 1.001, 2), ("null", float("nan"), 3), ("lost", None, 3), ("new", 1.0, 1)], "k string, v double, n int")
    values = delta.delta_values(old, new, "k", ["v", "n", "absent"])
    got = {r.k: (r.side, r.v_changed, r.n_changed, r.any_change) for r in values.collect()}
    assert got["same"] == got["tiny"] == got["null"] == ("both", False, False, False)
    assert got["moved"] == ("both", True, True, True) and got["lost"] == ("both", True, False, True)
    assert got["gone"][0] == "left_only" and got["new"][0] == "right_only"
    assert sorted(r.k for r in delta.changed_overlap(values).collect()) == ["lost", "moved"]
    row = delta.verdict(old, new, "k", ["v", "n"]).first()
    assert (row.n_new, row.n_removed, row.n_changed, row.verdict, row.holdout) == (1, 1, 2, "new_entities", "too_few")
    same = delta.verdict(old, old, "k", ["v", "n"]).first()
    assert (same.n_new, same.n_changed, same.verdict) == (0, 0, "identical")


def test_negatives(spark):
    df = spark.createDataFrame([(1, "Alpha\nb"), (2, "alpha"), (3, "hit"), (4, ""), (5, "second hit")], "i int, t string")
    a, b = (spark.createDataFrame([(x,)], "t string") for x in ("HIT", "second  hit"))
    row = delta.negatives_report(df, "t", [(a, "t"), (b, "t")]).first()
    assert (row.n_input, row.n_failed, row.n_collisions_1, row.n_collisions_2, row.n_duplicates, row.n_clean) == (5, 1, 1, 1, 1, 1)
    assert [r.i for r in delta.clean_negatives(df, "t", [(a, "t"), (b, "t")], ["i"]).collect()] == [1]


@pytest.mark.parametrize("path", ["window", "slots"])
def test_entity_aggregate_first_known(spark, request, path):
    if path == "slots":
        request.getfixturevalue("slots_only")
    rows = [("e", None, 1.0, 2000, "c", "s", 1), ("e", "x", 2.0, 2001, "c", "s2", 2), ("e", "y", None, None, "d", "s", 3), (None, "z", 5.0, 1, "c", "s", 4)]
    df = spark.createDataFrame(rows, "k string, r string, v double, y int, c string, s string, o int")
    (row,) = aggregate.entity_aggregate(df, "k", "v", "y", "c", "s", ["r"], ["o"]).collect()
    assert (row.r, row.value_median, row.n_measurements, row.year_min, row.year_max, row.n_collections, row.n_sources) == ("x", 1.5, 2, 2000, 2001, 2, 2)


def test_csv_round_trip_of_line_breaks(spark, tmp_path):
    from mensura.sources import readers, sinks

    rows = [("a", 'first\nsecond, "quoted"'), ("b", "plain")]
    df = spark.createDataFrame(rows, "k string, v string")
    sinks.write_csv(df, str(tmp_path / "t"))
    back = readers.read_table_csv(spark, str(tmp_path / "t"), df.schema)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_text_counts_as_missing_number(spark):
    from mensura.functions import clean

    df = spark.createDataFrame([("1.5",), ("n/a",), (None,)], "v string")
    assert [r[0] for r in df.select(clean.nan_to_null("v")).collect()] == [1.5, None, None]


def test_csv_files_share_one_header(spark, tmp_path):
    for name, text in (("a.csv", "\ufeffid,n\nx,1\n"), ("b.csv", "\ufeffid,n\ny,2\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert sorted(tuple(r) for r in readers.read_table_csv(spark, str(tmp_path), SCHEMA).collect()) == [("x", 1), ("y", 2)]
    (tmp_path / "c.csv").write_text("n,id\n3,z\n")
    with pytest.raises(Exception, match="(?s)read"):
        readers.read_table_csv(spark, str(tmp_path), SCHEMA).collect()


def test_csv_with_nameless_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",id,n\n0,x,1\n1,y,2\n")
    assert sorted(tuple(r) for r in readers.read_table_csv(spark, str(tmp_path), SCHEMA).collect()) == [("x", 1), ("y", 2)]


def test_hashes_of_a_partitioned_snapshot(spark, tmp_path):
    path = f"{tmp_path}/parts"
    spark.range(10).withColumn("k", F.col("id") % 2).repartition(1).write.partitionBy("k").parquet(path)
    found = snapshots.file_hashes(spark, path, "*.parquet")
    assert sorted(r.file.split("/")[0] for r in found.collect()) == ["k=0", "k=1"]
    assert {r.check: r.n_bad for r in snapshots.hashes_match(found, found).collect()} == {"file_missing": 0, "file_extra": 0, "hash_differs": 0}


def test_hashes_by_blocks(spark, tmp_path, monkeypatch):
    """Files of many blocks and with odd names (empty ones are not listed); the reader's whole files give the same digests."""
    monkeypatch.setattr(snapshots, "HASH_BLOCK", 64)
    (tmp_path / "in k=a b").mkdir()
    texts = {"plain": bytes(range(256)) * 9 + b"end", "empty": b"", "in k=a b/50% \u00fc+x": b"x" * 64}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    want = {name: hashlib.sha256(content).hexdigest() for name, content in texts.items() if content}
    found = snapshots.file_hashes(spark, str(tmp_path))
    assert {r.file: r.sha256 for r in found.collect()} == want
    assert "ReadSchema: struct<path:string>" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(snapshots, "BLOCK_SCHEMES", {})
    assert {r.file: r.sha256 for r in snapshots.file_hashes(spark, str(tmp_path)).collect()} == want


def test_nan_is_missing_in_roll_ups(spark):
    nan = float("nan")
    df = spark.createDataFrame([("e", "s", 1.0), ("e", "s", nan), ("e", "t", 3.0), ("e", "t", None)], "e string, s string, v double")
    row = aggregate.entity_aggregate(df, "e", "v").first()
    assert (row.n_measurements, row.value_min, row.value_max, row.value_median) == (2, 1.0, 3.0, 2.0) and row.value_sd == pytest.approx(2**0.5)
    got = {r.s: (r.n_measurements, r.value_n, r.value_max, r.value_median) for r in aggregate.source_aggregate(df, "s", "e", "v").collect()}
    assert got == {"s": (2, 1, 1.0, 1.0), "t": (2, 1, 3.0, 3.0)}
    row = aggregate.multi_source_range(df, "e", "s", "v").first()
    assert (row.n_entities, row.max_range, row.median_range) == (1, 2.0, 2.0)
    row = aggregate.describe_delta(df, "v").first()
    assert (row.n, row.mean, row.max, row.p50) == (2, 2.0, 3.0, 2.0)
