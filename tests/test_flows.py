import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.operators import models as mo
from mensura.operators.expect import ExpectationError
from mensura.plans import audit, grid, overview, protocol, release
from mensura.streaming import landing

RECORDS = [
    ("1", "s1", "m1", "T1", "IC50", "=", "10", None, None, "C", None),
    ("2", "s1", "m2", "T1", "ic50", ">", "10", None, "inactive", "", "Outside typical range"),
    ("3", "s2", "m1", "T1", None, "=", "x", None, None, "C", None),
    ("4", "s2", "m3", "T1", "Inhibition", "=", "50", None, None, "C", None),
]
COLUMNS = ("record_id string, source_id string, entity_id string, target_id string, standard_type string, standard_relation string, "
           "standard_value string, standard_upper_value string, comment string, structure string, validity_comment string")


def test_overview(spark):
    raw = spark.createDataFrame(RECORDS, COLUMNS).withColumn("type", F.lit("IC50"))
    sources = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "no records")], "source_id string, description string")
    expected = spark.createDataFrame([("s1", 2), ("s2", 2)], "source_id string, n_records long")
    overview.check_records(raw, "T1", "Homo sapiens")
    with pytest.raises(ExpectationError):
        overview.check_records(raw, "T2", "Homo sapiens")
    out = overview.overview(raw, sources, "IC50", expected)
    summary = out["summary"].first()
    assert (summary.n_records, summary.n_exact, summary.n_non_exact, summary.n_right_censored, summary.n_single_point) == (4, 1, 2, 1, 1)
    flags = {r.record_id: r.descriptive_flags for r in out["records"].collect()}
    assert flags["1"] == "exact;missing_organism"
    assert flags["2"] == "non_exact;right_censored;text_contains_inactive;missing_structure;has_validity_comment;missing_organism"
    assert {r.source_id: r.n_records for r in out["sources"].collect()} == {"s1": 2, "s2": 2, "s3": 0}
    counts = {(r.group, r.value): r.n_records for r in out["counts"].collect()}
    assert counts["type", "IC50"] == 3 and counts["type", "INHIBITION"] == 1 and counts["flag", "missing_organism"] == 4
    cover = {r.field: (r.n_present, r.n_missing) for r in out["field_coverage"].collect()}
    assert cover["structure"] == (3, 1) and cover["standard_upper_value"] == (0, 4)
    assert sorted(r.record_id for r in out["review"].collect()) == ["2", "3", "4"]
    wrong = spark.createDataFrame([("s1", 2), ("s2", 1)], "source_id string, n_records long")
    with pytest.raises(ExpectationError, match="count_differs"):
        overview.overview(raw, sources, "IC50", wrong)


def test_audit(spark):
    records = spark.createDataFrame(
        [("s1", "m1", 7.0, 2010), ("s1", "m2", 8.0, 2011), ("s2", "m1", 6.0, 2012), (" ", "m9", 1.0, 2000), ("s2", None, 5.0, 2012)],
        "source_id string, entity_id string, value double, year int",
    )
    sources = spark.createDataFrame(
        [("s1", "Inhibition of AITC-induced calcium flux by fura-2 assay", "F"), ("s2", "short", "B")], "source_id string, description string, type string"
    )
    prior = spark.createDataFrame([("s2", "done")], "source_id string, review_status string")
    table, summary = audit.audit(records, sources, "ABC1", prior)
    rows = {r.source_id: r for r in table.collect()}
    assert rows["s1"].review_priority == "candidate_strict" and rows["s1"].matches_calcium == "calcium;calcium_flux;fura-2"
    assert rows["s2"].review_priority == "high" and rows["s2"].review_status == "done" and rows["s1"].review_status == "unreviewed"
    assert (rows["s2"].n_measurements, rows["s2"].n_entities, rows["s1"].years) == (2, 1, "2010;2011")
    assert table.first().source_id == "s2"
    got = {r.category: (r.n_sources, r.entities_union, r.n_measurements) for r in summary.collect()}
    assert got["flag_calcium"] == (1, 2, 2) and got["flag_sparse_description"] == (1, 1, 2) and got["flag_xenopus"] == (0, 0, 0)


def test_protocol_families_and_contrasts(spark):
    base = "CHO cells, FLIPR, cinnamaldehyde at EC50, incubated with compounds for 10 minutes prior to adding agonist. "
    sources = spark.createDataFrame(
        [("a", "d1", base + "followed by 15 minutes at room temperature.", 25), ("b", "d1", base + "followed by 90 minutes at room temperature.", 25),
         ("c", "d1", "unknown", 25), ("d", "d2", base, 25)],
        "source string, coll string, description string, n_entities int",
    )
    rows = [(s, f"m{i}", 6.0 + i / 10 + (0.3 if s == "b" else 0.0), f"g{i % 5}") for s in "abcd" for i in range(25)]
    records = spark.createDataFrame(rows, "source string, entity string, value double, grp string")
    dec = protocol.decompose(sources, "description", "ABC1").cache()
    fam = {r.n_sources: r for r in protocol.families(dec, records, "source", "entity", "coll").collect()}
    assert fam[3].members == ["a", "b", "d"] and fam[3].unique_entities == 25 and fam[3].n_collections == 2
    assert fam[3].information == "well_specified" and fam[1].information == "low_information" and not fam[3].verified
    (row,) = protocol.protocol_contrasts(dec, records, "source", "entity", "coll", "value", "grp", 20, 500).collect()
    assert (row.source_a, row.source_b, row.differing_field, row.value_a, row.value_b) == ("a", "b", "plate_equilibration_min", "15", "90")
    assert row.confidence == "plate_equilibration_min_differs__other_fields_unverified"
    assert row.delta_median == pytest.approx(0.3) and row.dominant_direction == "B_higher" and row.n_groups == 5


def test_release(spark):
    cols = "e string, v double, y int, c string, s string"
    old = spark.createDataFrame([("a", 1.0, 2000, "c", "s"), ("b", 2.0, 2001, "c", "s"), ("nan", 9.0, 1, "c", "s")], cols)
    new = spark.createDataFrame([("a", 1.0, 2000, "c", "s"), ("b", 2.0, 2001, "c", "s"), ("b", 3.0, 2002, "d", "s"), ("x", 3.0, 2003, "d", "t")], cols)
    tables = [release.entity_table(d, "e", "v", "y", "c", "s") for d in (old, new)]
    out = release.compare(*tables, "e")
    assert tuple(out["counts"].first()) == (2, 3, 2, 1, 0)
    assert [r.e for r in out["changed"].collect()] == ["b"] and [r.e for r in out["new"].collect()] == ["x"]
    assert out["verdict"].first().verdict == "new_entities"
    report = out["report"].first()
    assert (report.increased, report.unchanged, report.n_abs_gt_010) == (1, 1, 1)


def test_grid_resumes(spark):
    from pyspark.ml.functions import array_to_vector

    data = spark.range(120).select(
        F.col("id").alias("k"), F.concat(F.lit("g"), F.col("id") % 12).alias("g"), (F.col("id") % 7).cast("double").alias("y"),
        array_to_vector(F.array((F.col("id") % 7).cast("double"), F.rand(3))).alias("x"),
    ).cache()
    seen = []
    algorithms = {"forest": lambda v: mo.forest_regressor(4, 4, v)}
    out = grid.run(data, "k", "g", "y", {"plain": "x"}, algorithms, n_splits=3, partitions=1, sink=lambda df: seen.append(df.count()))
    table = {r.representation: r for r in out["summary"].collect()}
    assert table["plain"].r2_pooled > 0.9 > table["__baseline__"].r2_pooled and table["__baseline__"].n == 120
    assert sorted(seen) == [120, 120]
    done = out["oof"].where("representation = 'plain'")
    again = mo.model_grid(data, out["folds"], "k", "y", {"plain": "x"}, algorithms, done=done)
    whole = sorted(map(tuple, out["oof"].select("representation", "k", "fold", "y_pred").collect()))
    assert sorted(map(tuple, again.select("representation", "k", "fold", "y_pred").collect())) == whole
    trained = []
    for rows, new in ((out["oof"], []), (done, [120]), (done.where("k <> 5"), [120, 120])):
        trained.clear()
        full = mo.model_grid(data, out["folds"], "k", "y", {"plain": "x"}, algorithms, done=rows, sink=lambda df: trained.append(df.count()))
        assert full.count() == 240 and trained == new


def test_permuted_copies_keep_values(spark):
    test = spark.range(50).select(F.col("id").alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    got = mo.permuted_copies(test, "k", "x", 2, 3).toPandas()
    assert len(got) == 50 * 2 * 3
    first = got[(got.feature_index == 0) & (got.repeat == 1)]
    assert sorted(v[0] for v in first.x) == list(range(50)) and any(v[0] != k for k, v in zip(first.k, first.x))
    assert all(v[0] == k for k, v in zip(got[got.feature_index == 1].k, got[got.feature_index == 1].x))


def test_landing_stream(spark, tmp_path):
    schema = T.StructType.fromDDL("record_id string, standard_type string, standard_relation string, standard_value string, landed_at timestamp")
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def land(name, *rows):
        lines = [r if isinstance(r, str) else json.dumps(dict(zip(schema.names, r))) for r in rows]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    def run():
        records = landing.landed_records(landing.landed_lines(spark, folder, schema), "IC50", "landed_at")
        landing.append(records, out, check).awaitTermination(120)

    land("a.jsonl", ("1", "IC50", "=", "5", "2024-01-01T00:00:00"), ("1", "IC50", "=", "5", "2024-01-01T00:01:00"), "{broken")
    run()
    land("b.jsonl", ("1", "IC50", "=", "5", "2024-01-01T00:02:00"), ("2", "IC50", ">", "5", "2024-01-01T00:03:00"))
    run()
    got = sorted((r.record_id, r.exact, r.right_censored) for r in spark.read.parquet(out).collect())
    assert got == [("1", True, False), ("2", False, True)]
    land("c.jsonl", "[1]", "{broken", ("3", "IC50", "=", "5", "2024-01-01T00:04:00"))
    aside, seen = str(tmp_path / "aside"), str(tmp_path / "seen")
    landing.append(landing.bad_lines(landing.landed_lines(spark, folder, schema)), aside, seen).awaitTermination(120)
    assert sorted(r.value for r in spark.read.parquet(aside).collect()) == ["[1]", "{broken", "{broken"]


def test_ranked_importance(spark):
    cols = "feature string, importance_mean double, importance_sd double"
    impurity = spark.createDataFrame([("a", 0.2, 0.0), ("b", 0.5, 0.1), ("c", 0.2, 0.0)], cols)
    permutation = spark.createDataFrame([("a", 0.4, 0.0), ("b", 0.1, 0.1)], cols)
    signs = spark.createDataFrame([("a", -0.5, "down"), ("b", 0.01, "neutral"), ("d", 0.9, "up")], "feature string, rho double, direction string")
    got = [(r.feature, r.impurity_rank, r.permutation_rank, r.direction) for r in mo.ranked_importance(impurity, permutation, signs).collect()]
    assert got == [("a", 2, 1, "down"), ("b", 1, 2, "neutral"), ("c", 2, None, None), ("d", None, None, "up")]
