from pyspark.sql import functions as F

from mensura.functions import rules as r
from mensura.functions.rulebook import SIGNATURE_FIELDS, keyword_rules
from mensura.plans.protocol import FIELDS, decompose


def parse(spark, *texts):
    df = spark.createDataFrame([(i, t, 60) for i, t in enumerate(texts)], "i int, d string, n_entities int")
    return decompose(df, "d", "ABC1").orderBy("i").collect()


def test_protocol_values_and_confidence(spark):
    text = (
        "Assay (15 minutes) CHO cells expressing human ABC1 were loaded with calcium indicator dye for 1 hr, followed by 30 minutes at room "
        "temperature. Cells were incubated with compounds for 10 minutes or 90 minutes at room temperature prior to adding agonist "
        "cinnamaldehyde at an EC80 concentration of 30 uM. Hill coefficient was fixed to 1.5."
    )
    (row,) = parse(spark, text)
    assert row.assay_modality == "calcium_fluorescence"
    assert row.challenge_agonist == "cinnamaldehyde" and row.challenge_agonist__confidence == "explicit_description"
    assert row.agonist_level == "EC80"
    assert row.agonist_concentration == "30" and row.agonist_concentration__confidence == "explicit_with_units"
    assert row.cell_line == "CHO" and row.construct == "not_reported" and row.construct__confidence == "unknown"
    assert row.compound_preincubation_min is None
    assert row.compound_preincubation_min__confidence == "ambiguous"
    assert row.compound_preincubation_candidates == "10;90"
    assert row.assay_title_time_min == "15" and row.plate_equilibration_min == "30"
    assert row.dye_loading_time == "1 hr" and row.hill_coefficient_fixed == "1.5"
    assert row.application_order == "compound_before_agonist"
    assert row.review_priority == "critical" and row.requires_source_review
    assert row.protocol_signature.split(" | ")[0] == "human" and len(row.protocol_signature.split(" | ")) == len(SIGNATURE_FIELDS)


def test_protocol_unclear_cases(spark):
    none, bare, mixed, late, species, empty = parse(
        spark,
        "binding assay",
        "Inhibition of AITC (75) response",
        "FLIPR and patch clamp with AITC or carvacrol in HEK293 and CHO, wild type and mutant",
        "x" * 80 + " (15 minutes)",
        "human and rat ABC1",
        None,
    )
    assert none.n_unknown_fields >= 10 and none.challenge_agonist is None
    assert bare.agonist_concentration is None and bare.agonist_concentration_unresolved_token == "75"
    assert mixed.assay_modality == "mixed_calcium_and_ephys" and " || " in mixed.assay_modality__evidence
    assert mixed.challenge_agonist == "AITC;carvacrol" and mixed.challenge_agonist__confidence == "ambiguous_multiple"
    assert mixed.cell_line == "CHO;HEK293" and mixed.construct == "mutant_or_chimera"
    assert late.assay_title_time_min is None
    assert species.species_mentioned_in_text == "human;rat" and species.text_mentions_other_species
    assert not empty.text_mentions_other_species and empty.construct == "not_reported"
    assert [empty[f] for f in FIELDS if f != "construct"] == [None] * (len(FIELDS) - 1)


def test_evidence_window(spark):
    texts = ["a" * 70 + "\nKEY 5\n" + "b" * 70, "KEY 7", "\U0001F600" * 65 + "KEY 9", "no"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", r.extract_field(F.col("t"), r"KEY (\d)").alias("f")).orderBy("i").collect()
    assert got[0].f.value == "5" and got[0].f.evidence == "a" * 59 + " KEY 5 " + "b" * 59
    assert got[1].f.evidence == "KEY 7"
    assert got[2].f.value == "9" and got[2].f.evidence == "\U0001F600" * 60 + "KEY 9"
    assert got[3].f is None


def test_micro_sign_variants(spark):
    rows = parse(spark, "AITC at 30 µM", "AITC at 30 μM", "AITC at 30 uM", "AITC at 30")
    assert [x.agonist_concentration for x in rows] == ["30", "30", "30", None]


def test_unicode_word_edges(spark):
    df = spark.createDataFrame([("éagonist",), ("agonisté",), ("an agonist.",)], "t string")
    got = [x.h for x in df.select(r.found(F.col("t"), r"\bagonist\b").alias("h")).collect()]
    assert got == [False, False, True]


def test_keyword_matrix(spark):
    df = spark.createDataFrame(
        [(1, "fura-2 calcium flux in hek293t cells, habc1 wt"), (2, "nothing here"), (3, "pre-incubated before aitc")], "i int, t string"
    )
    out = {x.i: x for x in r.keyword_matrix(df, "t", keyword_rules("ABC1")).collect()}
    assert out[1].matches_calcium == "calcium;calcium_flux;fura-2" and out[1].flag_hek293
    assert out[1].matches_human == "hABC1" and out[1].matches_wild_type == "WT"
    assert not any(out[2][f"flag_{c}"] for c in keyword_rules("ABC1"))
    assert out[3].matches_preincubation == "before_agonist;preincubation"


def test_signature_and_priority(spark):
    df = spark.createDataFrame([(None, "a"), ("nan", None)], "x string, y string")
    assert [v.s for v in df.select(r.signature(["x", "y"]).alias("s")).collect()] == ["NA | a", "NA | NA"]
    cases = [(50, 1, 0), (10, 1, 0), (50, 0, 3), (50, 0, 2), (10, 0, 4), (10, 0, 3)]
    df = spark.createDataFrame(cases, "n int, a int, u int")
    got = [v.p for v in df.select(r.review_priority(F.col("n"), F.col("a"), F.col("u")).alias("p")).collect()]
    assert got == ["critical", "high", "high", "medium", "medium", "low"]


def test_required_words_lose_no_match(spark):
    """Every pattern finds the same texts with and without the words it needs, also where letters outside ASCII fold to it."""
    from mensura.functions.rulebook import keyword_rules, protocol_patterns
    from mensura.functions.rules import found, java, required_words

    assert required_words(r"\bcalcium[ -]flux\b") == ["calcium"]
    assert required_words(r"\bmutant\b|\b[A-Z]\d{2,4}[A-Z]\b") == []
    assert required_words(r"x?(?:ab)*") == []
    assert [required_words(p) for p in (r"(?i)abc", r"\p{L}abc", r"[a&&[^b]]c", r"a(?-i:b)")] == [[]] * 4
    flat, stack = [], [list(keyword_rules("XYZ1").values()), list(protocol_patterns("XYZ1").values())]
    while stack:
        one = stack.pop()
        stack.extend(one) if isinstance(one, (list, tuple)) else flat.append(one)
    patterns = sorted(set(flat))
    texts = ["", "Calcium FLUX by FLIPR", "Kelvin patıent", "CALCİUM", "ca 2+ a whole cell", "Mouse r XYZ1 hXYZ1 rat", "epſilon before adding",
             "blocKed by a cho-k1 F-11 H2O2", "WILD type µM EC 50 concentration", "agoniſt evoKed", "at patch clamp muſtard oil", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    for ignore in (True, False):
        got = df.select(*[found(t, p, ignore).alias(f"a{i}") for i, p in enumerate(patterns)],
                        *[F.coalesce(t.rlike(java(p, ignore)), F.lit(False)).alias(f"b{i}") for i, p in enumerate(patterns)]).collect()
        for row in got:
            assert row[: len(patterns)] == row[len(patterns):]
        assert any(row[i] for row in got for i in range(len(patterns)))


def test_audit_scans_texts_in_all_partitions(spark):
    """The join with small counts does not leave the scan of the texts to one task."""
    from mensura.plans.audit import audit

    docs = spark.range(200).select(F.col("id").cast("string").alias("source_id"), F.lit("calcium flux").alias("description"))
    table, _ = audit(docs.select("source_id", F.lit("e").alias("entity_id")), docs, "XYZ1")
    assert table.count() == 200 and table.where("flag_calcium AND description_length = 12").count() == 200
    from mensura.session import spread_wide

    assert spread_wide(docs.limit(5), "source_id").rdd.getNumPartitions() >= 8
