"""Projections, predicates and scalar rules."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import clean as c
from ..registry import query

TRIM = "trim({0}, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"


def strip_sql(x: str) -> str:
    return TRIM.format(x)


def normal_sql(x: str) -> str:
    """Normal form of text that has no compatibility characters."""
    return strip_sql(rf"regexp_replace(lower({x}), '\s+', ' ', 'g')")


# A text cell that may be missing: blanks and the word nan.
LINE = "text"


@query("p01_clean_text", f"""
    WITH d AS (SELECT doc_id, {strip_sql(LINE)} AS v FROM documents)
    SELECT doc_id, CASE WHEN v <> '' AND lower(v) <> 'nan' THEN v END AS cleaned FROM d""")
def clean_text(t):
    return t.documents.select("doc_id", c.clean_text("text").alias("cleaned"))


@query("p02_to_number", """
    SELECT event_id, CAST(props->>'k' AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad, value AS number
    FROM events""")
def to_number(t):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("\t"))
    return t.events.select("event_id", c.to_number(k).alias("k"), c.to_number("event_type").alias("bad"), c.to_number(text).alias("number"))


@query("p03_first_present", f"""
    WITH d AS (SELECT doc_id, {strip_sql(LINE)} AS a, {strip_sql('source')} AS b FROM documents)
    SELECT doc_id, coalesce(nullif(a, ''), nullif(b, '')) AS found, nullif(b, '') AS only_fallback FROM d""")
def first_present(t):
    return t.documents.select(
        "doc_id", c.first_present("text", "source").alias("found"), c.first_present(None, "source").alias("only_fallback")
    )


@query("p04_parse_bool3", """
    SELECT doc_id, quality = 1 AS quality_flag, toxic = 1 AS toxic_flag, CAST(NULL AS BOOLEAN) AS unknown FROM labels""")
def parse_bool3(t):
    words = F.when(F.col("quality") == 1, " Yes ").otherwise("0.0")
    return t.labels.select(
        "doc_id", c.parse_bool3(words).alias("quality_flag"), c.parse_bool3("toxic").alias("toxic_flag"),
        c.parse_bool3(F.concat(F.lit("maybe "), F.col("toxic").cast("string"))).alias("unknown"),
    )


@query("p05_normalize_text", f"SELECT doc_id, {normal_sql('text')} AS normal FROM documents")
def normalize_text(t):
    return t.texts().select("doc_id", c.normalize_text("text").alias("normal"))


@query("p06_combine_text", """
    SELECT doc_id, lang || ' | ' || coalesce(nullif(source, 'src1'), '') || ' | ' || CAST(n_chars AS VARCHAR) AS combined FROM documents""")
def combine_text(t):
    return t.documents.select(
        "doc_id", c.combine_text(["lang", F.nullif("source", F.lit("src1")), "n_chars"]).alias("combined")
    )


@query("p07_nested_to_json", """
    SELECT event_id, '{"event":"' || event_type || '","k":"' || (props->>'k') || '"}' AS js,
           CASE WHEN event_type = 'view' THEN '' ELSE '["' || event_type || '"]' END AS lst FROM events""")
def nested_to_json(t):
    kind = T.MapType(T.StringType(), T.StringType())
    pairs = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event"), F.col("event_type"))
    items = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array("event_type"))
    return t.events.select(
        "event_id", c.nested_to_json(pairs, kind).alias("js"),
        c.nested_to_json(items, T.ArrayType(T.StringType())).alias("lst"),
    )


@query("p08_upper_labels", "SELECT upper(event_type) AS label, count(*) AS n FROM events GROUP BY 1")
def upper_labels(t):
    return t.events.groupBy(F.upper("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("p09_conform_schema", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_acctbal, CAST(NULL AS VARCHAR) AS region, c_name FROM customer""")
def conform_schema(t):
    return c.conform_schema(t.customer, T.StructType.fromDDL("c_custkey string, c_acctbal double, region string, c_name string"))


@query("p10_strict_filter", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_extendedprice IS NOT NULL""")
def strict_filter(t):
    rows = c.strict_filter(t.lineitem, {"l_returnflag": "R", "l_linestatus": "O"}, ["l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


# Events as measurements: a relation, an upper bound and a missing value follow from the payload.
EVENT_FACTS = """e AS (SELECT event_id, event_type, value,
    CASE CAST(props->>'k' AS INT) % 5 WHEN 0 THEN '=' WHEN 1 THEN '>' WHEN 2 THEN '<=' WHEN 3 THEN '=' END AS relation,
    CASE WHEN CAST(props->>'k' AS INT) > 90 THEN value * 2 END AS upper FROM events)"""


def event_facts(t):
    k = F.get_json_object("props", "$.k").cast("int")
    relation = F.when(k % 5 == 0, "=").when(k % 5 == 1, ">").when(k % 5 == 2, "<=").when(k % 5 == 3, "=")
    return t.events.select(
        "event_id", "event_type", "user_id", "value", "props", relation.alias("relation"),
        F.when(k > 90, F.col("value") * 2).alias("upper"),
    )


CENSOR = ["exact", "non_exact", "interval", "right_censored", "left_censored"]


def censored(t):
    df = event_facts(t)
    flags = c.classify_censoring(F.col("event_type"), F.col("relation"), F.col("value"), F.col("upper"), "purchase")
    return df.withColumns(flags)


CENSOR_SQL = f"""{EVENT_FACTS}, x AS (SELECT *, event_type = 'purchase' AS p,
       event_type = 'purchase' AND coalesce(relation = '=', false) AND value IS NOT NULL AND upper IS NULL AS exact FROM e),
  f AS (SELECT event_id, event_type, exact, p AND NOT exact AS non_exact, p AND upper IS NOT NULL AS interval,
       p AND coalesce(relation = '>', false) AS right_censored, p AND coalesce(relation = '<=', false) AS left_censored FROM x)"""


@query("p11_classify_censoring", f"WITH {CENSOR_SQL} SELECT event_id, exact, non_exact, \"interval\", right_censored, left_censored FROM f")
def classify_censoring(t):
    return censored(t).select("event_id", *CENSOR)


DOC_FLAGS = ["text_contains_inactive", "single_point", "missing_structure", "potential_duplicate_true",
             "has_validity_comment", "missing_organism", "has_text_value"]


def flagged_documents(t):
    """Documents as records; the wording rule looks for two frequent words."""
    docs = t.texts().join(t.labels, "doc_id", "left")
    flags = c.record_flags(
        comments=[F.col("text"), F.col("source")], kind=F.concat(F.col("lang"), F.lit("inhib")), wanted="ENINHIB",
        structure=F.col("text"), duplicate=F.col("toxic").cast("string"),
        validity=F.nullif("source", F.lit("src3")), organism=F.nullif("lang", F.lit("fr")),
        text_value=F.col("quality").cast("string"), inactive_pattern=r"\bthe\b|\bund\s+die\b",
    )
    return docs.withColumns(flags)


EDGE = r"[^\p{L}\p{N}_]"
FLAGS_SQL = rf"""f AS (SELECT documents.doc_id,
    regexp_matches(lower(text), '(^|{EDGE})(the|und\s+die)($|{EDGE})') AS text_contains_inactive,
    lang <> 'en' AS single_point, {strip_sql("text")} = '' AS missing_structure,
    coalesce(toxic = 1, false) AS potential_duplicate_true, source <> 'src3' AS has_validity_comment,
    lang = 'fr' AS missing_organism, quality IS NOT NULL AS has_text_value
  FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)"""


@query("p12_record_flags", f"WITH {FLAGS_SQL} SELECT * FROM f")
def record_flags(t):
    return flagged_documents(t).select("doc_id", *DOC_FLAGS)


@query("p13_flags_to_list", f"""WITH {FLAGS_SQL}
    SELECT doc_id, concat_ws(';', {", ".join(f"CASE WHEN {x} THEN '{x}' END" for x in DOC_FLAGS)}) AS flags FROM f""")
def flags_to_list(t):
    return flagged_documents(t).select("doc_id", c.flags_to_list(DOC_FLAGS).alias("flags"))


@query("p14_review_mask", f"""WITH {CENSOR_SQL}
    SELECT event_id FROM f WHERE non_exact OR "interval" OR right_censored OR left_censored""")
def review_mask(t):
    return censored(t).where(c.any_flag(["non_exact", "interval", "right_censored", "left_censored"])).select("event_id")


@query("p15_neg_log10_molar", """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, -log10(l_extendedprice * 1e-9) AS computed FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(computed, 6) AS computed, round(5 - computed, 6) AS value_delta FROM x""")
def neg_log10_molar(t):
    computed = c.neg_log10_molar(F.col("l_extendedprice"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(computed, 6).alias("computed"), F.round(5 - computed, 6).alias("value_delta")
    )


@query("p16_threshold_label", """
    SELECT p_partkey, CAST(p_size >= 25 AS INTEGER) AS label FROM part""")
def threshold_label(t):
    return t.part.select("p_partkey", c.threshold_label(F.col("p_size").cast("double"), 25.0).alias("label"))


@query("p17_bucketize", """
    WITH x AS (SELECT p_partkey, p_size, p_size / 50.0 - 0.5 AS rho FROM part)
    SELECT p_partkey,
      CASE WHEN p_size % 8 >= 5 THEN 'well_specified' WHEN p_size % 8 >= 3 THEN 'partially_specified' ELSE 'low_information' END AS information,
      CASE WHEN p_size * 4 >= 100 THEN 'sufficient' WHEN p_size * 4 >= 40 THEN 'marginal' WHEN p_size > 0 THEN 'too_few' ELSE 'none' END AS verdict,
      CASE WHEN abs(rho) > 0.3 THEN 'confound_possible' WHEN abs(rho) > 0.15 THEN 'mild_trend' ELSE 'independent' END AS confound,
      CASE WHEN rho > 0.05 THEN 'up' WHEN rho < -0.05 THEN 'down' ELSE 'neutral' END AS direction,
      CASE WHEN abs(rho - rho / 2) < 0.1 THEN 'signal_holds' ELSE 'partly_explained' END AS partial FROM x""")
def bucketize(t):
    size, rho = F.col("p_size"), F.col("p_size") / 50.0 - 0.5
    return t.part.select(
        "p_partkey", c.information_level(size % 8).alias("information"), c.delta_size_verdict(size * 4).alias("verdict"),
        c.confound_level(rho).alias("confound"), c.direction_arrow(rho).alias("direction"),
        c.partial_verdict(rho, rho / 2).alias("partial"),
    )


@query("p18_triage_priority", f"""
    WITH d AS (SELECT documents.doc_id, coalesce(toxic = 1, false) AS err, length({normal_sql('text')}) < 25 AS sparse,
                      coalesce(quality = 1, false) AS cand FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)
    SELECT doc_id, CASE WHEN err OR sparse THEN 'high' WHEN cand THEN 'candidate_strict' ELSE 'normal' END AS priority FROM d""")
def triage_priority(t):
    docs = t.texts().join(t.labels, "doc_id", "left")
    error, good = (F.coalesce(F.col(x) == 1, F.lit(False)) for x in ("toxic", "quality"))
    return docs.select("doc_id", c.triage_priority(error, c.is_sparse("text"), good).alias("priority"))


@query("p19_candidate_flags", """
    WITH d AS (SELECT doc_id, contains(lower(text), 'the') AS a, contains(lower(text), 'and') AS b, lang = 'en' AS f,
                      contains(lower(text), 'of') AS g, contains(lower(text), 'license') AS x FROM documents)
    SELECT doc_id, a AND b AS candidate_signal_trigger, f AND g AS candidate_functional_direction,
           a AND b AND f AND g AND NOT x AS candidate_strict FROM d""")
def candidate_flags(t):
    low = F.lower("text")
    flags = c.candidate_flags(
        low.contains("the"), low.contains("and"), F.col("lang") == "en", low.contains("of"), low.contains("license")
    )
    return t.texts().select("doc_id", *[v.alias(k) for k, v in flags.items()])


@query("p20_text_length", f"""
    SELECT doc_id, length({normal_sql('text')}) AS n, length({normal_sql('text')}) < 25 AS sparse FROM documents""")
def text_length(t):
    return t.texts().select("doc_id", c.text_length("text").cast("long").alias("n"), c.is_sparse("text").alias("sparse"))


@query("p21_link_columns", """
    SELECT doc_id, 'https://example.org/doc/' || doc_id || '.json' AS doc_url,
           CASE WHEN source = 'src1' THEN '' ELSE 'https://example.org/source/' || source || '.json' END AS source_url FROM documents""")
def link_columns(t):
    return t.documents.select(
        "doc_id", c.link_column("https://example.org/doc/%s.json", F.col("doc_id")).alias("doc_url"),
        c.link_column("https://example.org/source/%s.json", F.nullif("source", F.lit("src1"))).alias("source_url"),
    )


@query("p22_is_finite", """
    SELECT vec_id, true AS all_finite, embedding[1] > 0 AS one_finite,
           CASE WHEN label = 3 THEN false ELSE true END AS scaled_finite FROM embeddings""")
def is_finite(t):
    """Label 3 rows are scaled out of range, negative first cells to NaN."""
    first = F.col("embedding")[0]
    scale = F.when(F.col("label") == 3, float("inf")).otherwise(1.0)
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    return t.embeddings.select(
        "vec_id", c.array_is_finite("embedding").alias("all_finite"),
        c.is_finite(F.when(first > 0, first.cast("double")).otherwise(float("nan"))).alias("one_finite"),
        c.array_is_finite(scaled).alias("scaled_finite"),
    )


@query("p23_fold_change", "SELECT l_orderkey, l_linenumber, l_partkey, round(pow(10, l_discount), 6) AS fold FROM lineitem")
def fold_change(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(c.fold_change(F.col("l_discount")), 6).alias("fold"))


def largest_sql(x: str) -> str:
    parts = f"list_filter(string_split({x}, chr(10)), lambda p: {strip_sql('p')} <> '')"
    return f"list_filter({parts}, lambda p: length(p) = list_max(list_transform({parts}, lambda q: length(q))))[1]"


@query("p24_largest_component", f"SELECT doc_id, {largest_sql('text')} AS part FROM documents")
def largest_component(t):
    return t.texts().select("doc_id", c.largest_component("text").alias("part"))


@query("p25_identity_key", f"""
    SELECT doc_id, CASE WHEN {normal_sql('text')} <> '' THEN sha256({normal_sql('text')}) END AS entity_key FROM documents""")
def identity_key(t):
    return t.texts().select("doc_id", c.identity_key("text").alias("entity_key"))


@query("p26_empty_group_sentinel", """
    SELECT CASE WHEN source = 'src2' THEN 'UNGROUPED::' || doc_id ELSE source END AS grp, count(*) AS n FROM documents GROUP BY 1""")
def empty_group_sentinel(t):
    blank = F.when(F.col("source") == "src2", " ").otherwise(F.col("source"))
    return t.documents.groupBy(c.empty_group_sentinel(blank, F.col("doc_id")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
