"""Text-rule annotation on the whole text of the documents.

Word edges are Unicode-aware. The statements spell ``\\b`` out as a character class because
their regex engine knows only ASCII edges.
"""

from pyspark.sql import functions as F

from ...functions import rules as r
from ...functions.rulebook import SUBSTRING_FLAGS
from ..registry import query
from .cleaning import EDGE, normal_sql, strip_sql

# (label, pattern) → and the same words for the statement.
WORDS = {
    "license": ["license", "licensed", "gnu", "apache", "mit"],
    "english": ["the", "and", "with", "that", "this"],
    "french": ["les", "des", "dans", "pour", "une"],
    "german": ["und", "der", "die", "nicht", "mit"],
    "spanish": ["los", "del", "que", "para", "con"],
    "secret": ["token", "version", "public"],
}
RULEBOOK = {cat: [(w, rf"\b{w}\b") for w in words] for cat, words in WORDS.items()}
RULEBOOK["contact"] = [
    ("email", r"\b\w+@\w+\.example\.com\b"), ("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}\b"), ("ip", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
]
CONTACT_SQL = [
    ("email", r"[\p{L}\p{N}_]@[\p{L}\p{N}_]+\.example\.com(" + EDGE + "|$)"),
    ("phone", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(" + EDGE + "|$)"),
    ("ip", r"(^|" + EDGE + r")[0-9]{1,3}(\.[0-9]{1,3}){3}(" + EDGE + "|$)"),
]


def word_sql(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(^|{EDGE})({pattern})({EDGE}|$)')"


def _matches_sql(text: str, cat: str) -> str:
    if cat == "contact":
        tests = [(w, f"regexp_matches({text}, '{p}')") for w, p in CONTACT_SQL]
    else:
        tests = [(w, word_sql(text, w)) for w in WORDS[cat]]
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {cond} THEN '{w}' END" for w, cond in sorted(tests)) + ")"


MATCHES_SQL = ", ".join(f"{_matches_sql('normal', c)} AS matches_{c}" for c in RULEBOOK)
KEYWORD_SQL = f"""n AS (SELECT doc_id, lang, source, {normal_sql('text')} AS normal FROM documents),
    k AS (SELECT doc_id, lang, source, {MATCHES_SQL} FROM n)"""


def keyword_documents(t):
    from ...functions.clean import normalize_text

    docs = t.texts().select("doc_id", "lang", "source", normalize_text("text").alias("normal"))
    return r.keyword_matrix(docs, "normal", RULEBOOK).drop("normal")


@query("t01_keyword_matrix", f"""WITH {KEYWORD_SQL} SELECT *,
    {", ".join(f"matches_{c} <> '' AS flag_{c}" for c in RULEBOOK)} FROM k""")
def keyword_matrix(t):
    return keyword_documents(t)


@query("t02_contains_any", "SELECT doc_id, " + ", ".join(
    "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f") AS has_{name}" for name, words in
    {**{k.lower(): v for k, v in SUBSTRING_FLAGS.items()}, "license": ["license", "copyright"], "contact": ["@", "http", "+1 ("]}.items()) + " FROM documents")
def contains_any(t):
    lists = {**{k.lower(): v for k, v in SUBSTRING_FLAGS.items()}, "license": ["license", "copyright"], "contact": ["@", "http", "+1 ("]}
    return t.texts().select("doc_id", *[r.contains_any("text", words).alias(f"has_{n}") for n, words in lists.items()])


def evidence_sql(text: str, whole: str) -> str:
    """``whole`` is an expression for the full match, which must be its first occurrence."""
    at = f"strpos({text}, {whole})"
    window = f"substr({text}, greatest({at} - 60, 1), least({at} - 1, 60) + length({whole}) + 60)"
    return f"CASE WHEN {whole} <> '' THEN {strip_sql(f'replace({window}, chr(10), chr(32))')} END"


PHONE = r"\+1 \((\d{3})\) \d{3}-\d{4}"


@query("t03_extract_field", rf"""
    WITH d AS (SELECT doc_id, text, regexp_extract(text, '{PHONE}', 0) AS whole, regexp_extract(text, '{PHONE}', 1) AS v FROM documents)
    SELECT doc_id, nullif(v, '') AS value, {evidence_sql('text', 'whole')} AS evidence FROM d""")
def extract_field(t):
    return t.texts().select("doc_id", r.extract_field(F.col("text"), PHONE).alias("f")).select(
        "doc_id", F.col("f.value").alias("value"), F.col("f.evidence").alias("evidence")
    )


@query("t04_extract_all", r"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '([Vv]ersion [0-9.]+|\([0-9]+\))', 1),
           lambda x: replace(upper(x), ' ', '')))), ';') AS found FROM documents""")
def extract_all(t):
    found = r.extract_all(F.col("text"), r"([Vv]ersion [0-9.]+|\([0-9]+\))", 1, lambda x: F.upper(F.replace(x, F.lit(" "), F.lit(""))))
    return t.texts().select("doc_id", F.array_join(found, ";").alias("found"))


LABELS = [("english", r"\bthe\b"), ("french", r"\bles\b"), ("german", r"\bund\b"), ("spanish", r"\blos\b")]
LABEL_SQL = "concat_ws(';', " + ", ".join(f"CASE WHEN {word_sql('lower(text)', p[2:-2])} THEN '{lab}' END" for lab, p in LABELS) + ")"


def _labels(t):
    return t.texts().select("doc_id", r.multi_label(F.col("text"), LABELS).alias("f"))


@query("t05_multi_label", f"""
    WITH d AS (SELECT doc_id, {LABEL_SQL} AS v FROM documents)
    SELECT doc_id, nullif(v, '') AS value, CASE WHEN v = '' THEN 'unknown' WHEN contains(v, ';') THEN 'ambiguous_multiple'
           ELSE 'explicit_description' END AS confidence FROM d""")
def multi_label(t):
    return _labels(t).select("doc_id", "f.value", "f.confidence")


A_PAT, B_PAT = r"[A-Za-z]+@[A-Za-z]+|\d+@mail", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"


@query("t06_conflict_label", rf"""
    WITH d AS (SELECT doc_id, text, contains(lower(text), 'the') AS a, regexp_matches(text, '{B_PAT}') AS b,
        regexp_extract(text, '(token|License|the)', 0) AS wa, regexp_extract(text, '{B_PAT}', 0) AS wb FROM documents),
    e AS (SELECT doc_id, a, b, {evidence_sql('text', 'wa')} AS ea, {evidence_sql('text', 'wb')} AS eb FROM d)
    SELECT doc_id, CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'words' WHEN b THEN 'address' END AS value,
      CASE WHEN a AND b THEN coalesce(ea, 'None') || ' || ' || eb WHEN a THEN ea WHEN b THEN eb END AS evidence,
      CASE WHEN a OR b THEN 'explicit_description' ELSE 'unknown' END AS confidence FROM e""")
def conflict_label(t):
    """The word detector ignores case, its evidence pattern is narrower and is matched with case."""
    f = r.conflict_label(F.col("text"), ("words", "the", "(?-i)(token|License|the)"), ("address", B_PAT, B_PAT), "mixed")
    return t.texts().select("doc_id", f.alias("f")).select("doc_id", "f.*")


ORDER_RULES = [("apache", r"\bApache\b"), ("gnu", r"\bGNU\b"), ("other", r"\bLicense\b")]


@query("t07_precedence_label", f"""
    WITH d AS (SELECT doc_id, text, CASE WHEN {word_sql('text', 'Apache')} THEN 'apache' WHEN {word_sql('text', 'GNU')} THEN 'gnu'
                  WHEN {word_sql('text', 'License')} THEN 'other' END AS v, regexp_extract(text, '(Released|Licensed|licensed)', 0) AS whole FROM documents)
    SELECT doc_id, coalesce(v, 'not_reported') AS value, {evidence_sql('text', 'whole')} AS evidence,
           CASE WHEN v IS NULL THEN 'unknown' ELSE 'explicit_description' END AS confidence FROM d""")
def precedence_label(t):
    f = r.precedence_label(F.col("text"), ORDER_RULES, "not_reported", "(?-i)(Released|Licensed|licensed)", ignore_case=False)
    return t.texts().select("doc_id", f.alias("f")).select("doc_id", "f.*")


UNIT, BARE = r"[Vv]ersion (\d+\.\d+)", r"\((\d+)\)"


@query("t08_number_with_unit", rf"""
    WITH d AS (SELECT doc_id, text, regexp_extract(text, '{UNIT}', 0) AS wu, regexp_extract(text, '{UNIT}', 1) AS u,
                      regexp_extract(text, '{BARE}', 0) AS wb, regexp_extract(text, '{BARE}', 1) AS b FROM documents)
    SELECT doc_id, nullif(u, '') AS value, CASE WHEN u <> '' THEN 'explicit_with_units' ELSE 'unknown' END AS confidence,
           CASE WHEN u <> '' THEN {evidence_sql('text', 'wu')} ELSE {evidence_sql('text', 'wb')} END AS evidence,
           CASE WHEN u = '' THEN nullif(b, '') END AS token FROM d""")
def number_with_unit(t):
    f, token = r.number_with_unit(F.col("text"), UNIT, BARE)
    return t.texts().select("doc_id", f.alias("f"), token.alias("token")).select("doc_id", "f.*", "token")


CLAUSES = [r"(?-i)\+1 ([^.,]{0,60})", r"(?-i)version ([^,]{0,20})"]


@query("t09_clause_then_numbers", r"""
    WITH d AS (SELECT doc_id, coalesce(CASE WHEN regexp_matches(text, '\+1 [^.,]{0,60}') THEN regexp_extract(text, '\+1 ([^.,]{0,60})', 1) END,
                      CASE WHEN regexp_matches(text, 'version [^,]{0,20}') THEN regexp_extract(text, 'version ([^,]{0,20})', 1) END) AS clause FROM documents),
    e AS (SELECT doc_id, regexp_extract_all(clause, '([0-9]+)-', 1) AS near, regexp_extract_all(clause, '([0-9]+)', 1) AS plain FROM d),
    n AS (SELECT doc_id, CASE WHEN len(near) > 0 THEN near ELSE coalesce(plain, []) END AS nums FROM e)
    SELECT doc_id, CASE WHEN len(nums) = 1 THEN nums[1] END AS value,
           CASE WHEN len(nums) = 1 THEN 'explicit_description' WHEN len(nums) > 1 THEN 'ambiguous' ELSE 'unknown' END AS confidence,
           CASE WHEN len(nums) > 0 THEN array_to_string(nums, ';') END AS candidates FROM n""")
def clause_then_numbers(t):
    f, candidates = r.clause_then_numbers(F.col("text"), CLAUSES, r"(\d+)-", r"(\d+)")
    return t.texts().select("doc_id", f.alias("f"), candidates.alias("candidates")).select("doc_id", "f.value", "f.confidence", "candidates")


@query("t10_prefix_extract", r"""
    SELECT doc_id, nullif(regexp_extract(substr(text, 1, 80), '(the|les|und|los) ', 1), '') AS value,
           CASE WHEN regexp_matches(substr(text, 1, 80), '(the|les|und|los) ') THEN 'inferred_from_title' ELSE 'unknown' END AS confidence FROM documents""")
def prefix_extract(t):
    f = r.prefix_extract(F.col("text"), r"(?-i)(the|les|und|los) ")
    return t.texts().select("doc_id", f.alias("f")).select("doc_id", "f.value", "f.confidence")


FOUR = {
    "code": r"token = \"([0-9a-f]+)\"", "area": r"\+1 \((\d{3})\)", "line": r"\d{3}-(\d{4})", "release": r"Version (\d+\.\d+)",
    "third": r"version (\d+)",
}


@query("t11_separate_fields", "SELECT doc_id, " + ", ".join(
    "nullif(regexp_extract(text, '" + p.replace('\\"', '"') + f"', 1), '') AS {n}" for n, p in FOUR.items()) + " FROM documents")
def separate_fields(t):
    """Similar numbers stay in separate fields, each with its own pattern."""
    cols = [r.extract_value(F.col("text"), p, ignore_case=False).alias(n) for n, p in FOUR.items()]
    return t.texts().select("doc_id", *cols)


SIGNATURE = ["o_orderstatus", "prio", "year", "big"]
SIGNED_SQL = """o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS prio,
    CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_totalprice > 400000 THEN 'big' END AS big FROM orders),
  s AS (SELECT *, concat_ws(' | ', o_orderstatus, coalesce(prio, 'NA'), CAST(year AS VARCHAR), coalesce(big, 'NA')) AS sig,
    1 + CAST(prio IS NOT NULL AS INTEGER) + 1 + CAST(big IS NOT NULL AS INTEGER) AS n_known FROM o)"""


def signed_orders(t):
    orders = t.orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("prio"), F.year("o_orderdate").alias("year"),
        F.when(F.col("o_totalprice") > 400000, "big").alias("big"),
    )
    known = r.count_by_confidence([], [F.col(c) for c in SIGNATURE])["n_known"]
    return orders.select("*", r.signature(SIGNATURE).alias("sig"), known.alias("n_known"))


@query("t12_signature", f"WITH {SIGNED_SQL} SELECT sig, n_known, count(*) AS n FROM s GROUP BY 1, 2")
def signature(t):
    return signed_orders(t).groupBy("sig", "n_known").agg(F.count(F.lit(1)).alias("n"))


CONF_SQL = f"""c AS (SELECT doc_id, n_chars, {LABEL_SQL} AS v1,
    CASE WHEN {word_sql('text', 'Apache')} THEN 'apache' WHEN {word_sql('text', 'GNU')} THEN 'gnu' WHEN {word_sql('text', 'License')} THEN 'other' END AS v2
    FROM documents), q AS (SELECT doc_id, n_chars, CAST(contains(v1, ';') AS INTEGER) AS n_ambiguous,
    CAST(v1 = '' AS INTEGER) + CAST(v2 IS NULL AS INTEGER) AS n_unknown,
    CAST(v1 <> '' AS INTEGER) + CAST(v2 IS NOT NULL AS INTEGER) AS n_known FROM c)"""


def confident_documents(t):
    a = r.multi_label(F.col("text"), LABELS)
    b = r.precedence_label(F.col("text"), ORDER_RULES, None, ignore_case=False)
    docs = t.texts().select("doc_id", "n_chars", a.alias("a"), b.alias("b"))
    return docs.withColumns(r.count_by_confidence([F.col("a.confidence"), F.col("b.confidence")], [F.col("a.value"), F.col("b.value")]))


@query("t13_count_by_confidence", f"WITH {CONF_SQL} SELECT doc_id, n_ambiguous, n_unknown, n_known FROM q")
def count_by_confidence(t):
    return confident_documents(t).select("doc_id", "n_ambiguous", "n_unknown", "n_known")


@query("t14_review_priority", f"""WITH {CONF_SQL}, p AS (SELECT doc_id, CASE WHEN n_ambiguous > 0 AND n_chars >= 500 THEN 'critical'
    WHEN n_ambiguous > 0 OR (n_chars >= 500 AND n_unknown >= 3) THEN 'high' WHEN n_chars >= 500 OR n_unknown >= 4 THEN 'medium' ELSE 'low' END AS priority FROM q)
    SELECT doc_id, priority, priority IN ('critical', 'high') AS requires_review FROM p""")
def review_priority(t):
    level = r.review_priority(F.col("n_chars"), F.col("n_ambiguous"), F.col("n_unknown"), big=500)
    return confident_documents(t).select("doc_id", level.alias("priority")).withColumn("requires_review", r.requires_review(F.col("priority")))


@query("t15_extra_labels", f"""
    WITH d AS (SELECT doc_id, {LABEL_SQL} AS v FROM documents)
    SELECT doc_id, v <> '' AND v <> 'english' AS has_extra FROM d""")
def extra_labels(t):
    return _labels(t).select("doc_id", r.extra_labels(F.coalesce(F.split("f.value", ";"), F.array().cast("array<string>")), ["english"]).alias("has_extra"))
