"""Feature columns from texts and arrays."""

from pyspark.sql import functions as F

from ...operators import features as f
from ...operators import similarity
from ...session import kept_columns
from ..registry import query, rounded


TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("f01_fingerprint", rf"""
    WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    g AS (SELECT doc_id, unnest([w[i], CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] END, CASE WHEN i < len(w) - 1 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END]) AS gram FROM p)
    SELECT d.doc_id AS doc_id, count(DISTINCT gram) AS n_grams, true AS bits_as_hashed FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY 1""")
def fingerprint(t):
    """Distinct token neighbourhoods of each document, and whether the on-bits are as many as so many hashes
    into 2,048 places set, within six standard deviations."""
    texts = t.texts().select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = f.fingerprint(texts, "text", count="n_grams").select("doc_id", "n_grams", f.on_bits("fingerprint").cast("double").alias("b"))
    places, n = F.lit(float(f.FINGERPRINT_BITS)), F.col("n_grams")
    empty = places * F.pow(1 - 1 / places, n)
    sd = F.sqrt(F.least(empty, n * n / (2 * places)) + 1)
    fits = (F.col("b") <= n) & (F.abs(F.col("b") - (places - empty)) <= 6 * sd)
    return out.select("doc_id", "n_grams", fits.alias("bits_as_hashed"))


def kept_sql(cls: str) -> str:
    """Share of characters in a class: what remains after removing all others."""
    return f"round(length(regexp_replace(text, '[^{cls}]', '', 'g')) / greatest(length(text), 1), 6)"


@query("f02_descriptors", rf"""
    WITH d AS (SELECT doc_id, text, {TOKENS} AS w FROM documents), l AS (SELECT *, list_transform(w, lambda x: length(x)) AS n FROM d)
    SELECT doc_id, length(text)::DOUBLE AS n_chars, len(w)::DOUBLE AS n_tokens,
      CASE WHEN length(text) > 0 THEN (len(string_split(text, chr(10))))::DOUBLE ELSE 0 END AS n_lines,
      {kept_sql('0-9')} AS digit_share, {kept_sql(chr(92) + 'p{Lu}')} AS upper_share, {kept_sql('.,;:!?#$%&*')} AS punct_share,
      {kept_sql(' ' + chr(92) + 'n' + chr(92) + 't')} AS blank_share, round((length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / greatest(length(text), 1), 6) AS accent_share,
      {kept_sql('aeiouAEIOU')} AS vowel_share, round(coalesce(list_sum(n), 0) / greatest(len(w), 1), 6) AS mean_token, coalesce(list_max(n), 0)::DOUBLE AS longest_token,
      round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS distinct_share, round(len(list_filter(n, lambda x: x <= 3)) / greatest(len(w), 1), 6) AS short_share,
      round(len(list_filter(n, lambda x: x >= 8)) / greatest(len(w), 1), 6) AS long_share,
      round(len(string_split(text, chr(10))) * 1000.0::DOUBLE / greatest(length(text), 1), 6) AS lines_per_kchar FROM l""")
def descriptors(t):
    return rounded(f.descriptors(t.texts().select("doc_id", "text"), "text").drop("text"), *f.DESCRIPTORS)


@query("f03_concat_features", """
    SELECT vec_id, len(embedding) + 2 AS n, round(list_sum(embedding) + label + vec_id, 4) AS total FROM embeddings""")
def concat_features(t):
    both = f.concat_features("embedding", F.array(F.col("label").cast("double"), F.col("vec_id").cast("double")))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return t.embeddings.select("vec_id", both.alias("x")).select("vec_id", F.size("x").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("f04_scale_on_train", """
    WITH e AS (SELECT vec_id, label % 3 AS fold, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) AS p(i)),
    s AS (SELECT CAST(j AS INTEGER) AS outer_fold, i, avg(x) AS m, stddev_pop(x) AS sd FROM range(3) AS r(j) JOIN e ON e.fold <> j GROUP BY 1, 2)
    SELECT outer_fold, vec_id, CAST(e.i AS INTEGER) AS position, round((x - m) / sd, 6) AS scaled FROM s JOIN e ON e.i = s.i""")
def scale_on_train(t):
    rows = t.embeddings.select(
        "vec_id", (F.col("label") % 3).alias("fold"), F.transform("embedding", lambda x: x.cast("double")).alias("x"),
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("outer_fold"),
    )
    out = f.scale_on_train(rows, "vec_id", "x", "fold")
    cells = out.select("outer_fold", "vec_id", F.posexplode("scaled").alias("i", "scaled"))
    return rounded(cells.select("outer_fold", "vec_id", (F.col("i") + 1).alias("position"), "scaled"), "scaled")


@query("f05_token_pooling", """
    SELECT vec_id, 8::BIGINT AS n_tokens, CAST(i AS INTEGER) AS position, round(embedding[i + 1]::DOUBLE, 6) AS first,
           round((embedding[i + 9]::DOUBLE + embedding[i + 25]::DOUBLE + embedding[i + 41]::DOUBLE + embedding[i + 57]::DOUBLE) / 4, 6) AS mean
    FROM embeddings, range(8) AS p(i)""")
def token_pooling(t):
    """The 64 numbers of a row read as eight token vectors, every second one masked."""
    spots = F.sequence(F.lit(0), F.lit(7))
    vectors = F.transform(spots, lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(spots, lambda i: i % 2)
    pooled = t.embeddings.select("vec_id", vectors.alias("v"), mask.alias("k")).select(
        "vec_id", F.size("v").cast("long").alias("n_tokens"), f.first_token(F.col("v")).alias("a"), f.masked_mean(F.col("v"), F.col("k")).alias("m")
    )
    cells = pooled.select("vec_id", "n_tokens", F.posexplode(F.arrays_zip("a", "m")).alias("position", "z"))
    return rounded(
        cells.select("vec_id", "n_tokens", "position", F.col("z.a").alias("first"), F.col("z.m").alias("mean")), "first", "mean"
    )


# Bits of a document: the first 32 bits of each token's MD5, in 2,048 places.
BITS_SQL = rf"""d AS (SELECT doc_id, {TOKENS} AS w, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
    b AS (SELECT DISTINCT doc_id, known, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 2048 AS bit FROM (SELECT doc_id, known, unnest(w) AS tok FROM d)),
    n AS (SELECT doc_id, known, count(*) AS n FROM b GROUP BY 1, 2),
    o AS (SELECT x.doc_id, y.doc_id AS other, count(*) AS shared FROM b x JOIN b y ON x.bit = y.bit AND NOT x.known AND y.known GROUP BY 1, 2),
    s AS (SELECT o.doc_id, other, shared / (a.n + c.n - shared) AS sim FROM o JOIN n a ON a.doc_id = o.doc_id JOIN n c ON c.doc_id = o.other),
    m AS (SELECT doc_id, max(sim) AS sim, arg_min(other, (-sim, other)) AS nearest FROM s GROUP BY 1),
    r AS (SELECT d.doc_id, CAST(coalesce(n.n, 0) AS INTEGER) AS n_bits, coalesce(sim, 0) AS sim, nearest
          FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id WHERE NOT d.known)"""


def _nearest(t):
    """The documents without label against those with one, as sets of hashed tokens."""
    rows = t.texts().select("doc_id", f.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    # Written once: both joins below would hash the words of every document.
    rows = kept_columns(rows.select("doc_id", similarity.hashed_bits(F.col("w")).alias("bits")), "bits")
    known = t.labels.select("doc_id").distinct()
    return similarity.max_similarity(rows.join(known, "doc_id", "left_anti"), rows.join(known, "doc_id", "left_semi"), "doc_id", "bits")


@query("f06_max_similarity", f"WITH {BITS_SQL} SELECT doc_id, n_bits, round(sim, 9) AS similarity, nearest FROM r")
def max_similarity(t):
    return rounded(_nearest(t), "similarity", digits=9)


@query("f06_similarity_bands", f"""WITH {BITS_SQL} SELECT CAST(least(9, floor(sim / 0.1 + 1e-9)) AS INTEGER) AS band, count(*) AS n,
    round(avg(sim), 6) AS mean_similarity, round(avg(n_bits), 6) AS mean_value FROM r GROUP BY 1""")
def similarity_bands(t):
    """How many documents lie how far from the labelled ones, and how many bits they have."""
    return rounded(similarity.similarity_bands(_nearest(t), "similarity", "n_bits"), "mean_similarity", "mean_value")
