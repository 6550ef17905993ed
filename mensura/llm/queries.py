"""The registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .chat import chat_digests
from .common import table
from .divergence import source_divergence
from .htmltext import extract_main_text
from .jaccard import similarity_classes
from .linededup import LineIndex
from .media import media_columns, store_media
from .mixing import mix_documents
from .packing import BYTE_BPE_ADDED, pack
from .quality import quality_scores
from .toxicity import toxicity_scores
from .urlfilter import judge_urls
from .versions import version_fingerprints
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return wrap


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_classes(table(spark, folder, "documents"))


@query("op10_best_two_fit_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    # The ranks of byte_bpe_50k are the vocabulary of byte_bpe_50k.json; tests hold both against each other.
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), added=BYTE_BPE_ADDED)


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

URL_SQL = r"""
WITH rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                     ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, row_number() OVER () AS k,
        coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
f AS (SELECT k, arg_max(h || p, (length(h || p), length(h))) AS rule, arg_max(verdict, (length(h || p), length(h))) AS verdict
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (k)
"""


@query("op6_bloom_cascade_url_filter", URL_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES)


@query("op8_tar_shard_media_columns")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    out = media_columns(store_media(table(spark, folder, "documents")))
    return out.withColumnRenamed("row", "doc_id")


@query("op4_iblt_version_fingerprints")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return version_fingerprints(table(spark, folder, "documents"))


@query("op5_site_style_tree_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


@query("op9_quadratic_discriminant_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_random_field_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_mix_sources_to_weights")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mix_documents(table(spark, folder, "documents"))


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '[', '\q') AS body,
        CASE role WHEN 'user' THEN '[INST] ' WHEN 'system' THEN '<<SYS>> ' WHEN 'assistant' THEN '<s> '
             ELSE '<|' || replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '[', '\q'), '|', '\p') || '|> ' END AS head,
        CASE role WHEN 'user' THEN ' [/INST]' WHEN 'system' THEN ' <</SYS>>' WHEN 'assistant' THEN ' </s>' ELSE ' <|end|>' END AS tail
      FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head || body || tail)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op3_reply_tree_chat_format", CHAT_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(conversations.union(extra)).drop("formatted")


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT lang, source, k, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source, v, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)
      LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (total + 5)) // (l.n + 5 * v)::HUGEINT AS q
      FROM g JOIN kept USING (lang) JOIN l USING (lang, v) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


@query("op12_count_level_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))


@query("op13_lanczos_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT k, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
n AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM n WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT n.*, top IS NOT NULL AND top <> doc_id AS gone FROM n LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY k, doc_id
"""


@query("op11_cuckoo_line_dedup", LINES_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    index = LineIndex(spark, scratch_path(spark, "lines"))
    index.insert(documents)
    out = index.clean(documents)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
