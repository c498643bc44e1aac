"""Registered queries of the corpus operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattline.llm import bitsliced, chat, exact, langid, licenses, media, mixing, neardup, packing, periodic, quality, topk, toxicity
from wattline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


OWN_CONVERSATION = """
SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'
"""


@query(
    "op2_chat_formatting",
    r"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), counted AS (
      SELECT *, len(regexp_extract_all(role || ' ' || text, '</?s>|\[/?INST\]|<</?SYS>>')) AS marks FROM rows
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length(role) + length(text) + marks + 22)::BIGINT AS formatted_chars,
      sum(marks) > 0 AS escaped, true AS round_trip
    FROM counted GROUP BY conv_id
    """,
)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(spark.sql(OWN_CONVERSATION))))


@query(
    "op9_exact_dedup",
    r"""
    WITH normal AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    )
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
    FROM normal WINDOW same AS (PARTITION BY text_sha256)
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).drop("member")


@query(
    "op4_minhash_near_dedup",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
    ), runs AS (
      SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS run
      FROM words, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0
    ), sizes AS (
      SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id
    ), links AS (
      SELECT a.doc_id AS x, b.doc_id AS y
      FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id
      JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
    ), reach(doc_id, other) AS (
      SELECT doc_id, doc_id FROM documents
      UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
    )
    SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
    FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
    """,
)
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts may be long, and a worker holds a few copies of those it receives at once.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op5_entropy_mixing")
def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


@query("op3_media_jpeg")
def op3_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.stored(table(spark, sf_dir, "documents"))).drop("width", "height")


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.repeated_tail))


@query(
    "op11_norm_sorted_top_k",
    """
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
      SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
    ), ranked AS (
      SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score FROM scored
    )
    SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op11_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled("embedding").alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query(
    "op12_bit_sliced_search",
    r"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
    ), size AS (
      SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS total FROM docs
    ), tf AS (
      SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM docs) GROUP BY ALL
    ), df AS (
      SELECT term, count(*) AS df FROM tf GROUP BY term
    ), items AS (
      SELECT i, item_id, term, count(*) AS copies FROM (
        SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
    ), scored AS (
      SELECT i, item_id, r, doc_id, sum(copies * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
        * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))))::BIGINT AS score
      FROM items JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL
    ), ranked AS (
      SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
      FROM scored WHERE score > 0
    )
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
)
def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
