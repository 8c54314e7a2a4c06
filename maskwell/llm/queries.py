"""The queries opN_<name> with production parameters, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .byte_bpe import round_trip_digests
from .chat_format import chat_digests
from .exact_dedup import exact_dedup
from .fingerprints import document_fingerprints
from .language_id import identify_languages
from .licenses import license_scan
from .mixing import mix_documents
from .pii import pii_scan
from .secrets import secret_scan
from .simhash import simhash_groups


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.table(spark, f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


#: The planted conversation -1, which holds the template's own control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat_digests(turns.unionByName(planted))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op6_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_fingerprints": op4_fingerprints,
    "op5_secret_scan": op5_secret_scan,
    "op6_pii_scan": op6_pii_scan,
    "op7_mixing": op7_mixing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_license_scan": op10_license_scan,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
            sha256(coalesce(text, '')) AS text_sha256, min(doc_id) OVER g <= (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // 2 FROM documents) AS in_history
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op3_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|NEXT\])')) AS chars,
                length(role) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\]|NEXT\])')) AS role_chars
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars + CASE WHEN opens THEN role_chars + 20 ELSE 6 END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op7_mixing": r"""
        WITH RECURSIVE
        d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, min(size) FILTER (size > 0) AS least, list(size::DOUBLE) FILTER (size > 0) AS sizes,
                [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM d GROUP BY source),
        -- Sources by how soon they reach their cap; the first that the level leaves below it sets the level.
        w AS (
            SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
            FROM s WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT *, least(2.0::DOUBLE * source_size, weight * coalesce((SELECT max(x.level) FROM w x WHERE x.weight * x.level < 2 * x.source_size), 1e300)) AS target, source_size / n AS mean FROM w),
        -- Bisection for the multiplier.
        b AS (
            SELECT 0 AS step, source, sizes, mean, target, least(-1e-3, 1.001 * ln(target / source_size) * mean / least) AS low, 1.001 * ln(2) * mean / least AS high
            FROM t WHERE source_size > 0 AND target < 2 * source_size
            UNION ALL
            SELECT step + 1, source, sizes, mean, target, CASE WHEN reached < target THEN middle ELSE low END, CASE WHEN reached < target THEN high ELSE middle END
            FROM (SELECT *, (low + high) / 2 AS middle, list_sum(list_transform(sizes, lambda x: x * least(2, exp((low + high) / 2 * x / mean)))) AS reached FROM b WHERE step < 100)),
        m AS (SELECT source, round((low + high) / 2, 9) AS multiplier FROM b WHERE step = 100),
        p AS (
            SELECT d.*, t.source_size, t.target, ('0x' || substr(md5(doc_id || ':' || size || ':0'), 1, 15))::BIGINT AS mixed,
                CASE WHEN size = 0 THEN 0 ELSE floor(least(2, coalesce(exp(multiplier * size / mean), 2)) * 1048576 + 0.5)::BIGINT END AS units, ceil(t.n / 256)::BIGINT AS cells
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source),
        q AS (SELECT *, mixed % cells AS cell, row_number() OVER (PARTITION BY source, mixed % cells ORDER BY size DESC, mixed, doc_id) AS place FROM p),
        r AS (
            SELECT source, cell, 0::BIGINT AS place, NULL::BIGINT AS doc_id, 0::BIGINT AS copies, 0::BIGINT AS owed FROM q GROUP BY source, cell
            UNION ALL
            SELECT source, cell, place, doc_id, copies, due - copies * size * 1048576 FROM (
                SELECT q.*, r.owed + units * size AS due, CASE WHEN size = 0 THEN 0 ELSE least(2, greatest(0, (r.owed + units * size + size * 524288) // (greatest(size, 1) * 1048576))) END::BIGINT AS copies
                FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source AND r.cell = q.cell AND q.place = r.place + 1))
        SELECT q.doc_id, q.size, q.source_size, q.target, r.copies * q.size AS taken, r.copies
        FROM q JOIN r ON q.source IS NOT DISTINCT FROM r.source AND q.cell = r.cell AND q.place = r.place""",
}
