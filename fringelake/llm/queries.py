"""One query per operator, with production settings over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, compression, exact_dedup, langid, line_dedup, lm, mixing, pii, simhash, toxicity, turns, whitening
from .shared import remainder, table


def vocabulary() -> str:
    """Path of the word-level BPE vocabulary: FRINGELAKE_BPE, or the file of the installed package."""
    if path := os.environ.get("FRINGELAKE_BPE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 4) == 2)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), least_words=1).select("doc_id", "text", "n_lines", "n_dropped")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_ann, op3_exact_dedup, op4_toxicity, op5_bpe, op6_language_id, op7_line_dedup, op8_pii, op9_class_lm, op10_mixing, op11_compression, op12_whitening, op13_turns, pipeline)}

ORACLES = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, count(*)::BIGINT AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
        r AS (SELECT *, cap::DOUBLE / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
        l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM r),
        v AS (SELECT *, min_by(here, ratio) FILTER (here <= ratio) OVER () AS level FROM l),
        t AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio < level THEN cap::DOUBLE ELSE level * weight END AS target FROM v),
        c AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) AS upto
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        f AS (SELECT doc_id, size, source, key, e, (upto + source_size * e)::DOUBLE / target AS finish FROM c, range(2) x(e) WHERE size > 0 AND target > 0),
        o AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NOT NULL, source, key, doc_id, e ROWS UNBOUNDED PRECEDING) AS run FROM f),
        k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM o WHERE run <= (SELECT sum(target) FROM t) GROUP BY 1)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN k USING (doc_id)""",
    # states and costs of the edits as tables, one step of the recursion a row, the best kept by a window
    "op13_turns": r"""
        WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
        named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        hashed AS (SELECT *, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT),
            lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) % 20 AS kind FROM named, crc),
        after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hashed, range(2) r(x) WHERE kind <> 0 AND (kind = 3 OR x = 0)),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM after),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth) AS n FROM seen),
        judged AS (SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before,
            CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
        counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS rows,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1),
        puts(f, m, put, put_cost, added) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']),
            (3, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']), (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:'])),
        edits(m, g, edit, edit_cost, fits, role_set) AS (VALUES (0, 0, 'D', 2, NULL, NULL), (1, 1, 'D', 2, NULL, NULL), (2, 2, 'D', 2, NULL, NULL), (3, 3, 'D', 2, NULL, NULL),
            (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (3, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL),
            (0, 2, 'R', 1, NULL, 'user'), (1, 2, 'R', 1, NULL, 'user'), (3, 2, 'R', 1, NULL, 'user'), (2, 3, 'R', 1, NULL, 'assistant')),
        walk AS (SELECT conv_id, 0 AS n, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counted
            UNION ALL
            SELECT * FROM (SELECT w.conv_id, w.n + 1 AS n, g AS state, cost + put_cost + edit_cost + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost, audit || put || edit AS audit,
                CASE WHEN edit = 'D' THEN lines || added ELSE lines || added || [coalesce(role_set, role) || ':' || text] END AS lines
            FROM walk w JOIN judged j ON j.n = w.n + 1 AND j.conv_id IS NOT DISTINCT FROM w.conv_id JOIN puts ON f = w.state JOIN edits e ON e.m = puts.m
            WHERE (edit = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (fits IS NULL OR fits = initial))
            QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
        ends AS (SELECT w.conv_id, cost + put_cost AS cost, audit || put AS audit, lines || added AS lines FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.n = c.rows
            JOIN puts ON f = w.state WHERE m IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + put_cost, w.audit || put) = 1)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
