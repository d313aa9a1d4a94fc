"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, centroids, conversations, exact_dedup, hmm, packing, paragraphs, quality, secrets, sharding, simhash, token_counts, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.bounded_ring_shards(_documents(spark, sf_dir))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(_documents(spark, sf_dir))


def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_documents(spark, sf_dir)).drop("mark")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex(found["fp"]).alias("fingerprint"), "component_id")


def op11_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op12_repair_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damage_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_threshold_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _centroid_sql(clusters: int = 40, rounds: int = 5) -> str:
    """The rounds one after the other: a_i has every vector's nearest centroid of c_i, c_(i+1) their means."""

    def assign(i: int) -> str:
        apart = "CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        return f"""a{i} AS MATERIALIZED (
            SELECT r, vec_id, e, cluster, distance FROM (SELECT v.r, v.vec_id, v.e, c.cluster, {apart} AS distance FROM v CROSS JOIN c{i} c)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"""

    def move(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (
                SELECT cluster, list(s // n - CAST(s % n < 0 AS INTEGER) ORDER BY d) AS e FROM (
                    SELECT cluster, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM a{i}) GROUP BY cluster, d
                ) GROUP BY cluster
            ) m USING (cluster))"""

    steps = [x for i in range(rounds) for x in (assign(i), move(i))] + [assign(rounds)]
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS cluster, e FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v) ORDER BY h NULLS LAST, e LIMIT {clusters}
        ), {", ".join(steps)}
        SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c USING (cluster)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_maxscore, op2_bounded_ring, op3_line_rules, op4_token_counts, op5_byte_bpe, op6_best_fit_packing, op7_hmm_scores, op8_paragraph_minhash, op9_secret_scan,
        op10_simhash_pivots, op11_heavy_hitters, op12_repair_parse,
        op13_threshold_centroids,
    )
}

SQL: dict[str, str] = {
    "op1_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op3_line_rules": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
        t AS (SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
        c AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM t),
        k AS (
            SELECT r, count(*) AS n_words, count(*) FILTER (WHERE covered) AS n_repeat_words FROM (
                SELECT r, twice OR coalesce(lag(twice) OVER p, false) OR coalesce(lag(twice, 2) OVER p, false) AS covered FROM c WINDOW p AS (PARTITION BY r ORDER BY i)
            ) GROUP BY r
        ), l AS (SELECT r, line, length(line) AS n, length(line) - length(replace(line, ' ', '')) AS spaces FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
        b AS (
            SELECT r, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS solid,
                   (n - length(translate(line, '{quality.MARKS}', ''))) * 100 >= n * {quality.MARK_PERCENT}
                   OR (n >= {quality.CAPITALS_LENGTH} AND regexp_matches(line, '[A-ZÀ-ÖØ-Þ]') AND NOT regexp_matches(line, '[a-zß-öø-ÿ]'))
                   OR (spaces >= {quality.UNPUNCTUATED_WORDS - 1} AND NOT regexp_matches(line, '[.,;:!?。，！？؟।]'))
                   OR (spaces < {quality.BOILERPLATE_WORDS} AND regexp_matches(line, '{quality.BOILERPLATE}')) AS bad
            FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        ), m AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(solid) FILTER (WHERE bad), 0) AS lost FROM b GROUP BY r),
        s AS (
            SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
            FROM d LEFT JOIN k USING (r) LEFT JOIN m USING (r)
        ), v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost * 100 <= word_chars * {quality.LOST_PERCENT} AS kept FROM v
    """,
    "op11_heavy_hitters": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r)
    """,
    "op13_threshold_centroids": _centroid_sql(),
}
