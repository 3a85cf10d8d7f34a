"""The queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, flac, langid, minhash, mixing, pii, quality, secrets, vectors, warc
from .common import table


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(flac.store(table(spark, sf_dir, "documents")))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_rows(table(spark, sf_dir, "documents"))


def op4_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op8_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op9_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


_COMPONENTS = "reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"

#: Where SQL can say it in time; the other operators are tested against brute force, exact round trips or held-out accuracy.
SQL = {
    "op1_cross_polytope": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
        links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v AS p JOIN v AS q ON p.label = q.label AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.e, q.e) >= 0.93), {_COMPONENTS}
        SELECT x.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(x.vec_id, coalesce(low.b, x.vec_id)) AS component_id, x.vec_id <= coalesce(low.b, x.vec_id) AS kept
        FROM embeddings AS x LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) AS c ON c.a = x.vec_id LEFT JOIN low ON low.a = x.vec_id""",
    "op9_indexed_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM q""",
    "op10_odd_sketch_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s AS p JOIN s AS q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), {_COMPONENTS}
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(low.b, d.doc_id) AS kept
        FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id""",
}


def _secrets_sql() -> str:
    """The secret scan as SQL: positions from running lengths of the pieces between matches."""
    text = "coalesce(text, '')"
    q = lambda t: t.replace("'", "''")
    runs = "|".join(re.escape(c) * 6 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    fake = secrets.PLACEHOLDER.replace(r"(.)\1{5}", runs)
    parts = []
    for kind, pattern, group, least in (*secrets.BASE, secrets.GENERIC):
        parts.append(f"""
            SELECT doc_id, source, lang, {secrets.RANKS[kind]} AS k, '{kind}' AS kind, v, (sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS a, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS z, length(v) >= {least} AS ok
            FROM (SELECT doc_id, source, lang, unnest(regexp_extract_all({text}, '{q(pattern)}')) AS m, unnest(regexp_extract_all({text}, '{q(pattern)}', {group})) AS v, unnest(string_split_regex({text}, '{q(pattern)}')) AS p, unnest(generate_series(1, greatest(1, len(string_split_regex({text}, '{q(pattern)}'))))) AS i FROM documents) WHERE m IS NOT NULL""")
    return f"""
        WITH found AS ({" UNION ALL ".join(parts)}), base AS (SELECT * FROM found WHERE ok AND k < 3),
        extra AS (SELECT g.* FROM found AS g WHERE ok AND k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[G-Zg-z]') AND NOT EXISTS (SELECT 1 FROM base AS b WHERE b.doc_id = g.doc_id AND b.a < g.z AND g.a < b.z)),
        every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
        held AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT source || chr(0) || lang) AS repos FROM every GROUP BY v),
        judged AS (SELECT e.*, owners < {secrets.OWNERS} AND repos < {secrets.REPOS} AND NOT regexp_matches(e.v, '{q(fake)}') AS live FROM every AS e JOIN held AS h ON h.v = e.v),
        docs AS (SELECT doc_id, sum(CASE WHEN kind = 'assign' THEN 1 ELSE 0 END) AS n_assign, sum(CASE WHEN kind = 'access' THEN 1 ELSE 0 END) AS n_access, sum(CASE WHEN kind = 'hex' THEN 1 ELSE 0 END) AS n_hex,
            string_agg(CASE WHEN k < 3 THEN kind || ':' || a || ':' || z END, ',' ORDER BY a, k) AS b, string_agg(CASE WHEN k < 3 OR live THEN kind || ':' || a || ':' || z END, ',' ORDER BY a, k) AS s, sum(CASE WHEN live THEN 1 ELSE 0 END) AS n_live, sum(CASE WHEN live THEN 0 ELSE 1 END) AS n_example FROM judged GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
        FROM documents AS d LEFT JOIN docs AS x ON x.doc_id = d.doc_id"""


SQL["op3_secret_ownership"] = _secrets_sql()


def oracle_sql() -> dict[str, str]:
    return SQL
