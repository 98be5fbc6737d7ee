"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm.ann import nearest_vectors
from wayfarer.llm.common import table
from wayfarer.llm.divergence import source_divergence
from wayfarer.llm.html_text import main_text
from wayfarer.llm.licenses import license_scan
from wayfarer.llm.near_text import near_text
from wayfarer.llm.near_vectors import near_vectors
from wayfarer.llm.packing import pack
from wayfarer.llm.pieces import sampled_pieces_digest
from wayfarer.llm.quality import quality
from wayfarer.llm.substring import repeated_spans
from wayfarer.llm.token_files import token_files
from wayfarer.llm.toxicity import toxicity
from wayfarer.llm.whitening import whitened


def vocabulary(name: str) -> str:
    """A public tokenizer's file, in the place where it is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text(table(spark, sf_dir, "documents"))


def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_token_files,
        op3_sampled_pieces,
        op4_minhash_near_dedup,
        op5_html_main_text,
        op6_quality_classifier,
        op7_approximate_neighbours,
        op8_toxicity,
        op9_substring_dedup,
        op10_best_fit_packing,
        op11_source_divergence,
        op12_license_scan,
        op13_embedding_whitening,
    )
}

_WORDS = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        sides AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b
            ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (
            SELECT vec_id, vec_id AS seen FROM embeddings
            UNION
            SELECT r.vec_id, s.v FROM reach r JOIN sides s ON s.u = r.seen),
        n AS (SELECT u, count(*) AS k FROM sides GROUP BY u)
        SELECT r.vec_id, coalesce(any_value(n.k), 0)::BIGINT AS n_links, min(seen) AS component_id, min(seen) = r.vec_id AS kept
        FROM reach r LEFT JOIN n ON n.u = r.vec_id GROUP BY r.vec_id""",
    "op4_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
            FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
            WHERE 100 * c >= 75 * (x.k + y.k - c)),
        sides AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
        reach AS (
            SELECT doc_id, doc_id AS seen FROM documents
            UNION
            SELECT r.doc_id, l.v FROM reach r JOIN sides l ON l.u = r.seen)
        SELECT d.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, min(r.seen) AS component_id, min(r.seen) = d.doc_id AS kept
        FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id)
        GROUP BY d.doc_id, n.k""",
    "op9_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS t
            FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w)),
        least AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
        gone AS (
            SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p
            FROM win JOIN least USING (t) WHERE m < doc_id),
        marked AS (
            SELECT x.doc_id, x.p, x.word, g.p IS NOT NULL AS g
            FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w) x
            LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p)
        SELECT d.doc_id, count(m.p)::BIGINT AS n_words, count(m.p) FILTER (m.g)::BIGINT AS n_removed,
            sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.p) FILTER (NOT m.g), '')) AS kept_sha256
        FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id""",
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        w AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        l AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (
            SELECT g.lang, g.source, l.term, coalesce(x.n, 0) AS n, l.n AS lang_n
            FROM g JOIN l USING (lang)
            LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = l.term),
        t AS (
            SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total,
                count(*) OVER (PARTITION BY lang, source) AS v
            FROM c),
        p AS (
            SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS p,
                1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS q
            FROM t),
        s AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
