"""The queries of this subpackage: each applies one operator to its whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, jaccard_join, line_dedup, packing, pii, quality, secret_scan, sentencepiece_codec, substring_dedup, topk_search
from ._shared import table, with_text

#: Key of the pseudonyms where the caller gives none; production passes its own secret.
DEMO_KEY = b"tallyloom-demonstration-key"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the files are no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, as pieces with the checksum of their ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words of repeated windows of 35 words, as a digest."""
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the prefix table, decoded again, as digests."""
    model = vocabulary("piece_bpe_32k.model")
    docs = with_text(table(spark, sf_dir, "documents"))
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model).drop("text"), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: the fixed patterns and dense strings."""
    found = secret_scan.scan(with_text(table(spark, sf_dir, "documents")))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "entropy")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of links of every text; the least id of a group is kept."""
    found = jaccard_join.near_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "copy_of", "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every vector whose id is divisible by 20."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), k=20)


_TOPK_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s
)
SELECT query_id, CAST(rk AS INTEGER) AS "rank", vec_id, score FROM r WHERE rk <= 20
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms for personal data, and what was replaced."""
    done = pii.pseudonymise(with_text(table(spark, sf_dir, "documents")), DEMO_KEY)
    spans = F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join(spans, ",").alias("spans"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its repeated chunks of lines, as a digest."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_LINES_SQL = f"SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256 FROM ({line_dedup.ORACLE_SQL.format(table='documents')})"


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from the labels that aren't held out."""
    docs = with_text(table(spark, sf_dir, "documents"))
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


_SUBSTRINGS_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), k AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), g AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY win) AS c FROM k) WHERE c > 1
), x AS (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w
), r AS (
    SELECT x.doc_id, count(*) AS n, count(g.j) AS gone, string_agg(word, ' ' ORDER BY x.j) FILTER (g.j IS NULL) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.j = x.j GROUP BY x.doc_id
)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
"""

#: Links by comparing all documents that share an n-gram, groups by following links.
_JACCARD_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
    SELECT doc_id, ws, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS grams FROM d
), g AS (
    SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM s
), l AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.5 * (min(a.n) + min(b.n) - count(*))
), r(id, reached) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached
), c AS (
    SELECT id, min(reached) AS class_id FROM r GROUP BY id
)
SELECT s.doc_id, CASE WHEN len(ws) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) END AS copy_of,
    c.class_id, coalesce(k.n_links, 0) AS n_links, s.doc_id = c.class_id AS kept
FROM s JOIN c ON c.id = s.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = s.doc_id
"""

_EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
), r(id, reached) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached
), c AS (
    SELECT id, min(reached) AS component_id FROM r GROUP BY id
)
SELECT c.id AS vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, c.id = c.component_id AS kept
FROM c LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = c.id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_substrings": op2_substrings,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_secrets": op4_secrets,
        "op5_jaccard": op5_jaccard,
        "op6_embeddings": op6_embeddings,
        "op7_topk": op7_topk,
        "op8_pii": op8_pii,
        "op9_lines": op9_lines,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substrings": _SUBSTRINGS_SQL, "op5_jaccard": _JACCARD_SQL, "op6_embeddings": _EMBEDDINGS_SQL, "op7_topk": _TOPK_SQL, "op9_lines": _LINES_SQL}
