"""The library's queries on the driver's tables, each with DuckDB SQL of its own making where SQL can say it."""

from __future__ import annotations

import sqlite3
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records as R
from ..functions import tokens as K
from ..functions import vectors as V
from ..operators import centroids as C
from ..operators import contrastive, evaluate, sampling
from ..operators import lookup as L
from ..operators.encoders import HashedNgrams, NeuralBundle, random_bundle
from ..sources import tables as S
from .extractor import CentroidModel, Extractor, NeuralModel, encode_whole, fit, fit_vectors
from .predict import predict

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- SQL building blocks ------------------------------------------------------------------------------------

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_A, _B, _C, _D = (chr(0xE000 + k) for k in range(4))


def _sql_merged(text: str) -> str:
    """Spaced letters merged without look-around: runs of letters are put in marks, those of lone letters in other marks."""
    runs = f"regexp_replace({text}, '([A-Za-z]+)', '{_A}\\1{_B}', 'g')"
    lone = f"regexp_replace({runs}, '{_A}([A-Za-z]){_B}', '{_C}\\1{_D}', 'g')"
    joined = f"regexp_replace({lone}, '{_D}[{_WS}]+{_C}', '', 'g')"
    return f"regexp_replace({joined}, '[{_A}{_B}{_C}{_D}]', '', 'g')"


def _sql_tokens(text: str, limit: int | None = K.MAX_TOKENS) -> str:
    """A list of struct (token, type)."""
    dots = f"regexp_replace(lower({_sql_merged(f'coalesce({text}, chr(32)[1:0])')}), '\\.([{_WS}]|$)', '\\1', 'g')"
    raw = f"regexp_extract_all({dots}, '[a-z](?:\\.[a-z])+\\.?|[a-z]+|\\p{{Nd}}+|[{_WS}]+|\\.|[^{_WS}\\p{{L}}\\p{{N}}_.]')"
    if limit is not None:
        raw = f"({raw})[1:{limit}]"
    return f"""list_transform({raw}, lambda r: CASE
        WHEN regexp_matches(r, '^[a-z]') THEN {{'token': replace(r, '.', ''), 'type': 0}}
        WHEN regexp_matches(r, '^\\p{{Nd}}') THEN {{'token': coalesce(nullif(ltrim(r, '0'), ''), '0'), 'type': 1}}
        WHEN regexp_matches(r, '^[{_WS}]') THEN {{'token': ' ', 'type': 2}}
        ELSE {{'token': r, 'type': 3}} END)"""


_CHARS = K.CHARACTERS.replace("'", "''")
_MARKS = K.MARKS.replace("'", "''")
_SPECIAL = f"CASE WHEN regexp_matches(t.token, '^(0|[1-9][0-9]{{0,3}})$') AND try_cast(t.token AS INTEGER) <= 1000 THEN try_cast(t.token AS INTEGER) + 14 WHEN length(t.token) = 1 THEN instr('{_MARKS}', t.token) + 1 ELSE 1 END"
_UNIT = "list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12))"
_HASH = "(({0} * 7919 + 104729) % 1000003)"


def _sql_centroids(source: str, cls: str = "label", vector: str = "embedding") -> str:
    """(class, n, centroid) of a table."""
    return f"""SELECT class, n, {_UNIT} AS centroid FROM (SELECT class, max(n) AS n, list(x ORDER BY i) AS v FROM (
        SELECT class, i, avg(x) AS x, count(*) AS n FROM (SELECT {cls} AS class, unnest(CAST({vector} AS DOUBLE[])) AS x, generate_subscripts({vector}, 1) AS i FROM {source}) GROUP BY class, i) GROUP BY class)"""


# -- tokens -------------------------------------------------------------------------------------------------


def tokens_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.explode_tokens(_table(spark, sf_dir, "documents"), "text", "doc_id").withColumn("type", F.col("type").cast("int"))


def token_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = K.explode_tokens(_table(spark, sf_dir, "pages"), "html", max_tokens=None)
    return every.groupBy(F.col("type").cast("int").alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("token").cast("long")).alias("n_chars"))


def spaced_letter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", K.merge_spaced_letters("text").alias("merged"))
    return docs.where("merged <> text").select("doc_id", "merged")


def acronym_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made into dotted acronyms come back as one token."""
    dotted = F.concat(F.array_join(F.slice(F.split(F.regexp_replace("p_name", "[^a-z]", ""), ""), 1, 4), "."), F.lit(". local "), F.col("p_partkey").cast("string"))
    parts = _table(spark, sf_dir, "part").select("p_partkey", dotted.alias("name"))
    return parts.select("p_partkey", "name", F.array_join(F.transform(K.tokens("name"), lambda t: t["token"]), "|").alias("tokens"))


def number_tokens_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.explode_tokens(_table(spark, sf_dir, "customer"), "c_name", "c_custkey").where("is_number").select("c_custkey", "pos", "token")


def token_char_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = K.explode_tokens(_table(spark, sf_dir, "part"), "p_brand", "p_partkey")
    return every.select("p_partkey", "pos", F.array_join(K.char_ids("token"), ",").alias("ids"))


def token_special_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(K.special_ids(K.tokens("s_name")), ",").alias("ids"))


def padded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _table(spark, sf_dir, "supplier").select("s_suppkey", K.padded(K.tokens("s_name"), 8).alias("t"))
    return full.select("s_suppkey", F.array_join(K.special_ids("t"), ",").alias("ids"), F.array_join(K.token_mask("t"), ",").alias("mask"))


def designation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer")
    number = F.when(F.col("c_custkey") % 5 == 0, "").otherwise((F.col("c_custkey") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)).cast("string"))
    return rows.select("c_custkey", K.designation_label(K.tokens("c_name"), number).cast("int").alias("place"))


def designation_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer")
    return rows.select("c_custkey", K.designation_decode(K.tokens("c_name"), (F.col("c_custkey") % 6).cast("int")).alias("designation"))


def last_number_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest number of a page's address wins, the earlier one among equals, if it has two digits or more."""
    rows = _table(spark, sf_dir, "pages").select("page_id", K.tokens("html").alias("t"))
    place = K.pointer("t", lambda t, i: F.length(t["token"]), null_score=1.0)
    return rows.select("page_id", place.cast("int").alias("place"), K.designation_decode("t", place).alias("designation"))


def neural_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks, numbers and the first token's ids, as the neural stages get them."""
    full = _table(spark, sf_dir, "customer").select("c_custkey", K.padded(K.tokens("c_name")).alias("t"))
    ones = F.aggregate(K.token_mask("t"), F.lit(0), lambda s, x: s + x)
    return full.select("c_custkey", ones.alias("n_tokens"), F.size("t").alias("width"), F.array_join(K.char_ids(F.get("t", F.lit(0))["token"]), ",").alias("first_ids"))


# -- vectors ------------------------------------------------------------------------------------------------


def _rounded(v: str) -> Column:
    return F.transform(v, lambda x: F.round(x, 6) + F.lit(0.0))


def class_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.mean_vectors(_table(spark, sf_dir, "embeddings"), "label", "embedding")
    return found.select(F.col("class").alias("label"), "n", F.posexplode(_rounded("centroid")).alias("i", "x"))


def empty_class_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    classes = spark.range(12).select(F.col("id").cast("int").alias("label"))
    found = C.mean_vectors(vectors, "label", "embedding", classes, dim=64)
    return found.select(F.col("class").alias("label"), "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


def one_class_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.mean_vector(_table(spark, sf_dir, "embeddings").where("label = 0"), "embedding")
    return found.select("n", F.posexplode(_rounded("centroid")).alias("i", "x"))


def one_class_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    centroid = C.mean_vector(vectors.where("label = 0"), "embedding").head()["centroid"]
    scored = C.score_against(vectors, "embedding", centroid)
    return scored.select("vec_id", F.round("score", 6).alias("score"), C.gate("score", 0.2).alias("is_union"))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = C.nearest_centroid(vectors.select("vec_id", "embedding"), "vec_id", "embedding", C.mean_vectors(vectors, "label", "embedding"))
    return found.select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


def _nearest_at(threshold: float) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = _table(spark, sf_dir, "embeddings")
        found = C.nearest_centroid(vectors.select("vec_id", "embedding"), "vec_id", "embedding", C.mean_vectors(vectors, "label", "embedding"), threshold)
        return found.select("vec_id", "accepted", F.col("accepted").isNull().alias("unrecognized"), F.coalesce("accepted", F.lit(0)).alias("context"), F.round("similarity", 6).alias("similarity"))

    return query


_NEAREST_SQL = f"""SELECT vec_id, class AS nearest, round(s, 6) AS similarity FROM (
    SELECT e.vec_id, c.class, list_inner_product(CAST(e.embedding AS DOUBLE[]), c.centroid) AS s FROM embeddings e CROSS JOIN ({_sql_centroids('embeddings')}) c)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class) = 1"""


def _nearest_sql(threshold: float) -> str:
    return f"""SELECT vec_id, CASE WHEN s >= {threshold} THEN class END AS accepted, s < {threshold} AS unrecognized, CASE WHEN s >= {threshold} THEN class ELSE 0 END AS context, round(s, 6) AS similarity FROM (
        SELECT e.vec_id, c.class, list_inner_product(CAST(e.embedding AS DOUBLE[]), c.centroid) AS s FROM embeddings e CROSS JOIN ({_sql_centroids('embeddings')}) c)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class) = 1"""


def all_pairs_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs inside batches of 64 consecutive vectors."""
    rows = _table(spark, sf_dir, "embeddings").withColumn("b", F.floor(F.col("vec_id") / 64))
    return contrastive.pair_similarities(rows, "vec_id", "embedding", "b").select(F.col("batch").cast("long").alias("batch"), "a", "b", F.round("similarity", 6).alias("similarity"))


def contrastive_loss_supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("b", F.floor(F.col("vec_id") / 64))
    return contrastive.supervised_contrastive_loss(rows, "vec_id", "embedding", "label", "b").select(F.round("loss", 6).alias("loss"))


def contrastive_loss_one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("b", F.floor(F.col("vec_id") / 64)).withColumn("y", (F.col("label") < 5).cast("int"))
    return contrastive.one_class_contrastive_loss(rows, "vec_id", "embedding", "y", "b").select(F.round("loss", 6).alias("loss"))


def _loss_sql(positive: str) -> str:
    return f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {positive} AS pos, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / 0.1 AS z
        FROM embeddings a JOIN embeddings b ON a.vec_id // 64 = b.vec_id // 64),
    m AS (SELECT *, z - max(z) OVER (PARTITION BY a) AS y FROM p),
    r AS (SELECT a, sum(exp(y)) AS den, sum(CASE WHEN pos THEN y ELSE 0 END) AS zp, count(*) FILTER (pos) AS np FROM m WHERE a <> b GROUP BY a)
    SELECT round(coalesce(avg(-(zp - np * ln(den + 1e-8)) / (np + 1e-8)), 0), 6) AS loss FROM r WHERE np > 0"""


def token_attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over token lengths, pads left out, as weights of a mean of places."""
    rows = K.explode_tokens(_table(spark, sf_dir, "documents"), "text", "doc_id").withColumn("z", F.length("token").cast("double"))
    top = rows.groupBy("doc_id").agg(F.max("z").alias("top"))
    pooled = rows.join(top, "doc_id").withColumn("w", F.exp(F.col("z") - F.col("top"))).groupBy("doc_id")
    return pooled.agg((F.sum(F.col("w") * F.col("pos")) / F.sum("w")).alias("p")).select("doc_id", F.round("p", 6).alias("pooled"))


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", HashedNgrams()(K.tokens("s_name")).alias("v"))
    return rows.select("s_suppkey", F.posexplode("v").alias("i", "x")).where("x > 0").select("s_suppkey", "i", F.round("x", 6).alias("x"))


def _sql_vector(toks: str) -> str:
    """Hashed n-grams of a token list as a list of 64 counts; words and numbers alone."""
    grams = f"""flatten(list_transform(list_filter({toks}, lambda t: t.type <= 1), lambda t: list_concat(list_concat(
        list_transform(range(1, length(t.token) + 1), lambda i: (unicode(t.token[i:i]) * 961 + 7) % 64),
        list_transform(range(1, length(t.token)), lambda i: (unicode(t.token[i:i]) * 961 + unicode(t.token[i + 1:i + 1]) * 31 + 14) % 64)),
        list_transform(range(1, length(t.token) - 1), lambda i: (unicode(t.token[i:i]) * 961 + unicode(t.token[i + 1:i + 1]) * 31 + unicode(t.token[i + 2:i + 2]) + 21) % 64))))"""
    return grams


# -- lookups ------------------------------------------------------------------------------------------------


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_returnflag").alias("aff_abbr"), F.col("l_suppkey").cast("string").alias("desig_num"), F.col("l_partkey").alias("f_num"))


_LOOKUP = "SELECT l_returnflag AS aff, CAST(l_suppkey AS VARCHAR) AS desig, list_sort(list(DISTINCT l_partkey)) AS fnums FROM lineitem WHERE l_returnflag <> '' GROUP BY ALL"


def lookup_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.build_lookup(_registry(spark, sf_dir)).select("aff", "desig", F.array_join("fnums", ",").alias("fnums"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("c_custkey") % 4 == 0, "A").when(F.col("c_custkey") % 4 == 1, "R").when(F.col("c_custkey") % 4 == 2, "X").otherwise("")
    return _table(spark, sf_dir, "customer").select("c_custkey", flag.alias("affiliation"), (F.col("c_custkey") % 150).cast("string").alias("designation"))


_ASKED = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'R' WHEN 2 THEN 'X' ELSE '' END AS affiliation, CAST(c_custkey % 150 AS VARCHAR) AS designation FROM customer"


def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.lookup(_asked(spark, sf_dir), L.build_lookup(_registry(spark, sf_dir)))
    return found.select("c_custkey", "affiliation", "designation", F.size("fnums").cast("long").alias("n"), F.coalesce(F.array_max("fnums"), F.lit(-1)).alias("largest"))


def lookup_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = L.lookup(_asked(spark, sf_dir), L.build_lookup(_registry(spark, sf_dir))).withColumn("fnums", F.slice("fnums", 1, 1 + F.col("c_custkey").cast("int") % 3))
    return short.select("c_custkey", R.format_list("fnums").alias("pred_fnum"), R.format_multiple("fnums").alias("pred_fnum_multiple"))


def distinct_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").where("o_orderstatus <> '' AND o_orderpriority IS NOT NULL")
    return rows.select("o_orderstatus", "o_orderpriority").distinct().orderBy("o_orderstatus", "o_orderpriority")


# -- sampling -----------------------------------------------------------------------------------------------


def class_filter_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sampling.keep_frequent(docs, "source", 45, drop=["src0"]).groupBy("source").agg(F.count("*").alias("n"))


def distinct_class_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.agg(F.countDistinct("source").alias("n_classes"), F.count_if(F.col("lang").isNull()).alias("n_null"), F.count("lang").alias("n_known"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(_table(spark, sf_dir, "documents"), "lang", "doc_id", 0.05, exclude=["fr"]).select("doc_id", "lang", "split")


def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_rows(_table(spark, sf_dir, "orders"), "o_orderkey", 500).select("o_orderkey")


def split_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the training split by semi-join, and rows of the test split, counted by class."""
    docs = _table(spark, sf_dir, "documents")
    split = sampling.stratified_split(docs, "lang", "doc_id", 0.2)
    train = docs.join(split.where("split = 'train'").select("doc_id"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n_train"))
    test = split.where("split = 'test'").groupBy("lang").agg(F.count("*").alias("n_test"))
    return train.join(test, "lang")


def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batches(_table(spark, sf_dir, "embeddings"), "vec_id", 64).groupBy("batch").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def not_in_keeps_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("segment"))
    return rows.where(R.not_in("segment", ["BUILDING", "MACHINERY"]))


def union_all_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("text", F.lit(1).alias("label"))
    both = docs.unionByName(_table(spark, sf_dir, "benchmark").select("text", F.lit(0).alias("label")))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("n_chars"))


# -- evaluation ---------------------------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as labelled names: the truth from the key, predictions that are wrong in known places."""
    rows = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return rows.select(
        F.col("c_name").alias("text"),
        F.col("c_mktsegment").alias("true_aff"),
        F.when(k % 9 == 0, F.lit(None)).otherwise(F.concat(F.lpad(k.cast("string"), 6, "0"), F.lit(".0"))).alias("true_desig"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "NONE").otherwise(F.col("c_mktsegment")).alias("pred_aff"),
        F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("pred_desig"),
    )


_PREDICTIONS = """SELECT *, regexp_replace(split_part(coalesce(true_desig, ''), '.', 1), '^0+', '') AS td, regexp_replace(pred_desig, '^0+', '') AS pd,
        coalesce(pred_aff = true_aff, false) AS am, regexp_replace(split_part(coalesce(true_desig, ''), '.', 1), '^0+', '') = regexp_replace(pred_desig, '^0+', '') AS dm FROM (
    SELECT c_name AS text, c_mktsegment AS true_aff, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.0' END AS true_desig,
        CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'NONE' ELSE c_mktsegment END AS pred_aff,
        CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS pred_desig FROM customer) WHERE true_aff IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')"""
_KNOWN = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.metrics(evaluate.judged(_predictions(spark, sf_dir), _KNOWN))
    return found.select(*(F.round(c, 6).alias(c) if c in evaluate.RATIOS else F.col(c) for c in found.columns))


def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors(evaluate.judged(_predictions(spark, sf_dir), _KNOWN))


def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_breakdown(evaluate.judged(_predictions(spark, sf_dir), _KNOWN))


def _judged_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(_table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive"))


_LENGTHS = "SELECT CAST(n_chars AS DOUBLE) AS score, quality = 1 AS positive FROM documents JOIN labels USING (doc_id)"
_CURVE = f"""SELECT score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an, p, n FROM (
    SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM ({_LENGTHS}) GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.roc_curve(_judged_lengths(spark, sf_dir), "score", "positive")
    return found.select("threshold", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(_judged_lengths(spark, sf_dir), "score", "positive").select(F.round("auc", 6).alias("auc"))


def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.youden_threshold(_judged_lengths(spark, sf_dir), "score", "positive").select("threshold", F.round("j", 6).alias("j"))


# -- the plan -----------------------------------------------------------------------------------------------

_UNION_AT, _AFFILIATION_AT = 0.93, 0.95


def _fitted(spark: SparkSession, sf_dir: str) -> CentroidModel:
    """Languages stand in for affiliations, and French for the unknown class."""
    docs = _table(spark, sf_dir, "documents")
    return fit(docs.select("text", F.when(F.col("lang") == "fr", "UNK").otherwise(F.upper("lang")).alias("aff_abbr")))


def extract_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan on all documents, scores rounded for comparison."""
    extractor = Extractor(_fitted(spark, sf_dir), _UNION_AT, _AFFILIATION_AT)
    out = extractor.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "is_union", F.round("union_score", 6).alias("union_score"), "affiliation", "affiliation_unrecognized", "designation", F.round("aff_score", 6).alias("aff_score"))


_PIPELINE_SQL = f"""
WITH t AS (SELECT doc_id, CASE lang WHEN 'fr' THEN 'UNK' ELSE upper(lang) END AS aff, {_sql_tokens('text')} AS toks FROM documents),
g AS (SELECT doc_id, aff, toks, {_sql_vector('toks')} AS grams FROM t),
c AS (SELECT doc_id, dim, count(*) AS n FROM (SELECT doc_id, unnest(grams) AS dim FROM g) GROUP BY ALL),
v AS (SELECT doc_id, list(x ORDER BY dim) AS v FROM (SELECT d.doc_id, r.dim, CAST(coalesce(c.n, 0) AS DOUBLE) / sqrt(d.q) AS x FROM (SELECT doc_id, sum(CAST(n AS DOUBLE) * n) AS q FROM c GROUP BY doc_id) d CROSS JOIN (SELECT unnest(range(64)) AS dim) r LEFT JOIN c ON c.doc_id = d.doc_id AND c.dim = r.dim) GROUP BY doc_id),
k AS (SELECT v.doc_id, g.aff, v.v FROM v JOIN g USING (doc_id)),
u AS ({_sql_centroids("k WHERE aff <> 'UNK'", "1", "v")}),
f AS (SELECT * FROM ({_sql_centroids("k WHERE aff NOT IN ('UNK', 'UNAFF', 'MULTI')", "aff", "v")}) WHERE n >= 5),
s AS (SELECT k.doc_id, list_inner_product(k.v, u.centroid) AS us FROM k CROSS JOIN u),
b AS (SELECT k.doc_id, f.class, list_inner_product(k.v, f.centroid) AS fs FROM k CROSS JOIN f QUALIFY row_number() OVER (PARTITION BY k.doc_id ORDER BY list_inner_product(k.v, f.centroid) DESC, f.class) = 1)
SELECT g.doc_id, coalesce(us >= {_UNION_AT}, false) AS is_union, coalesce(round(us, 6), 'nan'::DOUBLE) AS union_score,
    CASE WHEN us >= {_UNION_AT} AND fs >= {_AFFILIATION_AT} THEN class END AS affiliation,
    coalesce(us >= {_UNION_AT} AND fs < {_AFFILIATION_AT}, false) AS affiliation_unrecognized,
    CASE WHEN us >= {_UNION_AT} THEN coalesce(list_filter(toks, lambda x: x.type = 1)[-1].token, '') END AS designation,
    CASE WHEN us >= {_UNION_AT} THEN round(fs, 6) END AS aff_score
FROM g LEFT JOIN s USING (doc_id) LEFT JOIN b USING (doc_id)
"""


def predict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's columns for suppliers; numbers come from the lookup of line items."""
    names = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    model = fit(names.select(F.col("s_name").alias("text"), F.when(F.col("s_suppkey") % 3 == 0, "A").when(F.col("s_suppkey") % 3 == 1, "N").otherwise("R").alias("aff_abbr")), least=1)
    return predict(names, Extractor(model), L.build_lookup(_registry(spark, sf_dir)), "s_name")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with quotes, commas, line feeds and empty cells, written and read again."""
    odd = F.concat(F.lit('say "'), F.col("s_name"), F.lit('", twice\nor \\n, '), F.when(F.col("s_suppkey") % 2 == 0, F.lit("")).otherwise(F.lit("x")))
    rows = _table(spark, sf_dir, "supplier").select(F.monotonically_increasing_id().alias(S.ROW), F.col("s_suppkey").cast("string").alias("id"), odd.alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("y").alias("extra"))
    path = S.work_dir(spark, "csv")
    S.write_csv(rows, path)
    return S.read_csv(spark, path).select("id", "name", "extra")


_CSV_SQL = """SELECT CAST(s_suppkey AS VARCHAR) AS id, 'say "' || s_name || '", twice' || chr(10) || 'or \\n, ' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'x' END AS name,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'y' END AS extra FROM supplier"""


def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan as a stream over the documents' files, to its end; equal to the batch result."""
    from ..streaming.extract import extract_stream, read_table_stream

    extractor = Extractor(_fitted(spark, sf_dir), _UNION_AT, _AFFILIATION_AT)
    work = S.work_dir(spark, "stream")
    schema = _table(spark, sf_dir, "documents").schema
    path = f"{sf_dir}/documents.parquet"
    extract_stream(read_table_stream(spark, path, schema).select("doc_id", "text"), extractor, "text", f"{work}/out", f"{work}/state", once=True).awaitTermination()
    out = spark.read.parquet(f"{work}/out")
    return out.select("doc_id", "is_union", F.round("union_score", 6).alias("union_score"), "affiliation", "affiliation_unrecognized", "designation", F.round("aff_score", 6).alias("aff_score"))


# -- whole texts --------------------------------------------------------------------------------------------


def document_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents, without the limit that the model's inputs have, counted by type."""
    return K.type_counts(_table(spark, sf_dir, "documents"), "text", "doc_id", max_tokens=None)


def last_number_whole_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``last_number_pointer`` over whole pages."""
    rows = _table(spark, sf_dir, "pages").select("page_id", K.tokens("html", None).alias("t"))
    place = K.pointer("t", lambda t, i: F.length(t["token"]), null_score=1.0)
    return rows.select("page_id", place.cast("int").alias("place"), K.designation_decode("t", place).alias("designation"))


def extract_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extract_pipeline`` fitted on and applied to all tokens of all documents."""
    encoder, path = HashedNgrams(), S.work_dir(spark, "encoded")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "fr", "UNK").otherwise(F.upper("lang")).alias("aff_abbr"))
    # texts are read once, for the fit and for the records
    encode_whole(docs, "text", encoder, "vector", "number").write.parquet(path)
    encoded = spark.read.parquet(path)
    model = fit_vectors(encoded, "aff_abbr", "vector", encoder=encoder)
    out = Extractor(model, _UNION_AT, _AFFILIATION_AT).transform_encoded(encoded, "vector", "number")
    return out.select("doc_id", "is_union", F.round("union_score", 6).alias("union_score"), "affiliation", "affiliation_unrecognized", "designation", F.round("aff_score", 6).alias("aff_score"))


# -- files --------------------------------------------------------------------------------------------------


def lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as lines of a file, blank ones too, counted when read again."""
    path = S.work_dir(spark, "lines")
    _table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit(' "'), F.col("s_name"), F.lit(", x"))).alias("value")).write.text(path)
    return S.read_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def registry_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry in a SQLite file of the driver, where such a file lies, read as the lookup's source."""
    rows = _table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).otherwise("").alias("a"), F.when(F.col("s_suppkey") % 7 > 0, (F.col("s_suppkey") % 9).cast("string")).alias("d"), (F.col("s_suppkey") % 13).alias("f"))
    with tempfile.TemporaryDirectory(prefix="tallyloom-") as folder:
        path = f"{folder}/registry.db"
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE lm_data (aff_abbr TEXT, desig_num TEXT, f_num INTEGER)")
            db.executemany("INSERT INTO lm_data VALUES (?, ?, ?)", map(tuple, rows.toLocalIterator()))
        db.close()
        return S.read_registry_sqlite(spark, path)


def labelled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows from a CSV file: numbers stay text, with their zeros and without a float's end."""
    path = S.work_dir(spark, "labelled")
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("text"), F.col("s_nationkey").cast("string").alias("aff_abbr"), F.concat(F.lit("00"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".0").otherwise("")).alias("desig_num"))
    S.write_csv(rows, path, single_file=False)
    return S.read_labelled(spark, path)


def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits written to their folders, the test split read again."""
    path = S.work_dir(spark, "split")
    S.write_split(sampling.stratified_split(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.2), path)
    return S.read_split(spark, path, "test").select("doc_id", "lang", "split")


def error_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error report as a CSV file, counted when read again; empty cells are nulls to the reader."""
    path = S.work_dir(spark, "errors")
    S.write_errors(evaluate.errors(evaluate.judged(_predictions(spark, sf_dir), _KNOWN)), path)
    return spark.read.csv(path, header=True, quote='"', escape='"').groupBy("true_aff", "aff_match", "desig_match").agg(F.count("*").alias("n"), F.count("pred_aff").alias("n_said"))


def lookup_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup written as JSON lines and read again."""
    path = S.work_dir(spark, "lookup")
    S.write_lookup(L.build_lookup(_registry(spark, sf_dir)), path, "json")
    return S.read_lookup(spark, path, "json").select("aff", "desig", F.size("fnums").cast("long").alias("n"), F.array_max("fnums").alias("largest"))


def mini_batches_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 vectors exactly; those that don't fill the last one are dropped."""
    return sampling.full_batches(_table(spark, sf_dir, "embeddings"), "vec_id", 64).groupBy("batch").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def neural_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neural stages with random weights on supplier names: shapes and gates, no meaning."""
    arrays = random_bundle(3, affiliations=3, hidden=16)
    unit = [1.0 if i == 0 else 0.0 for i in range(64)]
    other = [[1.0 if i == k else 0.0 for i in range(64)] for k in range(3)]
    model = NeuralModel(NeuralBundle("", arrays=arrays), unit, ["A", "B", "C"], other)
    return Extractor(model, union_threshold=-1.0, affiliation_threshold=0.0).transform(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name").drop("union_score", "aff_score")


def queries() -> dict[str, Query]:
    named = [
        tokens_exploded, token_type_counts, spaced_letter_merge, acronym_collapse, number_tokens_normalised, token_char_ids, token_special_ids, padded_tokens, designation_label, designation_decode,
        last_number_pointer, neural_inputs, class_centroids, empty_class_centroid, one_class_centroid, one_class_gate, nearest_centroid, all_pairs_similarity, contrastive_loss_supervised, contrastive_loss_one_class,
        token_attention_pool, hashed_vectors, lookup_build, lookup_join, lookup_format, distinct_filter_sort, class_filter_min_count, distinct_class_count, stratified_split, deterministic_sample,
        split_training_rows, mini_batches, not_in_keeps_null, union_all_concat, eval_metrics, eval_errors, error_breakdown, roc_curve, roc_auc, youden_threshold, extract_pipeline, predict_rows, csv_roundtrip, stream_extract, neural_pointer,
        document_token_counts, last_number_whole_page, extract_whole_texts, lines_roundtrip, registry_sqlite, labelled_csv, split_files, error_file, lookup_file, mini_batches_full,
    ]
    return {f.__name__: f for f in named} | {"nearest_centroid_at_0_8": _nearest_at(0.8), "nearest_centroid_at_0_2": _nearest_at(0.2)}


def _whole(sql: str) -> str:
    """The plan's SQL over all tokens of a text."""
    limited = f")[1:{K.MAX_TOKENS}]"
    if limited not in sql:
        raise ValueError("no limit to take away")
    return sql.replace(limited, ")")


def _predict_sql() -> str:
    """The plan's SQL on supplier names and the command line's columns over it."""
    names = "SELECT s_suppkey AS doc_id, s_name AS text, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'n' ELSE 'r' END AS lang FROM supplier"
    plan = _PIPELINE_SQL.replace("WITH t AS", f"WITH documents AS ({names}), t AS", 1).replace(f">= {_UNION_AT}", ">= 0.5").replace(f">= {_AFFILIATION_AT}", ">= 0.8").replace(f"< {_AFFILIATION_AT}", "< 0.8").replace("n >= 5", "n >= 1").replace("round(us, 6)", "us")
    listed = "CASE coalesce(len(fnums), 0) WHEN 0 THEN '' WHEN 1 THEN CAST(fnums[1] AS VARCHAR) ELSE '[' || array_to_string(fnums, ', ') || ']' END"
    several = "CASE coalesce(len(fnums), 0) WHEN 0 THEN '' WHEN 1 THEN 'False' ELSE 'True' END"
    return f"""SELECT s.s_suppkey, s.s_name, CASE WHEN is_union THEN 'True' ELSE 'False' END AS pred_is_union, coalesce(affiliation, '') AS pred_aff,
        CASE WHEN affiliation_unrecognized THEN 'True' ELSE 'False' END AS pred_unknown, coalesce(designation, '') AS pred_desig,
        CASE WHEN isnan(union_score) THEN 'nan' ELSE printf('%.4f', union_score) END AS pred_union_score, {listed} AS pred_fnum, {several} AS pred_fnum_multiple
        FROM ({plan}) p JOIN supplier s ON s.s_suppkey = p.doc_id LEFT JOIN ({_LOOKUP}) l ON l.aff = nullif(affiliation, '') AND l.desig = nullif(designation, '')"""


def _exploded(table: str, key: str, text: str, limit: int | None = K.MAX_TOKENS) -> str:
    return f"SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, t.token AS token, t.type AS type FROM (SELECT {key}, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM (SELECT {key}, {_sql_tokens(text, limit)} AS toks FROM {table}))"


def _char_ids(token: str) -> str:
    return f"array_to_string(list_concat(list_transform(range(1, least(length({token}), 20) + 1), lambda i: instr('{_CHARS}', lower({token})[i:i]) + 1), list_transform(range(greatest(20 - length({token}), 0)), lambda i: 0)), ',')"


def oracle_sql() -> dict[str, str]:
    supplier = f"SELECT s_suppkey, {_sql_tokens('s_name')} AS toks FROM supplier"
    specials = f"list_transform(toks, lambda t: CASE WHEN t.type = 0 THEN 0 ELSE ({_SPECIAL}) END)"
    customers = f"SELECT c_custkey, {_sql_tokens('c_name')} AS toks FROM customer"
    h, hd = _HASH.format("o_orderkey"), _HASH.format("doc_id")

    def split(fraction: float, exclude: str) -> str:
        return f"""SELECT doc_id, lang, CASE WHEN lang IN ({exclude}) THEN 'exclude' WHEN n >= 2 AND r <= floor(n * {fraction} + 0.5) THEN 'test' ELSE 'train' END AS split FROM (
            SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY {hd}, doc_id) AS r FROM documents)"""

    counters = "count(*) AS total, count(*) FILTER (am) AS aff_correct, count(*) FILTER (pred_aff IS NOT NULL) AS aff_non_none_total, count(*) FILTER (pred_aff IS NOT NULL AND am) AS aff_non_none_correct, count(*) FILTER (dm) AS desig_correct, count(*) FILTER (td <> '') AS has_desig_total, count(*) FILTER (td <> '' AND dm) AS desig_correct_given_has, count(*) FILTER (td = '') AS no_desig_total, count(*) FILTER (td = '' AND dm) AS desig_correct_given_none, count(*) FILTER (am AND dm) AS joint_correct, count(*) FILTER (pred_aff IS NOT NULL AND am AND dm) AS joint_non_none_correct"
    ratios = ", ".join(f"round(CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0.0 END, 6) AS {name}" for name, (n, d) in evaluate.RATIOS.items())
    toks = f"SELECT page_id, {_sql_tokens('html')} AS toks FROM pages"
    numbers = f"SELECT page_id, t.token AS token, i FROM (SELECT page_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM ({toks})) WHERE t.type = 1 AND length(t.token) > 1"
    return {
        "tokens_exploded": f"SELECT doc_id, pos, token, type, type = 1 AS is_number FROM ({_exploded('documents', 'doc_id', 'text')})",
        "token_type_counts": f"SELECT type, count(*) AS n, CAST(sum(length(token)) AS BIGINT) AS n_chars FROM ({_exploded('pages', 'page_id', 'html', None)}) GROUP BY type",
        "spaced_letter_merge": f"SELECT doc_id, merged FROM (SELECT doc_id, text, {_sql_merged('text')} AS merged FROM documents) WHERE merged <> text",
        "acronym_collapse": f"SELECT p_partkey, name, array_to_string(list_transform({_sql_tokens('name')}, lambda t: t.token), '|') AS tokens FROM (SELECT p_partkey, array_to_string(string_split(regexp_replace(p_name, '[^a-z]', '', 'g')[1:4], ''), '.') || '. local ' || p_partkey AS name FROM part)",
        "number_tokens_normalised": f"SELECT c_custkey, pos, token FROM ({_exploded('customer', 'c_custkey', 'c_name')}) WHERE type = 1",
        "token_char_ids": f"SELECT p_partkey, pos, {_char_ids('token')} AS ids FROM ({_exploded('part', 'p_partkey', 'p_brand')})",
        "token_special_ids": f"SELECT s_suppkey, array_to_string({specials}, ',') AS ids FROM ({supplier})",
        "padded_tokens": f"SELECT s_suppkey, array_to_string(list_concat({specials}, list_transform(range(8 - len(toks)), lambda i: 1)), ',') AS ids, array_to_string(list_concat(list_transform(toks, lambda t: 1), list_transform(range(8 - len(toks)), lambda i: 0)), ',') AS mask FROM ({supplier})",
        "designation_label": f"SELECT c_custkey, CAST(coalesce(list_max(list_transform(toks, lambda t, i: CASE WHEN number <> '' AND t.token = number THEN i ELSE 0 END)), 0) AS INTEGER) AS place FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN CAST(c_custkey + 1 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS number FROM ({customers}))",
        "designation_decode": f"SELECT c_custkey, CASE WHEN c_custkey % 6 > 0 AND toks[c_custkey % 6].type = 1 THEN toks[c_custkey % 6].token ELSE '' END AS designation FROM ({customers})",
        "last_number_pointer": f"SELECT p.page_id, CAST(coalesce(n.i, 0) AS INTEGER) AS place, coalesce(n.token, '') AS designation FROM pages p LEFT JOIN (SELECT * FROM ({numbers}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(token) DESC, i) = 1) n USING (page_id)",
        "neural_inputs": f"SELECT c_custkey, CAST(len(toks) AS INTEGER) AS n_tokens, 70 AS width, {_char_ids('toks[1].token')} AS first_ids FROM ({customers})",
        "class_centroids": f"SELECT class AS label, n, CAST(i - 1 AS INTEGER) AS i, round(x, 6) + 0.0 AS x FROM (SELECT class, n, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM ({_sql_centroids('embeddings')}))",
        "empty_class_centroid": f"SELECT CAST(r.l AS INTEGER) AS label, coalesce(n, 0) AS n, round(coalesce(list_inner_product(centroid, centroid), 0.0), 6) AS squared FROM (SELECT unnest(range(12)) AS l) r LEFT JOIN ({_sql_centroids('embeddings')}) c ON c.class = r.l",
        "one_class_centroid": f"SELECT n, CAST(i - 1 AS INTEGER) AS i, round(x, 6) + 0.0 AS x FROM (SELECT n, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM ({_sql_centroids('embeddings WHERE label = 0')}))",
        "one_class_gate": f"SELECT vec_id, round(s, 6) AS score, s >= 0.2 AS is_union FROM (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), centroid) AS s FROM embeddings CROSS JOIN ({_sql_centroids('embeddings WHERE label = 0')}))",
        "nearest_centroid": _NEAREST_SQL,
        "nearest_centroid_at_0_8": _nearest_sql(0.8),
        "nearest_centroid_at_0_2": _nearest_sql(0.2),
        "all_pairs_similarity": "SELECT a.vec_id // 64 AS batch, a.vec_id AS a, b.vec_id AS b, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id // 64 = b.vec_id // 64 AND a.vec_id <> b.vec_id",
        "contrastive_loss_supervised": _loss_sql("a.label = b.label"),
        "contrastive_loss_one_class": _loss_sql("a.label < 5 AND b.label < 5"),
        "token_attention_pool": f"SELECT doc_id, round(sum(w * pos) / sum(w), 6) AS pooled FROM (SELECT doc_id, pos, exp(length(token) - max(length(token)) OVER (PARTITION BY doc_id)) AS w FROM ({_exploded('documents', 'doc_id', 'text')})) GROUP BY doc_id",
        "hashed_vectors": f"SELECT s_suppkey, CAST(dim AS INTEGER) AS i, round(n / sqrt(sum(n * n) OVER (PARTITION BY s_suppkey)), 6) AS x FROM (SELECT s_suppkey, dim, CAST(count(*) AS DOUBLE) AS n FROM (SELECT s_suppkey, unnest({_sql_vector('toks')}) AS dim FROM ({supplier})) GROUP BY ALL)",
        "lookup_build": f"SELECT aff, desig, array_to_string(fnums, ',') AS fnums FROM ({_LOOKUP})",
        "lookup_join": f"SELECT c_custkey, affiliation, designation, coalesce(len(fnums), 0) AS n, coalesce(list_max(fnums), -1) AS largest FROM ({_ASKED}) q LEFT JOIN ({_LOOKUP}) l ON l.aff = nullif(q.affiliation, '') AND l.desig = nullif(q.designation, '')",
        "lookup_format": f"SELECT c_custkey, CASE len(f) WHEN 0 THEN '' WHEN 1 THEN CAST(f[1] AS VARCHAR) ELSE '[' || array_to_string(f, ', ') || ']' END AS pred_fnum, CASE len(f) WHEN 0 THEN '' WHEN 1 THEN 'False' ELSE 'True' END AS pred_fnum_multiple FROM (SELECT c_custkey, coalesce(fnums[1:1 + c_custkey % 3], []) AS f FROM ({_ASKED}) q LEFT JOIN ({_LOOKUP}) l ON l.aff = nullif(q.affiliation, '') AND l.desig = nullif(q.designation, ''))",
        "distinct_filter_sort": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> '' AND o_orderpriority IS NOT NULL ORDER BY 1, 2",
        "class_filter_min_count": "SELECT source, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY source HAVING count(*) >= 45",
        "distinct_class_count": "SELECT count(DISTINCT source) AS n_classes, count(*) FILTER (lang IS NULL) AS n_null, count(lang) AS n_known FROM documents",
        "stratified_split": split(0.05, "'fr'"),
        "deterministic_sample": f"SELECT o_orderkey FROM orders ORDER BY {h}, o_orderkey LIMIT 500",
        "split_training_rows": f"SELECT lang, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM ({split(0.2, 'NULL')}) GROUP BY lang",
        "mini_batches": f"SELECT CAST({_HASH.format('vec_id')} % greatest(1, (SELECT count(*) FROM embeddings) // 64) AS INTEGER) AS batch, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings GROUP BY 1",
        "not_in_keeps_null": "SELECT * FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS segment FROM customer) WHERE coalesce(segment NOT IN ('BUILDING', 'MACHINERY'), true)",
        "union_all_concat": "SELECT label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT text, 1 AS label FROM documents UNION ALL SELECT text, 0 FROM benchmark) GROUP BY label",
        "eval_metrics": f"SELECT *, {ratios} FROM (SELECT {counters} FROM ({_PREDICTIONS}))",
        "eval_errors": f"SELECT text[1:80] AS text, true_aff, pred_aff, am AS aff_match, td AS true_desig, pd AS pred_desig, dm AS desig_match FROM ({_PREDICTIONS}) WHERE NOT (am AND dm)",
        "error_breakdown": f"SELECT count(*) FILTER (NOT am AND dm) AS aff_only, count(*) FILTER (am AND NOT dm) AS desig_only, count(*) FILTER (NOT am AND NOT dm) AS both FROM ({_PREDICTIONS})",
        "roc_curve": f"SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(CAST(tp AS DOUBLE) / ap, 6) AS tpr, round(CAST(fp AS DOUBLE) / an, 6) AS fpr FROM ({_CURVE})",
        "roc_auc": f"SELECT round(CAST(sum((an - fp) * p) AS DOUBLE) / CAST(max(ap) * max(an) AS DOUBLE) + 0.5 * CAST(sum(p * n) AS DOUBLE) / CAST(max(ap) * max(an) AS DOUBLE), 6) AS auc FROM ({_CURVE})",
        "youden_threshold": f"SELECT threshold, round(j, 6) AS j FROM (SELECT threshold, CAST(tp AS DOUBLE) / ap - CAST(fp AS DOUBLE) / an AS j FROM ({_CURVE})) ORDER BY round(j, 12) DESC, threshold DESC LIMIT 1",
        "extract_pipeline": _PIPELINE_SQL,
        "stream_extract": _PIPELINE_SQL,
        "csv_roundtrip": _CSV_SQL,
        "predict_rows": _predict_sql(),
        "document_token_counts": f"SELECT doc_id, type, count(*) AS n, CAST(sum(length(token)) AS BIGINT) AS n_chars, max(pos) AS last, max(token) AS largest FROM ({_exploded('documents', 'doc_id', 'text', None)}) GROUP BY doc_id, type",
        "last_number_whole_page": f"SELECT p.page_id, CAST(coalesce(n.i, 0) AS INTEGER) AS place, coalesce(n.token, '') AS designation FROM pages p LEFT JOIN (SELECT * FROM ({_whole(numbers)}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(token) DESC, i) = 1) n USING (page_id)",
        "extract_whole_texts": _whole(_PIPELINE_SQL),
        "lines_roundtrip": "SELECT CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ' \"' || s_name || ', x' END AS text, count(*) AS n FROM supplier GROUP BY 1",
        "registry_sqlite": "SELECT DISTINCT 'N' || s_nationkey AS aff_abbr, CAST(s_suppkey % 9 AS VARCHAR) AS desig_num, s_suppkey % 13 AS f_num FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0",
        "labelled_csv": "SELECT s_name AS text, CAST(s_nationkey AS VARCHAR) AS aff_abbr, '00' || s_suppkey AS desig_num FROM supplier",
        "split_files": f"SELECT * FROM ({split(0.2, 'NULL')}) WHERE split = 'test'",
        "error_file": f"SELECT true_aff, CASE WHEN am THEN 'true' ELSE 'false' END AS aff_match, CASE WHEN dm THEN 'true' ELSE 'false' END AS desig_match, count(*) AS n, count(pred_aff) AS n_said FROM ({_PREDICTIONS}) WHERE NOT (am AND dm) GROUP BY 1, 2, 3",
        "lookup_file": f"SELECT aff, desig, len(fnums) AS n, list_max(fnums) AS largest FROM ({_LOOKUP})",
        "mini_batches_full": f"SELECT CAST(r // 64 AS BIGINT) AS batch, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM (SELECT vec_id, row_number() OVER (ORDER BY {_HASH.format('vec_id')}, vec_id) - 1 AS r FROM embeddings) WHERE r // 64 < (SELECT count(*) // 64 FROM embeddings) GROUP BY 1",
    }
