"""Removal of repeated multi-line chunks, with chunk borders that the lines themselves choose.

A rolling hash over the hashes of two neighbouring lines decides whether a chunk ends after the second:
it does if the hash's first hexadecimal digit is one of ``ENDS``, for a quarter of all lines. Lines put in or
left out before a passage so move the borders near them and no others, and a passage that several
documents hold falls into the same chunks in all of them. Of the chunks with at least two lines that
hold more than spaces, those that occur more than once keep their first occurrence (least id, then least
place); the others go after their bytes were compared with the first one's.

Only DataFrame functions are used. Chunks are grouped by 128 bits of hash, counted with partial sums, so a
chunk that a third of all documents hold is one row for each task; texts of chunks move only for the
comparison, and only those of repeated ones.

Defined results: a null text counts as empty; an empty text stays empty; rows with equal id and text are
one document, cut alike; a document all of whose chunks go has an empty text; other columns pass unchanged, whatever
their names, but those that the result adds (``n_lines``, ``n_removed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, written

ENDS = ("0", "4", "8", "c")


def chunked(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Adds ``out_col``: the chunks of a text, each an array of lines.

    Every step is a column that a later step reads more than once, so the optimizer keeps the steps apart
    and the work stays in proportion to the lines.
    """
    n = F.size("_lines")
    steps = docs.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    steps = steps.withColumn("_hashes", F.transform("_lines", lambda x: F.md5(x.cast("binary"))))
    before = F.slice(F.concat(F.array(F.lit("")), F.col("_hashes")), 1, n)
    ends = F.zip_with(before, "_hashes", lambda a, b: F.substring(F.md5(F.concat(a, b).cast("binary")), 1, 1).isin(*ENDS))
    steps = steps.withColumn("_ends", ends)
    opens = F.concat(F.array(F.lit(True)), F.slice("_ends", 1, n - 1))
    steps = steps.withColumn("_starts", F.array_compact(F.zip_with(F.sequence(F.lit(0), n - 1), opens, lambda i, first: F.when(first, i))))
    stops = F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(n))
    spans = F.zip_with("_starts", stops, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    steps = steps.withColumn("_spans", spans)
    chunks = F.transform("_spans", lambda p: F.slice("_lines", p["a"] + 1, p["b"] - p["a"]))
    steps = steps.withColumn(out_col, F.when((n > 0) & (F.size("_spans") > 0), chunks))
    return steps.drop("_lines", "_hashes", "_ends", "_starts", "_spans")


def _candidate(chunk: Column) -> Column:
    return F.size(F.filter(chunk, lambda x: F.trim(x) != "")) >= 2


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks removed from ``text_col``, and the columns ``n_lines`` and ``n_removed`` (lines)."""
    key = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    pieces = chunked(key, "_text", "_chunks").select("_id", "_th", F.posexplode("_chunks").alias("_k", "_chunk")).where(_candidate(F.col("_chunk")))
    text = F.array_join("_chunk", "\n")
    hashed = pieces.select("_id", "_th", "_k", F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"))
    hashed, hashed_path = written(hashed, "chunks")
    groups = hashed.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_th", "_k")).alias("_first")).where("_n > 1").drop("_n")
    is_first = F.struct("_id", "_th", "_k").eqNullSafe(F.col("_first"))
    asked, asked_path = written(hashed.join(groups.hint("merge"), ["_h1", "_h2"]).select("_id", "_th", "_k", "_h1", "_h2", is_first.alias("_is_first")), "repeated")

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._th") == F.col(f"{b}._th"))

    wanted = asked.groupBy("_id", "_th").agg(F.collect_set(F.struct("_k", "_h1", "_h2", "_is_first")).alias("_wanted"))  # chunks of one text
    held = key.alias("d").join(wanted.alias("w").hint("merge"), same("d", "w")).select("d._id", "d._th", "_text", "_wanted")
    held = chunked(held, "_text", "_chunks").select("_id", "_th", F.explode(F.transform("_wanted", lambda w: F.struct(w.alias("w"), F.array_join(F.get("_chunks", w["_k"]), "\n").alias("t")))).alias("c"))
    held = held.select("_id", "_th", "c.w.*", "c.t")
    firsts = held.where("_is_first").groupBy("_h1", "_h2").agg(F.first("t").alias("_t"))
    gone = held.where("NOT _is_first").join(firsts.hint("merge"), ["_h1", "_h2"]).where("t = _t").select("_id", "_th", "_k")
    gone, _ = written(gone.groupBy("_id", "_th").agg(F.collect_set("_k").alias("_gone")), "gone")
    drop_written(docs.sparkSession, hashed_path, asked_path)

    rows = docs.drop("n_lines", "n_removed")
    # a row's text travels once, inside the row
    keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    own_text = F.col("_row").getField(text_col).alias("_text")
    done = keyed.alias("d").join(gone.alias("g").hint("merge"), same("d", "g"), "left").select("_row", own_text, "_gone")
    cut = chunked(done.where("_gone IS NOT NULL"), "_text", "_chunks")
    kept = F.filter("_chunks", lambda c, i: ~F.array_contains("_gone", i))
    cut = cut.select("_row", "_text", F.array_join(F.flatten(kept), "\n").alias("_new"), F.size(F.flatten("_chunks")).alias("_n"), F.size(F.flatten(kept)).alias("_left"))
    cut = cut.select("_row", "_new", F.col("_n").cast("long").alias("n_lines"), (F.col("_n") - F.col("_left")).cast("long").alias("n_removed"))
    whole = F.coalesce("_text", F.lit(""))
    lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    left = done.where("_gone IS NULL").select("_row", whole.alias("_new"), lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    out = left.union(cut)
    return out.select(*((F.col("_new") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in rows.columns), "n_lines", "n_removed")


def windowed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_lines``, ``_places`` of those with more than spaces, and ``_windows``: texts from each of those to the next one."""
    steps = docs.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    steps = steps.withColumn("_places", F.array_compact(F.transform("_lines", lambda x, i: F.when(F.trim(x) != "", i))))
    pairs = F.zip_with(F.slice("_places", 1, F.greatest(F.size("_places") - 1, F.lit(0))), F.slice("_places", 2, F.size("_places")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    steps = steps.withColumn("_pairs", pairs)
    return steps.withColumn("_windows", F.transform("_pairs", lambda p: F.array_join(F.slice("_lines", p["a"] + 1, p["b"] - p["a"] + 1), "\n"))).drop("_pairs")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as of ``dedup_lines``, but without any passage of two lines or more that occurs before, however short.

    Every line that holds more than spaces makes a window with the next such line, and the blank ones between
    them. A window that occurs more than once keeps its first occurrence (least id, then least place), whole;
    all other lines of its later ones go. No border has to fall right, so no passage is missed.
    """
    key = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    hashes = F.transform("_windows", lambda t: F.struct(F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit(1), t).alias("_h2")))
    hashed = windowed(key, "_text").select("_id", "_th", F.posexplode(hashes).alias("_k", "_h")).select("_id", "_th", "_k", "_h.*")
    hashed, hashed_path = written(hashed, "windows")
    groups = hashed.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_th", "_k")).alias("_first")).where("_n > 1").drop("_n")
    is_first = F.struct("_id", "_th", "_k").eqNullSafe(F.col("_first"))
    asked, asked_path = written(hashed.join(groups.hint("merge"), ["_h1", "_h2"]).select("_id", "_th", "_k", "_h1", "_h2", is_first.alias("_is_first")), "repeated")

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._th") == F.col(f"{b}._th"))

    wanted = asked.groupBy("_id", "_th").agg(F.collect_set(F.struct("_k", "_h1", "_h2", "_is_first")).alias("_wanted"))
    held = key.alias("d").join(wanted.alias("w").hint("merge"), same("d", "w")).select("d._id", "d._th", "_text", "_wanted")
    held = windowed(held, "_text").select("_id", "_th", F.explode(F.transform("_wanted", lambda w: F.struct(w.alias("w"), F.get("_windows", w["_k"]).alias("t")))).alias("c"))
    held = held.select("_id", "_th", "c.w.*", "c.t")
    firsts = held.where("_is_first").groupBy("_h1", "_h2").agg(F.first("t").alias("_t"))
    known = held.where("NOT _is_first").join(firsts.hint("merge"), ["_h1", "_h2"]).where("t = _t").select("_id", "_th", "_k", "_is_first")
    known = known.union(asked.where("_is_first").select("_id", "_th", "_k", "_is_first"))
    sets = (F.collect_set(F.when(F.col("_is_first") == first, F.col("_k"))).alias(name) for first, name in ((False, "_gone"), (True, "_stay")))
    gone, _ = written(known.groupBy("_id", "_th").agg(*sets).where(F.size("_gone") > 0), "gone")
    drop_written(docs.sparkSession, hashed_path, asked_path)

    rows = docs.drop("n_lines", "n_removed")
    # a row's text travels once, inside the row
    keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    own_text = F.col("_row").getField(text_col).alias("_text")
    done = keyed.alias("d").join(gone.alias("g").hint("merge"), same("d", "g"), "left").select("_row", own_text, "_gone", "_stay")
    cut = windowed(done.where("_gone IS NOT NULL"), "_text")

    def lines_of(windows: str) -> Column:
        return F.flatten(F.transform(windows, lambda k: F.sequence(F.get("_places", k), F.get("_places", k + 1))))

    cut = cut.withColumn("_kept", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.array_except(lines_of("_gone"), lines_of("_stay"))))
    text = F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n")
    cut = cut.select("_row", text.alias("_new"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"))
    whole = F.coalesce("_text", F.lit(""))
    lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    left = done.where("_gone IS NULL").select("_row", whole.alias("_new"), lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    out = left.union(cut)
    return out.select(*((F.col("_new") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in rows.columns), "n_lines", "n_removed")


#: DuckDB SQL of (doc_id, text, n_lines, n_removed) for a table; line feeds are chr(10).
ORACLE_SQL = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {table}
), e AS (
    SELECT *, substr(md5(lag(md5(line), 1, '') OVER w || md5(line)), 1, 1) IN ('0', '4', '8', 'c') AS ends FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), k AS (
    SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e
), c AS (
    SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS lines, count(*) FILTER (trim(line, ' ') <> '') AS shown FROM k GROUP BY doc_id, k
), r AS (
    SELECT *, shown >= 2 AND row_number() OVER (PARTITION BY chunk, shown >= 2 ORDER BY doc_id, k) > 1 AS gone FROM c
)
SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text,
    CAST(sum(lines) AS BIGINT) AS n_lines, CAST(coalesce(sum(lines) FILTER (gone), 0) AS BIGINT) AS n_removed
FROM r GROUP BY doc_id
"""
