"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks of bounded size, and every pair of blocks is scored by one
matrix product. A first pass counts the scores of each query in coarse bins; the counts of all blocks
are added, and the bin that holds the k-th best score is split into finer bins in the next pass, until
bins hold one integer. Then the k-th score is known exactly, and a last pass takes the scores above it
and, of those equal to it, the ones with the smallest ids that are still wanted. A block leaves out bins
that its own k best scores already rule out, so counts stay short; that loses nothing.

Scores are inner products of the integer vectors ``floor(scale * x)``. Blocks travel in 16 bits a component where they fit,
and are multiplied in single or double precision where that is exact, else in integers. Defined results: vectors that are
null or hold null or non-finite components take no part, nor do rows without id; a shorter vector counts as filled with zeros;
every row that asks has the other rows as candidates, those with its id too, so a repeated id has its ranks once for each row; components beyond
1e15 and products beyond 2**61 count as these bounds; without other candidates a query has no rows; an empty table gives none;
only the id and vector columns and those that ``is_query`` names are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_written, written

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
BINS = 16384
_MOST = 2**61
_SLICE = 64


def _pack(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
    """One row for a block: its rows and ids, its integer matrix and the largest length of a vector in it."""
    dim = max(map(len, pdf["v"]), default=0)
    rows = np.zeros((len(pdf), max(dim, 1)))
    for i, v in enumerate(pdf["v"]):
        rows[i, : len(v)] = v
    rows = np.clip(rows, -1e15, 1e15)
    norm = float(np.sqrt((rows**2).sum(axis=1)).max())
    kind = "int16" if np.abs(rows).max() < 2**15 else "int64"
    uids, ids = (pdf[c].to_numpy(np.int64).tobytes() for c in ("uid", "id"))
    return pd.DataFrame({key: [pdf[key].iloc[0]], "uids": [uids], "ids": [ids], "m": [rows.astype(kind).tobytes()], "kind": [kind], "width": [rows.shape[1]], "norm": [norm]})


def _scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Inner products as int64: exact in floating point where they are small, else in integers."""
    if bound < 2**52:
        kind = np.float32 if bound < 2**23 else np.float64
        return np.rint(q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    return np.clip(q.astype(object) @ c.astype(object).T, -_MOST, _MOST).astype(np.int64)


def _slices(r) -> Iterator[tuple[np.ndarray, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, which of the block, candidate ids, scores, mask of a row with itself) in slices of a pair of blocks."""
    q, c = (np.frombuffer(m, kind).reshape(-1, width) for m, kind, width in ((r.q_m, r.q_kind, r.q_width), (r.c_m, r.c_kind, r.c_width)))
    wide = min(q.shape[1], c.shape[1])
    q, c = q[:, :wide], c[:, :wide]
    q_uids, c_uids, c_ids = (np.frombuffer(x, np.int64) for x in (r.q_uids, r.c_uids, r.c_ids))
    for at in range(0, len(q), _SLICE):
        part = slice(at, at + _SLICE)
        yield q_uids[part], part, c_ids, _scores(q[part], c, r.q_norm * r.c_norm), q_uids[part][:, None] == c_uids[None]


def _counts(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                low_all, step_all, span_all, want_all = (np.frombuffer(x, np.int64) for x in (r.low, r.step, r.span, r.want))
                for ids, part, _, scores, own in _slices(r):
                    low, step, want = low_all[part, None], step_all[part, None], want_all[part, None]
                    at = (scores - low) // step
                    at[own | (scores < low) | (scores - low >= span_all[part, None])] = BINS
                    at += np.arange(len(ids))[:, None] * (BINS + 1)
                    n = np.bincount(at.ravel(), minlength=len(ids) * (BINS + 1)).reshape(len(ids), BINS + 1)[:, :BINS]
                    above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
                    i, b = np.nonzero((n > 0) & (above < want))
                    yield pd.DataFrame({"asks": ids[i], "bin": b, "n": n[i, b]})

    return run


def _hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for r in pdf.itertuples():
            least_all, want_all, ids_all = (np.frombuffer(x, np.int64) for x in (r.low, r.want, r.q_ids))
            for asks, part, c_ids, scores, own in _slices(r):
                least = least_all[part, None]
                i, j = np.nonzero((scores > least) & ~own)
                tied_i, tied_j = np.nonzero((scores == least) & ~own)
                order = np.lexsort((c_ids[tied_j], tied_i))
                tied_i, tied_j = tied_i[order], tied_j[order]
                place = np.arange(len(tied_i)) - np.searchsorted(tied_i, tied_i)
                wanted = place < want_all[part][tied_i]
                i, j = np.concatenate([i, tied_i[wanted]]), np.concatenate([j, tied_j[wanted]])
                yield pd.DataFrame({"asks": asks[i], "query_id": ids_all[part][i], "vec_id": c_ids[j], "score": scores[i, j]})


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every row that ``is_query`` picks, ties to smaller ids."""
    spark = vectors.sparkSession
    ok = F.coalesce(F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    v = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    v = F.transform(v, lambda x: F.when(F.abs(x) < 1e15, F.floor(x)).otherwise(x).cast("double"))
    rows = vectors.where(ok & F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("is_query"))
    rows, rows_path = written(rows, "rows")
    total = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, query_blocks = max(1, -(-total.n // CANDIDATE_BLOCK)), max(1, -(-total.q // QUERY_BLOCK))
    packed = "{0} int, uids binary, ids binary, m binary, kind string, width int, norm double"

    def dealt(key: str, into: int):
        return F.pmod(F.xxhash64(key), F.lit(into)).cast("int")

    c, c_path = written(rows.withColumn("cb", dealt("uid", blocks)).select("cb", "uid", "id", "v").groupBy("cb").applyInPandas(lambda p: _pack(p, "cb"), packed.format("cb")), "candidates")
    q, q_path = written(rows.where("is_query").withColumn("qb", dealt("uid", query_blocks)).select("qb", "uid", "id", "v").groupBy("qb").applyInPandas(lambda p: _pack(p, "qb"), packed.format("qb")), "queries")
    drop_written(spark, rows_path)
    most = c.agg(F.max("norm")).first()[0] or 0.0  # one number

    def first_state(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                m = np.frombuffer(r.m, r.kind).reshape(-1, r.width).astype(np.float64)
                bound = np.minimum(np.ceil(np.sqrt((m**2).sum(axis=1)) * most * (1 + 1e-9)) + 1, float(_MOST)).astype(np.int64)
                step = -(-(2 * bound + 1) // BINS)
                yield pd.DataFrame({"asks": np.frombuffer(r.uids, np.int64), "low": -bound, "step": step, "span": step * BINS, "want": k})

    states, s_path = written(q.mapInPandas(first_state, "asks long, low long, step long, span long, want long"), "bins")

    def pairs(states: DataFrame) -> DataFrame:
        """Every pair of a query block, with its queries' bins, and a candidate block."""
        ours = states.withColumn("qb", dealt("asks", query_blocks))

        def pack_state(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            r = one.iloc[0]
            by = two.set_index("asks").loc[np.frombuffer(r["uids"], np.int64)]
            at = {n: [by[n].to_numpy(np.int64).tobytes()] for n in ("low", "step", "span", "want")}
            return pd.DataFrame({"qb": [key[0]], **{f"q_{n}": [r[n]] for n in ("uids", "ids", "m", "kind", "width", "norm")}, **at})

        asking = q.groupBy("qb").cogroup(ours.groupBy("qb")).applyInPandas(
            pack_state, "qb int, q_uids binary, q_ids binary, q_m binary, q_kind string, q_width int, q_norm double, low binary, step binary, span binary, want binary"
        )
        asking = asking.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        given = c.select("cb", *(F.col(n).alias(f"c_{n}") for n in ("uids", "ids", "m", "kind", "width", "norm"))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        # the key is the pair, so the pairs of one block are as many tasks' as of any other
        return given.join(asking.hint("merge"), ["qb", "cb"])

    while True:
        counted = pairs(states).mapInPandas(_counts(k), "asks long, bin long, n long").groupBy("asks", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("asks").orderBy(F.desc("bin"))  # the bins of a query's best scores
        reached = counted.withColumn("upto", F.sum("n").over(down)).join(states, "asks").where("upto >= want AND upto - n < want")
        found = reached.select("asks", (F.col("low") + F.col("bin") * F.col("step")).alias("low"), F.col("step").alias("span1"), (F.col("want") - F.col("upto") + F.col("n")).alias("want"))
        # a query with fewer than k candidates is never reached: it takes them all
        after = states.select("asks", F.col("want").alias("want0")).join(found, "asks", "left")
        span = F.coalesce("span1", F.lit(1)).cast("long")
        after = after.select(
            "asks",
            F.when(F.col("span1").isNull(), F.lit(-2 * _MOST)).otherwise(F.col("low")).alias("low"),
            F.ceil(span / F.lit(BINS)).cast("long").alias("step"),
            span.alias("span"),
            F.coalesce("want", "want0").cast("long").alias("want"),
        )
        after, path = written(after, "bins")
        drop_written(spark, s_path)
        states, s_path = after, path
        if states.where("span > 1").isEmpty():
            break
    hits = pairs(states).mapInPandas(_hits, "asks long, query_id long, vec_id long, score long")
    best = Window.partitionBy("asks").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
