"""Similarity join of documents by the Jaccard coefficient of their word n-grams, with Bayesian pruning.

Words are runs of letters and digits in lower case; a document's set holds its ``n``-grams of words (a
shorter document has one, all its words). Documents with equal word sequences are one class, looked at
once. Every class gets ``BANDS * BAND_ROWS`` MinHash values. Classes that agree in all values of some
band are candidates.

Large groups would make as many candidate pairs as bands that they agree in, each with both sets on its way. So classes that share
bands are dealt into tiles of about ``TILE`` by the least id they meet. How many candidates two tiles have is known from
the counts of their members in each band. Where these are at least one for ``SPARSE`` pairs of members, no candidate is formed: the
members' sets travel once for each such pair of tiles and all pairs are verified there, on 64 bits. This finds all that the bands would, and more.

All other candidates' values are compared in steps of ``STEP``: under a uniform prior, the
probability that the coefficient reaches the threshold after m of k values agreed is a binomial tail, and
a pair goes as soon as it falls below ``tolerance``. The few that stay are verified on their whole sets:
on 32 bits of each n-gram first, half as many bytes on their way, and on 64 bits if the count comes so near to the
threshold that wrong codes might decide: within ``SLACK``, the n-grams that share a code with another one of their text,
and the number of wrong agreements to be expected of sets of these sizes, with six standard deviations.

A pair with a coefficient j is a candidate with probability 1 - (1 - j**BAND_ROWS)**BANDS: 0.9952 at 0.5,
0.9999 at 0.6, so documents of one group, which usually have several links, stay connected.

Only DataFrame functions are used. Minima are taken by partial sums in the tasks that read the texts; equal texts
are one class, so copies cost nothing further; bands that many different texts share are split by the
adaptive join; no bucket or partner list is capped.

Defined results: null texts and texts without letters or digits link with nothing; one row for every input
row; repeated ids count as so many documents of their texts' classes; no other column is read.
"""

from __future__ import annotations

import random
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._shared import drop_written, written

BANDS = 40
BAND_ROWS = 3
STEP = 12
#: Shared n-grams by which counts on 32 bits may be off at least before a pair is counted again on 64.
SLACK = 4
#: Classes in a tile, at most about.
TILE = 256
#: Pairs of two tiles' members to one candidate (counted in every band) up to which all of them are verified at once.
SPARSE = 4
_CONSTANTS = [c - 2**31 for c in random.Random(5).sample(range(2**32), BANDS * BAND_ROWS)]


def least_agreeing(k: int, threshold: float, tolerance: float) -> int:
    """The least number of agreeing values of ``k`` at which the threshold is still likely enough.

    With a uniform prior, P(J >= t | m of k agree) = P(Binomial(k + 1, t) <= m).
    """
    tail = 0.0
    for m in range(k + 1):
        tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        if tail >= tolerance:
            return m
    return k


def _likely(a: str, b: str, threshold: float, tolerance: float) -> Column:
    """Compares the values of two signatures step by step and stops at the first step that rules the pair out."""

    def agreed(start: int, known: Column) -> Column:
        here = F.zip_with(F.slice(a, start + 1, STEP), F.slice(b, start + 1, STEP), lambda x, y: (x == y).cast("int"))
        return F.aggregate(here, known, lambda s, x: s + x)

    total = BANDS * BAND_ROWS
    so_far = F.lit(0)
    # nested from the last step outwards, so that a later step is only looked at after the earlier ones
    def step(start: int, so_far: Column) -> Column:
        m = agreed(start, so_far)
        bound = F.lit(least_agreeing(start + STEP, threshold, tolerance))
        if start + STEP >= total:
            return m >= bound
        return F.element_at(F.transform(F.array(m), lambda c: F.when(c < bound, F.lit(False)).otherwise(step(start + STEP, c))), 1)

    return step(0, so_far)


def shingled(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """Adds ``k1``, ``k2`` (128 bits of the word sequence, null without words) and ``grams``, hashes of the n-grams."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    steps = docs.withColumn("_words", words).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    some = F.size("_hashes") > 0
    gram = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_hashes") - n, F.lit(0))), lambda i: F.xxhash64(*(F.get("_hashes", i + j) for j in range(n))))
    return steps.select(*docs.columns, F.when(some, F.xxhash64("_hashes")).alias("k1"), F.when(some, F.xxhash64(F.lit(5), "_words")).alias("k2"), F.when(some, gram).alias("grams"))


def _counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, both, lost): the sizes of the pairs' sets, of what they share, and what the sets have more than codes."""
    one, two = (sets.select(F.col("u").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    met = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    lost = F.col("na") + F.col("nb") - F.size("sa") - F.size("sb")
    return met.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"), lost.alias("lost"))


def _slack(na: Column, nb: Column, lost: Column) -> Column:
    """By how much a count on 32 bits may be off."""
    false = na.cast("double") * nb / 2.0**32
    return SLACK + lost + false + 6 * F.sqrt(false)


def _tiled(keyed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(ta, tb), the pairs of tiles to be verified as a whole; (u, t, m), the tiles; (a, b), the candidates in no such pair; their paths."""
    alike = Window.partitionBy("key")
    shared = keyed.select("key", "u", F.count("*").over(alike).alias("n"), F.min("u").over(alike).alias("lead")).where("n > 1").drop("n")
    shared, shared_path = written(shared, "shared")
    leads = shared.groupBy("u").agg(F.min("lead").alias("lead"))
    parts = leads.groupBy("lead").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    dealt = leads.join(parts, "lead").select("u", F.xxhash64("lead", F.pmod(F.xxhash64("u"), "parts")).alias("t"))
    tiles, tiles_path = written(dealt.withColumn("m", F.count("*").over(Window.partitionBy("t"))), "tiles")

    placed = shared.select("key", "u").join(tiles.hint("merge"), "u")
    counts = placed.groupBy("key", "t").agg(F.count("*").alias("c"), F.first("m").alias("m"))
    one, two = (counts.select("key", F.col("t").alias(f"t{x}"), F.col("c").alias(f"c{x}"), F.col("m").alias(f"m{x}")) for x in "ab")
    own = F.col("ta") == F.col("tb")
    # products as doubles: as many candidates, or pairs, as the members in a band, or of the tiles, make
    made, room = (F.when(own, F.col(f"{x}a").cast("double") * (F.col(f"{x}a") - 1) / 2).otherwise(F.col(f"{x}a").cast("double") * F.col(f"{x}b")) for x in "cm")
    met = one.join(two.hint("merge"), "key").where("ta <= tb").select("key", "ta", "tb", "ma", "mb", made.alias("made")).where("made > 0")
    met, met_path = written(met, "meetings")
    cells = met.groupBy("ta", "tb").agg(F.sum("made").alias("made"), F.first("ma").alias("ma"), F.first("mb").alias("mb"))
    cells = cells.where((F.col("made") >= F.col("ma") + F.col("mb")) & (F.col("made") * SPARSE >= room)).select("ta", "tb")
    cells, cells_path = written(cells, "cells")

    a, b = (placed.select("key", F.col("u").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
    rest = met.select("key", "ta", "tb").join(cells, ["ta", "tb"], "left_anti").join(a.hint("merge"), ["key", "ta"]).join(b.hint("merge"), ["key", "tb"])
    rest = rest.where(~own | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest, rest_path = written(rest, "candidates")
    drop_written(keyed.sparkSession, shared_path, met_path)
    return cells, tiles, rest, [cells_path, tiles_path, rest_path]


def _within(cells: DataFrame, tiles: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of all pairs of the cells' members at or over the threshold."""
    members = tiles.select("t", "u").join(sets.hint("merge"), "u")
    one, two = (cells.join(members.select(F.col("t").alias(f"t{x}"), F.col("u").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")).hint("merge"), f"t{x}") for x in "ab")
    # each condition names what is shared once, so that it is counted once; it and what is needed are whole or well apart
    need = threshold * (F.col("na") + F.col("nb")) / (1 + threshold) - 1e-9
    pairs = one.join(two.hint("merge"), ["ta", "tb"]).where((F.col("ta") != F.col("tb")) | (F.col("a") < F.col("b")))
    close = pairs.where((F.least("na", "nb") >= need) & (F.size(F.array_intersect("sa", "sb")) >= need))
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(docs: DataFrame, n: int = 3, threshold: float = 0.5, tolerance: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, copy_of, class_id, n_links) of every row.

    ``copy_of`` is the least id with the same words, ``class_id`` the least id that links lead to, ``n_links``
    the number of other rows at or over the threshold.
    """
    total = BANDS * BAND_ROWS
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    values = shingled(rows.withColumn("uid", F.monotonically_increasing_id()), n).select("uid", "id", "k1", "k2", F.explode_outer(F.transform("grams", lambda g: F.shiftright(g, 32).cast("int"))).alias("g"))
    signed = values.groupBy("uid", "id", "k1", "k2").agg(*(F.min(F.hash(F.col("g").bitwiseXOR(F.lit(c)))).alias(f"m{i}") for i, c in enumerate(_CONSTANTS)))
    signed, _ = written(signed.select("uid", "id", "k1", "k2", F.array(*(f"m{i}" for i in range(total))).alias("sig")), "signatures")
    classes = signed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("uid").alias("u"), F.min("id").alias("copy_of"), F.count("*").alias("copies"))
    classes, _ = written(classes, "classes")
    sigs = signed.select(F.col("uid").alias("u"), "sig").join(classes.select("u"), "u", "left_semi")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *(F.get("sig", b * BAND_ROWS + j) for j in range(BAND_ROWS))))
    keyed = sigs.select("u", F.explode(bands).alias("key"))
    cells, tiles, met, (cells_path, tiles_path, met_path) = _tiled(keyed)
    # 16 bits of each value travel with a pair: a false agreement in 65,536 only ever keeps a pair
    short = F.transform("sig", lambda x: (F.pmod(x, F.lit(65536)) - 32768).cast("smallint"))
    one, two = (sigs.select(F.col("u").alias(x), short.alias(f"sig_{x}")) for x in "ab")
    likely, likely_path = written(met.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(_likely("sig_a", "sig_b", threshold, tolerance)).select("a", "b"), "likely")
    drop_written(rows.sparkSession, met_path)

    inside = tiles.join(cells.select(F.col("ta").alias("t")).union(cells.select("tb")), "t", "left_semi").select("u")
    asked = likely.select(F.col("a").alias("u")).union(likely.select("b")).union(inside).distinct()
    asked = asked.join(classes, "u").select("u", "copy_of", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    held = shingled(rows.join(asked.hint("merge"), F.col("id").eqNullSafe(F.col("copy_of"))).select("u", "c1", "c2", "text"), n).where("k1 = c1 AND k2 = c2")
    sets = held.groupBy("u").agg(F.first(F.array_distinct("grams")).alias("s"))
    codes = F.array_distinct(F.transform("s", lambda x: F.shiftright(x, 32).cast("int")))
    sets, sets_path = written(sets.select("u", F.size("s").alias("n"), codes.alias("c"), "s"), "sets")
    judged, judged_path = written(_counted(likely, sets.select("u", "n", F.col("c").alias("s"))), "judged")
    need = threshold * (F.col("na") + F.col("nb")) / (1 + threshold)  # both / (na + nb - both) >= threshold
    unclear = F.abs(F.col("both") - need) <= _slack(F.col("na"), F.col("nb"), F.col("lost"))
    again = _counted(judged.where(unclear).select("a", "b"), sets.select("u", "n", "s"))
    pairs = judged.where(~unclear).union(again).where(F.col("both") >= threshold * (F.col("na") + F.col("nb") - F.col("both")))
    sizes = classes.select("u", "copies")
    links = pairs.select("a", "b").union(_within(cells, tiles, sets.select("u", "n", "s"), threshold)).join(sizes.select(F.col("u").alias("a"), F.col("copies").alias("ca")), "a").join(sizes.select(F.col("u").alias("b"), F.col("copies").alias("cb")), "b")
    links, _ = written(links.select("a", "b", "ca", "cb"), "links")
    drop_written(rows.sparkSession, likely_path, sets_path, judged_path, cells_path, tiles_path)

    others = links.select(F.col("a").alias("u"), F.col("cb").alias("n")).union(links.select("b", "ca")).groupBy("u").agg(F.sum("n").alias("others"))
    grouped, _ = components(links.select("a", "b"))
    grouped = grouped.withColumnRenamed("id", "u")
    known = classes.join(others, "u", "left").join(grouped, "u", "left").withColumn("component", F.coalesce("component", "u"))
    least = known.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    known = known.join(least, "component").select("k1", "k2", "copy_of", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    found = signed.select("id", "k1", "k2").join(known, ["k1", "k2"], "left")
    return found.select("id", "k1", "k2", F.coalesce("copy_of", "id").alias("copy_of"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
