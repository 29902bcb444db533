"""Removal of word sequences that occur more than once, by seeds and their extension.

Words are maximal runs of other than ASCII white space, taken unchanged. A window is ``length`` words in
a row. In each window the least hash of ``SEED`` neighbouring words is its anchor (winnowing), so equal
windows have equal anchors at equal places. The windows of a text that share one anchor follow each
other and make up a segment: the anchor's reach to both sides. Segments join on anchors:

* an anchor that occurs once proves all windows of its segment single;
* segments that agree in the anchor and in all words of their extent repeat as a whole. They are found
  by counting, so a group of any size costs one row for each member and no pairs;
* where an anchor occurs with several extents, one text for each distinct extent is looked up again, its
  windows are hashed one by one at their distance from the anchor, and the counts say which repeat.

The repeated windows of a document, joined where they touch, are its maximal repeats. Keys pair the
anchor's 64 bits with 64 bits of another hash of all words of the extent or window.

Defined results: a null text has no words and gives the empty text; every row is judged, rows with equal
id and text repeat each other; texts shorter than a window stay; the kept words are joined by one space;
long texts are processed whole; other columns of the input are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, written

SEED = 8
_BATCH_ROWS = 256
_BASE_1, _BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX, _SALT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x2545F4914F6CDD1D)
_STRETCH = 1 << 19


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _MIX
    return h ^ h >> np.uint64(29)


@functools.lru_cache(maxsize=8)
def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; those that texts of usual length need are kept."""
    return _all_powers(base, _STRETCH + 1)[:n] if n <= _STRETCH + 1 else _all_powers.__wrapped__(base, n)


class RangeHash:
    """Hashes of any ranges of a sequence of hashes, from one array of sums."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(_BASE_2, len(h)), out=self.sums[1:])
        self.back = _powers(pow(_BASE_2, -1, 1 << 64), len(h) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


_BYTES = _mixed((np.arange(256) + 1).astype(np.uint64) * np.uint64(_BASE_1))


def segments(h: np.ndarray, text_of: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor's place, anchor hash, extent hash) of all segments.

    ``h`` are the word hashes of several texts one after another, ``text_of`` the text of each word.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(h) < length:
        return none
    seeds = np.zeros(len(h) - SEED + 1, np.uint64)
    for j in range(SEED):
        seeds = seeds * np.uint64(_BASE_1) + h[j : len(h) - SEED + 1 + j]
    seeds = _mixed(seeds)
    span = length - SEED + 1
    least, at = seeds, np.arange(len(seeds))
    wide = 1
    while wide < span:
        step = min(wide, span - wide)
        a, b = least[:-step], least[step:]
        right = b < a
        least, at = np.where(right, b, a), np.where(right, at[step:], at[:-step])
        wide += step
    inside = np.flatnonzero(text_of[: len(h) - length + 1] == text_of[length - 1 :])
    if not len(inside):
        return none
    anchor, text = at[inside], text_of[inside]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    firsts = np.flatnonzero(new)
    first, count, place = inside[firsts], np.diff(np.append(firsts, len(inside))), anchor[firsts]
    extent = RangeHash(_mixed(h ^ _SALT)).of(first, first + count + length - 1)
    extent = _mixed(extent ^ ((place - first).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)) * np.uint64(_BASE_1))
    return first, count, place, seeds[place].view(np.int64), extent.view(np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def word_hashes(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, where they start) of texts that lie in ``data`` one after another and begin at ``firsts``.

    A word's hash is made of the hash of its bytes, taken from running sums over ``data``, and its length.
    """
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(data):
        hi = lo + _STRETCH
        while hi < len(data) and not _SPACE[data[hi - 1]]:
            gap = np.flatnonzero(_SPACE[data[hi : hi + _STRETCH]])
            hi += int(gap[0]) + 1 if len(gap) else _STRETCH
        part = data[lo:hi]
        shown = ~_SPACE[part]
        edge = shown.copy()
        edge[1:] &= ~shown[:-1]
        first = firsts[(firsts >= lo) & (firsts < lo + len(part))] - lo
        edge[first] = shown[first]
        at = np.flatnonzero(edge)
        end = shown.copy()
        end[:-1] &= ~shown[1:] | edge[1:]
        size = np.flatnonzero(end) + 1 - at
        h = RangeHash(_BYTES[part]).of(at, at + size)
        hashes.append(_mixed(h ^ size.astype(np.uint64) * np.uint64(_BASE_1)))
        starts.append(at + lo)
        lo += len(part)
    return np.concatenate(hashes), np.concatenate(starts)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, nulls as empty ones, and where each begins."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return np.frombuffer(raw if raw is not None else b"", np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0]


def _find_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH_ROWS):
                part = batch.slice(lo, _BATCH_ROWS)
                data, firsts = _bytes(part.column("text"))
                h, at = word_hashes(data, firsts)
                text_of = np.searchsorted(firsts, at, "right") - 1  # an empty text begins where the next one does
                begins = np.searchsorted(at, firsts)
                first, count, place, anchor, extent = segments(h, text_of, length)
                rows = text_of[first] if len(first) else np.zeros(0, np.int64)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("th").take(take), pa.array(anchor), pa.array(extent), pa.array(first - begins[rows], pa.int64()), pa.array(count, pa.int64()), pa.array(place - first, pa.int64())],
                    ["doc_id", "th", "ah", "ch", "s", "n", "o"],
                )

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the way through a shuffle."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress(t.encode()) if t is not None else None for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(packed, pa.binary())], ["doc_id", "th", "z"])


def _opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all compressed texts one after another, nulls as empty ones, and where each begins, the end of the last one too."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    texts = [open_.decompress(z) if z is not None else b"" for z in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _listed(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """(row of each member of a column of lists of structs, the members' fields)."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *(flat.field(n).to_numpy() for n in names)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i]`` to ``starts[i] + sizes[i] - 1`` of all i, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _find_windows(length: int):
    """Each segment's matches are extended to both sides: a window's key tells how far it reaches before the anchor, and all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH_ROWS):
                part = batch.slice(lo, _BATCH_ROWS)
                data, ends = _opened(part.column("z"))
                h, at = word_hashes(data, ends[:-1])
                k, ah, s, n, o, c = _listed(part.column("segs"), "ah", "s", "n", "o", "c")
                first = _spread(s, n)
                of = np.repeat(np.arange(len(n)), n)
                begin = np.searchsorted(at, ends[:-1])[k[of]] + first
                w = RangeHash(_mixed(h ^ _SALT)).of(begin, begin + length)
                before = o[of] - (first - s[of])
                w = _mixed(w ^ ah.view(np.uint64)[of] ^ before.astype(np.uint64) * np.uint64(_BASE_1)).view(np.int64)
                take = pa.array(k[of])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("th").take(take), *map(pa.array, (ah[of], w, first, c[of]))], ["doc_id", "th", "ah", "w", "s", "c"])

    return run


def _covered(n: int, starts: np.ndarray, ends: np.ndarray, depth: type = np.int64) -> np.ndarray:
    """True for the places of ``range(n)`` that some range covers; as many ranges as ``depth`` can count may overlap."""
    change = np.zeros(n + 1, depth)
    np.add.at(change, starts, depth(1))
    np.add.at(change, ends, depth(-1))
    return np.cumsum(change, dtype=depth)[:-1] > 0


def _runs(flags: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; a run ends where a text begins."""
    opens, closes = flags.copy(), flags.copy()
    opens[1:] &= ~flags[:-1]
    opens[firsts[firsts < len(flags)]] = flags[firsts[firsts < len(flags)]]
    closes[:-1] &= ~flags[1:] | opens[1:]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH_ROWS):
                part = batch.slice(lo, _BATCH_ROWS)
                data, ends = _opened(part.column("z"))
                first, last = _runs(~_SPACE[data], ends[:-1])  # of the bytes of words
                begins = np.searchsorted(first, ends)
                k, s, n = _listed(part.column("spans"), "s", "n")
                gone = _covered(len(first), begins[k] + s, begins[k] + s + n + length - 1)
                kept = np.flatnonzero(~gone)
                # a kept word that another one of its text follows takes the space after it along
                text_of = np.searchsorted(ends, first[kept], "right")
                follows = np.append(text_of[1:] == text_of[:-1], False)[: len(kept)]
                stays = np.zeros(len(data) + 1, bool)
                stays[:-1] = _covered(len(data), first[kept], last[kept], np.int8)
                spaces = last[kept][follows]
                stays[spaces] = True
                out = np.append(data, np.uint8(32))
                out[spaces] = 32
                size = np.cumsum(np.bincount(text_of, last[kept] - first[kept] + follows, minlength=len(part) + 1))
                texts = pa.StringArray.from_buffers(len(part), pa.py_buffer(size.astype(np.int32)), pa.py_buffer(out[stays]))
                start, end = _runs(gone, begins[:-1])
                of = np.searchsorted(begins, start, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(start - begins[of]), pa.array(end - begins[of])], ["start", "end"])
                repeats = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(part) + 1)), pa.int32()), spans)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[begins])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts, pa.array(np.diff(begins)), pa.array(removed), repeats], ["doc_id", "kept", "n_words", "n_removed", "repeats"])

    return run


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_words, n_removed, repeats) of every row; ``repeats`` are removed ranges of words, ends exclusive."""
    if length < SEED:
        raise ValueError(f"a window has {SEED} words at least")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    kind = docs.schema[id_col].dataType.simpleString()
    key = f"doc_id {kind}, th long"
    found, found_path = written(texts.mapInArrow(_find_segments(length), f"{key}, ah long, ch long, s long, n long, o long"), "segments")

    anchors = found.groupBy("ah").agg(F.count("*").alias("seen"), (F.min("ch") != F.max("ch")).alias("several")).where("seen > 1").drop("seen")
    shared, shared_path = written(found.join(anchors, "ah"), "shared")
    drop_written(spark, found_path)

    several = shared.where("several")
    extents = several.groupBy("ah", "ch").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "s", "n", "o")).alias("one"))
    extents, extents_path = written(extents, "extents")
    whole = shared.where("NOT several").select("doc_id", "th", "s", "n").union(several.join(extents.where("c > 1").select("ah", "ch"), ["ah", "ch"], "left_semi").select("doc_id", "th", "s", "n"))

    again = extents.select("one.doc_id", "one.th", F.struct("ah", "one.s", "one.n", "one.o", "c").alias("g")).groupBy("doc_id", "th").agg(F.collect_list("g").alias("segs"))
    squeezed = texts.mapInArrow(_squeeze, f"{key}, z binary")
    # rows with equal id and text are one text here; which of them is looked up again makes no difference
    a, b = squeezed.alias("a"), again.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
    looked = a.join(b, same).select("a.doc_id", "a.th", "z", "segs").mapInArrow(_find_windows(length), f"{key}, ah long, w long, s long, c long")
    looked, looked_path = written(looked.distinct(), "windows")
    repeated = looked.groupBy("ah", "w").agg(F.sum("c").alias("c")).where("c > 1").select("ah", "w")
    single = looked.where("c = 1").join(repeated, ["ah", "w"], "left_semi").select("doc_id", "th", "s", F.lit(1).cast("long").alias("n"))

    spans, _ = written(whole.union(single).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "n")).alias("spans")), "spans")
    drop_written(spark, shared_path, extents_path, looked_path)
    b = spans.alias("b")
    done = squeezed.alias("a").join(b, same, "left").select("a.doc_id", "z", "spans")
    return done.mapInArrow(_remove(length), f"doc_id {kind}, kept string, n_words long, n_removed long, repeats array<struct<start:long,end:long>>")
