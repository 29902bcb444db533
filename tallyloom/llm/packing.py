"""Packing of related documents into training sequences.

A signature of each document holds, for each of ``BINS`` classes of token pairs, 16 bits of the least hash (one-permutation
MinHash): the share of bins in which two signatures agree estimates the Jaccard coefficient of their documents' token
pairs. The rows are put in ``ORDERS`` orders, each by four other bins, one after another, so that rows stand the nearer together the
more of these bins they share. In each order a row is compared with the ``REACH`` rows on either side, and the ``TIES`` most
similar are its ties; of those from all orders it keeps the ``BEST`` most similar. Rows of one key, a hot source or a group of copies,
are ordered by row like any others and split between tasks; where the tasks' ranges meet, the rows on
both sides are compared once more. So the edges grow with the rows, and no group is ever compared pair by pair. The graph
is approximate: README has its recall.

Documents are dealt into blocks by the least id near them in the graph (over ties not much weaker than their best one), in ranges of (that id, own id), so a hot group is split
like any other. In each block paths are walked greedily: start at the unvisited document of lowest degree, go on
to the unvisited neighbour with the heaviest edge (of lowest degree, then least id, among equals), start anew when there is none.
Edges into other blocks aren't walked; ``layout`` counts them for each row (``lost``). The documents of all paths of a
block are laid end to end and cut every ``length`` tokens, so only a block's last sequence has padding.

Tokens are written once, as compact binaries, and joined with the layout; they never sit in one task's
memory beyond a batch.

Defined results: a null or empty text is the end-of-document id alone, has no ties and is packed where its row lies; every row
is packed, repeated rows and ids too, each by itself; among equal neighbours the least row wins; a long document spans
as many sequences as it needs; an empty table gives no pieces; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, with_text, written
from .word_tokens import tokenizer

BINS, ORDERS = 32, 6
#: Rows on either side that a row meets in an order, ties kept of an order, ties kept of all, and those that choose the block.
REACH, TIES, BEST, LABEL_TIES = 16, 8, 12, 4
BLOCK_ROWS = 50_000
SLICE_BYTES = 1_000_000
_MEMO_WORDS = 200_000
_TIES = pa.struct([("w", pa.int32()), ("b", pa.int64())])


def signatures(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[texts, BINS] uint16, 0 for a bin without pairs; every text's last id is its end and makes no pair."""
    ends = np.cumsum(counts)
    # of a long text only hashes that can be the least of their bin, but for one bin in 160,000, are looked at
    bound = np.minimum(2.0**63 * 12 * BINS / np.maximum(counts, 1), 2.0**63).astype(np.uint64) * np.uint64(2) - np.uint64(1)
    found = [np.zeros(0, np.uint64)]
    for lo in range(0, len(ids) - 1, 1 << 20):
        wide = ids[lo : lo + (1 << 20) + 1].astype(np.uint64)
        h = wide[:-1] * np.uint64(0x9E3779B97F4A7C15)
        h += wide[1:] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        upto = np.clip(ends - lo, 0, len(h))
        most = np.repeat(bound, np.diff(upto, prepend=0))
        last = np.concatenate([ends, ends[counts > 1] - 1]) - lo
        most[last[(last > 0) & (last <= len(h))] - 1] = 0
        small = np.flatnonzero(h < most)
        text, h = np.searchsorted(upto, small, "right"), h[small]
        found.append((text * BINS + (h & np.uint64(BINS - 1)).astype(np.int64)).astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    kept = np.sort(np.concatenate(found))
    bins = (kept >> np.uint64(40)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1])[: len(bins)])
    out = np.zeros(len(counts) * BINS, np.uint16)
    out[bins[first]] = ((kept[first] & np.uint64((1 << 40) - 1)) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)
    return out.reshape(-1, BINS)


def order_keys(signature: np.ndarray) -> np.ndarray:
    """[texts, ORDERS] int64: the number of the order, then 15 bits of each of four bins; an empty bin borrows from the next one that isn't."""
    twice = np.concatenate([signature, signature], axis=1)
    place = np.where(twice > 0, np.arange(2 * BINS), 2 * BINS - 1)
    full = np.take_along_axis(twice, np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BINS], axis=1).astype(np.int64) >> 1
    step = BINS // ORDERS
    return np.stack([sum((full[:, step * o + j] << 15 * (3 - j) for j in range(4)), np.full(len(full), o, np.int64) << 60) for o in range(ORDERS)], axis=1)


def walk(ids: np.ndarray, neighbours: list[dict[int, int]]) -> list[int]:
    """The order in which greedy low-degree-first paths visit rows; ``neighbours`` maps row to edge weight."""
    degree = [len(n) for n in neighbours]
    seen = [False] * len(ids)
    out = []
    for start in sorted(range(len(ids)), key=lambda i: (degree[i], ids[i])):
        at = start
        while at >= 0 and not seen[at]:
            seen[at] = True
            out.append(at)
            free = [(-w, degree[j], ids[j], j) for j, w in neighbours[at].items() if not seen[j]]
            at = min(free)[3] if free else -1
    return out


def in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``SLICE_BYTES`` of text, or one row if that is longer."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(row_id, doc_id, n, ids binary, signature binary) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path)
        own.most_words = _MEMO_WORDS
        for batch in batches:
            for part in in_slices(batch):
                ids, counts = own.encode(part.column("text"), end_id)
                ends = np.append(0, np.cumsum(counts) * ids.itemsize).astype(np.int32)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                signs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BINS), len(counts), [None, pa.py_buffer(signatures(ids, counts))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("doc_id"), pa.array(counts, pa.int64()), raw, signs], ["row_id", "doc_id", "n", "ids", "signature"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id long, doc_id {id_type}, n long, ids binary, signature binary")


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


def closest(ids: np.ndarray, signs: np.ndarray, low: int, high: int) -> tuple[np.ndarray, pa.Array]:
    """The rows from ``low`` to ``high`` that have ties, and these: the ``TIES`` most similar rows within ``REACH`` places."""
    n = len(ids)
    weight, other = np.zeros((n, 2 * REACH), np.int32), np.zeros((n, 2 * REACH), np.int64)
    held = (signs > 0).view(np.uint64)
    for d in range(1, min(REACH + 1, n)):
        agree = ((signs[d:] == signs[:-d]) & (signs[d:] > 0)).view(np.uint64)
        either = np.bitwise_count(held[d:] | held[:-d]).sum(axis=1)
        w = 64 * np.bitwise_count(agree).sum(axis=1).astype(np.int32) // np.maximum(either, 1).astype(np.int32)
        w[ids[d:] == ids[:-d]] = 0
        weight[:-d, d - 1], other[:-d, d - 1] = w, ids[d:]
        weight[d:, REACH + d - 1], other[d:, REACH + d - 1] = w, ids[:-d]
    weight, other = weight[low:high], other[low:high]
    order = np.lexsort([other, -weight])[:, :TIES] if len(weight) else np.zeros((0, TIES), np.int64)
    weight, other = np.take_along_axis(weight, order, axis=1), np.take_along_axis(other, order, axis=1)
    some = weight > 0
    count = some.sum(axis=1)
    have = count > 0
    pairs = pa.StructArray.from_arrays([pa.array(weight[some]), pa.array(other[some])], fields=list(_TIES))
    return ids[low:high][have], pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count[have])), pa.int32()), pairs)


def neighbour_graph(rows: DataFrame) -> DataFrame:
    """(a, ties): the ``BEST`` most similar rows (w, b) that row a met in any order; w is 64 times the share of bins that agree."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _unpacked(batch.column("signature"))
            some = np.flatnonzero(signs.any(axis=1))
            take = pa.array(np.repeat(some, ORDERS))
            yield pa.RecordBatch.from_arrays([pa.array(order_keys(signs[some]).ravel()), batch.column("row_id").take(take), batch.column("signature").take(take)], ["k", "row_id", "signature"])

    held = rows.select("row_id", "signature").mapInArrow(keyed, "k long, row_id long, signature binary")
    held, held_path = written(held, "orders")  # the range partitioning reads it twice
    held = held.repartitionByRange("k", "row_id").sortWithinPartitions("k", "row_id")
    schema = "a long, ties array<struct<w:int,b:long>>, border int, side int, signature binary"

    def record(a: np.ndarray, ties: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), ties, *(pa.nulls(len(a), t) for t in (pa.int32(), pa.int32(), pa.binary()))], ["a", "ties", "border", "side", "signature"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        ids, signs, head, low = np.zeros(0, np.int64), np.zeros((0, BINS), np.uint16), None, 0

        def border(which: int, side: int, part: slice) -> pa.RecordBatch:
            n = len(ids[part])
            raw = pa.array([x.tobytes() for x in signs[part]], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.nulls(n, pa.list_(_TIES)), pa.array([which] * n, pa.int32()), pa.array([side] * n, pa.int32()), raw], ["a", "ties", "border", "side", "signature"])

        for batch in batches:
            ids, signs = np.concatenate([ids, batch.column(1).to_numpy()]), np.concatenate([signs, _unpacked(batch.column(2))])
            if head is None and len(ids) >= REACH:
                head = True
                yield border(own - 1, 1, slice(0, REACH))
            high = len(ids) - REACH
            if high > low:  # rows that have all their neighbours
                yield record(*closest(ids, signs, low, high))
                drop = max(high - REACH, 0)
                ids, signs, low = ids[drop:], signs[drop:], high - drop
        if len(ids):
            if head is None:
                yield border(own - 1, 1, slice(0, REACH))
            yield record(*closest(ids, signs, low, len(ids)))
            yield border(own, 0, slice(max(len(ids) - REACH, 0), None))

    def across(rows: pa.Table) -> pa.Table:
        """Ties of the last rows of one task's range and the first ones of the next."""
        rows = rows.sort_by([("side", "ascending"), ("place", "ascending")]).combine_chunks()
        a, ties = closest(rows.column("a").to_numpy(), _unpacked(rows.column("signature")), 0, rows.num_rows)
        return pa.table({"a": a, "ties": ties})

    met, met_path = written(held.select("k", "row_id", "signature").mapInArrow(run, schema).withColumn("place", F.monotonically_increasing_id()), "met")
    borders = met.where("border IS NOT NULL").select("a", "border", "side", "place", "signature")
    crossed = borders.groupBy("border").applyInArrow(across, "a long, ties array<struct<w:int,b:long>>")  # 2 * REACH rows a group
    every = met.where("border IS NULL").select("a", "ties").unionByName(crossed)
    # a few ties of each order and border are collected
    graph, _ = written(every.groupBy("a").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ties"))), asc=False), 1, BEST).alias("ties")), "graph")
    drop_written(rows.sparkSession, held_path, met_path)
    return graph


def layout(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(row_id, block, at, lost), as a written table: where a row's first token lies in its block of concatenated documents, and its ties into other blocks."""
    total = rows.count()
    blocks = max(1, -(-total // (block_rows or BLOCK_ROWS)))
    graph = neighbour_graph(rows)
    nearest = F.filter(F.slice("ties", 1, LABEL_TIES), lambda t: 4 * t["w"] >= 3 * F.get("ties", F.lit(0))["w"])
    nearby = F.transform(nearest, lambda t: t["b"])
    near = graph.select("a", nearby.alias("bs")).select("a", "bs", F.least("a", F.array_min("bs")).alias("l"))
    nearer = near.select("a", F.explode("bs").alias("b")).join(near.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("label"))
    nodes = rows.select("row_id", "n").join(nearer.join(graph, "a").withColumnRenamed("a", "row_id"), "row_id", "left")
    nodes = nodes.withColumn("label", F.coalesce("label", "row_id")).select("label", "row_id", "n", "ties").repartitionByRange(blocks, "label", "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = list(batches)  # a block: ids, lengths and a few edges of each of its rows
        if not sum(p.num_rows for p in parts):
            return
        block = pa.Table.from_batches(parts).combine_chunks()
        ids, n = (block.column(c).to_numpy() for c in ("row_id", "n"))
        ties = block.column("ties").combine_chunks()
        ties = ties.chunk(0) if isinstance(ties, pa.ChunkedArray) else ties
        flat, sizes = ties.flatten(), np.nan_to_num(ties.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        a, b, w = np.repeat(np.arange(len(ids)), sizes), flat.field("b").to_numpy(), flat.field("w").to_numpy()
        order = np.argsort(ids)
        place = np.minimum(np.searchsorted(ids, b, sorter=order), len(ids) - 1)
        here = ids[order[place]] == b
        lost = np.bincount(a[~here], minlength=len(ids))
        neighbours: list[dict[int, int]] = [{} for _ in ids]
        for x, y, weight in zip(a[here].tolist(), order[place[here]].tolist(), w[here].tolist()):
            neighbours[x][y] = neighbours[y][x] = weight
        path = np.array(walk(ids.tolist(), neighbours))
        n = n[path]
        yield pa.RecordBatch.from_arrays([pa.array(ids[path]), pa.array(np.full(len(ids), TaskContext.get().partitionId(), np.int32)), pa.array(np.cumsum(n) - n), pa.array(lost[path])], ["row_id", "block", "at", "lost"])

    placed, _ = written(nodes.mapInArrow(run, "row_id long, block int, at long, lost long"), "layout")
    return placed


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids.

    ``ids`` is a binary of little-endian unsigned 32-bit token ids. Sequence ``sequence_id`` is filled from
    offset 0 without gaps; what is missing to ``length`` at its end is padding.
    """
    rows, _ = written(tokenize(with_text(docs, id_col, text_col), tokenizer_path, end_id), "tokens")
    where = layout(rows)
    # both sides grow with the documents; a broadcast would only ever fit small tables
    placed = rows.select("row_id", "doc_id", "n", "ids").join(where.hint("merge"), "row_id")
    id_type = placed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield _pieces(batch.slice(at, 256), length)

    return placed.select("doc_id", "n", "ids", "block", "at").mapInArrow(
        run, f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def _pieces(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    which, start, size, sequence, offset, ids = [], [], [], [], [], []
    rows = zip(*(batch.column(n).to_pylist() for n in ("n", "ids", "block", "at")))
    for k, (n, raw, block, at) in enumerate(rows):
        values = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
        done = 0
        while done < n:
            here = (at + done) % length
            take = min(n - done, length - here)
            which.append(k)
            start.append(done)
            size.append(take)
            sequence.append((block << 40) + (at + done) // length)
            offset.append(here)
            ids.append(values[4 * done : 4 * (done + take)])
            done += take
    rows_of = pa.array(which, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(rows_of), *(pa.array(x, pa.int64()) for x in (start, size)), batch.column("n").take(rows_of), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(ids, pa.binary())],
        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )
