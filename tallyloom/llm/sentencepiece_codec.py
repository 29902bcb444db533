"""SentencePiece BPE encoding by a prefix table of last tokens, and decoding.

Encoding. In a merge-type model every prefix of a string has exactly one BPE encoding, and the encoding
of a longer prefix differs from it only in its last tokens. So one table entry for each prefix, its
unique last token, holds all encodings. The entries are found from left to right: an automaton gives the
pieces that end at a position; such a piece is the last token exactly if it may stand after the last
token of the prefix before it. Whether two tokens may stand side by side is decided by undoing their
merges in reverse order of rank and looking for a merge across the gap that would have come first. Ids
are then read off the table backwards.

Texts are cut where no piece can reach across (before a space mark that follows another character, and
at characters that no longer piece holds), and each word is encoded once for as long as a bounded memo
keeps it. Words are never cut elsewhere, so the ids are those of the whole text.

Models whose normalizer changes texts are refused: some texts that would show it are compared with the library's ids at the start.

Defined results: an empty table gives an empty one; a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded each; very long words cost time in proportion to their length; other columns pass unchanged,
a column that has the output's name is replaced.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
_MEMO_WORDS = 500_000
_MEMO_PAIRS = 1_000_000
_LOADED: dict[str, "PieceCodec"] = {}


class PieceCodec:
    """One BPE model with byte fallback, as its file gives it."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.bytes_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        #: What an id stands for, as bytes; control ids and the unknown one have their own rules.
        self.surface: list[bytes] = [b""] * size
        plain: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.surface[i] = piece.replace(SPACE, " ").encode()
                plain[piece] = i
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.bytes_id] = True
        self.score = {p: model.get_score(i) for p, i in plain.items()}
        self.plain = plain
        runs = {p for p in plain if len(p) > 1 and not p.strip(SPACE)}
        longer = [p for p in plain if len(p) > 1 and p not in runs]
        if any(SPACE in p[1:] for p in longer):
            raise ValueError("a piece holds a space mark after another character")
        ranked = sorted(longer, key=lambda p: -self.score[p])
        if len({self.score[p] for p in longer}) != len(longer):
            raise ValueError("pieces share a score, so merges have no single order")
        #: By rank: single characters first, then merged pieces in the order in which they merge.
        singles = sorted({c for p in plain for c in p})
        self.rank = {c: k for k, c in enumerate(singles)} | {p: len(singles) + k for k, p in enumerate(ranked)}
        self.text = singles + ranked
        self.ids = [plain.get(p) for p in self.text]
        self.split: list[tuple[int, int]] = [(k, k) for k in range(len(self.text))]
        self.pair: dict[tuple[int, int], int] = {}
        self.single_count = len(singles)
        reached = []
        for k in range(len(singles), len(self.text)):
            last = self._last_merge(self.text[k])
            if last is not None:
                self.split[k] = last
                reached.append(k)
        for k in reached:
            word = self.text[k]
            for cut in range(1, len(word)):
                a, b = self.rank.get(word[:cut]), self.rank.get(word[cut:])
                if a is not None and b is not None:
                    self.pair[a, b] = k
        self.matcher = ahocorasick.Automaton()
        for k in [*range(len(singles)), *reached]:
            self.matcher.add_word(self.text[k], (k, len(self.text[k])))
        self.matcher.make_automaton()
        self.newline_cuts = not any("\n" in p for p in longer)
        #: Neighbours within some piece; between any two other characters a text can be cut.
        self.inside = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self._units: dict[str, bytes] = {}
        self._fits: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._runs: dict[int, bytes] = {}
        # a model with a normalizer of its own, or without a leading space mark, would give other ids
        for text in ("a", " a  b ", "\n\ta\u00a0b", "e\u0301 \ufb01 \u2460 \uff21 \u2126 \u200b", "\x00\r\x7f", "A\u00df\u0130"):
            ids = model.encode(text)
            if np.frombuffer(self.encode(text), np.int32).tolist() != ids or self.decode(ids) != model.decode(ids):
                raise ValueError(f"this model's rules differ from the codec's on {text!r}")

    def _last_merge(self, word: str) -> tuple[int, int] | None:
        """The two tokens that merge last into ``word``, None if its own text isn't encoded as one token."""
        parts = list(word)
        while len(parts) > 2:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _compatible(self, one: int, two: int) -> bool:
        """True if BPE leaves these tokens side by side."""
        key = one << 20 | two
        limit, fits = len(self.text) + 1, True
        while True:
            if self.pair.get((one, two), limit) < limit:
                fits = False
                break
            if one > two:
                limit, one = one, self.split[one][1]
                if one == limit:
                    limit, two = two + 1, self.split[two][0]
                    if two + 1 == limit:
                        break
            else:
                limit, two = two + 1, self.split[two][0]
                if two + 1 == limit:
                    limit, one = one, self.split[one][1]
                    if one == limit:
                        break
        if len(self._fits) >= _MEMO_PAIRS:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def _unit(self, word: str) -> list[int]:
        """Ids of a word that has no space mark but maybe its first character."""
        last = [-1] * len(word)  # rank of the last token of each prefix; -1 for a character of no piece
        fits, check = self._fits.get, self._compatible
        for end, (rank, length) in self.matcher.iter(word):  # for each end the longest piece first
            if last[end] < 0:
                start = end - length
                if start < 0:
                    last[end] = rank
                elif (before := last[start]) < 0:
                    last[end] = rank
                else:
                    known = fits(before << 20 | rank)
                    if known or known is None and check(before, rank):
                        last[end] = rank
        out: list[int] = []
        end = len(word)
        while end:
            rank = last[end - 1]
            piece = self.text[rank] if rank >= 0 else word[end - 1]
            one = self.ids[rank] if rank >= 0 else None
            if one is None:
                out.extend(self.bytes_id[b] for b in reversed(piece.encode()))
            else:
                out.append(one)
            end -= len(piece)
        return out[::-1]

    def _run(self, n: int) -> bytes:
        """Ids of ``n`` space marks: their pieces share one score, so the leftmost pair merges first."""
        known = self._runs.get(n)
        if known is not None:
            return known
        length, left, right = [1] * n, list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (s := self.score.get(SPACE * (length[i] + length[j]))) is not None:
                heapq.heappush(queue, (-s, i, length[i], length[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if length[i] != a or j < 0 or length[j] != b:
                continue
            length[i], length[j], right[i] = a + b, 0, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        out = np.array([self.plain[SPACE * k] for k in length if k], np.int32).tobytes()
        if len(self._runs) > 10_000:
            self._runs.clear()
        self._runs[n] = out
        return out

    def _word(self, word: str) -> bytes:
        """Ids, as int32 bytes, of a word of ``encode``: after one space mark, or led by a line feed."""
        if SPACE in word:  # the text's own marks are spaces to the model
            return self.encode_parts(word.split(SPACE))
        if word[:1] != "\n" or not self.newline_cuts:
            word = SPACE + word
        start, out, inside, units = 0, [], self.inside, self._units
        for cut in [*(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside), len(word)]:
            unit, start = word[start:cut], cut
            ids = units.get(unit)
            if ids is None:
                ids = np.array(self._unit(unit), np.int32).tobytes()
                if len(unit) <= 64:
                    if len(units) >= _MEMO_WORDS // 2:
                        units.clear()
                    units[unit] = ids
            out.append(ids)
        return b"".join(out)

    def _known(self, word: str) -> bytes:
        """``_word``, from the memo if it is there; only words of usual length go into it."""
        ids = self._words.get(word)
        if ids is None:
            ids = self._word(word)
            if len(word) <= 64:
                if len(self._words) >= _MEMO_WORDS:
                    self._words.clear()
                self._words[word] = ids
        return ids

    def encode_parts(self, parts: list[str]) -> bytes:
        """Ids of parts that each follow a space mark, some of them empty."""
        out, marks, mark = [], 0, np.int32(self.plain[SPACE]).tobytes()
        for part in parts:
            if not part:
                marks += 1
                continue
            ids = self._known(part)
            if marks and part[:1] == "\n" and self.newline_cuts:
                out.append(self._run(marks))
            elif marks and ids[:4] == mark and (len(ids) == 4 or not ids[4:8] == mark):
                out.append(self._run(marks + 1))  # the word's own mark merged with nothing of the word
                ids = ids[4:]
            elif marks:
                out.append(self._run(marks))
            out.append(ids)
            marks = 0
        if marks:
            out.append(self._run(marks))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as int32 bytes."""
        if not text:
            return b""
        parts = (text.replace("\n", " \n") if self.newline_cuts else text).split(" ")
        if SPACE in text:
            parts = [x for part in parts for x in part.split(SPACE)]
        if "" in parts:
            return self.encode_parts(parts)
        words = self._words
        try:
            return b"".join(map(words.__getitem__, parts))
        except KeyError:
            return b"".join(map(self._known, parts))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading space goes; bytes that are no UTF-8 become U+FFFD, one each."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if raw[:1] == b" " and not self.is_byte[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, start = [], 0
            while start < len(raw):
                try:
                    out.append(raw[start:].decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[start : start + e.start].decode() + "�")
                    start += e.start + 1
            return "".join(out)


def codec(model_path: str) -> PieceCodec:
    """The codec of a model file, built once in each process."""
    key = os.fspath(model_path)
    if key not in _LOADED:
        _LOADED[key] = PieceCodec(key)
    return _LOADED[key]


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def _added(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), column], [*(batch.schema.names[i] for i in kept), name])


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``, an array of int: the ids of the whole text in ``text_col``; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                parts = [own.encode(t or "") for t in part.column(text_col).to_pylist()]
                ends = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
                ids = pa.array(np.frombuffer(b"".join(parts), np.int32))
                yield _added(part, out_col, pa.ListArray.from_arrays(pa.array(ends), ids))

    return df.mapInArrow(run, _schema(df, out_col, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the text of the ids in ``ids_col``; null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [own.decode(x.values.tolist()) if x.is_valid and len(x.values) else "" for x in _lists(part.column(ids_col))]
                yield _added(part, out_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema(df, out_col, T.StringType()))


class _List:
    __slots__ = ("is_valid", "values")

    def __init__(self, is_valid: bool, values: np.ndarray):
        self.is_valid, self.values = is_valid, values


def _lists(column: pa.Array) -> Iterator[_List]:
    values, ends, valid = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield _List(bool(valid[i]), values[ends[i] : ends[i + 1]])
