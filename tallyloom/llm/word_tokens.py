"""Token ids of whole texts by a word-level BPE tokenizer file, a batch of texts at a time.

The batch is one array of bytes. It is cut into units: runs of letters, single digits and runs of other signs, as
the tokenizer's own pattern cuts them. That is decided on bytes for ASCII and the letters U+00C0 to U+00FF; a
word (between ASCII white space) that holds anything else, an apostrophe or a special token's opening stays whole
and goes through the ``tokenizers`` library, once for as long as a bounded memo keeps it. The units' bytes are
looked up in a table of fixed size in which each unit has one slot and a later one takes an earlier one's place;
units that aren't there are merged, all at once, by the ranks of the file's merges. Nothing is approximate: a slot
holds the whole unit and is compared with it.

Files with other rules than these (normal form C, white space, lower case; the pattern ``_PATTERN``; merges of
bytes with an end-of-word mark) work too: every word then goes through the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER, _WHOLE = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _OTHER
_KIND[list(b" \t\n\r\x0b\x0c")] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Units of more bytes aren't kept in the table.
_LONGEST = 24
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SLOT_BITS = 20
_MOST_IDS = 1 << 23
_UNITS_AT_ONCE = 32_768
_STRETCH = 1 << 20
_LOADED: dict[str, "WordTokenizer"] = {}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i]`` to ``starts[i] + sizes[i] - 1`` of all i, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Merges:
    """Byte-pair merges of many units at once: in each round every unit's pair of least rank is merged."""

    def __init__(self, vocab: dict[str, int], merges: list):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.first = np.array([vocab[names[b]] for b in range(256)])
        self.final = np.array([vocab[names[b] + "</w>"] for b in range(256)])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made: dict[str, int] = {}
        for k, (a, b) in enumerate(pairs):
            made.setdefault(a + b, k)
        if any(made.get(x, -1) >= k for k, pair in enumerate(pairs) for x in pair):
            raise ValueError("a merge comes before those of its parts")
        self.none = len(pairs)
        self.made = np.array([*(vocab[a + b] for a, b in pairs), 0])
        keys = np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], np.uint64)
        self.keys = np.append(keys, np.uint64(1 << 63))
        # two tables of slots; multipliers are drawn until no pair is left over
        rng, left = np.random.default_rng(1), np.arange(1)
        while len(left):
            left, self.tables = np.arange(len(keys)), []
            for bits in (20, 18):
                multiplier = np.uint64(rng.integers(0, 1 << 62) * 2 + 1)
                table = np.full(1 << bits, self.none, np.int32)
                slot = keys[left] * multiplier >> np.uint64(64 - bits)
                table[slot] = left
                left = left[table[slot] != left]
                self.tables.append((multiplier, np.uint64(64 - bits), table))

    def _rank(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = (one << 24 | two).astype(np.uint64)
        (m, shift, table), (m2, shift2, table2) = self.tables
        rank = table[key * m >> shift]
        missed = np.flatnonzero(self.keys[rank] != key)
        key = key[missed]
        again = table2[key * m2 >> shift2]
        again[self.keys[again] != key] = self.none
        rank[missed] = again
        return rank

    def ids(self, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units (``sizes[i]`` bytes of ``data`` from ``at[i]``) one after another, and their number for each."""
        unit, count, ends = np.arange(len(at)), sizes, np.cumsum(sizes)
        chars = data[_spread(at, sizes)]
        symbols = self.first[chars]
        symbols[ends - 1] = self.final[chars[ends - 1]]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        while len(unit):
            ends = np.cumsum(count)
            starts = ends - count
            rank = np.full(len(symbols), self.none, np.int32)
            rank[:-1] = self._rank(symbols[:-1], symbols[1:])
            rank[ends - 1] = self.none
            least = np.minimum.reduceat(rank, starts)
            over = least == self.none
            hit = np.flatnonzero(rank == np.repeat(np.where(over, -1, least), count))
            if len(hit) > 1:  # of equal pairs that overlap each other every second one counts, from the left
                opens = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
                runs = np.flatnonzero(opens)
                hit = hit[(np.arange(len(hit)) - np.repeat(runs, np.diff(np.append(runs, len(hit))))) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            ready = np.repeat(over, count)
            if over.any():
                done.append((unit[over], count[over], symbols[ready]))
            count = count - np.add.reduceat(gone, starts)
            symbols, unit, count = symbols[~gone & ~ready], unit[~over], count[~over]
        unit, count, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(unit)
        return ids[_spread((np.cumsum(count) - count)[order], count[order])], count[order]


class WordTokenizer:
    """A ``tokenizers`` file whose rules drop white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.kind = np.dtype("<u2" if self.own.get_vocab_size() <= 65536 else "<u4")
        one, two = (self.own.encode(x, add_special_tokens=False).ids for x in "ab")
        if self.own.encode("a b", add_special_tokens=False).ids != one + two:
            raise ValueError("this tokenizer doesn't drop white space")
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.merges = Merges(rules["model"]["vocab"], rules["model"]["merges"]) if self._cuts_units(rules) else None
        self.memo: dict[bytes, bytes] = {}
        self.most_words = 200_000  # in the memo
        self.forget()

    @staticmethod
    def _cuts_units(rules: dict) -> bool:
        """True for the rules that ``_units`` follows."""
        cut, rest, model = (rules.get("pre_tokenizer") or {}).get("pretokenizers", []), (rules.get("normalizer") or {}).get("normalizers", []), rules["model"]
        return (
            [n["type"] for n in rest] == ["NFC", "Replace", "Lowercase"]
            and rest[1]["content"] == " " and rest[1]["pattern"] == {"Regex": r"\s+"}
            and [c["type"] for c in cut] == ["Split", "ByteLevel"]
            and cut[0]["pattern"] == {"Regex": _PATTERN} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
            and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
            and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and all(t["content"][:2] == "<|" for t in rules["added_tokens"])
        )

    def forget(self) -> None:
        """Empties the table."""
        self.slots = np.zeros((3, 1 << _SLOT_BITS), np.uint64)
        self.where, self.count = np.zeros(1 << _SLOT_BITS, np.int32), np.zeros(1 << _SLOT_BITS, np.uint8)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where ``ids`` lie in the pool, which they are put into."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), self.kind)])
        self.pool[at : self.used] = ids
        return at

    def _units(self, data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, unit starts, unit sizes, whether a unit is a whole word); texts begin at ``firsts``."""
        n = len(data)
        kind, low = _KIND[data], _LOWER[data]
        if self.merges is None:
            kind[kind != _SPACE] = _OTHER
        else:
            lead = np.flatnonzero(data[:-1] == 0xC3)
            second = data[lead + 1]
            letter = (second >= 0x80) & (second != 0x97) & (second != 0xB7)  # all but the signs for times and divided by
            lead, second = lead[letter], second[letter]
            kind[lead] = kind[lead + 1] = _LETTER
            low[lead + 1] = np.where(second < 0x9F, second + 0x20, second)
        begins = np.zeros(n, bool)
        begins[firsts[firsts < n]] = True
        odd = np.union1d(np.flatnonzero(kind == _OTHER), np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)))
        if len(odd):
            space = kind == _SPACE
            edge = begins.copy()
            edge[:1] = True
            edge[1:] |= space[1:] != space[:-1]
            at = np.flatnonzero(edge)
            word = np.unique(np.searchsorted(at, odd, "right") - 1)
            inside = _spread(at[word], np.append(at[1:], n)[word] - at[word])
            kind[inside] = _WHOLE
            low[inside] = data[inside]
        edge = begins | (kind == _DIGIT)
        edge[:1] = True
        edge[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(edge)
        shown = kind[at] != _SPACE
        return low, at[shown], np.diff(np.append(at, n))[shown], kind[at[shown]] == _WHOLE

    def _merge(self, low: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of units lie in the pool, and their number."""
        counts, first = [np.zeros(0, np.int64)], self.used
        for k in range(0, len(at), _UNITS_AT_ONCE):
            ids, count = self.merges.ids(low, at[k : k + _UNITS_AT_ONCE], sizes[k : k + _UNITS_AT_ONCE])
            self._keep(ids.astype(self.kind))
            counts.append(count)
        count = np.concatenate(counts)
        return first + np.cumsum(count) - count, count

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``_merge`` for whole words, by the library."""
        if len(self.memo) > self.most_words:
            self.memo.clear()
        lacking = [w.decode() for w in dict.fromkeys(words) if w not in self.memo]
        for k in range(0, len(lacking), 128):
            line = lacking[k : k + 128]
            e = self.own.encode(" ".join(line), add_special_tokens=False)
            cuts = np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), np.cumsum([len(w) + 1 for w in line])) * self.kind.itemsize
            raw, start = np.array(e.ids, self.kind).tobytes(), 0
            for w, end in zip(line, cuts.tolist()):
                self.memo[w.encode()] = raw[start:end]
                start = end
        found = [self.memo[w] for w in words]
        count = np.array(list(map(len, found)), np.int64) // self.kind.itemsize
        return self._keep(np.frombuffer(b"".join(found), self.kind)) + np.cumsum(count) - count, count

    def _places(self, low: np.ndarray, at: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each unit lie in the pool, and their number."""
        wide = np.concatenate([low, np.zeros(_LONGEST + 8, np.uint8)])
        words = np.ndarray(len(low) + _LONGEST, np.dtype("<u8"), wide.data, strides=(1,))
        # bytes 0 is in no unit but whole words, so a unit's bytes, filled up with 0, tell its length too
        keys = [words[at + 8 * j] & _MASKS[np.clip(sizes - 8 * j, 0, 8)] for j in range(3)]
        h = keys[0] * _MIX[0]
        for key, mix in zip(keys[1:], _MIX[1:]):
            h ^= h >> np.uint64(29)
            h += key
            h *= mix
        h ^= h >> np.uint64(32)
        slot = (h * _MIX[0] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        where, count = self.where[slot].astype(np.int64), self.count[slot].astype(np.int64)
        usual = (sizes <= _LONGEST) & ~whole
        known = usual.copy()
        for held, key in zip(self.slots, keys):
            known &= held[slot] == key
        new = np.flatnonzero(usual & ~known)
        if len(new):
            order = new[np.lexsort([key[new] for key in keys])]
            differs = np.zeros(len(order), bool)
            differs[0] = True
            for key in keys:
                differs[1:] |= key[order[1:]] != key[order[:-1]]
            group, once = np.cumsum(differs) - 1, order[differs]
            w, c = self._merge(low, at[once], sizes[once])
            where[order], count[order] = w[group], c[group]
            for held, key in zip(self.slots, keys):
                held[slot[once]] = key[once]
            self.where[slot[once]], self.count[slot[once]] = w, c
        long = np.flatnonzero((sizes > _LONGEST) & ~whole)
        where[long], count[long] = self._merge(low, at[long], sizes[long])
        if whole.any():
            own = np.flatnonzero(whole)
            raw = low.tobytes()
            where[own], count[own] = self._whole([raw[a : a + n] for a, n in zip(at[own].tolist(), sizes[own].tolist())])
        return where, count

    @staticmethod
    def _stretches(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of about ``_STRETCH`` bytes that begin with a text or after white space."""
        start = 0
        while start < len(data):
            stop = start + _STRETCH
            if stop >= len(data):
                stop = len(data)
            else:
                text = int(ends[np.searchsorted(ends, stop, "right") - 1])
                while text <= start and stop < len(data) and _KIND[data[stop - 1]] != _SPACE:
                    gap = np.flatnonzero(_KIND[data[stop : stop + _STRETCH]] == _SPACE)
                    stop = min(len(data), stop + (int(gap[0]) + 1 if len(gap) else _STRETCH))
                stop = text if text > start else min(stop, int(ends[np.searchsorted(ends, start, "right")]))
            yield start, stop
            start = stop

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has); every text is followed by the id ``end``."""
        if self.used > _MOST_IDS:
            self.forget()
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw if raw is not None else b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        found = [(np.zeros(0, np.int64),) * 3]
        for start, stop in self._stretches(data, ends):
            firsts = ends[np.searchsorted(ends, start) : np.searchsorted(ends, stop)]
            low, at, sizes, whole = self._units(data[start:stop], firsts - start)
            found.append((at + start, *self._places(low, at, sizes, whole)))
        at, where, count = (np.concatenate(x) for x in zip(*found))
        # the end of a text is one more unit
        before = np.searchsorted(at, ends[1:])
        where, count = np.insert(where, before, self._keep(np.array([end], self.kind))), np.insert(count, before, 1)
        upto = np.append(0, np.cumsum(count))
        ids = [self.pool[_spread(where[k : k + _STRETCH], count[k : k + _STRETCH])] for k in range(0, len(where), _STRETCH)]
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.diff(upto[np.append(0, before + 1 + np.arange(len(before)))])


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, built once in each process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
