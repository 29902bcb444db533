"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Found and validated are: card numbers (Luhn), international account numbers (mod 97), social security
numbers (ranges), telephone numbers, IPv4 addresses (octets), calendar dates (they must exist) and mail
addresses. The digits of a value, without its punctuation, are permuted within the set of values of the
same kind and length; check digits are computed anew, separators stay where they are. Dates are permuted
as day numbers within ``DATE_RANGE``. A permutation under one key maps equal values to equal pseudonyms
in every document, and different values to different ones, so records stay linked and nothing has to be
looked up in a table. Where a permutation would leave its set, it is repeated until it is in the set
again (cycle walking).

A telephone number is its country code, told from its digits alone, and the rest; one in North American writing without a
code has the code 1, and a trunk zero in brackets stays. So a number has one pseudonym in all its writings.

Defined results: a null text stays null, an empty one empty, a text without such values unchanged;
overlapping finds are taken leftmost, then in the order of ``KINDS``, valid ones only; texts are processed whole; equal rows
and rows of one id are changed alike, an empty table gives an empty one. Dates
outside ``DATE_RANGE`` stay, and so does 127.0.0.1, every machine's name for itself; any other address of
four octets without leading zeros is replaced by one of its class of first octets. Other columns pass unchanged; ``pii`` is replaced if the input has it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date")
DATE_RANGE = (dt.date(1900, 1, 1), dt.date(2100, 1, 1))
ROUNDS = 10
_MEMO = 100_000
#: First octets, from and to, of addresses that are permuted among themselves; all others are one class.
_IPV4_CLASSES = ((0, 1), (127, 128), (224, 240), (240, 256))
_LOOPBACK = 127 << 24 | 1

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])", re.ASCII)
#: All other kinds start with a digit, "+", "(" or two capitals with two digits.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])", re.ASCII)
_CARD = re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])", re.ASCII)
_SSN = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])", re.ASCII)
_PHONE = re.compile(
    r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)(?:[ .-]?[0-9]{2,4}){2,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
    re.ASCII,
)
_IPV4 = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", re.ASCII)
_DATE = re.compile(r"(?<![0-9A-Za-z./-])(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?![0-9A-Za-z]|[./-][0-9])", re.ASCII)
_PATTERNS = (_EMAIL, _IBAN, _CARD, _SSN, _PHONE, _IPV4, _DATE)
#: Country codes of one and two digits; all others have three.
_SHORT_CODES = {*"17"} | {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
_DIGIT_RUN = re.compile(r"[0-9][0-9 ().+-]{5}|[0-9][-/.][0-9]", re.ASCII)


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A permutation of ``range(size)``: an unbalanced Feistel network over two mixed-radix halves, walked along its cycle."""
    if size < 2:
        return value
    low = max(2, int(size**0.5))
    high = -(-size // low)

    def mix(i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{i}|{half}".encode(), key=key, digest_size=16).digest(), "big")

    while True:
        a, b = divmod(value, low)
        for i in range(0, ROUNDS, 2):
            a = (a + mix(i, b)) % high
            b = (b + mix(i + 1, a)) % low
        value = a * low + b
        if value < size:
            return value


def _digits(digits: str, key: bytes, tweak: str) -> str:
    """Digits permuted among those of the same length."""
    return str(feistel(int(digits), 10 ** len(digits), key, tweak)).zfill(len(digits)) if digits else ""


def _letters(letters: str, key: bytes, tweak: str) -> str:
    value = 0
    for c in letters:
        value = value * 26 + ord(c) - 97
    value, out = feistel(value, 26 ** len(letters), key, tweak), []
    for _ in letters:
        value, c = divmod(value, 26)
        out.append(chr(97 + c))
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    """True if the last digit is the check digit of the others."""
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def iban_ok(compact: str) -> bool:
    """True if the number taken modulo 97, its first four characters last, is 1."""
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _ends(value: str, least: int) -> Iterator[str]:
    """``value`` and what is left of it as groups go from its end, down to ``least`` characters."""
    while len(value) >= least:
        yield value
        value = value[: max(value.rfind(" "), value.rfind("-"), 0)]


def _cuts(k: int, found: str) -> list[str]:
    """What may be the value at the start of a match of kind ``k``: numbers with checks or of known length may end sooner than the pattern."""
    if k in (1, 2):
        return list(_ends(found, 15 if k == 1 else 13))
    if k == 4 and found[:2] == "+1":
        return [v for v in _ends(found, 12) if sum(map(str.isdigit, v)) == 11][:1] or [found]
    return [found]


def _same_places(original: str, new: str) -> str:
    """``new`` character by character in the places of the letters and digits of ``original``."""
    given = iter(new)
    return "".join(next(given) if c.isalnum() else c for c in original)


class Pseudonyms:
    """Replacements of validated values under one key."""

    def __init__(self, key: bytes):
        if not key or len(key) > 64:
            raise ValueError("the key has 1 to 64 bytes")
        self.key = key
        self.known: dict[tuple[str, str], str | None] = {}

    def replace(self, kind: str, value: str) -> str | None:
        """The pseudonym of ``value``; None if it isn't valid for its kind."""
        at = (kind, value)
        if at not in self.known:
            if len(self.known) >= _MEMO:
                self.known.clear()
            self.known[at] = getattr(self, f"_{kind}")(value)
        return self.known[at]

    def _email(self, value: str) -> str:
        local, domain = value.rsplit("@", 1)
        letters = [c for c in local if c.isalpha()]
        digits = _digits("".join(c for c in local if c.isdigit()), self.key, f"email-digits:{domain.lower()}")
        changed = _letters("".join(letters).lower(), self.key, f"email:{domain.lower()}") if letters else ""
        a, b = iter(changed), iter(digits)
        return "".join((next(a).upper() if c.isupper() else next(a)) if c.isalpha() else next(b) if c.isdigit() else c for c in local) + "@" + domain

    def _iban(self, value: str) -> str | None:
        compact = value.replace(" ", "")
        if not iban_ok(compact):
            return None
        body = compact[4:]
        digits = iter(_digits("".join(c for c in body if c.isdigit()), self.key, f"iban:{compact[:2]}:{len(compact)}"))
        letters = iter(_letters("".join(c for c in body if c.isalpha()).lower(), self.key, f"iban-letters:{compact[:2]}").upper())
        body = "".join(next(digits) if c.isdigit() else next(letters) for c in body)
        check = 98 - int("".join(str(int(c, 36)) for c in body + compact[:2] + "00")) % 97
        return _same_places(value, compact[:2] + f"{check:02d}" + body)

    def _card(self, value: str) -> str | None:
        digits = re.sub("[ -]", "", value)
        if not luhn(digits) or not digits.strip("0"):
            return None
        body = digits[0] + _digits(digits[1:-1], self.key, f"card:{digits[0]}")
        return _same_places(value, next(body + str(d) for d in range(10) if luhn(body + str(d))))

    def _ssn(self, value: str) -> str | None:
        def valid(n: int) -> bool:
            area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        number = int(value.replace("-", ""))
        if not valid(number):
            return None
        while not valid(number := feistel(number, 10**9, self.key, "ssn")):
            pass
        return _same_places(value, f"{number:09d}")

    def _phone(self, value: str) -> str | None:
        marked = value.replace("(0)", "(*)") if value[0] == "+" else value
        digits = re.sub("[^0-9]", "", marked)
        if not 7 <= len(digits) <= 15:
            return None
        code = "1" if value[0] != "+" else next((digits[:k] for k in (1, 2) if digits[:k] in _SHORT_CODES), digits[:3])
        head = code if value[0] == "+" else ""
        return _same_places(marked, head + _digits(digits[len(head) :], self.key, f"phone:{code}")).replace("(*)", "(0)")

    def _ipv4(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None

        def own(n: int) -> tuple[int, int]:
            return next((c for c in _IPV4_CLASSES if c[0] <= n >> 24 < c[1]), (0, 256))

        number = int.from_bytes(bytes(octets), "big")
        if number == _LOOPBACK:
            return None
        kind = low, high = own(number)
        tweak, start, size = "ipv4" if kind == (0, 256) else f"ipv4:{low}", low << 24, (high - low) << 24
        while True:
            number = start + feistel(number - start, size, self.key, tweak)
            if own(number) == kind and number != _LOOPBACK:
                return ".".join(map(str, number.to_bytes(4, "big")))

    def _date(self, value: str) -> str | None:
        m = _DATE.fullmatch(value)
        year_first = m.group(1) is not None
        a, b, c = (m.group(1), m.group(3), m.group(4)) if year_first else (m.group(5), m.group(7), m.group(8))
        mark = m.group(2) if year_first else m.group(6)
        # with the year last, a slash means month first, as in the United States, unless only the other order exists
        orders = [(a, b, c)] if year_first else [(c, a, b), (c, b, a)] if mark == "/" else [(c, b, a), (c, a, b)]
        for k, (y, month, day) in enumerate(orders):
            try:
                date = dt.date(int(y), int(month), int(day))
            except ValueError:
                continue
            if not DATE_RANGE[0] <= date < DATE_RANGE[1]:
                return None
            first = DATE_RANGE[0].toordinal()
            new = dt.date.fromordinal(first + feistel(date.toordinal() - first, DATE_RANGE[1].toordinal() - first, self.key, "date"))
            year, mon, d = f"{new.year:04d}", f"{new.month:0{len(month)}d}", f"{new.day:0{len(day)}d}"
            if year_first:
                return f"{year}{mark}{mon}{mark}{d}"
            month_first = (mark == "/") == (k == 0)
            return f"{mon}{mark}{d}{mark}{year}" if month_first else f"{d}{mark}{mon}{mark}{year}"
        return None

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of what was replaced, in the given text."""
        able = [k for k in range(len(KINDS)) if ("@" in text if k == 0 else True)]
        if not _DIGIT_RUN.search(text):
            able = [k for k in able if k == 0]
        ahead = {k: (-1, -1, "") for k in able}  # each kind's next valid find
        out, spans, end = [], [], 0
        while ahead:
            for k in [k for k, find in ahead.items() if find[0] < end]:
                find = self._next(k, text, end)
                if find is None:
                    del ahead[k]
                else:
                    ahead[k] = find
            if ahead:
                k = min(ahead, key=lambda k: (ahead[k][0], k))
                start, stop, new = ahead[k]
                out += [text[end:start], new]
                spans.append((KINDS[k], start, stop))
                end = stop
        return ("".join([*out, text[end:]]), spans) if spans else (text, spans)

    def _next(self, k: int, text: str, at: int) -> tuple[int, int, str] | None:
        """The first valid find of kind ``k`` from ``at`` on: start, end and pseudonym."""
        while (m := _PATTERNS[k].search(text, at)) is not None:
            for value in _cuts(k, m.group()):
                if (new := self.replace(KINDS[k], value)) is not None:
                    return m.start(), m.start() + len(value), new
            at = m.start() + 1
        return None


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Replaces personal data in ``text_col`` and adds ``pii``, an array of (kind, start, end) in the text given."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*(f for f in docs.schema if f.name != "pii"), T.StructField("pii", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(text_col).to_pylist():
                new, found = own.text(text) if text else (text, [])
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            kept = [n for n in batch.schema.names if n != "pii"]
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in kept), pa.array(spans, kind)], [*kept, "pii"])

    return docs.mapInArrow(run, schema)
