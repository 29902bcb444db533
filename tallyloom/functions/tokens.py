"""Tokenizer of organisation names as Column expressions; nothing leaves the JVM.

A token is a struct (pos int, token string, type tinyint, is_number boolean), in an array in text order.
Null texts count as empty. The classes below stand for what Python's ``re`` calls space, digit and word
character, which Java's own classes match for some code points only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, NUMBER, SPACE, PUNCT, PAD = range(5)
MAX_TOKENS = 70
MAX_CHARS = 20
#: Special ids: 0 pads, 1 unknown, 2 to 13 these, then the numbers 0 to 1000.
MARKS = " -/&,.()'\"#:"
#: Character ids: 0 pads, 1 unknown, then these in order.
CHARACTERS = string.ascii_lowercase + string.digits + MARKS
NUMBERS = 1000

_WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# the first look ahead spares all places but gaps the look behind
_LONE_GAP = rf"(?=[{_WS}])(?<=(?<![A-Za-z])[A-Za-z])[{_WS}]++(?=[A-Za-z](?![A-Za-z]))"
_WORDS = r"[a-z](?:\.[a-z])+\.?|[a-z]+|\p{Nd}+"
_NO_WORD = r"[^a-z\p{Nd}]"
_SCAN = rf"{_WORDS}|[{_WS}]+|\.(?=[^{_WS}])|[^{_WS}\p{{L}}\p{{N}}_.]"


def merge_spaced_letters(text: Column | str) -> Column:
    """Letters that stand alone, apart by white space, put together: ``A F G E`` becomes ``AFGE``."""
    return F.regexp_replace(text, _LONE_GAP, "")


def _typed(raw: Column, place: Column) -> Column:
    """The token of one match of the scan. Comparisons by code points decide on ASCII, expressions on the rest."""

    def token(text: Column, kind: int) -> Column:
        return F.struct(place.alias("pos"), text.alias("token"), F.lit(kind).cast("tinyint").alias("type"), F.lit(kind == NUMBER).alias("is_number"))

    number = F.coalesce(F.nullif(F.ltrim(raw, F.lit("0")), F.lit("")), F.lit("0"))
    return (
        F.when((raw >= "a") & (raw < "{"), token(F.replace(raw, F.lit("."), F.lit("")), WORD))
        .when(raw == " ", token(raw, SPACE))
        .when((raw >= "0") & (raw < ":"), token(number, NUMBER))
        .when((raw >= "!") & (raw < "\x7f"), token(raw, PUNCT))
        .when(raw.rlike(r"^\p{Nd}"), token(number, NUMBER))
        .when(raw.rlike(rf"^[{_WS}]"), token(F.lit(" "), SPACE))
        .otherwise(token(raw, PUNCT))
    )


def _scanned(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(merge_spaced_letters(F.coalesce(text, F.lit(""))))


def tokens(text: Column | str, max_tokens: int | None = MAX_TOKENS) -> Column:
    """Tokens of a text, the first ``max_tokens`` of them (all if None)."""
    raw = F.regexp_extract_all(_scanned(text), F.lit(_SCAN), F.lit(0))
    if max_tokens is not None:
        raw = F.slice(raw, 1, max_tokens)
    return F.transform(raw, _typed)


def words(text: Column | str) -> Column:
    """Words and numbers of a whole text as ``tokens`` has them, in text order, spaces between and behind them; no array is made."""
    found = F.regexp_replace(_scanned(text), rf"{_NO_WORD}*+({_WORDS})|{_NO_WORD}++", "$1 ")
    return F.regexp_replace(F.replace(found, F.lit("."), F.lit("")), r"(?=0)(?<![^ ])0+(?=\p{Nd})", "")


def last_number(words: Column | str) -> Column:
    """The last number among ``words``, empty without one."""
    return F.substring_index(F.rtrim(words, F.lit(" " + string.ascii_lowercase)), " ", -1)


def padded(token_array: Column | str, max_tokens: int = MAX_TOKENS) -> Column:
    """Tokens filled up to ``max_tokens`` with empty ones of type ``PAD``, as a fixed-shape model wants them."""
    token_array = F.col(token_array) if isinstance(token_array, str) else token_array
    missing = F.sequence(F.size(token_array), F.lit(max_tokens - 1))
    pads = F.transform(missing, lambda i: F.struct(i.cast("int").alias("pos"), F.lit("").alias("token"), F.lit(PAD).cast("tinyint").alias("type"), F.lit(False).alias("is_number")))
    return F.when(F.size(token_array) < max_tokens, F.concat(token_array, pads)).otherwise(F.slice(token_array, 1, max_tokens))


def token_mask(token_array: Column | str) -> Column:
    """1 for every token that is no pad, else 0."""
    return F.transform(token_array, lambda t: (t["type"] != PAD).cast("int"))


def explode_tokens(df: DataFrame, text_col: str, *keep: str, max_tokens: int | None = MAX_TOKENS) -> DataFrame:
    """One row for each token: ``keep``, pos, token, type, is_number."""
    return df.select(*keep, F.inline(tokens(text_col, max_tokens)))


def type_counts(df: DataFrame, text_col: str, *keys: str, max_tokens: int | None = MAX_TOKENS) -> DataFrame:
    """(keys, type, n, n_chars, last, largest): tokens counted by type, their characters, the last place and the largest token.

    Each row's tokens are counted within the row; what is sorted and shuffled is a row for each type, not for each token.
    """

    def of_type(kind: int) -> Column:
        return F.filter("_t", lambda t: t["type"] == F.lit(kind).cast("tinyint"))

    def counts(own: Column, kind: Column) -> Column:
        n_chars = F.aggregate(own, F.lit(0).cast("long"), lambda s, t: s + F.length(t["token"]))
        largest = F.array_max(F.transform(own, lambda t: t["token"]))
        return F.struct(kind.alias("type"), F.size(own).cast("long").alias("n"), n_chars.alias("n_chars"), F.get(own, F.size(own) - 1)["pos"].alias("last"), largest.alias("largest"))

    parts = F.transform(F.array(*map(of_type, (WORD, NUMBER, SPACE, PUNCT))), counts)
    rows = df.select(*keys, tokens(text_col, max_tokens).alias("_t")).select(*keys, F.inline(F.filter(parts, lambda c: c["n"] > 0)))
    return rows.groupBy(*keys, "type").agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars"), F.max("last").alias("last"), F.max("largest").alias("largest"))


def char_ids(token: Column | str, max_chars: int = MAX_CHARS) -> Column:
    """Ids of the first ``max_chars`` lower-case characters, filled up with 0."""
    token = F.col(token) if isinstance(token, str) else token
    chars = F.filter(F.split(F.substring(F.lower(token), 1, max_chars), ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.instr(F.lit(CHARACTERS), c) + 1)
    return F.concat(ids, F.array_repeat(F.lit(0), max_chars - F.size(ids)))


def special_id(token: Column | str) -> Column:
    """Id of a mark or of a number up to 1000; 1 for any other token, the empty one too."""
    token = F.col(token) if isinstance(token, str) else token
    number = F.try_to_number(token, F.lit("9999")).cast("int")
    return (
        F.when(token.rlike("^(0|[1-9][0-9]{0,3})$") & (number <= NUMBERS), number + 2 + len(MARKS))
        .when(F.length(token) == 1, F.instr(F.lit(MARKS), token) + F.lit(1))
        .otherwise(1)
    )


def special_ids(token_array: Column | str) -> Column:
    """``special_id`` of every token but words, which get 0; pads hold the empty token and get 1."""
    return F.transform(token_array, lambda t: F.when(t["type"] == WORD, F.lit(0)).otherwise(special_id(t["token"])))


def designation_label(token_array: Column | str, number: Column | str) -> Column:
    """Place (from 1) of the last token that equals ``number``; 0 without one."""
    number = F.col(number) if isinstance(number, str) else number
    places = F.transform(token_array, lambda t, i: F.when(t["token"] == number, i + 1).otherwise(0))
    return F.when(F.coalesce(number, F.lit("")) == "", 0).otherwise(F.coalesce(F.array_max(places), F.lit(0)))


def designation_decode(token_array: Column | str, place: Column | str) -> Column:
    """The number at ``place`` (from 1); empty for place 0, for a place beyond the tokens and for other tokens."""
    place = F.col(place) if isinstance(place, str) else place
    token_array = F.col(token_array) if isinstance(token_array, str) else token_array
    token = F.get(token_array, place - 1)["token"]
    return F.when((place > 0) & token.rlike(r"^\p{Nd}"), token).otherwise("")


def pointer(token_array: Column | str, score, null_score: float = 0.0) -> Column:
    """Place (from 1) of the number token with the best ``score(token, index)``; 0 if the null score isn't beaten.

    The null slot comes first and wins ties, then the earlier token does; only numbers may win.
    """
    scored = F.transform(token_array, lambda t, i: F.when(t["is_number"], F.struct(score(t, i).cast("double").alias("score"), (-(i + 1)).alias("back"))))
    slots = F.concat(F.array(F.struct(F.lit(float(null_score)).alias("score"), F.lit(0).alias("back"))), F.filter(scored, lambda s: s.isNotNull()))
    return -F.array_max(slots)["back"]
