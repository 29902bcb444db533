import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import tokens as K

CASES = {
    "I.B.E.W.": "ibew", "IBEW": "ibew", "I.A.M.": "iam", "I.A.T.S.E.": "iatse", "I.U.O.E.": "iuoe", "I.U.P.A.T.": "iupat",
    "I.B.E.W. Local 134": "ibew| |local| |134", "U.S. Steel": "us| |steel", "A F G E - 2138": "afge| |-| |2138", "A T U - 425": "atu| |-| |425",
    "Local A F G E 123": "local| |afge| |123", "A W - 100": "aw| |-| |100", "I am here": "i| |am| |here", "Local No. 123": "local| |no| |123",
    "Local No.123": "local| |no|.|123", "Intl. Brotherhood": "intl| |brotherhood", "Int. Union": "int| |union", "AFSCME 140.11": "afscme| |140|.|11",
    "Council 25 1640.12": "council| |25| |1640|.|12", "IBEW-622": "ibew|-|622", "IBEW    Local   123": "ibew| |local| |123", "  IBEW  ": " |ibew| ",
    "I.A.M. & A.W.": "iam| |&| |aw", "SEIU (Local 0099)": "seiu| |(|local| |99|)", "J.Smith": "js|mith", "I.B.E.W.Local 3": "ibewl|ocal| |3",
    "I.B.E W": "ibe|w", "32BJ": "32|bj", "1A B": "1|ab", "Driver's A B": "driver|'|sab", "José": "jos", "x_y": "x|y", "a.. b": "a|.| |b",
    "end.": "end", "0099": "99", "000": "0", "": "", "a b": "ab", "K9": "k|9",
}


def scanned(text: str) -> list[str]:
    """The same tokens by a hand-written scanner over characters."""

    def letter(c: str) -> bool:
        return c.isascii() and c.isalpha()

    merged, i = [], 0
    while i < len(text):
        merged.append(text[i])
        lone = letter(text[i]) and not (i and letter(text[i - 1]))
        j = i + 1
        while j < len(text) and text[j].isspace():
            j += 1
        if lone and i + 1 < j < len(text) and letter(text[j]) and not (j + 1 < len(text) and letter(text[j + 1])):
            i = j
            continue
        i += 1
    s, out, i = "".join(merged).lower(), [], 0
    while i < len(s):
        c, j = s[i], i + 1
        if letter(c):
            while j + 1 < len(s) and s[j] == "." and letter(s[j + 1]):
                j += 2
            if j > i + 1:
                out.append(s[i:j].replace(".", ""))
                j += j < len(s) and s[j] == "."
            else:
                while j < len(s) and letter(s[j]):
                    j += 1
                out.append(s[i:j])
        elif unicodedata.category(c) == "Nd":
            while j < len(s) and unicodedata.category(s[j]) == "Nd":
                j += 1
            out.append(s[i:j].lstrip("0") or "0")
        elif c.isspace():
            while j < len(s) and s[j].isspace():
                j += 1
            out.append(" ")
        elif c == ".":
            if j < len(s) and not s[j].isspace():
                out.append(".")
        elif c != "_" and unicodedata.category(c)[0] not in "LN":
            out.append(c)
        i = j
    return out


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.k for r in rows.select("i", F.transform(K.tokens("t", None), lambda t: t["token"]).alias("k")).orderBy("i").collect()]


def test_vectors(spark):
    assert dict(zip(CASES, ("|".join(k) for k in found(spark, list(CASES))))) == CASES


def test_null_counts_as_empty(spark):
    assert found(spark, [None]) == [[]]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB .I\t-1'0é_&(  ٣x\n", max_size=14), min_size=40, max_size=80))
def test_against_scanner(spark, texts):
    assert found(spark, texts) == [scanned(t) for t in texts]


def test_types_truncation_and_pads(spark):
    row = spark.range(1).select(K.tokens(F.lit("SEIU 12 - x y z 5"), 4).alias("t")).select("t", K.padded("t", 6).alias("p"), K.token_mask(K.padded("t", 6)).alias("m"), K.special_ids(K.padded("t", 6)).alias("s")).head()
    assert [(t.pos, t.token, t.type, t.is_number) for t in row.t] == [(0, "seiu", 0, False), (1, " ", 2, False), (2, "12", 1, True), (3, " ", 2, False)]
    assert [t.type for t in row.p] == [0, 2, 1, 2, 4, 4] and row.m == [1, 1, 1, 1, 0, 0] and row.s == [0, 2, 26, 2, 1, 1]


@pytest.mark.parametrize("token, want", [("0", 14), ("1000", 1014), ("1001", 1), (" ", 2), (":", 13), ("", 1), ("%", 1), ("seiu", 1), ("٣", 1)])
def test_special_id(spark, token, want):
    assert spark.range(1).select(K.special_id(F.lit(token))).head()[0] == want


def test_char_ids(spark):
    assert spark.range(1).select(K.char_ids(F.lit("Az9 é:"), 8)).head()[0] == [2, 27, 37, 38, 1, 49, 0, 0]


def test_label_and_decode(spark):
    rows = spark.createDataFrame([("7 or 7", "7"), ("x", "7"), ("7", ""), ("7", None)], "t string, d string")
    assert [r[0] for r in rows.select(K.designation_label(K.tokens("t"), "d")).collect()] == [5, 0, 0, 0]
    row = spark.range(1).select(*(K.designation_decode(K.tokens(F.lit("a 5")), F.lit(p)) for p in (0, 1, 3, 9))).head()
    assert list(row) == ["", "", "5", ""]


def test_pointer_ties_go_to_the_null_slot_then_to_the_first(spark):
    t = K.tokens(F.lit("a 5 6"))
    same = spark.range(1).select(K.pointer(t, lambda t, i: F.lit(0.0)), K.pointer(t, lambda t, i: F.lit(1.0)), K.pointer(K.tokens(F.lit("a")), lambda t, i: F.lit(9.0))).head()
    assert list(same) == [0, 3, 0]


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(K.tokens(F.lit("a")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_type_counts_shuffle_rows_of_types_not_tokens(spark):
    """Rows of equal keys meet, null ones too, after their tokens were counted; no token is a row of the plan."""
    texts = [(1, "b a 07 007, zz"), (1, "c. 12"), (2, None), (2, ""), (None, "é \u0663\u0664 \u2003x"), (3, "__ é")]
    rows = spark.createDataFrame(texts, "id int, text string")
    got = K.type_counts(rows, "text", "id", max_tokens=None)
    every = K.explode_tokens(rows, "text", "id", max_tokens=None)
    want = every.groupBy("id", F.col("type").cast("int").alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("token").cast("long")).alias("n_chars"), F.max("pos").alias("last"), F.max("token").alias("largest"))
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert (1, 1, 3, 4, 4, "7") in set(map(tuple, got.collect()))
    long = spark.range(0, 4, 1, 1).select("id", F.repeat(F.lit("word 5, "), 5000).alias("text"))
    counted = K.type_counts(long, "text", "id", max_tokens=None)
    assert counted.count() == 16
    generated = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "largest" in generated and "inline(filter(transform(" in generated


def test_words_of_whole_texts_are_those_of_the_tokens(spark):
    odd = ["", None, " . ", "é", "007 000 0", "0\u0663 00\u0660 x", "a.b.cd 0x0 1.50", "A B\u2003C. D\x1c7 ", "local12 y_z Ünï 00 \U0001d7ce\U0001d7d7", "x" * 300 + "0" * 300, "no number.", "3 then words only, ü"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*odd, *CASES])], "id int, text string")
    spoken = F.filter(K.tokens("text", None), lambda t: t["type"] <= 1)
    numbers = F.filter(spoken, lambda t: t["is_number"])
    last = F.coalesce(F.get(numbers, F.size(numbers) - 1)["token"], F.lit(""))
    got = rows.select("id", K.words("text").alias("w"), F.transform(spoken, lambda t: t["token"]).alias("want"), last.alias("last")).withColumn("number", K.last_number("w")).orderBy("id").collect()
    assert [r.w.split() for r in got] == [r.want for r in got]
    assert [r.number for r in got] == [r["last"] for r in got] and len({r.number for r in got}) > 5


def test_whole_texts_are_read_without_token_arrays(spark):
    """The same records and models as by tokens, from a plan without them."""
    from tallyloom.plans.extractor import CentroidModel, Extractor, encode_whole, fit, fit_vectors

    rows = spark.createDataFrame([(k, f"Local {k} A F G E. ok{'é' * (k % 2)} {'word 00' * k}", "ab"[k % 2]) for k in range(12)] + [(12, None, "a"), (13, "...", "b")], "id int, text string, aff_abbr string")
    model, limited = fit(rows, max_tokens=None), fit(rows, max_tokens=10_000)
    assert model.affiliations == limited.affiliations == ["a", "b"]
    assert model.union_centroid == pytest.approx(limited.union_centroid) and model.affiliation_centroids[1] == pytest.approx(limited.affiliation_centroids[1])
    whole = Extractor(model, 0.1, 0.1, max_tokens=None).transform(rows)
    assert "regexp_extract_all" not in whole._jdf.queryExecution().optimizedPlan().toString()
    want = Extractor(model, 0.1, 0.1, max_tokens=10_000).transform(rows)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, want.collect()))
    encoded = encode_whole(rows, "text", model.encoder, "v", "number")
    once = Extractor(fit_vectors(encoded, "aff_abbr", "v"), 0.1, 0.1).transform_encoded(encoded, "v", "number").drop("v", "number", "aff_abbr")
    plain = lambda df: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert plain(once) == plain(want.drop("text", "aff_abbr"))
    first = CentroidModel(model.union_centroid, model.affiliations, model.affiliation_centroids, number_score=lambda t, i: -i + 100_000)
    assert not first.needs_words_only
    assert Extractor(first, 0.1, 0.1, max_tokens=None).transform(rows).where("id = 11").head().designation == "11"
