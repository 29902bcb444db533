import csv
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import CentroidModel, Extractor, build_lookup, cli, fit, lookup, lookup_one
from tallyloom.functions import records as R
from tallyloom.operators import centroids as C
from tallyloom.operators import encoders as E
from tallyloom.operators import evaluate, sampling
from tallyloom.plans.predict import FIELDS
from tallyloom.sources import tables as S


def one(spark, *columns):
    return list(spark.range(1).select(*columns).head())


def test_gate_keeps_nan_and_null_out(spark):
    s = spark.createDataFrame([(0.5,), (0.499,), (float("nan"),), (None,)], "s double")
    assert [r[0] for r in s.select(R.passes("s", 0.5)).collect()] == [True, False, False, False]


def test_formats(spark):
    lists = [F.array().cast("array<bigint>"), F.array(F.lit(5)), F.array(F.lit(1), F.lit(2)), F.lit(None).cast("array<bigint>")]
    assert one(spark, *(R.format_list(x) for x in lists)) == ["", "5", "[1, 2]", ""]
    assert one(spark, *(R.format_multiple(x) for x in lists)) == ["", "False", "True", ""]
    assert one(spark, R.format_score(F.lit(0.99925)), R.format_score(F.lit(float("nan"))), R.format_bool(F.lit(True))) == ["0.9992", "nan", "True"]


def test_numbers_for_comparison(spark):
    assert one(spark, *(R.true_number(F.lit(x).cast("string")) for x in ("0012.0", "0", None, "7"))) == ["12", "", "", "7"]
    assert one(spark, *(R.predicted_number(F.lit(x).cast("string")) for x in ("012", "0", None))) == ["12", "", ""]


def test_not_in_keeps_null(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r.x for r in rows.where(R.not_in("x", ["a"])).collect()] == ["b", None]


def stub(spark_column):
    """Vectors that a text spells out: ``x,y`` in hundredths."""
    digits = F.transform(F.filter(spark_column, lambda t: t["is_number"]), lambda t: t["token"].cast("double") / 100)
    return F.when(F.size(digits) >= 2, F.slice(digits, 1, 2)).otherwise(F.array(F.lit(float("nan")), F.lit(0.0)))


@pytest.fixture(scope="module")
def model():
    return CentroidModel([1.0, 0.0], ["AA", "BB"], [[1.0, 0.0], [0.0, 1.0]], encoder=stub)


def test_thresholds_are_inclusive(spark, model):
    texts = ["50 80", "49 90", "50 79", "é", "", "80 80"]
    got = Extractor(model).extract_batch(spark, texts)
    assert [r["is_union"] for r in got] == [True, False, True, False, False, True]
    assert [r["affiliation"] for r in got] == ["BB", None, None, None, None, "AA"]  # equal scores: the first class
    assert [r["affiliation_unrecognized"] for r in got] == [False, False, True, False, False, False]
    assert got[2]["aff_score"] == 0.79 and got[1]["aff_score"] is None and math.isnan(got[3]["union_score"])
    assert got[0]["designation"] == "80" and got[1]["designation"] is None


def test_rows_pass_through_with_repeats_nulls_and_clashes(spark, model):
    rows = spark.createDataFrame([("50 80", 1), ("50 80", 1), (None, 2)], "text string, designation int")
    out = Extractor(model).transform(rows)
    assert out.count() == 3 and out.columns.count("designation") == 1
    assert Extractor(model).transform(rows.limit(0)).count() == 0


def test_no_number_gives_an_empty_designation(spark):
    flat = CentroidModel([1.0], ["AA"], [[1.0]], encoder=lambda t: F.array(F.lit(1.0)))
    assert Extractor(flat).extract(spark, "just words")["designation"] == ""


def test_fit_and_model_file(spark, tmp_path):
    rows = [("alpha beta", "AA")] * 5 + [("gamma delta", "BB")] * 5 + [("rare", "CC")] + [("zzz", "UNK")] * 6 + [("many", "MULTI")] * 6
    found = fit(spark.createDataFrame(rows, "text string, aff_abbr string"))
    assert found.affiliations == ["AA", "BB"]
    found.save(str(tmp_path / "m.json"))
    again = CentroidModel.load(str(tmp_path / "m.json"))
    assert again.affiliation_centroids == found.affiliation_centroids
    assert Extractor(again).extract(spark, "alpha beta 12")["affiliation"] == "AA"


def test_mean_vectors_by_hand(spark):
    rows = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 4.0]), ("b", None)], "k string, v array<double>")
    got = {r["class"]: (r.n, r.centroid) for r in C.mean_vectors(rows, "k", "v", rows.select("k"), dim=2).collect()}
    assert got["b"] == (0, [0.0, 0.0]) and got["a"][0] == 2 and np.allclose(got["a"][1], [0.6, 0.8])


def test_nearest_by_literals_equals_nearest_by_join(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(30)], "id int, v array<double>")
    named = spark.createDataFrame([(f"c{i}", [float(x) for x in rng.standard_normal(4)]) for i in range(7)], "class string, centroid array<double>")
    a = {r.id: (r.nearest, round(r.similarity, 9)) for r in C.nearest_centroid(vectors, "id", "v", named).collect()}
    monkeypatch.setattr(C, "LIMIT_LITERALS", 3)
    assert a == {r.id: (r.nearest, round(r.similarity, 9)) for r in C.nearest_centroid(vectors, "id", "v", named).collect()}


def test_lookup(spark):
    registry = spark.createDataFrame([("A", "1", 9), ("A", "1", 3), ("A", "1", 3), ("A", "01", 4), ("", "1", 5), (None, "1", 6), ("B", None, 7), ("B", "", 8), ("B", "2", None)], "aff_abbr string, desig_num string, f_num bigint")
    table = build_lookup(registry)
    assert {(r.aff, r.desig): r.fnums for r in table.collect()} == {("A", "1"): [3, 9], ("A", "01"): [4], ("B", ""): [8]}
    assert lookup_one(build_lookup(registry, normalise=True), "A", "1") == [3, 4, 9] and lookup_one(table, "Z", "1") == []
    asked = spark.createDataFrame([("A", "1"), ("A", "1"), ("B", ""), (None, None)], "affiliation string, designation string")
    for small in (10, 0):  # by broadcast and by shuffle
        assert sorted(r.fnums for r in lookup(asked, table, small_rows=small).collect()) == [[], [], [3, 9], [3, 9]]


def test_metric_identities(spark):
    rng = np.random.default_rng(2)
    pick = lambda names: [names[i] for i in rng.integers(0, len(names), 200)]
    rows = list(zip(pick(["A", "B", "U"]), pick(["1", "01", None, "2.0", "0"]), pick(["A", "B", None]), pick(["1", "", "2", None, "0"])))
    judged = evaluate.judged(spark.createDataFrame(rows, "true_aff string, true_desig string, pred_aff string, pred_desig string").withColumn("text", F.lit("x" * 99)), ["A", "B"])
    m = evaluate.metrics(judged).head()
    known = [r for r in rows if r[0] != "U"]
    norm = lambda d: (d or "").split(".")[0].lstrip("0")
    assert m.total == len(known) and m.has_desig_total + m.no_desig_total == m.total
    assert m.aff_correct == sum(r[0] == r[2] for r in known) and m.desig_correct == sum(norm(r[1]) == (r[3] or "").lstrip("0") for r in known)
    assert m.joint_correct <= min(m.aff_correct, m.desig_correct)
    assert evaluate.errors(judged).count() == m.total - m.joint_correct == sum(evaluate.error_breakdown(judged).head())
    empty = evaluate.metrics(judged.limit(0)).head()
    assert empty.total == 0 and empty.joint_accuracy == 0.0


def test_auc_and_youden_by_hand(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 20, 300).astype(float), rng.random(300) < 0.4
    rows = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    pos, neg = s[y], s[~y]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    assert abs(evaluate.roc_auc(rows, "s", "y").head().auc - auc) < 1e-12
    best = max((round((pos >= t).mean() - (neg >= t).mean(), 12), t) for t in set(s))
    assert evaluate.youden_threshold(rows, "s", "y").head().threshold == best[1]
    assert evaluate.roc_auc(rows.where("y"), "s", "y").head().auc is None


def test_split_and_sample_are_exact_and_repeatable(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") < 300, "a").when(F.col("id") == 301, "rare").otherwise("b").alias("k"))
    one_, two = (sampling.stratified_split(rows.repartition(n), "k", "id", 0.2, exclude=["b"]) for n in (1, 5))
    assert sorted(map(tuple, one_.collect())) == sorted(map(tuple, two.collect()))
    counts = {(r.k, r.split): r["count"] for r in one_.groupBy("k", "split").count().collect()}
    assert counts[("a", "test")] == math.floor(294 * 0.2 + 0.5) and counts[("rare", "train")] == 1 and counts[(None, "train")] == 10 and ("b", "test") not in counts
    assert sampling.sample_rows(rows, "id", 77).count() == 77 and sampling.sample_rows(rows, "id", 9999).count() == 500


def test_pooled_vectors_by_loops():
    w = E.random_bundle(1, hidden=4)
    rng = np.random.default_rng(4)
    chars = rng.integers(1, 50, (3, 6, 20))
    types = np.array([[0, 2, 1, 4, 4, 4], [0, 0, 0, 0, 0, 0], [4, 4, 4, 4, 4, 4]])
    numbers = (types == 1).astype(int)
    with np.errstate(invalid="ignore"):
        v, attention = E.pooled_vector(E.Weights(w, "union."), chars, types, numbers)
        shorter, _ = E.pooled_vector(E.Weights(w, "union."), chars[:1, :4], types[:1, :4], numbers[:1, :4])
    assert np.allclose(np.linalg.norm(v[:2], axis=1), 1) and np.isnan(v[2]).all() and np.allclose(attention[0, 3:], 0)
    assert np.allclose(v[0], shorter[0])  # pads don't matter to pooling
    p = E.Weights(w, "union.char_cnn.")
    x = p["char_embed.weight"][chars[0, 0]]
    pooled = []
    for k in (1, 2, 3):
        pad = np.pad(x, ((k > 1, k > 1), (0, 0)))
        pooled += [max(max(0.0, float((pad[i : i + k] * p[f"conv{k}.weight"][f].T).sum() + p[f"conv{k}.bias"][f])) for i in range(len(pad) - k + 1)) for f in range(len(p[f"conv{k}.bias"]))]
    h = np.array(pooled)
    g = 1 / (1 + np.exp(-(p["highway.gate.weight"] @ h + p["highway.gate.bias"])))
    h = g * np.maximum(p["highway.transform.weight"] @ h + p["highway.transform.bias"], 0) + (1 - g) * h
    assert np.allclose(E.character_cnn(p, chars[0, :1])[0], p["project.weight"] @ h + p["project.bias"])


def test_bundle_sizes_and_pointer():
    w = E.random_bundle(0, affiliations=5)
    size = lambda prefix: sum(a.size for n, a in w.items() if n.startswith(prefix))
    assert size("union.char_cnn.") == 124_928 and size("union.") == 163_640
    small = E.random_bundle(0, affiliations=2, hidden=4)
    types = np.array([[0, 2, 1, 1, 4, 4]])
    scores = E.pointer_scores(E.Weights(small, "pointer."), np.ones((1, 6, 20), int), types, (types == 1).astype(int), np.ones((1, 6), int), np.array([1]))
    assert scores.shape == (1, 7) and np.isfinite(scores[0, [0, 3, 4]]).all() and np.isneginf(scores[0, [1, 2, 5, 6]]).all()


def test_neural_stages_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Memory by the slice, not by the Arrow batch, and the same places as by whole-width inputs."""
    import tracemalloc

    seen = []
    monkeypatch.setattr(E, "attention", lambda w, query, keys, *rest, f=E.attention: seen.append(keys.shape[:2]) or f(w, query, keys, *rest))
    w = E.random_bundle(2, affiliations=2, hidden=4)
    rng = np.random.default_rng(5)
    types = np.full((6, 70), 4)
    for row, n in enumerate((3, 9, 1, 0, 5, 2)):
        types[row, :n] = rng.integers(0, 3, n)
    chars, numbers = rng.integers(0, 50, (6, 70, 20)) * (types != 4)[..., None], (types == 1).astype(int)
    specials = np.where(types == 4, 1, rng.integers(0, 1015, (6, 70)))
    scores = E.pointer_scores(E.Weights(w, "pointer."), chars, types, numbers, specials, np.zeros(6, int))
    assert scores.shape == (6, 71) and {s[1] for s in seen} == {10}
    odd = specials.copy()
    odd[:, 69] = 7  # unlike pads can't stand for one another
    E.pointer_scores(E.Weights(w, "pointer."), chars, types, numbers, odd, np.zeros(6, int))
    assert seen[-1][1] == 70
    v, a = E.pooled_vector(E.Weights(w, "union."), chars, types, numbers)
    assert a.shape == (6, 70) and np.allclose(a[1, 9:], 0) and np.isnan(a[3]).all() and np.isnan(v[3]).all()
    wide = types.copy()
    wide[4] = 0  # makes the others as wide as it is
    again = E.pointer_scores(E.Weights(w, "pointer."), chars, wide, numbers, specials, np.zeros(6, int))
    others = [0, 1, 2, 5]
    assert np.allclose(again[others], scores[others]) and np.allclose(E.pooled_vector(E.Weights(w, "union."), chars, wide, numbers)[0][others], v[others])

    assert [s.stop - s.start for s in E.slices(300)] == [128, 128, 44] and E.slices(0) == []
    ids = rng.integers(1, 50, (20_000, 20))
    tracemalloc.start()
    out = E.character_cnn(E.Weights(w, "union.char_cnn."), ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.shape == (20_000, 64) and peak < 200e6  # all words at once take over 1 GB
    bundle = E.NeuralBundle("", arrays=w)
    rows = spark.range(0, 300, 1, 1).select("id", F.transform(F.array(F.lit("local"), F.col("id").cast("string")), lambda x, i: F.struct(i.alias("pos"), x.alias("token"), i.cast("tinyint").alias("type"), (i == 1).alias("is_number"))).alias("t"))
    got = rows.select("id", bundle.vector("t", "union").alias("v"), bundle.place("t", F.lit(0)).alias("p")).orderBy("id").collect()
    alone = rows.where("id = 131").select(bundle.vector("t", "union").alias("v"), bundle.place("t", F.lit(0)).alias("p")).head()
    assert len(got) == 300 and np.allclose(got[131]["v"], alone["v"]) and got[131]["p"] == alone["p"]


def run_cli(tmp_path, capsys, spark, text, *args):
    path = tmp_path / "in.csv"
    path.write_text(text)
    model = tmp_path / "m.json"
    v = [1.0] + [0.0] * 63
    CentroidModel([0.125] * 64, ["AA"], [v]).save(str(model))
    code = cli.run([str(path), "--model", str(model), *args], spark=spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_cli_keeps_columns_and_order(spark, tmp_path, capsys):
    code, out, _ = run_cli(tmp_path, capsys, spark, 'id,name,extra\n1,"IBT, 123",x\n2,,\n3,"say ""hi""",z\n', "-c", "name")
    rows = list(csv.DictReader(io.StringIO(out)))
    assert code == 0 and [r["id"] for r in rows] == ["1", "2", "3"] and [r["name"] for r in rows] == ["IBT, 123", "", 'say "hi"']
    assert list(rows[0]) == ["id", "name", "extra", *FIELDS]
    assert rows[1]["pred_is_union"] == "False" and rows[1]["pred_union_score"] == "nan" and rows[1]["pred_desig"] == ""


def test_cli_lines(spark, tmp_path, capsys):
    code, out, _ = run_cli(tmp_path, capsys, spark, 'a "b", c 7\n\nlast\n', "--no-header")
    rows = list(csv.DictReader(io.StringIO(out)))
    assert code == 0 and [r["text"] for r in rows] == ['a "b", c 7', "", "last"]


@pytest.mark.parametrize("text, args, message", [("", [], "Empty CSV"), ("a\n", ["--no-header", "-c", "a"], "cannot be used with"), ("a,b\n1,2\n", [], "multiple columns"), ("a,b\n1,2\n", ["-c", "z"], "not found")])
def test_cli_errors(spark, tmp_path, capsys, text, args, message):
    code, _, err = run_cli(tmp_path, capsys, spark, text, *args)
    assert code and message in err


def test_registry_from_sqlite(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "r.db") as db:
        db.execute("CREATE TABLE lm_data (aff_abbr TEXT, desig_num TEXT, f_num INTEGER)")
        db.executemany("INSERT INTO lm_data VALUES (?, ?, ?)", [("A", "1", 2), ("A", "1", 2), ("", "1", 3), ("B", None, 4)])
    assert [tuple(r) for r in S.read_registry_sqlite(spark, str(tmp_path / "r.db")).collect()] == [("A", "1", 2)]


def test_bundle_files_and_warm_start(tmp_path):
    one, two = E.random_bundle(1, hidden=4), E.random_bundle(2, hidden=4)
    E.save_bundle(str(tmp_path / "a.npz"), {k.removeprefix("union."): v for k, v in one.items() if k.startswith("union.char_cnn.")})
    warm = E.warm_start(two, str(tmp_path / "a.npz"), "pointer.")
    assert np.allclose(warm["pointer.char_cnn.project.bias"], one["union.char_cnn.project.bias"], atol=1e-6)
    assert np.array_equal(warm["union.char_cnn.project.bias"], two["union.char_cnn.project.bias"])
    with pytest.warns(UserWarning, match="random"):
        assert E.warm_start(two, str(tmp_path / "none.npz"), "pointer.") == two
    assert E.NeuralBundle(str(tmp_path / "a.npz")).weights()["char_cnn.project.bias"].shape == (64,)


def test_cross_entropy_by_hand():
    assert abs(E.cross_entropy(np.array([[0.0, 0.0, -np.inf]]), np.array([1])) - np.log(2)) < 1e-12


def test_error_and_split_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "test"), ("b", "train")], "text string, split string")
    S.write_split(rows, str(tmp_path / "split"))
    assert [r.text for r in S.read_split(spark, str(tmp_path / "split"), "test").collect()] == ["a"]
    assert not S.write_errors(rows.limit(0), str(tmp_path / "errors")) and S.write_errors(rows, str(tmp_path / "errors"))
    assert spark.read.csv(str(tmp_path / "errors"), header=True).count() == 2


def test_output_columns_by_name():
    assert " ".join(FIELDS) == "pred_is_union pred_aff pred_unknown pred_desig pred_union_score pred_fnum pred_fnum_multiple"


def test_nearest_keeps_rows_of_equal_key_apart(spark, monkeypatch):
    monkeypatch.setattr(C, "LIMIT_LITERALS", 2)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "id int, v array<double>")
    named = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [0.0, 1.0]), ("c", [1.0, 0.0])], "class string, centroid array<double>")
    assert sorted((r.nearest, r.similarity) for r in C.nearest_centroid(rows, "id", "v", named).collect()) == [("a", 1.0), ("a", 1.0), ("c", 1.0)]


def test_fit_encodes_once_and_bounds_its_classes(spark, monkeypatch):
    from tallyloom.plans import extractor

    calls = spark.sparkContext.accumulator(0)

    def counting(tokens):
        @F.pandas_udf("array<double>")
        def encode(words):
            calls.add(len(words))
            return words.map(lambda w: [1.0, float(len(w))])

        return encode.asNondeterministic()(F.transform(tokens, lambda t: t["token"]))

    counting.dim = 2
    rows = spark.createDataFrame([("alpha", "AA"), ("beta two", "BB"), ("gamma", "CC")] * 5, "text string, aff_abbr string")
    assert fit(rows, encoder=counting).affiliations == ["AA", "BB", "CC"] and calls.value == 15
    monkeypatch.setattr(extractor, "LIMIT_LITERALS", 2)
    with pytest.raises(ValueError, match="classes"):
        fit(rows, encoder=counting)


def test_batch_size_does_not_outlive_the_call(spark, model):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    assert len(Extractor(model).extract_batch(spark, ["50 80"] * 5, batch_size=2)) == 5 and spark.conf.get(name) == before


def test_trained_bundle_from_files_and_its_attention(spark, tmp_path, capsys):
    from tallyloom.plans.extractor import NeuralModel, load_model

    E.save_bundle(str(tmp_path / "b.npz"), E.random_bundle(3, affiliations=2, hidden=4))
    unit = [1.0] + [0.0] * 63
    NeuralModel(E.NeuralBundle("b.npz"), unit, ["AA", "BB"], [unit, unit[::-1]]).save(str(tmp_path / "m.json"))
    found = load_model(str(tmp_path / "m.json"))
    assert isinstance(found, NeuralModel) and found.affiliations == ["AA", "BB"]
    rows = spark.createDataFrame([("IBT 123",), ("",)], "text string")
    weights = [r.attention for r in found.attention(rows).collect()]
    assert len(weights[0]) == 3 and abs(sum(weights[0]) - 1) < 1e-6 and weights[1] == []
    (tmp_path / "in.csv").write_text("name\nIBT 123\n")
    assert cli.run([str(tmp_path / "in.csv"), "--model", str(tmp_path / "m.json"), "--union-threshold", "-1"], spark=spark) == 0
    out = list(csv.DictReader(io.StringIO(capsys.readouterr().out)))
    assert out[0]["pred_is_union"] == "True" and out[0]["pred_desig"] in ("", "123")


def test_full_batches_drop_the_rest(spark):
    got = sampling.full_batches(spark.range(1000).repartition(7), "id", 64).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in got) == [(k, 64) for k in range(15)]
    assert sampling.full_batches(spark.range(10), "id", 64).count() == 0
