"""Nulls, empty and long texts, ties, repeated rows and ids, empty tables and clashing names, for every operator and stage."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyloom.llm import embedding_dedup, jaccard_join, line_dedup, packing, pii, quality, secret_scan, sentencepiece_codec, substring_dedup, topk_search
from tallyloom.llm.queries import vocabulary

WORDS = vocabulary("word_bpe_49k.json")
PIECES = vocabulary("piece_bpe_32k.model")
TEXTS = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (4, "three"), (None, "four five"), (5, "long " * 60_000), (6, "one two")]
#: Names that the operators use inside, as columns of the input.
CLASHES = "id row_id ids n signature label _id _text _th _row _lines th z u uid k1 k2 copies spans s text2 y x rows key score".split()


def texts(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def clashing(df, leave=()):
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES if c not in df.columns and c not in leave))


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


#: name: (operator over documents, the columns that it makes)
ON_TEXTS = {
    "op1": (lambda d: packing.pack(d, WORDS), ["doc_id", "start", "length", "doc_tokens", "ids"]),
    "op2": (lambda d: substring_dedup.remove_repeats(d), ["doc_id", "kept", "n_words", "n_removed"]),
    "op3": (lambda d: sentencepiece_codec.decode(sentencepiece_codec.encode(d, PIECES), PIECES), ["doc_id", "ids", "decoded"]),
    "op4": (lambda d: secret_scan.scan(d), ["doc_id", "text", "spans"]),
    "op5": (lambda d: jaccard_join.near_copies(d), ["id", "k1", "k2", "copy_of", "class_id", "n_links"]),
    "op8": (lambda d: pii.pseudonymise(d, b"k"), ["doc_id", "text", "pii"]),
    "op9": (lambda d: line_dedup.dedup_lines(d), ["doc_id", "text", "n_lines", "n_removed"]),
    "op9 passages": (lambda d: line_dedup.dedup_passages(d), ["doc_id", "text", "n_lines", "n_removed"]),
    "op10": (lambda d: quality.score(d, quality.fit(d, d.sparkSession.createDataFrame([(4, 1), (5, 0)], "doc_id bigint, quality int"))), ["doc_id", "text", "score"]),
}


@pytest.mark.parametrize("name", ON_TEXTS)
def test_odd_rows_clashes_and_empty_tables(spark, name):
    run, made = ON_TEXTS[name]
    plain = run(texts(spark))
    got = rows_of(plain, *made)
    assert len({r.split(",")[0] for r in got}) == 7 and len(got) >= len(TEXTS)
    other = run(clashing(texts(spark), leave=made))
    assert rows_of(other, *made) == got
    passed = [c for c in CLASHES if c in other.columns and c not in made]
    assert all(set(r) == {f"own {c}" for c in passed} for r in other.select(*passed).collect()) or not passed
    none = run(texts(spark, []))
    assert none.columns == plain.columns and none.count() == 0


def test_what_repeated_rows_give(spark):
    ids = [r.ids for r in sentencepiece_codec.encode(texts(spark), PIECES).where("doc_id = 4").collect()]
    assert len(ids) == 3 and ids.count(ids[0]) + ids.count(ids[-1]) in (3, 4, 5)
    secrets = secret_scan.scan(texts(spark, [(1, "token=abcdef"), (1, "token=abcdef"), (None, "token=abcdef")]))
    assert [len(r.spans) for r in secrets.collect()] == [1, 1, 1]
    changed = pii.pseudonymise(texts(spark, [(1, "248.40.198.62"), (1, "248.40.198.62"), (2, "x 248.40.198.62")]), b"k")
    assert len({r.text.split()[-1] for r in changed.collect()}) == 1
    links = {(r.id, r.class_id, r.n_links) for r in jaccard_join.near_copies(texts(spark)).collect()}
    assert (4, 4, 2) in links and (6, 4, 2) in links and (4, 4, 0) in links
    one = quality.fit(texts(spark, [(1, "a b")] * 50 + [(2, "$$")]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"), pairs=10)
    again = quality.fit(texts(spark, [(1, "a b"), (2, "$$")]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"), pairs=10)
    assert np.array_equal(one.weights, again.weights) and one.threshold == again.threshold


def test_vectors_with_repeated_ids_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 8))
    rows = [(20, base[0].tolist()), (20, base[0].tolist()), (20, base[1].tolist()), (3, base[0].tolist()), (None, base[0].tolist()), (4, None)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = embedding_dedup.near_duplicates(vectors)
    assert sorted((str(r.id), r.n_links, str(r.component_id)) for r in found.collect()) == [("20", 0, "20"), ("20", 3, "3"), ("20", 3, "3"), ("3", 3, "3"), ("4", 0, "4"), ("None", 3, "3")]
    assert rows_of(embedding_dedup.near_duplicates(clashing(vectors)), "id", "n_links", "component_id") == rows_of(found, "id", "n_links", "component_id")
    asks = F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))
    best = topk_search.top_k(vectors, asks, k=3)
    assert rows_of(topk_search.top_k(clashing(vectors), asks, k=3), *best.columns) == rows_of(best, *best.columns)
    # three rows ask under one id, each with the three other rows that have an id as candidates
    assert collections.Counter((r.query_id, r["rank"]) for r in best.collect()) == {(20, 1): 3, (20, 2): 3, (20, 3): 3}


# -- the packing graph


def related(rng, families=40, size=5, words=80):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(families):
        base = [word() for _ in range(words)]
        for k in range(size):
            own = [w if rng.random() > 0.05 * k else word() for w in base]
            out.append(" ".join(own))
    return list(enumerate(out))


def graph_of(spark, docs):
    rows = packing.tokenize(packing.with_text(texts(spark, docs)), WORDS, 2).cache()
    graph = {r.a: {t.b: t.w for t in r.ties} for r in packing.neighbour_graph(rows).collect()}
    return rows, graph


def test_graph_holds_the_nearest(spark):
    docs = related(random.Random(5))
    rows, graph = graph_of(spark, docs)
    sets = {}
    for r in rows.collect():
        ids = np.frombuffer(r.ids, "<u2")[:-1].tolist()
        sets[r.row_id] = set(zip(ids, ids[1:]))
    share = lambda a, b: len(a & b) / len(a | b)
    held = 0
    for i, own in sets.items():
        best = max(share(own, s) for j, s in sets.items() if j != i)
        held += max((share(own, sets[j]) for j in graph.get(i, {})), default=0) >= best
    assert held >= 0.9 * len(sets)
    assert all(len(t) <= packing.BEST and i not in t for i, t in graph.items())


def test_tasks_meet_at_their_borders(spark, monkeypatch):
    monkeypatch.setattr(packing, "BEST", 10_000)
    docs = related(random.Random(6), families=12)

    def edges(tasks):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        _, graph = graph_of(spark, docs)
        return {(a, b) for a, t in graph.items() for b in t}

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one, many = edges(1), edges(5)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert one <= many and len(one) > 100


def test_several_blocks(spark):
    docs = related(random.Random(7))
    rows, graph = graph_of(spark, docs)
    placed = packing.layout(rows, block_rows=40).collect()
    sizes = {r.row_id: r.n for r in rows.collect()}
    blocks = collections.defaultdict(list)
    for r in placed:
        blocks[r.block].append((r.at, r.row_id))
    assert len(blocks) > 2 and sorted(r.row_id for r in placed) == sorted(sizes)
    for own in blocks.values():
        at = 0
        for start, row in sorted(own):
            assert start == at
            at += sizes[row]
    block_of = {r.row_id: r.block for r in placed}
    assert all(r.lost == sum(block_of[b] != r.block for b in graph.get(r.row_id, {})) for r in placed)
    # families mostly stay together
    strong = [(a, b) for a, ties in graph.items() for b, w in ties.items() if w >= 16]
    assert sum(block_of[a] != block_of[b] for a, b in strong) <= 0.15 * len(strong)


# -- the pipeline's stages

ROWS = [
    (1, "good words in a row\nmore good words here", "en", "s", 1),
    (1, "good words in a row\nmore good words here", "en", "s", 1),
    (1, "another text under the id of the first one", None, None, None),
    (2, None, "en", "s", None),
    (3, "", "en", "s", 0),
    (None, "a text without id that says +1 (988) 555-2485 and no more", "en", "s", 5),
    (4, "good words in a row\nmore good words here now", "en", "s", 1),
    (5, "word " * 40_000, "en", "s", 1),
]


def stage_rows(spark, rows=ROWS, extra=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return clashing(df) if extra else df


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(1, 1), (5, 1), (3, 0)], "doc_id bigint, quality int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_take_odd_rows(spark, labels, name, stage):
    plain = stage(spark, stage_rows(spark), labels)
    columns = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    got = rows_of(plain, *columns)
    assert rows_of(stage(spark, stage_rows(spark, extra=True), labels), *columns) == got
    assert stage(spark, stage_rows(spark, []), labels).count() == 0
    assert name == "packing" or tuple(plain.columns) == P.COLUMNS


def test_stages_of_odd_rows_give_what_they_say(spark, labels):
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    one = P.keep_one(spark, stage_rows(spark), labels)
    assert ids(one) == ["1", "1", "2", "3", "5", "None"]
    assert sorted(r.text for r in one.where("doc_id = 1").collect()) == [ROWS[2][1], ROWS[0][1]]
    cut = P.cut_lines(spark, stage_rows(spark), labels)
    assert ids(cut) == ["1", "1", "1", "2", "3", "4", "5", "None"] and {r.text for r in cut.where("doc_id = 2").collect()} == {""}
    hidden = {str(r.doc_id): r for r in P.hide_personal(spark, stage_rows(spark), labels).collect()}
    assert "988" not in hidden["None"].text and hidden["2"].text is None and hidden["2"].n_chars is None
    packed = P.pack(spark, stage_rows(spark), labels)
    assert packed.where("start = 0").count() == len(ROWS)
    good = P.keep_good(spark, stage_rows(spark), labels)
    assert rows_of(good) == rows_of(good.intersectAll(stage_rows(spark)))


def test_run_leaves_no_tables_of_its_stages(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*shared.iterdir()}
    rows = P.run(spark, "/root/testdata/sf0.001")
    left = {p.name.split("-")[0] for p in {*shared.iterdir()} - before}
    assert rows.count() > 0 and left <= {"stage", "tokens", "layout", "graph", "orders", "met"} and sum(p.name.startswith("stage-") for p in {*shared.iterdir()} - before) == 1


def test_stages_hold_a_clean_corpus_whole(spark):
    """Each stage against its input on the given tables: what goes, goes for a reason."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    by_hand = {r.doc_id for r in docs.collect() if model.score(quality.features(r.text or "")[None])[0] >= quality.CUT}
    assert {r.doc_id for r in P.keep_good(spark, docs, sf).collect()} == by_hand
    words = {r.doc_id: tuple("".join(c if c.isalnum() else " " for c in (r.text or "").lower()).split()) for r in docs.collect()}
    grams = {i: {w[k : k + 3] for k in range(max(1, len(w) - 2))} if w else {("", i)} for i, w in words.items()}
    group = {i: i for i in grams}
    for i in sorted(grams):
        for j in grams:
            if j < i and 2 * len(grams[i] & grams[j]) >= len(grams[i] | grams[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert {r.doc_id for r in P.keep_one(spark, docs, sf).collect()} == {i for i, g in group.items() if i == g}
    own = pii.Pseudonyms(P.DEMO_KEY)
    hidden = {r.doc_id: r.text for r in P.hide_personal(spark, docs, sf).collect()}
    assert hidden == {r.doc_id: own.text(r.text)[0] if r.text else r.text for r in docs.collect()}
