"""Operators that look at all rows together, against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import embedding_dedup, jaccard_join, line_dedup, packing, substring_dedup, topk_search
from tallyloom.llm import queries as Q
from tallyloom.llm._graph import components
from tallyloom.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components_by_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    own = Groups()
    for a, b in edges:
        own.join(a, b)
    found, _ = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r.id: r.component for r in found.collect()}
    assert all(got[x] == own.find(x) for e in edges for x in e if e[0] != e[1])
    assert components(spark.createDataFrame([], "a bigint, b bigint"))[0].count() == 0


def test_components_that_do_not_converge_raise(spark, monkeypatch):
    monkeypatch.setattr("tallyloom.llm._graph._MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="converged"):
        components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint"))


# -- packing


def check_pieces(rows, docs, length=4096):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for doc_id, text in docs:
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by.pop(doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert not by
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def test_op1_packs_everything(spark):
    docs = documents(spark)
    rows = Q.op1_packing(spark, SF).collect()
    sequences = check_pieces(rows, docs)
    assert sum(r.length for r in rows) > (sequences - 1) * 4096


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "_MEMO_WORDS", 5)
    texts = [None, "", " ", "a", "İ. ΑΣ Σ. don't é́", "x " * 9000, "<|endoftext|> b", "½²ª_", "\x1c \x85 q"]
    pieces = packing.pack(frame(spark, list(enumerate(texts))), vocabulary("word_bpe_49k.json"))
    check_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).collect(), list(enumerate(texts)))
    assert packing.pack(frame(spark, []), vocabulary("word_bpe_49k.json")).count() == 0
    twice = packing.pack(frame(spark, [(1, "a b"), (1, "a b")]), vocabulary("word_bpe_49k.json")).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_related_documents_are_neighbours(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    bases = [" ".join(word() for _ in range(60)) for _ in range(20)]
    docs = [(i + 20 * k, b + f" tail{k}") for k in range(3) for i, b in enumerate(bases)]
    pieces = packing.pack(frame(spark, docs), vocabulary("word_bpe_49k.json")).collect()
    order = [r.doc_id % 20 for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(a == b for a, b in zip(order, order[1:])) >= 30


def test_relation_counts_more_than_shared_boilerplate(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = " ".join(word() for _ in range(60))
    bases = [" ".join(word() for _ in range(60)) for _ in range(100)]
    docs = [(i + 100 * k, f"{common} {b} tail{k}") for k in range(2) for i, b in enumerate(bases)]
    pieces = packing.pack(frame(spark, docs), vocabulary("word_bpe_49k.json")).collect()
    order = [r.doc_id % 100 for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(a == b for a, b in zip(order, order[1:])) >= 90


def test_walk_prefers_low_degree_and_heavy_edges():
    graph = [{1: 1}, {0: 1, 2: 5, 3: 1}, {1: 5}, {1: 1}, {}]
    assert packing.walk(np.arange(5), graph) == [4, 0, 1, 2, 3]


# -- substrings


def repeats(docs, length):
    split = [(i, (t or "").encode().split()) for i, t in docs]
    seen = collections.Counter(tuple(w[k : k + length]) for _, w in split for k in range(len(w) - length + 1))
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        yield i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def test_op2_against_counting(spark):
    want = sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in repeats(documents(spark), 35))
    assert sorted(map(tuple, Q.op2_substrings(spark, SF).collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(spark, seed):
    rng = random.Random(seed)
    docs = [(i, "  ".join(rng.choice(["a", "b", "b", "c d"]) for _ in range(rng.randint(0, 60)))) for i in range(25)]
    docs += [(90, None), (91, ""), (92, "a " * 300), (93, docs[0][1]), (94, docs[0][1]), (95, "\x1fa b")]
    got = substring_dedup.remove_repeats(frame(spark, docs), length=10)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == sorted(repeats(docs, 10))
    assert substring_dedup.remove_repeats(frame(spark, []), length=10).count() == 0


def test_equal_rows_repeat_each_other(spark):
    text = " ".join(map(str, range(12)))
    assert [r.n_removed for r in substring_dedup.remove_repeats(frame(spark, [(1, text), (1, text)]), length=10).collect()] == [12, 12]


# -- lines


def test_lines_against_sql(spark):
    import duckdb

    rng = random.Random(3)
    pool = ["", " ", "alpha", "beta", "gamma", "delta", "long line of text", "é"]
    shared = [rng.choice(pool) + str(k) for k in range(30)]
    docs = [(i, "\n".join([str(i)] * rng.randint(0, 2) + shared[rng.randint(0, 10) :] + [rng.choice(pool) for _ in range(rng.randint(0, 9))])) for i in range(30)]
    docs += [(50, None), (51, ""), (52, "\n\n\n"), (53, docs[0][1]), (54, "one\n" * 2000)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = db.execute(line_dedup.ORACLE_SQL.format(table="documents")).fetchall()
    got = line_dedup.dedup_lines(frame(spark, docs).withColumn("_text", F.lit(1)).withColumn("n_lines", F.lit("x")))
    assert got.columns == ["doc_id", "text", "_text", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == sorted(want)
    assert sum(w[3] for w in want) > 100
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def passages(docs):
    """Lines left by definition: windows of successive lines with more than spaces, in the order of ids."""
    split = {i: (t or "").split("\n") for i, t in docs}
    seen, first, later = set(), collections.defaultdict(set), collections.defaultdict(set)
    every = []
    for i in sorted(split):
        shown = [k for k, x in enumerate(split[i]) if x.strip(" ")]
        every += [(i, a, b, "\n".join(split[i][a : b + 1])) for a, b in zip(shown, shown[1:])]
    often = collections.Counter(w[3] for w in every)
    for i, a, b, text in every:
        if often[text] > 1:
            (later if text in seen else first)[i].update(range(a, b + 1))
        seen.add(text)
    return sorted((i, "\n".join(x for k, x in enumerate(split[i]) if k not in later[i] - first[i]), len(split[i]), len(later[i] - first[i])) for i in split)


def test_passages_by_definition(spark):
    rng = random.Random(4)
    pool = ["", " ", "alpha", "beta", "gamma", "delta", "é"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs += [(80, None), (81, ""), (82, "\n\n"), (84, "one\n" * 2000), (85, "one\none\ntwo")]
    got = line_dedup.dedup_passages(frame(spark, docs).withColumn("_text", F.lit(1)).withColumn("n_lines", F.lit("x")))
    assert got.columns == ["doc_id", "text", "_text", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == passages(docs)
    assert line_dedup.dedup_passages(frame(spark, [])).count() == 0
    twice = line_dedup.dedup_passages(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "b\nc"), (2, "x\na\nb")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in twice) == [("1", "a\nb"), ("1", "a\nb"), ("2", "x"), ("None", "b\nc")]
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString().replace("LogicalRDD", ""))


def test_pipeline_cuts_planted_passages_wholly(spark):
    import corpus_pipeline as P

    rng = random.Random(9)
    line = lambda: " ".join(str(rng.random()) for _ in range(6))
    planted = [[line() for _ in range(2 + k % 8)] for k in range(80)]
    docs = [(i, "\n".join([line()] * (i % 3) + planted[i % 80] + [line() for _ in range(1 + i % 2)])) for i in range(160)]
    rows = frame(spark, docs).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    left = {r.doc_id: r.text for r in P.cut_lines(spark, rows, "").collect()}
    assert all(x in left[i] for i in range(80) for x in planted[i])
    assert not any(x in left.get(i, "") for i in range(80, 160) for x in planted[i % 80])


def test_lines_run_no_python(spark):
    plan = line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- Jaccard


def jaccard(docs, n, threshold):
    sets = []
    for i, t in docs:
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    links, own = collections.Counter(), Groups()
    for x, (i, a) in enumerate(sets):
        own.find(i)
        for j, b in sets[:x]:
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                own.join(i, j)
    return sorted((i, own.find(i), links[i]) for i, _ in sets)


def test_op5_against_all_pairs(spark):
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in Q.op5_jaccard(spark, SF).collect())
    assert got == jaccard(documents(spark), 3, 0.5)


def test_jaccard_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!"), (4, "one"), (5, "One."), (6, "one two"), (7, "one two"), (8, "a b c d e f"), (9, "a b c d e g"), (10, "w " * 5000)]
    found = jaccard_join.near_copies(frame(spark, docs))
    assert sorted((r.id, r.class_id, r.n_links) for r in found.collect()) == jaccard(docs, 3, 0.5)
    assert jaccard_join.near_copies(frame(spark, [])).count() == 0


def test_jaccard_of_a_large_group_forms_no_pairs_by_bands(spark, monkeypatch):
    rng = random.Random(11)
    base, docs = [f"w{i}" for i in range(120)], []
    for i in range(150):  # near copies, several tiles of them
        docs.append((i, " ".join(w if rng.random() > rng.choice((0.02, 0.08)) else f"x{rng.randrange(40)}" for w in base)))
    for i in range(150, 200):  # short texts with one line in common
        docs.append((i, "one line that many short texts have in common " + " ".join(f"y{rng.randrange(500)}" for _ in range(rng.randrange(3, 9)))))
    docs += [(200, docs[0][1]), (201, None), (202, "alone here today")]
    made, plain = {}, jaccard_join.written

    def counting(df, what):
        table, path = plain(df, what)
        made[what] = made.get(what, 0) + table.count()
        return table, path

    monkeypatch.setattr(jaccard_join, "written", counting)
    for tile in (256, 16):
        made.clear()
        monkeypatch.setattr(jaccard_join, "TILE", tile, raising=False)
        found = jaccard_join.near_copies(frame(spark, docs)).collect()
        assert sorted((r.id, r.class_id, r.n_links) for r in found) == jaccard(docs, 3, 0.5)
        assert made["links"] > 5_000 and made["candidates"] < made["links"] / 10


def test_jaccard_recall_near_the_threshold(spark):
    rng = random.Random(7)
    docs = []
    for k in range(60):
        base = [f"w{k}x{i}" for i in range(120)]
        other = list(base)
        for i in rng.sample(range(120), rng.randint(0, 14)):
            other[i] = f"n{k}x{i}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = jaccard(docs, 3, 0.5)
    got = sorted((r.id, r.class_id, r.n_links) for r in jaccard_join.near_copies(frame(spark, docs)).collect())
    linked = [w for w in want if w[2]]
    assert all(g[2] <= w[2] for g, w in zip(got, want)) and sum(g == w for g, w in zip(got, want) if w[2]) >= 0.97 * len(linked)


def test_posterior_bounds():
    assert jaccard_join.least_agreeing(12, 0.5, 1e-4) == 0 and jaccard_join.least_agreeing(120, 0.5, 1e-4) > 35
    assert jaccard_join.least_agreeing(120, 0.9, 1e-4) > jaccard_join.least_agreeing(120, 0.5, 1e-4)


# -- embeddings


def cosine_links(rows, threshold=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    units = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links, own = collections.Counter(), Groups()
    ids = sorted(units)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                own.join(i, j)
    return sorted((i, links[i], own.find(i), own.find(i) == i) for i, _ in rows)


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        base = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + rng.standard_normal(64) * 0.2 * rng.random()).tolist()))
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [1.0, None]), (2004, []), (2005, [float("inf")] + [0.0] * 63), (2006, [1e-300] * 64), (2007, [2e-300] * 64), (2008, [1.0, 2.0]), (2009, [2.0, 4.0]), (2010, [3.0]), (2011, [5.0])]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got, want = sorted(map(tuple, found.collect())), cosine_links(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)
    assert [g for g in got if g[0] >= 2000] == [w for w in want if w[0] >= 2000]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_decoding_lists_all_filters_that_a_vector_passes():
    code = embedding_dedup.ProductCode(8, 20)
    v = np.random.default_rng(1).standard_normal((30, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    turned = v @ code.rotation
    score = (turned[:, :4] @ code.codes[0])[:, :, None] + (turned[:, 4:] @ code.codes[1])[:, None, :]
    rows, filters = code.decode(v)
    assert set(zip(rows.tolist(), filters.tolist())) == {(i, a * 20 + b) for i, a, b in np.argwhere(score >= code.alpha).tolist()}


@pytest.mark.parametrize("words", [3, 20, 60])
def test_decoding_lists_the_nearest_filters_in_any_case(words):
    code = embedding_dedup.ProductCode(8, words)
    v = np.random.default_rng(1).standard_normal((30, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    turned = v @ code.rotation
    score = ((turned[:, :4] @ code.codes[0])[:, :, None] + (turned[:, 4:] @ code.codes[1])[:, None, :]).reshape(30, -1)
    rows, filters = code.decode(v, least=32)
    for k in range(30):
        want = {*np.flatnonzero(score[k] >= code.alpha).tolist()} | {*np.argsort(-score[k])[: min(32, words**2)].tolist()}
        assert {*filters[rows == k].tolist()} == want and (rows == k).sum() == len(want)


@pytest.mark.parametrize("dim, words", [(2, 40), (3, 40), (5, 60), (64, 100)])
def test_alpha_gives_the_filters_asked_for(dim, words):
    code = embedding_dedup.ProductCode(dim, words)
    v = np.random.default_rng(2).standard_normal((4000, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    mean = len(code.decode(v)[0]) / len(v)
    assert 0.6 * embedding_dedup.FILTERS_EACH < mean < 1.6 * embedding_dedup.FILTERS_EACH


@pytest.mark.parametrize("vectors", [10**4, 10**6, 10**7, 10**8])
def test_near_vectors_share_filters_at_any_size(vectors):
    """Recall at the threshold with the code that a table of so many vectors gets."""
    rng, rows = np.random.default_rng(5), 500
    code = embedding_dedup.ProductCode(64, embedding_dedup.words_for(vectors, 48))
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, rows, 64)))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    (i, f), (j, g) = code.decode(x, embedding_dedup.LEAST_FILTERS), code.decode(y, embedding_dedup.LEAST_FILTERS)
    met = {k for k, _ in {*zip(i.tolist(), f.tolist())} & {*zip(j.tolist(), g.tolist())}}
    assert len(met) >= 0.98 * rows and len(i) <= 80 * rows


# -- top k


def top(rows, k):
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    out = []
    for q in sorted(good):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("blocks, bins", [(7, 4), (8192, 1024)])
def test_top_k_against_sorting(spark, monkeypatch, blocks, bins):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", blocks * 5)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", blocks)
    monkeypatch.setattr(topk_search, "BINS", bins)
    rng = np.random.default_rng(6)
    rows = [(i, np.round(rng.standard_normal(5) * (0 if i % 3 == 0 else 0.05), 2).tolist()) for i in range(130)]
    rows += [(140, None), (160, [1.0, None]), (180, [float("nan")] * 5), (200, [1.0]), (220, []), (201, [-1.0] * 5)]
    found = topk_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, k=6)
    assert sorted(map(tuple, found.collect())) == top(rows, 6)


def test_top_k_of_few_rows(spark):
    kind = "vec_id bigint, embedding array<float>"
    ask = lambda rows: topk_search.top_k(spark.createDataFrame(rows, kind), F.col("vec_id") % 20 == 0, k=5)
    assert ask([]).count() == 0 and ask([(20, [1.0])]).count() == 0 and ask([(1, [1.0]), (2, [1.0])]).count() == 0
    assert [tuple(r) for r in ask([(20, [1.0]), (3, [2.0])]).collect()] == [(20, 1, 3, 64 * 128)]


def test_top_k_of_large_numbers(spark):
    rows = [(0, [2e7]), (1, [2e7]), (2, [-2e7]), (3, [1e30])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 1, 2] and got[1].score == (64 * 20_000_000) ** 2


# -- the pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near copies", "personal data", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        docs, _ = P.written(stage(spark, docs, "/root/testdata/sf0.01"), f"test-{k}")
        assert tuple(docs.columns) == P.COLUMNS
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    bad = [r.doc_id for r in labels.where("quality = 0").collect()]
    assert sum(b in kept for b in bad) <= 0.05 * len(bad)
    rows = P.pack(spark, docs, "").collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()])
