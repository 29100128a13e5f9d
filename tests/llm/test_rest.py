"""Top-k search, sharding, toxicity and the pipeline."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import DATA, compare

import corpus_pipeline
from gaugeflow.llm import covertree, neardup, queries, sharding, toxicity

VECTORS = "vec_id long, embedding array<float>, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)


def brute_top(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        best = sorted(((-int(v @ w), i) for i, w in good if i != q))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def search(spark, rows, k=5):
    v = covertree.whole_vectors(vectors(spark, rows))
    return {tuple(r) for r in covertree.top_k(v, v.where("vec_id % 50 = 0"), k).collect()}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(150)]  # one common vector
    rows += [(2000, None), (2001, [None] * 8), (2050, [float("nan")] * 8), (2051, [float("inf")] * 8), (2052, []), (None, rows[0][1]), (2100, [0.0] * 8)]
    assert search(spark, rows) == brute_top(rows)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 4)
    assert search(spark, rows, 3) == brute_top(rows, 3)


def test_top_k_odd_tables(spark):
    assert search(spark, []) == set()
    assert search(spark, [(50, [1.0, 2.0])]) == set()
    few = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])]
    assert search(spark, few) == brute_top(few)


def test_dual_tree_prunes_and_is_exact():
    rng = np.random.default_rng(9)
    data = np.floor(rng.normal(size=(4000, 4)) * 20 + rng.integers(0, 8, (4000, 1)) * 400)
    ids = np.arange(4000)
    own = np.arange(0, 4000, 50)
    best = covertree.Best(len(own), 5)
    q, d = covertree.CoverTree(data[own], leaf=4), covertree.CoverTree(data)
    compared = covertree.dual_search(q, own, d, ids, best, np.full(len(own), np.iinfo(np.int64).min))
    leaves = lambda t: sum(not c for c in t.children)
    assert compared < leaves(q) * leaves(d) / 2
    score = data[own] @ data.T
    score[own[:, None] == ids[None, :]] = -np.inf
    assert (np.sort(best.score, axis=1) == np.sort(score, axis=1)[:, -5:]).all()


def test_sharding(spark):
    rows = [(i, f"text {i}" if i % 9 else None, None if i % 50 == 0 else f"s{i % 7 if i % 3 else 0}", "x") for i in range(1000)] + [(5, "text 5", "s5", "x")] * 3 + [(None, "", "s1", "x")]
    out = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string, shard string"), shards=16, buckets=32).collect()
    frame = pd.DataFrame([r.asDict() for r in out])
    assert len(frame) == len(rows)
    counts = frame.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and sorted(counts.index) == list(range(16))
    for _, own in frame.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    # Every shard has each source's share, to within two rows.
    per = frame.fillna({"source": "none"}).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (per.max(axis=1) - per.min(axis=1)).max() <= 2
    for r in out:
        if r.doc_id is not None and r.doc_id % 9:
            raw = f"text {r.doc_id}".encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.interleave(empty).count() == 0


def test_few_rows_over_many_shards(spark):
    three = spark.createDataFrame([(i, "t", "s") for i in range(3)], "doc_id long, text string, source string")
    assert len({r.shard for r in sharding.interleave(three).collect()}) == 3


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    compare(queries.QUERIES[name](spark, DATA), duck, queries.ORACLES[name])


WORDS = "the plan was good and many people came to see how things went on that day in spring".split()


def corpus(seed=1, n=400):
    rng = np.random.default_rng(seed)
    texts, toxic = [], []
    for i in range(n):
        w = rng.choice(WORDS, 40).tolist()
        if i % 4 == 0:
            for insult in rng.choice(["dimwit", "blockhead", "nitwit"], 2):
                w.insert(int(rng.integers(0, len(w))), insult)
        texts.append(" ".join(w) + ". And so on.")
        toxic.append(int(i % 4 == 0))
    return texts, np.array(toxic)


def test_toxicity_tolerates_gaps_and_inserts():
    model = toxicity.fit(*corpus())
    clean, held = corpus(2)
    s = model.scores(clean)
    assert ((s >= 0.7) == (held == 1)).mean() > 0.98
    variants = ["you d.i.m.w.i.t and n-i-t-w-i-t", "you dimmwit and blockxhead", "you d i m w i t and b l o c k h e a d", "you DIMWIT and N1TW1T"]
    assert (model.scores(variants) > 3 * model.scores(["you plan and people"])).all()
    assert model.scores(["you d.i.m.w.i.t and n-i-t-w-i-t"])[0] == pytest.approx(model.scores(["you dimwit and nitwit"])[0])
    assert all(0 <= x <= 1 for x in model.scores(["", " ", "x" * 100_000, "\n\n"]))


def test_toxicity_of_one_label_only():
    model = toxicity.fit(["a b", "c d"], np.array([0, 0]))
    assert len(set(model.scores(["a", "zzz"]).tolist())) == 1


def test_toxicity_query(spark):
    texts, toxic = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(900, None, 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)] + [(900, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id < len(texts)]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.95
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert len({r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()}) == 1


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    from test_dedup import brute_classes, brute_removed

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "substrings", "packing"]
    kept = stages["toxicity"](spark, docs, folder).cache()
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    single = stages["near duplicates"](spark, kept, folder).cache()
    classes = brute_classes(rows, corpus_pipeline.NEAR_PERCENT)
    assert {r.doc_id for r in single.collect()} == {i for i, c in classes.items() if i == c}
    cut = stages["substrings"](spark, single, folder).cache()
    assert cut.columns == columns
    expected = brute_removed([(r.doc_id, r.text) for r in single.collect()], 50)
    for r in cut.collect():
        n, removed, text = expected[r.doc_id]
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == n - removed
        assert removed == 0 or r.text == text
    pieces = stages["packing"](spark, cut, folder)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in cut.collect()}


def at_similarity(shared, base=0):
    """Two texts of 100 shingles each that share `shared` of them."""
    words = [f"w{base + i}" for i in range(104)]
    other = words[: shared + 4] + [f"o{base + i}" for i in range(100 - shared)]
    return " ".join(words), " ".join(other)


def test_near_duplicate_stage_at_80(spark):
    """Copies of similarity 0.80 up to 0.85 go, those below 0.80 stay; the query op3 links from 0.85."""
    docs = [(2 * k + j, t, "x") for k, shared in enumerate((88, 91, 92)) for j, t in enumerate(at_similarity(shared, 1000 * k))]
    for k in (10, 11, 12, 13):  # 90 / 110 = 0.818
        docs += [(2 * k + j, t, "x") for j, t in enumerate(at_similarity(90, 1000 * k))]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 4, 20, 22, 24, 26}
    assert neardup.near_duplicates(table).where("kept").count() == 8
    assert {r.doc_id for r in neardup.near_duplicates(table, percent=85).where("not kept").collect()} == {5}


def test_near_duplicate_stage_decides_by_row(spark):
    """Documents without an id stay unless a row with a near-duplicate does; one of repeated rows stays."""
    (a, a2), (b, b2), (c, _), (d, d2) = (at_similarity(95, 1000 * k) for k in range(4))
    unlike = "nothing like any other text here"
    docs = [(None, a, "1"), (None, b, "2"), (7, b2, "3"), (3, c, "4"), (3, c, "5"), (3, c, "6"), (None, d, "7"), (None, d2, "8"), (None, None, "9"), (5, "", "10"), (3, unlike, "11"), (9, a2 + " x y z", "12")]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 7
    one = ({(None, d), (None, d2)} & set(got)).pop()
    assert set(got) == {(9, a2 + " x y z"), (7, b2), (3, c), one, (None, None), (5, ""), (3, unlike)}
