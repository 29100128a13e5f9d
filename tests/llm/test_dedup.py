"""Near-duplicates, substrings and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gaugeflow.llm import fingerprint, neardup, substring
from gaugeflow.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def near_copies(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 30, 120, 400]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own) if rng.random() < 0.5 else " \n".join(own).upper()))
    rows += [(1000, None), (1001, ""), (1002, " \t "), (1003, "One two"), (1004, "one TWO"), (1005, "É é x y z"), (1006, "é é x y z"), (1007, "the same " * 5000), (1008, "the same " * 4000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_near_duplicates(spark, block):
    rows = near_copies()
    got = {r.doc_id: r for r in neardup.near_duplicates(table(spark, rows), block=block).collect()}
    expected = brute_classes(rows)
    assert {i: r.component_id for i, r in got.items()} == expected
    for i, t in rows:
        assert (got[i].n_shingles, got[i].kept) == (len(shingles(t)), expected[i] == i)


def test_near_duplicates_odd_tables(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    rows = neardup.near_duplicates(table(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (None, "alone in the world here")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, False), (0, 0, False), (0, 5, False), (5, 5, True), (5, 5, True)]


def test_tensored_keys_find_close_pairs():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        value = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        other = np.unique(np.concatenate([value[:-8], rng.integers(0, 1 << 63, 8, dtype=np.uint64)]))
        both = np.concatenate([value, other])
        _, keys = neardup.signatures(both, np.array([0, len(value), len(both)]))
        same = keys[0] == keys[1]
        missed += not (same[: neardup.KEYS].any() and same[neardup.KEYS :].any())
    assert missed == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(40)] + [(7, 7), (999, 999)]
    edges += [(2000, 2000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removed(rows, window):
    first, out = {}, {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def repeated_passages(seed=4):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    passages = [rng.choices(words, k=k) for k in (49, 50, 51, 90, 200)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 4)):
            text += rng.choices(words, k=rng.randrange(0, 60))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(0, 30) if len(p) > 90 else 0
                text += p[a:]
        rows.append((i, " \n".join(text)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "loop " * 3000), (105, "loop " * 500)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [4000, 5])
def test_repeats(spark, shard, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_PASSAGES", shard)
    rows = repeated_passages()
    docs = table(spark, rows)
    keyed = docs.withColumn("row_key", F.xxhash64("text"))
    starts = {r.doc_id: set(r.starts) for r in substring.covered_windows(keyed.select("doc_id", "row_key", "text"), shard=shard).collect()}
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    for i, (n, removed, kept) in brute_removed(rows, 50).items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (n, removed, kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert bool(starts.get(i)) == (removed > 0)


def test_hot_anchor_stays_out_of_the_groups(spark, monkeypatch):
    """No task holds more passages of one anchor than a shard, however many contexts a common passage has."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(52)]
    rows = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(40)] + common + [f"z{rng.randrange(10**6)}" for _ in range(40)])) for i in range(30)]
    search = substring._search

    def bounded(window):
        inner = search(window)

        def run(pdf):
            if pdf.groupby("anchor").size().max() > 5:
                raise ValueError("one anchor went whole into a group")
            return inner(pdf)

        return run

    monkeypatch.setattr(substring, "_search", bounded)
    keyed = table(spark, rows).withColumn("row_key", F.xxhash64("text")).select("doc_id", "row_key", "text")
    starts = {r.doc_id: sorted(r.starts) for r in substring.covered_windows(keyed, shard=5).collect()}
    assert starts == {i: [40, 41, 42] for i in range(1, 30)}


def test_repeats_odd_tables(spark):
    assert substring.remove_repeats(table(spark, [])).count() == 0
    long = " ".join(f"x{i}" for i in range(60))
    rows = substring.remove_repeats(table(spark, [(None, long), (3, long), (3, long), (3, "short"), (9, long + " tail")])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows) == [(0, 60, 0), (3, 1, 0), (3, 60, 0), (3, 60, 0), (9, 61, 60)]


def test_without_repeats_keeps_columns_and_untouched_texts(spark):
    long = "  ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long, 9, "en"), (2, long + "\n tail", 9, "en"), (3, None, None, None), (4, " as  it is\n", 11, "de")], "doc_id long, text string, n_chars long, starts string")
    got = {r.doc_id: tuple(r) for r in substring.without_repeats(docs.withColumnRenamed("starts", "lang")).collect()}
    assert got == {1: (1, long, 9, "en"), 2: (2, "tail", 4, "en"), 3: (3, None, None, None), 4: (4, " as  it is\n", 11, "de")}


def test_suffix_automaton():
    rng = random.Random(6)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    automaton = substring.SuffixAutomaton()
    for i, t in enumerate(texts):
        automaton.add(t, i)
    automaton.finish()
    for probe in texts + [[rng.randrange(4) for _ in range(30)] for _ in range(20)]:
        expected = [min((i for i, t in enumerate(texts) if any(t[j : j + 5] == probe[k : k + 5] for j in range(len(t) - 4))), default=(1 << 63) - 1) for k in range(len(probe) - 4)]
        assert automaton.least_documents(probe, 5) == expected


def test_fingerprints_are_homomorphic():
    a, b = "one two\nthree four\n\nfive", "six\nseven eight"
    x, y, both, swapped = fingerprint.fingerprints([a, b, a + "\n" + b, b + "\n" + "five\nthree four\none two"])
    assert (fingerprint.add(x, y) == both).all() and (both == swapped).all() and (fingerprint.remove(both, y) == x).all()
    assert (x != y).any() and not fingerprint.fingerprints([""]).any()
    twice = fingerprint.fingerprints(["five\nfive", "five"])
    assert (twice[0] == twice[1] * np.uint32(2)).all()


def test_compare_with_next(spark):
    texts = [None, "", "é" * 10, "a\nb\nc", "a\nb\nc", "x " * 20_000, "same line\n" * 50]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprint.compare_with_next(table(spark, rows).repartition(4)).collect()}
    ordered = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        lanes = fingerprint.fingerprints([t, new, nxt])
        assert [r.fingerprint, r.edited_fingerprint] == fingerprint.shown(lanes[:2])
        assert r.near_edited == pytest.approx(fingerprint.likeness(lanes[:1], lanes[1:2])[0])
        assert r.near_next == pytest.approx(fingerprint.likeness(lanes[:1], lanes[2:])[0])
    assert got[21].fingerprint == got[28].fingerprint and got[28].near_next == 1
    assert fingerprint.compare_with_next(table(spark, [])).count() == 0
    one = fingerprint.compare_with_next(table(spark, [(None, "alone\nhere")])).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_likeness_follows_shared_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = fingerprint.compare_with_next(docs).where("n_chars > 500").collect()
    assert np.mean([r.near_edited for r in rows]) > 0.5 > 0.2 > np.mean([r.near_next for r in rows])
