"""Inputs made to break an operator: words built to collide, clashing names, null ids, damage, long texts."""

import hashlib
import random
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from test_dedup import brute_classes, brute_removed, table

import corpus_pipeline
from gaugeflow.llm import covertree, fingerprint, idfiles, lexicon, neardup, packing, pretokens, rangecoder, sharding, spans, substring, tokencount, toxicity, transducer
from gaugeflow.llm.shared import new_folder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def thue_morse(n=1024):
    """A word of two letters and its complement, which polynomial hashes modulo 2^64 take for the same."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_word_hashes_tell_words_apart():
    a, b = thue_morse()
    words = [a, b, "", "x", "xy", "x" * 7, "x" * 8, "x" * 16, "x" * 17, a + "1", b + "1"]
    raw = "".join(words * 2).encode()
    size = np.array([len(w) for w in words * 2])
    ends = np.cumsum(size)
    h = spans.word_hashes(np.frombuffer(raw, np.uint8), ends - size, ends)
    assert len(set(h[: len(words)].tolist())) == len(words) and (h[: len(words)] == h[len(words) :]).all()


def test_spans_of_one_key_are_told_apart(monkeypatch):
    """With a key that is the same for all, codes still follow the bytes."""
    monkeypatch.setattr(spans.Edges, "keys", lambda self: np.zeros(len(self.size), np.uint64))
    words = [b"a", b"b", b"a", b"longer than sixteen bytes", b"b", b"longer than sixteen bytes", b"abcdefghi", b"abcdefghj"]
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size)
    code, first, _, _ = spans.distinct(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
    assert [words[first[c]] for c in code] == words and len(first) == 5


def test_colliding_words_do_not_link(spark):
    a, b = thue_morse()
    five = lambda w: " ".join(f"{w}{i}" for i in range(5))
    rows = [(1, five(a)), (2, five(b)), (3, five(a))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_classes(rows) == {1: 1, 2: 2, 3: 1}


def test_colliding_words_are_not_removed(spark):
    a, b = thue_morse()
    rest = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join([a, *rest])), (4, " ".join(["y" * 3000, *rest, "y" * 3000])), (5, " ".join(["y" * 3000, *rest]))]
    got = {r.doc_id: r for r in substring.remove_repeats(table(spark, rows)).collect()}
    for i, (n, removed, kept) in brute_removed(rows, 50).items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (n, removed, kept)
    assert got[2].n_removed == 0 and got[3].n_removed == 50 and got[5].n_removed == 50


def test_fingerprint_is_the_sum_of_paragraph_digests():
    """Against a few plain lines of Python; and texts of colliding words differ."""
    a, b = thue_morse()
    texts = ["", "\n\n", "one\ntwo\n\none", "two\none\none", a, b, "é\r\nf", a + "\n" + b]
    lanes = fingerprint.fingerprints(texts)
    for t, row in zip(texts, lanes):
        total = [0] * 32
        for p in (p for p in t.split("\n") if p):
            digest = hashlib.blake2b(p.encode(), person=b"lanes 0").digest() + hashlib.blake2b(p.encode(), person=b"lanes 1").digest()
            total = [(x + int.from_bytes(digest[4 * k : 4 * k + 4], "little")) % 2**32 for k, x in enumerate(total)]
        assert row[:32].tolist() == total
    assert (lanes[2] == lanes[3]).all() and (lanes[4] != lanes[5]).any()


def test_edited_fingerprints_by_deletion_and_insertion():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 80))) for _ in range(200)] + ["", "\n", "no break here"]
    following = texts[1:] + texts[:1]
    new = [fingerprint.edited(t, f) for t, f in zip(texts, following)]
    assert (fingerprint.edited_lanes(texts, following, fingerprint.fingerprints(texts)) == fingerprint.fingerprints(new)).all()


def test_cut_repeats_keeps_columns_of_any_name(spark):
    words = " ".join(f"x{i}" for i in range(60))
    names = ["doc_id", "text", "starts", "row_key", "anchor", "row", "least"]
    rows = [(1, words, "s1", "k1", 1, "r1", 0.5), (2, words + "\n tail", "s2", "k2", 2, "r2", 1.5), (None, words, None, None, None, None, None), (3, None, "s3", "k3", 3, "r3", 2.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, starts string, row_key string, anchor int, row string, least double")
    out = corpus_pipeline.cut_repeats(spark, docs, "")
    assert out.columns == names
    assert {tuple(r) for r in out.collect()} == {rows[0], (2, "tail", *rows[1][2:]), rows[2], rows[3]}


CLASHING = "doc_id long, text string, source string, n_shingles string, component_id string, kept string, score string, size string, shard string, file string, segment string, ids string, cls string, part string, node string, grp string, hash string, toxic string"


@pytest.mark.parametrize("operator", ["op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9", "op10", "stages"])
def test_nulls_repeats_and_clashing_columns(spark, operator):
    """Every row comes back once, whatever is null in it or repeats, beside columns of the operators' own names; an empty table gives none."""
    extra = ("x",) * 15
    rows = [(None, None, None, *extra), (None, "a b c d e f", "s", *extra), (1, None, "s", *extra), (1, "a b c d e f", None, *extra), (1, "a b c d e f", None, *extra), (2, "", "s", *extra), (3, "a b c d e f", "s", *[None] * 15)]
    docs, empty = spark.createDataFrame(rows, CLASHING), spark.createDataFrame([], CLASHING)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")

    def ids(table):
        folder = new_folder(spark, "ids")
        idfiles.write_ids(table, BYTES, folder, segment_ids=3)
        return idfiles.with_starts(idfiles.read_ids(spark, folder))

    run = {
        "op1": lambda t: packing.pack(t, WORDS),
        "op2": lambda t: lexicon.encode_decode(t, WORDS),
        "op3": neardup.near_duplicates,
        "op4": fingerprint.compare_with_next,
        "op5": lambda t: tokencount.token_counts(t, BYTES),
        "op6": substring.remove_repeats,
        "op8": ids,
        "op9": sharding.interleave,
        "op10": lambda t: toxicity.toxicity(t, labels),
    }
    if operator == "stages":
        for kept in (substring.without_repeats(docs), toxicity.score(docs, toxicity.fit([], np.zeros(0)), "_toxicity").drop("_toxicity")):
            assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
        assert neardup.one_of_each(docs).count() == 4  # one of the six-word texts, and each row without words
        assert substring.without_repeats(empty).count() == neardup.one_of_each(empty).count() == 0
        return
    out = run[operator](docs).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 1, 1, 1, 2, 3]
    assert run[operator](empty).count() == 0


def test_id_files_with_null_ids(spark):
    from tokenizers import Tokenizer

    tok, folder = Tokenizer.from_file(BYTES), new_folder(spark, "ids")
    rows = [(None, "no id"), (None, None), (5, "five"), (-3, "minus"), (5, "five again")] + [(7, f"many rows of one id {i}") for i in range(40)]
    idfiles.write_ids(table(spark, rows).repartition(3), BYTES, folder, segment_ids=20)
    out = idfiles.with_starts(idfiles.read_ids(spark, folder, with_ids=True)).orderBy("start").collect()
    assert [r.doc_id for r in out] == [-3, 5, 5, *[7] * 40, None, None]
    expected = sorted((repr(i), tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted((repr(r.doc_id), r.ids) for r in out) == expected
    assert [r.start for r in out] == np.cumsum([0, *[r.n_tokens for r in out[:-1]]]).tolist()


def test_a_header_survives_by_its_copy():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 70_000, 200_000).astype(np.uint32)  # more than 65,536 distinct ids in one segment
    blob = rangecoder.encode_segment(np.arange(2), np.array([50_000, 150_000]), ids)
    bad = bytearray(blob)
    bad[30] ^= 1
    with pytest.raises(ValueError, match="damaged segment header"):
        rangecoder.decode_segment(bytes(bad))
    for spare in (rangecoder.header(blob), None):
        whole = blob if spare is None else bytes(bad)
        assert (rangecoder.decode_segment(whole, spare)[2] == ids).all()


def brute_kernel(a, b, decay=toxicity.DECAY):
    """The normalised kernel by walking through all triples of both strings."""

    def triples(s):
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN + 1)):
                    out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + decay ** (k - i)
        return out

    x, y = triples(a), triples(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    own = dot(x, x) * dot(y, y)
    return (dot(x, y) / own**0.5) ** toxicity.POWER if own else 0.0


def test_string_kernel_against_brute_force():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 18))) for _ in range(60)] + ["dimwit", "dimmwit", "ab", ""]
    marks = toxicity.Landmarks(["dimwit", "abcabc", "dcbadcba", "aab"])
    got = marks.kernel(*toxicity._joined([toxicity.letters(w) for w in words]))
    for w, row in zip(words, got):
        strings = [w, *(w[:m] for m in toxicity.BEGINNINGS if len(w) > m)]
        assert row == pytest.approx([sum(brute_kernel(s, mark) for s in strings) for mark in marks.strings], rel=1e-5, abs=1e-9)


def test_nystroem_map_gives_the_kernel_back():
    strings = ["dimwit", "dimwits", "blockhead", "nitwit", "scum", "loweis"]
    marks = toxicity.Landmarks(strings)
    kernel = np.array([[brute_kernel(a, b) for b in strings] for a in strings])
    features = marks.of_strings(*toxicity._joined([toxicity.letters(s) for s in strings])) @ marks.map()
    assert features @ features.T == pytest.approx(kernel, abs=1e-5)
    assert np.linalg.eigvalsh(kernel).min() > 0


def test_scores_are_those_of_the_features():
    rng = np.random.default_rng(2)
    plain = "the plan was good and many people came".split()
    texts = [" ".join(rng.choice(plain + (["dimwit", "blockhead"] if i % 3 == 0 else []), 30)) + (" dimwit" if i % 3 == 0 else "") for i in range(300)]
    model = toxicity.fit(texts, np.array([int(i % 3 == 0) for i in range(300)]))
    texts += ["", "dimwit dimwit dimwit", "d.i.m.w.i.t", "x" * 100_000]
    margin = toxicity.text_features(model.landmarks, texts) @ model.beta + model.bias
    assert model.margins(texts) == pytest.approx(margin, rel=1e-4, abs=1e-4)


def test_pairs_at_similarity_085_meet():
    """No pair of 2,000 at similarity 0.85 is missed by all tables."""
    rng = np.random.default_rng(6)
    value, bounds = [], [0]
    for _ in range(2000):
        both = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        shared = both[: 170]
        for own in (both[170:185], both[185:]):  # 170 of 200 in the union
            value.append(np.unique(np.concatenate([shared, own])))
            bounds.append(bounds[-1] + len(value[-1]))
    _, keys = neardup.signatures(np.concatenate(value), np.array(bounds))
    same = keys[0::2] == keys[1::2]
    assert (same[:, : neardup.KEYS].any(axis=1) & same[:, neardup.KEYS :].any(axis=1)).all()


@pytest.mark.parametrize("block", [400, 3000])
def test_large_groups_of_several_families(spark, block):
    """Groups over a block: families that link only through later documents, and families that stay apart."""
    rng = random.Random(9)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60)] if family % 2 else [f"shared{i}" for i in range(60)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, rows), percent=85, block=block).collect()}
    assert got == brute_classes(rows)


def test_very_long_texts(spark):
    """A text of several megabytes among short ones, whole in every operator."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choices(vocabulary, k=600_000))
    one_word = "z" * 2_000_000
    rows = [(1, long), (2, "short " + long[:400]), (3, long + " tail"), (4, one_word), (5, one_word + " x")]
    docs = table(spark, rows)
    counts = {r.doc_id: r for r in tokencount.token_counts(docs, BYTES).collect()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    for i, t in rows[:3]:
        assert counts[i].n_tokens == len(tok.encode(t, add_special_tokens=False).ids)
    assert counts[4].n_bytes == 2_000_000
    classes = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs).collect()}
    assert removed[3] == (600_001, 600_000) and removed[1][1] == removed[4][1] == 0
    prints = {r.doc_id: r for r in fingerprint.compare_with_next(docs).collect()}
    assert prints[4].n_chars == 2_000_000


def test_search_floor_and_blocks(spark, monkeypatch):
    """Several blocks of queries, of which each is written down before the next, and trees of several levels."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6)) * 10
    rows = [(i, np.round(centres[i % 5] + rng.normal(size=6)).tolist()) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>")
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 8)
    monkeypatch.setattr(covertree, "DATA_BLOCK", 300)
    got = {tuple(r) for r in covertree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 3).collect()}
    data = np.array([v for _, v in rows])
    expected = set()
    for q in range(0, 1500, 50):
        score = data @ data[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:3]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == expected


def test_cover_tree_levels():
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(size=(400, 3)) + c for c in rng.normal(size=(8, 3)) * 40])
    tree = covertree.CoverTree(points, leaf=10)
    assert sum(len(tree.members[k]) for k in range(len(tree.centre)) if not tree.children[k]) == len(points)
    depth = 0
    for k, below in enumerate(tree.children):
        centre = tree.centre[k]
        assert (np.sqrt(((points[tree.members[k]] - centre) ** 2).sum(axis=1)) <= tree.radius[k]).all()
        assert (points == centre).all(axis=1).any()
        inner = [c for c in below if not np.array_equal(tree.centre[c], centre)]
        depth += bool(inner)
        for c in inner:
            assert tree.radius[c] <= tree.radius[k] / 2 * (1 + 1e-6)
            assert all(np.sqrt(((tree.centre[c] - tree.centre[d]) ** 2).sum()) > tree.radius[k] / 2 * (1 - 1e-6) for d in inner if d != c)
    assert depth > 3


def test_open_sequences_meet_in_rounds(spark):
    """Many tasks with few pieces each: bins fill by groups of tasks, gapless and each piece once."""
    from test_tokens import check_packed

    texts = [f"word{i} " * (i % 40) for i in range(300)]
    rows = packing.pack(table(spark, list(enumerate(texts))).repartition(60), WORDS, capacity=256).collect()
    assert check_packed(rows, texts, 256) > 0.85


def test_word_table_forgets_words_met_once():
    from gaugeflow.llm.wordcache import WordTable

    t = WordTable(lambda words: [np.frombuffer(w, np.uint8) for w in words], most=20)
    rng = random.Random(1)
    for k in range(60):
        words = [b"often", b"a word of more than sixteen bytes", b"", *(bytes(rng.choices(range(97, 123), k=rng.randrange(1, 30))) for _ in range(6))]
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size)
        ids, bounds = t.ids(t.find(np.frombuffer(b"".join(words), np.uint8), ends - size, ends))
        assert [bytes(ids[a:b].astype(np.uint8)) for a, b in zip(bounds[:-1], bounds[1:])] == words
    assert t.n < 30




@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1'  sretvlmd\n\t.é日")), max_size=30), max_size=5), st.sampled_from([1, 2, 3, 7]))
def test_composed_count_maps(texts, piece):
    """Maps of pieces of any size, composed, count as the library does."""
    machine = transducer.merger(BYTES)
    expected = [len(library().encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokencount.count_chunk(machine, texts, machine.specials, piece).tolist() == expected


def test_piece_maps_hold_for_every_entry_state():
    """The pretokens listed for an entry state are those that the scanner finds from it, step by step."""
    text = "it's  a 'test' of 12's\n\n x"
    points, offsets = pretokens.code_points([text])
    maps = transducer.PieceMaps(points, offsets, 4)
    sym = transducer.symbols(points, offsets)
    for j in range(len(maps.exit)):
        for q in range(8):
            state, starts = q, []
            for k in range(4 * j, min(4 * j + 4, len(sym))):
                if transducer._ALL_FLAG[sym[k], state]:
                    starts.append(k)
                state = transducer._ALL_TO[sym[k], state]
            listed = maps.start[(maps.slot == 8 * j + q) | (maps.slot == -1 - j)]
            assert sorted(listed.tolist()) == starts and maps.exit[j, q] == state
