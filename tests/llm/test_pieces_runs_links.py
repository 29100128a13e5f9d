"""Piece encoding and span alignment against the libraries, runs against brute force."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeflow.llm import alignment, periodic, piecebpe, pretokens, spans

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "   ", "a   ", " \t  a  'b 　c", "日本語①😀▁a ▁ b▁", "日本語①😀 a b①① ①", "q" * 70 + " " + "z" * 300, "ab " * 500, "\n" * 50, " " * 100, " " * 1000 + "x", "the" * 400, "\n \n  foo", " \n",
    "<s></s><unk><0x41>", "<|endoftext|>a<|startoftext|>", "a\x00b", "é́ ̈ a​﻿", "it's 'tis  'll\n\n  12", "İstanbul ΣΑΣ \x1c\x1f b\x85c",
]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tk():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


def table(spark, texts):
    """With null and repeated ids, and columns whose names clash with those of results."""
    rows = [(None if i % 7 == 6 else i, t, "x", i, "y") for i, t in enumerate(texts)]
    rows += rows[:3]
    return spark.createDataFrame(rows, "doc_id long, text string, pairs string, block long, n_tokens string"), rows


def check_pieces(sp, texts, codec=None):
    codec = codec or piecebpe.codec(PIECES)
    ids, bounds = codec.encode(texts)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        expected = sp.encode(t or "", num_threads=1)
        assert ids[a:b].tolist() == expected, t
        assert codec.model.decode(expected) == sp.decode(expected)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" aetnih▁\n", max_size=80)), max_size=4))
def test_pieces_are_the_library_s(sp, texts):
    check_pieces(sp, texts)


def test_hard_and_long_pieces(sp):
    rng = random.Random(4)
    check_pieces(sp, HARD)
    check_pieces(sp, HARD * 2, piecebpe.PieceCodec(PIECES, most=3))  # a table that is emptied all the time
    for letters in ("ab", "the in", "aetn ", "日本①😀 é", "abcdefgh", "012.,", " x"):
        check_pieces(sp, ["".join(rng.choices(letters, k=n)) for n in (200, 300, 3000, 6000)])
    check_pieces(sp, ["z" * 200_000, " " * 100_000 + "x", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000))])


def test_rounds_alone_give_the_library_s_pieces(sp, monkeypatch):
    """Without the heap, words of any length go through rounds to their end."""
    rng = random.Random(5)
    monkeypatch.setattr(piecebpe, "SLOW", 1 << 40)
    monkeypatch.setattr(piecebpe, "LONG", 20)
    monkeypatch.setattr(piecebpe.PieceBPE, "_heap", lambda self, sym: pytest.fail("heap"))
    check_pieces(sp, ["".join(rng.choices(x, k=700)) for x in ("abcdefghijklmnop", "thein", "ab", "a")], piecebpe.PieceCodec(PIECES))


def test_any_ids_decode_as_the_library_s(sp):
    rng = random.Random(6)
    model = piecebpe.codec(PIECES).model
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300), rng.randrange(3, 259)]) for _ in range(rng.randrange(9))]
        assert model.decode(ids) == sp.decode(ids)


def test_piece_tables(spark, sp):
    docs, rows = table(spark, HARD + ["the same words"] * 20)
    got = sorted(repr(tuple(r)) for r in piecebpe.encode_decode(docs.repartition(3), PIECES).collect())
    expected = []
    for i, t, *_ in rows:
        ids = sp.encode(t or "", num_threads=1)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(map(repr, expected))
    ids = piecebpe.with_ids(docs, PIECES)
    assert sorted((r.ids for r in ids.collect())) == sorted(sp.encode(t or "", num_threads=1) for _, t, *_ in rows)
    shown = sorted(r.text for r in piecebpe.decoded(ids, PIECES).collect())
    assert shown == sorted((t or "").replace("▁", " ") for _, t, *_ in rows)
    assert piecebpe.encode_decode(docs.limit(0), PIECES).count() == 0


def brute_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length, part = i - s + q, w[s : i + q]
            if length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    start, length, period = periodic.runs(np.array([x for t in texts for x in t], np.int64), first)
    return [[(s - a, n, q) for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()) if a <= s < b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def odd_text(rng):
    """Repeated blocks, many of which repeat inside themselves or nearly so (Fibonacci and Thue-Morse words)."""
    fib = [0]
    for _ in range(7):
        fib = [y for x in fib for y in ((0, 1) if x == 0 else (0,))]
    text, letters = [], rng.choice([1, 2, 2, 3, 5, 50])
    for _ in range(rng.randrange(4)):
        block = rng.choice([
            [rng.randrange(letters) for _ in range(rng.randrange(1, 60))], fib[: rng.randrange(1, 35)], [bin(i).count("1") % 2 for i in range(rng.randrange(1, 50))],
            ([rng.randrange(letters) for _ in range(rng.randrange(1, 6))] * 40)[: rng.randrange(5, 40)] + [rng.randrange(letters) for _ in range(rng.randrange(5))],
        ])
        text += (block * 10)[: int(len(block) * rng.choice([0.5, 1.7, 3.5, 4, 4, 4.02, 4.5, 6, 9]))]
        text += [rng.randrange(letters) for _ in range(rng.randrange(12))]
    return text


def test_runs_against_brute_force():
    rng, long = random.Random(7), 0
    for _ in range(250):
        texts = [odd_text(rng) for _ in range(5)]
        for t, runs in zip(texts, found_runs(texts)):
            assert runs == brute_runs(t), t
            long += sum(q >= periodic.SCAN for _, _, q in runs)
    assert long > 300


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.integers(1, 6))
def test_runs_of_small_alphabets(texts, times):
    texts = [t * times for t in texts]
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_runs_of_very_long_texts():
    assert found_runs([[0] * 600_000]) == [[(0, 600_000, 1)]]
    assert found_runs([list(range(1000)) * 600, [9] * 5]) == [[(0, 600_000, 1000)], []]
    assert found_runs([[bin(i).count("1") % 2 for i in range(300_000)]]) == [[]]  # without cubes


def brute_row(doc_id, text):
    raw = (text or "").encode()
    a, b, _ = spans.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    w = [raw[x:y] for x, y in zip(a, b)]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        at = g % n
        p = 1 + (n - at) // (3 + g % 8)
        w = [w[i] if i < at else w[at + (i - at) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = [x for i, x in enumerate(w) if i not in gone]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(kept)), len(w), len(gone))


def test_periodic_tables(spark):
    rng = random.Random(8)
    texts = HARD + ["ha " * 40, "one two three four five " * 9 + "six", " ".join(map(str, list(range(23)) * 5)), *(" ".join(map(str, odd_text(rng))) for _ in range(60))]
    docs, rows = table(spark, texts)
    got = sorted(repr(tuple(r)) for r in periodic.periodic_runs(docs.repartition(3)).collect())
    assert got == sorted(repr(brute_row(i, t)) for i, t, *_ in rows)
    out = {r.doc_id: r for r in periodic.collapse(docs).collect()}
    assert out[len(HARD)].text == "ha" and out[len(HARD)].runs[0].length == 40
    assert out[0].text is None and out[0].runs == [] and out[5].text == HARD[5]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_query_plants(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in periodic.periodic_runs(docs).collect()}
    few = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.n_chars < 2500]
    assert len(few) > 5
    for r in few:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)


def brute_links(tk, sp, texts):
    back = pretokens.byte_alphabet()
    of_a = {i: bytes(back[c] for c in t) for t, i in tk.get_vocab(with_added_tokens=False).items()}
    of_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    found, count = [], Counter()
    for t in texts:
        a, b, raw = tk.encode(" " + (t or ""), add_special_tokens=False).ids, sp.encode(t or "", num_threads=1), (" " + (t or "")).encode()
        groups = []
        if t and b"".join(of_a[i] for i in a) == raw == b"".join(of_b[i] for i in b):
            ends = [np.cumsum([len(of[i]) for i in x]).tolist() for of, x in ((of_a, a), (of_b, b))]
            i = j = 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                groups.append((a[i:x], b[j:y]))
                i, j = x, y
        found.append((a, b, groups))
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for a, b, groups in found:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((*((len(a), len(b)) if groups else (0, 0)), len(groups), len(links), sum(count[k] == most[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out, count, most


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="ab \n日①😀é̈'", max_size=40)), max_size=4))
def test_groups_are_those_of_the_libraries(tk, sp, texts):
    sizes, digests, _, _ = alignment.aligner(BYTES, PIECES).texts(texts)
    assert [(*s, d) for s, d in zip(sizes.tolist(), digests)] == [(*r[:4], r[6]) for r in brute_links(tk, sp, texts)[0]]


def test_aligned_tables(spark, tk, sp):
    docs, rows = table(spark, HARD + ["the same words"] * 20 + ["the samé words 日本①"] * 5)
    texts = [r[1] for r in rows]
    expected, count, most = brute_links(tk, sp, texts)
    expected = sorted(repr((r[0], *e)) for r, e in zip(rows, expected))
    for size in (1, 500, 1 << 20):
        got = alignment.align(docs.repartition(3), BYTES, PIECES, block_bytes=size)
        assert sorted(repr(tuple(r)) for r in got.collect()) == expected
    found = {(r.a, r.b): (r.n, r.best) for r in alignment.translation(docs, BYTES, PIECES).collect()}
    assert found == {k: (n, n == most[k[0]]) for k, n in count.items()}
    assert alignment.align(docs.limit(0), BYTES, PIECES).count() == 0


def test_alignment_of_documents(spark, tk, sp):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    expected, _, _ = brute_links(tk, sp, [r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, BYTES, PIECES).collect()}
    assert got == {r.doc_id: e for r, e in zip(rows, expected)}


def test_one_very_long_text_aligned():
    text = "word日① " * 40_000
    sizes, digests, links, bounds = alignment.Aligner(BYTES, PIECES).texts([text, None, "x"])
    assert sizes[0, 2] > 40_000 and bounds.tolist() == [0, len(links) - sizes[2, 3], len(links) - sizes[2, 3], len(links)] and digests[1] == ""


def test_fingerprints_of_one_id_spread_over_ranges(spark):
    """Rows that all have no id keep the order of their texts over several ranges."""
    from gaugeflow.llm import fingerprint

    texts = sorted(f"text {i % 90} {'x' * (i % 70)}" for i in range(400))
    docs = spark.createDataFrame([(None, t) for t in texts] + [(7, "first")], "doc_id long, text string").repartition(6)
    rows = fingerprint.compare_with_next(docs).collect()
    own = {r.fingerprint: r for r in rows}
    lanes = [fingerprint.compare_with_next(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().fingerprint for t in (texts[0], texts[-1])]
    assert len(rows) == 401 and own[lanes[0]].near_next > 0 and own[lanes[1]].n_chars == len(texts[-1])
    edited = sorted(r.edited_sha256 for r in rows)
    order = ["first", *texts]
    expected = []
    for t, after in zip(order, [*order[1:], order[0]]):
        n = len(t) // 3
        expected.append(hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())
    assert edited == sorted(expected)


def test_very_long_texts_of_the_other_operators(spark):
    """A word of 200,000 letters, one of random letters and 150,000 words: ids as the library's, and a score."""
    from tokenizers import Tokenizer

    from gaugeflow.llm import idfiles, lexicon, packing, toxicity
    from gaugeflow.llm.shared import new_folder

    rng, words = random.Random(9), public_tokenizers.path("word_bpe_49k.json")
    texts = ["z" * 200_000, "".join(rng.choices("abcdefgh", k=60_000)), " ".join(f"word{rng.randrange(5000)}" for _ in range(150_000)), "日本" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_words = [Tokenizer.from_file(words).encode(t, add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: r for r in lexicon.encode_decode(docs, words, 100).collect()}
    packed = packing.pack(docs, words).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(x) + 1 for i, x in enumerate(by_words)}
    for i, ids in enumerate(by_words):
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    folder = new_folder(spark, "ids")
    idfiles.write_ids(docs, BYTES, folder)
    for r in idfiles.read_ids(spark, folder).collect():
        ids = [*Tokenizer.from_file(BYTES).encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    model = toxicity.fit([f"you awful dimwit {i}" if i % 3 == 0 else f"a fine day {i}" for i in range(90)], np.array([int(i % 3 == 0) for i in range(90)]))
    scores = {r.doc_id: r.score for r in toxicity.score(docs.unionByName(spark.createDataFrame([(9, "dimwit " * 50_000)], "doc_id long, text string")), model).collect()}
    assert all(s < 0.7 for i, s in scores.items() if i < 9) and scores[9] > 0.7


def test_blocks_are_stored_and_joined_in_bounded_pieces(spark):
    """At most eight blocks in a file; what Python alone reads of them is packed, and no task of the join is given many."""
    import glob

    import pyarrow.parquet as pq

    from gaugeflow.llm.shared import made

    for x in ([], [0, 255], [256], [1 << 16, 3], [1 << 33]):
        raw = alignment._packed(np.array(x, np.int64))
        assert alignment._unpacked(raw).tolist() == x and len(raw) <= 1 + 8 * len(x)
    docs = spark.createDataFrame([(i, f"some words {i} and more words {i % 7}") for i in range(60)], "doc_id long, text string").coalesce(1)
    at_once, before = "spark.sql.execution.arrow.maxRecordsPerBatch", set(made())
    spark.conf.set(at_once, "4")
    try:
        got = sorted(map(tuple, alignment.align(docs, BYTES, PIECES, block_bytes=1).collect()))
    finally:
        spark.conf.unset(at_once)
    folder = next(p for p in made() if p not in before and "/blocks-" in p).removeprefix("file://")
    rows = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{folder}/*.parquet")]
    assert max(rows) <= 8 and sum(rows) == 15
    assert got == sorted(map(tuple, alignment.align(docs, BYTES, PIECES).collect()))
