"""Packing, encoding, counting and id files against the tokenizers library."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeflow.llm import idfiles, lexicon, packing, pretokens, rangecoder, tokencount, transducer
from gaugeflow.llm.shared import new_folder
from gaugeflow.llm.wordcache import TextEncoder

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [
    None, "", "   ", "a   ", " \t  a  'b 　c", "it's 'tis don't''s 're we're  \n\n 've x'll 5's '", "'", "'s", "''s'd'ref'", " 's  's\n's",
    "<|endoftext|>a<|startoftext|>", "x<|endoftext|> <|endoftext|>", "İstanbul ΣΑΣ é é \x1c\x1f b\x85c 12 3½ ²", "x​ y﻿z", "a\x1d b", "q" * 70 + " " + "z" * 300, "ab " * 5000, "日本語テキスト 🙂🙂 עברית", "a\x00b",
]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def docs(spark, texts, extra=True):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, ids string" if extra else "doc_id long, text string")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_is_the_library(path):
    tok, enc = library(path), TextEncoder(path)
    for _ in range(2):  # the second time from the table
        ids, bounds = enc.encode(HARD)
        for i, t in enumerate(HARD):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids
    small = TextEncoder(path, most=3)  # a table that is emptied all the time
    for t in HARD:
        ids, _ = small.encode([t])
        assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_scanner_and_merger_count_as_the_library(texts):
    tok, machine = library(BYTES), transducer.merger(BYTES)
    n = tokencount.count_chunk(machine, texts, machine.specials)
    assert n.tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    points, offsets = pretokens.code_points(texts)
    assert (transducer.scan_starts(points, offsets, piece=3) == pretokens.byte_level_starts(points, offsets)).all()


def test_merger_forgets_and_starts_anew():
    tok, machine = library(BYTES), transducer.Merger(BYTES, most_states=10)
    for t in ["some words here", "other words there", "ünïcödé words"] * 2:
        assert tokencount.count_chunk(machine, [t], ()).tolist() == [len(tok.encode(t, add_special_tokens=False).ids)]


def test_token_counts(spark):
    tok = library(BYTES)
    got = {r.doc_id: r for r in tokencount.token_counts(docs(spark, HARD), BYTES, limit=5).collect()}
    for i, t in enumerate(HARD):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 5)
    assert tokencount.token_counts(docs(spark, []), BYTES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 20_000))
def test_cut_pieces_fill_reciprocal_slots(n):
    sizes = packing.cut(n)
    assert sum(sizes) == n
    assert all(0 < s <= 2048 for s in sizes)
    assert all(2048 // (2048 // s) - s <= packing.WASTE for s in sizes)


def check_packed(rows, texts, capacity):
    tok = library(WORDS)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    seqs, own = {}, {}
    for r in rows:
        piece = np.array(ids[r.doc_id], "<u4")[r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(piece.tobytes()), len(ids[r.doc_id]))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts, most in ((seqs, None), (own, ids)):
        for key, spans in parts.items():
            at = 0
            for start, n in sorted(spans):
                assert start == at
                at += n
            assert at <= capacity if most is None else at == len(ids[key])
    assert len(own) == len(texts)
    return sum(map(len, ids.values())) / (capacity * len(seqs))


def test_packing(spark):
    texts = HARD + [f"word{i} " * (i % 97) for i in range(400)]
    rows = packing.pack(docs(spark, texts).repartition(3), WORDS).collect()
    assert check_packed(rows, texts, 2048) > 0.9
    small = packing.pack(docs(spark, texts).repartition(3), WORDS, capacity=64, with_ids=True).collect()
    check_packed(small, texts, 64)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in small)
    assert packing.pack(docs(spark, []), WORDS).count() == 0


def test_exact_merge_and_lexicon():
    tok = library(WORDS)
    words = [w.encode() for w in ("hello", "world", "a", "supercalifragilistic", "é", "x" * 200, "hellos", "hell", "日本")]
    merged = lexicon.ExactMerge(WORDS)(words)
    assert [m.tolist() for m in merged] == [tok.encode(w.decode(), add_special_tokens=False).ids for w in words]
    few = [b"hello", b"hellos", b"tell", b"tells", b""]
    blob = lexicon.compile_lexicon(few, [[i, i] for i in range(5)])
    lex = lexicon.mapped(blob, "test" + hashlib.sha256(blob).hexdigest()[:8])
    found = lex.find([*few[:4], b"hell", b"tellsx", b"zzz", b""])
    assert [lex.ids(k).tolist() for k in found[:4]] == [[0, 0], [1, 1], [2, 2], [3, 3]]
    assert (found[4:] < 0).all()
    # Suffixes are shared: five strings, far fewer states than letters.
    assert len(set(lex.to.tolist())) < 12


def test_encode_decode(spark):
    tok = library(WORDS)
    texts = HARD + ["the same words again and again"] * 50
    for size in (0, 5, 1 << 16):
        got = {r.doc_id: r for r in lexicon.encode_decode(docs(spark, texts), WORDS, size).collect()}
        for i, t in enumerate(texts):
            ids = tok.encode(t or "", add_special_tokens=False).ids
            shown = tok.decode(ids, skip_special_tokens=False)
            assert got[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert lexicon.encode_decode(docs(spark, []), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), max_size=60), max_size=8), st.sampled_from([4, 7, 64]))
def test_range_coder_round_trip(sequences, block):
    ids = np.array([x for s in sequences for x in s], np.uint32)
    docs_, sizes = np.arange(len(sequences)), np.array([len(s) for s in sequences], np.int64)
    a, b, c = rangecoder.decode_segment(rangecoder.encode_segment(docs_, sizes, ids, block))
    assert a.tolist() == docs_.tolist() and b.tolist() == sizes.tolist() and c.tolist() == ids.tolist()


def test_range_coder_compresses_and_finds_damage():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 50_000, 400), 50).astype(np.uint32)
    blob = rangecoder.encode_segment(np.arange(1), np.array([len(ids)]), ids)
    assert len(blob) < len(ids) * 0.6
    for at in (30, len(blob) - 500):
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            rangecoder.decode_segment(bytes(bad))


def test_id_files(spark):
    tok, folder = library(BYTES), new_folder(spark, "ids")
    texts = HARD + [f"text {i}" for i in range(100)]
    idfiles.write_ids(docs(spark, texts).repartition(4), BYTES, folder, segment_ids=100)
    rows = idfiles.with_starts(idfiles.read_ids(spark, folder, with_ids=True)).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = new_folder(spark, "ids")
    idfiles.write_ids(docs(spark, []), BYTES, empty)
    assert idfiles.with_starts(idfiles.read_ids(spark, empty)).count() == 0
