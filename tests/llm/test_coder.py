"""Work and limits of the id coder and the word table (operator 8)."""

import numpy as np
import pytest

from gaugeflow.llm import rangecoder
from gaugeflow.llm.wordcache import WordTable


def round_trip(ids, block=rangecoder.BLOCK):
    blob = rangecoder.encode_segment(np.arange(1), np.array([len(ids)]), ids, block)
    return blob, rangecoder.decode_segment(blob)[2]


def test_word_table_adds_words_without_copying_all():
    t, rng, copies, expected = WordTable(lambda words: [np.frombuffer(w, np.uint8) for w in words]), np.random.default_rng(1), 0, []
    for _ in range(100):
        data = rng.integers(97, 123, 50 * 12).astype(np.uint8)
        starts = np.arange(0, len(data), 12)
        before = t.known
        place = t.find(data, starts, starts + 12)
        copies += not np.shares_memory(before, t.known)
        expected.append((place, data))
    assert t.n > 4_900 and copies < 15
    for place, data in expected:
        assert (t.ids(place)[0] == data).all()


def test_encoder_weighs_many_steps_at_once(monkeypatch):
    calls, weights = [], rangecoder._Model._weights
    monkeypatch.setattr(rangecoder._Model, "_weights", lambda self, *rates: calls.append(1) or weights(self, *rates))
    ids = np.random.default_rng(1).integers(0, 300, 8 * rangecoder.BLOCK - 5).astype(np.uint32)
    rangecoder.encode_segment(np.arange(1), np.array([len(ids)]), ids)
    assert 0 < len(calls) < 20


@pytest.mark.parametrize("distinct", [1, 2, 1 << 14, (1 << 14) + 1, 1 << 19, (1 << 20) + 1])
def test_coder_takes_any_number_of_ids(distinct):
    rng = np.random.default_rng(distinct)
    often = rng.integers(0, min(distinct, 50), 40_000)
    ids = np.concatenate([rng.permutation(distinct), np.tile(often[:300], 30), often]).astype(np.uint32) * np.uint32(3)
    blob, back = round_trip(ids, 512 if distinct < 1 << 19 else 128)
    assert (back == ids).all()


def test_large_ids_need_no_large_table():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 3_000, dtype=np.uint64).astype(np.uint32)
    assert (round_trip(ids)[1] == ids).all()


def test_any_damage_is_found():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 30_000).clip(0, 20_000).astype(np.uint32)
    blob, back = round_trip(ids)
    assert (back == ids).all()
    first = len(rangecoder.header(blob))
    for at in rng.integers(first, len(blob), 25).tolist():
        bad = bytearray(blob)
        bad[at : at + 4] = rng.bytes(4)
        if bad == blob:
            continue
        try:  # bits after a block's last number may be any
            assert (rangecoder.decode_segment(bytes(bad))[2] == ids).all()
        except ValueError as error:
            assert "damaged" in str(error)
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.decode_segment(blob[: first + 100])
