import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import ODD
from tracemill.llm import huffman, packing
from tracemill.llm.textarrays import hashed_words, row_chunks, utf8, words
from tracemill.llm.tokens import KeySlots, UnitEncoder

P = pytest.importorskip("public_tokenizers")


def json_of(name):
    with open(P.path(name), encoding="utf-8") as f:
        return f.read()


def test_words_match_splitting():
    data, offsets = utf8(pa.array(ODD))
    starts, ends, first = words(data, offsets)
    for i, text in enumerate(ODD):
        want = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
        got = [data[a:b].tobytes() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == want
    h, _ = hashed_words(*utf8(pa.array(["Ab ab", "AB"])))
    assert len(set(h.tolist())) == 1
    assert [(a, b) for a, b in row_chunks(np.array([0, 5, 5, 9, 30]), 9)] == [(0, 3), (3, 4)]


def test_key_slots():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 3000, dtype=np.uint64))
    slots = KeySlots(12)
    slots.add(keys[:1500])
    slots.add(keys[1500:2500])
    assert slots.find(keys).tolist() == [*range(2500), *[-1] * (len(keys) - 2500)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_encode_as_whole_texts(name):
    rnd = random.Random(3)
    parts = ["a", "Bc", " ", "  ", "\n", "'s", "é", "́", "5", "<|", "!", "​", "\x1c", "\x0b", "Σ", "　", "\x85", "|", "ü", "ß"]
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(800)]
    enc = UnitEncoder(json_of(name))
    got = [ids[at[i] : at[i + 1]].tolist() for lo, hi, ids, at in enc.chunks(pa.array(texts), 2) for i in range(hi - lo)]
    want = [e.ids + [2] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


class NoOffsets:
    """A tokenizer that refuses the calls which also track character offsets: those take a sixth more time."""

    def __init__(self, tokenizer):
        self.normalizer, self.encode_batch_fast = tokenizer.normalizer, tokenizer.encode_batch_fast


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_are_encoded_without_offsets(name):
    texts = [t or "" for t in ODD] + ["one two,\n\nthree ", "", " \t"]
    enc = UnitEncoder(json_of(name))
    want = [e.ids + [2] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    enc.tokenizer = NoOffsets(enc.tokenizer)
    assert [ids[at[i] : at[i + 1]].tolist() for lo, hi, ids, at in enc.chunks(pa.array(texts), 2) for i in range(hi - lo)] == want


@pytest.mark.parametrize("n, symbols", [(0, 5), (1, 1), (3, 1), (64, 2), (70, 3), (5000, 40), (60000, 50000)])
def test_codes_are_laid_out_bit_by_bit(n, symbols):
    ids = (np.random.default_rng(n).zipf(1.3, n) % symbols).astype("<u2")
    lengths = huffman.code_lengths(np.bincount(ids, minlength=symbols))
    codes = huffman.canonical_codes(lengths)
    bits, marks = huffman.encode_bits(ids, lengths, codes)
    spelt = [f"{codes[i]:0{lengths[i]}b}" for i in ids]
    whole = "".join(spelt)
    assert bits == bytes(int(whole[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(whole), 8))
    assert marks.tolist() == [sum(map(len, spelt[:i])) for i in range(0, n, huffman.STRIDE)]


def plain_first_fit(sizes, capacity):
    room, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= sizes[i]
        out[i] = b
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_decreasing(seed):
    sizes = np.random.default_rng(seed).integers(1, 101, 137)
    bins, _ = packing.first_fit_decreasing(sizes, 100)
    assert bins.tolist() == plain_first_fit(sizes.tolist(), 100)
    assert packing.first_fit_decreasing(np.zeros(0, np.int64), 100)[0].tolist() == []


def test_packing_places_every_id_once(spark, odd, none):
    j = json_of("word_bpe_49k.json")
    enc = UnitEncoder(j)
    rows = packing.pack_documents(odd, j, capacity=256, group_size=8, with_ids=True).collect()
    want = sorted(tuple(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for t in [*ODD, "one", "no id"])
    by_seq = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 1024
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        ends = [0]
        for offset, length in sorted(spans):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 256
    assert sum(r.length for r in rows) == sum(map(len, want))
    ids3 = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 10)
    assert np.frombuffer(b"".join(x for _, x in ids3), "<u4").tolist() == enc.tokenizer.encode(ODD[10], add_special_tokens=False).ids + [2]
    assert packing.pack_documents(none, j).count() == 0
    padded = packing.sequences(packing.pack_documents(odd, j, capacity=256, with_ids=True), capacity=256).collect()
    assert all(len(r.ids) // 4 == (r.used if r.used & (r.used - 1) == 0 else 256) for r in padded)


def huffman_cost(counts):
    import heapq

    h = [int(c) for c in counts if c]
    heapq.heapify(h)
    cost = 0
    while len(h) > 1:
        a, b = heapq.heappop(h), heapq.heappop(h)
        cost += a + b
        heapq.heappush(h, a + b)
    return cost


@pytest.mark.parametrize("seed", range(4))
def test_code_lengths_are_optimal_and_limited(seed):
    counts = (np.random.default_rng(seed).pareto(0.6, 300) * 10).astype(np.int64)
    lengths = huffman.code_lengths(counts, 40)
    assert (lengths * counts).sum() == huffman_cost(counts)
    short = huffman.code_lengths(counts, 9)
    used = counts > 0
    assert short.max() <= 9 and sum(2.0 ** -int(x) for x in short[used]) == 1 and (short[~used] == 0).all()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


@pytest.mark.parametrize("n", [1, 511, 512, 513, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 200).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids))
    bits, marks = huffman.encode_bits(ids, lengths, huffman.canonical_codes(lengths))
    assert huffman.decode_bits(bits, marks, n, huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_stored_ids_read_back(spark, odd, none, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 64)
    j = json_of("byte_bpe_50k.json")
    tok = UnitEncoder(j).tokenizer
    blocks, lengths = huffman.store_tokens(odd, j)
    rows = huffman.read_blocks(blocks, lengths, with_ids=True).orderBy("start").collect()
    start = 0
    for r in rows:
        assert r.start == start and zlib.crc32(r.ids) == r.ids_crc32
        start += r.n_tokens
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x))
    texts = {i: t for i, t in enumerate(ODD)} | {None: "no id"}
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
    blocks, lengths = huffman.store_tokens(none, j)
    assert huffman.read_blocks(blocks, lengths).count() == 0
