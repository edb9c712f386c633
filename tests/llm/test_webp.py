import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tracemill.llm import webp, webpbatch


class Writer(webp.BitWriter):
    """Writes VP8L streams with any transform, code, reference or cache, for the decoder to read."""

    def code(self, lengths):
        used = [s for s, x in enumerate(lengths) if x]
        if len(used) <= 2 and all(lengths[s] == 1 for s in used) and all(s < 256 for s in used):
            self.put(1, 1), self.put(len(used) - 1 if used else 0, 1), self.put(1, 1)
            for s in used or [0]:
                self.put(s, 8)
        else:
            self.put(0, 1), self.put(15, 4)
            for k in webp.LENGTH_CODE_ORDER:
                self.put(4 if k < 16 else 0, 3)
            self.put(0, 1)
            for x in lengths:
                self.put(webp.reversed_bits(int(x), 4), 4)
        return {s: (webp.reversed_bits(c, n), n) if len(used) > 1 else (0, 0) for s, n, c in webp.canonical(np.array(lengths))}

    def pixels(self, symbols, alphabet_extra=0, cache_bits=0, top=True):
        """symbols: ('lit', a, r, g, b), ('ref', length, distance code) or ('cache', index)."""
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if top:
            self.put(0, 1)
        use = [dict() for _ in range(5)]
        plan = []
        for s in symbols:
            if s[0] == "lit":
                plan.append([(0, s[3], None), (1, s[2], None), (2, s[4], None), (3, s[1], None)])
            elif s[0] == "ref":
                (lp, lx), (dp, dx) = prefix(s[1]), prefix(s[2])
                plan.append([(0, 256 + lp, lx), (4, dp, dx)])
            else:
                plan.append([(0, 280 + s[1], None)])
            for which, sym, _ in plan[-1]:
                use[which][sym] = use[which].get(sym, 0) + 1
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        codes = []
        for counts, size in zip(use, sizes):
            from tracemill.llm.huffman import code_lengths

            codes.append(self.code(code_lengths(np.array([counts.get(i, 0) for i in range(size)]), 15)))
        for steps in plan:
            for which, sym, extra in steps:
                self.put(*codes[which][sym])
                if extra:
                    self.put(*extra)

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def prefix(value):
    """(prefix code, (extra bits' value, their count)) of a length or distance."""
    if value <= 4:
        return value - 1, None
    v = value - 1
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, (v & ((1 << (top - 1)) - 1), top - 1)


def header(w, width, height):
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)


def literals(argb):
    return [("lit", *(int(v) for v in p)) for p in argb.reshape(-1, 4)]


def image(rng, height, width, colours=None):
    if colours:
        return rng.integers(0, 256, (colours, 4))[rng.integers(0, colours, (height, width))].astype(np.int32)
    base = np.cumsum(rng.integers(-3, 4, (height, width, 4)), 1) + 120
    return (base & 255).astype(np.int32)


def rgba(argb):
    return argb[..., [1, 2, 3, 0]].astype(np.uint8)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    argb = image(np.random.default_rng(mode), 9, 11)
    bits = 2
    modes = np.full((3, 3), mode)
    w = Writer()
    header(w, 11, 9)
    w.put(1, 1), w.put(webp.PREDICTOR, 2), w.put(bits - 2, 3)
    w.pixels([("lit", 255, 0, mode, 0)] * 9, top=False)
    w.put(0, 1)
    w.pixels(literals(webp._walk_predictor(argb, modes, bits, True)))
    assert (webp.decode_vp8l(w.bytes()) == rgba(argb)).all()


def test_predictor_rules_by_hand():
    left, up, up_left, up_right = (np.array([v] * 4, np.int32) for v in (10, 200, 50, 90))
    want = {0: [255, 0, 0, 0], 1: 10, 2: 200, 3: 90, 4: 50, 5: 125, 6: 30, 7: 105, 8: 125, 9: 145, 10: 87, 12: 160, 13: 132}
    for mode, value in want.items():
        assert webp.predicted(mode, left, up, up_left, up_right).tolist() == (value if isinstance(value, list) else [value] * 4)
    # the gradient at the left is the larger, so the upper pixel is nearer to the prediction
    assert webp.predicted(11, left, up, up_left, up_right).tolist() == [200] * 4


def test_cross_colour_and_subtract_green():
    rng = np.random.default_rng(5)
    argb = image(rng, 8, 8)
    element = np.array([255, 17, 240, 130])
    elements = np.broadcast_to(element, (2, 2, 4))
    turned = webp._cross(argb, elements, 2, True)
    w = Writer()
    header(w, 8, 8)
    w.put(1, 1), w.put(webp.SUBTRACT_GREEN, 2)
    w.put(1, 1), w.put(webp.CROSS_COLOUR, 2), w.put(0, 3)
    w.pixels(literals(elements.copy()), top=False)
    w.put(0, 1)
    green = argb.copy()
    green[..., 1], green[..., 3] = (argb[..., 1] - argb[..., 2]) & 255, (argb[..., 3] - argb[..., 2]) & 255
    turned = webp._cross(green, elements, 2, True)
    w.pixels(literals(turned))
    assert (webp.decode_vp8l(w.bytes()) == rgba(argb)).all()


@pytest.mark.parametrize("colours", [2, 3, 13, 60])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 4))
    index = rng.integers(0, colours, (5, 13))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    width = -(-13 >> bits)
    packed = np.zeros((5, width), int)
    for x in range(13):
        packed[:, x >> bits] |= index[:, x] << ((x & ((1 << bits) - 1)) * (8 >> bits))
    w = Writer()
    header(w, 13, 5)
    w.put(1, 1), w.put(webp.PALETTE, 2), w.put(colours - 1, 8)
    w.pixels(literals(np.diff(table, axis=0, prepend=np.zeros((1, 4), int)) & 255), top=False)
    w.put(0, 1)
    w.pixels([("lit", 255, 0, int(g), 0) for g in packed.reshape(-1)])
    assert (webp.decode_vp8l(w.bytes()) == rgba(table[index])).all()


def test_references_and_cache():
    rng = random.Random(1)
    width, pixels, symbols, cache = 10, [], [], [0] * 16
    noted = 0
    pick = [(255, rng.randrange(256), rng.randrange(256), rng.randrange(256)) for _ in range(12)]
    whole = lambda p: p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]
    slot = lambda v: ((webp.HASH_MULTIPLIER * v) & 0xFFFFFFFF) >> 28
    while len(pixels) < 200:
        while noted < len(pixels):
            cache[slot(whole(pixels[noted]))] = whole(pixels[noted])
            noted += 1
        p = rng.choice(pick)
        if len(pixels) > 20 and len(pixels) < 180 and rng.random() < 0.3:
            code = rng.choice([1, 2, 3, 4, 130, 135])
            back = code - 120 if code > 120 else max(1, webp.NEAR[code - 1][0] + webp.NEAR[code - 1][1] * width)
            length = rng.choice([1, 3, 7, 18])
            symbols.append(("ref", length, code))
            for _ in range(length):
                pixels.append(pixels[-back])
        elif cache[slot(whole(p))] == whole(p):
            symbols.append(("cache", slot(whole(p))))
            pixels.append(p)
        else:
            symbols.append(("lit", p[0], p[1], p[2], p[3]))
            pixels.append(p)
    while len(pixels) % width:
        symbols.append(("lit", *pick[0]))
        pixels.append(pick[0])
    w = Writer()
    header(w, width, len(pixels) // width)
    w.put(0, 1)
    w.pixels(symbols, cache_bits=4)
    assert {s[0] for s in symbols} == {"lit", "ref", "cache"}
    assert (webp.decode_vp8l(w.bytes()).reshape(-1, 4) == rgba(np.array(pixels))).all()


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-1] == (8, 7)


def padded(data):
    return np.frombuffer(data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0"), np.uint8)


def payloads(seed):
    """Texts, repeats, noise, few values, one value, runs over several images."""
    rng = np.random.default_rng(seed)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(300)]
    text = lambda n: b" ".join(words[k] for k in rng.integers(0, 300, n))
    raw = [b"", b"a", text(5), text(700), text(4000), text(40) * 90, bytes(rng.integers(0, 256, 5000).astype(np.uint8)), b"ab" * 3000, b"abcdefghijklmnop" * 40, b"\0" * 9000, bytes(range(256)) * 3]
    fib = [1, 1]
    while sum(fib) < 3900:
        fib.append(fib[-1] + fib[-2])
    skewed = np.repeat(np.arange(len(fib)), fib).astype(np.uint8)  # a Huffman tree of one symbol a level
    rng.shuffle(skewed)
    return [padded(x) for x in (*raw, skewed.tobytes(), *(text(int(n)) for n in rng.integers(0, 200, 20)))]


def test_lockstep_agrees_with_the_loop():
    held = payloads(1)
    media = webpbatch.encode_payloads(held)
    uses = set()
    for payload, value in zip(held, media, strict=True):
        streams = list(webp.images(value))
        decoded = webpbatch.decode_streams(streams)
        assert webp.samples([d.pixels for d in decoded]) == payload.tobytes()
        for stream, d in zip(streams, decoded, strict=True):
            r = webp.BitReader(stream)
            width, height = webp.read_size(r)
            steps, inner = webp.read_steps(r, width, height)
            tally = webp.Uses()
            argb = webp.read_body(r, webp.read_head(r, inner, height, True), inner, height, tally).reshape(height, inner)
            assert (webp.finished(argb, steps) == d.pixels).all() and tally.references == d.references
            uses |= {k for k, on in (("codes", d.uneven_codes), ("references", d.references), ("palette", webp.PALETTE in d.transforms)) if on}
    assert uses == {"codes", "references", "palette"}
    every = webpbatch.decode_streams([x for value in media for x in webp.images(value)])
    assert webp.samples([d.pixels for d in every]) == b"".join(p.tobytes() for p in held)
    assert sum(map(len, media)) < 0.7 * sum(map(len, held))


def test_streams_of_all_kinds_decode_together():
    """Streams for the lockstep and for the general loop, mixed, come back in order."""
    rng = np.random.default_rng(2)
    plain = next(webp.images(webpbatch.encode_payloads([padded(b"some text " * 30)])[0]))
    argb = image(rng, 4, 5)
    w = Writer()
    header(w, 5, 4)
    w.put(0, 1)
    w.pixels(literals(argb))
    got = webpbatch.decode_streams([plain, w.bytes(), plain])
    assert (got[1].pixels == rgba(argb)).all() and (got[0].pixels == got[2].pixels).all()
    assert webpbatch.decode_streams([]) == []


def test_code_lengths_of_few_counts():
    rng = random.Random(3)
    for _ in range(200):
        counts = [rng.choice([1, 2, 3, 50, 10**6]) ** rng.choice([1, 2]) for _ in range(rng.randint(2, 40))]
        for limit in (6, 7, 15):
            if len(counts) <= 1 << limit:
                lengths = webpbatch.lengths_of(counts, limit)
                assert sum(2.0**-x for x in lengths) == 1 and max(lengths) <= limit


def test_extended_containers():
    stream = next(webp.images(webpbatch.encode_payloads([padded(b"x" * 100)])[0]))
    chunk = lambda name, body: name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    body = b"WEBP" + chunk(b"VP8X", bytes(10)) + chunk(b"ICCP", b"abc") + chunk(b"VP8L", stream) + chunk(b"EXIF", b"e")
    assert list(webp.images(chunk(b"RIFF", body))) == [stream]
    frames = b"WEBP" + chunk(b"VP8X", bytes(10)) + chunk(b"ANIM", bytes(6)) + chunk(b"ANMF", bytes(16) + chunk(b"VP8L", stream)) * 2
    assert list(webp.images(chunk(b"RIFF", frames))) == [stream, stream]


def test_damaged_streams_raise():
    stream = next(webp.images(webpbatch.encode_payloads([padded(bytes(range(200)) * 3)])[0]))
    for bad in (b"", stream[:5], stream[:-8], b"\x00" + stream[1:]):
        with pytest.raises(ValueError):
            webp.decode_vp8l(bad)
        with pytest.raises(ValueError):
            webpbatch.decode_streams([stream, bad])
    with pytest.raises(ValueError):
        list(webp.images(b"RIFFxxxxWEBPVP8 "))


def test_text_column(spark, odd, none):
    rows = webp.text_media(odd).collect()
    texts = dict(enumerate(ODD)) | {None: "no id"}
    assert len(rows) == len(ODD) + 2
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (4, 5)}) == 1
    assert webp.text_media(none).count() == 0
    pixels = webp.pixel_arrays(webp.store_texts(odd.where("doc_id = 4"))).first()
    assert bytes(pixels.pixels)[1::4].rstrip(b"\0").decode() == ODD[4] and pixels.width == 64


def test_texts_over_one_image():
    payload = np.random.default_rng(4).integers(0, 99, webpbatch.IMAGE_SAMPLES * 2 + 640).astype(np.uint8)
    media = webpbatch.encode_payloads([payload])[0]
    parts = webp.media_to_pixels(media)
    assert [p.shape for p in parts] == [(webpbatch.ROWS, 64, 4)] * 2 + [(10, 64, 4)] and webp.samples(parts) == payload.tobytes()
