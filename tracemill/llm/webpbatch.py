"""Many small lossless WebP images at once: an encoder of byte samples, and a decoder in which all images advance together.

A payload is cut into images of WIDTH x ROWS pixels, one sample a pixel, in
green. Each image has its own prefix codes; repeats of MATCH bytes or more are
back-references; an image of up to sixteen values takes a palette, several
pixels in one, where that is shorter.

Decoding reads each stream's header by itself. The streams whose red, blue and
alpha are constant and that use neither colour cache nor meta prefix codes are
then decoded in lockstep: at every step each image decodes one symbol through
its own tables, with numpy over images. Copies are resolved afterwards for all
images together, by following sources to literals. All other streams go
through the general loop of ``webp``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tracemill.llm import webp
from tracemill.llm.textarrays import mix

WIDTH, ROWS = 64, 64
IMAGE_SAMPLES = WIDTH * ROWS
#: The least length of a back-reference, and the most that the format allows.
MATCH, LONGEST = 8, 4096
#: Samples that are encoded, and pixels that are decoded, together; positions take PLACE_BITS bits.
CHUNK, PLACE_BITS = 2 << 20, 22
SYMBOLS, DISTANCES, LIMIT = 280, 40, 15


def _reversed16() -> np.ndarray:
    v = np.arange(1 << 16, dtype=np.uint32)
    out = np.zeros_like(v)
    for k in range(16):
        out |= ((v >> np.uint32(k)) & np.uint32(1)) << np.uint32(15 - k)
    return out


REVERSED = _reversed16()


def _near_distance(width: int) -> np.ndarray:
    """The distance in pixels of each short distance code, by code."""
    return np.array([0, *(max(1, x + y * width) for x, y in webp.NEAR)], np.int64)


def _near_code() -> np.ndarray:
    """The least short code for each distance, 0 where there is none."""
    near = _near_distance(WIDTH)
    out = np.zeros(int(near.max()) + 1, np.int64)
    for code in range(len(near) - 1, 0, -1):
        out[near[code]] = code
    return out


NEAR_CODE = _near_code()


# codes

def lengths_of(counts: list[int], limit: int) -> list[int]:
    """Code lengths, of at most ``limit``, for two or more positive counts: Huffman's over two queues; too deep a tree is built again of flattened counts."""
    n = len(counts)
    while True:
        order = sorted(range(n), key=counts.__getitem__)
        weight = [counts[k] for k in order] + [0] * (n - 1)
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if inner >= node or (leaf < n and weight[leaf] <= weight[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                total += weight[k]
                parent[k] = node
            weight[node] = total
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= limit:
            out = [0] * n
            for k, at in enumerate(order):
                out[at] = depth[k]
            return out
        counts = [(c >> 1) | 1 for c in counts]


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code, as it stands in the stream, of each symbol of each row of lengths."""
    rows, size = lengths.shape
    tally = np.stack([(lengths == k).sum(1) for k in range(LIMIT + 1)], 1)
    tally[:, 0] = 0
    begin = np.zeros((rows, LIMIT + 1), np.int64)
    for k in range(1, LIMIT + 1):
        begin[:, k] = (begin[:, k - 1] + tally[:, k - 1]) << 1
    order = np.argsort(lengths, axis=1, kind="stable")
    by = np.take_along_axis(lengths, order, 1).astype(np.int64)
    before = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(tally, 1)[:, :-1]], 1) + (size - tally.sum(1))[:, None]
    code = np.take_along_axis(begin, by, 1) + np.arange(size) - np.take_along_axis(before, by, 1)
    out = np.zeros((rows, size), np.uint32)
    np.put_along_axis(out, order, np.where(by > 0, REVERSED[np.where(by > 0, code, 0) & 0xFFFF] >> (16 - by).astype(np.uint32), 0).astype(np.uint32), 1)
    return out


@lru_cache(4096)
def _codes(lengths: tuple[int, ...]) -> dict[int, int]:
    return {s: webp.reversed_bits(c, n) for s, n, c in webp.canonical(np.array(lengths))}


def code_bits(lengths: list[int]) -> tuple[int, int]:
    """(bits, their count) that describe a code; no length at all is the code of symbol 0, one length that of its symbol."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2:
        s = used[0] if used else 0
        return (1 | s << 3, 4) if s < 2 else (1 | 1 << 2 | s << 3, 11)
    steps: list[tuple[int, int, int]] = []
    at = 0
    for s in used:
        gap = s - at
        while gap >= 3:
            run = min(gap, 138)
            steps.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
            gap -= run
        steps += [(0, 0, 0)] * gap
        steps.append((lengths[s], 0, 0))
        at = s + 1
    tally = [0] * 19
    for s, _, _ in steps:
        tally[s] += 1
    kinds = [s for s in range(19) if tally[s]]
    small = [0] * 19
    if len(kinds) > 1:
        for s, n in zip(kinds, lengths_of([tally[s] for s in kinds], 7), strict=True):
            small[s] = n
    codes = _codes(tuple(small))
    shown = small if len(kinds) > 1 else [int(s == kinds[0]) for s in range(19)]
    last = max(4, 1 + max(k for k, s in enumerate(webp.LENGTH_CODE_ORDER) if shown[s]))
    value, n = (last - 4) << 1, 5
    for s in webp.LENGTH_CODE_ORDER[:last]:
        value |= shown[s] << n
        n += 3
    room = max(1, -(-(max(0, len(steps) - 2)).bit_length() // 2)) - 1
    value |= 1 << n | room << (n + 1) | (len(steps) - 2) << (n + 4)
    n += 4 + 2 + 2 * room
    for s, extra, width in steps:
        if small[s]:
            value |= codes[s] << n
            n += small[s]
        value |= extra << n
        n += width
    return value, n


# encoder

def prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits' value, their count) of lengths or distance codes."""
    u = np.maximum(v - 1, 1)
    top = np.frexp(u.astype(float))[1].astype(np.int64) - 1
    small = v <= 4
    width = np.where(small, 0, top - 1)
    second = (u >> np.maximum(top - 1, 0)) & 1
    return np.where(small, v - 1, 2 * top + second), np.where(small, 0, u & ((1 << np.maximum(width, 0)) - 1)), width


def references(data: np.ndarray, image: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of back-references, first come first served: each repeats the nearest earlier MATCH bytes of its image, and what follows alike."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(MATCH, np.uint8)])
    key = np.ndarray((n,), "<u8", padded.data, strides=(1,)).copy()  # the MATCH bytes from each place on
    at = np.flatnonzero(np.arange(n) + MATCH <= ends[image])
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = (mix(key[at] ^ mix(image[at].astype(np.uint64) + np.uint64(1))) & ~low) | at.astype(np.uint64)
    packed.sort()
    place, same = (packed & low).astype(np.int64), (packed[1:] ^ packed[:-1]) <= low
    later, earlier = place[1:][same], place[:-1][same]
    sure = (key[later] == key[earlier]) & (image[later] == image[earlier])
    distance = np.zeros(n + 1, np.int64)
    distance[later[sure]] = (later - earlier)[sure]
    change = np.concatenate([[0], np.flatnonzero(distance[1:] != distance[:-1]) + 1])
    ends_of = np.concatenate([change[1:], [n + 1]])
    real = distance[change] > 0
    found, covered = [], 0
    for a, e, d in zip(change[real].tolist(), ends_of[real].tolist(), distance[change[real]].tolist(), strict=True):
        a, e = max(a, covered), e + MATCH - 1
        if e - a >= MATCH:
            covered = e
            found += [(k, min(LONGEST, e - k), d) for k in range(a, e, LONGEST)]
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def _scatter(items: np.ndarray, bits: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Bytes of a bit stream with each item's bits from its place on; items have up to 40 bits."""
    value = items.astype(np.uint64) << (at & 7).astype(np.uint64)
    byte = at >> 3
    most = int(((at & 7) + bits).max(initial=0))
    out = np.zeros(size + 8)
    for k in range(-(-most // 8)):
        out += np.bincount(byte + k, ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(float), size + 8)
    return out[:size].astype(np.uint8)


def encode_samples(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A VP8L stream for each image; ``data`` holds fewer than 1 << PLACE_BITS samples of images of whole rows in a row."""
    ends = np.cumsum(sizes)
    rows, n = len(sizes), len(data)
    image = np.repeat(np.arange(rows), sizes)
    place, length, distance = references(data, image, ends)
    free = np.ones(n + 1, np.int64)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + length, -1)
    free = np.cumsum(covered)[:n] == 0
    token = free.copy()
    token[place] = True
    at = np.flatnonzero(token)
    which = np.full(n, -1, np.int64)
    which[place] = np.arange(len(place))
    ref = which[at] >= 0
    near = np.where(distance < len(NEAR_CODE), NEAR_CODE[np.minimum(distance, len(NEAR_CODE) - 1)], 0)
    l_sym, l_extra, l_bits = prefixed(length)
    d_sym, d_extra, d_bits = prefixed(np.where(near > 0, near, distance + 120))
    symbol = data[at].astype(np.int64)
    symbol[ref] = 256 + l_sym[which[at[ref]]]
    of = image[at]
    green = np.bincount(of * SYMBOLS + symbol, minlength=rows * SYMBOLS).reshape(rows, SYMBOLS)
    dist = np.bincount(image[place] * DISTANCES + d_sym, minlength=rows * DISTANCES).reshape(rows, DISTANCES)
    heads, tables = [], []
    for tally in (green, dist):
        lengths = np.zeros(tally.shape, np.uint8)
        described = []
        for r in range(rows):
            used = np.flatnonzero(tally[r])
            shown = [0] * tally.shape[1]
            if len(used) > 1:
                own = lengths_of(tally[r, used].tolist(), LIMIT)
                lengths[r, used] = own
                for s, x in zip(used.tolist(), own, strict=True):
                    shown[s] = x
            elif len(used):
                shown[int(used[0])] = 1
            described.append(code_bits(shown))
        heads.append(described)
        tables.append((lengths, reversed_codes(lengths)))
    constant, alpha = code_bits([1]), code_bits([0] * 255 + [1])
    head_bytes, head_bits = [], []
    for r in range(rows):
        value, bits = 0x2F | (WIDTH - 1) << 8 | (int(sizes[r]) // WIDTH - 1) << 22 | 1 << 36, 8 + 14 + 14 + 1 + 3 + 3
        for v, k in (heads[0][r], constant, constant, alpha, heads[1][r]):
            value |= v << bits
            bits += k
        head_bytes.append(value.to_bytes(-(-bits // 8), "little"))
        head_bits.append(bits)
    # the items of all images: a token's symbol with its length's extra bits, and after a reference its distance
    items, widths = tables[0][1][of, symbol].astype(np.uint64), tables[0][0][of, symbol].astype(np.int64)
    own = which[at[ref]]
    items[ref] |= l_extra[own].astype(np.uint64) << widths[ref].astype(np.uint64)
    widths[ref] += l_bits[own]
    second = tables[1][1][image[place], d_sym].astype(np.uint64) | d_extra.astype(np.uint64) << tables[1][0][image[place], d_sym].astype(np.uint64)
    second_bits = tables[1][0][image[place], d_sym].astype(np.int64) + d_bits
    slot = np.arange(len(at)) + np.concatenate([[0], np.cumsum(ref)[:-1]]) if len(at) else np.zeros(0, np.int64)
    total = len(at) + int(ref.sum())
    every, bits, owner = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    every[slot], bits[slot], owner[slot] = items, widths, of
    after = slot[ref] + 1
    every[after], bits[after], owner[after] = second[own], second_bits[own], of[ref]
    body = np.bincount(owner, bits, rows).astype(np.int64)
    size = -(-(np.array(head_bits) + body) // 8)
    base = np.concatenate([[0], np.cumsum(size)])
    first = np.concatenate([[0], np.cumsum(body)[:-1]])
    where = np.cumsum(bits) - bits - first[owner] + (base[:-1] * 8 + np.array(head_bits))[owner]
    out = _scatter(every, bits, where, int(base[-1]))
    for r, raw in enumerate(head_bytes):
        out[base[r] : base[r] + len(raw)] |= np.frombuffer(raw, np.uint8)
    whole = out.tobytes()
    streams = [whole[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]
    for r in np.flatnonzero((np.count_nonzero(green[:, :256], axis=1) <= 16)).tolist():
        part = data[ends[r] - sizes[r] : ends[r]]
        if len(np.unique(part)) <= 16:
            shorter = encode_palette(part)
            if len(shorter) < len(streams[r]):
                streams[r] = shorter
    return streams


def encode_palette(samples: np.ndarray) -> bytes:
    """An image of up to sixteen values as indexes into a palette, several in one pixel, written as literals."""
    values, index = np.unique(samples, return_inverse=True)
    bits = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    index = index.reshape(-1, WIDTH)
    width = WIDTH >> bits
    packed = np.zeros((len(index), width), np.int64)
    for x in range(1 << bits):
        packed |= index[:, x :: 1 << bits] << (x * (8 >> bits))
    w = webp.BitWriter()
    w.put(0x2F | (WIDTH - 1) << 8 | (len(index) - 1) << 22 | 1 << 36, 40)
    w.put(1 | webp.PALETTE << 1 | (len(values) - 1) << 3, 11)
    steps = np.diff(values.astype(np.int64), prepend=0) & 255
    _literals(w, steps.tolist(), [255] + [0] * (len(values) - 1), top=False)
    w.put(0, 1)
    _literals(w, packed.reshape(-1).tolist(), None, top=True)
    return w.value.to_bytes((w.n + 7) // 8, "little")


def _literals(w: webp.BitWriter, green: list[int], alpha: list[int] | None, top: bool) -> None:
    """Pixels without red and blue as literals; ``alpha`` is 255 where it isn't given."""
    w.put(0, 2 if top else 1)
    codes = []
    for samples, size in ((green, SYMBOLS), (None, 256), (None, 256), (alpha if alpha is not None else [255], 256), (None, DISTANCES)):
        tally = [0] * size
        for s in samples or [0]:
            tally[s] += 1
        used = [s for s in range(size) if tally[s]]
        lengths = [0] * size
        for s, x in zip(used, lengths_of([tally[s] for s in used], LIMIT) if len(used) > 1 else [1], strict=True):
            lengths[s] = x
        w.put(*code_bits(lengths))
        codes.append({s: (webp.reversed_bits(c, x), x) for s, x, c in webp.canonical(np.array(lengths))} if len(used) > 1 else {used[0]: (0, 0)})
    for k, g in enumerate(green):
        w.put(*codes[0][g])
        if alpha is not None:
            w.put(*codes[3][alpha[k]])


def encode_payloads(payloads: list[np.ndarray]) -> list[bytes]:
    """Each payload, a multiple of WIDTH bytes, as WebP files in a row."""
    parts = [(k, p[at : at + IMAGE_SAMPLES]) for k, p in enumerate(payloads) for at in range(0, len(p), IMAGE_SAMPLES)]
    out: list[list[bytes]] = [[] for _ in payloads]
    lo = 0
    while lo < len(parts):
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi][1]) <= CHUNK):
            size += len(parts[hi][1])
            hi += 1
        streams = encode_samples(np.concatenate([p for _, p in parts[lo:hi]]), np.array([len(p) for _, p in parts[lo:hi]]))
        for (k, _), stream in zip(parts[lo:hi], streams, strict=True):
            out[k].append(webp.riff(stream))
        lo = hi
    return [b"".join(x) for x in out]


# decoder

@dataclass
class Lane:
    """A stream whose header has been read, ready for lockstep."""

    stream: bytes
    at: int
    width: int
    height: int
    steps: list
    full: int
    green: webp.PrefixCode
    distance: webp.PrefixCode
    constant: tuple[int, int, int]


@dataclass
class Decoded:
    """pixels: (height, width, 4) in R, G, B, A; what the stream used."""

    pixels: np.ndarray
    uneven_codes: int
    literals: int
    references: int
    cached: int
    transforms: tuple[int, ...]


def _tables(codes: list[webp.PrefixCode], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol | length << 16 by the next bits of the stream, one table after the other; where each begins; the mask of its bits)."""
    lengths = np.zeros((len(codes), size), np.uint8)
    for k, c in enumerate(codes):
        if c.single is None:
            lengths[k, : len(c.lengths)] = c.lengths
    width = lengths.max(1).astype(np.int64)
    share = np.where(lengths > 0, np.int64(1) << np.maximum(width[:, None] - lengths, 0), 0)
    if (share.sum(1) != np.where(width > 0, np.int64(1) << width, 0)).any():
        raise ValueError("incomplete prefix code")
    base = np.concatenate([[0], np.cumsum(np.int64(1) << width)])
    table = np.zeros(int(base[-1]), np.uint32)
    row, symbol = np.nonzero(lengths)
    own = lengths[row, symbol].astype(np.int64)
    times = share[row, symbol]
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    slot = np.repeat(base[row] + reversed_codes(lengths)[row, symbol], times) + (nth << np.repeat(own, times))
    table[slot] = np.repeat(symbol | own << 16, times)
    for k, c in enumerate(codes):
        if c.single is not None:
            table[base[k]] = c.single
    return table, base[:-1], (np.int64(1) << width) - 1


def lockstep(lanes: list[Lane]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(green of all lanes' pixels in a row, where each lane begins and the end, (lane of each back-reference))."""
    totals = np.array([x.width * x.height for x in lanes])
    starts = np.concatenate([[0], np.cumsum(totals)])
    room = [-(-len(x.stream) // 4) + 3 for x in lanes]
    words_at = np.concatenate([[0], np.cumsum(room)])
    raw = np.zeros(int(words_at[-1]) * 4, np.uint8)
    for x, w in zip(lanes, words_at.tolist(), strict=False):
        raw[4 * w : 4 * w + len(x.stream)] = np.frombuffer(x.stream, np.uint8)
    words = raw.view("<u4").astype(np.uint64)
    g_table, g_base, g_mask = _tables([x.green for x in lanes], SYMBOLS)
    d_table, d_base, d_mask = _tables([x.distance for x in lanes], DISTANCES)
    near = np.stack([_near_distance(w) for w in sorted({x.width for x in lanes})])
    near_row = np.searchsorted(sorted({x.width for x in lanes}), [x.width for x in lanes])
    out = np.zeros(int(starts[-1]), np.uint8)
    bit = words_at[:-1] * 32 + np.array([x.at for x in lanes])
    stop = words_at[:-1] * 32 + np.array([8 * len(x.stream) for x in lanes])
    at, end, lane = starts[:-1].copy(), starts[1:].copy(), np.arange(len(lanes))
    base, mask = g_base, g_mask.astype(np.uint64)
    copies: list[tuple[np.ndarray, ...]] = []

    def window(b: np.ndarray) -> np.ndarray:
        i = b >> 5
        return (words[i] | words[i + 1] << np.uint64(32)) >> (b & 31).astype(np.uint64)

    while len(lane):
        w = window(bit)
        entry = g_table[base + (w & mask).astype(np.int64)]
        symbol, width = entry & np.uint32(0xFFFF), (entry >> np.uint32(16)).astype(np.int64)
        out[at] = symbol
        bit = bit + width
        made = np.ones(len(lane), np.int64)
        ref = np.flatnonzero(symbol >= 256)
        if len(ref):
            s = symbol[ref].astype(np.int64) - 256
            extra = np.where(s < 4, 0, (s - 2) >> 1)
            read = lambda window_, s_, extra_: np.where(s_ < 4, s_ + 1, ((2 + (s_ & 1)) << extra_) + (window_ & ((np.uint64(1) << extra_.astype(np.uint64)) - np.uint64(1))).astype(np.int64) + 1)
            length = read(w[ref] >> width[ref].astype(np.uint64), s, extra)
            b = bit[ref] + extra
            own = lane[ref]
            w = window(b)
            entry = d_table[d_base[own] + (w & d_mask[own].astype(np.uint64)).astype(np.int64)]
            d, d_width = (entry & np.uint32(0xFFFF)).astype(np.int64), (entry >> np.uint32(16)).astype(np.int64)
            b = b + d_width
            extra = np.where(d < 4, 0, (d - 2) >> 1)
            code = read(window(b), d, extra)
            back = np.where(code > 120, code - 120, near[near_row[own], np.minimum(code, 120)])
            bit[ref] = b + extra
            made[ref] = length
            if (back > at[ref] - starts[own]).any() or (at[ref] + length > end[ref]).any():
                raise ValueError("back-reference outside the image")
            copies.append((own, at[ref], length, back))
        at = at + made
        live = at < end
        if (bit > stop[lane]).any():
            raise ValueError("the stream ends early")
        if not live.all():
            bit, at, end, lane, base, mask = bit[live], at[live], end[live], lane[live], base[live], mask[live]
    owners = np.zeros(0, np.int64)
    if copies:
        owners, place, length, back = (np.concatenate(x) for x in zip(*copies, strict=True))
        order = np.argsort(place)
        place, length, back = place[order], length[order], back[order]
        target = np.repeat((place - np.cumsum(length) + length).astype(np.int32), length)
        target += np.arange(len(target), dtype=np.int32)
        source = np.arange(len(out), dtype=np.int32)
        source[target] -= np.repeat(back.astype(np.int32), length)
        while True:  # follow copies of copies to literals
            further = source[source[target]]
            if (further == source[target]).all():
                break
            source[target] = further
        out[target] = out[source[target]]
    return out, starts, owners


def decode_streams(streams: list[bytes]) -> list[Decoded]:
    """Every stream's pixels, in order."""
    done: list[Decoded | None] = [None] * len(streams)
    lanes: list[tuple[int, Lane]] = []
    held = 0

    def flush() -> None:
        nonlocal lanes, held
        if not lanes:
            return
        # longest first, so that the lanes that go on are those in front
        green, starts, owners = lockstep([x for _, x in lanes])
        refs = np.bincount(owners, minlength=len(lanes)).tolist()
        for n, (k, x) in enumerate(lanes):
            part = green[starts[n] : starts[n + 1]].reshape(x.height, x.width)
            red, blue, alpha = x.constant
            argb = np.empty((x.height, x.width, 4), np.int32 if x.steps else np.uint8)
            argb[..., 0], argb[..., 1], argb[..., 2], argb[..., 3] = alpha, red, part, blue
            pixels = webp.invert(argb.astype(np.int32), x.steps) if x.steps else argb[..., [1, 2, 3, 0]]
            uneven = sum(len(set(c.lengths[c.symbols].tolist())) > 1 for c in (x.green, x.distance))
            done[k] = Decoded(pixels, uneven, 0, refs[n], 0, tuple(s[0] for s in x.steps))
        lanes, held = [], 0

    for k, stream in enumerate(streams):
        r = webp.BitReader(stream)
        width, height = webp.read_size(r)
        steps, inner = webp.read_steps(r, width, height)
        head = webp.read_head(r, inner, height, True)
        green, red, blue, alpha, distance = head.groups[0]
        if head.cache_bits == 0 and len(head.groups) == 1 and None not in (red.single, blue.single, alpha.single):
            lanes.append((k, Lane(stream, r.at, inner, height, steps, width, green, distance, (red.single, blue.single, alpha.single))))
            held += inner * height
            if held >= 4 * CHUNK:
                flush()
        else:
            tally = webp.Uses()
            argb = webp.read_body(r, head, inner, height, tally).reshape(height, inner)
            done[k] = Decoded(webp.finished(argb, steps), sum(len(set(c.lengths[c.symbols].tolist())) > 1 for g in head.groups for c in g), tally.literals, tally.references, tally.cached, tuple(s[0] for s in steps))
    flush()
    return done
