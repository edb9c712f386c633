"""Lossless WebP (VP8L): a decoder for whole streams, and a media column that stores texts as images.

The decoder reads prefix codes, back-references, the colour cache and
meta-prefix groups, and inverts the predictor, cross-colour, subtract-green and
palette transforms, in plain and in extended containers. Pixels are uint8
arrays (height, width, 4) in R, G, B, A order. ``webpbatch`` holds the encoder
and runs the decoder over many images at once.

Column operators: a null text is stored as an empty one (64 zero bytes); equal
texts give equal rows' values; a text of more than one image's samples becomes
several images in a row in one value. Repeated rows are handled one by one, an
empty table gives no rows, columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textarrays import row_chunks, tidied, utf8
from tracemill.scratch import materialize, ship_package

# Fixed values of the format.
LENGTH_CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
HASH_MULTIPLIER = 0x1E35A7BD
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class BitReader:
    """Bits from the least significant up; holds a window of the stream as one integer."""

    def __init__(self, data: bytes):
        self.data, self.at, self.base, self.window = data, 0, 0, int.from_bytes(data[:512], "little")

    def peek(self, n: int) -> int:
        """The next n bits, at most 4080; zeros beyond the end."""
        shift = self.at - self.base
        if shift + n > 4096 or shift < 0:
            self.base = self.at & ~7
            self.window = int.from_bytes(self.data[self.base >> 3 : (self.base >> 3) + 512], "little")
            shift = self.at - self.base
        return (self.window >> shift) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        value = self.peek(n) if n < 4080 else 0
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value


class PrefixCode:
    """A canonical code; ``table`` maps the next ``width`` bits to (symbol, length)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else (0 if not len(used) else None)
        self.width = int(lengths.max(initial=0))
        self.symbols = used
        self._table: list[tuple[int, int]] | None = None

    @property
    def table(self) -> list[tuple[int, int]]:
        if self._table is None:
            if sum(1 << (self.width - int(self.lengths[s])) for s in self.symbols) != 1 << self.width:
                raise ValueError("incomplete prefix code")
            self._table = [(0, 0)] * (1 << self.width)
            for symbol, length, code in canonical(self.lengths):
                first = reversed_bits(code, length)
                for k in range(first, 1 << self.width, 1 << length):
                    self._table[k] = (symbol, length)
        return self._table

    def read(self, r: BitReader) -> int:
        if self.single is not None:
            return self.single
        symbol, length = self.table[r.peek(self.width)]
        r.bits(length)
        return symbol


def reversed_bits(code: int, length: int) -> int:
    return int(f"{code:0{length}b}"[::-1], 2) if length else 0


def canonical(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(symbol, length, code) by length, then by symbol."""
    code, before = 0, 0
    for symbol in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        length = int(lengths[symbol])
        code <<= length - before
        yield symbol, length, code
        code, before = code + 1, length


@lru_cache(4096)
def _short_code(lengths: bytes) -> PrefixCode:
    """A code of few symbols, which many streams share; not to be changed."""
    return PrefixCode(np.frombuffer(lengths, np.uint8))


def read_code(r: BitReader, alphabet: int) -> PrefixCode:
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        lengths = bytearray(alphabet)
        lengths[r.bits(8 if wide else 1)] = 1
        if two:
            lengths[r.bits(8)] = 1
        return _short_code(bytes(lengths))
    small = bytearray(19)
    n = 4 + r.bits(4)
    shown = r.bits(3 * n)
    for k in range(n):
        small[LENGTH_CODE_ORDER[k]] = shown >> 3 * k & 7
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    code = _short_code(bytes(small))
    table, mask = ([(code.single, 0)], 0) if code.single is not None else (code.table, (1 << code.width) - 1)
    lengths, at, before = bytearray(alphabet), 0, 8
    window, used = r.peek(4080), 0
    while at < alphabet and left:
        left -= 1
        if used > 4000:
            r.bits(used)
            window, used = r.peek(4080), 0
        symbol, length = table[window >> used & mask]
        used += length
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            before = symbol or before
            continue
        bits = (2, 3, 7)[symbol - 16]
        times = (window >> used & ((1 << bits) - 1)) + (11 if symbol == 18 else 3)
        used += bits
        if at + times > alphabet:
            raise ValueError("too many code lengths")
        if symbol == 16:
            lengths[at : at + times] = bytes([before]) * times
        at += times
    r.bits(used)
    return PrefixCode(np.frombuffer(lengths, np.uint8))


def _prefixed(r: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.bits(extra) + 1


@dataclass
class Head:
    """What comes before an image's pixels: the cache's bits, the size and the groups of tiles, and each group's five codes."""

    cache_bits: int
    group_bits: int
    groups_of: list[int] | None
    groups: list[list[PrefixCode]]


@dataclass
class Uses:
    """How often a stream's pixels came as literals, references and cached colours."""

    literals: int = 0
    references: int = 0
    cached: int = 0


def read_head(r: BitReader, width: int, height: int, top: bool) -> Head:
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache of more than 11 bits")
    group_bits, groups_of = 0, None
    if top and r.bits(1):
        group_bits = r.bits(3) + 2
        columns, tiles = -(-width >> group_bits), -(-height >> group_bits)
        meta = read_body(r, read_head(r, columns, tiles, False), columns, tiles)
        groups_of = ((meta >> np.uint32(8)) & np.uint32(0xFFFF)).astype(int).tolist()
    n_groups = 1 + max(groups_of) if groups_of else 1
    groups = [[read_code(r, a) for a in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(n_groups)]
    return Head(cache_bits, group_bits, groups_of, groups)


def read_body(r: BitReader, head: Head, width: int, height: int, uses: Uses | None = None) -> np.ndarray:
    """One entropy-coded image as ARGB integers, row by row."""
    cache_bits, group_bits, uses = head.cache_bits, head.group_bits, uses or Uses()
    total = width * height
    out, cache, cached, columns = [0] * total, [0] * (1 << cache_bits), 0, -(-width >> group_bits)
    at = 0

    def remember() -> None:
        nonlocal cached
        while cached < at:
            cache[((HASH_MULTIPLIER * out[cached]) & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
            cached += 1

    green, red, blue, alpha, distance = head.groups[0]
    while at < total:
        if head.groups_of:
            y, x = divmod(at, width)
            green, red, blue, alpha, distance = head.groups[head.groups_of[(y >> group_bits) * columns + (x >> group_bits)]]
        symbol = green.read(r)
        if symbol < 256:
            # read in this order: green, red, blue, alpha
            r_, b_, a_ = red.read(r), blue.read(r), alpha.read(r)
            out[at] = a_ << 24 | r_ << 16 | symbol << 8 | b_
            uses.literals += 1
            at += 1
        elif symbol < 280:
            length = _prefixed(r, symbol - 256)
            code = _prefixed(r, distance.read(r))
            back = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if back > at or at + length > total:
                raise ValueError("back-reference outside the image")
            uses.references += 1
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            remember()
            uses.cached += 1
            out[at] = cache[symbol - 280]
            at += 1
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left: np.ndarray, up: np.ndarray, up_left: np.ndarray, up_right: np.ndarray) -> np.ndarray:
    """The prediction from neighbours' channel arrays (A, R, G, B as integers)."""
    half = lambda a, b: (a + b) >> 1
    match mode:
        case 1:
            return left
        case 2:
            return up
        case 3:
            return up_right
        case 4:
            return up_left
        case 5:
            return half(half(left, up_right), up)
        case 6:
            return half(left, up_left)
        case 7:
            return half(left, up)
        case 8:
            return half(up_left, up)
        case 9:
            return half(up, up_right)
        case 10:
            return half(half(left, up_left), half(up, up_right))
        case 11:
            to_left, to_up = np.abs(up - up_left).sum(-1), np.abs(left - up_left).sum(-1)
            return np.where((to_left < to_up)[..., None], left, up)
        case 12:
            return np.clip(left + up - up_left, 0, 255)
        case 13:
            mean = half(left, up)
            over = mean - up_left
            return np.clip(mean + np.where(over < 0, -((-over) // 2), over // 2), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), left.shape)


def _walk_predictor(image: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Add (or with ``forward`` subtract) each pixel's prediction, in reading order."""
    height, width, _ = image.shape
    out = image.copy()
    seen = image if forward else out
    black = np.array([255, 0, 0, 0], np.int32)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = black if x == 0 else seen[0, x - 1]
            elif x == 0:
                guess = seen[y - 1, 0]
            else:
                right = seen[y - 1, x + 1] if x + 1 < width else seen[y, 0]
                guess = predicted(int(modes[y >> bits, x >> bits]), seen[y, x - 1], seen[y - 1, x], seen[y - 1, x - 1], right)
            out[y, x] = (image[y, x] - guess if forward else image[y, x] + guess) & 255
    return out


def _cross(image: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """The cross-colour transform or its inverse; elements hold (A, red to blue, green to blue, green to red)."""
    height, width, _ = image.shape
    e = elements[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v: ((v + 128) & 255) - 128
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    out, sign = image.copy(), -1 if forward else 1
    out[..., 1] = (image[..., 1] + sign * delta(e[..., 3], image[..., 2])) & 255
    red = image[..., 1] if forward else out[..., 1]
    out[..., 3] = (image[..., 3] + sign * (delta(e[..., 2], image[..., 2]) + delta(e[..., 1], red))) & 255
    return out


def read_size(r: BitReader) -> tuple[int, int]:
    """(width, height) from the start of a stream."""
    if r.bits(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    return width, height


def read_steps(r: BitReader, width: int, height: int) -> tuple[list[tuple], int]:
    """(the transforms with what each holds, the width of the image that they are applied to)."""
    steps, seen = [], set()
    inner = lambda w, h: read_body(r, read_head(r, w, h, False), w, h)
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            shape = (-(-height >> bits), -(-width >> bits))
            steps.append((kind, bits, _channels(inner(shape[1], shape[0]).reshape(shape)), width))
        elif kind == PALETTE:
            n = r.bits(8) + 1
            table = np.cumsum(_channels(inner(n, 1)), 0) & 255
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, bits, table, width))
            width = -(-width >> bits)
        else:
            steps.append((kind, 0, None, width))
    return steps, width


def invert(image: np.ndarray, steps: list[tuple]) -> np.ndarray:
    """Pixels (R, G, B, A) of channels (A, R, G, B) after the transforms are taken back, last first."""
    for kind, bits, held, before in reversed(steps):
        if kind == PREDICTOR:
            image = _walk_predictor(image, held[..., 2], bits, False)
        elif kind == CROSS_COLOUR:
            image = _cross(image, held, bits, False)
        elif kind == SUBTRACT_GREEN:
            image[..., 1] = (image[..., 1] + image[..., 2]) & 255
            image[..., 3] = (image[..., 3] + image[..., 2]) & 255
        else:
            x = np.arange(before)
            index = image[:, x >> bits, 2] >> ((x & ((1 << bits) - 1)) * (8 >> bits)) & ((1 << (8 >> bits)) - 1)
            table = np.concatenate([held, np.zeros((256 - len(held), 4), held.dtype)])
            image = table[index]
    return image[..., [1, 2, 3, 0]].astype(np.uint8)


def finished(argb: np.ndarray, steps: list[tuple]) -> np.ndarray:
    return invert(_channels(argb), steps)


def decode_vp8l(data: bytes) -> np.ndarray:
    """The pixels of one VP8L stream, by the general loop."""
    r = BitReader(data)
    width, height = read_size(r)
    steps, inner = read_steps(r, width, height)
    return finished(read_body(r, read_head(r, inner, height, True), inner, height).reshape(height, inner), steps)


def riff(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + padded


def images(media: bytes) -> Iterator[bytes]:
    """The VP8L streams of files in a row, in plain and extended containers; other chunks are passed over, of an animation's frames each is one image."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        if end > len(media):
            raise ValueError("the file ends early")
        found = list(_streams(media, at + 12, end))
        if not found:
            raise ValueError("not a lossless WebP file")
        yield from found
        at = end


def _streams(media: bytes, at: int, end: int) -> Iterator[bytes]:
    while at + 8 <= end:
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"VP8L":
            yield media[at + 8 : at + 8 + size]
        elif name == b"ANMF":
            yield from _streams(media, at + 8 + 16, at + 8 + size)
        at += 8 + size + (size & 1)


class BitWriter:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def media_to_pixels(media: bytes) -> list[np.ndarray]:
    """The pixels of every image of a value."""
    from tracemill.llm.webpbatch import decode_streams

    return [d.pixels for d in decode_streams(list(images(media)))]


def samples(pixels: list[np.ndarray]) -> bytes:
    """The payload: the green samples of all images in a row."""
    return b"".join(p[..., 1].tobytes() for p in pixels)


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, padded with zero bytes to a positive multiple of 64, as lossless WebP."""
    ship_package(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tracemill.llm.webpbatch import encode_payloads

        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in row_chunks(at):
                payloads = []
                for i in range(lo, hi):
                    text = data[at[i] : at[i + 1]]
                    payload = np.zeros(max(1, -(-len(text) // 64)) * 64, np.uint8)
                    payload[: len(text)] = text
                    payloads.append(payload)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)[lo:hi]), pa.array(encode_payloads(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(encode), "doc_id long, n_bytes long, media binary")


def pixel_arrays(stored: DataFrame) -> DataFrame:
    """doc_id, width, heights, pixels (R, G, B, A bytes of all images in a row) of stored media."""
    ship_package(stored.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                parts = media_to_pixels(batch.column(1)[r].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([parts[0].shape[1]], pa.int32()), pa.array([[p.shape[0] for p in parts]], pa.list_(pa.int32())), pa.array([b"".join(p.tobytes() for p in parts)], pa.binary())], ["doc_id", "width", "heights", "pixels"])

    return stored.select("doc_id", "media").mapInArrow(decode, "doc_id long, width int, heights array<int>, pixels binary")


#: Bytes of media that are decoded together.
TOGETHER = 4 << 20


def media_digests(stored: DataFrame) -> DataFrame:
    """What is read back from each row's media: sizes, digests, a feature of the pixels, and how often each of the format's means was used."""
    ship_package(stored.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_images long, n_uneven_codes long, n_references long, n_cached long, n_transforms long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tracemill.llm.webpbatch import decode_streams

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in row_chunks(offsets, TOGETHER):
                values = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]
                streams = [list(images(v)) for v in values]
                decoded = iter(decode_streams([s for own in streams for s in own]))
                rows = []
                for media, own in zip(values, streams, strict=True):
                    found = [next(decoded) for _ in own]
                    payload = samples([d.pixels for d in found])
                    used = (sum(d.uneven_codes for d in found), sum(d.references for d in found), sum(d.cached for d in found), sum(len(d.transforms) for d in found))
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), len(found), *used))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidied(digest), schema)


def feature(payload: bytes) -> str:
    """Rows of 64 samples, and for all samples the mean and the mean step between rows, in thousandths."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    step = int(np.abs(np.diff(rows.astype(np.int16), axis=0)).sum(dtype=np.int64))
    return f"64x{len(rows)};mean={int(rows.sum(dtype=np.int64)) * 1000 // rows.size};step={step * 1000 // rows.size}"


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts as media in shared scratch, read the media back and digest what they hold."""
    return media_digests(materialize(store_texts(docs, id_col=id_col, text_col=text_col), "media"))
