"""Token ids as canonical length-limited Huffman code: independent blocks with bit-offset checkpoints.

Code lengths come from global counts (package-merge, at most MAX_BITS), and a
canonical code needs only those lengths. Documents are laid out in ascending
doc_id order. A block holds whole documents, the bit stream of their ids and
the bit offset of every STRIDE-th id; a block is read without any other, and
the checkpoints let a table-driven decoder run all strides of a block side by
side.

Nulls: a null text is empty and stored as the end id alone; null doc_ids sort
first. Repeated rows are stored once for each row, ties in order of their ids'
crc. An empty table gives an empty file set and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textarrays import tidied
from tracemill.llm.tokens import encoder
from tracemill.scratch import discard, materialize, ship_package

MAX_BITS = 20
STRIDE = 512
BLOCK_IDS = 1 << 18
BLOCK = "part int, block int, part_start long, doc_ids array<long>, sizes array<long>, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} symbols need more than {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    rows, packages = [], np.zeros(0, np.int64)
    for _ in range(most):
        both = np.concatenate([leaf, packages])
        sorted_ = np.argsort(both, kind="stable")
        rows.append(sorted_ < n)
        both = both[sorted_]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(rows):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        size = lengths[order].astype(np.int64)
        widest = int(size.max())
        slots = np.int64(1) << (widest - size)
        codes[order] = ((np.cumsum(slots) - slots) >> (widest - size)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length) for each value of the next ``width`` bits."""
    width = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.int64(1) << (width - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    total = int(spans.sum())
    symbols[:total], sizes[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, sizes, width


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit stream, bit offset of every STRIDE-th id)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    if not len(ids):
        return b"", begin
    word, room = begin >> 6, 64 - (begin & 63) - size  # a code goes into one word of 64 bits, and on into the next without room
    value, over = codes[ids].astype(np.uint64), np.flatnonzero(room < 0)
    first = value << np.maximum(room, 0).astype(np.uint64)
    first[over] = value[over] >> (-room[over]).astype(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
    out[word[heads]] = np.add.reduceat(first, heads)  # codes never share a bit, so sums are their unions
    out[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], begin[::STRIDE]


def decode_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids of a stream; all strides advance together, one table look-up each."""
    symbols, sizes, width = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    view = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    lanes = len(checkpoints)
    out = np.zeros((STRIDE, lanes), np.uint32)
    at, mask, last = checkpoints.astype(np.int64), np.uint32((1 << width) - 1), len(view) - 1
    for step in range(min(STRIDE, n)):
        live = lanes if step < n - (lanes - 1) * STRIDE else lanes - 1
        a = at[:live]
        peek = (view[np.minimum(a >> 3, last)] >> (np.uint32(32 - width) - (a & 7).astype(np.uint32))) & mask
        out[step, :live] = symbols[peek]
        at[:live] = a + sizes[peek]
    return out.T.reshape(-1)[:n]


def token_ids(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 16 bits where the vocabulary allows, else 32)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        kind = "<u2" if len(enc.sizes) <= 1 << 16 else "<u4"
        for batch in batches:
            for lo, hi, ids, at in enc.chunks(batch.column(1), end_id):
                offsets = pa.py_buffer((at * np.dtype(kind).itemsize).astype(np.int32))
                blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets, pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), blob], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(encode, encodes=True), "doc_id long, n_tokens long, ids binary")


def _unpack(column, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows in a row, offsets) of a binary column of ids."""
    from tracemill.llm.textarrays import utf8

    data, offsets = utf8(column)
    total = int(sizes.sum())
    width = len(data) // total if total else 2
    return data.view(f"<u{width}") if data.flags["C_CONTIGUOUS"] and data.ctypes.data % width == 0 else np.frombuffer(data.tobytes(), f"<u{width}"), offsets // width


def id_counts(ids: DataFrame) -> DataFrame:
    """id, n: how often each id occurs in all documents. Each task counts its own rows first."""
    ship_package(ids.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            flat, _ = _unpack(batch.column(1), batch.column(0).to_numpy(zero_copy_only=False))
            part = np.bincount(flat)
            if len(part) > len(total):
                part[: len(total)] += total
                total = part
            else:
                total[: len(part)] += part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used].astype(np.int64))], ["id", "n"])

    return ids.select("n_tokens", "ids").mapInArrow(tidied(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_blocks(ids: DataFrame, lengths: np.ndarray, parts: int) -> DataFrame:
    """Blocks in ascending doc_id order: a part holds a range of doc_ids, its blocks follow each other by number."""
    spark = ids.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def block(part: int, number: int, start: int, docs: list[pa.Array], chunks: list[np.ndarray], sizes: np.ndarray) -> pa.RecordBatch:
        bits, marks = encode_bits(np.concatenate(chunks), *shared.value)
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays([one(part, pa.int32()), one(number, pa.int32()), one(start, pa.int64()), one(pa.concat_arrays(docs).to_pylist(), pa.list_(pa.int64())), one(sizes, pa.list_(pa.int64())), one(bits, pa.binary()), one(marks.astype("<u4").tobytes(), pa.binary())], ["part", "block", "part_start", "doc_ids", "sizes", "bits", "checkpoints"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, start, held = TaskContext.get().partitionId(), 0, 0, 0
        docs, chunks, sizes = [], [], []
        for batch in batches:
            size = batch.column(1).to_numpy().astype(np.int64)
            flat, at = _unpack(batch.column(2), size)
            lo = 0
            while lo < len(size):  # whole documents until the block is full
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_IDS - held, "right")) - 1)
                hi = min(hi, len(size))
                docs.append(batch.column(0).slice(lo, hi - lo))
                chunks.append(flat[at[lo] : at[hi]])
                sizes.append(size[lo:hi])
                held += int(at[hi] - at[lo])
                lo = hi
                if held >= BLOCK_IDS or lo < len(size):
                    yield block(part, number, start, docs, chunks, np.concatenate(sizes))
                    number, start, held = number + 1, start + held, 0
                    docs, chunks, sizes = [], [], []
        if docs:
            yield block(part, number, start, docs, chunks, np.concatenate(sizes))

    return ids.withColumn("crc", F.crc32("ids")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "crc").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc").select("doc_id", "n_tokens", "ids").mapInArrow(tidied(encode), BLOCK)


def read_blocks(blocks: DataFrame, lengths: np.ndarray, *, with_ids: bool = False) -> DataFrame:
    """One row per document of the blocks: doc_id, start, n_tokens, ids_crc32 (and ids, uint32 little-endian)."""
    spark = blocks.sparkSession
    ship_package(spark)
    totals = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r.n for r in totals])
    shared = spark.sparkContext.broadcast((lengths, {r.part: int(e) - r.n for r, e in zip(totals, ends, strict=True)}))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, before = shared.value
        table = decode_table(lengths)
        for batch in batches:
            for r in range(batch.num_rows):
                part, _, start, docs, sizes, bits, marks = (batch.column(i)[r] for i in range(7))
                size = sizes.values.to_numpy().astype(np.int64)
                at = np.concatenate([[0], np.cumsum(size)])
                ids = decode_bits(bits.as_py(), np.frombuffer(marks.as_py(), "<u4"), int(at[-1]), table)
                raw = ids.astype("<u4").tobytes()
                spans = list(zip((at[:-1] * 4).tolist(), (at[1:] * 4).tolist(), strict=True))
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in spans), np.int64, len(spans))
                out = [docs.values, pa.array(before[part.as_py()] + start.as_py() + at[:-1]), pa.array(size), pa.array(crc)]
                if with_ids:
                    out.append(pa.array([raw[a:b] for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return blocks.mapInArrow(tidied(decode), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def store_tokens(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Encode, count, and write blocks to shared scratch: (the blocks as read back, code lengths)."""
    ids = materialize(token_ids(docs, tokenizer_json, id_col=id_col, text_col=text_col, end_id=end_id), "ids")
    rows = id_counts(ids).collect()  # one row for each id of the vocabulary at most
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    blocks = materialize(write_blocks(ids, lengths, max(1, ids.rdd.getNumPartitions())), "blocks")
    discard(ids)
    return blocks, lengths


__all__ = ["canonical_codes", "code_lengths", "decode_bits", "decode_table", "encode_bits", "id_counts", "read_blocks", "store_tokens", "token_ids", "write_blocks"]
