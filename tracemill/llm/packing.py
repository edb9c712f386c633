"""Packing token pieces into fixed-length sequences: first-fit decreasing over a tournament tree.

A document's ids are cut into pieces of at most ``capacity``. Pieces are dealt
at random into groups of about ``group_size`` and each group is packed alone:
pieces in falling order of size, each into the first bin with room, which a
tournament tree of the bins' free space finds in logarithmic time. Groups are
independent, so the work is one task per group however large the corpus is,
and a group's memory is bounded by its size.

Nulls: a null text is empty and packs as the end id alone; a null doc_id is
carried as it is. Repeated rows are packed once for each row. An empty table
gives an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textarrays import mix, tidied
from tracemill.llm.tokens import UnitEncoder
from tracemill.scratch import discard, materialize, ship_package

#: Units whose ids a task keeps, and bytes of text that it encodes at once: small, as a pipeline's other stages hold memory too.
KEPT_UNITS, CHUNK = 600_000, 1 << 20
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long"


class TournamentTree:
    """Free space of bins 0 .. n-1; each inner node holds the most free space below it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the first bin that has it; the bin's number."""
        most, leaves, at = self.most, self.leaves, 1
        while at < leaves:
            at <<= 1
            if most[at] < size:
                at += 1
        bin_ = at - leaves
        most[at] -= size
        at >>= 1
        while at:
            left, right = most[2 * at], most[2 * at + 1]
            new = left if left >= right else right
            if most[at] == new:
                break
            most[at] = new
            at >>= 1
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each size; sizes are at most ``capacity``. Equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree, used = TournamentTree(max(1, len(sizes)), capacity), [0] * max(1, len(sizes))
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        b = tree.first_fit(size)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids: full ones from its start, then the rest; with ``with_ids`` the ids too (uint32, little-endian)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = UnitEncoder(shared.value, KEPT_UNITS), 0
        for batch in batches:
            for lo, hi, ids, at in encode.chunks(batch.column(1), end_id, CHUNK):
                sizes = np.diff(at)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                raw, begin = ids.astype("<u4").tobytes(), at[doc] + start
                spans = list(zip((begin * 4).tolist(), ((begin + length) * 4).tolist(), strict=True))
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in spans), np.int64, len(spans))
                draw = mix(mix(crc.astype(np.uint64) + np.uint64(row) + np.arange(len(doc), dtype=np.uint64)) ^ (start + 7919 * length).astype(np.uint64))
                row += len(doc)
                out = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)).cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (start, length, crc, sizes[doc], draw.view(np.int64)))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw"]
                if with_ids:
                    out.append(pa.array([raw[a:b] for a, b in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(cut), PIECE + (", ids binary" if with_ids else ""))


def pack_pieces(pieces: DataFrame, *, capacity: int = 4096, group_size: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity``; see the module's head."""
    ship_package(pieces.sparkSession)
    groups = max(1, -(-pieces.count() // group_size))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("length", "doc_id", "start", "ids_crc32", "draw")]
        table = table.sort_by(order)  # the same rows in the same order give the same bins, whatever order they came in
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy().astype(np.int64), capacity)
        out = table.drop_columns(["pack_group", "draw"])
        return out.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    kept = [c for c in pieces.columns if c != "draw"]
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*kept).dtypes) + ", sequence_id long, offset long"
    dealt = pieces.withColumn("pack_group", F.pmod(F.col("draw"), F.lit(groups)).cast("long"))
    return dealt.groupBy("pack_group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, group_size: int = 8192, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    The pieces are written to shared scratch once, so texts are encoded once
    and a lost executor repeats only its own group.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_json, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, capacity=capacity, group_size=group_size)


def sequences(packed: DataFrame, *, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """The padded id array of each sequence, from pieces packed ``with_ids``: sequence_id, used, ids (binary, uint32 little-endian).

    A sequence whose length is a power of two stays at that length.
    """
    ship_package(packed.sparkSession)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        ids = b"".join(table.sort_by("offset").column("ids").to_pylist())
        used = len(ids) // 4
        full = used if used & (used - 1) == 0 else capacity
        ids += np.full(full - used, pad_id, "<u4").tobytes()
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "used": pa.array([used], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, used long, ids binary")


__all__ = ["TournamentTree", "cut_pieces", "discard", "first_fit_decreasing", "pack_documents", "pack_pieces", "sequences"]
