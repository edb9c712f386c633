"""Language-model scoring by a weighted backoff automaton over smoothed n-grams.

Counts are global and live nowhere as a whole. Documents are dealt into blocks,
which are stored once, a compressed row each. A block sends the distinct
n-grams of its texts with its own training counts, once each, to buckets of the
hash range. A bucket sums them over all blocks and answers every block for the
n-grams that it sent. From the answers a block builds the part of the automaton
that its texts can reach and walks it.

What is shuffled is linear in the corpus. An n-gram that all blocks hold costs
an entry for each block, but no task sees them all: more than FAN blocks are
summed in groups of FAN, the groups' sums in groups again, and answers come
back the same way, so a task holds at most a bucket of FAN senders. Orders are
asked for in rounds, so that the n-grams of all orders are never on disk at
once.

Model: p(w | h) = (1 - b) c(hw) / c(h) + b p(w | shorter h), down to
p(w) = (c(w) + 1) / (N + V + 1). The share b that a context h leaves to backing
off is 1 / (1 + c(h) ** (1 - GROWTH)): it falls as kinds of successors, growing
as c ** GROWTH, fall behind occurrences. Every context's probabilities, with
one unknown word, sum to 1. States are contexts; a seen n-gram is an arc with
its probability; a context's failure arc costs b and leads to its suffix.

Nulls: a null text is empty and scores its end token; a null doc_id is in
training. Repeated rows count and are scored as often as they occur; they are
dealt like others. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textarrays import hashed_words, mix, row_chunks, tidied, utf8
from tracemill.scratch import discard, materialize, ship_package

ORDER = 3
GROWTH = 0.85
#: Bytes of text in a block, and of text whose n-grams fill a bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 6 << 20
#: Senders that a task sums at most.
FAN = 256
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def held_out(doc_id: Column, fold: int = 7, rest: int = 2) -> Column:
    """Whether the crc of the id's text leaves this rest; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == rest, F.lit(False))


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(START, hashed words, END of each row in a row; first of each row and the count at the end)."""
    parts, sizes = [], []
    for lo, hi in row_chunks(offsets):
        w, first = hashed_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = np.diff(first)
        at = np.concatenate([[0], np.cumsum(n + 2)])
        out = np.empty(int(at[-1]), np.uint64)
        inner = np.ones(len(out), bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        out[at[:-1]], out[at[1:] - 1], out[inner] = START, END, w
        parts.append(out)
        sizes.append(n + 2)
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))])


class Grams:
    """The distinct n-grams of a block's rows, for each length up to ``order``, and where they end."""

    def __init__(self, table: pa.Table, order: int, least: int = 0):
        """``least``: the first order, from 0, whose tables are made."""
        data, offsets = utf8(table.column("text"))
        self.tokens, self.first = sequences(data, offsets)
        self.order = order
        total = len(self.tokens)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        place = np.arange(total) - self.first[:-1][row]
        train = ~table.column("held_out").to_numpy()[row]
        self.keys, self.at, self.index, self.own = [], [], [], []
        h = np.zeros(total, np.uint64)
        for k in range(1, order + 1):
            # the k-gram that ends here: the one of k - 1 before it, and this token
            h = self.tokens if k == 1 else np.concatenate([h[:1], mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) + self.tokens[1:]])
            if k <= least:
                for held in (self.keys, self.at, self.index, self.own):
                    held.append(np.zeros(0, np.int64))
                continue
            ends = np.flatnonzero(place >= k - 1)
            keys, at, inverse = np.unique(mix(h[ends]), return_index=True, return_inverse=True)
            index = np.zeros(total, np.int32)
            index[ends] = inverse
            self.keys.append(keys)
            self.at.append(ends[at])
            self.index.append(index)
            self.own.append(np.bincount(inverse, train[ends], len(keys)).astype(np.int64))


def planes(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, so that the high bytes' zeros lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def store_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """block, packed: the rows (doc_id, held_out, text) in ``blocks`` blocks, a compressed row each. Rows are dealt by hash and place, so equal rows spread."""
    draw = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.select(PACKED.names).cast(PACKED))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return rows.withColumn("block", F.pmod(draw, F.lit(blocks))).groupBy("block").applyInArrow(pack, "block long, packed binary")


PACKED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.large_string())])


def unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


REQUEST = "source long, gram int, bucket long, keys binary, counts binary"


def _request_rows(source: int, gram: int, keys: np.ndarray, counts: np.ndarray, buckets: int, first: int = 0, last: int | None = None) -> list[tuple]:
    """A row for each bucket, of those from ``first`` to ``last`` of the hash range, that holds some of these sorted keys."""
    last = buckets if last is None else last
    edges = np.array([(b << 64) // buckets for b in range(first + 1, last)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    return [(source, gram, first + int(b), planes(np.diff(keys[cut[b] : cut[b + 1]], prepend=np.uint64(0))), planes(counts[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut)).tolist()]


def _as_table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def block_requests(blocks: DataFrame, buckets: int, grams: tuple[int, ...]) -> DataFrame:
    """REQUEST rows of each block's distinct n-grams of these orders, once each, with its own training counts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = Grams(unpacked(raw.as_buffer()), max(grams) + 1, least=min(grams))
                for k in grams:
                    yield _as_table(_request_rows(block, k, held.keys[k], held.own[k], buckets), REQUEST)

    return blocks.mapInArrow(tidied(gather), REQUEST)


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(each row's number of keys, distinct keys, their sums, where each row's keys are among them)."""
    parts = [np.cumsum(unplanes(raw.as_buffer()), dtype=np.uint64) for raw in table.column("keys")]
    own = np.concatenate([unplanes(raw.as_buffer()) for raw in table.column("counts")])
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return [len(p) for p in parts], keys, np.bincount(inverse, own, len(keys)).astype(np.int64), inverse


ANSWER = "source long, gram int, bucket long, counts binary, distinct long, total long"


def _answers(table: pa.Table, sizes: list[int], totals: np.ndarray, inverse: np.ndarray) -> list[tuple]:
    cut = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    ids = zip(table.column("source").to_pylist(), table.column("gram").to_pylist(), table.column("bucket").to_pylist(), strict=True)
    return [(*i, planes(totals[inverse[a:b]]), None, None) for i, a, b in zip(ids, cut[:-1], cut[1:], strict=True)]


def global_counts(requests: DataFrame, sources: int, buckets: int, spent: list[DataFrame]) -> DataFrame:
    """ANSWER rows: global counts for every request; and a row a bucket (source -1) with distinct and total of training n-grams.

    ``spent`` gets the scratch tables that can go once the answers are stored.
    """
    if sources <= FAN:

        def add_up(key: tuple, table: pa.Table) -> pa.Table:
            sizes, keys, totals, inverse = _merged(table)
            gram, bucket = key[0].as_py(), key[1].as_py()
            # START is a context and no token
            real = keys != mix(np.array([START]))[0] if gram == 0 else np.ones(len(keys), bool)
            stats = (-1, gram, bucket, None, int((totals[real] > 0).sum()), int(totals[real].sum()))
            return pa.Table.from_batches([_as_table([*_answers(table, sizes, totals, inverse), stats], ANSWER)])

        return requests.groupBy("gram", "bucket").applyInArrow(add_up, ANSWER)

    fan, finer = FAN, buckets * FAN
    stored = materialize(requests, "requests", free=True)
    held = stored.withColumn("parent", F.floor(F.col("source") / fan))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parent, gram, bucket = (k.as_py() for k in key)
        _, keys, totals, _ = _merged(table)
        return pa.Table.from_batches([_as_table(_request_rows(parent, gram, keys, totals, finer, bucket * fan, (bucket + 1) * fan), REQUEST)])

    def hand_down(asked: pa.Table, got: pa.Table) -> pa.Table:
        sizes, keys, _, inverse = _merged(asked)
        parts = sorted(zip(got.column("bucket").to_pylist(), got.column("counts"), strict=True), key=lambda x: x[0])
        totals = np.concatenate([unplanes(raw.as_buffer()) for _, raw in parts]).astype(np.int64)
        if len(totals) != len(keys):
            raise RuntimeError("a group's n-grams differ from those that it asked for")
        return pa.Table.from_batches([_as_table(_answers(asked, sizes, totals, inverse), ANSWER)])

    above: list[DataFrame] = []
    upper = materialize(global_counts(held.groupBy("parent", "gram", "bucket").applyInArrow(merge, REQUEST), -(-sources // fan), finer, above), "upper", free=True)
    discard(*above)
    spent += [stored, upper]
    own = upper.where("source >= 0").select(F.col("source").alias("parent"), "gram", F.col("bucket"), F.floor(F.col("bucket") / fan).alias("coarse"), "counts")
    answers = held.groupBy("parent", "gram", "bucket").cogroup(own.groupBy("parent", "gram", "coarse")).applyInArrow(hand_down, ANSWER)
    return answers.unionByName(upper.where("source < 0"))


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    Arc k of length k + 1 has the log10 probability ``arc[k]``; the context of
    length k + 1 has the failure weight ``fail[k]``.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int):
        self.grams, self.counts = grams, counts
        p = (counts[0] + 1) / (total + distinct + 1)
        self.arc, self.fail = [np.log10(p)], []
        for k in range(1, grams.order):
            context = grams.index[k - 1][grams.at[k] - 1]
            suffix = grams.index[k - 1][grams.at[k]]
            c = counts[k - 1].astype(float)
            back = 1 / (1 + c ** (1 - GROWTH))
            self.fail.append(np.log10(back))
            p = (1 - back[context]) * counts[k] / np.maximum(c[context], 1) + back[context] * p[suffix]
            self.arc.append(np.log10(p))

    def walk(self) -> np.ndarray:
        """The log10 probability of each row: all rows advance together, one token at a time, each carrying its state's length."""
        g, n = self.grams, self.grams.order
        sizes = np.diff(g.first)
        order = np.argsort(-sizes, kind="stable")
        first, falling = g.first[:-1][order], -sizes[order]
        out, level = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
        if n > 1:  # every row starts at START, a context if any document was trained on
            level[:] = self.counts[0][g.index[0][first]] > 0
        for t in range(1, int(-falling[0]) if len(sizes) else 0):
            live = int(np.searchsorted(falling, -t))
            e, at = first[:live] + t, level[:live] + 1
            gained = np.zeros(live)
            for k in range(n, 1, -1):
                lanes = np.flatnonzero(at == k)
                if len(lanes):
                    ends = e[lanes]
                    gram = g.index[k - 1][ends]
                    seen = self.counts[k - 1][gram] > 0
                    gained[lanes] += np.where(seen, self.arc[k - 1][gram], self.fail[k - 2][g.index[k - 2][ends - 1]])
                    at[lanes] -= ~seen
            word = g.index[0][e]
            root = at == 1
            gained[root] += self.arc[0][word[root]]
            at[root] = self.counts[0][word[root]] > 0
            out[:live] += gained
            level[:live] = np.minimum(at, n - 1)
        back = np.empty(len(sizes))
        back[order] = out
        return back


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(blocks: DataFrame, answers: DataFrame, total: int, distinct: int, order: int = ORDER) -> DataFrame:
    """SCORES of all rows of the blocks."""

    def walk(held: pa.Table, got: pa.Table) -> pa.Table:
        docs = unpacked(held.column("packed")[0].as_buffer())
        grams = Grams(docs, order)
        parts = sorted(zip(got.column("gram").to_pylist(), got.column("bucket").to_pylist(), got.column("counts"), strict=True), key=lambda x: x[:2])
        counts = []
        for k in range(order):
            counts.append(np.concatenate([np.zeros(0, np.uint64), *(unplanes(raw.as_buffer()) for g, _, raw in parts if g == k)]).astype(np.int64))
            if len(counts[k]) != len(grams.keys[k]):
                raise RuntimeError("a block's n-grams differ from those that it asked for")
        automaton = Automaton(grams, counts, total, distinct)
        word = grams.index[0]
        inner = np.ones(len(word), bool)
        inner[grams.first[:-1]] = False
        row = np.repeat(np.arange(docs.num_rows), np.diff(grams.first))[inner]
        known = np.bincount(row, counts[0][word[inner]] > 0, docs.num_rows).astype(np.int64)
        base = np.bincount(row, automaton.arc[0][word[inner]], docs.num_rows)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(np.diff(grams.first) - 1), "n_known": pa.array(known), "train_tokens": pa.array(np.full(docs.num_rows, total)), "base_score": pa.array(base), "score": pa.array(automaton.walk())})

    own = answers.where("source >= 0").select(F.col("source").alias("block"), "gram", "bucket", "counts")
    return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(walk, SCORES)


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; see the module's head."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (held_out(F.col(id_col)) if held is None else held).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 16), F.lit(0)).alias("n")).first().n
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    # a bucket's share of a group of FAN blocks; it is split FAN times as groups join
    buckets = max(1, -(-min(size, FAN * BLOCK_BYTES) // BUCKET_BYTES))
    blocks = materialize(store_blocks(rows, n_blocks), "blocks", free=True)
    answers = None
    for grams in ((0, 1), *((k,) for k in range(2, order))):
        spent: list[DataFrame] = []
        some = materialize(global_counts(block_requests(blocks, buckets, tuple(k for k in grams if k < order)), n_blocks, buckets, spent), "answers", free=True)
        discard(*spent)
        answers = some if answers is None else answers.unionByName(some)
    known = answers.where("source = -1 and gram = 0").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).first()
    return score_blocks(blocks, answers, known.total, known.distinct, order)


__all__ = ["Automaton", "Grams", "held_out", "score_documents"]
