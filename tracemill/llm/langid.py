"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Training unrolls the network over windows of WINDOW bytes, all of those of the
texts that are learned from, and propagates back through time; every position
of a window is trained to name its document's language. Prediction reads every
byte of a text. Texts of up to SEGMENT bytes are read whole in both
directions. A longer one is cut into segments that are read side by side, each
with the WARM bytes before and after it, so that the state that enters a
segment from either end is one carried over from its neighbour's text; only
the positions of the segment itself are labelled. A document's probabilities
are the mean over all its positions.

Every language that a row names is learned, however rare. The state and the
updates grow with the number of languages; up to FEW_LANGS they are HIDDEN and
UPDATES. What is learned from is a bounded sample of labelled rows: at most
``per_lang`` documents a language, fewer where their whole texts would take
more than TRAIN_BYTES together.

Nulls: a null text, or one without a letter, is UNDECIDED with score 0; null
langs teach nothing. With no labelled rows at all everything is UNDECIDED.
Ties go to the language first in order. Of rows that share an id one teaches.
Repeated rows are predicted one by one; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.textarrays import row_chunks, tidied, utf8
from tracemill.scratch import discard, materialize, ship_package

UNDECIDED = "und"
WINDOW = 128
#: Bytes of a text that are read in one go, and of its neighbours that are read before on either side.
SEGMENT, WARM = 512, 64
HIDDEN = 8
#: Segments that are read side by side, for up to FEW_LANGS languages.
LANES = 1024
UPDATES = 240
#: Languages up to which the network and its training have their least size.
FEW_LANGS = 8
#: Bytes of all texts that are learned from, at most, as long as each language has one.
TRAIN_BYTES = 64 << 20
#: Languages whose drawn ids may be broadcast; beyond it the join shuffles.
BROADCAST_LANGS = 5000


@dataclass
class Direction:
    """One direction's weights. Rows: update gate, reset gate, candidate; the gates' rows hold half their logits."""

    by_byte: np.ndarray  # (3H, 256), biases included
    by_state: np.ndarray  # (3H, H)

    def run(self, steps: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T, H, N) for byte steps (T, N); with ``keep`` what back-propagation needs."""
        T, N = steps.shape
        H = self.by_state.shape[1]
        out, kept = np.empty((T, H, N), np.float32), []
        h = np.zeros((H, N), np.float32)
        for t in range(T):
            a = self.by_byte.take(steps[t], axis=1)
            g = self.by_state @ h
            gates = a[: 2 * H]
            gates += g[: 2 * H]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:H], gates[H:]
            n = a[2 * H :]
            n += r * g[2 * H :]
            np.tanh(n, out=n)
            new = out[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            if keep:
                kept.append((h, z, r, n, g[2 * H :]))
            h = new
        return out, kept

    def back(self, steps: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of (by_byte, by_state) from those of the states, through all steps."""
        T, N = steps.shape
        H = self.by_state.shape[1]
        d_state, d_a = np.zeros_like(self.by_state), np.empty((3 * H, T, N), np.float32)
        dh = np.zeros((H, N), np.float32)
        for t in reversed(range(T)):
            h, z, r, n, gn = kept[t]
            dh = dh + d_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            d_a[:H, t] = 2 * dh * (h - n) * z * (1 - z)  # twice: the gates' rows hold half logits
            d_a[H : 2 * H, t] = 2 * dn * gn * r * (1 - r)
            d_a[2 * H :, t] = dn
            dg = np.concatenate([d_a[: 2 * H, t], dn * r])
            d_state += dg @ h.T
            dh = dh * z + self.by_state.T @ dg
        flat = steps.reshape(-1)
        d_byte = np.stack([np.bincount(flat, row, 256) for row in d_a.reshape(3 * H, -1)]).astype(np.float32)
        return d_byte, d_state


@dataclass
class ByteGRU:
    langs: list[str]
    forward: Direction
    backward: Direction
    to_label: np.ndarray  # (K, 2H)
    bias: np.ndarray  # (K, 1)

    def label_sums(self, steps: np.ndarray, lengths: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(N, K): label probabilities of byte lanes (N, T), summed over each lane's positions from ``begin`` to ``end``.

        Lanes are read from their first byte on and from their last back.
        """
        n, span = steps.shape
        hidden, places = self.forward.by_state.shape[1], np.arange(span)
        ahead = self.forward.run(np.ascontiguousarray(steps.T))[0]
        logits = np.matmul(self.to_label[:, :hidden], ahead)
        turned = np.maximum(lengths[:, None] - 1 - places, 0)
        behind = self.backward.run(np.ascontiguousarray(np.take_along_axis(steps, turned, 1).T))[0]
        back = np.matmul(self.to_label[:, hidden:], behind)
        logits += np.take_along_axis(back, turned.T[:, None, :], 0)
        logits += self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= ((places[:, None] >= begin) & (places[:, None] < end))[:, None, :] / logits.sum(1, keepdims=True)
        return logits.sum(0, dtype=np.float64).T

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, K): mean probabilities over all bytes of each; zeros for an empty text."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        stop = np.minimum(start + SEGMENT, sizes[doc])
        low, high = np.maximum(start - WARM, 0), np.minimum(stop + WARM, sizes[doc])
        total = np.zeros((len(sizes), len(self.langs)))
        padded = np.concatenate([data, np.zeros(SEGMENT + 2 * WARM, np.uint8)])
        lanes = max(64, LANES * FEW_LANGS // max(FEW_LANGS, len(self.langs)))
        order = np.argsort(high - low, kind="stable")  # lanes of like lengths together
        for at in range(0, len(order), lanes):
            k = order[at : at + lanes]
            length = (high - low)[k]
            span = np.arange(int(length[-1]))
            steps = padded[(offsets[doc[k]] + low[k])[:, None] + span]
            np.add.at(total, doc[k], self.label_sums(steps, length, (start - low)[k], (stop - low)[k]))
        return total / np.maximum(sizes, 1)[:, None]


def network_size(n_langs: int) -> tuple[int, int]:
    """(hidden units of each direction, updates) for so many languages."""
    more = max(1.0, n_langs / FEW_LANGS)
    return round(HIDDEN * more**0.5), round(UPDATES * more**0.5)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], *, updates: int | None = None, batch: int = 128, rate: float = 0.02, seed: int = 5) -> ByteGRU:
    """Adam on the mean cross-entropy of all positions; the same windows always give the same network."""
    rng = np.random.default_rng(seed)
    K = len(langs)
    H, needed = network_size(K)
    updates = needed if updates is None else updates
    small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = ByteGRU(langs, Direction(small(3 * H, 256), small(3 * H, H)), Direction(small(3 * H, 256), small(3 * H, H)), small(K, 2 * H), np.zeros((K, 1), np.float32))
    weights = [net.forward.by_byte, net.forward.by_state, net.backward.by_byte, net.backward.by_state, net.to_label, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for update in range(1, updates + 1):
        pick = rng.integers(0, len(windows), min(batch, len(windows)))
        steps = np.ascontiguousarray(windows[pick].T)
        ahead, kept = net.forward.run(steps, True)
        behind, kept_back = net.backward.run(steps[::-1], True)
        states = np.concatenate([ahead, behind[::-1]], 1)
        logits = np.matmul(net.to_label, states) + net.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        p[:, labels[pick], np.arange(len(pick))] -= 1
        p /= p.shape[0] * p.shape[2]
        d_states = np.matmul(net.to_label.T, p)
        grads = [*net.forward.back(steps, kept, d_states[:, :H]), *net.backward.back(steps[::-1], kept_back, d_states[::-1, H:]), np.einsum("tkn,thn->kh", p, states), p.sum((0, 2))[:, None]]
        pace = rate * min(1.0, 2 * (1 - update / (updates + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= pace * (m / (1 - 0.9**update)) / (np.sqrt(v / (1 - 0.99**update)) + 1e-8)
    return net


def training_windows(raw: bytes) -> np.ndarray:
    """All windows of a text in a row, the last one filled up with zeros."""
    out = np.zeros(max(1, -(-len(raw) // WINDOW)) * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1, WINDOW)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 192) -> ByteGRU | None:
    """Learn from the whole texts of at most ``per_lang`` documents of each language, picked by hash.

    The pick is one document for each hash slot of a language, so it is the
    same however rows are dealt; only picked texts reach the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & F.col("id").isNotNull())
    langs = sorted(r.lang for r in usable.select("lang").distinct().collect())
    if not langs:
        return None
    draw, size = F.xxhash64("id", F.lit(11)), F.octet_length("text").cast("long")
    picked = usable.groupBy("lang", F.pmod(draw, F.lit(per_lang)).alias("slot")).agg(F.min_by(F.struct("id", size.alias("size")), F.struct(draw, "id")).alias("p"))
    picked = materialize(picked.select("lang", "slot", "p.id", "p.size"), "picked")
    # fewer slots of each language, where all whole texts would be too many
    slots, held = per_lang, picked.agg(F.sum("size").alias("n")).first().n
    if held > TRAIN_BYTES:
        slots = max(1, per_lang * TRAIN_BYTES // held)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("slot"))  # at most per_lang rows a language
    ids = picked.withColumn("rank", rank).where(F.col("rank") <= slots).select("id").distinct()
    number = {lang: k for k, lang in enumerate(langs)}
    found = usable.join(F.broadcast(ids) if len(langs) <= BROADCAST_LANGS else ids, "id", "left_semi")
    one = found.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("r"))
    sample = sorted(one.select(F.col("id").cast("string").alias("id"), "r.lang", "r.text").collect(), key=lambda r: r.id)
    discard(picked)
    windows = [training_windows(r.text.encode()) for r in sample]
    labels = np.repeat([number[r.lang] for r in sample], [len(w) for w in windows])
    return train(np.concatenate(windows), labels, langs)


def identify(docs: DataFrame, net: ByteGRU | None, *, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` named c0, c1, ..., then lang_pred and score of the text in ``text_col``."""
    spark = docs.sparkSession
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    if net is None:
        return rows.withColumn("lang_pred", F.lit(UNDECIDED)).withColumn("score", F.lit(0.0))
    ship_package(spark)
    shared = spark.sparkContext.broadcast(net)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    text_at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            for lo, hi in row_chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                p = net.documents(part, at)
                letters = np.concatenate([[0], np.cumsum(letter[part])])[at]
                decided = np.diff(letters) > 0
                for i in np.flatnonzero(~decided & (np.diff(at) > 0)).tolist():
                    decided[i] = any(map(str.isalpha, part[at[i] : at[i + 1]].tobytes().decode()))
                best = p.argmax(1)
                names = [net.langs[k] if ok else UNDECIDED for k, ok in zip(best.tolist(), decided.tolist(), strict=True)]
                score = np.where(decided, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(tidied(predict), ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", lang_pred string, score double")


def recognised(docs: DataFrame, *, least_score: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose language is decided with at least this score, with their columns as they are. Learns from ``docs``' own langs."""
    found = identify(docs, fit(docs))
    return found.where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= least_score)).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
