"""Token ids of whole texts by a public tokenizer, with each distinct spaced word encoded once.

Both byte-level and word-end vocabularies split a text before every run of
spaces that follows a word, so the ids of a text are the ids of its units (a
run of spaces and the word after it) in a row. A chunk of text is cut into
units by numpy, each distinct unit is encoded by the library once for a task,
and the ids are gathered back. Texts in which that cut could matter (other
white space than ASCII's, or a special token's string) are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from tracemill.llm.textarrays import CHUNK_BYTES, mix, row_chunks, utf8, word_hashes, words

SPACES = b" \t\n\v\f\r"
CASED = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
MOST_UNITS = 1_000_000
_encoders: dict[tuple[int, int], "UnitEncoder"] = {}


class KeySlots:
    """64-bit keys to dense numbers 0, 1, ...: an open-addressing table probed for whole arrays at once."""

    def __init__(self, bits: int = 21):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int32)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        out = np.full(len(keys), -1, np.int32)
        rest, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(rest):
            held, number = self.keys[at], self.numbers[at]
            same = (held == keys[rest]) & (number >= 0)
            out[rest[same]] = number[same]
            go = ~same & (number >= 0)
            rest, at = rest[go], (at[go] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new, distinct keys in their order."""
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        rest, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(rest):
            free = self.numbers[at] < 0
            self.keys[at[free]] = keys[rest[free]]
            self.numbers[at[free]] = numbers[rest[free]]
            lost = self.numbers[at] != numbers[rest]
            rest, at = rest[lost], (at[lost] + 1) & int(self.mask)


def encoder(tokenizer_json: str, most_units: int = MOST_UNITS) -> "UnitEncoder":
    """This worker's encoder, which later tasks in the same process go on using until a task of another kind runs there."""
    key = hash(tokenizer_json), most_units
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = UnitEncoder(tokenizer_json, most_units)
    return _encoders[key]


class UnitEncoder:
    """Encodes Arrow text columns; keeps at most ``most_units`` units' ids."""

    def __init__(self, tokenizer_json: str, most_units: int = MOST_UNITS):
        self.most_units = most_units
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        model = json.loads(tokenizer_json)
        suffix = model["model"].get("end_of_word_suffix") or ""
        self.spaced = model["normalizer"] is None
        sizes = np.zeros(max(model["model"]["vocab"].values()) + 1, np.int64)
        for token, number in model["model"]["vocab"].items():  # byte-level: a character of a token stands for a byte
            sizes[number] = len(token.removesuffix(suffix) if suffix else token)
        self.sizes = sizes
        self._forget()

    def _forget(self, least: int = 0) -> None:
        self.known = KeySlots(int(1.45 * max(least, self.most_units)).bit_length())
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of each text, without the character offsets that it otherwise tracks."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, ids in each), from units encoded as runs of text of some thousand characters."""
        flat, counts = [], []
        for i in range(0, len(units), 400):
            part = units[i : i + 400]
            if self.spaced:
                text, bounds = b"".join(part).decode(), list(map(len, part))
            else:  # this kind drops white space and changes case first, which can change sizes
                text = self.tokenizer.normalizer.normalize_str(b" ".join(u.strip(SPACES) for u in part).decode())
                pieces = text.split(" ")
                bounds = [len(u.encode()) for u in pieces] if len(pieces) == len(part) else []
            ids = np.array(self._library([text])[0], np.int64) if text else np.zeros(0, np.int64)
            reach, ends = np.cumsum(self.sizes[ids]), np.cumsum(bounds)
            cut = np.searchsorted(reach, ends, "right")
            if not len(bounds) or np.any(np.concatenate([[0], reach])[cut] != ends) or cut[-1] != len(ids):
                each = self._library([u.decode() for u in part])
                ids, cut = np.array([x for e in each for x in e], np.int64), np.cumsum([len(e) for e in each])
            flat.append(ids.astype(np.uint32))
            counts.append(np.diff(cut, prepend=0))
        return np.concatenate(flat), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        flat, counts = self._ids_of(units)
        at = self.known.size
        while at + len(keys) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.count[at : at + len(keys)] = counts
        self.begin[at : at + len(keys)] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.known.add(keys)

    def chunks(self, column, end_id: int, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids of these rows with end_id after each, offsets)."""
        data, offsets = utf8(column)
        for lo, hi in row_chunks(offsets, most):
            part = data[offsets[lo] : offsets[hi]]
            ids, at = self._encode(part, offsets[lo : hi + 1] - offsets[lo], end_id)
            yield lo, hi, ids, at

    def _encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        whole = rows_to_encode_whole(data, offsets)
        starts, ends, first = words(data, offsets)
        # a unit reaches from the end of the word before it, or from its row's start
        begins = np.empty(len(starts), np.int64)
        begins[1:] = ends[:-1]
        begins[:1] = 0
        lead = first[:-1][first[:-1] < first[1:]]
        begins[lead] = offsets[:-1][first[:-1] < first[1:]]
        # white space after a row's last word (or alone in it) is a unit of its own
        last_end = offsets[:-1].copy()
        some = first[1:] > first[:-1]
        last_end[some] = ends[first[1:][some] - 1]
        tail = np.flatnonzero(last_end < offsets[1:])
        row = np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(first)), tail])
        begins, ends = np.concatenate([begins, last_end[tail]]), np.concatenate([ends, offsets[1:][tail]])
        if whole.any():
            keep = ~whole[row]
            row, begins, ends = row[keep], begins[keep], ends[keep]
        order = np.argsort(row, kind="stable") if len(tail) else None
        if order is not None:
            row, begins, ends = row[order], begins[order], ends[order]
        hashes = word_hashes(data, begins, ends, CASED)
        slot = self.known.find(hashes)
        if (slot < 0).any():
            missing = np.flatnonzero(slot < 0)
            keys, where = np.unique(hashes[missing], return_index=True)
            if self.known.size + len(keys) > self.most_units:
                missing = np.arange(len(hashes))
                keys, where = np.unique(hashes, return_index=True)
                self._forget(len(keys))
            raw = data.tobytes()
            b, e = begins[missing[where]].tolist(), ends[missing[where]].tolist()
            self._learn(keys, [raw[i:j] for i, j in zip(b, e, strict=True)])
            slot[missing] = self.known.find(hashes[missing])
        counts = self.count[slot]
        flat = self.pool[_spans(self.begin[slot], counts)]
        sizes = np.bincount(row, counts, len(offsets) - 1).astype(np.int64)
        direct = {}
        if whole.any():
            for r in np.flatnonzero(whole).tolist():
                text = data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8")
                direct[r] = np.array(self._library([text])[0], np.uint32)
                sizes[r] = len(direct[r])
        at = np.zeros(len(offsets), np.int64)
        np.cumsum(sizes + 1, out=at[1:])
        out = np.empty(int(at[-1]), np.uint32)
        open_ = np.ones(len(out), bool)
        open_[at[1:] - 1] = False
        out[at[1:] - 1] = end_id
        for r, ids in direct.items():
            out[at[r] : at[r] + len(ids)] = ids
            open_[at[r] : at[r] + len(ids)] = False
        out[open_] = flat
        return out, at


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i] + count[i] - 1 for each i, in a row."""
    total = int(count.sum())
    jump = np.ones(total, np.int64)
    some = count > 0
    begin, count = begin[some], count[some]
    if not len(begin):
        return np.zeros(0, np.int64)
    heads = np.cumsum(count) - count
    jump[heads[1:]] = begin[1:] - (begin[:-1] + count[:-1] - 1)
    jump[0] = begin[0]
    return np.cumsum(jump)


def rows_to_encode_whole(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space or separators beyond ASCII's six, or with '<|'."""
    flag = np.zeros(len(data) + 2, bool)
    n = len(data)
    if n:
        flag[:n] = (data >= 0x1C) & (data <= 0x1F) | (data == 0)
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        for lead in (0x3C, 0xC2, 0xE1, 0xE2, 0xE3):
            at = np.flatnonzero(data == lead)
            if not len(at):
                continue
            b, c = padded[at + 1], padded[at + 2]
            if lead == 0x3C:
                hit = b == 0x7C
            elif lead == 0xC2:
                hit = (b == 0x85) | (b == 0xA0)
            elif lead == 0xE1:
                hit = (b == 0x9A) | (b == 0xA0)
            elif lead == 0xE2:
                hit = (b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81)
            else:
                hit = (b == 0x80) & (c == 0x80)
            flag[at[hit]] = True
    hits = np.flatnonzero(flag[:n])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, hits, "right") - 1] = True
    return out
