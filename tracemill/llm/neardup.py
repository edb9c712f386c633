"""Near-duplicate documents: one-permutation hashing, banded buckets and star-shaped candidate edges.

A document's set is its distinct shingles of SHINGLE words. Its signature keeps
the least hash in each of BINS bins of the hash range; an empty bin borrows
from the first filled bin of its own fixed permutation (optimal densification).
Bands of a few bins make buckets. Documents with equal sets are one class, and
candidates are found between class representatives only.

Candidate edges are stars: in every bucket each representative meets the least
one, its hub. Edges are confirmed on full sets, and components drawn. A link
between two members that are both unlike the hub would be lost, so a second,
exact search goes on among the members of all stars whose members are still in
several components. They order their shingles from rare to frequent, by counts
over these members; two sets alike share a shingle in the first few places
(prefix filter), where a copy has its own edits and not what its whole group
shares, so members meet that share rare shingles only. A shingle whose holders
are in one component has nothing more to say and is dropped for good, as
components only merge. Where a shingle still brings many together, that group
becomes a star in its turn before its pairs are made. The layout of bands
follows the threshold s: a pair at it shares no bucket with probability
(1 - s ** rows) ** bands, below one in a million for independent bins.

A row is a document. Rows that share a doc_id but not their text are numbered,
in the order of their ids, and searched under these numbers.

Nulls: a null, empty or blank text has an empty set and is linked with
nothing; a null doc_id is its own row with a null component. Repeated rows
come back as often as they occur. Empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.textarrays import hashed_words, mix, row_chunks, tidied, utf8
from tracemill.operators.batches import numbered
from tracemill.operators.components import components
from tracemill.scratch import discard, materialize, ship_package

SHINGLE = 5
BINS = 128
#: Ids that a broadcast may hold; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Meetings of the second search that one class may cause on average before its groups become stars first.
PAIRS_EACH = 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles of every row, sorted within a row; first of each row and the count at the end)."""
    w, first = hashed_words(data, offsets)
    n_words = np.diff(first)
    rows = len(n_words)
    seeds = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    row_of = np.repeat(np.arange(rows), n_words)
    full = max(0, len(w) - size + 1)
    h = np.zeros(full, np.uint64)
    for k in range(size):
        h += w[k : k + full] * seeds[k]
    whole = row_of[:full] == row_of[size - 1 : size - 1 + full] if full else np.zeros(0, bool)
    values, owner = mix(h)[whole], row_of[:full][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):  # fewer words than a shingle: the whole sequence is one
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n_words[short] > k
            extra[has] += w[first[short][has] + k] * seeds[k]
        values = np.concatenate([values, mix(extra + n_words[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(rows + 1))


def _permutations() -> np.ndarray:
    """For each bin a fixed order in which to look for a filled one."""
    rank = mix(np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS) + np.uint64(0x51ED270B))
    return np.argsort(rank, axis=1)


PERMUTATIONS = _permutations()
BIN_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
BAND_SEEDS = mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def layout(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows that miss fewer than one pair in a million at the threshold."""
    for rows in range(8, 1, -1):
        bands = BINS // rows
        if (1 - (percent / 100) ** rows) ** bands < 1e-6:
            return bands, rows
    return BINS, 1


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted, non-empty set."""
    bins = (shingles >> BIN_SHIFT).astype(np.int64)
    head = np.ones(len(bins), bool)
    head[1:] = bins[1:] != bins[:-1]
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[head]], filled[bins[head]] = shingles[head], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = PERMUTATIONS[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    parts, key = sig[: bands * rows].reshape(bands, rows), BAND_SEEDS[:bands].copy()
    for r in range(rows):
        key = mix(key ^ parts[:, r]) + np.uint64(r)
    return key


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_key (128 bits of the set; null for an empty one), bands."""
    ship_package(docs.sparkSession)
    n_bands, n_rows = layout(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in row_chunks(offsets):
                values, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keys: list[bytes | None] = []
                rows: list[np.ndarray | None] = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    keys.append(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    rows.append(band_keys(signature(values[a:b]), n_bands, n_rows).view(np.int64) if b > a else None)
                left = [batch.column(k).slice(lo, hi - lo) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*left, pa.array(np.diff(at)), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(tidied(sign), "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _held(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of these ids (doc_id, one row each)."""
    ids = materialize(ids, "involved")
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent`` per cent similarity; ``texts`` is (doc_id, text)."""
    ship_package(pairs.sparkSession)
    held = _held(texts, pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    first = held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            da, oa = utf8(batch.column(2))
            db, ob = utf8(batch.column(3))
            ok = np.zeros(batch.num_rows, bool)
            for lo, hi in row_chunks(oa + ob):
                va, fa = shingle_sets(da[oa[lo] : oa[hi]], oa[lo : hi + 1] - oa[lo])
                vb, fb = shingle_sets(db[ob[lo] : ob[hi]], ob[lo : hi + 1] - ob[lo])
                for i in range(hi - lo):
                    x, y = va[fa[i] : fa[i + 1]], vb[fb[i] : fb[i + 1]]
                    if len(x) and len(y):
                        both = np.concatenate([x, y])
                        both.sort(kind="stable")
                        common = int((both[1:] == both[:-1]).sum())
                        ok[lo + i] = 100 * common >= percent * (len(both) - common)
            picked = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked)], ["a", "b"])

    joined = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(tidied(check), "a long, b long")


def rare_prefixes(reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """rep, n, shingle, place: the shingles that two of these sets share and that stand in the first places from rare to frequent."""
    ship_package(reps.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in row_chunks(offsets):
                values, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["rep", "shingles"])

    sets = _held(texts, reps.select(F.col("rep").alias("doc_id")).distinct()).mapInArrow(tidied(read), "rep long, shingles array<long>").dropDuplicates(["rep"])
    each = materialize(sets.select("rep", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    frequency = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(frequency, "shingle")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle"))
    # shingles of one set alone take the first places and meet nothing
    place = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("rep")) + rank - 1
    return shared.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)).select("rep", "n", "shingle", "place")


class _Search:
    """Links found so far, their components and the pairs compared."""

    def __init__(self, texts: DataFrame, percent: int):
        self.texts, self.percent = texts, percent
        self.links: list[DataFrame] = []
        self.tried: list[DataFrame] = []
        self.roots: DataFrame | None = None

    def add(self, pairs: DataFrame) -> bool:
        """Compare the pairs (a, b) that weren't yet, join components; whether there was a link."""
        for before in self.tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        self.tried.append(materialize(pairs, "pairs"))
        found = materialize(confirm(self.tried[-1], self.texts, self.percent), "links")
        some = not found.isEmpty()
        if self.roots is None or some:
            self.links.append(found)
            discard(*([] if self.roots is None else [self.roots]))
            every = self.links[0]
            for more in self.links[1:]:
                every = every.unionByName(more)
            self.roots = materialize(components(every), "roots")
        return some

    def rooted(self, members: DataFrame) -> DataFrame:
        """Adds root, the component of each row's ``rep``."""
        return members.join(self.roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    def apart(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs (a, b) of rows (shingle, rep, n, root, place) in different components that can be alike."""
        other = right.select("shingle", *(F.col(c).alias(c + "2") for c in ("rep", "n", "root", "place")))
        # an overlap that the threshold asks of two sets leaves so many places before the first common shingle
        need = F.ceil(F.lit(self.percent) * (F.col("n") + F.col("n2")) / F.lit(100 + self.percent))
        early = (F.col("place") <= F.col("n") - need) & (F.col("place2") <= F.col("n2") - need)
        met = left.join(other, "shingle").where((F.col("root") != F.col("root2")) & _alike(F.col("n"), F.col("n2"), self.percent) & early)
        return met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()

    def inside(self, stars: DataFrame, most: int) -> None:
        """The second search over stars (a, rep), each member of a star once."""
        members = self.rooted(stars)
        open_ = members.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("a")
        reps = materialize(members.join(open_, "a").select("rep").distinct(), "members")
        if reps.isEmpty():
            return
        held = materialize(rare_prefixes(reps, self.texts, self.percent), "prefixes")
        help_ = True
        while True:
            # one row a member is rooted, and its shingles take the root from it
            now = held.join(self.rooted(reps), "rep")
            counted = now.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("size"))
            groups = counted.groupBy("shingle").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("in_main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
            groups = materialize(groups.select("shingle", "main", "all", (F.col("all") - F.col("in_main")).alias("outside")), "groups")
            due = groups.agg(F.coalesce(F.sum(F.col("outside") * F.col("all")), F.lit(0)).alias("pairs")).first().pairs
            met = materialize(now.join(groups.select("shingle", "main"), "shingle"), "met")
            discard(held)
            outside = met.where("root <> main")
            closing = due <= most or not help_
            if not closing:
                hubs = outside.groupBy("shingle").agg(F.min("rep").alias("hub"))
                outside = outside.join(hubs, "shingle").where("rep = hub")
            help_ = self.add(self.apart(outside, met))
            discard(groups)
            if closing:
                discard(met)
                return
            held = met.select("rep", "n", "shingle", "place")
            held._scratch_path = met._scratch_path


def _one_id_a_text(signed: DataFrame) -> DataFrame | None:
    """doc_id, text_key, row_no: a number for every text of an id, in the order of ids; None where no id has two texts."""
    texts = signed.where("set_key is not null and doc_id is not null").select("doc_id", "text_key").distinct()
    if texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    return numbered(texts.withColumn("place", F.struct("doc_id", "text_key")), "place").drop("place")


def _searched(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, is_root (whether the row's text and id are those that name the component; null for an empty set or id)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(signatures(rows, percent=percent), "signatures")
    texts, ids, named = rows, signed, _one_id_a_text(signed)
    if named is not None:
        named = materialize(named, "numbered")
        texts = rows.withColumn("text_key", F.xxhash64("text")).join(named, ["doc_id", "text_key"]).dropDuplicates(["row_no"]).select(F.col("row_no").alias("doc_id"), "text")
        ids = signed.join(named, ["doc_id", "text_key"]).drop("doc_id").withColumnRenamed("row_no", "doc_id")
    classes = ids.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rep", "n")).alias("hub")).where("size > 1")
    stars = materialize(members.join(hubs, "bucket").where(F.col("rep") != F.col("hub.rep")).select(F.col("hub.rep").alias("a"), F.col("hub.n").alias("n_a"), "rep", "n").distinct(), "stars")
    search = _Search(texts, percent)
    search.add(stars.where(_alike(F.col("n"), F.col("n_a"), percent)).select("a", F.col("rep").alias("b")))
    search.inside(stars.select("a", "rep"), PAIRS_EACH * max(1000, classes.count()))
    discard(stars)

    rooted = search.rooted(classes.select("set_key", "rep")).select("set_key", "root")
    if named is not None:
        rooted = rooted.join(named.select(F.col("row_no").alias("root"), F.col("doc_id").alias("root_id"), F.col("text_key").alias("root_key")), "root").drop("root")
    else:
        rooted = rooted.withColumnRenamed("root", "root_id").withColumn("root_key", F.lit(None).cast("long"))
    out = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(rooted, "set_key", "left")
    own = (F.col("doc_id") == F.col("root_id")) & F.coalesce(F.col("text_key") == F.col("root_key"), F.lit(True))
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("root_id", "doc_id").alias("component_id"), own.alias("is_root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links of at least ``percent`` per cent), kept."""
    found = _searched(docs, id_col, text_col, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component the one with the least id (and, of texts of that id, the least hash).

    Of repeated rows, equal in id and text, one stays; rows with a null id all
    stay, as do documents with an empty set, which are linked with nothing.
    """
    found = materialize(_searched(docs, id_col, text_col, percent), "components")
    numbers = found.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id", F.coalesce("text_key", F.lit(0))).alias("d"), F.count_if(~F.col("is_root")).alias("gone")).first()
    key, hashed = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    gone = found.where(~F.col("is_root")).select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct()
    left = docs.join(F.broadcast(gone) if numbers.gone <= BROADCAST_IDS else gone, (key == F.col("__gone_id")) & (hashed == F.col("__gone_key")), "left_anti")
    if numbers.n == numbers.d:
        return left
    whole = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
    return whole.unionByName(left.where(F.col(id_col).isNull()))
