"""Benchmark decontamination over a distributed positional inverted index, in Spark SQL expressions alone.

The index holds a posting (term, document, position) for every word of every
document. It knows nothing of a benchmark, so it can be kept and searched
again. Terms are 64-bit hashes of words, so rows are short and of one width
however long words are.

A search goes by windows of an item: WINDOW consecutive words, or a shorter
item whole. Each window is looked up by its two rarest words, by counts over
the index: their posting lists are intersected, adjusted for their offsets, and
where both lie within a window's length of each other, the postings around the
rarest one are drawn from the index by position. There the item's words and
the document's are aligned and intersected to both sides, which gives every
exact occurrence of every window; a proximity match asks only that a window's
words all lie around the rarest one, in any order.

No posting list is gathered into one task. Lists meet by document, word and
stretch of positions, so a posting meets a bounded number of others, whatever
passages documents share.

Nulls: a null text has no words; a null item_id counts as no item. Items
without words match nothing. Rows that share a doc_id are told apart by their
text, repeated rows come back as often as they occur. Empty tables give no
rows, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.scratch import materialize

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_EDGES = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows, of four numbers each at most, that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Stands for the document itself among its words; no word is empty.
HEADER = ""


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for none."""
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_EDGES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


def _small(df: DataFrame) -> DataFrame:
    """``df``, rows of a few numbers, to be broadcast only where its count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def term(word: Column) -> Column:
    return F.xxhash64(word)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, doc_key, pos of every word of every row; and a row of the HEADER's term for each row, its pos the number of words."""
    ws = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("doc_key"), words(F.col(text_col).cast("string")).alias("ws"))
    each = ws.select("doc_id", "doc_key", F.size("ws").alias("n"), F.posexplode(F.concat(F.array(F.lit(HEADER)), F.col("ws"))).alias("at", "word"))
    return each.select(term(F.col("word")).alias("term"), "doc_id", "doc_key", F.when(F.col("at") == 0, F.col("n")).otherwise(F.col("at") - 1).alias("pos"))


def headers(index: DataFrame) -> DataFrame:
    """doc_id, doc_key, n_words, one row a document row."""
    return index.where(F.col("term") == term(F.lit(HEADER))).select("doc_id", "doc_key", F.col("pos").alias("n_words"))


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of these terms (one row each)."""
    return index.where(F.col("term") != term(F.lit(HEADER))).join(_small(terms), "term")


def item_texts(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """text_key, terms (of the item's words in order), win, item_ids: each distinct item text that has words, with the ids (as strings) of its items."""
    listed = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    whole = listed.groupBy("ws").agg(F.collect_set("item_id").alias("item_ids"))
    return whole.select(F.sha2(F.array_join("ws", " "), 256).alias("text_key"), F.transform("ws", term).alias("terms"), F.least(F.lit(window), F.size("ws")).alias("win"), "item_ids")


def _around(terms: Column, at: Column, window: int) -> tuple[Column, Column]:
    """The terms before a place, nearest first, and those after it, up to window - 1 of each."""
    back = F.least(at, F.lit(window - 1))
    none = F.array().cast("array<long>")
    return F.when(at > 0, F.reverse(F.slice(terms, at - back + 1, F.greatest(back, F.lit(1))))).otherwise(none), F.slice(terms, at + 2, window - 1)


def start_terms(texts: DataFrame, counts: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """term, second, text_key, ipos, win, i_before, i_after, windows: each place of an item that is the rarest of a window, the next rarest other
    word there (null for a window of one word or repeats of it), the words around it, and the windows searched from both."""
    held = texts.select("text_key", F.posexplode("terms").alias("ipos", "term")).join(counts, "term", "left")
    ranked = held.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("ipos", F.coalesce("n", F.lit(0)).alias("n")))).alias("ranks"))
    begins = F.sequence(F.lit(0), F.size("terms") - F.col("win"))
    rare = lambda s: F.array_sort(F.transform(F.slice("ranks", s + 1, F.col("win")), lambda r: F.struct(r["n"].alias("n"), r["ipos"].alias("ipos"), F.get("terms", r["ipos"]).alias("term"))))
    windows = F.transform(begins, lambda s: F.struct(rare(s).alias("rare"), F.slice("terms", s + 1, F.col("win")).alias("window")))
    other = lambda w: F.get(F.filter(w["rare"], lambda r: r["term"] != w["rare"][0]["term"]), F.lit(0))["term"]
    found = F.transform(windows, lambda w: F.struct(w["rare"][0]["ipos"].alias("ipos"), other(w).alias("second"), w["window"].alias("window")))
    before, after = _around(F.col("terms"), F.col("w.ipos"), window)
    each = texts.join(ranked, "text_key").withColumn("w", F.explode(found))
    # a row has a window's words and those around one place: its width doesn't grow with the item
    rows = each.select("text_key", "win", F.col("w.ipos").alias("ipos"), F.get("terms", F.col("w.ipos")).alias("term"), F.col("w.second").alias("second"), before.alias("i_before"), after.alias("i_after"), "w.window")
    return rows.groupBy("text_key", "win", "ipos", "term", "second", "i_before", "i_after").agg(F.collect_set("window").alias("windows"))


def candidates(hits: DataFrame, starts: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """term, doc_id, doc_key, pos: postings of start terms that have a posting of their second term less than a window's length away."""
    pairs = starts.select("term", "second").distinct()
    alone = hits.join(_small(pairs.where("second is null").select("term").distinct()), "term", "left_semi")
    stretch = F.floor(F.col("pos") / window).cast("int")
    one = hits.join(_small(pairs.where("second is not null")), "term").select("term", "second", "doc_id", "doc_key", "pos", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    two = hits.join(_small(pairs.select(F.col("second").alias("term")).distinct()), "term", "left_semi").select(F.col("term").alias("second"), F.col("doc_id").alias("doc_id2"), F.col("doc_key").alias("doc_key"), F.col("pos").alias("pos2"), stretch.alias("stretch"))
    met = one.join(two, ["second", "doc_key", "stretch"]).where(F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.abs(F.col("pos") - F.col("pos2")) < window))
    return met.select("term", "doc_id", "doc_key", "pos").unionByName(alone.select("term", "doc_id", "doc_key", "pos")).distinct()


def neighbourhoods(index: DataFrame, found: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``found`` with before and after: the terms around each posting, nearest first, drawn from the index by position."""
    stretch = lambda pos: F.floor(F.col(pos) / window).cast("int")
    wanted = found.select(F.col("doc_id").alias("doc_id2"), "doc_key", F.col("pos").alias("centre")).distinct()
    wanted = wanted.select("*", F.explode(F.array(stretch("centre") - 1, stretch("centre"), stretch("centre") + 1)).alias("stretch"))
    # repeated rows of a document have equal postings: one of each is drawn
    held = index.where(F.col("term") != term(F.lit(HEADER))).select("doc_id", "doc_key", "pos", F.col("term").alias("near"), stretch("pos").alias("stretch"))
    drawn = held.join(_small(wanted), ["doc_key", "stretch"]).where(F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.abs(F.col("pos") - F.col("centre")) < window))
    around = drawn.groupBy("doc_id", "doc_key", "centre").agg(F.collect_set(F.struct((F.col("pos") - F.col("centre")).alias("off"), "near")).alias("a"))
    side = lambda sign: F.transform(F.array_sort(F.transform(F.filter("a", lambda x: x["off"] * sign > 0), lambda x: F.struct((x["off"] * sign).alias("off"), x["near"].alias("near")))), lambda x: x["near"])
    sides = around.select(F.col("doc_id").alias("doc_id2"), F.col("doc_key").alias("doc_key2"), F.col("centre").alias("pos2"), side(-1).alias("before"), side(1).alias("after"))
    f, g = found, sides
    return f.join(g, (F.col("doc_key") == F.col("doc_key2")) & (F.col("pos") == F.col("pos2")) & F.col("doc_id").eqNullSafe(F.col("doc_id2"))).select("term", "doc_id", "doc_key", "pos", "before", "after")


def _run(x: Column, y: Column) -> Column:
    """How many first words of two arrays are equal."""
    at = F.array_position(F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(x), F.size(y))).cast("int")


def occurrences(found: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, doc_key, text_key, exact, first, last: alignments of items at postings that hold a window exactly or in proximity."""
    met = found.join(starts, "term")
    met = met.withColumn("left", _run(F.col("before"), F.col("i_before"))).withColumn("right", _run(F.col("after"), F.col("i_after")))
    exact = F.col("left") + F.col("right") + 1 >= F.col("win")
    around = F.concat("before", F.array("term"), "after")
    near = F.exists("windows", lambda w: F.size(F.array_except(w, around)) == 0)
    return met.select("doc_id", "doc_key", "text_key", exact.alias("exact"), (exact | near).alias("near"), (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last")).where("near")


def _covered(spans: Column) -> Column:
    """Positions in the union of sorted (first, last) spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"] - 1, acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], s["last"].cast("long")).alias("end")),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, doc_key, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, one row per document row."""
    return search(materialize(build_index(docs, id_col=id_col, text_col=text_col), "index"), items, window=window)


def search(index: DataFrame, items: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """What ``contamination`` returns, of an index that is held already."""
    texts = materialize(item_texts(items, window=window), "items")
    counts = materialize(postings(index, texts.select(F.explode("terms").alias("term")).distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    starts = materialize(start_terms(texts, counts, window=window), "starts")
    hits = materialize(postings(index, starts.select(F.explode(F.array_compact(F.array("term", "second"))).alias("term")).distinct()), "hits")
    near = materialize(candidates(hits, starts, window=window), "candidates")
    found = occurrences(materialize(neighbourhoods(index, near, window=window), "neighbourhoods"), starts)
    # items are named after the spans are known, once for each document and item text
    by_text = materialize(found.groupBy("doc_key", "doc_id", "text_key").agg(F.max("exact").alias("exact"), F.collect_set(F.when(F.col("exact"), F.struct("first", "last"))).alias("spans")), "found")
    named = by_text.join(texts.select("text_key", F.explode("item_ids").alias("item_id")), "text_key")
    ids = named.groupBy("doc_key", "doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("items"), F.array_sort(F.collect_set("item_id")).alias("near_items"))
    spans = by_text.groupBy("doc_key", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    same = lambda a, b: (F.col(f"{a}.doc_key") == F.col(f"{b}.doc_key")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    joined = headers(index).alias("d").join(spans.alias("h"), same("d", "h"), "left").join(ids.alias("i"), same("d", "i"), "left")
    hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.doc_key").alias("doc_key"),
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.size(F.coalesce("near_items", none)).cast("long").alias("n_near_items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any item's window, with their columns."""
    dirty = materialize(contamination(docs, items, id_col=id_col, text_col=text_col, window=window).where("contaminated").select("doc_id", "doc_key").distinct(), "dirty")
    b = _small(dirty.toDF("__id", "__key"))
    return docs.join(b, (F.xxhash64(F.col(text_col).cast("string")) == F.col("__key")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left_anti")
