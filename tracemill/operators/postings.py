"""One long postings relation stands for every reverse index.

postings(index, key, id, seq, pos): ``id`` is listed under ``key`` of ``index``,
ordered by (seq, pos). Rows, not lists, are stored: an append is a union, and a
list is drawn only for the keys that a query asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.schemas import DERIVED_INDEXES, FAMILIES, Index

EVENT_INDEXES = ("time", "actor", "channel", "kind", "parent", "root", "payload", "event_cid")


def event_postings(events: DataFrame, indexes: tuple[str, ...] = EVENT_INDEXES) -> DataFrame:
    """Postings of the event indexes asked for; a key repeated in an event counts once."""
    many = {"time": "time_keys", "actor": "actor_keys", "channel": "channel_keys", "parent": "parent_event_ids"}
    one = {"kind": F.coalesce("value_kind", F.lit("")), "root": F.coalesce("root_event_id", "event_id"), "payload": F.col("payload_cid"), "event_cid": F.col("event_cid")}

    def entry(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("index"), key.alias("key"))

    def entries_of(name: str, column: str) -> Column:
        return F.transform(F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<string>"))), lambda k: entry(name, k))

    lists = [entries_of(n, c) for n, c in many.items() if n in indexes]
    single = [entry(n, c) for n, c in one.items() if n in indexes]
    entries = F.concat(*lists, *([F.array(*single)] if single else []))
    return events.select("seq", F.col("event_id").alias("id"), F.posexplode(entries).alias("pos", "e")).select("e.index", "e.key", "id", "seq", "pos").where("key is not null")


def _pointer_schema(indexes: tuple[Index, ...]) -> str:
    """The fields of pointers that indexes read, as a struct: lists of texts, or texts."""
    named = {x for i in indexes for x in (i.key, i.value) if x != "ID"}
    return ", ".join(f"{n.removesuffix('[]')} {'array<string>' if n.endswith('[]') else 'string'}" for n in sorted(named))


def _values(spec: str) -> Column:
    if spec == "ID":
        return F.array("id")
    field = F.col("p")[spec.removesuffix("[]")]
    return F.coalesce(field, F.array().cast("array<string>")) if spec.endswith("[]") else F.array_compact(F.array(field))


def _entries(index: Index) -> Column:
    keys, values = _values(index.key), _values(index.value)
    if index.skip_blank:
        keys = F.filter(keys, lambda k: k != "")
    pair = lambda k, v: F.struct(F.lit(index.name).alias("index"), k.alias("key"), v.alias("id"))
    return F.flatten(F.transform(keys, lambda k: F.transform(values, lambda v: pair(k, v))))


def derived_postings(artifacts: DataFrame, indexes: tuple[Index, ...] = DERIVED_INDEXES) -> DataFrame:
    """Postings of all artifact indexes, each (index, key, id) once at its first place: one scan, each pointer parsed once."""
    entries = F.array().cast("array<struct<index:string,key:string,id:string>>")
    for family in FAMILIES:
        specs = [i for i in indexes if i.family == family]
        if specs:
            entries = F.when(F.col("family") == family, F.concat(*map(_entries, specs))).otherwise(entries)
    parsed = artifacts.select("seq", "family", "id", F.from_json("pointer", _pointer_schema(indexes)).alias("p"))
    return first_of_each(parsed.select("seq", F.posexplode(entries).alias("pos", "e")).select("e.index", "e.key", "e.id", "seq", "pos"))


def first_of_each(postings: DataFrame) -> DataFrame:
    first = postings.groupBy("index", "key", "id").agg(F.min(F.struct("seq", "pos")).alias("at"))
    return first.select("index", "key", "id", "at.seq", "at.pos")


def lookup(postings: DataFrame, index: str, key: str | Column) -> DataFrame:
    """id, seq, pos under one key, in order; no rows for an unknown key."""
    return postings.where((F.col("index") == index) & (F.col("key") == key)).select("id", "seq", "pos").orderBy("seq", "pos")


def lookup_many(postings: DataFrame, index: str, keys: DataFrame) -> DataFrame:
    """key, ids (ordered) for a table of keys; an unknown key has an empty list."""
    wanted = keys.select("key").distinct()
    found = postings.where(F.col("index") == index).join(wanted, "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "id"))).alias("entries"))
    return wanted.join(found, "key", "left").select("key", F.coalesce(F.transform("entries", lambda e: e["id"]), F.array().cast("array<string>")).alias("ids"))


def ordered_lists(postings: DataFrame) -> DataFrame:
    """index, key, n, ids: every list drawn, in order."""
    drawn = postings.groupBy("index", "key").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "id"))).alias("entries"))
    return drawn.select("index", "key", F.size("entries").cast("long").alias("n"), F.transform("entries", lambda e: e["id"]).alias("ids"))


def get_many_events(events: DataFrame, ids: DataFrame) -> DataFrame:
    """event_id, found and the columns of events for each distinct id of a table; an unknown one is not found and has nulls."""
    asked = ids.select("event_id").distinct()
    held = events.withColumn("__found", F.lit(True))
    return asked.join(held, "event_id", "left").select("event_id", F.coalesce("__found", F.lit(False)).alias("found"), *(c for c in events.columns if c != "event_id"))


def all_of(postings: DataFrame, conditions: list[tuple[str, str]]) -> DataFrame:
    """id, seq of ids that are listed under every one of the (index, key) conditions."""
    distinct = list(dict.fromkeys(conditions))
    if not distinct:
        return postings.where("false").select("id", "seq")
    match = F.lit(False)
    for index, key in distinct:
        match = match | ((F.col("index") == index) & (F.col("key") == key))
    return postings.where(match).groupBy("id").agg(F.count_distinct("index", "key").alias("n"), F.min("seq").alias("seq")).where(F.col("n") == len(distinct)).select("id", "seq")


def index_stats(postings: DataFrame) -> DataFrame:
    """index, keys, entries, longest."""
    return postings.groupBy("index", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("index").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("entries"), F.max("n").alias("longest"))


def event_state_stats(events: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: the number of events and of distinct keys of each event index."""
    keys = postings.groupBy("index", "key").agg(F.lit(1).alias("one"))
    counted = keys.agg(*(F.count_if(F.col("index") == i).alias(i + "_keys") for i in EVENT_INDEXES))
    return events.agg(F.count(F.lit(1)).alias("events")).crossJoin(counted)  # one row each


def derived_state_stats(artifacts: DataFrame) -> DataFrame:
    """One row: distinct artifacts of each family."""
    return artifacts.select("family", "id").distinct().agg(*(F.count_if(F.col("family") == f).alias(f.replace("-", "_") + "_rows") for f in FAMILIES))
