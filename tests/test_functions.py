import json
import urllib.parse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.functions import deltas, identity, paths

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_canonical_json_column_matches_plain_json(spark):
    texts = ['{"b":1.0,"a":[1e16,-0.0,null,"é\\u001f"]}', "[]", '{"z":{"y":2,"x":1}}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in df.select("i", identity.canonical_json_column(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [None if t is None else identity.canonical_json(json.loads(t)) for t in texts]


def test_cids(spark):
    cid = identity.cid(b"x")
    row = one(spark, identity.cid_column(F.lit("x")).alias("cid"), identity.digest_from_cid(F.lit(cid)).alias("digest"), identity.content_id_column("run", F.lit("x")).alias("id"))
    assert (row.cid, row.digest) == (cid, identity.digest_of(cid))
    assert row.id == "run:" + identity.sha256_hex(b"x")
    with pytest.raises(ValueError):
        identity.digest_of("cidv0-local-sha256:12")
    with pytest.raises(Exception, match="not a CID"):
        one(spark, identity.digest_from_cid(F.lit("sha256:" + "0" * 64)))


@FEW
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x2FF), max_size=6), max_size=4))
def test_prefix_keys_match_quoting(spark, path):
    row = one(spark, paths.prefix_keys(F.array(*map(F.lit, path)).cast("array<string>")).alias("k"), paths.path_key(F.array(*map(F.lit, path)).cast("array<string>")).alias("p"))
    assert list(row.k) == paths.plain_prefix_keys(path)
    assert row.p == "/" + "/".join(urllib.parse.quote(x, safe="") for x in path)


def test_times(spark):
    for text, iso in (("2026-06-27T14:00:05Z", "2026-06-27T14:00:05Z"), ("2026-06-27T16:00:05.25+02:00", "2026-06-27T14:00:05.250000Z"), ("2026-01-02T03:04:05", "2026-01-02T03:04:05Z")):
        parts = paths.parse_time(text)
        assert parts["iso"] == iso
        ts = F.to_timestamp(F.lit(iso))
        row = one(spark, paths.utc_iso(ts).alias("iso"), paths.time_keys(ts).alias("keys"), paths.day_key(paths.time_path(ts)).alias("day"), paths.hour_shard(ts).alias("shard"))
        assert (row.iso, list(row.keys), row.shard) == (iso, paths.plain_time_keys(parts), paths.plain_time_keys(parts)[-1])
        assert row.day == f"{parts['year']}-{parts['month']}-{parts['day']}"


def test_leaf_key_needs_a_key(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, paths.leaf_key_or_blank(empty).alias("k")).k == ""
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        one(spark, paths.leaf_key(empty).alias("k"))


@FEW
@given(st.lists(st.integers(0, 1000), max_size=12))
def test_delta_coding_round_trip(spark, ids):
    column = F.array(*map(F.lit, ids)).cast("array<bigint>")
    row = one(spark, deltas.delta_encode(column).alias("e"), deltas.delta_decode(deltas.delta_encode(column)).alias("d"))
    assert list(row.d) == sorted(set(ids))
    assert all(g > 0 for g in row.e[1:])


def test_delta_values_and_encodings(spark):
    assert list(one(spark, deltas.delta_encode(F.array(*map(F.lit, [3, 1, 1, 2])).cast("array<bigint>")).alias("e")).e) == [1, 1, 1]
    odd = spark.createDataFrame([("/s", "t", "other", [1])], "shard_path string, token string, encoding string, gaps array<bigint>")
    with pytest.raises(Exception, match="unsupported postings encoding"):
        deltas.decompress_postings(odd).collect()
