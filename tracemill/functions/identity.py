"""Content identities: canonical JSON, CIDs and content ids, as plain functions and as columns.

Canonical JSON has sorted keys, no spaces, no escapes beyond JSON's own and no
NaN. Objects of a fixed layout that hold strings and integers alone can be
built by ``to_json`` of a struct with sorted fields; open objects go through
``canonical_json_column``, an Arrow UDF, because Spark prints floats and control
characters differently.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

CID_PREFIX = "cidv0-local-sha256:"


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def ascii_json(value: Any) -> str:
    """The form that batch manifests and Merkle leaves use: as canonical JSON, but ASCII alone."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def cid(data: bytes) -> str:
    return CID_PREFIX + sha256_hex(data)


def content_id(kind: str, value: Any) -> str:
    return f"{kind}:{sha256_hex(canonical_json(value).encode())}"


def stable_key(label: str, value: Any) -> str:
    return content_id(label, value)


def digest_of(cid_: str) -> str:
    digest = cid_.removeprefix(CID_PREFIX)
    if digest == cid_ or len(digest) != 64:
        raise ValueError(f"not a CID: {cid_}")
    return digest


def cid_column(data: Column) -> Column:
    return F.concat(F.lit(CID_PREFIX), F.sha2(data, 256))


def content_id_column(kind: str, canonical: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.sha2(canonical, 256))


def digest_from_cid(cid_: Column) -> Column:
    """The digest of a CID column; a value that is no CID raises an error, a null stays null."""
    good = cid_.startswith(CID_PREFIX) & (F.length(cid_) == len(CID_PREFIX) + 64)
    return F.when(cid_.isNull() | good, F.substr(cid_, F.lit(len(CID_PREFIX) + 1))).otherwise(F.raise_error(F.concat(F.lit("not a CID: "), cid_)))


@cache
def _canonical_udf() -> Callable[[Column], Column]:
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def canonical(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) for v in values.to_pylist()], pa.string())

    canonical.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return arrow_udf(canonical, "string")


def canonical_json_column(json_text: Column) -> Column:
    """Canonical form of JSON texts; malformed ones raise an error."""
    return _canonical_udf()(json_text)


def sorted_json(**fields: Column) -> Column:
    """Canonical JSON of an object whose values are strings, integers, arrays or structs built by this function's rule."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
