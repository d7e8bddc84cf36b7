"""Deeply nested JSON records as related flat tables.

One depth-first pass over each record emits every object in it as a tagged row:
the table it belongs to, its own key, its parent's key, its position and its
values. The visitor knows no schema: whatever holds objects becomes a table of its
own, named by the keys that lead to it. ``tagged`` yields these rows;
``write_tables`` writes them partitioned by tag and ``typed`` gives one tag its
schema. Nothing is shuffled and each payload is read once, however many tables
come out. A row's key is the path to it as delivered, so no two rows share one.

What the visitor takes as the same: keys that differ in case, underscores,
dashes or blanks; text that itself holds JSON; envelopes around a record, at any
depth; one object where an array is usual; an object whose keys are numbers,
which is an array with gaps; a text where a source object is usual, which is its
url.

Edge cases: a payload that is null, empty or no JSON gives no rows; so does one
without a record. Nulls within arrays keep their position. Very long payloads are
read whole; nesting deeper than the JSON parser allows counts as unreadable.
Arrays of plain values are one value of their object, as JSON. Records that repeat give their rows again. Columns other than the two named are
not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Branches of a record: key in plain form -> (branch, what its elements hold).
BRANCHES = {"indicators": "indicator", "indicator": "indicator", "facts": "fact", "fact": "fact"}
#: Parts of a record that hold sources and kinds of their own, never to be read as a record.
OTHER_PARTS = {"contestation", "verificationsource", "source", "sources", "scorehistory", "publication", "synthesis", "identity"}
#: Keys, in plain form, that mean the same table.
SAME_TABLE = {**BRANCHES, "sources": "source", "proxy": "proxies"}
#: Words for yes and no.
TRUE_WORDS = {"true", "yes", "oui", "ja", "si", "sí", "1", "1.0", "y", "t", "vrai", "wahr", "vero", "sì", "waar", "o", "x"}
FALSE_WORDS = {"false", "no", "non", "nein", "nee", "0", "0.0", "n", "f", "faux", "falsch", "falso", "onwaar"}
TRUTHS = {"publicinquiryheld"}
SCHEMA = "tag string, record_no bigint, row_key string, parent_key string, item_no bigint, payload string"
_PLAIN = re.compile(r"[\s_\-.]+")


def plain_key(key: str) -> str:
    return _PLAIN.sub("", key).lower()


def opened(value: Any) -> Any:
    """The value, with text that holds JSON replaced by what it holds."""
    while isinstance(value, str):
        s = value.strip().lstrip("﻿")
        if s[:1] not in ("{", "[", '"'):
            return value
        try:
            value = json.loads(s)
        except (ValueError, RecursionError):
            return value
    return value


def is_number_key(key: str) -> bool:
    return key.strip().lstrip("+-").isdigit()


def elements(value: Any) -> list[tuple[str, int, Any]]:
    """(label, position, element) of an array, of an object keyed by numbers or of a
    lone element."""
    value = opened(value)
    if isinstance(value, list):
        return [(str(k), k, v) for k, v in enumerate(value)]
    if isinstance(value, dict) and value and all(map(is_number_key, value)):
        return [(k.strip(), int(k), v) for k, v in value.items()]
    return [] if value is None else [("0", 0, value)]


def records(value: Any) -> Iterator[dict[str, Any]]:
    """The records in a payload: the outermost objects with a branch in them."""
    todo = [value]
    while todo:
        value = opened(todo.pop())
        if isinstance(value, dict):
            if any(plain_key(k) in BRANCHES for k in value):
                yield value
            else:
                todo += [v for k, v in reversed(value.items()) if plain_key(k) not in OTHER_PARTS]
        elif isinstance(value, list):
            todo += reversed(value)


def truth(value: Any) -> bool | None:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return None if value != value else bool(value)
    word = str(value).strip().lower()
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def is_table(name: str, value: Any) -> bool:
    """Whether a value is rows of its own rather than a value of its object."""
    if isinstance(value, dict) or name == "source":
        return value is not None
    return isinstance(value, list) and any(isinstance(opened(v), dict) for v in value)


def visit(record_no: int, value: Any) -> Iterator[tuple]:
    """Tagged rows of one payload, depth first: (tag, record_no, row_key, parent_key,
    item_no, values by plain key). ``item_no`` is the position in the record's array
    from which the row descends."""
    todo = [("record", f"{record_no}/{n}", None, n, rec) for n, rec in enumerate(records(value))]
    todo.reverse()
    while todo:
        tag, key, parent, item_no, obj = todo.pop()
        vals: dict[str, Any] = {}
        inner = []
        for k, v in obj.items():
            p, v = plain_key(k), opened(v)
            name = SAME_TABLE.get(p, p)
            if not is_table(name, v):
                if vals.get(p) is None and v is not None:
                    vals[p] = truth(v) if p in TRUTHS else json.dumps(v, ensure_ascii=False) if isinstance(v, list) else v
                continue
            own = (name if name != "source" else "record_source") if tag == "record" else f"{tag}_{name}"
            for label, at, item in elements(v):
                item = opened(item)
                if name == "source" and isinstance(item, str) and item.strip():
                    item = {"url": item.strip()}
                if isinstance(item, dict) and item:
                    inner.append((own, f"{key}/{k}/{label}", key, at if tag == "record" else item_no, item))
        yield tag, record_no, key, parent, item_no, vals
        todo += reversed(inner)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for no, text in zip(b.column(0).to_pylist(), b.column(1)):
            if no is None or not text.is_valid:
                continue
            value = opened(text.as_py())
            if isinstance(value, (dict, list)):
                for row in visit(no, value):
                    for c, v in zip(cols, (*row[:5], json.dumps(row[5], ensure_ascii=False))):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["tag", "record_no", "row_key", "parent_key", "item_no", "payload"])


def tagged(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(tag, record_no, row_key, parent_key, item_no, payload) of all parts."""
    return df.select(F.col(key).cast("bigint").alias("_k"), F.col(payload).cast("string").alias("_p")).mapInArrow(_emit, SCHEMA)


_PROXIES = "public_inquiry_held boolean, environmental_authority_opinion string, cndp_referral string, legal_appeals_count string, council_deliberations string"
_SOURCE = "title string, url string, accessed string, archived_url string"
SCHEMAS = {
    "record": "id string, name string, schema_version string",
    "indicator": "id string, status string, value string", "indicator_proxies": _PROXIES, "indicator_source": _SOURCE,
    "fact": "kind string, self_reported string", "fact_proxies": _PROXIES, "fact_source": _SOURCE,
}


def typed(rows: DataFrame, tag: str, schema: str | None = None) -> DataFrame:
    """The flat table of one tag, with its links and its own columns."""
    kinds = [c.split() for c in (schema or SCHEMAS[tag]).split(", ")]
    v = F.from_json("payload", ", ".join(f"{plain_key(c)} {kind}" for c, kind in kinds))
    own = rows.where(F.col("tag") == tag).select("record_no", "row_key", "parent_key", "item_no", v.alias("_v"))
    return own.select("record_no", "row_key", "parent_key", "item_no", *[F.col(f"_v.{plain_key(c)}").alias(c) for c, _ in kinds])


def write_tables(rows: DataFrame, path: str) -> None:
    """All tables in one pass, one folder per tag."""
    rows.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; a filter on ``tag`` opens one folder."""
    return spark.read.schema(SCHEMA).parquet(path)


def leaves(rows: DataFrame, wanted: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(record_no, branch, item_no, leaf, leaf_value) of named leaves of typed tables.

    ``wanted``: tag -> (branch, its leaves); null leaves give no row.
    """
    out = None
    for tag, (branch, names) in wanted.items():
        own = F.explode(F.array(*[F.struct(F.lit(n).alias("leaf"), F.col(n).cast("string").alias("leaf_value")) for n in names]))
        part = typed(rows, tag).select("record_no", F.lit(branch).alias("branch"), "item_no", own.alias("_l")).select("record_no", "branch", "item_no", "_l.leaf", "_l.leaf_value").where("leaf_value is not null")
        out = part if out is None else out.unionByName(part)
    return out
