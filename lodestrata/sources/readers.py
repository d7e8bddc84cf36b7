"""Readers: every one takes an explicit schema or reads all as text.

Rows that can't be read are dropped or returned apart, never guessed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A source citation and a bilingual text.
SOURCE = "struct<title:string,url:string,accessed:string,archived_url:string>"
LABEL = "struct<fr:string,en:string>"
PLACE = "struct<lat:double,lon:double>"
SITE = (
    f"schema_version string, id string, identity struct<name:string,operator:string,municipality:string,admin_area:string,country:string,coordinates:{PLACE},project_status:string,"
    f"vintage:struct<announced_year:int,expected_commissioning:int>,power_mw:double,power_mw_status:string,summary:{LABEL}>, "
    f"indicators array<struct<id:string,status:string,value:string,proxies:struct<public_inquiry_held:boolean,environmental_authority_opinion:string,cndp_referral:boolean,legal_appeals_count:int,council_deliberations:string>,"
    f"source:{SOURCE},verification_source:{SOURCE}>>, publication struct<status:string>, "
    f"score_history array<struct<date:string,methodology_version:string,grades:struct<site:string,project_process:string>,confidence:string,event:string,rationale:string>>, "
    f"contestation array<struct<kind:string,label:{LABEL},source:{SOURCE},self_reported:boolean>>"
)
ENTRY = f"id string, name string, operator string, municipality string, country string, project_status string, coordinates {PLACE}, summary {LABEL}, source {SOURCE}, facts array<struct<kind:string,label:{LABEL},source:{SOURCE},self_reported:boolean>>"
SIDECARS = ("provenance", "draft", "governance")


def with_stem(df: DataFrame) -> DataFrame:
    return df.withColumn("stem", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", ""))


def site_records(spark: SparkSession, path: str) -> DataFrame:
    """Site records, one JSON document per file, with ``stem``; files with a sidecar
    ending are left out."""
    df = with_stem(spark.read.schema(SITE).option("multiLine", True).json(path))
    return df.where(~F.col("stem").rlike(rf"\.({'|'.join(SIDECARS)})$"))


def latest_panel(df: DataFrame, order: str) -> DataFrame:
    """One record per stem, that of the last panel by ``order``."""
    names = [c for c in df.columns if c not in ("stem", order)]
    last = df.groupBy("stem").agg(F.max_by(F.struct(*names), order).alias("_r"))
    return last.select("stem", "_r.*")


def watch_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of files that hold a JSON array each."""
    return spark.read.schema(ENTRY).option("multiLine", True).json(path)


def active_version(spark: SparkSession, folder: str) -> DataFrame:
    """The one versioned document of a folder; none or several are an error."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", "v*.json").text(folder).select(F.col("value").alias("document"), F.col("_metadata.file_name").alias("file_name"))
    names = sorted(r["file_name"] for r in df.select("file_name").take(2))
    if len(names) != 1:
        raise ValueError(f"expected exactly one active version in {folder}, found {names or 'none'}")
    return df


def long_indicators(sites: DataFrame) -> DataFrame:
    """The long fact table, with a value that may be number, text or truth split
    into three typed columns."""
    i = sites.select("id", F.explode("indicators").alias("i"))
    v = F.col("i.value")
    return i.select(
        F.col("id").alias("site_id"), F.col("i.id").alias("indicator_id"), F.col("i.status").alias("status"), v.try_cast("double").alias("value_num"),
        F.when(v.isin("true", "false"), v.cast("string") == "true").alias("value_bool"), F.when(v.try_cast("double").isNull() & ~v.isin("true", "false"), v).alias("value_str"), F.col("i.proxies").alias("proxies"), F.col("i.source").alias("source"), F.col("i.verification_source").alias("verification_source"),
    )


def sites_table(spark: SparkSession, path: str, json: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sites, rejects) of a CSV with header or a JSON array: rows whose place can't
    be read are rejected; missing power is null, missing status is announced."""
    cols = ["name", "operator", "lat", "lon", "power_mw", "project_status"]
    raw = spark.read.schema(", ".join(f"{c} string" for c in cols)).option("multiLine", True).json(path) if json else spark.read.option("header", True).csv(path)
    for c in cols:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    ok = lat.isNotNull() & lon.isNotNull()
    good = raw.where(ok).select("name", "operator", lat.alias("lat"), lon.alias("lon"), F.col("power_mw").try_cast("double").alias("power_mw"), F.coalesce(F.nullif(F.trim("project_status"), F.lit("")), F.lit("announced")).alias("project_status"))
    return good, raw.where(~ok)


def delimited(spark: SparkSession, path: str, sep: str, charset: str = "utf-8") -> DataFrame:
    """A delimited file as text columns; byte order marks don't matter. Charsets that
    the engine doesn't read natively are decoded file by file."""
    if charset.lower().replace("-", "") in ("utf8", "utf8sig"):
        df = spark.read.option("header", True).option("sep", sep).csv(path)
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    files = spark.read.format("binaryFile").load(path)
    head = files.select("content").first()[0].decode(charset).splitlines()[0]
    names = [n.strip().strip('"').lstrip("﻿") for n in head.split(sep)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                got = pd.read_csv(io.StringIO(raw.decode(charset)), sep=sep, dtype=str, keep_default_na=False)
                got.columns = names
                yield got.where(got != "", None)

    return files.select("content").mapInPandas(decode, schema)


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines without malformed ones, the first row of each key by file order."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_n"))
    rows = raw.select("_f", "_n", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("_v")).select("_f", "_n", "_v.*").where(F.col(key).isNotNull())
    names = [c for c in rows.columns if c not in ("_f", "_n", key)]
    return rows.groupBy(key).agg(F.min(F.struct("_f", "_n", *names)).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in names])


def features(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, properties) of the point features of a collection."""
    schema = "type string, features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    at = F.col("f.geometry.coordinates")
    return f.select(F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"), F.col("f.properties").alias("properties"))


def layers(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """(shape, lon, lat, ring, kind, properties) of all features of collections: points
    with their place, polygons with their outer ring and lines with their corners.
    ``kinds`` gives classes to features by patterns on all their texts, the first that
    fits; features without a shape are kept with nulls."""
    schema = "type string, features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select(F.col("f.geometry.type").alias("shape"), F.col("f.geometry.coordinates").alias("_c"), F.col("f.properties").alias("properties"))
    line = lambda depth: F.from_json("_c", "array<" * depth + "double" + ">" * depth)
    corners = F.when(F.col("shape") == "Polygon", F.get(line(3), F.lit(0))).when(F.col("shape") == "MultiPolygon", F.get(F.get(line(4), F.lit(0)), F.lit(0))).when(F.col("shape").isin("LineString", "MultiPoint"), line(2)).when(F.col("shape") == "MultiLineString", F.get(line(3), F.lit(0)))
    ring = F.transform(corners, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    at = F.when(F.col("shape") == "Point", line(1))
    said = F.array_join(F.map_values("properties"), " ")
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list((kinds or {}).items())):
        kind = F.when(said.rlike(pattern), name).otherwise(kind)
    return f.select("shape", F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"), ring.alias("ring"), kind.alias("kind"), "properties")


def named_codes(spark: SparkSession, path: str, sep: str, code: int, names: list[int], keep: str) -> DataFrame:
    """(code, name) of a delimited text: the lines whose code matches a pattern, once for
    each of several name columns that isn't empty."""
    parts = F.split("value", f"\\Q{sep}\\E", -1)
    cols = F.array(*[F.trim(F.get(parts, F.lit(k))) for k in names])
    rows = spark.read.text(path).select(F.trim(F.get(parts, F.lit(code))).alias("code"), cols.alias("_n")).where(F.col("code").rlike(keep))
    return rows.select("code", F.explode(F.array_distinct(F.filter("_n", lambda x: F.length(x) > 0))).alias("name"))


def latest(rows: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """(key, period, value) of long rows: of each key the last period that has a value."""
    n = rows.select(key, F.col(period).try_cast("int").alias(period), F.col(value).try_cast("double").alias(value)).where(F.col(period).isNotNull() & F.col(value).isNotNull())
    return n.groupBy(key).agg(F.max(F.struct(period, value)).alias("_m")).select(key, "_m.*")


def tables_of(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a dump of CSV files, by name; one that is missing is an error when read."""
    return {n: spark.read.option("header", True).csv(f"{folder}/{n}.csv") for n in names}


def gml_values(df: DataFrame, text: str, elements: list[str]) -> DataFrame:
    """The first value of each named element of a GML or XML text, whatever its prefix;
    entities are resolved."""
    def value(e: str):
        v = F.regexp_extract(text, rf"<(?:[\w-]+:)?{e}(?:\s[^>]*)?>\s*([^<]*?)\s*</", 1)
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
            v = F.replace(v, F.lit(a), F.lit(b))
        return F.nullif(v, F.lit(""))

    return df.withColumns({e: value(e) for e in elements})


# Spreadsheets

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def column_index(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_file(z: zipfile.ZipFile, sheet: int | str) -> str:
    """Where a sheet lies, by number from 1 or by name."""
    if isinstance(sheet, int):
        return f"xl/worksheets/sheet{sheet}.xml"
    ids = {s.get("name"): s.get(_REL) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")}
    if sheet not in ids:
        raise ValueError(f"no sheet {sheet!r}, only {sorted(ids)}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return "xl/" + targets[ids[sheet]].removeprefix("/xl/")


def sheet_rows(raw: bytes, sheet: int | str = 1) -> list[list[str | None]]:
    """Rows of a sheet of a workbook, with shared and inline texts."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        out = []
        for row in ElementTree.fromstring(z.read(sheet_file(z, sheet))).iter(f"{{{_NS['m']}}}row"):
            cells: list[str | None] = []
            for c in row.findall("m:c", _NS):
                k = column_index(c.get("r"))
                cells += [None] * (k + 1 - len(cells))
                v = c.find("m:v", _NS)
                if c.get("t") == "s" and v is not None:
                    cells[k] = shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    cells[k] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is not None:
                    cells[k] = v.text
            out.append(cells)
    return out


def workbook(spark: SparkSession, path: str, columns: list[str], sheet: int | str = 1) -> DataFrame:
    """Named columns of workbooks, matched on the header row; all as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                rows = sheet_rows(bytes(raw), sheet)
                head = {h: k for k, h in enumerate(rows[0]) if h} if rows else {}
                yield pd.DataFrame([[r[head[c]] if c in head and head[c] < len(r) else None for c in columns] for r in rows[1:]], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)
