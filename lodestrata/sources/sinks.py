"""Writers: canonical JSON for small artifacts, partitioned files for the rest."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import html_escape


def canonical(value: object) -> str:
    """JSON with two blanks of indent, letters as they are and a final line end."""
    return json.dumps(value, ensure_ascii=False, indent=2) + "\n"


def write_artifact(df: DataFrame, path: str, key: str | None = None, most: int = 100_000) -> None:
    """A small result as one canonical JSON file, by key or as a list; more rows than
    ``most`` are an error: such results belong in ``write_partitioned``."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    out = {str(r.pop(key)): r for r in sorted(rows, key=lambda r: str(r[key]))} if key else rows
    Path(path).write_text(canonical(out), encoding="utf-8")


def features_json(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """One GeoJSON point feature per row, as text; rows without a place give none."""
    props = [c for c in df.columns if c not in (lon, lat)]
    geo = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.to_json(F.struct(F.lit("Feature").alias("type"), geo.alias("geometry"), F.struct(*props).alias("properties"))).alias("feature"))


def write_partitioned(df: DataFrame, path: str, by: list[str], form: str = "parquet") -> None:
    """Replaces only the partitions that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(form).save(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def coverage_report(matrix: DataFrame, label: str, columns: list[str], most: int = 1000) -> str:
    """A small matrix as a Markdown table, in order of its labels; more rows than
    ``most`` are an error: such a matrix belongs in a table."""
    rows = matrix.select(label, *columns).orderBy(label).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join([label, *columns]) + " |", "|" + "---|" * (len(columns) + 1)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def write_with_provenance(df: DataFrame, path: str, by: list[str], provenance: dict[str, object]) -> None:
    """Partitions that the rows belong to, replaced, and beside each a sidecar that says
    where they come from; writing the same rows again changes nothing."""
    write_partitioned(df, f"{path}/drafts", by, "json")
    said = F.struct(*[F.lit(v).alias(k) for k, v in sorted(provenance.items())])
    rows = df.groupBy(*by).agg(F.count("*").alias("n_rows")).withColumn("provenance", said)
    write_partitioned(rows, f"{path}/provenance", by, "json")


def review_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of an HTML table, with every value escaped."""
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def review_sheet(df: DataFrame, columns: list[str], title: str, most: int = 5000) -> str:
    """A page to look rows over by hand; more rows than ``most`` are an error."""
    rows = review_rows(df, columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{head}</tr>{''.join(r['line'] for r in rows)}</table>\n"
