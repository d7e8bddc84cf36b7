"""A Python data source for point layers behind an address, with pushed filters.

``spark.read.format("point_layer")`` with the options ``fetch`` (module:function)
and ``where``. The function gets the text of the filter and yields rows; it is
what talks to a service, so tests and offline use give it a stub.
"""

from __future__ import annotations

import datetime
import importlib
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "id bigint, lat double, lon double, label string"


def literal(value: object) -> str | None:
    """A value as a service's filter has it, or None if it can't be written safely."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int) or isinstance(value, float) and value == value and abs(value) != float("inf"):
        return repr(value)
    if isinstance(value, str) and value.isprintable():
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    return None


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def clause(f: Filter) -> str | None:
    """A filter on one plain column as text, or None where Spark has to apply it."""
    sign, column = _SIGNS.get(type(f)), getattr(f, "attribute", ())
    if len(column) != 1 or not re.fullmatch(r"[A-Za-z_]\w*", column[0]):
        return None
    if isinstance(f, In):
        values = [literal(v) for v in f.value]
        return f"{column[0]} IN ({', '.join(values)})" if values and None not in values else None
    value = literal(f.value) if sign else None
    return f"{column[0]} {sign} {value}" if value is not None else None


class PointLayer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "point_layer"

    def schema(self) -> str:
        return self.options.get("schema", SCHEMA)

    def reader(self, schema) -> DataSourceReader:
        return PointLayerReader(dict(self.options))


class PointLayerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.clauses = [options["where"]] if options.get("where") else []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons and lists of values go to the service; the rest stays with Spark."""
        for f in filters:
            text = clause(f)
            if text is None:
                yield f
            else:
                self.clauses.append(text)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(int(self.options.get("pages", "1")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, function = self.options["fetch"].partition(":")
        yield from getattr(importlib.import_module(module), function)(" AND ".join(self.clauses), partition.value)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointLayer)
