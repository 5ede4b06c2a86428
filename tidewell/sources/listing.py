"""Listings of a service, term by term, as a Spark data source, in batch and on a stream.

`register(spark)`, then `spark.read.format("term_listing").schema(...).option("path", folder).load()`. A partition is one
term. A service is a folder of JSON lines for each term (`term=<name>`, as Spark writes them by partition), or what the
option `service` names: `module:function`, which is called with a term and gives the text of a JSON array of records or an
object with `results`. A term that fails is asked for again, `tries` times in all, and then fails its partition's task,
which Spark runs again.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition


class Term(InputPartition):
    def __init__(self, term: str):
        super().__init__(term)
        self.term = term


def _value(value: object, kind: T.DataType) -> object:
    """A JSON value as the type asks for it; null where it doesn't fit."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StructType):
            return tuple(_value(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
        if isinstance(kind, T.ArrayType):
            return [_value(v, kind.elementType) for v in value] if isinstance(value, list) else None
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, T.FractionalType):
            return Decimal(str(value)) if isinstance(kind, T.DecimalType) else float(value)
        if isinstance(kind, T.DateType):
            return date.fromisoformat(value[:10])
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            return datetime.fromisoformat(value)
    except (ValueError, TypeError):
        return None
    return None


class Service:
    """Where listings come from, by the source's options."""

    def __init__(self, options: dict[str, str]):
        self.path, self.named, self.tries = options.get("path"), options.get("service"), int(options.get("tries", "3"))
        self.asked = options.get("terms")
        if not (self.path or self.named):
            raise ValueError("term_listing needs the option path or service")

    def terms(self) -> list[str]:
        """Those of the option `terms` (separated by commas), else those of the folder, in order of name."""
        if self.asked is not None:
            return [t for t in self.asked.split(",") if t]
        files, root = self._files()
        from pyarrow import fs

        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(i.base_name.removeprefix("term=") for i in found if i.type == fs.FileType.Directory and i.base_name.startswith("term="))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def records(self, term: str) -> list[dict]:
        if self.named:
            module, _, name = self.named.partition(":")
            said = json.loads(getattr(importlib.import_module(module), name)(term))
            return said.get("results") or [] if isinstance(said, dict) else said
        from pyarrow import fs

        files, root = self._files()
        out = []
        for info in files.get_file_info(fs.FileSelector(f"{root}/term={term}")):
            if info.base_name[0] not in "._":
                with files.open_input_stream(info.path) as f:
                    out += [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
        return out

    def rows(self, term: str, schema: T.StructType) -> Iterator[tuple]:
        for left in reversed(range(self.tries)):
            try:
                found = self.records(term)
                break
            except Exception:
                if not left:
                    raise
        for record in found:
            yield tuple(term if f.name == "term" and record.get("term") is None else _value(record.get(f.name), f.dataType) for f in schema)


class ListingReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.service, self.only = schema, Service(options), None

    def pushFilters(self, filters: list[Filter]):
        """Filters on the term choose partitions; Spark checks all others."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("term",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            else:
                yield f

    def partitions(self) -> list[Term]:
        return [Term(t) for t in self.service.terms() if self.only is None or t in self.only]

    def read(self, partition: Term) -> Iterator[tuple]:
        return self.service.rows(partition.term, self.schema)


class ListingStream(DataSourceStreamReader):
    """Terms come in the order of their names; an offset is the last term that was read."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.service = schema, Service(options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self.service.terms(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Term]:
        return [Term(t) for t in self.service.terms() if start["after"] < t <= end["after"]]

    def read(self, partition: Term) -> Iterator[tuple]:
        return self.service.rows(partition.term, self.schema)

    def commit(self, end: dict) -> None:
        pass


class TermListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "term_listing"

    def schema(self) -> str:
        return "term string, code string, title string"

    def reader(self, schema: T.StructType) -> ListingReader:
        return ListingReader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> ListingStream:
        return ListingStream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TermListing)
