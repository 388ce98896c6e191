"""Files as Spark data sources: observation feeds (JSON lines, JSON, TOML), Markdown pipe tables, manifests of documents.

``register(spark)`` makes the formats ``observations``, ``pipe_tables`` and ``source_documents`` known. Each file is a
partition, read on an executor in a stream of rows; equality filters on columns are applied while reading, and those on
``source_file`` leave whole files out.
"""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from afterbell.sources.documents import SCHEMA as DOCUMENT
from afterbell.sources.registries import OBSERVATION

FILE = "source_file"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri) else "file://" + quote(uri))


@dataclass
class File(InputPartition):
    """One file of a source."""

    system_uri: str
    path: str


class FileReader(DataSourceReader):
    """Reads files below a path with one of some endings; kinds of files say how their rows are made (:meth:`rows`)."""

    endings: tuple[str, ...] = ()

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.wanted: dict[str, set] = {}
        self.known: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column in self.schema.names and isinstance(f, IsNotNull):
                self.known.add(column)
            elif column in self.schema.names and values is not None:
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[File]:
        base = self.options["path"]
        system, path = _opened(base)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted(f.path for f in found if f.is_file and f.path.lower().endswith(self.endings))
        return [File(base, p) for p in files if FILE not in self.wanted or p in self.wanted[FILE]]

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = _opened(partition.system_uri)
        names = self.schema.names
        with system.open_input_stream(partition.path) as stream:
            for row in self.rows(stream, partition.path, system):
                row[FILE] = partition.path
                if all(row.get(c) in v for c, v in self.wanted.items()) and all(row.get(c) is not None for c in self.known):
                    yield tuple(row.get(n) for n in names)

    def rows(self, stream, path: str, system: fs.FileSystem) -> Iterator[dict]:
        raise NotImplementedError


def _typed(value: object, kind: str) -> object:
    """A value of a feed as the column's type; what doesn't fit is missing."""
    if value is None:
        return None
    if kind == "array<string>":
        return [v if isinstance(v, str) else json.dumps(v) for v in value] if isinstance(value, list) else [str(value)]
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    if kind == "int":
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    return value if isinstance(value, str) else json.dumps(value, default=str)


class ObservationReader(FileReader):
    """JSON lines are streamed (in files named .json they are read whole); a JSON or TOML file is one record, a list of them, or an object that holds such lists."""

    endings = (".jsonl", ".ndjson", ".json", ".toml")

    def rows(self, stream, path: str, system: fs.FileSystem) -> Iterator[dict]:
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields}

        def typed(record: object, text: str) -> dict:
            if not isinstance(record, dict):
                return {"_corrupt_record": text}
            return {n: _typed(record.get(n), k) for n, k in kinds.items() if n not in ("_corrupt_record", FILE)}

        def lines(of) -> Iterator[dict]:
            for line in of:
                if line.strip():
                    try:
                        yield typed(json.loads(line), line.rstrip("\n"))
                    except ValueError:
                        yield {"_corrupt_record": line.rstrip("\n")}

        if path.lower().endswith((".jsonl", ".ndjson")):
            yield from lines(io.TextIOWrapper(stream, "utf-8", "replace"))
            return
        text = stream.read().decode("utf-8", "replace")
        try:
            data = tomllib.loads(text) if path.lower().endswith(".toml") else json.loads(text)
        except ValueError:
            if path.lower().endswith(".json") and "\n" in text.strip():  # lines after all
                yield from lines(text.split("\n"))
            else:
                yield {"_corrupt_record": text}
            return
        held = data
        if isinstance(data, dict) and "slug" not in data:
            held = [r for v in data.values() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v) for r in v] or [data]
        for record in held if isinstance(held, list) else [held]:
            yield typed(record, json.dumps(record, default=str))


class PipeTableReader(FileReader):
    """Rows of Markdown pipe tables below a heading row; columns are found by their heading's name, others by place."""

    endings = (".md", ".markdown")

    def rows(self, stream, path: str, system: fs.FileSystem) -> Iterator[dict]:
        slug = lambda s: re.sub(r"[^a-z0-9]+", "_", s.lower()).strip("_")
        columns = [n for n in self.schema.names if n != FILE]
        places: list[str | None] | None = None
        before: list[str] | None = None
        for line in io.TextIOWrapper(stream, "utf-8", "replace"):
            line = line.strip()
            if not line.startswith("|"):
                places = before = None
                continue
            cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip("|"))]
            if all(re.fullmatch(r":?-+:?", c) for c in cells):
                heading = [slug(c) for c in before or []]
                places = [h if h in columns else None for h in heading] if any(h in columns for h in heading) else list(columns)
            elif places is not None:
                yield {n: "" for n in columns} | {p: c for p, c in zip(places, cells, strict=False) if p}
            before = cells


class DocumentReader(FileReader):
    """CSV manifests; a row without text takes the file at its path, relative to the manifest."""

    endings = (".csv",)

    def rows(self, stream, path: str, system: fs.FileSystem) -> Iterator[dict]:
        folder = path.rpartition("/")[0]
        for row in csv.DictReader(io.TextIOWrapper(stream, "utf-8-sig", "replace", newline="")):
            own = {k: v for k, v in row.items() if k in self.schema.names}
            place = (own.get("path") or "").strip()
            if not (own.get("text") or "").strip() and place and not any(own.get(c) not in v for c, v in self.wanted.items() if c not in ("text", FILE)):
                try:
                    with system.open_input_stream(place if place.startswith("/") else f"{folder}/{place}") as held:
                        own["text"] = held.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    own["text"] = None
            yield own


class _Source(DataSource):
    kind: type[FileReader]
    columns = ""

    def schema(self) -> str:
        return f"{self.columns}, {FILE} string"

    def reader(self, schema: StructType) -> FileReader:
        return self.kind(schema, {k.lower(): v for k, v in self.options.items()})


class ObservationSource(_Source):
    kind, columns = ObservationReader, OBSERVATION

    @classmethod
    def name(cls) -> str:
        return "observations"


class PipeTableSource(_Source):
    """Option ``columns``: names, comma-separated."""

    kind = PipeTableReader

    @classmethod
    def name(cls) -> str:
        return "pipe_tables"

    def schema(self) -> str:
        names = [c.strip() for c in {k.lower(): v for k, v in self.options.items()}["columns"].split(",")]
        return ", ".join(f"`{c}` string" for c in names) + f", {FILE} string"


class DocumentSource(_Source):
    kind, columns = DocumentReader, DOCUMENT

    @classmethod
    def name(cls) -> str:
        return "source_documents"


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, and let it push filters into Python sources, which they ask for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ObservationSource, PipeTableSource, DocumentSource):
        spark.dataSource.register(source)
