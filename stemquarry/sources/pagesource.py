"""A Spark data source for binary papers: pages of text, words, glyphs, answer tables and images.

    register(spark)
    spark.read.format("papers").option("decoder", "package.module:function").option("kind", "words").load(path)

``path`` is a Parquet table with a ``path`` and a ``content`` column (papers collected into a table, as
a crawl stores them) or a folder of files.  The decoder is the caller's (no library for such files is
installed here): a function of a file's bytes that gives the rows of the kind.  Partitions are row
groups of the table, or runs of files of about ``partitionBytes``; a reader holds one file at a time.
Filters on ``path`` are applied before a file is decoded.  A file that the decoder can't read is one
row with its error, unless the option ``errors`` is ``drop``.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Columns of each kind behind the file's path.
KINDS = {
    "pages": "page int, text string",
    "words": "page int, x double, y double, text string",
    "glyphs": "page int, x double, y double, text string, font string, height double",
    "tables": "page int, row int, cells array<string>",
    "images": "page int, width int, height int, data binary",
}


def schema_of(kind: str) -> str:
    """Columns of a kind: the path, the kind's own, and the error of a file that can't be read."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    return f"path string, {KINDS[kind]}, error string"


def function_of(name: str):
    """The function that ``package.module:function`` names."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError("decoder must be package.module:function")
    return getattr(importlib.import_module(module), function)


@dataclass
class Part(InputPartition):
    """A row group of a table, or files of a folder."""

    file: str | None
    group: int
    files: tuple[str, ...] = ()


class PaperSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return schema_of(self.options.get("kind", "pages"))

    def reader(self, schema: StructType) -> PaperReader:
        return PaperReader(schema, {k.lower(): v for k, v in self.options.items()})


def _open(path: str):
    """(file system, path in it) of a path or URL."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path or path
    return fs.FileSystem.from_uri(path)


class PaperReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.options = options
        self.kind = options.get("kind", "pages")
        self.columns = [c.split()[0] for c in schema_of(self.kind).split(", ")]
        self.types = pa_schema(schema)
        self.decoder = options["decoder"]
        function_of(self.decoder)  # a wrong name fails here and not in a task
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with ``path`` is ours; all other filters stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = own if self.paths is None else self.paths & own
            else:
                yield f

    def _found(self) -> tuple[list, list]:
        """(Parquet files, other files) of the path, in order, with their sizes."""
        from pyarrow import fs

        system, path = _open(self.options["path"])
        info = system.get_file_info(path)
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        infos = sorted((i for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        return [i for i in infos if i.extension == "parquet"], [i for i in infos if i.extension != "parquet"]

    def partitions(self) -> Sequence[Part]:
        import pyarrow.parquet as pq

        system, _ = _open(self.options["path"])
        tables, files = self._found()
        out = []
        for t in tables:
            with system.open_input_file(t.path) as f:
                out += [Part(t.path, g) for g in range(pq.ParquetFile(f).num_row_groups)]
        held, total, most = [], 0, int(self.options.get("partitionbytes", 64 << 20))
        for i in files:
            if self.paths is None or i.path in self.paths:
                held.append(i.path)
                total += i.size
                if total >= most:
                    out.append(Part(None, 0, tuple(held)))
                    held, total = [], 0
        return [*out, Part(None, 0, tuple(held))] if held or not out else out

    def _papers(self, part: Part) -> Iterator[tuple[str, bytes]]:
        import pyarrow.parquet as pq

        system, _ = _open(self.options["path"])
        for path in part.files:
            with system.open_input_stream(path) as f:
                yield path, f.read()
        if part.file is not None:
            key, content = self.options.get("pathcolumn", "path"), self.options.get("contentcolumn", "content")
            with system.open_input_file(part.file) as f:
                for batch in pq.ParquetFile(f).iter_batches(64, row_groups=[part.group], columns=[key, content]):
                    for k, c in zip(batch.column(key).to_pylist(), batch.column(content).to_pylist(), strict=True):
                        yield str(k), c.encode() if isinstance(c, str) else c or b""

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        decode, keep = function_of(self.decoder), self.options.get("errors", "keep") == "keep"
        n = len(self.columns) - 2
        for path, content in self._papers(part):
            if self.paths is not None and path not in self.paths:
                continue
            try:
                rows = [(path, *r, None) for r in decode(content)]
            except Exception as e:  # noqa: BLE001  any decoder error marks the file
                rows = [(path, *[None] * n, f"{type(e).__name__}: {e}")] if keep else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.types, strict=True)], names=self.columns)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which must let Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PaperSource)


def pa_schema(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]
