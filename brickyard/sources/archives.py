"""Members of ZIP archives as rows: exports and registers as their publishers send them.

Archives are rows of ``path`` and ``content``, as Spark's ``binaryFile``
source gives them from any store it can read; each is one task's work, and
its members are read one after another, tables line by line. An archive
inside an archive is opened too. The content of one archive is held in
memory (Spark's limit is 2 GB).
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from io import BytesIO, TextIOWrapper
from zipfile import BadZipFile, ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: How deep archives may lie in each other.
DEPTH = 4
#: Lines of a table that leave a task together.
LINES = 20_000


def archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _opened(content: bytes, path: str, depth: int = 0) -> Iterator[tuple[str, Callable]]:
    """Names and openers of all members, those of inner archives as ``inner.zip/name``; a file that is no archive is its own only member."""
    if content[:2] != b"PK":
        if depth == 0:
            yield path.rsplit("/", 1)[-1], lambda: BytesIO(content)
        return
    try:
        archive = ZipFile(BytesIO(content))
    except BadZipFile as e:
        raise ValueError(f"{path} is no valid archive") from e
    for info in archive.infolist():
        if info.is_dir():
            continue
        if info.filename.lower().endswith(".zip"):
            if depth + 1 >= DEPTH:
                raise ValueError(f"{path}: archives lie more than {DEPTH} deep")
            yield from ((f"{info.filename}/{name}", opener) for name, opener in _opened(archive.read(info), f"{path}/{info.filename}", depth + 1))
        else:
            yield info.filename, lambda info=info: archive.open(info)


def _base(name: str) -> str:
    return name.rsplit("/", 1)[-1].lower()


def only(path: str, members: list[tuple[str, Callable]], name: str) -> tuple[str, Callable]:
    """The one member whose base name is ``name``, upper or lower case; none and several are errors."""
    found = [m for m in members if _base(m[0]) == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{path} has {len(found)} members named {name}")
    return found[0]


def export(path: str, members: list[tuple[str, Callable]], word: str, suffix: str = ".xml") -> tuple[str, Callable]:
    """The member with the suffix that is the export: one whose name has ``word`` before others, then the shortest name, then the first in order; none is an error."""
    found = [m for m in members if m[0].lower().endswith(suffix)]
    if not found:
        raise ValueError(f"{path} has no {suffix} member")
    return min(found, key=lambda m: (word not in m[0].lower(), len(m[0]), m[0]))


def documents(files: DataFrame, word: str = "openimmo") -> DataFrame:
    """path, member and payload (text) of the export in each archive; a file that is no archive is the export itself. A null content gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (raw := content.as_py()) is None:
                    continue
                if raw[:2] == b"PK":
                    name, opener = export(path, list(_opened(raw, path)), word)
                else:
                    name, opener = _base(path), lambda raw=raw: BytesIO(raw)
                with opener() as f:
                    text = f.read().decode("utf-8-sig", errors="replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([text])], names=["path", "member", "payload"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, payload string")


def tables(files: DataFrame, member: str, columns: tuple[str, ...], delimiter: str = ";") -> DataFrame:
    """path and ``columns`` (text) of the one table named ``member`` in each archive, or of a file that is no archive; a missing column is an error."""
    names = ["path", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (raw := content.as_py()) is None:
                    continue
                if raw[:2] == b"PK":
                    _, opener = only(path, list(_opened(raw, path)), member)
                else:
                    opener = lambda raw=raw: BytesIO(raw)
                with opener() as f:
                    lines = csv.DictReader(TextIOWrapper(f, encoding="utf-8-sig", newline=""), delimiter=delimiter)
                    if lost := [c for c in columns if c not in (lines.fieldnames or ())]:
                        raise ValueError(f"{path}: {member} lacks {', '.join(lost)}")
                    rows: list[tuple] = []
                    for line in lines:
                        rows.append((path, *(line[c] for c in columns)))
                        if len(rows) == LINES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"`{c}` string" for c in names))
