"""Source trees as a DataFrame: a Python data source that keeps hidden names.

Spark's own file sources hide names that begin with ``_`` or ``.``, so ``__init__.py``, ``.env`` and
``.github/`` would be lost.  The tree is walked once on the driver without opening a file; ignored
folders are pruned before they are entered, files that no analyzer takes are left out, and the
paths are dealt to partitions by size, where executors read them.  The tree must lie in a folder
that all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievelake.functions import scalars as S

#: Bytes of a partition, 4 KB counted for opening each file, until there are so many partitions.
PART_BYTES, MOST_PARTS = 512 << 10, 20_000
SCHEMA = "path string, abs_path string, name string, content string, error string, lang string"


def walk(root: str, ignored: tuple[str, ...] = S.IGNORED) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files below ``root`` or of ``root`` itself, in path order; nothing below an ignored name."""
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if set(os.path.abspath(root).split("/")) & set(ignored):
        return
    if os.path.isfile(root):
        yield root, os.path.getsize(root)
        return
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in ignored)
        for name in sorted(names):
            path = os.path.join(folder, name)
            if name not in ignored and os.path.isfile(path):
                yield path, os.path.getsize(path)


def language_of(name: str) -> str | None:
    """Language of a file name, as ``scalars.language`` has it; None if no analyzer takes it."""
    for part in (name, os.path.splitext(name)[1].lower()):
        for lang, patterns in S.ANALYZERS.items():
            if part in patterns:
                return lang
    return None


class TreePartition(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.ignored = tuple(x for x in options.get("ignored", "").split(",") if x) or S.IGNORED
        self.all = options.get("allfiles", "false").lower() == "true"
        self.bytes = int(options.get("partitionbytes", 0))
        self.lang = options.get("lang")

    def partitions(self) -> list[InputPartition]:
        """Files in path order, dealt by bytes: parsing is slow, so parts are small unless there would be too many."""
        files = [(p, n + 4096) for p, n in walk(self.root, self.ignored) if self._wanted(os.path.basename(p))]
        limit = self.bytes or max(PART_BYTES, sum(n for _, n in files) // MOST_PARTS)
        parts, now, size = [], [], 0
        for path, n in files:
            if now and size + n > limit:
                parts.append(TreePartition(now))
                now, size = [], 0
            now.append(path)
            size += n
        return [*parts, TreePartition(now)] if now or not parts else parts

    def _wanted(self, name: str) -> bool:
        lang = language_of(name)
        return lang == self.lang if self.lang else self.all or lang is not None

    def read(self, partition: TreePartition) -> Iterator[tuple]:
        for path in partition.paths:
            name = os.path.basename(path)
            relative = name if path == self.root else os.path.relpath(path, self.root)
            try:
                with open(path, encoding="utf-8", newline="") as f:
                    yield relative, path, name, f.read().replace("\r\n", "\n").replace("\r", "\n"), None, language_of(name)
            except (OSError, UnicodeDecodeError) as e:
                yield relative, path, name, None, f"{type(e).__name__}: {e}", language_of(name)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``; options ``ignored`` (comma list), ``lang`` (only
    files of this language are opened), ``allFiles``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def classify(files: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Add is_fixture, and lang where it is not there, to (abs_path, name, ...); ignored paths and files without a language go."""
    out = files.where(~S.is_ignored(F.col("abs_path"), ignored))
    out = out if "lang" in files.columns else out.withColumn("lang", S.language(F.col("name")))
    return out.where("lang is not null").withColumn("is_fixture", S.is_fixture(F.col("abs_path")))


def read_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = (), lang: str | None = None) -> DataFrame:
    """The scannable files of a tree (of one language): path, abs_path, name, content, error, lang, is_fixture."""
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree")
    if ignored:
        reader = reader.option("ignored", ",".join(ignored))
    if lang:
        reader = reader.option("lang", lang)
    return classify(reader.load(os.path.abspath(root)), ignored)


def inline_files(spark: SparkSession, files: dict[str, str], root: str = "/project") -> DataFrame:
    """The same columns from texts by relative path."""
    rows = [(p, f"{root}/{p}", p.rsplit("/", 1)[-1], c, None) for p, c in files.items()]
    return classify(spark.createDataFrame(rows, SCHEMA.removesuffix(", lang string")))
