"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sievelake-")
        atexit.register(shutil.rmtree, root[len("file://"):], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sievelake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def held(spark: SparkSession, key: str, value) -> Iterator[None]:
    """A setting of the session for what runs meanwhile."""
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, str(value))
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut there, so a lost executor
    costs no earlier step, and the files give joins their true size.  The shuffle files that
    led to it are removed with the write, which is over.  ``options`` are the writer's."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with held(spark, _CLEANUP, "true"):
        df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing still to be computed reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, which the optimizer does not look through: an
    expression used inside a lambda is thereby computed once a row, not once an element."""
    for name, expr in columns.items():
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(expr)).alias(name))
    return df


def bundle(df: DataFrame, keep: tuple[str, ...], new: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, and all others but ``new`` in one struct ``_rest``, where no name can clash with ours."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (*keep, *new)]
    return df.select(*keep, F.struct(F.lit(True).alias("_"), *rest).alias("_rest"))


def unbundle(df: DataFrame, keep: tuple[str, ...], new: tuple[str, ...]) -> list[Column]:
    """The columns of ``df`` but ``new``, in its order, from what ``bundle`` made of it."""
    return [F.col(c) if c in keep else F.col("_rest").getField(c).alias(c) for c in df.columns if c not in new]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
