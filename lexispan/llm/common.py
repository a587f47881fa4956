"""What the operators of this subpackage share: scratch tables, shipped code and the definition of a word."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Ships this package to the Python workers, once for each application; plans made afterwards find it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="shipped-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, with workers that can import this package."""
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; in local mode a fresh temporary one where none is named (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexispan-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, kind: str) -> str:
    return f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by written() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a key from which on it is a hot one, unless they are many; so many hot keys there are at most.
HOT_ROWS, HOT_KEYS = 2_000, 100_000


def joined_by_count(left: DataFrame, counted: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """left joined with counted, a table of unique keys that tells in n how many rows of left each of them has.

    Keys of very many rows are broadcast, so that their rows stay where they are; by the bound there can only be some."""
    total, most = counted.agg(F.sum(n), F.max(n)).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= bound:
        return left.join(counted, on)
    hot = F.col(n) > bound
    return left.join(F.broadcast(counted.filter(hot)), on).unionByName(left.join(counted.filter(~hot), on))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
