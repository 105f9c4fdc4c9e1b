"""Readers of the corpus tables and the shared place for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; their Python workers import the helpers of the operators."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="symbolith-code-")) / "symbolith.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, os.path.join(package.name, path.relative_to(package)))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``folder``."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share for cut lineage.

    ``spark.checkpoint.dir`` of the session decides. Only a local master (tests) may do without: a temporary folder is
    made then and remembered in the session. On a cluster it would be another disk for every executor, so that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.symbolith.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="symbolith-")
        spark.conf.set("spark.symbolith.shared.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as a table to the shared folder and read again.

    Cuts the lineage, survives the loss of executors, and gives the planner the true size of the table. The files go
    away with the session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of several rows with equal ``keys`` the one that is last by ``order`` (nulls first); ties fall to the largest row.

    A partial aggregate, so that a hot key is reduced before it is shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if dict(df.dtypes)[c].startswith(("map", "array", "struct")) else F.col(c) for c in rest])
    picked = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], tie.alias("_tie"))).alias("_r")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def current_symbols(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The row of each (repo, id) of ``code_symbols`` that was seen last, with ``columns`` besides the key."""
    need = list(dict.fromkeys(["repo", "id", *columns, "seen_at", "symbol_seq"]))
    return latest(table(spark, folder, "code_symbols").select(*need), ["repo", "id"], ["seen_at", "symbol_seq"]).select(*dict.fromkeys(["repo", "id", *columns]))


def small_enough(df: DataFrame, rows: int = 200_000) -> DataFrame | None:
    """``df`` marked for broadcast if it, a table already written, has at most ``rows`` rows; else None."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None
