"""Cohorts on disk: pairs of files per network or partitioned tables; compute if absent."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.model import KEYS

FORMATS = ("parquet", "csv")


def _format(extension: str) -> str:
    if extension not in FORMATS:
        raise ValueError(f"an extension is one of {FORMATS}")
    return extension


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _escaped(path: str) -> str:
    """A path that a reader doesn't take for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_files(spark: SparkSession, folder: str, kind: str, levels: Sequence[str] = KEYS, extension: str = "parquet", index: Sequence[tuple] | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """All files ``{kind}_{level}-{id}[_{level}-{id}].{extension}`` of a folder as one table with the
    ids as string columns.  Ids may hold ``_``; one level will do; ``index`` chooses networks, and
    only their files are opened.
    Columns a file lacks are null; ``extra`` adds columns of the scan's metadata."""
    reader = spark.read.option("mergeSchema", "true") if _format(extension) == "parquet" else spark.read.option("header", "true").option("inferSchema", "true")
    reader = reader.format(extension).option("pathGlobFilter", f"{kind}_*.{extension}")
    files = [f"{folder.rstrip('/')}/{kind}_" + "_".join(f"{level}-{i}" for level, i in zip(levels, own, strict=True)) + f".{extension}" for own in index or ()]
    files = [f for f in files if exists(spark, f)]
    # Where none of the networks asked for is there, the folder tells the columns of no rows.
    table = reader.load([_escaped(f) for f in files] if files else folder)
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    pattern = f"^{kind}_" + "_".join(rf"{level}-(.+{'?' if i + 1 < len(levels) else ''})" for i, level in enumerate(levels)) + rf"\.{extension}$"
    out = table.withColumns({level: F.regexp_extract(name, pattern, i + 1) for i, level in enumerate(levels)} | dict(extra or {}))
    if index is not None:
        chosen = spark.createDataFrame([tuple(map(str, i)) for i in index], ", ".join(f"{level} string" for level in levels))
        out = out.join(chosen, [*levels], "left_semi")
    return out


def networks(table: DataFrame, levels: Sequence[str] = KEYS) -> DataFrame:
    """The ids of a cohort's networks."""
    return table.select(*levels).distinct()


def write_cohort(df: DataFrame, path: str, levels: Sequence[str] = KEYS, extension: str = "parquet", mode: str = "error") -> None:
    """One table for the whole cohort, in ranges of the ids: the number of files follows the size, not the
    number of networks, and a large network has several."""
    place = next(n for n in ("_" * i + "place" for i in range(1, len(df.columns) + 2)) if n not in df.columns)
    order = [*levels, place]
    rows = df.withColumns({level: F.col(level).cast("string") for level in levels}).withColumn(place, F.monotonically_increasing_id())
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(place).write.mode(mode)
    (writer.option("header", "true") if _format(extension) == "csv" else writer).format(extension).save(path)


def read_cohort(spark: SparkSession, path: str, levels: Sequence[str] = KEYS, extension: str = "parquet") -> DataFrame:
    """A cohort written as one table, or in a folder for each id; filters on the ids skip row groups of
    Parquet files, or folders.  Ids are strings."""
    reader = spark.read.option("header", "true").option("inferSchema", "true") if _format(extension) == "csv" else spark.read
    table = reader.format(extension).load(path)
    return table.withColumns({level: F.col(level).cast("string") for level in levels})


def read_matrix(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A text matrix without a header as double columns."""
    return spark.read.csv(path, schema=", ".join(f"`{c}` double" for c in columns))


def write_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Embeddings, labels and the like, as Parquet."""
    df.write.mode(mode).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keyed(folder: str, name: str, params: Mapping) -> str:
    """A path that tells parameter sets apart."""
    digest = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{folder.rstrip('/')}/{name}-{digest}"


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], recompute: bool = False) -> DataFrame:
    """Read a table if a finished one is there, else compute, write and read it."""
    if recompute or not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
