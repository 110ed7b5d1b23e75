"""Stage tables: results that must not be computed twice, kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """Shared folder of the session (``spark.checkpoint.dir``); a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tagloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders made in the scopes that are open, the innermost last
_SCOPES: list[list[str]] = []


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Stage tables made inside are removed at its end, also after a failure: write out what is to stay before.

    ``with stage_scope(spark): labeling.export(labeling.label_images(...), folder)``
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in made:
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet stage table and read it back with its lineage cut.

    With ``path`` the table stays where the caller wants it (a resumable run);
    otherwise it gets a fresh folder below the stage root.
    """
    spark = df.sparkSession
    target = path or f"{stage_root(spark)}/tagloom/{name}-{uuid.uuid4().hex}"
    if path is None:
        for made in _SCOPES[-1:]:
            made.append(target)
    df.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
