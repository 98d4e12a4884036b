"""Session helpers: table loading, lineage cuts in the shared folder, partition sizing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that setting is absent and all runs in one
    process (local tests) is a local folder made, set, and removed in the end.  A cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagelathe-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so later jobs survive a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, bytes_a_task: int = 4 << 20) -> DataFrame:
    """``df`` in enough partitions that Python-heavy work uses every core.

    A scan that is split finely enough already stays as it is, without a shuffle.  The number otherwise
    comes from the optimizer's size of the scan; nothing is read for it.
    """
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if plan.toRdd().getNumPartitions() >= cores:
        return df
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    return df.repartition(int(max(cores * 2, min(200_000, size // bytes_a_task))))


def public_path(name: str) -> str:
    """A file of the installed public tokenizer vocabularies; ``PAGELATHE_TOKENIZERS`` names another folder."""
    return os.path.join(os.environ.get("PAGELATHE_TOKENIZERS", "/opt/tokenizers"), name)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage is cut, columns stay prunable.

    The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, key: str, bound: int, total: int) -> DataFrame:
    """At most ``bound`` rows of ``df``, those with the lowest hash of ``key``; ``total`` is how many rows there are about.

    Rows far above the hash that ``bound`` rows lie below are filtered where they are read, so that what
    partitions send does not grow with their number.
    """
    share = min(1.0, 1.6 * bound / max(1, total) + 20 / max(1, total))
    rank = F.xxhash64(key)
    kept = df if share >= 1.0 else df.where(rank <= int(-(2**63) + share * (2**64 - 1)))
    return kept.orderBy(rank, key).limit(bound)


def slices(batch: pa.RecordBatch, most_rows: int = 500, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most ``most_rows`` rows and about ``most_bytes`` bytes of text, a single longer row apart."""
    sizes = np.zeros(batch.num_rows)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0.0
        end = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
        yield batch.slice(at, end - at)
        at = end
