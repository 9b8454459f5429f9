"""A table kept in generations: written aside, then made current by a commit
that only one writer can win. Readers never see half of a generation."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Lost(RuntimeError):
    """Another writer has committed the generation first."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _commits(spark: SparkSession, root: str) -> list[dict]:
    """All commits, the newest first; one that is being written does not count."""
    fs, at = _fs(spark, f"{root}/_commits")
    if not fs.exists(at):
        return []
    names = sorted((f.getPath().getName() for f in fs.listStatus(at)), reverse=True)
    out = []
    for name in names:
        if name.isdigit():
            stream = fs.open(_fs(spark, f"{root}/_commits/{name}")[1])
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            out.append(json.loads(text) | {"generation": int(name)})
    return out


def current(spark: SparkSession, root: str) -> int:
    """The newest generation; 0 if there is none."""
    return next((c["generation"] for c in _commits(spark, root)), 0)


def read(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame:
    """The rows of the newest generation, or of an earlier one."""
    for c in _commits(spark, root):
        if generation in (None, c["generation"]):
            return spark.read.parquet(f"{root}/{c['data']}")
    raise FileNotFoundError(f"no generation {generation or ''} in {root}")


def commit(df: DataFrame, root: str, after: int, batch: str | None = None) -> int:
    """Write ``df`` as the generation that follows ``after`` and return its number.

    Rows go to a folder of their own. The commit is a small file written aside
    and renamed to its generation's name, which fails where the name exists: of
    two writers that start from one generation the second gets ``Lost`` and its
    rows are deleted. A ``batch`` that has been committed is not written again;
    its number is returned, so a repeated micro-batch changes nothing."""
    spark = df.sparkSession
    done = _commits(spark, root)
    for c in done:
        if batch is not None and c["batch"] == batch:
            return c["generation"]
    data, number = f"data-{after + 1:012}-{uuid.uuid4().hex}", after + 1
    if done and done[0]["generation"] != after:
        raise Lost(f"generation {done[0]['generation']} is current, not {after}")
    df.write.parquet(f"{root}/{data}")
    fs, aside = _fs(spark, f"{root}/_commits/.{uuid.uuid4().hex}")
    fs.mkdirs(aside.getParent())
    out = fs.create(aside, False)
    out.write(json.dumps({"data": data, "batch": batch}).encode())
    out.close()
    name = _fs(spark, f"{root}/_commits/{number:012}")[1]
    if fs.exists(name) or not fs.rename(aside, name):
        fs.delete(aside, False)
        fs.delete(_fs(spark, f"{root}/{data}")[1], True)
        raise Lost(f"generation {number} is another writer's")
    return number


def batches_into(root: str):
    """A function for ``foreachBatch``: each micro-batch is a generation, once."""

    def put(df: DataFrame, batch_id: int) -> None:
        commit(df, root, current(df.sparkSession, root), f"batch-{batch_id}")

    return put
