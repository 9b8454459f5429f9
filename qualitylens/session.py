"""Session helpers: table loading and a scratch area that survives executor loss."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table through Spark's own reader (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the named tables as temporary views."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is
    absent a local session takes a temporary one; a cluster's executors would
    not see that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="qualitylens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one, deleted when the driver's file system closes."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return root


#: Rows of an Arrow batch. Texts of some 100 kB occur, so batches stay small.
ARROW_ROWS = 1000


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows, and so the memory, of the batches sent to Python. The
    setting is read when a query runs, not when it is made, so it stays in the
    session; a caller's smaller bound is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


class Scratch:
    """Intermediate tables written as Parquet under the shared folder.

    Writing cuts the lineage: a lost executor costs a re-read, not a
    recomputation, and the rows stay columnar and compressed.  Tables are
    registered for deletion when the driver's file system closes, and
    ``drop`` removes one early.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/qualitylens-{uuid.uuid4().hex}"
        self._made: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
        self._count = 0

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(path)

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write ``df`` and return a DataFrame reading it back."""
        self._count += 1
        path = f"{self.root}/{self._count}-{uuid.uuid4().hex[:8]}"
        writer = df.write.mode("overwrite")
        if by:
            writer = writer.partitionBy(by)
        writer.parquet(path)
        at = self._path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._made[out] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by ``save`` that nothing will read again."""
        path = self._made.pop(df, None)
        if path:
            at = self._path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
