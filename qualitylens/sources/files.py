"""Sources and sinks: source trees, telemetry logs, JSON documents, coverage,
commit logs; append, retention and generation writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def source_tree(spark: SparkSession, root: str, suffix: str = ".py", exclude: tuple[str, ...] = ("site-packages", "node_modules", ".git"), limit: int | None = None) -> DataFrame:
    """path, length, content of the files below ``root`` with the suffix, in
    order of path; the limit comes after the order."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root)
    for name in exclude:
        df = df.where(~F.col("path").contains(f"/{name}/"))
    df = df.select("path", "length", "content").orderBy("path")
    return df.limit(limit) if limit is not None else df


TELEMETRY = "timestamp string, event string, project string, tier string, output_mode string, blocking_count long, duration_ms double"


def telemetry(spark: SparkSession, root: str, since: str | None = None, event: str | None = None, project: str | None = None) -> DataFrame:
    """Daily JSON lines below ``root``/dt=YYYY-MM-DD; days before ``since`` are
    not read, lines that do not parse are dropped, absent tier and mode have
    their defaults."""
    df = spark.read.schema(f"{TELEMETRY}, dt date").option("mode", "DROPMALFORMED").json(root)
    if since:
        df = df.where(F.col("dt") >= F.lit(since).cast("date"))
    if event:
        df = df.where(F.col("event") == event)
    if project:
        df = df.where(F.col("project") == project)
    return df.na.fill({"tier": "unknown", "output_mode": "full"})


def append_telemetry(rows: DataFrame, root: str) -> None:
    """Append rows to their day; the time of writing wins over the caller's."""
    now = F.current_timestamp()
    rows.withColumn("timestamp", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).withColumn("dt", now.cast("date")).write.partitionBy("dt").mode("append").json(root)


def json_documents(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One JSON document per file; files that do not parse are skipped."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").json(root)
    return df.where("_corrupt_record is null").drop("_corrupt_record")


def _coverage(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    parts = ", ".join(f"{s}_lines: array<int>" for s in ("executed", "missing", "excluded"))
    schema = f"files map<string, struct<{parts}, missing_branches: array<array<int>>>>"
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    if not multi_line:
        # measured: with the encoding named, reports of a line take less time to
        # parse (likely since Jackson keeps names, here ever new paths, otherwise)
        reader = reader.option("encoding", "UTF-8")
    return reader.json(path).select(F.explode("files").alias("file", "c"))


def coverage_files(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """file, executed, missing, excluded (arrays of lines), branches (an array of
    from_line, to_line): each file of each coverage report, parsed once; what a
    report lacks is empty. Reports are one a file, or one a line without
    ``multi_line``; those that do not parse are skipped. Branches are those never
    taken, as far as they are pairs; those to a line below 0 are made up by the
    tool and left out."""
    lines = lambda s: F.coalesce(F.col(f"c.{s}_lines"), F.array().cast("array<int>")).alias(s)
    pairs = F.filter("c.missing_branches", lambda b: (F.size(b) == 2) & (F.get(b, 1) >= 0))
    branches = F.transform(F.coalesce(pairs, F.array().cast("array<array<int>>")), lambda b: F.struct(F.get(b, 0).alias("from_line"), F.get(b, 1).alias("to_line")))
    return _coverage(spark, path, multi_line).select("file", *[lines(s) for s in ("executed", "missing", "excluded")], branches.alias("branches"))


def coverage_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """file, line, state (executed, missing, excluded) of coverage reports: one a
    file, or one a line without ``multi_line``; reports that do not parse are skipped."""
    names = ("executed", "missing", "excluded")
    states = F.map_from_arrays(F.array(*[F.lit(s) for s in names]), F.array(*names))
    return coverage_files(spark, path, multi_line).select("file", F.explode(states).alias("state", "lines")).select("file", F.explode("lines").alias("line"), "state")


def coverage_branches(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """file, from_line, to_line: branches never taken, as far as they are pairs;
    those to a line below 0 are made up by the tool and left out."""
    return coverage_files(spark, path, multi_line).select("file", F.explode("branches").alias("b")).select("file", "b.*")


def decode_numbits(bits: Column) -> Column:
    """The numbers of the bits set in a binary, lowest first."""
    hexes = F.hex(bits)
    at = F.sequence(F.lit(0), F.octet_length(bits) * 8 - 1)
    one = lambda n: F.conv(F.substr(hexes, (2 * F.floor(n / 8) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.when(F.octet_length(bits) > 0, F.filter(at, lambda n: F.getbit(one(n), n % 8) == 1)).otherwise(F.array().cast("array<int>"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """commit, files: a log of ``COMMIT <id>`` lines, each with its files below.
    Each record of the file is one commit, so nothing needs a global order."""
    text = spark.read.option("lineSep", "COMMIT ").text(path).where(F.trim("value") != "")
    lines = F.split("value", "\n")
    files = F.array_sort(F.array_distinct(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x) != "")))
    return text.select(F.trim(lines[0]).alias("commit"), files.alias("files"))


def retained(runs: DataFrame, keep: int = 50) -> DataFrame:
    """The newest ``keep`` runs per type."""
    w = W.partitionBy("type").orderBy(F.desc("ts"), F.desc("run_id"))
    return runs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def newest_generation(state: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """The row of the highest generation per key."""
    row = F.struct(*[F.col(f"`{c}`") for c in state.columns])
    return state.groupBy(key).agg(F.max_by(row, generation).alias("row")).select("row.*")
