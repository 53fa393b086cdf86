"""Table, page and JSON-lines sources and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A parquet table of the data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


FEW_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over the cores when the input has a handful of splits.

    One small file with a single row group is one task however many cores
    there are.  An input of ``FEW_SPLITS`` or more is left alone on any
    cluster: its splits follow ``spark.sql.files.maxPartitionBytes``.  Meant
    for plain scans, whose split count is known without running a job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


GOLDEN_SCHEMA = T.StructType(
    [
        T.StructField("query", T.StringType(), False),
        T.StructField("context", T.StringType(), False),
        T.StructField("ground_truth", T.StringType(), False),
        T.StructField("doc_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("section", T.StringType()),
    ]
)
RAW_LOG_SCHEMA = (
    "log string, ticket struct<ticket_id:string,supplier_id:string,issue_type:string,order_id:string,"
    "amount_disputed:double,currency:string,priority:string,assigned_agent:string,resolution_requested:string,"
    "item_returned:boolean>"
)
CHATML_SCHEMA = "messages array<struct<role:string,content:string>>"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Golden triplets with the defaults of their optional fields."""
    rows = read_jsonl(spark, path, GOLDEN_SCHEMA)
    named = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("doc_id", "category", "difficulty")]
    return rows.select("query", "context", "ground_truth", *named, "section")


def read_raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Support logs and tickets of every JSON-lines file of a folder."""
    reader = spark.read.schema(RAW_LOG_SCHEMA).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl")
    rows = reader.json(folder)
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, null fields written out, one file per partition."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document per file."""
    return spark.read.option("multiLine", "true").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a single JSON file."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """HTML files as (path, html); undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        "path", _lenient_utf8(F.col("content")).alias("html")
    )


@F.pandas_udf(T.StringType())
def _lenient_utf8(contents: pd.Series) -> pd.Series:
    return contents.map(lambda raw: bytes(raw).decode("utf-8", errors="replace"))


def create_collection(spark: SparkSession, name: str, schema: str, recreate: bool = False) -> bool:
    """A vector collection as a table; an existing one is kept unless recreated."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    elif spark.catalog.tableExists(name):
        return False
    spark.createDataFrame([], schema).write.saveAsTable(name)
    return True


def upsert_latest(stored: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """Latest version of every key over both frames.

    A max_by aggregate: copies are reduced before the exchange, so a key with
    very many versions sends one row per task.
    """
    both = stored.unionByName(fresh)
    rest = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row"))
    return latest.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def load_config(path: str) -> dict:
    """Settings of a YAML file, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)
