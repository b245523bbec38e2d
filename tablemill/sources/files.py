"""Reading and writing tables and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.names import col


def scan_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A Parquet table, also as a view if it gets a name."""
    df = spark.read.parquet(path)
    if name:
        df.createOrReplaceTempView(name)
    return df


def scan_parquet_sample(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows, the smallest by a hash of key and seed; each task keeps ``n`` rows at most."""
    return df.orderBy(F.md5(F.concat(col(key).cast("string"), F.lit(seed))), col(key)).limit(n)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; give a schema for large files, else one pass infers it."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def scan_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files that hold one JSON array each; a file is read by one task."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are text."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def sink_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def sink_sample(df: DataFrame, path: str, n: int, key: str, source: str) -> None:
    """One JSON file with ``n`` sampled rows and where they come from."""
    scan_parquet_sample(df, key, n).withColumn("source", F.lit(source)).coalesce(1).write.json(path)


class Journal:
    """An append-only record journal with a success and a failure view.

    Spark's commit protocol makes an append whole or absent. The configuration's hash lies beside
    the records; a journal of another configuration isn't resumed.
    """

    def __init__(self, spark: SparkSession, path: str, config: dict, schema: str, key: str):
        import hashlib
        import json

        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = schema
        own = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
        try:
            held = [r.value for r in spark.read.text(f"{self.path}/config").collect()]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            held = []
        if held and held != [own]:
            raise ValueError("the journal belongs to another configuration")
        if not held:
            spark.createDataFrame([(own,)], "value string").coalesce(1).write.text(f"{self.path}/config")

    def records(self, good: Column | None = None) -> DataFrame:
        """All records, or those for which ``good`` holds."""
        try:
            out = self.spark.read.schema(self.schema).json(f"{self.path}/records")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            out = self.spark.createDataFrame([], self.schema)
        return out if good is None else out.filter(good)

    def append(self, rows: DataFrame) -> int:
        """Appends the rows whose key the journal hasn't, of rows with equal keys one; their number."""
        new = rows.join(self.records().select(self.key), self.key, "left_anti").select(*map(col, rows.columns)).dropDuplicates([self.key])
        seen = Observation()
        new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(f"{self.path}/records")
        return seen.get["n"]


#: The columns of a task record, whatever dataset it comes from.
TASK = ("task_id", "dataset", "split", "db_id", "question", "gold_sql", "metadata")


def tasks(df: DataFrame, dataset: str, split: str, names: dict[str, str]) -> DataFrame:
    """Records of one dataset as task records: ``names`` says which of its fields is which; the rest is metadata."""
    known = {k: col(v) for k, v in names.items()}
    rest = [c for c in df.columns if c not in names.values()]
    fill = {"dataset": F.lit(dataset), "split": F.lit(split), "metadata": F.to_json(F.struct(*map(col, rest))) if rest else F.lit(None).cast("string")} | known
    return df.select(*(fill.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in TASK))
