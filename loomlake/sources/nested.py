"""Readers and writers of the nested JSON layouts. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered

EXAMPLE = (
    "input string, output string, metadata_fold int, metadata_task_type string, metadata_source string, metadata_row_index bigint, metadata_n_classes int"
)
DOCUMENT = f"datasets array<struct<dataset: string, examples: array<struct<{EXAMPLE.replace(' string', ': string').replace(' int', ': int').replace(' bigint', ': bigint')}>>>>"
RECORD = "input map<string,double>, output double, metadata_fold int, metadata_dataset string, metadata_task string, metadata_source string, metadata_n_classes int"
RESULTS = "dataset string, method string, folds array<struct<fold: int, status: string, balanced_accuracy: double, r2: double, fit_time: double>>"


def read_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A JSON document that is an array of objects, or one object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> DataFrame:
    """An object a line; blank lines are none, broken ones are rows of nulls and go."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df.dropna("all")


def read_examples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Part, position, dataset and the fields of each example of documents in one or more parts.

    Each example gets its dataset's name before the array is exploded, else every row carries the whole document along.
    A document is parsed as one row; writers keep them small (``example_documents``, ``byte_parts``).
    """
    docs = read_array(spark, paths, DOCUMENT)
    named = lambda d: F.transform(d["examples"], lambda e, i: F.struct(i.alias("position"), d["dataset"].alias("dataset"), e.alias("e")))
    every = F.flatten(F.transform(F.filter("datasets", lambda d: d["examples"].isNotNull()), named))
    return docs.select(F.input_file_name().alias("part"), F.explode(every).alias("x")).select("part", "x.position", "x.dataset", "x.e.*")


def example_documents(df: DataFrame, dataset: str, example: Column, most: int = 50_000) -> DataFrame:
    """S3: a row for each document, of one dataset and of up to ``most`` examples; larger datasets have several."""
    chunk = F.floor(F.monotonically_increasing_id() / most)
    some = df.select(F.col(dataset).alias("dataset"), example.alias("example"), chunk.alias("chunk")).groupBy("dataset", "chunk")
    return some.agg(F.collect_list("example").alias("examples")).select(F.array(F.struct("dataset", "examples")).alias("datasets"))


def parse_input(df: DataFrame, features: list[str], lenient: bool = False) -> DataFrame:
    """The JSON text ``input`` as columns: what is missing or no number is null, or 0 if lenient."""
    parsed = df.withColumn("__m", F.from_json("input", "map<string,string>"))
    value = lambda f: F.col("__m")[f].try_cast("double")
    return parsed.withColumns({f: F.coalesce(value(f), F.lit(0.0)) if lenient else value(f) for f in features}).drop("__m")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that there is."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(paths)


def dataset_from_source(column: str):
    """The name after the last underscore of a source."""
    return F.regexp_extract(column, r"([^_]*)$", 1)


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tidy rows of nested results; only successful folds."""
    return tidy_results(read_array(spark, path, RESULTS))


def tidy_results(df: DataFrame) -> DataFrame:
    rows = df.select("dataset", "method", F.explode("folds").alias("f")).select("dataset", "method", "f.*")
    return rows.where("status = 'success'").drop("status").withColumn("score", F.coalesce("balanced_accuracy", "r2"))


def write_lines(df: DataFrame, path: str) -> None:
    """S9."""
    df.write.mode("overwrite").json(path)


def write_parts(df: DataFrame, path: str, order: str, rows: int) -> None:
    """Parts of at most ``rows`` rows, ordered by range."""
    n = max(1, -(-df.count() // rows))
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)


def byte_parts(df: DataFrame, dataset: str, order: list[str], most: int, overhead: int = 50) -> DataFrame:
    """Df with part: datasets follow one another into parts of fewer than ``most`` bytes of JSON; a dataset that is
    larger by itself has parts of its own, of ``rows // (bytes // most + 1)`` rows each.

    Only a size for each dataset comes to the driver; rows are numbered within their dataset by ranges.
    """
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*df.columns))) + 1).alias("bytes")).orderBy(dataset).collect()
    first, chunk, part, used = {}, {}, 0, overhead
    for name, n, size in sizes:
        if used + size >= most and used > overhead:
            part, used = part + 1, overhead
        first[name] = part
        if overhead + size < most:
            used += size
        else:
            chunk[name] = max(1, n // (size // most + 1))
            part += -(-n // chunk[name])
    lookup = lambda d, kind: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col(dataset)] if d else F.lit(None).cast(kind)
    places = numbered(df, order, "__place", [dataset])
    return places.withColumn("part", (lookup(first, "int") + F.coalesce(F.floor(F.col("__place") / lookup(chunk, "int")), F.lit(0))).cast("int")).drop("__place")


def write_by_dataset(df: DataFrame, path: str, column: str = "dataset") -> None:
    """A checkpoint that a later run reads by dataset."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def nested_results(df: DataFrame, keys: list[str]) -> DataFrame:
    """One struct a key with its rows as an array, for a JSON sink. Keys are configurations, so arrays are short."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))
