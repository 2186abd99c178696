"""Tables in the folder that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast, of about 100 bytes each.
BROADCAST_ROWS = 500_000
#: Bytes for each core up to which a table in few files is dealt anew.
SMALL_BYTES = 16_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, as in tests, a folder in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomlake-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files behind a frame that stored() returned."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomlake-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, each: int = SMALL_BYTES) -> DataFrame:
    """A table in fewer files than there are cores, and of up to ``each`` bytes for each core, is dealt to all of them.

    A file of one row group is one task's however many splits it has. Larger tables, and those of more files, stay as
    they are: no rows are moved.
    """
    spark, files = df.sparkSession, df._jdf.inputFiles()  # an array in the JVM: of many files none is named here
    cores = spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return df
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    size = sum((p := path(f)).getFileSystem(conf).getFileStatus(p).getLen() for f in files)
    return df.repartition(cores) if size <= each * cores else df


def small_or_merge(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose rows were counted and are few; beyond that a sort-merge join, which AQE splits by skew."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df.hint("merge")
