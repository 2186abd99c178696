"""Tables in the shared folder, and what is dealt anew."""

from loomlake.functions import shared


def test_stored_tables_and_spread(spark):
    df = spark.range(100).withColumnRenamed("id", "v")
    kept = shared.stored(df.coalesce(1), "numbers")
    assert kept.count() == 100 and len(kept.inputFiles()) == 1
    dealt = shared.spread(kept)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.v for r in dealt.collect()) == list(range(100))
    assert shared.spread(kept, each=1) is kept  # too large
    many = shared.stored(df.repartition(9), "numbers")
    assert shared.spread(many) is many and shared.spread(df) is df
    shared.drop_stored(many)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert shared.shared_dir(spark) == (folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared")
