"""Session settings that bound what a task holds."""

from pyspark.sql import functions as F

from bazaarlens.session import tune


def test_a_task_gets_a_small_piece_of_a_shuffle(spark):
    rows = spark.range(1_500_000).select(F.sha1(F.col("id").cast("string")).alias("key"))
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        found = tune(spark) and rows.groupBy("key").count()
        # About 40 MB, which Spark by itself would give to one task.
        assert found.rdd.getNumPartitions() >= 4
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_shuffle_begins_with_many_pieces_whatever_the_number_of_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        found = tune(spark) and spark.range(10).groupBy((F.col("id") % 3).alias("key")).count()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ", 1000)" in next(line for line in plan.splitlines() if "hashpartitioning" in line)
        assert sorted(tuple(r) for r in found.collect()) == [(0, 4), (1, 3), (2, 3)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
