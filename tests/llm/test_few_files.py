"""Small tables are not written as a file for each shuffle partition: on a local disk every file starts processes beside the executor."""

from pyspark.sql import functions as F

from lodestack.llm import components as c


def test_components_write_few_files(spark, monkeypatch):
    parts = []
    store = c.materialise
    monkeypatch.setattr(c, "materialise", lambda df, name: parts.append(df.rdd.getNumPartitions()) or store(df, name))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 97)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 10).alias("b"))
        found = dict(tuple(r) for r in c.components(edges, "a", "b").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {n: n % 10 for n in range(310)}
    assert max(parts) <= spark.sparkContext.defaultParallelism
