"""Known counts on the shared tables, and results that do not depend on partitioning."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxloom.operators.suppress import keep_best
from workload import views as V

SF = "/root/testdata/sf0.01"


def test_greedy_removal_keeps_the_known_count(spark):
    """Boxes numbered by line, as the written-down result has them."""
    line = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = V.table(spark, SF, "lineitem").withColumn("line", F.row_number().over(line))
    boxes = V.boxes_of(lines, F.col("line").alias("line")).select(
        "img", "line", "score", "x1", "y1", "x2", "y2")
    kept = keep_best(boxes, ["img"], [-F.col("score"), F.col("line")], 0.25)
    assert kept.count() == 34_720


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    boxes = V.boxes(spark, "/root/testdata/sf0.001").select("img", "box", "score", "x1", "y1", "x2", "y2")
    results = []
    for parts in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        kept = keep_best(boxes.repartition(parts), ["img"], [-F.col("score"), F.col("box")], 0.25)
        results.append(sorted((r.img, r.box) for r in kept.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]
