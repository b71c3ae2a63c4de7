"""What a scan by resource reads falls with the number of resources."""

from pyspark.sql import functions as F

from spendshift.sources import metric_store


def read_bytes(frame):
    """Files and rows that the scan read, from the metrics of the plan that ran."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    found, nodes = {}, [plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(n) for n in range(children.size())]
        if node.nodeName().startswith("Scan parquet") and node.metrics().contains("numFiles"):
            found["files"] = node.metrics().apply("numFiles").value()
            found["rows"] = node.metrics().apply("numOutputRows").value()
    return found


def test_scans_by_resource_read_less(spark, tmp_path):
    points = spark.range(60_000).select(
        F.concat(F.lit("r-"), (F.col("id") % 3_000).cast("string")).alias("resource_id"), F.lit("aws").alias("provider"), F.col("id").alias("value")
    )
    odd = points.limit(1).select(F.lit(None).cast("string").alias("resource_id"), "provider", "value")
    path = str(tmp_path / "points")
    metric_store.write_points(points.union(odd), path, buckets=16, row_group=4_096)
    read = {}
    for number in (1, 10, 3_000):
        wanted = points.filter(F.col("value") < number).select("provider", "resource_id").union(spark.createDataFrame([("aws", None)], "provider string, resource_id string"))
        got = metric_store.read_points(spark, path, wanted, ("provider", "resource_id"), buckets=16)
        assert got.count() == 20 * number and got.select("resource_id").distinct().count() == number
        read[number] = read_bytes(got)
    assert read[1]["files"] < read[10]["files"] < read[3_000]["files"]
    assert read[1]["rows"] < read[10]["rows"] < read[3_000]["rows"] and read[1]["rows"] < 60_000 / 50
    nobody = spark.createDataFrame([], "provider string, resource_id string")
    assert metric_store.read_points(spark, path, nobody, ("provider", "resource_id"), buckets=16).collect() == []
