"""Pose graphs over all events of a take."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans import surface


@pytest.mark.parametrize("size, nodes", [(120, 30), (124, 31), (6, 2)])
def test_pose_graph_has_all_fragments(spark, tmp_path, size, nodes):
    some = spark.read.parquet("/root/testdata/sf0.01/events.parquet").orderBy("event_id").limit(size)
    some.withColumn("user_id", F.lit(1).cast(some.schema["user_id"].dataType)).write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r["node"] for r in surface.pose_graph(spark, str(tmp_path)).collect()) == list(range(nodes))
