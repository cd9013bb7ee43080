"""Finding of round 3 on the pipeline: the driver's memory on many partitions."""

import random

from lodestone.llm import components


def test_few_edges_are_few_tasks(spark):
    """Pipeline: rounds over few edges have no exchange, however many partitions the session has; results are those of many edges."""
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)]
    rows = spark.createDataFrame(edges, "src long, dst long")
    few = components.FEW
    tracker = spark.sparkContext.statusTracker()

    def found(most, group):
        components.FEW = most
        spark.sparkContext.setJobGroup(group, group)
        try:
            got = {x.node: x.component for x in components.connected_components(rows).collect()}
        finally:
            components.FEW = few
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return got, sum(i.numTasks for i in infos if i)

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many, tasks = found(0, "many")
        one, fewer = found(few, "few")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert one == many and len(set(one.values())) > 1
    assert fewer < tasks / 3, (fewer, tasks)
