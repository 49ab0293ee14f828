"""What a merge sends to the driver."""

import re

from locusframe.plans import catalog


def test_merged_sites_are_not_broadcast(spark, sf_dir):
    """Spark expects little of a table whose files are small: with any table taken as small, samples alone go to the driver."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = catalog.QUERIES["merge_info"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    joins = re.findall(r"Broadcast(?:HashJoin \[|NestedLoopJoin )([^\n]*)", plan)
    joins = [j for j in joins if "sample_idx" not in j]  # the mapping's own join of parts with line items, a table of large files
    assert joins and not [j for j in joins if re.search(r"site_id|new_id|chrom", j)], joins
    assert re.search(r"SortMergeJoin \[src#\d+, site_id", plan)
