"""Streaming reads."""

from __future__ import annotations

from tallyloom.plans.registry import query
from tallyloom.session import scratch_dir
from tallyloom.streaming import incremental


@query("incremental_scan", "SELECT * FROM orders")
def incremental_scan(spark, sf):
    stream = incremental.incremental_scan(spark, f"{sf}/orders.parquet", files_per_trigger=1000)
    return incremental.drain(stream, scratch_dir(spark, "drained"))


@query("stream_totals", """
SELECT 'orders' AS source, round(sum(o_totalprice), 2) AS total, count(*) AS rows FROM orders
UNION ALL SELECT 'lineitem', round(sum(l_extendedprice), 2), count(*) FROM lineitem""")
def stream_totals(spark, sf):
    return incremental.stream_totals({
        "orders": (incremental.incremental_scan(spark, f"{sf}/orders.parquet"), "o_totalprice"),
        "lineitem": (incremental.incremental_scan(spark, f"{sf}/lineitem.parquet"), "l_extendedprice"),
    }, scratch_dir(spark, "totals"))
