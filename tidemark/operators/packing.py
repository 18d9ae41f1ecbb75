"""Tasks of very different cost, dealt to partitions so that none is much longer than the others.

Tasks are ordered by estimated cost, dearest first, and dealt out to and fro over the partitions: of every round each partition
gets one, and who got the dearest of a round gets the cheapest of the next. The longest partition is over the mean by the cost
of one task at most, whatever the mixture. The order is by ranges with counts before each, so that no task sorts everything.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import cumulative

#: Seconds of a fit on a monthly series of 63 values, measured; only their proportions matter.
SECONDS = {
    "naive_1": 0.001, "seasonal_naive": 0.001, "drift": 0.001, "theta": 0.003, "ridge": 0.002, "arima_110": 0.012, "ets": 0.2, "svr_rbf": 0.9, "xgboost": 1.3, "sarima": 4.0,
    "NF_BASE": 0.001, "FCM": 0.001, "HYBRID": 0.05, "DYNAMIC": 0.05,
}
#: Of a method that isn't listed: a swarm.
OTHER = 0.1


def cost(method: Column | str = "method", size: Column | int = 63) -> Column:
    """Estimated seconds of a task, in proportion to the length of its series."""
    table = F.create_map(*(F.lit(x) for x in chain(*SECONDS.items())))
    name = F.col(method) if isinstance(method, str) else method
    return F.coalesce(F.try_element_at(table, F.coalesce(name, F.lit(""))), F.lit(OTHER)) * (F.lit(size) if isinstance(size, int) else size) / 63.0


def to_and_fro(place: Column, bins: int) -> Column:
    """The partition of the task at each place (from 0) of the order by cost."""
    at = F.pmod(place, F.lit(bins))
    return F.when(F.floor(place / bins) % 2 == 0, at).otherwise(bins - 1 - at).cast("int")


def packed(work: DataFrame, by: Column, identity: list[str], bins: int | None = None) -> DataFrame:
    """The rows of ``work`` in ``bins`` partitions of about equal cost ``by``. ``identity`` tells rows apart; those that agree in
    it still have one place each. Null costs come last."""
    bins = bins or int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = work.withColumn("_cost", -F.coalesce(by, F.lit(0.0))).withColumn("_tie", F.monotonically_increasing_id()).withColumn("_one", F.lit(1).cast("bigint"))
    placed = cumulative(ordered, ["_cost", *identity, "_tie"], _before="_one")
    return placed.withColumn("_bin", to_and_fro(F.col("_before"), bins)).repartitionById(bins, "_bin").select(*work.columns)
