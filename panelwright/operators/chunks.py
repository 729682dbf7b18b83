"""Sensor histories in chunks of rows, for axes that are too long for one task a sensor.

With PanelConfig.chunk_rows, what needs a sensor's rows in order works on chunks of that many
positions: windows of bounded length get the rows that they reach into from the chunks
beside (a halo); states that reach back without bound are summed up for each chunk, carried
over the few chunks of a sensor, and settled in a second pass; ranks and quantiles come from
a range partition and the sizes of its parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources.scratch import written

from .sizes import bounded

#: A row's number of partition stands in front of these bits of its id.
PLACE_BITS = 33


def chunk_of(rows: int) -> Column:
    return F.floor(F.col("pos") / rows)


def in_chunks(panel: DataFrame, rows: int, back: int, ahead: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(panel), whose windows by sensor look back and ahead so many rows at most, computed in chunks.

    make sees each chunk as a sensor of its own, with the rows around it that its windows
    reach; these are left out afterwards. A row is repeated for each chunk that reaches it.
    """
    reached = F.sequence(F.greatest(F.floor((F.col("pos") - ahead) / rows), F.lit(0)), F.floor((F.col("pos") + back) / rows))
    spread = panel.withColumn("__chunk", F.explode(reached)).withColumn("sid", F.struct("sid", F.col("__chunk").alias("chunk"))).drop("__chunk")
    made = make(spread).where(F.col("sid.chunk") == chunk_of(rows))
    return made.withColumn("sid", F.col("sid.sid"))


def carried(ends: DataFrame, names: list[str]) -> DataFrame:
    """ends(sid, __chunk, names): for each chunk the last known values of those before it, as <name>_in."""
    before = Window.partitionBy("sid").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("sid", "__chunk", *[F.last(n, ignorenulls=True).over(before).alias(f"{n}_in") for n in names])


def state_events(panel: DataFrame, rows: int) -> DataFrame:
    """panel with __was, __start, __onset and __length as a window over the whole sensor gives them (see windows.add_state_times)."""
    from .clean import by_sid

    own = in_chunks(panel, rows, 1, 0, lambda p: p.withColumn("__was", F.lag("label").over(by_sid())))
    begins = F.col("__was").isNull() | (F.col("__was") != F.col("label"))
    own = own.withColumns({"__chunk": chunk_of(rows), "__s": F.when(begins, F.col("pos")), "__o": F.when((F.col("__was") == 0) & (F.col("label") == 1), F.col("pos"))})
    own = written(own, "states")
    by = Window.partitionBy("sid", "__chunk").orderBy("pos")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    ends = own.groupBy("sid", "__chunk").agg(F.max("__s").alias("__s"), F.max("__o").alias("__o"))
    own = own.join(bounded(carried(ends, ["__s", "__o"])), ["sid", "__chunk"])
    own = own.withColumns({"__start": F.coalesce(F.max("__s").over(so_far), "__s_in"), "__onset": F.coalesce(F.max("__o").over(so_far), "__o_in")})
    # at the row that ends an episode, the row before it knows where the episode began
    began = F.coalesce(F.lag("__start").over(by), "__s_in")
    own = own.withColumn("__l", F.when((F.col("__was") == 1) & (F.col("label") == 0), F.col("pos") - began))
    lengths = own.groupBy("sid", "__chunk").agg(F.max_by("__l", F.when(F.col("__l").isNotNull(), F.col("pos"))).alias("__l"))
    own = own.join(bounded(carried(lengths, ["__l"])), ["sid", "__chunk"])
    own = own.withColumn("__length", F.coalesce(F.last("__l", ignorenulls=True).over(so_far), "__l_in"))
    return own.drop("__s", "__o", "__l", "__s_in", "__o_in", "__l_in", "__chunk")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, written in the order of range partitions, with __part and __id, which ascend with it."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return written(ordered.withColumn("__part", F.shiftright("__id", PLACE_BITS)), "placed")


def ranked(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """rows with their rank from 0 in an order without ties, and n, how many there are."""
    ordered = placed(rows, order)
    sizes = sorted((r["__part"], r["count"]) for r in ordered.groupBy("__part").count().collect())  # a row a partition
    firsts, total = [], 0
    for part, size in sizes:
        firsts.append((part, total))
        total += size
    starts = F.broadcast(rows.sparkSession.createDataFrame(firsts, "__part long, __first long"))
    place = F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    out = ordered.join(starts, "__part").withColumns({name: F.col("__first") + place, "n": F.lit(total).cast("bigint")})
    return out.drop("__part", "__id", "__first")


def quantiles(rows: DataFrame, column: str, share: float) -> DataFrame:
    """(sid, value): the exact quantile of each sensor's values, between two ranks by their distance; nulls are left out.

    Equal values are counted before they are ordered, distinct ones are range-partitioned,
    and ranks come from running counts within a sensor's part of a partition and the sums
    of the parts before it. No task holds a sensor's values.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy("sid", F.col(column).alias("__v")).agg(F.count("*").alias("__k"))
    ordered = placed(counts, ["sid", "__v"])
    parts = ordered.groupBy("sid", "__part").agg(F.sum("__k").alias("__all"))
    whole = Window.partitionBy("sid")
    before = F.coalesce(F.sum("__all").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("sid", "__part", before.alias("__before"), F.sum("__all").over(whole).alias("__n"))
    so_far = Window.partitionBy("sid", "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    upto = ordered.join(bounded(parts), ["sid", "__part"]).withColumn("__upto", F.col("__before") + F.sum("__k").over(so_far))
    at = (F.col("__n") - 1) * F.lit(float(share))
    holds = lambda rank: (F.col("__upto") - F.col("__k") <= rank) & (rank < F.col("__upto"))
    ends = upto.groupBy("sid").agg(F.first(at).alias("__at"), F.max(F.when(holds(F.floor(at)), F.col("__v"))).alias("__lo"), F.max(F.when(holds(F.ceil(at)), F.col("__v"))).alias("__hi"))
    lo, hi = F.floor("__at"), F.ceil("__at")
    between = (hi - F.col("__at")) * F.col("__lo") + (F.col("__at") - lo) * F.col("__hi")
    return ends.select("sid", F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(between).alias("value"))
