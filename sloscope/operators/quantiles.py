"""Exact quantiles without a buffer that grows with a series: brackets by sketch, counts, then a selection.

The order statistics that a quantile lies between are known by their places. A pass over
the values sketches those inside a series' bracket (at first all) and so proposes a narrower
one; the next pass counts, exactly and on the map side, what lies below and inside it, and
sketches again. A bracket that turns out not to hold its places takes the old bound on that
side. Every pass narrows by some GRID / 2, so that three or four do for any number of
values; at most LIMIT values of a series are then gathered and sorted. A bracket of a single
value needs no gathering, however often the value stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloscope.operators.buckets import SKETCH_K
from sloscope.scratch import shared_folder

#: Values of a series that are gathered at last.
LIMIT = 100_000
#: Steps of rank that a sketch is asked at; its rank error at SKETCH_K is far below half a step.
GRID = 128


def _written(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession, "quantiles")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _sketch(value: Column) -> Column:
    """Values at GRID + 1 ranks of the sketched ones."""
    return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(value, F.lit(SKETCH_K)), F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]))


def _proposed(rows: DataFrame) -> DataFrame:
    """Adds a bracket (a, b) inside the known one, a step of rank wider than the places on each side."""
    step = lambda place: place.cast("double") / F.greatest("inside", F.lit(1)) * GRID
    low = F.greatest(F.lit(0), F.floor(step(F.col("k") - F.col("below"))).cast("int") - 1)
    high = F.least(F.lit(GRID), F.ceil(step(F.col("k") + 2 - F.col("below"))).cast("int") + 1)
    at = lambda k: F.element_at("grid", k + 1)
    return rows.withColumns({"a": F.when(low == 0, F.col("lo")).otherwise(at(low)), "b": F.when(high == GRID, F.col("hi")).otherwise(at(high))}).drop("grid")


def exact_quantile(values: DataFrame, q: float, limit: int = LIMIT, discrete: bool = False) -> DataFrame:
    """series, n and quantile (interpolated as ``percentile`` does) of ``values`` (series, v); null values don't count.

    With ``discrete`` the quantile is the least value with a share ``q`` of the values up to it, as ``percentile_disc`` has it.
    """
    values = values.filter("v IS NOT NULL").select("series", "v")
    first = values.groupBy("series").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), _sketch(F.col("v")).alias("grid"))
    place = (F.col("n") - 1) * F.lit(float(q))
    if discrete:  # rounded, so that a product next to a whole number counts as that number
        place = F.greatest(F.ceil(F.round(F.col("n") * F.lit(float(q)), 7)) - 1, F.lit(0)).cast("double")
    first = first.select("series", "n", place.alias("place"), F.floor(place).cast("long").alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "grid")
    known = _written(_proposed(first))
    done = (F.col("inside") <= limit) | (F.col("lo") == F.col("hi"))
    found = known.filter(done)
    wide = known.filter(~done)
    while not wide.isEmpty():
        met = values.join(wide.select("series", "a", "b"), "series")
        within = F.col("v").between(F.col("a"), F.col("b"))
        counts = met.groupBy("series").agg(F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if(within).alias("held"), _sketch(F.when(within, F.col("v"))).alias("grid"))
        rows = wide.join(counts, "series")
        low_ok, high_ok = F.col("under") <= F.col("k"), F.col("under") + F.col("held") > F.least(F.col("k") + 1, F.col("n") - 1)
        end = F.when(high_ok, F.col("under") + F.col("held")).otherwise(F.col("below") + F.col("inside"))
        below = F.when(low_ok, F.col("under")).otherwise(F.col("below"))
        rows = rows.select(
            "series", "n", "place", "k", F.when(low_ok, F.col("a")).otherwise(F.col("lo")).alias("lo"), F.when(high_ok, F.col("b")).otherwise(F.col("hi")).alias("hi"),
            below.alias("below"), (end - below).alias("inside"), "grid",
        )
        known = _written(_proposed(rows))
        found, wide = found.union(known.filter(done)), known.filter(~done)
    # what is gathered is a bracket's values, or only its one value; the value behind it may be the second place
    met = values.join(found, "series")
    gather = F.when((F.col("lo") < F.col("hi")) & F.col("v").between(F.col("lo"), F.col("hi")), F.col("v"))
    picked = met.groupBy("series").agg(F.sort_array(F.collect_list(gather)).alias("own"), F.min(F.when(F.col("v") > F.col("hi"), F.col("v"))).alias("beyond"))
    out = found.join(picked, "series")

    def at(k: Column) -> Column:
        """The value at a place: inside the bracket, else the next one."""
        inside = k < F.col("below") + F.col("inside")
        return F.when(~inside, F.col("beyond")).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.try_element_at("own", (k - F.col("below") + 1).cast("int")))

    share = F.col("place") - F.col("k")
    value = F.when(share == 0, at(F.col("k"))).otherwise((F.col("k") + 1 - F.col("place")) * at(F.col("k")) + share * at(F.col("k") + 1))
    return out.select("series", "n", value.alias("quantile"))
