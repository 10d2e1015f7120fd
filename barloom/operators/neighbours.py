"""Mutual information of numeric features with a class by nearest neighbours, on sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.evaluate import running_totals
from barloom.operators.order_stats import with_slices
from barloom.session import written_table

NEIGHBOURS = 3


def digamma(m: Column) -> Column:
    """Digamma of a positive integer: six steps up by its recurrence, and the asymptotic series from there."""
    steps = sum((1 / (m + F.lit(i)) for i in range(6)), F.lit(0.0))
    z = (m + 6).cast("double")
    z2 = z * z
    tail = 1 / (12 * z2) - 1 / (120 * z2 * z2) + 1 / (252 * z2 * z2 * z2) - 1 / (240 * z2 * z2 * z2 * z2)
    return F.ln(z) - 1 / (2 * z) - tail - steps


def _with_neighbours(values: DataFrame, k: int) -> DataFrame:
    """Adds near: the k values on either side within the same feature and class, with their counts.

    Values are sorted in slices. A slice gets the few rows of the neighbouring slices that its first and last rows need.
    """
    keys = ["feature", "y"]
    pair = F.struct("x", "n")
    sliced, slices = with_slices(values, *keys, "x")
    rows = sliced.withColumn("own", F.lit(True))
    if slices > 1:
        inside = Window.partitionBy("_slice", *keys)
        placed = sliced.withColumns({"first": F.row_number().over(inside.orderBy("x")), "last": F.row_number().over(inside.orderBy(F.desc("x")))})
        edge = written_table(placed.filter(f"first <= {k} OR last <= {k}"), "slice-edges")  # 2k rows per slice and class
        along = Window.partitionBy(*keys).orderBy("x")
        edge = edge.withColumns(
            {"before": F.collect_list(pair).over(along.rowsBetween(-k, -1)), "after": F.collect_list(pair).over(along.rowsBetween(1, k))}
        )
        lent = [edge.filter(f"{at} = 1").select(*keys, "_slice", F.explode(side).alias("p")) for at, side in (("first", "before"), ("last", "after"))]
        rows = rows.unionByName(lent[0].union(lent[1]).select(*keys, "p.x", "p.n", "_slice", F.lit(False).alias("own")))
    w = Window.partitionBy("_slice", *keys).orderBy("x")
    near = F.concat(F.collect_list(pair).over(w.rowsBetween(-k, -1)), F.collect_list(pair).over(w.rowsBetween(1, k)))
    return rows.withColumn("near", near).filter("own").drop("own", "_slice")


def neighbour_information(df: DataFrame, target: str, features: list[str], k: int = NEIGHBOURS) -> DataFrame:
    """feature, mi_score (nats): how much each numeric feature tells of the class, by the k-th neighbour of equal class.

    A row's radius is the distance to the k-th nearest other row of its class; the rows of any class that are nearer than
    that are counted (where the radius is 0: the equal ones, the row itself included). Feature by feature that is
    one-dimensional: neighbours lie within k rows of the sorted order, and a count within a radius is the difference
    of two running totals, looked up by putting the interval's ends among the values. Equal values of a class are one
    row with a count. Rows without a class or with a NULL or NaN value take no part for that feature, nor do classes of
    one row; a class of fewer than k others uses all of them. No noise is added, so results repeat. Never negative.
    """
    long = df.select(F.col(target).alias("y"), *[F.col(c).cast("double") for c in features]).unpivot("y", features, "feature", "x")
    counts = long.filter("y IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)").groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    counts = written_table(counts, "value-counts")
    classes = counts.groupBy("feature", "y").agg(F.sum("n").alias("class_rows")).filter("class_rows > 1")
    values = counts.join(classes.select("feature", "y"), ["feature", "y"])
    near = _with_neighbours(values, k).join(classes, ["feature", "y"])

    others = F.flatten(F.transform("near", lambda p: F.array_repeat(F.abs(p["x"] - F.col("x")), F.least(p["n"], F.lit(k)).cast("int"))))
    same = F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    of_class = F.least(F.lit(k), F.col("class_rows") - 1)
    sized = near.withColumns({"k": of_class, "r": F.element_at(F.array_sort(F.concat(same, others)), of_class.cast("int"))}).drop("near")
    sized = written_table(sized, "radii")

    # the open interval's ends among the values: ends to the right stand before equal values and ends to the left behind
    # them; with a radius of 0 it is the other way round
    turn = F.when(F.col("r") > 0, 1).otherwise(-1)
    end = F.explode(F.array(*[F.struct((F.col("x") + s * F.col("r")).alias("v"), (-s * turn).alias("side"), F.lit(s).alias("sign")) for s in (1, -1)]))
    probes = sized.select("feature", "y", "x", end.alias("e")).select("feature", "y", "x", F.struct("e.v", "e.side").alias("place"), F.lit(0).cast("long").alias("n"), "e.sign")
    points = values.select(
        "feature", F.lit(None).cast(values.schema["y"].dataType).alias("y"), F.lit(None).cast("double").alias("x"),
        F.struct(F.col("x").alias("v"), F.lit(0).alias("side")).alias("place"), "n", F.lit(0).alias("sign"),
    )
    totals = running_totals(points.unionByName(probes), "feature", "place", ["n"])
    within = totals.filter("sign <> 0").groupBy("feature", "y", "x").agg(F.sum(F.col("sign") * F.col("cum_n")).alias("m"))

    n = F.col("n").cast("double")
    parts = sized.join(within, ["feature", "y", "x"]).groupBy("feature").agg(
        F.sum("n").alias("rows"), F.sum(n * (digamma(F.col("k")) - digamma(F.col("class_rows")) - digamma(F.col("m")))).alias("s")
    )
    score = F.greatest(F.lit(0.0), digamma(F.col("rows")) + F.col("s") / F.col("rows"))
    every = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")  # the caller's list of names
    return every.join(parts.select("feature", score.alias("mi_score")), "feature", "left").select("feature", F.coalesce("mi_score", F.lit(0.0)).alias("mi_score"))
