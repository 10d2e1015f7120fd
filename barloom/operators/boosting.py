"""Boosted trees for every symbol at once: a level of all symbols' trees is one aggregation.

Features become bins of their symbol's quantiles. Gradients are summed by (symbol, node, feature, bin) with sums formed
before the shuffle, so a symbol that holds most rows costs a row per bin and task, and the number of jobs depends on
rounds and depth alone, not on the number of symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import written_table

#: Bytes of trees that may be broadcast to the rows; beyond that the join is by symbol.
BROADCAST_BYTES = 64 << 20
_SPLIT = "struct<feature:int,bin:int,gain:double>"


@dataclass(frozen=True)
class Boosting:
    rounds: int = 20
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    l2: float = 1.0
    least_rows: int = 5
    least_gain: float = 1e-6


def _codes(features: int) -> Column:
    """Bin of each value: 0 where it is NULL or NaN, else one more than the number of cuts below it."""
    def code(i: int) -> Column:
        x = F.get("x", F.lit(i))
        return F.when(x.isNull() | F.isnan(x), 0).otherwise(F.size(F.filter(F.get("cuts", F.lit(i)), lambda c: c < x)) + 1)

    return F.array(*[code(i) for i in range(features)])


def _placed(rows: DataFrame, depth: int) -> DataFrame:
    """The rows with ``node``, numbered as in a heap, at which they arrive: a row stays where a node has no split.

    A column a level, which Spark compiles; a fold over the levels would be interpreted row by row.
    """
    rows = rows.withColumn("node", F.lit(0))
    for _ in range(depth):
        rows = rows.withColumn("_split", F.get("tree", F.col("node")))
        beyond = (F.get("codes", F.col("_split.feature")) > F.col("_split.bin")).cast("int")
        rows = rows.withColumn("node", F.when(F.col("_split").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + beyond)).drop("_split")
    return rows


def _small(table: DataFrame, width: int) -> DataFrame:
    return F.broadcast(table) if table.count() * width <= BROADCAST_BYTES else table


def _by_node(rows: DataFrame, first: int, count: int, value: Column, kind: str) -> DataFrame:
    """symbol and ``values``: an array with the value of each node from ``first`` on, NULL where there is none."""
    held = rows.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("node", value.alias("v")))).alias("m"))
    return held.select("symbol", F.transform(F.sequence(F.lit(first), F.lit(first + count - 1)), lambda n: F.try_element_at("m", n)).cast(f"array<{kind}>").alias("values"))


def _best_splits(rows: DataFrame, p: Boosting) -> DataFrame:
    """The split of greatest gain for every (symbol, node); equal gains go to the first feature and the lowest bin."""
    hist = rows.select("symbol", "node", "g", "h", F.posexplode("codes").alias("feature", "bin")).groupBy("symbol", "node", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")
    )
    of_node = Window.partitionBy("symbol", "node", "feature")
    upto = of_node.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumns({**{f"{c}l": F.sum(c).over(upto) for c in "ghn"}, **{f"{c}t": F.sum(c).over(of_node) for c in "ghn"}})

    def score(g: Column, h: Column) -> Column:
        return g * g / (h + p.l2)

    gain = score(F.col("gl"), F.col("hl")) + score(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - score(F.col("gt"), F.col("ht"))
    tried = hist.withColumn("gain", F.round(gain, 9))
    tried = tried.filter((F.col("nl") >= p.least_rows) & (F.col("nt") - F.col("nl") >= p.least_rows) & (F.col("gain") > p.least_gain))
    return tried.groupBy("symbol", "node").agg(F.max_by(F.struct("feature", "bin", "gain"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("split"))


def fit_all(df: DataFrame, features: list[str], target: str, params: Boosting = Boosting(), cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """One model a symbol: symbol, status, rows, base (log odds), cuts and trees (round, tree, leaves) in order.

    ``status`` is ok, or says why a symbol has no trees: one class alone, or fewer rows than two leaves need. Rows
    without a symbol or whose target is not 0 or 1 are left out. Cuts are the symbol's quantiles, unless given for all.
    """
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    y = F.col(f"`{target}`").cast("double")
    data = df.select("symbol", x.alias("x"), y.alias("y")).filter("symbol IS NOT NULL AND y IN (0, 1)")
    shares = [i / params.bins for i in range(1, params.bins)]

    def cut(i: int) -> Column:
        if cuts is not None:
            return F.array(*[F.lit(float(c)) for c in sorted(cuts[features[i]])]).cast("array<double>")
        v = F.get("x", F.lit(i))
        quantiles = F.percentile_approx(F.when(~F.isnan(v), v), shares, 10_000)
        return F.coalesce(F.array_sort(F.array_distinct(quantiles)), F.array().cast("array<double>"))

    stats = data.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("pos"), F.array(*[cut(i) for i in range(len(features))]).alias("cuts"))
    status = F.when((F.col("pos") == 0) | (F.col("pos") == F.col("rows")), "one class").when(F.col("rows") < 2 * params.least_rows, "too few rows").otherwise("ok")
    stats = written_table(stats.select("symbol", status.alias("status"), "rows", F.when(status == "ok", F.ln(F.col("pos") / (F.col("rows") - F.col("pos")))).alias("base"), "cuts"), "boosting-symbols")
    able = stats.filter("status = 'ok'").select("symbol", "base", "cuts")
    # a symbol's rows lie together, those of a large one in several ranges: sums formed before a shuffle are then one row
    # per symbol and bin, also where a symbol has few rows of very many
    now = data.repartitionByRange("symbol", F.xxhash64("x")).join(_small(able, 64 + 8 * params.bins * len(features)), "symbol")
    now = written_table(now.select("symbol", "y", _codes(len(features)).alias("codes"), F.col("base").alias("margin")), "boosting-rows")
    chance = 1 / (1 + F.exp(-F.col("margin")))
    rounds: list[DataFrame] = []
    width = 64 + 24 * 2 ** (params.depth + 1)
    for done in range(params.rounds):
        trees = able.select("symbol", F.array().cast(f"array<{_SPLIT}>").alias("tree"))
        for level in range(params.depth):
            first, count = 2**level - 1, 2**level
            rows = _placed(now.join(_small(trees, width), "symbol"), level).select(
                "symbol", "codes", "node", (chance - F.col("y")).alias("g"), (chance * (1 - chance)).alias("h")
            )
            splits = _by_node(_best_splits(rows.filter(F.col("node") >= first), params), first, count, F.col("split"), _SPLIT)
            nothing = F.array_repeat(F.lit(None).cast(_SPLIT), count)
            trees = written_table(trees.join(splits, "symbol", "left").select("symbol", F.concat("tree", F.coalesce("values", nothing)).alias("tree")), "boosting-level")
        placed = _placed(now.join(_small(trees, width), "symbol"), params.depth)
        sums = placed.groupBy("symbol", "node").agg(F.sum(chance - F.col("y")).alias("g"), F.sum(chance * (1 - chance)).alias("h"))
        leaf = -params.rate * F.col("g") / (F.col("h") + params.l2)
        leaves = _by_node(sums, 0, 2 ** (params.depth + 1) - 1, leaf, "double").withColumnRenamed("values", "leaves")
        full = written_table(trees.join(leaves, "symbol"), "boosting-trees")
        rounds.append(full.select("symbol", F.struct(F.lit(done).alias("round"), "tree", "leaves").alias("t")))
        if done + 1 < params.rounds:
            gained = _placed(now.join(_small(full, width), "symbol"), params.depth).withColumn("margin", F.col("margin") + F.get("leaves", F.col("node")))
            now = written_table(gained.select("symbol", "y", "codes", "margin"), "boosting-rows")
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    grown = every.groupBy("symbol").agg(F.array_sort(F.collect_list("t")).alias("trees"))  # as many as there are rounds
    return stats.join(grown, "symbol", "left")


def score_all(df: DataFrame, models: DataFrame, features: list[str], depth: int) -> DataFrame:
    """The rows with status and probability of their symbol's model; without one the probability is NULL."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("symbol"), x.alias("x"))
    met = rows.join(models.select("symbol", "status", "base", "cuts", "trees"), "symbol", "left").withColumns({"codes": _codes(len(features)), "_row": F.monotonically_increasing_id()})
    # a row number between the projections: put into the lambdas below, codes would be made anew for every level of every tree
    met = met.filter("_row >= 0")

    def reached(t: Column) -> Column:
        def step(i: Column, _: Column) -> Column:
            split = F.get(t["tree"], i)
            return F.when(split.isNull(), i).otherwise(2 * i + 1 + (F.get("codes", split["feature"]) > split["bin"]).cast("int"))

        return F.get(t["leaves"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))

    margin = F.aggregate("trees", F.col("base"), lambda m, t: m + reached(t))
    return met.select("row.*", F.coalesce("status", F.lit("no model")).alias("status"), (1 / (1 + F.exp(-margin))).alias("probability"))
