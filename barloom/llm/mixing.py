"""Mixing sources to target weights: each source's budget is met by a subset sum over the lengths of its documents.

Documents are counted by source and exact length. Whole passes over a source come first; of what is left of the budget,
every length gives the same share of its documents, and a bounded-knapsack program over the lengths fits the last words.
So a plan says how many documents of each length are taken, and a seeded hash says which.
"""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.text import whole, words, written
from barloom.operators.order_stats import with_row_number

#: Weights of the sources in their order, repeating; the share of all words that the mix takes; passes over a source.
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST_PASSES = 2
#: Words of a budget that are left to the knapsack program. Its table has two entries for each of them.
EXACT_WORDS = 1 << 15
#: Documents of one source and length that are ranked together; more are dealt into parts by their hash.
RANKED_TOGETHER = 2_000
#: Rows of a plan that may be broadcast: 32 bytes each beside the source, which is counted too.
BROADCAST_BYTES = 64 << 20
_HASH_STEPS = 1 << 40


def closest_sum(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as close to the budget as any sum is; the smaller of two equally close.

    Reachable sums are bits of one number. Each length shifts it by 1, 2, 4, ... copies, and sums that appear are noted
    with the length that made them, from which the counts are read backwards.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    limit = 2 * budget  # a sum above it is farther from the budget than nothing at all
    mask = (1 << (limit + 1)) - 1
    made_by = np.full(limit + 1, -1, np.int32)
    reach = 1
    for i, (length, count) in enumerate(zip(lengths, counts)):
        most = min(count, limit // length) if length > 0 else 0
        if not most:
            continue
        grown, step = reach, 1
        while most > 0:
            use = min(step, most)
            grown |= (grown << (use * length)) & mask
            most -= use
            step *= 2
        fresh = grown & ~reach
        if fresh:
            bits = np.unpackbits(np.frombuffer(fresh.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
            made_by[np.flatnonzero(bits[: limit + 1])] = i
        reach = grown
        if reach >> budget & 1:
            break
    made_by[0] = -1
    sums = np.flatnonzero(made_by >= 0)
    best = 0
    if len(sums):
        away = np.abs(sums - budget)
        near = int(sums[away.argmin()])
        best = near if abs(near - budget) < budget else 0
    while best > 0:
        i = int(made_by[best])
        used = 1
        while best - used * lengths[i] > 0 and made_by[best - used * lengths[i]] == i:
            used += 1
        taken[i] = used
        best -= used * lengths[i]
    return taken


def take_counts(lengths: list[int], counts: list[int], budget: int, exact_words: int = EXACT_WORDS, seed: int = 0) -> list[int]:
    """Documents to take of each length (ascending) for one source.

    But for ``exact_words``, the budget goes to all lengths alike: what the share of a length leaves over as a part of a
    document is passed on to the next length. `closest_sum` fits the rest, trying the lengths in a seeded order, so that
    it favours neither short nor long ones.
    """
    taken = [0] * len(lengths)
    total = sum(length * count for length, count in zip(lengths, counts))
    given = 0
    if budget > exact_words and total:
        share, due = Fraction(budget - exact_words, total), Fraction(0)
        for i, (length, count) in enumerate(zip(lengths, counts)):
            if length > 0:
                due += length * count * share
                taken[i] = min(count, int((due - given) // length))
                given += taken[i] * length
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    rest = closest_sum([lengths[i] for i in order], [counts[i] - taken[i] for i in order], budget - given)
    for i, more in zip(order, rest):
        taken[i] += more
    return taken


def _targets(sources: DataFrame) -> DataFrame:
    """With ``target``: SHARE of all words dealt by weight, at most MOST_PASSES times a source's own.

    What sources above their limit leave goes to the others by weight, until none is above. A round is one sum over the
    sources; the driver sees the words that are fixed and the weights that still share.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not weights:
        return sources.withColumn("target", F.lit(0.0))
    cap = F.col("source_size") * MOST_PASSES
    fixed, sharing = 0, weights
    while sharing:
        level = (SHARE * total - fixed) / sharing
        # in whole numbers, so that equality is exact: cap <= weight * level
        over = (cap.cast("decimal(38,0)") * level.denominator <= F.col("weight") * F.lit(str(level.numerator)).cast("decimal(38,0)"))
        now = sources.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if (now[0], now[1]) == (fixed, sharing):
            break
        fixed, sharing = now[0], now[1]
    if not sharing:
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def _sized(df: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size and a hash of each document: all that is needed of the texts, read once."""
    text = whole("text")
    return written(
        df.select(
            "doc_id", F.col("source").isNull().alias("nameless"), whole("source").alias("named"),
            F.size(words(text)).cast("long").alias("size"),
            F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), text), F.lit(_HASH_STEPS)).alias("h"),
        ),
        "sized",
    )


_SOURCE = ["nameless", "named"]
_PLAN = "nameless boolean, named string, size long, n long, passes long, more long, source_size long, target double"


def _plan(histogram: DataFrame, sources: DataFrame, exact_words: int, seed: int) -> DataFrame:
    """Per source and length: passes over all documents, and how many of them are taken once more."""

    def fitted(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("size").to_pydict()
        target, source_size = rows["target"][0], rows["source_size"][0]
        goal = round(target)
        passes = min(MOST_PASSES, goal // source_size) if source_size else 0
        rest = goal - passes * source_size if passes < MOST_PASSES else 0
        more = take_counts(rows["size"], rows["n"], rest, exact_words, seed)
        columns = {c: rows[c] for c in (*_SOURCE, "size", "n")} | {"passes": [passes] * len(more), "more": more, "source_size": rows["source_size"], "target": rows["target"]}
        kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(columns.items(), kinds)})

    joined = histogram.join(sources.select(*_SOURCE, "source_size", "target"), _SOURCE)
    return written(joined.groupBy(*_SOURCE).applyInArrow(fitted, _PLAN), "mix-plan")


def mixed(df: DataFrame, seed: int = 13, exact_words: int = EXACT_WORDS) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document.

    A null or empty text has no words, and nothing is taken of it; a source without words has the target 0. Sources are
    ordered by code point, the null source last, and the empty name is a source of its own. Repeated rows and null ids
    are documents of their own; which of several equal rows is taken makes no difference to the result. An empty table
    gives no rows, and no other column is read. Source sizes are exact; a source misses its target by less than a word
    wherever its lengths can be summed up to it, else by as little as the knapsack allows. The program's memory depends
    on ``exact_words`` and on the longest document, not on the number of documents.
    """
    sized = _sized(df, seed)
    histogram = written(sized.groupBy(*_SOURCE, "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = histogram.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    numbered = with_row_number(sources.withColumn("order", F.concat(F.when(F.col("nameless"), "1").otherwise("0"), "named")), "order", "named", "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    targets = _targets(written(numbered.withColumn("weight", weight.cast("long")), "sources"))
    plan = _plan(histogram, targets, exact_words, seed)
    width = plan.agg(F.sum(F.length("named") + 64)).first()[0] or 0
    planned = sized.join(F.broadcast(plan) if width <= BROADCAST_BYTES else plan, [*_SOURCE, "size"])

    # a group's documents with the smallest hashes are taken; ranges of the hash part a large group, so none is ranked whole
    parts = F.ceil(F.col("n") / RANKED_TOGETHER)
    planned = planned.withColumn("part", F.floor(F.col("h") * parts / _HASH_STEPS))
    group = [*_SOURCE, "size", "part"]
    open_ = F.col("more").between(1, F.col("n") - 1)
    ranked = planned.filter(open_).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("h", "doc_id")))
    # ranks go on from part to part: counts of the parts of large groups alone
    of_parts = planned.filter(open_ & (F.col("n") > RANKED_TOGETHER)).groupBy(*group).agg(F.count(F.lit(1)).alias("in_part"))
    earlier = Window.partitionBy(*_SOURCE, "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = of_parts.withColumn("before", F.coalesce(F.sum("in_part").over(earlier), F.lit(0))).drop("in_part")
    ranked = ranked.join(before, group, "left").withColumn("extra", (F.col("rank") + F.coalesce("before", F.lit(0)) <= F.col("more")).cast("long"))
    settled = planned.filter(~open_).withColumn("extra", (F.col("more") > 0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("extra"))).alias("taken")]
    return ranked.select(*columns).unionByName(settled.select(*columns))
