"""Column expressions over whole texts, and tables cut from their lineage, shared by the operators of this folder."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import scratch_path

#: ASCII white space, the separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"
#: Rows below which a side may be sent to all executors. Beyond it the same join runs with a shuffle.
BROADCAST_ROWS = 1_000_000
_BLOCK = 256


def whole(text: Column | str) -> Column:
    """The text, or the empty text where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else, so that positions and other letters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; no words for an empty or blank text."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner != "", F.split(inner, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


_scopes: list[dict[str, SparkSession]] = []


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Tables written within are noted; the function given deletes them, but for those handed to it.

    For operators that end with a small table of their own: what led to it need not fill the shared folder.
    """
    noted: dict[str, SparkSession] = {}
    _scopes.append(noted)

    def drop_all_but(*kept: DataFrame) -> None:
        stay = {t._scratch for t in kept}
        for path, spark in noted.items():
            if path not in stay:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    try:
        yield drop_all_but
    finally:
        _scopes.remove(noted)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, without lineage, safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    for noted in _scopes:
        noted[path] = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)  # the kinds are known: no job to look for them
    table._scratch = path
    return table


def keep_if(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns as they are. Pushed below its projections, a condition would repeat their whole
    expressions wherever it names them, inside lambdas for every element; an id on each row keeps it above."""
    return df.withColumn("_stay", F.monotonically_increasing_id()).filter(condition & (F.col("_stay") >= 0)).drop("_stay")


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if the (cheap to count) side has at most BROADCAST_ROWS rows; else leave the join to Spark."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def pack(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that no name of theirs meets a name of the operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running_starts(lengths: Column) -> Column:
    """Sum of all earlier lengths for each element, through sums of blocks: no quadratic copying of long arrays."""
    n = F.size(lengths)
    sums = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")),
        lambda b: _total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))),
    )
    before = F.aggregate(
        sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )

    def start(x: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        return F.get(before, block) + _total(F.slice(lengths, block * _BLOCK + 1, i - block * _BLOCK))

    return F.when(n > 0, F.transform(lengths, start)).otherwise(F.array().cast("array<int>"))


def find_spans(
    df: DataFrame, out: str, text: str, pattern: str | Column, only_if: Column, keep: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Add ``out``: array<struct<start, end, value>> of the leftmost matches that do not overlap, in code points.

    The pieces between matches and the matches themselves give the positions. ``keep`` drops matches afterwards.
    ``only_if`` must hold for every text that has a match; others are not searched.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "_hits": F.when(only_if, F.regexp_extract_all(F.col(text), regex, F.lit(0))).otherwise(none),
        }
    )
    df = df.withColumn(
        "_gaps",
        F.when(F.size("_hits") > 0, F.transform(F.split(F.col(text), regex), lambda p: F.length(p))).otherwise(
            F.array().cast("array<int>")
        ),
    )
    df = df.withColumn("_steps", F.transform("_hits", lambda h, i: F.length(h) + F.get(F.col("_gaps"), i)))
    df = df.withColumn("_before", running_starts(F.col("_steps")))

    def span(h: Column, i: Column) -> Column:
        start = F.get(F.col("_before"), i) + F.get(F.col("_gaps"), i)
        return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("value"))

    found = F.transform("_hits", span)
    df = df.withColumn(out, found if keep is None else F.filter(found, lambda s: keep(s["value"])))
    return df.drop("_hits", "_gaps", "_steps", "_before")


def listed(spans: Column) -> Column:
    """kind:start:end, by start and then the kind's place ``k``; spans are struct<start, k, end, kind>."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def of_kind(spans: Column, kind: str, place: int) -> Column:
    """Spans in the shape that ``listed`` orders."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            s["value"].alias("value"),
        ),
    )
