"""Document rules and host verdicts: rule failures summed by host, shrunk by an empirical beta prior, joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import SPACES, keep_if, pack, small_side, whole, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is refused when its shrunk share of documents that fail one rule, or the base rules together, reaches this.
HOST_LIMIT = 0.8
#: Bounds of the prior's weight in documents; equal rates at all hosts would make it infinite.
PRIOR_WEIGHT = (2.0, 1e6)
RULES = ("short", "repeats", "symbols", "dup_lines")
#: What hosts are judged by; short and repeats are counted together, as either of them fails a document.
JUDGED = ("base_failed", "symbols", "dup_lines")


def _repeat_words(n: Column, grams: Column) -> Column:
    """Words in windows found at least twice: sorted window hashes give the starts, gaps of the starts the cover."""
    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(ordered)


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) to each row.

    A null or blank text has no words, and 0 for all counts but n_symbols. Equal rows keep their rows. Windows are
    compared by 64-bit hashes within one text.
    """
    packed = pack(docs).withColumn("_t", whole(F.col("row")[text]))
    packed = packed.withColumns(
        {
            "_w": words(F.col("_t")),
            "_lines": F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
            "word_chars": F.length(F.translate("_t", SPACES, "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        }
    ).drop("_t")
    packed = packed.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_grams": F.when(
                F.size("_w") > WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("_w", "_lines")
    packed = packed.withColumn("_s", _repeat_words(F.col("n_words"), F.col("_grams"))).drop("_grams")
    s = F.col("_s")
    starts = F.array_sort(
        F.transform(
            F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"]
        )
    )
    packed = packed.withColumn("_p", starts).drop("_s")
    p = F.col("_p")
    cover = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    return packed.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def failures(counts: DataFrame) -> DataFrame:
    """Add base_failed and one boolean per rule."""
    n = F.col("n_words")
    short, repeats = n < MIN_WORDS, F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT
    return counts.withColumns(
        {
            "base_failed": short | repeats,
            "short": short,
            "repeats": repeats,
            "symbols": F.col("n_symbols") * 10 > n,
            "dup_lines": F.col("n_dup_lines") * 10 > n,
        }
    )


def _prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Mean m and weight s of Beta(m*s, (1-m)*s) by the method of moments; no host at all gives a mean of 0."""
    mean = mean or 0.0
    weight = mean * (1 - mean) / variance - 1 if variance else PRIOR_WEIGHT[1]
    return mean, min(PRIOR_WEIGHT[1], max(PRIOR_WEIGHT[0], weight))


def host_verdicts(failed: DataFrame, host: str = "host") -> DataFrame:
    """Per host: docs, failed_<rule> of every rule, rate_<judged> (shrunk), host_rate, host_refused.

    Each of JUDGED has a prior of its own: Beta(m*s, (1-m)*s), m the mean of the hosts' rates, s from their variance
    (method of moments). ``host_rate`` is the largest of the shrunk rates; the host is refused where it reaches
    HOST_LIMIT. Rows without a host form one host of their own (null). One host alone is shrunk towards itself.
    """
    counted = dict.fromkeys((*JUDGED, *RULES))
    hosts = failed.groupBy(host).agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(F.col(r).cast("long")).alias(f"failed_{r}") for r in counted]
    )
    hosts = written(hosts, "hosts")
    rates = {r: F.col(f"failed_{r}") / F.col("docs") for r in JUDGED}
    moments = hosts.agg(*[f(rate).alias(f"{r}_{f.__name__}") for r, rate in rates.items() for f in (F.avg, F.var_pop)]).first()
    for r in JUDGED:
        mean, weight = _prior(moments[f"{r}_avg"], moments[f"{r}_var_pop"])
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"failed_{r}") + F.lit(mean * weight)) / (F.col("docs") + F.lit(weight)))
    hosts = hosts.withColumn("host_rate", F.greatest(*[f"rate_{r}" for r in JUDGED]))
    return hosts.withColumn("host_refused", F.col("host_rate") >= HOST_LIMIT)


def judged(docs: DataFrame, text: str = "text", host: str = "source", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Counts, rule failures, the host's rate and ``kept`` for every row, beside the packed ``row``.

    ``carry`` names the columns of a row that are kept (all by default). The counts are written once; sums by host
    are map-side first, so a host with a third of the rows costs one row per task.
    """
    failed = failures(rule_counts(docs, text)).withColumn("host", F.col("row")[host])
    if carry is not None:
        failed = failed.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carry]))
    failed = written(failed, "rule-counts")
    verdicts = host_verdicts(failed).select("host", "host_rate", "host_refused")
    joined = failed.join(small_side(verdicts), failed["host"].eqNullSafe(verdicts["host"]), "left").drop("host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_refused", F.lit(False)))


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that neither a rule nor their host's verdict rejects, with their own columns.

    The rules run twice, once to sum them by host and once to choose: cheaper than a second copy of all texts.
    """
    failed = failures(rule_counts(docs, text)).withColumn("host", F.col("row")[host])
    refused = host_verdicts(failed).filter("host_refused").select(F.col("host").alias("refused"))
    kept = keep_if(failed, ~F.col("base_failed")).select("row", "host")
    return kept.join(small_side(refused), kept["host"].eqNullSafe(refused["refused"]), "left_anti").select("row.*")
