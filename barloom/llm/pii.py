"""Personal data and the terms that give it away: pattern spans, and corpus co-occurrence of words with each value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import (
    SPACE_RUN,
    SPACES,
    ascii_lower,
    find_spans,
    keep_if,
    listed,
    of_kind,
    pack,
    small_side,
    whole,
    written,
)

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Possessive runs and the looks behind only spare vain starts inside a run; a
# start is also allowed where the match before it ended (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What stands for a span in a sanitised text.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "reveals": ""}
EDGE = ".,;:!?()\"'"


@dataclass(frozen=True)
class Disclosure:
    """When a term reveals a value. Information is -log2 of the share of documents.

    A term near a value (``reach`` code points) is generalised if PMI(term, value) >= information(value) / alpha, and
    removed if PMI >= information(value) / removal: there the term stands only beside the value. It must have been
    seen in ``contexts`` different surroundings, so that copies of one text are not evidence.
    """

    reach: int = 80
    alpha: float = 1.5
    removal: float = 1.0
    contexts: int = 3


DISCLOSURE = Disclosure()


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    parts = F.transform(F.split(value, "\\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _luhn(value: Column) -> Column:
    figures = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add the array column of every kind; ``text`` must not be null."""
    df = df.withColumn("_digit", F.col(text).rlike("[0-9]"))
    digit = F.col("_digit")
    df = find_spans(df, "email", text, EMAIL, F.col(text).contains("@"))
    df = find_spans(df, "ip", text, IP, digit, _octets)
    df = find_spans(df, "card", text, CARD, digit, _luhn)
    df = find_spans(df, "phone", text, PHONE, digit & F.col(text).contains("+"), _phone)
    return df.drop("_digit")


def _merged(kinds: tuple[str, ...]) -> Column:
    return F.array_sort(F.concat(*[of_kind(F.col(k), k, i) for i, k in enumerate(kinds)]))


def found(docs: DataFrame, text: str = "text", carry: tuple[str, ...] | None = None, only_spans: bool = False) -> DataFrame:
    """One written row per document (or per document with spans): rid, row, base (ordered spans), n_* and the text where
    a span was found."""
    packed = pack(docs).withColumn("_t", whole(F.col("row")[text]))
    if carry is not None:
        packed = packed.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carry]))
    spans = base_spans(packed, "_t")
    spans = spans.withColumn("base", _merged(KINDS))
    if only_spans:
        spans = keep_if(spans, F.size("base") > 0)
    kept = F.when(F.size("base") > 0, F.col("_t"))
    return written(
        spans.select(
            F.monotonically_increasing_id().alias("rid"), "row", "base", kept.alias("_t"),
            *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        ),
        "pii-base",
    )


def _tokens(context: Column) -> Column:
    """Lower-cased words of at least four letters, without the punctuation around them."""
    bare = F.transform(F.split(ascii_lower(context), SPACE_RUN), lambda w: F.btrim(w, F.lit(EDGE)))
    return F.array_distinct(F.filter(bare, lambda w: w.rlike("^\\p{L}{4,}$")))


def mentions(base: DataFrame, rule: Disclosure = DISCLOSURE) -> DataFrame:
    """rid, entity, context: one row per span, with the whole words within reach on both sides of it."""
    one = base.select("rid", "_t", F.explode("base").alias("s"))
    start, end, n = F.col("s.start"), F.col("s.end"), F.length("_t")
    first = F.greatest(F.lit(0), start - rule.reach)
    left = F.substring(F.col("_t"), first + 1, start - first)
    right = F.substring(F.col("_t"), end + 1, F.lit(rule.reach))
    # words cut by the reach or grown together with the value are no words
    left = F.when(first > 0, F.regexp_replace(left, "^[^ \\t-\\r]+", "")).otherwise(left)
    left = F.regexp_replace(left, "[^ \\t-\\r]+$", "")
    right = F.when(end + rule.reach < n, F.regexp_replace(right, "[^ \\t-\\r]+$", "")).otherwise(right)
    right = F.regexp_replace(right, "^[^ \\t-\\r]+", "")
    value = F.when(F.col("s.kind") == "email", F.lower("s.value")).when(F.col("s.kind") == "ip", F.col("s.value")).otherwise(_digits(F.col("s.value")))
    return one.select("rid", F.concat_ws(":", "s.kind", value).alias("entity"), F.concat_ws(" ", left, right).alias("context"))


def disclosing_terms(base: DataFrame, docs: DataFrame, text: str = "text", rule: Disclosure = DISCLOSURE) -> DataFrame:
    """entity, term, strength: PMI(term, entity) / information(entity), where at least 1 / alpha.

    Co-occurrence is counted over all mentions, document frequency over all words of all documents. All sums are
    map-side first. A value in every document has no
    information and reveals nothing.
    """
    seen = written(mentions(base, rule), "pii-mentions")
    near = seen.select("rid", "entity", F.xxhash64("context").alias("ctx"), F.explode(_tokens(F.col("context"))).alias("term"))
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("rid").alias("together"), F.count_distinct("ctx").alias("contexts"))
    pairs = pairs.filter(F.col("contexts") >= rule.contexts)
    pairs = written(pairs, "pii-pairs")
    terms = written(pairs.select("term").distinct(), "pii-terms")
    # document frequency of every word, summed map-side; only the counts meet the terms
    bare = F.transform(F.split(ascii_lower(whole(text)), SPACE_RUN), lambda w: F.btrim(w, F.lit(EDGE)))
    each = docs.select(F.explode(F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 4))).alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("term_docs")).join(small_side(terms), "term")
    entities = seen.groupBy("entity", "rid").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs"))
    total = F.lit(docs.count()).cast("double")
    scored = pairs.join(df, "term").join(entities, "entity")
    information = F.log2(total / F.col("entity_docs"))
    pmi = F.log2(total * F.col("together") / (F.col("term_docs") * F.col("entity_docs")))
    scored = scored.withColumn("strength", F.when(information > 0, pmi / information))
    return scored.filter(F.col("strength") * rule.alpha >= 1).select("entity", "term", "strength")


def _with_terms(base: DataFrame, docs: DataFrame, text: str, rule: Disclosure) -> DataFrame:
    """Base rows with ``terms`` (generalise) and ``reveals`` (remove) spans, in documents that hold the value."""
    strong = disclosing_terms(base, docs, text, rule)
    seen = mentions(base, rule).select("rid", "entity").distinct()
    per_doc = seen.join(strong, "entity").groupBy("rid").agg(
        F.collect_set(F.when(F.col("strength") * rule.removal < 1, F.col("term"))).alias("_general"),
        F.collect_set(F.when(F.col("strength") * rule.removal >= 1, F.col("term"))).alias("_remove"),
    )
    none = F.array().cast("array<string>")
    some = base.filter(F.size("base") > 0).join(per_doc, "rid", "left")
    some = some.withColumns({"_remove": F.coalesce("_remove", none), "_low": ascii_lower(F.col("_t"))})
    some = some.withColumn("_general", F.array_except(F.coalesce("_general", none), F.col("_remove")))
    for out, terms in (("term", "_general"), ("reveals", "_remove")):
        # terms are letters only; longer ones first does not matter, since a whole word must match
        pattern = F.concat(F.lit(f"(?<=^|[ \\t-\\r{EDGE}])(?:"), F.array_join(terms, "|"), F.lit(f")(?=[ \\t-\\r{EDGE}]|$)"))
        some = find_spans(some, out, "_low", pattern, F.size(terms) > 0)
    k = len(KINDS)
    more = F.concat(of_kind(F.col("term"), "term", k), of_kind(F.col("reveals"), "term", k))
    removed = of_kind(F.col("reveals"), "reveals", k + 1)
    clear = F.filter(more, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    removed = F.filter(removed, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    general = F.filter(of_kind(F.col("term"), "term", k), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    some = some.withColumns({"spans": F.array_sort(F.concat("base", clear)), "cuts": F.array_sort(F.concat("base", general, removed))})
    rest = base.filter(F.size("base") == 0).withColumns({"spans": F.col("base"), "cuts": F.col("base")})
    columns = ["row", "_t", "base", "spans", "cuts", *[f"n_{k}" for k in KINDS]]
    return some.select(columns).unionByName(rest.select(columns))


def private_spans(docs: DataFrame, text: str = "text", carry: tuple[str, ...] | None = None, rule: Disclosure = DISCLOSURE) -> DataFrame:
    """Per row of ``docs``: row, base and spans (struct<start, k, end, kind, value>), n_email, n_ip, n_card, n_phone.

    Null texts are empty ones and have no spans; equal rows each keep their own; kinds may overlap. Terms never touch
    a base span.
    """
    return _with_terms(found(docs, text, carry), docs, text, rule)


def sanitised(docs: DataFrame, text: str = "text", rule: Disclosure = DISCLOSURE) -> DataFrame:
    """The documents with every span replaced by its label, or cut out where a term only stands beside the value.

    Overlapping spans are replaced once, by the label of the first. Null texts stay null; n_chars, where there is such
    a column, follows the new text.
    """
    spans = _with_terms(found(docs, text, only_spans=True), docs, text, rule)
    cuts = F.col("cuts")
    # spans that begin inside an earlier one join it: keep the furthest end so far
    joined = F.aggregate(
        cuts,
        F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] < F.get(a, F.size(a) - 1)["end"]),
            F.concat(
                F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)),
                F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end"), F.get(a, F.size(a) - 1)["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
    )
    spans = spans.withColumn("_cuts", joined)
    c, t = F.col("_cuts"), F.col("_t")
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    pieces = F.transform(
        c,
        lambda s, i: F.concat(
            F.substring(t, F.coalesce(F.get(c, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(c, i - 1)["end"], F.lit(0))),
            F.element_at(label, s["kind"]),
        ),
    )
    tail = F.substring(t, F.get(c, F.size(c) - 1)["end"] + 1, F.length(t))
    clean = F.when(F.col("row")[text].isNull(), F.lit(None).cast("string")).when(F.size(c) == 0, t).otherwise(F.concat(F.array_join(pieces, ""), tail))
    spans = spans.withColumn("_clean", clean)
    out = []
    for name in docs.columns:
        if name == text:
            out.append(F.col("_clean").alias(name))
        elif name == "n_chars":
            out.append(F.when(F.col("row")[text].isNull(), F.col("row")[name]).otherwise(F.length("_clean")).cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(F.col("row")[name].alias(name))
    # texts without a span go through as they are; finding them again costs less than a copy of all texts
    plain = base_spans(pack(docs).withColumn("_t", whole(F.col("row")[text])), "_t")
    plain = keep_if(plain, F.size(F.concat(*KINDS)) == 0).select("row.*")
    return spans.select(*out).unionByName(plain)
