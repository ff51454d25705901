"""Filter interaction audit: what each filter removes under every order of applying them.

Method: a relational word pipeline, in DataFrame operations only. Words are
exploded and aggregated by (document, word), then by document for totals and
distinct words. The other flags are outer-joined to them, so that every document
has a mask of the filters that it fails; 32 conditional counts per part (for
all, good and toxic documents each) then say all that any order of five filters
can remove, and the orders are read off those counts.

Texts that are equal have equal words. So the document of the word pipeline is a
distinct text, known by its SHA-256: copies are combined before the shuffle, and
doc ids may repeat. Each text moves once, to where its digest belongs; both word
aggregations happen there. Document rows take part without their texts.

Defined results: a null text counts as an empty one, which has no words and so
fails A alone (and E where it repeats); a null part counts as the empty string;
a null doc id is no smaller than any other, and fails E never; repeated rows
count each on their own, and a document of the same id is no smaller one; labels
that repeat count once, with their greatest value, and documents without a label
(or with a null one) are neither good nor toxic; long texts are split in one row
and exploded as a stream; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import staged

#: What stands between words.
GAPS = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def word_totals(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """n_words and n_distinct by ``key``, which is unique; keys without words have no row.

    No row moves where ``texts`` are already partitioned by ``key``.
    """
    # explode_outer: for explode, the optimizer would split the text a second time to filter empty arrays
    words = texts.select(key, F.explode_outer(F.split(text_col, GAPS)).alias("word")).filter("word <> ''")
    each = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failed_filters(docs: DataFrame, *, min_words: int = 200, min_distinct: int = 50, max_capitals: int = 3, marks: str = "[#$%&*|]", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, part, n_words, n_distinct and ``fails``.

    ``fails`` has bit 0 (A) for under ``min_words`` words, bit 1 (B) for under
    ``min_distinct`` percent distinct ones, bit 2 (C) for over ``max_capitals``
    percent of code points A-Z, bit 3 (D) for any of ``marks`` and bit 4 (E) for
    a text that a smaller doc id has too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    flags = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        digest.alias("digest"),
        (100 * capitals.cast("long") > max_capitals * F.length(text).cast("long")).alias("capitals"),
        text.rlike(marks).alias("marked"),
    )
    flags = staged(flags, "audit-flags")
    distinct = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.any_value("text").alias("text"))
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("first"))
    # one row a text, without it: a hot text's documents are then met by a plain join, which AQE can split
    known = staged(first.join(word_totals(distinct, "digest"), "digest", "left"), "audit-texts")
    n, d = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [n < min_words, 100 * d < min_distinct * n, F.col("capitals"), F.col("marked"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return flags.join(known, "digest").select("doc_id", "part", n.alias("n_words"), d.alias("n_distinct"), mask.alias("fails"))


def mask_counts(failed: DataFrame, letters: str = FILTERS, kinds: dict[str, Column] | None = None) -> DataFrame:
    """By part, for each kind of document, how many fail just the filters of each mask.

    ``kinds`` names conditions; for each there are 2 ** len(letters) conditional
    counts, as an array by mask.
    """
    kinds = kinds or {"every": F.lit(True)}
    masks = range(1 << len(letters))
    counted = failed.groupBy("part").agg(*(F.count_if(rule & (F.col("fails") == m)).alias(f"{kind}_{m}") for kind, rule in kinds.items() for m in masks))
    return counted.select("part", *(F.array(*(f"{kind}_{m}" for m in masks)).alias(kind) for kind in kinds))


def every_order(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order of filters and step, from ``mask_counts`` of every, good and toxic."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    rows = counts.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    place = F.col("step")
    before = sum((F.when(F.instr("filter_order", c).between(1, place - 1), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    own = sum((F.when(F.instr("filter_order", c) == place, 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    rows = rows.withColumns({"before": before, "own": own})
    masks = F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))

    def total(kind: str, rule, weight=lambda m: F.lit(1)) -> Column:
        """Of the kind's documents, those whose mask fits the rule, by weight."""
        return F.aggregate(masks, F.lit(0).cast("long"), lambda n, m: n + F.when(rule(m), F.element_at(kind, m + 1) * weight(m)).otherwise(F.lit(0)))

    has = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: has(m) & ~gone(m)
    # each of k failed filters comes first in one of k orders
    share = lambda m: (F.lit(factorial(len(letters))) / F.bit_count(m)).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("every", lambda m: ~gone(m) & ~has(m)).alias("kept"),
        total("every", here).alias("removed"),
        total("every", lambda m: has(m) & gone(m)).alias("redundant"),
        total("every", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("every", has, share).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **limits) -> DataFrame:
    """The audit of the five filters over all orders; ``limits`` as in ``failed_filters``.

    Columns: part, filter_order, step, kept (after the step), removed (by it),
    redundant (fail its filter, but are gone already), unique_fails (fail its
    filter alone), good_lost and toxic_lost (removed, of labels quality and
    toxic 1) and shapley (its filter's removed over all orders).
    """
    marks = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    failed = failed_filters(docs, id_col=id_col, text_col=text_col, part_col=part_col, **limits).join(marks, "doc_id", "left")
    kinds = {"every": F.lit(True), **{k: F.coalesce(F.col(k), F.lit(False)) for k in ("good", "toxic")}}
    return every_order(mask_counts(failed, FILTERS, kinds))
