"""Name search over a catalogue: by designation, name, core, beginning, part and likeness, without comparing all with all.

Asked names meet distinct texts (names, cores, keys), not objects: however many
objects share a text, it is compared once, and brings only those of them that
can be among the first (`_leading`). Each rule is an equi-join: keys and cores by
value; names where one holds the asked name's rarest three letters, which finds
equal ones and beginnings too; beginnings of keys with the beginnings of the
known ones; alike cores on their rarest trigrams (a pair that agrees by
``LEAST`` shares one of all but ceil(LEAST * n) - 1 of them). Common letters so
hardly meet.

Defined results: blank and null names are asked for nothing; repeated ones
are answered once; objects without names or with null aliases are found by what they
have; of objects that share a key the least id has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import core_name, designation_key, looks_like_designation, normal_name, trigrams
from orrery.session import staged

# What each way of finding is worth.
DESIGNATION, EXACT, CORE, PREFIX, KEY_PREFIX, CONTAINS, ALIKE = 100.0, 80.0, 70.0, 50.0, 45.0, 35.0, 30.0
LEAST = 0.45


def name_index(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, keys) of objects (id, designation, name, aliases, rank): names are (id, rank, n, c), normal and core; keys (id, rank, k)."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    rank = F.coalesce(F.col("rank").cast("double"), F.lit(0.0)).alias("rank")
    written = objects.select("id", rank, F.explode(F.concat(F.array("name", "designation"), aliases)).alias("written")).filter("written <> ''")
    names = written.select("id", "rank", normal_name(F.col("written")).alias("n"), core_name(F.col("written")).alias("c")).filter("n <> ''").groupBy("id", "rank", "n").agg(F.min("c").alias("c"))
    called = objects.select("id", rank, F.explode(F.concat(F.array("designation"), aliases)).alias("written")).filter(looks_like_designation(F.col("written")))
    return staged(names, "names"), staged(called.select("id", "rank", designation_key(F.col("written")).alias("k")).distinct(), "name-keys")


def _rarest(lists: DataFrame, own: str, grams: DataFrame, keep: Column) -> DataFrame:
    """(own, gram): the ``keep`` (of size ``n``) rarest grams of each ``own``, of all of them as t."""
    counted = lists.select(own, F.explode("t").alias("gram")).join(grams, "gram", "left")
    ranked = counted.groupBy(own).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram"))).alias("r")).withColumn("n", F.size("r"))
    return ranked.select(own, F.explode(F.slice("r", F.lit(1), keep)).alias("g")).select(own, "g.gram")


def _leading(held: DataFrame, text: str, hits: DataFrame, limit: int) -> DataFrame:
    """``hits`` (asked, text, score, how) by object: those of a text's objects (id, rank, text) that can be among the first ``limit``.

    All objects of a text get its score, so ``limit`` of them that go before
    another keep it out. Ranks so near that their sums with a score may be equal
    count as equal. A window over one rank is reduced before its shuffle.
    """
    some = held.join(hits.select(text).distinct(), text, "left_semi").select(text, "id", "rank").distinct()
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy(text, "rank").orderBy("id"))).filter(F.col("_n") <= limit)
    order = Window.partitionBy(text).orderBy(F.desc("rank"), "id")
    last = F.nth_value("rank", limit).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    some = some.withColumns({"_n": F.row_number().over(order), "_last": last})
    near = F.col("rank") > F.col("_last") - 1e-12 * (100 + F.abs("_last"))
    return hits.join(some.filter(F.col("_last").isNull() | (F.col("_n") <= limit) | near), text).select("asked", "id", "rank", "score", "how")


def name_search(asked: DataFrame, objects: DataFrame, *, asked_col: str = "asked", limit: int = 20) -> DataFrame:
    """(asked, place, id, score, how): the ``limit`` best objects of each asked name.

    ``objects`` has id (unique), designation, name, aliases (array) and rank, which is
    added to the score of its best way of being found; ties go to the least id.
    """
    names, keys = name_index(objects)
    text = F.trim(F.col(asked_col))
    q = asked.select(text.alias("asked")).filter("asked <> ''").distinct()
    q = staged(q.select("asked", normal_name(F.col("asked")).alias("q"), core_name(F.col("asked")).alias("core"), F.when(looks_like_designation(F.col("asked")), designation_key(F.col("asked"))).alias("key")), "asked")
    texts = staged(names.select("n").distinct(), "name-texts")
    cores = staged(names.select("c").filter("c <> ''").distinct(), "name-cores")

    # names: by their rarest three letters; asked names of one or two letters by the beginning, or, if of three bytes or more, by all letters
    parts = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3))))
    held = texts.filter(F.length("n") >= 3).select("n", F.explode(parts("n")).alias("gram"))
    anchor = _rarest(q.filter(F.length("q") >= 3).select("q", parts("q").alias("t")).distinct(), "q", held.groupBy("gram").agg(F.count("*").alias("names")), F.lit(1))
    inner = anchor.join(held, "gram").filter(F.contains("n", "q")).select("q", "n")
    short = q.filter(F.length("q").between(1, 2)).select("q").distinct()
    first = texts.select("n", F.explode(F.array_distinct(F.array(F.substring("n", 1, 1), F.substring("n", 1, 2)))).alias("q"))
    letters = texts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("n")), lambda i: F.array(F.substring(F.col("n"), i, F.lit(1)), F.substring(F.col("n"), i, F.lit(2))))).alias("two")).select("n", F.explode("two").alias("q"))
    inner = inner.unionByName(short.join(first, "q").select("q", "n")).unionByName(short.filter(F.octet_length("q") >= 3).join(letters, "q").select("q", "n")).distinct()
    way = F.when(F.col("q") == F.col("n"), F.struct(F.lit(EXACT).alias("score"), F.lit("name").alias("how"))).when(F.startswith("n", "q"), F.struct(F.lit(PREFIX).alias("score"), F.lit("prefix").alias("how"))).otherwise(F.struct(F.lit(CONTAINS).alias("score"), F.lit("contains").alias("how")))
    by_name = staged(q.select("asked", "q").join(inner, "q").select("asked", "n", way.alias("way")).select("asked", "n", "way.score", "way.how"), "names-met")

    # cores: equal ones, and alike ones
    listed = cores.select("c", trigrams(F.col("c")).alias("t"))
    common = listed.select(F.explode("t").alias("gram")).groupBy("gram").agg(F.count("*").alias("names"))
    common = staged(common, "name-grams")
    some = F.col("n") - F.ceil(LEAST * F.col("n") - 1e-9).cast("int") + 1
    mine = _rarest(q.filter(F.octet_length("core") >= 4).select("core", trigrams(F.col("core")).alias("t")).distinct(), "core", common, some)
    alike = mine.join(_rarest(listed, "c", common, some), "gram").select("core", "c").distinct().withColumns({"t": trigrams(F.col("core")), "u": trigrams(F.col("c"))})
    both = F.size(F.array_intersect("t", "u"))
    alike = alike.withColumn("likeness", both / (F.size("t") + F.size("u") - both)).filter(F.col("likeness") >= LEAST).select("core", "c", "likeness")
    same = q.filter("core <> ''").join(cores, F.col("core") == F.col("c")).select("asked", "c", F.lit(CORE).alias("score"), F.lit("name").alias("how"))
    by_core = staged(same.unionByName(q.join(alike, "core").select("asked", "c", (ALIKE * F.col("likeness")).alias("score"), F.lit("similar").alias("how"))), "cores-met")

    # designations: equal keys, and beginnings
    owned = q.select("asked", "key").join(keys, F.col("key") == F.col("k")).groupBy("asked").agg(F.min("id").alias("id"), F.min_by("rank", "id").alias("rank"))
    owned = owned.select("asked", "id", "rank", F.lit(DESIGNATION).alias("score"), F.lit("designation").alias("how"))
    begins = keys.select("k").filter(F.length("k") >= 2).distinct().select("k", F.explode(F.sequence(F.lit(2), F.length("k"))).alias("i")).select("k", F.substring(F.col("k"), F.lit(1), F.col("i")).alias("begin"))
    whole = q.select("asked", F.upper(F.replace("q", F.lit(" "), F.lit(""))).alias("_short")).filter(F.octet_length("_short") >= 2)
    by_key = staged(whole.join(begins, F.col("_short") == F.col("begin")).select("asked", "k", F.lit(KEY_PREFIX).alias("score"), F.lit("prefix").alias("how")), "keys-met")

    every = owned.unionByName(_leading(names, "n", by_name, limit)).unionByName(_leading(names, "c", by_core, limit)).unionByName(_leading(keys, "k", by_key, limit))
    best = every.groupBy("asked", "id").agg(F.max_by("how", "score").alias("how"), (F.max("score") + F.max("rank")).alias("score"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("asked", "place", "id", "score", "how")
