"""Queries of the training-data operators, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.substrings import dedup_substrings

    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), 35)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.pieces import decode_pieces, encode_pieces, spaced

    model = vocabulary("piece_bpe_32k.model")
    coded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == spaced(F.col("text"))).alias("restored"),
    )


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.neardup import near_duplicates

    done = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 0.8, by_count=True)
    return done.select("doc_id", "class_id", "class_size", "keep")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.media import read_media, sound_features, store_media

    return read_media(store_media(table(spark, sf_dir, "documents")), sound_features).withColumn("tail_crc32", F.crc32("tail")).drop("tail")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.suffixes import dedup_suffixes

    done = dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.chat import format_conversations

    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_conversations(turns).select("conv_id", "formatted", "loss").mapInArrow(_read_back, kinds)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted", "offences")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.bpe import decode_bpe, encode_bpe

    vocab = vocabulary("word_bpe_49k.json")
    coded = encode_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab, packed=True).select("doc_id", "ids")
    coded = decode_bpe(coded, vocab)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which a tenth of the ids get words that repeat from some place on to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    repeated = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", a + (i - a) % p)))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.runs import periodic_runs

    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumns({"best": best, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))})
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of formatted conversations, from the formatted text and its loss ranges."""
    from orrery.llm.chat import parse_turns, unescape

    for batch in batches:
        rows = []
        for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
            turns = parse_turns(text)
            learned = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((conv, len(turns), sha256(whole.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest(), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_topk": op2_topk,
    "op3_substrings": op3_substrings,
    "op4_pieces": op4_pieces,
    "op5_neardup": op5_neardup,
    "op6_media": op6_media,
    "op7_suffixes": op7_suffixes,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op11_audit": op11_audit,
    "op12_bpe": op12_bpe,
    "op13_runs": op13_runs,
}

_CONTROL = r"(\\|<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]|\[/OUT\]|<\|image\|>|<\|audio\|>|<\|document\|>)"

ORACLES: dict[str, str] = {
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op3_substrings": """
WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS word FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents)),
win AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER f = 35 THEN md5(string_agg(word, ' ') OVER f) END AS h FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
twice AS (SELECT h FROM win WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
marked AS (SELECT doc_id, i, word, h IN (SELECT h FROM twice) AS again FROM win),
gone AS (SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)""",
    "op9_chat": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_replace(text, '{_CONTROL}', '\\\\\\1', 'g')) + len(regexp_replace(role, '{_CONTROL}', '\\\\\\1', 'g')) + CASE WHEN role = 'assistant' THEN 19 ELSE 21 END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op11_audit": """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
st AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
own AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS earlier FROM st),
r AS (SELECT m.*, filter_order, CAST(step AS INTEGER) AS step, own, fails[own] AS hit, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone FROM m, own),
g AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (WHERE gone AND hit), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE hit AND len(list_filter(fails, lambda z: z)) = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g""",
    "op13_runs": """
WITH b AS (SELECT doc_id, text, list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> CAST(k AS INTEGER)) & 1))),
  lambda c, k: xor(c >> 1, CASE WHEN xor(c, k) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT) AS c FROM documents),
h AS (SELECT doc_id, xor(c, 4294967295) AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS l FROM b),
a AS (SELECT *, h // 10 AS g, len(l) AS n, CASE WHEN len(l) > 0 AND h % 10 = 0 THEN (h // 10) % len(l) END AS a FROM h),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN l ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN l[i + 1] ELSE l[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS l FROM a),
w AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(l) AS word FROM d),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands GROUP BY doc_id, start, length),
steps AS (SELECT doc_id, i, sum(s) AS s FROM (SELECT doc_id, start + period AS i, 1 AS s FROM runs UNION ALL SELECT doc_id, start + length, -1 FROM runs) GROUP BY doc_id, i),
kept AS (SELECT doc_id, i, word, coalesce(sum(s) OVER (PARTITION BY doc_id ORDER BY i), 0) AS depth FROM w LEFT JOIN steps USING (doc_id, i)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM kept WHERE depth = 0 GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, arg_min(length, (-length, start, period)) AS length, arg_min(period, (-length, start, period)) AS period,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
 sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
