import random
import re
from itertools import permutations

from orrery.llm.audit import audit_filters, failed_filters

FIELDS = "doc_id long, text string, lang string, source string, part int, digest string, n_words int"


def plain_fails(rows):
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        smaller = doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), bool(re.search("[#$%&*|]", text)), smaller)
        out.append((doc_id, lang or "", fails))
    return out


def plain_audit(rows, quality, toxic):
    """Filters applied one after another to lists of documents, in every order."""
    docs, out = plain_fails(rows), {}
    for part in {d[1] for d in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [d for d in left if d[1][k]]
                left = [d for d in left if not d[1][k]]
                every = [d for d in own if d[1][k]]
                total[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(sum(d[1]) == 1 for d in every), sum(quality.get(d[0]) == 1 for d in gone), sum(toxic.get(d[0]) == 1 for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def fixture():
    rnd = random.Random(5)
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n\x0b\x0c\r ", None), (4, "a\x1cb\x85c\xa0d", ""), (None, "a b", "en"), (None, "a b", "en"), (5, "a b", "en"), (5, "a b", "en"), (6, "a b", "de"), (6, "other", "de"), (7, "X" * 40_000 + " y" * 40_000, "en"), (8, "ÀÉ" * 50, "fr"), (9, "x $ y", "fr")]
    for i in range(10, 120):
        words = [rnd.choice(["the", "The", "THE", "é", f"w{rnd.randrange(400)}"]) for _ in range(rnd.choice([0, 5, 150, 199, 200, 201, 400]))]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(words) + rnd.choice(["", "", "#", "|"]), rnd.choice(["en", "de", None])))
    rows += [(i + 1000, t, lang) for i, t, lang in rows[20:50]]
    return rows


def test_equals_filters_applied_one_by_one(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "s", 3, "x", 9) for r in rows], FIELDS)
    labels = [(i, i % 3 == 0, i % 4 == 0) for i in range(1, 1100) if i % 2] + [(7, 1, 0), (5, None, 1), (None, 1, 1)]
    marks = spark.createDataFrame([(i, None if q is None else int(q), int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    quality = {i: max(int(q or 0) for j, q, _ in labels if j == i) for i, _, _ in labels if i is not None}
    toxic = {i: max(int(t or 0) for j, _, t in labels if j == i) for i, _, _ in labels if i is not None}
    want = plain_audit(rows, quality, toxic)
    got = {(r[0], r[1], r[2]): list(r)[3:] for r in audit_filters(docs, marks).collect()}
    assert got == want and len(got) == 600 * len({d[1] for d in plain_fails(rows)})
    masks = sorted((str(r["doc_id"]), r["part"], r["fails"]) for r in failed_filters(docs).collect())
    assert masks == sorted((str(i), p, sum(1 << k for k, f in enumerate(fs) if f)) for i, p, fs in plain_fails(rows))
    assert audit_filters(docs.limit(0), marks).count() == 0 and audit_filters(docs, marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_texts_move_once_and_no_python(spark):
    docs = spark.createDataFrame([(*r, "s", 3, "x", 9) for r in fixture()], FIELDS)
    from orrery.llm.audit import word_totals

    texts = docs.selectExpr("sha(text) AS k", "text").groupBy("k").agg({"text": "any_value"}).withColumnRenamed("any_value(text)", "text")
    plan = word_totals(texts, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
    assert plan.count("split(") == 1


def test_query_equals_sql(spark):
    from orrery.llm.queries import ORACLES, op11_audit
    from tests.oracle import compare

    assert compare(spark, "op11_audit", op11_audit, ORACLES["op11_audit"], "/root/testdata/sf0.001") is None
