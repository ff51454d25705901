import random
import re

import pytest

import duckdb

from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators.names import _leading, name_search
from orrery.plans import ORACLES, QUERIES


def told(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(df["x"])).collect()]


def test_designations(spark):
    want = {
        "M31": "M 31", "m 031": "M 31", "Messier 42": "M 42", "NGC1313": "NGC 1313", "ngc 0281": "NGC 281", "IC 1318B": "IC 1318B", "SH2-129": "Sh2-129", "Sh 2-155": "Sh2-155", "sharpless 101": "Sh2-101",
        "Sharpless 2-216": "Sh2-216", "Sh2 216": "Sh2-216", "gum 3": "Gum 3", "B33": "B 33", "Barnard 72A": "B 72a", "vdB 1": "vdB 1", "van den bergh 1": "vdB 1", "C 014": "C 14", "Caldwell 49": "C 49", "LDN1235": "LDN 1235",
        "A 85": "Abell 85", "HCG 92": "HCG 92", "Arp 273": "Arp 273", "G116.9+0.2": "G116.9+00.2", "SNR G74.0-8.5": "G074.0-08.5", "snr g74−8.5": "G074.0-08.5", "Mel 22": "Mel 22", "Cr 399": "Cr 399", "Collinder–399": "Cr 399",
        "Garlic Nebula": None, "M 1-92": None, "M 111": None, "C 110": None, "Sh2-400": None, "": None, "M 0": None, "G360.0+1.0": None, None: None,
    }
    assert dict(zip(want, told(spark, text.designation, list(want)))) == want
    keys = told(spark, text.designation_key, ["ngc 7000", "NGC7000", "Some Star 5"])
    assert keys[0] == keys[1] and keys[2] == "SOMESTAR5"
    assert told(spark, text.looks_like_designation, ["M31", "2M 0415", "HD 209458", "Garlic Nebula", "SN2023ixf", "x" * 30 + "1"]) == [True, True, True, False, True, False]


def test_names(spark):
    assert told(spark, text.normal_name, ["Barnard's E", "Heart & Soul", "  Ångström–Galaxie α² ", None, "''"]) == ["barnards e", "heart and soul", "ångström galaxie α", None, ""]
    assert told(spark, text.strip_panel, ["IC 4604 Panel 12", "Cygnis Loop P2", "M31 - panel 3 ", "Panel", "Step2", None]) == ["IC 4604", "Cygnis Loop", "M31", "Panel", "Step2", None]
    assert told(spark, text.core_name, ["Heart and Soul Nebula SHO Panel 3", "The Nebula", "Rosette"]) == ["heart soul", "", "rosette"]


def grams(s):
    s = f"  {s} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def plain_search(asked, entries, limit):
    """All with all; entries are (id, names, cores, keys, rank) as the column functions make them."""
    a, q, core, key = asked
    short, best = q.replace(" ", "").upper(), {}

    def consider(i, score):
        best[i] = max(best.get(i, 0), score)

    owners = [i for i, _, _, keys, _ in entries if key in keys] if key else []
    if owners:
        consider(min(owners), 100)
    for i, names, cores, keys, _ in entries:
        for n, c in zip(names, cores):
            if n == q:
                consider(i, 80)
            if core and c == core:
                consider(i, 70)
            elif n.startswith(q):
                consider(i, 50)
            elif len(q.encode()) >= 3 and q in n:
                consider(i, 35)
            elif len(core.encode()) >= 4 and c:
                both = len(grams(c) & grams(core))
                j = both / (len(grams(c)) + len(grams(core)) - both)
                if j >= 0.45:
                    consider(i, 30 * j)
        if len(short.encode()) >= 2 and any(k.startswith(short) for k in keys):
            consider(i, 45)
    rank = {e[0]: e[4] for e in entries}
    ordered = sorted(((-(s + rank[i]), i) for i, s in best.items()))
    return [(i, round(-s, 9)) for s, i in ordered[:limit]]


def test_search_equals_all_with_all(spark):
    rnd = random.Random(4)
    words = ["garlic", "rosette", "cygnus", "loop", "heart", "soul", "nebula", "galaxy", "the", "veil", "witch", "head", "ha", "étoile", "星雲"]
    objects = []
    for i in range(150):
        name = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))).title() if rnd.random() < 0.9 else None
        aliases = [rnd.choice([f"M {rnd.randrange(1, 40)}", f"SH2-{rnd.randrange(1, 60)}", "Cygnus Wall", "", None, "HD 20945"]) for _ in range(rnd.randrange(3))] if rnd.random() < 0.9 else None
        objects.append((f"o{i:03d}", f"NGC {rnd.randrange(1, 200)}" if rnd.random() < 0.9 else None, name, aliases, rnd.choice([0.0, 0.5, 1.25, None])))
    asked = ["Garlic Nebula", "Cygnis Loop", "m31", "ngc 012", "N", "ha", "The", "rosete", "oul", "  ", None, "Sh2", "hd20945", "é", "星雲", "星", "veil witch head", "Heart & Soul Panel 2", "Cygnus Wall", "zzz", "Garlic Nebula", "nebula"]
    df = spark.createDataFrame(objects, "id string, designation string, name string, aliases array<string>, rank double")
    got = {}
    for r in name_search(spark.createDataFrame([(a,) for a in asked], "asked string"), df, limit=7).collect():
        got.setdefault(r["asked"], []).append((r["place"], r["id"], round(r["score"], 9)))
    every = [w for _, d, n, al, _ in objects for w in [n, d, *(al or [])] if w]
    normal, cores = (dict(zip(every, told(spark, f, every))) for f in (text.normal_name, text.core_name))
    entries = []
    for i, d, n, al, rank in objects:
        written = [w for w in [n, d, *(al or [])] if w]
        keys = [re.sub(r"\s", "", w.upper()) for w in [d, *(al or [])] if w and re.search(r"\d", w)]
        entries.append((i, [normal[w] for w in written], [cores[w] for w in written], keys, rank or 0.0))
    q = [a.strip() for a in dict.fromkeys(asked) if a and a.strip()]
    rows = zip(q, told(spark, text.normal_name, q), told(spark, text.core_name, q), told(spark, text.designation_key, q), told(spark, text.looks_like_designation, q))
    for a, n, c, k, looks in rows:
        want = plain_search((a, n, c, k if looks else None), entries, 7)
        assert [(i, s) for _, i, s in sorted(got.get(a, []))] == want, a
    assert [p for p, _, _ in sorted(got["N"])] == list(range(1, 8)) and "zzz" not in got


@pytest.mark.parametrize("asked,how", [("abell 85", "designation"), ("Garlic Nebula", "name"), ("garl", "prefix"), ("rlic", "contains"), ("garlik", "similar")])
def test_ways(spark, asked, how):
    df = spark.createDataFrame([("a", "G116.9+00.2", "Garlic Nebula", ["Abell 85"], 0.0), ("b", "NGC 281", "Pacman", None, 0.0)], "id string, designation string, name string, aliases array<string>, rank double")
    rows = name_search(spark.createDataFrame([(asked,)], "asked string"), df).collect()
    assert [(r["id"], r["how"]) for r in rows] == [("a", how)]
    assert name_search(spark.createDataFrame([(asked,)], "asked string"), df.limit(0)).count() == 0


def test_designations_and_sql_end_with_the_catalogue(spark, tmp_path):
    """Numbers beyond a catalogue's last one are no designations, here and in the SQL."""
    rows = [(k, f"part {k}", size) for k, size in enumerate([1, 3, 4, 2, 111, 0])] + [(9999, "a", 1), (10000, "b", 1), (20000, "c", 3), (10001, None, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {r[0]: r[1] for r in QUERIES["designations"](spark, str(tmp_path)).collect()}
    assert got[9999] == "NGC 9999" and got[10000] is None and got[20000] == "M 3" and got[4] is None
    assert got == dict(duckdb.sql(ORACLES["designations"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")).fetchall())


def test_a_shared_name_brings_its_leading_objects_only(spark):
    """3,000 objects of one name are compared once; those that sums of near ranks may let in stay, the rest can't be among the first."""
    rows = [(i, [0.0, 0.1, 0.1 + 1e-16, 0.3, float("nan"), None][(i * 7) % 6 if i < 2990 else 3], "Garlic Nebula", f"NGC {i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, rank double, name string, designation string").withColumn("aliases", F.lit(None).cast("array<string>"))
    known = [(i, 0.0 if r is None else r) for i, r, _, _ in rows if r is None or r == r]
    hits = spark.createDataFrame([("garlic", "garlic nebula", 50.0, "prefix"), ("rlic", "garlic nebula", 35.0, "contains")], "asked string, n string, score double, how string")
    held = spark.createDataFrame([(i, r, "garlic nebula") for i, r in known], "id long, rank double, n string")
    led = _leading(held, "n", hits, 5).collect()
    for asked, score in (("garlic", 50.0), ("rlic", 35.0)):
        mine = sorted((-(r["score"] + r["rank"]), r["id"]) for r in led if r["asked"] == asked)
        assert len(mine) <= 15 and mine[:5] == sorted((-(score + r), i) for i, r in known)[:5]
    plain = df.filter("not isnan(rank) or rank is null")
    got = {}
    for r in name_search(spark.createDataFrame([("garlic",), ("rlic",), ("NGC 7",)], "asked string"), plain, limit=5).collect():
        got.setdefault(r["asked"], []).append((r["place"], r["id"]))
    best = [i for _, i in sorted((-r, i) for i, r in known)[:5]]
    assert [i for _, i in sorted(got["garlic"])] == [i for _, i in sorted(got["rlic"])] == best
    owners = [(i, r) for i, r in known if i % 50 == 7]
    score = {i: (100 if i == owners[0][0] else 80) + r for i, r in owners}
    assert [i for _, i in sorted(got["NGC 7"])] == sorted(score, key=lambda i: (-score[i], i))[:5]
