import random
import statistics

import numpy as np

from orrery.operators.series import verdicts


def plain(points, change, level):
    """Bands judged one by one; points are (band, object, y, error)."""
    kinds = []
    for band in sorted({p[0] for p in points}):
        res, errs, ys = [], [], []
        for obj in {p[1] for p in points if p[0] == band}:
            own = [p for p in points if p[:2] == (band, obj) and p[2] is not None and p[3] is not None and 0 < p[2] < float("inf") and 0 < p[3] < float("inf")]
            if len(own) >= 5:
                m = statistics.median(p[2] for p in own)
                res += [p[2] - m for p in own]
                errs += [p[3] for p in own]
                ys += [p[2] for p in own]
        if not res:
            continue
        n, order = len(res), sorted(res)
        trim = max(1, int(0.01 * n + 0.5))
        peak = order[n - 1 - trim] - order[trim] if n > 2 * trim else 0.0
        amplitude = float(np.percentile(order, 95) - np.percentile(order, 5))
        error = statistics.median(errs)
        off = [r for r, e in zip(res, errs) if abs(r) > change / 2 and abs(r) > 5 * e]
        faint = sum(r > 0 for r in off)
        eclipse = faint >= max(5, 0.01 * n) and len(off) - faint <= 0.25 * faint
        varies = n >= 10 and (amplitude >= 4.5 * error or len(off) >= max(5, 0.02 * n) or eclipse)
        flat = n >= 20 and 3 * error <= change and amplitude < change / 3 and amplitude < 4.5 * error and len(off) <= max(1, 0.01 * n)
        if not level[0] <= statistics.median(ys) <= level[1]:
            continue
        kinds.append((0, -peak, band, peak) if varies and peak + 2 * error >= change else (1, -peak, band, peak) if varies else (2, -n, band, amplitude) if flat else (3, 0, band, 0.0))
    if not kinds:
        return ("unknown", None, 0.0, 0)
    kind, _, band, amplitude = min(kinds)
    return (["variable", "unknown", "flat", "unknown"][kind], band if kind < 3 else None, round(amplitude, 9), len(kinds))


def test_verdicts_equal_a_plain_loop(spark):
    rnd, rows = random.Random(11), []
    for star in range(60):
        shape = star % 6
        for band in ("g", "r", "i")[: rnd.randrange(1, 4)]:
            for obj in range(rnd.randrange(1, 3)):
                offset, error = rnd.uniform(-0.2, 0.2), rnd.choice([0.01, 0.03, 0.15])
                for k in range(rnd.choice([3, 12, 40, 150])):
                    dip = {0: 0.0, 1: 0.8 * (k % 2), 2: 0.6 * (k % 30 == 0), 3: -0.6 * (k % 30 == 0), 4: 0.12 * (k % 2), 5: 3.0 * (k % 60 == 0)}[shape]
                    y = (12.4 if star % 13 == 0 else 16.0) + offset + dip + rnd.gauss(0, error)
                    rows.append((star, band, obj, rnd.choice([y] * 30 + [None, float("nan"), -1.0]), rnd.choice([error] * 30 + [0.0, float("inf"), None])))
    df = spark.createDataFrame(rows, "star long, band string, field long, mag double, err double")
    got = {r["star"]: (r["verdict"], r["band"], round(r["amplitude"], 9), r["bands"]) for r in verdicts(df, "star", "band", "field", "mag", "err", change=0.5, level=(12.5, 20.5)).collect()}
    want = {s: plain([r[1:] for r in rows if r[0] == s], 0.5, (12.5, 20.5)) for s in range(60)}
    for s, w in want.items():
        assert got.get(s, ("unknown", None, 0.0, 0)) == w, s
    assert {w[0] for w in want.values()} == {"variable", "flat", "unknown"} and sum(w[0] == "unknown" and w[1] is not None for w in want.values()) > 2
