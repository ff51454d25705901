"""What is proposed for planned projects, case by case."""

import math

from orrery.operators import adoption
from orrery.operators.adoption import mosaic_proposals

FIELDS = "project string, flagged boolean, target string, name string, ra double, dec double, rotation double, note string"
W, H = 3.32, 2.22


def grid(project, names, ra, dec, rows, cols, overlap, flagged=True):
    """Targets of a grid of frames, row by row from north-east."""
    out = []
    for i, name in enumerate(names):
        dy, dx = ((rows - 1) / 2 - i // cols) * H * (1 - overlap), ((cols - 1) / 2 - i % cols) * W * (1 - overlap)
        d = dec + dy
        out.append((project, flagged, f"{project}-{i}", name, (ra + dx / math.cos(math.radians(d))) % 360, d, 0.0, "x"))
    return out


def named(prefix, numbers):
    return [f"{prefix} Panel {n}" for n in numbers]


def test_proposals(spark):
    stray = grid("Heart", named("Heart", (1, 2, 3)), 38.0, 61.5, 1, 3, 0.1)
    stray[2] = (*stray[2][:4], 10.0, 41.0, 0.0, "x")
    rows = [
        *grid("Markarian Chain", named("Markarian Chain", range(1, 10)), 187.0, 13.0, 3, 3, 0.15),
        *grid("Rho", named("IC 4604", range(1, 13)), 246.0, -24.0, 3, 4, 0.15),
        *grid("Gappy", named("gappy -", (1, 2, 3, 6, 12)), 0.5, 0.0, 1, 5, 0.2),
        *grid("Quiet", named("Quiet", (1, 2)), 50.0, 5.0, 1, 2, 0.2, flagged=False),
        *stray,
        *grid("Taurus", named("Taurus", range(1, 7)), 67.9, 25.3, 3, 2, 0.0),
        *grid("Cygnus Arc", ["Arc West", "Arc East"], 310.0, 40.0, 1, 2, 0.16),
        ("Rosette", False, "r1", "Rosette Nebula", 97.9, 4.9, 0.0, "x"),
        ("Rosette", False, "r2", "Rosette Nebula SHO", 97.95, 4.95, 0.0, "x"),
        ("Combined", True, "c1", "Rosette Nebula", 97.9, 4.9, 0.0, "x"),
        ("Combined", True, "c2", "NGC 2244", 97.95, 4.95, 0.0, "x"),
        ("Apart", False, "a1", "NGC 1", 10.0, 4.9, 0.0, "x"),
        ("Apart", False, "a2", "M 33", 10.01, 4.9, 0.0, "x"),
        ("Single", True, "s1", "Single Panel 1", 200.0, 4.9, 0.0, "x"),
        *grid("Twice", named("Twice", (1, 1)), 150.0, 5.0, 1, 2, 0.2),
    ]
    got = {r["project"]: tuple(r)[1:] for r in mosaic_proposals(spark.createDataFrame(rows, FIELDS), W, H).collect()}
    assert got == {
        "Markarian Chain": ("mosaic", "High", True, 9, []),
        "Rho": ("mosaic", "High", False, 12, ["renamed"]),
        "Gappy": ("mosaic", "Medium", False, 5, ["numbering"]),
        "Quiet": ("mosaic", "Medium", False, 2, ["unflagged"]),
        "Heart": ("mosaic", "Medium", False, 3, ["lonely"]),
        "Taurus": ("mosaic", "Medium", False, 6, ["lonely"]),
        "Cygnus Arc": ("mosaic", "Low", False, 2, ["unnamed"]),
        "Rosette": ("not_mosaic", "Medium", False, 0, ["same field"]),
        "Combined": ("not_mosaic", "Medium", False, 0, ["same field"]),
        "Twice": ("mosaic", "Low", False, 2, ["unnamed"]),
    }
    assert mosaic_proposals(spark.createDataFrame([], FIELDS), W, H).count() == 0


def test_projects_on_one_field_are_not_paired(spark, monkeypatch):
    """Many projects on the same field: candidates grow with a project's targets, and no table of all targets is joined to pairs."""
    found = []
    monkeypatch.setattr(adoption, "overlapping", lambda *a, kept=adoption.overlapping, **k: found.append(kept(*a, **k)) or found[-1])
    rows = [r for i in range(30) for r in grid(f"P{i}", named(f"P{i}", (1, 2)), 100.0, 20.0, 1, 2, 0.2)]
    got = mosaic_proposals(spark.createDataFrame(rows, FIELDS), W, H).collect()
    assert {tuple(r)[1:3] for r in got} == {("mosaic", "High")} and len(got) == 30
    assert found[0].count() == 30
