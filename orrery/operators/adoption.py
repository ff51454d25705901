"""Mosaics proposed from planned projects: by the names, numbers and places of their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.matching import cone_join
from orrery.operators.outlines import footprint, overlapping
from orrery.session import staged

# How panels are named; the overlap that makes panels neighbours; how near targets frame the same field (degrees).
PANEL = r"(?i)^(.*?)\bpanel\s*(\d+)\s*$"
NEIGHBOURS, SAME_FIELD = 0.03, 0.1


def mosaic_proposals(targets: DataFrame, width: float, height: float) -> DataFrame:
    """(project, kind, confidence, auto, panels, issues) for projects of two targets or more.

    ``targets`` has project, flagged (whether it is planned as a mosaic), target
    (an id), name, ra, dec and rotation; frames are ``width`` by ``height``
    degrees. Where every target is named "... Panel N" with a number of its own,
    the project is a mosaic: of high confidence and adopted by itself unless the
    panels are numbered otherwise than from 1 (numbering), it isn't flagged
    (unflagged) or a panel overlaps no other (lonely); panels that are not named
    after the project (renamed) only keep it from being adopted by itself.
    Otherwise, targets on the same field (flagged, or of like names) say that it
    is no mosaic, with medium confidence; else a flagged project is one of low
    confidence (unnamed). Nothing is proposed for the others.

    Panels meet by their project and the cells of their outlines, targets by
    project and the cells of their place: neither all targets of a project nor
    those of different projects are paired with one another.
    """
    number = F.regexp_extract("name", PANEL, 2).try_cast("int")
    prefix = F.regexp_replace(F.trim(F.regexp_extract("name", PANEL, 1)), r"[ \-_:,]+$", "")
    t = staged(targets.select("project", "flagged", "target", "name", "ra", "dec", "rotation", number.alias("number"), prefix.alias("prefix")), "targets")
    # like names begin alike, or have their first word in common
    low = F.lower(F.trim("name"))
    spots = t.select("project", "flagged", "target", "ra", "dec", low.alias("name"))
    others = spots.select("project", F.col("target").alias("target2"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), F.col("name").alias("name2"))
    near = cone_join(spots, others, SAME_FIELD, on=("project",)).filter(F.col("target") != F.col("target2"))
    alike = (F.col("name") != "") & (F.col("name2") != "") & (F.startswith("name", "name2") | F.startswith("name2", "name") | (F.split("name", r"\s+")[0] == F.split("name2", r"\s+")[0]))
    shared = near.filter(F.col("flagged") | alike).select("project", "target").distinct().groupBy("project").agg(F.count("*").alias("same_field"))
    frames = t.filter("number is not null").select("project", "target", footprint("ra", "dec", "rotation", width, height).alias("outline"))
    pairs = overlapping(frames, "target", least=NEIGHBOURS, within="project")
    met = pairs.select("project", F.explode(F.array("a", "b")).alias("target")).distinct().groupBy("project").agg(F.count("*").alias("met"))
    per = t.groupBy("project").agg(
        F.count("*").alias("panels"),
        F.bool_or("flagged").alias("flagged"),
        (F.bool_and(F.col("number").isNotNull()) & (F.countDistinct("number") == F.count("*"))).alias("named"),
        ((F.min("number") == 1) & (F.max("number") == F.count("*"))).alias("sequential"),
        F.bool_or(F.lower("prefix") != F.lower(F.trim(F.col("project").cast("string")))).alias("renamed"),
    )
    per = per.filter("panels >= 2").join(met, "project", "left").join(shared, "project", "left")
    lonely = F.coalesce("met", F.lit(0)) < F.col("panels")
    named = F.col("named")
    kind = F.when(named, "mosaic").when(F.col("same_field") > 0, "not_mosaic").when(F.col("flagged"), "mosaic")
    medium = ~F.col("sequential") | ~F.col("flagged") | lonely
    confidence = F.when(named & ~medium, "High").when(named | (F.col("same_field") > 0), "Medium").otherwise("Low")
    told = [(named & F.col("renamed"), "renamed"), (named & ~F.col("sequential"), "numbering"), (named & ~F.col("flagged"), "unflagged"), (named & lonely, "lonely"), (~named & (F.col("same_field") > 0), "same field"), (~named & F.col("same_field").isNull(), "unnamed")]
    issues = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in told)))
    done = per.withColumns({"kind": kind, "confidence": confidence, "issues": issues}).filter("kind is not null")
    return done.select("project", "kind", "confidence", (F.size("issues") == 0).alias("auto"), F.when(F.col("kind") == "mosaic", F.col("panels")).otherwise(0).alias("panels"), "issues")

