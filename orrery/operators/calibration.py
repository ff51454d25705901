"""Calibration frames: sets, choices, coverage, gaps and backlogs.

Frames are rows with id, kind (LIGHT, DARK, BIAS, FLAT), object, night (date),
at (seconds, double), filter, exposure, gain, offset, set_temp, bin_x, rotator.
Missing setup values are null and equal one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.sky import angle_between, rotation_fits
from orrery.operators.sessions import gap_sessions

LIBRARY_GAP = 36 * 3600.0
# Frames that a master is made of at least; the setpoints that a dark can be scaled over (degrees); darks of a full set from 120 s on and below; biases of a full set.
BUILDABLE, SCALED_DEGREES, LONG_EXPOSURE, LONG_DARKS, SHORT_DARKS, FULL_BIASES = 3, 10.0, 120.0, 10, 25, 30


def calibration_sets(frames: DataFrame) -> DataFrame:
    """Sets of calibration frames with their number, first and last night.

    Darks and biases of a setup join while at most 36 hours pass between
    frames; flats of a night, object, filter and whole-degree rotation are one
    set, whatever the pauses.
    """
    setup = ["kind", "exposure", "gain", "offset", "set_temp", "bin_x"]
    cols = [F.count("*").alias("frames"), F.min("night").alias("first_night"), F.max("night").alias("night"), F.max("at").alias("until")]
    library = gap_sessions(frames.filter(F.col("kind").isin("DARK", "BIAS")), setup, "at", LIBRARY_GAP, ties=["id"])
    sets = library.groupBy(*setup, "session").agg(*cols).drop("session")
    flats = frames.filter("kind = 'FLAT'").withColumn("rotator", F.round("rotator"))
    by = [*setup, "night", "object", "filter", "rotator"]
    flat_sets = flats.groupBy(*by).agg(F.count("*").alias("frames"), F.max("at").alias("until")).withColumn("first_night", F.col("night"))
    both = sets.unionByName(flat_sets, allowMissingColumns=True)
    return both.withColumn("set_id", F.xxhash64(*[F.col(c).cast("string") for c in (*by, "first_night")]))


def light_groups(frames: DataFrame) -> DataFrame:
    """Lights by object, night, filter and setup."""
    by = ["object", "night", "filter", "exposure", "gain", "offset", "set_temp", "bin_x", F.round("rotator").alias("rotator")]
    return frames.filter("kind = 'LIGHT'").groupBy(*by).agg(F.count("*").alias("lights")).withColumn("group_id", F.xxhash64("object", F.col("night").cast("string"), "filter", "exposure", "gain", "offset", "set_temp", "bin_x", "rotator"))


def _choice(groups: DataFrame, sets: DataFrame, kind: str, same: list[str], eligible: Column, order: list[Column], exact: Column) -> DataFrame:
    """The first eligible set of each group by ``order``, with grade exact, fallback or missing."""
    g, s = groups.alias("g"), sets.filter(F.col("kind") == kind).alias("s")
    on = F.lit(True)
    for c in same:
        on &= F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}"))
    pairs = g.join(s, on).filter(eligible)
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate([*order, F.col("s.set_id")])])
    best = pairs.groupBy("g.group_id").agg(F.min_by(F.struct(F.col("s.set_id").alias("set_id"), F.coalesce(exact, F.lit(False)).alias("exact")), key).alias("b"))
    name = kind.lower()
    grade = F.when(F.col("b.set_id").isNull(), "missing").when(F.col("b.exact"), "exact").otherwise("fallback")
    return best.select("group_id", F.col("b.set_id").alias(name), grade.alias(f"{name}_grade"))


def choose_darks(groups: DataFrame, sets: DataFrame, most_degrees: float = SCALED_DEGREES) -> DataFrame:
    """A dark of the same gain, offset and bin: full and exact first, then nearer in temperature, same exposure, longer, nearer night.

    A full set has 10 frames from 120 s on, 25 below. An unknown set point
    counts as ``most_degrees`` off and is never exact.
    """
    off = F.coalesce(F.abs(F.col("g.set_temp") - F.col("s.set_temp")), F.lit(most_degrees))
    same = F.abs(F.col("g.exposure") - F.col("s.exposure")) <= 0.01 * F.col("g.exposure")
    exact = same & (off <= 1) & F.col("g.set_temp").isNotNull() & F.col("s.set_temp").isNotNull()
    full = F.col("s.frames") >= F.when(F.col("s.exposure") >= LONG_EXPOSURE, LONG_DARKS).otherwise(SHORT_DARKS)
    eligible = (F.col("s.frames") >= BUILDABLE) & (off <= most_degrees) & (F.col("s.exposure") > 0)
    nights = F.abs(F.datediff("g.night", "s.night"))
    return _choice(groups, sets, "DARK", ["gain", "offset", "bin_x"], eligible, [~(full & exact), off, ~same, -F.col("s.exposure"), nights], exact)


def choose_flats(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """A flat of the same filter and bin: at a fitting rotation first, else by the angle; then of the same gain and offset, nearer night, the later on a tie.

    Any buildable set will do; it is exact if the rotation fits, gain and offset
    are the same and it is of the lights' own night.
    """
    fits = rotation_fits(F.col("g.rotator"), F.col("s.rotator"))
    angle = F.when(~fits, angle_between(F.col("g.rotator"), F.col("s.rotator"))).otherwise(0.0)
    same = F.col("g.gain").eqNullSafe(F.col("s.gain")) & F.col("g.offset").eqNullSafe(F.col("s.offset"))
    nights = F.datediff("s.night", "g.night")
    return _choice(groups, sets, "FLAT", ["filter", "bin_x"], F.col("s.frames") >= BUILDABLE, [~fits, angle, ~same, F.abs(nights), -nights], fits & same & (nights == 0))


def choose_biases(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The buildable bias of the same gain, offset and bin of the nearest night, the later on a tie, then the one of more frames; exact on the lights' own night."""
    nights = F.datediff("s.night", "g.night")
    return _choice(groups, sets, "BIAS", ["gain", "offset", "bin_x"], F.col("s.frames") >= BUILDABLE, [F.abs(nights), -nights, -F.col("s.frames"), -F.col("s.until")], nights == 0)


def coverage(frames: DataFrame) -> DataFrame:
    """Each group of lights with its dark, flat and bias and how well they fit."""
    sets, groups = calibration_sets(frames), light_groups(frames)
    out = groups
    for chosen, name in ((choose_darks, "dark"), (choose_flats, "flat"), (choose_biases, "bias")):
        out = out.join(chosen(groups, sets), "group_id", "left").withColumn(f"{name}_grade", F.coalesce(f"{name}_grade", F.lit("missing")))
    return out


def dark_gaps(frames: DataFrame, step: float = 5.0) -> DataFrame:
    """Setups of lights (gain, offset, temperature rung, exposure) that no buildable dark fits within a degree and one percent."""
    sets = calibration_sets(frames).filter(f"kind = 'DARK' and frames >= {BUILDABLE}").alias("s")
    lights = light_groups(frames).filter("gain is not null and offset is not null and set_temp is not null")
    need = lights.groupBy("gain", "offset", (F.round(F.col("set_temp") / step) * step).alias("rung"), "exposure").agg(F.sum("lights").alias("lights"), F.countDistinct("night").alias("nights"), F.max("night").alias("latest")).alias("n")
    fits = (F.col("n.gain") == F.col("s.gain")) & (F.col("n.offset") == F.col("s.offset")) & (F.abs(F.col("s.set_temp") - F.col("n.rung")) <= 1) & (F.abs(F.col("s.exposure") - F.col("n.exposure")) <= 0.01 * F.col("n.exposure"))
    return need.join(sets, fits, "left_anti")


def bias_backlog(frames: DataFrame, target: int = FULL_BIASES) -> DataFrame:
    """Setups whose chosen bias is missing or thin, most missing lights first, with their priority from 1.

    A set of under ``target`` frames is thin unless a full one of its setup was
    taken after it. Lights without gain, offset or bin name no setup (see
    ``unschedulable``).
    """
    sets = calibration_sets(frames)
    groups = light_groups(frames).dropna(subset=["gain", "offset", "bin_x"])
    chosen = groups.join(choose_biases(groups, sets), "group_id", "left").join(sets.select(F.col("set_id").alias("bias"), F.col("frames").alias("have"), "until"), "bias", "left")
    full = sets.filter((F.col("kind") == "BIAS") & (F.col("frames") >= target)).groupBy("gain", "offset", "bin_x").agg(F.max("until").alias("full_until"))
    chosen = chosen.join(full, ["gain", "offset", "bin_x"], "left")
    missing = F.col("bias").isNull()
    thin = (F.col("have") < target) & ~F.coalesce(F.col("full_until") > F.col("until"), F.lit(False))
    per = chosen.groupBy("gain", "offset", "bin_x").agg(F.sum(F.when(missing, F.col("lights")).otherwise(0)).alias("missing"), F.sum(F.when(thin, F.col("lights")).otherwise(0)).alias("thin"), F.max(F.when(missing | thin, F.col("night"))).alias("latest"))
    due = per.filter("missing > 0 or thin > 0")
    # a backlog is one row per camera setup: a handful, ranked as one list
    return due.withColumn("priority", F.row_number().over(Window.orderBy(F.desc("missing"), F.desc("thin"), F.desc("latest"), "gain", "offset", "bin_x")))


def unschedulable(frames: DataFrame) -> DataFrame:
    """Lights for which no calibration can be scheduled, by reason."""
    why = F.when(F.col("gain").isNull() | F.col("offset").isNull(), "no gain or offset").when(F.col("bin_x").isNull(), "no binning")
    return frames.filter((F.col("kind") == "LIGHT") & why.isNotNull()).groupBy(why.alias("reason")).agg(F.count("*").alias("lights"))


def calibration_runs(frames: DataFrame, pause: float = 1800.0) -> DataFrame:
    """Runs of consecutive calibration frames of one setup, pauses of at most ``pause`` seconds."""
    setup = F.xxhash64("kind", "exposure", "gain", "offset", "set_temp", "bin_x", "filter")
    w = Window.partitionBy("night").orderBy("at", "id")
    f = frames.filter("kind <> 'LIGHT'").withColumn("setup", setup)
    new = ~F.col("setup").eqNullSafe(F.lag("setup").over(w)) | (F.col("at") - F.lag("at").over(w) > pause)
    f = f.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return f.groupBy("night", "run").agg(F.first("kind").alias("kind"), F.count("*").alias("frames"), F.min("at").alias("began"), F.max(F.col("at") + F.coalesce("exposure", F.lit(0.0))).alias("ended"))
