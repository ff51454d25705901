"""Names, designations, coordinates and text scraps as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which object a name means.
GENERIC_WORDS = [
    "and", "cluster", "co", "complex", "galaxies", "galaxy", "ha", "hoo", "lrgb", "mosaic", "neb", "nebula", "nebulae", "of", "oiii", "region", "remnant", "rgb", "s", "sho", "snr", "supernova", "the",
]

# Catalogues of deep-sky objects, how their names are written, their last number, and the case of a letter after it.
CATALOGUES = {
    "Abell ": (["ABELL", "A"], 4076, ""),
    "Arp ": (["ARP"], 338, ""),
    "B ": (["BARNARD", "B"], 999, "lower"),
    "C ": (["CALDWELL", "C"], 109, ""),
    "Ced ": (["CEDERBLAD", "CED"], 999, "lower"),
    "Cr ": (["COLLINDER", "CR", "CL"], 471, ""),
    "Gum ": (["GUM"], 85, ""),
    "HCG ": (["HICKSON", "HCG"], 100, ""),
    "IC ": (["IC"], 9999, "upper"),
    "LBN ": (["LBN"], 1125, ""),
    "LDN ": (["LYNDS", "LDN"], 1802, ""),
    "M ": (["MESSIER", "M"], 110, ""),
    "Mel ": (["MELOTTE", "MEL"], 245, ""),
    "NGC ": (["NGC"], 9999, "upper"),
    "PGC ": (["PGC"], 9_999_999, ""),
    "RCW ": (["RCW"], 182, ""),
    "Sh2-": (["SHARPLESS"], 313, ""),
    "UGC ": (["UGC"], 99_999, ""),
    "vdB ": (["VANDENBERGH", "VDB"], 158, ""),
}
#: What a designation of any catalogue looks like (a fixed value).
DESIGNATION_SHAPE = r"^[A-Za-z][A-Za-z0-9]{0,9}[ -]?[+-]?\d[0-9A-Za-z.+\-*?]*$|^\d[A-Za-z]{1,2}\s?\d+(\.\d+)?$"


def normal_name(x: Column) -> Column:
    """Lower case, & as and, a possessive s with its word, everything but letters and digits (of any script) as single spaces."""
    joined = F.replace(F.lower(F.replace(x, F.lit("&"), F.lit(" and "))), F.lit("'s"), F.lit("s"))
    return F.trim(F.regexp_replace(joined, r"[^\p{L}\p{Nd}]+", " "))


def strip_panel(x: Column) -> Column:
    """A mosaic target's name without its panel number."""
    return F.trim(F.regexp_replace(x, r"(?i)(\s*[-,]?\s*\bpanel\s*\d+|\s+p\d+)\s*$", ""))


def core_name(x: Column) -> Column:
    """The normal name without panel and generic words; empty where nothing is left."""
    words = F.filter(F.split(normal_name(strip_panel(x)), " "), lambda w: ~w.isin(GENERIC_WORDS) & (w != ""))
    return F.array_join(words, " ")


def trigrams(x: Column) -> Column:
    """Distinct three-letter runs of a name, padded by two spaces before and one after."""
    padded = F.concat(F.lit("  "), x, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(F.array_union(a, b)))


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of x, which is worked out once a row, also in branches and filters."""
    return F.element_at(F.transform(F.array(x), then), 1)


def designation(x: Column) -> Column:
    """Canonical catalogue designation of a name, null if it isn't one."""
    remnant = r"^(?:SNR\s*)?G\s*(\d{1,3}(?:\.\d+)?)\s*([+-])\s*(\d{1,2}(?:\.\d+)?)$"  # by galactic position
    shape = r"^([A-Z][A-Z\s]*?)\s*-?\s*0*(\d+)\s*([A-Z])?$"
    listed = [(form, F.struct(F.lit(prefix), F.lit(last), F.lit(case))) for prefix, (forms, last, case) in CATALOGUES.items() for form in forms]
    rows = F.create_map(*(v for form, row in listed for v in (F.lit(form), row)))

    def placed(s: Column) -> Column:
        lon, lat = (F.regexp_extract(s, remnant, i).try_cast("double") for i in (1, 3))
        return F.when((lon < 360) & (lat <= 90), F.concat(F.lit("G"), F.lpad(F.format_string("%.1f", lon), 5, "0"), F.regexp_extract(s, remnant, 2), F.lpad(F.format_string("%.1f", lat), 4, "0")))

    def numbered(p: Column) -> Column:
        prefix, last, case = (p["own"][f"col{i}"] for i in (1, 2, 3))
        suffix = F.when(case == "upper", p["letter"]).when(case == "lower", F.lower(p["letter"])).when(p["letter"] == "", "")
        return F.when(p["number"].between(1, last), F.concat(prefix, p["number"].cast("string"), suffix))

    def listed_at(plain: Column) -> Column:
        word, number, letter = F.regexp_replace(F.regexp_extract(plain, shape, 1), r"\s+", ""), F.regexp_extract(plain, shape, 2).try_cast("int"), F.regexp_extract(plain, shape, 3)
        return _once(F.struct(F.try_element_at(rows, word).alias("own"), number.alias("number"), letter.alias("letter")), numbered)

    # the number of Sharpless' catalogue, 2, is part of its name
    plain = lambda s: F.regexp_replace(s, r"^(?:SH\s*2|SHARPLESS\s*2\s*-)\s*-?\s*(?=\d)", "SHARPLESS ")
    written = F.upper(F.trim(F.regexp_replace(F.regexp_replace(x, "[\u2010-\u2014\u2212_]", "-"), r"\s+", " ")))
    return _once(written, lambda s: F.coalesce(F.when(s.rlike(remnant), placed(s)), _once(plain(s), listed_at)))


def designation_key(x: Column) -> Column:
    """What two spellings of a designation have in common."""
    return F.upper(F.regexp_replace(F.coalesce(designation(x), x), r"\s+", ""))


def looks_like_designation(x: Column) -> Column:
    trimmed = F.trim(x)
    return ((F.octet_length(trimmed) <= 24) & trimmed.rlike(DESIGNATION_SHAPE)) | designation(x).isNotNull()


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sexagesimal(x: Column, unit: float = 1.0) -> Column:
    """Degrees of 'dd mm ss.s' (or with colons, or decimal), times ``unit``; null if it is neither."""
    parts = F.regexp_extract_all(F.trim(x), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    sign = F.when(F.trim(x).startswith("-"), -1.0).otherwise(1.0)
    value = sum((F.coalesce(F.try_element_at(parts, F.lit(i + 1)).cast("double"), F.lit(0.0)) / 60**i for i in range(3)), F.lit(0.0))
    return F.when(F.trim(x).rlike(r"^[+-]?\d+(\.\d+)?([ :]+\d+(\.\d+)?){0,2}$"), sign * value * unit)


def to_sexagesimal(x: Column) -> Column:
    """'+dd mm ss' of degrees, rounded to the second."""
    seconds = F.round(F.abs(x) * 3600).cast("long")
    sign = F.when(x < 0, "-").otherwise("+")
    pad = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat(sign, pad(F.floor(seconds / 3600)), F.lit(" "), pad(F.floor(seconds / 60) % 60), F.lit(" "), pad(seconds % 60))


def positions(x: Column) -> Column:
    """'RA hh:mm:ss ... Dec dd:mm:ss' scraps of prose, as (ra, dec) texts."""
    ra = F.regexp_extract_all(x, F.lit(r"(\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)\s*[,;]?\s*([+-]\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)"), F.lit(1))
    dec = F.regexp_extract_all(x, F.lit(r"(\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)\s*[,;]?\s*([+-]\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)"), F.lit(2))
    return F.arrays_zip(ra.alias("ra"), dec.alias("dec"))


def cut_html(x: Column, n: int) -> Column:
    """At most ``n`` characters, ending outside tags and entities."""
    return F.regexp_replace(F.substring(x, 1, n), r"(<[^>]*|&[^;\s]{0,10})$", "") if n else F.lit("")


def filter_name(x: Column, aliases: dict[str, str]) -> Column:
    """Canonical filter name by alias (lower case); an unknown one stays, trimmed."""
    found = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    return F.coalesce(F.try_element_at(found, F.lower(F.trim(x))), F.trim(x))
