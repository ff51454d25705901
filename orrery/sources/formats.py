"""Readers for the text, header and table formats of observation data.

Files are read by Spark (text, CSV, binaryFile), so any store that Spark reads
will do; parsing is column expressions, or a small helper per file where a
format is binary.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """Columns ``first`` to ``last`` (from 1) of a fixed-width line, cast to ``kind``."""

    name: str
    first: int
    last: int
    kind: str = "double"


def fixed_width(lines: DataFrame, fields: list[Field], *, required: list[str] = (), line: str = "value") -> DataFrame:
    """Fixed-width lines as columns; blank or unreadable is null.

    ``bad`` is true where a required field is null: count it, then filter.
    """
    cut = {f.name: F.trim(F.substring(F.col(line), f.first, f.last - f.first + 1)) for f in fields}
    cols = [(F.when(cut[f.name] != "", cut[f.name]) if f.kind == "string" else cut[f.name].try_cast(f.kind)).alias(f.name) for f in fields]
    out = lines.select(*cols)
    bad = F.lit(False)
    for r in required:
        bad |= F.col(r).isNull()
    return out.withColumn("bad", bad)


def ecsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """ECSV: CSV under # comments, with a header line that must name the schema's columns; 'null' is null."""
    return spark.read.option("comment", "#").option("header", True).option("nullValue", "null").option("enforceSchema", False).schema(schema).csv(path)


def commented_tsv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Tab-separated catalogue replies: # comments, a header, lines of units and of dashes, blank for null."""
    raw = spark.read.option("comment", "#").option("header", True).option("sep", "\t").csv(path)
    kept = raw.filter(~F.col(raw.columns[0]).rlike("^-+$"))
    clean = lambda c: F.when(F.trim(c) != "", F.trim(c))
    out = kept.select(*[(clean(F.col(c)) if t == "string" else clean(F.col(c)).try_cast(t)).alias(c) for c, t in columns.items()])
    # a line of units has no number where the rest have one
    number = next((c for c, t in columns.items() if t != "string"), None)
    return out.filter(F.col(number).isNotNull()) if number else out


def stamped_csv(lines: DataFrame, header: list[str], *, line: str = "value") -> DataFrame:
    """CSV lines (after a stamp and a header line) as columns of text, by the header's names."""
    parsed = F.from_csv(F.col(line), F.lit(", ".join(f"`{h}` STRING" for h in header)))
    return lines.select(parsed.alias("r")).select(*[F.col(f"r.{h}").alias(h) for h in header])


def any_time(x: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """The first of several time formats that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(x), F.lit(f)) for f in formats])


def forced_photometry(lines: DataFrame, *, line: str = "value") -> DataFrame:
    """Whitespace tables under a ### header: mjd, mag, error, flux, flux error, filter, seeing; unfair rows dropped."""
    p = F.split(F.trim(F.col(line)), r"\s+")
    num = lambda i: F.try_element_at(p, F.lit(i + 1)).try_cast("double")
    rows = lines.filter(~F.col(line).startswith("#")).select(num(0).alias("mjd"), num(1).alias("mag"), num(2).alias("mag_error"), num(3).alias("flux"), num(4).alias("flux_error"), F.try_element_at(p, F.lit(6)).alias("filter"))
    return rows.filter(F.col("mjd").isNotNull() & (F.col("flux_error") > 0))


def between_marks(text: Column, begin: str = "$$SOE", end: str = "$$EOE") -> Column:
    """The lines between two marks of a text table."""
    body = F.substring_index(F.substring_index(text, end, 1), begin, -1)
    return F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def field_rows(json: Column, fields: list[str]) -> Column:
    """{"fields": [...], "data": [[...]]} as an array of maps by field name."""
    doc = F.from_json(json, "fields array<string>, data array<array<string>>")
    return F.transform(doc["data"], lambda row: F.map_from_arrays(doc["fields"], row))


def log_lines(lines: DataFrame, *, line: str = "value") -> DataFrame:
    """JSON log lines: at, level, source, message; broken lines are null and counted by ``broken``."""
    r = F.from_json(line, "time string, level string, source string, message string", {"mode": "PERMISSIVE"})
    return lines.select(any_time(r["time"]).alias("at"), r["level"].alias("level"), r["source"].alias("source"), r["message"].alias("message"), r["message"].isNull().alias("broken"))


CARD = 80


def fits_cards(head: bytes) -> dict[str, str]:
    """Keywords of a FITS header, values as text without quotes and comments."""
    cards: dict[str, str] = {}
    for at in range(0, len(head) - CARD + 1, CARD):
        card = head[at : at + CARD].decode("latin-1")
        key = card[:8].strip()
        if key == "END":
            break
        if card[8:10] != "= ":
            continue
        value = card[10:]
        if value.lstrip().startswith("'"):
            body, quote, i = [], value.index("'") + 1, 0
            i = quote
            while i < len(value):
                if value[i] == "'":
                    if value[i + 1 : i + 2] != "'":
                        break
                    i += 1
                body.append(value[i])
                i += 1
            cards[key] = "".join(body).rstrip()
        else:
            cards[key] = value.split("/")[0].strip()
    return cards


def fits_headers(files: DataFrame, *, content: str = "content", path: str = "path") -> DataFrame:
    """(path, cards) of FITS files read as binaryFile."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f[path], "cards": [fits_cards(bytes(c)) for c in f[content]]})

    return files.select(path, content).mapInPandas(read, "path string, cards map<string,string>")


def fits_image(raw: bytes) -> np.ndarray:
    """The first image of a FITS file as float32 rows, BZERO and BSCALE applied."""
    cards, end = fits_cards(raw), raw.index(b"END" + b" " * 77)
    start = -(-(end + CARD) // 2880) * 2880
    kind = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}[int(cards["BITPIX"])]
    w, h = int(cards["NAXIS1"]), int(cards["NAXIS2"])
    data = np.frombuffer(raw, kind, w * h, start).reshape(h, w)
    return (data * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))).astype(np.float32)


def fits_bytes(image: np.ndarray, cards: dict[str, str] | None = None) -> bytes:
    """A float32 FITS file of an image."""
    h, w = image.shape
    head = [f"{'SIMPLE':8}= {'T':>20}", f"{'BITPIX':8}= {-32:>20}", f"{'NAXIS':8}= {2:>20}", f"{'NAXIS1':8}= {w:>20}", f"{'NAXIS2':8}= {h:>20}"]
    head += [f"{k[:8].upper():8}= '{str(v).replace(chr(39), chr(39) * 2):8}'" for k, v in (cards or {}).items()]
    raw = "".join(x[:CARD].ljust(CARD) for x in [*head, "END"]).encode("latin-1")
    data = image.astype(">f4").tobytes()
    return raw.ljust(-(-len(raw) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def unshuffled(raw: bytes, size: int) -> bytes:
    """Undo byte shuffling: planes of first, second, ... bytes of ``size``-byte items."""
    n = len(raw) // size
    return np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T.tobytes() + raw[n * size :]


def attachment(raw: bytes, codec: str, kind: str, order: str, shape: tuple[int, int]) -> np.ndarray:
    """A typed, maybe compressed and shuffled image attachment as float32; integers scale to 0..1."""
    name, shuffled, _ = codec.partition("+sh")
    if name == "zlib":
        raw = zlib.decompress(raw)
    elif name == "zstd":
        import zstandard

        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    elif name:
        raise ValueError(f"unknown codec {name!r}")
    code = {"UInt8": "u1", "UInt16": "u2", "UInt32": "u4", "Float32": "f4", "Float64": "f8"}[kind]
    if shuffled:
        raw = unshuffled(raw, int(code[1]))
    data = np.frombuffer(raw, ("<" if order == "little" else ">") + code)
    scale = 1.0 if code[0] == "f" else 1.0 / (2 ** (8 * int(code[1])) - 1)
    return (data * scale).astype(np.float32).reshape(shape)


def packed_header(values: list[float]) -> bytes:
    """Little-endian doubles with their number first, for binary columns."""
    return struct.pack(f"<I{len(values)}d", len(values), *values)
