"""Epochs of light curves regrouped by sky tile, in bounded column blocks.

Rows are dealt in ranges of (tile, object, time) and sorted within, so a tile of
very many epochs is cut over tasks like any other stretch of rows. A task goes
through its rows once and closes a block when it has ``BLOCK`` epochs or the
tile changes: no tile, and no light curve, is ever held whole. A block is a row
with its tile, its first and last object and time, and its columns delta-coded
and compressed; a read filters blocks by tile and object in the scan and decodes
what is left.

Defined results: epochs without a position, object or time are left out, as are
those that ``good`` refuses; equal epochs all stay; columns come back bit for
bit (nulls as nulls, NaN too); an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.sky import finite
from orrery.operators.skyindex import cone_cover, in_ranges, sky_pixel

#: Epochs of a block.
BLOCK = 65_536
#: Of tiles: 0.9 degrees.
ORDER = 6
_CODEC = pa.Codec("zstd")
_HEADER = "tile long, epochs int, first_object long, last_object long, first_time double, last_time double, columns array<binary>"


def good_epoch(flags: str | None, magnitude: str, error: str) -> Column:
    """No flag set, and a positive finite magnitude with a positive finite error."""
    fine = (finite(magnitude) > 0) & (finite(error) > 0)
    return F.coalesce(fine & (F.col(flags) == 0) if flags else fine, F.lit(False))


def packed(column: pa.Array) -> bytes:
    """Eight-byte values as differences of their bits, byte by byte in planes, compressed; and where the nulls are."""
    nulls = np.packbits(column.is_null().to_numpy(zero_copy_only=False)).tobytes() if column.null_count else b""
    bits = (column.fill_null(0) if nulls else column).to_numpy().view(np.uint64)
    steps = bits.copy()
    steps[1:] -= bits[:-1]
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
    return struct.pack("<II", len(bits), len(nulls)) + nulls + _CODEC.compress(planes, asbytes=True)


def unpacked(raw: bytes, kind: pa.DataType) -> pa.Array:
    n, size = struct.unpack_from("<II", raw)
    planes = _CODEC.decompress(raw[8 + size :], 8 * n, asbytes=True)
    bits = np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    values = bits.view(np.int64 if pa.types.is_integer(kind) else np.float64)
    mask = np.unpackbits(np.frombuffer(raw[8 : 8 + size], np.uint8))[:n].astype(bool) if size else None
    return pa.array(values, kind, mask=mask, from_pandas=False)


def write_tiles(epochs: DataFrame, path: str, columns: list[str], *, ra: str = "ra", dec: str = "dec", object_col: str = "object", time_col: str = "time", order: int = ORDER, good: Column | None = None, files: int | None = None, block: int = BLOCK) -> None:
    """Write epochs (one a row) as blocks by tile; ``columns`` are the values kept besides object and time, longs or doubles.

    Light curves with an array of epochs a row are exploded by the caller.
    """
    kinds = dict(epochs.dtypes)
    for c in columns:
        if kinds[c] not in ("bigint", "double"):
            raise ValueError(f"{c}: {kinds[c]}; blocks hold bigint and double")
    kept = epochs.filter(good) if good is not None else epochs
    # the place is tested, not the tile: a filter on it would work it out without sharing its parts
    kept = kept.filter(finite(ra).isNotNull() & finite(dec).isNotNull())
    rows = kept.select(sky_pixel(ra, dec, order).alias("tile"), F.col(object_col).cast("long").alias("object"), F.col(time_col).cast("double").alias("time"), *columns).dropna(subset=["object", "time"])
    keys = ["tile", "object", "time"]
    dealt = (rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def closed(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            """The blocks between the rows given, as one batch."""
            cols = [c.combine_chunks() for c in rows.columns]
            tile, obj, time = (c.to_numpy() for c in cols[:3])
            raws = [[packed(c.slice(a, b - a)) for c in cols[1:]] for a, b in zip(starts.tolist(), ends.tolist())]
            values = [tile[starts], (ends - starts).astype(np.int32), obj[starts], obj[ends - 1], time[starts], time[ends - 1]]
            return pa.RecordBatch.from_arrays([*map(pa.array, values), pa.array(raws, pa.list_(pa.binary()))], ["tile", "epochs", "first_object", "last_object", "first_time", "last_time", "columns"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            waiting = pa.concat_tables([waiting, table]) if waiting is not None else table
            tiles = waiting.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(tiles[1:] != tiles[:-1]) + 1, len(tiles)]
            starts = np.concatenate([np.arange(a, b, block) for a, b in zip(edges, edges[1:])])
            ends = np.r_[starts[1:], len(tiles)]
            if ends[-1] - starts[-1] < block:  # the last tile may go on
                starts, ends = starts[:-1], ends[:-1]
            if len(starts):
                yield closed(waiting, starts, ends)
                waiting = waiting.slice(ends[-1]) if ends[-1] < len(tiles) else None
        if waiting is not None:
            yield closed(waiting, np.array([0]), np.array([len(waiting)]))

    dealt.mapInArrow(blocks, _HEADER).write.mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str, columns: dict[str, str], *, tiles: list[tuple[int, int]] | None = None, objects: tuple[int, int] | None = None) -> DataFrame:
    """Epochs (tile, object, time and ``columns``, types by name) of ranges of tiles and a range of objects; all where none are given."""
    rows = spark.read.parquet(path)
    if tiles is not None:
        rows = rows.filter(in_ranges("tile", tiles))
    if objects is not None:
        rows = rows.filter((F.col("first_object") <= objects[1]) & (F.col("last_object") >= objects[0]))
    kinds = [pa.int64(), pa.float64(), *(pa.int64() if t in ("long", "bigint") else pa.float64() for t in columns.values())]
    names = ["tile", "object", "time", *columns]

    def epochs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for tile, n, raws in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts.append(pa.RecordBatch.from_arrays([pa.array(np.full(n, tile)), *(unpacked(r, k) for r, k in zip(raws, kinds))], names))
                held += n
                if held >= BLOCK:
                    yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    parts, held = [], 0
            if held:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    schema = ", ".join(["tile long", "object long", "time double", *(f"`{c}` {t}" for c, t in columns.items())])
    found = rows.select("tile", "epochs", "columns").mapInArrow(epochs, schema)
    return found.filter(F.col("object").between(*objects)) if objects is not None else found


def cone_tiles(ra: float, dec: float, radius: float, order: int = ORDER) -> list[tuple[int, int]]:
    """Ranges of tiles that hold a cone."""
    return cone_cover(ra, dec, radius, order)
