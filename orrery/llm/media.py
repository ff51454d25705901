"""Media columns: payloads as 8-bit audio, stored as content-defined chunks.

A payload is stored as mono PCM with one unsigned 8-bit sample per byte (a WAVE
file). Its samples are cut where a rolling gear hash of the last 32 bytes meets
a mask, so that equal passages give equal chunks wherever they stand. Chunks
that occur more than once in the table are stored once and joined in by digest
when a media file is read; chunks of one file stay with it. The ordered chunk
list rebuilds the file, whose digest is verified.

How the store comes about: chunk digests are counted over the whole table; the
repeated ones are marked in a bitmap of fixed size (``BITS``). A file's chunk
outside the bitmap is unique and stays inline. Others (repeated ones, and a few
that share a bit) go to the chunk table, of which a Spark join keeps one row
per digest. So only they are ever shuffled.

Defined results: a null text is an empty payload (64 zero samples after
padding); repeated rows are stored as rows of their own that share their
chunks; an empty table gives an empty result; a file is read back as one row
and so must fit in memory, as its text does.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import staged

UNIT = 64  # payloads are padded to a multiple
RATE = 8000
SMALLEST, LARGEST, MASK_BITS = 512, 16_384, 11
BITS = 1 << 22
#: 32-bit gear values of the byte values, from a fixed seed.
GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, np.uint32)
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
HEADER_BYTES = HEADER.size


def wave_header(samples: int) -> bytes:
    return HEADER.pack(b"RIFF", 36 + samples, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", samples)


def wave_samples(media: bytes) -> bytes:
    """The samples of a stored file; ValueError if it isn't such a file."""
    riff, _, wave, fmt, _, codec, channels, _, _, _, bits, data, n = HEADER.unpack_from(media)
    if (riff, wave, fmt, data, codec, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != HEADER.size + n:
        raise ValueError("not an 8-bit mono wave file")
    return media[HEADER.size :]


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h -> 2h + G[byte] of the last 32 bytes, at every byte."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def chunk_ends(payloads: list[bytes]) -> list[list[int]]:
    """Where each payload is cut: the chunks' ends, the last of which is its length."""
    out = []
    data = np.frombuffer(b"".join(payloads), np.uint8)
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    base = 0
    for p in payloads:
        n, last, ends = len(p), 0, []
        for m in (marks[slice(*np.searchsorted(marks, (base + SMALLEST, base + n)))] - base).tolist():
            while m - last > LARGEST:
                last += LARGEST
                ends.append(last)
            if m - last >= SMALLEST:
                ends.append(m)
                last = m
        while n - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if n > last:
            ends.append(n)
        out.append(ends)
        base += n
    return out


def _payloads(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[bytes]], list[list[bytes]]]]:
    """(rows, payloads before padding, chunks, chunk digests), a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            raw = [(t or "").encode() for t in part.column(1).to_pylist()]
            full = [padded(r) for r in raw]
            chunks = [[p[a:b] for a, b in zip([0, *ends], ends)] for p, ends in zip(full, chunk_ends(full))]
            yield part, raw, chunks, [[hashlib.blake2b(c, digest_size=16).digest() for c in own] for own in chunks]


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") % BITS


@dataclass
class MediaStore:
    """A table of files and the chunks that they share.

    files: row (of this table, unique), doc_id, n_bytes, media_bytes,
    media_sha256, refs (the digests of the file's chunks that are in the chunk
    table, with their places), inline (the other chunks with theirs,
    compressed). given: digest, shard (the task that wrote it), chunk
    (compressed); owner: the shard whose copy of a digest counts.
    """

    files: DataFrame
    given: DataFrame
    owner: DataFrame

    def chunks(self) -> DataFrame:
        """The chunk table, one row per digest."""
        return self.given.join(self.owner, ["digest", "shard"]).select("digest", "chunk")


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> MediaStore:
    """Store every text as a media file."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, own in _payloads(batches):
            yield pa.RecordBatch.from_arrays([pa.array([d for row in own for d in row], pa.binary())], ["digest"])

    repeated = picked.mapInArrow(digests, "digest binary").groupBy("digest").count().filter("count > 1")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({_bit(d) for d in batch.column(0).to_pylist()}), pa.int32())], ["bit"])

    marked = np.zeros(BITS, bool)  # at most BITS rows come back
    marked[repeated.select("digest").mapInArrow(bits, "bit int").distinct().toArrow().column("bit").to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    entry = pa.list_(pa.struct([("seq", pa.int32()), ("digest", pa.binary())]))
    inline = pa.list_(pa.struct([("seq", pa.int32()), ("chunk", pa.binary())]))
    fields = ["row", "doc_id", "n_bytes", "media_bytes", "media_sha256", "refs", "inline", "digest", "chunk"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), entry, inline, pa.binary(), pa.binary()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_, hit = zstandard.ZstdCompressor(level=3), np.unpackbits(sent.value)
        row, given = TaskContext.get().partitionId() << 36, set()
        for part, raw, chunks, names in _payloads(batches):
            files, shared = [], []
            for doc, r, own, dd in zip(part.column(0).to_pylist(), raw, chunks, names):
                media = hashlib.sha256(wave_header(sum(map(len, own))))
                for c in own:
                    media.update(c)
                refs, kept = [], []
                for seq, (c, d) in enumerate(zip(own, dd)):
                    if not hit[_bit(d)]:
                        kept.append({"seq": seq, "chunk": zip_.compress(c)})
                        continue
                    refs.append({"seq": seq, "digest": d})
                    if d not in given:
                        if len(given) < 200_000:  # a chunk given twice is dropped by the join
                            given.add(d)
                        shared.append((row >> 36, None, None, None, None, None, None, d, zip_.compress(c)))
                files.append((row, doc, len(r), HEADER_BYTES + sum(map(len, own)), media.hexdigest(), refs, kept, None, None))
                row += 1
            cols = zip(*files, *shared)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], fields)

    schema = "row long, doc_id long, n_bytes long, media_bytes long, media_sha256 string, refs array<struct<seq:int,digest:binary>>, inline array<struct<seq:int,chunk:binary>>, digest binary, chunk binary"
    written = staged(picked.mapInArrow(write, schema), "media")
    files = written.filter(F.col("digest").isNull()).drop("digest", "chunk")
    given = written.filter(F.col("digest").isNotNull()).select("digest", F.col("row").alias("shard"), "chunk")
    owner = staged(given.groupBy("digest").agg(F.min("shard").alias("shard")), "media-owner")
    return MediaStore(files, given, owner)


def read_media(store: MediaStore, features=None) -> DataFrame:
    """Rebuild stored files from their ordered chunk lists and verify them.

    Columns: doc_id, n_bytes, media_bytes, media_sha256 (verified against the
    rebuilt file, else an error) and, of the samples read back, payload_bytes,
    payload_sha256, tail (the last 64) and feature (``features`` of the
    samples). Without ``features`` also media, the rebuilt file itself.
    """
    files = store.files
    refs = files.filter(F.size("refs") > 0).select("row", F.explode("refs").alias("r")).select("row", "r.seq", "r.digest")
    # the small rows meet first, so that chunks move once
    borrowed = refs.join(store.owner, "digest").join(store.given, ["digest", "shard"]).groupBy("row").agg(F.collect_list(F.struct("seq", "chunk")).alias("lent"))
    none = F.lit(None).cast("array<struct<seq:int,chunk:binary>>")
    rows = files.filter(F.size("refs") == 0).withColumn("lent", none).unionByName(files.filter(F.size("refs") > 0).join(borrowed, "row", "left"))
    whole = features is None

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    own = sorted({(x["seq"], x["chunk"]) for x in [*(r["inline"] or []), *(r["lent"] or [])]})
                    samples = b"".join(unzip.decompress(c) for _, c in own)
                    media = wave_header(len(samples)) + samples
                    if len(media) != r["media_bytes"] or hashlib.sha256(media).hexdigest() != r["media_sha256"]:
                        raise ValueError(f"media of document {r['doc_id']} is damaged")
                    got = wave_samples(media)
                    feature = None if whole else features(got)
                    out.append((r["doc_id"], r["n_bytes"], len(got), hashlib.sha256(got).hexdigest(), got[-UNIT:], len(media), r["media_sha256"], feature, media if whole else None))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail", "media_bytes", "media_sha256", "feature", "media"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    cols = rows.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "inline", "lent")
    out = cols.mapInArrow(rebuild, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail binary, media_bytes long, media_sha256 string, feature string, media binary")
    return out if whole else out.drop("media")


def sound_features(samples: bytes) -> str:
    """Loudness and spectrum of 8-bit samples, as text: mean, deviation, zero crossings, and the energy shares of four bands of sample differences."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    bands = [float(np.mean((x[lag:] - x[:-lag]) ** 2)) for lag in (1, 2, 4, 8)]
    return f"mean={x.mean():.4f};dev={x.std():.4f};crossings={crossings};" + ";".join(f"d{lag}={b:.3f}" for lag, b in zip((1, 2, 4, 8), bands))
