"""Near-duplicate documents by consistent weighted sampling.

A document is a weighted set of its five-word shingles: a shingle's weight is
its count in the document times its inverse document frequency, 1 + ln((1 + N)
/ (1 + df)), with df counted over all documents. Improved consistent weighted
sampling draws ``BANDS * ROWS`` samples; two documents agree in a sample with
the probability of their weighted Jaccard similarity. Documents that agree in
all samples of a band meet in a bucket.

1. Texts go into shards of bounded size, in which equal texts (after
   lower-casing) are one. Every shard sends its distinct shingles, in ranges of
   their hashes, to be counted; what it gets back are the df of those that
   another document has too. Only packed arrays are shuffled.
2. Weight in shingles that no other document has is private. Where it is more
   than ``1 - threshold`` of the whole, no document can be near. For the others
   samples are drawn, and the shingles that they share are kept.
3. Every member of a bucket is compared with the bucket's pivot, the member of
   the least private share (an unedited original links its edited copies).
   Linked nodes form components. Two such rounds; in the second, a bucket whose
   members are in several components gets a pivot outside that of the first.
4. In buckets that still hold several components, all members but those of the
   largest are compared, block by block, with the members of other components
   in blocks of like total weight: every pair of different components that is
   near by its samples is verified. Only links leave a pair of blocks.

Every link is verified: weighted Jaccard similarity of at least ``threshold``.
The classes are the connected components of the links.

The copies of a text count in the df of its shingles: the more there are, the
less weighs what they share, and the more what one of them has changed, until
they are no longer near one another. ``by_count`` therefore links the pairs,
too, whose Jaccard similarity by counts alone reaches the threshold, which does
not depend on the size of a group or of the table. Steps 2 to 4 run for both
weightings, each with its own samples, buckets, pivots and blocks.

Defined results: null and empty texts are one class of equal texts; texts of
fewer than five words have one shingle, the whole text; very long texts are a
shard of their own; repeated rows are in one class; null ids are allowed (a
class's id is its least id that is not null); an empty table gives an empty
result; only the id and the text are read, whatever else the columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.substrings import word_bounds
from orrery.llm.suffixes import BYTE_VALUES
from orrery.llm.windows import Hasher, mix
from orrery.operators.entity import connected_components
from orrery.session import staged

SHINGLE = 5
BANDS, ROWS = 16, 4
BLOCK = 256
#: Bytes of text in a shard (a longer text is one alone) and shingles in a range of hashes.
SHARD_BYTES, RANGE_SHINGLES = 2 << 20, 1 << 19
#: A shingle's hash has so many bits more than there are shingles, so that one in 2**SPARE meets another by chance.
SPARE = 22
_rng = np.random.default_rng(7)
SEEDS = _rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
#: Quantiles of the Gamma(2, 1) distribution, at the middles of 4096 equal parts.
_grid = np.linspace(0, 30, 600_001)
GAMMA = np.interp((np.arange(4096) + 0.5) / 4096, 1 - np.exp(-_grid) * (1 + _grid), _grid).astype(np.float32)
LOG_GAMMA, INVERSE_GAMMA = np.log(GAMMA), 1 / GAMMA

#: Shingles (ascending), their weights, and the weight of the whole document.
Weighted = tuple[np.ndarray, np.ndarray, float]


def normal(text: Column) -> Column:
    """The text that is compared; null as empty."""
    return F.lower(F.coalesce(text, F.lit("")))


def node_of(text: Column) -> Column:
    """Digest of a normalised text: equal texts are one node."""
    return F.unhex(F.md5(text.cast("binary")))


def shingles(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the shingles of texts that stand one after another, each with a space after it."""
    starts, ends = word_bounds(raw)
    hashed = Hasher(BYTE_VALUES[np.frombuffer(raw, np.uint8)])
    words = mix(hashed(starts, ends) + (ends - starts).astype(np.uint64))
    edges = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
    n = np.diff(edges)
    k = np.minimum(n, SHINGLE)
    own = np.where(n > 0, n - k + 1, 0)
    text = np.repeat(np.arange(len(sizes)), own)
    first = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own) + edges[:-1][text]
    return text, Hasher(words)(first, first + k[text])


class Shard:
    """The distinct shingles of some texts, and which text has which, how often."""

    def __init__(self, raw: bytes, sizes: np.ndarray, bits: int):
        text, found = shingles(raw, sizes)
        found >>= np.uint64(64 - bits)
        order = np.argsort(found)
        ascending = found[order]
        first = np.r_[True, ascending[1:] != ascending[:-1]][: len(found)]
        self.ids = ascending[first]
        n = max(1, len(self.ids))
        place = np.empty(len(found), np.int64)
        place[order] = np.cumsum(first) - 1
        cells, self.counts = np.unique(text * n + place, return_counts=True)
        self.text, self.place = cells // n, cells % n
        self.edges = np.searchsorted(self.text, np.arange(len(sizes) + 1))


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpack(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, "<u8"), dtype=np.uint64)


def similarity(a: Weighted, b: Weighted) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = a[2] + b[2] - both
    return both / total if total else 1.0


def samples(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Improved consistent weighted samples, one row per (non-empty) set of shingles and weights.

    For each sample every shingle draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from
    bits of its hash that don't overlap; with t = floor(ln w / r + b) and ln y =
    r (t - b), the shingle of the least ln c - ln y - r is sampled together with
    its t. The least value itself, being a function of both, stands for them.
    """
    keys = np.concatenate([s[0] for s in sets])
    log_w = np.log(np.concatenate([s[1] for s in sets])).astype(np.float32)
    starts = np.r_[0, np.cumsum([len(s[0]) for s in sets])[:-1]]
    out = np.empty((len(sets), len(SEEDS)), np.float32)
    for s, seed in enumerate(SEEDS):
        h = keys * seed
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = (h >> np.uint64(52)).astype(np.intp)
        beta = (h >> np.uint64(8)).astype(np.uint32).astype(np.float32)
        beta *= np.float32(2**-32)
        r = GAMMA[at]
        value = log_w * INVERSE_GAMMA[at]
        value += beta
        np.floor(value, out=value)
        value -= beta
        value += 1
        value *= r
        np.subtract(LOG_GAMMA[(h >> np.uint64(40)).astype(np.intp) & 4095], value, out=value)
        out[:, s] = np.minimum.reduceat(value, starts)
    return out


def band_keys(drawn: np.ndarray, first: int = 1) -> np.ndarray:
    """A 64-bit bucket per row and band; bands are numbered from ``first``."""
    bits = mix(drawn.view(np.uint32).astype(np.uint64)).reshape(len(drawn), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(first, first + BANDS, dtype=np.uint64)), (len(drawn), BANDS))
    for i in range(ROWS):
        key = mix(key ^ bits[:, :, i])
    return key.view(np.int64)


def _shards(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts in shards: shard, documents, and of its distinct texts nodes, copies, least (id), sizes and texts (compressed)."""
    kind = dict(docs.dtypes)[id_col]
    picked = docs.select(normal(F.col(text_col)).alias("text"), F.col(id_col).alias("id"))
    picked = picked.select("text", "id", node_of(F.col("text")).alias("node"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(3)
        shard, held, size, least_kind = TaskContext.get().partitionId() << 32, {}, 0, None

        def flush() -> pa.RecordBatch:
            texts = b"".join(h[2] + b" " for h in held.values())
            cols = [
                pa.array([shard]), pa.array([sum(h[0] for h in held.values())]), pa.array([list(held)], pa.list_(pa.binary())), pa.array([[h[0] for h in held.values()]], pa.list_(pa.int64())),
                pa.array([[h[1] for h in held.values()]], pa.list_(least_kind)), pa.array([[len(h[2]) + 1 for h in held.values()]], pa.list_(pa.int64())), pa.array([zip_.compress(texts)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["shard", "documents", "nodes", "copies", "least", "sizes", "texts"])

        for batch in batches:
            least_kind = batch.column(1).type
            for text, own, node in zip(*(c.to_pylist() for c in batch.columns)):
                if node not in held:
                    raw = text.encode()
                    if held and size + len(raw) > SHARD_BYTES:
                        yield flush()
                        shard, held, size = shard + 1, {}, 0
                    held[node] = [0, own, raw]
                    size += len(raw) + 64
                h = held[node]
                h[0] += 1
                if own is not None and (h[1] is None or own < h[1]):
                    h[1] = own
        if held:
            yield flush()

    return picked.mapInArrow(gather, f"shard long, documents long, nodes array<binary>, copies array<bigint>, least array<{kind}>, sizes array<bigint>, texts binary")


def _shard_of(row: dict, bits: int) -> Shard:
    import zstandard

    return Shard(zstandard.ZstdDecompressor().decompress(row["texts"]), np.array(row["sizes"], np.int64), bits)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that only one shard is unpacked."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def document_frequencies(shards: DataFrame, bits: int, ranges: int) -> DataFrame:
    """(shard, range, found) for the shards' shingles, in ranges of their hashes.

    found: a compressed bit per shingle of the shard in that range (in order),
    set where more than one document has the shingle, and the number of
    documents of those.
    """
    shift = np.uint64(bits - (ranges - 1).bit_length()) if ranges > 1 else np.uint64(63)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = _shard_of(row, bits)
            df = np.bincount(s.place, np.array(row["copies"], np.float64)[s.text], len(s.ids)).astype(np.uint32)
            parts, starts = np.unique(s.ids >> shift, return_index=True)
            ends = np.r_[starts[1:], len(s.ids)]
            cols = [pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), row["shard"])), pa.array([pack_sorted(s.ids[a:b]) for a, b in zip(starts, ends)], pa.binary()), pa.array([pack(df[a:b]) for a, b in zip(starts, ends)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["range", "shard", "ids", "df"])

    def count(rows: pa.Table) -> pa.Table:
        ids = [unpack_sorted(x) for x in rows.column("ids").to_pylist()]
        edges = np.cumsum([0, *map(len, ids)])
        every, df = np.concatenate(ids), np.concatenate([unpack(x, "<u4") for x in rows.column("df").to_pylist()])
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(every[order]) > 0])
        total = np.empty(len(every), np.uint32)
        total[order] = np.repeat(np.add.reduceat(df[order].astype(np.uint64), first), np.diff(np.r_[first, len(every)]))
        found = [pack_found(total[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        out = pa.table({"shard": rows.column("shard"), "range": rows.column("range"), "found": pa.array(found, pa.binary())})
        return out.filter(pa.compute.is_valid(out.column("found")))

    asked = shards.select("shard", "copies", "sizes", "texts").mapInArrow(ask, "range int, shard long, ids binary, df binary")
    return asked.groupBy("range").applyInArrow(count, "shard long, range int, found binary")


def pack_found(df: np.ndarray) -> bytes | None:
    """Null if there is none of two documents or more."""
    several = df > 1
    if not several.any():
        return None
    bits = np.packbits(several).tobytes()
    return len(bits).to_bytes(4, "little") + bits + pack(df[several])


def unpack_found(raw: bytes, df: np.ndarray) -> None:
    """Enter what ``pack_found`` gave into ``df``, of 1 so far."""
    n = int.from_bytes(raw[:4], "little")
    several = np.unpackbits(np.frombuffer(raw[4 : 4 + n], np.uint8), count=len(df)).astype(bool)
    df[several] = unpack(raw[4 + n :], "<u4")


#: What a node has of a weighting: by count times inverse document frequency, and by count alone.
VIEWS = (("total", "share", "sig", "keys", "weights"), ("count", "count_share", "count_sig", "count_keys", "counts"))


def _drawn(shards: DataFrame, answers: DataFrame, documents: int, bits: int, ranges: int, threshold: float, kind: str, by_count: bool) -> DataFrame:
    """Each shard's nodes: node, copies, least and, where another can be near, ids and (of each weighting, null for counts without ``by_count``) total, share (of private weight), sig, keys and weights."""
    shift = np.uint64(bits - (ranges - 1).bit_length()) if ranges > 1 else np.uint64(63)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.schema.field("least").type
            for row in _rows([batch]):
                s, n = _shard_of(row, bits), len(row["nodes"])
                df = np.ones(len(s.ids), np.int64)
                for a in row["answers"] or []:
                    lo, hi = np.searchsorted(s.ids >> shift, (a["range"], a["range"] + 1))
                    unpack_found(a["found"], df[lo:hi])
                shared = df[s.place] > 1
                ids, views = [None] * n, []
                for view in range(len(VIEWS)):
                    weights = s.counts.astype(np.float32) if view else (s.counts * (1 + np.log((1 + documents) / (1 + df)))[s.place]).astype(np.float32)
                    total = np.bincount(s.text, weights, n)
                    share = np.bincount(s.text, np.where(shared, 0, weights), n) / np.maximum(total, 1e-9)
                    open_ = np.flatnonzero((total > 0) & (share <= 1 - threshold + 1e-6) & (by_count or not view))
                    sigs, keys, held = ([None] * n for _ in range(3))
                    for at in range(0, len(open_), 512):
                        own = open_[at : at + 512]
                        cells = [slice(s.edges[i], s.edges[i + 1]) for i in own]
                        drawn = samples([(s.ids[s.place[c]], weights[c]) for c in cells])
                        short = (mix(drawn.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
                        for i, c, sig, key in zip(own.tolist(), cells, short, band_keys(drawn, 1 + view * BANDS)):
                            some = shared[c]
                            sigs[i], keys[i], held[i] = sig.tobytes(), key, pack(weights[c][some])
                            ids[i] = ids[i] or pack_sorted(s.ids[s.place[c]][some])
                    near = np.isin(np.arange(n), open_)
                    views += [pa.array(np.where(near, x, 0), mask=~near) for x in (total, share)]
                    views += [pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(held, pa.binary())]
                cols = [pa.array(row["nodes"], pa.binary()), pa.array(row["copies"], pa.int64()), pa.array(row["least"], least.value_type), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *views], ["node", "copies", "least", "ids", *VIEWS[0], *VIEWS[1]])

    answered = answers.groupBy("shard").agg(F.collect_list(F.struct("range", "found")).alias("answers"))
    both = shards.select("shard", "nodes", "copies", "least", "sizes", "texts").join(answered, "shard", "left")
    views = ", ".join(f"{name} {t}" for view in VIEWS for name, t in zip(view, ("double", "double", "binary", "array<bigint>", "binary")))
    return both.mapInArrow(draw, f"node binary, copies long, least {kind}, ids binary, {views}")


def weighted_nodes(docs: DataFrame, threshold: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text", by_count: bool = False) -> DataFrame:
    """Staged ``_drawn`` of all documents."""
    kind = dict(docs.dtypes)[id_col]
    shards = staged(_shards(docs, id_col, text_col), "neardup-shards")
    size = shards.select(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)).alias("bytes")).first()
    bits = min(64, SPARE + (size["bytes"] // 4).bit_length())
    ranges = 1 << (size["bytes"] // 4 // RANGE_SHINGLES).bit_length()
    return staged(_drawn(shards, document_frequencies(shards, bits, ranges), size["n"], bits, ranges, threshold, kind, by_count), "neardup-drawn")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text", near: float = 0.64, by_count: bool = False) -> DataFrame:
    """One row per document: the id, class_id, class_size (documents), keep and node.

    keep is true for the class's row of the least id (and rows equal to it);
    node is the digest of the text.
    ``near``: the share of equal samples from which a pair is verified in the
    last step (of pairs at 0.8, six in ten thousand have fewer). ``by_count``:
    link pairs that reach the threshold by counts alone, too.
    """
    drawn = weighted_nodes(docs, threshold, id_col=id_col, text_col=text_col, by_count=by_count)
    open_ = drawn.filter("ids is not null")
    members = open_.select(F.explode("keys").alias("key"), "node", "share", F.lit(0).alias("view"))
    if by_count:
        members = members.unionByName(open_.select(F.explode("count_keys").alias("key"), "node", F.col("count_share").alias("share"), F.lit(1).alias("view")))
    pivot = F.min(F.struct("share", "node"))
    buckets = staged(members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), pivot.alias("p")).filter("a <> b").select("key", F.col("p.node").alias("pivot")), "neardup-buckets")
    members = staged(members.join(buckets, "key").distinct(), "neardup-members")
    sets = staged(open_.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).drop("copies", "least", "keys", "count_keys"), "neardup-sets")

    pairs = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    links = staged(_verified(pairs.distinct(), sets, threshold), "neardup-links")
    parts = staged(connected_components(links), "neardup-parts")
    labelled = staged(_labelled(members, parts), "neardup-labelled")
    pairs = _outer_pairs(labelled)
    more = staged(_verified(pairs.distinct(), sets, threshold), "neardup-links")
    links = links.unionByName(more)
    parts = staged(connected_components(links), "neardup-parts")

    more = staged(_verified_blocks(_labelled(members, parts), sets, threshold, near), "neardup-links")
    if not more.isEmpty():
        parts = staged(connected_components(links.unionByName(more)), "neardup-parts")

    named = drawn.groupBy("node").agg(F.min("least").alias("least"), F.sum("copies").alias("copies"))
    named = staged(named.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "neardup-named")
    row = F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("node"))
    classes = named.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.min(row).alias("first"))
    of_node = staged(named.join(classes, "component").select("node", "class_id", "class_size", "first"), "neardup-of-node")
    out = docs.select(F.col(id_col).alias("id"), node_of(normal(F.col(text_col))).alias("node")).join(of_node, "node")
    keep = (F.col("node") == F.col("first.node")) & F.col("id").eqNullSafe(F.col("first.least"))
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", keep.alias("keep"), "node")


def _labelled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with their components, of the buckets that hold several."""
    labelled = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    return labelled.join(mixed, "key", "left_semi")


def _outer_pairs(labelled: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's second pivot, which is outside the first one's component, with the members of other components."""
    first = labelled.filter("node = pivot").select("key", F.col("component").alias("first"))
    outer = labelled.join(first, "key").filter("component <> first").groupBy("key").agg(F.min(F.struct("share", "node", "component")).alias("p"))
    met = labelled.join(outer.select("key", F.col("p.node").alias("a"), F.col("p.component").alias("own")), "key")
    return met.filter("component <> own and node <> pivot").select("a", F.col("node").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold, in one weighting."""
    values = [(whole, weights) for whole, _, _, _, weights in VIEWS]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[Weighted | None]] = {}

        def sets_of(x: dict) -> list[Weighted | None]:
            if x["node"] not in known:
                if len(known) > 64:
                    known.clear()
                ids = unpack_sorted(x["ids"])
                known[x["node"]] = [(ids, unpack(x[weights], "<f4"), x[whole]) if x[weights] is not None else None for whole, weights in values]
            return known[x["node"]]

        for batch in batches:
            rows = [(x["node"], y["node"]) for x, y in zip(*(c.to_pylist() for c in batch.columns)) if any(a and b and similarity(a, b) >= threshold for a, b in zip(sets_of(x), sets_of(y)))]
            cols = zip(*rows) if rows else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], ["a", "b"])

    own = F.struct("node", "ids", *(name for pair in values for name in pair))
    one = pairs.join(sets.select(F.col("node").alias("b"), own.alias("y")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), own.alias("x")), "a")
    return both.select("x", "y").mapInArrow(verify, "a binary, b binary")


def similarities(a: list[Weighted], b: list[Weighted], columns: int = 4096) -> np.ndarray:
    """``similarity`` of every set of ``a`` with every one of ``b``.

    With v1 < v2 < ... the weights that a shingle has anywhere, the lesser of
    two weights is the sum of the steps v(k) - v(k-1) that both reach, so that
    the sums of lesser weights are a product of matrices.
    """
    sets = a + b
    keys, weights = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
    weights = weights.astype(np.float64)
    rows = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    order = np.lexsort((weights, keys))
    keys, weights, rows = keys[order], weights[order], rows[order]
    first = np.r_[True, keys[1:] != keys[:-1]]
    level = np.flatnonzero(first | np.r_[True, weights[1:] != weights[:-1]])
    own = np.searchsorted(level, np.arange(len(keys)), "right") - 1  # the level that an entry just reaches
    starts = first[level]
    step = weights[level] - np.where(starts, 0, np.r_[0, weights[level][:-1]])
    depth = (np.arange(len(level)) - np.maximum.accumulate(np.where(starts, np.arange(len(level)), 0)))[own] + 1
    reached = np.repeat(own, depth) - (np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth))
    rows = np.repeat(rows, depth)
    left = rows < len(a)
    shared = np.intersect1d(reached[left], reached[~left])
    both = np.zeros((len(a), len(b)))
    held = np.isin(reached, shared)
    reached, rows = np.searchsorted(shared, reached[held]), rows[held]
    order = np.argsort(reached, kind="stable")
    reached, rows = reached[order], rows[order]
    for at in range(0, len(shared), columns):
        lo, hi = np.searchsorted(reached, (at, at + columns))
        wide = np.zeros((len(sets), min(columns, len(shared) - at)))
        wide[rows[lo:hi], reached[lo:hi] - at] = 1
        both += (wide[: len(a)] * step[shared[at : at + columns]]) @ wide[len(a) :].T
    total = np.array([s[2] for s in sets])
    return both / np.maximum(total[: len(a), None] + total[None, len(a) :] - both, 1e-12)


def _verified_blocks(labelled: DataFrame, sets: DataFrame, threshold: float, near: float) -> DataFrame:
    """Links (a, b) between components, of all pairs of the blocks that meet.

    Members of a bucket's largest component only meet those of others. A block
    holds members of like total weight (``band``: a pair at the threshold is at
    most one apart). Of the links of two blocks, those are given that connect
    the same components.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Weighted] = {}

        def set_of(o: dict) -> Weighted:
            if o["node"] not in known:
                if len(known) > 4 * BLOCK:
                    known.clear()
                known[o["node"]] = unpack_sorted(o["ids"]), unpack(o["weights"], "<f4"), o["total"]
            return known[o["node"]]

        def links(a: list[dict], b: list[dict]) -> list[tuple[bytes, bytes]]:
            sigs = [np.frombuffer(b"".join(o["sig"] for o in side), np.uint16).reshape(len(side), -1) for side in (a, b)]
            number: dict[bytes, int] = {}
            kinds = [np.array([number.setdefault(o["component"], len(number)) for o in side]) for side in (a, b)]
            whole = [np.array([o["total"] for o in side]) for side in (a, b)]
            private = [np.array([o["share"] for o in side]) * w for side, w in zip((a, b), whole)]
            # what can be common, over what the union is then at least
            common = np.minimum((whole[0] - private[0])[:, None], whole[1] - private[1])
            open_pairs = common >= (threshold - 1e-6) * (whole[0][:, None] + whole[1] - common)
            open_pairs &= kinds[0][:, None] != kinds[1]
            for i in np.flatnonzero(open_pairs.any(1)):
                open_pairs[i] &= (sigs[0][i] == sigs[1]).mean(1) >= near
            i, j = np.flatnonzero(open_pairs.any(1)), np.flatnonzero(open_pairs.any(0))
            if not len(i):
                return []
            left, right = [set_of(a[x]) for x in i], [set_of(b[x]) for x in j]
            found = similarities(left, right)
            close = open_pairs[np.ix_(i, j)] & (found >= threshold - 1e-9)
            leader, out = list(range(len(number))), []

            def find(k: int) -> int:
                while leader[k] != k:
                    leader[k] = k = leader[leader[k]]
                return k

            for x, y in zip(*(v.tolist() for v in np.nonzero(close))):
                u, v = find(int(kinds[0][i[x]])), find(int(kinds[1][j[y]]))
                # At the threshold, the sum's order decides: the same one everywhere.
                if u != v and (found[x, y] >= threshold + 1e-9 or similarity(left[x], right[y]) >= threshold):
                    leader[max(u, v)] = min(u, v)
                    out.append((a[i[x]]["node"], b[j[y]]["node"]))
            return out

        for row in _rows(batches):
            rows = links(row["x"], row["y"])
            cols = zip(*rows) if rows else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], ["a", "b"])

    labelled = staged(labelled.select("key", "node", "component", "view"), "neardup-labelled")
    counts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    tops = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"))
    seeking = F.col("component") != F.col("top.component")
    band = F.floor(F.log(F.greatest("total", F.lit(1e-9))) / float(-np.log(threshold - 1e-6))).cast("int")
    slots = F.ceil(F.when(seeking, F.col("size") - F.col("top.n")).otherwise(F.col("top.n")) / BLOCK).cast("int")
    placed = labelled.join(tops, "key").select("key", "node", "component", "view", seeking.alias("seeking"), F.pmod(F.xxhash64("node"), slots).cast("int").alias("slot"))
    # a bucket is of one weighting
    of_view = [F.when(F.col("view") == 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(*VIEWS) if a != "keys"]
    placed = placed.join(sets, "node").select("key", "node", "component", "seeking", "slot", "ids", *of_view).withColumn("band", band)
    own = F.struct("node", "component", "sig", "total", "share", "ids", "weights")
    blocks = staged(placed.groupBy("key", "seeking", "band", "slot").agg(F.collect_list(own).alias("held")), "neardup-blocks")
    name = F.struct("band", "slot")
    ids = blocks.select("key", "seeking", "band", name.alias("name"))
    one = ids.filter("seeking").select("key", F.col("band").alias("level"), F.col("name").alias("a"))
    other = ids.select("key", "seeking", "band", F.col("name").alias("b"))
    met = staged(one.join(other, "key").filter("abs(band - level) <= 1 and (not seeking or b >= a)").select("key", "a", "seeking", "b"), "neardup-block-pairs")
    x = blocks.filter("seeking").select("key", name.alias("a"), F.col("held").alias("x"))
    y = blocks.select("key", "seeking", name.alias("b"), F.col("held").alias("y"))
    return met.join(x, ["key", "a"]).join(y, ["key", "seeking", "b"]).select("x", "y").mapInArrow(verify, "a binary, b binary")


def keep_one(docs: DataFrame, threshold: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text", by_count: bool = False) -> DataFrame:
    """The columns of ``docs``, one document of each class of near-duplicates."""
    free = [f"_own{i}" for i in range(len(docs.columns) + 2) if f"_own{i}" not in docs.columns][:2]
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))  # apart from an empty id
    classes = near_duplicates(docs, threshold, id_col=id_col, text_col=text_col, by_count=by_count)
    kept = staged(classes.filter("keep").select(name.alias(free[0]), F.col("node").alias(free[1])).distinct(), "neardup-kept")
    named = docs.withColumns({free[0]: name, free[1]: node_of(normal(F.col(text_col)))})
    return named.join(kept, free, "left_semi").dropDuplicates(free).drop(*free)
