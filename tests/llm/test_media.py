import hashlib
import random
import zlib

import numpy as np

from orrery.llm.media import GEAR, LARGEST, SMALLEST, chunk_ends, gear_hashes, padded, read_media, sound_features, store_media, wave_samples


def test_gear_hash_is_the_rolling_one():
    data = np.random.default_rng(0).integers(0, 256, 500, np.uint8)
    h, got = 0, gear_hashes(data)
    for i, b in enumerate(data):
        h = (2 * h + int(GEAR[b])) & 0xFFFFFFFF
        assert h == got[i]


def test_chunks_follow_content():
    rnd = random.Random(1)
    body = bytes(rnd.randrange(97, 123) for _ in range(60_000))
    a, b = chunk_ends([body, b"inserted " * 70 + body])
    assert all(y - x <= LARGEST for x, y in zip([0, *a], a)) and all(y - x >= SMALLEST for x, y in zip([0, *a[:-1]], a[:-1]))
    pa_ = {hashlib.md5(body[x:y]).digest() for x, y in zip([0, *a], a)}
    other = b"inserted " * 70 + body
    pb = {hashlib.md5(other[x:y]).digest() for x, y in zip([0, *b], b)}
    assert len(pa_ & pb) >= len(pa_) - 3


def test_store_and_read(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(50_000))
    texts = [None, "", "short é😀", long, long, long[:20_000] + "changed" + long[20_000:], "x" * 64, "y" * 40_000]
    docs = spark.createDataFrame([(i % 7, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(3)
    store = store_media(docs)
    chunks = store.chunks()
    assert chunks.count() == chunks.select("digest").distinct().count()
    got = sorted((r["doc_id"], r["n_bytes"], r["payload_sha256"], zlib.crc32(r["tail"]), r["media"]) for r in read_media(store).collect())
    want = []
    for i, t in enumerate(texts):
        p = padded((t or "").encode())
        want.append((i % 7, len((t or "").encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert [g[:4] for g in got] == sorted(want)
    assert all(hashlib.sha256(wave_samples(g[4])).hexdigest() == g[2] for g in got)
    stored = chunks.selectExpr("sum(length(chunk))").first()[0]
    assert stored > 0
    few = read_media(store, sound_features).collect()
    assert len({(r["payload_sha256"], r["feature"]) for r in few}) == len({r["payload_sha256"] for r in few})
    assert read_media(store_media(docs.limit(0)), sound_features).count() == 0
