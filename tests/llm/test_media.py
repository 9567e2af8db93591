import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plebis.llm import media


def test_round_trip(spark, docs_of, tmp_path):
    rng = random.Random(1)
    body = "".join(rng.choices("abcdef ghij\n", k=200_000))
    given = [(1, None, "s"), (2, "", "s"), (3, "é" * 32, "s"), (4, body, "s"), (5, body, "s"), (6, body[:90_000] + "X" + body[90_000:], "s"), (None, "n", "s"), (7, "n", "s"), (7, "n", "s")]
    docs_of(given).withColumn("seq", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op9_media(spark, str(tmp_path)).collect()
    assert len(got) == len(given)
    by = {r["doc_id"]: r for r in got}
    for i, text, _ in given:
        raw = (text or "").encode()
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(payload) + 44, hashlib.sha256(media.to_media(payload)).hexdigest())
    assert by[4]["feature"] == by[5]["feature"] != by[6]["feature"]


def test_chunks_follow_content(spark, docs_of):
    rng = random.Random(2)
    body = "".join(rng.choices("abcdefghij", k=900_000))
    docs = docs_of([body, "front " + body, body])
    lists = {r["key"]: list(map(bytes, r["digests"])) for r in media.chunk_lists(docs).collect()}
    assert lists[0] == lists[2] and len(set(lists[0]) & set(lists[1])) >= 0.8 * len(lists[0])
    stored = media.chunk_store(docs)
    assert stored.count() == len(set(lists[0]) | set(lists[1]))


def test_cuts_keep_bounds():
    data = bytes(random.Random(3).choices(range(256), k=300_000))
    ends = media.cuts(data, media.gear())
    sizes = [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert sum(sizes) == len(data) and max(sizes) <= media.MOST and min(sizes[:-1]) >= media.LEAST
    assert media.cuts(bytes(100_000), media.gear())[-1] == 100_000


def test_missing_chunk_is_an_error(spark, docs_of):
    docs = docs_of(["some text"])
    with pytest.raises(Exception):  # noqa: B017
        media.rebuild(media.chunk_lists(docs), media.chunk_store(docs).limit(0)).collect()
    assert media.rebuild(media.chunk_lists(docs.limit(0)), media.chunk_store(docs.limit(0))).count() == 0
