"""Operator 9: media columns stored as content-defined chunks.

A text becomes a payload (its UTF-8 bytes, zero-padded to a positive multiple of
64) and that a mono 8-bit sound file whose samples are the payload.  The file is
cut where a rolling gear hash over its last bytes has its low bits zero, between
a least and a greatest length.  Chunks are known by their digest: a Spark
aggregation keeps one copy of each, a join brings the ordered chunk lists their
bytes, and every file is put together again, verified against its digest and
parsed before anything is said about it.

Files are known by the payload's digest, so a text with many copies is rebuilt
once; a chunk that many files share is one row of the store.  The only group that
meets in one task is the chunks of one file.

Defined results.  Null text is the empty text (64 zero bytes).  Equal texts give
equal values whatever their ids; repeated rows give a row each.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plebis.llm.common import durable, table

#: Zero bits of the hash at a cut (mean length 16384), least and greatest length.
BITS, LEAST, MOST = 14, 4096, 65536
RATE = 8000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def gear(seed: int = 9) -> np.ndarray:
    """A random number for each byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def to_media(payload: bytes) -> bytes:
    n = len(payload)
    return HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_media(media: bytes) -> bytes:
    found = HEADER.unpack_from(media)
    if found[0] != b"RIFF" or found[2] != b"WAVE" or found[10] != 8 or found[12] != len(media) - HEADER.size:
        raise ValueError("not an 8-bit mono sound file")
    return media[HEADER.size :]


def cuts(data: bytes, table_: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks.  The hash of a place is the sum of its last bytes' gear
    values, each shifted by its distance; its low bits are summed by doubling."""
    n = len(data)
    if n <= least:
        return [n]
    h = table_[np.frombuffer(data, np.uint8)]
    span = 1
    while span < bits:
        h[span:] += h[:-span].copy() << np.uint32(span)
        span *= 2
    marks = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0) + 1
    ends, start = [], 0
    while n - start > least:
        at = np.searchsorted(marks, start + least)
        end = int(marks[at]) if at < len(marks) else n
        end = min(end, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _chunked(docs: DataFrame, key: str, text: str, store: bool) -> DataFrame:
    """With store: rows (digest, packed), each digest once a batch.  Else rows
    (key, n_bytes, media_id, digests), one a document."""
    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gears = gear()
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            sizes, ids, lists = [], [], []
            for t in batch.column(1).to_pylist():
                n, payload = payload_of(t)
                media = to_media(payload)
                start, digests = 0, []
                for end in cuts(media, gears):
                    part = media[start:end]
                    digest = hashlib.blake2b(part, digest_size=20).digest()
                    digests.append(digest)
                    if store and digest not in seen:
                        seen[digest] = bz2.compress(part)
                    start = end
                if not store:
                    sizes.append(n)
                    ids.append(hashlib.sha256(payload).digest())
                    lists.append(digests)
            if store:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["digest", "packed"]
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(lists, pa.list_(pa.binary()))],
                    names=["key", "n_bytes", "media_id", "digests"],
                )

    schema = "digest binary, packed binary" if store else f"key {kind}, n_bytes long, media_id binary, digests array<binary>"
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, schema)


def chunk_store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a distinct chunk: digest and packed bytes."""
    return _chunked(docs, key, text, True).dropDuplicates(["digest"])


def chunk_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, media_id, digests): each document's ordered chunk list."""
    return _chunked(docs, key, text, False)


def features(samples: np.ndarray) -> str:
    """Sum, sum of squares, turns about the middle and a histogram of 8 levels."""
    x = samples.astype(np.int64)
    turns = int(np.count_nonzero(np.diff(samples >= 128)))
    levels = np.bincount(samples >> 5, minlength=8)
    return f"sum={int(x.sum())};squares={int((x * x).sum())};turns={turns};levels={'/'.join(map(str, levels))}"


def rebuild(lists: DataFrame, store: DataFrame) -> DataFrame:
    """One row a file: media_id, its verified bytes' digests, sizes and features.

    A chunk missing from the store, or bytes that are not those of the digest,
    raise an error rather than give a wrong file.
    """
    listed = lists.select("media_id", F.size("digests").alias("n"), F.posexplode("digests").alias("seq", "digest"))
    places = listed.dropDuplicates(["media_id", "seq"])
    # A file of one chunk is whole where the chunk is; only the others' chunks
    # move once more, to meet in order.
    alone = places.where("n = 1").join(store, "digest", "left").select("media_id", F.array(F.struct("seq", "packed")).alias("parts"))
    several = (
        places.where("n > 1")
        .join(store, "digest", "left")
        .groupBy("media_id")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "packed"))).alias("parts"))
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if any(p["packed"] is None for p in parts):
                    raise ValueError("a chunk is missing from the store")
                media = b"".join(bz2.decompress(p["packed"]) for p in parts)
                payload = from_media(media)
                digest = hashlib.sha256(payload)
                if digest.digest() != key:
                    raise ValueError("rebuilt media differ from what was stored")
                made = (
                    len(payload),
                    digest.hexdigest(),
                    zlib.crc32(payload[-64:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    features(np.frombuffer(payload, np.uint8)),
                )
                for column, value in zip(out, made, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return alone.unionByName(several).mapInArrow(
        build,
        "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op9_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Read three times; without the bytes it is small.
    lists = chunk_lists(docs).transform(durable)
    rebuilt = rebuild(lists, chunk_store(docs))
    return lists.select(F.col("key").alias("doc_id"), "n_bytes", "media_id").join(rebuilt, "media_id").drop("media_id")
