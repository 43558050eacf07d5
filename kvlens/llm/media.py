"""Media columns: payloads as grey images, stored as content-defined chunks.

A payload becomes a binary grey image (PGM), 576 samples wide.  A rolling gear hash cuts its bytes into
chunks; chunks that several media share are found by a Spark join of their digests and stored once; all
other chunks stay with their media.  Reading joins the shared chunks back and checks the whole's digest.

Defined cases: a null text is an empty payload (one row of padding); equal payloads are one medium, stored
once, whatever their number; repeated rows are kept; no rows give no rows; a lost or damaged chunk raises.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.llm.common import Scratch, documents, keep_ids, map_rows, text_or_empty

WIDTH = 576
#: Fixed values of the chunker: smallest, largest, and a mask that a cut's hash must clear (mean about 2 KB more).
SMALLEST, LARGEST, MASK = 512, 8192, np.uint64(0x7FF << 40)
GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def pad(data: bytes, width: int = WIDTH) -> bytes:
    return data + b"\xff" * (-len(data) % width or (0 if data else width))


def to_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def from_pgm(stored: bytes) -> tuple[int, int, bytes]:
    kind, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a stored grey image")
    return width, height, samples


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash (shift by one, add the byte's number) at every byte, in six doubling steps."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16, 32):
        shifted = h[:-step] << np.uint64(step)
        h = h.copy()
        h[step:] += shifted
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    if len(data) <= SMALLEST:
        return [len(data)]
    found = np.flatnonzero((gear_hashes(data) & MASK) == 0) + 1
    ends, at, n = [], 0, len(data)
    while n - at > SMALLEST:
        i = int(np.searchsorted(found, at + SMALLEST))
        end = min(int(found[i]) if i < len(found) else n, at + LARGEST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(data):
        out.append(data[at:end])
        at = end
    return out


def features(stored: bytes) -> str:
    """height, mean and deviation of the samples, and the share of padding-white ones."""
    _, height, samples = from_pgm(stored)
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.int64)
    n, total, square = len(x), int(counts @ np.arange(256)), int(counts @ (np.arange(256) ** 2))
    return f"h={height};mean={total / n:.6f};var={square / n - (total / n) ** 2:.6f};white={counts[255] / n:.6f}"


def describe_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_id (the stored form's SHA-256), digests of its chunks in order."""

    def run(ids: list, texts: list) -> dict:
        data = [t.encode() for t in texts]
        stored = [to_pgm(pad(d)) for d in data]
        return {"doc_id": ids, "n_bytes": [len(d) for d in data], "media_id": [hashlib.sha256(s).digest() for s in stored], "digests": [[hashlib.blake2b(c, digest_size=16).digest() for c in chunks(s)] for s in stored]}

    return map_rows(docs, run, "doc_id long, n_bytes long, media_id binary, digests array<binary>")


def store(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the media; (documents: doc_id, n_bytes, media_id), (media: media_id, recipe, own), (shared: digest, data)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    described = scratch.save(describe_texts(texts), "described")
    holders = scratch.save(described.groupBy("media_id").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("holder")), "holders")
    # One row of a medium's chunk digests, from its holder; copies go no further.
    first = described.join(holders, "media_id").where(F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("holder"))
    listed = first.select("media_id", F.explode(F.array_distinct("digests")).alias("digest")).distinct()
    shared = scratch.save(listed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "shared-digests")
    wanted = first.select("media_id", "holder", F.explode(F.array_distinct("digests")).alias("digest")).join(shared, "digest", "left_semi")
    marks = scratch.save(wanted.groupBy("media_id").agg(F.collect_set("digest").alias("shared")), "marks")
    repeated = described.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    copies = scratch.save(described.join(holders, "media_id").where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("holder"))).select("doc_id").distinct().join(repeated, "doc_id", "left_anti"), "copies")
    held = keep_ids(texts, copies, "doc_id", "left_anti")

    # The marks are broadcast only while they are few; beyond that the texts are shuffled to them.
    by_doc = marks.join(holders, "media_id").select(F.col("holder").alias("doc_id"), "shared")
    size = by_doc.agg(F.coalesce(F.sum(F.size("shared")), F.lit(0))).first()[0]
    marked = held.join(F.broadcast(by_doc) if size <= 500_000 else by_doc, "doc_id", "left")

    def run(ids: list, texts: list, shared: list) -> dict:
        out: dict = {"media_id": [], "recipe": [], "own": [], "shared_chunks": []}
        for text, refs in zip(texts, shared, strict=True):
            stored = to_pgm(pad(text.encode()))
            refs, recipe, own, given = set(refs or ()), [], [], {}
            for chunk in chunks(stored):
                digest = hashlib.blake2b(chunk, digest_size=16).digest()
                if digest in refs:
                    given[digest] = chunk
                    recipe.append({"size": len(chunk), "digest": digest})
                else:
                    own.append(chunk)
                    recipe.append({"size": len(chunk), "digest": None})
            out["media_id"].append(hashlib.sha256(stored).digest())
            out["recipe"].append(recipe)
            out["own"].append(b"".join(own))
            out["shared_chunks"].append([{"digest": d, "data": c} for d, c in given.items()])
        return out

    kind = "media_id binary, recipe array<struct<size:int,digest:binary>>, own binary, shared_chunks array<struct<digest:binary,data:binary>>"
    written = scratch.save(map_rows(marked.select("doc_id", "text", "shared"), run, kind, rows=256), "media")
    media = written.select("media_id", "recipe", "own")
    if written.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():  # only if ids repeat
        media = media.dropDuplicates(["media_id"])
    chunk_rows = written.select(F.explode("shared_chunks").alias("c")).select("c.digest", "c.data")
    pool = scratch.save(chunk_rows.groupBy("digest").agg(F.first("data").alias("data")), "chunks")
    scratch.drop(shared, marks, copies)
    return described.select("doc_id", "n_bytes", "media_id"), media, pool


def read_media(media: DataFrame, pool: DataFrame) -> DataFrame:
    """media_id, stored: the bytes put together again in order and checked.

    Media that hold all their chunks are read where they lie; only those that refer to shared chunks are shuffled.
    """
    refers = F.exists("recipe", lambda r: r["digest"].isNotNull())
    referring = media.where(refers)
    refs = referring.select("media_id", F.explode(F.array_distinct(F.filter(F.transform("recipe", lambda r: r["digest"]), lambda d: d.isNotNull()))).alias("digest"))
    # Which medium needs a chunk is joined to the chunk; a chunk that very many media share is split by AQE.
    fetched = refs.join(pool, "digest").groupBy("media_id").agg(F.collect_list(F.struct("digest", "data")).alias("fetched"))
    whole = media.where(~refers).withColumn("fetched", F.lit(None).cast(fetched.schema["fetched"].dataType))
    return _assembled(whole.unionByName(referring.join(fetched, "media_id", "left")))


def _assembled(joined: DataFrame) -> DataFrame:
    def run(ids: list, recipes: list, own: list, fetched: list) -> dict:
        out = []
        for media_id, recipe, data, got in zip(ids, recipes, own, fetched, strict=True):
            known, at, parts = {x["digest"]: x["data"] for x in got or ()}, 0, []
            for step in recipe:
                if step["digest"] is None:
                    parts.append(data[at : at + step["size"]])
                    at += step["size"]
                else:
                    parts.append(known[step["digest"]])
            stored = b"".join(parts)
            if hashlib.sha256(stored).digest() != media_id:
                raise ValueError(f"medium {media_id.hex()} is damaged")
            out.append(stored)
        return {"media_id": ids, "stored": out}

    return map_rows(joined.select("media_id", "recipe", "own", "fetched"), run, "media_id binary, stored binary", rows=256)


def media_features(stored: DataFrame) -> DataFrame:
    """Values of each stored medium, computed from its bytes."""

    def run(ids: list, blobs: list) -> dict:
        payloads = [from_pgm(b)[2] for b in blobs]
        return {
            "media_id": ids,
            "payload_bytes": [len(p) for p in payloads],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": [zlib.crc32(p[-32:]) for p in payloads],
            "media_bytes": [len(b) for b in blobs],
            "media_sha256": [hashlib.sha256(b).hexdigest() for b in blobs],
            "feature": [features(b) for b in blobs],
        }

    return map_rows(stored, run, "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", rows=256)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    docs, media, pool = store(documents(spark, sf_dir), scratch)
    values = scratch.save(media_features(read_media(media, pool)), "values")
    return docs.join(values, "media_id").drop("media_id")
