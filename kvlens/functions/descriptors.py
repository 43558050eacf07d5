"""Identity of object descriptors: descriptor hash, object id and manifest id as columns.

Each step of Python in a plan is a worker of its own in every task; where several ids of a row are wanted, the
functions that give them together take one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from kvlens.functions.identity import blake3_hex, blake3_texts, canonical_json, strict_json


@dataclass(frozen=True)
class Names:
    """The names that a system's descriptors carry; they all begin with its project's name."""

    project: str = "kvlens"

    @property
    def object_schema(self) -> str:
        return f"{self.project}.kv_object.v1alpha1"

    @property
    def target_schema(self) -> str:
        return f"{self.project}.target_profile.v1alpha1"

    @property
    def id_algorithm(self) -> str:
        return f"{self.project}.object_id.v1"

    @property
    def id_prefix(self) -> str:
        return f"{self.project}://object/blake3/"


def normalized(text: str | None, payload_hash: str | None) -> bytes | None:
    """Canonical bytes of a descriptor with its ids empty and the payload's hash in place; None where it has no such form."""
    try:
        meta = strict_json(text)
        meta["object_id"] = None
        meta["integrity"] |= {"descriptor_hash": None, "payload_hash": payload_hash}
        return canonical_json(meta)
    except (TypeError, ValueError, KeyError, AttributeError, json.JSONDecodeError):
        return None


@F.pandas_udf(BinaryType())
def normalized_descriptor(metadata: pd.Series, payload_hash: pd.Series) -> pd.Series:
    return pd.Series([normalized(t, p) for t, p in zip(metadata, payload_hash, strict=True)], dtype=object)


def descriptor_hash(metadata: Column, payload_hash: Column) -> Column:
    return blake3_hex(normalized_descriptor(metadata, payload_hash))


def object_id(descriptor: Column, payload: Column, names: Names = Names()) -> Column:
    """The id of a descriptor hash and a payload hash; null if one is."""
    material = F.concat(F.lit(names.id_algorithm).cast("binary"), F.lit(b"\x00"), descriptor.cast("binary"), F.lit(b"\x00"), payload.cast("binary"))
    return F.concat(F.lit(names.id_prefix), F.substring(blake3_hex(material), 8, 64))


def named(metadata: Iterable[str | None], payload_hashes: Iterable[str | None], names: Names) -> dict[str, list[str | None]]:
    """The columns descriptor_hash and object_id, as the functions of these names give them."""
    payload_hashes = list(payload_hashes)
    hashes = blake3_texts(normalized(t, p) for t, p in zip(metadata, payload_hashes, strict=True))
    material = (None if d is None or p is None else b"\x00".join(x.encode() for x in (names.id_algorithm, d, p)) for d, p in zip(hashes, payload_hashes, strict=True))
    return {"descriptor_hash": hashes, "object_id": [x and names.id_prefix + x.removeprefix("blake3:") for x in blake3_texts(material)]}


def descriptor_identity(metadata: Column, payload_hash: Column, names: Names = Names()) -> Column:
    """Struct of descriptor_hash and object_id: one step of Python, so one worker a task."""

    @F.pandas_udf("descriptor_hash string, object_id string")
    def identity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, hashes in batches:
            yield pd.DataFrame(named(texts, hashes, names), dtype=object)

    return identity(metadata, payload_hash)


def object_identity(metadata: Column, payload: Column, names: Names = Names()) -> Column:
    """Struct of payload_hash, descriptor_hash and object_id: one step of Python, so one worker a task."""

    @F.pandas_udf("payload_hash string, descriptor_hash string, object_id string")
    def identity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, payloads in batches:
            hashes = blake3_texts(payloads)
            yield pd.DataFrame({"payload_hash": hashes} | named(texts, hashes, names), dtype=object)

    return identity(metadata, payload)


def manifest_id(manifest_type: Column, model: Column, tokenizer: Column, rope: Column, prefix: Column, start: Column, end: Column, id_prefix: str = "kvlens://manifest/blake3/") -> Column:
    lines = [F.coalesce(c.cast("string"), F.lit("")) for c in (manifest_type, model, tokenizer, rope, prefix, start, end)]
    joined = lines[0]
    for line in lines[1:]:
        joined = F.concat(joined, F.lit("\n"), line)
    return F.concat(F.lit(id_prefix), F.substring(blake3_hex(joined.cast("binary")), 8, 64))
