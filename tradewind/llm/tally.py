"""Counting and looking up keys of a corpus, block by block.

Documents are dealt to blocks of a few MB. A block asks for each of its different 64-bit keys once, with
its own count; keys are sorted, cut into ranges (buckets) and sent as arrays. A bucket gets the arrays of
all blocks, adds up equal keys and sends each block its totals in the order asked. So a frequent key costs
one entry a block, not one a occurrence, nothing is broadcast, and neither a block nor a bucket grows with
the corpus: their numbers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from tradewind.llm.common import arrow_table, planes, small_batches, unplanes

BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 19

ASKED = "kind int, bucket long, block long, keys binary, counts binary"
TOTALS = "kind int, bucket long, block long, totals binary"


def blocks(rows: DataFrame, text_bytes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (doc_id, text, ...) with a block number, spread by a hash of id and text."""
    small_batches(rows.sparkSession)
    n = max(1, -(-text_bytes // block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))


def bucket_bits(expected_keys: float, bucket_keys: int = BUCKET_KEYS) -> int:
    """Leading bits of a key that name its bucket; a rule of the corpus size, so that buckets stay alike."""
    return max(1, int(np.ceil(np.log2(max(2.0, expected_keys / bucket_keys)))))


def packed(ordered: np.ndarray) -> bytes:
    """Ascending keys as differences, whose high bytes are zero and vanish in the shuffle's compression."""
    steps = ordered.copy()
    steps[1:] -= ordered[:-1]
    return planes(steps)


def unpacked(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unplanes(data, dtype), dtype=dtype)


def counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, each occurrence's place among them, and the sums of the weights."""
    unique, place = np.unique(keys, return_inverse=True)
    return unique, place, np.bincount(place, weights=weight, minlength=len(unique)).astype(np.int64)


def ask(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, bits: int, short: bool = False) -> Iterator[dict]:
    """One row for each bucket that the sorted, different ``keys`` touch. ``short`` sends 32 bits below the bucket's: enough for a filter."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)]])
    sent = ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4") if short else keys.astype("<u8")
    for a, b in zip(cuts, cuts[1:]):
        yield {"kind": kind, "bucket": int(bucket[a]), "block": block, "keys": packed(sent[a:b]), "counts": planes(counts[a:b].astype("<u4"))}


def asked_table(rows: list[dict]) -> pa.Table:
    return arrow_table(ASKED, {c: [r[c] for r in rows] for c in ("kind", "bucket", "block", "keys", "counts")})


def totals(asked: DataFrame, short_kinds: tuple[int, ...] = (), at_most: dict[int, int] | None = None, distinct_only: bool = False) -> DataFrame:
    """The totals of all keys for every block, or with ``distinct_only`` one row per bucket with the number of keys counted at least once."""
    caps = at_most or {}

    def add(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        size = np.uint32 if kind in short_kinds else np.uint64
        keys = [unpacked(x, size) for x in table.column("keys").to_pylist()]
        counts = [unplanes(x, np.uint32) for x in table.column("counts").to_pylist()]
        _, place, sums = counted(np.concatenate(keys), np.concatenate(counts))
        if distinct_only:
            return arrow_table("kind int, n long, total long", {"kind": [kind], "n": [int((sums > 0).sum())], "total": [int(sums.sum())]})
        out = np.minimum(sums, caps.get(kind, 0xFFFFFFFF)).astype(np.uint8 if kind in caps else np.uint32)[place]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        rows = [planes(part) for part in np.split(out, ends)]
        return arrow_table(TOTALS, {"kind": [kind] * len(rows), "bucket": [bucket] * len(rows), "block": table.column("block"), "totals": rows})

    return asked.groupBy("kind", "bucket").applyInArrow(add, "kind int, n long, total long" if distinct_only else TOTALS)


def answers(table: pa.Table, kind: int, dtype) -> np.ndarray:
    """A block's totals of one kind, in the order of the keys it asked for."""
    picked = table.filter(pa.compute.equal(table.column("kind"), kind)).sort_by("bucket")
    found = [unplanes(x, dtype) for x in picked.column("totals").to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, dtype)
