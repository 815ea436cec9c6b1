"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit where more than half of the text's shingle hashes have it. Two fingerprints link if
they differ in at most ``RADIUS`` bits. To find all such pairs every bit gets a vector of RADIUS + 1 binary
digits, and there is a table for each non-zero vector v: it keeps the bits whose vector has an odd product
with v. The vectors of RADIUS differing bits never span the whole space, so some v is orthogonal to all of
them, its table keeps none of these bits, and the two fingerprints collide there: no pair within the radius
is missed.

Equal fingerprints are one entry with its smallest document id, so copies cost nothing. A bucket is compared
inside its task and gives a spanning forest of its links, never all pairs. A bucket with more than
``BUCKET`` fingerprints is passed on unread: its fingerprints are dealt again by masks of the same build
over the bits that its table leaves open. About 15 bits stay open then, so a bucket of the second round
holds at most some 2^15 different fingerprints whatever the size of the corpus.

Defined cases: a null or empty text has no words and fingerprint zero, which links like any other; fewer
than four words are one shingle; repeated rows each get a row; a null id counts as no id and is never the
smallest unless the whole component has none; other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tradewind.llm.common import arrow_table, map_batches, raw_texts, row_key, same_row, small_batches
from tradewind.llm.components import components
from tradewind.sources.stages import stage

RADIUS, SHINGLE, SEED = 4, 4, 42
BUCKET = 4096
_BITS = 64


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *(ends[: -SHINGLE]).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    kept = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(kept, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t) for t in raw_texts(batch)], dtype=np.uint64).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": fp}

    small_batches(docs.sparkSession)
    return map_batches(docs.select(*row_key(), "text"), run, "doc_id long, text_hash long, fp long")


def cover(open_bits: list[int]) -> list[int]:
    """Masks of the covering tables over the given bits."""
    vectors = 2 ** (RADIUS + 1)
    place = {bit: j % (vectors - 1) + 1 for j, bit in enumerate(open_bits)}
    return [sum(1 << bit for bit, vector in place.items() if (vector & v).bit_count() % 2) for v in range(1, vectors)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


FIRST = cover(list(range(_BITS)))
#: For each table of the first round, the masks of the second: its own bits and half of those it leaves open.
SECOND = [[m | extra for extra in cover([b for b in range(_BITS) if not m >> b & 1])] for m in FIRST]


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the sorted fingerprints of one bucket into the components of all its links.

    Breadth first: each fingerprint is compared once, as a whole vector, with those not reached yet.
    """
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue[-1]) <= RADIUS
            centre = queue.pop()
            if near.any():
                reached = left[near]
                out += [(int(centre), int(x)) for x in reached]
                queue += list(reached)
                left = left[~near]
    return out


_LINK = "a long, b long, t int"


def _links(batches: Iterable[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Links within buckets of rows (t, key, fp) that come sorted; a bucket beyond the limit is passed on as (fp, null, t)."""
    held: list[np.ndarray] = []
    held_key, passing = None, False

    def close() -> list[tuple[int, int]]:
        fps = np.concatenate(held) if held else np.zeros(0, np.uint64)
        return forest(fps) if len(fps) > 1 else []

    for batch in batches:
        t, key, fp = (batch.column(c).to_numpy() for c in ("t", "key", "fp"))
        if not len(t):
            continue
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
        links: list[tuple[int, int]] = []
        deferred: list[tuple[np.ndarray, int]] = []
        whole = (ends - starts) > 1
        edge = np.zeros(len(starts), bool)
        edge[[0, -1]] = True
        for i in np.flatnonzero(whole | edge):
            a, b = starts[i], ends[i]
            run = fp[a:b].view(np.uint64)
            here = (t[a], key[a])
            if here != held_key:
                links += close()
                held, held_key, passing = [], here, False
            held.append(run)
            if passing or (limit is not None and sum(map(len, held)) > limit):
                deferred += [(x, int(t[a])) for x in held]
                held, passing = [], True
        if links or deferred:
            a = np.concatenate([np.array([x[0] for x in links], dtype=np.uint64), *[x for x, _ in deferred]])
            b = [_signed(x[1]) for x in links] + [None] * (len(a) - len(links))
            table = np.concatenate([np.full(len(links), -1, np.int32), *[np.full(len(x), n, np.int32) for x, n in deferred]])
            yield from arrow_table(_LINK, {"a": a.view(np.int64), "b": b, "t": table}).to_batches()
    if links := close():
        yield from arrow_table(_LINK, {"a": [_signed(x) for x, _ in links], "b": [_signed(x) for _, x in links], "t": [-1] * len(links)}).to_batches()


def _compared(keyed: DataFrame, limit: int | None) -> DataFrame:
    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.mapInArrow(lambda batches: _links(batches, limit), _LINK)


def _second_round(deferred: DataFrame) -> DataFrame:
    masks = np.array(SECOND, dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> dict:
        t, fp = batch.column("t").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        key = (fp[:, None] & masks[t]).reshape(-1)
        tables = (t.astype(np.int32)[:, None] * masks.shape[1] + np.arange(masks.shape[1], dtype=np.int32)[None, :]).reshape(-1)
        return {"t": tables, "key": key.view(np.int64), "fp": np.repeat(fp, masks.shape[1]).view(np.int64)}

    return map_batches(deferred, run, "t int, key long, fp long")


def links(distinct_fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between different fingerprints whose components are those of all links."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(FIRST)])
    keyed = distinct_fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    found = stage(_compared(keyed, bucket), "simhash-links")
    again = _compared(_second_round(found.filter("b is null").select("t", F.col("a").alias("fp"))), None)
    return found.filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(again.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct()


def _rooted(entries: DataFrame, bucket: int) -> DataFrame:
    """``entries`` (fp and first, one row a fingerprint) with the root of each fingerprint's component."""
    roots = components(links(entries.select("fp"), bucket), "simhash")
    linked = entries.join(roots, entries["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return stage(linked, "simhash-roots")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    rows = stage(fingerprints(docs).select("doc_id", "fp"), "simhash-fp")
    linked = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), bucket)
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row of each component, unchanged: that with the smallest id, then the smallest text hash; of equal rows any one.

    Rows without an id come last, so one of them stays only if its component has no id at all.
    """
    keys = stage(fingerprints(docs).groupBy("doc_id", "text_hash", "fp").agg(F.count(F.lit(1)).alias("copies")), "simhash-keys")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "copies")
    linked = _rooted(keys.groupBy("fp").agg(F.min(first).alias("first")), bucket)
    winners = stage(linked.groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "simhash-first")
    beaten = keys.join(winners, keys["doc_id"].eqNullSafe(winners["doc_id"]) & (keys["text_hash"] == winners["text_hash"]), "left_anti")
    repeated = winners.filter("copies > 1").select("doc_id", "text_hash")
    dropped = stage(beaten.select("doc_id", "text_hash").unionByName(repeated), "simhash-dropped")
    kept = docs.join(dropped, same_row(docs, dropped), "left_anti")
    if not repeated.isEmpty():
        kept = kept.unionByName(docs.join(repeated, same_row(docs, repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)
