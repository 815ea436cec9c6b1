"""Operator 13: near-duplicates on word shingles by SetSketch registers, bands and a joint likelihood.

A document's set holds its different shingles of ``SHINGLE`` words (fewer words: the whole sequence). A SetSketch
register is the smallest of the set's hash values under the register's own hash, as an exponential variable, and
only the level it reaches on a scale of powers of ``BASE`` is kept, one byte. Registers are mergeable (``merged``: the
larger of two levels), and two sets agree in a register at least as often as their Jaccard similarity says.

``BANDS`` bands of ``ROWS`` registers name buckets. A pair at the threshold shares none of them with probability
(1 - 0.8^6)^48, about 5e-7. Equal sets are one node from the start, named by the number of their first row, so copies cost nothing. The large joins
are sort-merge joins at any size, so that small runs tell what large ones move. Then:

1. every node is paired with the smallest node of each of its buckets: a star, never all pairs of a bucket;
2. the likelihood of the registers' three outcomes (larger, smaller, equal) given both set sizes estimates the
   similarity, and pairs estimated below ``LEAST`` (5 deviations below the threshold) go. What is left joins nodes to
   groups; buckets that still lie in several groups are compared inside tasks, and a spanning forest of the pairs
   that the likelihood lets pass joins the groups further. So nodes that may reach the threshold share a group;
3. the full sets go to the groups, each once, and are linked there where 100 * common >= 80 * union. A group is cut in
   blocks of ``BUCKET`` nodes by a hash, each with the group's first node, and a block gives a spanning forest;
4. in a group of several blocks the nodes that are still outside its largest component are compared, in teams of
   ``BUCKET``, with every block; a node gives one link for each other component that it reaches.

So no link between components is lost but by the two stated probabilities, and no step writes all pairs of anything.

Defined cases: a null or empty text, or one of blanks, has an empty set and links with nothing; sets of up to three
shingles link with equal sets only, because no other set can reach the threshold; repeated rows each get a row;
a null id is never the smallest unless the component has no id at all, and counts as kept only then; no documents
give no rows; other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tradewind.llm.common import arrow_table, map_batches, raw_texts, seeded, texts
from tradewind.llm.components import components
from tradewind.sources.stages import stage

SHINGLE, COMMON, UNION = 2, 100, 80
BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
BASE, RATE = 1.1, 20.0
LEAST = 0.68
BUCKET = 4096
#: No set of up to this size reaches the threshold with another set.
ALONE = 3
#: Rows of an involved-node list up to which it is broadcast (about 16 bytes each).
BROADCAST_ROWS = 4_000_000
_XOR, _TIMES = seeded("set-sketch/xor", REGISTERS), seeded("set-sketch/times", REGISTERS)
#: Elements of sets that are hashed at once, so that a column of them stays in the processor's cache.
_AT_ONCE = 16_384


# ---- sets and registers


def shingle_set(text: bytes) -> np.ndarray:
    """The different shingles of a text as ascending 48-bit numbers."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words))]
    else:
        hashes = [digest(b" ".join(pair)) for pair in set(zip(*(words[i:] for i in range(SHINGLE))))]
    return np.unique(np.array(hashes, dtype=np.uint64) >> np.uint64(16))


def levels(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sets that are not empty, one row each."""
    out = np.empty((len(sets), REGISTERS), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    start = 0
    while start < len(sets):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), _AT_ONCE, side="right")))
        values = np.concatenate(sets[start:end]) * np.uint64(0x9E3779B97F4A7C15)
        values ^= values >> np.uint64(32)
        cuts = np.cumsum(sizes[start:end]) - sizes[start:end]
        for i in range(REGISTERS):
            out[start:end, i] = np.minimum.reduceat((values ^ _XOR[i]) * _TIMES[i], cuts)
        start = end
    least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(least) / np.log(BASE)), 0, 255).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _level(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.minimum(x, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)


_GRID = np.linspace(0.0, 1.0, 101)


def likely(size_a: np.ndarray, size_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of largest likelihood, given set sizes and how many registers are larger and smaller."""
    u = (size_a / (size_a + size_b))[:, None]
    v = 1.0 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    more, less = np.maximum(_level(u - v * j), 1e-12), np.maximum(_level(v - u * j), 1e-12)
    same = np.maximum(1.0 - more - less, 1e-12)
    up, down = larger[:, None], smaller[:, None]
    score = up * np.log(more) + down * np.log(less) + (REGISTERS - up - down) * np.log(same)
    best = score.argmax(axis=1)
    return np.take_along_axis(j, best[:, None], axis=1)[:, 0]


def alike(sketch_a: np.ndarray, size_a: np.ndarray, sketch_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether each pair of rows may reach the threshold: by the set sizes for sure, by the registers but for 5 deviations."""
    out = (COMMON * np.minimum(size_a, size_b) >= UNION * np.maximum(size_a, size_b)) & ((sketch_a == sketch_b).sum(axis=1) >= LEAST * REGISTERS)
    at = np.flatnonzero(out)
    if len(at):
        larger, smaller = (sketch_a[at] > sketch_b[at]).sum(axis=1), (sketch_a[at] < sketch_b[at]).sum(axis=1)
        out[at] = likely(size_a[at].astype(float), size_b[at].astype(float), larger, smaller) >= LEAST
    return out


def _packed(ordered: np.ndarray) -> bytes:
    """Ascending 48-bit numbers as 6-byte differences, byte by byte: the highest ones are nearly all zero and compress."""
    steps = ordered.copy()
    steps[1:] -= ordered[:-1]
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.zeros((len(data) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(6, -1).T
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)


_ROW = "doc_id long, n_shingles long, name binary, sketch binary, elements binary"


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t) for t in raw_texts(batch)]
        full = [i for i, s in enumerate(sets) if len(s)]
        sketch: list[bytes | None] = [None] * len(sets)
        if full:
            for i, registers in zip(full, levels([sets[i] for i in full])):
                sketch[i] = registers.tobytes()
        return {
            "doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets], "sketch": sketch,
            "name": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "elements": [_packed(s) for s in sets],
        }

    return map_batches(texts(docs), run, _ROW)


# ---- candidates


_PAIR = "u long, v long"


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) for every band of every node; the key is a hash of the band's number and registers."""

    def run(batch: pa.RecordBatch) -> dict:
        registers = _rows_of(batch.column("sketch"), REGISTERS).reshape(-1, BANDS, ROWS)
        keys = [xxhash.xxh3_64_intdigest(registers[i, b].tobytes(), b) for i in range(len(registers)) for b in range(BANDS)]
        order = pa.array(np.repeat(np.arange(len(registers)), BANDS))
        return {"key": np.array(keys, dtype=np.uint64).view(np.int64), "node": batch.column("node").take(order)}

    return map_batches(nodes.filter(F.col("n") > ALONE).select("node", "sketch"), run, "key long, node long")


def _likely_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` that the likelihood lets pass."""
    a = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    b = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    wide = pairs.hint("merge").join(b, "v").hint("merge").join(a, "u").select("u", "v", "nu", "nv", "su", "sv")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = alike(_rows_of(batch.column("su"), REGISTERS), batch.column("nu").to_numpy(), _rows_of(batch.column("sv"), REGISTERS), batch.column("nv").to_numpy())
                yield batch.select(["u", "v"]).filter(pa.array(ok))

    return wide.mapInArrow(run, _PAIR)


# ---- groups by sketches


def _forest_of(n: int, near) -> list[tuple[int, int]]:
    """Links that join ``n`` places into the components of ``near(place, others) -> mask``; each place is compared once with those not reached yet."""
    out, left = [], np.arange(n)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            centre = queue.pop()
            reached = near(centre, left)
            out += [(centre, x) for x in left[reached]]
            queue += list(left[reached])
            left = left[~reached]
    return out



def _pair_table(node: list[int], links: list[tuple[int, int]]) -> pa.Table:
    return arrow_table(_PAIR, {"u": [min(node[i], node[k]) for i, k in links], "v": [max(node[i], node[k]) for i, k in links]})


def _bucket_forest(table: pa.Table) -> pa.Table:
    sketch, n = _rows_of(table.column("sketch"), REGISTERS), table.column("n").to_numpy()

    def near(i: int, others: np.ndarray) -> np.ndarray:
        return alike(sketch[others], n[others], np.broadcast_to(sketch[i], (len(others), REGISTERS)), np.full(len(others), n[i]))

    return _pair_table(table.column("node").to_pylist(), _forest_of(len(n), near))


def _dealt(named: DataFrame, bucket: int) -> DataFrame:
    """(part, node, label, asked) of ``named`` (key, node, label): keys with several labels in parts that bring every asked node to every other node.

    Asked nodes are those outside their key's largest label. A key's nodes are cut in blocks of about ``bucket`` by a
    hash, its asked nodes in teams of as many; a part is one block and one team. A key without asked nodes has no part.
    """
    by_label = stage(named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("many")), "sketch-labels")
    mixed = by_label.groupBy("key").agg(F.sum("many").alias("size"), F.max(F.struct("many", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    mixed = mixed.select("key", F.ceil(F.col("size") / bucket).alias("blocks"), F.col("main.label").alias("main"), F.ceil((F.col("size") - F.col("main.many")) / bucket).alias("teams"))
    dealt = named.join(mixed, "key").withColumn("asked", F.col("label") != F.col("main"))

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    asked = dealt.filter("asked").select("key", "node", "label", each("blocks").alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("teams")).alias("team"), F.lit(True).alias("asked"))
    held = dealt.select("key", "node", "label", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), each("teams").alias("team"), F.lit(False).alias("asked"))
    part: Column = F.xxhash64("key", "block", "team")
    return asked.unionByName(held).groupBy(part.alias("part"), "node", "label").agg(F.bool_or("asked").alias("asked"))


def _labelled(links: DataFrame, name: str) -> DataFrame:
    """(node, label) of every node that has a link."""
    return components(links, name).withColumnRenamed("root", "label")


def groups(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(node, label): groups of nodes such that two nodes with a bucket in common and a likelihood that passes share one."""
    keyed = _buckets(nodes)
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("least")).filter("many > 1").select("key", "least")
    shared = stage(keyed.join(crowded, "key"), "sketch-shared")
    star = stage(_likely_pairs(shared.filter("node != least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct(), nodes), "sketch-star")
    first = _labelled(star, "sketch-first")
    parts = _dealt(shared.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), bucket)
    further = parts.hint("merge").join(nodes.select("node", "n", "sketch"), "node").select("part", "node", "n", "sketch").groupBy("part").applyInArrow(_bucket_forest, _PAIR).distinct()
    return _labelled(stage(star.unionByName(further), "sketch-pairs"), "sketch-groups")


# ---- links by full sets


class Sets:
    """Full sets of a task, compared one against many: sizes, registers and a bound on the common elements come first."""

    def __init__(self, table: pa.Table) -> None:
        self.sketch = _rows_of(table.column("sketch"), REGISTERS)
        self.elements = [_unpacked(x) for x in table.column("elements").to_pylist()]
        self.n = np.array([len(x) for x in self.elements], dtype=np.int64)
        self.low = [(x & np.uint64(0xFFFF)).astype(np.uint16) for x in self.elements]

    def linked(self, i: int, others: np.ndarray, one_is_enough: bool = False) -> np.ndarray:
        out = alike(self.sketch[others], self.n[others], np.broadcast_to(self.sketch[i], (len(others), REGISTERS)), np.full(len(others), self.n[i]))
        at = np.flatnonzero(out)
        if not len(at):
            return out
        mine = np.zeros(1 << 16, dtype=np.int32)
        mine[self.low[i]] = 1
        for k in at:
            other = others[k]
            both = int(self.n[i] + self.n[other])
            if (COMMON + UNION) * int(mine[self.low[other]].sum()) < UNION * both:
                out[k] = False
                continue
            common = len(np.intersect1d(self.elements[i], self.elements[other], assume_unique=True))
            out[k] = COMMON * common >= UNION * (both - common)
            if one_is_enough and out[k]:
                out[at[at > k]] = False
                break
        return out


def _block_forest(table: pa.Table) -> pa.Table:
    sets = Sets(table)
    return _pair_table(table.column("node").to_pylist(), _forest_of(len(sets.n), sets.linked))


def _across(table: pa.Table) -> pa.Table:
    """For each asked node one link to each other component of the part that it reaches."""
    table = table.combine_chunks()
    sets = Sets(table)
    label = table.column("label").to_numpy()
    order = np.argsort(label, kind="stable")
    runs = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    links = []
    for i in np.flatnonzero(table.column("asked").to_numpy()):
        for run in runs:
            if label[run[0]] != label[i]:
                links += [(int(i), int(k)) for k in run[sets.linked(int(i), run, True)]]
    return _pair_table(table.column("node").to_pylist(), links)


def _with_sets(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, label, sketch, elements) of the members of groups."""
    picked = F.broadcast(members.select("node")) if members.count() <= BROADCAST_ROWS else members.select("node")
    sets = rows.select(F.col("row").alias("node"), "sketch", "elements").join(picked, "node", "left_semi")
    return stage(members.hint("merge").join(sets, "node").select("node", "label", "sketch", "elements"), "sketch-sets")


def links(rows: DataFrame, nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): confirmed links whose components are those of all links."""
    sets = _with_sets(stage(groups(nodes, bucket), "sketch-members"), rows)
    sizes = sets.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    large = stage(sizes.filter(F.col("size") > bucket), "sketch-large")
    blocks = sets.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS // 4 else large, "label", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / bucket), F.lit(1).cast("long")))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")))
    place = F.when(F.col("node") == F.col("label"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own)
    placed = blocks.select("label", "node", "sketch", "elements", F.explode(place).alias("block"))
    sure = stage(placed.groupBy("label", "block").applyInArrow(_block_forest, _PAIR), "sketch-sure")
    if large.isEmpty():
        return sure
    known = _labelled(sure, "sketch-known")
    crowd = sets.select("node", F.col("label").alias("group")).join(large.select(F.col("label").alias("group")), "group")
    named = crowd.join(known, "node", "left").select(F.col("group").alias("key"), "node", F.coalesce("label", "node").alias("label"))
    parts = _dealt(named, bucket).join(sets.select("node", "sketch", "elements"), "node").select("part", "node", "label", "asked", "sketch", "elements")
    return sure.unionByName(stage(parts.groupBy("part").applyInArrow(_across, _PAIR), "sketch-late"))


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = stage(_sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketch-rows")
    full = rows.filter("name is not null")
    firsts = stage(full.groupBy("name").agg(F.min("row").alias("node"), F.min("doc_id").alias("first")), "sketch-firsts")
    first_rows = full.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "sketch")
    nodes = stage(first_rows.hint("merge").join(firsts.select("node"), "node"), "sketch-nodes")
    roots = _labelled(links(rows, nodes, bucket), "sketch-roots")
    rooted = stage(firsts.join(roots, "node", "left").select("name", "first", F.coalesce("label", "node").alias("root")), "sketch-rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("name", "component_id")
    out = rows.select("doc_id", "n_shingles", "name").join(named, "name", "left")
    own = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
