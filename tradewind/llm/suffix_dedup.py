"""Operator 1: removal of repeated strings with a distributed difference-cover suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts somewhere else, in the same document
or another one. Suffixes need to be ordered only as far as LENGTH bytes, and of the order only equality of
neighbours' prefixes matters, so prefixes are sorted by their fingerprints.

1. *Sort sampled triples.* The sampled suffixes start at the places whose residue by PERIOD is in COVER. For any
   two places there is a shift below PERIOD that takes both into the sample, so two equal strings of LENGTH
   bytes hold sampled suffixes, equally far inside, that agree in their first LENGTH - PERIOD + 1 bytes: three
   blocks, each of which has a name. The triples of names are dealt out by range, sorted, and equal neighbours
   found.
2. *Recurse on names.* A sampled suffix whose triple is unique is in its final place and leaves; those whose
   triple repeats go on to the full depth.
3. *Merge the remaining suffixes.* All suffixes, sampled or not, that start less than PERIOD before one that went on are
   named by their first LENGTH bytes, dealt out by range and sorted.
4. *Compare adjacent prefixes.* Equal neighbours are repeated strings; their union per document is removed.

Whole copies are found first by hashes of their texts: one of each group is sorted for all, counted twice, and the others
are removed as they are. Texts are dealt to blocks once; blocks and ranges have a bounded size whatever the corpus (``tally``). A string
that repeats very often costs one entry a block.

Defined cases: a null text counts as empty; documents below LENGTH bytes lose nothing; identical documents of
LENGTH bytes or more, repeated rows included, lose everything; very long texts are fingerprinted in segments; other columns of the
input are never read by ``removed`` and kept by ``without_repeats``. Names are 64-bit fingerprints made from
two independent ones, told apart within their range.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, functions as F

from tradewind.llm import tally
from tradewind.llm.common import arrow_table, corpus_size, raw_texts, seeded, sha256_hex, stir, texts
from tradewind.sources.stages import stage

LENGTH = 200
#: A perfect difference set: every residue but 0 is the difference of just one pair.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
BLOCK = (LENGTH - PERIOD + 1) // 3
COPIES, SAMPLED, WHOLE = 0, 1, 2
SEGMENT = 1 << 17
BLOCK_BYTES = 2 << 20
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Fingerprints:
    """Fingerprints of substrings of one length from two running polynomials modulo 2^64 with random byte values."""

    def __init__(self, label: str) -> None:
        self.values = seeded(f"{label}/values", 512).reshape(2, 256)
        self.steps = seeded(f"{label}/steps", 2) | np.uint64(4) | np.uint64(1)
        self.mixers = seeded(f"{label}/mixers", 2)
        self.powers = [self._powers(int(s)) for s in self.steps]
        self.inverse = [self._powers(pow(int(s), -1, 1 << 64)) for s in self.steps]

    @staticmethod
    def _powers(step: int) -> np.ndarray:
        out = np.full(SEGMENT + LENGTH + 1, step, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def at(self, data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """Of the ``length`` bytes from each of the ascending places; places index ``data``."""
        out = np.empty(len(places), dtype=np.uint64)
        first = 0
        while first < len(places):
            base = int(places[first])
            last = int(np.searchsorted(places, base + SEGMENT - length))
            last = max(last, first + 1)
            p = places[first:last] - base
            part = data[base : base + int(p[-1]) + length]
            mixed = np.zeros(len(p), dtype=np.uint64)
            for values, powers, inverse, mixer in zip(self.values, self.powers, self.inverse, self.mixers):
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(values[part] * powers[: len(part)], out=sums[1:])
                mixed = stir((sums[p + length] - sums[p]) * inverse[p] * mixer + mixed)
            out[first:last] = mixed
            first = last
        return out


_NAMES: dict[str, Fingerprints] = {}


def names(label: str) -> Fingerprints:
    if label not in _NAMES:
        _NAMES[label] = Fingerprints(label)
    return _NAMES[label]


_TRIPLE = seeded("triple", 3)


class Block:
    """The texts of one block laid end to end."""

    def __init__(self, table: pa.Table, flags: pa.Table) -> None:
        self.items = raw_texts(table)
        self.sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(self.items), dtype=np.uint8)
        #: How often a document counts: twice for one that stands for its copies, which do not count at all.
        self.weights = np.ones(len(self.items), dtype=np.int64)
        own = flags.filter(pa.compute.equal(flags.column("kind"), COPIES))
        here = {h: bool(f[0]) for h, f in zip(own.column("bucket").to_pylist(), own.column("totals").to_pylist())}
        for i, text in enumerate(self.items if here else ()):
            if len(text) >= LENGTH and (h := signed_hash(text)) in here:
                self.weights[i] = 2 if here[h] else 0
                here[h] = False

    def samples(self) -> np.ndarray:
        """Places of sampled suffixes in documents long enough, with all their three blocks inside the document."""
        cover = np.array(COVER, dtype=np.int64)
        parts = [np.zeros(0, np.int64)]
        for end, size, weight in zip(self.ends, self.sizes, self.weights):
            if size >= LENGTH and weight:
                periods = np.arange(-(-size // PERIOD), dtype=np.int64) * PERIOD
                own = (periods[:, None] + cover[None, :]).reshape(-1)
                parts.append(own[own <= size - 3 * BLOCK] + (end - size))
        return np.concatenate(parts)

    def triples(self, samples: np.ndarray) -> np.ndarray:
        f = names("block")
        return stir(sum(f.at(self.data, samples + k * BLOCK, BLOCK) * _TRIPLE[k] for k in range(3)))

    def remaining(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of LENGTH bytes inside a document that lie less than PERIOD before a repeated sample."""
        if not len(repeated):
            return repeated
        doc = np.searchsorted(self.ends, repeated, side="right")
        first = np.maximum(repeated - PERIOD + 1, self.ends[doc] - self.sizes[doc])
        last = np.minimum(repeated, self.ends[doc] - LENGTH)
        return from_spans(*merged(first, last + 1))

    def weight_at(self, places: np.ndarray) -> np.ndarray:
        return self.weights[np.searchsorted(self.ends, places, side="right")]

    def removed(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end place, and document, of the removed runs: of repeated strings, and copies as a whole."""
        doc = np.searchsorted(self.ends, starts, side="right")
        new = np.concatenate([[True], (starts[1:] > starts[:-1] + LENGTH) | (doc[1:] != doc[:-1])])[: len(starts)]
        at = np.flatnonzero(new)
        last = starts[np.concatenate([at[1:], [len(starts)]]) - 1] + LENGTH if len(starts) else starts
        copies = np.flatnonzero(self.weights == 0)
        first = np.concatenate([starts[at], self.ends[copies] - self.sizes[copies]])
        order = np.argsort(first, kind="stable")
        return first[order], np.concatenate([last, self.ends[copies]])[order], np.concatenate([doc[at], copies])[order]


def signed_hash(text: bytes) -> int:
    """What ``xxhash64`` gives for the text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def copy_flags(blocked: DataFrame) -> DataFrame:
    """For each block and each text with copies, the text's hash and whether the block holds the copy that counts.

    Shaped as totals, so that it travels with them. Texts are equal if their xxhash64, crc32 and length are.
    """
    key = ["bucket", "crc", "n"]
    hashed = blocked.select("block", F.xxhash64("text").alias("bucket"), F.crc32("text").alias("crc"), F.octet_length("text").alias("n")).filter(F.col("n") >= LENGTH)
    by_block = hashed.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("k"))
    groups = by_block.groupBy(*key).agg(F.sum("k").alias("copies"), F.min("block").alias("first")).filter("copies > 1")
    flag = F.when(F.col("block") == F.col("first"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    return stage(by_block.join(groups, key).select(F.lit(COPIES).alias("kind"), "bucket", "block", flag.alias("totals")), "copies")


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans whose first places ascend; empty ones are left out."""
    real = end > first
    first, end = first[real], np.maximum.accumulate(end[real]) if real.any() else end[real]
    new = np.concatenate([[True], first[1:] > end[:-1]])[: len(first)]
    at = np.flatnonzero(new)
    return first[at], end[np.concatenate([at[1:], [len(first)]]) - 1] if len(first) else end


def from_spans(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    sizes = end - first
    if not len(sizes):
        return np.zeros(0, np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.arange(sizes.sum(), dtype=np.int64) + np.repeat(first - offset, sizes)


def _repeats(rows: DataFrame, finish: Callable[[pa.Table, Block, tuple], pa.Table], empty: Callable[[], pa.Table], ddl: str) -> DataFrame:
    """``finish(table, block, removed runs)`` for every block of ``rows``, which hold doc_id, text and more."""
    _, text_bytes = corpus_size(rows)
    sample_bits = tally.bucket_bits(text_bytes * len(COVER) / PERIOD)
    whole_bits = tally.bucket_bits(text_bytes * 0.15)
    blocked = tally.blocks(rows, text_bytes, BLOCK_BYTES)

    def asked(kind: int, number: int, block: Block, places: np.ndarray, keys: np.ndarray, bits: int) -> pa.Table:
        unique, _, counts = tally.counted(keys, block.weight_at(places))
        return tally.asked_table(list(tally.ask(kind, number, unique, counts, bits, short=kind == SAMPLED)))

    def repeated(keys: np.ndarray, kind: int, totals: pa.Table) -> np.ndarray:
        _, place = np.unique(keys, return_inverse=True)
        return tally.answers(totals, kind, np.uint8)[place] > 1

    def ask_samples(table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return tally.asked_table([])
        block = Block(table, flags)
        samples = block.samples()
        return asked(SAMPLED, table.column("block")[0].as_py(), block, samples, block.triples(samples), sample_bits)

    def remaining(block: Block, totals: pa.Table) -> np.ndarray:
        samples = block.samples()
        return block.remaining(samples[repeated(block.triples(samples), SAMPLED, totals)]) if len(samples) else samples

    def ask_remaining(table: pa.Table, totals: pa.Table) -> pa.Table:
        if not table.num_rows:
            return tally.asked_table([])
        block = Block(table, totals)
        starts = remaining(block, totals)
        return asked(WHOLE, table.column("block")[0].as_py(), block, starts, names("whole").at(block.data, starts, LENGTH), whole_bits)

    def end(table: pa.Table, totals: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty()
        block = Block(table, totals)
        starts = remaining(block, totals)
        if len(starts):
            starts = starts[repeated(names("whole").at(block.data, starts, LENGTH), WHOLE, totals)]
        return finish(table, block, block.removed(starts))

    by_block = blocked.groupBy("block")
    flags = copy_flags(blocked)
    capped = {SAMPLED: 2, WHOLE: 2}
    sampled = tally.totals(by_block.cogroup(flags.groupBy("block")).applyInArrow(ask_samples, tally.ASKED), (SAMPLED,), capped).unionByName(flags)
    whole = tally.totals(by_block.cogroup(sampled.groupBy("block")).applyInArrow(ask_remaining, tally.ASKED), (SAMPLED,), capped)
    return by_block.cogroup(sampled.unionByName(whole).groupBy("block")).applyInArrow(end, ddl)


def kept(block: Block, runs: tuple) -> list[bytes]:
    """Each document's bytes outside the removed runs, joined."""
    first, end, doc = runs
    out = list(block.items)
    cuts = np.searchsorted(doc, np.arange(len(out) + 1))
    for i in np.unique(doc):
        base = int(block.ends[i] - block.sizes[i])
        edges = [base, *np.stack([first[cuts[i] : cuts[i + 1]], end[cuts[i] : cuts[i + 1]]], axis=1).reshape(-1).tolist(), int(block.ends[i])]
        out[i] = b"".join(block.items[i][a - base : b - base] for a, b in zip(edges[::2], edges[1::2]))
    return out


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""

    def finish(table: pa.Table, block: Block, runs: tuple) -> pa.Table:
        first, end, doc = runs
        n = len(block.items)
        return arrow_table(_OUT, {
            "doc_id": table.column("doc_id"), "n_bytes": block.sizes, "n_removed": np.bincount(doc, weights=end - first, minlength=n).astype(np.int64),
            "n_spans": np.bincount(doc, minlength=n), "kept_sha256": [sha256_hex(x) for x in kept(block, runs)],
        })

    return _repeats(texts(docs), finish, lambda: arrow_table(_OUT, {c.split()[0]: [] for c in _OUT.split(", ")}), _OUT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, n_chars) with repeated strings cut from the text and n_chars counted anew.

    A character of which a cut leaves only some bytes goes as well. A row whose text is cut to nothing stays, with an empty text.
    """
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
    )
    fields = [part.split()[0] for part in ddl.split(", ")]

    def finish(table: pa.Table, block: Block, runs: tuple) -> pa.Table:
        left = [x.decode("utf-8", "ignore") for x in kept(block, runs)]
        return arrow_table(ddl, {"doc_id": table.column("doc_id"), "text": left, "lang": table.column("lang"), "source": table.column("source"), "n_chars": [len(x) for x in left]})

    return _repeats(rows, finish, lambda: arrow_table(ddl, {c: [] for c in fields}), ddl)
