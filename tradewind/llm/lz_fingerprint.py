"""Operator 2: fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed from left to right into the shortest phrases that are not in its dictionary
yet, each of which joins it. Texts that compress each other well share many phrases, so the likeness of two
texts is the Jaccard similarity of their phrase sets. It is estimated from a signature: phrases are hashed
into BINS bins, and each bin keeps the smallest 16-bit value. The likeness is the share of equal bins among
those not empty in both signatures.

The edited text shares its first three quarters with the text, and so does its parse: it is parsed once and
continued with either end.

Documents meet their successor in id order inside parts that are sorted and streamed (``ordered``); texts
are shuffled once and never grouped in memory.

Defined cases: a null or empty text has no phrases, and two such have likeness 1; a text of under four code
points is its own edited text; the only document is its own successor; rows without an id come first; rows of
one id follow each other in the order of their texts' hashes, so repeated rows each get a row; other columns
of the input are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradewind.llm import ordered
from tradewind.llm.common import arrow_table, corpus_size, raw_texts, sha256_hex, stir, texts

BINS_LOG2, VALUE_BITS = 7, 16
BINS = 1 << BINS_LOG2
EMPTY = (1 << VALUE_BITS) - 1
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def parse(data: bytes, seen: set[bytes]) -> tuple[list[bytes], bytes]:
    """New phrases of ``data``, which are put into ``seen``, and the unfinished phrase at its end."""
    added, start = [], 0
    for end in range(1, len(data) + 1):
        phrase = data[start:end]
        if phrase not in seen:
            seen.add(phrase)
            added.append(phrase)
            start = end
    return added, data[start:]


def hashes(phrases: list[bytes]) -> np.ndarray:
    """Bin and value of each phrase in one number."""
    crc = np.fromiter(map(zlib.crc32, phrases), dtype=np.uint64, count=len(phrases))
    length = np.fromiter(map(len, phrases), dtype=np.uint64, count=len(phrases))
    return stir(crc + (length << np.uint64(32))) >> np.uint64(64 - BINS_LOG2 - VALUE_BITS)


def signature(numbers: np.ndarray) -> np.ndarray:
    out = np.full(BINS, EMPTY, dtype=np.uint16)
    if len(numbers):
        numbers = np.sort(numbers)
        bins = (numbers >> np.uint64(VALUE_BITS)).astype(np.int64)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        out[bins[first]] = np.minimum(numbers[first] & np.uint64(EMPTY), EMPTY - 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def shown(sign: np.ndarray) -> str:
    """Four hexadecimal digits a bin; ffff is an empty bin."""
    return sign.astype(">u2").tobytes().hex()


@dataclass
class Document:
    """A text with its parse: the signature, and what the edited text's parse continues from."""

    doc_id: int | None
    text: str

    def __post_init__(self) -> None:
        cut = len(self.text) // 4
        self.tail = cut
        self.head = self.text[: len(self.text) - cut]
        self.seen: set[bytes] = set()
        shared, self.rest = parse(self.head.encode(), self.seen)
        own, _ = parse(self.rest + self.text[len(self.head) :].encode(), self.seen)
        self.seen.difference_update(own)
        self.shared = hashes(shared)
        self.signature = signature(np.concatenate([self.shared, hashes(own)]))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """Hash of the edited text, and its signature; uses up the parse."""
        end = following[: self.tail].encode()
        added, _ = parse(self.rest + end, self.seen)
        self.seen = set()
        return sha256_hex(self.head.encode() + end), signature(np.concatenate([self.shared, hashes(added)]))


def _row(doc: Document, following: Document) -> tuple:
    digest, edited = doc.edited(following.text)
    return doc.doc_id, len(doc.text), digest, shown(doc.signature), shown(edited), likeness(doc.signature, edited), likeness(doc.signature, following.signature)


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by part, guests last: each of a part's own rows meets the row behind it."""
    before: Document | None = None
    part = None
    for batch in batches:
        rows = []
        for doc_id, number, guest, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("guest").to_pylist(), raw_texts(batch)):
            if number != part:
                part, before = number, None
            elif before is None:
                continue
            doc = Document(doc_id, text.decode())
            if before is not None:
                rows.append(_row(before, doc))
            before = None if guest else doc
        if rows:
            yield from arrow_table(_OUT, {c.split()[0]: list(x) for c, x in zip(_OUT.split(", "), zip(*rows))}).to_batches()


def fingerprints(docs: DataFrame, part_bytes: int = ordered.PART_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    rows = texts(docs).withColumn("at", F.coalesce("doc_id", F.lit(ordered.NO_ID)))
    _, text_bytes = corpus_size(rows)
    cuts = ordered.bounds(rows.select("at"), text_bytes, part_bytes)
    placed = ordered.with_successor(rows, cuts).repartition("part")
    return placed.sortWithinPartitions("part", "guest", "at", F.xxhash64("text")).select("doc_id", "part", "guest", "text").mapInArrow(_stream, _OUT)
