"""Operator 12: two tokenizers' tokens of the same bytes aligned by lockstep merging of whole batches.

Both token lists of a document cover the same bytes, so their ends form two ascending lists. One NumPy state vector holds
for every document of a batch the next A token and the next B token. Each step emits the link of the two, compares
their ends, and moves the side that ends first, or both at a cut; finished documents are squeezed out of the vector.
A long document enters as several pieces that begin at ends which both sides share (about every ``PIECE`` tokens), so
that the vector stays full and the number of steps does not follow the longest text.

A pair of ids counts once for each document that links it. A task's batch is a block: it writes its documents' pairs
as 32-bit places in the block's list of different pairs, and that list with the number of its documents. Lists are
added up over the corpus, joined back, and each block's documents are summed from the answers. So a pair that is in
every document travels once a block, and nothing is broadcast.

Defined cases: a null or empty text, and one that a tokenizer does not give back byte for byte, has no tokens, zeros
and an empty digest; repeated rows each get a row and each count; null ids are kept as they are; no documents give
no rows; other columns of the input are never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradewind.llm.common import arrow_table, map_batches, raw_texts, sha256_hex, texts
from tradewind.sources.stages import stage

PIECE = 256
#: Documents whose tokens and links a worker holds at once.
AT_ONCE = 250
REMEMBERED_LENGTH, REMEMBERED = 48, 100_000
_MARK = "▁"
_BLANK = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers with the bytes and the length of every id; one a worker.

    A's ids rise in the order of its merges, so its vocabulary is its list of ranks as well and runs in the faster of the
    two libraries for byte-level merges.
    """

    held: dict[tuple[str, str], Tokenizers] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a) as f:
            described = json.load(f)
        vocabulary, added = described["model"]["vocab"], {x["content"] for x in described["added_tokens"]}
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if token not in added:
                self.bytes_a[i] = bytes(alphabet[c] for c in token)
        ranks = {token: i for i, token in enumerate(self.bytes_a) if token}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.memory: dict[str, tuple[bytes, bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bytes, bool]] = {}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_MARK in p[1:] and set(p) != {_MARK} for p in pieces):
            raise ValueError("a piece holds the space mark behind another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (self.bytes_a, self.bytes_b))
        self.inside = [np.array([f"{i}," for i in range(len(x))], dtype=object) for x in (self.bytes_a, self.bytes_b)]
        self.last = [np.array([f"{i}{end}" for i in range(len(x))], dtype=object) for x, end in ((self.bytes_a, "|"), (self.bytes_b, ";"))]

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Tokenizers:
        if (path_a, path_b) not in cls.held:
            cls.held[path_a, path_b] = cls(path_a, path_b)
        return cls.held[path_a, path_b]

    def _made(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of both for each chunk, and whether the joined bytes are a space and the chunk."""
        out = []
        for chunk, b in zip(chunks, self.b.encode(chunks, num_threads=1)):
            a = self.a.encode_ordinary(" " + chunk)
            want = b" " + chunk.encode()
            same = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
            out.append((np.array(a, dtype="<i4").tobytes(), np.array(b, dtype="<i4").tobytes(), same))
        return out

    def encode(self, raw: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; both empty where the joined bytes differ from a space and the text.

        Neither side has a token that crosses a single blank between two other characters: chunks between such blanks are
        encoded alone and remembered, in two tables of ``REMEMBERED`` chunks, of which a full one becomes the older one.
        """
        items = [t.decode() for t in raw]
        chunks = [_BLANK.split(t) for t in items]
        memory, older = self.memory, self.older
        table = {}
        missing = []
        for chunk in set().union(*chunks):
            found = memory.get(chunk) or older.get(chunk)
            if found is None:
                missing.append(chunk)
            else:
                table[chunk] = found
        table.update(zip(missing, self._made(missing)))
        if len(memory) + len(table) > REMEMBERED:
            self.older, self.memory = memory, {}
        self.memory.update((c, x) for c, x in table.items() if len(c) <= REMEMBERED_LENGTH)
        none = np.zeros(0, np.int64)
        out_a, out_b = [], []
        for text, own in zip(items, chunks):
            parts = [table[c] for c in own]
            same = bool(text) and all(x[2] for x in parts)
            out_a.append(np.frombuffer(b"".join([x[0] for x in parts]), dtype="<i4").astype(np.int64) if same else none)
            out_b.append(np.frombuffer(b"".join([x[1] for x in parts]), dtype="<i4").astype(np.int64) if same else none)
        return out_a, out_b


@dataclass
class Alignment:
    """Links of a batch as places of its joined token lists, their documents, and which tokens of each side end at a cut."""

    link_a: np.ndarray
    link_b: np.ndarray
    doc: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _ends(lengths: list[np.ndarray], base: np.ndarray) -> np.ndarray:
    """Byte ends of joined token lists; each document begins at its base."""
    return np.concatenate([np.cumsum(x) + at for x, at in zip(lengths, base)] + [np.zeros(0, np.int64)])


def _pieces(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, sizes_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First A and B token of each piece and its document: documents' starts, and behind shared ends after every ``PIECE`` A tokens."""
    first_a, first_b, doc = [starts_a], [starts_b], [np.arange(len(starts_a))]
    for d in np.flatnonzero(sizes_a > 2 * PIECE):
        begin, stop = starts_a[d], starts_a[d] + sizes_a[d]
        for target in range(begin + PIECE, stop - PIECE, PIECE):
            near = np.arange(target, target + PIECE)
            at = np.searchsorted(ends_b, ends_a[near])
            shared = np.flatnonzero(ends_b[at] == ends_a[near])
            if len(shared):
                first_a.append(near[shared[:1]] + 1)
                first_b.append(at[shared[:1]] + 1)
                doc.append(np.array([d]))
    return np.concatenate(first_a), np.concatenate(first_b), np.concatenate(doc)


def lockstep(lengths_a: list[np.ndarray], lengths_b: list[np.ndarray]) -> Alignment:
    """Alignment of a batch from the byte lengths of both sides' tokens; each document's lengths have equal sums."""
    sizes_a, sizes_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (lengths_a, lengths_b))
    starts_a, starts_b = _starts(sizes_a), _starts(sizes_b)
    base = _starts(np.array([x.sum() for x in lengths_a], dtype=np.int64))
    ends_a, ends_b = _ends(lengths_a, base), _ends(lengths_b, base)
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    full = np.flatnonzero(sizes_a)
    i, j, doc = _pieces(ends_a, ends_b, starts_a[full], sizes_a[full], starts_b[full])
    order = np.argsort(i)
    i, j, doc = i[order], j[order], full[doc[order]]
    stop = np.concatenate([i[1:], [len(ends_a)]])  # pieces and documents with tokens lie one behind the other
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(i):
        links.append((i, j, doc))
        a, b = ends_a[i], ends_b[j]
        cut = a == b
        cut_a[i[cut]] = cut_b[j[cut]] = True
        i, j = i + (a <= b), j + (b <= a)
        going = i < stop
        if not going.all():
            i, j, doc, stop = i[going], j[going], doc[going], stop[going]
    joined = [np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in range(3)]
    return Alignment(*joined, cut_a, cut_b)


def rendered(model: Tokenizers, ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, sizes_a: np.ndarray, sizes_b: np.ndarray) -> list[str]:
    """Each document's groups as text: a group's A ids, a bar, its B ids; groups are separated by semicolons."""
    group_a, group_b = (np.cumsum(cut) - cut for cut in (found.cut_a, found.cut_b))
    before_b = np.searchsorted(group_b, group_a, side="left")
    through_a = np.searchsorted(group_a, group_b, side="right")
    parts = np.empty(len(ids_a) + len(ids_b), dtype=object)
    for side, (ids, cut, at) in enumerate(((ids_a, found.cut_a, np.arange(len(ids_a)) + before_b), (ids_b, found.cut_b, np.arange(len(ids_b)) + through_a))):
        parts[at] = np.where(cut, model.last[side][ids], model.inside[side][ids])
    stops = np.cumsum(sizes_a + sizes_b)
    return ["".join(parts[b - n : b].tolist())[:-1] for n, b in zip(sizes_a + sizes_b, stops)]


_BLOCK = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks: rows of kind 0 are documents (``pairs``: 32-bit places in the block's list, ``times``: links of each), a row of
    kind 1 is the list itself (``pairs``: id of A * 2^32 + id of B, ``times``: the block's documents with the pair)."""

    def part(raw: list[bytes]) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        """Columns of a few documents, and their different pairs: how many each document has, which, and how often."""
        model, n = Tokenizers.of(path_a, path_b), len(raw)
        all_a, all_b = model.encode(raw)
        found = lockstep([model.length_a[x] for x in all_a], [model.length_b[x] for x in all_b])
        ids_a, ids_b = np.concatenate(all_a), np.concatenate(all_b)
        sizes_a, sizes_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (all_a, all_b))
        listed, place = np.unique(ids_a[found.link_a] << 32 | ids_b[found.link_b], return_inverse=True)
        keyed, times = np.unique(found.doc * len(listed) + place, return_counts=True)
        owner, place = np.divmod(keyed, max(1, len(listed)))
        columns = {
            "n_a": sizes_a, "n_b": sizes_b, "n_groups": np.bincount(np.repeat(np.arange(n), sizes_a)[found.cut_a], minlength=n), "n_links": np.bincount(found.doc, minlength=n),
            "groups_sha256": [sha256_hex(t.encode()) if t else "" for t in rendered(model, ids_a, ids_b, found, sizes_a, sizes_b)],
        }
        return columns, np.bincount(owner, minlength=n), listed[place], times.astype("<u4")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        raw = raw_texts(batch)
        parts = [part(raw[i : i + AT_ONCE]) for i in range(0, len(raw), AT_ONCE)]
        columns = {c: np.concatenate([p[0][c] for p in parts]) for c in ("n_a", "n_b", "n_groups", "n_links")}
        columns["groups_sha256"] = [x for p in parts for x in p[0]["groups_sha256"]]
        listed, place = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        place, times = place.astype("<u4"), np.concatenate([p[3] for p in parts])
        ends = np.cumsum(np.concatenate([p[1] for p in parts])).tolist()
        cuts = list(zip([0, *ends], ends))
        own = {"kind": [0] * len(raw), "doc_id": batch.column("doc_id")}
        yield own | columns | {"pairs": [place[a:b].tobytes() for a, b in cuts], "times": [times[a:b].tobytes() for a, b in cuts]}
        in_docs = np.bincount(place, minlength=len(listed)).astype("<u4")
        nothing = {c: [None] for c in ("doc_id", *columns)}
        yield {"kind": [1], **nothing, "pairs": [listed.astype("<i8").tobytes()], "times": [in_docs.tobytes()]}

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                for columns in run(batch):
                    columns["block"] = [block] * len(columns["kind"])
                    yield from arrow_table(_BLOCK, columns).to_batches()
                block += 1

    return texts(docs).mapInArrow(numbered, _BLOCK)


_ASKED = "block long, place int, pair long, times long"


def _asked(blocks: DataFrame) -> DataFrame:
    """(block, place, pair, times): the lists of all blocks, one row for each different pair of a block."""

    def run(batch: pa.RecordBatch) -> dict:
        lists = [np.frombuffer(x, dtype="<i8") for x in batch.column("pairs").to_pylist()]
        sizes = [len(x) for x in lists]
        return {
            "block": np.repeat(batch.column("block").to_numpy(), sizes), "pair": np.concatenate(lists),
            "place": np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]),
            "times": np.concatenate([np.frombuffer(x, dtype="<u4") for x in batch.column("times").to_pylist()]).astype(np.int64),
        }

    return map_batches(blocks.filter("kind = 1").select("block", "pairs", "times"), run, _ASKED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): documents that link a pair of ids, and whether no other pair of its A id has more."""
    counts = stage(_asked(blocks).groupBy("pair").agg(F.sum("times").alias("count")), "alignment-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


_SUMS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(own: pa.Table, answers: pa.Table) -> pa.Table:
    count, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    place = answers.column("place").to_numpy()
    count[place], best[place] = answers.column("count").to_numpy(), answers.column("best").to_numpy()
    pairs = [np.frombuffer(x, dtype="<u4") for x in own.column("pairs").to_pylist()]
    times = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in own.column("times").to_pylist()]
    sums = {"n_best": [int(best[p] @ t) for p, t in zip(pairs, times)], "count_sum": [int(count[p] @ t) for p, t in zip(pairs, times)]}
    kept = {c: own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    return arrow_table(_SUMS, kept | sums)


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    blocks = stage(align(docs, path_a, path_b), "alignment-blocks")
    answers = _asked(blocks).select("block", "place", "pair").join(pair_counts(blocks), "pair").select("block", "place", "count", "best")
    return blocks.filter("kind = 0").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_summed, _SUMS)
