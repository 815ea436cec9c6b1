"""Operator 4: SentencePiece encoding and decoding of a merge-type vocabulary with byte fallback.

Every prefix of a text has exactly one last token in its encoding, so one table of last tokens is the whole
encoding. It is filled from left to right: an automaton gives all pieces that end at a position; exactly
one of them fits behind the last token of the prefix before it, which the pair test decides; the ids are
then read backwards from the end.

A pair of tokens fits if merging their joined text gives just this pair. The test undoes the merges of
both tokens in the order opposite to that of merging, latest first: while it does, no merge across the
border may come before the one that is undone next.

No piece holds the space mark behind another character, but for pure runs of marks whose merges come last
of all. A text therefore falls into units (a mark and what follows up to the next one) that are encoded
alone and remembered, and runs of single marks are then joined from the left.

Defined cases: a null text counts as empty and gives the end id alone; a character outside the vocabulary
gives its byte tokens; the literal space mark is a space, as in the library; very long units are encoded
in time linear in their length and not remembered; repeated rows each get a row; other columns of the
input are never read.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradewind.llm.common import map_batches, raw_texts, sha256_hex, texts

MARK = "▁"
#: Units up to this length are remembered, twice this many at most in a task: a full table becomes the older one.
REMEMBERED_LENGTH, REMEMBERED = 48, 100_000
#: Answers of the pair test that a task remembers at most.
REMEMBERED_PAIRS = 400_000


class PieceModel:
    """The vocabulary read from a model file: pieces, merge ranks, splits and the automaton."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        self.end = library.eos_id()
        self.control = {i for i in range(size) if library.is_control(i)}
        self.unknown = library.unk_id()
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if library.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        special = {*self.control, *self.byte_of, self.unknown}
        self.runs = {len(p): i for i, p in enumerate(self.pieces) if i not in special and set(p) == {MARK}}
        self.mark = self.runs.get(1)
        self.rank: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if i not in special and not (len(p) > 1 and i in self.runs.values()):
                self.id_of[p] = i
                if len(p) > 1:
                    self.rank[p] = -library.get_score(i)
        if any(MARK in p[1:] for p in self.id_of):
            raise ValueError("a piece holds the space mark behind another character")
        self.parts: dict[str, tuple[str, str]] = {}
        for p in sorted(self.rank, key=len):
            if parts := self._last_merge(p):
                if any(self.rank.get(x, -1.0) >= self.rank[p] for x in parts):
                    raise ValueError("a merge ranks before one of its parts")
                self.parts[p] = parts
        #: For each piece, whether it fits behind a token (-1: behind nothing).
        self.known: list[dict[int, bool]] = []
        self.n_known = 0
        automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if len(p) == 1 or p in self.parts:
                automaton.add_word(p, (len(p), self.id_of[p], known := {-1: True}))
                self.known.append(known)
        automaton.make_automaton()
        self.automaton = automaton
        self.alphabet = {p for p in self.id_of if len(p) == 1}
        #: Neighbouring characters inside some piece; between any others there is always a border.
        self.inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        #: What an id decodes to.
        self.spelled = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.sizes = [len(p) for p in self.pieces]
        self.shown = [str(i) for i in range(size)]
        self.longest_run = max(self.runs, default=1)

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes the piece, or None if merging its characters never gets there."""
        tokens = list(piece)
        while len(tokens) > 1:
            ranked = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in self.rank]
            if not ranked:
                return None
            _, i = min(ranked)
            if len(tokens) == 2:
                return tokens[0], tokens[1]
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
        return None

    def _fits(self, left: str, right: str) -> bool:
        """Whether the merges of the joined text leave a border between the two tokens.

        ``left_end`` and ``right_end`` are the ranks of the merges that take up the two tokens at the
        border. Of equal merges the left one comes first.
        """
        rank = self.rank
        left_end = right_end = float("inf")
        while True:
            across = rank.get(left + right)
            if across is not None and across < left_end and across <= right_end:
                return False
            a, b = rank.get(left, -1.0), rank.get(right, -1.0)
            if a < 0 and b < 0:
                return True
            if b >= a:
                right_end, right = b, self.parts[right][0]
            else:
                left_end, left = a, self.parts[left][1]

    def _test(self, left: int, piece: int, known: dict[int, bool]) -> bool:
        if self.n_known >= REMEMBERED_PAIRS:
            self.forget()
        self.n_known += 1
        fits = known[left] = self._fits(self.pieces[left], self.pieces[piece])
        return fits

    def forget(self) -> None:
        """Let go of all answers of the pair test."""
        self.n_known = 0
        for answers in self.known:
            answers.clear()
            answers[-1] = True

    def _stretch(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary: the table of last tokens, read backwards."""
        last: list[int | None] = [None] * (len(text) + 1)
        last[0] = -1
        for end, (length, piece, known) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                fits = known.get(left := last[end - length])
                if self._test(left, piece, known) if fits is None else fits:
                    last[end] = piece
        ids, at, sizes = [], len(text), self.sizes
        while at:
            piece = last[at]
            ids.append(piece)
            at -= sizes[piece]
        ids.reverse()
        return ids

    def unit(self, text: str) -> list[int]:
        """Ids of a mark and what follows it up to the next mark."""
        if self.alphabet.issuperset(text):
            return self._stretch(text)
        ids: list[int] = []
        for inside, part in itertools.groupby(text, self.alphabet.__contains__):
            if inside:
                ids += self._stretch("".join(part))
            else:
                ids += [self.byte_id.get(b, self.unknown) for b in "".join(part).encode("utf-8", "surrogatepass")]
        return ids

    def join_marks(self, ids: list[int]) -> list[int]:
        """Runs of single marks joined from the left, as long as pieces of marks go."""
        out: list[int] = []
        count = 0
        for i in [*ids, -1]:
            if i == self.mark:
                count += 1
                continue
            while count:
                size = min(count, self.longest_run)
                out.append(self.runs[size])
                count -= size
            if i >= 0:
                out.append(i)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text with the end id."""
        ids = [i for u in units(text) for i in self.unit(MARK + u)]
        return [*(self.join_marks(ids) if MARK * 2 in MARK + text.replace(" ", MARK) else ids), self.end]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The text of the ids in UTF-8; bytes that make no character become U+FFFD."""
        data = b"".join(map(self.spelled.__getitem__, ids)).removeprefix(b" ")
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode()
        return data


def units(text: str) -> list[str]:
    return (MARK + text).replace(" ", MARK).split(MARK)[1:] if text else []


class Encoder:
    """Whole documents with remembered units; one for each worker and model file.

    A unit is remembered as its ids in 16 bits. Two tables are kept: when the newer one is full it becomes
    the older one, so units in use stay and memory is bounded. A task forgets them at its end, because its worker stays
    for the steps that follow, which need the memory.
    """

    held: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if len(self.model.pieces) > 1 << 16:
            raise ValueError("ids need more than 16 bits")

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _made(self, unit: str) -> bytes:
        made = self.older.get(unit)
        if made is None:
            model = self.model
            end = len(unit)
            while end > 1 and unit[end - 2 : end] not in model.inside:  # the last character is a stretch of its own
                end -= 1
            if end < len(unit):
                stem = unit[:end]
                return (self.memory.get(stem) or self._made(stem)) + array("H", model.unit(unit[end:])).tobytes()
            made = array("H", model.unit(MARK + unit)).tobytes()
        if len(unit) <= REMEMBERED_LENGTH:
            if len(self.memory) >= REMEMBERED:
                self.older, self.memory = self.memory, {}
            self.memory[unit] = made
        return made

    def packed(self, text: str) -> array:
        """Ids of a whole text with the end id, in 16 bits."""
        parts = units(text)
        if "" in parts:
            return array("H", self.model.encode(text))
        get, made = self.memory.get, self._made
        ids = array("H", b"".join([get(u) or made(u) for u in parts]))
        ids.append(self.model.end)
        return ids

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text with the end id."""
        return self.packed(text).tolist()

    @classmethod
    def forget(cls) -> None:
        """Let go of the remembered units and pairs of all models; the models stay."""
        for encoder in cls.held.values():
            encoder.memory, encoder.older = {}, {}
            encoder.model.forget()


def encoded(batch: pa.RecordBatch, model_path: str) -> dict:
    """doc_id, ids and decoded text of a batch. Ids are never all numbers of Python at once, which take 20 times their bytes."""
    encoder = Encoder.of(model_path)
    packed = [encoder.packed(t.decode()) for t in raw_texts(batch)]
    ends = np.cumsum([0, *map(len, packed)], dtype=np.int32)
    values = np.frombuffer(b"".join(packed), dtype=np.uint16).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [encoder.model.decode(i).decode() for i in packed]}


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (with the end id) and the text decoded from them, for every row."""
    return map_batches(texts(docs), lambda batch: encoded(batch, model_path), "doc_id long, ids array<int>, decoded string", Encoder.forget)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row: the same ids, hashed where they are made."""

    def run(batch: pa.RecordBatch) -> dict:
        encoder = Encoder.of(model_path)
        model, out = encoder.model, {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in raw_texts(batch):
            ids = encoder.ids(text.decode())
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha256_hex(" ".join(map(model.shown.__getitem__, ids)).encode()))
            out["decoded_sha256"].append(sha256_hex(model.decode(ids)))
        return out

    return map_batches(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", Encoder.forget)
