"""Operator 8: token ids in flat files of unsigned integers with 64-bit document offsets.

A folder holds, for each part k of the documents in ascending id order,

* ``part-k.ids``: the ids of its documents one after the other, unsigned little-endian integers of the smallest
  of 2 or 4 bytes that holds every id of the vocabulary;
* ``part-k.off``: unsigned 64-bit offsets, in ids from the start of the file, of its documents and of its end;
* ``part-k.doc``: signed 64-bit document ids (the smallest value: no id);

and ``index.json`` with the integer size and, for each part, its name and its first document and first id among
all, which are prefix sums over the parts. The files are read by memory-mapping them.

Texts are encoded where they lie; only ids are shuffled. A part is sorted and written as a stream. A file gets
its name by a rename after it is complete, so a repeated task replaces it by the same bytes.

A chunk between blanks and line feeds is encoded alone and remembered: the tokenizer drops white space and looks
at no neighbouring word.

Defined cases: a null or empty text is the end id alone; rows of one id are ordered by their ids' bytes, so
repeated rows each get a row; no documents make an index without parts; other columns of the input are never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradewind.llm import ordered
from tradewind.llm.common import arrow_table, corpus_size, map_batches, raw_texts, texts

END_ID = 1
REMEMBERED_LENGTH, REMEMBERED = 48, 250_000
#: Chunks that hold one word, or one word and one run of marks behind it.
_SIMPLE = re.compile("([a-zß-öø-ÿ]+)([.,;:!?*&#$%@]+)?")
_WRITTEN = "part int, n_docs long, n_ids long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """The tokenizer with remembered chunks as bytes of the file's integers, in two tables: a full one becomes the older one."""

    held: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, integer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # Lower-case words need no normalizing; nor does the library's own memory help, since no word is asked twice.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words.model._resize_cache(0)
        self.integer, self.size = integer, np.dtype(integer).itemsize
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.end = np.array([END_ID], dtype=integer).tobytes()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks_ends = bool(self.ends.any())

    @classmethod
    def of(cls, path: str, integer: str) -> Encoder:
        if (path, integer) not in cls.held:
            cls.held[path, integer] = cls(path, integer)
        return cls.held[path, integer]

    def _made(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk. Words go through the library as one text, each of them ends with an id of a token's end; marks behind them and other chunks as they are."""
        found = [_SIMPLE.fullmatch(c) if self.marks_ends else None for c in chunks]
        words = list({m[1] for m in found if m})
        others = list({m[2] for m in found if m and m[2]} | {c for c, m in zip(chunks, found) if not m})
        out = {c: np.array(x.ids, dtype=self.integer).tobytes() for c, x in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False))}
        if words:
            ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.integer)
            data, cuts = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * self.size).tolist()
            out.update(zip(words, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
        return {c: out[c] if m is None or not m[2] else out[m[1]] + out[m[2]] for c, m in zip(chunks, found)}

    def _looked_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks, remembered or new."""
        if len(self.memory) > REMEMBERED:
            self.older, self.memory = self.memory, {}
        found = list(map(self.memory.get, chunks))
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = self.older.get(chunks[i])
        new = [i for i in missing if found[i] is None]
        made = self._made([chunks[i] for i in new])
        for i in new:
            found[i] = made[chunks[i]]
        self.memory.update((chunks[i], found[i]) for i in missing if len(chunks[i]) <= REMEMBERED_LENGTH)
        return found

    def encode(self, items: list[bytes]) -> list[bytes]:
        """Ids of each text with the end id. Each different chunk of the texts is looked up once; the rest is array work."""
        parts = pc.split_pattern(pa.array([_blanked(t) for t in items], pa.large_string()), " ")
        coded = parts.values.dictionary_encode()
        ids = [*self._looked_up(coded.dictionary.to_pylist()), self.end]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.size
        flat = np.frombuffer(b"".join(ids), dtype=self.integer)
        stops = parts.offsets.to_numpy()[1:]
        order = np.insert(coded.indices.to_numpy(), stops, len(ids) - 1)
        taken = sizes[order]
        ends = np.cumsum(taken)
        data = flat[np.repeat((np.cumsum(sizes) - sizes)[order] - (ends - taken), taken) + np.arange(ends[-1])].tobytes()
        cuts = (ends[stops + np.arange(len(items))] * self.size).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]


def _blanked(raw: bytes) -> bytes:
    """A text with blanks for line feeds. The tokenizer lowers A-Z itself; lowering them first, unless special tokens may be spelt, lets more chunks be equal."""
    return (raw if b"<|" in raw else raw.lower()).replace(b"\n", b" ")


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _Part:
    """One part's three files while they are written."""

    def __init__(self, folder: str, number: int) -> None:
        self.system, self.root = _files(folder)
        self.number, self.mark = number, uuid.uuid4().hex
        self.streams = {kind: self.system.open_output_stream(self._temporary(kind)) for kind in ("ids", "off", "doc")}
        self.n_docs = self.n_ids = 0

    def _temporary(self, kind: str) -> str:
        return f"{self.root}/tmp-{self.mark}.{kind}"

    def add(self, doc_ids: np.ndarray, ids: list[bytes], size: int) -> None:
        counts = np.array([len(x) // size for x in ids], dtype=np.uint64)
        starts = np.cumsum(counts) - counts + np.uint64(self.n_ids)
        for kind, data in (("ids", b"".join(ids)), ("off", starts.astype("<u8").tobytes()), ("doc", doc_ids.astype("<i8").tobytes())):
            self.streams[kind].write(data)
        self.n_docs += len(ids)
        self.n_ids += int(counts.sum())

    def close(self) -> tuple[int, int, int]:
        self.streams["off"].write(np.array([self.n_ids], dtype="<u8").tobytes())
        for kind, stream in self.streams.items():
            stream.close()
            self.system.move(self._temporary(kind), f"{self.root}/{part_name(self.number)}.{kind}")
        return self.number, self.n_docs, self.n_ids


def part_name(number: int) -> str:
    return f"part-{number:08d}"


def write(docs: DataFrame, folder: str, tokenizer_path: str, part_bytes: int = ordered.PART_BYTES) -> dict:
    """Write the documents' ids to ``folder`` and return the index, which is stored beside them."""
    from tokenizers import Tokenizer

    small = Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16
    kind, size = ("<u2", 2) if small else ("<u4", 4)
    rows = texts(docs).withColumn("at", F.coalesce("doc_id", F.lit(ordered.NO_ID)))
    _, text_bytes = corpus_size(rows)
    placed = ordered.with_part(rows, ordered.bounds(rows.select("at"), text_bytes, part_bytes))
    system, root = _files(folder)
    system.create_dir(root, recursive=True)

    def encode(batch: pa.RecordBatch) -> dict:
        ids = Encoder.of(tokenizer_path, kind).encode(raw_texts(batch))
        return {"part": batch.column("part"), "at": batch.column("at"), "ids": ids}

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = None, []
        for batch in batches:
            numbers, at, ids = batch.column("part").to_numpy(), batch.column("at").to_numpy(), batch.column("ids").to_pylist()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if part is None or part.number != numbers[a]:
                    done += [part.close()] if part else []
                    part = _Part(folder, int(numbers[a]))
                part.add(at[a:b], ids[a:b], size)
        done += [part.close()] if part else []
        if done:
            yield from arrow_table(_WRITTEN, {c: list(x) for c, x in zip(("part", "n_docs", "n_ids"), zip(*done))}).to_batches()

    encoded = map_batches(placed, encode, "part int, at long, ids binary")
    written = encoded.repartition("part").sortWithinPartitions("part", "at", "ids").mapInArrow(store, _WRITTEN).collect()
    index = {"integer": kind, "end_id": END_ID, "parts": []}
    docs_before = ids_before = 0
    for row in sorted(written):
        index["parts"].append({"name": part_name(row["part"]), "first_doc": docs_before, "first_id": ids_before, "n_docs": row["n_docs"], "n_ids": row["n_ids"]})
        docs_before, ids_before = docs_before + row["n_docs"], ids_before + row["n_ids"]
    with system.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def _mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is mounted, else read through its file system."""
    system, root = _files(folder)
    if isinstance(system, fs.LocalFileSystem):
        path = f"{root}/{name}"
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with system.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_index(folder: str) -> dict:
    system, root = _files(folder)
    with system.open_input_file(f"{root}/index.json") as f:
        return json.loads(f.read())


def read_part(folder: str, name: str, integer: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Document id, start inside the part and ids of each document of a part."""
    ids, offsets, doc_ids = _mapped(folder, f"{name}.ids", integer), _mapped(folder, f"{name}.off", "<u8"), _mapped(folder, f"{name}.doc", "<i8")
    for i, doc_id in enumerate(doc_ids.tolist()):
        start, end = int(offsets[i]), int(offsets[i + 1])
        yield None if doc_id == ordered.NO_ID else doc_id, start, ids[start:end]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; one task reads one part."""
    index = read_index(folder)
    integer = index["integer"]
    parts = [(p["name"], p["first_id"]) for p in index["parts"]]
    if not parts:
        return spark.createDataFrame([], _READ)
    names = F.element_at(F.lit([p[0] for p in parts]), F.col("id").cast("int") + 1).alias("name")
    firsts = F.element_at(F.lit([p[1] for p in parts]).cast("array<bigint>"), F.col("id").cast("int") + 1).alias("first_id")
    table = spark.range(0, len(parts), 1, min(len(parts), 10_000)).select(names, firsts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first_id").to_pylist()):
                rows = [(doc_id, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, start, ids in read_part(folder, name, integer)]
                yield from arrow_table(_READ, {c.split()[0]: list(x) for c, x in zip(_READ.split(", "), zip(*rows))}).to_batches()

    return table.mapInArrow(run, _READ)
