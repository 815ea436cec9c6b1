"""Operator 11: spelling variants grouped by range searches in k-d trees over letter-count vectors.

A word is a maximal run of letters (a-z after lower-casing A-Z, and U+00C0 to U+00FF) of at least ``LENGTH`` code
points that occurs at least ``TIMES`` times. Two words are near if one inserted, deleted or replaced code point
turns one into the other. Such an edit moves the vector of letter counts by at most two in L1 distance: a
replacement takes one letter and adds another, an insertion adds one. So near words of lengths (k, k) and
(k, k + 1) are found by range searches in the tree of length k or k + 1.

The upper levels of a length's tree cut its words into cells of about ``CELL`` words. A word lives in its own
cell and visits the other cells that the search box reaches: those of its length behind its own, and those of the
words one longer. So a pair meets in one cell. A task takes a cell, builds the tree's lower levels, prunes by
bounding boxes and checks the letter order of what is left. The cuts come from at most ``SAMPLE`` words of each
length, picked by a hash; they only balance the cells, each word is placed and searched.

A word's form is the most frequent of its near words, if it is ``RATIO`` times as frequent as the word; its root is
where the chain of forms ends. A chain has at most log(count) / log(RATIO) steps and is followed by doubling.

Defined cases: a null text has no words; with planted typos a null id counts as an empty one; repeated rows count each
time; no documents give no words; other columns of the input are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradewind.llm.common import arrow_table, raw_texts, texts
from tradewind.sources.stages import stage

LENGTH, TIMES, RATIO, TYPO = 7, 2, 10, 31
CELL, SAMPLE, LEAF = 8192, 32_768, 32
#: Different words that a task adds up before it hands them on.
HELD = 400_000
DIMS = 32
_DIM_OF = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], dtype=np.int64)
_MOST = 30_000


# ---- counting


def word_counts(docs: DataFrame, typos: int | None = None) -> DataFrame:
    """(word, n) over whole texts. With ``typos`` every run whose crc32 with its document's id it divides loses a letter."""
    least = LENGTH
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
                for word, times in Counter(runs.findall(text.lower().decode())).items():
                    if typos and not (h := zlib.crc32(word.encode(), start)) % typos:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    seen[word] += times
            if len(seen) > HELD:
                yield from arrow_table("word string, n long", {"word": list(seen), "n": list(seen.values())}).to_batches()
                seen = Counter()
        yield from arrow_table("word string, n long", {"word": list(seen), "n": list(seen.values())}).to_batches()

    partial = texts(docs).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TIMES)


# ---- trees


@dataclass
class Node:
    """A cut of the tree (count of letter ``dim`` at most ``at``, or more), or a leaf with its number or its points."""

    dim: int = -1
    at: int = 0
    below: Node | None = None
    above: Node | None = None
    number: int = 0
    points: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts of words; letters beyond a-z share six places, which can only bring words closer."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = _DIM_OF[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)]
    flat = np.bincount(np.repeat(np.arange(len(words)) * DIMS, sizes) + letters, minlength=len(words) * DIMS)
    return np.minimum(flat, _MOST).astype(np.int16).reshape(-1, DIMS)


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that halve the points best, or None if all points are alike."""
    tried = [np.zeros(DIMS), np.ones(DIMS), np.full(DIMS, 2), np.floor(points.mean(axis=0))]
    below = np.array([(points <= at).sum(axis=0) for at in tried])
    worth = np.minimum(below, len(points) - below)
    row, dim = divmod(int(worth.argmax()), DIMS)
    return (dim, int(tried[row][dim])) if worth[row, dim] else None


def cell_tree(sample: np.ndarray, leaf: float) -> Node:
    """The upper levels: cuts of the sample until a leaf has at most ``leaf`` of its points. Leaves are numbered from the left."""
    numbers = iter(range(len(sample) + 1))

    def grow(points: np.ndarray) -> Node:
        cut = _cut(points) if len(points) > leaf else None
        if cut is None:
            return Node(number=next(numbers))
        under = points[:, cut[0]] <= cut[1]
        return Node(cut[0], cut[1], grow(points[under]), grow(points[~under]))

    return grow(sample)


def point_tree(points: np.ndarray, at: np.ndarray) -> Node:
    """The lower levels over ``points[at]``, with the bounding box of each node."""
    here = points[at]
    box = {"low": here.min(axis=0), "high": here.max(axis=0)}
    cut = _cut(here) if len(at) > LEAF else None
    if cut is None:
        return Node(points=at, **box)
    under = here[:, cut[0]] <= cut[1]
    return Node(cut[0], cut[1], point_tree(points, at[under]), point_tree(points, at[~under]), **box)


def _reach(asked: np.ndarray, low: np.ndarray, high: np.ndarray, taken: int) -> np.ndarray:
    """Whether one added letter, and ``taken`` letters less, can bring each vector into the box."""
    more = np.maximum(low - asked, 0).sum(axis=1, dtype=np.int32)
    less = np.maximum(asked - high, 0).sum(axis=1, dtype=np.int32)
    return (more <= 1) & (less <= taken)


def visited(tree: Node, asked: np.ndarray, taken: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell number with the places of the vectors whose search reaches the cell."""

    def walk(node: Node, low: np.ndarray, high: np.ndarray, active: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        active = active[_reach(asked[active], low, high, taken)]
        if not len(active):
            return
        if node.below is None:
            yield node.number, active
            return
        top, bottom = high.copy(), low.copy()
        top[node.dim], bottom[node.dim] = min(high[node.dim], node.at), max(low[node.dim], node.at + 1)
        yield from walk(node.below, low, top, active)
        yield from walk(node.above, bottom, high, active)

    yield from walk(tree, np.zeros(DIMS, np.int16), np.full(DIMS, _MOST, np.int16), np.arange(len(asked)))


def homes(tree: Node, points: np.ndarray) -> np.ndarray:
    """The number of the cell that each vector lies in."""
    out = np.zeros(len(points), dtype=np.int64)

    def walk(node: Node, at: np.ndarray) -> None:
        if node.below is None:
            out[at] = node.number
            return
        under = points[at, node.dim] <= node.at
        walk(node.below, at[under])
        walk(node.above, at[~under])

    walk(tree, np.arange(len(points)))
    return out


def _candidates(tree: Node, points: np.ndarray, asked: np.ndarray, taken: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (point, asked) of all pairs within the range: one letter more and ``taken`` letters less."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def walk(node: Node, active: np.ndarray) -> None:
        active = active[_reach(asked[active], node.low, node.high, taken)]
        if not len(active):
            return
        if node.below is not None:
            walk(node.below, active)
            walk(node.above, active)
            return
        for part in np.array_split(active, -(-len(active) * len(node.points) // 200_000)):
            step = points[node.points][None, :, :] - asked[part][:, None, :]
            near = (np.maximum(step, 0).sum(axis=2, dtype=np.int32) <= 1) & (np.maximum(-step, 0).sum(axis=2, dtype=np.int32) <= taken)
            q, p = np.nonzero(near)
            found.append((node.points[p], part[q]))

    walk(tree, np.arange(len(asked)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


# ---- one cell


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def _replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the beginning and the end that both share cover the shorter word."""
    size = short.shape[1]
    head, tail = short != long[:, :-1], (short != long[:, 1:])[:, ::-1]
    first = np.where(head.any(axis=1), head.argmax(axis=1), size)
    last = np.where(tail.any(axis=1), tail.argmax(axis=1), size)
    return first + last >= size


def near_in_cell(at_home: list[str], guests: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs as places in ``at_home + guests``: each pair with at least one word at home, once."""
    words = at_home + guests
    points, codes = vectors(at_home), _codes(at_home)
    tree = point_tree(points, np.arange(len(at_home)))
    size = codes.shape[1]
    block = max(1, (32 << 20) // size)
    for same in (True, False):
        asked_at = np.array([i for i, w in enumerate(words) if (len(w) == size) == same], dtype=np.int64)
        if not len(asked_at):
            continue
        asked = [words[i] for i in asked_at]
        asked_codes = _codes(asked)
        p, q = _candidates(tree, points, vectors(asked), int(same))
        if same:
            once = (asked_at[q] >= len(at_home)) | (p < asked_at[q])
            p, q = p[once], q[once]
        for i in range(0, len(p), block):
            a, b = p[i : i + block], q[i : i + block]
            right = _replaced(codes[a], asked_codes[b]) if same else _inserted(asked_codes[b], codes[a])
            yield a[right], asked_at[b[right]]


_CELL = "cell long, guest boolean, word string, n long"
_NEAR = "word string, near string, near_n long"


def _pairs(table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by("guest")
    guest = table.column("guest").to_numpy()
    n_home = int((~guest).sum())
    word, n = table.column("word"), table.column("n")
    names = word.to_pylist()
    found = list(near_in_cell(names[:n_home], names[n_home:])) if n_home else []
    a = np.concatenate([x for x, _ in found] + [np.zeros(0, np.int64)])
    b = np.concatenate([y for _, y in found] + [np.zeros(0, np.int64)])
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    return arrow_table(_NEAR, {"word": word.take(pa.array(one)), "near": word.take(pa.array(other)), "near_n": n.take(pa.array(other))})


# ---- all words


def cell_trees(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, Node]:
    """Cuts for each length with more words than a cell takes; what reaches the driver is at most ``sample`` words a length."""
    crowded = {r["size"]: r["many"] for r in words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > cell).collect()}
    if not crowded:
        return {}
    steps = F.create_map(*[F.lit(x) for size, many in crowded.items() for x in (size, -(-2 * many // sample))])
    step = F.element_at(steps, F.length("word"))
    picked = words.filter(F.length("word").isin(list(crowded)) & (F.pmod(F.xxhash64("word"), step) == 0)).select("word").collect()
    by_size: dict[int, list[str]] = {}
    for row in picked:
        by_size.setdefault(len(row["word"]), []).append(row["word"])
    return {size: cell_tree(vectors(sorted(some)), max(8.0, cell * len(some) / crowded[size])) for size, some in by_size.items()}


def placed(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """Words in their own cells and, as guests, in those that their search reaches."""
    whole = Node()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
            rows, cells, guest = [], [], []
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                points = vectors([names[i] for i in at])
                home = homes(trees.get(size, whole), points)
                rows.append(at)
                cells.append((size << 16) + home)
                guest.append(np.zeros(len(at), bool))
                for target, taken in ((size, 1), (size + 1, 0)):
                    for number, reached in visited(trees.get(target, whole), points, taken):
                        if target == size:
                            reached = reached[home[reached] < number]
                        rows.append(at[reached])
                        cells.append(np.full(len(reached), (target << 16) + number))
                        guest.append(np.ones(len(reached), bool))
            if rows:
                order = pa.array(np.concatenate(rows))
                columns = {"cell": np.concatenate(cells), "guest": np.concatenate(guest), "word": batch.column("word").take(order), "n": batch.column("n").take(order)}
                yield from arrow_table(_CELL, columns).to_batches()

    return words.select("word", "n").mapInArrow(run, _CELL)


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, near, near_n): every pair of near words in both directions."""
    return placed(words, cell_trees(words, cell, sample)).groupBy("cell").applyInArrow(_pairs, _NEAR)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form; each turn doubles the steps followed."""
    roots = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots-0")
    turn = 0
    while True:
        turn += 1
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"spelling-roots-{turn}")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def variants(docs: DataFrame, typos: int | None = None, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stage(word_counts(docs, typos), "spelling-words")
    best = near_words(words, cell, sample).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    takes = -F.col("best.less") >= RATIO * F.col("n")
    ranked = stage(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(ranked.filter("form is not null"))
    return ranked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
