"""Operator 3: language-model scores from a weighted backoff automaton.

The model is a smoothed word bigram over the training documents:

    P(w | h) = (c(h w) + PRIOR * P(w)) / (c(h) + PRIOR),   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

As an automaton it has a root with an arc for each word, and a state for each history h with an arc for
each word seen behind it; the arc's weight is log10 P(w | h). The failure arc of h leads to the root with
weight log10 (PRIOR / (c(h) + PRIOR)), taken when the word was never seen behind h. Reading a word leads to
the word's own state, so one traversal from left to right carries the state and adds up the weights. A text
starts in the state of the end token and closes with that token.

The automaton grows with the corpus and is never held whole: each block of documents asks for the counts
of the arcs its own documents can take (see ``tally``) and builds just that part.

Defined cases: a null or empty text is the end token alone; a null id counts as training; without training
documents every count is 0 and the base is uniform over the one unseen word; repeated rows each get a row and
are each counted; other columns of the input are never read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tradewind.llm import tally
from tradewind.llm.common import arrow_table, corpus_size, is_held_out, raw_texts, seeded, stir, texts

FOLD_MOD, FOLD = 5, 1
#: Weight of the unigram distribution, in observations.
PRIOR = 100.0
UNIGRAM, BIGRAM = 1, 2
#: Different keys that a byte of text asks for, at most about; only sets the number of buckets.
KEYS_PER_BYTE = 0.12

_END = xxhash.xxh64_intdigest(b" end ")
_LEFT, _RIGHT = seeded("bigram", 2)
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Tokens:
    """A block's documents as one run of token keys; document i has tokens starts[i] to starts[i + 1], the last one the end."""

    ids: list[int | None]
    starts: np.ndarray
    words: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Tokens:
        ids = table.column("doc_id").to_pylist()
        split = [t.lower().split() for t in raw_texts(table)]
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in split])])
        flat = pa.array([w for words in split for w in words], type=pa.binary()).dictionary_encode()
        known = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], dtype=np.uint64)
        words = np.full(starts[-1], _END, dtype=np.uint64)
        inside = np.ones(starts[-1], bool)
        inside[starts[1:] - 1] = False
        words[inside] = known[flat.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
        train = np.array([not is_held_out(i, FOLD_MOD, FOLD) for i in ids], dtype=np.int64)
        return cls(ids, starts, words, np.repeat(train, np.diff(starts)))

    def bigrams(self) -> np.ndarray:
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.starts[:-1]] = _END
        return stir(before * _LEFT + self.words * _RIGHT)


class Automaton:
    """The part of the automaton that a block's documents traverse, from the totals of their keys."""

    def __init__(self, tokens: Tokens, unigrams: np.ndarray, bigrams: np.ndarray, n: int, v: int) -> None:
        words, self.word_at, _ = tally.counted(tokens.words, tokens.weight)
        _, self.arc_at, _ = tally.counted(tokens.bigrams(), tokens.weight)
        self.tokens, self.count = tokens, unigrams.astype(float)
        root = (self.count + 0.5) / (n + 0.5 * (v + 1))
        self.root = np.log10(root)
        self.failure = np.log10(PRIOR / (self.count + PRIOR))
        first = np.zeros(len(bigrams), np.int64)
        first[self.arc_at[::-1]] = np.arange(len(tokens.words) - 1, -1, -1)
        end = int(np.searchsorted(words, np.uint64(_END)))
        state_at = np.empty_like(self.word_at)
        state_at[1:] = self.word_at[:-1]
        state_at[tokens.starts[:-1]] = end
        self.state_at = state_at
        history, word = state_at[first], self.word_at[first]
        self.has_arc = bigrams > 0
        self.arc = np.log10((bigrams + PRIOR * root[word]) / (self.count[history] + PRIOR))

    def traverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's sum of weights, sum of root weights, and number of known tokens."""
        at_root = self.root[self.word_at]
        step = np.where(self.has_arc[self.arc_at], self.arc[self.arc_at], self.failure[self.state_at] + at_root)
        cuts = self.tokens.starts[:-1]
        return np.add.reduceat(step, cuts), np.add.reduceat(at_root, cuts), np.add.reduceat((self.count[self.word_at] > 0).astype(np.int64), cuts)


def training_size(rows: DataFrame, bits: int) -> tuple[int, int]:
    """N and V: training tokens, and different ones."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tokens = Tokens.of(pa.Table.from_batches([batch]))
                keys, _, counts = tally.counted(tokens.words, tokens.weight)
                yield from tally.asked_table(list(tally.ask(UNIGRAM, 0, keys[counts > 0], counts[counts > 0], bits))).to_batches()

    row = tally.totals(rows.mapInArrow(run, tally.ASKED), distinct_only=True).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    return int(row["n"]), int(row["v"])


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    rows = texts(docs)
    _, text_bytes = corpus_size(rows)
    bits = tally.bucket_bits(text_bytes * KEYS_PER_BYTE)
    n, v = training_size(rows, max(1, bits - 3))
    blocked = tally.blocks(rows, text_bytes)

    def request(table: pa.Table) -> pa.Table:
        tokens, block = Tokens.of(table), table.column("block")[0].as_py()
        out = []
        for kind, keys in ((UNIGRAM, tokens.words), (BIGRAM, tokens.bigrams())):
            unique, _, counts = tally.counted(keys, tokens.weight)
            out += tally.ask(kind, block, unique, counts, bits)
        return tally.asked_table(out)

    def score(documents: pa.Table, totals: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return arrow_table(_OUT, {c.split()[0]: [] for c in _OUT.split(", ")})
        tokens = Tokens.of(documents)
        total, base, known = Automaton(tokens, tally.answers(totals, UNIGRAM, np.uint32), tally.answers(totals, BIGRAM, np.uint32), n, v).traverse()
        size = np.diff(tokens.starts)
        return arrow_table(_OUT, {
            "doc_id": documents.column("doc_id"), "held_out": [is_held_out(i, FOLD_MOD, FOLD) for i in tokens.ids], "n_tokens": size, "n_known": known,
            "train_tokens": np.full(len(size), n), "base_score": base, "score": total,
        })

    counted = tally.totals(blocked.groupBy("block").applyInArrow(request, tally.ASKED))
    return blocked.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, _OUT)
