"""Operator 7: severity of toxic language by cumulative-link ordinal regression.

Grades are ordered: 0 is a text labelled clean; a text labelled toxic has grade 1, 2 or 3. The labels only
say toxic or not, so the grade of a toxic training text is the third in which its share of marker words
falls among toxic training texts. Markers are words and word beginnings that training texts labelled toxic
hold significantly more often; a marker word is one with a marker. The model is logit P(grade >= k) = w.x - c_k with one weight vector shared by
all thresholds c_1 < c_2 < c_3, so the grades' probabilities are ordered by construction; the output is
the expected grade, the sum of P(grade >= k).

The model is fitted on a bounded sample of labelled rows (``Sample.rows`` of each class). A sampled row weighs
as many rows as it stands for among all training labels, so the bound does not move the odds of a class.
Scoring is one narrow pass over whole texts.

Defined cases: a null text counts as empty; an empty text has no features and gets the model's severity
for that; repeated rows each get a row; labels without both classes give severity 0 for every text; other
columns of the input are never read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradewind.llm.common import is_held_out, map_batches, raw_texts, texts
from tradewind.llm.compress_quality import Sample, labelled_sample

GRADES = 3
FLAG = 0.5
#: A marker's smallest document count in toxic texts and smallest z value of its log odds.
MARKER_COUNT, MARKER_Z = 5, 4.0

#: A-Z to a-z, every other ASCII character that is no letter or digit to a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


#: Lengths in bytes of the word beginnings that can be markers; the shortest one is looked up first.
STEMS = range(4, 10)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def forms(word: bytes) -> list[bytes]:
    """The word and its beginnings, which end in a star."""
    return [word, *[word[:k] + b"*" for k in STEMS if k < len(word)]]


@dataclass
class ToxicityModel:
    markers: list[bytes] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.index = {m: i for i, m in enumerate(self.markers)}
        self.starts = {m.rstrip(b"*")[: STEMS[0]] for m in self.markers}

    def found(self, text: bytes) -> tuple[Counter, int, int]:
        """Counts of markers, of marker words and of all words."""
        all_words, markers, hits = words(text), Counter(), 0
        short, starts, index = STEMS[0], self.starts, self.index
        for word in [w for w in all_words if w[:short] in starts]:
            known = [f for f in forms(word) if f in index]
            markers.update(known)
            hits += bool(known)
        return markers, hits, len(all_words)

    def features(self, items: list[bytes]) -> np.ndarray:
        x = np.zeros((len(items), len(self.index) + 1))
        for row, text in enumerate(items):
            markers, hits, n = self.found(text)
            for marker, count in markers.items():
                x[row, self.index[marker]] = np.log1p(count)
            x[row, -1] = np.log1p(1000 * hits / max(n, 20))
        return x

    def at_least(self, items: list[bytes]) -> np.ndarray:
        """P(grade >= k) for k = 1 to 3, a column each."""
        if not self.cuts or not items:
            return np.zeros((len(items), GRADES))
        return sigmoid(self.features(items) @ np.array(self.weights)[:, None] - np.array(self.cuts)[None, :])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def find_markers(toxic: list[bytes], clean: list[bytes]) -> list[bytes]:
    """Words whose document frequency is significantly higher in toxic texts: log odds over its standard error."""
    a, b = Counter(), Counter()
    for counter, items in ((a, toxic), (b, clean)):
        for text in items:
            counter.update({f for w in set(words(text)) for f in forms(w)})
    out = []
    for word, n in a.items():
        if n >= MARKER_COUNT:
            cells = np.array([n, len(toxic) - n, b[word], len(clean) - b[word]]) + 0.5
            odds = np.log(cells[0] * cells[3] / (cells[1] * cells[2]))
            if odds / np.sqrt((1 / cells).sum()) >= MARKER_Z:
                out.append(word)
    return sorted(out)


def grades(model: ToxicityModel, toxic: list[bytes]) -> np.ndarray:
    """1, 2 or 3 by the thirds of the share of marker words."""
    share = np.array([hits / max(n, 1) for _, hits, n in map(model.found, toxic)])
    return 1 + np.searchsorted(np.quantile(share, [1 / 3, 2 / 3]), share, side="right")


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by Adam on the ridge likelihood; cuts are a first one and positive gaps. Row weights have the mean 1."""
    d, k = x.shape[1], GRADES
    theta = np.concatenate([np.zeros(d), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(len(x))
    for t in range(1, rounds + 1):
        w, gaps = theta[:d], np.exp(theta[d + 1 :])
        cuts = theta[d] + np.concatenate([[0], np.cumsum(gaps)])
        p = sigmoid((x @ w)[:, None] - cuts[None, :])
        padded = np.concatenate([np.ones((len(x), 1)), p, np.zeros((len(x), 1))], axis=1)
        slope = np.concatenate([np.zeros((len(x), 1)), p * (1 - p), np.zeros((len(x), 1))], axis=1)
        likelihood = np.maximum(padded[rows, grade] - padded[rows, grade + 1], 1e-9)
        up, down = weight * slope[rows, grade] / likelihood, weight * slope[rows, grade + 1] / likelihood
        by_cut = np.zeros((len(x), k + 2))
        by_cut[rows, grade] -= up
        by_cut[rows, grade + 1] += down
        g_cut = by_cut[:, 1:-1].sum(0)
        g = np.concatenate([x.T @ (up - down) - ridge * w, [g_cut.sum()], [gaps[j] * g_cut[j + 1 :].sum() for j in range(k - 1)]]) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:d], theta[d] + np.concatenate([[0], np.cumsum(np.exp(theta[d + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> ToxicityModel:
    by, stands_for = labelled_sample(docs, labels, "toxic", sample)
    toxic, clean = by[1], by[0]
    if not toxic or not clean:
        return ToxicityModel()
    model = ToxicityModel(find_markers(toxic, clean))
    x = model.features(toxic + clean)
    weight = np.repeat([stands_for[1], stands_for[0]], [len(toxic), len(clean)])
    w, cuts = fit_ordinal(x, np.concatenate([grades(model, toxic), np.zeros(len(clean), dtype=int)]), weight / weight.mean())
    model.weights, model.cuts = w.tolist(), cuts.tolist()
    return model


def score(docs: DataFrame, model: ToxicityModel, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, severity (0 to 3), p_toxic, grade (most likely one) and toxic for every row."""

    def run(batch: pa.RecordBatch) -> dict:
        p = model.at_least(raw_texts(batch))
        steps = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
        ids = batch.column("doc_id").to_pylist()
        return {
            "doc_id": batch.column("doc_id"), "held_out": [is_held_out(i, sample.fold_mod, sample.fold) for i in ids], "severity": p.sum(1), "p_toxic": p[:, 0],
            "grade": (steps[:, :-1] - steps[:, 1:]).argmax(1).astype(np.int32), "toxic": p[:, 0] >= FLAG,
        }

    return map_batches(texts(docs), run, "doc_id long, held_out boolean, severity double, p_toxic double, grade int, toxic boolean")
