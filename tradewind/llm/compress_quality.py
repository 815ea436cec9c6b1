"""Operator 5: a compression classifier of text quality.

Two zstandard dictionaries are built from labelled texts, one from good and one from bad ones. A text
that is like the good ones is packed smaller with the good dictionary. The difference of the two sizes,
normalised by the text's plain packed size and by its length, is calibrated to a probability by logistic
regression on labelled texts that went into neither dictionary.

The model is fitted on a bounded sample of the labelled training rows (``Sample``): the bounds, rows and bytes of
each class, are parameters, everything else runs over all rows. An id is sampled once, however many rows have it. The bound takes more from the larger class, so the odds of
all training labels, which are counted, replace those of the sample in the bias. Scoring is one narrow pass
over whole texts.

Defined cases: a null text counts as empty; an empty or blank text gets the model's score for a text of
no bytes; repeated rows each get a row; a labels table without both classes gives every text the share
of good labels (0.5 without labels), and no row is dropped for it; other columns of the input are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tradewind.llm.common import is_held_out, map_batches, raw_texts, small_batches, texts, held_out

THRESHOLD = 0.7


@dataclass(frozen=True)
class Sample:
    """Bounds of what the model is fitted on: labelled rows and text bytes of each class, and bytes of each class for its dictionary."""

    rows: int = 4000
    text_bytes: int = 64 << 20
    dictionary_bytes: int = 112 << 10
    level: int = 3
    fold_mod: int = 4
    fold: int = 2


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    level: int = 3
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    prior: float = 0.5

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The model with its compressors, made once per task."""

    def __init__(self, model: QualityModel) -> None:
        self.model = model
        options = {"level": model.level, "write_checksum": False, "write_content_size": False}
        self.packers = []
        for data in (model.good, model.bad) if model.weights else ():
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=model.level)
            self.packers.append(zstandard.ZstdCompressor(dict_data=dictionary, **options))
        self.packers.append(zstandard.ZstdCompressor(**options))

    def features(self, items: list[bytes]) -> np.ndarray:
        sizes = np.array([[len(p.compress(b)) for p in self.packers] for b in items], dtype=float).reshape(len(items), 3)
        n = np.array([len(b) for b in items], dtype=float) + 1
        gain = sizes[:, 1] - sizes[:, 0]
        base = np.stack([gain / sizes[:, 2], gain / n, sizes[:, 2] / n, np.log(n)], axis=1)
        pairs = [base[:, i] * base[:, j] for i in range(4) for j in range(i, 4)]
        return np.concatenate([base, np.stack(pairs, axis=1)], axis=1)

    def scores(self, items: list[bytes]) -> np.ndarray:
        m = self.model
        if not m.weights or not items:
            return np.full(len(items), m.prior)
        x = (self.features(items) - np.array(m.mean)) / np.array(m.scale)
        z = np.clip(x @ np.array(m.weights[1:]) + m.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias first), mean and scale of a ridge logistic regression, by damped Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-3

    def loss(v: np.ndarray) -> float:
        t = z @ v
        return float(np.logaddexp(0, t).sum() - (y * t).sum() + 0.5 * (penalty * v * v).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-4 and (then := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-9 * (1 + abs(now)):
            break
        w, now = w + size * step, then
    return w, mean, scale


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: Sample) -> tuple[dict[int, list[bytes]], dict[int, float]]:
    """Training texts of each class, at most ``sample.rows`` and ``sample.text_bytes``, and how many training labels each of them stands for.

    Ids are picked by a hash and cut to the bound before they meet the texts, so the broadcast side has at most
    ``2 * sample.rows`` rows whatever the size of the labels table. An id gives one text however many rows repeat it (that of the
    smallest hash). Sizes come to the driver first: a text that would take its class beyond ``sample.text_bytes``, in hash order
    of the ids, is left out whole, and only the others are collected.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), sample.fold_mod, sample.fold))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.filter("label = 0").orderBy(*order).limit(sample.rows).unionByName(known.filter("label = 1").orderBy(*order).limit(sample.rows))
    rows = texts(docs).join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("text"))
    smallest = F.min(F.struct("h", F.octet_length("text").alias("size"))).alias("t")
    found = [(r["doc_id"], r["label"], r["t"]["h"], r["t"]["size"]) for r in rows.groupBy("doc_id", "label").agg(smallest).collect()]
    kept, used, seen, taken = [], {0: 0, 1: 0}, {0: 0, 1: 0}, {0: 0, 1: 0}
    for doc_id, value, h, size in sorted(found, key=lambda r: (hash_order(r[0]), r)):
        seen[value] += 1
        if used[value] + size <= sample.text_bytes:
            used[value] += size
            taken[value] += 1
            kept.append((doc_id, value, h))
    wanted = docs.sparkSession.createDataFrame(kept, "doc_id long, label int, h long")
    chosen = rows.join(F.broadcast(wanted), ["doc_id", "label", "h"]).groupBy("doc_id", "label").agg(F.min("text").alias("text")).toArrow()
    out: dict[int, list[bytes]] = {0: [], 1: []}
    got = sorted(zip(chosen.column("doc_id").to_pylist(), chosen.column("label").to_pylist(), raw_texts(chosen)))
    for _, value, text in sorted(got, key=lambda r: (hash_order(r[0]), r)):
        out[value].append(text)
    return out, {c: max(1.0, counts.get(c, 0) / sample.rows) * (seen[c] / taken[c] if taken[c] else 1.0) for c in out}


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15) & (2**64 - 1)


def dictionary(items: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on the texts; too few texts to train on are joined as they are."""
    try:
        return zstandard.train_dictionary(size, items).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(items)[:size] or b"\n"


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> QualityModel:
    by, stands_for = labelled_sample(docs, labels, "quality", sample)
    good, bad = by[1], by[0]
    n_good, n_bad = len(good) * stands_for[1], len(bad) * stands_for[0]
    if len(good) < 4 or len(bad) < 4:
        return QualityModel(level=sample.level, prior=n_good / (n_good + n_bad) if good or bad else 0.5)
    model = QualityModel(dictionary(good[::2], sample.dictionary_bytes), dictionary(bad[::2], sample.dictionary_bytes), sample.level, weights=[0.0])
    x = model.scorer().features(good[1::2] + bad[1::2])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    w, mean, scale = logistic(x, y)
    w[0] += np.log(n_good / n_bad) - np.log(len(good[1::2]) / len(bad[1::2]))
    model.weights, model.mean, model.scale = w.tolist(), mean.tolist(), scale.tolist()
    return model


def score(docs: DataFrame, model: QualityModel, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    held: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(model.scorer())
        s = held[0].scores(raw_texts(batch))
        ids = batch.column("doc_id").to_pylist()
        return {"doc_id": batch.column("doc_id"), "held_out": [is_held_out(i, sample.fold_mod, sample.fold) for i in ids], "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return map_batches(texts(docs), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows whose text is predicted good, with all their columns and unchanged; all rows if no model could be fitted."""
    if not model.weights:
        return docs
    small_batches(docs.sparkSession)
    held: list[Scorer] = []

    def run(batches):
        for batch in batches:
            if not held:
                held.append(model.scorer())
            yield batch.filter(pa.array(held[0].scores(raw_texts(batch)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
