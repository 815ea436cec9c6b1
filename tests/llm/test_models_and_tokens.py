"""Operators 2, 3, 4, 5, 7 and 8 and the pipeline against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from llm_helpers import by_id
from tradewind.llm import compress_quality, lz_fingerprint, ngram_lm, ordered, piece_bpe, tally, token_files, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS_49K = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "   ", "a", "  two  blanks   ", "Line\nfeed\tand tab", "▁ mark ▁▁", "日本語 テキスト 🎉", "\x00\x01\x1c x", "<s> </s> <0x41> <|endoftext|>", "É é é ﬁ Ω", " " * 40 + "x" + " " * 17,
    "it's we'll 123 4.5%", "x" * 3000, "great-grand " * 400,
]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(8)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    return base + base[:5] + ODD + [prose(rng, 3000)]


# ---- operator 2


def sign_by_hand(text: str) -> np.ndarray:
    seen, phrase = set(), b""
    for byte in text.encode():
        phrase += bytes([byte])
        if phrase not in seen:
            seen.add(phrase)
            phrase = b""
    return lz_fingerprint.signature(lz_fingerprint.hashes(sorted(seen)))


@pytest.mark.parametrize("part_bytes", [1 << 24, 4000])
def test_phrases_like_brute_force(docs, texts, part_bytes):
    got = by_id(lz_fingerprint.fingerprints(docs(texts, extra="part"), part_bytes))
    all_texts = [t or "" for t in texts]
    signs = [sign_by_hand(t) for t in all_texts]
    for i, t in enumerate(all_texts):
        following = (i + 1) % len(all_texts)
        cut = len(t) // 4
        edited = t[: len(t) - cut] + all_texts[following][:cut]
        other = sign_by_hand(edited)
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.shown(signs[i]), lz_fingerprint.shown(other), lz_fingerprint.likeness(signs[i], other), lz_fingerprint.likeness(signs[i], signs[following]))
        assert tuple(got[i])[1:] == want, i


def test_likeness_estimates_shared_phrases():
    rng = random.Random(1)
    a, b = prose(rng, 600), prose(rng, 600)
    sets = []
    for t in (a, a[:2000] + b[2000:]):
        seen = set()
        lz_fingerprint.parse(t.encode(), seen)
        sets.append(seen)
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(lz_fingerprint.likeness(sign_by_hand(a), sign_by_hand(a[:2000] + b[2000:])) - true) < 0.15
    assert lz_fingerprint.likeness(sign_by_hand(a), sign_by_hand(a)) == 1.0


def test_one_document_follows_itself_and_rows_without_id_come_first(spark, docs):
    assert by_id(lz_fingerprint.fingerprints(docs(["only one here"])))[0]["near_next"] == 1.0
    assert lz_fingerprint.fingerprints(docs([])).count() == 0
    rows = spark.createDataFrame([(None, "abcdabcd"), (3, "wxyzwxyz"), (3, "wxyzwxyz")], "doc_id long, text string")
    got = lz_fingerprint.fingerprints(rows).collect()
    assert len(got) == 3 and Counter(r["doc_id"] for r in got) == {3: 2, None: 1}


def test_parts_follow_the_ids(spark):
    ids = spark.range(1000).withColumnRenamed("id", "at")
    cuts = ordered.bounds(ids, 10_000, 1000)
    rows = ordered.with_part(ids, cuts).collect()
    assert sorted((r["part"], r["at"]) for r in rows) == [(p, a) for a, p in sorted((r["at"], r["part"]) for r in rows)]
    assert 5 <= len({r["part"] for r in rows}) <= 10


# ---- operator 3


def test_scores_like_brute_force(docs, texts, monkeypatch):
    monkeypatch.setattr(tally, "BLOCK_BYTES", 4000)
    got = by_id(ngram_lm.scores(docs(texts, extra="score")))
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    uni, pair = Counter(), Counter()
    for ws, own in zip(tokens, train):
        if own:
            uni.update(ws)
            pair.update(zip([None, *ws], ws))
    n, v = sum(uni.values()), len(uni)
    p = {w: (uni[w] + 0.5) / (n + 0.5 * (v + 1)) for ws in tokens for w in ws}
    for i, ws in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], len(ws), sum(uni[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(p[w]) for w in ws))
        k = ngram_lm.PRIOR
        assert r["score"] == pytest.approx(sum(math.log10((pair[h, w] + k * p[w]) / (uni[h] + k)) for h, w in zip([None, *ws], ws)))


def test_weights_of_a_state_sum_to_one():
    uni, pair = Counter("aababc"), Counter({("a", "a"): 1, ("a", "b"): 2})
    n, v, k = 6, 3, ngram_lm.PRIOR
    p = {w: (uni[w] + 0.5) / (n + 0.5 * (v + 1)) for w in "abc?"}
    assert sum(p.values()) == pytest.approx(1)
    assert sum((pair["a", w] + k * p[w]) / (3 + k) for w in "abc?") == pytest.approx(1)


def test_scores_of_no_documents(docs):
    assert ngram_lm.scores(docs([])).count() == 0


# ---- operator 4


def test_pieces_like_the_library(docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(piece_bpe.encode_documents(docs(texts, extra="ids"), PIECES))
    hashed = by_id(piece_bpe.digests(docs(texts), PIECES))
    for i, t in enumerate(texts):
        ids = library.encode(t or "") + [library.eos_id()]
        assert (got[i]["ids"], got[i]["decoded"]) == (ids, library.decode(ids)), i
        assert tuple(hashed[i])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_of_random_joins():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder, rng = piece_bpe.Encoder(PIECES), random.Random(9)
    for _ in range(1500):
        t = "".join(rng.choice(encoder.model.pieces[3:]) for _ in range(rng.randint(1, 8))) + rng.choice(["", "  ", "\n", " ñ"])
        assert encoder.ids(t) == library.encode(t) + [2], t


@pytest.mark.parametrize("part", ["今天天气很好我们一起去公园散步吧", "🎉", "👩‍🚀🎉", "\n", "\t", "これはとても長い文章です", "สวัสดีครับ", "word\n🎉。"])
def test_long_units_of_characters_that_never_join(part):
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_bpe.Encoder(PIECES)
    long = (part * 5000)[:5000]
    for t in (long, "word" + long, f"so {long} it is", long + "word"):
        assert encoder.ids(t) == library.encode(t) + [2]


def test_remembered_units_are_bounded(monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(piece_bpe, "REMEMBERED_PAIRS", 50)
    encoder, library, rng = piece_bpe.Encoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    for _ in range(60):
        t = prose(rng, 40)
        assert encoder.ids(t) == library.encode(t) + [2]
    assert len(encoder.memory) <= 50 and len(encoder.older) <= 50


def test_a_task_forgets_its_units_and_keeps_the_model(docs, monkeypatch):
    """Workers stay for the next steps of a pipeline: what a task remembers goes with it."""
    encoder, ends = piece_bpe.Encoder.of(PIECES), []
    for build in (piece_bpe.encode_documents, piece_bpe.digests):
        monkeypatch.setattr(piece_bpe, "map_batches", lambda df, fn, ddl, end=None: ends.append(end))
        build(docs(["a"]), PIECES)
    for end in ends:
        assert encoder.ids("some words of a text unforgettable qzxv") and encoder.memory and encoder.model.n_known
        end()
        assert not (encoder.memory or encoder.older or encoder.model.n_known)
        assert all(set(known) == {-1} for known in encoder.model.known)
    assert piece_bpe.Encoder.of(PIECES) is encoder


def test_ids_of_a_batch_take_few_bytes():
    """A batch of 300,000 ids stays far below what they take as numbers of Python."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": ["of the house 日本 " * 1000] * 60})
    encoder = piece_bpe.Encoder.of(PIECES)
    ids = encoder.ids(batch.column("text")[0].as_py())
    tracemalloc.start()
    out = piece_bpe.encoded(batch, PIECES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["ids"].to_pylist() == [ids] * 60 and len(ids) * 60 > 300_000
    assert peak < 20 * len(ids) * 60


# ---- operators 5 and 7


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(700):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        text = prose(rng, rng.randint(60, 160)) if good else " ".join([prose(rng, 1).upper() + "!!"] * 5 + [prose(rng, 1)] * 40)
        if toxic:
            text += " " + " ".join(rng.choice(["Vileness", "vilest,", "rotter"]) for _ in range(rng.randint(2, 8)))
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_quality_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    got = by_id(compress_quality.score(docs, compress_quality.fit(docs, labels)))
    held = [(i, q) for i, q, _ in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(got[i]["predicted"] == q for i, q in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_quality_learns_nothing_from_held_out_labels(spark, labelled):
    docs, _, truth = labelled
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in truth]
    a = compress_quality.fit(docs, spark.createDataFrame(truth, "doc_id long, quality int, toxic int"))
    b = compress_quality.fit(docs, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert a == b


def test_quality_without_labels_and_of_empty_texts(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = compress_quality.score(docs(["a", None], extra="score"), compress_quality.fit(docs(["a", None]), none)).collect()
    assert [r["score"] for r in rows] == [0.5, 0.5]
    assert compress_quality.score(docs([]), compress_quality.QualityModel()).count() == 0


def test_rejected_rows_go_and_the_rest_is_unchanged(labelled):
    docs, labels, _ = labelled
    model = compress_quality.fit(docs, labels)
    want = {r["doc_id"] for r in compress_quality.score(docs, model).collect() if r["predicted"]}
    kept = compress_quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    got = by_id(toxicity.score(docs, toxicity.fit(docs, labels)))
    held = [(i, t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["toxic"] == bool(t) for i, t in held) >= 0.97 * len(held)
    assert all(0 <= r["severity"] <= toxicity.GRADES for r in got.values())


def test_thresholds_are_ordered_and_weights_shared(labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    assert model.cuts == sorted(model.cuts) and len(model.weights) == len(model.markers) + 1
    p = model.at_least([b"plain words", b"vilest vileness rotter rotter", b""])
    assert (p[:, 0] >= p[:, 1]).all() and (p[:, 1] >= p[:, 2]).all() and p[1, 0] > 0.5 > p[0, 0]


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs(["a", None]), toxicity.fit(docs(["a", None]), none)).collect()
    assert [(r["severity"], r["toxic"]) for r in rows] == [(0.0, False)] * 2


def test_odds_of_a_bounded_sample_are_those_of_all_labels(spark):
    rng = random.Random(21)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(1600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), int(i % 10 == 0)) for i in range(1600)], "doc_id long, quality int, toxic int")
    few = compress_quality.Sample(rows=100)
    good = [r["score"] for r in compress_quality.score(docs, compress_quality.fit(docs, labels, few), few).collect()]
    toxic = [r["p_toxic"] for r in toxicity.score(docs, toxicity.fit(docs, labels, few), few).collect()]
    assert abs(np.mean(good) - 0.9) < 0.05 and abs(np.mean(toxic) - 0.1) < 0.05


def test_all_rows_stay_without_a_model(spark, docs):
    few = spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    table = docs(["a", None, "c"])
    assert compress_quality.keep_good(table, compress_quality.fit(table, few)).count() == 3


# ---- operator 8


@pytest.mark.parametrize("part_bytes", [1 << 24, 3000])
def test_token_files_round_trip(spark, docs, texts, tmp_path, part_bytes):
    folder = f"file://{tmp_path}/tokens"
    shuffled = docs(texts, extra="at").orderBy(F.xxhash64("doc_id"))
    index = token_files.write(shuffled, folder, WORDS_49K, part_bytes)
    got = by_id(token_files.read(spark, folder))
    start, library = 0, Tokenizer.from_file(WORDS_49K)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), i
        start += len(ids)
    assert index["integer"] == "<u2" and (len(index["parts"]) > 3) == (part_bytes == 3000)
    name = index["parts"][0]["name"]
    raw = np.fromfile(f"{tmp_path}/tokens/{name}.ids", dtype="<u2")
    assert raw.tolist()[: len(library.encode(texts[0], add_special_tokens=False).ids)] == library.encode(texts[0], add_special_tokens=False).ids
    assert not [p for p in (tmp_path / "tokens").iterdir() if p.name.startswith("tmp-")]


def test_token_files_of_no_documents_and_repeated_ids(spark, docs, tmp_path):
    token_files.write(docs([]), f"{tmp_path}/none", WORDS_49K)
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0
    rows = spark.createDataFrame([(None, "b"), (5, "same"), (5, "same"), (5, None)], "doc_id long, text string")
    token_files.write(rows, f"{tmp_path}/some", WORDS_49K)
    got = token_files.read(spark, f"{tmp_path}/some").collect()
    assert sorted((r["doc_id"] is not None, r["start"]) for r in got)[0] == (False, 0) and sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)


# ---- pipeline


def test_pipeline_stages_like_their_operators(spark, tmp_path):
    tables = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, tables).write.parquet(str(tmp_path / f"out{i}"))
        after = spark.read.parquet(str(tmp_path / f"out{i}"))
        assert sorted(after.columns) == sorted(docs.columns) and 0 < after.count() <= docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in last} == left and all(r["ids"] == library.encode(left[r["doc_id"]]) + [2] for r in last)
    again = corpus_pipeline.run(spark, tables).collect()
    assert {(r["doc_id"], tuple(r["ids"])) for r in again} == {(r["doc_id"], tuple(r["ids"])) for r in last}


def test_a_repeated_id_is_sampled_once(spark, labelled):
    docs, labels, truth = labelled
    taken = [t[0] for t in truth if zlib.crc32(b"%d" % t[0]) % 4 != 2][0]
    copies = docs.filter(F.col("doc_id") == taken).crossJoin(spark.range(3000)).select(docs.columns)
    sample = compress_quality.Sample(rows=60)
    once, stands = compress_quality.labelled_sample(docs, labels, "quality", sample)
    many, again = compress_quality.labelled_sample(docs.unionByName(copies), labels.unionByName(labels), "quality", sample)
    assert (many, again) == (once, stands) and all(0 < len(v) <= 60 for v in many.values())


def test_other_texts_of_an_id_change_no_bound(spark, labelled):
    docs, labels, truth = labelled
    others = docs.withColumn("text", F.concat(F.lit("another "), "text"))
    by, _ = compress_quality.labelled_sample(docs.unionByName(others), labels, "quality", compress_quality.Sample(rows=60))
    assert all(len(v) <= 60 for v in by.values())


def test_the_sample_keeps_within_its_bytes_and_counts_what_it_leaves_out(spark, labelled):
    docs, labels, _ = labelled
    whole, stands = compress_quality.labelled_sample(docs, labels, "quality", compress_quality.Sample())
    bound = sum(map(len, whole[1])) // 2
    part, more = compress_quality.labelled_sample(docs, labels, "quality", compress_quality.Sample(text_bytes=bound))
    assert all(sum(map(len, v)) <= bound for v in part.values()) and 0 < len(part[1]) < len(whole[1])
    assert set(part[1]) <= set(whole[1]) and more[1] * len(part[1]) == pytest.approx(stands[1] * len(whole[1]))
    none, _ = compress_quality.labelled_sample(docs, labels, "quality", compress_quality.Sample(text_bytes=0))
    assert not any(map(any, none.values()))


def test_no_labels_give_no_sample(spark, labelled):
    docs, labels, _ = labelled
    by, stands = compress_quality.labelled_sample(docs, labels.filter("false"), "quality", compress_quality.Sample())
    assert by == {0: [], 1: []} and stands == {0: 1.0, 1: 1.0}
