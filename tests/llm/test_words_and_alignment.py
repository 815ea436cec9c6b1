"""Operators 11, 12 and 13 against brute force, with the defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_helpers import by_id
from tradewind.llm import set_sketch, spelling, token_alignment

BYTES_50K = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def words_of(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "ñé", "in", "ed", "nd"]) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def edited(rng: random.Random, word: str) -> str:
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word[:at] + "q" + word[at + 1 :]])


# ---- operator 11


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(rows: list[tuple[int | None, str | None]], typos: int | None) -> dict:
    seen: Counter = Counter()
    letters = {*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))}
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if c in letters else " " for c in lowered).split(" "):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if run and typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda v: (-n[v], v))] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


@pytest.fixture(scope="module")
def misspelled() -> list[str | None]:
    rng = random.Random(3)
    base = words_of(rng, 60)
    out: list[str | None] = []
    for _ in range(120):
        chosen = [base[min(59, int(rng.expovariate(0.08)))] for _ in range(60)]
        out.append(" ".join(edited(rng, w) if rng.random() < 0.15 else w for w in chosen))
    chain = ["abcdefgh"] * 2 + ["abcdefghi"] * 20 + ["abcdefghij"] * 200
    return [*out, *out[:3], " ".join(chain), None, "", "Émigrés-ÉMIGRÉS émigrésx×÷ÿ 12ab", "z" * 9000 + " " + "z" * 9001 + " " + "z" * 9000 + " " + "z" * 9001]


@pytest.mark.parametrize("cell, sample", [(spelling.CELL, spelling.SAMPLE), (8, 200)])
@pytest.mark.parametrize("typos", [None, 5])
def test_variants_like_brute_force(docs, misspelled, cell, sample, typos):
    rows = spelling.variants(docs(misspelled, extra="word"), typos, cell, sample).collect()
    got = {r["word"]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(got) and got == variants_by_hand(list(enumerate(misspelled)), typos)


def test_variants_follow_the_chain_of_forms(docs):
    text = " ".join(["abcdefgh"] * 2 + ["abcdefghi"] * 20 + ["abcdefghij"] * 200 + ["abcdefghijk"] * 2000)
    got = {r["word"]: r for r in spelling.variants(docs([text])).collect()}
    assert {r["root"] for r in got.values()} == {"abcdefghijk"} and got["abcdefgh"]["form"] == "abcdefghi"


def test_variants_of_ties_nulls_and_repeated_rows(spark, docs):
    ties = " ".join(["abcdefg"] * 2 + ["abcdefgz"] * 20 + ["abcdefgb"] * 20)
    got = {r["word"]: r["form"] for r in spelling.variants(docs([ties])).collect()}
    assert got["abcdefg"] == "abcdefgb" and got["abcdefgb"] is None
    rows = [(None, "letters apart", "x")] * 2 + [(4, None, "y")]
    same = spark.createDataFrame(rows, "doc_id long, text string, n string")
    assert {r["word"]: tuple(r)[1:] for r in spelling.variants(same, 3).collect()} == variants_by_hand([r[:2] for r in rows], 3)
    assert spelling.variants(docs([])).collect() == [] and spelling.variants(docs([None, ""])).collect() == []


# ---- operator 12


def aligned_by_hand(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    model = token_alignment.Tokenizers(BYTES_50K, PIECES)
    library = Tokenizer.from_file(BYTES_50K)
    library.encode_special_tokens = True
    counts: Counter = Counter()
    made = []
    for doc_id, text in rows:
        raw = b" " + (text or "").encode()
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.b.encode(text or "")
        pieces_a, pieces_b = [model.bytes_a[i] for i in a], [model.bytes_b[i] for i in b]
        if not text or b"".join(pieces_a) != raw or b"".join(pieces_b) != raw:
            a, b, pieces_a, pieces_b = [], [], [], []
        owner_a = [i for i, p in enumerate(pieces_a) for _ in p]
        owner_b = [i for i, p in enumerate(pieces_b) for _ in p]
        links = sorted(set(zip(owner_a, owner_b)))
        groups, group = [], ([], [])
        for k, (i, j) in enumerate(zip(owner_a, owner_b)):
            end_a, end_b = k + 1 == len(owner_a) or owner_a[k + 1] != i, k + 1 == len(owner_b) or owner_b[k + 1] != j
            group[0].extend([a[i]] if end_a else [])
            group[1].extend([b[j]] if end_b else [])
            if end_a and end_b:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                group = ([], [])
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(set(pairs))
        made.append((doc_id, len(a), len(b), groups, pairs))
    best: dict = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (d, a, b, len(g), len(p), sum(counts[x] == best[x[0]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, a, b, g, p in made
    ]


@pytest.fixture(scope="module")
def mixed() -> list[str | None]:
    rng = random.Random(9)
    base = [" ".join(words_of(rng, rng.randint(1, 80))) for _ in range(30)]
    odd = [None, "", " ", "a▁b", "<|endoftext|> <s> <0x41>", "日本語 テキスト 🎉 ﬁ é", "x" * 3000, "  two  blanks \n\n\t\r", "\x00\x1c", "it's we'll 123 4.5%", "a \x1cb \x85 c\u3000d \u00a0e ", " x  y z", "a \n b", " ".join(words_of(rng, 4000)), "word " * 2000]
    return base + base[:4] + odd


@pytest.mark.parametrize("piece", [token_alignment.PIECE, 8])
def test_alignment_like_brute_force(docs, mixed, piece, monkeypatch):
    monkeypatch.setattr(token_alignment, "PIECE", piece)
    got = token_alignment.alignments(docs(mixed, extra="block").repartition(3), BYTES_50K, PIECES)
    assert sorted(tuple(r) for r in got.collect()) == aligned_by_hand(list(enumerate(mixed)))


def test_alignment_of_null_ids_and_repeated_rows(spark, docs):
    rows = [(None, "one two", 1), (None, "one two", 1), (3, "one three", 2), (3, None, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, pair int")
    order = [(x[0] is None, *x[1:]) for x in aligned_by_hand([r[:2] for r in rows])]
    got = [(r[0] is None, *tuple(r)[1:]) for r in token_alignment.alignments(table, BYTES_50K, PIECES).collect()]
    assert sorted(got) == sorted(order)
    assert token_alignment.alignments(docs([]), BYTES_50K, PIECES).collect() == []


def test_lockstep_merges_ends_once():
    found = token_alignment.lockstep([np.array([2, 1, 3]), np.array([], np.int64), np.array([4])], [np.array([1, 2, 3]), np.array([], np.int64), np.array([1, 3])])
    assert list(zip(found.link_a.tolist(), found.link_b.tolist(), found.doc.tolist())) and found.cut_a.tolist() == [False, True, True, True]
    assert sorted(zip(found.link_a.tolist(), found.link_b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 3), (3, 4)]


# ---- operator 13


def shingles_by_hand(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w,) for w in words)


def near_by_hand(texts: list[str | None]) -> dict:
    sets = [shingles_by_hand(t) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for k in range(i):
            if a and sets[k] and root[i] != root[k] and 100 * len(a & sets[k]) >= 80 * len(a | sets[k]):
                low, high = sorted((root[i], root[k]))
                root = [low if r == high else r for r in root]
    return {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


@pytest.fixture(scope="module")
def copies() -> list[str | None]:
    rng = random.Random(21)
    base = [words_of(rng, rng.randint(2, 150)) for _ in range(40)]
    out = [" ".join(w) for w in base]
    for words in base[:25]:
        for _ in range(rng.randint(1, 5)):
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                changed[rng.randrange(len(changed))] = "changed" + str(rng.randrange(10))
            out.append(" ".join(changed))
    drift = words_of(rng, 100)
    for step in range(12):
        drift = [*drift[3:], *words_of(rng, 3)]
        out.append(" ".join(drift))
    rng.shuffle(out)
    return [*out, *out[:6], None, "", "  ", "word", "WORD", "a b", "a b c d e", "a b c d e f", "a b c d", " ".join(words_of(rng, 5000))]


@pytest.mark.parametrize("bucket", [set_sketch.BUCKET, 2])
def test_set_sketch_like_brute_force(docs, copies, bucket):
    got = by_id(set_sketch.near_duplicates(docs(copies, extra="node"), bucket))
    assert {i: tuple(r)[1:] for i, r in got.items()} == near_by_hand(copies)


def test_set_sketch_parts_bring_asked_nodes_to_all_others(spark):
    named = spark.createDataFrame([(7, i, 0 if i < 5 else i) for i in range(12)] + [(8, 20, 20), (8, 21, 20)], "key long, node long, label long")
    parts: dict = defaultdict(list)
    for r in set_sketch._dealt(named, 3).collect():
        parts[r["part"]].append((r["node"], r["asked"]))
    met = {tuple(sorted((a, b))) for some in parts.values() for a, asked in some if asked for b, _ in some if a != b}
    assert met == {(i, k) for i in range(12) for k in range(i + 1, 12) if k >= 5}


def test_set_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 1 << 48, 6000).astype(np.uint64)
    for size_a, size_b, common in ((1000, 1000, 800), (900, 1000, 850), (300, 330, 295), (2000, 2000, 400)):
        a, b = np.unique(pool[:size_a]), np.unique(pool[size_a - common : size_a - common + size_b])
        ra, rb, union = set_sketch.levels([a, b, np.union1d(a, b)])
        assert (set_sketch.merged(ra, rb) == union).all()
        want = common / (size_a + size_b - common)
        got = set_sketch.likely(np.array([float(size_a)]), np.array([float(size_b)]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))[0]
        assert abs(got - want) < 0.12
    assert (1 - 0.8**set_sketch.ROWS) ** set_sketch.BANDS < 1e-6


def test_set_sketch_of_null_ids_and_repeated_rows(spark, docs):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, near, "x"), (9, near + " more", "x"), (9, near + " more", "x"), (4, None, "y"), (None, "lone text", "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in set_sketch.near_duplicates(table).collect())
    assert got == [("4", 0, 4, True), ("9", 60, 9, True), ("9", 60, 9, True), ("None", 1, None, True), ("None", 59, 9, False)]
    assert set_sketch.near_duplicates(docs([])).collect() == [] and set_sketch.near_duplicates(docs([None, ""])).count() == 2
