"""Operators 1, 6, 9 and 10 against brute force, with the defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_helpers import by_id
from tradewind.llm import components, decontaminate, sharding, simhash, suffix_dedup

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "señor", "größe"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(30)]
    shared = prose(rng, 40)
    out = base + base[:4] + [base[0]] * 5
    out += [f"{prose(rng, 12)} {shared} {prose(rng, 9)}" for _ in range(4)]
    out += [base[7].replace("alpha", "ALPHA", 1), base[8] + " one more", shared * 3, "é" * 300, "ab" * 400, "", None, "   ", "x", prose(rng, 4000)]
    return out


# ---- operator 1


def removed_by_hand(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    for b in data:
        marks = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                marks[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, m in zip(b, marks) if not m)
        yield len(b), sum(marks), (b"\0" + bytes(marks)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()


def test_repeats_like_brute_force(docs, texts):
    got = by_id(suffix_dedup.removed(docs(texts, extra="block")))
    for i, want in enumerate(removed_by_hand(texts)):
        assert tuple(got[i])[1:] == want, i


def test_repeats_across_many_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    got = by_id(suffix_dedup.removed(docs(texts)))
    for i, want in enumerate(removed_by_hand(texts)):
        assert tuple(got[i])[1:] == want, i


def test_cover_holds_every_difference():
    p = suffix_dedup.PERIOD
    assert {(a - b) % p for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(p))
    assert 3 * suffix_dedup.BLOCK + p - 1 == suffix_dedup.LENGTH


def test_fingerprints_do_not_depend_on_place_or_segment():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 256, 200, dtype=np.uint8)
    data = np.concatenate([rng.integers(0, 256, 300_000, dtype=np.uint8), part, rng.integers(0, 256, 777, dtype=np.uint8), part])
    places = np.array([5, 130_000, 300_000, 300_977])
    keys = suffix_dedup.names("whole").at(data, places, 200)
    assert keys[2] == keys[3] and len(set(keys.tolist())) == 3


def test_repeats_of_no_documents(docs):
    assert suffix_dedup.removed(docs([])).count() == 0


def test_cut_texts_keep_rows_and_columns(docs, texts):
    out = by_id(suffix_dedup.without_repeats(docs(texts)))
    assert len(out) == len(texts) and all(r["n_chars"] == len(r["text"]) and r["lang"] == "en" for r in out.values())
    assert out[0]["text"] == "" or len(texts[0]) < 200


# ---- operator 6


def fingerprint_by_hand(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_hand(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_like_brute_force(docs, texts):
    got = by_id(simhash.near_duplicates(docs(texts, extra="fingerprint")))
    prints = [fingerprint_by_hand(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == roots_by_hand(prints)


def test_every_close_pair_meets_in_a_table():
    rng = random.Random(2)
    for _ in range(2000):
        bits = sum(1 << b for b in rng.sample(range(64), simhash.RADIUS))
        assert any(not bits & m for m in simhash.FIRST)
        t = next(i for i, m in enumerate(simhash.FIRST) if not bits & m)
        assert any(not bits & m for m in simhash.SECOND[t])
    assert max(64 - m.bit_count() for row in simhash.SECOND for m in row) <= 17


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_of_crowded_buckets_like_brute_force(spark, bucket):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 120:
        near = rng.choice(sorted(prints)) if rng.random() < 0.8 else rng.getrandbits(64)
        prints.add(near ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    prints = sorted(prints)
    table = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(table, bucket)).collect()}
    got = [roots.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    want = roots_by_hand(prints)
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(want)) == len(set(got))


def test_first_of_each_group_stays(docs, texts):
    kept = {r["doc_id"] for r in simhash.keep_first(docs(texts)).collect()}
    assert kept == set(roots_by_hand([fingerprint_by_hand(t) for t in texts]))


def test_one_row_of_repeated_rows_and_of_rows_without_id(spark):
    rng = random.Random(12)
    a, b, c, d, e, f = (prose(rng, 60) for _ in range(6))
    rows = [(1, a), (1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (3, d), (3, e), (4, e), (None, f), (7, None), (7, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).repartition(5)
    once = simhash.keep_first(docs)
    got = Counter((r["doc_id"], r["text"] or "") for r in once.collect())
    assert got == Counter([(1, a), (2, b), (None, c), (3, d), (3, e), (None, f), (7, "")])
    texts = Counter(r["text"] for r in suffix_dedup.without_repeats(once).collect())
    assert all(texts[t] == 1 for t in (a, b, c, d, e, f))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---- operator 9


def test_shards_are_even_gapless_and_whole(docs, texts, tmp_path):
    many = [f"{t or ''} {i}" for i in range(60) for t in texts[:30]] + [texts[0]] * 700 + [None, ""]
    rows = sharding.shard(docs(many, extra="shard"), str(tmp_path / "maps"), shards=8).collect()
    assert len(rows) == len(many) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    sizes, places = Counter(), {}
    for r in rows:
        text = (many[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
        sizes[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= 1.02 * min(sizes.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_growing_moves_slots_only_into_the_new_shard():
    rng = random.Random(4)
    loads = [(s, rng.randint(1, 1000), 1) for s in range(512)]
    old = sharding.assign(loads, 8, 512)
    new = sharding.grow(old, loads, 8)
    moved = {b for a, b in zip(old, new) if a != b}
    assert moved == {8}
    size = Counter()
    for s, b, _ in loads:
        size[new[s]] += b
    assert max(size.values()) <= 1.05 * min(size.values())


def test_a_map_version_is_never_overwritten(spark, tmp_path):
    table = sharding.map_table(spark, [0, 1, 0], [(0, 5, 2), (2, 7, 3)], 1)
    sharding.store_map(table, str(tmp_path / "m"))
    assert [r["first_slot"] for r in sharding.load_map(spark, str(tmp_path / "m"), 1).orderBy("vslot").collect()] == [0, 0, 2]
    with pytest.raises(Exception, match="already exists"):
        sharding.store_map(table, str(tmp_path / "m"))


@pytest.mark.parametrize("doc_id", [7, None])
def test_equal_rows_spread_over_all_shards(spark, tmp_path, doc_id):
    rows = [(doc_id, "same text " * 20)] * 3000 + [(1000 + i, f"text {i} " * 20) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(table, str(tmp_path / "maps"), shards=8).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 3100 and len(size) == 8 and max(size.values()) < 1.02 * min(size.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_no_documents(docs, tmp_path):
    assert sharding.shard(docs([]), str(tmp_path / "maps")).count() == 0


# ---- operator 10


def contamination_by_hand(texts, items):
    def words(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    windows = []
    for item, t in items:
        ws = words(t)
        m = min(len(ws), 10)
        windows += [(str(item), tuple(ws[i : i + m])) for i in range(len(ws) - m + 1) if m]
    for t in texts:
        ws = words(t)
        hit, found = set(), set()
        for item, w in windows:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
        yield len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_like_brute_force(spark, docs, texts):
    rng = random.Random(6)
    items = [(i, t) for i, t in enumerate(t for t in texts[:12])] + [(100, "xkappa only three"), (101, "Alone"), (102, None), (103, "..."), (104, texts[2])]
    own = texts[:40] + [f"{prose(rng, 5)} {' '.join(texts[3].upper().split()[:11])} {prose(rng, 5)}", "we say xkappa only three times", "alone, ALONE! alone", "Größe " * 30, texts[9]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(docs(own, extra="item_id"), benchmark))
    for i, want in enumerate(contamination_by_hand(own, items)):
        assert tuple(got[i])[1:] == want, i
    clean = {r["doc_id"] for r in decontaminate.keep_clean(docs(own), benchmark).collect()}
    assert clean == {i for i, w in enumerate(contamination_by_hand(own, items)) if not w[-1]}


def test_clean_rows_stay_beside_contaminated_ones_of_the_same_or_no_id(spark):
    rng = random.Random(13)
    item, a, b, c = (prose(rng, 30) for _ in range(4))
    rows = [(None, f"{a} {item}"), (None, b), (None, None), (5, f"{item} {b}"), (5, c), (5, c), (6, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, b), (None, None), (5, c), (5, c)])


def test_contamination_joined_by_a_shuffle(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [(i, t) for i, t in enumerate(texts[:5])]
    got = by_id(decontaminate.contamination(docs(texts[:20]), spark.createDataFrame(items, "item_id long, text string")))
    for i, want in enumerate(contamination_by_hand(texts[:20], items)):
        assert tuple(got[i])[1:] == want, i


def test_contamination_of_repeated_rows_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    twice = docs(["some words here", None]).unionByName(docs(["some words here", None]))
    rows = decontaminate.contamination(twice, none).collect()
    assert sorted((r["doc_id"], r["n_words"], r["contaminated"]) for r in rows) == [(0, 3, False), (0, 3, False), (1, 0, False), (1, 0, False)]
    assert decontaminate.contamination(docs([]), none).count() == 0
