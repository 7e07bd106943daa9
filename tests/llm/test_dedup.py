"""Exact, near and substring deduplication against brute force, and what they do with odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import exact_dedup, simhash, substring_dedup, suffix_sort
from gridloom.llm.components import components

#: Nulls in every column, repeated rows and ids, ties, empty and very long texts, and columns whose names clash with ours.
ODD = [
    (1, "Same Text", "a", 1, "x"),
    (5, "same text", "a", 1, "x"),
    (5, "same text", "a", 1, "x"),
    (None, "SAME TEXT", None, None, None),
    (2, None, "b", 1, "x"),
    (3, "", "b", 1, "x"),
    (4, "É ß İ same", "b", 1, "x"),
    (6, "é ß İ same", "b", 1, "x"),
    (None, None, None, None, None),
    (7, "long " * 60_000, "c", 9, "y"),
    (8, "LONG " * 60_000, "c", 9, "y"),
    (9, "one two", "c", 9, "y"),
    (10, " \t\n ", "c", 9, "y"),
]
SCHEMA = "doc_id long, text string, block string, fp int, keep_id string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 4])
def test_exact(odd, documents, salts):
    for df in (odd, documents):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, exact_dedup.exact_dedup(df, salts=salts).collect()), key=repr) == exact_brute(rows)


def test_exact_drop(odd):
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 6, 8, 9, 10]


def test_digest_check_stays_in_plans(spark, odd):
    for df in (exact_dedup.exact_dedup(odd), exact_dedup.drop_copies(odd), exact_dedup.exact_dedup(odd).select("doc_id")):
        assert "raise_error" in df._jdf.queryExecution().optimizedPlan().toString()


def test_copies_go_by_id_and_text(spark):
    rows = [(1, "a"), (5, "A"), (5, "b"), (5, "b"), (None, "b"), (None, "c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_copies(docs).collect()), key=repr) == sorted([(5, "A"), (5, "b"), (None, "c")], key=repr)
    assert sorted(map(tuple, exact_dedup.drop_copies(docs.limit(2)).collect())) == [(5, "A")]


def test_exact_sql(spark, sf_dir, duck, collected):
    from gridloom.llm.queries import ORACLES, QUERIES

    assert collected(QUERIES["op1_exact_dedup"](spark, sf_dir)) == duck(ORACLES["op1_exact_dedup"])


def test_exact_of_no_rows(odd):
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == exact_dedup.drop_copies(odd.limit(0)).count() == 0


def fingerprint_brute(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_brute(rows):
    fps = [fingerprint_brute(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min((i for (i, _), x in zip(rows, root) if x == r and i is not None), default=None) for r in root}
    return sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, root)), key=repr)


def near_texts():
    """Chains of small edits of long texts, so that fingerprints differ by few bits."""
    rng = random.Random(3)
    out = []
    for _ in range(6):
        words = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(500)]
        for _ in range(12):
            words[rng.randrange(500)] = "edit" + str(rng.random())
            out.append(" ".join(words))
    return list(enumerate(out))


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_near(spark, odd, hot):
    for rows in ([(r.doc_id, r.text) for r in odd.collect()], near_texts()):
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot)
        want = near_brute(rows)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len({r[2] for r in want}) < len(want) / 2  # there was something to link


def test_near_ignores_other_columns_and_no_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=repr) == near_brute(rows)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_bit_sliced_comparison():
    rng = np.random.default_rng(1)
    for n, radius in ((1, 2), (63, 2), (64, 1), (65, 0), (300, 2), (700, 2), (300, 5), (500, 7), (300, 28)):
        base = rng.integers(0, 2**63, 9, dtype="u8")
        fps = base[rng.integers(0, 9, n)]
        for _ in range(3):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype("u8")) * (rng.random(n) < 0.5).astype("u8")
        fps = np.unique(fps)
        rng.shuffle(fps)
        cuts = np.sort(rng.choice(np.arange(1, len(fps) + 1), min(3, len(fps)), replace=False))
        sizes = np.array(sorted(np.diff(np.r_[0, cuts, len(fps)]), reverse=True))
        sizes = sizes[sizes > 0]
        got = {(int(a), int(b)) for i, j in simhash.near_in_buckets(fps, sizes, radius) for a, b in zip(i, j)}
        group = np.repeat(np.arange(len(sizes)), sizes)
        assert got == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if group[a] == group[b] and int(fps[a] ^ fps[b]).bit_count() <= radius}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(7, 7), (-3, 500), (500, -3)] + [(1000, x) for x in range(1001, 1050)]
    root = {n: n for l in links for n in l}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()))
    assert got == {n: r for n, r in root.items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_to_roots_take_no_round(spark, monkeypatch):
    """Links from every node to the smallest of its component are written once, others as often as they change."""
    from gridloom.llm import components as module

    rounds = []
    monkeypatch.setattr(module, "written", lambda df, name, write=module.written: rounds.append(name) or write(df, name))
    stars = [(f"{x:03}", f"{x % 7:03}") for x in range(100)]
    for links, most in ((stars, 1), ([(b, a) for a, b in stars] * 2, 1), ([("b", "a"), ("c", "b")], 2), ([("c", "a"), ("c", "b")], 2)):
        rounds.clear()
        got = dict(map(tuple, components(spark.createDataFrame(links, "a string, b string")).collect()))
        assert got == ({a: b for a, b in stars} if len(links) > 2 else dict.fromkeys("abc", "a")) and len(rounds) == most


def repeats_brute(rows):
    """By the definition, over all pairs of places."""
    first, out = {}, []
    raws = [(1 << 63 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for k in range(len(raw) - 49):
            g = raw[k : k + 50]
            first[g] = min(first.get(g, 1 << 64), i)
    for (i, _), (order, raw) in zip(rows, raws):
        cover = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < order:
                cover[k : k + 50] = True
        spans = int((cover[1:] > cover[:-1]).sum() + cover[0])
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        out.append((i, len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated_texts():
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(45, 140))) for _ in range(8)] + ["x" * 200, "ab" * 90]
    texts = ["".join(rng.choice([*passages, "".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 80)))]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, texts[5]), (None, texts[5]), (None, texts[6] + "!"), (None, texts[6]), (70, texts[9]), (70, texts[9]), (71, passages[0] * 2), (72, None), (73, "a" * 50), (74, "a" * 49)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [None, 1, 5])
def test_repeats(spark, blocks):
    rows = repeated_texts()
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), blocks=blocks)
    assert sorted(map(tuple, got.collect()), key=repr) == repeats_brute(rows)


def test_repeats_of_odd_rows(spark, odd, documents):
    for df in (odd.where("length(text) < 1000 or text is null"), documents.limit(60)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        fixed = spark.createDataFrame([(i, t, None, 0, "k") for i, t in rows], SCHEMA)
        assert sorted(map(tuple, substring_dedup.repeats(fixed).collect()), key=repr) == repeats_brute(rows)
    long = {r[0]: r[1:] for r in substring_dedup.repeats(odd).collect()}
    assert long[7][1:3] == (0, 0) and long[8][1:3] == (0, 0)  # within one text nothing is taken, and capitals differ
    assert substring_dedup.repeats(odd.limit(0)).count() == 0


def test_slabs_do_not_show(monkeypatch):
    raw = bytes(random.Random(1).choice(b"ab") for _ in range(5000)) + b"a" * 400
    whole = substring_dedup.anchors(raw)
    monkeypatch.setattr(substring_dedup, "SLAB", 977)
    parts = substring_dedup.anchors(raw)
    of = lambda a: np.repeat(a[3], a[1] - a[0])
    assert (of(whole) == of(parts)).all() and len(of(whole)) == len(raw) - 49


def test_two_stage_sort():
    rng = random.Random(5)
    for _ in range(400):
        repeat = rng.choice([1, 2, 3, 8, 9, 13, 50])
        letters = rng.choice([b"ab", b"a", b"abc\0", bytes(range(256)), b"\xff\xfe"])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, repeat * 3))) for _ in range(4)]
        strings = [b"".join(rng.choice(base) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 12))]
        owners = np.array([rng.randint(0, 9) for _ in strings], "i8")
        least = {}
        for s, o in zip(strings, owners):
            for i in range(len(s) - repeat + 1):
                least[s[i : i + repeat]] = min(least.get(s[i : i + repeat], 99), o)
        want = [least[s[i : i + repeat]] if i + repeat <= len(s) else -1 for s in strings for i in range(len(s))]
        assert suffix_sort.smallest_owner(b"".join(strings), np.array([len(s) for s in strings], "i8"), owners, repeat).tolist() == want
    text = np.frombuffer(b"mississippi" * 3 + bytes(30), "u1")
    wanted = np.arange(len(text)) < 33
    order = suffix_sort.suffix_order(np.ascontiguousarray(text), wanted, 10)
    prefixes = [bytes(text[i : i + 10]) for i in order]
    assert prefixes == sorted(prefixes) and sorted(order) == list(range(33))


@pytest.mark.parametrize("hot", [0, 40, 1 << 16])
def test_a_phrase_that_all_texts_have(spark, monkeypatch, hot):
    """Phrases of 20 to 60 bytes in every text, in surroundings that differ, agree before them, or agree after them."""
    rng = random.Random(4)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "TOLD", 2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrases = [word(n) for n in (20, 34, 60)]
    common = [word(12) for _ in range(3)]
    rows = []
    for i in range(150):
        text = word(rng.randint(0, 40))
        for p in phrases:
            text += word(rng.randint(5, 30)) + rng.choice([*common, ""]) + p + rng.choice([*common, ""]) + word(rng.randint(5, 30))
        rows.append((rng.choice([i, i, None]), text))
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), blocks=5)
    assert sorted(map(tuple, got.collect()), key=repr) == repeats_brute(rows)


@pytest.mark.parametrize("size", [43, 48, 50, 56])
def test_no_key_keeps_more_pieces_than_are_hot(spark, monkeypatch, size):
    """A phrase about as long as a key in each text, with other bytes around it: pieces of one key are at most HOT, or one a block."""
    rng = random.Random(size)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = word(size)
    rows = [(i, word(rng.randint(40, 60)) + phrase + word(rng.randint(40, 60))) for i in range(400)]
    monkeypatch.setattr(substring_dedup, "HOT", 60)
    monkeypatch.setattr(substring_dedup, "TOLD", 2)
    monkeypatch.setattr(substring_dedup, "SORTED", 2000)
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), blocks=3)
    assert sorted(map(tuple, got.collect()), key=repr) == repeats_brute(rows)

    table = pa.table({"block": [0] * 400, "id": [r[0] for r in rows], "sha": [str(r[0]) for r in rows], "text": [r[1] for r in rows]})
    block = substring_dedup.Block(table, 1 << 30)  # a bucket a key
    every = {b: np.packbits(np.ones(len(at), bool)).tobytes() for b, at in block.by_bucket.items()}
    keys = np.frombuffer(b"".join(block.many(at)[1] for at in block.by_bucket.values()), "<u8").reshape(-1, 2)
    finer = {0: np.ascontiguousarray(keys[keys[:, 1] > 60, 0]).tobytes()}
    most = lambda fine: max(len(pieces) for _, pieces, _, _ in block.pieces(every, every, fine).values())
    assert most(finer) <= 60 and (most({}) > 60 or size == 43)


def test_largest_id_is_no_null(spark):
    text = "the same passage of more than fifty bytes stands in all of these texts, "
    rows = [((1 << 63) - 1, text + "one"), (None, text + "two"), (None, text + "three"), (-(1 << 63), "x" + text), ((1 << 63) - 1, text)]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == repeats_brute(rows)
