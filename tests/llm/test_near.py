"""The pipeline's near copies against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gridloom.llm import jaccard


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows, similarity=0.8):
    """(id, least id of its component), over all pairs, and the least id of each component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min((i for (i, _), x in zip(rows, root) if x == r and i is not None), default=None) for r in root}
    return sorted(((i, least[r]) for (i, _), r in zip(rows, root)), key=repr), sorted(least.values(), key=repr)


def edited():
    """Groups of copies with a few edits each, chains of them, texts that share passages, and odd rows."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage, out = [word() for _ in range(60)], []
    for n in (4, 12, 40, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for _ in range(6):
                own = list(base)
                for _ in range(rng.randint(0, max(1, n // 35))):
                    own[rng.randrange(n)] = word()
                out.append(" ".join(own))
        chain = [word() for _ in range(n)]
        for _ in range(8):
            chain[rng.randrange(n)] = word()
            out.append(" ".join(chain))
        out += [" ".join([word() for _ in range(n // 4)] + passage + [word() for _ in range(n // 4)]) for _ in range(5)]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return [*rows, (None, out[0] + " x"), (None, None), (900, ""), (901, " \n"), (902, "A b"), (903, "a B"), (5, out[70]), (904, "w " * 30_000)]


SETTINGS = {
    "as it is": {},
    "no common shingles": {"COMMON": 10**9},
    "hot shingles": {"COMMON": 2, "HOT": 3},
    "large buckets": {"BUCKET": 2},
    "heads": {"SMALL_TEXTS": 2, "ROUNDS": 3},
    "heads and a rest": {"SMALL_TEXTS": 2, "ROUNDS": 1, "HOT": 3, "BROADCAST_ROWS": 0, "BROADCAST_BYTES": 0},
}


@pytest.mark.parametrize("how", SETTINGS)
def test_near_stage_equals_brute_force(spark, monkeypatch, how):
    import corpus_pipeline as pipe

    for name, value in SETTINGS[how].items():
        monkeypatch.setattr(jaccard, name, value)
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, firsts = brute(rows)
    assert sorted(map(tuple, jaccard.near_copies(df).collect()), key=repr) == want
    assert len(rows) - len(firsts) > 50
    if how != "as it is":
        return
    kept = pipe.near_stage(spark, df, "")
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == firsts


def chains():
    """Chains of texts of which only neighbours are similar, so that no head is near two of another head's, and unlike texts with half of a chain's words."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    out = []
    for step in (1, 1, 2, 4):
        text = [word() for _ in range(50 * step)]
        for at in range(10):
            out.append(" ".join(text))
            for k in range(step):
                text[4 + (at % 8 * step + k) * 5 + at // 8] = word()
        out += [" ".join(text[: 25 * step] + [word() for _ in range(25 * step)]) for _ in range(3)]
    return list(enumerate(out))


@pytest.mark.parametrize(("texts", "size", "rounds"), [(4096, 8 << 20, 12), (2, 8 << 20, 12), (6, 8 << 20, 2), (4096, 1500, 3)])
def test_links_between_the_reaches_of_heads(spark, monkeypatch, texts, size, rounds):
    """The same components whether a task decides one whole or heads and blocks do."""
    for name, value in {"SMALL_TEXTS": texts, "SMALL_BYTES": size, "ROUNDS": rounds}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = chains()
    want, firsts = brute(rows)
    assert len(firsts) == 4 * (1 + 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.near_copies(df).collect()), key=repr) == want


def test_every_pair_of_blocks_meets(spark, monkeypatch):
    """Any two texts of different labels of a component are in one part, and a part has no more of them than two blocks."""
    monkeypatch.setattr(jaccard, "SMALL_TEXTS", 20)
    rows = [(root, f"{root}n{k}", "big" if k < 60 else f"{root}l{k % 7}", 10) for root in (1, 2) for k in range(100)]
    parts = {}
    for part, node, label in jaccard._pairs_of_blocks(spark.createDataFrame(rows, "root long, node string, label string, n int")).collect():
        parts.setdefault(part, {})[node] = label
    met = {(a, b) for held in parts.values() for a in held for b in held if held[a] != held[b]}
    assert met == {(a, b) for r, a, x, _ in rows for q, b, y, _ in rows if r == q and x != y}
    assert max(map(len, parts.values())) < 50 and len(parts) > 20


def test_rows_go_by_id_and_text(spark):
    long = "one two three four five six seven eight nine ten "
    rows = [(1, long), (5, long + "x"), (5, "wholly other words that no other text has"), (None, long), (7, long.upper() + "X"), (7, None), (None, "alone"), (None, "ALONE ")]
    df = spark.createDataFrame([(i, t, t, 0) for i, t in rows], "doc_id long, text string, th string, root int")
    kept = jaccard.drop_near_copies(df)
    assert kept.columns == df.columns
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert got - {(None, "alone"), (None, "ALONE ")} == {(1, long), (5, rows[2][1]), (7, None)} and len(got) == 4
    assert jaccard.drop_near_copies(df.limit(0)).count() == jaccard.near_copies(df.limit(0)).count() == 0


def test_near_stage_of_documents(spark, sf_dir):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    docs = pipe.exact_stage(spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    gone = {i for i, least in brute(rows)[0] if i != least}
    assert gone and {r.doc_id for r in pipe.near_stage(spark, docs, sf_dir).collect()} == {i for i, _ in rows} - gone


def test_links_of_sets():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 400, 40) for _ in range(5)]
    sets = [np.unique(np.r_[base[rng.integers(5)][rng.random(40) < 0.93], rng.integers(0, 400, 2)]).astype("u8") for _ in range(80)]
    root = list(range(80))
    for a, b in jaccard.linked_sets(sets):
        assert len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
        root = [root[a] if r == root[b] else r for r in root]
    for a in range(80):
        for b in range(a):
            if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])):
                assert root[a] == root[b]


def fingerprints_with(flips, rng):
    """Fingerprints of 256 bits as four longs: one, and for each of ``flips`` (in the first 128 bits, in the others) one that differs from it by so many."""
    base = rng.integers(0, 2, 256)
    out = [base]
    for a, b in flips:
        bits = base.copy()
        bits[np.r_[rng.choice(128, a, replace=False), 128 + rng.choice(128, b, replace=False)]] ^= 1
        out.append(bits)
    return [[int(x) for x in np.packbits(bits.astype("u1"), bitorder="little").view("<i8")] for bits in out]


def links_in_one_bucket(spark, fps):
    """The places of ``fps`` by what candidate links join, if all are of a bucket."""
    rows = [(str(i), 100, *fp, None, None, jaccard.name(*fp[:2]), [(12345 << 25) + 100], [], []) for i, fp in enumerate(fps)]
    kinds = "node string, n long, m1 long, m2 long, m3 long, m4 long, s1 long, s2 long, name long, keys array<long>, a array<long>, b array<long>"
    links = jaccard.candidate_links(spark.createDataFrame(rows, kinds)).collect()
    at, root = {r[8]: i for i, r in enumerate(rows)}, list(range(len(fps)))
    for a, b in links:
        new, old = sorted((root[at[a]], root[at[b]]))
        root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("bucket", [1024, 2])
def test_candidates_agree_in_all_their_bits(spark, monkeypatch, bucket):
    """Unlike texts that agree in the first 128 bits by chance are no candidates, whatever the size of their bucket."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    fps = fingerprints_with([(44, 64), (44, 32), (45, 0), (20, 57), (44, 33)], np.random.default_rng(5))
    root = links_in_one_bucket(spark, fps)
    assert root[2] == 0 and [root[k] == 0 for k in (1, 3, 4, 5)] == [False] * 4


def test_a_large_bucket_is_compared(spark):
    """A shingle of very many unlike texts that the sample doesn't tell as common joins none of them, and near copies among them meet."""
    rng = np.random.default_rng(4)
    fps = [[int(x) for x in rng.integers(-(1 << 63), 1 << 63, 4)] for _ in range(1500)]
    fps += fingerprints_with([(20, 20)] * 30, rng)
    root = links_in_one_bucket(spark, fps)
    assert root == [*range(1500), *[1500] * 31]
