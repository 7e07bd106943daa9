"""Merkle manifests against a plain version: all leaves in one list, level by level."""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import pytest

from gridloom.llm import merkle
from gridloom.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def tree(hashes):
    """The root and each leaf's steps (left siblings, right siblings)."""
    steps, places, now = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(now) > 1:
        for j, p in enumerate(places):
            run = p - p % 3
            steps[j].append((now[run:p], now[p + 1 : run + 3]))
        now = [H(*now[i : i + 3]) for i in range(0, len(now), 3)]
        places = [p // 3 for p in places]
    return now[0], steps


def plain(rows):
    rows = [dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r[:5])) for r in rows]
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for name in names:
        held = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        subs[name] = (held, *tree([leaf_of(r) for r in held]))
    root, tops = tree([subs[n][1] for n in names])
    out = []
    for name, top in zip(names, tops):
        held, subroot, steps = subs[name]
        for r, own in zip(held, steps):
            whole = own + top
            h = leaf_of(r)
            if r["doc_id"] is not None and r["text"] is not None and crc32(str(r["doc_id"]).encode()) % 2 == 0:
                h = leaf_of(r | {"text": r["text"].replace("\n", "")})
            for left, right in whole:
                h = H(*left, h, *right)
            proof = H(*[x for left, right in whole for x in left + right])
            out.append((r["doc_id"], leaf_of(r), subroot, root, proof, h, h == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def made(sizes):
    """Sources of these many rows, some texts with line ends, ids in no order."""
    rows, k = [], 0
    for source, n in sizes.items():
        for i in range(n):
            rows.append(((i * 37) % n - 3, f"line {k}\nend {source}" if k % 3 else f"plain {k}", "en", source, k))
            k += 1
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, "b": 1}, {"a": 3, None: 4, "": 1, "é": 2, "Z": 5, "b": 27}, {f"s{i}": i % 5 + 1 for i in range(30)}, {"hot": 700, "x": 1, "y": 10}])
def test_trees_of_many_sizes(spark, sizes):
    rows = made(sizes)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(merkle.tampered_manifest(df)) == plain(rows)


def test_parts_that_cut_through_runs_and_many_rounds(spark, monkeypatch):
    """Small parts and merges of three force unaligned edges on every level and several rounds."""
    rows = made({"hot": 400, "b": 13, "c": 2, None: 31})
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    plainly = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: plainly(*a, **k, part_rows=17, merge=3))
    assert found(merkle.tampered_manifest(df)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "null id\n", "en", None, 3), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "other\n", "en", "s", 6),
        (2, None, None, "s", None), (-5, "\n\n", "", "", 2), (7, "long\n" * 400_000, "en", "s", 2_000_000), (10**18, "big id", "en", "t", 6), (1, "same id elsewhere", "en", "t", 1),
    ]
    assert found(merkle.tampered_manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_very_many_equal_rows(spark):
    rows = [(4, "same\n", "en", "s", 5)] * 300 + made({"s": 40})
    assert found(merkle.tampered_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(merkle.tampered_manifest(spark.createDataFrame([], SCHEMA))) == []
    rows = [(*r, "x", 1, 2) for r in made({"a": 5, "b": 2})]
    odd = spark.createDataFrame(rows, SCHEMA + ", hash string, part int, tree int")
    assert found(merkle.tampered_manifest(odd)) == plain(rows)


def test_a_proof_folds_to_the_root_and_no_other_leaf_does():
    for n in range(1, 30):
        leaves = [H(str(i)) for i in range(n)]
        stack = merkle.Range(n, proving=True)
        for i, h in enumerate(leaves):
            stack.push(0, i, h)
        assert len(stack.stack) == 1
        for i, h in enumerate(leaves):
            proof, _ = stack.proof(0, i)
            assert merkle.fold(h, i, n, proof + "rest") == (stack.stack[0][2], "rest")
            assert merkle.fold(H("other"), i, n, proof)[0] != stack.stack[0][2]


def test_sql(spark, sf_dir, duck, collected):
    assert collected(QUERIES["op12_merkle_manifest"](spark, sf_dir)) == duck(ORACLES["op12_merkle_manifest"])
