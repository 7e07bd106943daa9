"""Merkle manifests: hash trees over the ordered rows of each group, and one over the groups.

Trees have a fan-out (3 unless said): every run of so many nodes becomes their hash, the last run being as short as it comes, without padding.

1. Rows are hashed where they are; what is shuffled from then on is ids and digests. They are dealt by ranges of (tree, order), however hot a tree is,
   and written; a window over the counts of (tree, part) gives each *segment*, a tree's rows in one part, its first index.
2. A *mountain-range stack* goes over each segment: a leaf is pushed, and as the last child of a run arrives, the run is
   carried into its parent, and so on upwards. What is left, the peaks, are the highest nodes that the segment has all leaves of.
3. Peaks of neighbouring parts meet in groups of ``MERGE`` parts, then of that many groups, and go over the same stack, which completes
   the runs that parts had cut through, until a tree is one peak. A round also says how each node it took is proved from the peak it went into.
4. Going back down the rounds, every segment's peaks get their proofs up to the tree's root; a last pass over the segments
   proves each leaf to its peak, and so to the root.

A tree of groups is the same with a group's root as leaf. Nothing is collected: a task holds one segment's digests, or the peaks of ``MERGE`` of them, a few for each level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import shuffle_parts, written

FANOUT = 3
#: Rows of a part, about, which bounds what a task holds; parts are as many as that takes.
PART_ROWS = 200_000
#: Parts, and then groups of parts, whose peaks meet in one task.
MERGE = 64


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Range:
    """A stack of adjacent nodes (level, index, hash) of a tree of ``n`` leaves, that carries as soon as a run is complete.

    With ``proving`` it keeps the runs it carried, so that ``proof`` can go up from any node that it was given.
    """

    def __init__(self, n: int, fanout: int = FANOUT, proving: bool = False):
        self.widths, self.fanout = [n], fanout
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // fanout))
        self.stack: list[tuple[int, int, str]] = []
        self.runs: dict[tuple[int, int], tuple[str, ...]] | None = {} if proving else None

    def push(self, level: int, index: int, value: str) -> None:
        self.stack.append((level, index, value))
        while level + 1 < len(self.widths):
            first = index - index % self.fanout
            size = min(self.fanout, self.widths[level] - first)  # the last run of a level may be shorter, down to one
            run = self.stack[-size:]
            if index != first + size - 1 or len(run) < size or run[0][:2] != (level, first):
                return
            hashes = tuple(h for _, _, h in run)
            if self.runs is not None:
                self.runs[level, first] = hashes
            del self.stack[-size:]
            level, index, value = level + 1, first // self.fanout, digest(hashes)
            self.stack.append((level, index, value))

    def proof(self, level: int, index: int) -> tuple[str, tuple[int, int]]:
        """The siblings from a node up to the peak above it, left to right and level by level, and that peak's level and index."""
        out: list[str] = []
        while (run := self.runs.get((level, index - index % self.fanout))) is not None:
            at = index % self.fanout
            out += run[:at] + run[at + 1 :]
            level, index = level + 1, index // self.fanout
        return "".join(out), (level, index)


def fold(value: str, index: int, n: int, proof: str, fanout: int = FANOUT) -> tuple[str, str]:
    """The root that the leaf ``value`` at ``index`` of ``n`` and a proof lead to, and what they leave of the proof."""
    at, size = 0, 64
    while n > 1:
        left = index % fanout
        run = min(fanout, n - (index - left))
        siblings = [proof[at + size * i : at + size * (i + 1)] for i in range(run - 1)]
        at += size * (run - 1)
        value = digest([*siblings[:left], value, *siblings[left:]])
        index, n = index // fanout, -(-n // fanout)
    return value, proof[at:]


def tree_key(group: Column) -> Column:
    """A group as a string that is never null, and sorts null first and then by bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


_ARROW = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _mapped(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], fields: dict[str, str]) -> DataFrame:
    """A partition's rows through a generator, in batches."""
    schema = pa.schema([(n, _ARROW[k]) for n, k in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = rows(_rows(batches))
        while held := list(islice(made, 1000)):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return df.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields.items()))


def _grouped(rows: Iterator[tuple], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    for key, held in groupby(rows, key=lambda r: r[:keys]):
        yield key, (r[keys:] for r in held)


def _ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the first two of ``keys`` and sorted by all in each partition."""
    return df.repartition(shuffle_parts(df.sparkSession), *keys[:2]).sortWithinPartitions(*keys)


def parted(leaves: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``leaves`` (tree, hash, ..) dealt by ranges of tree, ``order`` and hash, and written with ``part`` and ``spot``, their place in that order.

    Rows that are equal in all of it are alike, and get a place of their own, so that very many of them don't go to one part.
    """
    spark = leaves.sparkSession
    # Written first, so that neither the count nor the sampling of ranges hashes texts again.
    hashed = written(leaves.withColumn("_own", F.monotonically_increasing_id()), "leaves")[0]
    parts = max(shuffle_parts(spark), -(-hashed.count() // part_rows))
    keys = ["tree", *order, "hash", "_own"]
    dealt = hashed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_own")
    return written(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("spot")), "parts")[0]


def _segment_peaks(rows: Iterator[tuple], fanout: int) -> Iterator[tuple]:
    for (part, tree), held in _grouped(rows, 2):
        first, n, _ = next(held)  # a segment's numbers come before its leaves
        stack = Range(n, fanout)
        for index, (_, _, value) in enumerate(held, first):
            stack.push(0, index, value)
        for node in stack.stack:
            yield (part, tree, n, *node)


def _merged(rows: Iterator[tuple], fanout: int) -> Iterator[tuple]:
    for (group, tree), held in _grouped(rows, 2):
        taken = list(held)
        n = taken[0][1]
        stack = Range(n, fanout, proving=True)
        for _, _, level, index, value, _ in taken:
            stack.push(level, index, value)
        peaks = {(level, index): value for level, index, value in stack.stack}
        for _, _, level, index, _, part in taken:
            proof, peak = stack.proof(level, index)
            yield (group, tree, n, *peak, peaks[peak], part, level, index, proof)


_PEAKS = {"part": "int", "tree": "string", "n": "long", "level": "int", "index": "long", "hash": "string"}
_MERGED = {"group": "int", "tree": "string", "n": "long", "level": "int", "index": "long", "hash": "string", "part": "int", "of_level": "int", "of_index": "long", "proof": "string"}


def proved_peaks(parts: DataFrame, fanout: int = FANOUT, merge: int = MERGE) -> DataFrame:
    """(part, tree, n, level, index, proof, root): the peaks of each segment, each with its proof up to its tree's root."""
    counts = parts.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")  # a row a part
    before = F.sum("_n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    none = lambda kind: F.lit(None).cast(kind)
    places = counts.select("part", "tree", F.lit(-1).cast("long").alias("spot"), F.coalesce(before, F.lit(0)).alias("first"), F.sum("_n").over(tree).alias("n"), none("string").alias("hash"))
    leaves = parts.select("part", "tree", "spot", none("long").alias("first"), none("long").alias("n"), "hash")
    stream = _ordered(places.unionByName(leaves), "part", "tree", "spot").select("part", "tree", "first", "n", "hash")
    now = written(_mapped(stream, lambda rows: _segment_peaks(rows, fanout), _PEAKS), "peaks")[0]
    most, rounds = now.agg(F.max("part")).first()[0] or 0, []
    while not rounds or most:
        most //= merge
        start = F.col("index") * F.pow(F.lit(fanout), "level")
        taken = now.select(F.expr(f"int(part div {merge})").alias("group"), "tree", start.alias("_start"), "n", "level", "index", "hash", "part")
        stream = _ordered(taken, "group", "tree", "part", "_start")
        rounds.append(written(_mapped(stream, lambda rows: _merged(rows, fanout), _MERGED), "merged")[0])
        now = rounds[-1].select(F.col("group").alias("part"), "tree", "n", "level", "index", "hash").distinct()
    place = [F.col("of_level").alias("level"), F.col("of_index").alias("index")]
    upper = rounds[-1].select("part", "tree", "n", *place, "proof", F.col("hash").alias("root"))  # the last round leaves a tree one peak
    for r in rounds[-2::-1]:
        above = upper.select(F.col("part").alias("group"), "tree", "level", "index", F.col("proof").alias("_rest"), "root")
        upper = r.drop("hash").join(above, ["group", "tree", "level", "index"]).select("part", "tree", "n", *place, F.concat("proof", "_rest").alias("proof"), "root")
    return upper


def _proved(rows: Iterator[tuple], fanout: int, made: Callable[..., tuple]) -> Iterator[tuple]:
    for _, held in _grouped(rows, 2):
        peaks: list[tuple] = []
        at = last = 0
        for place, leaf in held:
            if place is not None:
                peaks.append(place)
                continue
            if not at and not last:
                peaks.sort(key=lambda p: p["index"] * fanout ** p["level"])
                at = peaks[0]["index"] * fanout ** peaks[0]["level"]
                last, waiting, inside = 0, iter(peaks), []
            if at >= last:
                peak = next(waiting)
                last = min((peak["index"] + 1) * fanout ** peak["level"], peak["n"])
                start, inside = at, []
            inside.append(leaf)
            at += 1
            if at == last:
                stack = Range(peak["n"], fanout, proving=True)
                for index, x in enumerate(inside, start):
                    stack.push(0, index, x["hash"])
                for index, x in enumerate(inside, start):
                    yield made(x, index, peak, stack.proof(0, index)[0] + peak["proof"])


def proved(parts: DataFrame, peaks: DataFrame, made: Callable[..., tuple], fields: dict[str, str], fanout: int = FANOUT) -> DataFrame:
    """``made(leaf, index, peak, proof)`` of every leaf, ``leaf`` and ``peak`` being rows as dictionaries."""
    leaf, peak = (F.struct(*[F.col(c) for c in df.columns if c not in ("part", "tree", "spot")]) for df in (parts, peaks))
    side = peaks.select("part", "tree", F.lit(-1).cast("long").alias("spot"), peak.alias("_peak"))
    stream = _ordered(side.unionByName(parts.select("part", "tree", "spot", leaf.alias("_leaf")), allowMissingColumns=True), "part", "tree", "spot")
    return _mapped(stream.select("part", "tree", "_peak", "_leaf"), lambda rows: _proved(rows, fanout, made), fields)


def encoded(value: Column) -> Column:
    """A value with its length before it, so that no two rows' values run together alike; ``-`` for null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def row_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _with_root(leaf: dict, index: int, peak: dict, proof: str) -> tuple:
    return leaf["name"], index, peak["n"], leaf["hash"], proof, peak["root"]


def manifest(
    rows: DataFrame, values: list[str], group_col: str = "source", id_col: str = "doc_id", altered: Column | None = None, fanout: int = FANOUT, part_rows: int = PART_ROWS, merge: int = MERGE
) -> DataFrame:
    """Every row as (id, leaf, subroot, root, proof_sha256, folded_root, verified): its hash, its group's and the whole table's root, the digest of its proof's siblings, and the root
    that the row, or what ``altered`` gives as its hash in its place, leads to with that proof.

    A leaf is the hash of ``values``. In a group leaves ascend by id, null first; rows of one id by leaf, and equal rows are alike. Groups are ordered by their
    names' bytes, null first and a group of its own. Any row's leaf depends on its values alone, so null, empty and very long ones are nothing special. An
    empty table gives an empty result; columns but those named, clashing names included, are not looked at.
    """
    id_kind = dict(rows.dtypes)[id_col]
    id_kind = id_kind if id_kind == "string" else "long"
    leaves = rows.select(
        tree_key(F.col(group_col)).alias("tree"), F.col(id_col).cast(id_kind).alias("id"), row_hash(*[F.col(c) for c in values]).alias("hash"),
        (F.lit(None).cast("string") if altered is None else altered).alias("altered"),
    )
    parts = parted(leaves, ["id"], part_rows)
    peaks = written(proved_peaks(parts, fanout, merge), "proofs")[0]
    # The tree of groups, whose leaves are their roots.
    groups = peaks.groupBy("tree").agg(F.min("root").alias("hash")).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    top = parted(groups, ["name"], part_rows)
    fields = {"tree": "string", "top_index": "long", "top_n": "long", "subroot": "string", "top_proof": "string", "top_root": "string"}
    roots = written(proved(top, proved_peaks(top, fanout, merge), _with_root, fields, fanout), "roots")[0]

    def made(leaf: dict, index: int, peak: dict, proof: str) -> tuple:
        whole = proof + peak["top_proof"]
        subroot, rest = fold(leaf["altered"] or leaf["hash"], index, peak["n"], whole, fanout)
        folded, _ = fold(subroot, peak["top_index"], peak["top_n"], rest, fanout)
        return leaf["id"], leaf["hash"], peak["root"], peak["top_root"], digest([whole]), folded, folded == peak["top_root"]

    fields = {"id": id_kind, "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
    return proved(parts, peaks.join(roots.drop("subroot"), "tree"), made, fields, fanout).withColumnRenamed("id", id_col)


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, verified against a copy in which texts with an even checksum of their id have lost their line ends; rows of null ids are left alone."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    less = row_hash(*[F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields])
    return manifest(docs, fields, altered=F.when(hit, less))
