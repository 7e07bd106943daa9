"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints go to a few tables by blocks of their bits: within radius 2 at least two of four 16-bit blocks are the
same, so links are sought only among fingerprints that share two blocks. A bucket of over HOT distinct fingerprints is split
again by the same rule on its other 32 bits, after which it can't hold more than 65,536.

Within a task the fingerprints of many buckets lie side by side as *bit planes*: plane k holds bit k of 64 fingerprints a word. All
fingerprints are compared with those d places on, for all of them at once: each plane's differing bits are added to
bitwise carry-save counters (two for a radius of 2), and words in which every distance has passed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import cut, filled, short_batches
from gridloom.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Distinct fingerprints in a bucket beyond which it is split again.
HOT = 8192
#: Fingerprints compared side by side in one go.
LANES = 1 << 20


def shingle_hashes(text: str, shingle: int = SHINGLE):  # noqa: ANN201
    """The hashes of the text's word shingles as uint64; of fewer words than a shingle that of the whole, and of none nothing."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return np.zeros(0, "<u8")
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(whole, SEED)], "<u8")
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]]
    return np.array([xxh64_intdigest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], "<u8")


def majority(hashes) -> int:  # noqa: ANN001
    """64 bits, each 1 if set in over half the hashes."""
    import numpy as np

    counts = np.zeros(64, "int64")
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each 1 if set in over half the hashes of the text's word shingles."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f - (f >> 63 << 64) for f in fps], pa.int64())], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), filled(text_col).alias("text")).mapInArrow(run, schema)


def near_in_buckets(fps, sizes, radius: int = RADIUS):  # noqa: ANN001, ANN201
    """Yield (i, j) arrays of the places of fingerprints of one bucket within ``radius`` of each other.

    ``fps`` is uint64, one or several words a fingerprint, bucket after bucket, larger buckets first; ``sizes`` has the buckets' sizes. The counters
    start so far below their end that one more than ``radius`` differing bits makes them overflow.
    """
    import numpy as np

    n = len(fps)
    words = -(-n // 64) + 1
    many = fps.size // n * 64 if n else 0
    bits = np.zeros((many, words * 64), "u1")
    bits[:, :n] = np.unpackbits(fps.view("u1").reshape(n, -1), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    del bits
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)) - 1  # how many follow in the bucket
    reach = np.cumsum(sizes)
    slack = (1 << radius.bit_length()) - 1 - radius
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        active = int(reach[np.searchsorted(-sizes, -d, side="left") - 1])  # buckets of over d fingerprints
        valid = np.zeros(-(-active // 64) * 64, "u1")
        valid[:active] = left[:active] >= d
        alive = np.packbits(valid, bitorder="little").view("<u8")
        at = np.flatnonzero(alive)
        alive = alive[at]
        counters = [np.full(len(at), (1 << 64) - 1 if slack >> c & 1 else 0, "u8") for c in range(radius.bit_length())]
        jump, shift = divmod(d, 64)
        for k in range(many):
            plane = planes[k]
            here = np.minimum(at + jump, words - 1)
            other = plane[here] >> np.uint64(shift)
            if shift:
                other |= plane[np.minimum(here + 1, words - 1)] << np.uint64(64 - shift)
            carry = plane[at] ^ other
            for c, counter in enumerate(counters):
                counters[c], carry = counter ^ carry, counter & carry
            alive &= ~carry
            if k % 4 == 3:
                some = np.flatnonzero(alive)
                if len(some) < len(at):
                    at, alive, counters = at[some], alive[some], [c[some] for c in counters]
                if not len(at):
                    break
        if len(at):
            word, lane = np.nonzero(np.unpackbits(alive.view("u1").reshape(-1, 8), axis=1, bitorder="little"))
            i = at[word] * 64 + lane
            yield i, i + d


def linked(fps, sizes, radius: int = RADIUS, allowed: Callable | None = None):  # noqa: ANN001, ANN201
    """For each fingerprint the first place of those that it is linked to within these buckets, over any number of links that are ``allowed``."""
    import numpy as np

    root = np.arange(len(fps))
    for i, j in near_in_buckets(fps, sizes, radius):
        if allowed is not None:
            fit = allowed(i, j)
            i, j = i[fit], j[fit]
        a, b = root[i], root[j]
        new = np.flatnonzero(a != b)
        if not len(new):
            continue
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y in zip(a[new].tolist(), b[new].tolist()):  # each that joins two sets takes one from a bounded number
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        olds = np.fromiter(up, "i8", len(up))
        to = np.arange(len(fps))
        to[olds] = [find(x) for x in up]
        root = to[root]
    return root


def whole_buckets(batches: Iterator[pa.RecordBatch], keys: int = 1, most: int = LANES):  # noqa: ANN201
    """Columns of sorted rows as arrays, about ``most`` rows at a time, with all rows that agree in the first ``keys`` columns together."""
    import numpy as np

    held, rows, wait = [], 0, most
    for batch in batches:
        held.append([np.asarray(batch.column(i)) for i in range(batch.num_columns)])
        rows += batch.num_rows
        if rows >= wait:
            all_ = [np.concatenate(x) for x in zip(*held)]
            last = np.flatnonzero(np.any([c != c[-1] for c in all_[:keys]], axis=0))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield [x[:done] for x in all_]
            held, rows = [[x[done:] for x in all_]], rows - done
            wait = max(most, 2 * rows)  # a bucket that goes on is not copied at every batch
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (t, key, fp) sorted by bucket, links (a, b) of fingerprints to the first of their set in the bucket."""
    import numpy as np

    for t, key, fp in whole_buckets(batches, 2):
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[first, len(fp)])
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        first, sizes = first[sizes > 1], sizes[sizes > 1]
        if not len(sizes):
            continue
        place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        some = np.ascontiguousarray(fp[place])
        root = linked(some.view("u8"), sizes)
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(some[moved]), pa.array(some[root[moved]])], names=["a", "b"])


def _keys(value: Column, bits: int, number: int) -> list[tuple[int, Column, Column]]:
    """For each pair of the ``number`` blocks of ``bits`` bits of ``value``: its place, both blocks, and all others."""
    block = [F.shiftrightunsigned(value, bits * i).bitwiseAND((1 << bits) - 1) for i in range(number)]
    out = []
    for t, (i, j) in enumerate(combinations(range(number), 2)):
        k, m = (x for x in range(number) if x not in (i, j))
        out.append((t, F.shiftleft(block[i], bits).bitwiseOR(block[j]), F.shiftleft(block[k], bits).bitwiseOR(block[m])))
    return out


def fingerprint_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp that have the same components as all pairs within RADIUS."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), key.alias("key"), rest.alias("rest")) for t, key, rest in _keys(F.col("fp"), 16, 4)])
    rows = distinct.select("fp", F.inline(tables))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # Joined by a turned key, for which alone both sides are shuffled, so that a bucket of very many rows can be split over tasks.
    turned = F.col("key").bitwiseXOR(F.lit(1).cast("long"))
    sizes = sizes.select(F.col("t").alias("_t"), turned.alias("_key"), "size")
    rows = rows.join(sizes, (F.col("t") == F.col("_t")) & (turned == F.col("_key")))
    again = F.array(*[F.struct((F.col("t") * 6 + 6 + s).alias("t"), F.shiftleft("key", 16).bitwiseOR(sub).alias("key")) for s, sub, _ in _keys(F.col("rest"), 8, 4)])
    split = F.when(F.col("size") > hot, again).otherwise(F.array(F.struct("t", "key")))
    rows = rows.select("fp", F.inline(split)).repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return rows.select("t", "key", "fp").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Every row of ``docs`` as (id, fingerprint, component_id).

    Null texts are empty; texts without words have fingerprint zero and are linked like any other. Rows that repeat an id
    are each reported. Null ids are carried, and a component of null ids alone has a null ``component_id``. An empty table gives an
    empty result. Columns other than the two named are not looked at.
    """
    short_batches(docs.sparkSession)
    each = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(each.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(fingerprint_links(distinct.select("fp"), hot))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    turned = F.col("root").bitwiseXOR(F.lit(1).cast("long"))  # as above, for a component of very many fingerprints
    classes = rooted.join(least.select(turned.alias("_root"), "component_id"), turned == F.col("_root")).select(F.col("fp").bitwiseXOR(F.lit(1).cast("long")).alias("_fp"), "component_id")
    same = each["fp"].bitwiseXOR(F.lit(1).cast("long")) == classes["_fp"]
    return each.join(classes, same).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
