"""Near copies by the Jaccard similarity of word shingles: bit-sliced SimHash finds candidates, exact sets decide.

Two sets of n and m shingles of similarity s or more share at least one of the first n - ceil(s n) + 1 of the one and the first
m - ceil(s m) + 1 of the other, in any order that all sets use. These are the buckets in which fingerprints of 128 bits are compared, on bit
planes as in ``simhash``: those within RADIUS bits, and within FULL_RADIUS of 256, become candidate links, if their sizes allow the similarity. So few
unlike texts are linked that components of candidates don't grow together as the table grows. The fingerprint of a small set is
the parity of its hashes at each of 128 places instead: sets that differ in k hashes differ in k places at most. Shingles that are common in a
sample come last in the order, so few texts meet at a shingle; texts that meet at one of the commonest of all, as large groups of near copies
do, are candidates without a comparison, and no bucket holds them. So no result depends on the sample.

Every candidate component is then decided on the sets themselves. Those of up to SMALL_TEXTS texts and SMALL_BYTES bytes are dealt whole to tasks. In
larger ones, round after round, all texts are compared with one head, the open text nearest to the majority of the open texts'
fingerprints, until each is within reach of a head or ROUNDS are over. What heads join is one label; as 1 - Jaccard is a metric, only texts that
are about as far from every head as some text of another label can be near one. These are compared with all such texts of other labels, in blocks
that are dealt over tasks by pairs. So both ways join the same texts, whatever the size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import cut, filled, short_batches, written
from gridloom.llm.components import components
from gridloom.llm.simhash import linked, majority, shingle_hashes, whole_buckets

SHINGLE = 5
SIMILARITY = 0.8
#: Bits by which fingerprints of candidates may differ. At a similarity of 0.8 they differ by 19 on average, and 107,940 pairs of at least that similarity
#: in the check table by 36 at most. One of 4,000 unrelated pairs differs by 44 or less.
RADIUS = 44
#: The same for 256 bits, of which the first 128 are these. At a similarity of 0.8 they differ by 39 on average with a deviation of 5.7, those of unrelated texts by
#: 128 with one of 8; both are 6.5 deviations away.
FULL_RADIUS = 76
#: Sets of fewer shingles are compared by parities.
SMALL = 64
#: Texts that are looked at for common shingles; in how many of them a shingle is common, and in how many no bucket is made for it; how many are told.
SAMPLE, COMMON, HOT, TOLD = 8_000, 6, 64, 20_000
#: Fingerprints beyond which a bucket is compared by itself, one fingerprint after the other, and beyond which a bucket's are all candidates of each other. The
#: sample grows with the table so that a shingle of so many texts is told as common.
BUCKET, WHOLE = 1024, 65_536
#: Texts and bytes of a component that one task decides.
SMALL_TEXTS, SMALL_BYTES = 4096, 8 << 20
#: Heads that the texts of a larger component are compared with at most before the rest is decided in pairs of blocks.
ROUNDS = 12
#: Steps in which distances from heads are told apart.
STEP = 0.01
#: Rows of two numbers that are broadcast at most (64 MB); beyond that both sides are shuffled.
BROADCAST_ROWS = 4_000_000
BROADCAST_BYTES = 16 << 20


def shingle_set(text: str, shingle: int = SHINGLE):  # noqa: ANN201
    """The distinct hashes of the text's shingles, in order; a shorter text is one shingle, and one without words has none."""
    import numpy as np

    return np.unique(shingle_hashes(text, shingle))


def _node(hashes) -> str:  # noqa: ANN001
    """A digest of a set, of 128 bits."""
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(hashes.tobytes())


def _text_hash(text: str | Column) -> Column:
    return F.xxhash64(filled(text))


def _common(docs: DataFrame, text_col: str, shingle: int):  # noqa: ANN202
    """The hashes of the sample's common shingles, their ranks, and whether they are hot, sorted by hash."""
    import numpy as np

    rows = docs.count()
    sample = max(SAMPLE, 3 * COMMON * rows // WHOLE)
    every = max(1, rows // sample)
    texts = docs.select(filled(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for x in batch.column(0):
                counts.update(shingle_set(x.as_py(), shingle).view("i8").tolist())
        some = [(h, n) for h, n in counts.items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], names=["h", "n"])

    found = texts.repartition(max(4, min(sample, rows) // 2000)).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(TOLD).toArrow()
    hashes = np.ascontiguousarray(found.column("h").to_numpy()[::-1]).astype("i8").view("u8")
    order = np.argsort(hashes)
    return hashes[order], order, found.column("n").to_numpy()[::-1][order] >= HOT


def _prefix(hashes, common, ranks, hot, similarity: float):  # noqa: ANN001, ANN202
    """The first shingles of a set in the order that all sets use, those that aren't hot and those that are."""
    import numpy as np

    n = len(hashes)
    size = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not len(common) or not n:
        return hashes[:size], hashes[:0]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    last = common[at] == hashes
    plain = hashes[~last][:size]
    at = at[last]
    at = at[np.argsort(ranks[at])][: size - len(plain)]
    return np.r_[plain, common[at[~hot[at]]]], common[at[hot[at]]]


def parities(hashes) -> tuple[int, int]:  # noqa: ANN001
    """128 bits: whether an odd number of hashes falls on each place."""
    import numpy as np

    odd = np.bincount((hashes >> np.uint64(7)).astype("i8") & 127, minlength=128) & 1
    return tuple(int(x) for x in np.packbits(odd.astype("u1"), bitorder="little").view("<i8"))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def wide_fingerprint(hashes) -> tuple[int, int, int, int]:  # noqa: ANN001
    """Four SimHash fingerprints, of the hashes and of the same mixed again and again."""
    import numpy as np

    out = [majority(hashes)]
    for times in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93):
        again = (hashes ^ hashes >> np.uint64(31)) * np.uint64(times)
        out.append(majority(again ^ again >> np.uint64(29)))
    return tuple(map(_signed, out))


#: A bucket key: 39 bits of a shingle's hash, 1 for parities, and 24 for the size of the set.
_SIZE, _KIND = (1 << 24) - 1, 1 << 24
_MIX = 0x9E3779B97F4A7C15 - (1 << 64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, th, node, n, m1, m2, m3, m4, s1, s2, name, keys, a, b) of every row; th is a hash of the text and ``node`` the set's digest.

    m1 to m4 are the fingerprint, s1 and s2 the parities of a small set, ``name`` its node in the candidate graph. ``keys`` are its buckets, a and b candidate links
    by hot shingles; both are given once for a set in a task.
    """
    common, ranks, hot = _common(docs, text_col, shingle)
    most = SMALL / similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        seen: set[str] = set()
        met: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for x in batch.column(2):
                s = shingle_set(x.as_py(), shingle)
                node = _node(s)
                wide, odd = wide_fingerprint(s), parities(s) if len(s) < most else (None, None)
                own = name(*(wide[:2] if len(s) >= SMALL else odd))
                plain, hots = _prefix(s, common, ranks, hot, similarity) if node not in seen else (s[:0], s[:0])
                seen.add(node)
                keys = (plain >> np.uint64(25) << np.uint64(25) | np.uint64(min(len(s), _SIZE))).view("i8")
                # Hot shingles are nodes of the graph themselves: the text is linked to one, and that to the text's others.
                hots = hots.view("i8").tolist()
                new = {(hots[0], h) for h in hots[1:]} - met
                met |= new
                links = [(own, hots[0]), *new] if hots else []
                if len(s) and SMALL <= len(s) < most:
                    links.append((own, name(*odd)))
                rows.append((node, len(s), *wide, *odd, own, keys, [a for a, _ in links], [b for _, b in links]))
            longs = pa.list_(pa.int64())
            kinds = [pa.string(), *[pa.int64()] * 8, longs, longs, longs]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "th", *names])

    names = ["node", "n", "m1", "m2", "m3", "m4", "s1", "s2", "name", "keys", "a", "b"]
    kinds = [T.StringType(), *[T.LongType()] * 8, *[T.ArrayType(T.LongType())] * 3]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), *[T.StructField(c, t) for c, t in zip(names, kinds)]])
    return docs.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("th"), filled(text_col).alias("text")).mapInArrow(run, schema)


def name(one: int, two: int) -> int:
    """The node of the candidate graph for a fingerprint."""
    return _signed((one * _MIX + two) & (1 << 64) - 1)


def _reached(size: int, near) -> list[int]:  # noqa: ANN001
    """For each of ``size`` places the first of those that ``near`` joins it to, over any number of links; near(i, js) tells which of js are near i."""
    import numpy as np

    root, left = np.arange(size), np.arange(size)
    while len(left):
        first, left = left[0], left[1:]
        queue = [int(first)]
        while queue and len(left):
            hit = near(queue.pop(), left)
            root[left[hit]] = first
            queue.extend(left[hit].tolist())
            left = left[~hit]
    return root


def candidate_links(each: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, full_radius: int = FULL_RADIUS) -> DataFrame:
    """Links (a, b) that join the fingerprints of all texts that may be similar, over any number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for key, n, *words in whole_buckets(split(batches)):
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in (key, n, *words)], axis=0)])
            key, n, fp = key[new], n[new], np.stack([w[new] for w in words], axis=1)
            names = fp[:, 0] * np.int64(_MIX) + fp[:, 1]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[first, len(key)])
            bucket = np.repeat(np.arange(len(first)), sizes)
            whole = np.flatnonzero(sizes[bucket] > WHOLE)
            links = [(names[whole], names[first[bucket[whole]]])]

            def fit(a, b, n, m, odd):  # noqa: ANN001, ANN202
                """Within a bucket sets come by size, so n are no larger than m. Of similar small sets no more hashes than this differ."""
                apart, rest = (np.bitwise_count(a[..., k] ^ b[..., k]).sum(axis=-1, dtype="i8") for k in (slice(2), slice(2, 4)))
                alike = (apart <= radius) & (apart + rest <= full_radius) & (n >= similarity * m - 1e-9)
                return alike & (~odd | (apart * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-9))

            for k in np.flatnonzero((sizes > BUCKET) & (sizes <= WHOLE)):
                at = slice(first[k], first[k] + sizes[k])
                some, many, odd = np.ascontiguousarray(fp[at]).view("u8"), n[at], bool(key[first[k]] & 1)
                one, two = np.ascontiguousarray(some[:, 0]), np.ascontiguousarray(some[:, 1])

                def near(i, js):  # noqa: ANN001, ANN202
                    hit = np.bitwise_count(one[js] ^ one[i]) + np.bitwise_count(two[js] ^ two[i]) <= radius  # noqa: B023
                    at = js[hit]
                    hit[hit] = fit(some[i], some[at], np.minimum(many[i], many[at]), np.maximum(many[i], many[at]), odd)  # noqa: B023
                    return hit

                links.append((names[at], names[at][_reached(len(some), near)]))
            order = np.argsort(-sizes, kind="stable")
            order = order[(sizes[order] > 1) & (sizes[order] <= BUCKET)]
            if len(order):
                first, sizes = first[order], sizes[order]
                place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                some, many, odd = np.ascontiguousarray(fp[place]).view("u8"), n[place], (key[place] & 1).astype(bool)
                root = linked(np.ascontiguousarray(some[:, :2]), sizes, radius, lambda i, j: fit(some[i], some[j], many[i], many[j], odd[i]))  # noqa: B023
                links.append((names[place], names[place][root]))
            pairs = np.concatenate([np.stack(x, axis=1) for x in links])
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            k = np.asarray(batch.column(0))
            n = k & _SIZE
            yield pa.RecordBatch.from_arrays([pa.array(k >> 24), pa.array(np.where(n == _SIZE, np.int64(1 << 40), n)), *batch.columns[1:]], names=["key", "n", *words])

    words, none = ["one", "two", "three", "four"], F.lit(0).cast("long")
    rows = each.where(F.col("n") >= SMALL).select(F.explode("keys").alias("k"), *[F.col(f"m{i + 1}").alias(w) for i, w in enumerate(words)])
    small = each.where(F.col("s1").isNotNull()).select(F.explode("keys").alias("k"), F.col("s1").alias("one"), F.col("s2").alias("two"), none.alias("three"), none.alias("four"))
    rows = rows.union(small.withColumn("k", F.col("k").bitwiseOR(F.lit(_KIND).cast("long"))))
    rows = rows.repartition(F.shiftright("k", 24)).sortWithinPartitions("k", "one", "two")
    return rows.mapInArrow(run, "a long, b long").union(each.select(F.inline(F.arrays_zip("a", "b"))))


def linked_sets(sets: list, similarity: float = SIMILARITY, labels: list | None = None) -> list[tuple[int, int]]:
    """Links of the same components as all pairs of at least ``similarity``; ``sets`` are arrays of distinct hashes, and those of one label are known to be joined."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    free, out = np.ones(len(sets), bool), []
    labels = list(range(len(sets))) if labels is None else labels
    members: dict = {}
    for k, label in enumerate(labels):
        members.setdefault(label, []).append(k)

    def index():  # noqa: ANN202
        at = np.flatnonzero(free)
        values = np.concatenate([sets[k] for k in at]) if len(at) else np.zeros(0, "u8")
        order = np.argsort(values, kind="stable")
        return len(at), values[order], np.repeat(at, sizes[at])[order]

    left, values, owners = index()
    now = left
    for start in range(len(sets)):
        if not free[start]:
            continue
        queue = list(members[labels[start]])
        free[queue], left = False, left - len(queue)
        while queue and left:
            if left < now / 2:
                now, values, owners = index()
            x = queue.pop()
            low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
            many = high - low
            places = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(owners[places], minlength=len(sets))
            new = np.flatnonzero(free & (common * (1 + similarity) >= similarity * (sizes[x] + sizes) - 1e-9)).tolist()
            out.extend((x, k) for k in new)
            for label in dict.fromkeys(labels[k] for k in new):
                free[members[label]], left = False, left - len(members[label])
                queue.extend(members[label])
    return out


def _once(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(root, node, text) of the sets in ``wanted`` (th, node, root), each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            keep = []
            for node, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                # Texts meet by a hash; that the set is the one wanted is seen here.
                good = node not in seen and node == _node(shingle_set(text.as_py(), shingle))
                keep.append(good)
                if good:
                    seen.add(node)
            yield batch.filter(pa.array(keep, pa.bool_()))

    texts = docs.select(_text_hash(text_col).alias("_th"), filled(text_col).alias("text"))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS // 2 else wanted
    return texts.join(few, texts["_th"] == few["th"]).select("root", "node", "text").mapInArrow(run, "root long, node string, text string")


def _decided(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """From (part, node, label, text), each part whole in one task, links (a, b) that join what is similar in it; texts of one label are known to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[str, str]] = {}
        now = None

        def solve() -> pa.RecordBatch:
            names, labels = list(held), [label for label, _ in held.values()]
            first: dict[str, int] = {}  # the start of each tree, by label; as nodes are in order, without labels it is the tree's smallest
            a, b = [], []
            for i, j in linked_sets([shingle_set(t, shingle) for _, t in held.values()], similarity, labels):
                to = first.setdefault(labels[i], i)
                first[labels[j]] = to
                a.append(names[j])
                b.append(names[to])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

        for batch in batches:
            for part, node, label, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if part != now and held:
                    yield solve()
                    held = {}
                now = part
                held[node] = (label, text)
        if held:
            yield solve()

    return rows.select("part", "node", "label", "text").repartition("part").sortWithinPartitions("part", "node").mapInArrow(run, "a string, b string")


def _turned(column: str) -> Column:
    """Joined by this, both sides are shuffled for the join alone, and a component of very many rows can be split over tasks."""
    return F.col(column).bitwiseXOR(F.lit(1).cast("long"))


def _heads(open_: DataFrame) -> DataFrame:
    """(root, head): of each component's open (root, node, fp) the one nearest to the majority of their fingerprints."""
    bit = lambda k: F.lit((1 << k) - (k // 63 << 64)).cast("long")
    most = open_.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("fp").bitwiseAND(bit(k)) != 0).alias(f"_{k}") for k in range(64)])
    middle = F.lit(0).cast("long")
    for k in range(64):
        middle = middle.bitwiseOR(F.when(F.col(f"_{k}") * 2 > F.col("_n"), bit(k)).otherwise(F.lit(0).cast("long")))
    most = most.select(_turned("root").alias("_root"), middle.alias("middle"))
    away = open_.join(most, _turned("root") == F.col("_root")).select("root", "node", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))).alias("d"))
    return away.groupBy("root").agg(F.min(F.struct("d", "node")).alias("best")).select("root", F.col("best.node").alias("head"))


def _by_heads(texts: DataFrame, sets: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) for components too large for a task: ``texts`` are (root, node, text), ``sets`` (root, node, fp, n)."""
    near = 1 - similarity + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        head, its = None, None
        for batch in batches:
            out = []
            for text, name, other in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                if name != head:
                    head, its = name, shingle_set(other, shingle)
                s = shingle_set(text, shingle)
                both = len(np.intersect1d(s, its, assume_unique=True))
                all_ = len(s) + len(its) - both
                out.append((all_ - both) / max(1, all_))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.float64())], names=["root", "node", "head", "far"])

    seen, open_ = [], sets
    for _ in range(ROUNDS):
        heads = cut(_heads(open_).select(F.col("root").alias("_of"), "head"))
        told = texts.join(F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads, (F.col("root") == F.col("_of")) & (F.col("node") == F.col("head")))
        told = cut(told.groupBy("root", "head").agg(F.first("text").alias("other")).select(_turned("root").alias("_root"), "head", "other"))
        size = told.agg(F.sum(F.octet_length("other"))).first()[0]
        if size is None:
            break
        pairs = texts.join(F.broadcast(told) if size <= BROADCAST_BYTES else told, _turned("root") == F.col("_root"))
        seen.append(cut(pairs.select("root", "node", "text", "head", "other").mapInArrow(run, "root long, node string, head string, far double")))
        done = seen[-1].where(F.col("far") <= near).select(F.col("node").alias("_node")).distinct()
        open_ = cut(open_.join(done, F.col("node") == F.col("_node"), "left_anti"))
    found = seen[0]
    for more in seen[1:]:
        found = found.unionByName(more)
    links = found.where(F.col("far") <= near).select(F.col("node").alias("a"), F.col("head").alias("b"))
    rest = cut(_unsettled(found, _labels(found, sets, near), near))
    if rest.isEmpty():
        return links
    parts = _pairs_of_blocks(rest).withColumnRenamed("node", "_node")
    return links.unionByName(_decided(texts.join(parts, F.col("node") == F.col("_node")), similarity, shingle))


def _labels(found: DataFrame, sets: DataFrame, near: float) -> DataFrame:
    """(root, node, n, label): the same label for all that links to heads join; an open text is its own."""
    own = cut(found.where(F.col("far") <= near).groupBy("node").agg(F.sort_array(F.collect_set("head")).alias("heads")))  # at most ROUNDS
    joined = components(own.select(F.explode("heads").alias("a"), F.col("heads")[0].alias("b"))).select(F.col("node").alias("_head"), F.col("root").alias("_label"))
    own = own.select(F.col("node").alias("_node"), F.col("heads")[0].alias("_first"))
    own = own.join(joined, F.reverse("_first") == F.reverse("_head"), "left").select("_node", F.coalesce("_label", "_first").alias("_label"))
    return cut(sets.join(own, F.col("node") == F.col("_node"), "left").select("root", "node", "n", F.coalesce("_label", "node").alias("label")))


def _unsettled(found: DataFrame, labelled: DataFrame, near: float) -> DataFrame:
    """The rows of ``labelled`` that can be near a text of another label: similar texts are about as far as each other from every head."""
    reach = int(near / STEP) + 2
    far = found.select("node", "head", F.floor(F.col("far") / STEP).alias("step")).distinct().withColumnRenamed("node", "_node")
    far = labelled.join(far, F.col("node") == F.col("_node")).select("root", "node", "label", "head", "step")
    steps = far.groupBy("root", "head", "step").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    steps = steps.select("root", "head", F.explode(F.sequence(F.col("step") - reach, F.col("step") + reach)).alias("step"), "low", "high")
    steps = steps.groupBy("root", "head", "step").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    steps = steps.select(_turned("root").alias("_root"), F.col("head").alias("_head"), F.col("step").alias("_step"), (F.col("low") != F.col("high")).alias("mixed"))
    same = (_turned("root") == F.col("_root")) & (F.col("head") == F.col("_head")) & (F.col("step") == F.col("_step"))
    able = far.join(steps, same).groupBy("node").agg(F.bool_and("mixed").alias("able")).where("able").select(F.col("node").alias("_node"))
    return labelled.join(able, F.col("node") == F.col("_node"), "left_semi")


def _pairs_of_blocks(rest: DataFrame) -> DataFrame:
    """(part, node, label): ``rest`` dealt to blocks of about half of what a task decides, and these by pairs, so that any two of a root and of different labels meet in a part.

    A label that fills several blocks has blocks of its own, which don't meet each other; the others share blocks.
    """
    blocks = lambda: F.greatest(F.ceil(F.sum("_texts") / max(1, SMALL_TEXTS // 2)), F.ceil(F.sum("_bytes") / max(1, SMALL_BYTES // 2)))
    labels = rest.groupBy("root", "label").agg(F.count(F.lit(1)).alias("_texts"), F.sum(F.col("n") * 8).alias("_bytes"))
    labels = labels.groupBy("root", "label", "_texts", "_bytes").agg(blocks().alias("_many")).withColumn("own", F.when(F.col("_many") > 1, F.col("label")).otherwise(F.lit("")))
    sizes = labels.groupBy("root", "own").agg(blocks().alias("many"))
    labels = labels.select("root", "label", "own").join(sizes, ["root", "own"]).select(F.col("root").alias("_root"), F.col("label").alias("_label"), "own", "many")
    turned = (F.col("root") == F.col("_root")) & (F.reverse("label") == F.reverse("_label"))
    dealt = cut(rest.join(labels, turned).select("root", "node", "label", "own", F.concat_ws(":", "own", F.pmod(F.xxhash64("node"), "many").cast("string")).alias("block")))
    one = cut(dealt.select("root", "own", "block").distinct())
    two = one.select(F.col("root").alias("_root"), F.col("own").alias("_own"), F.col("block").alias("_block"))
    pairs = one.join(two, (F.col("root") == F.col("_root")) & (F.col("block") <= F.col("_block")) & ((F.col("own") != F.col("_own")) | (F.col("own") == "")))
    part = F.concat_ws("|", F.col("root").cast("string"), "block", "_block").alias("part")
    pairs = pairs.select("_root", F.explode(F.array_distinct(F.array("block", "_block"))).alias("_block"), part)
    return dealt.join(pairs, (F.col("root") == F.col("_root")) & (F.col("block") == F.col("_block"))).select("part", "node", "label")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Every row of ``docs`` as (id, th, component_id, stays): th is a hash of the text; of each class one document stays.

    That is the one with the smallest id, null ids coming last, and of texts that share it the one with the smallest hash.
    """
    short_batches(docs.sparkSession)
    each = cut(signatures(docs, id_col, text_col, shingle, similarity))
    roots = components(candidate_links(each, similarity))
    sets = each.groupBy("node", F.col("m1").alias("fp"), "n", "name").agg(F.lit(0).alias("_"))
    sets = cut(sets.join(roots.select(_turned("node").alias("_name"), "root"), _turned("name") == F.col("_name"), "left").select("node", "n", "fp", F.coalesce("root", "name").alias("root")))
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("words")).where(F.col("texts") > 1)
    large = (F.col("texts") > SMALL_TEXTS) | (F.col("words") * 8 > SMALL_BYTES)
    sets = sets.join(sizes.select(_turned("root").alias("_root"), large.alias("large")), _turned("root") == F.col("_root"))
    rows = each.select("th", F.col("node").alias("_node")).distinct()
    wanted = cut(rows.join(sets, F.col("node") == F.col("_node")).select("th", "node", "fp", "n", "root", "large"))
    small = _once(docs, wanted.where("not large"), id_col, text_col, shingle)
    links = _decided(small.select(F.col("root").alias("part"), "node", F.col("node").alias("label"), "text"), similarity, shingle)
    if not wanted.where("large").isEmpty():
        texts, _ = written(_once(docs, wanted.where("large"), id_col, text_col, shingle), "texts")
        links = links.unionByName(_by_heads(texts, wanted.where("large").select("root", "node", "fp", "n").distinct(), similarity, shingle))
    labels = components(links).select(F.reverse("node").alias("_node"), F.col("root").alias("label"))
    labelled = each.select("id", "th", "node").join(labels, F.reverse("node") == F.col("_node"), "left").select("id", "th", F.coalesce("label", "node").alias("label"))
    winners = labelled.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("best"))
    winners = winners.select(F.reverse("label").alias("_label"), "best")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("th") == F.col("best.th"))
    return labelled.join(winners, F.reverse("label") == F.col("_label")).select("id", "th", F.col("best.id").alias("component_id"), stays.alias("stays"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Every row of ``docs`` as (id, component_id): the least id among the texts that links of at least ``similarity`` join.

    Null texts are empty; texts without words are copies of each other. Null ids are carried and link like others, and a component of null
    ids alone has a null ``component_id``. Rows that repeat an id are each reported by their own text. An empty table gives an empty result.
    Other columns are not looked at.
    """
    return classes(docs, id_col, text_col, shingle, similarity).select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are near copies of the document of their class that stays, columns unchanged.

    Rows go by id and text together: of texts that share an id each stays or goes by itself, and rows that repeat both stay or go alike.
    A row without an id goes if its class has another document that stays.
    """
    gone = cut(classes(docs, id_col, text_col).where(~F.col("stays")).select(F.col("id").alias("_gone"), F.col("th").alias("_th")).distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(few, docs[f"`{id_col}`"].eqNullSafe(few["_gone"]) & (_text_hash(docs[f"`{text_col}`"]) == few["_th"]), "left_anti")
