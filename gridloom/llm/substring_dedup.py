"""Removal of long repeats between documents by suffix sorting.

A byte goes if it lies in REPEAT bytes that also start in a document with a smaller id. Suffixes are sorted in many tasks, and to sort
them a task must hold all suffixes that may share their first REPEAT bytes. So each place where REPEAT bytes start is dealt by
what these bytes hold: the smallest hash of the GRAM-byte strings in them, their *anchor*. Equal strings have equal anchors. The places
that have one anchor in a row are sent as one short piece of text:

1. copies of a whole text become one (the others are removed altogether), and texts are dealt into blocks;
2. blocks send five bytes of each distinct anchor to its bucket, which answers whether another text has it, and whether it is *hot*: in so
   many pieces that these are dealt by more of their bytes than the anchor's (``GROUPS``), as a phrase that all documents have is. Blocks also
   tell how many pieces each key of ``GROUPS`` has; where these are too many still, as for a phrase a little longer than the key in
   surroundings that differ, each start goes by its own REPEAT bytes, of which a block has one piece;
3. blocks send the pieces of shared anchors, each distinct piece once, with its smallest id; the buckets sort their suffixes in two
   stages, compare neighbours, and answer for each start whether its bytes are in a document with a smaller id. Pieces of different keys
   can't be equal, so a large bucket is sorted in turns of whole keys;
4. blocks put the answers together to spans.

No step sends a row for each pair of documents; a piece that a third of all documents have is sent once by each block. Rows go from
blocks to buckets, so blocks grow with the root of the input, and the rows with the input itself.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import filled, shuffle_parts
from gridloom.llm.suffix_sort import REPEAT, smallest_owner

GRAM = 20
#: Text of a block, and of a bucket, on average: at least, at most, and the bytes of input that a row between them stands for.
BLOCK_BYTES, MOST_BYTES, ROW_BYTES = 6 << 20, 256 << 20, 64 << 10
#: Pieces, distinct within blocks, beyond which an anchor is hot (10 MB), and of how many a block tells the number.
HOT, TOLD = 1 << 17, 16
#: Pieces in bytes that a bucket sorts in one turn, on average; one key adds at most HOT pieces and TOLD a block to it.
SORTED = 1 << 28
#: Places whose anchors are sought in one go; bounds the memory that a very long text takes.
SLAB = 1 << 22
#: The starts of a hot anchor's pieces, by their distance from the anchor. Those of one group have all bytes in common that lie in each of their
#: strings, 42 at least, and are dealt by these; strings that reach far into what surrounds a phrase fall apart by it.
GROUPS = ((0, 0), (1, 1), (2, 3), (4, 7), (8, 14), (15, 22), (23, 26), (27, 28), (29, 29), (30, 30))
EMPTY = sha256(b"").hexdigest()


def block_bytes(total: int) -> int:
    return min(max(BLOCK_BYTES, int((total * ROW_BYTES) ** 0.5)), MOST_BYTES)


def _power(e: int):  # noqa: ANN202
    import numpy as np

    return np.uint64(pow(0x9E3779B97F4A7C15, e, 1 << 64))


def _hashes(raw):  # noqa: ANN001, ANN202
    """A hash of the GRAM bytes from each place."""
    import numpy as np

    n = len(raw)
    pieces = {1: raw.astype("u8") + np.uint64(1)}
    while 2 * max(pieces) <= GRAM:
        k = max(pieces)
        pieces[2 * k] = pieces[k][:-k] * _power(k) + pieces[k][k:]
    out, length = None, 0
    for k in sorted(pieces, reverse=True):
        while length + k <= GRAM:
            part = pieces[k][length : length + n - GRAM + 1]
            out = part if out is None else out * _power(k) + part
            length += k
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def _slab_anchors(raw):  # noqa: ANN001, ANN202
    """Of the places where REPEAT bytes start: where each run of one anchor begins, the anchor's place, and its hash."""
    import numpy as np

    h = _hashes(raw)
    width = REPEAT - GRAM + 1  # hashes in REPEAT bytes
    low = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype="u8")  # of equal hashes the first place
    least, span = low, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    last = width - span
    least = np.minimum(least[: len(least) - last], least[last:]) if last else least
    at = (least & np.uint64((1 << 24) - 1)).astype("i8")
    begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return begins, at[begins], h[at[begins]]


def anchors(raw: bytes):  # noqa: ANN201
    """(begins, ends, places, hashes) of the runs of starts with one anchor."""
    import numpy as np

    starts = len(raw) - REPEAT + 1
    if starts <= 0:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")
    data = np.frombuffer(raw, "u1")
    parts = [(a + b, a + p, h) for a in range(0, starts, SLAB) for b, p, h in [_slab_anchors(data[a : min(a + SLAB, starts) + REPEAT - 1])]]
    begins, places, hashes = (np.concatenate(x) for x in zip(*parts))
    return begins, np.r_[begins[1:], starts], places, hashes


def _five(x):  # noqa: ANN001, ANN202
    """The low five bytes of each number, packed."""
    import numpy as np

    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :5]).tobytes()


def _unfive(packed: bytes):  # noqa: ANN202
    import numpy as np

    wide = np.zeros((len(packed) // 5, 8), "u1")
    wide[:, :5] = np.frombuffer(packed, "u1").reshape(-1, 5)
    return wide.reshape(-1).view("<u8")


def _grouped(raw: bytes, begin: int, end: int, place: int):  # noqa: ANN202
    """(number, key, first, last) of the groups that the starts of a run fall into, the key being a hash of what all strings of the group share.

    These bytes hold the anchor, so a key belongs to one anchor.
    """
    from xxhash import xxh64_intdigest

    for number, (least, most) in enumerate(GROUPS):
        first, last = max(begin, place - most), min(end, place - least + 1)
        if first < last:
            yield number, xxh64_intdigest(raw[place - least : place - most + REPEAT], number), first, last


class Block:
    """The texts of a block in order of id, with their anchors."""

    def __init__(self, table: pa.Table, buckets: int):
        import numpy as np

        rows = sorted(zip(table["id"].to_pylist(), table["sha"].to_pylist(), table["text"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.number = table["block"][0].as_py()
        self.ids, self.shas = [r[0] for r in rows], [r[1] for r in rows]
        self.raws = [r[2].encode("utf-8", "surrogatepass") for r in rows]
        found = [anchors(r) for r in self.raws]
        self.begins, self.ends, self.places, hashes = (np.concatenate([f[k] for f in found]) for k in range(4))
        self.doc = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
        self.distinct, first, self.inverse, self.counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.buckets, self.frequent = buckets, None
        later = np.flatnonzero(self.doc != self.doc[first[self.inverse]]) if len(hashes) else np.zeros(0, "i8")
        self.twice = np.zeros(len(self.distinct), bool)  # anchors that two texts of this block have
        self.twice[self.inverse[later]] = True
        self.bucket = (self.distinct >> np.uint64(40)).astype("i8") % buckets
        order = np.argsort(self.bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, self.bucket[order][1:] != self.bucket[order][:-1]]) if len(order) else np.zeros(0, "i8")
        self.by_bucket = {int(self.bucket[order[a]]): order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])}

    def _runs(self, rows):  # noqa: ANN001, ANN202
        """(anchor, text, begin, end, place) of runs."""
        columns = (self.inverse, self.doc, self.begins, self.ends, self.places)
        return ((anchor, self.raws[doc], begin, end, place) for anchor, doc, begin, end, place in zip(*[c[rows].tolist() for c in columns]))

    def many(self, at) -> tuple[bytes, bytes]:  # noqa: ANN001
        """Of the anchors ``at`` that have over TOLD distinct pieces: their place in ``at``, and the number of pieces; and their keys with over TOLD pieces."""
        import numpy as np

        if self.frequent is None:
            pieces: dict[int, set[bytes]] = {}
            for anchor, raw, begin, end, _ in self._runs(np.flatnonzero(self.counts[self.inverse] > TOLD)):
                pieces.setdefault(anchor, set()).add(raw[begin : end + REPEAT - 1])
            self.frequent = np.zeros(len(self.distinct), "i8")
            for anchor, found in pieces.items():
                self.frequent[anchor] = len(found)
            del pieces
            keys: dict[tuple[int, int], set[int]] = {}
            for anchor, raw, begin, end, place in self._runs(np.flatnonzero(self.frequent[self.inverse] > TOLD)):
                for _, key, first, last in _grouped(raw, begin, end, place):
                    keys.setdefault((anchor, key), set()).add(hash(raw[first : last + REPEAT - 1]))
            self.keyed: dict[int, list[tuple[int, int]]] = {}
            for (anchor, key), found in keys.items():
                if len(found) > TOLD:
                    self.keyed.setdefault(anchor, []).append((key, len(found)))
        some = np.flatnonzero(self.frequent[at] > TOLD)
        told = [pair for anchor in at[some].tolist() for pair in self.keyed.get(anchor, [])]
        return np.stack([some, self.frequent[at[some]]], axis=1).astype("<u4").tobytes(), np.array(told, "<u8").tobytes()

    def _marked(self, answers: dict[int, bytes]):  # noqa: ANN202
        """Of each run, whether its anchor has its bit set."""
        import numpy as np

        out = np.zeros(len(self.distinct), bool)
        for bucket, bits in answers.items():
            at = self.by_bucket[bucket]
            out[at] = np.unpackbits(np.frombuffer(bits, "u1"), count=len(at)).astype(bool)
        return out[self.inverse]

    def pieces(self, shared: dict[int, bytes], hot: dict[int, bytes], finer: dict[int, bytes]):  # noqa: ANN201
        """By bucket (places, pieces, ids, parts) of the anchors that are shared, those of hot ones cut by GROUPS, and those of ``finer`` keys to single starts.

        ``places`` are (doc, begin, end, piece), piece being -1 where a smaller document of this block has the same one; a part is a byte of the key's hash.
        """
        import numpy as np
        from xxhash import xxh64_intdigest

        out: dict[int, tuple[list, list, list, list]] = {}
        known: dict[object, tuple[int, int]] = {}

        def put(bucket: int, part: int, key: object, piece: bytes, doc: int, begin: int, end: int) -> None:
            places, pieces, ids, parts = out.setdefault(bucket, ([], [], [], []))
            had = known.get(key)
            if had is None:
                had = known[key] = (len(pieces), doc)
                pieces.append(piece)
                ids.append(self.ids[doc])
                parts.append(part)
            places.append((doc, begin, end, had[0] if self.ids[had[1]] == self.ids[doc] else -1))

        hot_runs = self._marked(hot)
        rows = np.flatnonzero(self._marked(shared) & ~hot_runs)
        bucket_of, part_of = self.bucket[self.inverse[rows]], (self.distinct[self.inverse[rows]] >> np.uint64(32)) & np.uint64(255)
        for doc, begin, end, bucket, part in zip(self.doc[rows].tolist(), self.begins[rows].tolist(), self.ends[rows].tolist(), bucket_of.tolist(), part_of.tolist()):
            piece = self.raws[doc][begin : end + REPEAT - 1]
            put(bucket, part, piece, piece, doc, begin, end)
        rows = np.flatnonzero(hot_runs)
        fine = {key for found in finer.values() for key in np.frombuffer(found, "<u8").tolist()}
        for doc, begin, end, place in zip(self.doc[rows].tolist(), self.begins[rows].tolist(), self.ends[rows].tolist(), self.places[rows].tolist()):
            raw = self.raws[doc]
            for number, key, first, last in _grouped(raw, begin, end, place):
                if key not in fine:
                    piece = raw[first : last + REPEAT - 1]
                    put(key % self.buckets, key >> 56, (number, piece), piece, doc, first, last)
                    continue
                for start in range(first, last):
                    piece = raw[start : start + REPEAT]
                    own = xxh64_intdigest(piece, len(GROUPS))
                    put(own % self.buckets, own >> 56, (len(GROUPS), piece), piece, doc, start, start + 1)
        return out


A = "bucket int, block int, hashes binary, twice binary, many binary, keys binary"
S = "block int, kind int, bucket int, data binary"
G = "bucket int, block int, pieces binary, lengths binary, ids binary, none binary, parts binary"
R = "sha string, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """Every row of ``docs`` as (id, n_bytes, n_removed, n_spans, kept_sha256).

    Null texts are empty, and texts of under REPEAT bytes lose nothing. Null ids are larger than all others and equal to each
    other; texts of one id, repeated rows among them, take nothing from each other. An empty table gives an empty result. Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text")).withColumn("sha", F.sha2("text", 256))
    if blocks is None:
        total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        blocks = max(shuffle_parts(spark), -(-total // block_bytes(total)))
    texts = rows.groupBy("sha", "text").agg(F.min("id").alias("id")).select(F.pmod(F.xxhash64("sha"), F.lit(blocks)).cast("int").alias("block"), "id", "sha", "text")

    def offer(table: pa.Table) -> pa.Table:
        import numpy as np

        b = Block(table, blocks)
        out = [(bucket, b.number, _five(b.distinct[at]), np.packbits(b.twice[at]).tobytes(), *b.many(at)) for bucket, at in b.by_bucket.items()]
        return _table(out, ["bucket", "block", "hashes", "twice", "many", "keys"], [pa.int32(), pa.int32(), *[pa.binary()] * 4])

    def answer(table: pa.Table) -> pa.Table:
        import numpy as np

        hashes = [_unfive(x.as_py()) for x in table["hashes"]]
        sizes = [len(h) for h in hashes]
        alone = ~np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), "u1"), count=n).astype(bool) for x, n in zip(table["twice"], sizes)])
        many = np.ones(len(alone))
        for start, raw in zip(np.cumsum(sizes) - sizes, table["many"].to_pylist()):
            k, n = np.frombuffer(raw, "<u4").reshape(-1, 2).T
            many[start + k] = n
        _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shared = ~alone | (counts[inverse] > 1)
        shared |= np.bincount(inverse, weights=~alone, minlength=len(counts))[inverse] > 0
        hot = shared & (np.bincount(inverse, weights=many, minlength=len(counts))[inverse] > HOT)
        keys, times = np.frombuffer(b"".join(table["keys"].to_pylist()), "<u8").reshape(-1, 2).T
        keys, at = np.unique(keys, return_inverse=True)
        finer = keys[np.bincount(at, weights=times, minlength=len(keys)) > HOT].astype("<u8").tobytes()
        out, at = [], 0
        for block, n in zip(table["block"].to_pylist(), sizes):
            if finer and hot[at : at + n].any():
                out.append((block, 3, table["bucket"][0].as_py(), finer))
            for kind, flags in ((0, shared[at : at + n]), (2, hot[at : at + n])):
                if flags.any():
                    out.append((block, kind, table["bucket"][0].as_py(), np.packbits(flags).tobytes()))
            at += n
        return _table(out, ["block", "kind", "bucket", "data"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    def bits(table: pa.Table, kind: int) -> dict[int, bytes]:
        return {b: d for k, b, d in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["data"].to_pylist()) if k == kind}

    def send(texts_: pa.Table, answers: pa.Table) -> pa.Table:
        import numpy as np

        out = []
        if texts_.num_rows and answers.num_rows:
            b = Block(texts_, blocks)
            for bucket, (_, pieces, ids, parts) in b.pieces(bits(answers, 0), bits(answers, 2), bits(answers, 3)).items():
                none = np.packbits([i is None for i in ids]).tobytes()
                out.append((bucket, b.number, b"".join(pieces), np.array([len(p) for p in pieces], "u1").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), none, bytes(parts)))
        return _table(out, ["bucket", "block", "pieces", "lengths", "ids", "none", "parts"], [pa.int32(), pa.int32(), *[pa.binary()] * 5])

    def sort(table: pa.Table) -> pa.Table:
        import numpy as np

        lengths = [np.frombuffer(x.as_py(), "u1").astype("i8") for x in table["lengths"]]
        each = np.concatenate(lengths)
        ids = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table["ids"]])
        none = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), "u1"), count=len(n)) for x, n in zip(table["none"], lengths)])
        order = np.lexsort((ids, none))  # null ids are larger than all others, and equal to each other
        rank = np.zeros(len(ids), "i8")
        rank[order] = np.cumsum(np.r_[False, (ids[order][1:] != ids[order][:-1]) | (none[order][1:] != none[order][:-1])])
        ids = rank
        part = np.concatenate([np.frombuffer(x.as_py(), "u1") for x in table["parts"]])
        turn = (np.cumsum(np.bincount(part, weights=each, minlength=256)) // SORTED)[part]
        text = b"".join(table["pieces"].to_pylist())
        masks = np.zeros(len(each), "<u4")
        for t in np.unique(turn):
            now = np.flatnonzero(turn == t)
            long = each[now]
            some = text if len(now) == len(each) else np.frombuffer(text, "u1")[np.repeat(turn == t, each)].tobytes()
            least = smallest_owner(some, long, ids[now])
            of = np.repeat(np.arange(len(now)), long)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(long) - long, long)
            hit = np.flatnonzero((least >= 0) & (least < ids[now][of]))
            masks[now] = np.bincount(of[hit], weights=(1 << offset[hit]).astype("f8"), minlength=len(now)).astype("<u4")
        out, at = [], 0
        for block, n in zip(table["block"].to_pylist(), map(len, lengths)):
            out.append((block, 1, table["bucket"][0].as_py(), masks[at : at + n].tobytes()))
            at += n
        return _table(out, ["block", "kind", "bucket", "data"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    def finish(texts_: pa.Table, answers: pa.Table) -> pa.Table:
        import numpy as np

        out = []
        if texts_.num_rows:
            b = Block(texts_, blocks)
            gone: dict[int, list[np.ndarray]] = {}
            masks = bits(answers, 1)
            for bucket, (places, *_) in b.pieces(bits(answers, 0), bits(answers, 2), bits(answers, 3)).items():
                doc, begin, end, piece = np.array(places, "i8").T
                mask = np.where(piece < 0, (1 << 31) - 1, np.frombuffer(masks[bucket], "<u4").astype("i8")[piece])
                long = end - begin
                of = np.repeat(np.arange(len(doc)), long)
                offset = np.arange(len(of)) - np.repeat(np.cumsum(long) - long, long)
                hit = np.flatnonzero(mask[of] >> offset & 1)
                hit_doc, hit_at = doc[of[hit]], (begin[of] + offset)[hit]
                order = np.argsort(hit_doc, kind="stable")
                hit_doc, hit_at = hit_doc[order], hit_at[order]
                cuts = np.flatnonzero(np.r_[True, hit_doc[1:] != hit_doc[:-1]]) if len(hit) else np.zeros(0, "i8")
                for a, z in zip(cuts, [*cuts[1:], len(hit)]):
                    gone.setdefault(int(hit_doc[a]), []).append(hit_at[a:z])
            for i, raw in enumerate(b.raws):
                removed = spans = 0
                kept = raw
                if i in gone:
                    at = np.concatenate(gone[i])
                    edge = np.zeros(len(raw) + 1, "i4")
                    edge[at] += 1  # each start is in one piece
                    edge[at + REPEAT] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    removed = int(covered.sum())
                    spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    kept = np.frombuffer(raw, "u1")[~covered].tobytes()
                out.append((b.shas[i], b.ids[i], len(raw), removed, spans, sha256(kept).hexdigest()))
        return _table(out, ["sha", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])

    by_block = texts.groupBy("block")
    shared = by_block.applyInArrow(offer, A).groupBy("bucket").applyInArrow(answer, S)
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(send, G)
    replies = shared.unionByName(sent.groupBy("bucket").applyInArrow(sort, S))
    each = by_block.cogroup(replies.groupBy("block")).applyInArrow(finish, R)
    copy = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))) & (F.col("n_bytes") >= REPEAT)
    # Joined by the turned digest, for which alone both sides are shuffled, so that a text of very many copies can be split over tasks.
    turned = each.select(F.reverse("sha").alias("_sha"), F.col("id").alias("first"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    joined = rows.select("id", "sha").join(turned, F.reverse("sha") == F.col("_sha"))
    return joined.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
