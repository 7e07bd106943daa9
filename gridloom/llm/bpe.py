"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so one pyahocorasick automaton over the whole vocabulary finds every token that
occurs in a piece in one pass. The encoder walks the piece from the left, always trying the longest token that starts at
its place and shorter ones after it; a token is taken only if it is *compatible* with the one before it, that is if merging the
two tokens' bytes gives back these two tokens. Compatibility is memoised. Where nothing fits, the last token is
given up, and the place is marked as dead, so no place is worked twice and the time is linear. A sequence whose adjacent tokens
are all compatible is the one that the merges by rank give.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import filled, short_batches

#: Pieces, and token pairs, that one worker remembers at most.
MEMO = 400_000


def merged(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """The definition: of all adjacent parts whose union has a rank under ``below``, the lowest-ranked, leftmost union is made, until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] >= below:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Bpe:
    """Encoder and decoder for a rank file (``base64 rank`` a line) and a splitting pattern."""

    def __init__(self, rank_file: str, pattern: str, memo: int = MEMO):
        import ahocorasick
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split, self.memo = regex.compile(pattern).findall, memo
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.lengths = [len(x) for x in self.bytes_of]
        self.said = [str(i) for i in range(len(self.bytes_of))]
        self.tokens = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens.add_word(token.decode("latin-1"), rank)
        self.tokens.make_automaton()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}  # by left << 32 | right
        self.last: dict[int, tuple[int, int] | None] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose union, the last merge, made this one; none for single bytes."""
        known = self.last.get(token, 0)
        if known == 0:
            parts = merged(self.bytes_of[token], self.ranks, token)
            known = self.last[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives back these two: no union across the border comes first.

        Beside the border stand the last half of ``left``, that half's last half and so on, and the first halves of
        ``right``; the later a half was made the longer it stands. Walking back in time, each pair that stood there
        together must not have had a rank lower than the union that ended it. Of equal ranks the leftmost union is made.
        """
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is not None:
            return known
        if len(self.pairs) >= self.memo:
            self.pairs.clear()
        a, b, before, known = left, right, 1 << 60, True
        while True:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60) < before:
                known = False
                break
            x, y = self.halves(a), self.halves(b)
            if x is None and y is None:
                break
            if y is None or (x is not None and a > b):
                before, a = a, x[1]
            else:
                before, b = b + 1, y[0]
        self.pairs[pair] = known
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, lengths = len(piece), self.lengths
        starts: list[list[int]] = [[] for _ in range(n)]  # by end, so shorter tokens come first
        for end, rank in self.tokens.iter(piece.decode("latin-1")):
            starts[end + 1 - lengths[rank]].append(rank)
        dead = bytearray(n + 1)
        out: list[int] = []
        left: list[list[int]] = []  # what is still to be tried where each token of out was taken
        at, untried = 0, starts[0][:]
        while at < n:
            while untried:
                rank = untried.pop()
                if not dead[at + lengths[rank]] and (not out or self.compatible(out[-1], rank)):
                    out.append(rank)
                    left.append(untried)
                    at += lengths[rank]
                    untried = starts[at][:] if at < n else []
                    break
            else:
                if not out:
                    raise ValueError("the ranks lack single bytes of this piece")
                dead[at] = 1
                at -= lengths[out.pop()]
                untried = left.pop()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Token ids of a text, each match of the pattern by itself, without special tokens."""
        pieces, out = self.pieces, []
        get, extend = pieces.get, out.extend
        for piece in self.split(text):
            ids = get(piece)
            if ids is None:
                # Half of the memory is for what was met lately; when it is full it becomes the older half, which is forgotten next.
                if len(pieces) >= self.memo // 2:
                    self.older, self.pieces = pieces, {}
                    pieces = self.pieces
                    get = pieces.get
                ids = self.older.get(piece) or self.encode_piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    pieces[piece] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def _bpe(rank_file: str | None, pattern: str | None) -> Bpe:
    """One for each worker process. Without a file or pattern given, those of this worker's own machine: the driver's paths may not be there."""
    if rank_file is None or pattern is None:
        import public_tokenizers

        rank_file, pattern = rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return Bpe(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with an array of token ids added; a column of that name is replaced. Null texts have no tokens."""
    short_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() != ids_col.lower()]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(rank_file, pattern)
        for batch in batches:
            ids = pa.array([bpe.encode(x or "") for x in batch.column(names.index(text_col)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, ids_col])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)


def decode(docs: DataFrame, rank_file: str | None = None, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the ids added; null ids decode to no bytes."""
    pattern = None
    names = [c for c in docs.columns if c.lower() != bytes_col.lower()]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(rank_file, pattern)
        for batch in batches:
            out = pa.array([bpe.decode(x or []) for x in batch.column(names.index(ids_col)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*names, bytes_col])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)


def encoded_and_checked(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every text and decode the ids: id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256, and token_ids if kept.

    Null and empty texts have no tokens; repeated rows and null ids are carried; an empty table gives an empty result;
    columns other than the two named are not looked at. Both digests are taken where the ids are.
    """
    short_batches(docs.sparkSession)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(rank_file, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha, kept = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids))
                ids_sha.append(sha256(",".join(map(bpe.said.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(sha256(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(array("i", ids))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if keep_ids:
                ends = list(accumulate(counts, initial=0))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(kept))])))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col).alias(id_col), filled(text_col).alias("text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encoded_and_checked`` without the ids themselves, which then don't leave the worker."""
    return encoded_and_checked(docs, rank_file, pattern, id_col, text_col, keep_ids=False)
