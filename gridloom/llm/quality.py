"""Quality classifier by co-training of two views.

One view sees a document's text: hashed words and the bins of its shape (shares of capitals, symbols, digits and so on). The other sees its
metadata: source, language, length. Each is a logistic model. Over some rounds each labels the documents of an unlabelled pool of which
it is sure, and the other learns from these. On labelled rows that neither has learnt from, both views' outputs are
calibrated and combined; the combination scores every document.

Only the fit uses samples, of at most FIT_ROWS labelled and POOL_ROWS unlabelled documents of the table, one row for each id, those with the
smallest hashed ids; every document is scored, over its whole text. Co-training as published draws its unlabelled examples from a small random pool too,
as the views' surest labels of any large pool teach the other view alike; README has figures for several sizes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import filled, short_batches

FIT_ROWS = 12_000
POOL_ROWS = 6_000
ROUNDS = 3
#: A view hands on labels of which it is at least this sure, each round at most SHARE of the pool, and of each label in proportion.
SURE, SHARE = 0.97, 0.2
#: Documents of at least this combined probability stay.
THRESHOLD = 0.5
WORDS, META, BINS = 1 << 20, 1 << 12, 12
#: A feature that fewer fitting rows have than this share (and at least 3 rows) has no weight.
RARE = 0.001
#: Byte classes for a text's shape: lower, upper, digit, space, line end, sentence marks, bars, exclamation, other symbols, non-ASCII.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:'\"?-()", b"|", b"!")
SHAPE = 14


def _byte_class():  # noqa: ANN202
    import numpy as np

    table = np.full(256, len(_CLASSES), "u1")
    for i, chars in enumerate(_CLASSES):
        table[list(chars)] = i
    table[128:] = len(_CLASSES) + 1
    return table


def text_features(text: str, table):  # noqa: ANN001, ANN201
    """(indices of the distinct words, shape) of a text."""
    import numpy as np

    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    distinct = set(words)
    n = max(1, len(words))
    shares = np.bincount(table[np.frombuffer(raw, "u1")], minlength=10)[:10] / max(1, len(raw))
    repeats = sum(map(eq, words, words[1:])) / n
    shape = [*shares, len(distinct) / n, repeats, math.log1p(len(words)), len(raw) / n]
    return np.fromiter(map(crc32, distinct), "u4", len(distinct)) & (WORDS - 1), np.array(shape, "f4")


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    size = "none" if n_chars is None else str(int(2 * math.log2(1 + max(0, n_chars))))
    return [crc32(x.encode()) & (META - 1) for x in (f"s={source}", f"l={lang}", f"n={size}", f"l={lang}&n={size}", f"s={source}&l={lang}")]


@dataclass
class View:
    """A logistic model over index lists."""

    weights: object
    bias: float

    def logit(self, ids) -> float:  # noqa: ANN001
        return float(self.weights[ids].sum()) + self.bias


def fit(rows: list, labels, size: int, sample_weight=None, rounds: int = 150, prior: float = 6.0, rate: float = 0.05) -> View:  # noqa: ANN001
    """Logistic regression by Adam on full batches, its steps shrinking to nothing; ``rows`` are arrays of places whose value is 1, each place once.

    The weights' penalty counts as ``prior`` against all rows, so it matters less the more there are.
    """
    import numpy as np

    l2 = prior / max(1, len(rows))

    full, counts = size, np.bincount(np.concatenate(rows), minlength=size)
    kept = np.flatnonzero(counts >= max(3, int(RARE * len(rows))))
    to = np.full(size, -1, "i4")
    to[kept] = np.arange(len(kept))
    rows = [x[x >= 0] for x in (to[r] for r in rows)]
    size = len(kept)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(rows), dtype="i4"), lengths)
    del rows
    y = np.asarray(labels, "f8")
    sw = np.ones(len(y)) if sample_weight is None else np.asarray(sample_weight, "f8")
    sw = sw / sw.sum()
    base = float(np.clip((sw * y).sum(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(size), math.log(base / (1 - base))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = np.add.reduceat(np.append(w[flat], 0.0), starts) * (lengths > 0) + b  # a row without places gets the next one's, times 0
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * sw
        g, gb = np.bincount(flat, weights=e[of], minlength=size) + l2 * w, e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * (1 - (k - 1) / rounds) * math.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (math.sqrt(vb) + 1e-8)
    weights = np.zeros(full, "f4")
    weights[kept] = w
    return View(weights, float(b))


def _platt(z, y, rounds: int = 60):  # noqa: ANN001, ANN202
    """Weights of a small logistic model over the columns of z and a constant, by Newton steps with a light ridge."""
    import numpy as np

    x = np.c_[z, np.ones(len(z))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    text: View
    meta: View
    edges: object
    mix: object

    def text_ids(self, words, shape):  # noqa: ANN001, ANN201
        """Word places, then one place per shape bin."""
        import numpy as np

        bins = [WORDS + k * BINS + int(np.searchsorted(self.edges[k], shape[k])) for k in range(SHAPE)]
        return np.r_[words.astype("i4"), np.array(bins, "i4")]

    def score(self, words, shape, meta: list[int]) -> tuple[float, float, float]:  # noqa: ANN001
        """Combined, text and metadata probability of fitness."""
        t, m = self.text.logit(self.text_ids(words, shape)), self.meta.logit(meta)
        z = float(self.mix[0] * t + self.mix[1] * m + self.mix[2])
        return tuple(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in (z, t, m))


def co_train(texts: list, metas: list, labels, rounds: int = ROUNDS) -> Model | None:  # noqa: ANN001
    """``texts`` are (words, shape), ``labels`` 1, 0 or -1 for the unlabelled pool. None if one of the labels is missing."""
    import numpy as np

    y = np.asarray(labels)
    known, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    if len(np.unique(y[known])) < 2:
        return None
    held, learn = known[::4], np.setdiff1d(known, known[::4])
    if len(np.unique(y[held])) < 2 or len(np.unique(y[learn])) < 2:
        held = learn = known
    shapes = np.array([s for _, s in texts])
    edges = [np.unique(np.quantile(shapes[:, k], np.arange(1, BINS) / BINS)) for k in range(SHAPE)]
    model = Model(None, None, edges, None)  # type: ignore[arg-type]
    xt = [model.text_ids(*x) for x in texts]
    xm = [np.array(m) for m in metas]
    given: dict[str, dict[int, int]] = {"text": {}, "meta": {}}

    def learn_view(name: str, x: list, size: int) -> View:
        extra = list(given[name])
        at = [*learn, *extra]
        return fit([x[i] for i in at], [*y[learn], *given[name].values()], size, [1.0] * len(learn) + [0.5] * len(extra))

    for _ in range(rounds + 1):
        model.text, model.meta = learn_view("text", xt, WORDS + SHAPE * BINS), learn_view("meta", xm, META)
        if _ == rounds or not len(pool):
            break
        for view, x, other in ((model.text, xt, "meta"), (model.meta, xm, "text")):
            z = np.array([view.logit(x[i]) for i in pool])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            rate = y[learn].mean()
            for label, sure, share in ((1, p, rate), (0, 1 - p, 1 - rate)):
                best = np.argsort(-sure, kind="stable")[: max(1, int(SHARE * share * len(pool)))]
                given[other] |= {int(pool[i]): label for i in best if sure[i] >= SURE}
    z = np.array([[model.text.logit(xt[i]), model.meta.logit(xm[i])] for i in held])
    model.mix = _platt(z, y[held].astype("f8"))
    return model


FEATURED = "id string, label int, words binary, shape binary, meta array<int>"


def _featured(rows: DataFrame) -> DataFrame:
    """From (id, label, text, source, lang, n): the features of labelled and pool rows, to be fitted on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_class()
        for batch in batches:
            words, shapes, metas = [], [], []
            for t, s, lg, n in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)]):
                w, shape = text_features(t, table)
                words.append(w.tobytes())
                shapes.append(shape.tobytes())
                metas.append(meta_features(s, lg, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary()), pa.array(shapes, pa.binary()), pa.array(metas, pa.list_(pa.int32()))], names=["id", "label", "words", "shape", "meta"])

    return rows.mapInArrow(run, FEATURED)


def _meta_columns(docs: DataFrame) -> tuple[Column, Column, Column]:
    """Source, language and length, null where the table lacks the column or the length is no number."""
    at = {c.lower(): c for c in docs.columns}
    pick = lambda name, kind: (F.col(f"`{at[name]}`").try_cast(kind) if name in at else F.lit(None).cast(kind)).alias(f"_{name}")
    return pick("source", "string"), pick("lang", "string"), pick("n_chars", "long")


def chosen_ids(docs: DataFrame, labels: DataFrame, id_col: str, fit_rows: int, pool_rows: int) -> DataFrame:
    """(_id, _label) of the rows to fit on: distinct ids of ``docs`` alone, at most ``fit_rows`` labelled ones and ``pool_rows`` others, whose label is -1."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(good) >= 0.5).cast("int").alias("_label"))
    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    ids = ids.join(known, "_id", "left").select("_id", F.coalesce("_label", F.lit(-1)).alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    return ids.where("_label >= 0").orderBy(*order).limit(fit_rows).unionByName(ids.where("_label < 0").orderBy(*order).limit(pool_rows))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS) -> Model | None:
    """Fit on labelled documents; a document is fit if its quality is 1 and it isn't toxic. Of conflicting labels of an id the majority counts.

    Labels of ids that ``docs`` lacks, null ids and null qualities teach nothing and take no places of the sample. Of rows that repeat an id one is
    fitted on, that with the smallest hash. Without labelled rows of both kinds there is no model.
    """
    short_batches(docs.sparkSession)
    chosen = chosen_ids(docs, labels, id_col, fit_rows, pool_rows)
    rows = docs.select(F.col(id_col).alias("_id"), filled(text_col).alias("text"), *_meta_columns(docs)).join(F.broadcast(chosen), "_id")  # fit_rows + pool_rows rows of 12 bytes at most
    rows = rows.select("_id", "_label", F.struct(F.xxhash64("text", "_source", "_lang", "_n_chars").alias("h"), "text", "_source", "_lang", "_n_chars").alias("row"))
    rows = rows.groupBy("_id", "_label").agg(F.min("row").alias("row")).select(F.col("_id").cast("string").alias("id"), F.col("_label").alias("label"), "row.text", "row._source", "row._lang", "row._n_chars")
    # At most fit_rows + pool_rows rows are fitted on, in a task of their own: the driver gets the model alone.
    found = _featured(rows).repartition(1).mapInArrow(_fitted, "model binary").toArrow()
    return pickle.loads(found.column(0)[0].as_py()) if found.num_rows else None


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all featured rows, pickled; nothing if there is none."""
    import numpy as np

    rows = []
    for batch in batches:
        rows.extend(zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4, 1)]))
    rows.sort(key=lambda r: r[:2])
    texts = [(np.frombuffer(r[1], "u4"), np.frombuffer(r[2], "f4")) for r in rows]
    model = co_train(texts, [r[3] for r in rows], [r[4] for r in rows]) if rows else None
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as (id, score, text_score, meta_score, kept).

    Without a model (no labels, or all the same) every score is null and every document stays. Null texts are empty; null
    metadata is a value of its own; repeated rows score the same; null ids are carried; columns not named are not looked at.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(c, T.DoubleType()) for c in ("score", "text_score", "meta_score")], T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_class()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                if model is None:
                    out.append((None, None, None, True))
                    continue
                text, source, lang, n = (batch.column(k)[i].as_py() for k in (1, 2, 3, 4))
                s = model.score(*text_features(text, table), meta_features(source, lang, n))
                out.append((*s, s[0] >= threshold))
            cols = [pa.array([x[k] for x in out], pa.float64() if k < 3 else pa.bool_()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=schema.names)

    return docs.select(F.col(id_col).alias(id_col), filled(text_col).alias("text"), *_meta_columns(docs)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)


def drop_unfit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns unchanged.

    Each row is scored by itself, so rows that repeat an id or a text each stay or go by their own content; null ids and texts, metadata of other types and
    further columns are dealt with as ``score`` does. Without a model every row stays.
    """
    model = train(docs, labels, id_col, text_col)
    if model is None:
        return docs
    names, at = docs.columns, [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_class()
        for batch in batches:
            n = len(names)
            rows = zip(batch.column(at), *[batch.column(k).to_pylist() for k in (n, n + 1, n + 2)])
            keep = [model.score(*text_features(t.as_py() or "", table), meta_features(s, lg, size))[0] >= threshold for t, s, lg, size in rows]
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=names).filter(pa.array(keep, pa.bool_()))

    return docs.select(*[F.col(f"`{c}`") for c in names], *_meta_columns(docs)).mapInArrow(run, docs.schema)
