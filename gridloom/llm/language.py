"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text are added as log probabilities:

* the *text*: byte trigrams under a model for each language, tempered, as neighbouring trigrams aren't independent;
* the *declared* language of the markup (``<html lang>``), weighed by how often such declarations agree with the text;
* the *address*: a language code in the path, a subdomain or a country ending, weighed alike;
* the *host*: how the other texts of the host are distributed, smoothed towards the host's domain, and that towards the whole corpus.

The weights of declarations and addresses, and the host and domain priors, are grouped aggregations over all rows; a row's own part in
them is taken out again before they speak about it. Only
the trigram model is fitted on a sample, of about FIT_ROWS labelled texts: of every language those with the smallest hashed ids, up to a number that is the same for all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, filled, short_batches

FIT_ROWS = 8_000
GRAMS = 1 << 16
#: Share of the trigrams' summed log likelihood that counts, and the trigrams at which a text's evidence stops growing.
TEMPER, ENOUGH = 0.25, 400
#: Rows that the level above counts as, for hosts towards domains, domains towards the corpus, and for evidence that was hardly seen.
STRENGTH = 8.0
#: How often declarations and addresses are taken to be right before any are seen.
AGREE = 0.9

#: Hosts under a country's second level, as of co.uk, whose domains have three labels.
REGISTRY = r"\.(?:co|com|org|net|ac|gov|edu|or|ne|go)\.[a-z]{2}$"

_NO_TEXT = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")


def grams(raw: bytes):  # noqa: ANN201
    """Hashed byte trigrams of a text between two spaces, A-Z in lower case, runs of all that is no letter as one space."""
    import numpy as np

    table = _letters()
    b = table[np.frombuffer(b" " + raw + b" ", "u1")]
    b = b[(b != 32) | np.r_[True, b[:-1] != 32]].astype("u4")
    return (b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) >> 16 if len(b) > 2 else np.zeros(0, "u4")


def _letters():  # noqa: ANN202
    import numpy as np

    table = np.full(256, 32, "u1")
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def _plain(text: str, markup: bool) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return _NO_TEXT.sub(b" ", raw) if markup else raw


@dataclass
class TextModel:
    languages: list[str]
    table: object  # GRAMS x languages, log probabilities

    def loglik(self, raw: bytes) -> list[float]:
        """Tempered log likelihood for each language."""
        codes = grams(raw)
        if not len(codes):
            return [0.0] * len(self.languages)
        total = self.table[codes].sum(axis=0, dtype="f8")
        return (total * (TEMPER * min(1.0, ENOUGH / len(codes)))).tolist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS) -> TextModel | None:
    """The trigram model of the labelled rows; None if there are none.

    ``fit_rows`` bounds the rows that are learnt from, dealt over all languages by distinct ids: rows that repeat an id and a label are one, the one whose text sorts first.
    Rows without an id aren't learnt from.
    """
    import numpy as np

    labelled = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    labelled = labelled.select(F.lower(label_col).alias("_label"), F.col(id_col).alias("_id"), filled(text_col).alias("_text"))
    known = labelled.select("_label", "_id").distinct()
    of = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    counts = sorted(of.values())
    most, left = 1, fit_rows
    for k, n in enumerate(counts):  # the languages with few rows leave their places to the others
        most = max(most, min(n, left // (len(counts) - k)))
        left -= min(n, most)
    if of:  # no task is to sort all rows of a language: over twice the rows wanted are left, by hash
        share = F.create_map(*[x for label, n in of.items() for x in (F.lit(label), F.lit(min(1.0, (2 * most + 50) / n)))])
        thinned = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < share[F.col("_label")] * F.lit(float(1 << 40)))
    else:
        thinned = known
    order = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), F.col("_id"))
    ids = thinned.select("_label", "_id", F.row_number().over(order).alias("_nth")).where(F.col("_nth") <= most).select("_label", "_id")
    sample = labelled.join(F.broadcast(ids), ["_label", "_id"]).groupBy("_label", "_id").agg(F.min("_text").alias("text")).select(F.col("_label").alias("label"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, object] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.bincount(grams(_plain(text, False)), minlength=GRAMS)
                sums[label] = sums[label] + c if label in sums else c
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([c.astype("<i8").tobytes() for c in sums.values()], pa.binary())], names=["label", "counts"])

    totals: dict[str, object] = {}
    for label, counts in sample.coalesce(4).mapInArrow(count, "label string, counts binary").toLocalIterator():
        c = np.frombuffer(counts, "<i8")
        totals[label] = totals[label] + c if label in totals else c
    if not totals:
        return None
    languages = sorted(totals)
    table = np.stack([np.log((totals[x] + 0.5) / (totals[x].sum() + 0.5 * GRAMS)) for x in languages], axis=1).astype("f4")
    return TextModel(languages, table)


def evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """From (id, kind, text, markup, url, host): the likelihoods, and the codes that markup and address declare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lik = [model.loglik(_plain(t.as_py(), m.as_py())) for t, m in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 4, 5, 6, 7)], pa.array(lik, pa.list_(pa.float64()))], names=["id", "kind", "declared", "address", "host", "domain", "lik"])

    known = F.array(*[F.lit(x) for x in model.languages])
    only = lambda c: F.when(F.array_contains(known, c), c)
    declared = F.lower(F.regexp_extract("text", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    sub, path, end = (F.lower(F.regexp_extract("url", p, 1)) for p in (r"^\w+://([A-Za-z]{2,3})\.", r"^\w+://[^/]+/([A-Za-z]{2,3})(?:[-_][A-Za-z]+)?(?:/|$)", r"^\w+://[^/:?#]*\.([A-Za-z]{2,3})(?:[:/?#]|$)"))
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"^\w+://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")), F.col("host"), F.lit("")))
    rows = rows.select("id", "kind", "text", "markup", F.when(F.col("markup"), only(declared)).alias("declared"), F.coalesce(only(path), only(sub), only(end)).alias("address"), host.alias("host"))
    rows = rows.withColumn("domain", F.when(F.regexp_like("host", F.lit(REGISTRY)), F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2)))
    return rows.mapInArrow(run, "id long, kind string, declared string, address string, host string, domain string, lik array<double>")


def _posterior(logs: Column) -> Column:
    """Normalised probabilities of an array of log weights."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(n: int) -> Column:
    """For each language the sum of the rows' posteriors, as an array."""
    return F.array(*[F.sum(F.get("own", F.lit(k))) for k in range(n)])


def _smoothed(counts: Column, above: Column) -> Column:
    """Shares of the counts without this row's own, smoothed towards the shares above."""
    others = F.zip_with(counts, F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    total = F.aggregate(others, F.lit(0.0), lambda a, b: a + b) + STRENGTH
    return F.zip_with(others, above, lambda a, b: (a + STRENGTH * b) / total)


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """Every row of (id, kind, text, markup, url, host) as (id, kind, lang, probability, text_lang, declared, address).

    Null or empty texts leave the decision to the other evidence and the priors; nulls of address, host or id are carried; ties go to the language
    that sorts first. Hosts are compared in lower case; no host is a host of its own.
    """
    n = len(model.languages)
    seen = cut(evidence(rows, model).select("*", _posterior(F.col("lik")).alias("own")))
    corpus = seen.agg(_sums(n)).first()[0]
    everywhere = [((x or 0.0) + 1.0) / (sum(y or 0.0 for y in corpus) + n) for x in corpus]
    domains = seen.groupBy("domain").agg(_sums(n).alias("in_domain"))
    # Joined by host, of which the other side has one row, so that a host of very many rows can be split over tasks.
    hosts = seen.groupBy("host", "domain").agg(_sums(n).alias("in_host")).join(domains, "domain").select(F.reverse("host").alias("_host"), "in_host", "in_domain")

    def weighed(column: str) -> Column:
        """log P(code | language) by all other rows that have such a code: an array over languages; zeros where the row has none."""
        met = {r[0]: list(r[1]) for r in seen.where(F.col(column).isNotNull()).groupBy(column).agg(_sums(n)).collect()}
        per = [sum(row[k] or 0.0 for row in met.values()) for k in range(n)]
        first = lambda code, k: AGREE if code == model.languages[k] else (1 - AGREE) / max(1, n - 1)
        numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
        by_code = lambda made: F.create_map(*[x for code in model.languages for x in (F.lit(code), numbers(made(code)))])[F.col(column)]
        agreed = by_code(lambda code: [(met[code][k] or 0.0) if code in met else 0.0 for k in range(n)])
        taken = by_code(lambda code: [STRENGTH * first(code, k) for k in range(n)])
        less = lambda a: F.zip_with(a, F.col("own"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
        above = F.zip_with(less(agreed), taken, lambda a, b: a + b)
        return F.when(F.col(column).isNotNull(), F.zip_with(above, less(numbers(per)), lambda a, b: F.log(a / (b + STRENGTH)))).otherwise(F.array_repeat(F.lit(0.0), n))

    prior = _smoothed(F.col("in_host"), _smoothed(F.col("in_domain"), F.array(*[F.lit(x) for x in everywhere])))
    joined = seen.join(hosts, F.reverse("host") == F.col("_host")).select("*", prior.alias("prior"), weighed("declared").alias("said"), weighed("address").alias("at"))
    total = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get("lik", k) + F.get("said", k) + F.get("at", k) + F.log(F.get("prior", k)))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    fused = joined.withColumn("p", _posterior(total))
    return fused.select("id", "kind", best(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), F.when(F.array_max("own") > F.array_min("own"), best(F.col("own"))).alias("text_lang"), "declared", "address")


def page_rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("id"), F.lit("page").alias("kind"), filled("html").alias("text"), F.lit(True).alias("markup"), F.col("url").alias("url"), F.lit(None).cast("string").alias("host"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents have no markup or address; their source is their host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.lit("document").alias("kind"), filled("text").alias("text"), F.lit(False).alias("markup"), F.lit(None).cast("string").alias("url"), F.col("source").cast("string").alias("host"))


def language_id(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and pages, one row each: doc_id (null for pages), page_id (null for documents), lang, probability, text_lang, declared, address.

    Ids are numbers; others stop the job. Rows that repeat an id are rows of their own, each with its answer.
    Without any labelled document there is no language to tell: every ``lang`` is null.
    """
    short_batches(docs.sparkSession)
    rows = document_rows(docs).unionByName(page_rows(pages))
    model = train(docs)
    if model is None:
        none = F.lit(None).cast("string")
        found = rows.select("id", "kind", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("address"))
    else:
        found = identify(rows, model)
    one = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select(one("document").alias("doc_id"), one("page").alias("page_id"), "lang", "probability", "text_lang", "declared", "address")
