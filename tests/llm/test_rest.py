"""Quality, archives, tokens and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, quality, warc
from gridloom.llm.queries import ORACLES, QUERIES


def test_quality_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    held = labels.where("doc_id % 4 = 0")
    got = quality.score(docs, model).join(held, "doc_id")
    clean, junk = got.where("quality = 1 and toxic = 0"), got.where("quality = 0")
    assert clean.where("kept").count() > 0.95 * clean.count() and junk.where("kept").count() < 0.1 * junk.count()
    ranks = sorted((r.score, r.quality * (1 - r.toxic)) for r in got.collect())
    good = sum(y for _, y in ranks)
    auc = (sum(i + 1 for i, (_, y) in enumerate(ranks) if y) - good * (good + 1) / 2) / (good * (len(ranks) - good))
    assert auc > 0.85


def test_views_teach_each_other():
    rng = random.Random(2)
    table = quality._byte_class()
    texts, metas, labels = [], [], []
    for k in range(900):
        good = k % 2
        words = [rng.choice("alpha beta gamma delta" .split() if good else "junk spam zap bam".split()) for _ in range(20)]
        texts.append(quality.text_features(" ".join(words), table))
        metas.append(quality.meta_features("good" if good else "bad", "en", 100))
        labels.append(good if k < 60 else -1)
    model = quality.co_train(texts, metas, labels)
    for good, words in ((1, "alpha gamma"), (0, "spam bam")):
        w, s = quality.text_features(" ".join(words.split() * 10), table)
        z, t, m = model.score(w, s, quality.meta_features("good" if good else "bad", "en", 100))
        assert (z > 0.5) == (t > 0.5) == (m > 0.5) == bool(good)
    assert quality.co_train(texts, metas, [1] * 900) is None


def test_the_fit_is_not_the_drivers(spark, monkeypatch):
    """A task fits the model; the driver holds no features."""
    docs = spark.createDataFrame([(i, "fine words " * 9 if i % 2 else "!! ## " * 9, "src", "en", 90) for i in range(80)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "co_train", None)
    model = quality.train(docs, labels)
    assert all(r.kept == bool(r.doc_id % 2) for r in quality.score(docs, model).collect())
    assert quality.train(docs, labels.where("quality = 1")) is None and quality.train(docs, labels.limit(0)) is None


def test_quality_of_odd_rows(spark):
    rows = [(i, ("fine words in a row " * 9 if i % 2 else "!!! ### $$$ " * 9), "src", "en", 90) for i in range(200)] + [(500, None, None, None, None), (501, "", "src", "en", 0), (None, "fine words", "src", "en", 10), (7, "x " * 100_000, "src", "en", -5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 150)] + [(3, 0, 0), (3, 1, None), (3, 1, 0), (None, 1, 0), (8, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.kept == bool(r.doc_id % 2) for r in got if r.doc_id is not None and 150 <= r.doc_id < 200)
    kept = quality.drop_unfit(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert all(r.kept and r.score is None for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs.drop("source", "lang", "n_chars").withColumn("score", docs["doc_id"]), labels).count() == len(rows)


PAGES = [
    (1, "http://a/1", "<p>é</p>", "r"),
    (4, "http://a/4", "<p>é</p>", "r"),
    (4, "http://a/4", "<p>é</p>", "r"),
    (2, None, "", None),
    (3, "http://a/3\r\nX: y", None, None),
    (None, "u", "<p>é</p>", "r"),
    (None, "u", "alone", "r"),
    (5, "u", "WARC-Type: revisit\r\n\r\nWARC-Refers-To: <urn:x-page:9>\r\n", "r"),
    (6, "u", "long " * 100_000, "r"),
]


def warc_brute(rows, least=0):
    out = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        ids = [j for j, _, h, _ in rows if (h or "") == (html or "") and j is not None]
        top = max(ids, default=None)
        first = i == top or len(body) < least
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 9])
def test_warc(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3)
    assert sorted(map(tuple, warc.warc_round_trip(pages, min_bytes=least).collect()), key=repr) == warc_brute(PAGES, least)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_records_are_whole(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")
    warc.write_archive(pages, str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w/payloads"))
    assert stored.count() == len({h or "" for _, _, h, _ in PAGES})
    for r in warc.read_archive(spark, str(tmp_path / "w")).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n") and len(block) - 4 == int(fields["Content-Length"])
        assert block[:-4].partition(b"\r\n\r\n")[2] == (bytes(r.payload) if fields["WARC-Type"] == "response" else b"")
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files(spark, tmp_path, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archive(pages, str(tmp_path / "w"))
    records = warc.read_archive(spark, str(tmp_path / "w"))
    warc.write_files(records, str(tmp_path / "f"), compression)
    back = warc.read_files(spark, str(tmp_path / "f"))
    plain = lambda df: sorted((r.id, r.header, bytes(r.record)) for r in df.collect() if r.id is not None)
    assert plain(back) == plain(records) and back.count() == records.count() == len(PAGES)
    bodies = {r.id: bytes(r.payload) for r in back.collect() if "WARC-Type: response" in r.header and r.id is not None}
    html = {i: (h or "").encode() for i, _, h, _ in PAGES}
    assert len(bodies) == 4 and all(bodies[i] == html[i] for i in bodies)


def test_damaged_payloads_stop_the_job(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string, digest string")
    warc.write_archive(pages, str(tmp_path / "w"))
    spark.read.parquet(str(tmp_path / "w/payloads")).selectExpr("digest", "cast('other' as binary) as payload", "first_id").write.parquet(str(tmp_path / "v/payloads"))
    spark.read.parquet(str(tmp_path / "w/headers")).write.parquet(str(tmp_path / "v/headers"))
    with pytest.raises(Exception, match="payload differs"):
        warc.read_archive(spark, str(tmp_path / "v")).collect()


def test_warc_sql(spark, sf_dir, duck, collected):
    assert collected(QUERIES["op7_warc"](spark, sf_dir)) == duck(ORACLES["op7_warc"])


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as p
    import tiktoken

    own = bpe.Bpe(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def hard_texts():
    rng = random.Random(1)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "éàñß   ", "0123456789", "  \n\t", "ab", "THEthe ", "日本語🙂𝔘", "%$#*!", "Kİ́"]
    out = ["".join(rng.choice(a) for _ in range(rng.randint(0, 120))) for _ in range(1500) for a in [rng.choice(alphabets) + rng.choice(alphabets)]]
    return out + ["", " ", "\x00", "<|endoftext|>", "a" * 100_000, " " * 50_000, "the" * 20_000, "".join(rng.choice("etaoinshrdlu") for _ in range(50_000))]


def test_tokens_equal_tiktoken(codec):
    own, theirs = codec
    for text in hard_texts():
        ids = own.encode(text)
        assert ids == theirs.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_compatibility_is_what_merging_says(codec):
    own, _ = codec
    rng = random.Random(3)
    pairs = [(rng.randrange(50_256), rng.randrange(50_256)) for _ in range(3000)] + [(p >> 32, p & 0xFFFFFFFF) for p in list(own.pairs)[:3000]]
    for a, b in pairs:
        x, y = own.bytes_of[a], own.bytes_of[b]
        assert own.compatible(a, b) == (bpe.merged(x + y, own.ranks) == [x, y])


def test_memory_bound_does_not_show(codec):
    import public_tokenizers as p

    tight = bpe.Bpe(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN, memo=5)
    for text in hard_texts()[:100]:
        assert tight.encode(text) == codec[0].encode(text)
        assert len(tight.pieces) <= 5 and len(tight.pairs) <= 5


def test_round_trip_rows(spark, codec):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", None), (2, None, "x"), (3, "", "x"), (None, "naïve\n", "x"), (4, "word " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(2)
    got = sorted(map(tuple, bpe.round_trip(df).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = codec[1].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    coded = bpe.encode(df.withColumn("TOKEN_IDS", df["doc_id"]))
    back = bpe.decode(coded).collect()
    assert coded.columns == ["doc_id", "text", "n_tokens", "token_ids"] and all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.round_trip(df.limit(0)).count() == bpe.encode(df.limit(0)).count() == 0
    kept = bpe.encoded_and_checked(df).collect()
    assert all(list(r.token_ids) == codec[1].encode_ordinary(next(t or "" for i, t, _ in rows if i == r.doc_id)) for r in kept)


def numpy_scores(docs, model):
    """For each document the combined score, by the logistic models' sums."""
    table, out = quality._byte_class(), {}
    for r in docs:
        words, shape = quality.text_features(r.text or "", table)
        bins = [quality.WORDS + k * quality.BINS + sum(e < shape[k] for e in model.edges[k]) for k in range(quality.SHAPE)]
        t = sum(float(model.text.weights[i]) for i in [*words, *bins]) + model.text.bias
        m = sum(float(model.meta.weights[i]) for i in quality.meta_features(r.source, r.lang, r.n_chars)) + model.meta.bias
        sure = lambda z: 1 / (1 + np.exp(-z))
        out[r.doc_id] = (sure(model.mix[0] * t + model.mix[1] * m + model.mix[2]), sure(t), sure(m))
    return out


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def without_copies(docs):
    last = {}
    for r in docs:
        key = ascii_lower(r.text)
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    return [r for r in docs if last[ascii_lower(r.text)] == r.doc_id]


def without_near_copies(docs):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)]) for r in docs for w in [(r.text or "").encode().lower().split()]]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for r, c in zip(docs, root):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    return [r for r, c in zip(docs, root) if least[c] == r.doc_id]


def without_leaks(docs, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in docs])
    leaks = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op10_decontaminate']})").fetchall()}
    return [r for r in docs if r.doc_id not in leaks]


def test_pipeline(spark, sf_dir, codec):
    """Stage by stage against versions of their own: sums in NumPy, a dictionary, all pairs, DuckDB, tiktoken."""
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = numpy_scores(docs.collect(), quality.train(docs, labels))
    versions = [lambda rows: [r for r in rows if scores[r.doc_id][0] >= 0.5], without_copies, without_near_copies, lambda rows: without_leaks(rows, sf_dir)]
    assert [n for n, _ in pipe.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    rows = docs.collect()
    for (_, stage), version in zip(pipe.STAGES, versions):
        out = stage(spark, spark.createDataFrame(rows, docs.schema), sf_dir)
        want = version(rows)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, want)) and 0 < len(want) < len(rows)
        rows = want
    got = pipe.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, list(r.token_ids)) for r in got) == sorted((r.doc_id, codec[1].encode_ordinary(r.text or "")) for r in rows)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows and ids, an empty table, and columns whose names the stages use themselves."""
    import corpus_pipeline as pipe

    passage = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(i, f"plain words number {i} stand in this row of words " * 3) for i in range(30)]
    rows += [(30, passage), (31, None), (32, ""), (None, None), (None, "no id but words"), (None, "NO id but words"), (33, "long " * 60_000), (34, "twice"), (34, "twice"), (34, "other"), (35, "plain words number 3 stand in this row of words " * 3 + "more")]
    clash = ["_id", "_label", "_sha", "_keep", "_key", "th", "_th", "_gone", "node", "root", "label", "doc", "words", "token_ids", "n"]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or ""), *[7] * len(clash)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 0, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, passage), (None, None)], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        table.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        out, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
        for _, stage in pipe.STAGES[:-1]:
            out = spark.createDataFrame(stage(spark, out, str(tmp_path)).collect(), docs.schema)
            assert out.columns == docs.columns
            kept.append(out.count())
        if table is docs:
            # all labels are of one kind, so all stay; copies: "", null ids' two texts and the repeated row go; then the near copy; then the passage
            assert kept == [len(rows), len(rows) - 4, len(rows) - 5, len(rows) - 6], kept
        assert pipe.run(spark, str(tmp_path)).count() == kept[-1]


def test_labels_of_other_tables_take_no_places(spark):
    rows = [(i, ("fine words in a row " * 9 if i % 2 else "!!! ### $$$ " * 9), "src", "en", "90 chars") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars string")
    own = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    foreign = spark.range(1000, 201_000).selectExpr("id as doc_id", "int(id % 2) as quality", "0 as toxic")
    kept = {r.doc_id for r in quality.drop_unfit(docs, own).collect()}
    assert len(kept) == 30 and kept == {r.doc_id for r in quality.drop_unfit(docs, own.union(foreign)).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, own.union(foreign)).collect() if r.kept}


def test_an_id_repeated_is_one_row_of_the_sample(spark, monkeypatch):
    rows = [(7, f"words {i} " * 5, "s", "en", 1) for i in range(10_000)] + [(i, "fine words " * (1 + i % 2), "s", "en", 9) for i in range(100, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 110)], "doc_id long, quality int, toxic int")
    assert quality.chosen_ids(docs, labels, "doc_id", 12, 6).count() == 10 + 6
    seen = []
    monkeypatch.setattr(quality, "co_train", lambda texts, metas, labels: seen.append((len(texts), len(labels))))
    quality.train(docs, labels)
    assert seen == [(21, 21)]
    assert [r.n for r in quality.chosen_ids(docs, labels, "doc_id", 5, 3).groupBy((F.col("_label") >= 0).alias("l")).agg(F.count("*").alias("n")).orderBy("l").collect()] == [3, 5]


def test_scores_are_the_models_own(spark, sf_dir):
    """Scores by brute force: the logistic models' sums in NumPy, row by row."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    want = numpy_scores(docs.collect(), model)
    for r in quality.score(docs, model).collect():
        assert np.allclose((r.score, r.text_score, r.meta_score), want[r.doc_id], atol=1e-4) and r.kept == (r.score >= 0.5)
