"""Languages of few labelled rows."""

from __future__ import annotations

import re

import numpy as np

from gridloom.llm import language


def test_every_labelled_language_is_known(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(400)] + [(1000, "der hund und die katze", "DE"), (1001, "le chat et le chien", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train(docs, fit_rows=10).languages == language.train(docs, fit_rows=1).languages == ["de", "en", "fr"]
    assert language.train(docs.limit(0)) is None


def fused_brute(rows, model):
    """The fusion row by row in NumPy: (id, lang, probability, text_lang, declared, address)."""
    n, known = len(model.languages), set(model.languages)
    found = []
    for i, kind, text, markup, url, host in rows:
        lik = np.array(model.loglik(language._plain(text or "", markup)))
        own = np.exp(lik - lik.max()) / np.exp(lik - lik.max()).sum()
        code = lambda p, x: (m[1].lower() if (m := re.search(p, x or "")) else "")
        declared = code(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", text) if markup else ""
        codes = [code(p, url) for p in (r"^\w+://[^/]+/([A-Za-z]{2,3})(?:[-_][A-Za-z]+)?(?:/|$)", r"^\w+://([A-Za-z]{2,3})\.", r"^\w+://[^/:?#]*\.([A-Za-z]{2,3})(?:[:/?#]|$)")]
        address = next((c for c in codes if c in known), None)
        host = (code(r"^\w+://(?:[^/@]*@)?([^/:?#]+)", url) or host or "").lower()
        domain = ".".join(host.split(".")[-(3 if re.search(language.REGISTRY, host) else 2) :])
        found.append((i, lik, own, declared if declared in known else None, address, host, domain))
    add = lambda k, of: sum((f[2] for f in found if f[k] == of), np.zeros(n))
    corpus = sum(f[2] for f in found)
    everywhere = (corpus + 1) / (corpus.sum() + n)
    smooth = lambda counts, above: (counts + language.STRENGTH * above) / (counts.sum() + language.STRENGTH)
    out = []
    for i, lik, own, declared, address, host, domain in found:
        prior = smooth(np.maximum(add(5, host) - own, 0), smooth(np.maximum(add(6, domain) - own, 0), everywhere))
        total = lik + np.log(prior)
        for k, c in ((3, declared), (4, address)):
            if c:
                have = sum((f[2] for f in found if f[k]), np.zeros(n)) - own
                first = np.array([language.AGREE if c == x else (1 - language.AGREE) / max(1, n - 1) for x in model.languages])
                total = total + np.log((np.maximum(add(k, c) - own, 0) + language.STRENGTH * first) / (np.maximum(have, 0) + language.STRENGTH))
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        said = model.languages[int(own.argmax())] if own.max() > own.min() else None
        out.append((i, model.languages[int(p.argmax())], round(float(p.max()), 9), said, declared, address))
    return sorted(out)


def test_fusion_equals_brute_force(spark, sf_dir):
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    model = language.train(docs)
    rows = language.document_rows(docs).unionByName(language.page_rows(pages))
    extra = [
        (-1, "page", "<html lang=FR><p>le chat est sur la table et il dort", True, "http://a.news.co.uk/fr-CA/x", None),
        (-2, "page", "", True, "http://b.news.co.uk/", None),
        (-3, "page", "<p>", True, None, None),
        (-4, "page", "<html lang='xx'>the house is on the hill", True, "https://de.alone.org:80/", None),
        (-5, "document", "der Hund ist im Haus und er schläft", False, None, "SRC"),
    ]
    rows = rows.unionByName(spark.createDataFrame(extra, "id long, kind string, text string, markup boolean, url string, host string"))
    got = sorted((r.id + (10**6 if r.kind == "page" else 0), r.lang, round(r.probability, 9), r.text_lang, r.declared, r.address) for r in language.identify(rows, model).collect())
    want = fused_brute([(r.id + (10**6 if r.kind == "page" else 0), *r[1:]) for r in rows.collect()], model)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)


def test_repeated_ids_are_one_row(spark):
    """A language whose rows all have one id is neither lost to the thinning by ids nor above the bound because of them."""
    many = [(7, "der hund und die katze", "de")] * 6000
    few = [(1000 + i, "the cat and the dog", "en") for i in range(300)]
    once = [(7, "der hund und die katze", "de"), *few]
    schema = "doc_id long, text string, lang string"
    for shift in range(3):
        moved = [(i + 100_000 * shift, t, x) for i, t, x in many + few]
        a = language.train(spark.createDataFrame(moved, schema).repartition(4), fit_rows=100)
        b = language.train(spark.createDataFrame([(i + 100_000 * shift, t, x) for i, t, x in once], schema), fit_rows=100)
        assert a.languages == ["de", "en"] and (a.table == b.table).all()
