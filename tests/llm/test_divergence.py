"""Divergence of sources against a dense computation with Python integers."""

import re
from collections import Counter, defaultdict

from tests.llm.helpers import EDGES, SMALL, edges, no_rows, same_as_sql
from trialweave.llm import divergence
from trialweave.llm.common import table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dense(rows, min_docs, top):
    n, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        n[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    part = lambda c, total, v: 1 + 10**9 * (c + 5) // (total + 5 * v)
    for lang, docs in df.items():
        kept, sources = [t for t, c in docs.items() if c >= min_docs], [g for k, g in n if k == lang]
        size = {g: sum(n[lang, g][t] for t in kept) for g in sources}
        p = {g: {t: part(n[lang, g][t], size[g], len(kept)) for t in kept} for g in sources}
        q = {t: part(sum(n[lang, g][t] for g in sources), sum(size.values()), len(kept)) for t in kept}
        for source in sources:
            ranked = sorted((-sum(abs(p[source][t] - p[g][t]) for t in kept), g.encode(), g) for g in sources if g != source)
            out += [(lang, source, "pair", g, -v, k + 1) for k, (v, _, g) in enumerate(ranked)]
            over = sorted((q[t] - p[source][t], t.encode(), t) for t in kept if n[lang, source][t] and p[source][t] > q[t])
            out += [(lang, source, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(over[:top])]
    return sorted(out)


def made(df, **kw):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df, **kw).collect())


def test_cells_of_any_size_equal_the_dense_result(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("text", "lang", "source").collect()]
    want = dense(rows, 3, 7)
    df = table(spark, SMALL, "documents")
    assert made(df, min_docs=3, top=7) == want
    assert made(df, min_docs=3, top=7, shape=divergence.Shape(groups=8, terms=400)) == want


def test_query_equals_sql(spark):
    same_as_sql(spark, "op11_cube_divergence")


def test_edges(spark):
    rows = [(t, lang, source) for _, t, lang, source, _ in EDGES]
    for min_docs in (1, 2, 30):
        assert made(edges(spark, "term", "n", "value"), min_docs=min_docs) == dense(rows, min_docs, 50)
    assert made(no_rows(spark)) == []


def test_counts_beyond_a_long_product(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, v long")
    assert df.select(divergence.part_of(df["n"], df["total"], df["v"])).first()[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35)
