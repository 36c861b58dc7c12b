import random
import time
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import EDGES, SMALL, edges, no_rows, same_as_sql
from trialweave.llm import decontaminate, jaccard, queries, simhash


def plain_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def components(values, limit=4):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    v = np.array(values, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= limit) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def check(rows, ids):
    prints = [int(r["fingerprint"], 16) for r in rows]
    groups = components(prints)
    least = {}
    for g, i in zip(groups, ids):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    assert [r["component_id"] for r in rows] == [least.get(g) for g in groups]


def test_small_table_and_edges(spark):
    rows = queries.op8(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(int(r["fingerprint"], 16) == plain_fingerprint(texts[r["doc_id"]]) for r in rows if len(texts[r["doc_id"]]) < 3000)
    check(rows, [r["doc_id"] for r in rows])
    rows = simhash.near_duplicates(edges(spark, "fp", "doc", "row", "component_id")).collect()
    assert len(rows) == len(EDGES) and all(len(r["fingerprint"]) == 16 for r in rows)
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    check(rows, [r["doc_id"] for r in rows])
    assert simhash.near_duplicates(no_rows(spark)).count() == 0


def test_one_row_of_each_component_stays(spark):
    kept = simhash.deduplicate(edges(spark, "keep", "fp")).collect()
    assert len(kept) == len(set(jaccard_components([r[1] for r in EDGES])))
    assert Counter(r["doc_id"] for r in kept)[1] == 1 and None in {r["doc_id"] for r in kept}
    assert simhash.deduplicate(no_rows(spark)).count() == 0


def shingle_sets(texts, k=5):
    out = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def jaccard_components(texts, threshold=0.8):
    """Smallest place reachable over pairs of the wanted similarity, by brute force."""
    sets, at = shingle_sets(texts), {}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def link(i, j):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)

    for j, s in enumerate(sets):
        near = Counter(i for x in s for i in at.get(x, ()))
        for i, n in near.items():
            if n >= threshold * (len(s) + len(sets[i]) - n) - 1e-9:
                link(i, j)
        if not s:
            link(next(i for i, o in enumerate(sets) if not o), j)
        for x in s:
            at.setdefault(x, []).append(j)
    return [find(i) for i in range(len(texts))]


def test_stage_joins_all_pairs_of_similar_texts(spark):
    """Edited copies around the threshold, chains of them, a crowd, a common line, and texts under five words."""
    rng, docs = random.Random(11), []
    word = lambda: f"w{rng.randrange(3000)}"
    line = "a line that stands in very many of the texts here"
    for _ in range(60):
        t = [word() for _ in range(rng.choice([6, 25, 60, 200]))] + (line.split() if rng.random() < 0.5 else [])
        for _ in range(4):
            docs.append(" ".join(t))
            t = list(t)
            for _ in range(max(1, round(len(t) * rng.choice([0.005, 0.015, 0.022, 0.03, 0.05])))):
                t[rng.randrange(len(t))] = word()
    crowd = [word() for _ in range(80)]
    for _ in range(120):
        t = list(crowd)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(80)] = word()
        docs.append(" ".join(t).upper())
    docs += ["x y", "X  y", "x", "", None, line, line + " again"]
    rng.shuffle(docs)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = sorted(set(jaccard_components(docs)))
    assert sorted(r["doc_id"] for r in simhash.deduplicate(d.repartition(5)).collect()) == want and 60 < len(want) < 300
    bits = [plain_fingerprint(t) for t in docs]
    assert len(set(components(bits))) > len(want)  # four bits do not find them


def flipped(rng, value, n):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("dense,block", [(16, 2048), (3, 8), (10**9, 2048)])
def test_links_give_all_components(spark, dense, block):
    """Chains of four-bit steps, pairs at five bits, and crowds that share partition values."""
    rng, values = random.Random(dense % 97), set()
    for _ in range(40):
        v = rng.getrandbits(64)
        values |= {v, flipped(rng, v, 4), flipped(rng, v, 5)}
    v = rng.getrandbits(64)
    for _ in range(60):
        v = flipped(rng, v, 4)
        values.add(v)
    centre = rng.getrandbits(64)
    values |= {flipped(rng, centre, rng.randint(1, 5)) for _ in range(250)} | {0, 2**64 - 1, 2**63}
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), dense=dense, block=block)
    rows = links.collect()
    if dense < 100:
        assert len(rows) < 60_000
    place, parent = {v: i for i, v in enumerate(signed)}, list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in rows:
        a, b = find(place[r["a"]]), find(place[r["b"]])
        parent[max(a, b)] = min(a, b)
    want = components(values)
    assert [find(i) for i in range(len(values))] == want
    if dense == 3:
        got = {r["node"]: r["root"] for r in simhash.roots(links).collect()}
        alone = Counter(want)
        groups = {}
        for v, g in zip(signed, want):
            assert (v in got) == (alone[g] > 1)
            if v in got:
                groups.setdefault(g, set()).add(got[v])
        assert all(len(s) == 1 for s in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_allocation_obeys_the_pigeonhole():
    rng = np.random.default_rng(1)
    prints = rng.integers(-(2**63), 2**63 - 1, 500)
    prints[:200] = prints[0] ^ (1 << rng.integers(0, 20, 200))
    for parts in (2, 3, 4, 5):
        groups = simhash.correlated_partitions(prints, parts)
        assert sorted(b for g in groups for b in g) == list(range(64)) and max(map(len, groups)) - min(map(len, groups)) <= 1
        values = simhash.parts_of(prints, groups)
        t = simhash.allocate(values, values[:100], 500, [len(g) for g in groups], 4, 4, 2.0)
        assert ((t + 1).sum(axis=1) == 5).all() and t.min() >= -1


def brute_leaks(docs, items, k=5, threshold=0.8):
    import re

    words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    out = []
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            n = min(k, len(v))
            if n:
                a, b = {tuple(v[x : x + n]) for x in range(len(v) - n + 1)}, {tuple(w[x : x + n]) for x in range(len(w) - n + 1)}
                if len(a & b) >= threshold * len(a) - 1e-9:
                    out.append((i, j, len(a), len(a & b)))
    return sorted(out, key=str)


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 6, 9, 14, 30, 61]))) for i in range(40)] + [(90, None), (91, " -- "), (92, text(30).upper())]
    docs = [(100, None), (101, ""), (102, "w1")]
    for i in range(60):
        item = rng.choice(items)[1] or ""
        words = item.split()
        for _ in range(rng.choice([0, 1, 2, 3])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, f"{text(rng.choice([0, 20, 400]))}, {' '.join(words).title()}! {text(20)}"))
    docs += [docs[5]] * 3 + [(None, docs[6][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    d = d.selectExpr("*", "1 as key", "2 as item_id", "3 as hash", "4 as width", "5 as w")
    rows = decontaminate.leaks(d, b).collect()
    first = {}
    for j, u in items:
        first.setdefault(u, j)
    want = [x for x in brute_leaks(docs, items) if x[1] in first.values()]
    assert sorted([(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in rows], key=str) == want and len(want) > 30
    clean = decontaminate.decontaminate(d, b)
    assert clean.columns == d.columns
    bad = {t for i, t in docs for x in want if x[0] == i}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, t in docs if t not in bad)


def test_equal_items_and_empty_tables(spark):
    t = "some five words and then some more words to fill"
    d = spark.createDataFrame([(1, t), (2, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(7, t), (5, t.upper()), (9, "none of these words is in any document here")], "item_id long, text string")
    r = decontaminate.leaks(d, b).collect()
    assert [(x["doc_id"], x["item_id"], x["n_items"], x["containment"]) for x in r] == [(1, 5, 2, 1.0)]
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).count() == 2
    assert decontaminate.decontaminate(edges(spark, "key", "item_id"), b).count() == len(EDGES)


def test_items_without_or_under_one_id(spark):
    known, other, far = "some five words and then some more words to fill", "quite different words of another item that is long", "w1 w2 w3 w4 w5 w6"
    docs = [(1, f"intro {known} end"), (2, f"intro {other} end"), (3, f"{other} and {far}"), (4, "clean text without any of these")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(None, known), (3, other), (3, far)], "item_id long, text string")
    r = decontaminate.leaks(d, b).collect()
    got = sorted((x["doc_id"], str(x["item_id"]), x["n_items"], x["n_shingles"], x["containment"]) for x in r)
    assert got == [(1, "None", 1, 6, 1.0), (2, "3", 1, 5, 1.0), (3, "3", 1, 2, 1.0), (3, "3", 1, 5, 1.0)]
    assert [x["doc_id"] for x in decontaminate.decontaminate(d, b).collect()] == [4]


def test_shuffled_index_gives_the_same(spark, monkeypatch):
    want = sorted(map(str, queries.op9(spark, SMALL).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, queries.op9(spark, SMALL).collect())) == want


def test_leaks_equal_sql(spark):
    same_as_sql(spark, "op9_size_partitioned_containment")


def test_bitmaps_never_exceed_the_difference(spark):
    rng = np.random.default_rng(7)
    pairs = []
    for n in (1, 3, 60, 64, 65, 200, 1000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, size=n))
        for share in (0.0, 0.5, 0.9, 1.0):
            b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(-(2**63), 2**63 - 1, size=max(1, int((1 - share) * n * 1.3)))]))
            pairs.append((jaccard.bitmap(a).tolist(), jaccard.bitmap(b).tolist(), len(np.setxor1d(a, b)), max(len(a), len(b)) > 1.9 * min(len(a), len(b))))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, d long, far boolean").where("greatest(size(a), size(b)) <= 2 * least(size(a), size(b))")
    rows = df.withColumn("least", jaccard.least_difference(df["a"], df["b"])).collect()
    assert len(rows) > 15 and all(r["least"] <= r["d"] for r in rows) and any(r["least"] > r["d"] / 3 > 10 for r in rows)


def test_texts_of_one_template_end_soon(spark):
    """Nine common words and one of their own: every pair shares shingles, none is alike."""
    common = "the quick brown fox jumps over the lazy dog"
    df = spark.range(20_000).selectExpr("id as doc_id", f"concat('{common} nr', id) as text")
    began = time.time()
    assert simhash.deduplicate(df).count() == 20_000
    assert time.time() - began < 60


def test_fingerprints_propose_pairs_and_sets_decide(spark):
    """The stage goes by the pigeonhole index; links of fingerprints that are no pairs of the wanted similarity are left out."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    base = [word(120) for _ in range(12)]
    texts = [" ".join(t) for t in base] + [" ".join([*t[:60], "other", *t[61:]]) for t in base] + ["a b c d e", "a b c d e f"]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {tuple(sorted(r)) for r in simhash.proposed(nodes, 5, 6).collect()}
    prints = [simhash.text_fingerprint(t, 5) for t in texts]
    apart = lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count()
    assert got and all(a != b and apart(a, b) <= 6 for a, b in got)
    close = {(a, b) for a in range(len(texts)) for b in range(a) if apart(a, b) <= 6}
    assert {x for p in close for x in p} <= {x for p in got for x in p}
    none = nodes.selectExpr("node as a", "node as b").limit(0)
    wrong = nodes.where("node = 0").selectExpr("node as a", "node + 1 as b")
    links = [{tuple(sorted(r)) for r in jaccard.links(nodes, p, simhash.roots).collect()} for p in (none, wrong)]
    assert links[0] == links[1] == {(k, k + 12) for k in range(12)}
    assert len(jaccard.folded(np.arange(16, dtype=np.int64))) == 8


def components_of(links, n):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def edited(rng, base, most):
    t = list(base)
    for _ in range(rng.randint(1, most)):
        t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
    return " ".join(t)


def test_links_of_a_crowd_do_not_grow_with_its_pairs(spark):
    """Edited copies of one text, most pairs of which are alike: links stay fewer than a few per text, not per pair."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [edited(rng, base, 4) for _ in range(240)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = jaccard.links(nodes, nodes.selectExpr("node as a", "node as b").limit(0), simhash.roots).distinct().collect()
    sets = shingle_sets(texts)
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    assert all(alike(*r) for r in found) and components_of(found, 240) == jaccard_components(texts)
    assert sum(alike(a, b) for a in range(240) for b in range(a)) > 4 * 240 > len(found)


@pytest.mark.parametrize("stars,dense,block", [(0, 2, 3), (1, 5, 512), (0, 10**6, 512)])
def test_units_and_joins_find_the_same_components(spark, stars, dense, block):
    """Crowds in units of any size, texts of different sizes in one crowd, and none in units."""
    rng = random.Random(6)
    line, docs = [f"l{k}" for k in range(12)], []
    for n in (8, 20, 21, 60, 150):
        base = [f"w{rng.randrange(500)}" for _ in range(n)] + line
        docs += [edited(rng, base, max(1, n // 30)) for _ in range(9)] + [" ".join(base[k:]) for k in range(0, n // 4, 2)]
    docs += [" ".join([*line, f"nr{k}"]) for k in range(30)] + ["", "one word"]
    docs = list(dict.fromkeys(docs))
    nodes = spark.createDataFrame(list(enumerate(docs)), "node long, text string")
    none = nodes.selectExpr("node as a", "node as b").limit(0)
    found = jaccard.links(nodes, none, simhash.roots, stars=stars, dense=dense, block=block).collect()
    assert components_of(found, len(docs)) == jaccard_components(docs)


def test_counts_and_forests_of_a_unit():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(-50, 50, size=n)) * 2**40 for n in (0, 1, 5, 30, 80, 200)]
    for width in (7, 2048):
        got = jaccard.shared_counts(sets, sets[1:], width)
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[1:]] for x in sets]
    assert jaccard.shared_counts([], sets).shape == (0, 6) and jaccard.spanning(np.zeros((0, 3), dtype=bool)) == []
    for share in (0.02, 0.1, 0.9):
        near = rng.random((40, 30)) < share
        links = jaccard.spanning(near)
        assert all(near[x, y] for x, y in links) and len(links) < 70
        whole = components_of([(x, 40 + y) for x, y in np.argwhere(near).tolist()], 70)
        assert components_of([(x, 40 + y) for x, y in links], 70) == whole
