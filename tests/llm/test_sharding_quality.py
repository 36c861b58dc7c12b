import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.llm.helpers import EDGES, SMALL, edges, no_rows, same_as_sql
from trialweave.llm import quality, queries, sharding


def test_shards_are_exact_and_gapless(spark):
    rows = queries.op1(spark, SMALL).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_shard_edges(spark):
    df = edges(spark, "shard", "SLOT", "size", "n", "block", "cuts")
    out = sharding.shard_rows(df, 4, bucket_rows=2)
    rows = out.collect()
    assert len(rows) == len(EDGES) and [c for c in out.columns if c not in ("shard", "slot")] == [c for c in df.columns if c.lower() not in ("shard", "slot")]
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str(e[:2]) for e in EDGES)
    assert sharding.shard_rows(no_rows(spark), 4).count() == 0
    assert max(Counter(r["shard"] for r in sharding.shard_rows(spark.range(3), 40).collect()).values()) == 1
    with pytest.raises(ValueError):
        sharding.shard_rows(df, 0)


def test_many_blocks_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 5)
    rows = sharding.shard_rows(spark.range(0, 3000, 1, 7).select(F.lit(1).alias("same"), "id"), 7, bucket_rows=50).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert sorted(sizes.values()) == [428] * 3 + [429] * 4 and len({r["id"] for r in rows}) == 3000
    place = {r["id"]: r["shard"] for r in rows}
    moved = sum(place[i] != place[i + 1] for i in range(2999)) / 2999
    assert 0.8 < moved < 0.91  # 6 in 7 neighbours part


def test_allot_meets_both_margins_and_its_law():
    rng = np.random.default_rng(5)
    sizes, shards = np.array([5, 0, 17, 8]), np.array([10, 10, 10])
    total = np.zeros((4, 3))
    for _ in range(2000):
        m = sharding.allot(sizes, shards, rng)
        assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == shards).all() and (m >= 0).all()
        total += m
    assert np.abs(total / 2000 - np.outer(sizes, shards) / 30).max() < 0.15


def test_allot_of_large_populations():
    sizes, rng = np.array([3_000_000_000, 1_000_000_000, 2_000_000_000]), np.random.default_rng(1)
    m = sharding.allot(sizes, sharding.shard_sizes(6_000_000_000, 40), rng)
    assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == 150_000_000).all()
    assert np.abs(m[0] - 75_000_000).max() < 60_000 and len(set(m[0])) > 30
    draws = np.array([sharding.large_hypergeometric(rng, 40, 60, 30) for _ in range(4000)])
    assert abs(draws.mean() - 12) < 0.15 and abs(draws.var() - 30 * 0.4 * 0.6 * 70 / 99) < 0.4


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


TEXTS = [None, "", " \n ", "a b c a b c a b c", "a a a a", "x\ny\nx\n\nx", "# $ % < > | & *", "a b c d a b c", " lead a b c x a b c ", "🙂 🙂 🙂 🙂", "w " * 5000, "p q r\n" * 60]


def test_measures_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + [e[1] for e in EDGES])], "id int, text string")
    for r in quality.ledger(df.selectExpr("*", "1 as failed", "2 as N_WORDS", "3 as n")).collect():
        assert tuple(r[m] for m in quality.MEASURES) == brute_measures(r["text"]), r["text"][:80]
    assert quality.ledger(no_rows(spark)).count() == 0


def test_policies_and_ablation(spark):
    led = quality.ledger(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = led.select("failed", quality.kept(quality.STANDARD).alias("k"), quality.kept(quality.BASE).alias("b")).collect()
    bits = {r.name: 1 << k for k, r in enumerate(quality.RULES)}
    for r in rows:
        assert r["k"] == (r["failed"] == 0) and r["b"] == (r["failed"] & 3 == 0)
    for a in quality.ablation(led, quality.STANDARD).collect():
        bit = bits[a["rule"]]
        assert a["n_failed"] == sum(bool(r["failed"] & bit) for r in rows) and a["n_only"] == sum(r["failed"] == bit for r in rows)
        assert a["n_kept_without"] == sum(r["failed"] & ~bit == 0 for r in rows)


def test_ledger_equals_sql(spark):
    same_as_sql(spark, "op2_rule_ledger")
