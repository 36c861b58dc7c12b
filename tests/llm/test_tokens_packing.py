import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import EDGES, SMALL, edges, no_rows
from trialweave.llm import packing, queries, tokens

TEXTS = ["", "a", "x\n\ny", "Ünïcode ñ 漢字 🙂\nend", "one two\nthree four\n", "  spaces   \n\n\n tail", "<|endoftext|> is text", "\n" * 7, "don't we'll\r\nok"]


def brute(text, sections, rule, enc):
    owner, data = [-1] * len(text.encode()), text.encode()
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    for k, (_, a, b) in enumerate(sections):
        for x in range(at[a], at[b]):
            owner[x] = k if owner[x] == -1 else owner[x]
    out, place = Counter(), 0
    for t in enc.encode(text):
        mine = owner[place : place + int(enc.lengths[t])]
        place += len(mine)
        count, order = Counter(mine), list(dict.fromkeys(mine))
        if rule == "fraction":
            for o, n in count.items():
                out[o] += n / len(mine)
        else:
            out[{"first": mine[0], "last": mine[-1], "majority": max(order, key=lambda o: count[o])}[rule]] += 1
    assert place == len(data)
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_equals_brute_force(rule):
    enc, rng = tokens.encoder(queries.vocabulary()), random.Random(3)
    for text in TEXTS:
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1)))
        cases = [tokens.line_sections(text), [("p", a, b) for a, b in zip(cuts[::2], cuts[1::2])], [("p", 0, len(text)), ("late", 0, len(text))]]
        for sections in cases:
            rows, want = tokens.attribute(text, sections, rule, enc), brute(text, sections, rule, enc)
            assert {r[0]: pytest.approx(r[4]) for r in rows if r[4]} == {k: v for k, v in want.items() if v}
            assert sum(r[4] for r in rows) == pytest.approx(len(enc.encode(text)))


def test_ids_equal_the_library():
    enc, lib = tokens.encoder(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    added = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n", "<|endoftext| >", "  <|endoftext|>  tail"]
    for t in TEXTS + added + [e[1] for e in EDGES if e[1]]:
        ids = enc.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert sum(int(enc.lengths[i]) for i in ids) == len(t.encode())
    assert enc.encode("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_attribution_edges(spark):
    df = edges(spark, "section", "name", "start", "tokens")
    rows = tokens.attribute_tokens(df, queries.vocabulary()).collect()
    per_doc = Counter()
    for r in rows:
        per_doc[r["doc_id"]] += r["tokens"]
    enc = tokens.encoder(queries.vocabulary()).encode
    want = Counter()
    for i, t, *_ in EDGES:
        want[i] += len(enc(t or ""))
    assert per_doc == want
    text, sections = tokens.field_sections("source", "text")
    fields = df.select("doc_id", text.alias("t"), sections.alias("s"))
    got = tokens.attribute_tokens(fields, queries.vocabulary(), text="t", sections="s", rule="fraction").collect()
    assert {r["name"] for r in got} == {"source", "text", "outside"}
    assert tokens.attribute_tokens(no_rows(spark), queries.vocabulary()).count() == 0
    with pytest.raises(ValueError):
        tokens.attribute_tokens(df, queries.vocabulary(), rule="half")


def place_all(counts, capacity, score):
    run = packing.plan(counts, capacity, score)
    bins, seen = {}, Counter()
    for length, rank, n, k, first, offset in zip(*[run[c].tolist() for c in ("length", "rank", "n", "per_bin", "first_bin", "offset")]):
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            bins.setdefault(first + i // k, []).append((offset + i % k * length, length))
    assert seen == Counter({k: v for k, v in counts.items() if v}) and len(bins) == int(run["n_bins"])
    for own in bins.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(own) <= capacity.pieces and sum(x * x for _, x in own) <= capacity.cost
    return len(bins)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_capacity(score):
    rng = random.Random(1)
    for trial in range(25):
        top = rng.choice([5, 40, 1024])
        counts = Counter(min(top, 1 + int(rng.expovariate(3 / top))) for _ in range(rng.choice([1, 50, 2000])))
        capacity = packing.Capacity(top, rng.choice([2, 7, top]), rng.choice([top * top, top * top + 3]))
        n = place_all(counts, capacity, score)
        total = sum(k * v for k, v in counts.items())
        if capacity.pieces == top and score == "norm":
            assert n <= max(1.1 * total / top + 2, counts[top] + sum(v for k, v in counts.items() if top / 2 < k < top) + 2)
    place_all({1: 100_000, 1024: 3, 700: 5}, packing.Capacity(), score)
    with pytest.raises(ValueError):
        packing.plan({9: 1}, packing.Capacity(5, 5, 25))


def check_packed(rows, texts):
    enc = tokens.encoder(queries.vocabulary()).encode
    want = Counter()
    for i, t in texts:
        ids = [*enc(t or ""), 2]
        cut = -(-len(ids) // 1024)
        for k in range(cut):
            a, b = max(0, len(ids) - 1024 * (cut - k)), len(ids) - 1024 * (cut - 1 - k)
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return by


def test_packing_small_table(spark):
    rows = queries.op5(spark, SMALL).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    by = check_packed(rows, docs)
    assert len(by) <= sum(r["length"] for r in rows) / 1024 * 1.03 + 1


def test_packing_edges_and_sequences(spark):
    made = packing.pack(edges(spark, "piece", "ids", "part", "offset"), queries.vocabulary()).cache()
    check_packed(made.collect(), [e[:2] for e in EDGES])
    for s in packing.sequences(made).collect():
        ids = np.frombuffer(s["ids"], dtype="<u4")
        assert len(ids) <= 1024 and ids[-1] == 2 or len(ids) == 1024
        assert len(s["starts"]) == len(s["doc_ids"]) and s["starts"][0] == 0
    assert packing.pack(no_rows(spark), queries.vocabulary()).count() == 0
    many = spark.range(500).select(F.lit(9).cast("long").alias("doc_id"), F.lit("").alias("text"))
    assert {r["sequence_id"] for r in packing.pack(many, queries.vocabulary()).collect()} == {0}
    assert json.load(open(queries.vocabulary()))["model"]["type"] == "BPE"
