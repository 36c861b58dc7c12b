import hashlib
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import EDGES, SMALL, edges, no_rows
from tests.llm.test_duplicates import jaccard_components
from trialweave.llm import decontaminate, pii, queries, simhash
from trialweave.llm.common import stored, table


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits[::-1])) % 10 == 0


def brute(t):
    """The contract's patterns as they are written."""
    t, out = t or "", []
    spans = lambda p: re.finditer(p, t)
    number = lambda m: [int(c) for c in m[0] if c in "0123456789"]
    out += [(m.start(), 0, "email", m.end()) for m in spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [(m.start(), 1, "ip", m.end()) for m in spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in spans(r"[0-9]([\x20-]?[0-9])+") if 14 <= len(number(m)) <= 19 and luhn(number(m))]
    out += [(m.start(), 3, "phone", m.end()) for m in spans(r"\+[0-9][\x20().0-9-]+[0-9]") if 10 <= len(number(m)) <= 15]
    return sorted(out)


HOSTILE = [
    "a@b.co_x@d.ee x@y a@@b.c a@b..c %+-@q-.z me@x.y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 9.9.9.9999", "4111 1111 1111 1111-4111-1111 11111111 1111",
    "4111111111111111 0 4111-1111-1111-1111  4111  1111", "+1 (234) 555-6789 +12 +1-------2 +49.30.123456 789) ++1234567890 +1234567890123456", "ñ🙂 漢@x.com 🙂a@x.com🙂",
    "0" * 14 + " " + "0" * 19 + "x" + "0" * 20, "@" * 50, "a." * 3000 + "@x.com", "9" * 5000 + ".1.1.1", "5 " * 3000, "1.1." * 2000, "a@" + "b." * 4000 + "c",
    "(030) 555-1234 call (212) 555-1234 tel: (212) 555 1234", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" abcdefghijklmnopqrstuvwxyz sk-abcdefghij0123456789XY',
]


def test_base_spans_equal_brute_force(spark):
    rng, parts = random.Random(3), ["1", "42", "255", ".", "@", "a", "x.com", " ", "-", "+1", "(5)", "4111111111111111", "ñ", "\n", "_", "192.168.0.1"]
    texts = HOSTILE + ["".join(rng.choices(parts, k=rng.randint(2, 14))) for _ in range(1500)] + [e[1] for e in EDGES]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    rows = df.withColumn("base", pii.base_spans(F.coalesce("text", F.lit("")))).collect()
    for r in rows:
        assert [tuple(s) for s in r["base"]] == brute(r["text"]), r["text"]
    assert sum(len(r["base"]) for r in rows) > 500


def test_small_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op10(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for a, _, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= {s for s in r["spans"].split(",") if s}
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[2] == k for x in base) for k in pii.BASE]


def test_weak_supervision_tells_secrets_from_long_words(spark):
    rng = random.Random(5)
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    secrets = [(i, f'some text token = "{hexa(40)}" goes on') for i in range(60)] + [(i, f"api key: {hexa(32)} and so on") for i in range(60, 90)]
    words = [(i, f"a word {''.join(rng.choices('abcdeiounr', k=24))} in the text") for i in range(100, 160)]
    df = spark.createDataFrame(secrets + words, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(df, pii.fit(df)).collect()}
    assert all([s["kind"] for s in rows[i]["spans"]] == ["secret"] for i, t in secrets if not brute(t))
    assert all(not rows[i]["spans"] for i, _ in words)


def test_reliabilities_of_known_labelers(spark):
    rng, counts = random.Random(6), {}
    for _ in range(6000):
        true = rng.random() < 0.3
        v = tuple(rng.choice([1 if true == (rng.random() < acc) else 0] * 3 + [-1]) for acc in (0.95, 0.9, 0.8, 0.85, 0.7))
        counts[v] = counts.get(v, 0) + 1
    df = spark.createDataFrame([([(list(v), n) for v, n in sorted(counts.items())],)], "p array<struct<votes:array<int>,n:bigint>>")
    q = df.select(pii.reliabilities(F.col("p")).alias("q")).first()["q"]
    assert abs(q["pi"] - 0.3) < 0.05 and all(abs(x - y) < 0.06 for x, y in zip(q["a"], (0.95, 0.9, 0.8, 0.85, 0.7)))
    assert all(abs(x - y) < 0.06 for x, y in zip(q["b"], (0.05, 0.1, 0.2, 0.15, 0.3)))


def test_pii_edges_and_redaction(spark):
    df = edges(spark, "base", "Spans", "start", "kind", "n")
    rows = pii.find(df, pii.fit(df)).collect()
    assert len(rows) == len(EDGES) and not any(r["spans"] for r in rows)
    assert pii.find(no_rows(spark), pii.fit(no_rows(spark))).count() == 0
    texts = ["mail a@b.co now", "+1 (234) 555-6789", "no data", None, "4111 1111 1111 1111 1.2.3.4", "ñ a@b.co🙂b@c.de"]
    t = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("base", pii.base_spans(F.coalesce("text", F.lit(""))))
    got = [r[0] for r in t.select(pii.redact(F.col("text"), F.col("base"))).collect()]
    assert got == ["mail [EMAIL] now", "[PHONE]", "no data", None, got[4], "ñ [EMAIL]🙂[EMAIL]"] and "1.2.3.4" not in got[4]


def test_pipeline_stages_on_the_small_table(spark):
    docs = table(spark, SMALL, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SMALL), name))
    at = lambda k: {r["doc_id"]: r for r in steps[k].collect()}
    assert all(s.columns == docs.columns for s in steps[:-1])
    toxic = {r["doc_id"] for r in queries.op4(spark, SMALL).where("predicted = 1").collect()}
    assert set(at(1)) == set(at(0)) - toxic
    before = sorted(at(1).items())
    assert set(at(2)) == {before[k][0] for k in set(jaccard_components([r["text"] for _, r in before]))}
    leaked = {r["doc_id"] for r in decontaminate.leaks(steps[2], table(spark, SMALL, "benchmark")).collect()}
    assert set(at(3)) == set(at(2)) - leaked
    before, after = at(3), at(4)
    assert set(before) == set(after)
    for i, r in after.items():
        assert not brute(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == before[i]["text"] or brute(before[i]["text"]) or "[SECRET]" in r["text"] or "[NUMBER]" in r["text"]
    packed = steps[5].collect()
    assert {r["doc_id"] for r in packed} == set(after)
    assert sorted(map(str, packed)) == sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) or len(packed) == corpus_pipeline.run(spark, SMALL).count()


def test_stages_take_odd_tables(spark, tmp_path):
    for t, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for df in (edges(spark), edges(spark, "score", "spans", "base", "fp", "key"), no_rows(spark)):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stored(stage(spark, docs, str(tmp_path)), name)
            assert name == "best_fit_packing" or docs.columns == columns
        assert (docs.count() > 0) == (df.count() > 0)
