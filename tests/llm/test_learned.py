import random
import zlib

import numpy as np

from tests.llm.helpers import EDGES, edges, no_rows
from trialweave.llm import langid, queries, toxicity

MIDDLE = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_toxicity_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in queries.op4(spark, MIDDLE).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows.values():
        assert r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    pairs = [(rows[i]["predicted"], y) for i, y in labels.items() if i in rows and held_out(i)]
    assert sum(p == y for p, y in pairs) / len(pairs) >= 0.9
    assert sum(p > y for p, y in pairs) / len(pairs) < 0.03


def sentences(seed):
    """Toxic texts name one group far more often than clean ones do."""
    rng, plain = random.Random(seed), [f"word{k}" for k in range(80)]
    for i in range(600):
        toxic = i % 3 == 0
        own = rng.sample(plain, 8) + (["scum"] if toxic and rng.random() < 0.8 else [])
        if rng.random() < (0.9 if toxic else 0.05):
            own.append("muslims")
        rng.shuffle(own)
        yield i, " ".join(own) + ".", int(toxic)


def test_counterfactual_penalty_lowers_identity_weight(spark):
    data = list(sentences(1))
    docs, labels = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    neutral, slur = "we met some muslims today.", "they are scum."
    scores = {}
    for penalty in (0.0, 20.0):
        of = toxicity.fit(docs, labels, penalty=penalty).scorer()
        scores[penalty] = of(neutral), of(neutral.replace("muslims", "jews")), of(slur)
    gap = {p: abs(a - b) for p, (a, b, _) in scores.items()}
    assert gap[0.0] > 0.3 and gap[20.0] < 0.1 and scores[20.0][0] < scores[0.0][0] - 0.2 and scores[20.0][2] > 0.3


def test_counterfactuals_stay_in_sentences():
    swaps = toxicity.swap_table(toxicity.IDENTITY_TERMS)
    pairs = toxicity.counterfactuals("Women came. Nobody spoke. The Jews left, men too!", swaps)
    assert pairs == [({"women", "came"}, {"men", "came"}), ({"the", "jews", "left", "men", "too"}, {"the", "hindus", "left", "girls", "too"})]
    assert toxicity.counterfactuals(None, swaps) == []


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    df = edges(spark, "id", "y", "t", "SCORE")
    rows = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    none = toxicity.fit(df, labels.limit(0))
    assert none.scorer()("x") < 1e-9 and toxicity.fit(df, labels.where("toxic = 1")).scorer()(None) > 0.99
    assert toxicity.score(no_rows(spark), none).count() == 0


def test_training_separates_a_word():
    rows = [np.array(sorted({k % 50, 60 + k % 7} | ({99} if k % 4 == 0 else set()))) for k in range(400)]
    label = np.array([float(k % 4 == 0) for k in range(400)])
    model = toxicity.train(rows, label, np.ones(400), [])
    assert max(model.weights, key=model.weights.get) == 99 and model.weights[99] > 2 and len(model.weights) < 10


def test_language_on_held_out_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = queries.op7(spark, MIDDLE).collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and {r["lang_pred"] for r in rows} <= {"en", "de", "fr", "es", "und"}


def test_language_edges(spark):
    df = edges(spark, "id", "g", "t", "score", "lang_pred", "key", "piece")
    model = langid.fit(df)
    assert set(model.dictionaries) == {"en", "de", "es"}
    for r in langid.identify(df, model).collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    empty = langid.fit(no_rows(spark))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}
    assert langid.identify(no_rows(spark), model).count() == 0
    one = langid.Model({"xx": [b" some words"]}).classifier()
    assert one("words") == ("xx", 1.0, False) and one("123 --")[0] == "und"
    for t in ["²", "Ⅻ ①", "\u0301\u0308 7", "_", "٣", "🙂"]:  # no letters, though some count as word characters
        assert one(t)[0] == "und" and not any(c.isalpha() for c in t)
    assert langid.normal("नमस्ते दुनिया") == "नमस्ते दुनिया".encode()  # marks stay within words


def test_copies_leave_dictionaries_full_and_pieces_come_from_anywhere(spark):
    text = lambda lang, k: "the same opening of every page " + " ".join(f"{lang}{chr(97 + j % 26)}{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}" for j in range(40))
    rows = [(k, text("q", k), "qq") for k in range(400)] + [(k, text("q", 7), "qq") for k in range(400, 1900)] + [(k, text("r", k), "rr") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, docs_per_language=100, chars_per_doc=60)
    words = {g: len(b" ".join(d).split()) for g, d in model.dictionaries.items()}
    assert 0.8 < words["qq"] / words["rr"] < 1.25
    opening = sum(b"opening" in d for d in b" ".join(model.dictionaries["rr"]).split(b"every page"))
    assert opening < 40  # under half of the pieces hold the opening
    copy = langid.normal(text("q", 7)).split()[-1]
    assert b" ".join(model.dictionaries["qq"]).split().count(copy) <= 1


def test_close_languages_are_rejected():
    twins = langid.Model({"aa": [b" the same words here"], "bb": [b" the same words here"]}).classifier()
    assert twins("the same words") == ("aa", 0.5, True)
