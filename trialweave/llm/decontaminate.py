"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment.

Items are partitioned by their number of shingles. Each class fixes how many minima of an item's hashed shingles are kept: so many
that an item whose containment reaches the threshold cannot lose them all. The documents, however long, are probed with their
shingle hashes under the largest kept minimum, and every candidate is verified by exact containment of the shingle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import let, stored, without

#: Kept minima up to which the index is sent to every executor (24 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def windows(w: Column, k: int, of) -> Column:
    """``of(words)`` for every window of ``k`` words."""
    first = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))
    return F.transform(first, lambda x, i: of([x, *[F.get(w, i + d) for d in range(1, k)]]))


def hashed(w: Column, k: int) -> Column:
    return windows(w, k, lambda x: F.xxhash64(*x))


def spelled(w: Column, k: int) -> Column:
    """Distinct shingle texts."""
    blank = F.lit(" ")
    return F.array_distinct(windows(w, k, lambda x: F.concat(*[y for z in x for y in (z, blank)][:-1])))


def needed(n: Column, threshold: float) -> Column:
    """Shingles that must be shared."""
    return F.greatest(F.lit(1), F.ceil(n * threshold - 1e-9).cast("int"))


def item_classes(items: DataFrame, item_id: str, text: str, shingle: int) -> DataFrame:
    """Distinct items: a key of their words, smallest id, number of equal items, width of their shingles (all words if fewer),
    shingle texts and hashes. Everything goes by the key, as ids may be null or stand for several texts.
    """
    base = items.select(F.col(item_id).alias("item_id"), plain_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    base = base.groupBy("w").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    base = base.withColumn("item", F.md5(F.array_join("w", " ").cast("binary")))
    base = base.withColumn("width", F.least(F.lit(shingle), F.size("w")))
    pick = lambda f: F.coalesce(*[F.when(F.col("width") == k, f(F.col("w"), k)) for k in range(1, shingle + 1)])
    return base.select("item", "item_id", "n_items", "width", pick(spelled).alias("shingles"), F.array_distinct(pick(hashed)).alias("hashes"))


def sketches(classes: DataFrame, threshold: float) -> DataFrame:
    """``item, width, hash, need``: the kept minima, and how many of them a containing document has at least.

    A class of items has from 2^c to 2^(c+1) - 1 shingles. It keeps one more than may be missing from its largest items, which
    leaves ``need`` of at least one for each of its items.
    """
    n = F.size("hashes")
    top = (F.pow(F.lit(2.0), F.floor(F.log2(n) + 1e-9) + 1) - 1).cast("int")
    keep = F.least(n, top - needed(top, threshold) + 1)
    kept = F.slice(F.sort_array("hashes"), 1, keep)
    need = F.greatest(F.lit(1), keep - (n - needed(n, threshold)))
    return classes.select("item", "width", need.alias("need"), F.explode(kept).alias("hash"))


def candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs ``key, item`` of documents (``key``, words ``w``) that hold enough kept minima of an item."""
    widths = {r[0]: r[1] for r in index.groupBy("width").agg(F.max("hash")).collect()}  # five rows at most
    if not widths:
        return docs.select("key").limit(0).withColumn("item", F.lit(""))
    few = index.count() <= BROADCAST_ROWS
    found = None
    for k, highest in sorted(widths.items()):
        probes = F.array_distinct(F.filter(hashed(F.col("w"), k), lambda h: h <= highest))  # noqa: B023
        rows = docs.select("key", F.explode(probes).alias("hash"))
        own = index.where(F.col("width") == k).select("item", "need", "hash")
        hits = rows.join(F.broadcast(own) if few else own, "hash")
        found = hits if found is None else found.unionByName(hits)
    hits = found.groupBy("key", "item", "need", "hash").agg(F.lit(1).alias("one"))  # copies of a document meet here
    return hits.groupBy("key", "item", "need").agg(F.count("*").alias("n")).where("n >= need").select("key", "item")


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    shingle: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """Pairs of documents and the items they contain: ``doc_id, item_id, n_items, n_shingles, n_shared, containment``, and the
    document's ``key``.

    Containment is the share of an item's distinct word shingles that the document has. Equal items are one row under their
    smallest id (null if none has one) with their number ``n_items``; different items under one id are a row each; items shorter than a shingle are one shingle of all their words; items and
    documents without words match nothing. Repeated documents give repeated rows, copies are looked up once.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("key"), F.col(text).alias("text"))
    classes = stored(item_classes(items, item_id, item_text, shingle), "items")
    index = stored(sketches(classes, threshold), "minima")
    found = stored(candidates(base.select("key", plain_words(F.col("text")).alias("w")), index), "candidates")
    asked = found.join(classes.select("item", "item_id", "n_items", "width", "shingles"), "item")
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("item_id", "n_items", "width", "shingles")).alias("items"))
    # Stored, so that the join reads nothing but exchanges and a text with very many copies can be split; merged at every size.
    docs_asked = base.join(stored(asked, "asked").hint("merge"), "key")
    widths = [r[0] for r in classes.select("width").distinct().collect()] or [shingle]

    def shared(w: Column) -> Column:
        sets = F.struct(*[spelled(w, k).alias(f"s{k}") for k in widths])
        size = lambda c, s: F.coalesce(*[F.when(c["width"] == k, F.size(F.array_intersect(c["shingles"], s[f"s{k}"]))) for k in widths])
        row = lambda c, s: F.struct(c["item_id"].alias("item_id"), c["n_items"].alias("n_items"), F.size(c["shingles"]).alias("n_shingles"), size(c, s).alias("n_shared"))
        return let(sets, lambda s: F.transform("items", lambda c: row(c, s)))

    rows = docs_asked.select("doc_id", "key", F.explode(let(plain_words(F.col("text")), shared)).alias("r")).select("doc_id", "key", "r.*")
    kept = rows.where(F.col("n_shared") >= needed(F.col("n_shingles"), threshold))
    return kept.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without those that contain an item. A column named ``__key`` is lost."""
    base = without(docs, "__key")
    bad = stored(leaks(base, items, text=text, **options).select(F.col("key").alias("__key")).distinct(), "leaks")
    keyed = base.withColumn("__key", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return keyed.join(bad, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in base.columns])
