"""Differences between the term distributions of sources, by three-dimensional cube partitioning.

Sources of a language are dealt to group blocks and its kept terms to term blocks. A cell (group block, group block, term block) gets
two slices of counts, adds up the divergence of every pair of its sources over its terms, and the partial sums are reduced along the
term axis. Slices are replicated once per group block, not once per source, and no cell is larger than two slices.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import stored

#: Letters in lower case and non-ASCII bytes stay; every other byte ends a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Parts of one.
UNIT = 1_000_000_000

GROUP = ["lang", "source"]


@dataclass(frozen=True)
class Shape:
    """Sizes of the cube: sources in a group block and terms in a term block, on average."""

    groups: int = 32
    terms: int = 4096


def term_counts(df: DataFrame, text: str, lang: str, source: str, held: int = 500_000) -> DataFrame:
    """``lang, source, term, n`` (occurrences), ``docs`` (rows with the term), once per group and term. Nulls are read as ''. Every group
    that occurs has a row for the term '' as well. Counts are added up where texts are read, for about ``held`` terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs: dict[tuple[str, str], Counter] = defaultdict(Counter)
        rows_with: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def emptied() -> Iterator[pa.RecordBatch]:
            for (of_lang, of_source), counts in occurs.items():
                terms, docs = list(counts), rows_with[of_lang, of_source]
                cols = [
                    pa.array([of_lang] * (len(terms) + 1), pa.string()), pa.array([of_source] * (len(terms) + 1), pa.string()),
                    pa.array([b"", *terms], pa.binary()).cast(pa.string()), pa.array([0, *counts.values()], pa.int64()),
                    pa.array([0, *(docs[t] for t in terms)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            occurs.clear()
            rows_with.clear()

        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                for t, *group in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found = (t or b"").translate(TERM_BYTES).split()
                    occurs[tuple(group)].update(found)
                    rows_with[tuple(group)].update(set(found))
                if sum(map(len, occurs.values())) >= held:
                    yield from emptied()
        yield from emptied()

    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = df.select(as_text(text).alias("text"), as_text(lang).alias("lang"), as_text(source).alias("source"))
    return read.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def part_of(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * n_terms)), in integers."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * whole(count + 5), whole(total + 5 * n_terms)) + 1


def cell_divergences(pdf: pd.DataFrame) -> pd.DataFrame:
    """``lang, one, other, value``: partial sums of one cell, each pair of sources once."""

    def dense(side: pd.DataFrame) -> np.ndarray:
        out = np.repeat(side["none"].to_numpy(dtype=np.int64)[:, None], int(pdf["width"].iloc[0]), axis=1)
        for row, (at, parts) in enumerate(zip(side["at"], side["parts"], strict=True)):
            out[row, np.asarray(at, dtype=np.int64)] = np.asarray(parts, dtype=np.int64)
        return out

    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    a, b = dense(left), dense(right)
    names, others = left["source"].to_numpy(dtype=object), right["source"].to_numpy(dtype=object)
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    out = []
    for k, name in enumerate(names):
        pick = np.flatnonzero(others > name) if same else np.arange(len(others))
        out.append(pd.DataFrame({"one": name, "other": others[pick], "value": np.abs(b[pick] - a[k]).sum(axis=1)}))
    made = pd.concat(out) if out else pd.DataFrame({"one": [], "other": [], "value": []})
    return made.assign(lang=pdf["lang"].iloc[0])[["lang", "one", "other", "value"]]


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, top: int = 50, shape: Shape = Shape()) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group (``lang``, ``source``) that occurs.

    Terms are stretches of ASCII letters and non-ASCII characters, A-Z in lower case; a language keeps the terms in at least
    ``min_docs`` of its rows. A group gives each kept term 1 + floor(10^9 * (count + 5) / (N + 5 * V)). Part ``pair`` ranks all other
    sources of the language by the sum of absolute differences, part ``term`` the ``top`` terms of the group whose part is above that of
    the language. Ties go by item.

    Nulls in the three columns are read as ''. Groups without terms are groups like any other; a language that keeps no term has
    pairs of value 0 and no terms. Repeated rows count each. An empty table gives an empty table.
    """
    counts = stored(term_counts(df, text, lang, source), "term-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs)
    kept = stored(kept.select("lang", "term", "total"), "kept-terms")
    terms_of = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / shape.terms)).cast("int")
    in_block = Window.partitionBy("lang", "t").orderBy("term")
    numbered = kept.join(terms_of, "lang").select("lang", "term", "total", block.alias("t")).withColumn("at", F.row_number().over(in_block) - 1)
    numbered = stored(numbered, "numbered-terms")
    counted = stored(counts.join(numbered, ["lang", "term"]).select(*GROUP, "term", "n", "total", "t", "at"), "counted-terms")

    totals = counted.groupBy(*GROUP).agg(F.sum("n").alias("n_group"))
    named = counts.where("term = ''").select(*GROUP)
    blocks_of = named.groupBy("lang").agg(F.ceil(F.count("*") / shape.groups).cast("int").alias("g_blocks"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = named.join(totals, GROUP, "left").join(blocks_of, "lang").join(terms_of, "lang", "left")
    groups = groups.withColumns({c: zero(c) for c in ("n_group", "v", "lang_total")}).withColumn("g", F.pmod(F.xxhash64("source"), F.col("g_blocks")).cast("int"))
    groups = stored(groups.withColumn("none", F.when(F.col("v") > 0, part_of(F.lit(0), F.col("n_group"), F.col("v"))).otherwise(0)), "groups")

    parts = counted.join(groups.select(*GROUP, "n_group", "v", "lang_total"), GROUP).withColumn("p", part_of(F.col("n"), F.col("n_group"), F.col("v")))
    above = parts.withColumn("value", F.col("p") - part_of(F.col("total"), F.col("lang_total"), F.col("v"))).where("n > 0 AND value > 0")
    above = above.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    slices = parts.groupBy(*GROUP, "t").agg(F.collect_list(F.struct("at", "p")).alias("s"))
    widths = numbered.groupBy("lang", "t").agg(F.count("*").alias("width"))
    axis = groups.select("lang").distinct().join(widths, "lang", "left").select("lang", zero(F.col("t")).alias("t"), zero(F.col("width")).alias("width"))
    grid = groups.select(*GROUP, "g", "g_blocks", "none").join(axis, "lang").join(slices, [*GROUP, "t"], "left")
    at = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    grid = grid.select("lang", "t", "width", "source", "none", "g", "g_blocks", at("s.at", "array<int>").alias("at"), at("s.p", "array<bigint>").alias("parts"))
    grid = stored(grid, "slices")
    held = ["lang", "t", "width", "source", "none", "at", "parts"]
    left = grid.select(*held, F.lit(0).alias("side"), F.col("g").alias("i"), F.explode(F.sequence(F.col("g"), F.col("g_blocks") - 1)).alias("j"))
    right = grid.select(*held, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("g"))).alias("i"), F.col("g").alias("j"))
    cells = left.unionByName(right).groupBy("lang", "i", "j", "t").applyInPandas(cell_divergences, "lang string, one string, other string, value long")
    whole = cells.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    pair = lambda a, b: whole.select("lang", F.col(a).alias("source"), F.lit("pair").alias("part"), F.col(b).alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item")))
    pairs = pair("one", "other").unionByName(pair("other", "one")).withColumn("rank", ranked)
    return pairs.unionByName(above.withColumn("rank", ranked).where(F.col("rank") <= top))
