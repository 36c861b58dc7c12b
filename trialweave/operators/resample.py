"""Bootstrap and permutation jobs with reproducible hash draws.

Draws are rows: iterations spread over the cluster, each resampled slot is one exploded row that is added up where it is
made, and only the (iteration, group) sums are shuffled.  Trials are reduced to counts per session and arm first, so a draw
looks up four numbers instead of joining a trial table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trialweave.functions import draws, skew
from trialweave.operators import opto
from trialweave.operators import stats as st


#: So many rows of a task are hashed at once, and drawn rows meet theirs in blocks of so many.
ROWS_AT_ONCE = 1 << 16
#: Drawn subjects meet theirs in blocks of so many subjects and iterations; a row draws for so many slots; so many sessions are worked on at once.
SUBJECTS, ITERATIONS, SLOTS, SESSIONS = 1 << 10, 128, 1 << 20, 1 << 19
#: A border of drawn rows is looked for within so many standard deviations.
DEVIATIONS = 8

Keep = Callable[[str, DataFrame], DataFrame]


def iterations(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "iter")


def indexed(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """0-based index of each row in its group and the group size: in the order of a number, or of a text's hash and the text."""
    if df.schema[order].dataType.typeName() == "string":
        u = draws.u32(F.col(order))
        out = skew.number_rows(df.withColumn("__u", u), keys, [F.col("__u"), F.col(order)], F.shiftright("__u", 20), "__i", f"n_{name}").drop("__u")
    else:
        out = skew.number_rows(df, keys, [F.col(order)], skew.position_block(F.col(order)), "__i", f"n_{name}")
    return out.withColumn(name, F.col("__i") - 1).drop("__i")


def _tasks(spark: SparkSession) -> int:
    """Tasks for rows that are drawn many times each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def slots(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def session_cells(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per session: trials and right answers of each arm."""
    o, c = F.col("OptoEnabled"), F.col("ChoiceCorrect")
    return trials.groupBy("Name", "SessId", *keys).agg(
        F.count_if((o == 1) & (c == 1)).alias("o1"), F.count_if(o == 1).alias("o"), F.count_if((o == 0) & (c == 1)).alias("c1"), F.count_if(o == 0).alias("c")
    )


@dataclass
class Drawn:
    """Sessions drawn by some slots of some iterations: a slot (``iter``, ``slot``) drew a subject, each of its ``sess_slot`` a session."""

    at: np.ndarray  # of each drawn session, its slot
    iter: np.ndarray  # per slot
    slot: np.ndarray
    sess_slot: np.ndarray  # per drawn session
    first: np.ndarray  # the drawn session's cells begin here
    many: np.ndarray

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Drawn session and cell of each drawn cell."""
        who = np.repeat(np.arange(len(self.first)), self.many)
        return who, self.first[who] + np.arange(len(who)) - (np.cumsum(self.many) - self.many)[who]


Work = Callable[[Drawn, pa.Table], "dict[str, np.ndarray | pa.Array]"]


def _subjects_dealt(tag: str):
    """A function on Arrow batches of (iter, first, n): the subjects that ``SLOTS`` slots from ``first`` draw, a row per block of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for it, first, n in zip(*(batch[c].to_pylist() for c in ("iter", "first", "n")), strict=True):
                slot = np.arange(first, min(first + SLOTS, n))
                subj = draws.hashes(1, len(slot), f"{tag}1|{it}".encode(), slot)[0] % n
                yield _blocks(subj, SUBJECTS, {"iter": it, "first": first, "part": it // ITERATIONS}, {"slots": (slot - first).astype("<u4")})

    return work


def _blocks(drawn: np.ndarray, size: int, same: dict[str, object], beside: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Drawn numbers as a row per block of ``size`` numbers, packed with what lies beside them."""
    block = drawn // size
    order = np.argsort(block, kind="stable")
    at = np.flatnonzero(np.diff(block[order], prepend=-1))
    pack = lambda x: pa.array([y.tobytes() for y in np.split(x[order], at[1:])], pa.binary())
    cols = {k: pa.array([v] * len(at)) for k, v in same.items()} | {"block": pa.array(block[order][at].astype(np.int64)), "places": pack((drawn % size).astype("<u2"))}
    cols |= {k: pack(v) for k, v in beside.items()}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _unpacked(table: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a packed column, and of each its row."""
    held = [np.frombuffer(x, kind) for x in table[column].to_pylist()]
    return np.concatenate(held).astype(np.int64), np.repeat(np.arange(len(held)), [len(x) for x in held])


def _at_subjects(tag: str, work: Work, schema: pa.Schema):
    """A function on a block's draws and its cells: ``work`` on the sessions that are drawn, some slots at a time."""

    def drawn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        cells = right.sort_by([("subj", "ascending"), ("sess", "ascending")]).combine_chunks()
        subj, sess = (cells[c].to_numpy() for c in ("subj", "sess"))
        new = np.r_[True, (np.diff(subj) != 0) | (np.diff(sess) != 0)]
        first = np.flatnonzero(new)  # cells of a session
        many = np.diff(np.r_[first, len(subj)])
        n_sess = np.bincount(subj[first] % SUBJECTS, minlength=SUBJECTS)
        base = np.cumsum(n_sess) - n_sess
        place, row = _unpacked(left, "places", "<u2")
        slot = _unpacked(left, "slots", "<u4")[0] + left["first"].to_numpy()[row]
        it = left["iter"].to_numpy()[row]
        upto, out, done = np.cumsum(n_sess[place]), [], 0
        while done < len(place):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + SESSIONS, side="right")))
            p, i, s = place[done:end], it[done:end], slot[done:end]
            k = n_sess[p]
            at = np.repeat(np.arange(len(p)), k)
            sess_slot = np.arange(len(at)) - (np.cumsum(k) - k)[at]
            pick = draws.hashes(1, len(at), f"{tag}2".encode(), i[at], s[at], sess_slot)[0].astype(np.int64) % k[at]
            one = base[p][at] + pick
            out.append(pa.table(work(Drawn(at, i, s, sess_slot, first[one], many[one]), cells), schema=schema))
            done = end
        return pa.concat_tables(out)

    return drawn


def _drawn(spark: SparkSession, cells: DataFrame, n_iter: int, tag: str, work: Work, schema: T.StructType) -> DataFrame:
    """Subjects drawn with replacement, then each one's sessions with all their cells, and ``work`` on these where they lie.

    Slots draw their subjects by hashes; the draws, a few bytes each, are dealt to blocks of subjects and iterations, where the cells of the
    subjects lie. Neither side is ever broadcast, and drawn sessions leave a block only as ``work`` returns them.
    """
    sess = indexed(cells.select("Name", "SessId").distinct(), ["Name"], "SessId", "sess")
    subj = indexed(cells.select("Name").distinct().withColumn("__all", F.lit(1)), ["__all"], "Name", "subj").select("Name", "subj")
    held = skew.key_join(skew.key_join(cells, sess.drop("n_sess"), ["Name", "SessId"]), subj, ["Name"])
    block = skew.position_block(F.col("subj"), SUBJECTS).alias("block")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_iter - 1) // ITERATIONS).cast("long"))).alias("part")
    held = held.select(block, parts, *[c for c in held.columns if c not in ("Name", "SessId")])
    size = cells.select("Name").distinct().agg(F.count(F.lit(1)).alias("n"))
    it = skew.attach(iterations(spark, n_iter), size, []).filter("n > 0")
    it = it.select("iter", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS).cast("long"))).alias("first"), "n")
    dealt = it.mapInArrow(_subjects_dealt(tag), "iter long, first long, part long, block long, places binary, slots binary")
    return _meet(spark, dealt, held, ["block", "part"], _at_subjects(tag, work, to_arrow_schema(schema)), schema)


def _meet(spark: SparkSession, dealt: DataFrame, held: DataFrame, keys: Sequence[str], work, schema: T.StructType) -> DataFrame:
    """``work`` on the packed draws and the rows of each block. So many tasks whatever the rows take: rows are drawn many times."""
    left, right = (x.repartition(_tasks(spark), *keys).groupBy(*keys) for x in (dealt, held))
    return left.cogroup(right).applyInArrow(work, schema)


def _session_draws(spark: SparkSession, cells: DataFrame, n_iter: int, tag: str) -> DataFrame:
    """(iter, slot, sess_slot and the columns of a cell): subjects with replacement, then each one's sessions with all their cells."""
    kept = [f for f in cells.schema if f.name not in ("Name", "SessId")]

    def rows(d: Drawn, held: pa.Table) -> dict:
        who, cell = d.cells()
        return {"iter": d.iter[d.at[who]], "slot": d.slot[d.at[who]], "sess_slot": d.sess_slot[who], **{f.name: held[f.name].take(pa.array(cell)) for f in kept}}

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("iter", "slot", "sess_slot")] + kept)
    return _drawn(spark, cells, n_iter, tag, rows, schema)


def hierarchical_bootstrap(spark: SparkSession, trials: DataFrame, n_iter: int = 10_000, metric: str = "Gain", each_trial: bool = False) -> DataFrame:
    """Effect per iteration after resampling subjects, their sessions, and the trials of those with their labels.

    Of a session's resampled trials only four counts matter; they are drawn by three conditional binomials, so an iteration costs
    sessions, not trials. With ``each_trial`` every resampled trial is a draw of its own, added up where it is made.
    """
    arms = ("o", "o1", "c", "c1")

    def counted(d: Drawn, held: pa.Table) -> dict:
        cell = [held[c].to_numpy()[d.first] for c in arms]  # a session has one cell
        places = d.iter[d.at], d.slot[d.at], d.sess_slot
        if each_trial:
            o, o1, c1 = draws.trial_counts(b"b3", places, *cell)
        else:
            o, o1, c1 = draws.arm_quantiles(*cell, *(u / float(1 << 32) for u in draws.hashes(3, len(d.at), b"b3", *places)))
        its, at = np.unique(places[0], return_inverse=True)
        total = lambda x: np.bincount(at, weights=x, minlength=len(its)).astype(np.int64)
        return dict(zip(("iter", *arms), (its, *map(total, (o, o1, cell[0] + cell[2] - o, c1))), strict=True))

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("iter", *arms)])
    d = _drawn(spark, session_cells(trials, []), n_iter, "b", counted, schema)
    effect = opto.effect_size(F.col("c1") / F.nullif(F.col("c"), F.lit(0)), F.col("o1") / F.nullif(F.col("o"), F.lit(0)), metric).alias("effect")
    return d.groupBy("iter").agg(*[F.sum(c).alias(c) for c in arms]).select("iter", effect)


def sign_p(observed: Column, value: Column) -> Column:
    """Two-sided share of draws whose sign differs from the observed effect (an aggregate)."""
    other = F.when(observed > 0, value < 0).when(observed < 0, value > 0)
    return F.when(F.max(observed) == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.count_if(other) / F.count(value)))


def _subject_effects(tag: str) -> Work:
    """Work on drawn sessions: each arm of a session block resampled with replacement, a binomial count per arm; sums of the slots' effects."""

    def work(d: Drawn, held: pa.Table) -> dict:
        arm = {c: held[c].to_numpy() for c in ("o", "o1", "c", "c1")}
        names = [held[c].combine_chunks().dictionary_encode() for c in ("Region", "Phase")]
        region, phase = (x.indices.to_numpy() for x in names)
        tables = {n: draws.Binomials(arm[n], arm[f"{n}1"], arm[n]) for n in "oc"}
        who, cell = d.cells()
        its, at_iter = np.unique(d.iter, return_inverse=True)
        out = []
        for r, p in np.unique(np.stack([region, phase], axis=1), axis=0).tolist():
            mine = np.flatnonzero((region[cell] == r) & (phase[cell] == p))
            who_m, cell_m = who[mine], cell[mine]
            at = d.at[who_m]
            block = [x.dictionary[k].as_py() for x, k in zip(names, (r, p), strict=True)]
            u = draws.hashes(2, len(at), tag.encode(), d.iter[at], d.slot[at], d.sess_slot[who_m], *[x.encode() for x in block])
            total = lambda x: np.bincount(at, weights=x, minlength=len(d.iter))  # noqa: B023, E731
            n, right = ([total(x) for x in xs] for xs in (
                [arm[k][cell_m] for k in "co"], [tables[k].draw(cell_m, x) for k, x in (("c", u[1]), ("o", u[0]))]
            ))
            seen = (n[0] > 0) & (n[1] > 0) & (right[0] > 0)
            control, stimulated = ((k[seen] / m[seen]) for k, m in zip(right, n, strict=True))
            effect = np.round(-100 * (stimulated / control - 1), 9)
            count = np.bincount(at_iter[seen], minlength=len(its))
            value = np.bincount(at_iter[seen], weights=effect, minlength=len(its))
            out.append({"iter": its, "Region": np.full(len(its), block[0], object), "Phase": np.full(len(its), block[1], object), "n": count, "total": value})
        return {c: np.concatenate([x[c] for x in out]) for c in out[0]}

    return work


def region_means(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, Phase, stat, value): mean subject effect of each region."""
    return entries.filter("effect is not null").groupBy(*keys, "Phase", F.col("Region").alias("stat")).agg(F.avg("effect").alias("value"))


def region_gap(effects: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Rows (keys, Phase, 'Delta', value): difference of the regions' 20 %-trimmed mean session effects."""
    return _gap(st.trimmed_mean(effects, [*keys, "Phase", "Region"], "effect", 0.2, tie), keys)


def _gap(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = {r: F.max(F.when(F.col("Region") == r, F.col("trimmed_mean"))) for r in ("MFC", "LFC")}
    g = t.groupBy(*keys, "Phase").agg((side["MFC"] - side["LFC"]).alias("value"))
    return g.filter("value is not null").select(*keys, "Phase", F.lit("Delta").alias("stat"), "value")


def _rows_dealt(tag: str, keys: Sequence[str]):
    """A function on Arrow batches of (iter, first, n, keys): the rows that ``SLOTS`` slots from ``first`` draw, a row per block of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                slot = np.arange(r["first"], min(r["first"] + SLOTS, r["n"]))
                start = "|".join([tag, str(r["iter"]), *[r[k] for k in keys]]).encode()
                i = draws.hashes(1, len(slot), start, slot)[0] % r["n"]
                yield _blocks(i, ROWS_AT_ONCE, {"iter": r["iter"], **{k: r[k] for k in keys}, "part": r["iter"] // ITERATIONS}, {})

    return work


def _at_rows(keys: Sequence[str], value: str, schema: pa.Schema):
    """A function on a block's draws and its rows (``i``, a value, a zone): how often each zone, or each value of an open (odd) zone, is drawn."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        place, row = _unpacked(left, "places", "<u2")
        its, at = np.unique(left["iter"].to_numpy(), return_inverse=True)
        zone, v = (right[c].to_numpy() for c in ("zone", value))
        entries, code = np.unique(np.stack([zone, np.where(zone % 2 == 1, v, 0.0)], axis=1), axis=0, return_inverse=True)
        where = right["i"].to_numpy() % ROWS_AT_ONCE
        of, worth = np.full(ROWS_AT_ONCE, len(entries)), np.zeros(ROWS_AT_ONCE)
        of[where], worth[where] = code.ravel(), v
        size = len(entries) + 1  # the last: rows without a value
        both = at[row] * size + of[place]
        n = np.bincount(both, minlength=size * len(its)).reshape(len(its), size)[:, :-1]
        total = np.bincount(both, weights=worth[place], minlength=size * len(its)).reshape(len(its), size)[:, :-1]
        it, entry = np.nonzero(n)
        same = {k: pa.array([left[k][0].as_py()] * len(it)) for k in keys}
        cols = {"iter": its[it], **same, "zone": entries[entry, 0].astype(np.int64), "v": entries[entry, 1], "n": n[it, entry], "total": total[it, entry]}
        return pa.table(cols, schema=schema)

    return work


def _drawn_trimmed_means(spark: SparkSession, rows: DataFrame, keys: Sequence[str], value: str, tie: str, n_iter: int, tag: str) -> DataFrame:
    """20 %-trimmed mean of each iteration's rows, drawn with replacement per ``keys``; rows without a value may be drawn but do not count.

    The places of the two cuts among the ordered rows are known but for a few deviations. Draws are dealt to blocks of rows and counted there:
    a zone surely kept or cut is one sum, and only near the cuts (zones 1 and 3) values are listed with their counts. A cut outside of its zone
    would be an error, never another result.
    """
    keys = list(keys)
    idx = indexed(rows.select(*keys, tie, value), keys, tie, "i")
    n = idx.groupBy(*keys).agg(F.max("n_i").alias("n"))
    ranked = skew.number_rows(idx.filter(F.col(value).isNotNull()), keys, [F.col(value), F.col("i")], skew.value_block(F.col(value)), "r", "n_r")
    share, reach = F.col("r") / F.col("n_r"), (DEVIATIONS * F.sqrt(0.16 * F.col("n_r")) + 20) / F.col("n_r")
    zone = F.when(share < 0.2 - reach, 0).when(share <= 0.2 + reach, 1).when(share < 0.8 - reach, 2).when(share <= 0.8 + reach, 3).otherwise(4).cast("long")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_iter - 1) // ITERATIONS).cast("long")))
    held = ranked.select(*keys, skew.position_block(F.col("i"), ROWS_AT_ONCE).alias("block"), "i", value, zone.alias("zone"), parts.alias("part"))
    it = n.withColumn("iter", slots(F.lit(n_iter))).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS).cast("long"))))
    kinds = T.StructType([f for f in idx.schema if f.name in keys])
    schema = T.StructType([T.StructField("iter", T.LongType()), *kinds])
    packed = T.StructType([*schema.fields]).add("part", "long").add("block", "long").add("places", "binary")
    dealt = it.repartition(_tasks(spark), *keys, "iter", "first").mapInArrow(_rows_dealt(tag, keys), packed)
    for c, kind in (("zone", "long"), ("v", "double"), ("n", "long"), ("total", "double")):
        schema = schema.add(c, kind)
    d = _meet(spark, dealt, held, [*keys, "block", "part"], _at_rows(keys, value, to_arrow_schema(schema)), schema)
    d = d.groupBy("iter", *keys, "zone", "v").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    w = Window.partitionBy("iter", *keys)
    d = d.withColumns({"__upto": F.sum("n").over(w.orderBy("zone", "v").rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("n").over(w)})
    low = F.expr("__n div 5")
    kept = F.greatest(F.lit(0), F.least(F.col("__upto"), F.col("__n") - low) - F.greatest(F.col("__upto") - F.col("n"), low))
    open_, met = F.col("zone") % 2 == 1, kept == F.when(F.col("zone") == 2, F.col("n")).otherwise(0)
    d = d.withColumn("__kept", F.when(open_ | met, kept).otherwise(F.raise_error(F.lit("a cut of drawn rows lies outside of its zone"))))
    part = F.when(open_, F.col("__kept") * F.col("v")).when(F.col("zone") == 2, F.col("total")).otherwise(0.0)
    return d.groupBy("iter", *keys).agg((F.sum(part) / F.sum("__kept")).alias("trimmed_mean"))


def two_region_bootstrap(spark: SparkSession, trials: DataFrame, n_iter: int = 10_000, keep: Keep = lambda name, df: df) -> DataFrame:
    """Observed region means and their difference per phase, with bootstrap deviation, 95 % interval and sign p.

    Subject effects resample subjects, sessions and trials (each arm apart, as binomial counts); the difference resamples sessions
    within phase and region. ``keep`` may store the tables that several branches read: counts per session, and values per iteration.
    """
    cells = keep("cells", session_cells(trials, ["Region", "Phase"]))
    c, o = F.col("cm"), F.col("om")
    eff = F.round(opto.effect_size(c, o), 9)
    # observed
    means = cells.groupBy("Name", "Region", "Phase").agg((F.sum("c1") / F.nullif(F.sum("c"), F.lit(0))).alias("cm"), (F.sum("o1") / F.nullif(F.sum("o"), F.lit(0))).alias("om"))
    sess = cells.withColumns({"cm": F.expr("c1 / nullif(c, 0)"), "om": F.expr("o1 / nullif(o, 0)")}).withColumn("effect", eff)
    obs = region_means(means.withColumn("effect", eff), []).unionByName(region_gap(sess, [], ["SessId"]))
    # subject effects per iteration
    sums = T.StructType([T.StructField("iter", T.LongType()), T.StructField("Region", T.StringType()), T.StructField("Phase", T.StringType())])
    sums = sums.add("n", "long").add("total", "double")
    d = _drawn(spark, cells, n_iter, "r", _subject_effects("r3"), sums)
    boot = d.groupBy("iter", "Phase", F.col("Region").alias("stat")).agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("value")).filter("value is not null")
    # session effects per iteration
    t = _drawn_trimmed_means(spark, sess, ["Phase", "Region"], "effect", "SessId", n_iter, "r4")
    boot = keep("boot", boot.unionByName(_gap(t, ["iter"])))
    key = ["Phase", "stat"]
    ci = skew.exact_percentiles(boot, key, "value", {"ci_low": 0.025, "ci_high": 0.975})
    j = boot.join(obs.withColumnRenamed("value", "observed"), key)
    s = j.groupBy(*key, "observed").agg(F.stddev_samp("value").alias("sd"), sign_p(F.col("observed"), F.col("value")).alias("p"))
    return st.holm(s.join(ci, key), ["Phase"], "p", ["stat"])


def hypergeometric_table(cells: DataFrame) -> DataFrame:
    """For each distinct (n, r, o) and k the range ``lo`` to ``hi`` of a uniform draw for which k of the r right answers are among o
    of n; the ranges of k follow one another.

    Only k within 12 standard deviations of the mode are tabled: the others have far less than the 2^-32 grain of a draw.
    """
    n, r, o = (F.col(c).cast("double") for c in ("n", "r", "o"))
    reach = 12 * F.sqrt(o * (r / n) * ((n - r) / n) * ((n - o) / F.greatest(n - 1, F.lit(1.0)))) + 20
    mode = (o + 1) * (r + 1) / (n + 2)
    low = F.greatest(F.lit(0).cast("long"), F.col("o") - (F.col("n") - F.col("r")), F.floor(mode - reach))
    k = F.sequence(low, F.least(F.col("r"), F.col("o"), F.ceil(mode + reach)))
    t = cells.select("n", "r", "o").distinct().withColumn("k", F.explode(k))
    ratio = (F.col("r") - F.col("k") + 1).cast("double") * (F.col("o") - F.col("k") + 1) / (F.col("k").cast("double") * (F.col("n") - F.col("r") - F.col("o") + F.col("k")))
    w = Window.partitionBy("n", "r", "o").orderBy("k")  # grows with the root of a session's trials
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("n", "r", "o")
    first = F.row_number().over(w) == 1
    t = t.withColumn("__l", F.when(first, F.lit(0.0)).otherwise(F.ln(ratio))).withColumn("__l", F.sum("__l").over(upto))
    t = t.withColumn("__p", F.exp(F.col("__l") - F.max("__l").over(whole)))
    t = t.withColumns({"hi": F.sum("__p").over(upto) / F.sum("__p").over(whole), "__last": F.lead("k").over(w).isNull()})
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))
    return t.select("n", "r", "o", "k", "lo", F.when(F.col("__last"), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))


def hypergeometric_parts(cells: DataFrame) -> DataFrame:
    """For each distinct (n, r, o) its table as ``parts``: 0 to 1 in as many equal parts as there are rows, and in each the rows (k, hi) that it meets."""
    grain, size = F.lit(float(1 << 32)), ["n", "r", "o"]
    part = lambda x: F.least(F.floor(x * F.col("__m")), F.col("__m") - 1)
    t = hypergeometric_table(cells).where(F.ceil(F.col("lo") * grain) < F.ceil(F.col("hi") * grain))  # others meet no draw
    t = t.withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(*size)))
    t = t.withColumn("__part", F.explode(F.sequence(part(F.col("lo")), part(F.col("hi")))))
    rows = t.groupBy(*size, "__part").agg(F.array_sort(F.collect_list(F.struct("k", "hi"))).alias("rows"))
    whole = rows.groupBy(*size).agg(F.array_sort(F.collect_list(F.struct("__part", "rows"))).alias("__p"))
    return whole.select(*size, F.transform("__p", lambda x: x["rows"]).alias("parts"))


def tabled(parts: Column, u: Column) -> Column:
    """The k of a draw ``u`` of 32 bits, below 1; inside a lambda ``u`` is to be a variable, as each row of a part is compared with it."""
    at = F.least(F.floor(u * F.size(parts)), F.size(parts) - 1).cast("int")
    return F.get(F.filter(F.get(parts, at), lambda x: u < x["hi"]), F.lit(0))["k"]


def hypergeometric_draws(d: DataFrame) -> DataFrame:
    """``d`` (n, r, o and a draw ``u`` of 32 bits, below 1) with ``k``."""
    size = ["n", "r", "o"]
    return skew.key_join(d, hypergeometric_parts(d), size).withColumn("k", tabled(F.col("parts"), F.col("u"))).drop("parts")


def max_statistic_permutation(spark: SparkSession, trials: DataFrame, n_iter: int = 10_000) -> DataFrame:
    """Adjusted p from permutation maxima, within each phase and over both: mean effect of each region and their difference.

    An iteration deals the arms again within every session, and of that the number of right answers among the stimulated trials
    is all that matters: a hypergeometric draw per session. The resulting subject effects then get permuted region labels
    (subjects with both regions swap them or not, the others are dealt theirs), and all three statistics come from these. The
    difference needs two subjects in each region; sessions with one arm only take part in the observed effects alone.
    """
    blk = ["Name", "Region", "Phase"]
    o, c = F.col("OptoEnabled"), F.col("ChoiceCorrect")
    cells = trials.groupBy("Name", "SessId", "Region", "Phase").agg(F.count(F.lit(1)).alias("n"), F.count_if(c == 1).alias("r"), F.count_if(o == 1).alias("o"), F.count_if((o == 1) & (c == 1)).alias("k"))

    def effects(d: DataFrame, keys: Sequence[str]) -> DataFrame:
        on, right, seen, hit = F.sum("o"), F.sum("k"), F.sum(F.col("n") - F.col("o")), F.sum(F.col("r") - F.col("k"))
        gap = F.round(hit / F.nullif(seen, F.lit(0)) - right / F.nullif(on, F.lit(0)), 9)
        return d.groupBy(*keys, *blk).agg(gap.alias("effect")).filter("effect is not null")

    def statistics(e: DataFrame, keys: Sequence[str]) -> DataFrame:
        m = {r: F.avg(F.when(F.col("Region") == r, F.col("effect"))) for r in ("MFC", "LFC")}
        n = {r: F.count_if(F.col("Region") == r) for r in ("MFC", "LFC")}
        cross = F.when((n["MFC"] >= 2) & (n["LFC"] >= 2), m["MFC"] - m["LFC"])
        g = e.groupBy(*keys, "Phase").agg(m["MFC"].alias("MFC"), m["LFC"].alias("LFC"), cross.alias("crossregion"))
        return g.select(*keys, "Phase", F.expr("stack(3, 'MFC', MFC, 'LFC', LFC, 'crossregion', crossregion) as (stat, value)")).filter("value is not null")

    obs = statistics(effects(cells, []), [])
    # A subject's sessions of a region and phase are one row with the tables of their draws: an iteration is drawn and added up where the
    # row lies, and only sums per iteration are shuffled.
    size = ["n", "r", "o"]
    dealt = cells.filter("o > 0 and o < n").drop("k")
    held = skew.key_join(dealt, hypergeometric_parts(dealt), size)
    blocks = held.groupBy(*blk).agg(
        F.collect_list(F.struct("SessId", "parts")).alias("cells"), F.sum("o").alias("on"), F.sum(F.col("n") - F.col("o")).alias("seen"), F.sum("r").alias("right")
    )
    # Which subjects have an effect in which region does not depend on the draw.
    blocks = blocks.withColumn("paired", F.count(F.lit(1)).over(Window.partitionBy("Name", "Phase")) == 2)
    need = blocks.groupBy("Phase").agg(F.count_if((F.col("Region") == "MFC") & ~F.col("paired")).alias("need"))
    lone = skew.attach(blocks.filter("not paired"), need, ["Phase"], salt_on=["Name"])

    def drawn(b: DataFrame) -> DataFrame:
        # So many tasks whatever the rows take: each row is drawn ``n_iter`` times.
        d = b.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *blk).withColumn("iter", slots(F.lit(n_iter)))
        u = F.transform("cells", lambda x: draws.u32(F.lit("p1"), F.col("iter"), x["SessId"], F.col("Region"), F.col("Phase")) / F.lit(float(1 << 32)))
        k = F.aggregate(F.zip_with(u, F.col("cells"), lambda v, x: tabled(x["parts"], v)), F.lit(0).cast("long"), lambda s, x: s + x)
        d = d.withColumn("k", k).withColumn("u", draws.u32(F.lit("p2"), F.col("iter"), F.col("Phase"), F.col("Name")))
        gap = F.round((F.col("right") - F.col("k")) / F.col("seen") - F.col("k") / F.col("on"), 9)
        return d.select("iter", *[c for c in b.columns if c in (*blk, "need")], "u", gap.alias("effect"))

    singles = skew.number_rows(drawn(lone).drop("Region"), ["iter", "Phase"], [F.col("u"), F.col("Name")], F.shiftright("u", 20), "rn")
    given = singles.withColumn("Region", F.when(F.col("rn") <= F.col("need"), "MFC").otherwise("LFC"))
    other = F.when(F.col("Region") == "MFC", "LFC").otherwise("MFC")
    swapped = drawn(blocks.filter("paired")).withColumn("Region", F.when(F.col("u") < (1 << 31), other).otherwise(F.col("Region")))
    cols = ["iter", "Phase", "Region", "effect"]
    null = statistics(swapped.select(*cols).unionByName(given.select(*cols)), ["iter"])
    scope = F.explode(F.array(F.col("Phase"), F.lit("both")))
    top = null.select("iter", scope.alias("scope"), "value").groupBy("iter", "scope").agg(F.round(F.max(F.abs("value")), 9).alias("top"))
    wanted = obs.withColumn("scope", scope)
    beats = F.count_if(F.col("top") >= F.round(F.abs(F.col("value")), 9))
    p = wanted.join(top, "scope").groupBy("Phase", "stat", F.col("value").alias("observed"), "scope").agg(((1 + beats) / (1 + F.count(F.lit(1)))).alias("p"))
    own = F.col("scope") != "both"
    return p.groupBy("Phase", "stat", "observed").agg(F.max(F.when(own, F.col("p"))).alias("p_adjusted"), F.max(F.when(~own, F.col("p"))).alias("p_global"))


def _dealt_again(keys: Sequence[str], row: str, n_iter: int):
    """A function on Arrow batches: per iteration and group the sums over rows whose hash lies below ``__lo``, and each row up to ``__hi``."""

    def summed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = np.stack([table[k].combine_chunks().dictionary_encode("encode").indices.to_numpy() for k in keys])
        order = np.lexsort(codes[::-1])
        table, codes = table.take(pa.array(order)).combine_chunks(), codes[:, order]
        starts = np.flatnonzero(np.r_[True, (np.diff(codes, axis=1) != 0).any(axis=0)])
        lo, hi = (table[c].to_numpy().astype(np.uint32) for c in ("__lo", "__hi"))
        rank = table["mid_rank"].to_numpy().astype(float)
        ranked = ~np.isnan(rank)
        rank[~ranked] = 0.0
        names = table["__name"].to_pylist()
        sizes = np.array([len(x) for x in names])
        ends = []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            padded = b"".join(names[k].ljust(-(-size // 4) * 4, b"\0") for k in rows)
            ends.append((rows, size, np.ascontiguousarray(np.frombuffer(padded, "<u4").reshape(len(rows), -1).T)))
        mine = table.select([*keys, "n_left"])
        many = max(1, draws.AT_ONCE // len(table))
        for first in range(0, n_iter, many):
            its = np.arange(first, min(n_iter, first + many))
            u = np.empty((len(its), len(table)), np.uint32)
            for part, (length,) in draws.alike(its):
                for rows, size, words in ends:
                    t = draws.Texts(b"auc|").number(np.repeat(its[part], len(rows)), length)
                    for k, w in enumerate(words):
                        t.put(np.tile(w, len(part)), min(4, size - 4 * k))
                    u[np.ix_(part, rows)] = t.hashes(len(part) * len(rows))[0].reshape(len(part), -1)
            below = u < lo
            sums = [np.add.reduceat(x, starts, axis=1, dtype=kind).ravel() for x, kind in ((below, np.int64), (below & ranked, np.int64), (np.where(below, rank, 0.0), float))]
            its_near, near = np.nonzero(~below & (u <= hi))
            at = np.r_[np.tile(starts, len(its)), near]
            ids = table[row].take(pa.array(np.r_[np.zeros(len(sums[0]), np.int64), near], mask=np.arange(len(at)) < len(sums[0])))
            cols = [
                np.r_[np.repeat(its, len(starts)), its[its_near]], np.r_[np.full(len(sums[0]), -1), u[its_near, near]], np.r_[sums[0], np.ones(len(near), np.int64)],
                np.r_[sums[1], ranked[near]], np.r_[sums[2], rank[near]],
            ]
            held = [x.combine_chunks() for x in (*mine.take(pa.array(at)).columns, ids)]
            yield pa.RecordBatch.from_arrays([*held, *map(pa.array, cols)], [*keys, "n_left", row, "iter", "u", "n", "c", "s"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS_AT_ONCE:
                yield from summed(pa.Table.from_batches(held))
                held = []
        if held and sum(x.num_rows for x in held):
            yield from summed(pa.Table.from_batches(held))

    return work


def auc_permutation(df: DataFrame, keys: Sequence[str], value: str, left: Column, row: str, n_iter: int = 10_000) -> DataFrame:
    """Two-sided permutation p of the ROC area: sides dealt again per iteration, same side sizes.

    Mid-ranks do not depend on the sides, so an iteration needs their sum over the rows of the smallest hashes only. Where the border of
    the sides lies is known but for a few deviations of a uniform order statistic: rows are hashed where they lie, those surely before the
    border are added up there, and only the rows near it, about the root of a group, are shuffled and ordered. A border outside of its
    range would be an error, never another result.
    """
    keys = list(keys)
    spark = df.sparkSession
    used = df.withColumn("__l", left).filter("__l is not null").select(*keys, row, value, "__l")
    obs = st.rank_test(used, keys, value, F.col("__l")).select(*keys, F.col("auc").alias("observed"), "n_left")
    counts = used.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranks = skew.mid_ranks(counts, keys).select(*keys, F.col("v").alias(value), "mid_rank")
    const = obs.join(used.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("__rows"), F.count(value).cast("double").alias("__n")), keys)
    share = F.col("n_left") / F.col("__rows")
    reach = (DEVIATIONS * F.sqrt(F.col("n_left") * (1 - share)) + 20) / F.col("__rows")
    edge = lambda x: F.least(F.greatest(F.floor(x * F.lit(float(1 << 32))), F.lit(0)), F.lit((1 << 32) - 1))
    const = const.withColumns({"__lo": edge(share - reach), "__hi": edge(share + reach)})
    t = skew.attach(used.select(*keys, row, value).join(ranks, [*keys, value], "left"), const.drop("observed", "__rows", "__n"), keys, salt_on=[row], how="inner")
    name = F.coalesce(F.concat(F.lit("|"), F.col(row).cast("string")), F.lit("")).cast("binary").alias("__name")
    t = t.select(*keys, "n_left", row, name, "mid_rank", "__lo", "__hi")
    kinds = t.select(*keys, "n_left", row).schema
    for c, kind in (("iter", "long"), ("u", "long"), ("n", "long"), ("c", "long"), ("s", "double")):
        kinds = kinds.add(c, kind)
    # So many tasks whatever the rows take: each row is hashed ``n_iter`` times.
    d = t.repartition(_tasks(spark), row).mapInArrow(_dealt_again(keys, row, n_iter), kinds)
    group = ["iter", *keys]
    upto = Window.partitionBy(*group).orderBy("u", row).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__upto", F.sum("n").over(upto))
    mine, whole = F.col("__upto") <= F.col("n_left"), F.col("u") < 0
    null = d.groupBy(*group).agg(
        F.sum(F.when(mine, F.col("c"))).cast("double").alias("__n1"), F.sum(F.when(mine, F.col("s"))).alias("__s"),
        ((F.max("__upto") >= F.max("n_left")) & F.coalesce(F.max(F.when(whole, F.col("__upto"))) <= F.max("n_left"), F.lit(True))).alias("__met"),
    )
    null = null.withColumn("__n1", F.when(F.col("__met"), F.col("__n1")).otherwise(F.raise_error(F.lit("a border of dealt sides lies outside of its range"))))
    null = skew.key_join(null, const.select(*keys, "observed", "__n"), keys).filter("__n1 > 0 and __n1 < __n")
    auc = (F.col("__s") - F.col("__n1") * (F.col("__n1") + 1) / 2) / (F.col("__n1") * (F.col("__n") - F.col("__n1")))
    far = F.count_if(F.abs(auc - 0.5) >= F.abs(F.col("observed") - 0.5) - 1e-12)
    return null.groupBy(*keys, "observed").agg(((1 + far) / (1 + F.count(F.lit(1)))).alias("p"))


def bootstrap_rows(df: DataFrame, keys: Sequence[str], row: str, n_samples: int, with_replacement: bool, share: float = 1.0):
    """``n_samples`` samples of each group: drawn indexes joined back, or the first part of a hash-ordered shuffle."""
    if with_replacement:
        idx = indexed(df, keys, row, "i")
        n = idx.groupBy(*keys).agg(F.max("n_i").alias("n_i"))
        s = n.withColumn("sample", slots(F.lit(n_samples))).withColumn("slot", slots(F.floor(F.col("n_i") * share)))
        s = s.withColumn("i", draws.index(F.col("n_i"), F.lit("boot"), F.col("sample"), *map(F.col, keys), F.col("slot")))
        return s.drop("n_i").join(idx.drop("n_i").hint("merge"), [*keys, "i"])  # neither side is small, whatever is guessed of drawn rows
    t = df.withColumn("sample", slots(F.lit(n_samples)))
    t = t.withColumn("u", draws.u32(F.lit("boot"), F.col("sample"), F.col(row)))
    t = skew.number_rows(t, ["sample", *keys], [F.col("u"), F.col(row)], F.shiftright("u", 20), "rn", "n")
    return t.filter(F.col("rn") <= F.floor(F.col("n") * share))


def resample_sessions(spark: SparkSession, trials: DataFrame, factor: int, random_dv: bool = False) -> DataFrame:
    """Per subject: ``factor`` × its sessions drawn with replacement, valid trials drawn again under the old numbers."""
    valid = trials.filter("valid")
    t = indexed(valid, ["Name", "SessId"], "event_id", "i")
    sess = indexed(t.groupBy("Name", "SessId").agg(F.max("n_i").alias("n_i")), ["Name"], "SessId", "sess")
    n = sess.groupBy("Name").agg(F.max("n_sess").alias("n_sess"))
    s = n.withColumn("new_sess", slots(F.col("n_sess") * factor))
    s = s.withColumn("sess", draws.index(F.col("n_sess"), F.lit("rs1"), F.col("Name"), F.col("new_sess"))).drop("n_sess")
    s = skew.key_join(s, sess.select("Name", "sess", "SessId", "n_i"), ["Name", "sess"]).withColumn("k", slots(F.col("n_i")))
    s = s.withColumn("i", draws.index(F.col("n_i"), F.lit("rs2"), F.col("Name"), F.col("new_sess"), F.col("k"))).drop("n_i")
    old = t.select("SessId", F.col("i").alias("k"), "TrialNumber")
    new = t.select("SessId", "i", "DV", "calcStimulusTime", "ChoiceCorrect")
    out = skew.key_join(skew.key_join(s, old, ["SessId", "k"]), new, ["SessId", "i"])
    if random_dv:
        u = draws.u32(F.lit("rs3"), F.col("Name"), F.col("new_sess"), F.col("k")) / F.lit(float(1 << 32))
        out = out.withColumn("DV", 2 * u - 1)
    return out.select("Name", "new_sess", "TrialNumber", "DV", "calcStimulusTime", "ChoiceCorrect")
