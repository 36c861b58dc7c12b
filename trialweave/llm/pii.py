"""Personal data by weak supervision.

Fixed patterns give the base spans. Wider patterns give candidates of further kinds; regex, gazetteer and context labelers vote on
each (1, 0, or -1: no vote), expectation-maximisation estimates how reliable every labeler is from the vote patterns, and a naive
Bayes classifier of span features is trained on the estimated labels. Spans that it accepts are added to the base.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import let, without

# The base kinds in their order. A run of local-part characters or digits is entered at its start or where the last
# match ended, and quantifiers do not give back, so that long runs cost no more than short ones.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must stand in a text before its pattern is tried.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# Candidates of further kinds.
FURTHER = {
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "number": r"(?<![0-9A-Za-z+.(-])\([0-9]{2,4}\)[\x20-]?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}+(?![0-9A-Za-z])",
}
KINDS = (*BASE, *FURTHER)
# Words that announce the kinds, and known beginnings of credentials.
CUES = {
    "secret": r"(?i)(key|token|secret|passw|auth|credential|bearer|schlüssel|clave|clé)[^\n]{0,6}$",
    "number": r"(?i)(tel|phone|call|fax|mobile|cell|telefon|anruf|appel|llam|móvil)[^\n]{0,12}$",
}
CREDENTIALS = r"^(AKIA|ASIA|ghp_|gho_|sk-|pk-|hf_|xox[abp]-|AIza|eyJ)"
LABELERS = 5
AROUND = 24
ROUNDS = 25


def luhn(match: Column) -> Column:
    digits = F.translate(match, " -", "")
    value = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")  # noqa: E731  i: place from the right
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    part = lambda i: F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(match, r"\."), lambda p: F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255
        )
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        n = F.length(F.regexp_replace(match, "[^0-9]", ""))
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def found(text: Column, pattern: str) -> Column:
    """Matches with their places: array of start, end (code points, end exclusive) and match."""
    kind = "array<struct<start:int,end:int,match:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["piece"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), a["spans"]).otherwise(F.array_append(a["spans"], span)).alias("spans"))

    def zipped(m: Column) -> Column:
        pairs = F.zip_with(F.split(text, pattern), m, lambda p, q: F.struct(p.alias("piece"), q.alias("match")))
        return F.aggregate(pairs, start, step, lambda a: a["spans"])

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) > 0, zipped(m)).otherwise(F.array().cast(kind)))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, kind, end) of the base kinds, in order."""
    kinds = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        spans = F.filter(found(text, pattern), lambda s: valid(kind, s["match"]))  # noqa: B023
        row = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))  # noqa: B023
        none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
        kinds.append(F.when(F.contains(text, F.lit(SIGNS[kind])), row).otherwise(none) if SIGNS[kind] else row)
    return F.sort_array(F.concat(*kinds))


def votes(kind: str, match: Column, before: Column, after: Column) -> list[Column]:
    """One vote of each labeler: pattern, announcing words, known beginnings or area code, surroundings, composition."""
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    never, digits = F.lit(False), F.length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "secret":
        letters = F.length(F.regexp_replace(match, "[^A-Za-z]", ""))
        mixed = (digits >= 4) & (letters >= 4)
        variety = F.size(F.array_distinct(F.split(match, "")))
        return [
            vote(mixed, digits < 2),
            vote(before.rlike(CUES[kind]), never),
            vote(match.rlike(CREDENTIALS), never),
            vote(before.rlike("[\"'=:][\\x20\"']*$"), before.rlike(r"[\p{L},.][\x20\n]$") & after.rlike(r"^[\x20\n.,]")),
            vote((variety >= 10) & mixed, variety < 8),
        ]
    return [
        vote((digits >= 9) & (digits <= 12), (digits < 8) | (digits > 13)),
        vote(before.rlike(CUES[kind]), never),
        vote(match.rlike(r"^\([1-9][0-9]{2}\)"), match.rlike(r"^\(0+\)")),
        vote(before.rlike(r"(^|[\p{L},.:])[\x20\n]?$"), before.rlike(r"[$€£%=*/]\s?$") | after.rlike(r"^\s?[%€$£]")),
        vote(match.rlike(r"\)[\x20-]?[0-9]{3}[\x20.-][0-9]{4}$"), match.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}$")),
    ]


def features(match: Column, before: Column, after: Column) -> list[Column]:
    """Span features in few values each: length, share of digits, neighbours on either side."""
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    near = lambda c: (
        F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike("[\"'=:]"), "quote").otherwise("other")
    )
    return [
        F.concat(F.lit("length "), F.least(F.floor(F.length(match) / 8), F.lit(8)).cast("string")),
        F.concat(F.lit("digits "), F.floor(digits * 4 / F.length(match)).cast("string")),
        F.concat(F.lit("before "), near(F.right(before, F.lit(1)))),
        F.concat(F.lit("after "), near(F.left(after, F.lit(1)))),
    ]


def candidates(text: Column) -> Column:
    """Array of (start, rank, kind, end, votes, features) of the further kinds."""

    def of_kind(kind: str, rank: int):
        def row(s: Column) -> Column:
            before = F.substr(text, F.greatest(s["start"] - AROUND, F.lit(0)) + 1, F.least(s["start"], F.lit(AROUND)))
            after = F.substr(text, s["end"] + 1, F.lit(AROUND))
            around = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), before.alias("before"), after.alias("after"))
            full = lambda x: F.struct(
                x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"),
                F.array(*votes(kind, x["match"], x["before"], x["after"])).alias("votes"),
                F.array(*features(x["match"], x["before"], x["after"])).alias("features"),
            )
            return let(around, full)

        return row

    return F.concat(*[F.transform(found(text, p), of_kind(kind, len(BASE) + k)) for k, (kind, p) in enumerate(FURTHER.items())])


def reliabilities(patterns: Column) -> Column:
    """EM over an array of (votes, n): struct of the share ``pi`` of true spans and the chances ``a`` and ``b`` that a labeler that
    votes on a true and on a false span votes 1."""
    prior_a, prior_b = (8.0, 2.0), (2.0, 8.0)  # labelers are thought right four times in five before any vote is seen
    start = F.struct(F.lit(0.5).alias("pi"), F.array(*[F.lit(0.8)] * LABELERS).alias("a"), F.array(*[F.lit(0.2)] * LABELERS).alias("b"))

    def step(q: Column, _: Column) -> Column:
        total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda s, r: s + f(r))
        weight = {True: lambda r: r["n"] * r["p"], False: lambda r: r["n"] * (1 - r["p"])}
        voted = lambda r, j: F.get(r["votes"], F.lit(j))

        def chance(rows: Column, j: int, of: bool) -> Column:
            one, two = prior_a if of else prior_b
            yes = total(rows, lambda r: F.when(voted(r, j) == 1, weight[of](r)).otherwise(0.0))
            cast = total(rows, lambda r: F.when(voted(r, j) >= 0, weight[of](r)).otherwise(0.0))
            return (yes + one) / (cast + one + two)

        def next_(rows: Column) -> Column:
            share = (total(rows, weight[True]) + 1.0) / (total(rows, lambda r: r["n"].cast("double")) + 2.0)
            return F.struct(
                share.alias("pi"),
                F.array(*[chance(rows, j, True) for j in range(LABELERS)]).alias("a"),
                F.array(*[chance(rows, j, False) for j in range(LABELERS)]).alias("b"),
            )

        rows = F.transform(patterns, lambda r: F.struct(r["votes"].alias("votes"), r["n"].alias("n"), posterior(r["votes"], q).alias("p")))
        return let(rows, next_)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def posterior(cast: Column, q: Column) -> Column:
    """Chance that a span with these votes is true."""
    odds = F.log(q["pi"] / (1 - q["pi"]))
    for j in range(LABELERS):
        v, a, b = F.get(cast, F.lit(j)), F.get(q["a"], F.lit(j)), F.get(q["b"], F.lit(j))
        odds = odds + F.when(v == 1, F.log(a / b)).when(v == 0, F.log((1 - a) / (1 - b))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


@dataclass(frozen=True)
class Model:
    """Log odds of the kinds and of kind-feature pairs (``kind|feature``)."""

    prior: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def accepts(self, c: Column) -> Column:
        if not self.prior:
            return F.lit(False)
        table = lambda d: F.create_map(*[F.lit(x) for k, v in sorted(d.items()) for x in (k, v)])
        weight = lambda f: F.coalesce(F.try_element_at(table(self.weights), F.concat(c["kind"], F.lit("|"), f)), F.lit(0.0))
        start = F.coalesce(F.try_element_at(table(self.prior), c["kind"]), F.lit(-40.0))
        return F.aggregate(c["features"], start, lambda a, f: a + weight(f)) > 0


def tallies(df: DataFrame, text: str) -> DataFrame:
    """Candidates counted by kind, votes and features: as many rows as there are combinations, however many documents."""
    each = df.select(F.explode(candidates(F.coalesce(text, F.lit("")))).alias("c"))
    return each.groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))


def fit(df: DataFrame, text: str = "text") -> Model:
    """Reliabilities from all candidates of all documents, then the classifier; a few hundred numbers reach the driver."""
    seen = tallies(df, text)
    by_votes = seen.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    sets = by_votes.groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("patterns"))
    fitted = sets.select("kind", reliabilities(F.sort_array("patterns")).alias("q"))
    soft = seen.join(F.broadcast(fitted), "kind").withColumn("p", posterior(F.col("votes"), F.col("q")))  # a row for each kind
    share = [F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")]
    rows = soft.select("kind", "n", "p", F.explode(F.array_append("features", F.lit(""))).alias("feature")).groupBy("kind", "feature").agg(*share).collect()
    of = {r["kind"]: (r["yes"], r["no"]) for r in rows if r["feature"] == ""}
    prior = {k: math.log((yes + 1) / (no + 1)) for k, (yes, no) in of.items()}
    weights = {}
    for r in rows:
        if r["feature"]:
            yes, no = of[r["kind"]]
            weights[f"{r['kind']}|{r['feature']}"] = math.log((r["yes"] + 0.5) / (yes + 4)) - math.log((r["no"] + 0.5) / (no + 4))
    return Model(prior, weights)


def find(df: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with ``base`` and ``spans`` (their names after ``prefix``): arrays of (start, rank, kind, end) by start and kind, code points, end exclusive.

    ``spans`` holds all of ``base`` and the accepted candidates that overlap none of it. Null text is empty. Rows are independent
    and whole texts are read: there is no shuffle. Columns of these names are replaced.
    """
    whole = F.coalesce(text, F.lit(""))
    base_name, name = f"{prefix}base", f"{prefix}spans"
    out = without(df, base_name, name).withColumn(base_name, base_spans(whole))

    def joined(base: Column) -> Column:
        free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        more = F.filter(candidates(whole), lambda c: model.accepts(c) & free(c))
        narrow = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"))
        return F.sort_array(F.concat(base, F.transform(more, narrow)))

    return out.withColumn(name, let(F.col(base_name), joined))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one names the whole."""
    kind = "array<string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("parts"))

    def step(a: Column, s: Column) -> Column:
        new = F.array(F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["parts"], new)).otherwise(a["parts"]).alias("parts"))

    def close(a: Column) -> Column:
        return F.array_join(F.array_append(a["parts"], F.substr(text, a["at"] + 1)), "")

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, close))
