"""Reply trees: root-to-leaf paths, branch ranking, and one formatted conversation per chosen path.

Messages point to their parents. Iterative self-joins with doubled jumps give every message its depth and path score in as many
rounds as the depth has binary digits; the leaves of a tree are ranked by path score, and only chosen paths are spelled out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import let, stored


@dataclass(frozen=True)
class Template:
    """Turn: ``start`` role ``header_end`` text ``end``. The mark goes into control strings that stand in a text."""

    start: str = "[INST]"
    header_end: str = "[/INST]"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("<s>", "<<SYS>>", "<</SYS>>")
    mark: str = "\\"

    @property
    def control(self) -> tuple[str, ...]:
        return (self.start, self.header_end, self.end, *self.reserved)

    def hidden(self, token: str) -> str:
        return token[0] + self.mark + token[1:]

    def escape(self, text: Column) -> Column:
        """Marks are doubled, then a mark is put behind the first character of every control string."""
        out = F.replace(text, F.lit(self.mark), F.lit(self.mark * 2))
        for token in self.control:
            out = F.replace(out, F.lit(token), F.lit(self.hidden(token)))
        return out

    def unescape(self, text: Column) -> Column:
        """A single mark stands only behind the first character of a control string; all others are double."""
        out = text
        for token in self.control:
            out = F.replace(out, F.lit(self.hidden(token)), F.lit(token))
        return F.replace(out, F.lit(self.mark * 2), F.lit(self.mark))

    def turn(self, role: Column, text: Column) -> tuple[Column, Column, Column]:
        """Header, body and end of a turn."""
        return F.concat(F.lit(self.start), self.escape(role), F.lit(self.header_end)), self.escape(text), F.lit(self.end)

    def read_turns(self, formatted: Column) -> Column:
        """The turns of a formatted conversation: array of role and text."""
        cut = F.filter(F.split(formatted, r"\Q" + self.end + r"\E"), lambda x: x != "")

        def turn(x: Column) -> Column:
            bare = F.substr(x, F.lit(len(self.start) + 1))
            sides = lambda at: F.struct(
                self.unescape(F.substr(bare, F.lit(1), at - 1)).alias("role"),
                self.unescape(F.substr(bare, at + len(self.header_end))).alias("text"),
            )
            return let(F.locate(self.header_end, bare), sides)

        return F.transform(cut, turn)


def chain(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages of conversations that are kept by turn: each row's parent is the row before it.

    Rows of one turn follow one another by role and text, so nothing is lost; ids are places in the conversation.
    """
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    numbered = rows.selectExpr("conv", "row_number() over (partition by conv order by at nulls first, role, text) as id", "role", "text")
    return numbered.withColumns({"parent": F.when(F.col("id") > 1, F.col("id") - 1), "score": F.lit(0.0)})


def resolve(messages: DataFrame) -> DataFrame:
    """Messages with ``depth`` (from 0) and ``path_score`` (sum from the root), by joins with jumps of doubled length.

    A message whose parent is missing or stands on a cycle back to itself is no descendant of a root; the first becomes a root,
    the second never ends and is left out. Repeated (conv, id) rows count once.
    """
    nodes = messages.groupBy("conv", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("conv", "id", "m.*")
    parents = nodes.select("conv", F.col("id").alias("parent"), F.lit(True).alias("there"))
    known = nodes.join(parents, ["conv", "parent"], "left")
    state = known.select(
        "conv", "id", F.when(F.col("there"), F.col("parent")).alias("parent"), "role", "text",
        F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"),
    ).withColumn("key", F.xxhash64("conv", "id"))
    state = stored(state, "messages")
    largest = state.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    jumps = state.select("conv", "id", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.col("score").alias("path_score"))
    for _ in range(int(largest - 1).bit_length()):  # no path is longer than the largest tree
        ahead = jumps.select("conv", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("depth").alias("d2"), F.col("path_score").alias("s2"))
        open_ = jumps.where("to is not null").join(ahead, ["conv", "to"])
        moved = open_.select("conv", "id", F.col("to2").alias("to"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("path_score") + F.col("s2")).alias("path_score"))
        jumps = stored(jumps.where("to is null").unionByName(moved), "jumps")
    done = jumps.where("to is null").select("conv", "id", "depth", "path_score")
    return state.drop("key").join(done, ["conv", "id"])


def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of each tree set (all for None), one row per message: conv, path, step, role, text.

    Branches are ranked by mean score, then by length (longer first), then by leaf id; ``path`` is the rank from 1.
    """
    tree = stored(resolve(messages), "tree")
    inner = tree.where("parent is not null").select("conv", F.col("parent").alias("id")).distinct()
    leaves = tree.join(inner, ["conv", "id"], "left_anti").select("conv", "id", "depth", (F.col("path_score") / (F.col("depth") + 1)).alias("mean"))
    ranked = leaves.selectExpr("conv", "id", "depth", "row_number() over (partition by conv order by mean desc, depth desc, id) as path")
    chosen = stored(ranked if top is None else ranked.where(F.col("path") <= top), "leaves")
    deepest = chosen.agg(F.max("depth")).first()[0] or 0
    up = tree.select("conv", "id", F.col("parent").alias("to")).where("to is not null")
    spelled = chosen.select("conv", "path", "id", "depth")
    for _ in range(int(deepest).bit_length()):  # ancestors at distance 1, then 2 and 3, then 4 to 7, ...
        gap = 2**_
        above = spelled.join(up, ["conv", "id"]).select("conv", "path", F.col("to").alias("id"), (F.col("depth") - gap).alias("depth"))
        spelled = stored(spelled.unionByName(above), "paths")
        ahead = up.select("conv", F.col("id").alias("to"), F.col("to").alias("to2"))
        up = stored(up.join(ahead, ["conv", "to"]).select("conv", "id", F.col("to2").alias("to")), "ancestors")
    text = tree.select("conv", "id", "role", "text")
    return spelled.join(text, ["conv", "id"]).select("conv", "path", F.col("depth").alias("step"), "id", "role", "text")


def formatted(path_rows: DataFrame, template: Template = Template(), learn: str = "assistant") -> DataFrame:
    """One row per path: ``conv, path, formatted``, and ``segments``, its parts with ``loss`` true where text is learned.

    The parts joined are ``formatted``; ``loss_spans`` are their places (code points, end exclusive). The body of every turn whose
    role is ``learn`` is under the loss mask. One conversation is one row, as long as it is.
    """
    header, body, end = template.turn(F.col("role"), F.col("text"))
    row = F.struct("step", "id", header.alias("header"), body.alias("body"), end.alias("end"), (F.col("role") == learn).alias("loss"))
    made = path_rows.groupBy("conv", "path").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    part = lambda text, loss: F.struct(text.alias("part"), loss.alias("loss"))
    off = F.lit(False)
    segments = F.flatten(F.transform("rows", lambda r: F.array(part(r["header"], off), part(r["body"], r["loss"]), part(r["end"], off))))
    made = made.select("conv", "path", segments.alias("segments"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, s: Column) -> Column:
        to = a["at"] + F.length(s["part"])
        span = F.array(F.struct(a["at"].alias("start"), to.alias("end")))
        return F.struct(to.alias("at"), F.when(s["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return made.withColumns(
        {"formatted": F.array_join(F.col("segments.part"), ""), "loss_spans": F.aggregate("segments", start, step, lambda a: a["spans"])}
    )


def format_trees(messages: DataFrame, template: Template = Template(), top: int | None = 1, learn: str = "assistant") -> DataFrame:
    """Conversations of reply trees given as ``conv, id, parent, role, text, score`` (null role or text is empty).

    Null conversation ids form no tree and are left out, as are cycles; an empty table gives no row; equal messages count once.
    """
    given = messages.where("conv is not null and id is not null").withColumns(
        {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}
    )
    return formatted(paths(given, top), template, learn)
