"""Byte-level token ids of whole texts, and the offset-mapped attribution of tokens to sections.

A text is encoded once. Byte-level tokens tile the bytes of the text, so running sums of their byte lengths give exact spans;
sections tile it too, and the two interval lists are joined in order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = ("first", "last", "majority", "fraction")


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: visible characters stand for themselves, the others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of a text under a byte-level BPE vocabulary file of the ``tokenizers`` library, equal to those of its ``encode`` with
    ``add_special_tokens=False``: the literal of an added token in the text is that token.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in or ask for neighbouring characters are not supported")
        special = {t["content"]: t["id"] for t in added}
        back = byte_of_char()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.ordinary = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = special
        # the longest first where two begin at one place
        self.literals = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=lambda t: (-len(t), t))) + ")") if special else None
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        for t, i in special.items():
            self.lengths[i] = len(t.encode())

    def encode(self, text: str) -> list[int]:
        if not any(t in text for t in self.special):
            return self.ordinary(text)
        ids: list[int] = []
        for k, part in enumerate(self.literals.split(text)):
            ids += [self.special[part]] if k % 2 else self.ordinary(part)
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """One section per line, its line feed included."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append(("line", at, at := min(len(text), at + len(line) + 1)))
    return out


def field_sections(*fields: str) -> tuple[Column, Column]:
    """The texts of several columns joined by line feeds, and the sections ``(name, start, end)`` that they take there."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, sections = F.lit(0), []
    for name, part in zip(fields, parts, strict=True):
        end = at + F.length(part)
        sections.append(F.struct(F.lit(name).alias("name"), at.alias("start"), end.alias("end")))
        at = end + 1
    return F.concat_ws("\n", *parts), F.array(*sections)


def attribute(text: str, sections: list[tuple[str, int, int]], rule: str, enc: Encoder) -> list[tuple[int, str, int, int, float, int]]:
    """Rows (section, name, start, end, tokens, crossing tokens); section -1 holds what no section gets."""
    data = text.encode("utf-8", "surrogatepass")
    lengths = enc.lengths[np.array(enc.encode(text), dtype=np.int64)] if text else np.zeros(0, dtype=np.int64)
    ends = lengths.cumsum()
    starts = ends - lengths
    first = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    at_byte = np.append(np.flatnonzero(first), len(data))  # of each character
    bounds, owner, last = [], [], 0
    for k, (_, a, b) in sorted(enumerate(sections), key=lambda x: (x[1][1], x[1][2])):
        a, b = (int(at_byte[min(max(0, x), len(at_byte) - 1)]) for x in (a, b))
        a = max(a, last)  # of overlapping sections the earlier one keeps its characters
        if a < b:
            bounds += [last, a] if a > last else [a]
            owner += [-1, k] if a > last else [k]
            last = b
    if last < len(data):
        bounds.append(last)
        owner.append(-1)
    tokens, crossing = np.zeros(len(sections) + 1), np.zeros(len(sections) + 1, dtype=np.int64)
    if len(ends):
        edges, own = np.array([*bounds, len(data)]), np.array(owner)
        f, g = np.searchsorted(edges, starts, "right") - 1, np.searchsorted(edges, ends - 1, "right") - 1
        inside = f == g
        tokens += np.bincount(own[f[inside]] + 1, minlength=len(tokens))
        for i in np.flatnonzero(~inside):
            span = range(f[i], g[i] + 1)
            share = [min(ends[i], edges[j + 1]) - max(starts[i], edges[j]) for j in span]
            for j in {own[j] for j in span}:
                crossing[j + 1] += 1
            if rule == "fraction":
                for j, n in zip(span, share, strict=True):
                    tokens[own[j] + 1] += n / (ends[i] - starts[i])
            else:
                held: dict[int, int] = {}
                for j, n in zip(span, share, strict=True):
                    held[own[j]] = held.get(own[j], 0) + n
                pick = {"first": own[f[i]], "last": own[g[i]], "majority": max(held, key=held.get)}[rule]
                tokens[pick + 1] += 1
    rows = [(k, name, a, b, float(tokens[k + 1]), int(crossing[k + 1])) for k, (name, a, b) in enumerate(sections)]
    return rows + ([(-1, "outside", 0, len(text), float(tokens[0]), int(crossing[0]))] if tokens[0] or crossing[0] else [])


def attribute_tokens(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "majority"
) -> DataFrame:
    """Tokens of each section of each document: ``doc_id, section, name, start, end, tokens, crossing``.

    ``sections`` names a column of ``array<struct<name, start, end>>`` (code points, end exclusive); without it the lines are the
    sections. A token that crosses a border goes to the section with most of its bytes, the earlier one in a tie (``majority``),
    to the ``first`` or ``last`` section it touches, or is split by bytes (``fraction``). Tokens of no section are returned as
    section -1, so that the sums are the token counts of whole documents. Null text is empty and has one empty line; overlapping
    sections lose what an earlier one has. Rows are independent: equal rows give equal results, there is no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = df.schema[doc_id].dataType
    names = ["doc_id", "section", "name", "start", "end", "tokens", "crossing"]
    kinds = [kind, T.IntegerType(), T.StringType(), T.LongType(), T.LongType(), T.DoubleType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    columns = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")] + ([F.col(sections).alias("sections")] if sections else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        out = pa.schema([pa.field("section", pa.int32()), pa.field("name", pa.string()), pa.field("start", pa.int64()),
                         pa.field("end", pa.int64()), pa.field("tokens", pa.float64()), pa.field("crossing", pa.int64())])
        for batch in batches:
            where, rows = [], []
            given = batch.column("sections").to_pylist() if sections else None
            for i, t in enumerate(batch.column("text").to_pylist()):
                t = t or ""
                own = [(s["name"], s["start"], s["end"]) for s in given[i] or [] if s] if sections else line_sections(t)
                got = attribute(t, own, rule, enc)
                where += [i] * len(got)
                rows += got
            parts = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)] if rows else [pa.array([], f.type) for f in out]
            ids = batch.column("doc_id").take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *parts], names=names)

    return df.select(*columns).mapInArrow(run, schema)
