"""Language by compression: the language whose dictionary makes a text smallest.

For each language a zstandard raw-content dictionary is made of pieces of labelled texts. A text is put in lower case without
anything but letters, and encoded in blocks against every dictionary. Where two languages are close, further dictionaries made of
other pieces add their sizes before the choice; what stays close is marked as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks belong to the letters before them, but no text is made of marks alone.
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
BLOCK = 16_384


def normal(text: str | None) -> bytes:
    """Lower-case words of letters; empty if there is no letter."""
    if not LETTER.search(text or ""):
        return b""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Model:
    """Per language the contents of its dictionaries, the first one used for every text."""

    dictionaries: dict[str, list[bytes]]
    level: int = 6
    narrow: float = 0.02

    def classifier(self):
        import zstandard

        def compressor(content: bytes):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(level=self.level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

        tools = {g: [compressor(c) for c in contents] for g, contents in sorted(self.dictionaries.items())}
        most = max((len(t) for t in tools.values()), default=0)

        def classify(text: str | None) -> tuple[str, float, bool]:
            data = normal(text)
            if not data or not tools:
                return "und", 0.0, True
            blocks = [b" " + data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
            size = dict.fromkeys(tools, 0)
            for turn in range(most):
                for g, own in tools.items():
                    size[g] += sum(len(own[turn % len(own)].compress(b)) for b in blocks)
                best, *others = sorted(size.values())
                margin = (others[0] - best) / others[0] if others else 1.0
                if margin >= self.narrow:
                    break
            choice = min(size, key=lambda g: (size[g], g))
            # sizes are averages over the dictionaries used; a byte is a factor e
            total = sum(math.exp(max(-700.0, (best - s) / (turn + 1))) for s in size.values())
            return choice, 1 / total, margin < self.narrow

        return classify


def fit(
    df: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 120, chars_per_doc: int = 2_000,
    n_dictionaries: int = 3, seed: int = 1, level: int = 6, narrow: float = 0.02,
) -> Model:
    """Dictionaries from about ``docs_per_language`` texts of each language, ``chars_per_doc`` characters of each.

    The bounds hold for the dictionaries alone. Texts are drawn by their hash at the rate that the language's number of different
    texts asks for, so copies neither fill nor thin a dictionary; of each a piece at a hashed place of the whole text is taken.
    Rows without language or letters are not used; the ids of the rows decide nothing.
    """
    rows = df.select(F.col(text).alias("t"), F.col(lang).alias("g")).where(r"g is not null and t rlike '\\p{L}'")
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "t"))
    counts = {g: int(n) for g, n in rows.select("g", "key").distinct().groupBy("g").agg(F.count("*")).collect()}
    if not counts:
        return Model({}, level, narrow)
    rate = F.create_map(*[F.lit(x) for g, n in sorted(counts.items()) for x in (g, min(1.0, 1.5 * docs_per_language / n))])
    drawn = rows.where(F.shiftrightunsigned("key", 11) * F.lit(2.0**-53) < F.element_at(rate, F.col("g")))
    places = F.greatest(F.lit(1), F.length("t") - (chars_per_doc - 1))
    start = (1 + F.pmod(F.xxhash64(F.lit(seed), "key"), places)).cast("int")
    pieces = drawn.groupBy("g", F.col("t").substr(start, F.lit(chars_per_doc)).alias("piece")).agg(F.min("key").alias("key"))
    of: dict[str, list[bytes]] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["g"], r["key"])):
        if data := normal(r["piece"]):
            of.setdefault(r["g"], []).append(data)
    dealt = {g: [own[:docs_per_language][k::n_dictionaries] for k in range(n_dictionaries)] for g, own in of.items()}
    return Model({g: [b" " + b" ".join(x) for x in lists if x] for g, lists in dealt.items()}, level, narrow)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` (``und`` without letters), ``score`` (0 to 1) and ``rejected`` (the margin stayed narrow).

    Whole texts are encoded. Ties go to the first language by name. Rows are independent: there is no shuffle and equal texts get
    equal results. Columns with the names of the results are replaced.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = model.classifier()
        for batch in texts:
            yield pd.DataFrame([of(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    lost = {"lang_pred", "score", "rejected"}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in lost]
    return df.withColumn("__lang", run(F.col(text))).select(*rest, "__lang.lang_pred", "__lang.score", "__lang.rejected")
