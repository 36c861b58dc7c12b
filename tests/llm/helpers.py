"""Fixtures shared by the tests of the subpackage."""

import duckdb

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{k % 977}" for k in range(60_000))
#: Nulls in every column, empty and blank texts, repeated rows, a repeated id, and a very long text.
EDGES = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n\x0b\f\r ", "en", None, 7), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3),
    (5, "one two three four five six seven eight", "en", "b", 40), (5, "another text under the same id", "en", "b", 30), (None, "no id here at all", "en", "b", 17),
    (None, None, None, None, None), (6, LONG, "de", "c", len(LONG)), (7, "Ünïcode ñ 漢字 🙂 zero​width", "es", "c", 25),
]


def edges(spark, *clashing):
    """The edge rows, with extra columns of the given names."""
    df = spark.createDataFrame(EDGES, SCHEMA).repartition(3)
    for name in clashing:
        df = df.selectExpr("*", f"'own' as `{name}`")
    return df


def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


def same_as_sql(spark, name, sf_dir=SMALL):
    """Rows of a registered query and of its SQL, as sorted text."""
    from trialweave.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    text = lambda rows: sorted(str([repr(v) for v in r]) for r in rows)
    mine, theirs = text([[r[c] for c in cols] for r in got.collect()]), text([[r[k] for k in at] for r in want.fetchall()])
    assert mine == theirs and mine
