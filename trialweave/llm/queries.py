"""Registered queries of the subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import chat, decontaminate, divergence, langid, packing, periodic, pii, quality, sharding, simhash, tokens, toxicity, voronoi
from trialweave.llm.common import let, table, words

#: The vocabulary used by the queries; operators take a path.
VOCABULARY = "byte_bpe_50k.json"

#: Documents of this remainder are never learned from.
HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_hypergeometric_shards")
def op1(spark, d):
    text = F.coalesce("text", F.lit(""))
    return sharding.shard_rows(table(spark, d, "documents"), 40).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs
), windows AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), repeated AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k
), lines AS (
  SELECT k, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM docs
), measured AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(w.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l.l) AS BIGINT) AS n_lines
  FROM words w JOIN lines l USING (k) LEFT JOIN covered c USING (k)
), ledger AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed,
  (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM ledger
"""


@query("op2_rule_ledger", OP2_SQL)
def op2(spark, d):
    rows = quality.ledger(table(spark, d, "documents"))
    return rows.select(
        "doc_id", *quality.MEASURES, "failed", (~quality.kept(quality.BASE)).alias("base_failed"), quality.kept(quality.STANDARD).alias("kept")
    )


@query("op3_offset_attribution")
def op3(spark, d):
    rows = tokens.attribute_tokens(table(spark, d, "documents"), vocabulary(), rule="majority")
    return rows.select("doc_id", "section", "start", "end", F.col("tokens").cast("long").alias("n_tokens"), F.col("crossing").alias("n_crossing"))


@query("op5_vector_best_fit")
def op5(spark, d):
    made = packing.pack(table(spark, d, "documents"), vocabulary())
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def learned(df: DataFrame) -> DataFrame:
    return df.where(f"NOT coalesce({HELD_OUT}, false)")


def toxicity_model(spark, d, docs: DataFrame) -> toxicity.Model:
    return toxicity.fit(learned(docs), learned(table(spark, d, "labels")))


@query("op4_counterfactual_toxicity")
def op4(spark, d):
    docs = table(spark, d, "documents")
    rows = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, d, docs))
    held_out, predicted = F.expr(f"coalesce({HELD_OUT}, false)"), (F.col("score") >= 0.3).cast("int")
    return rows.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query("op7_compression_language")
def op7(spark, d):
    docs = table(spark, d, "documents")
    rows = langid.identify(docs.select("doc_id", "text"), langid.fit(learned(docs)))
    return rows.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "lang_pred", "score", "rejected")


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + (length(role || text) - length(replace(role || text, chr(92), '')))
    + len(string_split(role, '[INST]')) + len(string_split(role, '[/INST]')) + len(string_split(role, '</s>'))
    + len(string_split(role, '<s>')) + len(string_split(role, '<<SYS>>')) + len(string_split(role, '<</SYS>>')) - 6
    + len(string_split(text, '[INST]')) + len(string_split(text, '[/INST]')) + len(string_split(text, '</s>'))
    + len(string_split(text, '<s>')) + len(string_split(text, '<<SYS>>')) + len(string_split(text, '<</SYS>>')) - 6 + 17 AS n
  FROM rows
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op6_reply_trees", OP6_SQL)
def op6(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    template = chat.Template()
    made = chat.format_trees(chat.chain(rows.unionByName(extra), "conv_id", "turn", "role", "text"), template)
    made = made.withColumns(
        {
            "turns": template.read_turns(F.col("formatted")),
            "learned": F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["part"])), ""),
        }
    )
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op8_simhash_pigeonhole")
def op8(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


OP9_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), item_words AS (
  SELECT row_number() OVER () AS item, w, min(item_id) AS item_id, count(*) AS n_items FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0 GROUP BY w
), item_shingles AS (
  SELECT DISTINCT item, item_id, n_items, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item_words)
), widths AS (
  SELECT DISTINCT least(5, len(w)) AS width FROM item_words
), doc_shingles AS (
  SELECT DISTINCT k, doc_id, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT k, doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, widths)
), sized AS (SELECT item, count(*) AS n FROM item_shingles GROUP BY ALL)
SELECT doc_id, any_value(i.item_id) AS item_id, CAST(any_value(i.n_items) AS BIGINT) AS n_items, CAST(any_value(z.n) AS INTEGER) AS n_shingles,
  CAST(count(*) AS INTEGER) AS n_shared, count(*) / any_value(z.n) AS containment
FROM doc_shingles d JOIN item_shingles i USING (s) JOIN sized z USING (item)
GROUP BY k, doc_id, item HAVING count(*) >= ceil(0.8 * any_value(z.n) - 1e-9)
"""


@query("op9_size_partitioned_containment", OP9_SQL)
def op9(spark, d):
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("key")


@query("op10_weak_supervision_pii")
def op10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = pii.find(docs, pii.fit(docs))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.BASE]  # noqa: B023
    return rows.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), occurrences AS (
  SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM occurrences GROUP BY ALL HAVING count(DISTINCT k) >= 30
), langs AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS lang_total FROM kept GROUP BY ALL
), counts AS (
  SELECT o.lang, o.source, o.term, CAST(count(*) AS HUGEINT) AS n FROM occurrences o JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.lang_total, 0) AS lang_total, coalesce(n.n_group, 0) AS n_group
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n_group FROM counts GROUP BY ALL) n USING (lang, source)
), parts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.n_group + 5 * g.v) AS p,
    1 + (1000000000 * (k.total + 5)) // (g.lang_total + 5 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM parts a JOIN parts b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM parts WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""


@query("op11_cube_divergence", OP11_SQL)
def op11(spark, d):
    return divergence.audit(table(spark, d, "documents"))


OP12_SQL = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, c.k AS c,
    CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT * FROM vectors WHERE vec_id % 20 = 0) q JOIN vectors c ON q.k <> c.k
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(score, 0) DESC, vec_id NULLS LAST, c) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, coalesce(score, 0) AS score FROM ranked WHERE r <= 20
"""


@query("op12_voronoi_top_k", OP12_SQL)
def op12(spark, d):
    return voronoi.top_k(table(spark, d, "embeddings"), asks=F.col("vec_id") % 20 == 0, k=20)


def with_planted_run(doc_id, text):
    """``text`` with the words from one on repeated from there, for a tenth of the ids."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words(text), planted)).otherwise(text)


@query("op13_seed_extend_runs")
def op13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", with_planted_run(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.find_runs(docs).withColumn("best", periodic.strongest(F.col("runs")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        sha(periodic.listed(F.col("runs"))).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
