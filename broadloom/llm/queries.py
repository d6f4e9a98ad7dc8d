"""One query per operator over its whole table, with a SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.llm import (
    decontamination,
    exact_dedup,
    html_text,
    language_id,
    language_model,
    license_scan,
    minhash_forest,
    packing,
    periodic_runs,
    private_data,
    token_counts,
    toxicity,
    whitening,
)
from broadloom.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

# The words of a text, with A-Z alone in lower case.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_sql(table: str, key: str, pattern: str) -> str:
    return (
        f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
        f"'{pattern}') AS w FROM {table}"
    )


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""


@query("op2_exact_dedup", OP2_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the decision of the digest index."""
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents")).drop("tag")


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.default_tokenizer())


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), token_counts.default_tokenizer())


_OP6_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP6_SQL = f"""
WITH docs AS MATERIALIZED ({words_sql("documents", "doc_id", _OP6_WORD)}),
items AS ({words_sql("benchmark", "item_id", _OP6_WORD)}),
windows AS MATERIALIZED (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w]
    ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS s FROM items
), sizes AS (SELECT DISTINCT len(s) AS size FROM windows),
places AS MATERIALIZED (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM docs JOIN sizes ON len(w) >= size
), found AS MATERIALIZED (
  SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON p.w[p.i:p.i + p.size - 1] = x.s
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
), of_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN of_items USING (doc_id)
"""


@query("op6_benchmark_decontamination", OP6_SQL)
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark windows."""
    docs, benchmark = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontamination.contamination(docs, benchmark).drop("tag")


OP1_SQL = f"""
WITH RECURSIVE tokens AS MATERIALIZED (
  {words_sql("documents", "doc_id", "[^\\x20\\x09-\\x0D]+")}
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM tokens
), sized AS MATERIALIZED (
  SELECT t.doc_id, count(s) AS n FROM tokens t LEFT JOIN shingles USING (doc_id) GROUP BY t.doc_id
), shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sized
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sized JOIN least USING (doc_id)
"""


@query("op1_minhash_near_dedup", OP1_SQL)
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the near-duplicate component it belongs to."""
    docs = table(spark, sf_dir, "documents")
    return minhash_forest.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels that are not held out."""
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity.score(docs, labels).drop("tag")


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the terms that reveal it."""
    return private_data.report(table(spark, sf_dir, "documents"))


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document states."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def planted_period(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of one text in ten repeating from some word on, as op13 defines it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    changed = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    changed = changed.withColumn("_n", F.when(F.size("_w") > 0, F.size("_w").cast("long")))
    g = F.floor(F.col("_h") / 10)
    changed = changed.withColumn("_a", g % F.col("_n"))
    changed = changed.withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)"))
    repeated = F.expr(
        "array_join(transform(_w, (w, i) -> if(i >= _a, _w[cast(_a + (i - _a) % _p as int)], w)), ' ')"
    )
    return changed.withColumn("text", F.coalesce(F.when(F.col("_n").isNotNull(), repeated), "text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, one text in ten made periodic, and its text without repetition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(planted_period(docs))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("q")))
    )
    listed = F.concat_ws(
        "", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    )
    return found.withColumn("_best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.l").alias("length"),
        (-F.col("_best.q")).alias("period"),
        F.expr("1000 * _best.l div (-_best.q)").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding along the components of the covariance of all of them."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whitening.quantised("embedding").alias("x"))
    white = whitening.whiten(vectors, "x", "vec_id")
    each = white.select(
        "vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened")
    )
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("explained", F.col("at")).alias("explained"),
        "identity_error",
    )


@query("op12_lm_scoring")
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every document under a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    found = language_model.score(docs, remainder != 2)
    return found.withColumn("held_out", F.coalesce(remainder == 2, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
