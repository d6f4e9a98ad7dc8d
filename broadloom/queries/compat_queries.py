"""Does a table fit a stored scaler; profiles of the column list."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadloom.operators import compat, scalers
from broadloom.operators import matrix as m
from broadloom.queries import fixtures as fx
from broadloom.queries.matrix_queries import WIDE, wide_table
from broadloom.queries.registry import query
from broadloom.session import scratch_path
from broadloom.sources import artifacts, sinks


@query(
    "d10_missing_cells",
    f"WITH {fx.NULL_CELLS} SELECT count(DISTINCT row_id) AS rows, count(*) - count(x) AS missing_cells FROM nulled",
)
def d10(spark, sf_dir):
    return compat.missing_count(fx.matrix_with_nulls(spark, sf_dir))


@query(
    "d11_non_numeric_features",
    """SELECT * FROM (
SELECT 0 AS feature_idx, count(*) FILTER (WHERE try_cast(p_name AS DOUBLE) IS NULL) AS bad_cells FROM part
UNION ALL SELECT 1, count(*) FILTER (WHERE try_cast(substr(p_brand, 7) AS DOUBLE) IS NULL) FROM part
UNION ALL SELECT 2, count(*) FILTER (WHERE p_size > 45) FROM part
UNION ALL SELECT 3, count(*) FILTER (WHERE p_type = 'PROMO') FROM part) WHERE bad_cells > 0""",
)
def d11(spark, sf_dir):
    """Names, numbers, numbers with some unreadable cells, numbers with some empty ones."""
    size, kind = F.col("p_size"), F.col("p_type")
    cells = F.array(
        "p_name",
        F.substring("p_brand", 7, 10),
        F.when(size > 45, "n/a").otherwise(size.cast("string")),
        F.when(kind == "PROMO", "1,5").when(kind == "SMALL", "").otherwise("2.5"),
    )
    long = fx.table(spark, sf_dir, "part").select(F.posexplode(cells).alias("feature_idx", "value"))
    return compat.non_numeric_features(long)


def _index(spark, sf_dir, mode="all_non_metadata", exclude=()):
    line = fx.table(spark, sf_dir, "lineitem")
    return m.feature_index(spark, line.schema, fx.LINE_META, mode, exclude)


@query(
    "d12_dtype_counts",
    """SELECT CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
         WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS dtype, count(*) AS columns,
       (SELECT count(*) FROM lineitem) AS table_rows
FROM (DESCRIBE lineitem) WHERE column_name NOT IN ('l_returnflag', 'l_linestatus') GROUP BY ALL""",
)
def d12(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").agg(F.count("*"))
    return compat.dtype_counts(_index(spark, sf_dir)).withColumn("table_rows", rows.scalar())


@query(
    "d13_matching_columns",
    """SELECT p_name, count(*) AS parts FROM part WHERE contains(p_name, 'widget') GROUP BY p_name""",
)
def d13(spark, sf_dir):
    """The part names stand for a long column list."""
    parts = fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("feature_idx"), F.col("p_name").alias("feature_name"),
        F.lit("double").alias("dtype"),
    )
    found = compat.find_columns(parts, "widget")
    return found.groupBy(F.col("feature_name").alias("p_name")).agg(F.count("*").alias("parts"))


@query(
    "d13_column_status",
    """SELECT 'Supplier name' AS feature_name, false AS present, NULL::INTEGER AS position,
       NULL::VARCHAR AS dtype, false AS excluded
UNION ALL SELECT c_name, true, CAST(c_custkey AS INTEGER), 'double', c_nationkey = 7
FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 7)""",
)
def d13_status(spark, sf_dir):
    """A column dropped from a list of customers, and one that never was in it."""
    customers = fx.table(spark, sf_dir, "customer")
    index = customers.select(
        F.col("c_custkey").cast("int").alias("feature_idx"), F.col("c_name").alias("feature_name"),
        F.lit("double").alias("dtype"), "c_nationkey",
    )
    kept = index.filter("c_nationkey <> 7")
    name = customers.filter("c_nationkey = 7").agg(F.max_by("c_name", "c_custkey")).first()[0]
    absent = compat.column_status(index, "Supplier name", kept)
    return absent.unionByName(compat.column_status(index, name, kept))


@query(
    "a13_schema_profile",
    """WITH n AS (SELECT count(*) AS n FROM part),
i AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS feature_idx, p_partkey FROM part)
SELECT 'first' AS part, feature_idx, 'p' || p_partkey AS feature_name FROM i WHERE feature_idx < 20
UNION ALL SELECT 'last', feature_idx, 'p' || p_partkey FROM i, n WHERE feature_idx >= n - 20""",
)
def a13(spark, sf_dir):
    """One feature per part: the first and last twenty names as written."""
    first = fx.table(spark, sf_dir, "part").agg(F.min("p_partkey"))
    index = fx.table(spark, sf_dir, "part").withColumn("first", first.scalar()).select(
        (F.col("p_partkey") - F.col("first")).cast("int").alias("feature_idx"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("feature_name"),
        F.lit("double").alias("dtype"),
    )
    path = scratch_path(spark, "profile")
    sinks.write_schema_profile(index, path)
    return spark.read.parquet(f"{path}/edges").select("part", "feature_idx", "feature_name")


# --- checks ---------------------------------------------------------------


def _stored(spark, sf_dir):
    path = scratch_path(spark, "params")
    artifacts.save_params(scalers.fit(fx.line_matrix(spark, sf_dir), "maxabs"), path)
    return artifacts.load_params(spark, path)


# What the schema of the table says about each variant.
_DESCRIBED = """columns AS (SELECT column_name, column_type FROM (DESCRIBE lineitem)),
variants AS (
  SELECT 'fits' AS variant, ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'] AS names
  UNION ALL SELECT 'missing', ['l_quantity', 'l_tax']
  UNION ALL SELECT 'extra', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber']
  UNION ALL SELECT 'text', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_returnflag']),
described AS (
  SELECT variant, CAST(count(*) AS INTEGER) AS n, list(column_name) FILTER (WHERE column_type = 'VARCHAR') AS texts,
         (SELECT CAST(count(*) AS INTEGER) FROM columns WHERE column_type = 'DOUBLE') AS expected
  FROM variants JOIN columns ON list_contains(names, column_name) GROUP BY variant)"""

_VARIANTS = {
    "fits": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "missing": ("l_quantity", "l_tax"),
    "extra": ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"),
    "text": ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag"),
}


def _variant(spark, sf_dir, name):
    return fx.table(spark, sf_dir, "lineitem").select("l_linestatus", *_VARIANTS[name])


def _checked(spark, sf_dir, known=True):
    expected = compat.expected_features(_stored(spark, sf_dir), "maxabs" if known else "nothing")
    result = None
    for name in _VARIANTS:
        row = compat.check(_variant(spark, sf_dir, name), expected, ["l_linestatus", "l_shipmode"])
        row = row.withColumn("variant", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result


@query(
    "h01_feature_count_check",
    f"""WITH {_DESCRIBED}
SELECT variant, n AS n_features, expected, greatest(expected - n, 0) AS missing,
       greatest(n - expected, 0) AS extra, n = expected AS count_matches FROM described""",
)
def h01(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "variant", "n_features", "expected", "missing", "extra", "count_matches"
    )


@query(
    "h02_metadata_presence",
    f"""WITH {_DESCRIBED}, found AS (
  SELECT column_name FROM columns WHERE column_name IN ('l_linestatus', 'l_shipmode')
  AND column_name = 'l_linestatus')
SELECT variant, (SELECT CAST(count(*) AS INTEGER) FROM found) AS n_metadata,
       (SELECT string_agg(column_name, ',') FROM found) AS metadata_found, (SELECT count(*) FROM lineitem) AS rows
FROM described""",
)
def h02(spark, sf_dir):
    return _checked(spark, sf_dir).select("variant", "n_metadata", "metadata_found", "rows")


@query(
    "h03_verdict",
    f"""WITH {_DESCRIBED}
SELECT variant, n = expected AND texts IS NULL AS compatible, (SELECT count(*) FROM lineitem) AS rows,
       (SELECT CAST(count(*) - count(l_tax) AS BIGINT) FROM lineitem) AS missing_cells FROM described""",
)
def h03(spark, sf_dir):
    return _checked(spark, sf_dir).select("variant", "compatible", "rows", "missing_cells")


@query(
    "h03_verdict_wide",
    f"""SELECT {WIDE + 2}::INTEGER AS total_columns, {WIDE}::INTEGER AS n_features, {WIDE}::INTEGER AS expected,
       true AS compatible, count(*) AS rows,
       CAST({WIDE} * count(*) FILTER (WHERE embedding IS NULL) AS BIGINT) AS missing_cells FROM embeddings""",
)
def h03_wide(spark, sf_dir):
    """The full check of a table of 2,500 feature columns, and its gate."""
    wide = wide_table(spark, sf_dir)
    compat.gate(wide.schema, WIDE, ["Label", "row_id"])
    found = compat.check(wide, WIDE, ["Label", "row_id"])
    return found.select("total_columns", "n_features", "expected", "compatible", "rows", "missing_cells")


@query(
    "h03_unknown_expectation",
    """SELECT variant, false AS compatible, NULL::INTEGER AS missing
FROM (SELECT unnest(['fits', 'missing', 'extra', 'text']) AS variant)
WHERE (SELECT count(*) FROM lineitem) > 0""",
)
def h03_unknown(spark, sf_dir):
    return _checked(spark, sf_dir, known=False).select("variant", "compatible", "missing")


@query(
    "h04_gate",
    f"""WITH {_DESCRIBED}
SELECT variant, n = expected AND texts IS NULL AS passed,
       CASE WHEN n <> expected THEN 'expected ' || expected || ' features, found ' || n
            WHEN texts IS NOT NULL THEN len(texts) || ' non-numeric feature columns, first: [''' || texts[1] || ''']' END AS reason
FROM described""",
)
def h04(spark, sf_dir):
    """The gate of every variant: passed, or the reason it stopped the run."""
    expected = compat.expected_features(_stored(spark, sf_dir), "maxabs")
    outcome = []
    for name in _VARIANTS:
        try:
            compat.gate(_variant(spark, sf_dir, name).schema, expected, ["l_linestatus"])
            outcome.append((name, True, None))
        except compat.Incompatible as stopped:
            outcome.append((name, False, str(stopped)))
    return spark.createDataFrame(outcome, "variant string, passed boolean, reason string")


@query(
    "h05_name_alignment",
    """WITH have AS (SELECT 'n' || c_nationkey AS feature_name, CAST(min(c_custkey) AS INTEGER) AS input_idx
  FROM customer GROUP BY 1),
want AS (SELECT 'n' || (n_nationkey + 3) AS feature_name, n_nationkey AS wanted_idx FROM nation)
SELECT feature_name, input_idx, wanted_idx, CASE WHEN input_idx IS NULL THEN 'missing'
  WHEN wanted_idx IS NULL THEN 'extra' ELSE 'matched' END AS status
FROM have FULL JOIN want USING (feature_name)""",
)
def h05(spark, sf_dir):
    """Nation numbers seen among the customers against a list shifted by three."""
    name = lambda c: F.concat(F.lit("n"), c.cast("string")).alias("feature_name")
    have = fx.table(spark, sf_dir, "customer").groupBy(name(F.col("c_nationkey"))).agg(
        F.min("c_custkey").cast("int").alias("feature_idx")
    )
    want = fx.table(spark, sf_dir, "nation").select(
        name(F.col("n_nationkey") + 3), F.col("n_nationkey").alias("feature_idx")
    )
    return compat.alignment(have, want)


@query(
    "h05_aligned_matrix",
    f"""WITH {fx.CELLS}
SELECT v.vec_id AS row_id, CAST(w.i AS INTEGER) AS feature_idx, coalesce(x, 0.0) AS value
FROM embeddings v CROSS JOIN (SELECT * FROM (VALUES (3, 0), (99, 1), (0, 2), (17, 3)) t(f, i)) w
LEFT JOIN cells c ON c.row_id = v.vec_id AND c.feature_idx = w.f""",
)
def h05_matrix(spark, sf_dir):
    """Features picked by name; one of them is not in the table."""
    names = [f"f{i}" for i in range(64)]
    aligned = m.align(fx.matrix(spark, sf_dir), names, ["f3", "f99", "f0", "f17"])
    return m.to_long(aligned, ["row_id"])
