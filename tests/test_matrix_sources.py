"""Splitting, reading and writing feature tables."""

import pytest
from pyspark.sql import functions as F

from broadloom.functions.text import base_name, stem
from broadloom.operators import compat
from broadloom.operators import matrix as m
from broadloom.operators import scalers, trials
from broadloom.operators.report import REPORT_SCHEMA
from broadloom.sources import artifacts, sinks, tables


@pytest.fixture(scope="module")
def genomes(spark):
    rows = [("g1", "x", 1.5, 2, 0.5, "E. coli"), ("g2", "y", None, 3, 0.25, "B. subtilis")]
    schema = "Assembly string, Label string, f1 double, f2 int, f3 double, Species string"
    return spark.createDataFrame(rows, schema)


def test_split_orders_metadata_by_list(genomes):
    matrix = m.to_matrix(genomes)
    assert matrix.columns == ["Assembly", "Species", "Label", "features"]
    assert [r["features"] for r in matrix.orderBy("Assembly").collect()] == [[1.5, 2.0, 0.5], [0.0, 3.0, 0.25]]


def test_feature_modes(genomes):
    names = lambda **o: [f.name for f in m.feature_fields(genomes.schema, **o)]
    assert names() == ["f1", "f2", "f3"]
    assert names(mode="float64_only") == ["f1", "f3"]
    assert names(exclude=["f3"]) == ["f1", "f2"]
    with pytest.raises(ValueError):
        names(mode="other")


def test_metadata_may_be_required(genomes):
    with pytest.raises(m.MissingColumns):
        m.to_matrix(genomes, require_metadata=True)


def test_null_policies(genomes):
    kept = m.to_matrix(genomes, null_policy="propagate").orderBy("Assembly").collect()
    assert kept[1]["features"][0] is None
    with pytest.raises(ValueError):
        m.to_matrix(genomes, null_policy="mean")


def test_fill_leaves_nan(matrix_of):
    row = m.fill_nulls(matrix_of([[None, float("nan")]])).first()["features"]
    assert row[0] == 0.0 and row[1] != row[1]


def test_trim(matrix_of):
    matrix = matrix_of([[1, 2, 3], [4, 5, 6]])
    assert m.trim(matrix, 2).first()["features"] == [1.0, 2.0]
    assert m.trim(matrix, 9).first()["features"] == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="expected 9 features, found 3"):
        m.trim(matrix, 9, strict=True).collect()


def test_long_and_back(matrix_of):
    matrix = matrix_of([[1, 2, 3], [4, 5, 6]])
    back = m.from_long(m.to_long(matrix, ["row_id"]), ["row_id"]).orderBy("row_id")
    assert back.collect() == matrix.orderBy("row_id").collect()


def test_named_columns_of_any_width(matrix_of):
    wide = matrix_of([list(range(700))])
    named = m.name_columns(wide, "features", 700)
    assert named.columns == ["row_id", *[f"encoded_{i}" for i in range(700)]]
    assert list(named.first())[1:] == [float(i) for i in range(700)]


def test_wide_tables_and_odd_names(spark):
    names = [f"a`b.{i}" for i in range(2100)]
    df = spark.createDataFrame([(*([1] * 2100), "x")], ", ".join(f"`{n.replace('`', '``')}` int" for n in names) + ", Label string")
    matrix = m.to_matrix(df)
    assert matrix.columns == ["Label", "features"] and m.width_of(matrix) == 2100


# --- CSV ------------------------------------------------------------------


@pytest.fixture
def csv_file(tmp_path):
    def write(text, name="t.csv"):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


QUOTED = 'Assembly,f1,Species,f2,Label\ng1,1.5,"Bacillus, ""B."" strain",3,a\ng2,,plain,4,\n'


def test_quoted_fields_and_empty_cells(spark, csv_file):
    matrix, names = tables.read_feature_csv(spark, csv_file(QUOTED))
    assert names == ["f1", "f2"]
    first, second = matrix.orderBy("Assembly").collect()
    assert first["Species"] == 'Bacillus, "B." strain' and first["features"] == [1.5, 3.0]
    assert second["features"] == [None, 4.0] and second["Label"] is None


def test_types_from_all_rows(spark, csv_file):
    lines = ["Label,a,b,c,d"] + [f"l,{i},{i},{i},1.0" for i in range(9)] + ["l,9,9.5,x,"]
    path = csv_file("\n".join(lines) + "\n")
    guessed = {f.name: f.dataType.simpleString() for f in tables.sample_schema(spark, path).fields}
    assert guessed["b"] == "int"  # the prefix does not see the fraction
    text, names = tables.read_text_matrix(spark, path)
    typed = {r["feature_name"]: r["dtype"] for r in tables.infer_feature_types(text, names).collect()}
    assert typed == {"a": "bigint", "b": "double", "c": "string", "d": "double"}
    matrix, kept = tables.read_feature_csv(spark, path, mode="float64_only", exclude=["d"])
    assert kept == ["b"] and matrix.agg(F.sum(F.get("features", F.lit(0)))).first()[0] == 45.5


def test_ten_thousand_columns(spark, csv_file):
    width = 10_000
    lines = ["Assembly," + ",".join(f"f{i}" for i in range(width))]
    lines += [f"g{r}," + ",".join(str(i % 7 + r) for i in range(width)) for r in range(20)]
    matrix, names = tables.read_feature_csv(spark, csv_file("\n".join(lines)))
    assert len(names) == width
    params = scalers.fit(matrix, ["standard", "robust", "minmax"])
    assert params.count() == 3 * width


def test_header_and_missing_files(spark, csv_file, tmp_path):
    assert tables.read_header(spark, csv_file(QUOTED)) == ["Assembly", "f1", "Species", "f2", "Label"]
    with pytest.raises(tables.TableNotFound):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(tables.TableNotFound):
        tables.read_trials(spark, str(tmp_path / "none"))
    with pytest.raises(tables.TableNotFound):
        artifacts.load_params(spark, str(tmp_path / "none"))
    assert tables.read_trials(spark, str(tmp_path / "none"), required=False).count() == 0


def test_trials_from_csv_with_older_columns(spark, csv_file):
    text = 'encoding_dim,num_layers,layer_config,mse,r2_score\n64,2,"[4096, 1024]",0.5,0.9\n'
    read = tables.read_trials(spark, csv_file(text))
    row = trials.with_defaults(trials.prepare(read)).first()
    assert row["layer_config"] == [4096, 1024] and row["deepest_layer"] == 1024
    assert (row["learning_rate"], row["batch_size"], row["dropout_rate"]) == (0.001, 16, 0.2)


def test_encoded_sink_overwrites(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0])], "row_id long, encoded array<double>")
    for path in (str(tmp_path / "out.csv"), str(tmp_path / "out")):
        for _ in range(2):
            sinks.write_encoded(df, path, width=2)
        stored = tables.read_table(spark, path)
        assert stored.columns == ["row_id", "encoded_0", "encoded_1"] and stored.count() == 1
    sinks.write_encoded(df, str(tmp_path / "wide.csv"))
    assert tables.read_table(spark, str(tmp_path / "wide.csv")).first()["encoded"] == "[0.5,1.0]"


def test_report_sink_and_file_names(spark, tmp_path):
    rows = [("s", "k", "m", 0.5, "0.5")]
    sinks.write_report(spark.createDataFrame(rows, REPORT_SCHEMA), str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "report")).collect()] == rows
    paths = spark.createDataFrame([("/models/a.b.h5",), ("plain",), (".hidden",)], "p string")
    named = paths.select(base_name(F.col("p")).alias("b"), stem(F.col("p")).alias("s")).collect()
    assert [tuple(r) for r in named] == [("a.b.h5", "a.b"), ("plain", "plain"), (".hidden", ".hidden")]


# --- compatibility --------------------------------------------------------


def test_gate_messages(spark):
    df = spark.createDataFrame([("a", 1.0, "t")], "Label string, f1 double, f2 string")
    with pytest.raises(compat.Incompatible, match="expected 3 features, found 2"):
        compat.gate(df.schema, 3)
    with pytest.raises(compat.Incompatible, match="non-numeric"):
        compat.gate(df.schema, 2)
    with pytest.raises(compat.Incompatible):
        compat.gate(df.schema, None)
    compat.gate(df.schema, 1, exclude=["f2"])


def test_check_counts_null_and_nan(spark):
    rows = [("a", None, 1.0), ("b", float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "Label string, f1 double, f2 double")
    row = compat.check(df, 2).first()
    assert (row["compatible"], row["rows"], row["missing_cells"]) == (True, 2, 2)
    row = compat.check(df, None).first()
    assert not row["compatible"] and row["missing"] is None


def test_column_profile(spark):
    index = m.feature_index(spark, spark.createDataFrame([], "a double, Orth1 double, Orth2 int").schema)
    assert [r["feature_name"] for r in compat.find_columns(index, "Orth").orderBy("feature_idx").collect()] == ["Orth1", "Orth2"]
    kept = index.filter("feature_name <> 'Orth1'")
    status = compat.column_status(index, "Orth1", kept).first()
    assert (status["present"], status["position"], status["dtype"], status["excluded"]) == (True, 1, "double", True)
    assert not compat.column_status(index, "b", kept).first()["present"]
    assert sorted((r["part"], r["feature_idx"]) for r in compat.edges(index, 2).collect()) == [
        ("first", 0), ("first", 1), ("last", 1), ("last", 2)
    ]


def test_alignment_by_name(spark, matrix_of):
    aligned = m.align(matrix_of([[1, 2, 3]]), ["a", "b", "c"], ["c", "x", "a"])
    assert aligned.first()["features"] == [3.0, 0.0, 1.0]
