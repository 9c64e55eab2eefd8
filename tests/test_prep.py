import pytest
from pyspark.sql import functions as F

from scorelake.functions import target as t
from scorelake.functions.state import stage
from scorelake.operators import neighbours, prep, profile, resample, split
from scorelake.operators.prep import RejectRules, Rule, Treatment
from scorelake.plans import views
from scorelake.sources import readers, writers

TARGET = t.TargetSpec("target", ("good",), ("bad",), ("maybe",))


def test_target_declaration_is_checked():
    with pytest.raises(ValueError):
        t.TargetSpec(" ", ("good",), ("bad",))
    with pytest.raises(ValueError):
        t.TargetSpec("x", (), ("bad",))
    with pytest.raises(ValueError):
        t.TargetSpec("x", ("a",), ("a",))


def test_target_encoding_strict_and_known(spark):
    df = spark.createDataFrame([("good",), ("bad",), ("maybe",)], "target string")
    with pytest.raises(ValueError):
        t.encode_target(df, TARGET)
    assert [r.label for r in t.encode_target(df, TARGET, strict=False).collect()] == [0, 1, 0]
    with pytest.raises(ValueError):
        t.encode_target(df.union(spark.createDataFrame([(None,)], "target string")), TARGET, strict=False)


def test_integer_targets_compare_as_text(spark):
    df = spark.createDataFrame([(1,), (0,)], "target int")
    numbers = t.TargetSpec("target", ("0",), ("1",))
    assert [r.label for r in t.encode_target(df, numbers).collect()] == [1, 0]


def test_binary_check_and_ratio(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "v string")
    assert t.validate_binary_target(df, "v").first().is_binary
    assert not t.validate_binary_target(df, "v", max_class_ratio=5).first().is_binary


def test_waterfall_counts_on_what_is_left_and_drops_null_masks(spark):
    df = spark.createDataFrame([(1, "5"), (2, "20"), (None, "7"), (9, None), (9, "3")], "a int, b string")
    rules = [Rule("a", ">", 5, "big"), Rule("b", "<", 10, "small text number")]
    rows = {r.rule: r for r in prep.exclusion_waterfall(df, rules).collect()}
    assert (rows[1].rows_removed, rows[1].rows_dropped, rows[1].rows_left) == (2, 3, 2)
    assert (rows[2].rows_removed, rows[2].rows_left) == (1, 1)
    assert prep.apply_exclusions(df, rules).collect() == [(2, "20")]
    for bad in (Rule("a", "==", 1), Rule("zz", "==", 1, "r"), Rule("a", "~", 1, "r"), Rule("a", "in", 1, "r")):
        with pytest.raises(ValueError):
            prep.apply_exclusions(df, [bad])


def test_treatment_order_and_nulls(spark):
    df = spark.createDataFrame([(None,), (100.0,), (-5.0,)], "v double")
    steps = [Treatment("v", "cap", 50.0, "r"), Treatment("v", "floor", 0.0, "r")]
    assert [r.v for r in prep.treat(df, steps).collect()] == [None, 50.0, 0.0]
    filled = [Treatment("v", "impute", 80.0, "r"), *steps]
    assert [r.v for r in prep.treat(df, filled).collect()] == [50.0, 50.0, 0.0]
    assert {(r.kind, r.changed) for r in prep.treatment_summary(df, filled).collect()} == {("impute", 1), ("cap", 2), ("floor", 1)}


def test_reject_population_fixture(spark):
    df = spark.createDataFrame([("good", 0), ("bad", 0), (None, 1)], "target string, rejected int")
    row = prep.reject_population(df, TARGET, RejectRules("ttd", "flag_column", "rejected")).first()
    assert (row.financed_rows, row.non_financed_rows, row.excluded_rows) == (2, 1, 0)
    kept = prep.reject_none(prep.classify_population(df, TARGET, RejectRules("ttd", "target_missing")))
    assert kept.count() == 2 and prep.FINANCED not in kept.columns
    with pytest.raises(ValueError):
        RejectRules("ttd")


def test_quality_warnings(spark):
    df = spark.range(100).selectExpr(
        "id AS customer_id", "1 AS same", "CASE WHEN id < 60 THEN NULL ELSE id END AS holes", "cast(id % 3 AS string) AS level"
    )
    found = {(r.column, r.code) for r in profile.quality_warnings(df).collect()}
    assert {("customer_id", "SUSPECT_ID_COLUMN"), ("customer_id", "NEAR_UNIQUE_COLUMN"), ("same", "CONSTANT_COLUMN")} <= found
    assert ("same", "DOMINANT_VALUE_COLUMN") in found and ("holes", "NULL_HEAVY_COLUMN") in found
    assert not any(c == "level" for c, _ in found)
    assert profile.name_warning("opened_at") == "SUSPECT_DATE_COLUMN"
    assert profile.name_warning("days_dpd") == "SUSPECT_LEAKAGE_COLUMN"
    assert profile.name_warning("income") is None


def test_text_numbers_and_dates(spark):
    df = spark.createDataFrame([("$1,234.5", "2020-01-02"), ("7", "2020-1-2 10:00:00"), ("1,2,3", "soon")], "n string, d string")
    assert [r.parsed for r in profile.string_numeric(df, ["n"]).collect()] == [2]
    assert [r.parsed for r in profile.string_dates(df, ["d"]).collect()] == [2]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert profile.duplicate_rows(df).first().duplicate_rows == 1


@pytest.mark.parametrize("partitions", [1, 16])
def test_split_sizes_are_exact(spark, partitions):
    df = spark.range(1000).selectExpr("id AS key", "CASE WHEN id % 10 = 0 THEN 'bad' ELSE 'good' END AS y").repartition(partitions)
    out = split.stratified_split(df, "y", ["key"])
    sizes = {(r.y, r.role): r["count"] for r in out.groupBy("y", "role").count().collect()}
    assert sizes == {
        ("bad", "train"): 60, ("bad", "test"): 20, ("bad", "oot"): 20,
        ("good", "train"): 540, ("good", "test"): 180, ("good", "oot"): 180,
    }
    with pytest.raises(ValueError):
        split.SplitParams(0.5, 0.1, 0.1)


def test_preassigned_split_needs_every_role(spark):
    df = spark.createDataFrame([("train",), ("test",), ("other",)], "s string")
    with pytest.raises(ValueError):
        split.preassigned_split(df, "s")


@pytest.mark.parametrize(
    "strategy, ratio, expected",
    [
        ("undersample_majority", 1.0, (20, 20, 0)),
        ("oversample_minority", 1.0, (80, 80, 60)),
        ("combined", 1.0, (50, 50, 30)),
        ("undersample_majority", 0.5, (20, 10, 0)),
    ],
)
def test_resampled_sizes(spark, strategy, ratio, expected):
    df = spark.range(100).selectExpr("id AS row_id", "CASE WHEN id < 20 THEN 'bad' ELSE 'good' END AS target")
    out = resample.resample(df, TARGET, ["row_id"], strategy, ratio).collect()
    bad, good = [r for r in out if r.target == "bad"], [r for r in out if r.target == "good"]
    assert (len(bad), len(good), sum(r[resample.SYNTHETIC] for r in out)) == expected
    assert len({r.row_id for r in good}) == len(good)


def test_nearest_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(150, 3)), rng.normal(size=(5, 3)) * 50])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point long, a double, b double, c double")
    got = resample.nearest_neighbours(df, ["a", "b", "c"], 4, leaf=6).toPandas()
    for i, p in enumerate(points):
        distances = np.sort(np.linalg.norm(points - p, axis=1))[1:5]
        mine = got[got.point == i].sort_values("rank").distance.to_numpy()
        assert np.allclose(mine, distances)


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    result = work()
    spark.sparkContext.setJobGroup("other", "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), result


def test_neighbour_tree_takes_as_many_passes_when_deep(spark):
    points = stage(spark.range(6000).selectExpr("id AS point", "array(rand(1), rand(2)) AS x"))
    shallow, (_, _, few) = _jobs(spark, "shallow tree", lambda: neighbours.grow_tree(points, 2, 1024))
    deep, (_, placed, many) = _jobs(spark, "deep tree", lambda: neighbours.grow_tree(points, 2, 8))
    assert len(few) < 30 and len(many) > 500 and max(many.values()) <= 32
    assert deep == shallow and placed.count() == 6000


@pytest.mark.parametrize("limit, value", [("SAMPLED", 1), ("PROBES", 20)])
def test_neighbours_are_exact_with_a_coarse_sample_and_with_blocks(spark, monkeypatch, limit, value):
    import numpy as np

    monkeypatch.setattr(neighbours, limit, value)
    points = np.unique(np.random.default_rng(2).integers(0, 40, (500, 2)), axis=0).astype(float)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point long, a double, b double")
    listed = {r.point: [tuple(f) for f in r.found] for r in neighbours.neighbour_lists(df, ["a", "b"], 4, leaf=24).collect()}
    gaps = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(gaps, np.inf)
    assert listed == {i: sorted(zip(g.tolist(), range(len(g))))[:4] for i, g in enumerate(gaps)}


def test_development_columns_keep_the_rows(spark, tmp_path):
    lines = "id AS l_orderkey, id % 7 AS l_partkey, id % 3 AS l_suppkey, cast(id % 4 AS int) AS l_linenumber, cast(id % 40 AS double) AS l_quantity, cast(id AS double) AS l_extendedprice, 0.06D AS l_discount, 0.01D AS l_tax, 'R' AS l_returnflag, 'F' AS l_linestatus, timestamp '2020-01-01' AS l_shipdate"
    line = spark.range(300).selectExpr("if(id % 50 = 0, null, id % 90) AS id", "id AS n").selectExpr(*lines.split(", "))
    orders = spark.range(100).selectExpr("if(id % 30 = 7, null, id % 80) AS o_orderkey", "if(id % 9 = 0, null, id % 25) AS o_custkey", "'1-URGENT' AS o_orderpriority")
    customer = spark.range(30).selectExpr("if(id = 4, null, id % 20) AS c_custkey", "if(id % 2 = 0, 'BUILDING', null) AS c_mktsegment", "cast(id AS double) AS c_acctbal")
    for name, df in (("lineitem", line), ("orders", orders), ("customer", customer)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    columns = ["app_key", "outcome", "quantity", "balance"]
    kept = views.development(spark, str(tmp_path), columns)
    whole = views.development(spark, str(tmp_path)).select(*columns)
    assert kept.columns == columns and kept.count() > 100
    assert kept.exceptAll(whole).isEmpty() and whole.exceptAll(kept).isEmpty()


def test_smote_balances_and_stays_inside_the_minority(spark):
    df = spark.range(100).selectExpr(
        "id AS row_id", "cast(id % 20 AS double) AS a", "cast(id AS double) / 10 AS b",
        "CASE WHEN id < 20 THEN 'bad' ELSE 'good' END AS target",
    )
    out = resample.smote(df, TARGET, ["a", "b"], k=3)
    made = out.filter(resample.SYNTHETIC).collect()
    assert len(made) == 60 and {r.target for r in made} == {"bad"} and {r.row_id for r in made} == {None}
    assert all(0 <= r.a <= 19 and 0 <= r.b <= 1.9 for r in made)
    with pytest.raises(ValueError):
        resample.smote(df, TARGET, ["a", "b"], k=25)


def test_smote_with_copies_does_not_pair_them(spark):
    df = spark.range(300).selectExpr("CASE WHEN id < 90 THEN 1.0D ELSE cast(id AS double) END AS a", "CASE WHEN id < 100 THEN 'bad' ELSE 'good' END AS target")
    assert resample.smote(df, TARGET, ["a"], k=5).filter("target = 'bad'").count() == 200


def test_csv_import(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text("id\tamount\tflag\tnote\n001\t1.5\ttrue\tNA\n002\t-\tfalse\tx\n", encoding="latin-1")
    df = readers.read_table(spark, str(path), encoding="latin-1", null_values=["NA", "-"], overrides={"id": "string"})
    assert dict(df.dtypes) == {"id": "string", "amount": "double", "flag": "boolean", "note": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("001", 1.5, True, None), ("002", None, False, "x")]
    with pytest.raises(ValueError):
        readers.infer_format("table.xlsx")
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b\n")
    with pytest.raises(ValueError):
        readers.read_table(spark, str(empty))


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "x int, y string")
    base = writers.fingerprint(df).first()
    assert writers.fingerprint(df.select("y", "x").orderBy(F.desc("x")).repartition(3)).first() == base
    assert writers.fingerprint(df.fillna("", ["y"])).first() != base


def test_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "v int, role string")
    writers.write_table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "train"), (2, "test")]
