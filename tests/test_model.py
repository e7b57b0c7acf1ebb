import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.operators import forest, metrics, predict, quantiles
from tidewatch.plans import reports, training
from tidewatch.sources import model_store
from verification import fixed_model


def test_average_path():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert forest.average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (10.0, 5.0)], "a double, b double")
    rows = {r["feature"]: r for r in forest.fit_scaler(df, ["a", "b"]).collect()}
    assert rows["a"]["std"] == pytest.approx(3.491060, abs=1e-6) and rows["b"]["std"] == 1.0
    scaled = forest.scale_features(df, forest.Scaler.from_table(forest.fit_scaler(df, ["a", "b"])))
    assert [r["b"] for r in scaled.collect()] == [0.0] * 4


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(3000)]
    rows += [(3000 + i, 9.0 + i, -9.0 - i, 9.0) for i in range(5)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").cache()


@pytest.mark.parametrize("trees", [5, 40])
def test_forest_structure(spark, points, trees):
    def fit(n):
        rows = forest.fit_forest(points.repartition(n), ["a", "b", "c"], trees, row_key=F.col("id")).collect()
        return sorted(tuple(r) for r in rows)
    nodes = fit(1)
    assert nodes == fit(9)
    by_tree = {}
    for n in nodes:
        by_tree.setdefault(n[0], []).append(n)
    assert len(by_tree) == trees
    for rows in by_tree.values():
        leaves = [n for n in rows if n[4] < 0]
        assert sum(n[7] for n in leaves) == 256 and max(n[6] for n in rows) <= 8
        assert {n[1] for n in rows} == set(range(len(rows)))


def test_rows_are_offered_to_trees_alike(spark, monkeypatch):
    shares = forest._shares(20, 0.03)
    want = [sum(math.comb(20, i) * 0.03 ** i * 0.97 ** (20 - i) for i in range(k + 1)) for k in range(20)]
    assert shares == pytest.approx(want) and forest._shares(3, 1.0) == [0.0] * 3
    rows = spark.range(20_000).select(F.col("id").alias("_row_key"), F.rand(3).alias("a"))
    for fraction in (0.02, 0.4, 1.0):
        taken = forest._tree_samples(rows, ["a"], 10, 10**6, 5, fraction).groupBy("tree_id").count().collect()
        spread = 6 * math.sqrt(20_000 * fraction * (1 - fraction))
        assert len(taken) == 10 and all(abs(r["count"] - 20_000 * fraction) <= spread for r in taken)
    # a margin that leaves trees short is mended
    monkeypatch.setattr(forest, "MARGIN", 0.3)
    nodes = forest.fit_forest(rows.select("a"), ["a"], 8).collect()
    assert [n["n"] for n in nodes if n["node_id"] == 0] == [256] * 8


def test_equal_rows_without_a_key(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(1)).alias("a"))
    nodes = forest.fit_forest(df, ["a"], 4).collect()
    roots = [n["n"] for n in nodes if n["node_id"] == 0]
    assert roots == [256] * 4


def test_outliers_score_lowest_and_share_is_kept(spark, points):
    model = forest.fit_model(points, ["a", "b", "c"], 60, 0.1, row_key=F.col("id"))
    scored = training.score_table(points, model)
    flagged = scored.filter("y_pred = 1").count()
    assert abs(flagged - 300.5) <= 1.5
    worst = [r["id"] for r in scored.orderBy("score").limit(5).collect()]
    assert set(worst) == {3000, 3001, 3002, 3003, 3004}


def test_walk_matches_plain_descent(spark):
    nodes = fixed_model.forest()
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (500, len(K.CORE_FEATURES)))

    def descend(row):
        total = 0.0
        for tree in range(3):
            table = {n.node_id: n for n in nodes if n.tree_id == tree}
            node = table[0]
            while node.left >= 0:
                node = table[node.left if row[node.feature_idx] <= node.threshold else node.right]
            total += node.depth + forest.average_path(node.n)
        return total / 3
    assert forest.NodeArrays(nodes).mean_path(x) == pytest.approx([descend(r) for r in x])


def test_prediction_goldens(spark):
    df = spark.createDataFrame([(-0.25,), (-0.6,), (0.0,), (0.2,), (None,)], "s double")
    got = [(r["is_anomaly"], r["prediction"], r["confidence"], r["error"]) for r in predict.predict_from_score(df, "s").collect()]
    assert got == [(True, -1, 0.5, None), (True, -1, 1.0, None), (False, 1, 0.0, None), (False, 1, 0.0, None),
                   (False, 1, 0.0, "Feature extraction failed")]


def test_unreadable_features_and_absent_model(spark):
    df = spark.createDataFrame([("1",), ("n/a",)], "bytes_sent string")
    got = predict.predict_logs(df, fixed_model.model()).collect()
    assert got[0]["error"] is None and got[1]["error"] == "Feature extraction failed"
    assert {r["error"] for r in predict.predict_logs(df, None).collect()} == {"Model not loaded"}


def test_model_round_trip(spark, points, tmp_path):
    path = str(tmp_path / "model")
    assert model_store.load_model(spark, path) is None and model_store.model_n_features(spark, path) == 11
    model = forest.fit_model(points, ["a", "b", "c"], 10, row_key=F.col("id"))
    model_store.save_model(spark, model, path, {"accuracy": 0.5})
    back = model_store.load_model(spark, path)
    assert model_store.model_n_features(spark, path) == 3
    assert model_store.model_metadata(spark, path)["test_metrics"] == {"accuracy": 0.5}
    assert (back.offset, back.scaler, back.trees) == (model.offset, model.scaler, model.trees)
    a = training.score_table(points, model).agg(F.sum("score")).first()[0]
    assert training.score_table(points, back).agg(F.sum("score")).first()[0] == pytest.approx(a, abs=1e-9)


@pytest.mark.parametrize("direct", [10**6, 900, 40])
def test_percentiles_are_exact_however_they_are_found(spark, direct):
    rng = np.random.default_rng(3)
    columns = {"u": rng.random(5001), "skew": np.exp(rng.normal(0, 3, 5001)),
               "ties": rng.integers(0, 3, 5001).astype(float), "hot": np.where(rng.random(5001) < 0.4, 7.0, rng.random(5001))}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], list(columns)).repartition(5)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {(r["key"], r["q"]): r["value"] for r in quantiles.exact_percentiles(
        quantiles.keyed_values(df, list(columns)), wanted, direct).collect()}
    for name, values in columns.items():
        assert [got[(name, q)] for q in wanted] == pytest.approx(np.quantile(values, wanted).tolist())
    assert quantiles.kth_smallest(df, "u", 17, direct) == sorted(columns["u"])[17]


def test_percentile_golden(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    assert quantiles.exact_percentile(df, "x", 0.1) == pytest.approx(1.3)
    row = quantiles.describe(df, ["x"]).first()
    assert row["std"] == pytest.approx(4.031129, abs=1e-6) and row["p50"] == 3.0


def test_describe_does_not_depend_on_the_finish(spark, points):
    a = quantiles.describe(points, ["a", "b"]).orderBy("feature").collect()
    b = quantiles.describe(points, ["a", "b"], finish_rows=100).orderBy("feature").collect()
    for x, y in zip(a, b):
        assert list(x)[1:] == pytest.approx(list(y)[1:])


@pytest.mark.parametrize("finish", [10**6, 30])
def test_describe_counts_by_bins_instead_of_sketches(spark, monkeypatch, finish):
    """Steep, tied, constant and extreme columns; a sketch per column and round is what large tables cannot afford."""
    rng = np.random.default_rng(6)
    columns = {"steep": np.exp(rng.normal(0, 9, 3001)), "ties": rng.integers(0, 3, 3001) * 1.5, "same": np.full(3001, -7.25),
               "signs": rng.normal(0, 1, 3001), "tiny": rng.integers(0, 9, 3001) * 5e-324, "hot": np.where(rng.random(3001) < 0.6, 1e9, rng.random(3001))}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], list(columns)).repartition(3)
    with monkeypatch.context() as patch:
        if finish > 3001:
            patch.setattr(quantiles.F, "percentile_approx", lambda *_: pytest.fail("a sketch"))
        got = {r["feature"]: r for r in quantiles.describe(df, list(columns), finish).collect()}
    for name, values in columns.items():
        row = got[name]
        assert [row["min"], row["p25"], row["p50"], row["p75"], row["max"]] == pytest.approx(
            np.quantile(values, [0, 0.25, 0.5, 0.75, 1]).tolist(), rel=1e-12, abs=0)
        assert row["count"] == 3001 and row["mean"] == pytest.approx(values.mean()) and row["std"] == pytest.approx(values.std(ddof=1), rel=1e-9)
    wide = spark.createDataFrame([(-1.7e308,), (1.0,), (2.0,), (1.7e308,), (math.inf,), (math.nan,), (None,)], "x double")
    row = quantiles.describe(wide, ["x"], 1).first()
    assert (row["count"], row["min"], row["p50"], row["p25"]) == (6, -1.7e308, (2.0 + 1.7e308) / 2, 1.25)


@pytest.mark.parametrize("finish", [10**6, 20])
def test_special_values_come_in_order(spark, finish):
    inf, nan = math.inf, math.nan
    values = [-inf] * 3 + [float(x) for x in range(80)] + [inf] * 10 + [nan] * 7 + [None] * 5
    df = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
    wanted = [0.0, 0.02, 0.25, 0.5, 0.825, 0.9, 1.0]
    got = [r["value"] for r in quantiles.exact_percentiles(
        quantiles.keyed_values(df, ["x"]), wanted, finish).orderBy("q").collect()]
    ordered = values[:100]
    want = []
    for q in wanted:
        place = q * 99
        low, high, w = ordered[math.floor(place)], ordered[math.ceil(place)], place % 1
        want.append(low if low == high or w == 0 else (1 - w) * low + w * high)
    assert got == pytest.approx(want, nan_ok=True) and got[1] == -inf and got[5] == inf and math.isnan(got[6])
    alone = spark.createDataFrame([(nan,), (inf,), (None,)], "x double")
    assert quantiles.kth_smallest(alone, "x", 0, finish) == inf
    assert quantiles.describe(alone.filter("x is null"), ["x"]).count() == 0


def test_metric_goldens(spark):
    matrix = spark.createDataFrame([(41556, 5155, 27094, 31071)], "tn long, fp long, fn long, tp long")
    m = metrics.binary_metrics(matrix).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1_score"], m["false_positive_rate"]) == (
        0.6925, 0.8577, 0.5342, 0.6583, 0.1104)
    empty = spark.createDataFrame([(0, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    assert list(metrics.binary_metrics(empty).first()) == [0.0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0.0]
    report = {r["class"]: r for r in metrics.classification_report(matrix).collect()}
    assert report["Attack"]["recall"] == 0.5342 and report["weighted avg"]["support"] == 104876
    assert metrics.report_metrics(empty).first()["f1_score"] == 0.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.0, None)], "x double")
    bins = reports.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [1, 0, 1, 2] and [r["bin_start"] for r in bins] == [0, 0.25, 0.5, 0.75]
    flat = reports.histogram(df.filter("x = 1"), "x", 2).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [0, 2]


def test_lists_are_zero_filled(spark):
    empty = spark.createDataFrame([], "event_type string, is_anomaly boolean, severity string")
    assert [r["rate"] for r in reports.detection_rate(empty).orderBy("place").collect()] == [0.0] * 5
    assert [r["n"] for r in reports.severity_distribution(empty).orderBy("place").collect()] == [0] * 6


def test_leaking_column_can_be_left_out(spark):
    df = spark.createDataFrame([(0.0, 1)], "src_port double, event_type_code int")
    assert training.training_columns(df) == ["src_port", "event_type_code"]
    assert training.training_columns(df, leak=False) == ["src_port"]
