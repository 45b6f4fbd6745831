"""Trained kernels as pipeline stages."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from test_signal import back, make
from wavetally.operators import spatial, training
from wavetally.plans.estimators import Csp, CspModel, Ica, load_model


@pytest.fixture(scope="module")
def marked(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((800, 4)) * np.where((np.arange(800) // 50 % 2)[:, None] == 0, [3, 1, 1, 1], [1, 1, 1, 3])
    return make(spark, x).withColumn("label", (F.floor(F.col("t") / 50) % 2).cast("int"))


def test_labels_as_a_column_equal_labels_as_a_table(spark, marked):
    windows = spark.createDataFrame([(k, k % 2) for k in range(16)], "window_index long, label int")
    want = {r["component"]: r["x"] for r in training.csp_calibrate(marked, windows, 50, 2).collect()}
    model = Csp(W=50, n_components=2).fit(marked)
    got = {r["component"]: r["x"] for r in model.table.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert (model.getOrDefault("W"), model.getOrDefault("n_components")) == (50, 2)


def test_windows_without_one_label_take_no_part(spark, marked):
    torn = marked.withColumn("label", F.when(F.col("t") == 3, 1).when(F.col("t") == 160, None).otherwise(F.col("label")))
    keep = spark.createDataFrame([(k, k % 2) for k in range(16) if k not in (0, 3)], "window_index long, label int")
    want = {r["component"]: r["x"] for r in training.csp_calibrate(marked, keep, 50, 2).collect()}
    got = {r["component"]: r["x"] for r in Csp(W=50, n_components=2).fit(torn).table.collect()}
    assert all(np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(ValueError, match="two classes"):
        Csp(W=50).fit(marked.withColumn("label", F.lit(1)))


def test_a_saved_pipeline_gives_the_same_rows(spark, marked, tmp_path):
    path = str(tmp_path / "fitted")
    fitted = Pipeline(stages=[Csp(W=50, n_components=4), Ica(tol=1e-3)]).fit(marked)
    fitted.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert [type(s).__name__ for s in again.stages] == ["CspModel", "IcaModel"] and again.stages[1].getOrDefault("tol") == 1e-3
    assert again.uid == fitted.uid and again.stages[0].uid == fitted.stages[0].uid
    assert np.array_equal(back(again.transform(marked)), back(fitted.transform(marked)))
    again.stages[0].write().overwrite().save(str(tmp_path / "one"))
    one = load_model(spark, str(tmp_path / "one"))
    assert isinstance(one, CspModel) and np.array_equal(back(one.transform(marked)), back(spatial.csp_apply(marked, fitted.stages[0].table)))


def test_a_saved_recipe_and_parameter_maps(spark, marked, tmp_path):
    recipe = Pipeline(stages=[Csp(W=40, label_col="label")])
    recipe.write().overwrite().save(str(tmp_path / "recipe"))
    csp = Pipeline.load(str(tmp_path / "recipe")).getStages()[0]
    assert isinstance(csp, Csp) and csp.getOrDefault("W") == 40 and csp.getOrDefault("n_components") == 4
    small = csp.fit(marked, {csp.W: 50, csp.n_components: 2})
    assert small.table.count() == 2 and small.getOrDefault("W") == 50 and csp.getOrDefault("W") == 40
