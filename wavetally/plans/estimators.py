"""Trained kernels as stages of ``pyspark.ml`` pipelines: parameters, fit, transform, save, load."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.operators import spatial, training


class _TableWriter(MLWriter):
    """Parameters as metadata, the trained table as parquet beside it."""

    def __init__(self, model: _TableModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.coalesce(1).write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _TableModel(Model, MLWritable, MLReadable):
    """A model whose state is a small table: one row per component."""

    def __init__(self, table: DataFrame):
        super().__init__()
        self.table = table

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _CspParams(Params):
    W = Param(Params._dummy(), "W", "samples of a training window", typeConverter=TypeConverters.toInt)
    n_components = Param(Params._dummy(), "n_components", "number of filters, even", typeConverter=TypeConverters.toInt)
    label_col = Param(Params._dummy(), "label_col", "column with the class of a sample's window", typeConverter=TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(W=160, n_components=4, label_col="label")


class CspModel(_TableModel, _CspParams):
    """Filters (component, x) applied to every sample."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return spatial.csp_apply(dataset, self.table)


class Csp(Estimator, _CspParams, DefaultParamsWritable, DefaultParamsReadable):
    """Spatial filters from samples (recording_id, t, x) with the class of their window in ``label_col``.

    Windows are consecutive, ``W`` samples each. One that is not full, has a sample without a label, or labels that differ takes no
    part. There must be two classes."""

    @keyword_only
    def __init__(self, *, W: int = 160, n_components: int = 4, label_col: str = "label"):
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, W: int = 160, n_components: int = 4, label_col: str = "label") -> Csp:
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CspModel:
        W, label = self.getOrDefault(self.W), F.col(self.getOrDefault(self.label_col))
        windows = dataset.groupBy("recording_id", F.floor(F.col("t") / W).alias("window_index"))
        found = windows.agg(F.min(label).alias("label"), F.max(label).alias("_most"), F.count("*").alias("_rows"), F.count(label).alias("_marked"))
        labels = found.where("label = _most AND _rows = _marked").select("recording_id", "window_index", "label")
        rows = dataset.select("recording_id", "t", "x")
        return self._copyValues(CspModel(training.csp_calibrate(rows, labels, W, self.getOrDefault(self.n_components))))


class _IcaParams(Params):
    max_iter = Param(Params._dummy(), "max_iter", "most passes over the samples", typeConverter=TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "largest turn of a component at the end, as 1 - |cosine|", typeConverter=TypeConverters.toFloat)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(max_iter=200, tol=1e-4)


class IcaModel(_TableModel, _IcaParams):
    """Unmixing rows (row, weights, mean) applied to every sample."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return spatial.ica_apply(dataset, self.table)


class Ica(Estimator, _IcaParams, DefaultParamsWritable, DefaultParamsReadable):
    """Independent components of samples (recording_id, t, x)."""

    @keyword_only
    def __init__(self, *, max_iter: int = 200, tol: float = 1e-4):
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, max_iter: int = 200, tol: float = 1e-4) -> Ica:
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> IcaModel:
        return self._copyValues(IcaModel(training.fastica_calibrate(dataset, self.getOrDefault(self.max_iter), self.getOrDefault(self.tol))))


def load_model(spark: SparkSession, path: str) -> Model:
    """A saved model of either kind."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
