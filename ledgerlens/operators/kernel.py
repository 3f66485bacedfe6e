"""Random Fourier features (Rahimi and Recht, 2007) for the RBF kernel exp(-sigma * |x - y|^2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """z(x) = sqrt(2 / D) * cos(W x + b) with rows of W ~ N(0, 2 sigma I), so that z(x).z(y) approximates the kernel.

    W and b follow from the seed, so a saved pipeline stores parameters only.
    """

    sigma = Param(Params._dummy(), "sigma", "kernel width", TypeConverters.toFloat)
    dims = Param(Params._dummy(), "dims", "number of random features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, seed=7, sigma=0.01, dims=256):
        super().__init__()
        self._setDefault(seed=7, sigma=0.01, dims=256)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sigma, dims, seed = self.getOrDefault(self.sigma), self.getOrDefault(self.dims), self.getSeed()

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(rows: pd.Series) -> pd.Series:
            if len(rows) == 0:
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy())
            generator = np.random.default_rng(seed)
            weights = generator.normal(0.0, np.sqrt(2.0 * sigma), size=(x.shape[1], dims))
            offsets = generator.uniform(0.0, 2.0 * np.pi, size=dims)
            return pd.Series(list(np.sqrt(2.0 / dims) * np.cos(x @ weights + offsets)))

        values = vector_to_array(F.col(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(values)))
