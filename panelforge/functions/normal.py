"""Normal distribution functions of columns, by the standard library, in Arrow batches."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_N = NormalDist()


@pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(_N.cdf, na_action="ignore").astype(float)


@pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda v: _N.inv_cdf(v) if 0 < v < 1 else float("nan"), na_action="ignore").astype(float)


@pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 2 * _N.cdf(-abs(v)), na_action="ignore").astype(float)
