"""Forecast scores as aggregate expressions over ``y_true`` and ``y_pred``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mae(y: Column | str, p: Column | str) -> Column:
    return F.avg(F.abs(_col(y) - _col(p)))


def mse(y: Column | str, p: Column | str) -> Column:
    e = _col(y) - _col(p)
    return F.avg(e * e)


def rmse(y: Column | str, p: Column | str) -> Column:
    return F.sqrt(mse(y, p))


def bias(y: Column | str, p: Column | str) -> Column:
    return F.avg(_col(p) - _col(y))


def r2(y: Column | str, p: Column | str) -> Column:
    """Over rows where both are present."""
    e = _col(y) - _col(p)
    seen = F.when(e.isNotNull(), _col(y))
    return 1 - F.sum(e * e) / F.nullif(F.count(e) * F.var_pop(seen), F.lit(0.0))


def nrmse_range(y: Column | str, p: Column | str) -> Column:
    return rmse(y, p) / F.nullif(F.max(_col(y)) - F.min(_col(y)), F.lit(0.0))


def nrmse_mean(y: Column | str, p: Column | str) -> Column:
    return rmse(y, p) / F.nullif(F.avg(_col(y)), F.lit(0.0))


def skill(model: Column | str, naive: Column | str) -> Column:
    """Percent improvement over the naive score; NULL if the naive score is 0."""
    return (1 - _col(model) / F.nullif(_col(naive), F.lit(0.0))) * 100
