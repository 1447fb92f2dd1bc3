"""Loss metrics as Column builders ``metric(actual, pred) -> Column``.

Each builder returns an *aggregate* expression, usable in ``groupBy().agg``.
Zero denominators give NULL terms (``try_divide``) that ``avg`` skips; the
count of such terms is available from :func:`zero_denominators`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mae(actual, pred) -> Column:
    return F.avg(F.abs(_c(actual) - _c(pred)))


def mse(actual, pred) -> Column:
    return F.avg(F.pow(_c(actual) - _c(pred), 2))


def mape_term(actual, pred) -> Column:
    return F.try_divide(F.abs(_c(actual) - _c(pred)), F.abs(_c(actual)))


def smape_term(actual, pred) -> Column:
    return F.try_divide(F.abs(_c(actual) - _c(pred)), F.abs(_c(actual)) + F.abs(_c(pred)))


def mape(actual, pred) -> Column:
    return F.avg(mape_term(actual, pred)) * 100


def smape(actual, pred) -> Column:
    return F.avg(smape_term(actual, pred)) * 100


def zero_denominators(actual, pred) -> Column:
    """Rows whose MAPE denominator is zero (their term is NULL)."""
    return F.count_if(_c(actual) == 0)


LOSSES = {"MAE": mae, "MSE": mse, "MAPE": mape, "sMAPE": smape}


def loss_func(name: str):
    """Metric builder by name: MAE, MSE, MAPE or sMAPE."""
    if name not in LOSSES:
        raise KeyError(f"unknown loss {name!r}; choose one of {sorted(LOSSES)}")
    return LOSSES[name]
