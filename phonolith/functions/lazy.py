"""Pandas and Arrow UDFs that are made when they are used, so modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def pandas_function(returns: str) -> Callable:
    """Like ``pandas_udf``, for a DDL type."""

    def decorate(function: Callable) -> Callable[..., Column]:
        @wraps(function)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(function, returns)(*columns)

        return call

    return decorate


def arrow_function(returns: str, function: Callable) -> Callable[..., Column]:
    """A function of Arrow arrays as one of columns, for a DDL type."""
    return F.arrow_udf(function, returns, F.ArrowUDFType.SCALAR)
