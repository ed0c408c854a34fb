"""Columns that hold a result: a struct of ok and err, of which err tells whether it failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def result(ok: Column, failed: Column, error: Column) -> Column:
    return F.struct(F.when(~failed, ok).alias("ok"), F.when(failed, error).alias("err"))


def map_ok(r: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(F.when(r["err"].isNull(), f(r["ok"])).alias("ok"), r["err"].alias("err"))


def map_err(r: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(r["ok"].alias("ok"), F.when(r["err"].isNotNull(), f(r["err"])).alias("err"))


def unwrap_or_else(r: Column, f: Callable[[Column], Column]) -> Column:
    """The value, or what f makes of the error; an ok of NULL stays NULL."""
    return F.when(r["err"].isNull(), r["ok"]).otherwise(f(r["err"]))
