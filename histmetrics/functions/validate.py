"""Identifier rules. Each returns the (typed) value, or NULL when it is invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from histmetrics.functions.text import _col

# Accepted identifier shapes.
HASH = "^[0-9a-fA-F]+$"
MODULE = "^[A-Za-z_][A-Za-z0-9_]*$"
MODEL = "^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*$"
RUN_ID = "^[0-9a-fA-F]{8,64}$"
EPOCH = "^([0-9]+|-0+)$"


def _keep(c: Column | str, pattern: str) -> Column:
    return F.when(_col(c).rlike(pattern), _col(c))


def valid_hash(c: Column | str) -> Column:
    return _keep(c, HASH)


def valid_module(c: Column | str) -> Column:
    return _keep(c, MODULE)


def valid_model(c: Column | str) -> Column:
    return _keep(c, MODEL)


def valid_run_id(c: Column | str) -> Column:
    return _keep(c, RUN_ID)


def valid_epoch(c: Column | str) -> Column:
    return _keep(c, EPOCH).try_cast("bigint")


def valid_email(c: Column | str) -> Column:
    return F.when((F.length(_col(c)) > 0) & ~_col(c).rlike("\\s"), _col(c))
