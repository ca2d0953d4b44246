"""Text that should be JSON."""

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_json(text: str | None) -> str | None:
    """A Python literal as JSON; null where it is none."""
    if text is None:
        return None
    try:
        return json.dumps(ast.literal_eval(text))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def literal_json(raw: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_as_json, na_action="ignore").astype(object).where(texts.notna(), None)

    return F.pandas_udf(run, "string")(raw)


def parsed(raw: Column, schema: str) -> Column:
    """``raw`` by a schema; what is no JSON is read as a Python literal, what is neither is null.

    Only texts that aren't JSON reach Python.
    """
    odd = F.when(F.try_parse_json(raw).isNull(), raw)
    return F.when(odd.isNull(), F.from_json(raw, schema)).otherwise(F.from_json(literal_json(odd), schema))
