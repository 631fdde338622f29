"""Canonical JSON (sorted keys, compact, UTF-8, no NaN or infinity), as an Arrow function: no built-in writes these bytes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def canonical(text: str) -> str | None:
    """The canonical form of a JSON text; null if it is not JSON or holds a number that JSON lacks."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except ValueError:
        return None


@pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(canonical, na_action="ignore")
