"""Whole plans: chains of operators that a user runs as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators.detect import detect, explode_findings


def findings_to_events(texts: DataFrame, key: str, host: Column, at: Column, action: str = "send_anyway", **how) -> DataFrame:
    """texts -> findings -> wire events; categories that the wire does not know are left out."""
    from .. import rules

    found = explode_findings(detect(texts, **how), [key, *[c for c in texts.columns if c not in (key, "text")]])
    return E.build_events(found.filter(F.col("category").isin(*rules.WIRE_CATEGORIES)), host=host, action=F.lit(action), at=at, keys=(key,))
