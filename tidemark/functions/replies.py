"""Structured values from the replies of a judging model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _object(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.when(F.isnan(x), None).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def verdict(raw: Column) -> Column:
    """struct(winner, confidence): from JSON, else from a reply that starts with the word A or B; null and 0 otherwise."""
    own = F.upper(F.btrim(F.get_json_object(_object(raw), "$.winner")))
    stated = F.get_json_object(_object(raw), "$.confidence")
    sure = F.when(stated.isNull(), F.lit(0.5)).otherwise(stated.try_cast("double"))
    bare = F.nullif(F.regexp_extract(F.upper(F.btrim(raw)), r"^([AB])\b", 1), F.lit(""))
    good = own.isin("A", "B") & sure.isNotNull()
    return F.struct(F.when(good, own).otherwise(bare).alias("winner"), F.when(good, _clamp(sure, 0.0, 1.0)).when(bare.isNotNull(), F.lit(0.5)).otherwise(F.lit(0.0)).alias("confidence"))


def signed_score(raw: Column) -> Column:
    """The score in JSON, else the first number, within -100 to 100; null without one."""
    stated = F.get_json_object(_object(raw), "$.score").try_cast("double")
    return _clamp(F.coalesce(stated, F.nullif(F.regexp_extract(raw, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")), -100.0, 100.0)


def internal_score(signed: Column) -> Column:
    return signed / 2 + 50


def policy(raw: Column) -> Column:
    """The boolean of that name in JSON, read strictly, else whether the reply says true."""
    stated = F.lower(F.get_json_object(_object(raw), "$.policy"))
    return F.when(stated.isin("true", "false"), stated == "true").otherwise(F.contains(F.lower(raw), F.lit("true")))
