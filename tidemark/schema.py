"""The document schema, and source types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Source types; those of the composite committee.
SOURCE_TYPES = ("speech", "interview", "mp_statement", "mp_qa", "mp_account", "mp_report", "testimony", "member_view")
COMMITTEE = ("mp_statement", "mp_qa", "mp_account", "mp_report")

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
DOCUMENT = T.StructType([T.StructField(n, t, n not in ("date", "speaker", "title", "text", "source_type")) for n, t in (
    ("date", T.DateType()), ("speaker", _S), ("title", _S), ("text", _S), ("source_type", _S), ("institution", _S), ("source_url", _S), ("orig_language", _S), ("translated", _B),
    ("word_count", _I), ("is_policy", _B), ("mu", _D), ("mu_adj", _D), ("sigma", _D), ("n_comparisons", _I), ("direct_score", _D), ("direct_adj", _D), ("id", _S),
)])
LOG = "tournament int, seq long, a string, b string, winner string, confidence double, _bad string"
