"""JSON helpers: payload extraction (C7) and row rendering for results (Q3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeaudit.functions._util import col_of


def extract_json_fields(payload, fields: dict[str, str]) -> dict[str, Column]:
    """Typed fields of a JSON text column.

    ``fields`` maps an output name to ``"$.path:type"`` (type defaults to
    string). Malformed text or a value of the wrong type gives NULL for that
    field; callers add a validity flag with :func:`json_is_valid`.
    """
    out = {}
    for name, spec in fields.items():
        path, _, dtype = spec.partition(":")
        value = F.get_json_object(col_of(payload), path)
        out[name] = value.try_cast(dtype or "string")
    return out


def json_is_valid(payload) -> Column:
    """True when the whole text is one JSON value, NULL for NULL."""
    p = col_of(payload)
    # The parser stops after the first value; as an element of two arrays of known
    # length the text must be one value and nothing more.
    alone = (F.json_array_length(F.concat(F.lit("["), p, F.lit(",0]"))) == 2) & (
        F.json_array_length(F.concat(F.lit("[0,0,"), p, F.lit("]"))) == 3
    )
    return F.when(p.isNotNull(), F.try_parse_json(p).isNotNull() & F.coalesce(alone, F.lit(False)))


def row_json(*cols) -> Column:
    """One JSON object per row: decimals stay numbers, timestamps ISO text."""
    return F.to_json(F.struct(*(cols or ["*"])))
