"""Column-expression helpers built only from ``pyspark.sql.functions``.

Everything here returns a ``Column`` so it stays inside whole-stage codegen.
"""

from lakeaudit.functions.money import money, money_sum, pct_change
from lakeaudit.functions.json import extract_json_fields, json_is_valid, row_json
from lakeaudit.functions.time import seconds_between

__all__ = [
    "money",
    "money_sum",
    "pct_change",
    "extract_json_fields",
    "json_is_valid",
    "row_json",
    "seconds_between",
]
