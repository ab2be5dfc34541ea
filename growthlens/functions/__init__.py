"""Column functions: tolerant parsing, safe arithmetic, row-wise combinations."""

from growthlens.functions.dates import iso_text, month_start, month_year, year_of, year_start
from growthlens.functions.numbers import half_even, plain_number, ratio, row_mean, row_sum, safe_rate, to_number
from growthlens.functions.text import bracket_or_tail, mapped

__all__ = [
    "bracket_or_tail",
    "half_even",
    "iso_text",
    "mapped",
    "month_start",
    "month_year",
    "plain_number",
    "ratio",
    "row_mean",
    "row_sum",
    "safe_rate",
    "to_number",
    "year_of",
    "year_start",
]
