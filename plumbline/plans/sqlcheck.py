"""Cell checks that SQL can call: ``select * from dq_check(table(...), 'regex_match', 'email', '{"pattern": "@"}', 'country')``.

The result has one row for each value of the last argument's column (or, without one, a
row for each task, to be summed): how many values were evaluated, how many failed.  Rows
stream through; a group's rows are never held.  The checks are those that look at one value alone;
they decide as the column expressions of ``operators.checks`` do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from .. import config, refdata

#: What the engine strips from both ends of a value.
WHITE = re.compile(r"^\s+|\s+$", re.ASCII)


def stripped(x: str | None) -> str:
    return WHITE.sub("", x or "")


def present(x: str | None) -> bool:
    return stripped(x) != "" and stripped(x).lower() not in config.PLACEHOLDERS


def number(x: str | None) -> float | None:
    clean = re.sub(r"[,\s$€£₹]", "", stripped(x))
    return float(clean) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", clean, re.ASCII) else None


#: check -> (whether a value is evaluated, whether it fails), given its parameters.
Decision = tuple[Callable[[str | None, dict], bool], Callable[[str | None, dict], bool]]
LISTS = {"country": lambda: set(refdata.countries()), "currency": lambda: {c.lower() for c in refdata.CURRENCIES}, "us_state": lambda: set(refdata.states())}
CHECKS: dict[str, Decision] = {
    "not_null": (lambda x, p: True, lambda x, p: stripped(x) == ""),
    "not_placeholder": (lambda x, p: stripped(x) != "", lambda x, p: not present(x)),
    "regex_match": (lambda x, p: present(x), lambda x, p: not re.search(p["pattern"], stripped(x), re.I)),
    "valid_phone": (lambda x, p: present(x), lambda x, p: not 7 <= len(re.sub(r"[^0-9]", "", x)) <= 15),
    "no_surrounding_whitespace": (lambda x, p: stripped(x) != "", lambda x, p: x != stripped(x)),
    "non_negative": (lambda x, p: present(x) and number(x) is not None, lambda x, p: number(x) < 0),
    "in_reference_list": (lambda x, p: present(x), lambda x, p: stripped(x).lower() not in p["_list"]),
}


def register_checks(spark: SparkSession) -> None:
    """Makes ``dq_check`` known to a session's SQL."""
    spark.udtf.register("dq_check", udtf(CheckTable))


class CheckTable:
    """The rows of a table against one check of one column."""

    def __init__(self):
        self.evaluated = self.failed = 0
        self.by: str | None = None
        self.params: dict[str, Any] | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, check: AnalyzeArgument, column: AnalyzeArgument, params: AnalyzeArgument | None = None, by: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument of dq_check is a table")
        if check.value not in CHECKS:
            raise ValueError(f"there is no check {check.value} for SQL; there are {', '.join(CHECKS)}")
        names = rows.dataType.fieldNames()
        for c in (column, by):
            if c is not None and c.value is not None and c.value not in names:
                raise ValueError(f"the table has no column {c.value}")
        prepared_params(check.value, params.value if params else None)
        schema = StructType().add("part", StringType()).add("evaluated", LongType()).add("failed", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{by.value}`")] if by is not None and by.value is not None else [])

    def eval(self, rows, check: str, column: str, params: str | None = None, by: str | None = None):
        if self.params is None:
            self.params = prepared_params(check, params)
        if by is not None:
            self.by = None if rows[by] is None else str(rows[by])
        x = None if rows[column] is None else str(rows[column])
        asked, fails = CHECKS[check]
        if asked(x, self.params):
            self.evaluated += 1
            self.failed += bool(fails(x, self.params))

    def terminate(self):
        yield self.by, self.evaluated, self.failed


def prepared_params(check: str, text: str | None) -> dict[str, Any]:
    """The parameters of a check from JSON; ValueError for those that it lacks."""
    params = json.loads(text) if text else {}
    if check == "regex_match" and "pattern" not in params:
        raise ValueError("regex_match asks for a pattern")
    if check == "in_reference_list":
        if params.get("list") not in LISTS:
            raise ValueError(f"in_reference_list asks for a list: {', '.join(LISTS)}")
        params["_list"] = LISTS[params["list"]]()
    return params
