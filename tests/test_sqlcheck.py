"""Checks called from SQL against the column expressions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.operators import profile as profiles
from plumbline.plans import sqlcheck
from plumbline.plans.rules import Rule
from plumbline.queries import dq

SF = "/root/testdata/sf0.001"
CASES = [("not_null", "email", {}), ("not_placeholder", "email", {}), ("regex_match", "email", {"pattern": "^[^@]+@[a-z]+\\.com$"}), ("valid_phone", "phone", {}), ("no_surrounding_whitespace", "full_name", {}), ("non_negative", "annual_revenue", {}), ("in_reference_list", "country", {"list": "country"})]


@pytest.fixture(scope="module")
def rows(spark):
    d = dq.defects(spark, SF).cache()
    d.createOrReplaceTempView("checked")
    sqlcheck.register_checks(spark)
    return d


@pytest.mark.parametrize(("check", "column", "params"), CASES)
def test_equals_columns(spark, rows, check, column, params):
    import json

    rule = Rule("Q", check, "validity", check, params=params, column=column)
    o = checks.CELL_CHECKS[check](F.col(column).cast("string"), rule, checks.Context(rows, profiles.profile(rows.select("__row__", column), [column]), datetime(2024, 7, 1)))
    want = {r["state"]: (r["e"], r["f"]) for r in rows.groupBy("state").agg(F.count_if(o.evaluated).alias("e"), F.count_if(o.evaluated & o.failed).alias("f")).collect()}
    text = json.dumps(params).replace("\\", "\\\\").replace("'", "\\'")
    got = spark.sql(f"select * from dq_check(table(checked), '{check}', '{column}', '{text}', 'state')").collect()
    assert {r["part"]: (r["evaluated"], r["failed"]) for r in got} == want
    whole = spark.sql(f"select sum(evaluated) e, sum(failed) f from dq_check(table(select * from checked), '{check}', '{column}', '{text}')").first()
    assert (whole["e"], whole["f"]) == tuple(map(sum, zip(*want.values(), strict=True)))


@pytest.mark.parametrize(("call", "said"), [("table(checked), 'nope', 'email'", "no check"), ("table(checked), 'not_null', 'other'", "no column"), ("table(checked), 'regex_match', 'email'", "pattern")])
def test_refused(spark, rows, call, said):
    with pytest.raises(Exception, match=said):
        spark.sql(f"select * from dq_check({call})").collect()
