"""Registry of runs and assessments: small tables, and the queries that list them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_LIMIT = 200


def derived_status(statuses: Column) -> Column:
    """An assessment's status from its runs': one processing, then one awaiting, then one failed, else completed."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(has("processing"), "processing").when(has("awaiting_cdes"), "awaiting_cdes").when(has("failed"), "failed").otherwise("completed")


def list_runs(runs: DataFrame, owner: int | None = None, limit: int = RUN_LIMIT) -> DataFrame:
    """Single runs, newest first; the overall score only of completed ones."""
    own = runs.where("assessment_id is null")
    if owner is not None:
        own = own.where(F.col("owner_id") == owner)
    return own.select("run_id", "owner_id", "status", "created", F.when(F.col("status") == "completed", F.col("overall")).alias("overall")).orderBy(F.desc("created"), F.desc("run_id")).limit(limit)


def assessment_status(runs: DataFrame) -> DataFrame:
    """Each assessment with its runs, their number and its derived status."""
    grouped = runs.where("assessment_id is not null").groupBy("assessment_id").agg(F.count("*").alias("n_runs"), F.collect_set("status").alias("s"))
    return grouped.select("assessment_id", "n_runs", derived_status(F.col("s")).alias("status"))


def sessions(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Valid sessions with their user; here an order is a session of its customer."""
    live = tokens.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"))
    return live.join(users.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name")), "user_id")


def dashboard(runs: DataFrame, newest: int = 5) -> DataFrame:
    """The newest completed runs, the lowest first, with their average and how many are below 70."""
    recent = runs.where("status = 'completed'").orderBy(F.desc("created"), F.desc("run_id")).limit(newest)
    both = recent.agg(F.round(F.avg("overall"), 1).alias("average"), F.count_if(F.col("overall") < 70).alias("below"))
    return recent.crossJoin(F.broadcast(both)).select("run_id", "overall", "average", "below").orderBy("overall", "run_id")


def delete_cascade(runs: DataFrame, assessment_id: int) -> DataFrame:
    """The runs left after an assessment is deleted."""
    return runs.where(F.col("assessment_id").isNull() | (F.col("assessment_id") != assessment_id))


def expired(runs: DataFrame, before) -> DataFrame:
    """Runs created before a moment."""
    return runs.where(F.col("created") < F.lit(before))


def claimed(runs: DataFrame, owner: int) -> DataFrame:
    """Ownerless runs given to an owner."""
    return runs.withColumn("owner_id", F.coalesce("owner_id", F.lit(owner).cast(runs.schema["owner_id"].dataType)))


def runs_from_orders(orders: DataFrame) -> DataFrame:
    """Orders read as runs: for trying the registry on the standard tables."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "awaiting_cdes").otherwise("processing")
    return orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 100).alias("assessment_id"),
        status.alias("status"), F.col("o_orderdate").alias("created"), F.round(F.col("o_totalprice") % 100, 1).alias("overall"),
    )


RUNS_SQL = """with runs as (select o_orderkey run_id, o_custkey owner_id, case when o_orderkey % 3 = 0 then o_custkey % 100 end assessment_id,
 case o_orderstatus when 'F' then 'completed' when 'O' then 'awaiting_cdes' else 'processing' end status, o_orderdate created, round(o_totalprice % 100, 1) overall from orders)"""
LIST_SQL = f"{RUNS_SQL} select run_id, owner_id, status, created, case when status = 'completed' then overall end overall from runs where assessment_id is null order by created desc, run_id desc limit 200"
STATUS_SQL = f"{RUNS_SQL} select assessment_id, count(*) n_runs, case when bool_or(status = 'processing') then 'processing' when bool_or(status = 'awaiting_cdes') then 'awaiting_cdes' when bool_or(status = 'failed') then 'failed' else 'completed' end status from runs where assessment_id is not null group by 1"
SESSION_SQL = "select o_custkey user_id, o_orderkey session_id, c_name user_name from orders join customer on c_custkey = o_custkey where o_orderstatus = 'O'"
DASHBOARD_SQL = f"{RUNS_SQL}, r as (select * from runs where status = 'completed' order by created desc, run_id desc limit 5) select run_id, overall, (select round(avg(overall), 1) from r) average, (select count(*) filter (overall < 70) from r) below from r"
