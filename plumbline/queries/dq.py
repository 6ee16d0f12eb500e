"""Queries of the data-quality engine, each with its DuckDB counterpart.

``D`` is a customer view with defects seeded by arithmetic on the key; its SQL
means the same in Spark and DuckDB, so expected counts can be computed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, refdata
from ..functions import text as X
from ..operators import checks, dependencies, fuzzy, records
from ..operators import profile as profiles
from ..operators.ranges import in_ranges
from ..plans import assess, registry, score, serve
from ..plans.rules import EMAIL, Rule, bind, default_pack
from ..shared import fresh_path, written
from ..sources.rowcsv import CsvDataset, read_csv, systematic

AS_OF = datetime(2024, 7, 1)
ROW = "__row__"
FIRST = "Ada,Bela,Cora,Dina,Emil,Fara,Gero,Hana,Ivan,Jana,Karl,Lena,Milo,Nora,Otto,Pia,Quin,Rosa,Sven,Tara"
LAST = "Abbot,Bodmer,Cobalt,Durand,Ebner,Fisker,Gruber,Hollis,Ibsen,Jansen,Kepler,Lorenz,Mercer,Novak,Ortega,Pruitt,Quirke,Rossi,Sander"
D = f"""
select k as __row__,
 case when k % 50 = 7 then 'CUS-' || lpad(cast(k - 1 as string), 9, '0') else 'CUS-' || lpad(cast(k as string), 9, '0') end customer_id,
 case when k % 25 = 3 then '  ' || n || ' ' when k % 28 = 5 then upper(n) else n end full_name,
 case when k % 17 = 0 then null when k % 23 = 1 then 'N/A' when k % 29 = 2 then 'person' || cast(k as string) when k % 61 = 4 then 'person' || cast(k as string) || '@gmial.com'
  else 'person' || cast(k as string) || '@' || split_part('gmail.com,yahoo.com,outlook.com,hotmail.com,icloud.com', ',', cast(k % 5 + 1 as int)) end email,
 case when k % 33 = 6 then 'call me' when k % 21 = 8 then cast(200 + k % 700 as string) || '.' || cast(100 + k % 900 as string) || '.' || cast(1000 + k % 9000 as string)
  else '(' || cast(200 + k % 700 as string) || ') ' || cast(100 + k % 900 as string) || '-' || cast(1000 + k % 9000 as string) end phone,
 split_part('Boston,New York,Chicago,Houston,Phoenix,Denver,Seattle,Atlanta,Miami,Portland', ',', cast(k % 10 + 1 as int)) city,
 split_part('MA,NY,IL,TX,AZ,CO,WA,GA,FL,OR', ',', cast(k % 10 + 1 as int)) state,
 case when k % 71 = 9 then '99501' else split_part('02108,10001,60601,77001,85001,80201,98101,30301,33101,97201', ',', cast(k % 10 + 1 as int)) end zip_code,
 case when k % 37 = 10 then 'Neverland' else 'US' end country,
 case when k % 53 = 11 then 'not a date' when k % 24 = 12 then substr(s, 9, 2) || '/' || substr(s, 6, 2) || '/' || substr(s, 1, 4) when k % 83 = 13 then '2025-03-01' else s end signup_date,
 case when k % 27 = 14 then '2021-05-05' else cast(date '2024-01-01' + cast(k % 180 as int) as string) end last_activity_date,
 case when k % 43 = 15 then 'zz-legacy-' || cast(k as string) else split_part('active,inactive,pending,closed', ',', cast(k % 4 + 1 as int)) end account_status,
 case when k % 97 = 16 then '999999999999' when k % 89 = 17 then cast(-(k % 1000) - 1 as string) else cast(50000 + k % 9973 as string) end annual_revenue,
 'P-' || cast(k % 6 as string) product_code,
 case when k % 101 = 18 then 'other thing' else split_part('anvil,bolt,crank,dowel,easel,flange', ',', cast(k % 6 + 1 as int)) end product_name
from (select c_custkey k, split_part('{FIRST}', ',', cast(c_custkey % 20 + 1 as int)) || ' ' || split_part('{LAST}', ',', cast(c_custkey % 19 + 1 as int)) n,
 cast(date '2022-01-01' + cast(c_custkey % 700 as int) as string) s from {{customer}}) base
"""
PLACEHOLDERS = ", ".join(f"'{p}'" for p in config.PLACEHOLDERS)
WITH_D = f"with d as ({D.format(customer='customer')})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(D, customer=table(spark, sf_dir, "customer"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


# Cell checks over D ---------------------------------------------------------


def check_query(check: str, column: str, params: dict, more: tuple[str, ...], rows: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = rows(spark, sf_dir).select(ROW, column, *more)
        context = checks.Context(df, profiles.profile(df, [column, *more]), AS_OF)
        rule = Rule("Q", check, "validity", check, params=params, column=column)
        o = checks.CELL_CHECKS[check](F.col(column).cast("string"), rule, context)
        out = context.df.agg(F.count_if(o.evaluated).alias("evaluated"), F.count_if(o.evaluated & o.failed).alias("failed")) if o else spark.sql("select 0L evaluated, 0L failed")
        return out.select(F.lit(column).alias("column_name"), "evaluated", "failed")

    return run


def present(c: str) -> str:
    return f"(trim(coalesce({c}, '')) <> '' and lower(trim({c})) not in ({PLACEHOLDERS}))"


def counts_sql(column: str, evaluated: str, failed: str, before: str = "", source: str = "d") -> str:
    return f"{WITH_D}{before} select '{column}' column_name, count(*) filter ({evaluated}) evaluated, count(*) filter (({evaluated}) and ({failed})) failed from {source}"


def add_check(check: str, column: str, evaluated: str, failed: str, params: dict | None = None, more: tuple[str, ...] = (), before: str = "", source: str = "d", suffix: str = "") -> None:
    add(f"chk_{check}{suffix}", check_query(check, column, params or {}, more, defects), counts_sql(column, evaluated, failed, before, source))


def day_of(c: str) -> str:
    return f"try_strptime(trim({c}), ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y'])"


def number_of(c: str) -> str:
    return f"try_cast({c} as double)"


P = present
add_check("not_null", "email", "true", "trim(coalesce(email, '')) = ''")
add_check("not_placeholder", "email", "trim(coalesce(email, '')) <> ''", f"lower(trim(email)) in ({PLACEHOLDERS})")
add_check("fill_rate_above", "email", "true", "trim(coalesce(email, '')) = '' and (select count(email) / count(*) from d) < 0.95", {"threshold": 0.95})
add_check("regex_match", "email", P("email"), f"not regexp_matches(trim(email), '(?i){EMAIL}')", {"pattern": EMAIL})
add_check("valid_phone", "phone", P("phone"), r"length(regexp_replace(phone, '[^0-9]', '', 'g')) not between 7 and 15")
add_check("parseable_date", "signup_date", P("signup_date"), f"{day_of('signup_date')} is null")
add_check("date_in_plausible_range", "signup_date", f"{P('signup_date')} and {day_of('signup_date')} is not null", f"{day_of('signup_date')} < timestamp '1900-01-01' or {day_of('signup_date')} > timestamp '2024-07-01' + interval 0 day", {"max_years_ahead": 0})
DOMAIN = """, f as (select account_status v, count(*) n, min(__row__) r from d group by 1), c as (select v, coalesce(sum(n) over (order by n desc, r rows between unbounded preceding and 1 preceding), 0) b, sum(n) over () t from (select * from f order by n desc, r limit 25)),
 dom as (select lower(v) v from c where b / t < 0.95 and (select count(*) from f) <= 25)"""
add_check("in_enum_domain", "country", P("country"), "lower(trim(country)) not in (select v from dom)", before=DOMAIN.replace("account_status", "country"))
add_check("numeric_range", "annual_revenue", f"{P('annual_revenue')} and {number_of('annual_revenue')} is not null", f"{number_of('annual_revenue')} < 0", {"allow_negative": False})
add_check("length_within", "account_status", P("account_status"), "length(trim(account_status)) > (select greatest(cast(floor(4 * avg(length(trim(account_status)))) as bigint), min(length(trim(account_status))) + 20) from d) or length(trim(account_status)) < 7", {"min": 7})
add_check("type_conforms", "signup_date", P("signup_date"), f"{day_of('signup_date')} is null", suffix="_date")
add_check("type_conforms", "annual_revenue", P("annual_revenue"), f"{number_of('annual_revenue')} is null")
MASK = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[0-9]+', '9', 'g'), '\p{{Lu}}+', 'A', 'g'), '\p{{Ll}}+', 'a', 'g'), '\s+', ' ', 'g')"
USUAL = f""", f as (select {MASK.format('phone')} v, count(*) n, min(__row__) r from d where trim(coalesce(phone, '')) <> '' group by 1), c as (select v, coalesce(sum(n) over (order by n desc, r rows between unbounded preceding and 1 preceding), 0) b, sum(n) over () t from f), usual as (select v from c where b / t < 0.9)"""
add_check("pattern_consistent", "phone", P("phone"), f"{MASK.format('phone')} not in (select v from usual)", {"coverage": 0.9}, before=USUAL)
CASING = "case when not regexp_matches(trim({0}), '\\p{{L}}') then 'none' when not regexp_matches(trim({0}), '\\p{{Ll}}') then 'upper' when not regexp_matches(trim({0}), '\\p{{Lu}}') then 'lower' when regexp_matches(trim({0}), '^\\p{{Lu}}') and not regexp_matches(trim({0}), '(^| )\\p{{Ll}}') then 'title' else 'mixed' end".format("full_name")
add_check("consistent_casing", "full_name", f"{P('full_name')} and {CASING} <> 'none'", f"{CASING} <> (select {CASING} from d where {P('full_name')} group by 1 order by count(*) desc, 1 limit 1)")
add_check("no_surrounding_whitespace", "full_name", "trim(coalesce(full_name, '')) <> ''", "full_name <> trim(full_name)")
FORMAT = "case when try_strptime(trim(signup_date), '%Y-%m-%d') is not null then '%Y-%m-%d' when try_strptime(trim(signup_date), '%d/%m/%Y') is not null then '%d/%m/%Y' else 'other' end"
add_check("single_date_format", "signup_date", P("signup_date"), f"{FORMAT} <> (select {FORMAT} from d group by 1 order by count(*) desc limit 1)")
COUNTRIES = ", ".join(f"'{c}'" for c in refdata.countries())
add_check("in_reference_list", "country", P("country"), f"lower(trim(country)) not in ({COUNTRIES})", {"list": "country"})
add_check("postcode_matches_country", "zip_code", f"{P('zip_code')} and {P('country')}", r"country = 'US' and not regexp_matches(trim(zip_code), '^\d{5}(-\d{4})?$')", more=("country",))
ZIPS = " ".join(f"when cast(substr(trim(zip_code), 1, 3) as int) between {a} and {b} then '{s}'" for a, b, s in refdata.ZIP_RANGES)
add_check("zip_matches_state", "zip_code", r"regexp_matches(trim(zip_code), '^\d{5}') and trim(coalesce(state, '')) <> ''", f"coalesce(case {ZIPS} end <> upper(trim(state)), false)", more=("state",))
MAIL = ", ".join(f"'{m}'" for m in refdata.MAIL_DOMAINS)
add_check("email_domain_plausible", "email", f"{P('email')} and contains(email, '@')", f"split_part(lower(trim(email)), '@', 2) not in ({MAIL}) and (select max(damerau_levenshtein(split_part(lower(trim(email)), '@', 2), m) <= 1) from (select unnest([{MAIL}]) m))")
add_check("not_future_date", "signup_date", f"{P('signup_date')} and {day_of('signup_date')} is not null", f"{day_of('signup_date')} > timestamp '2024-07-01'")
MAD = f", x as (select {number_of('annual_revenue')} v from d), m as (select median(v) m from x), a as (select median(abs(v - m)) mad from x, m)"
add_check("statistical_outlier", "annual_revenue", f"{P('annual_revenue')} and {number_of('annual_revenue')} is not null", f"abs({number_of('annual_revenue')} - (select m from m)) * 0.6745 / (select mad from a) > 3.5", {"threshold": 3.5}, before=MAD)
add_check("non_negative", "annual_revenue", f"{P('annual_revenue')} and {number_of('annual_revenue')} is not null", f"{number_of('annual_revenue')} < 0")
add_check("not_stale", "last_activity_date", f"{P('last_activity_date')} and {day_of('last_activity_date')} is not null", f"{day_of('last_activity_date')} < timestamp '2024-07-01' - interval 730 day", {"days": 730})
add_check("not_future_dated", "signup_date", f"{P('signup_date')} and {day_of('signup_date')} is not null", f"{day_of('signup_date')} > timestamp '2024-07-01'")
QUANTILES = f", q as (select quantile_cont(epoch_us({day_of('signup_date')})::double, [0.01, 0.99]) q from d)"
add_check("within_expected_range", "signup_date", f"{P('signup_date')} and {day_of('signup_date')} is not null", f"epoch_us({day_of('signup_date')}) < (select q[1] from q) - 86400000000.0 or epoch_us({day_of('signup_date')}) > (select q[2] from q) + 86400000000.0", {"margin_days": 1}, before=QUANTILES)


# Profiles -------------------------------------------------------------------


def cells_of(name: str, key: str, columns: tuple[str, ...]):
    return lambda spark, sf_dir: profiles.long_form(table(spark, sf_dir, name).withColumn(ROW, F.col(key).cast("long")), list(columns))


PART = ("p_name", "p_brand", "p_type", "p_size")
CELLS = "cells as (" + " union all ".join(f"select '{c}' col, p_partkey r, trim(cast({c} as varchar)) v from part" for c in PART) + ")"
D_CELLS = "cells as (" + " union all ".join(f"select '{c}' col, __row__ r, trim(cast({c} as varchar)) v from d" for c in ("full_name", "email", "phone", "signup_date", "account_status", "annual_revenue")) + ")"
D_COLUMNS = ("full_name", "email", "phone", "signup_date", "account_status", "annual_revenue")


def d_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.long_form(defects(spark, sf_dir), list(D_COLUMNS))


def counts_of(cells: DataFrame) -> DataFrame:
    c = profiles.counts(cells)
    return c.select("column", *[F.col(x).cast("long").alias(x) for x in ("total", "nulls", "blanks", "placeholders", "populated")], F.round("fill_rate", 6).alias("fill_rate"))


COUNTS_SQL = f"select col as \"column\", count(*) total, count(*) filter (v is null) nulls, count(*) filter (v = '') blanks, count(*) filter (lower(v) in ({PLACEHOLDERS})) placeholders, count(*) filter (v <> '') populated, round(count(*) filter (v <> '') / count(*), 6) fill_rate from cells group by col"
add("profile_counts", lambda s, d: counts_of(d_cells(s, d)), f"{WITH_D}, {D_CELLS} {COUNTS_SQL}")
add("profile_counts_part", lambda s, d: counts_of(cells_of("part", "p_partkey", PART)(s, d)), f"with {CELLS} {COUNTS_SQL}")
add("profile_distinct", lambda s, d: profiles.counts(d_cells(s, d)).select("column", F.col("distinct").alias("n_distinct"), F.round("distinct_ratio", 6).alias("distinct_ratio")), f"{WITH_D}, {D_CELLS} select col as \"column\", count(distinct v) n_distinct, round(least(count(distinct v) / count(v), 1), 6) distinct_ratio from cells where v <> '' group by col")
add("profile_lengths", lambda s, d: profiles.counts(d_cells(s, d)).select("column", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), F.round("mean_length", 6).alias("mean_length")), f"{WITH_D}, {D_CELLS} select col as \"column\", min(length(v)) min_length, max(length(v)) max_length, round(avg(length(v)), 6) mean_length from cells where v <> '' group by col")
add("profile_minmax", lambda s, d: profiles.counts(d_cells(s, d)).select("column", "min_value", "max_value"), f"{WITH_D}, {D_CELLS} select col as \"column\", min(v) min_value, max(v) max_value from cells where v <> '' group by col")
TOP_SQL = "select col as \"column\", key, n, first_row, rank from (select *, row_number() over (partition by col order by n desc, first_row) rank from (select col, {key} as key, count(*) n, min(r) first_row from cells where v <> '' group by 1, 2)) where rank <= {k}"
add("profile_topk", lambda s, d: profiles.top(d_cells(s, d), F.col("v"), 25).withColumn("rank", F.col("rank").cast("long")), f"{WITH_D}, {D_CELLS} {TOP_SQL.format(key='v', k=25)}")
add("profile_masks", lambda s, d: profiles.top(d_cells(s, d), X.mask(F.col("v")), 50).withColumn("rank", F.col("rank").cast("long")), f"{WITH_D}, {D_CELLS} {TOP_SQL.format(key=MASK.format('v'), k=50)}")
add("profile_samples", lambda s, d: profiles.samples(d_cells(s, d)).select("column", F.col("rank").cast("long").alias("rank"), "v"), f"{WITH_D}, {D_CELLS} select col as \"column\", rank, v from (select *, row_number() over (partition by col order by r) rank from cells where v <> '') where rank <= 3")
add("profile_numeric", lambda s, d: profiles.numbers(cells_of("orders", "o_orderkey", ("o_totalprice",))(s, d)).select("column", *[F.round(c, 4).alias(c) for c in ("num_min", "num_max", "num_mean", "num_median", "mad")], "negatives"), "with x as (select o_totalprice v from orders), m as (select median(v) m from x) select 'o_totalprice' as \"column\", round(min(v), 4) num_min, round(max(v), 4) num_max, round(avg(v), 4) num_mean, round(median(v), 4) num_median, round(median(abs(v - m)), 4) mad, count(*) filter (v < 0) negatives from x, m")
add("date_parse_rate", lambda s, d: profiles.rates(profiles.long_form(defects(s, d), ["signup_date", "last_activity_date"])).select("column", F.round("date_parse_rate", 6).alias("date_parse_rate"), "has_time"), f"{WITH_D}, cells as (select 'signup_date' col, signup_date v from d union all select 'last_activity_date', last_activity_date from d) select col as \"column\", round(avg(case when {day_of('v')} is null then 0.0 else 1.0 end), 6) date_parse_rate, bool_or(regexp_matches(v, '\\d{{1,2}}:\\d{{2}}')) has_time from cells where trim(v) <> '' group by col")
add("semantic_values", lambda s, d: profiles.rates(d_cells(s, d)).select("column", *[F.round(f"rate_{m}", 6).alias(f"rate_{m}") for m in ("email", "currency_code", "amount", "identifier", "person_name")]), f"{WITH_D}, {D_CELLS} select col as \"column\", " + ", ".join("round(avg(case when regexp_matches(v, '{}') then 1.0 else 0.0 end), 6) rate_{}".format(dict(config.SEMANTIC_VALUES)[m].replace("'", "''"), m) for m in ("email", "currency_code", "amount", "identifier", "person_name")) + " from cells where v <> '' group by col")


def profile_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    fields = "column string, inferred_type string, semantic_type string, cde_score double, is_cde boolean"
    return spark.createDataFrame([(c["column"], c["inferred_type"], c["semantic_type"], round(c["cde_score"], 4), c["is_cde"]) for c in rows], fields)


add("infer_type", lambda s, d: profile_rows(s, profiles.profile(table(s, d, "part").withColumn(ROW, F.col("p_partkey")).select(ROW, "p_partkey", *PART, "p_retailprice"))).select("column", "inferred_type"), f"with {CELLS.replace('cells as (', 'cells as (select ' + chr(39) + 'p_partkey' + chr(39) + ' col, p_partkey r, cast(p_partkey as varchar) v from part union all select ' + chr(39) + 'p_retailprice' + chr(39) + ', p_partkey, cast(p_retailprice as varchar) from part union all ')} select col as \"column\", case when avg(case when regexp_matches(v, '^-?[\\d,]+$') then 1.0 else 0 end) >= 0.95 then 'integer' when avg(case when try_cast(v as double) is not null then 1.0 else 0 end) >= 0.95 then 'decimal' else 'string' end inferred_type from cells group by col")
add("cde_score", lambda s, d: profile_rows(s, profiles.profile(defects(s, d))).select("column", "semantic_type", "cde_score", "is_cde"))
add("enum_domain", lambda s, d: profiles.enum_domains(profiles.top(profiles.long_form(defects(s, d), ["country", "product_name", "state"]), F.col("v"), 25), profiles.counts(profiles.long_form(defects(s, d), ["country", "product_name", "state"]))).withColumn("rank", F.col("rank").cast("long")), f"{WITH_D}, cells as (select 'country' col, __row__ r, country v from d union all select 'product_name', __row__, product_name from d union all select 'state', __row__, state from d), t as ({TOP_SQL.format(key='v', k=25)}), c as (select *, coalesce(sum(n) over (partition by \"column\" order by rank rows between unbounded preceding and 1 preceding), 0) b, sum(n) over (partition by \"column\") t from t) select \"column\", key, rank from c where b / t < 0.95")
add("sample_systematic", lambda s, d: systematic(table(s, d, "lineitem").select(F.col("l_orderkey").alias(ROW), "l_linenumber", "l_partkey"), above=1000, target=500).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts")), "with n as (select greatest(2, -((-count(*)) // 500)) every from lineitem) select l_linenumber, count(*) n, sum(l_partkey)::bigint parts from lineitem, n where ((((l_orderkey - 2) % 50000) + 50000) % 50000) % every = 0 group by 1")


# Records --------------------------------------------------------------------


def context_of(df: DataFrame, columns: list[str]) -> checks.Context:
    df = df.select(ROW, *columns)
    return checks.Context(df, profiles.profile(df, columns), AS_OF)


def counts_frame(spark: SparkSession, found: records.Found | None) -> DataFrame:
    return spark.createDataFrame([(found.evaluated, found.failed)] if found else [(0, 0)], "evaluated long, failed long")


def record_rule(check: str, **params) -> Rule:
    return Rule("Q", check, "uniqueness", check, params=params)


def dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW), "text")
    rows = records.later_occurrences(docs, F.lower(X.trimmed(F.col("text"))), F.left("text", F.lit(20)), "text")
    return rows.select("row", "failed")


LOWER = "lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))"
add("dup_exact", dup_documents, f"select doc_id as \"row\", row_number() over (partition by {LOWER} order by doc_id) > 1 failed from documents")
add("dup_key", lambda s, d: records.later_occurrences(defects(s, d), F.lower(X.trimmed(F.col("customer_id"))), X.shown(F.col("customer_id")), "customer_id").select("row", "column", "value", "failed"), f"{WITH_D} select __row__ as \"row\", 'customer_id' as \"column\", customer_id as value, row_number() over (partition by lower(trim(customer_id)) order by __row__) > 1 failed from d")
add("dup_exact_examples", lambda s, d: records.later_occurrences(defects(s, d), F.lower(X.trimmed(F.col("full_name"))), X.shown(F.col("full_name")), "full_name").where("failed").orderBy("row").limit(200).select("row", "reason"), f"{WITH_D} select r as \"row\", 'same as row ' || f reason from (select __row__ r, min(__row__) over (partition by lower(trim(full_name))) f from d) where r > f order by r limit 200")
FUZZY = ["full_name", "email", "phone"]
def fuzzy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(fuzzy.representatives(records.fuzzy_keys(context_of(defects(spark, sf_dir), FUZZY))), "fuzzy")


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings, row by row of the usual table."""
    row = f"list_prepend([0 for x in range(length({b}) + 1)], [[ascii(y)] for y in string_split({a}, '')])"
    cells = f"[[prev[i], prev[i + 1], case when ascii({b}[i]) = ch[1] then 1 else 0 end] for i in range(1, length({b}) + 1)]"
    return f"case when {a} = '' or {b} = '' then 0 else list_last(list_reduce({row}, lambda prev, ch: list_reduce(list_prepend([0], {cells}), lambda acc, t: list_append(acc, greatest(list_last(acc), t[2], t[1] + t[3]))))) end"


NORMAL = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"
FUZZY_SQL = f"""{WITH_D}, n as (select __row__ r, {NORMAL.format('full_name')} a, {NORMAL.format('email')} b, {NORMAL.format('phone')} c, lower(trim(coalesce(email, ''))) m, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') p from d),
 t as (select r, concat_ws(' ', nullif(a, ''), nullif(b, ''), nullif(c, '')) txt, list_sort(list_filter([case when length(a) >= 3 then 'n:' || left(a, 3) || left(regexp_replace(a, '[aeiou]', '', 'g'), 4) end,
  case when contains(m, '@') and split_part(m, '@', 1) <> '' then 'e:' || split_part(m, '@', 1) end, case when length(p) >= 7 then 'p:' || right(p, 7) end], lambda x: x is not null)) ks from n),
 f as (select txt, ks, min(r) r from t where txt <> '' group by 1, 2), k as (select r, txt, unnest(ks) k from f),
 q as (select distinct x.r a, y.r b, list_distinct(string_split(x.txt, ' ')) u, list_distinct(string_split(y.txt, ' ')) v from k x join k y on x.k = y.k and x.r < y.r),
 w as (select a, b, list_intersect(u, v) s, list_sort(list_filter(u, lambda x: not list_contains(v, x))) ul, list_sort(list_filter(v, lambda x: not list_contains(u, x))) vl from q),
 z as (select a, b, length(array_to_string(s, ' ')) n, len(s) m, array_to_string(ul, ' ') l, array_to_string(vl, ' ') r from w),
 o as (select a, b, n, m, l, r, {lcs_sql('l', 'r')} c from z where 200 * (n + 1 + least(length(l), length(r))) >= 88 * (2 * n + 2 + length(l) + length(r)) or m > 0),
 g as (select a, b, case when m > 0 and (l = '' or r = '') then 100.0 when m = 0 then 200.0 * c / (length(l) + length(r))
  else greatest(200.0 * (n + 1 + c) / (2 * n + 2 + length(l) + length(r)), 200.0 * n / (2 * n + 1 + length(l)), 200.0 * n / (2 * n + 1 + length(r))) end score from o)"""
add("dup_fuzzy_pairs", lambda s, d: fuzzy.pairs(fuzzy_rows(s, d)).withColumn("score", F.round("score", 6)), f"{FUZZY_SQL} select a, b, round(cast(score as double), 6) score from g where score >= 88")
# components of a graph with few links: labels spread along paths until none changes
add("dup_fuzzy_clusters", lambda s, d: records.components(fuzzy.connections(fuzzy_rows(s, d))), f"{FUZZY_SQL.replace('with d', 'with recursive d', 1)}, e as materialized (select a, b from g where score >= 88), h as (select a x, b y from e union select b, a from e), reach(x, y) as (select x, x from h union select reach.x, h.y from reach join h on reach.y = h.x) select x node, min(y) component from reach group by 1")
add("fd_pairs", lambda s, d: records.fd_conflicts(defects(s, d), [("product_code", "product_name"), ("zip_code", "state"), ("city", "state")]).groupBy("det", "dep").agg(F.count("*").alias("evaluated"), F.count_if("conflict").alias("conflicts"), F.count_distinct("key").alias("groups")), f"{WITH_D}, p as (select 'product_code' det, 'product_name' dep, lower(trim(product_code)) k, trim(product_name) v, __row__ r from d union all select 'zip_code', 'state', lower(trim(zip_code)), trim(state), __row__ from d union all select 'city', 'state', lower(trim(city)), trim(state), __row__ from d), q as (select *, first_value(v) over (partition by det, dep, k order by r) e from p) select det, dep, count(*) evaluated, count(*) filter (lower(v) <> lower(e)) conflicts, count(distinct k) as groups from q group by 1, 2")
add("fd_cardinality", lambda s, d: counts_frame(s, records.cardinality_holds(record_rule("cardinality_holds"), context_of(defects(s, d), ["city", "state"]))), f"{WITH_D}, q as (select lower(trim(state)) v, lower(first_value(trim(state)) over (partition by lower(trim(city)) order by __row__)) e, lower(trim(city)) v2, lower(first_value(trim(city)) over (partition by lower(trim(state)) order by __row__)) e2 from d) select 2 * count(*) evaluated, count(*) filter (v <> e) + count(*) filter (v2 <> e2) failed from q")
add("fd_nation_region", lambda s, d: records.fd_conflicts(table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.expr("c_nationkey = n_nationkey")).select(F.col("c_custkey").cast("long").alias(ROW), "n_name", F.col("n_regionkey").cast("string").alias("region")), [("n_name", "region"), ("region", "n_name")]).groupBy("det", "dep").agg(F.count("*").alias("evaluated"), F.count_if("conflict").alias("conflicts")), "with c as (select * from customer join nation on c_nationkey = n_nationkey), p as (select 'n_name' det, 'region' dep, lower(n_name) k, cast(n_regionkey as varchar) v, c_custkey r from c union all select 'region', 'n_name', cast(n_regionkey as varchar), n_name, c_custkey from c), q as (select *, first_value(v) over (partition by det, dep, k order by r) e from p) select det, dep, count(*) evaluated, count(*) filter (lower(v) <> lower(e)) conflicts from q group by 1, 2")
FD_COLUMNS = ["city", "state", "zip_code", "country", "account_status", "product_code", "product_name"]


def lattice_sql(source: str, columns: list[str]) -> str:
    """All dependencies up to two determinants by one grouping for each, then the minimal ones."""
    v = {c: f"case when {P(c)} then lower(trim({c})) end" for c in columns}
    sets = [(c,) for c in columns] + [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = "select '{n}' d, '{x}' p, '{a}' q, '{dep}' dep, coalesce(sum(n), 0) n, count(*) g, coalesce(sum(n - most), 0) bad from (select k, sum(c) n, max(c) most from (select {k} k, {v} v, count(*) c from {s} where ({k}) is not null and ({v}) is not null group by 1, 2) group by 1)"
    parts = [one.format(n=", ".join(s), x=s[0], a=s[-1], dep=dep, k=v[s[0]] if len(s) == 1 else f"({v[s[0]]}) || chr(31) || ({v[s[1]]})", v=v[dep], s=source) for s in sets for dep in columns if dep not in s]
    fits = "g >= 5 and g <= 0.6 * n and bad <= 0.05 * n + 1e-9"
    return f"m as ({' union all '.join(parts)}), c as (select unnest([{', '.join(repr(c) for c in columns)}]) c), u as (select c from c where (select count(distinct v) from (select unnest([{', '.join(v.values())}]) v, unnest([{', '.join(repr(c) for c in columns)}]) w from {source}) where w = c) > 1) select d determinants, dep dependent, cast(n as bigint) evaluated, g as groups, cast(bad as bigint) violations from m where {fits} and dep in (select c from u) and (p = q or not exists (select 1 from m o where o.p = o.q and o.dep = m.dep and o.p in (m.p, m.q) and o.g >= 5 and o.g <= 0.6 * o.n and o.bad <= 0.05 * o.n + 1e-9))"


add("fd_lattice", lambda s, d: dependencies.frame(defects(s, d), dependencies.search(defects(s, d), FD_COLUMNS)), f"{WITH_D}, {lattice_sql('d', FD_COLUMNS)}")
add("dep_populated", lambda s, d: counts_frame(s, records.dependent_field_populated(record_rule("dependent_field_populated", support=0.85), context_of(defects(s, d), ["phone", "email"]))), f"{WITH_D} select count(*) filter ({P('phone')}) evaluated, count(*) filter ({P('phone')} and not {P('email')}) failed from d having count(*) filter ({P('phone')} and {P('email')}) / count(*) filter ({P('phone')}) >= 0.85 union all select 0, 0 from (select count(*) filter ({P('phone')} and {P('email')}) / count(*) filter ({P('phone')}) s from d) where s < 0.85")
add("fk_orphans", lambda s, d: records.orphans(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), table(s, d, "orders"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("orphans")), "select count(*) orphans from lineitem where l_orderkey not in (select o_orderkey from orders)")
add("childless_parents", lambda s, d: records.orphans(table(s, d, "customer").select("c_custkey"), table(s, d, "orders"), "c_custkey", "o_custkey").select("c_custkey"), "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
add("lookup_codes", lambda s, d: records.orphans(table(s, d, "part").select("p_partkey", "p_brand"), table(s, d, "lineitem").select("l_partkey").distinct(), "p_partkey", "l_partkey").groupBy("p_brand").agg(F.count("*").alias("n")), "select p_brand, count(*) n from part where p_partkey not in (select l_partkey from lineitem) group by 1")


# Delimited files ---------------------------------------------------------------


def as_csv(df: DataFrame, name: str, range_bytes: int) -> CsvDataset:
    """A table written as delimited files, every value quoted, and read back by ranges of its bytes."""
    path = f"{fresh_path(df.sparkSession, name)}"
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return read_csv(df.sparkSession, path, range_bytes=range_bytes)


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their line breaks and quotes through files: what comes back, by language."""
    read = as_csv(table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "concat('\"', text, '\"\n,') as text"), "documents", 1 << 20).df
    return read.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(F.col("doc_id").cast("long")).alias("ids"))


def csv_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines that have a cell too many where the customer has a certain last digit: records, dropped and kept ones."""
    path = fresh_path(spark, "orders")
    line = "concat_ws(',', o_orderkey, o_custkey, concat('\"', o_orderpriority, '\n\"'), case when o_custkey % 10 = 3 then 'one too many' end)"
    lines = table(spark, sf_dir, "orders").selectExpr(f"{line} as value", "monotonically_increasing_id() & ((1L << 33) - 1) = 0 as first")
    # the first line of each task, and so of each file, gets the header before it
    lines.selectExpr("case when first then concat('order,customer,priority\n', value) else value end").write.text(path)
    got = read_csv(spark, path, range_bytes=1 << 18)
    kept = got.df.agg(F.count("*").alias("kept"), F.sum(F.col("order").cast("long")).alias("orders"))
    return kept.select(F.lit(got.records).cast("long").alias("records"), F.lit(got.dropped()).cast("long").alias("dropped"), "kept", "orders")


add("csv_scan", csv_scan, "select lang, count(*) n, cast(sum(length('\"' || text || '\"' || chr(10) || ',')) as bigint) chars, cast(sum(doc_id) as bigint) ids from documents group by 1")
add("csv_bad_rows", csv_bad_rows, "select count(*) records, count(*) filter (o_custkey % 10 = 3) dropped, count(*) filter (o_custkey % 10 <> 3) kept, cast(sum(o_orderkey) filter (o_custkey % 10 <> 3) as bigint) orders from orders")


# Ranges -------------------------------------------------------------------------


def part_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the parts whose range of keys (key less size to key plus size) holds their part's key."""
    ranges = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey - p_size as low", "p_partkey + p_size as high")
    found = in_ranges(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), ranges, "l_partkey", "low", "high")
    return found.groupBy("p_partkey").agg(F.count("*").alias("n"), F.sum("l_orderkey").cast("long").alias("orders"))


add("range_join", part_ranges, "select p_partkey, count(*) n, cast(sum(l_orderkey) as bigint) orders from lineitem join part on l_partkey between p_partkey - p_size and p_partkey + p_size group by 1")


# Examples, scores and serving -------------------------------------------------


def some_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule results of plain cell rules over D, as one fused aggregation and a stack."""
    d = defects(spark, sf_dir)
    x = {c: X.trimmed(F.col(c)) for c in ("email", "phone", "full_name", "signup_date")}
    parts = [
        ("COM-NULL-01", "completeness", "high", F.lit(True), x["email"] == ""),
        ("COM-PLACEHOLDER-01", "completeness", "medium", x["email"] != "", X.is_placeholder(x["email"])),
        ("VAL-PHONE-01", "validity", "medium", X.present(F.col("phone")), ~F.length(F.regexp_replace(x["phone"], r"\D", "")).between(7, 15)),
        ("VAL-DATE-PARSE-01", "validity", "high", X.present(F.col("signup_date")), X.date(F.col("signup_date")).isNull()),
        ("CON-WHITESPACE-01", "consistency", "low", x["full_name"] != "", F.col("full_name") != x["full_name"]),
    ]
    row = d.agg(*[f for k, p in enumerate(parts) for f in (F.count_if(p[3]).alias(f"e{k}"), F.count_if(p[3] & p[4]).alias(f"f{k}"))])
    made = F.array(*[F.struct(F.lit(p[0]).alias("rule_id"), F.lit(p[1]).alias("dimension"), F.lit(p[2]).alias("severity"), F.col(f"e{k}").alias("evaluated"), F.col(f"f{k}").alias("failed")) for k, p in enumerate(parts)])
    return row.select(F.explode(made).alias("r")).select("r.*")


RESULTS = f"""{WITH_D}, r as (
 select 'COM-NULL-01' rule_id, 'completeness' dimension, 'high' severity, 3 w, count(*) evaluated, count(*) filter (trim(coalesce(email, '')) = '') failed from d
 union all select 'COM-PLACEHOLDER-01', 'completeness', 'medium', 2, count(*) filter (trim(coalesce(email, '')) <> ''), count(*) filter (lower(trim(email)) in ({PLACEHOLDERS})) from d
 union all select 'VAL-PHONE-01', 'validity', 'medium', 2, count(*) filter ({P('phone')}), count(*) filter ({P('phone')} and length(regexp_replace(phone, '[^0-9]', '', 'g')) not between 7 and 15) from d
 union all select 'VAL-DATE-PARSE-01', 'validity', 'high', 3, count(*) filter ({P('signup_date')}), count(*) filter ({P('signup_date')} and {day_of('signup_date')} is null) from d
 union all select 'CON-WHITESPACE-01', 'consistency', 'low', 1, count(*) filter (trim(coalesce(full_name, '')) <> ''), count(*) filter (full_name <> trim(full_name)) from d)"""
SCORES = f"{RESULTS}, s as (select dimension, round(100 * (1 - sum(w * failed) / sum(w * evaluated)), 1) score from r group by 1)"
add("rule_results", some_results, f"{RESULTS} select rule_id, dimension, severity, evaluated, failed from r")
add("score_dimension", lambda s, d: score.dimension_scores(some_results(s, d)), f"{SCORES} select dimension, score from s")
add("score_overall", lambda s, d: score.overall(score.dimension_scores(some_results(s, d))), f"{SCORES} select round(avg(score), 1) overall from s")
add("score_band", lambda s, d: score.dimension_scores(some_results(s, d)).select("dimension", score.band(F.col("score")).alias("band")), f"{SCORES} select dimension, case when score >= 90 then 'healthy' when score >= 70 then 'needs attention' else 'critical' end band from s")
add("score_pooled", lambda s, d: score.dimension_scores(score.pooled({"a": some_results(s, d), "b": some_results(s, d).where("severity = 'high'")})), f"{RESULTS}, u as (select * from r union all select * from r where severity = 'high') select dimension, round(100 * (1 - sum(w * failed) / sum(w * evaluated)), 1) score from u group by 1")
add("rules_ranked", lambda s, d: score.ranked(some_results(s, d)).select("rule_id", F.round("pass_rate", 8).alias("pass_rate")), f"{RESULTS} select rule_id, round(1 - failed / evaluated, 8) pass_rate from r order by 2, 1")


def examples_of(spark: SparkSession, sf_dir: str, validity: str) -> DataFrame:
    d = defects(spark, sf_dir).select(ROW, "email", "phone")
    rules = [Rule("VAL-EMAIL-01", "", "validity", "regex_match", params={"pattern": EMAIL}, column="email", message="form"), Rule("COM-NULL-01", "", "completeness", "not_null", column="email", message="empty"), Rule("VAL-PHONE-01", "", "validity", "valid_phone", column="phone", message="digits")]
    context = checks.Context(d, [], AS_OF)
    bound = [(r, checks.CELL_CHECKS[r.check](F.col(r.column), r, context)) for r in rules]
    return assess.cell_examples(d, bound).where(F.col("validity") == validity).select("rule_id", "row", "value", "reason")


EXAMPLES = f"""{WITH_D}, e as (select 'VAL-EMAIL-01' rule_id, __row__ r, email v, not regexp_matches(trim(email), '(?i){EMAIL}') bad, 'form' why from d where {P('email')}
 union all select 'COM-NULL-01', __row__, email, trim(coalesce(email, '')) = '', 'empty' from d
 union all select 'VAL-PHONE-01', __row__, phone, length(regexp_replace(phone, '[^0-9]', '', 'g')) not between 7 and 15, 'digits' from d where {P('phone')}),
 k as (select *, row_number() over (partition by rule_id, bad order by r) n from e)"""
SHOWN = "case when v is null then '(null)' when trim(v) = '' then '(blank)' else left(v, 200) end as value"
add("examples_topn", lambda s, d: examples_of(s, d, "violation"), f"{EXAMPLES} select rule_id, r as \"row\", {SHOWN}, why reason from k where bad and n <= 200")
add("valid_examples_topn", lambda s, d: examples_of(s, d, "valid"), f"{EXAMPLES} select rule_id, r as \"row\", {SHOWN}, cast(null as varchar) reason from k where not bad and n <= 200")
add("rule_binding", lambda s, d: s.createDataFrame([(r.id, r.check, r.column, r.severity) for r in bind(default_pack(), profiles.profile(defects(s, d)))], "rule_id string, check_name string, column_name string, severity string"))
add("assess_full", lambda s, d: assess.assess(defects(s, d), AS_OF).results_frame())
add("registry_list", lambda s, d: registry.list_runs(registry.runs_from_orders(table(s, d, "orders"))), registry.LIST_SQL)
add("assessment_status", lambda s, d: registry.assessment_status(registry.runs_from_orders(table(s, d, "orders"))), registry.STATUS_SQL)
add("session_user", lambda s, d: registry.sessions(table(s, d, "orders"), table(s, d, "customer")), registry.SESSION_SQL)
add("dashboard_top5", lambda s, d: registry.dashboard(registry.runs_from_orders(table(s, d, "orders"))), registry.DASHBOARD_SQL)
add("picker_search", lambda s, d: serve.search(table(s, d, "part").select("p_partkey", "p_name", "p_brand"), "BRAND#3", "p_name", "p_brand").select("p_partkey"), "select p_partkey from part where contains(lower(p_name), 'brand#3') or contains(lower(p_brand), 'brand#3')")
add("unknown_values", lambda s, d: records.orphans(table(s, d, "customer").select("c_nationkey").distinct(), table(s, d, "supplier").select("s_nationkey").distinct(), "c_nationkey", "s_nationkey").select("c_nationkey"), "select distinct c_nationkey from customer where c_nationkey not in (select s_nationkey from supplier)")
