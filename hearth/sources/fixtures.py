"""Housing-shaped views over the driver's TPC-H-like tables.

Each view is one SQL text with ``{table}`` placeholders. Spark runs it
through ``spark.sql(text, table=DataFrame)``; the DuckDB oracle formats the
same text with plain table names, so both engines start from identical
inputs. Money is kept integer-valued (whole cents, then ``floor``) so that
averages are exact in every engine.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

_STATE = ("substr('ABCDE',cast(n_nationkey % 5 as int)+1,1) || "
          "substr('VWXYZ',cast(floor(n_nationkey/5) as int)+1,1)")


def _zip(key: str) -> str:
    """A key as a zip code: five digits at least, never cut."""
    return (f"case when {key} < 10000 then lpad(cast({key} as string), 5, '0') "
            f"else cast({key} as string) end")


FX_SQL: dict[str, str] = {
    "fx_zip_market": f"""
select {_zip('l_suppkey')} as zip_code, s_name as city, {_STATE} as state,
       r_name || '-' || cast(s_suppkey % 4 as string) as metro_area,
       m.date, zhvi_sfr, zhvi_sfrcondo, zori_rent
from (select l_suppkey, cast(date_trunc('month', l_shipdate) as date) as date,
       cast(floor(cast(sum(cast(round(l_extendedprice * 100, 0) as bigint)) as double) / count(*) / 10) as double) as zhvi_sfr,
       cast(floor(cast(sum(cast(round(l_extendedprice * 100, 0) as bigint) * (100 - cast(round(l_discount * 100, 0) as bigint))) as double) / count(*) / 1000) as double) as zhvi_sfrcondo,
       case when min(l_quantity) < 10 then cast(floor(sum(l_quantity) * 60 / count(*)) as double) end as zori_rent
      from {{lineitem}} group by l_suppkey, cast(date_trunc('month', l_shipdate) as date)) m
join {{supplier}} on l_suppkey = s_suppkey
join {{nation}} on s_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey""",

    "fx_metro_market": """
select r_name || '-' || cast(c_custkey % 4 as string) as metro_area, r_name as state,
       cast(date_trunc('month', o_orderdate) as date) as date,
       cast(floor(cast(sum(cast(round(o_totalprice * 100, 0) as bigint)) as double) / count(*) / 100) as double) as median_sale_price,
       cast(10 + count(*) % 50 as double) as days_to_pending,
       cast(floor(cast(count(case when o_orderstatus = 'F' then 1 end) as double) * 100 / count(*)) as double) as market_heat_index,
       cast(count(*) as double) as for_sale_inventory,
       cast(count(case when o_orderpriority = '1-URGENT' then 1 end) as double) / count(*) as pct_sold_above_list
from {orders} join {customer} on o_custkey = c_custkey
join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
group by r_name || '-' || cast(c_custkey % 4 as string), r_name, cast(date_trunc('month', o_orderdate) as date)""",

    "fx_census": f"""
select {_zip('c_custkey')} as zip_code,
       case when c_custkey % 17 = 0 then null else cast(floor(40000 + c_acctbal * 8) as double) end as median_income,
       cast(1000 + c_custkey % 5000 as double) as total_units,
       cast(100 + (c_custkey * 7) % 6000 as double) as occupied_units,
       case when c_custkey % 13 = 0 then null else cast(30 + c_custkey % 60 as double) end as owner_occupied_pct,
       cast(4 + c_custkey % 5 as double) as median_rooms
from {{customer}}""",

    "fx_crosswalk": f"""
select {_zip('c_custkey')} as zip_code, {_STATE} as state, c_name as city,
       r_name || '-' || cast(c_custkey % 4 as string) as metro_area,
       c_mktsegment || case when c_custkey % 2 = 0 then ' County' else ' Parish' end as county_raw,
       c_mktsegment as county_clean
from {{customer}} join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey""",

    "fx_crime_raw": f"""
select c_mktsegment || ' County, ' || {_STATE} as county_name,
       cast(count(case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 1 end) as string) as murder,
       cast(count(case when o_orderpriority = '1-URGENT' and o_orderstatus = 'O' then 1 end) as string) as rape,
       cast(count(case when o_orderpriority = '2-HIGH' and o_orderstatus = 'F' then 1 end) as string) as robbery,
       cast(count(case when o_orderpriority = '2-HIGH' and o_orderstatus = 'O' then 1 end) as string) as agasslt,
       cast(count(case when o_orderpriority = '3-MEDIUM' then 1 end) as string) as burglry,
       cast(count(case when o_orderpriority like '4%' then 1 end) as string) as larceny,
       case when n_nationkey = 3 then 'n/a' else cast(count(case when o_orderpriority like '5%' then 1 end) as string) end as mvtheft,
       cast(count(distinct c_custkey) * 2000 as string) as population
from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey
group by c_mktsegment, n_nationkey""",

    "fx_aqi_raw": f"""
select {_STATE} as state_abbr, c_mktsegment || ' Parish' as county,
       cast(30 + (n_nationkey * 7 + length(c_mktsegment) * 5) % 60 as double) as median_aqi,
       cast(count(case when c_acctbal > 0 then 1 end) as double) as good_days,
       cast(count(*) as double) as days_with_aqi
from {{customer}} join {{nation}} on c_nationkey = n_nationkey group by n_nationkey, c_mktsegment""",

    "fx_amenity_raw": f"""
select {_STATE} as state, c_mktsegment as county,
       case when n_nationkey = 7 then null else cast(1 + (n_nationkey + length(c_mktsegment)) % 7 as double) end as amenity_rank,
       cast((n_nationkey * 13 + length(c_mktsegment)) % 40 - 20 as double) / 10 as topography_z,
       cast(n_nationkey % 11 as double) as water_area_pct
from {{customer}} join {{nation}} on c_nationkey = n_nationkey group by n_nationkey, c_mktsegment""",

    "fx_schools_raw": f"""
select p_partkey as school_id, {_zip('cast(floor(p_partkey / 3) as bigint)')} as lzip,
       p_size % 6 as sy_status, case when p_type = 'PROMO' then 'Yes' else 'No' end as charter_text,
       lower(p_brand) as lea_name, {_STATE} as lstate,
       case when p_type in ('SMALL','ECONOMY') then 'Elementary' when p_type in ('LARGE','STANDARD') then 'High' else 'Other' end as level
from {{part}} join {{nation}} on n_nationkey = p_partkey % 25""",

    "fx_seda_raw": f"""
select upper(p_brand) as sedaleaname, {_STATE} as stateabb, 2000 + p_size % 3 as year,
       cast(cast(round(p_retailprice * 100, 0) as bigint) % 1200 - 600 as string) as gys_mn_all
from {{part}} join {{nation}} on n_nationkey = p_partkey % 25""",

    "fx_features_base": f"""
select {_zip('c_custkey')} as zip_code, c_name as city, {_STATE} as state,
       case when c_custkey % 29 = 0 then null else r_name || '-' || cast(c_custkey % 4 as string) end as metro_area,
       cast(floor(cents / n * 3 / 100) as double) as zhvi_sfr,
       cast(floor(cents / n / 40) as double) as zhvi_sfrcondo,
       case when c_custkey % 5 = 0 then null else cast(floor(cents / n / 10000) as double) end as zori_rent,
       last_updated
from (select o_custkey, cast(sum(cast(round(o_totalprice * 100, 0) as bigint)) as double) as cents,
       count(*) as n, max(cast(o_orderdate as date)) as last_updated
      from {{orders}} group by o_custkey) o
join {{customer}} on o_custkey = c_custkey
join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey""",

    "fx_properties": f"""
select o_orderkey as property_id, {_zip('o_custkey')} as zip_code,
       cast(600 + o_orderkey % 3400 as double) as sqft, cast(1 + o_orderkey % 6 as int) as bedrooms,
       cast(1 + o_orderkey % 7 as double) / 2 + 0.5 as bathrooms, cast(1920 + o_orderkey % 82 as int) as year_built,
       case o_orderkey % 5 when 0 then 'excellent' when 1 then 'Good' when 2 then 'fair' when 3 then 'poor' else 'unheard' end as condition,
       case o_orderkey % 4 when 0 then 'single_family' when 1 then 'condo' when 2 then 'townhouse' else 'loft' end as property_type,
       o_orderkey % 3 = 0 as garage, cast(o_orderkey % 4 as int) as forecast_years
from {{orders}}""",

    "fx_preferences": """
select c_custkey as user_id, cast(300000 + (c_custkey * 37) % 700 * 1000 as double) as max_budget,
       case when c_custkey % 3 = 0 then null else cast(150000 + (c_custkey * 11) % 100 * 1000 as double) end as min_budget,
       case c_custkey % 4 when 0 then 'schools,family' when 1 then 'appreciate' when 2 then 'quiet,bogus' else '' end as priorities_csv
from {customer}""",
}


def _placeholders(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def fixture_sql_for_duckdb(name: str) -> str:
    """The view text with plain table names (DuckDB / ANSI side)."""
    text = FX_SQL[name]
    return text.format(**{t: t for t in _placeholders(text)})


def fixture(spark: SparkSession, sf_dir: str, name: str, tables: dict | None = None) -> DataFrame:
    """Build one fx_* view as a Spark DataFrame over the driver tables."""
    text = FX_SQL[name]
    tables = tables if tables is not None else {}
    for t in _placeholders(text):
        if t not in tables:
            tables[t] = read_table(spark, sf_dir, t)
    return spark.sql(text, **{t: tables[t] for t in _placeholders(text)})


class Fixtures:
    """Lazily built, memoised fx_* DataFrames for one sf directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}   # each driver table read once

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = fixture(self.spark, self.sf_dir, name, self._tables)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            return self[name]
        raise AttributeError(name)


@lru_cache(maxsize=None)
def duckdb_with_clause(names: tuple[str, ...]) -> str:
    """``WITH fx_a AS (...), fx_b AS (...)`` for the oracle SQL."""
    parts = [f"{n} AS ({fixture_sql_for_duckdb(n)}\n)" for n in names]
    return "WITH " + ",\n".join(parts)
