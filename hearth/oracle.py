"""Independent SQL twins of the registered queries (DuckDB dialect).

Written by hand from the formulas, not generated from the Spark plans; the
only shared pieces are the fixture view texts (the common input) and the
fixed value lists. Rounding is spelled out with the same arithmetic the
Spark side uses (see ``functions.numeric``) so both engines produce the
same bits.
"""

from __future__ import annotations

from .functions.clean import (COUNTY_SUFFIXES_CRIME, COUNTY_SUFFIXES_CROSSWALK,
                              COUNTY_SUFFIXES_QUALITY, STATE_SUFFIX_PATTERN)
from .functions.numeric import NUMERIC_PATTERN
from .sources.fixtures import fixture_sql_for_duckdb


# ----------------------------------------------------------------- helpers

def p10(k: int) -> str:
    return str(10 ** k)


def rhe(x: str, k: int) -> str:
    """pandas-style half-even rounding (k < 0: tens, hundreds, ...)."""
    if k < 0:
        return f"(round_even(({x}) / {p10(-k)}, 0) * {p10(-k)})"
    return f"(round_even(({x}) * {p10(k)}, 0) / {p10(k)})"


def dbl(x: float) -> str:
    """A DOUBLE literal (a bare 0.04 is DECIMAL in DuckDB)."""
    return f"cast({x!r} as double)"


def rhu(x: str, k: int) -> str:
    """half away from zero."""
    return f"(sign({x}) * floor(abs({x}) * {p10(k)} + 0.5) / {p10(k)})"


def num(x: str) -> str:
    return (f"(case when regexp_matches(cast({x} as varchar), '{NUMERIC_PATTERN}') "
            f"then try_cast(trim(cast({x} as varchar)) as double) end)")


def clip(x: str, lo: str | None, hi: str | None) -> str:
    out = x
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(case when ({x}) is not null then {out} end)"


def zfill5(x: str) -> str:
    t = f"trim(cast({x} as varchar))"
    return f"(case when length({t}) < 5 then lpad({t}, 5, '0') else {t} end)"


def clean_county(x: str, suffixes) -> str:
    out = f"upper(trim({x}))"
    for s in suffixes:
        out = f"trim(regexp_replace({out}, '{s}$', ''))"
    return out


def mean_rhu(x: str, decimals: int | None, digits: int) -> str:
    if decimals is None:
        return rhu(f"avg({x})", digits)
    m = f"(sum(round_even(({x}) * {p10(decimals)}, 0)) / cast(count({x}) as double))"
    if digits == decimals:
        return f"(sign({m}) * floor(abs({m}) + 0.5) / {p10(decimals)})"
    return rhu(f"({m} / {p10(decimals)})", digits)


def exact_mean(x: str, decimals: int) -> str:
    return (f"(sum(round_even(({x}) * {p10(decimals)}, 0)) / "
            f"(cast(count({x}) as double) * {p10(decimals)}))")


def tdiv(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def with_fx(*names: str) -> list[tuple[str, str]]:
    return [(n, fixture_sql_for_duckdb(n)) for n in names]


def render(ctes: list[tuple[str, str]], final: str) -> str:
    seen, parts = set(), []
    for name, body in ctes:
        if name in seen:
            continue
        seen.add(name)
        parts.append(f"{name} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + final


# ------------------------------------------------------------ ETL tables

def crosswalk_ctes():
    body = f"""
select distinct zip_code, state, city, metro_area, county_raw, county_clean from (
  select {zfill5('RegionName')} as zip_code, upper(trim(State)) as state, City as city,
         Metro as metro_area, trim(CountyName) as county_raw,
         {clean_county('CountyName', COUNTY_SUFFIXES_CROSSWALK)} as county_clean
  from (select cast(cast(zip_code as bigint) as varchar) as RegionName, lower(state) as State,
               city as City, metro_area as Metro, county_raw as CountyName from fx_crosswalk) r
) t where zip_code is not null and county_clean is not null"""
    return with_fx("fx_crosswalk") + [("crosswalk", body),
                                      ("xw_keys", "select zip_code, upper(trim(state)) as state, "
                                                  "upper(trim(county_clean)) as county_clean "
                                                  "from crosswalk")]


def _county_join(name: str, county_cte: str, metric_cols, state_col: str,
                 fuzzy: bool):
    m = ", ".join(metric_cols)
    mq = ", ".join(f"c.{c}" for c in metric_cols)
    key = "regexp_replace({}, '[^A-Z0-9]', '', 'g')".format
    on = f"{key('x.county_clean')} = {key('c.county_clean')}" if fuzzy else "x.county_clean = c.county_clean"
    ctes = [(f"{name}_chosen",
             f"select x.zip_code, x.county_clean, x.state, {mq}, x.county_clean <> c.county_clean as inexact "
             f"from xw_keys x join {county_cte} c on {on} and x.state = c.{state_col}")]
    order = ", ".join(f"{c} asc nulls first" for c in ["inexact", "county_clean", "state", *metric_cols])
    final = (f"select zip_code, {m} from (select *, row_number() over (partition by zip_code "
             f"order by {order}) as rn from {name}_chosen) t where rn = 1")
    ctes.append((name, final))
    return ctes


def crime_ctes(raw: str = "fx_crime_raw", name: str = "crime"):
    county = f"upper(trim(regexp_replace(trim(county_name), '{STATE_SUFFIX_PATTERN}', '')))"
    for s in COUNTY_SUFFIXES_CRIME:
        county = f"trim(regexp_replace({county}, '{s}$', ''))"
    state = (f"nullif(upper(trim(regexp_extract(trim(county_name), '{STATE_SUFFIX_PATTERN}', 1))), '')")
    cnt = {c: f"coalesce({num(c)}, 0)" for c in
           ("murder", "rape", "robbery", "agasslt", "burglry", "larceny", "mvtheft")}
    violent = f"({cnt['murder']} + {cnt['rape']} + {cnt['robbery']} + {cnt['agasslt']})"
    prop = f"({cnt['burglry']} + {cnt['larceny']} + {cnt['mvtheft']})"
    pop = num("population")
    denom = f"(case when {pop} = 0 then 1 else {pop} end)"
    rates = f"""
select {county} as county_clean, {state} as state_abbr,
       {rhe(f'{violent} / {denom} * 100000', 1)} as violent_crime_rate,
       {rhe(f'{prop} / {denom} * 100000', 1)} as property_crime_rate
from {raw}"""
    pv = f"(select quantile_cont(violent_crime_rate, 0.95) from {name}_rates)"
    pp = f"(select quantile_cont(property_crime_rate, 0.95) from {name}_rates)"
    v = f"({tdiv(clip('violent_crime_rate', '0', pv), pv)} * 60)"
    p = f"({tdiv(clip('property_crime_rate', '0', pp), pp)} * 40)"
    safety = clip(rhe(f"100 - ({v} + {p})", 1), "0", "100")
    county_df = f"""
select * from (select county_clean, state_abbr, violent_crime_rate, property_crime_rate,
                      {safety} as safety_index from {name}_rates) t
where county_clean is not null and state_abbr is not null and violent_crime_rate is not null
  and property_crime_rate is not null and safety_index is not null"""
    return crosswalk_ctes() + with_fx("fx_crime_raw") + [
        (f"{name}_rates", rates), (f"{name}_county", county_df)] + _county_join(
        name, f"{name}_county", ["violent_crime_rate", "property_crime_rate", "safety_index"],
        "state_abbr", True)


def air_quality_ctes():
    base = f"""
select {clean_county('county', COUNTY_SUFFIXES_QUALITY)} as county_clean,
       upper(trim(state_abbr)) as state_abbr, {num('median_aqi')} as median_aqi,
       {rhe(f"{num('good_days')} / (case when {num('days_with_aqi')} = 0 then 1 else {num('days_with_aqi')} end) * 100", 1)} as good_day_pct
from fx_aqi_raw"""
    p95 = "(select quantile_cont(median_aqi, 0.95) from aqi_base)"
    aqi = clip(rhe(f"100 - {tdiv(clip('median_aqi', '0', p95), p95)} * 100", 1), "0", "100")
    county_df = f"""
select * from (select county_clean, state_abbr, median_aqi, good_day_pct, {aqi} as air_quality_index
               from aqi_base) t
where county_clean is not null and state_abbr is not null and median_aqi is not null
  and good_day_pct is not null and air_quality_index is not null"""
    return crosswalk_ctes() + with_fx("fx_aqi_raw") + [("aqi_base", base), ("aqi_county", county_df)] + \
        _county_join("air_quality", "aqi_county", ["median_aqi", "good_day_pct", "air_quality_index"],
                     "state_abbr", False)


def amenities_ctes():
    rank = num("amenity_rank")
    county_df = f"""
select {clean_county('county', COUNTY_SUFFIXES_QUALITY)} as county_clean, upper(trim(state)) as state,
       {rank} as amenity_rank, {rhe(f'({rank} - 1) / 6 * 100', 1)} as natural_amenity_score,
       {num('topography_z')} as topography_z, {num('water_area_pct')} as water_area_pct
from fx_amenity_raw where {rank} is not null"""
    return crosswalk_ctes() + with_fx("fx_amenity_raw") + [("amenity_county", county_df)] + \
        _county_join("amenities", "amenity_county",
                     ["amenity_rank", "natural_amenity_score", "topography_z", "water_area_pct"],
                     "state", False)


def school_ctes():
    status = num("sy_status")
    body = f"""
select {zfill5("regexp_replace(cast(lzip as varchar), '^([0-9]{5})-[0-9]{4}$', '\\1')")} as zip_code,
       coalesce(cast(upper(trim(charter_text)) = 'YES' as integer), 0) as is_charter,
       upper(trim(lea_name)) as district_name, upper(trim(lstate)) as state,
       coalesce(cast(contains(upper(level), 'ELEMENTARY') as integer), 0) as is_elementary,
       coalesce(cast(contains(upper(level), 'HIGH') as integer), 0) as is_high
from fx_schools_raw
where (case when {status} = floor({status}) then cast({status} as bigint) end) in (1, 2, 3, 4)"""
    by_zip = f"""
select zip_code, count(*) as total_schools, cast(sum(is_charter) as bigint) as charter_schools,
       cast(sum(is_elementary) as bigint) as elementary_schools,
       cast(sum(is_high) as bigint) as high_schools,
       {rhe(tdiv('cast(sum(is_charter) as double)', 'cast(count(*) as double)') + ' * 100', 1)} as charter_pct
from schools group by zip_code"""
    return with_fx("fx_schools_raw") + [("schools", body), ("school_zip", by_zip),
                                        ("district_zip", "select distinct zip_code, district_name, "
                                                         "state from schools")]


def district_ctes():
    yr = num("year")
    yint = f"(case when {yr} = floor({yr}) then cast({yr} as bigint) end)"
    latest = f"(select max({yint}) from fx_seda_raw)"
    byd = f"""
select * from (
  select upper(trim(sedaleaname)) as district_name, upper(trim(stateabb)) as state,
         avg({num('gys_mn_all')}) as avg_score
  from fx_seda_raw where {yint} = {latest}
  group by upper(trim(sedaleaname)), upper(trim(stateabb))) t where avg_score is not null"""
    lo = "(select min(avg_score) from seda_by_district)"
    hi = "(select max(avg_score) from seda_by_district)"
    norm = rhe(f"{tdiv(f'avg_score - {lo}', f'{hi} - {lo}')} * 100", 1)
    scores = f"select district_name, state, {rhe(f'{norm} * 0.5 + {norm} * 0.5', 1)} as academic_score from seda_by_district"
    return with_fx("fx_seda_raw") + [("seda_by_district", byd), ("district_scores", scores)]


def education_ctes():
    seda_zip = f"""
select d.zip_code, {exact_mean('s.academic_score', 1)} as academic_score
from district_zip d left join district_scores s on d.district_name = s.district_name and d.state = s.state
group by d.zip_code"""
    p95 = "(select quantile_cont(cast(total_schools as double), 0.95) from edu_joined)"
    ts = "cast(total_schools as double)"
    norm = rhe(f"{tdiv(clip(ts, '0', p95), p95)} * 100", 1)
    edu_idx = rhe(f"coalesce(academic_score, 50) * 0.7 + coalesce({norm}, 50) * 0.3", 1)
    joined = "select z.*, s.academic_score from school_zip z left join seda_zip s on z.zip_code = s.zip_code"
    final = (f"select zip_code, total_schools, charter_schools, charter_pct, academic_score, "
             f"{edu_idx} as education_index from edu_joined")
    return school_ctes() + district_ctes() + [("seda_zip", seda_zip), ("edu_joined", joined),
                                              ("education", final)]


def census_ctes():
    inc = f"""
select {zfill5("trim(split_part('8600000US' || zip_code, 'US', -1))")} as zip_code,
       {num('cast(median_income as varchar)')} as median_income,
       cast(null as double) as income_margin
from fx_census"""
    hou = f"""
select {zfill5("trim(split_part('8600000US' || zip_code, 'US', -1))")} as zip_code,
       {num('cast(total_units as varchar)')} as total_units,
       {num('cast(occupied_units as varchar)')} as occupied_units,
       {num('cast(owner_occupied_pct as varchar)')} as owner_occupied_pct,
       {num('cast(median_rooms as varchar)')} as median_rooms
from fx_census"""
    final = """
select i.zip_code, i.median_income, i.income_margin, h.total_units, h.occupied_units,
       h.owner_occupied_pct, h.median_rooms
from census_income i join census_housing h on i.zip_code = h.zip_code
where i.median_income is not null and i.median_income > 0
  and h.total_units is not null and h.total_units > 0"""
    return with_fx("fx_census") + [("census_income", inc), ("census_housing", hou), ("census", final)]


def metro_snapshot_ctes():
    body = """
select metro_area, arg_max(median_sale_price, date) as median_sale_price,
       arg_max(days_to_pending, date) as days_to_pending,
       arg_max(market_heat_index, date) as market_heat_index
from fx_metro_market group by metro_area"""
    return with_fx("fx_metro_market") + [("metro_latest", body)]


def features_ctes():
    pti = "(b.zhvi_sfr / nullif(c.median_income, 0))"
    joined = f"""
select b.zip_code, b.city, b.state, b.metro_area, b.zhvi_sfr, b.zhvi_sfrcondo, b.zori_rent,
       m.median_sale_price, m.days_to_pending, m.market_heat_index,
       c.median_income, c.owner_occupied_pct, e.total_schools, e.academic_score, e.education_index,
       k.safety_index, k.violent_crime_rate, k.property_crime_rate,
       a.air_quality_index, a.median_aqi,
       n.natural_amenity_score, n.amenity_rank, n.topography_z, n.water_area_pct,
       {pti} as price_to_income_ratio, c.occupied_units * 2.1 as total_population,
       b.last_updated
from fx_features_base b
left join census c on b.zip_code = c.zip_code
left join education e on b.zip_code = e.zip_code
left join crime k on b.zip_code = k.zip_code
left join air_quality a on b.zip_code = a.zip_code
left join amenities n on b.zip_code = n.zip_code
left join metro_latest m on b.metro_area = m.metro_area"""
    aff = ("(case when price_to_income_ratio is not null then "
           + rhu("100 - least(price_to_income_ratio, 20) / 20 * 100", 1) + " end)")
    tier = """(case when price_to_income_ratio is null then 'Unknown'
       when price_to_income_ratio < 3 and education_index >= 55 then 'Hidden gem'
       when price_to_income_ratio < 5 and education_index >= 45 then 'Great value'
       when price_to_income_ratio < 8 then 'Fair market'
       when price_to_income_ratio < 12 then 'Premium' else 'Overpriced' end)"""
    dens = """(case when total_population >= 8000 then 'urban' when total_population >= 2500 then 'suburban'
       when total_population >= 800 then 'small_town' when total_population is not null then 'rural' end)"""
    scored = f"select *, {aff} as affordability_score, {tier} as value_tier, {dens} as pop_density_class from feat_joined"
    bonus = """(case value_tier when 'Hidden gem' then 100 when 'Great value' then 80
       when 'Fair market' then 60 when 'Premium' then 30 when 'Overpriced' then 0 end)"""
    total = ("coalesce(affordability_score, 50) * 0.25 + coalesce(safety_index, 50) * 0.2 + "
             "coalesce(education_index, 50) * 0.2 + coalesce(air_quality_index, 50) * 0.15 + "
             f"coalesce(natural_amenity_score, 50) * 0.12 + coalesce(cast({bonus} as double), 50) * 0.08")
    final = f"""
select zip_code, city, state, metro_area, zhvi_sfr, zhvi_sfrcondo, zori_rent, median_sale_price,
       days_to_pending, market_heat_index, median_income, owner_occupied_pct, total_schools,
       academic_score, education_index, safety_index, violent_crime_rate, property_crime_rate,
       air_quality_index, median_aqi, natural_amenity_score, amenity_rank, topography_z,
       water_area_pct, price_to_income_ratio, affordability_score, {rhu(total, 1)} as value_score,
       value_tier, total_population, pop_density_class, last_updated
from feat_scored"""
    return (with_fx("fx_features_base") + census_ctes() + education_ctes() + crime_ctes()
            + air_quality_ctes() + amenities_ctes() + metro_snapshot_ctes()
            + [("feat_joined", joined), ("feat_scored", scored), ("features", final)])


# ------------------------------------------------------------ query twins

SEARCH_COLS = ("zip_code, city, state, metro_area, zhvi_sfr, zhvi_sfrcondo, zori_rent, "
               "median_sale_price, days_to_pending, market_heat_index, median_income, "
               "owner_occupied_pct, total_schools, academic_score, education_index, "
               "price_to_income_ratio, affordability_score, value_score, value_tier, "
               "safety_index, violent_crime_rate, property_crime_rate, air_quality_index, "
               "median_aqi, natural_amenity_score, amenity_rank, total_population, "
               "pop_density_class, last_updated")


def _q_county_clean():
    up = f"upper(trim(regexp_replace(trim(county_name), '{STATE_SUFFIX_PATTERN}', '')))"
    state = f"nullif(upper(trim(regexp_extract(trim(county_name), '{STATE_SUFFIX_PATTERN}', 1))), '')"
    return render(with_fx("fx_crime_raw"), f"""
select county_name, {state} as state_abbr, {up} as county_upper,
       {clean_county(up, COUNTY_SUFFIXES_CRIME)} as county_crime,
       {clean_county(up, COUNTY_SUFFIXES_CROSSWALK)} as county_crosswalk,
       {clean_county(up, COUNTY_SUFFIXES_QUALITY)} as county_quality
from fx_crime_raw""")


def _q_crime_fuzzy():
    punct = ("select * replace (substr(county_name, 1, 2) || '.' || substr(county_name, 3) "
             "as county_name) from fx_crime_raw")
    ctes = with_fx("fx_crime_raw") + [("crime_raw_punct", punct)] + \
        crime_ctes(raw="crime_raw_punct", name="crime_fuzzy")
    return render(ctes, "select * from crime_fuzzy")


def _q_match_report():
    ctes = education_ctes() + crosswalk_ctes()
    return render(ctes, f"""
select count(academic_score) as academic_matched, count(*) as education_rows,
       (select count(*) from crosswalk) as crosswalk_rows,
       (select count(distinct zip_code) from crosswalk) as crosswalk_zips,
       (select count(distinct county_clean) from crosswalk) as crosswalk_counties,
       {rhe(tdiv('count(academic_score) * 100.0', 'count(*)'), 1)} as academic_match_pct
from education""")


def _feat(final: str) -> str:
    return render(features_ctes(), final)


def _as_of() -> str:
    return "(select max(date) from fx_zip_market)"


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["crosswalk"] = render(crosswalk_ctes(), "select * from crosswalk")
    q["county_clean"] = _q_county_clean()
    q["crime"] = render(crime_ctes(), "select * from crime")
    q["crime_fuzzy"] = _q_crime_fuzzy()
    q["air_quality"] = render(air_quality_ctes(), "select * from air_quality")
    q["amenities"] = render(amenities_ctes(), "select * from amenities")
    q["school_zip_stats"] = render(school_ctes(), "select * from school_zip")
    q["district_scores"] = render(district_ctes(), "select * from district_scores")
    q["education"] = render(education_ctes(), "select * from education")
    q["census_join"] = render(census_ctes(), "select * from census")
    q["features"] = _feat("select * from features")
    q["match_report"] = _q_match_report()

    q["search"] = _feat(f"""
select {SEARCH_COLS} from features
where zip_code is not null and education_index >= 30 and median_income >= 50000
order by value_score desc nulls last, zip_code asc limit 20""")
    q["search_affordable"] = _feat(f"""
select {SEARCH_COLS} from features
where zip_code is not null and (contains(lower(city), '0') or contains(zip_code, '0'))
  and zhvi_sfr <= 900000 and pop_density_class = 'urban'
order by price_to_income_ratio asc nulls last, zip_code asc limit 25""")
    q["search_quality"] = _feat(f"""
select {SEARCH_COLS} from features
where zip_code is not null and value_tier = 'Fair market' and total_population >= 1000
  and total_population <= 12000 and safety_index >= 10 and air_quality_index >= 20
order by safety_index desc nulls last, zip_code asc limit 30""")
    q["top_value_state"] = _feat("""
select zip_code, city, state, metro_area, zhvi_sfr, median_income, education_index, academic_score,
       market_heat_index, value_score as sort_metric
from features where value_score is not null and city is not null and upper(state) = 'AV'
order by value_score desc, zip_code asc limit 10""")
    q["kpis_metro"] = _feat(f"""
select {mean_rhu('zhvi_sfr', None, 0)} as avg_home_value,
       {mean_rhu('median_income', None, 0)} as avg_median_income,
       {mean_rhu('education_index', 1, 1)} as avg_education_index,
       {mean_rhu('owner_occupied_pct', 1, 1)} as avg_owner_occupied,
       count(distinct zip_code) as total_zip_codes, count(distinct metro_area) as total_metros
from features where zhvi_sfr is not null and contains(lower(metro_area), 'asia')""")
    q["distribution_state"] = _feat(f"""
select case when zhvi_sfr < 200000 then 'Under $200K' when zhvi_sfr < 400000 then '$200K - $400K'
            when zhvi_sfr < 600000 then '$400K - $600K' when zhvi_sfr < 800000 then '$600K - $800K'
            when zhvi_sfr < 1000000 then '$800K - $1M' else 'Over $1M' end as price_range,
       count(*) as zip_count, {mean_rhu('zhvi_sfr', None, 0)} as avg_value
from features where zhvi_sfr is not null and upper(state) = 'BW' group by 1 order by avg_value""")
    q["price_trends_metro"] = render(with_fx("fx_zip_market"), f"""
select cast(date_trunc('month', date) as date) as period,
       {mean_rhu('zhvi_sfr', None, 0)} as avg_zhvi_sfr,
       {mean_rhu('zhvi_sfrcondo', None, 0)} as avg_zhvi_sfrcondo,
       {mean_rhu('zori_rent', None, 0)} as avg_rent,
       count(distinct zip_code) as zip_count
from fx_zip_market where date >= {_as_of()} - interval 36 month and contains(lower(metro_area), 'europe')
group by cast(date_trunc('month', date) as date) order by period""")
    q["lookup"] = _feat("""
select * from features where zip_code in (select case when o_custkey < 10000 then lpad(cast(o_custkey as varchar), 5, '0') else cast(o_custkey as varchar) end from orders)""")
    q["price_history"] = render(with_fx("fx_zip_market", "fx_features_base"), f"""
select zip_code, date, zhvi_sfr, zhvi_sfrcondo, zori_rent from fx_zip_market
where date >= {_as_of()} - interval 24 month
  and zip_code in (select zip_code from fx_features_base)""")
    q["price_history_recent"] = render(with_fx("fx_zip_market", "fx_features_base"), f"""
select zip_code, date, zhvi_sfr, zhvi_sfrcondo, zori_rent from (
  select *, row_number() over (partition by zip_code order by date desc) as rn from fx_zip_market
  where date >= {_as_of()} - interval 24 month
    and zip_code in (select zip_code from fx_features_base)) t
where rn <= 6""")
    q["top_metric"] = _feat("""
select zip_code, city, state, metro_area, zhvi_sfr, median_income, education_index, academic_score,
       market_heat_index, education_index as sort_metric
from features where education_index is not null and city is not null
order by education_index desc, zip_code asc limit 10""")
    q["metros"] = _feat(f"""
select metro_area, state, count(distinct zip_code) as zip_count,
       {mean_rhu('zhvi_sfr', None, 0)} as avg_home_value,
       {mean_rhu('median_income', None, 0)} as avg_income,
       {mean_rhu('education_index', 1, 1)} as avg_education_index,
       {mean_rhu('market_heat_index', None, 2)} as avg_heat_index
from features where metro_area is not null group by metro_area, state
order by avg_home_value desc nulls last, metro_area, state limit 20""")
    q["kpis"] = _feat(f"""
select {mean_rhu('zhvi_sfr', None, 0)} as avg_home_value,
       {mean_rhu('median_income', None, 0)} as avg_median_income,
       {mean_rhu('education_index', 1, 1)} as avg_education_index,
       {mean_rhu('owner_occupied_pct', 1, 1)} as avg_owner_occupied,
       count(distinct zip_code) as total_zip_codes, count(distinct metro_area) as total_metros
from features where zhvi_sfr is not null""")
    for key, months, unit in (("price_trends_month", 24, "month"),
                              ("price_trends_quarter", 84, "quarter")):
        q[key] = render(with_fx("fx_zip_market"), f"""
select cast(date_trunc('{unit}', date) as date) as period,
       {mean_rhu('zhvi_sfr', None, 0)} as avg_zhvi_sfr,
       {mean_rhu('zhvi_sfrcondo', None, 0)} as avg_zhvi_sfrcondo,
       {mean_rhu('zori_rent', None, 0)} as avg_rent,
       count(distinct zip_code) as zip_count
from fx_zip_market where date >= {_as_of()} - interval {months} month
group by cast(date_trunc('{unit}', date) as date) order by period""")
    q["metro_compare"] = _feat(f"""
select metro_area, state, count(distinct zip_code) as zip_count,
       {mean_rhu('zhvi_sfr', None, 0)} as avg_home_value,
       {mean_rhu('zori_rent', None, 0)} as avg_rent,
       {mean_rhu('median_income', None, 0)} as avg_income,
       {mean_rhu('education_index', 1, 1)} as avg_education,
       {mean_rhu('owner_occupied_pct', 1, 1)} as avg_owner_pct
from features where metro_area is not null and zhvi_sfr is not null group by metro_area, state
order by avg_home_value desc nulls last, metro_area, state limit 15""")
    q["distribution"] = _feat(f"""
select case when zhvi_sfr < 200000 then 'Under $200K' when zhvi_sfr < 400000 then '$200K - $400K'
            when zhvi_sfr < 600000 then '$400K - $600K' when zhvi_sfr < 800000 then '$600K - $800K'
            when zhvi_sfr < 1000000 then '$800K - $1M' else 'Over $1M' end as price_range,
       count(*) as zip_count, {mean_rhu('zhvi_sfr', None, 0)} as avg_value
from features where zhvi_sfr is not null group by 1 order by avg_value""")
    q["edu_vs_value"] = _feat(f"""
select zip_code, city, state, {rhu('zhvi_sfr', 0)} as home_value,
       {rhu('education_index', 1)} as education_index, {rhu('median_income', 0)} as median_income
from features where zhvi_sfr is not null and education_index is not null and city is not null
order by zhvi_sfr desc, zip_code asc limit 100""")
    q["affordability"] = _feat(f"""
select zip_code, city, state, metro_area, {rhu('zhvi_sfr', 0)} as home_value,
       {rhu('median_income', 0)} as median_income,
       {rhu('zhvi_sfr / nullif(median_income, 0)', 2)} as price_to_income_ratio,
       {rhu('zori_rent', 0)} as monthly_rent, {rhu('education_index', 1)} as education_index
from features where zhvi_sfr is not null and median_income is not null and city is not null
order by price_to_income_ratio asc nulls first, zip_code asc limit 20""")
    q["top_metros"] = _feat(f"""
select * from (
  select metro_area, state, count(distinct zip_code) as zip_count,
         {mean_rhu('zhvi_sfr', None, 0)} as avg_home_value,
         {mean_rhu('median_income', None, 0)} as avg_income,
         {mean_rhu('education_index', 1, 1)} as avg_education,
         {mean_rhu('owner_occupied_pct', 1, 1)} as avg_ownership,
         {mean_rhu('zori_rent', None, 0)} as avg_rent
  from features where zhvi_sfr between 300000.0 and 600000.0 and metro_area is not null
  group by metro_area, state) t
where zip_count >= 3
order by avg_education desc nulls last, avg_income desc nulls last, metro_area, state limit 10""")
    q.update(panel_queries())
    q.update(source_queries())
    q["training_data_stored"] = q["training_data"]
    q.update(model_queries(q["training_data"]))
    q.update(recommend_queries())
    q["comparables"] = _feat("""
select target_zip, zip_code, city, state, zhvi_sfr, median_income, education_index, value_diff,
       cast(rn as integer) as rank
from (select t.zip_code as target_zip, n.zip_code, n.city, n.state, n.zhvi_sfr, n.median_income,
             n.education_index, abs(n.zhvi_sfr - t.zhvi_sfr) as value_diff,
             row_number() over (partition by t.zip_code
                                order by abs(n.zhvi_sfr - t.zhvi_sfr), n.zip_code) as rn
      from features t join features n on n.metro_area = t.metro_area and n.zip_code <> t.zip_code
      where n.zhvi_sfr is not null and t.zhvi_sfr is not null) p
where rn <= 5""")
    return q


def _valuation_ctes():
    year_now = "year((select max(date) from fx_zip_market))"
    cond = ("(case lower(p.condition) when 'excellent' then {e} when 'good' then {g} "
            "when 'fair' then {f} when 'poor' then {po} else {one} end)").format(
        e=dbl(1.10), g=dbl(1.00), f=dbl(0.88), po=dbl(0.75), one=dbl(1.0))
    typ = ("(case lower(p.property_type) when 'single_family' then {s} when 'condo' then {c} "
           "when 'townhouse' then {t} else {one} end)").format(
        s=dbl(1.00), c=dbl(0.88), t=dbl(0.93), one=dbl(1.0))
    base = f"coalesce(nullif(f.zhvi_sfr, 0), nullif(f.zhvi_sfrcondo, 0), {dbl(350000.0)})"
    est = (f"{base} * pow(p.sqft / {dbl(1800.0)}, {dbl(0.85)}) "
           f"* (1 + (p.bedrooms - 3) * {dbl(0.04)}) * (1 + (p.bathrooms - 2) * {dbl(0.03)}) "
           f"* greatest({dbl(0.65)}, 1 - greatest(0, {year_now} - p.year_built) * {dbl(0.003)}) "
           f"* {cond} * {typ} * (case when p.garage then {dbl(1.04)} else {dbl(1.0)} end)")
    vals = f"""
select p.property_id, p.zip_code, f.city, f.state, f.metro_area, p.forecast_years,
       {rhe(est, -2)} as estimated_value, {rhe(f'({est}) * {dbl(0.92)}', -2)} as low_estimate,
       {rhe(f'({est}) * {dbl(1.08)}', -2)} as high_estimate, {dbl(75.0)} as confidence,
       {rhe(f'({est}) / nullif(p.sqft, 0)', 2)} as price_per_sqft, 'fallback' as model_version
from fx_properties p join features f on p.zip_code = f.zip_code"""
    return features_ctes() + with_fx("fx_zip_market", "fx_properties") + [("valuations", vals)]


def _trend_rate(base: str) -> tuple[str, str]:
    """CTE body of the trailing trend, and the annual growth of a row joined to it as ``s``."""
    stats = f"""
select zip_code, count(*) as n_months, max(case when rn = 1 then zhvi_sfr end) as zhvi_last,
       max(case when rn = 12 then zhvi_sfr end) as zhvi_12th_last
from (select zip_code, zhvi_sfr, row_number() over (partition by zip_code order by date desc) as rn
      from fx_zip_market where date >= {_as_of()} - interval 14 month) t group by zip_code"""
    cur = f"coalesce(nullif(s.zhvi_last, 0), {base})"
    ago = f"coalesce(nullif(s.zhvi_12th_last, 0), {cur})"
    return stats, (f"(case when coalesce(s.n_months, 0) >= 12 and {ago} is not null and {ago} > 0 "
                   f"then least(greatest(({cur} - {ago}) / {ago}, {dbl(-0.1)}), {dbl(0.2)}) "
                   f"else {dbl(0.04)} end)")


def panel_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    as_of = _as_of()
    q["melt_wide"] = render(with_fx("fx_zip_market"), """
select zip_code, city, state, metro_area, date, zhvi_sfr from fx_zip_market where zhvi_sfr is not null""")
    q["align_outer"] = render(with_fx("fx_zip_market"), """
select zip_code, city, state, metro_area, date, zhvi_sfr, zhvi_sfrcondo, zori_rent from fx_zip_market""")
    q["zip_market_build"] = render(with_fx("fx_zip_market"), """
select zip_code, city, state, metro_area, cast(null as varchar) as county, date,
       zhvi_sfr, zhvi_sfrcondo, zori_rent from fx_zip_market""")
    q["metro_market_build"] = render(with_fx("fx_metro_market"), """
select metro_area, state, date, median_sale_price, days_to_pending, market_heat_index,
       for_sale_inventory, pct_sold_above_list from fx_metro_market""")
    q["snapshot"] = render(with_fx("fx_zip_market"), """
select zip_code, arg_max(city, date) as city, arg_max(state, date) as state,
       arg_max(metro_area, date) as metro_area, arg_max(zhvi_sfr, date) as zhvi_sfr,
       arg_max(zhvi_sfrcondo, date) as zhvi_sfrcondo,
       (select z2.zori_rent from fx_zip_market z2 where z2.zip_code = z.zip_code
        order by z2.date desc limit 1) as zori_rent,
       max(date) as last_updated
from fx_zip_market z group by zip_code""")
    q["market_trends"] = render(with_fx("fx_zip_market", "fx_features_base") + [
        ("tr_rows", f"""
select zip_code, date, zhvi_sfr, zhvi_sfrcondo, zori_rent from fx_zip_market
where date >= {as_of} - interval 12 month and zip_code in (select zip_code from fx_features_base)"""),
        ("tr_agg", """
select zip_code, count(*) as n, coalesce(arg_min(zhvi_sfr, date), 0) as f,
       coalesce(arg_max(zhvi_sfr, date), 0) as l from tr_rows group by zip_code""")], f"""
select r.*, case when a.n < 2 then cast(null as double) when a.f = 0 then {dbl(0.0)}
                 else {rhe('(a.l - a.f) / a.f * 100', 2)} end as appreciation
from tr_rows r join tr_agg a on r.zip_code = a.zip_code""")
    q["valuation_fallback"] = render(_valuation_ctes(), "select * from valuations")
    stats, rate = _trend_rate("v.estimated_value")
    fc = f"""
select v.property_id, v.estimated_value as base_value, {rate} as annual_rate, v.forecast_years
from valuations v left join trend_stats s on v.zip_code = s.zip_code where v.forecast_years >= 1"""
    proj = "(base_value * pow(1 + annual_rate, yr))"
    margin = f"({dbl(0.06)} + (yr - 1) * {dbl(0.03)})"
    q["forecast"] = render(_valuation_ctes() + [("trend_stats", stats), ("fc_base", fc)], f"""
select property_id, cast(year({as_of}) + yr as integer) as year,
       {rhe(proj, -2)} as projected_value, {rhe(f'{proj} * (1 - {margin})', -2)} as low_estimate,
       {rhe(f'{proj} * (1 + {margin})', -2)} as high_estimate,
       {rhe('annual_rate * 100', 1)} as annual_rate_pct,
       {rhe(f'({proj} - base_value) / nullif(base_value, 0) * 100', 1)} as total_gain_pct
from (select *, unnest(range(1, forecast_years + 1)) as yr from fc_base) t""")
    lag = "lag(z.zhvi_sfr, {n}) over (partition by z.zip_code order by z.date)"
    q["training_data"] = render(features_ctes() + with_fx("fx_zip_market"), f"""
select z.zhvi_sfr as home_value, z.zip_code, z.state, z.metro_area,
       cast(year(z.date) as integer) as year, cast(month(z.date) as integer) as month,
       z.zhvi_sfr as current_zhvi, z.zhvi_sfrcondo, z.zori_rent,
       (z.zhvi_sfr - {lag.format(n=12)}) / nullif({lag.format(n=12)}, 0) * 100 as price_yoy_pct,
       (z.zhvi_sfr - {lag.format(n=3)}) / nullif({lag.format(n=3)}, 0) * 100 as price_3mo_pct,
       c.median_income, c.owner_occupied_pct, c.total_units, c.median_rooms,
       e.education_index, e.academic_score, e.total_schools,
       m.median_sale_price as metro_median_price, m.days_to_pending as metro_days_pending,
       m.market_heat_index as metro_heat_index, m.for_sale_inventory as metro_inventory,
       m.pct_sold_above_list as metro_pct_above_list,
       nf.safety_index, nf.air_quality_index, nf.natural_amenity_score
from fx_zip_market z
left join census c on z.zip_code = c.zip_code
left join education e on z.zip_code = e.zip_code
left join fx_metro_market m on z.metro_area = m.metro_area and z.date = m.date
left join features nf on z.zip_code = nf.zip_code
where z.zhvi_sfr is not null and z.date >= date '1998-01-01' and c.median_income is not null""")
    return q


def model_queries(training: str) -> dict[str, str]:
    from .plans.training import FEATURE_COLS, SERVING_DEFAULTS
    q: dict[str, str] = {}
    tr = [("tr", f"select * from ({training}) t")]
    stats = " union all ".join(
        f"select '{c}' as feature, count({c}) as count, {rhu(f'avg(cast({c} as double))', 4)} as mean, "
        f"{rhu(f'stddev_samp(cast({c} as double))', 4)} as stddev, min(cast({c} as double)) as min, "
        + ", ".join(f"{rhu(f'quantile_cont(cast({c} as double), {p})', 4)} as {n}"
                    for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
        + f", max(cast({c} as double)) as max from tr" for c in FEATURE_COLS)
    q["training_stats"] = render(tr, stats)
    bucket = "(('0x' || substr(md5(zip_code || '|' || year || '|' || month), 1, 8))::ubigint % 100)"
    split = [("sp", f"""
select *, coalesce(state, 'UNKNOWN') as st,
       case when {bucket} < 15 then 'test' when {bucket} < 30 then 'validation' else 'train' end as split from tr"""),
             ("med", "select " + ", ".join(f"quantile_cont(cast({c} as double), 0.5) as {c}" for c in FEATURE_COLS)
              + " from sp where split = 'train'"),
             ("codes", "select s, row_number() over (order by s) - 1 as code from "
                       "(select distinct st as s from sp where split <> 'test') d")]
    q["model_inputs"] = render(tr + split, "select sp.zip_code, sp.year as panel_year, sp.month as panel_month, sp.split, "
                               "cast(coalesce(codes.code, 0) as double) as state_encoded, "
                               + ", ".join(f"{rhu(f'coalesce(cast(sp.{c} as double), med.{c}, 0)', 6)} as {c}" for c in FEATURE_COLS)
                               + " from sp cross join med left join codes on codes.s = sp.st")
    trend = f"""
select zip_code, count(*) as n_months, max(case when rn = 1 then zhvi_sfr end) as l1,
       max(case when rn = 12 then zhvi_sfr end) as l12, max(case when rn = 3 then zhvi_sfr end) as l3
from (select zip_code, zhvi_sfr, row_number() over (partition by zip_code order by date desc) as rn
      from fx_zip_market where date >= {_as_of()} - interval 14 month) t group by zip_code"""
    cur = "coalesce(nullif(s.l1, 0), 0.0)"

    def growth(lag):
        ago = f"coalesce(nullif(s.{lag}, 0), {cur})"
        return f"(case when coalesce(s.n_months, 0) >= 12 and {ago} <> 0 then ({cur} - {ago}) / {ago} * 100 else 0.0 end)"

    served = {"year": f"cast(year({_as_of()}) as double)", "month": f"cast(month({_as_of()}) as double)",
              "price_yoy_pct": growth("l12"), "price_3mo_pct": growth("l3")}
    for name, source, default in SERVING_DEFAULTS:
        served[name] = dbl(default) if source is None else f"coalesce(nullif(cast(f.{source} as double), 0), {dbl(default)})"
    base = features_ctes() + with_fx("fx_zip_market", "fx_properties") + [("tstats", trend)]
    joined = "from fx_properties p join features f on p.zip_code = f.zip_code left join tstats s on p.zip_code = s.zip_code"
    q["serving_inputs"] = render(base, "select p.property_id, "
                                 + ", ".join(f"cast({served[c]} as double) as {c}" for c in FEATURE_COLS) + f" {joined}")
    cond = (f"(case lower(p.condition) when 'excellent' then {dbl(1.08)} when 'good' then {dbl(1.0)} when 'fair' then {dbl(0.89)} "
            f"when 'poor' then {dbl(0.76)} else {dbl(1.0)} end)")
    typ = (f"(case lower(p.property_type) when 'single_family' then {dbl(1.0)} when 'condo' then {dbl(0.87)} "
           f"when 'townhouse' then {dbl(0.93)} else {dbl(1.0)} end)")
    est = (f"coalesce(nullif(f.zhvi_sfr, 0), {dbl(300000.0)}) * pow(p.sqft / {dbl(1800.0)}, {dbl(0.85)}) "
           f"* (1 + (p.bedrooms - 3) * {dbl(0.035)}) * (1 + (p.bathrooms - 2) * {dbl(0.025)}) "
           f"* greatest({dbl(0.70)}, 1 - greatest(0, year({_as_of()}) - p.year_built) * {dbl(0.0025)}) "
           f"* {cond} * {typ} * (case when p.garage then {dbl(1.035)} else {dbl(1.0)} end)")
    conf = (f"least({dbl(92.0)}, greatest({dbl(70.0)}, 100 - (select cast(count(distinct zip_code) % 7 as double) from fx_zip_market) * 3)) "
            "- (case when coalesce(f.median_income, 0) = 0 then 5 else 0 end) "
            "- (case when coalesce(f.education_index, 0) = 0 then 3 else 0 end) "
            "- (case when coalesce(s.n_months, 0) = 0 then 4 else 0 end)")
    valued = base + [("valued", f"select p.property_id, p.zip_code, p.sqft, {est} as est, {conf} as conf {joined}")]
    margin = "((100 - conf) / 100)"
    q["predict_given_price"] = render(valued, f"""
select property_id, zip_code, {rhe('est', -2)} as estimated_value, {rhe(f'est * (1 - {margin} * 1.2)', -2)} as low_estimate,
       {rhe(f'est * (1 + {margin} * 1.2)', -2)} as high_estimate, {rhe('conf', 1)} as confidence,
       {rhe('est / nullif(sqft, 0)', 2)} as price_per_sqft from valued""")
    q["metro_zip_counts"] = render(with_fx("fx_zip_market"), """
select metro_area, cast(date_trunc('quarter', date) as date) as quarter, count(distinct zip_code) as zip_count
from fx_zip_market where metro_area is not null group by all""")
    bad, long_ = "cast(gys_mn_all as integer) % 11 = 0", "length(sedaleaname) % 5 = 0"
    good = f"not ({long_}) and coalesce(not ({bad}), true)"
    q["load_rejects"] = render(with_fx("fx_seda_raw"), f"""
select count(*) filter ({good}) as accepted, sum(case when {good} then {num('gys_mn_all')} end) as score_sum,
       count(*) filter (not ({good})) as rejected, count(*) as rows_read, count(*) filter ({long_}) as malformed,
       count(*) filter (not ({long_}) and {bad}) as bad_score, cast(0 as bigint) as bad_year from fx_seda_raw""")
    note = "'Cañón ' || upper(trim(state))"
    q["raw_files"] = render(amenities_ctes(), f"""
select county_clean, state, amenity_rank, natural_amenity_score, topography_z, water_area_pct,
       (select min({note}) from fx_amenity_raw) as note_lo, (select max({note}) from fx_amenity_raw) as note_hi,
       (select count(*) from fx_amenity_raw) as rows_written from amenity_county""")
    return q


def source_queries() -> dict[str, str]:
    from .plans.registry import named_states
    from .functions.clean import STATE_ABBREVIATIONS
    q: dict[str, str] = {}
    yr = num("year")
    pair = f"""
select * from (
  select upper(trim(sedaleaname)) as district_name, upper(trim(stateabb)) as state,
         avg({num('gys_mn_all')}) as a0,
         avg(cast(length(sedaleaname) * 7 - cast(gys_mn_all as integer) % 300 as double)) as a1
  from fx_seda_raw where cast({yr} as bigint) = (select max(cast({yr} as bigint)) from fx_seda_raw)
  group by upper(trim(sedaleaname)), upper(trim(stateabb))) t where a0 is not null and a1 is not null"""
    n0, n1 = (rhe(tdiv(f"a{i} - (select min(a{i}) from pair_scores)",
                       f"(select max(a{i}) from pair_scores) - (select min(a{i}) from pair_scores)") + " * 100", 1)
              for i in (0, 1))
    q["district_scores_pair"] = render(with_fx("fx_seda_raw") + [("pair_scores", pair)], f"""
select district_name, state, {rhe(f'{n0} * 0.5 + {n1} * 0.5', 1)} as academic_score from pair_scores""")
    code = "case state_abbr " + " ".join(f"when '{k}' then '{STATE_ABBREVIATIONS[v]}'" for k, v in
                                         named_states().items() if v in STATE_ABBREVIATIONS) + " end"
    ctes = air_quality_ctes()
    names = [n for n, _ in ctes]
    q["aqi_state_names"] = render(ctes[:names.index("aqi_county") + 1], f"""
select county_clean, {code} as state_abbr, median_aqi, good_day_pct, air_quality_index from aqi_county
where {code} is not null""")
    q["census_two_headers"] = render(census_ctes(), "select * from census")
    q["labels"] = _feat("""
select zip_code, median_aqi, case when median_aqi <= 50 then 'Good' when median_aqi <= 100 then 'Moderate'
       when median_aqi is not null then 'Unhealthy' end as aqi_label, metro_area as short_metro from features""")
    stats, rate = _trend_rate("v.estimated_value")
    years = "greatest(coalesce(v.forecast_years, 0), 0)"
    value = rhe(f"v.estimated_value * pow(1 + {rate}, {years})", -2)
    q["predict_fallback"] = render(_valuation_ctes() + [("trend_stats", stats)], f"""
select v.property_id, v.zip_code, v.estimated_value, v.low_estimate, v.high_estimate, v.confidence,
       v.price_per_sqft, v.model_version, f.value_tier, f.zhvi_sfr, cast({years} as integer) as forecast_rows,
       case when {years} > 0 then cast(year({_as_of()}) + {years} as integer) end as last_year,
       case when {years} > 0 then {value} end as last_value,
       case when {years} > 0 then {rhe(f'{rate} * 100', 1)} end as annual_rate_pct
from valuations v join features f using (zip_code) left join trend_stats s on v.zip_code = s.zip_code""")
    q["unmatched_properties"] = render(features_ctes() + with_fx("fx_properties"), """
select property_id, zip_code from fx_properties
where zip_code not in (select zip_code from features where median_income is not null)""")
    q["panel_table"] = render(with_fx("fx_zip_market"), f"""
select zip_code, date, zhvi_sfr, zhvi_sfrcondo, zori_rent from fx_zip_market
where date >= {_as_of()} - interval 24 month""")
    return q


def _t(metric: str, scale: float, w: float) -> str:
    return (f"(case when {metric} is not null then least({dbl(1.0)}, {metric} / {dbl(scale)}) "
            f"* {dbl(w)} else {dbl(0.0)} end)")


def recommend_queries() -> dict[str, str]:
    from .plans.recommend import METRIC_MAX, PRIORITY_WEIGHTS
    q: dict[str, str] = {}
    prefs = """
select user_id, max_budget, min_budget,
       case when priorities_csv = '' then []::varchar[] else string_split(priorities_csv, ',') end as priorities
from fx_preferences"""
    pairs = f"""
select p.user_id, p.max_budget, p.min_budget, p.priorities, f.zip_code, f.city, f.state, f.metro_area,
       f.zhvi_sfr, f.zhvi_sfrcondo, f.zori_rent, f.median_income, f.owner_occupied_pct,
       f.education_index, f.academic_score, f.total_schools, f.last_updated
from rc_prefs p join features f
  on f.zhvi_sfr <= p.max_budget * {dbl(1.2)}
 and (coalesce(p.min_budget, 0) = 0 or f.zhvi_sfr >= p.min_budget * {dbl(0.8)})
where f.zhvi_sfr is not null and f.city is not null"""
    capped = """
select * from rc_pairs"""
    cases = " ".join(
        f"when '{name}' then [{', '.join(_t(m, METRIC_MAX.get(m, 100.0), w) for m, w in mw)}]"
        for name, mw in PRIORITY_WEIGHTS.items())
    psum = (f"list_reduce(list_prepend({dbl(0.0)}, flatten(list_transform(priorities, "
            f"lambda p: case p {cases} else []::double[] end))), lambda a, b: a + b)")
    hv, mx = "coalesce(zhvi_sfr, 0.0)", "max_budget"
    mn = f"coalesce(nullif(min_budget, 0), {mx} * {dbl(0.5)})"
    budget = (f"(case when {hv} <= {mx} and {hv} >= {mn} then greatest({dbl(0.0)}, {dbl(1.0)} - "
              f"abs({hv} - {mx} * {dbl(0.85)}) / nullif({mx} * {dbl(0.5)}, 0)) * 40 "
              f"when {hv} < {mn} then {dbl(15.0)} else {dbl(0.0)} - ({hv} - {mx}) / nullif({mx}, 0) * 30 end)")
    parts = f"select *, {budget} as _b, {psum} as _ps from rc_capped"
    s1 = "(case when len(priorities) > 0 then _b + _ps / len(priorities) * 40 else _b end)"
    s2 = f"({s1} + coalesce(nullif(education_index, 0), {dbl(0.0)}) / 100 * 10)"
    inc = f"coalesce(nullif(median_income, 0), {dbl(0.0)})"
    s3 = f"(case when {inc} > 50000 then {s2} + least({dbl(10.0)}, ({inc} - 50000) / 20000) else {s2} end)"
    score = rhe(f"least({dbl(100.0)}, greatest({dbl(0.0)}, {s3}))", 1)
    reason = f"""(case when education_index is not null and education_index <> 0 and education_index >= 60
            then 'Strong education index of ' || cast(education_index as varchar)
       when median_income is not null and median_income <> 0 and median_income >= 80000
            then 'Median income of $' || format('{{:,.0f}}', median_income)
       when zhvi_sfr is not null and zhvi_sfr <> 0 and zhvi_sfr <= max_budget then 'Within your budget'
       when zhvi_sfr is not null and zhvi_sfr <> 0 and zhvi_sfr <= max_budget * {dbl(1.1)}
            then 'Slightly above budget but strong match'
       else 'Matches your location and lifestyle preferences' end)"""
    scored = f"select *, {score} as match_score, {reason} as reason from rc_parts"
    def ctes(prefs: str, pairs: str):
        return features_ctes() + with_fx("fx_preferences") + [
            ("rc_prefs", prefs), ("rc_pairs", pairs), ("rc_capped", capped), ("rc_parts", parts),
            ("rc_scored", scored)]

    ranked = """
select user_id, cast(rk as integer) as rank, zip_code, city, state, metro_area, zhvi_sfr, zhvi_sfrcondo,
       zori_rent, median_income, owner_occupied_pct, education_index, academic_score, total_schools,
       last_updated, match_score, reason
from (select *, row_number() over (partition by user_id
                                   order by match_score desc, zhvi_sfr desc, zip_code) as rk
      from rc_scored) t where rk <= 10"""
    q["recommend"] = render(ctes(prefs, pairs), ranked)
    filtered_prefs = f"""
select *, case when user_id % 3 = 0 then substr('abcde', cast(user_id % 5 as int) + 1, 1)
                 || substr('vwxyz', cast(user_id // 5 % 5 as int) + 1, 1) end as u_state,
       case when user_id % 5 = 4 then 'A' end as u_metro,
       case when user_id % 4 = 1 then {dbl(50.0)} end as u_edu,
       case when user_id % 4 = 2 then {dbl(60000.0)} end as u_inc
from ({prefs})"""
    filtered_pairs = pairs + """
 and (p.u_state is null or upper(f.state) = upper(p.u_state))
 and (p.u_metro is null or contains(lower(f.metro_area), lower(p.u_metro)))
 and (p.u_edu is null or f.education_index >= p.u_edu)
 and (p.u_inc is null or f.median_income >= p.u_inc)"""
    q["recommend_filtered"] = render(ctes(filtered_prefs, filtered_pairs), ranked)
    q["recommend_unmatched"] = render(ctes(filtered_prefs, filtered_pairs),
                                      "select user_id from rc_prefs where user_id not in (select user_id from rc_pairs)")

    refs = ", ".join(f"coalesce(nullif({m}, 0), {dbl(d)}) as r_{m}" for m, d in
                     (("zhvi_sfr", 400000.0), ("median_income", 65000.0),
                      ("education_index", 50.0), ("owner_occupied_pct", 60.0)))
    dist = "sqrt(" + " + ".join(f"pow((c.{m} - t.r_{m}) / nullif(t.r_{m}, 0), 2)" for m in
                                ("zhvi_sfr", "median_income", "education_index",
                                 "owner_occupied_pct")) + ")"
    sim = [("sim_t", f"select zip_code as target_zip, {refs} from features"),
           ("sim_c", "select zip_code, city, state, metro_area, zhvi_sfr, median_income, education_index, "
                     "owner_occupied_pct from features where zhvi_sfr is not null and "
                     "median_income is not null and education_index is not null"),
           ("sim_p", f"select t.target_zip, c.*, {dist} as d from sim_t t join sim_c c "
                     f"on c.zip_code <> t.target_zip")]
    sim_full = [("sim_f", "select * from features where owner_occupied_pct is not null")] + [
        (n, b.replace("from features", "from sim_f")) for n, b in sim]
    q["similar_complete"] = render(features_ctes() + sim_full, f"""
select target_zip, cast(rn as integer) as rank, zip_code, city, state, metro_area, zhvi_sfr,
       median_income, education_index, owner_occupied_pct,
       {rhe(f"greatest({dbl(0.0)}, 100 - coalesce(nullif(d, 0), {dbl(1.0)}) * 50)", 1)} as similarity_score
from (select *, row_number() over (partition by target_zip order by d asc nulls first, zip_code) as rn
      from sim_p) t where rn <= 5""")
    q["similar"] = render(features_ctes() + sim, f"""
select target_zip, cast(rn as integer) as rank, zip_code, city, state, metro_area, zhvi_sfr,
       median_income, education_index, owner_occupied_pct,
       {rhe(f"greatest({dbl(0.0)}, 100 - coalesce(nullif(d, 0), {dbl(1.0)}) * 50)", 1)} as similarity_score
from (select *, row_number() over (partition by target_zip order by d asc nulls first, zip_code) as rn
      from sim_p) t where rn <= 5""")
    return q
