"""Quality control (Q), climate aggregates (A1 to A4), windows (W1 to W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import climate, quality
from . import cleaning
from .registry import nudged, nudged_sql, query, r
from .standin import LAGS, lag_sql

DAY = "cast(datetime as date) as Date"


def _dated(df, *columns):
    return df.select(F.col("datetime").cast("date").alias("Date"), "site", *columns)


@query("q1_temperature_order", f"""
    select {DAY}, site, round(case when ok then TMIN end, 6) as TMIN, round(case when ok then TAVG end, 6) as TAVG, round(case when ok then TMAX end, 6) as TMAX
    from (select *, coalesce(TMIN < TAVG and TAVG < TMAX, false) as ok from derived)""")
def q1(t):
    return _dated(quality.null_unordered_temperatures(t.derived), r("TMIN"), r("TAVG"), r("TMAX"))


@query("q2_temperature_range", f"select {DAY}, site, round(TMIN, 6) as TMIN, round(TAVG, 6) as TAVG, round(TMAX, 6) as TMAX from controlled")
def q2(t):
    checked = t.derived.transform(quality.null_unordered_temperatures).transform(quality.null_extreme_temperatures)
    return _dated(checked, r("TMIN"), r("TAVG"), r("TMAX"))


@query("q3_precipitation_limits", f"select {DAY}, site, round(PRECIPITATION, 6) as PRECIPITATION from controlled")
def q3(t):
    return _dated(t.derived.transform(quality.attach_precipitation_threshold, "Station Name").transform(quality.null_bad_precipitation), r("PRECIPITATION"))


@query("q4_precipitation_threshold", 'select "Station Name", round(threshold, 6) as threshold from thresholds')
def q4(t):
    return quality.precipitation_threshold(t.derived, "Station Name").select("Station Name", r("threshold"))


_PROFILED = ["TMIN", "TAVG", "TMAX", "PRECIPITATION", "Sturm_DOWY", "SWE"]


@query("q5_missing_profile", " union all ".join(f"select '{c}' as column_name, count(*) - count({c}) as missing from controlled" for c in _PROFILED))
def q5(t):
    return quality.missing_profile(t.controlled.select(*_PROFILED))


@query("q6_merge_report", """
    select (select count(*) from snow) as rows_before, (select count(distinct Site) from snow) as sites_before, count(*) as rows_after,
      count(distinct case when latitude is not null and longitude is not null then Site end) as sites_located,
      count(*) filter (latitude is null) as missing_latitude, count(*) filter (longitude is null) as missing_longitude
    from snow left join stations on Site = triplets""")
def q6(t):
    return quality.merge_report(t.snow, t.located(t.snow), "Site", ["Latitude", "Longitude"])


@query("a1_monthly_mean_temperature", 'select "Station Name", cast(year as int) as year, cast(month as int) as month, ' + nudged_sql("mean_temp") + ' from monthly')
def a1(t):
    return climate.monthly_mean_temperature(t.controlled, "Station Name", "datetime").select("Station Name", "year", "month", nudged("mean_temp"))


@query("a2_temperature_difference", 'select "Station Name", cast(year as int) as year, round(Temp_Diff, 6) as Temp_Diff from spread')
def a2(t):
    return climate.temperature_difference(t.controlled, "Station Name", "datetime").select("Station Name", "year", r("Temp_Diff"))


@query("a3_winter_precip", "select Station_Name, winter, round(PPTWT, 6) as PPTWT from winters")
def a3(t):
    return climate.winter_precipitation(t.controlled, "Station_Name", "datetime").select("Station_Name", "winter", r("PPTWT"))


@query("a4_winter_label", f"select {DAY}, site, winter, cast(winter_end - 1 as int) as winter_start, cast(winter_end as int) as winter_end from derived")
def a4(t):
    return _dated(t.derived, "winter", "winter_start", "winter_end")


@query("w1_previous_value", f"select {DAY}, site, round(prev_TAVG, 6) as previous from shifted")
def w1(t):
    """One row back within the station, read off the 1-day trailing mean's source."""
    sliced = climate.previous_row(t.controlled, "Station Name", "datetime", ["TAVG"])
    return _dated(sliced, r("TAVG_previous", 6, "previous"))


@query("w2_trailing_mean", f"select {DAY}, site, {', '.join(nudged_sql(climate.lag_name(c, w)) for c in cleaning.LAG_COLUMNS for w in LAGS)} from history")
def w2(t):
    lagged = climate.lag_features(t.controlled, "Station Name", "datetime", list(cleaning.LAG_COLUMNS), LAGS)
    return _dated(lagged, *[nudged(climate.lag_name(c, w)) for c in cleaning.LAG_COLUMNS for w in LAGS])


@query("w3_warm_up_mask", """
    select event_id, round(case when ts >= first_seen + interval 14 day then avg(prev) over (partition by user_id order by epoch_us(ts)
        range between 1209599999999 preceding and current row) end, 9) as value_lag_14d
    from (select event_id, user_id, ts, lag(value) over (partition by user_id order by ts) as prev,
            min(ts) over (partition by user_id) as first_seen from events)""")
def w3(t):
    """Irregular timestamps: event streams per user."""
    events = t.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return climate.lag_features(events, "user_id", "ts", ["value"], [14]).select("event_id", r("value_lag_14d", 9))


_ALL = [(c, w) for c in cleaning.LAG_COLUMNS for w in range(1, 31)]


@query("w4_lag_features", f"select {DAY}, site, {', '.join(nudged_sql(climate.lag_name(c, w)) for c, w in _ALL)} from (select *, {', '.join(lag_sql(c, w) for c, w in _ALL)} from shifted)")
def w4(t):
    """All 60 lag columns."""
    lagged = climate.add_multiple_lags(t.controlled, list(cleaning.LAG_COLUMNS), 30)
    return _dated(lagged, *[nudged(climate.lag_name(c, w)) for c, w in _ALL])
