"""Scalar functions (C1 to C20) over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, units
from .registry import NUDGE, query, r

KEY = 'cast(datetime as date) as d, site'


def _keyed(t, **columns):
    return t.raw.select(F.col("datetime").cast("date").alias("d"), "site", *[c.alias(n) for n, c in columns.items()])


@query("c1_fahrenheit_to_celsius", f"""
    select {KEY}, round((tavg_f - 32) * (cast(5 as double) / 9), 6) as tavg_c,
      round((tmin_f - 32) * (cast(5 as double) / 9), 6) as tmin_c from raw""")
def c1(t):
    return _keyed(t, tavg_c=r(units.fahrenheit_to_celsius(F.col("AVG AIR TEMP"))), tmin_c=r(units.fahrenheit_to_celsius(F.col("MIN AIR TEMP"))))


@query("c2_inches_to_metric", f"""
    select {KEY}, round(snowdepth_in * cast(0.0254 as double), 8) as depth_m, round(snowdepth_in * cast(2.54 as double), 8) as depth_cm,
      round(snowdepth_in * cast(25.4 as double), 8) as depth_mm from raw""")
def c2(t):
    depth = F.col("SNOWDEPTH")
    return _keyed(
        t,
        depth_m=r(units.inches_to_metric(depth, "meters"), 8),
        depth_cm=r(units.inches_to_metric(depth, "cm"), 8),
        depth_mm=r(units.inches_to_metric(depth, "mm"), 8),
    )


@query("c3_feet_to_metres", "select s_suppkey, round(abs(s_acctbal) * cast(0.3048 as double), 8) as elevation_m from supplier")
def c3(t):
    return t.table("supplier").select("s_suppkey", r(units.feet_to_metres(F.abs("s_acctbal")), 8, "elevation_m"))


@query("c4_day_of_water_year", f"""
    select {KEY}, cast(DOWY as int) as dowy, cast(Pistochi_DOWY as int) as dowy_november,
      date_diff('day', make_date(year(datetime) - (case when month(datetime) < 4 then 1 else 0 end), 4, 1), cast(datetime as date))::int + 1 as dowy_april
    from derived""")
def c4(t):
    ts = F.col("datetime")
    return _keyed(t, dowy=dates.day_of_water_year(ts), dowy_november=dates.day_of_water_year(ts, 11), dowy_april=dates.day_of_water_year(ts, 4))


@query("c5_sturm_day", f"select {KEY}, cast(Sturm_DOWY as int) as sturm_day from derived")
def c5(t):
    return _keyed(t, sturm_day=dates.sturm_day(F.col("datetime")))


@query("c6_day_dispatch", """
    select event_id, cast(DOWY as int) as day_default, cast(Sturm_DOWY as int) as day_sturm from
      (select event_id, date_diff('day', make_date(year(d) - (case when month(d) < 10 then 1 else 0 end), 10, 1), d) + 1 as DOWY,
        case when month(d) between 7 and 9 then null
          else date_diff('day', make_date(year(d) + (case when month(d) >= 10 then 1 else 0 end), 1, 1), d)
            + (case when month(d) >= 10 then 0 else 1 end) end as Sturm_DOWY
       from (select event_id, cast(ts as date) as d from events))""")
def c6(t):
    ts = F.col("ts").cast("timestamp")
    return t.table("events").select(
        "event_id", dates.day_number(ts).alias("day_default"), dates.day_number(ts, algorithm="Sturm").alias("day_sturm")
    )


# Mixed spellings of a day: whole numbers in and out of range, fractions, dates, junk.
_SPELLING_SPARK = """case cast(o_orderkey % 7 as int)
    when 0 then cast(o_orderkey % 400 as string)
    when 1 then cast(cast(o_orderdate as date) as string)
    when 2 then concat(cast(o_orderkey % 366 as string), '.5')
    when 3 then concat(' ', cast(o_orderkey % 180 + 1 as string), '.0 ')
    when 4 then cast(0 - o_orderkey % 120 as string)
    when 5 then 'unknown' end"""
_SPELLING_SQL = _SPELLING_SPARK.replace("as string", "as varchar")
_NUMBER = "try_cast(trim(x) as double)"


def _validated_sql(low: int, high: int, converted: str) -> str:
    return f"""
    select o_orderkey, case when n is not null then case when n = floor(n) and n between {low} and {high} then cast(n as int) end
        else cast({converted} as int) end as valid_day,
      case when x is null then 'missing' when n is not null and n <> floor(n) then 'not a whole number'
        when n is not null and n not between {low} and {high} then 'out of bounds'
        when n is null and d is null then 'not a date' end as reject_reason
    from (select o_orderkey, x, {_NUMBER} as n, case when x like '____-__-__' then try_cast(x as date) end as d
          from (select o_orderkey, {_SPELLING_SQL} as x from orders))"""


@query("c7_validate_day", _validated_sql(1, 366, "date_diff('day', make_date(year(d) - (case when month(d) < 11 then 1 else 0 end), 11, 1), d) + 1"))
def c7(t):
    x = F.expr(_SPELLING_SPARK)
    return t.table("orders").select(
        "o_orderkey", dates.validate_day(x, 11).alias("valid_day"), dates.validate_day_reason(x).alias("reject_reason")
    )


@query("c8_validate_sturm_day", _validated_sql(-92, 182, """case when month(d) between 7 and 9 then null
      else date_diff('day', make_date(year(d) + (case when month(d) >= 10 then 1 else 0 end), 1, 1), d) + (case when month(d) >= 10 then 0 else 1 end) end"""))
def c8(t):
    x = F.expr(_SPELLING_SPARK)
    return t.table("orders").select(
        "o_orderkey", dates.validate_sturm_day(x).alias("valid_day"), dates.validate_sturm_day_reason(x).alias("reject_reason")
    )


@query("c9_validate_snow_class", """
    select p_partkey, case when lower(x) in ('alpine', 'maritime', 'prairie', 'tundra', 'taiga') then lower(x) end as snow_class
    from (select p_partkey, case p_size % 7 when 0 then 'Alpine' when 1 then 'MARITIME' when 2 then 'prairie' when 3 then 'tunDRA'
      when 4 then 'Taiga' when 5 then 'Ocean' end as x from part)""")
def c9(t):
    x = F.expr("""case p_size % 7 when 0 then 'Alpine' when 1 then 'MARITIME' when 2 then 'prairie' when 3 then 'tunDRA'
      when 4 then 'Taiga' when 5 then 'Ocean' end""")
    return t.table("part").select("p_partkey", text.snow_class_name(x).alias("snow_class"))


_MONTH_TEXT = """case p_size % 6 when 0 then cast(p_partkey % 14 as {s}) when 1 then concat('0', cast(p_partkey % 9 + 1 as {s}))
      when 2 then concat(' ', upper(substr({m}, 1, 3))) when 3 then {m} when 4 then 'janu' else null end"""
_MONTH_SQL = "['january','february','march','april','may','june','july','august','september','october','november','december']"


@query("c10_month_number", f"""
    select p_partkey, cast(case when regexp_matches(x, '^[0-9]+$') then case when cast(x as int) between 1 and 12 then cast(x as int) end
        else coalesce(nullif(list_position(names, x), 0), nullif(list_position(list_transform(names, lambda v: v[1:3]), x), 0)) end as int) as month_number
    from (select p_partkey, names, lower(trim({_MONTH_TEXT.format(s='varchar', m='names[p_partkey % 12 + 1]')})) as x
          from (select *, {_MONTH_SQL} as names from part))""")
def c10(t):
    spelled = "date_format(make_date(2001, cast(p_partkey % 12 + 1 as int), 1), 'MMMM')"
    x = F.expr(_MONTH_TEXT.format(s="string", m=spelled))
    return t.table("part").select("p_partkey", text.month_number(x).alias("month_number"))


@query("c11_station_name", """select s_suppkey, trim(regexp_extract(concat(s_name, ' (', cast(s_suppkey as varchar), ')'), '([^(]*)', 1)) as station_name from supplier""")
def c11(t):
    return t.table("supplier").select(
        "s_suppkey", text.station_name(F.concat("s_name", F.lit(" ("), F.col("s_suppkey").cast("string"), F.lit(")"))).alias("station_name")
    )


@query("c12_station_id", """
    select s_suppkey, nullif(regexp_extract(case when s_suppkey % 5 = 4 then s_name else concat(s_name, ' (', cast(s_suppkey as varchar), ')') end,
      '\\((\\d+)\\)', 1), '') as station_id from supplier""")
def c12(t):
    raw = F.expr("case when s_suppkey % 5 = 4 then s_name else concat(s_name, ' (', cast(s_suppkey as string), ')') end")
    return t.table("supplier").select("s_suppkey", text.station_id(raw).alias("station_id"))


@query("c13_triplet", """
    select s_suppkey, concat(cast(s_suppkey as varchar), ':', n_name, ':SNTL') as triplet, n_name as state, cast(s_suppkey as varchar) as station_id
    from supplier join nation on s_nationkey = n_nationkey""")
def c13(t):
    triplet = text.compose_triplet(F.col("s_suppkey").cast("string"), F.col("n_name"), F.lit("SNTL"))
    return t.suppliers.select(
        "s_suppkey", triplet.alias("triplet"), text.triplet_state(triplet).alias("state"), text.triplet_part(triplet, 1).alias("station_id")
    )


@query("c14_capitalise", "select p_partkey, concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) as label from part")
def c14(t):
    return t.table("part").select("p_partkey", text.capitalise(F.col("p_type")).alias("label"))


@query("c15_calendar_parts", """
    select o_orderkey, cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month, monthname(o_orderdate) as month_name from orders""")
def c15(t):
    d = F.col("o_orderdate").cast("timestamp")
    return t.table("orders").select(
        "o_orderkey", F.year(d).alias("year"), F.month(d).alias("month"), dates.month_label(d).alias("month_name")
    )


@query("c16_parse_date", """
    select o_orderkey, case when o_orderkey % 4 < 3 then cast(o_orderdate as date) end as parsed, (o_orderkey % 4 = 3) as rejected from orders""")
def c16(t):
    spelled = F.expr("""case cast(o_orderkey % 4 as int) when 0 then date_format(o_orderdate, 'yyyy-MM-dd')
        when 1 then date_format(o_orderdate, 'MM/dd/yyyy') when 2 then date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') else 'not known' end""")
    parsed = dates.parse_date(spelled)
    return t.table("orders").select("o_orderkey", parsed.cast("date").alias("parsed"), parsed.isNull().alias("rejected"))


@query("c17_legacy_class_names", "select ix, iy, snow_class from cells")
def c17(t):
    named = t.grid.join(t.grid_codes, "code")
    return named.select("ix", "iy", text.current_class_name(F.col("meaning")).alias("snow_class"))


@query("c18_season_alignment", f"""
    select {KEY}, case when datetime between timestamp '1998-12-01' and timestamp '1999-05-30' then '1998-1999' else '1999-2000' end as winter,
      case when cast(datetime as date) between date '1998-12-01' and date '1999-05-30' then cast(cast(datetime as date) + interval 12 month as date)
        else cast(datetime as date) end as aligned
    from raw where datetime between timestamp '1998-12-01' and timestamp '2000-05-15'""")
def c18(t):
    ts = F.col("datetime")
    seasons = t.raw.where(ts.between(F.lit("1998-12-01").cast("timestamp"), F.lit("2000-05-15").cast("timestamp")))
    return seasons.select(
        ts.cast("date").alias("d"),
        "site",
        dates.season_tag(ts, "1998-12-01", "1999-05-30", "1998-1999", "1999-2000").alias("winter"),
        dates.align_season(ts, "1998-12-01", "1999-05-30").alias("aligned"),
    )


@query("c19_density_from_swe", f"""
    select {KEY}, round(SWE / nullif(Snow_Depth, 0), 6) as density, round(SWE / nullif(Snow_Depth, 0) * 1000 + {NUDGE}, 4) as density_kg_m3 from derived""")
def c19(t):
    swe, depth = F.col("SWE"), F.col("Snow_Depth")
    return t.derived.select(
        F.col("datetime").cast("date").alias("d"), "site", r(units.snow_density(swe, depth), 6, "density"), r(units.snow_density(swe, depth, 1000) + NUDGE, 4, "density_kg_m3")
    )


@query("c20_round_half_even", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::date as d, l_quantity, case when abs(v - floor(v) - 0.5) < 1e-9
      then 2 * round(v / 2) else round(v) end as half_rounded
    from (select *, l_quantity / 2 as v from lineitem)""")
def c20(t):
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("d"), "l_quantity",
        units.round_half_even(F.col("l_quantity") / 2, 0).alias("half_rounded"),
    )
