"""Station-days, stations, grids and surveys read from the supplied star-schema
tables, in Spark and as the same view definitions in SQL.

A supplier is a station, a ship date an observation day, a region a snow class; a
customer is a survey site, an order a survey; a part is a grid cell. Expressions
are spelled the same on both sides.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import GridHeader, header_of
from ..schemas import RAW_OBSERVATIONS
from ..session import landed, modified, prepare
from ..sources.writers import write_parquet
from . import cleaning

LAGS = [7, 14]

STATION_CLASS = (
    "case n_regionkey when 0 then 'Alpine' when 1 then 'Maritime' when 2 then 'Prairie' when 3 then 'Tundra' else 'Taiga' end"
)
# Coordinates spread keys over a box of 60 by 30 degrees.
LON = "-125.0 + ({k} * 91 % 6000) / 100.0D"
LAT = "30.0 + ({k} * 37 % 3000) / 100.0D"

GRID_X0, GRID_Y0, GRID_DX, GRID_DY, GRID_NX = -125.0, 30.0, 1.0, 0.5, 60
GRID_CODES = (
    (0, "ocean"), (1, "tundra"), (2, "boreal_forest"), (3, "maritime"),
    (4, "ephemeral"), (5, "prairie"), (6, "montane_forest"), (7, "ice"),
)


class Tables:
    """Lazy access to the supplied tables and the stand-in tables over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))

    @cached_property
    def raw(self) -> DataFrame:
        """Station-days in raw units; (site, datetime) is unique by the grouping.
        Rounding removes the order of summation from the input."""
        days = (
            self.table("lineitem")
            .groupBy("l_suppkey", F.expr("cast(l_shipdate as date)").alias("d"))
            .agg(
                F.expr("round(avg(l_quantity * (0.02D + l_tax * 8.0D)), 6)").alias("SWE"),
                F.expr("round(avg(l_quantity), 6)").alias("SNOWDEPTH"),
                F.expr("round(sum(case when l_linenumber = 7 then null else l_discount * 10.0D end), 6)").alias("PRECIPITATION"),
                F.expr("round(avg(10.0D + l_extendedprice % 60.0D), 6)").alias("AVG AIR TEMP"),
                F.expr("round(min(10.0D + l_extendedprice % 60.0D - l_discount * 200.0D), 6)").alias("MIN AIR TEMP"),
                F.expr("round(max(10.0D + l_extendedprice % 60.0D + l_tax * 200.0D), 6)").alias("MAX AIR TEMP"),
            )
        )
        return days.join(self.suppliers, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
            "cast(d as timestamp) as datetime",
            "concat(cast(s_suppkey as string), ':', substr(n_name, 1, 2), ':SNTL') as site",
            "concat(s_name, ' (', cast(s_suppkey as string), ')') as `Station Name`",
            "SWE", "SNOWDEPTH", "PRECIPITATION", "`AVG AIR TEMP`", "`MIN AIR TEMP`", "`MAX AIR TEMP`",
            "abs(s_acctbal) as Elevation",
            f"{STATION_CLASS} as Snow_Class",
        )

    @cached_property
    def derived(self) -> DataFrame:
        return cleaning.derive(self.raw)

    @cached_property
    def staged_path(self) -> str:
        """Raw station-days landed once a session as a table in the shared folder, again
        when a table they come from has changed. Quality control and history pass over
        them several times; from here a pass is a column-pruned scan, not the join and
        aggregation above."""
        tables = ("lineitem", "supplier", "nation")
        changes = [modified(self.spark, f"{self.folder}/{name}.parquet") for name in tables]
        return landed(self.spark, "raw", (self.folder, *changes), lambda path: write_parquet(self.raw, path, compression="zstd"))

    @cached_property
    def staged(self) -> DataFrame:
        return self.spark.read.schema(RAW_OBSERVATIONS).parquet(self.staged_path)

    @cached_property
    def controlled(self) -> DataFrame:
        return cleaning.control(cleaning.derive(self.staged))

    def history(self, windows: list[int] | None = None) -> DataFrame:
        return cleaning.add_history(self.controlled, LAGS if windows is None else windows)

    def clean(self, windows: list[int] | None = None) -> DataFrame:
        return self.history(windows).transform(cleaning.keep_snow).transform(cleaning.shape)

    @cached_property
    def snow(self) -> DataFrame:
        """Clean rows without climate history, for what needs none."""
        return self._snow(self.derived)

    @cached_property
    def staged_snow(self) -> DataFrame:
        """The same over the landed station-days, for work that passes over them often."""
        return self._snow(cleaning.derive(self.staged))

    def _snow(self, derived: DataFrame) -> DataFrame:
        kept = cleaning.keep_snow(derived.withColumn("PPTWT", F.lit(None).cast("double")))
        return kept.withColumnsRenamed({"datetime": "Date", "site": "Site"}).select(
            "Date", "Site", "Station_Name", "Snow_Class", "Elevation", "SWE", "Snow_Depth", "Snow_Density",
            "Sturm_DOWY", "Pistochi_DOWY", "DOWY",
        )

    @cached_property
    def scraped(self) -> DataFrame:
        """Station list as scraped, with a network code to filter on."""
        return self.suppliers.selectExpr(
            "concat(s_name, ' (', cast(s_suppkey as string), ')') as site_name",
            "substr(n_name, 1, 2) as state",
            "case when s_suppkey % 10 = 9 then 'SCAN' else 'SNTL' end as ntwk",
            f"cast({LAT.format(k='s_suppkey')} as double) as lat",
            f"cast({LON.format(k='s_suppkey')} as double) as lon",
            "abs(s_acctbal) as elev",
            f"case when s_suppkey % 17 = 0 then 'ocean' else lower({STATION_CLASS}) end as snow_class",
        )

    @cached_property
    def stations(self) -> DataFrame:
        from ..sources.readers import shape_station_metadata

        return shape_station_metadata(self.scraped)

    def located(self, clean: DataFrame) -> DataFrame:
        return cleaning.attach_coordinates(clean, self.stations)

    @cached_property
    def grid(self) -> DataFrame:
        return self.table("part").selectExpr(
            f"cast(p_partkey % {GRID_NX} as int) as ix",
            f"cast(floor(p_partkey / {GRID_NX}) as int) as iy",
            "cast(p_size % 8 as int) as code",
            "p_retailprice as elevation_m",
        )

    @cached_property
    def grid_codes(self) -> DataFrame:
        return self.spark.createDataFrame(list(GRID_CODES), "code int, meaning string")

    @cached_property
    def grid_header(self) -> GridHeader:
        return header_of(self.grid, GRID_X0, GRID_Y0, GRID_DX, GRID_DY)

    @cached_property
    def surveys(self) -> DataFrame:
        """Order-based surveys in inches."""
        return self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
            "o_orderkey as survey_id",
            "cast(cast(o_orderdate as date) as string) as SURVEY_DATE_TEXT",
            "0.02D + (o_orderkey % 89) * 0.008D as DENSITY",
            "(1.0D + o_totalprice % 60.0D) * (0.02D + (o_orderkey % 89) * 0.008D) as WATER",
            "1.0D + o_totalprice % 60.0D as DEPTH",
            f"cast({LAT.format(k='c_custkey')} as double) as LATITUDE",
            f"cast({LON.format(k='c_custkey')} as double) as LONGITUDE",
            "c_name as SITE_NAME",
            "case o_orderpriority when '1-URGENT' then 'QUESTIONABLE' when '5-LOW' then 'UNKNOWN' else 'GOOD' end as CONFIDENCE_LEVEL",
        )

    @cached_property
    def surveys_bc(self) -> DataFrame:
        """Order-based surveys in metric units."""
        return self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
            "o_orderkey as survey_id",
            "cast(cast(o_orderdate as date) as string) as Date",
            "10.0D + o_totalprice % 180.0D as SD",
            "(10.0D + o_totalprice % 180.0D) * (0.05D + (o_orderkey % 97) * 0.005D) as SWE_cm",
            "0.05D + (o_orderkey % 97) * 0.005D as rho_g_cm3",
            f"cast({LAT.format(k='c_custkey')} as double) as LATITUDE",
            f"cast({LON.format(k='c_custkey')} as double) as LONGITUDE",
            "c_name as LOCATION_NAME",
            "case when o_orderkey % 50 = 0 then null else abs(c_acctbal) / 4.0D end as ELEVATION",
        )

    def with_grids(self, survey: DataFrame, elevation: bool) -> DataFrame:
        """Class (and elevation) of the nearest cell for survey points."""
        from ..functions.text import capitalise
        from ..operators.grid import attach_nearest, attach_snow_class

        found = attach_snow_class(survey, self.grid, self.grid_codes, self.grid_header, "LONGITUDE", "LATITUDE")
        found = found.withColumn("Snow_Class", capitalise(F.col("snow_class"))).drop("in_bounds")
        if elevation:
            found = attach_nearest(
                found, self.grid.withColumnRenamed("elevation_m", "Elevation"), self.grid_header, ["Elevation"], "LONGITUDE", "LATITUDE"
            ).drop("in_bounds")
        return found

    @cached_property
    def maine(self) -> DataFrame:
        return cleaning.clean_survey_maine(self.with_grids(self.surveys, elevation=True))

    @cached_property
    def bc(self) -> DataFrame:
        return cleaning.clean_survey_bc(self.with_grids(self.surveys_bc, elevation=False))


# ---------------------------------------------------------------------------
# The same tables as SQL view definitions, for the oracle.
# ---------------------------------------------------------------------------


CTES = {
    "raw": f"""
        select cast(l.d as timestamp) as datetime,
          concat(cast(s_suppkey as varchar), ':', substr(n_name, 1, 2), ':SNTL') as site,
          concat(s_name, ' (', cast(s_suppkey as varchar), ')') as "Station Name",
          l.swe_in, l.snowdepth_in, l.precip_in, l.tavg_f, l.tmin_f, l.tmax_f,
          abs(s_acctbal) as elevation_ft, {STATION_CLASS} as Snow_Class
        from (select l_suppkey, cast(l_shipdate as date) as d,
                round(avg(l_quantity * (cast(0.02 as double) + l_tax * 8)), 6) as swe_in,
                round(avg(l_quantity), 6) as snowdepth_in,
                round(sum(case when l_linenumber = 7 then null else l_discount * 10 end), 6) as precip_in,
                round(avg(10 + l_extendedprice % 60), 6) as tavg_f,
                round(min(10 + l_extendedprice % 60 - l_discount * 200), 6) as tmin_f,
                round(max(10 + l_extendedprice % 60 + l_tax * 200), 6) as tmax_f
              from lineitem group by 1, 2) l
        join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    "derived": """
        select datetime, site, "Station Name", Snow_Class,
          trim(regexp_extract("Station Name", '([^(]*)', 1)) as Station_Name,
          swe_in * cast(2.54 as double) as SWE, snowdepth_in * cast(2.54 as double) as Snow_Depth,
          elevation_ft * cast(0.3048 as double) as Elevation,
          (tavg_f - 32) * (cast(5 as double) / 9) as TAVG, (tmax_f - 32) * (cast(5 as double) / 9) as TMAX,
          (tmin_f - 32) * (cast(5 as double) / 9) as TMIN, precip_in * cast(2.54 as double) as PRECIPITATION,
          case when month(datetime) between 7 and 9 then null
               else (case when date_diff('day', make_date(year(datetime) + (case when month(datetime) >= 10 then 1 else 0 end), 1, 1), cast(datetime as date)) >= 0 then 1 else 0 end)
                    + date_diff('day', make_date(year(datetime) + (case when month(datetime) >= 10 then 1 else 0 end), 1, 1), cast(datetime as date)) end as Sturm_DOWY,
          date_diff('day', make_date(year(datetime) - (case when month(datetime) < 11 then 1 else 0 end), 11, 1), cast(datetime as date)) + 1 as Pistochi_DOWY,
          date_diff('day', make_date(year(datetime) - (case when month(datetime) < 10 then 1 else 0 end), 10, 1), cast(datetime as date)) + 1 as DOWY,
          month(datetime) as month, year(datetime) as year,
          year(datetime) - (case when month(datetime) <= 2 then 1 else 0 end) as winter_end,
          concat(cast(year(datetime) - (case when month(datetime) <= 2 then 1 else 0 end) - 1 as varchar), '-',
                 cast(year(datetime) - (case when month(datetime) <= 2 then 1 else 0 end) as varchar)) as winter
        from raw""",
    "thresholds": """
        select "Station Name", quantile_cont(PRECIPITATION, 0.999) as threshold from derived group by 1""",
    "controlled": """
        select * exclude (TMIN, TAVG, TMAX, PRECIPITATION, ok),
          case when ok and TMIN between -40 and 40 then TMIN end as TMIN,
          case when ok and TAVG between -40 and 40 then TAVG end as TAVG,
          case when ok and TMAX between -40 and 40 then TMAX end as TMAX,
          case when PRECIPITATION < 0 or PRECIPITATION > threshold then null else PRECIPITATION end as PRECIPITATION
        from (select derived.*, threshold, coalesce(TMIN < TAVG and TAVG < TMAX, false) as ok
              from derived join thresholds using ("Station Name"))""",
    "monthly": """
        select "Station Name", year, month, avg(TAVG) as mean_temp from controlled group by 1, 2, 3""",
    "spread": """
        select "Station Name", year, max(mean_temp) - min(mean_temp) as Temp_Diff from monthly group by 1, 2""",
    "winters": """
        select k.Station_Name, k.winter,
          case when count(distinct month(r.datetime)) = 3 then sum(r.PRECIPITATION) end as PPTWT
        from (select distinct Station_Name, winter, winter_end from controlled) k
        left join controlled r on r.Station_Name = k.Station_Name
          and r.datetime >= make_date(k.winter_end - 1, 12, 1) and r.datetime < make_date(k.winter_end, 3, 1)
        group by 1, 2""",
    "shifted": """
        select *, lag(TAVG) over st as prev_TAVG, lag(PRECIPITATION) over st as prev_PRECIPITATION,
          min(datetime) over (partition by "Station Name") as first_seen
        from controlled window st as (partition by "Station Name" order by datetime)""",
    "snow": """
        select cast(datetime as date) as Date, site as Site, Station_Name, Snow_Class, Elevation, SWE, Snow_Depth,
          SWE / Snow_Depth as Snow_Density, Sturm_DOWY, Pistochi_DOWY, DOWY
        from derived where Snow_Depth <> 0 and SWE <> 0 and Snow_Depth > 5 and SWE > 3
          and SWE / Snow_Depth <= 0.6 and SWE / Snow_Depth >= 0.05""",
    "scraped": f"""
        select concat(s_name, ' (', cast(s_suppkey as varchar), ')') as site_name, substr(n_name, 1, 2) as state,
          case when s_suppkey % 10 = 9 then 'SCAN' else 'SNTL' end as ntwk,
          cast(30.0 as double) + cast(s_suppkey * 37 % 3000 as double) / 100 as lat,
          cast(-125.0 as double) + cast(s_suppkey * 91 % 6000 as double) / 100 as lon,
          abs(s_acctbal) as elev,
          case when s_suppkey % 17 = 0 then 'ocean' else lower({STATION_CLASS}) end as snow_class
        from supplier join nation on s_nationkey = n_nationkey""",
    "stations": """
        select site_name, lat as latitude, lon as longitude, elev as elevation,
          concat(regexp_extract(site_name, '\\((\\d+)\\)', 1), ':', state, ':', ntwk) as triplets,
          case when snow_class = 'ocean' then 'Maritime'
               else concat(upper(substr(snow_class, 1, 1)), lower(substr(snow_class, 2))) end as snowclass
        from scraped where ntwk = 'SNTL'""",
    "grid": """
        select cast(p_partkey % 60 as int) as ix, cast(floor(p_partkey / 60) as int) as iy,
          cast(p_size % 8 as int) as code, p_retailprice as elevation_m from part""",
    "grid_codes": "select * from (values "
    + ", ".join(f"({c}, '{m}')" for c, m in GRID_CODES)
    + ") v(code, meaning)",
    "cells": """
        select ix, iy, elevation_m,
          case meaning when 'montane_forest' then 'alpine' when 'boreal_forest' then 'taiga' else meaning end as snow_class
        from grid join grid_codes using (code)""",
    "extent": "select max(ix) as mx, max(iy) as my from grid",
    "surveys": """
        select o_orderkey as survey_id, cast(cast(o_orderdate as date) as varchar) as SURVEY_DATE_TEXT,
          cast(0.02 as double) + (o_orderkey % 89) * cast(0.008 as double) as DENSITY,
          (1 + o_totalprice % 60) * (cast(0.02 as double) + (o_orderkey % 89) * cast(0.008 as double)) as WATER,
          1 + o_totalprice % 60 as DEPTH,
          cast(30.0 as double) + cast(c_custkey * 37 % 3000 as double) / 100 as LATITUDE,
          cast(-125.0 as double) + cast(c_custkey * 91 % 6000 as double) / 100 as LONGITUDE,
          c_name as SITE_NAME,
          case o_orderpriority when '1-URGENT' then 'QUESTIONABLE' when '5-LOW' then 'UNKNOWN' else 'GOOD' end as CONFIDENCE_LEVEL
        from orders join customer on o_custkey = c_custkey""",
    "surveys_bc": """
        select o_orderkey as survey_id, cast(cast(o_orderdate as date) as varchar) as Date,
          10 + o_totalprice % 180 as SD,
          (10 + o_totalprice % 180) * (cast(0.05 as double) + (o_orderkey % 97) * cast(0.005 as double)) as SWE_cm,
          cast(0.05 as double) + (o_orderkey % 97) * cast(0.005 as double) as rho_g_cm3,
          cast(30.0 as double) + cast(c_custkey * 37 % 3000 as double) / 100 as LATITUDE,
          cast(-125.0 as double) + cast(c_custkey * 91 % 6000 as double) / 100 as LONGITUDE,
          c_name as LOCATION_NAME,
          case when o_orderkey % 50 = 0 then null else abs(c_acctbal) / 4 end as ELEVATION
        from orders join customer on o_custkey = c_custkey""",
}


def _cell_sql(table: str) -> str:
    """Points of ``table`` with the index of their nearest cell."""
    x, y = f"(LONGITUDE - ({GRID_X0})) / {GRID_DX}", f"(LATITUDE - {GRID_Y0}) / {GRID_DY}"
    return f"""
        select *, case when in_bounds then least(cast(floor(px + 0.5) as int), mx) end as ix,
          case when in_bounds then least(cast(floor(py + 0.5) as int), my) end as iy
        from (select t.*, mx, my, {x} as px, {y} as py,
                coalesce({x} between 0 and mx and {y} between 0 and my, false) as in_bounds
              from {table} t cross join extent)"""


def _days_sql(day: str) -> str:
    ref = f"make_date(year({day}) + (case when month({day}) >= 10 then 1 else 0 end), 1, 1)"
    return f"""
          case when month({day}) between 7 and 9 then null
               else date_diff('day', {ref}, {day}) + (case when {day} >= {ref} then 1 else 0 end) end as Sturm_DOWY,
          date_diff('day', make_date(year({day}) - (case when month({day}) < 11 then 1 else 0 end), 11, 1), {day}) + 1 as Pistochi_DOWY,
          date_diff('day', make_date(year({day}) - (case when month({day}) < 10 then 1 else 0 end), 10, 1), {day}) + 1 as DOWY"""


CTES["survey_cells"] = _cell_sql("surveys")
CTES["survey_bc_cells"] = _cell_sql("surveys_bc")
CTES["maine"] = f"""
        select survey_id, d as Date, SITE_NAME, LATITUDE as Latitude, LONGITUDE as Longitude, Snow_Class, Elevation,
          SWE, Snow_Depth, SWE / Snow_Depth as Snow_Density, {_days_sql('d')}
        from (select s.*, cast(SURVEY_DATE_TEXT as date) as d,
                upper(substr(c.snow_class, 1, 1)) || lower(substr(c.snow_class, 2)) as Snow_Class,
                elevation_m as Elevation, WATER * cast(2.54 as double) as SWE, DEPTH * cast(2.54 as double) as Snow_Depth
              from survey_cells s left join cells c using (ix, iy)) x
        where CONFIDENCE_LEVEL = 'GOOD' and DENSITY > 0 and DENSITY < 1 and Snow_Class is not null and Snow_Class <> 'Ocean' and Elevation is not null
          and Snow_Depth > 5 and SWE > 3 and SWE / Snow_Depth between 0.05 and 0.6
          and month(d) not between 7 and 9"""
CTES["bc"] = f"""
        select survey_id, d as Date, LOCATION_NAME, LATITUDE as Latitude, LONGITUDE as Longitude, Snow_Class, ELEVATION as Elevation,
          SWE_cm as SWE, SD as Snow_Depth, rho_g_cm3 as Snow_Density, {_days_sql('d')}
        from (select s.*, cast(s.Date as date) as d,
                upper(substr(c.snow_class, 1, 1)) || lower(substr(c.snow_class, 2)) as Snow_Class
              from survey_bc_cells s left join cells c using (ix, iy)) x
        where Snow_Class is not null and ELEVATION is not null and month(d) not between 7 and 9"""


def lag_sql(column: str, window: int) -> str:
    """A trailing mean over ``shifted``, as an ordinary range window."""
    return f"""case when datetime >= first_seen + interval {window} day then
            avg(prev_{column}) over (partition by "Station Name" order by epoch_us(datetime)
              range between {window * 86_400_000_000 - 1} preceding and current row) end as {column}_lag_{window}d"""


def _history_sql(windows: list[int]) -> str:
    lags = ",\n          ".join(lag_sql(c, w) for c in cleaning.LAG_COLUMNS for w in windows)
    return f"""
        select * exclude (first_seen, prev_TAVG, prev_PRECIPITATION) from (select *, {lags} from shifted)
        left join spread using ("Station Name", year) join winters using (Station_Name, winter)"""


CTES["history"] = _history_sql(LAGS)
CTES["clean"] = """
        select cast(datetime as date) as Date, site as Site, Station_Name, Snow_Class, Elevation, SWE, Snow_Depth,
          SWE / Snow_Depth as Snow_Density, Sturm_DOWY, Pistochi_DOWY, DOWY, Temp_Diff, PPTWT * 10 as PPTWT,
          TAVG_lag_7d, TAVG_lag_14d, PRECIPITATION_lag_7d, PRECIPITATION_lag_14d
        from history where Snow_Depth <> 0 and SWE <> 0 and Snow_Depth > 5 and SWE > 3
          and SWE / Snow_Depth <= 0.6 and SWE / Snow_Depth >= 0.05"""
CTES["station_table"] = """
        select Snow_Class, Station_Name, Elevation from
          (select *, row_number() over (partition by Station_Name order by Date, Site) as n from snow) where n = 1"""


def oracle(query: str, **extra: str) -> str:
    """``query`` over the views above; ``extra`` adds views of its own. Only the
    views it reaches are included."""
    import re

    views = {**CTES, **extra}
    used: list[str] = []

    def visit(sql: str) -> None:
        for name in views:
            if name not in used and re.search(rf"\b(from|join)\s+{name}\b", sql):
                visit(views[name])
                if name not in used:
                    used.append(name)

    visit(query)
    if not used:
        return query
    body = ",\n".join(f"{name} as ({views[name]})" for name in used)
    return f"with {body}\n{query}"
