"""Sources and sinks (S), projections (P), filters (F), joins (J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import units
from ..operators import climate, encoders, grid, learn, quality, shape, splits, sweeps
from ..schemas import SURVEY_MAINE
from ..session import scratch_path
from ..sources import readers, writers
from . import cleaning
from .registry import day, query, r
from .splits_sql import SPLIT_VIEWS

DATED = "cast(datetime as date) as Date"


@query("s1_read_parquet", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def s1(t):
    schema = T.StructType.fromDDL("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    return readers.read_parquet(t.spark, f"{t.folder}/supplier.parquet", schema)


@query("s2_read_csv", "select survey_id, SURVEY_DATE_TEXT, round(DENSITY, 9) as DENSITY, round(WATER, 9) as WATER, round(DEPTH, 9) as DEPTH, round(LATITUDE, 9) as LATITUDE, round(LONGITUDE, 9) as LONGITUDE, SITE_NAME, CONFIDENCE_LEVEL from surveys")
def s2(t):
    """The surveys written as CSV (S7) and read back with their schema."""
    path = writers.write_csv(t.surveys, scratch_path(t.spark, "surveys"))
    back = readers.read_csv(t.spark, path, SURVEY_MAINE)
    return back.select("survey_id", "SURVEY_DATE_TEXT", *[r(c, 9) for c in ("DENSITY", "WATER", "DEPTH", "LATITUDE", "LONGITUDE")], "SITE_NAME", "CONFIDENCE_LEVEL")


@query("s3_multi_station_ingest", f"""
    select {DATED}, site, "Station Name", Snow_Class, elevation_ft as Elevation, swe_in as SWE, precip_in as PRECIPITATION
    from raw where datetime between timestamp '1996-01-01' and timestamp '1999-12-31'""")
def s3(t):
    records = t.raw.drop("Station Name", "Elevation", "Snow_Class")
    tags = t.suppliers.selectExpr(
        "concat(cast(s_suppkey as string), ':', substr(n_name, 1, 2), ':SNTL') as site",
        "concat(s_name, ' (', cast(s_suppkey as string), ')') as `Station Name`",
        "abs(s_acctbal) as Elevation",
        "case n_regionkey when 0 then 'Alpine' when 1 then 'Maritime' when 2 then 'Prairie' when 3 then 'Tundra' else 'Taiga' end as Snow_Class",
    )
    found = readers.ingest_daily_records(records, tags, "1996-01-01", "1999-12-31")
    return found.select(F.col("datetime").cast("date").alias("Date"), "site", "Station Name", "Snow_Class", "Elevation", "SWE", "PRECIPITATION")


@query("s4_variable_selection", f'select {DATED}, site, "Station Name", elevation_ft as Elevation, Snow_Class, swe_in as SWE, snowdepth_in as SNOWDEPTH from raw')
def s4(t):
    kept = readers.select_variables(t.raw, ("SWE", "SNOWDEPTH"))
    return kept.select(F.col("datetime").cast("date").alias("Date"), *[c for c in kept.columns if c != "datetime"])


@query("s5_station_metadata", "select site_name, latitude, longitude, elevation, triplets, snowclass from stations")
def s5(t):
    return t.stations


_BY_WATER_YEAR = "select cast(year(Date) + (case when month(Date) >= 10 then 1 else 0 end) as int) as water_year, count(*) as n, round(avg(SWE), 6) as swe from snow group by 1"


@query("s6_write_parquet", _BY_WATER_YEAR)
def s6(t):
    """Written by water year, gzip, and read back."""
    path = writers.write_by_water_year(t.snow, scratch_path(t.spark, "clean"))
    back = t.spark.read.parquet(path)
    return back.groupBy("water_year").agg(F.count(F.lit(1)).alias("n"), r(F.avg("SWE"), 6, "swe"))


@query("s7_write_csv", "select SITE_NAME, count(*) as n, round(sum(DEPTH), 4) as depth from surveys group by 1")
def s7(t):
    path = writers.write_csv(t.surveys, scratch_path(t.spark, "surveys-out"))
    back = t.spark.read.schema(SURVEY_MAINE).option("header", True).csv(path)
    return back.groupBy("SITE_NAME").agg(F.count(F.lit(1)).alias("n"), r(F.sum("DEPTH"), 4, "depth"))


@query("s8_store_splits", """
    select final_eval, role, count(*) as n, round(avg(Snow_Density), 6) as density, round(avg(SWE), 6) as swe from (
      select true as final_eval, case split when 'test' then 'evaluation' else 'training' end as role, Snow_Density, SWE from spatial
      union all
      select false, case split when 'val' then 'evaluation' else 'training' end, Snow_Density, SWE from spatial where split <> 'test') group by 1, 2""", **SPLIT_VIEWS)
def s8(t):
    """Stored by split; density and SWE targets are columns of the same rows."""
    rows = splits.create_splitter("spatial").split(cleaning.station_table(t.snow), t.snow)
    path = writers.store_split(rows, scratch_path(t.spark, "splits"), ["Station_Name", "Date"])
    parts = []
    for final_eval in (True, False):
        for role, part in zip(("training", "evaluation"), readers.load_split(t.spark, path, final_eval)):
            parts.append(part.select(F.lit(final_eval).alias("final_eval"), F.lit(role).alias("role"), "Snow_Density", "SWE"))
    stacked = readers.union_stations(parts)
    return stacked.groupBy("final_eval", "role").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("Snow_Density"), 6, "density"), r(F.avg("SWE"), 6, "swe")
    )


@query("p1_derive_columns", f"""
    select {DATED}, site, round(SWE, 6) as SWE, round(Snow_Depth, 6) as Snow_Depth, round(Elevation, 6) as Elevation, round(TAVG, 6) as TAVG,
      cast(DOWY as int) as DOWY, cast(Pistochi_DOWY as int) as Pistochi_DOWY, cast(month as int) as month, winter from derived""")
def p1(t):
    return t.derived.select(F.col("datetime").cast("date").alias("Date"), "site", r("SWE"), r("Snow_Depth"), r("Elevation"), r("TAVG"), "DOWY", "Pistochi_DOWY", "month", "winter")


@query("p2_keep_named", "select Snow_Class, Station_Name, Elevation from snow")
def p2(t):
    return shape.keep_named(t.snow, ["Snow_Class", "Station_Name", "Elevation", "Not_There"])


@query("p3_drop_columns", "select Date, Site, Station_Name, Snow_Class, round(Snow_Density, 9) as Snow_Density from snow")
def p3(t):
    kept = t.snow.drop("Elevation", "SWE", "Snow_Depth", "Sturm_DOWY", "Pistochi_DOWY", "DOWY")
    return kept.select(day(), *[c for c in kept.columns if c not in ("Date", "Snow_Density")], r("Snow_Density", 9))


@query("p4_rename", "select triplets as site, latitude as Latitude, longitude as Longitude from stations")
def p4(t):
    return t.stations.select("triplets", "latitude", "longitude").withColumnsRenamed({"triplets": "site", "latitude": "Latitude", "longitude": "Longitude"})


@query("p5_replace_values", "select site_name, case when snow_class = 'ocean' then 'maritime' when snow_class = 'taiga' then 'boreal' else snow_class end as snow_class from scraped")
def p5(t):
    return shape.replace_values(t.scraped, "snow_class", {"ocean": "maritime", "taiga": "boreal"}).select("site_name", "snow_class")


@query("p6_feature_set", """
    select Date, s.Elevation, Snow_Depth, cast(DOWY as int) as DOWY, latitude as Latitude, longitude as Longitude, Snow_Class
    from snow s left join stations on Site = triplets""")
def p6(t):
    chosen = learn.select_variant(t.located(t.snow), "main", ["Date"])
    return chosen.select(day(), *[c for c in chosen.columns if c != "Date"])


@query("p7_features_and_target", "select Date, Site, round(Snow_Density, 9) as label, Snow_Depth, cast(DOWY as int) as DOWY from snow")
def p7(t):
    rows = t.located(t.snow).select("Date", "Site", "Snow_Density", "Snow_Depth", "DOWY", "Latitude", "Longitude")
    shaped = splits.features_and_target(rows, "Snow_Density", geography=False)
    return shaped.select(day(), "Site", r("label", 9), "Snow_Depth", "DOWY")


@query("p8_constant_baseline", """
    select Date, Site, round(Snow_Density, 9) as Snow_Density, (select round(avg(Snow_Density), 6) from spatial where split <> 'test') as Baseline_Density
    from spatial where split = 'test'""", **SPLIT_VIEWS)
def p8(t):
    rows = splits.create_splitter("spatial").split(cleaning.station_table(t.snow), t.snow)
    based = sweeps.with_baseline(rows.where("split = 'test'"), rows.where("split <> 'test'"), "Snow_Density")
    return based.select(day(), "Site", r("Snow_Density", 9), r("Baseline_Density"))


@query("p9_swe_products", "select Date, Site, round(Snow_Density * Snow_Depth, 6) as A_SWE, round(Snow_Density * 2 * Snow_Depth, 6) as B_SWE from snow")
def p9(t):
    from ..operators.swe import with_swe_products

    rows = t.snow.withColumns({"A_Density": F.col("Snow_Density"), "B_Density": F.col("Snow_Density") * 2})
    return with_swe_products(rows, ["A", "B"]).select(day(), "Site", r("A_SWE"), r("B_SWE"))


@query("p10_row_keys", "select Station_Name, Date, Snow_Depth, count(*) over (partition by Station_Name, Date) as copies from snow")
def p10(t):
    """The key travels as columns; it is unique."""
    rows = shape.keyed(t.snow.select(day(), "Station_Name", "Snow_Depth"), ["Station_Name", "Date"])
    return rows.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("Station_Name", "Date")))


@query("f1_minimum_snow", f"select {DATED}, site, round(SWE, 6) as SWE, round(Snow_Depth, 6) as Snow_Depth from derived where Snow_Depth <> 0 and SWE <> 0 and Snow_Depth > 5 and SWE > 3")
def f1(t):
    return t.derived.where(quality.minimum_snow()).select(F.col("datetime").cast("date").alias("Date"), "site", r("SWE"), r("Snow_Depth"))


@query("f2_density_band", f"select {DATED}, site, round(SWE / Snow_Depth, 9) as Snow_Density from derived where SWE / nullif(Snow_Depth, 0) between 0.05 and 0.6")
def f2(t):
    rows = t.derived.withColumn("Snow_Density", units.snow_density(F.col("SWE"), F.col("Snow_Depth"))).where(quality.physical_density())
    return rows.select(F.col("datetime").cast("date").alias("Date"), "site", r("Snow_Density", 9))


@query("f3_survey_quality", "select survey_id, CONFIDENCE_LEVEL, round(DENSITY, 9) as DENSITY from surveys where CONFIDENCE_LEVEL in ('GOOD', 'UNKNOWN') and DENSITY > 0 and DENSITY < 1")
def f3(t):
    return t.surveys.where(quality.survey_quality(["GOOD", "UNKNOWN"])).select("survey_id", "CONFIDENCE_LEVEL", r("DENSITY", 9))


@query("f4_exclude_class", "select ix, iy, snow_class from grid left join cells using (ix, iy) where snow_class is null or snow_class <> 'ocean'")
def f4(t):
    from ..functions.text import current_class_name

    named = t.grid.join(t.grid_codes, "code", "left").withColumn("snow_class", current_class_name(F.col("meaning")))
    return named.where(quality.not_class("snow_class", "ocean")).select("ix", "iy", "snow_class")


@query("f5_date_gap", f"select {DATED}, site from raw where not (datetime between timestamp '1998-05-16' and timestamp '1998-11-30')")
def f5(t):
    return t.raw.where(quality.outside_gap(F.col("datetime"), "1998-05-16", "1998-11-30")).select(F.col("datetime").cast("date").alias("Date"), "site")


@query("f6_complete_cases", "select survey_id, Date, SITE_NAME, Snow_Class, Elevation, round(SWE, 6) as SWE, round(Snow_Depth, 6) as Snow_Depth, round(Snow_Density, 9) as Snow_Density, cast(Sturm_DOWY as int) as Sturm_DOWY, cast(Pistochi_DOWY as int) as Pistochi_DOWY, cast(DOWY as int) as DOWY from maine")
def f6(t):
    """The whole survey cleaning: F3, C16, J7, J8, C2, C19, F4, F1, F2, F6."""
    return t.maine.select("survey_id", day(), "SITE_NAME", "Snow_Class", "Elevation", r("SWE"), r("Snow_Depth"), r("Snow_Density", 9), "Sturm_DOWY", "Pistochi_DOWY", "DOWY")


@query("f7_complete_named", f"select {DATED}, site, round(PRECIPITATION, 6) as PRECIPITATION from derived where PRECIPITATION is not null and TAVG is not null")
def f7(t):
    return quality.complete_cases(t.derived, ["PRECIPITATION", "TAVG"]).select(F.col("datetime").cast("date").alias("Date"), "site", r("PRECIPITATION"))


@query("f8_month_filter", "select Date, Site from snow where month(Date) = 8")
def f8(t):
    return t.snow.where(quality.in_month(F.col("Date"), 8)).select(day(), "Site")


@query("f9_year_cutoff", "select case when year(Date) <= 1998 then 'early' else 'late' end as period, count(*) as n from snow group by 1")
def f9(t):
    early = quality.up_to_year(F.col("Date"), 1998)
    return t.snow.groupBy(F.when(early, "early").otherwise("late").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("f10_station_membership", "select Date, Site from snow where Station_Name in (select Station_Name from station_split where split = 'test')", **SPLIT_VIEWS)
def f10(t):
    held = splits.create_splitter("spatial").assign(cleaning.station_table(t.snow)).where("split = 'test'")
    return quality.keep_stations(t.snow, held).select(day(), "Site")


@query("j1_attach_threshold", f'select {DATED}, site, round(threshold, 6) as threshold from derived join thresholds using ("Station Name")')
def j1(t):
    joined = quality.attach_precipitation_threshold(t.derived, "Station Name")
    return joined.select(F.col("datetime").cast("date").alias("Date"), "site", r("threshold"))


@query("j2_attach_temperature_difference", f'select {DATED}, site, round(Temp_Diff, 6) as Temp_Diff from controlled left join spread using ("Station Name", year)')
def j2(t):
    joined = climate.attach_temperature_difference(t.controlled, "Station Name", "datetime")
    return joined.select(F.col("datetime").cast("date").alias("Date"), "site", r("Temp_Diff"))


@query("j3_attach_winter_precip", f"select {DATED}, site, round(PPTWT, 6) as PPTWT from controlled join winters using (Station_Name, winter)")
def j3(t):
    joined = climate.attach_winter_precipitation(t.controlled, "Station_Name", "datetime")
    return joined.select(F.col("datetime").cast("date").alias("Date"), "site", r("PPTWT"))


@query("j4_attach_coordinates", "select Date, Site, latitude as Latitude, longitude as Longitude from snow left join stations on Site = triplets")
def j4(t):
    return t.located(t.snow).select(day(), "Site", "Latitude", "Longitude")


@query("j5_station_semi_anti", """
    select 'kept' as part, count(*) as n from snow where Station_Name in (select Station_Name from station_split where split = 'train')
    union all select 'left out', count(*) from snow where Station_Name not in (select Station_Name from station_split where split = 'train')""", **SPLIT_VIEWS)
def j5(t):
    chosen = splits.create_splitter("spatial").assign(cleaning.station_table(t.snow)).where("split = 'train'")
    kept = quality.keep_stations(t.snow, chosen).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("kept"))
    out = quality.drop_stations(t.snow, chosen).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("left out"))
    return kept.unionByName(out).select("part", "n")


@query("j6_winter_range_lookup", """
    select k.Station_Name, k.winter, count(r.PRECIPITATION) as days_with_value, round(sum(r.PRECIPITATION), 6) as total
    from (select distinct Station_Name, winter, winter_end from derived) k left join derived r on r.Station_Name = k.Station_Name
      and r.datetime >= make_date(k.winter_end - 1, 12, 1) and r.datetime < make_date(k.winter_end, 3, 1) group by 1, 2""")
def j6(t):
    """The correlated range lookup as aggregate and equi-join."""
    from ..functions.dates import winter_of

    totals = t.derived.where(F.col("month").isin(12, 1, 2)).groupBy("Station_Name", winter_of(F.col("datetime")).alias("winter_end")).agg(
        F.count("PRECIPITATION").alias("days_with_value"), F.sum("PRECIPITATION").alias("total")
    )
    keys = t.derived.select("Station_Name", "winter", "winter_end").distinct()
    joined = keys.join(totals, ["Station_Name", "winter_end"], "left")
    return joined.select("Station_Name", "winter", F.coalesce("days_with_value", F.lit(0).cast("bigint")).alias("days_with_value"), r("total"))


@query("j7_nearest_snow_class", "select survey_id, in_bounds, snow_class from survey_cells left join cells using (ix, iy)")
def j7(t):
    found = grid.attach_snow_class(t.surveys, t.grid, t.grid_codes, t.grid_header, "LONGITUDE", "LATITUDE")
    return found.select("survey_id", "in_bounds", "snow_class")


@query("j8_nearest_elevation", "select survey_id, in_bounds, elevation_m from survey_cells left join grid using (ix, iy)")
def j8(t):
    found = grid.attach_nearest(t.surveys, t.grid, t.grid_header, ["elevation_m"], "LONGITUDE", "LATITUDE")
    return found.select("survey_id", "in_bounds", "elevation_m")


@query("j9_encoded_class_column", """
    select Date, Site, Snow_Depth, round(mean_density, 6) as encoded from snow join (select Snow_Class, avg(Snow_Density) as mean_density from snow group by 1) using (Snow_Class)""")
def j9(t):
    """The encoding joins on the class and stays on the row."""
    table = t.snow.groupBy("Snow_Class").agg(F.avg("Snow_Density").alias("encoded")).withColumn("fallback", F.lit(None).cast("double"))
    return encoders.apply_encoding(t.snow.select(day(), "Site", "Snow_Class", "Snow_Depth"), table, "Snow_Class").select("Date", "Site", "Snow_Depth", r("encoded"))


@query("j10_rows_of_split", "select Date, Site, round(SWE, 6) as SWE, round(Snow_Density * Snow_Depth, 6) as predicted from spatial where split = 'test'", **SPLIT_VIEWS)
def j10(t):
    """Held-out rows found by key, with a prediction that is a column of the row."""
    rows = splits.create_splitter("spatial").split(cleaning.station_table(t.snow), t.snow).where("split = 'test'")
    predictions = rows.select("Station_Name", "Date", (F.col("Snow_Density") * F.col("Snow_Depth")).alias("predicted"))
    return t.snow.join(predictions, ["Station_Name", "Date"]).select(day(), "Site", r("SWE"), r("predicted"))
