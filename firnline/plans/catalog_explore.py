"""Aggregations and reports (A5 to A12, A15 to A20), windows W5 to W8, sorts (T),
set operations and reshaping (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..functions.text import triplet_state
from ..operators import density, encoders, explore, metrics, ordering, shape, splits
from ..sources.readers import union_stations
from . import cleaning
from .catalog_models import SCORES, VIEWS
from .registry import day, query, r
from .splits_sql import SPLIT_VIEWS

NUMBERS = ["SWE", "Snow_Depth", "Snow_Density"]


def _spatial(t):
    return splits.create_splitter("spatial").split(cleaning.station_table(t.snow), t.snow)


@query("a5_distinct_counts", "select count(distinct Station_Name) as n_station_name, count(distinct Site) as n_site, count(distinct Date) as n_date from snow")
def a5(t):
    return explore.distinct_counts(t.snow.select("Station_Name", "Site", day()), ["Station_Name", "Site", "Date"])


@query("a6_frequency_tables", """
    select 'state' as kind, split_part(Site, ':', 2) as value, count(*) as count from snow group by 2
    union all select 'month', monthname(Date), count(*) from snow group by 2""")
def a6(t):
    states = explore.value_counts(t.snow, triplet_state(F.col("Site")), "value").withColumn("kind", F.lit("state"))
    months = explore.value_counts(t.snow, month_label(F.col("Date")), "value").withColumn("kind", F.lit("month"))
    return states.unionByName(months).select("kind", "value", "count")


@query("a7_class_share", """
    select Snow_Class, count, cast(round_even(count * 100.0 / sum(count) over (), 0) as int) as percent from (select Snow_Class, count(*) as count from station_table group by 1)""")
def a7(t):
    return explore.class_share(cleaning.station_table(t.snow), "Snow_Class")


_DESCRIBE = " union all ".join(
    f"""select '{c}' as column_name, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min,
      round(max({c}), 6) as max, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75 from snow"""
    for c in NUMBERS
)


@query("a8_descriptive_statistics", _DESCRIBE)
def a8(t):
    table = explore.describe(t.snow, NUMBERS)
    return table.select("column_name", "count", *[r(c) for c in ("mean", "std", "min", "max", "p25", "p50", "p75")])


@query("a9_percentiles", "select 'Snow_Density' as column_name, " + ", ".join(f"round(quantile_cont(Snow_Density, {p}), 6) as p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from snow")
def a9(t):
    table = explore.percentiles(t.snow, ["Snow_Density"], [0.1, 0.25, 0.5, 0.75, 0.9])
    return table.select("column_name", *[r(c) for c in table.columns if c != "column_name"])


@query("a10_box_summary", """
    select Snow_Class, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(q3 - q1, 6) as iqr,
      round(min(case when ok then Elevation end), 6) as whisker_low, round(max(case when ok then Elevation end), 6) as whisker_high, count(*) filter (not ok) as outliers
    from (select *, Elevation between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as ok from station_table join
      (select Snow_Class, quantile_cont(Elevation, 0.25) as q1, quantile_cont(Elevation, 0.5) as median, quantile_cont(Elevation, 0.75) as q3 from station_table group by 1) using (Snow_Class))
    group by Snow_Class, q1, median, q3""")
def a10(t):
    table = explore.box_summary(cleaning.station_table(t.snow), "Snow_Class", "Elevation")
    return table.select("Snow_Class", *[r(c) for c in ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high")], "outliers")


@query("a11_histogram", """
    select e.split, cast(e.bin as int) as bin, round(lo + e.bin * ((hi - lo) / 50), 6) as left_edge, count(c.split) as count
    from (select split, lo, hi, unnest(range(0, 50)) as bin from ranges) e
    left join (select split, cast(least(floor((Snow_Depth - lo) / (hi - lo) * 50), 49) as int) as bin from spatial join ranges using (split)) c
      on c.split = e.split and c.bin = e.bin group by 1, 2, 3""", **SPLIT_VIEWS, ranges="select split, min(Snow_Depth) as lo, max(Snow_Depth) as hi from spatial group by 1")
def a11(t):
    return explore.histogram(_spatial(t), "Snow_Depth", "split").select("split", "bin", r("left_edge"), "count")


@query("a12_correlation_matrix", " union all ".join(f"select '{x}' as x, '{y}' as y, round(corr({x}, {y}), 6) as corr from snow" for x in NUMBERS for y in NUMBERS))
def a12(t):
    return explore.correlation_matrix(t.snow, NUMBERS).select("x", "y", r("corr"))


@query("a15_split_report", """
    select split, count(*) as samples, count(distinct Station_Name) as stations, (select count(distinct Station_Name) from spatial) as total_stations from spatial group by 1""", **SPLIT_VIEWS)
def a15(t):
    """Also U2: stations over all splits without a union."""
    return explore.split_report(_spatial(t))


_ATTRIBUTIONS = {
    "Snow_Depth": "(Snow_Depth - 60) * 0.001D", "DOWY": "(DOWY - 180) * 0.0004D", "Elevation": "(Elevation - 1500) * 0.00001D",
}
_ATTRIBUTED = "(Snow_Depth - 60) * cast(0.001 as double) as a_Snow_Depth, (DOWY - 180) * cast(0.0004 as double) as a_DOWY, (Elevation - 1500) * cast(0.00001 as double) as a_Elevation"
_BY_FEATURE = " union all ".join(f"select Snow_Class, 'a_{c}' as feature, a_{c} as a from attributed" for c in _ATTRIBUTIONS)


@query("a16_attribution_means", f"""
    select Snow_Class, feature, round(avg(abs(a)), 6) as importance from ({_BY_FEATURE}) group by 1, 2
    union all select 'all', feature, round(avg(abs(a)), 6) from ({_BY_FEATURE}) group by 2""", attributed=f"select Snow_Class, {_ATTRIBUTED} from snow")
def a16(t):
    features = [f"a_{c}" for c in _ATTRIBUTIONS]
    rows = t.snow.select("Snow_Class", *[F.expr(e).alias(f"a_{c}") for c, e in _ATTRIBUTIONS.items()])
    by_class = explore.attribution_means(rows, features, "Snow_Class")
    overall = explore.attribution_means(rows, features).withColumn("Snow_Class", F.lit("all"))
    return by_class.unionByName(overall).select("Snow_Class", "feature", r("importance"))


@query("a17_average_gain", """
    select feature, round(g / sum(g) over (), 9) as importance from
      (select p_brand as feature, case when count(*) filter (p_size > 40) <> 0 then sum(p_retailprice) / count(*) filter (p_size > 40) else 0 end as g from part group by 1)""")
def a17(t):
    supplied = t.table("part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("gain"), F.count_if(F.col("p_size") > 40).alias("splits"))
    return explore.average_gain(supplied).select("feature", r("importance", 9))


_TRIALS_SQL = """select l_returnflag as model, l_linestatus as variant, case l_linenumber % 3 when 0 then 'onehot' when 1 then 'target' else 'catboost' end as encoder,
      sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))) as rmse from lineitem group by 1, 2, 3"""


def _trials(t):
    """Results per (model, variant, encoder) aggregated from the line items."""
    error = F.col("l_tax") - F.col("l_discount")
    encoder = F.expr("case l_linenumber % 3 when 0 then 'onehot' when 1 then 'target' else 'catboost' end")
    return t.table("lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("variant"), encoder.alias("encoder")).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


@query("a18_encoder_selection", """
    select encoder, count(*) as wins from (select *, rank() over (partition by model, variant order by rmse) as place from trials) where place = 1 group by 1""", trials=_TRIALS_SQL)
def a18(t):
    return explore.encoder_wins(_trials(t))


@query("a19_first_per_station", "select Snow_Class, Station_Name, Elevation from station_table")
def a19(t):
    return explore.first_per_station(t.snow, "Station_Name", ["Date", "Site"], ["Snow_Class", "Elevation"]).select("Snow_Class", "Station_Name", "Elevation")


@query("a20_row_counts", "select split, count(*) as n from spatial group by 1", **SPLIT_VIEWS)
def a20(t):
    return ordering.group_sizes(_spatial(t), ["split"], "n")


_HASHED = "md5(concat_ws('|', '10', Station_Name))"


@query("w5_portions", f"select Station_Name, cast(ntile(8) over (order by {_HASHED}, Station_Name) as int) as portion from station_table")
def w5(t):
    return ordering.portions(cleaning.station_table(t.snow).select("Station_Name"), [], ["Station_Name"], 10, 8)


@query("w6_cumulative_portions", f"""
    select cast(step as int) as step, count(*) as stations from (select ntile(8) over (order by {_HASHED}, Station_Name) as portion from station_table) join range(1, 9) s(step) on portion <= step group by 1""")
def w6(t):
    parts = ordering.portions(cleaning.station_table(t.snow).select("Station_Name"), [], ["Station_Name"], 10, 8)
    return ordering.group_sizes(shape.cumulative_portions(parts, 8), ["step"], "stations")


ORDERED_SQL = """(coalesce(sum(Snow_Density) over w, 0) + (select avg(Snow_Density) from {v})) / (count(*) over w + 1)"""


@query("w7_ordered_target_statistics", f"""
    select Date, Site, round({ORDERED_SQL.format(v='snow')}, 6) as encoded from snow
    window w as (partition by Snow_Class order by Station_Name, Date rows between unbounded preceding and 1 preceding)""")
def w7(t):
    encoded = encoders.ordered_encoding(t.snow, "Snow_Class", "Snow_Density", ["Station_Name"], ["Date"], period=F.year("Date"))
    return encoded.select(day(), "Site", r("encoded"))


@query("w8_best_per_group", "select model, variant, encoder, round(rmse, 6) as rmse from (select *, row_number() over (partition by model, variant order by rmse, encoder) as n from trials) where n = 1", trials=_TRIALS_SQL)
def w8(t):
    return explore.best_per_group(_trials(t), ["model", "variant"], "rmse", ["encoder"]).select("model", "variant", "encoder", r("rmse"))


@query("t1_sort_station_time", 'select "Station Name", cast(datetime as date) as Date, row_number() over (partition by "Station Name" order by datetime) as place from raw')
def t1(t):
    """Order within the station, by rank; no global sort."""
    ranked = ordering.running_before(
        t.raw.select("Station Name", "datetime", F.year("datetime").alias("year")), ["Station Name"], ["year"], ["datetime"], {"place": F.lit(1)}
    )
    return ranked.select("Station Name", F.col("datetime").cast("date").alias("Date"), (F.col("place") + 1).alias("place"))


@query("t2_sort_descending", "select Station_Name as value, count(*) as count from snow group by 1 order by 2 desc, 1")
def t2(t):
    return explore.value_counts(t.snow, F.col("Station_Name"), "value")


@query("t3_first_rows", "select Station_Name, Date, round(SWE, 6) as SWE from snow order by SWE desc, Station_Name, Date limit 5")
def t3(t):
    return shape.first_rows(t.snow.select("Station_Name", day(), "SWE"), [F.desc("SWE"), "Station_Name", "Date"]).select("Station_Name", "Date", r("SWE"))


@query("t4_best_of_sweep", "select model, variant, encoder, round(rmse, 6) as rmse from trials order by rmse, model, variant, encoder limit 1", trials=_TRIALS_SQL)
def t4(t):
    return shape.first_rows(_trials(t), ["rmse", "model", "variant", "encoder"], 1).select("model", "variant", "encoder", r("rmse"))


@query("u1_union_frames", """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity, case when l_returnflag <> 'R' then l_tax end as l_tax from lineitem""")
def u1(t):
    """Frames that cover the table between them; one lacks a column."""
    items = t.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax")
    returned = items.where("l_returnflag = 'R' or l_returnflag is null").drop("l_tax")
    others = items.where("l_returnflag not in ('A', 'N', 'R')")
    return union_stations([items.where("l_returnflag = 'A'"), items.where("l_returnflag = 'N'"), others, returned])


@query("u2_stations_over_splits", "select count(distinct Station_Name) as stations from spatial", **SPLIT_VIEWS)
def u2(t):
    return _spatial(t).agg(F.count_distinct("Station_Name").alias("stations"))


@query("u3_wide_to_long", """
    select Date, Site, 'Snow_Depth' as Measurement, round(Snow_Depth, 6) as Value from snow union all select Date, Site, 'Snow_Density', round(Snow_Density, 6) from snow""")
def u3(t):
    long = explore.stack_measurements(t.snow.select(day(), "Site", "Snow_Depth", "Snow_Density"), ["Date", "Site"], ["Snow_Depth", "Snow_Density"])
    return long.select("Date", "Site", "Measurement", r("Value"))


_WIDE_MODELS = ("Jonas", "Pistochi", "Sturm")
_WIDE_LONG = " union all ".join(f"select '{m}_Density' as model, Snow_Density as y, {m}_Density as yhat from densities where {m}_Density is not null" for m in _WIDE_MODELS)
_WIDE_SCORES = f"(select model, {SCORES} from ({_WIDE_LONG}) group by 1)"


@query("u4_long_to_wide", " union all ".join(
    f"select '{m}' as metric, " + ", ".join(f"max(case when model = '{c}_Density' then {m.lower()} end) as {c}_Density" for c in _WIDE_MODELS) + f" from {_WIDE_SCORES}"
    for m in ("RMSE", "MBE", "RSQ")), **VIEWS)
def u4(t):
    names = [f"{m}_Density" for m in _WIDE_MODELS]
    scores = metrics.compare_models(density.with_densities(t.snow, list(_WIDE_MODELS)), "Snow_Density", names)
    return metrics.scores_wide(scores, names).select("metric", *[r(n) for n in names])


@query("u5_leakage_check", "select count(*) as stations, count(*) filter (splits > 1) as leaking from (select Station_Name, count(distinct split) as splits from spatial group by 1)", **SPLIT_VIEWS)
def u5(t):
    rows = _spatial(t)
    leaking = splits.leakage(rows).agg(F.count(F.lit(1)).alias("leaking"))
    return rows.agg(F.count_distinct("Station_Name").alias("stations")).join(F.broadcast(leaking))  # one row each
