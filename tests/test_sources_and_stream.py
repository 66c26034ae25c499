import datetime

import pytest
from pyspark.sql import functions as F

from firnline.operators import shape
from firnline.plans import cleaning
from firnline.schemas import RAW_OBSERVATIONS, SURVEY_BC
from firnline.session import scratch_path, shared_folder
from firnline.sources import readers, writers
from firnline.streaming.score import score_station_days

DAY = datetime.datetime


def raw_rows():
    rows = []
    for i in range(60):
        t = DAY(2004, 12, 1) + datetime.timedelta(days=i)
        rows.append((t, "312:ID:SNTL", "Banner Summit (312)", 4.0 + i * 0.1, 20.0 + i * 0.3, 0.1 * (i % 4), 20.0 + i % 7, 10.0 + i % 7, 30.0 + i % 7, 7040.0, "Alpine"))
    return rows


def test_station_metadata(spark):
    rows = [("Banner Summit (312)", "ID", "SNTL", 44.3, -115.2, 7040.0, "alpine"), ("Coast (9)", "WA", "SNTL", 47.0, -124.0, 10.0, "ocean"), ("Other (1)", "ID", "SCAN", 1.0, 1.0, 1.0, "taiga")]
    df = spark.createDataFrame(rows, "site_name string, state string, ntwk string, lat double, lon double, elev double, snow_class string")
    got = {r.site_name: (r.triplets, r.snowclass, r.elevation) for r in readers.shape_station_metadata(df).collect()}
    assert got == {"Banner Summit (312)": ("312:ID:SNTL", "Alpine", 7040.0), "Coast (9)": ("9:WA:SNTL", "Maritime", 10.0)}


def test_ingest(spark):
    stations = readers.station_list(spark, ["a", "b"], ["A (1)", "B (2)"], [10, 20], ["Alpine", "Taiga"])
    records = spark.createDataFrame([("a", DAY(2001, 1, 1), 1.0), ("a", DAY(2009, 1, 1), 2.0), ("z", DAY(2001, 1, 1), 3.0)], "site string, datetime timestamp, SWE double")
    path = writers.write_parquet(records, scratch_path(spark, "records"))
    found = readers.ingest_daily_records(spark.read.parquet(path), stations, "2000-01-01", "2005-12-31")
    assert [(r.site, r["Station Name"], r.Elevation) for r in found.collect()] == [("a", "A (1)", 10.0)]
    assert "PushedFilters: [IsNotNull(datetime), GreaterThanOrEqual(datetime" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        readers.station_list(spark, ["a"], [], [1], ["x"])
    with pytest.raises(ValueError):
        readers.ingest_daily_records(records.drop("site"), stations, "2000-01-01", "2001-01-01")
    with pytest.raises(ValueError):
        readers.select_variables(records, ("HUMIDITY",))


def test_csv_and_nan(spark):
    df = spark.createDataFrame([(1, "2021-02-01", 100.0, float("nan"), 0.3, 50.0, -120.0, "x", 900.0)], SURVEY_BC)
    path = writers.write_csv(df, scratch_path(spark, "csv"))
    row = readers.read_csv(spark, path, SURVEY_BC).first()
    assert row.SD == 100.0 and row.SWE_cm is None


def test_water_year_folders(spark):
    df = spark.createDataFrame([(DAY(2001, 9, 30), 1.0), (DAY(2001, 10, 1), 2.0)], "Date timestamp, SWE double")
    path = writers.write_by_water_year(df, scratch_path(spark, "years"))
    back = spark.read.parquet(path).where("water_year = 2002")
    assert [r.SWE for r in back.collect()] == [2.0]
    assert "PartitionFilters: [isnotnull(water_year" in back._jdf.queryExecution().executedPlan().toString()


def test_clustered_files_are_few_and_ordered(spark):
    days = spark.range(4000).selectExpr("concat('s', lpad(string(id % 50), 2, '0')) as Site", "timestamp'2001-10-01' + make_interval(0, 0, 0, int(id % 1400)) as Date", "double(id) as SWE").repartition(16)
    path = writers.write_by_water_year(days, scratch_path(spark, "clustered"))
    back = spark.read.parquet(path)
    years = back.select("water_year").distinct().count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert years == 4 and len(back.inputFiles()) <= tasks + years - 1
    stretches = back.groupBy("water_year", F.input_file_name().alias("file")).agg(F.min("Site").alias("low"), F.max("Site").alias("high"), F.count("*").alias("n")).orderBy("water_year", "low").collect()
    assert sum(s.n for s in stretches) == 4000
    assert all(a.high <= b.low for a, b in zip(stretches, stretches[1:]) if a.water_year == b.water_year)


def test_store_split_clustered(spark):
    rows = spark.range(1000).selectExpr("if(id % 5 = 0, 'test', 'train') as split", "string(id % 20) as Station_Name", "id")
    path = writers.store_split(rows.repartition(16), scratch_path(spark, "split"), ["Station_Name", "id"])
    back = spark.read.parquet(path)
    assert back.count() == 1000 and len(back.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions")) + 1


def test_union_keeps_other_flags(spark, tmp_path):
    from firnline.plans.catalog import QUERIES

    flags = ["A", "N", "R", "X", None]
    rows = [(i, i, i, i, f, 1.0, 0.5) for i, f in enumerate(flags)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_returnflag: r.l_tax for r in QUERIES["u1_union_frames"](spark, str(tmp_path)).collect()}
    assert got == {"A": 0.5, "N": 0.5, "X": 0.5, "R": None, None: None}


def test_clean_observations(spark):
    raw = spark.createDataFrame(raw_rows(), RAW_OBSERVATIONS)
    clean = cleaning.clean_observations(raw, [7])
    assert {"Date", "Site", "Station_Name", "Snow_Density", "Temp_Diff", "PPTWT", "TAVG_lag_7d", "PRECIPITATION_lag_7d", "Sturm_DOWY"} <= set(clean.columns)
    assert not {"winter", "TAVG", "threshold", "PRECIPITATION", "Station Name"} & set(clean.columns)
    rows = clean.orderBy("Date").collect()
    assert len(rows) == 60 and rows[0].Station_Name == "Banner Summit" and rows[0].TAVG_lag_7d is None and rows[10].TAVG_lag_7d is not None
    assert rows[0].Snow_Density == pytest.approx(0.2)
    stations = cleaning.station_table(clean).collect()
    assert [(s.Station_Name, s.Snow_Class) for s in stations] == [("Banner Summit", "Alpine")]


def test_station_filter_reaches_the_scan(spark):
    path = writers.write_parquet(spark.createDataFrame(raw_rows(), RAW_OBSERVATIONS), scratch_path(spark, "raw"))
    from firnline.operators import climate

    lagged = climate.lag_features(readers.read_parquet(spark, path, RAW_OBSERVATIONS), "Station Name", "datetime", ["PRECIPITATION"], [7, 14])
    plan = lagged.where(F.col("Station Name") == "x").select("datetime", "PRECIPITATION_lag_7d")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(`Station Name`,x)") == 2  # rows and edges
    assert plan.count("ReadSchema: struct<datetime:timestamp,Station Name:string,PRECIPITATION:double>") == 2
    assert "PRECIPITATION_14" not in plan  # the other window is pruned


def test_stream_equals_batch(spark):
    raw = spark.createDataFrame(raw_rows(), RAW_OBSERVATIONS)
    path = writers.write_parquet(raw, scratch_path(spark, "stream-in"))
    batch = score_station_days(raw)
    stream = score_station_days(spark.readStream.schema(RAW_OBSERVATIONS).parquet(path))
    assert stream.isStreaming
    out = scratch_path(spark, "stream-out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == batch.count() == 60
    assert got.select(sorted(got.columns)).exceptAll(batch.select(sorted(batch.columns))).count() == 0


def test_shape_helpers(spark):
    df = spark.createDataFrame([("Ocean", 1)], "c string, portion int")
    assert shape.keep_named(df, ["portion", "nope"]).columns == ["portion"]
    assert shape.replace_values(df, "c", {"Ocean": "Maritime"}).first().c == "Maritime"
    assert [r.step for r in shape.cumulative_portions(df, 3).collect()] == [1, 2, 3]
    assert shape.keyed(df, ["portion"]).columns == ["portion", "c"]
    assert readers.union_stations([df, df.drop("c")]).count() == 2


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
