"""Fixed schemas of every stage."""

from __future__ import annotations

from pyspark.sql import types as T

DOUBLE, INT, LONG, STRING, TIMESTAMP = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name.replace("__", " "), kind) for name, kind in columns.items()])


RAW_OBSERVATIONS = _schema(
    datetime=TIMESTAMP,
    site=STRING,
    Station__Name=STRING,
    SWE=DOUBLE,
    SNOWDEPTH=DOUBLE,
    PRECIPITATION=DOUBLE,
    AVG__AIR__TEMP=DOUBLE,
    MIN__AIR__TEMP=DOUBLE,
    MAX__AIR__TEMP=DOUBLE,
    Elevation=DOUBLE,
    Snow_Class=STRING,
)

SCRAPED_STATIONS = _schema(site_name=STRING, state=STRING, ntwk=STRING, lat=DOUBLE, lon=DOUBLE, elev=DOUBLE)

STATION_METADATA = _schema(
    site_name=STRING, latitude=DOUBLE, longitude=DOUBLE, elevation=DOUBLE, triplets=STRING, snowclass=STRING
)

SURVEY_MAINE = _schema(
    survey_id=LONG,
    SURVEY_DATE_TEXT=STRING,
    DENSITY=DOUBLE,
    WATER=DOUBLE,
    DEPTH=DOUBLE,
    LATITUDE=DOUBLE,
    LONGITUDE=DOUBLE,
    SITE_NAME=STRING,
    CONFIDENCE_LEVEL=STRING,
)

SURVEY_BC = _schema(
    survey_id=LONG,
    Date=STRING,
    SD=DOUBLE,
    SWE_cm=DOUBLE,
    rho_g_cm3=DOUBLE,
    LATITUDE=DOUBLE,
    LONGITUDE=DOUBLE,
    LOCATION_NAME=STRING,
    ELEVATION=DOUBLE,
)

SNOW_CLASS_GRID = _schema(ix=INT, iy=INT, code=INT)
ELEVATION_GRID = _schema(ix=INT, iy=INT, elevation_m=DOUBLE)

EXPERIMENTS = _schema(
    model=STRING,
    variant=STRING,
    encoder=STRING,
    mode=STRING,
    rmse=DOUBLE,
    r2=DOUBLE,
    mbe=DOUBLE,
    best_iteration=INT,
    hyperparameters=T.MapType(STRING, DOUBLE),
    seed=INT,
    timestamp=STRING,
)
