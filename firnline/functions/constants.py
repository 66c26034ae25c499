"""Published model parameters and lookup values."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. They must equal the published ones for results to be right.
# ---------------------------------------------------------------------------

# Sturm et al. (2010), doi 10.1175/2010JHM1202.1: bulk density by snow class.
STURM_PARAMETERS = {
    "alpine": {"rho_max": 0.5975, "rho_0": 0.2237, "k1": 0.0012, "k2": 0.0038},
    "maritime": {"rho_max": 0.5979, "rho_0": 0.2578, "k1": 0.0010, "k2": 0.0038},
    "prairie": {"rho_max": 0.5940, "rho_0": 0.2332, "k1": 0.0016, "k2": 0.0031},
    "tundra": {"rho_max": 0.3630, "rho_0": 0.2425, "k1": 0.0029, "k2": 0.0049},
    "taiga": {"rho_max": 0.2170, "rho_0": 0.2170, "k1": 0.0000, "k2": 0.0000},
}

# Jonas et al. (2009), doi 10.1016/j.jhydrol.2009.09.021: (a, b) by month and
# elevation band, in the order below 1400 m, 1400 to 2000 m, 2000 m and above.
JONAS_PARAMETERS = {
    1: ((31, 235), (47, 208), (52, 206)),
    2: ((9, 279), (52, 218), (46, 217)),
    3: ((3, 333), (31, 281), (26, 272)),
    4: ((25, 347), (15, 354), (9, 331)),
    5: ((19, 413), (29, 409), (21, 378)),
    6: (None, None, (8, 452)),
    7: (None, None, (15, 470)),
    8: (None, None, None),
    9: (None, None, None),
    10: (None, None, None),
    11: ((37, 149), (35, 183), (47, 206)),
    12: ((26, 201), (47, 190), (52, 203)),
}
JONAS_BAND_EDGES_M = (1400.0, 2000.0)

# Pistocchi (2016), doi 10.1016/j.ejrh.2016.03.004.
PISTOCCHI_BASE = 200
PISTOCCHI_DAY_SHIFT = 61

# Hill et al. (2019), doi 10.5194/tc-13-1767-2019: factor and exponents of
# depth, winter precipitation, temperature difference and day of water year.
HILL_ACCUMULATION = (0.0533, 0.9480, 0.1701, -0.1314, 0.2922)
HILL_ABLATION = (0.0481, 1.0395, 0.1699, -0.0461, 0.1804)
HILL_PEAK_DAY = 180
HILL_BLEND_RATE = 0.01

SNOW_CLASSES = ("alpine", "maritime", "prairie", "tundra", "taiga")

# Newer class names of the snow classification grid and the names used here.
LEGACY_CLASS_NAMES = {"montane_forest": "alpine", "boreal_forest": "taiga"}

MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

INCH_FACTORS = {"meters": 0.0254, "cm": 2.54, "mm": 25.4}
FOOT_IN_METRES = 0.3048

STURM_DAY_RANGE = (-92, 182)
WATER_YEAR_DAY_RANGE = (1, 366)

MAIN_FEATURES = ("Elevation", "Snow_Depth", "DOWY", "Latitude", "Longitude")
CLIMATE_7_FEATURES = ("PRECIPITATION_lag_7d", "TAVG_lag_7d")
CLIMATE_14_FEATURES = ("PRECIPITATION_lag_14d", "TAVG_lag_14d")
NOMINAL_FEATURE = "Snow_Class"
