"""Density and SWE models (D1 to D9) and scores (A13, A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import JONAS_PARAMETERS, STURM_PARAMETERS
from ..operators import density, metrics, swe
from .registry import day, query, r

_STURM_VALUES = ", ".join(f"('{c}', {p['rho_max']}, {p['rho_0']}, {p['k1']}, {p['k2']})" for c, p in STURM_PARAMETERS.items())
_JONAS_VALUES = ", ".join(
    f"({m}, {band}, {'null, null' if ab is None else f'{ab[0]}, {ab[1]}'})" for m, bands in JONAS_PARAMETERS.items() for band, ab in enumerate(bands)
)
VIEWS = {
    "sturm": f"select cls, cast(rho_max as double) as rho_max, cast(rho_0 as double) as rho_0, cast(k1 as double) as k1, cast(k2 as double) as k2 from (values {_STURM_VALUES}) v(cls, rho_max, rho_0, k1, k2)",
    "jonas": f"select m, band, cast(a as double) as a, cast(b as double) as b from (values {_JONAS_VALUES}) v(m, band, a, b)",
    "densities": """
        select snow.*, (a * (Snow_Depth * cast(0.01 as double)) + b) / 1000 as Jonas_Density, (200 + (Pistochi_DOWY + 61)) / cast(1000 as double) as Pistochi_Density,
          (rho_max - rho_0) * (1 - exp(-k1 * Snow_Depth - k2 * Sturm_DOWY)) + rho_0 as Sturm_Density
        from snow left join sturm on cls = lower(Snow_Class)
        left join jonas on m = month(Date) and band = case when Elevation < 1400 then 0 when Elevation < 2000 then 1 else 2 end""",
    "swes": """
        select *, Jonas_Density * Snow_Depth as Jonas_SWE, Pistochi_Density * Snow_Depth as Pistochi_SWE, Sturm_Density * Snow_Depth as Sturm_SWE from densities""",
    "hill": """
        select *, case when ok then acc end as swe_acc, case when ok then abl end as swe_abl from
          (select *, isfinite(acc) and isfinite(abl) as ok from
            (select *, 0.0533 * pow(h, 0.9480) * pow(PPTWT, 0.1701) * (case when Temp_Diff > 0 then pow(Temp_Diff, -0.1314) end) * pow(DOWY, 0.2922) as acc,
               0.0481 * pow(h, 1.0395) * pow(PPTWT, 0.1699) * (case when Temp_Diff > 0 then pow(Temp_Diff, -0.0461) end) * pow(DOWY, 0.1804) as abl
             from (select *, Snow_Depth * 10 as h from clean)))""",
}
VIEWS["hill_swe"] = """
        select *, (swe_acc * 0.5 * (1 - turn) + swe_abl * 0.5 * (1 + turn)) / 10 as Hill_SWE
        from (select *, tanh(cast(0.01 as double) * (DOWY - 180)) as turn from hill)"""
SCORES = """sqrt(avg((yhat - y) * (yhat - y))), 6) as rmse, round(avg(yhat - y), 6) as mbe,
      round(1 - sum((yhat - y) * (yhat - y)) / (count(*) * var_pop(y)), 6) as rsq, count(*) as n"""
SCORES = f"round({SCORES}"


@query("d1_sturm_density", "select Date, Site, round(Sturm_Density, 8) as Sturm_Density from densities", **VIEWS)
def d1(t):
    return density.with_densities(t.snow, ["Sturm"]).select(day(), "Site", r("Sturm_Density", 8))


@query("d2_jonas_density", "select Date, Site, round(Jonas_Density, 8) as Jonas_Density from densities", **VIEWS)
def d2(t):
    return density.with_densities(t.snow, ["Jonas"]).select(day(), "Site", r("Jonas_Density", 8))


@query("d3_pistocchi_density", "select Date, Site, Pistochi_Density from densities", **VIEWS)
def d3(t):
    return density.with_densities(t.snow, ["Pistochi"]).select(day(), "Site", "Pistochi_Density")


@query("d4_hill_parts", "select Date, Site, round(swe_acc, 6) as swe_acc, round(swe_abl, 6) as swe_abl from hill", **VIEWS)
def d4(t):
    acc, abl = swe.hill_parts(F.col("PPTWT"), F.col("Temp_Diff"), F.col("DOWY"), F.col("Snow_Depth") * 10)
    return t.clean([]).select(day(), "Site", r(acc, 6, "swe_acc"), r(abl, 6, "swe_abl"))


@query("d5_hill_blend", """
    select Date, Site, round(Snow_Depth * 0.5 * (1 - turn) + SWE * 0.5 * (1 + turn), 6) as blended
    from (select *, tanh(cast(0.01 as double) * (DOWY - 180)) as turn from snow)""")
def d5(t):
    return t.snow.select(day(), "Site", r(swe.hill_blend(F.col("Snow_Depth"), F.col("SWE"), F.col("DOWY")), 6, "blended"))


@query("d6_hill_swe", "select Date, Site, round(Hill_SWE, 6) as Hill_SWE from hill_swe", **VIEWS)
def d6(t):
    return swe.with_hill_swe(t.clean([])).select(day(), "Site", r("Hill_SWE"))


@query("d7_swe_from_density", "select Date, Site, round(Snow_Depth * Snow_Density, 6) as swe from snow")
def d7(t):
    return t.snow.select(day(), "Site", r(swe.swe_from_density(F.col("Snow_Depth"), F.col("Snow_Density")), 6, "swe"))


@query("d8_swe_by_algorithm", """
    select Date, Site, algorithm, round(case algorithm when 'default' then Snow_Depth * Snow_Density when 'STURM' then Sturm_SWE
      when 'Jonas' then (Snow_Depth * cast(0.01 as double)) * 100 * Jonas_Density when 'pistochi' then Pistochi_SWE when 'Hill' then Hill_SWE end, 9) as swe
    from (select *, case DOWY % 6 when 0 then 'default' when 1 then 'STURM' when 2 then 'Jonas' when 3 then 'pistochi' when 4 then 'Hill' else 'other' end as algorithm
          from swes join (select Date, Site, Hill_SWE from hill_swe) using (Date, Site))""", **VIEWS)
def d8(t):
    depth = F.col("Snow_Depth")
    algorithm = F.expr("case DOWY % 6 when 0 then 'default' when 1 then 'STURM' when 2 then 'Jonas' when 3 then 'pistochi' when 4 then 'Hill' else 'other' end")
    choices = {
        "default": swe.swe("default", snow_depth=depth, snow_density=F.col("Snow_Density")),
        "sturm": swe.swe("sturm", snow_depth=depth, DOY=F.col("Sturm_DOWY"), snow_class=F.col("Snow_Class")),
        "jonas": swe.swe("jonas", snow_depth=depth * 0.01, month=F.month("Date"), elevation=F.col("Elevation")),
        "pistochi": swe.swe("pistochi", snow_depth=depth, DOY=F.col("Pistochi_DOWY")),
        "hill": swe.swe("hill", snow_depth=depth * 10, pptwt=F.col("PPTWT"), TD=F.col("Temp_Diff"), DOY=F.col("DOWY")),
    }
    return t.clean([]).select(day(), "Site", algorithm.alias("algorithm"), r(swe.swe_by_name(algorithm, choices), 9, "swe"))


@query("d9_score_table", """
    select c.Date, c.Site, round(Jonas_Density, 9) as Jonas_Density, round(Pistochi_Density, 6) as Pistochi_Density, round(Sturm_Density, 6) as Sturm_Density,
      round(Jonas_SWE, 9) as Jonas_SWE, round(Pistochi_SWE, 6) as Pistochi_SWE, round(Sturm_SWE, 6) as Sturm_SWE, round(Hill_SWE, 6) as Hill_SWE
    from swes c join hill_swe h using (Date, Site)""", **VIEWS)
def d9(t):
    models = ["Jonas", "Pistochi", "Sturm"]
    scored = t.clean([]).transform(density.with_densities, models).transform(swe.with_swe_products, models).transform(swe.with_hill_swe)
    return scored.select(day(), "Site", r("Jonas_Density", 9), r("Pistochi_Density"), r("Sturm_Density"), r("Jonas_SWE", 9), *[r(f"{m}_SWE") for m in ("Pistochi", "Sturm", "Hill")])


@query("a13_model_metrics", f"select Snow_Class, {SCORES} from (select Snow_Class, SWE as y, Sturm_SWE as yhat from swes where Sturm_SWE is not null) group by 1", **VIEWS)
def a13(t):
    scored = t.snow.transform(density.with_densities, ["Sturm"]).transform(swe.with_swe_products, ["Sturm"])
    return metrics.evaluate_model(scored, "SWE", "Sturm_SWE", ["Snow_Class"]).select("Snow_Class", r("rmse"), r("mbe"), r("rsq"), "n")


_LONG = " union all ".join(f"select '{m}_SWE' as model, SWE as y, {m}_SWE as yhat from swes where {m}_SWE is not null" for m in ("Jonas", "Pistochi", "Sturm"))


@query("a14_compare_models", f"select model, {SCORES} from ({_LONG}) group by 1", **VIEWS)
def a14(t):
    """Flagship: station-days, conversion, snow filters, three models, scores."""
    models = ["Jonas", "Pistochi", "Sturm"]
    scored = t.snow.transform(density.with_densities, models).transform(swe.with_swe_products, models)
    return metrics.compare_models(scored, "SWE", [f"{m}_SWE" for m in models]).select("model", r("rmse"), r("mbe"), r("rsq"), "n")
