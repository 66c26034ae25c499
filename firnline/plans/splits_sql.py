"""Stratified allocation and hashed order as SQL views, for the oracle."""

from __future__ import annotations


def allocation_sql(counts: str, units: str, held_out: str, name: str, stratum: str = "stratum") -> str:
    """``name``: units held out per stratum of ``counts``. ``held_out`` is an
    expression over ``total``."""
    return f"""
        select * exclude (total, stay, fl, rest, short, place),
          {units} - (fl + case when place <= short then 1 else 0 end)::bigint as {name}
        from (select *, row_number() over (order by rest desc, {stratum}) as place, stay - sum(fl) over () as short
              from (select *, floor({units} * stay / total) as fl, ({units} * stay) % total as rest
                    from (select *, total - cast({held_out} as bigint) as stay
                          from (select *, cast(sum({units}) over () as bigint) as total from {counts}))))"""


def split_sql(units: str, keys: list[str], stratum: str | None, test: str, validation: str | None, seed) -> dict[str, str]:
    """Views ``quota_counts``, ``quota_test``, ``quotas`` and the ranked split."""
    s = f"{stratum}" if stratum else "'all'"
    hashed = f"md5(concat_ws('|', '{seed}', {', '.join(f'cast({k} as varchar)' for k in keys)}))"
    views = {
        "quota_counts": f"select {s} as stratum, count(*) as units from {units} group by 1",
        "quota_test": allocation_sql("quota_counts", "units", test, "n_test"),
        "quota_left": "select *, units - n_test as remaining from quota_test",
        "quotas": allocation_sql("quota_left", "remaining", validation, "n_val") if validation else "select *, 0 as n_val from quota_left",
    }
    views["placed"] = f"""
        select u.*, case when place <= n_test then 'test' when place <= n_test + n_val then 'val' else 'train' end as split
        from (select *, row_number() over (partition by {s} order by {hashed}, {', '.join(keys)}) as place, {s} as stratum from {units}) u
        join quotas using (stratum)"""
    return views


FIFTH = "ceil(cast(0.2 as double) * total)"
EIGHTH = "ceil(cast(0.125 as double) * total)"

SPLIT_VIEWS = split_sql("station_table", ["Station_Name"], "Snow_Class", FIFTH, EIGHTH, 300)
SPLIT_VIEWS["station_split"] = "select Station_Name, split from placed"
SPLIT_VIEWS["spatial"] = "select snow.*, split from snow join station_split using (Station_Name)"
