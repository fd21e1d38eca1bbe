"""Microwave-link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweave.functions.attenuation import (
    P838_2,
    coefficient_pieces,
    link_polarisation,
    rain_rate,
    rain_rate_from_maximum,
    waa_leijnse,
    waa_pastorek,
    with_power_law,
)
from rainweave.functions.geo import midpoint
from rainweave.functions.rain import clamp_negative
from rainweave.operators import links as ops
from rainweave.operators import reshape
from rainweave.operators.partitioned import decay_horizon
from rainweave.operators.wetlookup import antenna_from_observed, lookup_table
from rainweave.plans.common import rounded
from rainweave.plans.registry import query
from rainweave.sources import views

# Threshold for the given data, whose rolling std is 0.53 .. 0.88. Levels are multiples of 0.05, so
# a std of exactly 0.72 does occur and would leave the flag to the last bit; 0.7203 cannot be hit.
THRESHOLD = 0.7203

WET_SQL = """,
wet as materialized (
  select link_id, t, trsl, coalesce(case when count(trsl) over w = 60 then stddev_pop(trsl) over w > 0.7203e0 end, false) as wet
  from cml window w as (partition by link_id order by t rows between 30 preceding and 29 following))"""


def recursion_sql(n: int, wet: str = WET_SQL) -> str:
    """Baseline and wet-antenna recursion row by row, all links side by side."""
    return f"""{wet},
rec as (
  select link_id, t, trsl, wet, [trsl] as hist, trsl as baseline, 0e0 as waa from wet where t = 0
  union all
  select link_id, t, trsl, wet,
         case when len(hist) < {n} then list_append(hist, baseline) else list_append(hist[2:], baseline) end,
         baseline,
         case when wet then least(trsl - baseline, 2.2e0, w0 + (2.2e0 - w0) * 3 / 15) else least(trsl - baseline, 2.2e0) end
  from (select s.link_id, s.t, s.trsl, s.wet, r.hist, r.waa as w0,
               case when s.t < {n} then s.trsl
                    when s.wet and not r.wet then case when len(list_filter(r.hist, lambda x: x is null)) = 0 then list_sum(r.hist) / {n} end
                    when s.wet then r.baseline else s.trsl end as baseline
        from rec r join wet s on s.link_id = r.link_id and s.t = r.t + 1))"""


# the regressions of P.838-3, written out for the twins
_REGRESSION_SQL = {
    "k_H": "pow(10e0, -5.33980e0 * exp(-pow((x + 0.10008e0) / 1.13098e0, 2)) - 0.35351e0 * exp(-pow((x - 1.26970e0) / 0.45400e0, 2))"
           " - 0.23789e0 * exp(-pow((x - 0.86036e0) / 0.15354e0, 2)) - 0.94158e0 * exp(-pow((x - 0.64552e0) / 0.16817e0, 2)) - 0.18961e0 * x + 0.71147e0)",
    "k_V": "pow(10e0, -3.80595e0 * exp(-pow((x - 0.56934e0) / 0.81061e0, 2)) - 3.44965e0 * exp(-pow((x + 0.22911e0) / 0.51059e0, 2))"
           " - 0.39902e0 * exp(-pow((x - 0.73042e0) / 0.11899e0, 2)) + 0.50167e0 * exp(-pow((x - 1.07319e0) / 0.27195e0, 2)) - 0.16398e0 * x + 0.63297e0)",
    "alpha_H": "-0.14318e0 * exp(-pow((x - 1.82442e0) / -0.55187e0, 2)) + 0.29591e0 * exp(-pow((x - 0.77564e0) / 0.19822e0, 2))"
               " + 0.32177e0 * exp(-pow((x - 0.63773e0) / 0.13164e0, 2)) - 5.37610e0 * exp(-pow((x + 0.96230e0) / 1.47828e0, 2))"
               " + 16.1721e0 * exp(-pow((x + 3.29980e0) / 3.43990e0, 2)) + 0.67849e0 * x - 1.95537e0",
    "alpha_V": "-0.07771e0 * exp(-pow((x - 2.33840e0) / -0.76284e0, 2)) + 0.56727e0 * exp(-pow((x - 0.95545e0) / 0.54039e0, 2))"
               " - 0.20238e0 * exp(-pow((x - 1.14520e0) / 0.26809e0, 2)) - 48.2991e0 * exp(-pow((x - 0.791669e0) / 0.116226e0, 2))"
               " + 48.5833e0 * exp(-pow((x - 0.791459e0) / 0.116479e0, 2)) - 0.053739e0 * x + 0.83433e0",
}


def _law_sql(version: str = "ITU_2005") -> str:
    """Link coefficients in SQL."""
    if version == "ITU_2005":
        k, alpha = (f"case when polarization = 'H' then {_REGRESSION_SQL[c + '_H']} else {_REGRESSION_SQL[c + '_V']} end" for c in ("k", "alpha"))
        return f""",
law as (select link_id, frequency, length, polarization, {k} as a, {alpha} as b from (select *, log10(frequency) as x from cml_link))"""
    rows = ",\n".join(
        "('" + r[0] + "', " + ", ".join(f"{v!r}::double" if v != float("inf") else "'inf'::double" for v in r[1:]) + ")" for r in coefficient_pieces(P838_2)
    )
    return f""",
piece(pol, low, high, a0, a1, a2, a3, b0, b1, b2, b3) as (values {rows}),
law as (select link_id, frequency, length, polarization,
               a0 + (frequency - low) * (a1 + (frequency - low) * (a2 + (frequency - low) * a3)) as a,
               b0 + (frequency - low) * (b1 + (frequency - low) * (b2 + (frequency - low) * b3)) as b
        from cml_link join piece on frequency >= low and frequency < high
         and pol = case when polarization = 'H' then 'H' else 'V' end)"""


def _film_sql(source: str, name: str) -> str:
    """``name``: the rows of ``source`` (with r in mm/h and frequency in GHz) and ``waa`` of the water film, step by step."""
    return f""",
{name}_e as (select *, 3.52e0 + 7.52e0 * h as e2, 77.66e0 - 103.3e0 * h as e0, 20.2e0 + 146.4e0 * h + 316e0 * h * h as g
             from (select *, 1 - 300e0 / 293e0 as h from {source})),
{name}_p as (select *, e2 + (e0 - 0.0671e0 * e0) / (1 + pow(frequency / g, 2)) + (0.0671e0 * e0 - e2) / (1 + pow(frequency / (39.8e0 * g), 2)) as er,
                    (e0 - 0.0671e0 * e0) * (frequency / g) / (1 + pow(frequency / g, 2))
                    + (0.0671e0 * e0 - e2) * (frequency / (39.8e0 * g)) / (1 + pow(frequency / (39.8e0 * g), 2)) as ei from {name}_e),
{name}_n as (select *, sqrt((sqrt(er * er + ei * ei) + er) / 2) as nr, sqrt((sqrt(er * er + ei * ei) - er) / 2) as ni, 2 * pi() * frequency * 1e9 / 299792458e0 as w from {name}_p),
{name}_a as (select *, w * nr * 2.06e-5 * pow(r, 0.24e0) as fa, w * ni * 2.06e-5 * pow(r, 0.24e0) as fb, w * 1.73e0 * 1e-3 as da, w * 0.014e0 * 1e-3 as db from {name}_n),
{name}_t as (select *, cos(fa) * cosh(fb) as fcr, -sin(fa) * sinh(fb) as fci, cos(fa) * sinh(fb) as fsr, -sin(fa) * cosh(fb) as fsi,
                    cos(da) * cosh(db) as dcr, -sin(da) * sinh(db) as dci, cos(da) * sinh(db) as dsr, -sin(da) * cosh(db) as dsi,
                    nr * nr + ni * ni as n2, 1.73e0 * 1.73e0 + 0.014e0 * 0.014e0 as c2 from {name}_a),
{name}_m as (select *, fcr + (fsr * nr + fsi * ni) / n2 as pr, fci + (fsi * nr - fsr * ni) / n2 as pi, fcr + fsr * nr - fsi * ni as qr, fci + fsr * ni + fsi * nr as qi,
                    dcr + (dsr * 1.73e0 + dsi * 0.014e0) / c2 as vr, dci + (dsi * 1.73e0 - dsr * 0.014e0) / c2 as vi,
                    dcr + dsr * 1.73e0 - dsi * 0.014e0 as ur, dci + dsr * 0.014e0 + dsi * 1.73e0 as ui from {name}_t),
{name} as (select * exclude (waa), case when r = 0 then 0 else waa end as waa from (
             select *, 10 * log10((pow(ur * pr - ui * pi + vr * qr - vi * qi, 2) + pow(ur * pi + ui * pr + vr * qi + vi * qr, 2)) / (pow(ur + vr, 2) + pow(ui + vi, 2))) as waa from {name}_m))"""


def _law(spark, folder, version="ITU_2005"):
    links = views.links(spark, folder)
    return with_power_law(
        links.withColumn("rule", link_polarisation(F.col("polarization"))), polarisation="rule", version=version
    )


def wet_series(spark, folder):
    return ops.flag_wet(views.link_series(spark, folder), ["link_id"], "t", "trsl", 60, THRESHOLD)


@query(
    "s4_link_table",
    views.with_views("cml", "cml_link") + """
select link_id, t, trsl, frequency, length, polarization from cml join cml_link using (link_id)""",
)
def s4_link_table(spark, folder):
    links = views.links(spark, folder).select("link_id", "frequency", "length", "polarization")
    return views.link_series(spark, folder).join(links, "link_id").select(
        "link_id", "t", "trsl", "frequency", "length", "polarization"
    )


@query(
    "p2_link_midpoints",
    views.with_views("cml_link") + """
select link_id, round((site_a_latitude + site_b_latitude) / 2, 9) as latitude,
       round((site_a_longitude + site_b_longitude) / 2, 9) as longitude from cml_link""",
)
def p2_link_midpoints(spark, folder):
    return views.links(spark, folder).select(
        "link_id", rounded(midpoint(F.col("site_a_latitude"), F.col("site_b_latitude")), 9).alias("latitude"),
        rounded(midpoint(F.col("site_a_longitude"), F.col("site_b_longitude")), 9).alias("longitude"),
    )


@query(
    "p13_polarisation",
    views.with_views("cml_link") + "select link_id, case polarization when 'HV' then 'V' else polarization end as rule from cml_link",
)
def p13_polarisation(spark, folder):
    return views.links(spark, folder).select("link_id", link_polarisation(F.col("polarization")).alias("rule"))


@query("w1_wet_flags", views.with_views("cml") + WET_SQL + "select link_id, t, wet from wet")
def w1_wet_flags(spark, folder):
    return wet_series(spark, folder).select("link_id", "t", "wet")


@query(
    "w2_wet_borders",
    views.with_views("cml") + WET_SQL + """
select * from (select link_id, t, coalesce(lead(wet) over p and not wet, false) as is_start,
               coalesce(lag(wet) over p and not wet, false) as is_end from wet window p as (partition by link_id order by t))
where is_start or is_end""",
)
def w2_wet_borders(spark, folder):
    flags = ops.wet_borders(wet_series(spark, folder), ["link_id"], "t", "wet")
    return flags.where("is_start or is_end").select("link_id", "t", "is_start", "is_end")


@query(
    "w2_wet_events",
    views.with_views("cml") + WET_SQL + """
select link_id, min(t) as start_pos, max(t) as end_pos, count(*) as samples
from (select link_id, t, t - row_number() over (partition by link_id order by t) as island from wet where wet)
group by link_id, island""",
)
def w2_wet_events(spark, folder):
    return ops.wet_events(wet_series(spark, folder), ["link_id"], "t", "wet")


@query(
    "w3_baseline_last_dry",
    views.with_views("cml") + WET_SQL + """
select link_id, t, last_value(case when not wet or t = 0 then trsl end ignore nulls)
       over (partition by link_id order by t rows between unbounded preceding and current row) as baseline from wet""",
)
def w3_baseline_last_dry(spark, folder):
    df = ops.baseline_constant(wet_series(spark, folder), ["link_id"], "t", "trsl", "wet", 1)
    return df.select("link_id", "t", "baseline")


@query("w3_baseline_mean_of_five", views.with_views("cml") + recursion_sql(5) + "select link_id, t, round(baseline, 9) as baseline from rec")
def w3_baseline_mean_of_five(spark, folder):
    df = ops.baseline_constant(wet_series(spark, folder), ["link_id"], "t", "trsl", "wet", 5)
    return df.select("link_id", "t", rounded(F.col("baseline"), 9).alias("baseline"))


_GAPS_SQL = WET_SQL.replace("wet as materialized (", "known as (") + """,
wet as materialized (select link_id, t, case when t % 997 <> 10 then trsl end as trsl, wet from known)"""


@query("w3_baseline_unknown_levels", views.with_views("cml") + recursion_sql(5, _GAPS_SQL) + "select link_id, t, round(baseline, 9) as baseline from rec")
def w3_baseline_unknown_levels(spark, folder):
    """The mean of five, with some levels unknown: a wet run that looks at one is unknown, and so are those that build on it."""
    gaps = wet_series(spark, folder).withColumn("trsl", F.when(F.col("t") % 997 != 10, F.col("trsl")))
    df = ops.baseline_constant(gaps, ["link_id"], "t", "trsl", "wet", 5)
    return df.select("link_id", "t", rounded(F.col("baseline"), 9).alias("baseline"))


@query(
    "w4_baseline_linear",
    views.with_views("cml") + WET_SQL + """,
f as (select *, case when t % 211 = 97 then null else wet end as flag from wet),
a as (select *, flag = false or t = 0 as anchor from f),
b as (select *, coalesce(anchor, false) as is_anchor from a),
k as (select *, max(case when is_anchor then t end) over (partition by link_id order by t rows between unbounded preceding and current row) as left_t,
             min(case when is_anchor then t end) over (partition by link_id order by t rows between current row and unbounded following) as self_or_next
      from b),
seg as (select link_id, t as left_t, trsl as left_v, lead(t) over p as right_t, lead(trsl) over p as right_v
        from b where is_anchor window p as (partition by link_id order by t)),
taint as (select link_id, left_t, bool_or(flag is null and t > 0) as bad from k group by link_id, left_t),
s as (select seg.*, coalesce(taint.bad, false) and right_t is not null as blank from seg left join taint using (link_id, left_t)),
q as (select *, lag(blank) over (partition by link_id order by left_t) as blank_before from s)
select k.link_id, k.t, round(case
    when k.is_anchor and right_t - q.left_t > 1 then case when blank then null else left_v end
    when k.is_anchor then case when blank_before then null else left_v end
    when right_t is null then 0
    when blank then null
    else left_v + (right_v - left_v) * (k.t - q.left_t) / (right_t - q.left_t) end, 9) as baseline
from k join q on q.link_id = k.link_id and q.left_t = k.left_t""",
)
def w4_baseline_linear(spark, folder):
    """Linear baseline, with some unknown flags put in so that blanked runs occur."""
    flags = wet_series(spark, folder).withColumn("flag", F.when(F.col("t") % 211 != 97, F.col("wet")))
    df = ops.baseline_linear(flags, ["link_id"], "t", "trsl", "flag")
    return df.select("link_id", "t", rounded(F.col("baseline"), 9).alias("baseline"))


def _wetted(spark, folder):
    based = ops.baseline_constant(wet_series(spark, folder), ["link_id"], "t", "trsl", "wet", 5)
    return ops.wet_antenna_schleiss(based, ["link_id"], "t", "trsl", "baseline", "wet")


@query("w5_wet_antenna", views.with_views("cml") + recursion_sql(5) + "select link_id, t, round(waa, 9) + 0e0 as waa from rec")
def w5_wet_antenna(spark, folder):
    return _wetted(spark, folder).select("link_id", "t", rounded(F.col("waa"), 9).alias("waa"))


@query("x1_blockwise_function", views.with_views("cml") + recursion_sql(5) + "select link_id, t, round(waa, 9) + 0e0 as waa from rec")
def x1_blockwise_function(spark, folder):
    """A plain 1-D Python function over each series in blocks: the wet-antenna recursion as a loop."""
    based = ops.baseline_constant(wet_series(spark, folder), ["link_id"], "t", "trsl", "wet", 5)

    def recursion(pdf):
        level, levels = 0.0, []
        for t, loss, wet in zip(pdf["t"], pdf["trsl"] - pdf["baseline"], pdf["wet"]):
            rising = level + (2.2 - level) * 3 / 15 if wet else 2.2
            level = 0.0 if t == 0 else min(loss, 2.2, rising)
            levels.append(level)
        return pdf[["link_id", "t"]].assign(waa=levels)

    df = ops.apply_in_blocks(based, ["link_id"], "t", recursion, "link_id long, t long, waa double", 4096, decay_horizon(0.8))
    return df.withColumn("waa", rounded(F.col("waa"), 9))


@query(
    "p8_clamped_attenuation",
    views.with_views("cml") + recursion_sql(5) + """
select link_id, t, round(greatest(trsl - baseline, 0), 6) as without_waa, round(greatest(trsl - baseline - waa, 0), 6) as with_waa from rec""",
)
def p8_clamped_attenuation(spark, folder):
    loss = F.col("trsl") - F.col("baseline")
    return _wetted(spark, folder).select(
        "link_id", "t", rounded(clamp_negative(loss)).alias("without_waa"), rounded(clamp_negative(loss - F.col("waa"))).alias("with_waa")
    )


@query(
    "f4_power_law",
    views.with_views("cml_link") + _law_sql() + "select link_id, round(a, 9) as a, round(b, 9) as b from law",
)
def f4_power_law(spark, folder):
    return _law(spark, folder).select("link_id", rounded(F.col("a"), 9).alias("a"), rounded(F.col("b"), 9).alias("b"))


@query(
    "f4_power_law_2003",
    views.with_views("cml_link") + _law_sql("ITU_2003") + "select link_id, round(a, 9) as a, round(b, 9) as b from law",
)
def f4_power_law_2003(spark, folder):
    return _law(spark, folder, "ITU_2003").select("link_id", rounded(F.col("a"), 9).alias("a"), rounded(F.col("b"), 9).alias("b"))


_LOSS_SQL = views.with_views("cml", "cml_link") + _law_sql() + """,
loss as (select cml.link_id, t, trsl - 0.5e0 as loss, frequency, length, a, b from cml join law using (link_id))"""


def _loss(spark, folder):
    law = _law(spark, folder).select("link_id", "frequency", "length", "a", "b")
    series = views.link_series(spark, folder).withColumn("loss", F.col("trsl") - 0.5)
    return series.join(law, "link_id")


@query(
    "f5_rain_rate",
    _LOSS_SQL + """
select link_id, t, round(case when r < 0.1e0 then 0 else r end, 6) as rain_rate
from (select *, case when loss >= 0 then pow(loss / (a * length), 1 / b) else 0 end as r from loss)""",
)
def f5_rain_rate(spark, folder):
    df = _loss(spark, folder)
    rate = rain_rate(F.col("loss"), F.col("length"), F.col("a"), F.col("b"))
    return df.select("link_id", "t", rounded(rate).alias("rain_rate"))


@query(
    "f6_rain_rate_from_maximum",
    _LOSS_SQL + """
select link_id, t, round(case when r < 0.1e0 then 0 else r end, 6) as rain_rate
from (select *, case when loss >= 0 then pow(loss / (a * pow(ln(90e0) + 0.57721566e0, b) * length), 1 / b) else 0 end as r from loss)""",
)
def f6_rain_rate_from_maximum(spark, folder):
    df = _loss(spark, folder)
    rate = rain_rate_from_maximum(F.col("loss"), F.col("length"), F.col("a"), F.col("b"))
    return df.select("link_id", "t", rounded(rate).alias("rain_rate"))


@query(
    "f7_waa_pastorek",
    _LOSS_SQL + """
select link_id, t, round(case when r = 0 then 0 else 14e0 * (1 - exp(-0.1e0 * pow(r, 0.55e0))) end, 6) as waa
from (select link_id, t, case when r < 0.1e0 then 0 else r end as r from
      (select *, case when loss >= 0 then pow(loss / (a * length), 1 / b) else 0 end as r from loss))""",
)
def f7_waa_pastorek(spark, folder):
    df = _loss(spark, folder)
    rate = rain_rate(F.col("loss"), F.col("length"), F.col("a"), F.col("b"))
    return df.select("link_id", "t", rounded(waa_pastorek(rate)).alias("waa"))


@query(
    "f8_waa_leijnse",
    _LOSS_SQL + """,
rated as (select link_id, t, frequency, case when rate < 0.1e0 then 0 else rate end as r
          from (select *, case when loss >= 0 then pow(loss / (a * length), 1 / b) else 0 end as rate from loss))""" + _film_sql("rated", "film")
    + "select link_id, t, round(waa, 6) as waa from film",
)
def f8_waa_leijnse(spark, folder):
    """Water-film model on every rain rate."""
    df = _loss(spark, folder).withColumn(
        "rain_rate", rain_rate(F.col("loss"), F.col("length"), F.col("a"), F.col("b"))
    )
    return df.select("link_id", "t", rounded(waa_leijnse(F.col("rain_rate"), F.col("frequency") * 1e9)).alias("waa"))


@query(
    "f9_waa_pastorek_observed",
    _LOSS_SQL + """,
pts as (select link_id, n, x, case when x = 0 then 0 else pow(x / (a * length), 1 / b) end as r
        from law cross join (select n, case when n = 0 then 0 else pow(10e0, -10e0 + 13e0 * n / 99e0) end as x
                             from (select unnest(generate_series(0, 99)) as n))),
lut as (select link_id, n, case when r = 0 then 0 else 14e0 * (1 - exp(-0.1e0 * pow(r, 0.55e0))) end as waa, x from pts),
seg as (select link_id, x + waa as lo, waa as w0, lead(x + waa) over p as hi, lead(waa) over p as w1
        from lut window p as (partition by link_id order by n)),
q as (select link_id, t, trsl as a_obs from cml)
select q.link_id, q.t, round(w0 + (w1 - w0) * (a_obs - lo) / (hi - lo), 6) as waa
from q asof join seg on q.link_id = seg.link_id and q.a_obs >= seg.lo""",
)
def f9_waa_pastorek_observed(spark, folder):
    table = lookup_table(_law(spark, folder).select("link_id", "length", "a", "b"), waa_pastorek)
    series = views.link_series(spark, folder)
    df = antenna_from_observed(series, table, "trsl")
    return df.select("link_id", "t", rounded(F.col("waa")).alias("waa"))


@query(
    "f9_waa_leijnse_observed",
    _LOSS_SQL + """,
pts as (select link_id, n, x, frequency, case when x = 0 then 0 else pow(x / (a * length), 1 / b) end as r
        from law cross join (select n, case when n = 0 then 0 else pow(10e0, -10e0 + 13e0 * n / 99e0) end as x
                             from (select unnest(generate_series(0, 99)) as n)))""" + _film_sql("pts", "lut") + """,
seg as (select link_id, x + waa as lo, waa as w0, lead(x + waa) over p as hi, lead(waa) over p as w1
        from lut window p as (partition by link_id order by n))
select q.link_id, q.t, round(w0 + (w1 - w0) * (trsl - lo) / (hi - lo), 6) as waa
from cml q asof join seg on q.link_id = seg.link_id and q.trsl >= seg.lo""",
)
def f9_waa_leijnse_observed(spark, folder):
    law = _law(spark, folder).select("link_id", "length", "a", "b", "frequency")
    table = lookup_table(law, lambda r: waa_leijnse(r, F.col("frequency") * 1e9))
    df = antenna_from_observed(views.link_series(spark, folder), table, "trsl")
    return df.select("link_id", "t", rounded(F.col("waa")).alias("waa"))


@query(
    "w9_link_rain",
    views.with_views("cml", "cml_link") + recursion_sql(5) + _law_sql() + """
select link_id, (t // 15 + 1) * 15 as bucket_end, round(avg(case when r < 0.1e0 then 0 else r end), 6) as rain_rate, count(*) as n
from (select rec.link_id, t, pow(greatest(trsl - baseline - waa, 0) / (a * length), 1 / b) as r from rec join law using (link_id))
group by link_id, t // 15""",
)
def w9_link_rain(spark, folder):
    """Signal level to rain rate, averaged over 15 minutes with the right edge as label."""
    rain = ops.link_rain(views.link_series(spark, folder), views.links(spark, folder), ["link_id"], "t", "trsl", threshold=THRESHOLD)
    bucket = (F.floor(F.col("t") / 15) + 1) * 15
    return rain.groupBy("link_id", bucket.alias("bucket_end")).agg(
        rounded(F.avg("rain_rate")).alias("rain_rate"), F.count(F.lit(1)).alias("n")
    )


# two ends per link: even minutes come from station A, odd ones from station B
_TWO_SQL = """,
two as (select link_id, case when t % 2 = 0 then 'Station A' else 'Station B' end as station, t // 2 as time, trsl, wet from wet)"""


def _two_ended(spark, folder):
    station = F.when(F.col("t") % 2 == 0, "Station A").otherwise("Station B")
    return wet_series(spark, folder).select(
        "link_id", station.alias("station"), F.floor(F.col("t") / 2).alias("time"), "trsl", "wet"
    )


@query(
    "a10_link_mean",
    views.with_views("cml") + WET_SQL + _TWO_SQL + "select link_id, time, round(avg(trsl), 6) as trsl from two group by link_id, time",
)
def a10_link_mean(spark, folder):
    return _two_ended(spark, folder).groupBy("link_id", "time").agg(rounded(F.avg("trsl")).alias("trsl"))


@query(
    "j14_station_pairs",
    views.with_views("cml") + WET_SQL + _TWO_SQL + """
select link_id, time, max(trsl) filter (station = 'Station A') as station_a, max(trsl) filter (station = 'Station B') as station_b
from two group by link_id, time""",
)
def j14_station_pairs(spark, folder):
    wide = reshape.to_wide(_two_ended(spark, folder), ["link_id", "time"], "station", "trsl", ["Station A", "Station B"])
    return wide.withColumnsRenamed({"Station A": "station_a", "Station B": "station_b"})


@query(
    "r2_two_level_wide",
    views.with_views("cml", "cml_link") + WET_SQL + _TWO_SQL + """,
m as (select time, polarization || '_' || station as cell, avg(trsl) as v from two join cml_link using (link_id) group by all)
select time, """ + ", ".join(
        f"round(max(v) filter (cell = '{p}_Station {s}'), 9) as {p.lower()}_{s.lower()}" for p in ("H", "V", "HV") for s in "AB"
    ) + " from m group by time",
)
def r2_two_level_wide(spark, folder):
    """Polarisation x station as columns, means over the links."""
    labels = views.links(spark, folder).select("link_id", "polarization")
    means = (
        _two_ended(spark, folder).join(labels, "link_id")
        .groupBy("time", F.concat_ws("_", "polarization", "station").alias("cell")).agg(F.avg("trsl").alias("v"))
    )
    names = {f"{p}_Station {s}": f"{p.lower()}_{s.lower()}" for p in ("H", "V", "HV") for s in "AB"}
    wide = reshape.to_wide(means, ["time"], "cell", "v", list(names))
    return wide.select("time", *[rounded(F.col(f"`{old}`"), 9).alias(new) for old, new in names.items()])


@query(
    "a12_wet_fraction",
    views.with_views("cml") + WET_SQL + _TWO_SQL + """
select link_id, round(count(*) filter (wet) / count(distinct time), 6) as wet_fraction from two group by link_id""",
)
def a12_wet_fraction(spark, folder):
    return ops.wet_fraction(_two_ended(spark, folder), "link_id", "time", "wet").withColumn(
        "wet_fraction", rounded(F.col("wet_fraction"))
    )


@query(
    "a13_masked_link_total",
    views.with_views("cml") + WET_SQL + _TWO_SQL + """,
f as (select link_id, count(*) filter (wet) / count(distinct time) as wet_fraction from two group by link_id)
select link_id, station, round(sum(case when wet_fraction < 0.8e0 then trsl end), 6) as total
from two join f using (link_id) group by link_id, station""",
)
def a13_masked_link_total(spark, folder):
    """Totals per link end; links that are wet too often are masked to NULL."""
    rows = _two_ended(spark, folder)
    totals = rows.groupBy("link_id", "station").agg(F.sum("trsl").alias("total"))
    fractions = ops.wet_fraction(rows, "link_id", "time", "wet")
    return totals.join(fractions, "link_id").select(
        "link_id", "station", rounded(F.when(F.col("wet_fraction") < 0.8, F.col("total"))).alias("total")
    )


@query(
    "a11_link_coordinates",
    views.with_views("cml", "cml_link") + """
select link_id, round(avg(site_a_latitude), 6) as latitude, round(avg(site_a_longitude), 6) as longitude, count(*) as n
from cml join cml_link using (link_id) group by link_id""",
)
def a11_link_coordinates(spark, folder):
    return s_table(spark, folder).groupBy("link_id").agg(
        rounded(F.avg("site_a_latitude")).alias("latitude"), rounded(F.avg("site_a_longitude")).alias("longitude"),
        F.count(F.lit(1)).alias("n"),
    )


def s_table(spark, folder):
    return views.link_series(spark, folder).join(views.links(spark, folder), "link_id")


@query(
    "a14_distinct_sites",
    views.with_views("cml_link") + """
select polarization, count(*) as tuples, count(distinct la) as latitudes
from (select distinct polarization, site_a_latitude as la, site_a_longitude as lo, site_b_latitude as lb, site_b_longitude as lp from cml_link)
group by polarization""",
)
def a14_distinct_sites(spark, folder):
    tuples = views.links(spark, folder).select(
        "polarization", "site_a_latitude", "site_a_longitude", "site_b_latitude", "site_b_longitude"
    ).distinct()
    return tuples.groupBy("polarization").agg(
        F.count(F.lit(1)).alias("tuples"), F.countDistinct("site_a_latitude").alias("latitudes")
    )
