"""Microwave attenuation: power-law coefficients, rain rate, wet-antenna models."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ITU-R P.838-2 (2003), rows frequency GHz, k_H, k_V, alpha_H, alpha_V.
P838_2 = (
    (1, 2, 4, 6, 7, 8, 10, 12, 15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100),
    (3.87e-5, 2e-4, 6e-4, 1.8e-3, 3e-3, 4.5e-3, 0.0101, 0.0188, 0.0367, 0.0751, 0.124, 0.187, 0.263, 0.35, 0.442,
     0.536, 0.707, 0.851, 0.975, 1.06, 1.12),
    (3.52e-5, 1e-4, 6e-4, 1.6e-3, 2.6e-3, 4e-3, 0.0089, 0.0168, 0.0335, 0.0691, 0.113, 0.167, 0.233, 0.31, 0.393,
     0.479, 0.642, 0.784, 0.906, 0.999, 1.06),
    (0.912, 0.963, 1.121, 1.308, 1.332, 1.327, 1.276, 1.217, 1.154, 1.099, 1.061, 1.021, 0.979, 0.939, 0.903,
     0.873, 0.826, 0.793, 0.769, 0.753, 0.743),
    (0.88, 0.923, 1.075, 1.265, 1.312, 1.31, 1.264, 1.2, 1.128, 1.065, 1.03, 1.0, 0.963, 0.929, 0.897, 0.868,
     0.824, 0.793, 0.769, 0.754, 0.744),
)

# ITU-R P.838-3 (2005) regression, terms (a, b, c) then slope m and constant c of log10 f.
P838_3 = {
    "k_H": (((-5.33980, -0.10008, 1.13098), (-0.35351, 1.26970, 0.45400), (-0.23789, 0.86036, 0.15354),
             (-0.94158, 0.64552, 0.16817)), -0.18961, 0.71147),
    "k_V": (((-3.80595, 0.56934, 0.81061), (-3.44965, -0.22911, 0.51059), (-0.39902, 0.73042, 0.11899),
             (0.50167, 1.07319, 0.27195)), -0.16398, 0.63297),
    "alpha_H": (((-0.14318, 1.82442, -0.55187), (0.29591, 0.77564, 0.19822), (0.32177, 0.63773, 0.13164),
                 (-5.37610, -0.96230, 1.47828), (16.1721, -3.29980, 3.43990)), 0.67849, -1.95537),
    "alpha_V": (((-0.07771, 2.33840, -0.76284), (0.56727, 0.95545, 0.54039), (-0.20238, 1.14520, 0.26809),
                 (-48.2991, 0.791669, 0.116226), (48.5833, 0.791459, 0.116479)), -0.053739, 0.83433),
}

# Accepted polarisation labels, valid frequency range in GHz, smallest rain rate in mm/h.
POLARISATIONS = {"V": ("v", "V", "vertical", "Vertical"), "H": ("h", "H", "horizontal", "Horizontal")}
FREQUENCY_RANGE_GHZ = (1.0, 100.0)
MIN_RAIN_RATE = 0.1
EULER_GAMMA = 0.57721566


def regression(name: str, frequency: Column) -> Column:
    """``k_H``, ``k_V``, ``alpha_H`` or ``alpha_V`` of P.838-3 at any frequency in GHz, by its regression."""
    terms, slope, constant = P838_3[name]
    x = F.log10(frequency)
    total = F.lit(slope) * x + F.lit(constant)
    for height, centre, width in terms:
        total = total + F.lit(height) * F.exp(-F.pow((x - F.lit(centre)) / F.lit(width), F.lit(2.0)))
    return F.pow(F.lit(10.0), total) if name.startswith("k") else total


def cubic_pieces(x: Sequence[float], y: Sequence[float]) -> np.ndarray:
    """Not-a-knot cubic spline: per interval the coefficients of (f - x_i)**0 .. **3."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    system, right = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * (slope[i] - slope[i - 1])
    # equal third derivatives across the second and the last but one knot
    system[0, :3] = h[1], -(h[0] + h[1]), h[0]
    system[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(system, right)
    return np.column_stack(
        [y[:-1], slope - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, (m[1:] - m[:-1]) / (6 * h)]
    )


def coefficient_pieces(table: Sequence[Sequence[float]]) -> list[tuple]:
    """(pol, low, high, a0..a3, b0..b3): spline pieces of a table of rows frequency, k_H, k_V, alpha_H, alpha_V."""
    f, *columns = (np.asarray(row, float) for row in table)
    rows = []
    for pol, k, alpha in (("H", 0, 2), ("V", 1, 3)):
        a, b = cubic_pieces(f, columns[k]), cubic_pieces(f, columns[alpha])
        for i in range(len(f) - 1):
            rows.append((pol, float(f[i]), float(f[i + 1]) if i + 2 < len(f) else float("inf"), *map(float, a[i]), *map(float, b[i])))
    return rows


def _on_pieces(table: Sequence[Sequence[float]], pol: Column, frequency: Column) -> tuple[Column, Column]:
    """Both coefficients by the piece that holds the frequency; the pieces stand in one constant array."""
    names = ["pol", "low", "high", *[f"{c}{i}" for c in "ab" for i in range(4)]]
    pieces = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in coefficient_pieces(table)])
    piece = F.get(F.filter(pieces, lambda p: (p["pol"] == pol) & (frequency >= p["low"]) & (frequency < p["high"])), F.lit(0))
    d = frequency - piece["low"]
    return tuple(piece[f"{c}0"] + d * (piece[f"{c}1"] + d * (piece[f"{c}2"] + d * piece[f"{c}3"])) for c in "ab")


def link_polarisation(label: Column) -> Column:
    """Dual-polarised links count as vertical."""
    return F.when(label == "HV", "V").otherwise(label)


def _canonical(label: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, spellings in POLARISATIONS.items():
        kind = F.when(label.isin(*spellings), name).otherwise(kind)
    return kind


def with_power_law(
    links: DataFrame, frequency: str = "frequency", polarisation: str = "polarization",
    version: str = "ITU_2005", strict: bool = True, table: Sequence[Sequence[float]] | None = None,
) -> DataFrame:
    """Add ``a`` and ``b`` of ``A = a R**b L`` by frequency (GHz) and polarisation.

    ``ITU_2005`` evaluates the regression of P.838-3 at the frequency itself, ``ITU_2003`` interpolates the
    table of P.838-2 with a not-a-knot spline. ``table`` (rows frequency, k_H, k_V, alpha_H, alpha_V) is interpolated
    instead, for instance the printed, rounded table of a recommendation.
    ``strict`` raises on a frequency outside 1..100 GHz or an unknown polarisation;
    otherwise such links get NULL coefficients.
    """
    if version not in ("ITU_2003", "ITU_2005"):
        raise ValueError("version must be 'ITU_2003' or 'ITU_2005'")
    low, high = FREQUENCY_RANGE_GHZ
    pol, f = _canonical(F.col(polarisation)), F.col(frequency)
    if strict:
        pol = F.when(pol.isNull(), F.raise_error(F.lit("polarisation must be vertical or horizontal"))).otherwise(pol)
        checked = F.when(
            f.between(low, high), f
        ).otherwise(F.raise_error(F.lit("frequency must be between 1 and 100 GHz")).cast("double"))
    else:
        checked = F.when(f.between(low, high), f)
    keyed = links.withColumns({"_pol": pol, "_f": checked})
    if table is None and version == "ITU_2005":
        a, b = (F.when(F.col("_pol") == "H", regression(f"{c}_H", F.col("_f"))).when(F.col("_pol") == "V", regression(f"{c}_V", F.col("_f"))) for c in ("k", "alpha"))
    else:
        a, b = _on_pieces(P838_2 if table is None else table, F.col("_pol"), F.col("_f"))
    return keyed.select(*links.columns, a.alias("a"), b.alias("b"))


def rain_rate(attenuation: Column, length_km: Column, a: Column, b: Column, r_min: float = MIN_RAIN_RATE) -> Column:
    """mm/h from path attenuation in dB; negative attenuation and rates under ``r_min`` give 0."""
    rate = F.when(attenuation >= 0, F.pow(attenuation / (a * length_km), F.lit(1.0) / b)).otherwise(F.lit(0.0))
    return F.when(attenuation.isNotNull(), F.when(rate < r_min, F.lit(0.0)).otherwise(rate))


def rain_rate_from_maximum(
    attenuation: Column, length_km: Column, a: Column, b: Column, r_min: float = MIN_RAIN_RATE, k: int = 90
) -> Column:
    """Rain rate from the maximum attenuation of ``k`` samples."""
    return rain_rate(attenuation, length_km, a * F.pow(F.log(F.lit(float(k))) + EULER_GAMMA, b), b, r_min)


def waa_pastorek(rate: Column, a_max: float = 14.0, zeta: float = 0.55, d: float = 0.1) -> Column:
    """Wet-antenna attenuation in dB from the rain rate, bounded by ``a_max``; 0 without rain."""
    wet = F.lit(a_max) * (F.lit(1.0) - F.exp(F.lit(-d) * F.pow(rate, F.lit(zeta))))
    return F.when(rate == 0, F.lit(0.0)).otherwise(wet)


# fixed values: double Debye model of pure water (Liebe et al. 1991), by theta = 1 - 300 K / T
STATIC = (77.66, -103.3)
HIGH_SHARE = 0.0671  # of the static value, between the two relaxations
OPTICAL = (3.52, 7.52)
RELAXATION_GHZ = (20.2, 146.4, 316.0)
SECOND_RELAXATION = 39.8  # times the first


LIGHT = 299792458.0  # m/s
COVER_INDEX = (1.73, 0.014)  # refractive index of the antenna cover
COVER_M = 0.001


def _given(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of a row of values that are computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), F.lit(0))


def _times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def _over(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    size = b[0] * b[0] + b[1] * b[1]
    return (a[0] * b[0] + a[1] * b[1]) / size, (a[1] * b[0] - a[0] * b[1]) / size


def water_permittivity(f_ghz: Column, t_kelvin: float = 293.0) -> tuple[Column, Column]:
    """Real part and loss of the permittivity of water without salt: an optical value and two relaxations."""
    theta = 1 - 300.0 / t_kelvin
    static, optical, corner = (sum(c * theta**k for k, c in enumerate(x)) for x in (STATIC, OPTICAL, RELAXATION_GHZ))
    real, loss = F.lit(optical), F.lit(0.0)
    for step, at in ((static * (1 - HIGH_SHARE), corner), (static * HIGH_SHARE - optical, corner * SECOND_RELAXATION)):
        ratio = f_ghz / F.lit(at)
        real, loss = real + F.lit(step) / (1 + ratio * ratio), loss + F.lit(step) * ratio / (1 + ratio * ratio)
    return real, loss


def _edges(index: tuple[Column, Column], thickness: Column, wave: Column) -> dict[str, Column]:
    """Of the characteristic matrix of a layer at normal incidence: its diagonal, and the two others, which are
    ``-i sin(phase)`` divided by and times the index."""
    a, b = wave * thickness * index[0], wave * thickness * index[1]
    diagonal = F.cos(a) * F.cosh(b), -F.sin(a) * F.sinh(b)
    flow = F.cos(a) * F.sinh(b), -F.sin(a) * F.cosh(b)
    upper, lower = _over(flow, index), _times(flow, index)
    return {"tr": diagonal[0], "ti": diagonal[1], "ur": upper[0], "ui": upper[1], "lr": lower[0], "li": lower[1]}


def waa_leijnse(rate: Column, f_hz: Column, t_kelvin: float = 293.0, gamma: float = 2.06e-5, delta: float = 0.24) -> Column:
    """Attenuation in dB of a water film of thickness ``gamma * R**delta`` on an antenna cover; 0 without rain.

    Model of Leijnse et al. (2008), solved with the characteristic matrices of layered media: the transmission of cover and
    film relative to that of the cover alone. Complex numbers are pairs of columns, so all of it stays in Spark.
    """
    def with_film(x: Column) -> Column:
        wave = 2 * math.pi * x["f"] / LIGHT
        size = F.sqrt(x["real"] * x["real"] + x["loss"] * x["loss"])
        index = F.sqrt((size + x["real"]) / 2), F.sqrt((size - x["real"]) / 2)
        cover = tuple(F.lit(v) for v in COVER_INDEX)
        film = _edges(index, F.lit(gamma) * F.pow(x["rate"], F.lit(delta)), wave)
        dry = _edges(cover, F.lit(COVER_M), wave)
        return _given({**{f"d{k}": v for k, v in dry.items()}, **{f"f{k}": v for k, v in film.items()}}, attenuation)

    def attenuation(m: Column) -> Column:
        # the amplitude that passes a stack is 2 over the sum of all elements of its matrix
        left, right = (m["dtr"] + m["dlr"], m["dti"] + m["dli"]), (m["dtr"] + m["dur"], m["dti"] + m["dui"])
        wet = [a + b for a, b in zip(_times(left, (m["ftr"] + m["fur"], m["fti"] + m["fui"])), _times(right, (m["ftr"] + m["flr"], m["fti"] + m["fli"])))]
        dry = [a + b for a, b in zip(left, right)]
        return 10 * F.log10((wet[0] * wet[0] + wet[1] * wet[1]) / (dry[0] * dry[0] + dry[1] * dry[1]))

    real, loss = water_permittivity(f_hz / 1e9, t_kelvin)
    db = _given({"rate": rate, "f": f_hz, "real": real, "loss": loss}, with_film)
    return F.when(rate == 0, F.lit(0.0)).otherwise(db)
