"""Derived physical fields of binned particle sums, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import AnalysisError, require
from .scalars import safe_div


@dataclass(frozen=True)
class Units:
    """Fixed values, in metal units: Boltzmann's constant and conversions."""

    kb: float = 8.617343e-5
    bar2gpa: float = 1e-4
    mvv2e: float = 1.0364269e-4
    nktv2p: float = 1.6021765e6
    mass2gcm3: float = 1.66053906660


#: Input columns by role: the first that a table has counts.
ALIASES = {
    "N": ("Ncount", "N", "ncount"),
    "M": ("v_mass", "mass", "M"),
    "mvx": ("v_mvx", "mvx"),
    "mvy": ("v_mvy", "mvy"),
    "mvz": ("v_mvz", "mvz"),
    "KE": ("c_ke", "v_ke", "ke"),
    **{f"mvv{a}": (f"v_mvv{a}", f"mvv{a}") for a in ("xx", "yy", "zz", "xy", "xz", "yz")},
    **{f"W{a}": (f"c_virial_{k}_", f"c_virial[{k}]", f"W{a}") for k, a in enumerate(("xx", "yy", "zz", "xy", "xz", "yz"), 1)},
}
STRESSES = ("xx", "yy", "zz", "xy", "xz", "yz")
#: Names under which derived fields are asked for, in any case, and what they stand for.
NAMES = {
    "t": "T", "temperature": "T", "vx": "vx", "vy": "vy", "vz": "vz", "velocity": "speed", "pressure": "pressure", "density": "density",
    **{f"s{a}": f"sigma_{a}" for a in STRESSES}, "vonmisess": "von_mises",
}
NEED_VOLUME = ("pressure", "density", "von_mises", *(f"sigma_{a}" for a in STRESSES))


def first_present(columns: list[str], names: tuple[str, ...], code: str | None = "MissingColumn") -> str | None:
    """The first of names among columns; none is an error unless code is None."""
    for n in names:
        if n in columns:
            return n
    if code:
        raise AnalysisError(code, f"none of {', '.join(names)}")
    return None


def fields(columns: list[str], dv: float = 1.0, units: Units = Units()) -> dict[str, Column]:
    """Every derived field that a table with these columns has, by name. Stresses whose inputs are missing are left out."""
    require(isinstance(dv, (int, float)) and 0 < dv < float("inf"), "BadDV", "the volume of a bin must be positive")
    at = lambda role: F.col(f"`{first_present(columns, ALIASES[role])}`")
    opt = lambda role: (n := first_present(columns, ALIASES[role], None)) and F.col(f"`{n}`")
    n, m, ke = at("N"), at("M"), at("KE")
    p = {a: at(f"mv{a}") for a in "xyz"}
    v = {a: safe_div(p[a], m) for a in "xyz"}
    square = v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]
    thermal = ke + 0.5 * units.mvv2e * m * square - units.mvv2e * (v["x"] * p["x"] + v["y"] * p["y"] + v["z"] * p["z"])
    out = {f"v{a}": v[a] for a in "xyz"}
    out |= {"speed": F.sqrt(square), "density": m / dv * units.mass2gcm3, "T": safe_div(2 * thermal, 3 * n * units.kb)}
    for a in STRESSES:
        i, j = a
        second, virial = opt(f"mvv{a}"), opt(f"W{a}")
        if second is not None and virial is not None:
            kinetic = units.mvv2e * units.nktv2p * (second + m * v[i] * v[j] - v[i] * p[j] - v[j] * p[i])
            out[f"sigma_{a}"] = (virial - kinetic) / dv * units.bar2gpa
    s = {a: out.get(f"sigma_{a}") for a in STRESSES}
    if all(s[a] is not None for a in ("xx", "yy", "zz")):
        out["pressure"] = -(s["xx"] + s["yy"] + s["zz"]) / 3
        if all(x is not None for x in s.values()):
            sq = lambda x: x * x
            normal = sq(s["xx"] - s["yy"]) + sq(s["yy"] - s["zz"]) + sq(s["zz"] - s["xx"])
            out["von_mises"] = F.sqrt(0.5 * (normal + 6 * (sq(s["xy"]) + sq(s["xz"]) + sq(s["yz"]))))
    return out


def variable(df: DataFrame, name: str, dv: float | None = None, units: Units = Units()) -> Column:
    """A raw column of that name, or else the derived field that the name stands for."""
    if name in df.columns:
        return F.col(f"`{name}`")
    field = NAMES.get(name.lower())
    require(field is not None, "UnknownVariable", name)
    require(field not in NEED_VOLUME or dv is not None, "NeedDV", f"{name} needs the volume of a bin")
    found = fields(df.columns, 1.0 if dv is None else dv, units)
    if field not in found:
        raise AnalysisError("MissingPressure" if field == "pressure" else "MissingStressComponent", name)
    return found[field]


def derived_table(df: DataFrame, dv: float, keys: tuple[str, ...] = ("step_index", "row_id"), units: Units = Units()) -> DataFrame:
    """Keys and all derived fields but von Mises, the density named density_gcm3."""
    found = fields(df.columns, dv, units)
    order = ["vx", "vy", "vz", "speed", "density", "T", "pressure", *(f"sigma_{a}" for a in STRESSES)]
    rename = {"density": "density_gcm3"}
    return df.select(*(k for k in keys if k in df.columns), *(found[k].alias(rename.get(k, k)) for k in order if k in found))
