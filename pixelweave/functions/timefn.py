"""Time-basis functions as columns of an epoch table, as a numpy matrix, and as text.

A basis function has a value raw(t) while tmin <= t <= tmax, both ends included, and 0 elsewhere. Centred functions
measure time from tref in a unit. `side` restricts to what is left or right of tref. Each function gives its raw value
through a small set of operations (`Ops`), so that one definition serves Spark columns and numpy arrays.
"""

from __future__ import annotations

import ast
import math
import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit.
SECONDS = {"secs": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "mins": 60.0, "minutes": 60.0, "hours": 3600.0, "hour": 3600.0, "days": 86400.0, "day": 86400.0, "weeks": 604800.0, "years": 365.25 * 86400, "year": 365.25 * 86400}

_COLUMN = SimpleNamespace(
    where=lambda c, a, b: F.when(c, a).otherwise(b),
    log=lambda x: F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(F.abs(x))),
    exp=F.exp, cos=F.cos, sin=F.sin, atan=F.atan, pow=lambda x, n: F.pow(x, F.lit(float(n))), abs=F.abs, rint=F.rint, const=lambda v: F.lit(float(v)),
)
_ARRAY = SimpleNamespace(
    where=np.where, log=lambda x: np.log(np.abs(x)), exp=np.exp, cos=np.cos, sin=np.sin, atan=np.arctan, pow=lambda x, n: np.power(x, float(n)), abs=np.abs, rint=np.rint, const=float,
)


def when(t) -> datetime:
    """A date, datetime or one of the accepted texts as a datetime."""
    if isinstance(t, datetime):
        return t
    if isinstance(t, date):
        return datetime(t.year, t.month, t.day)
    for form in ("%Y-%m-%d", "%Y%m%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f"):
        try:
            return datetime.strptime(str(t), form)
        except ValueError:
            pass
    raise ValueError(f"not a date or time: {t!r}")


@dataclass
class Basis:
    """A function of time; parameters are those of its text form."""

    name: str
    tref: object = None
    units: str = "days"
    tmin: object = None
    tmax: object = None
    side: str = "both"
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        self.name = self.name.lower()
        if self.name not in FUNCTIONS:
            raise ValueError(f"unknown function {self.name!r}")
        if self.name in CENTRED and self.tref is None:
            raise ValueError(f"{self.name} needs tref")
        if self.units not in SECONDS:
            raise ValueError(f"unknown unit {self.units!r}")
        for key in ("tau", "period", "scale"):
            if self.params.get(key) == 0:
                raise ValueError(f"{key} cannot be zero")
        if self.name in ("bspline", "ispline", "pbspline") and int(self.params.get("order", 3)) < 2:
            raise ValueError("order of a spline cannot be less than 2")
        if self.name == "pbspline" and self.params.get("offset", 0.0) >= self.params["period"]:
            raise ValueError("offset cannot exceed the period")
        if self.name == "geolog":
            self.side = "right"

    def _raw(self, tn, ops):
        return FUNCTIONS[self.name](tn, ops, **self.params)

    def bounds(self) -> tuple[datetime | None, datetime | None]:
        lo, hi = (when(x) if x is not None else None for x in (self.tmin, self.tmax))
        if self.side == "right":
            lo = max(filter(None, (lo, when(self.tref))))
        if self.side == "left":
            hi = min(filter(None, (hi, when(self.tref))))
        return lo, hi

    def column(self, t: Column) -> Column:
        """The value at a timestamp or date column."""
        t = t.cast("timestamp_ntz")
        seconds = lambda c: F.unix_micros(c.cast("timestamp_ltz")) / 1e6  # noqa: E731  both ends are of one zone
        at = lambda d: F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")
        tn = (seconds(t) - seconds(at(when(self.tref)))) / SECONDS[self.units] if self.tref is not None else None
        out = self._raw(tn, _COLUMN)
        lo, hi = self.bounds()
        active = F.lit(True)
        if lo is not None:
            active = active & (t >= at(lo))
        if hi is not None:
            active = active & (t <= at(hi))
        return F.when(active, out).otherwise(F.lit(0.0))

    def values(self, times: list) -> np.ndarray:
        """The values at dates or datetimes."""
        ts = [when(t) for t in times]
        tn = np.array([(t - when(self.tref)).total_seconds() / SECONDS[self.units] for t in ts]) if self.tref is not None else None
        with np.errstate(all="ignore"):
            out = np.broadcast_to(self._raw(tn, _ARRAY), len(ts)).astype(float)
        lo, hi = self.bounds()
        return np.where([(lo is None or t >= lo) and (hi is None or t <= hi) for t in ts], out, 0.0)

    def __str__(self) -> str:
        keys = {"tref": self.tref and str(self.tref), "units": self.units if self.tref else None, "tmin": self.tmin and str(self.tmin), "tmax": self.tmax and str(self.tmax), "side": None if self.side == "both" or self.name == "geolog" else self.side} | self.params
        return f"{self.name}({','.join(f'{k}={v}' for k, v in keys.items() if v is not None)})"


def _power(n):
    return lambda tn, ops, tau=1.0: ops.pow(tn / tau, n)


def _log(base):
    return lambda tn, ops, tau=1.0: ops.log(tn / tau) / base


def _exp(k):
    return lambda tn, ops, tau=1.0: ops.exp(-k * tn / tau)


def _spline(x, ops, order: int, power: int, divisor: float):
    total = ops.const(0.0)
    for k in range(order + 2):
        m = x - k - (order + 1) / 2
        total = total + ops.where(m >= 0, ops.pow(m, power), ops.const(0.0)) * ((-1) ** k * math.comb(order + 1, k))
    return total / divisor


def _bspline(tn, ops, scale=1.0, order=3):
    order = int(order)
    return _spline(tn / scale + order + 1, ops, order, order, float(math.factorial(order)))


def _ispline(tn, ops, scale=1.0, order=3):
    order = int(order)
    return _spline(tn / scale + order + 1, ops, order, order + 1, (order + 1) * math.factorial(order) / scale)


def _pbspline(tn, ops, period, scale=1.0, order=3, offset=0.0):
    t = tn - offset
    return _bspline(t - period * ops.rint(t / period), ops, scale, order)


FUNCTIONS = {
    "constant": lambda tn, ops: ops.const(1.0),
    "power": lambda tn, ops, exp=1.0, tau=1.0: ops.pow(tn / tau, exp),
    "linear": _power(1), "quadratic": _power(2), "cubic": _power(3), "quartic": _power(4),
    "log": _log(1.0), "log10": _log(math.log(10)), "log2": _log(math.log(2)),
    "geolog": lambda tn, ops, tau=1.0: ops.log(1 + ops.abs(tn / tau)),
    "exp": _exp(1.0), "exp10": _exp(math.log(10)), "exp2": _exp(math.log(2)),
    "cos": lambda tn, ops, period=1.0: ops.cos(2 * math.pi * tn / period),
    "sin": lambda tn, ops, period=1.0: ops.sin(2 * math.pi * tn / period),
    "arctan": lambda tn, ops, period=1.0: ops.atan(tn / period),
    "bspline": _bspline, "ispline": _ispline, "pbspline": _pbspline,
}
CENTRED = frozenset(FUNCTIONS) - {"constant"}


class Collection(list):
    """Functions in order, none twice."""

    def append(self, fn) -> Collection:
        for f in fn if isinstance(fn, list) else [fn]:
            if any(str(f) == str(g) for g in self):
                raise ValueError(f"{f} is there already")
            super().append(f)
        return self

    def __iadd__(self, other) -> Collection:
        return self.append(other)

    def __add__(self, other) -> Collection:
        return Collection(self).append(other)

    def matrix(self, times: list) -> np.ndarray:
        """The design matrix: a row for each time, a column for each function."""
        return np.stack([f.values(times) for f in self], axis=1) if self else np.zeros((len(times), 0))

    def columns(self, t: Column, prefix: str = "g") -> list[Column]:
        return [f.column(t).alias(f"{prefix}{i}") for i, f in enumerate(self)]

    def __str__(self) -> str:
        return "[" + ";".join(map(str, self)) + "]"


def poly(order: int, tref, minorder: int = 0, units: str = "days", tau: float = 1.0, **active) -> Collection:
    """1, t, t^2 and so on, from minorder on."""
    return Collection(Basis("constant", **active) if k == 0 else Basis("power", tref, units, params={"exp": float(k), "tau": tau}, **active) for k in range(minorder, order + 1))


def periodic(period: float, tref, units: str = "days", **active) -> Collection:
    return Collection(Basis(n, tref, units, params={"period": period}, **active) for n in ("cos", "sin"))


def spline_set(name: str, tmin, tmax, num: int, order: int = 3, units: str = "days", **params) -> Collection:
    """Uniform knots from tmin to tmax; the scale is their distance."""
    if num < 1:
        raise ValueError("number of splines cannot be zero")
    a, b = when(tmin), when(tmax)
    step = (b - a) / max(num - 1, 1)
    scale = step.total_seconds() / SECONDS[units]
    return Collection(Basis(name, a + i * step, units, tmin, tmax, params={"order": order, "scale": scale} | params) for i in range(num))


_SETS = {"poly": lambda **k: poly(int(k.pop("order")), k.pop("tref"), int(k.pop("minorder", 0)), **k), "periodic": lambda **k: periodic(k.pop("period"), k.pop("tref"), **k)}
_SETS |= {n + "set": (lambda n: lambda **k: spline_set(n, k.pop("tmin"), k.pop("tmax"), int(k.pop("num")), int(k.pop("order", 3)), **k))(n) for n in ("bspline", "ispline", "pbspline")}


def _literal(v: str):
    v = v.strip().strip("'\"")
    try:
        value = ast.literal_eval(v)
        return value if isinstance(value, (int, float)) and not re.fullmatch(r"\d{8}", v) else v
    except (ValueError, SyntaxError):
        return v


def parse(text: str) -> Collection:
    """`name(k=v,...)`, several between brackets and divided by semicolons; names in any case, quotes optional."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    out = Collection()
    for part in filter(None, (p.strip() for p in text.split(";"))):
        m = re.fullmatch(r"(\w+)\s*\((.*)\)", part, re.S)
        if not m:
            raise ValueError(f"not a function: {part!r}")
        keys = {}
        for item in filter(None, (i.strip() for i in m[2].split(","))):
            key, eq, value = item.partition("=")
            if not eq:
                raise ValueError(f"not a parameter: {item!r}")
            keys[key.strip().lower()] = _literal(value)
        name = m[1].lower()
        if name in _SETS:
            out.append(_SETS[name](**keys))
        else:
            own = {k: keys.pop(k) for k in ("tref", "units", "tmin", "tmax", "side") if k in keys}
            out.append(Basis(name, **own, params=keys))
    return out


#: The classes of a function. Those that are not named here have none. No function is a step of its own.
CLASSES = {
    "constant": ("secular",),
    "linear": ("secular",),
    "cos": ("seasonal",),
    "sin": ("seasonal",),
    "bspline": ("seasonal", "reg"),
    "ispline": ("transient", "reg"),
}


def function_types(fns: Collection) -> dict[str, list[int]]:
    """The places of the columns of each class; reg are those that an inversion regularises."""
    return {c: [i for i, f in enumerate(fns) if c in CLASSES.get(f.name, ())] for c in ("secular", "seasonal", "transient", "step", "reg")}


def timescales(fns: Collection, times: list) -> list[float]:
    """For each column: the span of the times in years of 365 days if secular, the period of a cosine or sine, the scale of a
    regularised spline, in their unit; else not a number."""
    span = abs((when(times[-1]) - when(times[0])).days) / 365.0
    key = {"seasonal": "period", "reg": "scale"}
    out = []
    for f in fns:
        classes = CLASSES.get(f.name, ())
        out.append(span if "secular" in classes else float(f.params.get(key[classes[-1]], 1.0)) if classes else math.nan)
    return out


class TimeFunction:
    """A builder of models out of steps, seasons, decays and polynomials."""

    def __init__(self, tref, units: str = "days"):
        self.tref, self.units, self.functions = tref, units, Collection()

    def add_heaviside(self, times: list) -> TimeFunction:
        for t in times:
            self.functions.append(Basis("constant", t, self.units, tmin=t))
        return self

    def add_periodic(self, periods: list) -> TimeFunction:
        for p in periods:
            self.functions.append(periodic(float(p), self.tref, self.units))
        return self

    def add_post_seismic(self, times: list, taus: list) -> TimeFunction:
        if len(times) != len(taus or []):
            raise ValueError("each event needs a tau")
        for t, tau in zip(times, taus):
            self.functions.append(Basis("geolog", t, self.units, params={"tau": float(tau)}))
        return self

    def add_log(self, taus: list, base10: bool = False) -> TimeFunction:
        for tau in taus:
            self.functions.append(Basis("log10" if base10 else "log", self.tref, self.units, params={"tau": float(tau)}))
        return self

    def add_polynomial(self, order: int) -> TimeFunction:
        """Without its constant, which models carry on their own."""
        self.functions.append(poly(order, self.tref, 1, self.units))
        return self


def heaviside(t: Column, event: Column) -> Column:
    """Strictly after the event."""
    return F.when(t > event, 1.0).otherwise(0.0)


def post_seismic(t: Column, event: Column, tau: float) -> Column:
    """log10(1 + (t - event) / tau) after the event, in years; what is no number counts as 1e-6 before the step."""
    x = 1 + (t - event) / tau
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(1e-6)) * heaviside(t, event)


def days(n: float) -> timedelta:
    return timedelta(days=n)
