"""The registered queries of the raster time-series operators, each beside its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from math import pi
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .fixtures import BPERP, INC, LABELS, MASK, PX, SLANT, ed, st
from .functions import complexcol as C
from .functions import dates as D
from .functions import stats, timefn
from .operators import amplitude, closure, despeckle, fit, neighbours, network, phaselink, sbas, scatterers, sequential, simulate, spectral, topo
from .plans import stencil
from .plans.checkpoints import checkpoint
from .sources import raster

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _sql[key] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rnd(c: Column | str, n: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 0.5 * 10**-n, F.lit(0.0)).otherwise(F.round(c, n))


def R(e: str, n: int = 6) -> str:
    return f"(case when abs({e}) < {0.5 * 10**-n:.12f} then 0.0::double else round(({e})::double, {n}) end)"


def num(values) -> str:
    """A list literal of doubles."""
    return "[" + ",".join(repr(float(v)) for v in values) + "]::double[]"


AMP = "sqrt(re*re + im*im)"

# ---- projections and predicates ------------------------------------------------------------------------------------


@register(f"with {PX}, {st()} select y, x, band, {R(AMP)} amp from st")
def p1_amplitude(spark, d):
    return X.stack(spark, d).select("y", "x", "band", rnd(C.amplitude(F.col("re"), F.col("im"))).alias("amp"))


@register(f"with {PX}, {st()} select y, x, band, {R('atan2(im, re)')} phase from st")
def p2_phase(spark, d):
    return X.stack(spark, d).select("y", "x", "band", rnd(C.phase(F.col("re"), F.col("im"))).alias("phase"))


@register(f"with {PX}, {st()} select y, x, band, {R('cos(atan2(im, re))')} re, {R('sin(atan2(im, re))')} im from st")
def p3_phasor(spark, d):
    a, b = C.phasor(C.phase(F.col("re"), F.col("im")))
    return X.stack(spark, d).select("y", "x", "band", rnd(a).alias("re"), rnd(b).alias("im"))


@register(f"with {PX}, {st()} select a.y, a.x, a.band, {R('a.re*b.re + a.im*b.im')} re, {R('a.im*b.re - a.re*b.im')} im from st a join st b on a.y = b.y and a.x = b.x and b.band = 0 where a.band > 0")
def p4_interferogram(spark, d):
    return scatterers.interferograms(X.stack(spark, d)).select("y", "x", "band", rnd("re").alias("re"), rnd("im").alias("im"))


@register(f"with {PX}, {st()}, p as (select *, 40 * re phi from st) select y, x, band, {R('phi - 2*pi()*round_even(phi/(2*pi()), 0)')} phase from p")
def p5_wrap(spark, d):
    return X.stack(spark, d).select("y", "x", "band", rnd(C.wrap(40 * F.col("re"))).alias("phase"))


@register(f"with {PX}, {st()}, {MASK} select y, x, bool_and(not (re = 0 and im = 0) and not isnan(re) and mask <> 0) valid from st join mk using (y, x) group by y, x")
def p6_validity(spark, d):
    return amplitude.all_valid(X.stack(spark, d), X.mask(spark, d))


CAL = f"cal as (select band, avg({AMP}) amp_const from st group by band), al as (select band, amp_const / (select amp_const from cal where band = 0) alpha from cal)"


@register(f"with {PX}, {st()}, {CAL} select y, x, band, {R(f'{AMP} / alpha')} amp from st join al using (band)")
def p7_normalise(spark, d):
    s = X.stack(spark, d)
    return amplitude.normalised(s, amplitude.calibrate(s)).select("y", "x", "band", rnd("amp").alias("amp"))


DA = f"s as (select y, x, count(*) n, avg({AMP}) m, avg({AMP}*{AMP}) m2 from st where {AMP} <> 0 group by y, x), da as (select y, x, n, case when n > 1 then m else 0.0 end mean_amp, case when n > 1 and m2 - m*m > 0 then sqrt(m2 - m*m)/m else -1.0 end da from s)"


@register(f"with {PX}, {st()}, {DA} select y, x from da where da >= 0 and da < 0.5")
def p8_ps_select(spark, d):
    return amplitude.dispersion(X.stack(spark, d)).where(amplitude.persistent(F.col("da"), 0.5)).select("y", "x")


IFG = "ifg as (select a.y, a.x, a.band, a.re*b.re + a.im*b.im re, a.im*b.re - a.re*b.im im from st a join st b on a.y = b.y and a.x = b.x and b.band = 0 where a.band > 0)"


def _is_ps(spark, d):
    return X.pixels(spark, d).select("y", "x", ((F.col("vec_id") % 3) == 0).alias("is_ps"))


@register(f"with {PX}, {st()}, {IFG} select y, x, band, {R('case when vec_id % 3 = 0 then re else cos(atan2(im, re)) end')} re, {R('case when vec_id % 3 = 0 then im else sin(atan2(im, re)) end')} im from ifg join px using (y, x)")
def p9_ps_over_ds(spark, d):
    s = X.stack(spark, d)
    out = scatterers.integrate(scatterers.interferograms(s, unit=True), scatterers.interferograms(s), _is_ps(spark, d))
    return out.select("y", "x", "band", rnd("re").alias("re"), rnd("im").alias("im"))


@register(f"with {PX} select y, x, case when vec_id % 3 = 0 then 0.95 else (vec_id * 31 % 100) / 100.0 end::double tcorr from px")
def p10_coherence_override(spark, d):
    t = X.pixels(spark, d).select("y", "x", (F.col("vec_id") * 31 % 100 / 100.0).alias("tcorr"))
    return scatterers.override_coherence(t, _is_ps(spark, d))


@register(f"with {PX}, {st()} select y, x, band, {R('atan2(im, re) * 0.05546576 / (4*pi())', 9)} displacement from st")
def p11_displacement(spark, d):
    return X.stack(spark, d).select("y", "x", "band", rnd(C.displacement(C.phase(F.col("re"), F.col("im"))), 9).alias("displacement"))


def _linked(spark, d, n, size):
    """Phasors by mini stack, and a datum for each, out of two parts of the stack."""
    w = X.wide(spark, d, n)
    rows = w.select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(n // size - 1))).alias("ministack"), "re", "im")
    part = lambda c: F.slice(c, F.col("ministack") * size + 1, F.lit(size)).alias(c)
    datum = X.pixels(spark, d).select("y", "x", F.slice("e", 49, n // size).alias("re"), F.slice("e", 57, n // size).alias("im"))
    return rows.select("y", "x", "ministack", part("re"), part("im")), datum


@register(f"with {PX}, {st(24)}, j as (select y, x, band // 6 ms, band % 6 k, re, im, e[49 + band // 6] dr, e[57 + band // 6] di from st join px using (y, x)) select y, x, cast(ms as int) ministack, cast(k as int) k, {R('re*dr - im*di')} re, {R('re*di + im*dr')} im from j")
def p12_adjust_wrapped(spark, d):
    linked, datum = _linked(spark, d, 24, 6)
    return sequential.adjust_wrapped(linked, datum).select("y", "x", "ministack", "k", rnd("re").alias("re"), rnd("im").alias("im"))


@register(f"with {PX}, v as (select y, x, cast(k // 6 as int) ministack, cast(k as int) band, e[k+1] + e[49 + k // 6] phase from px, (select unnest(range(24)) k)), r as (select ministack, band, phase ref from v where y = 3 and x = 4) select y, x, ministack, band, {R('phase - ref')} phase from v join r using (ministack, band)")
def p13_adjust_unwrapped(spark, d):
    px = X.pixels(spark, d)
    phases = px.select("y", "x", F.posexplode(F.slice("e", 1, 24)).alias("band", "phase")).select("y", "x", F.floor(F.col("band") / 6).cast("int").alias("ministack"), "band", "phase")
    datum = px.select("y", "x", F.posexplode(F.slice("e", 49, 4)).alias("ministack", "phase"))
    return sequential.adjust_unwrapped(phases, datum, 3, 4).select("y", "x", "ministack", "band", rnd("phase").alias("phase"))


@register(f"with {PX}, {st()} select y, x, band, {R('atan2(im*e[1] - re*e[2], re*e[1] + im*e[2])')} phase from st join px using (y, x) where band > 0")
def p14_datum_difference(spark, d):
    rows = X.stack(spark, d).where("band > 0").join(X.pixels(spark, d).select("y", "x", "e"), ["y", "x"])
    return rows.select("y", "x", "band", rnd(sequential.datum_difference((F.col("re"), F.col("im")), (F.col("e")[0], F.col("e")[1]))).alias("phase"))


_BANDS = "b as (select cast(k as int) band, cast(date '2022-01-01' + cast(12 * k as integer) as date) date from (select unnest(range(32)) k))"


@register(f"with {_BANDS}, g as (select *, cast(band // 10 as int) ministack from b) select band, date, ministack, strftime(min(date) over (partition by ministack), '%Y%m%d') || '_' || strftime(max(date) over (partition by ministack), '%Y%m%d') as label from g")
def p15_ministack_assignment(spark, d):
    return sequential.assign_mini_stacks(X.bands(spark), 10).select("band", "date", "ministack", "label")


@register(f"with {PX}, {LABELS} select y, x, pair, {R('e[pair + 1] + 2*pi()*(lb.label - 3)')} phase from lb join px using (y, x)")
def p16_cycle_correction(spark, d):
    obs = X.pixels(spark, d).select("y", "x", F.posexplode(F.slice("e", 1, 4)).alias("pair", "phase"))
    u = X.labels(spark, d).select("y", "x", "pair", (F.col("label") - 3).alias("u"))
    return closure.corrected(obs, u).select("y", "x", "pair", rnd("phase").alias("phase"))


# ---- sources, subsets, sinks ---------------------------------------------------------------------------------------


@register(f"with {PX}, {st()}, r as (select band, re ref from st where y = 2 and x = 7) select y, x, band, {R('re - ref')} re from st join r using (band)")
def s5_reference_pixel(spark, d):
    return sequential.relative_to(X.stack(spark, d).select("y", "x", "band", "re"), "re", 2, 7, ["band"]).select("y", "x", "band", rnd("re").alias("re"))


@register(f"with {PX}, c as (select y, x, [e[49], e[50]] r, [e[57], e[58]] i, e from px) select y, x, cast(k as int) band, {R('case when k < 2 then r[k+1] else e[2*(k+8)+1] end')} re, {R('case when k < 2 then i[k+1] else e[2*(k+8)+2] end')} im from c, (select unnest(range(12)) k)")
def s6_ministack(spark, d):
    earlier = X.pixels(spark, d).select("y", "x", F.slice("e", 49, 2).alias("cre"), F.slice("e", 57, 2).alias("cim"))
    m = sequential.mini_stack(X.wide(spark, d), earlier, 10, 20)
    return m.select("y", "x", F.posexplode(F.arrays_zip("re", "im")).alias("band", "z")).select("y", "x", "band", rnd("z.re").alias("re"), rnd("z.im").alias("im"))


@register(f"with {PX}, {st()} select y, x, band, re, im from st where y between 3 and 12 and x between 5 and 16")
def s7_window(spark, d):
    return raster.subset(X.stack(spark, d), 3, 5, 10, 12)


_GEO = "g as (select y, x, 40.0 - 0.01 * y + 0.001 * x lat, 10.0 + 0.01 * x + 0.001 * y lon from px)"


@register(
    f"with {PX}, {_GEO}, a as (select y, x from g order by (lat-39.9)*(lat-39.9) + (lon-10.15)*(lon-10.15), y, x limit 1), b as (select y, x from g order by (lat-39.97)*(lat-39.97) + (lon-10.05)*(lon-10.05), y, x limit 1)"
    " select least(a.y, b.y) y0, least(a.x, b.x) x0, greatest(a.y, b.y) - least(a.y, b.y) + 1 as \"rows\", greatest(a.x, b.x) - least(a.x, b.x) + 1 cols from a, b"
)
def s8_geographic_window(spark, d):
    g = X.pixels(spark, d).select("y", "x", (40.0 - 0.01 * F.col("y") + 0.001 * F.col("x")).alias("lat"), (10.0 + 0.01 * F.col("x") + 0.001 * F.col("y")).alias("lon"))
    return raster.geographic_window(g, 39.9, 39.97, 10.05, 10.15)


def _scratch(spark, name: str) -> str:
    """A new folder of the shared checkpoint folder, for files that a query writes and reads."""
    checkpoint(spark.range(0).toDF("id"))
    return f"{spark.sparkContext.getCheckpointDir()}/scratch/{uuid4().hex}/{name}"


@register("select cast(date '2022-01-01' + cast(12*k as integer) as date) master, cast(date '2022-01-01' + cast(12*k + 12 as integer) as date) slave, 'i' || k || '.unw' unwrapped, 'i' || k || '.cor' coherence, 0.25::double threshold, case when k % 2 = 0 then 2.0 else 1.0 end::double scale from (select unnest(range(31)) k)")
def s9_pair_list(spark, d):
    day = lambda k: F.date_format(F.date_add(F.lit(X.FIRST), (k * X.STEP).cast("int")), "yyyyMMdd")
    name = lambda end: F.concat(F.lit("i"), "id", F.lit(end))
    rows = spark.range(31).select(day(F.col("id")).alias("Master Date"), day(F.col("id") + 1).alias("Slave Date"), name(".unw").alias("Unwrapped Interferogram"), name(".cor").alias("Coherence"), F.when(F.col("id") % 2 == 0, "2").alias("Scale"))
    path = _scratch(spark, "pairs.csv")
    rows.write.csv(path, header=True)
    return raster.read_pairs(spark, path, threshold=0.25)


@register(f"with {PX}, {st(4)} select y, x, band, re, im from st where band = 2")
def k1_raster_sink(spark, d):
    path = _scratch(spark, "stack")
    raster.write_raster(X.stack(spark, d, 4), path, "band")
    return spark.read.parquet(path).where("band = 2").select("y", "x", F.col("band").cast("int").alias("band"), "re", "im")


@register(f"with {PX}, {st()}, {_BANDS} select band, date, {R(f'avg({AMP})')} amp_const from st join b using (band) group by band, date")
def k2_annotated_bands(spark, d):
    return raster.with_constants(X.bands(spark), amplitude.calibrate(X.stack(spark, d))).select("band", "date", rnd("amp_const").alias("amp_const"))


@register(f"with {_BANDS} select date, 'unwrap -m snaphu -i ' || strftime(date, '%Y%m%d') || '.int -c tcorr.bin -o ' || strftime(date, '%Y%m%d') || '.unw' command from b")
def k4_unwrap_commands(spark, d):
    return scatterers.unwrap_commands(X.bands(spark).select("date"))


# ---- stencils ------------------------------------------------------------------------------------------------------


@register(f"with {PX} select a.y, a.x, b.y - a.y dy, b.x - a.x dx from px a join px b on b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 where a.vec_id <> b.vec_id")
def j2_neighbour_pairs(spark, d):
    return stencil.neighbour_pairs(X.pixels(spark, d).select("y", "x", "label"), 2, 2, half=False).select("y", "x", "dy", "dx")


# ---- amplitude -----------------------------------------------------------------------------------------------------


@register(f"with {PX}, {st()}, {MASK} select band, {R(f'coalesce(avg(case when mask > 0 and {AMP} <> 0 then {AMP} end), 1.0)')} amp_const, count(case when mask > 0 and {AMP} <> 0 then 1 end) n, floor(10000.0::double * count(case when mask > 0 and {AMP} <> 0 then 1 end) / count(*)) / 100.0 coverage from st join mk using (y, x) group by band")
def o1_o2_calamp(spark, d):
    return amplitude.calibrate(X.stack(spark, d), X.mask(spark, d)).select("band", rnd("amp_const").alias("amp_const"), "n", "coverage")


@register(f"with {PX}, {st()}, {DA} select y, x, n, {R('mean_amp')} mean_amp, {R('da')} da from da")
def o3_ampdispersion(spark, d):
    return amplitude.dispersion(X.stack(spark, d)).select("y", "x", "n", rnd("mean_amp").alias("mean_amp"), rnd("da").alias("da"))


# ---- neighbourhoods ------------------------------------------------------------------------------------------------

_NMAP = (
    f"with {PX}, {st()}, a as (select y*25 + x p, y, x, {AMP} * (1 + 0.2*label) v from st join px using (y, x)), q as (select distinct p, y, x from a),"
    " e as (select l.p, m.p q, m.y - l.y dy, m.x - l.x dx from q l join q m on m.y between l.y-2 and l.y+2 and m.x between l.x-2 and l.x+2 where l.p <> m.p),"
    " u as (select e.p, e.q, a.v, 1 s from e join a on a.p = e.p union all select e.p, e.q, a.v, -1 s from e join a on a.p = e.q),"
    " dd as (select p, q, max(abs(cs))/32.0::double d from (select p, q, sum(s) over (partition by p, q order by v range between unbounded preceding and current row) cs from u) group by p, q),"
    " z as (select p, q, d*4.0::double u from dd),"
    " pv as (select p, q, case when u < 0.2 then 1.0::double when u < 0.755 then 1 - 2.50662827*(exp(-1.2337005501361697/(u*u)) + exp(-11.103304951225528/(u*u)) + exp(-30.842513753404244/(u*u)))/u"
    " when u < 6.8116 then 2*(exp(-2*u*u) - case when round(3/u) > 1 then exp(-8*u*u) else 0 end + case when round(3/u) > 2 then exp(-18*u*u) else 0 end - case when round(3/u) > 3 then exp(-32*u*u) else 0 end) else 0 end pv from z),"
    " acc as (select e.*, pv from e join pv using (p, q) where pv >= 0.05), al as (select p, dy, dx from acc union all select p, 0, 0 from q)"
)


def _amps(spark, d):
    s = X.stack(spark, d).join(X.pixels(spark, d).select("y", "x", "label"), ["y", "x"])
    return neighbours.sorted_amplitudes(s.withColumn("amp", C.amplitude(F.col("re"), F.col("im")) * (1 + 0.2 * F.col("label"))))


@register(_NMAP + f" select p // 25 y, p % 25 x, dy, dx, {R('pv')} p from acc")
def o20_nmap_ks2_edges(spark, d):
    e = neighbours.neighbours(_amps(spark, d), 2, 2, 0.05).where("dy <> 0 or dx <> 0")
    return e.select("y", "x", "dy", "dx", rnd("p").alias("p"))


@register(_NMAP + " select p // 25 y, p % 25 x, cast(count(*) as int) n_neighbors from al group by p")
def o5_neighbour_count(spark, d):
    return neighbours.bit_masks(neighbours.neighbours(_amps(spark, d), 2, 2, 0.05), 2, 2).select("y", "x", "n_neighbors")


@register(_NMAP + " select p // 25 y, p % 25 x, bit_or(1::bigint << ((dy + 2)*5 + dx + 2)) word0 from al group by p")
def o6_bit_mask(spark, d):
    return neighbours.bit_masks(neighbours.neighbours(_amps(spark, d), 2, 2, 0.05), 2, 2).select("y", "x", F.col("mask")[0].alias("word0"))


_LABEL_WINDOW = f"with {PX}, {ed(4, 4)}"


@register(_LABEL_WINDOW + " select y, x, dy, dx from ed")
def o6b_mask_decode(spark, d):
    return neighbours.decode_masks(neighbours.bit_masks(X.edges(spark, d, 4, 4), 4, 4), 4, 4)


@register(_LABEL_WINDOW + " select y, x, cast(count(*) as int) bits from ed group by y, x")
def o7_popcount(spark, d):
    return neighbours.bit_masks(X.edges(spark, d, 4, 4), 4, 4).select("y", "x", neighbours.popcount(F.col("mask")).cast("int").alias("bits"))


def _pairs2(spark, d):
    """Each pixel with its right neighbour: samples for tests."""
    return stencil.neighbour_pairs(_amps(spark, d), 0, 1)


_SAMPLES = f"with {PX}, {st()}, a as (select y, x, {AMP} * (1 + 0.2*label) v from st join px using (y, x)), e as (select distinct a.y, a.x from a join px b on b.y = a.y and b.x = a.x + 1), u as (select e.y, e.x, a.v, 1 s from e join a on a.y = e.y and a.x = e.x union all select e.y, e.x, a.v, 0 from e join a on a.y = e.y and a.x = e.x + 1)"


@register(
    _SAMPLES
    + f", r as (select y, x, row_number() over (partition by y, x order by v, s) j, sum(s) over (partition by y, x order by v, s rows unbounded preceding) m from u), a2 as (select y, x, (sum(case when j < 64 then ((64.0*m - 32.0*j)*(64.0*m - 32.0*j) + (64.0*(j-m) - 32.0*j)*(64.0*(j-m) - 32.0*j)) / (j*(64.0-j)) end) / 32.0 / 64.0 - 1) / {stats.ad_sigma(32)!r} a2 from r group by y, x) select y, x, {R('a2')} a2 from a2"
)
def o20c_ad2_statistic(spark, d):
    p = _pairs2(spark, d)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                a, c = (np.asarray(b.column(i).flatten()).reshape(b.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stats.ad_statistic(a, c))], ["y", "x", "a2"])

    rows = p.select("y", "x", F.col("a.amps").alias("a"), F.col("b.amps").alias("b")).mapInArrow(run, "y int, x int, a2 double")
    return rows.select("y", "x", rnd("a2").alias("a2"))


@register()
def o20c_nmap_ad2(spark, d):
    return neighbours.neighbours(_amps(spark, d), 2, 2, 0.05, "AD2").select("y", "x", "dy", "dx", rnd("p").alias("p"))


_KSD = ", c as (select y, x, abs(sum(2*s-1) over (partition by y, x order by v range unbounded preceding)) a from u), k as (select y, x, max(a)/32.0::double d from c group by y, x)"
_LAM = "((4.0::double + 0.12 + 0.11/4.0) * d)"


@register(_SAMPLES + _KSD + f", l as (select y, x, {_LAM} l from k) select y, x, {R('greatest(0.0, least(1.0, list_sum(list_transform(range(1, 102), lambda j: 2 * power(-1.0::double, j - 1) * exp(-2*l*l*j*j)))))')} p from l")
def t9_ks_asymptotic(spark, d):
    return neighbours.probabilities(_pairs2(spark, d), "asymptotic").select("y", "x", rnd("p").alias("p"))


@register(_SAMPLES + _KSD + f" select y, x, {R('d')} d from k")
def o20a_ks_distance(spark, d):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                a, c = (np.asarray(b.column(i).flatten()).reshape(b.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stats.ks_distance(a, c))], ["y", "x", "d"])

    return _pairs2(spark, d).select("y", "x", F.col("a.amps").alias("a"), F.col("b.amps").alias("b")).mapInArrow(run, "y int, x int, d double").select("y", "x", rnd("d").alias("d"))


_KP = "case when u < 0.2 then 1.0::double when u < 0.755 then 1 - 2.50662827*(exp(-1.2337005501361697/(u*u)) + exp(-11.103304951225528/(u*u)) + exp(-30.842513753404244/(u*u)))/u when u < 6.8116 then 2*(exp(-2*u*u) - case when round(3/u) > 1 then exp(-8*u*u) else 0 end + case when round(3/u) > 2 then exp(-18*u*u) else 0 end - case when round(3/u) > 3 then exp(-32*u*u) else 0 end) else 0 end"


@register(f"with g as (select k, (k + 0.5) / 60.0::double u from (select unnest(range(450)) k)) select k, {R(_KP)} p from g")
def o20b_kolmogorov(spark, d):
    return spark.range(450).select(F.col("id").alias("k"), ((F.col("id") + 0.5) / 60.0).alias("u")).select("k", rnd(stats.kolmogorov_column(F.col("u"))).alias("p"))


# ---- despeckling and coherence -------------------------------------------------------------------------------------


def _band(spark, d, k):
    return X.pixels(spark, d).select("y", "x", F.col("e")[2 * k].alias("re"), F.col("e")[2 * k + 1].alias("im"))


_D = f"with {PX}, {ed()}, v as (select ed.y, ed.x, q.e[1] r1, q.e[2] i1, q.e[3] r2, q.e[4] i2 from ed join px q on q.y = qy and q.x = qx)"


@register(_D + f" select y, x, {R('avg(sqrt(r1*r1 + i1*i1))')} amp from v group by y, x")
def o8_despeckled_amplitude(spark, d):
    return despeckle.mean_amplitude(X.edges(spark, d), _band(spark, d, 0), 2, 2).select("y", "x", rnd("amp").alias("amp"))


@register(_D + f" select y, x, {R('avg(r1*r2 + i1*i2)')} re, {R('avg(i1*r2 - r1*i2)')} im from v group by y, x")
def o9_despeckled_interferogram(spark, d):
    return despeckle.interferogram(X.edges(spark, d), _band(spark, d, 0), _band(spark, d, 1), 2, 2).select("y", "x", rnd("re").alias("re"), rnd("im").alias("im"))


_COH = ", s as (select y, x, sum(r1*r2 + i1*i2) r, sum(i1*r2 - r1*i2) i, sqrt(sum(r1*r1 + i1*i1)) * sqrt(sum(r2*r2 + i2*i2)) n from v group by y, x)"


@register(_D + _COH + f" select y, x, {R('case when n > 0 then r/n else 0 end')} re, {R('case when n > 0 then i/n else 0 end')} im from s")
def o10_despeckled_coherence(spark, d):
    return despeckle.coherence(X.edges(spark, d), _band(spark, d, 0), _band(spark, d, 1), 2, 2).select("y", "x", rnd("re").alias("re"), rnd("im").alias("im"))


_MAT = (
    f"with {PX}, {ed()}, v as (select ed.y, ed.x, q.e from ed join px q on q.y = qy and q.x = qx), t as (select y, x, cast(i as int) ti, cast(j as int) tj, e[2*i+1] r1, e[2*i+2] i1, e[2*j+1] r2, e[2*j+2] i2 from v, (select unnest(range(32)) i), (select unnest(range(32)) j) where i < j),"
    " s as (select y, x, ti, tj, count(*) n, sum(r1*r2 + i1*i2) r, sum(i1*r2 - r1*i2) i, sqrt(sum(r1*r1 + i1*i1) * sum(r2*r2 + i2*i2)) p from t group by y, x, ti, tj)"
)


@register(_MAT + f" select y, x, n, ti, tj, {R('r/p')} re, {R('i/p')} im from s")
def o11_j8_coherence_matrix(spark, d):
    return despeckle.coherence_matrix(X.edges(spark, d), X.wide(spark, d, 32), 2, 2).select("y", "x", "n", "ti", "tj", rnd("re").alias("re"), rnd("im").alias("im"))


@register(_MAT + f" select y, x, n, ti, tj, {R('r/p')} re, {R('i/p')} im from s where y = 5 and x = 7")
def o49_pixel_matrix(spark, d):
    return despeckle.pixel_matrix(X.edges(spark, d), X.wide(spark, d, 32), 5, 7, 2, 2).select("y", "x", "n", "ti", "tj", rnd("re").alias("re"), rnd("im").alias("im"))


# ---- phase linking -------------------------------------------------------------------------------------------------

_TWO = (
    _D + ", c as (select y, x, count(*) n, atan2(sum(i1*r2 - r1*i2), sum(r1*r2 + i1*i2)) a from v group by y, x),"
    " l as (select c.y, c.x, n >= 2 ok, cos(-a) lr, sin(-a) li, e from c join px using (y, x))"
    f" select y, x, case when ok then 1.0 else 0.0 end::double tcorr, {R('case when ok then lr else 0 end')} re1, {R('case when ok then li else 0 end')} im1,"
    f" {R('case when ok then (e[1] + e[3]*lr + e[4]*li)/2 else 0 end')} comp_re, {R('case when ok then (e[2] + e[4]*lr - e[3]*li)/2 else 0 end')} comp_im from l"
)


def _link(spark, d, n, method, **options):
    masks = neighbours.bit_masks(X.edges(spark, d), 2, 2)
    return phaselink.phase_link(X.wide(spark, d, n), masks, 2, 2, method, **options)


def _two(method):
    def run(spark, d):
        out = _link(spark, d, 2, method, min_neighbors=2)
        return out.select("y", "x", rnd("tcorr").alias("tcorr"), rnd(F.col("re")[1]).alias("re1"), rnd(F.col("im")[1]).alias("im1"), rnd("comp_re").alias("comp_re"), rnd("comp_im").alias("comp_im"))

    return run


for _id, _method in (("o21_o15_o25_evd_two_epochs", "EVD"), ("o23_mle_two_epochs", "MLE"), ("o24_robust_two_epochs", "phase_link")):
    register(_TWO, _id)(_two(_method))


def _many(n, method, **options):
    def run(spark, d):
        return _link(spark, d, n, method, **options).select("y", "x", rnd("tcorr", 4).alias("tcorr"), F.transform("re", lambda v: F.round(v, 4)).alias("re"), F.transform("im", lambda v: F.round(v, 4)).alias("im"))

    return run


register(name="o21_o16_evd")(_many(32, "EVD"))
register(name="o22_stbas")(_many(32, "STBAS", bandwidth=4))
register(name="o23_mle")(_many(8, "MLE"))
register(name="o23_mle_rank_deficient")(_many(16, "MLE"))
register(name="o24_phase_link_robust")(_many(32, "phase_link"))
register(name="t1_iterative_mle")(_many(8, "iterative"))


@register()
def o49b_matrix_diagnostics(spark, d):
    out = _link(spark, d, 32, "EVD", diagnostics=True)
    return out.select("y", "x", *[rnd(c, 4).alias(c) for c in out.columns[2:]])


@register()
def o26_sequential(spark, d):
    masks = neighbours.bit_masks(X.edges(spark, d), 2, 2)
    own, _ = sequential.sequential(X.wide(spark, d, 32), masks, 32, 8, 2, 2, "EVD")
    return own.select("y", "x", "ministack", rnd("tcorr", 4).alias("tcorr"))


@register()
def t5_sequential_overlap(spark, d):
    masks = neighbours.bit_masks(X.edges(spark, d), 2, 2)
    out = sequential.sequential_overlap(X.wide(spark, d, 32), masks, 32, 8, 2, 2, "EVD")
    return out.select("y", "x", rnd("tcorr", 4).alias("tcorr"), F.transform("re", lambda v: F.round(v, 4)).alias("re"))


# ---- small baselines -----------------------------------------------------------------------------------------------

_PAIRS = [(i, i + s) for i in range(8) for s in (1, 2) if i + s < 8]
_PAIR_DATES = [(X.DATES[a], X.DATES[b]) for a, b in _PAIRS]
_J, _J_DATES = sbas.incidence(_PAIR_DATES, X.DATES[0])
_JI = np.linalg.pinv(_J)
_G = sbas.trend_matrix(_J_DATES, X.DATES[0])
_GI = np.linalg.pinv(_G)
_NP = len(_PAIRS)


def _obs(spark, d):
    """Long observations of the pairs with a coherence."""
    px = X.pixels(spark, d).select("y", "x", "vec_id", F.posexplode(F.slice("e", 1, _NP)).alias("pair", "v"))
    return px.select("y", "x", "pair", (F.col("v") * 3).alias("phase"), ((F.col("vec_id") * 31 + F.col("pair") * 17) % 100 / 100.0).alias("coh"))


_OBS = f"ob as (select y, x, cast(p as int) pair, e[p+1]*3 phase, ((vec_id*31 + p*17) % 100) / 100.0::double coh from px, (select unnest(range({_NP})) p))"
_ARR = f"ar as (select y, x, list_transform(e[1:{_NP}], lambda v: v*3) phi from px)"
_TS = f"ts as (select y, x, phi, [{', '.join(f'list_dot_product({num(r)}, phi)' for r in _JI)}] ts from ar)"


@register(f"with {PX}, {_OBS} select pair, {R('avg(case when y between 2 and 11 and x between 3 and 14 and coh > 0.2 then phase end)')} as \"offset\" from ob group by pair")
def o12_reference_offset(spark, d):
    return sbas.reference_offsets(_obs(spark, d), (2, 3, 10, 12), 0.2).select("pair", rnd("offset").alias("offset"))


def _inverted(spark, d):
    return sbas.invert(sbas.pair_arrays(_obs(spark, d), _NP), _PAIR_DATES, X.DATES[0])


@register(f"with {PX}, {_ARR}, {_TS} select y, x, cast(k as int) epoch, {R('case when k = 0 then 0 else ts[k] end')} value from ts, (select unnest(range(8)) k)")
def o27_sbas_inversion(spark, d):
    out = sbas.with_reference_epoch(_inverted(spark, d), _PAIR_DATES, X.DATES[0])
    return out.select("y", "x", (F.datediff("date", F.lit(X.DATES[0])) / 12).cast("int").alias("epoch"), rnd("value").alias("value"))


@register(f"with {PX}, {_ARR}, {_TS} select y, x, {R(f'list_dot_product({num(_GI[1])}, ts)')} velocity from ts")
def o28_velocity(spark, d):
    return _inverted(spark, d).select("y", "x", rnd("velocity").alias("velocity"))


_RES = f"list_transform(list_zip(phi, [{', '.join(f'list_dot_product({num(r)}, ts)' for r in _J)}]), lambda z: z[1] - z[2])"


@register(f"with {PX}, {_ARR}, {_TS}, r as (select y, x, {_RES} r from ts) select y, x, {R(f'sqrt(power(list_sum(list_transform(r, lambda v: cos(v))), 2) + power(list_sum(list_transform(r, lambda v: sin(v))), 2)) / {_NP}')} tcorr from r")
def o17_network_coherence(spark, d):
    return _inverted(spark, d).select("y", "x", rnd("tcorr").alias("tcorr"))


_BASE = [float((k * 37) % 41 - 20) * 20 - float((0 * 37) % 41 - 20) * 20 for k in range(1, 8)]
_C = (np.eye(7) - _G @ _GI) @ np.array(_BASE)
_Q = float(_C @ np.array(_BASE))


@register(f"with {PX}, {_ARR}, {_TS}, f as (select *, 4*pi() / (0.056 * {SLANT} * sin(radians({INC}))) f from ts) select y, x, {R(f'list_dot_product({num(_C)}, ts) / {_Q!r} / f', 4)} zerr, {R(f'list_dot_product({num(_GI[1])}, ts) - list_dot_product({num(_GI[1])}, {num(_BASE)}) * list_dot_product({num(_C)}, ts) / {_Q!r}')} velocity from f")
def o29_height_error(spark, d):
    out = sbas.height_error(_inverted(spark, d), _BASE, _J_DATES, X.DATES[0], 0.056, X.slant(F.col("x")), X.incidence(F.col("x")))
    return out.select("y", "x", rnd("zerr", 4).alias("zerr"), rnd("velocity").alias("velocity"))


@register("select cast(t1 as int) as ref, cast(t2 as int) follower, cast(m.k as int) k from (values " + ", ".join(f"({a},{b})" for a, b in _PAIRS) + ") p(t1, t2), (select unnest(range(8)) k) m where k = t1 or k = t2")
def j4_epoch_lookup(spark, d):
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_PAIRS)], "pair int, ref int, follower int")
    k = closure.epochs_table(pairs)
    return pairs.join(F.broadcast(k), (F.col("epoch") == F.col("ref")) | (F.col("epoch") == F.col("follower"))).select("ref", "follower", F.col("k").cast("int").alias("k"))


# ---- grid search ---------------------------------------------------------------------------------------------------


def _topo(spark, d):
    z = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(F.col("e")[2 * i].alias("re"), F.col("e")[2 * i + 1].alias("im"), X.bperp(i).alias("bperp")))
    return X.pixels(spark, d).select("y", "x", z.alias("z"))


_TOPO = (
    f"with {PX}, {st(12)}, k as (select y, x, 4*pi() / (0.056 * {SLANT} * sin(radians({INC}))) k from px), v as (select y, x, k, re, im, {BPERP} b from st join k using (y, x)),"
    " s as (select y, x, k, i, sum(re*cos(k*h*b) - im*sin(k*h*b)) r, sum(re*sin(k*h*b) + im*cos(k*h*b)) m, sum(sqrt(re*re + im*im)) a, any_value(h) h from v, (select i, i * 0.1::double - 20.0::double h from (select unnest(range(401)) i)) group by y, x, k, i),"
    " c as (select y, x, k, h from (select *, row_number() over (partition by y, x order by sqrt(r*r + m*m)/a desc, i) pos from s) where pos = 1),"
    " s2 as (select v.y, v.x, v.k, i, any_value(c.h + (i - 10)*0.01::double) h, sum(re*cos(v.k*(c.h + (i - 10)*0.01::double)*b) - im*sin(v.k*(c.h + (i - 10)*0.01::double)*b)) r, sum(re*sin(v.k*(c.h + (i - 10)*0.01::double)*b) + im*cos(v.k*(c.h + (i - 10)*0.01::double)*b)) m, sum(sqrt(re*re + im*im)) a from v join c using (y, x), (select unnest(range(21)) i) group by v.y, v.x, v.k, i),"
    " f as (select *, sqrt(r*r + m*m)/a coh from (select *, row_number() over (partition by y, x order by sqrt(r*r + m*m)/a desc, i) pos from s2) where pos = 1)"
)


@register(_TOPO + f" select y, x, {R('coh')} coh from f")
def o30_topofit(spark, d):
    out = topo.topofit(_topo(spark, d), topo.height_factor(0.056, X.slant(F.col("x")), X.incidence(F.col("x"))))
    return out.select("y", "x", rnd("coh").alias("coh"))


@register(_TOPO + f" select y, x, {R('h', 4)} dz, {R('coh')} coh from f")
def o31_toporesidual(spark, d):
    out = topo.topo_residual(_topo(spark, d), 0.056, X.slant(F.col("x")), X.incidence(F.col("x")))
    return out.select("y", "x", rnd("dz", 4).alias("dz"), rnd("coh").alias("coh"))


@register()
def t6_grid_search_2d(spark, d):
    k = 4 * pi / 0.056
    z = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(F.col("e")[2 * i].alias("re"), F.col("e")[2 * i + 1].alias("im"), (X.bperp(i) * (k / 850e3 / np.sin(np.radians(34)))).alias("kb"), (i * (12 / 365.25 * k)).alias("kt")))
    out = topo.grid_search_2d(X.pixels(spark, d).select("y", "x", z.alias("z")))
    return out.select("y", "x", rnd("coh", 4).alias("coh"))


# ---- regression ----------------------------------------------------------------------------------------------------

_T = sbas.years(X.DATES, X.DATES[0])
_EVENT = float(_T[16])
_SER = "se as (select y, x, e[1:32] ts, (vec_id * 31 % 100) / 100.0::double tcorr from px)"


def _series(spark, d):
    return X.pixels(spark, d).select("y", "x", F.slice("e", 1, 32).alias("ts"), (F.col("vec_id") * 31 % 100 / 100.0).alias("tcorr"))


def _model_sql(g: np.ndarray) -> str:
    gi = np.linalg.pinv(g)
    return f"with {PX}, {_SER} select y, x, cast(i as int) i, " + R(f"list_dot_product(([{', '.join(num(r) for r in gi)}])[i+1], ts)") + f" m from se, (select unnest(range({len(gi)})) i)"


def _fitted(g):
    def run(spark, d):
        out = fit.fit(_series(spark, d), g).select("y", "x", F.posexplode("model").alias("i", "m"))
        return out.select("y", "x", "i", rnd("m").alias("m"))

    return run


_L = fit.model_matrix("linear", _T)
register(
    f"with {PX}, r as (select y, x, regr_intercept(v, t) a, regr_slope(v, t) b from (select y, x, unnest(e[1:32]) v, unnest({num(_T)}) t from px) group by y, x) select y, x, cast(i as int) i, {R('case when i = 0 then a else b end')} m from r, (select unnest(range(2)) i)",
    "o32_fit_linear",
)(_fitted(_L))
for _id, _g in (
    ("o32_fit_linear_seasonal", fit.model_matrix("linear_seasonal", _T)),
    ("o32_fit_linear_coseismic", fit.model_matrix("linear_coseismic", _T, _EVENT)),
    ("o32_fit_linear_coseismic_postseismic", fit.model_matrix("linear_coseismic_postseismic", _T, _EVENT, 0.08)),
    ("o33_fit_functions", timefn.TimeFunction("2022-01-01").add_polynomial(2).add_heaviside(["2022-07-12"]).add_periodic([180.0]).functions.matrix(X.DATES)),
):
    register(_model_sql(_g), _id)(_fitted(_g))


def _hat(tau: float) -> np.ndarray:
    g = fit.model_matrix("linear_coseismic_postseismic", _T, _EVENT, tau)
    return g @ np.linalg.pinv(g)


def _rmse_sql(h: np.ndarray) -> str:
    return f"sqrt(list_sum(list_transform(list_zip(ts, [{', '.join(f'list_dot_product({num(r)}, ts)' for r in h)}]), lambda z: (z[1] - z[2])*(z[1] - z[2]))) / 32)"


@register(f"with {PX}, {_SER} select {R(f'coalesce(avg(case when tcorr > 0.5 then {_rmse_sql(_L @ np.linalg.pinv(_L))} end), 1e6)')} mean_rmse from se")
def o18_mean_rmse(spark, d):
    return fit.mean_rmse(fit.fit(_series(spark, d), _L), 0.5).select(rnd("mean_rmse").alias("mean_rmse"))


@register(" union all ".join(f"select {R(str(tau) + '::double')} tau, {R(f'avg(case when tcorr > 0.5 then {_rmse_sql(_hat(tau))} end)')} mean_rmse from (with {PX}, {_SER} select * from se)" for tau in fit.TAUS))
def o34_tau_search(spark, d):
    return fit.search_tau(_series(spark, d), _T, _EVENT, 0.5).select(rnd("tau").alias("tau"), rnd("mean_rmse").alias("mean_rmse"))


@register()
def o35_nonlinear_fit(spark, d):
    out = fit.fit_nonlinear(_series(spark, d), _T, _EVENT)
    return out.select("y", "x", *[rnd(c, 4).alias(c) for c in ("offset", "rate", "step", "rmse")])


# ---- closures, ambiguities, regions --------------------------------------------------------------------------------

_NET = [(i, i + s) for i in range(5) for s in (1, 2) if i + s < 5]
_NETSQL = "nt as (select * from (values " + ", ".join(f"({k},{a},{b})" for k, (a, b) in enumerate(_NET)) + ") v(pair, ref, follower))"


def _net(spark):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(_NET)], "pair int, ref int, follower int")


@register(f"with {_NETSQL} select pair, e epoch, w from (select pair, ref e, -1 w from nt union all select pair, follower, 1 from nt) where e <> 0")
def o36_time_series_matrix(spark, d):
    return closure.time_series_matrix(_net(spark))


@register(f"with {_NETSQL} select pair, cast(k as int) k, 1 w from nt, (select unnest(range(5)) k) where k >= ref and k < follower")
def o37_differential_matrix(spark, d):
    return closure.differential_matrix(_net(spark)).select("pair", F.col("k").cast("int").alias("k"), "w")


_TRI = "tr as (select a.pair p12, b.pair p13, c.pair p23 from nt a join nt b on a.ref = b.ref join nt c on c.ref = a.follower and c.follower = b.follower)"


@register(f"with {_NETSQL}, {_TRI} select p12, p13, p23 from tr")
def o38_j6_triplets(spark, d):
    return closure.triplets(_net(spark))


def _net_obs(spark, d):
    px = X.pixels(spark, d).select("y", "x", F.posexplode(F.slice("e", 1, len(_NET))).alias("pair", "v"))
    cycles = F.when((F.col("pair") == 2) & (F.col("x") > 12), 1).otherwise(0)
    signal = F.array(*[F.lit(float(b - a)) for a, b in _NET])[F.col("pair")]
    return px.select("y", "x", "pair", (signal * 0.7 + F.col("v") * 0.01 + 2 * pi * cycles).alias("phase"))


_NETOBS = f"no as (select y, x, cast(p as int) pair, ({num(b - a for a, b in _NET)})[p+1] * 0.7 + e[p+1]*0.01 + 2*pi()*case when p = 2 and x > 12 then 1 else 0 end phase from px, (select unnest(range({len(_NET)})) p))"


@register(f"with {PX}, {_NETSQL}, {_TRI}, {_NETOBS} select a.y, a.x, p12, p13, p23, {R('a.phase - b.phase + c.phase')} closure from tr join no a on a.pair = p12 join no b on b.pair = p13 and b.y = a.y and b.x = a.x join no c on c.pair = p23 and c.y = a.y and c.x = a.x")
def o39_closure_phase(spark, d):
    out = closure.closure_phases(_net_obs(spark, d), closure.triplets(_net(spark)))
    return out.select("y", "x", "p12", "p13", "p23", rnd("closure").alias("closure"))


_GT = closure.triplet_matrix(_NET)
_LOOPS = [tuple(int(np.flatnonzero(r)[k]) for k in range(3)) for r in _GT]
_GTI = np.linalg.pinv(-2 * pi * _GT)


def _regions(spark, d):
    return X.pixels(spark, d).select("y", "x", F.when(F.col("x") > 12, 1).otherwise(0).cast("long").alias("region"))


def _ambiguities(spark, d):
    at = spark.createDataFrame([(k, *r) for k, r in enumerate(_loops())], "loop int, p12 int, p13 int, p23 int")
    c = closure.closure_phases(_net_obs(spark, d), closure.triplets(_net(spark))).join(F.broadcast(at), ["p12", "p13", "p23"])
    return closure.ambiguities(spark, c.select("y", "x", "loop", "closure"), _regions(spark, d), _GT)


def _loops() -> list[tuple[int, int, int]]:
    """p12, p13, p23 of each row of the triplet matrix."""
    return [(int(np.flatnonzero(r == 1)[0]), int(np.flatnonzero(r == -1)[0]), int(np.flatnonzero(r == 1)[1])) for r in _GT]


_AMB = (
    f"with {PX}, {_NETOBS}, rg as (select y, x, case when x > 12 then 1 else 0 end region from px), f as (select * from (select *, row_number() over (partition by region order by y, x) k from rg) where k <= 20),"
    " m as (" + " union all ".join(f"select region, {k} l, avg(a.phase - b.phase + c.phase) c from f join no a on a.y = f.y and a.x = f.x and a.pair = {p} join no b on b.y = f.y and b.x = f.x and b.pair = {q} join no c on c.y = f.y and c.x = f.x and c.pair = {r} group by region" for k, (p, q, r) in enumerate(_loops())) + "),"
    f" w as (select * from (values {', '.join(f'({p},{k},{_GTI[p, k]!r}::double)' for p in range(_GTI.shape[0]) for k in range(_GTI.shape[1]))}) v(pair, l, w)),"
    " am as (select region, pair, cast(round_even(round(sum(w*c), 9), 0) as int) u from m join w using (l) group by region, pair)"
).replace("np.float64(", "(")


@register(_AMB + " select cast(region as bigint) region, pair, u from am")
def o40_ambiguities(spark, d):
    u = _ambiguities(spark, d)
    every = _regions(spark, d).select("region").distinct().crossJoin(F.broadcast(spark.range(len(_NET)).select(F.col("id").cast("int").alias("pair"))))
    return every.join(u, ["region", "pair"], "left").select("region", "pair", F.coalesce("u", F.lit(0)).alias("u"))


@register(f"with {PX}, {LABELS} select y, x, cast(min(case when label <> 0 then 1 else 0 end) as int) mask from lb group by y, x")
def o13_common_mask(spark, d):
    return closure.common_mask(X.labels(spark, d))


@register(
    f"with recursive {PX}, {LABELS}, mk as (select y, x, min(case when label <> 0 then 1 else 0 end) m from lb group by y, x), n as (select y, x, y*25 + x id from mk where m = 1),"
    " r as (select id, id root from n union select r.id, q.id from r join n p on p.id = r.root join n q on abs(q.y - p.y) <= 1 and abs(q.x - p.x) <= 1 and q.id <> p.id)"
    " select n.y, n.x, cast(min(root) as bigint) region from r join n on n.id = r.id group by n.y, n.x"
)
def o41_regions(spark, d):
    return closure.label_regions(closure.common_mask(X.labels(spark, d)), 25)


@register(f"with {PX}, {LABELS} select distinct pair, label, cast(x > 12 as int)::bigint region from lb where label <> 0")
def j7_region_overlap(spark, d):
    return closure.region_overlap(X.labels(spark, d), _regions(spark, d))


_RU = "ru as (select 0::bigint region, p pair, p - 1 u from (select unnest(range(4)) p) union all select 1, p, 3*p from (select unnest(range(4)) p))"


@register(f"with {PX}, {LABELS}, {_RU}, ov as (select distinct pair, label, cast(x > 12 as int)::bigint region from lb where label <> 0), m as (select pair, label, cast(round_even(median(u), 0) as int) u from ov join ru using (region, pair) group by pair, label) select y, x, pair, coalesce(u, 0) u from lb left join m using (pair, label)")
def o14_assign_ambiguities(spark, d):
    u = spark.range(4).select(F.lit(0).cast("long").alias("region"), F.col("id").cast("int").alias("pair"), (F.col("id") - 1).cast("int").alias("u")).unionByName(spark.range(4).select(F.lit(1).cast("long").alias("region"), F.col("id").cast("int").alias("pair"), (3 * F.col("id")).cast("int").alias("u")))
    return closure.assign_ambiguities(X.labels(spark, d), _regions(spark, d), u)


# ---- networks ------------------------------------------------------------------------------------------------------


def _scenes(spark):
    return X.bands(spark).select("date", X.bperp(F.col("band")).alias("bperp"))


_SC = f"{_BANDS}, sc as (select date, {BPERP} bperp from b)"


@register(f"with {_BANDS} select a.date as ref, c.date follower from b a, b c where a.band = 0 and c.band > 0")
def o42_single_master(spark, d):
    return network.single_master(_scenes(spark))


_GC = "1 - 2*abs(a.bperp - c.bperp)*5.0*power(cos(radians(34.0::double)), 2)/0.056/850000.0"


@register(f"with {_SC} select a.date as ref, c.date follower, {R(f'greatest({_GC}, 0.001::double)')} coh from sc a join sc c on a.date < c.date")
def o43_geometrical_coherence(spark, d):
    return network.geometrical_coherence(_scenes(spark), 0.056, 850000.0, 5.0, 34.0).select("ref", "follower", rnd("coh").alias("coh"))


@register()
def o44_spanning_trees(spark, d):
    pairs = [tuple(r) for r in network.geometrical_coherence(_scenes(spark), 0.056, 850000.0, 5.0, 34.0).collect()]
    return network.spanning_trees(spark, pairs, 2)


@register(f"with {_SC} select a.date as ref, c.date follower from sc a join sc c on a.date < c.date and datediff('day', a.date, c.date) <= 60 and abs(a.bperp - c.bperp) <= 150")
def o45_small_baseline(spark, d):
    return network.small_baseline(_scenes(spark), 60, 150.0)


# ---- filter, unwrapping in time, simulators ------------------------------------------------------------------------


@register()
def o47_adaptive_filter(spark, d):
    return spectral.adaptive_filter(_band(spark, d, 0)).select("y", "x", rnd("re", 4).alias("re"), rnd("im", 4).alias("im"))


@register(f"with {PX}, {st()}, p as (select y, x, band, atan2(im, re) f from st), s as (select *, f - lag(f) over w d from p window w as (partition by y, x order by band)), t as (select *, d - 2*pi()*round_even(d/(2*pi()), 0) e from s) select y, x, band, {R('first_value(f) over w + sum(coalesce(e, 0)) over w')} phase from t window w as (partition by y, x order by band)")
def o48_unwrap_in_time(spark, d):
    p = X.stack(spark, d).select("y", "x", "band", C.phase(F.col("re"), F.col("im")).alias("phase"))
    return scatterers.unwrap_in_time(p).select("y", "x", "band", rnd("phase").alias("phase"))


@register()
def t2_t3_simulated_stack(spark, d):
    t = np.arange(0, 120, 12.0)
    c = simulate.exponential(t, 0.999, 72.0, 0.99)
    return simulate.stack(spark, c, 6, 6, 5).select("y", "x", F.transform("re", lambda v: F.round(v, 6)).alias("re"))


@register()
def t4_cramer_rao(spark, d):
    t = np.arange(0, 120, 12.0)
    bound = simulate.cramer_rao(simulate.exponential(t, 0.9, 50.0), 121)
    return spark.createDataFrame([(i + 1, round(float(v), 6)) for i, v in enumerate(bound)], "epoch int, bound double")


# ---- time functions ------------------------------------------------------------------------------------------------

_TN = "(date_diff('day', date '2022-03-02', date))::double"


def _basis(text: str):
    def run(spark, d):
        fns = timefn.parse(text)
        cols = F.array(*[f.column(F.col("date")) for f in fns])
        rows = X.bands(spark).select("band", F.posexplode(cols).alias("i", "v"))
        return rows.select("band", "i", F.when(F.abs("v") == float("inf"), F.lit(-1e9)).otherwise(rnd("v")).alias("v"))

    return run


def _basis_sql(*exprs: str) -> str:
    return f"with {_BANDS} select band, cast(i as int) i, case when abs(v) = 'inf'::double then -1e9::double else {R('v')} end v from (" + " union all ".join(f"select band, {i} i, ({e})::double v from b" for i, e in enumerate(exprs)) + ")"


def _spline_sql(x: str, n: int, p: int, factor: str) -> str:
    from math import comb

    terms = [f"{(-1) ** k * comb(n + 1, k)} * (case when {x} - {k} - {(n + 1) / 2} >= 0 then power({x} - {k} - {(n + 1) / 2}, {p}) else 0 end)" for k in range(n + 2)]
    return f"({' + '.join(terms)}) * {factor}"


_LOGT = f"case when {_TN} = 0 then '-inf'::double else ln(abs({_TN}/40)) end"
_SET = [f"({_TN.replace('2022-03-02', '2022-01-01')} - {k * 60})" for k in range(4)]
_ACTIVE = "case when date between date '2022-01-01' and date '2022-06-30' then {} else 0 end"
for _id, _text, _exprs in (
    ("f1_constant", "constant(tmin=2022-03-02,tmax=2022-06-30)", ["case when date between date '2022-03-02' and date '2022-06-30' then 1 else 0 end"]),
    ("f2_power", "power(tref=2022-03-02,exp=2,tau=40)", [f"power({_TN}/40, 2)"]),
    ("f3_f6_powers", "linear(tref=2022-03-02);quadratic(tref=2022-03-02,tau=40);cubic(tref=2022-03-02,tau=40);quartic(tref=2022-03-02,tau=40)", [_TN, f"power({_TN}/40,2)", f"power({_TN}/40,3)", f"power({_TN}/40,4)"]),
    ("f7_log", "log(tref=2022-03-02,tau=40)", [_LOGT]),
    ("f8_f9_log10_log2", "log10(tref=2022-03-02,tau=40);log2(tref=2022-03-02,tau=40)", [f"({_LOGT})/ln(10)", f"({_LOGT})/ln(2)"]),
    ("f10_geolog", "geolog(tref=2022-03-02,tau=40)", [f"case when {_TN} >= 0 then ln(1 + abs({_TN}/40)) else 0 end"]),
    ("f11_f13_exp", "exp(tref=2022-03-02,tau=40);exp10(tref=2022-03-02,tau=90);exp2(tref=2022-03-02,tau=40)", [f"exp(-{_TN}/40)", f"exp(-ln(10)*{_TN}/90)", f"exp(-ln(2)*{_TN}/40)"]),
    ("f14_f15_cos_sin", "cos(tref=2022-03-02,period=180);sin(tref=2022-03-02,period=180)", [f"cos(2*pi()*{_TN}/180)", f"sin(2*pi()*{_TN}/180)"]),
    ("f16_arctan", "arctan(tref=2022-03-02,period=60)", [f"atan({_TN}/60)"]),
    ("f17_bspline", "bspline(tref=2022-03-02,scale=50,order=3)", [_spline_sql(f"({_TN}/50 + 4)", 3, 3, "1/6.0::double")]),
    ("f18_ispline", "ispline(tref=2022-03-02,scale=50,order=3)", [_spline_sql(f"({_TN}/50 + 4)", 3, 4, "50/(4*6.0::double)")]),
    ("f19_pbspline", "pbspline(tref=2022-03-02,scale=30,order=3,period=120,offset=10)", [_spline_sql(f"((({_TN}-10) - 120*round_even(({_TN}-10)/120, 0))/30 + 4)", 3, 3, "1/6.0::double")]),
    ("f20_poly", "poly(order=2,tref=2022-03-02,minorder=0)", ["1", _TN, f"power({_TN},2)"]),
    ("f21_periodic", "[periodic(period=90,tref='2022-03-02')]", [f"cos(2*pi()*{_TN}/90)", f"sin(2*pi()*{_TN}/90)"]),
    ("f22_bspline_set", "bsplineset(tmin=2022-01-01,tmax=2022-06-30,num=4,order=3)", [_ACTIVE.format(_spline_sql(f"({t}/60 + 4)", 3, 3, "1/6.0::double")) for t in _SET]),
    ("f23_ispline_set", "ISplineSet(tmin=2022-01-01,tmax=2022-06-30,num=4,order=3)", [_ACTIVE.format(_spline_sql(f"({t}/60 + 4)", 3, 4, "60/(4*6.0::double)")) for t in _SET]),
    ("f24_pbspline_set", "pbsplineset(tmin=2022-01-01,tmax=2022-06-30,num=4,order=3,period=150)", [_ACTIVE.format(_spline_sql(f"(({t} - 150*round_even({t}/150, 0))/60 + 4)", 3, 3, "1/6.0::double")) for t in _SET]),
    ("f25_f26_collection", "[Linear(tref=2022-03-02,units=days);Constant();Sin(tref=2022-03-02,period=180)]", [_TN, "1", f"sin(2*pi()*{_TN}/180)"]),
):
    register(_basis_sql(*_exprs), _id)(_basis(_text))


_TYPED = "constant();linear(tref=2022-01-01);quadratic(tref=2022-01-01);cos(tref=2022-01-01,period=365.25);sin(tref=2022-01-01,period=180);geolog(tref=2022-02-01,tau=10);bspline(tref=2022-03-02,scale=50,order=3);ispline(tref=2022-03-02,scale=40,order=3);pbspline(tref=2022-03-02,scale=30,order=3,period=120)"


@register(
    f"with {_BANDS}, f as (select i - 1 as i, regexp_extract(t, '^[a-z]+') as name, regexp_extract(t, 'period=([0-9.]+)', 1) as period, regexp_extract(t, 'scale=([0-9.]+)', 1) as scale from (select unnest(string_split('{_TYPED}', ';')) t, unnest(range(1, 100)) i) where t is not null), "
    "s as (select abs(date_diff('day', min(date), max(date))) / 365.0::double as span from b) "
    "select cast(i as int) i, case when name in ('constant', 'linear') then 'secular' when name in ('cos', 'sin', 'bspline') then 'seasonal' when name = 'ispline' then 'transient' end as kind, name in ('bspline', 'ispline') as regularised, "
    + R("case when name in ('constant', 'linear') then span when name in ('cos', 'sin') then try_cast(period as double) when name in ('bspline', 'ispline') then try_cast(scale as double) end")
    + " as timescale from f, s"
)
def f27_function_types(spark, d):
    fns = timefn.parse(_TYPED)
    kinds = timefn.function_types(fns)
    first, last = X.bands(spark).agg(F.min("date"), F.max("date")).first()
    named = {i: kind for kind in ("secular", "seasonal", "transient", "step") for i in kinds[kind]}
    rows = [(i, named.get(i), i in kinds["reg"], s) for i, s in enumerate(timefn.timescales(fns, [first, last]))]
    df = spark.createDataFrame(rows, "i int, kind string, regularised boolean, timescale double")
    return df.withColumn("timescale", rnd(F.nanvl("timescale", F.lit(None).cast("double"))))


@register(_basis_sql("case when date >= date '2022-03-02' then 1 else 0 end", f"cos(2*pi()*{_TN}/90)", f"sin(2*pi()*{_TN}/90)", f"case when {_TN} >= 0 then ln(1 + abs({_TN}/40)) else 0 end", _TN, f"power({_TN},2)"))
def f28_time_function_builder(spark, d):
    fns = timefn.TimeFunction("2022-03-02").add_heaviside(["2022-03-02"]).add_periodic([90]).add_post_seismic(["2022-03-02"], [40]).add_polynomial(2).functions
    rows = X.bands(spark).select("band", F.posexplode(F.array(*[f.column(F.col("date")) for f in fns])).alias("i", "v"))
    return rows.select("band", "i", rnd("v").alias("v"))


_YR = "(date_diff('day', date '2022-01-01', date) / 365.25)::double"


@register(f"with {_BANDS} select band, case when {_YR} > {_EVENT!r} then 1.0 else 0.0 end::double h from b")
def f29_heaviside(spark, d):
    t = D.years_since(F.col("date"), F.lit(date(2022, 1, 1)))
    return X.bands(spark).select("band", timefn.heaviside(t, F.lit(_EVENT)).alias("h"))


@register(f"with {_BANDS} select band, {R(f'case when {_YR} > {_EVENT!r} then log10(1 + ({_YR} - {_EVENT!r})/0.08) else 0 end')} v from b")
def f30_post_seismic(spark, d):
    t = D.years_since(F.col("date"), F.lit(date(2022, 1, 1)))
    return X.bands(spark).select("band", rnd(timefn.post_seismic(t, F.lit(_EVENT), 0.08)).alias("v"))


@register(
    f"with e as (select event_id, ts::timestamp ts from events) select event_id, cast(date_diff('day', date '1900-01-01', ts::date) as int) as \"days\", {R(chr(39).join(['date_diff(', 'day', ', date ', '2022-01-01', ', ts::date)/365.25']))} as \"years\", {R('year(ts) + (dayofyear(ts) - 1)/365.25')} decimal_year,"
    f" {R('hour(ts)*3600 + minute(ts)*60 + second(ts) + (microsecond(ts) % 1000000)/1e6', 3)} as \"seconds\", {R('(hour(ts)*3600 + minute(ts)*60 + second(ts) + (microsecond(ts) % 1000000)/1e6)/3600')} as \"hours\", {R('dayofyear(ts) + (hour(ts)*3600 + minute(ts)*60 + second(ts) + (microsecond(ts) % 1000000)/1e6)/86400')} as \"day\" from e"
)
def f31_f35_dates(spark, d):
    t, day = F.col("ts"), F.to_date("ts")
    return spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", D.days_since_1900(day).alias("days"), rnd(D.years_since(day, F.lit(date(2022, 1, 1)))).alias("years"), rnd(D.decimal_year(day)).alias("decimal_year"),
        rnd(D.seconds_of_day(t), 3).alias("seconds"), rnd(D.hours_of_day(t)).alias("hours"), rnd(D.day_of_year(t)).alias("day"),
    )


@register(f"with {_BANDS} select band, strftime(date, '%Y-%m-%dT%H:%M:%S.%f') as text, cast(k as int) k, epoch_us(date::timestamp) + cast(864000000000 * k / 4 as bigint) micros from b, (select unnest(range(5)) k)")
def f34_f36_parse_format_linspace(spark, d):
    text = D.format_datetime(F.col("date").cast("timestamp"))
    rows = X.bands(spark).select("band", text.alias("text")).withColumn("t", D.parse_datetime(F.col("text")))
    return rows.select("band", "text", F.posexplode(D.linspace(F.col("t"), F.col("t") + F.expr("interval 10 days"), 5)).alias("k", "p")).select("band", "text", "k", F.unix_micros("p").alias("micros"))
