"""Kernels and helpers against independent formulas, properties and simulated truth."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave import catalog
from pixelweave import fixtures as X
from pixelweave.functions import stats, timefn
from pixelweave.model import RasterError, to_long, to_wide
from pixelweave.operators import amplitude, closure, fit, neighbours, phaselink, sbas, sequential, simulate, spectral, topo
from pixelweave.plans.components import components

# ---- test statistics


def _ks(a, b):
    values = np.concatenate([a, b])
    return max(abs((a <= v).mean() - (b <= v).mean()) for v in values)


def test_ks_distance_by_definition_with_ties():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, (20, 30)).astype(float), rng.integers(0, 9, (20, 30)).astype(float)
    assert np.allclose(stats.ks_distance(a, b), [_ks(x, y) for x, y in zip(a, b)])


def test_kolmogorov_column_equals_numpy(spark):
    u = np.linspace(0.01, 8, 300)
    df = spark.createDataFrame([(float(v),) for v in u], "u double")
    got = np.array([r[0] for r in df.select(stats.kolmogorov_column(F.col("u"))).collect()])
    assert np.allclose(got, stats.kolmogorov(u)) and (np.diff(got) <= 1e-6).all()


def test_tests_are_symmetric_and_separate_samples():
    rng = np.random.default_rng(2)
    a, same, other = (rng.rayleigh(s, (200, 40)) for s in (1, 1, 2.5))
    for name, test in stats.TESTS.items():
        assert (test(a, same) >= 0.05).mean() > 0.9, name
        assert (test(a, other) >= 0.05).mean() < 0.1, name
    assert np.allclose(stats.ks_probability(a, other), stats.ks_probability(other, a))


def test_ad_statistic_by_definition():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=12), rng.normal(size=12)
    n, total = 12, 24
    z = np.sort(np.concatenate([a, b]))
    inner = sum(sum((total * (s <= z[j - 1]).sum() - n * j) ** 2 / (j * (total - j)) for j in range(1, total)) / n for s in (a, b)) / total
    assert np.isclose(stats.ad_statistic(a[None], b[None])[0] * stats.ad_sigma(n) + 1, inner)


# ---- masks


@pytest.mark.parametrize("ny,nx", [(2, 2), (7, 7), (1, 3)])
def test_masks_round_trip(spark, ny, nx):
    every = [(5, 5, dy, dx) for dy in range(-ny, ny + 1) for dx in range(-nx, nx + 1) if (dy, dx) != (-ny, -nx)]
    edges = spark.createDataFrame(every, "y int, x int, dy int, dx int")
    masks = neighbours.bit_masks(edges, ny, nx)
    assert {tuple(r) for r in neighbours.decode_masks(masks, ny, nx).collect()} == set(every)
    assert masks.select(neighbours.popcount(F.col("mask"))).first()[0] == len(every)


def test_neighbourhoods_are_symmetric(spark):
    rng = np.random.default_rng(4)
    rows = [(y, x, sorted(rng.rayleigh(1 + (x > 3), 24).tolist())) for y in range(6) for x in range(7)]
    e = {tuple(r)[:4] for r in neighbours.neighbours(spark.createDataFrame(rows, "y int, x int, amps array<double>"), 2, 2).collect()}
    assert all((y + dy, x + dx, -dy, -dx) in e for y, x, dy, dx in e) and {(y, x, 0, 0) for y in range(6) for x in range(7)} <= e


@pytest.mark.parametrize("method", ["KS2", "AD2"])
def test_neighbourhoods_of_tiles_equal_all_pairs(spark, method):
    from pixelweave.functions import stats

    rng = np.random.default_rng(5)
    amps = {(y, x): np.sort(rng.rayleigh(1 + (x > 4), 12)) for y in range(-2, 9) for x in range(9) if rng.random() < 0.9}
    rows = [(y, x, v.tolist()) for (y, x), v in amps.items()]
    got = neighbours.neighbours(spark.createDataFrame(rows, "y int, x int, amps array<double>"), 2, 3, 0.2, method, tile=4).collect()
    expected = {(y, x, 0, 0): 1.0 for y, x in amps}
    for (y, x), v in amps.items():
        for dy in range(-2, 3):
            for dx in range(-3, 4):
                if (dy, dx) > (0, 0) and (y + dy, x + dx) in amps:
                    p = float(stats.TESTS[method](v[None], amps[y + dy, x + dx][None])[0])
                    if p >= 0.2:
                        expected[y, x, dy, dx] = expected[y + dy, x + dx, -dy, -dx] = p
    assert len(got) == len(expected) and {tuple(r)[:4]: r.p for r in got} == pytest.approx(expected)


def test_despeckling_by_tiles_equals_sums_over_windows(spark):
    from pixelweave.operators import despeckle

    rng = np.random.default_rng(6)
    z = {(y, x): rng.normal(size=3) + 1j * rng.normal(size=3) for y in range(7) for x in range(8)}
    z[3, 3] = np.zeros(3, complex)
    edges = [(y, x, dy, dx) for y, x in z for dy in (-1, 0, 1) for dx in (-2, 0, 1) if (y + dy, x + dx) in z and (y, x, dy, dx) != (2, 2, 0, 0)]
    e = spark.createDataFrame(edges, "y int, x int, dy int, dx int")
    wide = spark.createDataFrame([(*k, v.real.tolist(), v.imag.tolist()) for k, v in z.items()], "y int, x int, re array<double>, im array<double>")
    band = lambda k: wide.select("y", "x", F.col("re")[k].alias("re"), F.col("im")[k].alias("im"))
    near = {p: np.array([z[y + dy, x + dx] for y, x, dy, dx in edges if (y, x) == p]) for p in z}
    options = {"ny": 1, "nx": 2, "tile": 3}
    amp = {(r.y, r.x): r.amp for r in despeckle.mean_amplitude(e, band(0), **options).collect()}
    assert amp == pytest.approx({p: abs(v[:, 0]).mean() for p, v in near.items() if p != (2, 2)})
    inter = {(r.y, r.x): complex(r.re, r.im) for r in despeckle.interferogram(e, band(0), band(1), **options).collect()}
    assert inter == pytest.approx({p: (v[:, 0] * v[:, 1].conj()).mean() for p, v in near.items() if p != (2, 2)})
    found = despeckle.coherence_matrix(e, wide, **options).collect()
    assert len(found) == 3 * len(z)
    for r in found:
        a, b = near[r.y, r.x][:, r.ti], near[r.y, r.x][:, r.tj]
        assert r.n == len(a) and complex(r.re, r.im) == pytest.approx((a * b.conj()).sum() / np.sqrt((abs(a) ** 2).sum() * (abs(b) ** 2).sum()))
    with pytest.raises(Exception, match="longer than the window"):
        despeckle.coherence_matrix(e, wide, ny=1, nx=1).collect()


# ---- amplitudes


def test_sentinels_of_amplitudes(spark):
    rows = [(0, 0, 0, 3.0, 4.0), (0, 0, 1, 0.0, 0.0), (0, 1, 0, 1.0, 0.0), (0, 1, 1, 1.0, 0.0), (0, 2, 0, float("nan"), 0.0), (0, 2, 1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "y int, x int, band int, re double, im double")
    got = {r.x: r for r in amplitude.dispersion(df).collect()}
    assert (got[0].mean_amp, got[0].da, got[1].da, got[2].da) == (0.0, -1.0, -1.0, -1.0) and np.isnan(got[2].mean_amp)
    assert {r.band: r.amp_const for r in amplitude.calibrate(df.where("x = 0")).collect()} == {0: 5.0, 1: 1.0}
    assert [r.valid for r in amplitude.all_valid(df).orderBy("x").collect()] == [False, True, False]


# ---- phase linking


def _stack(spark, seed=0, n=11, step=12.0, days=360):
    t = np.arange(0, days, step)
    rng = np.random.default_rng(seed)
    phase = t / 365.25 + np.sin(4 * np.pi * t / 365.25) + rng.normal(0, 0.3, len(t))
    c = simulate.exponential(t, 0.999, 72.0, 0.99, phase - phase[0])
    return simulate.stack(spark, c, n, n, seed), np.angle(np.exp(1j * (phase - phase[0])))


def _full_masks(spark, n, ny, nx):
    from pixelweave.plans.stencil import neighbour_pairs

    px = spark.createDataFrame([(y, x) for y in range(n) for x in range(n)], "y int, x int")
    e = neighbour_pairs(px, ny, nx, half=False).select("y", "x", "dy", "dx").unionByName(px.select("y", "x", F.lit(0).alias("dy"), F.lit(0).alias("dx")))
    return neighbours.bit_masks(e, ny, nx)


def _rmse(row, truth):
    z = np.array(row.re) + 1j * np.array(row.im)
    return np.degrees(np.sqrt((np.angle(z * np.exp(-1j * truth)) ** 2).mean()))


@pytest.mark.parametrize("method", ["EVD", "MLE", "phase_link", "iterative"])
def test_simulated_phases_are_recovered_within_ten_degrees(spark, method):
    wide, truth = _stack(spark)
    row = phaselink.phase_link(wide, _full_masks(spark, 11, 5, 5), 5, 5, method).where("y = 5 and x = 5").first()
    assert _rmse(row, truth) <= 10 and 0 < row.tcorr <= 1 + 1e-9 and (row.re[0], row.im[0]) == (1.0, 0.0)


def test_tiles_do_not_change_results(spark):
    wide, _ = _stack(spark, n=9, days=120)
    masks = _full_masks(spark, 9, 2, 2)
    results = [{(r.y, r.x): (r.tcorr, *r.re, *r.im) for r in phaselink.phase_link(wide, masks, 2, 2, "EVD", tile=t).collect()} for t in (2, 4, 64)]
    for other in results[1:]:
        assert all(np.allclose(results[0][k], other[k]) for k in results[0])


def test_a_global_phase_changes_nothing_and_two_epochs_agree():
    rng = np.random.default_rng(5)
    z = simulate.neighbourhood(simulate.random_coherence(6, 5), 80, 6)[None]
    c = phaselink.coherence_matrices(z, np.ones((1, 80), bool))
    turned = phaselink.coherence_matrices(z * np.exp(0.7j), np.ones((1, 80), bool))
    assert np.allclose(phaselink.link(c, "MLE")[0], phaselink.link(turned, "MLE")[0])
    two = c[:, :2, :2]
    for m in ("EVD", "MLE", "phase_link"):
        assert np.isclose(np.angle(phaselink.link(two, m)[0][0, 1]), -np.angle(two[0, 0, 1]))
    assert rng is not None


def test_rank_deficient_matrices_have_a_status_and_bands_are_checked():
    z = np.random.default_rng(7).normal(size=(1, 4, 8)) + 0j
    c = phaselink.coherence_matrices(z, np.ones((1, 4), bool))
    linked, status = phaselink.link(c, "MLE")
    assert status[0] == -2 and not linked.any()
    assert phaselink.link(c, "phase_link")[1][0] > 0
    with pytest.raises(RasterError):
        phaselink.link(c, "STBAS", bandwidth=7)


def test_sequential_estimator_equals_numpy(spark):
    t = np.arange(0, 96, 12.0)
    z = simulate.neighbourhood(simulate.exponential(t, 0.95, 60.0, 0.2, t / 40), 9, 8)
    wide = spark.createDataFrame([(i // 3, i % 3, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(z)], "y int, x int, re array<double>, im array<double>")
    own, datum = sequential.sequential(wide, _full_masks(spark, 3, 2, 2), 8, 4, 2, 2, "EVD")
    got = sequential.adjust_wrapped(own.where("y = 1 and x = 1"), datum).orderBy("ministack", "k").collect()
    # the compressed acquisitions of the numpy version are those of each pixel, as here: the window is the whole grid
    assert np.allclose([r.re + 1j * r.im for r in got], simulate.sequential_numpy(z, 4), atol=1e-8)
    row = sequential.sequential_overlap(wide, _full_masks(spark, 3, 2, 2), 8, 3, 2, 2, "EVD").where("y = 1 and x = 1").first()
    assert np.allclose(np.array(row.re) + 1j * np.array(row.im), simulate.sequential_overlap_numpy(z, 3), atol=1e-8)


# ---- inversion, fits, grid search


def test_noise_free_networks_are_recovered(spark):
    dates = [date(2020, 1, 1) + timedelta(24 * k) for k in range(9)]
    pairs = [(dates[i], dates[j]) for i in range(9) for j in (i + 1, i + 2) if j < 9]
    ref = dates[3]
    t = sbas.years(dates, ref)
    base = np.array([0, 90, -60, 0, 120, -30, 45, -80, 15.0])
    height, slant, inc, wavelength = 12.0, 850e3, 34.0, 0.056
    factor = 4 * np.pi / (wavelength * slant * np.sin(np.radians(inc)))
    truth = 0.4 * t + 0.05 * t * t + base * factor * height
    phi = [float(truth[dates.index(a)] - truth[dates.index(b)]) for a, b in pairs]
    df = sbas.invert(spark.createDataFrame([(0, 0, phi)], "y int, x int, phi array<double>"), pairs, ref)
    row = df.first()
    others = [i for i in range(9) if i != 3]
    assert np.allclose(row.ts, truth[others]) and np.isclose(row.tcorr, 1)
    fixed = sbas.height_error(df, base[others].tolist(), [dates[i] for i in others], ref, wavelength, F.lit(slant), F.lit(inc)).first()
    assert np.isclose(fixed.zerr, height) and np.isclose(fixed.velocity, 0.4)
    biased = sbas.height_error(df, base[others].tolist(), [dates[i] for i in others], ref, wavelength, F.lit(slant), F.lit(inc), compat=True).first()
    assert not np.isclose(biased.zerr, height)
    with pytest.raises(RasterError):
        sbas.invert(df, [(dates[0], dates[1]), (dates[2], dates[3])], dates[0])
    with pytest.raises(RasterError):
        sbas.incidence(pairs, date(1999, 1, 1))
    with pytest.raises(RasterError):
        sbas.require_scenes(pairs, dates[:4])
    full = [r.value for r in sbas.with_reference_epoch(df, pairs, ref).orderBy("date").collect()]
    assert np.allclose(full, truth) and full[3] == 0


def test_offsets_scale_and_empty_boxes(spark):
    obs = spark.createDataFrame([(0, 0, 0, 1.0, 0.9), (0, 1, 0, 3.0, 0.9), (1, 1, 0, 9.0, 0.1)], "y int, x int, pair int, phase double, coh double")
    off = sbas.reference_offsets(obs, (0, 0, 2, 2))
    scale = spark.createDataFrame([(0, 2.0)], "pair int, scale double")
    assert [r.phase for r in sbas.referenced(obs, off, scale).orderBy("y", "x").collect()] == [-2.0, 2.0, 14.0]
    assert sbas.reference_offsets(obs, None).first().offset == 0
    with pytest.raises(RasterError):
        sbas.referenced(obs, sbas.reference_offsets(obs, (1, 1, 1, 1)))


@pytest.mark.parametrize("wavelength,slant,inc,dz,n,spread", [(0.06, 850e3, 34, 6, 30, 1000), (0.06, 920e3, 40, 20, 35, 500), (0.03, 788e3, 23, -10, 25, 700)])
def test_heights_are_found(spark, wavelength, slant, inc, dz, n, spread):
    rng = np.random.default_rng(9)
    b = rng.normal(0, spread, n)
    k = 4 * np.pi / (wavelength * slant * np.sin(np.radians(inc)))
    phase = -k * dz * b + rng.uniform(0, 0.3, n)
    z = [(float(np.cos(p)), float(np.sin(p)), float(v)) for p, v in zip(phase, b)]
    df = spark.createDataFrame([(0, z)], "id int, z array<struct<re:double,im:double,bperp:double>>")
    row = topo.topofit(df, topo.height_factor(wavelength, F.lit(float(slant)), F.lit(float(inc)))).first()
    assert abs(row.h - dz) < 0.15 and row.coh > 0.95 and np.isclose(row.k_h, k * row.h)
    slope, coh = topo.topofit_linear(phase, b, wraps=abs(k * dz) * np.ptp(b) / 2 / np.pi + 2)
    assert abs(slope + row.k_h) < abs(row.k_h) * 0.02 + 1e-4 and coh > 0.95
    other = topo.topo_residual(df, wavelength, F.lit(float(slant)), F.lit(float(inc)), sign=-1).first()
    assert abs(other.dz + dz) < 0.15


def test_rate_and_height_of_arcs_are_found(spark):
    k, t = 4 * np.pi / 0.056, np.arange(20) * 24 / 365.25
    b = np.random.default_rng(10).normal(0, 300, 20)
    kb, kt = b * k / (850e3 * np.sin(np.radians(34))), t * k
    phase = kb * 7.0 + kt * 0.012
    z = [(float(np.cos(p)), float(np.sin(p)), float(u), float(v)) for p, u, v in zip(phase, kb, kt)]
    row = topo.grid_search_2d(spark.createDataFrame([(0, z)], "id int, z array<struct<re:double,im:double,kb:double,kt:double>>")).first()
    assert abs(row.dz - 7) < 0.5 and abs(row.rate - 0.012) < 0.001 and row.coh > 0.99
    nodes = simulate.integrate_arcs(6, simulate.grid_arcs(2, 3), [b - a for a, b in simulate.grid_arcs(2, 3)])
    assert np.allclose(nodes, range(6))


def test_grid_search_2d_equals_brute_force_over_all_pixels(spark, sf):
    df = X.pixels(spark, sf)
    got = {(r.y, r.x): r.coh for r in catalog.queries()["t6_grid_search_2d"](spark, sf).collect()}
    assert set(got) == {(r.y, r.x) for r in df.collect()}
    k, i = 4 * np.pi / 0.056, np.arange(12)
    kb = (i * 37 % 41 - 20) * 20.0 * k / 850e3 / np.sin(np.radians(34))
    kt, grid = i * (12 / 365.25 * k), np.linspace(-1, 1, 21)
    for r in df.orderBy(F.desc("y"), "x").limit(5).collect():
        z = np.array(r.e[0:24:2]) + 1j * np.array(r.e[1:24:2])
        h, v, half, best = 0.0, 0.0, (40.0, 0.05), 0.0
        for _ in range(3):
            best, h, v = max(((round(abs((z * np.exp(-1j * (a * kb + b * kt))).sum()) / np.abs(z).sum(), 12), a, b) for a in h + grid * half[0] for b in v + grid * half[1]), key=lambda c: c[0])
            half = (half[0] / 5, half[1] / 5)
        assert np.isclose(got[r.y, r.x], best, atol=1e-4)


def test_nonlinear_fit_recovers_decay(spark):
    t = np.arange(0, 3, 0.05)
    d = 1 + 0.5 * t + (t > 1.2) * (0.8 + 0.6 * np.log10(1 + np.where(t > 1.2, t - 1.2, 0) / 0.1))
    df = spark.createDataFrame([(0, 0, d.tolist())], "y int, x int, ts array<double>")
    row = fit.fit_nonlinear(df, t, 1.2).first()
    assert np.allclose([row.offset, row.rate, row.step, row.decay], [1, 0.5, 0.8, 0.6], atol=0.02) and abs(row.log_tau - np.log(0.1)) < 0.1
    best = fit.search_tau(df.withColumn("tcorr", F.lit(0.9)), t, 1.2, 0.5).first()
    assert np.isclose(best.tau, 0.08)
    assert fit.mean_rmse(fit.fit(df.withColumn("tcorr", F.lit(0.1)), fit.model_matrix("linear", t)), 0.5).first()[0] == 1e6


# ---- closures and regions


def test_one_cycle_is_found_in_a_closure_network(spark):
    pairs = [(i, j) for i in range(1, 10) for j in (i + 1, i + 2, i + 3) if j <= 9]
    assert len(pairs) == 21
    g = closure.triplet_matrix(pairs)
    phase = np.array([0.4 * (b - a) for a, b in pairs])
    phase[5] += 2 * np.pi
    rows = [(y, 0, loop, float(v)) for y in range(2) for loop, v in enumerate(g @ phase)]
    regions = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "y int, x int, region long")
    u = closure.ambiguities(spark, spark.createDataFrame(rows, "y int, x int, loop int, closure double"), regions, g)
    found = {r.pair: r.u for r in u.collect()}
    assert {p: v for p, v in found.items() if v} == {5: -1}


@pytest.mark.parametrize("tile", [128, 4, 1])
def test_regions_are_connected_areas(spark, tile):
    rng = np.random.default_rng(11)
    on = rng.random((12, 15)) < 0.55
    df = spark.createDataFrame([(y, x, int(on[y, x])) for y in range(12) for x in range(15)], "y int, x int, mask int")
    got = {(r.y, r.x): r.region for r in closure.label_regions(df, 15, tile=tile).collect()}
    seen = {}
    for y, x in sorted(map(tuple, np.argwhere(on))):
        if (y, x) in seen:
            continue
        todo, root = [(y, x)], y * 15 + x
        while todo:
            a, b = todo.pop()
            if (a, b) in seen or not (0 <= a < 12 and 0 <= b < 15) or not on[a, b]:
                continue
            seen[a, b] = root
            todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert got == {(int(a), int(b)): int(v) for (a, b), v in seen.items()}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000


# ---- filter, layout, functions


def test_spectral_filter_keeps_a_ramp_and_zeros():
    i, j = np.mgrid[:24, :24]
    chip = np.exp(1j * (0.0314 * i + 0.02 * j))
    noisy = chip * np.exp(1j * np.random.default_rng(12).normal(0, 0.8, chip.shape))
    score = lambda a: abs((a * chip.conj()).sum()) / np.abs(a).sum()
    assert score(spectral.filter_chip(noisy)) > score(noisy) and not spectral.filter_chip(chip * 0).any()


def test_layouts_round_trip(spark):
    rows = [(0, 0, b, float(b), -float(b)) for b in (2, 0, 1)]
    df = spark.createDataFrame(rows, "y int, x int, band int, re double, im double")
    assert {tuple(r) for r in to_long(to_wide(df)).collect()} == set(rows)


def test_cramer_rao_falls_with_looks():
    g = simulate.exponential(np.arange(0, 60, 12.0), 0.8, 50)
    assert (simulate.cramer_rao(g, 200) < simulate.cramer_rao(g, 50)).all()


def test_time_functions_as_numpy_equal_columns(spark):
    text = "poly(order=2,tref=2022-03-02);geolog(tref=2022-03-02,tau=40);bspline(tref=2022-03-02,scale=50,order=3);pbspline(tref=2022-03-02,scale=30,order=2,period=120,offset=10);exp(tref=2022-03-02,tau=40,side=left)"
    fns = timefn.parse(text)
    dates = [date(2022, 1, 1) + timedelta(9 * k) for k in range(30)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d date").orderBy("i")
    got = np.array([list(r)[1:] for r in df.select("i", *fns.columns(F.col("d"))).orderBy("i").collect()])
    assert np.allclose(got, fns.matrix(dates)) and str(timefn.parse(str(fns))) == str(fns)


def test_function_types_and_timescales():
    fns = timefn.parse("constant();linear(tref=2022-01-01);cubic(tref=2022-01-01);sin(tref=2022-01-01,period=90);bspline(tref=2022-01-01,scale=50);ispline(tref=2022-01-01);log(tref=2022-01-01,tau=9)")
    assert timefn.function_types(fns) == {"secular": [0, 1], "seasonal": [3, 4], "transient": [5], "step": [], "reg": [4, 5]}
    got = timefn.timescales(fns, [date(2022, 1, 1), date(2022, 6, 1), date(2024, 1, 1)])
    assert np.allclose(got, [2.0, 2.0, np.nan, 90, 50, 1, np.nan], equal_nan=True)
    assert timefn.function_types(timefn.Collection())["reg"] == []


def test_bad_time_functions_are_refused():
    for text in ("nothing(tref=2022-01-01)", "linear()", "log(tref=2022-01-01,tau=0)", "bspline(tref=2022-01-01,order=1)", "pbspline(tref=2022-01-01,period=10,offset=20)", "linear", "linear(tref=yesterday)"):
        with pytest.raises(ValueError):
            timefn.parse(text).matrix([date(2022, 1, 1)])
    with pytest.raises(ValueError):
        timefn.parse("constant();constant()")
    with pytest.raises(ValueError):
        timefn.TimeFunction("2022-01-01").add_post_seismic(["2022-01-01"], None)
