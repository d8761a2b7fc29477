"""Pair correlation, profiles, fits and probe tiling against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import sequence as Q
from quillon.operators import curves, design

KEYS = "fov long, nucleus long"


def blob(rng, h=30, w=34):
    """A mask with a bay, a hole and a loose part."""
    mask = {(y, x) for y in range(h) for x in range(w) if (y - 14) ** 2 + (x - 15) ** 2 < 180}
    return (mask - {(y, x) for y in range(5, 12) for x in range(10, 16)} - {(20, 20), (21, 20)}) | {(28, 33), (29, 33)}


def test_ring_weights_by_counting_pixels(spark):
    rng = random.Random(1)
    mask, width, bins = blob(rng), 3, 4
    points = [(i, rng.uniform(0, 30), rng.uniform(0, 34)) for i in range(25)] + [(90, 200.0, 200.0), (91, 14.0, 15.0)]
    got = curves.ring_area_weights(
        spark.createDataFrame([(1, 1, i, y, x) for i, y, x in points], KEYS + ", point long, y double, x double"),
        spark.createDataFrame([(1, 1, y, x) for y, x in mask] + [(2, 1, 0, 0)], KEYS + ", y long, x long"),
        width,
        bins,
    ).collect()
    assert len(got) == len(points) * bins
    at = {i: (round(y), round(x)) for i, y, x in points}
    for r in got:
        y0, x0 = at[r.point]
        n = sum((width * r.bin) ** 2 < (y - y0) ** 2 + (x - x0) ** 2 <= (width * (r.bin + 1)) ** 2 for y, x in mask)
        area = math.pi * ((width * (r.bin + 1)) ** 2 - (width * r.bin) ** 2)
        assert r.weight == (pytest.approx(area / n) if n else None)


def plain_pcf(p1, p2, mask, width, step, rmax):
    """Pairs by ring over what even density gives, with the mask's autocorrelation counted shift by shift."""
    area, out = len(mask), {}
    shifted = {}

    def corr(dy, dx):
        if (dy, dx) not in shifted:
            shifted[dy, dx] = sum((y + dy, x + dx) in mask for y, x in mask) / area
        return shifted[dy, dx]

    for b in range(int((rmax - width) / step + 1e-9) + 1):
        start, end = b * step, b * step + width
        edge = 0.0
        for k in range(64):
            t = 2 * math.pi * k / 64
            dy, dx = (start + end) / 2 * math.sin(t), (start + end) / 2 * math.cos(t)
            y0, x0 = math.floor(dy), math.floor(dx)
            fy, fx = dy - y0, dx - x0
            edge += (corr(y0, x0) * (1 - fy) * (1 - fx) + corr(y0 + 1, x0) * fy * (1 - fx) + corr(y0, x0 + 1) * (1 - fy) * fx + corr(y0 + 1, x0 + 1) * fy * fx) / 64
        n = sum(start < math.dist(p, q) <= end for p in p1 for q in p2)
        norm = len(p1) * len(p2) / area * math.pi * (end**2 - start**2) * edge
        out[b] = n / norm
    return out


def test_pair_correlation_by_counting(spark):
    rng = random.Random(2)
    mask = blob(rng)
    spots = sorted(mask)
    p1, p2 = ([(y + rng.random(), x + rng.random()) for y, x in rng.choices(spots, k=n)] for n in (60, 80))
    a = spark.createDataFrame([(1, 1, i, y, x) for i, (y, x) in enumerate(p1)], KEYS + ", i long, y double, x double")
    b = spark.createDataFrame([(1, 1, i, y, x) for i, (y, x) in enumerate(p2)], KEYS + ", j long, y double, x double")
    m = spark.createDataFrame([(1, 1, y, x) for y, x in mask], KEYS + ", y long, x long")
    got = {r.bin: r.g for r in curves.pcf(a, b, m, 2, 1, 7, least=10).collect()}
    assert got == pytest.approx(plain_pcf(p1, p2, mask, 2, 1, 7), rel=1e-6)
    assert curves.pcf(a, b, m, 2, 1, 7, least=70).count() == 0


def test_three_synthetic_cases(spark):
    """Even points give about 1, clusters more and a kept distance less at short range."""
    rng = np.random.default_rng(3)
    size, n = 120, 900
    even = rng.random((n, 2)) * size
    centres = rng.random((60, 2)) * size
    clustered = np.clip(centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 2)) * 1.5, 0, size - 1e-6)
    apart = []
    while len(apart) < 500:
        p = rng.random(2) * size
        if all((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 > 9 for q in apart):
            apart.append(p)
    cases = {1: even, 2: clustered, 3: np.array(apart)}
    rows = [(k, 1, i, float(y), float(x)) for k, ps in cases.items() for i, (y, x) in enumerate(ps)]
    a, b = (spark.createDataFrame(rows, f"{KEYS}, {c} long, y double, x double") for c in "ij")
    side = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    mask = spark.createDataFrame([(k, 1) for k in cases], KEYS).select("fov", "nucleus", side.alias("y")).select("*", side.alias("x"))
    g = {(r.fov, r.bin): r.g for r in curves.pcf(a, b, mask, 2, 2, 12, least=100).collect()}
    assert all(abs(g[1, b] - 1) < 0.15 for b in range(1, 5))
    assert g[2, 0] > 3 and abs(g[2, 5] - 1) < 0.5
    assert g[3, 0] < 0.1 and abs(g[3, 4] - 1) < 0.2


def test_polygon_pair_correlation_by_counting(spark):
    rng = random.Random(4)
    mask, width, bins = blob(rng), 2, 3
    p1, p2 = ([(float(y), float(x)) for y, x in rng.choices(sorted(mask), k=n)] for n in (20, 50))
    a = spark.createDataFrame([(1, 1, i, y, x) for i, (y, x) in enumerate(p1)], KEYS + ", point long, y double, x double")
    b = spark.createDataFrame([(1, 1, i, y, x) for i, (y, x) in enumerate(p2)], KEYS + ", j long, y double, x double")
    m = spark.createDataFrame([(1, 1, y, x) for y, x in mask], KEYS + ", y long, x long")
    got = {r.bin: r.g for r in curves.pcf_polygon(a, b, m, width, bins).collect()}
    for k in range(bins):
        s, area = 0.0, math.pi * ((width * (k + 1)) ** 2 - (width * k) ** 2)
        for p in p1:
            pixels = sum(width * k < math.dist(p, q) <= width * (k + 1) for q in mask)
            s += sum(width * k < math.dist(p, q) <= width * (k + 1) for q in p2) * (area / pixels if pixels else 0)
        assert got[k] == pytest.approx(s / (len(p1) * area * len(p2) / len(mask)))


def test_profile_by_least_squares(spark):
    rng = np.random.default_rng(5)
    pixels = [(y, x, float(rng.normal())) for y in range(9) for x in range(9)]
    hubs, rmax = [(2.0, 3.0), (6.5, 5.0)], 4
    got = curves.rdf_lsq(
        spark.createDataFrame([(1, 1, y, x, v) for y, x, v in pixels], KEYS + ", y long, x long, value double"),
        spark.createDataFrame([(1, 1, y, x) for y, x in hubs], KEYS + ", y double, x double"),
        rmax,
    ).collect()
    v = np.array([p[2] for p in pixels])
    z = (v - v.mean()) / v.std()
    design_matrix = np.zeros((len(pixels), rmax + 1))
    for i, (y, x, _) in enumerate(pixels):
        for h in hubs:
            r = int(np.rint(math.dist((y, x), h)))
            if r <= rmax:
                design_matrix[i, r] += 1
    used = design_matrix.sum(1) > 0
    d = design_matrix[used]
    want = np.linalg.solve(d.T @ d + 1e-9 * np.eye(rmax + 1), d.T @ z[used])
    assert {r.radius: r.profile for r in got} == pytest.approx(dict(enumerate(want)), abs=1e-6)
    assert {r.radius: r.n_pixels for r in got} == dict(enumerate((design_matrix > 0).sum(0).tolist()))


def plain_fit(r, g, r0_max, steps):
    r, y = np.asarray(r[1:], float), np.asarray(g[1:], float) - 1
    best = (math.inf, 0, 0)
    for r0 in (np.arange(steps) + 1) * (r0_max / steps):
        e = np.exp(-r / r0)
        a = min(max((e * y).sum() / (e * e).sum(), -1.0), 5.0)
        best = min(best, (((y - a * e) ** 2).sum(), r0, a))
    return best


def test_decay_fit_by_plain_grid(spark):
    rng = np.random.default_rng(6)
    r = np.arange(12) * 2.0
    sets = {k: 1 + a * np.exp(-r / r0) + rng.normal(size=12) * s for k, (a, r0, s) in enumerate([(2, 5, 0.01), (0.4, 20, 0.05), (9, 3, 0.0), (0, 5, 0.2)])}
    rows = [(k, float(x), float(v)) for k, g in sets.items() for x, v in zip(r, g, strict=True)]
    for f in curves.fit_decay(spark.createDataFrame(rows, "k long, r double, value double"), ["k"], r0_max=40, steps=80).collect():
        sse, r0, a = plain_fit(r, sets[f.k], 40, 80)
        e = sets[f.k][1:] - 1 - a * np.exp(-r[1:] / r0)
        y = sets[f.k][1:] - 1
        assert (f.A, f.r0) == pytest.approx((a, r0)) and f.rmse == pytest.approx(math.sqrt((e * e).mean()), abs=1e-9)
        assert f.r2 == pytest.approx(1 - (e * e).sum() / ((y - y.mean()) ** 2).sum()) and f.mae == pytest.approx(np.abs(e).mean()) and f.max_residual == pytest.approx(np.abs(e).max())
        assert f.sign_changes == int((np.sign(e[1:]) * np.sign(e[:-1]) < 0).sum()) and f.grade == ("good" if f.r2 >= 0.9 else "fair" if f.r2 >= 0.7 else "poor")


def test_bootstrap_by_its_draws(spark):
    rng = np.random.default_rng(7)
    r = np.arange(8) * 3.0
    cells = {f"c{k}": (1 + rng.uniform(0.5, 2) * np.exp(-r / rng.uniform(4, 9)), float(rng.integers(1, 5))) for k in range(9)}
    rows = [(c, float(x), float(v), w) for c, (g, w) in cells.items() for x, v in zip(r, g, strict=True)]
    table = spark.createDataFrame(rows, "cell string, r double, value double, weight double")
    rounds, n = 15, 6
    draws = spark.range(rounds * n).select("id", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(9)).alias("i")).collect()
    names, fits = sorted(cells), []
    for k in range(rounds):
        picked = [cells[names[d.i]] for d in draws if d.id % rounds == k]
        mean = sum(g * w for g, w in picked) / sum(w for _, w in picked)
        fits.append(plain_fit(r, mean, 500.0, 500)[:0:-1])
    got = curves.bootstrap(table, "cell", rounds, n, 3).first()
    assert got.rounds == rounds
    for j, c in enumerate(("A", "r0")):
        assert [got[f"{c}_{p}"] for p in (5, 50, 95)] == pytest.approx(np.percentile([f[j] for f in fits], [5, 50, 95]).tolist())


def test_probe_tiling_by_plain_python(spark):
    rng = random.Random(8)
    genes = [(f"g{i}", "c", "+-"[i % 2], 1000 * i + 1, "".join(rng.choices("ACGT", k=400))) for i in range(4)]
    table = spark.createDataFrame(genes, "gene string, contig string, strand string, g0 long, seq string")
    exons = spark.createDataFrame([("c", 1, 150), ("c", 1001, 1400)], "contig string, i0 long, i1 long")
    introns = spark.createDataFrame([("c", 151, 400), ("c", 1201, 1210)], "contig string, i0 long, i1 long")
    lengths = (26, 28, 30)
    got = design.design_probes(table, exons, introns, lengths, 2, 0.5, -32.0).collect()
    salt = spark.range(1).select(F.expr(design.SALT)).first()[0]
    want = {}
    for gene, _, strand, g0, seq in genes:
        e = [design.DIMER_ENERGY[seq[i : i + 2]] for i in range(len(seq) - 1)]
        at = 0
        for start in range(len(seq) - 25):
            scored = [(1 - 0.1 * abs(sum(e[start : start + n - 1]) - salt + 32), -n) for n in lengths if start + n <= len(seq)]
            score, n = max(scored)
            if score >= 0.5 and start >= at:
                at = start - n + 2
                p0 = g0 + len(seq) - start + n if strand == "-" else g0 + start
                site = seq[start : start - n]
                want[gene, start] = (-n, p0, site.translate(str.maketrans("ACGT", "TGCA"))[::-1], score)
    assert {(r.gene, r.start): (r.length, r.p0, r.seq) for r in got} == {k: v[:3] for k, v in want.items()} and len(want) > 20
    overlap = lambda p, some: any(p.p0 <= b and a <= p.p1 for a, b in some)
    for r in got:
        assert r.score == pytest.approx(want[r.gene, r.start][3]) and r.p1 == r.p0 + r.length - 1
        ex, intr = overlap(r, [(1, 150), (1001, 1400)]), overlap(r, [(151, 400), (1201, 1210)])
        assert r.region_type == ("exon-intron" if ex and intr else "exon" if ex else "intron" if intr else "intergenic")
    one = spark.createDataFrame([(r.seq,) for r in got[:5]], "s string").select("s", Q.gc(F.col("s")).alias("g")).collect()
    assert {x.s: x.g for x in one} == pytest.approx({x.s: (x.s.count("G") + x.s.count("C")) / len(x.s) for x in one})
