"""Long sequences and windows in pieces, and matching in rounds: equal to plain Python, with bounded groups."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import design, intervals, spatial


def test_energies_of_a_long_sequence(spark, monkeypatch):
    """Windows that run over the ends of pieces give the sums of the whole sequence."""
    rng = random.Random(1)
    seqs = {"long": "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=5000)), "edge": "".join(rng.choices("acgt", k=1024)), "edge1": "".join(rng.choices("ACGT", k=1025)), "short": "ACGTACG", "one": "A", "none": ""}
    lengths = [5, 26, 32]
    want = {}
    salt = spark.range(1).select(F.expr(design.SALT)).first()[0]
    for k, s in seqs.items():
        e = [design.DIMER_ENERGY.get(s[i : i + 2].upper(), 0.0) for i in range(len(s) - 1)]
        want |= {(k, i, n): sum(e[i : i + n - 1]) - salt for n in lengths for i in range(len(s) - n + 1)}
    table = spark.createDataFrame([*seqs.items(), ("null", None)], "gene string, seq string")
    got = design.rolling_dg(table, lengths).collect()
    assert len(got) == len(want)
    assert {(r.gene, r.start, r.length): r.dg for r in got} == pytest.approx(want)
    assert all(r.score == pytest.approx(1 - 0.1 * abs(r.dg + 32)) for r in got)


def test_no_window_holds_a_long_sequence(spark):
    table = spark.range(1).select(F.lit("g").alias("gene"), F.repeat(F.lit("ACGTTGCA"), 1 << 17).alias("seq"))
    rows = design.rolling_dg(table, [26])
    assert rows.count() == (1 << 20) - 25
    groups = intervals.pieces(table, "seq", F.lit(26)).select(F.length("_piece").alias("n"))
    assert groups.count() == 1024 and groups.agg(F.max("n")).first()[0] == intervals.PIECE + 26


def test_coverage_over_blocks(spark):
    rng = random.Random(2)
    windows = {1: ("c", 100, 5200), 2: ("c", 3000, 3001), 3: ("c", 50, 50), 4: ("d", 0, 1024), 5: ("c", 4000, 6048)}
    reads = [("c", a, a + rng.choice([1, 50, 3000])) for a in (rng.randrange(6000) for _ in range(300))] + [("d", 0, 1), ("d", 1023, 1025), ("d", 2000, 2100)]
    w = spark.createDataFrame([(k, *v) for k, v in windows.items()], "probe long, contig string, w0 long, w1 long")
    r = spark.createDataFrame(reads, "contig string, start0 long, end0 long")
    got = {(x.probe, x.pos): x.depth for x in intervals.coverage(r, w).collect()}
    assert got == {(k, p): sum(c == d and a <= p < b for d, a, b in reads) for k, (c, w0, w1) in windows.items() for p in range(w0, w1)}


def serial(shared):
    """Cells in order take the free nucleus with most shared pixels."""
    out, used = {}, set()
    for cell in sorted({c for c, _ in shared}):
        free = sorted((-n, k) for (c, k), n in shared.items() if c == cell and k not in used)
        if free:
            out[cell] = free[0][1]
            used.add(free[0][1])
    return out


def test_nuclei_by_serial_choice(spark):
    rng = random.Random(3)
    cells, nuclei, want = [], [], {}
    for fov in range(8):
        wide = 3 if fov % 2 else 9  # few nuclei: most cells are turned down again and again
        image = {(y, x): (rng.randrange(8), rng.randrange(wide)) for y in range(12) for x in range(12)}
        shared = {}
        for (y, x), (c, k) in image.items():
            cells.append((fov, y, x, c))
            nuclei.append((fov, y, x, k))
            if c and k:
                shared[c, k] = shared.get((c, k), 0) + 1
        taken = serial(shared)
        want |= {(fov, c): taken.get(c) for c, _ in image.values() if c}
    got = spatial.match_nuclei(spark.createDataFrame(cells, "fov long, y long, x long, cell long"), spark.createDataFrame(nuclei, "fov long, y long, x long, nucleus long"))
    assert {(r.fov, r.cell): r.nucleus for r in got.collect()} == want and None in want.values()
    none = spark.createDataFrame([], "fov long, y long, x long, nucleus long")
    assert all(r.nucleus is None for r in spatial.match_nuclei(spark.createDataFrame(cells[:20], "fov long, y long, x long, cell long"), none).collect())


def test_a_chain_of_refusals(spark):
    """Cell i prefers nucleus i - 1, which cell i - 1 takes: every round moves the refusal on by one."""
    shared = {(1, 1): 9, (1, 2): 1} | {(i, k): n for i in range(2, 7) for k, n in ((i - 1, 9), (i, 5))}
    cells, nuclei, x = [], [], 0
    for (c, k), n in shared.items():
        for _ in range(n):
            cells.append((1, 0, x, c))
            nuclei.append((1, 0, x, k))
            x += 1
    schema = "fov long, y long, x long, {} long"
    got = spatial.match_nuclei(spark.createDataFrame(cells, schema.format("cell")), spark.createDataFrame(nuclei, schema.format("nucleus")))
    assert {r.cell: r.nucleus for r in got.collect()} == serial(shared) == {i: i for i in range(1, 7)}


def narrowest(hits, most):
    """By all starts: the guides' first ends from there on."""
    guides, best = {h[0] for h in hits}, None
    for contig in {h[1] for h in hits}:
        own = [h for h in hits if h[1] == contig]
        for start in {h[2] for h in own}:
            ends = {g: min((h[3] for h in own if h[0] == g and h[2] >= start), default=None) for g in guides}
            if None not in ends.values() and (span := max(ends.values()) - start) <= most:
                best = min(best or (span, contig, start), (span, contig, start))
    return best


@pytest.mark.parametrize("most", [1, 25, 60, 5000])
def test_narrowest_cluster_by_all_starts(spark, most):
    rng = random.Random(most)
    for guides in (1, 3, 6):
        hits = [(rng.randrange(guides), rng.choice("ab"), a, a + rng.choice([0, 5, 20])) for a in (rng.randrange(-300, 700) for _ in range(120))]
        got = intervals.coherent_target(spark.createDataFrame(hits + [(None, "a", 1, 2)], "guide long, contig string, start0 long, end0 long"), most).collect()
        want = narrowest(hits, most)
        assert [(r.span, r.contig, r.start0) for r in got] == ([want] if want else [])
        assert all(r.end0 - r.start0 == r.span for r in got)


def test_binomial_tails_by_sums():
    from math import comb, inf, log

    import numpy as np
    import pandas as pd

    from quillon.operators.stats import binomial_log_tail

    tail = getattr(binomial_log_tail, "func", binomial_log_tail)
    cases = [(k, n, p) for n in (1, 2, 7, 60) for k in range(n + 2) for p in (0.01, 0.3, 0.5, 0.97)]
    got = tail(*(pd.Series([c[i] for c in cases], dtype=float) for i in range(3)))
    for (k, n, p), v in zip(cases, got, strict=True):
        s = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert v == (inf if not s else pytest.approx(-log(min(s, 1.0)), rel=1e-9, abs=1e-12))
    big = tail(pd.Series([600_000.0, 500_000.0, 5.0, 0.0, 3.0, 2.0]), pd.Series([1e6, 1e6, 1e6, 5.0, 3.0, 2.0]), pd.Series([0.5, 0.5, 0.5, 0.0, 0.0, 1.0]))
    assert big[0] == pytest.approx(20144.7, rel=1e-3) and big[1] == pytest.approx(log(2), rel=2e-3) and big[2] == 0 and big[3] == 0 and big[4] == inf and big[5] == 0
    assert np.isnan(tail(pd.Series([np.nan]), pd.Series([1.0]), pd.Series([0.5]))[0])


def test_references_by_prefix_meet_without_a_loop(spark):
    from quillon.operators import tables

    rows = [(1, "HIGH a", "HIGH", 1, 2.0, "HI"), (2, "HIGH b", "x", 1, 4.0, "HIGH"), (3, "LOW", "LOW", 1, 8.0, "HIGH a"), (4, "LOW", "LOW", 2, 9.0, "none"), (5, None, "LOW", 2, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, Condition string, Base string, Date long, v double, ref string").withColumn("ref_date", F.lit(None).cast("long"))
    out = tables.with_reference(df, "v", "Condition", "Base", "Date", "ref", "ref_date")
    assert {r.id: r.reference for r in out.collect()} == {1: 3.0, 2: 2.0, 3: 2.0, 4: None, 5: None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "NestedLoop" in x]
    assert all("Inner" in x or "Cross" in x for x in joins) and len(joins) <= 2  # the lengths in use, a broadcast of a few rows


def test_diameters_by_all_pairs(spark):
    from math import cos, dist, sin

    from quillon.operators import tracks

    rng = random.Random(9)
    points = {("a", i): [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(rng.choice([1, 2, 3, 40, 300]))] for i in range(25)}
    points |= {("line", 0): [(float(i), 2.0 * i) for i in range(30)], ("same", None): [(1.5, 1.5)] * 4, ("ring", 1): [(cos(i), sin(i)) for i in range(200)], (None, 1): [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0)]}
    rows = [(k, i, x, y) for (k, i), ps in points.items() for x, y in ps] + [("a", 0, None, 5.0), ("a", 1, float("nan"), 500.0), ("null", 1, None, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, i long, x double, y double").repartition(7)
    got = {(r.k, r.i): r.max_distance for r in tracks.diameters(table, ["k", "i"]).collect()}
    assert got == pytest.approx({k: max(dist(p, q) for p in ps for q in ps) for k, ps in points.items()})
