"""Long sequences take time in proportion to their letters; results against plain Python."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import sequence as Q
from quillon.operators import design, intervals, reads, spatial
from quillon.plans import catalog

RNG = random.Random(5)


def letters(n):
    return "".join(RNG.choices("ACGT", (5, 3, 3, 5), k=n))


@pytest.fixture(scope="module")
def long(spark):
    return [letters(n) for n in (200_000, 40, 9, 3)] + ["CCCACCACACAACC" * 3, "ACCTCC", "CCACTCA", "A\\nCCxC\\nC"]


def texts(spark, tmp_path, rows):
    """A folder whose documents are the given letters, written as v_seq reads them: a, b, c, d stand for A, C, G, T."""
    docs = [(i, s.translate(str.maketrans("ACGT", "abcd")), "en", "web") for i, s in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def dense(s):
    return any(s[i : i + 6].count("C") > 3 for i in range(len(s) - 5))


def low(s):
    return len(s) >= 10 and len({s[i : i + 3] for i in range(len(s) - 2)}) / (len(s) - 2) < 0.5


def test_rules_of_long_sequences(spark, long):
    df = spark.createDataFrame(list(enumerate(long)), "id int, s string")
    at = time.time()
    got = df.select("id", Q.composition_rules(F.col("s"))[4].alias("sparse"), Q.low_complexity(F.col("s")).alias("low")).orderBy("id").collect()
    assert [(r.sparse, r.low) for r in got] == [(not dense(s), low(s)) for s in long]
    assert time.time() - at < 20


def test_tiles_of_long_sequences(spark, tmp_path):
    rows = [letters(n) for n in (200_000, 62, 64, 65)]
    at = time.time()
    got = sorted(tuple(r) for r in catalog.QUERIES["p23_reject"](spark, texts(spark, tmp_path, rows)).collect())
    want = []
    for i, s in enumerate(rows):
        for t in range(0, len(s), 31):
            p = s[t : t + 31]
            if len(p) >= 3:
                want.append((i, t // 31, len(p) != 31 or low(p) or any(x * 5 in p for x in "ACGT")))
    assert got == want and time.time() - at < 20


def test_pairs_of_a_long_sequence(spark, tmp_path):
    s = letters(1_000_000)
    sf = texts(spark, tmp_path, [s, s[:83]])
    at = time.time()
    runs = {(r.read, r.tile): r.run for r in catalog.QUERIES["f7_complement_run"](spark, sf).collect()}
    ranks = catalog.QUERIES["o4_rank_pairs"](spark, sf).collect()
    assert time.time() - at < 45
    assert len(runs) == 49_999 + 3 and sorted(r.pair for r in ranks) == [*range(49_997), 100_000]
    assert all(runs[1, t] == runs[0, t] for t in range(3))
    for t in range(300):
        x, y = s[20 * t : 20 * t + 20], s[20 * t + 4 : 20 * t + 24].translate(str.maketrans("ACGT", "TGCA"))[::-1]
        assert runs[0, t] == max((n for n in range(1, 21) for i in range(21 - n) if x[i : i + n] in y), default=0)


def test_best_windows_of_a_long_sequence(spark):
    """A walk, no window or shuffle: against plain Python, also where pieces of STEP starts meet."""
    s = letters(300_000)
    df = spark.createDataFrame([(1, s), (2, s[:27]), (3, "ACG"), (4, None)], "gene int, seq string")
    at = time.time()
    out = design.best_windows(df, range(26, 33), -32.0, 0.9)
    got = {(r.gene, r.start): (r.length, r.dg, r.score) for r in out.collect()}
    plan = out._jdf.queryExecution().toString()
    assert time.time() - at < 20 and "Window" not in plan and "Exchange" not in plan
    salt = math.log(0.115) * -0.175 - 0.2
    for i in (*range(200), *range(design.STEP - 50, design.STEP + 50), *range(len(s) - 40, len(s))):
        best = None
        for n in range(26, min(33, len(s) - i + 1)):
            dg = sum(round(10 * design.DIMER_ENERGY[s[j : j + 2]]) for j in range(i, i + n - 1)) / 10 - salt
            score = round(1 - 0.1 * abs(dg + 32), 9)
            if score >= 0.9 and (best is None or score > best[2]):
                best = (n, dg, score)
        assert got.get((1, i)) == (best and (best[0], pytest.approx(best[1]), pytest.approx(best[2])))
    assert {k for k in got if k[0] == 2} <= {(2, 0), (2, 1)} and not {3, 4} & {k[0] for k in got}


def test_lookup_of_a_needle_that_many_plates_share(spark):
    texts = spark.createDataFrame([(i, letters(60) + "GATTACA" * (i % 2)) for i in range(3000)], "read int, seq string").cache()
    plates = spark.createDataFrame([(p, ("gattac", "acgta", "TTTTTTTTG")[p % 3]) for p in range(30_000)][::-1], "plate int, needle string")
    at = time.time()
    got = {r.read: r.plate for r in intervals.substring_lookup(texts, "seq", plates, "needle", ["plate"], 6).collect()}
    held = [(0, "GATTAC"), (1, "ACGTA"), (2, "TTTTTTTTG")]
    assert got == {r.read: next((p for p, n in held if n in r.seq), None) for r in texts.collect()} and time.time() - at < 20


def test_hubs_and_pixels_of_one_place_meet_once(spark):
    hubs = spark.range(20_000).selectExpr("id as hub", "1 as fov", "1 as nucleus", "double(3 + id % 3) as x", "4d as y")
    px = spark.range(64 * 400).selectExpr("1 as fov", "1 as nucleus", "double(id % 8) as x", "double(floor(id / 8) % 8) as y", "id % 100 as value")
    at = time.time()
    got = {(r.hub, r.bin): (r.n_pixels, r.total) for r in spatial.annular_rdf(hubs, px, 1, 1, 4, 1).collect()}
    assert len(got) == 80_000 and time.time() - at < 20
    for hub in (0, 1, 2, 19_999):
        want = {}
        for i in range(64 * 400):
            d = math.dist((3 + hub % 3, 4), (i % 8, i // 8 % 8))
            if d < 4:
                n, t = want.get(int(d), (0, 0))
                want[int(d)] = (n + 1, t + i % 100)
        assert {b: v for (h, b), v in got.items() if h == hub} == want


def test_reads_are_worked_out_once_to_be_demultiplexed(spark):
    seq = F.regexp_replace("s", "-", "")
    df = spark.createDataFrame([(1, "AAAACCCCGGGG-GCAACGTACGTTACAAAACCCCTT")], "read int, s string").select("read", seq.alias("seq"))
    codes = spark.createDataFrame([("a", "CCCCGGGG", "AAAACCCC")], "SampleName string, P7_Barcode string, P5_Barcode string")
    out = reads.demultiplex(df, reads.load_sample_map(codes), "GCA", "TAC", 1)
    assert "regexp_replace" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.read, r.status, r.sample, r.distance) for r in out.collect()] == [(1, "assigned", "a", 0)]


def test_places_that_hold_no_seed_are_not_dealt(spark):
    """Only what passes the filter of seeds is shuffled: of 400,000 places two, where each place went with its letters before."""
    s = letters(400_000)
    genome = spark.createDataFrame([("a", s), ("b", letters(50))], "contig string, seq string")
    rc = s[5000:5030].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    guides = spark.createDataFrame([(1, s[300:324]), (2, rc), (3, s[399_990:])], "guide int, seq string")
    out = intervals.placed(guides.filter("guide < 3"), genome)
    assert sorted(map(tuple, out.collect())) == [(1, "a", 300, "+"), (2, "a", 5000, "-")]
    bits = intervals._filter(guides.select(F.left("seq", F.lit(20)).alias("s")))
    h = intervals._hashes(s, 20)
    assert len(h) == len(s) - 19 and {300} <= set(np.flatnonzero(bits[h >> 6] >> (h & 63) & 1).tolist()) <= {300} | set(range(len(s)))
    assert np.count_nonzero(bits[h >> 6] >> (h & 63) & 1) < 5
    assert (3, "a", 399_990, "+") in set(map(tuple, intervals.placed(guides, genome, strict=False).collect()))
