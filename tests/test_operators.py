"""Small hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.functions import sequence as Q
from quillon.functions.user import build_filter, merged
from quillon.operators import curves, design, intervals, pixels, reads, spatial, stats, tables, tracks
from quillon.plans import composites
from quillon.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_revcomp_hamming_search(spark):
    assert one(spark, Q.revcomp(F.lit("acgtn"))) == "NACGT"
    assert one(spark, Q.hamming(F.lit("ACGT"), F.lit("ACCA"))) == 2
    assert one(spark, Q.hamming(F.lit("ACGT"), F.lit("ACGTAA"))) == 6
    assert [one(spark, f(F.lit("GATTAGAT"), "GAT")) for f in (Q.find, Q.rfind)] == [0, 5]
    assert one(spark, Q.rfind(F.lit("AAA"), "C")) == -1


def test_runs(spark):
    assert one(spark, Q.has_run(F.lit("ACGGGGGT"), 5)) and not one(spark, Q.has_run(F.lit("ACGGGGT"), 5))
    assert one(spark, Q.has_dinucleotide_run(F.lit("CATATATC"), 6)) and not one(spark, Q.has_dinucleotide_run(F.lit("AAAAAA"), 6))
    assert one(spark, Q.complement_run(F.lit("AAACCC"), F.lit("GGGTTT"))) == 6


def test_edges_of_empty_sequences(spark):
    assert one(spark, Q.gc(F.lit(""))) is None
    assert one(spark, Q.mean_phred(F.lit(""))) is None
    assert one(spark, Q.complement_run(F.lit(""), F.lit("ACG"))) == 0
    assert one(spark, Q.rules_passed(F.lit(""))) >= 0


def test_coordinates_toward_three_prime(spark):
    for end, snp, want in ((100, 105, 5), (100, 100, None), (100, 121, None)):
        assert one(spark, S.primer_to_snp(F.lit(end), F.lit(snp), 20)) == want
    assert one(spark, S.primer_to_snp(F.lit(100), F.lit(95), 20, F.lit("-"))) == 5


def test_names(spark):
    assert one(spark, S.fov_key(F.lit("FOV3_Left.tif"))) == "FOV3"
    assert one(spark, S.base_condition(F.lit("WT 12"))) == "WT"
    assert one(spark, S.clean_name(F.lit("__a b//c.--"))) == "a_b_c"
    assert one(spark, S.genotype_dose(F.lit("WT_2.5uM"))) == ("WT", 2.5)
    with pytest.raises(Exception, match="unknown name"):
        one(spark, S.genotype_dose(F.lit("x")))


def test_assign_cell(spark):
    rows = [(1, 0), (1, 2), (1, 2), (1, 2), (1, 3), (2, 0), (2, 0)]
    got = {r.track: r for r in tracks.assign_cell(spark.createDataFrame(rows, "track long, cell long")).collect()}
    assert (got[1].cell, got[1].confidence, got[1].labels, got[1].ambiguous) == (2, 0.6, "0;2;3", True)
    assert (got[2].cell, got[2].confidence, got[2].ambiguous) == (0, 1.0, False)


def test_links_make_one_track(spark):
    six = spark.createDataFrame([("f", i, i, float(i), 0.0) for i in range(6)], "fov string, spot long, frame long, x double, y double")
    got = composites.link(six, 5, 2, 5)
    assert {r.track for r in got.collect()} == {0} and got.count() == 6
    e = tracks.edges(got).collect()
    assert {r.edge_type for r in e} == {"adjacent"} and len(e) == 5


def test_links_close_a_gap(spark):
    frames = [0, 1, 2, 4, 5, 6]
    d = spark.createDataFrame([("f", i, f, float(f), 0.0) for i, f in enumerate(frames)], "fov string, spot long, frame long, x double, y double")
    got = composites.link(d, 5, 2, 5)
    s = tracks.track_summary(got).first()
    assert (s.n, s.gap_edges) == (6, 1)
    assert max(r.frame_difference for r in tracks.edges(got).collect()) == 2


def test_range_join_no_nested_loop(spark):
    a = spark.createDataFrame([(1, 5, 9), (2, 0, 5000), (3, 7, 6), (4, None, 5)], "i long, a0 long, a1 long")
    b = spark.createDataFrame([(1, 9, 9), (2, 10, 12), (3, 4000, 9000)], "j long, b0 long, b1 long")
    got = intervals.range_join(a, b, ("a0", "a1"), ("b0", "b1"), bucket=8)
    assert sorted((r.i, r.j) for r in got.collect()) == [(1, 1), (2, 1), (2, 2), (2, 3)]
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    anti = intervals.range_join(a, b, ("a0", "a1"), ("b0", "b1"), bucket=8, how="left_anti")
    assert sorted(r.i for r in anti.collect()) == [3, 4]


def test_distance_join_no_nested_loop(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, -0.1, 0.0), (3, None, 1.0)], "i long, ax double, ay double")
    b = spark.createDataFrame([(1, 2.5, 0.0), (2, 2.4, 0.0)], "j long, bx double, `by` double")
    got = spatial.distance_join(a, b, 2.5)
    assert sorted((r.i, r.j) for r in got.collect()) == [(1, 2)]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_dispersion_is_free_of_scale(spark):
    rows = [(k, float(v * k)) for k in (1, 7) for v in (1, 2, 3, 10)]
    got = [(r.gini, r.cv, r.robust) for r in stats.dispersion(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()]
    assert got[0] == pytest.approx(got[1])


def test_cumulants(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=30)
    px = spark.createDataFrame([(0, 0, 0, i, float(x)) for i, x in enumerate(v)], "fov int, y int, x int, frame int, value double")
    d = v - v.mean()
    assert pixels.cumulant(px, 2).first().value == pytest.approx(np.mean(d[:-1] * d[1:]))
    a, b, c, e = (d[i : len(d) - 3 + i] for i in range(4))
    m = lambda x, y: np.mean(x * y)
    want = np.mean(a * b * c * e) - m(a, b) * m(c, e) - m(a, c) * m(b, e) - m(a, e) * m(b, c)
    assert pixels.cumulant(px, 4).first().value == pytest.approx(want)


def test_step_threshold_is_half(spark):
    rows = [(1, i, 100.0 - 20 * (i // 8)) for i in range(40)]
    got = pixels.step_scale(spark.createDataFrame(rows, "roi int, frame int, value double")).first()
    assert got.step == pytest.approx(20) and got.threshold == pytest.approx(10)


def test_t_tail():
    assert stats.t_tail([2.0], [10.0])[0] == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_tail([0.0], [3.0])[0] == pytest.approx(1.0)


def test_fit_decay_finds_its_parameters(spark):
    rows = [(1, float(r), 1 + 2 * math.exp(-r / 20)) for r in range(0, 100, 2)]
    got = curves.fit_decay(spark.createDataFrame(rows, "k int, r double, value double"), ["k"], r0_max=100, steps=100).first()
    assert (got.A, got.r0, got.grade) == (pytest.approx(2.0), pytest.approx(20.0), "good")


def test_greedy_spacing(spark):
    rows = [("g", 0, 10), ("g", 5, 10), ("g", 12, 10), ("g", 30, 5)]
    got = design.greedy_spacing(spark.createDataFrame(rows, "gene string, start int, length int"), 2)
    assert sorted(r.start for r in got.collect()) == [0, 12, 30]


def test_select_probes_relaxes(spark):
    rows = [("g", i, i % 3, 4 if i < 2 else 0, 1.0) for i in range(10)]
    p = spark.createDataFrame(rows, "gene string, probe int, n_snps int, n_rules int, score double")
    assert design.select_probes(p, 2, 0).count() == 2
    assert {r.level for r in design.select_probes(p, 5, 0).collect()} == {0}


def test_demultiplex(spark):
    m = spark.createDataFrame([("s1", "AAAACCCC", "GGGGTTTT"), ("s2", "ACACACAC", "TGTGTGTG")], "SampleName string, P7_Barcode string, P5_Barcode string")
    a7, a5 = "GATTACAGATT", "CCTTGGAACCT"
    read = lambda i7, i5: i7 + a7 + "ACGTTGCA" * 3 + a5 + i5
    s = read("AAAACCCC", "GGGGTTTT")
    rows = [("exact", s), ("one", read("AAAACCCA", "GGGGTTTT")), ("two", read("AAAACCAA", "GGGGTTTT")), ("none", "ACGT" * 20)]
    got = {r.read: (r.status, r.sample) for r in reads.demultiplex(spark.createDataFrame(rows, "read string, seq string"), reads.load_sample_map(m), a7, a5).collect()}
    assert got == {"exact": ("assigned", "s1"), "one": ("assigned", "s1"), "two": ("unmatched", None), "none": ("unrecognized", None)}


def test_sample_map_errors(spark):
    m = spark.createDataFrame([("s1", "AAAACCCC", "GGGGTTTT"), ("s2", "AAAACCCC", "GGGGTTTT")], "SampleName string, P7_Barcode string, P5_Barcode string")
    with pytest.raises(Exception, match="bad sample map"):
        reads.load_sample_map(m).collect()


def test_in_polygon_first_cell_wins(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    polys = spark.createDataFrame([(1, 2, square), (1, 1, square), (1, 3, [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0)])], "fov int, cell int, vertices array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1, 5.0, 5.0), (1, 2, 50.0, 5.0)], "fov int, point int, x double, y double")
    assert {r.point: r.cell for r in spatial.in_polygon(points, polys).collect()} == {1: 1, 2: -1}
    assert sorted(r.cell for r in spatial.outer_only(polys).collect()) == [1, 2]


def test_qpcr(spark):
    rows = [(1, "WT 1", 1, "G", "WT", 1, 20.0, 10.0), (2, "KO 1", 1, "G", "WT", 1, 22.0, 10.0)]
    df = spark.createDataFrame(rows, "id long, Condition string, Date int, Primer_ref string, FoldChange_ref string, FoldChange_ref_date int, X double, G double")
    got = composites.qpcr(df, ["X", "G"]).collect()
    assert [(r.id, r.Primer, r.ddCp, r.FoldChange) for r in got] == [(2, "X", 2.0, 0.25)]


def test_reference_mean_does_not_depend_on_the_order_of_rows(spark):
    import math
    import random

    rng = random.Random(3)
    cp = [round(rng.uniform(0, 9000), 6) for _ in range(20000)]
    rows = [(i, "WT 1", 1, "G", "WT", 1, x, 0.0) for i, x in enumerate(cp)] + [(-1, "KO 1", 1, "G", "WT", 1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, Condition string, Date int, Primer_ref string, FoldChange_ref string, FoldChange_ref_date int, X double, G double")
    want = 1.0 - math.fsum(cp) / len(cp)
    assert [composites.qpcr(d, ["X", "G"]).first().ddCp for d in (df.repartition(7), df.orderBy("X").coalesce(1))] == [want, want]


def test_config_merge(spark):
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert spark.range(5).filter(build_filter({"id": {"above": 1, "most": 3}})).count() == 2
    with pytest.raises(ValueError, match="unknown rules"):
        build_filter({"id": {"nope": 1}})


def test_truncated_fastq(spark, tmp_path):
    p = tmp_path / "x.fastq"
    p.write_text("@r1\nACGT\n+\nIIII\n@r2\nAC\n")
    with pytest.raises(Exception, match="truncated"):
        readers.read_fastq(spark, str(p)).collect()


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        tables.require(spark.range(1), ["id", "b"])


def test_empty_tables(spark):
    t = spark.createDataFrame([], "track long, spot long, frame long, x double, y double, cell long")
    for f in (tracks.edges, tracks.msd, tracks.angles, tracks.assign_cell, tracks.track_summary):
        assert f(t).count() == 0
    assert stats.hist(spark.createDataFrame([], "v double"), "v", 0, 1, 4).count() == 0


def test_guides_of_any_length_are_placed(spark):
    import random

    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    revcomp = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("g70", genome[1000:1070]), ("g60", genome[40:100]), ("g15", genome[2000:2015]), ("end", genome[-25:]), ("minus", revcomp(genome[1020:1055])), ("half", genome[500:520] + "ACGTACGTAC")]
    d, ref = spark.createDataFrame(rows, "guide string, seq string"), spark.createDataFrame([("c", genome)], "contig string, seq string")
    got = {(r.guide, r.start0, r.strand) for r in intervals.placed(d.filter("guide <> 'half'"), ref).collect()}
    want = {(g, i, s) for g, q in rows[:-1] for s, t in (("+", q), ("-", revcomp(q))) for i in range(len(genome)) if genome.startswith(t, i)}
    assert got == want and len({g for g, *_ in got}) == 5
    with pytest.raises(Exception, match="no full-length exact place for guide half"):
        intervals.placed(d, ref).collect()
    assert {r.guide: r.n for r in intervals.partial_places(d, ref).collect()}["half"] == 1
    assert "half" not in {r.guide for r in intervals.placed(d, ref, strict=False).collect()}


def test_fasta_headers_may_hold_the_sign(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a x>y\nACGT\nAC\n>b >> z\r\nGG\r\nTT\r\n>c\nA")
    got = {r.id: r.seq for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"a": "ACGTAC", "b": "GGTT", "c": "A"}


def test_fastq_lines_are_numbered_by_file(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.fq").write_text("".join(f"@{f}{i}/1 x\nACG{'T' * (i % 7)}\n+\nIII{'@' * (i % 7)}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.read_id: (r.seq, r.qual) for r in readers.read_fastq(spark, str(tmp_path / "*.fq")).collect()}
        assert spark.read.text(str(tmp_path / "*.fq")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"{f}{i}": ("ACG" + "T" * (i % 7), "III" + "@" * (i % 7)) for f in "ab" for i in range(3000)}


def test_measured_buckets_bound_the_candidates(spark):
    import random

    rng = random.Random(6)
    a = [(i, s, s + rng.randint(0, 49)) for i, s in enumerate(rng.randint(0, 200_000) for _ in range(2000))]
    b = [(i, s, s + (150_000 if i < 3 else rng.randint(0, 49))) for i, s in enumerate(rng.randint(0, 50_000 if i < 3 else 200_000) for i in range(2000))]
    left, right = spark.createDataFrame(a, "i long, a0 long, a1 long"), spark.createDataFrame(b, "j long, b0 long, b1 long")
    assert intervals.bucket_width((left, ("a0", "a1")), (right, ("b0", "b1"))) == (64, True)
    got = sorted((r.i, r.j) for r in intervals.range_join(left, right, ("a0", "a1"), ("b0", "b1"), bucket=None).collect())
    assert got == sorted((i, j) for i, a0, a1 in a for j, b0, b1 in b if a0 <= b1 and b0 <= a1)
    key = lambda d, p: d.selectExpr(f"explode(sequence(floor({p}0 / 64), floor({p}1 / 64))) as k").groupBy("k").count()
    short = right.filter("b1 - b0 < 1024")
    met = key(left, "a").join(key(short, "b").withColumnRenamed("count", "m"), "k").selectExpr("sum(count * m)").first()[0]
    assert met < 8 * sum(1 for i, j in got if b[j][2] - b[j][1] < 1024) + 4000


def test_global_order_without_one_task(spark):
    import random

    from quillon.operators import ordering, stats

    rng = random.Random(7)
    values = [rng.randint(0, 300) / 4 for _ in range(2001)] + [None]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    import numpy as np

    got = ordering.quantiles(d, F.col("v"), [0.05, 0.5, 0.95, 0, 1]).first()
    assert got.n == 2001 and list(got)[1:] == pytest.approx(np.quantile([v for v in values if v is not None], [0.05, 0.5, 0.95, 0, 1]))
    assert ordering.quantiles(d.filter("false"), F.col("v"), [0.5]).first().asDict() == {"n": 0, "q0": None}
    ids = spark.range(1000).withColumnRenamed("id", "k").orderBy(F.rand(3))
    assert all(r.k == r.n for r in ordering.numbered(ids, ["k"], "n").collect())
    assert stats.control_threshold(d, "v", 0.95).first().threshold == pytest.approx(np.quantile([v for v in values if v is not None], 0.95))


def test_distance_bins_plan_no_nested_loop(spark):
    points = spark.createDataFrame([(0, i, float(i % 13), float(i % 7)) for i in range(60)], "fov long, i long, x double, y double")
    out = spatial.pair_counts_closed(points, points.withColumnRenamed("i", "j"), 2.5, 0.5, 9, ["fov"])
    want = {}
    rows = points.collect()
    for a in rows:
        for b in rows:
            dist = ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5
            for k in range(14):
                if k * 0.5 <= dist <= k * 0.5 + 2.5:
                    want[k] = want.get(k, 0) + 1
    assert {r.bin: r.n for r in out.collect()} == want
    hubs = points.selectExpr("i as hub", "fov", "0 as nucleus", "x", "y")
    px = points.selectExpr("fov", "0 as nucleus", "x", "y", "i as value")
    rdf = spatial.annular_rdf(hubs, px, 1, 1, 4, 1)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() + rdf._jdf.queryExecution().toString()


def test_summary_keeps_all_samples_and_sections(spark):
    rows = [(i, "assigned", f"s{i % 150:03d}", "forward", 0, f"A{i % 150}", "C", f"W{i}", "V", 0, i % 3 - 1) for i in range(300)]
    rows += [(900, "ambiguous", None, None, None, "A0", "C", None, None, None, None), (901, "unmatched", *[None] * 9), (902, "assigned", "", "reverse", 1, "B", "C", "W", "V", 1, 1)]
    d = spark.createDataFrame(rows, "read long, status string, sample string, orientation string, distance int, i7 string, i5 string, word7 string, word5 string, offset7 int, offset5 int")
    got = {}
    for r in reads.demux_summary(d).collect():
        got.setdefault(r.Section, {})[r.Key] = r.Value
    assert got["overall"] == {"total_reads": 303, "assigned": 300, "matched_blank_sample": 1, "unrecognized_structure": 0, "unmatched_barcode": 1, "ambiguous_barcode": 1}
    assert len(got["sample"]) == 150 and got["barcode_offsets"] == {"P7=0;P5=-1": 100, "P7=0;P5=0": 100, "P7=0;P5=1": 100, "P7=1;P5=1": 1}
    assert got["canonical_pair"]["A0,C,ambiguous_barcode:1;matched:2"] == 2 and len(got["observed_pair"]) == 100 and len(got["canonical_pair"]) == 151


def test_summary_lists_statuses_as_its_sql_does(spark):
    rows = [(1, "assigned", "s", "forward", 0, "A", "C", "W", "V", 0, 0), (2, "ambiguous", None, None, None, "A", "C", None, None, None, None), (3, "ambiguous", None, None, None, "A", "C", None, None, None, None)]
    d = spark.createDataFrame(rows, "read long, status string, sample string, orientation string, distance int, i7 string, i5 string, word7 string, word5 string, offset7 int, offset5 int")
    got = reads.demux_summary(d, matched_first=True).filter("Section = 'canonical_pair'").collect()
    assert [(r.Key, r.Value) for r in got] == [("A,C,matched:1;ambiguous_barcode:2", 1)]


def test_greedy_spacing_takes_the_next_free_start(spark):
    import random

    rng = random.Random(8)
    rows = sorted({(g, rng.randint(0, 400)) for g in "ab" for _ in range(150)})
    rows = [(g, s, 5 + s % 9) for g, s in rows]
    got = [tuple(r) for r in design.greedy_spacing(spark.createDataFrame(rows, "gene string, start long, length long").repartition(5), 2).orderBy("gene", "start").collect()]
    want = []
    for g in "ab":
        at = 0
        for _, s, n in (r for r in rows if r[0] == g):
            if s >= at:
                want.append((g, s, n))
                at = s + n + 2
    assert got == want


def test_pairs_of_long_tracks_meet_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(9)
    rows = [(t, i, f, rng.random(), rng.random()) for t in (1, 2) for i, f in enumerate(sorted(rng.sample(range(300), 60)))] + [(3, 0, 7, 0.5, 0.5)]
    d = spark.createDataFrame(rows, "track long, spot long, frame long, x double, y double").withColumn("value", F.col("x"))
    monkeypatch.setattr(tracks, "FRAMES", 16)
    want, far = {}, {3: 0.0}
    for t, _, f, x, y in rows:
        for u, _, g, a, b in rows:
            if t == u and g > f:
                d2 = (a - x) ** 2 + (b - y) ** 2
                far[t] = max(far.get(t, 0), d2**0.5)
                if g - f <= 59:
                    want.setdefault((t, g - f), []).append(d2)
    got = {(r.track, r.lag): (r.msd, r.n_pairs) for r in tracks.msd(d).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(sum(v) / len(v)) for k, v in want.items())
    assert {r.track: r.max_distance for r in tracks.aio_table(d).collect()} == pytest.approx(far)


def test_annular_profiles_with_and_without_overlap(spark):
    points = [(i, float(i % 13) / 2, float(i % 7) / 3, i % 5 + 1) for i in range(80)]
    hubs = spark.createDataFrame([(i, 0, 1, x, y) for i, x, y, _ in points[:9]], "hub long, fov long, nucleus long, x double, y double")
    px = spark.createDataFrame([(0, 1, x, y, v) for _, x, y, v in points], "fov long, nucleus long, x double, y double, value long")
    for width, step in ((0.5, 0.5), (1.0, 0.5)):
        got = {(r.hub, r.bin): (r.n_pixels, r.total, r.local_ref, r.local_disc) for r in spatial.annular_rdf(hubs, px, width, step, 3, 0.75).collect()}
        want = {}
        for h, x, y, _ in points[:9]:
            near = [(((a - x) ** 2 + (b - y) ** 2) ** 0.5, v) for _, a, b, v in points]
            local, disc = [v for d, v in near if d < 3], [v for d, v in near if d <= 0.75]
            for k in range(int((3 - width) / step) + 1):
                own = [v for d, v in near if k * step <= d < k * step + width]
                if own:
                    want[h, k] = (len(own), sum(own), pytest.approx(sum(local) / len(local)), pytest.approx(sum(disc) / len(disc)))
        assert got == want


def test_tiers_of_a_pair_one_rule_at_a_time(spark):
    """A pair that passes everything, with one thing changed in each row."""
    good = {"left_seq": "ACGTTGCAAGTCATCGATGC", "right_seq": "AGGATACCTTGACGTCTAGC", "left_tm": 60.0, "right_tm": 60.5, "amplicon_size": 120, "specific": True}
    good |= {"left_hits": 1, "right_hits": 1, "dg": -3.0, "on_target": True, "n_snps": 2, "overlaps_snp": False}
    changes = [
        ({}, "strict_all", ""),
        ({"amplicon_size": 250}, "relaxed_amplicon", "amplicon"),
        ({"amplicon_size": 400}, "failed", "amplicon"),
        ({"specific": False}, "relaxed_specificity", "specificity"),
        ({"specific": False, "right_hits": 0}, "failed", "specificity;relaxed_specificity"),
        ({"specific": False, "left_hits": None}, "failed", "specificity;relaxed_specificity"),
        ({"left_tm": 63.0, "right_tm": 63.0}, "relaxed_gc_tm", "gc_tm"),
        ({"dg": -9.0}, "failed", "thermo"),
        ({"dg": None}, "failed", "thermo"),
        ({"on_target": False}, "failed", "target"),
        ({"n_snps": 0}, "failed", "snps"),
        ({"overlaps_snp": None}, "failed", "overlaps_snp"),
        ({"left_seq": "ACGTTGCAAGTCATC"}, "failed", "length"),
        ({"left_seq": "ACGTTGCAAGTCATCGATGCACGTTGCAAGTCATC"}, "failed", "length"),
        ({"left_tm": 57.9}, "failed", "dtm;gc_tm"),
    ]
    names = list(good)
    schema = "left_seq string, right_seq string, left_tm double, right_tm double, amplicon_size long, specific boolean, left_hits long, right_hits long, dg double, on_target boolean, n_snps long, overlaps_snp boolean"
    rows = [tuple((good | c)[n] for n in names) + (i,) for i, (c, _, _) in enumerate(changes)]
    df = spark.createDataFrame(rows, schema + ", i long")
    got = {r.i: (r.tier, r.reasons) for r in design.primer_tier(df, inter=20).collect()}
    assert got == {i: (tier, reasons) for i, (_, tier, reasons) in enumerate(changes)}
    few = df.drop("left_hits", "right_hits", "dg", "on_target", "n_snps", "overlaps_snp").filter("i in (0, 3, 4)").withColumn("relaxed", F.col("i") == 3)
    assert {r.i: r.tier for r in design.primer_tier(few, inter=20).collect()} == {0: "strict_all", 3: "relaxed_specificity", 4: "failed"}


def test_t_tails_by_integration():
    """Two-sided tails of Student's t by summing its density."""
    import numpy as np

    for df in (1.0, 2.5, 7.0, 60.0):
        x = np.linspace(0, 60, 2_000_001)
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        for t in (0.0, 0.3, 1.0, 2.7, -4.0):
            inner = np.trapezoid(density[x <= abs(t) + 1e-12], x[x <= abs(t) + 1e-12])
            assert float(stats.t_tail(np.array([t]), np.array([df]))[0]) == pytest.approx(1 - 2 * inner, abs=2e-5)
