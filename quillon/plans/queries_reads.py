"""Queries of the interval, read and design operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.sequence import complement_run, pieces_of
from quillon.operators import design, intervals, reads
from quillon.plans import composites
from quillon.plans.registry import query
from quillon.operators.pixels import stack_groups

_CALLS = "SELECT r.read, r.sample, s.pos, CASE WHEN (r.start0 + s.pos) % 11 = 0 THEN 'N' ELSE substr('ACGT', CAST((r.qname + s.snp) % 4 AS INT) + 1, 1) END AS base, substr('ACGT', CAST(s.snp % 4 AS INT) + 1, 1) AS base1, substr('ACGT', CAST((s.snp + 1) % 4 AS INT) + 1, 1) AS base2, s.pos - r.start0 AS query FROM v_read r JOIN v_snp s ON r.contig = s.contig AND s.pos >= r.start0 AND s.pos < r.end0"
_W = "SELECT probe, contig, strand, CASE WHEN strand = '+' THEN start1 - 15 ELSE end1 + 1 END AS w0, CASE WHEN strand = '+' THEN start1 - 1 ELSE end1 + 15 END AS w1 FROM v_window"
_HIT = f"SELECT DISTINCT w.probe, r.read FROM v_read r JOIN ({_W}) w ON r.contig = w.contig AND w.strand = CASE WHEN r.reverse THEN '+' ELSE '-' END AND CASE WHEN r.reverse THEN r.end0 - 1 ELSE r.start0 END BETWEEN w.w0 AND w.w1"


def _calls(d):
    r = d.v_read.select("read", "sample", "contig", "start0", "qname", (F.col("end0") - 1).alias("last0"))
    s = d.v_snp.select("contig", "snp", "pos", F.col("pos").alias("s0"), F.col("pos").alias("s1"))
    j = intervals.range_join(r, s, ("start0", "last0"), ("s0", "s1"), ["contig"], 64)
    letter = lambda e: F.substring(F.lit("ACGT"), (e % 4).cast("int") + 1, F.lit(1))
    base = F.when((F.col("start0") + F.col("pos")) % 11 == 0, "N").otherwise(letter(F.col("qname") + F.col("snp")))
    return j.select("read", "sample", "pos", base.alias("base"), letter(F.col("snp")).alias("base1"), letter(F.col("snp") + 1).alias("base2"), (F.col("pos") - F.col("start0")).alias("query"))


_VOTE = f"SELECT read, sample, count(*) FILTER (base = base1) AS b, count(*) FILTER (base = base2) AS c, count(*) FILTER (base <> 'N') AS cov FROM ({_CALLS}) GROUP BY ALL"


@query(f"SELECT read, b AS B6_Matches, c AS Cast_Matches, cov AS Total_SNP_Coverage, CASE WHEN b > c THEN 'B6' WHEN c > b THEN 'Cast' WHEN b > 0 THEN 'Ambiguous' ELSE 'Noise' END AS Allele FROM ({_VOTE})")
def a14_assign_allele(d):
    return reads.assign_allele(_calls(d))


@query(f"SELECT sample, count(*) FILTER (b > c) AS B6, count(*) FILTER (c > b) AS Cast, count(*) FILTER (b = c AND b > 0) AS Ambiguous, count(*) FILTER (b = 0 AND c = 0) AS Noise, count(*) AS Total, coalesce(count(*) FILTER (c > b) / nullif(count(*) FILTER (c > b) + count(*) FILTER (b > c), 0)::DOUBLE, 0.0) AS Ratio FROM ({_VOTE}) GROUP BY sample", "Ratio")
def a14_a2_allele_vote(d):
    return reads.allele_summary(reads.assign_allele(_calls(d), keys=["read", "sample"]))


@query(f"SELECT cond AS Condition, avg(r) AS mean_ratio, CAST(sum(t) AS BIGINT) AS total FROM (SELECT k AS cond, count(*) AS t, coalesce(count(*) FILTER (c > b) / nullif(count(*) FILTER (c > b) + count(*) FILTER (b > c), 0)::DOUBLE, 0.0) AS r FROM (SELECT *, read % 5 AS k, read % 25 AS g FROM ({_VOTE})) GROUP BY k, g) GROUP BY cond", "mean_ratio")
def a3_by_condition(d):
    votes = reads.assign_allele(_calls(d)).withColumn("Condition", F.col("read") % 5).withColumn("g", F.col("read") % 25)
    return reads.by_condition(reads.allele_summary(votes, ["Condition", "g"]))


@query("SELECT Base, avg(p) AS mean, coalesce(stddev_samp(p), 0.0) AS std, CAST(sum(n) AS BIGINT) AS n FROM (SELECT Base, file, 100.0 * count(*) FILTER (status = 'F') / count(*) AS p, count(*) AS n FROM v_assay GROUP BY ALL) GROUP BY Base", "mean std")
def a4_replicates(d):
    per = d.v_assay.groupBy("Base", "file").agg((100.0 * F.count_if(F.col("status") == "F") / F.count("*")).alias("p"), F.count("*").alias("n"))
    return reads.replicate_summary(per, ["Base"], "p", ["n"])


@query("SELECT label, avg(embedding[1]) AS e2, avg(embedding[2]) AS e10 FROM embeddings GROUP BY label", "e2 e10")
def a5_mean_cols(d):
    e = d.embeddings.select("label", F.get("embedding", F.lit(0)).cast("double").alias("e2"), F.get("embedding", F.lit(1)).cast("double").alias("e10"))
    return reads.mean_cols(e, ["label"], "^e[0-9]+$")


@query("SELECT sample, count(*) AS n_reads, avg(l) AS mean_length, quantile_cont(l, 0.5) AS median_length, min(l) AS min_length, max(l) AS max_length, avg(q) AS mean_quality, max(n) AS n50 FROM (SELECT sample, l, q, CASE WHEN 2 * sum(l) OVER (PARTITION BY sample ORDER BY l DESC RANGE UNBOUNDED PRECEDING) >= sum(l) OVER (PARTITION BY sample) THEN l END AS n FROM (SELECT source AS sample, length(seq) AS l, list_avg(list_transform(string_split(seq, ''), lambda c: ascii(c) - 33)) AS q FROM v_seq)) GROUP BY sample", "mean_length median_length mean_quality")
def a6_a7_fastq_qc(d):
    return reads.fastq_qc(d.v_seq.select(F.col("source").alias("sample"), "seq", F.col("seq").alias("qual")))


@query(f"SELECT probe, read FROM ({_HIT})")
def j10_on_target(d):
    return intervals.on_target_reads(d.v_read, intervals.probe_windows(d.v_window), 64)


@query(f"SELECT sample, count(*) AS n_reads, count(h.read) AS n_on_target, 100.0 * count(h.read) / count(*) AS rate FROM v_read r LEFT JOIN (SELECT DISTINCT read FROM ({_HIT})) h ON r.read = h.read GROUP BY sample", "rate")
def a8_on_target_rate(d):
    return intervals.on_target_rate(d.v_read, intervals.probe_windows(d.v_window), bucket=64)


@query("SELECT sample, count(*) AS raw, count(DISTINCT qname) AS dedup, count(DISTINCT qname) / count(*)::DOUBLE AS nrf FROM v_read GROUP BY sample", "nrf")
def a9_complexity(d):
    from quillon.functions.scalar import safe_ratio

    return d.v_read.groupBy("sample").agg(F.count("*").alias("raw"), F.count_distinct("qname").alias("dedup")).withColumn("nrf", safe_ratio(F.col("dedup"), F.col("raw")))


@query(f"SELECT w.probe, w.pos, count(r.read) AS n FROM (SELECT probe, contig, strand, unnest(range(w0, w1 + 1)) AS pos FROM ({_W})) w LEFT JOIN v_read r ON r.contig = w.contig AND w.strand = CASE WHEN r.reverse THEN '+' ELSE '-' END AND CASE WHEN r.reverse THEN r.end0 - 1 ELSE r.start0 END = w.pos GROUP BY ALL")
def a10_start_profile(d):
    return intervals.start_profile(d.v_read, intervals.probe_windows(d.v_window))


@query("SELECT probe, coalesce(bool_or(peak >= 3 AND peak > coalesce(bg, 0) + 2), false) AS accepted FROM (SELECT dataset, probe, max(CASE WHEN in_bin THEN n END) AS peak FROM (SELECT o_orderstatus AS dataset, o_custkey % 50 AS probe, o_orderkey % 3 = 0 AS in_bin, o_orderkey % 9 AS n FROM orders) GROUP BY ALL) p JOIN (SELECT dataset AS d2, probe AS p2, min(n) AS bg FROM (SELECT *, rank() OVER (PARTITION BY dataset, probe ORDER BY c DESC) AS r FROM (SELECT o_orderstatus AS dataset, o_custkey % 50 AS probe, o_orderkey % 9 AS n, count(*) AS c FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL)) WHERE r = 1 GROUP BY ALL) b ON p.dataset = d2 AND p.probe = p2 GROUP BY probe")
def a11_probe_status(d):
    prof = d.orders.select(F.col("o_orderstatus").alias("dataset"), (F.col("o_custkey") % 50).alias("probe"), (F.col("o_orderkey") % 3 == 0).alias("in_bin"), (F.col("o_orderkey") % 9).alias("n"))
    return intervals.probe_status(prof)


@query("SELECT w.probe, w.pos, count(r.read) AS depth FROM (SELECT probe, contig, unnest(range(start1, end1)) AS pos FROM v_window) w LEFT JOIN v_read r ON r.contig = w.contig AND r.start0 <= w.pos AND w.pos < r.end0 GROUP BY ALL")
def a12_coverage(d):
    w = d.v_window.select("probe", "contig", F.col("start1").alias("w0"), F.col("end1").alias("w1"))
    return intervals.coverage(d.v_read, w)


@query("SELECT a.read, s.pos, CASE WHEN s.pos - a.start0 < 5 THEN substr(a.seq, CAST(s.pos - a.start0 AS INT) + 3, 1) WHEN s.pos - a.start0 < 8 THEN '-' ELSE substr(a.seq, CAST(s.pos - a.start0 AS INT), 1) END AS base FROM (SELECT q.read, 'A' AS contig, q.read * 7 % 9000 AS start0, q.read * 7 % 9000 + 18 AS end0, q.seq FROM v_seq q) a JOIN (SELECT * FROM v_snp WHERE contig = 'A') s ON s.pos >= a.start0 AND s.pos < a.end0")
def a13_base_at(d):
    a = d.v_seq.select("read", F.lit("A").alias("contig"), (F.col("read") * 7 % 9000).alias("start0"), (F.col("read") * 7 % 9000 + 18).alias("end0"), F.lit("2S5M3D10M").alias("cigar"), "seq")
    return reads.base_at(a, d.v_snp).select("read", "pos", "base")


@query(f"SELECT read, count(*) FILTER (base = base1) AS n_ref, count(*) FILTER (base <> base1) AS n_alt, 100.0 * count(*) FILTER (base <> base1) / count(*) AS percent_alt FROM ({_CALLS}) WHERE base <> 'N' AND query <> 0 GROUP BY read", "percent_alt")
def a15_pileup(d):
    return reads.pileup_counts(_calls(d).withColumnRenamed("base1", "ref"))


@query("SELECT sample, count(*) AS total, count(*) FILTER (f & 4 = 0) AS mapped, count(*) FILTER (f & 1 <> 0 AND f & 2 <> 0 AND f & 4 = 0) AS proper_pair, count(*) FILTER (f & 1 <> 0 AND f & 4 = 0 AND f & 8 = 0) AS both_mapped, count(*) FILTER (f & 1 <> 0 AND f & 4 = 0 AND f & 8 <> 0) AS singletons, CAST(sum(CASE WHEN f & 4 = 0 THEN end0 - start0 ELSE 0 END) AS BIGINT) AS bases_mapped, 100.0 * count(*) FILTER (f & 4 = 0) / count(*) AS mapped_percent, 100.0 * count(*) FILTER (f & 1 <> 0 AND f & 2 <> 0 AND f & 4 = 0) / count(*) AS proper_pair_percent, 100.0 * count(*) FILTER (f & 1 <> 0 AND f & 4 = 0 AND f & 8 <> 0) / count(*) AS singletons_percent, sum(CASE WHEN f & 4 = 0 THEN end0 - start0 ELSE 0 END) / 20000.0::DOUBLE AS mean_coverage FROM (SELECT *, CAST(qname % 16 AS INT) AS f FROM v_read) GROUP BY sample", "mapped_percent proper_pair_percent singletons_percent mean_coverage")
def a16_flags(d):
    return reads.flag_summary(d.v_read.withColumn("flag", (F.col("qname") % 16).cast("int")), length=20000)


@query("SELECT read, CASE WHEN b IS NULL THEN 'MissingAdapters' WHEN length(b) - 6 > 50 THEN 'Success' ELSE 'TooShort' END AS status, left(b, 6) AS umi FROM (SELECT read, CASE WHEN a > 0 AND instr(substr(s, a + 3), 'TAC') > 0 THEN substr(s, a + 3, instr(substr(s, a + 3), 'TAC') - 1) END AS b FROM (SELECT read, s, instr(s, 'GCA') AS a FROM (SELECT read, CASE WHEN contains(seq, 'GCA') THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS s FROM v_seq)))")
def a17_trim(d):
    return reads.trim_umi(d.v_seq, "GCA", "TAC").select("read", "status", "umi")


@query("SELECT c AS origin, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / t, 2) AS percent, round(100.0 * coalesce(n, 0) / 20000, 2) AS percent_of_all FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(c) LEFT JOIN (SELECT status, count(*) AS n FROM v_assay GROUP BY status) q ON q.status = c CROSS JOIN (SELECT count(*) AS t FROM v_assay)")
def a18_categories(d):
    return reads.origin_summary(d.v_assay.withColumnRenamed("status", "origin"), ["F", "O", "P", "X"], all_reads=20000)


_EVID = "SELECT qname AS read, CASE WHEN supp % 5 = 0 THEN 'ncrna' ELSE 'genome' END AS source, contig, mapq, CAST(supp % 7 AS BIGINT) AS locus FROM v_read"


@query("SELECT o_orderkey AS read, coalesce(h.contig, '') AS best_contig, coalesce(h.mapq, -1) AS best_mapq FROM orders LEFT JOIN (SELECT * FROM (SELECT qname, contig, mapq, row_number() OVER (PARTITION BY qname ORDER BY mapq DESC, end0 - start0 DESC, contig DESC) AS r FROM v_read) WHERE r = 1) h ON h.qname = o_orderkey")
def a19_best_hit(d):
    hits = d.v_read.select(F.col("qname").alias("read"), "contig", "mapq", (F.col("end0") - F.col("start0")).alias("length"))
    return reads.best_hit(hits, d.orders.select(F.col("o_orderkey").alias("read")))


@query("SELECT qname AS read, max(mapq) AS max_mapq, max(mapq) < 5 AS low_mapq FROM v_read GROUP BY qname")
def a20_max_mapq(d):
    return reads.max_mapq(d.v_read.select(F.col("qname").alias("read"), "mapq"), 5)


@query(f"SELECT o.read, CASE WHEN assigned THEN 'assigned' WHEN l1 THEN 'locus1' WHEN l2 THEN 'locus2' WHEN x AND q >= 5 THEN 'special' WHEN q >= 5 THEN 'other' WHEN q IS NOT NULL THEN 'low_mapq' WHEN nc THEN 'ncRNA' ELSE 'unresolved' END AS origin FROM (SELECT o_orderkey AS read, o_orderkey % 10 = 0 AS assigned FROM orders) o LEFT JOIN (SELECT read, max(mapq) FILTER (source = 'genome') AS q, coalesce(bool_or(source = 'genome' AND locus = 1), false) AS l1, coalesce(bool_or(source = 'genome' AND locus = 2), false) AS l2, coalesce(bool_or(source = 'genome' AND contig = 'R'), false) AS x, bool_or(source <> 'genome') AS nc FROM ({_EVID}) GROUP BY read) e ON o.read = e.read")
def j22_origin(d):
    e = d.v_read.select(F.col("qname").alias("read"), F.when(F.col("supp") % 5 == 0, "ncrna").otherwise("genome").alias("source"), "contig", "mapq", (F.col("supp") % 7).alias("locus"))
    o = d.orders.select(F.col("o_orderkey").alias("read"), (F.col("o_orderkey") % 10 == 0).alias("assigned"))
    return reads.origin(o, e, "R", 5).select("read", "origin")


@query("SELECT DISTINCT r.read, w.probe AS gene FROM v_read r JOIN v_window w ON r.contig = w.contig AND w.start1 <= r.end0 AND w.end1 >= r.start0 + 1")
def j11_gene_overlap(d):
    b = d.v_read.select("read", "contig", (F.col("start0") + 1).alias("b0"), F.col("end0").alias("b1"))
    e = d.v_window.select(F.col("probe").alias("gene"), "contig", F.col("start1").alias("e0"), F.col("end1").alias("e1"))
    return intervals.gene_overlap(b, e, 128)


@query("SELECT DISTINCT r.read, w.probe AS locus FROM v_read r JOIN v_window w ON r.contig = w.contig AND r.start0 < w.end1 AND r.end0 > w.start1 - 1")
def j12_locus(d):
    loci = d.v_window.select(F.col("probe").alias("locus"), "contig", F.col("start1").alias("s"), F.col("end1").alias("e"))
    return intervals.hits_locus(d.v_read, loci)


@query("SELECT p.probe, CASE WHEN ex AND it THEN 'exon-intron' WHEN ex THEN 'exon' WHEN it THEN 'intron' ELSE 'intergenic' END AS region_type FROM (SELECT probe, EXISTS (SELECT 1 FROM v_window e WHERE e.size > 40 AND e.contig = w.contig AND e.start1 <= w.end1 AND w.start1 <= e.end1) AS ex, EXISTS (SELECT 1 FROM v_window e WHERE e.size < 10 AND e.contig = w.contig AND e.start1 <= w.end1 AND w.start1 <= e.end1) AS it FROM v_window w) p")
def j13_region_type(d):
    part = lambda c: d.v_window.filter(c).select("contig", F.col("start1").alias("i0"), F.col("end1").alias("i1"))
    p = d.v_window.select("probe", "contig", F.col("start1").alias("p0"), F.col("end1").alias("p1"))
    return intervals.region_type(p, part("size > 40"), part("size < 10")).select("probe", "region_type")


@query("SELECT w.probe AS region, count(s.pos) AS n_snps, coalesce(string_agg(concat(s.contig, ':', s.pos), ',' ORDER BY s.pos) FILTER (s.pos IS NOT NULL), '') AS snps, coalesce(string_agg(s.genotype, ',' ORDER BY s.pos), '') AS genotypes FROM v_window w LEFT JOIN v_snp s ON s.contig = w.contig AND s.pos BETWEEN w.start1 AND w.end1 GROUP BY w.probe")
def j14_snps_in_region(d):
    r = d.v_window.select(F.col("probe").alias("region"), "contig", F.col("start1").alias("r0"), F.col("end1").alias("r1"))
    return intervals.snps_in_region(r, d.v_snp).select("region", "n_snps", "snps", "genotypes")


@query("SELECT w.probe AS pair, count(s.pos) AS amplicon_snps, count(s.pos) FILTER (s.pos <= w.start1 + 9) AS left_snps, count(s.pos) FILTER (s.pos >= w.end1 + 90) AS right_snps FROM v_window w LEFT JOIN v_snp s ON s.contig = w.contig AND s.pos BETWEEN w.start1 AND w.end1 + 100 GROUP BY w.probe")
def j15_snp_counts(d):
    e = F.col("end1") + 100
    p = d.v_window.select(F.col("probe").alias("pair"), "contig", F.col("start1").alias("a0"), e.alias("a1"), F.col("start1").alias("l0"), (F.col("start1") + 9).alias("l1"), (e - 10).alias("r0"), e.alias("r1"))
    return intervals.snp_counts(p, d.v_snp).select("pair", "amplicon_snps", "left_snps", "right_snps")


@query("SELECT probe FROM v_window w WHERE size % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM v_snp s WHERE s.contig = w.contig AND s.pos BETWEEN w.start1 AND w.end1)")
def j16_no_snp(d):
    b = d.v_window.select("probe", "contig", F.col("start1").alias("b0"), F.col("end1").alias("b1"), F.when(F.col("size") % 3 == 0, "centre").otherwise("up").alias("side"))
    return intervals.no_snp_overlap(b, d.v_snp)


@query("SELECT DISTINCT g.probe AS gene, s.pos, CASE WHEN g.strand = '-' THEN g.end1 + 200 - s.pos ELSE s.pos - g.start1 END AS relative FROM v_window g JOIN v_snp s ON s.contig = g.contig AND s.pos BETWEEN g.start1 AND g.end1 + 200 WHERE s.pos BETWEEN g.start1 + 50 AND g.start1 + 150")
def j17_exonic_snps(d):
    g = d.v_window.select(F.col("probe").alias("gene"), "contig", "strand", F.col("start1").alias("g0"), (F.col("end1") + 200).alias("g1"))
    e = d.v_window.select(F.col("probe").alias("gene"), (F.col("start1") + 50).alias("e0"), (F.col("start1") + 150).alias("e1"))
    return intervals.exonic_snps(g, e, d.v_snp)


@query("SELECT read, p_partkey AS plate FROM (SELECT read, p.p_partkey, row_number() OVER (PARTITION BY read ORDER BY p.p_partkey) AS r FROM v_seq LEFT JOIN (SELECT p_partkey, translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtac') AS k FROM part) p ON length(k) >= 1 AND contains(seq, upper(substr(k, 1, 6)))) WHERE r = 1")
def j18_substring_lookup(d):
    p = d.part.select(F.col("p_partkey").alias("plate"), F.substring(F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz ", "acgtacgtacgtacgtacgtacgtac"), 1, 6).alias("needle"))
    return intervals.substring_lookup(d.v_seq.select("read", "seq"), "seq", p, "needle", ["plate"], 6).select("read", "plate")


@query("SELECT w.probe, count(s.pos) AS n FROM v_window w LEFT JOIN v_snp s ON s.contig = w.contig AND s.pos BETWEEN w.start1 AND w.end1 GROUP BY w.probe")
def range_join_counts(d):
    w = d.v_window.select("probe", "contig", "start1", "end1")
    s = d.v_snp.select("contig", F.col("pos").alias("s0"), F.col("pos").alias("s1"))
    return intervals.overlap_counts(w, s, "probe", ("start1", "end1"), ("s0", "s1"), ["contig"]).select("probe", "n")


def _exons(d):
    return d.v_window.select(F.col("gene").alias("tx"), F.lit("+").alias("strand"), F.col("start1").alias("e0"), (F.col("start1") + F.col("size") % 8).alias("e1"))


_EX = "SELECT gene AS tx, start1 AS e0, start1 + size % 8 AS e1 FROM v_window"


@query(f"SELECT tx, e1 + 1 AS i0, n - 1 AS i1 FROM (SELECT tx, e1, lead(e0) OVER (PARTITION BY tx ORDER BY e0, e1) AS n FROM ({_EX})) WHERE e1 + 1 <= n - 1")
def w20_introns(d):
    return intervals.introns(_exons(d))


@query(f"SELECT tx, e0, CAST(sum(e1 - e0 + 1) OVER (PARTITION BY tx ORDER BY e0 ROWS UNBOUNDED PRECEDING) - (e1 - e0 + 1) AS BIGINT) AS c0, CAST(sum(e1 - e0 + 1) OVER (PARTITION BY tx ORDER BY e0 ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS c1 FROM ({_EX})")
def w21_cdna(d):
    return intervals.cdna_segments(_exons(d)).select("tx", "e0", "c0", "c1")


@query(f"SELECT p.tx, p.c, s.e0 + p.c - s.c0 AS g FROM (SELECT DISTINCT gene AS tx, size * 5 AS c FROM v_window) p LEFT JOIN (SELECT tx, e0, CAST(sum(e1 - e0 + 1) OVER (PARTITION BY tx ORDER BY e0 ROWS UNBOUNDED PRECEDING) - (e1 - e0 + 1) AS BIGINT) AS c0, CAST(sum(e1 - e0 + 1) OVER (PARTITION BY tx ORDER BY e0 ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS c1 FROM ({_EX})) s ON s.tx = p.tx AND p.c BETWEEN s.c0 AND s.c1")
def j38_map_coord(d):
    p = d.v_window.select(F.col("gene").alias("tx"), (F.col("size") * 5).alias("c")).distinct()
    return intervals.map_coord(p, intervals.cdna_segments(_exons(d))).select("tx", "c", "g")


@query("SELECT gene, j0, j1 FROM (SELECT kind AS gene, size AS j0, size + 1 AS j1, count(DISTINCT contig) AS n FROM v_window GROUP BY ALL) a JOIN (SELECT kind, count(DISTINCT contig) AS t FROM v_window GROUP BY kind) b ON kind = gene AND n = t WHERE j0 % 2 = 0")
def j37_common_junctions(d):
    j = d.v_window.select(F.col("kind").alias("gene"), F.col("contig").alias("tx"), F.col("size").alias("j0"), (F.col("size") + 1).alias("j1"))
    return intervals.common_junctions(j, j.filter("j0 % 2 = 0").select("gene", "j0", "j1").distinct())


@query("SELECT p.probe AS primer, count(s.snp) AS n_spanned, coalesce(bool_or(s.pos - p.start1 + 1 >= 5 AND p.end1 - s.pos >= 5 AND CASE WHEN p.strand = '+' THEN p.end1 - s.pos ELSE s.pos - p.start1 + 1 END >= 8), false) AS crosses FROM v_window p LEFT JOIN v_snp s ON s.contig = p.contig AND p.start1 <= s.pos AND p.end1 >= s.pos + 1 GROUP BY p.probe")
def j39_crosses(d):
    p = d.v_window.select(F.col("probe").alias("primer"), F.col("contig").alias("tx"), F.col("start1").alias("p0"), F.col("end1").alias("p1"), (F.col("strand") == "+").alias("forward"))
    return intervals.crosses(p, d.v_snp.select(F.col("contig").alias("tx"), F.col("pos").alias("j")), 5, 8).select("primer", "n_spanned", "crosses")


@query(f"SELECT tx, CAST(sum(e1 - e0 + 1) AS BIGINT) AS spliced_length, min(e0) AS gene_start, max(e1) AS gene_end FROM ({_EX}) GROUP BY tx")
def a70_transcript_lengths(d):
    return intervals.transcript_lengths(_exons(d))


@query("SELECT contig, start0, end0, span FROM (SELECT s.contig, s.start0, max(e.end0) AS end0, max(e.end0) - s.start0 AS span, count(*) AS n FROM (SELECT DISTINCT contig, pos AS start0 FROM v_snp) s JOIN (SELECT a.contig, a.start0, b.g, min(b.end0) AS end0 FROM (SELECT DISTINCT contig, pos AS start0 FROM v_snp) a JOIN (SELECT contig, snp % 3 AS g, pos AS p0, pos + 20 AS end0 FROM v_snp) b ON a.contig = b.contig AND b.p0 >= a.start0 GROUP BY ALL) e ON e.contig = s.contig AND e.start0 = s.start0 GROUP BY s.contig, s.start0) WHERE n = 3 AND span <= 2000 ORDER BY span, contig, start0 LIMIT 1")
def j33_coherent_target(d):
    h = d.v_snp.select((F.col("snp") % 3).alias("guide"), "contig", F.col("pos").alias("start0"), (F.col("pos") + 20).alias("end0"))
    return intervals.coherent_target(h, 2000)


@query("SELECT g.read AS guide, t.read AS contig, CAST(i - 1 AS BIGINT) AS start0, '+' AS strand FROM (SELECT read, substr(seq, 31, 24) AS g FROM v_seq WHERE length(seq) >= 60) g JOIN (SELECT read, seq, unnest(range(1, length(seq) - 22)) AS i FROM v_seq) t ON substr(t.seq, i, 24) = g.g UNION SELECT g.read, t.read, CAST(i - 1 AS BIGINT), '-' FROM (SELECT read, reverse(translate(substr(seq, 31, 24), 'ACGT', 'TGCA')) AS g FROM v_seq WHERE length(seq) >= 60) g JOIN (SELECT read, seq, unnest(range(1, length(seq) - 22)) AS i FROM v_seq) t ON substr(t.seq, i, 24) = g.g")
def j34_placed(d):
    g = d.v_seq.filter("length(seq) >= 60").select(F.col("read").alias("guide"), F.substring("seq", 31, 24).alias("seq"))
    out = intervals.placed(g, d.v_seq.select(F.col("read").alias("contig"), "seq"))
    return out.withColumn("start0", F.col("start0").cast("long"))


@query("SELECT p.probe AS primer, count(h.l) FILTER (h.l >= least(20, 18 + p.size % 5) AND h.i >= 90) AS n_perfect, count(h.l) FILTER (NOT (h.l >= least(20, 18 + p.size % 5) AND h.i >= 90) AND h.l >= 15) AS n_noise FROM v_window p LEFT JOIN (SELECT l_partkey, CAST(l_quantity AS INT) AS l, 80 + l_suppkey % 21 AS i FROM lineitem) h ON h.l_partkey = p.probe GROUP BY p.probe")
def j35_specificity(d):
    p = d.v_window.select(F.col("probe").alias("primer"), F.expr("repeat('A', cast(18 + size % 5 as int))").alias("seq"))
    h = d.lineitem.select(F.col("l_partkey").alias("primer"), F.col("l_quantity").cast("int").alias("length"), (80 + F.col("l_suppkey") % 21).alias("pident"))
    return design.specificity(p, h, 90, 20, 15).select("primer", "n_perfect", "n_noise")


_SPANS = " UNION ALL ".join(f"SELECT contig, pos AS s0, lead(pos, {n - 1}) OVER (PARTITION BY contig ORDER BY pos) AS s1, {n} AS n FROM v_snp" for n in range(3, 8))


@query(f"SELECT contig, s0, s1, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY s1 - s0, n DESC, s0) AS r FROM (SELECT contig, s0, s1, max(n) AS n FROM ({_SPANS}) WHERE s1 IS NOT NULL GROUP BY ALL)) WHERE r <= 10")
def j36_target_spans(d):
    return design.target_spans(d.v_snp, 3, 10, "contig").select("contig", "s0", "s1", "n")


def _samples(d):
    """A sample map of one row a nation, with barcodes from its name."""
    code = lambda i: F.translate(F.substring(F.md5("n_name"), i, 8), "0123456789abcdef", "ACGTACGTACGTACGT")
    return reads.load_sample_map(d.nation.select(F.col("n_name").alias("SampleName"), code(1).alias("P7_Barcode"), code(9).alias("P5_Barcode")))


_CODE = "translate(substr(md5(n_name), {}, 8), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_BEST = "min(struct_pack(d := hamming({0}, {1}), a := abs(o), o := o, w := {0})) FILTER ({0} IS NOT NULL)"
_DEMUX = f"""
WITH s AS (
  SELECT read, upper(seq) AS s, 'forward' AS orientation FROM v_seq
  UNION ALL SELECT read, reverse(translate(upper(seq), 'ACGT', 'TGCA')), 'reverse' FROM v_seq),
f AS (SELECT *, instr(s, 'GCA') - 1 AS a, length(s) - instr(reverse(s), 'CAT') - 2 AS b FROM s WHERE contains(s, 'GCA') AND contains(s, 'TAC')),
m AS (SELECT n_name AS sample, {_CODE.format(1)} AS i7, {_CODE.format(9)} AS i5 FROM nation),
w AS (SELECT read, orientation, o, CASE WHEN a - 8 + o >= 0 AND a + o <= length(s) THEN substr(s, a - 8 + o + 1, 8) END AS w7,
             CASE WHEN b + 3 + o >= 0 AND b + 11 + o <= length(s) THEN substr(s, b + 3 + o + 1, 8) END AS w5
      FROM f, (SELECT unnest(range(-2, 3)) AS o)),
c AS (SELECT read, orientation, sample, i7, i5, {_BEST.format("w7", "i7")} AS b7, {_BEST.format("w5", "i5")} AS b5 FROM w, m GROUP BY ALL),
p AS (SELECT *, b7.d + b5.d AS distance, rank() OVER (PARTITION BY read ORDER BY b7.d + b5.d, b7.a + b5.a) AS k
      FROM c WHERE b7.d + b5.d <= 4),
g AS (SELECT read, count(*) AS n, min(struct_pack(sample := sample, orientation := orientation, distance := distance, i7 := i7, i5 := i5,
             word7 := b7.w, word5 := b5.w, offset7 := b7.o, offset5 := b5.o)) AS x FROM p WHERE k = 1 GROUP BY read)
SELECT v.read, CASE WHEN a.read IS NULL THEN 'unrecognized' WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'assigned' END AS status,
       CASE WHEN n = 1 THEN x.sample END AS sample, CASE WHEN n = 1 THEN x.orientation END AS orientation, CASE WHEN n = 1 THEN x.distance END AS distance,
       x.i7 AS i7, x.i5 AS i5, CASE WHEN n = 1 THEN x.word7 END AS word7, CASE WHEN n = 1 THEN x.word5 END AS word5,
       CASE WHEN n = 1 THEN x.offset7 END AS offset7, CASE WHEN n = 1 THEN x.offset5 END AS offset5
FROM v_seq v LEFT JOIN (SELECT DISTINCT read FROM f) a ON a.read = v.read LEFT JOIN g ON g.read = v.read
"""
_COUNT = "SELECT '{0}' AS Section, {1} AS Key, count(*) AS Value FROM d WHERE {2} GROUP BY ALL"
_SUMMARY = f"""
WITH d AS ({_DEMUX}), o AS (
  SELECT count(*) AS total_reads, count(*) FILTER (status = 'assigned') AS assigned, CAST(0 AS BIGINT) AS matched_blank_sample,
         count(*) FILTER (status = 'unrecognized') AS unrecognized_structure, count(*) FILTER (status = 'unmatched') AS unmatched_barcode,
         count(*) FILTER (status = 'ambiguous') AS ambiguous_barcode FROM d),
b AS (SELECT i7, i5, status, count(*) AS n FROM d WHERE i7 IS NOT NULL GROUP BY ALL)
SELECT 'overall' AS Section, Key, Value FROM (UNPIVOT o ON COLUMNS(*) INTO NAME Key VALUE Value)
UNION ALL {_COUNT.format("orientation", "orientation", "status = 'assigned'")}
UNION ALL {_COUNT.format("barcode_mismatches", "CAST(distance AS VARCHAR)", "status = 'assigned'")}
UNION ALL {_COUNT.format("barcode_offsets", "concat('P7=', offset7, ';P5=', offset5)", "status = 'assigned'")}
UNION ALL {_COUNT.format("sample", "sample", "status = 'assigned'")}
UNION ALL SELECT 'canonical_pair', concat_ws(',', i7, i5, string_agg(concat(CASE WHEN status = 'assigned' THEN 'matched' ELSE status || '_barcode' END, ':', n), ';' ORDER BY status DESC)),
       CAST(sum(n) FILTER (status = 'assigned') AS BIGINT) FROM b GROUP BY i7, i5 HAVING count(*) FILTER (status = 'assigned') > 0
UNION ALL SELECT * FROM ({_COUNT.format("observed_pair", "concat_ws(',', word7, word5)", "status = 'assigned'")} ORDER BY Value DESC, Key LIMIT 100)
"""


@query(_DEMUX)
def j19_j20_demultiplex(d):
    return reads.demultiplex(d.v_seq.select("read", "seq"), _samples(d), "GCA", "TAC", 4)


@query(_SUMMARY)
def s24_demux_summary(d):
    return reads.demux_summary(reads.demultiplex(d.v_seq.select("read", "seq"), _samples(d), "GCA", "TAC", 4), matched_first=True)


@query("SELECT DISTINCT lang AS sample, CAST(doc_id AS VARCHAR) AS read_id FROM documents")
def s5_read_ids(d):
    return reads.read_ids(d.documents.select(F.col("lang").alias("sample"), F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit("/1 x:y")).alias("header")))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b, a.n / b.n::DOUBLE AS ratio FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k", "ratio")
def a68_count_ratio(d):
    one = lambda s: d.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return reads.count_ratio(one("F"), one("O"), "k")


@query("SELECT s_suppkey AS cell, CAST(coalesce(c, 0) AS BIGINT) AS count FROM supplier LEFT JOIN (SELECT cell, sum(count) AS c FROM v_expr WHERE gene = 7 GROUP BY cell) e ON e.cell = s_suppkey")
def s20_gene_expression(d):
    genes = d.part.select(F.col("p_partkey").alias("gene"), "p_brand")
    return reads.gene_expression(d.v_expr, d.supplier.select(F.col("s_suppkey").alias("cell")), genes, 7).select("cell", "count")


# --- design ---------------------------------------------------------------------------------------------------

_E = ", ".join(f"('{k}', {v})" for k, v in design.DIMER_ENERGY.items())
_DIMERS = f"SELECT read AS gene, i AS start, e.e::DOUBLE AS e FROM (SELECT read, seq, unnest(range(0, length(seq) - 1)) AS i FROM v_seq) d JOIN (VALUES {_E}) e(k, e) ON e.k = substr(d.seq, CAST(d.i AS INT) + 1, 2)"
_SUMS = " UNION ALL ".join(f"SELECT gene, start, {n} AS length, sum(e) OVER w{n} AS s, count(*) OVER w{n} AS n FROM m WINDOW w{n} AS (PARTITION BY gene ORDER BY start ROWS BETWEEN CURRENT ROW AND {n - 2} FOLLOWING)" for n in (26, 28))
_DG = f"WITH m AS ({_DIMERS}) SELECT gene, start, length, s - ((ln(0.115::DOUBLE) * -0.175) - 0.2) AS dg, 1 - 0.1 * abs(s - ((ln(0.115::DOUBLE) * -0.175) - 0.2) + 32) AS score FROM ({_SUMS}) WHERE n = length - 1"


@query(f"SELECT gene, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, dg, score FROM ({_DG})", "dg score")
def w8_rolling_dg(d):
    out = design.rolling_dg(d.v_seq.select(F.col("read").alias("gene"), "seq"), [26, 28])
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "length")})


_SCORES = "WITH m AS ({0}) SELECT gene, start, length, s - ((ln(0.115::DOUBLE) * -0.175) - 0.2) AS dg, 1 - 0.1 * abs(s - ((ln(0.115::DOUBLE) * -0.175) - 0.2) + 32) AS score FROM ({1}) WHERE n = length - 1".format(
    _DIMERS, " UNION ALL ".join(f"SELECT gene, start, {n} AS length, sum(e) OVER w{n} AS s, count(*) OVER w{n} AS n FROM m WINDOW w{n} AS (PARTITION BY gene ORDER BY start ROWS BETWEEN CURRENT ROW AND {n - 2} FOLLOWING)" for n in range(26, 33))
)


@query(f"SELECT gene, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, score FROM (SELECT *, row_number() OVER (PARTITION BY gene, start ORDER BY round(score, 9) DESC, length) AS r FROM ({_SCORES})) WHERE r = 1 AND score >= 0.9", "score")
def w9_best_length(d):
    out = design.best_windows(d.v_seq.select(F.col("read").alias("gene"), "seq"), range(26, 33))
    return out.select("gene", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.round("score", 6).alias("score"))


#: Candidates, each with the next one that is free behind it; the chain from the first one of a gene.
_SPACED = f"""
WITH RECURSIVE c AS (
  SELECT gene, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length
  FROM (SELECT *, row_number() OVER (PARTITION BY gene, start ORDER BY round(score, 9) DESC, length) AS r FROM ({_SCORES})) WHERE r = 1 AND round(score, 9) >= 0.9),
n AS (SELECT a.gene, a.start, a.length, b.start AS following FROM (SELECT *, start + length + 2 AS free FROM c) a ASOF LEFT JOIN c b ON a.gene = b.gene AND a.free <= b.start),
w AS (
  SELECT gene, start, length, following FROM n WHERE start = (SELECT min(start) FROM c WHERE c.gene = n.gene)
  UNION ALL SELECT n.gene, n.start, n.length, n.following FROM w JOIN n ON n.gene = w.gene AND n.start = w.following)
SELECT gene, start, length FROM w
"""


@query(_SPACED)
def w9_w10_spacing(d):
    return design.greedy_spacing(design.best_windows(d.v_seq.select(F.col("read").alias("gene"), "seq"), range(26, 33)), 2)


@query(None)
def k14_design_probes(d):
    contig = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("read") % 3 + 1).cast("int"))
    genes = d.v_seq.select(F.col("read").alias("gene"), contig.alias("contig"), F.when(F.col("read") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("read") * 20).alias("g0"), "seq")
    part = lambda c: d.v_window.filter(c).select("contig", F.col("start1").alias("i0"), F.col("end1").alias("i1"))
    return design.design_probes(genes, part("size > 30"), part("size < 10"))


#: Whole sequences in tiles of 20 letters; a pair is a tile and the one three further on.
_TILES = "SELECT read, fov, seq, CAST(t AS BIGINT) AS tile FROM (SELECT read, fov, seq, unnest(range(0, CAST(floor(length(seq) / 20.0) AS BIGINT))) AS t FROM v_seq)"
_TILE = "substr(seq, CAST(tile * 20 + {} AS INT), 20)"


def _tiles(d, *ahead):
    """(read, fov, tile, w0, ...): whole pieces of 20 letters by their numbers, each with the pieces so many further on."""
    own = d.v_seq.select("read", "fov", pieces_of(F.col("seq"), 20).alias("w"))
    more = [F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))).alias(f"w{k}") for k in ahead]
    at = own.select("read", "fov", F.posexplode(F.arrays_zip(F.col("w").alias("w0"), *more)).alias("tile", "at"))
    return at.select("read", "fov", F.col("tile").cast("long").alias("tile"), "at.*").filter("length(w0) = 20")


def _pairs(d):
    k = F.col("read") + F.col("tile")
    return _tiles(d, 3).filter("length(w3) = 20").select(
        (F.col("read") * 100_000 + F.col("tile")).alias("pair"), F.concat_ws("-", "fov", (F.col("read") % 50).cast("string")).alias("gene"), F.col("w0").alias("left_seq"), F.col("w3").alias("right_seq"),
        (57 + k % 7).cast("double").alias("left_tm"), (57 + k % 5).cast("double").alias("right_tm"), (50 + k % 260).alias("amplicon_size"), (k % 3 != 0).alias("specific"),
        (k % 4).alias("left_hits"), (k % 7 - 1).alias("right_hits"), (-(k % 11)).cast("double").alias("dg"), (k % 13 != 0).alias("on_target"), (k % 8).alias("n_snps"), (k % 9 == 0).alias("overlaps_snp"),
    )


_GC = "((20 - length(translate({0}, 'GC', ''))) / 20.0::DOUBLE)"
_BOTH = "({0} BETWEEN {2} AND {3} AND {1} BETWEEN {2} AND {3})"
_RUN5 = "regexp_matches({}, 'A{{5}}|C{{5}}|G{{5}}|T{{5}}')"
_ALTERNATING = "regexp_matches({}, '" + "|".join(f"({x}{y}){{{{4}}}}" for x in "ACGT" for y in "ACGT" if x != y) + "')"
_LONGEST = "len(list_filter(range(1, 21), lambda n: len(list_filter(range(1, 22 - n), lambda i: contains({1}, substr({0}, i, n)))) > 0))"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_HARD = {
    "target": "NOT on_target",
    "snps": "n_snps < 1",
    "overlaps_snp": "overlaps_snp",
    "length": "NOT (length(l) BETWEEN 18 AND 30 AND length(r) BETWEEN 18 AND 30)",
    "homopolymer": f"{_RUN5.format('l')} OR {_RUN5.format('r')}",
    "quad_g": "contains(l, 'GGGG') OR contains(r, 'GGGG')",
    "dinucleotide": f"{_ALTERNATING.format('l')} OR {_ALTERNATING.format('r')}",
    "clamp": "right(l, 1) NOT IN ('G', 'C') OR right(r, 1) NOT IN ('G', 'C')",
    "inter_primer": "run > 4",
    "dtm": "abs(tl - tr) > 2",
    "thermo": "dg <= -9",
}
_RELAXED = "(specific OR (left_hits >= 1 AND right_hits >= 1))"
_TIGHT = f"{_BOTH.format(_GC.format('l'), _GC.format('r'), 0.4, 0.6)} AND {_BOTH.format('tl', 'tr', 58, 62)}"
_WIDE = f"{_BOTH.format(_GC.format('l'), _GC.format('r'), 0.3, 0.7)} AND {_BOTH.format('tl', 'tr', 55, 65)}"
_SOFT = {"amplicon": "NOT size BETWEEN 80 AND 200", "specificity": "NOT specific", "relaxed_specificity": f"NOT {_RELAXED}", "gc_tm": f"NOT ({_TIGHT})"}
_TIERED = f"""
SELECT *, concat_ws(';', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in (_HARD | _SOFT).items())}) AS reasons,
       CASE WHEN {" OR ".join(f"({c})" for c in _HARD.values())} THEN 'failed'
            WHEN size BETWEEN 80 AND 200 AND specific AND {_TIGHT} THEN 'strict_all' WHEN size BETWEEN 60 AND 300 AND specific AND {_TIGHT} THEN 'relaxed_amplicon'
            WHEN size BETWEEN 60 AND 300 AND {_RELAXED} AND {_TIGHT} THEN 'relaxed_specificity'
            WHEN size BETWEEN 60 AND 300 AND {_RELAXED} AND {_WIDE} THEN 'relaxed_gc_tm' ELSE 'failed' END AS tier
FROM (SELECT *, {_LONGEST.format("l", _RC.format("r"))} AS run
      FROM (SELECT read * 100000 + tile AS pair, concat(fov, '-', read % 50) AS gene, {_TILE.format(1)} AS l, {_TILE.format(61)} AS r, 57.0::DOUBLE + (read + tile) % 7 AS tl,
                   57.0::DOUBLE + (read + tile) % 5 AS tr, 50 + (read + tile) % 260 AS size, (read + tile) % 3 <> 0 AS specific,
                   (read + tile) % 4 AS left_hits, (read + tile) % 7 - 1 AS right_hits, -CAST((read + tile) % 11 AS DOUBLE) AS dg, (read + tile) % 13 <> 0 AS on_target,
                   (read + tile) % 8 AS n_snps, (read + tile) % 9 = 0 AS overlaps_snp
            FROM ({_TILES}) WHERE length(seq) >= tile * 20 + 80))
"""


@query(f"SELECT pair, tier, reasons FROM ({_TIERED})")
def p25_primer_tier(d):
    return design.primer_tier(_pairs(d)).select("pair", "tier", "reasons")


@query(f"SELECT read, tile, concat_ws(';', CASE WHEN NOT g BETWEEN 0.4 AND 0.6 THEN 'gc' END, CASE WHEN NOT 50 + (read + tile) % 20 BETWEEN 55 AND 65 THEN 'tm' END, CASE WHEN right(s, 1) NOT IN ('G', 'C') THEN 'clamp' END, CASE WHEN regexp_matches(s, 'A{{5}}|C{{5}}|G{{5}}|T{{5}}') THEN 'homopolymer' END, CASE WHEN contains(s, 'GGGG') THEN 'quad_g' END, CASE WHEN (read + tile) % 4 > 0 THEN 'snp' END, CASE WHEN (read + tile) % 3 = 0 THEN 'specificity' END) AS reasons FROM (SELECT read, tile, {_TILE.format(1)} AS s, {_GC.format(_TILE.format(1))} AS g FROM ({_TILES}))")
def p26_score_primer(d):
    k = F.col("read") + F.col("tile")
    p = _tiles(d).select("read", "tile", F.col("w0").alias("seq"), (50 + k % 20).alias("tm"), (k % 4).alias("n_snps"), (k % 3 != 0).alias("specific"))
    return design.score_primer(p).select("read", "tile", "reasons")


@query("SELECT tx, CASE WHEN NOT starts_with(tx, 'NM_') THEN 'not_curated_refseq' WHEN n_exons < 2 THEN 'single_exon_or_no_exons' ELSE '' END AS reason FROM (SELECT concat(CASE WHEN p_size % 2 = 0 THEN 'NM_' ELSE 'XM_' END, p_partkey) AS tx, p_size % 4 AS n_exons FROM part)")
def p34_transcripts(d):
    tx = d.part.select(F.concat(F.when(F.col("p_size") % 2 == 0, "NM_").otherwise("XM_"), F.col("p_partkey").cast("string")).alias("tx"), (F.col("p_size") % 4).alias("n_exons"))
    return design.mark_transcripts(tx, ["NM_"]).select("tx", "reason")


def _probes(d):
    return d.v_window.select("gene", "probe", (F.col("size") % 4).alias("n_snps"), (F.col("size") % 6).alias("n_rules"), F.col("price").alias("score"), (F.col("size") / 100.0).alias("gc"))


@query("SELECT gene, probe, CAST(rank AS INTEGER) AS rank FROM (SELECT p.gene, p.probe, n_snps, row_number() OVER (PARTITION BY p.gene ORDER BY n_snps DESC, n_rules DESC, score DESC, p.probe) AS rank FROM (SELECT gene, probe, size % 4 AS n_snps, size % 6 AS n_rules, price AS score FROM v_window) p JOIN (SELECT gene, CASE WHEN c3 >= 30 THEN 3 WHEN c4 >= 30 THEN 4 WHEN c5 >= 30 THEN 5 ELSE 0 END AS level FROM (SELECT gene, count(*) FILTER (size % 6 >= 3) AS c3, count(*) FILTER (size % 6 >= 4) AS c4, count(*) FILTER (size % 6 >= 5) AS c5 FROM v_window GROUP BY gene)) l ON l.gene = p.gene WHERE n_rules >= level) WHERE rank <= 30 AND n_snps >= 1")
def o8_select_probes(d):
    return design.select_probes(_probes(d), 30, 1).select("gene", "probe", "rank")


@query("SELECT gene, count(*) AS n, round(avg(price), 2) AS mean_score, round(avg(size / 100.0::DOUBLE), 2) AS mean_gc, CAST(sum(size % 4) AS BIGINT) AS n_snps FROM v_window GROUP BY gene", "mean_score mean_gc")
def a69_gene_stats(d):
    return design.gene_stats(_probes(d))


@query("SELECT g.gene, CAST(coalesce(n, 0) AS BIGINT) AS candidates, CAST(coalesce(s, 0) AS BIGINT) AS selected, CAST(coalesce(k, 0) AS BIGINT) AS n_snps, CASE WHEN coalesce(s, 0) > 0 THEN 'success' ELSE 'failed' END AS status FROM (SELECT DISTINCT gene FROM v_window) g LEFT JOIN (SELECT gene, count(*) AS n, count(*) FILTER (size > 45) AS s, sum(size % 4) AS k FROM v_window GROUP BY gene) r ON r.gene = g.gene")
def a78_batch_summary(d):
    r = d.v_window.select("gene", F.col("kind").alias("tx"), F.lit("strict_all").alias("tier"), (F.col("size") > 45).alias("selected"), (F.col("size") % 4).alias("n_snps"))
    return design.batch_summary(d.v_window.select("gene").distinct(), r).select("gene", "candidates", "selected", "n_snps", "status")


_RANKED = f"""
SELECT gene, pair, tier, CAST(row_number() OVER (PARTITION BY gene ORDER BY list_position(['strict_all', 'relaxed_amplicon', 'relaxed_specificity', 'relaxed_gc_tm', 'failed'], tier),
       pair % 3, -(pair % 5), pair % 2, abs(tl - tr), size, pair) AS INTEGER) AS rank FROM ({_TIERED})
"""


@query(_RANKED)
def o4_rank_pairs(d):
    return design.rank_pairs(design.primer_tier(_pairs(d)).withColumns({"primer_snps": F.col("pair") % 3, "amplicon_snps": F.col("pair") % 5, "n_noise": F.col("pair") % 2, "dtm": F.abs(F.col("left_tm") - F.col("right_tm"))})).select("gene", "pair", "tier", "rank")


@query(f"SELECT read, tile, CAST({_LONGEST.format('x', _RC.format('y'))} AS INTEGER) AS run FROM (SELECT read, tile, {_TILE.format(1)} AS x, {_TILE.format(5)} AS y FROM ({_TILES}) WHERE length(seq) >= tile * 20 + 24)")
def f7_complement_run(d):
    other = F.substring(F.concat("w0", "w1"), 5, 20)
    return _tiles(d, 1).filter("length(w1) >= 4").select("read", "tile", complement_run(F.col("w0"), other).alias("run"))


@query(f"SELECT r.sample, r.n_reads, r.n_on_target, n.raw, n.dedup, coalesce(p.probes, 0) AS probes FROM (SELECT sample, count(*) AS n_reads, count(h.read) AS n_on_target FROM v_read r LEFT JOIN (SELECT DISTINCT read FROM ({_HIT})) h ON r.read = h.read GROUP BY sample) r JOIN (SELECT sample, count(*) AS raw, count(DISTINCT qname) AS dedup FROM v_read GROUP BY sample) n ON n.sample = r.sample LEFT JOIN (SELECT sample, count(*) AS probes FROM (SELECT sample, probe, count(*) AS n FROM ({_HIT}) h JOIN v_read r ON r.read = h.read GROUP BY ALL) WHERE n >= 3 GROUP BY sample) p ON p.sample = r.sample")
def k15_focused_report(d):
    out = composites.focused_report(d.v_read, intervals.probe_windows(d.v_window))
    return out.select("sample", "n_reads", "n_on_target", "raw", "dedup", "probes")


@query("SELECT CAST(regexp_extract(name, 'p([0-9]+)_', 1) AS VARCHAR) AS prefix, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n FROM (SELECT concat('p', track, '_') AS name, cell AS x, track % 3 AS y FROM v_track) GROUP BY ALL")
def a77_stack_groups(d):
    f = d.v_track.select(F.concat(F.lit("p"), "track", F.lit("_X"), "cell", F.lit("_Y"), (F.col("track") % 3).cast("string"), F.lit("_Z"), "frame").alias("name"))
    return stack_groups(f).select(F.substring("prefix", 2, 20).alias("prefix"), "x", "y", "n")
