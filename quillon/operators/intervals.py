"""Interval joins without nested loops, and what is built on them.

range_join deals both sides by buckets of a fixed width: each interval goes to the buckets it touches, buckets meet by
an equi-join, and the true condition filters. A pair is kept only in the first bucket that both touch, so it comes once.
Buckets that hold very many rows, as under one amplicon, are cut into blocks of both sides.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import initiation_window
from quillon.functions.sequence import revcomp, words_of
from quillon.operators.skew import BLOCK, skewed_join
from quillon.plans.storage import materialize


#: Intervals of more than so many buckets meet in buckets so many times as wide.
LONG = 16
#: Letters or places of a piece of a sequence or a window.
PIECE = 1024


def bucket_width(*sides: tuple[DataFrame, tuple[str, str]]) -> tuple[int, bool]:
    """The least power of two from 64 on that 95 % of the intervals don't exceed, and if some are longer than LONG of it."""
    width, most = 64, 0
    for df, (a, b) in sides:
        size = F.col(b) - F.col(a) + 1
        often, top = df.filter(F.col(a) <= F.col(b)).agg(F.percentile_approx(size, 0.95), F.max(size)).first()
        width, most = max(width, 1 << max(0, int(often or 1) - 1).bit_length()), max(most, int(top or 0))
    return width, most > LONG * width


def _bucketed(side: DataFrame, span: tuple[str, str], width: int) -> DataFrame:
    """A side with _bucket, once for each bucket that its intervals touch."""
    return side.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor(F.col(span[1]) / width))))


def range_join(
    left: DataFrame,
    right: DataFrame,
    l: tuple[str, str],
    r: tuple[str, str],
    on: Sequence[str] = (),
    bucket: int | None = 1024,
    how: str = "inner",
    block: int | None = BLOCK,
) -> DataFrame:
    """Closed intervals [l0, l1] and [r0, r1] that overlap, with equal columns on (as inner, left_semi or left_anti).

    Columns of the two sides must have different names but for on. Intervals with end before start or null ends meet nothing.
    bucket None: the width is measured on the intervals, and pairs with a long one meet in wider buckets of their own. A bucket with
    more than a block of rows on a side is cut (see skew.py); block None: none is.
    """
    if how != "inner":
        marked = materialize(left.withColumn("_row", F.monotonically_increasing_id()), "marked")
        ends = [F.col(c).alias(f"_l{i}") for i, c in enumerate(l)]
        keys = right.select(*on, *(F.col(c).alias(f"_r{i}") for i, c in enumerate(r)))
        hits = range_join(marked.select("_row", *on, *ends), keys, ("_l0", "_l1"), ("_r0", "_r1"), on, bucket, block=block)
        return marked.join(hits.select("_row").distinct(), "_row", how).select(*left.columns)
    a, b = (d.filter(F.col(p[0]) <= F.col(p[1])) for d, p in ((left, l), (right, r)))
    width, some_long = (bucket, False) if bucket else bucket_width((a, l), (b, r))

    def meet(x: DataFrame, y: DataFrame, w: int) -> DataFrame:
        both = skewed_join(_bucketed(x, l, w), _bucketed(y, r, w), [*on, "_bucket"], block)
        hit = (F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))
        first = F.greatest(F.floor(F.col(l[0]) / w), F.floor(F.col(r[0]) / w)) == F.col("_bucket")
        return both.filter(hit & first).drop("_bucket")

    if not some_long:
        return meet(a, b, width)
    is_long = lambda p: F.col(p[1]) - F.col(p[0]) >= LONG * width
    (a0, a1), (b0, b1) = ((d.filter(~is_long(p)), d.filter(is_long(p))) for d, p in ((a, l), (b, r)))
    wide = width * LONG * LONG
    return meet(a0, b0, width).unionByName(meet(a1, b, wide)).unionByName(meet(a0, b1, wide))


def overlap_counts(left: DataFrame, right: DataFrame, key: str, l: tuple[str, str], r: tuple[str, str], on: Sequence[str] = (), bucket: int = 1024, name: str = "n") -> DataFrame:
    """left with the number of right intervals that overlap (0 if none)."""
    n = range_join(left.select(key, *on, *l), right.select(*on, *r), l, r, on, bucket).groupBy(key).agg(F.count("*").alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def _on_target(reads: DataFrame, windows: DataFrame, bucket: int) -> DataFrame:
    at = F.when(F.col("reverse"), F.col("end0") - 1).otherwise(F.col("start0"))
    points = reads.select("read", "contig", at.alias("p0"), at.alias("p1"), F.when(F.col("reverse"), "+").otherwise("-").alias("strand"))
    return range_join(points, windows.select("probe", "contig", "strand", "w0", "w1"), ("p0", "p1"), ("w0", "w1"), ["contig", "strand"], bucket).select("probe", "read")


def on_target_reads(reads: DataFrame, windows: DataFrame, bucket: int = 1024) -> DataFrame:
    """(probe, read): 5' ends in probe windows; + probe: reverse read with end0 - 1 in it, - probe: forward read with
    start0 in it. 1-based windows meet 0-based places unchanged. reads: read, contig, start0, end0, reverse; windows: probe, contig, strand, w0, w1."""
    return _on_target(reads, windows, bucket).distinct()


def on_target_rate(reads: DataFrame, windows: DataFrame, sample: str = "sample", bucket: int = 1024) -> DataFrame:
    """Distinct on-target reads over all reads in percent, 0 without reads. A read counts once over all probes, in each of its
    samples. Reads and hits meet in one grouping by read."""
    hits = _on_target(reads, windows, bucket).select("read", F.lit(None).cast(reads.schema[sample].dataType).alias("_s"), F.lit(False).alias("_own"), F.lit(1).alias("_hit"))
    own = reads.select("read", F.col(sample).alias("_s"), F.lit(True).alias("_own"), F.lit(0).alias("_hit"))
    per = own.unionByName(hits).groupBy("read").agg(F.collect_set(F.when(F.col("_own"), F.struct("_s"))).alias("_in"), F.max("_hit").alias("_hit"))
    out = per.select(F.explode("_in").alias("_in"), "_hit").groupBy(F.col("_in._s").alias(sample)).agg(F.count("*").alias("n_reads"), F.sum("_hit").alias("n_on_target"))
    return out.withColumn("rate", F.coalesce(F.try_divide(100.0 * F.col("n_on_target"), F.col("n_reads")), F.lit(0.0)))


def gene_overlap(blocks: DataFrame, exons: DataFrame, bin: int | None = None) -> DataFrame:
    """(read, gene) where an exon touches a block; both 1-based closed. blocks: read, contig, b0, b1; exons: gene, contig, e0, e1."""
    return range_join(blocks, exons, ("b0", "b1"), ("e0", "e1"), ["contig"], bin).select("read", "gene").distinct()


def hits_locus(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """(read, locus) of reads (0-based half-open) that touch a named 1-based locus: start0 < e and end0 > s - 1."""
    r = reads.select("read", "contig", "start0", (F.col("end0") - 1).alias("last0"))
    l = loci.select("locus", "contig", (F.col("s") - 1).alias("s0"), (F.col("e") - 1).alias("e0"))
    return range_join(r, l, ("start0", "last0"), ("s0", "e0"), ["contig"], None).select("read", "locus").distinct()


def region_type(probes: DataFrame, exons: DataFrame, introns: DataFrame) -> DataFrame:
    """Exon, intron, exon-intron or intergenic. probes: probe, contig, p0, p1; the others: contig, i0, i1."""
    out = probes
    for name, parts in (("_exon", exons), ("_intron", introns)):
        hit = range_join(probes.select("probe", "contig", "p0", "p1"), parts.select("contig", "i0", "i1"), ("p0", "p1"), ("i0", "i1"), ["contig"]).select("probe").distinct()
        out = out.join(hit.withColumn(name, F.lit(True)), "probe", "left")
    both = F.col("_exon").isNotNull() & F.col("_intron").isNotNull()
    kind = F.when(both, "exon-intron").when(F.col("_exon"), "exon").when(F.col("_intron"), "intron").otherwise("intergenic")
    return out.withColumn("region_type", kind).drop("_exon", "_intron")


def snps_in_region(regions: DataFrame, snps: DataFrame) -> DataFrame:
    """Count, 'chr:pos' list and genotype list of SNPs in closed regions. regions: region, contig, r0, r1; snps: contig, pos, genotype."""
    points = snps.select("contig", F.col("pos").alias("s0"), F.col("pos").alias("s1"), "genotype")
    hit = range_join(regions.select("region", "contig", "r0", "r1"), points, ("r0", "r1"), ("s0", "s1"), ["contig"])
    listed = F.array_sort(F.collect_list(F.struct("s0", "contig", "genotype")))
    found = hit.groupBy("region").agg(F.count("*").alias("n_snps"), listed.alias("_l"))
    found = found.select("region", "n_snps", F.concat_ws(",", F.transform("_l", lambda x: F.concat(x["contig"], F.lit(":"), x["s0"].cast("string")))).alias("snps"), F.concat_ws(",", F.transform("_l", lambda x: x["genotype"])).alias("genotypes"))
    out = regions.join(found, "region", "left")
    return out.withColumn("n_snps", F.coalesce("n_snps", F.lit(0))).withColumns({c: F.coalesce(c, F.lit("")) for c in ("snps", "genotypes")})


def snp_counts(pairs: DataFrame, snps: DataFrame) -> DataFrame:
    """SNPs in the amplicon and in both primers: one join over the amplicon, three conditional counts.
    pairs: pair, contig, a0, a1, l0, l1, r0, r1; snps: contig, pos."""
    points = snps.select("contig", F.col("pos").alias("s0"), F.col("pos").alias("s1"))
    hit = range_join(pairs.select("pair", "contig", "a0", "a1", "l0", "l1", "r0", "r1"), points, ("a0", "a1"), ("s0", "s1"), ["contig"])
    inside = lambda a, b: F.count_if(F.col("s0").between(F.col(a), F.col(b)))
    n = hit.groupBy("pair").agg(F.count("*").alias("amplicon_snps"), inside("l0", "l1").alias("left_snps"), inside("r0", "r1").alias("right_snps"))
    return pairs.join(n, "pair", "left").fillna(0, ["amplicon_snps", "left_snps", "right_snps"])


def no_snp_overlap(blocks: DataFrame, snps: DataFrame, key: str = "probe") -> DataFrame:
    """Keys of probes none of whose blocks touches a SNP; the probe centred on the SNP never stays (side 'centre')."""
    points = snps.select("contig", F.col("pos").alias("s0"), F.col("pos").alias("s1"))
    hit = range_join(blocks.select(key, "contig", "b0", "b1"), points, ("b0", "b1"), ("s0", "s1"), ["contig"]).select(key).distinct()
    return blocks.filter(F.col("side") != "centre").select(key).distinct().join(hit, key, "left_anti")


def exonic_snps(genes: DataFrame, exons: DataFrame, snps: DataFrame) -> DataFrame:
    """(gene, pos, relative): SNPs in a gene and in one of its exons; the place counts from the 5' end, from 0."""
    points = snps.select("contig", F.col("pos").alias("s0"), F.col("pos").alias("s1"))
    within = range_join(genes.select("gene", "contig", "strand", "g0", "g1"), points, ("g0", "g1"), ("s0", "s1"), ["contig"])
    both = range_join(within, exons.select("gene", "e0", "e1"), ("s0", "s1"), ("e0", "e1"), ["gene"])
    relative = F.when(F.col("strand") == "-", F.col("g1") - F.col("s0")).otherwise(F.col("s0") - F.col("g0"))
    return both.select("gene", F.col("s0").alias("pos"), relative.alias("relative")).distinct()


def start_profile(reads: DataFrame, windows: DataFrame) -> DataFrame:
    """A10: dense (probe, pos, n) over [w0, w1]: 5' ends by the strand rule, 0 where none."""
    at = F.when(F.col("reverse"), F.col("end0") - 1).otherwise(F.col("start0"))
    starts = reads.groupBy("contig", at.alias("pos"), F.when(F.col("reverse"), "+").otherwise("-").alias("strand")).agg(F.count("*").alias("n"))
    dense = windows.select("probe", "contig", "strand", F.explode(F.sequence("w0", "w1")).alias("pos"))
    return dense.join(starts, ["contig", "strand", "pos"], "left").select("probe", "pos", F.coalesce("n", F.lit(0)).alias("n"))


def probe_status(profile: DataFrame, least: int = 3, above: int = 2) -> DataFrame:
    """(probe, accepted): in any data set the peak is at least `least` and more than `above` over the mode of the
    background (ties: the smallest). profile: dataset, probe, n, in_bin."""
    per = profile.groupBy("dataset", "probe").agg(F.max(F.when(F.col("in_bin"), F.col("n"))).alias("peak"), F.mode(F.when(~F.col("in_bin"), F.col("n")), True).alias("background"))
    ok = (F.col("peak") >= least) & (F.col("peak") > F.coalesce("background", F.lit(0)) + above)
    return per.groupBy("probe").agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("accepted"))


def coverage(reads: DataFrame, windows: DataFrame) -> DataFrame:
    """(probe, pos, depth) where it changes or not, dense over [w0, w1): reads count on [max(w0, start0), min(w1, end0)).
    Changes of depth are summed by blocks of PIECE places first; a block starts from the sum of those before it."""
    hit = range_join(reads.select("contig", "start0", (F.col("end0") - 1).alias("last0")), windows.select("probe", "contig", "w0", (F.col("w1") - 1).alias("w_last")), ("start0", "last0"), ("w0", "w_last"), ["contig"])
    up = hit.select("probe", F.greatest("w0", "start0").alias("pos"), F.lit(1).alias("d"))
    down = hit.select("probe", F.least(F.col("w_last"), F.col("last0")).alias("pos"), F.lit(-1).alias("d")).withColumn("pos", F.col("pos") + 1)
    events = up.unionByName(down).groupBy("probe", "pos").agg(F.sum("d").alias("d"))
    block = F.sequence(F.lit(0), F.floor((F.col("w1") - F.col("w0") - 1) / PIECE).cast("int"))
    blocks = windows.filter("w1 > w0").select("probe", "w0", "w1", F.explode(block).alias("_block"))
    first = windows.select("probe", F.col("w0").alias("_w0"))
    events = events.join(first, "probe").withColumn("_block", F.floor((F.col("pos") - F.col("_w0")) / PIECE).cast("int")).drop("_w0")
    sums = events.groupBy("probe", "_block").agg(F.sum("d").alias("_d"))
    earlier = Window.partitionBy("probe").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for PIECE places
    blocks = blocks.join(sums, ["probe", "_block"], "left").withColumn("_offset", F.coalesce(F.sum("_d").over(earlier), F.lit(0)))
    start = F.col("w0") + F.col("_block") * PIECE
    places = F.explode(F.sequence(start, F.least(start + PIECE, F.col("w1")) - 1)).alias("pos")
    dense = blocks.select("probe", "_block", "_offset", places).join(events.select("probe", "pos", "d"), ["probe", "pos"], "left")
    running = Window.partitionBy("probe", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select("probe", "pos", (F.col("_offset") + F.sum(F.coalesce("d", F.lit(0))).over(running)).alias("depth"))


def common_junctions(junctions: DataFrame, template: DataFrame) -> DataFrame:
    """(j0, j1) present in every transcript of the gene and in the template. junctions: gene, tx, j0, j1; template: gene, j0, j1."""
    total = junctions.groupBy("gene").agg(F.count_distinct("tx").alias("_all"))
    each = junctions.groupBy("gene", "j0", "j1").agg(F.count_distinct("tx").alias("_n"))
    return each.join(total, "gene").filter("_n = _all").select("gene", "j0", "j1").join(template, ["gene", "j0", "j1"], "left_semi")


def introns(exons: DataFrame) -> DataFrame:
    """(tx, i0, i1): non-empty gaps between exons in order. exons: tx, e0, e1."""
    following = F.lead("e0").over(Window.partitionBy("tx").orderBy("e0", "e1"))
    return exons.withColumn("_next", following).select("tx", (F.col("e1") + 1).alias("i0"), (F.col("_next") - 1).alias("i1")).filter("i0 <= i1")


def cdna_segments(exons: DataFrame) -> DataFrame:
    """Exons with c0, c1, their 0-based cDNA places in transcript order, the minus strand reversed. exons: tx, strand, e0, e1."""
    order = Window.partitionBy("tx").orderBy(F.when(F.col("strand") == "-", -F.col("e1")).otherwise(F.col("e0"))).rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("e1") - F.col("e0") + 1
    return exons.withColumn("c1", F.sum(size).over(order) - 1).withColumn("c0", F.col("c1") - size + 1)


def map_coord(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Points (tx, c) with their genome place g, null outside all segments."""
    seg = segments.select("tx", "strand", "e0", "e1", "c0", "c1")
    hit = range_join(points.select("tx", F.col("c").alias("p0"), F.col("c").alias("p1")).distinct(), seg, ("p0", "p1"), ("c0", "c1"), ["tx"])
    g = F.when(F.col("strand") == "-", F.col("e1") - (F.col("p0") - F.col("c0"))).otherwise(F.col("e0") + F.col("p0") - F.col("c0"))
    return points.join(hit.select("tx", F.col("p0").alias("c"), g.alias("g")), ["tx", "c"], "left")


def map_interval(intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, parts): the genome pieces of a cDNA interval, in order. intervals: id, tx, q0, q1."""
    hit = range_join(intervals, segments.select("tx", "strand", "e0", "e1", "c0", "c1"), ("q0", "q1"), ("c0", "c1"), ["tx"])
    a, b = F.greatest("q0", "c0") - F.col("c0"), F.least("q1", "c1") - F.col("c0")
    minus = F.col("strand") == "-"
    piece = F.struct("c0", F.when(minus, F.col("e1") - b).otherwise(F.col("e0") + a).alias("g0"), F.when(minus, F.col("e1") - a).otherwise(F.col("e0") + b).alias("g1"))
    return hit.groupBy("id").agg(F.array_sort(F.collect_list(piece)).alias("_p")).select("id", F.transform("_p", lambda p: F.struct(p["g0"].alias("g0"), p["g1"].alias("g1"))).alias("parts"))


def crosses(primers: DataFrame, junctions: DataFrame, each_side: int, three_prime: int) -> DataFrame:
    """Primers (primer, tx, p0, p1, forward) with n_spanned and crosses: a junction after cDNA place j with at least
    each_side bases on both sides and three_prime at the 3' end."""
    j = junctions.select("tx", F.col("j").alias("j0"), (F.col("j") + 1).alias("j1"))
    hit = range_join(primers, j, ("p0", "p1"), ("j0", "j1"), ["tx"]).filter("p0 <= j0 and p1 >= j1")
    before, after = F.col("j0") - F.col("p0") + 1, F.col("p1") - F.col("j0")
    ok = (before >= each_side) & (after >= each_side) & (F.when(F.col("forward"), after).otherwise(before) >= three_prime)
    n = hit.groupBy("primer").agg(F.count("*").alias("n_spanned"), F.bool_or(ok).alias("crosses"))
    return primers.join(n, "primer", "left").withColumn("n_spanned", F.coalesce("n_spanned", F.lit(0))).withColumn("crosses", F.coalesce("crosses", F.lit(False)))


def transcript_lengths(exons: DataFrame) -> DataFrame:
    """(tx, spliced_length, gene_start, gene_end)."""
    return exons.groupBy("tx").agg(F.sum(F.col("e1") - F.col("e0") + 1).alias("spliced_length"), F.min("e0").alias("gene_start"), F.max("e1").alias("gene_end"))


def probe_windows(probes: DataFrame, n: int = 15) -> DataFrame:
    """Probes (probe, contig, strand, start1, end1) with w0, w1; unstranded ones go."""
    w = initiation_window(F.col("strand"), F.col("start1"), F.col("end1"), n)
    return probes.withColumn("_w", w).filter("_w is not null").withColumn("w0", F.col("_w.start")).withColumn("w1", F.col("_w.end")).drop("_w")


def pieces(df: DataFrame, text: str, more) -> DataFrame:
    """df with _start (from 0) and _piece for text: runs of PIECE letters with more of what follows, so that later work on
    places walks short strings."""
    cut = df.withColumn("_start", F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(PIECE))))
    return cut.withColumn("_piece", F.substring(F.col(text), F.col("_start") + 1, PIECE + more)).drop(text)


def _seeded(texts: DataFrame, text: str, key: str, needles: DataFrame, k: int) -> DataFrame:
    """(key, needle columns): texts that hold the seed of a needle: its first k letters, or all of a shorter one. Needles have
    _seed. Texts give their words of each seed length that is there, with nothing but key and word, in one walk for each."""
    lengths = [r[0] for r in needles.select(F.length("_seed")).distinct().collect()]  # k rows at most
    words = F.array_distinct(F.flatten(F.array(*(words_of(F.col(text), n) for n in lengths)))) if lengths else F.array().cast("array<string>")
    return texts.select(key, F.explode(words).alias("_seed")).join(needles, "_seed")


def substring_lookup(df: DataFrame, text: str, plates: DataFrame, needle: str, order: Sequence[str], k: int = 12) -> DataFrame:
    """For each row the first plate row (in order) whose needle its text holds, in any case; nulls where none does.

    Of plates with one needle only the first can win, so a needle has one row. Needles of k letters or more meet the text's k-mers by
    an equi-join on their first k, shorter ones by their own length; what meets carries a row number and a place only, the text
    and the rows join once the candidates are known.
    """
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    p = plates.withColumn("_s", F.upper(needle)).filter("_s <> ''").withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(*order)))
    p = materialize(p.filter("_r = 1").drop("_r").withColumn("_seed", F.left("_s", F.lit(k))), "needles")
    texts = rows.select("_row", F.upper(text).alias("_t")).filter("_t <> ''")
    first = Window.partitionBy("_row").orderBy(*order)
    hit = _seeded(texts, "_t", "_row", p.filter(F.length("_s") <= k), k).select("_row", *plates.columns)
    long = p.filter(F.length("_s") > k)
    if not long.isEmpty():
        met = _seeded(texts, "_t", "_row", long, k).select("_row", *plates.columns, "_s")
        hit = hit.unionByName(met.join(texts, "_row").filter(F.contains("_t", "_s")).drop("_t", "_s"))
    hit = hit.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("_row", *plates.columns)
    return rows.join(hit, "_row", "left").drop("_row")


#: Bits of the filter that places pass before they meet seeds; its size, 32 MB, doesn't grow with the guides.
FILTER = 28
#: Letters of a contig whose places are looked at together.
STRIDE = 1 << 20


def _hashes(text: str, k: int) -> np.ndarray:
    """A number below 2^FILTER for the k letters at each place of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(k if n > 0 else 0):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += points[i : i + n] + np.uint64(1)
    return ((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER)).astype(np.int64)


def _filter(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds' hashes, set by tasks and put together word by word; only the words come to the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([_hashes(s, len(s))[0] for s in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h >> 6), pa.array(np.int64(1) << (h & 63))], ["_w", "_b"])

    words = seeds.mapInArrow(mark, "_w long, _b long").groupBy("_w").agg(F.bit_or("_b").alias("_b")).toArrow()
    bits = np.zeros(1 << (FILTER - 6), np.int64)
    bits[words["_w"].to_numpy()] = words["_b"].to_numpy()
    return bits


def _met(guides: DataFrame, genome: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(guide, g, strand, _seed) of the guides on either strand, and (contig, start0, _seed, _word) of the genome's places that may
    have a seed, with the letters from there on that the longest guide needs. Places pass a filter of the seeds where they are
    read. Both are written: they grow with guides and places, not with their pairs."""
    both = guides.select("guide", F.upper("seq").alias("g"), F.lit("+").alias("strand")).unionByName(guides.select("guide", revcomp(F.col("seq")).alias("g"), F.lit("-").alias("strand")))
    both = materialize(both.filter("g <> ''").distinct().withColumn("_seed", F.left("g", F.lit(k))), "seeds")
    chunked = "offset" in genome.columns
    at = [F.col("offset").cast("long").alias("_offset"), F.col("own").cast("long").alias("_own")] if chunked else [F.lit(0).cast("long").alias("_offset"), F.length("seq").cast("long").alias("_own")]
    ref = genome.select("contig", *at, F.upper("seq").alias("_ref")).filter("_ref is not null")
    longest = both.agg(F.coalesce(F.max(F.length("g")), F.lit(0))).first()[0]
    widths = sorted(r[0] for r in both.select(F.length("_seed")).distinct().collect())  # k rows at most
    bits = ref.sparkSession.sparkContext.broadcast(_filter(both.select("_seed").distinct()))
    kind = ref.schema["contig"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contigs, found, size = b.column("contig"), [], 0

            def batch() -> pa.RecordBatch:
                own, start, width, word = zip(*found, strict=True)
                return pa.RecordBatch.from_arrays([contigs.take(pa.array(own)), pa.array(start, pa.int64()), pa.array([w[:n] for w, n in zip(word, width, strict=True)], pa.string()), pa.array(word, pa.string())], ["contig", "start0", "_seed", "_word"])

            for i, (offset, own) in enumerate(zip(b.column("_offset").to_pylist(), b.column("_own").to_pylist(), strict=True)):
                text = b.column("_ref")[i].as_py()
                for first in range(0, min(own, len(text)), STRIDE):
                    some = text[first : first + STRIDE + longest - 1]
                    for n in widths:
                        h = _hashes(some, n)[: min(STRIDE, own - first)]
                        for p in np.flatnonzero(bits.value[h >> 6] >> (h & 63) & 1).tolist():
                            found.append((i, offset + first + p, n, some[p : p + longest]))
                            size += longest
                            if size >= 1 << 22:
                                yield batch()
                                found, size = [], 0
            if found:
                yield batch()

    met = ref.mapInArrow(pick, f"contig {kind}, start0 long, _seed string, _word string")
    return both, materialize(met.distinct(), "met")


def _places(both: DataFrame, met: DataFrame) -> DataFrame:
    """(guide, contig, start0, strand, exact): places of the guides' seeds, and if all letters agree. Pairs are made distinct only
    where a guide has several texts or a place several words."""
    out = met.join(both, "_seed").select("guide", "contig", "start0", "strand", F.startswith("_word", "g").alias("exact"))
    twice = lambda d, *keys: not d.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()
    return out.distinct() if twice(both, "guide", "strand") or twice(met, "contig", "start0", F.length("_seed")) else out


def placed(guides: DataFrame, genome: DataFrame, k: int = 20, strict: bool = True) -> DataFrame:
    """Full-length exact places (guide, contig, start0, strand) of guides of any length: their first k letters, or all of
    shorter ones, meet the genome's, and the rest is compared. strict: a guide without a place is an error. guides: guide, seq;
    genome: contig, seq, or chunks of contigs with offset and own as read_fasta_chunks() gives them, with a halo of at least the
    longest guide's letters less one."""
    both, met = _met(guides, genome, k)
    hits = _places(both, met).filter("exact").drop("exact")
    if not strict:
        return hits
    words = met.select("_seed", "_word").distinct()
    found = both.join(words, "_seed").filter(F.startswith("_word", "g")).select("guide").distinct()
    missing = guides.select("guide").distinct().join(found, "guide", "left_anti").agg(F.min("guide").alias("g"), F.count("*").alias("n"))
    text = F.concat(F.lit("no full-length exact place for guide "), F.col("g").cast("string"), F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" others"))
    check = missing.select(F.when(F.col("n") > 0, F.raise_error(text).cast("int")).otherwise(1).alias("_ok"))
    return hits.crossJoin(F.broadcast(check)).filter("_ok = 1").drop("_ok")


def partial_places(guides: DataFrame, genome: DataFrame, k: int = 20) -> DataFrame:
    """(guide, n): places of a guide's first k letters where the rest differs or the contig ends, 0 if none."""
    n = _places(*_met(guides, genome, k)).filter("not exact").groupBy("guide").agg(F.count("*").alias("n"))
    return guides.select("guide").distinct().join(n, "guide", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _narrowest(hits: Iterator[tuple], n_guides: int, max_span: int) -> tuple[int, int, int] | None:
    """(span, start, end) of the narrowest window with a hit of every guide; hits (start, end, guide) by falling start. Of each guide
    the hit that ends first is kept; a heap, whose outdated entries are dropped when they come up, gives the last of these ends."""
    ends: dict = {}
    heap: list[tuple[int, str]] = []
    best = None
    for start, same in groupby(hits, key=lambda h: h[0]):
        for _, end, guide in same:
            if end < ends.get(guide, math.inf):
                ends[guide] = end
                heapq.heappush(heap, (-end, guide))
        while -heap[0][0] != ends[heap[0][1]]:
            heapq.heappop(heap)
        span = -heap[0][0] - start
        if len(ends) == n_guides and span <= max_span and (best is None or (span, start) < best[:2]):
            best = (span, start, -heap[0][0])
    return best


def coherent_target(hits: DataFrame, max_span: int) -> DataFrame:
    """One hit of every guide on one contig within max_span, the smallest span (ties: contig, start).

    Contigs are cut into blocks of max_span, each with the hits of the block after it, so a window lies in the block where it starts; a
    block is swept once, from its last hit to its first, and gives its narrowest window. hits: guide, contig, start0, end0 after it.
    """
    some = hits.filter("guide is not null and start0 <= end0").select("contig", F.col("guide").cast("string").alias("guide"), F.col("start0").cast("long"), F.col("end0").cast("long"))
    n_guides, width = some.agg(F.count_distinct("guide")).first()[0], max(1, max_span)
    own = F.floor(F.col("start0") / width)
    placed = some.withColumn("_block", F.explode(F.array(own, own - 1)))
    keys = ["contig", "_block"]
    rows = placed.repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, F.desc("start0"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (*keys, "start0", "end0", "guide")), strict=True))
        found = []
        for (contig, _), block in groupby(each, key=lambda r: r[:2]):
            best = _narrowest((r[2:] for r in block), n_guides, max_span)
            if best:
                found.append((contig, best[1], best[2], best[0]))
        columns = zip(*found, strict=True) if found else [[]] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["contig", "start0", "end0", "span"])

    per = rows.mapInArrow(sweep, "contig string, start0 long, end0 long, span long")
    return per.orderBy("span", "contig", "start0").limit(1)
