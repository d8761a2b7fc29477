"""Sequencing reads: demultiplexing, trimming, quality, alleles, origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import safe_ratio
from quillon.functions.sequence import candidates, find, hamming, mean_phred, revcomp, rfind
from quillon.operators.intervals import range_join
from quillon.plans.storage import materialize


def load_sample_map(df: DataFrame, allow_blank: bool = False, length: int = 8) -> DataFrame:
    """(sample, i7, i5) of either layout (P7_Barcode, P5_Barcode or i7, i5), i7 reverse-complemented in the second;
    errors: wrong length, a pair or a sample that is there twice."""
    layout_a = "P7_Barcode" in df.columns
    i7 = F.upper(F.col("P7_Barcode")) if layout_a else revcomp(F.col("i7"))
    out = df.select(F.col("SampleName").alias("sample"), i7.alias("i7"), F.upper(F.col("P5_Barcode" if layout_a else "i5")).alias("i5"))
    if allow_blank:
        out = out.filter("i7 <> '' and i5 <> ''")
    by_pair, by_name = (F.count("*").over(Window.partitionBy(*k)) for k in (("i7", "i5"), ("sample",)))
    out = out.withColumn("_p", by_pair).withColumn("_s", by_name)
    bad = (F.length("i7") != length) | (F.length("i5") != length) | (F.col("_p") > 1) | (F.col("_s") > 1)
    return out.withColumn("sample", F.when(bad, F.raise_error(F.concat(F.lit("bad sample map row: "), "sample"))).otherwise(F.col("sample"))).drop("_p", "_s")


def close_words(words: DataFrame, codes: DataFrame, k: int, width: int) -> DataFrame:
    """(word, code, d): pairs of distinct words and codes of a width with at most k mismatches. Cut into k + 1 parts, at least one
    part is equal, so pairs meet by an equi-join on a part; with more parts than letters all of them meet."""
    n = k + 1 if k < width else 1
    cuts = [width * i // n for i in range(n + 1)] if k < width else [0, 0]
    parts = lambda c: F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.substring(c, cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("part")) for i in range(n))))
    a = words.select("word").distinct().select("word", parts("word").alias("p"))
    b = codes.select("code").distinct().select("code", parts("code").alias("p"))
    return a.join(b, "p").select("word", "code").distinct().withColumn("d", hamming(F.col("word"), F.col("code"))).filter(F.col("d") <= k)


def demultiplex(reads: DataFrame, sample_map: DataFrame, anchor7: str, anchor5: str, k: int = 1, width: int = 8, reach: int = 2) -> DataFrame:
    """(read, status, sample, orientation, distance, i7, i5, word7, word5, offset7, offset5). In both orientations the words
    of the barcode width at offsets -reach..reach before the first anchor7 and after the last anchor5 are candidates. Each side
    keeps, for each barcode, its best (Hamming, |offset|); a sample's total is the sum of both. Total over k: unmatched; a tie on
    (distance, offset), also of one sample's two orientations: ambiguous, with the first by name; no anchors: unrecognized."""
    whole = F.array(F.struct(F.col("seq").alias("q")))  # a sequence is worked out once, its strands are rows of their own
    strands = lambda q: F.array(F.struct(F.upper(q["q"]).alias("s"), F.lit("forward").alias("orientation")), F.struct(revcomp(q["q"]).alias("s"), F.lit("reverse").alias("orientation")))
    both = reads.select("read", F.inline(F.flatten(F.transform(whole, strands))))
    at = both.select("read", "orientation", "s", find(F.col("s"), anchor7).alias("_a"), rfind(F.col("s"), anchor5).alias("_b")).filter("_a >= 0 and _b >= 0")
    near7, near5 = (candidates(F.col("s"), p, width, reach) for p in (F.col("_a") - width, F.col("_b") + len(anchor5)))
    found = materialize(at.select("read", "orientation", near7.alias("near7"), near5.alias("near5")), "found")
    sides = []
    for name, code in (("7", "i7"), ("5", "i5")):
        words = found.select("read", "orientation", F.explode(f"near{name}").alias("c")).select("read", "orientation", "c.offset", "c.word")
        near = close_words(words, sample_map.select(F.col(code).alias("code")), k, width)
        best = words.join(near, "word").groupBy("read", "orientation", "code").agg(F.min(F.struct("d", F.abs("offset").alias("o"), "offset", "word")).alias(f"b{name}"))
        sides.append(best.withColumnRenamed("code", code))
    pairs = sides[0].join(sides[1], ["read", "orientation"]).join(sample_map, ["i7", "i5"])
    pairs = pairs.withColumn("distance", F.col("b7.d") + F.col("b5.d")).withColumn("offset", F.col("b7.o") + F.col("b5.o")).filter(F.col("distance") <= k)
    order = Window.partitionBy("read").orderBy("distance", "offset")
    match = F.struct("sample", "orientation", "distance", "i7", "i5", F.col("b7.word").alias("word7"), F.col("b5.word").alias("word5"), F.col("b7.offset").alias("offset7"), F.col("b5.offset").alias("offset5"))
    ranked = pairs.withColumn("_r", F.rank().over(order)).filter("_r = 1").groupBy("read").agg(F.count("*").alias("_n"), F.min(match).alias("_m"))
    out = reads.select("read").join(found.select("read").distinct().withColumn("_anchored", F.lit(True)), "read", "left").join(ranked, "read", "left")
    status = F.when(F.col("_anchored").isNull(), "unrecognized").when(F.col("_n").isNull(), "unmatched").when(F.col("_n") > 1, "ambiguous").otherwise("assigned")
    chosen = lambda c: F.when(F.col("_n") == 1, F.col(f"_m.{c}"))
    pair = (F.col(f"_m.{c}").alias(c) for c in ("i7", "i5"))
    return out.select("read", status.alias("status"), *(chosen(c).alias(c) for c in ("sample", "orientation", "distance")), *pair, *(chosen(c).alias(c) for c in ("word7", "word5", "offset7", "offset5")))


#: Keys of the overall section and the statuses they count.
OVERALL = {"assigned": "assigned", "unrecognized_structure": "unrecognized", "unmatched_barcode": "unmatched", "ambiguous_barcode": "ambiguous"}


def demux_summary(assigned: DataFrame, n: int = 100, matched_first: bool = False) -> DataFrame:
    """(Section, Key, Value), stacked: overall counts, orientations, mismatches, offsets and samples of the assigned reads,
    their pairs of the map with the statuses of all reads that fit best there, and the n most frequent pairs as observed (ties by
    key). A matched pair with a blank sample name counts as matched_blank_sample, not as assigned. A pair's statuses are listed by
    their names, or matched_first: by status, descending."""
    d = materialize(assigned, "assigned")
    matched = d.filter("status = 'assigned'")
    blank = F.coalesce(F.col("sample"), F.lit("")) == ""
    part = lambda section, key, rows: rows.groupBy(F.lit(section).alias("Section"), key.cast("string").alias("Key")).agg(F.count("*").alias("Value"))
    counts = [F.count("*").alias("total_reads"), F.count_if((F.col("status") == "assigned") & ~blank).alias("assigned"), F.count_if((F.col("status") == "assigned") & blank).alias("matched_blank_sample")]
    counts += [F.count_if(F.col("status") == s).alias(k) for k, s in OVERALL.items() if s != "assigned"]
    keys = ["total_reads", "assigned", "matched_blank_sample", *(k for k in OVERALL if k != "assigned")]
    overall = d.agg(*counts).unpivot([], keys, "Key", "Value").select(F.lit("overall").alias("Section"), "Key", "Value")
    by_status = d.filter("i7 is not null").groupBy("i7", "i5", "status").agg(F.count("*").alias("n"))
    name = F.when(F.col("status") == "assigned", "matched").otherwise(F.concat("status", F.lit("_barcode")))
    text = F.concat(name, F.lit(":"), F.col("n").cast("string"))
    each = F.sort_array(F.collect_list(F.struct("status", text.alias("text"))), False)["text"] if matched_first else F.array_sort(F.collect_list(text))
    listed = F.array_join(each, ";")  # one entry a status
    canonical = by_status.groupBy("i7", "i5").agg(listed.alias("s"), F.sum(F.when(F.col("status") == "assigned", F.col("n"))).alias("Value")).filter("Value is not null")
    canonical = canonical.select(F.lit("canonical_pair").alias("Section"), F.concat_ws(",", "i7", "i5", "s").alias("Key"), "Value")
    out = overall.unionByName(part("orientation", F.col("orientation"), matched)).unionByName(part("barcode_mismatches", F.col("distance"), matched))
    out = out.unionByName(part("barcode_offsets", F.concat(F.lit("P7="), "offset7", F.lit(";P5="), "offset5"), matched)).unionByName(part("sample", F.col("sample"), matched.filter(~blank)))
    return out.unionByName(canonical).unionByName(part("observed_pair", F.concat_ws(",", "word7", "word5"), matched).orderBy(F.desc("Value"), "Key").limit(n))


def n50(df: DataFrame, length: str, keys: Sequence[str] = ()) -> DataFrame:
    """The first length, descending, where the running sum reaches half of the total. Lengths are grouped first, so the
    ordered window holds one row for each distinct length."""
    counts = df.groupBy(*keys, length).agg((F.count("*") * F.col(length)).alias("_bases"))
    order = Window.partitionBy(*keys).orderBy(F.desc(length))
    counts = counts.withColumn("_sum", F.sum("_bases").over(order)).withColumn("_all", F.sum("_bases").over(Window.partitionBy(*keys)))
    return counts.groupBy(*keys).agg(F.max(F.when(2 * F.col("_sum") >= F.col("_all"), F.col(length))).alias("n50"))


def fastq_qc(reads: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """N, mean, median, least and largest length, N50 and the mean of the reads' mean qualities. reads: sample, seq, qual."""
    r = reads.withColumn("_len", F.length("seq").cast("long")).withColumn("_q", mean_phred(F.col("qual")))
    main = r.groupBy(*keys).agg(F.count("*").alias("n_reads"), F.avg("_len").alias("mean_length"), F.percentile("_len", 0.5).alias("median_length"), F.min("_len").alias("min_length"), F.max("_len").alias("max_length"), F.avg("_q").alias("mean_quality"))
    return main.join(n50(r, "_len", keys), list(keys))


def cigar_blocks(alignments: DataFrame) -> DataFrame:
    """(read, contig, kind M or D, r0, r1, q0, seq): aligned and deleted pieces, 0-based closed on the reference."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"), 1)
    start = F.struct(F.col("start0").cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<kind:string,r0:bigint,r1:bigint,q0:bigint>>").alias("out"))

    def step(s: Column, op: Column) -> Column:
        n, kind = F.regexp_extract(op, r"^(\d+)", 1).cast("long"), F.right(op, F.lit(1))
        on_ref, on_query = kind.isin("M", "=", "X", "D", "N"), kind.isin("M", "=", "X", "I", "S")
        piece = F.struct(F.when(kind.isin("M", "=", "X"), "M").otherwise("D").alias("kind"), s["r"].alias("r0"), (s["r"] + n - 1).alias("r1"), s["q"].alias("q0"))
        return F.struct(F.when(on_ref, s["r"] + n).otherwise(s["r"]).alias("r"), F.when(on_query, s["q"] + n).otherwise(s["q"]).alias("q"), F.when(kind.isin("M", "=", "X", "D"), F.array_append(s["out"], piece)).otherwise(s["out"]).alias("out"))

    walked = F.aggregate(ops, start, step, lambda s: s["out"])
    return alignments.select("read", "contig", "seq", F.explode(walked).alias("b")).select("read", "contig", "seq", "b.*")


def base_at(alignments: DataFrame, snps: DataFrame) -> DataFrame:
    """(read, contig, pos, base, query): the base, '-' in a deletion; places in the alignment's span that no piece covers
    are 'N'. alignments: read, contig, start0, end0, cigar, seq; snps: contig, pos (0-based)."""
    points = snps.select("contig", "pos", F.col("pos").alias("s0"), F.col("pos").alias("s1"))
    hit = range_join(cigar_blocks(alignments), points, ("r0", "r1"), ("s0", "s1"), ["contig"])
    query = F.col("q0") + F.col("pos") - F.col("r0")
    base = F.when(F.col("kind") == "D", "-").otherwise(F.substring("seq", (query + 1).cast("int"), F.lit(1)))
    calls = hit.select("read", "contig", "pos", base.alias("base"), F.when(F.col("kind") == "M", query).alias("query"))
    spans = alignments.select("read", "contig", "start0", (F.col("end0") - 1).alias("last0")).distinct()
    asked = range_join(spans, points, ("start0", "last0"), ("s0", "s1"), ["contig"]).select("read", "contig", "pos").distinct()
    return asked.join(calls, ["read", "contig", "pos"], "left").withColumn("base", F.coalesce("base", F.lit("N")))


def assign_allele(calls: DataFrame, names: tuple[str, str] = ("B6", "Cast"), keys: Sequence[str] = ("read",)) -> DataFrame:
    """(read, Allele, B6_Matches, Cast_Matches, Total_SNP_Coverage): more matches win; a tie above 0 is Ambiguous, none Noise;
    coverage counts all but N. keys: read, and what it determines. calls: read, base, base1, base2."""
    n = calls.groupBy(*keys).agg(F.count_if(F.col("base") == F.col("base1")).alias(f"{names[0]}_Matches"), F.count_if(F.col("base") == F.col("base2")).alias(f"{names[1]}_Matches"), F.count_if(F.col("base") != "N").alias("Total_SNP_Coverage"))
    a, b = F.col(f"{names[0]}_Matches"), F.col(f"{names[1]}_Matches")
    return n.withColumn("Allele", F.when(a > b, names[0]).when(b > a, names[1]).when(a > 0, "Ambiguous").otherwise("Noise"))


def allele_summary(reads: DataFrame, keys: Sequence[str] = ("sample",), names: tuple[str, str] = ("B6", "Cast"), prefix: bool = False) -> DataFrame:
    """A2: counts of the four classes and ratio = second / (first + second), 0 if none; prefix: classes match by their start."""
    is_ = lambda n: F.col("Allele").startswith(n) if prefix else F.col("Allele") == n
    out = reads.groupBy(*keys).agg(*(F.count_if(is_(n)).alias(n) for n in (*names, "Ambiguous", "Noise")), F.count("*").alias("Total"))
    return out.withColumn("Ratio", safe_ratio(F.col(names[1]), F.col(names[0]) + F.col(names[1])))


def by_condition(summary: DataFrame, condition: str = "Condition") -> DataFrame:
    """A3: mean of the ratios, not pooled, and sum of the totals."""
    return summary.groupBy(condition).agg(F.avg("Ratio").alias("mean_ratio"), F.sum("Total").alias("total"))


def replicate_summary(summary: DataFrame, keys: Sequence[str], percent: str, counts: Sequence[str]) -> DataFrame:
    """A4: mean and sample standard deviation (null: 0) of a percentage, sums of counts."""
    return summary.groupBy(*keys).agg(F.avg(percent).alias("mean"), F.coalesce(F.stddev_samp(percent), F.lit(0.0)).alias("std"), *(F.sum(c).alias(c) for c in counts))


def mean_cols(df: DataFrame, keys: Sequence[str], pattern: str) -> DataFrame:
    """A5: mean of the columns whose name matches, in the order of the number in it."""
    import re

    found = sorted((c for c in df.columns if re.search(pattern, c)), key=lambda c: (int(re.search(r"\d+", c)[0]) if re.search(r"\d+", c) else -1, c))
    return df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in found))


def pileup_counts(calls: DataFrame, skip_first_base: bool = True) -> DataFrame:
    """(read, n_ref, n_alt, percent_alt): a match with the reference, any other base is the alternative; deletions and N
    are skipped, and a base at query place 0 too (it was tested for truth). calls: read, base, query, ref."""
    used = calls.filter("base not in ('-', 'N')")
    used = used.filter("query <> 0") if skip_first_base else used
    n = used.groupBy("read").agg(F.count_if(F.col("base") == F.col("ref")).alias("n_ref"), F.count_if(F.col("base") != F.col("ref")).alias("n_alt"))
    return n.withColumn("percent_alt", F.coalesce(F.try_divide(100.0 * F.col("n_alt"), F.col("n_ref") + F.col("n_alt")), F.lit(0.0)))


def flag_summary(alignments: DataFrame, keys: Sequence[str] = ("sample",), length: int | None = None) -> DataFrame:
    """Counts of alignment flags with percents; mean coverage is mapped bases over a length."""
    bit = lambda k: F.col("flag").bitwiseAND(k) != 0
    mapped = ~bit(4)
    out = alignments.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(mapped).alias("mapped"),
        F.count_if(bit(1) & bit(2) & mapped).alias("proper_pair"),
        F.count_if(bit(1) & mapped & ~bit(8)).alias("both_mapped"),
        F.count_if(bit(1) & mapped & bit(8)).alias("singletons"),
        F.sum(F.when(mapped, F.col("end0") - F.col("start0")).otherwise(0)).alias("bases_mapped"),
    )
    out = out.withColumns({f"{c}_percent": 100 * safe_ratio(F.col(c), F.col("total")) for c in ("mapped", "proper_pair", "singletons")})
    return out if length is None else out.withColumn("mean_coverage", F.col("bases_mapped") / float(length))


def trim_umi(reads: DataFrame, head: str, tail: str, umi: int = 6, least: int = 50) -> DataFrame:
    """Reads with status, umi and insert. Between the first head adapter and the tail after it: the first umi bases,
    then the insert; longer than least is Success, else TooShort; without both adapters in either strand MissingAdapters."""
    s = F.upper(F.col("seq"))
    s = F.when(F.instr(s, head) > 0, s).otherwise(revcomp(F.col("seq")))
    a = F.instr(s, head)
    b = F.call_function("locate", F.lit(tail), s, a + len(head))
    body = F.when((a > 0) & (b > 0), F.substring(s, a + len(head), b - a - len(head)))
    out = reads.withColumn("_body", body).withColumn("umi", F.left("_body", F.lit(umi))).withColumn("insert", F.substring("_body", F.lit(umi + 1), F.length("_body")))
    return out.withColumn("status", F.when(F.col("_body").isNull(), "MissingAdapters").when(F.length("insert") > least, "Success").otherwise("TooShort")).drop("_body")


def status_fractions(df: DataFrame, status: str = "status") -> DataFrame:
    """Counts and shares by status."""
    n = df.groupBy(status).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def origin_summary(classes: DataFrame, categories: Sequence[str], column: str = "origin", all_reads: int | None = None) -> DataFrame:
    """Every category with its count (0 if none), percent of the rows and of all reads, two decimals."""
    dim = classes.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    n = classes.groupBy(column).agg(F.count("*").alias("n"))
    out = dim.join(n, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    return out.withColumn("percent", F.round(100 * safe_ratio(F.col("n"), total), 2)).withColumn("percent_of_all", F.round(100 * safe_ratio(F.col("n"), F.lit(all_reads) if all_reads else total), 2))


def best_hit(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads with the contig of the largest (mapq, aligned length), '' and -1 if none (ties: the largest contig)."""
    best = hits.groupBy("read").agg(F.max(F.struct("mapq", "length", "contig")).alias("b")).select("read", F.col("b.contig").alias("best_contig"), F.col("b.mapq").alias("best_mapq"))
    return reads.join(best, "read", "left").withColumn("best_contig", F.coalesce("best_contig", F.lit(""))).withColumn("best_mapq", F.coalesce("best_mapq", F.lit(-1)))


def max_mapq(hits: DataFrame, low: int = 10) -> DataFrame:
    """(read, max_mapq, low_mapq): the largest quality below low is multi or low."""
    return hits.groupBy("read").agg(F.max("mapq").alias("max_mapq"), F.bool_or(F.col("mapq") >= low).alias("_any")).withColumn("low_mapq", ~F.col("_any")).drop("_any")


def origin(reads: DataFrame, evidence: DataFrame, special: str = "X", low: int = 10) -> DataFrame:
    """Reads (read, assigned) with one origin: assigned, locus 1, locus 2, the special contig, another contig, low quality,
    ncRNA (only if unmapped), unresolved. evidence: read, source (genome or ncrna), contig, mapq, locus."""
    g = F.col("source") == "genome"
    e = evidence.groupBy("read").agg(
        F.max(F.when(g, F.col("mapq"))).alias("_mapq"),
        F.coalesce(F.bool_or(g & (F.col("locus") == 1)), F.lit(False)).alias("_l1"),
        F.coalesce(F.bool_or(g & (F.col("locus") == 2)), F.lit(False)).alias("_l2"),
        F.coalesce(F.bool_or(g & (F.col("contig") == special)), F.lit(False)).alias("_x"),
        F.bool_or(~g).alias("_nc"),
    )
    out = reads.join(e, "read", "left")
    mapped = F.col("_mapq").isNotNull()
    kind = F.when(F.col("assigned"), "assigned").when(F.col("_l1"), "locus1").when(F.col("_l2"), "locus2").when(F.col("_x") & (F.col("_mapq") >= low), "special").when(mapped & (F.col("_mapq") >= low), "other").when(mapped, "low_mapq").when(F.col("_nc"), "ncRNA").otherwise("unresolved")
    return out.select(*reads.columns, kind.alias("origin"))


def read_ids(df: DataFrame, header: str = "header") -> DataFrame:
    """(sample, read_id): the first token of the header without @ and a trailing /1 or /2, distinct."""
    return df.select("sample", F.regexp_replace(F.regexp_extract(header, r"^@?(\S+)", 1), "/[12]$", "").alias("read_id")).distinct()


def count_ratio(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Value counts of both by key and their ratio; missing is null."""
    n = lambda d, name: d.groupBy(key).agg(F.count("*").alias(name))
    return n(a, "n_a").join(n(b, "n_b"), key, "full").withColumn("ratio", F.try_divide("n_a", "n_b"))


def gene_expression(expr: DataFrame, cells: DataFrame, genes: DataFrame, gene: str) -> DataFrame:
    """Cells with the count of one gene (0 if none) and the gene's own columns; an unknown gene is an error."""
    one = genes.filter(F.col("gene") == gene)
    check = one.agg(F.when(F.count("*") == 0, F.raise_error(F.lit(f"unknown gene {gene}")).cast("int")).otherwise(1).alias("_ok"))
    counts = expr.filter(F.col("gene") == gene).groupBy("cell").agg(F.sum("count").alias("count"))
    out = cells.join(counts, "cell", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.crossJoin(F.broadcast(check)).filter("_ok = 1").drop("_ok").crossJoin(F.broadcast(one.limit(1)))
