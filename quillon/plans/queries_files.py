"""Queries of readers, sinks and streams: text that Spark writes from the tables to the shared folder, read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import tables
from quillon.plans.registry import query
from quillon.plans.storage import fresh
from quillon.sources import readers, sinks
from quillon.streaming import jobs


def _text(df: DataFrame, name: str) -> str:
    """Write a value column as text files; the folder."""
    path = fresh(df.sparkSession, name)
    df.select("value").write.text(path)
    return path


def _csv(df: DataFrame, name: str, sep: str = ",", header: bool = True) -> str:
    path = fresh(df.sparkSession, name)
    df.write.option("header", header).option("sep", sep).csv(path)
    return path


def _lines(*columns):
    return F.concat_ws("\t", *(c.cast("string") for c in columns))


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part", "p_partkey p_size")
def s1_csv(d):
    return readers.read_csv(d.spark, _csv(d.part.select("p_partkey", "p_size"), "csv"), "p_partkey long, p_size int", as_float=True)


@query("SELECT pos AS POS, 'A' AS REF, genotype AS B6_GT, pos - 1 AS pos0 FROM v_snp")
def s2_tsv(d):
    t = d.v_snp.select(F.col("pos").alias("POS"), F.lit("A").alias("REF"), F.lit("C").alias("ALT"), F.col("genotype").alias("B6_GT"), F.lit("x").alias("CAST_GT"), F.lit("A").alias("B6_BASE"), F.lit("C").alias("CAST_BASE"))
    return readers.read_tsv(d.spark, _csv(t, "tsv", "\t")).select("POS", "REF", "B6_GT", "pos0")


@query('SELECT CAST(track AS DOUBLE) AS "trackID", CAST(frame AS DOUBLE) AS t, x FROM v_track', "trackID t x")
def s3_track_export(d):
    rows = d.v_track.select(*(F.col(s).cast("string").alias(n) for s, n in (("track", "TRACK_ID"), ("spot", "ID"), ("frame", "POSITION_T"), ("x", "POSITION_X"))))
    units = d.region.select(*(F.lit(u).alias(n) for u, n in (("", "TRACK_ID"), ("Spot ID", "ID"), ("(sec)", "POSITION_T"), ("(pixel)", "POSITION_X")))).limit(3)
    path = _csv(units.unionByName(rows), "tracks")
    return readers.read_track_export(d.spark, path, {"TRACK_ID": "trackID", "POSITION_T": "t", "POSITION_X": "x"})


@query("SELECT concat('r', read) AS read_id, seq, seq AS qual FROM v_seq")
def s4_fastq(d):
    rec = d.v_seq.select(F.concat(F.lit("@r"), F.col("read").cast("string"), F.lit("/1 x\n"), "seq", F.lit("\n+\n"), "seq").alias("value"))
    return readers.read_fastq(d.spark, _text(rec, "fastq"))


@query("SELECT contig AS chrom, 'exon' AS feature, start1 AS start, end1 AS stop, strand, concat('P', probe) AS gene FROM v_window")
def s6_gtf(d):
    q = F.lit('"')
    attrs = F.concat(F.lit("gene_id "), q, F.lit("G1"), q, F.lit("; gene_name "), q, F.lit("P"), F.col("probe").cast("string"), q, F.lit(";"))
    rows = d.v_window.select(_lines(F.col("contig"), F.lit("src"), F.lit("exon"), F.col("start1"), F.col("end1"), F.lit("."), F.col("strand"), F.lit("."), attrs).alias("value"))
    return readers.read_gtf(d.spark, _text(d.region.limit(1).select(F.lit("#comment").alias("value")).unionByName(rows), "gtf")).select("chrom", "feature", "start", F.col("end").alias("stop"), "strand", "gene")


@query("SELECT concat('chr', contig) AS chrom, pos, CASE snp % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'G' END AS base1, 'A' AS base2 FROM v_snp WHERE snp % 3 > 0 AND snp % 5 > 0")
def s7_vcf(d):
    head = d.region.limit(1).select(F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.lit("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "CAST", "B6"])))).alias("value"))
    gt = F.when(F.col("snp") % 5 == 0, ".").otherwise(F.concat((F.col("snp") % 3).cast("string"), F.lit("/1:30")))
    rows = d.v_snp.select(_lines(F.concat(F.lit("chr"), "contig"), F.col("pos"), F.lit("."), F.lit("A"), F.lit("C,G"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT:DP"), gt, F.lit("0/0:9")).alias("value"))
    return readers.read_vcf_informative(d.spark, _text(head.unionByName(rows), "vcf"), "CAST", "B6", single_base=True).select("chrom", "pos", "base1", "base2")


@query("SELECT concat('s', read) AS id, seq FROM v_seq")
def s8_s26_fasta(d):
    path = fresh(d.spark, "fasta")
    sinks.to_fasta(d.v_seq.withColumn("id", F.concat(F.lit("s"), F.col("read").cast("string"))), path)
    return readers.read_fasta(d.spark, path)


@query("SELECT concat('q', qname) AS read, CAST(qname % 512 AS INTEGER) AS flag, contig, start0, start0 + 10 AS end0, CAST(mapq AS INTEGER) AS mapq FROM v_read WHERE (CAST(qname % 512 AS INTEGER) & 2304) = 0")
def s9_alignments(d):
    rows = d.v_read.select(_lines(F.concat(F.lit("q"), F.col("qname").cast("string")), F.col("qname") % 512, F.col("contig"), F.col("start0") + 1, F.col("mapq"), F.lit("4M1D2I5M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGTACGTACG"), F.lit("*")).alias("value"))
    head = d.region.limit(1).select(F.lit("@HD\tVN:1.6").alias("value"))
    return readers.read_alignments(d.spark, _text(head.unionByName(rows), "sam")).select("read", "flag", "contig", "start0", "end0", "mapq")


@query("SELECT CAST(p_partkey AS VARCHAR) AS qseqid, p_brand AS sseqid, 90.5 AS pident, p_size AS length, 'plus' AS sstrand FROM part", "pident")
def s10_hits6(d):
    n = lambda v, c: F.lit(v).alias(c)
    t = d.part.select(F.col("p_partkey").alias("q"), F.col("p_brand").alias("s"), n(90.5, "p"), F.col("p_size").alias("l"), *(n(1, f"c{i}") for i in range(6)), n(1e-9, "e"), n(50.0, "b"), n("plus", "st"))
    return readers.read_hits6(d.spark, _csv(t, "hits", "\t", header=False), with_strand=True).select("qseqid", "sseqid", "pident", "length", "sstrand")


@query("SELECT concat('p', p_partkey) AS probe, CAST(CASE WHEN p_size >= 15 THEN 2 ELSE 1 END AS INTEGER) AS hits, CASE WHEN p_size >= 15 THEN 95 ELSE 100 END AS identity1, p_size < 15 AS is_unique FROM part")
def s11_blast_report(d):
    size = F.col("p_size").cast("string")
    block = F.concat(F.lit("Query #1: p"), F.col("p_partkey").cast("string"), F.lit("\n Identities = 19/"), size, F.lit(" (95%)\n Identities = 20/20 (100%)\n"))
    reports = d.part.select(F.concat(F.lit("head\n"), block).alias("value"))
    return readers.parse_blast_report(reports).select("probe", "hits", "identity1", F.col("unique").alias("is_unique"))


@query("SELECT p_name AS sample, CAST(p_size AS BIGINT) AS reads_before, CAST(0 AS BIGINT) AS reads_after, CAST(floor(p_retailprice) AS BIGINT) AS bases_before, CAST(floor(p_retailprice) AS BIGINT) // greatest(p_size, 1) AS mean_length FROM part")
def s12_run_json(d):
    j = d.part.select(F.to_json(F.struct(F.col("p_name").alias("sample"), F.struct(F.struct(F.col("p_size").alias("total_reads"), F.floor("p_retailprice").alias("total_bases")).alias("before_filtering")).alias("summary"))).alias("value"))
    path = fresh(d.spark, "json")
    j.write.text(path)
    return readers.read_run_json(d.spark, path, multi_line=False).select("sample", "reads_before", "reads_after", "bases_before", "mean_length")


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id % 100 END AS frames, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 / 20.0::DOUBLE ELSE 0.03 END AS interval_s FROM events", "interval_s")
def s13_acquisition(d):
    n = (F.col("event_id") % 100).cast("string")
    text = F.when(F.col("event_id") % 4 == 0, "not json").when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"Frames": '), n, F.lit(', "FramesPerSecond": 20}'))).otherwise(F.concat(F.lit('{"Frames": '), n, F.lit(', "Exposure_ms": 30}')))
    return d.events.select("event_id", readers.parse_acquisition(text).alias("a")).select("event_id", "a.frames", "a.interval_s")


@query("SELECT status AS sample, max(cust)::DOUBLE AS total, max(id % 100)::DOUBLE AS mapped FROM v_assay GROUP BY status", "total mapped")
def s14_flagstat(d):
    lines = F.explode(F.array(F.concat(F.col("cust").cast("string"), F.lit(" + 0 in total (QC-passed)")), F.concat((F.col("id") % 100).cast("string"), F.lit(" + 0 mapped (98%)")))).alias("value")
    return readers.parse_key_lines(d.v_assay.select(F.col("status").alias("sample"), lines), readers.FLAGSTAT).select("sample", "total", "mapped")


@query("SELECT concat('img', track) AS prefix, 'X' AS axis, CAST(cell AS VARCHAR) AS pos, CAST(frame AS VARCHAR) AS t, '3' AS z FROM v_track WHERE cell <> 2")
def s15_s16_file_fields(d):
    names = d.v_track.select(F.concat(F.lit("img"), "track", F.lit("_posX"), "cell", F.lit("_t"), "frame", F.lit("_posZ3.tif")).alias("name")).withColumn("path", F.concat(F.lit("/a/"), "name"))
    kept = readers.filter_paths(names, ["/a/img*"], ["*_posX2_*"])
    return readers.file_fields(kept).select("prefix", "axis", "pos", "t", "z")


@query("SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL FROM supplier")
def s17_read_many(d):
    a = _csv(d.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "many")
    b = _csv(d.supplier.select(F.col("s_suppkey").alias("k")), "many")
    return readers.read_many(d.spark, [a, b]).drop("filename")


@query("SELECT p_brand AS well, p_name AS sequence FROM part")
def s18_plates(d):
    return readers.read_plates(d.spark, _csv(d.part.select(F.col("p_brand").alias("Well Position"), F.col("p_name").alias("Sequence")), "plates")).select("well", "sequence")


@query("SELECT id, Base AS key FROM v_assay WHERE Base = 'HIGH'")
def s19_s23_clusters(d):
    path = fresh(d.spark, "clusters")
    sinks.write_by_sample(d.v_assay.select("id", F.col("Base").alias("key")), path, "key")
    return readers.read_clusters(d.spark, path, "HIGH").select("id", "key")


@query("SELECT contig AS chrom, start1 - 1 AS start, end1 AS stop, concat(probe, '/', gene, '//') AS name, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS strand FROM v_window")
def s25_bed(d):
    rows = d.v_window.select(F.col("contig").alias("chrom"), F.col("start1").alias("start"), F.col("end1").alias("end"), "strand", F.col("probe").alias("id"), "gene", F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("snps"))
    path = fresh(d.spark, "bed")
    sinks.to_bed(rows, path)
    return d.spark.read.schema("chrom string, start long, stop long, name string, score long, strand string").option("sep", "\t").csv(path).drop("score")


@query("SELECT c_custkey, c_nationkey FROM customer")
def s27_write_policy(d):
    path = fresh(d.spark, "stage")
    rows = d.customer.select("c_custkey", "c_nationkey")
    sinks.write_stage(rows, path)
    if sinks.write_stage(rows.filter("false"), path, resume=True) != "skip":
        raise AssertionError("a finished stage was written again")
    return d.spark.read.parquet(path)


@query("SELECT event_id, event_type FROM events")
def t1_intake(d):
    source, out, ck = (fresh(d.spark, n) for n in ("in", "out", "ck"))
    rows = d.events.select("event_id", "event_type")
    rows.repartition(4).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        jobs.start_intake(jobs.ingest(d.spark, source, rows.schema), out, ck, {"k": 1}).awaitTermination()
    return d.spark.read.parquet(out)


@query("SELECT user_id, max_by(event_id, event_id) AS event_id FROM events GROUP BY user_id")
def t2_status(d):
    source, table, ck = (fresh(d.spark, n) for n in ("in", "status", "ck"))
    rows = d.events.select("user_id", "event_id")
    rows.repartition(2).write.parquet(source)
    jobs.status_sink(jobs.ingest(d.spark, source, rows.schema, files_per_trigger=1), table, ["user_id"], ["event_id"], ck).awaitTermination()
    return jobs.status_table(d.spark, table, rows.schema)


@query("SELECT n_done, n_total, rate, (total - planned) * rate AS remaining_s FROM (SELECT count(*) FILTER (event_id % 3 > 0) AS n_done, count(*) AS n_total, least(greatest(sum(CASE WHEN event_id % 3 > 0 THEN value * 2 ELSE 0 END) / sum(CASE WHEN event_id % 3 > 0 THEN value ELSE 0 END), 0.5), 3.0) AS rate, sum(value) AS total, sum(CASE WHEN event_id % 3 > 0 THEN value ELSE 0 END) AS planned FROM events)", "rate remaining_s")
def t3_progress(d):
    return jobs.progress(d.events.select(F.col("value").alias("planned_s"), F.when(F.col("event_id") % 3 > 0, F.col("value") * 2).alias("actual_s")))


@query("SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) < 3600000000 THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g HAVING count(*) >= 3")
def t4_session_window(d):
    return jobs.sessions(d.events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "1 hour", least=3).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("SELECT CAST(user_id AS BIGINT) AS k, CAST(count(*) * 2 AS BIGINT) AS n FROM events GROUP BY user_id")
def d2_group_function(d):
    import pandas as pd

    def twice(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf.user_id.iloc[:1], "n": [2 * len(pdf)]})

    return d.events.select("user_id").groupBy("user_id").applyInPandas(twice, "k long, n long")


@query("SELECT event_id, upper(event_type) AS kind, event_id % 3 AS part FROM events WHERE event_id % 3 < 2")
def d1_d3_d4_functions(d):
    from quillon.functions.user import apply_rows, expand, rules_to_filter

    rows = apply_rows(d.events.select("event_id", "event_type"), "kind", lambda e: e.upper(), "string", "event_type")
    grown = expand(rows, F.array((F.col("event_id") % 3)), "part")
    return rules_to_filter(grown, {"part": {"below": 2}}).select("event_id", "kind", "part")


@query("SELECT Base, status FROM (SELECT Base, status, row_number() OVER (PARTITION BY Base ORDER BY id) AS r FROM v_assay) WHERE r = 1")
def o9_first_variant(d):
    return tables.first_per_key(d.v_assay, ["Base"], ["id"]).select("Base", "status")
