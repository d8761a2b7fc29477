"""Readers of the usual text formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.ordering import ranged, running

HITS6 = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart long, send long, evalue double, bitscore double"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, as_float: bool = False) -> DataFrame:
    """Header row, given or inferred types; as_float casts all columns."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.select(*(F.col(c).cast("double").alias(c) for c in df.columns)) if as_float else df


def read_tsv(spark: SparkSession, path: str, schema: str = "POS long, REF string, ALT string, B6_GT string, CAST_GT string, B6_BASE string, CAST_BASE string") -> DataFrame:
    """Tab-separated SNP table with header; pos0 is POS - 1."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path).withColumn("pos0", F.col("POS") - 1)


TRACK_COLUMNS = {"TRACK_ID": "trackID", "ID": "spotID", "FRAME": "frame", "POSITION_T": "t", "POSITION_X": "x", "POSITION_Y": "y", "RADIUS": "R", "MEAN_INTENSITY_CH1": "meanIntensity", "MEDIAN_INTENSITY_CH1": "medianIntensity", "MIN_INTENSITY_CH1": "minIntensity", "MAX_INTENSITY_CH1": "maxIntensity", "TOTAL_INTENSITY_CH1": "totalIntensity", "STD_INTENSITY_CH1": "stdIntensity", "CONTRAST_CH1": "contrast", "SNR_CH1": "SNR"}


def read_track_export(spark: SparkSession, path: str, columns: dict[str, str] = TRACK_COLUMNS) -> DataFrame:
    """S3: rows with a numeric ID (unit rows go), the named columns as doubles under new names, sorted by (trackID, t)."""
    df = spark.read.option("header", True).csv(path)
    return df.filter(F.col("ID").try_cast("double").isNotNull()).select(*(F.col(a).cast("double").alias(b) for a, b in columns.items())).orderBy("trackID", "t")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, value): the lines of text files with their number, from 0, in their file.

    Lines are numbered within the block of the file that a task reads and offset by the counts of the file's blocks before it.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("file", "block", "offset")
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("at") + F.col("offset")).alias("i"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq, qual) of four-line records, plain or gz; a record without all lines, or with unequal lengths, is an error.

    Numbered lines are gathered four by four. A gz file is one task.
    """
    lines = numbered_lines(spark, path)
    records = lines.groupBy("file", F.expr("i div 4").alias("record")).agg(*(F.max(F.when(F.col("i") % 4 == k, F.col("value"))).alias(n) for k, n in enumerate(("header", "seq", "plus", "qual"))))
    bad = F.col("qual").isNull() | ~F.col("header").startswith("@") | (F.length("seq") != F.length("qual"))
    header = F.when(bad, F.raise_error(F.lit("truncated record"))).otherwise(F.col("header"))
    return records.select(F.regexp_replace(F.regexp_extract(header, r"^@(\S+)", 1), "/[12]$", "").alias("read_id"), "seq", "qual")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): records from one '>' at a line's start to the next, sequence lines joined and kept as they are; other '>'
    belong to the header."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).filter(F.trim("value") != "")
    lines = F.split("value", r"\r?\n|\r$")
    return rows.select(F.regexp_extract(F.get(lines, F.lit(0)), r"^(\S+)", 1).alias("id"), F.concat_ws("", F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))).alias("seq"))


def read_fasta_chunks(spark: SparkSession, path: str, chunk: int = 1 << 20, halo: int = 0) -> DataFrame:
    """(id, offset, own, seq): contigs of any size in chunks of so many letters, each with up to halo letters of what follows; own
    letters of it, from its offset in the contig, are the chunk's. A contig without letters has no chunk.

    Lines find their contig by the number of headers before them, and their place in it by the letters of the contig before them; both
    are summed by ranges of lines, so neither a file nor a contig is one task's."""
    lines = numbered_lines(spark, path).withColumn("_head", F.col("value").startswith(">"))
    lines = running(lines, ["file", "i"], F.col("_head").cast("long"), "_heads")
    lines = lines.select(F.when(F.col("_head"), F.col("_heads") + 1).otherwise(F.col("_heads")).alias("_contig"), "file", "i", "value", "_head")
    names = lines.filter("_head").select("file", "_contig", F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("id"))
    letters = F.regexp_replace("value", r"\r$", "")
    own = lines.filter("not _head").select(F.struct("file", "_contig").alias("_k"), F.col("i").alias("_v"), letters.alias("value"))
    own = own.withColumn("_c", F.length("value").cast("long")).filter("_c > 0")
    placed = ranged(own)[0].select("_k.*", F.col("_before").alias("at"), "value", "_c")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("at") - halo) / chunk))
    parts = placed.withColumn("_chunk", F.explode(F.sequence(first, F.floor((F.col("at") + F.col("_c") - 1) / chunk))))
    begin = F.greatest(F.col("at"), F.col("_chunk") * chunk)
    stop = F.least(F.col("at") + F.col("_c"), (F.col("_chunk") + 1) * chunk + halo)
    cut = F.substring(F.col("value"), (begin - F.col("at") + 1).cast("int"), (stop - begin).cast("int"))
    parts = parts.filter(begin < stop).select("file", "_contig", "_chunk", F.struct(begin.alias("at"), cut.alias("part")).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
    chunks = parts.groupBy("file", "_contig", "_chunk").agg(whole.alias("seq"))
    chunks = chunks.join(names, ["file", "_contig"])  # what stands before a file's first header has no name and goes
    return chunks.select("id", (F.col("_chunk") * chunk).alias("offset"), F.least(F.length("seq"), F.lit(chunk)).cast("long").alias("own"), "seq")


def gtf_attributes(c: Column) -> Column:
    """Key "value" pairs as a map; the first of a repeated key counts."""
    keys, values = F.regexp_extract_all(c, F.lit(r'(\w+) "([^"]*)"'), 1), F.regexp_extract_all(c, F.lit(r'(\w+) "([^"]*)"'), 2)
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(0), F.size(keys) - 1).alias("i")), lambda e: F.array_position(keys, e["k"]) == e["i"] + 1)
    return F.when(F.size(keys) > 0, F.map_from_arrays(F.transform(first, lambda e: e["k"]), F.transform(first, lambda e: e["v"]))).otherwise(F.create_map().cast("map<string,string>"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, feature, start, end, strand, attrs, gene); comments and short rows go; gene is gene_name, else gene_id."""
    schema = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
    df = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path).filter("attributes is not null")
    df = df.select("chrom", "feature", "start", "end", "strand", gtf_attributes(F.col("attributes")).alias("attrs"))
    return df.withColumn("gene", F.coalesce(F.try_element_at("attrs", F.lit("gene_name")), F.try_element_at("attrs", F.lit("gene_id"))))


def genotype_base(gt: Column, ref: Column, alts: Column, missing: str | None = None) -> Column:
    """The first allele's base of a sample field; '.' is missing: null, or the given letter."""
    index = F.regexp_extract(F.get(F.split(gt, ":"), F.lit(0)), r"^(\d+)", 1).try_cast("int")
    base = F.get(F.concat(F.array(ref), alts), index)
    return base if missing is None else F.coalesce(base, F.lit(missing))


def read_vcf_informative(spark: SparkSession, path: str, s1: str, s2: str, single_base: bool = False, missing: str | None = None) -> DataFrame:
    """(chrom, pos, ref, alt, gt1, gt2, base1, base2) of rows in which two named samples differ. Only the header line is looked
    at on the driver, for the samples' columns."""
    text = spark.read.text(path)
    header = text.filter(F.col("value").startswith("#CHROM")).first()[0].split("\t")
    i1, i2 = header.index(s1), header.index(s2)
    f = F.split("value", "\t")
    rows = text.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("pos"), F.get(f, F.lit(3)).alias("ref"), F.get(f, F.lit(4)).alias("alt"), F.get(f, F.lit(i1)).alias("gt1"), F.get(f, F.lit(i2)).alias("gt2"))
    alts = F.split("alt", ",")
    out = rows.withColumn("base1", genotype_base(F.col("gt1"), F.col("ref"), alts, missing)).withColumn("base2", genotype_base(F.col("gt2"), F.col("ref"), alts, missing))
    out = out.filter("base1 is not null and base2 is not null and base1 <> base2")
    return out.filter("length(ref) = 1") if single_base else out


def read_alignments(spark: SparkSession, path: str, mapped_only: bool = False, region: tuple[str, int, int] | None = None) -> DataFrame:
    """SAM text: (read, flag, contig, start0, end0, mapq, cigar, seq) without secondary and supplementary rows, optionally
    mapped ones that touch a 0-based half-open region."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    df = rows.select(*(F.get(f, F.lit(i)).cast(t).alias(n) for i, n, t in ((0, "read", "string"), (1, "flag", "int"), (2, "contig", "string"), (3, "pos", "long"), (4, "mapq", "int"), (5, "cigar", "string"), (9, "seq", "string"))))
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    df = primary(df.withColumn("start0", F.col("pos") - 1).withColumn("end0", F.col("pos") - 1 + span).drop("pos"))
    df = df.filter(F.col("flag").bitwiseAND(4) == 0) if mapped_only or region else df
    return df if region is None else df.filter((F.col("contig") == region[0]) & (F.col("start0") < region[2]) & (F.col("end0") > region[1]))


def primary(df: DataFrame) -> DataFrame:
    """Rows that are neither secondary nor supplementary (flag & 2304 = 0)."""
    return df.filter(F.col("flag").bitwiseAND(2304) == 0)


def read_hits6(spark: SparkSession, path: str, with_strand: bool = False) -> DataFrame:
    """Tabular hits of 12 or 13 columns."""
    return spark.read.schema(HITS6 + (", sstrand string" if with_strand else "")).option("sep", "\t").option("comment", "#").csv(path)


def parse_blast_report(reports: DataFrame, text: str = "value", least: int = 15) -> DataFrame:
    """(probe, hits, identity1, identity2, unique): blocks of 'Query #n:' or 'Query='; hits are 'Identities = a/b (p%)' with b of
    at least 15; unique is exactly one."""
    block = F.explode(F.slice(F.split(text, r"(?m)^Query(?: #\d+:|=)\s*"), 2, F.greatest(F.size(F.split(text, r"(?m)^Query(?: #\d+:|=)\s*")) - 1, F.lit(1)))).alias("b")
    pattern = r"Identities = (\d+)/(\d+) \((\d+)%\)"
    b = reports.select(block)
    sizes, percents = (F.regexp_extract_all("b", F.lit(pattern), i) for i in (2, 3))
    kept = F.filter(F.arrays_zip(sizes.alias("n"), percents.alias("p")), lambda h: h["n"].cast("int") >= least)
    out = b.select(F.regexp_extract("b", r"^(\S+)", 1).alias("probe"), kept.alias("_h"))
    at = lambda i: F.get(F.transform("_h", lambda h: h["p"].cast("int")), F.lit(i))
    return out.select("probe", F.size("_h").alias("hits"), at(0).alias("identity1"), at(1).alias("identity2"), (F.size("_h") == 1).alias("unique"))


RUN = "sample string, summary struct<before_filtering:struct<total_reads:bigint,total_bases:bigint>,after_filtering:struct<total_reads:bigint,total_bases:bigint>>"


def run_columns(df: DataFrame) -> DataFrame:
    """Reads and bases before and after filtering (default 0) and the whole-number mean length, of rows of the schema RUN."""
    v = lambda a, b: F.coalesce(F.col(f"summary.{a}_filtering.{b}"), F.lit(0))
    out = df.select("sample", v("before", "total_reads").alias("reads_before"), v("after", "total_reads").alias("reads_after"), v("before", "total_bases").alias("bases_before"))
    return out.withColumn("mean_length", F.expr("bases_before div greatest(reads_before, 1)"))


def read_run_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON reports, one a file or one a line."""
    return run_columns(spark.read.schema(RUN).option("multiLine", multi_line).json(path))


def parse_acquisition(c: Column) -> Column:
    """(frames, pixel_size_um, exposure_ms, fps, interval_s) of a JSON text; anything but an object is empty; interval is 1 / fps,
    else exposure / 1000."""
    j = F.from_json(c, "Frames bigint, FramesPerSecond double, Exposure_ms double, PixelSize_um double", {"mode": "PERMISSIVE"})
    fps, exposure = j["FramesPerSecond"], j["Exposure_ms"]
    return F.struct(j["Frames"].alias("frames"), j["PixelSize_um"].alias("pixel_size_um"), exposure.alias("exposure_ms"), fps.alias("fps"), F.coalesce(F.try_divide(F.lit(1.0), fps), exposure / 1000).alias("interval_s"))


def parse_key_lines(lines: DataFrame, rules: dict[str, str], sample: str = "sample", text: str = "value") -> DataFrame:
    """One row a sample: for each name the number of the first group of its pattern, in lines that match."""
    hits = [F.max(F.regexp_extract(text, p, 1).try_cast("double")).alias(n) for n, p in rules.items()]
    return lines.groupBy(sample).agg(*hits)


FLAGSTAT = {"total": r"^(\d+) \+ \d+ in total", "mapped": r"^(\d+) \+ \d+ mapped", "proper_pair": r"^(\d+) \+ \d+ properly paired", "singletons": r"^(\d+) \+ \d+ singletons"}
STATS = {"bases_mapped": r"^SN\tbases mapped:\s*(\d+)", "insert_size": r"^SN\tinsert size average:\s*([\d.]+)", "error_rate": r"^SN\terror rate:\s*([\d.eE+-]+)"}


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, name, length) of files; contents aren't read."""
    return spark.read.format("binaryFile").load(glob).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def file_fields(files: DataFrame, pattern: str = r"^(.+?)_pos([XY])(\d+)_t(\d+)_posZ(\d+)", names: Sequence[str] = ("prefix", "axis", "pos", "t", "z"), excluded: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Fields of names by a pattern; other names and names with excluded tokens are skipped."""
    out = files.filter(F.col(name).rlike(pattern))
    for token in excluded:
        out = out.filter(~F.lower(name).contains(token.lower()))
    number = lambda i, n: F.regexp_extract(name, pattern, i + 1).alias(n)
    return out.select("*", *(number(i, n) for i, n in enumerate(names)))


def filter_paths(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Paths that match any include pattern (none: all) and no exclude pattern; * and ? as in a shell."""
    regex = lambda p: "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/" else "\\" + c) for c in p) + "$"
    anyof = lambda ps: F.col(path).rlike("|".join(map(regex, ps)))
    df = df.filter(anyof(include)) if include else df
    return df.filter(~anyof(exclude)) if exclude else df


def read_many(spark: SparkSession, paths: Sequence[str], name: str = "filename") -> DataFrame:
    """CSV files in one read, the file name as the first column; columns that a file lacks are null."""
    from functools import reduce

    frames = [spark.read.option("header", True).csv(p).select(F.col("_metadata.file_name").alias(name), "*") for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_plates(spark: SparkSession, path: str) -> DataFrame:
    """(plate, well, sequence) of sheets landed as CSV files of one layout; the sheet is the file name; the well column is the one
    whose name holds well and position."""
    df = spark.read.option("header", True).csv(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "").alias("plate"), "*")
    well = next(c for c in df.columns if "well" in c.lower() and "pos" in c.lower())
    sequence = next(c for c in df.columns if "sequence" in c.lower())
    return df.select("plate", F.col(well).alias("well"), F.col(sequence).alias("sequence"))


def read_clusters(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One keyed table (DPM, RPM, ...) of Parquet partitioned by key: only its folder is read."""
    return spark.read.parquet(path).filter(F.col("key") == key)
