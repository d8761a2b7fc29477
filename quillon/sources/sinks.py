"""Sinks: what Spark's writers make of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_by_sample(df: DataFrame, path: str, sample: str = "sample", mode: str = "errorifexists") -> None:
    """Parquet by sample, the rest under unassigned. Rows are dealt by sample and a salt first, so that a hot sample has several
    writers and others make few files."""
    out = df.withColumn(sample, F.coalesce(sample, F.lit("unassigned")))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    out.repartition(F.col(sample), salt).write.mode(mode).partitionBy(sample).parquet(path)


def bed_rows(df: DataFrame, score: str | None = None, flip: bool = True) -> DataFrame:
    """(chrom, start, end, name, score, strand): start - 1; the probe's strand is against its target's, unknown is '.';
    name is id/gene/region/SNPs; score or 0. df: chrom, start, end, strand, id, gene, region, snps."""
    s = F.col("strand")
    strand = F.when(s == "+", "-" if flip else "+").when(s == "-", "+" if flip else "-").otherwise(".")
    name = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "gene", "region", "snps")))
    value = F.coalesce(F.col(score), F.lit(0)) if score else F.lit(0)
    return df.select("chrom", (F.col("start") - 1).alias("start"), "end", name.alias("name"), value.alias("score"), strand.alias("strand"))


def to_bed(df: DataFrame, path: str, score: str | None = None, mode: str = "errorifexists") -> None:
    """Tab-separated BED files."""
    bed_rows(df, score).write.mode(mode).option("sep", "\t").option("header", False).csv(path)


def fasta_rows(df: DataFrame, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """One text a record."""
    return df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))


def to_fasta(df: DataFrame, path: str, id_col: str = "id", seq: str = "seq", mode: str = "errorifexists") -> None:
    """Text files of records."""
    fasta_rows(df, id_col, seq).write.mode(mode).text(path)


def is_written(df_or_spark, path: str) -> bool:
    """Whether a finished output is there: its _SUCCESS mark, seen through the path's own file system."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_stage(df: DataFrame, path: str, resume: bool = False, force: bool = False) -> str:
    """Run if there is no output or force; skip a finished one on resume; else an error. Spark's committer renames at the end."""
    if force or not is_written(df, path):
        df.write.mode("overwrite" if force else "errorifexists").parquet(path)
        return "run"
    if resume:
        return "skip"
    raise FileExistsError(path)


def long_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """(Section, Key, Value) of several two-column tables."""
    from functools import reduce

    rows = [d.select(F.lit(n).alias("Section"), F.col(d.columns[0]).cast("string").alias("Key"), F.col(d.columns[1]).cast("string").alias("Value")) for n, d in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def sample_column(c: Column) -> Column:
    return F.coalesce(c, F.lit("unassigned"))
