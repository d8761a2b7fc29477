"""Contigs larger than a split, in chunks: the same letters and the same places as whole contigs."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import intervals
from quillon.sources import readers


@pytest.fixture(scope="module")
def genome(spark, tmp_path_factory):
    """Two files; one contig of 30,000 letters over many splits, short and empty ones, uneven lines, blank lines, '>' in a header."""
    rng = random.Random(1)
    folder = tmp_path_factory.mktemp("fasta")
    contigs = {"big": "".join(rng.choices("ACGT", k=30_000)), "tiny": "ACGTACGTTG", "none": "", "lower": "".join(rng.choices("acgt", k=999)), "second": "".join(rng.choices("ACGT", k=2001))}
    for name, some in (("a", ("big", "tiny")), ("b", ("none", "lower", "second"))):
        text = "; a comment before the first header\n"
        for c in some:
            text += f">{c} some > text\r\n" if c == "lower" else f">{c}\n"
            at = 0
            while at < len(contigs[c]):
                n = rng.choice([1, 60, 60, 61, 500])
                text += contigs[c][at : at + n] + ("\r\n" if c == "lower" else "\n") + "\n" * (rng.random() < 0.05)
                at += n
        (folder / f"{name}.fa").write_bytes(text.encode())
    return str(folder), contigs


@pytest.mark.parametrize("chunk,halo", [(1000, 0), (1000, 40), (64, 200), (1 << 20, 30)])
def test_chunks_are_the_contigs(spark, genome, chunk, halo):
    folder, contigs = genome
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_fasta_chunks(spark, folder, chunk, halo).collect()
        assert readers.numbered_lines(spark, folder).rdd.getNumPartitions() >= 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(c, at): (min(chunk, len(s) - at), s[at : at + chunk + halo]) for c, s in contigs.items() for at in range(0, len(s), chunk)}
    assert {(r.id, r.offset): (r.own, r.seq) for r in rows} == want and len(rows) == len(want)


def test_places_across_borders_of_chunks(spark, genome):
    """Guides that lie over a border are found once; places and partial places are those on whole contigs."""
    folder, contigs = genome
    rng = random.Random(2)
    comp = str.maketrans("ACGTacgt", "TGCATGCA")
    guides = [(f"g{i}", contigs["big"][a : a + n]) for i, (a, n) in enumerate([(990, 24), (999, 24), (1000, 24), (1980, 40), (0, 20), (29_970, 30)])]
    guides += [("back", contigs["second"][985:1015].translate(comp)[::-1]), ("low", contigs["lower"][10:34].upper()), ("part", contigs["big"][5000:5020] + "".join(rng.choices("ACGT", k=15)))]
    table = spark.createDataFrame(guides, "guide string, seq string")
    whole = spark.createDataFrame(list(contigs.items()), "contig string, seq string")
    chunks = readers.read_fasta_chunks(spark, folder, 1000, 40).withColumnRenamed("id", "contig")
    want = sorted(map(tuple, intervals.placed(table, whole, strict=False).collect()))
    assert sorted(map(tuple, intervals.placed(table, chunks, strict=False).collect())) == want
    plain = [(g, c, i, s) for g, q in guides for c, t in contigs.items() for s, x in (("+", q), ("-", q.translate(comp)[::-1])) for i in range(len(t)) if t[i : i + len(x)].upper() == x]
    assert want == sorted(plain) and {g for g, *_ in want} == {g for g, _ in guides} - {"part"}
    parts = {r.guide: r.n for r in intervals.partial_places(table, chunks).collect()}
    assert parts == {r.guide: r.n for r in intervals.partial_places(table, whole).collect()} and parts["part"] == 1


def test_letters_are_not_shuffled_with_places(spark):
    """What meets the seeds is a piece's number, a place and a seed."""
    guides = spark.createDataFrame([("g", "ACGTACGTACGTACGTACGTACGTAAAA")], "guide string, seq string")
    genome = spark.range(1).select(F.lit("c").alias("contig"), F.repeat(F.lit("ACGTTGCA"), 5000).alias("seq"))
    plan = intervals.partial_places(guides, genome)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x and "_seed" in x]
    assert joins and not any("_here" in x for x in plan.split("\n"))
