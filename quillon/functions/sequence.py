"""Nucleotide sequences as string columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces_of(s: Column, width: int) -> Column:
    """s cut into pieces of a width, the last one may be shorter: one walk over s, where a substring for each place walks to it."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{width}}}"), 0)


def words_of(s: Column, width: int) -> Column:
    """The words of a width at all places of s, in one walk over it."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{width}}}))"), 1)


def revcomp(s: Column) -> Column:
    """reverse complement, upper case; N stays N."""
    return F.reverse(F.translate(F.upper(s), "ACGT", "TGCA"))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def hamming(a: Column, b: Column) -> Column:
    """number of differing places; strings of unequal length differ by the longer length."""
    same = F.aggregate(F.zip_with(_chars(a), _chars(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), same).otherwise(F.greatest(F.length(a), F.length(b)))


def find(s: Column, sub: str | Column, pos: int = 0) -> Column:
    """0-based first place of sub from pos on, -1 if absent."""
    sub = F.lit(sub) if isinstance(sub, str) else sub
    return F.call_function("locate", sub, s, F.lit(pos + 1)) - 1


def rfind(s: Column, sub: str | Column) -> Column:
    """0-based last place of sub, -1 if absent."""
    sub = F.lit(sub) if isinstance(sub, str) else sub
    back = F.call_function("locate", F.reverse(sub), F.reverse(s))
    return F.when(back > 0, F.length(s) - back - F.length(sub) + 1).otherwise(-1)


def candidates(s: Column, pos: Column, width: int = 8, reach: int = 2) -> Column:
    """array of (offset, word): the words of a width at pos - reach .. pos + reach that lie within s (0-based pos)."""
    offsets = F.filter(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: (pos + o >= 0) & (pos + o + width <= F.length(s)))
    return F.transform(offsets, lambda o: F.struct(o.alias("offset"), F.substring(s, pos + o + 1, F.lit(width)).alias("word")))


def base_count(s: Column, bases: str) -> Column:
    return F.length(s) - F.length(F.translate(s, bases, ""))


def fraction(s: Column, bases: str) -> Column:
    """share of the given bases, null for an empty sequence."""
    return F.try_divide(base_count(F.upper(s), bases).cast("double"), F.length(s))


def gc(s: Column) -> Column:
    """share of G and C."""
    return fraction(s, "GC")


def has_run(s: Column, n: int) -> Column:
    """a base repeated n times or more."""
    return F.upper(s).rlike(rf"([ACGT])\1{{{n - 1},}}")


def has_quad_g(s: Column) -> Column:
    """GGGG."""
    return F.upper(s).contains("GGGG")


def has_dinucleotide_run(s: Column, n: int) -> Column:
    """two different bases in turn, ceil(n / 2) times or more."""
    return F.upper(s).rlike(rf"([ACGT])(?!\1)([ACGT])(\1\2){{{max(0, math.ceil(n / 2) - 1)},}}")


def gc_clamp(s: Column) -> Column:
    """the last base is G or C."""
    return F.upper(F.right(s, F.lit(1))).isin("G", "C")


def starts_with_g(s: Column) -> Column:
    """the first base is G."""
    return F.upper(F.left(s, F.lit(1))) == "G"


def complement_run(a: Column, b: Column) -> Column:
    """longest run of matches between a and the reverse complement of b, over all offsets. A run that ends at a letter is at
    most one longer than the longest that ends before it, so each end is looked at once."""

    def longest(s: Column) -> Column:
        longer = lambda best, i: F.when(F.contains(s["y"], F.substring(s["x"], i - best, best + 1)), best + 1).otherwise(best)
        return F.when(F.least(s["n"], F.length(s["y"])) > 0, F.aggregate(F.sequence(F.lit(1), s["n"]), F.lit(0), longer)).otherwise(0)

    x = F.upper(a)
    once = F.array(F.struct(x.alias("x"), revcomp(b).alias("y"), F.length(x).alias("n")))  # worked out once, not at every step
    return F.coalesce(F.get(F.transform(once, longest), F.lit(0)), F.lit(0))


def mask_positions(seq: Column, positions: Column) -> Column:
    """F8: N at the listed 1-based places; places outside are left out."""
    inside = F.filter(positions, lambda p: (p >= 1) & (p <= F.length(seq)))
    return F.aggregate(inside, seq, lambda s, p: F.overlay(s, F.lit("N"), p, F.lit(1)))


def locate_in(seq: Column, ref: Column, ref_start: Column) -> Column:
    """(start, end, strand) of seq in ref in genome coordinates, the forward strand first; an error if it is on neither."""
    forward, back = F.instr(ref, seq), F.instr(ref, revcomp(seq))
    at = F.when(forward > 0, forward).when(back > 0, back).otherwise(F.raise_error(F.lit("sequence not found on either strand")).cast("int"))
    return F.struct((ref_start + at - 1).alias("start"), (ref_start + at + F.length(seq) - 2).alias("end"), F.when(forward > 0, "+").otherwise("-").alias("strand"))


def mean_phred(q: Column) -> Column:
    """mean of the quality characters less 33, null for an empty string."""
    total = F.aggregate(_chars(q), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c) - 33)
    return F.try_divide(total.cast("double"), F.length(q))


def low_complexity(s: Column, share: float = 0.5) -> Column:
    """Distinct 3-mers over all 3-mers below share; sequences of under 10 bases pass."""
    return F.when(F.length(s) < 10, False).otherwise(F.size(F.array_distinct(words_of(s, 3))) / (F.length(s) - 2) < share)


#: Four C within six bases: as many as two others lie between them.
_DENSE = "(?s)" + "|".join(f"C{'.' * a}C{'.' * b}C{'.' * c}C" for a in range(3) for b in range(3 - a) for c in range(3 - a - b))


def composition_rules(s: Column) -> list[Column]:
    """The five rules: A below 28 %; no AAAA; C above 22 % and below 28 %; no CCCC; no six bases with more than half C."""
    u = F.upper(s)
    dense = F.when(F.length(u) < 6, False).otherwise(u.rlike(_DENSE))
    c = fraction(u, "C")
    return [fraction(u, "A") < 0.28, ~u.contains("AAAA"), (c > 0.22) & (c < 0.28), ~u.contains("CCCC"), ~dense]


def rules_passed(s: Column, used: tuple[int, ...] = (1, 2, 3, 4, 5)) -> Column:
    """How many of the used rules hold."""
    rules = composition_rules(s)
    total = F.lit(0)
    for k in used:
        total = total + F.coalesce(rules[k - 1].cast("int"), F.lit(0))
    return total


def quality_ok(s: Column, masked: Column | None = None, low: float = 0.4, high: float = 0.6, run: int = 4) -> Column:
    """GC within the limits, no run above run bases, not masked."""
    good = gc(s).between(low, high) & ~has_run(s, run + 1)
    return good & ~masked if masked is not None else good


def rejected(s: Column, length: int, runs: tuple[int, ...] = (5, 6, 7)) -> Column:
    """Another length, an N, low complexity, or a run at one of the settings (the shortest decides)."""
    return (F.length(s) != length) | s.contains("N") | low_complexity(s) | has_run(s, min(runs))
