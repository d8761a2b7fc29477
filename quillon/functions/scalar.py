"""Geometry, text, JSON and small rules on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """A / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def primer_to_snp(end: Column, snp: Column, window: int, strand: Column | None = None) -> Column:
    """distance toward the 3' end, if it is within 1..window, else null; the minus strand counts downward."""
    d = snp - end if strand is None else F.when(strand == "-", end - snp).otherwise(snp - end)
    return F.when(d.between(1, window), d)


def fov_key(name: Column, suffix: str = r"[ _-]?(left|right)") -> Column:
    """file name less its extension and a channel suffix, in any case."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), rf"(?i){suffix}$", "")


def genotype_dose(s: Column) -> Column:
    """(genotype, dose) of names like WT_2.5uM; other names are an error."""
    pattern = r"^([A-Za-z0-9]+)_([0-9]+(?:\.[0-9]+)?)uM$"
    ok = s.rlike(pattern)
    genotype = F.when(ok, F.regexp_extract(s, pattern, 1)).otherwise(F.raise_error(F.concat(F.lit("unknown name: "), s)))
    return F.struct(genotype.alias("genotype"), F.regexp_extract(s, pattern, 2).try_cast("double").alias("dose"))


def fov_token(s: Column) -> Column:
    """the trailing FOV token, empty if there is none."""
    return F.regexp_extract(s, r"(?i)(fov[-_]?[0-9]+)$", 1)


def parse_array(s: Column) -> Column:
    """'[a, b]' as doubles."""
    return F.from_json(s, "array<double>")


def by_name(columns: list[str], name: Column) -> Column:
    """the value of the column that a row names."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("double"))]
    return F.try_element_at(F.create_map(*pairs), name)


def fold(ddcp: Column) -> Column:
    """2 to the minus ddcp."""
    return F.pow(F.lit(2.0), -ddcp)


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """F16: Euclidean distance."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def to_pixel(x: Column, size: int | Column) -> Column:
    """F16: rounded half to even and clipped to 0 .. size - 1."""
    top = F.lit(size - 1) if isinstance(size, int) else size - 1
    return F.least(F.greatest(F.rint(x), F.lit(0.0)), top.cast("double")).cast("int")


def mask_pixel(x: Column) -> Column:
    """F16: truncated toward zero, so -0.5 lies in pixel 0."""
    return x.cast("int")


def eq_diameter(area: Column) -> Column:
    """F16: diameter of the disc of that area."""
    return 2 * F.sqrt(area / F.pi())


def safe_log10(x: Column) -> Column:
    """null for what isn't positive."""
    return F.when(x > 0, F.log10(x))


def p_stars(p: Column) -> Column:
    """ns, *, **, ***, **** at .05, .01, .001, .0001."""
    return F.when(p < 1e-4, "****").when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def acquisition_profile(lasers: Column, exposure_ms: Column, binning: Column) -> Column:
    """first active laser (name, power, active), exposure and binning; points become p."""
    first = F.get(F.filter(lasers, lambda x: x["active"]), F.lit(0))
    text = F.concat_ws("_", F.coalesce(first["name"], F.lit("none")), F.coalesce(first["power"].cast("string"), F.lit("0")), exposure_ms.cast("string"), binning.cast("string"))
    return F.replace(text, F.lit("."), F.lit("p"))


def same_date(a: Column, b: Column) -> Column:
    """equal calendar dates."""
    return F.to_date(a) == F.to_date(b)


def epoch(ts: Column) -> Column:
    """seconds since 1970."""
    return F.unix_timestamp(ts)


def norm_chrom(c: Column, prefix: bool = False) -> Column:
    """Without the chr prefix, or with it."""
    bare = F.regexp_replace(c, "^chr", "")
    return F.concat(F.lit("chr"), bare) if prefix else bare


def clean_name(s: Column) -> Column:
    """Runs of anything but letters, digits, point, underscore and hyphen become _, ends are trimmed of ._-."""
    return F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")


def base_condition(s: Column) -> Column:
    """P10: without a trailing blank and number."""
    return F.regexp_replace(s, r"\s*\d+$", "")


def condition_of(s: Column, rules: dict[str, str], default: str | None = None) -> Column:
    """The first rule whose text is in the lower-case name; else the default, or the name."""
    out = None
    for needle, label in rules.items():
        hit = F.lower(s).contains(needle.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    last = s if default is None else F.lit(default)
    return last if out is None else out.otherwise(last)


def condition_by_regex(s: Column, pattern: str, labels: dict[str, str], group: int = 1) -> Column:
    """The label of a regex group; unmatched names stay."""
    key = F.regexp_extract(s, pattern, group)
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), key) if labels else F.lit(None)
    return F.coalesce(found, F.when(key != "", key), s)


def value_for(name: Column, tokens: dict[str, float], default: float) -> Column:
    """The value of the first token that the lower-case name holds."""
    out = None
    for token, value in tokens.items():
        hit = F.lower(name).contains(token.lower())
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def is_true(c: Column) -> Column:
    """True, 1 or yes as text, in any case."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def to_numeric(c: Column, strict: bool = False) -> Column:
    """Number, an error or null where it isn't one."""
    return c.cast("double") if strict else c.try_cast("double")


def range_status(count: Column, most: int) -> Column:
    """not_counted, outside or within."""
    return F.when(count.isNull(), "not_counted").when(count > most, "outside").otherwise("within")


def mask_rejected(values: Column, flag: Column) -> Column:
    """The largest value of an array, null unless the flag is 1."""
    return F.when(flag == 1, F.array_max(values))


def reasons(*checks: tuple[Column, str]) -> Column:
    """Array of the texts whose check holds (null counts as not)."""
    return F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in checks)))


def initiation_window(strand: Column, start: Column, end: Column, n: int = 15) -> Column:
    """(start, end) before a + probe, after a - probe, else null."""
    lo = F.when(strand == "+", start - n).when(strand == "-", end + 1)
    hi = F.when(strand == "+", start - 1).when(strand == "-", end + n)
    return F.when(lo.isNotNull(), F.struct(lo.alias("start"), hi.alias("end")))


def rt_region(strand: Column, start: Column, end: Column, length: int) -> Column:
    """P5: (start, end) of the region read after the probe; any strand but + counts as -."""
    plus = strand == "+"
    return F.struct(F.when(plus, start - length).otherwise(end + 1).alias("start"), F.when(plus, start - 1).otherwise(end + length).alias("end"))


def forward_window(strand: Column, start: Column, end: Column, least: int, most: int) -> Column:
    """(start, end) of the search window; strands +, 1, - and -1, else null."""
    s = strand.cast("string")
    lo = F.when(s.isin("+", "1"), start - most).when(s.isin("-", "-1"), end + least)
    hi = F.when(s.isin("+", "1"), start - least).when(s.isin("-", "-1"), end + most)
    return F.when(lo.isNotNull(), F.struct(lo.alias("start"), hi.alias("end")))


def accessible(pos: Column, strand: Column, start: Column, end: Column, low: int = 120, high: int = 404) -> Column:
    """NO within [low, high) of the amplicon position, YES outside."""
    at = F.when(strand == "-", end - pos).otherwise(pos - start)
    return F.when((at >= low) & (at < high), "NO").otherwise("YES")
