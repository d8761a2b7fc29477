"""Queries of the table, scalar, set and sort operators, each with the DuckDB text that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.functions import sequence as Q
from quillon.operators import stats, tables
from quillon.plans.registry import query

_REVCOMP = "reverse(translate(upper({0}), 'ACGT', 'TGCA'))"

# --- scalar functions ---------------------------------------------------------------------------------------


@query("SELECT read, reverse(translate(upper(seq), 'ACGT', 'TGCA')) AS rc, CAST(hamming(seq, reverse(seq)) AS INTEGER) AS d, CAST(instr(seq, 'ACG') - 1 AS INTEGER) AS first, CAST(CASE WHEN instr(reverse(seq), 'GCA') > 0 THEN length(seq) - instr(reverse(seq), 'GCA') - 2 ELSE -1 END AS INTEGER) AS last FROM v_seq")
def f1_f3_sequence_search(d):
    s = F.col("seq")
    return d.v_seq.select("read", Q.revcomp(s).alias("rc"), Q.hamming(s, F.reverse(s)).alias("d"), Q.find(s, "ACG").alias("first"), Q.rfind(s, "ACG").alias("last"))


@query("SELECT read, CAST(o AS INTEGER) AS offset, substr(seq, 11 + CAST(o AS INTEGER), 8) AS word FROM (SELECT read, seq, unnest(range(-2, 3)) AS o FROM v_seq) AS e WHERE 10 + o + 8 <= length(seq)")
def f4_offset_words(d):
    return d.v_seq.select("read", F.explode(Q.candidates(F.col("seq"), F.lit(10))).alias("c")).select("read", "c.offset", "c.word")


@query("SELECT read, (length(seq) - length(translate(seq, 'GC', ''))) / length(seq)::DOUBLE AS gc, (length(seq) - length(translate(seq, 'A', ''))) / length(seq)::DOUBLE AS a FROM v_seq", "gc a")
def f5_base_fractions(d):
    return d.v_seq.select("read", Q.gc(F.col("seq")).alias("gc"), Q.fraction(F.col("seq"), "A").alias("a"))


@query("SELECT read, (regexp_matches(seq, 'A{5}|C{5}|G{5}|T{5}')) AS run5, contains(seq, 'GGGG') AS quad, right(seq, 1) IN ('G', 'C') AS clamp, left(seq, 1) = 'G' AS starts_g FROM v_seq")
def f6_runs(d):
    s = F.col("seq")
    return d.v_seq.select("read", Q.has_run(s, 5).alias("run5"), Q.has_quad_g(s).alias("quad"), Q.gc_clamp(s).alias("clamp"), Q.starts_with_g(s).alias("starts_g"))


@query("SELECT read, concat(substr(seq, 1, 4), 'N', substr(seq, 6, 4), 'N', CASE WHEN length(seq) >= 5000 THEN concat(substr(seq, 11, 4989), 'N', substr(seq, 5001)) ELSE substr(seq, 11) END) AS masked FROM v_seq")
def f8_mask(d):
    return d.v_seq.select("read", Q.mask_positions(F.col("seq"), F.array(F.lit(5), F.lit(10), F.lit(0), F.lit(5000))).alias("masked"))


@query("SELECT read, 1000 + 10 AS start, 1000 + 21 AS stop, CASE WHEN fwd > 0 THEN '+' ELSE '-' END AS strand FROM (SELECT *, instr(seq, substr(seq, 11, 12)) AS fwd FROM v_seq) AS q WHERE fwd = 11")
def f9_locate(d):
    at = Q.locate_in(F.substring("seq", 11, 12), F.col("seq"), F.lit(1000))
    return d.v_seq.select("read", at.alias("a"), "seq").filter(F.instr(F.col("seq"), F.substring("seq", 11, 12)) == 11).select("read", "a.start", F.col("a.end").alias("stop"), "a.strand")


@query("SELECT event_id, CASE WHEN v BETWEEN 1 AND 20 THEN v END AS dist FROM (SELECT event_id, user_id - event_id % 97 AS v FROM events) AS q")
def f10_primer_distance(d):
    return d.events.select("event_id", S.primer_to_snp(F.col("event_id") % 97, F.col("user_id"), 20).alias("dist"))


@query("SELECT read, list_avg(list_transform(string_split(seq, ''), lambda c: ascii(c) - 33)) AS q FROM v_seq", "q")
def f11_mean_phred(d):
    return d.v_seq.select("read", Q.mean_phred(F.col("seq")).alias("q"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS clean, regexp_extract(url, '([0-9]+)', 1) AS number FROM pages")
def f12_p9_names(d):
    return d.pages.select("page_id", S.clean_name(F.col("url")).alias("clean"), F.regexp_extract("url", "([0-9]+)", 1).alias("number"))


@query("SELECT event_id, list_sum(CAST(concat('[', k, ', ', event_id % 5, '.5]') AS DOUBLE[])) AS total FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) AS q", "total")
def f13_array_text(d):
    text = F.concat(F.lit("["), F.regexp_extract("props", "([0-9]+)", 1), F.lit(", "), (F.col("event_id") % 5).cast("string"), F.lit(".5]"))
    return d.events.select("event_id", F.aggregate(S.parse_array(text), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT l_orderkey, l_linenumber, CASE CAST(l_linenumber % 2 AS BIGINT) WHEN 0 THEN l_quantity ELSE l_discount END AS named, pow(2.0, -l_discount) AS fold FROM lineitem", "named fold")
def f14_f15_named_column(d):
    name = F.when(F.col("l_linenumber") % 2 == 0, "l_quantity").otherwise("l_discount")
    return d.lineitem.select("l_orderkey", "l_linenumber", S.by_name(["l_quantity", "l_discount"], name).alias("named"), S.fold(F.col("l_discount")).alias("fold"))


@query("SELECT spot, CAST(least(greatest(round_even(x, 0), 0), 7) AS INTEGER) AS px, CAST(trunc(x) AS INTEGER) AS mx, sqrt((x - y) * (x - y) + (y - x) * (y - x)) AS dist, 2 * sqrt(abs(x) / pi()) AS dia, CASE WHEN x > 0 THEN log10(x) END AS lg FROM v_spot", "dist dia lg")
def f16_f17_geometry(d):
    x, y = F.col("x"), F.col("y")
    return d.v_spot.select("spot", S.to_pixel(x, 8).alias("px"), S.mask_pixel(x).alias("mx"), S.dist(x, y, y, x).alias("dist"), S.eq_diameter(F.abs(x)).alias("dia"), S.safe_log10(x).alias("lg"))


@query("SELECT event_id, CASE WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT event_id, event_id % 1000 / 10000.0::DOUBLE AS p FROM events) AS q")
def f18_stars(d):
    return d.events.select("event_id", S.p_stars(F.col("event_id") % 1000 / F.lit(10000.0)).alias("stars"))


@query("SELECT event_id, concat(CASE WHEN event_id % 3 = 0 THEN 'red' ELSE 'blue' END, '_', CASE WHEN event_id % 3 = 0 THEN '2p5' ELSE '7p5' END, '_', event_id % 50, '_2') AS profile FROM events")
def f19_profile(d):
    laser = lambda n, p, a: F.struct(F.lit(n).alias("name"), F.lit(p).alias("power"), a.alias("active"))
    lasers = F.array(laser("red", 2.5, F.col("event_id") % 3 == 0), laser("blue", 7.5, F.lit(True)))
    return d.events.select("event_id", S.acquisition_profile(lasers, F.col("event_id") % 50, F.lit(2)).alias("profile"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) = DATE '1996-01-02' AS same, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def f20_dates(d):
    return d.orders.select("o_orderkey", S.same_date(F.col("o_orderdate"), F.lit("1996-01-02").cast("timestamp")).alias("same"), S.epoch(F.col("o_orderdate").cast("timestamp")).alias("seconds"))


# --- projections and filters ----------------------------------------------------------------------------------


@query("SELECT p_size, p_partkey, p_brand FROM part")
def p1_p2_reorder(d):
    return tables.reorder(tables.require(d.part, ["p_partkey"]), ["p_size", "nope", "p_partkey", "p_brand"])


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS t FROM events", "k")
def p3_to_numeric(d):
    return d.events.select("event_id", S.to_numeric(F.regexp_extract("props", "([0-9]+)", 1), strict=True).alias("k"), S.to_numeric(F.col("event_type")).alias("t"))


@query("SELECT probe, CASE WHEN strand = '+' THEN start1 - 15 ELSE end1 + 1 END AS i0, CASE WHEN strand = '+' THEN start1 - 1 ELSE end1 + 15 END AS i1, CASE WHEN strand = '+' THEN start1 - 50 ELSE end1 + 1 END AS r0, CASE WHEN strand = '+' THEN start1 - 1 ELSE end1 + 50 END AS r1, CASE WHEN strand = '+' THEN start1 - 90 ELSE end1 + 20 END AS f0, CASE WHEN strand = '+' THEN start1 - 20 ELSE end1 + 90 END AS f1, CASE WHEN CASE WHEN strand = '-' THEN end1 - 500 ELSE 500 - start1 END BETWEEN 120 AND 403 THEN 'NO' ELSE 'YES' END AS ok FROM v_window")
def p4_p6_p32_windows(d):
    a = (F.col("strand"), F.col("start1"), F.col("end1"))
    w = d.v_window.select("probe", S.initiation_window(*a).alias("i"), S.rt_region(*a, 50).alias("r"), S.forward_window(*a, 20, 90).alias("f"), S.accessible(F.lit(500), *a).alias("ok"))
    return w.select("probe", *(F.col(f"{c}.{e}").alias(f"{c}{k}") for c in "irf" for k, e in enumerate(("start", "end"))), "ok")


@query("SELECT o_orderkey, regexp_replace(o_orderpriority, '^chr', '') AS chrom, concat('chr', o_orderpriority) AS with_chr, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'top' WHEN contains(lower(o_orderpriority), 'high') THEN 'second' ELSE o_orderpriority END AS cond, CASE regexp_extract(o_orderpriority, '^([0-9])', 1) WHEN '1' THEN 'one' WHEN '2' THEN 'two' ELSE regexp_extract(o_orderpriority, '^([0-9])', 1) END AS letter, regexp_replace(concat(o_orderstatus, ' ', o_orderkey), '\\s*\\d+$', '') AS base, CASE WHEN contains(lower(o_orderpriority), 'low') THEN 2.5 ELSE 1.0 END AS val, lower(o_orderstatus) IN ('true', '1', 'yes') AS truthy FROM orders", "val")
def p7_p10_p19_p33_names(d):
    p = F.col("o_orderpriority")
    return d.orders.select("o_orderkey", S.norm_chrom(p).alias("chrom"), S.norm_chrom(p, True).alias("with_chr"), S.condition_of(p, {"urgent": "top", "high": "second"}).alias("cond"), S.condition_by_regex(p, "^([0-9])", {"1": "one", "2": "two"}).alias("letter"), S.base_condition(F.concat("o_orderstatus", F.lit(" "), F.col("o_orderkey").cast("string"))).alias("base"), S.value_for(p, {"low": 2.5}, 1.0).alias("val"), S.is_true(F.col("o_orderstatus")).alias("truthy"))


@query("SELECT p_partkey, concat_ws(';', CASE WHEN p_size < 10 THEN 'small' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END) AS reason, NOT (p_size < 10 OR p_retailprice > 1500) AS accepted FROM part")
def p11_accept(d):
    return tables.accept_inputs(d.part, [(F.col("p_size") < 10, "small"), (F.col("p_retailprice") > 1500, "dear")]).select("p_partkey", "reason", "accepted")


@query("SELECT label, edge_distance, concat_ws(';', CASE WHEN area < 2000 THEN 'small_area' END, CASE WHEN edge_distance < 1 THEN 'near_edge' END) AS reason FROM (SELECT label, count(*) AS area, least(min(x), min(y), 8 - (max(x) + 1), 8 - (max(y) + 1)) AS edge_distance FROM v_pixel GROUP BY label) AS q")
def p12_region_qc(d):
    from quillon.operators.pixels import region_props

    r = region_props(d.v_pixel, ["fov"]).withColumn("width", F.lit(8)).withColumn("height", F.lit(8))
    return tables.region_qc(r, 2000, 1).select("label", "edge_distance", "reason")


@query("SELECT fov, track, x, y FROM v_track WHERE coalesce(x, 0) > 2 AND coalesce(y, 0) < 5")
def p20_threshold_filter(d):
    return tables.threshold_filter(d.v_track, {"x": ("Above", 2), "y": ("Below", 5)}).select("fov", "track", "x", "y")


@query("SELECT o_orderkey, CASE WHEN n IS NULL THEN 'not_counted' WHEN n > 5 THEN 'outside' ELSE 'within' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN greatest(o_orderkey % 7, 2) END AS steps FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 END AS n FROM orders) AS q")
def p17_p18_status(d):
    n = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 9)
    return d.orders.select("o_orderkey", S.range_status(n, 5).alias("status"), S.mask_rejected(F.array(F.col("o_orderkey") % 7, F.lit(2)), F.col("o_orderkey") % 3).alias("steps"))


@query("SELECT read, CAST((a < 0.28)::INT + (NOT contains(seq, 'AAAA'))::INT + (c > 0.22 AND c < 0.28)::INT + (NOT contains(seq, 'CCCC'))::INT + (NOT dense)::INT AS INTEGER) AS n, g BETWEEN 0.4 AND 0.6 AND NOT regexp_matches(seq, 'A{5}|C{5}|G{5}|T{5}') AS good, CASE WHEN length(seq) < 10 THEN false ELSE km / (length(seq) - 2)::DOUBLE < 0.5 END AS low FROM (SELECT read, seq, (length(seq) - length(translate(seq, 'A', ''))) / length(seq)::DOUBLE AS a, (length(seq) - length(translate(seq, 'C', ''))) / length(seq)::DOUBLE AS c, (length(seq) - length(translate(seq, 'GC', ''))) / length(seq)::DOUBLE AS g, len(list_distinct(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 3)))) AS km, len(list_filter(range(1, length(seq) - 4), lambda i: length(substr(seq, i, 6)) - length(translate(substr(seq, i, 6), 'C', '')) > 3)) > 0 AS dense FROM v_seq) AS q")
def p21_p22_p24_sequence_rules(d):
    s = F.col("seq")
    return d.v_seq.select("read", Q.rules_passed(s).alias("n"), Q.quality_ok(s).alias("good"), Q.low_complexity(s).alias("low"))


@query("SELECT read, CAST(i AS BIGINT) AS tile, length(seq) <> 31 OR contains(seq, 'N') OR regexp_matches(seq, 'A{5}|C{5}|G{5}|T{5}') OR len(list_distinct(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 3)))) / (length(seq) - 2)::DOUBLE < 0.5 AS rejected FROM (SELECT read, i, substr(seq, CAST(i * 31 + 1 AS INT), 31) AS seq FROM (SELECT read, seq, unnest(range(0, CAST(ceil(length(seq) / 31.0) AS BIGINT))) AS i FROM v_seq) WHERE length(seq) - i * 31 >= 3)")
def p23_reject(d):
    tiles = d.v_seq.select("read", F.posexplode(Q.pieces_of(F.col("seq"), 31)).alias("tile", "probe")).filter("length(probe) >= 3")
    return tiles.select("read", F.col("tile").cast("long").alias("tile"), Q.rejected(F.col("probe"), 31).alias("rejected"))


@query("SELECT t.track, frame FROM v_track t JOIN (SELECT track FROM v_track GROUP BY track HAVING count(*) >= 60) g ON t.track = g.track")
def p16_min_length(d):
    return tables.min_length(d.v_track, ["track"], 60).select("track", "frame")


@query("SELECT track, spot FROM (SELECT track, spot, row_number() OVER (PARTITION BY track ORDER BY frame, spot) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM v_track) AS q WHERE i IN (round_even(0 * (n - 1) / 4.0::DOUBLE, 0), round_even(1 * (n - 1) / 4.0::DOUBLE, 0), round_even(2 * (n - 1) / 4.0::DOUBLE, 0), round_even(3 * (n - 1) / 4.0::DOUBLE, 0), round_even(4 * (n - 1) / 4.0::DOUBLE, 0))")
def p28_even_sample(d):
    return tables.even_sample(d.v_track, 5, ["frame", "spot"], ["track"]).select("track", "spot")


@query("SELECT track, frame FROM v_track WHERE frame IN (SELECT frame FROM v_track GROUP BY frame HAVING count(DISTINCT track) = (SELECT count(DISTINCT track) FROM v_track))")
def p29_common_frames(d):
    return tables.common_keys_of_all(d.v_track, "frame", "track", "x").select("track", "frame")


# --- joins ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, p_brand, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j1_j8_lookup(d):
    dim = d.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return tables.map_column(d.lineitem.select("l_orderkey", "l_partkey"), dim, "l_partkey").select("l_orderkey", "l_partkey", "p_brand", "p_size")


@query("SELECT a.Condition, a.Date, a.n, b.total FROM (SELECT Condition, Date, count(*) AS n FROM v_assay GROUP BY ALL) a JOIN (SELECT Condition, Date, sum(value) AS total FROM v_assay WHERE status = 'F' GROUP BY ALL) b ON a.Condition = b.Condition AND a.Date = b.Date", "total")
def j2_metrics(d):
    a = d.v_assay.groupBy("Condition", "Date").agg(F.count("*").alias("n"))
    b = d.v_assay.filter("status = 'F'").groupBy("Condition", "Date").agg(F.sum("value").alias("total"))
    return tables.join_metrics(a, b)


@query("SELECT coalesce(a.cust, b.cust) AS cust, a.n AS n_O, b.n AS n_F FROM (SELECT cust, count(*) AS n FROM v_assay WHERE status = 'O' GROUP BY cust) a FULL JOIN (SELECT cust, count(*) AS n FROM v_assay WHERE status = 'F' GROUP BY cust) b ON a.cust = b.cust")
def j3_full_join(d):
    n = lambda s: d.v_assay.filter(F.col("status") == s).groupBy("cust").agg(F.count("*").alias("n"))
    return tables.combine_by({"O": n("O"), "F": n("F")}, "cust")


@query("SELECT probe, size, CAST(coalesce(h, 0) AS BIGINT) AS hits, coalesce(h = 1, false) AS is_unique FROM v_window LEFT JOIN (SELECT l_partkey, count(*) FILTER (l_quantity > 49) AS h FROM lineitem GROUP BY l_partkey) q ON l_partkey = probe WHERE h = 1")
def j4_annotate_hits(d):
    hits = d.lineitem.groupBy(F.col("l_partkey").alias("probe")).agg(F.count_if(F.col("l_quantity") > 49).alias("hits")).withColumn("unique", F.col("hits") == 1)
    stale = d.v_window.select("probe", "size", F.lit(9).alias("hits"))
    return tables.annotate_hits(stale, hits, "probe").select("probe", "size", "hits", F.col("unique").alias("is_unique"))


@query("SELECT id, value, m AS value_median, coalesce(s, 0.0) AS value_std FROM v_assay a JOIN (SELECT cust, quantile_cont(value, 0.5) AS m, stddev_samp(value) AS s FROM v_assay GROUP BY cust) g ON a.cust = g.cust", "value value_median value_std")
def j5_group_stats(d):
    return tables.with_group_stats(d.v_assay, ["cust"], "value").select("id", "value", "value_median", "value_std")


@query("SELECT a.id AS id, n FROM v_assay a JOIN (SELECT c_custkey AS cust, c_nationkey AS n FROM customer) c ON a.cust = c.cust")
def j6_near_metric(d):
    near = d.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("n"))
    return tables.join_near_metric(d.v_assay, near, "cust").select("id", "n")


@query("SELECT a.Condition, a.Date, a.m AS m_all, b.m AS m_open FROM (SELECT Condition, Date, avg(value) AS m FROM v_assay GROUP BY ALL) a LEFT JOIN (SELECT Condition, Date, avg(value) AS m FROM v_assay WHERE status = 'O' GROUP BY ALL) b ON a.Condition = b.Condition AND a.Date = b.Date", "m_all m_open")
def j7_dual_channel(d):
    m = lambda rows: rows.groupBy("Condition", "Date").agg(F.avg("value").alias("m"))
    return tables.dual_channel(m(d.v_assay), m(d.v_assay.filter("status = 'O'")), ["Condition", "Date"], ("all", "open"))


@query("SELECT id, coalesce(CAST(c_nationkey AS VARCHAR), '') AS review FROM v_assay LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON cust = c_custkey")
def j9_review(d):
    review = d.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("review"))
    return tables.apply_review(d.v_assay, review, ["cust"], ["review"]).select("id", "review")


@query("SELECT c_custkey AS cust FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j21_unassigned(d):
    return tables.unassigned(d.customer.select(F.col("c_custkey").alias("cust")), d.orders.select(F.col("o_custkey").alias("cust")), ["cust"])


@query("SELECT a.fov AS key, a.path AS left_path, b.path AS right_path FROM (SELECT regexp_replace(concat('img', track, '_', frame), '_$', '') AS fov, concat('img', track, '_', frame, '_Left.tif') AS path FROM v_track WHERE cell < 3) a JOIN (SELECT concat('img', track, '_', frame) AS fov, concat('img', track, '_', frame, '_Right.tif') AS path FROM v_track WHERE cell > 0) b ON a.fov = b.fov")
def j32_pair_files(d):
    path = lambda s: F.concat(F.lit("img"), "track", F.lit("_"), "frame", F.lit(f"_{s}.tif"))
    files = d.v_track.filter("cell < 3").select(path("Left").alias("path")).unionByName(d.v_track.filter("cell > 0").select(path("Right").alias("path")))
    return tables.pair_files(files, S.fov_key(F.col("path")), F.regexp_extract("path", "(?i)(left|right)[.]tif$", 1), ("left", "right"))


@query("SELECT g.Base, g.t, g.z FROM (SELECT * FROM (SELECT DISTINCT Base, Date AS t FROM v_assay) JOIN (SELECT DISTINCT Base, cust AS z FROM v_assay) USING (Base)) g LEFT JOIN (SELECT DISTINCT Base, Date AS t, cust AS z FROM v_assay) p ON g.Base = p.Base AND g.t = p.t AND g.z = p.z WHERE p.z IS NULL")
def j41_missing_grid(d):
    f = d.v_assay.select("Base", F.col("Date").alias("t"), F.col("cust").alias("z"))
    return tables.missing_grid(f, ["Base"])


@query("SELECT k AS Condition, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n IS NULL THEN 'NA' ELSE 'ok' END AS status, CAST(i AS INTEGER) AS position FROM (VALUES (0, '2-HIGH'), (1, 'none'), (2, '1-URGENT')) v(i, k) LEFT JOIN (SELECT Condition, count(*) AS n FROM v_assay GROUP BY Condition) c ON c.Condition = k")
def j42_reindex(d):
    return tables.reindex(stats.counts(d.v_assay, ["Condition"]), "Condition", ["2-HIGH", "none", "1-URGENT"], "n")


@query("SELECT a.id, a.value - coalesce(e.m, p.m) AS delta FROM v_assay a LEFT JOIN (SELECT Base, Date, avg(value) AS m FROM v_assay GROUP BY ALL) e ON e.Base = 'HIGH' AND e.Date = a.Date LEFT JOIN (SELECT Date, avg(value) AS m FROM v_assay WHERE starts_with(Condition, 'HIGH') GROUP BY ALL) p ON p.Date = a.Date", "delta")
def j23_reference(d):
    rows = d.v_assay.withColumn("ref", F.lit("HIGH")).withColumn("ref_date", F.col("Date"))
    return tables.with_reference(rows, "value", "Condition", "Base", "Date", "ref", "ref_date").select("id", "delta")


# --- sets, sorts, top-k -------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier", "bal")
def u1_union(d):
    return tables.union([d.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), d.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) AS q WHERE r = 1")
def u2_w5_dedupe(d):
    return tables.dedupe(d.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT k, min(src) AS source_rank FROM (SELECT c_nationkey AS k, 0 AS src FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) AS q GROUP BY k")
def u3_unique_across(d):
    return tables.unique_across(d.customer.select(F.col("c_nationkey").alias("k")), d.supplier.select(F.col("s_nationkey").alias("k")), "k", ["k"])


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def u4_intersect(d):
    return tables.common_keys(d.customer.select(F.col("c_nationkey").alias("k")), d.supplier.select(F.col("s_nationkey").alias("k")), ["k"])


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def u5_minus(d):
    return tables.minus(d.orders.select(F.col("o_custkey").alias("k")), d.supplier.select(F.col("s_suppkey").alias("k")), ["k"])


@query("SELECT Base, count(*) FILTER (status = 'F') AS F, count(*) FILTER (status = 'O') AS O, count(*) FILTER (status = 'P') AS P FROM v_assay GROUP BY Base")
def u6_pivot(d):
    return tables.pivot_counts(d.v_assay, ["Base"], "status", ["F", "O", "P"])


@query("SELECT l_orderkey, l_partkey, 'l_tax' AS Primer, l_tax AS val FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'l_discount', l_discount FROM lineitem", "val")
def u7_melt(d):
    return tables.melt(d.lineitem.select("l_orderkey", "l_partkey", "l_tax", "l_discount"), ["l_orderkey", "l_partkey"], ["l_tax", "l_discount"])


@query("SELECT p_partkey, concat('GATTACA', p_name) AS full_sequence, CAST(length(p_name) + 7 AS INTEGER) AS full_length, CAST(row_number() OVER (PARTITION BY 1 ORDER BY p_partkey) AS INTEGER) AS rank FROM part")
def u9_handles(d):
    out = tables.add_handle(d.part, {"H1": "GATTACA"}, "H1", ["p_partkey"], "p_name")
    return out.select("p_partkey", "full_sequence", "full_length", "rank")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM customer UNION ALL SELECT -1, 'new'")
def s28_upsert(d):
    old = d.customer.select(F.col("c_custkey").alias("k"), F.lit("old").alias("state"))
    new = d.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("state"))
    return tables.upsert(old, new.unionByName(d.region.limit(1).select(F.lit(-1).cast("long").alias("k"), F.lit("new").alias("state"))), ["k"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "o_totalprice")
def o1_o3_o5_top(d):
    return tables.sort(tables.top(d.orders.select("o_orderkey", "o_totalprice"), 100, [F.desc("o_totalprice"), "o_orderkey"]), [("o_totalprice", False), ("o_orderkey", True)])


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('2-HIGH', '1-URGENT') THEN o_orderpriority END AS o_orderpriority FROM orders")
def o2_order_by_list(d):
    return tables.order_by_list(d.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["2-HIGH", "1-URGENT"])


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 25, -p_retailprice, p_partkey) AS INTEGER) AS rank FROM part")
def o4_rank(d):
    return tables.rank_by(d.part, [F.col("p_size") > 25, -F.coalesce("p_retailprice", F.lit(0.0)), F.col("p_partkey")], within=["p_brand"]).select("p_brand", "p_partkey", "rank")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM (SELECT *, min(tier) OVER (PARTITION BY p_brand) AS best FROM (SELECT *, CASE WHEN p_size > 45 THEN 1 WHEN p_size > 20 THEN 2 ELSE 3 END AS tier FROM part) AS a) AS b WHERE tier = best) AS c WHERE r <= 4")
def o6_tier(d):
    tier = F.when(F.col("p_size") > 45, 1).when(F.col("p_size") > 20, 2).otherwise(3)
    return tables.select_tier(d.part, tier, ["p_partkey"], 4, ["p_brand"]).select("p_brand", "p_partkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') AS q WHERE r = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o7_top_per_key(d):
    return tables.top_per_key(d.orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 50, F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) AS q WHERE r = 1", "o_totalprice")
def o9_argmax(d):
    return tables.argmax_row(d.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.col("o_totalprice"), F.col("o_orderkey"))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('0:', o_orderkey)), o_orderkey) AS r FROM orders) WHERE r <= 20")
def o10_subsample(d):
    return tables.subsample(d.orders, ["o_orderpriority"], 20, ["o_orderkey"]).select("o_orderpriority", "o_orderkey")


@query("SELECT * FROM v_spot WHERE channel = 1 AND CAST(concat('0x', substr(md5(concat('7:', spot)), 1, 8)) AS BIGINT) < 429496729", "x y")
def s21_sample(d):
    return tables.sample_rows(d.v_spot.filter("channel = 1"), 0.1, 7, ["spot"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a72_duplicates(d):
    return tables.assert_unique(d.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT probe, (row_number() OVER (PARTITION BY gene ORDER BY start1, probe)) % 2 = 1 AS odd FROM v_window")
def w7_odd_even(d):
    return tables.odd_even(d.v_window, ["gene"], ["start1", "probe"]).select("probe", "odd")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS r FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS f FROM part) AS a WHERE f = 1) AS b WHERE r <= 3")
def w6_top_unique(d):
    order = [F.desc("p_size"), F.desc("p_retailprice"), "p_partkey"]
    return tables.top_unique(d.part, ["p_brand"], ["p_size"], order, 3).select("p_brand", "p_partkey")


@query("SELECT 'positive' AS \"check\", count(*) FILTER (NOT value > 10) AS failed, count(*) FILTER (NOT value > 10) = 0 AS ok FROM v_assay UNION ALL SELECT 'known', count(*) FILTER (status NOT IN ('F', 'O')), count(*) FILTER (status NOT IN ('F', 'O')) = 0 FROM v_assay UNION ALL SELECT 'rows', greatest(100000000 - count(*), 0), false FROM v_assay")
def a71_validate(d):
    return tables.validate(d.v_assay, {"positive": F.col("value") > 10, "known": F.col("status").isin("F", "O")}, 100000000)
