"""Queries of the track, spatial, pixel, curve and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import curves, pixels, spatial, stats, tables, tracks
from quillon.plans import composites
from quillon.plans.registry import query

# --- tracks -----------------------------------------------------------------------------------------------------

_EDGE = "SELECT track, spot AS source, t AS target, frame AS source_frame, f2 AS target_frame, f2 - frame AS frame_difference, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS distance, CASE WHEN f2 - frame = 1 THEN 'adjacent' ELSE 'gap_closing' END AS edge_type FROM (SELECT *, lead(spot) OVER w AS t, lead(frame) OVER w AS f2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v_track WINDOW w AS (PARTITION BY track ORDER BY frame, spot)) WHERE t IS NOT NULL"


@query(_EDGE, "distance")
def w1_edges(d):
    return tracks.edges(d.v_track)


@query(f"SELECT t.track, t.n, first_frame, last_frame, max_step, coalesce(gap_edges, 0) AS gap_edges FROM (SELECT track, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM v_track GROUP BY track) t LEFT JOIN (SELECT track, max(distance) AS max_step, count(*) FILTER (edge_type = 'gap_closing') AS gap_edges FROM ({_EDGE}) GROUP BY track) e ON e.track = t.track", "max_step")
def a22_track_summary(d):
    return tracks.track_summary(d.v_track)


_MSD = "SELECT a.track, b.frame - a.frame AS lag, avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS msd, count(*) AS n_pairs FROM v_track a JOIN v_track b ON a.track = b.track AND b.frame > a.frame JOIN (SELECT track, count(*) AS n FROM v_track GROUP BY track) s ON s.track = a.track AND b.frame - a.frame <= n - 1 GROUP BY ALL"


@query(_MSD, "msd")
def w2_msd(d):
    return tracks.msd(d.v_track)


@query(f"SELECT track, lag FROM (SELECT track, lag, row_number() OVER (PARTITION BY track ORDER BY lag) AS r, count(*) OVER (PARTITION BY track) AS n FROM ({_MSD})) WHERE r <= least(greatest(3, round_even(n / 2.0::DOUBLE, 0)), n)")
def w4_fit_lags(d):
    return tracks.fit_lags(tracks.msd(d.v_track)).select("track", "lag")


_ANGLE = "SELECT track, frame, CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END AS angle FROM (SELECT track, frame, degrees(lead(h) OVER w - h) AS d FROM (SELECT track, frame, spot, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS h FROM v_track WINDOW w AS (PARTITION BY track ORDER BY frame, spot)) WINDOW w AS (PARTITION BY track ORDER BY frame, spot)) WHERE d IS NOT NULL"


@query(_ANGLE, "angle")
def w3_angles(d):
    return tracks.angles(d.v_track)


@query("SELECT track, " + ", ".join(f"count(*) FILTER (b = {i}) / count(*)::DOUBLE AS f{i}" for i in range(6)) + f" FROM (SELECT track, least(floor(abs(angle) / 30), 5) AS b FROM ({_ANGLE})) GROUP BY track", "f0 f1 f2 f3 f4 f5")
def a41_angle_fractions(d):
    return tracks.angle_fractions(tracks.angles(d.v_track))


_FIT = f"SELECT * FROM (SELECT track, lag, msd, row_number() OVER (PARTITION BY track ORDER BY lag) AS r, count(*) OVER (PARTITION BY track) AS n FROM ({_MSD})) WHERE r <= least(greatest(3, round_even(n / 2.0::DOUBLE, 0)), n)"


@query(f"SELECT track, slope, r2, alpha, CASE WHEN slope > 0 THEN slope / (8 / 3.0::DOUBLE) END AS D, CASE WHEN b >= 0 THEN 1000 * sqrt(b / 4) END AS sigma FROM (SELECT track, regr_slope(msd, lag) AS slope, regr_intercept(msd, lag) AS b, regr_r2(msd, lag) AS r2, regr_slope(CASE WHEN msd > 0 THEN log10(msd) END, log10(lag)) AS alpha FROM ({_FIT}) GROUP BY track)", "slope r2 alpha D sigma")
def k2_diffusion(d):
    return tracks.diffusion(tracks.msd(d.v_track)).select("track", "slope", "r2", "alpha", "D", "sigma")


@query("SELECT track, spot FROM v_track WHERE track NOT IN (SELECT track FROM v_track GROUP BY track, x HAVING count(*) > 2) AND track NOT IN (SELECT track FROM v_track GROUP BY track, y HAVING count(*) > 2)")
def p15_dead_pixels(d):
    return tracks.drop_dead_pixels(d.v_track).select("track", "spot")


@query("SELECT track, n, mean_intensity, end_to_end, max_distance FROM (SELECT track, count(*) AS n, avg(value) AS mean_intensity, sqrt(pow(max_by(x, frame) - min_by(x, frame), 2) + pow(max_by(y, frame) - min_by(y, frame), 2)) AS end_to_end FROM v_track GROUP BY track) JOIN (SELECT a.track AS t, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS max_distance FROM v_track a JOIN v_track b ON a.track = b.track GROUP BY a.track) ON t = track", "mean_intensity end_to_end max_distance")
def a23_aio_table(d):
    return tracks.aio_table(d.v_track, max_lag=5).select("track", "n", "mean_intensity", "end_to_end", "max_distance")


@query("SELECT track, CAST(frame AS DOUBLE) AS frame, x, y, CAST(dense_rank() OVER (ORDER BY track) AS INTEGER) AS trajectory FROM v_track", "frame x y")
def u8_explode_tracks(d):
    return tracks.explode_tracks(tracks.aio_table(d.v_track, max_lag=2)).select("track", "frame", "x", "y", "trajectory")


@query("SELECT t.track, c.cell, avg(CASE WHEN t.cell = c.cell THEN 1.0 ELSE 0.0 END) AS confidence, string_agg(DISTINCT t.cell, ';' ORDER BY t.cell) AS labels, count(DISTINCT t.cell) > 1 OR avg(CASE WHEN t.cell = c.cell THEN 1.0 ELSE 0.0 END) < 1 AS ambiguous FROM v_track t JOIN (SELECT track, coalesce(min(cell), 0) AS cell FROM (SELECT track, cell, rank() OVER (PARTITION BY track ORDER BY count(*) DESC) AS r FROM v_track WHERE cell <> 0 GROUP BY track, cell) WHERE r = 1 GROUP BY track) c ON c.track = t.track GROUP BY t.track, c.cell", "confidence")
def a21_assign_cell(d):
    return tracks.assign_cell(d.v_track)


_METRIC = "SELECT track, event_k AS condition, concat('f', track % 6) AS file, (track * 37 % 100) + 0.5 AS mean_step_nm, CASE WHEN track % 9 = 0 THEN NULL ELSE (track * 13 % 20) / 10.0::DOUBLE END AS alpha, (track % 10) / 10.0::DOUBLE AS r2, CAST(track % 3 AS BIGINT) AS cell FROM (SELECT DISTINCT track, track % 2 AS event_k FROM v_track)"


def _metric(d):
    t = d.v_track.select("track").distinct()
    return t.select("track", (F.col("track") % 2).alias("condition"), F.concat(F.lit("f"), (F.col("track") % 6).cast("string")).alias("file"), ((F.col("track") * 37) % 100 + 0.5).alias("mean_step_nm"), F.when(F.col("track") % 9 != 0, (F.col("track") * 13 % 20) / 10.0).alias("alpha"), (F.col("track") % 10 / 10.0).alias("r2"), (F.col("track") % 10 / 10.0).alias("loglog_r2"), (F.col("track") % 3).alias("cell"))


@query(f"SELECT track FROM ({_METRIC}) WHERE mean_step_nm > 30 AND alpha > 0.7")
def p14_mobile(d):
    return tracks.mobile(_metric(d)).select("track")


@query(f"SELECT track FROM ({_METRIC}) WHERE mean_step_nm > 30 AND r2 > 0.7 AND alpha > 0.5")
def p13_metric_filter(d):
    return tracks.filter_metric(_metric(d), "D").select("track")


@query(f"SELECT condition, count(*) AS n_files, avg(i) AS immobile_mean, stddev_samp(i) / sqrt(count(*)) AS immobile_sem, avg(c) AS constrained_mean, stddev_samp(c) / sqrt(count(*)) AS constrained_sem, avg(o) AS normal_mean, stddev_samp(o) / sqrt(count(*)) AS normal_sem FROM (SELECT condition, file, count(*) FILTER (mean_step_nm < 30) / count(*)::DOUBLE AS i, count(*) FILTER (mean_step_nm >= 30 AND alpha <= 0.5) / count(*)::DOUBLE AS c, count(*) FILTER (mean_step_nm >= 30 AND alpha > 0.5) / count(*)::DOUBLE AS o FROM ({_METRIC}) GROUP BY ALL) GROUP BY condition", "immobile_mean immobile_sem constrained_mean constrained_sem normal_mean normal_sem")
def a24_fractions(d):
    return tracks.fraction_tables(_metric(d))


@query(f"SELECT condition, count(*) AS n_replicates, avg(i / n::DOUBLE) AS immobile, avg(c / m::DOUBLE) AS constrained, avg(o / m::DOUBLE) AS normal FROM (SELECT condition, file, count(*) AS n, count(*) FILTER (mean_step_nm < 30) AS i, count(*) FILTER (mean_step_nm >= 30) AS m, count(*) FILTER (mean_step_nm >= 30 AND alpha <= 0.5) AS c, count(*) FILTER (mean_step_nm >= 30 AND alpha > 0.5) AS o FROM ({_METRIC}) GROUP BY ALL) WHERE c > 0 GROUP BY condition", "immobile constrained normal")
def a25_legacy_fractions(d):
    return tracks.legacy_fractions(_metric(d).withColumn("file", F.concat("file", F.lit("_FOV"), F.col("track").cast("string"))))


@query(f"SELECT condition, metric, count(v) AS N, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std, stddev_samp(v) / sqrt(count(v)) AS sem FROM (SELECT condition, 'alpha' AS metric, alpha AS v FROM ({_METRIC}) UNION ALL SELECT condition, 'r2', r2 FROM ({_METRIC})) WHERE v IS NOT NULL GROUP BY ALL", "mean median std sem")
def a26_metric_summary(d):
    return tracks.metric_summary(_metric(d), ["condition"], ["alpha", "r2"])


@query(f"SELECT condition, count(DISTINCT (file, cell)) FILTER (cell > 0) AS n_cells, count(*) FILTER (cell > 0) AS assigned, count(*) FILTER (cell = 0) AS background, count(*) AS total FROM ({_METRIC}) GROUP BY condition")
def a27_cell_counts(d):
    return tracks.cell_counts(_metric(d))


@query("SELECT track, spot FROM v_track WHERE track IN (SELECT track FROM v_track WHERE x >= 1 AND x < 1.2 AND y >= 1 AND y < 1.2)")
def p30_crop(d):
    box = d.region.limit(1).select(F.lit(1.0).alias("x0"), F.lit(1.2).alias("x1"), F.lit(1.0).alias("y0"), F.lit(1.2).alias("y1"))
    return tracks.select_crop(d.v_track, box).select("track", "spot")


@query("SELECT o_orderpriority AS condition, o_custkey % 20 AS diff_coef, sum(o_totalprice) AS occupation, CASE WHEN o_custkey % 20 > 0 THEN log10(o_custkey % 20) END AS log10_diff_coef FROM orders GROUP BY ALL", "occupation log10_diff_coef")
def a74_occupation(d):
    return tracks.occupation(d.orders.select(F.col("o_orderpriority").alias("condition"), (F.col("o_custkey") % 20).alias("diff_coef"), F.col("o_totalprice").alias("posterior")))


@query("SELECT track, CAST(session AS BIGINT) AS session, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM (SELECT track, frame, sum(s) OVER (PARTITION BY track ORDER BY frame) AS session FROM (SELECT track, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS s FROM v_track)) GROUP BY ALL HAVING count(*) >= 5")
def t4_sessions_batch(d):
    return tracks.sessions(d.v_track, ["track"])


@query("SELECT a.fov, a.spot AS a, b.spot AS b, b.frame - a.frame AS lag, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM v_track a JOIN v_track b ON a.fov = b.fov AND b.frame - a.frame BETWEEN 1 AND 2 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 0.5", "dist")
def j40_link_candidates(d):
    return spatial.link_candidates(d.v_track, 0.5).select("fov", "a", "b", "lag", "dist").withColumn("lag", F.col("lag").cast("long"))


@query(None)
def k1_link(d):
    return composites.link(d.v_track.select("fov", "spot", "frame", "x", "y"), 0.5, 2, 3).select("fov", "track", "spot", "frame", "trajectory_uid")


# --- spatial ----------------------------------------------------------------------------------------------------


@query("SELECT a.fov, a.nucleus, a.channel AS ch1, b.channel AS ch2, count(DISTINCT a.spot) AS n FROM v_spot a JOIN v_spot b ON a.fov = b.fov AND a.nucleus = b.nucleus AND a.channel <> b.channel WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 2.5 GROUP BY ALL")
def j24_colocalized(d):
    return spatial.colocalized(d.v_spot)


@query("SELECT a.spot AS id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS nearest FROM v_spot a LEFT JOIN v_spot b ON a.fov = b.fov AND a.spot <> b.spot AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3 GROUP BY a.spot", "nearest")
def j25_nearest(d):
    return spatial.nearest(d.v_spot.withColumnRenamed("spot", "id"), 3).select("id", "nearest")


_BIN = "SELECT i AS bin, i * 2 AS s, i * 2 + 4 AS e FROM (SELECT unnest(range(0, 9)) AS i)"


@query(f"SELECT a.fov, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM v_spot a JOIN v_spot b ON a.fov = b.fov JOIN ({_BIN}) k ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > s AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= e WHERE a.channel = 0 AND b.channel = 1 GROUP BY ALL")
def j26_w22_pair_counts(d):
    p = lambda c, n: d.v_spot.filter(F.col("channel") == c).select("fov", F.col("spot").alias(n), "x", "y")
    return spatial.pair_counts(p(0, "i"), p(1, "j"), 4, 2, 20, ["fov"]).select("fov", "bin", "n")


@query("SELECT a.fov, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM v_spot a JOIN v_spot b ON a.fov = b.fov JOIN (SELECT i AS bin, i * 3 AS s, i * 3 + 3 AS e FROM (SELECT unnest(range(0, 5)) AS i)) k ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) BETWEEN s AND e GROUP BY ALL")
def j27_pair_counts_closed(d):
    p = lambda n: d.v_spot.select("fov", F.col("spot").alias(n), "x", "y")
    return spatial.pair_counts_closed(p("i"), p("j"), 3, 3, 15, ["fov"])


@query("SELECT h.spot AS hub, CAST(k.bin AS INTEGER) AS bin, count(*) AS n_pixels, CAST(sum(p.value) AS BIGINT) AS total FROM (SELECT spot, fov, nucleus, 3 + spot % 3 AS x, 4 AS y FROM v_spot) h JOIN (SELECT fov, label, frame, x, y, value FROM v_pixel) p ON p.fov = h.fov AND p.label = h.nucleus JOIN (SELECT i AS bin, i AS s, i + 1 AS e FROM (SELECT unnest(range(0, 4)) AS i)) k ON sqrt((h.x - p.x) * (h.x - p.x) + (h.y - p.y) * (h.y - p.y)) >= s AND sqrt((h.x - p.x) * (h.x - p.x) + (h.y - p.y) * (h.y - p.y)) < e GROUP BY ALL")
def j28_annular(d):
    hubs = d.v_spot.select(F.col("spot").alias("hub"), "fov", "nucleus", (3 + F.col("spot") % 3).cast("double").alias("x"), F.lit(4.0).alias("y"))
    px = d.v_pixel.select("fov", F.col("label").alias("nucleus"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "value")
    out = spatial.annular_rdf(hubs, px, 1, 1, 4, 1)
    return out.select("hub", "bin", "n_pixels", "total")


@query("SELECT s.spot, coalesce(m.label, 0) AS label FROM v_spot s LEFT JOIN (SELECT fov, x, y, max(label) AS label FROM v_pixel GROUP BY ALL) m ON m.fov = s.fov AND m.x = least(greatest(round_even(s.x, 0), 0), 7) AND m.y = least(greatest(round_even(s.y, 0), 0), 7)")
def j29_labels(d):
    mask = d.v_pixel.groupBy("fov", "x", "y").agg(F.max("label").alias("label"))
    return spatial.assign_label(d.v_spot, mask, 8, 8).select("spot", "label")


def _polys(d):
    v = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    r = (2 + F.col("spot") % 5).cast("double")
    return d.v_spot.select("fov", F.col("spot").alias("cell"), F.array(v(F.col("x") - r, F.col("y") - r), v(F.col("x") + r, F.col("y") - r), v(F.col("x") + r, F.col("y") + r), v(F.col("x") - r, F.col("y") + r)).alias("vertices"))


_POLY = "SELECT fov, spot AS cell, x - (2 + spot % 5) AS x0, x + (2 + spot % 5) AS x1, y - (2 + spot % 5) AS y0, y + (2 + spot % 5) AS y1 FROM v_spot"


@query(f"SELECT s.spot AS point, coalesce(min(p.cell), -1) AS cell FROM v_spot s LEFT JOIN ({_POLY}) p ON p.fov = s.fov AND s.x > x0 AND s.x < x1 AND s.y > y0 AND s.y < y1 GROUP BY s.spot")
def j30_in_polygon(d):
    return spatial.in_polygon(d.v_spot.withColumnRenamed("spot", "point"), _polys(d)).select("point", "cell")


@query(f"SELECT a.fov, a.cell FROM ({_POLY}) a WHERE NOT EXISTS (SELECT 1 FROM ({_POLY}) b WHERE b.fov = a.fov AND b.cell <> a.cell AND b.x1 - b.x0 > a.x1 - a.x0 AND b.x0 < a.x0 AND a.x1 < b.x1 AND b.y0 < a.y0 AND a.y1 < b.y1)")
def j31_outer(d):
    return spatial.outer_only(_polys(d)).select("fov", "cell")


@query(None)
def j43_match_nuclei(d):
    c = d.v_pixel.select(F.col("frame").alias("fov"), "y", "x", F.floor(F.col("x") / 3).alias("cell"))
    n = d.v_pixel.filter("value > 0").select(F.col("frame").alias("fov"), "y", "x", (F.floor(F.col("y") / 3) + 1).alias("nucleus"))
    return spatial.match_nuclei(c, n)


# --- pixels -----------------------------------------------------------------------------------------------------


@query("SELECT fov, y, x, max(value) AS value FROM v_pixel GROUP BY ALL")
def a54_mip(d):
    return pixels.mip(d.v_pixel, ["fov"])


@query("SELECT fov, CAST(floor(frame / 50) AS BIGINT) AS block, y, x, avg(value) AS value FROM v_pixel GROUP BY ALL", "value")
def a55_block_mean(d):
    return pixels.block_mean(d.v_pixel, 50)


@query("SELECT fov, count(*) AS n, count(*) FILTER (value < 0) AS n_negative, count(*) FILTER (value = 0) AS n_zero, count(*) AS n_finite, min(value) AS min, max(value) AS max FROM v_pixel GROUP BY fov")
def a56_stack_stats(d):
    return pixels.stack_stats(d.v_pixel)


@query("SELECT fov, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM v_pixel GROUP BY fov, label", "cy cx")
def a50_region_props(d):
    return pixels.region_props(d.v_pixel)


@query("SELECT v.fov, v.label, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, max(m.mode) AS mode, quantile_cont(value, 0.99) AS p99, sqrt(count(*) / pi()) AS radius FROM v_pixel v JOIN (SELECT fov, min(value) AS mode FROM (SELECT fov, value, rank() OVER (PARTITION BY fov ORDER BY count(*) DESC) AS r FROM v_pixel GROUP BY fov, value) WHERE r = 1 GROUP BY fov) m ON m.fov = v.fov GROUP BY v.fov, v.label", "mean std p99 radius")
def a51_region_metrics(d):
    return pixels.region_metrics(d.v_pixel).select("fov", "label", "max", "mean", "std", "mode", "p99", "radius")


_COMP = "SELECT fov, frame AS cell, x % 2 AS channel, y < 3 AS nucleus, value FROM v_pixel WHERE frame > 0"


def _comp(d):
    return d.v_pixel.select("fov", F.col("frame").alias("cell"), (F.col("x") % 2).alias("channel"), (F.col("y") < 3).alias("nucleus"), "value")


@query(f"SELECT fov, cell, channel, avg(value) AS cell_mean, max(value) AS cell_max, coalesce(avg(value) FILTER (nucleus), 0) AS nucleus_mean, coalesce(avg(value) FILTER (NOT nucleus), 0) AS cytoplasm_mean FROM ({_COMP}) GROUP BY ALL", "cell_mean cell_max nucleus_mean cytoplasm_mean")
def a52_compartments(d):
    return pixels.compartments(_comp(d)).select("fov", "cell", "channel", "cell_mean", "cell_max", "nucleus_mean", "cytoplasm_mean")


@query(f"SELECT fov, cell, count(*) FILTER (channel = 0 AND nucleus) AS nucleus_area, count(*) FILTER (channel = 0 AND NOT nucleus) AS cytoplasm_area, avg(value) FILTER (channel = 0 AND nucleus) AS a, max(value) FILTER (channel = 1 AND NOT nucleus) AS b FROM ({_COMP}) GROUP BY ALL", "a b")
def a79_nucleus_stats(d):
    out = pixels.nucleus_stats(_comp(d), [0, 1])
    return out.select("fov", "cell", "nucleus_area", "cytoplasm_area", F.col("0_nucleus_mean").alias("a"), F.col("1_cytoplasm_max").alias("b"))


_TWO = "SELECT a.fov, a.frame, a.y, a.x, CAST(a.value AS DOUBLE) AS l, CAST(b.value AS DOUBLE) AS r FROM v_pixel a JOIN v_pixel b ON a.frame = b.frame AND a.y = b.y AND b.x = 7 - a.x"


def _two(d):
    b = d.v_pixel.select("frame", "y", (7 - F.col("x")).alias("x"), F.col("value").cast("double").alias("r"))
    return d.v_pixel.select("fov", "frame", "y", "x", F.col("value").cast("double").alias("l")).join(b, ["frame", "y", "x"])


@query(f"SELECT fov, frame, count(*) AS n, corr(l, r) AS r FROM ({_TWO}) GROUP BY ALL", "r")
def a45_pcc(d):
    return pixels.pcc(_two(d), "l", "r", ["fov", "frame"])


@query(f"SELECT fov, frame, sum(CASE WHEN r > 10 THEN abs(l) ELSE 0 END) / nullif(sum(abs(l)), 0) AS m1, sum(CASE WHEN abs(l) > 20 THEN r ELSE 0 END) / nullif(sum(r), 0) AS m2 FROM ({_TWO}) GROUP BY ALL", "m1 m2")
def a46_manders(d):
    return pixels.manders(_two(d).withColumn("l", F.abs("l")), "l", "r", 20, 10, ["fov", "frame"])


_OTSU = """
SELECT fov, CASE WHEN lo = hi THEN lo ELSE c END AS threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY fov ORDER BY v DESC, b) AS r FROM (
    SELECT fov, lo, hi, b, c, coalesce(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2), -1) AS v FROM (
      SELECT *, sum(n) OVER u AS w0, sum(n * c) OVER u AS s0, sum(n) OVER (PARTITION BY fov) AS w, sum(n * c) OVER (PARTITION BY fov) AS s FROM (
        SELECT fov, lo, hi, b, lo + (b + 0.5) * (hi - lo) / 256 AS c, CAST(count(*) AS DOUBLE) AS n FROM (
          SELECT fov, lo, hi, coalesce(least(floor((value - lo) / nullif((hi - lo) / 256, 0)), 255), 0) AS b FROM v_pixel
          JOIN (SELECT fov AS f, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM v_pixel GROUP BY fov) ON f = fov)
        GROUP BY ALL)
      WINDOW u AS (PARTITION BY fov ORDER BY b ROWS UNBOUNDED PRECEDING)))) WHERE r = 1
"""


@query(_OTSU, "threshold")
def a47_otsu(d):
    return pixels.otsu(d.v_pixel, ["fov"], "value")


@query("SELECT fov, frame, count(*) FILTER (value > 100) AS bright, CASE WHEN count(*) FILTER (value > 100) > 10 THEN 'with_cloud' ELSE 'no_cloud' END AS class, CASE WHEN count(*) FILTER (value > 100) > 10 THEN avg(value) FILTER (value <= 100) END AS background_mean FROM v_pixel GROUP BY ALL", "background_mean")
def a48_cloud_class(d):
    return pixels.cloud_class(d.v_pixel, "value", 100, 10, ["fov", "frame"])


@query("SELECT p.frame, avg(value) AS mean, stddev_pop(value) AS std, max(b) AS base, max(b) + 2 * stddev_pop(value) AS threshold FROM v_pixel p JOIN (SELECT frame, avg(value) AS b FROM (SELECT frame, value, row_number() OVER (PARTITION BY frame ORDER BY value) AS r FROM v_pixel) WHERE r <= 20 GROUP BY frame) s ON s.frame = p.frame GROUP BY p.frame", "mean std base threshold")
def a49_adaptive(d):
    return pixels.adaptive_threshold(d.v_pixel, "value", 2, ["frame"]).select("frame", "mean", "std", "base", "threshold")


@query("SELECT p_partkey, p_size * 0.01 AS area_um2, 2 * sqrt(p_size * 0.01 / pi()) AS diameter_um, 4 * pi() * p_size / (p_retailprice * p_retailprice) AS circularity FROM part", "area_um2 diameter_um circularity")
def a53_puncta(d):
    return pixels.puncta_stats(d.part.withColumnRenamed("p_size", "area").withColumnRenamed("p_retailprice", "perimeter"), 0.1).select("p_partkey", "area_um2", "diameter_um", "circularity")


@query("SELECT status AS condition, count(*) AS n_cells, avg(n) AS mean, stddev_samp(n) / sqrt(count(*)) AS sem FROM (SELECT status, cust, count(*) AS n FROM v_assay GROUP BY ALL) GROUP BY status", "mean sem")
def a53_puncta_per_cell(d):
    return pixels.puncta_per_cell(d.v_assay.select(F.col("status").alias("condition"), F.col("cust").alias("cell")))


@query("SELECT fov, y, x, avg(d0 * d1) AS value FROM (SELECT fov, y, x, d AS d0, lead(d) OVER (PARTITION BY fov, y, x ORDER BY frame) AS d1 FROM (SELECT *, value - avg(value) OVER (PARTITION BY fov, y, x) AS d FROM v_pixel)) WHERE d1 IS NOT NULL GROUP BY ALL", "value")
def a57_cumulant2(d):
    return pixels.cumulant(d.v_pixel, 2)


_LAGS = ", ".join(f"lead(d, {i}) OVER w AS d{i}" for i in range(4))


@query(
    f"SELECT fov, y, x, avg(d0 * d1 * d2 * d3) - avg(d0 * d1) * avg(d2 * d3) - avg(d0 * d2) * avg(d1 * d3) - avg(d0 * d3) * avg(d1 * d2) AS value FROM (SELECT fov, y, x, {_LAGS} FROM (SELECT *, value - avg(value) OVER (PARTITION BY fov, y, x) AS d FROM v_pixel) WINDOW w AS (PARTITION BY fov, y, x ORDER BY frame)) WHERE d3 IS NOT NULL GROUP BY ALL",
    "value",
)
def a57_cumulant4(d):
    return pixels.cumulant(d.v_pixel, 4)


_SP = "SELECT frame AS fov, frame AS spot, 3 + frame % 3 AS y, 4 AS x FROM v_pixel GROUP BY frame"


def _spots(d):
    return d.v_pixel.select("frame").distinct().select(F.col("frame").alias("fov"), F.col("frame").alias("spot"), (3 + F.col("frame") % 3).alias("y"), F.lit(4).alias("x"))


def _img(d):
    return d.v_pixel.select(F.col("frame").alias("fov"), "y", "x", "value")


@query(f"SELECT s.fov, s.spot, avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max, CAST(sum(value) AS BIGINT) AS total, stddev_pop(value) AS std FROM ({_SP}) s JOIN v_pixel p ON p.frame = s.fov AND (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 4 GROUP BY ALL", "mean median std")
def a58_spot_stats(d):
    return pixels.spot_stats(_spots(d), _img(d), 2).select("fov", "spot", "mean", "median", "min", "max", "total", "std")


@query(f"SELECT s.fov, s.spot, max(value) FILTER (abs(p.x - s.x) <= 1 AND abs(p.y - s.y) <= 1) AS max_r1, max(value) FILTER (abs(p.x - s.x) <= 2 AND abs(p.y - s.y) <= 2) AS max_r2, max(value) FILTER (abs(p.x - s.x) <= 3 AND abs(p.y - s.y) <= 3) AS max_r3 FROM ({_SP}) s JOIN v_pixel p ON p.frame = s.fov GROUP BY ALL")
def a59_local_max(d):
    return pixels.local_max(_spots(d), _img(d))


@query("SELECT roi, frame, avg(value) FILTER (d <= 2) AS peak_mean, avg(value) FILTER (d >= 9) AS background_mean, avg(value) FILTER (d <= 2) - avg(value) FILTER (d >= 9) AS mean_difference, sum(value) FILTER (d <= 2) - count(*) FILTER (d <= 2) * avg(value) FILTER (d >= 9) AS integrated_difference FROM (SELECT label AS roi, frame, value, (x - 4) * (x - 4) + (y - 4) * (y - 4) AS d FROM v_pixel) WHERE d <= 2 OR d BETWEEN 9 AND 9 GROUP BY ALL", "peak_mean background_mean mean_difference integrated_difference")
def a60_a62_traces(d):
    seeds = d.v_pixel.select("fov", F.col("label").alias("roi")).distinct().withColumn("y", F.lit(4)).withColumn("x", F.lit(4))
    nothing = d.v_pixel.filter("false")
    disc = pixels.roi_pixels(seeds, nothing, 1, 3, 3).unionByName(seeds.withColumn("o", F.explode(F.array(*(F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a in (3, 5) for b in (3, 5))))).select("fov", "roi", "o.y", "o.x", F.lit(True).alias("is_signal")))
    return pixels.traces(d.v_pixel, disc).drop("fov")


_TR = "SELECT frame AS roi, y * 8 + x AS frame, CAST(value AS DOUBLE) AS value FROM v_pixel"


def _trace(d):
    return d.v_pixel.select(F.col("frame").alias("roi"), (F.col("y") * 8 + F.col("x")).alias("t"), F.col("value").cast("double").alias("value")).withColumnRenamed("t", "frame")


@query(f"SELECT roi, avg(value) FILTER (i <= 5) AS initial_mean, avg(value) FILTER (i > n / 2.0) AS late_mean, regr_slope(value, frame) FILTER (i > n / 2.0) AS late_slope FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY frame) AS i, count(*) OVER (PARTITION BY roi) AS n FROM ({_TR})) GROUP BY roi", "initial_mean late_mean late_slope")
def a61_trace_metrics(d):
    return pixels.trace_metrics(_trace(d)).select("roi", "initial_mean", "late_mean", "late_slope")


_STEPS = f"""
WITH m AS (SELECT roi, frame, list_sort([coalesce(lag(value) OVER w, value), value, coalesce(lead(value) OVER w, value)])[2] AS med3,
                  row_number() OVER w AS i, count(*) OVER (PARTITION BY roi) AS n FROM ({_TR}) WINDOW w AS (PARTITION BY roi ORDER BY frame)),
d AS (SELECT * FROM (SELECT roi, med3 - lead(med3) OVER (PARTITION BY roi ORDER BY frame) AS d FROM m WHERE i > n / 2.0) WHERE d IS NOT NULL),
c AS (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY roi) AS c FROM d),
s AS (SELECT roi, any_value(c) AS c, 1.4826 * quantile_cont(abs(d - c), 0.5) AS noise FROM c GROUP BY roi),
j AS (SELECT d.roi, d FROM d JOIN s ON s.roi = d.roi WHERE d > c + 4 * noise),
h AS (SELECT j.roi, quantile_cont(d, 0.5) AS step FROM j JOIN (SELECT roi, quantile_cont(d, 0.5) AS mid FROM j GROUP BY roi) k ON k.roi = j.roi WHERE d <= mid GROUP BY j.roi)
SELECT s.roi, noise, coalesce(step, greatest(8 * noise, 1.0)) AS step, coalesce(step, greatest(8 * noise, 1.0)) / 2 AS threshold FROM s LEFT JOIN h ON h.roi = s.roi
"""


@query(_STEPS, "noise step threshold")
def a43_step_scale(d):
    return pixels.step_scale(_trace(d))


@query(f"SELECT roi, frame, list_sort([coalesce(lag(value) OVER w, value), value, coalesce(lead(value) OVER w, value)])[2] AS med3, lead(value) OVER w - value AS diff FROM ({_TR}) WINDOW w AS (PARTITION BY roi ORDER BY frame)", "med3 diff")
def w18_w19_median_difference(d):
    m = pixels.med3(_trace(d), ["roi"])
    return m.join(pixels.diff(_trace(d), ["roi"]).select("roi", "frame", "diff"), ["roi", "frame"], "left").select("roi", "frame", "med3", "diff")


@query(f"SELECT roi, frame, coalesce(v, a.v0 + (b.v1 - a.v0) * (frame - a.t0) / nullif(b.t1 - a.t0, 0), a.v0, b.v1) AS filled FROM (SELECT roi, frame, CASE WHEN frame % 3 = 1 THEN value END AS v, last_value(CASE WHEN frame % 3 = 1 THEN {{'t0': frame::DOUBLE, 'v0': value}} END IGNORE NULLS) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(CASE WHEN frame % 3 = 1 THEN {{'t1': frame::DOUBLE, 'v1': value}} END IGNORE NULLS) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM ({_TR}))", "filled")
def w17_interpolate(d):
    t = _trace(d).withColumn("value", F.when(F.col("frame") % 3 == 1, F.col("value")))
    return pixels.interpolate(t, ["roi"]).select("roi", "frame", "filled")


@query("SELECT CAST(cust AS BIGINT) AS roi, count(*) AS n_seeds, max(id % 9) AS diameter, CASE WHEN count(*) = 1 AND max(id % 9) <= 5 THEN 'point' ELSE 'extended' END AS roi_class FROM v_assay GROUP BY cust")
def a63_roi_class(d):
    return pixels.roi_class(d.v_assay.select(F.col("cust").alias("roi"), (F.col("id") % 9).alias("diameter")), ["roi"])


@query("SELECT status AS profile, count(*) AS files, CAST(sum(cust) AS BIGINT) AS frames, CAST(sum(id) AS BIGINT) AS size, min_by(Date, id) AS exposure FROM v_assay GROUP BY status")
def a64_profiles(d):
    return pixels.profiles(d.v_assay.select(F.col("status").alias("profile"), F.col("cust").alias("frames"), F.col("id").alias("size"), F.col("Date").alias("exposure"), F.col("id").alias("path")))


@query("SELECT Base, count(*) FILTER (status = 'F') AS files, CAST(sum(CASE WHEN status = 'F' THEN cust ELSE 0 END) AS BIGINT) AS frames, count(*) FILTER (status <> 'F') AS skipped FROM v_assay GROUP BY Base")
def a65_preflight(d):
    return pixels.preflight(d.v_assay.select("Base", F.col("cust").alias("frames"), (F.col("status") == "F").alias("accepted")), ["Base"])


_ROI = "SELECT Condition, Date, id % 4 > 0 AS ok, id % 11 AS c FROM v_assay"


def _rois(d):
    return d.v_assay.select("Condition", "Date", (F.col("id") % 4 > 0).cast("int").alias("flag"), (F.col("id") % 11).alias("count"))


@query(f"SELECT Condition, count(*) AS total, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok AND c <= 6) AS within, quantile_cont(CASE WHEN ok AND c <= 6 THEN c END, 0.5) AS median, avg(CASE WHEN ok AND c <= 6 THEN c END) AS mean, count(*) FILTER (ok AND c > 6) AS outside, count(*) FILTER (ok) / count(*)::DOUBLE AS fraction FROM ({_ROI}) GROUP BY Condition", "median mean fraction")
def a66_count_summary(d):
    return pixels.count_summary(_rois(d), ["Condition"], 6)


@query(f"SELECT Date AS multiplier, count(*) FILTER (ok) / count(*)::DOUBLE AS accepted_fraction, quantile_cont(CASE WHEN ok THEN c END, 0.5) AS median_count FROM ({_ROI}) GROUP BY Date", "accepted_fraction median_count")
def a67_sweep(d):
    return pixels.sweep(_rois(d).withColumnRenamed("Date", "multiplier"))


@query("SELECT Base, quantile_cont(s, 0.5) AS spacing FROM (SELECT Base, value - lag(value) OVER (PARTITION BY Base ORDER BY id) AS s FROM v_assay) GROUP BY Base", "spacing")
def a73_spacing(d):
    return pixels.infer_spacing(d.v_assay, ["Base"], "id", "value")


@query("SELECT id, coalesce(value >= greatest(m + 1 * s, 200.0), false) AS keep FROM v_assay a JOIN (SELECT Base, quantile_cont(value, 0.5) AS m, stddev_samp(value) AS s FROM v_assay GROUP BY Base) g ON g.Base = a.Base")
def p27_keep_hub(d):
    return pixels.keep_hub(tables.with_group_stats(d.v_assay, ["Base"], "value"), "value", "value_median", "value_std", 1, 200).select("id", "keep")


@query("SELECT count(r) AS n, quantile_cont(r, 0.5) AS ratio, count(r) < 20 OR quantile_cont(r, 0.5) BETWEEN 0.01 AND 100 AS ok FROM (SELECT CASE WHEN l_quantity > 0 AND l_extendedprice > 0 THEN l_quantity / l_extendedprice END AS r FROM lineitem)", "ratio")
def p31_scale_check(d):
    return pixels.scale_check(d.lineitem, "l_quantity", "l_extendedprice")


@query("SELECT id, CASE WHEN q99 > q1 THEN least(greatest((value - q1) / (q99 - q1), 0), 1) ELSE 0 END AS pct, (value - mn) / (mx - mn) AS scaled FROM v_assay a JOIN (SELECT Base, quantile_cont(value, 0.01) AS q1, quantile_cont(value, 0.99) AS q99, min(value) AS mn, max(value) AS mx FROM v_assay GROUP BY Base) g ON g.Base = a.Base", "pct scaled")
def w13_w14_scaling(d):
    return pixels.minmax(pixels.pct_norm(d.v_assay, ["Base"], "value").withColumnRenamed("scaled", "pct"), ["Base"], "value").select("id", "pct", "scaled")


# --- statistics ---------------------------------------------------------------------------------------------------


@query("SELECT Base, Date, count(*) AS n FROM v_assay GROUP BY ALL")
def a1_counts(d):
    return stats.counts(d.v_assay, ["Base", "Date"])


@query("SELECT Base, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std, quantile_cont(value, 0.9) AS q90, max(value) AS max FROM v_assay GROUP BY Base", "mean median std q90 max")
def a28_safe_stats(d):
    return stats.safe_stats(d.v_assay, ["Base"], "value")


@query("SELECT nullif(status, 'P') AS method, count(*) AS n, quantile_cont(value, 0.5) AS value_median, quantile_cont(value, 0.9) AS value_q90, quantile_cont(cust, 0.5) AS cust_median, quantile_cont(cust, 0.9) AS cust_q90 FROM v_assay GROUP BY ALL", "value_median value_q90 cust_median cust_q90")
def a33_detectors(d):
    return stats.detector_summary(d.v_assay.withColumn("method", F.when(F.col("status") != "P", F.col("status"))), ["method"], ["value", "cust"])


@query("SELECT Base, count(*) AS n, min_by(Condition, id) AS Condition, count(*) FILTER (status = 'F') AS n_flagged, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std, quantile_cont(value, 0.9) AS q90, max(value) AS max FROM v_assay GROUP BY Base", "median std q90 max")
def a34_screen(d):
    return stats.screen_summary(d.v_assay.withColumn("flag", F.col("status") == "F"), ["Base"], "value", "flag", "Condition", "id")


@query("SELECT quantile_cont(value, 0.95) AS threshold FROM v_assay WHERE status = 'F'", "threshold")
def a35_control(d):
    return stats.control_threshold(d.v_assay.filter("status = 'F'"), "value")


@query("SELECT k, count(*) AS retained, avg(cust) AS first_mean, avg(id) AS last_mean FROM (SELECT unnest([1.0::DOUBLE, 2.0, 3.0]) AS k) JOIN (SELECT a.*, m, s FROM v_assay a JOIN (SELECT Base, quantile_cont(value, 0.5) AS m, stddev_samp(value) AS s FROM v_assay GROUP BY Base) g ON g.Base = a.Base) v ON value >= m + k * s / 3 GROUP BY k", "k first_mean last_mean")
def a36_sweep_k(d):
    s = tables.with_group_stats(d.v_assay, ["Base"], "value").withColumn("third", F.col("value_std") / 3)
    return stats.sweep_k(s, [1, 2, 3], "value", "value_median", "third", "cust", "id")


@query('SELECT id, CASE WHEN value <= lo THEN \'low\' WHEN value >= hi THEN \'high\' ELSE \'middle\' END AS "group" FROM v_assay CROSS JOIN (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM v_assay)')
def a37_tails(d):
    return stats.tails(d.v_assay, "value").select("id", "group")


@query('SELECT status, bin, c AS "count", c / sum(c) OVER (PARTITION BY status)::DOUBLE AS probability FROM (SELECT status, CAST(least(floor(value / 25.0), 19) AS BIGINT) AS bin, count(*) AS c FROM v_assay WHERE value BETWEEN 0 AND 500 GROUP BY ALL)', "probability")
def a39_hist(d):
    return stats.hist(d.v_assay, "value", 0, 500, 20, ["status"]).select("status", "bin", "count", "probability")


@query('SELECT bx, "by", c AS "count", c / sum(c) OVER ()::DOUBLE AS density FROM (SELECT CAST(least(floor(x), 4) AS BIGINT) AS bx, CAST(least(floor(y), 4) AS BIGINT) AS "by", count(*) AS c FROM v_track WHERE x BETWEEN 0 AND 5 AND y BETWEEN 0 AND 5 GROUP BY ALL)', "density")
def a40_hist2d(d):
    return stats.hist2d(d.v_track, "x", "y")


@query("SELECT a.Base, 1.4826 * quantile_cont(abs(value - m), 0.5) AS sigma FROM v_assay a JOIN (SELECT Base, quantile_cont(value, 0.5) AS m FROM v_assay GROUP BY Base) g ON g.Base = a.Base GROUP BY a.Base", "sigma")
def a42_robust_sigma(d):
    return stats.robust_sigma(d.v_assay, ["Base"], "value")


@query("SELECT Base, 2 * sum(r * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*)::DOUBLE AS gini, stddev_pop(value) / avg(value) AS cv, (quantile_cont(value, 0.9) - quantile_cont(value, 0.1)) / quantile_cont(value, 0.5) AS robust FROM (SELECT Base, value, row_number() OVER (PARTITION BY Base ORDER BY value) AS r FROM v_assay) GROUP BY Base", "gini cv robust")
def a44_dispersion(d):
    return stats.dispersion(d.v_assay, ["Base"], "value")


@query("SELECT Base, count(value) AS n, avg(value) AS mean, avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(value)) AS low, avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(value)) AS high FROM v_assay GROUP BY Base", "mean low high")
def a75_mean_ci(d):
    return stats.mean_ci(d.v_assay, ["Base"], "value")


@query('SELECT status, \'value\' AS "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM v_assay GROUP BY status UNION ALL SELECT status, \'cust\', quantile_cont(cust, 0.25), quantile_cont(cust, 0.5), quantile_cont(cust, 0.75) FROM v_assay GROUP BY status', "q1 q2 q3")
def a76_box(d):
    return stats.box_stats(d.v_assay, "status", ["value", "cust"])


@query("SELECT id, slope * cust + b AS predicted, r2 FROM v_assay a JOIN (SELECT Base, regr_slope(value, cust) AS slope, regr_intercept(value, cust) AS b, regr_r2(value, cust) AS r2 FROM v_assay GROUP BY Base) g ON g.Base = a.Base", "predicted r2")
def k3_calibrate(d):
    return stats.calibrate(d.v_assay, ["Base"], "cust", "value").select("id", "predicted", "r2")


_MOM = "SELECT Base, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM v_assay GROUP BY Base"


@query(f"SELECT a.Base AS Base1, b.Base AS Base2, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df FROM ({_MOM}) a JOIN ({_MOM}) b ON a.Base < b.Base", "t df")
def k9_welch(d):
    return stats.welch(d.v_assay, "Base", "value").select("Base1", "Base2", "t", "df")


@query(None)
def k9_k10_p_values(d):
    w = stats.welch(d.v_assay, "Base", "value").select("Base1", "Base2", F.col("p").alias("welch"))
    return w.join(stats.ttest(d.v_assay, "Base", "value").select("Base1", "Base2", F.col("p").alias("student")), ["Base1", "Base2"])


@query(f"SELECT a.Base AS Base1, b.Base AS Base2, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t FROM ({_MOM}) a JOIN ({_MOM}) b ON a.Base < b.Base", "t")
def k10_ttest(d):
    return stats.ttest(d.v_assay, "Base", "value").select("Base1", "Base2", "t")


@query("SELECT Base, (avg(value) - 250) / (stddev_samp(value) / sqrt(count(value))) AS t FROM v_assay GROUP BY Base", "t")
def k10_ttest_1samp(d):
    return stats.ttest_1samp(d.v_assay, ["Base"], "value", 250).select("Base", "t")


@query("SELECT count(*) FILTER (status = 'F') AS n1, count(*) FILTER (status = 'O') AS n2, sum(CASE WHEN status = 'F' THEN r END) - count(*) FILTER (status = 'F') * (count(*) FILTER (status = 'F') + 1) / 2.0 AS U FROM (SELECT status, rank() OVER (ORDER BY Date) + (count(*) OVER (PARTITION BY Date) - 1) / 2.0 AS r FROM v_assay WHERE status IN ('F', 'O'))", "U")
def k11_mwu(d):
    return stats.mwu(d.v_assay, "status", "Date", "F", "O").select("n1", "n2", "U")


_TAIL = "CASE WHEN {0} <= 0 THEN 0.0 ELSE -ln(list_sum(list_transform(range({0}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({1}) + (n - i) * ln(1 - ({1})))))) END"
_PEAKS = ", ".join(
    f"greatest({_TAIL.format('a', p)}, {_TAIL.format('b', f'1 - {p}')}) AS {name}_score"
    for name, p in (("even", "0.5::DOUBLE"), ("totals", "(51000.0::DOUBLE / 110000)"), ("pseudo", "(51001.0::DOUBLE / 110002)"))
)


@query(f"SELECT peak, {_PEAKS} FROM (SELECT probe AS peak, CAST(size AS BIGINT) AS a, CAST(probe % 60 AS BIGINT) AS b, CAST(size + probe % 60 AS BIGINT) AS n FROM v_window)", "even_score totals_score pseudo_score")
def k12_peak_scores(d):
    p = d.v_window.select(F.col("probe").alias("peak"), F.col("size").alias("a"), (F.col("probe") % 60).alias("b"), F.lit(51000).alias("total_a"), F.lit(59000).alias("total_b"))
    return stats.peak_scores(p).select("peak", "even_score", "totals_score", "pseudo_score")


@query("SELECT id, CASE WHEN cust % 50 = 0 THEN m + 1 ELSE value END AS value FROM v_assay a JOIN (SELECT Base, max(value) FILTER (cust % 50 <> 0) AS m FROM v_assay GROUP BY Base) g ON g.Base = a.Base", "value")
def w15_cap_inf(d):
    v = d.v_assay.withColumn("value", F.when(F.col("cust") % 50 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    return stats.cap_inf(v, ["Base"], "value").select("id", "value")


@query(f"SELECT roi, frame, CAST(row_number() OVER (PARTITION BY roi ORDER BY frame) AS INTEGER) AS peak FROM (SELECT roi, frame, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM ({_TR}) WINDOW w AS (PARTITION BY roi ORDER BY frame)) WHERE value > a AND value > b AND value >= 50")
def k13_peaks(d):
    return stats.find_peaks(_trace(d), ["roi"], "frame", "value").select("roi", "frame", "peak")


# --- curves -------------------------------------------------------------------------------------------------------

_CURVE = "SELECT vec_id AS hub, label AS fov, vec_id % 7 AS nucleus, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS bin, CAST(unnest(embedding) AS DOUBLE) + 1 AS value, vec_id % 5 + 1 AS w FROM embeddings"


def _curve(d):
    e = d.embeddings.select(F.col("vec_id").alias("hub"), F.col("label").alias("fov"), (F.col("vec_id") % 7).alias("nucleus"), (F.col("vec_id") % 5 + 1).alias("w"), F.posexplode("embedding").alias("bin", "value"))
    return e.withColumn("bin", F.col("bin").cast("long")).withColumn("value", F.col("value").cast("double") + 1).withColumn("n_pixels", F.lit(1))


@query(f"SELECT bin, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n_hubs, count(DISTINCT (fov, nucleus)) AS n_nuclei, count(*) AS pixels, stddev_samp(value) / sqrt(count(*)) AS sem FROM ({_CURVE}) GROUP BY bin", "mean std sem")
def a29_aggregate(d):
    return curves.aggregate_rdf(_curve(d))


@query(f"SELECT bin, avg(value) AS value_mean, stddev_pop(value) / sqrt((SELECT count(DISTINCT (fov, nucleus)) FROM ({_CURVE}))) AS value_sem FROM ({_CURVE}) GROUP BY bin", "value_mean value_sem")
def a30_pool(d):
    return curves.pool_pcf(_curve(d), ["fov", "nucleus"], ["value"])


@query(f"SELECT bin, m AS mean, sqrt(v) AS std, sqrt(v / n) AS sem, n FROM (SELECT c.bin, max(g.m) AS m, sum(w * pow(value - g.m, 2)) / sum(w) AS v, count(*) AS n FROM ({_CURVE}) c JOIN (SELECT bin, sum(w * value) / sum(w) AS m FROM ({_CURVE}) GROUP BY bin) g ON g.bin = c.bin GROUP BY c.bin)", "mean std sem")
def a31_weighted(d):
    return curves.weighted_stats(_curve(d), ["bin"], "value", "w")


@query(f"SELECT hub, max(value) AS max, min_by(value, abs(bin - 5)) AS at_5 FROM ({_CURVE}) GROUP BY hub", "max at_5")
def a32_landmarks(d):
    return curves.pcf_summary(_curve(d), ["hub"], "bin", "value", (5.0,)).select("hub", "max", "at_5")


@query(f"SELECT hub, avg(value) FILTER (bin < 3) AS near FROM ({_CURVE}) GROUP BY hub", "near")
def a38_near(d):
    return curves.near_metric(_curve(d), ["hub"])


@query(f"SELECT c.hub, bin, value / nullif(b, 0) AS normalised FROM ({_CURVE}) c JOIN (SELECT hub, avg(value) FILTER (bin >= 59) AS b FROM ({_CURVE}) GROUP BY hub) g ON g.hub = c.hub", "normalised")
def w11_tail_norm(d):
    return curves.tail_norm(_curve(d), ["hub"]).select("hub", "bin", "normalised")


@query(f"SELECT c.hub, bin, value / nullif(b, 0) AS normalised, cv AS baseline_cv FROM ({_CURVE}) c JOIN (SELECT hub, avg(value) FILTER (bin > 40) AS b, stddev_pop(value) FILTER (bin > 40) / avg(value) FILTER (bin > 40) AS cv FROM ({_CURVE}) GROUP BY hub) g ON g.hub = c.hub", "normalised baseline_cv")
def w12_far_norm(d):
    return curves.far_norm(_curve(d), ["hub"], "bin", "value", 10, 40).select("hub", "bin", "normalised", "baseline_cv")


@query(f"SELECT hub, min_by(value, bin) AS first, max_by(value, bin) AS last FROM ({_CURVE}) GROUP BY hub", "first last")
def w16_first_last(d):
    return curves.first_last(_curve(d), ["hub"])


@query("SELECT vec_id AS cell, CAST(vec_id % 9 + vec_id % 4 AS DOUBLE) AS weight FROM embeddings WHERE coalesce(CASE WHEN vec_id % 6 > 0 THEN vec_id % 10 / 10.0::DOUBLE END, 1.0) <= 0.5", "weight")
def s22_load_curves(d):
    c = d.embeddings.select(F.col("vec_id").alias("cell"), F.when(F.col("vec_id") % 6 > 0, F.col("vec_id") % 10 / 10.0).alias("baseline_cv"), (F.col("vec_id") % 9).alias("n_interest"), (F.col("vec_id") % 4).alias("n_ref"))
    return curves.load_curves(c, 0.5).select("cell", "weight")


@query(None)
def k8_fit_decay(d):
    c = _curve(d).groupBy("fov", "bin").agg(F.avg(F.col("value") + F.exp(-F.col("bin") / 8.0)).alias("value"))
    return curves.fit_decay(c, ["fov"], "bin", "value", 100, 200)


@query(None)
def k7_bootstrap(d):
    c = _curve(d).withColumn("value", F.col("value") + F.exp(-F.col("bin") / 8.0)).withColumn("weight", F.col("w").cast("double"))
    return curves.bootstrap(c, "hub", 20, 30, 1, "bin")


def _nucleus(d):
    return d.v_pixel.select("fov", F.col("label").alias("nucleus"), "y", "x").distinct()


def _points(d, channel, name):
    return d.v_spot.filter(F.col("channel") == channel).select("fov", "nucleus", F.col("spot").alias(name), F.pmod("x", F.lit(8.0)).alias("x"), F.pmod("y", F.lit(8.0)).alias("y"))


@query(None)
def k4_pcf(d):
    return curves.pcf(_points(d, 0, "i"), _points(d, 1, "j"), _nucleus(d), 2, 1, 6, least=5)


@query(None)
def k5_pcf_polygon(d):
    return curves.pcf_polygon(_points(d, 0, "point"), _points(d, 1, "j"), _nucleus(d), 2, 3)


@query(None)
def k6_rdf_lsq(d):
    px = d.v_pixel.groupBy("fov", F.col("label").alias("nucleus"), "y", "x").agg(F.avg("value").alias("value"))
    hubs = d.v_spot.select("fov", "nucleus", F.pmod("y", F.lit(8.0)).alias("y"), F.pmod("x", F.lit(8.0)).alias("x"))
    return curves.rdf_lsq(px, hubs, 4)


_QPCR = """
WITH a AS (SELECT *, value / 10 - cust / 100.0::DOUBLE AS dCp FROM v_assay), r AS (SELECT Date AS day, avg(dCp) AS m FROM a WHERE Base = 'HIGH' GROUP BY Date)
SELECT id, concat(Base, ' ', cust % 3) AS Condition, Base AS BaseCondition, 'Xist' AS Primer, dCp, dCp - m AS ddCp, pow(2.0::DOUBLE, m - dCp) AS FoldChange
FROM a LEFT JOIN r ON day = Date WHERE Base <> 'HIGH'
"""


@query(_QPCR, "dCp ddCp FoldChange")
def k16_qpcr(d):
    wide = d.v_assay.select("id", F.concat("Base", F.lit(" "), (F.col("cust") % 3).cast("string")).alias("Condition"), "Date", F.lit("Gapdh").alias("Primer_ref"), F.lit("HIGH").alias("FoldChange_ref"), F.col("Date").alias("FoldChange_ref_date"), (F.col("value") / 10).alias("Xist"), (F.col("cust") / 100.0).alias("Gapdh"))
    return composites.qpcr(wide, ["Xist", "Gapdh"])
