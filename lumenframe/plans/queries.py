"""The registered queries over the detector fixture, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import ratio_rounded
from ..functions.sql import register_functions
from ..operators import calibration, components, frames, layout, metrics, tiles, views
from ..streaming import chunks
from .fixtures import BASE, EPS, EVENTS, GEOM, dark_frames, frame_ids, raw_frames


def _dark(spark):
    return frames.dark_max(dark_frames(spark), GEOM)


def _l1(spark, d):
    return frames.reduce_l1(raw_frames(spark, d), _dark(spark), EPS, GEOM)


def _events(spark, d):
    return frames.events(raw_frames(spark, d), _dark(spark), EPS, GEOM)


def _hist(spark, d):
    """The run's own frames are its calibration frames: medians don't mind the few hits of a pixel."""
    return tiles.tile_histograms(raw_frames(spark, d), GEOM)


QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None, base: str = BASE):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = base + "\n" + oracle
        return f

    return add


@query("SELECT y, x, max(adu)::INT AS t FROM raw GROUP BY y, x")
def dark_max(spark, d):
    return frames.dark_max(raw_frames(spark, d), GEOM)


@query("SELECT y, x, median(adu)::DOUBLE AS med, round(stddev_pop(adu), 6) AS std FROM raw GROUP BY y, x")
def dark_median_std(spark, d):
    return tiles.pixel_stats(_hist(spark, d), GEOM).withColumn("std", F.round("std", 6))


@query("SELECT y, frame_id, median(adu)::DOUBLE AS med FROM raw GROUP BY y, frame_id")
def dark_row_medians(spark, d):
    return calibration.row_medians(raw_frames(spark, d), GEOM)


@query("SELECT y, x, (adu // 4)::INT AS bin, count(*) AS n FROM raw GROUP BY ALL")
def dark_pixel_histograms(spark, d):
    return tiles.pixel_histograms(_hist(spark, d), GEOM, 4)


@query("SELECT fr.frame_id, count(l1.v) AS n_fg, coalesce(sum(v), 0)::BIGINT AS sum_v, coalesce(max(v), 0)::INT AS max_v, coalesce(min(v), 0)::INT AS min_v FROM fr LEFT JOIN l1 USING (frame_id) GROUP BY 1")
def l1_frame_stats(spark, d):
    return frames.frame_stats(raw_frames(spark, d), _dark(spark), EPS, GEOM)


@query("SELECT frame_id, y, x, v FROM l1")
def l1_pixels(spark, d):
    return _l1(spark, d)


@query("SELECT frame_id, (y * 64 + x) // 8 AS byte, sum(1 << ((y * 64 + x) % 8))::INT AS bits FROM l1 GROUP BY 1, 2")
def l3_bitmap_bytes(spark, d):
    packed = frames.pack_frames(raw_frames(spark, d), _dark(spark), EPS, GEOM, level=3, codec=None)
    parts = packed.select("frame_id", F.posexplode(F.expr("transform(sequence(0, octet_length(bitmap) - 1), i -> cast(conv(hex(substring(bitmap, i + 1, 1)), 16, 10) as int))")).alias("byte", "bits"))
    return parts.where("bits <> 0")


@query("SELECT frame_id, lab, area, w, wy, wx, vmax, vmin FROM ev", BASE + EVENTS)
def l4_events(spark, d):
    return _events(spark, d).drop("py", "px")


@query("SELECT frame_id, lab, area, w FROM ev", BASE + EVENTS)
def l4_events_from_sparse(spark, d):
    return components.label_components(_l1(spark, d), GEOM).select("frame_id", "lab", "area", "w")


@query("SELECT frame_id, cy, cx FROM cnt", BASE + EVENTS)
def l4_counts(spark, d):
    return components.counts(_events(spark, d))


@query("SELECT frame_id, lab, (wy // w)::INT AS cy, (wx // w)::INT AS cx, vmax, vmin, round(w / area, 6) AS vmean FROM ev", BASE + EVENTS)
def l2_stats(spark, d):
    e = _events(spark, d)
    return e.select("frame_id", "lab", ratio_rounded("wy", "w", "floor").alias("cy"), ratio_rounded("wx", "w", "floor").alias("cx"), "vmax", "vmin", F.round(F.col("w") / F.col("area"), 6).alias("vmean"))


@query("SELECT frame_id, y AS cy, x AS cx FROM (SELECT cc.frame_id, y, x, row_number() OVER (PARTITION BY cc.frame_id, cc.lab ORDER BY v DESC, cc.id) AS k FROM cc JOIN fg USING (frame_id, id)) WHERE k = 1", BASE + EVENTS)
def l4_peak_centroids(spark, d):
    return components.counts(_events(spark, d), centroid="peak")


@query("SELECT frame_id, count(*) AS n_events, max(area) AS max_area FROM ev WHERE area > 2 GROUP BY 1", BASE + EVENTS)
def area_filter(spark, d):
    return components.area_filter(_events(spark, d), 2).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("area").alias("max_area"))


def _run_frames(spark, d):
    """The frames' ids and, after them, two that have nothing; no images are made for them."""
    f = frame_ids(spark, d)
    return f.unionByName(f.agg(F.max("frame_id").alias("m")).select(F.explode(F.array(F.col("m") + 1, F.col("m") + 2)).alias("frame_id")))


_RUN = ", run AS (SELECT frame_id FROM fr UNION ALL SELECT max(frame_id) + k FROM fr, (SELECT unnest([1, 2]) AS k) GROUP BY k), dose AS (SELECT run.frame_id, count(ev.lab) AS n_events FROM run LEFT JOIN ev USING (frame_id) GROUP BY 1)"


@query("SELECT frame_id, n_events, n_events / 4096.0::DOUBLE AS rate FROM dose", BASE + EVENTS + _RUN)
def dose_rate(spark, d):
    return components.dose_rate(_events(spark, d), GEOM, _run_frames(spark, d))


@query(
    "SELECT frame_id, count(*) AS n_events FROM (SELECT cc.frame_id, cc.lab FROM cc JOIN fg USING (frame_id, id) WHERE fg.y BETWEEN 1 AND 62 AND fg.x BETWEEN 1 AND 62 GROUP BY ALL) GROUP BY 1",
    BASE.replace("WHERE r.adu > d.t + 400)", "WHERE r.adu > d.t + 400 AND r.y BETWEEN 1 AND 62 AND r.x BETWEEN 1 AND 62)") + EVENTS,
)
def border_dropped_events(spark, d):
    return frames.events(raw_frames(spark, d), _dark(spark), EPS, GEOM, border="drop").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "SELECT round(avg(n_events / 4096.0::DOUBLE), 12) AS rate, count(*) AS frames, floor((SELECT count(*) FROM run) * avg(n_events / 4096.0::DOUBLE))::BIGINT AS n_events FROM dose WHERE frame_id >= (SELECT max(frame_id) - 99 FROM run)",
    BASE + EVENTS + _RUN,
)
def mean_dose(spark, d):
    """Over the last hundred frames, two of them empty, numbered from nought."""
    run = _run_frames(spark, d)
    rates = components.dose_rate(_events(spark, d), GEOM, run)
    n, last = run.where("frame_id IS NOT NULL").distinct().agg(F.count(F.lit(1)), F.max("frame_id")).first()
    late = rates.where(F.col("frame_id") >= last - 99).withColumn("frame_id", F.col("frame_id") - (last - 99))
    return components.mean_dose(late, n).select(F.round("rate", 12).alias("rate"), "frames", "n_events")


@query(
    "SELECT v.frame_id, count(ev.lab) AS n_events, count(ev.lab) / 1024.0::DOUBLE AS rate FROM (SELECT frame_id FROM fr WHERE frame_id % 10 = 0) v LEFT JOIN ev USING (frame_id) GROUP BY 1",
    BASE.replace("WHERE r.adu > d.t + 400)", "WHERE r.adu > d.t + 400 AND r.y BETWEEN 16 AND 47 AND r.x BETWEEN 16 AND 47)") + EVENTS,
)
def validation_dose(spark, d):
    return chunks.validation_dose(raw_frames(spark, d), _dark(spark), EPS, GEOM, 10, 32)


_ROIS = [(1, 8, 8, 20, 20), (2, 0, 32, 64, 16), (3, 30, 30, 4, 30)]


@query("SELECT roi_id, frame_id, count(*) AS n FROM l1 JOIN (VALUES (1, 8, 8, 20, 20), (2, 0, 32, 64, 16), (3, 30, 30, 4, 30)) r(roi_id, x0, y0, w, h) ON x > x0 AND x < x0 + w AND y > y0 AND y < y0 + h GROUP BY 1, 2")
def roi_counts(spark, d):
    rois = spark.createDataFrame(_ROIS, "roi_id int, x0 int, y0 int, w int, h int")
    return views.roi_counts(_l1(spark, d), rois)


@query("SELECT frame_id, count(*) AS n_px, sum(adu)::BIGINT AS sum_adu, max(adu) AS max_adu FROM raw WHERE frame_id % 10 = 0 GROUP BY 1")
def validation_sample(spark, d):
    px = frames.pixels(views.every_nth(raw_frames(spark, d), 10), GEOM)
    return px.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_px"), F.sum("adu").alias("sum_adu"), F.max("adu").alias("max_adu"))


@query("SELECT frame_id, count(*) AS n_fg, count(*) / 1024.0::DOUBLE AS rate FROM l1 WHERE frame_id % 10 = 0 AND y BETWEEN 16 AND 47 AND x BETWEEN 16 AND 47 GROUP BY 1")
def central_roi_dose(spark, d):
    l1 = frames.reduce_l1(views.every_nth(raw_frames(spark, d), 10), _dark(spark), EPS, GEOM)
    inside, roi = views.central_roi(l1, GEOM, 32)
    return inside.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_fg")).withColumn("rate", F.col("n_fg") / F.lit(float(roi.pixels)))


_SIZES = "sz AS (SELECT fr.frame_id, 512::BIGINT AS c1, ((count(v) * 12 + 7) // 8)::BIGINT AS c2 FROM fr LEFT JOIN l1 USING (frame_id) GROUP BY 1)"


@query("SELECT frame_id, c1, c2, c2 AS packed, coalesce(sum(c1 + c2) OVER (ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM sz", BASE + ", " + _SIZES)
def seek_table(spark, d):
    packed = frames.pack_frames(raw_frames(spark, d), _dark(spark), EPS, GEOM, codec=None)
    return layout.seek_table(packed.select("frame_id", F.col("bitmap_bytes").alias("c1"), F.col("vals_bytes").alias("c2"), F.col("packed_bytes").alias("packed")))


@query("SELECT frame_id, id, (id - coalesce(lag(id) OVER (PARTITION BY frame_id ORDER BY id), 0) - 1)::INT AS gap FROM (SELECT frame_id, (y * 64 + x)::INT AS id FROM l1) WHERE id >= 1")
def rle_runs(spark, d):
    return layout.rle_runs(_l1(spark, d), 64)


@query("SELECT frame_id, (cy * 64 + cx) AS id, (cy * 64 + cx) % 256 AS b0, (cy * 64 + cx) // 256 AS b1 FROM cnt", BASE + EVENTS)
def linear_indices(spark, d):
    c = components.counts(_events(spark, d)).select("frame_id", F.expr("cy * 64 + cx").alias("id"))
    return c.select("frame_id", "id", F.expr("id % 256").alias("b0"), F.expr("cast(id div 256 as int)").alias("b1"))


@query("SELECT frame_id, y, x, v, row_number() OVER (PARTITION BY frame_id ORDER BY y, x)::INT AS ordinal FROM l1")
def fg_ordinal(spark, d):
    return layout.ordinals(_l1(spark, d))


@query("SELECT g.y, g.x, coalesce(v + 1, 4096)::INT AS t FROM grid g LEFT JOIN (SELECT y, x, v, row_number() OVER (PARTITION BY y, x ORDER BY v DESC) AS k FROM l1) r ON r.y = g.y AND r.x = g.x AND k = 6")
def gain_threshold(spark, d):
    return calibration.gain_threshold(_l1(spark, d), 5, GEOM)


@query("SELECT y, x, ((max(CASE WHEN k = 3 THEN v END) + max(CASE WHEN k = 4 THEN v END)) / 2.0)::DOUBLE AS t FROM (SELECT y, x, v, row_number() OVER (PARTITION BY y, x ORDER BY v DESC) AS k FROM l1) GROUP BY 1, 2")
def topk_midpoint(spark, d):
    return calibration.topk_midpoint(_l1(spark, d), 3, GEOM).withColumn("t", F.col("t").cast("double"))


@query("SELECT frame_id, y, x, (adu - median(adu) OVER (PARTITION BY frame_id, x // 16, x % 2))::DOUBLE AS adu FROM raw")
def common_mode(spark, d):
    return calibration.common_mode(raw_frames(spark, d), GEOM, 16)


@query("SELECT (frame_id // 10)::INT AS bin, y, x, sum(v)::BIGINT AS sum_v FROM l1 GROUP BY 1, 2, 3")
def fraction_view(spark, d):
    return views.fraction_view(_l1(spark, d), 10)


@query("SELECT (frame_id // 10)::INT AS bin, coalesce(sum(v), 0)::BIGINT AS total, coalesce(sum(v), 0)::BIGINT / 40960.0::DOUBLE AS rate, (frame_id // 10)::INT * (coalesce(sum(v), 0)::BIGINT / 40960.0::DOUBLE) AS cumulative FROM fr LEFT JOIN l1 USING (frame_id) GROUP BY frame_id // 10")
def dose_summary(spark, d):
    raw = raw_frames(spark, d)
    return views.dose_summary(frames.reduce_l1(raw, _dark(spark), EPS, GEOM), GEOM, 10, frames=raw)


@query(
    "SELECT bin, round(quantile_cont(coalesce(sum_v, 0), 0.9), 6)::DOUBLE AS p FROM (SELECT b.bin, g.y, g.x, s.sum_v FROM (SELECT DISTINCT (frame_id // 10)::INT AS bin FROM fr) b CROSS JOIN grid g LEFT JOIN (SELECT (frame_id // 10)::INT AS bin, y, x, sum(v)::BIGINT AS sum_v FROM l1 GROUP BY 1, 2, 3) s ON s.bin = b.bin AND s.y = g.y AND s.x = g.x) GROUP BY bin"
)
def view_p90(spark, d):
    raw = raw_frames(spark, d)
    view = views.fraction_view(frames.reduce_l1(raw, _dark(spark), EPS, GEOM), 10)
    return views.view_percentile(view, GEOM, 0.9, raw.select(F.expr("cast(frame_id div 10 as int)").alias("bin"))).withColumn("p", F.round("p", 6))


@query("SELECT i::INT AS i, y, x, floor(med + 2.5 * i)::INT AS t FROM (SELECT y, x, median(adu) AS med FROM raw GROUP BY 1, 2), (SELECT unnest(range(4)) AS i)")
def sigma_thresholds(spark, d):
    return calibration.sigma_thresholds(tiles.pixel_stats(_hist(spark, d), GEOM), 2.5, 4)


_ZC = ", med AS (SELECT y, x, median(adu) AS m FROM raw GROUP BY 1, 2), zc AS (SELECT (adu - m)::DOUBLE AS d FROM raw JOIN med USING (y, x)), en AS (SELECT min(d) AS lo, max(d) AS hi FROM zc)"


@query("SELECT least(100, floor((d - lo) * 100 / (hi - lo)) + 1)::INT AS bin, count(*) AS n FROM zc, en GROUP BY 1", BASE + _ZC)
def zero_centred_hist(spark, d):
    return calibration.equal_histogram(tiles.deviations(_hist(spark, d)), weight="n").select("bin", "n")


@query("SELECT round(sum(c * n) / sum(n), 6) AS mean, round(sqrt(sum(c * c * n) / sum(n) - (sum(c * n) / sum(n)) ^ 2), 6) AS sigma FROM (SELECT d::DOUBLE AS c, count(*)::DOUBLE AS n FROM zc GROUP BY 1)", BASE + _ZC)
def histogram_moments(spark, d):
    h = tiles.deviations(_hist(spark, d)).select(F.col("d").alias("c"), F.col("n").cast("double").alias("n"))
    return calibration.histogram_moments(h).select(F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


_LAST = """, med AS (SELECT y, x, median(adu) AS m FROM raw GROUP BY 1, 2), late AS (SELECT frame_id FROM fr ORDER BY frame_id DESC LIMIT 40),
sf AS (SELECT i, frame_id, y, x, (y * 64 + x)::BIGINT AS id FROM raw JOIN late USING (frame_id) JOIN med USING (y, x), (SELECT unnest(range(4)) AS i) WHERE adu > floor(m + 60.0 * (i + 1))),
sr AS (SELECT i, frame_id, id, y, x, id AS lab FROM sf
       UNION SELECT f.i, f.frame_id, f.id, f.y, f.x, sr.lab FROM sr JOIN sf f ON f.i = sr.i AND f.frame_id = sr.frame_id AND abs(f.y - sr.y) <= 1 AND abs(f.x - sr.x) <= 1 AND sr.lab < f.id),
se AS (SELECT i, count(DISTINCT (frame_id, lab)) AS n_events FROM (SELECT i, frame_id, id, min(lab) AS lab FROM sr GROUP BY 1, 2, 3) GROUP BY 1)"""


@query("SELECT i::INT AS i, n_frames, n_events, n_fg FROM (SELECT i, count(*) AS n_fg FROM sf GROUP BY 1) JOIN se USING (i), (SELECT count(*) AS n_frames FROM late)", BASE + _LAST)
def sigma_events(spark, d):
    """Events and foreground of the last 40 frames at four thresholds over the median, all from one pass."""
    raw = raw_frames(spark, d)
    med = tiles.pixel_stats(_hist(spark, d), GEOM).select("y", "x", (F.col("med") + 60.0).alias("med"))
    least = raw.select("frame_id").orderBy(F.desc("frame_id")).limit(40).agg(F.min("frame_id")).first()[0]
    return calibration.sigma_counts(raw.where(F.col("frame_id") >= least), med, 60.0, 4, GEOM)


@query("SELECT frame_id, lab, area, w + 400 * area AS w FROM ev", BASE + EVENTS)
def l4_dark_weights(spark, d):
    return frames.events(raw_frames(spark, d), _dark(spark), EPS, GEOM, weights="dark").select("frame_id", "lab", "area", "w")


@query("SELECT frame_id, y, string_agg(adu::VARCHAR || ' ', '' ORDER BY x) AS line FROM raw GROUP BY 1, 2")
def text_lines(spark, d):
    return views.text_lines(raw_frames(spark, d), GEOM)


@query("SELECT metric, value::DOUBLE AS value FROM (SELECT unnest(['last_frame', 'raw_bytes', 'reduced_bytes', 'run_frames', 'run_pixels']) AS metric, unnest([max(frame_id), count(*) * 8192, sum(512 + (n * 12 + 7) // 8), count(*), sum(n)]) AS value FROM (SELECT fr.frame_id, count(v) AS n FROM fr LEFT JOIN l1 USING (frame_id) GROUP BY 1))")
def run_metrics(spark, d):
    """Figures of a run, observed while its records are made."""
    packed = frames.pack_frames(raw_frames(spark, d), _dark(spark), EPS, GEOM)
    found = metrics.measured(packed, GEOM, lambda r: r.write.format("noop").mode("overwrite").save())
    return metrics.metric_rows(spark, {k: v for k, v in found.items() if k not in ("run_ms", "compressed_bytes")})


@query("SELECT frame_id, y, x, v FROM l1")
def sql_unpack_frame(spark, d):
    """Records unpacked in plain SQL by the table function."""
    register_functions(spark)
    frames.pack_frames(raw_frames(spark, d), _dark(spark), EPS, GEOM).createOrReplaceTempView("packed_records")
    return spark.sql("SELECT r.frame_id, p.y, p.x, p.v FROM packed_records r, LATERAL unpack_frame(r.bitmap, r.vals, 12, 'zlib', 64, 4096) p")


@query("SELECT frame_id, count(*) AS n, sum(y * 64 + x)::BIGINT AS places, sum(v)::BIGINT AS sum_v, ((count(*) * 12 + 7) // 8)::INT AS packed FROM l1 GROUP BY 1")
def sql_pack_round_trip(spark, d):
    """Pixels packed and unpacked again by SQL functions."""
    register_functions(spark)
    _l1(spark, d).createOrReplaceTempView("sparse_pixels")
    return spark.sql(
        """WITH s AS (SELECT frame_id, array_sort(collect_list(struct(y * 64 + x AS i, v AS v))) AS px FROM sparse_pixels GROUP BY frame_id),
        p AS (SELECT frame_id, size(px) AS k, pack_bits(px.i, 4096) AS bits, pack_values(px.v, 12) AS vals FROM s)
        SELECT frame_id, cast(k AS long) AS n, aggregate(unpack_bits(bits, 4096), 0L, (a, i) -> a + i) AS places, aggregate(unpack_values(vals, 12, k), 0L, (a, v) -> a + v) AS sum_v, octet_length(vals) AS packed FROM p"""
    )


_RECAL = "SELECT frame_id, y, x, v::INT AS v FROM (SELECT fr.frame_id, g.y, g.x, least(65535, greatest(0, coalesce(l1.v, 0) + g.t - (g.t + (g.y + g.x) % 7 - 3 + {eps}))) AS v FROM fr CROSS JOIN dark g LEFT JOIN l1 ON l1.frame_id = fr.frame_id AND l1.y = g.y AND l1.x = g.x) WHERE v > 0"


def _recal(spark, d, eps):
    dark = _dark(spark)
    new = dark.select("y", "x", F.expr("t + (y + x) % 7 - 3").alias("t"))
    return frames.recalibrate(frames.reduce_l1(raw_frames(spark, d), dark, EPS, GEOM), dark, new, eps, GEOM, frame_ids(spark, d))


@query(_RECAL.format(eps=1))
def recalibrate(spark, d):
    return _recal(spark, d, 1)


@query(_RECAL.format(eps=5))
def recalibrate_sparse(spark, d):
    return _recal(spark, d, 5)


@query("SELECT fr.frame_id, 4096::BIGINT AS n_px, coalesce(sum(v), 0)::BIGINT AS sum_v, (4096 - count(v))::BIGINT AS n_zero FROM fr LEFT JOIN l1 USING (frame_id) GROUP BY 1")
def expand_dense(spark, d):
    px = frames.pixels(frames.dense(_l1(spark, d), GEOM, frame_ids(spark, d)), GEOM)
    return px.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_px"), F.sum("adu").alias("sum_v"), F.count_if(F.col("adu") == 0).alias("n_zero"))


def _parts(spark, d):
    s = l1_frame_stats(spark, d).where("frame_id % 37 <> 5").select("frame_id", "n_fg", "sum_v").withColumn("part", F.expr("cast(frame_id % 4 as int)"))
    return s.unionByName(s.where("frame_id % 50 = 0").select("frame_id", "n_fg", (F.col("sum_v") + 1).alias("sum_v"), F.lit(3).alias("part")))


_PARTS = ", st AS (SELECT frame_id, (frame_id % 4)::INT AS part, count(*) AS n_fg, sum(v)::BIGINT AS sum_v FROM l1 WHERE frame_id % 37 <> 5 GROUP BY 1), pt AS (SELECT * FROM st UNION ALL SELECT frame_id, 3, n_fg, sum_v + 1 FROM st WHERE frame_id % 50 = 0)"


@query("SELECT frame_id, part, n_fg, sum_v FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY part DESC) AS k FROM pt) WHERE k = 1", BASE + _PARTS)
def merge_parts(spark, d):
    return layout.ordered(layout.merge_parts(_parts(spark, d))).select("frame_id", "part", "n_fg", "sum_v")


@query("SELECT range::BIGINT AS frame_id FROM range((SELECT max(frame_id) + 1 FROM fr)) WHERE range NOT IN (SELECT frame_id FROM pt)", BASE + _PARTS)
def missing_frames(spark, d):
    n = frame_ids(spark, d).agg(F.max("frame_id")).first()[0] + 1
    return layout.missing_frames(_parts(spark, d), n)


@query("SELECT frame_id, count(*) AS n, list_sort(list(part))::VARCHAR AS parts FROM pt GROUP BY 1 HAVING count(*) > 1", BASE + _PARTS)
def duplicate_frames(spark, d):
    return layout.duplicate_frames(_parts(spark, d)).withColumn("parts", F.concat(F.lit("["), F.array_join("parts", ", "), F.lit("]")))


@query("SELECT part, min(frame_id) AS first, max(frame_id) AS last, count(DISTINCT frame_id) AS n FROM pt GROUP BY 1", BASE + _PARTS)
def part_summary(spark, d):
    return layout.part_summary(_parts(spark, d))


@query("SELECT chunk_id, n, coalesce(sum(n) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run_offset FROM (SELECT frame_id // 7 AS chunk_id, count(*) AS n FROM fr GROUP BY 1)")
def run_offsets(spark, d):
    return layout.run_offsets(raw_frames(spark, d).groupBy(F.expr("frame_id div 7").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT frame_id, count(*) AS n FROM (SELECT * FROM cnt c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT frame_id, (vmax % 64)::INT AS cy, (area % 64)::INT AS cx FROM ev) o WHERE o.frame_id = c.frame_id AND abs(o.cy - c.cy) <= 1 AND abs(o.cx - c.cx) <= 1)) GROUP BY 1", BASE + EVENTS)
def nn_match(spark, d):
    e = _events(spark, d)
    other = e.select("frame_id", F.expr("vmax % 64").alias("cy"), F.expr("cast(area % 64 as int)").alias("cx")).distinct()
    return components.unmatched(components.counts(e), other).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS differing FROM ((SELECT frame_id, y, x, v FROM l1 EXCEPT ALL SELECT frame_id, y, x, v + (frame_id % 5 = 0)::INT FROM l1) UNION ALL (SELECT frame_id, y, x, v + (frame_id % 5 = 0)::INT FROM l1 EXCEPT ALL SELECT frame_id, y, x, v FROM l1))")
def frame_differences(spark, d):
    a = _l1(spark, d)
    b = a.withColumn("v", F.col("v") + F.when(F.col("frame_id") % 5 == 0, 1).otherwise(0))
    return layout.differences(a, b).agg(F.count(F.lit(1)).alias("differing"))


@query("SELECT vec_id, (pos - 1)::INT AS pos, val - 0.1::DOUBLE AS v FROM (SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS val FROM embeddings) WHERE val > 0.1::DOUBLE", "")
def embedding_frames_l1(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "val"))
    return e.select("vec_id", "pos", (F.col("val").cast("double") - F.lit(0.1)).alias("v")).where("v > 0")


ORACLES["embedding_frames_l1"] = ORACLES["embedding_frames_l1"].replace("WHERE val > 0.1::DOUBLE", "WHERE val - 0.1::DOUBLE > 0")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2", "")
def chunk_windows(spark, d):
    return chunks.chunk_windows(spark.read.parquet(f"{d}/events.parquet"))


@query("SELECT frame_id, count(*) AS n, sum(v)::BIGINT AS sum_v FROM l1 GROUP BY 1")
def pack_roundtrip(spark, d):
    packed = frames.pack_frames(raw_frames(spark, d), _dark(spark), EPS, GEOM, codec="shuffle_zstd")
    return frames.unpack_records(packed, GEOM, codec="shuffle_zstd").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum_v"))


@query()
def codec_sizes(spark, d):
    plain = frames.pack_frames(raw_frames(spark, d), _dark(spark), EPS, GEOM, codec=None)
    return layout.codec_ratios(plain, ("zlib", "zstd", "lz4", "snappy", "bz2", "lzma", "shuffle_zstd"), GEOM.nbytes)


@query()
def fft_view(spark, d):
    return views.spectrum(raw_frames(spark, d), GEOM)


@query()
def gaussian_sigma(spark, d):
    return spark.createDataFrame([(calibration.global_sigma(tiles.deviations(_hist(spark, d))),)], "sigma double")


@query()
def calibration_report(spark, d):
    _, report, _ = calibration.sigma_report(raw_frames(spark, d), GEOM, 3, n_stats=40)
    return report
