"""Image and mask operators over embeddings seen as 8 x 8 images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.operators import masks, pixel, tables
from lumigrid.plans import adapters as A

PIXEL = """pixel AS (
    SELECT image_id, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, CAST(x AS DOUBLE) AS v
    FROM (SELECT vec_id AS image_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings))"""
MASK = f"""{PIXEL},
mask AS (SELECT image_id, r, c, CAST(CASE WHEN v > 0.05 THEN 1 + (r // 4) * 2 + (c // 4) ELSE 0 END AS INTEGER) AS label FROM pixel)"""
#: The distance to the background by comparing with all of it, and components by recursion.
EDT = f"""{MASK},
edt AS (
    SELECT a.image_id, a.r, a.c, a.label, CASE WHEN a.label = 0 THEN 0.0 ELSE min(sqrt(CAST((a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c) AS DOUBLE))) END AS dist
    FROM mask a LEFT JOIN mask b ON a.image_id = b.image_id AND b.label = 0 GROUP BY a.image_id, a.r, a.c, a.label)"""
REACH = """reach(image_id, r, c, label, root) AS (
    SELECT image_id, r, c, label, r * 8 + c FROM mask WHERE label <> 0
    UNION
    SELECT m.image_id, m.r, m.c, m.label, p.root FROM reach p JOIN mask m ON m.image_id = p.image_id AND m.label = p.label AND abs(m.r - p.r) <= 1 AND abs(m.c - p.c) <= 1),
comp AS (SELECT image_id, r, c, label, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS component FROM (SELECT image_id, r, c, label, min(root) AS root FROM reach GROUP BY ALL))"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pixel_table(spark, sf_dir)


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mask_table(spark, sf_dir)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


@query(f"WITH {PIXEL} SELECT image_id, r, c, round(v, 6) + 0.0 AS v FROM pixel")
def pixels(spark, d):
    return rounded(px(spark, d), "v")


@query(f"WITH {PIXEL} SELECT image_id, r, c, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-7), 6) + 0.0 AS v FROM pixel WINDOW w AS (PARTITION BY image_id)")
def whole_image_norm(spark, d):
    return rounded(pixel.normalize(px(spark, d)), "v")


BOX = "FROM pixel a JOIN pixel b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.image_id, a.r, a.c, a.v"


@query(f"WITH {PIXEL} SELECT a.image_id, a.r, a.c, round(sum(b.v) / 9, 6) + 0.0 AS mean {BOX}")
def box_mean(spark, d):
    return rounded(pixel.box_mean(px(spark, d), 3).drop("v"), "mean")


@query(f"""WITH {PIXEL}, m AS (SELECT a.image_id, a.r, a.c, a.v - sum(b.v) / 9 AS v {BOX}),
s AS (SELECT a.image_id, a.r, a.c, a.v, sum(b.v) / 9 AS m1, sum(b.v * b.v) / 9 AS m2 {BOX.replace('pixel', 'm')})
SELECT image_id, r, c, round(v / (sqrt(greatest(m2 - m1 * m1, 0)) + 1e-7), 5) + 0.0 AS v FROM s""")
def window_std_norm(spark, d):
    return rounded(pixel.normalize_local(px(spark, d), 3), "v", digits=5)


@query(f"""WITH {PIXEL}, t AS (SELECT image_id, r, c, v / max(v) OVER (PARTITION BY image_id) AS v FROM pixel)
SELECT a.image_id, a.r, a.c, round(a.v - sum(b.v) / 9, 6) + 0.0 AS v {BOX.replace('pixel', 't')}""")
def max_norm(spark, d):
    return rounded(pixel.normalize_max(px(spark, d), 3), "v")


@query(f"""WITH {PIXEL}, t AS (SELECT image_id, r, c, v / (SELECT max(v) FROM pixel) AS v FROM pixel)
SELECT a.image_id, a.r, a.c, round(a.v - sum(b.v) / 9, 6) + 0.0 AS v {BOX.replace('pixel', 't')}""")
def max_norm_batch(spark, d):
    return rounded(pixel.normalize_max(px(spark, d), 3, whole_batch=True), "v")


@query(f"""WITH {PIXEL}, p AS (SELECT CAST(unnest(range(12)) AS INTEGER) AS k),
s AS (SELECT k, CASE WHEN k - 2 < 0 THEN 2 - k WHEN k - 2 > 7 THEN 16 - k ELSE k - 2 END AS f FROM p)
SELECT image_id, a.k AS r, b.k AS c, round(v, 6) + 0.0 AS v FROM pixel JOIN s a ON pixel.r = a.f JOIN s b ON pixel.c = b.f""")
def reflect_pad(spark, d):
    return rounded(pixel.reflect_pad(px(spark, d), 2), "v")


@query(f"WITH {PIXEL} SELECT image_id, r // 3 AS r, c // 3 AS c, round(max(v), 6) + 0.0 AS v FROM pixel WHERE r < 6 AND c < 6 GROUP BY ALL")
def max_pool(spark, d):
    return rounded(pixel.max_pool(px(spark, d), 3), "v")


@query(f"""WITH {PIXEL} SELECT a.image_id, a.r, a.c, round(max(b.v), 6) + 0.0 AS v FROM pixel a JOIN pixel b
ON a.image_id = b.image_id AND b.r - a.r IN (0, 2) AND b.c - a.c IN (0, 2) WHERE a.r < 6 AND a.c < 6 GROUP BY a.image_id, a.r, a.c""")
def dilated_max_pool(spark, d):
    return rounded(pixel.dilated_max_pool(px(spark, d), 2, 2), "v")


@query(f"WITH {PIXEL} SELECT image_id, r, c, round(r / 7.0::DOUBLE, 6) AS loc_r, round(c / 7.0::DOUBLE, 6) AS loc_c FROM pixel")
def location(spark, d):
    return rounded(pixel.location(px(spark, d)).drop("v"), "loc_r", "loc_c")


@query(f"""WITH {PIXEL}, k AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS k)
SELECT image_id, a.k AS r, b.k AS c, round(v, 6) + 0.0 AS v FROM pixel JOIN k a ON pixel.r = a.k * 8 // 20 JOIN k b ON pixel.c = b.k * 8 // 20""")
def upsample_nearest(spark, d):
    return rounded(pixel.resize_nearest(px(spark, d), 20, 20), "v")


@query(f"""WITH {PIXEL}, k AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS k),
w AS (SELECT k, CAST(unnest(range(8)) AS INTEGER) AS f, greatest(0, least(7, (k + 0.5::DOUBLE) * 8 / 5 - 0.5::DOUBLE)) AS place FROM k),
u AS (SELECT k, f, 1 - abs(place - f) AS weight FROM w WHERE 1 - abs(place - f) > 0)
SELECT image_id, a.k AS r, b.k AS c, round(sum(v * a.weight * b.weight), 6) + 0.0 AS v FROM pixel JOIN u a ON pixel.r = a.f JOIN u b ON pixel.c = b.f GROUP BY ALL""")
def resize_bilinear(spark, d):
    return rounded(pixel.resize_bilinear(px(spark, d), 5, 5), "v")


@query(f"WITH {PIXEL} SELECT image_id, r - 1 AS r, c - 2 AS c, round(v, 6) + 0.0 AS v FROM pixel WHERE r BETWEEN 1 AND 6 AND c BETWEEN 2 AND 5")
def trim_padding(spark, d):
    return rounded(pixel.trim(px(spark, d), 1, 2), "v")


@query(f"""WITH {PIXEL}, o AS (SELECT * FROM (VALUES (0, 0), (1, 3), (2, 5)) x(tile, o0))
SELECT image_id, a.tile AS tile_r, b.tile AS tile_c, r - a.o0 AS r, c - b.o0 AS c, round(v, 6) + 0.0 AS v
FROM pixel JOIN o a ON r BETWEEN a.o0 AND a.o0 + 2 JOIN o b ON c BETWEEN b.o0 AND b.o0 + 2""")
def reshape_tiles(spark, d):
    return rounded(pixel.tiles(px(spark, d), 3).drop("at_r", "at_c"), "v")


@query(f"WITH {PIXEL} SELECT image_id, r, c, round(v, 6) + 0.0 AS v FROM pixel")
def tile_untile(spark, d):
    return rounded(pixel.untile(pixel.tiles(px(spark, d), 4, 3)), "v")


@query(f"WITH {PIXEL} SELECT image_id, r, c, round(least(v, quantile_cont(v, 0.9) OVER (PARTITION BY image_id)), 6) + 0.0 AS v FROM pixel")
def percentile_clamp(spark, d):
    return rounded(pixel.clamp_percentile(px(spark, d), 0.9), "v")


@query(f"""WITH {PIXEL}, q AS (SELECT image_id, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM pixel WHERE v <> 0 GROUP BY 1)
SELECT image_id, r, c, round(greatest(0, least(1, (v - a) / (b - a))), 6) + 0.0 AS v FROM pixel JOIN q USING (image_id)""")
def rgb_percentile_stretch(spark, d):
    return rounded(pixel.stretch_percentiles(px(spark, d), 0.05, 0.95), "v")


@query(f"""WITH {PIXEL} SELECT a.image_id, a.r, a.c, round(a.v, 6) AS v FROM pixel a JOIN pixel b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2
GROUP BY a.image_id, a.r, a.c, a.v HAVING a.v = max(b.v) AND a.v > 0.1""")
def peak_local_max(spark, d):
    return rounded(pixel.local_maxima(px(spark, d), 2, 0.1), "v")


@query(f"WITH {PIXEL} SELECT image_id, r, c, round(CASE WHEN v > 0.1 THEN v ELSE 0 END, 6) + 0.0 AS v FROM pixel")
def foreground_threshold(spark, d):
    return rounded(pixel.threshold(px(spark, d), 0.1), "v")


@query(f"""WITH {PIXEL}, t AS (SELECT image_id, r, c, CASE WHEN v > 0.2 THEN v ELSE 0 END AS v FROM pixel),
u AS (SELECT *, max(v <> 0) OVER (PARTITION BY image_id, r) AS a, max(v <> 0) OVER (PARTITION BY image_id, c) AS b FROM t)
SELECT image_id, r, c, round(v, 6) + 0.0 AS v FROM u WHERE a AND b""")
def drop_empty_lines(spark, d):
    return rounded(pixel.drop_empty_lines(pixel.threshold(px(spark, d), 0.2)), "v")


# ---- masks -------------------------------------------------------------------------

EDGE = f"""{MASK}, edge AS (
    SELECT a.image_id, a.r, a.c, a.label, CAST(a.label > 0 AND bool_or(b.label <> a.label) AS INTEGER) AS edge, CAST(bool_or(b.label = 0) AS INTEGER) AS near_bg
    FROM mask a JOIN mask b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY a.image_id, a.r, a.c, a.label)"""


@query(f"WITH {EDGE} SELECT image_id, r, c, label, edge FROM edge")
def boundary_inner(spark, d):
    return masks.boundary(mask(spark, d))


@query(f"""WITH {EDGE} SELECT image_id, r, c, edge, CAST(label > 0 AND edge = 0 AS INTEGER) AS interior, CAST(label = 0 AS INTEGER) AS background FROM edge""")
def pixelwise3(spark, d):
    return masks.pixelwise(mask(spark, d))


@query(f"""WITH {EDGE} SELECT image_id, r, c, edge * (1 - near_bg) AS edge_cell, edge * near_bg AS edge_background, CAST(label > 0 AND edge = 0 AS INTEGER) AS interior, CAST(label = 0 AS INTEGER) AS background FROM edge""")
def pixelwise4(spark, d):
    return masks.pixelwise(mask(spark, d), split_edges=True)


@query(f"""WITH {EDGE}, grown AS (SELECT a.image_id, a.r, a.c, a.label, a.edge, max(b.edge) AS g FROM edge a JOIN edge b ON a.image_id = b.image_id AND (a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c) <= 4 GROUP BY ALL),
e AS (SELECT *, CASE WHEN label > 0 AND edge = 0 THEN 0 ELSE g END AS e, CAST(label > 0 AND edge = 0 AS INTEGER) AS interior FROM grown)
SELECT image_id, r, c, e AS edge, interior, CAST(e + interior = 0 AS INTEGER) AS background FROM e""")
def dilate_disk(spark, d):
    return masks.pixelwise(mask(spark, d), dilation=2)


@query(f"WITH {EDGE} SELECT image_id, r, c, CASE WHEN edge = 1 THEN 0 ELSE label END AS label FROM edge")
def erode_edges(spark, d):
    return masks.erode_edges(mask(spark, d), 1)


@query(f"WITH {MASK} SELECT image_id, r, c, CASE WHEN label = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY image_id, label = 0 ORDER BY label) END AS label FROM mask")
def relabel(spark, d):
    return masks.relabel(mask(spark, d))


@query(f"WITH {MASK} SELECT image_id, r, c, label, CASE WHEN label > 1 THEN 1 ELSE label END AS fg, CAST(label = 0 AS INTEGER) AS bg FROM mask")
def fgbg(spark, d):
    return masks.fgbg(mask(spark, d))


@query(f"""WITH {MASK}, n AS (SELECT *, max(label) OVER (PARTITION BY image_id) AS top FROM mask)
SELECT image_id, r, c, label, CAST(k AS INTEGER) AS class, CAST(k = label AS INTEGER) AS hot FROM (SELECT *, unnest(range(top + 1)) AS k FROM n)""")
def one_hot_long(spark, d):
    return masks.one_hot(mask(spark, d))


@query(f"WITH RECURSIVE {MASK}, {REACH} SELECT m.image_id, m.r, m.c, m.label, CAST(coalesce(component, 0) AS INTEGER) AS component FROM mask m LEFT JOIN comp USING (image_id, r, c)")
def connected_components(spark, d):
    return masks.components(mask(spark, d))


@query(f"WITH {EDT} SELECT image_id, r, c, label, round(dist, 6) AS dist FROM edt")
def edt(spark, d):
    return rounded(masks.distance(mask(spark, d)), "dist")


OUTER = f"""{EDT}, {REACH},
outer_ AS (SELECT e.image_id, e.r, e.c, CASE WHEN e.label = 0 THEN 0 ELSE dist / nullif(max(dist) OVER (PARTITION BY e.image_id, coalesce(component, 0)), 0) END AS dist
    FROM edt e LEFT JOIN comp USING (image_id, r, c))"""


@query(f"WITH RECURSIVE {OUTER} SELECT image_id, r, c, round(dist, 6) AS dist FROM outer_")
def outer_distance(spark, d):
    return rounded(masks.outer_distance(mask(spark, d)).select("image_id", "r", "c", "dist"), "dist")


@query(f"""WITH RECURSIVE {OUTER}, b AS (SELECT *, min(dist) OVER w - 1e-7 AS lo, max(dist) OVER w + 1e-7 AS hi FROM outer_ WINDOW w AS (PARTITION BY image_id))
SELECT image_id, r, c, CAST(ceil((dist - lo) / ((hi - lo) / 4)) - 1 AS INTEGER) AS bin FROM b""")
def outer_distance_binned(spark, d):
    return masks.watershed_bins(mask(spark, d)).select("image_id", "r", "c", "bin")


@query(f"WITH {EDT} SELECT image_id, r, c, round(CASE WHEN label = 0 THEN 0 ELSE dist / nullif(max(dist) OVER (PARTITION BY image_id, label), 0) END, 6) AS dist FROM edt")
def outer_distance_by_label(spark, d):
    return rounded(masks.outer_distance(mask(spark, d), per="label").select("image_id", "r", "c", "dist"), "dist")


#: The mask without the outermost pixels of its instances.
ERODED = f"""{MASK.replace('mask AS (', 'whole AS (')},
rim AS (SELECT a.image_id, a.r, a.c, any_value(a.label) AS label, bool_or(b.label <> a.label) AS edge FROM whole a JOIN whole b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY 1, 2, 3),
mask AS (SELECT image_id, r, c, CASE WHEN edge THEN 0 ELSE label END AS label FROM rim)"""


@query(f"WITH RECURSIVE {OUTER.replace(MASK, ERODED)} SELECT image_id, r, c, round(dist, 6) AS dist FROM outer_")
def outer_distance_eroded(spark, d):
    return rounded(masks.outer_distance(mask(spark, d), erosion=1).select("image_id", "r", "c", "dist"), "dist")


@query(f"WITH {EDT.replace(MASK, ERODED)} SELECT image_id, r, c, round(dist, 6) AS dist FROM edt")
def outer_distance_raw_eroded(spark, d):
    return rounded(masks.outer_distance(mask(spark, d), erosion=1, normalize=False).select("image_id", "r", "c", "dist"), "dist")


INNER = """WITH RECURSIVE {edt}, {reach},
e AS (SELECT edt.*, component FROM edt LEFT JOIN comp USING (image_id, r, c)),
k AS (SELECT image_id, component, sum(r * dist) / sum(dist) AS cr, sum(c * dist) / sum(dist) AS cc, count(*) AS area FROM e WHERE label <> 0 GROUP BY 1, 2)
SELECT e.image_id, e.r, e.c, round(CASE WHEN label = 0 THEN 0 ELSE 1 / (1 + {alpha} * ((e.r - cr) * (e.r - cr) + (e.c - cc) * (e.c - cc))) END, 6) AS inner_ FROM e LEFT JOIN k ON e.image_id = k.image_id AND e.component = k.component"""


@query(INNER.format(edt=EDT.replace(MASK, ERODED), reach=REACH, alpha="0.1::DOUBLE"))
def inner_distance_eroded(spark, d):
    e = masks.inner_distance(mask(spark, d), erosion=1)
    return rounded(e.select("image_id", "r", "c", F.col("inner").alias("inner_")), "inner_")


@query(INNER.format(edt=EDT, reach=REACH, alpha="0.1::DOUBLE"))
def inner_distance(spark, d):
    return rounded(masks.inner_distance(mask(spark, d)).select("image_id", "r", "c", F.col("inner").alias("inner_")), "inner_")


@query(INNER.format(edt=EDT, reach=REACH, alpha="1 / sqrt(area::DOUBLE)"))
def inner_distance_auto(spark, d):
    return rounded(masks.inner_distance(mask(spark, d), alpha="auto").select("image_id", "r", "c", F.col("inner").alias("inner_")), "inner_")


@query(f"WITH {EDT} SELECT image_id, label, round(sum(r * dist) / sum(dist), 6) AS cr, round(sum(c * dist) / sum(dist), 6) AS cc, count(*) AS area FROM edt WHERE label <> 0 GROUP BY 1, 2")
def weighted_centroid(spark, d):
    return rounded(masks.weighted_centroids(masks.distance(mask(spark, d))), "cr", "cc")


# ---- stacks ------------------------------------------------------------------------

#: All images of a class in order as stacks of twelve; pixels have unequal sides.
STACK = f"""{MASK}, place AS (SELECT image_id, concat(class, '/', t // 12) AS stack, t % 12 AS z
    FROM (SELECT vec_id AS image_id, label AS class, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings)),
voxel AS (SELECT stack, CAST(z AS INTEGER) AS z, r, c, mask.label FROM mask JOIN place USING (image_id)),
d AS (SELECT a.stack, a.z, a.r, a.c, a.label, CASE WHEN a.label = 0 THEN 0.0 ELSE min(sqrt(pow((a.z - b.z) * 0.5::DOUBLE, 2) + pow((a.r - b.r) * 0.217::DOUBLE, 2) + pow((a.c - b.c) * 0.217::DOUBLE, 2))) END AS dist
    FROM voxel a JOIN voxel b ON a.stack = b.stack AND b.label = 0 GROUP BY a.stack, a.z, a.r, a.c, a.label)"""
AXES, SPACING = ("z", "r", "c"), (0.5, 0.217, 0.217)


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images of a class in order as stacks of twelve, the last as far as they go."""
    number = F.concat_ws("/", "movie", F.floor(F.col("t") / 12)).alias("stack")
    place = A.movie_table(spark, sf_dir).select(number, (F.col("t") % 12).alias("z"), "image_id")
    return mask(spark, sf_dir).join(place, "image_id").select("stack", "z", "r", "c", "label")


@query(f"WITH {STACK} SELECT stack, z, r, c, round(CASE WHEN label = 0 THEN 0 ELSE dist / nullif(max(dist) OVER (PARTITION BY stack, label), 0) END, 6) AS dist FROM d")
def outer_distance_3d(spark, d):
    e = masks.outer_distance(stacks(spark, d), per="label", by=["stack"], axes=AXES, spacing=SPACING)
    return rounded(e.select("stack", "z", "r", "c", "dist"), "dist")


@query(f"""WITH {STACK}, k AS (SELECT stack, label, sum(z * dist) / sum(dist) AS cz, sum(r * dist) / sum(dist) AS cr, sum(c * dist) / sum(dist) AS cc, count(*) AS area FROM d WHERE label <> 0 GROUP BY 1, 2)
SELECT d.stack, z, r, c, round(CASE WHEN d.label = 0 THEN 0 ELSE 1 / (1 + 1 / cbrt(CAST(area AS DOUBLE)) * (pow((z - cz) * 0.5::DOUBLE, 2) + pow((r - cr) * 0.217::DOUBLE, 2) + pow((c - cc) * 0.217::DOUBLE, 2))) END, 6) AS inner_
FROM d LEFT JOIN k ON d.stack = k.stack AND d.label = k.label""")
def inner_distance_3d(spark, d):
    e = masks.inner_distance(stacks(spark, d), "auto", per="label", by=["stack"], axes=AXES, spacing=SPACING)
    return rounded(e.select("stack", "z", "r", "c", F.col("inner").alias("inner_")), "inner_")


@query(f"""WITH {STACK}, e AS (SELECT a.stack, a.z, a.r, a.c, a.label, CAST(a.label > 0 AND bool_or(b.label <> a.label) AS INTEGER) AS edge FROM voxel a JOIN voxel b ON a.stack = b.stack AND abs(a.z - b.z) + abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY a.stack, a.z, a.r, a.c, a.label)
SELECT stack, z, r, c, CASE WHEN edge = 1 THEN 0 ELSE label END AS label FROM e""")
def erode_edges_3d(spark, d):
    return masks.erode_edges(stacks(spark, d), 1, ["stack"], AXES)



# ---- filters and overlays ----------------------------------------------------------


@query(f"WITH {MASK} SELECT image_id, r, c, label FROM mask WHERE image_id IN (SELECT image_id FROM mask GROUP BY 1 HAVING count(DISTINCT label) - 1 >= 4)")
def min_objects_filter(spark, d):
    return tables.min_objects(mask(spark, d), 4)


@query(f"""WITH {EDGE} SELECT edge.image_id, edge.r, edge.c, round(CASE WHEN edge = 1 THEN 1 ELSE v END, 6) + 0.0 AS v FROM edge JOIN pixel USING (image_id, r, c)""")
def outline_overlay(spark, d):
    e = masks.boundary(mask(spark, d)).join(px(spark, d), ["image_id", "r", "c"])
    return rounded(e.select("image_id", "r", "c", F.when(F.col("edge") == 1, 1.0).otherwise(F.col("v")).alias("v")), "v")


# ---- objects -----------------------------------------------------------------------

PROPS = """SELECT image_id, label, count(*) AS area, round(avg(r), 6) AS cr, round(avg(c), 6) AS cc, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1, round(sum(v), 6) AS total,
    var_pop(r) + 1.0::DOUBLE / 12 AS a, var_pop(c) + 1.0::DOUBLE / 12 AS b, covar_pop(r, c) AS ab FROM mask JOIN pixel USING (image_id, r, c) WHERE label <> 0 GROUP BY 1, 2"""


@query(f"""WITH {MASK}, p AS ({PROPS}), q AS (SELECT *, (a + b) / 2 AS half, sqrt(pow((a - b) / 2, 2) + pow(ab, 2)) AS root FROM p)
SELECT image_id, label, area, cr, cc, r0, c0, r1, c1, total, round(sqrt(greatest(0, 1 - (half - root) / (half + root))), 5) AS eccentricity FROM q""")
def regionprops(spark, d):
    joined = mask(spark, d).join(px(spark, d), ["image_id", "r", "c"])
    return rounded(rounded(tables.regionprops(joined, "v"), "cr", "cc", "total"), "eccentricity", digits=5)


@query(f"""WITH {MASK}, s AS (SELECT a.image_id, a.label, a.r, a.c, 4 - count(*) FILTER (b.label = a.label) AS sides FROM mask a JOIN mask b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.label <> 0 GROUP BY ALL)
SELECT image_id, label, CAST(sum(sides) AS BIGINT) AS perimeter FROM s GROUP BY 1, 2""")
def perimeter(spark, d):
    return tables.perimeters(mask(spark, d))


@query(f"WITH {PIXEL} SELECT r, c, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std FROM pixel GROUP BY 1, 2")
def featurewise_stats(spark, d):
    return rounded(tables.featurewise(px(spark, d), ["r", "c"]), "mean", "std")


@query(f"WITH {PIXEL} SELECT image_id, r, c, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-7), 6) + 0.0 AS v FROM pixel WINDOW w AS (PARTITION BY r, c)")
def featurewise_standardize(spark, d):
    p = px(spark, d)
    stats = tables.featurewise(p, ["r", "c"])  # a row for each pixel position
    joined = p.join(F.broadcast(stats), ["r", "c"])
    return rounded(joined.select("image_id", "r", "c", ((F.col("v") - F.col("mean")) / (F.col("std") + pixel.EPSILON)).alias("v")), "v")


OVER = f"""{MASK}, b AS (SELECT image_id, r, c, CASE WHEN v > 0.1 THEN 1 + (r // 4) * 2 + (c // 4) ELSE 0 END AS p FROM pixel),
m AS (SELECT image_id, label AS t, p, count(*) AS common FROM mask JOIN b USING (image_id, r, c) GROUP BY 1, 2, 3),
s AS (SELECT *, sum(common) OVER (PARTITION BY image_id, t) AS ta, sum(common) OVER (PARTITION BY image_id, p) AS pa FROM m),
pair AS (SELECT image_id, t, p, common, common / (ta + pa - common) AS iou FROM s WHERE t <> 0 AND p <> 0)"""


def predicted(spark, d):
    return A.mask_table(spark, d, 0.1)


@query(f'WITH {OVER} SELECT image_id, t AS "true", CAST(p AS INTEGER) AS predicted, common, round(iou, 6) AS iou FROM pair')
def object_iou(spark, d):
    return rounded(tables.overlaps(mask(spark, d), predicted(spark, d)), "iou")


@query(f"""WITH {OVER}, n AS (SELECT image_id, count(DISTINCT label) FILTER (label <> 0) AS n_true FROM mask GROUP BY 1), k AS (SELECT image_id, count(DISTINCT p) FILTER (p <> 0) AS n_predicted FROM b GROUP BY 1),
h AS (SELECT image_id, count(*) AS matched FROM pair WHERE iou > 0.5 GROUP BY 1)
SELECT image_id, n_true, n_predicted, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / nullif(n_predicted, 0), 6) AS "precision", round(coalesce(matched, 0) / nullif(n_true, 0), 6) AS recall, round(2 * coalesce(matched, 0) / nullif(n_true + n_predicted, 0), 6) AS f1
FROM n JOIN k USING (image_id) LEFT JOIN h USING (image_id)""")
def match_counts(spark, d):
    return rounded(tables.object_metrics(mask(spark, d), predicted(spark, d)), "precision", "recall", "f1")


@query(f"""WITH {MASK}, j AS (SELECT image_id, label <> 0 AS a, v > 0.1 AS b FROM mask JOIN pixel USING (image_id, r, c)), s AS (SELECT image_id, count(*) FILTER (a AND b) AS i, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b FROM j GROUP BY 1)
SELECT image_id, round(2 * i / nullif(a + b, 0), 6) AS dice, round(i / nullif(a + b - i, 0), 6) AS jaccard FROM s""")
def pixel_metrics(spark, d):
    return rounded(tables.pixel_metrics(mask(spark, d), predicted(spark, d)), "dice", "jaccard")


@query(f"""WITH {MASK}, n AS (SELECT image_id, r, c, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-7) AS v FROM pixel WINDOW w AS (PARTITION BY image_id)),
m AS (SELECT image_id, r, c, v, CAST(v > 0.5 AS INTEGER) AS label FROM n),
{REACH.replace('mask', 'm2')}, x AS (SELECT 1)
SELECT image_id, CAST(component AS INTEGER) AS label, count(*) AS area, round(avg(r), 6) AS cr, round(avg(c), 6) AS cc, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1, round(sum(v), 5) AS total
FROM comp JOIN m USING (image_id, r, c) GROUP BY 1, 2""".replace("reach(image_id", "m2 AS (SELECT image_id, r, c, label FROM m), reach(image_id").replace("WITH", "WITH RECURSIVE", 1))
def segment_measure(spark, d):
    """Normalize, threshold, label by components, measure."""
    e = pixel.normalize(px(spark, d)).withColumn("label", (F.col("v") > 0.5).cast("int"))
    found = masks.components(e).withColumn("label", F.col("component"))
    return rounded(rounded(tables.regionprops(found, "v").drop("eccentricity"), "cr", "cc"), "total", digits=5)
