"""Images in crops, affine maps, and pictures of cells."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lumigrid.operators import affine, appearance, augment, cluster, crops, tables, volumes
from lumigrid.plans import adapters as A
from lumigrid.plans.targets import label_targets
from lumigrid.queries.images import MASK, PIXEL, STACK, mask, px, rounded
from lumigrid.queries.objects import KEY, MOVIE, draw

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---- crops with a margin -------------------------------------------------------------

MIRROR = "(CASE WHEN abs(p) % 14 > 7 THEN 14 - abs(p) % 14 ELSE abs(p) % 14 END)"


@query(f"""WITH {PIXEL}, tile AS (SELECT CAST(i AS INTEGER) AS tile, CAST(i * 2 AS INTEGER) AS at_, CAST(k AS INTEGER) AS k, i * 2 - 30 + k AS p FROM range(4) a(i), range(62) b(k)),
line AS (SELECT tile, at_, k, {MIRROR} AS f FROM tile)
SELECT image_id, a.tile AS tile_r, b.tile AS tile_c, count(*) AS n, round(sum(v * (a.k * 62 + b.k)), 4) + 0.0 AS load FROM pixel JOIN line a ON pixel.r = a.f JOIN line b ON pixel.c = b.f GROUP BY ALL""")
def halo_crops(spark, d):
    """Every crop of a field of 61, as the number of its pixels and a sum that tells where they are."""
    e = crops.halo_crops(px(spark, d))
    load = F.sum(F.col("v") * (F.col("r") * 62 + F.col("c")))
    return rounded(e.groupBy("image_id", "tile_r", "tile_c").agg(F.count("*").alias("n"), load.alias("load")), "load", digits=4)


def blur(x: np.ndarray) -> dict[str, np.ndarray]:
    """The mean of three by three, and the largest of five in a row; zeros beyond."""
    p = np.pad(x, ((0, 0), (1, 1), (2, 2)))
    h, w = x.shape[1:]
    mean = sum(p[:, a : a + h, b + 1 : b + 1 + w] for a in range(3) for b in range(3)) / 9
    return {"mean": mean, "top": np.max([p[:, 1 : 1 + h, b : b + w] for b in range(5)], axis=0)}


@query(f"""WITH {PIXEL}, line AS (SELECT CAST(k AS INTEGER) AS k, CAST(o AS INTEGER) AS o, CAST(CASE WHEN k + o < 0 THEN -(k + o) WHEN k + o > 7 THEN 14 - (k + o) ELSE k + o END AS INTEGER) AS f FROM range(8) a(k), range(-2, 3) b(o))
SELECT image_id, a.k AS r, b.k AS c, round(avg(v) FILTER (abs(b.o) <= 1), 6) + 0.0 AS mean, round(max(v) FILTER (a.o = 0), 6) + 0.0 AS top
FROM pixel JOIN line a ON pixel.r = a.f AND abs(a.o) <= 1 JOIN line b ON pixel.c = b.f GROUP BY ALL""")
def whole_image_in_crops(spark, d):
    return rounded(crops.whole_image(px(spark, d), blur, ("mean", "top"), crops=4, field=5), "mean", "top")


@query(f"""WITH {PIXEL}, x AS (SELECT a.image_id, a.r, a.c, sum(b.v) / 9 AS mean FROM pixel a JOIN pixel b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL)
SELECT image_id, r, c, round(CASE WHEN c < 6 AND r < 6 THEN mean ELSE 0 END, 6) + 0.0 AS mean FROM x""")
def whole_image_zero_rest(spark, d):
    """Zeros beyond the border, and sides that three crops do not divide."""
    return rounded(crops.whole_image(px(spark, d), blur, ("mean",), crops=3, field=5, padding="zero"), "mean")


# ---- affine maps ---------------------------------------------------------------------


def map_sql(key: str, seed: int, rotation=0.0, height=0.0, width=0.0, shear=0.0, zoom=0.0, flip_rows=False, flip_cols=False) -> str:
    """The six numbers of affine.drawn() for images of side 8."""

    def u(k: int, low: float, high: float) -> str:
        return f"({float(low)}::DOUBLE + {float(high) - float(low)}::DOUBLE * {draw(key, seed + k)} / 2147483647)"

    turn, slant = f"({u(0, -rotation, rotation)} * {math.pi / 180}::DOUBLE)", f"({u(1, -shear, shear)} * {math.pi / 180}::DOUBLE)"
    down, right = f"({u(2, -height, height)} * {8 if 0 < height < 1 else 1})", f"({u(3, -width, width)} * {8 if 0 < width < 1 else 1})"
    zr, zc = u(4, 1 - zoom, 1 + zoom), u(5, 1 - zoom, 1 + zoom)
    fr, fc = (f"(CASE WHEN {str(on).upper()} AND {draw(key, seed + k)} % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)" for k, on in ((6, flip_rows), (7, flip_cols)))
    return (
        f"cos({turn}) * {zr} * {fr} AS m0, -sin({turn} + {slant}) * {zc} * {fc} AS m1, sin({turn}) * {zr} * {fr} AS m2, cos({turn} + {slant}) * {zc} * {fc} AS m3, "
        f"cos({turn}) * {down} - sin({turn}) * {right} AS m4, sin({turn}) * {down} + cos({turn}) * {right} AS m5"
    )


BEYOND = {
    "nearest": "greatest(0, least(7, {x}))",
    "constant": "greatest(0, least(7, {x}))",
    "wrap": "((({x}) % 8 + 8) % 8)",
    "reflect": "(CASE WHEN ((({x}) % 16 + 16) % 16) < 8 THEN ((({x}) % 16 + 16) % 16) ELSE 15 - ((({x}) % 16 + 16) % 16) END)",
}


def seen_sql(source: str, keys: str, params: str, order: int, fill: str, cval: float = 0.0) -> str:
    """Rows (keys, r, c, v) of `source` (keys, px: a list of 64) under the map of each."""
    at = lambda a, b: f"px[CAST({BEYOND[fill].format(x=a)} * 8 + {BEYOND[fill].format(x=b)} + 1 AS BIGINT)]"
    if order == 0:
        value = at("CAST(floor(sr + 0.5) AS BIGINT)", "CAST(floor(sc + 0.5) AS BIGINT)")
    else:
        a, b = "CAST(floor(sr) AS BIGINT)", "CAST(floor(sc) AS BIGINT)"
        u, v = "(sr - floor(sr))", "(sc - floor(sc))"
        value = f"({at(a, b)} * (1 - {v}) + {at(a, f'{b} + 1')} * {v}) * (1 - {u}) + ({at(f'{a} + 1', b)} * (1 - {v}) + {at(f'{a} + 1', f'{b} + 1')} * {v}) * {u}"
    if fill == "constant":
        value = f"CASE WHEN sr < 0 OR sr > 7 OR sc < 0 OR sc > 7 THEN {cval} ELSE {value} END"
    return f"""drawn AS (SELECT *, {params} FROM {source}),
spot AS (SELECT *, CAST(i AS INTEGER) AS r, CAST(j AS INTEGER) AS c FROM drawn, range(8) a(i), range(8) b(j)),
seen AS (SELECT *, m0 * (r - 3.5::DOUBLE) + m1 * (c - 3.5::DOUBLE) + m4 + 3.5::DOUBLE AS sr, m2 * (r - 3.5::DOUBLE) + m3 * (c - 3.5::DOUBLE) + m5 + 3.5::DOUBLE AS sc FROM spot),
warped AS (SELECT {keys}, r, c, {value} AS v FROM seen)"""


BLOCK = "block AS (SELECT vec_id AS image_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS px FROM embeddings)"


def each_pixel(blocks, *keys, value="px"):
    e = blocks.select(*keys, F.posexplode(value).alias("i", "v"))
    return e.select(*keys, F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).cast("int").alias("c"), "v")


WIDE = dict(rotation=40, height=0.2, width=1.5, shear=15, zoom=0.3, flip_rows=True, flip_cols=True)


def wide(blocks, key, seed):
    return affine.drawn(blocks, key, seed, 40, 0.2, 1.5, 15, 0.3, True, True)


@query(f"WITH {BLOCK}, {seen_sql('block', 'image_id', map_sql('image_id', 21, **WIDE), 1, 'reflect')} SELECT image_id, r, c, round(v, 5) + 0.0 AS v FROM warped")
def affine_reflect(spark, d):
    return rounded(each_pixel(affine.apply(wide(A.blocks(spark, d), F.col("image_id"), 21), {"px": 1}, "reflect"), "image_id"), "v", digits=5)


@query(f"WITH {BLOCK}, {seen_sql('block', 'image_id', map_sql('image_id', 22, **WIDE), 1, 'constant', 0.25)} SELECT image_id, r, c, round(v, 5) + 0.0 AS v FROM warped")
def affine_constant(spark, d):
    return rounded(each_pixel(affine.apply(wide(A.blocks(spark, d), F.col("image_id"), 22), {"px": 1}, "constant", 0.25), "image_id"), "v", digits=5)


@query(f"""WITH {MOVIE}, {BLOCK}, frame AS (SELECT movie, t, {KEY.format('CAST(movie AS VARCHAR)')} AS k, px FROM movie JOIN block USING (image_id)),
{seen_sql('frame', 'movie, t', map_sql('k', 23, **WIDE), 1, 'nearest')} SELECT movie, t, r, c, round(v, 5) + 0.0 AS v FROM warped""")
def affine_movie(spark, d):
    """All frames of a movie by one map."""
    frames = A.movie_table(spark, d).join(A.blocks(spark, d), "image_id")
    return rounded(each_pixel(affine.apply(wide(frames, affine.key_of(F.col("movie")), 23), {"px": 1}, "nearest"), "movie", "t"), "v", digits=5)


@query(f"""WITH {MOVIE}, {BLOCK}, frame AS (SELECT movie, t, {KEY.format("concat(movie, '/', t)")} AS k, px FROM movie JOIN block USING (image_id)),
{seen_sql('frame', 'movie, t', map_sql('k', 24, **WIDE), 1, 'wrap')} SELECT movie, t, r, c, round(v, 5) + 0.0 AS v FROM warped""")
def affine_frames(spark, d):
    """Each frame of a movie by a map of its own."""
    frames = A.movie_table(spark, d).join(A.blocks(spark, d), "image_id")
    return rounded(each_pixel(affine.apply(wide(frames, affine.key_of(F.col("movie"), F.col("t")), 24), {"px": 1}, "wrap"), "movie", "t"), "v", digits=5)


@query(f"""WITH {BLOCK}, k AS (SELECT image_id, px, -0.3::DOUBLE + 0.6::DOUBLE * {draw('image_id', 25)} / 2147483647 AS shift FROM block)
SELECT image_id, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c, round(greatest(list_min(px), least(list_max(px), px[i] + shift)), 6) + 0.0 AS v FROM k, range(1, 65) x(i)""")
def channel_shift(spark, d):
    return rounded(each_pixel(affine.channel_shift(A.blocks(spark, d), F.col("image_id"), 25, 0.3), "image_id"), "v")


#: Foreground, edge and inside of each label, of images with three or more.
CHAIN = f"""{MASK}, rich AS (SELECT image_id FROM mask GROUP BY 1 HAVING count(DISTINCT label) - 1 >= 3),
near AS (SELECT a.image_id, a.r, a.c, any_value(a.label) AS label, bool_or(b.label <> a.label) AS edge FROM mask a JOIN mask b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY 1, 2, 3),
plane AS (SELECT image_id, r, c, unnest(['v', 'edge', 'interior', 'background', 'fg']) AS plane,
    unnest([v, CAST(label > 0 AND edge AS DOUBLE), CAST(label > 0 AND NOT edge AS DOUBLE), CAST(label = 0 AS DOUBLE), CAST(label > 0 AS DOUBLE)]) AS x FROM near JOIN pixel USING (image_id, r, c) WHERE image_id IN (SELECT image_id FROM rich)),
stack AS (SELECT image_id, plane, list(x ORDER BY r, c) AS px FROM plane GROUP BY 1, 2)"""
GENTLE = dict(rotation=20, shear=5, zoom=0.1, flip_cols=True)


@query(f"""WITH {CHAIN}, photo AS (SELECT * FROM stack WHERE plane = 'v'), target AS (SELECT * FROM stack WHERE plane <> 'v'),
{seen_sql('photo', 'image_id, plane', map_sql('image_id', 26, **GENTLE), 1, 'nearest').replace('drawn', 'd1').replace('spot', 's1').replace('seen', 'e1').replace('warped', 'w1')},
{seen_sql('target', 'image_id, plane', map_sql('image_id', 26, **GENTLE), 0, 'nearest').replace('drawn', 'd2').replace('spot', 's2').replace('seen', 'e2').replace('warped', 'w2')},
whole AS (SELECT image_id, plane, r, c, (v - avg(v) OVER p) / (stddev_pop(v) OVER p + 1e-7) AS v FROM w1 WINDOW p AS (PARTITION BY image_id) UNION ALL SELECT * FROM w2)
SELECT image_id, plane, r, c, round(v, 4) + 0.0 AS v FROM whole""")
def training_chain(spark, d):
    """Images with enough objects, their targets, one map for all of them, and intensities
    standardized after it."""
    m = tables.min_objects(mask(spark, d), 3)
    planes = label_targets(m.withColumn("channel", F.lit(0)), ("fgbg", "pixelwise")).where("NOT (target = 'fgbg' AND plane = 'bg')").select("image_id", "r", "c", "plane", F.col("value").cast("double").alias("v"))
    photo = px(spark, d).join(m.select("image_id").distinct(), "image_id", "left_semi").withColumn("plane", F.lit("v"))
    both = A.blocks_of(photo.unionByName(planes), ["image_id", "plane"])
    key = F.col("image_id")
    moved = affine.drawn(both, key, 26, rotation=20, shear=5, zoom=0.1, flip_cols=True)
    seen = [each_pixel(affine.apply(moved.where(some), {"px": order}, "nearest"), "image_id", "plane") for some, order in ((F.col("plane") == "v", 1), (F.col("plane") != "v", 0))]
    own = augment.Window.partitionBy("image_id")
    ready = seen[0].withColumn("v", (F.col("v") - F.avg("v").over(own)) / (F.stddev_pop("v").over(own) + 1e-7))
    return rounded(ready.unionByName(seen[1]), "v", digits=4).select("image_id", "plane", "r", "c", "v")


# ---- volumes ------------------------------------------------------------------------

#: Intensities of the stacks of twelve images.
VOLUME = f"""{STACK}, volume AS (SELECT stack, CAST(z AS INTEGER) AS z, r, c, v FROM pixel JOIN place USING (image_id))"""


def volume(spark, d):
    name = F.concat_ws("/", "movie", F.floor(F.col("t") / 12)).alias("stack")
    return A.movie_table(spark, d).join(px(spark, d), "image_id").select(name, (F.col("t") % 12).cast("int").alias("z"), "r", "c", "v")


def watershed_3d(spark, d):
    heads = volume(spark, d).select("stack", "z", "r", "c", F.col("v").alias("maxima"), F.col("v").alias("interior"))
    return volumes.watershed(heads, ["stack"], distance=2, peak=0.1, inside=0.0, block=(4, 4, 4))


Q["watershed_3d"] = watershed_3d  # iterative; its operator is tested against plain loops


@query(f"WITH {VOLUME} SELECT stack, z, r, c, round(v, 6) + 0.0 AS v FROM volume")
def tile_untile_3d(spark, d):
    """Boxes that overlap, and the mean of them."""
    boxes = volumes.tiles(volume(spark, d), (4, 6, 6), (3, 4, 4), ["stack"])
    return rounded(volumes.untile(boxes, ["stack"]), "v")


@query(f"""WITH {VOLUME}, deep AS (SELECT stack, max(z) + 1 AS n FROM volume GROUP BY 1), goal AS (SELECT stack, n, CAST(round_even(n * 1.5::DOUBLE, 0) AS INTEGER) AS m FROM deep),
place_ AS (SELECT stack, n, CAST(k AS INTEGER) AS k, (k + 0.5::DOUBLE) * n / m - 0.5::DOUBLE AS p FROM goal, range(18) x(k) WHERE k < m),
two AS (SELECT stack, n, k, unnest([floor(p), floor(p) + 1]) AS q, unnest([1 - (p - floor(p)), p - floor(p)]) AS w FROM place_),
from_ AS (SELECT stack, k, CAST(CASE WHEN n = 1 THEN 0 WHEN q < 0 THEN -q WHEN q >= n THEN 2 * (n - 1) - q ELSE q END AS INTEGER) AS z, w FROM two)
SELECT stack, f.k AS z, r, c, round(sum(v * w), 5) + 0.0 AS v FROM from_ f JOIN volume USING (stack, z) GROUP BY ALL""")
def z_rescale(spark, d):
    return rounded(volumes.resize_axis(volume(spark, d), "z", ["stack"], scale=1.5), "v", digits=5)


@query(f"""WITH {VOLUME}, goal AS (SELECT stack, max(z) + 1 AS n FROM volume GROUP BY 1),
place_ AS (SELECT stack, n, CAST(k AS INTEGER) AS k, floor((k + 0.5::DOUBLE) * n / 5 - 0.5::DOUBLE + 0.5::DOUBLE) AS q FROM goal, range(5) x(k)),
from_ AS (SELECT stack, k, CAST(CASE WHEN n = 1 THEN 0 WHEN q < 0 THEN -q WHEN q >= n THEN 2 * (n - 1) - q ELSE q END AS INTEGER) AS z FROM place_)
SELECT stack, f.k AS z, r, c, label FROM from_ f JOIN voxel USING (stack, z)""")
def z_resize_labels(spark, d):
    name = F.concat_ws("/", "movie", F.floor(F.col("t") / 12)).alias("stack")
    labels = A.movie_table(spark, d).join(mask(spark, d), "image_id").select(name, (F.col("t") % 12).cast("int").alias("z"), "r", "c", F.col("label").alias("v"))
    small = volumes.resize_axis(labels, "z", ["stack"], size=5, order=0)
    return small.select("stack", "z", "r", "c", F.col("v").cast("int").alias("label"))


def turned_sql(across: str, other: str) -> str:
    """Planes of depth and `other`, by the angle of their stack."""
    at = lambda a, b: f"px[CAST(greatest(0, least(h - 1, {a})) * 8 + greatest(0, least(7, {b})) + 1 AS BIGINT)]"
    a, b, u, v = "CAST(floor(sr) AS BIGINT)", "CAST(floor(sc) AS BIGINT)", "(sr - floor(sr))", "(sc - floor(sc))"
    value = f"({at(a, b)} * (1 - {v}) + {at(a, f'{b} + 1')} * {v}) * (1 - {u}) + ({at(f'{a} + 1', b)} * (1 - {v}) + {at(f'{a} + 1', f'{b} + 1')} * {v}) * {u}"
    return f"""WITH {VOLUME}, plane AS (SELECT stack, {across}, max(z) + 1 AS h, list(v ORDER BY z, {other}) AS px FROM volume GROUP BY 1, 2),
drawn AS (SELECT *, {map_sql(KEY.format('stack'), 31, rotation=25)} FROM plane),
spot AS (SELECT *, CAST(i AS INTEGER) AS z, CAST(j AS INTEGER) AS {other} FROM drawn, range(12) a(i), range(8) b(j) WHERE i < h),
seen AS (SELECT *, m0 * (z - (h - 1) / 2.0::DOUBLE) + m1 * ({other} - 3.5::DOUBLE) + m4 + (h - 1) / 2.0::DOUBLE AS sr, m2 * (z - (h - 1) / 2.0::DOUBLE) + m3 * ({other} - 3.5::DOUBLE) + m5 + 3.5::DOUBLE AS sc FROM spot)
SELECT stack, z, r, c, round({value}, 5) + 0.0 AS v FROM seen"""


@query(turned_sql("r", "c"))
def turn_rows_3d(spark, d):
    return rounded(volumes.turn_slices(volume(spark, d), "r", affine.key_of(F.col("stack")), 31, 25, ["stack"]), "v", digits=5)


@query(turned_sql("c", "r"))
def turn_columns_3d(spark, d):
    return rounded(volumes.turn_slices(volume(spark, d), "c", affine.key_of(F.col("stack")), 31, 25, ["stack"]), "v", digits=5)


# ---- clusters -----------------------------------------------------------------------


def spots(spark, d):
    """The pixels of an image as points: where they are, and how bright."""
    p = px(spark, d)
    return p.select("image_id", (F.col("r") * 8 + F.col("c")).cast("long").alias("id"), (F.col("r") * 0.1).alias("x"), (F.col("c") * 0.1).alias("y"), F.col("v").alias("z"))


@query(f"""WITH RECURSIVE {PIXEL}, spot AS (SELECT image_id, CAST(r * 8 + c AS BIGINT) AS id, r * 0.1::DOUBLE AS x, c * 0.1::DOUBLE AS y, v AS z FROM pixel),
near AS (SELECT a.image_id, a.id, b.id AS other FROM spot a JOIN spot b ON a.image_id = b.image_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 0.15::DOUBLE * 0.15::DOUBLE),
core AS (SELECT image_id, id FROM near GROUP BY 1, 2 HAVING count(*) >= 4),
link AS (SELECT n.* FROM near n JOIN core a ON a.image_id = n.image_id AND a.id = n.id JOIN core b ON b.image_id = n.image_id AND b.id = n.other),
way(image_id, id, root) AS (SELECT image_id, id, id FROM core UNION SELECT l.image_id, l.other, w.root FROM way w JOIN link l ON l.image_id = w.image_id AND l.id = w.id AND w.root < l.other),
named AS (SELECT image_id, id, min(root) AS cluster FROM way GROUP BY 1, 2),
edge AS (SELECT n.image_id, n.id, min(cluster) AS cluster FROM near n JOIN named k ON k.image_id = n.image_id AND k.id = n.other GROUP BY 1, 2)
SELECT s.image_id, s.id, k.id IS NOT NULL AS core, coalesce(k.cluster, e.cluster) AS cluster FROM spot s LEFT JOIN named k USING (image_id, id) LEFT JOIN edge e USING (image_id, id)""")
def cluster_density(spark, d):
    return cluster.dbscan(spots(spark, d), 0.15, 4, ["image_id"], ("x", "y", "z")).select("image_id", "id", "core", "cluster")


def cluster_modes(spark, d):
    return cluster.mean_shift(spots(spark, d), 0.3, ["image_id"], ("x", "y", "z"))[1].select("image_id", "id", "cluster")


Q["cluster_modes"] = cluster_modes  # iterative; its operator is tested against plain loops


# ---- pictures of cells ---------------------------------------------------------------

BOX = f"""{MASK}, box AS (SELECT image_id, label, min(r) AS r0, min(c) AS c0, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w, avg(r) AS cr, avg(c) AS cc, count(*) AS area FROM mask WHERE label > 0 GROUP BY 1, 2)"""


def weights_sql(size: int) -> str:
    """Table of the share of pixel s of a line of n in place i of `size`, as appearance.weights()."""
    return f"""n_ AS (SELECT CAST(n AS INTEGER) AS n, greatest(0.0::DOUBLE, (n / {size}.0::DOUBLE - 1) / 2) AS spread FROM range(1, 17) a(n)),
lin AS (SELECT n, spread, CAST(i AS INTEGER) AS i, q, (CASE WHEN q = floor(p) THEN 1 - (p - floor(p)) ELSE p - floor(p) END) AS w FROM (SELECT n, spread, i, unnest([floor(p), floor(p) + 1]) AS q, p FROM (SELECT n, spread, i, (i + 0.5::DOUBLE) * n / {size} - 0.5::DOUBLE AS p FROM n_, range({size}) b(i))) WHERE q >= 0 AND q < n),
bell AS (SELECT n, CAST(k AS INTEGER) AS k, exp(-0.5 * (k / spread) ** 2) / sum(exp(-0.5 * (k / spread) ** 2)) OVER (PARTITION BY n) AS g FROM n_, range(-16, 17) b(k) WHERE spread > 0 AND CAST(floor(4 * spread + 0.5) AS INTEGER) > 0 AND abs(k) <= CAST(floor(4 * spread + 0.5) AS INTEGER)
    UNION ALL SELECT n, 0, 1.0 FROM n_ WHERE CAST(floor(4 * spread + 0.5) AS INTEGER) = 0),
share AS (SELECT n, i, q + k AS s, sum(w * g) AS w FROM lin JOIN bell USING (n) WHERE q + k >= 0 AND q + k < n GROUP BY ALL)"""


def picture_sql(boxes: str, size: int, pixels: str = "pixel", keys: str = "image_id", on: str = "p.image_id = b.image_id") -> str:
    return f"""{weights_sql(size)}, room AS ({boxes}),
grid AS (SELECT DISTINCT {keys}, label, h, w, r0, c0, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM room, range({size}) a(i), range({size}) b(j)),
drawn AS (SELECT b.*, x.i, y.i AS j, p.v * x.w * y.w AS v FROM room b JOIN {pixels} p ON {on} AND p.r >= b.r0 AND p.r < b.r0 + b.h AND p.c >= b.c0 AND p.c < b.c0 + b.w JOIN share x ON x.n = b.h AND x.s = p.r - b.r0 JOIN share y ON y.n = b.w AND y.s = p.c - b.c0),
summed AS (SELECT {keys}, label, i, j, sum(v) AS v FROM drawn GROUP BY ALL),
picture AS (SELECT {keys}, label, i, j, round(coalesce(v, 0), 5) + 0.0 AS v FROM grid LEFT JOIN summed USING ({keys}, label, i, j))"""


def cells_of(spark, d):
    return mask(spark, d).join(px(spark, d), ["image_id", "r", "c"])


def shown(found, size, *keys):
    e = found.select(*keys, "label", F.posexplode("patch").alias("k", "v"))
    return rounded(e.select(*keys, "label", F.floor(F.col("k") / size).cast("int").alias("i"), (F.col("k") % size).cast("int").alias("j"), "v"), "v", digits=5)


@query(f"WITH {BOX}, {picture_sql('SELECT * FROM box', 3)} SELECT * FROM picture")
def cell_appearances(spark, d):
    return shown(appearance.appearances(cells_of(spark, d), 3), 3, "image_id")


@query(f"""WITH {BOX}, own AS (SELECT image_id, r, c, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v, label FROM mask JOIN pixel USING (image_id, r, c) WHERE label > 0 WINDOW w AS (PARTITION BY image_id, label) QUALIFY stddev_pop(v) OVER w > 0),
{picture_sql('SELECT image_id, label, CAST(floor(cr) AS INTEGER) - 2 AS r0, CAST(floor(cc) AS INTEGER) - 2 AS c0, 4 AS h, 4 AS w FROM box', 4, 'own', on='p.image_id = b.image_id AND p.label = b.label')} SELECT * FROM picture""")
def cell_appearances_fixed(spark, d):
    """Four pixels a side around the centre, the cell alone, standardized; part of it may be outside."""
    e = appearance.appearances(cells_of(spark, d), 20, mode="fixed", norm=True)  # wide enough for the whole cell
    e = shown(e, 20, "image_id").where("i between 8 and 11 and j between 8 and 11")
    return e.withColumns({"i": F.col("i") - 8, "j": F.col("j") - 8})


@query(f"WITH {BOX}, {picture_sql('SELECT image_id, label, CAST(floor(cr) AS INTEGER) - 5 AS r0, CAST(floor(cc) AS INTEGER) - 5 AS c0, 10 AS h, 10 AS w FROM box', 5)} SELECT * FROM picture")
def cell_neighbourhoods(spark, d):
    return shown(appearance.neighbourhoods(cells_of(spark, d), 5, 2), 5, "image_id")


@query(f"""WITH {BOX}, {MOVIE}, frame AS (SELECT movie, t, pixel.* FROM movie JOIN pixel USING (image_id)), placed AS (SELECT movie, t, box.* FROM movie JOIN box USING (image_id) JOIN (SELECT movie, max(t) AS last FROM movie GROUP BY 1) USING (movie) WHERE t < last),
{picture_sql('SELECT movie, t, label, CAST(floor(cr) AS INTEGER) - 3 AS r0, CAST(floor(cc) AS INTEGER) - 3 AS c0, 6 AS h, 6 AS w FROM placed', 5, 'frame', 'movie, t', 'p.movie = b.movie AND p.t = b.t + 1')} SELECT * FROM picture""")
def cell_future_areas(spark, d):
    frames = A.movie_table(spark, d).join(cells_of(spark, d), "image_id").drop("image_id")
    return shown(appearance.future_areas(frames, 3, 2, ["movie", "t"]), 5, "movie", "t")
