"""Features of tracked cells, windows of samples, and images at a model's size."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumigrid.operators import augment, features, graph, masks, pixel, tables
from lumigrid.plans import adapters as A
from lumigrid.plans import targets
from lumigrid.queries.images import MASK, OUTER, PIXEL, mask, px, rounded
from lumigrid.queries.objects import CELL, LINEAGE, MOVIE, SAME, cells, draw, family

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---- tracks ------------------------------------------------------------------------

PLACED = f"{CELL}, placed AS (SELECT *, row_number() OVER (PARTITION BY movie, t ORDER BY track) AS place FROM cell)"


def placed(spark, d):
    return tables.placed(cells(spark, d))


@query(f"WITH {LINEAGE}, {SAME}, kept AS (SELECT movie, track FROM lineage WHERE last - first >= 2) SELECT movie, t, track FROM same WHERE (movie, track) IN (SELECT (movie, track) FROM kept)")
def known_same(spark, d):
    c = family(spark, d)
    some = A.lineage_table(c).where(F.col("last") - F.col("first") >= 2)
    return features.known(graph.same_edges(c), some).select("movie", "t", "track")


@query(f"WITH {LINEAGE}, {SAME} SELECT movie, t, track FROM cell WHERE (movie, t) IN (SELECT (movie, t) FROM same)")
def linked_frames(spark, d):
    c = family(spark, d)
    return features.linked_frames(c, graph.same_edges(c)).select("movie", "t", "track")


@query(f"""WITH {PLACED}, room AS (SELECT max(place) + 3 AS n FROM placed), f AS (SELECT DISTINCT movie, t, unnest(range(1, (SELECT n FROM room) + 1)) AS place FROM cell)
SELECT f.movie, f.t, f.place, coalesce(track, 0) AS track, coalesce(area, 0) AS area FROM f LEFT JOIN placed p ON p.movie = f.movie AND p.t = f.t AND p.place = f.place""")
def padded_cells(spark, d):
    p = placed(spark, d)
    most = p.agg(F.max("place")).first()[0]
    return features.padded(p, (most or 0) + 3, ("track", "area"))


@query(f"WITH {PIXEL}, k AS (SELECT * FROM pixel WHERE v > 0.1) SELECT image_id, list(round(v, 6) ORDER BY r, c) AS val, list(r ORDER BY r, c) AS ind_r, list(c ORDER BY r, c) AS ind_c FROM k GROUP BY 1")
def sparse_images(spark, d):
    return features.sparse(rounded(pixel.threshold(px(spark, d), 0.1), "v"), ["image_id"], ("r", "c"), "v")


@query(f"WITH {PLACED} SELECT t, place, track FROM placed WHERE movie = 'click' AND track <> 0")
def batch_slice(spark, d):
    return features.batch_of(placed(spark, d).where("track <> 0").select("movie", "t", "place", "track"), "movie", "click")


@query(f"WITH {CELL} SELECT movie, track, t, area AS morphologies, round(x, 6) AS centroids, area % 3 AS adj_matrices, track % 5 AS temporal_adj_matrices FROM cell")
def routed_features(spark, d):
    cent, adj, temp_adj = F.round("x", 6).alias("cent"), (F.col("area") % 3).alias("adj"), (F.col("track") % 5).alias("temp_adj")
    named = cells(spark, d).select("movie", "track", "t", F.col("area").alias("morph"), cent, adj, temp_adj)
    return features.routed(named, ("movie", "track", "t")).select("movie", "track", "t", "x.*", "y.*")


@query(f"WITH {CELL}, n AS (SELECT movie, t, count(*) AS n FROM cell GROUP BY 1, 2), m AS (SELECT movie, count(*) AS t, max(n) AS n FROM n GROUP BY 1) SELECT count(*) AS movies, max(t) AS frames, max(n) AS cells FROM m")
def largest_shape(spark, d):
    return features.largest_shape(cells(spark, d))


@query("SELECT vec_id, vec_id // 7 AS batch, vec_id % 7 AS t FROM embeddings")
def unmerge(spark, d):
    return features.unmerged(A.read(spark, d, "embeddings").select("vec_id"), "vec_id", 7)


@query("SELECT user_id, ts, concat('event=', event_type, ',min=', CASE WHEN user_id % 2 = 0 THEN user_id % 10 ELSE 3 END, ',side=8') AS options FROM events")
def merged_options(spark, d):
    e = A.read(spark, d, "events")
    text = lambda c: c.cast("string")
    defaults = F.create_map(F.lit("min"), F.lit("3"), F.lit("side"), F.lit("8"), F.lit("event"), F.lit("none"))
    own = F.create_map(F.lit("event"), F.col("event_type"))
    own = F.when(F.col("user_id") % 2 == 0, F.map_concat(own, F.create_map(F.lit("min"), text(F.col("user_id") % 10)))).otherwise(own)
    entries = F.array_sort(F.transform(F.map_entries(features.merged_options(defaults, own)), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return e.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.array_join(entries, ",").alias("options"))


@query(f"""WITH {CELL}, f AS (SELECT movie, track, unnest(list_sort(list(t))) AS t FROM cell GROUP BY 1, 2),
n AS (SELECT movie, track, min(t) AS old, max(t) AS last, count(*) AS n FROM f GROUP BY 1, 2),
k AS (SELECT f.movie, f.track, f.t, row_number() OVER (PARTITION BY f.movie, f.track ORDER BY {draw('(f.track * 1000003 + f.t)', 8)}, f.t) AS i FROM f JOIN n ON n.movie = f.movie AND n.track = f.track WHERE f.t < n.last OR n.n = 1),
s AS (SELECT movie, track, list_sort(list(t)) AS s FROM k WHERE i <= 4 GROUP BY 1, 2)
SELECT movie, track, list_concat(list_transform(range(4 - len(s)), lambda x: old), s) AS frames FROM s JOIN n USING (movie, track)""")
def random_frames(spark, d):
    tracks = cells(spark, d).groupBy("movie", "track").agg(F.sort_array(F.collect_list("t")).alias("frames"))
    return tables.random_frames(tracks, 4, 8)


# ---- samples -----------------------------------------------------------------------


@query(f"""WITH {PIXEL}, p AS (SELECT * FROM pixel WHERE v > 0.2 AND r - 1 > 0 AND r + 1 < 8 AND c - 1 > 0 AND c + 1 < 8)
SELECT p.image_id, p.r, p.c, q.r - p.r AS dr, q.c - p.c AS dc, round(q.v, 6) + 0.0 AS v FROM p JOIN pixel q ON q.image_id = p.image_id AND abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1""")
def sample_patches(spark, d):
    p = px(spark, d)
    places = tables.sample_windows(p.withColumn("v", (F.col("v") > 0.2).cast("int")), 1)
    return rounded(pixel.windows(p, places, 1), "v")


@query(f"""WITH {MOVIE}, {PIXEL}, m AS (SELECT movie, t, r, c, v FROM movie JOIN pixel USING (image_id)), n AS (SELECT movie, max(t) + 1 AS n FROM m GROUP BY 1)
SELECT movie, t, r, c FROM m JOIN n USING (movie) WHERE v > 0.2 AND t - 2 > 0 AND t + 2 < n AND r - 1 > 0 AND r + 1 < 8 AND c - 1 > 0 AND c + 1 < 8""")
def sample_volumes(spark, d):
    m = A.movie_table(spark, d).join(px(spark, d), "image_id").withColumn("v", (F.col("v") > 0.2).cast("int"))
    return tables.sample_volumes(m, 1, 2)


# ---- images at a model's size ------------------------------------------------------


@query(f"""WITH {PIXEL}, k AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS k),
w AS (SELECT k, CAST(unnest(range(8)) AS INTEGER) AS f, greatest(0, least(7, (k + 0.5::DOUBLE) * 8 / 10 - 0.5::DOUBLE)) AS place FROM k),
u AS (SELECT k, f, 1 - abs(place - f) AS weight FROM w WHERE 1 - abs(place - f) > 0)
SELECT image_id, a.k AS r, b.k AS c, round(sum(v * a.weight * b.weight), 6) + 0.0 AS v FROM pixel JOIN u a ON pixel.r = a.f JOIN u b ON pixel.c = b.f GROUP BY ALL""")
def to_resolution(spark, d):
    return rounded(pixel.to_resolution(px(spark, d), 0.65, 0.5), "v")


@query(f"""WITH {PIXEL}, p AS (SELECT CAST(unnest(range(11)) AS INTEGER) AS k), s AS (SELECT k, CASE WHEN k - 1 < 0 THEN 1 - k WHEN k - 1 > 7 THEN 15 - k ELSE k - 1 END AS f FROM p)
SELECT image_id, a.k AS r, b.c, round(v, 6) + 0.0 AS v FROM pixel b JOIN s a ON b.r = a.f""")
def pad_to_model(spark, d):
    return rounded(pixel.pad_to(px(spark, d), 11, 8), "v")


@query("SELECT vec_id AS image_id, 8 AS h, 8 AS w, 8 // 4 + 60 AS crop_h, 8 // 4 + 60 AS crop_w FROM embeddings")
def crop_shape(spark, d):
    return pixel.crop_shape(A.blocks(spark, d).select("image_id", "h", "w"))


@query("""WITH e AS (SELECT vec_id AS image_id, vec_id % 23 / 2.0::DOUBLE - 1 AS x, vec_id % 19 / 2.0::DOUBLE - 1 AS y, embedding FROM embeddings),
k AS (SELECT *, CAST(trunc(x + 0.5) AS INTEGER) AS c, CAST(trunc(y + 0.5) AS INTEGER) AS r FROM e)
SELECT image_id, printf('x=%.4f, y=%.4f', x, y) || CASE WHEN c BETWEEN 0 AND 7 AND r BETWEEN 0 AND 7 THEN printf(', z=%.2f', CAST(round(embedding[r * 8 + c + 1] * 100) / 100 AS DOUBLE) + 0.0) || '00' ELSE '' END AS shown FROM k""")
def coordinate_text(spark, d):
    e = A.blocks(spark, d).withColumns({"x": F.col("image_id") % 23 / 2.0 - 1, "y": F.col("image_id") % 19 / 2.0 - 1})
    row, col = pixel.at_pixel(F.col("y")), pixel.at_pixel(F.col("x"))
    e = e.withColumn("v", F.when(row.between(0, 7) & col.between(0, 7), F.round(F.get("px", row * 8 + col) * 100) / 100))
    return pixel.coordinate_text(e).select("image_id", "shown")


@query(f"SELECT vec_id AS image_id, round(0.9::DOUBLE + 0.2::DOUBLE * {draw('vec_id', 6)} / 2147483647, 6) AS zoom FROM embeddings")
def scale_targets(spark, d):
    k = F.col("image_id").cast("long")
    return A.blocks(spark, d).select("image_id", F.round(augment.drawn_zoom(k, 3, 0.1), 6).alias("zoom"))


#: Two channels of labels as images 2 i and 2 i + 1.
BOTH = f"""{MASK.replace('mask AS (', 'low AS (')},
mask AS (SELECT image_id * 2 AS image_id, r, c, label FROM low UNION ALL SELECT image_id * 2 + 1, r, c, CASE WHEN v > 0.1 THEN label ELSE 0 END FROM low JOIN pixel USING (image_id, r, c))"""


@query(f"""WITH RECURSIVE {OUTER.replace(MASK, BOTH)},
near AS (SELECT a.image_id, a.r, a.c, any_value(a.label) AS label, bool_or(b.label <> a.label) AS other FROM mask a JOIN mask b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY 1, 2, 3),
e AS (SELECT edt.*, component FROM edt LEFT JOIN comp USING (image_id, r, c)),
mid AS (SELECT image_id, component, sum(r * dist) / sum(dist) AS cr, sum(c * dist) / sum(dist) AS cc FROM e WHERE label <> 0 GROUP BY 1, 2),
inn AS (SELECT e.image_id, e.r, e.c, CASE WHEN label = 0 THEN 0 ELSE 1 / (1 + 0.1::DOUBLE * ((e.r - cr) * (e.r - cr) + (e.c - cc) * (e.c - cc))) END AS inner_ FROM e LEFT JOIN mid ON e.image_id = mid.image_id AND e.component = mid.component),
span AS (SELECT *, min(dist) OVER w - 1e-7 AS lo, max(dist) OVER w + 1e-7 AS hi FROM outer_ WINDOW w AS (PARTITION BY image_id)),
bins AS (SELECT *, CAST(ceil((dist - lo) / ((hi - lo) / 4)) - 1 AS INTEGER) AS bin FROM span),
plane AS (
    SELECT image_id, r, c, 'fgbg' AS target, unnest(['fg', 'bg']) AS plane, unnest([(label > 0)::DOUBLE, (label = 0)::DOUBLE]) AS value FROM mask
    UNION ALL SELECT image_id, r, c, 'pixelwise', unnest(['edge', 'interior', 'background']), unnest([(label > 0 AND other)::DOUBLE, (label > 0 AND NOT other)::DOUBLE, (label = 0)::DOUBLE]) FROM near
    UNION ALL SELECT image_id, r, c, 'outer-distance', 'dist', dist FROM outer_
    UNION ALL SELECT image_id, r, c, 'inner-distance', 'inner', inner_ FROM inn
    UNION ALL SELECT image_id, r, c, 'watershed', 'bin' || k, (bin = k)::DOUBLE FROM bins, range(4) x(k)
    UNION ALL SELECT image_id, r, c, 'disc', 'class' || k, (label = k)::DOUBLE FROM (SELECT *, max(label) OVER (PARTITION BY image_id) AS top FROM mask), range(5) x(k) WHERE k <= top)
SELECT image_id // 2 AS image_id, CAST(image_id % 2 AS INTEGER) AS channel, r, c, target, plane, round(value, 6) + 0.0 AS value FROM plane""")
def label_targets(spark, d):
    low = mask(spark, d).withColumn("channel", F.lit(0))
    high = mask(spark, d).join(px(spark, d), ["image_id", "r", "c"])
    high = high.select("image_id", "r", "c", F.when(F.col("v") > 0.1, F.col("label")).otherwise(0).alias("label"), F.lit(1).alias("channel"))
    return rounded(targets.label_targets(low.unionByName(high), ("fgbg", "pixelwise", "outer-distance", "inner-distance", "watershed", "disc")), "value")


@query(f"""WITH {MASK}, rich AS (SELECT image_id FROM mask GROUP BY 1 HAVING count(DISTINCT label) - 1 >= 3), k AS (SELECT *, {draw('image_id', 9)} % 3 AS r0, {draw('image_id', 10)} % 3 AS c0 FROM mask JOIN pixel USING (image_id, r, c) WHERE image_id IN (SELECT image_id FROM rich)),
x AS (SELECT image_id, r - r0 AS r, c - c0 AS c, v, label FROM k WHERE r >= r0 AND r < r0 + 6 AND c >= c0 AND c < c0 + 6)
SELECT image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-7), 5) + 0.0 AS v, CAST(label > 0 AS INTEGER) AS fg FROM x WINDOW w AS (PARTITION BY image_id)""")
def training_pairs(spark, d):
    out = targets.training_pairs(px(spark, d), mask(spark, d), least=3, crop=(6, 6), seed=9)
    return rounded(out.select("image_id", "r", "c", "v", "fg"), "v", digits=5)
