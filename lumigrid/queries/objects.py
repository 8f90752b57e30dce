"""Cells, lineages, draws, losses and text operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumigrid.functions import text
from lumigrid.operators import graph, losses, tables
from lumigrid.plans import adapters as A
from lumigrid.queries.images import PIXEL, rounded

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CELL = """cell AS (SELECT event_type AS movie, user_id AS track, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t,
    avg(value) AS x, avg(CAST(hour(ts) AS DOUBLE)) AS y, count(*) AS area FROM events GROUP BY 1, 2, 3)"""
#: Thirty days of an event type are a movie, and a user is another track in each ten days.
FAMILY = f"""{CELL.replace('cell AS', 'every AS')},
span AS (SELECT min(t) AS t0, max(track) + 1 AS w FROM every),
cell AS (SELECT concat(movie, '/', (t - t0) // 30) AS movie, track + w * CASE (t - t0) // 10 % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS track, t, x, y, area FROM every, span)"""
LINEAGE = f"""{FAMILY},
track AS (SELECT movie, track, min(t) AS first, max(t) AS last FROM cell GROUP BY 1, 2),
kin AS (SELECT a.movie, a.track, list_sort(list(b.track)) AS daughters FROM track a JOIN track b ON a.movie = b.movie AND b.track // 2 = a.track AND b.first > a.last GROUP BY 1, 2 HAVING count(*) = 2),
lineage AS (SELECT track.*, daughters FROM track LEFT JOIN kin USING (movie, track))"""
MOVIE = "movie AS (SELECT label AS movie, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, vec_id AS image_id FROM embeddings)"
SAME = "same AS (SELECT movie, t, track FROM (SELECT *, lead(t) OVER (PARTITION BY movie, track ORDER BY t) AS n FROM cell) WHERE n = t + 1)"


#: As tables.key_of(): 28 bits of the digest of the keys' text.
KEY = "('0x' || substr(md5({0}), 1, 7))::BIGINT"


def draw(key: str, seed: int) -> str:
    x = f"(({key} * 2654435761 + {seed * 40503 + 1}) % 4294967296)"
    return f"((({x} % 2147483647) * ({x} % 2147483629)) % 2147483647)"


def cells(spark, d):
    return A.cell_table(spark, d)


def family(spark, d):
    return A.generation_table(spark, d)


def photos(spark, d):
    return A.read(spark, d, "embeddings").select("vec_id", F.col("label").alias("class"))


# ---- draws, splits, filters --------------------------------------------------------


@query("SELECT vec_id, CASE WHEN i % 100 <= 20 THEN 'val' WHEN i % 100 <= 25 THEN 'test' ELSE 'train' END AS split FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings)")
def split_mod100(spark, d):
    return tables.split(photos(spark, d).select("vec_id"), ["vec_id"])


@query("SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings")
def batch_ids(spark, d):
    return tables.batches(photos(spark, d).select("vec_id"), ["vec_id"], 32)


@query("SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, count(*) OVER () AS n FROM embeddings) WHERE i <= n - n % 48")
def trim_to_batches(spark, d):
    return tables.trim_to_batches(photos(spark, d).select("vec_id"), ["vec_id"], 48)


@query(f"SELECT vec_id, row_number() OVER (ORDER BY {draw('vec_id', 7)}, vec_id) - 1 AS place FROM embeddings")
def seeded_shuffle(spark, d):
    return tables.shuffled(photos(spark, d).select("vec_id"), "vec_id", 7)


@query(f"""WITH b AS (SELECT vec_id, label AS class, vec_id % 4 AS batch FROM embeddings), k AS (SELECT batch, min(n) AS k FROM (SELECT batch, class, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, class, batch FROM (SELECT *, row_number() OVER (PARTITION BY batch, class ORDER BY {draw('vec_id', 3)}, vec_id) AS i FROM b) JOIN k USING (batch) WHERE i <= k""")
def class_balance(spark, d):
    e = photos(spark, d).withColumn("batch", F.col("vec_id") % 4)
    return tables.class_balance(e, "batch", "class", "vec_id", 3)


@query("SELECT l_suppkey % 10 AS batch, l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1, 2")
def class_counts(spark, d):
    e = A.read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("batch"), F.col("l_returnflag").alias("class"))
    return tables.class_counts(e, "batch", "class")


@query(f"WITH {PIXEL} SELECT image_id, r, c FROM pixel WHERE v > 0.1 AND r - 2 > 0 AND r + 2 < 8 AND c - 2 > 0 AND c + 2 < 8")
def sample_windows(spark, d):
    p = A.pixel_table(spark, d)
    return tables.sample_windows(p.withColumn("v", (F.col("v") > 0.1).cast("int")), 2).select("image_id", "r", "c")


@query(f"WITH {PIXEL} SELECT image_id, r, c FROM pixel WHERE v > 0.1 ORDER BY {draw('(image_id * 1000003 + r * 1009 + c)', 5)}, image_id, r, c LIMIT 300")
def sample_windows_most(spark, d):
    p = A.pixel_table(spark, d)
    return tables.sample_windows(p.withColumn("v", (F.col("v") > 0.1).cast("int")), 2, "same", 300, 5).select("image_id", "r", "c")


@query(f"WITH {PIXEL} SELECT image_id, count(*) FILTER (v > 0.1 AND r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6) AS n FROM pixel GROUP BY 1")
def max_sample_counts(spark, d):
    from lumigrid.operators import pixel

    return pixel.trim(A.pixel_table(spark, d), 1, 1).groupBy("image_id").agg(F.count_if(F.col("v") > 0.1).alias("n"))


@query(f"""WITH {MOVIE}, s AS (SELECT movie, {draw(KEY.format('CAST(movie AS VARCHAR)'), 11)} % greatest(max(t) + 2 - 8, 1) AS s FROM movie GROUP BY 1)
SELECT movie, t - s AS t, image_id FROM movie JOIN s USING (movie) WHERE t >= s AND t < s + 8""")
def temporal_slice(spark, d):
    return tables.temporal_slice(A.movie_table(spark, d), 8, 11)


@query(f"""WITH {CELL}, f AS (SELECT movie, track, list_sort(list(t)) AS f FROM cell GROUP BY 1, 2)
SELECT movie, track, CASE WHEN len(f) >= 4 THEN f[-4:] ELSE list_concat(list_transform(range(4 - len(f)), lambda x: f[1]), f) END AS frames FROM f""")
def fetch_frames(spark, d):
    tracks = cells(spark, d).groupBy("movie", "track").agg(F.sort_array(F.collect_list("t")).alias("frames"))
    return tables.fetch_frames(tracks, 4)


@query(f"WITH {CELL} SELECT movie, track, t FROM cell WHERE (movie, track) IN (SELECT (movie, track) FROM cell GROUP BY movie, track HAVING count(DISTINCT t) > 10)")
def short_track_filter(spark, d):
    return tables.long_tracks(cells(spark, d), 10).select("movie", "track", "t")


@query(f"""WITH {LINEAGE}, n AS (SELECT movie, track, count(DISTINCT t) AS n FROM cell GROUP BY 1, 2), each AS (SELECT movie, track, unnest(daughters) AS k FROM lineage),
w AS (SELECT each.movie, each.track, bool_and(n.n > 3) AS w FROM each JOIN n ON n.movie = each.movie AND n.track = each.k GROUP BY 1, 2)
SELECT movie, track, first, last, CASE WHEN w THEN daughters END AS daughters FROM lineage LEFT JOIN w USING (movie, track)""")
def daughters_all_present(spark, d):
    c = family(spark, d)
    return tables.whole_families(A.lineage_table(c), c)


@query(f"WITH {LINEAGE} SELECT movie, track, first, last, daughters FROM lineage")
def lineages(spark, d):
    return A.lineage_table(family(spark, d))


@query(f"""WITH {LINEAGE}, late AS (SELECT movie, track, first, last + CASE WHEN track % 7 = 0 THEN 12 ELSE 0 END AS last, daughters FROM lineage)
SELECT DISTINCT movie FROM (SELECT movie, last, unnest(daughters) AS k FROM late) e JOIN track t USING (movie) WHERE t.track = k AND t.first <= e.last""")
def invalid_lineages(spark, d):
    c = family(spark, d)
    late = A.lineage_table(c).withColumn("last", F.col("last") + F.when(F.col("track") % 7 == 0, 12).otherwise(0))
    return tables.invalid_lineages(late, c)


@query(f"SELECT vec_id, CASE WHEN {draw('vec_id', 13)} % 1000 < 200 THEN 'test' ELSE 'train' END AS split FROM embeddings")
def random_split(spark, d):
    return tables.random_split(photos(spark, d).select("vec_id"), "vec_id", seed=13)


@query(f"""WITH {LINEAGE}, n AS (SELECT movie, track, row_number() OVER (PARTITION BY movie ORDER BY track) AS k FROM lineage),
x AS (SELECT e.movie, e.track, list_sort(list(n.k)) AS daughters FROM (SELECT movie, track, unnest(daughters) AS c FROM lineage) e JOIN n ON n.movie = e.movie AND n.track = e.c GROUP BY 1, 2)
SELECT lineage.movie, k AS track, first, last, x.daughters FROM lineage JOIN n USING (movie, track) LEFT JOIN x USING (movie, track)""")
def sequential_lineage(spark, d):
    c = family(spark, d)
    return tables.sequential_tracks(c, A.lineage_table(c))[1]


# ---- aggregates --------------------------------------------------------------------


@query(f"""WITH {PIXEL}, b AS (SELECT image_id, 1 + (r // 4) * 2 + c // 4 AS label, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM pixel WHERE v > 0.05 GROUP BY 1, 2)
SELECT round(avg(h)) AS mean_r, round(median(h)) AS median_r, round(avg(w)) AS mean_c, round(median(w)) AS median_c FROM b""")
def cell_extents(spark, d):
    return tables.extents(A.mask_table(spark, d), ("r", "c"))


@query(f"""WITH {LINEAGE}, s AS (SELECT movie, count(DISTINCT t) AS frames, count(*) AS cells FROM cell GROUP BY 1), k AS (SELECT movie, count(*) AS tracks, count(daughters) AS divisions FROM lineage GROUP BY 1)
SELECT movie, frames, cells, tracks, divisions, round(cells / tracks, 6) AS mean_frames FROM s JOIN k USING (movie)""")
def track_stats(spark, d):
    c = family(spark, d)
    return rounded(tables.track_stats(c, A.lineage_table(c)), "mean_frames")



@query("SELECT class, round(1.0::DOUBLE / (SELECT count(DISTINCT label) FROM embeddings) * (SELECT count(*) FROM embeddings) / (n + 1), 6) AS weight FROM (SELECT label AS class, count(*) AS n FROM embeddings GROUP BY 1)")
def class_weights(spark, d):
    return rounded(tables.class_weights(photos(spark, d), "class"), "weight")


SCORE = f"""{PIXEL}, score AS (SELECT image_id, r AS class, v, exp(v) / sum(exp(v)) OVER (PARTITION BY image_id, c) AS p, c FROM pixel)"""


def scores(spark, d):
    """Eight samples of an image, one for each column, scored over eight classes."""
    p = A.pixel_table(spark, d).select("image_id", F.col("r").alias("class"), "c", "v")
    return losses.softmax(p, ["image_id", "c"])


@query(f"WITH {SCORE}, s AS (SELECT image_id, class, round(sum(p), 9) AS s FROM score GROUP BY 1, 2) SELECT image_id, class FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, class) AS i FROM s) WHERE i = 1")
def vote_argmax(spark, d):
    return tables.vote(scores(spark, d), ["image_id"])


@query(f"WITH {PIXEL}, m AS (SELECT image_id, avg(1 + v / 10) AS m FROM pixel GROUP BY 1) SELECT image_id, round(CASE WHEN abs(m - 1) < 0.01 THEN 1 ELSE m END, 6) AS scale FROM m")
def scale_mean_snap(spark, d):
    e = A.pixel_table(spark, d).select("image_id", (1 + F.col("v") / 10).alias("scale"))
    return rounded(tables.mean_scale(e, ["image_id"]), "scale")


@query('SELECT quality AS "true", toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2')
def confusion_matrix(spark, d):
    return tables.confusion(A.read(spark, d, "labels"), "quality", "toxic")


@query("SELECT event_type AS experiment, user_id % 3 AS part, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def metrics_rollup(spark, d):
    e = A.read(spark, d, "events").select(F.col("event_type").alias("experiment"), (F.col("user_id") % 3).alias("part"), "value")
    return rounded(e.rollup("experiment", "part").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query(f"WITH {CELL} SELECT movie, track, min(t) AS first, max(t) AS last FROM cell GROUP BY 1, 2")
def track_length(spark, d):
    return cells(spark, d).groupBy("movie", "track").agg(F.min("t").alias("first"), F.max("t").alias("last"))


@query(f"WITH {CELL}, n AS (SELECT movie, count(DISTINCT track) AS n FROM cell GROUP BY 1) SELECT max(n) AS most FROM n")
def max_cells(spark, d):
    return cells(spark, d).groupBy("movie").agg(F.count_distinct("track").alias("n")).agg(F.max("n").alias("most"))


@query(f"WITH {CELL}, n AS (SELECT movie, t, count(*) AS n FROM cell GROUP BY 1, 2) SELECT movie, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs FROM n GROUP BY 1")
def count_pairs(spark, d):
    n = cells(spark, d).groupBy("movie", "t").agg(F.count("*").alias("n"))
    return n.groupBy("movie").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))


@query("SELECT event_type, round(avg(value / 8), 6) AS mean, round(stddev_pop(value / 8), 6) AS std FROM events GROUP BY 1")
def batch_timing(spark, d):
    e = A.read(spark, d, "events").withColumn("s", F.col("value") / 8)
    return rounded(e.groupBy("event_type").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std")), "mean", "std")


# ---- graphs ------------------------------------------------------------------------

ADJ = f"""{CELL}, adj AS (SELECT a.movie, a.t, a.track AS i, b.track AS j FROM cell a JOIN cell b ON a.movie = b.movie AND a.t = b.t AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 4)"""
NADJ = f"""{ADJ}, n AS (SELECT movie, t, i, j, 1 / sqrt(CAST(count(*) OVER (PARTITION BY movie, t, i) * count(*) OVER (PARTITION BY movie, t, j) AS DOUBLE)) AS weight FROM adj)"""


@query(f"WITH {ADJ} SELECT movie, t, i, j FROM adj")
def adjacency(spark, d):
    return graph.adjacency(cells(spark, d), 4.0)


@query(f"WITH {NADJ} SELECT movie, t, i, j, round(weight, 6) AS weight FROM n")
def normalized_adjacency(spark, d):
    return rounded(graph.normalized_adjacency(cells(spark, d), 4.0), "weight")


@query(f"WITH {NADJ} SELECT n.movie, n.t, n.i AS track, round(sum(weight * x), 5) AS x FROM n JOIN cell c ON c.movie = n.movie AND c.t = n.t AND c.track = n.j GROUP BY 1, 2, 3")
def graph_conv_sum(spark, d):
    return rounded(graph.neighbour_sums(cells(spark, d), 4.0, "x"), "x", digits=5)


@query(f"WITH {CELL}, {SAME} SELECT movie, t, track FROM same")
def temporal_same(spark, d):
    return graph.same_edges(cells(spark, d))


DAUGHTER = f"""{LINEAGE}, birth AS (SELECT movie, last AS t, track, daughter FROM (SELECT movie, last, track, unnest(daughters) AS daughter FROM lineage) JOIN (SELECT movie, max(last) AS fin FROM lineage GROUP BY 1) USING (movie) WHERE last < fin)"""


@query(f"WITH {DAUGHTER} SELECT movie, t, track, daughter FROM birth")
def temporal_daughter(spark, d):
    return graph.daughter_edges(A.lineage_table(family(spark, d)))


@query(f"""WITH {DAUGHTER} SELECT a.movie, a.t, count(*) FILTER (a.track <> b.track AND k.track IS NULL) AS different FROM cell a JOIN cell b ON a.movie = b.movie AND b.t = a.t + 1
LEFT JOIN birth k ON k.movie = a.movie AND k.t = a.t AND k.track = a.track AND k.daughter = b.track GROUP BY 1, 2""")
def temporal_different(spark, d):
    c = family(spark, d)
    return graph.different_counts(c, A.lineage_table(c))


@query(f"WITH {CELL} SELECT a.movie, a.t, a.track, coalesce(list_sort(list(b.track) FILTER (b.track <> a.track)), []) AS different FROM cell a JOIN cell b USING (movie, t) GROUP BY 1, 2, 3")
def different_cells(spark, d):
    return graph.others(cells(spark, d))


@query(f"WITH {CELL}, ask AS (SELECT movie, track, min(t) + 3 AS t FROM cell GROUP BY 1, 2) SELECT ask.movie, ask.track, ask.t, min(cell.t) AS next FROM ask LEFT JOIN cell ON cell.movie = ask.movie AND cell.track = ask.track AND cell.t > ask.t GROUP BY 1, 2, 3")
def next_frame_asof(spark, d):
    c = cells(spark, d)
    return graph.next_frame(c, c.groupBy("movie", "track").agg((F.min("t") + 3).alias("t")))


@query(f"WITH {LINEAGE} SELECT e.movie, e.track, e.daughter, t.first AS born FROM (SELECT movie, track, unnest(daughters) AS daughter FROM lineage) e JOIN track t ON t.movie = e.movie AND t.track = e.daughter")
def daughter_first_frame(spark, d):
    return graph.daughter_first_frames(A.lineage_table(family(spark, d)))


@query(f"WITH {CELL} SELECT movie, track, t, round(coalesce(x - lag(x) OVER w, 0), 6) + 0.0 AS dx, round(coalesce(y - lag(y) OVER w, 0), 6) + 0.0 AS dy FROM cell WINDOW w AS (PARTITION BY movie, track ORDER BY t)")
def centroid_deltas(spark, d):
    return rounded(graph.deltas(cells(spark, d)).select("movie", "track", "t", "dx", "dy"), "dx", "dy")


@query(f"WITH {CELL} SELECT a.movie, a.t, a.track AS i, b.track AS j, round(b.x - a.x, 6) + 0.0 AS dx, round(b.y - a.y, 6) + 0.0 AS dy FROM cell a JOIN cell b ON a.movie = b.movie AND b.t = a.t + 1")
def pairwise_deltas(spark, d):
    return rounded(graph.pairs(cells(spark, d)), "dx", "dy")


@query(f"""WITH {CELL}, g AS (SELECT movie, track, t, t - row_number() OVER (PARTITION BY movie, track ORDER BY t) AS g FROM cell) SELECT movie, track, min(t) AS first, max(t) AS last, count(*) AS frames FROM g GROUP BY movie, track, g""")
def track_runs(spark, d):
    return graph.track_runs(cells(spark, d))


@query(f"WITH {CELL} SELECT movie, track, t, round(x * cos(radians(30)) + y * sin(radians(30)), 6) + 0.0 AS x, round(y * cos(radians(30)) - x * sin(radians(30)), 6) + 0.0 AS y FROM cell")
def rotate_centroids(spark, d):
    return rounded(graph.rotate(cells(spark, d), 30.0).select("movie", "track", "t", "x", "y"), "x", "y")


@query(f"WITH {CELL} SELECT movie, track, t, round(x + 2.5, 6) AS x, round(y - 1.25, 6) + 0.0 AS y FROM cell")
def translate_centroids(spark, d):
    return rounded(graph.translate(cells(spark, d), 2.5, -1.25).select("movie", "track", "t", "x", "y"), "x", "y")


@query(f"WITH {CELL} SELECT movie, track, t, 0 AS batch FROM cell WHERE track % 2 = 0 UNION ALL SELECT movie, track, t, 1 AS batch FROM cell WHERE track % 2 = 1")
def concat_tracks(spark, d):
    c = cells(spark, d).select("movie", "track", "t")
    return graph.concat_tracks(c.where("track % 2 = 0"), c.where("track % 2 = 1"))


# ---- losses ------------------------------------------------------------------------

TRUTH = f"""{SCORE}, y AS (SELECT s.image_id, s.class, s.c, s.p, CAST(s.class = e.label % 8 AS DOUBLE) AS y FROM score s JOIN embeddings e ON e.vec_id = s.image_id)"""
CLIP = "greatest(1e-7, least(1 - 1e-7, {}))"
WEIGHT = f"{TRUTH}, w AS (SELECT class, 1.0::DOUBLE / 8 * (SELECT sum(y) FROM y) / (sum(y) + 1) AS weight FROM y GROUP BY 1)"


def truth(spark, d):
    e = A.read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("label") % 8).alias("_l"))
    return scores(spark, d).join(e, "image_id").withColumn("y", (F.col("class") == F.col("_l")).cast("double")).drop("_l", "v")


BY = ["image_id", "c"]


@query(f"WITH {TRUTH} SELECT image_id, c, round(-sum(y * ln({CLIP.format('p')})), 6) + 0.0 AS loss FROM y GROUP BY 1, 2")
def cce(spark, d):
    return rounded(losses.cross_entropy(truth(spark, d), BY), "loss")


@query(f"WITH {WEIGHT} SELECT image_id, c, round(-sum(y * ln({CLIP.format('p')}) * weight), 6) + 0.0 AS loss FROM y JOIN w USING (class) GROUP BY 1, 2")
def weighted_cce(spark, d):
    return rounded(losses.weighted_cross_entropy(truth(spark, d), BY, 8), "loss")


@query(f"WITH {TRUTH} SELECT image_id, c, round(-sum(y * ln({CLIP.format('y * p')})), 6) + 0.0 AS loss FROM y GROUP BY 1, 2")
def sample_cce(spark, d):
    return rounded(losses.sample_cross_entropy(truth(spark, d), BY), "loss")


@query(f"WITH {WEIGHT} SELECT image_id, c, round(-sum(weight * pow(1 - {CLIP.format('p')}, 2) * y * ln({CLIP.format('p')})), 6) + 0.0 AS loss FROM y JOIN w USING (class) GROUP BY 1, 2")
def weighted_focal(spark, d):
    return rounded(losses.weighted_focal(truth(spark, d), BY, 8), "loss")


@query(f"WITH {TRUTH} SELECT image_id, round(-(2 * sum(y * p) + 1) / (sum(y) + sum(p) + 1), 6) AS loss FROM y GROUP BY 1")
def dice_loss(spark, d):
    return rounded(losses.dice(truth(spark, d), ["image_id"]), "loss")


@query(f"WITH {TRUTH} SELECT image_id, class, c, round(CASE WHEN abs(y - p) < 1.0::DOUBLE / 9 THEN 4.5::DOUBLE * (y - p) * (y - p) ELSE abs(y - p) - 0.5::DOUBLE / 9 END, 6) AS loss FROM y")
def smooth_l1(spark, d):
    e = truth(spark, d)
    return rounded(e.select("image_id", "class", "c", losses.smooth_l1(F.col("y"), F.col("p")).alias("loss")), "loss")


@query(f"WITH {TRUTH}, q AS (SELECT *, {CLIP.format('p')} AS q FROM y) SELECT image_id, class, c, round(CASE WHEN y = 1 THEN 0.25 * pow(1 - q, 2) * -ln(q) ELSE 0.75 * pow(q, 2) * -ln(1 - q) END, 6) + 0.0 AS loss FROM q")
def focal(spark, d):
    e = truth(spark, d)
    return rounded(e.select("image_id", "class", "c", losses.focal(F.col("y"), F.col("p")).alias("loss")), "loss")


@query("""WITH v AS (SELECT vec_id % 5 AS image_id, label AS instance, vec_id AS point, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
m AS (SELECT image_id, instance, dim, avg(v) AS m FROM v GROUP BY 1, 2, 3),
g AS (SELECT v.image_id, v.instance, point, sqrt(1e-7 + sum(pow(v - m, 2))) AS d FROM v JOIN m USING (image_id, instance, dim) GROUP BY 1, 2, 3),
pull AS (SELECT image_id, avg(s) AS pull FROM (SELECT image_id, instance, avg(pow(greatest(d - 0.5, 0), 2)) AS s FROM g GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT a.image_id, a.instance, b.instance AS j, sqrt(1e-7 + sum(pow(a.m - b.m, 2))) AS d FROM m a JOIN m b ON a.image_id = b.image_id AND a.dim = b.dim AND a.instance <> b.instance GROUP BY 1, 2, 3),
n AS (SELECT image_id, count(*) AS n, avg(l) AS l FROM (SELECT image_id, instance, sqrt(1e-7 + sum(pow(m, 2))) AS l FROM m GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT image_id, sum(pow(greatest(3 - d, 0), 2)) AS h FROM p GROUP BY 1)
SELECT image_id, round(pull + coalesce(h, 0) / (n * n) + 0.001::DOUBLE * l, 6) AS loss FROM pull JOIN n USING (image_id) LEFT JOIN h USING (image_id)""")
def discriminative(spark, d):
    e = A.read(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("image_id"), F.col("label").alias("instance"), F.col("vec_id").alias("point"), F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v"))
    return rounded(losses.discriminative(e, ["image_id"]), "loss")


DENSE = [[(k + 1) * (j + 1) / 100 - 0.3 for j in range(3)] for k in range(8)]


@query("SELECT image_id, c, j, round(sum(v * ((r + 1) * (j + 1) / 100 - 0.3::DOUBLE)) + j / 10, 6) + 0.0 AS z FROM (SELECT *, unnest(range(3)) AS j FROM pixel) GROUP BY 1, 2, 3".replace("SELECT image_id, c, j, round", f"WITH {PIXEL} SELECT image_id, c, j, round"))
def tensor_product(spark, d):
    e = A.pixel_table(spark, d).groupBy("image_id", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("x"))
    z = e.select("image_id", "c", F.posexplode(losses.tensor_product(F.col("x"), DENSE, [0.0, 0.1, 0.2])).alias("j", "z"))
    return rounded(z.withColumn("j", F.col("j").cast("long")), "z")


# ---- text --------------------------------------------------------------------------


@query("SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '^(\\D*)', 1), CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER)) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(spark, d):
    e = A.read(spark, d, "part").select("p_brand").distinct().withColumn("_k", text.natural_key(F.col("p_brand")))
    return tables.number(e, ["_k"], "place").select("p_brand", (F.col("place") + 1).alias("place"))


@query("SELECT k, row_number() OVER (ORDER BY CAST(substr(k, 2) AS INTEGER)) AS place FROM (SELECT DISTINCT 'C' || p_size AS k FROM part)")
def key_sort(spark, d):
    e = A.read(spark, d, "part").select(F.concat(F.lit("C"), F.col("p_size")).alias("k")).distinct().withColumn("_k", text.number_after_first(F.col("k")))
    return tables.number(e, ["_k"], "place").select("k", (F.col("place") + 1).alias("place"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 ELSE 1073741824 END AS n_bytes FROM part")
def size_strings(spark, d):
    unit = F.when(F.col("p_partkey") % 3 == 0, "KB").when(F.col("p_partkey") % 3 == 1, "MB").otherwise("GB")
    return A.read(spark, d, "part").select("p_partkey", text.size_in_bytes(F.concat_ws(" ", "p_size", unit)).alias("n_bytes"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS units, CAST(p_partkey % 4 AS VARCHAR) AS heads FROM part")
def layer_grammar(spark, d):
    made = F.concat(F.lit("gat-units:"), F.col("p_size"), F.lit("-heads:"), F.col("p_partkey") % 4)
    e = A.read(spark, d, "part").select("p_partkey", text.layer_options(made).alias("o"))
    return e.select("p_partkey", F.col("o")["units"].alias("units"), F.col("o")["heads"].alias("heads"))


@query(f"WITH {MOVIE} SELECT image_id, 'feature_' || (movie % 3) || '_frame_' || lpad(CAST(t AS VARCHAR), 4, '0') || '.tif' AS name FROM movie")
def output_names(spark, d):
    return A.movie_table(spark, d).select("image_id", text.feature_file(F.lit("feature"), F.col("movie") % 3, F.col("t"), 4).alias("name"))


@query("SELECT DISTINCT p_size AS epoch, round(0.01::DOUBLE * pow(0.99::DOUBLE, p_size), 9) AS rate FROM part")
def learning_rates(spark, d):
    e = A.read(spark, d, "part").select(F.col("p_size").alias("epoch")).distinct()
    return e.withColumn("rate", F.round(text.decayed(0.01, 0.99, F.col("epoch")), 9))


@query(f"WITH {PIXEL} SELECT image_id, r, c, 'whole-cell' AS compartment, CAST(v > 0.05 AS INTEGER) AS label FROM pixel UNION ALL SELECT image_id, r, c, 'nuclear', CAST(v > 0.15 AS INTEGER) FROM pixel")
def compartment_union(spark, d):
    p = A.pixel_table(spark, d)
    part = lambda name, above: p.select("image_id", "r", "c", F.lit(name).alias("compartment"), (F.col("v") > above).cast("int").alias("label"))
    return part("whole-cell", 0.05).unionByName(part("nuclear", 0.15))


@query(f"WITH {MOVIE}, {PIXEL} SELECT movie, t, r, c, round(v, 6) + 0.0 AS v, round(n, 6) + 0.0 AS later FROM (SELECT movie, t, r, c, v, lead(v) OVER (PARTITION BY movie, r, c ORDER BY t) AS n FROM movie JOIN pixel USING (image_id)) WHERE n IS NOT NULL")
def future_values(spark, d):
    e = A.movie_table(spark, d).join(A.pixel_table(spark, d), "image_id")
    later = F.lead("v").over(Window.partitionBy("movie", "r", "c").orderBy("t"))
    return rounded(e.withColumn("later", later).where("later is not null").select("movie", "t", "r", "c", "v", "later"), "v", "later")
