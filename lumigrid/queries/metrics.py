"""Trackings compared with what is true, and samples of movies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumigrid.operators import tables, trackmetrics, volumes
from lumigrid.plans import adapters as A
from lumigrid.queries.images import PIXEL, px, rounded
from lumigrid.queries.objects import LINEAGE, MOVIE, family
from lumigrid.sources import pictures

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- a tracking and the truth ------------------------------------------------------

#: A tracking with faults: cells lost, tracks that go on under another name, pairs exchanged.
FOUND = f"""{LINEAGE},
found AS (SELECT movie, CASE WHEN track % 9 = 4 AND t % 10 >= 5 THEN 1000000 + track WHEN track % 22 = 8 THEN track + 2 WHEN track % 22 = 10 THEN track - 2 ELSE track END AS track,
    t, x + ((track + t) % 3) * 0.01 AS x, y FROM cell WHERE (track * 31 + t * 7) % 11 <> 0),
ftrack AS (SELECT movie, track, min(t) AS first, max(t) AS last FROM found GROUP BY 1, 2),
fkin AS (SELECT a.movie, a.track, list_sort(list(b.track)) AS daughters FROM ftrack a JOIN ftrack b ON a.movie = b.movie AND b.track // 2 = a.track AND b.first > a.last GROUP BY 1, 2 HAVING count(*) = 2),
near AS (SELECT a.movie, a.t, a.track AS tr, b.track AS f, round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 9) AS apart FROM cell a JOIN found b ON a.movie = b.movie AND a.t = b.t
    WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.25),
node AS (SELECT movie, t, tr, f FROM (SELECT *, row_number() OVER (PARTITION BY movie, t, tr ORDER BY apart, tr, f) AS i, row_number() OVER (PARTITION BY movie, t, f ORDER BY apart, tr, f) AS j FROM near) WHERE i = 1 AND j = 1),
common AS (SELECT movie, tr, f, count(*) AS n FROM node GROUP BY ALL)"""
DIVISION = f"""{FOUND},
best AS (SELECT movie, tr, f FROM (SELECT *, row_number() OVER (PARTITION BY movie, tr ORDER BY n DESC, f) AS i FROM common) WHERE i = 1),
own AS (SELECT e.movie, e.track, count(*) AS n, list_sort(list(best.f) FILTER (best.f IS NOT NULL)) AS best FROM (SELECT movie, track, unnest(daughters) AS d FROM kin) e LEFT JOIN best ON best.movie = e.movie AND best.tr = e.d GROUP BY ALL),
ev AS (SELECT kin.*, last FROM kin JOIN track USING (movie, track)), fev AS (SELECT fkin.*, last FROM fkin JOIN ftrack USING (movie, track)),
met AS (SELECT DISTINCT ev.movie, ev.track AS tr, fev.track AS f, abs(ev.last - fev.last) AS apart, own.best IS NOT NULL AND own.best = fev.daughters AND len(own.best) = own.n AS ok
    FROM node JOIN ev ON ev.movie = node.movie AND ev.track = node.tr JOIN fev ON fev.movie = node.movie AND fev.track = node.f JOIN own ON own.movie = ev.movie AND own.track = ev.track
    WHERE abs(ev.last - fev.last) <= 2 AND node.t BETWEEN least(ev.last, fev.last) - 2 AND least(ev.last, fev.last)),
pair AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie, tr ORDER BY ok DESC, apart, tr, f) AS i, row_number() OVER (PARTITION BY movie, f ORDER BY ok DESC, apart, tr, f) AS j FROM met) WHERE i = 1 AND j = 1),
division AS (SELECT ev.movie, ev.track AS "true", pair.f AS found, CASE WHEN pair.f IS NULL THEN 'missed' WHEN ok THEN 'correct' ELSE 'mismatch' END AS kind FROM ev LEFT JOIN pair ON pair.movie = ev.movie AND pair.tr = ev.track
    UNION ALL SELECT fev.movie, NULL, fev.track, 'false' FROM fev LEFT JOIN pair ON pair.movie = fev.movie AND pair.f = fev.track WHERE pair.f IS NULL)"""
SCORED = f"""{DIVISION},
link AS (SELECT movie, track, t, n FROM (SELECT movie, track, t, lead(t) OVER (PARTITION BY movie, track ORDER BY t) AS n FROM cell) WHERE n IS NOT NULL),
flink AS (SELECT movie, track, t, n FROM (SELECT movie, track, t, lead(t) OVER (PARTITION BY movie, track ORDER BY t) AS n FROM found) WHERE n IS NOT NULL),
kept AS (SELECT m.movie, count(*) AS n FROM node m JOIN link a ON a.movie = m.movie AND a.track = m.tr AND a.t = m.t JOIN flink b ON b.movie = m.movie AND b.track = m.f AND b.t = m.t AND b.n = a.n
    JOIN node k ON k.movie = m.movie AND k.t = a.n AND k.tr = m.tr AND k.f = m.f GROUP BY 1),
score AS (SELECT movie, coalesce(c, 0) AS correct_division, coalesce(w, 0) AS mismatch_division, coalesce(fp, 0) AS false_positive_division, coalesce(fn, 0) AS false_negative_division, coalesce(c + w + fn, 0) AS total_divisions,
    coalesce(kept.n, 0) AS aa_tp, coalesce(aa, 0) AS aa_total, coalesce(te, 0) AS te_tp, total AS te_total
    FROM (SELECT movie, count(*) AS total FROM cell GROUP BY 1) LEFT JOIN kept USING (movie) LEFT JOIN (SELECT movie, count(*) AS aa FROM link GROUP BY 1) USING (movie)
    LEFT JOIN (SELECT movie, CAST(sum(n) AS BIGINT) AS te FROM (SELECT movie, tr, max(n) AS n FROM common GROUP BY 1, 2) GROUP BY 1) USING (movie)
    LEFT JOIN (SELECT movie, count(*) FILTER (kind = 'correct') AS c, count(*) FILTER (kind = 'mismatch') AS w, count(*) FILTER (kind = 'false') AS fp, count(*) FILTER (kind = 'missed') AS fn FROM division GROUP BY 1) USING (movie))"""


def tracking(spark, d):
    """Cells and lineage of the truth, of a tracking with faults, and the matched cells. The
    tables of cells are written once, as the metrics read them several times."""
    c = tables.checkpointed(family(spark, d))
    t, track = F.col("t"), F.col("track")
    name = F.when((track % 9 == 4) & (t % 10 >= 5), 1000000 + track).when(track % 22 == 8, track + 2).when(track % 22 == 10, track - 2).otherwise(track)
    kept = c.where((track * 31 + t * 7) % 11 != 0)
    found = tables.checkpointed(kept.select("movie", name.alias("track"), "t", (F.col("x") + ((track + t) % 3) * 0.01).alias("x"), "y"))
    return c, found, A.lineage_table(c), A.lineage_table(found), tables.checkpointed(trackmetrics.matched_by_distance(c, found, 0.5))


@query(f'WITH {FOUND} SELECT movie, t, tr AS "true", f AS found FROM node')
def matched_cells(spark, d):
    return tracking(spark, d)[4]


@query(f'WITH {DIVISION} SELECT movie, "true", found, kind FROM division')
def matched_divisions(spark, d):
    _, _, truth, found, nodes = tracking(spark, d)
    return trackmetrics.divisions(truth, found, nodes, tolerance=2)


@query(f"WITH {SCORED} SELECT * FROM score")
def tracking_counts(spark, d):
    return trackmetrics.counts(*tracking(spark, d), tolerance=2)


SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in trackmetrics.COUNTS)


@query(f"""WITH {SCORED}, s AS (SELECT split_part(movie, '/', 1) AS experiment, {SUMS} FROM score GROUP BY 1),
q AS (SELECT *, correct_division / nullif(total_divisions, 0) AS rec, correct_division / nullif(correct_division + false_positive_division, 0) AS prec FROM s)
SELECT experiment, {", ".join(trackmetrics.COUNTS)}, round(rec, 6) + 0.0 AS division_recall, round(prec, 6) + 0.0 AS division_precision, round(2 * rec * prec / nullif(rec + prec, 0), 6) + 0.0 AS division_f1,
    round(correct_division / nullif(correct_division + false_positive_division + false_negative_division, 0), 6) + 0.0 AS branching, round(false_negative_division / nullif(total_divisions, 0), 6) + 0.0 AS missed,
    round(aa_tp / nullif(aa_total, 0), 6) + 0.0 AS association_accuracy, round(te_tp / nullif(te_total, 0), 6) + 0.0 AS target_effectiveness FROM q""")
def tracking_summary(spark, d):
    c = trackmetrics.counts(*tracking(spark, d), tolerance=2).withColumn("experiment", F.substring_index("movie", "/", 1))
    return rounded(trackmetrics.summary(c, ["experiment"]), "division_recall", "division_precision", "division_f1", "branching", "missed", "association_accuracy", "target_effectiveness")


@query()
def tracking_identity(spark, d):
    truth, found, _, _, nodes = tracking(spark, d)
    return rounded(trackmetrics.identity(truth, found, nodes), "idp", "idr", "idf1")


# ---- samples of movies -------------------------------------------------------------


@query(f"""WITH {MOVIE}, {PIXEL}, m AS (SELECT movie, t, r, c, v FROM movie JOIN pixel USING (image_id)), n AS (SELECT movie, max(t) + 1 AS n FROM m GROUP BY 1),
p AS (SELECT movie, t, r, c FROM m JOIN n USING (movie) WHERE v > 0.2 AND t - 2 > 0 AND t + 2 < n AND r - 1 > 0 AND r + 1 < 8 AND c - 1 > 0 AND c + 1 < 8)
SELECT p.movie, p.t, p.r, p.c, count(*) AS n, round(sum(q.v * ((q.t - p.t + 2) * 9 + (q.r - p.r + 1) * 3 + q.c - p.c + 1)), 5) + 0.0 AS load FROM p JOIN m q ON q.movie = p.movie AND abs(q.t - p.t) <= 2 AND abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1 GROUP BY ALL""")
def movie_windows(spark, d):
    """Every sample's block of five frames of three by three, as the number of its pixels and a
    sum that tells where they are."""
    movies = A.movie_table(spark, d)
    marks = movies.join(px(spark, d), "image_id").withColumn("v", (F.col("v") > 0.2).cast("int"))
    frames = movies.join(A.blocks(spark, d), "image_id").select("movie", "t", "h", "w", "px")
    e = volumes.movie_windows(frames, tables.sample_volumes(marks, 1, 2), 1, 2)
    load = F.aggregate(F.transform("px", lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)
    return rounded(e.select("movie", "t", "r", "c", F.size("px").cast("long").alias("n"), load.alias("load")), "load", digits=5)


# ---- pictures ----------------------------------------------------------------------


@query(f"""WITH {PIXEL}, e AS (SELECT image_id, 2 * r + c // 4 AS k, c % 4 AS ch, v FROM pixel), g AS (SELECT image_id, k, arg_max(ch, v) AS best FROM e GROUP BY 1, 2),
s AS (SELECT image_id, k, best, min(best) OVER (PARTITION BY image_id) AS low, max(best) OVER (PARTITION BY image_id) AS high FROM g)
SELECT image_id, k // 4 AS r, k % 4 AS c, CAST(best AS INTEGER) AS channel, CAST(CASE WHEN high = low THEN 0 ELSE floor((best - low)::DOUBLE / (high - low) * 255) END AS INTEGER) AS grey FROM s""")
def channel_pictures(spark, d):
    """Images as four by four pixels of four channels: the greatest channel and its grey."""
    e = A.blocks(spark, d).withColumn("best", pictures.greatest_channel(F.col("px"), F.lit(4)))
    e = e.select("image_id", F.posexplode(F.arrays_zip("best", pictures.grey(F.col("best")).alias("grey"))).alias("k", "p"))
    return e.select("image_id", F.floor(F.col("k") / 4).cast("int").alias("r"), (F.col("k") % 4).cast("int").alias("c"), F.col("p.best").cast("int").alias("channel"), "p.grey")
