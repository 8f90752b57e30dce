"""How well a tracking tells the truth: cells matched frame by frame, then links, tracks and
divisions.

Truth and tracking are cell tables (movie, track, t) with lineages (movie, track, last,
daughters). Their cells are matched first, one to one in each frame, by overlap or by
distance; all that follows is joins and counts by movie and track, so no movie is a group.
Counts are summed over movies before ratios are taken, so long movies weigh more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.operators import cluster
from lumigrid.operators.tables import checkpointed, draw, key_of, overlaps

FRAME = ["movie", "t"]
#: What counts() tells of a movie.
COUNTS = ("correct_division", "mismatch_division", "false_positive_division", "false_negative_division", "total_divisions", "aa_tp", "aa_total", "te_tp", "te_total")


def mutual(pairs: DataFrame, by: list[str], order: list[Column], one: str = "true", two: str = "found") -> DataFrame:
    """The pairs that come first for both of their ends: no end is in two of them."""
    first = lambda end: F.row_number().over(Window.partitionBy(*by, end).orderBy(*order, one, two))
    return pairs.withColumns({"_a": first(one), "_b": first(two)}).where("_a = 1 AND _b = 1").drop("_a", "_b")


def matched_by_overlap(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """movie, t, true, found: instances of two masks (movie, t, r, c, label) that overlap by
    more than `least` and are each other's best. From 0.5 on these are all such pairs."""
    pairs = overlaps(truth, found, FRAME).where(F.col("iou") > least).withColumnRenamed("predicted", "found")
    return mutual(pairs, FRAME, [F.desc("iou")]).select(*FRAME, "true", "found")


def matched_by_distance(truth: DataFrame, found: DataFrame, far: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """movie, t, true, found: cells of two tables at most `far` apart that are each other's
    nearest (to nine digits of the squared distance). Cells without a place have no match."""
    put = lambda cells: cells.select(*FRAME, "track", *axes).dropna(subset=list(axes))
    pairs = cluster.within(put(truth), put(found), far, FRAME, axes)
    apart = F.round(sum((F.pow(F.col(a) - F.col(f"p_{a}"), 2) for a in axes), F.lit(0.0)), 9)
    pairs = pairs.select(*FRAME, F.col("track").alias("true"), F.col("p_track").alias("found"), apart.alias("apart"))
    return mutual(pairs, FRAME, [F.col("apart")]).select(*FRAME, "true", "found")


def common_frames(nodes: DataFrame) -> DataFrame:
    """movie, true, found, common: the frames in which two tracks' cells are matched."""
    return nodes.groupBy("movie", "true", "found").agg(F.count("*").alias("common"))


def links(cells: DataFrame) -> DataFrame:
    """movie, track, t, next: each cell's next frame in its track."""
    own = Window.partitionBy("movie", "track").orderBy("t")
    return cells.select("movie", "track", "t", F.lead("t").over(own).alias("next")).dropna(subset=["next"])


def kept_links(truth: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The true links (movie, true, found, t, next) whose two cells are matched with
    neighbours in one found track."""
    a = links(truth).withColumnRenamed("track", "true")
    b = links(found).withColumnRenamed("track", "found")
    both = nodes.join(a, ["movie", "t", "true"]).join(b, ["movie", "t", "found", "next"])
    return both.join(nodes.withColumnRenamed("t", "next"), ["movie", "next", "true", "found"]).select("movie", "true", "found", "t", "next")


def matched_tracks(nodes: DataFrame) -> DataFrame:
    """movie, true, found, common: whole tracks, one to one. Pairs of most common frames
    come first (equal ones in an order drawn from their names), and of the rest those whose
    tracks are both still free. That is what taking pairs one by one gives; here a round
    takes all pairs that are first for both tracks. The best pair of all is always one, and
    as equal ones are drawn, rounds are about as many as frames at the very most."""
    keyed = common_frames(nodes).withColumn("_d", draw(key_of(F.col("movie"), F.col("true"), F.col("found")), 3))
    rest, rounds = checkpointed(keyed), []
    while not rest.isEmpty():
        taken = checkpointed(mutual(rest, ["movie"], [F.desc("common"), F.col("_d")]))
        rounds.append(taken)
        free = rest.join(taken.select("movie", "true"), ["movie", "true"], "left_anti").join(taken.select("movie", "found"), ["movie", "found"], "left_anti")
        rest = checkpointed(free)
    out = rest
    for taken in rounds:
        out = out.unionByName(taken)
    return out.select("movie", "true", "found", "common")


def identity(truth: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """By movie: idtp (matched cells of matched tracks), n_true, n_found, and the ratios idp,
    idr and idf1 of them."""
    count = lambda cells, name: cells.groupBy("movie").agg(F.count("*").alias(name))
    right = matched_tracks(nodes).groupBy("movie").agg(F.sum("common").alias("idtp"))
    e = count(truth, "n_true").join(count(found, "n_found"), "movie", "full").join(right, "movie", "left").na.fill(0, ["n_true", "n_found", "idtp"])
    return e.withColumns({"idp": _share("idtp", "n_found"), "idr": _share("idtp", "n_true"), "idf1": F.try_divide(2.0 * F.col("idtp"), F.col("n_true") + F.col("n_found"))})


def _events(lineage: DataFrame, name: str) -> DataFrame:
    """Tracks that divide, by the last frame of the parent."""
    return lineage.where(F.size("daughters") > 0).select("movie", F.col("track").alias(name), F.col("last").alias(f"{name}_last"), F.array_sort("daughters").alias(f"{name}_daughters"))


def divisions(truth: DataFrame, found: DataFrame, nodes: DataFrame, tolerance: int = 1) -> DataFrame:
    """Divisions of two lineages: movie, true, found (parents; null without a partner), kind.

    Two divisions can be partners if their parents' last frames are at most `tolerance`
    apart and the parents are matched in one of the `tolerance` + 1 frames up to the earlier
    of these. Of several, partners are those that are first for each other: right ones,
    then near ones. A pair is "correct" if the found tracks that the true daughters share
    most frames with are exactly the found daughters, else "mismatch". What has no partner
    is "missed" or "false"."""
    e, f = _events(truth, "true"), _events(found, "found")
    before = F.least("true_last", "found_last")
    met = nodes.join(e.drop("true_daughters"), ["movie", "true"]).join(f.drop("found_daughters"), ["movie", "found"])
    met = met.where((F.abs(F.col("true_last") - F.col("found_last")) <= tolerance) & (F.col("t") <= before) & (F.col("t") >= before - tolerance))
    met = met.select("movie", "true", "found", F.abs(F.col("true_last") - F.col("found_last")).alias("apart")).distinct()
    best = common_frames(nodes).groupBy("movie", F.col("true").alias("_d")).agg(F.min_by("found", F.struct(-F.col("common"), "found")).alias("_best"))
    own = e.select("movie", "true", F.explode("true_daughters").alias("_d")).join(best, ["movie", "_d"], "left")
    told = own.groupBy("movie", "true").agg(F.array_sort(F.collect_list("_best")).alias("_best"), F.count("*").alias("_n"))
    pairs = met.join(told, ["movie", "true"]).join(f.select("movie", "found", "found_daughters"), ["movie", "found"])
    pairs = pairs.withColumn("right", (F.size("_best") == F.col("_n")) & (F.col("_best") == F.col("found_daughters")))
    pairs = mutual(pairs, ["movie"], [F.desc("right"), F.col("apart")])
    kind = F.when(F.col("found").isNull(), "missed").when(F.col("right"), "correct").otherwise("mismatch")
    seen = e.select("movie", "true").join(pairs.select("movie", "true", "found", "right"), ["movie", "true"], "left").select("movie", "true", "found", kind.alias("kind"))
    other = f.select("movie", "found").join(pairs.select("movie", "found"), ["movie", "found"], "left_anti")
    return seen.unionByName(other.select("movie", F.lit(None).cast(e.schema["true"].dataType).alias("true"), "found", F.lit("false").alias("kind")))


def counts(truth: DataFrame, found: DataFrame, true_lineage: DataFrame, found_lineage: DataFrame, nodes: DataFrame, tolerance: int = 1) -> DataFrame:
    """COUNTS by movie, 0 where there is nothing: divisions of each kind and all true ones;
    true links and those kept; true cells, and those in the found track that shares most of
    their track. A movie of either side has a row. `nodes` is read several times: give a
    written table."""
    most = common_frames(nodes).groupBy("movie", "true").agg(F.max("common").alias("n"))
    kinds = divisions(true_lineage, found_lineage, nodes, tolerance).groupBy("movie", "kind").agg(F.count("*").alias("n"))
    names = {"correct": COUNTS[0], "mismatch": COUNTS[1], "false": COUNTS[2], "missed": COUNTS[3]}
    named = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("kind"))
    each = lambda rows, name, n=F.lit(1): rows.groupBy("movie").agg(F.sum(n).cast("long").alias("n")).select("movie", F.lit(name).alias("name"), "n")
    facts = [
        kinds.select("movie", named.alias("name"), "n"),
        each(kinds.where("kind <> 'false'"), "total_divisions", F.col("n")),
        each(kept_links(truth, found, nodes), "aa_tp"),
        each(links(truth), "aa_total"),
        each(most, "te_tp", F.col("n")),
        each(truth, "te_total"),
        each(found, "", F.lit(0)),  # a movie that only the tracking has
    ]
    out = facts[0]
    for more in facts[1:]:
        out = out.unionByName(more)
    return out.groupBy("movie").agg(*[F.coalesce(F.sum(F.when(F.col("name") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTS])


def _share(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b))


def summary(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of COUNTS over the rows of each of `by` (all, if none), and the ratios of the
    sums, null where there is nothing to divide by: division recall, precision and f1, the
    share of right ones among all that either side has (branching), the share of missed
    ones, association accuracy and target effectiveness. A wrong pair counts for recall
    alone, as it is neither missed nor false."""
    e = table.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in COUNTS])
    c, fp, fn = (F.col(k) for k in ("correct_division", "false_positive_division", "false_negative_division"))
    e = e.withColumns({"division_recall": _share("correct_division", "total_divisions"), "division_precision": F.try_divide(c.cast("double"), c + fp)})
    r, p = F.col("division_recall"), F.col("division_precision")
    return e.withColumns({
        "division_f1": F.try_divide(2 * r * p, r + p), "branching": F.try_divide(c.cast("double"), c + fp + fn), "missed": _share("false_negative_division", "total_divisions"),
        "association_accuracy": _share("aa_tp", "aa_total"), "target_effectiveness": _share("te_tp", "te_total"),
    })
