"""Decision trees and forests grown level by level, all models at once.

A level is one aggregate: for every open node of every model (settings x folds x trees), the
class weights at each distinct value of each feature.  Zero cells are one value, whose weights
follow from the node's.  Running totals over these ladders give the score of every split; the
random splitter draws one threshold per node and feature instead.  So jobs grow with the depth,
not with the number of models, and no node's rows are ever gathered.

Nodes are numbered 1, then 2n and 2n + 1 below n.  A tree with a limit on its leaves keeps the
splits that best-first growth would make.  What that growth leaves out among the levels known so
far it leaves out for good, so each level adds at most two candidates per split kept.

Below the root, nodes with random thresholds and few cells leave the levels: ``subtrees`` grows
each of them on in one task.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import value_bucket
from ..sources.scratch import materialize, materialize_with
from . import subtrees
from .folds import clamped_fold_count, stratified_folds
from .matrix import Matrix
from .skew import BROADCAST_ROWS, running_totals
from .terms import distinct_labels

DEEPEST = 60  # node numbers fit 64 bits
SCORE_DIGITS = 9  # scores are compared after rounding, so that equal splits tie
# Chance of at most 0, 1, .. draws of a row in a bootstrap sample (Poisson, mean 1).
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))


@dataclass(frozen=True)
class Trees:
    """Settings; ``fit`` returns the model.

    ``min_samples_split`` is a number of rows or, below 1, a share of them.  ``max_features`` is
    a number, a share (a float), "sqrt" (also "auto"), "log2", or None for all; a node looks at
    that many features, drawn anew for each node.  ``class_weight`` "balanced" gives classes the
    same total weight.  ``bootstrap`` draws each row a Poisson number of times per tree.
    """

    criterion: str = "gini"
    splitter: str = "best"
    max_depth: int | None = None
    min_samples_split: float = 2
    min_samples_leaf: int = 1
    max_leaf_nodes: int | None = None
    max_features: int | float | str | None = None
    class_weight: str | None = None
    bootstrap: bool = False
    n_trees: int = 1
    seed: int = 0

    def __post_init__(self) -> None:
        if self.criterion not in ("gini", "entropy") or self.splitter not in ("best", "random"):
            raise ValueError("criterion is gini or entropy, splitter best or random")
        if self.class_weight not in (None, "balanced"):
            raise ValueError('class_weight is None or "balanced"')
        if self.n_trees < 1 or self.min_samples_leaf < 1 or (self.max_leaf_nodes or 2) < 2:
            raise ValueError("n_trees and min_samples_leaf start at 1, max_leaf_nodes at 2")

    def features_per_node(self, n: int) -> int:
        m = self.max_features
        if m is None:
            return n
        if m in ("sqrt", "auto"):
            m = math.isqrt(n)
        elif m == "log2":
            m = int(math.log2(max(1, n)))
        elif isinstance(m, float):
            m = int(m * n)
        return max(1, min(n, m))

    def fit(self, matrix: Matrix) -> TreesModel:
        classes = distinct_labels(matrix.rows)
        rows = matrix.rows.withColumn("fold", F.lit(-1))
        return TreesModel(classes, grow(rows, matrix.cells, classes, [(self, -2)]))


def forest(**settings) -> Trees:
    return Trees(**{"n_trees": 10, "max_features": "sqrt", "bootstrap": True, **settings})


def extra_trees(**settings) -> Trees:
    """Trees on all rows with random thresholds."""
    return Trees(**{"n_trees": 10, "max_features": "sqrt", "splitter": "random", **settings})


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _score(criterion: Column, counts: list[Column]) -> Column:
    """Weight times purity: larger is better, for either criterion."""
    total = sum(counts, F.lit(0.0))
    gini = sum((c * c for c in counts), F.lit(0.0)) / total
    entropy = sum((F.when(c > 0, c * F.ln(c / total)).otherwise(0.0) for c in counts), F.lit(0.0))
    return F.when(total <= 0, 0.0).when(criterion == "gini", gini).otherwise(entropy)


def _models(
    spark, rows: DataFrame, specs: Sequence[tuple[Trees, int]], k: int, n_features: int
) -> DataFrame:
    """One small row per tree: its settings as numbers, and its class weights."""
    counts: dict[int, list[int]] = {}
    for r in rows.groupBy("fold", "k").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["fold"], [0] * k)[r["k"]] = r["n"]
    out = []
    for s, (tree, left_out) in enumerate(specs):
        sizes = [sum(c[i] for f, c in counts.items() if f != left_out) for i in range(k)]
        n = sum(sizes)
        split = tree.min_samples_split
        weights = [n / (k * c) if tree.class_weight and c else 1.0 for c in sizes]
        for t in range(tree.n_trees):
            out.append((
                len(out), s, left_out, t, tree.seed, tree.criterion, tree.splitter == "random", tree.bootstrap,
                min(DEEPEST, tree.max_depth or DEEPEST), int(math.ceil(split * n)) if split < 1 else int(split),
                tree.min_samples_leaf, tree.max_leaf_nodes, tree.features_per_node(n_features), weights,
            ))
    return spark.createDataFrame(
        out,
        "m int, setting int, left_out int, tree int, seed int, criterion string, random boolean, bootstrap boolean, "
        "deepest int, min_split int, min_leaf int, max_leaves int, n_features int, cw array<double>",
    )


@dataclass(frozen=True)
class Grown:
    """``models`` (m, setting, ...), ``nodes`` (m, node, c0.., feature, threshold, below) per level.

    A node is ``below`` if what it starts is in ``subtrees`` (m, root, node, c0.., fidx, threshold),
    whose features are those of ``numbers`` (feature, fidx).
    """

    models: DataFrame
    levels: list[DataFrame]
    sizes: list[int]
    classes: int
    subtrees: DataFrame | None = None
    numbers: DataFrame | None = None

    def route(self, rows: DataFrame, cells: DataFrame) -> DataFrame:
        """(id, m, c0.., times): class weights of the leaf that each row (id, fold) reaches in each tree.

        A model sees the rows of the fold it was not grown on, or all if there is none.
        """
        cs = [f"c{i}" for i in range(self.classes)]
        models = F.broadcast(self.models.select("m", "left_out"))
        at = rows.select("id", "fold").join(models, (F.col("fold") == F.col("left_out")) | (F.col("left_out") == -2))
        at = at.select("id", "m", F.lit(1).cast("long").alias("node"))
        done = handed = None
        for depth, level in enumerate(self.levels):
            here = _with_nodes(at, level, self.sizes[depth])
            ended = here.where("feature IS NULL AND NOT below").select("id", "m", *cs, F.lit(1).cast("long").alias("times"))
            done = ended if done is None else done.unionAll(ended)
            if self.subtrees is not None:
                down = here.where("below").select("id", "m", F.col("node").alias("root"))
                handed = down if handed is None else handed.unionAll(down)
            if depth + 1 < len(self.levels):
                at = materialize(_step(here.where("feature IS NOT NULL"), cells, "id", "m"))
        if handed is not None:
            packed = subtrees.packed(cells, self.numbers)
            done = done.unionAll(subtrees.route(handed, packed, self.subtrees, self.classes, self.numbers.count()))
        return done


def _with_nodes(rows: DataFrame, nodes: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Rows and what ``n`` rows on their nodes say; the nodes are broadcast if few, and the rows never.

    Left to itself the planner goes by the size of files, and rows of repeated numbers take a
    hundred times that in the driver's memory.
    """
    return rows.join(F.broadcast(nodes) if n <= BROADCAST_ROWS else nodes.hint("merge"), ["m", "node"], how)


def _step(here: DataFrame, cells: DataFrame, *keep: str) -> DataFrame:
    """Rows with the feature and threshold of their node go to its left or right child."""
    value = F.coalesce(F.col("value"), F.lit(0.0))
    child = F.col("node") * 2 + (value > F.col("threshold")).cast("long")
    return here.join(cells.hint("merge"), ["id", "feature"], "left").select(*keep, child.alias("node"))


def grow(rows: DataFrame, cells: DataFrame, classes: list, specs: Sequence[tuple[Trees, int]]) -> Grown:
    """Grow the trees of all ``specs`` (settings, fold left out) on ``rows`` (id, label, fold)."""
    spark, k = rows.sparkSession, len(classes)
    cs = [f"c{i}" for i in range(k)]
    names = F.array(*[F.lit(c) for c in classes])
    rows = materialize(
        rows.where("label IS NOT NULL").select(
            "id", "fold", (F.array_position(names, F.col("label")) - 1).cast("int").alias("k")
        )
    )
    cells = materialize(cells.where("value <> 0").select("id", "feature", F.col("value").cast("double").alias("value")))
    features = materialize(cells.select("feature").distinct())
    n_features = features.count()
    models = materialize(_models(spark, rows, specs, k, n_features))
    small = F.broadcast(models)

    u = _uniform(F.col("id"), F.col("tree"), F.col("seed"))
    drawn = sum(((u >= F.lit(p)).cast("int") for p in POISSON), F.lit(0))
    times = F.when(F.col("bootstrap"), drawn).otherwise(F.lit(1))
    # Trees whose small nodes are grown on by one task.
    ends_in_tasks = n_features <= subtrees.LOCAL_FEATURES and any(
        t.splitter == "random" and not t.max_leaf_nodes for t, _ in specs
    )
    entries, hand_on, numbers = [*cs], F.lit(False), None
    if ends_in_tasks:
        numbers, draws = subtrees.numbered_features(features, SCORE_DIGITS)
        numbers = materialize(numbers)
        packed = materialize(subtrees.packed(cells, numbers))
        rows = materialize(rows.join(packed.select("id", "held"), "id", "left").na.fill(1, ["held"]))
        entries.append("held")
        fits_a_task = (F.col("held") <= subtrees.LOCAL_CELLS) & (F.col("n") * F.col("n_features") <= subtrees.LOCAL_PAIRS)
        hand_on = F.col("random") & F.col("max_leaves").isNull() & fits_a_task
    start = rows.join(small, F.col("fold") != F.col("left_out")).withColumn("times", times).where("times > 0")
    weight = F.col("times") * F.get("cw", F.col("k"))
    at = start.select("m", "id", F.lit(1).cast("long").alias("node"), *[
        F.when(F.col("k") == i, weight).otherwise(0.0).alias(c) for i, c in enumerate(cs)
    ], *entries[k:])
    narrows = any(t.features_per_node(10**6) < 10**6 for t, _ in specs)
    # Rows meet the features their node looks at before the cells, if those are the fewer.
    few = narrows and max(t.features_per_node(n_features) for t, _ in specs) * rows.count() < cells.count()
    limits, number = {}, 0
    for t, _ in specs:
        limits.update({number + i: t.max_leaf_nodes for i in range(t.n_trees) if t.max_leaf_nodes})
        number += t.n_trees
    found, levels, sizes, handed = None, [], [], None
    for depth in range(DEEPEST + 1):
        at, seen = materialize_with(at, F.count(F.lit(1)).alias("n"))
        if not seen["n"]:
            break
        mixed = sum(((F.col(c) > 0).cast("int") for c in cs), F.lit(0)) > 1
        splits = mixed & (F.col("n") >= F.col("min_split")) & (F.lit(depth) < F.col("deepest"))
        counted = at.groupBy("m", "node").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in entries])
        counted = counted.join(small, "m").withColumn("below", splits & hand_on & F.lit(depth > 0))
        totals, seen = materialize_with(
            counted.select("m", "node", "n", *cs, "below", (splits & ~F.col("below")).alias("able")),
            F.count_if("below").alias("below"), F.count_if("able").alias("able"), F.count(F.lit(1)).alias("n"),
        )
        sizes.append(seen["n"])
        if seen["below"]:
            down = _with_nodes(at, totals.where("below").select("m", "node"), seen["below"], "left_semi").drop("held")
            handed = down if handed is None else handed.unionAll(down)
        if not seen["able"]:
            levels.append((totals, None))
            break
        able = totals.where("able").join(small, "m").select("m", "node", *[F.col(c).alias(f"t_{c}") for c in ("n", *cs)], "criterion", "random", "min_leaf", "tree", "seed", "n_features")
        if narrows:
            key = F.xxhash64("feature", "node", "tree", "seed")
            # Open nodes by features: what max_features is defined over.
            ranked = able.withColumn("_one", F.lit(1)).join(features.withColumn("_one", F.lit(1)), "_one").drop("_one")
            first = W.partitionBy("m", "node").orderBy(key, "feature")
            looked = ranked.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= F.col("n_features")).drop("_r")
            looked = materialize(looked)
        # Rows in leaves have no split to look for.
        if few:
            pairs = seen["able"] * max(t.features_per_node(n_features) for t, _ in specs)
            met = _with_nodes(at, looked.select("m", "node", "feature"), pairs).join(cells.hint("merge"), ["id", "feature"])
        else:
            met = _with_nodes(at, able.select("m", "node"), seen["able"], "left_semi").join(cells.hint("merge"), "id")
        ladder = met.groupBy("m", "node", "feature", "value").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in cs]
        )
        sums = ("n", *cs)
        if narrows:
            ladder = ladder.join(looked, ["m", "node", "feature"])
        else:
            ladder = _with_nodes(ladder, able, seen["able"])
        ladder = materialize(ladder)
        group = ["m", "node", "feature"]
        held = ladder.groupBy(*group, *[c for c in able.columns if c not in group]).agg(*[F.sum(c).alias(c) for c in sums])
        zeros = held.select(
            *[F.lit(0.0).alias("value") if c == "value" else (F.col(f"t_{c}") - F.col(c)).alias(c) if c in sums else F.col(c)
              for c in ladder.columns]
        ).where("n > 0")
        whole = ladder.unionAll(zeros)
        parts = []
        if any(t.splitter == "best" for t, _ in specs):
            parts.append(_best(whole, group, sums))
        if any(t.splitter == "random" for t, _ in specs):
            parts.append(_random(whole, group, sums))
        candidates = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        left = [F.col(f"l_{c}") for c in cs]
        right = [F.greatest(F.col(f"t_{c}") - F.col(f"l_{c}"), F.lit(0.0)) for c in cs]
        score = _score(F.col("criterion"), left) + _score(F.col("criterion"), right)
        gain = score - _score(F.col("criterion"), [F.col(f"t_{c}") for c in cs])
        fits = (F.col("l_n") >= F.col("min_leaf")) & (F.col("t_n") - F.col("l_n") >= F.col("min_leaf")) & (F.col("l_n") < F.col("t_n"))
        choice = F.struct(
            (-F.round(score, SCORE_DIGITS)).alias("order"), "feature", "threshold", F.round(gain, SCORE_DIGITS).alias("gain"), "random"
        )
        best = candidates.where(fits).groupBy("m", "node").agg(F.min(choice).alias("x")).select(
            "m", "node", "x.feature", "x.threshold", "x.gain", "x.random"
        )
        best = materialize(_between(materialize(best), whole, group, seen["able"]).select("m", "node", "feature", "threshold", "gain"))
        if limits:
            found = best if found is None else found.unionAll(best)
            kept = _first(found.where(F.col("m").isin(list(limits))), limits)
            free = ~F.col("m").isin(list(limits))
            found = materialize(found.where(~free).join(F.broadcast(kept), ["m", "node"], "left_semi"))
            best = best.where(free).unionAll(best.where(~free).join(F.broadcast(kept), ["m", "node"], "left_semi"))
        levels.append((totals, best))
        at = _step(_with_nodes(at, best.select("m", "node", "feature", "threshold"), seen["able"]), cells, "m", "id", *entries)
    out = []
    for totals, best in levels:
        made = best
        if limits and best is not None:  # a split may have been left out when a later level was known
            made = best.where(~F.col("m").isin(list(limits))).unionAll(found)
        nodes = totals.select("m", "node", *cs, "below")
        if made is None:  # the last level: leaves, and nodes that tasks grow on
            feature = F.lit(None).cast(cells.schema["feature"].dataType)
            out.append(nodes.select("m", "node", *cs, feature.alias("feature"), F.lit(None).cast("double").alias("threshold"), "below"))
            continue
        split = made.select("m", "node", "feature", "threshold")
        out.append(materialize(nodes.join(split, ["m", "node"], "left")))
    if handed is None:
        return Grown(models, out, sizes, k)
    own = {r["m"]: r for r in models.collect()}
    return Grown(models, out, sizes, k, subtrees.grow(handed, packed, own, draws, k), numbers)


def _best(whole: DataFrame, group: list[str], sums: Sequence[str]) -> DataFrame:
    """Every value of a ladder as a split: what lies at or below it goes left."""
    totals = running_totals(whole.where("NOT random"), group, "value", list(sums), value_bucket(F.col("value")))
    return totals.select(
        *group, *_settings(whole, group, sums), F.col("value").alias("threshold"),
        *[(F.col(f"{c}_before") + F.col(c)).alias(f"l_{c}") for c in sums],
    )


def _random(whole: DataFrame, group: list[str], sums: Sequence[str]) -> DataFrame:
    """One threshold per node and feature, drawn between its extremes."""
    part = whole.where("random")
    ends = part.groupBy(*group).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi")
    u = _uniform(F.lit("threshold"), F.col("feature"), F.col("node"), F.col("tree"), F.col("seed"))
    cut = F.col("lo") + u * (F.col("hi") - F.col("lo"))
    placed = part.join(ends.hint("merge"), group).withColumn("threshold", F.when(cut >= F.col("hi"), F.col("lo")).otherwise(cut))
    keep = _settings(whole, group, sums)
    return placed.groupBy(*group, *keep, "threshold").agg(
        *[F.sum(F.when(F.col("value") <= F.col("threshold"), F.col(c)).otherwise(0)).alias(f"l_{c}") for c in sums]
    )


def _settings(whole: DataFrame, group: list[str], sums: Sequence[str]) -> list[str]:
    return [c for c in whole.columns if c not in (*group, "value", *sums)]


def _between(best: DataFrame, whole: DataFrame, group: list[str], n: int) -> DataFrame:
    """Thresholds of the best splitter move halfway to the next value of the node; ``best`` has up to ``n`` rows."""
    chosen = best.where("NOT random").select(*group, "threshold")
    higher = (
        whole.select(*group, "value").join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen.hint("merge"), group)
        .where("value > threshold")
        .groupBy(*group)
        .agg(F.min("value").alias("_next"))
    )
    middle = (F.col("threshold") + F.col("_next")) / 2
    moved = F.when(F.col("_next").isNull(), F.col("threshold")).when(middle >= F.col("_next"), F.col("threshold"))
    return best.join(higher, group, "left").withColumn("threshold", moved.otherwise(middle)).drop("_next", "random")


def _first(found: DataFrame, limits: dict[int, int]) -> DataFrame:
    """(m, node): the splits that best-first growth makes before a model has its leaves.

    ``found`` has at most three times as many rows per model as it may have leaves.
    """
    gains: dict[int, dict[int, float]] = {}
    for r in found.select("m", "node", "gain").collect():
        gains.setdefault(r["m"], {})[r["node"]] = r["gain"]
    kept = []
    for m, gain in gains.items():
        open_nodes = [(-gain[1], 1)] if 1 in gain else []
        while open_nodes and sum(1 for k, _ in kept if k == m) < limits[m] - 1:
            _, node = heapq.heappop(open_nodes)
            kept.append((m, node))
            for child in (2 * node, 2 * node + 1):
                if child in gain:
                    heapq.heappush(open_nodes, (-gain[child], child))
    return found.sparkSession.createDataFrame(kept, "m int, node long")


def _voted(leaves: DataFrame, models: DataFrame, k: int) -> DataFrame:
    """(id, setting, found): class number with the largest mean share; the smallest of equals."""
    cs = [f"c{i}" for i in range(k)]
    total = sum((F.col(c) for c in cs), F.lit(0.0))
    shares = leaves.join(F.broadcast(models.select("m", "setting")), "m").groupBy("id", "setting").agg(
        *[F.round(F.sum(F.col(c) / total * F.col("times")) / F.sum("times"), 12).alias(c) for c in cs]
    )
    means = F.array(*[F.col(c) for c in cs])
    return shares.select("id", "setting", (F.array_position(means, F.array_max(means)) - 1).cast("int").alias("found"))


@dataclass(frozen=True)
class TreesModel:
    classes: list
    grown: Grown

    def predict(self, matrix: Matrix) -> DataFrame:
        """(id, label, y_pred) of every row of ``matrix``."""
        rows = matrix.rows.withColumn("fold", F.lit(-1))
        cells = matrix.cells.select("id", "feature", F.col("value").cast("double").alias("value"))
        voted = _voted(self.grown.route(rows, cells), self.grown.models, len(self.classes))
        names = F.array(*[F.lit(c) for c in self.classes])
        return matrix.rows.join(voted, "id", "left").select(
            "id", "label", F.get(names, F.col("found")).alias("y_pred")
        )


def score_candidates(
    matrix: Matrix, candidates: Sequence[dict], n_folds: int = 5, seed: int = 0
) -> DataFrame:
    """(params, fold, score): accuracy of each candidate, written as JSON, on each fold.

    The trees of all candidates and folds grow together, a level at a time.
    """
    spark = matrix.rows.sparkSession
    schema = "params string, fold int, score double"
    if not candidates:
        return spark.createDataFrame([], schema)
    known = matrix.rows.where("label IS NOT NULL")
    folds = clamped_fold_count(known, n_folds, "label")
    marked = materialize(stratified_folds(known.select("id", "label"), folds, "label", "id", seed))
    classes = distinct_labels(marked)
    specs = [(Trees(**c), f) for c in candidates for f in range(folds)]
    grown = grow(marked, matrix.cells, classes, specs)
    cells = matrix.cells.select("id", "feature", F.col("value").cast("double").alias("value"))
    voted = _voted(grown.route(marked, cells), grown.models, len(classes)).join(marked.hint("merge"), "id")
    names = F.array(*[F.lit(c) for c in classes])
    hit = (F.get(names, F.col("found")) == F.col("label")).cast("int")
    scores = voted.groupBy("setting", "fold").agg((F.sum(hit) / F.count(F.lit(1))).alias("score"))
    named = spark.createDataFrame(
        [(i * folds + f, json.dumps(c, sort_keys=True)) for i, c in enumerate(candidates) for f in range(folds)],
        "setting int, params string",
    )
    return scores.join(F.broadcast(named), "setting").select("params", "fold", "score")
