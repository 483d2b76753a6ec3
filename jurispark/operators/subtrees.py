"""Subtrees with random thresholds whose rows fit one task.

A level of ``trees.grow`` is a chain of jobs, whatever its rows, and a tree without a limit on its depth
has dozens.  A node with few cells is grown on in one task instead, with the draws, scores and ties
of the levels: what is drawn depends on feature, node, tree and seed only, so both ways give the same tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize

# Cells of a node for one task, which takes about 50 bytes each (a row counts one more) ...
LOCAL_CELLS = 4_000_000
# ... pairs of its rows and the features it looks at ...
LOCAL_PAIRS = 1_000_000
# ... in matrices of at most so many features, as a node draws its own from all of them.
LOCAL_FEATURES = 10_000
# Pairs of open nodes and features whose keys are held at once.
KEYS_AT_ONCE = 1_000_000

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def hashed_int(state: np.ndarray, x: int) -> np.ndarray:
    """Spark's xxhash64 with one more int column."""
    x = np.array([x & 0xFFFFFFFF], np.uint64) * _P1
    return _mixed(_turned((state + _P5 + np.uint64(4)) ^ x, 23) * _P2 + _P3)


def hashed_long(state: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 with one more long column."""
    x = _turned(np.atleast_1d(x).astype(np.uint64) * _P2, 31) * _P1
    return _mixed(_turned((state + _P5 + np.uint64(8)) ^ x, 27) * _P1 + _P4)


def round_units(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` in units of its last digit, rounded as Spark rounds: halves of the written number away from 0."""
    units = np.abs(x) * 10.0**digits
    out = np.floor(units + 0.5)
    for i in np.flatnonzero(np.abs(units - np.floor(units) - 0.5) < 1e-3 + units * 2.0**-51):
        out[i] = float(Decimal(repr(abs(float(x[i])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(x < 0, -out, out)


class Cells:
    """Cells of rows by row and feature number; a row may list a feature more than once."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n_rows: int, n_features: int):
        key = row * n_features + feature
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        self.key, self.value, self.n_features = key, value, n_features
        self.repeated = bool((self.key[1:] == self.key[:-1]).any())
        # Of dense rows, where the cells of each key begin.
        self.begin = None
        if n_rows * n_features <= 4 * (len(key) + n_rows):
            self.begin = np.searchsorted(key, np.arange(n_rows * n_features + 1)).astype(np.int32)

    def find(self, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells of each pair, the pair of each cell found, its value)."""
        want = row * self.n_features + feature
        if self.begin is None:
            first, end = np.searchsorted(self.key, want, "left"), np.searchsorted(self.key, want, "right")
        else:
            first, end = self.begin[want], self.begin[want + 1]
        count = end - first
        pair = np.repeat(np.arange(len(want)), count)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        return count, pair, self.value[first[pair] + within]

    def steps(self, row: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, 1 if right): a pair goes on once for each of its cells, or once with 0 if it has none."""
        count, pair, value = self.find(row, feature)
        none = np.flatnonzero(count == 0)
        pair, value = np.concatenate([pair, none]), np.concatenate([value, np.zeros(len(none))])
        return pair, (value > threshold[pair]).astype(np.int64)


def _unpacked(rows: pa.Table, n_features: int) -> tuple[np.ndarray, Cells]:
    """Number of each row's id, and the cells of the ids from the first row of each."""
    ids = rows["id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    _, first = np.unique(ids, return_index=True)
    own = rows.select(["features", "values"]).take(pa.array(first))
    features, values = own["features"].combine_chunks(), own["values"].combine_chunks()
    sizes = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(first)), sizes)
    value = values.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    if np.isnan(value).any():
        value = np.where(np.isnan(value), np.inf, value)  # the largest value, as in Spark
    return ids.astype(np.int64), Cells(row, features.flatten().to_numpy(), value, len(first), n_features)


def _purity(criterion: str, counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1)
    safe = np.where(total > 0, total, 1.0)[:, None]
    if criterion == "gini":
        found = (counts * counts / safe).sum(axis=1)
    else:
        found = np.where(counts > 0, counts * np.log(np.where(counts > 0, counts, 1.0) / safe), 0.0).sum(axis=1)
    return np.where(total > 0, found, 0.0)


@dataclass(frozen=True)
class Draws:
    """What all tasks know: of each feature, in order, the hash states that draws start from."""

    keys: np.ndarray
    cuts: np.ndarray
    digits: int

    def looked(self, nodes: np.ndarray, tree, n: int) -> np.ndarray:
        """Numbers of the features that each node looks at."""
        every = len(self.keys)
        if n >= every:
            return np.tile(np.arange(every), (len(nodes), 1))
        out, step = [], max(1, KEYS_AT_ONCE // every)
        for i in range(0, len(nodes), step):
            states = hashed_long(self.keys[None, :], nodes[i : i + step, None])
            keys = hashed_int(hashed_int(states, tree.tree), tree.seed).view(np.int64)
            out.append(np.argsort(keys, axis=1, kind="stable")[:, :n])
        return np.concatenate(out)

    def uniform(self, nodes: np.ndarray, features: np.ndarray, tree) -> np.ndarray:
        found = hashed_int(hashed_int(hashed_long(self.cuts[features], nodes), tree.tree), tree.seed)
        return (found & np.uint64((1 << 52) - 1)).astype(np.float64) / float(1 << 52)


def _split(draws: Draws, tree, cells: Cells, nodes, total, sums, at, row, kind, times, weight):
    """(feature, threshold) of each node; feature -1 where no split is valid.

    Entry i is a row (``row[i]``, ``times[i]`` times) of class ``kind[i]`` in node ``at[i]``.
    """
    k = sums.shape[1]
    looked = draws.looked(nodes, tree, tree.n_features)
    n = looked.shape[1]
    group_feature, group_node = looked.ravel(), np.repeat(np.arange(len(nodes)), n)
    size = len(group_feature)
    entry = np.repeat(np.arange(len(at)), n)
    _, pair, value = cells.find(row[entry], looked[at].ravel())
    group = (at[entry] * n + np.tile(np.arange(n), len(at)))[pair]
    who = entry[pair]
    mass, one = times[who] * weight[who], times[who]
    count = lambda g, w: np.bincount(g, w, size)
    classes = lambda g, c, w: np.bincount(g * k + c, w, size * k).reshape(size, k)
    met = np.bincount(group, minlength=size) > 0
    rest_n, rest = total[group_node] - count(group, one), sums[group_node] - classes(group, kind[who], mass)
    zeros = met & (rest_n > 0)
    low, high = np.full(size, np.inf), np.full(size, -np.inf)
    np.minimum.at(low, group, value)
    np.maximum.at(high, group, value)
    low, high = np.where(zeros, np.minimum(low, 0.0), low), np.where(zeros, np.maximum(high, 0.0), high)
    with np.errstate(invalid="ignore"):
        cut = low + draws.uniform(nodes[group_node], group_feature, tree) * (high - low)
        threshold = np.where(cut < high, cut, low)
    left = value <= threshold[group]
    zeros_left = zeros & (threshold >= 0)
    l_n = count(group[left], one[left]) + np.where(zeros_left, rest_n, 0.0)
    l_c = classes(group[left], kind[who[left]], mass[left]) + np.where(zeros_left[:, None], rest, 0.0)
    t_n, t_c = total[group_node], sums[group_node]
    fits = met & (low < high) & (l_n >= tree.min_leaf) & (t_n - l_n >= tree.min_leaf) & (l_n < t_n)
    score = _purity(tree.criterion, l_c) + _purity(tree.criterion, np.maximum(t_c - l_c, 0.0))
    order = np.full(size, np.inf)
    order[fits] = -round_units(score[fits], draws.digits)
    first = np.lexsort((group_feature, order, group_node))[::n]
    found = np.isfinite(order[first])
    return np.where(found, group_feature[first], -1), np.where(found, threshold[first], np.nan)


def _merged(row, kind, weight, child, times):
    """Entries that are the same, as one."""
    order = np.lexsort((child, weight, kind, row))
    row, kind, weight, child, times = (x[order] for x in (row, kind, weight, child, times))
    new = np.ones(len(row), bool)
    for x in (row, kind, weight, child):
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~new[1:]
    start = np.flatnonzero(new)
    return row[start], kind[start], weight[start], child[start], np.add.reduceat(times, start)


def _grown(draws: Draws, tree, root: int, cells: Cells, row, kind, weight, k: int):
    """(node, class sums, feature or -1, threshold) of the nodes below and at ``root``."""
    nodes, depth, out = np.array([root], np.int64), root.bit_length() - 1, []
    at, times = np.zeros(len(row), np.int64), np.ones(len(row))
    while len(nodes):
        total = np.bincount(at, times, len(nodes))
        sums = np.bincount(at * k + kind, times * weight, len(nodes) * k).reshape(-1, k)
        able = ((sums > 0).sum(axis=1) > 1) & (total >= tree.min_split) & (depth < tree.deepest)
        feature, threshold = np.full(len(nodes), -1, np.int64), np.full(len(nodes), np.nan)
        if able.any():
            place, own = np.cumsum(able) - 1, np.flatnonzero(able[at])
            feature[able], threshold[able] = _split(
                draws, tree, cells, nodes[able], total[able], sums[able],
                place[at[own]], row[own], kind[own], times[own], weight[own],
            )
        out.append((nodes, sums, feature, threshold))
        own = np.flatnonzero(feature[at] >= 0)
        pair, right = cells.steps(row[own], feature[at[own]], threshold[at[own]])
        own = own[pair]
        child = 2 * nodes[at[own]] + right
        row, kind, weight, times = row[own], kind[own], weight[own], times[own]
        if cells.repeated and len(row):
            row, kind, weight, child, times = _merged(row, kind, weight, child, times)
        nodes, at = np.unique(child, return_inverse=True)
        depth += 1
    return [np.concatenate(x) for x in zip(*out)]


def numbered_features(features: DataFrame, digits: int) -> tuple[DataFrame, Draws]:
    """The features (at most LOCAL_FEATURES) by number, in order, and what draws start from."""
    keyed = features.orderBy("feature").select(
        "feature", F.xxhash64("feature").alias("key"), F.xxhash64(F.lit("threshold"), "feature").alias("cut")
    )
    found = keyed.collect()
    of = lambda name: np.array([r[name] for r in found], np.int64).view(np.uint64)
    table = features.sparkSession.createDataFrame(
        [(r["feature"], i) for i, r in enumerate(found)],
        T.StructType([*features.schema.fields, T.StructField("fidx", T.IntegerType())]),
    )
    return table, Draws(of("key"), of("cut"), digits)


def packed(cells: DataFrame, numbers: DataFrame) -> DataFrame:
    """(id, held, features, values): the cells of each id in one row, by feature."""
    entries = F.sort_array(F.collect_list(F.struct("fidx", "value")))
    rows = cells.join(F.broadcast(numbers), "feature").groupBy("id").agg(entries.alias("_e"))
    return rows.select(
        "id", (F.size("_e") + 1).alias("held"), F.col("_e.fidx").alias("features"), F.col("_e.value").alias("values")
    )


def grow(at: DataFrame, rows: DataFrame, trees: dict, draws: Draws, k: int) -> DataFrame:
    """(m, root, node, c0.., fidx, threshold): the subtrees of all (m, node) in ``at`` (m, id, node, c0..)."""
    cs = [f"c{i}" for i in range(k)]
    n_features = len(draws.keys)

    def run(group: pa.Table) -> pa.Table:
        m, root = group["m"][0].as_py(), group["node"][0].as_py()
        row, cells = _unpacked(group, n_features)
        weights = np.stack([group[c].to_numpy() for c in cs], axis=1)
        kind = weights.argmax(axis=1)
        node, sums, feature, threshold = _grown(
            draws, trees[m], root, cells, row, kind, weights[np.arange(len(kind)), kind], k
        )
        leaf = feature < 0
        return pa.table({
            "m": pa.array(np.full(len(node), m), pa.int32()), "root": pa.array(np.full(len(node), root), pa.int64()),
            "node": pa.array(node, pa.int64()), **{c: pa.array(sums[:, i]) for i, c in enumerate(cs)},
            "fidx": pa.array(feature, pa.int32(), mask=leaf), "threshold": pa.array(threshold, pa.float64(), mask=leaf),
        })

    doubles = ", ".join(f"{c} double" for c in cs)
    met = at.join(rows.drop("held"), "id", "left").groupBy("m", "node")
    return materialize(met.applyInArrow(run, f"m int, root long, node long, {doubles}, fidx int, threshold double"))


def route(at: DataFrame, rows: DataFrame, subtrees: DataFrame, k: int, n_features: int) -> DataFrame:
    """(id, m, c0.., times): the leaves that rows reach from their (m, root) in ``at`` (id, m, root)."""
    cs = [f"c{i}" for i in range(k)]

    def run(group: pa.Table, tree: pa.Table) -> pa.Table:
        tree = tree.sort_by("node")
        nodes, threshold = tree["node"].to_numpy(), tree["threshold"].fill_null(0.0).to_numpy()
        feature = tree["fidx"].fill_null(-1).to_numpy().astype(np.int64)
        number, cells = _unpacked(group, n_features)
        row, times = np.arange(len(group)), np.ones(len(group), np.int64)
        at = np.zeros(len(group), np.int64)  # the root is the smallest node of its subtree
        ends = []
        while len(row):
            open_ = feature[at] >= 0
            ends.append((row[~open_], at[~open_], times[~open_]))
            row, at, times = row[open_], at[open_], times[open_]
            pair, right = cells.steps(number[row], feature[at], threshold[at])
            child = 2 * nodes[at[pair]] + right
            row, times = row[pair], times[pair]
            if cells.repeated and len(row):
                same = np.zeros(len(row), np.int64)
                row, _, _, child, times = _merged(row, same, same, child, times)
            at = np.minimum(np.searchsorted(nodes, child), len(nodes) - 1)
            known = nodes[at] == child
            row, times, at = row[known], times[known], at[known]
        row, at, times = (np.concatenate(x) for x in zip(*ends))
        leaves = tree.select(cs).take(pa.array(at))
        return pa.table({
            "id": group["id"].take(pa.array(row)), "m": group["m"].take(pa.array(row)),
            **{c: leaves[c] for c in cs}, "times": pa.array(times, pa.int64()),
        })

    # A root that many rows reach is cut into slices of them.
    met = materialize(at.join(rows, "id", "left"))
    held = F.sum(F.coalesce(F.col("held"), F.lit(1)))
    slices = met.groupBy("m", "root").agg(F.ceil(held / F.lit(LOCAL_CELLS)).cast("int").alias("slices"))
    keys = ["m", "root", "slice"]
    parts = met.join(slices, ["m", "root"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    copies = subtrees.join(slices, ["m", "root"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    doubles = ", ".join(f"{c} double" for c in cs)
    schema = f"id {dict(at.dtypes)['id']}, m int, {doubles}, times long"
    return parts.drop("held", "slices").groupBy(*keys).cogroup(copies.drop("slices").groupBy(*keys)).applyInArrow(run, schema)
