"""Partial-least-squares models of all settings on all folds, fitted side by side.

A search over nu and the number of components needs one model per (nu, fold).  Here
they share every pass: ``g`` (the fold a model leaves out) is a key column, and values
that differ by nu are arrays with one entry per nu, or rows with its position ``k``.
The number of jobs depends on the number of components only.  The driver holds numbers
per model and pair of components.

Cells are packed once into blocks of rows x chunks of features, with their rank in each
training part.  Tasks derive the values and residuals of every model from a block with
numpy; what is shuffled are sums per feature and, for the ranks of residuals, one sorted
piece of values per (model, feature, block).

Covers the variants without a regression per feature (``standard`` and ``gini``);
``standard`` does not depend on nu and is fitted once per fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import shuffle_bucket, shuffle_key
from ..sources.scratch import materialize
from . import skew
from .matrix import Matrix, stats_of_cells
from .metrics import per_class
from .packed import arrays, coded, in_parts, joined, runs
from .pls import PLS, RESIDUAL_DIGITS
from .skew import row_numbers, weighted_join

SIDE_BY_SIDE = ("standard", "gini")
GROUP = ["g", "g_n", "g_sy", "g_mean", "g_sd"]
PLACE = ["num", "chunk", "pos"]
# A block has at most so many rows (fewer on small tables, for all cores to have one), a chunk so many features.
BLOCK_ROWS, LEAST_ROWS, WIDTH = 4096, 256, 128
CELL = {"value": "f8", "rn": "i4", "idn": "i4", "fold": "i4", "y": "f8"}
RANKED = {"rn": "i4", "idn": "i4", "fold": "i4"}
SUMS = ["cross", "r0", "new0", "high", "low"]
RESIDUAL = {"value": "sorted", "s": "planes", "cnt": "i4"}
# Below this size a double has more than RESIDUAL_DIGITS decimals.
EXACT = 2.0**53 / 10.0**RESIDUAL_DIGITS


def _number(x: Column) -> Column:
    """A number from pandas, where NaN comes back as NULL: sums must not skip it."""
    return F.coalesce(x, F.lit(float("nan")))


def grid_scores(
    matrix: Matrix, marked: DataFrame, params: PLS, nus: Sequence[float], sizes: Sequence[int],
    folds: Sequence[int],
) -> DataFrame:
    """(nu, n_comp, fold, score): macro F1 of every setting on every fold.

    ``marked`` is the matrix's rows (id, label, fold).  Raises ValueError where a single
    fit would: other than two classes, or a fold whose features are all constant.
    """
    return _Grid(matrix, marked, params, nus, sizes, folds).scores()


# --- inside tasks ---------------------------------------------------------------------


def _pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all left[i] == right[j], in the order of i."""
    order = np.argsort(right, kind="stable")
    low, high = (np.searchsorted(right, left, side, sorter=order) for side in ("left", "right"))
    n = high - low
    i = np.repeat(np.arange(len(left)), n)
    return i, order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(i))]


def _rounded(x: np.ndarray) -> np.ndarray:
    scale = 10.0**RESIDUAL_DIGITS
    return np.where(np.abs(x) < EXACT, np.rint(x * scale) / scale, x) + 0.0


def _merged(value: np.ndarray, s: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values with the sums of ``s`` and ``cnt``."""
    order = np.argsort(value, kind="stable")
    value, s, cnt = value[order], s[order], cnt[order]
    starts = runs(value)
    if len(starts) == len(value):
        return value, s, cnt
    return value[starts], np.add.reduceat(s, starts), np.add.reduceat(cnt, starts)


def _pack_cells(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["rn", "pos", "value"], kind="stable")
    packed = {c: [group[c].to_numpy().astype(kind).tobytes()] for c, kind in {**CELL, "pos": "i4"}.items()}
    return group[["block", "chunk"]].head(1).assign(**packed)


def _value_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each feature of each block: its cells by value."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            cell = arrays(row, {**CELL, "pos": "i4"})
            order = np.lexsort([cell["value"], cell["pos"]])
            cell = {c: x[order] for c, x in cell.items()}
            ends = [*runs(cell["pos"]), len(order)]
            yield pd.DataFrame([
                {"num": row.chunk * WIDTH + int(cell["pos"][a]), "block": row.block,
                 **{c: cell[c][a:b].tobytes() for c in CELL}}
                for a, b in zip(ends, ends[1:])
            ])


def _pack_ranked(group: pd.DataFrame) -> pd.DataFrame:
    """The ranked cells of one block and chunk, by row and feature."""
    cell = joined(group, RANKED)
    n = len(cell["rn"])
    cell["pos"] = np.repeat(group["pos"].to_numpy(), [len(x) // 4 for x in group["rn"]]).astype("i4")
    for c in ("rank", "new"):
        cell[c] = np.frombuffer(b"".join(group[c])).reshape(n, -1)
    order = np.lexsort([cell["pos"], cell["rn"]])
    return group[["block", "chunk"]].head(1).assign(**{c: [x[order].tobytes()] for c, x in cell.items()})


class _Placing:
    """Ranks the cells of one feature (or one range of its values) in every training part.

    ``what`` is ``count`` (cells of the range), ``sums`` (per training part) or ``cells``.
    """

    def __init__(self, what: str, size: dict, known: dict, nus: Sequence[float], centred: bool) -> None:
        self.what, self.size, self.known, self.nus, self.centred = what, size, known, nus, centred

    def __call__(self, key, pieces: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        num, part = int(key[0]), int(key[1])
        if not len(side):  # cells of a feature that no training part keeps
            return pd.DataFrame()
        side = next(side.itertuples(index=False))
        cell = joined(pieces, CELL)
        cuts = np.asarray([] if side.cuts is None else side.cuts)
        holds_zero = int(np.searchsorted(cuts, 0.0, "left")) == part
        values = np.unique(np.append(cell["value"], 0.0) if holds_zero else cell["value"])
        at = np.searchsorted(values, cell["value"])
        zero = int(np.searchsorted(values, 0.0)) if holds_zero else None
        if self.what == "cells":
            rank = np.full((len(at), len(self.size)), np.nan)
            new = np.full((len(at), len(self.nus)), np.nan)
        p, out = np.asarray(self.nus) - 1.0, []
        for i, (g, n) in enumerate(self.size.items()):
            nnz, sy_listed = side.nnz[i], side.sy[i]
            if nnz < 0:
                continue
            train, g_sy, g_mean = cell["fold"] != g, *self.known[g]
            cnt = np.bincount(at[train], minlength=len(values)).astype(float)
            sy = np.bincount(at[train], cell["y"][train], len(values))
            zeros = n - nnz if zero is not None else 0.0
            if zeros > 0:
                cnt[zero], sy[zero] = cnt[zero] + zeros, sy[zero] + g_sy - sy_listed
            if self.what == "count":
                out.append((g, num, part, cnt.sum()))
                continue
            before = np.cumsum(cnt) - cnt + side.before[i]
            ranks = before + (cnt + 1) / 2.0
            place = n + 2.0 - (before + cnt / 2.0 + 1.0)
            down = np.where(cnt > 0, n + 1.0 - ranks, 1.0)  # where no row is, none counts
            shift = np.asarray(side.shift).reshape(len(self.size), -1)[i]
            sums = {c: np.zeros(len(p)) for c in SUMS}
            for k, power in enumerate(p):  # one by one: a column can be long
                own, r = place**power, down**power
                high, low = cnt * r, cnt * (down + 1.0) ** power
                if self.centred:
                    below, above = np.cumsum(low) - low, high.sum() - np.cumsum(high)
                    own = own - (above + below + (cnt + 1) * own) / (n + 1.0) - shift[k]
                if self.what == "cells":
                    new[~train, k] = own[at[~train]]
                    continue
                sums["high"][k], sums["low"][k] = high.sum(), low.sum()
                sums["cross"][k] = (r * (sy - cnt * g_mean)).sum()
                if zeros > 0:
                    sums["r0"][k] = r[zero]
                if zero is not None:
                    sums["new0"][k] = own[zero]
            if self.what == "cells":
                rank[train, i] = ranks[at[train]]
            else:
                out.append({"g": g, "num": num, "part": part, **sums, "zero": float(zero is not None)})
        if self.what == "count":
            return pd.DataFrame(out, columns=["g", "num", "part", "cnt"])
        if self.what == "sums":
            return pd.DataFrame(out, columns=["g", "num", "part", *SUMS, "zero"])
        ends = np.cumsum([0, *(len(x) // 4 for x in pieces["rn"])])
        return pd.DataFrame({
            "block": pieces["block"], "chunk": num // WIDTH, "pos": num % WIDTH,
            **{c: pieces[c] for c in RANKED},
            "rank": [rank[a:b].tobytes() for a, b in zip(ends, ends[1:])],
            "new": [new[a:b].tobytes() for a, b in zip(ends, ends[1:])],
        })


class _Block:
    """Cells of one block and chunk, with the numbers of its features (models x WIDTH) beside them."""

    def __init__(self, row, size: dict, nus: Sequence[float], ranked: bool, side: Sequence[str]) -> None:
        self.size, self.nus, self.ranked = size, nus, ranked
        self.cell = arrays(row, {**RANKED, "pos": "i4"} if ranked else {**CELL, "pos": "i4"})
        for c in ("rank", "new") if ranked else ():
            if hasattr(row, c):
                width = len(size) if c == "rank" else len(nus)
                self.cell[c] = np.frombuffer(getattr(row, c) or b"").reshape(-1, width)
        shape = (len(size), len(nus), WIDTH)
        self.side = {c: np.frombuffer(getattr(row, c)).reshape(shape) for c in side}

    def known(self, i: int) -> np.ndarray:
        """Features that training part ``i`` keeps."""
        return ~np.isnan(self.side["sparse"][i, 0])

    def listed(self, i: int, g: int, left_out: bool) -> np.ndarray:
        return np.flatnonzero(((self.cell["fold"] == g) == left_out) & self.known(i)[self.cell["pos"]])

    def values(self, i: int, k: int, at: np.ndarray, left_out: bool = False) -> np.ndarray:
        """v of the cells at some positions, for model (i, k): z = v + base."""
        pos = self.cell["pos"][at]
        if not self.ranked:
            return self.side["a"][i, k, pos] * self.cell["value"][at]
        if left_out:
            return self.cell["new"][at, k] - self.side["base_new"][i, k, pos]
        n = list(self.size.values())[i]
        return (n + 1.0 - self.cell["rank"][at, i]) ** (self.nus[k] - 1.0) - self.side["r0"][i, k, pos]


class _TrainRows:
    """Training rows of a block for one fold left out: components, and residuals of the target per model."""

    def __init__(self, row, i: int, n_models: int, fits: dict) -> None:
        which = np.frombuffer(row.t_i, dtype="i4") == i
        self.idn = np.frombuffer(row.t_idn, dtype="i4")[which]
        ys = np.frombuffer(row.t_ys)[which]
        self.t = np.frombuffer(row.t_t).reshape(len(which), -1, n_models)[which]
        self.eps = np.stack([
            ys - sum((self.t[:, l, k] * c for l, c in enumerate(fits[i, k][0])), 0.0) for k in range(n_models)
        ])


class _Grid:
    def __init__(self, matrix, marked, params, nus, sizes, folds) -> None:
        self.params, self.sizes, self.nus = params, sizes, [float(x) for x in nus]
        self.gini = params.variant == "gini"
        # nu does not enter the covariance: one model stands for all.
        self.models = range(len(self.nus) if self.gini else 1)
        self.spark = matrix.rows.sparkSession
        found = marked.groupBy("fold", "label").count().collect()  # folds x classes
        classes = sorted({r["label"] for r in found if r["label"] is not None})
        if len(classes) != 2 or any(r["label"] is None for r in found):
            raise ValueError(f"need exactly 2 classes, got labels {classes}")
        self.size, self.known, known = {}, {}, []
        for g in folds:
            kept = [r for r in found if r["fold"] != g]
            n = float(sum(r["count"] for r in kept))
            sy = float(sum(r["count"] for r in kept if r["label"] == classes[1]))
            sd = math.sqrt(sy * (n - sy) / (n * (n - 1))) if params.standardize else 1.0
            mean = sy / n if params.standardize else 0.0
            self.size[int(g)], self.known[int(g)] = n, (sy, sy / n)
            known.append((g, n, sy, sy / n, sd, mean))
        groups = F.broadcast(self.spark.createDataFrame(
            known, "g int, g_n double, g_sy double, g_mean double, g_sd double, g_shift double"
        ))
        y = (F.col("label") == F.lit(classes[1])).cast("double").alias("y")
        rows = self._placed_rows(marked.select("id", "fold", y), sum(r["count"] for r in found))
        cells = materialize(matrix.cells.where("value <> 0").join(rows, "id"))
        each_fold = F.explode(F.array(*[F.lit(int(g)) for g in folds])).alias("g")
        self.rows = rows.select("*", each_fold).join(groups, "g").select(
            "g", "id", "fold", "y", "block", "idn", "rn",
            ((F.col("y") - F.col("g_shift")) / F.col("g_sd")).alias("ys"),
        )
        every = cells.select("fold", "feature", "value", "y", each_fold).join(groups, "g")
        index = self._features(every.where("fold <> g"))
        self.cells = materialize(
            weighted_join(cells, index, ["feature"], "nnz", ["id"], self.n_names)
            .select("block", "chunk", "pos", F.col("value").cast("double").alias("value"), "rn", "idn", "fold", "y")
            .groupBy("block", "chunk").applyInPandas(
                _pack_cells, "block int, chunk int, " + ", ".join(f"{c} binary" for c in [*CELL, "pos"])
            )
        )

    def _placed_rows(self, rows: DataFrame, n: int) -> DataFrame:
        """Rows with their ``block``, their number ``rn`` and that of their id ``idn`` in it; an id has one block."""
        cores = self.spark.sparkContext.defaultParallelism
        blocks = math.ceil(n / min(BLOCK_ROWS, max(LEAST_ROWS, n / (2 * cores))))
        key = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("id"))
        placed = rows.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int"))
        inside = W.partitionBy("block")
        return materialize(placed.select(
            "*", (F.dense_rank().over(inside.orderBy("id")) - 1).alias("idn"),
            (F.row_number().over(inside.orderBy("id", "fold", "y")) - 1).alias("rn"),
        ))

    # --- features and ranks -----------------------------------------------------------

    def _features(self, train: DataFrame) -> DataFrame:
        """Non-constant features of each training part; returns all of them with their place."""
        one, zero = F.lit(1.0), F.lit(0.0)
        scaled = self.params.standardize
        stats = stats_of_cells(train, F.col("g_n"), F.col("g_sy"), [*GROUP, "feature"])
        plain = materialize(stats.where("vmin <> vmax").select(
            *GROUP, "feature", "nnz", "sy",
            (1 / F.col("sd") if scaled else one).alias("a"),
            (-F.col("mean") / F.col("sd") if scaled else zero).alias("base"), "cov",
            (F.col("nnz") < F.col("g_n")).cast("double").alias("sparse"),
        ))
        names = plain.groupBy("feature").agg(F.sum("nnz").alias("nnz")).withColumn(
            "_k", shuffle_key(0, F.col("feature"))
        )
        numbered = row_numbers(names, [], ["_k", "feature"], shuffle_bucket(F.col("_k")), "_rn")
        num = (F.col("_rn") - 1).cast("int")
        index = materialize(numbered.select(
            "feature", "nnz", num.alias("num"), F.floor(num / WIDTH).cast("int").alias("chunk"),
            (num % WIDTH).alias("pos"),
        ))
        self.n_names = index.count()
        self.features = materialize(plain.join(index.drop("nnz"), "feature").drop("feature"))
        counts = self.features.groupBy("g").count().collect()  # one row per fold
        if len(counts) < len(self.size):
            raise ValueError("all features are constant")
        self.n_features = sum(r["count"] for r in counts)
        return index.drop("num")

    def _array(self, entry: Callable[[int], Column]) -> Column:
        return F.array(*[entry(k) for k in self.models])

    def _ranks(self) -> DataFrame:
        """(g, num, r0, base, base_new, ws): ranks of zeros and first weights; ``self.ranked`` holds the cells."""
        size, known, nus, centred = self.size, self.known, self.nus, self.params.center_ranks
        listed = self.cells.mapInPandas(
            _value_pieces, "num int, block int, " + ", ".join(f"{c} binary" for c in CELL)
        )
        pieces, cuts, parts = in_parts(
            listed, ["num"], CELL, sum(size.values()) / max(1, len(size) - 1), self.n_names
        )
        per_fold = lambda c: F.array(*[
            F.coalesce(F.max(F.when(F.col("g") == g, F.col(c))).cast("double"), F.lit(-1.0)) for g in size
        ]).alias(c)
        side = self.features.groupBy("num").agg(per_fold("nnz"), per_fold("sy"))
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        no_shift = zeros(len(size) * len(nus)).alias("shift")
        cut = F.lit(None).cast("array<double>") if cuts is None else F.col("cuts")
        if cuts is not None:
            side = side.join(materialize(cuts), "num", "left")
        each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        side = side.select("num", each, "nnz", "sy", cut.alias("cuts"), zeros(len(size)).alias("before"), no_shift)

        def run(what: str, schema: str) -> DataFrame:
            place = _Placing(what, size, known, nus, centred)
            found = pieces.groupBy("num", "part").cogroup(side.groupBy("num", "part"))
            return found.applyInPandas(lambda key, a, b: place(key, a, b), schema)

        if parts > 1:
            counts = materialize(run("count", "g int, num int, part int, cnt double"))
            earlier = W.partitionBy("g", "num").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
            carried = counts.select("*", F.coalesce(F.sum("cnt").over(earlier), F.lit(0.0)).alias("before"))
            side = side.drop("before").join(
                carried.groupBy("num", "part").agg(per_fold("before")), ["num", "part"], "left"
            ).withColumn("before", F.coalesce("before", zeros(len(size))))
        sums = ", ".join(f"{c} array<double>" for c in SUMS)
        found = run("sums", f"g int, num int, part int, {sums}, zero double")
        found = materialize(found.select("g", "num", "part", "zero", *[
            F.transform(c, _number).alias(c) for c in SUMS
        ]))
        shift = zeros(len(nus))
        if parts > 1 and centred:  # what the other ranges of the feature add to the mean rank
            by = W.partitionBy("g", "num").orderBy("part")
            over = {"low": by.rowsBetween(W.unboundedPreceding, -1), "high": by.rowsBetween(1, W.unboundedFollowing)}
            rest = lambda k: sum(
                (F.coalesce(F.sum(F.col(c)[k]).over(w), F.lit(0.0)) for c, w in over.items()), F.lit(0.0)
            )
            n = F.create_map(*[F.lit(x) for pair in size.items() for x in pair])[F.col("g")]
            found = materialize(found.withColumn("shift", self._array(lambda k: rest(k) / (n + 1.0))))
            shifts = found.groupBy("num", "part").agg(F.flatten(F.array(*[
                F.coalesce(F.max(F.when(F.col("g") == g, F.col("shift"))), zeros(len(nus))) for g in size
            ])).alias("shift"))
            side = side.drop("shift").join(shifts, ["num", "part"], "left").withColumn(
                "shift", F.coalesce("shift", zeros(len(size) * len(nus)))
            )
            shift = F.col("shift")
        if max(self.sizes) > 1:
            binaries = ", ".join(f"{c} binary" for c in [*RANKED, "rank", "new"])
            self.ranked = materialize(
                run("cells", f"block int, chunk int, pos int, {binaries}")
                .groupBy("block", "chunk").applyInPandas(_pack_ranked, f"block int, chunk int, pos binary, {binaries}")
            )
        total = lambda c, k: F.sum(F.col(c)[k])
        summed = found.withColumn("_shift", shift).groupBy("g", "num").agg(
            *[self._array(lambda k, c=c: total(c, k)).alias(c) for c in ("high", "cross", "r0")],
            self._array(lambda k: F.sum(F.col("new0")[k] - F.col("zero") * F.col("_shift")[k])).alias("base_new"),
        )
        mean = lambda k: F.col("high")[k] / F.col("g_n") if centred else F.lit(0.0)
        weight = lambda k: (
            F.lit(0.0) if self.nus[k] == 1  # all ranks to the power 0 are equal
            else -self.nus[k] * F.col("cross")[k] / ((F.col("g_n") - 1) * F.col("g_sd"))
        )
        groups = self.features.select("g", "num", "g_n", "g_sd")
        return materialize(summed.join(groups, ["g", "num"]).select(
            "g", "num", "r0", self._array(lambda k: F.col("r0")[k] - mean(k)).alias("base"), "base_new",
            self._array(weight).alias("ws"),
        ))

    # --- components -----------------------------------------------------------------

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        """Numbers per model as a table: folds x settings rows."""
        return F.broadcast(self.spark.createDataFrame(rows, schema))

    def _first_weights(self, ranks: DataFrame | None) -> DataFrame:
        """(g, k, num, chunk, pos, nnz, base, base_new, w) of the first component."""
        kept = [*GROUP, *PLACE, "nnz", "base", F.col("base").alias("base_new"), "a", "sparse"]
        if not self.gini:
            w = (F.col("cov") * F.col("a") / F.col("g_sd")).alias("w")
            return self.features.select(F.lit(0).alias("k"), *kept, w)
        return self.features.select(*kept).join(ranks.select("g", "num", "ws"), ["g", "num"]).select(
            *GROUP, *PLACE, "nnz", "base", "base_new", "a", "sparse", F.posexplode("ws").alias("k", "w")
        )

    def _form(self, ranks: DataFrame | None) -> DataFrame:
        """Features of every model, with z = v + base (base_new for rows that join the training rows)."""
        kept = [*GROUP, *PLACE, "nnz", "a", "sparse"]
        if not self.gini:
            base = F.col("base").alias("base_new")
            return self.features.select(*kept, F.lit(0).alias("k"), "base", base, F.lit(0.0).alias("r0"))
        zipped = F.arrays_zip("base", "base_new", "r0")
        return materialize(
            self.features.drop("base").join(ranks.drop("ws"), ["g", "num"])
            .select(*kept, F.posexplode(zipped).alias("k", "_z")).select(*kept, "k", "_z.*")
        )

    def _side(self, long: DataFrame, columns: Sequence[str]) -> DataFrame:
        """(chunk, columns): one array (models x WIDTH) each, NaN where a training part lacks the feature."""
        place, shape = {g: i for i, g in enumerate(self.size)}, (len(self.size), len(self.models), WIDTH)

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            at = group["g"].map(place).to_numpy(), group["k"].to_numpy(), group["pos"].to_numpy()
            out = group[["chunk"]].head(1)
            for c in columns:
                x = np.full(shape, np.nan)
                x[at] = group[c].to_numpy()
                out = out.assign(**{c: [x.tobytes()]})
            return out

        return long.select("g", "k", "chunk", "pos", *columns).groupBy("chunk").applyInPandas(
            pack, "chunk int, " + ", ".join(f"{c} binary" for c in columns)
        )

    def _beside(self, blocks: DataFrame, side: DataFrame) -> DataFrame:
        small = self.n_features * len(self.models) <= skew.BROADCAST_ROWS
        return blocks.join(F.broadcast(side) if small else side, "chunk")

    def _scored(self, raw: DataFrame, rows: DataFrame, ranked: bool, ts: list[str]) -> DataFrame:
        """Rows with the next component: one number per setting."""
        raw = materialize(raw)
        norm = F.sum(F.abs("w")) if self.gini else F.sqrt(F.sum(F.col("w") * F.col("w")))
        totals = raw.groupBy("g", "k").agg(
            norm.alias("norm"), F.sum(F.col("base") * F.col("w")).alias("shift"),
            F.sum(F.col("base_new") * F.col("w")).alias("shift_new"),
            *[F.sum(F.col(f"b_{t}") * F.col("w")).alias(f"p_{t}") for t in ts],
        ).collect()  # folds x settings
        got = {(r["g"], r["k"]): r for r in totals}
        names = ["norm", "shift", "shift_new", *[f"p_{t}" for t in ts]]
        numbers = [(g, *[[float(got[g, k][c] or 0.0) for k in self.models] for c in names]) for g in self.size]
        side = self._table(numbers, "g int, " + ", ".join(f"{c} array<double>" for c in names))
        columns = ["sparse", "w", *(["r0", "base_new"] if ranked else ["a"])]
        size, nus = self.size, self.nus[: len(self.models)]

        def by_id(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    block = _Block(row, size, nus, ranked, columns)
                    for i, g in enumerate(size):
                        parts = [(block.listed(i, g, out), out) for out in (False, True)]
                        at = np.concatenate([x for x, _ in parts])
                        ids, place = np.unique(block.cell["idn"][at], return_inverse=True)
                        s, pos = np.empty((len(ids), len(nus))), block.cell["pos"][at]
                        for k in range(len(nus)):
                            v = np.concatenate([block.values(i, k, x, out) for x, out in parts])
                            s[:, k] = np.bincount(place, v * block.side["w"][i, k, pos], len(ids))
                        yield pd.DataFrame({"g": g, "block": row.block, "idn": ids, "s": list(s)})

        blocks = self._beside(self.ranked if ranked else self.cells, self._side(raw, columns))
        sums = blocks.mapInPandas(by_id, "g int, block int, idn int, s array<double>").groupBy(
            "g", "block", "idn"
        ).agg(self._array(lambda k: F.sum(_number(F.col("s")[k]))).alias("_s"))

        def value(k: int) -> Column:
            shift = F.when(F.col("fold") == F.col("g"), F.col("shift_new")[k]).otherwise(F.col("shift")[k])
            taken = sum((F.col(t)[k] * F.col(f"p_{t}")[k] for t in ts), F.lit(0.0))
            size = F.when(F.col("norm")[k] == 0, 1.0).otherwise(F.col("norm")[k])
            return (F.coalesce(F.col("_s")[k], F.lit(0.0)) + shift - taken) / size

        t = f"t{len(ts) + 1}"
        return materialize(
            rows.join(sums, ["g", "block", "idn"], "left").join(side, "g").withColumn(t, self._array(value))
            .drop("_s", *names)
        )

    def _moments(self, rows: DataFrame, ts: list[str]) -> dict:
        """{(g, k): (inverse gram, coefficients, means, mean residual)} of the training rows."""
        long = rows.where("fold <> g").select("g", "ys", F.posexplode(F.arrays_zip(*ts)).alias("k", "t"))
        t = lambda name: F.col("t")[name]
        pairs = [(a, b) for i, a in enumerate(ts) for b in ts[i:]]
        found = long.groupBy("g", "k").agg(
            *[F.sum(t(a) * t(b)).alias(f"{a}_{b}") for a, b in pairs],
            *[F.sum(t(a) * F.col("ys")).alias(f"{a}_y") for a in ts],
            *[F.avg(t(a)).alias(f"{a}_m") for a in ts], F.avg("ys").alias("y_mean"),
        ).collect()  # folds x settings
        out = {}
        for r in found:
            gram = np.array([[r[f"{a}_{b}"] if i <= j else r[f"{b}_{a}"] for j, b in enumerate(ts)] for i, a in enumerate(ts)])
            inverse, means = np.linalg.pinv(gram), np.array([r[f"{a}_m"] for a in ts])
            c = inverse @ np.array([r[f"{a}_y"] for a in ts])
            out[r["g"], r["k"]] = inverse, c, means, r["y_mean"] - float(c @ means)
        return out

    def _with_train_rows(self, rows: DataFrame, ts: list[str]) -> DataFrame:
        """Blocks of cells beside their training rows, one for every chunk, with cells in it or not."""
        place = {g: i for i, g in enumerate(self.size)}

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            t = np.stack([np.stack(group[t].to_numpy()) for t in ts], axis=1)
            return group[["block"]].head(1).assign(
                t_i=[group["g"].map(place).to_numpy().astype("i4").tobytes()],
                t_idn=[group["idn"].to_numpy().astype("i4").tobytes()],
                t_ys=[group["ys"].to_numpy().astype("f8").tobytes()], t_t=[t.astype("f8").tobytes()],
            )

        packed = materialize(
            rows.where("fold <> g").select("block", "g", "idn", "ys", *ts).groupBy("block")
            .applyInPandas(pack, "block int, t_i binary, t_idn binary, t_ys binary, t_t binary")
        )
        cells = self.ranked.drop("new") if self.gini else self.cells
        chunks = F.broadcast(self.features.select("chunk").distinct())
        return packed.crossJoin(chunks).join(cells, ["block", "chunk"], "left")

    def _next_weights(self, rows, form, ts: list[str], moments: dict) -> DataFrame:
        """(g, k, num, .., b_t1.., w) of the next component from the residuals."""
        per_model = self._table(
            [
                (g, k, self.nus[k], *[[float(x) for x in v] for v in (c, m, inv.ravel())], float(e))
                for (g, k), (inv, c, m, e) in moments.items()
            ],
            "g int, k int, nu double, c array<double>, means array<double>, inv array<double>, eps_mean double",
        )
        h, size, nus, ranked = len(ts), self.size, self.nus[: len(self.models)], self.gini
        place = {g: i for i, g in enumerate(size)}
        fits = {(place[g], k): ([float(x) for x in c], float(e)) for (g, k), (_, c, _, e) in moments.items()}
        blocks = self._with_train_rows(rows, ts)
        columns = ["sparse", "r0" if ranked else "a"]
        names = [f"s_{x}" for x in [*ts, "eps", "v"]]

        def by_feature(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    block = _Block(row, size, nus, ranked, columns)
                    for i, g in enumerate(size):
                        train, at = _TrainRows(row, i, len(nus), fits), block.listed(i, g, False)
                        cell, r = _pairs(block.cell["idn"][at], train.idn)
                        pos = block.cell["pos"][at][cell]
                        found = np.unique(pos)
                        for k in range(len(nus)):
                            v = block.values(i, k, at)[cell]
                            sums = [
                                np.bincount(pos, x, WIDTH)[found]
                                for x in [*(v * train.t[r, l, k] for l in range(h)), v * train.eps[k][r], v]
                            ]
                            yield pd.DataFrame({
                                "g": g, "k": k, "num": row.chunk * WIDTH + found, **dict(zip(names, sums))
                            })

        sums = self._beside(blocks, self._side(form, columns)).mapInPandas(
            by_feature, "g int, k int, num int, " + ", ".join(f"{x} double" for x in names)
        ).groupBy("g", "k", "num").agg(*[F.sum(_number(F.col(x))).alias(x) for x in names])
        z = form.join(sums, ["g", "k", "num"], "left").na.fill(0.0, names).join(per_model, ["g", "k"])
        n, base = F.col("g_n"), F.col("base")
        tx = [F.col(f"s_{t}") + base * F.col("means")[i] * n for i, t in enumerate(ts)]
        b = [
            sum((tx[i] * F.col("inv")[l * h + i] for i in range(h)), F.lit(0.0)).alias(f"b_{t}")
            for l, t in enumerate(ts)
        ]
        loads = z.select(
            *GROUP, "k", *PLACE, "nnz", "base", "base_new", "a", "r0", "sparse", "means", "eps_mean", *b,
            (F.col("s_eps") + base * F.col("eps_mean") * n).alias("z_eps"), (F.col("s_v") / n + base).alias("z_mean"),
        )
        if not self.gini:
            pull = sum((F.col(f"b_{t}") * F.col("means")[i] for i, t in enumerate(ts)), F.lit(0.0))
            mean = F.col("z_mean") - pull
            return loads.withColumn("w", (F.col("z_eps") - n * mean * F.col("eps_mean")) / (n - 1))
        loads = materialize(loads)
        w = self._residual_weights(blocks, loads, ts, fits)
        return loads.join(w, ["g", "k", "num"], "left").na.fill(0.0, ["w"])

    def _residual_weights(self, blocks: DataFrame, loads: DataFrame, ts: list[str], fits: dict) -> DataFrame:
        """(g, k, num, w): rank covariance of residuals, of every row and feature; 0 (left out) for nu = 1."""
        bs = [f"b_{t}" for t in ts]
        columns = ["sparse", "r0", "base", *bs]
        size, nus = self.size, self.nus
        ranking = [k for k, nu in enumerate(nus) if nu != 1]

        def residuals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    block = _Block(row, size, nus, True, columns)
                    for i, g in enumerate(size):
                        train, at = _TrainRows(row, i, len(nus), fits), block.listed(i, g, False)
                        cell, r = _pairs(block.cell["idn"][at], train.idn)
                        order = np.argsort(block.cell["pos"][at][cell], kind="stable")
                        cell, r = cell[order], r[order]
                        pos = block.cell["pos"][at][cell]
                        ends = np.searchsorted(pos, np.arange(WIDTH + 1))
                        sparse = block.side["sparse"][i, 0] == 1
                        for k in ranking:
                            dev = train.eps[k] - fits[i, k][1]
                            taken = sum(
                                (block.side[b][i, k][:, None] * train.t[None, :, l, k] for l, b in enumerate(bs)), 0.0
                            )
                            at_zero = block.side["base"][i, k][:, None] - taken
                            own = _rounded(block.values(i, k, at)[cell] + at_zero[pos, r])
                            out = []
                            for f in np.flatnonzero(block.known(i)):
                                rs = r[ends[f] : ends[f + 1]]
                                value, s, cnt = own[ends[f] : ends[f + 1]], dev[rs], np.ones(len(rs), dtype="i4")
                                if sparse[f]:  # rows without a cell
                                    missing = 1 - np.bincount(rs, minlength=len(dev))
                                    rest = np.flatnonzero(missing)
                                    value = np.append(value, _rounded(at_zero[f, rest]))
                                    s = np.append(s, missing[rest] * dev[rest])
                                    cnt = np.append(cnt, missing[rest])
                                if len(value):
                                    merged = zip(RESIDUAL.items(), _merged(value, s, cnt))
                                    piece = {c: coded(x, kind) for (c, kind), x in merged}
                                    out.append({"g": g, "k": k, "num": row.chunk * WIDTH + int(f), **piece})
                            yield pd.DataFrame(out, columns=["g", "k", "num", *RESIDUAL])

        def ranked(key, pieces: pd.DataFrame, side: pd.DataFrame | None = None) -> pd.DataFrame:
            g, k, num, part = (int(x) for x in key)
            _, s, cnt = _merged(*joined(pieces, RESIDUAL).values())
            s, cnt = s[cnt > 0], cnt[cnt > 0]
            before = 0.0 if side is None else float(side["before"].iloc[0])
            down = size[g] + 1.0 - (before + np.cumsum(cnt) - cnt + (cnt + 1) / 2.0)
            cov = float((down ** (nus[k] - 1.0) * s).sum()) / (size[g] - 1)
            return pd.DataFrame([(g, k, num, part, float(cnt.sum()), cov)], columns=["g", "k", "num", "part", "n", "cov"])

        listed = self._beside(blocks, self._side(loads, columns)).mapInPandas(
            residuals, "g int, k int, num int, " + ", ".join(f"{c} binary" for c in RESIDUAL)
        )
        keys, schema = ["g", "k", "num"], "g int, k int, num int, part int, n double, cov double"
        pieces, _, parts = in_parts(
            listed, keys, RESIDUAL, max(size.values()), self.n_features * len(nus)
        )
        grouped = pieces.groupBy(*keys, "part")
        found = grouped.applyInPandas(lambda key, x: ranked(key, x), schema)
        if parts > 1:  # the rows of each range first: they shift the ranks of the next ones
            earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
            side = materialize(found).select(
                *keys, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0.0)).alias("before")
            )
            found = grouped.cogroup(side.groupBy(*keys, "part")).applyInPandas(
                lambda key, x, y: ranked(key, x, y), schema
            )
        nu = F.array(*[F.lit(x) for x in nus])[F.col("k")]
        return found.groupBy(*keys).agg(F.sum(_number(F.col("cov"))).alias("cov")).select(*keys, (-nu * F.col("cov")).alias("w"))

    def scores(self) -> DataFrame:
        h, ranks = max(self.sizes), self._ranks() if self.gini else None
        form = self._form(ranks) if h > 1 else None
        raw, rows, ts, fits = self._first_weights(ranks), self.rows, [], []
        for j in range(h):
            rows = self._scored(raw, rows, self.gini and j > 0, ts)
            ts.append(f"t{j + 1}")
            fits.append(self._moments(rows, ts))
            if j + 1 < h:
                raw = self._next_weights(rows, form, ts, fits[j])
        return self._macro_f1(rows, ts, fits)

    def _macro_f1(self, rows: DataFrame, ts: list[str], fits: list[dict]) -> DataFrame:
        numbers = [
            (g, [[[float(x) for x in fit[g, k][1]] for fit in fits] for k in self.models],
             [[float(fit[g, k][1] @ fit[g, k][2]) for fit in fits] for k in self.models])
            for g in self.size
        ]
        side = self._table(numbers, "g int, c array<array<array<double>>>, threshold array<array<double>>")

        def choice(i: int, h: int) -> Column:
            k = i if self.gini else 0
            score = sum((F.col(t)[k] * F.col("c")[k][h - 1][l] for l, t in enumerate(ts[:h])), F.lit(0.0))
            reached = (score >= F.col("threshold")[k][h - 1]).cast("int")
            return F.struct(F.lit(self.nus[i]).alias("nu"), F.lit(h).alias("n_comp"), reached.alias("y_pred"))

        choices = F.array(*[choice(i, h) for i in range(len(self.nus)) for h in self.sizes])
        guesses = rows.where("fold = g").join(side, "g").select(
            "fold", F.col("y").cast("int").alias("y_true"), F.inline(choices)
        )
        by = ["nu", "n_comp", "fold"]
        f1 = per_class(guesses, by).where("class in (0, 1)").groupBy(*by)
        return materialize(f1.agg((F.sum("f1") / 2.0).alias("score")))
