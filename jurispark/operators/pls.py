"""Partial-least-squares classifiers on sparse matrices.

Four ways to weigh features: covariance with the label (``standard``), covariance of
descending ranks (``gini``), logistic coefficients of values (``logit``) or of ranks
(``logit_gini``).

Nothing the size of rows x features is stored.  A feature is z = a * v + base with v
listed for nonzero cells only, so centred data keeps its zeros implicit; residuals
follow from z and the components, T[j+1] = Z w - T (B w).  The driver holds numbers
per pair of components, never per row or feature.  The one dense step is the second
and later weights of the rank and logistic variants: their definition ranks (or fits)
residuals, which have no zeros.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import value_bucket
from ..sources.scratch import materialize, materialize_with
from . import ranks
from .logit import grouped_logistic, settled
from .matrix import Matrix, stats_of_cells
from .skew import BROADCAST_ROWS, running_totals, weighted_join

VARIANTS = ("standard", "gini", "logit", "logit_gini")
# Residuals are compared after rounding to this many digits, so that rows with equal
# contents tie although their sums were added up in different orders.
RESIDUAL_DIGITS = 10


def dot(names: list[str], factors) -> Column:
    """Sum of columns times numbers."""
    return sum((F.col(c) * F.lit(float(x)) for c, x in zip(names, factors)), F.lit(0.0))


@dataclass
class _Training:
    """What all rounds of a fit share."""

    n: float
    sy: float
    y_mean: float
    y_sd: float
    classes: list
    rows: DataFrame  # id, y (0/1), ys (as used by the regressions)
    cells: DataFrame  # id, feature, value, y: nonzero cells
    features: DataFrame  # feature, nnz, a, base, cov: non-constant features
    n_features: int
    ladder: DataFrame | None = None  # feature, value, cnt, sy, rank, r
    n_values: int = 0
    rank_cells: DataFrame | None = None  # id, feature, v
    rank_form: DataFrame | None = None  # feature, a, base


@dataclass(frozen=True)
class PLS:
    """Settings; ``fit`` returns the model."""

    variant: str = "standard"
    n_components: int = 10
    nu: float = 2.0
    standardize: bool = True
    center_ranks: bool = True
    use_vip: bool = False
    vip_threshold: float = 1.0

    def __post_init__(self) -> None:
        if self.variant not in VARIANTS:
            raise ValueError(f"unknown variant {self.variant!r}; known: {VARIANTS}")
        if self.n_components < 1:
            raise ValueError("n_components must be at least 1")
        if self.nu <= 0:
            raise ValueError("nu must be positive")

    @property
    def uses_ranks(self) -> bool:
        return self.variant in ("gini", "logit_gini")

    # --- preparation -----------------------------------------------------------

    def _prepare(self, matrix: Matrix) -> _Training:
        found = matrix.rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(3).collect()
        sizes = {r["label"]: r["n"] for r in found}
        if len(sizes) != 2 or None in sizes:
            raise ValueError(f"need exactly 2 classes, got labels {list(sizes)}")
        classes = sorted(sizes)
        n, sy = float(sum(sizes.values())), float(sizes[classes[1]])
        y_mean, y_sd = sy / n, math.sqrt(sy * (n - sy) / (n * (n - 1)))
        y = (F.col("label") == F.lit(classes[1])).cast("double")
        ys = (y - F.lit(y_mean)) / F.lit(y_sd) if self.standardize else y
        rows = materialize(matrix.rows.select("id", y.alias("y"), ys.alias("ys")))
        cells = materialize(
            matrix.cells.where("value <> 0").join(rows.select("id", "y"), "id")
        )
        one, zero = F.lit(1.0), F.lit(0.0)
        stats = stats_of_cells(cells, n, sy).where("vmin <> vmax").select(
            "feature",
            "nnz",
            "sy",
            (1 / F.col("sd") if self.standardize else one).alias("a"),
            (-F.col("mean") / F.col("sd") if self.standardize else zero).alias("base"),
            "cov",
        )
        # Residual variants address features by number (see _residuals).
        if self.variant != "standard" and self.n_components > 1:
            stats = _numbered(materialize(stats))
        features, seen = materialize_with(stats, F.count(F.lit(1)).alias("k"))
        prep = _Training(n, sy, y_mean, y_sd, classes, rows, cells, features, seen["k"])
        if prep.n_features == 0:
            raise ValueError("all features are constant")
        if self.variant != "standard":
            plain = ranks.value_ladder(cells, features, n, sy)
            known = features.select("feature")
            if prep.n_features <= BROADCAST_ROWS:
                known = F.broadcast(known)
            plain = plain.join(known, "feature", "left_semi")
            if self.uses_ranks:
                plain = ranks.with_rank(plain).withColumn(
                    "r", ranks.gini_rank(F.col("rank"), n, self.nu)
                )
            prep.ladder, seen = materialize_with(plain, F.count(F.lit(1)).alias("n"))
            prep.n_values = seen["n"]
        if self.uses_ranks and self.n_components > 1:
            self._prepare_rank_form(prep)
        return prep

    def _prepare_rank_form(self, prep: _Training) -> None:
        """Ranks as z = v + base: v is 0 on zero cells, base is their (centred) rank."""
        at_zero = F.max(F.when(F.col("value") == 0, F.col("r")))
        mean = F.sum(F.col("cnt") * F.col("r")) / prep.n if self.center_ranks else F.lit(0.0)
        form = materialize(
            prep.ladder.groupBy("feature").agg(
                F.coalesce(at_zero, F.lit(0.0)).alias("at_zero"), mean.alias("_mean")
            )
        )
        prep.rank_form = form.select(
            "feature", F.lit(1.0).alias("a"), (F.col("at_zero") - F.col("_mean")).alias("base")
        )
        found = ranks.cell_ranks(
            prep.cells.select("id", "feature", "value"),
            prep.ladder.select("feature", "value", "r", "cnt"),
            prep.n_values,
        )
        weights = prep.features.select("feature", "nnz")
        placed = weighted_join(
            found, form.select("feature", "at_zero").join(weights, "feature"), ["feature"], "nnz",
            ["id"], prep.n_features,
        )
        prep.rank_cells = materialize(
            placed.select("id", "feature", (F.col("r") - F.col("at_zero")).alias("v"))
        )

    # --- weights ---------------------------------------------------------------

    def _first_weights(self, prep: _Training, features: DataFrame) -> DataFrame:
        """(feature, w): raw weights of the first component."""
        y_sd = prep.y_sd if self.standardize else 1.0
        if self.variant == "standard":
            w = (F.col("cov") * F.col("a") / y_sd).alias("w")
            return features.select("feature", "nnz", "a", "base", w)
        ladder = prep.ladder
        if self.variant == "gini":
            cross = F.col("r") * (F.col("sy") - F.col("cnt") * prep.y_mean)
            # Ranks to the power 0 are all equal: no covariance, not rounding noise either.
            cov = F.lit(0.0) if self.nu == 1 else F.sum(cross) / ((prep.n - 1) * y_sd)
            return (
                ladder.groupBy("feature").agg((-self.nu * cov).alias("w"))
                .join(features.select("feature"), "feature")
            )
        z = F.col("r") if self.uses_ranks else F.col("a") * F.col("value") + F.col("base")

        def observations(params: DataFrame) -> DataFrame:
            return self._with_features(ladder, params, prep, weight=False).withColumn("z", z)

        fitted = settled(grouped_logistic(
            features.select("feature", "a", "base"), observations, [F.col("z")]
        ))
        return fitted.select("feature", F.col("beta")[1].alias("w"))

    def _next_weights(
        self, prep: _Training, cells: DataFrame, rows: DataFrame, ts: list[str], moments: dict,
        eps_mean: float, loads: DataFrame,
    ) -> DataFrame:
        """(feature, w): raw weights of the next component from the residuals."""
        if self.variant == "standard":
            n = prep.n
            # sum(RES * eps) = sum(z * eps): eps is orthogonal to the components.
            res_mean = F.col("z_mean") - dot([f"b_{t}" for t in ts], moments["means"])
            cov = (F.col("z_eps") - n * res_mean * eps_mean) / (n - 1)
            return loads.withColumn("w", cov)
        loads = materialize(loads)
        if self.variant == "gini":
            raw = self._residual_rank_weights(prep, rows, cells, loads, ts, eps_mean)
        else:

            def observations(params: DataFrame) -> DataFrame:
                return self._residuals(prep, rows, cells, params, ts)

            fitted = settled(grouped_logistic(
                loads.select("feature", "fidx", "nnz", "a", "base", *[f"b_{t}" for t in ts]),
                observations,
                [F.col("res"), *[F.col(t) for t in ts]],
            ))
            second = F.col("beta")[1] if self.variant == "logit" else F.col("beta")[2]
            raw = fitted.select("feature", F.col("beta")[1].alias("w"), second.alias("w_extra"))
        return loads.join(raw, "feature")

    def _with_features(
        self, left: DataFrame, features: DataFrame, prep: _Training, weight: bool = True
    ) -> DataFrame:
        """Join rows that name a feature with the feature table."""
        if prep.n_features <= BROADCAST_ROWS:
            return left.join(F.broadcast(features), "feature")
        if weight and "nnz" in features.columns:
            extra = features.withColumn("_w", F.col("nnz"))
            return weighted_join(left, extra, ["feature"], "_w", ["id"])
        return left.join(features, "feature")

    def _residuals(
        self, prep: _Training, rows: DataFrame, cells: DataFrame, table: DataFrame, ts: list[str]
    ) -> DataFrame:
        """All residuals as (columns of table, cnt, sy, res, eps, components).

        Every row gets the residual it would have with a zero cell; each nonzero cell
        takes that one back (cnt = -1) and adds its own.
        """
        res0 = F.col("base") - sum((F.col(t) * F.col(f"b_{t}") for t in ts), F.lit(0.0))
        k = prep.n_features
        every = rows.withColumn("fidx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        side = F.broadcast(table) if k <= BROADCAST_ROWS else table
        base = every.join(side, "fidx").select(
            *table.columns, *ts, "y", "eps", F.lit(1).alias("cnt"), res0.alias("res")
        )
        listed = self._with_features(cells.join(rows, "id"), table, prep)
        res = F.col("a") * F.col("v") + res0
        signed = F.explode(
            F.array(
                F.struct(F.lit(-1).alias("cnt"), res0.alias("res")),
                F.struct(F.lit(1).alias("cnt"), res.alias("res")),
            )
        )
        fixes = listed.withColumn("_s", signed).select(
            *table.columns, *ts, "y", "eps", "_s.cnt", "_s.res"
        )
        return (
            base.unionByName(fixes)
            .withColumn("res", F.round("res", RESIDUAL_DIGITS))
            .withColumn("sy", F.col("cnt") * F.col("y"))
        )

    def _residual_rank_weights(
        self, prep: _Training, rows: DataFrame, cells: DataFrame, loads: DataFrame, ts: list[str],
        eps_mean: float,
    ) -> DataFrame:
        ladder = (
            self._residuals(
                prep, rows, cells,
                loads.select("feature", "fidx", "nnz", "a", "base", *[f"b_{t}" for t in ts]), ts,
            )
            .groupBy("feature", (F.col("res") + 0.0).alias("value"))
            .agg(
                F.sum("cnt").alias("cnt"),
                F.sum(F.col("cnt") * (F.col("eps") - eps_mean)).alias("s"),
            )
            .where("cnt > 0")
        )
        # Written once: the running totals read it twice, and it is the dense step.
        ranked = running_totals(
            materialize(ladder), ["feature"], "value", ["cnt"], value_bucket(F.col("value"))
        )
        rank = F.col("cnt_before") + (F.col("cnt") + 1) / 2.0
        v = ranks.gini_rank(rank, prep.n, self.nu)
        cov = F.lit(0.0) if self.nu == 1 else F.sum(v * F.col("s")) / (prep.n - 1)
        return ranked.groupBy("feature").agg((-self.nu * cov).alias("w"))

    def _normalise(self, raw: DataFrame, ts: list[str]) -> tuple[DataFrame, float, float, list[float]]:
        """Write raw weights; return them with their norm and the sums the scores need.

        The norm is 1 if all weights are 0.  The sums are those of base * w and of
        b_t * w for each earlier component, all taken while writing.
        """
        if self.variant == "gini":
            norm = F.sum(F.abs("w"))
        elif self.variant in ("logit", "logit_gini") and ts:
            norm = F.sqrt(F.sum(F.col("w") * F.col("w") + F.col("w_extra") * F.col("w_extra")))
        else:
            norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
        table, seen = materialize_with(
            raw,
            norm.alias("norm"),
            F.sum(F.col("base") * F.col("w")).alias("offset"),
            *[F.sum(F.col(f"b_{t}") * F.col("w")).alias(t) for t in ts],
        )
        size = seen["norm"] or 1.0
        return table, size, (seen["offset"] or 0.0) / size, [(seen[t] or 0.0) / size for t in ts]

    # --- components ------------------------------------------------------------

    def _components(self, prep: _Training, features: DataFrame) -> dict:
        """Fit all components on the given features."""
        more = [c for c in ("fidx",) if c in features.columns]
        x_form = features.select("feature", "nnz", "a", "base", *more)
        x_cells = prep.cells.select("id", "feature", F.col("value").alias("v"))
        z_form, z_cells = x_form, x_cells
        if self.uses_ranks and self.n_components > 1:
            z_form = prep.rank_form.join(features.select("feature", "nnz", *more), "feature")
            z_cells = prep.rank_cells
        rows, ts, h = prep.rows, [], self.n_components
        steps = np.zeros((h, h))  # steps[a, j]: what component j takes off per unit of T_a
        offsets, coefs, weights = [], [], None
        raw = x_form.join(self._first_weights(prep, features).select("feature", "w"), "feature")
        if self.variant == "standard":  # a function of the feature table itself
            raw = self._first_weights(prep, features)
        for j in range(h):
            t, w = f"t{j + 1}", f"w{j + 1}"
            raw, norm, offset, pulls = self._normalise(raw, ts)
            steps[:j, j] = pulls
            offsets.append(offset)
            side = raw.select("feature", "nnz", "a", "base", (F.col("w") / norm).alias(w))
            # The model keeps the linear form of the values, not that of the ranks.
            scaled = side.select("feature", w)
            weights = (
                side if j == 0 else weights.join(scaled, "feature")
            )
            score = self._with_features(x_cells if j == 0 else z_cells, side, prep)
            sums = score.groupBy("id").agg(
                F.sum(F.col("a") * F.col("v") * F.col(w)).alias("_s")
            )
            value = F.coalesce("_s", F.lit(0.0)) + offset - dot(ts, pulls)
            grown = rows.join(sums, "id", "left").withColumn(t, value).drop("_s")
            ts.append(t)
            rows, moments = _with_moments(grown, ts)
            inverse = np.linalg.pinv(moments["gram"])
            c = inverse @ moments["ty"]
            coefs.append([float(x) for x in c])
            if j + 1 == h:
                break
            means = moments["means"]
            eps_mean = moments["y_mean"] - float(c @ means)
            rows_eps = rows.withColumn("eps", F.col("ys") - dot(ts, c))
            joined = self._with_features(z_cells.join(rows_eps, "id"), z_form.select("feature", "nnz"), prep)
            sums = joined.groupBy("feature").agg(
                *[F.sum(F.col("v") * F.col(x)).alias(f"s_{x}") for x in ts],
                F.sum(F.col("v") * F.col("eps")).alias("s_eps"),
                F.sum("v").alias("s_v"),
            )
            z = z_form.join(sums, "feature", "left").na.fill(0.0)
            tx = [
                F.col("a") * F.col(f"s_{x}") + F.col("base") * float(m * prep.n)
                for x, m in zip(ts, means)
            ]
            b = [
                sum((tx[i] * float(inverse[l, i]) for i in range(len(ts))), F.lit(0.0)).alias(f"b_{x}")
                for l, x in enumerate(ts)
            ]
            loads = z.select(
                "feature", "nnz", "a", "base", *more, *b,
                (F.col("a") * F.col("s_eps") + F.col("base") * (eps_mean * prep.n)).alias("z_eps"),
                (F.col("a") * F.col("s_v") / prep.n + F.col("base")).alias("z_mean"),
            )
            raw = self._next_weights(prep, z_cells, rows_eps, ts, moments, eps_mean, loads)
        return {
            "weights": weights if h == 1 else materialize(weights),
            "rows": rows, "coefs": coefs, "steps": steps, "offsets": offsets,
            "threshold": float(np.dot(coefs[-1], moments["means"])), "moments": moments,
        }

    def fit(self, matrix: Matrix) -> PLSModel:
        """Fit on a matrix whose labels have two values; the larger one is class 1."""
        prep = self._prepare(matrix)
        features = prep.features
        while True:
            fitted = self._components(prep, features)
            if not self.use_vip:
                break
            kept = materialize(
                vip(fitted["weights"], fitted["moments"], prep.n_features)
                .where(F.col("vip_sum") >= self.vip_threshold)
                .select("feature")
            )
            n_kept = kept.count()
            if n_kept < self.n_components or n_kept == prep.n_features:
                break
            features = materialize(features.join(kept, "feature", "left_semi"))
            if "fidx" in features.columns:
                features = materialize(_numbered(features.drop("fidx")))
            prep.n_features = n_kept
        powers = None
        if self.uses_ranks and self.n_components > 1:
            powers = ranks.ladder_powers(prep.ladder, prep.n, self.nu)
            if self.use_vip:
                powers = powers.join(features.select("feature"), "feature", "left_semi")
        return PLSModel(
            params=self,
            classes=prep.classes,
            n=prep.n,
            n_features=prep.n_features,
            weights=fitted["weights"],
            coefficients=fitted["coefs"],
            steps=[[float(x) for x in row] for row in fitted["steps"]],
            offsets=fitted["offsets"],
            threshold=fitted["threshold"],
            powers=powers,
            train_rows=fitted["rows"],
            moments={k: np.asarray(v).tolist() for k, v in fitted["moments"].items()},
        )


def _numbered(table: DataFrame) -> DataFrame:
    """Add ``fidx`` 0..k-1 by hash order of the feature, without sorting in one task."""
    from ..functions.ordering import shuffle_bucket, shuffle_key
    from .skew import row_numbers

    keyed = table.withColumn("_k", shuffle_key(0, F.col("feature"))).withColumn("_g", F.lit(0))
    out = row_numbers(keyed, ["_g"], ["_k", "feature"], shuffle_bucket(F.col("_k")), "_rn")
    return out.withColumn("fidx", (F.col("_rn") - 1).cast("int")).drop("_rn", "_k", "_g")


def _with_moments(rows: DataFrame, ts: list[str]) -> tuple[DataFrame, dict]:
    """Write the rows and take the sums that the small systems need: h * h numbers."""
    pairs = [(a, b) for i, a in enumerate(ts) for b in ts[i:]]
    rows, got = materialize_with(
        rows,
        *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs],
        *[F.sum(F.col(a) * F.col("ys")).alias(f"{a}_y") for a in ts],
        *[F.avg(a).alias(f"{a}_m") for a in ts],
        F.avg("ys").alias("y_mean"),
        F.sum(F.col("ys") * F.col("ys")).alias("yy"),
        F.count(F.lit(1)).alias("n"),
    )
    gram = np.zeros((len(ts), len(ts)))
    for a, b in pairs:
        i, k = ts.index(a), ts.index(b)
        gram[i, k] = gram[k, i] = got[f"{a}_{b}"]
    return rows, {
        "gram": gram,
        "ty": np.array([got[f"{a}_y"] for a in ts]),
        "means": np.array([got[f"{a}_m"] for a in ts]),
        "y_mean": got["y_mean"],
        "yy": got["yy"],
        "n": got["n"],
    }


def fit_statistics(rows: DataFrame, gram: np.ndarray, coefs: list[list[float]], yy: float) -> list[tuple]:
    """[(component, r2, q2, rss, press)] of the models with 1..h components, in one pass.

    PRESS is the leave-one-out error through leverages; a row that alone carries a
    direction (leverage 1) has none, and PRESS and Q2 are None then.  From the second
    component on, Q2 compares with the RSS of the same component.
    """
    sums = []
    for j, c in enumerate(coefs):
        ts = [f"t{i + 1}" for i in range(j + 1)]
        inverse = np.linalg.pinv(np.asarray(gram)[: j + 1, : j + 1])
        leverage = sum(
            (
                F.col(a) * F.col(b) * float(inverse[i, k])
                for i, a in enumerate(ts)
                for k, b in enumerate(ts)
            ),
            F.lit(0.0),
        )
        fit, left = dot(ts, c), 1 - leverage
        eps = F.col("ys") - fit
        sums += [
            F.sum(eps * eps).alias(f"rss_{j}"),
            F.sum(fit * fit).alias(f"ess_{j}"),
            F.sum(F.when(left > 1e-9, (eps / left) * (eps / left))).alias(f"press_{j}"),
            F.count_if(left <= 1e-9).alias(f"undefined_{j}"),
        ]
    got = rows.agg(*sums).first()
    out = []
    for j in range(len(coefs)):
        rss, ess = got[f"rss_{j}"], got[f"ess_{j}"]
        press = None if got[f"undefined_{j}"] else got[f"press_{j}"]
        total = yy if j == 0 else rss
        q2 = None if press is None or not total else 1 - press / total
        out.append((j + 1, ess / (ess + rss), q2, rss, press))
    return out


def vip(weights: DataFrame, moments: dict, n_features: int) -> DataFrame:
    """(feature, vip1.., vip_sum): importance of each feature after 1..h components.

    A component counts by how well it explains the label; a feature by its squared
    weight in it.
    """
    n = moments["n"]
    gram, ty, means = (np.asarray(moments[x]) for x in ("gram", "ty", "means"))
    tt = np.diag(gram)
    yy, ym = moments["yy"], moments["y_mean"]
    explained = np.divide(ty**2, tt * yy, out=np.zeros_like(ty), where=tt * yy > 0)
    cov = ty - n * means * ym
    spread = (tt - n * means**2) * (yy - n * ym**2)
    corr2 = np.divide(cov**2, spread, out=np.zeros_like(ty), where=spread > 0)
    sofar = np.cumsum(corr2)
    names = [f"vip{s + 1}" for s in range(len(ty))]
    columns = []
    for s, name in enumerate(names):
        scale = n_features / sofar[s] if sofar[s] else 0.0
        columns.append(
            sum(
                (F.col(f"w{l + 1}") ** 2 * float(scale * explained[l]) for l in range(s + 1)),
                F.lit(0.0),
            ).alias(name)
        )
    return weights.select("feature", *columns).withColumn(
        "vip_sum", sum((F.col(x) for x in names), F.lit(0.0))
    )


@dataclass(frozen=True)
class PLSModel:
    """A fitted classifier: per-feature weights as a table, the rest as a few numbers."""

    params: PLS
    classes: list
    n: float
    n_features: int
    weights: DataFrame  # feature, nnz, a, base, w1..wh
    coefficients: list[list[float]]  # regression of the label on 1, 2, .. h components
    steps: list[list[float]]
    offsets: list[float]  # score of a row without cells, per component
    threshold: float
    powers: DataFrame | None = None  # train ladder of the rank variants
    train_rows: DataFrame | None = None  # id, y, ys, t1..th
    moments: dict | None = None

    @property
    def components(self) -> list[str]:
        return [f"t{j + 1}" for j in range(self.params.n_components)]

    def first(self, h: int) -> PLSModel:
        """The model with the first ``h`` components only.

        Components do not depend on how many follow, so this equals a fit with ``h``
        (unless features were eliminated).
        """
        if not 1 <= h <= self.params.n_components:
            raise ValueError(f"need 1 to {self.params.n_components} components, got {h}")
        m = dict(self.moments)
        m["gram"] = [row[:h] for row in m["gram"][:h]]
        m["ty"], m["means"] = m["ty"][:h], m["means"][:h]
        later = [f"w{j + 1}" for j in range(h, self.params.n_components)]
        dropped = [f"t{j + 1}" for j in range(h, self.params.n_components)]
        return replace(
            self,
            params=replace(self.params, n_components=h),
            weights=self.weights.drop(*later),
            coefficients=self.coefficients[:h],
            steps=[row[:h] for row in self.steps[:h]],
            offsets=self.offsets[:h],
            threshold=float(np.dot(self.coefficients[h - 1], m["means"])),
            train_rows=self.train_rows and self.train_rows.drop(*dropped),
            moments=m,
        )

    def component_scores(self, matrix: Matrix) -> dict[int, float]:
        """{h: macro F1} of the models with 1..h components, from one projection."""
        from .metrics import per_class

        means = self.moments["means"]
        choices = []
        for j, c in enumerate(self.coefficients):
            reached = dot(self.components[: j + 1], c) >= float(np.dot(c, means[: j + 1]))
            choices.append(
                F.struct(F.lit(j + 1).alias("h"), reached.cast("int").alias("y_pred"))
            )
        table = self.transform(matrix).select(
            (F.col("label") == F.lit(self.classes[1])).cast("int").alias("y_true"),
            F.inline(F.array(*choices)),
        )
        rows = per_class(table, ["h"]).where("class in (0, 1)").collect()
        return {
            j + 1: sum(r["f1"] for r in rows if r["h"] == j + 1) / 2.0
            for j in range(self.params.n_components)
        }

    def vip(self) -> DataFrame:
        """Importance of the features the model kept."""
        return vip(self.weights, self.moments, self.n_features)

    def fit_table(self, spark: SparkSession) -> DataFrame:
        """(component, r2, q2, rss, press): how well 1..h components fit the training label."""
        rows = fit_statistics(
            self.train_rows, self.moments["gram"], self.coefficients, self.moments["yy"]
        )
        return spark.createDataFrame(
            rows, "component int, r2 double, q2 double, rss double, press double"
        )

    def loadings(self, matrix: Matrix) -> DataFrame:
        """(feature, b_t1..): regression of each standardised feature on the components."""
        ts = self.components
        inverse = np.linalg.pinv(np.asarray(self.moments["gram"]))
        means = self.moments["means"]
        joined = matrix.cells.where("value <> 0").join(self.train_rows.select("id", *ts), "id")
        sums = joined.groupBy("feature").agg(
            *[F.sum(F.col("value") * F.col(t)).alias(f"s_{t}") for t in ts]
        )
        tx = [
            F.col("a") * F.col(f"s_{t}") + F.col("base") * float(m * self.n)
            for t, m in zip(ts, means)
        ]
        return self.weights.join(sums, "feature").select(
            "feature",
            *[
                sum((x * float(inverse[l, i]) for i, x in enumerate(tx)), F.lit(0.0)).alias(f"b_{t}")
                for l, t in enumerate(ts)
            ],
        )

    def transform(self, matrix: Matrix) -> DataFrame:
        """(id, label, t1..th): rows in the space of the components."""
        h = self.params.n_components
        cells = matrix.cells.where("value <> 0")
        # First component of the rank variants, all components of the others.
        last = 1 if self.params.uses_ranks else h
        table = self.weights
        ws = [f"w{j + 1}" for j in range(h)]
        joined = self._with_weights(cells, table)
        out = matrix.rows.select("id", "label").join(
            joined.groupBy("id").agg(
                *[
                    F.sum(F.col("a") * F.col("value") * F.col(w)).alias(f"_{w}")
                    for w in ws[:last]
                ]
            ),
            "id",
            "left",
        )
        start = dict(zip(ws[:last], self.offsets))
        if self.params.uses_ranks and h > 1:
            out, more = self._rank_scores(cells, out, ws[1:])
            start.update(more)
        for j, t in enumerate(self.components):
            taken = dot(self.components[:j], [self.steps[a][j] for a in range(j)])
            out = out.withColumn(
                t, F.coalesce(F.col(f"_{ws[j]}"), F.lit(0.0)) + float(start[ws[j]]) - taken
            )
        return out.select("id", "label", *self.components)

    def _rank_scores(self, cells: DataFrame, out: DataFrame, ws: list[str]):
        """Scores of the later components from the ranks of new values among train values."""
        known = self._with_weights(cells, self.weights.select("feature", "nnz")).select(
            "id", "feature", "value"
        )
        zeros = self.weights.select("feature", F.lit(0.0).alias("value"))
        asked = known.select("feature", "value").unionByName(zeros)
        r = materialize(
            ranks.new_value_ranks(
                self.powers, asked, self.n, self.params.nu, self.params.center_ranks
            )
        )
        at_zero = r.where("value = 0").select("feature", F.col("r").alias("r0"))
        base = self.weights.join(at_zero, "feature")
        offsets = base.agg(*[F.sum(F.col("r0") * F.col(w)).alias(w) for w in ws]).first()
        counted = known.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
        table, seen = materialize_with(
            r.join(counted, ["feature", "value"]), F.count(F.lit(1)).alias("n")
        )
        placed = weighted_join(known, table, ["feature", "value"], "cnt", ["id"], seen["n"])
        scored = self._with_weights(placed, base.select("feature", "nnz", "r0", *ws))
        sums = scored.groupBy("id").agg(
            *[F.sum((F.col("r") - F.col("r0")) * F.col(w)).alias(f"_{w}") for w in ws]
        )
        return out.join(sums, "id", "left"), {w: offsets[w] for w in ws}

    def _with_weights(self, cells: DataFrame, table: DataFrame) -> DataFrame:
        extra = table.withColumn("_w", F.col("nnz")).drop("nnz")
        return weighted_join(cells, extra, ["feature"], "_w", ["id"], self.n_features)

    def predict(self, matrix: Matrix) -> DataFrame:
        """(id, label, score, y_pred): class 1 where the fitted label reaches the threshold."""
        score = dot(self.components, self.coefficients[-1])
        return self.transform(matrix).select(
            "id",
            "label",
            score.alias("score"),
            (score >= self.threshold).cast("int").alias("y_pred"),
        )

    def predictions(self, matrix: Matrix) -> DataFrame:
        """(id, y_true, y_pred) with the truth encoded as 0/1."""
        return self.predict(matrix).select(
            "id", (F.col("label") == F.lit(self.classes[1])).cast("int").alias("y_true"), "y_pred"
        )

    def score(self, matrix: Matrix) -> float:
        """Macro F1 over both classes."""
        from .metrics import per_class

        rows = per_class(self.predictions(matrix)).where("class in (0, 1)").collect()
        return sum(r["f1"] for r in rows) / 2.0

    def save(self, path: str) -> None:
        """Tables as Parquet, numbers as JSON."""
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        if self.powers is not None:
            self.powers.write.mode("overwrite").parquet(f"{path}/powers")
        meta = {
            "params": asdict(self.params), "classes": self.classes, "n": self.n,
            "n_features": self.n_features, "coefficients": self.coefficients, "steps": self.steps,
            "offsets": self.offsets, "threshold": self.threshold, "moments": self.moments,
            "has_powers": self.powers is not None,
        }
        spark = self.weights.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "params string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PLSModel:
        meta = json.loads(spark.read.parquet(f"{path}/params").first()[0])
        powers = spark.read.parquet(f"{path}/powers") if meta.pop("has_powers") else None
        meta["params"] = PLS(**meta["params"])
        return PLSModel(weights=spark.read.parquet(f"{path}/weights"), powers=powers, **meta)
