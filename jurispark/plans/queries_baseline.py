"""Registered queries: baseline classifiers, transformations and searches on embeddings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.ordering import rounded
from ..operators import search
from ..operators.kernel_svm import KernelSVM
from ..operators.lsa import LatentSemantics
from ..operators.mllib import Topics
from ..operators.pls import PLS
from ..operators.registry import classifier, transformation
from ..operators.vectorizer import Vectorizer
from . import inputs as I
from . import jobs
from .queries_model import STD1, STD2, average_rank, determinant, on_split, split_matrix
from .registry import query

SQL_DISTANCES = "WITH " + """folds AS (
  SELECT vec_id, (row_number() OVER (PARTITION BY CAST(label >= 5 AS INTEGER)
                  ORDER BY md5('0:' || vec_id), vec_id) - 1) % 4 AS fold FROM embeddings),
cells AS (
  SELECT vec_id, fold, CAST(label >= 5 AS INTEGER) AS y, generate_subscripts(embedding, 1) AS f,
         CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings JOIN folds USING (vec_id)),
dist AS (
  SELECT a.vec_id, b.vec_id AS train_id, any_value(b.y) AS label, {distance} AS distance
  FROM cells a JOIN cells b ON a.f = b.f WHERE a.fold = 0 AND b.fold <> 0
  GROUP BY a.vec_id, b.vec_id),
near AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, train_id) AS rank FROM dist)
  WHERE rank <= 5)"""


def knn(spark, sf, **settings):
    train, test = split_matrix(spark, sf)
    out = classifier("KNN", **settings).fit(train).predict(test)
    return out.select(F.col("id").alias("vec_id"), "y_pred")


@query("knn_predict", SQL_DISTANCES.format(distance="sqrt(sum((a.v - b.v) * (a.v - b.v)))") + """
SELECT vec_id, CAST(sum(label) * 2 > count(*) AS INTEGER) AS y_pred FROM near GROUP BY vec_id""")
def knn_predict(spark, sf):
    return knn(spark, sf)


@query("knn_distance_predict", SQL_DISTANCES.format(distance="sum(abs(a.v - b.v))") + """,
ex AS (SELECT vec_id, max(CAST(distance = 0 AS INTEGER)) AS exact FROM near GROUP BY vec_id),
v AS (SELECT vec_id, label, sum(CASE WHEN exact = 1 THEN CAST(distance = 0 AS DOUBLE)
             ELSE 1 / distance END) AS votes FROM near JOIN ex USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, CAST(coalesce(sum(CASE WHEN label = 1 THEN votes END), 0)
                  > coalesce(sum(CASE WHEN label = 0 THEN votes END), 0) AS INTEGER) AS y_pred
FROM v GROUP BY vec_id""")
def knn_distance_predict(spark, sf):
    return knn(spark, sf, weights="distance", metric="manhattan")


SPLIT_CELLS = on_split(I.MATRIX + ", one AS (SELECT 1)")


@query("nb_bernoulli", SPLIT_CELLS + """,
nc AS (SELECT y, count(DISTINCT vec_id) AS nc FROM cells GROUP BY y),
nn AS (SELECT sum(nc) AS n FROM nc),
pr AS (SELECT feature, nc.y, (sum(CAST(v > 0 AND cells.y = nc.y AS INTEGER)) + 1) / (any_value(nc) + 2.0e0) AS p
       FROM cells, nc GROUP BY feature, nc.y),
jl AS (SELECT c.vec_id, pr.y, ln(any_value(nc) / any_value(n)) + sum(CASE WHEN v > 0 THEN ln(p) ELSE ln(1 - p) END) AS l
       FROM cells0 c JOIN pr USING (feature) JOIN nc ON nc.y = pr.y, nn WHERE fold = 0 GROUP BY c.vec_id, pr.y)
SELECT vec_id, round(max(CASE WHEN y = 0 THEN l END), 6) + 0.0e0 AS log_0,
       round(max(CASE WHEN y = 1 THEN l END), 6) + 0.0e0 AS log_1,
       CAST(max(CASE WHEN y = 1 THEN l END) > max(CASE WHEN y = 0 THEN l END) AS INTEGER) AS y_pred
FROM jl GROUP BY vec_id""")
def nb_bernoulli(spark, sf):
    train, test = split_matrix(spark, sf)
    out = classifier("GaussianNB").fit(train).predict(test)
    return out.select(
        F.col("id").alias("vec_id"), rounded(F.col("log_0")).alias("log_0"),
        rounded(F.col("log_1")).alias("log_1"), "y_pred",
    )


@query("pls_canonical_predict", on_split(STD1) + """
SELECT vec_id, CAST(sum((v - m) / sd * w) > 0 AS INTEGER) AS y_pred
FROM cells0 JOIN st USING (feature) JOIN w1 USING (feature) WHERE fold = 0 GROUP BY vec_id""")
def pls_canonical_predict(spark, sf):
    train, test = split_matrix(spark, sf)
    out = classifier("pls_canonical").fit(train).predict(test)
    return out.select(F.col("id").alias("vec_id"), "y_pred")


@query("pls_regression_predict", on_split(STD2) + """,
s1 AS (SELECT vec_id, feature, (v - m) / sd AS z FROM cells0 JOIN st USING (feature) WHERE fold = 0),
tt1 AS (SELECT vec_id, sum(z * w) AS t1 FROM s1 JOIN w1 USING (feature) GROUP BY vec_id),
tt2 AS (SELECT vec_id, sum((z - t1 * b) * w) AS t2 FROM s1 JOIN tt1 USING (vec_id)
        JOIN b1 USING (feature) JOIN w2 USING (feature) GROUP BY vec_id),
cc AS (SELECT sum(t * ys) / sum(t * t) AS ca, sum(t2 * ys) / sum(t2 * t2) AS cb FROM t1 JOIN t2 USING (vec_id))
SELECT vec_id, CAST(ca * t1 + cb * t2 > 0 AS INTEGER) AS y_pred FROM tt1 JOIN tt2 USING (vec_id), cc""")
def pls_regression_predict(spark, sf):
    """Two components, which are orthogonal: each has its own coefficient."""
    train, test = split_matrix(spark, sf)
    out = classifier("pls_regression", n_components=2).fit(train).predict(test)
    return out.select(F.col("id").alias("vec_id"), "y_pred")


def predict_named(name, **settings):
    def run(spark, sf):
        train, test = split_matrix(spark, sf)
        out = classifier(name, **settings).fit(train).predict(test)
        return out.select(F.col("id").alias("vec_id"), "label", "y_pred")

    return run


for key, name, settings in (
    ("quadratic_discriminant", "quadraticDA", {"reg_param": 0.1}),
    ("linear_svm", "LinearSVM", {}),
    ("decision_tree", "Tree", {}),
    ("random_forest", "RandomForest", {}),
    ("extra_trees", "ExtraTrees", {}),
):
    query(key)(predict_named(name, **settings))


def sql_discriminant(steps: int = 40) -> str:
    """The two-class discriminant in SQL: conjugate gradients on the covariance within classes, written out."""
    ctes = ["""mu AS (SELECT y, feature, avg(v) AS m FROM cells GROUP BY y, feature),
sizes AS (SELECT count(DISTINCT vec_id) AS n, count(DISTINCT vec_id) FILTER (y = 1) AS n1 FROM cells),
z AS MATERIALIZED (SELECT vec_id, feature, v - m AS z FROM cells JOIN mu USING (y, feature)),
g AS MATERIALIZED (SELECT a.feature AS i, b.feature AS j, sum(a.z * b.z) / (any_value(n) - 2) AS g
  FROM z a JOIN z b USING (vec_id), sizes GROUP BY a.feature, b.feature),
v0 AS MATERIALIZED (SELECT a.feature AS i, 0.0e0 AS x, a.m - b.m AS r, a.m - b.m AS p
  FROM mu a JOIN mu b USING (feature) WHERE a.y = 1 AND b.y = 0)"""]
    for k in range(steps):
        ctes.append(f"""q{k} AS (SELECT g.i, sum(g * p) AS q FROM g JOIN v{k} v ON v.i = g.j GROUP BY g.i),
u{k} AS (SELECT i, x + a * p AS x, r - a * q AS r, p, rr FROM (
  SELECT *, sum(r * r) OVER () AS rr, coalesce(sum(r * r) OVER () / nullif(sum(p * q) OVER (), 0), 0) AS a
  FROM v{k} JOIN q{k} USING (i))),
v{k + 1} AS MATERIALIZED (SELECT i, x, r, r + p * coalesce(sum(r * r) OVER () / nullif(rr, 0), 0) AS p FROM u{k})""")
    return ",\n" + ",\n".join(ctes) + f""",
c AS (SELECT ln(any_value(n1) / (any_value(n) - any_value(n1))) - sum(x * m) / 2 AS c
      FROM v{steps} JOIN mu ON mu.feature = i, sizes),
s AS (SELECT vec_id, any_value(y) AS label, sum(v * x) + any_value(c) AS s
      FROM cells0 JOIN v{steps} ON feature = i, c WHERE fold = 0 GROUP BY vec_id)
SELECT vec_id, label, round(s, 6) + 0.0e0 AS margin, CAST(s > 0 AS INTEGER) AS y_pred FROM s"""


@query("linear_discriminant", SPLIT_CELLS + sql_discriminant())
def linear_discriminant(spark, sf):
    """Classes of held-out vectors and by how much class 1 is likelier, by spectral regression."""
    train, test = split_matrix(spark, sf)
    model = classifier("linearDA", tol=1e-11).fit(train)
    margin = F.col("scores")[1] - F.col("scores")[0]
    return model.decision(test).select(
        F.col("id").alias("vec_id"), "label", rounded(margin).alias("margin"),
        (margin > 0).cast("int").alias("y_pred"),
    )


@query("lsa_transform")
def lsa_transform(spark, sf):
    """Documents in the space of the first singular vectors of their TF-IDF weights."""
    docs = I.all_labelled(spark, sf)
    # The fit deals the weights into blocks, which the projection reads too.
    m = I.Matrix.from_weights(docs, Vectorizer("tfidf", norm="l2").fit_transform(docs, words="words"))
    return LatentSemantics(5).fit(m).transform(m).cells


@query("topic_terms")
def topic_terms(spark, sf):
    """Heaviest terms of each topic of all documents."""
    docs = I.all_labelled(spark, sf)
    weights = Vectorizer("tfidf", norm="l2", df_min=5).fit(docs, words="words").transform(docs, words="words")
    return Topics(4, max_iter=100).fit(I.Matrix.from_weights(docs, weights)).top_terms(10)


@query("pls_space_tree")
def pls_space_tree(spark, sf):
    """A decision tree on the components of a partial-least-squares model."""
    train, test = split_matrix(spark, sf)
    space = transformation("pls_standard").fit(train)
    out = classifier("Tree", maxDepth=5).fit(space.transform(train)).predict(space.transform(test))
    return out.select(F.col("id").alias("vec_id"), "label", "y_pred")


def sql_pls_grid(nus, folds: int, h: int) -> str:
    """Rank-covariance models of all nu on all folds, written out: the CTEs up to ``tt{h}`` and ``co1..h``.

    Keys: s (nu), f (the fold left out).  ``rz`` holds centred ranks, those of left-out rows as if each
    joined the training rows alone.
    """
    values = ", ".join(f"({i}, {float(nu)}e0)" for i, nu in enumerate(nus))

    def solve(j: int, side: str) -> list[str]:
        """Cramer's rule for the moments of j components; 0 where they are all 0."""
        gram = [[f"g{min(a, b)}{max(a, b)}" for b in range(1, j + 1)] for a in range(1, j + 1)]
        swapped = lambda l: [[f"{side}{a + 1}" if b == l else gram[a][b] for b in range(j)] for a in range(j)]
        return [f"coalesce(({determinant(swapped(l))}) / nullif({determinant(gram)}, 0), 0)" for l in range(j)]

    weights = "coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY s, f), 0), 0) AS w"
    cov = "CASE WHEN any_value(nu) = 1 THEN 0 ELSE -any_value(nu) * covar_samp({v}, {y}) END AS c"
    ctes = [
        I.MATRIX,
        f"""fo AS (
  SELECT vec_id, y, (row_number() OVER (PARTITION BY y ORDER BY md5('0:' || vec_id), vec_id) - 1) % {folds} AS fold
  FROM (SELECT DISTINCT vec_id, y FROM cells)),
nus AS (SELECT * FROM (VALUES {values}) t(s, nu)),
x AS MATERIALIZED (SELECT f, vec_id, c.y, feature, v, fold
  FROM cells c JOIN fo USING (vec_id), (SELECT unnest(range({folds})) AS f)),
st AS (SELECT f, feature, avg(v) AS m, stddev_samp(v) AS sd FROM x WHERE fold <> f
       GROUP BY f, feature HAVING min(v) <> max(v)),
ym AS (SELECT f, avg(y) AS ym, stddev_samp(y) AS ysd, count(*) AS n
       FROM (SELECT DISTINCT f, vec_id, y FROM x WHERE fold <> f) GROUP BY f),
rk AS MATERIALIZED (SELECT f, vec_id, feature, v, {average_rank('f, feature', 'v')} AS rank
       FROM x JOIN st USING (f, feature) WHERE fold <> f),
r AS MATERIALIZED (SELECT s, f, vec_id, feature, nu, pow(n + 1 - rank, nu - 1) AS r FROM rk JOIN ym USING (f), nus),
pairs AS (
  SELECT s, a.f, a.vec_id, a.feature, any_value(n) AS n, any_value(nu) AS nu,
         count(*) FILTER (b.v < a.v) AS lower, count(*) FILTER (b.v = a.v) AS same,
         coalesce(sum(pow(n + 2 - b.rank, nu - 1)) FILTER (b.v < a.v), 0)
         + coalesce(sum(pow(n + 1 - b.rank, nu - 1)) FILTER (b.v > a.v), 0) AS others
  FROM x a JOIN rk b ON a.f = b.f AND a.feature = b.feature JOIN ym ON ym.f = a.f, nus
  WHERE a.fold = a.f GROUP BY s, a.f, a.vec_id, a.feature),
own AS (SELECT *, pow(n + 2 - (lower + same / 2.0e0 + 1), nu - 1) AS r FROM pairs),
rz AS MATERIALIZED (
  SELECT s, f, vec_id, feature, r - avg(r) OVER (PARTITION BY s, f, feature) AS z FROM r
  UNION ALL SELECT s, f, vec_id, feature, r - (others + (same + 1) * r) / (n + 1) AS z FROM own),
v0 AS (SELECT s, f, feature, {cov.format(v='r', y='ys')}
       FROM r JOIN (SELECT f, vec_id, (y - ym) / ysd AS ys FROM fo, ym) USING (f, vec_id) GROUP BY s, f, feature),
w1 AS MATERIALIZED (SELECT s, f, feature, {weights} FROM v0),
tt1 AS MATERIALIZED (
  SELECT s, f, vec_id, any_value(fold) AS fold, any_value(x.y) AS y, any_value((x.y - ym) / ysd) AS ys,
         sum((v - m) / sd * w) AS t1
  FROM x JOIN st USING (f, feature) JOIN w1 USING (f, feature) JOIN ym USING (f) GROUP BY s, f, vec_id)""",
    ]
    for j in range(1, h + 1):
        each = range(1, j + 1)
        sums = [f"sum(t{a} * t{b}) AS g{a}{b}" for a in each for b in each if a <= b]
        sums += [f"sum(t{a} * ys) AS q{a}, avg(t{a}) AS m{a}" for a in each]
        ctes.append(f"mo{j} AS (SELECT s, f, {', '.join(sums)} FROM tt{j} WHERE fold <> f GROUP BY s, f)")
        ctes.append(f"co{j} AS MATERIALIZED (SELECT *, " + ", ".join(f"{x} AS c{l + 1}" for l, x in enumerate(solve(j, "q"))) + f" FROM mo{j})")
        if j == h:
            break
        ctes.append(f"""bx{j} AS (SELECT s, f, feature, {', '.join(f'sum(z * t{a}) AS x{a}' for a in each)}
  FROM rz JOIN tt{j} USING (s, f, vec_id) WHERE fold <> f GROUP BY s, f, feature),
bb{j} AS MATERIALIZED (SELECT s, f, feature, {', '.join(f'{x} AS b{l + 1}' for l, x in enumerate(solve(j, 'x')))}
  FROM bx{j} JOIN co{j} USING (s, f)),
re{j} AS MATERIALIZED (
  SELECT s, f, vec_id, feature, fold, z - ({' + '.join(f't{a} * b{a}' for a in each)}) AS res,
         ys - ({' + '.join(f't{a} * c{a}' for a in each)}) AS eps
  FROM rz JOIN tt{j} USING (s, f, vec_id) JOIN bb{j} USING (s, f, feature) JOIN co{j} USING (s, f)),
rq{j} AS (SELECT s, f, feature, eps, round(res, 10) AS q FROM re{j} WHERE fold <> f),
rv{j} AS (SELECT s, f, feature, eps, nu, pow(n + 1 - {average_rank('s, f, feature', 'q')}, nu - 1) AS v2
  FROM rq{j} JOIN ym USING (f) JOIN nus USING (s)),
v{j} AS (SELECT s, f, feature, {cov.format(v='v2', y='eps')} FROM rv{j} GROUP BY s, f, feature),
w{j + 1} AS MATERIALIZED (SELECT s, f, feature, {weights} FROM v{j}),
sc{j + 1} AS (SELECT s, f, vec_id, sum(res * w) AS t{j + 1} FROM re{j} JOIN w{j + 1} USING (s, f, feature) GROUP BY s, f, vec_id),
tt{j + 1} AS MATERIALIZED (SELECT * FROM tt{j} JOIN sc{j + 1} USING (s, f, vec_id))""")
    guesses = " UNION ALL ".join(
        f"SELECT s, f, {j} AS n_comp, y, CAST({' + '.join(f'c{a} * t{a}' for a in range(1, j + 1))} >= "
        f"{' + '.join(f'c{a} * m{a}' for a in range(1, j + 1))} AS INTEGER) AS p "
        f"FROM tt{h} JOIN co{j} USING (s, f) WHERE fold = f" for j in range(1, h + 1)
    )
    return "WITH " + ",\n".join(ctes) + f",\ngu AS ({guesses})"


@query("pls_search", sql_pls_grid(search.NU_RANGE, search.SEARCH_FOLDS, max(search.COMPONENTS_RANGE)) + """
SELECT nu, CAST(n_comp AS INTEGER) AS n_comp, CAST(f AS INTEGER) AS fold,
       round((coalesce(2.0e0 * sum(y * p) / nullif(sum(y) + sum(p), 0), 0)
        + coalesce(2.0e0 * sum((1 - y) * (1 - p)) / nullif(sum(1 - y) + sum(1 - p), 0), 0)) / 2, 6) AS score
FROM gu JOIN nus USING (s) GROUP BY nu, n_comp, f""")
def pls_search(spark, sf):
    """Score table of the default (nu, components) grid, all models fitted side by side."""
    m = I.matrix(spark, sf).written()
    scores = search.pls_scores(m, PLS("gini"), search.NU_RANGE, search.COMPONENTS_RANGE)
    return scores.withColumn("score", rounded(F.col("score")))


@query("tree_grid_search")
def tree_grid_search(spark, sf):
    grid = search.grid_candidates({"maxDepth": [3, 5], "minInstancesPerNode": [1, 5]})
    return search.search_scores(I.matrix(spark, sf).written(), "Tree", grid, n_folds=2)


@query("tree_tuned")
def tree_tuned(spark, sf):
    """Predictions of a tree whose settings are searched on the training fold."""
    _, train, test = jobs.outer_folds(I.matrix(spark, sf).written(), 4)[0]
    return search.Tuned("Tree", n_folds=3).fit(train).predict(test)


@query("discriminant_random_search")
def discriminant_random_search(spark, sf):
    grid = {"reg_param": [i / 100 for i in range(101)]}
    candidates = search.random_candidates(grid, n_iter=20)
    return search.search_scores(I.matrix(spark, sf).written(), "quadraticDA", candidates, n_folds=2)


@query("evaluate_grid")
def evaluate_grid(spark, sf):
    """Metric table of two classifiers over two folds."""
    folds = jobs.outer_folds(I.matrix(spark, sf).written(), 2)
    return jobs.evaluate_grid({"raw": folds}, "embeddings", ["pls_canonical", "GaussianNB"])


def sql_svm(settings: list[tuple[dict, str]], marks: int, fits: str, landmark_rows: str, steps: int = 10) -> str:
    """Newton steps of kernel machines in SQL, written out: the CTEs up to ``w`` (s, f, a1.., b).

    ``settings`` are (candidate, gamma as SQL); ``fits`` are the folds that models leave out.
    """
    n = marks + 1
    ks = range(1, n)

    def kernel(dot: str, one: str, two: str) -> str:
        return (
            f"CASE kernel WHEN 'linear' THEN {dot} WHEN 'poly' THEN pow(gamma * {dot}, degree) "
            f"ELSE exp(-gamma * greatest({one} + {two} - 2 * {dot}, 0)) END"
        )

    rows = ", ".join(
        f"({i}, '{json.dumps(c, sort_keys=True)}', '{c['kernel']}', {c['C']}e0, {gamma}, {c.get('degree', 3)})"
        for i, (c, gamma) in enumerate(settings)
    )
    entry = lambda i, j: "sum(x.k{} * x.k{})".format(i, j)
    ctes = [
        """e AS (
  SELECT vec_id, CASE WHEN label >= 5 THEN 1.0e0 ELSE -1.0e0 END AS y, CAST(embedding AS DOUBLE[]) AS x,
         (row_number() OVER (PARTITION BY CAST(label >= 5 AS INTEGER)
                             ORDER BY md5('0:' || vec_id), vec_id) - 1) % 4 AS fold FROM embeddings)""",
        f"""lm AS (
  SELECT x, row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id) AS k FROM e
  WHERE {landmark_rows} QUALIFY k <= {marks})""",
        f"""u AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i, vec_id FROM e WHERE {landmark_rows}),
sc AS (SELECT 1 / (nf * (ss / (nr * nf) - pow(s / (nr * nf), 2))) AS scale FROM (
  SELECT count(DISTINCT i) FILTER (v <> 0) AS nf, count(DISTINCT vec_id) AS nr, sum(v) AS s, sum(v * v) AS ss FROM u))""",
        f"st AS (SELECT * FROM (VALUES {rows}) v(s, params, kernel, c, gamma0, degree))".replace(
            "SELECT *", "SELECT s, params, kernel, c, coalesce(gamma0, scale) AS gamma, degree"
        ).replace("v(s, params, kernel, c, gamma0, degree)", "v(s, params, kernel, c, gamma0, degree), sc"),
        "pr AS (SELECT vec_id, y, fold, list_dot_product(e.x, e.x) AS len, "
        + ", ".join(f"list_dot_product(e.x, l{k}.x) AS d{k}, list_dot_product(l{k}.x, l{k}.x) AS q{k}" for k in ks)
        + " FROM e, " + ", ".join(f"(SELECT x FROM lm WHERE k = {k}) l{k}" for k in ks) + ")",
        "ker AS MATERIALIZED (SELECT s, c, vec_id, y, fold, "
        + ", ".join(f"{kernel(f'd{k}', 'len', f'q{k}')} AS k{k}" for k in ks) + f", 1.0e0 AS k{n} FROM pr, st)",
        "own AS MATERIALIZED (SELECT s, " + ", ".join(
            f"max(CASE WHEN i = {i} AND j = {j} THEN p END) AS p{i}_{j}" for i in ks for j in ks
        ) + " FROM (SELECT s, a.k AS i, b.k AS j, "
        + kernel("list_dot_product(a.x, b.x)", "list_dot_product(a.x, a.x)", "list_dot_product(b.x, b.x)")
        + " AS p FROM lm a, lm b, st) GROUP BY s)",
        f"w0 AS (SELECT s, f, {', '.join(f'0.0e0 AS a{i}' for i in range(1, n + 1))} FROM st, {fits})",
    ]
    for step in range(1, steps + 1):
        line = " + ".join(f"w.a{i} * x.k{i}" for i in range(1, n + 1))
        cells = [
            (f"any_value(p{i}_{j}) + " if i < n and j < n else "") + f"2 * any_value(x.c) * {entry(i, j)} AS m{i}_{j}"
            for i in range(1, n + 1) for j in range(1, n + 1)
        ] + [f"2 * any_value(x.c) * sum(x.k{i} * x.y) AS m{i}_{n + 1}" for i in range(1, n + 1)]
        ctes.append(
            f"g{step}_0 AS (SELECT w.s, w.f, {', '.join(cells)} FROM w{step - 1} w JOIN ker x ON x.s = w.s AND x.fold <> w.f "
            f"JOIN own o ON o.s = w.s WHERE 1 - x.y * ({line}) > 0 GROUP BY w.s, w.f)"
        )
        for k in range(1, n + 1):  # elimination of one column
            made = [
                f"m{k}_{j} / m{k}_{k} AS m{k}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}"
                for i in range(1, n + 1) for j in range(k + 1, n + 2)
            ]
            ctes.append(f"g{step}_{k} AS (SELECT s, f, {', '.join(made)} FROM g{step}_{k - 1})")
        ctes.append(
            f"w{step} AS MATERIALIZED (SELECT s, f, {', '.join(f'm{i}_{n + 1} AS a{i}' for i in range(1, n + 1))} FROM g{step}_{n})"
        )
    margin = " + ".join(f"w.a{i} * x.k{i}" for i in range(1, n + 1))
    ctes.append(f"mg AS (SELECT x.s, w.f, vec_id, y, {margin} AS margin FROM w{steps} w JOIN ker x ON x.s = w.s AND x.fold = w.f)")
    return "WITH " + ",\n".join(ctes)


SVM_MARKS = 3


@query("svm_kernel_margins", sql_svm([({"kernel": "rbf", "C": 1.0}, "NULL::DOUBLE")], SVM_MARKS, "(SELECT 0 AS f)", "fold <> 0") + """
SELECT vec_id, round(margin, 6) + 0.0e0 AS margin, CAST(margin >= 0 AS INTEGER) AS y_pred FROM mg""")
def svm_kernel_margins(spark, sf):
    """Radial kernel machine on a few landmarks: margins of the test fold."""
    train, test = split_matrix(spark, sf)
    model = KernelSVM("rbf", 1.0, n_landmarks=SVM_MARKS).fit(train)
    margin = F.col("margins")[0]
    return model.decision(test).select(
        F.col("id").alias("vec_id"), rounded(margin).alias("margin"), (margin >= 0).cast("int").alias("y_pred")
    )


SVM_GRID = [
    *[{"kernel": "linear", "C": c} for c in (0.1, 10.0)],
    *[{"kernel": "rbf", "C": c, "gamma": g} for c in (0.1, 10.0) for g in (0.01, 0.1)],
    *[{"kernel": "poly", "C": 1.0, "gamma": 0.1, "degree": d} for d in (2, 3)],
]


@query("svm_kernel_search", sql_svm([(c, f"{c.get('gamma', 0.0)}e0") for c in SVM_GRID], SVM_MARKS, "(SELECT unnest(range(4)) AS f)", "fold >= 0") + """
SELECT params, CAST(f AS INTEGER) AS fold, avg(CAST((margin >= 0) = (y > 0) AS DOUBLE)) AS score
FROM mg JOIN st USING (s) GROUP BY params, f""")
def svm_kernel_search(spark, sf):
    """All settings on all folds, fitted side by side."""
    grid = [{**c, "n_landmarks": SVM_MARKS} for c in SVM_GRID]
    found = search.search_scores(I.matrix(spark, sf).written(), "SVM", grid, n_folds=4)
    return found.withColumn("params", F.regexp_replace("params", f', "n_landmarks": {SVM_MARKS}', ""))


@query("svm_random_search")
def svm_random_search(spark, sf):
    """Twenty drawn settings on four folds."""
    ranges, folds = search.DRAWN["SVM"]
    candidates = search.random_candidates(ranges, n_iter=20)
    return search.search_scores(I.matrix(spark, sf).written(), "SVM", candidates, folds)


TREE_GRID = [
    {"criterion": "gini", "max_depth": 1},
    {"criterion": "gini", "max_depth": 2},
    {"criterion": "gini", "max_depth": 2, "min_samples_leaf": 20},
    {"criterion": "entropy", "max_depth": 2},
    {"criterion": "entropy", "max_depth": 2, "min_samples_leaf": 20},
]


def sql_trees(grid: list[dict], folds: int, depth: int) -> str:
    """Trees of two classes grown in SQL, level by level: the CTEs up to ``leaf``."""
    rows = ", ".join(
        f"({i}, '{json.dumps(c, sort_keys=True)}', '{c['criterion']}', {c.get('min_samples_leaf', 1)}, {c['max_depth']})"
        for i, c in enumerate(grid)
    )

    def purity(a: str, b: str) -> str:
        part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * ln({x} / ({a} + {b})) ELSE 0 END"
        return f"CASE WHEN criterion = 'gini' THEN ({a} * {a} + {b} * {b}) / ({a} + {b}) ELSE {part(a)} + {part(b)} END"

    ctes = [
        f"""e AS (
  SELECT vec_id, CAST(label >= 5 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS x,
         (row_number() OVER (PARTITION BY CAST(label >= 5 AS INTEGER)
                             ORDER BY md5('0:' || vec_id), vec_id) - 1) % {folds} AS fold FROM embeddings),
cells AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS feature FROM e),
st AS (SELECT * FROM (VALUES {rows}) t(s, params, criterion, leaf, deepest)),
at0 AS (SELECT s, f, vec_id, y, 1 AS node FROM e, st, (SELECT unnest(range({folds})) AS f) WHERE fold <> f),
go0 AS (SELECT s, f, vec_id, y, 1 AS node FROM e, st, (SELECT unnest(range({folds})) AS f) WHERE fold = f)"""
    ]
    for d in range(depth + 1):
        ctes.append(f"""tot{d} AS MATERIALIZED (
  SELECT s, f, node, count(*) AS n, sum(1.0e0 - y) AS c0, sum(1.0e0 * y) AS c1 FROM at{d} GROUP BY ALL),
lad{d} AS (
  SELECT s, f, node, feature, v, count(*) AS n, sum(1.0e0 - y) AS c0, sum(1.0e0 * y) AS c1
  FROM at{d} JOIN cells USING (vec_id) GROUP BY ALL),
run{d} AS (
  SELECT s, f, node, feature, v, lead(v) OVER w AS nv, sum(n) OVER w AS ln, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1
  FROM lad{d} WINDOW w AS (PARTITION BY s, f, node, feature ORDER BY v)),
sp{d} AS MATERIALIZED (
  SELECT r.s, r.f, r.node, feature, (v + nv) / 2 AS threshold
  FROM run{d} r JOIN tot{d} t ON t.s = r.s AND t.f = r.f AND t.node = r.node JOIN st ON st.s = r.s
  WHERE nv IS NOT NULL AND ln >= leaf AND n - ln >= leaf AND c0 > 0 AND c1 > 0 AND {d} < deepest
  QUALIFY row_number() OVER (PARTITION BY r.s, r.f, r.node ORDER BY
    -round({purity('l0', 'l1')} + {purity('(c0 - l0)', '(c1 - l1)')}, 9), feature, v) = 1)""")
        for name in ("at", "go"):
            ctes.append(f"""{name}{d + 1} AS MATERIALIZED (
  SELECT a.s, a.f, a.vec_id, a.y, 2 * a.node + CAST(c.v > threshold AS INTEGER) AS node
  FROM {name}{d} a JOIN sp{d} b ON a.s = b.s AND a.f = b.f AND a.node = b.node
  JOIN cells c ON c.vec_id = a.vec_id AND c.feature = b.feature)""")
    ends = " UNION ALL ".join(
        f"SELECT g.s, g.f, g.vec_id, g.y, t.c0, t.c1 FROM go{d} g JOIN tot{d} t ON t.s = g.s AND t.f = g.f AND t.node = g.node "
        f"ANTI JOIN sp{d} p ON p.s = g.s AND p.f = g.f AND p.node = g.node" for d in range(depth + 1)
    )
    return "WITH " + ",\n".join(ctes) + f",\nleaf AS ({ends})"


@query("tree_exact_search", sql_trees(TREE_GRID, 4, 2) + """
SELECT params, CAST(f AS INTEGER) AS fold,
       avg(CASE WHEN y = CASE WHEN c1 > c0 THEN 1 ELSE 0 END THEN 1.0e0 ELSE 0.0e0 END) AS score
FROM leaf JOIN st USING (s) GROUP BY params, f""")
def tree_exact_search(spark, sf):
    """Exact trees of all settings on all folds, grown side by side."""
    return search.search_scores(I.matrix(spark, sf).written(), "ExactTree", TREE_GRID, n_folds=4)
