"""Registered queries: matrices, ranks, partial-least-squares models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import rounded
from ..operators import matrix as M
from ..operators import ranks
from ..operators.folds import stratified_folds
from ..operators.matrix import Matrix
from ..operators.pls import PLS
from ..sources.scratch import materialize
from . import inputs as I
from .registry import query

NU = 1.7

# --- the matrix itself -------------------------------------------------------------


@query("load_matrix_long", "WITH " + I.MATRIX + " SELECT vec_id, y, feature, v AS value FROM cells")
def load_matrix_long(spark, sf):
    m = I.matrix(spark, sf)
    return m.cells.join(m.rows, "id").select(
        F.col("id").alias("vec_id"), F.col("label").alias("y"), "feature", "value"
    )


@query("encode_labels", """
SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_index
FROM documents""")
def encode_labels(spark, sf):
    return M.encode_labels(I.table(spark, sf, "documents").select("doc_id", "source"), "source")


@query("feature_stats", "WITH " + I.MATRIX + """
SELECT feature, count(*) AS nnz, round(avg(v), 6) + 0.0e0 AS mean,
       round(stddev_samp(v), 6) + 0.0e0 AS sd, round(covar_samp(v, y), 6) + 0.0e0 AS cov
FROM cells GROUP BY feature""")
def feature_stats(spark, sf):
    stats = M.feature_stats(I.matrix(spark, sf))
    return stats.select("feature", "nnz", *[rounded(F.col(c)).alias(c) for c in ("mean", "sd", "cov")])


@query("constant_features", """
WITH cells AS (
  SELECT unnest(list_append(embedding, 4.0::FLOAT)) AS v,
         CAST(generate_subscripts(list_append(embedding, 4.0::FLOAT), 1) - 1 AS INTEGER) AS feature
  FROM embeddings)
SELECT feature FROM cells GROUP BY feature HAVING min(v) = max(v)""")
def constant_features(spark, sf):
    rows = I.table(spark, sf, "embeddings")
    values = F.array_append(F.col("embedding").cast("array<double>"), F.lit(4.0))
    m = Matrix.from_arrays(rows, "vec_id", F.col("label"), values)
    return M.constant_features(M.feature_stats(m))


# Standardised cells; the fragments below build on z (vec_id, feature, v, z, ys, n).
Z = I.MATRIX + """,
ym AS (SELECT avg(y) AS ym, stddev_samp(y) AS ysd, count(*) AS n FROM (SELECT DISTINCT vec_id, y FROM cells)),
st AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS sd FROM cells GROUP BY feature HAVING min(v) <> max(v)),
z AS (SELECT vec_id, feature, v, (v - m) / sd AS z, (y - ym) / ysd AS ys, n
      FROM cells JOIN st USING (feature), ym)"""


@query("standardize", "WITH " + Z + " SELECT vec_id, feature, round(z, 6) + 0.0e0 AS z FROM z")
def standardize(spark, sf):
    m = I.matrix(spark, sf)
    z = M.standardize(m, M.feature_stats(m))
    return z.select(F.col("id").alias("vec_id"), "feature", rounded(F.col("z")).alias("z"))


# --- ranks -------------------------------------------------------------------------


def average_rank(part: str, value: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {part} ORDER BY {value})"
        f" + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0e0)"
    )


def ranked_cells(spark, sf):
    m = I.matrix(spark, sf).written()
    y = m.rows.select("id", F.col("label").cast("double").alias("y"))
    totals = y.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy")).first()
    cells = m.cells.where("value <> 0").join(y, "id")
    stats = M.stats_of_cells(cells, totals["n"], totals["sy"])
    ladder = ranks.with_rank(ranks.value_ladder(cells, stats, totals["n"], totals["sy"]))
    return cells, ladder, totals["n"]


@query("avg_rank", "WITH " + I.MATRIX + f"""
SELECT vec_id, feature, {average_rank('feature', 'v')} AS rank FROM cells""")
def avg_rank(spark, sf):
    cells, ladder, _ = ranked_cells(spark, sf)
    found = ranks.cell_ranks(cells.select("id", "feature", "value"), ladder.drop("sy"))
    return found.select(F.col("id").alias("vec_id"), "feature", "rank")


R = Z + f""", r0 AS (
  SELECT *, pow(n + 1 - {average_rank('feature', 'v')}, {NU}e0 - 1) AS r FROM z),
r AS (SELECT *, r - avg(r) OVER (PARTITION BY feature) AS rc FROM r0)"""


@query("gini_rank", "WITH " + R + """
SELECT vec_id, feature, round(r, 6) + 0.0e0 AS r, round(rc, 6) + 0.0e0 AS rc FROM r""")
def gini_rank(spark, sf):
    cells, ladder, n = ranked_cells(spark, sf)
    rated = ladder.withColumn("r", ranks.gini_rank(F.col("rank"), n, NU)).drop("sy", "rank")
    means = rated.groupBy("feature").agg((F.sum(F.col("cnt") * F.col("r")) / n).alias("m"))
    table = rated.join(means, "feature").select(
        "feature", "value", "cnt", "r", (F.col("r") - F.col("m")).alias("rc")
    )
    found = ranks.cell_ranks(cells.select("id", "feature", "value"), table)
    return found.select(
        F.col("id").alias("vec_id"), "feature", rounded(F.col("r")).alias("r"),
        rounded(F.col("rc")).alias("rc"),
    )


# --- models ------------------------------------------------------------------------

STD1 = Z + """,
w0 AS (SELECT feature, covar_samp(z, ys) AS c FROM z GROUP BY feature),
w1 AS (SELECT feature, c / (SELECT sqrt(sum(c * c)) FROM w0) AS w FROM w0),
t1 AS (SELECT vec_id, ys, n, sum(z * w) AS t FROM z JOIN w1 USING (feature) GROUP BY vec_id, ys, n),
c1 AS (SELECT sum(t * ys) / sum(t * t) AS c, sum(t * t) AS tt FROM t1),
e1 AS (SELECT vec_id, ys, n, t, ys - c * t AS eps FROM t1, c1),
b1 AS (SELECT feature, sum(z * t) / any_value(tt) AS b FROM z JOIN t1 USING (vec_id), c1 GROUP BY feature)"""

STD2 = STD1 + """,
res AS (SELECT vec_id, feature, z - t * b AS res, eps
        FROM z JOIN e1 USING (vec_id) JOIN b1 USING (feature)),
v0 AS (SELECT feature, covar_samp(res, eps) AS c FROM res GROUP BY feature),
w2 AS (SELECT feature, c / (SELECT sqrt(sum(c * c)) FROM v0) AS w FROM v0),
t2 AS (SELECT vec_id, sum(res * w) AS t2 FROM res JOIN w2 USING (feature) GROUP BY vec_id)"""

GINI1 = R + f""",
w0 AS (SELECT feature, -{NU}e0 * covar_samp(r, ys) AS c FROM r GROUP BY feature),
w1 AS (SELECT feature, c / (SELECT sum(abs(c)) FROM w0) AS w FROM w0),
t1 AS (SELECT vec_id, ys, n, sum(z * w) AS t FROM z JOIN w1 USING (feature) GROUP BY vec_id, ys, n),
c1 AS (SELECT sum(t * ys) / sum(t * t) AS c, sum(t * t) AS tt FROM t1),
e1 AS (SELECT vec_id, ys, n, t, ys - c * t AS eps FROM t1, c1),
b1 AS (SELECT feature, sum(rc * t) / any_value(tt) AS b FROM r JOIN t1 USING (vec_id), c1 GROUP BY feature)"""

GINI2 = GINI1 + f""",
res AS (SELECT vec_id, feature, rc - t * b AS res, eps, e1.n AS n
        FROM r JOIN e1 USING (vec_id) JOIN b1 USING (feature)),
rr AS (SELECT vec_id, feature, res, eps, n, round(res, 10) AS q FROM res),
rv AS (SELECT *, pow(n + 1 - {average_rank('feature', 'q')}, {NU}e0 - 1) AS v2 FROM rr),
v0 AS (SELECT feature, -{NU}e0 * covar_samp(v2, eps) AS c FROM rv GROUP BY feature),
w2 AS (SELECT feature, c / (SELECT sum(abs(c)) FROM v0) AS w FROM v0),
t2 AS (SELECT vec_id, sum(res * w) AS t2 FROM res JOIN w2 USING (feature) GROUP BY vec_id)"""


def fitted(spark, sf, **settings):
    return PLS(**settings).fit(I.matrix(spark, sf))


def weights(model):
    names = [f"w{j + 1}" for j in range(model.params.n_components)]
    return model.weights.select("feature", *[rounded(F.col(w)).alias(w) for w in names])


def components(model):
    return model.train_rows.select(
        F.col("id").alias("vec_id"), *[rounded(F.col(t)).alias(t) for t in model.components]
    )


@query("pls_w1_standard", "WITH " + STD1 + " SELECT feature, round(w, 6) + 0.0e0 AS w1 FROM w1")
def pls_w1_standard(spark, sf):
    return weights(fitted(spark, sf, variant="standard", n_components=1))


@query("pls_w1_gini", "WITH " + GINI1 + " SELECT feature, round(w, 6) + 0.0e0 AS w1 FROM w1")
def pls_w1_gini(spark, sf):
    return weights(fitted(spark, sf, variant="gini", n_components=1, nu=NU))


@query("pls_standard_t1", "WITH " + STD1 + " SELECT vec_id, round(t, 6) + 0.0e0 AS t1 FROM t1")
def pls_standard_t1(spark, sf):
    return components(fitted(spark, sf, variant="standard", n_components=1))


@query("pls_gini_t1", "WITH " + GINI1 + " SELECT vec_id, round(t, 6) + 0.0e0 AS t1 FROM t1")
def pls_gini_t1(spark, sf):
    return components(fitted(spark, sf, variant="gini", n_components=1, nu=NU))


@query("pls_standard_t2", "WITH " + STD2 + """
SELECT vec_id, round(t, 6) + 0.0e0 AS t1, round(t2, 6) + 0.0e0 AS t2 FROM t1 JOIN t2 USING (vec_id)""")
def pls_standard_t2(spark, sf):
    return components(fitted(spark, sf, variant="standard", n_components=2))


@query("pls_gini_t2", "WITH " + GINI2 + """
SELECT vec_id, round(t, 6) + 0.0e0 AS t1, round(t2, 6) + 0.0e0 AS t2 FROM t1 JOIN t2 USING (vec_id)""")
def pls_gini_t2(spark, sf):
    return components(fitted(spark, sf, variant="gini", n_components=2, nu=NU))


# Logistic variants: Newton steps of one penalised regression per feature, unrolled.


def determinant(m) -> str:
    """Determinant of a matrix of SQL terms, by its first row."""
    if len(m) == 1:
        return m[0][0]
    minors = [[row[:j] + row[j + 1:] for row in m[1:]] for j in range(len(m))]
    return " + ".join(
        f"({'-' if j % 2 else ''}({m[0][j]}) * ({determinant(minors[j])}))" for j in range(len(m))
    )


def newton(source: str, columns: list[str], steps: int, name: str) -> str:
    """CTEs ``<name>_<i>`` (feature, b0, b1, ..) after i steps on ``source`` (feature, y, columns)."""
    xs = ["1.0e0", *columns]
    n = range(len(xs))
    parts = [
        f"{name}_0 AS (SELECT DISTINCT feature, "
        + ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in n) + f" FROM {source})"
    ]
    for step in range(steps):
        eta = " + ".join(f"b{i} * {x}" for i, x in enumerate(xs))
        grads = ", ".join(
            f"sum((y - p) * {x})" + (f" - any_value(b{i})" if i else "") + f" AS g{i}"
            for i, x in enumerate(xs)
        )
        hess = ", ".join(
            f"sum(p * (1 - p) * {xs[i]} * {xs[j]})" + (" + 1" if i == j and i else "") + f" AS h{i}{j}"
            for i in n for j in n if j >= i
        )
        h = [[f"h{min(i, j)}{max(i, j)}" for j in n] for i in n]
        moves = []
        for k in n:
            swapped = [[f"g{i}" if j == k else h[i][j] for j in n] for i in n]
            moves.append(f"b{k} + ({determinant(swapped)}) / ({determinant(h)}) AS b{k}")
        olds = ", ".join(f"any_value(b{i}) AS b{i}" for i in n)
        parts.append(
            f"{name}_{step + 1} AS (SELECT feature, {', '.join(moves)} FROM ("
            f"SELECT feature, {olds}, {grads}, {hess} FROM ("
            f"SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM {source} JOIN {name}_{step} USING (feature))"
            " GROUP BY feature))"
        )
    return ",\n".join(parts)


def logit_sql(variant: str) -> str:
    """w1, t1, w2, t2 of the logistic variants; ``x`` is what the regressions see."""
    by_rank = variant == "logit_gini"
    steps = 25 if by_rank else 15
    other = "b2" if by_rank else "b1"
    return (R if by_rank else Z) + f""",
y AS (SELECT DISTINCT vec_id, y FROM cells),
first AS (SELECT vec_id, feature, y, {'r' if by_rank else 'z'} AS x FROM {'r' if by_rank else 'z'} JOIN y USING (vec_id)),
{newton('first', ['x'], steps, 'f')},
w1 AS (SELECT feature, b1 / (SELECT sqrt(sum(b1 * b1)) FROM f_{steps}) AS w FROM f_{steps}),
t1 AS (SELECT vec_id, ys, sum(z * w) AS t FROM z JOIN w1 USING (feature) GROUP BY vec_id, ys),
c1 AS (SELECT sum(t * t) AS tt FROM t1),
form AS (SELECT vec_id, feature, {'rc' if by_rank else 'z'} AS x FROM {'r' if by_rank else 'z'}),
b1 AS (SELECT feature, sum(x * t) / any_value(tt) AS b FROM form JOIN t1 USING (vec_id), c1 GROUP BY feature),
second AS (SELECT vec_id, feature, y, round(x - t * b, 10) AS x, t FROM form JOIN t1 USING (vec_id)
           JOIN b1 USING (feature) JOIN y USING (vec_id)),
{newton('second', ['x', 't'], steps, 's')},
w2 AS (SELECT feature, b1 / (SELECT sqrt(sum(b1 * b1 + {other} * {other})) FROM s_{steps}) AS w FROM s_{steps}),
t2 AS (SELECT vec_id, sum(x * w) AS t2 FROM second JOIN w2 USING (feature) GROUP BY vec_id)"""


SQL_T12 = """
SELECT vec_id, round(t, 6) + 0.0e0 AS t1, round(t2, 6) + 0.0e0 AS t2 FROM t1 JOIN t2 USING (vec_id)"""


@query("pls_logit_t2", "WITH " + logit_sql("logit") + SQL_T12)
def pls_logit_t2(spark, sf):
    return components(fitted(spark, sf, variant="logit", n_components=2))


@query("pls_logit_gini_t2", "WITH " + logit_sql("logit_gini") + SQL_T12)
def pls_logit_gini_t2(spark, sf):
    return components(fitted(spark, sf, variant="logit_gini", n_components=2, nu=NU))


@query("logit_w1", "WITH " + logit_sql("logit") + " SELECT feature, round(w, 6) + 0.0e0 AS w1 FROM w1")
def logit_w1(spark, sf):
    return weights(fitted(spark, sf, variant="logit", n_components=1))


@query("logit_gini_w1", "WITH " + logit_sql("logit_gini") + " SELECT feature, round(w, 6) + 0.0e0 AS w1 FROM w1")
def logit_gini_w1(spark, sf):
    return weights(fitted(spark, sf, variant="logit_gini", n_components=1, nu=NU))


@query("pls_loadings", "WITH " + STD1 + " SELECT feature, round(b, 6) + 0.0e0 AS b_t1 FROM b1")
def pls_loadings(spark, sf):
    model = fitted(spark, sf, variant="standard", n_components=1)
    return model.loadings(I.matrix(spark, sf)).select("feature", rounded(F.col("b_t1")).alias("b_t1"))


FIT_ROWS = "WITH " + STD1 + """,
lev AS (SELECT eps, c * t AS fit, 1 - t * t / tt AS left_out, ys FROM e1, c1)"""


@query("pls_r2", FIT_ROWS + """
SELECT 1 AS component, round(sum(fit * fit) / (sum(fit * fit) + sum(eps * eps)), 6) + 0.0e0 AS r2 FROM lev""")
def pls_r2(spark, sf):
    model = fitted(spark, sf, variant="standard", n_components=1)
    return model.fit_table(spark).select("component", rounded(F.col("r2")).alias("r2"))


@query("pls_q2", FIT_ROWS + """
SELECT 1 AS component, round(sum(pow(eps / left_out, 2)), 6) + 0.0e0 AS press,
       round(1 - sum(pow(eps / left_out, 2)) / sum(ys * ys), 6) + 0.0e0 AS q2 FROM lev""")
def pls_q2(spark, sf):
    model = fitted(spark, sf, variant="standard", n_components=1)
    return model.fit_table(spark).select(
        "component", rounded(F.col("press")).alias("press"), rounded(F.col("q2")).alias("q2")
    )


@query("pls_vip", "WITH " + STD2 + """,
m AS (SELECT pow(corr(t1.t, t1.ys), 2) AS m1, pow(corr(t2, t1.ys), 2) AS m2 FROM t1 JOIN t2 USING (vec_id)),
k AS (SELECT count(*) AS k FROM st)
SELECT feature, round(k * w1.w * w1.w, 6) + 0.0e0 AS vip1,
       round(k / (m1 + m2) * (m1 * w1.w * w1.w + m2 * w2.w * w2.w), 6) + 0.0e0 AS vip2
FROM w1 JOIN w2 USING (feature), m, k""")
def pls_vip(spark, sf):
    table = fitted(spark, sf, variant="standard", n_components=2).vip()
    return table.select("feature", rounded(F.col("vip1")).alias("vip1"), rounded(F.col("vip2")).alias("vip2"))


@query("pls_vip_selection")
def pls_vip_selection(spark, sf):
    """Features left after the backward elimination."""
    model = fitted(spark, sf, variant="standard", n_components=2, use_vip=True)
    return weights(model)


# --- prediction: train on folds 1..3, predict fold 0 -----------------------------------

SPLIT = """folds AS (
  SELECT vec_id, (row_number() OVER (PARTITION BY CAST(label >= 5 AS INTEGER)
                  ORDER BY md5('0:' || vec_id), vec_id) - 1) % 4 AS fold FROM embeddings),
cells0 AS (
  SELECT vec_id, CAST(label >= 5 AS INTEGER) AS y, fold,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature,
         CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings JOIN folds USING (vec_id)),
cells AS (SELECT vec_id, y, feature, v FROM cells0 WHERE fold <> 0),
"""


def on_split(fragment: str) -> str:
    """The fragment with the train part of the split as its cells."""
    return "WITH " + SPLIT + fragment[len(I.MATRIX) + 1:].lstrip(" ,\n")


def split_matrix(spark, sf):
    m = I.matrix(spark, sf).written()
    marked = materialize(stratified_folds(m.rows, 4, "label", "id"))
    return m.split(marked, F.col("fold") != 0), m.split(marked, F.col("fold") == 0)


def predicted(model, test):
    return model.predict(test).select(
        F.col("id").alias("vec_id"), rounded(F.col("score")).alias("score"), "y_pred"
    )


@query("pls_predict", on_split(STD1) + """,
thr AS (SELECT avg(c * t) AS thr FROM t1, c1),
s AS (SELECT vec_id, sum((v - m) / sd * w) * any_value(c) AS score
      FROM cells0 JOIN st USING (feature) JOIN w1 USING (feature), c1 WHERE fold = 0 GROUP BY vec_id)
SELECT vec_id, round(score, 6) + 0.0e0 AS score, CAST(score >= thr AS INTEGER) AS y_pred FROM s, thr""")
def pls_predict(spark, sf):
    train, test = split_matrix(spark, sf)
    return predicted(PLS("standard", 1).fit(train), test)


# Ranks of test values among train values, one value at a time, by definition.
TEST_RANKS = f""",
tr AS (SELECT feature, v, {average_rank('feature', 'v')} AS rk, n FROM r),
te AS (SELECT vec_id, feature, v FROM cells0 WHERE fold = 0),
le AS (SELECT vec_id, te.feature, any_value(tr.n) AS n,
              sum(CAST(tr.v < te.v AS INTEGER)) AS l, sum(CAST(tr.v = te.v AS INTEGER)) AS e
       FROM te JOIN tr USING (feature) GROUP BY vec_id, te.feature),
d AS (SELECT vec_id, feature, v, pow(n + 2 - (l + e / 2.0e0 + 1), {NU}e0 - 1) AS own
      FROM te JOIN le USING (vec_id, feature)),
rang AS (
  SELECT vec_id, d.feature, any_value(own) - (any_value(own) + sum(
           CASE WHEN tr.v > d.v THEN pow(n + 1 - rk, {NU}e0 - 1)
                WHEN tr.v < d.v THEN pow(n + 2 - rk, {NU}e0 - 1) ELSE own END)) / (any_value(n) + 1) AS rang
  FROM d JOIN tr USING (feature) GROUP BY vec_id, d.feature)"""


@query("gini_test_rank", on_split(R) + TEST_RANKS + """
SELECT vec_id, feature, round(rang, 6) + 0.0e0 AS r FROM rang""")
def gini_test_rank(spark, sf):
    train, test = split_matrix(spark, sf)
    y = train.rows.select("id", F.col("label").cast("double").alias("y"))
    totals = y.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy")).first()
    cells = train.cells.where("value <> 0").join(y, "id")
    stats = M.stats_of_cells(cells, totals["n"], totals["sy"])
    ladder = ranks.with_rank(ranks.value_ladder(cells, stats, totals["n"], totals["sy"]))
    powers = ranks.ladder_powers(ladder, totals["n"], NU)
    r = ranks.new_value_ranks(powers, test.cells, totals["n"], NU)
    return test.cells.join(r, ["feature", "value"]).select(
        F.col("id").alias("vec_id"), "feature", rounded(F.col("r")).alias("r")
    )


# Scores of two components fitted on the train part, applied to the test part.
TWO_COMPONENTS = TEST_RANKS + """,
tt1 AS (SELECT vec_id, sum((v - m) / sd * w) AS t1 FROM te JOIN st USING (feature) JOIN w1 USING (feature)
        GROUP BY vec_id),
tt2 AS (SELECT vec_id, sum((rang - t1 * b) * w) AS t2 FROM rang JOIN tt1 USING (vec_id)
        JOIN b1 USING (feature) JOIN w2 USING (feature) GROUP BY vec_id),
tr2 AS (SELECT t1.t AS a, t2 AS b, ys FROM t1 JOIN t2 USING (vec_id)),
mm AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * ys) AS ay, sum(b * ys) AS by_,
              avg(a) AS ma, avg(b) AS mb FROM tr2),
cc AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb,
              ma, mb FROM mm)
SELECT vec_id, round(ca * t1 + cb * t2, 6) + 0.0e0 AS score,
       CAST(ca * t1 + cb * t2 >= ca * ma + cb * mb AS INTEGER) AS y_pred
FROM tt1 JOIN tt2 USING (vec_id), cc"""


@query("pls_gini_predict", on_split(GINI2) + TWO_COMPONENTS)
def pls_gini_predict(spark, sf):
    train, test = split_matrix(spark, sf)
    return predicted(PLS("gini", 2, nu=NU).fit(train), test)


@query("pls_logit_gini_predict", on_split(logit_sql("logit_gini")) + TWO_COMPONENTS)
def pls_logit_gini_predict(spark, sf):
    train, test = split_matrix(spark, sf)
    return predicted(PLS("logit_gini", 2, nu=NU).fit(train), test)


TEXT_SPLIT = I.FOLDS + f""",
docs AS (SELECT doc_id, label, fold, {I.sql_clean('text')} AS words FROM folds JOIN documents USING (doc_id)),
g AS (SELECT doc_id, label, fold, unnest(words) AS term FROM docs),
tc AS (SELECT doc_id, label, fold, term, count(*) AS cnt FROM g GROUP BY ALL),
nn AS (SELECT count(*) * 1.0e0 AS n, sum(label) * 1.0e0 AS n1 FROM docs WHERE fold <> 0),
dfs AS (SELECT term, count(*) * 1.0e0 AS df, sum(label) * 1.0e0 AS a1 FROM tc WHERE fold <> 0 GROUP BY term),
gw AS (SELECT term, abs(n * (a1 * ((n - n1) - (df - a1)) - (df - a1) * (n1 - a1))
              / (df * (n - df) * n1 * (n - n1))) AS gweight
       FROM dfs, nn WHERE df >= 2 AND df <> n),
raw AS (SELECT doc_id, label, fold, term, cnt / len(words) * gweight AS w
        FROM tc JOIN docs USING (doc_id, label, fold) JOIN gw USING (term) WHERE gweight <> 0),
v AS (SELECT doc_id, label, fold, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM raw),
st AS (SELECT term, sum(v) / any_value(n) AS m,
              sqrt((sum(v * v) - sum(v) * sum(v) / any_value(n)) / (any_value(n) - 1)) AS sd,
              (sum(v * label) - sum(v) * any_value(n1) / any_value(n)) / (any_value(n) - 1) AS cov
       FROM v, nn WHERE fold <> 0 GROUP BY term),
w1 AS (SELECT term, m, sd, cov / sd / (SELECT sqrt(sum(cov / sd * cov / sd)) FROM st) AS w FROM st),
base AS (SELECT sum(m * w / sd) AS o FROM w1),
t AS (SELECT docs.doc_id, docs.label, docs.fold, coalesce(sum(v * w / sd), 0) - any_value(o) AS t
      FROM docs LEFT JOIN (v JOIN w1 USING (term)) x ON x.doc_id = docs.doc_id, base
      GROUP BY docs.doc_id, docs.label, docs.fold),
c AS (SELECT sum(t * (label - n1 / n) / sqrt(n1 * (n - n1) / (n * (n - 1)))) / sum(t * t) AS c
      FROM t, nn WHERE fold <> 0)"""


@query("pls_text_predict", "WITH " + TEXT_SPLIT + """
SELECT doc_id AS id, label, round(c * t, 6) + 0.0e0 AS score, CAST(c * t >= 0 AS INTEGER) AS y_pred
FROM t, c WHERE fold = 0""")
def pls_text_predict(spark, sf):
    """TF-CHI2 vectors learned on one train split, standard variant, applied to its test split."""
    from ..operators.vectorizer import Vectorizer

    docs = I.labelled(spark, sf)
    marked = stratified_folds(docs.select("doc_id", "label"), 4, "label", "doc_id")
    placed = materialize(docs.join(marked.select("doc_id", "fold"), "doc_id"))
    train, test = placed.where("fold <> 0"), placed.where("fold = 0")
    model = Vectorizer("tfchi2", norm="l2").fit(train, words="words")

    def as_matrix(part):
        return Matrix.from_weights(part, model.transform(part, words="words"))

    scored = PLS("standard", 1).fit(as_matrix(train)).predict(as_matrix(test))
    return scored.withColumn("score", rounded(F.col("score")))
