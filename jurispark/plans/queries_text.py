"""Registered queries: texts, term statistics, folds and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ordering import rounded
from ..operators import clusters, folds, lemmas, selection, terms
from ..operators.vectorizer import Vectorizer
from ..sources import readers
from ..sources.scratch import materialize
from . import inputs as I
from .registry import query

# --- texts ---------------------------------------------------------------------


@query("clean_text", f"""
SELECT doc_id, array_to_string({I.sql_clean('text')}, ' ') AS text FROM documents""")
def clean_text(spark, sf):
    return I.documents(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("clean_tokens", f"""
SELECT doc_id, len({I.sql_tokens('text')}) AS n_tokens,
       len(list_filter({I.sql_tokens('text')}, lambda t: regexp_full_match(t, '\\p{{L}}+'))) AS n_alpha,
       len({I.sql_clean('text')}) AS n_kept
FROM documents""")
def clean_tokens(spark, sf):
    words = I.documents(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_tokens"),
        F.size(T.clean_tokens(F.col("w"), True, False)).cast("long").alias("n_alpha"),
        F.size(T.clean_tokens(F.col("w"))).cast("long").alias("n_kept"),
    )


@query("src_texts", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(quality AS VARCHAR) AS label,
       trim(regexp_replace(text, '{I.WS}', ' ', 'g')) AS text
FROM documents LEFT JOIN labels USING (doc_id)""")
def src_texts(spark, sf):
    labels = I.table(spark, sf, "labels")
    docs = I.table(spark, sf, "documents")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("quality").cast("string").alias("label"),
        T.collapse_whitespace(F.col("text")).alias("text"),
    )


@query("src_folder", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS label, text FROM documents""")
def src_folder(spark, sf):
    """Id and label read off the path of each document (source/id.v1.txt)."""
    path = F.concat(F.lit("file:/corpus/"), "source", F.lit("/"), "doc_id", F.lit(".v1.txt"))
    fields = readers.folder_fields(path)
    return I.table(spark, sf, "documents").select(*[c.alias(n) for n, c in fields.items()], "text")


@query("src_cv_layout", "WITH " + I.FOLDS + """
SELECT lang AS zone, source AS category, 4 AS n_folds, fold, 'test' AS split,
       CAST(label AS VARCHAR) AS label, CAST(doc_id AS VARCHAR) AS doc_id
FROM folds JOIN documents USING (doc_id)""")
def src_cv_layout(spark, sf):
    """Zone, category, fold, part, label and id read off the path of each document."""
    rows = I.predictions(spark, sf).where("classifier = 'len500'")
    path = F.format_string(
        "file:/root/cv-%s/%s_lemma_4_folds_cv/%d/test/%s-%d/%d.txt",
        "lang", "source", "fold", "source", "y_true", "doc_id",
    )
    found = rows.select(path.alias("path")).where(F.col("path").rlike(readers.CV_PATH))
    return found.select(*[c.alias(n) for n, c in readers.cv_fields(F.col("path")).items()])


@query("ngrams", "WITH " + I.TEXTS + """, p AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
g AS (
  SELECT w AS term FROM p
  UNION ALL
  SELECT w || ' ' || nw FROM (
    SELECT w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nw FROM p) WHERE nw IS NOT NULL)
SELECT term, count(*) AS n FROM g GROUP BY term""")
def ngrams(spark, sf):
    grams = terms.with_ngrams(I.texts(spark, sf), nmin=1, nmax=2, words="words")
    return (
        terms.explode_terms(grams, [], F.col("ngrams"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("strip_markers", """
SELECT page_id, regexp_replace(html, '<[^>]*(div|nav)[^>]*>', '', 'g') AS html FROM pages""")
def strip_markers(spark, sf):
    pages = I.table(spark, sf, "pages")
    return pages.select("page_id", T.strip_markers(F.col("html"), ("div", "nav")).alias("html"))


@query("nbsvm_normalize", r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(replace(lower(text), chr(10), ' '),
       '<br />', ' '), '([.",()!?;:])', ' \1 ', 'g'), '[ \t]+', ' ', 'g')) AS line
FROM conversations""")
def nbsvm_normalize(spark, sf):
    rows = I.table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", T.class_file_line(F.col("text")).alias("line"))


@query("fasttext_lines", f"""
SELECT conv_id, turn,
       '__label__' || role || ' ' || trim(regexp_replace(text, '{I.WS}', ' ', 'g')) || '.' AS line
FROM conversations""")
def fasttext_lines(spark, sf):
    rows = I.table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", T.supervised_line(F.col("role"), F.col("text")).alias("line"))


@query("decision_key", f"""
WITH t AS (SELECT doc_id, source, n_chars, {I.sql_tokens('text')}[1] AS city FROM documents)
SELECT doc_id, upper(source)
  || upper(replace(replace(replace(replace(replace(strip_accents(substring(city, 1, 3)),
     'ß', 'ss'), 'Œ', 'OE'), 'œ', 'oe'), 'Æ', 'AE'), 'æ', 'ae'))
  || upper(replace(doc_id || '/' || n_chars, '/', '')) || '.txt' AS decision_key
FROM t""")
def decision_key(spark, sf):
    first = F.get(T.tokens(F.col("text")), F.lit(0))
    number = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    return I.documents(spark, sf).select(
        "doc_id", T.decision_key(F.col("source"), first, number).alias("decision_key")
    )


# Dictionary of the lemma queries: tokens that end in s, without it.
SQL_LEMMAS = I.TEXTS + """, tok AS (SELECT DISTINCT unnest(words) AS token FROM docs),
lem AS (SELECT token, left(token, length(token) - 1) AS lemma FROM tok
        WHERE token LIKE '%s' AND length(token) > 1)"""


@query("lemmatize", "WITH " + SQL_LEMMAS + """, p AS (
  SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS i FROM docs),
j AS (SELECT doc_id, i, coalesce(lemma, p.token) AS w FROM p LEFT JOIN lem USING (token)),
a AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(text, '') AS text FROM docs LEFT JOIN a USING (doc_id)""")
def lemmatize(spark, sf):
    docs = I.texts(spark, sf)
    tokens = terms.explode_terms(docs, [], F.array_distinct("words")).distinct()
    dictionary = tokens.where(F.col("term").endswith("s") & (F.length("term") > 1)).select(
        F.col("term").alias("token"),
        F.expr("left(term, length(term) - 1)").alias("lemma"),
    )
    out = lemmas.lemmatize(docs, materialize(dictionary))
    return out.select("doc_id", F.array_join("words", " ").alias("text"))


@query("lemma_clean_text", f"""
WITH docs AS (SELECT doc_id, {I.sql_tokens('text')} AS words FROM documents),
tok AS (SELECT DISTINCT unnest(words) AS token FROM docs),
lem AS (SELECT token, left(token, length(token) - 1) AS lemma FROM tok
        WHERE token LIKE '%s' AND length(token) > 1),
p AS (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS i FROM docs),
j AS (SELECT doc_id, i, coalesce(lemma, p.token) AS w FROM p LEFT JOIN lem USING (token)),
a AS (SELECT doc_id, string_agg(lower(w), ' ' ORDER BY i) AS text FROM j
      WHERE regexp_full_match(w, '\\p{{L}}+') AND length(w) > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(text, '') AS text FROM docs LEFT JOIN a USING (doc_id)""")
def lemma_clean_text(spark, sf):
    """The whole preprocessing chain, lemmas from tokens that end in s."""
    docs = I.documents(spark, sf)
    seen = terms.explode_terms(docs, [], F.array_distinct(T.tokens(F.col("text")))).distinct()
    dictionary = seen.where(F.col("term").endswith("s") & (F.length("term") > 1)).select(
        F.col("term").alias("token"),
        F.expr("left(term, length(term) - 1)").alias("lemma"),
    )
    return lemmas.clean_with_lemmas(docs, materialize(dictionary))


# --- term statistics -------------------------------------------------------------


def labelled_grams(spark, sf):
    return I.labelled(spark, sf).withColumnRenamed("words", "ngrams")


def text_grams(spark, sf):
    return I.texts(spark, sf).withColumnRenamed("words", "ngrams")


@query("term_counts", "WITH " + I.TEXT_COUNTS + """
SELECT doc_id, term, cnt, CAST(size AS BIGINT) AS size FROM tc JOIN sizes USING (doc_id)""")
def term_counts(spark, sf):
    return terms.term_counts(text_grams(spark, sf), ["doc_id"])


@query("tf_weights", "WITH " + I.TEXT_COUNTS + """
SELECT doc_id, term, round(cnt / size, 6) + 0.0e0 AS tf FROM tc JOIN sizes USING (doc_id)""")
def tf_weights(spark, sf):
    counts = terms.term_counts(text_grams(spark, sf), ["doc_id"])
    return counts.select("doc_id", "term", rounded(F.col("cnt") / F.col("size")).alias("tf"))


@query("doc_freq", "WITH " + I.TEXT_COUNTS + " SELECT term, df FROM dfs")
def doc_freq(spark, sf):
    return terms.document_frequency(text_grams(spark, sf))


@query("vocabulary", "WITH " + I.TEXT_COUNTS + " SELECT term, df FROM dfs WHERE df >= 2")
def vocabulary(spark, sf):
    return terms.vocabulary(text_grams(spark, sf))


@query("idf_weights", "WITH " + I.TEXT_IDF + """
SELECT term, df, round(gweight, 6) + 0.0e0 AS gweight FROM idf""")
def idf_weights(spark, sf):
    return terms.idf_weights(text_grams(spark, sf)).withColumn("gweight", rounded(F.col("gweight")))


SQL_CLASS_COUNTS = I.COUNTS + """, nc AS (SELECT label, count(*) AS nc FROM docs GROUP BY label),
tl AS (SELECT term, label, count(*) AS a FROM tc GROUP BY term, label),
ct AS (SELECT dfs.term, df, nc.label, nc, coalesce(a, 0) AS a FROM dfs CROSS JOIN nc
       LEFT JOIN tl ON tl.term = dfs.term AND tl.label = nc.label),
chi AS (SELECT term, df, label, a,
  CASE WHEN df * (n - df) * nc * (n - nc) <> 0
       THEN n * 1.0e0 * (a * 1.0e0 * ((n - nc) - (df - a)) - (df - a) * 1.0e0 * (nc - a))
            / (df * 1.0e0 * (n - df) * nc * (n - nc)) ELSE 0.0e0 END AS chi2
  FROM ct, nd)"""


@query("class_term_counts", "WITH " + SQL_CLASS_COUNTS + """
SELECT term, label, a AS n_term_class, df FROM ct""")
def class_term_counts(spark, sf):
    docs = labelled_grams(spark, sf)
    return terms.class_term_counts(docs, "label", terms.distinct_labels(docs)).select(
        "term", "label", "n_term_class", "df"
    )


@query("chi2_weights", "WITH " + SQL_CLASS_COUNTS + """
SELECT term, df, round(1e6 * max(chi2), 6) + 0.0e0 AS gweight_e6 FROM chi
WHERE df >= 2 GROUP BY term, df HAVING max(chi2) <> 0""")
def chi2_weights(spark, sf):
    model = Vectorizer("tfchi2").fit(I.labelled(spark, sf), words="words")
    return model.table.select("term", "df", rounded(F.col("gweight") * 1e6).alias("gweight_e6"))


@query("top_terms", "WITH " + SQL_CLASS_COUNTS + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(1e6 * chi2, 6) DESC, term) AS rank
  FROM chi)
SELECT label, term, CAST(rank AS INTEGER) AS rank, round(1e6 * chi2, 6) + 0.0e0 AS chi2_e6
FROM r WHERE rank <= 10""")
def top_terms(spark, sf):
    scores = terms.chi2_scores(labelled_grams(spark, sf)).withColumn(
        "chi2_e6", rounded(F.col("chi2") * 1e6)
    )
    return terms.top_terms(scores, "label", "chi2_e6", 10)


SQL_TFIDF = I.TEXT_IDF + """, w AS (
  SELECT doc_id, label, term, cnt / size * gweight AS weight
  FROM tc JOIN sizes USING (doc_id) JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS len FROM w GROUP BY doc_id)"""


def tfidf(spark, sf, norm):
    docs = I.texts(spark, sf)
    weights = Vectorizer("tfidf", norm=norm).fit_transform(docs, words="words")
    return weights.withColumn("weight", rounded(F.col("weight")))


@query("tfidf_weights", "WITH " + SQL_TFIDF + """
SELECT doc_id, term, round(weight, 6) + 0.0e0 AS weight FROM w""")
def tfidf_weights(spark, sf):
    return tfidf(spark, sf, None)


@query("tfidf_vectors", "WITH " + SQL_TFIDF + """
SELECT doc_id, term, round(weight * len, 6) + 0.0e0 AS weight FROM w JOIN nrm USING (doc_id)""")
def tfidf_vectors(spark, sf):
    return tfidf(spark, sf, "compat")


@query("tfidf_vectors_l2", "WITH " + SQL_TFIDF + """
SELECT doc_id, term, round(weight / len, 6) + 0.0e0 AS weight FROM w JOIN nrm USING (doc_id)""")
def tfidf_vectors_l2(spark, sf):
    return tfidf(spark, sf, "l2")


@query("tfidf_apply", "WITH " + I.IDF + f""", u AS (
  SELECT doc_id, {I.sql_clean('text')} AS words FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
ug AS (SELECT doc_id, unnest(words) AS term FROM u),
uc AS (SELECT doc_id, term, count(*) AS cnt FROM ug GROUP BY ALL),
w AS (SELECT doc_id, term, cnt / len(words) * gweight AS weight
      FROM uc JOIN u USING (doc_id) JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS len FROM w GROUP BY doc_id)
SELECT doc_id, term, round(weight * len, 6) + 0.0e0 AS weight FROM w JOIN nrm USING (doc_id)""")
def tfidf_apply(spark, sf):
    """Weights learned on the labelled documents, applied to the others."""
    model = Vectorizer("tfidf").fit(I.labelled(spark, sf), words="words")
    rest = I.documents(spark, sf).join(I.table(spark, sf, "labels"), "doc_id", "left_anti")
    new = rest.select("doc_id", T.clean_words(F.col("text")).alias("words"))
    return model.transform(new, words="words").withColumn("weight", rounded(F.col("weight")))


@query("vectors_wide", "WITH " + I.TEXT_IDF + """, w AS (
  SELECT doc_id, term, cnt / size * gweight AS weight
  FROM tc JOIN sizes USING (doc_id) JOIN idf USING (term)
  WHERE term IN ('das', 'la', 'the', 'und'))
SELECT doc_id AS id, label,
       round(coalesce(max(CASE WHEN term = 'das' THEN weight END), 0), 6) + 0.0e0 AS das,
       round(coalesce(max(CASE WHEN term = 'la' THEN weight END), 0), 6) + 0.0e0 AS la,
       round(coalesce(max(CASE WHEN term = 'the' THEN weight END), 0), 6) + 0.0e0 AS the,
       round(coalesce(max(CASE WHEN term = 'und' THEN weight END), 0), 6) + 0.0e0 AS und
FROM docs LEFT JOIN w USING (doc_id) GROUP BY doc_id, label""")
def vectors_wide(spark, sf):
    names = ["das", "la", "the", "und"]
    docs = I.all_labelled(spark, sf)
    weights = Vectorizer("tfidf", norm=None).fit(docs, words="words").transform(docs, words="words")
    wide = I.Matrix.from_weights(docs, weights).to_wide(names)
    return wide.select("id", "label", *[rounded(F.col(c)).alias(c) for c in names])


# --- folds -----------------------------------------------------------------------


def labelled_rows(spark, sf):
    labels = I.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return I.table(spark, sf, "documents").select("doc_id").join(labels, "doc_id")


@query("stratified_folds", "WITH " + I.FOLDS + " SELECT doc_id, label, fold FROM folds")
def stratified_folds(spark, sf):
    return folds.stratified_folds(labelled_rows(spark, sf), 4, "label", "doc_id")


@query("kf_split", """WITH k AS (
  SELECT least(60, min(n)) AS k FROM (
    SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality))
SELECT doc_id, quality AS label, CAST((row_number() OVER (
  PARTITION BY quality ORDER BY md5('0:' || doc_id), doc_id) - 1) % k AS INTEGER) AS fold
FROM documents JOIN labels USING (doc_id), k""")
def kf_split(spark, sf):
    return folds.inner_folds(labelled_rows(spark, sf), 60, "label", "doc_id")


@query("cv_expand", "WITH " + I.FOLDS + """
SELECT doc_id, label, fold, CAST(cv AS INTEGER) AS cv,
       CASE WHEN fold = cv THEN 'test' ELSE 'train' END AS split
FROM folds, range(4) t(cv)""")
def cv_expand(spark, sf):
    return folds.cv_expand(folds.stratified_folds(labelled_rows(spark, sf), 4, "label", "doc_id"), 4)


@query("balance_classes", "WITH " + I.FOLDS + """,
smallest AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM rn GROUP BY label))
SELECT doc_id, label FROM rn, smallest WHERE r <= m""")
def balance_classes(spark, sf):
    return selection.balance_classes(labelled_rows(spark, sf), "label", "doc_id").select(
        "doc_id", "label"
    )


# --- selection -------------------------------------------------------------------


def chosen_claims(spark, sf):
    return selection.matching_claims(I.claims(spark, sf), "object", "norm", "F", "1-URGENT")


SQL_SINGLE = "WITH " + I.CLAIMS + """, one AS (
  SELECT decision, min(trim(outcome)) AS outcome FROM claims
  WHERE object = 'F' AND norm = '1-URGENT' GROUP BY decision HAVING count(*) = 1)"""


@query("claims_filter", "WITH " + I.CLAIMS + """
SELECT decision, object, norm, outcome FROM claims WHERE object = 'F' AND norm = '1-URGENT'""")
def claims_filter(spark, sf):
    return chosen_claims(spark, sf).select("decision", "object", "norm", "outcome")


def single(spark, sf):
    return selection.single_claims(chosen_claims(spark, sf), "decision", F.col("outcome"))


@query("single_claim", SQL_SINGLE + " SELECT decision, outcome FROM one")
def single_claim(spark, sf):
    return single(spark, sf)


@query("single_claim_docs", SQL_SINGLE + """
SELECT decision, outcome, text FROM one JOIN documents ON decision = doc_id""")
def single_claim_docs(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("decision"), "text")
    return selection.with_documents(single(spark, sf), docs, "decision")


@query("missing_docs", SQL_SINGLE + """
SELECT decision, outcome FROM one WHERE decision NOT IN (SELECT doc_id FROM documents)""")
def missing_docs(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("decision"))
    return selection.without_documents(single(spark, sf), docs, "decision")


@query("select_decisions", SQL_SINGLE + """
SELECT decision, outcome, CAST(decision IN (SELECT doc_id FROM documents) AS INTEGER) AS found
FROM one""")
def select_decisions(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("decision"))
    claims = chosen_claims(spark, sf)
    return selection.select_decisions(claims, docs, "decision", F.col("outcome"))


# --- word clusters ---------------------------------------------------------------

# Dictionary of the cluster queries: tokens of 3 letters or more by first letter.
SQL_CLUSTERS = f"""WITH docs AS (SELECT doc_id, {I.sql_clean('text')} AS words FROM documents),
g AS (SELECT doc_id, unnest(words) AS word FROM docs),
dict AS (SELECT DISTINCT word, left(word, 1) AS cluster FROM g WHERE length(word) >= 3),
post AS (SELECT cluster, doc_id, count(*) AS n FROM g JOIN dict USING (word) GROUP BY ALL),
idx AS (SELECT cluster, 1 AS size, CAST(sum(n) AS BIGINT) AS n_occ, count(*) AS n_docs
        FROM post GROUP BY cluster)"""


def postings(spark, sf):
    words = I.documents(spark, sf).select("doc_id", T.clean_words(F.col("text")).alias("ngrams"))
    # Written, so that texts are tokenised once for dictionary and postings.
    counts = materialize(terms.term_counts(words, ["doc_id"]).select("doc_id", "term", "cnt"))
    raw = (
        counts.select("term")
        .where(F.length("term") >= 3)
        .distinct()
        .select("term", F.expr("left(term, 1)").alias("cluster"))
    )
    dictionary = materialize(clusters.clean_dictionary(raw, "term", "cluster"))
    return clusters.cluster_postings(counts, dictionary)


@query("cluster_postings", SQL_CLUSTERS + " SELECT cluster, doc_id, n FROM post")
def cluster_postings(spark, sf):
    return postings(spark, sf)


@query("cluster_index", SQL_CLUSTERS + " SELECT cluster, size, n_occ, n_docs FROM idx")
def cluster_index(spark, sf):
    return clusters.cluster_index(postings(spark, sf))


@query("cluster_posting_lines", SQL_CLUSTERS + """
SELECT cluster, part, string_agg(doc_id || '-' || n, ':' ORDER BY doc_id) AS postings
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY cluster ORDER BY doc_id) - 1) // 10000 AS INTEGER)
        AS part FROM post)
GROUP BY cluster, part""")
def cluster_posting_lines(spark, sf):
    return clusters.posting_lines(postings(spark, sf))


@query("cluster_summary", SQL_CLUSTERS + """
SELECT count(*) AS nb_scanned_words, count(*) AS size_voc, count(*) AS nb_validated_scanned_words,
       (SELECT count(*) FROM documents) AS nb_files FROM idx""")
def cluster_summary(spark, sf):
    index = clusters.cluster_index(postings(spark, sf))
    return clusters.index_summary(index, I.table(spark, sf, "documents"))
