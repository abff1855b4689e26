"""Label, text feature, classifier and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.functions.segment import dictionary_tokenizer
from civicpulse.ml import features, labels, metrics
from civicpulse.ml.evidence import is_fitted
from civicpulse.plans.classification import MODELS, classify
from civicpulse.session import broadcast_within
from querybook.book import query, six

_BREAK = r"[^\p{L}\p{M}\p{N}_]+"

SQL_LABELLED = """labelled AS (
  SELECT doc_id, text, list_filter([CASE WHEN quality = 1 THEN 'quality' END,
      CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS labels
  FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 1)"""

SQL_TERMS = f"""tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_BREAK}'), lambda t: t <> '')
    AS w FROM documents),
terms AS (SELECT doc_id, w, list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1])) AS terms FROM tokens)"""

SQL_VOCABULARY = f"""{SQL_TERMS},
counts AS (SELECT doc_id, term, count(*) AS n
  FROM (SELECT doc_id, unnest(terms) AS term FROM terms) GROUP BY ALL),
vocabulary AS (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM counts
  GROUP BY term HAVING count(*) >= 5 ORDER BY tf DESC, term LIMIT 5000)"""


def _tickets(t, marks=None):
    """Documents as comments, their labels (or ``marks``, the same rows) as a ``{a, b}`` type text."""
    flags = F.concat_ws(
        ", ",
        F.when(F.col("quality") == 1, "quality"),
        F.when(F.col("toxic") == 1, "toxic"),
    )
    return t.documents.join(t.labels if marks is None else marks, "doc_id").select(
        "doc_id", "text", F.concat(F.lit("{"), flags, F.lit("}")).alias("type")
    )


@query(
    "label_parse",
    f"WITH {SQL_LABELLED} SELECT doc_id, array_to_string(labels, '|') AS labels FROM labelled",
)
def label_parse(t):
    return labels.labelled(_tickets(t), "text").select(
        "doc_id", F.array_join("labels", "|").alias("labels")
    )


@query(
    "label_binarize",
    f"""WITH {SQL_LABELLED} SELECT doc_id,
      CASE WHEN list_contains(labels, 'quality') THEN '1' ELSE '0' END || ',' ||
      CASE WHEN list_contains(labels, 'toxic') THEN '1' ELSE '0' END AS y FROM labelled""",
)
def label_binarize(t):
    rows = labels.labelled(_tickets(t), "text")
    matrix = labels.binarize(labels.label_classes(rows)).cast("array<string>")
    return rows.select("doc_id", F.array_join(matrix, ",").alias("y"))


@query(
    "hash_split",
    """SELECT doc_id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR) || '|2025'), 1, 8) < '33333333'
      THEN 1 ELSE 0 END AS in_test FROM documents""",
)
def hash_split(t):
    return t.documents.select("doc_id", labels.in_test_set("doc_id").cast("int").alias("in_test"))


@query(
    "exact_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|2025'))
      <= ceil(count(*) OVER () / 5e0) THEN 1 ELSE 0 END AS in_test FROM documents""",
)
def exact_split(t):
    docs = t.documents.select("doc_id")
    return docs.select("doc_id", labels.in_exact_test_set(docs, "doc_id").cast("int").alias("in_test"))


@query("dictionary_tokens")
def dictionary_tokens(t):
    """Documents cut into the short words that occur alone in at least five of them."""
    found = features.with_terms(t.documents.select("text"), "text", ngram_range=(1, 1))
    known = features.term_statistics(found).where("df >= 5 AND length(term) BETWEEN 2 AND 8")
    cut = dictionary_tokenizer(known, "term")(F.lower("text"))
    return t.documents.select("doc_id", cut.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("digest")
    )


@query(
    "token_counts",
    f"""WITH {SQL_TERMS} SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct
    FROM terms""",
)
def token_counts(t):
    return features.token_counts(t.documents, "doc_id", "text")


@query(
    "ngrams",
    f"""WITH {SQL_TERMS} SELECT doc_id, len(terms) AS n_terms,
      md5(array_to_string(terms, '|')) AS digest FROM terms""",
)
def ngrams(t):
    return features.with_terms(t.documents, "text").select(
        "doc_id",
        F.size("terms").cast("bigint").alias("n_terms"),
        F.md5(F.array_join("terms", "|")).alias("digest"),
    )


@query("vocabulary", f"WITH {SQL_VOCABULARY} SELECT term, tf, df FROM vocabulary")
def vocabulary(t):
    tokens = features.with_terms(t.documents, "text", ngram_range=(1, 1))
    return features.vocabulary(tokens, ngram_range=fixed.NGRAM_RANGE)


@query(
    "tfidf_weights",
    f"""WITH {SQL_VOCABULARY}, n AS (SELECT count(*) AS n FROM documents),
    raw AS (SELECT doc_id, term, c.n * (ln((1 + n.n) / (1e0 + df)) + 1) AS w
      FROM counts c JOIN vocabulary USING (term), n)
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
    FROM raw""",
)
def tfidf_weights(t):
    texts = features.with_tokens(t.documents.select("doc_id", "text"), "text")
    model = features.fit_tfidf(texts, "text")
    return six(model.weights(texts, "doc_id"))


SQL_SCORED = """scored AS (SELECT doc_id, quality AS t1, toxic AS t2,
    CAST(n_chars > 600 AS INTEGER) AS p1, CAST(n_chars % 7 = 0 AS INTEGER) AS p2
  FROM documents JOIN labels USING (doc_id)),
confusion AS (
  SELECT 'quality' AS label, t1 AS t, p1 AS p FROM scored
  UNION ALL SELECT 'toxic', t2, p2 FROM scored),
per_label AS (SELECT label, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn
  FROM confusion GROUP BY label),
s AS (SELECT label, tp, fp, fn, tp + fn AS support,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
    coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM per_label)"""


def _scored(t):
    n = F.col("n_chars")
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        F.array("quality", "toxic").alias("truth"),
        F.array((n > 600).cast("int"), (n % 7 == 0).cast("int")).alias("predicted"),
    )


@query(
    "f1_scores",
    f"""WITH {SQL_SCORED}
    SELECT round(avg(f1), 6) AS macro_f1,
      round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 6) AS micro_f1,
      round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM s""",
)
def f1_scores(t):
    return six(metrics.f1_scores(_scored(t)))


@query(
    "classification_report",
    f"""WITH {SQL_SCORED}, r AS (
    SELECT label, precision, recall, f1, support FROM s
    UNION ALL SELECT 'micro avg', sum(tp) / (sum(tp) + sum(fp))::DOUBLE,
      sum(tp) / (sum(tp) + sum(fn))::DOUBLE,
      2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, sum(support) FROM s
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
      sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s
    UNION ALL SELECT 'samples avg',
      avg(coalesce((t1 * p1 + t2 * p2) / nullif(p1 + p2, 0)::DOUBLE, 0)),
      avg(coalesce((t1 * p1 + t2 * p2) / nullif(t1 + t2, 0)::DOUBLE, 0)),
      avg(coalesce(2 * (t1 * p1 + t2 * p2) / nullif(t1 + t2 + p1 + p2, 0)::DOUBLE, 0)),
      sum(t1 + t2) FROM scored)
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r""",
)
def classification_report(t):
    return six(metrics.classification_report(_scored(t), ["quality", "toxic"]))


SQL_GRADED = """graded AS (SELECT doc_id, quality AS t1, toxic AS t2,
    (n_chars % 101) / 101e0 AS s1, (doc_id % 17) / 17e0 AS s2 FROM documents JOIN labels USING (doc_id)),
cell AS (SELECT CAST(0 AS INTEGER) AS label, t1 AS t, s1 AS s FROM graded UNION ALL SELECT 1, t2, s2 FROM graded)"""


def _graded(t):
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        F.array("quality", "toxic").alias("truth"),
        F.array(F.col("n_chars") % 101 / F.lit(101e0), F.col("doc_id") % 17 / F.lit(17e0)).alias("scores"),
    )


@query(
    "ranking_scores",
    f"""WITH {SQL_GRADED}, c AS (SELECT label, s, sum(t) AS p, sum(1 - t) AS n FROM cell GROUP BY ALL),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY s
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
    SELECT label, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
      round(sum(p * (b + n / 2e0)) / nullif(sum(p)::DOUBLE * sum(n), 0), 6) AS auc FROM r GROUP BY label""",
)
def ranking_scores(t):
    return six(metrics.ranking_scores(_graded(t), slices=8))


@query(
    "calibration",
    f"""WITH {SQL_GRADED} SELECT label, CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, count(*) AS n,
      round(avg(s), 6) AS mean_probability, round(avg(t), 6) AS rate FROM cell GROUP BY ALL""",
)
def calibration(t):
    return six(metrics.calibration(_graded(t), probabilities="scores"))


SQL_TEST_ROWS = f"""WITH {SQL_LABELLED}
    SELECT doc_id, CASE WHEN list_contains(labels, 'quality') THEN '1' ELSE '0' END || ',' ||
      CASE WHEN list_contains(labels, 'toxic') THEN '1' ELSE '0' END AS truth, true AS fitted
    FROM labelled WHERE md5(CAST(doc_id AS VARCHAR) || '|{fixed.SPLIT_SEED}')[1:8]
      < '{int(fixed.TEST_FRACTION * 2**32):08x}'"""


def _classified(t, model):
    """Test rows with their truth.

    ``fitted`` says that the model of every class passes its test, that the loss worked out from
    the scores of the training rows beside their truth is the one the fit ended with (scores of other rows
    would give another), and that a row's predictions follow from its scores.
    """
    # A million labels are some 40 MB; beside them the texts need no shuffle.
    tickets = _tickets(t, broadcast_within(t.labels.select("doc_id", "quality", "toxic"), max_rows=1_000_000))
    done = classify(tickets, "doc_id", "text", "type", models={model: MODELS[model]})
    sound = is_fitted(done.fitted[model], done.training[model])
    done.close()
    follows = F.forall(F.arrays_zip("predicted", "scores"), lambda c: c["predicted"] == (c["scores"] > 0).cast("int"))
    whole = (F.size("predicted") == len(done.classes)) & follows
    return done.results[model].select(
        "doc_id",
        F.array_join(F.col("truth").cast("array<string>"), ",").alias("truth"),
        (F.lit(sound) & whole).alias("fitted"),
    )


@query("ovr_logistic", SQL_TEST_ROWS)
def ovr_logistic(t):
    return _classified(t, "logistic")


@query("ovr_gbt", SQL_TEST_ROWS)
def ovr_gbt(t):
    return _classified(t, "boosted_trees")


@query("ovr_svc", SQL_TEST_ROWS)
def ovr_svc(t):
    return _classified(t, "linear_svc")


@query("ovr_predictions")
def ovr_predictions(t):
    """Test rows with truth, prediction and score of the logistic model."""
    done = classify(_tickets(t), "doc_id", "text", "type", models={"logistic": MODELS["logistic"]})
    done.close()
    digits = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("truth", "predicted")]
    scores = F.array_join(F.transform("scores", lambda s: F.format_number(s, 2)), ",").alias("scores")
    return done.results["logistic"].select("doc_id", *digits, scores)
