"""Queries: features, models, clustering."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tracehold.operators import features, models
from tracehold.plans.registry import query
from tracehold.plans.views import LOGS_CTE, as_text, logs, r6, table
from tracehold.session import stage, staging_path

TRAINED_AT = "2024-02-01T00:00:00"


@query(
    "time_features",
    """SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend FROM events""",
)
def time_features(spark, folder):
    """H1: hour, weekday, weekend."""
    return as_text(features.time_features(logs(spark, folder)).select("event_id", "hour", "day_of_week", "is_weekend"))


def _with_gaps(spark, folder):
    """Order totals, missing for open orders."""
    return table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("total"), F.col("o_custkey").cast("double").alias("cust")
    )


@query(
    "numeric_features",
    f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS total, CAST(o_custkey AS DOUBLE) AS cust FROM orders),
f AS (SELECT o_orderkey, coalesce(total, (SELECT avg(total) FROM o)) AS total, cust FROM o),
s AS (SELECT avg(total) AS tm, stddev_pop(total) AS td, avg(cust) AS cm, stddev_pop(cust) AS cd FROM f)
SELECT o_orderkey, {r6('(total - tm) / td')} AS total, {r6('(cust - cm) / cd')} AS cust FROM f, s""",
)
def numeric_features(spark, folder):
    """H2: mean-filled, in population deviations."""
    return as_text(features.standardized(_with_gaps(spark, folder), ["total", "cust"], "o_orderkey"))


@query(
    "categorical_features",
    """SELECT o_orderkey, o_orderpriority AS level, CAST(1 AS BIGINT) AS value FROM orders WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders)""",
)
def categorical_features(spark, folder):
    """H3: one-hot columns in long form, the first level dropped."""
    return as_text(features.one_hot(table(spark, folder, "orders"), "o_orderpriority", "o_orderkey"))


_WORDS = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})', 1)"
_TFIDF = f"""w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY 1, 2),
v AS (SELECT term, sum(n) AS total, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term ORDER BY total DESC, term LIMIT 100),
x AS (SELECT doc_id, term, n * idf AS w FROM c JOIN v USING (term)), y AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id)"""


@query("text_features", f"WITH {_TFIDF} SELECT doc_id, term, {r6('w / norm')} AS weight FROM x JOIN y USING (doc_id)")
def text_features(spark, folder):
    """H4: TF-IDF of whole texts over the hundred most frequent terms, long form."""
    return as_text(features.tfidf(table(spark, folder, "documents"), ["text"], "doc_id"))


def feature_rows(spark, folder):
    return logs(spark, folder).select("event_id", "value", "k", "service", "message", "event_type")


@query(
    "assemble_features",
    f"""WITH {LOGS_CTE}, s AS (SELECT avg(value) AS mv, stddev_pop(value) AS dv, avg(k) AS mk, stddev_pop(k) AS dk, count(DISTINCT service) AS n, min(service) AS low FROM logs),
w AS (SELECT event_id, unnest(regexp_extract_all(lower(message), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM logs),
top AS (SELECT t FROM w GROUP BY t ORDER BY count(*) DESC, t LIMIT 100), has AS (SELECT DISTINCT event_id, 1 AS h FROM w JOIN top USING (t))
SELECT event_id, CAST(2 + n - 1 + (SELECT count(*) FROM top) AS BIGINT) AS size,
  round(sqrt(((value - mv) / dv) ** 2 + ((k - mk) / dk) ** 2 + CASE WHEN service <> low THEN 1 ELSE 0 END + coalesce(h, 0)), 6) + 0.0 AS length
FROM logs LEFT JOIN has USING (event_id), s""",
)
def assemble_features(spark, folder):
    """H5: numeric, one-hot and text features as one vector, described by size and length."""
    rows = feature_rows(spark, folder)
    model = features.fit_features(rows, ["value", "k"], ["service"], ["message"])
    vector = vector_to_array("features")
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return as_text(model.transform(rows).select("event_id", F.size(vector).alias("size"), length.alias("length")))


@query("anomaly_model")
def anomaly_model(spark, folder):
    """A forest trained, saved, loaded and applied to all rows."""
    rows = feature_rows(spark, folder)
    path = staging_path(spark, "models")
    model = models.train_anomaly_model(rows, "event_id", ["value", "k"], ["service"], trained_at=TRAINED_AT)
    models.save_model(spark, model, path, "iforest")
    return models.load_model(spark, path, "iforest").transform(rows).select("event_id", "anomaly", "anomaly_score")


# Scores differ, so the interpolated 5 % quantile has that many rows below it.
_BELOW = "CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT)"


@query(
    "anomaly_model_summary",
    f"SELECT count(*) AS total_records, {_BELOW} AS anomaly_count, {r6(_BELOW + ' * 100.0 / count(*)')} AS anomaly_percentage FROM events",
)
def anomaly_model_summary(spark, folder):
    """H7: rows, anomalies and percentage."""
    rows = feature_rows(spark, folder)
    model = models.train_anomaly_model(rows, "event_id", ["value", "k"])
    return as_text(models.score_summary(model.transform(rows)))


def _labelled(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    return stage(docs.join(table(spark, folder, "labels"), "doc_id"), "labelled")


@query("classify")
def classify(spark, folder):
    """A classifier on the labelled documents, applied to all documents."""
    model = models.train_classifier(_labelled(spark, folder), "quality", ["n_chars"], ["lang"], ["text"], trained_at=TRAINED_AT)
    path = staging_path(spark, "models")
    models.save_model(spark, model, path, "quality")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    scored = models.load_model(spark, path, "quality").transform(docs)
    return scored.select("doc_id", "predicted_class", *[c for c in scored.columns if c.startswith("prob_")])


@query("classify_events")
def classify_events(spark, folder):
    """H9: predicted classes counted against the true event type."""
    rows = feature_rows(spark, folder)
    model = models.train_classifier(rows, "event_type", ["value", "k"], ["service"])
    return model.transform(rows).groupBy("event_type", "predicted_class").agg(F.count("*").alias("n"))


@query(
    "classify_known",
    f"""WITH {LOGS_CTE} SELECT source_type, source_type AS predicted_class, count(*) AS n, TRUE AS sums_to_one FROM logs GROUP BY 1""",
)
def classify_known(spark, folder):
    """H8, H9: a label that the service decides, so every prediction is known; probabilities sum to one."""
    rows = logs(spark, folder).select("event_id", "value", "k", "service", "source_type")
    scored = models.train_classifier(rows, "source_type", ["value", "k"], ["service"]).transform(rows)
    total = sum(F.col(c) for c in scored.columns if c.startswith("prob_"))
    return scored.groupBy("source_type", "predicted_class").agg(F.count("*").alias("n"), F.min(F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query(
    "list_models",
    f"""SELECT 'iforest' AS name, 'isolation_forest' AS type, '{TRAINED_AT}' AS training_date, count(*) AS training_rows FROM events
UNION ALL SELECT 'types', 'random_forest', '{TRAINED_AT}', count(*) FROM events WHERE event_type IS NOT NULL""",
)
def list_models(spark, folder):
    """Stored models with type and training date."""
    rows = feature_rows(spark, folder)
    path = staging_path(spark, "models")
    models.save_model(spark, models.train_anomaly_model(rows, "event_id", ["value"], trained_at=TRAINED_AT), path, "iforest")
    models.save_model(spark, models.train_classifier(rows, "event_type", ["value"], trained_at=TRAINED_AT), path, "types")
    return models.list_models(spark, path)


@query("cluster_events")
def cluster_events(spark, folder):
    """Clusters of value and k per service."""
    rows = feature_rows(spark, folder)
    return models.cluster_events(rows, "event_id", ["value", "k"], ["service"], eps=0.25, min_samples=10)


@query("cluster_stats")
def cluster_stats(spark, folder):
    """Size, share and value statistics per cluster."""
    rows = feature_rows(spark, folder)
    found = stage(models.cluster_events(rows, "event_id", ["value", "k"], eps=0.25, min_samples=10), "clusters")
    return models.cluster_stats(rows, found, "event_id", ["value", "k"])


# On a line: core points by counting neighbours, clusters by gaps between core points.
_LINE = f"""WITH {LOGS_CTE}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM logs), p AS (SELECT event_id, service, (value - m) / d AS x FROM logs, s),
n AS (SELECT *, count(*) OVER (ORDER BY x RANGE BETWEEN 0.1 PRECEDING AND 0.1 FOLLOWING) AS near FROM p),
o AS (SELECT *, CASE WHEN x - lag(x) OVER (ORDER BY x, event_id) <= 0.1 THEN 0 ELSE 1 END AS opens FROM n WHERE near >= 5),
g AS (SELECT *, sum(opens) OVER (ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
c AS (SELECT run, row_number() OVER (ORDER BY min(event_id)) - 1 AS cluster FROM g GROUP BY run),
k AS (SELECT g.event_id, g.x, c.cluster FROM g JOIN c USING (run)),
e AS (SELECT n.event_id, n.service, n.x, k.cluster, last_value(k.x IGNORE NULLS) OVER w AS lx, last_value(k.cluster IGNORE NULLS) OVER w AS lc,
  first_value(k.x IGNORE NULLS) OVER v AS rx, first_value(k.cluster IGNORE NULLS) OVER v AS rc FROM n LEFT JOIN k USING (event_id)
  WINDOW w AS (ORDER BY n.x, n.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (ORDER BY n.x, n.event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT event_id, service, coalesce(cluster, least(CASE WHEN x - lx <= 0.1 THEN lc END, CASE WHEN rx - x <= 0.1 THEN rc END), -1) AS cluster FROM e)
{{}}"""


@query("cluster_categories", _LINE.format("SELECT cluster, service AS value, count(*) AS n FROM f GROUP BY 1, 2"))
def cluster_categories(spark, folder):
    """Services per cluster."""
    rows = feature_rows(spark, folder)
    found = models.cluster_events(rows, "event_id", ["value"], eps=0.1, min_samples=5)
    return models.cluster_categories(rows, found, "event_id", "service")


@query("cluster_line", _LINE.format("SELECT event_id, CAST(cluster AS BIGINT) AS cluster FROM f"))
def cluster_line(spark, folder):
    """The cluster of every event, numbered by first member, -1 for outliers."""
    rows = feature_rows(spark, folder)
    return models.cluster_events(rows, "event_id", ["value"], eps=0.1, min_samples=5)


@query(
    "cluster_line_stats",
    _LINE.format(
        f"""SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS size, {r6('avg(value)')} AS value_mean, {r6('stddev_samp(value)')} AS value_std, {r6('min(value)')} AS value_min,
{r6('max(value)')} AS value_max, {r6('count(*) * 100.0 / (SELECT count(*) FROM logs)')} AS percentage FROM f JOIN logs USING (event_id) GROUP BY 1"""
    ),
)
def cluster_line_stats(spark, folder):
    """Size, share and statistics of clusters and outliers."""
    rows = feature_rows(spark, folder)
    found = stage(models.cluster_events(rows, "event_id", ["value"], eps=0.1, min_samples=5), "clusters")
    return as_text(models.cluster_stats(rows, found, "event_id", ["value"]))


def _text_run(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    return models.text_density(docs, "doc_id", ["n_chars"], ["lang"], ["text"], eps=0.4, min_samples=5)


@query("cluster_text")
def cluster_text(spark, folder):
    """Clusters of whole texts by their terms, language and length."""
    return _text_run(spark, folder).clusters()


@query(
    "cluster_text_noise",
    f"""WITH {_TFIDF}, u AS (SELECT doc_id, term, w / norm AS w FROM x JOIN y USING (doc_id)),
s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d, min(lang) AS low FROM documents),
e AS (SELECT doc_id, (n_chars - m) / d AS z, CASE WHEN lang <> low THEN lang ELSE '' END AS kind, CASE WHEN norm > 0 THEN 1.0 ELSE 0.0 END AS own FROM documents LEFT JOIN y USING (doc_id), s),
dots AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.w * b.w) AS dot FROM u a JOIN u b USING (term) GROUP BY 1, 2),
near AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON abs(a.z - b.z) <= 0.4 LEFT JOIN dots ON dots.i = a.doc_id AND dots.j = b.doc_id
  WHERE a.doc_id = b.doc_id OR a.own + b.own - 2 * coalesce(dot, 0) + (a.z - b.z) ** 2
    + CASE WHEN a.kind = b.kind THEN 0 WHEN a.kind = '' OR b.kind = '' THEN 1 ELSE 2 END <= 0.4 ** 2),
n AS (SELECT i, count(*) AS close FROM near GROUP BY i)
SELECT n.i AS doc_id, n.close, n.close < 5 AND NOT EXISTS (SELECT 1 FROM near JOIN n c ON c.i = near.j WHERE near.i = n.i AND c.close >= 5) AS noise FROM n""",
)
def cluster_text_noise(spark, folder):
    """Neighbours of every document in that clustering, and which are outliers."""
    run = _text_run(spark, folder)
    noise = run.noise().withColumn("noise", F.lit(True))
    return run.neighbours().join(noise, "doc_id", "left").select("doc_id", "close", F.coalesce("noise", F.lit(False)).alias("noise"))
