"""Models of difficulty and stop risk fitted on the test tables, and what they predict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import boosting, calibrate, fitting
from scoreloom.plans.proxy import RECORDS_SQL, TOP, judged, score_records
from scoreloom.session import reliable_checkpoints


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(score_records(spark, sf_dir)).select("dataset", "d", "x", "units", (F.col("units") * 4 > TOP).alias("severe"))


def ridge_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostic model: error by discount and tax, ridge with alpha 1."""
    model = fitting.ridge(_features(spark, sf_dir), ["d", "x"], "units")
    e6 = lambda v: F.floor(F.lit(float(v)) * 1e6 + 0.5)
    names = ["d", "x", "intercept"]
    rows = spark.createDataFrame([(n, float(v)) for n, v in zip(names, [*model["weights"], model["intercept"]], strict=True)], "feature string, weight double")
    return rows.select("feature", F.floor(F.col("weight") * 1e6 + 0.5).alias("weight_e6"), F.lit(model["rows"]).cast("long").alias("rows"), e6(model["alpha"]).alias("alpha_e6"))


def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and mean error of every combination of discount and tax."""
    rows = _features(spark, sf_dir)
    predicted = fitting.linear(fitting.ridge(rows, ["d", "x"], "units"))
    return rows.groupBy("d", "x").agg(F.count("*").alias("n"), (F.sum("units") / F.count("*")).alias("mean")).select("d", "x", "n", F.floor(F.col("mean") * 1e3 + 0.5).alias("mean_e3"), F.floor(predicted * 1e3 + 0.5).alias("predicted_e3"))


def clipped_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture model: slopes, with predictions kept within the errors that were fitted."""
    rows = _features(spark, sf_dir).where("dataset = 'A'")
    low, high = rows.agg(F.min("units"), F.max("units")).first()
    done = fitting.clipped(calibrate.slopes(rows, ["d", "x"], "units"), _features(spark, sf_dir).select((F.col("d") * 3 - 10).alias("d"), F.col("x")).distinct(), ["d", "x"], (low or 0, high or 0))
    return done.select("d", "x", F.floor(F.col("predicted") * 1e6 + 0.5).alias("predicted_e6"))


def boosted_first_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary model's first tree of two leaves: where it cuts, and what its leaves say."""
    model = boosting.fit(_features(spark, sf_dir), ["d", "x"], "units", trees=1, leaves=2)
    tree = model.trees[0]
    rows = [(model.features[tree.feature[0]], float(model.edges[tree.feature[0]][tree.cut[0]]), tree.value[tree.left[0]], tree.value[tree.right[0]], model.base)]
    made = spark.createDataFrame(rows, "feature string, threshold double, left_value double, right_value double, base double")
    return made.select("feature", "threshold", *[F.floor(F.col(c) * 1e6 + 0.5).alias(f"{c}_e6") for c in ("left_value", "right_value", "base")])


def boosted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that the primary model (up to 200 trees, ended by a tenth of the items that it does not see) predicts for every
    combination of features, next to their means."""
    reliable_checkpoints(spark)
    equal = _features(spark, sf_dir).groupBy("dataset", "d", "x", "units").agg(F.count("*").alias("n")).checkpoint()  # all that is read of the items, once
    rows = equal.withColumn("held", F.pmod(F.xxhash64("d", "x", "units", "dataset"), F.lit(10)) == 0).withColumn("kind", F.when(F.col("dataset") == "A", 0).when(F.col("dataset") == "N", 1).otherwise(2))
    model = boosting.fit(rows, ["d", "x", "kind"], "units", held_out="held", weight="n")
    means = rows.groupBy("dataset", "kind", "d", "x").agg(F.sum("n").alias("n"), (F.sum(F.col("units") * F.col("n")) / F.sum("n")).alias("mean"))
    return boosting.predict(model, means).select("dataset", "d", "x", "n", F.floor(F.col("mean") * 1e3 + 0.5).alias("mean_e3"), F.floor(F.col("predicted") * 1e3 + 0.5).alias("predicted_e3"))


def stop_risk_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head that predicts severe errors from discount and tax, after its 200 epochs."""
    model = fitting.fit_stop_risk(_features(spark, sf_dir), ["d", "x"], "severe")
    rows = [*((f, m, s, w) for f, m, s, w in zip(*(model[k] for k in ("features", "means", "scales", "weights")), strict=True)), ("bias", 0.0, 1.0, model["bias"])]
    e6 = lambda c: F.floor(F.col(c) * 1e6 + 0.5).alias(f"{c}_e6")
    counts = [F.lit(model[k]).cast("long").alias(k) for k in ("rows", "positives")]
    return spark.createDataFrame([(f, float(m), float(s), float(w)) for f, m, s, w in rows], "feature string, mean double, scale double, weight double").select("feature", e6("mean"), e6("scale"), e6("weight"), *counts)


QUERIES = {f.__name__: f for f in (ridge_difficulty, ridge_predictions, clipped_difficulty, boosted_first_split, boosted_predictions, stop_risk_head)}
_RIDGE = f"""WITH {RECORDS_SQL}, m AS (SELECT count(*) AS n, avg(d) AS md, avg(x) AS mx, avg(units) AS my, covar_pop(d, d) * count(*) + 1 AS a, covar_pop(d, x) * count(*) AS b, covar_pop(x, x) * count(*) + 1 AS c,
  covar_pop(d, units) * count(*) AS p, covar_pop(x, units) * count(*) AS q FROM judged),
  w AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS wd, (a * q - b * p) / (a * c - b * b) AS wx FROM m)"""
ORACLES = {
    "ridge_difficulty": f"""{_RIDGE} SELECT f AS feature, floor(v * 1e6::DOUBLE + 0.5)::BIGINT AS weight_e6, n AS rows, 1000000::BIGINT AS alpha_e6
        FROM (SELECT n, unnest(['d', 'x', 'intercept']) AS f, unnest([wd, wx, my - wd * md - wx * mx]) AS v FROM w)""",
    "ridge_predictions": f"""{_RIDGE} SELECT d, x, count(*) AS n, floor(sum(units)::DOUBLE / count(*) * 1e3::DOUBLE + 0.5)::BIGINT AS mean_e3,
        floor((any_value(my) + any_value(wd) * (d - any_value(md)) + any_value(wx) * (x - any_value(mx))) * 1e3::DOUBLE + 0.5)::BIGINT AS predicted_e3 FROM judged CROSS JOIN w GROUP BY d, x""",
    "clipped_difficulty": f"""WITH {RECORDS_SQL}, r AS (SELECT * FROM judged WHERE dataset = 'A'), m AS (SELECT avg(d) AS md, avg(x) AS mx, avg(units) AS my, coalesce(covar_pop(d, units) / nullif(var_pop(d), 0), 0) / 2 AS wd,
        coalesce(covar_pop(x, units) / nullif(var_pop(x), 0), 0) / 2 AS wx, min(units) AS low, max(units) AS high FROM r)
        SELECT d, x, floor(greatest(low, least(high, my + wd * (d - md) + wx * (x - mx))) * 1e6::DOUBLE + 0.5)::BIGINT AS predicted_e6 FROM (SELECT DISTINCT d * 3 - 10 AS d, x FROM judged) CROSS JOIN m""",
    "boosted_first_split": f"""WITH {RECORDS_SQL}, m AS (SELECT avg(units) AS base, count(*) AS n FROM judged), v AS (SELECT feature, val, count(*) AS n, sum(base - units) AS g FROM judged CROSS JOIN m,
          LATERAL (SELECT unnest(['d', 'x']) AS feature, unnest([d, x]) AS val) GROUP BY ALL),
        c AS (SELECT feature, (val + lead(val) OVER w) / 2.0::DOUBLE AS threshold, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(n) OVER (PARTITION BY feature) AS n, sum(g) OVER (PARTITION BY feature) AS g FROM v WINDOW w AS (PARTITION BY feature ORDER BY val)),
        s AS (SELECT *, gl * gl / (nl + 0.1::DOUBLE) + (g - gl) * (g - gl) / (n - nl + 0.1::DOUBLE) AS gain FROM c WHERE threshold IS NOT NULL AND nl >= 20 AND n - nl >= 20)
        SELECT feature, threshold, floor(-0.08::DOUBLE * gl / (nl + 0.1::DOUBLE) * 1e6::DOUBLE + 0.5)::BIGINT AS left_value_e6, floor(-0.08::DOUBLE * (g - gl) / (n - nl + 0.1::DOUBLE) * 1e6::DOUBLE + 0.5)::BIGINT AS right_value_e6,
          floor(base * 1e6::DOUBLE + 0.5)::BIGINT AS base_e6 FROM s CROSS JOIN (SELECT base FROM m) ORDER BY gain DESC, feature, threshold LIMIT 1""",
    "stop_risk_head": f"""WITH RECURSIVE {RECORDS_SQL}, c AS MATERIALIZED (SELECT d, x, (units * 4 > {TOP})::INT AS y, count(*) AS c FROM judged GROUP BY ALL),
        m AS MATERIALIZED (SELECT sum(c)::DOUBLE AS n, sum(c * y) AS p, sum(c * d)::DOUBLE / sum(c) AS md, sum(c * x)::DOUBLE / sum(c) AS mx FROM c),
        s AS MATERIALIZED (SELECT any_value(n) AS n, any_value(p) AS p, any_value(md) AS md, any_value(mx) AS mx, sqrt(sum(c * (d - md) * (d - md)) / any_value(n)) AS sd, sqrt(sum(c * (x - mx) * (x - mx)) / any_value(n)) AS sx FROM c CROSS JOIN m),
        z AS MATERIALIZED (SELECT list({{'u': (d - md) / sd, 'v': (x - mx) / sx, 'y': y, 'c': c}}) AS rows, any_value(n) AS n, any_value(p) AS p FROM c CROSS JOIN s),
        e AS (SELECT 0 AS i, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, ln(((p + 0.5) / (n + 1)) / (1 - (p + 0.5) / (n + 1))) AS b FROM z
          UNION ALL SELECT i + 1, w1 - 0.1::DOUBLE * (list_sum(list_transform(g, lambda r: r.g * r.u)) / n + 1e-4::DOUBLE * w1), w2 - 0.1::DOUBLE * (list_sum(list_transform(g, lambda r: r.g * r.v)) / n + 1e-4::DOUBLE * w2),
            b - 0.1::DOUBLE * list_sum(list_transform(g, lambda r: r.g)) / n
          FROM (SELECT i, w1, w2, b, n, list_transform(rows, lambda r: {{'g': (1 / (1 + exp(-(b + r.u * w1 + r.v * w2))) - r.y) * r.c, 'u': r.u, 'v': r.v}}) AS g FROM e CROSS JOIN z WHERE i < 200)),
        f AS (SELECT unnest(['d', 'x', 'bias']) AS feature, unnest([md, mx, 0.0::DOUBLE]) AS mean, unnest([sd, sx, 1.0::DOUBLE]) AS scale, unnest([w1, w2, b]) AS weight, n, p FROM e CROSS JOIN s WHERE i = 200)
        SELECT feature, floor(mean * 1e6::DOUBLE + 0.5)::BIGINT AS mean_e6, floor(scale * 1e6::DOUBLE + 0.5)::BIGINT AS scale_e6, floor(weight * 1e6::DOUBLE + 0.5)::BIGINT AS weight_e6, n::BIGINT AS rows, p::BIGINT AS positives FROM f""",
}
