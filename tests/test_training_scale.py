"""Training rows that keep the cores busy."""
from pyspark.sql import functions as F

from turnstile.operators import training as G


def test_narrow_rows_are_spread_over_tasks(spark):
    rows = spark.range(1000).coalesce(1).select(F.col("id").alias("a"))
    out = G.spread(rows, rows_per_task=200)
    assert out.rdd.getNumPartitions() == 5 and out.agg(F.sum("a")).first()[0] == 999 * 500
    sizes = out.rdd.glom().map(len).collect()
    assert max(sizes) < 400
    assert G.spread(rows, rows_per_task=1000).rdd.getNumPartitions() == 1


def test_boosted_trees_grow_over_intervals_not_rows(spark, monkeypatch):
    """The same scores as from a pass over all rows for every level of every tree; the trainer sees few rows.
    Split points are drawn from a sample, since there are more than 10,000 rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    ids = spark.range(30_000, numPartitions=3)
    df = ids.select("id", F.abs(F.hash("id") % 7).cast("double").alias("a"), (F.abs(F.xxhash64("id") % 500) / 500.0).alias("b"),
                    F.lit(3.0).alias("same"))
    df = df.withColumn("y", (F.abs(F.xxhash64("id", "a") % 800) / 100.0 < F.col("a") * F.col("b")).cast("double"))
    cols = ["a", "b", "same"]
    want = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="keep"),
                            GBTClassifier(featuresCol="_features", labelCol="y", seed=42)]).fit(df)
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    got = G.fit_boosted_trees(df, cols, "y", seed=42)
    assert 100 < seen[0] <= 7 * 32 * 2 and len(seen) == 1
    new = spark.range(40_000, 41_000).select("id", (F.col("id") % 9 - 1.0).alias("a"), (F.col("id") / 41_000.0).alias("b"),
                                             F.lit(4.0).alias("same"))
    for rows in (df, new):
        one, other = (G.score_batch(rows, m).select("id", F.col("fraud_score").alias(k)) for m, k in ((want, "s"), (got, "t")))
        assert one.columns == ["id", "s"] and G.score_batch(rows, got).columns == [*rows.columns, "fraud_score", "is_fraud"]
        assert one.join(other, "id").where(F.abs(F.col("s") - F.col("t")) < 1e-9).count() == rows.count()


def test_scoring_query_trains_on_intervals(spark, sf_dir, monkeypatch):
    import __spark_entry__ as E
    from pyspark.ml.classification import GBTClassifier
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    scored = E.queries()["p4_batch_fraud_scoring"](spark, sf_dir)
    assert len(seen) == 1 and seen[0] < 1000 < scored.count()
