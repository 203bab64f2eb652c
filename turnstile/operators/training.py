"""G — training data, split, model search, evaluation, scoring, registry.

Model fitting uses ``pyspark.ml`` (distributed GBT); evaluation metrics are
plain aggregates so they scale with the scored table and need no driver
collect.
"""

from __future__ import annotations

import math
import random
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions.ordered import COARSE, FINE, order_statistics, value_bucket
from turnstile.session import path_exists, reuse

# Fixed values from the reference: label threshold, split, search space, gate.
FRAUD_LABEL_THRESHOLD = 0.05
LABEL_COLUMN = "is_fraud_label"
VALID_FRACTION, SPLIT_SEED = 0.2, 42
SEARCH_SPACE = {"max_depth": (2, 4), "learning_rate": (0.05, 0.3), "n_estimators": (20, 60),
                "subsample": (0.6, 1.0), "colsample": (0.6, 1.0)}
N_TRIALS = 5
BASELINE_AUC, BASELINE_ACCURACY = 0.75, 0.80
SCORE_THRESHOLD = 0.5
HASH_SPACE = 16 ** 15  # first 15 hex digits of md5


# ---------------------------------------------------------------- G1
def fraud_training_frame(user_metrics: DataFrame, threshold: float = FRAUD_LABEL_THRESHOLD,
                         cols=None, label: str = LABEL_COLUMN) -> DataFrame:
    """G1: label = fraud_risk_score ≥ threshold (null → 0); keep
    lifetime_purchases, fraud_risk_score (when present) and the label.
    ``cols`` must all exist (else ValueError)."""
    if "fraud_risk_score" not in user_metrics.columns:
        raise ValueError("user_metrics must contain a 'fraud_risk_score' column")
    lab = F.coalesce(F.col("fraud_risk_score") >= F.lit(threshold), F.lit(False)).cast("int").alias(label)
    if cols is not None:
        missing = [c for c in cols if c not in user_metrics.columns]
        if missing:
            raise ValueError(f"Requested feature columns missing from DataFrame: {missing}")
        keep = list(cols)
    else:
        keep = [c for c in ("lifetime_purchases", "fraud_risk_score") if c in user_metrics.columns]
    extra = [c for c in ("user_id",) if c in user_metrics.columns and c not in keep]
    return user_metrics.select(*extra, *keep, lab)


# ---------------------------------------------------------------- G2
def split_hash(id_col: str, seed: int = SPLIT_SEED) -> Column:
    """Stable per-row uniform integer in [0, 16**15) from md5(id ‖ seed)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str, id_col: str, frac: float = VALID_FRACTION,
                     seed: int = SPLIT_SEED, exact: bool = True) -> DataFrame:
    """Add ``split`` ∈ {train, valid}.

    Default: exactly ceil(frac·n_class) rows of every class are ``valid``, those
    of the smallest hashes (a per-class order statistic of the hash, joined
    back as one cut per class).  ``exact=False`` compares the hash with ``frac``
    of its range instead: the same share of every class in expectation, and
    no pass over the data.
    """
    h = split_hash(id_col, seed)
    if not exact:
        cut = int(frac * HASH_SPACE)
        return df.withColumn("split", F.when(h < F.lit(cut), F.lit("valid")).otherwise(F.lit("train")))
    d = df.withColumn("_h", h)
    cuts = order_statistics(d.select(label, "_h"), "_h", {"_cut": lambda n: F.ceil(F.lit(frac) * n) - 1}, [label])
    return (d.join(cuts.select(label, "_cut"), label, "left")
             .withColumn("split", F.when(F.col("_h") <= F.col("_cut"), F.lit("valid")).otherwise(F.lit("train")))
             .drop("_h", "_cut"))


# ---------------------------------------------------------------- G3
def sample_params(trials: int = N_TRIALS, seed: int = SPLIT_SEED) -> list[dict]:
    """Seeded random search points over the reference's space (log-uniform rate)."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        lo, hi = SEARCH_SPACE["learning_rate"]
        out.append({
            "maxDepth": rng.randint(*SEARCH_SPACE["max_depth"]),
            "stepSize": math.exp(rng.uniform(math.log(lo), math.log(hi))),
            "maxIter": rng.randint(*SEARCH_SPACE["n_estimators"]),
            "subsamplingRate": rng.uniform(*SEARCH_SPACE["subsample"]),
            "featureSubsetStrategy": f"{rng.uniform(*SEARCH_SPACE['colsample']):.3f}",
        })
    return out


ROWS_PER_TASK = 50_000  # training rows of a task, while there are cores for more tasks


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` written once, in as many parts as its rows keep busy.  A boosted
    model passes over its rows hundreds of times, and adaptive execution puts a
    narrow table of a million rows into one or two parts, which is as many tasks
    a pass.  Small tables stay as they are."""
    stored = reuse(df)
    parts = min(-(-stored.count() // rows_per_task), 3 * df.sparkSession.sparkContext.defaultParallelism)
    return reuse(stored.repartition(parts)) if parts > stored.rdd.getNumPartitions() else stored


def _split_points(rows: DataFrame, n: int, sample: DataFrame, gbt, features) -> list[list[float]]:
    """The split points that ``gbt`` would draw for every feature from all ``n``
    ``rows``: Spark's own step, so it draws the same rows.  It is told their number,
    which it would count in a pass of its own; what else it asks for follows from
    the columns and settings, taken from ``sample`` (any of the rows)."""
    from pyspark.ml.feature import VectorAssembler
    asm = VectorAssembler(inputCols=list(features), outputCol=gbt.getFeaturesCol(), handleInvalid="keep")
    jvm, ml = rows.sparkSession._jvm, rows.sparkSession._jvm.org.apache.spark.ml
    gbt._transfer_params_to_java()
    trees, util = (getattr(getattr(package, f"{name}$"), "MODULE$") for package, name in (
        (ml.tree.impl, "RandomForest"), (ml.util, "DatasetUtils")))

    def instances(df: DataFrame):
        return util.extractInstances(gbt._java_obj, asm.transform(df)._jdf, jvm.scala.Some(2))
    strategy = jvm.org.apache.spark.mllib.tree.configuration.Strategy.defaultStrategy("Regression")
    strategy.setMaxBins(gbt.getMaxBins())
    m = ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances(sample), strategy, 1, "all")
    bins = rows.sparkSession.sparkContext._gateway.new_array(jvm.int, len(features))
    for i in range(len(features)):
        bins[i] = min(gbt.getMaxBins(), n)
    m = ml.tree.impl.DecisionTreeMetadata(
        m.numFeatures(), n, float(n), m.numClasses(), m.maxBins(), m.featureArity(), m.unorderedFeatures(), bins, m.impurity(),
        m.quantileStrategy(), m.maxDepth(), m.minInstancesPerNode(), m.minWeightFractionPerNode(), m.minInfoGain(), m.numTrees(),
        m.numFeaturesPerNode())
    found = trees.findSplits(instances(rows), m, gbt.getSeed())
    return [[point.threshold() for point in one] for one in found]


def fit_boosted_trees(train: DataFrame, features, label: str, seed: int = SPLIT_SEED):
    """The model of ``Pipeline([VectorAssembler, GBTClassifier])`` fitted on
    ``train`` with Spark's defaults, without its hundred passes over the rows.

    Boosting sees of a row only its label and, for each feature, between which
    split points it lies.  Split points are drawn from the rows as ever
    (``_split_points``); then rows that agree in all this are one row with
    their number as weight, at most 32 for each feature times two labels, and the trees
    grow over these.  The model takes plain features and puts them between the
    split points itself.

    The rows are made once: the second pass, which draws, reads the shuffle files
    of the first, which counts."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Bucketizer, VectorAssembler
    spark, features = train.sparkSession, list(features)
    rows = train.select(*features, label)
    rows = DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.rdd(), rows._jdf.schema()), spark)
    counted = reuse(rows.groupBy(*features, label).agg(F.count(F.lit(1)).cast("double").alias("_rows")))
    n = int(counted.agg(F.coalesce(F.sum("_rows"), F.lit(0.0))).first()[0])
    gbt = GBTClassifier(featuresCol="_features", labelCol=label, seed=seed)
    points = _split_points(rows, n, counted, gbt, features)
    binned = [f"_features_{i}" for i in range(len(features))]

    def place(points: list[list[float]]) -> Bucketizer:
        # A value equal to a split point lies below it, so an interval ends just above; without points all values lie in the first.
        ends = [[math.nextafter(x, math.inf) for x in one] or [sys.float_info.max] for one in points]
        return Bucketizer(splitsArray=[[-math.inf, *one, math.inf] for one in ends], inputCols=features, outputCols=binned,
                          handleInvalid="keep")
    # Points with no row between them are one point, the lowest, which the trainer takes of equal ones.
    there = place(points).transform(counted).agg(*[F.sort_array(F.collect_set(b)).alias(b) for b in binned]).first()
    points = [[one[int(b)] for b in there[name][:-1]] for one, name in zip(points, binned, strict=True)]
    # Places are numbers to the trainer, not names, which the Bucketizer's notes on its columns would make them.
    cells = spread(place(points).transform(counted).groupBy(*binned, label).agg(F.sum("_rows").alias("_rows"))
                   .select(*[F.col(b).alias(b, metadata={}) for b in binned], label, "_rows"))
    asm = VectorAssembler(inputCols=binned, outputCol="_features")
    return PipelineModel([place(points), asm, gbt.setWeightCol("_rows").fit(asm.transform(cells))])


def tune_and_train(train: DataFrame, valid: DataFrame, features, label: str = LABEL_COLUMN,
                   trials: int = N_TRIALS, seed: int = SPLIT_SEED, parallelism: int = 1):
    """Random search maximising validation AUC over GBT settings.  Each
    trial is a distributed fit on the training split; ``parallelism`` trials run concurrently (as
    ``TrainValidationSplit(parallelism=…)`` does); only the small parameter
    list lives on the driver.

    Returns (best_model, trials_df) where trials_df lists params and AUC.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = train.sparkSession
    asm = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    # Written once: every trial and evaluation reads these copies.
    tr = spread(train.select(*features, F.col(label).cast("double").alias("_label")))
    va = spread(valid.select(*features, F.col(label).cast("double").alias("_label")))

    def trial(i_p):
        i, p = i_p
        gbt = GBTClassifier(featuresCol="_features", labelCol="_label", seed=seed, **p)
        model = Pipeline(stages=[asm, gbt]).fit(tr)
        ev = evaluate_scores(score_batch(va, model), label="_label", score="fraud_score").first()
        auc = float(ev["auc"]) if ev["auc"] is not None else 0.0
        return model, (i, p["maxDepth"], p["stepSize"], p["maxIter"], p["subsamplingRate"],
                       p["featureSubsetStrategy"], auc, float(ev["accuracy"]))

    points = list(enumerate(sample_params(trials, seed)))
    if parallelism > 1:
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            fitted = list(pool.map(trial, points))
    else:
        fitted = [trial(x) for x in points]
    final = max(fitted, key=lambda f: (f[1][6], -f[1][0]))[0]  # best AUC, earliest trial on ties
    trials_df = spark.createDataFrame([row for _, row in fitted], "trial int, max_depth int, learning_rate double, n_estimators int, "
                                            "subsample double, colsample string, roc_auc double, accuracy double")
    return final, trials_df


# ---------------------------------------------------------------- G4
def evaluate_scores(df: DataFrame, label: str = "label", score: str = "score",
                    threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Exact ROC-AUC (ties count ½, Mann-Whitney) and accuracy at
    score ≥ threshold over rows with a score and a 0/1 label, as one row
    (auc null with a single class).

    A positive beats all negatives of lower buckets: scores are counted per
    coarse bucket, in those with both classes per fine bucket, and in fine
    buckets with both classes and several scores per score.  Counts are combined
    map-side; totals are taken over bounded tables of buckets, side by side for
    each coarse and each fine bucket (16,384 a factor of two), so neither
    scores of one range nor equal scores meet in one task.  Scores and labels
    are written once, since scoring may cost more than all this.
    """
    base = reuse(df.select(F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y"))
                 .where(F.col("_s").isNotNull() & F.col("_y").isin(0.0, 1.0)))
    base = base.withColumn("_b", value_bucket(F.col("_s"), COARSE))
    hit = (F.col("_s") >= F.lit(threshold)) == (F.col("_y") == 1)
    sums = [F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")]
    span = [F.min("_s").alias("lo"), F.max("_s").alias("hi")]
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    ties = F.when(F.col("lo") == F.col("hi"), 0.5 * F.col("neg")).otherwise(F.lit(0.0))

    def counted(rows: DataFrame, within: list[str], by: str, *more: Column) -> DataFrame:
        lower = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.groupBy(*within, by).agg(*sums, *span, *more) \
                   .withColumn("_below", F.coalesce(F.sum("neg").over(lower), F.lit(0)) + ties)

    def wins(counts: DataFrame, name: str) -> DataFrame:
        return counts.agg(F.coalesce(F.sum(F.col("pos") * F.col("_below")), F.lit(0.0)).alias(name))
    coarse = reuse(counted(base, [], "_b", F.count_if(hit).alias("_hit")))
    inside = base.join(coarse.where(both & (F.col("lo") < F.col("hi"))).select("_b"), "_b", "left_semi") \
                 .withColumn("_f", value_bucket(F.col("_s"), FINE))
    fine = reuse(counted(inside, ["_b"], "_f"))
    inside = inside.join(fine.where(both & (F.col("lo") < F.col("hi"))).select("_b", "_f"), ["_b", "_f"], "left_semi")
    between = coarse.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
                         F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"), F.sum("_hit").alias("_hit"))
    parts = [wins(coarse, "_u1"), wins(fine, "_u2"), wins(counted(inside, ["_b", "_f"], "_s"), "_u3")]
    n = F.col("positives") + F.col("negatives")
    auc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                 (F.col("_u1") + F.col("_u2") + F.col("_u3")) / (F.col("positives") * F.col("negatives")))
    return reduce(DataFrame.crossJoin, parts, between).select(
        auc.alias("auc"), F.coalesce(F.try_divide(F.col("_hit"), n), F.lit(0.0)).alias("accuracy"),
        n.alias("n"), "positives", "negatives")


# ---------------------------------------------------------------- G5
def baseline_gate(metrics: DataFrame, min_auc: float = BASELINE_AUC, min_acc: float = BASELINE_ACCURACY) -> DataFrame:
    """Accepted ⇔ auc ≥ 0.75 and accuracy ≥ 0.80."""
    ok = F.coalesce((F.col("auc") >= F.lit(min_auc)) & (F.col("accuracy") >= F.lit(min_acc)), F.lit(False))
    return metrics.withColumn("accepted", ok)


# ---------------------------------------------------------------- G7
def score_batch(df: DataFrame, model, threshold: float = SCORE_THRESHOLD, score_col: str = "fraud_score") -> DataFrame:
    """Probability of the positive class (``predict_proba[:,1]`` analogue)
    and ``is_fraud`` = score ≥ threshold.

    ``model`` is a fitted ``pyspark.ml`` model/pipeline, or any object with
    ``predict_proba``/``predict`` plus a ``feature_columns`` list — the
    latter runs through ``mapInPandas`` (Arrow batches, one model copy per
    task), the only Python-scored path.
    """
    if hasattr(model, "transform"):
        from pyspark.ml.functions import vector_to_array
        out = model.transform(df)
        prob = vector_to_array(F.col("probability"))[1] if "probability" in out.columns else F.col("prediction")
        drop = [c for c in out.columns if c in ("rawPrediction", "probability", "prediction") or c.startswith("_features")]
        out = out.withColumn(score_col, prob.cast("double")).drop(*drop)
    else:
        cols = list(model.feature_columns)
        schema = T.StructType(df.schema.fields + [T.StructField(score_col, T.DoubleType())])

        def run(batches):
            for pdf in batches:
                x = pdf[cols].to_numpy(dtype="float64")
                if hasattr(model, "predict_proba"):
                    s = model.predict_proba(x)[:, 1]
                else:
                    s = model.predict(x)
                yield pdf.assign(**{score_col: s.astype("float64")})
        out = df.mapInPandas(run, schema)
    return out.withColumn("is_fraud", F.col(score_col) >= F.lit(threshold))


# ---------------------------------------------------------------- G6
PERMUTE_ROWS = 100_000  # rows among which one task shuffles a value, about


def _permute_column(df: DataFrame, col: str, seed: int) -> DataFrame:
    """Shuffle one column's values across rows: rows are dealt to groups by a
    hash, each group is put in two orders by two other hashes, and the k-th row of
    one takes the value of the k-th row of the other.  Everything follows from
    the rows and the seed, so a retried task gives the same values."""
    own = F.xxhash64(*df.columns, F.lit(seed))
    groups = max(1, -(-df.count() // PERMUTE_ROWS))
    dealt = df.withColumn("_group", F.pmod(own, F.lit(groups)))

    def ordered(salt: int) -> Column:
        keys = [F.xxhash64(*df.columns, F.lit(seed), F.lit(salt)), F.xxhash64(*df.columns, F.lit(salt))]
        return F.row_number().over(Window.partitionBy("_group").orderBy(*keys))
    rows = dealt.withColumn("_place", ordered(1)).drop(col)
    values = dealt.select("_group", ordered(2).alias("_place"), col)
    return rows.join(values, ["_group", "_place"]).select(*df.columns)


def feature_attribution(model, df: DataFrame, features, label: str = LABEL_COLUMN,
                        seed: int = SPLIT_SEED) -> DataFrame:
    """Permutation importance — drop in AUC when one feature's values
    are shuffled — next to the GBT's own ``featureImportances``."""
    spark = df.sparkSession
    df = reuse(df)  # read by every shuffle and evaluation
    base = evaluate_scores(score_batch(df, model), label=label, score="fraud_score").first()["auc"] or 0.0
    gbt = model.stages[-1] if hasattr(model, "stages") else model
    imp = list(gbt.featureImportances.toArray()) if hasattr(gbt, "featureImportances") else [None] * len(features)
    rows = []
    for i, c in enumerate(features):
        shuffled = _permute_column(df, c, seed + i)
        auc = evaluate_scores(score_batch(shuffled, model), label=label, score="fraud_score").first()["auc"] or 0.0
        rows.append((c, float(base) - float(auc), float(imp[i]) if imp[i] is not None else None))
    return spark.createDataFrame(rows, "feature string, auc_drop double, model_importance double")


# ---------------------------------------------------------------- G8
def select_model_version(registry: DataFrame, stage: str = "Production") -> DataFrame:
    """Per model name the highest numeric version in ``stage``
    (case-insensitive), else the highest version overall; ``model_uri``."""
    v = F.col("version").cast("long")
    match = (F.lower(F.coalesce(F.col("stage"), F.lit(""))) == F.lit(stage.strip().lower())).cast("int")
    best = registry.groupBy("name").agg(F.max_by(F.struct("version", "stage", "run_id", "source"),
                                                 F.struct(match, v)).alias("b"))
    return best.select("name", F.col("b.version").cast("string").alias("version"),
                       F.coalesce(F.col("b.stage"), F.lit("")).alias("stage"), F.col("b.run_id").alias("run_id"),
                       F.col("b.source").alias("source"),
                       F.concat(F.lit("models:/"), F.col("name"), F.lit("/"), F.col("b.version").cast("string"))
                       .alias("model_uri"))


def register_if_accepted(gate: DataFrame, registry_path: str, name: str, source: str = "pyspark.ml",
                         model=None, models_root: str | None = None) -> bool:
    """Append the next version of ``name`` to the registry table, in stage
    Staging, when the gate row says accepted.  Returns accepted.  Only a
    registry that was never written starts at version 1; one that cannot be
    read is an error.

    A ``model`` (``pyspark.ml``, fitted) is saved first, under ``models_root``
    (the shared folder of all artifacts) by name and version, and the row's
    ``source`` is that folder.  So a row never names an artifact that is not
    whole; what an interrupted registration left is overwritten by the next."""
    spark = gate.sparkSession
    row = gate.select("accepted", "auc", "accuracy").first()
    if not row or not row["accepted"]:
        return False
    nxt = None
    if path_exists(spark, registry_path):
        reg = spark.read.parquet(registry_path)
        nxt = reg.where(F.col("name") == name).agg(F.max(F.col("version").cast("long")).alias("v")).first()["v"]
    version = str((nxt or 0) + 1)
    if model is not None:
        source = f"{(models_root or registry_path + '_artifacts').rstrip('/')}/{name}/version={version}"
        model.write().overwrite().save(source)
    spark.createDataFrame([(name, version, "Staging", f"auc={row['auc']:.4f};accuracy={row['accuracy']:.4f}", source)],
                          "name string, version string, stage string, run_id string, source string") \
         .write.mode("append").parquet(registry_path)
    return True


def resolve_model(registry: DataFrame, uri: str) -> dict:
    """The registry row that ``models:/name/version`` or ``models:/name/stage``
    means: that version, or what ``select_model_version`` gives for the stage."""
    scheme, _, rest = uri.partition(":/")
    name, _, which = rest.strip("/").rpartition("/")
    if scheme != "models" or not name or not which:
        raise ValueError(f"not a model URI (models:/name/version or models:/name/stage): {uri}")
    own = registry.where(F.col("name") == name)
    if which.isdigit():
        own = own.where(F.col("version").cast("long") == int(which))
        found = own.select("name", "version", "stage", "run_id", "source").first()
    else:
        found = select_model_version(own, which).first()
    if found is None:
        raise LookupError(f"{uri} is not in the registry")
    return found.asDict()


def load_model(registry: DataFrame, uri: str):
    """The saved model behind a URI, in whatever session asks."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(resolve_model(registry, uri)["source"])


def model_inputs(model) -> list[str] | None:
    """Columns that a fitted pipeline assembles, none where it has no assembler."""
    return next((list(s.getInputCols()) for s in getattr(model, "stages", []) if hasattr(s, "getInputCols")), None)


def list_model_versions(registry: DataFrame) -> DataFrame:
    """Listing: versions sorted numerically descending; a null stage shows as "None"."""
    return registry.select("name", F.col("version").cast("string").alias("version"),
                           F.coalesce(F.col("stage"), F.lit("None")).alias("stage"), "run_id") \
        .orderBy("name", F.col("version").cast("long").desc())
