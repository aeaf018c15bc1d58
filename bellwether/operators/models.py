"""Models on Spark ML: splits, learners, walk-forward refits, ensembles and their checks.

Fitting is Spark's own distributed training. What reaches the driver is a list of fold
dates (bounded by the calendar), fitted models and single metric values.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions.scalar import class_weight, mix
from bellwether.functions.vectors import as_dense
from bellwether.operators import ranks as R
from bellwether.operators import skipgram as S
from bellwether.operators import windows as W
from bellwether.operators.aggregates import confusion, corr
from bellwether.operators.text import vocabulary
from bellwether.session import frozen

SEED = 13


# ------------------------------------------------------------------ features and splits


def feature_table(panel: DataFrame) -> DataFrame:
    """Price features and next-session labels in one exchange on ticker; rows without a full
    history are dropped. ``y`` is an up day, ``up5`` a +5 % touch."""
    p = W.lagged_returns(panel, (1, 2, 3))
    p = W.momentum(p, (5, 20))
    p = W.volatility(p, (5, 20))
    p = W.range_distance(p)
    p = W.range_features(p)
    p = W.hit_priors(p)
    p = p.filter("vol_20 is not null and ret is not null")
    return p.withColumns({"y": (F.col("ret") > 0).cast("double"), "label": F.col("up5").cast("double"), "weight": F.lit(1.0)})


# The feature sets that are compared.
FEATURES = {
    "returns": ["gap", "lagret_1", "lagret_2", "lagret_3"],
    "trend": ["gap", "lagret_1", "lagret_2", "lagret_3", "mom_5", "mom_20", "dist_hi", "dist_lo"],
    "all": ["gap", "lagret_1", "lagret_2", "lagret_3", "mom_5", "mom_20", "dist_hi", "dist_lo",
            "vol_5", "vol_20", "hl20", "std20", "hl_prev", "absr1_prev", "u20", "d20"],
}


def time_split(rows: DataFrame, train: float = 0.6, dev: float = 0.15) -> DataFrame:
    """train / dev / test by date: the first 60 % of dates train, of which the last 15 % are dev."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    days = rows.select("date").distinct()  # one row per date
    n = days.agg(F.count(F.lit(1)).alias("_n"))
    d = R.with_scalars(days.withColumn("_i", F.row_number().over(w) - 1), n)
    cut = F.floor(F.col("_n") * train)
    part = F.when(F.col("_i") >= cut, "test").when(F.col("_i") >= F.floor(cut * (1 - dev)), "dev").otherwise("train")
    return rows.join(F.broadcast(d.select("date", part.alias("split"))), "date")


def assemble(columns: list[str]) -> list:
    """Median imputation and assembly, fitted with the model so that nothing leaks."""
    filled = [f"{c}_f" for c in columns]
    return [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw")]


def boosted(columns: list[str], label: str = "label", iters: int = 20, depth: int = 3) -> Pipeline:
    gbt = GBTClassifier(labelCol=label, featuresCol="raw", weightCol="weight", maxIter=iters, maxDepth=depth, stepSize=0.1, seed=SEED)
    return Pipeline(stages=[*assemble(columns), gbt])


def logistic(columns: list[str], label: str = "label", elastic: float = 0.5, reg: float = 0.01) -> Pipeline:
    lr = LogisticRegression(labelCol=label, featuresCol="x", weightCol="weight", elasticNetParam=elastic, regParam=reg, maxIter=50)
    return Pipeline(stages=[*assemble(columns), StandardScaler(inputCol="raw", outputCol="x", withMean=True), lr])


def linear(columns: list[str], label: str, reg: float = 0.01) -> Pipeline:
    lr = LinearRegression(labelCol=label, featuresCol="x", weightCol="weight", regParam=reg, predictionCol="size")
    return Pipeline(stages=[*assemble(columns), StandardScaler(inputCol="raw", outputCol="x", withMean=True), lr])


def forest(columns: list[str], label: str = "label", trees: int = 20, depth: int = 5) -> Pipeline:
    rf = RandomForestClassifier(labelCol=label, featuresCol="raw", weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[*assemble(columns), rf])


def dense_net(columns: list[str], hidden: list[int], label: str = "label") -> Pipeline:
    net = MultilayerPerceptronClassifier(labelCol=label, featuresCol="x", layers=[len(columns), *hidden, 2], maxIter=40, seed=SEED)
    return Pipeline(stages=[*assemble(columns), StandardScaler(inputCol="raw", outputCol="x", withMean=True), net])


def score(model: Model, rows: DataFrame, out: str = "p") -> DataFrame:
    """Rows with the positive-class probability; the model's working columns are dropped."""
    s = model.transform(rows).withColumn("_p", F.get(vector_to_array("probability"), F.lit(1)))
    return s.select(*rows.columns, F.col("_p").alias(out))


def weighted(rows: DataFrame, label: str = "label", top: float = 25.0) -> DataFrame:
    """Positive rows weigh as many as there are negatives per positive, within [1, top]."""
    rate = rows.agg(F.avg(label).alias("_rate"))
    return R.with_scalars(rows, rate).withColumn(
        "weight", F.when(F.col(label) == 1, class_weight("_rate", top)).otherwise(1.0)).drop("_rate")


def metrics(pred: DataFrame, label: str = "label", p: str = "p", by: list[str] | None = None) -> DataFrame:
    return confusion(pred, F.col(label) == 1, F.col(p) > 0.5, by)


# ------------------------------------------------------------------ walk-forward


def fold_starts(rows: DataFrame, first: float, step: int) -> list[tuple[dt.date, dt.date | None, int, list[dt.date]]]:
    """(block start, next block start, its number among the dates, all dates) from the distinct dates."""
    days = [r[0] for r in rows.select("date").distinct().orderBy("date").collect()]  # bounded by the calendar
    at = list(range(int(len(days) * first), len(days), step))
    return [(days[i], days[i + step] if i + step < len(days) else None, i, days) for i in at]


def fold_table(rows: DataFrame, step: int = 63, embargo: int = 1, min_rows: int = 200, first: float = 0.4) -> DataFrame:
    """One row per block of ``walk_forward``: its rows, its training rows, and whether it is ``used``.

    Blocks with too little history are skipped there; here they are seen."""
    per_day = rows.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    days = per_day.withColumns({"_i": F.row_number().over(w) - 1, "_upto": F.sum("_n").over(w)})
    days = R.with_scalars(days, days.agg(F.floor(F.count(F.lit(1)) * first).alias("_first")))
    # rows before the last ``embargo`` dates before the block's start
    days = days.withColumn("_train", F.coalesce(F.lag("_upto", embargo + 1).over(w), F.lit(0)))
    days = days.filter("_i >= _first").withColumn("_b", F.floor((F.col("_i") - F.col("_first")) / step))
    blocks = days.groupBy("_b").agg(F.min("date").alias("block"), F.sum("_n").alias("rows"),
                                    F.min_by("_train", "date").alias("train_rows"), F.min("_i").alias("_i"))
    return blocks.withColumn("used", (F.col("train_rows") >= min_rows) & (F.col("_i") - embargo >= 1)).drop("_b", "_i")


def walk_forward(rows: DataFrame, make: Callable[[], Estimator], step: int = 63, embargo: int = 1,
                 min_rows: int = 200, first: float = 0.4, out: str = "p",
                 weights: Callable[[DataFrame, dt.date], DataFrame] | None = None) -> DataFrame:
    """Expanding refits: each block of ``step`` dates is predicted by a model fitted on all
    earlier dates but the last ``embargo``. One distributed fit per block. Blocks with fewer
    than ``min_rows`` training rows are skipped; ``fold_table`` lists them."""
    parts = None
    for start, nxt, i, days in fold_starts(rows, first, step):
        if i - embargo < 1:
            continue
        train = rows.filter(F.col("date") < F.lit(days[i - embargo]))
        if train.limit(min_rows).count() < min_rows:
            continue
        if weights is not None:
            train = weights(train, start)
        block = rows.filter(F.col("date") >= F.lit(start))
        if nxt is not None:
            block = block.filter(F.col("date") < F.lit(nxt))
        scored = score(make().fit(train), block, out).withColumn("block", F.lit(start))
        parts = scored if parts is None else parts.unionByName(scored)
    if parts is None:
        raise ValueError("no block has enough training rows")
    return parts


def poisson_weight(key: list[str], bag: int, seed: int = SEED, rate: float = 1.0) -> Column:
    """How often a row is in a bag: Poisson by inverse distribution function of a hash of key, bag and seed.

    The draw depends on nothing but these, so it is the same under every partitioning, on a retry and in another engine. Rows with
    equal keys get equal draws, so the key should be unique; a null counts as an empty text. Steps go on until what is
    left is below the hash's own step of 2 to the power of -52."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(bag)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / float(1 << 52)
    steps, term, upto, k = [], math.exp(-rate), 0.0, 0
    while k <= rate or term > 2.0**-52:
        upto += term
        steps.append(upto)
        k += 1
        term *= rate / k
    # the array binds the draw, so that its hash is taken once and not once per step
    return F.get(F.transform(F.array(u), lambda x: sum(((x >= s).cast("int") for s in steps), F.lit(0))), F.lit(0))


def bagging(train: DataFrame, test: DataFrame, make: Callable[[], Estimator], bags: int = 3, seed: int = SEED,
            key: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """Mean probability of models fitted on bags: Poisson draws by hash of ``key``, as row weights (``make`` has to use ``weight``),
    instead of copies of rows."""
    out = test
    for b in range(bags):
        bag = train.withColumn("weight", F.col("weight") * poisson_weight(list(key), b, seed)).filter("weight > 0")
        out = score(make().fit(bag), out, f"_p{b}")
    return out.withColumn("p", sum(F.col(f"_p{b}") for b in range(bags)) / bags).drop(*[f"_p{b}" for b in range(bags)])


def ensemble(test: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Mean probability of several models; each scores the same rows, so no join is needed."""
    out = test
    for name, m in models.items():
        out = score(m, out, f"p_{name}")
    return out.withColumn("p", sum(F.col(f"p_{n}") for n in models) / len(models))


def meta_label(rows: DataFrame, test: DataFrame, make: Callable[[], Estimator], make_meta: Callable[[], Estimator],
               chunks: int = 4, keep: float = 0.2, frozen_cut: bool = False) -> DataFrame:
    """A second model for the candidates of a first one.

    Training dates are cut into chunks; each chunk but the first is predicted by a model of
    the chunks before it. The top ``keep`` of those predictions trains the second model,
    with the first probability as an extra feature. Test candidates get its probability,
    all others 0. The candidates are the top ``keep`` of all test scores, which looks at the whole test part; with
    ``frozen_cut`` they are the test scores at or above the cut of the out-of-fold scores. Rows and scores
    are written once: a fit and a quantile read them several times.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    parts = rows.select("date").distinct().withColumn("chunk", F.ntile(chunks).over(w))
    d = frozen(rows.join(F.broadcast(parts), "date"))
    oof = None
    for k in range(2, chunks + 1):
        s = score(make().fit(weighted(d.filter(F.col("chunk") < k))), d.filter(F.col("chunk") == k))
        oof = s if oof is None else oof.unionByName(s)
    oof = frozen(oof)
    cut = R.exact_quantiles(oof, "p", [1 - keep]).select(F.col("q").alias("_q"))
    second = make_meta().fit(weighted(R.with_scalars(oof, cut).filter(F.col("p") >= F.col("_q")).drop("_q"), top=15.0))
    first = frozen(score(make().fit(weighted(d.drop("chunk"))), test))
    if not frozen_cut:
        cut = R.exact_quantiles(first, "p", [1 - keep]).select(F.col("q").alias("_q"))
    s = score(second, R.with_scalars(first, cut), "_m")
    return s.withColumn("p_meta", F.when(F.col("p") >= F.col("_q"), F.col("_m")).otherwise(0.0)).drop("_m", "_q")


def meta_correct(oos: DataFrame, make: Callable[[], Estimator], step: int, min_rows: int) -> DataFrame:
    """Walk-forward second model for P(the first model is right), on its own past predictions."""
    d = oos.withColumns({"conf": F.abs(F.col("p") - 0.5), "right": ((F.col("p") > 0.5) == (F.col("label") == 1)).cast("double")})
    return walk_forward(d.drop("block"), make, step=step, min_rows=min_rows, first=0.3, out="p_right")


def calibrate(oos: DataFrame, min_rows: int = 200) -> DataFrame:
    """Isotonic calibration of each block on the predictions of earlier blocks.

    A block with fewer than ``min_rows`` of them keeps its raw probabilities and has ``calibrated`` false."""
    blocks = [r[0] for r in oos.select("block").distinct().orderBy("block").collect()]  # one per fold
    out = None
    for b in blocks:
        here, past = oos.filter(F.col("block") == F.lit(b)), oos.filter(F.col("block") < F.lit(b))
        if past.limit(min_rows).count() < min_rows:
            c = here.withColumns({"p_cal": F.col("p"), "calibrated": F.lit(False)})
        else:
            iso = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="p_cal").fit(past)
            c = iso.transform(here).select(*here.columns, "p_cal").withColumn("calibrated", F.lit(True))
        out = c if out is None else out.unionByName(c)
    return out


def recency(half_life: float = 252.0) -> Callable[[DataFrame, dt.date], DataFrame]:
    """Training weights that halve every ``half_life`` days before the block."""
    def add(train: DataFrame, start: dt.date) -> DataFrame:
        age = F.datediff(F.lit(start), F.col("date"))
        return train.withColumn("weight", F.pow(F.lit(0.5), age / half_life))
    return add


def by_return(train: DataFrame, start: dt.date) -> DataFrame:
    return train.withColumn("weight", 1.0 + 5.0 * F.abs("ret"))


# ------------------------------------------------------------------ comparison and inspection


def compare(split: DataFrame, candidates: dict[str, Pipeline]) -> DataFrame:
    """Accuracy and MCC per model and split."""
    train = split.filter("split = 'train'")
    out = None
    for name, pipe in candidates.items():
        m = metrics(score(pipe.fit(train), split), by=["split"]).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def rank_auc(pred: DataFrame, label: str = "label") -> float:
    """Exact: one threshold per different score."""
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol=label, numBins=0).evaluate(pred)


def permutation_importance(model: Model, rows: DataFrame, columns: list[str], key: list[str], repeats: int = 3) -> DataFrame:
    """Mean drop in AUC when one feature is shuffled.

    Rows are ranked once by key and, per repeat, once by a hash of the key; the row of rank i takes the
    values of the row of hashed rank i, so each repeat is one permutation of the rows for all features.
    """
    base = rank_auc(score(model, rows))
    numbered = frozen(R.global_rank(rows, [F.asc(k) for k in key], "_i"))
    drops = dict.fromkeys(columns, 0.0)
    for r in range(repeats):
        hashed = numbered.withColumn("_h", mix(F.lit(r + 1), F.col("_i"), SEED))
        other = R.global_rank(hashed, [F.asc("_h"), F.asc("_i")], "_j").select(F.col("_j").alias("_i"), *[F.col(c).alias(f"_{c}") for c in columns])
        moved = frozen(numbered.join(other, "_i"))
        for c in columns:
            drops[c] += base - rank_auc(score(model, moved.withColumn(c, F.col(f"_{c}")).select(*rows.columns)))
    found = [(c, float(base), drops[c] / repeats) for c in columns]
    return rows.sparkSession.createDataFrame(found, "feature string, auc double, drop double")


def stack(dev: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Logistic regression on features and the first model's probability, fitted on dev."""
    return score(logistic([*columns, "p"]).fit(dev), test, "p_stack")


def rule_baselines(panel: DataFrame) -> DataFrame:
    """Momentum (yesterday's sign) and the majority class."""
    w = W.by_ticker()
    d = panel.withColumn("prev", F.lag("ret").over(w)).filter("ret is not null and prev is not null")
    major = d.agg((F.avg((F.col("ret") > 0).cast("int")) > 0.5).alias("_up"))
    d = R.with_scalars(d, major)
    y = F.col("ret") > 0
    a = confusion(d, y, F.col("prev") > 0).withColumn("model", F.lit("momentum"))
    return a.unionByName(confusion(d, y, F.col("_up")).withColumn("model", F.lit("majority")))


def claim_checks(table: DataFrame, claims: list[tuple[str, str]], value: str = "mcc") -> DataFrame:
    """Does the first model of each claim beat the second? One row per claim, plus the best model."""
    rows = table.sparkSession.createDataFrame(claims, "better string, worse string")
    a = table.select(F.col("model").alias("better"), F.col(value).alias("a"))
    b = table.select(F.col("model").alias("worse"), F.col(value).alias("b"))
    best = table.agg(F.max_by("model", F.struct(value, "model")).alias("best"))
    return R.with_scalars(rows.join(a, "better").join(b, "worse"), best).withColumn("holds", F.col("a") > F.col("b"))


# ------------------------------------------------------------------ text and vector models


def word_vectors(tokens: DataFrame, dim: int = 100, min_count: int = 5, window: int = 5) -> DataFrame:
    """Skip-gram word vectors of eligible texts; one row per word, by hierarchical softmax over all pairs, once.

    As many tasks as the session's parallelism train, each on its own texts with vectors of the words it meets; a word's vector is the
    mean over tasks, weighted by its uses. The driver sees the words and their counts, which go to all tasks; vectors stay in tasks."""
    spark = tokens.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    vocab = vocabulary(tokens.select(F.explode("toks").alias("form")), min_count)
    listed = vocab.select("form", "n", "word_id").toArrow().sort_by("word_id").combine_chunks()
    counts = listed["n"].to_numpy()
    texts = tokens.select("toks").coalesce(tasks)
    held = {r.task: r.n for r in texts.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    words = pa.concat_arrays(listed["form"].chunks) if len(counts) else pa.array([], pa.string())
    shared = spark.sparkContext.broadcast((words, counts, S.huffman(counts)))
    share, rows = {k: n / sum(held.values()) for k, n in held.items()}, max(64, 49_152 // tasks)

    def fit(batches):
        words, counts, tree = shared.value
        task = TaskContext.get().partitionId()
        t = S.Trainer(counts, tree, dim, window, SEED, task, share.get(task, 1 / tasks))
        for _, ids, text, *_ in S.numbered(batches, words):
            t.train(ids, text)
        for blob in t.blobs(rows):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(blob, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                                             ["bucket", "ids", "uses", "vecs"])

    def join(blobs: pa.Table) -> pa.Table:
        ids, x = S.merged(*(blobs[c].to_pylist() for c in ("ids", "uses", "vecs")))
        vecs = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.astype(np.float32).ravel()))
        return pa.table({"word_id": pa.array(ids.astype(np.int64) + 1), "vec": vecs})

    blobs = texts.mapInArrow(fit, "bucket int, ids binary, uses binary, vecs binary")
    vectors = frozen(blobs.groupBy("bucket").applyInArrow(join, "word_id bigint, vec array<float>"))
    return vectors.join(vocab.select("word_id", "form"), "word_id").select("form", F.col("vec").cast("array<double>").alias("vec"))


def principal_components(vectors: DataFrame, vec: str, k: int, fit: Column) -> DataFrame:
    """The first k components, fitted on ``fit`` rows; the sign of a component is arbitrary."""
    d = vectors.withColumn("_x", as_dense(vec))
    m = PCA(k=k, inputCol="_x", outputCol="_pc").fit(d.filter(fit))
    return m.transform(d).withColumn("pc", vector_to_array("_pc")).drop("_x", "_pc")


def _grams(texts: DataFrame) -> DataFrame:
    """(ticker, date, gram) for every token and every pair of adjacent tokens; the texts of a day follow one another by
    published_at and news_id, so the last token of one and the first of the next are a pair."""
    keys = ["ticker", "date"]
    pairs = F.transform(F.slice("toks", F.lit(1), F.greatest(F.size("toks") - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", t, F.get("toks", i + 1)))
    within = texts.select(*keys, F.explode(F.concat("toks", pairs)).alias("gram"))
    ends = texts.filter(F.size("toks") > 0).select(*keys, "published_at", "news_id", F.get("toks", F.lit(0)).alias("head"), F.element_at("toks", -1).alias("tail"))
    follow = F.lead("head").over(Window.partitionBy(*keys).orderBy("published_at", "news_id"))
    across = ends.withColumn("follow", follow).filter("follow is not null").select(*keys, F.concat_ws(" ", "tail", "follow").alias("gram"))
    return within.unionByName(across)


def tfidf_features(texts: DataFrame, days: DataFrame, vocab: int = 20_000) -> DataFrame:
    """``days`` (ticker, date, split, ...) with ``x``, the sparse 1- and 2-gram TF-IDF of all their ``texts``
    (ticker, date, published_at, news_id, toks).

    Terms occur in at least two training days; the ``vocab`` most frequent are kept, ties by term. A day's tokens never meet in
    one row: what is collected per day is its counts of vocabulary terms."""
    keys = ["ticker", "date"]
    train = days.filter("split = 'train'").select(*keys)
    grams = _grams(texts.filter("toks is not null"))
    uses = grams.join(train, keys, "left_semi").groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    terms = uses.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf")).filter("df >= 2")
    terms = frozen(terms.orderBy(F.desc("tf"), "gram").limit(vocab))
    size, m = max(terms.count(), 1), train.count()
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("tf"), "gram")
    terms = frozen(terms.select("gram", (F.row_number().over(order) - 1).alias("i"), F.log((F.lit(m) + 1) / (F.col("df") + 1)).alias("idf")))
    counts = grams.join(terms, "gram").groupBy(*keys, "i", "idf").agg(F.count(F.lit(1)).alias("n"))
    vectors = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", (F.col("n") * F.col("idf")).alias("v")))).alias("_c"))
    sparse = F.udf(lambda c: Vectors.sparse(size, [r["i"] for r in c or []], [r["v"] for r in c or []]), VectorUDT())
    return frozen(days.join(vectors, keys, "left").withColumn("x", sparse("_c")).drop("_c"))


def tfidf_svm(texts: DataFrame, days: DataFrame, costs=(0.1, 0.5, 1.0, 2.0), vocab: int = 20_000) -> DataFrame:
    """1- and 2-gram TF-IDF (at least two documents) with a linear SVM; the cost with the best
    dev MCC is kept and returned as ``cost``. ``days`` has ticker, date, label and split; see ``tfidf_features``."""
    d = tfidf_features(texts, days, vocab).persist()
    train = d.filter("split = 'train'")
    n, best = train.count(), None
    for c in costs:
        m = LinearSVC(featuresCol="x", labelCol="label", regParam=1.0 / (c * max(n, 1)), maxIter=20).fit(train)
        s = m.transform(d).withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1)))
        mcc = confusion(s.filter("split = 'dev'"), F.col("label") == 1, F.col("prediction") == 1).first()
        mcc = (mcc.mcc if mcc is not None else None) or 0.0
        if best is None or mcc > best[0]:
            best = (mcc, c, s)
    out = best[2].withColumns({"p": 1.0 / (1.0 + F.exp(-F.col("margin"))), "cost": F.lit(float(best[1]))})
    out = frozen(out.select(*days.columns, "p", "cost"))
    d.unpersist()
    return out


def news_gap_variants(samples: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Direction and size of the gap from different groups of news vectors.

    ``samples`` holds one array column per group, gap, has_over, split. Reported on the
    test part, for all rows and for rows with overnight news.
    """
    out = None
    d = samples.withColumns({"label": (F.col("gap") > 0).cast("double"), "weight": F.lit(1.0)})
    for name, groups in variants.items():
        x = d.withColumn("raw", as_dense(F.concat(*groups)))
        scale = StandardScaler(inputCol="raw", outputCol="x", withMean=True)
        direction = Pipeline(stages=[scale, LogisticRegression(labelCol="label", featuresCol="x", regParam=0.1, maxIter=30)])
        size = Pipeline(stages=[scale, LinearRegression(labelCol="gap", featuresCol="x", regParam=0.1, predictionCol="size")])
        train, test = x.filter("split <> 'test'"), x.filter("split = 'test'")
        s = score(direction.fit(train), test)
        s = size.fit(train).transform(s.drop("x")).select(*s.columns, "size")
        scope = F.explode(F.when(F.col("has_over"), F.array(F.lit("all"), F.lit("overnight"))).otherwise(F.array(F.lit("all"))))
        s = s.withColumn("scope", scope)
        m = metrics(s, by=["scope"]).join(s.groupBy("scope").agg(
            corr("size", "gap").alias("size_corr"), F.avg(((F.col("size") > 0) == (F.col("gap") > 0)).cast("int")).alias("size_dir_acc")), "scope")
        m = m.withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out
