"""Learned parts: regimes, fold-wise label models, calibration, a second model on the first's picks, projections, templates.

Training runs on Spark ML over the feature table; what comes to the driver are coefficients and label centroids, whose
number is that of features or labels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.tables import written

COLUMNS = ["spread", "imbalance", "depth", "move"]


def features(quotes: DataFrame, ahead: int = 5) -> DataFrame:
    """symbol, seq, ts_us, a feature vector and y: 1 where the mid is higher `ahead` rows on; rows without one are left out."""
    w = Window.partitionBy("symbol").orderBy("ts_us", "seq")
    f = quotes.select(
        "symbol", "seq", "ts_us", (F.col("ask") - F.col("bid")).alias("spread"), ((F.col("bid_size") - F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size"))).alias("imbalance"),
        (F.col("bid_size") + F.col("ask_size")).cast("double").alias("depth"), F.coalesce(F.col("mid") - F.lag("mid").over(w), F.lit(0.0)).alias("move"), (F.lead("mid", ahead).over(w) > F.col("mid")).cast("double").alias("y"), F.ntile(5).over(w).alias("fold"),
    )
    return VectorAssembler(inputCols=COLUMNS, outputCol="x").transform(f.where("y is not null"))


def _auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the curve from average ranks of p; rows of one p are counted before they are ranked."""
    counts = scored.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("c1"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = counts.withColumn("place", before + (F.col("c") + 1) / 2)
    g = r.groupBy(*keys).agg(F.sum(F.col("place") * F.col("c1")).alias("s"), F.sum("c1").alias("n1"), F.sum("c").alias("n"))
    n0 = F.col("n") - F.col("n1")
    return g.select(*keys, "n", F.when((F.col("n1") > 0) & (n0 > 0), (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * n0)).alias("auc"))


def learned_regime(quotes: DataFrame, window: int = 30) -> DataFrame:
    """Quartile of the recent variance of moves, learned by multinomial logistic regression on the features; p of each class."""
    w = Window.partitionBy("symbol").orderBy("ts_us", "seq")
    f = features(quotes).withColumn("rv", F.avg(F.col("move") * F.col("move")).over(w.rowsBetween(-window, 0)))
    cuts = f.agg(F.percentile("rv", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] or [0.0] * 3
    f = f.withColumn("label", sum(((F.col("rv") > c).cast("double") for c in cuts), F.lit(0.0)))
    model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", maxIter=20).fit(f)
    return model.transform(f).select("symbol", "seq", F.col("label").cast("int").alias("regime"), F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("p"))


def fold_scores(quotes: DataFrame, embargo_us: int = 0, depth: int = 3, trees: int = 10) -> DataFrame:
    """Out-of-fold p of a boosted model for each of five folds in time, trained on rows further than the embargo from its span."""
    f = written(features(quotes), "features")  # every pass of every fold reads it
    spans = f.groupBy("fold").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).orderBy("fold").collect()
    out = []
    for fold, lo, hi in spans:
        train = f.where((F.col("fold") != fold) & ((F.col("ts_us") < lo - embargo_us) | (F.col("ts_us") > hi + embargo_us) | F.lit(embargo_us <= 0)))
        model = GBTClassifier(featuresCol="x", labelCol="y", maxDepth=depth, maxIter=trees, seed=7).fit(train)
        out.append(model.transform(f.where(F.col("fold") == fold)).select("symbol", "seq", "fold", "x", "y", vector_to_array("probability")[1].alias("p")))
    return written(reduce(DataFrame.unionByName, out), "scores")


def fold_auc(quotes: DataFrame) -> DataFrame:
    return _auc(fold_scores(quotes), ["fold"])


def calibration_gain(quotes: DataFrame) -> DataFrame:
    """Brier score before and after isotonic calibration (fit on even numbers, judged on odd ones), and the verdict at .001, .005, .015."""
    s = fold_scores(quotes).select("seq", "p", "y")
    model = IsotonicRegression(featuresCol="p", labelCol="y").fit(s.where("seq % 2 = 0"))
    g = model.transform(s.where("seq % 2 = 1")).agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("before"), F.avg((F.col("prediction") - F.col("y")) ** 2).alias("after"))
    d = F.col("before") - F.col("after")
    return g.select("before", "after", F.when(d >= 0.015, "large").when(d >= 0.005, "clear").when(d >= 0.001, "small").otherwise("none").alias("verdict"))


def meta_labels(quotes: DataFrame, first: float = 0.5) -> DataFrame:
    """Precision of the first model's picks (p >= first), and of those a second model (on features and p) also takes."""
    s = VectorAssembler(inputCols=["x", "p"], outputCol="z").transform(fold_scores(quotes).where(F.col("p") >= first))
    model = LogisticRegression(featuresCol="z", labelCol="y", maxIter=20).fit(s.where("seq % 2 = 0"))
    t = model.transform(s.where("seq % 2 = 1"))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("picks"), F.avg("y").alias("precision_before"), F.sum("prediction").alias("kept"), F.avg(F.when(F.col("prediction") == 1, F.col("y"))).alias("precision_after"))


def shape_clusters(shapes: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """K-means classes of event shapes (in place of density clusters), with the distance of each row to its centre."""
    x = VectorAssembler(inputCols=columns, outputCol="x").transform(shapes.fillna(0.0, columns))
    model = KMeans(featuresCol="x", k=k, seed=7, maxIter=20).fit(x)
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    away = F.sqrt(F.aggregate(F.zip_with(vector_to_array("x"), F.get(centres, F.col("prediction")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return model.transform(x).select("symbol", "win", F.col("prediction").alias("cluster"), away.alias("away"))


def latent(vectors: DataFrame, k: int = 16) -> DataFrame:
    """The first k principal components of each vector (in place of a convolutional encoder)."""
    v = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x")).where("embedding is not null")
    return PCA(k=k, inputCol="x", outputCol="z").fit(v).transform(v).select("vec_id", vector_to_array("z").alias("z"))


_DOT = "aggregate(zip_with(embedding, centre, (a, b) -> CAST(a AS DOUBLE) * b), 0D, (s, v) -> s + v)"


def match_templates(vectors: DataFrame, least: float = 0.6) -> DataFrame:
    """Every vector against each label's mean: 0.53 cosine (mapped to [0, 1]) + 0.47 / (1 + distance in standard deviations); matches of at least `least`.

    The means number as many as the labels; both tables meet by a join that broadcasts them only below Spark's own limit.
    """
    flat = vectors.select("label", F.posexplode("embedding").alias("i", "e"))
    stats = flat.groupBy("label", "i").agg(F.avg("e").alias("m"), F.stddev_pop("e").alias("sd"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda s: s[c])
    templates = stats.groupBy("label").agg(ordered("m").alias("centre"), ordered("sd").alias("spread")).withColumnRenamed("label", "pattern")
    pairs = vectors.select("vec_id", "embedding").join(templates)
    norms = "sqrt(aggregate(embedding, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)) * sqrt(aggregate(centre, 0D, (s, v) -> s + v * v))"
    far = "sqrt(aggregate(zip_with(zip_with(embedding, centre, (a, b) -> a - b), spread, (d, s) -> IF(s > 0, d / s, 0D)), 0D, (s, v) -> s + v * v) / size(centre))"
    score = F.expr(f"53e-2 * (1 + {_DOT} / ({norms})) / 2 + 47e-2 / (1 + {far})")
    return pairs.select("vec_id", "pattern", score.alias("score")).where(F.col("score") >= least)


def exemplars(vectors: DataFrame, count: int = 5) -> DataFrame:
    """The vectors nearest to the mean of their label."""
    flat = vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    mean = flat.groupBy("label", "i").agg(F.avg("e").alias("m"))
    d = flat.join(mean, ["label", "i"]).groupBy("label", "vec_id").agg(F.round(F.sqrt(F.sum((F.col("e") - F.col("m")) ** 2)), 6).alias("away"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("away", "vec_id"))).where(F.col("place") <= count)


EXEMPLARS_SQL = """WITH flat AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings), mean AS (SELECT label, i, avg(e) AS m FROM flat GROUP BY 1, 2),
 d AS (SELECT f.label, f.vec_id, round(sqrt(sum((e - m) * (e - m))), 6) AS away FROM flat f JOIN mean USING (label, i) GROUP BY 1, 2), r AS (SELECT label, vec_id, away, row_number() OVER (PARTITION BY label ORDER BY away, vec_id) AS place FROM d) SELECT * FROM r WHERE place <= 5"""
MATCH_SQL = """WITH flat AS (SELECT label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings), st AS (SELECT label AS pattern, i, avg(e) AS m, stddev_pop(e) AS sd FROM flat GROUP BY 1, 2),
 v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, pattern, 0.53 * (1 + sum(e * m) / (sqrt(sum(e * e)) * sqrt(sum(m * m)))) / 2 + 0.47 / (1 + sqrt(sum(CASE WHEN sd > 0 THEN (e - m) / sd * (e - m) / sd ELSE 0 END) / count(*))) AS score FROM v JOIN st USING (i) GROUP BY 1, 2)
 SELECT vec_id, pattern, round(score, 6) AS score FROM s WHERE round(score, 6) >= 0.6"""
