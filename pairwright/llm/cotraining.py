"""Quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class CoTrainingSpec:
    """Bounds of what is fitted on, and the course of the rounds; scores cover all documents.

    fit_rows      labelled documents fitted on, at most, per class
    check_rows    further labelled documents that calibrate, at most, per class
    pool_share    share of all documents that a round labels anew; each round takes others
    rounds        exchanges of pseudo-labels
    confidence    probability from which a view's label is handed to the other view
    least_score   documents with a lower combined score are rejected
    """

    fit_rows: int = 2000
    check_rows: int = 1000
    pool_share: float = 0.05
    rounds: int = 2
    confidence: float = 0.95
    text_features: int = 1 << 15
    least_score: float = 0.4


#: Rows of a pool that a task of a fit goes over, about: every step of a fit is a job of its own.
ROWS_PER_TASK = 10_000
NUMBERS = ("log_chars", "log_lines", "line_chars", "word_chars", "upper", "digits", "symbols", "distinct_words")


def _share(text: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def _cell(columns: list[str], name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in columns else F.lit(None).cast(kind)


def with_views(
    docs: DataFrame, spec: CoTrainingSpec, id_column: str = "doc_id", text_column: str = "text", carry: bool = False
) -> DataFrame:
    """``doc, text_view, numbers, origin``: the inputs of both views for every row, and if asked the struct ``row``.

    Text view: words, their shapes (runs of capitals, small letters, digits and signs) and
    repetitions of the word before, hashed and scaled to length 1. Metadata view: language, source,
    length and layout figures, of which no word can be told.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    shape = text
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0"), (r"([^\s\w])\1+", "$1")):
        shape = F.regexp_replace(shape, pattern, sign)
    own = [F.struct("*").alias("row")] if carry else []
    kept = ["doc", *(["row"] if carry else [])]
    rows = docs.select(
        F.col(id_column).alias("doc"),
        *own,
        F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "").alias("words"),
        F.filter(F.split(shape, r"\s+"), lambda w: w != "").alias("shapes"),
        F.length(text).cast("double").alias("chars"),
        F.coalesce(F.regexp_count(text, F.lit("\n")), F.lit(0)).cast("double").alias("lines"),
        _share(text, r"\p{Lu}").alias("upper"),
        _share(text, r"\p{N}").alias("digits"),
        _share(text, r"[^\s\p{L}\p{N}]").alias("symbols"),
        F.array(
            F.concat(F.lit("lang="), F.coalesce(_cell(docs.columns, "lang", "string"), F.lit(""))),
            F.concat(F.lit("source="), F.coalesce(_cell(docs.columns, "source", "string"), F.lit(""))),
        ).alias("origin_terms"),
    )
    n = F.greatest(F.size("words"), F.lit(1))
    repeats = F.filter(
        F.zip_with(F.col("words"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: a == b),
        lambda same: same,
    )
    rows = rows.select(
        *kept, "origin_terms", "upper", "digits", "symbols",
        F.concat(
            F.col("words"),
            F.transform("shapes", lambda s: F.concat(F.lit("shape "), s)),
            F.transform(repeats, lambda _: F.lit("word again")),
        ).alias("terms"),
        F.log1p("chars").alias("log_chars"),
        F.log1p("lines").alias("log_lines"),
        (F.col("chars") / (F.col("lines") + 1)).alias("line_chars"),
        (F.col("chars") / n).alias("word_chars"),
        (F.size(F.array_distinct("words")) / n).alias("distinct_words"),
    )
    rows = HashingTF(numFeatures=spec.text_features, inputCol="terms", outputCol="counts").transform(rows)
    rows = Normalizer(inputCol="counts", outputCol="text_view").transform(rows)
    rows = HashingTF(numFeatures=256, binary=True, inputCol="origin_terms", outputCol="origin").transform(rows)
    numbers = array_to_vector(F.array(*(F.col(c).cast("double") for c in NUMBERS)))
    return rows.select(*kept, "text_view", numbers.alias("numbers"), "origin")


@dataclass
class CoTrained:
    """Fitted views with their calibrations; ``prior`` stands in where the labels were of one class."""

    spec: CoTrainingSpec
    scaler: StandardScalerModel | None = None
    text: LogisticRegressionModel | None = None
    metadata: LogisticRegressionModel | None = None
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    prior: float = 1.0

    def scores(self, views: DataFrame, *keep: str) -> DataFrame:
        """``doc, *keep, text_score, metadata_score, score``: calibrated probabilities and their combination,
        the mean of the calibrated log odds."""
        if self.text is None:
            prior = F.lit(self.prior)
            return views.select(
                "doc", *keep, prior.alias("text_score"), prior.alias("metadata_score"), prior.alias("score")
            )
        rows = _metadata(self.scaler, views)
        odds = []
        for model, column, (a, b) in zip((self.text, self.metadata), ("text", "metadata"), self.calibration):
            model = model.copy({model.rawPredictionCol: f"{column}_raw", model.probabilityCol: "", model.predictionCol: ""})
            rows = model.transform(rows)
            odds.append(F.lit(a) * vector_to_array(f"{column}_raw")[1] + F.lit(b))
        sigmoid = lambda z: 1 / (1 + F.exp(-z))
        return rows.select(
            "doc", *keep, sigmoid(odds[0]).alias("text_score"), sigmoid(odds[1]).alias("metadata_score"),
            sigmoid((odds[0] + odds[1]) / 2).alias("score"),
        )


def _metadata(scaler: StandardScalerModel, views: DataFrame) -> DataFrame:
    scaled = scaler.transform(views)
    return VectorAssembler(inputCols=["scaled", "origin"], outputCol="metadata_view").transform(scaled)


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(
        featuresCol=view, labelCol="label", weightCol="weight", maxIter=30, regParam=1e-4, standardization=False
    ).fit(rows)


def _weighted(rows: DataFrame) -> DataFrame:
    """Both classes with the same total weight."""
    sizes = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for label, n in sizes.items():
        weight = F.when(F.col("label") == label, total / (2.0 * n)).otherwise(weight)
    return rows.withColumn("weight", weight)


def train(
    docs: DataFrame, labels: DataFrame, spec: CoTrainingSpec = CoTrainingSpec(), id_column: str = "doc_id",
    text_column: str = "text", label_column: str = "quality",
) -> CoTrained:
    """Fit both views on a bounded sample of ``labels`` (1: good, 0: bad) and on pools of all documents.

    The sample are the labelled rows with the least hash of their id. Each round fits both views,
    lets each label a pool of its own, a share of all documents outside the sample, and adds its
    confident labels to the other view's training set; pools are never gathered, fits run on
    them where they lie. A document with labels of both kinds counts as bad; null ids and labels
    are ignored. With labels of one class or none nothing is fitted and every document scores the
    share of good labels (1 if none).
    """
    order = F.xxhash64(F.col("doc"), F.lit("co-training"))
    known = materialize(
        labels.select(F.col(id_column).alias("doc"), F.col(label_column).cast("int").alias("label"))
        .where("doc is not null and label in (0, 1)")
        .groupBy("doc").agg(F.min("label").cast("double").alias("label"))
        .join(docs.select(F.col(id_column).alias("doc")).distinct(), "doc"),
        "labels",
    )
    sizes = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2 or min(sizes.values()) < 4:
        return CoTrained(spec, prior=sizes.get(1, 0) / sum(sizes.values()) if sizes else 1.0)
    chosen = None
    for label in (0.0, 1.0):
        # of few labels a third calibrates
        check = min(spec.check_rows, sizes[int(label)] // 3)
        part = known.where(F.col("label") == label).orderBy(order, "doc").limit(spec.fit_rows + check)
        part = part.select("doc", "label", F.row_number().over(Window.orderBy(order, "doc")).alias("k")).select(
            "doc", "label", F.when(F.col("k") <= check, "check").otherwise("fit").alias("use")
        )
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * (fit_rows + check_rows) rows are broadcast
    sample = materialize(chosen, "sample").withColumnRenamed("doc", "sampled")
    picked = docs.join(F.broadcast(sample), F.col(id_column) == F.col("sampled")).dropDuplicates([id_column])
    views = materialize(
        with_views(picked, spec, id_column, text_column).join(
            F.broadcast(sample.withColumnRenamed("sampled", "doc")), "doc"
        ),
        "views",
    )
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="numbers", outputCol="scaled").fit(
        views.where("use = 'fit'")
    )
    views = materialize(
        _metadata(scaler, views).select("doc", "label", "use", "text_view", "numbers", "origin", "metadata_view")
        .repartition(2),
        "scaled",
    )
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit("pool")), F.lit(1 << 20)) / float(1 << 20)
    pools = docs.where(draw < spec.pool_share * spec.rounds).join(
        F.broadcast(sample.select("sampled")), F.col(id_column) == F.col("sampled"), "left_anti"
    )
    pools = with_views(pools.withColumn(id_column, F.struct(F.col(id_column).alias("id"), draw.alias("draw"))), spec, id_column, text_column)
    pools = materialize(
        _metadata(scaler, pools).select(
            F.col("doc.id").alias("doc"), F.floor(F.col("doc.draw") / spec.pool_share).alias("round"),
            "text_view", "numbers", "origin", "metadata_view",
        ).repartition(1 + int(docs.count() * spec.pool_share * spec.rounds) // ROWS_PER_TASK),
        "pools",
    )
    fit = views.where("use = 'fit'").drop("use")
    sets = {"text_view": fit, "metadata_view": fit}
    models: dict[str, LogisticRegressionModel] = {}
    for k in range(spec.rounds + 1):
        models = {view: _fit(_weighted(rows), view) for view, rows in sets.items()}
        if k == spec.rounds:
            break
        pool = pools.where(F.col("round") == k).drop("round")
        for view, other in (("text_view", "metadata_view"), ("metadata_view", "text_view")):
            told = models[view].transform(pool).withColumn("p", vector_to_array("probability")[1])
            sure = told.where((F.col("p") >= spec.confidence) | (F.col("p") <= 1 - spec.confidence)).select(
                "doc", F.when(F.col("p") > 0.5, 1.0).otherwise(0.0).alias("label"), *pool.columns[1:]
            )
            sets[other] = materialize(sets[other].select(sure.columns).union(sure), f"{other}-set")
    check = views.where("use = 'check'")
    calibration = []
    for view, model in models.items():
        margins = materialize(
            model.transform(check).select("label", vector_to_array("rawPrediction")[1].alias("margin")), "margins"
        ).select("label", array_to_vector(F.array("margin")).alias("margin"))
        platt = LogisticRegression(featuresCol="margin", labelCol="label", maxIter=50, regParam=1e-3).fit(margins)
        calibration.append((float(platt.coefficients[0]), float(platt.intercept)))
    return CoTrained(spec, scaler, models["text_view"], models["metadata_view"], tuple(calibration))


def score_documents(
    docs: DataFrame, labels: DataFrame, spec: CoTrainingSpec = CoTrainingSpec(), id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id_column, text_score, metadata_score, score, kept`` of every row of ``docs``, null and empty texts too."""
    model = train(docs, labels, spec, id_column, text_column)
    scored = model.scores(with_views(docs, spec, id_column, text_column))
    return scored.withColumn("kept", F.col("score") >= spec.least_score).withColumnRenamed("doc", id_column)


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, spec: CoTrainingSpec = CoTrainingSpec(), id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; each row is judged by itself, none shuffled."""
    model = train(docs, labels, spec, id_column, text_column)
    scored = model.scores(with_views(docs, spec, id_column, text_column, carry=True), "row")
    return scored.where(F.col("score") >= spec.least_score).select("row.*")
