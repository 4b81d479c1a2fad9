"""Text features, classifiers, themes and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noticelake.functions.gazetteer import extract_entities, label_category
from noticelake.functions.once import once
from noticelake.functions.parsing import strip_html
from noticelake.functions.severity import severity_label, severity_score
from noticelake.functions.text import DOMAIN, ENGLISH, bigrams, compose_text, tokens
from noticelake.operators import clusters
from noticelake.operators.aggregates import unique_slugs
from noticelake.operators.vectors import dot, knn, normalized, novelty, with_embedding, with_surrogates
from noticelake.storage import cut, fresh_path

#: The classes that a model of classes is trained on.
TRAINED = ("Class I", "Class II", "Class III")


def tfidf(df: DataFrame, key: str, text: str, min_df: int | Column = 2, max_df: float | Column | None = None, max_features: int = 20_000, stop: frozenset[str] = ENGLISH, part: str | None = None) -> DataFrame:
    """``key``, ``term``, ``weight``: smoothed idf over words and word pairs, rows at unit length.

    The vocabulary is the ``max_features`` terms with most occurrences, ties in order of the term. With ``part``
    every part is a corpus of its own; bounds may then be expressions over ``n``, its number of texts.
    """
    by = [part] if part else []
    # the texts move, once, and not their terms: what is counted by key is counted where its texts are
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = df.select(key, *by, F.col(text).alias("__t")).repartition(tasks, key).select(key, *by, F.filter(tokens(F.col("__t")), lambda w: ~w.isin(*sorted(stop)) if stop else F.lit(True)).alias("__w"))
    terms = held.select(key, *by, F.explode(F.concat("__w", bigrams(F.col("__w")))).alias("term"))
    tf = terms.groupBy(key, *by, "term").agg(F.count("*").alias("tf"))
    total = df.groupBy(*by).agg(F.count("*").alias("n"))
    counts = tf.groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    stats = (counts.join(total, by) if part else counts.crossJoin(F.broadcast(total))).where(F.col("df") >= min_df)
    if max_df is not None:
        stats = stats.where(F.col("df") <= F.coalesce(max_df if isinstance(max_df, Column) else F.lit(max_df), F.lit(1.0)) * F.col("n"))
    if part:
        best = W.partitionBy(*by).orderBy(F.desc("all"), "term")
        kept = stats.withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= max_features)
    else:
        kept = stats.orderBy(F.desc("all"), "term").limit(max_features)
    kept = kept.select(*by, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    if not part:  # no more than the vocabulary
        kept = F.broadcast(kept)
    raw = tf.join(kept, [*by, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


# Bounds of a term's documents, and the corpora from which they hold.
MIN_DF, MIN_DF_LARGE, LARGE_CORPUS, MAX_DF, MAX_DF_FROM = 2, 5, 500, 0.3, 200


def corpus_bounds(n: int) -> dict[str, float | None]:
    """``min_df`` and ``max_df`` for a corpus of ``n`` texts: a real one sheds one-off names and what every text has."""
    return {"min_df": MIN_DF_LARGE if n >= LARGE_CORPUS else MIN_DF, "max_df": MAX_DF if n >= MAX_DF_FROM else None}


def part_bounds() -> dict[str, Column]:
    """The same for ``tfidf`` by parts, over ``n``."""
    return {"min_df": F.when(F.col("n") >= LARGE_CORPUS, MIN_DF_LARGE).otherwise(MIN_DF), "max_df": F.when(F.col("n") >= MAX_DF_FROM, MAX_DF)}


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds weights under which all classes count the same."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    return df.join(F.broadcast(counts.crossJoin(total)), label).withColumn(out, F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def holdout(df: DataFrame, key: str, label: str, share: float = 0.2) -> DataFrame:
    """Adds ``held``: about a share of every class, by a hash of the key."""
    return df.withColumn("held", F.pmod(F.xxhash64(key, label), F.lit(1000)) < int(1000 * share))


def _detached(spark, model):
    """The model as it is stored, without its training summary.

    The summary of two classes holds the session, and a session that has observed a query cannot be sent to tasks.
    """
    path = fresh_path(spark, "trained")
    model.write().save(path)
    return type(model).load(path)


def train_text(df: DataFrame, text: str, label: str, features: int = 20_000, min_df: int = 2) -> PipelineModel:
    """TF-IDF over words and pairs, then balanced logistic regression. ``label`` is a class index."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern="[a-z0-9]{2,}", gaps=False), StopWordsRemover(inputCol="__words", outputCol="__kept", stopWords=sorted(ENGLISH)),
        NGram(n=2, inputCol="__kept", outputCol="__pairs"), SQLTransformer(statement="SELECT *, concat(__kept, __pairs) AS __terms FROM __THIS__"),
        CountVectorizer(inputCol="__terms", outputCol="__tf", vocabSize=features, minDF=min_df), IDF(inputCol="__tf", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=20, regParam=0.01, probabilityCol="__p", rawPredictionCol="__r", predictionCol="prediction"),
    ]
    model = Pipeline(stages=stages).fit(class_weights(df, label))
    return PipelineModel(stages=[*model.stages[:-1], _detached(df.sparkSession, model.stages[-1])])


def train_vectors(df: DataFrame, vector: str, label: str) -> LogisticRegressionModel:
    """Balanced logistic regression on array vectors. Rows with the same vector and label are one, which weighs as much as they do."""
    same = df.select(F.transform(vector, lambda x: x.cast("double")).alias("__v"), label).groupBy("__v", label).agg(F.count("*").alias("__m"))
    counts = same.groupBy(label).agg(F.sum("__m").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    weight = F.col("__m") * F.col("__n") / (F.col("__k") * F.col("__c"))
    rows = cut(same.join(F.broadcast(counts.crossJoin(total)), label).select(label, weight.alias("weight"), "__m", array_to_vector("__v").alias("__x")), "training")
    # the fit scales features by an unbiased deviation, which takes a row of more weight for fewer rows: the penalty makes up for that
    n, apart, one = rows.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("weight") / F.col("__m")), F.sum(F.col("weight") * F.col("weight"))).first()
    penalty = 0.01 * (n - one / n) / (n - apart / n) if n and n > apart / n else 0.01
    model = LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=25, regParam=penalty, probabilityCol="__p", rawPredictionCol="__r").fit(rows)
    return _detached(df.sparkSession, model)


def apply_vectors(df: DataFrame, vector: str, model) -> DataFrame:
    """Adds ``prediction`` and its ``confidence`` to four places."""
    rows = model.transform(df.withColumn("__x", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    return rows.withColumn("confidence", F.round(F.array_max(vector_to_array("__p")), 4)).drop("__x", "__p", "__r")


def classify(df: DataFrame, text: str, rule: Column, model: PipelineModel | None = None, names: list[str] | None = None) -> DataFrame:
    """Adds ``category`` and ``category_confidence``: the model's best class; hazards named by the
    rule rescue what the model calls other; without a model the rule alone."""
    if model is None:
        return df.withColumn("category", rule).withColumn("category_confidence", F.when(F.col("category") == "other", 0.0).otherwise(1.0))
    rows = model.transform(df).withColumn("__rule", rule)
    guess = F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))
    rescued = (guess == "other") & (F.col("__rule") != "other")
    return rows.withColumn("category", F.when(rescued, F.col("__rule")).otherwise(guess)).withColumn("category_confidence", F.when(rescued, 1.0).otherwise(F.array_max(vector_to_array("__p")))).select(*df.columns, "category", "category_confidence")


def evaluate(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class precision, recall, F1 and support, and the accuracy over all."""
    pairs = df.groupBy(F.col(label).cast("string").alias("l"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("right")))).alias("x")).select("x.*")
    per = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("right").alias("right"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumn("precision", ratio(F.col("right"), F.col("called"))).withColumn("recall", ratio(F.col("right"), F.col("support")))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    every = per.agg((F.sum("right") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced"), (F.max("support") / F.sum("support")).alias("majority"))
    return per.crossJoin(F.broadcast(every)).select("class", "support", "precision", "recall", "f1", "accuracy", "balanced", "majority")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("count"))


def rescued(df: DataFrame, rule: str, guess: str, confidence: str, least: float = 0.6) -> DataFrame:
    """How many rows without a rule's class the model classifies with confidence."""
    met = (F.col(guess) != "other") & (F.col(confidence) >= least)
    return df.where(F.col(rule) == "other").agg(F.count("*").alias("others"), F.count_if(met).alias("rescued"))


def themes(df: DataFrame, key: str, vector: str, k: int = 16, floor: int = 200, least: float = 0.55, seeds: tuple[int, ...] = tuple(range(42, 52))) -> DataFrame | None:
    """``key``, ``theme``, ``similarity`` of one part's rows: k-means, the best of several starts.

    Rows less like their centre than ``least`` have no theme. None under ``floor`` rows.
    """
    placed = part_themes(df.withColumn("__part", F.lit("")), key, vector, "__part", k, floor, least, seeds)
    return None if placed is None else placed.drop("__part")


def part_themes(df: DataFrame, key: str, vector: str, part: str, k: int = 16, floor: int = 200, least: float = 0.55, seeds: tuple[int, ...] = tuple(range(42, 52)), max_parts: int = 64) -> DataFrame | None:
    """``key``, ``part``, ``theme``, ``similarity`` of all parts with at least ``floor`` rows; None where no part has.

    All starts of all parts are fitted together (``clusters.fit``); of each part the start of least inertia counts.
    """
    unit = df.where(dot(F.col(vector), F.col(vector)) > 0).select(key, part, normalized(F.col(vector)).alias("v"))
    rows = cut(unit, "unit-vectors")
    sizes = {r[part]: r["n"] for r in rows.groupBy(part).agg(F.count("*").alias("n")).where(F.col("n") >= floor).limit(max_parts + 1).collect()}
    if len(sizes) > max_parts:
        raise ValueError(f"more than {max_parts} parts")
    if not sizes:
        return None
    fitted = clusters.fit(rows, part, "v", sizes, k, seeds)
    placed = clusters.assign(rows, key, part, "v", {p: best for p, (best, _) in fitted.items()})
    return placed.select(key, part, F.when(F.col("similarity") >= least, F.col("theme")).alias("theme"), "similarity")


def theme_labels(weights: DataFrame, assigned: DataFrame, key: str, n: int = 8, candidates: int = 200, by: tuple[str, ...] = ("theme",)) -> DataFrame:
    """Per theme (``by``) its top terms, none part of a better one, and a label of the best three."""
    themed = assigned.where("theme is not null")
    size = themed.groupBy(*by).agg(F.count("*").alias("size"))
    mean = weights.join(themed.select(key, *by), key).groupBy(*by, "term").agg(F.sum("weight").alias("w")).join(size, [*by]).withColumn("w", F.col("w") / F.col("size"))
    order = W.partitionBy(*by).orderBy(F.desc("w"), "term")
    best = mean.withColumn("n", F.row_number().over(order)).where(F.col("n") <= candidates)
    lists = best.groupBy(*by, "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("terms"))
    parted = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    clash = lambda kept, t: F.exists(kept, lambda o: parted(o).contains(parted(t)) | parted(t).contains(parted(o)))
    chosen = F.aggregate("terms", F.array().cast("array<string>"), lambda kept, t: F.when((F.size(kept) >= n) | clash(kept, t), kept).otherwise(F.concat(kept, F.array(t))))
    return lists.withColumn("top_terms", chosen).select(*by, "size", "top_terms", F.array_join(F.slice("top_terms", 1, 3), ", ").alias("label"))


# ---- passes over stored rows


def decode_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with markup or references decoded in place; texts without stay as they are."""
    return df.withColumns({c: F.when(F.col(c).rlike("[<&]"), strip_html(F.col(c))).otherwise(F.col(c)) for c in columns})


def rederive(df: DataFrame) -> DataFrame:
    """Entities, category and severity of stored rows, derived again from their source fields."""
    rows = once(df.drop("entities", "category", "severity_score", "severity_label"), reason_text=F.col("reason_text"))
    rows = once(rows, entities=extract_entities(F.col("reason_text")))
    rows = once(rows, category=label_category(F.col("reason_text"), F.col("entities")))
    score = severity_score(F.col("classification"), F.col("category"), F.col("entities"), F.col("states"), F.col("distribution_pattern"), F.col("reason_text"))
    return once(rows, severity_score=score).withColumn("severity_label", severity_label(F.col("severity_score")))


# ---- saved models, predictions, the whole rebuild


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark, kind, path: str):
    """The model stored at ``path``; None where there is none, so that callers fall back."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return kind.load(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def class_counts(df: DataFrame, countries: tuple[str, ...] = ("us", "ca"), classes: tuple[str, ...] = TRAINED) -> DataFrame:
    """How many notices of every class a country has to train on."""
    return df.where(F.col("country").isin(*countries) & F.col("classification").isin(*classes)).groupBy("country", "classification").agg(F.count("*").alias("count"))


def with_class_index(df: DataFrame, classes: tuple[str, ...] = TRAINED) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, classes)), F.col("classification"))
    return df.where(F.col("classification").isin(*classes)).withColumn("y", (at - 1).cast("double"))


def eval_cross(df: DataFrame, vector: str, train: str, test: str) -> DataFrame:
    """Trained on one country, evaluated on a held-out fifth of it and on another: accuracies and the majority's share."""
    known = holdout(with_class_index(df), "id", "y")
    model = train_vectors(known.where((F.col("country") == train) & ~F.col("held")), vector, "y")
    parts = {"in_domain": (F.col("country") == train) & F.col("held"), "cross": F.col("country") == test}
    out = None
    for name, part in parts.items():
        row = evaluate(apply_vectors(known.where(part), vector, model), "y", "prediction").select(F.lit(name).alias("split"), "accuracy", "balanced", "majority").distinct()
        out = row if out is None else out.unionByName(row)
    return out


def predict_class(df: DataFrame, vector: str, model, countries: tuple[str, ...] = ("uk", "za", "eu"), classes: tuple[str, ...] = TRAINED) -> DataFrame:
    """Predicted class and confidence of countries without classes, and severity scored again with them.

    Notices without a vector, and all without a model, have no prediction and the plain score.
    """
    rows = df.where(F.col("country").isin(*countries))
    if model is None:
        done = rows.withColumn("predicted_class", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        usable = apply_vectors(rows.where(F.col(vector).isNotNull()), vector, model).withColumn("predicted_class", F.get(F.array(*map(F.lit, classes)), F.col("prediction").cast("int"))).drop("prediction")
        done = usable.unionByName(rows.where(F.col(vector).isNull()), allowMissingColumns=True)
    score = severity_score(F.col("classification"), F.col("category"), F.col("entities"), F.col("states"), F.col("distribution_pattern"), F.col("reason_text"), F.col("predicted_class"), F.coalesce("confidence", F.lit(0.0)))
    return done.withColumn("severity_score", score).withColumn("severity_label", severity_label(F.col("severity_score")))


def rebuild(df: DataFrame, vectors: DataFrame, k: int = 6, n_themes: int = 16, floor: int = 200, least: float = 0.55) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All derived tables of notices with ``id``: neighbours, novelty, and themes with their members.

    Every notice is embedded twice: with its product for neighbours, by its reason for themes. Both
    stay within a country. Themes are numbered over all countries, their slugs are unique in each.
    """
    texts = df.select("id", "country", compose_text(F.col("reason_text"), F.col("product_description"), F.col("company_name"), 2, 1).alias("near"), compose_text(F.col("reason_text"), F.col("product_description"), F.col("company_name"), 4, 1).alias("cause"))
    held = cut(texts.where("length(near) > 0"), "texts")
    near = cut(with_embedding(held.select("id", "country", "near"), "near", vectors).where("vector is not null").select("id", "country", "vector"), "vectors")
    neighbors = cut(knn(near, "id", "vector", "country", k), "neighbors")
    novel = novelty(near, neighbors, "id", "country")
    cause = cut(with_embedding(held.select("id", "country", "cause"), "cause", vectors).where("vector is not null"), "vectors")
    members = part_themes(cause, "id", "vector", "country", n_themes, floor, least)
    if members is None:
        return neighbors, novel, None
    placed = cut(members, "themes")
    fitted = cause.join(F.broadcast(placed.select("country").distinct()), "country", "left_semi")
    weights = tfidf(fitted, "id", "cause", stop=ENGLISH | DOMAIN, part="country", **part_bounds())
    named = theme_labels(weights, placed, "id", by=("country", "theme"))
    base = F.trim(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "-"), F.lit("-"))
    numbered = with_surrogates(named.withColumnRenamed("theme", "cluster")).withColumn("base", F.when(base == "", F.concat(F.lit("theme-"), F.col("id").cast("string"))).otherwise(base))
    return neighbors, novel, unique_slugs(numbered, "base", "country", "cluster").drop("base").withColumnRenamed("cluster", "theme")
