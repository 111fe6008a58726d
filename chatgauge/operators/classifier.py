"""Text classifiers trained on labelled chats.

``fit_label_model`` is a Spark ML pipeline (hashed words, logistic regression) that is fitted on
a bounded number of rows. ``fit_word_model`` is multinomial naive Bayes as tables: every row
and every word counts, weights are a table of words that is written and read like any other,
and a prediction is a join and a sum, so that anybody who has the table can make it again.
"""

import math
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chat import answer_sql, asked_sql, prompt_sql
from ..functions.expr import literal
from ..functions.labels import clean_classes, label_sql
from ..session import cut_lineage


def training_rows(chats: DataFrame, classes) -> DataFrame:
    """(example_id, prompt, label) of chats that have an answer."""
    answered = chats.selectExpr("example_id", "messages", f"{answer_sql('messages')} AS answer").where("answer <> ''")
    return answered.selectExpr(
        "example_id", f"{prompt_sql(asked_sql('messages'))} AS prompt", f"{label_sql('answer', classes)} AS label"
    )


#: Penalties to choose from, and one in how many rows judges them.
PENALTIES, JUDGING = (10.0, 1.0, 0.1, 0.01), 5


def log_loss(model, rows: DataFrame):
    """(mean, standard error) of -log of the probability given to the true label."""
    given = vector_to_array("probability")[F.col("label_no").cast("int")]
    loss = -F.log(F.greatest(given, F.lit(1e-9)))
    mean, error = model.transform(rows).agg(F.avg(loss), F.stddev_samp(loss) / F.sqrt(F.count("*"))).first()
    return (math.inf if mean is None else mean), error or 0.0


def choose_penalty(judged) -> float:
    """The strongest penalty whose loss is within a standard error of the least.

    ``judged`` is (penalty, (mean, error)); with few rows the least loss alone is mostly chance.
    """
    least, error = min(loss for _, loss in judged)
    return max(p for p, (mean, _) in judged if mean <= least + error)


def bounded(rows: DataFrame, most) -> DataFrame:
    """At most ``most`` rows, those of the least prompt hashes; equal prompts stay or go together."""
    key = F.xxhash64("prompt")
    least = rows.select(key.alias("key")).orderBy("key").limit(most + 1)
    cut = least.agg(F.when(F.count("*") > most, F.max("key")).alias("cut")).scalar()
    return rows.where(cut.isNull() | (key < cut))


def fit_label_model(
    rows: DataFrame, classes, features=1 << 16, iterations=20, most=100_000, penalties=PENALTIES
) -> PipelineModel:
    """Fit on (prompt, label), on at most ``most`` rows, chosen by a hash of the prompt.

    The penalty is chosen on a fifth of these rows that the trial models have not seen (equal
    prompts stay together); the model is then fitted on all of them. The class list fixes the label numbers, so no pass is needed to
    index labels, and the hashed features keep the model's size fixed whatever the vocabulary.
    """
    number = f"CAST(array_position({literal(clean_classes(classes))}, label) - 1 AS DOUBLE) AS label_no"
    numbered = rows.selectExpr("prompt", number).where("label_no >= 0")
    if most:
        numbered = bounded(numbered, most)
    counting = PipelineModel([
        RegexTokenizer(inputCol="prompt", outputCol="words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
    ])
    judging = (F.pmod(F.xxhash64(F.lit("judging"), "prompt"), F.lit(JUDGING)) == 0).alias("judging")
    # the weights and the solver pass over the counts several times: tokenise once
    counts = counting.transform(numbered).select("counts", "label_no", judging).persist()

    def solve(part, penalty):
        return LogisticRegression(
            featuresCol="features", labelCol="label_no", predictionCol="predicted_no",
            maxIter=iterations, regParam=penalty, aggregationDepth=3,
        ).fit(part)

    try:
        weighing = IDF(inputCol="counts", outputCol="features").fit(counts)
        weighed = weighing.transform(counts)
        best = max(penalties)
        learning, unseen = weighed.where("NOT judging"), weighed.where("judging")
        if len(penalties) > 1 and not learning.isEmpty():
            best = choose_penalty([(p, log_loss(solve(learning, p), unseen)) for p in penalties])
        return PipelineModel([*counting.stages, weighing, solve(weighed, best)])
    finally:
        counts.unpersist()


def predict_labels(model: PipelineModel, rows: DataFrame, classes) -> DataFrame:
    """Add ``predicted``, the class name of the model's answer."""
    name = f"element_at({literal(clean_classes(classes))}, CAST(predicted_no AS INT) + 1) AS predicted"
    return model.transform(rows).selectExpr(*rows.columns, name)


class WordModel(NamedTuple):
    """(word, w) with a weight for each class in ``w``, what each class adds to every text, and the classes."""

    weights: DataFrame
    base: list
    classes: tuple

    def write(self, path, mode="errorifexists"):
        """Weights and classes as two tables below ``path``."""
        spark = self.weights.sparkSession
        self.weights.write.mode(mode).parquet(f"{path}/weights")
        spark.createDataFrame([(list(self.classes), self.base)], "classes ARRAY<STRING>, base ARRAY<DOUBLE>").write.mode(mode).parquet(f"{path}/classes")


def read_word_model(spark, path) -> WordModel:
    row = spark.read.parquet(f"{path}/classes").first()
    return WordModel(spark.read.parquet(f"{path}/weights"), list(row["base"]), tuple(row["classes"]))


WORD_PATTERN = r"[\\p{L}\\p{N}_]+"  # in SQL text


def _words(rows: DataFrame, *kept) -> DataFrame:
    return rows.selectExpr(*kept, f"explode(regexp_extract_all(lower(prompt), '{WORD_PATTERN}', 0)) AS word")


def fit_word_model(rows: DataFrame, classes) -> WordModel:
    """Fit on (prompt, label); a class without rows gets no text.

    Words are counted before the one shuffle, so a common word is a row for each task. Only
    the number of rows and words of each class reaches the driver.
    """
    names = clean_classes(classes)
    known = rows.where(F.col("label").isin(list(names)))
    n_rows = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = cut_lineage(_words(known, "label").groupBy("word").agg(
        *[F.count_if(F.col("label") == c).alias(f"n{k}") for k, c in enumerate(names)]
    ))
    n_words, *of_class = counts.agg(F.count("*"), *[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(len(names))]).first()
    total = sum(n_rows.values())
    weights = ", ".join(f"ln((n{k} + 1) / {n + n_words}D)" for k, n in enumerate(of_class))
    base = [math.log(n_rows[c] / total) if n_rows.get(c) else -math.inf for c in names]
    return WordModel(counts.selectExpr("word", f"array({weights}) AS w"), base, names)


#: Share of the model's words from which on a word is common: at most 10,000 words have it, as shares add up to one.
COMMON = 1e-4


def weights_of_words(model: WordModel, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights of the (key, word) rows that the model knows: (of common words, of all others).

    Common words get theirs from a broadcast, where they are: shuffled by word, the rows of one would all
    go to one task. A word that is common in ``words`` alone is left to the splitting of skewed joins.
    """
    share = " + ".join(f"{math.exp(b)!r}D * exp(w[{k}])" for k, b in enumerate(model.base))
    marked = model.weights.withColumn("common", F.expr(f"{share} > {COMMON!r}D"))
    common, others = (marked.where(c).drop("common") for c in ("common", "NOT common"))
    rest = words.join(F.broadcast(common.select("word")), "word", "left_anti")
    return words.join(F.broadcast(common), "word"), rest.join(others, "word")


def predict_words(model: WordModel, rows: DataFrame, key="example_id") -> DataFrame:
    """Add ``predicted`` to (key, prompt, ...): the class of the largest sum, the first of equal ones.

    ``key`` must be unique. Words that the model does not know count for nothing.
    """
    places = range(len(model.classes))
    common, others = weights_of_words(model, _words(rows, key))
    sums = common.unionByName(others).groupBy(key).agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in places])
    found = rows.join(sums, key, "left")
    scores = [f"coalesce(s{k}, 0D) + double('{model.base[k]}')" for k in places]
    best = f"array_position(array({', '.join(scores)}), greatest({', '.join(scores)}))" if len(scores) > 1 else "1"
    return found.selectExpr(*[f"`{c}`" for c in rows.columns], f"element_at({literal(model.classes)}, CAST({best} AS INT)) AS predicted")


def train_and_evaluate(rows: DataFrame, classes, held_out) -> tuple[WordModel, DataFrame]:
    """(model, rows with ``held_out`` and ``predicted``): fitted without the rows that ``held_out`` names, applied to all."""
    marked = rows.withColumn("held_out", held_out)
    model = fit_word_model(marked.where("NOT held_out"), classes)
    return model, predict_words(model, marked)
