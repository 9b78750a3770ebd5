"""Feature matrix: scaled numbers, one-hot categories, text vectors, one vector column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF, PCA, HashingTF, IndexToString, Normalizer, OneHotEncoder,
    SQLTransformer, StringIndexer, StringIndexerModel, Tokenizer, VectorAssembler, VectorSizeHint,
)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwise.config import DEFAULTS, Settings

TEXTS = ("current_transcript", "context_text")


def scale_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; deviation 1 for a constant. One job."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standard_scale(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "_z") -> DataFrame:
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def _scaling_sql(stats: dict[str, tuple[float, float]], categorical: Sequence[str],
                 texts: Sequence[str], sentinel: str) -> str:
    parts = ["*"] + [f"(cast(`{c}` as double) - ({m!r}D)) / ({s!r}D) AS `{c}__z`" for c, (m, s) in stats.items()]
    parts += [f"coalesce(cast(`{c}` as string), '{sentinel}') AS `{c}__s`" for c in categorical]
    parts += [f"coalesce(`{c}`, '') AS `{c}__t`" for c in texts]
    return "SELECT " + ", ".join(parts) + " FROM __THIS__"


def frequent_categories(df: DataFrame, columns: Sequence[str], most: int) -> list[list[str]]:
    """Up to ``most`` values of each column, in order of their names: the most frequent, ties to the first name.

    Counts are exact and shuffled by value; the driver receives ``most`` values a column, however many there are.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(pairs)).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).persist()
    found = [[r["v"] for r in counts.where(F.col("c") == i).orderBy(F.desc("n"), "v").limit(most).collect()] for i in range(len(columns))]
    counts.unpersist()
    return [sorted(v) for v in found]


def count_stages(column: str, out: str, dim: int) -> list:
    """A text's hashed bag of words, ``{out}__tf``; all in the JVM."""
    return [
        Tokenizer(inputCol=column, outputCol=f"{out}__w"),
        HashingTF(inputCol=f"{out}__w", outputCol=f"{out}__tf", numFeatures=dim),
    ]


def word_counts(df: DataFrame, texts: Sequence[str] = TEXTS, dim: int = DEFAULTS.embedding_dim) -> DataFrame:
    """``df`` with the hashed bag of words of each text; a null text is empty."""
    ready = df.withColumns({f"{t}__t": F.coalesce(F.col(t), F.lit("")) for t in texts})
    for t in texts:
        for stage in count_stages(f"{t}__t", f"{t}__v", dim):
            ready = stage.transform(ready)
    return ready.select(*df.columns, *[f"{t}__v__tf" for t in texts])


def fit_features(df: DataFrame, settings: Settings = DEFAULTS, texts: Sequence[str] = TEXTS,
                 vectors: Mapping[str, int] | None = None) -> PipelineModel:
    """Fit [numbers, one-hot, text vectors] -> ``features`` on ``df``.

    ``texts`` are hashed, weighted by IDF and cut to unit length; ``vectors`` name columns that already hold vectors of
    another encoder, with their widths. The target takes no part, so the same model serves
    training and scoring. Of a category column the ``most_categories`` most frequent values have slots; others encode to
    zeros, as values do that were not seen.
    """
    return fit_counted(word_counts(df, texts, settings.embedding_dim), settings, texts, vectors)[0]


def fit_counted(df: DataFrame, settings: Settings = DEFAULTS, texts: Sequence[str] = TEXTS,
                vectors: Mapping[str, int] | None = None) -> tuple[PipelineModel, PipelineModel]:
    """``fit_features`` on rows with the ``word_counts`` of their texts: (the pipeline, the same for rows with word counts).

    A written table of word counts spares a pass over the texts for each statistic and each use.
    """
    stats = scale_stats(df, settings.numeric)
    cats = [f"{c}__s" for c in settings.categorical]
    filled, counted = (SQLTransformer(statement=_scaling_sql(stats, settings.categorical, t, settings.sentinel)) for t in (texts, ()))
    encoders: list = []
    if cats:
        categories = frequent_categories(counted.transform(df).select(*cats), cats, settings.most_categories)
        indexed = [f"{c}__i" for c in settings.categorical]
        encoders = Pipeline(stages=[
            counted,
            StringIndexerModel.from_arrays_of_labels(categories, inputCols=cats, outputCols=indexed, handleInvalid="keep"),
            # The slot kept for unknown values is the last one, which is dropped: all zeros.
            OneHotEncoder(inputCols=[f"{c}__i" for c in settings.categorical],
                          outputCols=[f"{c}__o" for c in settings.categorical], dropLast=True),
        ]).fit(df).stages[1:]
    whole, rest = [filled, *encoders], [counted, *encoders]
    for t in texts:
        weighed = [IDF(inputCol=f"{t}__v__tf", outputCol=f"{t}__v__idf").fit(df), Normalizer(inputCol=f"{t}__v__idf", outputCol=f"{t}__v")]
        whole += count_stages(f"{t}__t", f"{t}__v", settings.embedding_dim) + weighed
        rest += weighed
    vectors = vectors or {}
    last = [VectorSizeHint(inputCol=c, size=n, handleInvalid="optimistic") for c, n in vectors.items()]
    last.append(VectorAssembler(
        inputCols=[*[f"{c}__z" for c in settings.numeric], *[f"{c}__o" for c in settings.categorical],
                   *[f"{t}__v" for t in texts], *vectors],
        outputCol="features", handleInvalid="keep"))
    return PipelineModel([*whole, *last]), PipelineModel([*rest, *last])


def add_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The input columns plus ``features``."""
    return model.transform(df).select(*df.columns, "features")


def feature_names(model: PipelineModel, settings: Settings = DEFAULTS, n_embedding: int = 0) -> list[str]:
    """Names along the vector: numbers, ``column_value``, ``emb_i``."""
    names = list(settings.numeric)
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            for column, values in zip(settings.categorical, stage.labelsArray):
                names += [f"{column}_{v}" for v in values]
    return names + [f"emb_{i}" for i in range(n_embedding)]


def fit_labels(df: DataFrame, target: str = DEFAULTS.target) -> StringIndexerModel:
    """Sorted label codes; a label not seen here is an error later."""
    return StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc",
                         handleInvalid="error").fit(df)


def decode_labels(df: DataFrame, labels: Sequence[str], code: str = "label",
                  out: str = "decoded") -> DataFrame:
    return IndexToString(inputCol=code, outputCol=out, labels=list(labels)).transform(df)


def hashing_encoder(dim: int = DEFAULTS.embedding_dim) -> Callable[[DataFrame, str, str], DataFrame]:
    """An encoder (frame, text column, output column) -> frame with unit vectors as arrays.

    Term frequencies only, so a text's vector does not depend on the other texts
    and may be cached.
    """
    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        stages = Pipeline(stages=[
            Tokenizer(inputCol="__t", outputCol="__w"),
            HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dim),
            Normalizer(inputCol="__tf", outputCol="__v")])
        ready = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
        return stages.fit(ready).transform(ready).withColumn(
            out, vector_to_array("__v", "float32")).drop("__t", "__w", "__tf", "__v")
    return encode


def batch_encoder(make_predict_fn: Callable, dim: int, batch_size: int = 64
                  ) -> Callable[[DataFrame, str, str], DataFrame]:
    """An encoder around a neural model: ``make_predict_fn`` loads it once per worker and
    returns a function from an array of texts to a matrix with ``dim`` columns."""
    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        from pyspark.sql.types import ArrayType, FloatType

        predict = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()),
                                    batch_size=batch_size)
        return df.withColumn(out, predict(F.coalesce(F.col(text), F.lit(""))))
    return encode


def one_hot_counts(df: DataFrame, columns: Sequence[str], sentinel: str = DEFAULTS.sentinel) -> DataFrame:
    """Rows per one-hot slot: one pass over the filled columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.coalesce(F.col(c).cast("string"), F.lit(sentinel)).alias("category"))
                      for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "category").agg(F.count(F.lit(1)).alias("n"))


def as_vector(col: Column) -> Column:
    return array_to_vector(col.cast("array<double>"))


def principal_components(df: DataFrame, vector: str, k: int = 2):
    """(rows with centred ``pc1..pck``, explained variance shares).

    Spark projects without centring, so the projection of the mean is taken off.
    """
    model = PCA(k=k, inputCol=vector, outputCol="__pc").fit(df)
    projected = model.transform(df).withColumn("__pc", vector_to_array("__pc"))
    mean = projected.agg(*[F.avg(F.get("__pc", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    coords = projected.withColumns({
        f"pc{i + 1}": F.get("__pc", F.lit(i)) - F.lit(mean[f"m{i}"]) for i in range(k)}).drop("__pc")
    return coords, [float(x) for x in model.explainedVariance.toArray()]


