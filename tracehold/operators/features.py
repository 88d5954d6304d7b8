"""Feature engineering: time, numeric, categorical and text columns to one vector."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.operators.anomaly import known
from tracehold.operators.ordered import numbered
from tracehold.operators.word_counts import LEAST, LETTER, term_totals
from tracehold.session import stage, staging_path

# Size of the text vocabulary and what counts as a word.
MAX_TERMS = 100
WORD = f"{LETTER}{{{LEAST},}}"

LEVEL_SCHEMA = "field string, level string, n long, code long"


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, day_of_week (Monday 0) and is_weekend; a missing time gives no weekend."""
    day = F.weekday(ts)
    return df.withColumns(
        {"hour": F.hour(ts), "day_of_week": day, "is_weekend": F.when(day >= 5, 1).otherwise(0)}
    )


def text_of(fields: list[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def vocabulary(df: DataFrame, fields: list[str], size: int = MAX_TERMS) -> DataFrame:
    """The most frequent terms with their smoothed inverse document frequency.

    Occurrences and texts are counted in bulk in the tasks, which read a text once.
    """
    rows = df.count()
    terms = term_totals(df.select(F.lower(text_of(fields)).alias("_text")))
    terms = terms.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    top = terms.orderBy(F.desc("total"), "term").limit(size)
    return top.select("term", "total", "df", (F.log((F.lit(1.0) + rows) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, fields: list[str], row_id: str, size: int = MAX_TERMS) -> DataFrame:
    """Long form of the text features: (row id, term, weight), rows of length one.

    The vocabulary has at most ``size`` terms; the weights are row-local, nothing of the
    texts is shuffled.
    """
    terms = {r["term"]: r["idf"] for r in vocabulary(df, fields, size).orderBy("term").collect()}
    if not terms:
        return df.select(row_id, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    weighted = FeatureModel(text_fields=list(fields), terms=terms).transform(df, "_features")
    names = F.array(*[F.lit(t) for t in terms])
    cells = F.filter(F.arrays_zip(names.alias("term"), vector_to_array("_features").alias("weight")), lambda c: c["weight"] > 0)
    return weighted.select(row_id, F.inline(cells))


def level_table(df: DataFrame, fields: list[str], share: float = 0.0) -> str:
    """Path of the written dictionary (field, level, n, code) of the fields' levels; nulls are none.

    Codes count the levels in order from 0, so there may be as many as rows: they
    are numbered by a range sort and stay a table.  Levels held by less than
    ``share`` of the rows have one common code behind the others, but for the first
    level, which is always 0.
    """
    parts = [df.select(F.lit(f).alias("field"), F.col(f).cast("string").alias("level")) for f in fields]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    found = stage(rows.where(F.col("level").isNotNull()).groupBy("field", "level").agg(F.count("*").alias("n")), "levels")
    if share:
        enough = share * df.count()
        first = found.groupBy("field").agg(F.min("level").alias("first"))
        found = found.join(first, "field").withColumn("own", (F.col("n") >= enough) | (F.col("level") == F.col("first"))).drop("first")
    else:
        found = found.withColumn("own", F.lit(True))
    own = numbered(found.where("own").drop("own"), ["field"], ["level"], "code").withColumn("code", F.col("code") - 1)
    own = stage(own.select("field", "level", "n", "code"), "codes")
    behind = own.groupBy("field").agg(F.count("*").alias("code"))
    rare = found.where(~F.col("own")).join(behind, "field").select("field", "level", "n", "code")
    path = staging_path(df.sparkSession, "dictionary")
    own.unionByName(rare).write.parquet(path)
    return path


@dataclass
class FeatureModel:
    """Fitted features; what is kept here is small: two numbers per numeric field, the
    number of codes of a categorical field, at most a hundred terms.  The levels are
    a table at ``levels``.  New data goes through the fitted values, never through a refit.
    """

    numeric: dict[str, tuple[float, float]] = field(default_factory=dict)
    categorical: dict[str, int] = field(default_factory=dict)
    text_fields: list[str] = field(default_factory=list)
    terms: dict[str, float] = field(default_factory=dict)
    levels: str = ""

    def fields(self) -> list[str]:
        """What the places of :meth:`coded` hold."""
        return [*self.numeric, *self.categorical, *[f"term_{t}" for t in self.terms]]

    def code_places(self) -> frozenset[int]:
        return frozenset(range(len(self.numeric), len(self.numeric) + len(self.categorical)))

    def names(self, spark: SparkSession, places: list[int]) -> dict[int, str]:
        """Names of some places of the vector of :meth:`transform`, as many as are asked for."""
        start, found, wanted = len(self.numeric), {}, set(places)
        found.update({i: f for i, f in enumerate(self.numeric) if i in wanted})
        for f, size in self.categorical.items():
            codes = [p - start + 1 for p in wanted if start <= p < start + max(size - 1, 0)]
            if codes:
                # A code that rare levels share is named by the first of them.
                asked = self._levels(spark).where((F.col("field") == f) & F.col("code").isin(codes))
                for row in asked.groupBy("code").agg(F.min("level").alias("level"), F.count("*").alias("n")).collect():
                    found[start + row["code"] - 1] = f"{f}_{row['level']}" + (" and others" if row["n"] > 1 else "")
            start += max(size - 1, 0)
        found.update({start + i: f"term_{t}" for i, t in enumerate(self.terms) if start + i in wanted})
        return found

    def columns(self) -> list[Column]:
        """The numeric columns, filled and in deviations."""
        found = []
        for name, (mean, deviation) in self.numeric.items():
            value = F.coalesce(known(name), F.lit(mean))
            found.append((value - F.lit(mean)) / F.lit(deviation or 1.0))
        return found

    def _levels(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(LEVEL_SCHEMA).parquet(self.levels)

    def with_codes(self, df: DataFrame) -> DataFrame:
        """Add ``_code0``, ... of the categorical fields; first, missing and unknown levels are 0.

        Spark broadcasts a dictionary by its measured size and splits hot levels of a larger one.
        """
        for i, f in enumerate(self.categorical):
            dictionary = self._levels(df.sparkSession).where(F.col("field") == f)
            dictionary = dictionary.select(F.col("level").alias("_level"), F.col("code").alias(f"_code{i}"))
            df = df.withColumn("_level", F.col(f).cast("string")).join(dictionary, "_level", "left").drop("_level")
            df = df.withColumn(f"_code{i}", F.coalesce(f"_code{i}", F.lit(0)))
        return df

    def _with_text(self, df: DataFrame, output: str) -> DataFrame:
        step = df.withColumn("_words", words(text_of(self.text_fields)))
        stages = [
            CountVectorizerModel.from_vocabulary(list(self.terms), inputCol="_words", outputCol="_counts"),
            ElementwiseProduct(scalingVec=Vectors.dense(list(self.terms.values())), inputCol="_counts", outputCol="_weights"),
            Normalizer(p=2.0, inputCol="_weights", outputCol=output),
        ]
        for stage_ in stages:
            step = stage_.transform(step)
        return step.drop("_words", "_counts", "_weights")

    def coded(self, df: DataFrame, output: str) -> DataFrame:
        """Add the array of numbers, codes of levels and term weights: one place a field, however many levels."""
        base, step = df.columns, self.with_codes(df)
        cells = [*self.columns(), *[F.col(f"_code{i}").cast("double") for i in range(len(self.categorical))]]
        values = F.array(*cells).cast("array<double>")
        if self.terms:
            step = self._with_text(step, "_text")
            values = F.concat(values, vector_to_array("_text"))
        return step.select(*base, values.alias(output))

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the sparse vector of numbers, one-hot levels (but the first) and term weights."""
        base, step = df.columns, self.with_codes(df)
        plain = {f"_f{i}": c for i, c in enumerate(self.columns())}
        step, inputs = step.withColumns(plain) if plain else step, list(plain)
        hot = {i: size - 1 for i, size in enumerate(self.categorical.values()) if size > 1}
        if hot:
            # Code 0 becomes an invalid category, which is all zeros.
            step = step.withColumns({f"_code{i}": (F.col(f"_code{i}") - 1).cast("double") for i in hot})
            encoder = OneHotEncoder(
                inputCols=[f"_code{i}" for i in hot], outputCols=[f"_hot{i}" for i in hot], handleInvalid="keep", dropLast=True
            )
            largest = df.sparkSession.range(1).select(*[F.lit(float(n - 1)).alias(f"_code{i}") for i, n in hot.items()])
            step = encoder.fit(largest).transform(step)
            inputs += [f"_hot{i}" for i in hot]
        if self.terms:
            step = self._with_text(step, "_text")
            inputs.append("_text")
        assembled = VectorAssembler(inputCols=inputs, outputCol=output).transform(step)
        return assembled.select(*base, output)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "FeatureModel":
        body = json.loads(text)
        body["numeric"] = {k: tuple(v) for k, v in body["numeric"].items()}
        return FeatureModel(**body)


def fit_features(
    df: DataFrame,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    text: list[str] | None = None,
    level_share: float = 0.0,
) -> FeatureModel:
    """Learn means, population deviations, category levels (see :func:`level_table`) and terms."""
    if not (numeric or categorical or text):
        raise ValueError("no features given")
    model = FeatureModel(text_fields=list(text or []))
    if numeric:
        row = df.agg(
            *[F.avg(known(f)).alias(f"m_{f}") for f in numeric],
            *[F.stddev_pop(known(f)).alias(f"s_{f}") for f in numeric],
            *[F.count(known(f)).alias(f"n_{f}") for f in numeric],
            F.count("*").alias("n"),
        ).first()
        for f in numeric:
            mean = row[f"m_{f}"] or 0.0
            # Rows filled with the mean add no deviation but count in the divisor.
            shrink = (row[f"n_{f}"] / row["n"]) ** 0.5 if row["n"] else 0.0
            model.numeric[f] = (mean, (row[f"s_{f}"] or 0.0) * shrink)
    if categorical:
        model.levels = level_table(df, categorical, level_share)
        sizes = model._levels(df.sparkSession).groupBy("field").agg((F.max("code") + 1).alias("n")).collect()
        model.categorical = {f: {r["field"]: r["n"] for r in sizes}.get(f, 0) for f in categorical}
    if text:
        model.terms = {r["term"]: r["idf"] for r in vocabulary(df, text).orderBy("term").collect()}
    return model


def one_hot(df: DataFrame, field_name: str, row_id: str) -> DataFrame:
    """Long form of one-hot columns: (row id, level, 1) without the first level."""
    first = df.agg(F.min(F.col(field_name).cast("string")).alias("v")).scalar()
    level = F.col(field_name).cast("string")
    return df.where(level.isNotNull() & (level != first)).select(row_id, level.alias("level"), F.lit(1).alias("value"))


def standardized(df: DataFrame, fields: list[str], row_id: str) -> DataFrame:
    """Mean-filled fields in population deviations, in one scan after one aggregation."""
    model = fit_features(df, numeric=fields)
    return df.select(row_id, *[c.alias(f) for f, c in zip(fields, model.columns())])

