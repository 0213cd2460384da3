"""Group-mean and ordinal encoders as ML pipeline stages, and the out-of-fold variant.

Both keep their fitted state as a table. Inside a pipeline given to a cross-validator they
are fitted on the training folds only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.session import SMALL_ROWS, materialise, small_table
from fumarole.sources.dimensions import local_table


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.table = small_table(self.sparkSession.read.parquet(f"{path}/table"))
        return model


class _PlainWriter(MLWritable, MLReadable):
    def write(self):
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls):
        return DefaultParamsReader(cls)


class _TableModel(Model, MLWritable, MLReadable):
    table: DataFrame

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)


# --- group means -------------------------------------------------------------------------


def mean_column(group: str, target: str) -> str:
    return f"{group}_mean_log_{target.removesuffix('_emissions')}"


class _GroupMeanParams(Params):
    groupCol = Param(Params._dummy(), "groupCol", "grouping column", TypeConverters.toString)
    targets = Param(Params._dummy(), "targets", "target columns", TypeConverters.toListString)

    def _source(self, target: str, columns: Sequence[str]) -> str | None:
        """The log column of a target, else the target itself, else nothing."""
        return next((c for c in (f"log_{target}", target) if c in columns), None)

    def outputs(self, columns: Sequence[str]) -> list[str]:
        group = self.getOrDefault(self.groupCol)
        return [mean_column(group, t) for t in self.getOrDefault(self.targets) if self._source(t, columns)]


class GroupMean(Estimator, _GroupMeanParams, _PlainWriter):
    """Mean of each log target per group; fitted rows with a null group only count globally."""

    @keyword_only
    def __init__(self, *, groupCol: str = "sector", targets: list[str] | None = None):
        super().__init__()
        self._setDefault(groupCol="sector", targets=vocab.TARGETS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def sums(self, dataset: DataFrame, *by: str) -> DataFrame:
        """Sum and count of each log target per group (and other columns), all that a fit reads."""
        sources = {t: self._source(t, dataset.columns) for t in self.getOrDefault(self.targets)}
        cells = [
            cell
            for t, c in sources.items()
            if c is not None
            for cell in (F.sum(c).alias(f"sum_{t}"), F.count(c).alias(f"n_{t}"))
        ]
        return small_table(dataset.groupBy(self.getOrDefault(self.groupCol), *by).agg(*cells))

    def _fit(self, dataset: DataFrame) -> GroupMeanModel:
        return self.fit_sums(self.sums(dataset))

    def fit_sums(self, sums: DataFrame) -> GroupMeanModel:
        """The model from sums per group; the global mean comes from the same small table."""
        group = self.getOrDefault(self.groupCol)
        means = {mean_column(group, t): t for t in self.getOrDefault(self.targets) if f"sum_{t}" in sums.columns}
        total = sums.agg(
            *[
                F.try_divide(F.sum(f"sum_{t}"), F.sum(f"n_{t}")).alias(out)
                for out, t in means.items()
            ]
        ).first()
        model = GroupMeanModel(groupCol=group, targets=list(means.values()))
        model.overall = {out: total[out] for out in means}
        model.table = sums.select(
            F.col(group).cast("string").alias("group"),
            *[F.try_divide(F.col(f"sum_{t}"), F.col(f"n_{t}")).alias(out) for out, t in means.items()],
            *[F.lit(mean).cast("double").alias(f"global_{out}") for out, mean in model.overall.items()],
        )
        return model


class GroupMeanModel(_TableModel, _GroupMeanParams):
    @keyword_only
    def __init__(self, *, groupCol: str = "sector", targets: list[str] | None = None):
        super().__init__()
        self.overall: dict[str, float | None] | None = None
        self._setDefault(groupCol="sector", targets=vocab.TARGETS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def names(self) -> list[str]:
        group = self.getOrDefault(self.groupCol)
        return [mean_column(group, t) for t in self.getOrDefault(self.targets)]

    def global_means(self) -> dict[str, float | None]:
        if self.overall is None:
            row = self.table.select(*[f"global_{c}" for c in self.names()]).first()
            self.overall = {c: (row[f"global_{c}"] if row else None) for c in self.names()}
        return self.overall

    def _transform(self, dataset: DataFrame) -> DataFrame:
        group, outs = self.getOrDefault(self.groupCol), self.names()
        fallback = self.global_means()
        known = self.table.where("`group` is not null").select(
            F.col("group").alias("_group"), *[F.col(c).alias(f"_{c}") for c in outs]
        )
        joined = dataset.join(known, dataset[group].cast("string") == known["_group"], "left")
        kept = [c for c in dataset.columns if c not in outs]
        return joined.select(
            *[dataset[c] for c in kept],
            *[F.coalesce(F.col(f"_{c}"), F.lit(fallback[c])).alias(c) for c in outs],
        )


def out_of_fold_means(
    df: DataFrame, group: str, fold: str, targets: Sequence[str] = vocab.TARGETS
) -> DataFrame:
    """Group means where each row sees only the rows of the other folds.

    One grouped pass gives sums per group and fold; the mean outside a fold is a difference
    of totals. A group with no rows in other folds takes the other folds' global mean.
    """
    sources = [(t, f"log_{t}" if f"log_{t}" in df.columns else t) for t in targets]
    cells = df.groupBy(group, fold).agg(
        *[F.sum(c).alias(f"s_{t}") for t, c in sources],
        *[F.count(c).alias(f"n_{t}") for t, c in sources],
    )
    cells = small_table(cells)
    sums = [f"{k}_{t}" for t, _ in sources for k in ("s", "n")]
    folds = cells.groupBy(fold).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).collect()
    in_group = Window.partitionBy(group)

    def outside_group(t: str):
        def rest(c: str):
            return F.coalesce(F.sum(c).over(in_group), F.lit(0)) - F.coalesce(F.col(c), F.lit(0))

        n = rest(f"n_{t}")
        return F.when(F.col(group).isNotNull() & (n > 0), F.try_divide(rest(f"s_{t}"), n))

    def outside_fold(t: str):
        chain = F.lit(None).cast("double")
        for row in folds:
            others = [r for r in folds if r[fold] != row[fold]]
            n = sum(r[f"n_{t}"] for r in others)
            mean = sum(r[f"s_{t}"] for r in others) / n if n else None
            chain = F.when(F.col(fold) == row[fold], F.lit(mean).cast("double")).otherwise(chain)
        return chain

    outs = [mean_column(group, t) for t, _ in sources]
    table = cells.select(
        F.col(group).alias("_group"),
        F.col(fold).alias("_fold"),
        *[
            F.coalesce(outside_group(t), outside_fold(t)).alias(out)
            for (t, _), out in zip(sources, outs)
        ],
    )
    table = small_table(table)
    same = df[group].eqNullSafe(table["_group"]) & (df[fold] == table["_fold"])
    return df.join(table, same, "left").select(*[df[c] for c in df.columns if c not in outs], *outs)


# --- ordinal codes -----------------------------------------------------------------------


def ranked_values(df: DataFrame, column: str, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Distinct values (null as "Unknown") with their position in codepoint order, from 0.

    Up to ``max_rows`` values are numbered on the driver. Beyond that the values are range
    sorted and numbered per partition, and each partition adds the sizes of those before it.
    """
    values = df.select(_text(column).alias("value")).distinct()
    first = values.limit(max_rows + 1).toArrow()
    if first.num_rows > max_rows:
        placed = positions(materialise(values, "values"), "value")
        return placed.select("value", F.col("position").cast("int").alias("code"))
    return _numbered(df.sparkSession, first["value"].to_pylist())


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("Unknown"))


def _numbered(spark: SparkSession, values: Sequence[str]) -> DataFrame:
    if not values:
        return spark.createDataFrame([], "value string, code int")
    # Python sorts text by codepoint, as Spark does
    table = local_table(spark, enumerate(sorted(values)), ["code", "value"])
    return table.select("value", F.col("code").cast("int").alias("code"))


def fit_codes(
    df: DataFrame, columns: Sequence[str], max_rows: int = SMALL_ROWS
) -> list[OrdinalCodeModel]:
    """Ordinal codes of several columns, their values found in one pass.

    With more than ``max_rows`` values in all, each column is fitted on its own.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in columns])
    found = df.select(F.inline(cells)).distinct().limit(max_rows + 1).toArrow()
    if found.num_rows > max_rows:
        return [OrdinalCode(inputCol=c).fit(df) for c in columns]
    rows = found.to_pylist()
    models = [OrdinalCodeModel(inputCol=c) for c in columns]
    for model, column in zip(models, columns):
        values = [r["value"] for r in rows if r["column"] == column]
        model.table = _numbered(df.sparkSession, values)
    return models


def positions(values: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with their ``position`` (a long from 0) in an order: sorted partitions are numbered
    inside, and each adds the sizes of those before it."""
    placed = F.monotonically_increasing_id()  # partition number, then row number in 33 bits
    chunk = materialise(values.orderBy(*order).withColumn("_at", placed), "sorted")
    chunk = chunk.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = small_table(
        chunk.groupBy("_part").count().select(
            "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
        )
    )
    placed = chunk.join(sizes, "_part").withColumn("position", F.col("_start") + F.col("_row"))
    return placed.drop("_part", "_at", "_row", "_start")


class _OrdinalParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "text column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "code column", TypeConverters.toString)


class OrdinalCode(Estimator, _OrdinalParams, _PlainWriter):
    """Position of a value among the fitted values in codepoint order; unseen values get -1."""

    @keyword_only
    def __init__(self, *, inputCol: str = "sector", outputCol: str | None = None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol or f"{inputCol}_encoded")

    def _fit(self, dataset: DataFrame) -> OrdinalCodeModel:
        model = OrdinalCodeModel(
            inputCol=self.getOrDefault(self.inputCol), outputCol=self.getOrDefault(self.outputCol)
        )
        model.table = ranked_values(dataset, model.getOrDefault(model.inputCol))
        return model


class OrdinalCodeModel(_TableModel, _OrdinalParams):
    @keyword_only
    def __init__(self, *, inputCol: str = "sector", outputCol: str | None = None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol or f"{inputCol}_encoded")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source, out = self.getOrDefault(self.inputCol), self.getOrDefault(self.outputCol)
        table = self.table.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        text = F.coalesce(dataset[source].cast("string"), F.lit("Unknown"))
        joined = dataset.join(table, text == table["_value"], "left")
        kept = [dataset[c] for c in dataset.columns if c != out]
        return joined.select(*kept, F.coalesce(F.col("_code"), F.lit(-1)).alias(out))


def encode_all(df: DataFrame, columns: Sequence[str] = vocab.CATEGORICAL) -> DataFrame:
    for model in fit_codes(df, [c for c in columns if c in df.columns]):
        df = model.transform(df)
    return df
