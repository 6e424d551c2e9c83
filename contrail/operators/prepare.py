"""Preprocessing stages of the churn model (M3-M5) as Spark ML estimators.

Each learns a few numbers or words per column from aggregates over the training
side and keeps them as parameters of its model, so a fitted ``Pipeline`` is
saved and loaded with them:

* ``MedianImputer``: the exact median (not an approximate quantile);
* ``PopulationScaler``: mean and *population* standard deviation;
* ``ModeImputer``: the most frequent word, of equally frequent ones the smallest.

All transforms are built-in expressions.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import quantile_values


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Maps each of ``inputCols`` to the one of ``outputCols`` at its place."""

    def __init__(self, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols, outputCols=outputCols or inputCols)

    def pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getInputCols(), self.getOutputCols(), strict=True))

    def _like(self, model: _Columns) -> _Columns:
        return model._set(inputCols=self.getInputCols(), outputCols=self.getOutputCols())


def _number(name: str):
    """A column as a double, null where it is not a number."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


class MedianImputerModel(Model, _Columns):
    medians = Param(Params._dummy(), "medians", "median of each column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({out: F.coalesce(_number(c), F.lit(m))
                               for (c, out), m in zip(self.pairs(), self.getOrDefault(self.medians), strict=True)})


class MedianImputer(Estimator, _Columns):
    """Fills nulls and NaN with the column's exact median (a column without any value with 0)."""

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        found = quantile_values(df.select(*[_number(c).alias(c) for c in self.getInputCols()]), {c: [0.5] for c in self.getInputCols()})
        return self._like(MedianImputerModel())._set(medians=[0.0 if found[c][0] is None else float(found[c][0]) for c in self.getInputCols()])


class PopulationScalerModel(Model, _Columns):
    means = Param(Params._dummy(), "means", "mean of each column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population standard deviation of each column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        learnt = zip(self.pairs(), self.getOrDefault(self.means), self.getOrDefault(self.deviations), strict=True)
        return df.withColumns({out: (F.col(c).cast("double") - F.lit(mean)) / F.lit(sd or 1.0) for (c, out), mean, sd in learnt})


class PopulationScaler(Estimator, _Columns):
    """Mean 0 and population deviation 1; a column that does not vary becomes 0."""

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        # one row
        r = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return self._like(PopulationScalerModel())._set(means=[float(r[f"m{i}"] or 0.0) for i in range(len(cols))],
                                                        deviations=[float(r[f"s{i}"] or 0.0) for i in range(len(cols))])


class ModeImputerModel(Model, _Columns):
    modes = Param(Params._dummy(), "modes", "most frequent word of each column", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({out: F.coalesce(F.col(c), F.lit(m)) for (c, out), m in zip(self.pairs(), self.getOrDefault(self.modes), strict=True)})


class ModeImputer(Estimator, _Columns):
    """Fills nulls with the most frequent word (a column without any with "missing")."""

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.getInputCols()
        long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value").where("value IS NOT NULL")
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        # a row per column
        best = {r["column"]: r["v"] for r in counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("v")).collect()}
        return self._like(ModeImputerModel())._set(modes=[best.get(c, "missing") for c in cols])
