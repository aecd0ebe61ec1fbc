"""Cross-validation of ``pyspark.ml`` estimators over temporal folds."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.splitters import TemporalSplit
from chronofold.scratch import Scratch

ParamMap = Mapping[Param, object]


def cross_validate(estimator: Estimator, evaluator: Evaluator, splitter: TemporalSplit, df: DataFrame, time: str, entity: str | None = None, parallelism: int = 4) -> list[float]:
    """The evaluator's metric on the test rows of each fold, in fold order; folds are fitted side by side."""

    def score(pair: tuple[DataFrame, DataFrame]) -> float:
        train, test = pair
        return float(evaluator.evaluate(estimator.fit(train).transform(test)))

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(score, splitter.split(df, time, entity)))


class TemporalSearch(Estimator):
    """Chooses among param maps by the mean of the evaluator's metric over temporal folds, and fits the best on all rows.

    The rows of all folds are written once to the shared folder, a directory a fold and role, so a fit reads its fold alone. Folds and maps are fitted side by
    side, ``parallelism`` at a time. Of maps with equal means the first wins.
    """

    def __init__(self, estimator: Estimator, maps: Sequence[ParamMap], evaluator: Evaluator, splitter: TemporalSplit, time: str, entity: str | None = None, parallelism: int = 4) -> None:
        super().__init__()
        if not maps:
            raise ValueError("no param maps")
        self.estimator, self.maps, self.evaluator, self.splitter = estimator, list(maps), evaluator, splitter
        self.time, self.entity, self.parallelism = time, entity, parallelism

    def _fit(self, dataset: DataFrame) -> TemporalSearchModel:
        source = self.splitter.source(dataset, self.time, self.entity)
        folds = self.splitter.get_n_splits(source) if not hasattr(self.splitter, "each") else self.splitter.bounds(source).agg(F.max("fold_id")).first()[0] + 1
        rows = Scratch(dataset.sparkSession).save(self.splitter.assign_rows(source), "folds", by=("fold_id", "role"))
        side = lambda i, role: rows.where((F.col("fold_id") == i) & (F.col("role") == role)).drop("fold_id", "role")

        def score(task: tuple[int, int]) -> float:
            m, i = task
            fitted = self.estimator.fit(side(i, "train"), self.maps[m])
            return float(self.evaluator.evaluate(fitted.transform(side(i, "test"), self.maps[m])))

        tasks = [(m, i) for m in range(len(self.maps)) for i in range(folds)]
        with ThreadPoolExecutor(self.parallelism) as pool:
            scores = dict(zip(tasks, pool.map(score, tasks), strict=True))
        metrics = [[scores[m, i] for i in range(folds)] for m in range(len(self.maps))]
        means = [sum(x) / len(x) for x in metrics]
        best = (max if self.evaluator.isLargerBetter() else min)(range(len(means)), key=means.__getitem__)
        return TemporalSearchModel(self.estimator.fit(dataset, self.maps[best]), best, metrics, [{p.name: v for p, v in m.items()} for m in self.maps])


class TemporalSearchModel(Model):
    """``best_model``, the number of its map, ``metrics`` (a list of fold metrics a map) and the maps by name. Saved as the model and one row of JSON."""

    def __init__(self, best_model: Model, best: int, metrics: list[list[float]], maps: list[dict[str, object]]) -> None:
        super().__init__()
        self.best_model, self.best, self.metrics, self.maps = best_model, best, metrics, maps

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.best_model.transform(dataset)

    def by_fold(self, spark: SparkSession) -> DataFrame:
        """map, fold_id, metric."""
        return spark.createDataFrame([(m, i, v) for m, row in enumerate(self.metrics) for i, v in enumerate(row)], "map int, fold_id int, metric double")

    def save(self, path: str) -> None:
        self.best_model.save(f"{path}/best")
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps({"best": self.best, "metrics": self.metrics, "maps": self.maps}),)], "value string").coalesce(1).write.text(f"{path}/search")

    @classmethod
    def load(cls, path: str) -> TemporalSearchModel:
        spark = SparkSession.active()
        held = json.loads(spark.read.text(f"{path}/search").first()["value"])
        return cls(DefaultParamsReader.loadParamsInstance(f"{path}/best", spark), held["best"], held["metrics"], held["maps"])
