"""MLlib's regression trees over packed rows: ``Trees.java`` beside this file says what
differs. It is compiled once an application by the Janino that Spark brings along for its
own generated code, and reaches executors like any jar."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark import StorageLevel
from pyspark.ml import regression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of sums that a task holds at most; more open nodes take further passes.
SUMS = 64 << 20

#: By application id: the compiled class's only object.
_COMPILED: dict[str, object] = {}
_LOCK = threading.Lock()


def _trees(spark: SparkSession):
    """The object of ``Trees.java``, whose classes are known to driver and executors."""
    context = spark.sparkContext
    with _LOCK:
        if context.applicationId not in _COMPILED:
            jvm = context._jvm
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
            compiler.setParentClassLoader(loader)
            with open(os.path.join(os.path.dirname(__file__), "Trees.java"), encoding="utf-8") as source:
                compiler.cook(source.read())
            classes = compiler.getBytecodes()
            path = os.path.join(tempfile.mkdtemp(prefix="firnline-trees-"), "firnline-trees.jar")
            with zipfile.ZipFile(path, "w") as jar:
                for name in classes:
                    jar.writestr(f"{name.replace('.', '/')}.class", bytes(classes[name]))
            context._jsc.addJar(path)
            urls = context._gateway.new_array(jvm.java.net.URL, 1)
            urls[0] = jvm.java.io.File(path).toURI().toURL()
            found = jvm.java.net.URLClassLoader(urls, loader).loadClass("firnline.Trees")
            _COMPILED[context.applicationId] = found.getDeclaredConstructor(None).newInstance(None)
        return _COMPILED[context.applicationId]


class Points:
    """A learner's rows as the blocks that trees are grown on. ``cells`` holds an array of
    numbers, named by ``columns`` (by the features where that is left out), and the label.
    A feature is a column; with ``fills`` by column, ``{column}_filled`` is the column with
    its fill value and ``{column}_missing`` the flag that it is missing. Split candidates
    depend on rows and seed only, so learners with one seed, and learners on some of the
    features, share one packed copy."""

    def __init__(self, cells: DataFrame, features: list[str], columns: list[str] | None = None, fills: dict[str, float] | None = None):
        self.spark, self.features = cells.sparkSession, features
        self.trees = _trees(self.spark)
        self.n = cells.count()
        if not self.n:
            raise ValueError("there are no rows to learn from")
        read, places, kinds, values = columns or features, [], [], []
        for name in features:
            column, _, made = name.rpartition("_")
            kind = {"filled": 1, "missing": 2}.get(made, 0) if column in (fills or {}) else 0
            places.append(read.index(column if kind else name))
            kinds.append(kind)
            values.append(float(fills[column]) if kind == 1 else 0.0)
        jvm = self.spark._jvm
        numbers = self._array(jvm.int, places), self._array(jvm.int, kinds), self._array(jvm.double, values)
        self.raw = self.trees.raw(cells._jdf.queryExecution().toRdd().toJavaRDD(), *numbers)
        self._packed: dict[tuple, tuple] = {}
        self._keeps_raw = False
        self._lock = threading.Lock()

    def packed(self, max_bins: int, seed: int) -> tuple:
        """Blocks of bins, and the split candidates they stand for."""
        with self._lock:
            if (max_bins, seed) not in self._packed:
                thresholds = self.trees.thresholds(self.raw, None, len(self.features), self.n, max_bins, seed)
                self._packed[max_bins, seed] = kept(self.spark, self.trees.pack(self.raw, None, thresholds)), thresholds
            return self._packed[max_bins, seed]

    def columns(self, features: list[str]):
        """Places of some features, for the JVM."""
        return self._array(self.spark._jvm.int, [self.features.index(name) for name in features])

    def _array(self, kind, numbers: list):
        made = self.spark.sparkContext._gateway.new_array(kind, len(numbers))
        for i, number in enumerate(numbers):
            made[i] = number
        return made

    def keep(self) -> None:
        """Keeps the numbers themselves, for learners that pass over them every round."""
        if not self._keeps_raw:
            self._keeps_raw = True
            kept(self.spark, self.raw)

    def release(self) -> None:
        for blocks, _ in self._packed.values():
            blocks.unpersist()
        self._packed.clear()
        if self._keeps_raw:
            self._keeps_raw = False
            self.raw.unpersist()


def kept(spark: SparkSession, rdd):
    return rdd.persist(spark.sparkContext._getJavaStorageLevel(StorageLevel.MEMORY_AND_DISK))


def cells(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Rows as ``Points`` reads them."""
    return rows.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("cells"), F.col(f"`{label}`").cast("double").alias("label"))


def _grow(points: Points, packed, drawn, thresholds, features, rows: int, trees: int, learner):
    return points.trees.grow(
        packed, drawn, thresholds, points.columns(features), rows, trees, learner.getMaxBins(), learner.getMaxDepth(), learner.getMinInstancesPerNode(),
        float(learner.getMinWeightFractionPerNode()), float(learner.getMinInfoGain()), SUMS, learner.uid,
    )


class RandomForestRegressor(regression.RandomForestRegressor):
    """MLlib's forest with all features at every node, fitted on ``Points``; ``features``
    are those of them to learn from."""

    features: list[str]

    def fit_points(self, points: Points) -> regression.RandomForestRegressionModel:
        if self.getFeatureSubsetStrategy() not in ("all", "1.0"):
            raise ValueError("every node chooses among all features here")
        features, trees = getattr(self, "features", points.features), self.getNumTrees()
        packed, thresholds = points.packed(self.getMaxBins(), self.getSeed())
        drawn = None
        if self.getBootstrap() or self.getSubsamplingRate() < 1:
            drawn = kept(points.spark, points.trees.bag(packed, trees, float(self.getSubsamplingRate()), self.getBootstrap(), self.getSeed()))
        try:
            grown = _grow(points, packed, drawn, thresholds, features, points.n, trees, self)
        finally:
            if drawn is not None:
                drawn.unpersist()
        model = points.spark._jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(self.uid, grown, len(features))
        return self._copyValues(regression.RandomForestRegressionModel(model))


class DecisionTreeRegressor(regression.DecisionTreeRegressor):
    """MLlib's tree for the residuals of a boosting round, fitted on the ``points`` that
    all rounds share."""

    points: Points

    def _fit(self, rows: DataFrame) -> regression.DecisionTreeRegressionModel:
        points, residuals = self.points, rows._jdf.queryExecution().toRdd().toJavaRDD()
        n = int(points.trees.squares(residuals)[0])
        thresholds = points.trees.thresholds(points.raw, residuals, len(points.features), n, self.getMaxBins(), self.getSeed())
        packed = kept(points.spark, points.trees.pack(points.raw, residuals, thresholds))
        try:
            grown = _grow(points, packed, None, thresholds, points.features, n, 1, self)
        finally:
            packed.unpersist()
        return self._copyValues(regression.DecisionTreeRegressionModel(grown[0]))


class Margins:
    """Predictions so far of a booster's rows, kept beside them: a round adds its tree to
    those of the round before."""

    def __init__(self, points: Points):
        points.keep()
        self.points, self.now, self._before = points, None, None

    def add(self, tree: regression.DecisionTreeRegressionModel, weight: float, store: bool) -> None:
        """One more tree; ``store`` writes the sums to the checkpoint folder."""
        if self._before is not None:
            self._before.unpersist()  # the sums that were made out of it have been read by now
        points = self.points
        self._before, self.now = self.now, kept(points.spark, points.trees.margins(points.raw, self.now, len(points.features), weight, tree._java_obj))
        if store:
            self.now.checkpoint()

    def residuals(self, rate: float, seed: int) -> DataFrame:
        """Label less prediction so far, a row per block; rows that the round does not draw have none."""
        session, schema = self.points.spark._jsparkSession, StructType([StructField("residuals", BinaryType())])
        rows = self._residuals(rate, seed)
        return DataFrame(session.createDataFrame(rows, session.parseDataType(schema.json())), self.points.spark)

    def mean_square(self) -> float:
        """Mean squared residual."""
        n, total = self.points.trees.squares(self._residuals(1.0, 0))
        return total / n

    def _residuals(self, rate: float, seed: int):
        return self.points.trees.residuals(self.points.raw, self.now, float(rate), seed)

    def release(self) -> None:
        for sums in (self._before, self.now):
            if sums is not None:
                sums.unpersist()
