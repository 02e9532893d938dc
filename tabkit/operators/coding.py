"""One-hot vectors from a dictionary table: labels are numbered over ranges and joined, never listed in a plan."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tabkit.operators.ranks import rank_rows
from tabkit.operators.stages import _Columns, _TableModel
from tabkit.session import written

_CELL = StructType([StructField("v", VectorUDT())])


def unit_vector(place: Column, size: int) -> Column:
    """Sparse vector of `size` slots with a one at `place`; without a place all are zero. An expression of the JVM."""
    head = f'{{"v":{{"type":0,"size":{size},"indices":['
    one = F.concat(F.lit(head), place.cast("string"), F.lit('],"values":[1.0]}}'))
    return F.from_json(F.coalesce(one, F.lit(head + '],"values":[]}}')), _CELL)["v"]


class CategoryCoder(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """One 0/1 slot for each label of the training rows, in the order of the labels' bytes.

    Labels not seen in training, and missing ones, are all zeros; an empty text is a label, without a name. The dictionary is counted and numbered by Spark: no
    task or driver holds all labels, and a label in most rows is counted before the shuffle.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CategoryCoderModel:
        columns = self.getInputCols()
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
        labels = df.select(F.inline(cells)).where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("__n"))
        ranked = written(rank_rows(written(labels, "labels"), "c", "v", "place"), "dictionary")
        spans = ranked.groupBy("c").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))  # a row per column
        sizes = {r["c"]: r["size"] for r in spans.collect()}
        numbered = ranked.join(F.broadcast(spans), "c").select("c", "v", "__n", (F.col("place") - F.col("first")).alias("place"))
        model = CategoryCoderModel()._set(
            inputCols=columns, outputCols=self._outputs(), sizes=[sizes.get(c, 0) for c in columns]
        )
        return model._hold(numbered)


class CategoryCoderModel(_TableModel, _Columns):
    """`table`: column c, label v, its slot `place`, and __n, the training rows that held it."""

    sizes = Param(Params._dummy(), "sizes", "number of labels of each column", TypeConverters.toListInt)

    def slot_names(self, column: str) -> list[str] | None:
        """Labels by slot, for the metadata of vectors; None if the dictionary is too large for metadata."""
        if not self.small:
            return None
        if not hasattr(self, "_names"):
            self._names: dict[str, list[str]] = {}
            for r in sorted(self.table.collect(), key=lambda r: r["place"]):  # proven small
                self._names.setdefault(r["c"], []).append(r["v"])
        return self._names.get(column, [])

    def _transform(self, df: DataFrame) -> DataFrame:
        for c, o, size in zip(self.getInputCols(), self._outputs(), self.getOrDefault("sizes")):
            names = [n for n in df.columns if n != o]
            own = self.table.where(F.col("c") == c).select(F.col("v").alias("__key"), F.col("place").alias("__place"), "__n")
            if self.small:  # a vector per label, not per row
                own = own.withColumn("__vector", unit_vector(F.col("__place"), size))
            joined = self._look_up(df.withColumn("__key", F.col(f"`{c}`").cast("string")), "__key", own)
            about: dict = {"num_attrs": size}
            labels = self.slot_names(c)
            if labels:
                about["attrs"] = {"binary": [{"idx": i, "name": v} if v else {"idx": i} for i, v in enumerate(labels)]}
            coded = F.coalesce("__vector", unit_vector(F.lit(None), size)) if self.small else unit_vector(F.col("__place"), size)
            coded = coded.alias(o, metadata={"ml_attr": about})
            df = joined.select(*[F.col(f"`{n}`") for n in names], coded)
        return df
