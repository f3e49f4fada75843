"""A table with the three readings of a column: raw text, number and moment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import coerce
from gleaner.model import ColumnProfile, SemanticModel


@dataclass
class Dataset:
    """``kinds`` holds a logical type for columns that are text so far; columns
    with a Spark type of their own are read natively, so that filters and column
    pruning reach the scan."""

    name: str
    df: DataFrame
    kinds: dict[str, str] = field(default_factory=dict)
    day_first: dict[str, bool] = field(default_factory=dict)
    model: SemanticModel = field(default_factory=SemanticModel)
    profiles: list[ColumnProfile] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    rows: int | None = None
    source: str = "table"

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def _col(self, name: str) -> Column:
        return self.df["`" + name.replace("`", "``") + "`"]

    def _type(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def is_text(self, name: str) -> bool:
        return isinstance(self._type(name), T.StringType)

    def raw(self, name: str) -> Column:
        """As text, null if missing."""
        return self._col(name) if self.is_text(name) else self._col(name).cast("string")

    def native(self, name: str) -> Column:
        return self._col(name)

    def kind(self, name: str) -> str:
        if name in self.kinds:
            return self.kinds[name]
        t = self._type(name)
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return "datetime"
        if isinstance(t, T.DateType):
            return "date"
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "integer"
        if isinstance(t, T.NumericType):
            return "number"
        return "category"

    def number(self, name: str) -> Column:
        """As double; a NaN is missing. Invalid booleans that are not missing count as 0."""
        if self.kind(name) == "boolean":
            flag = coerce.boolean_of(self.raw(name)) if self.is_text(name) else self._col(name).cast("boolean")
            return F.when(self._col(name).isNotNull(), F.coalesce(flag, F.lit(False)).cast("double"))
        if self.is_text(name):
            return coerce.number_of(self.raw(name))
        t = self._type(name)
        value = self._col(name).cast("double")
        return F.when(~F.isnan(value), value) if isinstance(t, (T.DoubleType, T.FloatType)) else value

    def moment(self, name: str) -> Column:
        """As timestamp in UTC."""
        if self.is_text(name):
            return coerce.date_of(self.raw(name), self.day_first.get(name, False))
        return self._col(name).cast("timestamp")

    def count(self) -> int:
        if self.rows is None:
            self.rows = self.df.count()
        return self.rows

    def typed(self) -> DataFrame:
        """A frame with native types: for Parquet, and to read text only once."""
        out = []
        for c in self.columns:
            k = self.kind(c)
            value = self.number(c) if k in ("number", "integer") else coerce.boolean_of(self.raw(c)) if k == "boolean" and self.is_text(c) else self.moment(c) if k in ("date", "datetime") else self._col(c)
            out.append(value.alias(c))
        return self.df.select(*out)

    def materialised(self, path: str | None = None) -> Dataset:
        """The dataset over typed columns, written to ``path`` or kept in memory
        and on disk, so that later passes do not parse text again."""
        typed = self.typed()
        if path:
            typed.write.mode("overwrite").parquet(path)
            typed = self.df.sparkSession.read.parquet(path)
        else:
            typed = typed.persist()
        kinds = {c: self.kind(c) for c in self.columns}
        return Dataset(self.name, typed, kinds, {}, self.model, self.profiles, self.warnings, self.rows, self.source)
