"""A caller's columns under numbers, so that no name of theirs can meet one of an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Held:
    """The rows of a frame with its columns named c0, c1, …, and the names to give back."""

    def __init__(self, df: DataFrame, **roles: str) -> None:
        self.names = df.columns
        self.columns = [f"c{i}" for i in range(len(self.names))]
        self.rows = df.toDF(*self.columns)
        self.of = {role: self.columns[self.names.index(name)] for role, name in roles.items()}

    def __getitem__(self, role: str) -> str:
        return self.of[role]

    def fields(self, *results: T.StructField) -> T.StructType:
        """Schema of the rows with further columns."""
        return T.StructType([*self.rows.schema.fields, *results])

    def given(self, out: DataFrame, *results: str) -> DataFrame:
        """out under the caller's names with results, which replace columns of the same name."""
        added = {r.lower() for r in results}
        own = [F.col(c).alias(n) for c, n in zip(self.columns, self.names, strict=True) if n.lower() not in added]
        return out.select(*own, *results)
