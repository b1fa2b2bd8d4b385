"""Categories as columns: a kept dictionary of column names.

A category value may be any text: with dots or backticks, or the same as
another but for case, which as column names Spark could not resolve or
would take for one. So the wide form is built from a dictionary (feature,
value, name): the name is ``<feature>_<value>`` where that has only letters,
digits, spaces, ``_`` and ``-`` and no other column has it, case aside;
else other characters become ``_`` and eight digits of the value's hash
follow. A dictionary is made once, kept with the features, and extended: a
name that it has never changes, so the columns of later runs line up with
those of earlier ones.

Values become column names, so they are on the driver whatever is done
(one small job reads them); the dictionary has one entry per column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "feature string, value string, name string"


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _plain(value: str) -> bool:
    return value != "" and value == value.strip() and all(c.isalnum() or c in "_- " for c in value)


def column_name(feature: str, value: str, taken: set[str]) -> str:
    """A name for ``value`` that no entry of ``taken`` (lower case) equals."""
    name = f"{feature}_{value}"
    if _plain(value) and name.lower() not in taken:
        return name
    digest = hashlib.md5(value.encode()).hexdigest()
    name = f"{feature}_" + "".join(c if c.isalnum() or c in "_- " else "_" for c in value)
    return next(n for n in (f"{name}_{digest[:k]}" for k in range(8, 33)) if n.lower() not in taken)


@dataclass(frozen=True)
class Categories:
    """The dictionary: (feature, value) -> name."""

    names: dict[tuple[str, str], str] = field(default_factory=dict)

    def extended(self, domains: dict[str, Iterable[str]], reserved: Iterable[str] = ()) -> Categories:
        """With names for the values of ``domains`` that have none yet, in
        the order of features and values; none is one of ``reserved``."""
        names = dict(self.names)
        taken = {n.lower() for n in (*names.values(), *reserved)}
        for feature in sorted(domains):
            for value in sorted(set(map(str, domains[feature]))):
                if (feature, value) not in names:
                    names[feature, value] = name = column_name(feature, value, taken)
                    taken.add(name.lower())
        return Categories(names)

    def of(self, feature: str) -> dict[str, str]:
        """value -> name of one feature, by value."""
        return {v: n for (f, v), n in sorted(self.names.items()) if f == feature}

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per entry."""
        return spark.createDataFrame([(f, v, n) for (f, v), n in sorted(self.names.items())], SCHEMA)

    @staticmethod
    def read(table: DataFrame) -> Categories:
        """A kept dictionary: one row per column of the wide form."""
        return Categories({(r["feature"], r["value"]): r["name"] for r in table.collect()})
