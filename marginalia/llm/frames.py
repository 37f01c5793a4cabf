"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

#: A word, as every contract here defines it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has more rows than HOT_ROWS and than HOT_SHARE of all rows; there are at most 1 / HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 1000, 1e-4


def column(name: str) -> Column:
    """The top-level column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack(df: DataFrame, name: str = "row") -> DataFrame:
    """One struct column with all of ``df``'s columns, so that no name can clash with the operator's own."""
    return df.select(F.struct(*map(column, df.columns)).alias(name))


def unpack(df: DataFrame, columns: list[str], added: dict[str, Column], name: str = "row") -> DataFrame:
    """The packed columns again, and ``added``; an added name replaces an input column of that name."""
    kept = [F.col(name)[c].alias(c) for c in columns if c not in added]
    return df.select(*kept, *[v.alias(k) for k, v in added.items()])


def numbered(columns: list[str]) -> list[Column]:
    """The columns as c0, c1, ...: names that no operator uses for its own."""
    return [column(c).alias(f"c{i}") for i, c in enumerate(columns)]


def schema_of(df: DataFrame, columns: list[str], added: str = "") -> StructType:
    """The fields of ``columns`` by their own names, and those of the DDL string ``added``."""
    by_name = {f.name: f for f in df.schema.fields}
    fields = [by_name[c] for c in columns] + (StructType.fromDDL(added).fields if added else [])
    return StructType([StructField(f.name, f.dataType, True) for f in fields])


def word_count(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_counted(rows: DataFrame, by_key: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row for each key and, as ``n``, the number of the key's rows; ``total`` is their sum or more.

    Rows of hot keys stay where they are: at most 1 / HOT_SHARE keys can be
    hot, so these are broadcast. All others are joined by sort and merge, and
    none of their keys is large.
    """
    most = max(HOT_ROWS, int(total * HOT_SHARE))
    hot, cold = F.broadcast(by_key.where(F.col("n") > most)), by_key.where(F.col("n") <= most)
    others = rows.join(F.broadcast(by_key.where(F.col("n") > most).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys, how).unionByName(others.join(cold.hint("merge"), keys, how))
