"""Helper columns beside those of a user's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField


def quoted(name: str) -> str:
    """``name`` as a column reference, also where it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def orderable(field: StructField) -> Column:
    """The column, or its JSON text where its type has no order (maps and variants, nested ones too)."""
    column = F.col(quoted(field.name))
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column


def fresh(table: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``table`` has it (letter case aside)."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(table: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``table`` with the columns of these names, letter case aside, renamed, and how to rename them back.

    So are columns whose names hold dots or backticks, which functions over Arrow batches do not take.
    """
    back: dict[str, str] = {}
    for column in table.columns:
        if column.lower() in names or "." in column or "`" in column:
            other = fresh(table, "kept_" + column.replace(".", "_").replace("`", "_"))
            table = table.withColumnRenamed(column, other)
            back[other] = column
    return table, back
