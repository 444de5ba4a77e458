"""Completion tables: the first k items of every prefix, made once, changed where items change, and read by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.operators.windows import page


def prefixes_of(items: DataFrame, key: str = "key") -> DataFrame:
    """A row for each item and each prefix of its key, the key itself included; null and empty keys have none."""
    cuts = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda n: n <= F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))
    return items.withColumn("prefix", F.explode(cuts))


def completion_table(items: DataFrame, by: list[str], order: list[Column], k: int = 15, key: str = "key") -> DataFrame:
    """Columns of items, prefix and rank: of each `by` and prefix the first k items in order.

    Each task keeps k rows a prefix before they are shuffled, so a prefix that a third of all items has is k rows a task.
    """
    return page(prefixes_of(items, key), [*by, "prefix"], order, k)


def update_completions(table: DataFrame, changed: DataFrame, items: DataFrame, by: list[str], order: list[Column], k: int = 15, key: str = "key") -> DataFrame:
    """The table after changes, which equals a new one: only prefixes of changed rows (by, key: new, gone or different) are made again.

    items are those after the change; of these only rows with such a prefix are shuffled.
    """
    lists = [*by, "prefix"]
    touched = prefixes_of(changed.select(*by, key).distinct(), key).select(*lists).distinct()
    again = page(prefixes_of(items, key).join(touched, lists, "left_semi"), lists, order, k)
    return table.join(touched, lists, "left_anti").unionByName(again.select(*table.columns))


def complete(requests: DataFrame, table: DataFrame, on: dict[str, str], k: int | Column = 15) -> DataFrame:
    """Requests (query, and columns that `on` pairs with the table's) with the items of their prefix, in the table's order."""
    rows = table
    for mine, theirs in on.items():
        rows = rows.withColumnRenamed(theirs, mine)
    return requests.join(rows.withColumnRenamed("prefix", "query"), ["query", *on]).filter(F.col("rank") <= k)
