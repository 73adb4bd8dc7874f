"""Extracted tables as chunks: the table as JSON, and a sentence for each row. JVM only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import is_blank, strip


def _cell(c: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(c, "\n", " ")), F.lit(""))


def is_table(data: Column) -> Column:
    """Not empty, and more than a single small header."""
    filled = F.filter(F.try_element_at(data, F.lit(1)), lambda c: c.isNotNull() & ~is_blank(c))
    return (F.size(data) > 0) & ~((F.size(filled) < 2) & (F.size(data) < 2))


def chunks(docs: DataFrame) -> DataFrame:
    """``(file_id, table_no, row_no, parent, child)`` of ``(file_id, tables)``.

    ``table_no`` counts skipped tables too. Cells beyond the header get a numbered name in
    the JSON and are left out of the sentences; so are cells without a name or value.
    """
    t = docs.select("file_id", F.posexplode("tables").alias("table_no", "_t")).select("file_id", "table_no", F.col("_t.data").alias("data")).where(
        F.col("data").isNotNull() & (F.size("data") > 0))
    t = t.where(is_table(F.col("data")))
    t = t.withColumn("_h", F.transform(F.try_element_at("data", F.lit(1)), _cell)).withColumn("_b", F.slice("data", 2, F.greatest(F.size("data") - 1, F.lit(0))))
    # to_json keeps the first place and the last value of a name that occurs twice
    named = F.transform("_b", lambda row: F.transform(row, lambda c, j: F.struct(
        F.when(j < F.size("_h"), F.get("_h", j)).otherwise(F.concat(F.lit("column_"), (j + 1).cast("string"))).alias("n"), _cell(c).alias("v"))))
    t = t.withColumn("_n", F.transform(named, lambda row: F.filter(row, lambda x: x["n"] != "")))

    def as_object(row: Column) -> Column:
        keys = F.array_distinct(F.transform(row, lambda x: x["n"]))
        return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(row, lambda x: x["n"] == k), F.lit(-1))["v"])))

    parent = F.concat(F.lit("["), F.array_join(F.transform(F.filter("_n", lambda r: F.size(r) > 0), as_object), ","), F.lit("]"))
    t = t.withColumn("parent", parent)
    # fixed values: the words of a row's sentence
    rows = t.select("file_id", "table_no", "parent", "_h", F.posexplode("_b").alias("row_no", "_r"))
    clause = F.filter(F.transform("_r", lambda c, j: F.struct(F.when(j < F.size("_h"), F.get("_h", j)).otherwise(F.lit("")).alias("n"), _cell(c).alias("v"))),
                      lambda x: (x["n"] != "") & (x["v"] != ""))
    rows = rows.withColumn("_c", clause).where(F.size("_c") > 0)
    said = F.array_join(F.transform("_c", lambda x: F.concat(F.lit("wartość dla '"), x["n"], F.lit("' to '"), x["v"], F.lit("'"))), "; ")
    return rows.select("file_id", "table_no", "row_no", "parent", F.concat(F.lit("W tej tabeli wiersz zawiera następujące dane: "), said, F.lit(".")).alias("child"))
