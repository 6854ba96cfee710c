"""Conversations: which are shown, and what their answers cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(collections: Column, chosen: Column) -> Column:
    """Whether a conversation of some collections is shown with a choice of them: it is of none, or of one that is chosen."""
    return (F.coalesce(F.size(collections), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap(collections, chosen), F.lit(False))


def citation_links(answers: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, known, ...) for each [n] or [[n]] in answers (keys, text), with the columns of the source of that rank of the same answer, from sources (keys, rank, ...)."""
    n = F.explode(F.regexp_extract_all("text", F.lit(r"\[+([0-9]+)\]+"), F.lit(1)).cast("array<bigint>"))
    cited = answers.select(*keys, n.alias("n"))
    s = sources.withColumn("known", F.lit(True))
    return cited.join(s.withColumnRenamed("rank", "n"), [*keys, "n"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
