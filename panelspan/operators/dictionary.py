"""Which of many patterns does a value contain, with the patterns in a table.

A literal per pattern in the plan stops at a few hundred.  Here a pattern is
indexed by one of its grams, the one found in fewest values; a value offers
each of its grams once; where both meet, the pattern is looked for in the
value itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters; none if the text is shorter."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(size))))


def contained(values: DataFrame, value: str, patterns: DataFrame, pattern: str, gram: int = GRAM) -> DataFrame:
    """(value, pattern): each distinct value with each distinct pattern that it contains as it stands.

    Patterns shorter than ``gram`` are indexed whole.  A pattern goes to one
    gram only, so a frequent gram meets the patterns that have no rarer one.
    Missing and empty values or patterns have no match.
    """
    have = values.select(F.col(value).alias("value")).where("value <> ''").distinct()
    want = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    offered = have.select("value", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("value"), k) for k in range(1, gram + 1)])))).alias("gram"))
    frequency = offered.groupBy("gram").agg(F.count("*").alias("values"))
    size = F.least(F.length("pattern"), F.lit(gram))
    own = F.when(size == gram, _grams(F.col("pattern"), gram)).otherwise(F.array("pattern"))
    # a gram that no value has rules its pattern out
    choice = want.select("pattern", F.explode(own).alias("gram")).join(frequency, "gram", "left").groupBy("pattern").agg(
        F.min(F.struct(F.coalesce("values", F.lit(0)).alias("values"), "gram")).alias("rarest"))
    index = choice.where("rarest.values > 0").select("pattern", F.col("rarest.gram").alias("gram"))
    return offered.join(index, "gram").where(F.contains("value", "pattern")).select("value", "pattern")
