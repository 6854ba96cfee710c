"""Questions that a map of themes asks: by depth, by angle, and for finer topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Angle: question, with {} for the topic.
ANGLES = {
    "overview": "Set out, in order, what the library says about {}.",
    "ideas": "Name the chief ideas about {}, with a line on each.",
    "compare": "Where do the sources differ on {}, and how?",
    "open": "What remains unsettled or disputed about {}?",
    "critique": "Which weaknesses and limits of {} do the sources point out?",
}


def trail(path: Column) -> Column:
    return F.array_join(path, " › ")


def level_question(path: Column) -> Column:
    """A question for a path of topics, the narrower the deeper it goes."""
    leaf = F.try_element_at(path, F.size(path))
    above = trail(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))))
    broad = F.concat(F.lit("Sum up "), F.coalesce(F.nullif(trail(path), F.lit("")), F.lit("the library")), F.lit(" as the library has it."))
    middle = F.concat(F.lit('Explain "'), leaf, F.lit('" as a part of '), F.try_element_at(path, F.lit(1)), F.lit(": its ideas, and what ties them together."))
    deep = F.concat(F.lit('Go into "'), leaf, F.lit('" under '), above, F.lit(": how it works, what it costs, and the details."))
    return F.when(F.size(path) <= 1, broad).when(F.size(path) == 2, middle).otherwise(deep)


def deepen_prompt(path: Column) -> Column:
    """Asks a model for four to six finer topics as a JSON array of name and blurb; null for an empty path."""
    leaf = F.try_element_at(path, F.size(path))
    asked = F.concat(F.lit("In a library, take this path of topics: "), trail(path), F.lit('. Split "'), leaf, F.lit('" into four to six narrower topics, none of them named like it, each with one sentence.\nAnswer with JSON alone: [{"name": "...", "blurb": "..."}]'))
    return F.when(F.size(path) > 0, asked)


def angles(topics: DataFrame) -> DataFrame:
    """(topic, angle, question) for each topic."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("angle"), F.replace(F.lit(q), F.lit("{}"), F.col("topic")).alias("question")) for k, q in ANGLES.items()]))
    return topics.select("topic", each.alias("x")).select("topic", "x.angle", "x.question")
