"""Match names that are written differently, such as those of local data with those of census tracts.

A name is its numbers and its words. Numbers must be the same in the same order; words may differ by a few letters. Of the names
that are left after exact matches, those with few known names of the same numbers are paired with all of these. For the others, every way of
leaving out up to that many letters is a blocking key together with the numbers: two texts
within so many edits always share one, so that no match is missed. Names that share a key are few, however
large the tables are, as they have the same numbers and nearly the same letters. Pairs are then
measured by their edit distance.

Each distinct name is matched once, so a name that fills a large part of a table costs as much as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_EDITS = 2
#: Words of fewer letters than this for each edit must match better.
LETTERS_AN_EDIT = 5
#: Up to so many known names with the same numbers are compared as they are: a long name has more keys than that.
SMALL_BLOCK = 64

EXACT, NEAR, AMBIGUOUS, NONE = "exact", "near", "ambiguous", "none"


def numbers_of(name: Column) -> Column:
    """The numbers of a name in order, without decimals that are zero."""
    found = F.regexp_extract_all(name, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.array_join(F.transform(found, lambda n: F.regexp_replace(n, r"\.0+$", "")), " ")


def words_of(name: Column) -> Column:
    """The name without numbers and punctuation, in lower case, with single blanks."""
    letters = F.regexp_replace(F.lower(name), r"\d+(?:\.\d+)?", " ")
    return F.trim(F.regexp_replace(letters, r"[^\p{L}]+", " "))


def _shortened(texts: Column) -> Column:
    """Every text with each one of its letters left out."""

    def without_one(text: Column) -> Column:
        places = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substr(text, i + 1)))

    return F.array_distinct(F.flatten(F.transform(texts, without_one)))


def left_out(text: Column, most: int) -> Column:
    """Marks of the text with up to ``most`` letters left out in every way."""
    made = every = F.array(text)
    for _ in range(most):
        made = _shortened(made)
        every = F.concat(every, made)
    return F.transform(F.array_distinct(every), lambda t: F.xxhash64(t))


def _edits_allowed(words: Column, most: int) -> Column:
    return F.least(F.lit(most), F.floor(F.char_length(words) / LETTERS_AN_EDIT).cast("int"))


def match_names(
    rows: DataFrame,
    known: DataFrame,
    name: str,
    known_name: str,
    key: str,
    within: tuple[str, ...] = (),
    most_edits: int = MOST_EDITS,
) -> DataFrame:
    """The rows with ``key`` of the known name that theirs stands for, ``match`` and ``edits``; columns of these names are replaced.

    ``within`` names columns, such as a county, that must be equal as well. ``match`` is ``exact`` for the same numbers and words, ``near``
    for one nearest name with at most ``most_edits`` edits, one for each five letters; ``ambiguous``, without
    a key, if several known names are as near; ``none`` if there is none, and for names that are missing.
    """
    parts = ["numbers", "words", *within]
    read = {"numbers": numbers_of, "words": words_of}
    asked = rows.select(F.col(name).alias("asked"), *within).filter(F.col("asked").isNotNull()).distinct()
    asked = asked.select("asked", *[f(F.col("asked")).alias(c) for c, f in read.items()], *within)
    of_known = known.select(*[f(F.col(known_name)).alias(c) for c, f in read.items()], *within, F.col(key).alias("found"))
    of_known = of_known.groupBy(*parts).agg(F.min("found").alias("found"), F.count_distinct("found").alias("rivals"))
    wanted = asked.select(*parts).distinct()
    exact = wanted.join(of_known, parts).select(*parts, "found", "rivals", F.lit(0).alias("edits"))

    block = ["numbers", *within]
    rest = wanted.join(exact, parts, "left_anti").withColumn("most", _edits_allowed(F.col("words"), most_edits)).filter("most > 0")
    sizes = of_known.groupBy(*block).agg(F.count("*").alias("size"))
    others = of_known.withColumnRenamed("words", "known_words")
    rest = rest.join(sizes, block)
    few = rest.filter(F.col("size") <= SMALL_BLOCK).drop("size").join(others, block)
    rest = rest.filter(F.col("size") > SMALL_BLOCK).drop("size")
    others = others.join(rest.select(*block).distinct(), block, "left_semi")
    rest = rest.withColumn("mark", F.explode(left_out(F.col("words"), most_edits)))
    others = others.withColumn("mark", F.explode(left_out(F.col("known_words"), most_edits)))
    # Spark estimates the marks at the size of the names that they are made from, and would broadcast them.
    many = rest.join(others.hint("merge"), [*block, "mark"]).drop("mark").distinct()
    near = few.unionByName(many).withColumn("edits", F.levenshtein("words", "known_words")).filter("edits <= most")
    rivals = F.greatest(F.count_distinct("found"), F.max("rivals")).alias("rivals")
    at_distance = near.groupBy(*parts, "edits").agg(F.min("found").alias("found"), rivals)
    best = at_distance.groupBy(*parts).agg(F.min(F.struct("edits", "found", "rivals")).alias("best"))
    near = best.select(*parts, "best.found", "best.rivals", "best.edits")

    every = exact.unionByName(near)
    sure = F.col("rivals") == 1
    kind = F.when(F.col("rivals").isNull(), NONE).when(~sure, AMBIGUOUS).when(F.col("edits") == 0, EXACT).otherwise(NEAR)
    judged = asked.join(every, parts, "left").select(
        F.col("asked").alias(name), *within, F.when(sure, F.col("found")).alias(key), kind.alias("match"), "edits"
    )
    matched = rows.drop(key, "match", "edits").join(judged, [name, *within], "left")
    return matched.withColumn("match", F.coalesce("match", F.lit(NONE)))


def match_report(matched: DataFrame) -> DataFrame:
    """Rows for each kind of match."""
    return matched.groupBy("match").agg(F.count("*").alias("rows"))
