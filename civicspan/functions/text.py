"""Text clean-up: coded ages, blank-padded columns, tract numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age codes that stand where a number is declared, and the numbers that
# replace them (not specified; under a day, a week, a year old).
AGE_CODES = {"NS": -1, "NN": -2, "NB": -3, "BB": -4}


def _decoded_age(age: Column) -> Column:
    text = F.trim(age)
    return F.coalesce(*[F.when(text == code, F.lit(str(n))) for code, n in AGE_CODES.items()], text)


def recode_age(age: Column) -> Column:
    """A coded age as a number. Any other text that is no number stops the job."""
    return _decoded_age(age).cast("smallint")


def try_recode_age(age: Column) -> Column:
    """As ``recode_age``, but null for text that is no number."""
    return _decoded_age(age).try_cast("smallint")


def drop_padding(column: Column) -> Column:
    """A ``character(n)`` value without the trailing blanks, which never count in comparisons."""
    return F.rtrim(column)


def tract_key(name: Column) -> Column:
    """Tract number from a place name: ``Census Tract 7002, X County, Y`` gives ``7002.00``."""
    number = F.split_part(F.split_part(name, F.lit(","), F.lit(1)), F.lit(" "), F.lit(-1))
    return F.when(number.contains("."), number).otherwise(F.concat(number, F.lit(".00")))
