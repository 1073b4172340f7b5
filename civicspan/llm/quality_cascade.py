"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one condition on its signals. On a sample the cascade measures what
a rule costs and what it rejects, and orders the rules by newly rejected rows per second. For a
row the conditions are then tried in that order and the first that rejects ends the trial
(``CASE WHEN`` evaluates lazily), so costly signals are computed only for rows that the cheap
rules let pass. The order changes time, never the verdict.

Defined cases: a null text has no words and is treated as empty; an empty text has no words and
is rejected as too short; equal texts get equal verdicts; an empty table keeps the given rule
order; other columns are passed through, and a column that has the name of an output is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import let, unused, written

SPACES = "[ \\t-\\r]+"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARACTERS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACES)
    )


def repeated_words(of: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by a 64-bit hash. Texts whose windows are all different, the usual
    case, end there; for the others the positions of equal windows come from one sort.
    """

    def covered(positions: Column) -> Column:
        steps = F.transform(
            positions, lambda at, j: F.least(F.lit(width), F.coalesce(F.get(positions, j + 1) - at, F.lit(width)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(ordered: Column) -> Column:
        def same(entry: Column, j: Column) -> Column:
            return F.coalesce(F.get(ordered, j).getField("window") == entry.getField("window"), F.lit(False))

        twice = F.filter(ordered, lambda entry, j: same(entry, j - 1) | same(entry, j + 1))
        return let(F.array_sort(F.transform(twice, lambda entry: entry.getField("at"))), covered)

    def among(windows: Column) -> Column:
        pairs = F.transform(windows, lambda window, at: F.struct(window.alias("window"), at.alias("at")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(F.array_sort(pairs), repeated)
        )

    starts = F.sequence(F.lit(1), F.size(of) - (width - 1))
    return F.when(F.size(of) <= width, F.lit(0)).otherwise(
        let(F.transform(starts, lambda start: F.xxhash64(F.slice(of, start, width))), among)
    )


def distinct_in_pieces(of: Column, width: int = 1000) -> Column:
    """Distinct words of each ``width`` words, added up: their share does not fall with the length of the text."""
    pieces = F.sequence(F.lit(0), F.floor((F.greatest(F.size(of), F.lit(1)) - 1) / width).cast("int"))
    each = F.transform(pieces, lambda piece: F.size(F.array_distinct(F.slice(of, piece * width + 1, F.lit(width)))))
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARACTERS)) != "")


#: From a text's words, in one pass over them.
WORD_SIGNALS: dict[str, Callable[[Column], Column]] = {
    "n_words": F.size,
    "word_chars": lambda of: F.char_length(F.array_join(of, "")),
    "n_repeat_words": repeated_words,
    "n_distinct_words": lambda of: distinct_in_pieces(of),
}
#: From the text itself.
TEXT_SIGNALS: dict[str, Callable[[Column], Column]] = {
    "n_symbols": lambda text: F.regexp_count(text, F.lit(SYMBOLS)),
    "n_dup_lines": lambda text: let(_lines(text), lambda of: F.size(of) - F.size(F.array_distinct(of))),
    "n_lines": lambda text: F.size(_lines(text)),
    "n_exclamations": lambda text: F.regexp_count(text, F.lit("!")),
    "n_digits": lambda text: F.regexp_count(text, F.lit("[0-9]")),
    "n_capitals": lambda text: F.regexp_count(text, F.lit("\\p{Lu}")),
    "n_letters": lambda text: F.regexp_count(text, F.lit("\\p{L}")),
    "n_chars": F.char_length,
}


class Signals:
    """Signals of a text by name: a column where it is given, else the expression that computes it."""

    def __init__(self, text: Column, given: tuple[str, ...] = ()):
        self.text, self.given = F.coalesce(text, F.lit("")), given

    def __getitem__(self, name: str) -> Column:
        if name in self.given:
            return F.col(name)
        if name in TEXT_SIGNALS:
            return TEXT_SIGNALS[name](self.text).cast("long")
        return let(words(self.text), WORD_SIGNALS[name]).cast("long")


def with_signals(docs: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """Adds signals as columns; those on words share one split of the text."""
    source = F.coalesce(F.col(text), F.lit(""))
    of_words = [name for name in names if name in WORD_SIGNALS]
    shared = let(words(source), lambda of: F.struct(*[WORD_SIGNALS[name](of).alias(name) for name in of_words]))
    kept = docs.drop(*names)
    (all_,) = unused(docs.columns, "_signals")
    rows = kept.withColumn(all_, shared) if of_words else kept
    columns = [
        F.col(all_)[name] if name in WORD_SIGNALS else TEXT_SIGNALS[name](source) for name in names
    ]
    return rows.select(*kept.columns, *[c.cast("long").alias(name) for c, name in zip(columns, names, strict=True)])


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Signals], Column]


def base_failed(s: Signals) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


#: The production rules. Each is a wide margin away from ordinary prose.
RULES = (
    Rule("too_short", lambda s: s["n_words"] < 10),
    Rule("repeated_windows", lambda s: 100 * s["n_repeat_words"] > 20 * s["n_words"]),
    Rule("symbols", lambda s: 100 * s["n_symbols"] > 30 * s["n_words"]),
    Rule("duplicate_lines", lambda s: 2 * s["n_dup_lines"] > s["n_lines"]),
    Rule("exclamations", lambda s: 2 * s["n_exclamations"] > s["n_words"]),
    Rule("capitals", lambda s: (s["n_letters"] >= 50) & (10 * s["n_capitals"] > 6 * s["n_letters"])),
    Rule("digits", lambda s: 10 * s["n_digits"] > 6 * s["n_chars"]),
    Rule("long_words", lambda s: s["word_chars"] > 200 * s["n_words"]),
    Rule("variety", lambda s: (s["n_words"] >= 50) & (100 * s["n_distinct_words"] < 15 * s["n_words"])),
)


@dataclass(frozen=True)
class Estimate:
    """What the sample says of a rule: seconds a row, and its share of rows not yet rejected."""

    name: str
    seconds: float
    rejected: float


def _seconds(run: Callable[[], object]) -> float:
    run()  # compiles the code
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def order_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    sample_rows: int = 1000,
    seed: int = 7,
) -> tuple[list[Rule], list[Estimate]]:
    """The rules by rejected rows per second on a sample of about ``sample_rows`` rows.

    Greedy: after a rule is placed, the others count only rows that it let pass. What is collected
    is one row per combination of verdicts, at most as many as sampled rows.
    """
    total = docs.count()
    if not total:
        return list(rules), []
    share = min(1.0, sample_rows / total)
    sample = written(docs.select(F.col(text).alias("text")).sample(share, seed), "rule-sample")
    signals = Signals(F.col("text"))

    def count(condition: Column) -> Callable[[], object]:
        return lambda: sample.agg(F.count_if(condition)).first()

    idle = _seconds(count(F.col("text").isNull()))
    rows = max(1, sample.count())
    costs = {r.name: max(_seconds(count(r.rejects(signals))) - idle, 1e-3) / rows for r in rules}
    verdicts = sample.select(*[F.coalesce(r.rejects(signals), F.lit(False)).alias(r.name) for r in rules])
    patterns = [(row.asDict(), row["count"]) for row in verdicts.groupBy(*[r.name for r in rules]).count().collect()]
    ordered, estimates, left = [], [], list(rules)
    while left:
        gain = {r.name: sum(n for bits, n in patterns if bits[r.name]) for r in left}
        best = max(left, key=lambda r: (gain[r.name] / costs[r.name], -costs[r.name]))
        remaining = sum(n for _, n in patterns)
        estimates.append(Estimate(best.name, costs[best.name], gain[best.name] / remaining if remaining else 0.0))
        ordered.append(best)
        left.remove(best)
        patterns = [(bits, n) for bits, n in patterns if not bits[best.name]]
    return ordered, estimates


def apply_cascade(docs: DataFrame, ordered: list[Rule], text: str = "text", given: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rejected_by``, the first rule in this order that rejects the row, or null."""
    signals = Signals(F.col(text), given)
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects(signals), rule.name).otherwise(verdict)
    return docs.withColumn("rejected_by", verdict)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns they had."""
    ordered, _ = order_rules(docs, rules, text)
    judged = apply_cascade(docs, ordered, text)
    return judged.where(F.col("rejected_by").isNull()).select(docs.columns)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Signals and verdict of every row; rules read the signals that are there anyway."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ordered, _ = order_rules(docs, rules, text)
    rows = apply_cascade(with_signals(docs, names, text), ordered, text, given=tuple(names))
    failed = base_failed(Signals(F.col(text), tuple(names)))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("rejected_by").isNull())
