"""Checks that a database would enforce while loading, as jobs that report violations.

Loading never stops on them: load first, then run ``validation_report``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from civicspan.sources.schema import REFERENCES, REGISTRY, YEARLY_TABLES, Reference, Table

# Documented codes by column.
DOMAINS = {
    "reported_status": ["I", "Z", "U"],
    "attempt_complete_flag": ["A", "C"],
    "method_entry_code": ["F", "N"],
    "sex_code": ["M", "F", "U"],
    "resident_code": ["N", "R", "U"],
    "resident_status_code": ["N", "R", "U"],
    "orig_format": ["F", "W", "U", "S", "B", "N", "M"],
}

# Documented most rows per parent, as table, parent key and limit.
ROW_LIMITS = [
    ("nibrs_offense", "incident_id", 10),
    ("nibrs_offender", "incident_id", 99),
    ("nibrs_victim", "incident_id", 999),
    ("nibrs_victim_offender_rel", "victim_id", 10),
    ("nibrs_weapon", "offense_id", 3),
    ("nibrs_property", "incident_id", 10),
    ("nibrs_suspected_drug", "property_id", 3),
    ("nibrs_suspect_using", "offense_id", 3),
    ("nibrs_victim_injury", "victim_id", 10),
    ("nibrs_criminal_act", "offense_id", 3),
    ("nibrs_bias_motivation", "offense_id", 5),
]


def key_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows_with_key")).filter("rows_with_key > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str, *shared: str) -> DataFrame:
    """Values of ``column`` without a parent, with their number of rows.

    ``shared`` names columns, such as the year, that child and parent must have in common too.

    The child is counted by value first, so a value that fills a large part of the table
    reaches the join as one row.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(column, *shared).agg(F.count("*").alias("orphan_rows"))
    known = parent.select(F.col(parent_column).alias(column), *shared).distinct()
    return values.join(known, [column, *shared], "left_anti")


def cardinality_violations(child: DataFrame, parent_key: str, limit: int) -> DataFrame:
    """Parents with more child rows than documented."""
    counts = child.groupBy(parent_key).agg(F.count("*").alias("child_rows"))
    return counts.filter(F.col("child_rows") > limit)


def _one_pass(rows: DataFrame, conditions: Mapping[tuple[str, str], str]) -> DataFrame:
    """Rows that meet each condition, all counted in one scan: one row per condition.

    Conditions are SQL texts by kind of check and column.
    """
    counted = rows.selectExpr(*[f"count_if({text}) AS c{i}" for i, text in enumerate(conditions.values())])
    lines = ", ".join(
        f"named_struct('check_name', '{check}', 'column_name', '{column}', 'violations', c{i})"
        for i, (check, column) in enumerate(conditions)
    )
    return counted.selectExpr(f"inline(array({lines}))")


def _null_conditions(required: Iterable[str]) -> dict[tuple[str, str], str]:
    return {("not_null", name): f"`{name}` IS NULL" for name in required}


def _length_conditions(lengths: Mapping[str, int]) -> dict[tuple[str, str], str]:
    return {("length", name): f"length(rtrim(`{name}`)) > {limit}" for name, limit in lengths.items()}


def _domain_conditions(domains: Mapping[str, list[str]]) -> dict[tuple[str, str], str]:
    return {
        ("domain", name): f"`{name}` NOT IN ({', '.join(repr(code) for code in codes)})"
        for name, codes in domains.items()
    }


def null_violations(rows: DataFrame, required: list[str]) -> DataFrame:
    return _one_pass(rows, _null_conditions(required)).drop("check_name")


def length_violations(rows: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    """Values longer than declared; trailing blanks do not count."""
    return _one_pass(rows, _length_conditions(lengths)).drop("check_name")


def type_violations(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text that does not fit the declared type."""
    conditions = {
        ("type", name): f"`{name}` IS NOT NULL AND try_cast(`{name}` AS {kind}) IS NULL"
        for name, kind in types.items()
    }
    return _one_pass(rows, conditions).drop("check_name")


def domain_violations(rows: DataFrame, domains: Mapping[str, list[str]]) -> DataFrame:
    """Filled values outside their documented codes."""
    return _one_pass(rows, _domain_conditions(domains)).drop("check_name")


INTEGRAL = (ByteType, ShortType, IntegerType, LongType)
#: In a key that a report groups by: all columns filled, the first one missing, another one missing.
FILLED, FIRST_MISSING, OTHER_MISSING = 0, 1, 2


@dataclass
class _Report:
    """What a report counts. A key is the columns of a parent table; its rows come with slot 0, those of each child that
    refers to it with a slot of their own. A row check has a key number too, and sends its rows with slot 0."""

    tables: Mapping[str, DataFrame]
    keys: dict[tuple[str, tuple[str, ...]], int] = field(default_factory=dict)
    slots: dict[tuple[int, str, str], int] = field(default_factory=dict)
    emitted: dict[str, list[tuple[int, int, tuple[str, ...]]]] = field(default_factory=dict)
    row_checks: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    limits: list[tuple[int, int, int]] = field(default_factory=list)
    lines: list[tuple[int, str, str, str, str]] = field(default_factory=list)
    numbers: int = 0

    def key(self, table: str, columns: tuple[str, ...]) -> int:
        if (table, columns) not in self.keys:
            self.keys[table, columns] = self.numbers
            self.emitted.setdefault(table, []).append((self.numbers, 0, columns))
            self.numbers += 1
        return self.keys[table, columns]

    def child(self, key: int, table: str, columns: tuple[str, ...]) -> int:
        at = (key, table, columns[0])
        if at not in self.slots:
            self.slots[at] = 1 + sum(other == key for other, _, _ in self.slots)
            self.emitted.setdefault(table, []).append((key, self.slots[at], columns))
        return self.slots[at]

    def row_check(self, table: str, condition: str, check: str, column: str) -> None:
        self.row_checks.setdefault(table, []).append((self.numbers, condition))
        self.lines.append((self.numbers, "rows", table, check, column))
        self.numbers += 1

    def _is_number(self, key: int) -> bool:
        """Whether the key's columns are at most two whole numbers, in the parent and in every child."""
        uses = [(t, columns) for t, sent in self.emitted.items() for k, _, columns in sent if k == key]
        return all(
            len(columns) <= 2 and isinstance(self.tables[t].schema[c].dataType, INTEGRAL) for t, columns in uses for c in columns
        )

    def _sent(self, key: int, slot: int, columns: tuple[str, ...]) -> Column:
        first, *others = [F.col(c) for c in columns]
        other_missing = reduce(Column.__or__, [c.isNull() for c in others], F.lit(False))
        state = F.when(first.isNull(), FIRST_MISSING).when(other_missing, OTHER_MISSING).otherwise(FILLED)
        number = second = F.lit(None).cast("bigint")
        text = F.lit(None).cast("string")
        if self._is_number(key):
            number = first.cast("bigint")
            second = others[0].cast("bigint") if others else second
        else:
            text = F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate([first, *others])]))
        return _tagged(key, slot, state, number, second, text)

    def _rows(self, table: str) -> DataFrame:
        """Every row's keys and failed row checks, from one scan."""
        keys = [self._sent(*sent) for sent in self.emitted.get(table, [])]
        failed = [F.when(F.expr(condition), _tagged(number, 0)) for number, condition in self.row_checks.get(table, [])]
        each = self.tables[table].select(F.explode(F.array(*keys, *failed)).alias("one"))
        return each.where("one IS NOT NULL").select("one.*")

    def counted(self) -> DataFrame:
        """``table_name, check_name, detail, violations``, a row for each line."""
        named = sorted({*self.emitted, *self.row_checks})
        schema = "number int, measure string, table_name string, check_name string, detail string"
        lines = next(iter(self.tables.values())).sparkSession.createDataFrame(self.lines, schema)
        if not named:
            return lines.select("table_name", "check_name", "detail", F.lit(0).cast("bigint").alias("violations"))
        slots = range(1 + max(self.slots.values(), default=0))
        by_key = (
            reduce(DataFrame.unionByName, map(self._rows, named))
            .groupBy("key", "state", "number", "second", "text")
            .agg(*[F.count_if(F.col("slot") == j).alias(f"n{j}") for j in slots])
        )
        lost = f"state = {OTHER_MISSING} OR state = {FILLED} AND n0 = 0"
        measures = {"rows": "sum(n0)", "repeated": "count_if(n0 > 1)"}
        measures |= {f"lost{j}": f"sum(if({lost}, n{j}, 0L))" for j in slots if j}
        for j in {slot for _, slot, _ in self.limits}:
            most = " ".join(f"WHEN {key} THEN {limit}" for key, slot, limit in self.limits if slot == j)
            measures[f"over{j}"] = f"count_if(n{j} > CASE key {most} END)"
        sums = by_key.groupBy("key").agg(*[F.expr(text).alias(name) for name, text in measures.items()])
        pairs = [F.struct(F.lit(name).alias("measure"), F.col(name).alias("violations")) for name in measures]
        each = sums.select(F.col("key").alias("number"), F.inline(F.array(*pairs)))
        return lines.join(each, ["number", "measure"], "left").select(
            "table_name", "check_name", "detail", F.coalesce("violations", F.lit(0)).alias("violations")
        )


def _tagged(key: int, slot: int, state=None, number=None, second=None, text=None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(key).alias("key"),
        F.lit(slot).alias("slot"),
        (F.lit(FILLED) if state is None else state).alias("state"),
        (none.cast("bigint") if number is None else number).alias("number"),
        (none.cast("bigint") if second is None else second).alias("second"),
        (none.cast("string") if text is None else text).alias("text"),
    )


def validation_report(
    tables: Mapping[str, DataFrame],
    registry: Mapping[str, Table] = REGISTRY,
    references: list[Reference] = REFERENCES,
    rejects: DataFrame | None = None,
) -> DataFrame:
    """One row per check: table, kind of check, column or columns, number of violations.

    Checks every key, required column, length, code, row limit and reference that the columns present allow. Each table is
    scanned once: a row sends its own key, the keys that it refers to and the row checks it fails. All are counted by key in
    one shuffle, before which tasks add up what they have, so that a code that fills a third of a table is one row
    for each task. A key's counts tell whether it is repeated, referred to without being there, or referred to too often.

    ``rejects`` are lines that a load has kept aside, as ``read_rejects`` gives them: a row ``load`` for each table and drop.
    """
    columns = {name: set(tables[name].columns) for name in tables}
    report = _Report(tables)
    for name in columns:
        table = registry.get(name)
        if table is None:
            continue
        conditions = {
            **_null_conditions(c for c in table.required() if c in columns[name]),
            **_length_conditions({c: n for c, n in table.lengths().items() if c in columns[name]}),
            **_domain_conditions({c: codes for c, codes in DOMAINS.items() if c in columns[name]}),
        }
        for (check, column), condition in conditions.items():
            report.row_check(name, condition, check, column)
        if columns[name].issuperset(table.row_key):
            key = report.key(name, table.row_key)
            report.lines.append((key, "repeated", name, "primary_key", ",".join(table.row_key)))
    for ref in references:
        if ref.column in columns.get(ref.child, ()) and ref.parent_column in columns.get(ref.parent, ()):
            shared = ("data_year",) if ref.parent in YEARLY_TABLES and "data_year" in columns[ref.child] else ()
            key = report.key(ref.parent, (ref.parent_column, *shared))
            slot = report.child(key, ref.child, (ref.column, *shared))
            detail = ",".join([ref.column, *shared])
            report.lines.append((key, f"lost{slot}", ref.child, "foreign_key", f"{detail}->{ref.parent}"))
    for name, column, limit in ROW_LIMITS:
        if name in registry and column in columns.get(name, ()):
            slots = [(key, slot) for (key, child, c), slot in report.slots.items() if (child, c) == (name, column)]
            key, slot = slots[0] if slots else (report.key(name, (column,)), 0)
            report.limits.append((key, slot, limit))
            report.lines.append((key, f"over{slot}", name, "row_limit", column))
    counts = report.counted()
    if rejects is None:
        return counts
    kept_aside = rejects.groupBy("table_name", F.col("drop").alias("detail")).agg(F.count("*").alias("violations"))
    return counts.unionByName(kept_aside.withColumn("check_name", F.lit("load")))
