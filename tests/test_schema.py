"""The declared tables as a whole."""

from __future__ import annotations

from collections import Counter

import declared
from civicspan.sources.schema import REFERENCES, REGISTRY


def test_census_of_tables_columns_and_references():
    fields = [f for table in REGISTRY.values() for f in table.schema]
    assert len(REGISTRY) == 42
    assert len(fields) == 279
    assert sum(f.metadata.get("required", False) for f in fields) == 75
    assert sum("max_len" in f.metadata for f in fields) == 117
    assert sum(f.metadata.get("padded", False) for f in fields) == 39
    assert sum(table.is_fact for table in REGISTRY.values()) == 18
    assert sum(len(table.key) > 1 for table in REGISTRY.values()) == 10
    assert len(REFERENCES) == 51
    assert sum(ref.cascade for ref in REFERENCES) == 19
    kinds = Counter(f.dataType.simpleString() for f in fields)
    assert kinds == {
        "smallint": 69,
        "int": 38,
        "bigint": 40,
        "string": 117,
        "decimal(18,6)": 2,
        "double": 1,
        "date": 6,
        "timestamp_ntz": 6,
    }


def test_keys_are_columns():
    for table in REGISTRY.values():
        assert set(table.key) <= set(table.columns)


def test_comments_are_kept():
    for name in ("nibrs_month", "nibrs_incident"):
        assert "flat file" in REGISTRY[name].schema["orig_format"].metadata["comment"]


def test_every_column_type_length_key_and_reference():
    lines = []
    for table in REGISTRY.values():
        for field in table.schema:
            length = field.metadata.get("max_len")
            text = "char" if field.metadata.get("padded") else "varchar"
            line = f"{table.name}.{field.name} {f'{text}({length})' if length else field.dataType.simpleString()}"
            line += " not null" if field.metadata.get("required") else ""
            line += f" key {table.key.index(field.name) + 1}" if field.name in table.key else ""
            lines.append(line)
    assert lines == declared.COLUMNS.strip().splitlines()
    references = [
        f"{r.child}.{r.column} {r.parent}.{r.parent_column}{' cascade' if r.cascade else ''}" for r in REFERENCES
    ]
    assert references == declared.REFERENCES.strip().splitlines()
