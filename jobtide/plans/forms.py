"""Made-up lines above the driver's texts: each line takes its forms in turn as the row's key goes on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Table = tuple[tuple[str, ...], ...]


def forms(table: Table, key: Column) -> list[Column]:
    """The k-th line takes form (key div (k + 1)) mod their number; ``#`` is the key."""
    pick = lambda k, lines: F.element_at(F.array(*map(F.lit, lines)), (F.floor(key / (k + 1)) % len(lines) + 1).cast("int"))
    return [F.replace(pick(k, lines), F.lit("#"), key.cast("string")) for k, lines in enumerate(table)]


def forms_sql(table: Table, key: str) -> str:
    """The same lines in SQL, separated by commas."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"replace([{', '.join(map(quoted, lines))}][(({key} // {k + 1}) % {len(lines)} + 1)::INTEGER], '#', {key}::VARCHAR)" for k, lines in enumerate(table))
