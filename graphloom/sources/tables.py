"""Tables as text with columns of fixed width."""

from __future__ import annotations


def format_table(rows: list[dict], columns: list[str]) -> str:
    """A page of rows: a header and left-aligned cells, booleans in lower case, null as a hyphen."""
    show = lambda v: "-" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    cells = [columns, *[[show(r.get(c)) for c in columns] for r in rows]]
    width = [max(len(row[k]) for row in cells) for k in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, width, strict=True)).rstrip() for row in cells)
