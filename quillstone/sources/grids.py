"""Cells of a table with spans as a grid of texts."""

from __future__ import annotations

Cell = tuple[int, int, int, int, str]
Grid = list[list[str | None]]

#: Places that a grid may have; a table with more is an error, not cut.
PLACES = 1_000_000


def grid(cells: list[Cell]) -> Grid:
    """cells: row, column, rows, columns, text. A merged cell's text stands in all of its places.

    Rows and columns in which no cell begins are left out, so spans and addresses bring no more places than the cells do.
    Places that no cell has are null; of cells in one place the first counts.
    """
    rows, columns = (sorted({c[i] for c in cells}) for i in (0, 1))
    if len(rows) * len(columns) > PLACES:
        raise ValueError(f"a table of {len(rows)} x {len(columns)} places")
    out: Grid = [[None] * len(columns) for _ in rows]
    row_at, column_at = ({v: i for i, v in enumerate(values)} for values in (rows, columns))
    free = len(rows) * len(columns)
    for row, column, tall, wide, text in cells:
        for r in range(row_at[row], len(rows)):
            if rows[r] >= row + max(tall, 1) or not free:
                break
            for c in range(column_at[column], len(columns)):
                if columns[c] >= column + max(wide, 1):
                    break
                if out[r][c] is None:
                    out[r][c] = text
                    free -= 1
    return out
