"""Table grids to lines of `label | header value`, so that each number carries its header."""

from __future__ import annotations

import re

#: A table has so many rows, one row of so many cells, and no larger share of empty cells; a header so many cells.
ROWS, CELLS, EMPTY, HEADER_CELLS = 2, 2, 0.55, 2
#: Characters between which a wrapped line joins without a space; a period; an amount.
WIDE = re.compile(r"[⺀-鿿豈-﫿＀-￯]")
PERIOD = re.compile(r"(?:19|20)\d{2}\s*(?:年\s*(?:半年度|年度|第[一二三四]季度|全年度)?|[.\-/]\s*\d{1,2}\s*(?:[.\-/月]\s*\d{1,2}\s*日?)?)?")
AMOUNT = re.compile(r"\d{1,3}(?:,\d{3})+|\d\.\d|[¥$€£]|\d\s*[%‰]")

Grid = list[list[str]]


def unwrap(text: str | None) -> str:
    """Lines joined with a space, but without one between two wide characters."""
    out = ""
    for k, line in enumerate((text or "").split("\n")):
        glued = k and out and line and WIDE.match(out[-1]) and WIDE.match(line[0])
        out += line if not k or glued else f" {line}"
    return out


def clean(rows: list[list[str | None]]) -> Grid:
    """Cells with collapsed blanks; rows without any text are dropped."""
    cells = ([re.sub(r"[ \t]+", " ", unwrap(c)).strip() for c in row] for row in rows)
    return [row for row in cells if any(row)]


def starts(row: list[str]) -> list[tuple[int, str]]:
    """Runs of equal cells as (first column, cell)."""
    return [(i, c) for i, c in enumerate(row) if not i or c != row[i - 1]]


def defect(rows: list[list[str | None]]) -> str:
    """Why a grid is no table, or an empty string."""
    grid = clean(rows)
    if len(grid) < ROWS:
        return "few rows"
    if max(sum(map(bool, row)) for row in grid) < CELLS:
        return "few cells"
    empty = sum(not c for row in grid for c in row) / (max(map(len, grid)) * len(grid))
    return f"empty {empty:.2f}" if empty > EMPTY else ""


def header_score(row: list[str]) -> int:
    """How many distinct cells have letters; 0 if the row has under two cells or an amount."""
    cells = {c for c in row if c}
    if len(cells) < HEADER_CELLS or any(AMOUNT.search(c) and not PERIOD.fullmatch(c.strip()) for c in cells):
        return 0
    return sum(any(ch.isalpha() for ch in c) for c in cells)


def flatten(rows: list[list[str | None]], inherited: list[str] | None = None, header_rows: int = 1) -> tuple[str, list[str] | None]:
    """The table's lines, and the header that a continuation may inherit.

    The best of the first rows is the header; rows above it are dropped. Without one, an inherited header holds for all
    rows. A header cell reaches over blanks to its right. The first column is the label and gets no header.
    """
    grid = clean(rows)
    tops = [header_score(r) for r in grid[: header_rows + 1]]
    if any(tops):
        at = tops.index(max(tops))
        header, body = list(grid[at]), grid[at + 1 :]
    else:
        header, body = (list(inherited or []) if grid else []), grid
    for i in range(1, len(header)):
        header[i] = header[i] or header[i - 1]

    def shown(i: int, cell: str) -> str:
        name = header[i] if 0 < i < len(header) else ""
        return cell if name in ("", cell) else f"{name} {cell}"

    lines = [" | ".join(shown(i, c) for i, c in starts(row) if c) for row in body]
    if header and not lines:
        lines = [" | ".join(c for _, c in starts(header) if c)]
    return "\n".join(x for x in lines if x), header if any(header) else None


def may_inherit(header: list[str] | None, width: int, apart: int = 0, top: float | None = None, height: float | None = None) -> bool:
    """Whether a table goes on with a header: of equal width, with nothing between, and on a page within the top fifth."""
    if not header or apart or width != len(header):
        return False
    return top is None or not height or top <= 0.2 * height


class Span:
    """Expands colspans and rowspans to a grid."""

    def __init__(self) -> None:
        self.grid: Grid = []
        self.below: dict[int, tuple[int, str]] = {}

    @staticmethod
    def number(value: str | None, most: int = 1000) -> int:
        try:
            return max(1, min(most, int(value or 1)))
        except ValueError:
            return 1

    def add(self, cells: list[tuple[str, str | None, str | None]]) -> None:
        """A row of (text, colspan, rowspan)."""
        row: list[str] = []

        def fill() -> None:
            while len(row) in self.below:
                left, text = self.below.pop(len(row))
                if left > 1:
                    later[len(row)] = (left - 1, text)
                row.append(text)

        later: dict[int, tuple[int, str]] = {}
        for text, wide, high in cells:
            fill()
            for _ in range(self.number(wide, 60)):
                if self.number(high) > 1:
                    later[len(row)] = (self.number(high) - 1, text)
                row.append(text)
        fill()
        for at in sorted(self.below):  # spans right of a short row
            if at >= len(row):
                row.extend([""] * (at - len(row)))
                left, text = self.below[at]
                if left > 1:
                    later[at] = (left - 1, text)
                row.append(text)
        self.below = later
        self.grid.append(row)
