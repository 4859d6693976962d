"""Alignment of two lists of masses by diagonals, with shifts, and its path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: As many cells go through plain lists.
FEW_CELLS = 64


def same_diagonal(a: np.ndarray, b: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (earlier, later) of cells, numbered by row of a and column of b, whose offsets b - a differ by less than the tolerance and of which the later one is behind in both lists; sorted by the later one.

    Cells are put in order of their offsets, so that a cell's diagonal is one stretch of them.
    """
    offset = (b[None, :] - a[:, None]).reshape(-1)
    order = np.argsort(offset, kind="stable")
    upto = np.searchsorted(offset[order], offset[order] + tolerance, "left")
    n = np.maximum(upto - np.arange(len(order)) - 1, 0)
    one = np.repeat(np.arange(len(order)), n)
    two = one + 1 + np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
    one, two = order[one], order[two]
    one, two = np.minimum(one, two), np.maximum(one, two)
    later = (two // len(b) > one // len(b)) & (two % len(b) > one % len(b))
    one, two = one[later], two[later]
    by = np.lexsort((one, two))
    return one[by], two[by]


def layers(a: np.ndarray, b: np.ndarray, shifts: int, tolerance: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For 0 to ``shifts`` shifts the most matches of a path that ends with each cell, and same_diagonal()'s pairs.

    A path begins anywhere. Each layer takes up a cell of its own diagonal, or with one shift more any cell before it, of
    which the prefix maxima of the layer below say the best.
    """
    n, m = len(a), len(b)
    earlier, later = same_diagonal(a, b, tolerance)
    starts = np.searchsorted(later, np.arange(n + 1) * m)
    best = np.ones((shifts + 1, n, m), np.int64)
    for k in range(shifts + 1):
        now = best[k]
        if k:
            before = np.maximum.accumulate(np.maximum.accumulate(best[k - 1], axis=0), axis=1)
            now[1:, 1:] += before[:-1, :-1]
        flat = now.reshape(-1)
        for i in range(1, n):  # rows: a cell looks at rows above alone
            some = slice(starts[i], starts[i + 1])
            np.maximum.at(flat, later[some], flat[earlier[some]] + 1)
    return best, (earlier, later)


def few_cells_path(a: list[float], b: list[float], shifts: int, tolerance: float) -> list[tuple[int, int, int]]:
    """shifted_path() of short lists in plain lists: for few cells an array's overhead is most of its time."""
    m = len(b)
    cells = [(i, j) for i in range(len(a)) for j in range(m)]
    offset = [b[j] - a[i] for i, j in cells]
    links: list[list[int]] = []
    for c, (i, j) in enumerate(cells):
        x = offset[c]
        links.append([p * m + q for p in range(i) for q in range(j) if (offset[p * m + q] < x + tolerance if offset[p * m + q] >= x else x < offset[p * m + q] + tolerance)])
    best: list[list[int]] = []
    for k in range(shifts + 1):
        now = []
        before: list[int] = []  # the most matches of the layer below in the rows and columns up to a cell
        for c, (i, j) in enumerate(cells):
            top = 1 + before[c - m - 1] if k and i and j else 1
            for e in links[c]:
                if now[e] >= top:
                    top = now[e] + 1
            now.append(top)
            if k:
                before.append(max(best[k - 1][c], before[c - m] if i else 0, before[c - 1] if j else 0))
        best.append(now)
    down = lambda c: (cells[c][0] + cells[c][1], cells[c][0])
    k, most = shifts, max(best[shifts])
    cell = max((c for c, v in enumerate(best[k]) if v == most), key=down)
    path = [(cell, k)]
    while best[k][cell] > 1:
        value = best[k][cell] - 1
        own = [e for e in links[cell] if best[k][e] == value]
        if own:
            cell = own[-1]
        else:
            k -= 1
            i, j = cells[cell]
            cell = max((c for c, (p, q) in enumerate(cells) if p < i and q < j and best[k][c] == value), key=down)
        path.append((cell, k))
    first = path[-1][1]
    return [(*cells[c], j - first) for c, j in reversed(path)]


def shifted_path(a: np.ndarray, b: np.ndarray, shifts: int, tolerance: float) -> list[tuple[int, int, int]]:
    """(row, column, shifts so far) of a longest path: masses of a that follow b in order, of which the offset b - a changes at most ``shifts`` times.

    Ties: the path ends as far down both lists as can be, then down a; going back it stays on its diagonal while
    that costs no match, to the nearest row; at a shift it goes to the farthest cell down both lists, then down a.
    """
    if not (len(a) and len(b)):
        return []
    if len(a) * len(b) <= FEW_CELLS:
        return few_cells_path(a.tolist(), b.tolist(), shifts, tolerance)
    best, (earlier, later) = layers(a, b, shifts, tolerance)
    m, k = len(b), shifts
    rows, columns = np.divmod(np.arange(best[0].size), m)

    def last(cells: np.ndarray) -> int:
        return int(cells[np.lexsort((rows[cells], rows[cells] + columns[cells]))[-1]])

    cell = last(np.nonzero(best[k].reshape(-1) == best[k].max())[0])
    path = [(cell, k)]
    while True:
        flat, value = best[k].reshape(-1), best[k].reshape(-1)[cell]
        if value == 1:
            break
        low, high = np.searchsorted(later, [cell, cell + 1])
        own = earlier[low:high]
        own = own[flat[own] == value - 1]
        if len(own):
            cell = int(own[np.lexsort((columns[own], rows[own]))[-1]])
        else:
            k -= 1
            cell = last(np.nonzero((best[k].reshape(-1) == value - 1) & (rows < rows[cell]) & (columns < columns[cell]))[0])
        path.append((cell, k))
    first = path[-1][1]
    return [(int(rows[c]), int(columns[c]), j - first) for c, j in reversed(path)]


def shifted_paths(pairs: DataFrame, shifts: int, tolerance: float) -> DataFrame:
    """light, heavy, step (from 0), light_mass, heavy_mass, shift (how many shifts lie before) of shifted_path() of each pair (light, heavy, a, b: rising masses of both). Pairs with an empty or null list have no row."""

    def run(batches):
        for batch in batches:
            out = []
            for light, heavy, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.array(x or [], float), np.array(y or [], float)
                out += [(light, heavy, s, float(x[i]), float(y[j]), k) for s, (i, j, k) in enumerate(shifted_path(x, y, shifts, tolerance))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names=["light", "heavy", "step", "light_mass", "heavy_mass", "shift"])

    return pairs.selectExpr("cast(light as long) light", "cast(heavy as long) heavy", "cast(a as array<double>) a", "cast(b as array<double>) b").mapInArrow(run, "light long, heavy long, step int, light_mass double, heavy_mass double, shift int")
