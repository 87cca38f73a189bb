"""The best ``k`` per query of the rows that a task sees, in numpy: vectors by a distance, sparse vectors and texts by a dot product. Memory is bounded by tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and rows of a tile of distances, and what a tile of sparse products holds at most.
ASKS, ROWS, PRODUCTS = 256, 4096, 1 << 21
#: Values of vectors that a task holds, and that are compared or scored at once.
VALUES, TILE = 1 << 22, 1 << 18
#: Candidates that are held before those that can't be among the best go.
HELD = 1 << 18


class Best:
    """The best ``k`` per query of what is added, smallest ``sign`` first, ties by id, and what lies within ``slack`` of the last of them; of equal ones the ``k`` smallest ids.

    ``slack`` is the unit to which scores are rounded later, or 0; what is then equal beyond doubt counts as equal.
    """

    def __init__(self, k: int, slack: float, queries: int) -> None:
        self.k, self.slack, self.edge = k, slack, np.full(queries, np.inf)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []
        self.n, self.kept, self.limit = 0, 0, HELD

    def add(self, q: np.ndarray, ids: pa.Array, sign: np.ndarray, score: np.ndarray) -> None:
        if len(q):
            self.parts.append((q, ids, sign, score))
            self.n += len(q)
        if self.n > self.limit:
            self.cut()
            self.limit = max(HELD, 2 * self.n)

    def cut(self) -> None:
        if not self.parts:
            return
        q, sign, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2, 3))
        sign = self._rounded(sign)
        ids = pa.concat_arrays([p[1] for p in self.parts])
        at = np.lexsort((pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy(), sign, q))
        q, sign = q[at], sign[at]
        first = np.r_[True, q[1:] != q[:-1]]
        tied = first.copy()
        tied[1:] |= sign[1:] != sign[:-1]
        here = np.arange(len(q))
        begin, group = np.flatnonzero(first), np.cumsum(first) - 1
        size = np.diff(np.r_[begin, len(q)])
        last = sign[begin + np.minimum(size, self.k) - 1]
        self.edge[q[begin]] = np.where(size >= self.k, last, np.inf)
        keep = (here - begin[group] < self.k) | ((sign <= last[group] + self.slack) & (here - np.flatnonzero(tied)[np.cumsum(tied) - 1] < self.k))
        at = at[keep]
        self.parts = [(q[keep], ids.take(pa.array(at)), sign[keep], score[at])]
        self.n = self.kept = len(at)

    def _rounded(self, sign: np.ndarray) -> np.ndarray:
        if not self.slack:
            return sign
        with np.errstate(all="ignore"):
            at = sign / self.slack
            whole = np.floor(at + 0.5)
            sure = (np.abs(at - whole) < 0.499999) & (np.abs(at) < 1e9)
        return np.where(sure, whole * self.slack, sign)

    def tighten(self) -> None:
        """Brings the edges near to what was added, at a cost in proportion to that."""
        if self.n >= 2 * self.kept:
            self.cut()

    def table(self, qids: pa.Array, kind: pa.DataType, nan_is_null: bool) -> pa.RecordBatch:
        self.cut()
        q, ids, _, score = self.parts[0] if self.parts else (np.empty(0, np.int64), pa.array([], kind), None, np.empty(0))
        return pa.RecordBatch.from_arrays([qids.take(pa.array(q, pa.int64())), ids, pa.array(score, pa.float64(), from_pandas=nan_is_null)], ["qid", "id", "score"])


def joined(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(column.chunks or [pa.array([], column.type)]) if isinstance(column, pa.ChunkedArray) else column


# --- vectors ----------------------------------------------------------------------------------------------------------

Lengths = dict[int, tuple[np.ndarray, np.ndarray]]


def by_length(column: pa.Array) -> Lengths:
    """Vectors that aren't null as matrices by their length, with their places; null components are NaN."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes).astype(int).tolist():
        rows = np.flatnonzero(sizes == size)
        out[size] = rows, flat.reshape(len(rows), size) if len(rows) == len(sizes) else flat[starts[rows].astype(np.int64)[:, None] + np.arange(size)]
    return out


def _pairs(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the rows of ``a`` to those of ``b``, summed component by component as the Column expressions do; NaN where these give null."""
    total, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    with np.errstate(all="ignore"):
        for i in range(a.shape[1]):
            x, y = a[:, i], b[:, i]
            if metric == "l2":
                total += (x - y) * (x - y)
                continue
            total += x * y
            if metric != "dot":
                aa += x * x
                bb += y * y
        if metric == "l2":
            return np.sqrt(total)
        if metric == "dot":
            return total
        below = np.sqrt(aa * bb)
        score = np.where(below == 0, np.nan, total / np.where(below == 0, 1.0, below))
    return 1.0 - score if metric == "cosine_distance" else score


def _plain(m: np.ndarray, metric: str) -> np.ndarray:
    """Which vectors a product of matrices can compare: finite ones of a usual length."""
    with np.errstate(all="ignore"):
        squares = (m * m).sum(1)
    good = np.isfinite(squares) & (squares < 1e100)
    return good & (squares > 1e-100) if metric.startswith("cosine") else good


def _first_copies(m: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of all vectors but equal ones after the ``k`` with the smallest ids: no query needs these."""
    odd = np.random.default_rng(1).integers(1, 1 << 62, m.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (np.ascontiguousarray(m).view(np.uint64) * odd).sum(1, dtype=np.uint64) if m.shape[1] else np.zeros(len(m), np.uint64)
    if len(np.unique(h)) == len(m):
        return np.arange(len(m))
    at = np.lexsort((order, h))
    new = np.ones(len(m), bool)
    new[1:] = (h[at][1:] != h[at][:-1]) | (m[at][1:] != m[at][:-1]).any(1)
    return at[np.arange(len(m)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]


def _left(m: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """The rows' side of a product of matrices, and their greatest square."""
    mm = (m * m).sum(1)
    if metric == "l2":
        return np.hstack([m, mm[:, None], np.ones((len(m), 1))]), mm.max()
    return m if metric == "dot" else m / np.sqrt(mm)[:, None], mm.max()


def _candidates(left: np.ndarray, most: float, q: np.ndarray, k: int, metric: str, slack: float, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) among which are each query's best ``k`` and those within ``slack``, but for what is beyond ``edge``: by a product of matrices, with a bound of its rounding."""
    size, qq = q.shape[1], (q * q).sum(1)
    if metric == "l2":
        right, err = np.hstack([-2 * q, np.ones((len(q), 1)), qq[:, None]]), (size + 8) * 2.0**-50 * (most + qq)
    elif metric == "dot":
        right, err = -q, (size + 8) * 2.0**-50 * np.sqrt(most * qq)
    else:
        right, err = -q / np.sqrt(qq)[:, None], np.full(len(q), (size + 8) * 2.0**-50)

    def bound(kth: np.ndarray, err: np.ndarray) -> np.ndarray:
        if metric != "l2":
            return kth + 2 * err + slack * (1 + 1e-9)
        return (np.sqrt(np.maximum(kth + err, 0)) + slack * (1 + 1e-9)) ** 2 * (1 + 1e-12) + err

    with np.errstate(over="ignore"):
        limit = bound(edge**2 if metric == "l2" else edge - 1 if metric == "cosine_distance" else edge, err)
    near = right @ left.T
    hit = near <= limit[:, None]
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * k)
    if len(many):
        some = near[many]
        kth = np.partition(some, k - 1, axis=1)[:, k - 1]
        hit[many] &= some <= bound(kth, err[many])[:, None]
    at = np.flatnonzero(hit)
    return at // len(left), at % len(left)


def nearest(docs: Lengths, asks: Lengths, ids: pa.Array, k: int, metric: str, larger: bool, best: Best) -> None:
    """Adds to ``best`` what each query needs of these rows. Vectors of another length, and zero ones by cosine, have no score and come last."""
    order = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()

    def put(q: np.ndarray, d: np.ndarray, score: np.ndarray) -> None:
        sign = -score if larger else score
        sign = np.where(np.isnan(sign), np.inf, sign)
        keep = sign <= best.edge[q] + best.slack
        best.add(q[keep], ids.take(pa.array(d[keep])), sign[keep], score[keep])

    for size, (places, q) in asks.items():
        rows, m = docs.get(size, (np.empty(0, np.int64), np.empty((0, size))))
        usual, calm = _plain(m, metric), np.flatnonzero(_plain(q, metric))
        near, odd = np.flatnonzero(usual), np.flatnonzero(~usual)
        near = near[_first_copies(m[near] if len(odd) else m, order[rows[near]], k)]
        step = max(256, TILE // max(1, size))
        for t in range(0, len(near), min(ROWS, step)):
            at = near[t : t + min(ROWS, step)]
            left, most = _left(m[at], metric)
            for i in range(0, len(calm), ASKS):
                part = calm[i : i + ASKS]
                x, y = _candidates(left, most, q[part], k, metric, best.slack, best.edge[places[part]])
                for j in range(0, len(x), step):
                    a, b = at[y[j : j + step]], part[x[j : j + step]]
                    put(places[b], rows[a], _pairs(m[a], q[b], metric))
            best.tighten()
        strange = np.setdiff1d(np.arange(len(q)), calm)
        for some, of in ((calm, odd), (strange, np.arange(len(m)))):
            for i in some if len(of) else ():
                put(np.full(len(of), places[i]), rows[of], _pairs(m[of], np.broadcast_to(q[i], (len(of), size)), metric))
        if len(rows) < len(order):  # of another length: wanted where fewer than k have a score
            others = np.setdiff1d(np.arange(len(order)), rows)
            others = others[np.argsort(order[others])[:k]]
            for i in places[np.isinf(best.edge[places])] if len(near) < k else ():
                put(np.full(len(others), i), others, np.full(len(others), np.nan))


# --- sparse vectors and texts -----------------------------------------------------------------------------------------


class Postings:
    """Queries as lists by index: which queries have it, with what weight. ``index`` numbers the indices from 0 without gaps."""

    def __init__(self, query: np.ndarray, index: np.ndarray, weight: np.ndarray, queries: int, indices: int) -> None:
        at = np.lexsort((query, index))
        self.query, self.weight, self.queries = query[at], weight[at], queries
        self.start = np.searchsorted(index[at], np.arange(indices + 1))

    def add(self, doc: np.ndarray, index: np.ndarray, weight: np.ndarray, ids: pa.Array, best: Best) -> None:
        """Adds to ``best`` the dot products of rows with the queries they share an index with. ``doc`` (places in ``ids``) ascends; each row's products are summed in the order given."""
        if not len(doc):
            return
        each = self.start[index + 1] - self.start[index]
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        made = np.cumsum(np.add.reduceat(each, begin))
        most = max(1, 2 * PRODUCTS // max(1, self.queries))
        i = 0
        while i < len(begin):
            j = max(i + 1, min(i + most, int(np.searchsorted(made, (made[i - 1] if i else 0) + PRODUCTS, "right"))))
            a, b = begin[i], begin[j] if j < len(begin) else len(doc)
            self._tile(doc[begin[i:j]], np.repeat(np.arange(j - i), np.diff(np.r_[begin[i:j], b])), index[a:b], weight[a:b], each[a:b], ids, best)
            i = j

    def _tile(self, places: np.ndarray, row: np.ndarray, index: np.ndarray, weight: np.ndarray, each: np.ndarray, ids: pa.Array, best: Best) -> None:
        of = np.repeat(np.arange(len(row)), each)
        at = np.arange(len(of)) + np.repeat(self.start[index] - (np.cumsum(each) - each), each)
        cell = row[of] * self.queries + self.query[at]
        score = np.bincount(cell, weight[of] * self.weight[at], minlength=len(places) * self.queries)
        hit = np.zeros(len(score), bool)
        hit[cell] = True
        sign = np.where(np.isnan(score), -np.inf, -score).reshape(len(places), self.queries)
        r, q = np.nonzero(hit.reshape(sign.shape) & (sign <= best.edge + best.slack))
        best.add(q, ids.take(pa.array(places[r])), sign[r, q], score.reshape(sign.shape)[r, q])


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of rows with vectors ``v``, of about a tile's values each."""
    for b in slices(batches, ROWS):
        values = pc.sum(pc.list_value_length(b.column("v"))).as_py() or 0
        yield from slices(iter([b]), max(256, TILE * b.num_rows // max(1, values)))
