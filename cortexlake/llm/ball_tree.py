"""Ball trees over whole-number vectors: the best inner products inside windows of scores.

A node is a ball around its rows' mean. A row's product with a query lies within |query| * radius of the centre's, so a ball bounds
it above and below. A ball is left out for a query where no window of the query meets these bounds, where all that it could
add ranks behind the k-th row that a window has already, or where none of its labels is asked for.
"""

from __future__ import annotations

import numpy as np

LEAF = 128
#: Numbers with a product below this are exact as doubles, and a score and a rank fit one long.
_EXACT = 1 << 44
NONE = -(1 << 62)


def whole(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    """Rows of whole numbers, shorter vectors with zeros: doubles where their products are exact, else Python's integers."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    most = int(np.abs(out.astype(np.float64)).max(initial=0)) + 1
    return out.astype(np.float64) if most * most * max(dim, 1) < _EXACT else out.astype(object)


class BallTree:
    """Rows in the order of ``rank`` (0 is best among equal scores), their labels and vectors."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray, rank: np.ndarray):
        self.exact, self.labels, self.rows, self.rank = vectors, labels, rows, rank
        self.near = vectors.astype(np.float64)
        self.nodes: list[tuple] = []
        self.order = np.arange(len(rows))
        if len(rows):
            self._grow(0, len(rows))

    def _grow(self, lo: int, hi: int) -> int:
        here = self.order[lo:hi]
        points = self.near[here]
        centre = points.mean(0)
        away = np.sqrt(((points - centre) ** 2).sum(1))
        at = len(self.nodes)
        self.nodes.append(())
        kids: tuple[int, ...] = ()
        if hi - lo > LEAF:
            far = points[away.argmax()]
            other = points[((points - far) ** 2).sum(1).argmax()]
            half = (hi - lo) // 2
            self.order[lo:hi] = here[np.argpartition(points @ (far - other), half)]
            kids = (self._grow(lo, lo + half), self._grow(lo + half, hi))
        labels = self.labels[here]
        self.nodes[at] = (lo, hi, centre, float(away.max()), int(labels.min()), int(labels.max()), kids)
        return at

    def best(self, queries: np.ndarray, labels: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """For each query and window: the best ``k`` rows with a score from ``low`` to ``high``, not below ``floor``.

        ``same`` asks for rows of the query's own label, without the row itself; else for those of other labels. Returns, one
        element for each row found: the query, the window, the row's place here, and its score.
        """
        wide = queries.dtype == object or self.exact.dtype == object
        kind = object if wide else np.int64
        span = len(self.rows) + 1
        top = np.full((*low.shape, k), NONE, kind)
        floor = floor.astype(kind)
        q = queries.astype(np.float64)
        norm = np.sqrt((q**2).sum(1))

        def visit(at: int, which: np.ndarray) -> None:
            lo, hi, centre, radius, least, most, kids = self.nodes[at]
            middle, reach = q[which] @ centre, norm[which] * radius
            reach = reach + 1e-9 * (np.abs(middle) + norm[which] * np.sqrt(centre @ centre) + reach) + 1
            up, down = middle + reach, middle - reach
            kth = np.where(top[which, :, -1] == NONE, floor[which], np.maximum(floor[which], top[which, :, -1] // span))
            useful = ((up[:, None] >= np.maximum(low[which], kth)) & (down[:, None] <= high[which])).any(1)
            useful &= (labels[which] >= least) & (labels[which] <= most) if same else ~((labels[which] == least) & (least == most))
            which = which[useful]
            if not len(which):
                return
            if kids:
                first = sorted(kids, key=lambda x: -float((q[which] @ self.nodes[x][2]).sum()))
                for kid in first:
                    visit(kid, which)
                return
            here = self.order[lo:hi]
            score = (queries[which].astype(object) @ self.exact[here].astype(object).T) if wide else (q[which] @ self.near[here].T).astype(np.int64)
            fits = (labels[which][:, None] == self.labels[here]) == same
            if same:
                fits &= rows[which][:, None] != self.rows[here]
            key = score * span + (len(self.rows) - self.rank[here])
            for w in range(low.shape[1]):
                inside = fits & (score >= np.maximum(low[which, w], floor[which, w])[:, None]) & (score <= high[which, w][:, None])
                some = inside.any(1)
                if some.any():
                    both = np.concatenate([top[which[some], w], np.where(inside[some], key[some], NONE)], axis=1)
                    top[which[some], w] = np.sort(both, axis=1)[:, : -k - 1 : -1]

        if len(self.rows):
            visit(0, np.arange(len(queries)))
        at, window, place = np.nonzero(top != NONE)
        found = top[at, window, place]
        by_rank = np.empty(span, np.int64)
        by_rank[self.rank] = np.arange(len(self.rows))
        return at, window, by_rank[(len(self.rows) - found % span).astype(np.int64)], found // span
