"""A directed proximity graph over unit vectors: batched insertion, robust pruning, beam search.

Everything works on batches of vectors at once, in numpy, inside one task.
"""

from __future__ import annotations

import numpy as np

#: A place of a beam that holds no node; like every odd number it counts as expanded.
NOBODY = np.int64((1 << 63) - 1)
#: Steps of the similarity in the number that orders a beam.
FINE = np.float32(1 << 24)


def _ordered(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Numbers that sort by similarity descending, then id; the lowest bit says "expanded"."""
    return (((np.float32(1.5) - sims) * FINE).astype(np.int64) << np.int64(34)) | (ids.astype(np.int64) << np.int64(1))


def _ids(beam: np.ndarray) -> np.ndarray:
    return ((beam >> np.int64(1)) & np.int64((1 << 33) - 1)).astype(np.int32)


class ProximityGraph:
    """X: unit vectors, float32, at least one row. degree: edges left by pruning; a node is pruned
    again when back edges have filled half as many places more. beam: width of searches; slack: an edge is
    dropped if a kept neighbour is `slack` times nearer to its end."""

    def __init__(self, X: np.ndarray, degree: int = 16, beam: int = 24, slack: float = 1.2, batch: int = 512, entries: int = 1024):
        n = len(X)
        self.X = np.concatenate([np.asarray(X, np.float32), np.zeros((1, X.shape[1]), np.float32)])  # row n: no node
        self.degree, self.beam, self.slack = degree, beam, np.float32(slack)
        self.nobody = n
        self.out = np.full((n + 1, degree + degree // 2), n, np.int32)
        self.used = np.zeros(n + 1, np.int32)
        rest = np.random.default_rng(7).permutation(n).astype(np.int32)
        self.starts = rest[:entries]  # a search begins at the nearest of them
        done, size = 0, min(entries, 64)
        while done < n:  # every batch is linked to what stands and to its own members
            self._insert(rest[done : done + size], done)
            done, size = done + size, min(batch, 2 * size)

    def search(self, Q: np.ndarray, own: np.ndarray | None = None, standing: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the `beam` best found for each query, best first; -1 where fewer.
        own: the node that the query itself is, or -1; the search begins there too. standing: nodes inserted so far."""
        width, X, out, nobody, m = self.beam, self.X, self.out, self.nobody, len(Q)
        starts = self.starts[:standing]
        few = min(4, len(starts))
        sims = Q @ X[starts].T
        best = np.argpartition(-sims, few - 1, axis=1)[:, :few] if few < len(starts) else np.tile(np.arange(few), (m, 1))
        beam = np.full((m, width), NOBODY, np.int64)
        seen = np.zeros((m, nobody + 1), bool)
        seen[:, nobody] = True
        rows = np.arange(m)
        beam[:, :few] = _ordered(np.take_along_axis(sims, best, 1), starts[best])
        seen[rows[:, None], starts[best]] = True
        if own is not None and width > few:
            fresh = (own >= 0) & ~seen[rows, own]
            r = rows[fresh]
            beam[r, few] = _ordered(np.einsum("ij,ij->i", Q[r], X[own[r]]), own[r])
            seen[r, own[r]] = True
        beam.sort(axis=1)
        flat = seen.reshape(-1)
        row = rows
        while True:
            B = beam[row]
            closed = (B & 1).astype(bool)
            at = np.argmin(closed, axis=1)  # sorted by similarity, so the first open one is the best
            k = np.arange(len(row))
            open_ = ~closed[k, at]
            if not open_.all():
                row, B, at = row[open_], B[open_], at[open_]
                if not len(row):
                    break
                k = np.arange(len(row))
            B[k, at] |= 1
            near = out[_ids(B[k, at])]
            place = row[:, None] * np.int64(nobody + 1) + near
            i, j = np.nonzero(~flat[place])
            flat[place[i, j]] = True
            node = near[i, j]
            every = np.full((len(row), width + near.shape[1]), NOBODY, np.int64)
            every[:, :width] = B
            every[i, width + j] = _ordered(np.einsum("ij,ij->i", X[node], Q[row[i]]), node)
            every.sort(axis=1)
            beam[row] = every[:, :width]
        none = beam == NOBODY
        ids = np.where(none, -1, _ids(beam))
        return ids, np.where(none, np.float32(-2), np.float32(1.5) - (beam >> np.int64(34)).astype(np.float32) / FINE)

    def _prune(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """At most `degree` edges of points from candidates (`nobody` for none): near ones first,
        each sparing only those that no kept neighbour is much nearer to."""
        X, nobody = self.X, self.nobody
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = nobody
        V = X[cand]
        far = 1 - np.matmul(V, X[points][:, :, None])[:, :, 0]
        far[(cand == nobody) | (cand == points[:, None])] = np.inf
        order = np.argsort(far, axis=1)
        cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
        last = int(np.isfinite(far).sum(axis=1).max(initial=0))
        cand, far, V = cand[:, :last], far[:, :last], np.take_along_axis(V, order[:, :last, None], 1)
        hides = self.slack * (1 - np.matmul(V, V.transpose(0, 2, 1))) <= far[:, None, :]  # kept i hides j
        alive = np.isfinite(far)
        room = np.full(len(points), self.degree)
        kept = np.zeros_like(alive)
        for i in range(last):  # by distance, so every candidate is looked at once
            take = alive[:, i] & (room > 0)
            kept[:, i] = take
            room -= take
            alive &= ~(hides[:, i] & take[:, None])
        out = np.full((len(points), self.degree), nobody, np.int32)
        i, j = np.nonzero(kept)
        out[i, (np.cumsum(kept, axis=1) - 1)[i, j]] = cand[i, j]
        return out

    def _set(self, points: np.ndarray, edges: np.ndarray) -> None:
        self.out[points] = self.nobody
        self.out[points, : edges.shape[1]] = edges
        self.used[points] = (edges != self.nobody).sum(axis=1)

    def _insert(self, points: np.ndarray, standing: int) -> None:
        among = self.X[points] @ self.X[points].T
        np.fill_diagonal(among, -2)
        few = min(8, len(points) - 1)
        cand = points[np.argpartition(-among, max(0, few - 1), axis=1)[:, :few]]
        if standing:
            found, _ = self.search(self.X[points], standing=standing)
            cand = np.concatenate([np.where(found < 0, self.nobody, found), cand], axis=1)
        if cand.shape[1]:
            self._set(points, self._prune(points, cand.astype(np.int32)))
        self._link_back(points)

    def _link_back(self, points: np.ndarray) -> None:
        """The edges of points the other way round. A node without room is pruned with all that is new to it."""
        edges = self.out[points]
        i, j = np.nonzero(edges != self.nobody)
        a, b = points[i], edges[i, j]
        known = (self.out[b] == a[:, None]).any(axis=1)
        a, b = a[~known], b[~known]
        most = self.out.shape[1]
        while len(b):
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            ends, begin, count = np.unique(b, return_index=True, return_counts=True)
            nth = np.arange(len(b)) - np.repeat(begin, count)
            room = most - self.used[b]
            fits = nth < room
            self.out[b[fits], self.used[b[fits]] + nth[fits]] = a[fits]
            self.used[ends] = np.minimum(most, self.used[ends] + count)
            a, b = a[~fits], b[~fits]
            full = np.unique(b)  # make room and go on with those that found none
            for lo in range(0, len(full), 1024):
                part = full[lo : lo + 1024]
                self._set(part, self._prune(part, self.out[part]))
