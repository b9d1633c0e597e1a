"""A hierarchical navigable small-world graph that inserts and searches whole batches with numpy."""

from __future__ import annotations

import numpy as np

BATCH = 512


class Graph:
    """Layers of neighbour lists over unit vectors; similarity is the dot product in single precision.

    Levels are geometric with a fixed seed. A batch is searched layer by layer from the entry point with a beam per
    vector, all beams advancing at once; the batch's vectors are candidates of each other too. Neighbours are chosen
    for variety (nearer to the vector than to any chosen before), then filled up with the nearest rest.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 12, beam: int = 64, seed: int = 1):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.degree, n = degree, len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(degree)).astype(int), 6)
        if n:
            self.level[0] = self.level.max()
        top = int(self.level.max()) if n else 0
        self.row = [np.full(n, -1, dtype=np.int32) for _ in range(top + 1)]
        self.near = []
        for k in range(top + 1):
            members = np.flatnonzero(self.level >= k)
            self.row[k][members] = np.arange(len(members))
            self.near.append(np.full((len(members), 2 * degree if k == 0 else degree), -1, dtype=np.int32))
        at, size = min(1, n), 32
        while at < n:  # the first batches are small, so that there is a graph to search
            self._insert(np.arange(at, min(n, at + size)), beam)
            at, size = at + size, min(BATCH, size * 2)
        self._connect(beam)

    def _reached(self) -> np.ndarray:
        """Which vectors the lowest layer's lists lead to from the entry point."""
        seen, new = np.zeros(len(self.x), dtype=bool), np.zeros(min(1, len(self.x)), dtype=np.int64)
        while len(new):
            seen[new] = True
            near = np.unique(self.near[0][new])
            new = near[(near >= 0)]
            new = new[~seen[new]]
        return seen

    def _connect(self, beam: int, extra: int = 8) -> None:
        """Lists crowded by equal vectors can leave others behind: each is added to the list of the nearest that is reached."""
        while not (seen := self._reached()).all():
            lost = np.flatnonzero(~seen)
            nearest = np.concatenate([self.search(self.x[lost[k : k + BATCH]], beam)[0][:, 0] for k in range(0, len(lost), BATCH)])
            order = np.argsort(nearest, kind="stable")
            lost, nearest = lost[order], nearest[order]
            _, first, count = np.unique(nearest, return_index=True, return_counts=True)
            place = np.arange(len(lost)) - np.repeat(first, count)
            more = np.full((len(self.x), extra), -1, dtype=np.int32)
            fits = place < extra
            more[nearest[fits], place[fits]] = lost[fits]
            self.near[0] = np.concatenate([self.near[0], more[:, : int(place[fits].max()) + 1]], axis=1)

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, -1 where a beam isn't full."""
        b, n = len(q), len(self.x)
        near, row = self.near[layer], self.row[layer]
        seen = np.zeros((b, n + 1), dtype=bool)
        width = max(beam, entry.shape[1])
        ids = np.full((b, width), -1, dtype=np.int32)
        sims = np.full((b, width), -np.inf, dtype=np.float32)
        ids[:, : entry.shape[1]] = entry
        held = entry >= 0
        sims[:, : entry.shape[1]] = np.where(held, np.einsum("bd,bkd->bk", q, self.x[entry]), -np.inf)
        np.put_along_axis(seen, np.where(held, entry, n), True, axis=1)
        done = ids < 0
        while True:
            open_ = np.where(done, -np.inf, sims)
            best = open_.argmax(axis=1)
            live = np.flatnonzero(open_[np.arange(b), best] > -np.inf)
            if not len(live):
                break
            done[live, best[live]] = True
            new = near[row[ids[live, best[live]]]]
            fresh = (new >= 0) & ~seen[live[:, None], new]
            seen[live[:, None], np.where(fresh, new, n)] = True
            s = np.where(fresh, np.matmul(self.x[new], q[live][:, :, None])[:, :, 0], -np.inf)
            all_s = np.concatenate([sims[live], s], axis=1)
            keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            take = lambda x: np.take_along_axis(x, keep, axis=1)
            sims[live] = take(all_s)
            ids[live] = take(np.concatenate([ids[live], np.where(fresh, new, -1)], axis=1))
            done[live] = take(np.concatenate([done[live], ~fresh], axis=1))
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def _choose(self, base: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of candidates (rows of ids, -1 for none) up to `most` neighbours for each base vector."""
        out = np.full((len(ids), most), -1, dtype=np.int32)
        for at in range(0, len(ids), 1024):
            out[at : at + 1024] = self._choose_some(base[at : at + 1024], ids[at : at + 1024], most)
        return out

    def _choose_some(self, base: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        v = self.x[ids]
        s = np.where(ids >= 0, np.matmul(v, base[:, :, None])[:, :, 0], -np.inf)
        order = np.argsort(-s, axis=1)
        ids, s = np.take_along_axis(ids, order, axis=1), np.take_along_axis(s, order, axis=1)
        v = np.take_along_axis(v, order[:, :, None], axis=1)
        between = np.matmul(v, v.transpose(0, 2, 1))
        n, k = ids.shape
        kept = np.zeros((n, k), dtype=bool)
        closest = np.full((n, k), -np.inf, dtype=np.float32)  # to any kept so far
        for c in range(k):
            kept[:, c] = (s[:, c] > closest[:, c]) & (s[:, c] > -np.inf) & (kept.sum(axis=1) < most)
            closest = np.where(kept[:, c, None], np.maximum(closest, between[:, c, :]), closest)
        rank = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)) * k + np.arange(k)[None, :], axis=1)[:, :most]
        chosen = np.take_along_axis(ids, rank, axis=1)
        return np.pad(chosen, ((0, 0), (0, max(0, most - chosen.shape[1]))), constant_values=-1)

    def _insert(self, new: np.ndarray, beam: int) -> None:
        q = self.x[new]
        entry = np.zeros((len(new), 1), dtype=np.int32)
        for layer in range(len(self.near) - 1, -1, -1):
            found, _ = self._beam(layer, q, entry, beam if layer == 0 else min(beam, 24))
            entry = found[:, : 1 if layer > 1 else 4]
            own = np.flatnonzero(self.level[new] >= layer)
            if not len(own):
                continue
            mates = new[own]
            s = q[own] @ q[own].T
            np.fill_diagonal(s, -np.inf)
            k = min(len(own) - 1, 2 * self.degree)
            inside = mates[np.argsort(-s, axis=1)[:, :k]].astype(np.int32) if k > 0 else np.zeros((len(own), 0), np.int32)
            near, row, cap = self.near[layer], self.row[layer], self.near[layer].shape[1]
            chosen = self._choose(q[own], np.concatenate([found[own][:, : 3 * self.degree], inside], axis=1), self.degree)
            near[row[mates], : self.degree] = chosen
            self._link_back(mates, chosen, near, row, cap)

    def _link_back(self, mates: np.ndarray, chosen: np.ndarray, near: np.ndarray, row: np.ndarray, cap: int) -> None:
        to, source = chosen.ravel(), np.repeat(mates, chosen.shape[1]).astype(np.int32)
        held = to >= 0
        to, source = to[held], source[held]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        most = min(int(count.max(initial=1)), 2 * cap)
        place = np.arange(len(to)) - np.repeat(first, count)
        more = np.full((len(nodes), most), -1, dtype=np.int32)
        ok = place < most
        more[np.repeat(np.arange(len(nodes)), count)[ok], place[ok]] = source[ok]
        joined = np.concatenate([near[row[nodes]], more], axis=1)
        # a mate that chose this node and was chosen by it must not appear twice
        order = np.argsort(joined, axis=1)
        values = np.take_along_axis(joined, order, axis=1)
        twice = np.zeros_like(joined, dtype=bool)
        np.put_along_axis(twice, order[:, 1:], (values[:, 1:] == values[:, :-1]), axis=1)
        joined = np.where(twice, -1, joined)
        joined = np.take_along_axis(joined, np.argsort(joined < 0, axis=1, kind="stable"), axis=1)
        full = (joined >= 0).sum(axis=1) > cap
        result = joined[:, :cap].copy()
        if full.any():
            result[full] = self._choose(self.x[nodes[full]], joined[full], cap)
        near[row[nodes]] = result

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest (ids, similarities) of each query, best first."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        entry = np.zeros((len(q), 1), dtype=np.int32)
        for layer in range(len(self.near) - 1, -1, -1):
            ids, sims = self._beam(layer, q, entry, beam if layer == 0 else 16)
            entry = ids[:, : 1 if layer > 1 else 4]
        return ids, sims
