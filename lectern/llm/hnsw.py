"""A small-world graph over one shard of vectors, held in flat neighbour arrays.

The graph is the hierarchical navigable small-world graph of Malkov and
Yashunin: nodes have a geometric level, each level is a padded ``int32`` array
``[nodes, degree]`` of neighbour positions (-1 where empty), a search descends
greedily through the upper levels and then walks level 0 with a beam.  Inserts
and searches run for a batch of vectors at a time, so that every step is a few
numpy calls on the batch; members of one insert batch, which cannot meet in the
graph, are compared with each other directly on the upper levels.  On level 0
every node is compared with those of its cell, a few hundred nodes about one of
the centroids of the graph: in a large graph of mostly unlike vectors a walk
seldom comes upon the few that are alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = np.float32(-np.inf)
#: Nodes that a descent hands to the level below.
ENTRIES = 3
#: Queries times points that one step of a walk keeps in memory.
SEEN = 1 << 21
#: Nodes of a cell of the graph on average.
CELL = 512


@dataclass
class Graph:
    """``points`` are unit rows; ``levels[l]`` is (positions, neighbours)."""

    points: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    slots: list[np.ndarray]  # per level: position -> row in that level's array
    entry: int
    full: np.ndarray  # the points as cells compare them
    centres: np.ndarray  # of the cells
    cells: list[np.ndarray]  # positions


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of length zero stay zero."""
    rows = np.ascontiguousarray(rows, dtype=np.float32)
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
    return (rows / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of ``sample`` (unit rows) by spherical k-means."""
    random = np.random.default_rng(seed)
    cells = max(1, min(cells, len(sample)))
    centres = sample[random.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds if cells > 1 else 0):
        near = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        empty = np.bincount(near, minlength=cells) == 0
        total[empty] = sample[random.choice(len(sample), int(empty.sum()))]
        centres = unit(total)
    return centres


def _nearest(rows, centres):
    return np.concatenate([(rows[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)


def _cells(points: np.ndarray, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centroids of small cells of the points and the positions in each, or in
    one part of it where a cell has more than four times the average."""
    n = len(points)
    if n <= 2 * CELL:
        return points[:1], [np.arange(n)]
    wanted = n // CELL
    sample = points[np.random.default_rng(seed).choice(n, min(n, 32 * wanted), replace=False)]
    centres = fit_centroids(sample, wanted, rounds=4, seed=seed)
    home = _nearest(points, centres)
    out, of = [], []
    for c, members in enumerate(np.split(np.argsort(home, kind="stable"), np.cumsum(np.bincount(home, minlength=len(centres)))[:-1])):
        for part in np.array_split(members, -(-len(members) // (4 * CELL))) if len(members) else []:
            out.append(part)
            of.append(c)
    return centres[of], out


def _best(rows: np.ndarray, points: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The ``k`` nearest points of each row (not itself), in no order; -1 beyond."""
    sims = rows @ points.T
    if own:
        np.fill_diagonal(sims, NEVER)
    out = np.full((len(rows), k), -1, dtype=np.int32)
    k = min(k, len(points) - own)
    if k > 0:
        out[:, :k] = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k :]
    return out


def _beam(points, queries, links, slot, start, start_sim, width, expand):
    """Walk one level from ``start`` ([b, s] positions); the best ``width`` seen.

    What has been seen takes a byte and a number per query and point: many
    queries go in runs that keep this small."""
    b, n = len(queries), len(points)
    run = max(32, SEEN // max(1, n))
    if b > run:
        parts = [_beam(points, queries[i : i + run], links, slot, start[i : i + run], start_sim[i : i + run], width, expand) for i in range(0, b, run)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    rows = np.arange(b)[:, None]
    # flat [b, n]; ``claim`` is read only where it has just been written
    seen, claim = np.zeros(b * n, dtype=bool), np.empty(b * n, dtype=np.int32)
    ids = np.full((b, width), -1, dtype=np.int32)
    sims = np.full((b, width), NEVER, dtype=np.float32)
    done = np.zeros((b, width), dtype=bool)
    s = min(start.shape[1], width)
    order = np.argsort(-start_sim, axis=1)[:, :s]
    ids[:, :s] = start[rows, order]
    sims[:, :s] = start_sim[rows, order]
    sims[ids < 0] = NEVER
    seen[(ids + rows * n)[ids >= 0]] = True
    live = np.arange(b)
    expand = min(expand, width)
    while len(live):
        open_sims = np.where(done[live], NEVER, sims[live])
        pick = np.argpartition(open_sims, width - expand, axis=1)[:, width - expand :] if expand < width else np.tile(np.arange(width), (len(live), 1))
        usable = open_sims[rows[: len(live)], pick] > NEVER
        going = usable.any(1)
        if not going.all():
            live, pick, usable = live[going], pick[going], usable[going]
            if not len(live):
                break
        done[live[:, None], pick] |= usable
        near = links[slot[np.where(usable, ids[live[:, None], pick], 0)]]
        near[~usable] = -1
        near = near.reshape(len(live), -1)
        spot = near + live[:, None] * n
        at = np.flatnonzero((near >= 0) & ~seen[np.maximum(spot, 0)])
        spot = spot.ravel()[at]
        # one neighbour may be reached from two expanded nodes at once
        claim[spot] = np.arange(len(at), dtype=np.int32)
        first = claim[spot] == np.arange(len(at), dtype=np.int32)
        at, spot = at[first], spot[first]
        if not len(at):
            continue
        seen[spot] = True
        found = np.full(near.shape, NEVER, dtype=np.float32)
        found.ravel()[at] = np.einsum("ij,ij->i", points[near.ravel()[at]], queries[live[at // near.shape[1]]])
        both_sims = np.concatenate([sims[live], found], axis=1)
        top = np.argpartition(both_sims, both_sims.shape[1] - width, axis=1)[:, both_sims.shape[1] - width :]
        of = rows[: len(live)]
        sims[live] = both_sims[of, top]
        done[live] = np.concatenate([done[live], np.zeros(near.shape, dtype=bool)], axis=1)[of, top]
        ids[live] = np.concatenate([ids[live], near], axis=1)[of, top]
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = sims[rows, order]
    ids = np.where(sims > NEVER, ids[rows, order], -1)
    return ids, sims


def _choose(points, ids, sims, degree):
    """The diversity rule: take a candidate only if it is nearer to the node
    than to every neighbour taken before it; candidates come best first."""
    b, k = ids.shape
    safe = np.where(ids >= 0, ids, 0)
    rows = points[safe]
    between = np.matmul(rows, rows.transpose(0, 2, 1))
    blocked = ids < 0
    taken = np.zeros((b, k), dtype=bool)
    count = np.zeros(b, dtype=np.int32)
    for i in range(k):
        take = ~blocked[:, i] & (count < degree)
        taken[:, i] = take
        count += take
        blocked |= take[:, None] & (between[:, i, :] >= sims) & (np.arange(k) > i)
    # room that the rule leaves is filled with the nearest of the rest
    rest = ~taken & (ids >= 0)
    room = (np.cumsum(rest, axis=1) <= (degree - count)[:, None]) & rest
    taken |= room
    order = np.argsort(~taken, axis=1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(taken, order, 1), np.take_along_axis(ids, order, 1), -1)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def _link_back(points, links, slot, new, chosen, degree):
    """Add the reverse of the edges ``new -> chosen`` and prune full nodes."""
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    keep = target >= 0
    source, target = source[keep], target[keep]
    if not len(source):
        return
    # nearest first, so that what does not fit below is the farthest
    order = np.lexsort((-np.einsum("ij,ij->i", points[source], points[target]), target))
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, count)
    wide = min(int(count.max()), 4 * degree)
    extra = np.full((len(nodes), wide), -1, dtype=np.int32)
    ok = rank < wide
    extra[np.repeat(np.arange(len(nodes)), count)[ok], rank[ok]] = source[ok]
    have = links[slot[nodes]]
    both = np.concatenate([have, extra], axis=1)
    full = (both >= 0).sum(1) > degree
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    links[slot[nodes[~full]]] = packed[~full][:, :degree]
    if full.any():
        ids, of = packed[full], nodes[full]
        sims = np.einsum("ijk,ik->ij", points[np.where(ids >= 0, ids, 0)], points[of])
        sims[ids < 0] = NEVER
        order = np.argsort(-sims, axis=1, kind="stable")
        links[slot[of]] = _choose(points, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), degree)


def _batches(n: int, small: int, above: int):
    """Insert batches: they double until they are a sixth of all; none has nodes
    on both sides of ``above``."""
    at = 0
    while at < n:
        step = min(max(small, min(at, n // 6)), (above if at < above else n) - at)
        yield at, at + step
        at += step


def build(points: np.ndarray, degree: int = 12, width: int = 32, expand: int = 4, seed: int = 7, full: np.ndarray | None = None) -> Graph:
    """Insert all rows of ``points`` (unit rows), batch by batch.

    ``degree`` is M: upper levels keep M neighbours a node, level 0 twice as
    many; ``width`` is the beam of the insert search.  ``full`` has the unit
    rows of which ``points`` are projections, if they are.
    """
    n = len(points)
    full = points if full is None else full
    centres, cells = _cells(full, seed)
    mates = np.full((n, degree), -1, dtype=np.int32)
    for c in cells:
        got = _best(full[c], full[c], degree, True)
        mates[c] = np.where(got >= 0, c[got], -1)
    random = np.random.default_rng(seed)
    tall = np.minimum((-np.log(1 - random.random(n)) / np.log(max(2, degree))).astype(int), 6) if n else np.zeros(0, int)
    # tall nodes first, so that a level begins with the nodes of the level above
    order = random.permutation(n)
    order = order[np.argsort(-tall[order], kind="stable")]
    top = int(tall.max()) if n else 0
    levels, slots = [], []
    for level in range(top + 1):
        ids = order[tall[order] >= level]
        slot = np.full(n, -1, dtype=np.int32)
        slot[ids] = np.arange(len(ids), dtype=np.int32)
        levels.append((ids, np.full((len(ids), degree * (2 if level == 0 else 1)), -1, dtype=np.int32)))
        slots.append(slot)
    # where the search of a node enters the level below, from the top down
    entry = np.full((n, ENTRIES), -1, dtype=np.int32)
    for level in range(top, -1, -1):
        ids, links = levels[level]
        room, above = links.shape[1], len(levels[level + 1][0]) if level < top else 0
        for lo, hi in _batches(len(ids), 64, above):
            new = ids[lo:hi]
            if level:
                got = _best(points[new], points[new], degree, True)
                cand = np.where(got >= 0, new[got], -1).astype(np.int32)
            else:
                cand = mates[new]
            sims = np.where(cand >= 0, np.einsum("ijk,ik->ij", points[cand], points[new]), NEVER)
            if lo:
                # nodes of the level above come first and have no entry from there: they
                # start at a handful of nodes inserted before
                start = entry[new] if lo >= above > 0 else np.tile(ids[np.linspace(0, lo - 1, min(lo, 16)).astype(int)].astype(np.int32), (len(new), 1))
                start_sim = np.where(start >= 0, np.einsum("ijk,ik->ij", points[start], points[new]), NEVER)
                found, found_sims = _beam(points, points[new], links, slots[level], start, start_sim, width, expand)
                if not level:  # cells also hold nodes inserted before
                    sims[(cand[:, :, None] == found[:, None, :]).any(2)] = NEVER
                cand, sims = np.concatenate([found, cand], 1), np.concatenate([found_sims, sims], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : max(width, 1)]
            cand, sims = np.take_along_axis(cand, best, 1), np.take_along_axis(sims, best, 1)
            cand = np.where(sims > NEVER, cand, -1)
            chosen = _choose(points, cand, sims, degree)
            # links from nodes of its cell that came before stay while there is room
            have = links[slots[level][new]]
            have[(have[:, :, None] == chosen[:, None, :]).any(2)] = -1
            both = np.concatenate([chosen, have], axis=1)
            links[slots[level][new]] = both[np.arange(len(new))[:, None], np.argsort(both < 0, axis=1, kind="stable")][:, :room]
            _link_back(points, links, slots[level], new, chosen, room)
        # all nodes that are not of this level descend through it
        rest = order[len(ids) :] if level else order[:0]
        for lo in range(0, len(rest), 512):
            new = rest[lo : lo + 512]
            start = entry[new] if level < top else np.full((len(new), 1), ids[0], dtype=np.int32)
            start_sim = np.where(start >= 0, np.einsum("ijk,ik->ij", points[start], points[new]), NEVER)
            entry[new] = _beam(points, points[new], links, slots[level], start, start_sim, ENTRIES, 2)[0]
    return Graph(points, levels, slots, int(levels[-1][0][0]) if n else -1, full, centres, cells)


def search(graph: Graph, queries: np.ndarray, width: int = 32, expand: int = 4, own: np.ndarray | None = None, batch: int = 512, full: np.ndarray | None = None):
    """Best ``width`` (positions, similarities) of each query, best first.

    ``own`` gives, for queries that are nodes themselves, their position: the
    walk then starts there.  Others descend from the top level and also start at
    the nearest nodes of the cell they fall into; ``full`` has the rows of which
    they are projections, if they are.
    """
    full = queries if full is None else full
    out_ids, out_sims = [], []
    for lo in range(0, len(queries), batch):
        q = queries[lo : lo + batch]
        if own is not None:
            start = own[lo : lo + batch].astype(np.int32)[:, None]
        else:
            start = np.full((len(q), 1), graph.entry, dtype=np.int32)
            for level in range(len(graph.levels) - 1, 0, -1):
                sim = np.einsum("ijk,ik->ij", graph.points[start], q)
                start, _ = _beam(graph.points, q, graph.levels[level][1], graph.slots[level], start, sim, min(4, max(1, width)), 2)
                start = np.where(start >= 0, start, start[:, :1])
            home, near = _nearest(full[lo : lo + batch], graph.centres), np.full((len(q), ENTRIES), -1, dtype=np.int32)
            for c in np.unique(home):
                at = np.nonzero(home == c)[0]
                got = _best(full[lo + at], graph.full[graph.cells[c]], ENTRIES, False)
                near[at] = np.where(got >= 0, graph.cells[c][got], -1)
            start = np.concatenate([start, np.where(near >= 0, near, start[:, :1])], axis=1)
        sim = np.einsum("ijk,ik->ij", graph.points[start], q)
        same = np.sort(start, axis=1)
        if start.shape[1] > 1:
            dup = np.zeros(start.shape, dtype=bool)
            dup[:, 1:] = (start[:, 1:, None] == start[:, None, :-1]).any(2) & (same[:, 1:] >= -1)
            for j in range(1, start.shape[1]):
                dup[:, j] = (start[:, j, None] == start[:, :j]).any(1)
            sim = np.where(dup, NEVER, sim)
            start = np.where(dup, -1, start)
        ids, sims = _beam(graph.points, q, graph.levels[0][1], graph.slots[0], start, sim, width, expand)
        out_ids.append(ids)
        out_sims.append(sims)
    if not out_ids:
        return np.zeros((0, width), np.int32), np.zeros((0, width), np.float32)
    return np.concatenate(out_ids), np.concatenate(out_sims)
