"""Wilson's algorithm one step at a time, as a reference for the samplers: ``walk`` on arrays, ``forests`` on a graph."""

from bisect import bisect_right
from hashlib import md5

import numpy as np


def walk(ids, offsets, targets, cum, deg, q, seed, rep, level):
    """Next vertex (-1 for a root) and root of each vertex; ``level`` is moved on in place."""
    ids, offsets, targets, cum, deg, q, high = (x.tolist() for x in (ids, offsets, targets, cum, deg, q, level))
    n, hash_, number = len(ids), md5, int.from_bytes
    nxt, root = [-2] * n, [-1] * n
    place = [-1] * n  # in the path that is walked now
    for start in range(n):
        path, i = [], start
        while root[i] < 0:
            if place[i] >= 0:  # a cycle: its vertices lose their top arrows
                at = place[i]
                for x in path[at:]:
                    high[x] += 1
                    place[x] = -1
                del path[at:]
            place[i] = len(path)
            path.append(i)
            key = f"|{seed}|{rep}|{ids[i]}|{high[i]}"
            d = deg[i]
            if (number(hash_(f"u{key}".encode()).digest()[:7], "big") >> 4) / 2**52 * (q[i] + d) < q[i]:
                nxt[i], root[i] = -1, i
                break
            t = (number(hash_(f"v{key}".encode()).digest()[:7], "big") >> 4) / 2**52 * d
            b = offsets[i + 1]
            nxt[i] = targets[min(bisect_right(cum, t, offsets[i], b), b - 1)]
            i = nxt[i]
        end = root[i]
        for x in path:
            root[x], place[x] = end, -1
    level[:] = high
    return np.array(nxt, np.int64), np.array(root, np.int64)


def arrays(g):
    """(ids, offsets, targets, cumulative weights, degrees)."""
    ids = np.array(sorted(r.id for r in g.vertices.collect()))
    near = {}
    for r in g.edges.collect():
        near.setdefault(r.src, []).append((r.dst, r.weight))
    offsets, targets, cum = [0], [], []
    for i in ids:
        mine = sorted(near.get(i, []))
        targets += [int(np.searchsorted(ids, d)) for d, _ in mine]
        cum += np.cumsum([w for _, w in mine]).tolist()
        offsets.append(len(targets))
    deg = np.array([cum[b - 1] if b > a else 0.0 for a, b in zip(offsets, offsets[1:])])
    return ids, np.array(offsets), np.array(targets, np.int64), np.array(cum), deg


def forests(g, qs, reps, seed):
    """Sorted rows (rep, q_index, id, next, root, level) for rates ``qs``: numbers or {id: q}, going down."""
    a = g if isinstance(g, tuple) else arrays(g)
    out = []
    for rep in range(reps):
        level = np.zeros(len(a[0]), np.int64)
        for k in sorted(range(len(qs)), key=lambda k: 0 if isinstance(qs[k], dict) else -qs[k]):
            q = np.array([qs[k].get(i, 0.0) if isinstance(qs[k], dict) else qs[k] for i in a[0].tolist()], float)
            nxt, root = walk(*a, q, seed, rep, level)
            out += [(rep, k, int(i), int(a[0][n]) if n >= 0 else None, int(a[0][r]), int(h)) for i, n, r, h in zip(a[0], nxt, root, level)]
    return sorted(out, key=str)
