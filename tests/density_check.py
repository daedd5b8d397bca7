"""Plain numpy density clustering over all pairs, for small inputs only."""

import numpy as np

SHORTEST = 1e-10


def brute_labels(x: np.ndarray, m: int) -> np.ndarray:
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    others = np.sort(d + np.where(np.eye(n, dtype=bool), np.inf, 0), axis=1)
    core = others[:, min(m, n - 1) - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    pairs = sorted((w[a, b], a, b) for a in range(n) for b in range(a + 1, n))
    # single linkage: node -> (left, right, weight, size)
    parent, node = list(range(n)), list(range(n))
    tree, size = {}, {i: 1 for i in range(n)}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    nxt = n
    for weight, a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            tree[nxt] = (node[ra], node[rb], weight)
            size[nxt] = size[node[ra]] + size[node[rb]]
            parent[ra] = rb
            node[rb] = nxt
            nxt += 1
    top = nxt - 1
    leaf_cluster, births, gains, children = {}, {0: 0.0}, {0: 0.0}, {0: []}

    def points(t):
        stack, out = [t], []
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack += tree[y][:2]
        return out

    stack = [(top, 0)]
    while stack:
        t, c = stack.pop()
        if t < n:
            leaf_cluster[t] = c
            continue
        left, right, weight = tree[t]
        lam = 1 / max(weight, SHORTEST)
        sl, sr = size[left], size[right]
        if sl >= m and sr >= m:
            for s in (left, right):
                new = len(births)
                births[new], gains[new], children[new] = lam, 0.0, []
                children[c].append(new)
                stack.append((s, new))
            gains[c] += (sl + sr) * (lam - births[c])
        else:
            for s, k in ((left, sl), (right, sr)):
                if k >= m:
                    stack.append((s, c))
                else:
                    gains[c] += k * (lam - births[c])
                    for p in points(s):
                        leaf_cluster[p] = c
    worth, chosen = {}, {}
    for c in sorted(births, reverse=True):
        below = sum(worth[k] for k in children[c])
        chosen[c] = c != 0 and gains[c] >= below
        worth[c] = max(gains[c], below)
    final = {}
    for c in sorted(births):  # parents first
        up = next((p for p in births if c in children[p]), None)
        final[c] = final[up] if up is not None and final[up] is not None else (c if chosen[c] else None)
    raw = [final[leaf_cluster[i]] for i in range(n)]
    return np.array([-1 if r is None else r for r in raw])


def same_partition(a, b) -> bool:
    pairs = set(zip(a, b))
    return (len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs})) and all((x == -1) == (y == -1) for x, y in pairs)
