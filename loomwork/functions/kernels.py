"""Small numerical kernels over numpy: graphs, orders, partitions and likelihoods.

They work on tables whose size is that of a universe of categories or
entities, never of the documents.
"""

from __future__ import annotations

import numpy as np


def matrix(labels: list[str], edges: list[tuple[str, str, float]]) -> np.ndarray:
    """The symmetric weight matrix of the edges over the sorted labels."""
    at = {x: k for k, x in enumerate(labels)}
    w = np.zeros((len(labels), len(labels)))
    for i, j, v in edges:
        w[at[i], at[j]] = w[at[j], at[i]] = v
    return w


def maximum_spanning_tree(edges: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Kruskal over falling weights; ties by the ends."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, j, w in sorted(edges, key=lambda e: (-round(e[2], 12), e[0], e[1])):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            kept.append((i, j, w))
    return kept


def components(w: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(len(w))
    while True:
        near = np.where(w > 0, label[None, :], len(w)).min(axis=1, initial=len(w))
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def centralities(w: np.ndarray) -> dict[str, np.ndarray]:
    """Betweenness, closeness (both over distances 1 / w), eigenvector centrality and weighted clustering."""
    n = len(w)
    between, close = np.zeros(n), np.zeros(n)
    length = np.where(w > 0, 1 / np.where(w > 0, w, 1), np.inf)
    for s in range(n):
        dist, paths, done, order = np.full(n, np.inf), np.zeros(n), np.zeros(n, dtype=bool), []
        before: list[list[int]] = [[] for _ in range(n)]
        dist[s], paths[s] = 0, 1
        while True:
            left = np.where(done, np.inf, dist)
            v = int(left.argmin())
            if not np.isfinite(left[v]):
                break
            done[v] = True
            order.append(v)
            for u in np.flatnonzero(np.isfinite(length[v]) & ~done):
                d = dist[v] + length[v, u]
                if d < dist[u] - 1e-12:
                    dist[u], paths[u], before[u] = d, paths[v], [v]
                elif abs(d - dist[u]) <= 1e-12:
                    paths[u] += paths[v]
                    before[u].append(v)
        reach = done.sum() - 1
        total = dist[done].sum()
        close[s] = (reach / total) * (reach / (n - 1)) if total > 0 and n > 1 else 0.0
        share = np.zeros(n)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                between[v] += share[v]
    between /= max(1, (n - 1) * (n - 2))
    x = np.full(n, n**-0.5) if n else np.zeros(0)
    for _ in range(1000):
        y = w @ x + x
        y /= np.linalg.norm(y) or 1
        if np.abs(y - x).sum() < n * 1e-9:
            break
        x = y
    scaled = np.cbrt(w / w.max()) if n and w.max() > 0 else w
    degree = (w > 0).sum(axis=1)
    cluster = np.where(degree > 1, np.diag(scaled @ scaled @ scaled) / np.maximum(degree * (degree - 1), 1), 0.0)
    return {"betweenness": between, "closeness": close, "eigenvector": x, "clustering": cluster}


def classical_mds(distance: np.ndarray, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (the first label's are not positive) and all eigenvalues, falling."""
    n = len(distance)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (distance**2) @ centre)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    out = vectors[:, :axes] * np.sqrt(np.maximum(values[:axes], 0))
    return out * np.where(out[0] > 0, -1, 1), values


def centre_partition(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Weighted centres on a line: evenly spaced to begin with, Lloyd steps, snapped to the nearest point; and the midpoints."""
    centres = np.linspace(x.min(), x.max(), k)
    for _ in range(rounds):
        near = np.abs(x[:, None] - centres).argmin(axis=1)
        new = np.array([np.average(x[near == c], weights=weight[near == c]) if weight[near == c].sum() > 0 else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    centres = np.sort(np.array([x[np.abs(x - c).argmin()] for c in centres]))
    return centres, (centres[1:] + centres[:-1]) / 2


def communities(w: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Greedy modularity: nodes move in order to the best community, then communities merge as nodes, until nothing gains."""
    member = np.arange(len(w))
    graph = w.copy()
    while True:
        label, total = np.arange(len(graph)), graph.sum()
        if total == 0:
            return member
        strength, moved_any = graph.sum(axis=1), False
        for _ in range(rounds):
            moved = False
            for v in range(len(graph)):
                own = label[v]
                gain = {}
                for c in np.unique(label[np.flatnonzero(graph[v] > 0)].tolist() + [own]):
                    inside = (label == c) & (np.arange(len(graph)) != v)
                    gain[c] = graph[v, inside].sum() - strength[v] * strength[inside].sum() / total
                best = max(gain, key=lambda c: (round(gain[c], 12), c == own, -c))
                if best != own and gain[best] > gain[own] + 1e-12:
                    label[v], moved, moved_any = best, True, True
            if not moved:
                break
        names, label = np.unique(label, return_inverse=True)
        member = label[member]
        if not moved_any or len(names) == len(graph):
            return member
        hot = np.eye(len(names))[label]
        graph = hot.T @ graph @ hot


def diffuse(phi: np.ndarray, theta: np.ndarray, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """f = alpha theta + (1 - alpha) f phi, iterated; on convergence the iterate before the last."""
    f = theta.copy()
    for _ in range(rounds):
        new = alpha * theta + (1 - alpha) * (f @ phi)
        if np.abs(new - f).sum() < tolerance:
            return f
        f = new
    return f


def divergence(p: np.ndarray, q: np.ndarray) -> tuple[float, float]:
    """Kullback-Leibler divergence and Jensen-Shannon distance of two nonnegative vectors, 1e-12 added to each and scaled to 1."""
    p, q = ((x + 1e-12) / (x + 1e-12).sum() for x in (p, q))
    kl = lambda a, b: float(np.sum(a * np.log(a / b)))
    m = (p + q) / 2
    return kl(p, q), max(0.0, (kl(p, m) + kl(q, m)) / 2) ** 0.5


def fiedler_order(affinity: np.ndarray) -> np.ndarray:
    """Nodes in the order of the second eigenvector of the Laplacian; the first node's sign is not positive."""
    lap = np.diag(affinity.sum(axis=1)) - affinity
    v = np.linalg.eigh(lap)[1][:, 1] if len(lap) > 1 else np.zeros(len(lap))
    return np.argsort(v * (-1 if len(v) and v[0] > 0 else 1), kind="stable")


def ward_order(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Leaves in the order of a Ward tree, and its merges (a, b, height)."""
    clusters = {i: ([i], x[i].astype(float)) for i in range(len(x))}
    merges, following = [], len(x)
    while len(clusters) > 1:
        keys = sorted(clusters)
        best = None
        for p, a in enumerate(keys):
            for b in keys[p + 1 :]:
                na, nb = len(clusters[a][0]), len(clusters[b][0])
                d = np.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(clusters[a][1] - clusters[b][1])
                if best is None or d < best[0] - 1e-12:
                    best = (d, a, b)
        d, a, b = best
        (la, ca), (lb, cb) = clusters.pop(a), clusters.pop(b)
        clusters[following] = (la + lb, (len(la) * ca + len(lb) * cb) / (len(la) + len(lb)))
        merges.append((a, b, float(d)))
        following += 1
    return np.array(next(iter(clusters.values()))[0] if clusters else []), merges


def choice_moments(x: np.ndarray, chosen: int, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """log of the elementary symmetric sum of order ``chosen`` over exp(x beta), its gradient and Hessian.

    The recursion over the alternatives carries the sum, its first and its
    second derivatives, scaled to stay in range.
    """
    u = x @ beta
    shift = u.max()
    e, k = np.exp(u - shift), x.shape[1]
    s, g, h = np.zeros(chosen + 1), np.zeros((chosen + 1, k)), np.zeros((chosen + 1, k, k))
    s[0], scale = 1.0, 0.0
    for r in range(len(x)):
        xr, outer = x[r], np.outer(x[r], x[r])
        for m in range(min(chosen, r + 1), 0, -1):
            h[m] += e[r] * (h[m - 1] + np.outer(xr, g[m - 1]) + np.outer(g[m - 1], xr) + s[m - 1] * outer)
            g[m] += e[r] * (g[m - 1] + s[m - 1] * xr)
            s[m] += e[r] * s[m - 1]
        top = s.max()
        if top > 1e100:
            s, g, h, scale = s / top, g / top, h / top, scale + np.log(top)
    mean = g[chosen] / s[chosen]
    return float(np.log(s[chosen]) + scale + chosen * shift), mean, h[chosen] / s[chosen] - np.outer(mean, mean)


def swap_null(pairs: np.ndarray, seed: int, burn: int = 20, thin: int = 8, draws: int = 1):
    """The edge sets of ``swap_walk``."""
    for edges, _ in swap_walk(pairs, seed, burn, thin, draws):
        yield edges


def swap_walk(pairs: np.ndarray, seed: int, burn: int = 20, thin: int = 8, draws: int = 1):
    """Bipartite edge sets with the same margins on both sides, by random swaps; yields the edges and the swaps accepted for each draw.

    ``burn`` accepted swaps an edge come first and ``thin`` before each draw.
    Of a table more than half full the empty cells are swapped, which is the
    same walk with fewer refusals; a full table has no other state.
    """
    r = np.random.default_rng(seed)
    rows, columns = (pairs.max(axis=0) + 1) if len(pairs) else (0, 0)
    grid = np.zeros((rows, columns), dtype=bool)
    if len(pairs):
        grid[pairs[:, 0], pairs[:, 1]] = True
    holes = 2 * len(pairs) > grid.size
    edges = [tuple(p) for p in (np.argwhere(~grid) if holes else pairs).tolist()]
    have, n = set(edges), len(edges)
    picks = iter(())
    for k in range(draws):
        target, tries, done = ((0 if k else burn) + thin) * len(pairs), 0, 0
        while done < target and tries < max(1000, 100 * target) and n > 1:
            tries += 1
            found = next(picks, None)
            if found is None:
                picks = iter(r.integers(0, n, (4096, 2)).tolist())
                found = next(picks)
            i, j = found
            (a, x), (b, y) = edges[i], edges[j]
            if a == b or x == y or (a, y) in have or (b, x) in have:
                continue
            have.remove((a, x))
            have.remove((b, y))
            have.add((a, y))
            have.add((b, x))
            edges[i], edges[j] = (a, y), (b, x)
            done += 1
        if holes:
            grid[:] = True
            if edges:
                grid[tuple(np.array(edges).T)] = False
            yield np.argwhere(grid), done
        else:
            yield np.array(edges), done


def ridge_logit(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Intercept and coefficients of the standardised columns, with a ridge on the coefficients alone, by Newton steps."""
    spread = x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)])
    penalty, beta = np.diag([0.0, *[1 / strength] * x.shape[1]]), np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-12 * np.eye(len(beta)), z.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-10:
            break
    return beta


def longest_path(edges: list[tuple[str, str]]) -> list[str]:
    """The longest path of a tree or forest, by edges; of equal ones that whose ends come first by name."""
    near: dict[str, list[str]] = {}
    for i, j in edges:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)

    def farthest(start: str) -> list[str]:
        paths, best = {start: [start]}, [start]
        order = [start]
        for node in order:
            for other in sorted(near.get(node, ())):
                if other not in paths:
                    paths[other] = [*paths[node], other]
                    order.append(other)
                    if (len(paths[other]), best[-1]) > (len(best), other):
                        best = paths[other]
        return best

    leaves = sorted(n for n, others in near.items() if len(others) == 1)
    return max((farthest(n) for n in leaves), key=len, default=[])


def bridging(w: np.ndarray) -> np.ndarray:
    """The bridging coefficient: a node's inverse degree over the sum of its neighbours' inverse degrees."""
    linked = w > 0
    degree = linked.sum(axis=1)
    inverse = np.divide(1.0, degree, out=np.zeros(len(w)), where=degree > 0)
    around = linked @ inverse
    return np.divide(inverse, around, out=np.zeros(len(w)), where=around > 0)


def smooth(values: np.ndarray, sigma: float = 1.15, radius: int = 3) -> np.ndarray:
    """Gaussian weighted means over neighbouring places; places past an end take the end's value."""
    weight = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    wide = np.pad(np.asarray(values, dtype=float), radius, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * radius + 1) @ (weight / weight.sum())


def average_ranks(x: np.ndarray, places: int = 9) -> np.ndarray:
    """Ranks from 1; values equal after rounding share their mean."""
    _, group, size = np.unique(np.round(x, places), return_inverse=True, return_counts=True)
    return (np.cumsum(size) - (size - 1) / 2)[group]


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Spearman's coefficient; nan where either side is constant."""
    a, b = (r - r.mean() for r in map(average_ranks, (x, y)))
    size = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / size) if size else float("nan")


def cosines(rows: np.ndarray) -> np.ndarray:
    """The cosines of all rows of a table of entities."""
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return unit @ unit.T


def transport(p: np.ndarray, q: np.ndarray, cost: np.ndarray, tiny: float = 1e-12) -> float:
    """The least cost of moving the shares p onto the shares q; nan where either has no mass.

    Successive cheapest paths: each round sends what fits from the sources that
    have mass left to the cheapest sink that lacks some, and may take back what
    earlier rounds sent.
    """
    if p.sum() <= 0 or q.sum() <= 0:
        return float("nan")
    left, need = p / p.sum(), q / q.sum()
    sent = np.zeros(cost.shape)
    while (left > tiny).any() and (need > tiny).any():
        reach, taken_back = np.where(left > tiny, 0.0, np.inf), np.full(len(left), -1)
        least, via = np.full(len(need), np.inf), np.zeros(len(need), dtype=int)
        while True:
            # a way changes only where the new one is cheaper by more than rounding, so that ways never run in circles
            arrive = reach[:, None] + cost
            nearer = arrive.min(axis=0) < least - tiny
            least[nearer], via[nearer] = arrive.min(axis=0)[nearer], arrive.argmin(axis=0)[nearer]
            undo = np.where(sent > tiny, least - cost, np.inf)
            better = undo.min(axis=1) < reach - tiny
            if not better.any():
                break
            reach[better], taken_back[better] = undo.min(axis=1)[better], undo.argmin(axis=1)[better]
        sink = int(np.where(need > tiny, least, np.inf).argmin())
        amount, path, at = need[sink], [], sink
        while True:
            source = int(via[at])
            path.append((source, at, 1))
            at = int(taken_back[source])
            if at < 0:
                amount = min(amount, left[source])
                break
            amount = min(amount, sent[source, at])
            path.append((source, at, -1))
        for i, j, sign in path:
            sent[i, j] += sign * amount
        left[path[-1][0]] -= amount
        need[sink] -= amount
    return float((sent * cost).sum())


def peaks(values: np.ndarray, most: int, apart: int = 1) -> list[int]:
    """Places higher than the one before and no lower than the one after, highest first, each at least ``apart`` from those taken."""
    y = np.concatenate([[-np.inf], values, [-np.inf]])
    taken: list[int] = []
    for k in sorted(np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])).tolist(), key=lambda k: (-values[k], k)):
        if len(taken) < most and all(abs(k - t) >= apart for t in taken):
            taken.append(k)
    return taken


def best_of_bins(values: np.ndarray, x: np.ndarray, bins: int, floor: float) -> list[int]:
    """The highest place of each equal bin of x, where it reaches ``floor`` of the highest of all; ties: the first."""
    if not len(values) or values.max() <= 0:
        return []
    spread = np.ptp(x)
    at = np.minimum((x - x.min()) / spread * bins, bins - 1).astype(int) if spread else np.zeros(len(x), dtype=int)
    best = [max(np.flatnonzero(at == b).tolist(), key=lambda k: (values[k], -k)) for b in np.unique(at)]
    return [k for k in best if values[k] >= floor * values.max()]


def spread_selection(values: np.ndarray, x: np.ndarray, liked: dict[int, float], target: int, gaps: tuple[float, ...]) -> list[int]:
    """Up to ``target`` places in order of x: the best of ``liked`` (place: bonus) whose x keeps a gap from all that are taken.

    The gaps are tried one after the other, each over all that is left, until
    the target is reached; ties: the first place.
    """
    order = sorted(liked, key=lambda k: (-(values[k] + liked[k]), k))
    taken: list[int] = []
    for gap in gaps:
        for k in order:
            if len(taken) < target and k not in taken and all(abs(x[k] - x[t]) >= gap for t in taken):
                taken.append(k)
    return sorted(taken, key=lambda k: (x[k], k))
