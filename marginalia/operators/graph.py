"""Dependence graphs, in plain Python: a few dozen attributes, never rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from math import ceil, prod, sqrt

Edge = frozenset


@dataclass
class Graph:
    nodes: list
    edges: set = field(default_factory=set)

    def copy(self) -> Graph:
        return Graph(list(self.nodes), set(self.edges))

    def neighbours(self, v) -> set:
        return {u for e in self.edges if v in e for u in e if u != v}

    def toggled(self, a, b) -> Graph:
        out = self.copy()
        out.edges ^= {Edge((a, b))}
        return out

    def adjacency(self) -> dict:
        out = {v: set() for v in self.nodes}
        for e in self.edges:
            a, b = tuple(e)
            out[a].add(b)
            out[b].add(a)
        return out


def triangulate(graph: Graph) -> Graph:
    """Eliminate nodes in the order of their first degree, joining each one's remaining neighbours."""
    adj = graph.adjacency()
    left = {v: set(n) for v, n in adj.items()}
    out = graph.copy()
    rank = {v: k for k, v in enumerate(graph.nodes)}
    for v in sorted(graph.nodes, key=lambda v: (len(adj[v]), rank[v])):
        for a, b in combinations(left[v], 2):
            left[a].add(b)
            left[b].add(a)
            out.edges.add(Edge((a, b)))
        for u in left.pop(v):
            left[u].discard(v)
    return out


def cliques(graph: Graph) -> list[tuple]:
    """Maximal cliques, each in the nodes' order, by pivoting search."""
    adj, rank, found = graph.adjacency(), {v: k for k, v in enumerate(graph.nodes)}, []
    todo = [(frozenset(), frozenset(graph.nodes), frozenset())]
    while todo:
        held, may, done = todo.pop()
        if not may and not done:
            found.append(tuple(sorted(held, key=rank.get)))
            continue
        pivot = max(may | done, key=lambda v: len(adj[v] & may))
        for v in sorted(may - adj[pivot], key=rank.get):
            todo.append((held | {v}, may & adj[v], done & adj[v]))
            may, done = may - {v}, done | {v}
    return sorted(found, key=lambda c: [rank[v] for v in c])


def junction_tree(parts: list[tuple]) -> list[tuple[int, int]]:
    """Edges of a spanning tree over cliques with the largest separators."""
    root = list(range(len(parts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for i, j in sorted(combinations(range(len(parts)), 2), key=lambda p: (-len(set(parts[p[0]]) & set(parts[p[1]])), p)):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def schedule(tree: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Messages in an order in which each comes after those it waits for."""
    messages = [m for i, j in tree for m in ((i, j), (j, i))]
    waits = {m: {k for k in messages if k[1] == m[0] and k[0] != m[1]} for m in messages}
    out = []
    while waits:
        ready = sorted(m for m, w in waits.items() if not w)
        out += ready
        for m in ready:
            del waits[m]
        for w in waits.values():
            w.difference_update(ready)
    return out


def cells(attrs, sizes: dict) -> int:
    return prod(sizes[a] for a in attrs)


def fits(graph: Graph, sizes: dict, clique_cells: float, all_cells: float) -> bool:
    each = [cells(c, sizes) for c in cliques(triangulate(graph))]
    return max(each, default=0) <= clique_cells and sum(each) <= all_cells


def score(graph: Graph, dependence: dict, sizes: dict, penalty: float, clique_cells: float, all_cells: float) -> float:
    """Dependence that the edges explain, less a price for the junction tree's cells."""
    each = [cells(c, sizes) for c in cliques(triangulate(graph))]
    if max(each, default=0) > clique_cells or sum(each) > all_cells:
        return -1e8
    return sum(dependence.get(e, 0.0) for e in graph.edges) - penalty * sum(each)


def entropy_score(graph: Graph, entropy) -> float:
    """Minus the entropy of the graph's model: cliques less separators."""
    parts = cliques(triangulate(graph))
    total = sum(entropy(c) for c in parts)
    return -(total - sum(entropy(tuple(sorted(set(parts[i]) & set(parts[j])))) for i, j in junction_tree(parts) if set(parts[i]) & set(parts[j])))


def climb(nodes: list, dependence: dict, sizes: dict, penalty: float = 0.0, clique_cells: float = 1e5, all_cells: float = 3e5, patience: int = 3) -> Graph:
    """Toggle the edge that improves the score most, until none does (or none for `patience` steps sideways)."""
    best = now = Graph(list(nodes))
    top = held = score(now, dependence, sizes, penalty, clique_cells, all_cells)
    stuck, seen = 0, {frozenset()}
    for _ in range(len(nodes) * (len(nodes) - 1)):
        options = []
        for a, b in combinations(nodes, 2):
            g = now.toggled(a, b)
            if frozenset(g.edges) not in seen:
                options.append((score(g, dependence, sizes, penalty, clique_cells, all_cells), -len(options), g))
        if not options:
            break
        held, _, now = max(options, key=lambda x: x[:2])
        seen.add(frozenset(now.edges))
        if held > top:
            best, top, stuck = now, held, 0
        else:
            stuck += 1
            if stuck >= patience:
                break
    return best


def search(nodes: list, dependence: dict, sizes: dict, penalty: float = 0.0, clique_cells: float = 1e5, all_cells: float = 3e5, patience: int = 3) -> Graph:
    """The graph that climbing finds, triangulated."""
    return triangulate(climb(nodes, dependence, sizes, penalty, clique_cells, all_cells, patience))


def subsets(graph: Graph, n: int) -> list[tuple]:
    """All sets of n attributes within a maximal clique."""
    return sorted({s for c in cliques(graph) for s in combinations(c, n)})


def network_measures(graph: Graph, dependence: dict, sizes: dict, limit: float) -> list[tuple]:
    """For each attribute of a clique, in order from the most dependent, the parents that say most about it.

    A parent set is worth the sum of its dependences with the attribute over
    the root of its size plus those among the parents, within the cell limit.
    """

    def dep(a, b) -> float:
        return dependence.get(Edge((a, b)), 0.0)

    out = set()
    for clique in cliques(graph):
        placed = [max(clique, key=lambda a: (sum(dep(a, b) for b in clique if b != a), str(a)))]
        left = [a for a in clique if a not in placed]
        if not left:
            out.add((placed[0],))
        while left:
            best = None
            for a in left:
                parents: list = []
                for p in sorted(placed, key=lambda p: (-dep(a, p), str(p))):
                    if cells([a, *parents, p], sizes) <= limit:
                        parents.append(p)
                among = sum(dep(x, y) for x, y in combinations(parents, 2))
                worth = sum(dep(a, p) for p in parents) / sqrt(len(parents) + among) if parents else 0.0
                if best is None or worth > best[0]:
                    best = (worth, a, parents)
            _, a, parents = best
            out.add(tuple(sorted([a, *parents], key=clique.index)))
            placed.append(a)
            left.remove(a)
    return sorted(out)


def merge(left: Graph, right: Graph, ranked: list[tuple], sizes: dict, clique_cells: float = 2e6, all_cells: float = 4e6) -> Graph:
    """The parties' graphs side by side and a fifth of all cross pairs, the most dependent first, that keep within the limits."""
    out = Graph(left.nodes + right.nodes, left.edges | right.edges)
    want, got = ceil(len(left.nodes) * len(right.nodes) / 5), 0
    for a, b in ranked:
        if got >= want:
            break
        g = out.toggled(a, b)
        if fits(g, sizes, clique_cells, all_cells):
            out, got = g, got + 1
    return out
