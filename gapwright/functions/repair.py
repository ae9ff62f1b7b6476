"""Consistency of times and sequence numbers on the driver, over what is left after the distributed checks: longest
non-decreasing subsequences, minimum vertex covers and difference constraints."""

from __future__ import annotations

from bisect import bisect_right


def longest_nondecreasing(values: list[int]) -> list[int]:
    """Positions of a longest non-decreasing subsequence; of equal lengths the one with the smallest ends."""
    ends, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_right(ends, v)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def corrections(values: list[int]) -> list[int]:
    """Positions that must change for the rest to be monotonic."""
    kept = set(longest_nondecreasing(values))
    return [i for i in range(len(values)) if i not in kept]


def stripped(graph: dict, gone: set) -> dict:
    """The graph without some nodes."""
    return {v: near - gone for v, near in graph.items() if v not in gone}


def cover_size(graph: dict, most: int | None = None) -> int:
    """The size of a smallest vertex cover, or ``most`` if there is none below it. A leaf's neighbour goes in; else the
    node with most neighbours goes in, or all of them; a maximal matching bounds what is left from below."""
    size = 0
    most = len(graph) if most is None else most
    while (leaf := next((v for v, near in graph.items() if len(near) == 1), None)) is not None:
        graph = stripped(graph, set(graph[leaf]))
        size += 1
    free, bound = set(), size
    for u, near in graph.items():
        v = None if u in free else next((v for v in near if v not in free), None)
        if v is not None:
            free |= {u, v}
            bound += 1
    if bound == size or bound >= most:
        return min(bound, most)
    top = max(graph, key=lambda v: len(graph[v]))
    best = size + 1 + cover_size(stripped(graph, {top}), most - size - 1)
    near = set(graph[top])
    return min(best, size + len(near) + cover_size(stripped(graph, near), min(most, best) - size - len(near)))


def vertex_cover(edges: list[tuple], cap: int = 64) -> tuple[list, bool]:
    """(cover, exact): the first minimum cover by order of its vertices, or, over ``cap`` vertices, a greedy one."""
    edges = sorted({tuple(sorted(e)) for e in edges})
    nodes = sorted({v for e in edges for v in e})
    if len(nodes) <= cap:
        graph = {v: set() for v in nodes}
        for u, v in edges:
            graph[u].add(v)
            graph[v].add(u)
        need, chosen = cover_size(graph), set()
        for v in nodes:
            if v in graph and graph[v]:
                # v goes in if a smallest cover has it; else all its neighbours have to.
                fits = cover_size(stripped(graph, {v})) == need - 1
                taken = {v} if fits else set(graph[v])
                chosen |= taken
                need -= len(taken)
                graph = stripped(graph, taken)
        return sorted(chosen), True
    cover, left = [], list(edges)
    while left:
        degree = {v: sum(v in e for e in left) for e in left for v in e}
        best = min(degree, key=lambda v: (-degree[v], v))
        cover.append(best)
        left = [e for e in left if best not in e]
    return sorted(cover), False


def feasible(constraints: list[tuple], rounds: int | None = None) -> bool:
    """Whether times exist with t[v] - t[u] <= w for all (u, v, w): no negative cycle."""
    nodes = {x for u, v, _ in constraints for x in (u, v)}
    dist = dict.fromkeys(nodes, 0)
    for _ in range(len(nodes) + 1 if rounds is None else rounds):
        changed = False
        for u, v, w in constraints:
            if dist[u] + w < dist[v]:
                dist[v] = dist[u] + w
                changed = True
        if not changed:
            return True
    return False
