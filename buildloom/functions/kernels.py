"""Graph and scheduling kernels over plain Python lists: for graphs within a checked size, and the test of the distributed forms."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict


def order(nodes: list, deps: dict) -> list:
    """Nodes with their dependencies first; raises on a cycle."""
    left = {n: len(deps.get(n, ())) for n in nodes}
    users = defaultdict(list)
    for n, ds in deps.items():
        for d in ds:
            users[d].append(n)
    ready = [n for n in nodes if not left[n]]
    out = []
    while ready:
        n = ready.pop()
        out.append(n)
        for u in users[n]:
            left[u] -= 1
            if not left[u]:
                ready.append(u)
    if len(out) < len(nodes):
        raise ValueError(f"the graph has a cycle among {sorted(n for n in nodes if left[n] > 0)[:5]}")
    return out


def betweenness(nodes: list, succ: dict) -> dict:
    """Shortest-path betweenness of a directed unweighted graph, scaled by (n - 1)(n - 2), by Brandes' accumulation."""
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        paths, dist, seen, before = {s: 1}, {s: 0}, [s], defaultdict(list)
        for v in seen:
            for w in succ.get(v, ()):
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    seen.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(seen, 0.0)
        for w in reversed(seen):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    scale = (len(nodes) - 1) * (len(nodes) - 2)
    return {n: x / scale if scale > 0 else 0.0 for n, x in total.items()}


def communities(nodes: list, pairs: list, resolution: float = 1.0, seed: int = 42) -> dict:
    """Louvain communities of an undirected weighted graph; nodes are visited in an order fixed by the seed."""
    belongs = {n: n for n in nodes}
    weight: dict = defaultdict(lambda: defaultdict(float))
    for a, b, w in pairs:
        weight[a][b] += w
        if a != b:
            weight[b][a] += w
    units, draw = list(nodes), random.Random(seed)
    while True:
        degree = {u: sum(w * (2 if v == u else 1) for v, w in weight[u].items()) for u in units}
        m2 = sum(degree.values())
        if not m2:
            return belongs
        group, mass, moved = {u: u for u in units}, dict(degree), False
        visit = sorted(units)
        draw.shuffle(visit)
        changed = True
        while changed:
            changed = False
            for u in visit:
                own = group[u]
                mass[own] -= degree[u]
                near: dict = defaultdict(float)
                for v, w in weight[u].items():
                    if v != u:
                        near[group[v]] += w
                best = max([own, *near], key=lambda g: (near.get(g, 0.0) - resolution * degree[u] * mass[g] / m2, g == own))
                mass[best] += degree[u]
                if best != own and near.get(best, 0.0) - resolution * degree[u] * (mass[best] - degree[u]) / m2 > near.get(own, 0.0) - resolution * degree[u] * mass[own] / m2 + 1e-12:
                    group[u], changed, moved = best, True, True
                elif best != own:
                    mass[best] -= degree[u]
                    mass[own] += degree[u]
                    group[u] = own
        belongs = {n: group[g] for n, g in belongs.items()}
        if not moved:
            return belongs
        joined: dict = defaultdict(lambda: defaultdict(float))
        for u in units:
            for v, w in weight[u].items():
                if v == u:
                    joined[group[u]][group[u]] += w
                elif group[u] == group[v]:
                    joined[group[u]][group[u]] += w / 2
                else:
                    joined[group[u]][group[v]] += w
        weight, units = joined, sorted(set(group.values()))


def schedule(times: dict, deps: dict, cores: int, pool_of: dict | None = None, pool_depth: dict | None = None, phony: set | frozenset = frozenset()) -> list[tuple]:
    """(target, start, end, core) of a list schedule.

    A target is ready when its dependencies have finished; ready ones are committed at once, the
    heaviest first (weight: the targets, phony ones apart, on the longest chain of dependencies; ties
    by name), to the core that is free first.  A pool holds at most its depth of targets from commit to finish."""
    weight: dict = {}
    for n in order(list(times), deps):
        weight[n] = (n not in phony) + max((weight[d] for d in deps.get(n, ())), default=0)
    users, left = defaultdict(list), {}
    for n in times:
        left[n] = len(deps.get(n, ()))
        for d in deps.get(n, ()):
            users[d].append(n)
    pool_of, room = pool_of or {}, dict(pool_depth or {})
    free = [(0, c) for c in range(cores)]
    ready = [(-weight[n], n, 0) for n in times if not left[n]]
    heapq.heapify(ready)
    waiting: dict = defaultdict(list)
    running: list = []
    since = dict.fromkeys(times, 0)
    out = []
    while ready or running:
        while ready:
            w, n, at = heapq.heappop(ready)
            pool = pool_of.get(n)
            if pool in room and room[pool] <= 0:
                heapq.heappush(waiting[pool], (w, n, at))
                continue
            if pool in room:
                room[pool] -= 1
            idle, core = heapq.heappop(free)
            start = max(idle, at)
            heapq.heappush(free, (start + times[n], core))
            heapq.heappush(running, (start + times[n], n))
            out.append((n, start, start + times[n], core))
        if running:
            end, n = heapq.heappop(running)
            pool = pool_of.get(n)
            if pool in room:
                room[pool] += 1
                if waiting[pool]:
                    w, m, at = heapq.heappop(waiting[pool])
                    heapq.heappush(ready, (w, m, max(at, end)))
            for u in users[n]:
                left[u] -= 1
                since[u] = max(since[u], end)
                if not left[u]:
                    heapq.heappush(ready, (-weight[u], u, since[u]))
    return out
