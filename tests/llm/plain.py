"""Plain versions of rules that several tests hold results against."""

import heapq


def lpt(sizes, n):
    """Loads, group by group through a heap."""
    heap = [(0, k) for k in range(n)]
    for s in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + s, k))
    return sorted(x for x, _ in heap)


def pour(tokens, weights, total, epochs):
    """Budgets by a plain rule: the water level at which a node's children hold its budget, found by bisection."""
    out = {}

    def give(node, budget):
        kids = sorted({p[: len(node) + 1] for p in tokens if p[: len(node)] == node and len(p) > len(node)})
        if not kids:
            out[node] = budget
            return
        room = {k: epochs * sum(n for p, n in tokens.items() if p[: len(k)] == k) for k in kids}
        weight = {k: max(0.0, weights.get(k, 1.0)) for k in kids}
        budget = min(budget, sum(room[k] for k in kids if weight[k]))
        low, high = 0.0, 1e12
        for _ in range(200):
            level = (low + high) / 2
            if sum(min(room[k], level * weight[k]) for k in kids) < budget:
                low = level
            else:
                high = level
        for k in kids:
            give(k, room[k] if weight[k] and high * weight[k] >= room[k] - 1e-6 else int(high * weight[k] + 1e-6))

    give((), total)
    return out
