"""Minimum cuts of small labelling graphs."""

from __future__ import annotations

from collections import deque


def label(gains: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling that cuts least: a node labelled True gives up max(-gain, 0), one labelled False
    max(gain, 0), and an edge between different labels its weight. A tie is False.

    A node whose gain outweighs all its edges keeps the label of its gain in every best labelling; such nodes
    are settled first and their edges become gains of their neighbours. Maximum flow labels the rest.
    """
    n = len(gains)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        if a != b and w > 0:
            around[a][b] = around[a].get(b, 0) + w
            around[b][a] = around[b].get(a, 0) + w
    gain, weight = list(gains), [sum(x.values()) for x in around]
    chosen: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if chosen[i] is not None or abs(gain[i]) <= weight[i]:
            continue
        chosen[i] = gain[i] > 0
        for j, w in around[i].items():
            if chosen[j] is None:
                gain[j] += w if chosen[i] else -w
                weight[j] -= w
                del around[j][i]
                queue.append(j)
    rest = [i for i in range(n) if chosen[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inner = [(place[i], place[j], w) for i in rest for j, w in around[i].items() if i < j and chosen[j] is None]
        for i, up in zip(rest, source_side([gain[i] for i in rest], inner)):
            chosen[i] = up
    return [bool(c) for c in chosen]


def source_side(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of the smallest minimum cut, by maximum flow along shortest paths."""
    n = len(gains)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gains):
        if g > 0:
            arc(source, i, g, 0.0)
        elif g < 0:
            arc(i, sink, -g, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                at = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[at] < len(head[at]):
                e = head[at][turn[at]]
                if room[e] > tiny and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(head[at]):
                path.append(head[at][turn[at]])
                at = to[path[-1]]
            elif not path:
                break
            else:
                e = path.pop()
                at = to[e ^ 1]
                turn[at] += 1
