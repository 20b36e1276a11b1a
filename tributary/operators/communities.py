"""Overlapping communities: ego-network label propagation with merging, and speaker-listener propagation.

Both are deterministic here: seeded hashes, fixed orders, ties to the smallest label.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["model", "net_idx"]


def _propagate(members: list[int], near: dict[int, set[int]], rounds: int = 30) -> dict[int, int]:
    """Label propagation in ascending node order; ties to the smallest label."""
    label = {v: v for v in members}
    for _ in range(rounds):
        moved = False
        for v in members:
            count: dict[int, int] = {}
            for w in near[v]:
                if w in label:
                    count[label[w]] = count.get(label[w], 0) + 1
            if count:
                best = min(count, key=lambda x: (-count[x], x))
                if count[best] > count.get(label[v], 0):
                    label[v], moved = best, True
        if not moved:
            break
    return label


def ego_communities(near: dict[int, set[int]], epsilon: float = 0.25, least: int = 3) -> list[set[int]]:
    """Communities of every node's ego network (without the node, which then joins each), merged.

    A community joins a larger one when at most ``epsilon`` of it lies outside; in order of
    (size descending, smallest member).  Communities below ``least`` members go.
    """
    found: set[frozenset[int]] = set()
    for v in sorted(near):
        ego = sorted(near[v])
        groups: dict[int, set[int]] = {}
        inside = {w: near[w] & near[v] for w in ego}
        for w, label in _propagate(ego, inside).items():
            groups.setdefault(label, set()).add(w)
        found |= {frozenset(g | {v}) for g in groups.values() if len(g) + 1 >= least}
    merged: list[set[int]] = []
    for c in sorted(found, key=lambda c: (-len(c), sorted(c))):
        for m in merged:
            if len(c - m) <= epsilon * len(c):
                m |= c
                break
        else:
            merged.append(set(c))
    return sorted(merged, key=lambda c: (-len(c), min(c)))


def speaker_listener(near: dict[int, set[int]], rounds: int = 20, threshold: float = 0.1, seed: int = 42) -> list[set[int]]:
    """Each round every node hears one label from each neighbour, drawn by a seeded hash from the speaker's memory by
    frequency, and keeps the most frequent one; labels below ``threshold`` of a memory are dropped at the end."""
    memory = {v: {v: 1} for v in near}
    for r in range(rounds):
        for v in sorted(near):
            heard: dict[int, int] = {}
            for w in sorted(near[v]):
                m = memory[w]
                draw = zlib.crc32(f"{seed}-{r}-{v}-{w}".encode()) % sum(m.values())
                for label in sorted(m):
                    draw -= m[label]
                    if draw < 0:
                        heard[label] = heard.get(label, 0) + 1
                        break
            if heard:
                best = min(heard, key=lambda x: (-heard[x], x))
                memory[v][best] = memory[v].get(best, 0) + 1
    groups: dict[int, set[int]] = {}
    for v, m in memory.items():
        total = sum(m.values())
        for label, n in m.items():
            if n >= threshold * total and near[v]:
                groups.setdefault(label, set()).add(v)
    out = {frozenset(g) for g in groups.values() if len(g) > 1}
    out = {c for c in out if not any(c < d for d in out)}
    return [set(c) for c in sorted(out, key=lambda c: (-len(c), min(c)))]


ALGORITHMS = {"demon": ego_communities, "aslpaw": speaker_listener}


def detect(nodes: DataFrame, undirected: DataFrame, algorithm: str = "demon", **options) -> DataFrame:
    """(model, net_idx, node, community) of all networks, a task per network; networks without edges have none.

    ``undirected(model, net_idx, u, v)``.  An unknown algorithm is a KeyError.
    """
    find = ALGORITHMS[algorithm]

    def run(key, edges: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in edges[["u", "v"]].itertuples(index=False):
            if a != b:
                near.setdefault(int(a), set()).add(int(b))
                near.setdefault(int(b), set()).add(int(a))
        rows = [(key[0], key[1], v, k) for k, c in enumerate(find(near, **options)) for v in sorted(c)]
        return pd.DataFrame(rows, columns=["model", "net_idx", "node", "community"])

    found = undirected.groupBy(*KEY).applyInPandas(run, "model string, net_idx int, node long, community long")
    return found.join(nodes.select(*KEY, "node").distinct(), [*KEY, "node"], "left_semi")


def membership_lists(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(model, net_idx, node, num_communities, community_ids ("0;3")); nodes in none: 0 and empty."""
    sets = membership.groupBy(*KEY, "node").agg(F.array_sort(F.collect_set("community")).alias("c"))
    j = nodes.select(*KEY, "node").distinct().join(sets, [*KEY, "node"], "left")
    return j.select(*KEY, "node", F.coalesce(F.size("c"), F.lit(0)).alias("num_communities"), F.coalesce(F.array_join("c", ";"), F.lit("")).alias("community_ids"))
