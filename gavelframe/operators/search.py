"""Searches: minimal witnesses, attack choice, evidence budgets, average-link clusters.

Each step of such a search depends on the answer before, so a single one is sequential; many of
them run side by side, one group of rows each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelframe.functions import text as T
from gavelframe.functions.rng import digest
from gavelframe.functions.stats import wilson

UNTRIED = 1e9
GROUP = 400


class BudgetSpent(Exception):
    """A search has asked as often as it may."""


def ddmin(parts: Sequence, fools: Callable[[Sequence], bool], calls: int = 10_000) -> list:
    """A 1-minimal subsequence that still fools: no single part can be taken out.

    Delta debugging: at granularity n, test the n subsets, then their complements; a subset that
    fools restarts at 2, a complement at n - 1; else n doubles until parts stand alone.  Answers are
    remembered.  After that many calls the best found so far is returned.
    """
    known: dict[tuple[int, ...], bool] = {}

    def test(kept: tuple[int, ...]) -> bool:
        if kept not in known:
            if len(known) >= calls:
                raise BudgetSpent
            known[kept] = bool(fools([parts[i] for i in kept]))
        return known[kept]

    now, n = tuple(range(len(parts))), 2
    if not test(now):
        raise ValueError("the whole input does not fool")
    try:
        while len(now) > 1:
            n = min(n, len(now))
            edges = [len(now) * i // n for i in range(n + 1)]
            subsets = [now[a:b] for a, b in zip(edges, edges[1:])]
            smaller = next((s for s in subsets if test(s)), None)
            if smaller is not None:
                now, n = smaller, 2
                continue
            rest = next((c for c in (tuple(i for i in now if i not in set(s)) for s in subsets) if c and n > 2 and test(c)), None)
            if rest is not None:
                now, n = rest, n - 1
            elif n == len(now):
                break
            else:
                n *= 2
    except BudgetSpent:
        pass
    return [parts[i] for i in now]


def witnesses(rows: DataFrame, keys: list[str], order: str, part: str, fools: Callable[[Sequence[str]], bool], calls: int = 10_000) -> DataFrame:
    """(keys, parts, kept, witness): the minimal parts of every group that still fool; groups that do not fool have none."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        parts = group.sort_values(order)[part].tolist()
        found = ddmin(parts, fools, calls) if fools(parts) else []
        return pd.DataFrame([[*group.iloc[0][keys], len(parts), len(found), found]], columns=[*keys, "parts", "kept", "witness"])

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, order, part).groupBy(*keys).applyInPandas(search, f"{fields}, parts long, kept long, witness array<string>")


def attack_bounds(tried: Mapping[str, int], won: Mapping[str, int]) -> dict[str, float]:
    """Upper confidence bound of every attack; one that was not tried stands above all others."""
    log = math.log(max(1, sum(tried.values())))
    return {a: UNTRIED if not n else (won[a] + 1) / (n + 2) + math.sqrt(2 * log / n) for a, n in tried.items()}


def first_by_hash(rows: DataFrame, groups: list[str], hashed: Column, least: int) -> DataFrame:
    """rows that stand first in their group by a hex digest: all up to the power of two below which at least that many lie.

    Rows are counted by the bits of the digest's head first, so nothing is sorted and a task holds one
    count a group and bit; the counts, one row a group, are broadcast.  About 2 * least rows a group stay.
    """
    bits = F.length(F.bin(F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long")))
    placed = rows.withColumn("_bits", bits)
    below = Window.partitionBy(*groups).orderBy("_bits").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*groups, "_bits").agg(F.count("*").alias("_n")).withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    cuts = counts.where(F.col("_below") < least).groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups))).agg(F.max("_bits").alias("_cut"))
    near = F.col("_bits") <= F.col("_cut")
    for i, g in enumerate(groups):
        near = near & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(F.broadcast(cuts), near, "left_semi").drop("_bits")


def stress(outcomes: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """Attack by attack what a judge let pass within a budget of tries: (keys, attack, tried, fooled, low, high).

    outcomes: keys, attack, case_id, fooled.  The next attack has the largest upper confidence bound,
    ties by name; its next case comes in hash order, so no more than budget rows an attack are read.
    """
    hashed = digest("stress", F.col("case_id"))
    order = Window.partitionBy(*keys, "attack").orderBy(hashed, "case_id")
    rows = first_by_hash(outcomes, [*keys, "attack"], hashed, budget).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= budget).select(*keys, "attack", "turn", "fooled")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        queues = {a: g.sort_values("turn")["fooled"].tolist() for a, g in group.groupby("attack")}
        tried, won = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
        for _ in range(budget):
            left = {a: b for a, b in attack_bounds(tried, won).items() if tried[a] < len(queues[a])}
            if not left:
                break
            best = min(left, key=lambda a: (-left[a], a))
            won[best] += bool(queues[best][tried[best]])
            tried[best] += 1
        return pd.DataFrame([[*group.iloc[0][keys], a, tried[a], won[a]] for a in sorted(queues)], columns=[*keys, "attack", "tried", "fooled"])

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    found = rows.groupBy(*keys).applyInPandas(search, f"{fields}, attack string, tried long, fooled long")
    low, high = wilson("fooled", "tried")
    return found.withColumns({"low": low, "high": high})


def evidence_budget(cases: DataFrame, components: Sequence[str], judge: Callable[[Mapping[str, Column]], Column]) -> list[dict]:
    """Which components can go without moving a verdict: one trial each, the largest (in characters over all cases) first.

    judge(columns) is the verdict from the components left.  A trial drops one more component and
    counts the cases whose verdict moves, over all cases; with any, the component stays.  Returns the
    trials: component, chars, moved, dropped.
    """
    sizes = cases.agg(*(F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in components)).first().asDict()
    left, trials = list(components), []
    first = judge({c: F.col(c) for c in components})
    for name in sorted(components, key=lambda c: (-sizes[c], c)):
        kept = {c: F.col(c) for c in left if c != name}
        moved = cases.agg(F.count_if(~judge(kept).eqNullSafe(first))).first()[0]
        trials.append({"component": name, "chars": sizes[name], "moved": moved, "dropped": moved == 0})
        if not moved:
            left.remove(name)
    return trials


def clusters(similar: Sequence[Sequence[float]], threshold: float = 0.2) -> list[list[int]]:
    """Average-link groups of a similarity matrix: the closest pair merges while it is alike enough.

    The similarity of a merged group to a third is the mean of its parts' weighted by their sizes;
    candidates alike enough wait in a heap, and those of groups that are gone are passed over.
    """
    links = np.array(similar, dtype="float64").reshape(len(similar), len(similar))
    members = {i: [i] for i in range(len(links))}
    alive = np.ones(len(links), dtype=bool)
    heap = [(-float(links[i, j]), int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(links >= threshold, 1)))]
    heapq.heapify(heap)
    while heap:
        negative, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or links[a, b] != -negative:
            continue
        size_a, size_b = len(members[a]), len(members[b])
        merged = (size_a * links[a] + size_b * links[b]) / (size_a + size_b)
        alive[b] = False
        links[a], links[:, a] = merged, merged
        for c in np.nonzero(alive & (merged >= threshold))[0].tolist():
            if c != a:
                heapq.heappush(heap, (-float(merged[c]), *sorted((a, c))))
        members[a] += members.pop(b)
    return sorted((sorted(m) for m in members.values()), key=lambda m: m[0])


def similarities(vectors: Sequence[Mapping[str, float]]) -> np.ndarray:
    """Cosines of all pairs of unit vectors, term by term over the vectors that have it; sums in extended precision, so that alike pairs tie."""
    holders: dict[str, list[int]] = {}
    for i, vector in enumerate(vectors):
        for term in vector:
            holders.setdefault(term, []).append(i)
    out = np.zeros((len(vectors), len(vectors)), dtype=np.longdouble)
    for term, rows in holders.items():
        if len(rows) > 1:
            w = np.array([vectors[i][term] for i in rows])
            out[np.ix_(rows, rows)] += np.multiply.outer(w, w)
    return out.astype("float64")


def tfidf(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): maps of term to weight, of length 1; texts without terms have none."""
    counted = rows.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    rarity = counted.groupBy("term").agg(F.count("*").alias("df"))
    n = rows.agg(F.count_distinct(key).alias("n"))
    weighted = counted.join(rarity, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    listed = weighted.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return listed.select(key, F.map_from_entries(F.transform("t", lambda x: F.struct(x["term"].alias("term"), (x["w"] / F.col("norm")).alias("w")))).alias("terms"))


def top_terms(rows: DataFrame, keys: list[str], term: str, k: int = 5) -> DataFrame:
    """(keys, term, n, rank): the k most frequent terms of every group, ties by the term."""
    counts = rows.groupBy(*keys, term).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), term))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine_of(a: Mapping[str, float], b: Mapping[str, float]) -> float:
    return sum(w * b[t] for t, w in a.items() if t in b)


def cluster_items(rows: DataFrame, key: str, text: str, threshold: float = 0.2, group: int = GROUP) -> DataFrame:
    """(key, cluster): average-link clusters of texts by TF-IDF; a cluster is named after its smallest key.

    Items are compared within the group of their heaviest term; groups of more than GROUP items are
    first split by their next terms' hash, so that none is held whole in one task.  Items without
    terms stand alone.
    """
    vectors = tfidf(rows, key, text)
    entries = F.array_sort(F.transform(F.map_entries("terms"), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("t"))))
    led = vectors.withColumns({"lead": F.get(entries, F.lit(0))["t"], "next": F.coalesce(F.get(entries, F.lit(1))["t"], F.lit(""))})
    sizes = led.groupBy("lead").agg(F.ceil(F.count("*") / group).alias("parts"))
    placed = led.join(sizes, "lead").withColumn("part", F.pmod(F.xxhash64("next"), F.col("parts")))
    order = Window.partitionBy("lead", "part").orderBy(key)
    placed = placed.withColumn("part2", F.floor((F.row_number().over(order) - 1) / group))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        keys, vectors_of = part[key].tolist(), [dict(t) for t in part["terms"]]
        found = clusters(similarities(vectors_of), threshold)
        return pd.DataFrame([(keys[i], keys[g[0]]) for g in found for i in g], columns=[key, "cluster"])

    kind = rows.schema[key].dataType.simpleString()
    found = placed.select(key, "terms", "lead", "part", "part2").groupBy("lead", "part", "part2").applyInPandas(run, f"{key} {kind}, cluster {kind}")
    alone = rows.select(key).distinct().join(vectors.select(key), key, "left_anti").select(key, F.col(key).alias("cluster"))
    return found.unionByName(alone)


def clarified(before: DataFrame, after: DataFrame, key: str = "item") -> DataFrame:
    """(items, contested_before, contested_after, settled, unsettled) of contested() rows of a rubric and of its revision, on the items both have."""
    split = lambda df, name: df.select(key, (F.col("split") > 0).alias(name))
    both = split(before, "b").join(split(after, "a"), key)
    b, a = F.col("b"), F.col("a")
    return both.agg(F.count("*").alias("items"), F.count_if(b).alias("contested_before"), F.count_if(a).alias("contested_after"), F.count_if(b & ~a).alias("settled"), F.count_if(~b & a).alias("unsettled"))
