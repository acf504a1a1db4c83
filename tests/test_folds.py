"""Folds are the greedy ones at every number of groups."""

import heapq
import random

from affinia.operators import splits


def greedy(sizes, k):
    heap, out = [(0, f) for f in range(k)], []
    for s in sizes:
        n, f = heapq.heappop(heap)
        out.append(f)
        heapq.heappush(heap, (n + s, f))
    return out


def test_turns_are_the_greedy_choice():
    r = random.Random(8)
    for _ in range(400):
        k = r.randint(1, 7)
        counts = sorted({r.choice([1, 2, 3, 7, 50, 1000]) * r.randint(1, 9): r.choice([1, 2, 5, 40, 700]) for _ in range(r.randint(1, 6))}.items(), reverse=True)
        got = []
        for (_, n), (_, steps) in zip(counts, splits._turns(counts, k)):
            stop = [s[0] for s in steps[1:]] + [len(got) + n]
            for (first, folds), end in zip(steps, stop):
                got += [folds[(p - first) % len(folds)] for p in range(first, end)]
        assert got == greedy([s for s, n in counts for _ in range(n)], k)


def test_one_rule_beyond_the_old_limit(spark):
    rows = [(0,)] * 500 + [(i,) for i in range(1, 301) for _ in range(1 + i % 5)]
    m = spark.createDataFrame(rows, "g long")
    got = splits.group_folds(m, "g", 5)
    assert sorted(got.collect()) == sorted(splits.group_folds(m, "g", 5).collect())
    order = got.orderBy(splits.F.desc("size"), splits.shuffled("g"), "g").collect()
    assert [r.fold for r in order] == greedy([r["size"] for r in order], 5)
    loads = {r.fold: r.s for r in got.groupBy("fold").agg(splits.F.sum("size").alias("s")).collect()}
    assert loads[0] == 500 and max(v for f, v in loads.items() if f) - min(v for f, v in loads.items() if f) <= 5
