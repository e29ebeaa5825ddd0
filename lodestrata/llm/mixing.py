r"""A selection of texts in which each source has its target share of all tokens.

Method: min-cost flow for overlapping sources. Texts are aggregated by membership pattern (the set of target sources
that hold a text). A flow routes the tokens of patterns to the quotas of sources; the first use of a text costs nothing,
each further one more than the one before, so texts are repeated as little and as evenly as the quotas allow. Texts are
then laid out in seeded order on a line for each pattern, round after round, and each source takes the texts whose
middle lies in its stretch of it.

* The total is the largest one at which every source with texts can reach its target, unless ``total_tokens`` sets it.
* A source uses a text at most its ``max_repeats`` times; over all sources a text is used at most as often as the most
  generous of its sources allows.
* Sources without target give nothing. Targets without texts can't be met; the others share in proportion, and the
  report says so. Whole texts are taken, so a share may be off by one text for each pattern.

Scale: what reaches the driver is one row for each pattern (2,047 for the eleven targets at most; more than
``MOST_PATTERNS`` are an error) and the targets. The total follows from the min-cut of each set of sources, so the flow is
solved once. Positions come from sums over hash buckets of each pattern, as many as leave about ``WINDOW`` texts in a window.

Defined results: null, empty and repeated texts: null and empty texts aren't used, equal texts are one text, of which the
least document id of each source stands for it. A null source has no target. Null or negative shares and repeats count
as 0. No texts or no targets: an empty selection, and a report of the targets with 0 tokens.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encoding
from .common import materialise

MOST_PATTERNS = 100_000
#: Texts in a window of running sums, on average, where a pattern has all of them.
WINDOW = 8192
#: Up to so many sums over sets of sources and patterns the total follows from all of them, beyond it from a search.
MOST_SUMS = 200_000_000


class Flow:
    """Min-cost flow with integer capacities by successive shortest paths."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y), self.cap.append(c), self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        """The greatest flow at the least cost."""
        total = 0
        while True:
            dist, via, inq = [None] * len(self.out), [-1] * len(self.out), [False] * len(self.out)
            dist[s], q = 0, deque([s])
            while q:
                a = q.popleft()
                inq[a] = False
                for e in self.out[a]:
                    b = self.to[e]
                    if self.cap[e] > 0 and (dist[b] is None or dist[a] + self.cost[e] < dist[b]):
                        dist[b], via[b] = dist[a] + self.cost[e], e
                        if not inq[b]:
                            inq[b] = True
                            q.append(b)
            if dist[t] is None:
                return total
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            total += push


def greatest_total(patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total at which every source reaches its quota. By max-flow and min-cut the quotas of each set of sources
    must not exceed what the patterns can give to that set."""
    names = sorted(targets)
    share = np.array([targets[s][0] for s in names])
    weight = sum(targets[s][0] for s in names)
    repeats = np.array([[targets[s][1] if s in p else 0 for s in names] for p, _ in patterns], np.float64)
    size = np.array([n for _, n in patterns], np.float64)
    sets = (np.arange(1, 1 << len(names))[:, None] >> np.arange(len(names))) & 1
    give = np.concatenate([np.minimum(b @ repeats.T, repeats.max(axis=1)) @ size for b in np.array_split(sets.astype(np.float64), max(1, len(sets) // 4096))])
    enough = lambda total: bool((sets @ np.floor(total * share / weight) <= give).all())
    part = sets @ share / weight
    all_uses = int(repeats.max(axis=1) @ size)
    lo, hi = min(int((give / part).min()), all_uses), min(int(((give + sets.sum(axis=1)) / part).min()) + 1, all_uses)
    while lo > 0 and not enough(lo):
        lo -= 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if enough(mid) else (lo, mid - 1)
    return lo


def route(patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict[tuple[int, str], int]]:
    """The total and the tokens that each source takes of each pattern (by its place in the list)."""
    names = sorted(s for s, (share, k) in targets.items() if share > 0 and k > 0 and any(s in p and n > 0 for p, n in patterns))
    weight = sum(targets[s][0] for s in names)
    if not names or not weight:
        return 0, {}

    def solve(goal: int) -> tuple[int, dict[tuple[int, str], int]]:
        f = Flow(2 + len(patterns) + len(names))
        place = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
        takes: dict[tuple[int, str], int] = {}
        for i, (p, n) in enumerate(patterns):
            own = [s for s in p if s in place]
            for use in range(max((targets[s][1] for s in own), default=0)):
                f.edge(0, 2 + i, n, use * use)
            for s in own:
                takes[i, s] = f.edge(2 + i, place[s], n * targets[s][1])
        for s in names:
            f.edge(place[s], 1, int(goal * targets[s][0] / weight))
        flow = f.run(0, 1)
        return flow, {k: f.cap[e ^ 1] for k, e in takes.items() if f.cap[e ^ 1]}

    if total is None and len(names) < 20 and len(patterns) << len(names) <= MOST_SUMS:
        total = greatest_total(patterns, {s: targets[s] for s in names})
    if total is None:
        lo, hi = 0, sum(n * max((targets[s][1] for s in p if s in targets), default=0) for p, n in patterns)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if solve(mid)[0] >= sum(int(mid * targets[s][0] / weight) for s in names):
                lo = mid
            else:
                hi = mid - 1
        total = lo
    return total, solve(total)[1]


class Mixture:
    """``docs`` (doc_id, text, source) and ``targets`` (source, target_share, max_repeats)."""

    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = "byte_bpe_50k", folder: str | None = None, seed: int = 11):
        spark = docs.sparkSession
        self.targets = {r["source"]: (max(r["target_share"] or 0.0, 0.0), max(r["max_repeats"] or 0, 0)) for r in targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").limit(MOST_PATTERNS).collect()}
        d = docs.where((F.length("text") > 0) & F.col("source").isin(list(self.targets))).select("doc_id", "text", "source")
        counts = encoding.Encoded(d, tokenizer=tokenizer, folder=folder).counts().groupBy("h").agg(F.max("n_tokens").alias("n_tokens"))
        one = d.select(F.col("doc_id").cast("long").alias("doc"), "source", F.xxhash64("text").alias("h"))
        held = one.groupBy("h", "source").agg(F.min("doc").alias("doc_id")).join(counts, "h")
        texts = held.groupBy("h").agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("docs"))
        texts = materialise(texts.select("h", "n_tokens", "docs", F.col("docs.source").alias("pattern"), F.xxhash64("h", F.lit(seed)).alias("place")), "texts")
        rows = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("texts")).sort(F.array_join("pattern", "\0")).limit(MOST_PATTERNS + 1).collect()
        if len(rows) > MOST_PATTERNS:
            raise ValueError("too many membership patterns")
        buckets = 1 + max((r["texts"] for r in rows), default=0) // WINDOW
        self.texts = texts.withColumn("bucket", F.pmod("place", F.lit(buckets)))
        patterns = [(tuple(r["pattern"]), int(r["n"])) for r in rows]
        self.total, flow = route(patterns, self.targets, total_tokens)
        at: dict[int, int] = {}
        stretches = []
        for (i, s), n in sorted(flow.items()):
            stretches.append((list(patterns[i][0]), s, at.get(i, 0), n, patterns[i][1]))
            at[i] = at.get(i, 0) + n
        self.stretches = spark.createDataFrame(stretches, "pattern array<string>, source string, from long, size long, round long")

    def selection(self) -> DataFrame:
        """(source, doc_id, n_tokens, uses): each text that a source uses, and how often."""
        sums = self.texts.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("s"))
        w = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("pattern", "bucket", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("start"))
        inside = Window.partitionBy("pattern", "bucket").orderBy("place", "h").rowsBetween(Window.unboundedPreceding, -1)
        x = self.texts.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        x = x.join(starts, ["pattern", "bucket"]).withColumn("at", F.col("start") + F.col("inside") + F.floor(F.col("n_tokens") / 2))
        x = x.join(F.broadcast(self.stretches), "pattern")
        upto = lambda c: F.ceil((c - F.col("at")) / F.col("round"))
        uses = upto(F.col("from") + F.col("size")) - upto(F.col("from"))
        doc = F.element_at(F.filter("docs", lambda d: d["source"] == F.col("source")), 1)["doc_id"]
        return x.select("source", doc.alias("doc_id"), "n_tokens", uses.cast("int").alias("uses")).where(F.col("uses") > 0)

    def report(self) -> DataFrame:
        """(source, target_share, max_repeats, n_texts, available_tokens, selected_tokens, actual_share, most_uses)."""
        spark = self.texts.sparkSession
        t = spark.createDataFrame([(s, float(a), int(b)) for s, (a, b) in sorted(self.targets.items())], "source string, target_share double, max_repeats int")
        have = self.texts.select(F.explode("docs.source").alias("source"), "n_tokens").groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_tokens").alias("available_tokens"))
        got = self.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("selected_tokens"), F.max("uses").alias("most_uses"))
        r = t.join(have, "source", "left").join(got, "source", "left").na.fill(0)
        total = F.sum("selected_tokens").over(Window.partitionBy(F.lit(0)))  # one row for each target
        r = r.withColumn("actual_share", F.coalesce(F.col("selected_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)))
        return r.select("source", "target_share", "max_repeats", "n_texts", "available_tokens", "selected_tokens", "actual_share", "most_uses")
