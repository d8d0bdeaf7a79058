"""Filling containers of fixed capacity with documents: dominance reduction, then best fit.

Only the sizes matter, and there are at most as many of them as a container has tokens, so a job is solved on the
histogram of its sizes (bounded by the capacity, whatever the number of documents):

1. a document larger than the container gives full containers of its own and a rest, which is an item like others;
2. reduction after Martello and Toth: going down the sizes, a set of one, two or three items is fixed for good if it
   dominates every other set that holds its largest item - it fills the container exactly, or no further item fits, or
   its parts are at least as large as those of any other set that fits. Taking such sets away leaves the reasons for it
   true as long as every size in it has enough items left, so sets of the same sizes are fixed together;
3. what is left is packed by best fit in decreasing order of size, equal containers together.

The outcome is a list of patterns (which sizes, how often each, how many containers). The documents of a size then take
its places in hash order; their ranks are prefix sums in two steps, so one size may hold any share of the rows.

Documents without tokens (null or empty text) take no space and go to container 0. Capacities that are null or below 1
give no rows, nor do empty tables. Repeated rows are items of their own. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import prefix_sums
from rankloom.llm.tokens import with_tokens
from rankloom.runtime import catalog_rows, stash


class Sizes:
    """A multiset of sizes with what the reduction asks of it."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, k: int = 1) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def put(self, size: int, k: int = 1) -> None:
        if size not in self.n:
            insort(self.order, size)
            self.n[size] = 0
        self.n[size] += k

    def fitting(self, room: int) -> int | None:
        """The largest size of at most ``room``."""
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def smallest(self, k: int) -> int | None:
        """Sum of the k smallest items, None if there are fewer."""
        total = 0
        for s in self.order:
            m = min(k, self.n[s])
            total, k = total + m * s, k - m
            if not k:
                return total
        return None


def dominant(items: Sizes, size: int, capacity: int) -> tuple[int, ...] | None:
    """Items that go with one of ``size`` (already taken out) in a set that dominates all others, None if unknown."""
    room = capacity - size
    a = items.fitting(room)
    if a is None or a == room:
        return () if a is None else (a,)
    two, three = items.smallest(2), items.smallest(3)
    if two is None or two > room:
        return (a,)  # at most one item fits
    if three is not None and three <= room:
        return None  # sets of four and more would have to be compared
    # the largest smaller part of any pair that fits, and the largest pair
    least = pair = 0
    for i, low in enumerate(items.order):
        if 2 * low > room:
            break
        high = items.fitting(room - low)
        if high is not None and high >= low and (high > low or items.n[low] > 1):
            least, pair = low, max(pair, low + high)
    if not pair or a >= pair:
        return (a,)
    items.take(a)
    b = items.fitting(room - a)
    items.put(a)
    return (a, b) if b is not None and b >= least else None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Patterns (containers, {size: items in each}) fixed by dominance, and the counts of what is left."""
    items, done = Sizes(counts), []
    for size in sorted(counts, reverse=True):
        while items.n.get(size):
            items.take(size)
            others = dominant(items, size, capacity)
            items.put(size)
            if others is None:
                break  # it stays among the items that go with smaller ones
            pattern = Counter((size, *others))
            times = min(items.n[s] // k for s, k in pattern.items())
            for s, k in pattern.items():
                items.take(s, times * k)
            done.append((times, dict(pattern)))
    return done, items.n


def packed(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns that hold all items; sizes are from 1 to ``capacity``."""
    done, rest = reduced(counts, capacity)
    return done + best_fit(rest, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit in decreasing order; open containers of equal content are handled together."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    rooms: list[int] = []

    def add(room: int, times: int, content: dict[int, int]) -> None:
        if not open_[room]:
            insort(rooms, room)
        open_[room].append((times, content))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            room = rooms[i] if i < len(rooms) else capacity
            if i < len(rooms):
                times, content = open_[room].pop()
                if not open_[room]:
                    rooms.pop(i)
            else:
                times, content = left, {}
            each = min(room // size, left)  # the tightest container stays the tightest as it fills
            full = min(times, left // each)
            if content and times > full:
                add(room, times - full, content)
            add(room - each * size, full, {**content, size: each})
            left -= each * full
    return [x for r in rooms for x in open_[r]]


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size, runs of ranks: where they start, their first container, and the items in each container."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    first = 0
    for times, content in patterns:
        for size, each in content.items():
            runs[size].append((used[size], first, each))
            used[size] += times * each
        first += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for s, r in runs.items()}


def pieces(sizes: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job, doc_id, piece_no, n_tokens, is_full): items of each job; a full piece fills a container of its own."""
    j = jobs.where("job is not null and capacity_tokens >= 1").groupBy("job").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    rows = catalog_rows(j, 1000)
    if not rows:
        return sizes.limit(0).select(F.lit("").alias("job"), "doc_id", F.lit(0).cast("bigint").alias("piece_no"), "n_tokens", F.lit(False).alias("is_full"))
    each = F.explode(F.array(*[F.struct(F.lit(r.job).alias("job"), F.lit(r.capacity).alias("capacity")) for r in rows])).alias("j")
    c, n = F.col("j.capacity"), F.col("n_tokens")
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.ceil(n / c).cast("bigint") - 1)), lambda i: F.struct(i.alias("piece_no"), F.least(c, n - i * c).alias("n_tokens"), ((n > c) & (n - i * c >= c)).alias("is_full")))
    return sizes.select("doc_id", "n_tokens", each).select("j.job", "doc_id", F.explode(cut).alias("p")).select("job", "doc_id", "p.*")


def packed_documents(docs: DataFrame, jobs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(job, container_no, doc_id, piece_no, n_tokens, fixed): where every document, or piece of an oversized one, goes.

    ``fixed`` tells the places that the reduction fixed. The histogram of a job has at most as many sizes as its capacity.
    """
    sizes = stash(with_tokens(docs, ["doc_id"], tokenizer), "sizes")
    items = pieces(sizes, jobs)
    hist = items.groupBy("job", "is_full", "n_tokens").agg(F.count("*").alias("n")).collect()
    capacity = {r.job: int(r.capacity_tokens) for r in jobs.where("job is not null and capacity_tokens >= 1").groupBy("job").agg(F.max("capacity_tokens").alias("capacity_tokens")).collect()}
    table: dict[tuple[str, bool], dict] = {}
    bound: dict[str, int] = {}
    for job, cap in capacity.items():
        own = {r.n_tokens: r.n for r in hist if r.job == job and not r.is_full and r.n_tokens > 0}
        full = sum(r.n for r in hist if r.job == job and r.is_full)
        done, rest = reduced(own, cap)
        patterns = done + best_fit(rest, cap)
        table[job, False] = places(patterns)
        bound[job] = sum(t for t, _ in done)
        start = np.array([sum(t for t, _ in patterns)], dtype=np.int64)
        table[job, True] = {cap: (np.zeros(1, dtype=np.int64), start, np.ones(1, dtype=np.int64))} if full else {}
    ranked = prefix_sums(items.withColumns({"_h": F.xxhash64("doc_id", "piece_no"), "_one": F.lit(1)}), ["job", "is_full", "n_tokens"], "_h", "_one", sum(r.n for r in hist))

    def run(batches):
        for pdf in batches:
            out, fixed = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=bool)
            for (job, full, size), at in pdf.groupby(["job", "is_full", "n_tokens"]).indices.items():
                if size > 0:
                    starts, first, each = table[job, bool(full)][int(size)]
                    rank = pdf["before"].to_numpy()[at]
                    i = np.searchsorted(starts, rank, side="right") - 1
                    out[at] = first[i] + (rank - starts[i]) // each[i]
                    fixed[at] = out[at] < bound[job]
            pdf["container_no"], pdf["fixed"] = out, fixed
            yield pdf[["job", "container_no", "doc_id", "piece_no", "n_tokens", "fixed"]]

    return ranked.select("job", "is_full", "doc_id", "piece_no", "n_tokens", F.col("before").cast("bigint").alias("before")).mapInPandas(run, "job string, container_no bigint, doc_id bigint, piece_no bigint, n_tokens bigint, fixed boolean")


def fill_report(placed: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job, capacity_tokens, containers, tokens, least_containers, fill, fullest, items, fixed_items): how little space is left unused."""
    by = placed.groupBy("job", "container_no").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("k"), F.count_if("fixed").alias("f"))
    j = jobs.where("job is not null and capacity_tokens >= 1").groupBy("job").agg(F.max("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    out = by.groupBy("job").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("k").alias("items"), F.sum("f").alias("fixed_items")).join(j, "job")
    return out.select("job", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("bigint").alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"), "fullest", "items", "fixed_items")
