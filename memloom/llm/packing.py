"""Filling fixed-capacity containers with items (problem 6).

Sizes are whole token counts, so an instance is a histogram with at most ``capacity`` entries however many texts there are.
It is reduced by Martello and Toth's dominance rule (a set of at most three items that provably dominates every other filling
of its largest item's container is fixed), and what is left is packed best-fit decreasing, both on whole counts of equal
sizes at a time.  The result is a list of container patterns; its length depends on the capacity, not on the corpus.

Texts are then given to the patterns' places by their rank among texts of equal size.  Ranks are counted in blocks of texts
(by a hash of doc_id) with offsets per size and block, so a size that a third of all texts share is spread over all blocks.

A text longer than the capacity is split: full pieces take containers of their own, the rest is an item.  Null and empty
texts have 0 tokens and lie in container 0 of their pack.  Repeated documents are items of their own.  Null or non-positive
capacities are left out.  No texts give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from memloom.sources.scratch import materialize

#: Texts per block for ranking.
BLOCK = 50_000
MAX_PACKS = 1_000
#: Sum of capacities whose histograms and patterns the driver takes.
MAX_CAPACITY_SUM = 4_000_000

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((size, items per container), ...), containers


class _Sizes:
    """Counts of sizes with sorted access to those that are left."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.count = Counter({s: n for s, n in histogram.items() if s > 0 and n > 0})
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def smallest(self, n: int, without: Counter) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.count[s] - without[s])
            if len(out) == n:
                break
        return out

    def largest(self, most: int, without: Counter) -> int:
        """The largest size up to ``most`` of which an item is left beside ``without``; 0 if there is none."""
        i = bisect_right(self.sizes, most) - 1
        while i >= 0 and self.count[self.sizes[i]] - without[self.sizes[i]] <= 0:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def largest_second(self, room: int, without: Counter) -> int:
        """The largest y for which another item x >= y is left with x + y <= room; 0 if no two fit."""
        for i in range(bisect_right(self.sizes, room // 2) - 1, -1, -1):
            y = self.sizes[i]
            n = self.count[y] - without[y]
            if n >= 2:
                return y
            if n == 1:
                for x in self.sizes[i + 1 : i + 4]:
                    if x + y > room:
                        break
                    if self.count[x] - without[x] > 0:
                        return y
        return 0

    def best_pair(self, room: int, without: Counter) -> int:
        best = 0
        for y in self.sizes:
            if 2 * y > room:
                break
            if self.count[y] - without[y] <= 0:
                continue
            x = self.largest(room - y, without + Counter({y: 1}))
            if x:
                best = max(best, x + y)
        return best


def dominant(left: _Sizes, size: int, capacity: int) -> tuple[int, ...] | None:
    """The other items of a container of ``size`` that dominates all its fillings, or None.

    Only fillings with at most two others are decided: with at most one, the largest that fits; with two, either one item
    no smaller than any feasible pair, or a pair whose members bound those of every feasible pair.
    """
    one = Counter({size: 1})
    room = capacity - size
    small = left.smallest(3, one)
    if not small or small[0] > room:
        return ()
    top = left.largest(room, one)
    if top == room or len(small) < 2 or small[0] + small[1] > room:
        return (top,)
    if len(small) == 3 and sum(small) <= room:
        return None
    if top >= left.best_pair(room, one):
        return (top,)
    other = left.largest(room - top, one + Counter({top: 1}))
    if other and other >= left.largest_second(room, one):
        return (top, other)
    return None


def reduce_instance(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed containers and the histogram of the items that are left."""
    left, fixed = _Sizes(histogram), []
    again = True
    while again and left.sizes:
        again = False
        for size in sorted(left.sizes, reverse=True):
            while left.count[size]:
                others = dominant(left, size, capacity)
                if others is None:
                    break
                need = Counter((size, *others))
                n = min(left.count[s] // k for s, k in need.items())
                for s, k in need.items():
                    left.take(s, n * k)
                fixed.append((tuple(sorted(need.items())), n))
                again = True
    return fixed, dict(left.count)


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: equal containers are filled together."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: tuple[tuple[int, int], ...], n: int) -> None:
        if room not in open_:
            insort(rooms, room)
        open_[room].append((pattern, n))

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                pattern, m = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                each = capacity // size
                room, pattern, m = capacity, (), -(-n // each)
            each = room // size
            full = min(m, n // each)
            n -= full * each
            if full:
                put(room - full_size if (full_size := each * size) else room, (*pattern, (size, each)), full)
            if full < m and n:
                put(room - n * size, (*pattern, (size, n)), 1)
                m, n = m - 1, 0
            if m > full and pattern:
                put(room, pattern, m - full)
    return [(p, n) for groups in open_.values() for p, n in groups]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduce_instance(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern], first: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Per size the ranks at which a run of containers begins, its first container and its length; containers used."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    for pattern, n in patterns:
        for size, each in pattern:
            runs[size].append((used[size], first, n))
            used[size] += each * n
        first += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}, first


def pack(documents: DataFrame, packs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(pack_name, capacity_tokens, doc_id, piece_no, n_tokens, container_id): one row per piece of a text and pack."""
    return assign(materialize(token_counts(documents, folder, name), "tokens"), packs, block)


OUT = "pack_name STRING, capacity_tokens BIGINT, doc_id BIGINT, piece_no BIGINT, n_tokens BIGINT, container_id BIGINT"


def assign(sizes: DataFrame, packs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Containers for (doc_id, n_tokens) rows, which must come from a table that reads the same each time."""
    spark = sizes.sparkSession
    caps = packs.select("pack_name", F.col("capacity_tokens").cast("long").alias("c")).where("pack_name IS NOT NULL AND c > 0").distinct().limit(MAX_PACKS + 1).collect()
    if len(caps) > MAX_PACKS or sum(r.c for r in caps) > MAX_CAPACITY_SUM:
        raise ValueError("too many packs, or capacities too large for histograms on the driver")
    if not caps or sizes.isEmpty():
        return spark.createDataFrame([], OUT)
    each = F.array(*(F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.c).cast("long").alias("capacity_tokens")) for r in caps))
    n_blocks = max(1, -(-sizes.count() // block))
    items = (
        sizes.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)))
        .withColumn("p", F.explode(each))
        .select("doc_id", "n_tokens", "block", "p.*")
        .withColumn("n_full", F.when(F.col("n_tokens") > F.col("capacity_tokens"), F.expr("n_tokens div capacity_tokens")).otherwise(0))
        .withColumn("size", F.col("n_tokens") - F.col("n_full") * F.col("capacity_tokens"))
    )
    counts = items.groupBy("pack_name", "capacity_tokens", "size", "block").agg(F.count("*").alias("n"), F.sum("n_full").alias("n_full"))
    counts = materialize(counts, "sizes")
    hist: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    for r in counts.groupBy("pack_name", "capacity_tokens", "size").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        hist[r.pack_name, r.capacity_tokens][r.size] = r.n
    places, full_from = {}, {}
    for key, h in hist.items():
        places[key], full_from[key] = _places(pack_histogram(h, key[1]), 0)
    before = Window.partitionBy("pack_name", "capacity_tokens", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pack_name", "capacity_tokens", "size", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    fulls = counts.groupBy("pack_name", "capacity_tokens", "block").agg(F.sum("n_full").alias("n"))
    all_before = Window.partitionBy("pack_name", "capacity_tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fulls = fulls.select("pack_name", "capacity_tokens", "block", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("full_offset"))
    in_size = Window.partitionBy("pack_name", "capacity_tokens", "size", "block").orderBy("doc_id")
    ranked = items.withColumn("rank", F.row_number().over(in_size) - 1).join(offsets, ["pack_name", "capacity_tokens", "size", "block"]).withColumn("rank", F.col("rank") + F.col("offset"))
    shared = spark.sparkContext.broadcast(places)
    columns = ["pack_name", "capacity_tokens", "doc_id", "n_tokens", "n_full", "block", "size", "rank"]
    schema = pa.schema([("pack_name", pa.string()), ("capacity_tokens", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int64()), ("n_tokens", pa.int64()), ("container_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for b in batches:
            rows = b.select(["pack_name", "capacity_tokens", "doc_id", "n_full", "size", "rank"]).to_pydict()
            box = []
            for name, cap, size, rank in zip(rows["pack_name"], rows["capacity_tokens"], rows["size"], rows["rank"], strict=True):
                if size == 0:
                    box.append(0)
                    continue
                starts, firsts, lengths = places[name, cap][size]
                i = int(np.searchsorted(starts, rank, "right")) - 1
                box.append(int(firsts[i] + (rank - starts[i]) % lengths[i]))
            yield pa.RecordBatch.from_arrays([b.column("pack_name"), b.column("capacity_tokens"), b.column("doc_id"), pa.array(rows["n_full"], pa.int64()), pa.array(rows["size"], pa.int64()), pa.array(box, pa.int64())], schema=schema)

    rests = ranked.where("size > 0 OR n_full = 0").select(*columns).mapInArrow(run, OUT)
    firsts = F.create_map(*(x for (name, cap), n in full_from.items() for x in (F.lit(f"{name}\x00{cap}"), F.lit(n)))) if full_from else None
    long = items.where("n_full > 0")
    in_block = Window.partitionBy("pack_name", "capacity_tokens", "block").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        long.withColumn("at", F.coalesce(F.sum("n_full").over(in_block), F.lit(0)))
        .join(fulls, ["pack_name", "capacity_tokens", "block"])
        .withColumn("at", F.col("at") + F.col("full_offset") + F.element_at(firsts, F.concat("pack_name", F.lit("\x00"), F.col("capacity_tokens").cast("string"))))
        .select("pack_name", "capacity_tokens", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1)).alias("piece_no"), F.col("capacity_tokens").alias("n_tokens"), "at")
        .select("pack_name", "capacity_tokens", "doc_id", "piece_no", "n_tokens", (F.col("at") + F.col("piece_no")).alias("container_id"))
    )
    return rests.unionByName(pieces)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per pack: containers used, the least number any packing needs by volume, and the share of room that is filled."""
    used = packed.where("n_tokens > 0").groupBy("pack_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    per = used.groupBy("pack_name", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return per.select("pack_name", "capacity_tokens", "n_pieces", "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), "fullest", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled"))
