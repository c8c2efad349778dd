"""Near-duplicate records with small edits (problem 3): an exact set-similarity join by the general pigeonhole principle.

A record is the set of its distinct words, seen as a sparse bit vector.  Two sets of sizes a >= b and Jaccard similarity of
at least num/den share o >= num*(a+b)/(num+den) words.

*Partitions.*  Correlated bits are grouped: words that keep company with others far more often than by chance (the frames of
templates), and words in many records, form the common partition, of which nothing is asked (threshold -1); the rest is
divided by frequency into partitions of middling and of rare words.  The smaller set b shares at least
k(b) = ceil(2*num*b/(num+den)) - (its common words) words outside the common partition, so by the general pigeonhole
principle any minimal overlaps c_1..c_m with sum c_i = k + m - 1 have a partition i in which the pair shares c_i words.

*Thresholds.*  The c_i are unequal: for each number of partitions and each k a dynamic programme allocates them to minimise the
signatures and candidates counted in a sample; the cheapest plan wins.  Records whose k is too small for it have thresholds
of their own: the rare partitions keep theirs, and the middling words, as one partition, get what is left, k - sum (c_rare - 1).
Single words in order of rarity (partitions of one word, threshold 0 on the rarest n - ceil(num*n/den) + 1, -1 on the others)
serve the few that are left and very long records.  For both, the other records emit only the signatures that a fixed-size bit
map of the small records' signatures admits.

*Probe and verify.*  Each record emits a hash of each c_i-subset per partition; equal hashes are joined (sort-merge, split by
adaptive execution where a hash is hot), prefiltered by a 48-bit parity sketch whose Hamming distance is a lower bound, and
verified exactly on the words.  Nothing is sampled but the rows from which frequencies of company and plan costs are estimated
(``SAMPLE``); these decide cost, never results.

Equal word sets are one class: signatures are emitted for its first row only.  With ``most`` None, as in the query p3_found,
pairs are given between all rows of all classes, large classes in blocks of ``BLOCK`` rows; else classes of more than ``most``
rows are linked by their first row only, and the other pairs of their rows are left out.

Null payloads, payloads without words and patches of type slot have no pairs; repeated rows count once (counted rows).
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.scratch import materialize
from memloom.sources.tables import counted, norm_type

NUM, DEN = 3, 5
#: Rows of the sample for company and plan costs.
SAMPLE = 8_000
#: Words in this share of records or more are looked at for company; at most mean set size / FREQUENT words.
FREQUENT = 0.002
COMMON = 0.05
#: Subsets that a record may emit per partition; wider records take the single-word way.
MAX_SUBSETS = 400
EXPAND = 50
#: Rows of a class that meet as many of another, or of its own, in one key of the joins that list all pairs.
BLOCK = 1_000
MAP_BITS = 1 << 26
#: Number of the partition of all middling words.
JOINT = -1
#: Rows of (hash, first row) of repeated sets up to which they are broadcast rather than shuffled.
BROADCAST_ROWS = 300_000
SKETCH = 48
SIGNATURE_BITS = 40
# Relative costs of a signature row and of a candidate pair.
ROW_COST, PAIR_COST = 1.0, 0.02


@dataclass(frozen=True)
class Plan:
    """words: frequent word -> partition (0 common, then ``mid`` middling ones); rare words are spread over ``rare`` more."""

    words: dict[str, int]
    counts: dict[str, int]
    mid: int
    rare: int
    first: tuple[int, ...]
    num: int = NUM
    den: int = DEN

    @property
    def least(self) -> int:
        """The k from which the first thresholds find every pair."""
        return sum(self.first) - len(self.first) + 1

    @property
    def by_rare(self) -> int:
        """What the rare partitions' thresholds make up; a record of a lower k needs k - by_rare middling words in common."""
        return sum(c - 1 for c in self.first[self.mid :])

    @property
    def low(self) -> range:
        """Thresholds of the joint middling partition that records below ``least`` may have."""
        return range(2, self.least - self.by_rare)


def word_sets(patches: DataFrame) -> DataFrame:
    """(row_id, words): counted rows with words, not of type slot; words distinct, sorted, separated by blanks.

    Few rows are delivered again, so the rows that don't count are found on the keys alone, and the texts stay where they
    were read as long as those rows are few enough to be broadcast.
    """
    rows = patches.where("conv_id IS NOT NULL AND patch_id IS NOT NULL AND row_id IS NOT NULL")
    again = materialize(rows.groupBy("conv_id", "patch_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", "patch_id"), "again")
    few = again.count() <= BROADCAST_ROWS
    mark = F.broadcast if few else (lambda df: df)
    delivered = rows.select("conv_id", "patch_id", "ingested_at", "row_id").join(mark(again), ["conv_id", "patch_id"], "left_semi")
    first = counted(delivered, "row_id").select("row_id")
    lost = materialize(delivered.select("row_id").join(first, "row_id", "left_anti"), "lost")
    if lost.count() > BROADCAST_ROWS:
        mark = lambda df: df
    words = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("payload"), F.lit(r"([\p{L}\p{N}]+)"), 1))), " ")
    kept = rows.where("payload IS NOT NULL").where(~norm_type(F.col("patch_type")).eqNullSafe("slot")).select("row_id", "payload").join(mark(lost), "row_id", "left_anti")
    return kept.select("row_id", words.alias("words")).where("words <> ''")


def _keys() -> tuple:
    return F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("2"), "words").alias("h2")


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first rows of each class of equal sets, members): members is (row_id, rep, n) of classes of several rows.

    Classes are counted on 128-bit hashes with partial aggregation, so a class of a third of all rows stays spread.
    """
    twice = materialize(sets.select("row_id", *_keys()).groupBy("h1", "h2").agg(F.min("row_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    side = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    tagged = sets.select("row_id", "words", *_keys()).join(side, ["h1", "h2"], "left")
    return tagged.where("rep IS NULL OR rep = row_id").select("row_id", "words"), tagged.where("rep IS NOT NULL").select("row_id", "rep", "n")


def word_counts(reps: DataFrame) -> DataFrame:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

        for b in batches:
            v = pc.value_counts(pc.list_flatten(pc.split_pattern(b.column("words"), " ")))
            held.update(dict(zip(v.field("values").to_pylist(), v.field("counts").to_pylist(), strict=True)))
            if len(held) > 500_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return reps.select("words").mapInArrow(run, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


def company(sample: list[list[str]], frequent: dict[str, int]) -> set[str]:
    """Frequent words that at least two others keep company with, 5 times as often as by chance and in 3 of 10 records."""
    at = {w: i for i, w in enumerate(frequent)}
    x = np.zeros((len(sample), len(at)), np.float32)
    for i, words in enumerate(sample):
        for w in words:
            if w in at:
                x[i, at[w]] = 1
    both = x.T @ x
    own = np.maximum(np.diag(both).copy(), 1)
    given = both / own[:, None]
    np.fill_diagonal(given, 0)
    with_others = (given >= 0.3) & (given * len(sample) >= 5 * own[None, :])
    return {w for w, i in at.items() if with_others[i].sum() >= 2}


def allocate(tables: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Least cost of thresholds c_i >= 1 with the given sum, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for table in tables:
        nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, c) in best.items():
            for i in range(1, min(len(table), total - used + 1)):
                if cost + table[i] < nxt.get(used + i, (math.inf,))[0]:
                    nxt[used + i] = (cost + table[i], (*c, i))
        best = nxt
    return best.get(total, (math.inf, ()))


def make_plan(sample: list[list[str]], counts: dict[str, int], n: int, num: int = NUM, den: int = DEN) -> Plan:
    """counts: records per frequent word; n: records.

    Signatures and candidates per partition and threshold are counted in the sample and scaled to n records.
    """
    common = {w for w, c in counts.items() if c >= COMMON * n} | (company(sample, counts) if sample else set())
    middling = sorted(w for w in counts if w not in common)
    default = Plan(dict.fromkeys(common, 0), counts, 1, 1, (1,) * 2, num, den)
    if not sample:
        return default
    own = np.array([-(-2 * num * len(s) // (num + den)) - sum(w in common for w in s) for s in sample])
    rows = pa.array([" ".join(s) for s in sample])
    scale = (n / len(sample)) ** 2
    best, found = math.inf, default
    for rare, mid in itertools.product((1, 2, 3), (1, 2)):
        # Halves of the middling words with like frequencies in both.
        words = dict.fromkeys(common, 0) | {w: 1 + i % mid for i, w in enumerate(sorted(middling, key=lambda w: -counts[w]))}
        m = rare + mid
        trial = Plan(words, counts, mid, rare, (1,) * m, num, den)
        e = Emitter(trial)
        e.read(rows)
        made: dict[tuple[int, int], tuple[float, float]] = {}  # (partition, threshold) -> signatures a record, pairs in all
        for g in range(m):
            for c in range(1, 9):
                _, sig = e.family(g + 1, c, ~e.wide)
                _, k = np.unique(sig, return_counts=True)
                made[g, c] = len(sig) / len(sample), float((k * (k - 1.0)).sum() / 2 * scale)
        cost = [[0.0] + [ROW_COST * n * made[g, c][0] + PAIR_COST * made[g, c][1] for c in range(1, 9)] for g in range(m)]
        plans = {k: (x, c, float((own < k).mean())) for k in range(1, 13) for x, c in [allocate(cost, k + m - 1)] if c}
        joint = {}
        for c in range(2, 7):
            _, sig = e.family(JOINT, c, ~e.wide)
            _, k = np.unique(sig, return_counts=True)
            joint[c] = len(sig) / len(sample), float((k * (k - 1.0)).sum() / 2 * scale)
        for k, (x, c, _) in plans.items():
            plan = Plan(words, counts, mid, rare, c, num, den)
            total = x
            for i in plan.low:
                share = float((own == i + plan.by_rare).mean())
                sigs, pairs = joint.get(i, (MAX_SUBSETS, math.inf))
                if share:
                    met = min(n * sigs, n * sigs * (1 - math.exp(-share * n * sigs / MAP_BITS)) + 2 * share * pairs)
                    total += ROW_COST * (share * n * sigs + met) + PAIR_COST * 2 * share * pairs
            lone = float((own < 2 + plan.by_rare).mean())
            total += ROW_COST * n * 9 * (1 - math.exp(-lone * n * 9 / len(e.seen)))
            if total < best:
                best, found = total, plan
    return found


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Emitter:
    """Signatures of a batch of word sets."""

    def __init__(self, plan: Plan) -> None:
        self.plan = plan
        self.seen: dict[str, tuple[int, int, int]] = {}
        self.combos: dict[tuple[int, int], np.ndarray] = {}

    def _word(self, w: str) -> tuple[int, int, int]:
        """Hash, partition, place in the order of rarity."""
        hit = self.seen.get(w)
        if hit is None:
            h, g = _hash(w), self.plan.words.get(w)
            part = 1 + self.plan.mid + h % self.plan.rare if g is None else g
            hit = self.seen[w] = (h, part, self.plan.counts.get(w, 0))
            if len(self.seen) > 1_000_000:
                self.seen.clear()
        return hit

    def _subsets(self, n: int, c: int) -> np.ndarray:
        if (n, c) not in self.combos:
            self.combos[n, c] = np.array(list(itertools.combinations(range(n), c)), np.int64).reshape(-1, c)
        return self.combos[n, c]

    def read(self, words: pa.Array) -> None:
        lists = pc.split_pattern(words, " ")
        flat = pc.list_flatten(lists).dictionary_encode()
        codes = flat.indices.to_numpy()
        info = [self._word(w) for w in flat.dictionary.to_pylist()]
        self.size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.hash = np.array([x[0] for x in info], np.uint64)[codes]
        self.part = np.array([x[1] for x in info], np.int64)[codes]
        self.count = np.array([x[2] for x in info], np.int64)[codes]
        starts = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        parity = np.left_shift(np.uint64(1), _mix(self.hash, 99) % np.uint64(SKETCH))
        self.sketch = np.bitwise_xor.reduceat(parity, starts) if len(starts) else np.zeros(0, np.uint64)
        rows = len(self.size)
        p = self.plan
        self.n_in = np.stack([np.bincount(self.row[self.part == g], minlength=rows) for g in range(1 + p.mid + p.rare)]) if rows else np.zeros((1 + p.mid + p.rare, 0), np.int64)
        k = -(-2 * p.num * self.size // (p.num + p.den)) - self.n_in[0]
        self.wide = np.zeros(rows, bool)
        for g, ci in [*enumerate(p.first, 1), *((JOINT, c) for c in p.low)]:
            n = self._n(g)
            big = int(np.max(n, initial=0))
            limit = next((x for x in range(ci, big + 1) if math.comb(x, ci) > MAX_SUBSETS), big + 1)
            self.wide |= n >= limit
        self.own = k - p.by_rare
        self.level = np.where(self.wide, 3, np.where(k >= p.least, 1, np.where(self.own >= 2, 2, 3)))

    def _n(self, g: int) -> np.ndarray:
        return self.n_in[1 : 1 + self.plan.mid].sum(axis=0) if g == JOINT else self.n_in[g]

    def family(self, g: int, c: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, signatures) of all c-subsets in partition g of the marked rows."""
        within = (self.part >= 1) & (self.part <= self.plan.mid) if g == JOINT else self.part == g
        sel = within & rows[self.row]
        h, r, n = self.hash[sel], self.row[sel], self._n(g)
        out_r, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for size in np.unique(n[rows]):
            if size >= c and math.comb(int(size), c) <= MAX_SUBSETS:
                which = np.flatnonzero((n == size) & rows)
                m = h[n[r] == size].reshape(len(which), size)
                sig = _mix(m[:, self._subsets(int(size), c)].sum(axis=2, dtype=np.uint64), (g + 2) * 10 + c)
                out_r.append(np.repeat(which, sig.shape[1]))
                out_s.append(sig.ravel())
        return np.concatenate(out_r), np.concatenate(out_s)

    def subsets(self, c: tuple[int, ...], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._all([self.family(g, ci, rows) for g, ci in enumerate(c, 1)])

    @staticmethod
    def _all(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    def rarest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words, rarest first, of which a similar record must have at least one."""
        sel = rows[self.row]
        r, h, c = self.row[sel], self.hash[sel], self.count[sel]
        order = np.lexsort((h, c, r))
        r, h = r[order], h[order]
        if not len(r):
            return r, h
        first = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.concatenate([first, [len(r)]])))
        keep = place < (self.size - -(-self.plan.num * self.size // self.plan.den) + 1)[r]
        return r[keep], _mix(h[keep], 7)

    def needed(self) -> tuple[np.ndarray, np.ndarray]:
        """The further signatures of the records that the first thresholds don't serve."""
        return self._all([*(self.family(JOINT, c, (self.level == 2) & (self.own == c)) for c in self.plan.low), self.rarest(self.level == 3)])

    def offered(self) -> tuple[np.ndarray, np.ndarray]:
        """All signatures by which such a record may meet this one."""
        return self._all([*(self.family(JOINT, c, ~self.wide) for c in self.plan.low), self.rarest(np.ones(len(self.size), bool))])


def _wanted(reps: DataFrame, plan: Plan) -> np.ndarray | None:
    """Bit map of the further signatures of the records that need them; None if none do."""
    schema = pa.schema([("w", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Emitter(plan)
        for b in batches:
            e.read(b.column("words"))
            _, s = e.needed()
            pos = np.unique(s % np.uint64(MAP_BITS))
            word, at = np.unique(pos >> np.uint64(6), return_index=True)
            if len(pos):
                bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), pos & np.uint64(63)), at)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], schema=schema)

    rows = reps.select("words").mapInArrow(run, "w BIGINT, b BIGINT").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # MAP_BITS / 64 rows at most
    if not rows.num_rows:
        return None
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return bits.view(np.uint8)


_SIGNATURE = pa.schema([("sig", pa.int64()), ("row_id", pa.int64()), ("sketch", pa.int64())])


def _batch(e: Emitter, ids: np.ndarray, r: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """sketch has the parity bits, and in the byte above them the set size (255: 255 or more)."""
    packed = (e.sketch | (np.minimum(e.size, 255).astype(np.uint64) << np.uint64(SKETCH))).view(np.int64)
    order = np.argsort(r, kind="stable")  # a record's rows side by side compress well
    r, s = r[order], s[order] >> np.uint64(64 - SIGNATURE_BITS)
    return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(ids[r], pa.int64()), pa.array(packed[r])], schema=_SIGNATURE)


def signatures(reps: DataFrame, plan: Plan) -> DataFrame:
    """(sig, row_id, sketch) by the first thresholds."""
    shared = reps.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Emitter(shared.value)
        for b in batches:
            e.read(b.column("words"))
            yield _batch(e, b.column("row_id").to_numpy(), *e.subsets(e.plan.first, ~e.wide))

    return reps.select("row_id", "words").mapInArrow(run, "sig BIGINT, row_id BIGINT, sketch BIGINT")


def low_signatures(reps: DataFrame, plan: Plan, wanted: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Further signatures: of the records that need them, and of all records as far as the bit map admits them."""
    shared = reps.sparkSession.sparkContext.broadcast((plan, wanted))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Emitter(shared.value[0])
        for b in batches:
            e.read(b.column("words"))
            yield _batch(e, b.column("row_id").to_numpy(), *e.needed())

    def admitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, wanted = shared.value
        e = Emitter(plan)
        for b in batches:
            e.read(b.column("words"))
            r, s = e.offered()
            pos = s % np.uint64(MAP_BITS)
            hit = (wanted[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1
            yield _batch(e, b.column("row_id").to_numpy(), r[hit], s[hit])

    rows = reps.select("row_id", "words")
    schema = "sig BIGINT, row_id BIGINT, sketch BIGINT"
    return rows.mapInArrow(needed, schema), rows.mapInArrow(admitted, schema)


def _candidates(left: DataFrame, right: DataFrame, num: int, den: int, both_ways: bool) -> DataFrame:
    """Pairs of equal signatures whose sizes and sketches allow the similarity.  both_ways: left is right."""
    a = left.select("sig", F.col("row_id").alias("x"), F.col("sketch").alias("sk_x"))
    b = right.select("sig", F.col("row_id").alias("y"), F.col("sketch").alias("sk_y"))
    nx, ny = F.shiftrightunsigned("sk_x", SKETCH), F.shiftrightunsigned("sk_y", SKETCH)
    distance = F.bit_count(F.col("sk_x").bitwiseXOR(F.col("sk_y")).bitwiseAND(F.lit((1 << SKETCH) - 1)))
    most = nx + ny - 2 * F.expr(f"({num} * (shiftrightunsigned(sk_x, {SKETCH}) + shiftrightunsigned(sk_y, {SKETCH})) + {num + den - 1}) div {num + den}")
    near = (F.greatest(nx, ny) >= 255) | ((distance <= most) & (den * F.least(nx, ny) >= num * F.greatest(nx, ny)))
    order = F.col("x") < F.col("y") if both_ways else F.col("x") != F.col("y")
    return a.join(b, "sig").where(order & near).select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def similar_sets(reps: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(row_id_a, row_id_b, n_common, n_union), a < b, of rows with different word sets and similarity >= num/den."""
    n = reps.count()
    floor = max(2, math.ceil(FREQUENT * n))
    counts = {r.word: r.n for r in word_counts(reps).where(F.col("n") >= floor).collect()}  # at most mean set size / FREQUENT
    every = max(1, n // SAMPLE)
    sample = [r.words.split(" ") for r in reps.where(F.pmod(F.xxhash64("row_id"), F.lit(every)) == 0).select("words").limit(2 * SAMPLE).collect()]
    plan = make_plan(sample, counts, max(1, n), num, den)
    s = signatures(reps, plan)
    pairs = _candidates(s, s, num, den, True)
    wanted = _wanted(reps, plan)
    if wanted is not None:
        pairs = pairs.unionByName(_candidates(*low_signatures(reps, plan, wanted), num, den, False))
    pairs = pairs.distinct()
    va = reps.select(F.col("row_id").alias("row_id_a"), F.col("words").alias("wa"))
    vb = reps.select(F.col("row_id").alias("row_id_b"), F.col("words").alias("wb"))
    a, b = F.split("wa", " "), F.split("wb", " ")
    common = F.size(F.array_intersect(a, b))
    return (
        pairs.join(va, "row_id_a")
        .join(vb, "row_id_b")
        .select("row_id_a", "row_id_b", common.alias("n_common"), (F.size(a) + F.size(b) - common).alias("n_union"))
        .where(F.col("n_common") * den >= F.col("n_union") * num)
    )


def expand(pairs: DataFrame, members: DataFrame, most: int | None = EXPAND) -> DataFrame:
    """Pairs between first rows, and members of classes, to all pairs of rows.

    With ``most``, classes beyond so many rows stay linked by their first row only.
    """
    of = F.ceil(F.col("n") / BLOCK).cast("int")
    full = (members if most is None else members.where(F.col("n") <= most)).select("rep", "row_id", of.alias("of"), F.pmod(F.xxhash64("row_id"), of).cast("int").alias("block"))
    split = full.where("of > 1 AND rep = row_id")
    between = pairs.select("row_id_a", "row_id_b")
    for side in "ab":
        row = f"row_id_{side}"
        parts = split.select(F.col("rep").alias(row), F.col("of").alias("of_" + side))
        rows = full.select(F.col("rep").alias(row), F.col("block").alias("block_" + side), F.col("row_id").alias("m" + side))
        between = between.join(parts, row, "left").withColumn("block_" + side, F.explode(F.sequence(F.lit(0), F.coalesce("of_" + side, F.lit(1)) - 1))).join(rows, [row, "block_" + side], "left")
    # A class of one row has no members; a block of a split class may be empty.
    x, y = (F.coalesce("m" + s, F.when(F.col("of_" + s).isNull(), F.col("row_id_" + s))) for s in "ab")
    between = between.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    left = full.select("rep", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("of") - 1)).alias("j"), F.col("row_id").alias("x"))
    right = full.select("rep", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("row_id").alias("y"))
    out = between.unionByName(left.join(right, ["rep", "i", "j"]).where("i < j OR x < y").select("x", "y"))
    if most is not None:
        out = out.unionByName(members.where((F.col("n") > most) & (F.col("row_id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("row_id").alias("y")))
    return out.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def found(patches: DataFrame, most: int | None = EXPAND) -> DataFrame:
    """(row_id_a, row_id_b), a < b; all pairs with ``most`` None."""
    sets = materialize(word_sets(patches), "sets")
    reps, members = classes(sets)
    members = materialize(members, "members")
    return expand(similar_sets(reps), members, most)


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_id, group_id): connected components by alternating large and small stars, a written table per round.

    Each round sends a node's neighbours to its least neighbour; no neighbourhood is gathered into an array.
    """
    edges = materialize(pairs.select(F.greatest("row_id_a", "row_id_b").alias("u"), F.least("row_id_a", "row_id_b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, "edges")
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last:
            break
        last = sign
    top = edges.groupBy("u").agg(F.min("v").alias("group_id")).withColumnRenamed("u", "row_id")
    return nodes.select("row_id").join(top, "row_id", "left").select("row_id", F.coalesce("group_id", "row_id").alias("group_id"))


def groups(patches: DataFrame) -> DataFrame:
    """(row_id, group_id, n_links): one row per counted patch with words; n_links counts similar classes."""
    sets = materialize(word_sets(patches), "sets")
    reps, members = classes(sets)
    members = materialize(members, "members")
    pairs = materialize(similar_sets(reps).select("row_id_a", "row_id_b"), "pairs")
    star = members.where("row_id <> rep").select(F.col("rep").alias("row_id_a"), F.col("row_id").alias("row_id_b"))
    links = pairs.select(F.col("row_id_a").alias("rep")).unionByName(pairs.select(F.col("row_id_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    rep = members.select("row_id", "rep")
    named = components(sets, pairs.unionByName(star)).join(rep, "row_id", "left").withColumn("rep", F.coalesce("rep", "row_id"))
    return named.join(links, "rep", "left").select("row_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
