"""Best-fit packing by a grouping genetic algorithm on islands.

A document of at most a window is one piece; a longer one is cut into full windows, before which the rest comes as a
first, shorter piece. Full windows are sequences of their own. What is packed are the shorter pieces, of which only the
lengths matter: a chromosome is a set of groups, a group being a pattern of lengths that share a bin and the number of bins
with that pattern, so its size hangs on the window and not on the corpus.

Crossover injects whole well-filled bins of one parent into the other, removes the bins there whose documents are now
placed twice, changes a document of a bin that has room for a longer displaced one, and puts the documents that are then
displaced where they fit best, longest first. Mutation empties some bins
and packs their documents again in another order. Populations live on islands, the groups of a Spark shuffle; after each
round an island's elite is also sent to the next. Every round is a written table, so a lost executor costs one round of
one island. Rounds end when the best plan meets the lower bound for any packing, or after ``rounds``.

The best plan says for ranges of ranks by length to which sequence they go. A piece's rank is the number of its length
before it in its task, counted while tokenising, and in earlier tasks, from a table of counts by task, so no length is one
task's, however many documents have it.

Defined cases: null or empty text has the end id alone; rows that repeat a doc_id are packed each by itself; pieces of
equal length are interchangeable; an empty table gives an empty table; other columns don't matter. Every id lies in one
piece, every sequence is gapless from 0.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinery.llm._common import bounded_batches, materialise, scratch_scope
from skeinery.llm.byte_tokens import ids_by

WINDOW = 1024
END_ID = 2
#: Islands, individuals on each, rounds (a migration after each) and children an island has in a round.
ISLANDS, POPULATION, ROUNDS, CHILDREN = 6, 10, 5, 40
SEED = 42

#: Lengths that share a bin, longest first, with how often each is in it.
Pattern = tuple[tuple[int, int], ...]


def filled(pattern: Pattern) -> int:
    return sum(a * m for a, m in pattern)


def lower_bound(counts: dict[int, int], window: int) -> int:
    """Bins that any packing needs: all tokens, and for each t the pieces over window - t, which share with none of at least t."""
    n = np.zeros(window + 1, np.int64)
    for a, m in counts.items():
        n[a] = m
    number, tokens = np.cumsum(n), np.cumsum(n * np.arange(window + 1))
    best = -(-int(tokens[-1]) // window)
    for t in range(1, window // 2 + 1):
        alone = int(number[window] - number[window - t])
        half = int(number[window - t] - number[window // 2])
        room = half * window - int(tokens[window - t] - tokens[window // 2])
        small = int(tokens[window // 2] - tokens[t - 1])
        best = max(best, alone + half + max(0, -(-(small - room) // window)))
    return best


class Bins:
    """Bins by pattern, with the patterns by the room they have left."""

    def __init__(self, window: int, groups: dict[Pattern, int] | None = None):
        self.window, self.by_room, self.open = window, [{} for _ in range(window + 1)], 0
        for pattern, n in (groups or {}).items():
            self.add(pattern, n)

    def add(self, pattern: Pattern, n: int) -> None:
        if n > 0:
            room = self.window - filled(pattern)
            own = self.by_room[room]
            own[pattern] = own.get(pattern, 0) + n
            self.open |= 1 << room

    def take(self, room: int) -> tuple[Pattern, int]:
        got = self.by_room[room].popitem()
        if not self.by_room[room]:
            self.open &= ~(1 << room)
        return got

    def fit(self, length: int, n: int) -> None:
        """Put ``n`` pieces of a length each where it leaves the least room; new bins where none has room."""
        while n:
            with_room = self.open >> length
            room = length + (with_room & -with_room).bit_length() - 1 if with_room else self.window
            pattern, bins = self.take(room) if with_room else ((), -(-n * length // self.window) + n)
            # The fullest bin with room stays the fullest, so it takes the length as often as it can.
            times = room // length
            whole = min(bins, n // times)
            self.add(extended(pattern, length, times), whole)
            n, bins = n - whole * times, bins - whole
            if bins and 0 < n < times:
                self.add(extended(pattern, length, n), 1)
                n, bins = 0, bins - 1
            if pattern:
                self.add(pattern, bins)

    def groups(self) -> dict[Pattern, int]:
        return {p: n for own in self.by_room for p, n in own.items()}


def extended(pattern: Pattern, length: int, times: int) -> Pattern:
    """``pattern`` with ``length`` ``times`` more often."""
    own = dict(pattern)
    own[length] = own.get(length, 0) + times
    return tuple(sorted(((a, m) for a, m in own.items() if m), reverse=True))


def fitness(groups: dict[Pattern, int]) -> tuple[int, int]:
    """Smaller is better: bins, then minus the squares of their fill, which prefers full bins beside emptier ones."""
    return sum(groups.values()), -sum(n * filled(p) ** 2 for p, n in groups.items())


def best_fit(free: dict[int, int], window: int, groups: dict[Pattern, int] | None = None, order: Iterable[int] | None = None) -> dict[Pattern, int]:
    """``groups`` with the pieces of ``free`` added, longest first unless an order is given."""
    bins = Bins(window, groups)
    for a in sorted(free, reverse=True) if order is None else order:
        bins.fit(a, free[a])
    return bins.groups()


def swap(free: Counter, window: int, groups: dict[Pattern, int]) -> dict[Pattern, int]:
    """``groups`` after each bin with room has changed one of its pieces for the longest displaced one that then fits; the shorter ones are displaced instead."""
    lengths, out = sorted(a for a, n in free.items() if n > 0), dict(groups)
    for pattern in sorted(groups, key=lambda p: (filled(p), p)):
        room = window - filled(pattern)
        best = (0, 0, 0)
        for b, _ in pattern if room else ():
            at = bisect_right(lengths, b + room)
            if at and lengths[at - 1] > b:
                best = max(best, (lengths[at - 1] - b, b, lengths[at - 1]))
        gain, b, a = best
        if gain and (n := min(out[pattern], free[a])) > 0:
            out[pattern] -= n
            changed = extended(extended(pattern, b, -1), a, 1)
            out[changed] = out.get(changed, 0) + n
            free[a] -= n
            free[b] += n
            if not free[a]:
                del lengths[bisect_right(lengths, a) - 1]
            at = bisect_right(lengths, b)
            if not at or lengths[at - 1] != b:
                lengths.insert(at, b)
    return out


def without(free: Counter, pattern: Pattern, n: int) -> int:
    """Take up to ``n`` bins of a pattern out of ``free``; how many could be taken."""
    n = min([n, *(free[a] // m for a, m in pattern)])
    if n > 0:
        for a, m in pattern:
            free[a] -= m * n
    return max(0, n)


def shuffled(lengths: Iterable[int], r: np.random.Generator, spread: float) -> list[int]:
    """Longest first, but for neighbours that changed places."""
    lengths = np.array(sorted(lengths, reverse=True))
    return lengths[np.argsort(-lengths * (1 + spread * r.standard_normal(len(lengths))), kind="stable")].tolist()


def crossover(giver: dict[Pattern, int], taker: dict[Pattern, int], counts: dict[int, int], window: int, r: np.random.Generator) -> dict[Pattern, int]:
    """Well-filled bins of ``giver``, what of ``taker`` has no document twice, fullest first, and the displaced put where they fit best."""
    room = int(r.choice([0, 1, 2, 4, 8, 16]))
    good = sorted(p for p in giver if window - filled(p) <= room)
    injected = [p for p, heads in zip(good, r.random(len(good)) < 0.5) if heads]
    free, child = Counter(counts), {}
    for p in injected:
        child[p] = without(free, p, giver[p])
    for p in sorted(taker, key=lambda p: (-filled(p), p)):
        child[p] = child.get(p, 0) + without(free, p, taker[p])
    child = swap(free, window, child)
    return best_fit({a: n for a, n in free.items() if n}, window, child)


def mutate(groups: dict[Pattern, int], window: int, r: np.random.Generator) -> dict[Pattern, int]:
    """Empty the least filled bins and a few others, and fit their documents again in another order."""
    patterns = sorted(groups, key=lambda p: (filled(p), p))
    gone = patterns[: int(r.integers(1, 4))] + [p for p, x in zip(patterns, r.random(len(patterns))) if x < 0.08]
    kept, free = dict(groups), Counter()
    for p in dict.fromkeys(gone):
        n = kept[p] if r.random() < 0.5 else -(-kept[p] // 2)
        kept[p] -= n
        for a, m in p:
            free[a] += m * n
    kept = swap(free, window, kept)
    return best_fit(free, window, kept, shuffled(free, r, float(r.choice([0.0, 0.05, 0.3]))))


def evolve(population: list[dict[Pattern, int]], counts: dict[int, int], window: int, bound: int, seed: int, size: int, children: int) -> list[dict[Pattern, int]]:
    """An island's next ``size`` individuals, fittest first; without a population it begins with best fits in several orders."""
    r = np.random.default_rng(seed)
    for i in range(size - len(population)):
        order = shuffled(counts, r, 0.02 * i) if population or i else None
        population = [*population, best_fit(counts, window, None, order)]
    ranked = sorted(((fitness(g), i, g) for i, g in enumerate(population)), key=lambda x: x[:2])
    for born in range(children):
        if ranked[0][0][0] <= bound:
            break
        a, b = (ranked[min(r.integers(0, len(ranked), 2))][2] for _ in range(2))
        child = crossover(a, b, counts, window, r)
        if a is b or r.random() < 0.5:
            child = mutate(child, window, r)
        fit = fitness(child)
        if all(fit != x[0] for x in ranked):
            ranked = sorted([*ranked, (fit, len(population) + born, child)], key=lambda x: x[:2])[:size]
    return [g for _, _, g in ranked[:size]]


def _stored(groups: dict[Pattern, int]) -> str:
    return json.dumps([[list(map(list, p)), n] for p, n in sorted(groups.items()) if n])


def _read(text: str) -> dict[Pattern, int]:
    return {tuple(map(tuple, p)): n for p, n in json.loads(text)}


def plan(spark: SparkSession, counts: dict[int, int], window: int = WINDOW, islands: int = ISLANDS, rounds: int = ROUNDS, population: int = POPULATION, children: int = CHILDREN, seed: int = SEED) -> dict[Pattern, int]:
    """Patterns of lengths with numbers of bins, that together use each of ``counts`` (pieces by length, below the window)."""
    if not counts:
        return {}
    bound = lower_bound(counts, window)
    schema = "island int, bins long, slack long, plan string"
    state = spark.range(islands).select(F.col("id").cast("int").alias("island"), F.lit(None).cast("string").alias("plan"))

    def life(step: int):
        def live(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            island = int(key[0])
            own = [_read(x) for x in sorted(rows["plan"].dropna())]
            own = evolve(own, counts, window, bound, seed * 1_000_003 + step * 1009 + island, population, children)
            out = [(island, *fitness(g), _stored(g)) for g in own]
            elite = ((island + 1) % islands, *out[0][1:])  # migrates; its original stays
            return pd.DataFrame([*out, elite], columns=["island", "bins", "slack", "plan"])

        return live

    for step in range(rounds):
        # By a number of partitions of its own, so that the islands aren't put together in one task.
        dealt = state.repartition(4 * islands, "island")
        state = materialise(dealt.groupBy("island").applyInPandas(life(step), schema), "islands")
        best = state.orderBy("bins", "slack", "plan").select("bins", "plan").first()  # at most islands x (population + 1) rows
        if best.bins <= bound:
            break
    return _read(best.plan)


def tokenised(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each of ``docs``: task, uid, ids, the length and checksum of a shorter first piece and its number among those of that length in its task, checksums of the full pieces."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, task int, uid long, doc_tokens long, rest int, rest_crc long, nth long, full_crcs array<long>"
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, end = ids_by(tokenizer), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        uid, met = task << 40, Counter()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of([t or "" for t in batch.column(1).to_pylist()])):
                view = memoryview(ids + end)
                n, step = len(view) // 4, 4 * window
                rest = n % window
                crcs = [zlib.crc32(view[at : at + step]) for at in range(4 * rest, 4 * n, step)]
                rows.append((doc_id, task, uid, n, rest, zlib.crc32(view[: 4 * rest]), met[rest], crcs))
                met[rest] += 1
                uid += max(1, len(crcs))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def placed(groups: dict[Pattern, int]) -> list[np.ndarray]:
    """Ranges of ranks by length, ascending: key (length << 44 | first rank), times in a bin, first sequence, offset of the first there."""
    ranges, used, sequences = [], Counter(), 0
    for pattern, n in sorted(groups.items(), reverse=True):
        offset = 0
        for a, m in pattern:
            ranges.append((a << 44 | used[a], m, sequences, offset))
            used[a] += m * n
            offset += a * m
        sequences += n
    return list(np.array(sorted(ranges), np.int64).reshape(-1, 4).T)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, **genetic) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset and doc_tokens. ``genetic``: what ``plan`` takes."""
    spark = docs.sparkSession
    rows = materialise(tokenised(docs, tokenizer, window, end_id), "best-fit-ids")
    has_rest = (F.col("rest") > 0).cast("int")
    full = rows.select("doc_id", "doc_tokens", "rest", "uid", F.posexplode("full_crcs").alias("k", "ids_crc32")).select(
        "doc_id",
        (F.col("k") + has_rest).alias("piece"),
        (F.col("rest") + F.col("k").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        ((F.col("uid") + F.col("k")) * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "doc_tokens",
    )
    short = rows.filter("rest > 0")
    by_task = materialise(short.groupBy("rest", "task").agg(F.count("*").alias("n")), "best-fit-counts")
    counts = {r.rest: r.n for r in by_task.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most window - 1 rows
    with scratch_scope(spark):
        keys, times, first, at = placed(plan(spark, counts, window, **genetic))
    shared = spark.sparkContext.broadcast((keys, times, first, at))  # a plan's patterns, whatever the corpus
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = by_task.select("rest", "task", earlier.alias("before"))

    @F.arrow_udf("struct<sequence: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, times, first, at = shared.value
        length, rank = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False)
        key = length << 44 | rank
        row = np.searchsorted(keys, key, side="right") - 1
        bin_, nth = np.divmod(key - keys[row], times[row])
        return pa.StructArray.from_arrays([pa.array(first[row] + bin_), pa.array(at[row] + nth * length)], ["sequence", "offset"])

    # Joined by task and length, which no task has more than a window's of; Spark broadcasts the counts only while they are small.
    ranked = short.join(before, ["rest", "task"]).withColumn("to", place(F.col("rest"), F.col("before") + F.col("nth")))
    first_pieces = ranked.select(
        "doc_id",
        F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.col("rest").cast("long").alias("length"),
        F.col("rest_crc").alias("ids_crc32"),
        (F.col("to.sequence") * 2 + 1).alias("sequence_id"),
        F.col("to.offset").alias("offset"),
        "doc_tokens",
    )
    return full.unionByName(first_pieces)


def sequences(pieces: DataFrame, docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; ``docs`` must have unique doc_ids here."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<long>")
    def ids(texts: pa.Array) -> pa.Array:
        end = np.array([end_id], "<u4").tobytes()
        return pa.array([np.frombuffer(x + end, "<u4").astype(np.int64) for x in ids_by(tokenizer)([t.as_py() or "" for t in texts])], pa.list_(pa.int64()))

    cut = pieces.join(docs.select("doc_id", ids(F.col("text")).alias("ids")), "doc_id")
    part = F.struct("offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["ids"])).alias("ids"))
