"""Packing by non-negative least squares over shallow length combinations.

A document's ids are cut into full windows, each a sequence of its own, and a tail. The tails' histogram (at most
window - 1 bins, whatever the corpus) decides the rest: combinations of two to four lengths that fill a window exactly
are enumerated, non-negative least squares solves how often each should be used so that the histogram is met, the
counts are rounded down, and what is left is packed greedily, longest first, each gap taking the longest that fits.
The result is a plan of rank ranges by length; a tail's rank among those of its length says which sequence it goes to.
Ranks come from counts by (length, salt), so a length that a third of the documents have is no single task's.

Defined cases: null or empty text has the end id alone; rows that repeat a doc_id are packed each by itself; equal
lengths are ranked in an arbitrary but complete order; an empty table gives an empty table; other columns don't
matter. Every id lies in exactly one piece, and every sequence is gapless from 0.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, filterfalse
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinery.llm._common import bounded_batches, materialise

WINDOW = 2048
END_ID = 1
SALTS = 32
#: Chunks of text whose ids a worker remembers, in two halves: when one is full, the other is forgotten but for what is asked for again.
REMEMBERED = 400_000
#: Runs of punctuation after words whose ids a worker remembers.
MARKS = 10_000
#: Characters whose words are in memory at once.
AT_ONCE = 1 << 20
_BLANK = re.compile(r"\s")


def _goes_by_words(tokenizer: dict) -> bool:
    """Whether a tokenizer lower-cases, drops the white space between words and marks a word's last token."""
    parts = [(tokenizer.get(k) or {}) for k in ("normalizer", "pre_tokenizer")]
    normal, pre = (x.get(k) or [x] for x, k in zip(parts, ("normalizers", "pretokenizers")))
    lowers = any(x.get("type") == "Lowercase" for x in normal)
    drops = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
    return lowers and drops and tokenizer["model"].get("end_of_word_suffix") == "</w>"


def _leaves_letters(tokenizer: dict) -> bool:
    """Whether lower-case ASCII letters reach the model of a tokenizer that goes by words as they are, a word as one piece."""
    normal = (tokenizer.get("normalizer") or {}).get("normalizers") or []
    pre = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers") or []
    harmless = all(x.get("type") in ("NFC", "Lowercase") or x.get("type") == "Replace" and x.get("pattern") == {"Regex": r"\s+"} for x in normal)
    pieces = [x.get("pattern") for x in pre[:1]] == [{"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}]
    return harmless and pieces and [(x.get("type"), x.get("add_prefix_space")) for x in pre[1:]] == [("ByteLevel", False)]


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, through a memory of words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in order. A run
    of punctuation after the letters of a word is a word of its own for it as well. New words of letters alone are encoded together,
    a thousand at once: each is one token sequence whose last token, and no other, has the end-of-word mark. Those of ASCII
    letters go to the model without the steps before it, where these would change nothing. Texts
    where this could fail (special tokens' marks, or separators that only Python takes for white space) go to the
    tokenizer whole; so does everything with a tokenizer that isn't of this kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        kind = json.loads(self.tokenizer.to_str())
        self.by_words, self.bare = _goes_by_words(kind), self.tokenizer
        if self.by_words and _leaves_letters(kind):
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer, self.bare.pre_tokenizer = None, WhitespaceSplit()
        self.marks: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.encode(texts)
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if "<|" in t or any(c in t for c in "\x1c\x1d\x1e\x1f")]
        for i, ids in zip(whole, self.encode([texts[i] for i in whole]) if whole else []):
            out[i] = ids
        self.forget()
        short = [i for i, t in enumerate(texts) if out[i] is None and len(t) <= AT_ONCE]
        split = [texts[i].split() for i in short]
        self.learn(chain.from_iterable(split))
        for i, words in zip(short, split):
            out[i] = b"".join(map(self.known.__getitem__, words))
        for i, text in enumerate(texts):
            if out[i] is None:
                parts = []
                for words in map(str.split, _slices(text)):
                    self.forget()
                    self.learn(words)
                    parts.append(b"".join(map(self.known.__getitem__, words)))
                out[i] = b"".join(parts)
        return out

    def forget(self) -> None:
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known

    def unknown(self, words: Iterable[str]) -> set[str]:
        """Those of ``words`` that aren't in memory; what its older half has moves to the newer one."""
        new, older = set(filterfalse(self.known.__contains__, words)), self.older
        if older:
            again = {w: older[w] for w in new if w in older}
            self.known.update(again)
            new.difference_update(again)
        return new

    def learn(self, words: Iterable[str]) -> None:
        """Have the ids of ``words`` in memory."""
        known, new = self.known, self.unknown(words)
        # Letters that any version of Unicode's tables knows, so that Python and the tokenizer agree.
        ascii_ = [w for w in new if w.isascii()]
        whole = [w for w in ascii_ if w.isalpha()]
        stopped = [(w, stem, w[len(stem) :]) for w in ascii_ if (stem := w.rstrip(punctuation)) and len(stem) < len(w) and stem.isalpha()]
        stems = " ".join(whole).lower().split() + " ".join([stem for _, stem, _ in stopped]).lower().split()
        self.learn_letters(self.unknown(set(stems)), self.bare)  # they will come again with other marks
        known.update(zip(whole, map(known.__getitem__, stems)))
        stopped = [(w, stem, mark) for (w, _, mark), stem in zip(stopped, stems[len(whole) :])]
        latin = [(w, stem, w[len(stem) :]) for w in new.difference(ascii_) if (stem := w.rstrip(punctuation)).isalpha() and max(stem) < "\u0250"]
        self.learn_letters(self.unknown({stem for _, stem, _ in latin}), self.tokenizer)
        stopped += [x for x in latin if x[2]]
        if len(self.marks) > MARKS:
            self.marks = {"": b""}
        marks = list({mark for _, _, mark in stopped}.difference(self.marks))
        self.marks.update(zip(marks, self.encode(marks)))
        known.update((w, known[stem] + self.marks[mark]) for w, stem, mark in stopped)
        others = [w for w in new if w not in known]
        for at in range(0, len(others), 1000):
            part = others[at : at + 1000]
            known.update(zip(part, self.encode(part)))

    def learn_letters(self, words: set[str], tokenizer) -> None:
        """The same for words of letters alone."""
        new = list(words)
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                data = ids.tobytes()
                self.known.update((w, data[lo:hi]) for w, lo, hi in zip(part, [0, *cuts], cuts))
            else:
                self.known.update(zip(part, self.encode(part)))


@cache
def word_ids(path: str) -> WordIds:
    """One memory for a worker process, kept from task to task."""
    return WordIds(path)


def _slices(text: str) -> Iterator[str]:
    """A long text in parts that end at white space, so that not all its words are in memory at once."""
    at = 0
    while at < len(text):
        m = _BLANK.search(text, at + AT_ONCE)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def tokenised(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): uid, number of ids, checksums of its full windows and its tail, its first sequence."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, uid long, doc_tokens long, first_window long, window_crcs array<long>, tail_crc long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        # Numbers by partition and place: the input is a stored table, so a repeated task counts alike.
        uid = windows = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of([t or "" for t in batch.column(1).to_pylist()])):
                view = memoryview(ids + end)
                n, step = len(view) // 4, 4 * window
                full = n // window
                crcs = [zlib.crc32(view[k * step : (k + 1) * step]) for k in range(full)]
                rows.append((doc_id, uid, n, windows, crcs, zlib.crc32(view[full * step :])))
                uid, windows = uid + 1, windows + full
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def combinations_filling(counts: dict[int, int], window: int, wide: int = 64, deep: int = 24) -> list[tuple[int, ...]]:
    """Length combinations that fill a window: all pairs; triples and fours whose first lengths are among the most frequent."""
    have = {x for x, n in counts.items() if n > 0}
    often = sorted(have, key=lambda x: (-counts[x], x))
    found = {(a, window - a) for a in have if a <= window - a and window - a in have}
    top = sorted(often[:wide])
    found |= {tuple(sorted((a, b, window - a - b))) for i, a in enumerate(top) for b in top[i:] if window - a - b in have}
    top = sorted(often[:deep])
    found |= {tuple(sorted((a, b, c, window - a - b - c))) for i, a in enumerate(top) for j, b in enumerate(top[i:], i) for c in top[j:] if window - a - b - c in have}
    return sorted(found)


def solve_nnls(combos: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 80) -> np.ndarray:
    """Repeat counts x >= 0 with least squared error of the lengths used against the histogram, by coordinate descent."""
    columns = [list(Counter(c).items()) for c in combos]
    norms = [sum(m * m for _, m in col) for col in columns]
    left, x = {k: float(n) for k, n in counts.items()}, [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for k, col in enumerate(columns):
            step = sum(m * left[a] for a, m in col) / norms[k]
            if step < -x[k]:
                step = -x[k]
            if step:
                x[k] += step
                moved = max(moved, abs(step))
                for a, m in col:
                    left[a] -= m * step
        if moved < 0.01:
            break
    return np.array(x)


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, times)...], repeats): patterns of at most a window that together use every tail exactly once."""
    left, out = {a: n for a, n in counts.items() if n > 0}, []
    combos = combinations_filling(left, window)
    for combo, x in zip(combos, np.floor(solve_nnls(combos, left) + 1e-6).astype(int).tolist()):
        used = sorted(Counter(combo).items(), reverse=True)
        if (x := min([x, *(left[a] // m for a, m in used)])) > 0:
            out.append((used, x))
            for a, m in used:
                left[a] -= m * x
    lengths = sorted((a for a, n in left.items() if n > 0), reverse=True)
    while lengths:
        used, gap = [], window
        for a in lengths:  # longest first: each is taken as often as it fits, so this is the longest for every gap
            if a <= gap:
                m = min(gap // a, left[a])
                used.append((a, m))
                gap -= a * m
        x = min(left[a] // m for a, m in used)
        out.append((used, x))
        for a, m in used:
            left[a] -= m * x
        lengths = [a for a in lengths if left[a] > 0]
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    rows = materialise(tokenised(docs, tokenizer, window, end_id), "tokenised")
    full = rows.select("doc_id", "doc_tokens", "first_window", F.posexplode("window_crcs").alias("k", "ids_crc32")).select(
        "doc_id",
        (F.col("k") * F.lit(window)).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        ((F.col("first_window") + F.col("k")) * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    tails = rows.select("doc_id", "uid", "doc_tokens", (F.col("doc_tokens") % window).alias("length"), "tail_crc").filter("length > 0")
    tails = tails.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
    by_salt = tails.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_salt = materialise(by_salt, "tail-counts")
    counts = {r.length: r.n for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window - 1 rows
    ranges, placed, sequences = [], Counter(), 0
    for used, repeats in plan(counts, window):
        offset = 0
        for a, m in used:
            ranges.append((a, placed[a], placed[a] + m * repeats, m, sequences, offset))
            placed[a] += m * repeats
            offset += a * m
        sequences += repeats
    ranges = spark.createDataFrame(ranges, "length long, lo long, hi long, times long, first long, at long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_salt.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    # Bounded whatever the corpus: at most window x salts rows here, and a few ranges for each of window lengths below.
    ranked = tails.withColumn("own", own).join(F.broadcast(offsets), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    put = ranked.join(F.broadcast(ranges), "length").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    place = F.col("rank") - F.col("lo")
    tail = put.select(
        "doc_id",
        (F.col("doc_tokens") - F.col("length")).alias("start"),
        "length",
        F.col("tail_crc").alias("ids_crc32"),
        "doc_tokens",
        ((F.col("first") + F.floor(place / F.col("times"))) * 2 + 1).alias("sequence_id"),
        (F.col("at") + (place % F.col("times")) * F.col("length")).alias("offset"),
    )
    return full.unionByName(tail)


def sequences(pieces: DataFrame, docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, padded with ``pad_id`` but for those at a power of two.

    ``docs`` must have unique doc_ids here.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<long>")
    def ids(texts: pa.Array) -> pa.Array:
        end = np.array([end_id], "<u4").tobytes()
        return pa.array([np.frombuffer(x + end, "<u4").astype(np.int64) for x in word_ids(tokenizer)([t.as_py() or "" for t in texts])], pa.list_(pa.int64()))

    cut = pieces.join(docs.select("doc_id", ids(F.col("text")).alias("ids")), "doc_id")
    cut = cut.select("sequence_id", F.struct("offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("piece"))
    joined = cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    padding = F.when(F.bit_count(n) == 1, F.array().cast("array<long>")).otherwise(F.array_repeat(F.lit(pad_id).cast("long"), F.lit(window) - n))
    return joined.select("sequence_id", F.concat("ids", padding).alias("ids"))
