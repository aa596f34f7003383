"""Spelling variant grouping by errata-trie merging: all pairs of words that are one edit apart.

A trie is held as a sorted array of words: a node is a range of words with a common beginning, its children are
sub-ranges. The nodes are decomposed into heavy paths: at each node the child with most words is followed, the others are
light, so a word lies in light subtrees only as often as a logarithm. At a node the light subtrees are merged with one
character skipped or replaced, the smaller into the larger: without their first character they form one errata subtree,
where coinciding terminals are words that differ in that character; that subtree is then merged into the heavy child's
(one more replaced character) and into the node's own (one skipped), and the light words themselves into the heavy
child's subtree with its first character skipped. Terminals that coincide are one-edit pairs.

One edit leaves two words of at least ``m`` characters a common beginning or a common end of (m - 1) / 2 characters. So
words go to groups by that many first characters, and reversed to groups by their last, and each group is a trie of its
own in one task. A group with over ``most`` words is merged by a shuffle at its topmost branching node, where words without
that node's character meet, and its children become groups; so a task holds a bounded number of words, whatever their
distribution, and no pair is lost.

Defined cases: null or empty texts have no words; a text of any length is read in slices; words of any length are taken; a
null doc_id counts as the empty string where occurrences are thinned; repeated rows count each; an empty table gives an
empty table; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm._common import bounded_batches, materialise, scratch_scope

#: Characters of a word at least, occurrences at least, and how much more frequent a word's form must be.
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: One occurrence in so many (by a checksum) loses a character.
THINNING = 199
#: Words in one task's trie at most.
MOST = 20_000
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 200_000
# Letters of ASCII in lower case, and U+00C0 to U+00FF, in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LETTERS = bytes([*range(97, 123), *range(128, 256)])
_AT_ONCE = 1 << 20


def runs(text: str) -> Iterator[list[bytes]]:
    """The text's runs of letters, A-Z lower-cased, a slice at a time."""
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z alone
    pending: list[bytes] = []
    for at in range(0, len(data), _AT_ONCE):
        part = data[at : at + _AT_ONCE]
        # The run that a slice ends in goes on in the next.
        cut = len(part.rstrip(_LETTERS)) if at + _AT_ONCE < len(data) else len(part)
        if cut:
            yield _RUN.findall(b"".join([*pending, part[:cut]]))
            pending = []
        pending.append(part[cut:])


def thinned(run: bytes, h: int, every: int = THINNING) -> bytes:
    """The run without the code point ``h`` % length if ``every`` divides ``h``."""
    if h % every:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = THINNING) -> DataFrame:
    """(word, n): words of ``docs`` (doc_id, text) that are long and frequent enough."""
    bounded_batches(docs.sparkSession)

    def handed(total: Counter) -> pa.RecordBatch:
        words = [w for w in total if len(w) >= min_chars and len(w.decode()) >= min_chars]
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(b"%s:" % (doc_id or "").encode())
                for part in runs(text or ""):
                    for run, n in Counter(part).items():
                        h = zlib.crc32(run, start)
                        total[run if h % every else thinned(run, h, every)] += n
                    if len(total) > COUNTED:
                        yield handed(total)
                        total = Counter()
        yield handed(total)

    partial = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def children(words: list[str], lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
    """Sub-ranges of the range by the character at ``depth``; a word that ends there comes first and is in none."""
    out = []
    at = lo + (len(words[lo]) == depth)
    while at < hi:
        # The first word beyond all that have this character here.
        beyond = bisect_left(words, words[at][:depth] + chr(ord(words[at][depth]) + 1), at, hi)
        out.append((at, beyond))
        at = beyond
    return out


def common(a: str, b: str, start: int) -> int:
    """How many first characters two words share, of which ``start`` are known."""
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def merged(words: list[str], depth: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of the distinct, ascending ``words`` that are one edit apart and share at least their first ``depth`` characters."""

    def at(word: str, lo: int, hi: int) -> int:
        i = bisect_left(words, word, lo, hi)
        return i if i < hi and words[i] == word else -1

    paths = [(0, len(words), depth)]
    while paths:
        lo, hi, depth = paths.pop()
        while hi - lo > 1:
            # Nodes with one child and no word of their own branch nowhere: no two words part there.
            depth = common(words[lo], words[hi - 1], depth)
            parts = children(words, lo, hi, depth)
            heavy = max(parts, key=lambda p: (p[1] - p[0], -p[0]))
            light = [p for p in parts if p != heavy]
            begin, first = words[lo][:depth], words[heavy[0]][depth]
            errata: dict[str, list[int]] = {}
            for a, b in light:
                for i in range(a, b):
                    rest = words[i][depth + 1 :]
                    own = errata.setdefault(rest, [])
                    yield from ((j, i) for j in own)  # replaced, both light
                    own.append(i)
                    # The light word itself beside the heavy subtree with its first character skipped.
                    if (j := at(begin + first + words[i][depth:], *heavy)) >= 0:
                        yield i, j
            for rest, own in errata.items():
                j, k = at(begin + first + rest, *heavy), at(begin + rest, lo, hi)
                for i in own:
                    if j >= 0:
                        yield i, j  # replaced, one heavy
                    # Skipped. Of a run of equal characters the last is the one that is missing.
                    if k >= 0 and rest[:1] != words[i][depth]:
                        yield k, i
            if len(words[lo]) == depth and (j := at(begin + first, *heavy)) >= 0:
                yield lo, j  # the node's own word, and the heavy child's
            paths += [(a, b, depth + 1) for a, b in light]
            (lo, hi), depth = heavy, depth + 1


def _side(backwards: bool) -> F.Column:
    return (F.reverse("word") if backwards else F.col("word")).alias("w")


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, most: int = MOST) -> DataFrame:
    """(u, nu, v, nv) with u < v: the pairs of ``words`` (word, n; distinct, of ``min_chars`` at least) that are one edit apart, each once."""
    shared = min_chars // 2  # of min_chars - 1 characters around the edit, the larger half
    sides = [words.select(F.lit(b).alias("back"), _side(b), "n") for b in (False, True)]
    open_ = sides[0].unionByName(sides[1]).withColumn("group", F.substring("w", 1, shared))
    found = []
    fine = None
    with scratch_scope(words.sparkSession):
        open_ = materialise(open_, "trie-words")
        while True:
            sizes = open_.groupBy("back", "group").agg(F.count("*").alias("of"), F.min("w").alias("low"), F.max("w").alias("high"))
            sizes = materialise(sizes, "trie-groups")
            small = open_.join(sizes.filter(F.col("of") <= most).select("back", "group"), ["back", "group"])
            fine = small if fine is None else fine.unionByName(small)
            large = sizes.filter(F.col("of") > most)
            if large.isEmpty():
                break
            # The topmost branching node of a group: what its first and last words share.
            apart = F.array_position(F.zip_with(F.split("low", ""), F.split("high", ""), lambda a, b: ~a.eqNullSafe(b)), True)
            at = open_.join(large.select("back", "group", (apart.cast("int") - 1).alias("depth")), ["back", "group"])
            at = materialise(at, "trie-large")
            found.append(materialise(_met(at), "trie-met", keep=True))
            below = at.filter(F.length("w") > F.col("depth"))
            open_ = materialise(below.select("back", "w", "n", F.substring("w", F.lit(1), F.col("depth") + 1).alias("group")), "trie-words")
        found.append(materialise(_in_tries(fine, shared), "trie-pairs", keep=True))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    # Found forwards and backwards, perhaps.
    return pairs.groupBy("u", "v").agg(F.first("nu").alias("nu"), F.first("nv").alias("nv")).select("u", "nu", "v", "nv")


def _ordered(pairs: DataFrame) -> DataFrame:
    """(u, nu, v, nv), read forwards, from (back, a, na, b, nb)."""
    a, b = (F.when(F.col("back"), F.reverse(x)).otherwise(F.col(x)) for x in ("a", "b"))
    p, q = F.struct(a.alias("w"), F.col("na").alias("n")), F.struct(b.alias("w"), F.col("nb").alias("n"))
    both = pairs.select(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    return both.select(F.col("p.w").alias("u"), F.col("p.n").alias("nu"), F.col("q.w").alias("v"), F.col("q.n").alias("nv"))


def _met(at: DataFrame) -> DataFrame:
    """Pairs that part at ``depth``: words without that character meet each other and the words that never had it.

    A list has one word for each character that can stand there, and one more.
    """
    one = F.struct("w", "n")
    depth = F.col("depth")
    gone = F.concat(F.substring("w", F.lit(1), depth), F.substring("w", depth + 2, F.length("w")))
    shorter = at.filter(F.length("w") > depth).select("back", gone.alias("key"), one.alias("x"))
    lists = shorter.unionByName(at.select("back", F.col("w").alias("key"), one.alias("x"))).groupBy("back", "key").agg(F.array_distinct(F.sort_array(F.collect_list("x"))).alias("xs"))
    each = lists.filter(F.size("xs") > 1).select("back", "xs", F.posexplode("xs").alias("i", "a"))
    pairs = each.select("back", "a", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("b"))
    return _ordered(pairs.select("back", F.col("a.w").alias("a"), F.col("a.n").alias("na"), F.col("b.w").alias("b"), F.col("b.n").alias("nb")))


def _in_tries(words: DataFrame, shared: int) -> DataFrame:
    """Pairs within the groups of ``words`` (back, group, w, n), each of which is one task's at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key, own: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
            names = [w for w, _ in own]
            out = []
            for i, j in merged(names, len(key[1])):
                out.append((key[0], *own[i], *own[j]))
                if len(out) == 10_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        key, own = None, []
        for batch in batches:
            for back, group, w, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (back, group) != key:
                    if len(own) > 1:
                        yield from pairs(key, own)
                    key, own = (back, group), []
                own.append((w, n))
        if len(own) > 1:
            yield from pairs(key, own)

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = (pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["back", "a", "na", "b", "nb"])

    dealt = words.select("back", "group", "w", "n").repartition("back", "group").sortWithinPartitions("back", "group", "w")
    return _ordered(dealt.mapInArrow(run, "back boolean, a string, na long, b string, nb long"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last of the chain of forms. Chains are short, as counts grow by a factor at each link; they are halved in each round."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = THINNING, most: int = MOST) -> DataFrame:
    """word, n, n_near (words one edit away), form (the most frequent of them, if ``ratio`` times as frequent), form_n and root (the last of the chain of forms)."""
    if min_chars < 2:
        raise ValueError("words of one character share neither a beginning nor an end")
    with scratch_scope(docs.sparkSession):
        words = materialise(word_counts(docs, min_chars, min_count, every), "words")
        pairs = materialise(near_pairs(words, min_chars, most), "near-pairs")
        both = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("nv").alias("of")).unionByName(pairs.select(F.col("v").alias("word"), F.col("u").alias("other"), F.col("nu").alias("of")))
        near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("of")).alias("minus"), "other")).alias("best"))
        every_word = words.join(near, "word", "left")
        much = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
        formed = every_word.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.minus")).alias("form_n")
        )
        formed = materialise(formed, "forms")
        last = roots(formed.filter("form IS NOT NULL").select("word", "form"))
        result = formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return materialise(result, "spelling", keep=True)
