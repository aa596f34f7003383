"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The random field reads the regions around digits, @ and spelled-out addresses: a
region is a run of neighbouring words, a candidate segment is one to six of its words, and features of the whole
segment (digit groups, checksum, separators, parts of an address, the word before it) score each type. Entities are
bounded in length, so a dynamic program finds the jointly best boundaries and types in time linear in the region. The
weights are learnt by maximum likelihood (forward-backward over segments, numpy) from sentences made up here with a
fixed seed: written forms that the patterns know and that they don't (addresses spelled with [at] and [dot], telephone
numbers without a plus sign, cards with dots), and numbers that are none (dates, amounts, versions, order numbers, hex
keys).
Spans of the field that touch no base span are added; base spans stay.

Words without a digit, @ or such a mark can only be outside, so the best path between regions is known beforehand.

Defined cases: null text is the empty text and has no spans; patterns run over the whole text in linear time however
long it is; of a region of any length the field holds 26 bytes a word; repeated rows, an empty table and other columns are as anywhere. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import random
import re
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.llm._common import bounded_batches, spare

KINDS = ("email", "ip", "card", "phone")
#: Words that an entity can have.
MAX_WORDS = 6
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Nothing follows the repeated groups, so they need no way back: possessive, and a match of any length takes no memory.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
# A match can't begin within a run of digits where it couldn't at the run's start, so the look-behind loses none.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((lo, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by the patterns, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:  # 19 digits have 18 separators at most
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


_MARK = re.compile(r"[0-9@][^\s]*|[\[(](?:at|dot)[\])]", re.I)
_BLANK = re.compile(r"\s")
_SPELLED = re.compile(r"[\[(](?:at|dot)[\])]", re.I)
_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{,;:=", "\"'>]},;:!?."
_WORD_LEFT = re.compile(r"([^\s]+)[^\S\n]$")


class Words:
    """The (start, end) of words, as numbers side by side."""

    def __init__(self, words=()):
        self.at = array("q", (x for w in words for x in w))

    def append(self, start: int, end: int) -> None:
        self.at.append(start)
        self.at.append(end)

    def __len__(self) -> int:
        return len(self.at) // 2

    def __getitem__(self, i: int) -> tuple[int, int]:
        if not -len(self) <= i < len(self):
            raise IndexError(i)
        i %= len(self)
        return self.at[2 * i], self.at[2 * i + 1]

    def __eq__(self, other) -> bool:
        return isinstance(other, Words) and self.at == other.at


def _marked_words(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit, @ or spelled-out mark, and the neighbours of spelled-out marks, in order."""
    last = 0
    for m in _MARK.finditer(text):
        s, e = m.span()
        if s < last:
            continue
        spelled = text[s] in "[("
        while s > last and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        if spelled and s > last and text[s - 1] == " ":
            b = s - 1
            while b > last and not text[b - 1].isspace():
                b -= 1
            if b < s - 1:
                yield b, s - 1
        yield s, e
        last = e
        if spelled and e + 1 < len(text) and text[e] == " " and not text[e + 1].isspace():
            b = e + 1
            while b < len(text) and not text[b].isspace():
                b += 1
            yield e + 1, b
            last = b


def regions(text: str) -> Iterator[Words]:
    """Runs of neighbouring words that can hold an entity."""
    own, end = Words(), 0
    for s, e in _marked_words(text):
        if len(own) and not (s - end == 1 and text[end] == " "):
            yield own
            own = Words()
        own.append(s, e)
        end = e
    if len(own):
        yield own


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in _TRIM_LEFT:
        s += 1
    while e > s and text[e - 1] in _TRIM_RIGHT:
        e -= 1
    if s < e and text[e - 1] == ")" and "(" not in text[s:e]:
        e -= 1
    if s < e and text[s] == "(" and ")" not in text[s:e]:
        s += 1
    return s, e


#: Words before a number that tell what it is; any other word is "other".
_CUES = {w: k for k, ws in {
    "phone": "tel tel. tel: phone phone: call fax fax: mobile telefon téléphone teléfono",
    "card": "card card: visa mastercard iban karte carte tarjeta",
    "ip": "ip ip: host address server from",
    "email": "mail mail: email email: e-mail contact write",
    "count": "version v build order id id: no no. nr nr. page total costs about chapter isbn key token",
}.items() for w in ws.split()}


@lru_cache(maxsize=50_000)
def _features(segment: str, words: int, cue: str) -> tuple[str, ...]:
    digits = _NOT_DIGIT.sub("", segment)
    n, letters = len(digits), sum(c.isalpha() for c in segment)
    out = ["bias", f"words={words}", f"cue={cue}", f"digits={n if n < 20 else 20}", f"letters={min(letters, 4)}"]
    groups = [len(g) for g in re.findall("[0-9]+", segment)]
    out.append("groups=" + "-".join(str(min(g, 9)) for g in groups[:7]))
    out.append(f"n_groups={min(len(groups), 7)}")
    if 13 <= n <= 19:
        out.append(f"luhn={luhn(digits)}")
        out.append(f"long luhn={luhn(digits)} letters={letters > 0}")
    if letters:
        out.append(f"upper={segment.isupper()} at={'@' in segment}")
    if segment.startswith("+"):
        out.append("plus")
    if segment.startswith("("):
        out.append("parenthesis")
    for c in "@.-/:,$€%#=_":
        if c in segment:
            out.append(f"has {c}")
    spelled = [m[0][1:-1].lower() for m in _SPELLED.finditer(segment)]
    if spelled:
        out.append("spelled " + " ".join(spelled[:4]))
        ends = not _SPELLED.match(segment) and not re.search(r"[\])]$", segment)
        out.append(f"spelled whole={ends and spelled[:1] == ['at'] and 'dot' in spelled}")
    parts = segment.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append(f"address={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    if "@" in segment:
        out.append(f"mail={bool(re.fullmatch(r'[^@\s]+@[^@\s.]+([.][^@\s.]+)+', segment))}")
    if re.fullmatch(r"[0-9+().\- /]+", segment):
        out.append(f"number digits={n if n < 20 else 20} words={words}")
        out.append(f"number groups={len(groups)} plus={segment.startswith('+')}")
    return tuple(out)


def cue_of(text: str, start: int) -> str:
    m = _WORD_LEFT.search(text, max(0, start - 24), start)
    return _CUES.get(m[1].lower().strip("(\"'"), "other") if m else "none"


class SemiMarkov:
    """Types: 0 outside (single words), then the kinds. weights[type, feature] and bias-free transitions[type, type]."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.index, self.weights, self.transitions = index, weights, transitions

    def segments(self, text: str, words):
        """For each end word in turn: [(first word, span, feature numbers)]."""
        for j in range(len(words)):
            row = []
            for i in range(j, max(-1, j - MAX_WORDS), -1):
                s, e = trimmed(text, words[i][0], words[j][1])
                f = _features(text[s:e], j - i + 1, cue_of(text, words[i][0])) if e - s <= 200 else ("bias", "too long")
                row.append((i, (s, e), [k for k in map(self.index.get, f) if k is not None]))
            yield row

    def scores(self, row) -> np.ndarray:
        """Segment by type; outside is for single words alone."""
        got = np.array([self.weights[:, f].sum(axis=1) for _, _, f in row])
        got[1:, 0] = -np.inf
        for k, (_, (s, e), _) in enumerate(row):
            if s == e:
                got[k, 1:] = -np.inf
        return got

    def best(self, text: str, words) -> list[tuple[int, int, int]]:
        """The best segmentation's entities as (kind's number, start, end).

        Values are kept for the last ``MAX_WORDS`` words alone; a word and type have two bytes to find the way back by.
        """
        n, types = len(words), len(KINDS) + 1
        taken, came = np.zeros((n + 1, types), np.int8), np.zeros((n + 1, types), np.int8)
        value = np.full((MAX_WORDS + 1, types), -np.inf)
        value[0, 0] = 0
        for j, row in enumerate(self.segments(text, words)):
            from_ = np.stack([value[i % (MAX_WORDS + 1)] for i, _, _ in row])[:, :, None] + self.transitions
            total = from_.max(axis=1) + self.scores(row)
            k = total.argmax(axis=0)
            value[(j + 1) % (MAX_WORDS + 1)] = total[k, range(types)]
            taken[j + 1], came[j + 1] = k + 1, from_[k, :, range(types)].argmax(axis=1)
        out, j, t = [], n, int(value[n % (MAX_WORDS + 1)].argmax())
        while j:
            i = j - int(taken[j, t])
            if t:
                out.append((t - 1, *trimmed(text, words[i][0], words[j - 1][1])))
            j, t = i, int(came[j, t])
        return out[::-1]

    def gradient(self, text: str, words: list[tuple[int, int]], gold: list[tuple[int, int, int]]) -> float:
        """Add the log-likelihood's gradient for the gold segments (first word, last word, type); the log-likelihood."""
        n, types = len(words), len(KINDS) + 1
        rows = list(self.segments(text, words))
        got = [self.scores(r) for r in rows]
        ahead = np.full((n + 1, types), -np.inf)
        ahead[0, 0] = 0
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(n):
                terms = [np.logaddexp.reduce(ahead[i][:, None] + self.transitions, axis=0) + got[j][k] for k, (i, _, _) in enumerate(rows[j])]
                ahead[j + 1] = np.logaddexp.reduce(terms, axis=0)
            behind = np.full((n + 1, types), -np.inf)
            behind[n] = 0
            for j in range(n - 1, -1, -1):
                for k, (i, _, _) in enumerate(rows[j]):
                    behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(self.transitions + (got[j][k] + behind[j + 1])[None, :], axis=1))
            whole = np.logaddexp.reduce(ahead[n])
            likely = -whole
            for j in range(n):
                for k, (i, _, f) in enumerate(rows[j]):
                    joint = np.exp(ahead[i][:, None] + self.transitions + (got[j][k] + behind[j + 1])[None, :] - whole)
                    self.d_transitions -= joint
                    self.d_weights[:, f] -= joint.sum(axis=0)[:, None]
        prev = 0
        for i, j, t in gold:
            k = j - i
            likely += self.transitions[prev, t] + got[j][k][t]
            self.d_transitions[prev, t] += 1
            self.d_weights[t, rows[j][k][2]] += 1
            prev = t
        return float(likely)


def _luhn_number(r: random.Random, n: int) -> str:
    head = "4" + "".join(r.choice("0123456789") for _ in range(n - 2))
    return next(head + d for d in "0123456789" if luhn(head + d))


def examples(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, str]]]]:
    """Made-up regions: (text, [(kind's number or -1, piece)...]) with the pieces joined by blanks."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    byte = lambda: str(r.randint(0, 255))
    made = [
        lambda: (0, f"{w()}.{d(2)}@{w()}{d(1)}.example.{r.choice(['com', 'org', 'net'])}"),
        lambda: (0, f"{w()} [at] {w()} [dot] {r.choice(['com', 'org', 'net'])}"),
        lambda: (0, f"{w()} (at) {w()} (dot) {r.choice(['com', 'org', 'net'])}"),
        lambda: (0, f"{w()}.{w()} [at] {w()}.example [dot] com"),
        lambda: (1, ".".join(byte() for _ in range(4))),
        lambda: (2, _luhn_number(r, 16)),
        lambda: (2, r.choice(["-", ".", " "]).join(re.findall("....", _luhn_number(r, 16)))),
        lambda: (2, (lambda x: f"{x[:4]} {x[4:10]} {x[10:]}")(_luhn_number(r, 15))),
        lambda: (3, f"+{r.randint(1, 99)} ({d(3)}) 555-{d(4)}"),
        lambda: (3, f"({d(3)}) 555-{d(4)}"),
        lambda: (3, f"{r.randint(200, 999)}-555-{d(4)}"),
        lambda: (3, f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}"),
        lambda: (3, f"00{r.randint(10, 99)} {d(3)} {d(7)}"),
        lambda: (-1, f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"),
        lambda: (-1, f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}"),
        lambda: (-1, f"{d(r.randint(1, 3))}.{d(2)}"),
        lambda: (-1, f"${d(r.randint(1, 5))}"),
        lambda: (-1, d(r.randint(1, 7))),
        lambda: (-1, "1" + d(15)),
        lambda: (-1, f"{byte()}.{byte()}.{byte()}"),
        lambda: (-1, f"{d(1)}.{d(1)}.{d(4)}.{r.randint(300, 9999)}"),
        lambda: (-1, "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40]))) + d(1)),
        lambda: (-1, f'"{"".join(r.choice("0123456789abcdef") for _ in range(31))}{d(1)}"'),
        lambda: (-1, f"{w()}{d(2)}"),
        lambda: (-1, f"{w()}.{d(3)}"),
        lambda: (-1, "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(r.randint(12, 24))) + d(1)),
        lambda: (-1, r.choice(["", "ghp_", "sk-"]) + "".join(r.choice("ABCDEFGHIJKLabcdefghijkl0123456789") for _ in range(r.randint(16, 40)))),
        lambda: (-1, f"@{w()}"),
        lambda: (-1, f"{d(2)}:{d(2)}"),
        lambda: (-1, f"{r.randint(1, 99)}%"),
        lambda: (-1, f"{d(1)},{d(3)},{d(3)}"),
        lambda: (-1, f"http://{w()}.example.com/{d(5)}"),
        lambda: (-1, f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
    ]
    out = []
    for k in range(n):
        pieces = [made[k % len(made)]()] + [r.choice(made)() for _ in range(r.choice([0, 0, 0, 1, 1, 2]))]
        r.shuffle(pieces)
        pieces = [(t, p + r.choice(["", "", "", ",", ".", ";"]) if t >= 0 else p) for t, p in pieces]
        out.append((" ".join(p for _, p in pieces), pieces))
    return out


@cache
def trained(n: int = 600, epochs: int = 6, seed: int = 5) -> SemiMarkov:
    """The field, learnt with AdaGrad and a little shrinkage; the same for every call."""
    r = random.Random(seed)
    data = []
    for _, pieces in examples(n, seed):
        lead = r.choice(["", "", *(w + " " for w in _CUES), *("word " for _ in range(30))])
        text, words, gold, at = lead, [], [], len(lead)
        for k, (t, p) in enumerate(pieces):
            text += " " * (k > 0) + p
            at += k > 0
            first = len(words)
            for x in p.split(" "):
                words.append((at, at + len(x)))
                at += len(x) + 1
            at -= 1
            gold += [(first, len(words) - 1, t + 1)] if t >= 0 else [(i, i, 0) for i in range(first, len(words))]
        data.append((text, words, gold))
    index: dict[str, int] = {}
    probe = SemiMarkov(index, np.zeros((len(KINDS) + 1, 0)), np.zeros((len(KINDS) + 1,) * 2))
    for text, words, _ in data:
        for j in range(len(words)):
            for i in range(j, max(-1, j - MAX_WORDS), -1):
                s, e = trimmed(text, words[i][0], words[j][1])
                for f in _features(text[s:e], j - i + 1, cue_of(text, words[i][0])):
                    index.setdefault(f, len(index))
    types = len(KINDS) + 1
    model = SemiMarkov(index, np.zeros((types, len(index))), np.zeros((types, types)))
    seen_w, seen_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            model.d_weights, model.d_transitions = -1e-3 * model.weights, -1e-3 * model.transitions
            model.gradient(*data[k])
            seen_w += model.d_weights**2
            seen_t += model.d_transitions**2
            model.weights += 0.3 * model.d_weights / np.sqrt(seen_w)
            model.transitions += 0.3 * model.d_transitions / np.sqrt(seen_t)
    del model.d_weights, model.d_transitions, probe
    return model


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov) -> list[tuple[int, int, int]]:
    """The field's spans that touch no base span."""
    taken = sorted((s, e) for _, s, e in base)
    out, k = [], 0
    for words in regions(text):
        lo, hi = words[0][0], words[-1][1]
        while k < len(taken) and taken[k][1] <= lo:
            k += 1
        near, q = [], k
        while q < len(taken) and taken[q][0] < hi:
            near.append(taken[q])
            q += 1
        if len(words) == 1 and near and near[0][0] <= lo + 1 and near[0][1] >= hi - 2:
            continue  # a base span is all of it
        out += [(t, s, e) for t, s, e in model.best(text, words) if all(e <= a or s >= b for a, b in near)]
    return out


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base and spans: arrays of (kind, start, end), by kind as in KINDS and then start; spans holds both methods'."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>")
    def find(texts: pa.Array) -> pa.Array:
        field = model.value
        base, spans = [], []
        rows = lambda found: [{"kind": KINDS[t], "start": s, "end": e} for t, s, e in found]
        for t in texts:
            t = t.as_py() or ""
            b = base_spans(t)
            base.append(rows(b))
            spans.append(rows(sorted(b + added_spans(t, b, field))))
        return pa.StructArray.from_arrays([pa.array(base, span), pa.array(spans, span)], names=["base", "spans"])

    found = spare(docs.columns, "_found")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(found, find(F.col(text))).select(*kept, F.col(f"{found}.base").alias(spare(docs.columns, "base")), F.col(f"{found}.spans").alias(spare(docs.columns, "spans")))


def joined(spans):
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
