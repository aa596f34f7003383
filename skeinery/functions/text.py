"""Text as columns: terms, hashes, variants, modes, prompt sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}_]+"

# The words that tell a question's mode, first match wins, anywhere in the question.
MODES = (
    ("locate", ("where", "which file", "location", "located", "find file")),
    ("flow", ("how", "flow", "process", "works")),
    ("debug", ("bug", "issue", "problem", "error")),
)
INSTRUCTIONS = {
    "explain": "Say how the parts work together, with the architecture in view.",
    "locate": "Say where this is implemented, with file names and places.",
    "flow": "Go through what happens, one step after the other.",
    "debug": "Look for defects and say what could go wrong.",
}


def terms(text: Column) -> Column:
    """Lower-cased terms in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, lowercase hex."""
    return F.sha2(text, 256)


def expand_query(query: Column, suffixes) -> Column:
    """The query itself, then one variant for each suffix; ``suffixes`` is a sequence or an array column."""
    array = suffixes if isinstance(suffixes, Column) else F.array(*map(F.lit, suffixes)).cast("array<string>")
    return F.concat(F.array(query), F.transform(array, lambda s: F.concat_ws(" ", query, s)))


def parse_suffixes(raw: Column) -> Column:
    """Split at commas, strip, drop the empty."""
    return F.filter(F.transform(F.split(raw, ","), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def detect_mode(question: Column) -> Column:
    q, out = F.lower(question), None
    for mode, words in MODES:
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        out = F.when(hit, mode) if out is None else out.when(hit, mode)
    return out.otherwise("explain")


def mode_fallback(mode: Column, n_contexts: Column) -> Column:
    """With under 3 contexts, explain and flow become locate."""
    return F.when((n_contexts < 3) & mode.isin("explain", "flow"), "locate").otherwise(mode)


def instruction(mode: Column) -> Column:
    pairs = [F.lit(x) for kv in INSTRUCTIONS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), mode), F.lit(""))


def namespace_prefix(namespace: Column) -> Column:
    return F.when(F.coalesce(namespace, F.lit("")) != "", F.concat(F.lit("// namespace "), namespace, F.lit("\n"))).otherwise("")


def qualify(namespace: Column, name: Column) -> Column:
    """namespace.name, or whichever isn't empty."""
    return F.concat_ws(".", F.nullif(namespace, F.lit("")), F.nullif(name, F.lit("")))


def is_code_file(file_name: Column) -> Column:
    return F.coalesce(file_name, F.lit("")).endswith(".cs")


def section(rank: Column, file: Column, path: Column, score: Column, text: Column) -> Column:
    """One labelled part of a prompt; the score is shown with 3 digits."""
    return F.format_string("[%s] %s (%s) score=%s\n%s", rank.cast("string"), file, path, F.call_function("format_number", score, F.lit("0.0##")), text)


def token_count(text: Column) -> Column:
    """The default tokenizer's length: words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))
