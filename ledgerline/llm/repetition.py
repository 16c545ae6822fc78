"""Operator 8: quality rules on repetition, by rolling hashes in numpy.

For several n the characters inside n-grams of words that occur more than once in the text
(every occurrence counted, overlaps once) and the characters inside repeated lines are
measured as shares of the text's word characters. Word hashes of a whole run of texts
are rolled into n-gram hashes with array operations; no loop per word.

A text is kept unless it fails the base rules (under ``LEAST_WORDS`` words, or over
``MOST_REPEATED`` percent of them in repeated windows of five words), a share exceeds
its limit or symbols abound. The shares are about whole texts: a few repeated lines in a long text pass.

Defined results: a null or empty text has no words, so it fails the base rules with all counts
0; repeated rows get the same result; a null doc_id is measured like any other; an empty
table gives an empty result; other columns are not read. Memory grows with the longest
text (about 100 bytes a character), never with the table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import MIX_1, Words, chunks, mixed
from ledgerline.shipping import shipped

LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5
#: Largest share of word characters inside duplicated n-grams, by n, and inside repeated lines.
LIMITS = {2: 0.9, 3: 0.6, 5: 0.3, 8: 0.3, 10: 0.3}
LINE_LIMIT = 0.3
#: Most symbols for each word character.
SYMBOL_LIMIT = 0.05

SYMBOLS = re.compile(r"[#*$%&|<>]")

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double"


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys: which are found twice or more, and which of these aren't the first."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    more, again = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    more[order[1:][same]] = more[order[:-1][same]] = True
    again[order[1:][same]] = True
    return more, again


def repeated_windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of n words, and whether its text has the same words in another one.

    Windows meet by their rolling hash and are confirmed on the words; where one hash stands
    for different words, all windows are numbered by their words instead.
    """
    at, hashes = words.windows(n)
    keys = mixed(hashes + words.owner[at].astype(np.uint64) * MIX_1)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    x, y = order[1:][same], order[:-1][same]
    if words.same_windows(at[x], at[y], n).all():
        more = np.zeros(len(at), dtype=bool)
        more[x] = more[y] = True
        return at, more
    rows = np.column_stack([words.owner[at], *[words.ids[at + k] for k in range(n)]])
    return at, _repeated(np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1))[0]


def covered(words: Words, n: int) -> np.ndarray:
    """Which words stand inside a repeated window of n words."""
    at, more = repeated_windows(words, n)
    edges = np.zeros(len(words.ids) + 1, dtype=np.int32)
    edges[at[more]] += 1
    edges[at[more] + n] -= 1
    return np.cumsum(edges[:-1]) > 0


def repeated_lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that have a word: owner, whether equal to an earlier line of the text, first and last word (exclusive)."""
    data = words.bytes
    ends = np.flatnonzero(data == 0x0A)
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    some = first < last
    starts, ends, first, last = starts[some], ends[some], first[some], last[some]
    owner = words.owner[first]
    raw, number = data.tobytes(), {}
    lines = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.int64, count=len(starts))
    _, again = _repeated(owner * (len(number) + 1) + lines)
    return owner, again, first, last


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts and shares of each text."""
    words, n = Words(texts), len(texts)
    chars = words.code_points

    def by_text(of: np.ndarray) -> np.ndarray:
        return np.bincount(words.owner, weights=of, minlength=n).astype(np.int64)

    out = {"n_words": words.counts.astype(np.int64), "word_chars": by_text(chars)}
    out["n_symbols"] = np.fromiter((len(SYMBOLS.findall(t)) for t in texts), dtype=np.int64, count=n)
    whole = np.maximum(out["word_chars"], 1)
    for k in sorted({WINDOW, *LIMITS}):
        inside = covered(words, k)
        if k == WINDOW:
            out["n_repeat_words"] = by_text(inside)
        out[f"share_{k}"] = by_text(chars * inside) / whole
    owner, again, first, last = repeated_lines(words)
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n).astype(np.int64)
    edges = np.zeros(len(words.ids) + 1, dtype=np.int32)
    edges[first[again]] += 1
    np.add.at(edges, last[again], -1)
    out["dup_line_share"] = by_text(chars * (np.cumsum(edges[:-1]) > 0)) / whole
    return out


def judge(found: dict[str, np.ndarray], limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT, symbol_limit: float = SYMBOL_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept of each text."""
    failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
    kept = ~failed & (found["dup_line_share"] <= line_limit) & (found["n_symbols"] <= symbol_limit * found["word_chars"])
    for n, most in limits.items():
        kept &= found[f"share_{n}"] <= most
    return failed, kept


def repetition_rules(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Counts, base_failed, kept and the shares of every row; one pass, no shuffle."""
    limits = LIMITS if limits is None else limits
    if unknown := set(limits) - set(LIMITS):
        raise ValueError(f"n-gram lengths that are not measured: {sorted(unknown)}")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for start, texts in chunks(x.as_py() or "" for x in batch.column(1)):
                found = measure(texts)
                found["base_failed"], found["kept"] = judge(found, limits, line_limit)
                own = batch.column(0).slice(start, len(texts))
                shares = [pa.array(found[f"share_{n}"]) for n in sorted(LIMITS)]
                yield pa.RecordBatch.from_arrays([own, *[pa.array(found[x]) for x in names[1:]], *shares], [*names, *[f"share_{n}" for n in sorted(LIMITS)]])

    schema = SCHEMA + "".join(f", share_{n} double" for n in sorted(LIMITS))
    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, schema)
