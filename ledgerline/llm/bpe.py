"""Operator 9: byte-pair encoding and decoding with contiguous rank arrays.

A short word is held as its part boundaries and the ranks of the pairs of adjacent
parts. The lowest rank is searched by a scan, its inner boundary deleted and the two
neighbouring ranks looked up again, until no pair has a rank. That is done for all new
words of a run of texts at once, a row of the arrays each, in numpy. Words of more than
``SHORT`` bytes, where repeated scans would be quadratic, use a heap.

Runs without white space are remembered once encoded, in two generations of which the elder
is forgotten when the younger has half of ``REMEMBERED`` runs or of ``REMEMBERED_BYTES``
bytes. More of them cost memory and save CPU time; ids are the same. So a worker holds those and what the texts at hand have, whatever the corpus: also
one of unspaced texts, whose runs are whole texts.

Defined results: null and empty texts have no ids and decode to an empty text; a text
that repeats, in one row or several, gets the same result each time; a null doc_id is
encoded like any other and stays null; an empty table gives an empty result; other
columns are not read. Strings of the special tokens in a text are those tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase
from tokenizers.normalizers import Sequence as Normalisers
from tokenizers.pre_tokenizers import Split

from ledgerline.llm.common import MIX_1, chunks, held
from ledgerline.shipping import shipped

SHORT = 48
REMEMBERED = 500_000
#: Characters of the runs, four bytes each, and bytes of their ids.
REMEMBERED_BYTES = 64 << 20
#: Words merged together, and characters of the texts whose words are.
BLOCK = 8192
CHUNK = 2 << 20
NEVER = np.int32(2**31 - 1)
#: No id: ends a run's ids where those of many are joined.
MARK = 2**32 - 1
#: White space as the vocabulary's normaliser takes it (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def _letters_and_numbers() -> tuple[str, ...]:
    """Bodies of character classes for the Unicode categories L and N, in the Unicode version of the tokenizers library: up to U+FFFF, then beyond."""
    every = ["".join(chr(c) for c in range(a, a + 0x2000) if not 0xD800 <= c < 0xE000) for a in range(0, sys.maxunicode + 1, 0x2000)]
    out = []
    for part in (every[:8], every[8:]):
        runs_of = ([m[0] for plane in part for m in Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(plane)] for kind in "LN")
        out += ["".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in found) for found in runs_of]
    return tuple(out)


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """Contractions, runs of letters, single numbers, runs of anything else but white space.

    The alternatives begin with different characters, except the last, so their order is free.
    Characters beyond U+FFFF have classes of their own: Python tries their ranges one by one, for every
    character that is in none, where those below are looked up.
    """
    letters, numbers, far_letters, far_numbers = _letters_and_numbers()
    far = "\\U00010000-\\U0010ffff"
    other, far_other = f"[^{WHITE}{letters}{numbers}{far}]", f"[^\\x00-\\uffff{far_letters}{far_numbers}]"
    return re.compile(f"(?:[{letters}]++|(?=[{far}])[{far_letters}]++)++|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|(?=[{far}])[{far_numbers}]|(?:{other}++|(?=[{far}]){far_other}++)++")


#: A run without white space; what :meth:`str.split` parts by, but for the four separators that it alone takes as blank.
_RUNS = re.compile(f"[^{WHITE}]+").findall
_SEPARATORS = re.compile("[\x1c-\x1f]").search


def runs(text: str) -> list[str]:
    """The runs without white space; no word spans two of them, whatever normalisation does."""
    return _RUNS(text) if _SEPARATORS(text) else text.split()


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Pairs:
    """Ranks of pairs of ids, looked up for whole arrays: a hash table with open addressing."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.bits = max(4, len(pairs).bit_length() + 3)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NEVER, dtype=np.int32)
        for rank, (a, b) in enumerate(pairs):
            key = a << 32 | b
            k = (key * int(MIX_1) & 2**64 - 1) >> (64 - self.bits)
            while self.keys[k] >= 0:
                k = (k + 1) & (1 << self.bits) - 1
            self.keys[k], self.ranks[k] = key, rank

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        k = (key.astype(np.uint64) * MIX_1 >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[k]
        out = np.where(held == key, self.ranks[k], NEVER)
        open_ = np.nonzero((held != key) & (held >= 0))
        while len(open_[0]):
            k[open_] = (k[open_] + 1) & (1 << self.bits) - 1
            held, wanted = self.keys[k[open_]], key[open_]
            found = held == wanted
            out[tuple(x[found] for x in open_)] = self.ranks[k[open_][found]]
            open_ = tuple(x[(held >= 0) & ~found] for x in open_)
        return out


class _Remembered(dict):
    """Runs and their numbers, given when a run is first asked for; and the ids of each number, put in by :meth:`append`."""

    def __init__(self):
        self.added: list[str] = []
        self.bytes = self.filled = self.known = 0
        self.flat = np.zeros(1 << 16, dtype="<u4")
        self.starts, self.sizes = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def __missing__(self, run: str) -> int:
        k = self[run] = len(self)
        self.added.append(run)
        return k

    def append(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray | None = None) -> None:
        """The ids of the next numbers: places in ``ids``, one after the other unless ``starts`` says where."""
        if self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.filled], ids, np.zeros(self.filled + len(ids), dtype="<u4")))
        else:
            self.flat[self.filled : self.filled + len(ids)] = ids
        if self.known + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate((x, np.zeros(len(x) + len(sizes), dtype=np.int64))) for x in (self.starts, self.sizes))
        own = slice(self.known, self.known + len(sizes))
        self.sizes[own] = sizes
        self.starts[own] = self.filled + (np.cumsum(sizes) - sizes if starts is None else starts)
        self.filled, self.known = self.filled + len(ids), self.known + len(sizes)

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these numbers in one row, and how many each has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


class WordBpe:
    """Encoder and decoder for a vocabulary file with word ends."""

    def __init__(self, path: str, remembered: int | None = None):
        self.remembered = remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pairs = [(vocab[a], vocab[b]) for a, b in model["merges"]]
        self.rank_of = {x: rank for rank, x in enumerate(pairs)}
        self.ranks_of = _Pairs(pairs)
        #: The id that the pair of each rank becomes.
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]] or [0], dtype=np.int64)
        self.inner = np.array([vocab[x] for x in _byte_letters()], dtype=np.int64)
        self.last = np.array([vocab[x + model["end_of_word_suffix"]] for x in _byte_letters()], dtype=np.int64)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = re.compile(word_pattern().pattern + "|\n").findall
        self.normaliser = Normalisers([NFC(), Lowercase()]).normalize_str
        self.now, self.elder = self._young(), self._young()

    def normalise(self, text: str) -> str:
        """NFC and lower case letter by letter, in the library's Unicode version."""
        return text.lower() if text.isascii() else self.normaliser(text)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: list[bytes] = [b""] * len(raw)
        order = np.argsort(sizes, kind="stable")
        short = order[: np.searchsorted(sizes[order], SHORT, side="right")]
        for block in np.split(short, range(BLOCK, len(short), BLOCK)):
            for i, ids in zip(block.tolist(), self._merge_short([raw[i] for i in block.tolist()], sizes[block]), strict=True):
                out[i] = ids
        for i in order[len(short) :].tolist():
            out[i] = self._merge_long(raw[i])
        return out

    def _letters(self, raw: bytes) -> np.ndarray:
        """The ids of a word's bytes, the last one's with the word's end."""
        codes = np.frombuffer(raw, dtype=np.uint8)
        ids = self.inner[codes]
        ids[-1] = self.last[codes[-1]]
        return ids

    def _merge_short(self, raw: list[bytes], sizes: np.ndarray) -> list[bytes]:
        """Rows of ``parts`` are the ids between the boundaries left; ``ranks[:, i]`` is the rank of parts i and i + 1."""
        if not raw:
            return []
        n, width = len(raw), int(sizes[-1])
        codes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        row, stops = np.repeat(np.arange(n), sizes), np.cumsum(sizes)
        parts = np.full((n, width), -1, dtype=np.int64)
        parts[row, np.arange(len(codes)) - np.repeat(stops - sizes, sizes)] = self.inner[codes]
        parts[np.arange(n), sizes - 1] = self.last[codes[stops - 1]]
        done, left, at = np.full((n, width), -1, dtype=np.int64), sizes.copy(), np.arange(n)
        ranks = np.where(parts[:, 1:] >= 0, self.ranks_of(parts[:, :-1], parts[:, 1:]), NEVER)
        while ranks.shape[1]:
            i = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(i)), i]
            go = lowest < NEVER
            if not go.all():
                done[at[~go], : parts.shape[1]] = parts[~go]
                parts, ranks, at, i, lowest = parts[go], ranks[go], at[go], i[go], lowest[go]
            rows = np.arange(len(i))
            parts[rows, i] = self.merged[lowest]
            # The boundary after part i goes, and with it part i + 1 and rank i.
            place = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, place + (place > i[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, place[:-1] + (place[:-1] >= i[:, None]), axis=1)
            left[at] -= 1
            for change in (i, i - 1):
                some = np.flatnonzero((change >= 0) & (change + 1 < left[at]))
                k = change[some]
                ranks[some, k] = self.ranks_of(parts[some, k], parts[some, k + 1])
        done[at, : parts.shape[1]] = parts
        flat = done[np.arange(width) < left[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(left)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, raw: bytes) -> bytes:
        parts, rank_of = self._letters(raw).tolist(), self.rank_of
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, parts[i], parts[i + 1]) for i in range(n - 1) if (found := rank_of.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := rank_of.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (found, x, parts[x], parts[y]))
        return np.array([x for x in parts if x >= 0], dtype="<u4").tobytes()

    def _young(self) -> _Remembered:
        """A generation that knows the special tokens alone, behind a blank, which no run has."""
        out = _Remembered()
        for special, i in self.special.items():
            out[" " + special]
            out.append(np.array([i], dtype="<u4"), np.array([1]))
        out.added.clear()
        return out

    def _learn(self) -> None:
        """Have the ids of the runs that ``now`` has numbered but doesn't know yet, in the order of their numbers."""
        now, elder = self.now, self.elder
        added, now.added = now.added, []
        if not added:
            return
        places = list(map(elder.get, added))
        new = [run for run, k in zip(added, places, strict=True) if k is None]
        known = np.array([k for k in places if k is not None], dtype=np.int64)
        fresh, sizes = self._encoded(new) if new else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))
        old, old_sizes = elder.ids_of(known)
        # Both kinds in one row each, then dealt to their numbers.
        is_new = np.fromiter((k is None for k in places), dtype=bool, count=len(places))
        starts, lengths = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        lengths[is_new], lengths[~is_new] = sizes, old_sizes
        starts[is_new], starts[~is_new] = np.cumsum(sizes) - sizes, len(fresh) + np.cumsum(old_sizes) - old_sizes
        now.append(np.concatenate((fresh, old)), lengths, starts)
        now.bytes += 4 * sum(map(len, added)) + 4 * int(lengths.sum())

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these runs in one row, and how many each has."""
        # Line feeds, which no run has, part the runs; normalisation changes nothing across them.
        words = self.words(self.normalise("\n".join(new) + "\n"))
        distinct = list(set(words) - {"\n"})
        ids_of = dict(zip(distinct, self.encode_words(distinct), strict=True))
        ids_of["\n"] = MARK.to_bytes(4, "little")
        ids = np.frombuffer(b"".join(map(ids_of.__getitem__, words)), dtype="<u4")
        ends = np.flatnonzero(ids == MARK)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.now) > (self.remembered or REMEMBERED) // 2 or self.now.bytes > REMEMBERED_BYTES // 2:
            self.elder, self.now = self.now, self._young()
        pieces = [self._pieces(t or "") for t in texts]
        counts = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        numbers = np.fromiter(map(self.now.__getitem__, chain.from_iterable(pieces)), dtype=np.int64, count=int(counts.sum()))
        self._learn()
        ids, sizes = self.now.ids_of(numbers)
        before = np.concatenate(([0], np.cumsum(sizes)))
        ends = (4 * before[np.cumsum(counts)]).tolist()
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4")

    def _pieces(self, text: str) -> list[str]:
        """Runs without white space, and the special tokens between them, each behind a blank."""
        if "<|" not in text:
            return runs(text)
        return [x for piece in self.split_special.split(text) for x in ([" " + piece] if piece in self.special else runs(piece))]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The tokens with a blank between each two, as a vocabulary without a decoder has it, in UTF-8."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))).encode("utf-8", "surrogatepass")

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, dtype="<u4").tobytes()).decode("utf-8", "surrogatepass")


def encoder(path: str, remembered: int | None = None) -> WordBpe:
    return held((path, remembered), lambda: WordBpe(path, remembered))


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids and the decoded text of every row; one pass, no shuffle."""

    def run(batches):
        bpe = encoder(vocabulary)
        for batch in batches:
            for start, texts in chunks((x.as_py() or "" for x in batch.column(1)), CHUNK):
                ids = bpe.encode_batch(texts)
                lists = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), lists, pa.array([bpe.decode_bytes(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return shipped(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; one pass, no shuffle."""

    def run(batches):
        bpe = encoder(vocabulary)
        for batch in batches:
            for start, texts in chunks((x.as_py() or "" for x in batch.column(1)), CHUNK):
                ids = bpe.encode_batch(texts)
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return shipped(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
