"""Operator 11: phrases whose words stand together more often than their parts would by chance.

1. Sketch: each task hashes its runs of one to ``most_words`` words into two rows of counting cells. A
   phrase can't be more frequent than the lesser of its two cells, so the cells that reach ``least`` are upper
   bounds that lose no phrase. Parts of the cells are shuffled (sorted places, coded by their gaps), and what
   comes back is a bit a cell. The rows grow with the table's bytes, up to ``CELLS`` cells, so their
   bits have a proven bound (64 MB a row) for the broadcast; in larger tables the bounds get looser and more
   phrases are counted, with the same result.
2. Scan: the phrases of a run of texts that their bounds let pass are compiled into an Aho-Corasick automaton
   (pyahocorasick) whose patterns begin and end with a blank, the delimiter of words; pieces are kept apart by
   a mark that no word can be. It scans its run and counts overlapping matches. An automaton holds
   phrases of its own run alone, so its memory is bounded by the run's bytes (``RUN``, or the longest piece).
3. Counts are summed over all runs, then the thresholds apply. All further work is on phrases that
   reach ``least``, joined with the counts of their parts.

Words are ``[^\\x20\\x09]+`` within pieces, pieces what stands between ``[.,;:!?\\x0A-\\x0D]``; A-Z are lower-cased.
Counts are per language. Defined results: a null text is empty, a null language is ``und``; ids aren't read, and rows
that repeat count each; a long text is read whole, cut into runs between pieces; ties rank by the phrase; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import mixed, sequence_hashes, stored, whole_text
from ledgerline.shipping import shipped

MOST_WORDS = 3
LEAST = 10
TOP = 2000
#: A candidate goes if a longer one around it has this share of its count, in percent.
SHARE = 50
#: Most cells of a sketch's row; a cell for eight bytes of text up to there.
CELLS = 1 << 29
#: Cells that one record of a sketch's parts covers.
BLOCK = 1 << 20
#: Bytes of a run of texts, and words that a task holds back before it hands their cells on.
RUN = 4 << 20
HELD = 4 << 20
ROWS = 2

#: Ends of pieces become line feeds, tabs blanks.
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_END = b"\n"


def runs(batches: Iterable[pa.RecordBatch], run: int = RUN) -> Iterator[tuple[str, bytes]]:
    """Language and bytes (lower case, piece by piece) of runs of texts of one language, of about ``run`` bytes each."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE)
            while len(own) > run:
                # Between two pieces; one piece that is longer stays whole.
                cut = own.rfind(_END, 0, run)
                cut = cut if cut >= 0 else own.find(_END, run)
                if cut < 0:
                    break
                yield lang, own[:cut]
                own = own[cut + 1 :]
            held.setdefault(lang, []).append(own)
            sizes[lang] = sizes.get(lang, 0) + len(own) + 1
            if sizes[lang] >= run or sum(sizes.values()) >= 4 * run:
                full = max(sizes, key=sizes.__getitem__)
                del sizes[full]
                yield full, _END.join(held.pop(full))
    for lang, texts in held.items():
        yield lang, _END.join(texts)


class Run:
    """The words of a run as numbers; ends of pieces are 0."""

    def __init__(self, lang: str, text: bytes):
        self.words = [w for w in text.replace(_END, b" \n ").split(b" ") if w]
        number = {w: i for i, w in enumerate(dict.fromkeys([_END, *self.words]))}
        self.distinct = list(number)
        self.ids = np.fromiter(map(number.__getitem__, self.words), dtype=np.int64, count=len(self.words))
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.distinct)), dtype="<u8").reshape(-1, 2)
        self._low, self._high = halves[self.ids, 0], halves[self.ids, 1]
        self._lang = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))

    def windows(self, n: int) -> np.ndarray:
        """Where n words stand within a piece."""
        total = max(0, len(self.ids) - n + 1)
        whole = np.ones(total, dtype=bool)
        for k in range(n):
            whole &= self.ids[k : k + total] != 0
        return np.flatnonzero(whole)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return mixed(sequence_hashes(self._low, self._high, at, n) ^ self._lang)

    def phrases(self, at: np.ndarray, n: int) -> list[bytes]:
        """The different runs of n words at these places."""
        key, size = self.ids[at], len(self.distinct)
        for k in range(1, n):
            # Numbers of the runs so far stay below the places, so a pair of numbers is one.
            key = np.unique(key, return_inverse=True)[1] * size + self.ids[at + k]
        first = at[np.unique(key, return_index=True)[1]]
        return [b" ".join(self.words[i : i + n]) for i in first.tolist()]


def cells_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in either row."""
    low = np.uint64((1 << bits) - 1)
    return [(hashes & low).astype(np.uint32), (hashes >> np.uint64(32) & low).astype(np.uint32)]


def coded(places: np.ndarray) -> bytes:
    """Ascending numbers as the gaps between them, in bytes: 255 adds up and goes on."""
    gaps = np.diff(places, prepend=0)
    ends = np.cumsum(gaps // 255 + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, dtype=np.uint8)
    out[ends] = gaps % 255
    return out.tobytes()


def decoded(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def _capped(cells: np.ndarray, least: int) -> np.ndarray:
    """Sorted, each at most ``least`` times."""
    cells = np.sort(cells)
    if len(cells) > least:
        cells = cells[np.concatenate((np.ones(least, dtype=bool), cells[least:] != cells[:-least]))]
    return cells


def _sketched(batches: Iterable[pa.RecordBatch], bits: int, most_words: int, least: int, run: int) -> Iterator[pa.RecordBatch]:
    """Records (row, block, places) of a task's words."""
    held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]

    def flush() -> Iterator[pa.RecordBatch]:
        for row, parts in enumerate(held):
            cells = _capped(np.concatenate(parts), least) if parts else np.zeros(0, dtype=np.uint32)
            parts.clear()
            blocks = (cells // BLOCK).astype(np.int64)
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            found = [(int(blocks[i]), coded(own.astype(np.int64) % BLOCK)) for i, own in zip(starts.tolist(), np.split(cells, starts[1:]), strict=True)] if len(starts) else []
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int32()), pa.array([b for b, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], ["row", "block", "places"])

    for lang, text in runs(batches, run):
        own = Run(lang, text)
        for n in range(1, most_words + 1):
            for row, cells in enumerate(cells_of(own.hashes(own.windows(n), n), bits)):
                held[row].append(cells)
        if sum(map(len, held[0])) >= HELD:
            yield from flush()
    yield from flush()


def _summed(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Records (row, block, bits): which cells reach ``least``. Records of a block follow each other, so one is held."""
    at, counts = None, np.zeros(BLOCK, dtype=np.uint32)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())], ["row", "block", "bits"])

    for batch in batches:
        for own, places in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2), strict=True):
            if own != at:
                if at is not None:
                    yield told()
                at = own
                counts[:] = 0
            np.add.at(counts, decoded(places.as_py()), 1)
    if at is not None:
        yield told()


def upper_bounds(texts: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, run: int = RUN, cells: int = CELLS) -> tuple[list[np.ndarray], int]:
    """Both rows' bits of the cells that reach ``least``, of (lang, text), and the logarithm of the row's cells."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(16, min(cells.bit_length() - 1, (size // 8).bit_length()))
    parts = shipped(texts).mapInArrow(lambda b: _sketched(b, bits, most_words, least, run), "row int, block int, places binary")
    summed = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(lambda b: _summed(b, least), "row int, block int, bits binary")
    out = [np.zeros(-(-(1 << bits) // 8), dtype=np.uint8) for _ in range(ROWS)]
    for r in summed.collect():  # a bit a cell: at most 128 MB
        own = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        begin = r["block"] * (BLOCK // 8)
        out[r["row"]][begin : begin + len(own)] = own[: len(out[r["row"]]) - begin]
    return out, bits


def _passing(bounds: list[np.ndarray], hashes: np.ndarray, bits: int) -> np.ndarray:
    passed = np.ones(len(hashes), dtype=bool)
    for own, cells in zip(bounds, cells_of(hashes, bits), strict=True):
        passed &= (own[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
    return passed


def scan(run: Run, bounds: list[np.ndarray], bits: int, most_words: int) -> tuple[list[bytes], list[int], np.ndarray]:
    """Phrases that their bounds let pass, their words, and how often an automaton of them all finds each in the run."""
    phrases, words = [], []
    for n in range(1, most_words + 1):
        at = run.windows(n)
        own = run.phrases(at[_passing(bounds, run.hashes(at, n), bits)], n)
        phrases += own
        words += [n] * len(own)
    if not phrases:
        return [], [], np.zeros(0, dtype=np.int64)
    # Bytes as characters of one byte each, which keeps the text small; no byte of a character is a blank.
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase.decode('latin-1')} ", i)
    automaton.make_automaton()
    text = f" {b' '.join(run.words).decode('latin-1')} "
    return phrases, words, np.bincount(np.fromiter((i for _, i in automaton.iter(text)), dtype=np.int64), minlength=len(phrases))


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, run: int = RUN, cells: int = CELLS) -> DataFrame:
    """lang, phrase, words and f of all phrases of one to ``most_words`` words that occur ``least`` times; in a row without words (phrase empty, 0 words) all words."""
    texts = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), whole_text(docs["text"]).alias("text"))
    found, bits = upper_bounds(texts, most_words, least, run, cells)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in runs(batches, run):
            own = Run(lang, text)
            phrases, words, counts = scan(own, shared.value, bits, most_words)
            phrases, words = [*phrases, b""], [*words, 0]
            counts = np.append(counts, np.count_nonzero(own.ids))
            text_of = pa.array([p.decode("utf-8", "surrogatepass") for p in phrases], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), text_of, pa.array(words, pa.int32()), pa.array(counts, pa.int64())], ["lang", "phrase", "words", "f"])

    parts = shipped(texts).mapInArrow(count, "lang string, phrase string, words int, f long")
    return stored(parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least)))


def _parts(first: Column | int, length: Column | int) -> Column:
    """``length`` words of the phrase from its ``first``, which counts from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r and score of every candidate (two words and more), by its lowest-scoring cut."""
    whole = F.col("a").cast("decimal(19,0)")
    cuts = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _parts(F.lit(1), F.col("k")).alias("left"), _parts(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.where("words >= 1").select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    million = F.lit(1_000_000).cast("decimal(7,0)")
    # Decimals hold 38 digits: a count may have 16.
    by = cuts.withColumn("over", million * whole * whole).withColumn("under", F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")).withColumn("score", F.expr("over div under"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return by.groupBy("lang", "phrase", "words", "a").agg(best.alias("cut")).select("lang", "phrase", "words", "a", "cut.*")


def mine_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, share: int = SHARE, run: int = RUN, cells: int = CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases of 2 to ``most_words`` words.

    Score is the floor of 1000000 * a * a / (l * r) at the cut with the least, the first of equal ones. A
    candidate inside a longer one that has ``share`` percent of its count goes.
    """
    counts = phrase_counts(docs, most_words, least, run, cells)
    candidates = scored(counts)
    around = counts.where("words >= 3").select("lang", "phrase", "words", "f", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    around = around.select("lang", "phrase", "f", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("from"))
    around = around.select("lang", _parts(F.col("from"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(counts.where("words = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
