"""What the training-data operators share: tables, scratch storage, hold-out folds, what workers hold."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.storage import checkpointed as checkpointed
from ledgerline.storage import scratch_folder


#: The columns of ``documents``, which filtering stages pass on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark's reader can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: compressed, unlike a checkpoint, for what is large.

    The table stays there after the application, as that folder's scratch files do.
    """
    path = f"{scratch_folder(df.sparkSession)}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def order_statistics(values: DataFrame, wanted: dict, cells: int = 256) -> dict:
    """The numbers at some places (from 0) in each group's ascending order, exact at any number of rows.

    values: group and value, without nulls; wanted: places by group. Gives them by (group, place). Each pass counts
    ``cells`` parts of what a number still lies in, so that the driver gets counts alone.
    """
    ends = {r["group"]: (r["least"], r["most"]) for r in values.groupBy("group").agg(F.min("value").alias("least"), F.max("value").alias("most")).collect()}
    left = {(g, k): (*ends[g], k) for g, places in wanted.items() for k in places}
    out = {}
    while True:
        out |= {at: lo for at, (lo, hi, _) in left.items() if lo == hi}
        left = {at: x for at, x in left.items() if at not in out}
        if not left:
            return out
        kind = f"group {values.schema['group'].dataType.simpleString()}, place long, lo double, hi double"
        asked = values.sparkSession.createDataFrame([(*at, lo, hi) for at, (lo, hi, _) in left.items()], kind)
        within = values.join(F.broadcast(asked), "group").where("value between lo and hi")
        part = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))
        counts = within.groupBy("group", "place", part.alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: r["part"]):
            at = (r["group"], r["place"])
            if (before := left[at][2]) >= 0:
                # A number found has place -1 - what is left of it, so that later parts don't change it.
                left[at] = (r["lo"], r["hi"], -1 - before) if before < r["n"] else (*left[at][:2], before - r["n"])
        left = {at: (lo, hi, -1 - k) for at, (lo, hi, k) in left.items()}


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def whole_text(text: Column | str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: What this Python worker holds from task to task, for one operator at a time.
_held: dict = {}


def held[T](key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, held for the worker's next tasks in place of what it held for another key."""
    if key not in _held:
        _held.clear()
        _trim()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what the worker holds: it outlives its stage, and other operators need the memory."""
    if _held:
        _held.clear()
        _trim()


def _trim() -> None:
    """Give free memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(texts: Iterable[str], most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of about ``most`` characters, each with its first index.

    A longer text is a run of its own, so that arrays over a run stay in the CPU's caches
    for ordinary texts and grow with the longest text only.
    """
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


#: Odd 64-bit multipliers (golden ratio and the finaliser of splitmix64).
MIX_1, MIX_2, MIX_3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_2
    x = (x ^ (x >> np.uint64(27))) * MIX_3
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a run of texts as arrays: number, owner and place.

    Words are ``[^\\x20\\x09-\\x0D]+``. The texts are joined by line feeds, so no word
    spans two of them. Equal words, and only they, have equal numbers (``ids``) within the run.
    """

    __slots__ = ("_halves", "bytes", "counts", "distinct", "first", "ids", "owner", "starts", "stops", "text_starts")

    def __init__(self, texts: list[str], lower: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = b"\n".join(raw) + b"\n"
        if lower:
            whole = whole.lower()  # A-Z alone, as of all bytes
        data = np.frombuffer(whole, dtype=np.uint8)
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
        self.text_starts = np.concatenate(([0], np.cumsum(lengths)))
        self.bytes = data
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data])).view(np.int8)))
        self.starts, self.stops = edges[0::2], edges[1::2]
        self.owner = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.counts = np.bincount(self.owner, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        found = whole.split()  # at the same six characters
        number = {w: i for i, w in enumerate(dict.fromkeys(found))}
        self.ids = np.fromiter(map(number.__getitem__, found), dtype=np.int64, count=len(found))
        self.distinct = list(number)
        self._halves: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def code_points(self) -> np.ndarray:
        """Those of each word: its bytes that don't continue another's."""
        begun = np.concatenate(([0], np.cumsum((self.bytes & 0xC0) != 0x80)))
        return begun[self.stops] - begun[self.starts]

    @property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each word's 128-bit hash (XXH3 of its bytes): the same in every run."""
        if self._halves is None:
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.distinct)), dtype="<u8").reshape(-1, 2)
            self._halves = both[self.ids, 0], both[self.ids, 1]
        return self._halves

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions (in words) and hashes of all runs of ``n`` words within one text."""
        total = len(self.ids) - n + 1
        if total <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.owner[:total] == self.owner[n - 1 :])
        return at, sequence_hashes(*self.hashes, at, n)

    def same_windows(self, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        """Whether the ``n`` words from x are those from y, and of the same text."""
        same = self.owner[x] == self.owner[y]
        for k in range(n):
            same &= self.ids[x + k] == self.ids[y + k]
        return same


def sequence_hashes(low: np.ndarray, high: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each position, of both halves of their hashes, mixed after every word."""
    h = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        h = mixed(h ^ low[at + k]) * MIX_1 + high[at + k]
    return mixed(h)
