"""Problem 4: records whose texts share most of their runs of characters.

Method: pigeonring filtering. A text is sketched by minhash symbols over its runs of
four characters (a run that comes again is another run); symbols form segments on a ring.
An equi-join on agreeing segments proposes pairs. From the agreeing segment the ring is
followed: after each stretch of the chain the differences so far must stay within the
budget in proportion to its length (bit arithmetic in the join); the budget is what the
least similar pair of those two lengths would have. The survivors are counted exactly.
The sketch is a sample: how many pairs it finds is stated in the README.

Exact copies are one text throughout (a 64-bit digest of the text without white space,
in lower case); they come back only where results are written out per record.

Defined cases
    null text        -> in no pair, no class
    under four signs -> no runs: equal only to equal texts
    repeated rows    -> a record counts once
    group of copies  -> one representative in every shuffle
    very long text   -> sketched whole
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut

RUN = 4
#: Segments on the ring, symbols of a segment, bits kept of a symbol in a chain.
RING, SYMBOLS, BITS = 24, 3, 3
BOX = SYMBOLS * BITS
#: Segments after the agreeing one, by the column of 64 bits that holds them. The first column holds the digest of the agreeing segment and the length too.
STRETCHES = (3, 7, 7)
COLUMNS = ("ring", "w1", "w2")
DIGEST, LENGTH_AT, FIRST_AT = 0xFFFFFFFF, 32, 37
#: Deviations by which the differences at the end of each stretch may exceed what the least similar pair has on average.
DEVIATIONS = (3.3, 3.0, 2.5)
#: A length is a number of steps of this factor, counted round a circle: lengths that far apart share too little anyway.
LENGTH_STEP, LENGTHS = 1.04, 32
#: Bits of the table that tells which texts are in a pair: 4 MB, whatever the corpus holds.
MENTIONED = 1 << 25
SLICE = 65_536
#: Signs of the texts that are taken apart at once: more would leave the processor's cache, and their arrays be given by the system anew each time.
SIGNS = 16_384
_rng = np.random.RandomState(20_011)
_MUL = _rng.randint(1, 2**31, RING * SYMBOLS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.randint(0, 2**31, RING * SYMBOLS).astype(np.uint32)


def bare(text: Column) -> Column:
    """Lower case without white space: what counts when texts are compared."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def run_hashes(codes: np.ndarray) -> np.ndarray:
    """Mixed 32-bit hashes of the runs of a string of code points."""
    codes = codes.astype(np.uint64)
    h = codes[:-3] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-2]
    h = h * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:-1]
    h = h * np.uint64(0x165667B19E3779F9) + codes[3:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring texts of up to ``SIGNS`` signs together; a longer text stands alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SIGNS, side="right")))
        yield a, b
        a = b


def _told_apart(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of texts, text by text; a run that comes again has another."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    whole = of[:-3] == of[3:]
    key = np.sort(of[:-3][whole] << np.uint64(32) | run_hashes(codes)[whole])
    at = np.arange(len(key))
    again = at - np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
    return key.astype(np.uint32) ^ again.astype(np.uint32) * np.uint32(0x9E3779B1)


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, runs) of texts of at least four signs: one row of minhash symbols each, and how many runs it has."""
    sizes = np.array([len(t) for t in texts])
    h = np.concatenate([_told_apart(texts[a:b], sizes[a:b]) for a, b in _slices(sizes)])
    runs = sizes - RUN + 1
    ends = np.cumsum(runs)
    out = np.full((RING * SYMBOLS, len(texts)), 0xFFFFFFFF, np.uint32)
    mixed = np.empty(SLICE, np.uint32)
    for a in range(0, len(h), SLICE):  # in slices, so that memory stays level
        part = h[a : a + SLICE]
        first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, a + len(part) - 1, side="right") + 1
        cuts, buffer = np.maximum(ends[first:last] - runs[first:last], a) - a, mixed[: len(part)]
        for k in range(RING * SYMBOLS):
            np.multiply(part, _MUL[k], out=buffer)
            np.add(buffer, _ADD[k], out=buffer)
            np.minimum(out[k, first:last], np.minimum.reduceat(buffer, cuts), out=out[k, first:last])
    return np.ascontiguousarray(out.T), runs


def _ring(symbols: np.ndarray, runs: np.ndarray) -> list[np.ndarray]:
    """Per text and segment, as 64-bit columns: a digest of the segment, the length, and the low bits of the symbols of the segments after it."""
    parts = symbols.reshape(len(symbols), RING, SYMBOLS).astype(np.uint64)
    digest = np.arange(RING, dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(SYMBOLS):
        digest = (digest * np.uint64(0x9E3779B97F4A7C15)) ^ (parts[:, :, k] * np.uint64(0xC2B2AE3D27D4EB4F))
        digest ^= digest >> np.uint64(31)
    low = (parts >> np.uint64(17)) & np.uint64((1 << BITS) - 1)
    box = low[:, :, 0]
    for k in range(1, SYMBOLS):
        box = box | low[:, :, k] << np.uint64(BITS * k)
    steps = (np.log(np.maximum(runs, 1)) / math.log(LENGTH_STEP)).astype(np.uint64) % np.uint64(LENGTHS)
    columns, after = [], 1
    for c, n in enumerate(STRETCHES):
        word = digest & np.uint64(DIGEST) | steps[:, None] << np.uint64(LENGTH_AT) if c == 0 else np.zeros(box.shape, np.uint64)
        for k in range(n):
            word |= np.roll(box, -(after + k), axis=1) << np.uint64(BOX * k + (FIRST_AT if c == 0 else 0))
        columns.append(word.ravel().view(np.int64))
        after += n
    return columns


def segments(texts: DataFrame) -> DataFrame:
    """(text_key, ring, w1, w2): one row per text and segment of (text_key, bare)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = dict(zip(batch.column("text_key").to_pylist(), batch.column("bare").to_pylist(), strict=True))
            done = [(k, t) for k, t in first.items() if len(t) >= RUN]
            if done:
                columns = _ring(*sketches([t for _, t in done]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(np.array([k for k, _ in done], np.int64), RING), *columns)], ["text_key", *COLUMNS])

    return texts.select("text_key", "bare").mapInArrow(run, ", ".join(f"{c} long" for c in ("text_key", *COLUMNS)))


def chain_limit(least: float, ratio: float, stretch: int) -> int:
    """The differences a chain may have at the end of a stretch, for two texts whose numbers of runs have that ratio."""
    alike = least / (1 + ratio - least)
    differ = (1 - 0.5**BITS) * (1 - alike)  # the bits kept of different symbols may be equal
    n = SYMBOLS * sum(STRETCHES[: stretch + 1])
    return math.floor(n * differ + DEVIATIONS[stretch] * math.sqrt(n * differ * (1 - differ)))


def _mask(stretch: int) -> int:
    """The lowest bit of every symbol of a stretch."""
    return sum(1 << (BITS * k + (FIRST_AT if stretch == 0 else 0)) for k in range(SYMBOLS * STRETCHES[stretch]))


def within_budget(a: list[str], b: list[str], least: float) -> Column:
    """The chain condition on two rows: lengths that allow the share, and after every stretch no more differences than the budget."""
    length = lambda c: F.shiftrightunsigned(F.col(c), LENGTH_AT).bitwiseAND(F.lit(LENGTHS - 1)).cast("int")
    apart = F.abs(length(a[0]) - length(b[0]))
    apart = F.least(apart, LENGTHS - apart)
    most = math.ceil(math.log(1 / least) / math.log(LENGTH_STEP))
    out, total = apart <= most, F.lit(0)
    for n, (x, y) in enumerate(zip(a, b, strict=True)):
        differing = bits = F.col(x).bitwiseXOR(F.col(y))
        for k in range(1, BITS):
            differing = differing.bitwiseOR(F.shiftrightunsigned(bits, k))
        total = total + F.bit_count(differing.bitwiseAND(F.lit(_mask(n))))
        # Lengths are known to a step, so the ratio is the largest the steps allow.
        limits = [chain_limit(least, min(1.0, LENGTH_STEP ** (1 - d)), n) for d in range(most + 1)]
        out = out & (total <= (F.get(F.array(*[F.lit(v) for v in limits]), apart) if n == len(STRETCHES) - 1 else limits[0]))
    return out


def candidates(texts: DataFrame, least: float) -> DataFrame:
    """(a, b): keys of texts that agree in a segment and pass the chain condition from it."""
    rows = segments(texts)
    side = lambda name: rows.select(F.col("text_key").alias(name), *[F.col(c).alias(f"_{name}{n}") for n, c in enumerate(COLUMNS)])
    agree = F.col("_a0").bitwiseAND(F.lit(DIGEST)) == F.col("_b0").bitwiseAND(F.lit(DIGEST))
    near = within_budget([f"_a{n}" for n in range(len(COLUMNS))], [f"_b{n}" for n in range(len(COLUMNS))], least)
    return side("a").join(side("b"), agree & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def mentioned(texts: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose key may be among ``keys``, found where they are read.

    The keys are bits of a table of ``MENTIONED`` bits in rows of 4 KB, which is broadcast:
    its size is fixed. A text that is kept in vain does no harm.
    """
    bit = lambda c: F.pmod(F.col(c), F.lit(MENTIONED))
    page, place = lambda c: F.shiftright(bit(c), 15).cast("int"), lambda c: bit(c).bitwiseAND(F.lit(32767))
    table = keys.groupBy(page(keys.columns[0]).alias("_page")).agg(F.bitmap_construct_agg(place(keys.columns[0])).alias("_bits"))
    met = texts.withColumn("_at", page(key)).join(F.broadcast(table), F.col("_at") == F.col("_page"))
    byte = F.conv(F.hex(F.substr(F.col("_bits"), F.shiftright(place(key), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.call_function("shiftright", byte, place(key).bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*texts.columns)


@lru_cache(maxsize=4096)
def _counts(text: str) -> Counter:
    return Counter(text[i : i + RUN] for i in range(len(text) - RUN + 1))


def share(a: str | None, b: str | None) -> float:
    """Runs in common, counted with repetition, divided by the count of the text with more."""
    if not a or not b:
        return 0.0
    x, y = len(a) - RUN + 1, len(b) - RUN + 1
    if min(x, y) <= 0:
        return float(a == b)
    small, large = (_counts(a), _counts(b)) if x < y else (_counts(b), _counts(a))
    return sum(min(n, large[g]) for g, n in small.items() if g in large) / max(x, y)


def _run_ids(codes: np.ndarray) -> np.ndarray:
    """32-bit numbers of the runs of a string of code points: equal just where the runs are."""
    present = np.zeros(int(codes.max()) + 1, bool)
    present[codes] = True
    signs = np.flatnonzero(present)
    numbers = np.empty(len(present), np.uint32)
    numbers[signs] = np.arange(len(signs), dtype=np.uint32)
    sign = numbers[codes]
    if len(signs) <= 256:
        return sign[:-3] << np.uint32(24) | sign[1:-2] << np.uint32(16) | sign[2:-1] << np.uint32(8) | sign[3:]
    ids = sign.astype(np.uint64)
    for step in (1, 2):  # numbers of two signs, then of two such numbers
        ids = np.unique(ids[:-step] * (ids.max() + np.uint64(1)) + ids[step:], return_inverse=True)[1].astype(np.uint64)
    return ids.astype(np.uint32)


def _common_runs(left: list[str], right: list[str], sizes: np.ndarray) -> np.ndarray:
    """Runs in common, counted with repetition, of pairs of texts of at least four signs."""
    codes = np.frombuffer("".join([t for pair in zip(left, right, strict=True) for t in pair]).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(2 * len(left), dtype=np.uint64), sizes.ravel())
    at, whole = of[:-3], of[:-3] == of[3:]
    # A run is its pair, its number and, in the lowest bit, the side it stands on.
    key = np.sort((at >> np.uint64(1) << np.uint64(33) | _run_ids(codes).astype(np.uint64) << np.uint64(1) | at & np.uint64(1))[whole])
    run = key >> np.uint64(1)
    last = np.flatnonzero(np.r_[run[1:] != run[:-1], True])
    on_right = np.diff(np.cumsum(key & np.uint64(1), dtype=np.int64)[last], prepend=0)
    on_left = np.diff(last, prepend=-1) - on_right
    return np.bincount((run[last] >> np.uint64(32)).astype(np.int64), weights=np.minimum(on_left, on_right), minlength=len(left))


def shares(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """``share`` of every pair of two lists, counted for a slice of them at once."""
    sizes = np.array([(len(x or ""), len(y or "")) for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    out, counted = np.zeros(len(left)), np.flatnonzero(sizes.min(axis=1) >= RUN)
    for i in np.flatnonzero(sizes.min(axis=1) < RUN):
        out[i] = share(left[i], right[i])
    for a, b in _slices(sizes[counted].sum(axis=1)):
        part = counted[a:b]
        common = _common_runs([left[i] for i in part], [right[i] for i in part], sizes[part])
        out[part] = common / (sizes[part].max(axis=1) - RUN + 1)
    return out


def text_keys(df: DataFrame, text: str, *group: str) -> DataFrame:
    """Adds ``bare`` and ``text_key``; texts are compared within equal values of ``group`` only."""
    kept = df.filter(F.col(text).isNotNull()).withColumn("bare", bare(F.col(text)))
    return kept.withColumn("text_key", F.xxhash64(*group, "bare") if group else F.xxhash64("bare"))


def similar_texts(keyed: DataFrame, least: float) -> DataFrame:
    """(a, b, share): pairs of different texts of (text_key, bare) with at least that share."""
    pairs = cut(candidates(keyed, least), "near-copy-pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("_key"))
    texts = mentioned(keyed.select(F.col("text_key").alias("_k"), "bare"), "_k", keys).groupBy("_k").agg(F.first("bare").alias("_t"))
    both = pairs.join(texts, F.col("a") == F.col("_k")).select("a", "b", F.col("_t").alias("_ta"))
    both = both.join(texts, F.col("b") == F.col("_k")).select("a", "b", "_ta", F.col("_t").alias("_tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shares(batch.column("_ta").to_pylist(), batch.column("_tb").to_pylist())
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got)], ["a", "b", "share"])
            yield out.filter(pa.array(got >= least))

    return both.mapInArrow(check, "a long, b long, share double")


def near_copies(df: DataFrame, key: str, text: str, table: str, least: float = 0.7) -> DataFrame:
    """(table, id_a, id_b): all pairs of records of one table with at least that share, id_a < id_b; equal texts included."""
    keyed = text_keys(df, text, table)
    members = cut(keyed.select(table, F.col(key).alias("_id"), "text_key").distinct(), "near-copies")
    links = similar_texts(keyed, least).select("a", "b")
    left = members.select(table, F.col("_id").alias("_x"), F.col("text_key").alias("a"))
    right = members.select(F.col("_id").alias("_y"), F.col("text_key").alias("b"))
    unlike = links.join(left, "a").join(right, "b").select(table, "_x", "_y")
    alike = left.join(right, F.col("a") == F.col("b")).filter("_x < _y").select(table, "_x", "_y")
    return unlike.unionByName(alike).select(table, F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b")).distinct()


def near_copy_classes(df: DataFrame, key: str, text: str, table: str, least: float = 0.7) -> DataFrame:
    """(table, key, class_id, n_links): every record with a text; records joined by links share a class. Copies link to their text, not to each other."""
    keyed = text_keys(df, text, table)
    links = cut(similar_texts(keyed, least).select("a", "b"), "near-copy-links")
    parts = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of = parts.join(degree, "node")
    rows = keyed.select(table, key, "text_key").distinct()
    out = rows.join(of, F.col("text_key") == F.col("node"), "left")
    return out.select(table, key, F.hex(F.coalesce("component", "text_key")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
