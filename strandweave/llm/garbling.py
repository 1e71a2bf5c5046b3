"""Problem 9: texts decoded with the wrong encoding, found and restored.

Method: expectation-maximization with latent encoding chains. A chain says how bytes
were written and how they were read (``utf-8 read as cp1252``). For every run of unusual
characters and every chain the undone run is weighed against the run as it stands by a
character-triple model counted over the whole corpus. Each record has one latent chain (or
none); its prior belongs to the record's source and is re-estimated from the posteriors
of all records of that source, smoothed by the whole corpus. A record is repaired by the
chain with the highest posterior.

Defined cases
    null or plain text   -> not affected
    null source          -> a source of its own
    lost characters      -> affected (U+FFFD, C1 controls); what is left is repaired
    foreign words, typographic signs -> not affected: undoing a chain makes them rarer
    very long text       -> processed whole
    empty table          -> empty result
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Encodings texts are written in and read as.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp874", "cp1250", "koi8_r")
SINGLE = (
    ("cp874", "cp1252"), ("cp874", "mac_roman"), ("cp874", "cp437"), ("cp874", "cp850"), ("cp874", "cp1251"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp874"), ("cp1252", "cp1250"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"),
)
CHAINS = tuple([("utf-8", b, 1) for b in READ_AS] + [(a, b, 1) for a, b in SINGLE] + [("utf-8", b, 2) for b in READ_AS] + [("utf-8", "cp1252", 3)])
NAMES = tuple(f"{a} read as {b}" + (f" {n} times" if n > 1 else "") for a, b, n in CHAINS)
#: The rounds end when no chain's expected share of all records moves by more than this, at the latest after so many.
SETTLED, ROUNDS = 1e-4, 12
#: Records that the corpus-wide prior counts for beside a source's own.
SMOOTHING = 20.0
START_CLEAN = 0.9
#: Log gains of a run below this are noise; while garbled records are set apart from the model, a smaller gain tells.
LEAST_GAIN, FIRST_GAIN = 4.0, 1.0
#: Runs of fewer signs are too short to be judged by other records alone: a quotation mark before a new word would look odd.
OWN_LEAST = 3

THAI, THAI_LEAD = re.compile("[ก-๛]+"), re.compile("[เ][ธน][ก-ฟ]")
READ_AS_THAI = tuple(n for n, (_, read, _) in enumerate(CHAINS) if read == "cp874")
RUN = re.compile(r"[^\x00-\x7f]+")
LOST = re.compile("[�\x80-\x9f]")
#: What can hold a garbled run: signs outside plain Latin and Thai text, Thai beside Latin, or the Thai pairs that UTF-8 lead bytes turn to.
SUSPECT = r"[^\x00-\x7fก-๛]|[เ][ธน][ก-ฟ]|[A-Za-z][ก-๛]|[ก-๛][A-Za-z]"
_utf8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


class _ToBytes(dict):
    """Character to the byte it was read from, as a Latin-1 character; anything else becomes a stop."""

    def __init__(self, codec: str):
        super().__init__()
        for byte in range(128, 256):
            self[byte] = chr(byte) if byte < 160 else "￿"  # a reader passes undefined bytes through as controls
        for byte in range(128, 256):
            try:
                self[ord(bytes([byte]).decode(codec))] = chr(byte)
            except UnicodeDecodeError:
                self[byte] = chr(byte)

    def __missing__(self, code: int) -> str:
        self[code] = known = chr(code) if code < 128 else "￿"
        return known


_bytes = {codec: _ToBytes(codec) for codec in {b for _, b, _ in CHAINS}}


def _utf8_char(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def undo(run: str, chain: int) -> str:
    """The run with a chain undone wherever its bytes allow; the run itself where they do not."""
    written, read, times = CHAINS[chain]
    for _ in range(times):
        raw = run.translate(_bytes[read])
        if written == "utf-8":
            out, at = [], 0
            for m in _utf8.finditer(raw):
                out += [run[at : m.start()], _utf8_char(m)]
                at = m.end()
            if not at:
                return run
            run = "".join(out) + run[at:]
        elif "￿" in raw:
            return run
        else:
            try:
                run = raw.encode("latin-1").decode(written)
            except UnicodeDecodeError:
                return run
    return run


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _singles(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint32(0xFFFF)).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((((a.astype(np.uint64) * _A) ^ b.astype(np.uint64)) * _B) >> np.uint64(44)).astype(np.int64) + 65536


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    mixed = (((a.astype(np.uint64) * _A) ^ b.astype(np.uint64)) * _B ^ c.astype(np.uint64)) * _C
    return (mixed >> np.uint64(42)).astype(np.int64) + 65536 + (1 << 20)


#: Cells of the model: characters, hashed pairs, hashed triples. The size is fixed, whatever the corpus holds.
CELLS = 65536 + (1 << 20) + (1 << 22)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _add_counts(total: np.ndarray, texts: list[str]) -> None:
    """Counts characters, pairs and triples of texts into the cells."""
    for at in range(0, len(texts), 500):
        codes = _codes("\n\n" + "\n\n".join(texts[at : at + 500]) + "\n\n")
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        keep = (a | b | c) > 127
        total[:65536] += np.bincount(_singles(codes), minlength=65536)
        for cells in (_pairs(a, b), _triples(a[keep], b[keep], c[keep])):
            if len(cells) > CELLS // 8:
                total += np.bincount(cells, minlength=CELLS)
            else:
                np.add.at(total, cells, 1)


def triple_counts(df: DataFrame, text: str, garbled_by: TripleModel | None = None) -> DataFrame:
    """(cell, n): how often each character, hashed pair and hashed triple occurs in all texts, or in those a model sees garbled. Triples within ASCII are left out: no chain changes them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            texts = [t for t in batch["_t"] if t]
            _add_counts(total, [t for t in texts if LOST.search(t) or garbled_by.gains(t)] if garbled_by else texts)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    texts = df.select(F.col(text).alias("_t"))
    if garbled_by:
        texts = texts.filter(F.col("_t").rlike(SUSPECT))
    return texts.mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _own_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of what one text adds to pairs and triples."""
    codes = _codes("\n\n" + text + "\n\n")
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    keep = (a | b | c) > 127
    return np.unique(np.concatenate([_pairs(a, b), _triples(a[keep], b[keep], c[keep])]), return_counts=True)


def _held(own: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
    """How often each of some cells is among a text's own."""
    at = np.minimum(np.searchsorted(own[0], cells), len(own[0]) - 1)
    return np.where(own[0][at] == cells, own[1][at], 0)


class TripleModel:
    """Log probability of characters given the two before them, backing off to single characters."""

    BACK = 0.5

    def __init__(self, counts: np.ndarray, least: float = LEAST_GAIN):
        self.counts, self.least = counts, least
        single = counts[:65536].astype(np.float64)
        self.single = (single + 0.1) / (single.sum() + 6553.6)
        self._gains = lru_cache(maxsize=200_000)(self._weigh)

    @staticmethod
    def dense(cells: pd.DataFrame) -> np.ndarray:
        counts = np.zeros(CELLS, np.float32)
        counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        return counts

    def __reduce__(self):
        at = np.flatnonzero(self.counts)
        return _model_of, (at.astype(np.int32), self.counts[at], self.least)

    def score(self, left: str, run: str, right: str, own: tuple[np.ndarray, np.ndarray] | int = 0) -> float:
        """Of ``run`` and ``right``, both after ``left`` (two characters).

        ``own`` is what the record itself has added to the counts: the (cells, counts) of its
        text, or one of each. A run as it stands is judged by the other records only, else
        a garbled text would vouch for itself.
        """
        codes = _codes(left + run + right)
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        triples, pairs = _triples(a, b, c), _pairs(a, b)
        seen, before = self.counts[triples], self.counts[pairs]
        if not isinstance(own, int) or own:
            less = (1, 1) if isinstance(own, int) else (_held(own, triples), _held(own, pairs))
            seen, before = np.maximum(seen - less[0], 0), np.maximum(before - less[1], 0)
        plain = (a | b | c) <= 127
        p = (seen + self.BACK * self.single[_singles(c)]) / (before + self.BACK)
        return float(np.log(p[~plain]).sum())

    def _weigh(self, left: str, run: str, right: str, own_counts: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[tuple[int, float], ...]:
        chains = range(len(CHAINS))
        if THAI.fullmatch(run):
            # Thai letters are read from bytes by one codec only: as UTF-8, which shows, or within Latin words.
            if not THAI_LEAD.search(run) and not (len(run) <= 4 and (left[-1:].isalpha() or right[:1].isalpha())):
                return ()
            chains = READ_AS_THAI
        own = self.score(left, run, right, own_counts() if own_counts else int(len(run) >= OWN_LEAST))
        if own > -self.least:
            return ()  # no chain can gain more than the run costs
        out, shorter = [], {run}
        for chain in chains:
            undone = undo(run, chain)
            if undone in shorter and (undone == run or CHAINS[chain][2] > 1):
                continue  # the chain does nothing, or no more than a shorter one
            shorter.add(undone)
            if (gain := self.score(left, undone, right) - own) > self.least:
                out.append((chain, gain))
        return tuple(out)

    def gains(self, text: str) -> dict[int, float]:
        """By chain: how much likelier the runs of a text are with the chain undone."""
        total: dict[int, float] = {}
        held = lru_cache(maxsize=1)(lambda: _own_counts(text))
        for m in RUN.finditer(text):
            run, a, b = m.group(), m.start(), m.end()
            around = ("\n\n" + text[max(0, a - 2) : a])[-2:], run, (text[b : b + 2] + "\n\n")[:2]
            weighed = self._gains(*around) if len(run) <= 8 else self._weigh(*around, held)
            for chain, gain in weighed:
                total[chain] = total.get(chain, 0.0) + gain
        return total

    def repair(self, text: str, chain: int) -> str:
        def mend(m: re.Match) -> str:
            run, a, b = m.group(), m.start(), m.end()
            undone = undo(run, chain)
            left, right = ("\n\n" + text[max(0, a - 2) : a])[-2:], (text[b : b + 2] + "\n\n")[:2]
            return undone if undone != run and self.score(left, undone, right) > self.score(left, run, right) else run

        return RUN.sub(mend, text)


def _model_of(at: np.ndarray, n: np.ndarray, least: float) -> TripleModel:
    counts = np.zeros(CELLS, np.float32)
    counts[at] = n
    return TripleModel(counts, least)


def clean_model(df: DataFrame, text: str) -> TripleModel:
    """The model of the texts that are not garbled.

    First all texts are counted; those in which that model already sees garbling are
    then counted on their own, where they are read, and taken out. At most ``CELLS``
    counts reach the driver.
    """
    everything = TripleModel.dense(triple_counts(df, text).toPandas())
    garbled = triple_counts(df, text, TripleModel(everything, FIRST_GAIN)).toPandas()
    return TripleModel(np.maximum(everything - TripleModel.dense(garbled), 0))


def evidence(df: DataFrame, key: str, text: str, source: str, model: TripleModel, with_text: bool = False) -> DataFrame:
    """(key, source, lost, gains[, body]): records that hold a sign of garbling, with the log gain of each chain and, where it is asked for, their text."""
    kept = df.select(F.col(key), F.col(source).cast("string").alias("source"), F.col(text).alias("_t")).filter(F.col("_t").rlike(SUSPECT))
    schema = f"`{key}` {dict(df.dtypes)[key]}, source string, lost boolean, gains array<struct<chain:int,gain:double>>" + (", body string" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, s, t in zip(batch[key], batch["source"], batch["_t"], strict=True):
                gains, lost = model.gains(t), bool(LOST.search(t))
                if gains or lost:
                    rows.append((k, s, lost, [{"chain": c, "gain": g} for c, g in sorted(gains.items())], t)[: 5 if with_text else 4])
            yield pd.DataFrame(rows, columns=[key, "source", "lost", "gains", "body"][: 5 if with_text else 4])

    return kept.mapInPandas(run, schema)


def posteriors(df: DataFrame, key: str, text: str, source: str, model: TripleModel | None = None, with_text: bool = False) -> DataFrame:
    """(key, source, lost, chain, p[, body]): of every record with evidence the posterior of being garbled, and the likeliest chain if that is at least a half (else -1)."""
    model = model or clean_model(df, text)
    seen = cut(evidence(df, key, text, source, model, with_text), "garbling")
    everyone = F.lit("*")
    name = F.coalesce(F.col("source"), F.lit("(none)"))
    sizes = df.select(F.col(source).cast("string").alias("source")).groupBy(name.alias("pool")).agg(F.count("*").alias("n"))
    sizes = cut(sizes, "garbling-sizes")
    all_n = sizes.agg(F.sum("n")).first()[0] or 0
    even = (1 - START_CLEAN) / len(CHAINS)
    none = F.lit(-1).alias("chain")

    def weigh(records: DataFrame) -> DataFrame:
        """Adds ``post``: array of (chain, p), none first. ``prior`` maps chains to their share; what is missing has the least."""
        prior = lambda c: F.coalesce(F.try_element_at("prior", c), F.lit(even / 100))
        raw = F.concat(
            F.array(F.struct(none, F.log(F.greatest(prior(F.lit(-1)), F.lit(1e-6))).alias("p"))),
            F.transform("gains", lambda g: F.struct(g["chain"].alias("chain"), (g["gain"] + F.log(prior(g["chain"]))).alias("p"))),
        )
        most = F.array_max(F.transform("_raw", lambda r: r["p"]))
        mass = F.aggregate("_raw", F.lit(0.0), lambda s, r: s + F.exp(r["p"] - F.col("_most")))
        out = records.withColumn("_raw", raw).withColumn("_most", most).withColumn("_mass", mass)
        return out.withColumn("post", F.transform("_raw", lambda r: F.struct(r["chain"].alias("chain"), (F.exp(r["p"] - F.col("_most")) / F.col("_mass")).alias("p")))).drop("_raw", "_most", "_mass")

    start = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.lit(START_CLEAN if c < 0 else even)) for c in range(-1, len(CHAINS))]))
    records = seen.withColumn("pool", name)
    weighed = weigh(records.withColumn("prior", start))
    last: dict[int, float] = {}
    for _ in range(ROUNDS):
        # M step: expected records of each chain, per source and over all; records without evidence belong to "none".
        each = weighed.select(F.explode(F.array("pool", everyone)).alias("pool"), F.explode("post").alias("x")).filter("x.chain >= 0")
        sums = each.groupBy("pool", F.col("x.chain").alias("chain")).agg(F.sum("x.p").alias("r"))
        sums = cut(sums, "garbling-round")
        # Of all records together: one number a chain.
        shared = {x["chain"]: x["r"] for x in sums.filter(F.col("pool") == "*").collect()}
        settled = all(abs(shared.get(c, 0.0) - last.get(c, 0.0)) <= SETTLED * max(1, all_n) for c in range(len(CHAINS)))
        last = shared
        if settled:
            break
        own = sums.filter(F.col("pool") != "*").groupBy("pool").agg(F.map_from_entries(F.collect_list(F.struct("chain", "r"))).alias("own"))
        pools = sizes.join(own, "pool", "left")
        r = lambda c: F.coalesce(F.try_element_at("own", F.lit(c)), F.lit(0.0))
        share = [(r(c) + F.lit(SMOOTHING * shared.get(c, 0.0) / max(1, all_n))) / (F.col("n") + SMOOTHING) for c in range(len(CHAINS))]
        pools = pools.select("pool", *[F.greatest(x, F.lit(1e-7)).alias(f"c{c}") for c, x in enumerate(share)])
        left = 1 - sum((F.col(f"c{c}") for c in range(len(CHAINS))), F.lit(0.0))
        entry = lambda c, p: F.struct(F.lit(c).alias("chain"), p.alias("p"))
        prior = F.map_from_entries(F.array(entry(-1, F.greatest(left, F.lit(1e-3))), *[entry(c, F.col(f"c{c}")) for c in range(len(CHAINS))]))
        weighed = weigh(records.join(pools.select("pool", prior.alias("prior")), "pool"))
    best = F.array_max(F.transform(F.filter("post", lambda x: x["chain"] >= 0), lambda x: F.struct(x["p"].alias("p"), x["chain"].alias("chain"))))
    affected = 1 - F.get("post", F.lit(0))["p"]
    out = weighed.withColumn("_best", best).withColumn("p", affected)
    return out.select(key, "source", "lost", F.when(F.col("p") >= 0.5, F.col("_best.chain")).otherwise(-1).alias("chain"), "p", *(["body"] if with_text else []))


def garbled(df: DataFrame, key: str, text: str, source: str, model: TripleModel | None = None, with_text: bool = False) -> DataFrame:
    """(key, chain, p, lost): the affected records; ``p`` is the posterior of any chain at all.

    ``chain`` is the name of the likeliest chain, null where characters are only lost.
    """
    found = posteriors(df, key, text, source, model, with_text).filter((F.col("chain") >= 0) | F.col("lost"))
    names = F.array(*[F.lit(n) for n in NAMES])
    return found.select(key, F.when(F.col("chain") >= 0, F.get(names, F.col("chain"))).alias("chain"), F.round("p", 6).alias("p"), "lost", *(["body"] if with_text else []))


def repaired(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, chain, lost, repaired): the affected records with their text restored as far as it can be.

    Only records with evidence carry their text beyond the scan, so no text is joined back.
    """
    model = clean_model(df, text)
    number = {n: i for i, n in enumerate(NAMES)}
    schema = f"`{key}` {dict(df.dtypes)[key]}, chain string, lost boolean, repaired string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fixed = [model.repair(t, number[c]) if isinstance(c, str) else t for t, c in zip(batch["body"], batch["chain"], strict=True)]
            yield pd.DataFrame({key: batch[key], "chain": batch["chain"], "lost": batch["lost"], "repaired": fixed})

    return garbled(df, key, text, source, model, with_text=True).select(key, "chain", "lost", "body").mapInPandas(run, schema)
