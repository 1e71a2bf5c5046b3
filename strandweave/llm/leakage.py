"""Problem 8: passages of held-out items inside a training corpus.

Method: Wu-Manber multi-pattern search. A passage leaks if ``length`` consecutive kept
signs of it stand in a document, so the patterns are all windows of that length. The
shift table tells for a block of signs how far the search window may move without
missing a pattern; blocks with shift 0 name a bucket of passages, and direct comparison
confirms the occurrence.

Kept signs are letters, digits and Thai signs in lower case; everything else is skipped
on both sides.

Defined cases
    null or short document -> nothing
    passage below length   -> cannot leak, left out
    passage given twice    -> every item that holds the passage is reported
    very long document     -> scanned whole
    empty item table       -> empty result
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Everything that is no letter, digit or Thai sign.
SKIPPED = r"[^\p{L}\p{N}ก-ฺเ-๛]+"
#: Signs of passages searched at once. A larger set of items is searched in shards of
#: this size, one scan each, so what the executors hold has a fixed bound.
SHARD_SIGNS = 4_000_000
BLOCK = 20


def kept(text: Column) -> Column:
    """The signs that count, in lower case."""
    return F.regexp_replace(F.lower(text), SKIPPED, "")


class Searcher:
    """Shift table and suffix buckets of a set of passages."""

    def __init__(self, passages: list[tuple[str, str]], length: int, block: int = BLOCK):
        self.length, self.block = length, min(block, length)
        self.passages = [(k, p) for k, p in passages if p and len(p) >= length]
        self.reach = length - self.block
        shift: dict[str, int] = {}
        bucket: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, p) in enumerate(self.passages):
            for at in range(len(p) - self.block + 1):
                key = p[at : at + self.block]
                far = max(0, self.reach - at)
                if far < shift.get(key, self.reach + 1):
                    shift[key] = far
                if far == 0:
                    bucket[key].append((n, at + self.block))
        self.shift, self.bucket = shift, dict(bucket)

    def find(self, text: str | None) -> dict[str, int]:
        """Items that leak into ``text``, with the longest run of signs found of each."""
        found: dict[str, int] = {}
        if not text or not self.shift:
            return found
        length, block, skip = self.length, self.block, self.reach + 1
        shift, at, last = self.shift, length, len(text)
        while at <= last:
            key = text[at - block : at]
            far = shift.get(key, skip)
            if far:
                at += far
                continue
            start = at - length
            for n, end in self.bucket[key]:
                item, passage = self.passages[n]
                if found.get(item, 0) >= length and end - length > 0 and text[start - 1 : start] == passage[end - length - 1 : end - length]:
                    continue  # inside a run that is counted already
                if passage[end - length : end] == text[start:at]:
                    run = length
                    while at + run - length < last and end + run - length < len(passage) and text[at + run - length] == passage[end + run - length]:
                        run += 1
                    found[item] = max(run, found.get(item, 0))
            at += 1
        return found


def shares(passage: str, length: int) -> list[str]:
    """A passage, or if it is longer than a shard parts of it that overlap by all but one sign of the length, so that every window stands in one."""
    step = SHARD_SIGNS - length + 1
    return [passage[at : at + SHARD_SIGNS] for at in range(0, max(1, len(passage) - length + 1), step)]


def leaks(documents: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, length: int = 60) -> DataFrame:
    """(doc_key, item_key, longest_run): one row for each document and item of which it holds ``length`` signs.

    The documents are read once per shard of items and never shuffled; the result is the
    only thing that is. The driver holds the passages of one shard, whatever their number.
    """
    wanted = items.select(F.col(item_key).alias("k"), kept(F.col(passage)).alias("p")).filter(F.length("p") >= length)
    kinds = dict(documents.dtypes)[doc_key], dict(items.dtypes)[item_key]
    schema = f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}, longest_run int"
    signs = documents.select(F.col(doc_key), kept(F.col(text)).alias("_t")).filter(F.length("_t") >= length)

    def search(passages: list[tuple[str, str]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searcher = Searcher(passages, length)  # built where it is used: only the passages travel
            for batch in batches:
                rows = [(d, item, n) for d, t in zip(batch[doc_key], batch["_t"], strict=True) for item, n in searcher.find(t).items()]
                yield pd.DataFrame(rows, columns=[doc_key, item_key, "longest_run"])

        return signs.mapInPandas(run, schema)

    # One shard at a time is at the driver: where a second follows, the first is searched and written before.
    done, shard, held = None, [], 0
    for k, p in wanted.toLocalIterator(prefetchPartitions=False):
        for part in shares(p, length):
            if shard and held + len(part) > SHARD_SIGNS:
                found = cut(search(shard), "leaks")
                done, shard, held = found if done is None else done.unionByName(found), [], 0
            shard.append((k, part))
            held += len(part)
    last = search(shard)
    out = last if done is None else done.unionByName(last)
    return out.groupBy(doc_key, item_key).agg(F.max("longest_run").alias("longest_run"))
