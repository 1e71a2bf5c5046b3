"""Problem 7: texts packed into containers of a fixed number of tokens.

Method: bounded-space online packing. Each partition keeps a fixed number of open
windows, places a text where it fits best, and closes the fullest window when it fits
nowhere. At its end a partition packs what its open windows hold anew; windows that are
still not full are merged with those of neighbouring partitions.

Tokens are those of a public byte-level vocabulary, read from a path that is a parameter.

Defined cases
    null text             -> in no container, no row
    empty text            -> 0 tokens, in some container like any other
    text above capacity   -> cut into pieces of at most the capacity, never inside a
                             character; only such texts are cut
    repeated rows         -> each is an item of its own
    empty table           -> empty result
"""

from __future__ import annotations

import base64
import importlib.util
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: How the public vocabulary splits text before merging (fixed value of that vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN_WINDOWS = 256
#: Partitions whose leftovers are merged by one task: at most MERGED * OPEN_WINDOWS windows.
MERGED = 64
FULL = 0.98


def default_vocabulary() -> str:
    """Where the multilingual byte-level vocabulary lies."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder of a vocabulary file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_pieces(text: str, capacity: int, enc) -> list[tuple[int, int, int]]:
    """(char_start, char_end, tokens) of a text: one piece, or several of at most ``capacity`` tokens.

    The text is encoded once and its tokens are sliced where a character ends; a piece is
    encoded again only by itself, to count what it has on its own, so the work is linear.
    """
    ids = enc.encode_ordinary(text)
    if len(ids) <= capacity:
        return [(0, len(text), len(ids))]
    raw = text.encode("utf-8", "replace")
    ends = list(accumulate(map(len, enc.decode_tokens_bytes(ids))))
    out, at, first, begin = [], 0, 0, 0
    while at < len(ids):
        take = min(capacity, len(ids) - at)
        while True:
            stop = ends[at + take - 1]
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80 and take > 1:  # inside a character
                take -= 1
                stop = ends[at + take - 1]
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:  # one character of several tokens
                stop += 1
            piece = raw[begin:stop].decode("utf-8")
            n = len(enc.encode_ordinary(piece))
            if n <= capacity or take == 1:
                break
            take = max(1, take - (n - capacity))
        while at < len(ids) and ends[at] <= stop:
            at += 1
        out.append((first, first + len(piece), n))
        first, begin = first + len(piece), stop
    if begin < len(raw):
        piece = raw[begin:].decode("utf-8")
        out.append((first, first + len(piece), len(enc.encode_ordinary(piece))))
    return out


class Windows:
    """Open windows ordered by the room left; items are placed best-fit."""

    def __init__(self, capacity: int, most: int | None):
        self.capacity, self.most = capacity, most
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def place(self, tokens: int, item) -> list | None:
        """Places an item; gives back the items of a window that had to be closed for it."""
        at, closed = bisect_left(self.room, (tokens, -1)), None
        if at < len(self.room):
            left, window = self.room.pop(at)
        else:
            if self.most and len(self.room) >= self.most:
                closed = self.held.pop(self.room.pop(0)[1])
            left, window = self.capacity, self.made
            self.made += 1
            self.held[window] = []
        self.held[window].append(item)
        insort(self.room, (max(0, left - tokens), window))
        return closed

    def rest(self) -> list[tuple[int, list]]:
        """(room left, items) of every window still open, fullest first."""
        return [(left, self.held[w]) for left, w in self.room]


def pack(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str | None = None, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(key, piece_no, n_pieces, char_start, char_end, tokens, container_id) of every text or piece.

    The texts are tokenized where they are read and never shuffled; the assignment is
    written once to the shared folder, so a lost executor changes no container.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = dict(df.dtypes)[key]
    columns = [key, "piece_no", "n_pieces", "char_start", "char_end", "tokens", "src_part", "src_window", "still_open"]
    schema = f"`{key}` {kind}, piece_no int, n_pieces int, char_start int, char_end int, tokens int, src_part int, src_window long, still_open boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, windows, number = encoder(vocabulary), Windows(capacity, open_windows), 0
        part = -1

        def rows(items: list, window: int, is_open: bool) -> list:
            return [(*x, part, window, is_open) for x in items]

        for batch in batches:
            out = []
            for k, t, part in zip(batch[key], batch["_t"], batch["src_part"], strict=True):  # noqa: B007
                spans = token_pieces(t, capacity, enc)
                for n, (a, b, tokens) in enumerate(spans, 1):
                    closed = windows.place(tokens, (k, n, len(spans), a, b, tokens))
                    if closed:
                        out += rows(closed, number, False)
                        number += 1
            yield pd.DataFrame(out, columns=columns)
        again = Windows(capacity, None)
        for item in sorted((x for _, held in windows.rest() for x in held), key=lambda x: (-x[5], str(x[0]), x[1])):
            again.place(item[5], item)
        out = []
        for left, items in again.rest():
            out += rows(items, number, left > (1 - FULL) * capacity)
            number += 1
        yield pd.DataFrame(out, columns=columns)

    texts = df.select(F.col(key), F.col(text).alias("_t")).filter(F.col("_t").isNotNull()).withColumn("src_part", F.spark_partition_id())
    placed = cut(texts.mapInPandas(run, schema), "packing")
    own = F.concat_ws("-", F.lit("c"), "src_part", "src_window")
    left = placed.filter("still_open").groupBy("src_part", "src_window").agg(F.sum("tokens").cast("int").alias("fill")).withColumn("merge_group", F.floor(F.col("src_part") / MERGED).cast("int"))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        windows = Windows(capacity, None)
        for x in group.sort_values(["fill", "src_part", "src_window"], ascending=[False, True, True]).itertuples(index=False):
            windows.place(int(x.fill), (int(x.src_part), int(x.src_window)))
        return pd.DataFrame([(p, w, f"m-{items[0][0]}-{items[0][1]}") for _, items in windows.rest() for p, w in items], columns=["src_part", "src_window", "container_id"])

    merged = left.groupBy("merge_group").applyInPandas(merge, "src_part int, src_window long, container_id string")
    keep = [key, "piece_no", "n_pieces", "char_start", "char_end", "tokens"]
    closed = placed.filter("NOT still_open").select(*keep, own.alias("container_id"))
    return closed.unionByName(placed.filter("still_open").join(merged, ["src_part", "src_window"]).select(*keep, "container_id"))
