"""Texts into containers of a fixed number of tokens, by multiway differencing.

Texts are dealt by hash into batches of about ``BATCH`` texts. In a batch, Karmarkar-Karp differencing
in k windows repeatedly joins the two partial partitions with the largest spread, largest sums onto
smallest, which ends in k windows of nearly equal size. Where sizes are so coarse that some windows still
exceed the capacity, items are moved and swapped as long as that lowers what exceeds it. k starts at the
least possible number, that of the volume or of the items above half a container, and rises whenever
the capacity is still exceeded. Texts longer than a container are cut into full containers and a rest,
the only ones that are split.

Defined cases. Null texts and texts without tokens take no room and are left out. Repeated rows are
packed as often as they stand. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import cut

CAPACITY, BATCH = 2048, 1024
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PACKED = "container_id bigint, doc_id bigint, piece_no int, token_start int, token_end int, n_tokens int, container_tokens int"
SIZES = "doc_id bigint, n_tokens int"
#: Tasks that batches are packed in, at most.
MOST_TASKS = 10_000

#: Fixed value: how the vocabulary's tokenizer splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": np.array([len(e.encode_ordinary(t)) for t in b["text"]], np.int32)})

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, SIZES)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window number (0..k-1) of each item, by largest differencing over k-way partial partitions."""
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, int)
    children: list[tuple[int, int]] = []  # sets n, n + 1, ... are joined from two sets; 0..n-1 are items

    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        sums = np.zeros(k, np.int64)
        sums[0] = sizes[i]
        sets = np.full(k, -1, np.int64)
        sets[0] = i
        heap.append((-int(sizes[i]), int(i), sums, sets))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, sa, ma = heapq.heappop(heap)
        _, _, sb, mb = heapq.heappop(heap)
        sb, mb = sb[::-1], mb[::-1]
        sums = sa + sb
        sets = np.where(ma < 0, mb, ma)
        both = np.flatnonzero((ma >= 0) & (mb >= 0))
        if len(both):
            sets[both] = n + len(children) + np.arange(len(both))
            children.extend(zip(ma[both].tolist(), mb[both].tolist()))
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], sets[order]
        tick += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tick, sums - sums[-1], sets))
    out = np.zeros(n, int)
    for w, top in enumerate(heap[0][3].tolist()):
        stack = [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = w
            else:
                stack.extend(children[x - n])
    return out


def settled(sizes: np.ndarray, where: np.ndarray, k: int, capacity: int) -> tuple[np.ndarray, int]:
    """Windows after moves and swaps of items that lower what exceeds the capacity, and how much still does."""
    n = len(sizes)
    fill = np.bincount(where, weights=sizes, minlength=k).astype(np.int64)
    s, at = np.r_[sizes, np.zeros(k, np.int64)], np.r_[where, np.arange(k)]  # a swap with a window's empty slot is a move
    moved = True
    while moved and (fill > capacity).any():
        moved = False
        over = np.flatnonzero(fill > capacity)
        for w in over[np.argsort(-fill[over], kind="stable")]:
            while fill[w] > capacity:
                mine = np.flatnonzero(at[:n] == w)
                d, there = s[mine][:, None] - s[None, :], fill[at]
                change = np.maximum(fill[w] - d - capacity, 0) - (fill[w] - capacity) + np.maximum(there + d - capacity, 0) - np.maximum(there - capacity, 0)
                change = np.where((at == w)[None, :] | (d <= 0), np.iinfo(np.int32).max, change)
                # the least excess; among equals, into the window that is left fullest
                i, j = divmod(int(np.argmin(change * (2 * capacity) - np.minimum(there + d, capacity))), n + k)
                if change[i, j] >= 0:
                    break
                x, v = mine[i], at[j]
                fill[w], fill[v] = fill[w] - d[i, j], fill[v] + d[i, j]
                at[x] = v
                if j < n:
                    at[j] = w
                moved = True
    return at[:n], int(np.maximum(fill - capacity, 0).sum())


def least_windows(sizes: np.ndarray, capacity: int) -> int:
    """Number of windows that no packing can go below: by volume, and by items of which no two share a window."""
    return max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Window of each item and number of windows; every item must fit the capacity."""
    k = least_windows(sizes, capacity)
    while True:
        where, excess = settled(sizes, differencing(sizes, k), k, capacity)
        if not excess:
            return where, k
        k += -(-excess // capacity)


def containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, batch: int = BATCH) -> DataFrame:
    """One row per piece of text: its container, its token range, and how full the container is."""
    sizes = cut(token_counts(documents, vocabulary).where("n_tokens > 0 and doc_id is not null"))  # texts are read once
    batches_ = max(1, -(-sizes.count() // batch))
    # rows are few bytes and much work, so the number of tasks is stated and not left to their size
    dealt = sizes.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches_))).repartition(min(batches_, MOST_TASKS), "batch").sortWithinPartitions("batch", "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def emit(parts: list[pd.DataFrame]) -> pd.DataFrame:
            d = pd.concat(parts)
            doc, tokens, number = d["doc_id"].to_numpy(), d["n_tokens"].to_numpy().astype(np.int64), int(d["batch"].iloc[0])
            pieces = -(-tokens // capacity)
            at = np.repeat(np.arange(len(doc)), pieces)
            no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = no * capacity
            size = np.minimum(tokens[at] - start, capacity)
            full = size == capacity
            window = np.empty(len(at), np.int64)
            k = 0
            if (~full).any():
                window[~full], k = pack(size[~full], capacity)
            window[full] = k + np.arange(int(full.sum()))
            fill = np.bincount(window, weights=size, minlength=1).astype(np.int64)
            return pd.DataFrame({"container_id": window * batches_ + number, "doc_id": doc[at], "piece_no": no.astype(np.int32), "token_start": start.astype(np.int32), "token_end": (start + size).astype(np.int32), "n_tokens": size.astype(np.int32), "container_tokens": fill[window].astype(np.int32)})

        for f in frames:
            if not len(f):
                continue
            if held and f["batch"].iloc[0] != held[-1]["batch"].iloc[0]:
                yield emit(held)
                held = []
            for _, g in f.groupby("batch", sort=False):
                if held and g["batch"].iloc[0] != held[-1]["batch"].iloc[0]:
                    yield emit(held)
                    held = []
                held.append(g)
        if held:
            yield emit(held)

    return dealt.mapInPandas(run, PACKED)
