"""Evaluation texts inside training texts, by pigeonhole edit matching.

A passage is any ``WINDOW`` consecutive words of an item; a document leaks it if some part of it is at
most ``budget`` word edits (a word changed, added or left out) away. Items are cut into pieces of so few
words that every passage, wherever it begins, holds budget + 1 whole pieces, so an occurrence keeps at
least one piece intact. Exact hits of all pieces are found by one automaton over each document; every
passage around a hit is verified by Myers' bit-parallel edit distance over words, and nothing is
accepted without it. Distance 0 means that the document has the passage's words in a row.

Pieces that stand in the same surroundings in several items are verified once for all of them.
Words are runs of letters or digits of the text's consistent form, without regard to case.

Defined cases. Null and empty texts hold nothing. Items of fewer than WINDOW words have no passage.
Repeated documents or items give one row per pair of ids. Empty tables give empty results.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.lookalike import normal

WINDOW, BUDGET = 13, 2
#: Items that are searched for at once; more are searched in blocks.
BLOCK_ITEMS = 20_000
WORD = re.compile(r"[^\W_]+")
LEAKS = "doc_id bigint, item_id bigint, edits int, item_words int"


def words_of(text: str) -> list[str]:
    return WORD.findall(normal(text, by_text=False).casefold())


def piece_words(window: int = WINDOW, budget: int = BUDGET) -> int:
    """Words of a piece such that any window holds budget + 1 whole pieces, wherever the pieces begin."""
    return max(1, (window + 1) // (budget + 2))


def myers(pattern: Sequence, text: Sequence) -> int:
    """Least edit distance of ``pattern`` to any part of ``text``, bit-parallel over characters or words."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return best


class Index:
    """Pieces of a block of items in one automaton, each with its distinct surroundings and the items they stand in."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, budget: int = BUDGET):
        self.window, self.budget, self.p = window, budget, piece_words(window, budget)
        self.items = [(i, w) for i, t in items if t is not None and len(w := words_of(t)) >= window]
        reach = window - self.p
        around: dict[tuple, list[int]] = defaultdict(list)  # (words around a piece, its place in them) -> items
        for k, (_, w) in enumerate(self.items):
            for o in range(0, len(w) - self.p + 1, self.p):
                lo = max(0, o - reach)
                around[tuple(w[lo : o + self.p + reach]), o - lo].append(k)
        pieces: dict[str, list[int]] = defaultdict(list)
        self.around = []
        for (words, o), ks in around.items():
            pieces[" " + " ".join(words[o : o + self.p]) + " "].append(len(self.around))
            passages = range(max(0, o + self.p - window), min(len(words) - window, o) + 1)
            shared = [len({*words[s : s + window]}) - budget for s in passages]
            self.around.append((words, passages, frozenset(words), shared, min(shared), ks))
        self.auto = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.auto.add_word(piece, (len(piece), at))
        if pieces:
            self.auto.make_automaton()
        self.empty = not pieces

    def search(self, text: str) -> dict[int, int]:
        """Item number -> least edits of a passage of it in the text, as far as the budget goes."""
        doc = words_of(text)
        if self.empty or len(doc) < self.p:
            return {}
        flat = " " + " ".join(doc) + " "
        found: dict[int, int] = {}
        starts: dict[int, int] | None = None
        window, budget = self.window, self.budget
        reach = window - self.p + budget
        for end, (length, at) in self.auto.iter(flat):
            if starts is None:
                starts, pos = {}, 0
                for n, w in enumerate(doc):
                    starts[pos] = n
                    pos += len(w) + 1
            d = starts[end - length + 1]
            near = doc[max(0, d - reach) : d + self.p + reach]
            for a in at:
                words, passages, known, shared, least_shared, ks = self.around[a]
                # a passage within the budget shares all its different words but ``budget`` with what stands near
                here = known.intersection(near)
                if len(here) < least_shared:
                    continue
                least = max(found.get(k, budget + 1) for k in ks)
                for s, n in zip(passages, shared):
                    if not least:
                        break
                    if len(here.intersection(words[s : s + window])) >= n:
                        least = min(least, myers(words[s : s + window], near))
                if least <= budget:
                    for k in ks:
                        found[k] = min(found.get(k, least), least)
        return found


_BUILT: dict[tuple, Index] = {}


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """One row per document and item it holds a passage of, with the least word edits of a passage.

    The items are the stated query set: they go to the executors in blocks of at most BLOCK_ITEMS,
    and every document is searched whole, where it lies; there is no shuffle of documents.
    """
    spark = documents.sparkSession
    known = items.where("item_id is not null and text is not null").select("item_id", "text")
    blocks = max(1, -(-known.count() // BLOCK_ITEMS))
    out = None
    for b in range(blocks):
        rows = [(r.item_id, r.text) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        sent, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], sent=sent, key=(name, window, budget)) -> Iterator[pd.DataFrame]:
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = Index(sent.value, window, budget)
            index = _BUILT[key]
            for d in batches:
                hits = [(doc, index.items[k][0], edits, len(index.items[k][1])) for doc, t in zip(d["doc_id"], d["text"]) if t is not None for k, edits in index.search(t).items()]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "edits", "item_words"])

        part = documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("item_words").alias("item_words"))
