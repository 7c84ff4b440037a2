"""Benchmark decontamination by greedy string tiling.

Words shared in runs of five seed the comparison of a document with a benchmark
item; Karp-Rabin codes of the runs find the seeds. Of each pair that shares enough
of them, the longest common run of unmarked words is marked again and again, until
none of five words is left. The marked share of the item's words decides, in
whatever order its passages stand. The benchmark is the stated set of queries: it
is indexed in blocks of bounded text, and every document is read whole against each.
"""

from __future__ import annotations

import heapq
import re
import string

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import short_batches

RUN = 5
COVERAGE = 0.8
#: Characters of benchmark text in a block, which is broadcast; a longer item is a block of its own.
BLOCK_CHARS = 8 << 20

#: Characters of scripts without blanks between words (Thai to Khmer, kana, ideographs).
ALONE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words between white space and ASCII punctuation; characters of scripts that put no blanks stand alone."""
    text = text or ""
    if not text.isascii():
        text = ALONE.sub(r" \g<0> ", text)
    return text.lower().encode().translate(_BLANKS).split()


def _codes(ids: np.ndarray, run: int) -> np.ndarray:
    """Karp-Rabin codes of the runs of words."""
    n = max(0, len(ids) - run + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(run):
        out = out * _MULTIPLIER + ids[k : k + n].astype(np.uint64)
    return out


class Index:
    """Benchmark items by the codes of their runs of ``run`` words; of an item with fewer words the whole is the run."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.words, self.items, codes = {}, [], {}
        for item_id, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words)) for w in tokens(text)], dtype=np.int64)
            if len(ids):
                own = min(run, len(ids))
                codes.setdefault(own, []).append((len(self.items), np.unique(_codes(ids, own))))
                self.items.append((item_id, ids, own))
        #: By length of run: sorted codes and the item of each.
        self.codes = {}
        for own, found in codes.items():
            every, item = np.concatenate([c for _, c in found]), np.repeat([i for i, _ in found], [len(c) for _, c in found])
            order = np.argsort(every, kind="stable")
            self.codes[own] = every[order], item[order]

    def matches(self, text: str | None) -> list[tuple[float, int]]:
        """(coverage, item id) of the items that share a run with the text."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in tokens(text)], dtype=np.int64)
        known, shared = np.concatenate([[0], np.cumsum(ids >= 0)]), []
        for own, (codes, item) in self.codes.items():
            if len(ids) >= own:
                full = known[own:] - known[:-own] == own
                here = np.unique(_codes(ids, own)[full])
                low, high = np.searchsorted(codes, here, "left"), np.searchsorted(codes, here, "right")
                shared.append(np.unique(item[_ranges(low, high)]))
        if not any(len(x) for x in shared):
            return []
        return [(tiled(ids, self.items[i][1], self.items[i][2]), self.items[i][0]) for i in np.concatenate(shared).tolist()]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each ``low`` up to its ``high``."""
    n = high - low
    return np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())


def common_runs(doc: np.ndarray, item: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the item, place in the document, words) of every common run that cannot be extended, of ``run`` words or more.

    Seeds with equal codes are compared word by word; neighbours on one diagonal make one run.
    """
    codes, mine = _codes(doc, run), _codes(item, run)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    low, high = np.searchsorted(codes, mine, "left"), np.searchsorted(codes, mine, "right")
    i, p = np.repeat(np.arange(len(mine)), high - low), order[_ranges(low, high)]
    same = np.ones(len(i), dtype=bool)
    for k in range(run):
        same &= item[i + k] == doc[p + k]
    i, p = i[same], p[same]
    order = np.lexsort((i, p - i))
    i, p = i[order], p[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(p) != 1)
    first = np.flatnonzero(new)
    return i[first], p[first], np.diff(np.append(first, len(i))) + run - 1


def tiled(doc: np.ndarray, item: np.ndarray, run: int) -> float:
    """Share of the item's words in the longest non-overlapping common runs, marked greedily.

    Of equally long runs the first in the item, then in the document, is marked. Runs wait by length; one that
    marks have cut into since is put back as the free parts that are long enough.
    """
    doc_free, item_free = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
    waiting = [(-n, i, p) for i, p, n in zip(*(x.tolist() for x in common_runs(doc, item, run)))]
    heapq.heapify(waiting)
    while waiting:
        n, i, p = heapq.heappop(waiting)
        n = -n
        free = item_free[i : i + n] & doc_free[p : p + n]
        if free.all():
            item_free[i : i + n] = doc_free[p : p + n] = False
        elif free.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= run:
                    heapq.heappush(waiting, (a - b, i + a, p + a))
        if not item_free.any():
            break
    return float((~item_free).mean())


def _blocks(benchmark: DataFrame, chars: int):
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        if row.i is None or row.t is None:
            continue
        if block and held + len(row.t) > chars:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += len(row.t)
    if block:
        yield block


def matcher(benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS):
    """A column function text -> (coverage, item_id, n_items): the best match and the items covered enough."""
    spark = benchmark.sparkSession
    short_batches(spark)
    kind = "coverage double, item_id long, n_items int"

    def for_block(items):
        sent = spark.sparkContext.broadcast(Index(items))

        @F.pandas_udf(kind)
        def match(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for text in texts:
                found = sent.value.matches(text)
                best = max(found, key=lambda x: (x[0], -x[1]), default=(0.0, None))
                rows.append((best[0], best[1] if best[0] else None, sum(c >= coverage for c, _ in found)))
            frame = pd.DataFrame(rows, columns=["coverage", "item_id", "n_items"])
            return frame.astype({"coverage": float, "item_id": "Int64", "n_items": "int32"})

        return match

    blocks = [for_block(items) for items in _blocks(benchmark, block_chars)]
    if not blocks:
        return lambda text: F.lit(None).cast(f"struct<{kind.replace(' ', ':')}>".replace(",:", ","))

    def column(text: Column) -> Column:
        parts = [block(text.cast("string")) for block in blocks]
        best = F.greatest(*[F.struct(p["coverage"], -p["item_id"]) for p in parts]) if len(parts) > 1 else None
        if best is None:
            return parts[0]
        return F.struct(
            best["coverage"].alias("coverage"), (-best["col2"]).alias("item_id"), sum((p["n_items"] for p in parts), F.lit(0)).alias("n_items")
        )

    return column


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, the largest covered share of an item, the item, how many items are covered enough, and whether any is.

    Takes doc_id and text; other columns are ignored. Null and empty texts and an
    empty benchmark give no match: coverage 0, item null. Of equally covered items
    the smallest id is named. Items without id or text are left out; of items with fewer than five words all must stand in a row.
    """
    match = matcher(benchmark, coverage, block_chars)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), match(F.col("text")).alias("m"))
    return found.select(
        "doc_id",
        F.coalesce("m.coverage", F.lit(0.0)).alias("coverage"),
        F.col("m.item_id").alias("item_id"),
        F.coalesce("m.n_items", F.lit(0)).alias("n_items"),
        (F.coalesce("m.n_items", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text covers no benchmark item enough."""
    match = matcher(benchmark, coverage)
    return docs.filter(F.coalesce(match(F.col("text"))["n_items"], F.lit(0)) == 0)
