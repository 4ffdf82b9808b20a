"""Problem 8: passages of held-out items inside a training corpus.

Texts are compared as plain letters without spaces. Every passage of `words` consecutive words of an item (the
whole item, if it is shorter) is a pattern with an error budget of its own. Items are cut into pieces on a fixed grid,
so fine that each pattern of an item holds budget + 1 whole pieces, and two more where they stay long enough; a pattern
that occurs with at most `budget` edits then keeps one or three pieces unhurt. Items of one grid width are a class; documents
are scanned once a class for exact pieces with a rolling hash; what has enough of them is verified, runs without an edit
by extending the hit, others with Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import codepoints as cp
from .common import read

ITEM_BLOCK_CHARS = 8_000_000  # items are broadcast in blocks of at most so many characters (or one item)
EDIT_LETTERS = 12  # a passage may have one edit for so many letters, up to the budget: more would make another text of a short item
WIDTHS = {3: (16, 12, 10, 8, 7), 1: (16, 12, 8, 6, 5, 4, 3, 2, 1)}  # grid widths by the number of pieces that must be unhurt


def myers(pattern: str, text: str, most: int) -> bool:
    """Whether pattern occurs somewhere in text with at most `most` edits (bit-parallel, pattern of any length)."""
    m = len(pattern)
    if m <= most:
        return True
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most:
            return True
    return False


def allowed(letters: np.ndarray, budget: int) -> np.ndarray:
    """The edits that passages of so many letters may have."""
    return np.minimum(budget, letters // EDIT_LETTERS)


def grid(w: np.ndarray, ends: np.ndarray, words: int, budget: int) -> tuple[int, int]:
    """(pieces that must be unhurt, grid width) for an item with these word limits: its tightest passage decides for it alone."""
    n = min(words, len(w))
    if not n:
        return 1, WIDTHS[1][0]
    long = ends[n - 1 :] - w[: len(w) - n + 1]
    # a span of n letters holds (n + 1) // q - 1 whole pieces of a grid of width q, at least
    for need in (3, 1) if budget else (1,):
        most = int(((long + 1) // (allowed(long, budget) + need + 1)).min())
        if q := next((q for q in WIDTHS[need] if q <= most), 0):
            return need, q
    return 1, 1


def classes(keys: list, texts: list[str], words: int, budget: int) -> list[Items]:
    """The items by grid, so that one with a short passage changes nothing for the others."""
    _, first, begins, _ = cp.folded(*cp.explode(pa.array(texts, pa.string())))
    by: dict[tuple[int, int], list[int]] = {}
    for i in range(len(texts)):
        a, b = int(begins[i]), int(begins[i + 1])
        w = np.flatnonzero(first[a:b])
        by.setdefault(grid(w, np.append(w[1:], b - a), words, budget), []).append(i)
    return [Items([keys[i] for i in x], [texts[i] for i in x], words, budget, *g) for g, x in by.items()]


class Items:
    """Items of one grid: letters, word limits and the sorted hashes of their pieces."""

    def __init__(self, keys: list, texts: list[str], words: int, budget: int, need: int, q: int):
        letters, first, begins, _ = cp.folded(*cp.explode(pa.array(texts, pa.string())))
        self.keys, self.words, self.budget, self.need, self.q = keys, words, budget, need, q
        self.text, self.limits = [], []
        for i in range(len(texts)):
            a, b = int(begins[i]), int(begins[i + 1])
            w = np.flatnonzero(first[a:b])
            ends = np.append(w[1:], b - a)
            self.text.append(letters[a:b])
            self.limits.append((w, ends))
        prefix = cp.sums(letters)
        at = [np.arange(int(begins[i]), int(begins[i + 1]) - self.q + 1, self.q) for i in range(len(texts))]
        self.item = np.repeat(np.arange(len(texts)), [len(x) for x in at]).astype(np.int64)
        pos = np.concatenate(at) if at else np.zeros(0, np.int64)
        h = cp.spans(prefix, pos, pos + self.q)
        order = np.argsort(h, kind="stable")
        self.hash, self.item = h[order], self.item[order]
        self.pos = (pos - begins[:-1][np.repeat(np.arange(len(texts)), [len(x) for x in at])])[order] if len(pos) else pos
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, letters: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, position in the row, item, position in the item) of every exact piece."""
        n = len(letters) - self.q + 1
        if n <= 0 or not len(self.hash):
            return (np.zeros(0, np.int64),) * 4
        prefix = cp.sums(letters)
        at = np.arange(n)
        h = cp.spans(prefix, at, at + self.q)
        at = at[self.bits[(h >> np.uint64(42)).astype(np.int64)]]
        h = h[at]
        lo, hi = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        piece = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(at, count)
        row = np.searchsorted(begins, at, "right") - 1
        inside = at + self.q <= begins[row + 1]
        row, at, piece = row[inside], at[inside], piece[inside]
        return row, at - begins[row], self.item[piece], self.pos[piece]

    def together(self, row: np.ndarray, at: np.ndarray, item: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        """The hits that have enough others of their row and item near their diagonal, in order.

        Unhurt pieces of one passage lie on diagonals that its edits move apart by `budget` at most.
        """
        order = np.lexsort((pos, at - pos, item, row))
        row, at, item, pos = row[order], at[order], item[order], pos[order]
        n = len(row) - self.need + 1
        keep = np.zeros(len(row), bool)
        if n > 0:
            a, b = slice(0, n), slice(self.need - 1, None)
            ok = (row[a] == row[b]) & (item[a] == item[b]) & ((at - pos)[b] - (at - pos)[a] <= self.budget)
            for i in range(self.need):
                keep[i : i + n] |= ok
        row, at, item, pos = row[keep], at[keep], item[keep], pos[keep]
        order = np.lexsort((pos, item, row))
        return row[order], at[order], item[order], pos[order]

    def leaked(self, letters: np.ndarray, item: int, at: np.ndarray, pos: np.ndarray) -> bool:
        s = self.text[item]
        w, ends = self.limits[item]
        need = min(self.words, len(w))
        done: dict[int, int] = {}
        for a, p in zip(at.tolist(), pos.tolist()):
            if done.get(a - p, -1) > p:
                continue
            n = min(len(letters) - a, len(s) - p)
            diff = np.flatnonzero(letters[a : a + n] != s[p : p + n])
            right = p + (int(diff[0]) if len(diff) else n)
            n = min(a, p)
            diff = np.flatnonzero(letters[a - n : a] != s[p - n : p])
            left = p - n + (int(diff[-1]) + 1 if len(diff) else 0)
            done[a - p] = right
            if np.searchsorted(ends, right, "right") - np.searchsorted(w, left) >= need:
                return True
        if not self.budget:
            return False
        seen = np.unique(pos)
        starts, stops = w[: len(w) - need + 1], ends[need - 1 :]
        edits = allowed(stops - starts, self.budget)
        # an edit hurts one piece at most: all others of the passage must be met
        unhurt = np.maximum(stops // self.q - -(-starts // self.q) - edits, self.need)
        enough = np.searchsorted(seen, stops - self.q, "right") - np.searchsorted(seen, starts) >= unhurt
        plain = lambda x: x.astype("<u4").tobytes().decode("utf-32-le")
        for i in np.flatnonzero(enough & (edits > 0)).tolist():
            b, e, most = int(starts[i]), int(stops[i]), int(edits[i])
            inner = (pos >= b) & (pos + self.q <= e)
            p, diagonal = pos[inner], at[inner] - pos[inner]
            # words at both ends of the passage must be whole, so that a shorter quote never counts
            pattern, first, last = plain(s[b:e]), plain(s[b : int(ends[i])]), plain(s[int(w[i + need - 1]) : e])
            for d in set(diagonal.tolist()):
                # each edit moves what follows by one letter at most
                if len(set(p[(diagonal >= d) & (diagonal <= d + most)].tolist())) < unhurt[i]:
                    continue
                # the passage begins at most so far before the least of its diagonals, or behind it
                lo, hi = max(0, b + d - most), min(len(letters), e + d + 2 * most)
                text = plain(letters[lo:hi])
                x, y = text.find(first, 0, len(first) + 2 * most), text.rfind(last, max(0, len(text) - len(last) - 3 * most))
                if x >= 0 and y >= 0 and myers(pattern, text, most):
                    return True
        return False


def _item_blocks(items: DataFrame, key: str, text: str, words: int) -> Iterator[tuple[list, list[str]]]:
    """Item texts in blocks of bounded size, one partition of the item table at a time."""
    blocks: dict[bool, list[tuple]] = {False: [], True: []}
    size = {False: 0, True: 0}
    for row in items.select(key, text).where(f"{text} is not null").distinct().toLocalIterator():
        short = len(row[1].split()) < 2 * words
        if blocks[short] and size[short] + len(row[1]) > ITEM_BLOCK_CHARS:
            yield tuple(map(list, zip(*blocks[short])))
            blocks[short], size[short] = [], 0
        blocks[short].append(tuple(row))
        size[short] += len(row[1])
    yield from (tuple(map(list, zip(*block))) for block in blocks.values() if block)


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text",
          words: int = 12, budget: int = 2) -> DataFrame:
    """Rows (doc_key, item_key): the document holds the whole item or `words` consecutive words of it.

    Case, punctuation, spacing, line breaks, hyphens, accents, look-alike and invisible characters don't count; up to
    `budget` letters of a passage may differ, one in twelve at most. Null, blank and letterless texts and items match nothing; repeated rows
    count once; other columns are ignored. The items go to the executors in blocks of bounded size, each document is
    scanned whole once a grid width of a block.
    """
    spark = docs.sparkSession
    d, i = docs.schema[doc_key], items.schema[item_key]
    schema = f"`{doc_key}` {d.dataType.simpleString()}, `{item_key}` {i.dataType.simpleString()}"
    item_type = to_arrow_type(i.dataType)
    out = None
    for keys, texts in _item_blocks(items, item_key, item_text, words):
        shared = spark.sparkContext.broadcast(classes(keys, texts, words, budget))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = [pa.array(its.keys, item_type) for its in shared.value]
            for b in batches:
                letters, _, begins, _ = cp.folded(*cp.explode(b.column(1)))
                for its, name in zip(shared.value, names):
                    row, at, item, pos = its.together(*its.hits(letters, begins))
                    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]), [True]))) if len(row) else []
                    found = [(int(row[x]), int(item[x])) for x, y in zip(cut[:-1], cut[1:]) if y - x >= its.need
                             and its.leaked(letters[begins[row[x]] : begins[row[x] + 1]], int(item[x]), at[x:y], pos[x:y])]
                    rows, hit = (np.array(v, np.int64) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), name.take(pa.array(hit))], [doc_key, item_key])

        part = docs.select(doc_key, text).where(f"{text} is not null").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def p8_found(spark, sf_dir) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_report(spark, sf_dir) -> DataFrame:
    """Every item with the number of documents that it leaked into."""
    found = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return read(spark, sf_dir, "eval_items").select("item_id", "suite").distinct().join(found, "item_id", "left").fillna(0, ["n_documents"])


QUERIES = {"p8_found": p8_found, "p8_report": p8_report}
SQL: dict = {}
