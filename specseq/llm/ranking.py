"""Ranked lexical search of a stated set of items over all documents, by a scan of the texts.

The terms of all items go into one Aho-Corasick automaton, each between two
separators. A text's bytes are mapped so that A-Z are lower-cased and each byte
that belongs to no term is a separator; then every match of the automaton is a whole
term, and its output, the number of the term, leads to the items that hold it. A
first scan counts the corpus (documents, terms, documents of each term), a second one
counts terms again and scores; no index of the documents is made. Each task keeps its
best documents for each item, and those are ranked in two further steps.

The items' terms go to the tasks in blocks of items, so what is broadcast doesn't grow with
the number of items; each block takes its own scans.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, in_slices, written

#: Bytes that belong to no term are separators; A-Z are lower-cased (fixed values).
SEPARATOR = " "
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_MAP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Rows of (item, term) that one block of items has, about. An item is never split.
BLOCK_TERMS = 200_000
#: Bytes of text that the automaton takes at once, and cells of documents by items that are scored at once.
STRETCH, CELLS = 1 << 20, 1 << 21
#: The scores' parts are added in doubles, which are exact for whole numbers up to this one.
EXACT = 1 << 53
_output = itemgetter(1)
#: Parts in which tasks' best documents are ranked first.
PARTS = 64


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and repeats of each item; rows of one item_id are one item, a null item_id is none."""
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


class Terms:
    """A block's automaton, and for each of its terms the items that hold it with their repeats."""

    def __init__(self, terms: list[str], items: list[int], starts: np.ndarray, holders: np.ndarray, repeats: np.ndarray):
        self.items, self.starts, self.holders, self.repeats, self.size = np.array(items, np.int64), starts, holders, repeats, len(terms)
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(SEPARATOR + term.encode().decode("latin-1") + SEPARATOR, i)
        self.automaton.make_automaton()

    def counts(self, mapped: bytes) -> Counter:
        """How often each term of the block stands in a mapped text."""
        found, at, n = Counter(), 0, len(mapped)
        while at < n:
            end = n if n - at <= STRETCH else mapped.find(b" ", at + STRETCH)
            end = n if end < 0 else end
            found.update(map(_output, self.automaton.iter(f" {mapped[at:end].decode('latin-1')} ")))
            at = end
        return found


def mapped(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.translate(_MAP) for t in texts.cast(pa.binary()).to_pylist()]


def n_terms(text: bytes) -> int:
    """Terms of a mapped text, with repeats."""
    inside = np.frombuffer(text, np.uint8) != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[0]) if len(text) else 0


_held: dict[str, Terms] = {}


def _block(shared) -> Terms:
    """The block that a broadcast holds, built once a worker; a worker holds one block."""
    name, parts = shared.value
    if name not in _held:
        _held.clear()
        _held[name] = Terms(*parts)
    return _held[name]


def corpus_counts(docs: DataFrame, shared) -> DataFrame:
    """term (its number in the block) and n: documents with it; -1 stands for documents with a term, -2 for all terms with repeats."""

    def run(batches):
        block = _block(shared)
        df, n_docs, length = np.zeros(block.size, np.int64), 0, 0
        for batch in in_slices(batches):
            for text in mapped(batch.column(0)):
                n = n_terms(text)
                n_docs += n > 0
                length += n
                if n:
                    df[list(block.counts(text))] += 1
        some = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, (-1, -2))), pa.array(np.append(df[some], (n_docs, length)).astype(np.int64))], names=["term", "n"])
        give_back()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def best_of(item: np.ndarray, doc: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's ``top`` rows by highest score, equal ones by least doc."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    first = np.searchsorted(item, item, "left")
    keep = np.arange(len(item)) - first < top
    return item[keep], doc[keep], score[keep]


class Scorer:
    """Scores documents for the items of a block."""

    def __init__(self, block: Terms, weight: np.ndarray, n_docs: int, length: int, top: int):
        self.block, self.weight, self.n_docs, self.length, self.top = block, weight, n_docs, length, top
        self.held = np.diff(block.starts)
        most = np.bincount(block.holders, weights=block.repeats, minlength=len(block.items)).max(initial=0) * max(int(weight.max(initial=0)), 1) * 10**6
        self.kind = np.float64 if most < EXACT else np.int64
        self.rows = max(1, CELLS // max(1, len(block.items)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Documents by items."""
        doc, term, tf, norm = [], [], [], []
        for k, text in enumerate(texts):
            found = self.block.counts(text)
            norm.append(75 + (25 * n_terms(text) * self.n_docs) // self.length if found else 0)
            doc += [k] * len(found)
            term += found.keys()
            tf += found.values()
        doc, term, tf, norm = (np.array(x, np.int64) for x in (doc, term, tf, norm))
        part = self.weight[term] * ((10**9 * tf) // (1000 * tf + 12 * norm[doc]))
        n_items, held = len(self.block.items), self.held[term]
        place = np.repeat(self.block.starts[term] - np.append(0, np.cumsum(held)[:-1]), held) + np.arange(held.sum())
        cell = np.repeat(doc, held) * n_items + self.block.holders[place]
        value = np.repeat(part, held) * self.block.repeats[place]
        if self.kind is np.float64:
            total = np.bincount(cell, weights=value, minlength=len(texts) * n_items).astype(np.int64)
        else:
            total = np.zeros(len(texts) * n_items, np.int64)
            np.add.at(total, cell, value)
        return total.reshape(len(texts), n_items)

    def run(self, ids: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item (its number in the block), doc and score of the best of these documents."""
        total, ids = self.scores(texts), np.array(ids, np.int64)
        least = np.partition(total, len(texts) - self.top, axis=0)[len(texts) - self.top] if len(texts) > self.top else np.zeros(total.shape[1], np.int64)
        doc, item = np.nonzero((total >= least) & (total > 0))
        return best_of(item, ids[doc], total[doc, item], self.top)


def _ranked(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents of highest score above 0, equal scores by least doc_id.

    A null or empty text has no terms. Rows that repeat an id are documents each, and
    may be ranked each; a row without an id counts in the corpus and isn't ranked, as
    nothing names it. Rows of one item_id are one item; items without an id or
    without terms, and empty tables, give no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    terms = written(item_terms(items), "item-terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    results = []
    for k in range(blocks):
        rows = terms.where(F.col("block") == k).select("item_id", "term", "repeats").collect()
        if rows:
            results.append(_search_block(spark, texts, rows, top))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.select("item_id", "rank", "doc_id", "score")


def _search_block(spark, texts: DataFrame, rows: list, top: int) -> DataFrame:
    names, items = sorted({r.term for r in rows}), sorted({r.item_id for r in rows})
    number, place = {t: i for i, t in enumerate(names)}, {x: i for i, x in enumerate(items)}
    term, holder, repeats = (np.array(x, np.int64) for x in zip(*((number[r.term], place[r.item_id], r.repeats) for r in rows), strict=True))
    order = np.lexsort((holder, term))
    starts = np.append(0, np.cumsum(np.bincount(term, minlength=len(names))))
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, (names, items, starts, holder[order], repeats[order])))
    counted = {r.term: r.n for r in corpus_counts(texts, shared).collect()}  # a row a term of the block
    n_docs, length = counted.pop(-1, 0), counted.pop(-2, 0)
    df = np.zeros(len(names), np.int64)
    df[list(counted)] = list(counted.values())
    weight = weights(df, n_docs)

    def run(batches):
        block = _block(shared)
        scorer = Scorer(block, weight, n_docs, length, top)
        kept, ids, waiting, size = [np.zeros(0, np.int64)] * 3, [], [], 0
        for batch in in_slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), mapped(batch.column(1)), strict=True):
                if doc is None or not text:
                    continue
                ids.append(doc)
                waiting.append(text)
                size += len(text)
                if len(ids) >= scorer.rows or size > 8 << 20:
                    kept = best_of(*map(np.concatenate, zip(kept, scorer.run(ids, waiting), strict=True)), top)
                    ids, waiting, size = [], [], 0
        if ids:
            kept = best_of(*map(np.concatenate, zip(kept, scorer.run(ids, waiting), strict=True)), top)
        yield pa.RecordBatch.from_arrays([pa.array(block.items[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["item_id", "doc_id", "score"])
        give_back()

    best = texts.mapInArrow(run, "item_id long, doc_id long, score long")
    return _ranked(_ranked(best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), ["item_id", "part"], top).drop("rank", "part"), ["item_id"], top)
