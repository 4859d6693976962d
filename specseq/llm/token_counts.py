"""Token counts of a unigram vocabulary, without making tokens.

An Aho-Corasick automaton over the vocabulary finds all pieces that end at each
character; dynamic programming keeps the best score to there and its number of
tokens. Ties fall as in the tokenizer: of equal scores the earliest start wins,
and an unknown character, which starts last, wins none.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices

#: The mark that stands for a blank, and the penalty of an unknown character under the least score (fixed values).
MARK, UNKNOWN = "▁", 10.0
#: Words whose counts a worker remembers; emptied when full.
CACHE = 600_000


class UnigramCounter:
    """Counts the tokens of texts by (piece, score) pairs; a character without a piece takes its UTF-8 bytes, or one token a run without byte fallback."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        last = {piece: float(score) for piece, score in vocabulary if piece}
        for piece, score in last.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((float(s) for _, s in vocabulary), default=0.0) - UNKNOWN
        self.byte_fallback = byte_fallback
        # Words can be counted apart if no piece reaches from a non-mark over a mark, and sums don't round: else ties would fall otherwise than in a whole text.
        self.apart = not any(MARK in p.lstrip(MARK) for p in last) and all(s == int(s) and abs(s) < 1 << 32 for s in last.values())
        self.known: dict[str, int] = {}

    def count_marked(self, text: str) -> int:
        """Tokens of a text in which blanks are marks already."""
        n = len(text)
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        for e in range(n):
            top, start, single = None, -1, False
            for size, score in ends[e]:
                s = e + 1 - size
                z = best[s] + score
                if top is None or z > top or (z == top and s < start):
                    top, start = z, s
                single = single or size == 1
            if single or (top is not None and top >= best[e] + self.unknown):
                best[e + 1], count[e + 1] = top, count[start] + 1
            else:
                best[e + 1], unk[e + 1] = best[e] + self.unknown, True
                count[e + 1] = count[e] + (len(text[e].encode("utf-8", "replace")) if self.byte_fallback else int(not unk[e]))
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a whole text: a mark before it, and marks for its blanks. An empty text has none."""
        if not text:
            return 0
        if not self.apart or MARK in text:
            return self.count_marked(MARK + text.replace(" ", MARK))
        # Without byte fallback a run of unknown characters is one token; a mark ends it only if it is a piece.
        total, known = 0, self.known
        if len(known) > CACHE:
            known.clear()
        blanks = 1
        for word in text.split(" "):
            if not word:
                blanks += 1
                continue
            key = word if blanks == 1 else MARK * blanks + word
            got = known.get(key)
            if got is None:
                got = known[key] = self.count_marked(MARK + word if blanks == 1 else key)
            total += got
            blanks = 1
        return total + (self.count_marked(MARK * (blanks - 1)) if blanks > 1 else 0)


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


_counters: dict[str, UnigramCounter] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of each row's whole text; a null or empty text has 0. Repeated rows and null doc_ids give a row each; other columns are left out."""

    def run(batches):
        if path not in _counters:
            _counters[path] = UnigramCounter(load_vocabulary(path))
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_counters[path].count(t or "") for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long")
