"""Alignment of two tokenizers' tokens of the same text, by diagonal run skipping.

Tokens are told by the byte offsets at which they end. Where both tokenizers cut
alike, end i of the one is end i + shift of the other: exponential probing
compares stretches of both end arrays at the current shift and jumps over them, a
group of one token each for every end. Where the ends differ, the shorter side
catches up until both end together; that irregular group changes the shift. The
slice of texts that a task works on is one pair of end arrays, as each text's end is
an end of both.

Two tokens are linked where their byte ranges overlap. How often a pair of ids is
linked in the corpus is counted on the pairs that each text has, with their numbers.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_BROADCAST, give_back, in_slices, written
from .packing import Encoder, _byte_of

#: A SentencePiece file's mark for a blank (fixed value).
MARK = "▁"
#: Bits for an id in the code of a pair.
ID_BITS = 24
#: A pair with at least this share of all links is frequent: at most so many pairs are.
MOST_FREQUENT = 100_000


class ByteTokens:
    """Ids of texts by a byte-level BPE file; ``tokens`` are their bytes. Strings of special tokens are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        ranks = Encoder._ranks(spec)
        if ranks is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self._encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import public_tokenizers
            import tiktoken

            run = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._encode = lambda texts: list(map(run, texts))
        self.cuts = ranks is not None  # then tokens are stretches of the text itself: if their lengths make up its length, they are its bytes

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """Ids of a blank and each text; None if their bytes aren't these."""
        ids = self._encode([" " + t for t in texts])
        if self.cuts:
            return [x if sum(map(len, map(self.tokens.__getitem__, x))) == len(t.encode()) + 1 else None for x, t in zip(ids, texts, strict=True)]
        return [x if _joined(self.tokens, x) == b" " + t.encode() else None for x, t in zip(ids, texts, strict=True)]


def _joined(tokens: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


class PieceTokens:
    """Ids of texts by a SentencePiece file; ``tokens`` are their bytes: the mark is a blank, <0xHH> a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(MARK, " ").encode() for p in names]

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """Ids of each text, before which the model puts a blank; None if their bytes aren't a blank and the text."""
        return [x if _joined(self.tokens, x) == b" " + t.encode() else None for x, t in zip(self.model.encode(texts, num_threads=1), texts, strict=True)]


def irregular_groups(a: list[int], b: list[int]) -> tuple[np.ndarray, ...]:
    """First and end places in a and in b of the groups that aren't one token each; a and b are rising ends, the last ones equal."""
    found = []
    i = j = 0
    n = len(a)
    while i < n:
        step = 1
        while a[i : i + step] == b[j : j + step] and i < n:
            i += step
            j += step
            step += step
        while step > 1:
            step >>= 1
            if a[i : i + step] == b[j : j + step]:
                i += step
                j += step
        if i >= n:
            break
        i0, j0, x, y = i, j, a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        found += (i0, i, j0, j)
    return tuple(np.array(found, np.int64).reshape(-1, 4).T)


def _inside(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in the ranges, which don't meet."""
    change = np.zeros(n + 1, np.int64)
    change[first] += 1
    np.subtract.at(change, end, 1)
    return np.cumsum(change[:-1]) > 0


class Aligner:
    """Aligns slices of texts. ``groups`` asks for the groups' text beside its digest."""

    def __init__(self, path_a: str, path_b: str, groups: bool):
        self.a, self.b, self.groups = ByteTokens(path_a), PieceTokens(path_b), groups
        self.size_a, self.size_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        if max(len(self.a.tokens), len(self.b.tokens)) >= 1 << ID_BITS:
            raise ValueError("vocabulary too large")
        # An id with the sign that follows it: within its side, at the side's end.
        self.signs = [f"{i}{s}" for i in range(len(self.a.tokens)) for s in ",|"] + [f"{i}{s}" for i in range(len(self.b.tokens)) for s in ",;"]

    def align(self, texts: list[str]) -> dict[str, pa.Array]:
        shown = [k for k, t in enumerate(texts) if t]
        coded = zip(shown, *(side.encode([texts[k] for k in shown]) for side in (self.a, self.b)), strict=True)
        shown, ids_a, ids_b = [list(x) for x in zip(*(x for x in coded if x[1] and x[2]), strict=True)] or ([], [], [])
        n = len(texts)
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        text, digest = [""] * n, [""] * n
        codes, counts, starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        if shown:
            row = np.array(shown)
            number = [np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b)]
            a, b = (np.fromiter(chain.from_iterable(ids), np.int64, k.sum()) for ids, k in zip((ids_a, ids_b), number, strict=True))
            ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            a0, a1, b0, b1 = irregular_groups(ends_a.tolist(), ends_b.tolist())
            odd_a, odd_b = _inside(len(a), a0, a1), _inside(len(b), b0, b1)
            new_a, new_b = ~odd_a, ~odd_b  # where groups begin
            new_a[a0], new_b[b0] = True, True
            first_a, first_b = np.append(np.nonzero(new_a)[0], len(a)), np.append(np.nonzero(new_b)[0], len(b))
            group_a, group_b = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
            stop_a, stop_b = np.cumsum(number[0]), np.cumsum(number[1])

            # All ids as written: a group's ids of a, then those of b.
            signs = np.empty(len(a) + len(b), np.int64)
            signs[np.arange(len(a)) + first_b[group_a]] = 2 * a + np.append(new_a[1:], True)
            signs[np.arange(len(b)) + first_a[group_b + 1]] = 2 * (b + len(self.a.tokens)) + np.append(new_b[1:], True)
            at = 0
            for k, end in zip(shown, (stop_a + stop_b).tolist(), strict=True):
                joined = "".join(map(self.signs.__getitem__, signs[at:end].tolist()))[:-1]
                digest[k] = hashlib.sha256(joined.encode()).hexdigest()
                if self.groups:
                    text[k] = joined
                at = end
            del signs

            # A link ends at each end of either side; in an irregular group these are merged.
            ends = np.union1d(ends_a[odd_a], ends_b[odd_b])
            link_a = np.concatenate([np.nonzero(~odd_a)[0], np.searchsorted(ends_a, ends)])
            link_b = np.concatenate([np.nonzero(~odd_b)[0], np.searchsorted(ends_b, ends)])
            doc = np.searchsorted(stop_a, link_a, "right")
            keys, counts = np.unique(doc << (2 * ID_BITS) | a[link_a] << ID_BITS | b[link_b], return_counts=True)
            codes = keys & ((1 << 2 * ID_BITS) - 1)
            starts[1:] = np.cumsum(np.bincount(row[keys >> (2 * ID_BITS)], minlength=n))
            out["n_a"][row], out["n_b"][row] = number
            out["n_groups"][row] = np.bincount(np.searchsorted(stop_a, first_a[:-1], "right"), minlength=len(row))
            out["n_links"][row] = np.bincount(doc, minlength=len(row))
        found = {k: pa.array(v) for k, v in out.items()} | {"groups_sha256": pa.array(digest, pa.string())}
        if self.groups:
            found["groups"] = pa.array(text, pa.string())
        offsets = pa.array(starts.astype(np.int32))
        return found | {"pairs": pa.ListArray.from_arrays(offsets, pa.array(codes)), "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))}


_aligners: dict[tuple, Aligner] = {}


def align_tokens(docs: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and counts (the text's pairs of linked ids as a << 24 | b, and how many links each has), and with ``groups`` the groups as a1,a2|b1;a3|b2,b3.

    Texts that are null or empty, or whose tokens' joined bytes aren't a blank and the
    text, have no tokens: zeros, empty strings, no pairs. Repeated rows and null
    doc_ids give a row each; other columns are left out; an empty table gives no row.
    """
    key = (path_a, path_b, groups)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + ", groups string" * groups + ", pairs array<long>, counts array<long>"

    def run(batches):
        if key not in _aligners:
            _aligners[key] = Aligner(*key)
        for batch in in_slices(batches, most_bytes=1 << 20):
            found = _aligners[key].align([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.values()], names=["doc_id", *found])
            del found
        give_back()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, total (links that hold it in all texts) and best (whether no pair of its b has more) of align_tokens()' rows."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = each.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << ID_BITS) - 1))
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def with_corpus_counts(aligned: DataFrame) -> DataFrame:
    """align_tokens()' rows without their pairs, with n_best (links whose pair is its b's most frequent in all texts, ties included) and count_sum (corpus counts summed over links).

    Corpus counts are broadcast if they are few; else those of frequent pairs, of which
    there can be at most MOST_FREQUENT, are, and the others meet in a shuffle.
    """
    kept = written(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    totals = written(pair_counts(kept), "pair-counts")
    each = kept.select("_row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    n_pairs, links = totals.agg(F.count("*"), F.sum("total")).first()
    if n_pairs <= MOST_BROADCAST:
        met = each.join(F.broadcast(totals), "pair")
    else:
        frequent = F.broadcast(totals.where(F.col("total") * MOST_FREQUENT >= links))
        rare = totals.where(F.col("total") * MOST_FREQUENT < links)
        met = each.join(frequent, "pair").unionByName(each.join(frequent.select("pair"), "pair", "left_anti").join(rare, "pair"))
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    return kept.drop("pairs", "counts").join(sums, "_row", "left").drop("_row").fillna(0, ["n_best", "count_sum"])
