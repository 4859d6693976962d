"""Best-fit packing by minimum bin slack.

Documents are cut to pieces of at most ``size`` tokens. Bins are filled on the
counts of the lengths 1 to ``size``, which are few whatever the input: a subset-sum
over the available lengths, kept as bits of one number for each length, finds the
fullest combination that holds the longest piece left, and it is taken out as often
as the counts allow. Pieces are then numbered within their length and looked up.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, in_slices, written

#: Pieces of one length are numbered in so many parts.
SALTS = 256
_tokenizers: dict = {}


def _byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable Latin-1 characters for themselves, the rest from code 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts by a tokenizer file.

    A plain byte-level BPE file whose ids follow the order of its merges is run by
    the tiktoken library on the file's own vocabulary, which gives the same ids
    in a fifth of the time; any other file by the tokenizers library. A string of the
    file's added tokens in a text is that token, as the tokenizers library has it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks, added = self._ranks(spec), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if ranks is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self._encode = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import public_tokenizers
            import tiktoken

            encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added).encode_to_numpy
            self._encode = lambda texts: [encode(t, allowed_special="all").astype("<u4").tobytes() for t in texts]

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            return None
        plain = model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        byte, vocab = _byte_of(), model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [vocab.get(a + b) for a, b in merges] != [256 + i for i in range(len(merges))]:
            return None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self._encode(texts)


def cut_pieces(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """doc_id, piece, start, length and ids of each piece of each row's tokens and end_id.

    A null or empty text is end_id alone. Only longer rows are cut; their first
    piece may be shorter, the others have ``size`` tokens. Repeated rows and null
    doc_ids give pieces each; other columns are left out.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        if path not in _tokenizers:
            _tokenizers[path] = Encoder(path)
            give_back()
        for batch in in_slices(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), _tokenizers[path].encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                starts = [0, *range((n - 1) % size + 1, n, size)]
                rows += [(doc, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths whose sum is the greatest that fits ``room``, longer lengths first, each at most as often as counted.

    Bit s of a number says that sum s can be reached; there is one number for
    each length and doubling of its count, so the choice can be read back.
    """
    bits, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            use = min(times, left)
            steps.append((bits, length, use))
            bits |= (bits << (length * use)) & mask
            left -= use
            times *= 2
        if bits >> room & 1:
            break
    total, chosen = bits.bit_length() - 1, []
    for before, length, use in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * use
            total -= length * use
    return chosen


def minimum_bin_slack(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins), which hold all counted pieces."""
    counts, bins = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = [longest, *fullest({k: v for k, v in counts.items() if v}, size - longest)]
        counts[longest] += 1
        own = {x: chosen.count(x) for x in set(chosen)}
        times = min(counts[x] // n for x, n in own.items())
        for x, n in own.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        bins.append((chosen, times))
    return bins


def places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first number of each run of its pieces, the sequence of that piece, and the offset of the run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...): each piece's sequence of at most ``size`` tokens and place.

    pieces must give the same rows each time it is read, such as a written table.
    The plan depends on the counts of the lengths alone; pieces of one length are
    numbered by SALTS parts, so no length gathers in one task. Equal pieces are
    interchangeable. No pieces, no sequences.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    # At most size * SALTS rows, a bound of the parameters.
    counts = {(r[0], r[1]): r[2] for r in salted.groupBy("length", "_salt").count().collect()}
    total: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for (length, salt), n in sorted(counts.items()):
        before[length, salt] = total.get(length, 0)
        total[length] = total.get(length, 0) + n
    plan = pieces.sparkSession.sparkContext.broadcast((before, places(minimum_bin_slack(total, size))))
    numbered = salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    names = pieces.columns

    def run(batches):
        first, runs = plan.value
        for batch in batches:
            at = {x: batch.schema.get_field_index(x) for x in ("length", "_salt", "_n")}
            sequence, offset = [], []
            for length, salt, n in zip(*[batch.column(i).to_pylist() for i in at.values()], strict=True):
                n += first[length, salt]
                starts, sequences, offsets = runs[length]
                i = int(np.searchsorted(starts, n, "right")) - 1
                sequence.append(int(sequences[i]) + n - int(starts[i]))
                offset.append(int(offsets[i]))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def with_crc(pieces: DataFrame) -> DataFrame:
    """ids replaced by ids_crc32, the unsigned CRC-32 of their little-endian bytes."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """Digest of the packing of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(with_crc(cut_pieces(docs, path, end_id, size)), "pieces"), size)


def fill(counts: dict[int, int], size: int) -> tuple[int, int]:
    """Bins that the plan takes, and the least that any packing could take."""
    return sum(n for _, n in minimum_bin_slack(counts, size)), -(-sum(k * v for k, v in counts.items()) // size)


