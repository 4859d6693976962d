"""Removal of repeated passages by run-length indexes.

A byte goes if it lies in a string of MATCH bytes that also starts in a document
with a smaller id. The corpus is not indexed in one piece:

1. Every window of MATCH bytes has a key, the least hash of the SEED-byte strings in
   it. Equal windows have equal keys, and consecutive windows with one key form a
   stretch. Keys alone are dealt first; those in one document only have no match.
2. Stretches whose key other documents have too are cut out with all bytes of
   their windows, and dealt by key. Equal stretches are told by their hashes and
   go once, for the least document; the others' windows all have a match.
3. Each receiving task builds run-length Burrows-Wheeler indexes over its distinct
   stretches, with samples at the starts and ends of runs, streams the stretches through
   as patterns, and marks every window whose matching statistic reaches MATCH in
   a class of rows that has an earlier document. So the index finds all matches but
   those of whole stretches, and those of the hot keys below.
4. The marked spans meet the texts again by document.

A key of more than HOT_STRETCHES stretches, copies included, is hot: the tasks that count it in step 1
name it to all tasks that cut, and these deal the windows of its stretches by the windows' hashes
instead, once for the least document of each. So a group of step 3 has a bound, and a window's
group has the entries of one document from each cutting task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_slices
from .dealing import bucket_count, dealt, from_planes, mixed, planes, runs_of, runs_of_two

#: Bytes of a match, and of the strings whose hashes are window keys.
MATCH, SEED = 50, 20
#: A stretch is cut after so many windows (long runs of one byte have one key).
STRETCH = 1024
#: Bytes of stretches in one index.
INDEX_BYTES = 1 << 20
#: Stretches of a key that still meet in one task.
HOT_STRETCHES = 1 << 13


def words_at(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; bytes past the end are 0."""
    raw = a.tobytes() + b"\0" * 16
    out = np.empty(len(a) + 8, np.uint64)
    for o in range(8):
        m = len(out[o::8])
        out[o::8] = np.frombuffer(raw, "<u8", count=min(m, (len(raw) - o) // 8), offset=o)[:m]
    return out


def window_keys(words: np.ndarray, size: int, match: int = MATCH, seed: int = SEED) -> np.ndarray:
    """For each window of ``match`` of the ``size`` bytes the least hash of the ``seed``-byte strings in it."""
    n = size - seed + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for at in [*range(8, seed - 8, 8), seed - 8]:
        h += words[at : at + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    width, step = match - seed + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def string_hashes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings of at least eight bytes that lie at starts in the bytes behind ``words``."""
    h = words[starts + sizes - 8] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = np.arange(len(starts))
    for j in range(int((sizes.max() - 1) // 8) if len(sizes) else 0):
        rows = rows[sizes[rows] > 8 * j + 8]
        h[rows] = mixed(h[rows] + words[starts[rows] + 8 * j])
    return mixed(h)


def stretches(raw: list[bytes], match: int = MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, text number, first window and number of windows of each stretch of the texts; then the words_at() of their joined bytes, and where each text starts there."""
    sizes = np.array([len(r) for r in raw], np.int64)
    a = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words = words_at(a)
    none = np.zeros(0, np.int64)
    if len(a) < match:
        return np.zeros(0, np.uint64), none, none, none, words, starts
    keys = window_keys(words, len(a), match)
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    new[starts[starts < len(keys)]] = True
    over = np.maximum(ends - match + 1, starts)  # from here on windows reach over the text's end
    new[over[over < len(keys)]] = True
    first = np.nonzero(new)[0]
    length = np.diff(np.append(first, len(keys)))
    text = np.searchsorted(starts, first, "right") - 1
    good = first < over[text]
    first, length, text = first[good], length[good], text[good]
    key = keys[first]
    if len(length) and length.max() > STRETCH:
        parts = -(-length // STRETCH)
        owner = np.repeat(np.arange(len(first)), parts)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        key, text, first, length = key[owner], text[owner], first[owner] + turn * STRETCH, np.minimum(length[owner] - turn * STRETCH, STRETCH)
    return key, text, first - starts[text], length, words, starts


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of strings, with the text places of its runs' starts and ends as samples.

    Suffixes are sorted whole, equal ones in the order of the strings. Rows that agree
    in their first ``match`` bytes form a class; its first row is kept with the least
    rank of a string that has those bytes.
    """

    def __init__(self, strings: list[bytes], ranks: np.ndarray, match: int):
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        ends = np.cumsum(sizes) - 1
        # Symbols are bytes + 1; 0 ends a string.
        text = raw.astype(np.int16) + np.int16(1)
        text[ends] = 0
        self.match, self.n, self.words = match, len(text), words_at(raw)
        self.left = (np.repeat(ends, sizes) - np.arange(self.n)).astype(np.int32)  # bytes up to the string's end
        order, self.class_start = self._sorted_suffixes(text, self.left, match)
        owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
        self.class_rank = np.minimum.reduceat(ranks[owner[order]], self.class_start)
        before = text[order - 1]
        cut = np.append(True, before[1:] != before[:-1])
        self.run_start = np.nonzero(cut)[0]
        run_end = np.append(self.run_start[1:], self.n) - 1
        self.run_symbol = before[self.run_start].astype(np.int64)
        self.sample_start, self.sample_end = order[self.run_start].astype(np.int64), order[run_end].astype(np.int64)
        # Where the rows before the run's symbol at its start lead: the place of that symbol among all, in sorted order.
        length = run_end - self.run_start + 1
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        self.leads = np.empty(len(length), np.int64)
        self.leads[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]
        self.look = self.run_symbol[by_symbol] * len(length) + by_symbol  # runs by symbol, then place
        self.by_symbol = by_symbol

    @staticmethod
    def _sorted_suffixes(text: np.ndarray, left: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all suffixes in order, and the first row of each class of rows that agree in ``match`` symbols, by doubling."""
        n, width = len(text), min(7, match)
        padded = np.append(text, np.zeros(width, text.dtype))
        packed = np.zeros(n, np.int64)
        for o in range(width):
            packed = (packed << 9) | np.where(left >= o, padded[o : o + n], 0)
        order = np.argsort(packed, kind="stable").astype(np.int32)
        packed = packed[order]
        head = np.append(True, packed[1:] != packed[:-1])
        del packed, padded
        # A suffix's rank is the first row of those that agree with it so far.
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        longest, classes = int(left.max()) + 1, None
        while True:
            if width == match:
                classes = np.nonzero(head)[0]
            tied = np.nonzero(~(head & np.append(head[1:], True)))[0]
            if width >= max(longest, match) or (not len(tied) and classes is not None):
                break
            step = match - width if width < match < 2 * width else width
            rows = order[tied]
            follow = np.where(left[rows] >= step, rank[np.minimum(rows + np.int64(step), n - 1)] + np.int64(1), 0)
            both = rank[rows] * np.int64(n + 1) + follow
            turn = np.argsort(both, kind="stable")
            both = both[turn]
            order[tied] = rows[turn]
            new = np.append(True, both[1:] != both[:-1]) if len(both) else np.zeros(0, bool)
            head[tied] |= new
            rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
            width += step
        if len(tied):  # equal to their ends: in the order of their strings
            rows = order[tied]
            order[tied] = rows[np.lexsort((rows, rank[rows]))]
        return order, classes

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes in which the suffixes at two places agree, up to ``match``."""
        most = np.minimum(np.minimum(self.left[a], self.left[b]), self.match)
        found = np.zeros(len(a), np.int64)
        rows = np.arange(len(a))
        for at in range(0, self.match, 8):
            apart = self.words[a[rows] + at] ^ self.words[b[rows] + at]
            same = (apart == 0).astype(np.int64)
            for k in range(1, 8):
                same += apart & np.uint64((1 << (8 * k)) - 1) == 0
            found[rows] += same
            rows = rows[(apart == 0) & (most[rows] > at + 8)]
            if not len(rows):
                break
        return np.minimum(found, most)

    def matching(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stream strings backwards, all at once: for each place of patterns (a matrix of symbols, padded at the left) its matching statistic,
        the length up to ``match`` of the longest string from there on that the index has, and the least rank that has it where ``match`` is reached (else -1).

        A state is a row that agrees with what was read in that length. If the row isn't preceded by the next symbol,
        the nearest rows before and after it that are end and start runs of the symbol; the one that agrees with the row in more bytes goes on.
        """
        m, wide = patterns.shape
        length, found = np.zeros((m, wide), np.int16), np.full((m, wide), -1, np.int64)
        row, place, size = np.zeros(m, np.int64), np.full(m, self.sample_start[0]), np.zeros(m, np.int64)
        runs = len(self.run_start)
        for back in range(wide):
            col = wide - 1 - back
            live = np.nonzero(sizes > back)[0]
            symbol = patterns[live, col].astype(np.int64)
            q, p, l = row[live], place[live], size[live]  # noqa: E741
            run = np.searchsorted(self.run_start, q, "right") - 1
            miss = np.nonzero(self.run_symbol[run] != symbol)[0]
            if len(miss):
                c, at = symbol[miss], np.searchsorted(self.look, symbol[miss] * runs + run[miss])
                low, high = self.by_symbol[np.maximum(at - 1, 0)], self.by_symbol[np.minimum(at, runs - 1)]
                below, above = (at > 0) & (self.run_symbol[low] == c), (at < runs) & (self.run_symbol[high] == c)
                p_low, p_high = self.sample_end[low], self.sample_start[high]
                n_low, n_high = np.where(below, self._common(p[miss], p_low), -1), np.where(above, self._common(p[miss], p_high), -1)
                up = n_high > n_low
                run[miss] = np.where(up, high, low)
                q[miss] = np.where(up, self.run_start[high], self.run_start[low] + self._length(low) - 1)
                p[miss] = np.where(up, p_high, p_low)
                l[miss] = np.minimum(l[miss], np.maximum(n_low, n_high))
            q = self.leads[run] + q - self.run_start[run]
            p, l = p - 1, np.minimum(l + 1, self.match)  # noqa: E741
            nowhere = l == 0  # the index doesn't have the symbol
            q[nowhere], p[nowhere] = 0, self.sample_start[0]
            row[live], place[live], size[live], length[live, col] = q, p, l, l
            whole = np.nonzero(l == self.match)[0]
            found[live[whole], col] = self.class_rank[np.searchsorted(self.class_start, q[whole], "right") - 1]
        return length, found

    def _length(self, run: np.ndarray) -> np.ndarray:
        return np.append(self.run_start, self.n)[run + 1] - self.run_start[run]


def earlier_windows(strings: list[bytes], ranks: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """String number and window number, in this order, of the windows that a string of lesser rank has too. Strings are distinct; equal ranks don't count as lesser.

    Strings beyond INDEX_BYTES go into several indexes in the order of their ranks, and each index is streamed by its own and all later strings.
    """
    order = np.argsort(ranks, kind="stable")
    sizes = np.array([len(s) for s in strings], np.int64)
    block = (np.cumsum(sizes[order] + 1) - 1) // INDEX_BYTES
    heads = np.append(np.nonzero(np.append(True, block[1:] != block[:-1]))[0], len(order))
    which, windows = [], []
    for first, last in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        index = RunLengthIndex([strings[i] for i in order[first:last].tolist()], ranks[order[first:last]], match)
        by_size = order[first:][np.argsort(sizes[order[first:]], kind="stable")]
        upto, at = sizes[by_size], 0
        while at < len(by_size):  # strings of like size side by side
            limit = max(int(upto[at]) * 5 // 4, int(upto[at]) + 8)
            end = min(max(int(np.searchsorted(upto, limit, "right")), at + 1), at + max(1, (1 << 19) // limit))
            rows, wide = by_size[at:end], int(upto[end - 1])
            joined = np.frombuffer(b"".join([strings[i].rjust(wide, b"\0") for i in rows.tolist()]), np.uint8)
            found = index.matching(joined.reshape(len(rows), wide).astype(np.int16) + np.int16(1), upto[at:end])[1]
            k, col = np.nonzero((found >= 0) & (found < ranks[rows][:, None]))
            which.append(rows[k])
            windows.append(col - (wide - upto[at:end][k]))
            at = end
        del index
    which, windows = np.concatenate(which), np.concatenate(windows)
    turn = np.lexsort((windows, which))
    which, windows = which[turn], windows[turn]
    if len(heads) > 2 and len(which):  # several indexes may name one window
        new = np.append(True, (which[1:] != which[:-1]) | (windows[1:] != windows[:-1]))
        which, windows = which[new], windows[new]
    return which, windows


def text_check(data: bytes) -> int:
    """Tells texts that share a doc_id apart."""
    return zlib.crc32(data)


CUT_SCHEMA = "bucket int, kind int, keys binary, docs binary, places binary, checks binary, sizes binary, strings binary"
#: kinds: an entry of a key; a stretch that others may share; a stretch to index; a span to remove; hot keys; windows of hot keys.
ENTRY, SHARED, STRING, SPAN, HOT, WINDOW = 0, 1, 2, 3, 4, 5
#: The place of an entry for several documents is this and its number of stretches.
SEVERAL = 1 << 31
ENTRY_BITS = np.uint64((1 << 48) - 1)


def _row(bucket: int, kind: int, keys, docs, places, checks=None, sizes=None, strings: bytes = b"") -> tuple:
    """keys: whole, or of ENTRY rows their lower 48 bits, which are enough to tell what may be shared."""
    if keys is None:
        packed = b""
    elif kind == ENTRY:
        packed = keys.astype("<u4").tobytes() + (keys >> np.uint64(32)).astype("<u2").tobytes()
    else:
        packed = keys.astype("<u8").tobytes()
    checked = np.ascontiguousarray(checks).astype("<u4").tobytes() if checks is not None else b""
    return bucket, kind, packed, planes(np.diff(docs, prepend=0)), planes(places), checked, planes(sizes) if sizes is not None else b"", pa.compress(strings, "zstd", asbytes=True) if strings else b""


def _entry_keys(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    columns = zip(*rows, strict=True) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CUT_SCHEMA.split(", ")])


def _by_bucket(bucket: np.ndarray):
    """(bucket, positions) of each bucket."""
    order = np.argsort(bucket, kind="stable")
    starts, ends = runs_of(bucket[order])
    for a, b in zip(starts, ends, strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _to_documents(kind: int, docs: np.ndarray, places: np.ndarray, checks: np.ndarray | None, buckets: int) -> list[tuple]:
    """Rows for the buckets of documents."""
    order = np.lexsort((places, docs))
    docs, places, checks = docs[order], places[order], checks[order] if checks is not None else None
    return [_row(b, kind, None, docs[at], places[at], checks[at] if checks is not None else None) for b, at in _by_bucket(np.mod(docs, buckets))]


def _columns(table) -> dict[str, list]:
    return {c: table.column(i).to_pylist() for i, c in enumerate(table.schema.names)}


def _span(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return start * (2 * STRETCH) + windows


def windows_of(strings: list[bytes], match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String number, window number and hash of each window of the strings."""
    sizes = np.array([len(s) for s in strings], np.int64)
    counts = sizes - match + 1
    owner = np.repeat(np.arange(len(strings)), counts)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, window, string_hashes(words_at(np.frombuffer(b"".join(strings), np.uint8)), (np.cumsum(sizes) - sizes)[owner] + window, np.full(len(owner), match))


def not_least(hashed: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which entries have a hash that a lesser document has too."""
    order = np.lexsort((docs, hashed))
    starts, ends = runs_of(hashed[order])
    later = np.zeros(len(docs), bool)
    later[order] = docs[order] != np.repeat(docs[order][starts], ends - starts)
    return later


def widened(raw: bytes, begin: int, stop: int) -> tuple[int, int]:
    """A span of bytes of UTF-8 with the whole of the characters at its edges."""
    while begin > 0 and begin < len(raw) and raw[begin] & 0xC0 == 0x80:
        begin -= 1
    while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
        stop += 1
    return begin, stop


def remove_repeats(docs: DataFrame, match: int = MATCH, carry: tuple[str, ...] = (), hot_stretches: int = HOT_STRETCHES, characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and the columns named in carry of each row of docs.

    Texts are their UTF-8 bytes, whole; a null text is empty. Strings are judged
    on the input, within a document. Rows of equal doc_id aren't earlier than each other. A
    null doc_id is neither earlier nor later than any, so its row keeps all. Other columns
    are left out. No rows give no rows. With ``characters`` a character of which some bytes
    go goes whole, so that kept is UTF-8 again.
    """
    # So many buckets that one's texts and entries fit a worker, whatever the input's size.
    buckets = bucket_count(docs.sparkSession, docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    rows = docs.selectExpr(f"cast(coalesce(pmod(cast(doc_id as long), {buckets}), 0) as int) bucket", "cast(doc_id as long) doc_id", "cast(text as string) text", *[f"`{c}`" for c in carry])

    def send(batches):
        for batch in in_slices(batches, most_bytes=8 << 20, most_rows=1 << 16):
            keys, owners, turns = [], [], []
            for part in in_slices([batch], most_bytes=1 << 20):
                ids = part.column(1).to_pylist()
                key, text, *_ = stretches([(t or "").encode("utf-8", "replace") if i is not None else b"" for i, t in zip(ids, part.column(2).to_pylist(), strict=True)], match)
                keys.append(key)
                owners.append(np.array([i or 0 for i in ids], np.int64)[text])
                turns.append(np.arange(len(text)) - np.searchsorted(text, text))
            key, doc, turn = np.concatenate(keys) & ENTRY_BITS, np.concatenate(owners), np.concatenate(turns) + 1
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, doc, turn = key[order], doc[order], turn[order]
            starts, ends = runs_of(key)
            common = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            # A key of several documents here is known to be shared; the others need one entry, with the number of stretches.
            own = np.repeat(~common, ends - starts)
            out = _to_documents(SHARED, doc[~own], turn[~own], None, buckets) if not own.all() else []
            key, doc, turn = np.concatenate([key[own], key[starts[common]]]), np.concatenate([doc[own], doc[starts[common]]]), np.concatenate([turn[own], SEVERAL + (ends - starts)[common]])
            order = np.lexsort((turn, doc))
            key, doc, turn = key[order], doc[order], turn[order]
            out += [_row(b, ENTRY, key[at], doc[at], turn[at]) for b, at in _by_bucket((mixed(key) % np.uint64(buckets)).astype(np.int64))]
            yield _batch(out)

    def meet(batches):
        keys, owners, turns = [], [], []
        for batch in batches:
            known = batch.filter(pa.array(np.array(batch.column(1).to_pylist()) == SHARED))
            if known.num_rows:
                yield known
            c = _columns(batch)
            for kind, k, d, p in zip(c["kind"], c["keys"], c["docs"], c["places"], strict=True):
                if kind == ENTRY:
                    keys.append(_entry_keys(k))
                    owners.append(np.cumsum(from_planes(d)))
                    turns.append(from_planes(p))
        if not keys:
            return
        key, doc, turn = np.concatenate(keys), np.concatenate(owners), np.concatenate(turns)
        order = np.argsort(key)
        starts, ends = runs_of(key[order])
        d, t = doc[order], turn[order]
        met = (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)) | (np.maximum.reduceat(t, starts) >= SEVERAL)
        shared = np.repeat(met, ends - starts) & (t < SEVERAL)
        hot = key[order][starts][met & (np.add.reduceat(np.where(t < SEVERAL, 1, t - SEVERAL), starts) > hot_stretches)]
        none = np.zeros(0, np.int64)
        yield _batch(_to_documents(SHARED, d[shared], t[shared], None, buckets) + [_row(b, HOT, hot, none, none) for b in range(buckets) if len(hot)])

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        c = _columns(found)
        turns: dict[int, list[np.ndarray]] = {}
        hot = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(k, "<u8") for kind, k in zip(c["kind"], c["keys"], strict=True) if kind == HOT]])
        for kind, d, p in zip(c["kind"], c["docs"], c["places"], strict=True):
            if kind == HOT:
                continue
            d, p = np.cumsum(from_planes(d)), from_planes(p) - 1
            starts, ends = runs_of(d)
            for a, b in zip(starts, ends, strict=True):
                turns.setdefault(int(d[a]), []).append(p[a:b])
        pairs = [(i, (t or "").encode("utf-8", "replace")) for i, t in zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True) if i in turns]
        columns, strings, at = [], [], 0
        while at < len(pairs):
            held, end = 0, at
            while end < len(pairs) and (end == at or held + len(pairs[end][1]) <= 1 << 20):
                held += len(pairs[end][1])
                end += 1
            raw = [r for _, r in pairs[at:end]]
            key, text, first, length, words, starts = stretches(raw, match)
            cuts = np.searchsorted(text, np.arange(len(raw) + 1))
            picks = []
            for j in range(len(raw)):
                own = np.unique(np.concatenate(turns[pairs[at + j][0]]))
                picks.append(own[own < cuts[j + 1] - cuts[j]] + cuts[j])
            picks = np.concatenate(picks)
            key, text, first, length = key[picks], text[picks], first[picks], length[picks]
            hashed = string_hashes(words, starts[text] + first, length + match - 1)
            docs_, checks = np.array([i for i, _ in pairs[at:end]], np.int64), np.array([text_check(r) for r in raw], np.int64)
            columns.append((key, docs_[text], _span(first, length), checks[text], hashed, length + match - 1))
            strings += [raw[t][f : f + n] for t, f, n in zip(text.tolist(), first.tolist(), (length + match - 1).tolist(), strict=True)]
            at = end
        if not strings:
            return pa.Table.from_batches([_batch([])])
        key, doc, place, check, hashed, size = (np.concatenate(c) for c in zip(*columns, strict=True))
        # Of equal strings those of the least document are sent; a match of the others is known.
        order = np.lexsort((place, doc, hashed, key))
        heads, stops = runs_of_two(key[order], hashed[order])
        least = np.repeat(doc[order][heads], stops - heads)
        later = order[doc[order] != least]
        out = _to_documents(SPAN, doc[later], place[later], check[later], buckets)
        own = order[doc[order] == least]
        own = own[np.lexsort((place[own], doc[own]))]
        if len(hot):
            by_window = np.isin(key[own] & ENTRY_BITS, hot)
            out += deal_windows(own[by_window], strings, doc, place, check)
            own = own[~by_window]
        for b, at_ in _by_bucket((mixed(key[own]) % np.uint64(buckets)).astype(np.int64)):
            at_ = own[at_]
            out.append(_row(b, STRING, key[at_], doc[at_], place[at_], check[at_], size[at_], b"".join([strings[i] for i in at_.tolist()])))
        return pa.Table.from_batches([_batch(out)])

    def deal_windows(rows: np.ndarray, strings: list[bytes], doc: np.ndarray, place: np.ndarray, check: np.ndarray) -> list[tuple]:
        """Rows for the windows of the strings with these numbers: to their hash's bucket for the least document here, to be removed for the others."""
        parts = []
        for a in range(0, len(rows), 1 << 12):
            some = rows[a : a + (1 << 12)]
            owner, window, hashed = windows_of([strings[i] for i in some.tolist()], match)
            parts.append((some[owner].astype(np.int32), window.astype(np.int16), hashed))
        if not parts:
            return []
        owner, window, hashed = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        later = not_least(hashed, doc[owner])
        # Windows side by side in a stretch go as one span.
        o, w = owner[later], window[later]
        cut = np.nonzero(np.append(True, (o[1:] != o[:-1]) | (w[1:] != w[:-1] + 1)))[0][: len(o)]
        out = _to_documents(SPAN, doc[o[cut]], _span(place[o[cut]] // (2 * STRETCH) + w[cut], np.diff(np.append(cut, len(o)))), check[o[cut]], buckets)
        owner, window, hashed = owner[~later], window[~later], hashed[~later]
        for b, at in _by_bucket((mixed(hashed) % np.uint64(buckets)).astype(np.int64)):
            o = owner[at]
            out.append(_row(b, WINDOW, hashed[at], doc[o], place[o] // (2 * STRETCH) + window[at], check[o]))
        return out

    def index(batches):
        columns, blobs, windows = [], [], []
        for batch in batches:
            spans = batch.filter(pa.array(np.array(batch.column(1).to_pylist()) == SPAN))
            if spans.num_rows:
                yield spans
            c = _columns(batch)
            for kind, k, d, p, h, z, s in zip(*(c[x] for x in ("kind", "keys", "docs", "places", "checks", "sizes", "strings")), strict=True):
                if kind == STRING:
                    size = from_planes(z)
                    columns.append((np.frombuffer(k, "<u8"), np.cumsum(from_planes(d)), from_planes(p), np.frombuffer(h, "<u4").astype(np.int64), size))
                    blobs.append(pa.decompress(s, int(size.sum()), "zstd", asbytes=True))
                elif kind == WINDOW:
                    windows.append((np.frombuffer(k, "<u8"), np.cumsum(from_planes(d)), from_planes(p), np.frombuffer(h, "<u4")))
        if windows:
            hashed, doc, place, check = (np.concatenate(x) for x in zip(*windows, strict=True))
            later = not_least(hashed, doc)
            if later.any():
                yield _batch(_to_documents(SPAN, doc[later], _span(place[later], np.ones(int(later.sum()), np.int64)), check[later], buckets))
            del windows, hashed, doc, place, check, later
        if not columns:
            return
        key, doc, place, check, size = (np.concatenate(c) for c in zip(*columns, strict=True))
        blob = b"".join(blobs)
        start = np.cumsum(size) - size
        hashed = np.concatenate([string_hashes(words_at(np.frombuffer(b, np.uint8)), np.cumsum(c[4]) - c[4], c[4]) for b, c in zip(blobs, columns, strict=True)])
        del blobs, columns
        order = np.lexsort((place, doc, hashed, key))
        heads, stops = runs_of_two(key[order], hashed[order])
        least = doc[order][heads]
        group = np.repeat(np.arange(len(heads)), stops - heads)
        first = doc[order] == least[group]
        later = order[~first]  # copies of an earlier document's stretch
        found = [(doc[later], place[later], check[later])]
        # Rows of the least document of each string, group by group.
        own, own_group = order[first], group[first]
        own_at = np.searchsorted(own_group, np.arange(len(heads) + 1))
        # A string that is alone under its key matches nothing but its copies.
        key_heads, key_stops = runs_of(key[order][heads])
        several = np.nonzero(key_stops - key_heads > 1)[0]
        sizes_of = size[order[heads]]
        strings, groups, held = [], [], 0

        def search() -> None:
            which, window = earlier_windows(strings, least[np.array(groups)], match)
            if not len(which):
                return
            cut = np.nonzero(np.append(True, (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)))[0]
            g, begin, n = np.array(groups)[which[cut]], window[cut], np.diff(np.append(cut, len(which)))
            times = own_at[g + 1] - own_at[g]
            rows = own[np.repeat(own_at[g], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            found.append((doc[rows], _span(place[rows] // (2 * STRETCH) + np.repeat(begin, times), np.repeat(n, times)), check[rows]))

        for k in several.tolist():
            a, b = int(key_heads[k]), int(key_stops[k])
            total = int(sizes_of[a:b].sum())
            if strings and held + total > INDEX_BYTES:
                search()
                strings, groups, held = [], [], 0
            for g in range(a, b):
                i = order[heads[g]]
                strings.append(blob[start[i] : start[i] + size[i]])
                groups.append(g)
            held += total
        if strings:
            search()
        docs_, places, checks = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(docs_):
            yield _batch(_to_documents(SPAN, docs_, places, checks, buckets))
        del key, doc, place, check, size, blob, hashed, order, strings, found
        give_back()

    def keep(texts: pa.Table, found: pa.Table) -> pa.Table:
        c = _columns(found)
        spans: dict[tuple[int, int], list] = {}
        for d, p, h in zip(c["docs"], c["places"], c["checks"], strict=True):
            for doc, place, check in zip(np.cumsum(from_planes(d)).tolist(), from_planes(p).tolist(), np.frombuffer(h, "<u4").tolist(), strict=True):
                spans.setdefault((doc, check), []).append((place // (2 * STRETCH), place % (2 * STRETCH)))
        marked = {d for d, _ in spans}
        out = []
        for doc, t in zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True):
            raw = (t or "").encode("utf-8", "replace")
            own = sorted(spans.get((doc, text_check(raw)), ())) if doc in marked else []
            parts, at, n = [], 0, 0
            begin = stop = None
            for f, windows in [*own, (None, None)]:
                if stop is not None and (f is None or f > stop):
                    if characters:
                        begin, stop = widened(raw, begin, stop)
                    parts.append(raw[at:begin])
                    at, n, stop = stop, n + 1, None
                if f is not None:
                    begin, stop = (f, f + windows + match - 1) if stop is None else (begin, max(stop, f + windows + match - 1))
            kept = b"".join([*parts, raw[at:]])
            out.append((doc, len(raw), len(raw) - len(kept), n, kept))
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.table([*[pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], *[texts.column(c) for c in carry]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry])

    shared = dealt(rows.mapInArrow(send, CUT_SCHEMA), buckets).mapInArrow(meet, CUT_SCHEMA)
    by_bucket = rows.repartition(buckets, "bucket").groupBy("bucket")
    strings = by_bucket.cogroup(shared.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(cut, CUT_SCHEMA)
    spans = dealt(strings, buckets).mapInArrow(index, CUT_SCHEMA)
    return by_bucket.cogroup(spans.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(
        keep, ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry]])
    )


def without_repeats(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """The rows and columns of docs with repeated passages cut from text.

    A character of which some bytes are cut goes whole. A null text becomes an
    empty one; n_chars, if there, is counted anew. Other columns stay as they are, whatever their names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    inside = tuple(f"_carried_{i}" for i in range(len(others)))
    kept = remove_repeats(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in zip(others, inside, strict=True)]), match, inside, characters=True)
    text = F.decode("kept", "UTF-8")
    back = {"doc_id": F.col("doc_id"), "text": text, **{c: F.col(x) for c, x in zip(others, inside, strict=True)}}
    if "n_chars" in back:
        back["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[back[c].alias(c) for c in docs.columns])
