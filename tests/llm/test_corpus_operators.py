"""The corpus operators against brute force, round trips and libraries, on small tables."""

import base64
import binascii
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specseq.llm import bpe, html_text, jaccard, packing, quality, queries, repeats, shingles, tiff, token_counts, toxicity, warc
from specseq.llm.common import scratch_path

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, bucket int"


def documents(spark, texts, extra="x"):
    rows = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", len(t or ""), extra, 7) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "the", "of", "x", "naïve", "zeta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n // 3)]
    texts = []
    for i in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice(words) + str(rng.randrange(50))
        texts.append(" ".join(t))
    texts += [None, "", " \n\t ", "ONE two", "one TWO", "a" * 3000, "ab " * 500, "a b c d e\n" * 40, "☃" * 60]
    return list(enumerate(texts, 3))


EDGE = [(5, None), (6, ""), (7, "a"), (7, "a"), (None, "same words in here now and then"), (9, "same words in here now and then"), (10, "é" * 200)]


# 1 WARC
def test_warc(spark):
    pages = [(3, "u3", "same"), (1, "u\r\n1", "same"), (2, None, ""), (4, "u4", None), (5, "u5", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (1, "again", "same"), (None, "n", "same"), (None, "m", "alone")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, first_id string")
    path = scratch_path(spark, "test-warc")
    warc.write_warc(warc.mark_revisits(df), path)
    got = sorted((tuple(r) for r in warc.resolve_revisits(warc.read_warc(spark, path)).collect()), key=repr)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in pages:
        f = first.get(h or "")
        want.append((i, len((h or "").encode()), digest(h), "response" if f is None or i == f else "revisit", None if f is None or i == f else f))
    assert got == sorted(want, key=repr)
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, path).collect() if r.record_type == "response"}
    assert payloads[5] == b"a\r\n\r\nWARC/1.1\r\n\r\nb" and payloads[1] == b"same"
    small = warc.mark_revisits(df, min_bytes=5)
    assert {r.record_type for r in small.where("html = 'same'").collect()} == {"response"}
    assert warc.mark_revisits(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.walk(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


# 2 run-length index
def brute_repeats(rows, m):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - m + 1):
                first[b[p : p + m]] = min(i, first.get(b[p : p + m], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - m + 1):
            if i is not None and first.get(b[p : p + m], i) < i:
                gone[p : p + m] = b"\1" * m
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("match", [24, 50])
def test_repeats(spark, match):
    rows = some_texts() + EDGE
    got = repeats.remove_repeats(documents(spark, rows).repartition(5), match).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == brute_repeats(rows, match)


@pytest.mark.parametrize("hot", [0, 5])
def test_repeats_of_hot_keys(spark, hot):
    rows = some_texts() + EDGE
    got = repeats.remove_repeats(documents(spark, rows).repartition(5), 50, hot_stretches=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == brute_repeats(rows, 50)


def test_hot_key_spreads_over_tasks(spark, monkeypatch):
    """A phrase with the least hash of its windows among different words: its stretches don't meet in one task."""
    rng = random.Random(4)
    word = lambda: bytes(rng.choice(b"abcdefghij") for _ in range(60))
    least = lambda b: repeats.window_keys(repeats.words_at(np.frombuffer(b, np.uint8)), len(b), 20, 20)[0]
    phrase = min((word()[:20] for _ in range(20000)), key=least)
    texts = [(word() + phrase + word()).decode() for _ in range(400)]
    texts += [texts[0][5:-5], texts[7][:100]]
    seen = []
    real = repeats.dealt
    monkeypatch.setattr(repeats, "dealt", lambda df, n: seen.append(df) or real(df, n))
    got = repeats.remove_repeats(documents(spark, list(enumerate(texts))), 50, hot_stretches=100).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == brute_repeats(list(enumerate(texts)), 50)
    sent = Counter()
    for r in seen[1].where(f"kind in ({repeats.STRING}, {repeats.WINDOW})").collect():
        sent[r.bucket] += len(r.keys) // 8
    assert len(sent) == repeats.bucket_count(spark) and max(sent.values()) < 2 * sum(sent.values()) / len(sent)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(documents(spark, some_texts()).limit(0)).count() == 0
    cut = repeats.without_repeats(documents(spark, some_texts()))
    assert cut.columns == documents(spark, []).columns and cut.count() == len(some_texts())


def test_repeats_keep_other_columns_and_whole_characters(spark):
    shared = "né à ☃ " * 12
    rows = [(1, "é" + shared, 1, "k1"), (2, "ê" + shared + "é!", 2, "k2"), (3, None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, kept string").selectExpr("*", "bucket as n_removed", "kept as `n.bytes`", "3 as n_chars")
    got = {r[0]: r for r in repeats.without_repeats(docs).collect()}
    assert got[2].text == "ê" + "é!" and got[1].text == "é" + shared and got[3].text == ""
    assert [(r.bucket, r.kept, r.n_removed, r["n.bytes"]) for _, r in sorted(got.items())] == [(1, "k1", 1, "k1"), (2, "k2", 2, "k2"), (3, None, 3, None)]
    assert [r.n_chars for _, r in sorted(got.items())] == [len("é" + shared), 3, 0]
    assert repeats.widened("aéb".encode(), 2, 3) == (1, 3) and repeats.widened("aéb".encode(), 0, 2) == (0, 3)


def test_index_against_all_windows(monkeypatch):
    rng = random.Random(7)
    for trial in range(60):
        m, letters = rng.choice([2, 5, 9, 50]), rng.choice([b"ab", b"abcd", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(250))
        strings = set()
        for _ in range(rng.randint(1, 20)):
            a = rng.randrange(180)
            s = bytearray(base[a : a + m + rng.randrange(50)])
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = rng.choice(letters)
            strings.add(bytes(s))
        strings = [s for s in strings if len(s) >= m]
        if not strings:
            continue
        ranks = np.array([rng.randrange(8) for _ in strings])
        least = {}
        for s, r in zip(strings, ranks.tolist(), strict=True):
            for p in range(len(s) - m + 1):
                least[s[p : p + m]] = min(r, least.get(s[p : p + m], r))
        want = [(i, p) for i, s in enumerate(strings) for p in range(len(s) - m + 1) if least[s[p : p + m]] < ranks[i]]
        monkeypatch.setattr(repeats, "INDEX_BYTES", rng.choice([100, 400, 1 << 20]))
        which, window = repeats.earlier_windows(strings, ranks, m)
        assert list(zip(which.tolist(), window.tolist(), strict=True)) == want
        # Matching statistics of strings that the index may not have.
        known = strings[: len(strings) // 2 + 1]
        wide = max(map(len, strings))
        symbols = np.array([[0] * (wide - len(s)) + [c + 1 for c in s] for s in strings])
        lengths, _ = repeats.RunLengthIndex(known, ranks[: len(known)], m).matching(symbols, np.array([len(s) for s in strings]))
        for s, row in zip(strings, lengths.tolist(), strict=True):
            own = [max(k for k in range(min(m, len(s) - p) + 1) if any(s[p : p + k] in x for x in known)) for p in range(len(s))]
            assert row[wide - len(s) :] == own


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_the_index_decides(spark, monkeypatch, size):
    """An index that finds nothing, or all, changes the result, with one index as with several."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(9)) + base[rng.randrange(40) : 300 + rng.randrange(90)] + str(i)) for i in range(12)]
    monkeypatch.setattr(repeats, "INDEX_BYTES", size)
    taken = [r.n_removed for r in repeats.remove_repeats(documents(spark, rows).coalesce(1), 50).orderBy("doc_id").collect()]
    assert taken == [x[2] for x in sorted(brute_repeats(rows, 50))]
    strings, ranks = [t.encode() for _, t in rows], np.array([i for i, _ in rows])
    want = [x.tolist() for x in repeats.earlier_windows(strings, ranks, 50)]
    real = repeats.RunLengthIndex.matching
    for lie in (lambda *a: [real(*a)[0], real(*a)[1] * 0 - 1], lambda *a: [real(*a)[0], real(*a)[1] * 0]):
        monkeypatch.setattr(repeats.RunLengthIndex, "matching", lie)
        assert [x.tolist() for x in repeats.earlier_windows(strings, ranks, 50)] != want


# 3 TIFF
@pytest.mark.parametrize("how", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE_NEW, tiff.DEFLATE_OLD, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(how, predictor, tile):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 256, (37, 50), np.uint8), np.repeat(rng.integers(0, 3, (20, 7, 3), np.uint8), 5, axis=1), np.zeros((300, 64), np.uint8), np.tile(np.arange(256, dtype=np.uint8), (90, 4))]
    data = tiff.write_tiff(pages, how, predictor, 8, tile)
    for (image, name), page in zip(tiff.read_tiff(data), pages, strict=True):
        assert np.array_equal(image.reshape(page.shape), page) and name == tiff.NAMES[how]


def test_tiff_pages(spark):
    good = tiff.write_tiff([np.full((2, 3), 7, np.uint8), np.full((1, 1), 9, np.uint8)])
    df = spark.createDataFrame([(1, good, "k"), (2, None, "k"), (3, b"", "k"), (4, b"II*\0garbage", "k"), (5, good[:20], "k"), (None, good, None)], "doc_id long, media binary, page string")
    got = tiff.tiff_pages(df, "media", ["doc_id"]).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, None: 2}
    assert {r.doc_id for r in got if r.error} == {2, 3, 4, 5} and all((r.page == -1) == bool(r.error) for r in got)
    assert tiff.tiff_pages(df.limit(0), "media", ["doc_id"]).count() == 0 and tiff.media_digest(tiff.texts_as_tiff(documents(spark, []))).count() == 0
    rows = some_texts() + EDGE + [(77, "long " * 300_000)]
    out = tiff.media_digest(tiff.texts_as_tiff(documents(spark, rows))).collect()
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want


def test_broken_tiff_headers_give_rows():
    rng = random.Random(5)
    page = np.arange(60, dtype=np.uint8).reshape(6, 10)
    files = [tiff.write_tiff([page], how, predictor, 2, tile) for how in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE_NEW, tiff.PACKBITS) for predictor, tile in ((1, None), (2, (16, 16)), (3, None))]
    for _ in range(5000):
        data = bytearray(rng.choice(files))
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.choice([0, 1, 2, 3, 255, rng.randrange(256)])
        pages = list(tiff._pages_of(bytes(data)))
        assert pages or bytes(data[4:8]) == bytes(4)  # no directory, no page
        assert all(p[0] == -1 or len(p[6]) == p[1] * p[2] * p[3] * p[4] // 8 for p in pages)


# 4 quality
def test_base_statistics(spark):
    rows = some_texts() + EDGE + [(99, "a b c d e f a b c d e g\nx\n\nx\n#$ <x>")]
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)] += 1
    got = quality.base_statistics(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def brute_mcd(x, floors):
    med = np.array([np.sort(c)[int(np.ceil(0.5 * len(c))) - 1] for c in x.T], float)
    dev = np.array([np.sort(np.abs(c - m))[int(np.ceil(0.5 * len(c))) - 1] for c, m in zip(x.T, med, strict=True)])
    mean, cov = med, np.diag((1.4826 * dev) ** 2 + floors**2)
    d = len(floors)
    factor = quality.SUBSET / quality.chi2_cdf(quality.chi2_quantile(quality.SUBSET, d), d + 2)
    for _ in range(quality.C_STEPS):
        w = np.linalg.inv(np.linalg.cholesky(cov))
        bins = np.minimum(np.floor(np.log1p((((x - mean) @ w.T) ** 2).sum(1)) * quality.BINS), quality.MOST_BIN)
        chosen = x[bins <= np.sort(bins)[int(np.ceil(quality.SUBSET * len(x))) - 1]].astype(float)
        mean = chosen.mean(0)
        cov = (chosen.T @ chosen / len(chosen) - np.outer(mean, mean)) * factor + np.diag(floors**2)
    w = np.linalg.inv(np.linalg.cholesky(cov))
    return (((x - mean) @ w.T) ** 2).sum(1)


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.rint(rng.normal([1600, 0, 0, 300, 1500], [60, 1, 1, 200, 300], (400, 5))).astype(int)
    x[:60] += np.array([300, 4000, 0, 0, 0])
    members = spark.createDataFrame([("a" if i % 4 else "b", *map(int, r)) for i, r in enumerate(x)], "grp string, " + ", ".join(f"{c} long" for c in quality.X))
    est = quality.minimum_covariance_determinant(members)
    got = members.join(est, "grp").select("grp", *quality.X, quality._distance().alias("d")).collect()
    floors = np.array(list(quality.FLOORS.values())) * quality.STEP
    for grp in "ab":
        own = np.array([[r[c] for c in quality.X] for r in got if r.grp == grp])
        assert np.allclose([r.d for r in got if r.grp == grp], brute_mcd(own, floors), rtol=1e-6)


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["river", "the", "stone", "of", "a", "morning", "light"]) + str(rng.randrange(900)) for _ in range(rng.randint(30, 90))) for _ in range(300)]
    junk = [" ".join(w + "###" for w in c.split()) for c in clean[:30]] + ["spam " * 60, "few words", None, ""]
    got = {r.doc_id: r for r in quality.judge(documents(spark, list(enumerate(clean + junk)))).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 334))
    assert got[330].base_failed and not got[300].base_failed
    kept = quality.keep_good(documents(spark, [*enumerate(clean + junk), (0, None)]))
    assert kept.columns == documents(spark, []).columns and {r.doc_id for r in kept.collect()} == set(range(1, 300))
    assert quality.judge(documents(spark, []).limit(0)).count() == 0


def test_quality_is_native(spark):
    plan = quality.base_statistics(documents(spark, some_texts()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 5 Jaccard
def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(seed)
    rows = some_texts(seed, 70)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    for i in range(100, 130):  # a family of heavy edits
        t = list(base)
        for _ in range(rng.choice([1, 2, 4, 9])):
            t[rng.randrange(len(t))] = f"q{rng.randrange(99)}"
        rows.append((i, " ".join(t)))
    rows += EDGE
    got = jaccard.near_groups(documents(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_groups(rows)


def test_near_groups_of_nothing(spark):
    assert jaccard.near_groups(documents(spark, []).limit(0)).count() == 0


def test_linked_sets_share_signatures():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        drop = int(rng.integers(0, n // 9 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, n // 9 + 1))).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            x, y = jaccard.signatures(a)[0], jaccard.signatures(b)[0]
            assert len(np.intersect1d(x, y)) > 0
            sa, sb = jaccard.sketch(a), jaccard.sketch(b)
            w = min(len(sa), len(sb))
            fold = lambda s: np.bitwise_xor.reduce(s.reshape(-1, w), axis=0).view(np.uint64)
            assert int(np.bitwise_count(fold(sa) ^ fold(sb)).sum()) <= len(a) + len(b) - 2 * both


def test_shingles_match_words():
    texts = [t or "" for _, t in some_texts()]
    for t, s in zip(texts, shingles.shingle_sets(texts), strict=True):
        w = t.encode().lower().split()
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))


# 6 toxicity
def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    met = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(met, model).join(labels, "doc_id").select("score", "toxic").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([s >= 0.7 for s in toxic]) > 0.8 and np.mean([s >= 0.7 for s in clean]) < 0.005
    edge = toxicity.score(documents(spark, some_texts() + EDGE), model).collect()
    assert len(edge) == len(some_texts()) + len(EDGE) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.keep_civil(documents(spark, some_texts()), model).columns == documents(spark, []).columns


def test_toxicity_without_labels(spark):
    model = toxicity.train(documents(spark, some_texts()), spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.score("anything") < 0.5
    crc = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert [r.h for r in spark.range(50).select(toxicity.held_out(F.col("id")).alias("h")).orderBy("id").collect()] == [crc(i) for i in range(50)]


# 7 token counts
def test_unigram_counts(spark):
    from tokenizers import Tokenizer, models, normalizers

    path = P.path("piece_bpe_32k.model")
    vocabulary = token_counts.load_vocabulary(path)
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rows = some_texts() + EDGE + [(50, "  two  blanks "), (51, "\U0001f600\U0001f601 x"), (52, "日本語 ☃☃"), (53, "▁x ▁"), (54, "<0x41> <s>\n\n"), (55, "x" * 5000)]
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(documents(spark, rows), path).collect())
    assert got == Counter((i, len(tokenizer.encode(t or "").ids)) for i, t in rows)


def test_unigram_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    rng = random.Random(1)
    for trial in range(200):
        pieces = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))})
        vocabulary = [("<unk>", 0.0)] + [(p, float(-rng.randrange(4))) for p in pieces]
        counter = token_counts.UnigramCounter(vocabulary, byte_fallback=False)
        tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
        for _ in range(10):
            t = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
            assert counter.count_marked(t) == len(tokenizer.encode(t).ids), (vocabulary, t)


def test_counts_of_whole_texts_with_tied_fractional_scores():
    """Counts by words are used only where sums don't round, so ties fall as in the library."""
    from tokenizers import Tokenizer, models

    rng, apart = random.Random(2), 0
    for trial in range(120):
        mark = token_counts.MARK
        pieces = list({rng.choice(["", mark]) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(10)} | {mark, "a", "b"})
        step = rng.choice([0.1, 0.3, 0.7, 1.0])
        vocabulary = [("<unk>", 0.0)] + [(p, -step * len(p)) for p in pieces]
        counter = token_counts.UnigramCounter(vocabulary, byte_fallback=False)
        tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
        apart += counter.apart
        for _ in range(12):
            t = " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 6)))
            assert counter.count(t) == len(tokenizer.encode(mark + t.replace(" ", mark)).ids), (vocabulary, t)
    assert 0 < apart < 120


# 8 packing
def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in some_texts() + EDGE if i not in (None, 7)] + [(90, "<|endoftext|> word " * 900), (91, "a\n \nb  c's \t"), (92, "a  <|endoftext|><|endoftext|>  <|endoftext|x|> b<|endoftext|>"), (93, "word " * 60_000)]
    rows = list(dict(rows).items())
    got = packing.pack_documents(documents(spark, rows), path).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // 1024) and all(r.length == 1024 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == binascii.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(documents(spark, []).limit(0), path).count() == 0


def test_fullest_is_the_best_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        chosen = packing.fullest(counts, room)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        assert sum(chosen) == max(s for s in sums if s <= room) and all(chosen.count(x) <= counts[x] for x in chosen)
        bins = packing.minimum_bin_slack(dict(counts), 30)
        assert Counter(x for lengths, n in bins for x in lengths * n) == Counter(counts) and all(sum(lengths) <= 30 for lengths, _ in bins)


# 9 BPE
def test_bpe_is_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = some_texts() + EDGE + [(70, "中文" * 200), (71, "\n\n  \t x's  'll 12345"), (72, "<|endoftext|>"), (73, "z" * 4097)]
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_documents(documents(spark, rows), path, P.PATTERN).collect())
    assert got == Counter((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)


# 10 HTML
def test_main_text(spark):
    tree = html_text.trained()
    right = [html_text.decide(tree, r) > 0.5 and b.label or not b.label and html_text.decide(tree, r) <= 0.5 for page in html_text.labelled_pages() for found in [html_text.blocks(page)] for r, b in zip(html_text.block_features(found), found, strict=True)]
    assert sum(map(bool, right)) >= 0.995 * len(right)
    used = lambda t: {html_text.FEATURES[t[0]], *used(t[2]), *used(t[3])} if isinstance(t, tuple) else set()
    assert used(tree) >= {"words", "density", "words_before", "words_after"} and used(tree) & {"density_before", "density_after"}
    page = """<html><head><title>T &amp; t</title><script>if (a</b) x("<p>no</p>")</script></head><body class="has-sidebar"><header><a href=/>Home</a></header><nav><ul><li><a>x</a></ul></nav>
    <div class="cookie-banner"><p>We use cookies, a great many of them indeed, for all kinds of good reasons.</p></div><article><h1>Fish &amp; chips</h1><p>One&nbsp;two<br>three <b>four</b></p><ul><li>a<li>b</ul><p><a href=x>linked words only</a></p>
    <form><p>Your name and all that goes with it</p></form></article><aside><p>Buy now and never again pay more than you must.</p></aside><section id=comments><p>I liked this a lot, thank you.</p></section><footer>&copy; us</footer>"""
    assert html_text.main_text(page, tree) == "Fish & chips\n\nOne two three four\n\na\n\nb\n\nlinked words only"
    df = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (3, "v", "", 0), (None, "w", "<p", 0), (5, "x", "<article><p>" + "long " * 50000, 0)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[2].text == got[3].text == "" and got[5].n_chars == 5 * 50000 - 1 and got[1].n_chars == len(got[1].text)
    broken = "<a title=\"x>" * 300 + "<p>ok</p>"
    assert isinstance(html_text.main_text(broken, tree), str)


def test_main_text_keeps_what_belongs_to_the_article():
    tree, long = html_text.trained(), "The survey of the valley went on for eleven days and found nothing that older maps had not shown in their margins."
    assert html_text.main_text(f"<div><p>{long}</p></div>", tree) == long
    assert html_text.main_text(f"<p>{long}</p><p>Yes</p>", tree) == f"{long}\n\nYes"
    page = f"<article><p class='legal'>{long}</p><p class='notice'>Two words</p><div id='discussion'>One</div><section class='discussion'>{long}</section><math><mi>x</mi></math></article>"
    assert html_text.main_text(page, tree) == f"{long}\n\nOne\n\n{long}\n\nx"  # a notice is no part of the article
    page = f"<header><a href=/>Home</a> <a href=/b>Sport</a></header><div class=content><h2>Heading</h2><p>{long} {long}</p><p>OK.</p></div><div class=comments><p>{long}</p><p>So true</p></div><footer>Copyright us 2001</footer>"
    assert html_text.main_text(page, tree) == f"Heading\n\n{long} {long}\n\nOK."
    for tag in ("button", "select", "svg", "object"):
        lost = html_text.main_text(f"<article><p>{long}</p><{tag}>b<p>{long}</p><{tag}>c<p>{long}</p></article>", tree)
        assert lost.count(long) == 3, tag
    assert html_text.main_text(f"<article><p>{long}</p><button>b</button><p>{long}</p></article>", tree) == f"{long}\n\n{long}"


def test_main_text_held_out():
    """Pages of other layouts, languages and lengths than the labelled ones; data-m marks what is main."""
    rng, tree = random.Random(11), html_text.trained()
    words = "le fiume è salito di una mano prima della luce e nessuno nel paese ha saputo dire chi avesse aperto la porta del mulino quella notte".split()
    say = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b))).capitalize() + "."
    right = total = 0
    for _ in range(150):
        link = lambda: f"<a href=/x>{say(1, 3)}</a>"
        menu = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
        body = "".join(f"<p data-m>{say(18, 90)}</p>" for _ in range(rng.randint(2, 6)))
        plain = f"<div><span>{link()} · {link()}</span></div><ul>{menu}</ul><h1 data-m>{say(2, 8)}</h1>{body}<ol>{menu}</ol><div>{link()} {link()}</div>"
        marked = f"<header>{say(2, 30)}<ul>{menu}</ul></header><main><h1 data-m>{say(2, 8)}</h1><p data-m>{say(1, 4)}</p>{body}<p data-m>{link()}</p></main><aside><p>{say(20, 60)}</p></aside><footer>{say(3, 40)}</footer>"
        named = f"<div class='top-nav menu'>{link()} {link()} {link()}</div><div class=content>{body}</div><div class='reader-comments comments'><p>{say(5, 70)}</p><p>{say(2, 30)}</p></div><div class=site-footer><p>{link()}</p></div>"
        for page in (plain, marked, named):
            found = html_text.blocks(page)
            right += sum((html_text.decide(tree, r) > 0.5) == bool(b.label) for b, r in zip(found, html_text.block_features(found), strict=True))
            total += len(found)
    assert right >= 0.97 * total


def test_given_pages_are_decided_by_words_and_links_first(spark):
    """Most paths through the tree test words or links of a block or its neighbours, and noise for names changes few verdicts."""
    tree, rng = html_text.trained(), random.Random(3)
    tested = changed = total = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        page = row.html or ""
        noise = re.sub('class="[^"]*"', lambda m: f'class="q{rng.randrange(10**6)}"', page)
        for x, y in zip(html_text.block_features(html_text.blocks(page)), html_text.block_features(html_text.blocks(noise)), strict=True):
            at, path = tree, set()
            while isinstance(at, tuple):
                path.add(at[0])
                at = at[2] if x[at[0]] <= at[1] else at[3]
            tested += min(path) < html_text.N_TEXT_FEATURES
            changed += (at > 0.5) != (html_text.decide(tree, y) > 0.5)
            total += 1
    assert tested >= total / 2 and changed <= total / 100


# pipeline
def test_pipeline_stage_by_stage(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, folder).cache()
    judged = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == judged
    civil = stages["toxicity"](spark, good, folder).cache()
    model = toxicity.train(good, spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r.doc_id for r in civil.collect()} == {i for i in judged if model.score(before[i]) < 0.7}
    rows = [(r.doc_id, r.text) for r in civil.collect()]
    single = stages["n-gram Jaccard join"](spark, civil, folder).cache()
    assert {r.doc_id for r in single.collect()} == {i for i, _, c in brute_groups(rows) if c == i}
    rows = [(r.doc_id, r.text) for r in single.collect()]
    cut = stages["suffix-array dedup"](spark, single, folder).cache()
    want = {i: kept.decode() for i, _, _, _, kept in brute_repeats(rows, 50)}  # no character of these texts is cut in two
    assert cut.columns == columns and {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    packed = stages["best-fit packing"](spark, cut, folder)
    assert {r.doc_id for r in packed.collect()} == set(want)


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
