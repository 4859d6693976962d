"""Vectors, search and alignment against brute force, and their queries against SQL, on small tables."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from specseq.llm import alignment, near_vectors, queries, ranking

P = pytest.importorskip("public_tokenizers")
TABLES = ("documents", "embeddings", "benchmark")


# 11 near-duplicate vectors
def brute_vectors(rows, cosine=0.93):
    """n_links, component_id and kept of each row, all pairs compared."""

    def unit(v):
        if not v or any(e is None or not math.isfinite(e) for e in v) or not any(v):
            return None
        top = max(map(abs, v))
        x = np.array([e / top for e in v])
        return x / math.sqrt(x @ x)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least, least is not None and rows[i][0] == least))
    return sorted(out, key=repr)


def some_vectors(seed, n=900, size=24, labels=2):
    """Loose vectors, loose and tight families, copies and multiples."""
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(n // 3):
        vectors.append(rng.normal(size=size))
    for spread, members in ((0.02, n // 3), (0.2, n // 6), (0.27, n // 6)):
        centre = rng.normal(size=size)
        centre /= np.linalg.norm(centre)
        vectors += [centre + rng.normal(size=size) * spread / math.sqrt(size) * 1.0 for _ in range(members)]
    for k in rng.integers(0, len(vectors), n // 10):
        vectors.append(vectors[k] * rng.choice([1.0, 3.0]))
    order = rng.permutation(len(vectors))
    return [(int(i * 3 % 2711), [float(e) for e in vectors[k]], int(rng.integers(labels))) for i, k in enumerate(order, 1)]


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, node int")


@pytest.mark.parametrize("seed", [1, 2])
def test_near_vectors_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(near_vectors, "CELL_NODES", 20)
    monkeypatch.setattr(near_vectors, "BLOCK_NODES", 40)
    rows = some_vectors(seed)
    got = near_vectors.near_vectors(vector_frame(spark, rows), reach=1.0)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_vectors(rows)


def test_vectors_at_the_default_reach(spark, monkeypatch):
    """Links that the default reach finds, against all: nearly every one, and none that isn't."""
    monkeypatch.setattr(near_vectors, "CELL_NODES", 20)
    rows = some_vectors(3)
    got = {i: n for i, n, *_ in near_vectors.near_vectors(vector_frame(spark, rows)).collect()}
    want = {i: n for i, n, *_ in brute_vectors(rows)}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_cells_part_what_they_can(spark, monkeypatch):
    """Loose vectors fall into many cells; each is at home once."""
    monkeypatch.setattr(near_vectors, "CELL_NODES", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([("g", i, 1, bytearray(v.astype("<f8").tobytes())) for i, v in enumerate(x)], "grouping string, node long, copies long, unit binary")
    cells = near_vectors.in_cells(nodes, 0.1)
    homes = cells.where("home").groupBy("node").count()
    assert homes.count() == 600 and homes.agg(F.max("count")).first()[0] == 1
    sizes = [r["count"] for r in cells.where("home").groupBy("cell").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 120


def test_vectors_of_all_kinds(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, float("nan")], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None),
        (9, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (10, [1e300, 1e299], 0), (11, [1e-310, 0.0], 0), (12, [1.0, 0.0, 0.0], 0), (13, [-1.0, 0.0], 0), (None, [2.0, 0.1], 0), (None, [0.0, 1.0], 0), (None, None, 0), (14, [1.0, 0.0], 1),
        (15, [-0.0, 1.0], 1), (16, [0.0, 5.0], 1), (17, [3.0], 5), (18, [-3.0], 5), (19, [4.0], 5),
    ]
    got = near_vectors.near_vectors(vector_frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_vectors(rows)
    assert near_vectors.near_vectors(vector_frame(spark, rows).where("false")).collect() == []


# 12 ranked search
def brute_search(docs, items, top):
    def terms(t):
        out, word = [], ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z":
                c = c.lower()
            if c.isascii() and not c.isalnum():
                if word:
                    out.append(word)
                word = ""
            else:
                word += c
        return out

    split = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    wanted = defaultdict(list)
    for i, t in items:
        if i is not None:
            wanted[i] += terms(t)
    out = []
    for item, query in wanted.items():
        found = []
        for doc, words in split:
            if doc is None or not words:
                continue
            tf, m = Counter(words), 75 + (25 * len(words) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in query if tf[t])
            if s > 0:
                found.append((-s, doc))
        out += [(item, k, doc, -s) for k, (s, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = ["the", "The", "a", "ab", "abc", "bc", "é", "Éa", "x1", "1", "漢字", "a-b", "ab,abc", "don't", "q r", " ", "zz"]
    text = lambda k: rng.choice([" ", "  ", "\n", "-"]).join(rng.choice(words) for _ in range(k))
    docs = [(i, text(rng.randint(1, 60))) for i in range(300)] + [(5, "ab abc"), (5, "ab abc"), (None, "ab zz zz"), (400, None), (401, ""), (402, "--- "), (403, "abc " * 3000)] + [(500 + i, "same words ab") for i in range(50)]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(3, "ab again"), (None, "ab"), (20, None), (21, "..."), (22, "nowhere"), (23, "same words same")]
    dd = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double").repartition(5)
    ii = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, rank int")
    want = brute_search(docs, items, 7)
    got = ranking.search(dd, ii, top=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 15)  # several blocks of items, small stretches, whole-number sums
    monkeypatch.setattr(ranking, "STRETCH", 64)
    monkeypatch.setattr(ranking, "EXACT", 0)
    assert sorted(tuple(r) for r in ranking.search(dd, ii, top=7).collect()) == want


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.search(docs.where("false"), items).collect() == []
    assert ranking.search(docs, items.where("false")).collect() == []
    assert ranking.search(docs.withColumn("text", F.lit(None)), items).collect() == []
    assert ranking.search(docs, items.withColumn("text", F.lit("?"))).collect() == []


def test_long_terms_and_texts_are_cut_at_separators():
    terms = ranking.Terms(["a" * 50, "b"], [1], np.array([0, 1, 2]), np.array([0, 0]), np.array([1, 1]))
    text = ("a" * 50 + " b ") * 40_000
    assert terms.counts(text.encode()) == {0: 40_000, 1: 40_000}
    assert terms.counts(("c" * 3_000_000 + " b").encode()) == {1: 1}


# 13 alignment
def brute_alignment(text, aligner, tokenizer, model):
    """Ids of both sides, groups as text and the numbers of linked pairs, by comparing all ranges."""
    nothing = (0, 0, 0, 0, "", {})
    if not text:
        return nothing
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    sides = []
    for ids, tokens in ((a, aligner.a.tokens), (b, aligner.b.tokens)):
        if b"".join(tokens[i] for i in ids) != (" " + text).encode():
            return nothing
        at, side = 0, []
        for i in ids:
            side.append((at, at + len(tokens[i]), i))
            at += len(tokens[i])
        sides.append(side)
    groups, pairs, low = [], Counter(), 0
    for end in sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]}):
        x, y = ([t for t in side if low <= t[0] < end] for side in sides)
        groups.append("|".join(",".join(str(t[2]) for t in z) for z in (x, y)))
        pairs.update(p[2] << alignment.ID_BITS | q[2] for p in x for q in y if p[0] < q[1] and q[0] < p[1])
        low = end
    return len(a), len(b), len(groups), sum(pairs.values()), ";".join(groups), dict(pairs)


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    tokenizer = Tokenizer.from_file(paths[0])
    tokenizer.encode_special_tokens = True
    return paths, alignment.Aligner(*paths, True), tokenizer, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def mixed_texts(seed=1, n=200):
    rng = random.Random(seed)
    signs = [*"abc .,\n\tThe tion 12éß漢😀▁", "<|endoftext|>", "<s>", "<0x0A>", "  ", "ing"]
    return [None, "", " ", "a", "　x", "ﬁ", "a b  c ", "same text", "same text"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_alignment_equals_brute_force(spark, tools):
    paths, aligner, tokenizer, model = tools
    texts = mixed_texts() + ["thandheion erblest " * 3000, "x" * 5000]
    want = [brute_alignment(t, aligner, tokenizer, model) for t in texts]
    assert any(w[0] for w in want) and any(not w[0] for w in want[8:])
    got = aligner.align([t or "" for t in texts])
    for k, w in enumerate(want):
        assert (*(got[c][k].as_py() for c in ("n_a", "n_b", "n_groups", "n_links", "groups")), dict(zip(got["pairs"][k].as_py(), got["counts"][k].as_py(), strict=True))) == w

    rows = [(k if k % 7 else None, t, "x", 3) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string, total int").repartition(3)
    for few in (alignment.MOST_BROADCAST, 0):
        patch = pytest.MonkeyPatch()
        patch.setattr(alignment, "MOST_BROADCAST", few)
        patch.setattr(alignment, "MOST_FREQUENT", 50)
        got = alignment.with_corpus_counts(alignment.align_tokens(docs, *paths, groups=True)).collect()
        patch.undo()
        total, best = Counter(), Counter()
        for w in want:
            total.update(w[5])
        for pair, n in total.items():
            b = pair & ((1 << alignment.ID_BITS) - 1)
            best[b] = max(best[b], n)
        full = [(rows[k][0], *w[:4], w[4], sum(n for p, n in w[5].items() if total[p] == best[p & ((1 << alignment.ID_BITS) - 1)]), sum(n * total[p] for p, n in w[5].items())) for k, w in enumerate(want)]
        assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in got), key=repr) == sorted(full, key=repr)
    assert alignment.with_corpus_counts(alignment.align_tokens(docs.where("false"), *paths)).collect() == []


def test_runs_are_jumped():
    rng = random.Random(2)
    for _ in range(300):
        ends = sorted(rng.sample(range(1, 400), rng.randint(1, 150)))
        a, b = ([e for e in ends[:-1] if rng.random() < p] + ends[-1:] for p in (0.9, rng.choice([1.0, 0.9, 0.3])))
        both, want = sorted(set(a) & set(b)), []
        i = j = 0
        for e in both:
            i1, j1 = a.index(e) + 1, b.index(e) + 1
            if (i1 - i, j1 - j) != (1, 1):
                want.append((i, i1, j, j1))
            i, j = i1, j1
        assert list(zip(*map(np.ndarray.tolist, alignment.irregular_groups(a, b)), strict=True)) == want


# the registered queries
@pytest.mark.parametrize("name", ["op11_spherical_cells", "op12_automaton_search"])
def test_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, folder), con.sql(queries.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    found = sorted(tuple(r[n] for n in names) for r in got.collect())
    assert found == sorted(tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall()) and found


def test_alignment_query(spark, tools):
    _, aligner, tokenizer, model = tools
    got = {r.doc_id: r for r in queries.QUERIES["op13_diagonal_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs[::20]:
        w = brute_alignment(d.text[:20000] if d.text else d.text, aligner, tokenizer, model) if len(d.text or "") < 20000 else None
        if w:
            r = got[d.doc_id]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links) == w[:4] and r.n_best <= r.n_links <= r.count_sum


def test_written_tables_send_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from specseq.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    rows = common.written(texts.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r.n for r in rows) == 2000 and max(r.bytes for r in rows) < 2 * common.BATCH_BYTES
    through = common.settled("sizes")(lambda df: df.mapInArrow(sizes, "n long, bytes long"))(texts).collect()
    assert sum(r.n for r in through) == 2000 and max(r.bytes for r in through) < 2 * common.BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
