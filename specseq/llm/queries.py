"""The registered queries of this package, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, html_text, jaccard, near_vectors, packing, quality, ranking, repeats, tiff, token_counts, toxicity, warc
from .common import scratch_path, table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(table(spark, sf_dir, "pages"), min_bytes=0), path)
    return warc.resolve_revisits(warc.read_warc(spark, path, payloads=False))


OP1_SQL = """
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) d from pages),
q as (select page_id, strlen(html) payload_bytes,
        translate(list_aggregate(list_transform(range(8), lambda i: to_base(('0x' || substr(d, (5 * i + 1)::int, 5))::bigint, 32, 4)), 'string_agg', ''),
                  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') payload_digest,
        min(page_id) over (partition by html) first_id from p)
select page_id, payload_bytes::bigint payload_bytes, payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end record_type,
       case when page_id <> first_id then first_id end refers_to
from q
"""


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), match=50).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(tiff.texts_as_tiff(table(spark, sf_dir, "documents")))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w
), n as (select doc_id, count(*) n from s group by doc_id),
links as (
  select a.doc_id a, b.doc_id b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach as (select doc_id a, doc_id b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.component_id
from documents d left join n using (doc_id) join (select a doc_id, min(b) component_id from reach group by a) m using (doc_id)
"""


def op6_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)


def op9_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

    def digest(batches):
        for batch in batches:
            ids = [x.as_py() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(2)])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return coded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


OP11_SQL = """
with recursive e as (
  select row_number() over () r, vec_id, label, list_transform(embedding, lambda v: v::double) v from embeddings
), u as (
  select r, vec_id, label, v, len(v) n, sqrt(list_sum(list_transform(v, lambda x: x * x))) size from e
  where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.r a, b.r b from u a join u b on a.label = b.label and a.n = b.n and a.r <> b.r where list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93
), reach as (select r a, r b from e union select x.a, l.b from reach x join links l on x.b = l.a),
named as (select x.a r, min(e.vec_id) component_id from reach x join e on e.r = x.b group by x.a)
select e.vec_id, (select count(*) from links where links.a = e.r)::bigint n_links, component_id, coalesce(e.vec_id = component_id, false) kept
from e join named using (r)
"""


def op12_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


OP12_SQL = r"""
with d as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents
), c as (select count(*) filter (len(w) > 0) n_docs, sum(len(w))::bigint n_all from d),
tf as (select r, term, count(*) tf from (select r, unnest(w) term from d) group by r, term),
q as (
  select item_id, term, count(*) repeats from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark where item_id is not null)
  group by item_id, term
), df as (select term, count(*) df from tf group by term),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint w from df, c),
m as (select r, doc_id, 75 + (25 * len(w)::hugeint * n_docs) // n_all m from d, c where len(w) > 0),
s as (
  select item_id, doc_id, r, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
  from q join tf using (term) join w using (term) join m using (r) where doc_id is not null group by item_id, doc_id, r
), ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int rank, doc_id, score from s where score > 0)
select * from ranked where rank <= 20
"""


def op13_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = alignment.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.with_corpus_counts(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op11_spherical_cells": op11_spherical_cells,
    "op12_automaton_search": op12_automaton_search,
    "op13_diagonal_runs": op13_diagonal_runs,
    "op1_warc_revisits": op1_warc_revisits,
    "op2_run_length_index": op2_run_length_index,
    "op3_tiff_pages": op3_tiff_pages,
    "op4_robust_outliers": op4_robust_outliers,
    "op5_partenum_join": op5_partenum_join,
    "op6_toxicity_nb": op6_toxicity_nb,
    "op10_html_blocks": op10_html_blocks,
    "op7_unigram_counts": op7_unigram_counts,
    "op8_minimum_bin_slack": op8_minimum_bin_slack,
    "op9_bpe_segment_tree": op9_bpe_segment_tree,
}
SQL = {"op1_warc_revisits": OP1_SQL, "op5_partenum_join": OP5_SQL, "op11_spherical_cells": OP11_SQL, "op12_automaton_search": OP12_SQL}
