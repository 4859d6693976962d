"""Queries on results of programs, clusters and texts as sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as r
from ..operators import compare, ranges, sequences
from ..operators.scores import best_per_group
from ..sources import tables as t

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RESULTS = """res as (select l_orderkey scan, l_returnflag program, (max({'p': l_extendedprice, 'k': l_partkey}).k % 50)::bigint answer, max(l_extendedprice) score, list_sort(list_distinct(list(l_partkey))) items from lineitem group by 1, 2)"""


@query("""select l_orderkey, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_suppkey) n from
  (select distinct l_orderkey, l_partkey, l_suppkey, l_extendedprice from lineitem)) where n = 1""")
def argmax_psm(spark, d):
    rows = t.table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_suppkey")).alias("s"))).alias("m"))
    flat = rows.select("l_orderkey", "l_partkey", (-F.col("m.s")).alias("l_suppkey"), F.col("m.l_extendedprice").alias("l_extendedprice"))
    return best_per_group(flat, "l_orderkey", "l_extendedprice", "l_partkey")


@query("select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id order by value desc, event_id desc) n from events) where n = 1")
def keep_best_override(spark, d):
    return compare.keep_best(t.table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "user_id", [F.desc("value"), F.desc("event_id")])


def _side(spark, d, flag):
    x = flag.lower()
    return t.program_results(spark, d).where(F.col("program") == flag).select("scan", F.col("answer").alias(f"answer_{x}"), F.col("score").alias(f"score_{x}"))


@query(f"with {RESULTS} select coalesce(a.scan, b.scan) scan, a.answer answer_a, a.score score_a, b.answer answer_r, b.score score_r from (select * from res where program = 'A') a full join (select * from res where program = 'R') b on a.scan = b.scan")
def full_outer_combine(spark, d):
    return compare.full_outer(_side(spark, d, "A"), _side(spark, d, "R"), "scan")


@query(f"""with {RESULTS} select a.scan, a.program prog_a, b.program prog_b, round(len(list_intersect(a.items, b.items)) / len(a.items), 6) as "precision", round(len(list_intersect(a.items, b.items)) / len(b.items), 6) accuracy
from res a join res b on a.scan = b.scan and a.program < b.program""")
def compare_programs(spark, d):
    precision, accuracy = compare.agreement(F.col("items_a"), F.col("items_b"))
    return compare.program_pairs(t.program_results(spark, d), "scan", "program").select("scan", "prog_a", "prog_b", F.round(precision, 6).alias("precision"), F.round(accuracy, 6).alias("accuracy"))


@query(f"""with {RESULTS}, v as (select scan, answer, count(distinct program) n_programs, max(score) score from res group by 1, 2)
select scan, answer, n_programs, score from (select *, row_number() over (partition by scan order by n_programs desc, score desc, answer) n from v) where n = 1""")
def consensus_merge(spark, d):
    return compare.consensus(t.program_results(spark, d), "scan", "program", "answer", "score").select("scan", "answer", "n_programs", "score")


@query(f"with {RESULTS} select scan, program, answer, score from res where scan in (select scan from res group by 1 having count(distinct program) >= 3)")
def min_programs_filter(spark, d):
    rows = t.program_results(spark, d).drop("items")
    enough = rows.groupBy("scan").agg(F.countDistinct("program").alias("n")).where("n >= 3").select("scan")
    return rows.join(enough, "scan", "left_semi").select("scan", "program", "answer", "score")


@query(f"""with {RESULTS} select program, kind, count(*) n, round(avg(score), 4) mean_score, max(score) best from (select *, case when answer < 10 then 'true' when answer < 30 then 'false' else 'other' end kind from res) group by rollup (program, kind)""")
def comp_stats_rollup(spark, d):
    kind = F.when(F.col("answer") < 10, "true").when(F.col("answer") < 30, "false").otherwise("other")
    return t.program_results(spark, d).withColumn("kind", kind).rollup("program", "kind").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.max("score").alias("best"))


SWEEP = """s as (select n_chars::double score, quality = 1 truth from documents join labels using (doc_id)), e as (select min(score) lo, max(score) hi from s),
cuts as (select i::integer cutoff_no, lo + i * ((hi - lo) / 99) cutoff from e, range(100) x(i)),
sw as (select cutoff_no, cutoff, count(*) filter (truth and score >= cutoff) tp, count(*) filter (not truth and score >= cutoff) fp, count(*) filter (truth) n_true from cuts, s group by 1, 2)"""


def _sweep(spark, d):
    scored = t.table(spark, d, "documents").join(t.table(spark, d, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("truth"))
    return compare.sweep(scored, "score", "truth", 100)


@query(f"""with {SWEEP} select cutoff_no, round(cutoff, 6) cutoff, round(tp / n_true, 6) sensitivity, round(case when tp + fp = 0 then 1 else tp / (tp + fp) end, 6) as "precision" from sw""")
def roc_sweep(spark, d):
    return compare.roc(_sweep(spark, d)).select("cutoff_no", *[F.round(c, 6).alias(c) for c in ("cutoff", "sensitivity", "precision")])


@query(f"with {SWEEP} select cutoff_no, round(cutoff, 6) cutoff, round(case when tp + fp = 0 then 0 else fp / (tp + fp) end, 6) fdr from sw")
def fdr_sweep(spark, d):
    return compare.fdr(_sweep(spark, d)).select("cutoff_no", F.round("cutoff", 6).alias("cutoff"), F.round("fdr", 6).alias("fdr"))


@query("select n_sources, count(*) n_texts from (select text, count(distinct source) n_sources from documents group by 1) group by 1")
def found_in_bins(spark, d):
    return t.table(spark, d, "documents").groupBy("text").agg(F.countDistinct("source").alias("n_sources")).groupBy("n_sources").agg(F.count("*").alias("n_texts"))


@query("select doc_id, source, n_chars from (select *, row_number() over (partition by md5(lower(text)) order by n_chars desc, doc_id) n from documents) where n = 1")
def unique_peptide_best(spark, d):
    rows = t.table(spark, d, "documents").select(F.md5(F.lower("text").cast("binary")).alias("k"), "doc_id", "source", "n_chars")
    return compare.keep_best(rows, "k", [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source", "n_chars")


@query("""with s as (select lang = 'en' bin, n_chars::double score, quality = 1 truth from documents join labels using (doc_id)), e as (select bin, min(score) lo, max(score) hi from s group by 1),
c as (select bin, i, lo + i * ((hi - lo) / 19) cut from e, range(20) x(i)), w as (select c.bin, i, count(*) filter (truth and score >= cut) tp, count(*) filter (not truth and score >= cut) fp from c join s on s.bin = c.bin group by 1, 2),
p as (select a.i i0, b.i i1, a.tp + b.tp tp, a.fp + b.fp fp from w a, w b where not a.bin and b.bin), q as (select *, round(200 * tp / (tp + fp))::bigint step from p where tp + fp > 0)
select step, max(tp) tp from q group by 1""")
def found_in_optimize(spark, d):
    """Cut-offs of two bins together: for each step of precision the most true results."""
    scored = t.table(spark, d, "documents").join(t.table(spark, d, "labels"), "doc_id").select((F.col("lang") == "en").alias("bin"), F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("truth"))
    a, b = (compare.sweep(scored.where(F.col("bin") == x), "score", "truth", 20).select(F.col("tp").alias(f"tp{int(x)}"), F.col("fp").alias(f"fp{int(x)}")) for x in (False, True))
    both = a.crossJoin(F.broadcast(b)).select((F.col("tp0") + F.col("tp1")).alias("tp"), (F.col("fp0") + F.col("fp1")).alias("fp")).where("tp + fp > 0")  # 20 rows each
    return both.groupBy(F.round(200 * F.col("tp") / (F.col("tp") + F.col("fp"))).cast("long").alias("step")).agg(F.max("tp").alias("tp"))


CLUSTERED = "x as (select c_custkey, c_mktsegment test, c_nationkey % 5 truth from customer), m as (select test, truth, count(*) n from x group by 1, 2)"


def _clustered(spark, d):
    return t.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("test"), (F.col("c_nationkey") % 5).alias("truth"))


@query(f"with {CLUSTERED} select count(*) filter (a.test = b.test and a.truth = b.truth) tp, count(*) filter (a.test = b.test and a.truth <> b.truth) fp, count(*) filter (a.test <> b.test and a.truth = b.truth) fn, count(*) filter (a.test <> b.test and a.truth <> b.truth) tn from x a join x b on a.c_custkey < b.c_custkey")
def cluster_pairwise_confusion(spark, d):
    return compare.pairwise_confusion(_clustered(spark, d), "test", "truth")


@query(f"""with {CLUSTERED} select round((select avg(s) from (select max(n) / sum(n) s from m group by truth)), 6) recall, round((select avg(s) from (select max(n) / sum(n) s from m group by test)), 6) as "precision" """)
def cluster_recall_precision(spark, d):
    return compare.best_overlap(_clustered(spark, d), "test", "truth").select(F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query("""with g as (select epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) gap from events), b as (select least((gap // 600000000)::bigint, 9) bin from g where gap is not null) select bin, count(*) n from b group by 1""")
def scan_diff_histogram(spark, d):
    from pyspark.sql.window import Window

    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.table(spark, d, "events").select(gap.alias("gap")).where("gap is not null").groupBy(F.least(F.expr("gap div 600000000"), F.lit(9).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


@query("""with d as (select round_even(abs(a.s_acctbal - b.s_acctbal) / 50, 0)::bigint b from supplier a join supplier b on a.s_suppkey < b.s_suppkey), s as (select unnest([b - 1, b, b + 1]) bucket from d) select bucket, count(*) n from s where bucket between 0 and 20 group by 1""")
def mass_delta_frequency(spark, d):
    """Differences of supplier balances up to 1000, each counted in its bucket and both neighbours."""
    gaps = ranges.gap_counts(t.table(spark, d, "supplier"), "s_acctbal", 50.0, 21)
    return gaps.select(F.explode(F.array(*[F.col("m") + i for i in (-1, 0, 1)])).alias("bucket"), "pairs").where("bucket between 0 and 20").groupBy("bucket").agg(F.sum("pairs").alias("n"))


@query("select l_partkey, l_quantity best, count(distinct l_orderkey) n_refs, min(l_discount) least_e from (select *, max(l_quantity) over (partition by l_partkey) m from lineitem) where l_quantity = m group by 1, 2")
def blast_best_hits(spark, d):
    """All orders that tie for a part's greatest quantity."""
    rows = t.table(spark, d, "lineitem")
    best = rows.groupBy("l_partkey").agg(F.max("l_quantity").alias("best"))
    return rows.join(best, "l_partkey").where("l_quantity = best").groupBy("l_partkey", "best").agg(F.countDistinct("l_orderkey").alias("n_refs"), F.min("l_discount").alias("least_e"))


@query("select l_suppkey, max(l_extendedprice) best, min(l_discount) least_e, round(sum(1 / (1 + l_tax)), 4) total, count(distinct l_partkey) n_peptides from lineitem group by 1")
def protein_stats(spark, d):
    return t.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("best"), F.min("l_discount").alias("least_e"), F.round(F.sum(1 / (1 + F.col("l_tax"))), 4).alias("total"), F.countDistinct("l_partkey").alias("n_peptides"))


@query("select l_partkey k from lineitem where l_returnflag = 'A' union select l_partkey from lineitem where l_returnflag = 'R'")
def nonredundant_union(spark, d):
    rows = t.table(spark, d, "lineitem")
    return rows.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).union(rows.where("l_returnflag = 'R'").select("l_partkey")).distinct()


@query("""with r as (select l_orderkey, l_linenumber k, max(l_extendedprice) v from lineitem group by 1, 2), x as (select *, coalesce(k - lag(k) over w = 1 and abs(v - lag(v) over w) < 0.3 * v, false) as near, row_number() over w as i from r window w as (partition by l_orderkey order by k)),
y as (select *, max(case when not near then i end) over (partition by l_orderkey order by k rows unbounded preceding) as start_i from x) select l_orderkey, k - 1 as first, k as second from y where near and (i - start_i) % 2 = 1""")
def consecutive_pairs(spark, d):
    """Lines of an order with consecutive numbers and like prices, each in one pair at most."""
    rows = t.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    return sequences.consecutive_pairs(rows, "l_orderkey", "l_linenumber", "price", 30000.0)


AA = "".join(r.RESIDUES)
NORMAL = f"regexp_replace(translate(upper(p_name), 'LUZB', 'ICQN'), '[^{AA}]', '', 'g')"
SEQ = f"s as (select p_partkey, {NORMAL} seq from part)"


@query(f"select p_partkey, regexp_replace(upper(p_name), '[^{AA}L]', '', 'g') seq from part")
def strip_modifications(spark, d):
    return t.table(spark, d, "part").select("p_partkey", r.stripped(F.upper("p_name")).alias("seq"))


@query(f"with {SEQ} select * from s")
def normalise_sequence(spark, d):
    return _sequences(spark, d)


def _sequences(spark, d):
    return t.table(spark, d, "part").select("p_partkey", r.normalised(F.col("p_name")).alias("seq"))


MASS = "m as (select * from (values " + ", ".join(f"('{k}', {v}::double)" for k, v in r.RESIDUES.items()) + ") v(sym, mono))"
LETTERS = "l as (select p_partkey, seq, i pos, substr(seq, i::integer, 1) sym from s, unnest(range(1, len(seq) + 1)) u(i))"
PRM = "prm as (select p_partkey, pos, sum(mono) over (partition by p_partkey order by pos) prm, len(seq) n from l join m using (sym))"


@query(f"with {SEQ}, {MASS}, {LETTERS}, {PRM} select p_partkey, pos::integer pos, round(prm, 5) prm from prm where pos < n")
def prm_ladder(spark, d):
    return sequences.ladder_rows(_sequences(spark, d), "p_partkey", "seq").select("p_partkey", "pos", F.round("prm", 5).alias("prm"))


@query(f"""with {SEQ}, {MASS}, {LETTERS}, {PRM}, f as (select p_partkey, prm from prm where pos < n), k as (select p_partkey from part), z as (select p_partkey, count(*) n from f group by 1),
j as (select a.p_partkey a, count(*) n from f a where exists (select 1 from f b where b.p_partkey = a.p_partkey + 1 and abs(a.prm - b.prm) < 0.02) group by 1)
select k.p_partkey a, (k.p_partkey + 1)::bigint b, coalesce(x.n, 0)::integer n_a, coalesce(y.n, 0)::integer n_b, coalesce(j.n, 0)::integer n_shared from k join k k2 on k2.p_partkey = k.p_partkey + 1 left join z x on x.p_partkey = k.p_partkey left join z y on y.p_partkey = k.p_partkey + 1 left join j on j.a = k.p_partkey""")
def ladder_compare(spark, d):
    """Ladders of parts with consecutive keys."""
    s = _sequences(spark, d).select("p_partkey", r.ladder(F.col("seq")).alias("x"))
    pairs = s.select(F.col("p_partkey").alias("a"), F.col("x").alias("la"), (F.col("p_partkey") + 1).alias("b")).join(s.select(F.col("p_partkey").alias("b"), F.col("x").alias("lb")), "b")
    return sequences.ladders_shared(pairs, "la", "lb", 0.02).select("a", "b", "n_a", "n_b", "n_shared")


SIDES = f"{LETTERS}, adj as (select p_partkey, pos, sym as before, lead(sym) over (partition by p_partkey order by pos) as after from l)"


@query(f"""with {SEQ}, {SIDES} select p_partkey, pos::integer pos, (case when after = 'P' then if(before = 'P', 15, 0) when before = 'P' then 1 when after = 'G' then if(before = 'G', 15, 2) when before = 'G' then 3 when after in ('R', 'K') then 4 when before = 'H' then 5 when after = 'H' then 6
when before in ('D', 'E') then 7 when after in ('D', 'E') then 8 when before in ('J', 'V') then 9 when after in ('J', 'V') then 10 when before in ('S', 'T') then 11 when after in ('S', 'T') then 12 when before = 'N' then 13 when after = 'N' then 14 else 15 end)::integer as class from adj where after is not null""")
def aa_equiv_class(spark, d):
    return sequences.adjacent(_sequences(spark, d), "p_partkey", "seq").select("p_partkey", "pos", r.amino_class(F.col("before"), F.col("after")).alias("class"))


@query(f"with {SEQ}, {SIDES} select p_partkey, pos::integer pos, (case when before in ('K', 'R') and after <> 'P' then 0 when before = 'D' then 1 else -1 end)::integer rule from adj where after is not null")
def enzyme_cleavage(spark, d):
    return sequences.adjacent(_sequences(spark, d), "p_partkey", "seq").select("p_partkey", "pos", r.cleavage_rule(F.col("before"), F.col("after"), [("[KR]", "[^P]"), ("D", ".")]).alias("rule"))


@query("""with k as (select lang, substr(text, i::integer, 3) kmer from documents, unnest(range(1, length(text) - 1)) u(i)), c as (select lang, kmer, count(*) n from k group by 1, 2)
select lang, sum(n)::bigint n_kmers, count(*) n_distinct, round(sum(n::double * n) / power(sum(n), 2), 9) p_match from c group by 1""")
def kmer_diversity(spark, d):
    return sequences.match_probability(sequences.kmers(t.table(spark, d, "documents").select("lang", "text"), "lang", "text", 3), "lang").withColumn("p_match", F.round("p_match", 9))


DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTNN')"
CODE = "code as (select a.b || b.b || c.b codon, substr('" + r.CODE + "', (a.i * 16 + b.i * 4 + c.i + 1)::integer, 1) aa from (values (0, 'T'), (1, 'C'), (2, 'A'), (3, 'G')) a(i, b), (values (0, 'T'), (1, 'C'), (2, 'A'), (3, 'G')) b(i, b), (values (0, 'T'), (1, 'C'), (2, 'A'), (3, 'G')) c(i, b))"


@query(f"""with {CODE}, s as (select item_id, {DNA} f from benchmark), o as (select item_id, 1 strand, f x from s union all select item_id, -1, reverse(translate(f, 'ACGTN', 'TGCAN')) from s),
fr as (select item_id, strand, frame, x from o, (values (0), (1), (2)) v(frame)), c as (select item_id, strand, frame, i, substr(x, (i * 3 + frame + 1)::integer, 3) codon from fr, unnest(range(0, (length(x) - frame) // 3)) u(i))
select item_id, strand::integer strand, frame::integer frame, string_agg(coalesce(aa, 'X'), '' order by i) protein from c left join code using (codon) group by 1, 2, 3""")
def six_frame(spark, d):
    dna = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTNN")
    rows = t.table(spark, d, "benchmark").select("item_id", dna.alias("f"))
    both = rows.select("item_id", F.lit(1).alias("strand"), F.col("f").alias("x")).unionByName(rows.select("item_id", F.lit(-1).alias("strand"), r.reverse_complement(F.col("f")).alias("x")))
    frames = F.array(*[F.struct(F.lit(i).alias("frame"), r.translated(F.col("x"), i).alias("protein")) for i in range(3)])
    return both.select("item_id", "strand", F.inline(frames)).where("protein <> ''")


@query("""with p as (select doc_id, i - 1 part, x[i] s from (select doc_id, regexp_split_to_array(text, '[.\\n]') x from documents), unnest(range(1, len(x) + 1)) u(i)), q as (select * from p where length(s) >= 20),
c as (select doc_id, part, j chunk_no, substr(s, (j * 80 + 1)::integer, 100) chunk from q, unnest(range(0, greatest(ceil((length(s) - 20) / 80)::bigint, 1))) u(j))
select doc_id, part::integer part, chunk_no::integer chunk_no, chunk from c where length(chunk) >= 20""")
def chunk_sequence(spark, d):
    return sequences.chunks(t.table(spark, d, "documents"), "doc_id", "text", ".\\n", 100, 20, 20)


@query(f"with {SEQ} select p_partkey, '>' || p_partkey || chr(10) || regexp_replace(seq, '(.{{5}})', '\\1' || chr(10), 'g') record from s where length(seq) % 5 <> 0")
def fasta_emit(spark, d):
    return _sequences(spark, d).where(F.length("seq") % 5 != 0).select("p_partkey", r.fasta(F.col("p_partkey").cast("string"), F.col("seq"), 5).alias("record"))


@query(f"""with recursive {SEQ}, {MASS}, {LETTERS}, u as (select distinct sym, mono from l join m using (sym)),
st as (select sym seq, mono mass from u where mono < 250 union all select st.seq || u.sym, st.mass + u.mono from st, u where st.mass + u.mono < 250) select seq, round(mass, 5) mass from st""")
def residue_strings(spark, d):
    """All strings of the residues that occur in part names, under 250 Da, of any length."""
    used = _sequences(spark, d).select(F.explode(r.letters(F.col("seq"))).alias("sym")).distinct().join(F.broadcast(r.residue_table(spark)), "sym")
    return sequences.residue_strings(used, 250.0).withColumn("mass", F.round("mass", 5))


@query(f"""with recursive {MASS}, st as (select sym seq, mono mass from m where mono < 400 union all select st.seq || m.sym, st.mass + m.mono from st, m where st.mass + m.mono < 400)
select c_custkey, c_acctbal, seq, round(mass, 5) seq_mass from customer join st on abs(c_acctbal - mass) < 0.5""")
def mass_index_lookup(spark, d):
    """Customers with each residue string of any length under 400 Da within 0.5 of the balance."""
    strings = sequences.residue_strings(r.residue_table(spark), 400.0)
    return sequences.mass_lookup(t.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", strings, 0.5).withColumn("seq_mass", F.round("seq_mass", 5))


EDGES = "g as (select a.s_suppkey src, b.s_suppkey dst, b.s_acctbal - a.s_acctbal gap from supplier a join supplier b on b.s_acctbal - a.s_acctbal > 50 and b.s_acctbal - a.s_acctbal < 300)"


@query(f"with {MASS}, {EDGES} select src, dst, case when count(sym) = 1 then any_value(sym) else '-' end as label from g left join m on abs(gap - mono) < 0.5 group by 1, 2 having count(sym) > 0 or any_value(gap) > 250")
def edge_labels(spark, d):
    s = t.table(spark, d, "supplier")
    gaps = ranges.range_join(s.select(F.col("s_suppkey").alias("src"), F.col("s_acctbal").alias("x")), s.select(F.col("s_suppkey").alias("dst"), F.col("s_acctbal").alias("y")), "x", "y", 300.0, F.expr("y - x > 50 and y - x < 300")).select("src", "dst", (F.col("y") - F.col("x")).alias("gap"))
    named = sequences.mass_lookup(gaps, "gap", r.residue_table(spark).select(F.col("sym").alias("seq"), F.col("mono").alias("mass")), 0.5)
    counts = named.groupBy("src", "dst").agg(F.count("*").alias("n"), F.first("seq").alias("only"))
    return gaps.join(counts, ["src", "dst"], "left").where("n is not null or gap > 250").select("src", "dst", F.when(F.col("n") == 1, F.col("only")).otherwise("-").alias("label"))


@query(f"""with {SEQ}, {LETTERS}, x as (select a.p_partkey, a.pos i, b.pos j from l a join l b on b.p_partkey = a.p_partkey + 1 and a.sym = b.sym), r as (select p_partkey, i - j diagonal, i, i - row_number() over (partition by p_partkey, i - j order by i) run from x)
select p_partkey, diagonal, min(i) as start, count(*) as length from r group by p_partkey, diagonal, run""")
def tag_runs(spark, d):
    l = _sequences(spark, d).select("p_partkey", F.posexplode(r.letters(F.col("seq"))).alias("i", "sym")).withColumn("i", (F.col("i") + 1).cast("long"))  # noqa: E741
    other = l.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("i").alias("j"), "sym")
    met = l.join(other, ["p_partkey", "sym"]).select("p_partkey", "i", "j")
    return sequences.tag_runs(t.dealt(met, "p_partkey", of=t.table(spark, d, "part"), per=20_000), "p_partkey")  # some twenty letters a part


@query("""with x as (select user_id, event_type = 'error' f, row_number() over (partition by user_id order by ts, event_id) - 1 i from events), y as (select user_id, i, i - row_number() over (partition by user_id order by i) run from x where f)
select user_id, min(i)::integer run_start, (max(i) + 1)::integer run_end from y group by user_id, run""")
def disagreement_regions(spark, d):
    return sequences.flag_runs(t.table(spark, d, "events").withColumn("flag", F.col("event_type") == "error"), "user_id", ["ts", "event_id"], "flag")
