"""Sequences against references: shared tags, chains of tags with the masses between them, affine alignments with their tracebacks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.residues import letters, prefix_masses
from .ranges import range_join
from .sequences import tag_runs

#: What an interval between tags costs by the way it is explained; an undefined shift is a mass that nothing explains.
PENALTIES = {"none": 0.0, "isobaric": -0.5, "modified": -1.0, "insertion": -2.0, "deletion": 0.0, "undefined": -3.0}
SPOT = ["after", "before", "b_from", "b_to"]


def _strings(rows: DataFrame, key: str, sequence: str, size: int, place: str) -> DataFrame:
    """key, place (from 0), string: every string of ``size`` letters of a sequence; none of null or of a shorter one."""
    last = F.length(sequence) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return rows.select(key, sequence, F.explode(starts).alias(place)).select(key, place, F.substr(sequence, F.col(place) + 1, F.lit(size)).alias("_string"))


def shared_tags(pairs: DataFrame, key: str, a: str, b: str, size: int = 3, ambiguous: str = "X") -> DataFrame:
    """key, tag (from 0 by its places), a_start, a_end, b_start, b_end (from 0, ends not included): runs of strings of ``size`` letters that both sequences of a pair have.

    Strings with the ambiguous letter are no tags. Strings that follow each other at once in both sequences make one tag. key is unique; a pair
    with a null or without a shared string has no tags.
    """
    one = _strings(pairs, key, a, size, "i").where(~F.col("_string").contains(ambiguous))
    met = one.join(_strings(pairs, key, b, size, "j"), [key, "_string"])
    start, other = F.col("start"), F.col("start") - F.col("diagonal")
    runs = tag_runs(met, key).select(key, start.alias("a_start"), (start + F.col("length") + size - 1).cast("int").alias("a_end"), other.alias("b_start"), (other + F.col("length") + size - 1).cast("int").alias("b_end"))
    return runs.withColumn("tag", F.row_number().over(Window.partitionBy(key).orderBy("a_start", "b_start")) - 1)


def greedy_tags(tags: DataFrame, key: str) -> DataFrame:
    """The tags that are taken one by one from the longest (the first of equally long ones), each if it shares no place of either sequence with one taken before."""
    spot = F.struct((F.col("a_start") - F.col("a_end")).alias("less"), "a_start", "a_end", "b_start", "b_end", "tag")
    lists = tags.groupBy(key).agg(F.array_sort(F.collect_list(spot)).alias("_all"))  # tags of one pair, as many as its lengths allow

    def take(taken: Column, x: Column) -> Column:
        meets = F.exists(taken, lambda t: ((t["a_start"] < x["a_end"]) & (x["a_start"] < t["a_end"])) | ((t["b_start"] < x["b_end"]) & (x["b_start"] < t["b_end"])))
        return F.when(meets, taken).otherwise(F.concat(taken, F.array(x)))

    return lists.select(key, F.inline(F.aggregate("_all", F.slice("_all", 1, 0), take))).select(*tags.columns)


def marked(pairs: DataFrame, tags: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, a, b: both sequences with stars around the tags, which must not overlap; a pair without tags stays as it is."""
    lists = tags.groupBy(key).agg(F.collect_list(F.struct("a_start", "a_end")).alias("_a"), F.collect_list(F.struct("b_start", "b_end")).alias("_b"))

    def starred(sequence: str, spots: str, start: str, end: str) -> Column:
        at = lambda i: F.concat(F.when(F.exists(spots, lambda t: t[end] == i), "*").otherwise(""), F.when(F.exists(spots, lambda t: t[start] == i), "*").otherwise(""))
        whole = F.array_join(F.transform(letters(F.col(sequence)), lambda c, i: F.concat(at(i), c)), "")
        return F.when(F.col(spots).isNull(), F.col(sequence)).otherwise(F.concat(whole, at(F.length(sequence)))).alias(sequence)

    return pairs.join(lists, key, "left").select(key, starred(a, "_a", "a_start", "a_end"), starred(b, "_b", "b_start", "b_end"))


def tag_intervals(pairs: DataFrame, tags: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, after, before, a_from, a_to, b_from, b_to: what may stand between two tags of a chain.

    after and before are the tags at both sides, -1 at an end. Sequence a is used from its start to its end, the
    reference b from any place to any other, so an interval at an end comes with every such place.
    """
    sizes = pairs.select(key, F.length(a).alias("_na"), F.length(b).alias("_nb"))
    none, whole = F.lit(-1), tags.join(sizes, key)
    first = tags.select(key, none.alias("after"), F.col("tag").alias("before"), F.lit(0).alias("a_from"), F.col("a_start").alias("a_to"), F.explode(F.sequence(F.lit(0), "b_start")).alias("b_from"), F.col("b_start").alias("b_to"))
    last = whole.select(key, F.col("tag").alias("after"), none.alias("before"), F.col("a_end").alias("a_from"), F.col("_na").alias("a_to"), F.col("b_end").alias("b_from"), F.explode(F.sequence("b_end", "_nb")).alias("b_to"))
    left = tags.select(key, F.col("tag").alias("after"), F.col("a_end").alias("a_from"), F.col("b_end").alias("b_from"))
    right = tags.select(key, F.col("tag").alias("before"), F.col("a_start").alias("a_to"), F.col("b_start").alias("b_to"))
    inner = left.join(right, key).where("a_from <= a_to and b_from <= b_to")  # tags of one pair
    return first.unionByName(last).unionByName(inner)


def explained_intervals(intervals: DataFrame, pairs: DataFrame, key: str, a: str, b: str, modifications: DataFrame, tolerance: float, a_masses: Column | None = None) -> DataFrame:
    """intervals with a_part, b_part, a_mass, b_mass, change (a name in PENALTIES) and mods, the modifications that explain it.

    Nothing on both sides is "none", on one side "insertion" or "deletion"; equal masses are "isobaric". Otherwise a modification (mod, site, position, mass)
    explains the interval if its mass is the difference and its site is there: anywhere, or, where its position is N-term or C-term, at that end of an
    interval at that end; a site N-term or C-term is that end itself. Else the change is "undefined". a_masses (from 0 to the whole, one more than letters)
    gives masses of a that has modified residues.
    """
    known = pairs.select(key, F.col(a).alias("_a"), F.col(b).alias("_b"), (prefix_masses(F.col(a)) if a_masses is None else a_masses).alias("_am"), prefix_masses(F.col(b)).alias("_bm"))
    part = lambda s, i, j: F.substr(F.col(s), F.col(i) + 1, F.col(j) - F.col(i))
    mass = lambda m, i, j: F.get(F.col(m), F.col(j)) - F.get(F.col(m), F.col(i))
    rows = intervals.join(known, key).select(
        *intervals.columns, part("_a", "a_from", "a_to").alias("a_part"), part("_b", "b_from", "b_to").alias("b_part"), mass("_am", "a_from", "a_to").alias("a_mass"), mass("_bm", "b_from", "b_to").alias("b_mass")
    )
    rows = rows.withColumns({"_term": F.when(F.col("after") < 0, "N-term").when(F.col("before") < 0, "C-term").otherwise(""), "_shift": F.col("a_mass") - F.col("b_mass")})
    both = (F.col("a_part") != "") & (F.col("b_part") != "")
    end = F.when(F.col("_term") == "N-term", F.substring("b_part", 1, 1)).otherwise(F.substring("b_part", -1, 1))
    fits = (F.col("site") == F.col("_term")) | (F.col("b_part").contains(F.col("site")) & ((F.col("position") == "Anywhere") | ((F.col("position") == F.col("_term")) & (end == F.col("site")))))
    open_ = rows.where(both & (F.abs("_shift") >= tolerance))
    named = modifications.select("mod", "site", "position", F.col("mass").alias("_mass"))
    near = range_join(open_, named, "_shift", "_mass", tolerance, fits & (F.abs(F.col("_shift") - F.col("_mass")) < tolerance))
    mods = near.groupBy(key, *SPOT).agg(F.array_sort(F.collect_set("mod")).alias("mods"))
    change = (
        F.when((F.col("a_part") == "") & (F.col("b_part") == ""), "none").when(F.col("b_part") == "", "insertion").when(F.col("a_part") == "", "deletion")
        .when(F.abs("_shift") < tolerance, "isobaric").when(F.col("mods").isNotNull(), "modified").otherwise("undefined")
    )
    return rows.join(mods, [key, *SPOT], "left").withColumn("change", change).drop("_term", "_shift")


def scored_intervals(explained: DataFrame, tags: DataFrame, pairs: DataFrame, key: str, a: str, scores: Column, penalties: dict[str, float] | None = None) -> DataFrame:
    """explained with ``score``: the evidence of the tag behind an interval, the evidence of what is inserted and the change's penalty.

    scores is an array over the places of a, from 0 to its length. A tag has the sum over its places, both ends included but for
    the ends of the sequence; an insertion has the sum over the places within.
    """
    cost = F.create_map(*[F.lit(x) for kv in (penalties or PENALTIES).items() for x in kv])
    total = lambda i, n: F.aggregate(F.slice("_scores", i + 1, F.greatest(n, F.lit(0))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    known = pairs.select(key, F.length(a).alias("_n"), scores.cast("array<double>").alias("_scores"))
    low, high = F.greatest("a_start", F.lit(1)), F.least(F.col("a_end"), F.col("_n") - 1)
    of_tags = tags.join(known, key).select(key, F.col("tag").alias("before"), total(low, high - low + 1).alias("_tag"))
    inside = F.when(F.col("change") == "insertion", total(F.col("a_from") + 1, F.col("a_to") - F.col("a_from") - 1)).otherwise(0.0)
    rows = explained.join(known, key).join(of_tags, [key, "before"], "left")
    return rows.select(*explained.columns, (F.coalesce("_tag", F.lit(0.0)) + inside + cost[F.col("change")]).alias("score"))


def best_chains(scored: DataFrame, key: str) -> DataFrame:
    """key, score, b_from, b_to, steps: the best chain of tags of each pair from the start of a to its end, where pairs have one.

    steps lists the intervals with after, before, change, mods, a_part, b_part and shift. Of equal intervals between the same tags that with
    the shortest part of the reference is taken, of equal chains, read from the end, the one through the last tag, so a tag is used rather than inserted.
    """
    spot = ["after", "before", "b_from", "b_to", "change", "mods", "a_part", "b_part", (F.col("a_mass") - F.col("b_mass")).alias("shift")]
    best = scored.groupBy(key, F.col("after").alias("_p"), F.col("before").alias("_q")).agg(F.max_by(F.struct(*spot, "score"), F.struct("score", F.col("b_from") - F.col("b_to"))).alias("_x"))
    lists = best.groupBy(key).agg(F.collect_list("_x").alias("_x"))  # at most the square of a pair's tags
    kind = dict((f.name, f.dataType.simpleString()) for f in scored.schema)[key]
    fields = "after int, before int, change string, mods array<string>, a_part string, b_part string, shift double"

    def chain(steps: list[dict]) -> tuple[float, list[dict]] | None:
        into: dict[int, list[dict]] = {}
        for s in steps:
            into.setdefault(s["before"], []).append(s)
        reached: dict[int, tuple[float, dict | None]] = {-1: (0.0, None)}
        for tag in [*sorted(t for t in into if t >= 0), None]:
            found = [(reached[s["after"]][0] + s["score"], s["after"], s) for s in into.get(-1 if tag is None else tag, []) if s["after"] in reached and (tag is not None or s["after"] >= 0)]
            if found:
                score, _, step = max(found, key=lambda f: f[:2])
                reached["end" if tag is None else tag] = (score, step)
        if "end" not in reached:
            return None
        score, step = reached["end"]
        path = [step]
        while path[-1]["after"] >= 0:
            path.append(reached[path[-1]["after"]][1])
        return score, path[::-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in fields.split(", ")]
        for pdf in frames:
            out = []
            for k, steps in zip(pdf[key], pdf["_x"], strict=True):
                found = chain([dict(s) for s in steps])
                if found:
                    score, path = found
                    plain = [{n: (list(s[n]) if n == "mods" and s[n] is not None else s[n]) for n in names} for s in path]
                    out.append((k, score, path[0]["b_from"], path[-1]["b_to"], plain))
            yield pd.DataFrame(out, columns=[key, "score", "b_from", "b_to", "steps"])

    return lists.mapInPandas(run, f"`{key}` {kind}, score double, b_from int, b_to int, steps array<struct<{fields.replace(' ', ':').replace(',:', ', ')}>>")


def tag_alignments(pairs: DataFrame, key: str, a: str, b: str, modifications: DataFrame, scores: Column, size: int = 2, tolerance: float = 0.02, penalties: dict[str, float] | None = None) -> DataFrame:
    """best_chains() of the shared tags of each pair (key unique, sequence a, reference b), intervals explained by mass. A pair without a tag, with a null or with a letter that is no residue beside its tags' places has no row or undefined shifts."""
    tags = shared_tags(pairs, key, a, b, size)
    explained = explained_intervals(tag_intervals(pairs, tags, key, a, b), pairs, key, a, b, modifications, tolerance)
    return best_chains(scored_intervals(explained, tags, pairs, key, a, scores, penalties), key)


def affine_batch(a: list[str], b: list[str], match: float, mismatch: float, opening: float, extending: float, table: dict[tuple[str, str], float] | None = None) -> list[tuple[float, str, str]]:
    """Score and both rows of the best global alignment of each pair, all pairs side by side. A gap of n costs opening + n * extending."""
    n = len(a)
    la, lb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    rows, cols = int(la.max(initial=0)), int(lb.max(initial=0))
    code = {c: i + 1 for i, c in enumerate(sorted({c for s in (*a, *b) for c in s}))}
    worth = np.full((len(code) + 1, len(code) + 1), float(mismatch))
    np.fill_diagonal(worth, match)
    for (x, y), w in (table or {}).items():
        if x in code and y in code:
            worth[code[x], code[y]] = w
    coded = lambda strings, width: np.array([[code[c] for c in s] + [0] * (width - len(s)) for s in strings], np.int32).reshape(n, width).T
    ca, cb = coded(a, rows), coded(b, cols)
    low = -1e18
    # States by the last column: a pair, a gap in b, a gap in a.
    now = np.full((3, cols + 1, n), low)
    now[0, 0] = 0.0
    came = np.zeros((3, rows + 1, cols + 1, n), np.int8)
    ends = np.full((3, n), low)
    each = np.arange(n)

    def step(before: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        cost = np.full((3, 1), opening + extending)
        cost[gap] = extending
        total = before + cost
        at = total.argmax(0)
        return total[at, each], at

    for i in range(rows + 1):
        if i:
            up, now = now, np.full((3, cols + 1, n), low)
            for j in range(cols + 1):
                now[1, j], came[1, i, j] = step(up[:, j], 1)
                if j:
                    at = up[:, j - 1].argmax(0)
                    now[0, j], came[0, i, j] = up[:, j - 1][at, each] + worth[ca[i - 1], cb[j - 1]], at
                    now[2, j], came[2, i, j] = step(now[:, j - 1], 2)
        else:
            for j in range(1, cols + 1):
                now[2, j], came[2, 0, j] = step(now[:, j - 1], 2)
        done = np.nonzero(la == i)[0]
        ends[:, done] = now[:, lb[done], done]
    out = []
    for k in range(n):
        i, j, state = len(a[k]), len(b[k]), int(ends[:, k].argmax())
        top, bottom = [], []
        while i or j:
            before = int(came[state, i, j, k])
            top.append("-" if state == 2 else a[k][i - 1])
            bottom.append("-" if state == 1 else b[k][j - 1])
            i, j, state = i - (state != 2), j - (state != 1), before
        out.append((float(ends[:, k].max()), "".join(reversed(top)), "".join(reversed(bottom))))
    return out


def affine_alignments(pairs: DataFrame, a: str, b: str, match: float = 1.0, mismatch: float = -1.0, opening: float = -4.0, extending: float = -2.0, table: dict[tuple[str, str], float] | None = None, cells: int = 4_000_000) -> DataFrame:
    """pairs with score, a_row and b_row: the best global alignment with affine gaps, gaps as "-".

    table has scores of pairs of letters that differ from match and mismatch. Of equally good alignments that is given which, read from its end, has a
    pair of letters before a gap in b, and that before a gap in a. Null where a sequence is null; two empty ones align with score 0. ``cells``
    bounds the cells that are held at once; one pair alone takes the product of its lengths.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            whole = [k for k, (x, y) in enumerate(zip(pdf[a], pdf[b], strict=True)) if x is not None and y is not None]
            whole.sort(key=lambda k: (len(pdf[a].iat[k]), len(pdf[b].iat[k])))
            found: list[tuple] = [(None, None, None)] * len(pdf)
            while whole:
                size, widest, tallest = 0, 1, 1
                for k in whole:  # as many pairs, from the shortest, as fit
                    widest, tallest = max(widest, len(pdf[a].iat[k]) + 1), max(tallest, len(pdf[b].iat[k]) + 1)
                    if size and (size + 1) * widest * tallest > cells:
                        break
                    size += 1
                part, whole = whole[:size], whole[size:]
                for k, x in zip(part, affine_batch([pdf[a].iat[k] for k in part], [pdf[b].iat[k] for k in part], match, mismatch, opening, extending, table), strict=True):
                    found[k] = x
            yield pdf.assign(**{name: pd.Series([f[c] for f in found], dtype="float64" if name == "score" else "object") for c, name in enumerate(("score", "a_row", "b_row"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, f"{schema}, score double, a_row string, b_row string")


def differing_regions(aligned: DataFrame, key: str, top: str = "a_row", bottom: str = "b_row") -> DataFrame:
    """key, start, end, a_from, a_to, b_from, b_to (from 0, ends not included): runs of columns in which the rows of an alignment differ, and where they lie in both sequences. key is unique; equal or null rows have none."""
    columns = aligned.select(key, F.posexplode(F.arrays_zip(letters(F.col(top)).alias("x"), letters(F.col(bottom)).alias("y"))).alias("at", "z")).select(key, "at", "z.x", "z.y")
    seen = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = columns.withColumns({"_a": F.count_if(F.col("x") != "-").over(seen), "_b": F.count_if(F.col("y") != "-").over(seen), "_run": F.count_if(F.col("x") == F.col("y")).over(seen)})
    before = lambda n, c: (F.min(F.col(n) - (F.col(c) != "-").cast("int"))).cast("int")
    return placed.where("x <> y").groupBy(key, "_run").agg(
        F.min("at").alias("start"), (F.max("at") + 1).alias("end"), before("_a", "x").alias("a_from"), F.max("_a").cast("int").alias("a_to"), before("_b", "y").alias("b_from"), F.max("_b").cast("int").alias("b_to")
    ).drop("_run")
