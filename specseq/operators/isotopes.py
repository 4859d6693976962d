"""Deisotoping by envelopes: charge and monoisotopic peak by how well isotope ratios fit, tallest peaks first."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The proton as deisotoping takes it, the step between isotopes, and the mean residue's mass and carbons.
PROTON, STEP = 1.00727782, 13.00335483 - 12.0
RESIDUE_MASS, RESIDUE_CARBONS, MOST_CARBONS = 111.0, 5.1, 400
# Share of heavy carbon; places before and after a peak at which its monoisotopic peak is sought; peaks of an envelope that are compared.
HEAVY, BEFORE, AFTER, MOST_PEAKS, REACH = 0.0107, 5, 1, 5, 5
# Fixed value: how much farther than a window peaks are fetched before they are compared with it.
SLACK = 1e-6


@lru_cache(maxsize=512)
def isotope_ratios(carbons: int, n: int = 12) -> tuple[float, ...]:
    """Shares of the first n isotopes by the number of heavy ones among ``carbons``, 1 at least and MOST_CARBONS at most."""
    c = min(max(carbons, 1), MOST_CARBONS)
    return tuple(math.comb(c, k) * HEAVY**k * (1 - HEAVY) ** (c - k) for k in range(n))


def window_of(mz: float, ppm: float) -> float:
    return round(mz * ppm / 1e6, 6)


def middle(values: list[float]) -> float:
    """The middle value; of an even number over two, the mean of the two above the middle, as the stop rule has it; 0 of none."""
    x = sorted(values)
    if len(x) < 3:
        return sum(x) / len(x) if x else 0.0
    mid = len(x) // 2
    return x[mid] if len(x) % 2 else (x[mid] + x[min(mid + 1, len(x) - 1)]) / 2


# A window holds few peaks, so the functions below go through plain lists; an array's overhead would be most of their time.
def chi_square(observed: Sequence[float], expected: Sequence[float]) -> float:
    """Sum of squared differences over what is expected, where anything is."""
    total, some = 0.0, False
    for x, y in zip(observed, expected):
        if y > 0:
            some = True
            total += (x - y) * (x - y) / y
    return total if some else -1.0


def slope_score(observed: Sequence[float], expected: Sequence[float]) -> float:
    """(1 - |slope - 1|) times the squared correlation about 0: 1 if both are equal."""
    both = own = other = 0.0
    for x, y in zip(observed, expected):
        both += x * y
        own += x * x
        other += y * y
    return (1 - abs(both / own - 1)) * both * both / (own * other) if own and other else 0.0


def near(mz: list[float], at: float, ppm: float) -> list[int]:
    """Which of the sorted masses are within ppm of ``at``."""
    width = window_of(at, ppm)
    return [i for i in range(bisect_left(mz, at - width - SLACK), bisect_right(mz, at + width + SLACK)) if abs(mz[i] - at) <= width]


def near_any(mz: list[float], at: float, ppm: float) -> bool:
    """Whether near() finds any."""
    wide = at * ppm / 1e6 + SLACK + SLACK
    i, n, upto = bisect_left(mz, at - wide), len(mz), at + wide
    while i < n and mz[i] <= upto:
        if abs(mz[i] - at) <= window_of(at, ppm):
            return True
        i += 1
    return False


def envelope(mz: list[float], intensity: list[float], top: float, charge: int, ppm: float) -> tuple[list[float], list[float]]:
    """Masses and intensities at the places -REACH to REACH about the peak ``top``, as far as the last one that is found; 0 where none is. mz is sorted. Of several peaks at a place the tallest, then the lowest, counts."""
    masses, found, n = [], [], len(mz)
    for k in range(-REACH, REACH + 1):
        at = top + STEP * k / charge
        wide = at * ppm / 1e6 + SLACK + SLACK
        most, tallest, upto, some = at, 0.0, at + wide, False
        i = bisect_left(mz, at - wide)
        if i < n and mz[i] <= upto:  # most places are empty
            width = window_of(at, ppm)
            while i < n and mz[i] <= upto:
                x = intensity[i]
                if abs(mz[i] - at) <= width and (not some or x > tallest):
                    most, tallest, some = mz[i], x, True
                i += 1
        masses.append(most)
        found.append(tallest)
    while len(found) > 1 and not found[-1]:
        masses.pop()
        found.pop()
    return masses, found


def monoisotopic(masses: list[float], found: list[float], ratios: tuple[float, ...]) -> tuple[float, float] | None:
    """Mass and score of the envelope's likeliest first peak.

    Each peak from BEFORE places before the selected one to AFTER behind it is tried, with envelopes of five peaks
    down to three. The best slope score over all peaks in front too wins; one within a fifth of it takes its place
    if it has more peaks and less chi-square, both over the envelope alone and with the peaks in front.
    """
    tried: dict[float, dict[float, tuple[int, list[float], int]]] = {}
    size = len(found)
    for i in range(REACH - BEFORE, min(REACH + AFTER + 1, size)):
        if not found[i]:
            continue
        most, last = MOST_PEAKS, False
        while most >= 3 and not last and i - REACH + most - 1 >= 0:
            own, zeros, at = [], 0, i
            while at < size and len(own) < most and not zeros:
                x = found[at]
                zeros += x == 0
                if not zeros or len(own) <= 2:
                    own.append(x)
                at += 1
            if len(own) <= 2 and own[-1]:
                own.append(0.0)
            n = len(own)
            if n <= 3 or (n == 4 and not own[-1]):
                last = True
            elif n < MOST_PEAKS and most == MOST_PEAKS:
                most = n
            every = sum(found[:i] + own)
            # slope_score() of the shares of all peaks in front too, of which nothing is expected there.
            both = square = other = 0.0
            for x in found[:i]:
                x /= every
                square += x * x
            for x, y in zip(own, ratios):
                x /= every
                both += x * y
                square += x * x
                other += y * y
            score = (1 - abs(both / square - 1)) * both * both / (square * other) if square and other else 0.0
            tried.setdefault(score, {})[masses[i]] = (n - zeros, own, i)
            most -= 1

    def chi(own: list[float], i: int) -> tuple[float, float]:
        """chi_square() of an envelope alone and with the peaks in front."""
        expected, front = ratios[: len(own)], found[:i] + own
        one, every = sum(own), sum(front)
        return chi_square([x / one for x in own], expected), chi_square([x / every for x in front], (0.0,) * i + expected)

    best = mono = None
    beaten = False
    for score in sorted(tried, reverse=True):
        if beaten or (best and abs(best - score) / best >= 0.2):
            break  # nothing below can take its place
        for mass, (n, own, i) in tried[score].items():
            if best is None:
                best, mono = score, mass
            elif mass != mono and best and abs(best - score) / best < 0.2 and not beaten:
                m, *leader = tried[best][mono]
                if n > m:
                    (chi_own, chi_wide), (x, y) = chi(own, i), chi(*leader)
                    if chi_own < x and chi_wide < y:
                        best, mono, beaten = score, mass, True
    return None if best is None else (mono, best)


def charge_and_mono(mz: list[float], intensity: list[float], top: float, most_charge: int, ppm: float) -> tuple[int, float] | None:
    """The charge and first peak of the envelope about ``top``, None if no charge explains it.

    A charge is tried if so many neighbouring isotopes are there as it has units, less 2, and one at least. Charges whose scores are within
    a fifth of the best, or over 0.8, are accepted: the greatest of them is taken, with the first peak that the worst-scored one has.
    """
    usual = middle(intensity) or 1.0
    kept = [i for i, x in enumerate(intensity) if x / usual >= 0.01]
    mz, intensity = [mz[i] for i in kept], [intensity[i] for i in kept]
    scored: dict[float, tuple[int, float]] = {}
    for z in range(1, most_charge + 1):
        if not (near_any(mz, top + STEP / z, ppm) or near_any(mz, top - STEP / z, ppm)):
            continue  # no neighbour, whatever lies farther off
        masses, found = envelope(mz, intensity, top, z, ppm)
        run = 0
        for step in (-1, 1):
            at = REACH + step
            while 0 <= at < len(found) and found[at]:
                run += 1
                at += step
        if run < max(z - 2, 1):
            continue
        got = monoisotopic(masses, found, isotope_ratios(int((top * z - PROTON * z) / RESIDUE_MASS * RESIDUE_CARBONS)))
        if got:
            scored[got[1]] = (z, got[0])
    if not scored:
        return None
    order = sorted(scored, reverse=True)
    taken = [scored[s] for s in order if s == order[0] or (order[0] and abs(order[0] - s) / order[0] <= 0.2) or s > 0.8]
    return max(z for z, _ in taken), taken[-1][1]


def peeled(mz: np.ndarray, intensity: np.ndarray, precursor: float, most_charge: int, ppm: float = 25.0, window: tuple[float, float] = (4.4, 2.2), least: float = 1.0, failures: int = 5, noise: bool = True) -> list[tuple[float, float, str]]:
    """(mass, intensity, kind) of a spectrum without isotopes: mono for singly charged first peaks, noise for peaks that no envelope explains.

    The tallest peak's window is searched for its charge and first peak; that and the four isotopes behind it are taken out and
    added up at the singly charged mass, which must not exceed the precursor's. A mass within ppm of an earlier one joins it.
    Where none is found, the peak is noise. It ends when the tallest peak is less than ``least`` times the middle intensity, or
    when failures outnumber successes by more than ``failures``; what is left is noise. Each mass's intensity is the mean of what was added to it.
    """
    order = np.argsort(mz, kind="stable")
    mz, left = mz[order].astype(float).tolist(), intensity[order].astype(float).tolist()
    floor, behind = least * middle(left), 0
    total: dict[float, float] = {}
    times: dict[float, int] = {}
    kind: dict[float, str] = {}

    def add(mass: float, what: float, name: str) -> None:
        times[mass] = times.get(mass, 0) + 1
        total[mass] = total.get(mass, 0.0) + what
        kind.setdefault(mass, name)

    while mz and behind <= failures:
        tallest = max(left)
        if tallest < floor:
            break
        top = left.index(tallest)
        start, end = bisect_right(mz, mz[top] - window[0]), bisect_left(mz, mz[top] + window[1])
        got = charge_and_mono(mz[start:end], left[start:end], mz[top], most_charge, ppm)
        mass = got[1] * got[0] - (got[0] - 1) * PROTON if got else 0.0
        if got and mass <= precursor:
            behind = max(behind - 1, 0)
            gone = set()
            for k in range(5):
                at = got[1] + k * STEP / got[0]
                wide = at * ppm / 1e6 + SLACK + SLACK
                i, upto = max(start, bisect_left(mz, at - wide)), at + wide
                while i < end and mz[i] <= upto:
                    if abs(mz[i] - at) < window_of(at, ppm):
                        gone.add(i)
                    i += 1
            old = [m for m in total if abs(m - mass) < window_of(mass, ppm)]
            add(old[-1] if old else mass, sum(left[i] for i in sorted(gone)), "mono")
            mz, left = [x for i, x in enumerate(mz) if i not in gone], [x for i, x in enumerate(left) if i not in gone]
        else:
            behind += 1
            if noise:
                add(mz[top], tallest, "noise")
            del mz[top], left[top]
    if noise:
        for m, x in zip(mz, left, strict=True):
            add(m, x, "noise")
    return [(m, total[m] / times[m], kind[m]) for m in sorted(total)]


def deisotope_envelopes(peaks: DataFrame, precursors: DataFrame, most_charge: int = 3, ppm: float = 25.0, noise: bool = True) -> DataFrame:
    """scan, mz, intensity, kind: peeled() of each scan's peaks (scan, mz, intensity); precursors has scan and total, the singly charged precursor's mass. Peaks without a mass or an intensity, and scans without a precursor, are left out."""
    whole = peaks.where("mz is not null and intensity is not null").groupBy("scan").agg(F.sort_array(F.collect_list(F.struct(F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity")))).alias("peaks"))  # a scan's peaks
    rows = whole.join(precursors.where("total is not null").select("scan", F.col("total").cast("double").alias("total")), "scan").select(F.col("scan").cast("long").alias("scan"), F.col("peaks.mz").alias("mz"), F.col("peaks.intensity").alias("intensity"), "total")

    def run(batches):
        for batch in batches:
            out = []
            for scan, mz, intensity, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(scan, *x) for x in peeled(np.array(mz), np.array(intensity), total, most_charge, ppm, noise=noise)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.string()), strict=True)], names=["scan", "mz", "intensity", "kind"])

    return rows.mapInArrow(run, "scan long, mz double, intensity double, kind string")


def one_charge(peaks: DataFrame, precursors: DataFrame, share: float = 0.95) -> DataFrame:
    """scan, singly_charged: whether at least ``share`` of a scan's intensity lies at or below its precursor's m/z (true if it has none). precursors has scan and total."""
    sums = peaks.join(precursors, "scan").groupBy("scan").agg(F.sum("intensity").alias("_all"), F.sum(F.when(F.col("mz") <= F.col("total"), F.col("intensity")).otherwise(0)).alias("_low"))
    return sums.select("scan", ((F.col("_all") <= 0) | (F.col("_low") / F.col("_all") >= share)).alias("singly_charged"))


def charge_guesses(peaks: DataFrame, precursors: DataFrame) -> DataFrame:
    """scan, charge: the charge that precursors (scan, total, charge) state; for a null one 1 if one_charge() says so, else both 2 and 3."""
    seen = precursors.join(one_charge(peaks, precursors.select("scan", "total")), "scan")
    guess = F.when(F.col("charge").isNotNull(), F.array("charge")).when(F.col("singly_charged"), F.array(F.lit(1))).otherwise(F.array(F.lit(2), F.lit(3)))
    return seen.select("scan", F.explode(guess).alias("charge"))
