"""Implausible spikes in measurements: impossible, spiking and stuck readings per source.

Method. Each source's field is followed by a Kalman filter of a local-level
state-space model: every reading is predicted, its innovation is divided by the
deviation that the filter expects, and the update is withheld for every flagged
reading. The state goes on over days and blocks.

* impossible: the state is a load that a connection can carry, so a reading outside
  what it can deliver has likelihood zero, whatever its innovation.
* spike: the innovation, divided by its standard deviation, lies above a threshold.
  A streak of flagged readings as long as a lasting load is taken as a new level and
  its flags are withdrawn; an impossible reading ends the streak.
* stuck: for successive innovations e and the gain K of the filter (zero where the
  update is withheld) e[t] - (1 - K[t-1]) e[t-1] are the whitened innovations. Where
  their running variance over a run of readings vanishes, the meter repeats itself.

Exact check. A flagged reading is a spike only if it belongs to a set of brief
excursions all of which are more than ``ratio`` times as high as anything else
the source's field reads; a stuck run only if it has ``stuck`` equal readings.

No spike is lost by the threshold: ordinary readings lie in [0, M], the level is
a mean of ordinary readings, so it is at most M, while a spike lies above 2 M:
its innovation exceeds M. The level is never less certain than a reading drawn from
all those below the lowest gap, so the innovation variance is at most theirs, which
is at most M^2/4, and the standardised innovation of a spike exceeds 2, the threshold. If
they are all equal, as for an appliance that is off, (g/4)^2 stands for their variance,
where g is the lowest reading above the gap: a spike's innovation exceeds g/2. No flag of a spike is withdrawn: a
streak is a stretch of successive readings, so ten of them are never all spikes; its
lowest reading is then an ordinary one, and a spike is more than twice as high. No
stuck run is lost: equal readings differ by zero, and rounding stays far below the
tolerance.

Scale: readings are hashed once by (source, time block) and filtered block by block.
A source is one block unless it has more than ``block`` readings; then its blocks are
of so many days that they hold about as many (one day at least), and each is led by
the last eighth of the span before it, in which the filter only finds its state: 25
updates leave less than 1e-19 of the state it starts with. Blocks without readings
there, after a gap of hours, start like a series from the source's own normal mean
and variance, which travel in one header row a block. Those come from a histogram per
source (quarter octaves, at most some hundred rows a source) with map-side combine.
Runs over block ends are merged from a few rows a block.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.columns import CONNECTION_LIMIT_W, DAY_US, POWER_STAND_INS, floor_to, from_micros, measured, micros
from voltloom.operators.joins import lookup_join, spread_join
from voltloom.operators.runs import merge_runs
from voltloom.session import cut

OUT = "kind string, k string, f int, b long, pos int, t long, v double, z double, run long, n int, touch_start boolean, touch_end boolean"

#: Variances of the level's steps and of a reading around the level, in units of the source's normal variance.
PROCESS, NOISE = 0.25, 0.05
#: Prior variance and gain of the filter in its steady state, and the taps after which a reading's weight is below rounding.
STEADY = (PROCESS + (PROCESS * PROCESS + 4 * PROCESS * NOISE) ** 0.5) / 2
GAIN = STEADY / (STEADY + NOISE)
TAPS = int(np.ceil(-16 / np.log10(1 - GAIN))) + 1
#: Readings of a source that make one block.
BLOCK = 20_000
#: Mean, variance and gaps of a field without a possible reading.
NO_HEAD = (0.0, 0.0, [])
#: Whitened innovations below this part of the reading have vanished.
VANISHED = 1e-9


def follow(y: list[float], mean: float, var: float, threshold: float, brief: int) -> tuple[list[float], list[float], list[float], list[int]]:
    """The local-level filter over a series: predicted level, innovation variance and gain per reading, and the flagged readings.

    y: readings, -1 for impossible ones, which are predicted, too, and end a streak.
    """
    process, noise, most = PROCESS * var, NOISE * var, (1 - NOISE) * var
    reach = threshold * threshold
    level, p = mean, most
    levels, spreads, gains, flagged, streak = [], [], [], set(), []
    for i, v in enumerate(y):
        p += process
        if p > most:
            p = most
        s = p + noise
        levels.append(level)
        spreads.append(s)
        e = v - level
        gain = 0.0
        if v < 0:
            streak = []
        elif e > 0 and e * e > reach * s:
            flagged.add(i)
            streak.append(i)
            if len(streak) >= brief:  # a load that lasts: its lowest reading is the new level
                low = min(y[j] for j in streak)
                flagged.difference_update(j for j in streak if y[j] <= 2 * low)
                gain = (low - level) / e
                level, p, streak = low, most, []
        else:
            if streak:
                streak = []
            gain = p / s if s > 0 else 1.0
            level += gain * e
            p *= 1 - gain
        gains.append(gain)
    return levels, spreads, gains, sorted(flagged)


def steady_innovations(y: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Innovations of the filter with its steady-state gain over series laid end to end: what ``follow`` comes to where nothing is flagged.

    y: readings; new: whether a reading starts a series, whose level starts at it. The
    level before a reading is the sum of the readings before it, weighted by powers of
    one minus the gain.
    """
    n = len(y)
    at = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    level = np.zeros(n)
    keep = 1.0
    for j in range(1, min(TAPS, int(at.max(initial=0))) + 1):
        inside = at >= j
        first = at == j  # the series' own start bears all weight that is left
        w = np.where(first, keep, GAIN * keep)[j:]
        level[j:] += np.where(inside[j:], w * y[:-j], 0.0)
        keep *= 1 - GAIN
    return np.where(new, 0.0, y - level)


def _gap_parts(k: str, f: int, b: int, rep: np.ndarray, ok: np.ndarray, gaps: list[float], out: list) -> None:
    """What one block says of excursions above each gap."""
    if not ok.any():  # nothing possible: every excursion ends here
        out.extend(("gap", k, f, b, 0, None, gap, None, 0, 0, False, False) for gap in gaps)
        return
    y, where = rep[ok], np.flatnonzero(ok)
    for gap in gaps:  # an impossible reading ends an excursion
        high = y >= gap
        if not high.any():
            out.append(("gap", k, f, b, 0, None, gap, None, 0, 0, False, False))
            continue
        turn = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (where[1:] != where[:-1] + 1)])
        stop = np.r_[turn[1:], len(y)]
        runs = [(a, z) for a, z in zip(turn.tolist(), stop.tolist(), strict=True) if high[a]]
        inner = max((z - a for a, z in runs if a > 0 and z < len(y)), default=0)
        for a, z in runs:
            if a == 0 or z == len(y):
                out.append(("gap", k, f, b, 2 if a else 0, None, gap, None, a, z - a, a == 0 and where[0] == 0, z == len(y) and where[-1] == len(rep) - 1))
        if len(runs) > 1 or runs[0] != (0, len(y)):
            out.append(("gap", k, f, b, 1, None, gap, None, 0, inner, False, False))


def _blocks(k: np.ndarray, b: np.ndarray, t: np.ndarray, fields: list[np.ndarray], block: np.ndarray, led: np.ndarray, heads: dict[int, dict], limit: float, stuck: int, brief: int, threshold: float) -> pd.DataFrame:
    """Everything the whole blocks of a batch say.

    k, b: source and start per block; t, fields, block (its number), led (whether it only
    leads to the block): one entry a row, sorted by block and time. heads: per block
    number and field the normal mean, variance and gaps.
    """
    parts: list[dict] = []
    out: list[tuple] = []

    def add(kind: str, f: int, blk: np.ndarray, **cols: object) -> None:
        if len(blk):
            parts.append({"kind": kind, "k": k[blk], "f": f, "b": b[blk], "pos": 0, "t": pd.NA, "v": np.nan, "z": np.nan, "run": 0, "n": 1, "touch_start": False, "touch_end": False, **cols})

    for f, raw in enumerate(fields):
        known = np.flatnonzero(~np.isnan(raw))
        if not len(known):
            continue
        tk, vk, bk, lk = t[known], raw[known], block[known], led[known]
        possible = (vk >= 0) & (vk <= limit)
        fresh = np.r_[True, (tk[1:] != tk[:-1]) | (bk[1:] != bk[:-1])]
        starts = np.flatnonzero(fresh)
        tt, bb, own = tk[starts], bk[starts], ~lk[starts]
        best = np.maximum.reduceat(np.where(possible, vk, -np.inf), starts)
        ok = best >= 0
        rep = np.where(ok, best, np.maximum.reduceat(vk, starts))
        first = np.flatnonzero(np.r_[True, bb[1:] != bb[:-1]])

        # the filter over each block's readings
        level, spread, gain, high = [], [], [], []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(rep)], strict=True):
            mean, var, _ = heads.get(int(bb[lo]), {}).get(f, NO_HEAD)
            levels, spreads, gains, flagged = follow(np.where(ok[lo:hi], rep[lo:hi], -1.0).tolist(), mean, var, threshold, brief)
            level += levels
            spread += spreads
            gain += gains
            high += [lo + i for i in flagged]
        level, deviation, gain = np.array(level), np.sqrt(np.maximum(spread, 1e-12)), np.array(gain)
        e = np.where(ok, rep, 0.0) - np.where(ok, level, 0.0)
        flag = np.zeros(len(rep), bool)
        flag[high] = True

        bad = ~possible & ~lk
        at = (np.cumsum(fresh) - 1)[bad]
        add("impossible", f, bk[bad], t=tk[bad], v=vk[bad], z=(vk[bad] - level[at]) / deviation[at])

        # stuck: the running variance of the whitened innovations vanishes
        whitened = np.r_[0.0, e[1:] - (1 - gain[:-1]) * e[:-1]]
        near = np.r_[False, ok[1:] & ok[:-1] & own[1:] & own[:-1] & (bb[1:] == bb[:-1])]
        still = near & (np.abs(whitened) <= VANISHED * np.maximum(1.0, np.abs(rep)))
        rep, tt, bb, ok, still, flag, z = rep[own], tt[own], bb[own], ok[own], still[own], flag[own], (e / deviation)[own]
        n = len(rep)
        if not n:
            continue
        moves = np.r_[0, np.cumsum(~still)]
        quiet = np.r_[np.zeros(min(stuck - 1, n), bool), moves[stuck:] == moves[1 : n - stuck + 2]] if n >= stuck else np.zeros(n, bool)
        new = np.r_[True, bb[1:] != bb[:-1]]
        last = np.r_[new[1:], True]
        same = still & np.r_[False, rep[1:] == rep[:-1]]
        a = np.flatnonzero(~same)
        end = np.r_[a[1:], n]
        length, at_start, at_end = end - a, new[a], last[end - 1]
        held = at_start | at_end | quiet[end - 1]
        a, length, at_start, at_end = a[held], length[held], at_start[held], at_end[held]
        add("run", f, bb[a], pos=a, v=rep[a], run=a, n=length, touch_start=at_start, touch_end=at_end)
        moving = (rep[a] != 0) & ok[a]
        rows = np.repeat(a[moving], length[moving]) + np.arange(length[moving].sum()) - np.repeat(np.cumsum(length[moving]) - length[moving], length[moving])
        add("frozen", f, bb[rows], t=tt[rows], v=rep[rows], z=z[rows], run=np.repeat(a[moving], length[moving]))

        first = np.flatnonzero(new)
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
            blk = int(bb[lo])
            gaps = heads.get(blk, {}).get(f, NO_HEAD)[2]
            if gaps:
                _gap_parts(k[blk], f, int(b[blk]), rep[lo:hi], ok[lo:hi], gaps, out)
                flag[lo:hi] &= rep[lo:hi] >= gaps[0]
            else:
                flag[lo:hi] = False
        add("spike", f, bb[flag], t=tt[flag], v=rep[flag], z=z[flag])
    names = [x.split()[0] for x in OUT.split(", ")]
    frames = [pd.DataFrame(p)[names] for p in parts]
    if out:
        frames.append(pd.DataFrame(out, columns=names))
    frames = [x.astype({"t": "Int64", "v": "float64", "z": "float64"}) for x in frames]
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=names)


def _scan(fields: int, limit: float, stuck: int, brief: int, threshold: float):
    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        k, b = pdf["k"].to_numpy(), pdf["b"].to_numpy()
        new = np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])]
        first, block = np.flatnonzero(new), np.cumsum(new) - 1
        heads = {}
        text = pdf["head"]
        for i in np.flatnonzero(text.notna().to_numpy()).tolist():
            heads[int(block[i])] = {int(x["f"]): (x.get("mean", 0.0), x.get("var", 0.0), sorted(x.get("gaps", []))) for x in json.loads(text.iat[i])}
        reading = pdf["t"].notna().to_numpy()
        rows = pdf[reading]
        values = [rows[f"v{i}"].to_numpy(dtype="float64") for i in range(fields)]
        return _blocks(k[first], b[first], rows["t"].to_numpy(dtype="int64"), values, block[reading], rows["led"].to_numpy(dtype=bool), heads, limit, stuck, brief, threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the block that may go on in the next batch
        for pdf in batches:
            if pdf.empty:
                continue
            k, b = pdf["k"].to_numpy(), pdf["b"].to_numpy()
            if held and (k[-1], b[-1]) == (held[0]["k"].iat[0], held[0]["b"].iat[0]):
                held.append(pdf)
                continue
            tail = int(np.flatnonzero((k != k[-1]) | (b != b[-1]))[-1] + 1) if (k[0], b[0]) != (k[-1], b[-1]) else 0
            done = whole(pd.concat([*held, pdf.iloc[:tail]], ignore_index=True)) if held or tail else None
            held = [pdf.iloc[tail:]]
            if done is not None and len(done):
                yield done
        if held:
            done = whole(pd.concat(held, ignore_index=True))
            if len(done):
                yield done

    return run


def implausible_readings(
    df: DataFrame,
    key: str,
    ts: str,
    fields: Mapping[str, Column],
    *,
    stand_ins: Sequence[float] = POWER_STAND_INS,
    limit: float = CONNECTION_LIMIT_W,
    ratio: float = 2.0,
    brief: int = 10,
    stuck: int = 20,
    threshold: float = 2.0,
    block: int = BLOCK,
) -> DataFrame:
    """key, ts, field, reason ('impossible', 'spike', 'stuck'), value, z (standardised innovation): one row per flagged reading and reason.

    impossible: below zero, infinite or above ``limit``. spike: in excursions of fewer
    than ``brief`` successive readings, all more than ``ratio`` times as high as anything
    else of the source's field. stuck: at least ``stuck`` successive readings of one
    nonzero value.

    z: the reading's innovation in units of the deviation that the filter expects of it.
    block: readings of a source that are filtered as one series in one task; larger
    sources are cut by time.

    Defined cases: null, NaN and stand-in numbers are not readings and do not end a run;
    impossible readings end an excursion and a run and are never 'anything else' nor stuck. Rows of one
    timestamp count once in runs, with their largest possible value, while each of their
    values may be impossible. Rows with a null key or time are ignored. A field with only
    one value has no spike. An empty table gives an empty result; other columns are ignored.
    """
    names = list(fields)
    cols = [measured(c.cast("double"), stand_ins).alias(f"v{i}") for i, c in enumerate(fields.values())]
    rows = df.select(F.col(key).cast("string").alias("k"), micros(ts).alias("t"), *cols).where("k is not null and t is not null")
    rows = rows.where(F.coalesce(*[F.col(f"v{i}") for i in range(len(names))]).isNotNull())

    long = rows.select("k", floor_to(F.col("t"), DAY_US).alias("b"), F.posexplode(F.array(*[f"v{i}" for i in range(len(names))])).alias("f", "v")).where(F.col("v").isNotNull() & (F.col("v") >= 0) & (F.col("v") <= limit))
    bin_ = F.when(F.col("v") > 0, F.floor(F.log2("v") * 4)).otherwise(F.lit(-(1 << 20))).cast("int")
    hist = long.groupBy("k", "f", bin_.alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    up = Window.partitionBy("k", "f").orderBy("bin")
    hist = hist.withColumn("below", F.lag("hi").over(up)).withColumn("gap", F.when(F.col("lo") > ratio * F.col("below"), F.col("bin")))
    hist = hist.withColumn("lowest", F.min("gap").over(Window.partitionBy("k", "f")))
    usual = F.coalesce(F.col("bin") < F.col("lowest"), F.lit(True))
    stats = hist.groupBy("k", "f").agg(
        F.sum(F.when(usual, F.col("c"))).alias("c"), F.sum(F.when(usual, F.col("s"))).alias("s"), F.sum(F.when(usual, F.col("q"))).alias("q"), F.collect_list(F.when(F.col("gap").isNotNull(), F.col("lo"))).alias("gaps"),
        F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.sum("c").alias("n"),
    )
    mean = F.col("s") / F.col("c")
    var, least = F.col("q") / F.col("c") - mean * mean, F.coalesce(F.array_min("gaps"), F.lit(0.0))
    var = F.when(var > mean * mean * 1e-12, var).otherwise(least * least / 16)  # usual readings that are all equal
    stats = stats.select("k", "b0", "b1", "n", F.struct("f", mean.alias("mean"), var.alias("var"), "gaps").alias("x"))
    heads = stats.groupBy("k").agg(F.to_json(F.collect_list("x")).alias("head"), F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.max("n").alias("n"))
    days = F.ceil((F.col("b1") - F.col("b0") + DAY_US) / DAY_US * block / F.col("n"))
    heads = cut(heads.select("k", "head", "b0", "b1", F.when(F.col("n") > block, days * DAY_US).alias("width")))  # a row a source

    body = lookup_join(rows, heads.where("width is not null").select("k", "width"), ["k"])
    b = F.coalesce(F.col("t") - F.pmod("t", "width"), F.lit(0))
    own, led = F.struct(b.alias("b"), F.lit(False).alias("led")), F.struct((b + F.col("width")).alias("b"), F.lit(True).alias("led"))
    body = body.withColumn("at", F.explode(F.when(F.pmod("t", "width") * 8 >= F.col("width") * 7, F.array(own, led)).otherwise(F.array(own)))).select("k", "t", *[f"v{i}" for i in range(len(names))], "at.b", "at.led").withColumn("head", F.lit(None).cast("string"))
    start = lambda c: F.col(c) - F.pmod(c, "width")
    top = heads.select("k", "head", F.explode(F.coalesce(F.sequence(start("b0"), start("b1"), F.col("width")), F.array(F.lit(0).cast("bigint")))).alias("b"))  # a header a block
    top = top.select("k", F.lit(None).cast("bigint").alias("t"), *[F.lit(None).cast("double").alias(f"v{i}") for i in range(len(names))], "b", F.lit(False).alias("led"), "head")
    blocks = body.unionByName(top).repartition("k", "b").sortWithinPartitions("k", "b", F.col("t").asc_nulls_first())
    seen = cut(blocks.mapInPandas(_scan(len(names), limit, stuck, brief, threshold), OUT))

    parts = seen.where("kind = 'run'")
    runs = merge_runs(parts, ["k", "f"], ["b", "pos"], "v", "n").where((F.col("run_length") >= stuck) & (F.col("v") != 0)).select("k", "f", "b", "run")
    stuck_rows = seen.where("kind = 'frozen'").select("k", "f", "b", "run", "t", "v", "z").join(runs, ["k", "f", "b", "run"]).select("k", "f", "t", "v", "z", F.lit("stuck").alias("reason"))

    gaps = seen.where("kind = 'gap'").withColumn("gap", F.col("v"))
    longest = merge_runs(gaps, ["k", "f", "gap"], ["b", "pos"], "v", "n").groupBy("k", "f", "gap").agg(F.max("run_length").alias("longest"))
    least = longest.where(F.col("longest") < brief).groupBy("k", "f").agg(F.min("gap").alias("least"))
    spikes = spread_join(seen.where("kind = 'spike'").select("k", "f", "t", "v", "z"), least, ["k", "f"]).where("v >= least").select("k", "f", "t", "v", "z", F.lit("spike").alias("reason"))

    impossible = seen.where("kind = 'impossible'").select("k", "f", "t", "v", "z", F.lit("impossible").alias("reason"))
    every = impossible.unionByName(spikes).unionByName(stuck_rows)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("f") + 1)
    return every.select(F.col("k").alias(key), from_micros(F.col("t")).alias("ts"), label.alias("field"), "reason", F.col("v").alias("value"), "z").distinct()
