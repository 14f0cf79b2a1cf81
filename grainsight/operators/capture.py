"""Scan plans, capture logs and focus: ordered records as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the stage and camera, in ms unless said otherwise.
FOV_MM, OVERLAP, MOTION_MS, SETTLE_MS, MARGIN_MS, GAP_MS, SIDES = 7.4, 0.10, 500.0, 50.0, 500.0, 50.0, 4
STANDARD_EXPOSURE_MS = {"Uniform": 100.0, "NSEW": 800.0}
FOCUS_EVERY, FOCUS_RATIO = 5, 0.8
GRAB_MS = 5000


def scan_stops(spark: SparkSession, columns: int, rows: int, step_mm: float) -> DataFrame:
    """(stop_index, row, col, axis, delta_mm): the serpentine plan; odd rows go right, even rows left."""
    if columns < 1 or rows < 1 or step_mm <= 0:
        raise ValueError("a scan needs columns, rows and a step above 0")
    n = F.col("id")
    row = (F.floor(n / columns) + 1).cast("int")
    along = (n % columns).cast("int")
    right = F.pmod(row, F.lit(2)) == 1
    col = F.when(right, along + 1).otherwise(F.lit(columns) - along).cast("int")
    turn = along == 0
    axis = F.when(n == 0, F.lit(None).cast("string")).when(turn, "Y").otherwise("X")
    delta = F.when(n == 0, 0.0).when(turn, -step_mm).when(right, step_mm).otherwise(-step_mm)
    return spark.range(columns * rows).select(n.cast("int").alias("stop_index"), row.alias("row"), col.alias("col"), axis.alias("axis"), delta.alias("delta_mm"))


def return_moves(row: Column, col: Column, step_mm: float) -> Column:
    """array<struct(axis, delta_mm)>: back to (1, 1), X first; stops are counted from 1."""
    if step_mm <= 0:
        raise ValueError("a step must be above 0")
    x = F.struct(F.lit("X").alias("axis"), (-(col - 1) * F.lit(float(step_mm))).alias("delta_mm"))
    y = F.struct(F.lit("Y").alias("axis"), ((row - 1) * F.lit(float(step_mm))).alias("delta_mm"))
    moves = F.filter(F.array(x, y), lambda m: m["delta_mm"] != 0)
    kind = "array<struct<axis:string,delta_mm:double>>"
    return F.when((row < 1) | (col < 1), F.raise_error(F.lit("rows and columns start at 1")).cast(kind)).otherwise(moves.cast(kind))


def return_to_start(columns: Column, rows: Column, step_mm: float) -> Column:
    """The moves back from the last stop of a serpentine scan."""
    return return_moves(rows, F.when(F.pmod(rows, F.lit(2)) == 1, columns).otherwise(F.lit(1)), step_mm)


def scan_summary(step: Column, columns: Column, rows: Column, fov_mm: float = FOV_MM) -> Column:
    x, y = (columns - 1) * step, (rows - 1) * step
    return F.struct(x.alias("x_mm"), y.alias("y_mm"), (x + fov_mm).alias("covered_x_mm"), (y + fov_mm).alias("covered_y_mm"), (columns * rows).alias("stops"))


def shutter_ms(total_ms: Column, mode: Column) -> Column:
    """Exposure of one frame: the total is shared by the ring's sides.  Both modes use the total as it is."""
    return F.when(total_ms > 0, total_ms)


def standard_exposure_ms(mode: Column) -> Column:
    return F.when(F.lower(mode) == "nsew", STANDARD_EXPOSURE_MS["NSEW"]).otherwise(STANDARD_EXPOSURE_MS["Uniform"])


def grab_timeout_ms(exposure_us: Column) -> Column:
    """How long to wait for a frame: two seconds beyond the exposure, `GRAB_MS` at least."""
    return F.greatest(F.lit(float(GRAB_MS)), exposure_us / 1000.0 + 2000.0).cast("int")


def pause_plan(shutter: Column, mode: Column) -> Column:
    """struct(frames, gaps, dwell_ms): how long the stage waits at a stop."""
    frames = F.when(mode == "NSEW", SIDES).otherwise(1)
    gaps = F.when(mode == "NSEW", SIDES - 1).otherwise(0)
    dwell = F.ceil(F.lit(MOTION_MS) + frames * (F.lit(SETTLE_MS) + shutter + MARGIN_MS) + gaps * F.lit(GAP_MS)).cast("int")
    return F.struct(frames.alias("frames"), gaps.alias("gaps"), dwell.alias("dwell_ms"))


def image_name(row: Column, col: Column, label: Column | None = None) -> Column:
    plain = F.format_string("(%d,%d).png", row, col)
    return plain if label is None else F.when(F.coalesce(label, F.lit("")) == "", plain).otherwise(F.format_string("(%d,%d)_%s.png", row, col, label))


def refocus_due(steps: Column, every: int = FOCUS_EVERY, enabled: bool = True) -> Column:
    return F.lit(enabled and every > 0) & (steps > 0) & (steps % F.lit(max(every, 1)) == 0)


def needs_refocus(score: Column, start: Column, stopped: Column, ratio: float = FOCUS_RATIO) -> Column:
    return ~stopped & (score <= start * ratio)


def with_refocus(stops: DataFrame, every: int = FOCUS_EVERY, scan: tuple[str, ...] = ()) -> DataFrame:
    """A plan's stops with the moves made so far and whether focus is due; a running count inside each scan."""
    w = Window.partitionBy(*scan, F.lit(0) if not scan else F.lit(1)).orderBy("stop_index").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.sum(F.col("axis").isNotNull().cast("int")).over(w)
    return stops.withColumn("steps", moved.cast("long")).withColumn("refocus", F.col("axis").isNotNull() & refocus_due(F.col("steps"), every))


def merge_manifest(writes: DataFrame, keys: tuple[str, ...] = ("row", "col"), seq: str = "seq", files: str = "files") -> DataFrame:
    """Stops of a capture: files in order of arrival, each once; (keys, first_seq, files)."""
    each = writes.select(*keys, seq, F.posexplode(files).alias("at", "file"))
    first = each.groupBy(*keys, "file").agg(F.min(F.struct(F.col(seq).alias("seq"), F.col("at").alias("at"))).alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "file"))), lambda x: x["file"])
    return first.groupBy(*keys).agg(F.min("first.seq").alias("first_seq"), listed.alias("files"))


def latest_settings(writes: DataFrame, columns: list[str], seq: str = "seq") -> DataFrame:
    """One row: each setting's last non-null value."""
    return writes.agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns))


def stop_sharpness(files: DataFrame, keys: tuple[str, ...] = ("row", "col"), order: str = "seq") -> DataFrame:
    """(keys, sharpness, files): the mean over a stop's photos; 0 for a stop without any (null name)."""
    one = F.struct(F.col(order).alias("seq"), F.col("name").alias("name"), F.col("sharpness").alias("sharpness"))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), one))), lambda x: F.struct(x["name"].alias("name"), x["sharpness"].alias("sharpness")))
    return files.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("name").isNotNull(), F.col("sharpness"))), F.lit(0.0)).alias("sharpness"), kept.alias("files"))


def autofocus_rollup(searches: DataFrame, keys: tuple[str, ...], attempt: str = "attempt") -> DataFrame:
    """Searches of one focus: the summed move, how many there were, the first start and what the last one left."""
    last = lambda c: F.max_by(c, attempt).alias(c)
    return searches.groupBy(*keys).agg(F.sum("z_change_mm").alias("z_change_mm"), F.count("*").alias("attempts"), F.min_by("start_sharpness", attempt).alias("start_sharpness"), last("sharpness"), last("best_sharpness"), last("stopped"))


def settled_frames(frames: DataFrame, asks: DataFrame, camera: str = "camera") -> DataFrame:
    """For each ask (camera, ask_id, at, settle_s, timeout_s) the first frame (camera, seq, at) after it has settled; null after the time limit.

    An as-of join: frames and asks of a stretch of time meet, sorted by time, and each
    ask takes the next frame.  Stretches are as long as the longest limit, so a frame
    goes to its own and the one before, and a busy camera's rows spread over many.
    """
    width = float(asks.agg(F.max("timeout_s")).head()[0] or 0.0) + 1.0
    stretch = lambda t: F.floor(t / F.lit(width)).cast("long")
    ready = F.col("at").cast("double") + F.col("settle_s")
    a = asks.select(camera, "ask_id", ready.alias("_t"), (ready + F.col("timeout_s")).alias("_until"), stretch(ready).alias("_s"), F.lit(None).cast("long").alias("_frame"))
    seen = frames.select(camera, F.col("at").cast("double").alias("_t"), F.col("seq").cast("long").alias("_frame"))
    f = seen.select(camera, "_t", "_frame", F.explode(F.array(stretch(F.col("_t")), stretch(F.col("_t")) - 1)).alias("_s"))
    both = a.unionByName(f, allowMissingColumns=True)
    # a frame of the very moment counts as before it
    later = Window.partitionBy(camera, "_s").orderBy(F.col("_t"), F.col("_frame").isNull(), "_frame").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("_frame").isNotNull(), F.struct("_t", "_frame")), ignorenulls=True).over(later)
    found = both.withColumn("_next", following).where("_frame IS NULL")
    return found.select(camera, "ask_id", F.when(F.col("_next._t") <= F.col("_until"), F.col("_next._frame")).alias("frame"))


class FocusWalk:
    """Hill climbing over heights, driven by `measure` and `move`; keeps a trace of what it decided.

    Coarse steps, then fine ones; up first, then down.  A miss is measured once
    more, and a second miss after one more step turns the search around.
    """

    EPS = 1e-9

    def __init__(self, measure, move, travel: float = 1.0, coarse: float = 0.05, fine: float = 0.01, gain: float = 0.02, stop=lambda: False):
        if travel < 0 or coarse <= 0 or fine <= 0 or gain < 0:
            raise ValueError("travel and gain can't be negative, steps must be above 0")
        self.measure, self.move, self.stop = measure, move, stop
        self.travel, self.gain = travel, gain
        self.at = self.best_at = 0.0
        self.stopped = False
        self.trace: list[tuple[str, float, float, str]] = []
        self.start = self.best = float(measure())
        self._note("start", self.best, "start")
        for step, phase in ((coarse, "coarse"), (fine, "fine")):
            for sign in (1.0, -1.0):
                if self._halted() or self._side(sign * step, phase):
                    break
            if self.stopped:
                break
        if abs(self.at - self.best_at) > self.EPS:
            self._go(self.best_at)
            self._note("return", self.best, "back")

    def _note(self, phase: str, score: float, decision: str) -> None:
        self.trace.append((phase, self.at, score, decision))

    def _halted(self) -> bool:
        self.stopped = self.stopped or bool(self.stop())
        return self.stopped

    def _go(self, to: float) -> None:
        if abs(to - self.at) > self.EPS:
            self.move(to - self.at)
            self.at = to

    def _sharper(self, phase: str, otherwise: str) -> bool:
        score = float(self.measure())
        won = score > self.best * (1 + self.gain)
        if won:
            self.best, self.best_at = score, self.at
        self._note(phase, score, "sharper" if won else otherwise)
        return won

    def _side(self, step: float, phase: str) -> bool:
        """Walks one way; whether that found a better height (or was stopped)."""
        improved, misses = False, 0
        while not self._halted():
            to = self.at + step
            if abs(to) > self.travel + self.EPS:
                break
            self._go(to)
            won = self._sharper(phase, "not sharper")
            if not won:
                if self._halted():
                    return True
                won = self._sharper(phase, "again")
            if won:
                improved, misses = True, 0
            elif misses:
                misses += 1
                break
            else:
                misses = 1
        else:
            return True
        if misses:
            self._go(self.best_at)
            self._note(phase, self.best, "back")
        return improved


def replay_focus(curves: DataFrame, key: str = "run", travel: float = 1.0, coarse: float = 0.05, fine: float = 0.01, gain: float = 0.02) -> DataFrame:
    """Replays the search over recorded curves (key, z_mm, sharpness), by linear interpolation: the trace of each run."""
    schema = f"{key} {dict(curves.dtypes)[key]}, step int, phase string, offset_mm double, sharpness double, decision string, best_offset_mm double, best_sharpness double"

    def run(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = groups.sort_values("z_mm")
        z, s = g["z_mm"].to_numpy(float), g["sharpness"].to_numpy(float)
        here = [0.0]

        def move(d: float) -> None:
            here[0] += d

        walk = FocusWalk(lambda: float(np.interp(here[0], z, s)), move, travel, coarse, fine, gain)
        rows = [(g[key].iloc[0], i, *t, walk.best_at, walk.best) for i, t in enumerate(walk.trace)]
        return pd.DataFrame(rows, columns=[key, "step", "phase", "offset_mm", "sharpness", "decision", "best_offset_mm", "best_sharpness"])

    return curves.groupBy(key).applyInPandas(run, schema)


def trace_line(index: Column, offset: Column, score: Column, phase: Column, decision: Column) -> Column:
    """A fixed-width line of a focus trace: number, what was done, signed offset, score and verdict."""
    value = F.when(score >= 100, F.format_string("%.0f", score)).otherwise(F.format_string("%.2f", score))
    place = F.format_string("%+.3f mm", offset)
    name = F.initcap(phase)
    done = F.when(decision == "start", F.lit("Start     ")).when(decision == "back", F.lit("Back to   ")).otherwise(F.rpad(name, 10, " "))
    verdict = F.when(decision.isin("start", "back"), F.lit("")).when(decision.isin("sharper", "again"), F.concat(F.lit("   "), decision)).otherwise(F.lit("   not sharper"))
    return F.concat(F.format_string("%2d. ", index), done, F.lit(" "), place, F.lit("   "), value, verdict)


def scan_program(stops: DataFrame, feed: float, dwell_ms: int) -> DataFrame:
    """One row, `program`: the stage's text for a plan, in order."""
    line = F.when(F.col("axis").isNotNull(), F.concat(F.lit(f"G4 P{dwell_ms}\nG1 "), "axis", F.format_string("%.2f", "delta_mm"), F.lit(f" F{feed:g}")))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("stop_index", line.alias("line"))))), lambda x: x["line"])
    return stops.agg(F.concat(F.lit("G21\nG91\n"), F.array_join(ordered, "\n"), F.lit(f"\nG4 P{dwell_ms}\nG90\n")).alias("program"))
