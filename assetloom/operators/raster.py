"""Raster operators over pixel rows and scanlines.

Storage form is one row per image line (channel arrays); aggregations explode
lines to pixels inside the map stage so that partial aggregation collapses them
before any shuffle. Every row carries the raster size ``w, h`` so that no
operator needs a join to learn it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import color
from ..schemas import require

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its Python functions travel with the job

CHANNELS = ("r", "g", "b")
BAND_LINES = 128
#: Samples of one plane that a task of the resampling works on at a time.
BLOCK_SAMPLES = 1 << 21
#: Samples of one plane in a block of columns that is turned to lines.
TURN_SAMPLES = 1 << 18
DECODE_CUT, ENCODE_CUT = fixed.SRGB_DECODE_CUT, fixed.SRGB_ENCODE_CUT


def explode_array(df: DataFrame, array: str, width: int | Column, value: str = "value") -> DataFrame:
    """Flat row-major array -> rows ``x, y, value``."""
    width = F.lit(width) if isinstance(width, int) else width
    keep = [c for c in df.columns if c != array]
    rows = df.select(*keep, F.posexplode(array).alias("_pos", value))
    return (rows.withColumn("x", (F.col("_pos") % width).cast("int"))
            .withColumn("y", F.floor(F.col("_pos") / width).cast("int")).drop("_pos"))


def explode_pixels(lines: DataFrame) -> DataFrame:
    """Scanlines -> one row per pixel. There is none where all samples are NULL."""
    keep = [c for c in lines.columns if c not in ("r", "g", "b", "a")]
    zipped = lines.select(*keep, F.posexplode(F.arrays_zip("r", "g", "b", "a")).alias("x", "_p"))
    there = zipped.where("_p.r is not null or _p.g is not null or _p.b is not null or _p.a is not null")
    return there.select(*keep, "x", *[F.col(f"_p.{c}").alias(c) for c in ("r", "g", "b", "a")])


def _gather_lines(px: DataFrame, *keys: str) -> DataFrame:
    """Pixels -> one row per ``keys`` (a line), each sample at its x; NULL samples stand for pixels that are missing."""
    planes = (*CHANNELS, "a")
    found = px.groupBy(*keys).agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), *planes)).alias("_p"))
    missing = F.array_except(F.sequence(F.lit(0), F.col("w").cast("int") - 1), F.col("_p.x"))
    blank = lambda x: F.struct(x.alias("x"), *[F.lit(None).cast(px.schema[c].dataType).alias(c) for c in planes])
    whole = F.when(F.size("_p") < F.col("w"), F.concat("_p", F.transform(missing, blank))).otherwise(F.col("_p"))
    return found.withColumn("_p", F.array_sort(whole)).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in planes])


def collect_scanlines(px: DataFrame) -> DataFrame:
    """Pixels -> scanlines, ``w`` samples each, NULL where a pixel is missing.

    A position has one pixel at most. A group is one image line, so at most 65 535 pixels wide.
    """
    require(px, "asset_id", "w", "h", "x", "y", *CHANNELS, "a")
    return _gather_lines(px, "asset_id", "w", "h", "y")


def _filled(plane: str, kind: str = "int") -> Column:
    """A line's samples, NULL ones behind them where it is shorter than its raster is wide."""
    known = F.coalesce(F.col(plane).cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    rest = F.array_repeat(F.lit(None).cast(kind), F.col("w").cast("int") - F.size(known))
    return F.when(F.size(known) < F.col("w"), F.concat(known, rest)).otherwise(known)


def identity(px: DataFrame) -> DataFrame:
    """No-op."""
    return px


def invert(px: DataFrame, depth: int = 8) -> DataFrame:
    """Top minus sample on colour channels; alpha kept."""
    top = 2 ** depth - 1
    return px.withColumns({c: F.lit(top) - F.col(c) for c in CHANNELS})


def invert_lines(lines: DataFrame, depth: int = 8) -> DataFrame:
    """:func:`invert` on scanlines."""
    top = 2 ** depth - 1
    return lines.withColumns({c: F.transform(c, lambda v: F.lit(top) - v) for c in CHANNELS})


def planned_dims(mode: Column, w: Column, h: Column, tw: Column, th: Column,
                 pct: Column) -> tuple[Column, Column]:
    """Target size for the six resize modes; ``max`` reads its cap from ``tw``."""
    w_, h_ = w.cast("double"), h.cast("double")
    rw, rh = tw.cast("double") / w_, th.cast("double") / h_
    scale = (F.when(mode == "max", F.least(tw.cast("double") / F.greatest(w_, h_), F.lit(1.0)))
             .when(mode == "percent", pct.cast("double") / 100.0)
             .when(mode == "fit", F.least(rw, rh, F.lit(1.0)))
             .when(mode.isin("cover", "fill"), F.greatest(rw, rh)))
    side = lambda n, fixed_: F.when(mode == "exact", fixed_.cast("bigint")).otherwise(
        F.greatest(F.round(n * scale).cast("bigint"), F.lit(1)))
    return side(w_, tw), side(h_, th)


def plan_resize(df: DataFrame, mode: Column | str, tw: Column | int | None = None,
                th: Column | int | None = None, pct: Column | float | None = None,
                w: str = "w", h: str = "h", out: tuple[str, str] = ("dw", "dh")) -> DataFrame:
    """Add target dims ``dw, dh``."""
    as_col = lambda v, t: v if isinstance(v, Column) else F.lit(v).cast(t)
    dw, dh = planned_dims(as_col(mode, "string"), F.col(w), F.col(h), as_col(tw, "bigint"),
                          as_col(th, "bigint"), as_col(pct, "double"))
    return df.withColumns({out[0]: dw, out[1]: dh})


def resize_limits(df: DataFrame, dw: str = "dw", dh: str = "dh") -> DataFrame:
    """Reason a target is refused (NULL when allowed)."""
    area = F.col(dw).cast("bigint") * F.col(dh).cast("bigint")
    too_long = F.greatest(F.col(dw), F.col(dh)) > fixed.RESIZE_MAX_EDGE
    return df.withColumn("reason", F.when(too_long, F.lit("edge"))
                         .when(area > fixed.RESIZE_MAX_AREA, F.lit("area")))


def _taps(src: Column, src_n: Column, dst_n: Column) -> tuple[Column, Column]:
    """Destination indexes one source sample reaches under a Lanczos-3 kernel."""
    scale = src_n.cast("double") / dst_n
    reach = 3.0 * F.greatest(scale, F.lit(1.0))
    lo = F.greatest(F.lit(0), F.ceil((src + 0.5 - reach) / scale - 0.5).cast("int"))
    hi = F.least(dst_n.cast("int") - 1, F.floor((src + 0.5 + reach) / scale - 0.5).cast("int"))
    same = src_n == dst_n
    return F.when(same, src).otherwise(lo), F.when(same, src).otherwise(hi)


def _to_linear(v: np.ndarray) -> np.ndarray:
    return np.where(v <= DECODE_CUT, v / 12.92, ((np.maximum(v, 0.0) + 0.055) / 1.055) ** 2.4)


def _from_linear(v: np.ndarray) -> np.ndarray:
    return np.where(v <= ENCODE_CUT, v * 12.92, 1.055 * np.maximum(v, 0.0) ** (1.0 / 2.4) - 0.055)


def _kernel(dst_n: int, src_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per destination sample, its taps: source index, weight (0 outside the raster), and whether it is within reach."""
    scale = src_n / dst_n
    wide = max(scale, 1.0)
    middle = (np.arange(dst_n) + 0.5) * scale
    at = np.ceil(middle - 0.5 - 3.0 * wide).astype(np.int64)[:, None] + np.arange(int(6.0 * wide) + 2)
    t = (at + 0.5 - middle[:, None]) / wide
    inside = (at >= 0) & (at < src_n) & (np.abs(t) <= 3.0)
    weight = np.where(inside & (np.abs(t) < 3.0), np.sinc(t) * np.sinc(t / 3.0), 0.0)
    return np.clip(at, 0, src_n - 1), weight, inside


def _across(planes: np.ndarray, kernel: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted means along the last axis over the samples that exist (not NaN), tap by tap; NaN where none does."""
    at, weight, inside = kernel
    known = ~np.isnan(planes)
    gaps = not known.all()
    filled = np.where(known, planes, 0.0) if gaps else planes
    total = np.zeros((*planes.shape[:-1], len(at)))
    share = np.zeros_like(total) if gaps else weight.sum(axis=1)
    reached = np.zeros(total.shape, bool) if gaps else None
    for k in range(at.shape[1]):
        total += filled[..., at[:, k]] * weight[:, k]
        if gaps:
            here = known[..., at[:, k]]
            share += here * weight[:, k]
            reached |= here & inside[:, k]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(reached, total / share, np.nan) if gaps else total / share


def _encoded(linear: np.ndarray, top: float) -> list[pa.Array]:
    """Lists of samples of ``planes x lines x width`` in linear light, NULL where there is none."""
    linear = np.clip(linear, 0.0, 1.0)
    linear[:3] = _from_linear(linear[:3])
    out = np.floor(linear * top + 0.5)
    ends = pa.array(np.arange(out.shape[1] + 1) * out.shape[2], pa.int32())
    lists = []
    for plane in out:
        flat = plane.ravel()
        gaps = np.isnan(flat)
        lists.append(pa.ListArray.from_arrays(ends, pa.array(np.where(gaps, 0, flat).astype(np.int32), mask=gaps)))
    return lists


def _line_resampler(depth: int, finished: bool):
    """Lines to their new width in linear light; encoded again if they are ``finished``, else as they are summed."""
    top = float(2 ** depth - 1)
    planes = (*CHANNELS, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = lru_cache(16)(_kernel)  # made here: a cached function of the module would not travel with the job
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            w, dw = columns["w"].to_numpy(), columns["dw"].to_numpy()
            runs = np.flatnonzero(np.diff(w, prepend=-1) | np.diff(dw, prepend=-1))
            for first, end in zip(runs, [*runs[1:], batch.num_rows], strict=True):
                step = max(1, BLOCK_SAMPLES // int(max(w[first], dw[first])))
                for start in range(first, end, step):
                    n = min(step, end - start)
                    raw = np.stack([columns[c].slice(start, n).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for c in planes]) / top
                    raw[:3] = _to_linear(raw[:3])
                    wide = _across(raw, kernel(int(dw[start]), int(w[start]))) if w[start] != dw[start] else raw
                    if finished:
                        lists = _encoded(wide, top)
                    else:
                        ends = pa.array(np.arange(n + 1) * int(dw[start]), pa.int32())
                        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in wide]
                    rest = [c.slice(start, n) for c in batch.columns[:-4]]
                    yield pa.RecordBatch.from_arrays([*rest, *lists], names=batch.schema.names)
    return run


def _band_summer(depth: int):
    """Sums the lines of a band into its destination lines as they stream in: memory for these lines, not for the source's."""
    top = float(2 ** depth - 1)
    planes = (*CHANNELS, "a")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the hints ask for streaming
        _, _, h, dw, dh, per, band = (k.as_py() for k in key)
        lines = np.arange(band * per, min(dh, (band + 1) * per))
        scale = h / dh
        total, share, reached = np.zeros((len(lines), 4, dw)), np.zeros((len(lines), 1, 1)), np.zeros((len(lines), 1, 1), bool)
        kind = None
        for batch in batches:
            kind = batch.schema.field("asset_id").type
            y = batch["y"].to_numpy()
            values = np.stack([batch[c].flatten().to_numpy().reshape(len(y), dw) for c in planes], axis=1)
            for at, v in zip(y, values, strict=True):
                t = (at + 0.5 - (lines + 0.5) * scale) / max(scale, 1.0)
                near = np.flatnonzero(np.abs(t) <= 3.0)
                weight = np.where(np.abs(t[near]) < 3.0, np.sinc(t[near]) * np.sinc(t[near] / 3.0), 0.0)[:, None, None]
                known = ~np.isnan(v)
                if not known.all():
                    if share.shape != total.shape:  # from the first gap on, each sample has its own share
                        share, reached = np.broadcast_to(share, total.shape).copy(), np.broadcast_to(reached, total.shape).copy()
                    v = np.where(known, v, 0.0)
                whole = share.shape != total.shape
                total[near] += weight * v
                share[near] += weight if whole else weight * known
                reached[near] |= True if whole else known
        with np.errstate(invalid="ignore", divide="ignore"):
            linear = np.where(reached, total / share, np.nan).swapaxes(0, 1)
        kept = ~np.isnan(linear[3]).all(axis=1)
        linear = linear[:, kept]
        n = int(kept.sum())
        ids = [pa.array([key[0].as_py()] * n, kind), *[pa.array(np.full(n, v), pa.int32()) for v in (dw, dh)], pa.array(lines[kept], pa.int32())]
        yield pa.RecordBatch.from_arrays([*ids, *_encoded(linear, top)], names=["asset_id", "w", "h", "y", *planes])
    return run


def resample_lines(lines: DataFrame, depth: int = 8, band_lines: int = BAND_LINES) -> DataFrame:
    """Separable Lanczos-3 of scanlines to ``dw x dh`` in linear light; alpha linear, untransformed.

    Lines are brought to their new width where they are read, tap by tap, so that what moves is as wide as the result.
    Every line is then copied to the bands of destination lines it reaches; one shuffle on (asset, band) brings a band
    together, where lines are added to at most ``band_lines`` destination lines as they stream in. Rasters that keep
    their height skip the shuffle, those that keep their size come back as they are. Samples outside the raster and those
    behind the end of a short line do not exist; weights are renormalised over those that do.
    """
    require(lines, "asset_id", "w", "h", "y", "dw", "dh", *CHANNELS, "a")
    c, planes = F.col, (*CHANNELS, "a")
    dims = [c("dw").cast("int").alias("w"), c("dh").cast("int").alias("h")]
    same = (c("w") == c("dw")) & (c("h") == c("dh"))
    whole = lambda n: c(n).cast("array<int>").alias(n)
    untouched = lines.where(same).select("asset_id", *dims, c("y").cast("int").alias("y"), *[whole(n) for n in planes])
    kind = lines.schema["asset_id"].dataType.simpleString()
    sized = lines.where(~same).select("asset_id", *[c(n).cast("int").alias(n) for n in ("w", "h", "dw", "dh", "y")], *[_filled(n).alias(n) for n in planes])
    columns = lambda t: f"asset_id {kind}, w int, h int, dw int, dh int, y int, " + ", ".join(f"{n} array<{t}>" for n in planes)
    flat = sized.where("h = dh").mapInArrow(_line_resampler(depth, True), columns("int")).select("asset_id", *dims, "y", *planes)
    # no fewer than 8 lines in a band, or a strong shrink would copy each line often; no more than fit, or an enlargement would be one band
    per_band = F.greatest(F.lit(1), F.least(F.lit(band_lines), F.greatest(F.lit(8), F.floor(band_lines * c("dh") / c("h"))), F.floor(F.lit(BLOCK_SAMPLES) / c("dw")))).cast("int")
    lo, hi = _taps(c("y"), c("h"), c("dh"))
    moved = (sized.where("h <> dh").mapInArrow(_line_resampler(depth, False), columns("double"))
             .withColumns({"_lo": lo, "_hi": hi, "_per": per_band}).where("_lo <= _hi")
             .withColumn("_band", F.explode(F.sequence(F.floor(c("_lo") / c("_per")), F.floor(c("_hi") / c("_per"))))).drop("_lo", "_hi"))
    made = moved.groupBy("asset_id", "w", "h", "dw", "dh", "_per", "_band").applyInArrow(
        _band_summer(depth), f"asset_id {kind}, w int, h int, y int, r array<int>, g array<int>, b array<int>, a array<int>")
    return untouched.union(flat).union(made)


def resample(px: DataFrame, depth: int = 8) -> DataFrame:
    """Pixel form of :func:`resample_lines`: pixels are gathered to lines first, gaps filled with NULL samples."""
    require(px, "asset_id", "w", "h", "x", "y", "dw", "dh", *CHANNELS, "a")
    lines = _gather_lines(px, "asset_id", "w", "h", "dw", "dh", "y")
    out = explode_pixels(resample_lines(lines, depth)).where("r is not null")
    return out.select("asset_id", "w", "h", "x", "y", *CHANNELS, "a")


def crop_center(px: DataFrame, tw: Column | int, th: Column | int) -> DataFrame:
    """Keep the centred ``tw x th`` window and rebase coordinates."""
    tw, th = (v if isinstance(v, Column) else F.lit(v) for v in (tw, th))
    ox = F.floor(F.greatest(F.lit(0), F.col("w") - tw) / 2).cast("int")
    oy = F.floor(F.greatest(F.lit(0), F.col("h") - th) / 2).cast("int")
    moved = px.withColumns({"x": F.col("x") - ox, "y": F.col("y") - oy})
    inside = (F.col("x") >= 0) & (F.col("x") < tw) & (F.col("y") >= 0) & (F.col("y") < th)
    return moved.where(inside).withColumns({
        "w": F.least(F.col("w"), tw).cast("int"), "h": F.least(F.col("h"), th).cast("int")})


def resize(px: DataFrame, mode: str, width: int | None = None, height: int | None = None,
           percent: float | None = None) -> DataFrame:
    """Any of the six modes, end to end; ``fill`` also crops."""
    out = resample(plan_resize(px, mode, width, height, percent))
    return crop_center(out, width, height) if mode == "fill" else out


def crop_center_lines(lines: DataFrame, tw: Column | int, th: Column | int) -> DataFrame:
    """:func:`crop_center` on scanlines: lines outside go, the others are sliced."""
    tw, th = (v if isinstance(v, Column) else F.lit(v) for v in (tw, th))
    ox = F.floor(F.greatest(F.lit(0), F.col("w") - tw) / 2).cast("int")
    oy = F.floor(F.greatest(F.lit(0), F.col("h") - th) / 2).cast("int")
    w, y = F.least(F.col("w"), tw).cast("int"), F.col("y") - oy
    return lines.where((y >= 0) & (y < th)).withColumns({
        **{c: F.slice(c, ox + 1, w) for c in (*CHANNELS, "a")}, "y": y, "w": w, "h": F.least(F.col("h"), th).cast("int")})


def resize_lines(lines: DataFrame, mode: str, width: int | None = None, height: int | None = None, percent: float | None = None) -> DataFrame:
    """Any of the six modes on scanlines; ``fill`` also crops."""
    out = resample_lines(plan_resize(lines, mode, width, height, percent))
    return crop_center_lines(out, width, height) if mode == "fill" else out


def resize_fill(px: DataFrame, width: int, height: int) -> DataFrame:
    """Cover the box, then crop to it."""
    return resize(px, "fill", width, height)


def thumbnail(px: DataFrame, size: int = 256, square: bool = False) -> DataFrame:
    """Long edge at most ``size``, or an exact square."""
    return resize(px, "fill", size, size) if square else resize(px, "max", size)


def auto_orient(px: DataFrame, orientation: str = "orientation") -> DataFrame:
    """Apply EXIF orientation 1..8 to coordinates and clear the tag."""
    o, x, y = F.col(orientation), F.col("x"), F.col("y")
    mx, my = F.col("w") - 1 - x, F.col("h") - 1 - y
    nx = (F.when(o.isin(2, 3), mx).when(o.isin(5, 8), y).when(o.isin(6, 7), my).otherwise(x))
    ny = (F.when(o.isin(3, 4), my).when(o.isin(5, 6), x).when(o.isin(7, 8), mx).otherwise(y))
    swap = o.isin(5, 6, 7, 8)
    return px.withColumns({
        "x": nx, "y": ny,
        "w": F.when(swap, F.col("h")).otherwise(F.col("w")),
        "h": F.when(swap, F.col("w")).otherwise(F.col("h")),
        orientation: F.lit(None).cast("int")})


def _turner(rest: list[str]):
    """Columns of a block of lines as lines: one block at a time, NULL where a line is missing or too short."""
    planes = (*CHANNELS, "a")

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        w, h, o, per, b = (block[n][0].as_py() for n in ("w", "h", "_o", "_per", "_b"))
        first, n = b * per, min(per, w - b * per)
        y = block["y"].to_numpy()
        columns = np.arange(first, first + n)
        made = {}
        for name in planes:
            column = block[name].combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            lengths = column.value_lengths().fill_null(0).to_numpy()
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            values = column.flatten()
            grid, known = np.zeros((n, h), np.int32), np.zeros((n, h), bool)
            grid[at, np.repeat(y, lengths)] = values.fill_null(0).to_numpy()
            known[at, np.repeat(y, lengths)] = values.is_valid().to_numpy(zero_copy_only=False)
            if o in (6, 7):
                grid, known = grid[:, ::-1], known[:, ::-1]
            made[name] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h, pa.int32()), pa.array(grid.ravel(), mask=~known.ravel()))
        whole = lambda v: pa.array(np.full(n, v), pa.int32())
        same = lambda name: block[name].combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        turned = w - 1 - columns if o in (7, 8) else columns
        return pa.table({"asset_id": same("asset_id"), "w": whole(h), "h": whole(w), "y": pa.array(turned, pa.int32()), **made, **{name: same(name) for name in rest}})
    return run


def auto_orient_lines(lines: DataFrame, orientation: str = "orientation") -> DataFrame:
    """:func:`auto_orient` on scanlines.

    Orientations 1 to 4 mirror lines where they are read, without a shuffle. For 5 to 8 lines are cut into blocks of
    columns, as many columns as keep a block within ``TURN_SAMPLES`` samples (one at least); one shuffle on (asset, block)
    brings a block together, which leaves as whole lines, so no task holds more of a raster than that. Samples of a line
    that is missing, or behind the end of a short one, are NULL. Columns beside the raster's own must be the same for all its lines.
    """
    require(lines, "asset_id", "w", "h", "y", *CHANNELS, "a", orientation)
    c, planes, o = F.col, (*CHANNELS, "a"), F.col(orientation)
    rest = [n for n in lines.columns if n not in ("asset_id", "w", "h", "y", *planes, orientation)]
    turned = F.coalesce(o.isin(5, 6, 7, 8), F.lit(False))
    unset = F.lit(None).cast("int").alias(orientation)
    flipped = lambda n: F.when(o.isin(2, 3), F.reverse(_filled(n, lines.schema[n].dataType.elementType.simpleString()))).otherwise(c(n))
    straight = lines.where(~turned).select(
        "asset_id", "w", "h", F.when(o.isin(3, 4), c("h") - 1 - c("y")).otherwise(c("y")).cast("int").alias("y"),
        *[flipped(n).alias(n) for n in planes], *rest, unset)
    per = F.greatest(F.lit(1), F.floor(F.lit(TURN_SAMPLES) / c("h"))).cast("int")
    cut = (lines.where(turned & c("y").isNotNull()).withColumn("_per", per)
           .withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((c("w") - 1) / c("_per")).cast("int"))))
           .select("asset_id", *[c(n).cast("int").alias(n) for n in ("w", "h", "y")], c(orientation).cast("int").alias("_o"), "_per", "_b",
                   *[F.slice(c(n).cast("array<int>"), c("_b") * c("_per") + 1, c("_per")).alias(n) for n in planes], *rest))
    types = {n: lines.schema[n].dataType.simpleString() for n in ("asset_id", *rest)}
    schema = ", ".join(["asset_id " + types["asset_id"], "w int, h int, y int", *[f"{n} array<int>" for n in planes], *[f"`{n}` {types[n]}" for n in rest]])
    made = cut.groupBy("asset_id", "_b").applyInArrow(_turner(rest), schema)
    return straight.unionByName(made.withColumn(orientation, unset)).select(*lines.columns)


def gravity_origin(gravity: Column, bw: Column, bh: Column, ow: Column, oh: Column,
                   margin: Column) -> tuple[Column, Column]:
    """Overlay origin for nine anchors; a centred axis ignores the margin."""
    zero = F.lit(0).cast("bigint")

    def along(base: Column, over: Column, low: Column, high: Column) -> Column:
        free = F.greatest(zero, base.cast("bigint") - over.cast("bigint"))
        return (F.when(low, margin.cast("bigint"))
                .when(high, F.greatest(zero, free - margin.cast("bigint")))
                .otherwise(F.floor(free / 2)))

    x = along(bw, ow, gravity.endswith("west"), gravity.endswith("east"))
    y = along(bh, oh, gravity.startswith("north"), gravity.startswith("south"))
    return x, y


def gravity_place(df: DataFrame, gravity: str = "gravity", margin: str = "margin") -> DataFrame:
    """Add ``ox, oy`` from ``bw, bh, ow, oh``."""
    ox, oy = gravity_origin(F.col(gravity), F.col("bw"), F.col("bh"), F.col("ow"), F.col("oh"),
                            F.col(margin))
    return df.withColumns({"ox": ox, "oy": oy})


def overlay_opacity(overlay: DataFrame, opacity: float | Column) -> DataFrame:
    """Scale the overlay's alpha; full opacity leaves it as it is."""
    opacity = opacity if isinstance(opacity, Column) else F.lit(float(opacity))
    dimmed = F.round(F.col("a") * opacity).cast("int")
    return overlay.withColumn("a", F.when(opacity < 1.0, dimmed).otherwise(F.col("a")))


def overlay_scale_dims(df: DataFrame, scale: str = "scale") -> DataFrame:
    """Overlay width as a share of the canvas, height keeping aspect, each at least 1."""
    ow, oh = F.greatest(F.col("ow"), F.lit(1)), F.greatest(F.col("oh"), F.lit(1))
    tw = F.greatest(F.round(F.col("bw") * F.col(scale)).cast("bigint"), F.lit(1))
    th = F.greatest(F.round(tw * oh.cast("double") / ow).cast("bigint"), F.lit(1))
    return df.withColumns({"tw": tw, "th": th})


def _blend(joined: DataFrame, depth: int) -> DataFrame:
    """Source-over with straight alpha, rounded half up; absent overlay keeps the base."""
    top = float(2 ** depth - 1)
    fa = F.coalesce(F.col("_oa"), F.lit(0)) / top
    ba = F.col("a") / top
    out_a = ba + fa - ba * fa

    def mix(c: str) -> Column:
        value = (F.col(f"_o{c}") * fa + F.col(c) * ba * (1.0 - fa)) / out_a
        return F.when(fa == 0, F.col(c)).otherwise(F.round(value).cast("int"))

    return joined.withColumns({
        **{c: mix(c) for c in CHANNELS},
        "a": F.when(fa == 0, F.col("a")).otherwise(F.round(out_a * top).cast("int")),
    }).drop("_ox", "_oy", "_or", "_og", "_ob", "_oa")


def _overlay_side(overlay: DataFrame) -> DataFrame:
    return overlay.select(F.col("x").alias("_ox"), F.col("y").alias("_oy"),
                          *[F.col(c).alias(f"_o{c}") for c in (*CHANNELS, "a")])


def composite(base: DataFrame, overlay: DataFrame, ox: Column | int, oy: Column | int,
              depth: int = 8) -> DataFrame:
    """Blend one overlay raster into every base at an origin, clipped to the canvas."""
    ox, oy = (v if isinstance(v, Column) else F.lit(v) for v in (ox, oy))
    side = _overlay_side(overlay)
    joined = (base.withColumns({"_ox": F.col("x") - ox, "_oy": F.col("y") - oy})
              .join(side, ["_ox", "_oy"], "left"))
    return _blend(joined, depth).select(*base.columns)


def composite_tiled(base: DataFrame, overlay: DataFrame, ow: int, oh: int,
                    depth: int = 8) -> DataFrame:
    """Repeat the overlay over the whole canvas; edge tiles clip."""
    side = _overlay_side(overlay)
    joined = (base.withColumns({"_ox": F.col("x") % ow, "_oy": F.col("y") % oh})
              .join(side, ["_ox", "_oy"], "left"))
    return _blend(joined, depth).select(*base.columns)


def _line_blender(depth: int, tile: bool):
    """Source-over of whole lines: slices of a base line and of the overlay line that it meets."""
    top = float(2 ** depth - 1)
    planes = (*CHANNELS, "a")

    def flat(column) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy() - column.offsets[0].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, over = [flat(batch[n]) for n in planes], [flat(batch[f"_o{n}"]) for n in planes]
            at, to = base[0][1], over[0][1]
            left = batch["_ox"].to_numpy()
            for i in np.flatnonzero(np.diff(to)):  # lines that meet none stay as they are
                w, n = int(at[i + 1] - at[i]), int(to[i + 1] - to[i])
                if tile:
                    first, last, take = 0, w, to[i] + np.arange(w) % n
                else:
                    first, last = max(0, int(left[i])), min(w, int(left[i]) + n)
                    take = to[i] + np.arange(first, last) - int(left[i])
                if first >= last:
                    continue
                here = slice(at[i] + first, at[i] + last)
                fa, ba = np.nan_to_num(over[3][0][take] / top), base[3][0][here] / top  # no overlay where its pixel is missing
                out_a = ba + fa - ba * fa
                met = fa != 0
                with np.errstate(invalid="ignore", divide="ignore"):
                    for k in range(3):
                        mixed = np.floor((over[k][0][take] * fa + base[k][0][here] * ba * (1.0 - fa)) / out_a + 0.5)
                        base[k][0][here] = np.where(met, mixed, base[k][0][here])
                base[3][0][here] = np.where(met, np.floor(out_a * top + 0.5), base[3][0][here])
            made = {}
            for n, (values, ends) in zip(planes, base, strict=True):
                gaps = np.isnan(values)
                made[n] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.where(gaps, 0, values).astype(np.int32), mask=gaps))
            kept = [c for c in batch.schema.names if not c.startswith("_o")]
            yield pa.RecordBatch.from_arrays([made.get(c, batch[c]) for c in kept], names=kept)
    return run


def composite_lines(lines: DataFrame, overlay: DataFrame, ox: Column | int = 0, oy: Column | int = 0, depth: int = 8, tile: int | None = None) -> DataFrame:
    """:func:`composite` on scanlines, or with ``tile`` (the overlay's height) :func:`composite_tiled`.

    ``overlay`` has ``y`` and the channel arrays of one raster. A base line meets the one overlay line at its height, so
    the join is by line and as many rows come out as went in; the samples are blended line by line in the same task.
    """
    require(lines, "asset_id", "w", "h", "y", *CHANNELS, "a")
    require(overlay, "y", *CHANNELS, "a")
    ox, oy = (v if isinstance(v, Column) else F.lit(v) for v in (ox, oy))
    planes, rest = (*CHANNELS, "a"), [c for c in lines.columns if c not in (*CHANNELS, "a")]
    key = F.col("y") - oy if tile is None else F.col("y") % tile
    whole = lambda n, name: F.col(n).cast("array<int>").alias(name)
    side = overlay.select(F.col("y").cast("long").alias("_oy"), *[whole(n, f"_o{n}") for n in planes])
    met = (lines.select(*rest, *[whole(n, n) for n in planes], ox.cast("long").alias("_ox"), key.cast("long").alias("_oy"))
           .join(side, "_oy", "left").select(*rest, *planes, "_ox", *[f"_o{n}" for n in planes]))
    schema = ", ".join([*[f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in rest], *[f"{n} array<int>" for n in planes]])
    return met.mapInArrow(_line_blender(depth, tile is not None), schema).select(*lines.columns)


def watermark_lines(lines: DataFrame, overlay: DataFrame, ow: int, oh: int, gravity: str = "southeast", margin: int = 0,
                    opacity: float = 1.0, tile: bool = False, had_alpha: Column | None = None, depth: int = 8) -> DataFrame:
    """:func:`watermark` on scanlines: opacity, placement (or tiling) and blend."""
    if opacity < 1.0:
        overlay = overlay.withColumn("a", F.transform("a", lambda v: F.round(v * opacity).cast("int")))
    ox, oy = gravity_origin(F.lit(gravity), F.col("w"), F.col("h"), F.lit(ow), F.lit(oh), F.lit(margin))
    out = composite_lines(lines, overlay, ox, oy, depth, oh if tile else None)
    full = F.transform("a", lambda v: F.when(v.isNotNull(), F.lit(2 ** depth - 1)))
    return out if had_alpha is None else out.withColumn("a", F.when(had_alpha, F.col("a")).otherwise(full))


def restore_opaque(px: DataFrame, had_alpha: Column, depth: int = 8) -> DataFrame:
    """A base without alpha stays opaque after compositing."""
    return px.withColumn("a", F.when(had_alpha, F.col("a")).otherwise(F.lit(2 ** depth - 1)))


def watermark(base: DataFrame, overlay: DataFrame, ow: int, oh: int, gravity: str = "southeast", margin: int = 0,
              opacity: float = 1.0, tile: bool = False, had_alpha: Column | None = None, depth: int = 8) -> DataFrame:
    """Opacity, placement (or tiling) and blend in one; scale the overlay beforehand if wanted."""
    over = overlay_opacity(overlay, opacity)
    if tile:
        out = composite_tiled(base, over, ow, oh, depth)
    else:
        ox, oy = gravity_origin(F.lit(gravity), F.col("w"), F.col("h"), F.lit(ow), F.lit(oh), F.lit(margin))
        out = composite(base, over, ox, oy, depth)
    return out if had_alpha is None else restore_opaque(out, had_alpha, depth)


def narrow_layout(px: DataFrame, facts: DataFrame, depth: int = 8) -> DataFrame:
    """Per asset L / LA / RGB / RGBA, never losing anything.

    ``facts`` gives ``asset_id, source_gray, source_alpha``.
    """
    top = 2 ** depth - 1
    seen = px.groupBy("asset_id").agg(
        F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("all_gray"),
        (F.min("a") < top).alias("any_translucent"))
    gray = F.col("source_gray") & F.col("all_gray")
    alpha = F.col("source_alpha") | F.col("any_translucent")
    layout = (F.when(gray & alpha, F.lit("LA")).when(gray, F.lit("L"))
              .when(alpha, F.lit("RGBA")).otherwise(F.lit("RGB")))
    return seen.join(facts.select("asset_id", "source_gray", "source_alpha"), "asset_id").select(
        "asset_id", "all_gray", "any_translucent", layout.alias("layout"))


def depth_downgrade(df: DataFrame, depth: str = "bit_depth", target: str = "target_fmt") -> DataFrame:
    """Flag (and word) a source deeper than 8 bits going to an 8-bit-only target."""
    flag = (F.col(depth) > 8) & F.col(target).isin(*fixed.EIGHT_BIT_ONLY)
    text = F.concat(F.lit("warning: "), F.col(depth).cast("string"),
                    F.lit("-bit source downgraded to 8-bit for "), F.col(target), F.lit(" output"))
    return df.withColumns({"downgraded": flag, "warning": F.when(flag, text)})
