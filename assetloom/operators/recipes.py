"""Recipes: ordered steps, validation, application, bundled flows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..schemas import require
from . import raster

C = F.col
STEP_SCHEMA = "array<struct<op:string,params:map<string,string>>>"


@dataclass(frozen=True)
class Op:
    """A registered operation: plan-time application (to pixels and, where given, to scanlines) and a validity Column over ``params``."""
    name: str
    apply: Callable[[DataFrame, dict[str, str]], DataFrame]
    check: Callable[[Column], Column]
    lines: Callable[[DataFrame, dict[str, str]], DataFrame] | None = None


OPS: dict[str, Op] = {}


def _no_params(_: Column) -> Column:
    return F.lit(None).cast("string")


def register_op(name: str, apply: Callable[[DataFrame, dict[str, str]], DataFrame],
                check: Callable[[Column], Column] = _no_params,
                lines: Callable[[DataFrame, dict[str, str]], DataFrame] | None = None) -> Op:
    """Add or replace an operation (the user extension point)."""
    if name == fixed.TERMINAL_STEP:
        raise ValueError(f"'{name}' is reserved")
    OPS[name] = Op(name, apply, check, lines)
    return OPS[name]


def _resize_check(params: Column) -> Column:
    mode = F.try_element_at(params, F.lit("mode"))
    num = lambda k: F.try_element_at(params, F.lit(k)).try_cast("bigint")
    pct = F.try_element_at(params, F.lit("percent")).try_cast("double")
    need = lambda k: F.coalesce(num(k) <= 0, F.lit(True))
    boxed = mode.isin("exact", "fit", "fill", "cover")
    return (F.when(mode.isNull(), "'mode' is not given")
            .when(~mode.isin("max", "exact", "percent", "fit", "fill", "cover"), F.concat(F.lit("no such mode: '"), mode, F.lit("'")))
            .when(((mode == "max") | boxed) & need("width"), F.concat(F.lit("mode '"), mode, F.lit("' needs a positive 'width'")))
            .when(boxed & need("height"), F.concat(F.lit("mode '"), mode, F.lit("' needs a positive 'height'")))
            .when((mode == "percent") & F.coalesce(pct <= 0, F.lit(True)), "mode 'percent' needs a positive 'percent'"))


def _resize(resize: Callable[..., DataFrame]) -> Callable[[DataFrame, dict[str, str]], DataFrame]:
    def run(df: DataFrame, p: dict[str, str]) -> DataFrame:
        num = lambda k: int(p[k]) if k in p else None
        return resize(df, p["mode"], num("width"), num("height"), float(p["percent"]) if "percent" in p else None)
    return run


def _oriented(orient: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, dict[str, str]], DataFrame]:
    return lambda df, _: orient(df).drop("orientation") if "orientation" in df.columns else df


register_op("identity", lambda px, p: raster.identity(px), lines=lambda df, p: df)
register_op("invert", lambda px, p: raster.invert(px), lines=lambda df, p: raster.invert_lines(df))
register_op("auto-orient", _oriented(raster.auto_orient), lines=_oriented(raster.auto_orient_lines))
register_op("resize", _resize(raster.resize), _resize_check, _resize(raster.resize_lines))


def recipe_steps(docs: DataFrame) -> DataFrame:
    """Documents (``recipe, doc`` JSON) -> ordered step rows."""
    return docs.select("recipe", F.posexplode(F.from_json("doc", STEP_SCHEMA)).alias("step_idx", "_s")).select(
        "recipe", "step_idx", "_s.op", F.coalesce("_s.params", F.create_map().cast("map<string,string>")).alias("params"))


def to_recipe(steps: DataFrame) -> DataFrame:
    """Step rows -> documents; a recipe holds at most 1024 steps."""
    require(steps, "recipe", "step_idx", "op", "params")
    params = F.map_from_entries(F.array_sort(F.map_entries("params")))
    listed = F.array_sort(F.collect_list(F.struct("step_idx", "op", F.to_json(params).alias("p"))))
    body = F.transform("_l", lambda s: F.concat(F.lit('{"op":"'), s["op"], F.lit('","params":'), s["p"], F.lit("}")))
    return steps.groupBy("recipe").agg(listed.alias("_l")).select(
        "recipe", F.concat(F.lit("["), F.array_join(body, ","), F.lit("]")).alias("doc"))


def validate_recipe(steps: DataFrame, version: Column | str = fixed.RECIPE_VERSION) -> DataFrame:
    """Violations only: version, length, unknown op, bad params."""
    version = F.lit(version) if isinstance(version, str) else version
    known = C("op").isin(*OPS)
    params = None
    for op in OPS.values():
        reason = op.check(C("params"))
        params = F.when(C("op") == op.name, reason) if params is None else params.when(C("op") == op.name, reason)
    reason = (F.when(version != fixed.RECIPE_VERSION, "unsupported recipe version")
              .when(C("step_idx") >= fixed.RECIPE_MAX_STEPS, "too many steps")
              .when(~known, F.concat(F.lit("unknown operation '"), C("op"), F.lit("'"))).otherwise(params))
    return steps.withColumn("reason", reason).where("reason is not null").select("recipe", "step_idx", "op", "reason")


def split_terminal(steps: DataFrame) -> DataFrame:
    """Mark a final ``optimize`` step; anywhere else it stays an ordinary (unknown) op."""
    last = F.max("step_idx").over(Window.partitionBy("recipe"))
    terminal = (C("op") == fixed.TERMINAL_STEP) & (C("step_idx") == last)
    return steps.withColumn("terminal", terminal)


def pixel_steps(steps: DataFrame) -> DataFrame:
    """Steps left for the pixel chain."""
    return split_terminal(steps).where(~C("terminal")).drop("terminal")


def _known(steps: list[tuple[str, dict[str, str]]]) -> None:
    unknown = [op for op, _ in steps if op not in OPS]
    if unknown:
        raise ValueError(f"unknown operation '{unknown[0]}'")


def apply_recipe(px: DataFrame, steps: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """Fold the ops into one plan; an unknown op raises before any plan exists."""
    _known(steps)
    return reduce(lambda d, s: OPS[s[0]].apply(d, s[1]), steps, px)


def apply_recipe_lines(lines: DataFrame, steps: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """:func:`apply_recipe` on scanlines. Ops that know pixels only get pixels, and their result is gathered to lines again."""
    _known(steps)

    def step(df: DataFrame, op: Op, params: dict[str, str]) -> DataFrame:
        if op.lines is not None:
            return op.lines(df, params)
        return raster.collect_scanlines(op.apply(raster.explode_pixels(df), params))

    return reduce(lambda d, s: step(d, OPS[s[0]], s[1]), steps, lines)


def line_sum(plane: str) -> Column:
    """Sum of a line's samples."""
    return F.aggregate(plane, F.lit(0).cast("bigint"), lambda total, v: total + F.coalesce(v, F.lit(0)))


def bundled(name: str) -> list[tuple[str, dict[str, str]]]:
    """Steps of a shipped flow."""
    edge = fixed.BUNDLED_MAX_EDGE[name]
    return [("auto-orient", {}), ("resize", {"mode": "max", "width": str(edge)}), (fixed.TERMINAL_STEP, {})]


def bundled_doc(name: Column) -> Column:
    """JSON document of a shipped flow, NULL for other names."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, edge in fixed.BUNDLED_MAX_EDGE.items():
        out = out.when(name == key, F.lit(
            '[{"op":"auto-orient","params":{}},{"op":"resize","params":{"mode":"max","width":"%d"}},{"op":"optimize","params":{}}]' % edge))
    return out


def resolve_recipes(requests: DataFrame, files: DataFrame) -> DataFrame:
    """A real recipe file shadows a bundled name; NULL ``doc`` means not found."""
    found = requests.join(files.select(C("recipe").alias("name"), C("doc").alias("_file")), "name", "left")
    return found.withColumn("origin", F.when(C("_file").isNotNull(), "file").when(bundled_doc(C("name")).isNotNull(), "bundled")
                            ).withColumn("doc", F.coalesce("_file", bundled_doc(C("name")))).drop("_file")


def canonical_chain(df: DataFrame) -> DataFrame:
    """Edit flags -> ops in fixed order whatever order they were given in; none is an error."""
    ops = F.array_compact(F.array(
        F.when(C("auto_orient"), "auto-orient"), F.when(C("resize_max").isNotNull(), F.concat(
            F.lit("resize:"), C("resize_max").cast("string"))), F.when(C("invert"), "invert")))
    return df.withColumn("ops", ops).withColumn(
        "reason", F.when(F.size("ops") == 0, "nothing to do: no operation was asked for"))
