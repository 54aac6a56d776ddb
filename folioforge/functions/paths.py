"""Paths as columns: an array of (verb, xs, ys) with verbs M, L, Q, C and Z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<verb:string,xs:array<double>,ys:array<double>>>"


def _step(verb: str, *points: tuple[Column, Column]) -> Column:
    xs = F.array(*[p[0].cast("double") for p in points]) if points else F.array().cast("array<double>")
    ys = F.array(*[p[1].cast("double") for p in points]) if points else F.array().cast("array<double>")
    return F.struct(F.lit(verb).alias("verb"), xs.alias("xs"), ys.alias("ys"))


def empty() -> Column:
    return F.array().cast(KIND)


def move_to(path: Column, x: Column, y: Column) -> Column:
    return F.concat(path, F.array(_step("M", (x, y))))


def line_to(path: Column, x: Column, y: Column) -> Column:
    return F.concat(path, F.array(_step("L", (x, y))))


def quad_to(path: Column, *points: tuple[Column, Column]) -> Column:
    return F.concat(path, F.array(_step("Q", *points)))


def cubic_to(path: Column, *points: tuple[Column, Column]) -> Column:
    return F.concat(path, F.array(_step("C", *points)))


def close(path: Column) -> Column:
    return F.concat(path, F.array(_step("Z")))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(_step("M", (x0, y0)), _step("L", (x1, y0)), _step("L", (x1, y1)), _step("L", (x0, y1)), _step("Z"))


def transformed(path: Column, m: tuple[Column, ...]) -> Column:
    a, b, c, d, e, f = m
    return F.transform(path, lambda s: F.struct(s["verb"].alias("verb"), F.zip_with(s["xs"], s["ys"], lambda x, y: x * a + y * c + e).alias("xs"), F.zip_with(s["xs"], s["ys"], lambda x, y: x * b + y * d + f).alias("ys")))


def box(path: Column) -> Column:
    """x0, y0, x1, y1 of all points; nulls for a path without any."""
    xs, ys = F.flatten(F.transform(path, lambda s: s["xs"])), F.flatten(F.transform(path, lambda s: s["ys"]))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def closed_corners(path: Column) -> Column:
    """The corners of a path that is one upright rectangle, else null."""
    b = box(path)
    inner = F.filter(path, lambda s: s["verb"] != "Z")
    upright = F.forall(inner, lambda s: (s["xs"][0].isin(b["x0"], b["x1"])) & (s["ys"][0].isin(b["y0"], b["y1"])))
    return F.when((F.size(inner) == 4) & F.forall(inner, lambda s: s["verb"].isin("M", "L")) & upright, b)
