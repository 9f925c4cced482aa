"""Similarity fits of landmarks to a template, in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five points of the 112 x 112 template.
TEMPLATE = [(38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041)]


def scaled_template(width: float, height: float, padding: float = 0.0, size: float = 112.0, template=TEMPLATE) -> list[tuple[float, float]]:
    """The template for another crop size, shrunk about the centre to leave padding."""
    return [tuple(c / 2 + (v * c / size - c / 2) / (1 + padding) for v, c in zip(point, (width, height), strict=True)) for point in template]


def similarity(xs: list[Column], ys: list[Column], template=TEMPLATE) -> dict[str, Column]:
    """Rotation and scale (a, b), translation (tx, ty), scale, rotation in
    degrees and RMS residual; null where the points coincide."""
    n = len(template)
    mx, my = sum(xs[1:], xs[0]) / n, sum(ys[1:], ys[0]) / n
    ux, uy = (sum(t[k] for t in template) / n for k in (0, 1))
    terms = [(x - mx, y - my, u - ux, v - uy) for x, y, (u, v) in zip(xs, ys, template, strict=True)]
    total = lambda f: sum((f(*t) for t in terms[1:]), f(*terms[0]))
    d = total(lambda x, y, u, v: x * x + y * y)
    d = F.when(d / n >= 1e-8, d)
    a, b = total(lambda x, y, u, v: x * u + y * v) / d, total(lambda x, y, u, v: x * v - y * u) / d
    err = total(lambda x, y, u, v: F.pow(a * x - b * y - u, 2) + F.pow(b * x + a * y - v, 2))
    return {"a": a, "b": b, "tx": ux - a * mx + b * my, "ty": uy - b * mx - a * my, "scale": F.sqrt(a * a + b * b), "rotation": F.degrees(F.atan2(b, a)), "residual": F.sqrt(err / n)}


def inverse(a: Column, b: Column, tx: Column, ty: Column) -> dict[str, Column]:
    d = a * a + b * b
    return {"ia": a / d, "ib": -b / d, "itx": -(a * tx + b * ty) / d, "ity": (b * tx - a * ty) / d}
