"""Boxes (x1, y1, x2, y2; the far edges exclusive) as Spark columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def centre(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    @property
    def valid(self) -> Column:
        return (self.x2 > self.x1) & (self.y2 > self.y1)

    def clip(self, width, height) -> Box:
        """Inside the frame, at least one pixel wide and high."""
        x1 = F.least(F.greatest(self.x1, F.lit(0.0)), F.lit(width - 1.0))
        y1 = F.least(F.greatest(self.y1, F.lit(0.0)), F.lit(height - 1.0))
        return Box(x1, y1, F.least(F.greatest(self.x2, x1 + 1), F.lit(float(width))), F.least(F.greatest(self.y2, y1 + 1), F.lit(float(height))))

    def clip_loose(self, width, height) -> Box:
        """Each edge by itself, the near ones up to one pixel from the far border
        and the far ones from one pixel on; the box may be left without an extent."""
        near = lambda v, most: clamp(v, 0.0, most - 1.0)
        far = lambda v, most: clamp(v, 1.0, float(most))
        return Box(near(self.x1, width), near(self.y1, height), far(self.x2, width), far(self.y2, height))

    def rounded(self) -> Box:
        """Whole pixels, halves to the even one."""
        return Box(*[F.bround(v, 0).cast("bigint") for v in self])

    def xywh(self) -> tuple[Column, Column, Column, Column]:
        return self.x1, self.y1, self.width, self.height

    def cxcywh(self) -> tuple[Column, Column, Column, Column]:
        return (*self.centre, self.width, self.height)

    def unletterbox(self, scale, pad_x, pad_y) -> Box:
        """Back from a scaled and padded frame."""
        return Box((self.x1 - pad_x) / scale, (self.y1 - pad_y) / scale, (self.x2 - pad_x) / scale, (self.y2 - pad_y) / scale)

    def scale(self, f: float) -> Box:
        """About the centre, by a factor above zero."""
        if f <= 0:
            raise ValueError(f"a box cannot be scaled by {f}")
        (cx, cy), w, h = self.centre, self.width * f / 2, self.height * f / 2
        return Box(cx - w, cy - h, cx + w, cy + h)

    def truncation(self, width, height) -> Column:
        """The share of the area outside the frame."""
        w = F.least(self.x2, F.lit(float(width))) - F.greatest(self.x1, F.lit(0.0))
        h = F.least(self.y2, F.lit(float(height))) - F.greatest(self.y1, F.lit(0.0))
        return 1 - F.try_divide(F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)), self.area)

    def measurement(self) -> tuple[Column, Column, Column, Column]:
        """Centre, area (1 at least) and aspect ratio (1e-6 at least)."""
        return (*self.centre, F.greatest(self.area, F.lit(1.0)), F.greatest(F.try_divide(self.width, self.height), F.lit(1e-6)))


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{n}").cast("double") for n in ("x1", "y1", "x2", "y2")])


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def from_cxcywh(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def from_measurement(u: Column, v: Column, s: Column, r: Column) -> Box:
    """Of centre, area (1 at least) and aspect ratio (1e-6 at least)."""
    s, r = F.greatest(s, F.lit(1.0)), F.greatest(r, F.lit(1e-6))
    w = F.sqrt(s * r)
    return from_cxcywh(u, v, w, s / w)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def roll_degrees(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Of the line from the first point to the second."""
    return F.degrees(F.atan2(by - ay, bx - ax))


def direction_consistency(from_x: Column, from_y: Column, to_x: Column, to_y: Column, heading_x: Column, heading_y: Column) -> Column:
    """0..1: how well a move goes on in a heading (a unit vector); 0.5 without a heading."""
    dx, dy = to_x - from_x, to_y - from_y
    cos = (dx * heading_x + dy * heading_y) / (F.sqrt(dx * dx + dy * dy) + 1e-6)
    none = (heading_x == 0) & (heading_y == 0)
    return F.when(none, 0.5).otherwise((clamp(cos, -1.0, 1.0) + 1) / 2)


def seconds(ticks: Column, num: int = 1, den: int = 1_000_000) -> Column:
    """Ticks of num/den seconds; null stays null."""
    return ticks * F.lit(num) / F.lit(den)


def declared_variable(average: Column, guessed: Column) -> Column:
    """Whether the two declared frame rates differ; no if either is missing."""
    return F.coalesce(average != guessed, F.lit(False))


def overlap(a: Box, b: Box) -> Column:
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0))
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    return w * h


def iou(a: Box, b: Box) -> Column:
    inter = overlap(a, b)
    return F.coalesce(F.try_divide(inter, a.area + b.area - inter), F.lit(0.0))


def containment(outer: Box, inner: Box) -> Column:
    """The share of ``inner`` that lies in ``outer``."""
    return F.coalesce(F.try_divide(overlap(outer, inner), inner.area), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clock(micros: Column) -> Column:
    """HH:MM:SS.mmm, the fraction cut, hours unbounded."""
    part = lambda div, mod=None: F.floor(micros / div).cast("bigint") if mod is None else F.floor(micros / div).cast("bigint") % mod
    two = lambda c, n: F.lpad(c.cast("string"), n, "0")
    hours = part(3_600_000_000)
    return F.concat(F.when(hours < 100, two(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), two(part(60_000_000, 60), 2), F.lit(":"), two(part(1_000_000, 60), 2), F.lit("."), two(part(1_000, 1000), 3))
