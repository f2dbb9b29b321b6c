"""Column functions over boxes. A box is four columns with a prefix: x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """The corners of a box in a table."""

    def __init__(self, x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str) -> None:
        self.x0, self.y0, self.x1, self.y1 = (F.col(c) if isinstance(c, str) else c for c in (x0, y0, x1, y1))

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(f"{prefix}x0", f"{prefix}y0", f"{prefix}x1", f"{prefix}y1")

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def valid(self) -> Column:
        return (self.x0 <= self.x1) & (self.y0 <= self.y1)

    def expanded(self, x: float, y: float) -> Box:
        """Grown by a share of its width and height on each side."""
        return Box(self.x0 - self.width * x, self.y0 - self.height * y, self.x1 + self.width * x, self.y1 + self.height * y)

    def rescaled(self, x: Column | float, y: Column | float) -> Box:
        return Box(self.x0 * x, self.y0 * y, self.x1 * x, self.y1 * y)

    def within(self, bounds: Box) -> Box:
        return Box(F.greatest(self.x0, bounds.x0), F.greatest(self.y0, bounds.y0), F.least(self.x1, bounds.x1), F.least(self.y1, bounds.y1))

    def overlap_x(self, other: Box) -> Column:
        return F.greatest(F.lit(0.0), F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0))

    def overlap_y(self, other: Box) -> Column:
        return F.greatest(F.lit(0.0), F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0))

    def intersection(self, other: Box) -> Column:
        return self.overlap_x(other) * self.overlap_y(other)

    def share_inside(self, other: Box) -> Column:
        """Part of this box's area that the other covers; 0 for an empty box."""
        return F.when(self.area > 0, self.intersection(other) / self.area).otherwise(0.0)

    def meets(self, other: Box) -> Column:
        """A predicate of four comparisons, for joins."""
        return (self.x0 < other.x1) & (other.x0 < self.x1) & (self.y0 < other.y1) & (other.y0 < self.y1)

    def contains(self, other: Box, tolerance: float = 0.0) -> Column:
        return (self.x0 - tolerance <= other.x0) & (self.y0 - tolerance <= other.y0) & (self.x1 + tolerance >= other.x1) & (self.y1 + tolerance >= other.y1)

    def center_distance(self, other: Box, x_weight: float = 1.0, y_weight: float = 1.0, absolute: bool = False) -> Column:
        dx, dy = self.center[0] - other.center[0], self.center[1] - other.center[1]
        return F.abs(dx) * x_weight + F.abs(dy) * y_weight if absolute else F.sqrt(dx * dx * x_weight + dy * dy * y_weight)

    def corner_distance(self, other: Box) -> Column:
        """Between the upper left corners."""
        return F.sqrt(F.pow(self.x0 - other.x0, F.lit(2.0)) + F.pow(self.y0 - other.y0, F.lit(2.0)))

    def gap(self, other: Box) -> Column:
        """The shortest distance between the boxes; 0 where they meet."""
        dx = F.greatest(F.lit(0.0), other.x0 - self.x1, self.x0 - other.x1)
        dy = F.greatest(F.lit(0.0), other.y0 - self.y1, self.y0 - other.y1)
        return F.sqrt(dx * dx + dy * dy)

    def normalised(self, width: Column | float, height: Column | float, scale: int = 1000) -> list[Column]:
        return [F.floor(c * scale / size).cast("int") for c, size in ((self.x0, width), (self.y0, height), (self.x1, width), (self.y1, height))]


def reading_row(y: Column | str, tolerance: float = 1.25) -> Column:
    """The row of a line for reading order: lines whose tops round to the same step share it."""
    y = F.col(y) if isinstance(y, str) else y
    return F.bround(y / tolerance) * tolerance
