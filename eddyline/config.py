"""Settings of an analysis, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Sizes are in cells of ``cell_km`` before thinning; see ``frame_cells`` and ``volume_cells``.

    iou: matches need overlap / union strictly above this ratio, in whole numbers; None takes the largest overlap whatever its share.
    gap_start: after a gap an interval starts on the day after the last one ended ("reference") or on reappearance ("island").
    close_open_events: whether what is alive on the last day ends there (else it has no interval).
    """

    height: int
    width: int
    cell_km: int = 10
    min_value: float = 0.2
    downsample: int = 1
    window_days: int = 200
    step_days: int = 150
    iou: tuple[int, int] | None = (1, 5)
    min_days: int = 5
    min_area_frame: int = 100_000
    min_area_time: int = 500_000
    hole_max: int = 10
    frame_connectivity: int = 8
    dust_connectivity: int = 4
    gap_start: str = "reference"
    close_open_events: bool = True

    def __post_init__(self) -> None:
        if self.step_days <= 0 or self.downsample < 1:
            raise ValueError("step_days and downsample are 1 or more")
        if self.gap_start not in ("reference", "island"):
            raise ValueError("gap_start is reference or island")

    @property
    def cells(self) -> int:
        return self.height * self.width

    def _cells(self, area: int) -> int:
        return int(cells_of_area(area, self.cell_km) / self.downsample**2)

    @property
    def frame_cells(self) -> int:
        return max(1, self._cells(self.min_area_frame))

    @property
    def volume_cells(self) -> int:
        return max(5, self._cells(self.min_area_time))

    @property
    def event_cells(self) -> int:
        """Least volume of an event; unlike that of a tracked volume it has no floor."""
        return self._cells(self.min_area_time)

    @property
    def cell_area(self) -> int:
        return (self.cell_km * self.downsample) ** 2


@dataclass(frozen=True)
class Axis:
    """A regular axis of cell centres: the first one's coordinate, from one to the next, and how many. A table of cells that is sparse doesn't tell it."""

    start: float
    step: float
    size: int

    def __post_init__(self) -> None:
        if self.step <= 0 or self.size < 0:
            raise ValueError("an axis rises and has no less than no cells")

    def first(self, low: float) -> int:
        """The number of the first cell at ``low`` or above; to a thousand-millionth of a cell, however it was computed."""
        return min(self.size, max(0, math.ceil(round((low - self.start) / self.step, 9))))

    def last(self, high: float) -> int:
        """The number of the last cell at ``high`` or below; -1 for none."""
        return max(-1, min(self.size - 1, math.floor(round((high - self.start) / self.step, 9))))

    def at(self, k: int) -> float:
        return self.start + k * self.step


def cells_of_area(area: float, cell_km: float) -> int:
    """How many cells an area in square kilometres takes."""
    return math.ceil(area / cell_km**2)


def check_box(values: list[float]) -> tuple[float, float, float, float]:
    """(lat_min, lat_max, lon_min, lon_max) from four numbers in this order."""
    if len(values) != 4:
        raise ValueError("a box takes four numbers: lat_min, lat_max, lon_min, lon_max")
    a, b, c, d = map(float, values)
    if a > b or c > d:
        raise ValueError("a box's least values come first")
    return a, b, c, d


def overlap_of_days(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int] | None:
    """The days two spans share, where they share more than one."""
    start, end = max(a[0], b[0]), min(a[1], b[1])
    return (start, end) if start < end else None


def windows_shown(full: int, window: int, step: int) -> int:
    """The number of windows for display: those that lie whole in ``full`` days."""
    if step <= 0:
        raise ValueError("step is 1 or more")
    return 0 if window > full else (full - window) // step + 1


def window_starts(first: int, last: int, window: int, step: int) -> list[tuple[int, int, bool]]:
    """(first day, last day, whether it is the last window) of each window over the days first..last."""
    out, start = [], first
    while start < last or not out:
        end = start + window
        out.append((start, min(end, last), end >= last))
        if end >= last:
            break
        start += step
    return out
