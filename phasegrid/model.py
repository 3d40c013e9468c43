"""Tables of the engine and the constants they share.

phase(ifg_id, row, col, phase): one row for each pixel of each interferogram,
null where there is no observation. ifgs(ifg_id, first_date, second_date, ...):
one row for each interferogram. Everything that grows with the image is a
DataFrame; the network (interferograms, epochs, loops) is small by nature and
may be collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

#: Fixed values of the data model.
DAYS_PER_YEAR = 365.25
SPEED_OF_LIGHT = 3e8
MM_PER_METRE = 1000.0
METRE_PER_KM = 1000.0
NODATA_TOLERANCE = 1e-6

PHASE = "ifg_id int, row int, col int, phase double"
IFGS = "ifg_id int, first_date date, second_date date, time_span double, wavelength double, nan_fraction double"


@dataclass(frozen=True)
class Grid:
    """Geometry of a raster: cells, corner and steps in degrees, and the size
    of its centre cell in metres."""

    nrows: int
    ncols: int
    x_first: float = 0.0
    y_first: float = 0.0
    x_step: float = 1.0
    y_step: float = -1.0
    x_size: float = 1.0
    y_size: float = 1.0

    @property
    def x_last(self) -> float:
        return self.x_first + self.ncols * self.x_step

    @property
    def y_last(self) -> float:
        return self.y_first + self.nrows * self.y_step

    @property
    def x_centre(self) -> int:
        return self.ncols // 2

    @property
    def y_centre(self) -> int:
        return self.nrows // 2

    def centre(self) -> tuple[float, float]:
        """Latitude and longitude of the centre cell."""
        return self.y_first + self.y_step * self.y_centre, self.x_first + self.x_step * self.x_centre


@dataclass(frozen=True, order=True)
class Ifg:
    """An interferogram of the network."""

    ifg_id: int
    first: date
    second: date
    weight: float = 0.0

    @property
    def days(self) -> int:
        return (self.second - self.first).days

    @property
    def years(self) -> float:
        return self.days / DAYS_PER_YEAR


@dataclass(frozen=True)
class Network:
    """Interferograms in order of their id, and the epochs they span."""

    ifgs: tuple[Ifg, ...]
    dates: tuple[date, ...] = field(default=())

    @classmethod
    def of(cls, rows) -> "Network":
        """From rows of ifgs; dates must run forward."""
        made = []
        for r in rows:
            x = r.asDict() if hasattr(r, "asDict") else dict(r)
            if not x["first_date"] < x["second_date"]:
                raise ValueError(f"interferogram {x['ifg_id']}: its first date must be before its second")
            made.append(Ifg(x["ifg_id"], x["first_date"], x["second_date"], float(x.get("nan_fraction") or 0.0)))
        made.sort()
        return cls(tuple(made), tuple(sorted({d for i in made for d in (i.first, i.second)})))

    def index(self) -> dict[date, int]:
        return {d: i for i, d in enumerate(self.dates)}

    def spans(self) -> list[float]:
        """Years of each epoch since the first."""
        return [(d - self.dates[0]).days / DAYS_PER_YEAR for d in self.dates]
