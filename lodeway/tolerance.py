"""Tolerances are part of the semantics of the geometry kernels, so they travel explicitly."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .errors import UnsupportedInputError


@dataclass(frozen=True)
class Tolerance:
    """Absolute tolerances in coordinate units (fixed default values)."""

    point: float = 0.01
    segment: float = 0.02
    polygon: float = 0.03
    delta: float = 0.01
    collinear: float = 0.001
    slope: float = 0.001
    vertical: float = 0.001

    def with_(self, **changes: float) -> Tolerance:
        unknown = set(changes) - set(self.__dataclass_fields__)
        if unknown:
            raise UnsupportedInputError(f"no such tolerance: {', '.join(sorted(unknown))}")
        return replace(self, **changes)


DEFAULT = Tolerance()
EARTH_RADIUS_MILES = 3958.8
EARTH_RADIUS_METERS = 6378137.0
