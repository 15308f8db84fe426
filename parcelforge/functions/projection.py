"""Plane grids to and from degrees: transverse Mercator by its series, and the sphere's Mercator of web maps.

The formulas take the module of functions that they are said in: Spark's (columns), numpy (arrays
inside a reader's task) or math (numbers). Errors of the series stay far below a millimetre
within some thousand kilometres of the central meridian. Both datums in use here (NAD83, WGS84)
are taken as one, as they differ by less than the data's accuracy.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import functions as F


@dataclass(frozen=True)
class TransverseMercator:
    """A grid; false origins in metres, ``unit`` is the length of the file's unit in metres."""

    lat0: float = 0.0
    lon0: float = 0.0
    k0: float = 1.0
    east0: float = 0.0
    north0: float = 0.0
    a: float = 6378137.0
    inverse_flattening: float = 298.257222101
    unit: float = 1.0

    @property
    def _n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def _radius(self) -> float:
        n = self._n
        return self.k0 * self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def _to_plane(self) -> list[float]:
        n = self._n
        return [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
        ]

    def _to_sphere(self) -> list[float]:
        n = self._n
        return [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]

    def _to_latitude(self) -> list[float]:
        n = self._n
        return [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]

    def _plane(self, lat, lon, m):
        """(along the meridian, across it) in radians of the grid."""
        e = 2 * math.sqrt(self._n) / (1 + self._n)
        s, d = m.sin(m.radians(lat)), m.radians(lon - self.lon0)
        t = m.sinh(m.atanh(s) - e * m.atanh(e * s))
        along, across = m.atan2(t, m.cos(d)), m.atanh(m.sin(d) / m.sqrt(1 + t * t))
        up, right = along, across
        for j, c in enumerate(self._to_plane(), 1):
            up = up + c * m.sin(2 * j * along) * m.cosh(2 * j * across)
            right = right + c * m.cos(2 * j * along) * m.sinh(2 * j * across)
        return up, right

    def _origin(self) -> float:
        return self._plane(self.lat0, self.lon0, math)[0]

    def forward(self, lat, lon, m=F):
        """(x, y) of a place in degrees, in the file's unit."""
        up, right = self._plane(lat, lon, m)
        return (self.east0 + self._radius * right) / self.unit, (self.north0 + self._radius * (up - self._origin())) / self.unit

    def inverse(self, x, y, m=F):
        """(lat, lon) in degrees."""
        up, right = (y * self.unit - self.north0) / self._radius + self._origin(), (x * self.unit - self.east0) / self._radius
        along, across = up, right
        for j, c in enumerate(self._to_sphere(), 1):
            along = along - c * m.sin(2 * j * up) * m.cosh(2 * j * right)
            across = across - c * m.cos(2 * j * up) * m.sinh(2 * j * right)
        conformal = m.asin(m.sin(along) / m.cosh(across))
        lat = conformal
        for j, c in enumerate(self._to_latitude(), 1):
            lat = lat + c * m.sin(2 * j * conformal)
        return m.degrees(lat), m.degrees(m.atan2(m.sinh(across), m.cos(along))) + self.lon0


@dataclass(frozen=True)
class WebMercator:
    """Mercator of the sphere, as web maps use it."""

    radius: float = 6378137.0

    def forward(self, lat, lon, m=F):
        return m.radians(lon) * self.radius, m.atanh(m.sin(m.radians(lat))) * self.radius

    def inverse(self, x, y, m=F):
        return m.degrees(m.asin(m.tanh(y / self.radius))), m.degrees(x / self.radius)


#: The provincial grid with the reference meridian 114 degrees west.
ALBERTA_3TM_114 = TransverseMercator(lon0=-114.0, k0=0.9999)

#: Names of one parameter in both versions of the text.
_PARAMETERS = {
    "lat0": ("latitudeoforigin", "latitudeofnaturalorigin"), "lon0": ("centralmeridian", "longitudeofnaturalorigin"),
    "k0": ("scalefactor", "scalefactoratnaturalorigin"), "east0": ("falseeasting",), "north0": ("falsenorthing",),
}
_NUMBER = r"\s*,\s*([-+0-9.eE]+)"


def from_prj(text: str | None) -> TransverseMercator | WebMercator | None:
    """The grid that a .prj text describes; None for no text and for degrees, an error for a grid that isn't known here."""
    text = text or ""
    if not re.search(r"PROJCR?S", text.upper()):
        return None
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    kind = re.search(r'(?:PROJECTION|METHOD)\s*\[\s*"([^"]*)"', text, re.IGNORECASE)
    kind = plain(kind[1]) if kind else ""
    if kind in ("mercatorauxiliarysphere", "popularvisualisationpseudomercator"):
        return WebMercator()
    if kind != "transversemercator":
        raise ValueError(f"no reprojection from {kind or 'a grid without a name'}")
    given = {plain(name): float(value) for name, value in re.findall(rf'PARAMETER\s*\[\s*"([^"]*)"{_NUMBER}', text, re.IGNORECASE)}
    found = {field: next((given[n] for n in names if n in given), None) for field, names in _PARAMETERS.items()}
    found = {k: v for k, v in found.items() if v is not None}
    shape = re.search(rf'(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"{_NUMBER}{_NUMBER}', text, re.IGNORECASE)
    if shape:
        found |= {"a": float(shape[1]), "inverse_flattening": float(shape[2])}
    lengths = [float(v) for name, v in re.findall(rf'UNIT\s*\[\s*"([^"]*)"{_NUMBER}', text, re.IGNORECASE) if re.search("met|f[o]?[oe]t", name, re.IGNORECASE)]
    unit = lengths[-1] if lengths else 1.0
    for field in ("east0", "north0"):
        if field in found:
            found[field] *= unit
    return TransverseMercator(**found, unit=unit)
