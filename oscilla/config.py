"""Constants of the recordings' test rig and of the two feature generations.

Fixed values: rates, speeds, geometry, sizes, bands and multipliers.
"""

from __future__ import annotations

from dataclasses import dataclass

FS = 12_000
OTHER_FS = 48_000
RPM_BY_LOAD = {0: 1797, 1: 1772, 2: 1750, 3: 1730}
DEFAULT_RPM = 1797
RPM_TOLERANCE = 20
NOMINAL_SECONDS = 10
SECONDS_TOLERANCE = 3
DIAMETERS = (7, 14, 21, 28, 40)
OTHER_BEARING_DIAMETERS = (28, 40)
LABELS = ("Normal", "IR", "OR", "B")
LABEL_NUMBERS = {"NORMAL": 0, "IR": 1, "OR": 2, "B": 3}
NORMAL_FILES = (("97", 0), ("98", 1), ("99", 2), ("100", 3))
BAND_EDGES = (0.0, 50.0, 100.0, 200.0, 400.0, 800.0, 1600.0, 3200.0, 6000.0)
FAULT_MULTIPLIERS = {"BPFI": 5.4152, "BPFO": 3.5848, "BSF": 2.357}
TOLERANCE_HZ = 2.0
EPS = 1e-10


@dataclass(frozen=True)
class Geometry:
    """Of a ball bearing: balls, ball and pitch diameter, contact angle in degrees."""

    balls: int = 9
    ball_diameter: float = 0.3126
    pitch_diameter: float = 1.537
    contact_angle: float = 0.0


DRIVE_END = Geometry()
