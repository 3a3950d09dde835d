"""Physical constants and closed-form conversions as column expressions."""

from __future__ import annotations

import math

from .text import Text, X

# CODATA constants in SI units.
ELEMENTARY_CHARGE_C = 1.602176634e-19
ELECTRON_MASS_KG = 9.1093837139e-31
BOLTZMANN_J_PER_K = 1.380649e-23

# Fixed value: line density per (GHz * rad) of interferometer phase, in m^-2,
# i.e. 1.18e6 s m^-2 rad^-1 times 1e9 Hz per GHz.
LINE_DENSITY_PER_GHZ_RAD_M2 = 1.18e6 * 1e9

# Factors that bring a unit named in the data to the base unit.
CURRENT_TO_A = {"A": 1.0, "mA": 1e-3, "uA": 1e-6}
AREA_TO_M2 = {"m2": 1.0, "cm2": 1e-4, "mm2": 1e-6}
TEMPERATURE_TO_EV = {"eV": 1.0, "K": BOLTZMANN_J_PER_K / ELEMENTARY_CHARGE_C}
LENGTH_TO_CM = {"m": 100.0, "cm": 1.0, "mm": 0.1, "um": 1e-4, "inch": 2.54, "in": 2.54}


def electron_density_m3(
    ies: Text,
    te: Text,
    area: Text | float,
    *,
    current_unit: str = "A",
    temperature_unit: str = "eV",
    area_unit: str = "m2",
    use_abs: bool = False,
) -> Text:
    """Density from the random electron flux onto a planar face.

    n = I / (e A sqrt(e Te / (2 pi m_e))).  Inputs that are missing, not finite or
    not positive give NULL; ``use_abs`` accepts a reversed current convention.
    """
    current = ies.cast("double") * CURRENT_TO_A[current_unit]
    if use_abs:
        current = X.abs(current)
    energy = te.cast("double") * TEMPERATURE_TO_EV[temperature_unit]
    face = (X.lit(float(area)) if not isinstance(area, Text) else area.cast("double")) * (
        AREA_TO_M2[area_unit]
    )
    speed_per_root_ev = math.sqrt(ELEMENTARY_CHARGE_C / (2 * math.pi * ELECTRON_MASS_KG))
    top = 1.7976931348623157e308
    usable = (
        current.between(5e-324, top) & energy.between(5e-324, top) & face.between(5e-324, top)
    )
    return X.when(
        usable,
        current / (ELEMENTARY_CHARGE_C * face * (speed_per_root_ev * X.sqrt(energy))),
    )


def line_density_m2(frequency_ghz: float, phase_rad: float, passes: float) -> float:
    """Line-integrated density of an interferometer phase shift."""
    return LINE_DENSITY_PER_GHZ_RAD_M2 * frequency_ghz * phase_rad / passes
