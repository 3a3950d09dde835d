"""Analysis parameters, checked when a plan is built.

Every field becomes a literal of the plan, so nothing is looked up at run time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

# Thresholds of the quality checks.
MIN_CURVE_POINTS = 7
ION_WINDOW_FRACTION = 0.25
SATURATION_MIN_POINTS = 5
SATURATION_MAX_TREND = 0.20
TE_CEILING_FRACTION = 0.80
TE_MIN_LOG_SPAN = 1.0
TE_MAX_RELATIVE_SLOPE_ERROR = 0.30
TE_MAX_CURVATURE_LOG = 0.05
TE_MAX_BLOCK_DEVIATION_LOG = 0.02
TE_CURVATURE_SIGMAS = 3.0
SIGNAL_TO_NOISE = 5.0
MAX_REVERSE_SWEEP_FRACTION = 0.05
MAX_LEAKAGE_FRACTION = 0.02
BULK_WINDOW_WIDTHS_V = (6, 9, 12, 15, 18, 24, 30, 45, 60)

GEOMETRIES = ("x_line", "xy_plane")
SHOT_MODES = ("individual", "average")
TIMING_SOURCES = ("manual", "hdf5")
Y_ORDERS = ("descending", "ascending")


@dataclass(frozen=True)
class Bound:
    """What a parameter may be; numbers lie between ``low`` and ``high``, ends open where said."""

    kind: str
    low: float | None = None
    high: float | None = None
    open_low: bool = False
    open_high: bool = False
    choices: tuple[str, ...] = ()

    def __call__(self, name: str, value: Any) -> Any:
        fault = f"{name}={value!r} is not allowed: {self}"
        if self.kind == "flag":
            if isinstance(value, bool):
                return value
            raise ValueError(fault)
        if self.kind == "choice":
            word = "none" if value is None else str(value).lower()
            if word in self.choices:
                return word
            raise ValueError(fault)
        if self.kind == "whole" and (isinstance(value, bool) or int(value) != value):
            raise ValueError(fault)
        number = int(value) if self.kind == "whole" else float(value)
        below = self.low is not None and (number <= self.low if self.open_low else number < self.low)
        above = self.high is not None and (number >= self.high if self.open_high else number > self.high)
        if not math.isfinite(number) or below or above:
            raise ValueError(fault)
        return number

    def __str__(self) -> str:
        if self.kind == "flag":
            return "True or False"
        if self.kind == "choice":
            return " | ".join(self.choices)
        ends = "(" if self.open_low else "[", ")" if self.open_high else "]"
        return f"{self.kind} number in {ends[0]}{self.low}, {self.high}{ends[1]}"


def whole(default: int, low: int):
    return field(default=default, metadata={"bound": Bound("whole", low)})


def real(default: float | None, low: float, high: float | None = None, **ends: bool):
    return field(default=default, metadata={"bound": Bound("real", low, high, **ends)})


def flag(default: bool):
    return field(default=default, metadata={"bound": Bound("flag")})


def choice(default: str, *choices: str):
    return field(default=default, metadata={"bound": Bound("choice", choices=choices)})


@dataclass(frozen=True)
class FitParams:
    """Parameters of the single-trace analysis; areas are in m^2."""

    iv_npts: int = whole(600, MIN_CURVE_POINTS)
    voltage_bin_width: float = real(0.05, 0, open_low=True)
    vp_smoothing: str | None = choice("savgol", "none", "moving", "savgol")
    vp_smoothing_width_V: float = real(2.5, 0, open_low=True)
    vp_savgol_order: int = whole(2, 1)
    ies_method: str = choice("high_bias_median", "at_vp", "high_bias_median")
    te_region_method: str = choice("linear_region", "bounded", "linear_region")
    te_min_points: int = whole(8, 3)
    te_margin_from_vp: float = real(0.2, 0)
    te_current_floor_frac: float = real(0.03, 0, TE_CEILING_FRACTION, open_high=True)
    te_min_eV: float = real(0.1, 0, open_low=True)
    te_max_eV: float = real(30.0, 0, open_low=True)
    te_min_r2: float = real(0.95, 0, 1)
    ion_min_snr: float = real(3.0, 0)
    probe_area: float | None = real(None, 0, open_low=True)
    current_zero_calibrated: bool = flag(False)
    enforce_ideal_model_checks: bool = flag(False)

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None or f.metadata["bound"].kind == "choice":
                object.__setattr__(self, f.name, f.metadata["bound"](f.name, value))
            elif f.default is not None:
                raise ValueError(f"{f.name} has no value")
        if self.te_min_eV >= self.te_max_eV:
            raise ValueError(f"no temperature lies between te_min_eV={self.te_min_eV} and te_max_eV={self.te_max_eV}")

    @classmethod
    def from_mapping(cls, values: dict[str, Any] | None) -> FitParams:
        """Build from a mapping; unknown keys are an error."""
        values = {} if values is None else values
        if not isinstance(values, dict):
            raise TypeError(f"expected names and values, got {type(values).__name__}")
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"Unknown names: {', '.join(unknown)}")
        return cls(**values)

    def with_(self, **changes: Any) -> FitParams:
        return replace(self, **changes)


@dataclass(frozen=True)
class ScanParams:
    """Acquisition layout, conditioning, spatial and calibration settings of a scan."""

    geometry: str
    nx: int
    nshots: int
    nt_full: int
    dt_s: float
    x_min_cm: float
    x_max_cm: float
    sweep_start: int
    sweep_end: int
    ny: int = 1
    y_min_cm: float = 0.0
    y_max_cm: float = 0.0
    y_order: str = "descending"
    data_offset: int = 0
    board: int = 1
    voltage_channel: int = 1
    current_channel: int = 2
    voltage_attenuation: float = 1.0
    current_attenuation: float = 1.0
    current_resistance_ohm: float = 1.0
    negate_current: bool = False
    nramps: int = 1
    ramp_spacing: int = 1
    subtract_dc: bool = False
    dc_start: int | None = None
    dc_end: int | None = None
    isat_start: int = 0
    isat_end: int = 0
    sg_window: int = 17
    sg_order: int = 1
    shot_mode: str = "individual"
    timing_source: str = "manual"
    enable_spike_rejection: bool = True
    spike_half_window: int | tuple[int, int] = 1
    spike_threshold_V: float = 5.0
    replace_spikes: bool = True
    enable_smoothing: bool = True
    smooth_half_window: int | tuple[int, int] = 1
    smooth_sigma: float = 1.0
    calibrate_density: bool = False
    frequency_GHz: float = 288.0
    phase_rad: float = 0.0
    passes: float = 1.0
    calibration_y_cm: float = 0.0
    fit: FitParams = FitParams()

    def __post_init__(self) -> None:
        for name, bound in LAYOUT.items():
            object.__setattr__(self, name, bound(name, getattr(self, name)))
        broken = [text for text, holds in CONDITIONS.items() if not holds(self)]
        if broken:
            raise ValueError(f"scan settings do not fit together: {'; '.join(broken)}")

    @classmethod
    def timed(cls, *, dt_s: float, times_s: dict[str, float], **settings: Any) -> ScanParams:
        """Settings with some of the sample indices given as times from the start of a trace, in seconds.

        ``times_s`` maps names out of ``TIMED`` to times; each becomes the nearest sample, half a
        sample the later one.
        """
        unknown = sorted(set(times_s) - set(TIMED))
        both = sorted(set(times_s) & set(settings))
        if unknown or both:
            raise ValueError(f"not given as times: {', '.join(unknown)}" if unknown else f"given twice: {', '.join(both)}")
        return cls(dt_s=dt_s, **settings, **{name: nearest_sample(t, dt_s) for name, t in times_s.items()})

    @property
    def ramp_length(self) -> int:
        return self.sweep_end - self.sweep_start + 1

    @property
    def ramp_bounds(self) -> list[tuple[int, int]]:
        return [
            (
                self.sweep_start + r * self.ramp_spacing,
                self.sweep_start + r * self.ramp_spacing + self.ramp_length - 1,
            )
            for r in range(self.nramps)
        ]

    @property
    def positions(self) -> int:
        return self.nx * (self.ny if self.geometry == "xy_plane" else 1)

    @property
    def first_shot(self) -> int:
        return self.data_offset + 1

    @property
    def last_shot(self) -> int:
        """Last shot of the scan, inclusive."""
        return self.data_offset + self.positions * self.nshots


#: settings that are sample indices or numbers of samples
TIMED = ("sweep_start", "sweep_end", "ramp_spacing", "dc_start", "dc_end")


def nearest_sample(time_s: float, dt_s: float) -> int:
    """Sample nearest to a time, in decimal arithmetic: 0.5 samples written as decimals are a tie."""
    time, step = Decimal(str(time_s)), Decimal(str(dt_s))
    if not (time.is_finite() and step.is_finite()) or time < 0 or step <= 0:
        raise ValueError(f"no sample lies at {time_s} s with an interval of {dt_s} s")
    return int((time / step).to_integral_value(ROUND_HALF_UP))


LAYOUT = {
    **{name: Bound("whole", 1) for name in ("nx", "ny", "nshots", "nramps")},
    "nt_full": Bound("whole", 2), "dt_s": Bound("real", 0, open_low=True),
    "geometry": Bound("choice", choices=GEOMETRIES), "shot_mode": Bound("choice", choices=SHOT_MODES),
    "timing_source": Bound("choice", choices=TIMING_SOURCES), "y_order": Bound("choice", choices=Y_ORDERS),
}


def _baseline_holds(scan: ScanParams) -> bool:
    """The plasma-off samples exist and no ramp shares one of them."""
    if not scan.subtract_dc:
        return True
    if scan.dc_start is None or scan.dc_end is None:
        return False
    apart = all(scan.dc_end < first or last < scan.dc_start for first, last in scan.ramp_bounds)
    return 0 <= scan.dc_start <= scan.dc_end < scan.nt_full and apart


CONDITIONS: dict[str, Callable[[ScanParams], bool]] = {
    "the x axis must run upwards": lambda s: s.x_min_cm < s.x_max_cm,
    "the y axis must run upwards": lambda s: s.geometry == "x_line" or s.y_min_cm < s.y_max_cm,
    "a ramp needs two samples or more": lambda s: 0 <= s.sweep_start < s.sweep_end,
    "the last ramp must end inside the trace": lambda s: s.ramp_bounds[-1][1] < s.nt_full and s.sweep_end < s.nt_full,
    "ramps must not overlap": lambda s: s.nramps == 1 or s.ramp_length <= s.ramp_spacing,
    "the saturation window must lie inside a ramp": lambda s: 0 <= s.isat_start <= s.isat_end < s.ramp_length,
    "the time filter must fit into a ramp and exceed its order": lambda s: s.sg_order < s.sg_window <= s.ramp_length,
    "the baseline needs samples outside all ramps": _baseline_holds,
}
