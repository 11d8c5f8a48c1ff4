"""Settings of the engine. Numbers that fix the method are stated here, once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Features that a segmentation may use.
FEATURES = ("slope", "width", "channels", "sinuosity", "curvature")
GEOMETRY_FEATURES = ("sinuosity", "curvature")


@dataclass(frozen=True)
class FeatureConfig:
    curvature_summary: str = "rms"
    width_summary: str = "median"
    channels_summary: str = "mean"
    binary_channels: bool = True
    channel_threshold: float = 1.0
    abs_curvature: bool = True
    log_width: bool = True
    slope_min_fraction: float = 0.8
    slope_min_points: int = 10
    slope_max_gap: int = 5
    min_points: int = 5
    geometry_step_m: float = 10.0
    curvature_smooth_points: int = 9
    node_half_window_m: float = 100.0


@dataclass(frozen=True)
class WindowConfig:
    """How window sizes follow from a path: "fixed", "raw" or "width" (log-spaced between width quantiles)."""

    method: str = "width"
    windows_m: tuple[float, ...] = (5000.0, 10000.0, 20000.0)
    n_windows: int = 5
    low_quantile: float = 0.10
    high_quantile: float = 0.90
    low_multiple: float = 36.0
    high_multiple: float = 36.0
    #: Sizes in metres that take the place of the width multiples.
    least_m: float | None = None
    most_m: float | None = None
    max_fraction: float | None = 0.15
    min_points: int = 5
    round_to_spacing: bool = True


@dataclass(frozen=True)
class SelectionConfig:
    min_support_runs: float = 0.20
    min_windows: int = 1
    min_support_windows: float = 0.0
    min_frequency: float | None = None
    min_spacing_m: float = 10_000.0
    min_reach_m: float | None = None
    max_breaks: int = 30
    stop_relative: float = 0.01
    stop_absolute: float = 0.0
    #: Where candidates come from: "support" (its clusters) or "all_runs" (breaks of the runs, or the
    #: medians of their chain clusters under candidate_tolerance_m).
    source: str = "support"
    candidate_tolerance_m: float | None = None
    #: Weights of windows by label in the squared error; those not named weigh 1.
    window_weights: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class ConsensusConfig:
    merge_threshold_m: float = 11_500.0
    stable_fraction: float = 0.75
    stable_count: int | None = None


@dataclass(frozen=True)
class CalibrationConfig:
    dominant_min: float = 0.15
    satellite_max: float = 0.05
    supported_min: float = 0.10
    min_pairs: int = 2
    round_km: float = 0.5
    upper_limits_km: tuple[float, ...] = (15, 20, 25, 30, 35, 40, 50, 60, 80, 100, 120)
    families: tuple[str, ...] = ("w2", "w3", "w4", "w5")
    min_consecutive: int = 3
    tolerance_km: float = 0.0
    min_families: int = 3


@dataclass(frozen=True)
class TuningConfig:
    mean_ch_gap: float = 0.10
    reach_tie: float = 0.02
    win_share: float = 0.75
    thresholds: tuple[float, ...] = (0.50, 0.625, 0.75, 0.875)
    match_tolerance_m: float = 5_000.0
    min_keep: int = 4
    core_min: float = 0.75
    medium_min: float = 0.50


@dataclass(frozen=True)
class GeometryConfig:
    step_m: float = 10.0
    smoothing: str = "piecewise"
    fixed_sigma_m: float = 50.0
    sigma_width_fraction: float = 0.25
    sigma_min_m: float = 20.0
    sigma_max_m: float = 150.0
    width_tolerance: float = 0.20
    width_statistic: str = "median"
    blend_m: float | None = None
    min_sinuosity_m: float = 0.0
    min_curvature_m: float = 100.0
    min_samples: int = 10
    fill_edges: bool = True


#: Penalties of a sweep, and the tolerance in which breaks of its runs are one.
PENALTIES = (2.5, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0)
STABILITY_TOLERANCE_M = 1_000.0
#: Breaks are sought on every JUMP-th point.
JUMP = 5


@dataclass(frozen=True)
class Family:
    """A window family: its number of windows and the least numbers of windows its grid asks for."""

    name: str
    n_windows: int
    min_windows: tuple[int, ...]
    raw: bool = False


#: The window families.
FAMILIES = (
    Family("raw", 1, (1,), raw=True),
    Family("w2", 2, (1,)),
    Family("w3", 3, (1, 2)),
    Family("w4", 4, (1, 2, 3)),
    Family("w5", 5, (1, 2, 3)),
)
SUPPORTS = (0.05, 0.10, 0.15, 0.20, 0.25)
STOPS = (0.04, 0.045, 0.05, 0.06)


@dataclass(frozen=True)
class Setting:
    """One selector setting."""

    min_support_runs: float
    min_windows: int
    stop_relative: float

    @property
    def label(self) -> str:
        return setting_label(self.min_windows, self.min_support_runs, self.stop_relative)


#: The settings that a final run keeps.
FINAL_SETTINGS = (
    Setting(0.10, 1, 0.050),
    Setting(0.05, 1, 0.050),
    Setting(0.15, 1, 0.050),
    Setting(0.10, 1, 0.045),
    Setting(0.10, 1, 0.060),
)


@dataclass(frozen=True)
class Stage:
    """What one stage of a setup segments, and with which families."""

    name: str
    features: tuple[str, ...]
    families: tuple[str, ...]


@dataclass(frozen=True)
class Setup:
    name: str
    stages: tuple[Stage, ...]


_WIDTH = Stage("width_channels", ("width", "channels"), ("raw", "w2", "w3", "w4", "w5"))
_GEOMETRY = Stage("sinuosity_curvature", ("sinuosity", "curvature"), ("w2", "w3", "w4", "w5"))
_ALL = Stage("all_features", ("width", "channels", "sinuosity", "curvature"), ("w2", "w3", "w4", "w5"))

#: The five setups; the last two segment the segments of their first stage again.
SETUPS = (
    Setup("01_width_channels", (_WIDTH,)),
    Setup("02_sinuosity_curvature", (_GEOMETRY,)),
    Setup("03_all_features", (_ALL,)),
    Setup("04_width_channels_then_geometry", (_WIDTH, _GEOMETRY)),
    Setup("05_geometry_then_width_channels", (_GEOMETRY, _WIDTH)),
)


@dataclass(frozen=True)
class PipelineConfig:
    features: tuple[str, ...] = ("width", "channels")
    feature: FeatureConfig = field(default_factory=FeatureConfig)
    window: WindowConfig = field(default_factory=WindowConfig)
    selection: SelectionConfig = field(default_factory=SelectionConfig)
    consensus: ConsensusConfig = field(default_factory=ConsensusConfig)
    geometry: GeometryConfig = field(default_factory=GeometryConfig)
    penalties: tuple[float, ...] = PENALTIES
    families: tuple[Family, ...] = FAMILIES
    jump: int = JUMP
    min_size: int | None = None
    stability_tolerance_m: float = STABILITY_TOLERANCE_M
    standardize: bool = True

    def with_(self, **changes) -> PipelineConfig:
        return replace(self, **changes)


def check_features(names: tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """Legal feature names, each once, in the order given."""
    unknown = [n for n in names if n not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features: {unknown}; known are {list(FEATURES)}")
    if not names:
        raise ValueError("at least one feature is needed")
    return unique(names)


def unique(values) -> tuple:
    """Values, each once, in order of first sight."""
    return tuple(dict.fromkeys(values))


def needs_geometry(features) -> bool:
    return any(f in GEOMETRY_FEATURES for f in features)


def needs_heights(features) -> bool:
    return "slope" in features


def check_stage(stage: Stage) -> Stage:
    """A raw window has no geometry features."""
    check_features(stage.features)
    if needs_geometry(stage.features) and "raw" in stage.families:
        raise ValueError(f"stage {stage.name}: geometry features need windows, so the raw family cannot be used")
    return stage


def target_families(families) -> tuple[str, ...]:
    """Families that calibration looks at: all but raw, in their fixed order."""
    return tuple(f.name for f in FAMILIES if f.name in set(families) and not f.raw)


def select_families(names=None) -> tuple[Family, ...]:
    """Families by name, in their fixed order; all if none are named."""
    if names is None:
        return FAMILIES
    unknown = set(names) - {f.name for f in FAMILIES}
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    return tuple(f for f in FAMILIES if f.name in set(names))


def window_label(window_m: float | None) -> str:
    """Wraw for the raw window, else its size in km."""
    return "Wraw" if window_m is None else f"W{window_m / 1000:g}km"


def _short(x: float) -> str:
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return text.replace(".", "p")


def setting_label(min_windows: int, min_support: float, stop: float) -> str:
    return f"mw{min_windows}_runs{_short(min_support)}_stop{_short(stop)}"


def parse_setting_label(label: str) -> Setting:
    parts = {p[: len(k)]: p[len(k) :] for p in label.split("_") for k in ("mw", "runs", "stop") if p.startswith(k)}
    number = lambda s: float(s.replace("p", "."))
    return Setting(number(parts["runs"]), int(parts["mw"]), number(parts["stop"]))


def selector_grid(family: Family, supports=SUPPORTS, stops=STOPS) -> tuple[Setting, ...]:
    """The grid of a family, ordered by least windows, support and stop."""
    return tuple(Setting(s, w, t) for w in family.min_windows for s in supports for t in stops)


def final_stable_count(n_settings: int) -> int:
    """How many settings must agree on a break of the final run: all but one, two at least, or the only one."""
    return 1 if n_settings <= 1 else max(2, n_settings - 1)


def stage_folder(setup: str, stage: str) -> str:
    return f"{setup}/{stage}"
