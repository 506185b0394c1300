"""Default analysis parameters.

Fixed values: they must equal the published analysis configuration for results
to agree, so they are stated here together and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

US_PER_SEC = 1_000_000


@dataclass(frozen=True)
class FilterParams:
    notch_f0: float = 60.0
    notch_max: float = 780.0
    notch_q: float = 35.0
    band_low: float = 300.0
    band_high: float = 2500.0
    band_order: int = 4


@dataclass(frozen=True)
class SpikeParams:
    polarity: int = -1
    sd_factor: float = 5.0
    noise_window_us: int = 5 * US_PER_SEC
    refractory_us: int = 1_000


@dataclass(frozen=True)
class BurstParams:
    isi_max_us: int = 100_000
    isi_end_us: int = 200_000
    min_spikes: int = 5


@dataclass(frozen=True)
class ObservationParams:
    silent_mode: str = "baseline_min"
    min_rate_spike: float = 6.0
    min_rate_burst: float = 0.0
    outlier_mode: str = "none"
    iqr_factor: float = 3.0
    upper_percentile: float = 99.0
    mean_multiplier: float = 15.0
    pct_max_include: float | None = 1000.0
    exclude_silenced_pct: bool = False


@dataclass(frozen=True)
class ConnectivityParams:
    bin_us: int = 1_000
    max_lag_bins: int = 100
    norm: str = "pearson"
    density: float = 0.10
    density_sweep: tuple[float, ...] = (0.05, 0.10, 0.15, 0.20, 0.25)
    sttc_delta_us: int = 50_000
    null_n: int = 100
    null_seed: int = 1


@dataclass(frozen=True)
class StatsParams:
    n_bootstrap: int = 10_000
    bootstrap_seed: int = 1
    fdr_q: float = 0.05


@dataclass(frozen=True)
class Params:
    filter: FilterParams = field(default_factory=FilterParams)
    spike: SpikeParams = field(default_factory=SpikeParams)
    burst: BurstParams = field(default_factory=BurstParams)
    observation: ObservationParams = field(default_factory=ObservationParams)
    connectivity: ConnectivityParams = field(default_factory=ConnectivityParams)
    stats: StatsParams = field(default_factory=StatsParams)
    rate_unit_us: int = 60 * US_PER_SEC
    block_us: int = 60 * US_PER_SEC
    fs_default: float = 24414.0625
    reference_channel: int = 15
    ground_channels: tuple[int, ...] = (16, 32, 48, 64)
    schema_version: str = "2.0"


DEFAULTS = Params()


#: The names of network metrics in output tables.
METRIC_LABELS = {
    "density": "Edge density", "clustering_mean": "Clustering coeff.", "path_length": "Char. path length",
    "small_worldness": "Small-worldness sigma", "efficiency": "Global efficiency", "modularity": "Modularity Q"}
