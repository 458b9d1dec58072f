"""Fixed values the results depend on."""

from __future__ import annotations

# Feature names in index order.
FEATURES = (
    "variance", "skewness", "kurtosis", "entropy", "iqr",
    "spatial_variance", "spatial_correlation", "spatial_gradient",
    "temporal_delta_mean", "temporal_delta_variance",
)

# Doppler feature names in index order.
DOPPLER_FEATURES = ("doppler_spread", "rms_doppler_spread", "peak_doppler", "spectral_centroid")

# Default score weights and normalisation ranges, in feature order.
DEFAULT_WEIGHTS = (0.128, 0.111, 0.166, 0.0, 0.182, 0.0, 0.0, 0.171, 0.241, 0.0)
DEFAULT_RANGES = (
    (0.0, 800.0), (-2.5, 1.5), (-3.0, 6.0), (4.0, 7.0), (0.0, 50.0),
    (0.0, 400.0), (-1.0, 1.0), (0.0, 40.0), (0.0, 20.0), (0.0, 150.0),
)

EPS = 1e-6

# Packet geometry.
MIN_PACKET_VALUES = 10
SUBCARRIER_RANGE = (47, 59)
ANALYSIS_BAND = (12, 116)
CAPTURE_VALUES = 128

# Window lengths.
MOMENT_ROWS = 20
HAMPEL_ROWS = 5
WAVELET_ROWS = 32
STATS_ROWS = 100
DOPPLER_ROWS = 64
DOPPLER_HOP = 32
DOPPLER_RATE = 50.0

# Filter coefficients.
MAD_SCALE = 1.4826
SAVGOL = (-0.0857, 0.3429, 0.4857, 0.3429, -0.0857)
LOWPASS_B = (0.00482434, 0.01929736, 0.02894604, 0.01929736, 0.00482434)
LOWPASS_A = (1.0, -2.36951301, 2.31398841, -1.05466541, 0.18737949)

# db4 taps, analysis low and high pass, then synthesis low and high pass.
DB4_LOW = (
    -0.010597401785, 0.032883011667, 0.030841381836, -0.187034811719,
    -0.027983769417, 0.630880767930, 0.714846570553, 0.230377813309,
)
DB4_HIGH = (
    -0.230377813309, 0.714846570553, -0.630880767930, -0.027983769417,
    0.187034811719, 0.030841381836, -0.032883011667, -0.010597401785,
)
DB4_SYN_LOW = (
    0.230377813309, 0.714846570553, 0.630880767930, -0.027983769417,
    -0.187034811719, 0.030841381836, 0.032883011667, -0.010597401785,
)
DB4_SYN_HIGH = (
    -0.010597401785, -0.032883011667, 0.030841381836, 0.187034811719,
    -0.027983769417, -0.630880767930, 0.714846570553, -0.230377813309,
)

# Calibration rules.
MIN_CALIBRATION_ROWS = 50
CALIBRATION_SAMPLES = (50, 10000)
MIN_SELECTED, MAX_SELECTED = 4, 6
FISHER_MIN_RATIO = 0.2
SAFETY_MARGIN = 1.05
THRESHOLD_MIN, THRESHOLD_MAX = 0.15, 0.80

# Publish gate.
PUBLISH_DELTA = 0.05
PUBLISH_HEARTBEAT_MS = 5000

# Parameter grid of the segmentation study.
GRID_K = (1.5, 2.0, 2.5, 3.0, 3.5)
GRID_WINDOW = (10, 15, 20, 25, 30)
GRID_MIN = (5, 10, 15, 20)
GRID_MAX = (40, 60, 80)

# Control commands as (name, kind, lowest, highest).
COMMANDS = (
    ("threshold", "float", 0.15, 0.80),
    ("stats", "report", None, None),
    ("info", "report", None, None),
    ("logs", "bool", None, None),
    ("analyze", "report", None, None),
    ("persistence", "int", 1.0, 30.0),
    ("debounce", "int", 1.0, 10.0),
    ("hysteresis", "float", 0.1, 1.0),
    ("features", "report", None, None),
    ("hampel_filter", "bool", None, None),
    ("hampel_threshold", "float", 1.0, 10.0),
    ("savgol_filter", "bool", None, None),
    ("butterworth_filter", "bool", None, None),
    ("wavelet_filter", "bool", None, None),
    ("wavelet_level", "int", 1.0, 3.0),
    ("wavelet_threshold", "float", 0.5, 2.0),
    ("smart_publishing", "bool", None, None),
    ("calibrate", "action", None, None),
    ("adaptive_normalizer", "bool", None, None),
    ("adaptive_normalizer_alpha", "float", 0.001, 0.1),
    ("adaptive_normalizer_reset_timeout", "int", 0.0, 300.0),
    ("adaptive_normalizer_stats", "report", None, None),
    ("traffic_generator_rate", "int", 0.0, 50.0),
    ("factory_reset", "reset", None, None),
)

# Command -> (config column, default).
CONFIG_DEFAULTS = {
    "threshold": ("threshold", 0.5),
    "persistence": ("persistence_timeout", 3.0),
    "debounce": ("debounce_count", 10.0),
    "hysteresis": ("hysteresis_ratio", 0.7),
    "logs": ("csi_logs_enabled", 1.0),
    "hampel_filter": ("hampel_enabled", 0.0),
    "hampel_threshold": ("hampel_threshold", 2.0),
    "savgol_filter": ("savgol_enabled", 1.0),
    "butterworth_filter": ("butterworth_enabled", 1.0),
    "wavelet_filter": ("wavelet_enabled", 0.0),
    "wavelet_level": ("wavelet_level", 3.0),
    "wavelet_threshold": ("wavelet_threshold", 1.0),
    "smart_publishing": ("smart_publishing_enabled", 0.0),
    "adaptive_normalizer": ("normalizer_enabled", 1.0),
    "adaptive_normalizer_alpha": ("normalizer_alpha", 0.02),
    "adaptive_normalizer_reset_timeout": ("normalizer_reset_timeout", 60.0),
    "traffic_generator_rate": ("packet_rate", 20.0),
}
