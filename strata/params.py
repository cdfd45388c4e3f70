"""Fixed values of the survey rules, in one place.

Everything below is a fixed value: results only agree with recorded surveys when these match.
"""

from __future__ import annotations

# Physics
SPEED_OF_LIGHT_M_PER_NS = 0.2998
DIRECT_WAVE_WINDOW_NS = 3.07
DEFAULT_DIELECTRIC = 9.0
MIN_USABLE_DIELECTRIC = 2.0
PERMITTIVITY_IMPLAUSIBLE_ABOVE = 90.0
PERMITTIVITY_AIR_LIKE_BELOW = 2.5

# Fit credibility
RECORD_FLOOR_FRACTION = 0.90
MIN_CREDIBLE_INLIERS = 8
RIDGE_MARGIN_TRACES = 5
RIDGE_MIN_PEAK = 1.3
RANSAC_DRAWS = 2000
RANSAC_RESIDUAL_SAMPLES = 4.0
RANSAC_MIN_INLIERS = 6
RANSAC_MIN_FRACTION = 0.35
POINT_R2 = 0.85
LINEAR_MAX_R2 = 0.5
LINEAR_ASPECT = 2.0
DISTURBED_COHERENCE = 0.3
STRONG_PEAK = 4.0

# Envelope
ENVELOPE_BLUR = (3, 17)
ROW_BACKGROUND_FLOOR = 0.15

# Candidate boxes from energy
THRESHOLD_PERCENTILE = 0.82
SCALE_PERCENTILE = 0.995
CLOSE_KERNEL = (9, 5)
OPEN_KERNEL = (3, 3)
MIN_BOX_WIDTH, MIN_BOX_HEIGHT, MIN_BOX_AREA = 8, 5, 150
MAX_BOX_ASPECT, STREAK_WIDTH = 4.0, 15

# Migration picker
DEFAULT_PICKS = 15
PICK_APERTURE_M = 1.0
PEAK_OVER_MEDIAN = 3.0
SKIP_TOP_NS = 1.0
SKIP_BELOW_TIME_ZERO_NS = 0.5
SKIP_BOTTOM_FRACTION = 0.1
PEAK_WINDOW_NS, PEAK_WINDOW_M = 2.0, 0.4
SHADOW_REACH_M, SHADOW_RATIO = 0.5, 0.3
NEAR_SURFACE_NS = 1.5
TIME_ZERO_SPREAD_NS = 1.0
BOX_ABOVE_NS, BOX_BELOW_NS = 1.0, 3.0
MIN_HALF_WIDTH_M, MAX_HALF_WIDTH_M = 0.2, 1.5
MIN_APERTURE_M = 0.15

# Fusion and corroboration
FUSE_POSITION_M, FUSE_TIME_NS = 0.3, 1.5
CLUSTER_POSITION_M, CLUSTER_DEPTH_M = 0.30, 0.35
RUN_RESIDUAL_M = CLUSTER_DEPTH_M / 3
MAX_PERMITTIVITY_RATIO = 2.0

# Semblance and focusing
SEMBLANCE_RANGE, SEMBLANCE_STEPS = (4.0, 30.0), 41
SEMBLANCE_HALF_WIDTH, SEMBLANCE_WINDOW, SEMBLANCE_MIN_TRACES = 30, 3, 10
FLAT_EDGE, MIN_PROMINENCE, MIN_ARCHES = 4, 0.02, 3
WET_SOIL_DIELECTRIC = 11.0
SWEEP_RANGE, SWEEP_STEPS, FLAT_PEAK_RATIO = (0.03, 0.15), 49, 3.0

# Class refinement
ROW_MIN_POINTS, ROW_SPACING_CV, ROW_DEPTH_FRACTION, CROWD_FRACTION = 3, 0.25, 0.10, 0.15
COHERENT_ECHO_FRACTION, MAIN_LOBE_FRACTION = 0.25, 0.5
POLARITY_HALF_TRACES, POLARITY_WINDOW_NS, MIN_POLARITY_NS = 3, (1.0, 1.5), 2.5

# Site map
PICK_POSITION_ERROR_M, DEPTH_RELATIVE_ERROR, FITTED_RELATIVE_ERROR, DEPTH_FLOOR_ERROR_M = 0.05, 0.15, 0.05, 0.04
RUN_MAX_GAP_M, RUN_DEPTH_STEP_M, RUN_DEPTH_RANGE_M, RUN_MIN_LINES = 1.5, 0.2, 0.4, 3
RUN_STRAIGHTNESS_M, RUN_MIN_CROSSING_DEG = 0.3, 30.0
FAMILY_ANGLE_DEG, LINE_EDGE_M, MIN_FIXES = 30.0, 0.3, 5
TRACK_STEP_M = 1.0  # about, between the points of a line's track
CHANCE_DRAWS, CHANCE_P_MAX = 30, 0.05
CHANCE_VERDICTS = ("runs beat chance on this site", "unconfirmed: runs here are no more common than chance")
TARGETS_PER_LINE, ARCHES_PER_LINE = 10, 8
M_PER_DEG_LAT, M_PER_DEG_LON_EQUATOR = 110_574.0, 111_320.0
WGS84_A, WGS84_E2, WGS84_F = 6_378_137.0, 0.00669437999014, 1 / 298.257223563

# Risk
RISK_WEIGHTS = {
    "elongated_linear_target": 1.0,
    "cavities": 0.9,
    "clear_point_reflector": 0.7,
    "intersecting_linear_and_point_reflector": 0.9,
    "multiple_point_reflectors": 0.6,
    "cluttered_multi_target": 0.5,
    "low_snr_point_reflector": 0.4,
    "disturbed_zone": 0.3,
}
RISK_DEFAULT_WEIGHT, RISK_LOW_MAX, RISK_MEDIUM_MAX = 0.2, 0.35, 0.65
UTILITY_CLASSES = ("elongated_linear_target", "intersecting_linear_and_point_reflector")
ELONGATED_CONFIDENCE, ELONGATED_MIN_COUNT = 0.8, 2

# Drawings
UTILITIES = ("ELECTRIC", "WATER", "SEWER", "DRAIN", "UC", "OFC", "METALLIC", "GAS", "TELECOM")
DRAWING_DEPTH_ERROR = 0.30
SHEET_LENGTH_M = 60.0

# Streaming
CHUNK_TRACES, SETTLE_TRACES, PERSIST_WINDOWS, WARMUP_TRACES = 16, 48, 4, 64
LOCKOUT_WINDOW_MINUTES, LOCKOUT_PAIR, LOCKOUT_NAME, LOCKOUT_IP = 15, 5, 50, 20

# Held-out evaluation sites
TEST_SITES = ("Set3", "Set4", "Set5")
RUN_TRIALS = 200  # trial lines through a cluster
