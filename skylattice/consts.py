"""Fixed values of the domain: physical constants, thresholds and code tables."""

# Physics and geodesy.
C_M_PER_NS = 0.299702547
FEET_TO_METERS = 0.3048
WGS84_A = 6378137.0
WGS84_E2 = 6.69437999014e-3
METERS_PER_DEGREE = 111320.0
CRUISE_RADIUS_M = 6381000.0

# Timing, in nanoseconds.
CORRELATION_WINDOW_NS = 200_000_000
TDOA_GUARD_NS = 1000.0
PAIR_VALIDITY_NS = 30_000_000_000
PAIR_EXPIRY_NS = 120_000_000_000
MAX_EXTRAPOLATION_NS = 120_000_000_000
CLASSIFY_INTERVAL_NS = 5_000_000_000
SOLVE_INTERVAL_NS = 1_000_000_000
CPR_PAIR_AGE_NS = 10_000_000_000
ENRICHMENT_TTL_S = 300

# Solvers.
MIN_BASELINE_M = 5000.0
MIN_SINGULAR = 1e-3
MAX_CONDITION = 1e8
PRESOLVE_GDOP = 20.0
MAX_RANGE_M = 500_000.0
MIN_DISTANCE_M = 1.0
MIN_SIGMA_M = 1.0
DEFAULT_PAIR_VARIANCE_NS2 = 90_000.0
MAX_PRIOR_TRACE = 25e6
INNOVATION_GATE = 15.0
WEAK_DIRECTION = 0.1
SDOP_LIMIT_M = 300.0
SEMI_CONDITION = 1e6
SEMI_INFLATION = 5.0
SEMI_EVALUATIONS = 50
ALT_MIN_M, ALT_MAX_M, ALT_FALLBACK_M = -500.0, 15000.0, 5000.0
ALT_ERROR_BASE_M, ALT_ERROR_RATE, ALT_ERROR_MAX_M = 76.2, 21.3, 926.0

# Kalman filter.
POS_VARIANCE, VEL_VARIANCE = 1e6, 4e4
PROCESS_NOISE = 0.5
MEASUREMENT_FLOOR = 1e4
MAHALANOBIS_SQ = 225.0
OUTLIERS_TO_RESET = 3
MAX_SPEED = 583.0
MAX_CLIMB = 50.0
HISTORY = 20
BEGUN_SPEED_SIGMA = 50.0

# Clocks.
MAD_TO_SIGMA = 0.6745
MAD_FLOOR_NS = 50.0
OUTLIER_MADS = 2.0
IRLS_ROUNDS = 5
IRLS_CLOSE = 0.05
UNSTABLE_NS = 500.0
MARGINAL_ENTER_NS, MARGINAL_EXIT_NS, UNSTABLE_EXIT_NS = 350.0, 200.0, 400.0
MIN_EDGES = 2
DISCONNECTED_AFTER = 3
BEACON_NUC = 6
WARM_UP_GATE_NS = 1000.0
DEFAULT_SIGMA_NS = 300.0
UNKNOWN_SIGMA_NS = 500.0
SOLVE_EVERY_NS = 5_000_000_000
DEGRADED_ADEV_NS = 1000.0
BUFFER_CAPACITY = 30_000
PAIR_SAMPLES = 50
DRIFT_WINDOW_NS = 60_000_000_000
ALLAN_TAUS_S = (1.0, 5.0, 10.0, 30.0, 60.0)

# Coverage grid.
GDOP_CLASSES = (("excellent", 2.0), ("good", 5.0), ("moderate", 10.0), ("poor", 20.0))
GRID_STEP_DEG = 0.1
PAD_LAT_DEG, PAD_LON_DEG = 2.7, 3.5
LAT_LIMIT, LON_LIMIT = 85.0, 180.0
DEFAULT_BOUNDS = (45.0, 55.0, -5.0, 5.0)
HEATMAP_ALT_M = 9144.0
PLANNING_ALTITUDES = (1524.0, 3048.0, 9144.0)
GRID_MIN_SINGULAR = 1e-6

# Messages.
CRC24_POLY = 0xFFF409
NUC_BY_TYPE = {9: 9, 20: 9, 10: 8, 21: 8, 11: 7, 22: 7, 12: 6, 13: 5, 14: 4, 15: 3, 16: 2, 17: 1}
NUC_WEIGHT = {5: 0.5, 6: 1.0, 7: 2.0, 8: 4.0, 9: 4.0}
NUC_SIGMA_M = {9: 50.0, 8: 100.0, 7: 300.0, 6: 500.0, 5: 800.0}
SPOOF_M = 2000.0

# Planning with virtual sensors.
MAX_VIRTUAL = 20
VIRTUAL_ID_START = 1_000_000
VIRTUAL_ALT_MAX_M = 15240.0

# Trajectory labels.
SEQ_LEN, N_FEATURES = 20, 8
CLASSIFY_STATES = 5
STD_EPSILON = 1e-8
