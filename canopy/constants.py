"""Fixed values that must equal the original application's for right results.

Everything in this module is a constant of the greenhouse domain; the
queries take them as defaults and accept overrides.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original application)
# ---------------------------------------------------------------------------

# Control loop targets and decision limits.
TARGET_PH = 6.0
TARGET_EC = 1.4
EC_EMERGENCY_MARGIN = 0.3          # emergency when ec > TARGET_EC + margin
PH_EMERGENCY_LOW = 4.5             # emergency when ph < low
PH_EMERGENCY_HIGH = 8.0            # emergency when ph > high
EC_DOSE_DEADBAND = 0.05            # dose nutrients when TARGET_EC - ec > deadband
PH_DOSE_DEADBAND = 0.15            # dose pH when |ph - TARGET_PH| > deadband
BASE_PULSE_MS = 1000               # every dose lasts this long
MIXING_DELAY_REAL_SEC = 60.0       # divided by the simulation speed
LOOKBACK_REAL_SEC = 120.0          # divided by the simulation speed, floor 10 s
LOOKBACK_FLOOR_SEC = 10.0
CONTROL_PERIOD_REAL_SEC = 60.0     # divided by the simulation speed, floor 1 s

# Decision outcomes, in evaluation order.
STATUS_WAITING = "WAITING"
STATUS_NO_DATA = "NO_DATA"
STATUS_EMERGENCY = "EMERGENCY_STOP"
STATUS_NUTRI_A = "DOSE_NUTRI_A"
STATUS_NUTRI_B = "DOSE_NUTRI_B"
STATUS_PH_MINUS = "DOSE_PH_MINUS"
STATUS_PH_PLUS = "DOSE_PH_PLUS"
STATUS_STABLE = "STABLE"

# Pumps and the decision that drives each one.
PUMP_PH_MINUS = "pump_ph_minus"
PUMP_PH_PLUS = "pump_ph_plus"
PUMP_NUTRI_1 = "pump_nutri_1"
PUMP_NUTRI_2 = "pump_nutri_2"
PUMP_NUTRI_3 = "pump_nutri_3"
PUMPS = [PUMP_PH_MINUS, PUMP_PH_PLUS, PUMP_NUTRI_1, PUMP_NUTRI_2, PUMP_NUTRI_3]
# Dashboard names of the same pumps (nutri a/b/c are nutri 1/2/3).
PUMP_ALIASES = {
    "pump_nutri_a": PUMP_NUTRI_1,
    "pump_nutri_b": PUMP_NUTRI_2,
    "pump_nutri_c": PUMP_NUTRI_3,
}
STATUS_TO_PUMP = {
    STATUS_NUTRI_A: PUMP_NUTRI_1,
    STATUS_NUTRI_B: PUMP_NUTRI_2,
    STATUS_PH_MINUS: PUMP_PH_MINUS,
    STATUS_PH_PLUS: PUMP_PH_PLUS,
}

# Dashboard gauge limits: metric -> (target, min_ok, max_ok, min, max).
METRIC_LIMITS = {
    "ph": (6.0, 5.5, 6.5, 4.0, 8.0),
    "ec": (1.4, 1.2, 1.6, 0.0, 3.0),
    "water_temp": (20.0, 18.0, 24.0, 10.0, 35.0),
    "air_temp": (24.0, 20.0, 28.0, 10.0, 40.0),
}

# Live-status fallbacks used when a value is missing, 0 or NaN.
LIVE_DEFAULTS = {"ph": 0.0, "ec": 0.0, "water_temp": 0.0, "air_temp": 23.4, "humidity": 58.0}

# Dashboard colour steps (lower bound -> colour), ascending.
PH_BANDS = [(0.0, "text"), (4.0, "red"), (5.0, "#EAB839"), (5.5, "green"), (6.0, "green"),
            (6.5, "yellow"), (7.0, "red"), (8.0, "red")]
EC_BANDS = [(0.0, "green"), (80.0, "red")]

# Activity matrix cell classes: 0, <3, <6, else.
ACTIVITY_BUCKETS = [(0, "empty"), (3, "low"), (6, "mid")]
ACTIVITY_TOP = "high"

# Hourly halo colours: metric -> (above max_ok, below min_ok).
HALO_COLOURS = {"ph": ("red", "blue"), "ec": ("orange", "purple")}

# Simulated pump physics: impact per second of pumping and nutrient factor on EC.
DOSE_IMPACT_PER_SEC = 0.15
NUTRIENT_EC_FACTOR = 0.4

# Light model: base + grow light when ON + sun through the louvers.
LUX_BASE = 400.0
LUX_GROW_LIGHT = 15000.0
LUX_SUN_FULL = 30000.0

# Ingest defaults and column limits.
DEFAULT_SENSOR_NAME = "unknown"
DEFAULT_CAMERA_ID = "esp32_cam_inconnu"
TRIGGER_SOURCE = "auto_backend"
VARCHAR_LIMITS = {"device_id": 50, "metric": 50, "sensor_name": 50, "actuator_id": 50,
                  "action": 20, "trigger_source": 50, "image_path": 255, "level": 20,
                  "category": 50}

# Time chunking of the original hypertables (7-day chunks, epoch aligned).
CHUNK_DAYS = 7

# Laplacian stencil of the blur score (3x3, border reflect-101).
LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]

# MQTT-style topic layout of commands: <prefix>/<node>/commands, where the node
# id is the second '_'-separated part of the device id (whole id otherwise).
TOPIC_PREFIX = "site"
COMMAND_ACTION = "PULSE"
