"""Fixed values of the domain: names, thresholds, catalogs."""

from __future__ import annotations

SENSORS = ["volt", "rotate", "pressure", "vibration"]
ERRORS = ["error1", "error2", "error3", "error4", "error5"]
COMPONENTS = ["comp1", "comp2", "comp3", "comp4"]
SEQUENCE_ROWS = 24
RISK_HOURS = 48
MEMORY_SIZE = 64

# Feature names of the hybrid vector after the memory nodes.
STATE_FEATURES = [*ERRORS, "days_comp1", "days_comp2", "days_comp3", "days_comp4", "age"]

# Alert thresholds, percent.
TIER_CUTS = (80.0, 40.0, 15.0)
REPLAY_CUTS = (80.0, 50.0, 20.0)
DISPLAY_CUTS = (80.0, 40.0)
DANGER_AT = 85.0
WARNING_AT = 40.0
REASON_ABOVE = 80.0
TREND_ROWS = 3

# Settings of the model family serving each machine type.
EXPERTS = [
    {
        "machine_type": "Máy Hàn Robot Tự Động",
        "kind": "robot",
        "dynamic_cols": ["robot_vibration_g", "servo_motor_temp_c", "robot_torque_proxy_amp", "wire_feed_speed_mmin"],
        "static_cols": ["hours_since_maintenance"],
        "target_col": "target_failure_24h",
        "time_steps": 60,
        "lookahead": 2880,
        "batch_size": 128,
        "risk_threshold": 75.0,
    },
    {
        "machine_type": "Máy Cắt Laser Fiber",
        "kind": "laser",
        "dynamic_cols": [
            "lens_temperature_c",
            "laser_source_temp_c",
            "delta_temperature",
            "xy_axis_torque_nm",
            "z_axis_tracking_error_proxy",
        ],
        "static_cols": ["days_since_lens_inspect"],
        "target_col": "target_lens_failure",
        "time_steps": 30,
        "lookahead": 2880,
        "batch_size": 64,
        "risk_threshold": 80.0,
    },
    {
        "machine_type": "Máy Chấn Tôn CNC",
        "kind": "press_brake",
        "dynamic_cols": ["ps1_max", "ps1_slope", "eps1_max", "ts1_mean", "fs1_mean"],
        "static_cols": ["days_since_oil_filter"],
        "target_col": "target_valve_condition",
        "time_steps": 100,
        "lookahead": 2880,
        "batch_size": 64,
        "risk_threshold": 70.0,
    },
    {
        "machine_type": "Máy Đột Dập CNC",
        "kind": "punching",
        "dynamic_cols": ["CF_Feature_1", "CF_Feature_2", "Vib_Feature_1", "Vib_Feature_2"],
        "static_cols": ["tool_hits_count"],
        "target_col": "target_wear",
        "time_steps": 50,
        "lookahead": 1000,
        "batch_size": 64,
        "risk_threshold": 85.0,
    },
]

# Sampling step per machine kind, in minutes.
STEP_MINUTES = {"laser": 60, "punching": 15, "press_brake": 1, "robot": 15}

# Columns smoothed by the rolling deviation, per machine kind.
ROLLING_FEATURES = {
    "laser": ["lens_temperature_c", "laser_source_temp_c", "xy_axis_torque_nm"],
    "press_brake": ["ps1_mean", "ps2_mean", "ts1_mean", "fs1_mean"],
    "punching": ["CF_Feature_1", "CF_Feature_2", "Vib_Feature_1", "Vib_Feature_4"],
    "robot": ["robot_vibration_g", "servo_motor_temp_c", "robot_torque_proxy_amp"],
}

# Name parts that give away the label.
LEAKAGE_PARTS = ["days_since", "hours_since", "tool_hits_count", "z_axis_tracking_error_proxy"]

# Name parts of likely label columns.
TARGET_PARTS = ["failure", "wear", "valve", "leak", "target", "risk"]

# Sensors of the hydraulic rig and their sampling rate in Hz.
HYDRAULIC_SENSORS = {
    "PS1": 100, "PS2": 100, "PS3": 100, "PS4": 100, "PS5": 100, "PS6": 100, "EPS1": 100,
    "FS1": 10, "FS2": 10,
    "TS1": 1, "TS2": 1, "TS3": 1, "TS4": 1, "VS1": 1, "SE": 1, "CE": 1, "CP": 1,
}

# Component catalog, (machine kind, component code, name, lifespan in days).
COMPONENT_CATALOG = [
    ("robot", "COMP1", "Bộ cấp dây (Wire Feeder)", 90),
    ("robot", "COMP2", "Béc hàn (Torch Tip)", 15),
    ("robot", "COMP3", "Nguồn hàn", 730),
    ("robot", "COMP4", "Trục Servo Robot", 365),
    ("laser", "COMP1", "Thấu kính quang học", 30),
    ("laser", "COMP2", "Máy làm mát Chiller", 180),
    ("laser", "COMP3", "Nguồn phát Laser", 1460),
    ("laser", "COMP4", "Thanh răng - Bánh răng", 365),
    ("press_brake", "COMP1", "Hệ thống van Servo Thủy lực", 180),
    ("press_brake", "COMP2", "Cụm Bơm thủy lực", 730),
    ("press_brake", "COMP3", "Lọc dầu thủy lực", 90),
    ("press_brake", "COMP4", "Thước quang học", 365),
    ("punching", "COMP1", "Cụm chày/cối (Punch/Die)", 30),
    ("punching", "COMP2", "Mâm dao quay (Turret)", 180),
    ("punching", "COMP3", "Trục X/Y tịnh tiến", 365),
    ("punching", "COMP4", "Cụm đầu búa đột", 730),
]

# Reason texts shown to engineers.
REASON_OVERDUE = "Quá hạn ({} ngày)"
REASON_ERROR = "Lỗi {} (x{})"
REASON_SENSOR = "Dao động cảm biến bất thường"
REASON_AGE = "Tuổi thọ cao ({} năm)"
REASON_OTHER = "Đa thông số rủi ro"
