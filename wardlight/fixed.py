"""Lists, tables, weights and texts that results depend on."""

from __future__ import annotations

# --- Fixed values: keyword rules (tier, pattern), tested on lower-cased text ---
KEYWORD_RULES: tuple[tuple[int, str], ...] = (
    (3, r"\bpassword\b|\bpasswd\b|\bcredential\b|\bpassphrase\b|\bprivate.?key\b"),
    (3, r"\bapi.?key\b|\bsecret.?key\b|\bauth.?token\b|\baccess.?token\b"),
    (3, r"\bssn\b|\bsocial.?security\b|\bpassport\b|\btax.?id\b"),
    (3, r"\brouting.?number\b|\baccount.?number\b|\bcredit.?card\b|\bcvv\b"),
    (3, r"\bmedical.?record\b|\bpatient.?data\b|\bdiagnosis\b|\bprescription\b"),
    (2, r"\bsalary\b|\bpayroll\b|\bcompensation\b|\bbonus\b|\bstipend\b"),
    (2, r"\bbudget\b|\bforecast\b|\brevenue\b|\bearnings\b|\bquarterly.?result\b"),
    (2, r"\bmerger\b|\bacquisition\b|\btakeover\b|\bipo\b|\bstrateg\w+\b"),
    (2, r"\blayoff\b|\brestructur\w+\b|\bdownsiz\w+\b|\btermination\b"),
    (2, r"\bconfidential\b|\bproprietary\b|\btrade.?secret\b|\bembargo\b"),
    (2, r"\blitigation\b|\blawsuit\b|\bsettlement\b|\battorney.?client\b"),
    (2, r"\bcontract\b|\bnda\b|\bnon.?disclosure\b|\bintellectual.?property\b"),
    (1, r"\binternal.?use\b|\bdraft\b|\bmeeting.?notes\b|\bagenda\b"),
    (1, r"\bproject.?plan\b|\baction.?item\b|\bconfidential\b"),
)

# --- Fixed values: file extension -> tier ---
EXTENSION_TIERS: dict[str, int] = {
    ".exe": 3, ".dll": 3, ".bat": 3, ".cmd": 3, ".ps1": 3,
    ".sh": 3, ".vbs": 3, ".js": 2, ".py": 2,
    ".zip": 2, ".tar": 2, ".gz": 2, ".7z": 2, ".rar": 2, ".bz2": 2,
    ".doc": 2, ".docx": 2, ".xls": 2, ".xlsx": 2,
    ".ppt": 2, ".pptx": 2, ".pdf": 2, ".csv": 2,
    ".txt": 1, ".log": 1, ".xml": 1, ".json": 1, ".sql": 2,
    ".jpg": 0, ".jpeg": 0, ".png": 0, ".gif": 0, ".bmp": 0,
}
EXTENSION_PATTERN = r"(\.[a-z0-9]{1,6})$"
EXTENSION_DEFAULT = 1

# --- Fixed values: hex signatures at the start of file content -> tier ---
SIGNATURE_TIERS: dict[str, int] = {
    "4D-5A": 3,
    "D0-CF-11-E0": 2,
    "25-50-44-46": 2,
    "50-4B-03-04": 2,
    "52-61-72-21": 2,
    "37-7A-BC-AF": 2,
}

# --- Fixed values: tier -> label ---
TIER_LABELS: tuple[str, ...] = ("PUBLIC", "INTERNAL", "SENSITIVE", "RESTRICTED")

# --- Fixed values: feature columns of a user-day row ---
EMAIL_FEATURES: tuple[str, ...] = (
    "email_count", "unique_pcs", "total_size", "avg_size",
    "total_attachments", "emails_with_attachments", "after_hours_emails",
    "avg_recipients", "max_recipients", "avg_content_words", "max_content_words",
    "bcc_email_count", "cc_email_count",
    "attachment_email_ratio", "after_hours_ratio", "bcc_ratio",
)
LOGON_FEATURES: tuple[str, ...] = (
    "logon_count", "logoff_count", "after_hours_logons", "unique_logon_pcs",
)
DEVICE_FEATURES: tuple[str, ...] = ("usb_connect_count", "usb_disconnect_count")
FILE_FEATURES: tuple[str, ...] = (
    "file_total", "file_to_removable", "file_from_removable",
    "file_write_count", "file_after_hours",
)
BEHAVIOR_FEATURES = EMAIL_FEATURES + LOGON_FEATURES + DEVICE_FEATURES + FILE_FEATURES
TRAITS: tuple[str, ...] = ("o", "c", "e", "a", "n")
FOREST_FEATURES = BEHAVIOR_FEATURES + TRAITS

# --- Fixed values: risk signals, weights, flag thresholds, flag texts ---
SIGNALS: tuple[str, ...] = (
    "lstm_p95", "after_hours", "bcc_usage", "file_exfil",
    "usb_activity", "multi_pc", "content_sensitivity",
)
WEIGHTS: dict[str, float] = {
    "lstm_p95": 0.45, "after_hours": 0.13, "bcc_usage": 0.09, "file_exfil": 0.09,
    "usb_activity": 0.09, "multi_pc": 0.05, "content_sensitivity": 0.10,
}
THRESHOLDS: dict[str, float] = {
    "lstm_p95": 0.70, "after_hours": 0.50, "bcc_usage": 0.50, "file_exfil": 0.50,
    "usb_activity": 0.50, "multi_pc": 0.50, "content_sensitivity": 0.50,
}
FLAG_TEXTS: dict[str, str] = {
    "lstm_p95": "High LSTM anomaly score -- unusual behavioural patterns over time",
    "after_hours": "Elevated after-hours email / login activity",
    "bcc_usage": "Abnormal BCC email usage (potential hidden recipients)",
    "file_exfil": "Files copied to removable media (possible data exfiltration)",
    "usb_activity": "Frequent USB device connections",
    "multi_pc": "Logging in from an unusual number of workstations",
    "content_sensitivity":
        "High DLP content sensitivity -- sensitive/restricted data in emails or files",
}
NO_FLAG_TEXT = "No strong individual behavioural indicators -- pattern is subtle."

# --- Fixed values: timestamp text, hours, windows, splits ---
TIMESTAMP_TEXT = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"
FIRST_HOUR, LAST_HOUR = 7, 20
WINDOW_ROWS = 7
TRAIN_FRACTION, VAL_FRACTION = 0.70, 0.15

# --- Fixed values: evaluation grid and weight search ---
GRID_PERCENTILES: tuple[int, ...] = (90, 95, 97)
GRID_KS: tuple[int, ...] = (10, 20, 50)
SWEEP_KS: tuple[int, ...] = (5, 10, 20, 30, 50, 75, 100)
OUTCOME_KS: tuple[int, ...] = (10, 20, 50, 100)
SEARCH = {
    "population": 60, "generations": 100, "tournament": 5, "crossover": 0.5,
    "sigma": 0.04, "mutation": 0.25, "elites": 4, "patience": 25,
    "alpha": 0.80, "beta": 0.20, "k": 50,
    "weight_low": 0.01, "weight_high": 1.0,
    "threshold_low": 0.10, "threshold_high": 0.95,
}
