"""Fixed values of the log model, the rules and the public dataset layouts.

Everything here has to agree with published behaviour for results to be
right, so the values are stated plainly and kept in one place.
"""

# ---------------------------------------------------------------- log model
REQUIRED_FIELDS = [
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "bytes_sent", "bytes_recv", "duration", "event_type", "log_level", "message",
]
NUMERIC_FIELDS = ["bytes_sent", "bytes_recv", "duration"]
INTEGER_FIELDS = ["src_port", "dst_port"]

PROTOCOL_CODES = {"TCP": 0, "UDP": 1, "ICMP": 2, "HTTP": 3, "DNS": 4}
EVENT_TYPE_CODES = {
    "connection": 0, "authentication": 1, "file_access": 2, "dns_query": 3,
    "http_request": 4, "port_scan": 5, "brute_force": 6, "ddos": 7,
    "data_exfiltration": 8, "privilege_escalation": 9,
}
LOG_LEVEL_CODES = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4}
DEFAULT_PROTOCOL_CODE = 0
DEFAULT_EVENT_TYPE_CODE = 0
DEFAULT_LOG_LEVEL_CODE = 1

INTERNAL_PREFIXES = ["10.", "192.168.", "172.16."]

RISK_KEYWORDS = {
    "failed": 3, "denied": 3, "unauthorized": 5, "root": 4, "admin": 3,
    "sudo": 4, "password": 3, "exploit": 5, "malware": 5, "suspicious": 4,
    "blocked": 2, "timeout": 1, "flood": 4, "scan": 3, "exfiltration": 5,
    "escalation": 5, "brute": 4, "injection": 5, "overflow": 5, "payload": 4,
}
FEATURE_KEYWORD_CAP = 25
SCORE_KEYWORD_CAP = 15

ATTACK_TYPES = ["port_scan", "brute_force", "ddos", "data_exfiltration", "privilege_escalation"]

# ----------------------------------------------------------------- features
CORE_FEATURES = [
    "src_port", "dst_port", "bytes_sent", "bytes_recv", "duration",
    "protocol_code", "event_type_code", "log_level_code",
    "message_risk_score", "hour_of_day", "is_weekend",
]
FLOW_FEATURE_DEFAULTS = {
    "count": 1.0, "srv_count": 1.0, "serror_rate": 0.0, "same_srv_rate": 1.0,
    "dst_host_count": 1.0, "dst_host_srv_count": 1.0,
    "dst_host_same_srv_rate": 0.5, "dst_host_serror_rate": 0.0,
}
FLOW_FEATURES = list(FLOW_FEATURE_DEFAULTS)
TABLE_CORE_FEATURES = [
    "src_port", "dst_port", "log_bytes_sent", "log_bytes_recv", "norm_duration",
    "protocol_code", "event_type_code", "log_level_code", "message_risk_score",
    "hour_of_day", "is_weekend",
]
TABLE_FEATURES = TABLE_CORE_FEATURES + FLOW_FEATURES

# -------------------------------------------------------------------- model
FOREST_SAMPLE_SIZE = 256
FOREST_SEED = 42
LABELLED_TREES, LABELLED_CONTAMINATION = 200, 0.10
DEFAULT_TREES, DEFAULT_CONTAMINATION = 150, 0.15
EULER_GAMMA = 0.5772156649015329
CONFIDENCE_SCALE = 0.5

# ------------------------------------------------------------ context rules
MAINTENANCE_HOURS = (2, 5)
PEAK_HOURS = (9, 17)
PEAK_SCORE_FACTOR = 0.7
BACKUP_PREFIXES = ["10.0.100.", "172.16.200."]
BACKUP_MIN_BYTES = 50000
BACKUP_EXCLUDED_EVENTS = ["brute_force", "privilege_escalation"]
WHITELISTED_IPS = ["10.0.0.1", "10.0.0.2", "192.168.1.1"]
MAINTENANCE_CONFIDENCE = 0.5
WHITELIST_CONFIDENCE = 0.6
INTERNAL_CONFIDENCE = 0.4

REASON_NOT_ANOMALY = "Not an anomaly"
REASON_MAINTENANCE = "Low-confidence anomaly during maintenance window (2:00-5:00 UTC)"
REASON_BACKUP_BEFORE_IP = "Large transfer to backup subnet "
REASON_BACKUP_AFTER_IP = " – likely scheduled backup"
REASON_WHITELIST = "Low-confidence anomaly involving whitelisted IP"
REASON_INTERNAL = "Low-confidence anomaly in internal-only traffic"
REASON_CONFIRMED = "Anomaly confirmed after context evaluation"

# ------------------------------------------------------------ threat scoring
SUSPICIOUS_PORTS = [4444, 5555, 31337, 12345, 23, 445, 1433, 3389]
ATTACK_BONUS = {
    "data_exfiltration": 10, "privilege_escalation": 10, "ddos": 8,
    "brute_force": 7, "port_scan": 5,
}
CORRELATION_GAP_SECONDS = 300
PEAK_TOTAL_FACTOR = 0.85
CORRELATION_POINTS = {5: 15, 3: 10, 2: 5}  # events in a session, at least -> points
SEVERITY_RANGES = {"LOW": (0, 25), "MEDIUM": (26, 50), "HIGH": (51, 75), "CRITICAL": (76, 100)}
SEVERITY_ORDER = ["NORMAL", "SUPPRESSED", "LOW", "MEDIUM", "HIGH", "CRITICAL"]

# ------------------------------------------------------------------ response
COOLDOWN_SECONDS = {"LOW": 300, "MEDIUM": 120, "HIGH": 60, "CRITICAL": 30}
DEFAULT_COOLDOWN_SECONDS = 120
# severity -> [(action type, text before the address, address column, target)]
# target None means the address itself
RESPONSE_PLAYBOOK = {
    "LOW": [("log_event", "Low-severity anomaly logged for ", "src_ip", None)],
    "MEDIUM": [
        ("generate_alert", "Alert generated for medium-severity threat from ", "src_ip", None),
        ("increase_monitoring", "Monitoring level increased for ", "src_ip", None),
    ],
    "HIGH": [
        ("generate_alert", "HIGH severity alert for ", "src_ip", None),
        ("block_ip", "[SIMULATED] Firewall rule added to block ", "src_ip", None),
        ("notify_soc", "SOC team notified of high-severity threat from ", "src_ip", "SOC_TEAM"),
    ],
    "CRITICAL": [
        ("generate_alert", "🚨 CRITICAL alert for ", "src_ip", None),
        ("block_ip", "[SIMULATED] Emergency firewall block for ", "src_ip", None),
        ("isolate_node", "[SIMULATED] Network isolation for target ", "dst_ip", None),
        ("escalate", "Incident escalated to SOC Lead – CRITICAL threat", None, "SOC_LEAD"),
    ],
}
MAX_ALERTS_KEPT = 500
MAX_LOGS_KEPT = 1000
DEFAULT_ALERT_PAGE = 50
LOG_FEED_ROWS, ALERT_FEED_ROWS, ACTION_FEED_ROWS = 200, 100, 150

# -------------------------------------------- connection dataset (NSL layout)
NSL_STRING_COLUMNS = ["protocol_type", "service", "flag", "attack_type"]
NSL_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds",
    "is_host_login", "is_guest_login", "count", "srv_count", "serror_rate",
    "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "attack_type", "difficulty_level",
]
NSL_ATTACK_CATEGORY = {
    "normal": "Normal", "back": "DoS", "land": "DoS", "neptune": "DoS", "pod": "DoS",
    "smurf": "DoS", "teardrop": "DoS", "apache2": "DoS", "mailbomb": "DoS",
    "processtable": "DoS", "udpstorm": "DoS", "ipsweep": "Probe", "nmap": "Probe",
    "portsweep": "Probe", "satan": "Probe", "mscan": "Probe", "saint": "Probe",
    "ftp_write": "R2L", "guess_passwd": "R2L", "imap": "R2L", "multihop": "R2L", "phf": "R2L",
    "spy": "R2L", "warezclient": "R2L", "warezmaster": "R2L", "xlock": "R2L", "xsnoop": "R2L",
    "snmpgetattack": "R2L", "httptunnel": "R2L", "snmpguess": "R2L", "sendmail": "R2L",
    "named": "R2L", "worm": "R2L", "buffer_overflow": "U2R", "loadmodule": "U2R", "perl": "U2R",
    "rootkit": "U2R", "xterm": "U2R", "ps": "U2R", "sqlattack": "U2R",
}
NSL_PROTOCOL_CODES = {"tcp": 0, "udp": 1, "icmp": 2}
NSL_SERVICE_PORTS = {
    "http": 80, "http_443": 443, "smtp": 25, "ftp": 21, "ftp_data": 20,
    "ssh": 22, "telnet": 23, "domain_u": 53, "domain": 53, "pop_3": 110,
    "imap4": 143, "ldap": 389, "finger": 79, "private": 0, "other": 0,
    "eco_i": 0, "ecr_i": 0, "tim_i": 0, "urp_i": 0, "red_i": 0,
}
NSL_FLAG_SEVERITY = {
    "SF": 0, "S0": 3, "REJ": 4, "RSTR": 3, "RSTO": 3,
    "SH": 2, "S1": 2, "S2": 2, "S3": 2, "OTH": 1,
}
NSL_RISK_WEIGHTS = {
    "hot": 5, "num_failed_logins": 10, "num_compromised": 8,
    "root_shell": 25, "su_attempted": 20, "num_root": 10,
}

# -------------------------------------------------- flow dataset (UNSW layout)
UNSW_ATTACK_CATEGORY = {
    "Normal": "Normal", "Fuzzers": "Probe", "Analysis": "Probe",
    "Backdoor": "U2R", "Backdoors": "U2R", "DoS": "DoS", "Exploits": "R2L",
    "Generic": "DoS", "Reconnaissance": "Probe", "Shellcode": "U2R", "Worms": "U2R",
}
UNSW_PROTOCOL_CODES = {"tcp": 0, "udp": 1, "icmp": 2, "arp": 3}
UNSW_SERVICE_PORTS = {
    "http": 80, "ftp": 21, "ftp-data": 20, "smtp": 25, "ssh": 22, "dns": 53,
    "pop3": 110, "snmp": 161, "ssl": 443, "dhcp": 67, "irc": 6667, "radius": 1812,
}
UNSW_STATE_SEVERITY = {
    "FIN": 0, "CON": 0, "INT": 1, "ACC": 0, "REQ": 1, "RST": 3, "CLO": 0, "no": 2, "ECO": 1,
}
UNSW_STRING_COLUMNS = ["attack_cat", "proto", "service", "state"]
UNSW_LONG_COLUMNS = [
    "label", "sbytes", "dbytes", "ct_state_ttl", "sttl", "is_ftp_login",
    "ct_flw_http_mthd", "is_sm_ips_ports", "spkts", "dpkts", "ct_srv_src",
    "ct_dst_ltm", "ct_srv_dst", "ct_dst_src_ltm", "dttl",
]
UNSW_DOUBLE_COLUMNS = ["dur", "sload", "rate"]

CATEGORY_EVENT_CODES = {"Normal": 0, "DoS": 1, "Probe": 2, "R2L": 3, "U2R": 4, "Unknown": 5}
UNKNOWN_CATEGORY = "Unknown"
OTHER_PROTOCOL_CODE = 3
NSL_DATASET, UNSW_DATASET = "NSL-KDD", "UNSW-NB15"
EPHEMERAL_PORT_LOW, EPHEMERAL_PORT_HIGH = 1024, 65535
MAX_PORT = 65535.0
MAX_DURATION = 300.0
MAX_RISK = 50
WEEKEND_PERCENT = 28

UNIFIED_COLUMNS = TABLE_CORE_FEATURES[:8] + [
    "hour_of_day", "is_weekend", "message_risk_score",
    "label", "attack_category", "attack_type", "dataset",
] + FLOW_FEATURES
