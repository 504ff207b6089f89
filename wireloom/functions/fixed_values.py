"""Fixed values.

Word lists, patterns, lookup tables and constants that decide results. They have to
equal the published ones for results to agree, so they stand here as plain data.
"""

# --- risk words -------------------------------------------------------------------
HIGH_ALERT_WORDS = [
    "ransomware", "heartbleed", "exploit", "c2", "exfil", "infiltrat",
    "trojan", "backdoor", "shellcode", "webshell", "mimikatz",
]
MEDIUM_ALERT_WORDS = [
    "scan", "brute", "beacon", "ddos", "flood", "dos", "patator",
    "injection", "attack", "malware", "bot", "worm", "anomaly",
]
BAD_DOMAIN_WORDS = [
    "malware", "phish", "exploit", "botnet", "evil", "malicious", "trojan", "ransom",
]

# risk level -> status, recommended action, opening words of the summary
RISK_STATUS = {"High": "Active", "Medium": "Monitoring", "Low": "Cleared"}
RISK_ACTION = {
    "High": "Block IP immediately and isolate affected host",
    "Medium": "Investigate source host and monitor traffic",
    "Low": "Normal traffic — no action required",
}
RISK_SIGNAL = {
    "High": "CRITICAL threat signature detected",
    "Medium": "Suspicious pattern detected",
    "Low": "Network activity recorded",
}
# score used when the model gave none
RISK_DEFAULT_SCORE = {"High": 0.92, "Medium": 0.65, "Low": 0.28}

# EVE alert severity -> risk hint (anything else is Low)
SEVERITY_RISK = {1: "High", 2: "Medium", 3: "Low"}

# --- attack categories ------------------------------------------------------------
ATTACK_LABELS = [
    "Benign", "DoS-Hulk", "PortScan", "DDoS", "DoS-GoldenEye",
    "FTP-Patator", "SSH-Patator", "Bot", "Web-BruteForce",
    "Infiltration", "Heartbleed", "Ransomware",
]
CATEGORY_TIER = {
    "Benign": 1,
    "DoS-GoldenEye": 2, "FTP-Patator": 2, "SSH-Patator": 2, "Web-BruteForce": 2, "PortScan": 2,
    "DoS-Hulk": 3, "DDoS": 3, "Bot": 3, "Infiltration": 3, "Heartbleed": 3, "Ransomware": 3,
}
TIER_TEXT = {
    1: "Tier-1 — Low risk: automated response executed",
    2: "Tier-2 — Medium risk: awaiting Analyst approval",
    3: "Tier-3 — High risk: awaiting Manager approval",
}
# alert words -> category, first group that hits wins
ALERT_CATEGORY_WORDS = [
    (["ransomware", "encrypt staging"], "Ransomware"),
    (["heartbleed"], "Heartbleed"),
    (["ddos", "distributed denial"], "DDoS"),
    (["dos flood", "hulk", "goldeneye", "slowloris"], "DoS-Hulk"),
    (["port scan", "portscan", "probe", "sweep", "nmap"], "PortScan"),
    (["ssh brute", "ssh-patator", "ssh patator"], "SSH-Patator"),
    (["ftp brute", "ftp-patator", "ftp patator"], "FTP-Patator"),
    (["web brute", "http brute", "login brute", "credential"], "Web-BruteForce"),
    (["bot", "beacon", "c2", "command and control"], "Bot"),
    (["exfil", "data exfil", "infiltrat"], "Infiltration"),
    (["dos", "flood"], "DoS-Hulk"),
    (["ssh"], "SSH-Patator"),
    (["ftp"], "FTP-Patator"),
]
# category -> (text before the percent, text after it)
REASON_TEXT = {
    "DoS-Hulk": ("Volumetric DoS detected — extremely high packet/byte rate (threat score ", "%)"),
    "PortScan": ("Port scan detected — high destination-port diversity and low-duration flows (", "%)"),
    "DDoS": ("DDoS flood detected — SYN/UDP storm from multiple source IPs (", "%)"),
    "DoS-GoldenEye": ("HTTP DoS (GoldenEye) — repeated connection exhaustion attack (", "%)"),
    "FTP-Patator": ("FTP brute force detected — repeated login attempts on port 21 (", "%)"),
    "SSH-Patator": ("SSH brute force detected — credential stuffing on port 22 (", "%)"),
    "Bot": ("Beaconing bot detected — periodic C2 check-in with DGA domain (", "%)"),
    "Web-BruteForce": ("Web brute force detected — rapid HTTP auth failures (", "%)"),
    "Infiltration": ("Low-and-slow infiltration — prolonged anomalous data transfer (", "%)"),
    "Heartbleed": ("Heartbleed exploit detected — TLS memory leak pattern (", "%)"),
    "Ransomware": ("Ransomware staging detected — encrypted exfiltration to DGA domain (", "%)"),
}
BENIGN_REASON = "Traffic within normal baseline parameters"
OTHER_REASON = ("Anomalous traffic pattern detected (", "% threat confidence)")
OVERRIDE_FLOOR = 0.3
OVERRIDE_SCORE = 0.65

# --- ATT&CK -----------------------------------------------------------------------
TACTICS = [
    ("TA0043", "Reconnaissance"),
    ("TA0001", "Initial Access"),
    ("TA0002", "Execution"),
    ("TA0003", "Persistence"),
    ("TA0004", "Privilege Escalation"),
    ("TA0005", "Defense Evasion"),
    ("TA0006", "Credential Access"),
    ("TA0007", "Discovery"),
    ("TA0008", "Lateral Movement"),
    ("TA0009", "Collection"),
    ("TA0010", "Exfiltration"),
    ("TA0011", "Command and Control"),
    ("TA0040", "Impact"),
]
TECHNIQUES = [
    ("TA0043", "T1046", "Network Service Discovery"),
    ("TA0043", "T1592", "Gather Victim Host Information"),
    ("TA0043", "T1589", "Gather Victim Identity Information"),
    ("TA0001", "T1566", "Phishing"),
    ("TA0001", "T1190", "Exploit Public-Facing Application"),
    ("TA0001", "T1195", "Supply Chain Compromise"),
    ("TA0002", "T1204", "User Execution"),
    ("TA0002", "T1648", "Serverless Execution"),
    ("TA0003", "T1547", "Boot or Logon Autostart Execution"),
    ("TA0003", "T1037", "Boot or Logon Initialization Scripts"),
    ("TA0004", "T1548", "Abuse Elevation Control Mechanism"),
    ("TA0004", "T1547", "Boot or Logon Autostart Execution"),
    ("TA0005", "T1197", "BITS Jobs"),
    ("TA0005", "T1612", "Build Image on Host"),
    ("TA0006", "T1110", "Brute Force"),
    ("TA0006", "T1555", "Credentials from Password Stores"),
    ("TA0006", "T1187", "Forced Authentication"),
    ("TA0007", "T1087", "Account Discovery"),
    ("TA0007", "T1518", "Software Discovery"),
    ("TA0008", "T1570", "Lateral Tool Transfer"),
    ("TA0009", "T1557", "Adversary-in-the-Middle"),
    ("TA0009", "T1123", "Audio Capture"),
    ("TA0010", "T1020", "Automated Exfiltration"),
    ("TA0010", "T1048", "Exfiltration Over Alternative Protocol"),
    ("TA0011", "T1071", "Application Layer Protocol"),
    ("TA0011", "T1092", "Communication Through Removable Media"),
    ("TA0011", "T1568", "Dynamic Resolution"),
    ("TA0040", "T1531", "Account Access Removal"),
    ("TA0040", "T1485", "Data Destruction"),
    ("TA0040", "T1486", "Data Encrypted for Impact"),
]
# ordered text rules: (tactic, technique, patterns); the first rule with a hit wins
TEXT_RULES = [
    ("TA0043", "T1046",
     ["scan", "nmap", "port.*scan", "network.*scan", "udp.*scan", "tcp.*scan", "syn.*scan"]),
    ("TA0001", "T1566",
     ["phish", "email.*spam", "credential.*theft", "social.*engineering", "malicious.*link"]),
    ("TA0001", "T1190",
     ["exploit", "shellcode", "overflow", "vulnerability", "injection", "sql.*injection", "xss", "rce"]),
    ("TA0006", "T1110",
     ["brute.*force", "password.*attack", "credential.*attack", "login.*attempt", "auth.*fail",
      "failed.*login"]),
    ("TA0011", "T1071",
     ["c2.*beacon", "command.*control", "reverse.*shell", "backdoor", "agent.*callback", "beacon"]),
    ("TA0011", "T1568.002",
     ["dga", "dynamic.*domain", "domain.*generation", "fast.*flux", "domain.*flux"]),
    ("TA0010", "T1041",
     ["exfil", "data.*theft", "data.*extract", "data.*transfer", "large.*transfer",
      "unusual.*traffic.*size"]),
    ("TA0040", "T1486",
     ["ransomware", "encrypt.*file", "crypto.*locker", "wannacry", "petya", "notpetya", "darkside"]),
]
DGA_RULE = ("TA0011", "T1568.002", "Dynamic Resolution: Domain Generation Algorithm")
DGA_MIN_LENGTH = 5
DGA_MIN_ENTROPY = 3.8
DOMAIN_RULE = ("TA0001", "T1566")
DOMAIN_RULE_WORDS = [
    "malware", "trojan", "botnet", "ransomware", "phish",
    "malicious", "evil", "c2", "command", "control",
]
# the 14 cells of the tactic heatmap, in display order
HEATMAP_TACTICS = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution",
    "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access",
    "Discovery", "Lateral Movement", "Collection", "Command and Control",
    "Exfiltration", "Impact",
]

# --- Zeek -------------------------------------------------------------------------
ZEEK_LOG_TYPES = ["conn", "dns", "http", "ssl", "notice", "files"]
ZEEK_BAD_CONN_STATES = ["S0", "REJ", "RSTOS0", "RSTRH", "SH", "SHR"]
ZEEK_BAD_NOTES = [
    "Scan::Port_Scan", "Scan::Address_Scan", "SSL::Invalid_Server_Cert",
    "HTTP::SQL_Injection_Attacker", "Exploit::", "Trojan::", "C2::",
]

# --- field aliases, in order of preference ----------------------------------------
GENERIC_JSON_ALIASES = {
    "source_ip": ["src_ip", "source_ip", "src", "orig_h"],
    "destination_ip": ["dest_ip", "destination_ip", "dst_ip", "dst", "resp_h"],
    "domain": ["domain", "query", "hostname", "host", "server_name"],
    "timestamp": ["timestamp", "time", "ts", "@timestamp"],
    "alert_type": ["alert_type", "event_type", "alert", "signature", "type", "note"],
    "protocol": ["proto", "protocol"],
}
CSV_ALIASES = {
    "source_ip": ["source_ip", "src_ip", "src", "orig_h"],
    "destination_ip": ["destination_ip", "dest_ip", "dst_ip", "dst", "resp_h"],
    "timestamp": ["timestamp", "time", "ts"],
    "domain": ["domain", "hostname", "query"],
    "alert_type": ["alert_type", "alert", "event"],
    "protocol": ["proto", "protocol"],
}
JSON_ACCEPT_SHARE = 0.2
# characters of one CSV cell beyond which a file is not read as CSV
CSV_CELL_LIMIT = 131072

# --- live filter ------------------------------------------------------------------
ALWAYS_KEPT_TYPES = ["alert", "anomaly"]
DOMAIN_BOUND_TYPES = ["dns", "http", "tls"]
KEPT_TYPES = ["dns", "http", "tls", "ssh", "ftp", "smtp"]
PRIVATE_PREFIXES = [
    "10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.20.", "172.21.",
    "172.22.", "172.23.", "172.24.", "172.25.", "172.26.", "172.27.", "172.28.", "172.29.",
    "172.30.", "172.31.", "127.", "::1", "fe80:", "fc", "fd",
]

# --- feature rules ----------------------------------------------------------------
SYN_WORDS = ["scan", "syn", "dos", "ddos", "flood"]
FIN_WORDS = ["close", "fin"]
RST_WORDS = ["scan", "reject", "reset"]
PSH_WORDS = ["exfil", "data", "upload"]
DOS_WORDS = ["dos", "ddos", "flood", "hulk", "goldeneye"]
SCAN_WORDS = ["scan", "probe", "sweep", "portscan"]
BRUTE_WORDS = ["brute", "patator", "credential", "login"]
BOT_WORDS = ["bot", "beacon", "c2", "command", "ransomware"]
EXFIL_WORDS = ["exfil", "transfer", "upload", "infiltrat"]
UDP_PORTS = [53, 123, 161]
# value of the first behaviour flag that is set, and the value without any; the order differs
FLOW_SECONDS = ([("scan", 0.005), ("dos", 0.02), ("brute", 0.3), ("bot", 1.2), ("exfil", 5.0)], 1.5)
FLOW_PACKETS = ([("dos", 500), ("scan", 2), ("brute", 10), ("bot", 5), ("exfil", 30)], 12)
BASELINE_DEVIATION = ([("dos", 3.5), ("scan", 2.8), ("brute", 2.0), ("bot", 2.5), ("exfil", 3.0)], 0.1)
TEMPORAL_ANOMALY = ([("dos", 4.0), ("bot", 0.5), ("scan", 2.0)], 0.05)
BACKWARD_SHARE = 0.65
FORWARD_PACKET_BYTES = 350
BACKWARD_PACKET_BYTES = 290
PACKET_SPREAD = 0.3
GAP_SPREAD_BOT = 0.1
GAP_SPREAD = 0.55
ACTIVE_SHARES = [0.4, 0.1, 0.6, 0.05]
IDLE_SHARES = [0.5, 0.15, 0.8, 0.05]
WINDOW_BYTES = 8192
DEFAULT_DST_PORT = 443
DEFAULT_SRC_PORT = 52000
DEFAULT_DOMAIN_ENTROPY = 1.5
PAYLOAD_CHARS = 64
CONTEXT_EVENTS = 20
SEQUENCE_LENGTH = 20

FEATURE_NAMES = [
    "duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts",
    "fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_std",
    "bwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean", "bwd_pkt_len_std",
    "flow_byts_per_s", "flow_pkts_per_s",
    "fwd_iat_tot", "fwd_iat_mean", "fwd_iat_std", "fwd_iat_max", "fwd_iat_min",
    "bwd_iat_tot", "bwd_iat_mean", "bwd_iat_std", "bwd_iat_max", "bwd_iat_min",
    "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min",
    "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags",
    "fwd_header_len", "bwd_header_len",
    "fin_flag_cnt", "syn_flag_cnt", "rst_flag_cnt", "psh_flag_cnt",
    "ack_flag_cnt", "urg_flag_cnt", "cwe_flag_cnt", "ece_flag_cnt",
    "fwd_avg_byts_bulk", "fwd_avg_pkts_bulk", "fwd_avg_blk_rate",
    "bwd_avg_byts_bulk", "bwd_avg_pkts_bulk", "bwd_avg_blk_rate",
    "subflow_fwd_pkts", "subflow_fwd_byts", "subflow_bwd_pkts", "subflow_bwd_byts",
    "active_mean", "active_std", "active_max", "active_min",
    "idle_mean", "idle_std", "idle_max", "idle_min",
    "payload_entropy", "domain_entropy",
    "baseline_deviation", "ip_diversity", "port_diversity", "temporal_anomaly",
    "protocol", "dst_port", "src_port",
    "down_up_ratio", "avg_pkt_size", "avg_fwd_seg_size", "avg_bwd_seg_size",
    "fwd_act_data_pkts", "fwd_seg_size_min", "init_win_byts_fwd", "init_win_byts_bwd",
]
# median and inter-quartile range of benign traffic, one value per feature above
FEATURE_MEDIANS = [
    1.5, 12, 8, 6500, 4200, 800, 40, 340, 180, 700, 35, 290, 155, 18000, 35,
    0.08, 0.02, 0.01, 0.15, 0.001, 0.07, 0.018, 0.009, 0.12, 0.001, 0.025, 0.02, 0.15, 0.001,
    1, 1, 0, 0, 32, 32, 1, 1, 0, 2, 5, 0, 0, 0, 200, 2, 1200, 150, 1.5, 500, 4, 2000, 3, 1400,
    0.02, 0.01, 0.04, 0.005, 0.01, 0.005, 0.04, 0.005, 3.2, 1.5,
    0.1, 3, 5, 0.05, 6, 443, 52000, 0.85, 380, 340, 290, 8, 40, 8192, 8192,
]
FEATURE_IQRS = [
    3, 25, 18, 15000, 10000, 600, 30, 250, 140, 550, 28, 220, 120, 40000, 80,
    0.15, 0.04, 0.02, 0.3, 0.002, 0.13, 0.035, 0.018, 0.25, 0.002, 0.05, 0.04, 0.3, 0.002,
    1, 1, 0.1, 0.1, 16, 16, 1, 1, 1, 3, 8, 0.5, 0.1, 0.1, 400, 3, 2500, 350, 3, 1000, 8, 4500, 5, 3000,
    0.04, 0.02, 0.08, 0.01, 0.02, 0.01, 0.08, 0.01, 1.5, 1.2,
    0.5, 5, 8, 0.2, 11, 22000, 13000, 0.4, 300, 270, 230, 10, 30, 16384, 16384,
]
IQR_EPSILON = 1e-8

# heuristic classifier, first rule that holds wins: limits, score, category
HEURISTIC_LIMITS = {
    "flood_pps": 5000, "flood_bps": 2e7, "port_diversity": 100,
    "domain_entropy": 4.5, "payload_entropy": 6.5, "slow_bps": 5e5,
}
HEURISTIC_SCORES = {
    "DDoS": 0.92, "PortScan": 0.80, "Bot": 0.75, "Heartbleed": 0.70, "DoS-GoldenEye": 0.55,
}

# --- model settings ---------------------------------------------------------------
FOREST_TREES = 200
FOREST_CONTAMINATION = 0.09
FOREST_SAMPLE = 256
NOVELTY_NU = 0.08
SPLIT_SHARE = 0.15
SEED = 42

# --- incident titles: (kind of test, words, title), first hit wins ----------------
NO_ALERT_TITLE = "Network Event"
TITLE_RULES = [
    ("detail", ["dns-query:"], "DNS Lookup: "),
    ("detail", ["tls:"], "Secure Connection: "),
    ("detail", ["http:"], "Web Request: "),
    ("prefix", ["dns-query"], "DNS Lookup"),
    ("word", ["netflow:tcp"], "TCP Network Flow"),
    ("word", ["netflow:udp"], "UDP Network Flow"),
    ("word", ["flow:tcp"], "TCP Connection"),
    ("word", ["flow:udp"], "UDP Connection"),
    ("word", ["anomaly"], "Network Anomaly Detected"),
    ("word", ["portscan", "port scan"], "Port Scan Detected"),
    ("word", ["brute"], "Brute Force Attempt"),
    ("word", ["exploit"], "Exploit Attempt"),
    ("word", ["malware"], "Malware Communication"),
    ("word", ["ransomware"], "Ransomware Activity"),
    ("word", ["c2", "beacon"], "C2 Beacon Detected"),
    ("word", ["ddos", "flood"], "DDoS / Flood Attack"),
    ("word", ["ssh"], "SSH Activity"),
    ("word", ["ftp"], "FTP Activity"),
    ("word", ["dns"], "DNS Activity"),
]
