"""DuckDB twins of the queries, written by hand against the same tables."""

ORACLE_SQL: dict[str, str] = {}

FLOWS = """
flows AS (
  SELECT event_id AS seq, CAST(user_id % 3 AS BIGINT) AS organization_id,
    CAST(CAST(floor(event_id / 50) AS BIGINT) AS VARCHAR) AS batch_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
    CASE WHEN k % 25 = 7 THEN ''
         ELSE concat('10.0.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) END AS source_ip,
    concat(CASE WHEN k % 2 = 0 THEN '192.168.1.' ELSE '203.0.113.' END, CAST(k % 50 AS VARCHAR)) AS destination_ip,
    CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'google.com' WHEN 2 THEN concat(md5(CAST(event_id AS VARCHAR)), '.biz')
               WHEN 3 THEN 'malicious-login.com' ELSE 'ransomware-c2.xyz' END AS domain,
    CASE k % 12 WHEN 0 THEN 'Port Scan' WHEN 1 THEN 'DDoS Flood' WHEN 2 THEN 'Bot C2 Beacon' WHEN 3 THEN 'SSH Brute Force'
      WHEN 4 THEN 'Ransomware Staging' WHEN 5 THEN 'DoS Flood' WHEN 6 THEN 'FTP Brute Force' WHEN 7 THEN 'Heartbleed Exploit'
      WHEN 8 THEN 'Data Exfiltration' WHEN 9 THEN 'Web Brute Force' WHEN 10 THEN 'dns-query: google.com' ELSE 'flow:tcp' END AS alert_type,
    CASE k % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' END AS hint,
    k, event_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

_HIGH = "ransomware|heartbleed|exploit|c2|exfil|infiltrat|trojan|backdoor|shellcode|webshell|mimikatz"
_MEDIUM = "scan|brute|beacon|ddos|flood|dos|patator|injection|attack|malware|bot|worm|anomaly"
_DOMAIN = "malware|phish|exploit|botnet|evil|malicious|trojan|ransom"


def risk(hint: str = "NULL") -> str:
    return f"""CASE
      WHEN coalesce({hint} = 'High', false) OR regexp_matches(lower(alert_type), '{_HIGH}')
        OR regexp_matches(lower(domain), '{_DOMAIN}') THEN 'High'
      WHEN coalesce({hint} = 'Medium', false) OR regexp_matches(lower(alert_type), '{_MEDIUM}') THEN 'Medium'
      ELSE 'Low' END"""


STATUS = """CASE risk_level WHEN 'High' THEN 'Active' WHEN 'Medium' THEN 'Monitoring' ELSE 'Cleared' END"""
ACTION = """CASE risk_level WHEN 'High' THEN 'Block IP immediately and isolate affected host'
  WHEN 'Medium' THEN 'Investigate source host and monitor traffic'
  ELSE 'Normal traffic — no action required' END"""

DETECTED = f"""
classified AS (SELECT *, {risk()} AS risk_level FROM flows WHERE source_ip <> '' AND destination_ip <> ''),
detected AS (
  SELECT *, {STATUS} AS status, {ACTION} AS recommended_action,
    concat(CASE risk_level WHEN 'High' THEN 'CRITICAL threat signature detected'
                           WHEN 'Medium' THEN 'Suspicious pattern detected' ELSE 'Network activity recorded' END,
           ': ', alert_type, ' | ', source_ip, ' → ', destination_ip,
           CASE WHEN domain <> '' THEN concat(' | Domain: ', domain) ELSE '' END, '.') AS summary
  FROM classified WHERE risk_level <> 'Low' OR domain <> '')"""


def category(alert: str = "alert_type") -> str:
    a = f"lower({alert})"
    return f"""CASE
      WHEN regexp_matches({a}, 'ransomware|encrypt staging') THEN 'Ransomware'
      WHEN contains({a}, 'heartbleed') THEN 'Heartbleed'
      WHEN regexp_matches({a}, 'ddos|distributed denial') THEN 'DDoS'
      WHEN regexp_matches({a}, 'dos flood|hulk|goldeneye|slowloris') THEN 'DoS-Hulk'
      WHEN regexp_matches({a}, 'port scan|portscan|probe|sweep|nmap') THEN 'PortScan'
      WHEN regexp_matches({a}, 'ssh brute|ssh-patator|ssh patator') THEN 'SSH-Patator'
      WHEN regexp_matches({a}, 'ftp brute|ftp-patator|ftp patator') THEN 'FTP-Patator'
      WHEN regexp_matches({a}, 'web brute|http brute|login brute|credential') THEN 'Web-BruteForce'
      WHEN regexp_matches({a}, 'bot|beacon|c2|command and control') THEN 'Bot'
      WHEN regexp_matches({a}, 'exfil|infiltrat') THEN 'Infiltration'
      WHEN regexp_matches({a}, 'dos|flood') THEN 'DoS-Hulk'
      WHEN contains({a}, 'ssh') THEN 'SSH-Patator'
      WHEN contains({a}, 'ftp') THEN 'FTP-Patator' END"""


def tier(cat: str) -> str:
    return f"""CASE WHEN {cat} = 'Benign' THEN 1
      WHEN {cat} IN ('DoS-GoldenEye', 'FTP-Patator', 'SSH-Patator', 'Web-BruteForce', 'PortScan') THEN 2
      WHEN {cat} IN ('DoS-Hulk', 'DDoS', 'Bot', 'Infiltration', 'Heartbleed', 'Ransomware') THEN 3 ELSE 2 END"""


def reason(cat: str, score: str) -> str:
    pct = f"CAST(CAST(floor({score} * CAST(100 AS DOUBLE)) AS BIGINT) AS VARCHAR)"
    return f"""CASE {cat}
      WHEN 'Benign' THEN 'Traffic within normal baseline parameters'
      WHEN 'DoS-Hulk' THEN concat('Volumetric DoS detected — extremely high packet/byte rate (threat score ', {pct}, '%)')
      WHEN 'PortScan' THEN concat('Port scan detected — high destination-port diversity and low-duration flows (', {pct}, '%)')
      WHEN 'DDoS' THEN concat('DDoS flood detected — SYN/UDP storm from multiple source IPs (', {pct}, '%)')
      WHEN 'DoS-GoldenEye' THEN concat('HTTP DoS (GoldenEye) — repeated connection exhaustion attack (', {pct}, '%)')
      WHEN 'FTP-Patator' THEN concat('FTP brute force detected — repeated login attempts on port 21 (', {pct}, '%)')
      WHEN 'SSH-Patator' THEN concat('SSH brute force detected — credential stuffing on port 22 (', {pct}, '%)')
      WHEN 'Bot' THEN concat('Beaconing bot detected — periodic C2 check-in with DGA domain (', {pct}, '%)')
      WHEN 'Web-BruteForce' THEN concat('Web brute force detected — rapid HTTP auth failures (', {pct}, '%)')
      WHEN 'Infiltration' THEN concat('Low-and-slow infiltration — prolonged anomalous data transfer (', {pct}, '%)')
      WHEN 'Heartbleed' THEN concat('Heartbleed exploit detected — TLS memory leak pattern (', {pct}, '%)')
      WHEN 'Ransomware' THEN concat('Ransomware staging detected — encrypted exfiltration to DGA domain (', {pct}, '%)')
      ELSE concat('Anomalous traffic pattern detected (', {pct}, '% threat confidence)') END"""


def entropy(text: str, length: str | None = None) -> str:
    """Entropy of the characters of ``text`` (0 when empty)."""
    n = length or f"length({text})"
    share = f"((length({text}) - length(replace({text}, c, ''))) / CAST({n} AS DOUBLE))"
    return f"""CASE WHEN length({text}) = 0 THEN CAST(0 AS DOUBLE)
      ELSE 0 - list_sum(list_transform(list_distinct(string_split({text}, '')), lambda c: {share} * log2({share}))) END"""


def label_entropy(domain: str) -> str:
    return f"CASE WHEN length({domain}) < 3 THEN CAST(0 AS DOUBLE) ELSE {entropy(f'lower(split_part({domain}, chr(46), 1))')} END"


def full_entropy(domain: str) -> str:
    return f"CASE WHEN {domain} = '' THEN CAST(1.5 AS DOUBLE) ELSE {entropy(domain)} END"


PAYLOAD = "substr(concat(source_ip, destination_ip, alert_type, domain), 1, 64)"

# --- base features ------------------------------------------------------------------
BASE = f"""
flags AS (
  SELECT *, lower(alert_type) AS a,
    regexp_matches(lower(alert_type), 'dos|flood|hulk|goldeneye') AS f_dos,
    regexp_matches(lower(alert_type), 'scan|probe|sweep') AS f_scan,
    regexp_matches(lower(alert_type), 'brute|patator|credential|login') AS f_brute,
    regexp_matches(lower(alert_type), 'bot|beacon|c2|command|ransomware') AS f_bot,
    regexp_matches(lower(alert_type), 'exfil|transfer|upload|infiltrat') AS f_exfil,
    coalesce(list(source_ip) OVER w, []) AS srcs, coalesce(list(destination_ip) OVER w, []) AS dsts,
    CAST(count(*) OVER w AS DOUBLE) AS port_diversity
  FROM flows WINDOW w AS (PARTITION BY organization_id, batch_id ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
q1 AS (
  SELECT *, CAST(len(list_distinct(list_concat(srcs, dsts))) AS DOUBLE) AS ip_diversity,
    CAST(CASE WHEN f_scan THEN 0.005 WHEN f_dos THEN 0.02 WHEN f_brute THEN 0.3 WHEN f_bot THEN 1.2 WHEN f_exfil THEN 5.0 ELSE 1.5 END AS DOUBLE) AS dur,
    CAST(CASE WHEN f_dos THEN 500 WHEN f_scan THEN 2 WHEN f_brute THEN 10 WHEN f_bot THEN 5 WHEN f_exfil THEN 30 ELSE 12 END AS DOUBLE) AS fwd,
    CAST(CASE WHEN f_dos THEN 3.5 WHEN f_scan THEN 2.8 WHEN f_brute THEN 2.0 WHEN f_bot THEN 2.5 WHEN f_exfil THEN 3.0 ELSE 0.1 END AS DOUBLE) AS dev,
    CAST(CASE WHEN f_dos THEN 4.0 WHEN f_bot THEN 0.5 WHEN f_scan THEN 2.0 ELSE 0.05 END AS DOUBLE) AS temporal,
    CAST(CASE WHEN regexp_matches(a, 'scan|syn|dos|flood') THEN 2 ELSE 1 END AS DOUBLE) AS syn,
    CAST(CASE WHEN regexp_matches(a, 'close|fin') THEN 1 ELSE 0 END AS DOUBLE) AS fin,
    CAST(CASE WHEN regexp_matches(a, 'scan|reject|reset') THEN 2 ELSE 0 END AS DOUBLE) AS rst,
    CAST(CASE WHEN regexp_matches(a, 'exfil|data|upload') THEN 3 ELSE 1 END AS DOUBLE) AS psh,
    CAST(CASE WHEN contains(a, 'urgent') THEN 1 ELSE 0 END AS DOUBLE) AS urg,
    CAST(CASE WHEN contains(a, 'icmp') THEN 1 WHEN contains(a, 'udp') THEN 17 ELSE 6 END AS DOUBLE) AS proto,
    {entropy(PAYLOAD)} AS payload_entropy, {full_entropy('domain')} AS domain_entropy
  FROM flags),
q2 AS (SELECT *, floor(fwd * CAST(0.65 AS DOUBLE)) AS bwd FROM q1),
q3 AS (
  SELECT *, fwd * 350 AS lfwd, bwd * 290 AS lbwd, fwd / dur AS pps, fwd * 350 / dur AS bps,
    fwd * 350 / greatest(fwd, 1) AS pm_f, bwd * 290 / greatest(bwd, 1) AS pm_b,
    dur / greatest(fwd - 1, 1) AS gap,
    dur / greatest(fwd - 1, 1) * CAST(CASE WHEN f_bot THEN 0.1 ELSE 0.55 END AS DOUBLE) AS gap_std
  FROM q2)"""

# feature -> (formula, median, inter-quartile range)
FEATURES = {
    "duration": ("dur", 1.5, 3), "tot_fwd_pkts": ("fwd", 12, 25), "tot_bwd_pkts": ("bwd", 8, 18),
    "totlen_fwd_pkts": ("lfwd", 6500, 15000), "totlen_bwd_pkts": ("lbwd", 4200, 10000),
    "fwd_pkt_len_max": ("pm_f * 1.6", 800, 600), "fwd_pkt_len_min": ("pm_f * 0.7", 40, 30),
    "fwd_pkt_len_mean": ("pm_f", 340, 250), "fwd_pkt_len_std": ("pm_f * 0.3", 180, 140),
    "bwd_pkt_len_max": ("pm_b * 1.6", 700, 550), "bwd_pkt_len_min": ("pm_b * 0.7", 35, 28),
    "bwd_pkt_len_mean": ("pm_b", 290, 220), "bwd_pkt_len_std": ("pm_b * 0.3", 155, 120),
    "flow_byts_per_s": ("bps", 18000, 40000), "flow_pkts_per_s": ("pps", 35, 80),
    "fwd_iat_tot": ("gap * fwd", 0.08, 0.15), "fwd_iat_mean": ("gap", 0.02, 0.04),
    "fwd_iat_std": ("gap_std", 0.01, 0.02), "fwd_iat_max": ("gap * 2.5", 0.15, 0.3),
    "fwd_iat_min": ("gap * 0.05", 0.001, 0.002),
    "bwd_iat_tot": ("gap * bwd", 0.07, 0.13), "bwd_iat_mean": ("gap", 0.018, 0.035),
    "bwd_iat_std": ("gap_std", 0.009, 0.018), "bwd_iat_max": ("gap * 2.5", 0.12, 0.25),
    "bwd_iat_min": ("gap * 0.05", 0.001, 0.002),
    "flow_iat_mean": ("gap", 0.025, 0.05), "flow_iat_std": ("gap_std", 0.02, 0.04),
    "flow_iat_max": ("gap * 3", 0.15, 0.3), "flow_iat_min": ("gap * 0.05", 0.001, 0.002),
    "fwd_psh_flags": ("psh", 1, 1), "bwd_psh_flags": ("psh", 1, 1),
    "fwd_urg_flags": ("urg", 0, 0.1), "bwd_urg_flags": ("urg", 0, 0.1),
    "fwd_header_len": ("proto * 4", 32, 16), "bwd_header_len": ("proto * 4", 32, 16),
    "fin_flag_cnt": ("fin", 1, 1), "syn_flag_cnt": ("syn", 1, 1), "rst_flag_cnt": ("rst", 0, 1),
    "psh_flag_cnt": ("psh", 2, 3), "ack_flag_cnt": ("1", 5, 8), "urg_flag_cnt": ("urg", 0, 0.5),
    "cwe_flag_cnt": ("0", 0, 0.1), "ece_flag_cnt": ("0", 0, 0.1),
    "fwd_avg_byts_bulk": ("pm_f * 2", 200, 400), "fwd_avg_pkts_bulk": ("2", 2, 3),
    "fwd_avg_blk_rate": ("bps * 0.5", 1200, 2500),
    "bwd_avg_byts_bulk": ("pm_b * 2", 150, 350), "bwd_avg_pkts_bulk": ("1.5", 1.5, 3),
    "bwd_avg_blk_rate": ("bps * 0.3", 500, 1000),
    "subflow_fwd_pkts": ("floor(fwd / 4)", 4, 8), "subflow_fwd_byts": ("floor(lfwd / 4)", 2000, 4500),
    "subflow_bwd_pkts": ("floor(bwd / 4)", 3, 5), "subflow_bwd_byts": ("floor(lbwd / 4)", 1400, 3000),
    "active_mean": ("dur * 0.4", 0.02, 0.04), "active_std": ("dur * 0.1", 0.01, 0.02),
    "active_max": ("dur * 0.6", 0.04, 0.08), "active_min": ("dur * 0.05", 0.005, 0.01),
    "idle_mean": ("dur * 0.5", 0.01, 0.02), "idle_std": ("dur * 0.15", 0.005, 0.01),
    "idle_max": ("dur * 0.8", 0.04, 0.08), "idle_min": ("dur * 0.05", 0.005, 0.01),
    "payload_entropy": ("payload_entropy", 3.2, 1.5), "domain_entropy": ("domain_entropy", 1.5, 1.2),
    "baseline_deviation": ("dev", 0.1, 0.5), "ip_diversity": ("ip_diversity", 3, 5),
    "port_diversity": ("port_diversity", 5, 8), "temporal_anomaly": ("temporal", 0.05, 0.2),
    "protocol": ("proto", 6, 11), "dst_port": ("443", 443, 22000), "src_port": ("52000", 52000, 13000),
    "down_up_ratio": ("lbwd / greatest(lfwd, 1)", 0.85, 0.4),
    "avg_pkt_size": ("(lfwd + lbwd) / greatest(fwd + bwd, 1)", 380, 300),
    "avg_fwd_seg_size": ("pm_f", 340, 270), "avg_bwd_seg_size": ("pm_b", 290, 230),
    "fwd_act_data_pkts": ("fwd", 8, 10), "fwd_seg_size_min": ("pm_f * 0.4", 40, 30),
    "init_win_byts_fwd": ("8192", 8192, 16384), "init_win_byts_bwd": ("8192", 8192, 16384),
}


def z(name: str) -> str:
    formula, median, iqr = FEATURES[name]
    return f"((CAST({formula} AS DOUBLE) - CAST({median} AS DOUBLE)) / CAST({iqr + 1e-8!r} AS DOUBLE))"


def heuristic(scaled: bool) -> str:
    v = (lambda n: z(n)) if scaled else (lambda n: f"CAST({FEATURES[n][0]} AS DOUBLE)")
    return f"""CASE WHEN {v('flow_pkts_per_s')} > 5000 OR {v('flow_byts_per_s')} > 20000000 THEN 'DDoS'
      WHEN {v('port_diversity')} > 100 THEN 'PortScan' WHEN {v('domain_entropy')} > 4.5 THEN 'Bot'
      WHEN {v('payload_entropy')} > 6.5 THEN 'Heartbleed' WHEN {v('flow_byts_per_s')} > 500000 THEN 'DoS-GoldenEye'
      ELSE 'Benign' END"""


# --- predictions without a model ------------------------------------------------------
PREDICTED = f"""
judged AS (
  SELECT *, {heuristic(True)} AS own_category FROM q3),
scored AS (
  SELECT *, CASE own_category WHEN 'DDoS' THEN 0.92 WHEN 'PortScan' THEN 0.8 WHEN 'Bot' THEN 0.75
                              WHEN 'Heartbleed' THEN 0.7 WHEN 'DoS-GoldenEye' THEN 0.55 ELSE 0 END AS own_score,
    {category()} AS named FROM judged),
predicted AS (
  SELECT *, {tier('attack_category')} AS risk_tier,
    CASE WHEN attack_category = 'Benign' THEN 'normal' ELSE 'suspicious' END AS ai_prediction,
    threat_score AS ai_score, {reason('attack_category', 'threat_score')} AS ai_reason
  FROM (SELECT *, CASE WHEN own_category = 'Benign' THEN coalesce(named, 'Benign') ELSE own_category END AS attack_category,
          CAST(CASE WHEN own_category = 'Benign' AND named IS NOT NULL AND own_score < 0.3 THEN 0.65 ELSE own_score END AS DOUBLE) AS threat_score
        FROM scored))"""

PREDICTION_COLUMNS = "attack_category, threat_score, risk_tier, ai_prediction, ai_score, ai_reason"

MATCHED = f"""
firsts AS (
  SELECT organization_id, batch_id, source_ip, destination_ip, {PREDICTION_COLUMNS}
  FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, batch_id, source_ip, destination_ip ORDER BY seq) AS rn
        FROM predicted) WHERE rn = 1),
matched AS (
  SELECT d.*, f.attack_category, f.threat_score, f.risk_tier, f.ai_prediction, f.ai_score, f.ai_reason
  FROM detected d LEFT JOIN firsts f USING (organization_id, batch_id, source_ip, destination_ip))"""


def mitre_rule(text: str, domain: str) -> str:
    """1-based number of the rule that decides, null when none does."""
    return f"""CASE
      WHEN regexp_matches({text}, 'scan|nmap') THEN 1
      WHEN regexp_matches({text}, 'phish|email.*spam|credential.*theft|social.*engineering|malicious.*link') THEN 2
      WHEN regexp_matches({text}, 'exploit|shellcode|overflow|vulnerability|injection|xss|rce') THEN 3
      WHEN regexp_matches({text}, 'brute.*force|password.*attack|credential.*attack|login.*attempt|auth.*fail|failed.*login') THEN 4
      WHEN regexp_matches({text}, 'c2.*beacon|command.*control|reverse.*shell|backdoor|agent.*callback|beacon') THEN 5
      WHEN regexp_matches({text}, 'dga|dynamic.*domain|domain.*generation|fast.*flux|domain.*flux') THEN 6
      WHEN regexp_matches({text}, 'exfil|data.*theft|data.*extract|data.*transfer|large.*transfer|unusual.*traffic.*size') THEN 7
      WHEN regexp_matches({text}, 'ransomware|encrypt.*file|crypto.*locker|wannacry|petya|notpetya|darkside') THEN 8
      WHEN length({domain}) > 5 AND {label_entropy(domain)} > 3.8 THEN 9
      WHEN regexp_matches(lower({domain}), 'malware|trojan|botnet|ransomware|phish|malicious|evil|c2|command|control') THEN 10 END"""


MITRE_COLUMNS = """
  CASE rule WHEN 1 THEN 'TA0043' WHEN 2 THEN 'TA0001' WHEN 3 THEN 'TA0001' WHEN 4 THEN 'TA0006' WHEN 5 THEN 'TA0011'
            WHEN 6 THEN 'TA0011' WHEN 7 THEN 'TA0010' WHEN 8 THEN 'TA0040' WHEN 9 THEN 'TA0011' WHEN 10 THEN 'TA0001' END AS mitre_tactic_id,
  CASE rule WHEN 1 THEN 'Reconnaissance' WHEN 2 THEN 'Initial Access' WHEN 3 THEN 'Initial Access' WHEN 4 THEN 'Credential Access'
            WHEN 5 THEN 'Command and Control' WHEN 6 THEN 'Command and Control' WHEN 7 THEN 'Exfiltration' WHEN 8 THEN 'Impact'
            WHEN 9 THEN 'Command and Control' WHEN 10 THEN 'Initial Access' END AS mitre_tactic,
  CASE rule WHEN 1 THEN 'T1046' WHEN 2 THEN 'T1566' WHEN 3 THEN 'T1190' WHEN 4 THEN 'T1110' WHEN 5 THEN 'T1071'
            WHEN 6 THEN 'T1568.002' WHEN 7 THEN 'T1041' WHEN 8 THEN 'T1486' WHEN 9 THEN 'T1568.002' WHEN 10 THEN 'T1566' END AS mitre_technique_id,
  CASE rule WHEN 1 THEN 'Network Service Discovery' WHEN 2 THEN 'Phishing' WHEN 3 THEN 'Exploit Public-Facing Application'
            WHEN 4 THEN 'Brute Force' WHEN 5 THEN 'Application Layer Protocol' WHEN 6 THEN 'T1568.002' WHEN 7 THEN 'T1041'
            WHEN 8 THEN 'Data Encrypted for Impact' WHEN 9 THEN 'Dynamic Resolution: Domain Generation Algorithm'
            WHEN 10 THEN 'Phishing' END AS mitre_technique"""


def mapped(source: str) -> str:
    return f"""
texts AS (SELECT *, lower(concat_ws(' ', alert_type, domain, coalesce(ai_reason, ''), summary)) AS t FROM {source}),
ruled AS (SELECT *, {mitre_rule('t', 'domain')} AS rule FROM texts),
mapped AS (SELECT *, {MITRE_COLUMNS} FROM ruled)"""


INCIDENTS = f"""
incidents AS (
  SELECT seq AS id, organization_id, source_ip, destination_ip, domain, timestamp, alert_type, summary, risk_level,
    recommended_action, status, coalesce(ai_prediction, CASE WHEN risk_level <> 'Low' THEN 'suspicious' ELSE 'normal' END) AS ai_prediction,
    CAST(coalesce(nullif(ai_score, 0), CASE risk_level WHEN 'High' THEN 0.92 WHEN 'Medium' THEN 0.65 ELSE 0.28 END) AS DOUBLE) AS ai_score,
    coalesce(ai_reason, concat('Rule-based detection: ', risk_level, ' risk threat signature identified.')) AS ai_reason,
    attack_category, threat_score, risk_tier, mitre_tactic_id, mitre_tactic, mitre_technique_id, mitre_technique
  FROM mapped)"""

PIPELINE = f"WITH {FLOWS}, {DETECTED}, {BASE}, {PREDICTED}, {MATCHED}, {mapped('matched')}, {INCIDENTS}"
SIMPLE = f"WITH {FLOWS}"
FOUND = f"WITH {FLOWS}, {DETECTED}"


def add(name: str, sql: str) -> None:
    ORACLE_SQL[name] = sql


# --- sources --------------------------------------------------------------------------
PARSED = "organization_id, batch_id, seq, source, timestamp, source_ip, destination_ip, source_port, destination_port, domain, alert_type, protocol, event_type, risk_level, signature_id, category, action"
_KNOWN = "source_ip <> ''"
_N = "CAST(NULL AS VARCHAR)"


def org_file(kind: str) -> str:
    return f"concat('{kind}-', CAST(organization_id AS VARCHAR))"


add("scan_log_lines", f"""{SIMPLE} SELECT CAST(0 AS BIGINT) AS organization_id,
  concat(concat_ws(' , ', timestamp, source_ip, destination_ip, domain, alert_type), CASE WHEN k % 2 = 0 THEN ',tcp' ELSE '' END) AS value
  FROM flows""")

add("route_formats", f"""{SIMPLE}, files AS (
  SELECT organization_id,
    CASE k % 4 WHEN 0 THEN 'eve-' WHEN 1 THEN 'csv-' WHEN 2 THEN 'zeek-conn-' ELSE 'plain-' END || CAST(organization_id AS VARCHAR) AS batch_id,
    CASE k % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'zeek_tsv' ELSE 'plain' END AS route,
    CASE WHEN k % 4 = 3 OR source_ip <> '' THEN 1 ELSE 0 END AS ok FROM flows)
  SELECT organization_id, batch_id, route, CAST(sum(ok) AS BIGINT) AS events FROM files GROUP BY ALL""")

EVE = f"""
eve AS (
  SELECT *, CASE k % 12 WHEN 10 THEN 'dns' WHEN 11 THEN 'flow' WHEN 9 THEN 'http' WHEN 6 THEN 'tls' ELSE 'alert' END AS kind FROM flows),
eve2 AS (
  SELECT *, CASE
      WHEN kind IN ('dns', 'http', 'tls') AND domain <> '' THEN concat(CASE kind WHEN 'dns' THEN 'dns-query' ELSE kind END, ': ', domain)
      WHEN kind = 'flow' THEN concat('flow:', CASE WHEN k % 2 = 0 THEN 'tcp' ELSE 'udp' END)
      WHEN kind = 'alert' THEN alert_type ELSE kind END AS shown,
    CASE WHEN kind = 'dns' THEN domain ELSE '' END AS dns_domain
  FROM eve)"""

add("normalize_eve", f"""{SIMPLE}, {EVE}
  SELECT organization_id, {org_file('eve')} AS batch_id, seq, 'suricata' AS source, timestamp, source_ip, destination_ip,
    CAST(k + 40000 AS VARCHAR) AS source_port, '443' AS destination_port, domain, shown AS alert_type,
    CASE WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol, kind AS event_type,
    CASE WHEN kind = 'alert' AND k % 4 = 1 THEN 'High' WHEN kind = 'alert' AND k % 4 = 2 THEN 'Medium' ELSE 'Low' END AS risk_level,
    CASE WHEN kind = 'alert' THEN CAST(k + 2000000 AS VARCHAR) END AS signature_id,
    CASE WHEN kind = 'alert' THEN alert_type ELSE '' END AS category,
    CASE WHEN kind = 'alert' THEN 'allowed' ELSE '' END AS action
  FROM eve2 WHERE {_KNOWN}""")

ZEEK = f"""
zeek AS (
  SELECT *, CASE k % 6 WHEN 0 THEN 'conn' WHEN 1 THEN 'dns' WHEN 2 THEN 'http' WHEN 3 THEN 'notice' WHEN 4 THEN 'ssl' ELSE 'files' END AS kind,
    CASE k % 4 WHEN 0 THEN 'S0' WHEN 1 THEN 'SF' WHEN 2 THEN 'REJ' ELSE '' END AS state,
    CASE k % 3 WHEN 0 THEN 'Scan::Port_Scan' WHEN 1 THEN 'Weird::Activity' ELSE 'notice' END AS note,
    CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'chain Failure' ELSE 'ok' END AS valid FROM flows),
zeek2 AS (
  SELECT *, CASE kind
      WHEN 'conn' THEN concat('zeek-conn:tcp:', CASE WHEN k % 4 = 0 THEN 'http' ELSE 'unknown' END, ':', state)
      WHEN 'dns' THEN concat('zeek-dns:', CASE WHEN k % 4 = 1 THEN 'AAAA' ELSE 'A' END, ':', domain)
      WHEN 'http' THEN concat('zeek-http:', CASE WHEN k % 4 = 2 THEN 'POST' ELSE 'GET' END, ':200')
      WHEN 'notice' THEN concat('zeek-notice:', note)
      WHEN 'ssl' THEN concat('zeek-ssl:TLSv12:', valid) ELSE 'zeek-files' END AS shown,
    CASE WHEN kind = 'conn' AND state IN ('S0', 'REJ') THEN 'Medium'
         WHEN kind = 'notice' AND note = 'Scan::Port_Scan' THEN 'High' WHEN kind = 'notice' THEN 'Medium'
         WHEN kind = 'ssl' AND valid = 'chain Failure' THEN 'Medium' ELSE 'Low' END AS zrisk
  FROM zeek)"""

add("normalize_zeek_tsv", f"""{SIMPLE}, {ZEEK}
  SELECT organization_id, concat('zeek-', kind, '-', CAST(organization_id AS VARCHAR)) AS batch_id, seq, concat('zeek-', kind) AS source,
    timestamp, source_ip, destination_ip,
    CASE WHEN kind IN ('notice', 'files') THEN NULL ELSE '40000' END AS source_port,
    CASE WHEN kind IN ('notice', 'files') THEN NULL ELSE '443' END AS destination_port,
    domain, shown AS alert_type, CASE kind WHEN 'conn' THEN 'tcp' WHEN 'dns' THEN 'udp' ELSE '' END AS protocol,
    {_N} AS event_type, zrisk AS risk_level, {_N} AS signature_id, {_N} AS category, {_N} AS action
  FROM zeek2 WHERE {_KNOWN}""")

add("zeek_risk", f"""{SIMPLE}, {ZEEK}
  SELECT concat('zeek-', kind) AS source, shown AS alert_type, zrisk AS risk_level, count(*) AS events
  FROM zeek2 WHERE {_KNOWN} GROUP BY ALL""")

add("zeek_log_type", f"""{SIMPLE}, {ZEEK}
  SELECT organization_id, concat('zeek-', kind, '-', CAST(organization_id AS VARCHAR)) AS batch_id, true AS has_zeek_header,
    kind AS zeek_type, count(*) + 3 AS n_lines FROM zeek GROUP BY ALL""")

add("normalize_zeek_json", f"""{SIMPLE}, z AS (
  SELECT *, CASE k % 3 WHEN 1 THEN 'dns' WHEN 2 THEN 'notice' ELSE 'conn' END AS kind,
    CASE WHEN k % 4 <> 0 THEN 'tcp' ELSE '' END AS proto,
    CASE WHEN k % 6 < 3 THEN 'ssl' WHEN k % 6 = 5 THEN 'Scan::Port_Scan' ELSE '' END AS detail FROM flows)
  SELECT organization_id, {org_file('zeek-json')} AS batch_id, seq, concat('zeek-', kind) AS source, timestamp, source_ip, destination_ip,
    {_N} AS source_port, {_N} AS destination_port, domain, concat('zeek-', kind, ':', proto, ':', detail) AS alert_type, proto AS protocol,
    {_N} AS event_type, 'Low' AS risk_level, {_N} AS signature_id, {_N} AS category, {_N} AS action
  FROM z WHERE {_KNOWN}""")


def loose(kind: str, source: str, protocol: str, where: str) -> str:
    return f"""{SIMPLE}
  SELECT organization_id, {org_file(kind)} AS batch_id, seq, '{source}' AS source, timestamp, source_ip, destination_ip,
    {_N} AS source_port, {_N} AS destination_port, domain, alert_type, {protocol} AS protocol,
    {_N} AS event_type, {_N} AS risk_level, {_N} AS signature_id, {_N} AS category, {_N} AS action
  FROM flows WHERE {where}"""


_TCP = "CASE WHEN k % 2 = 0 THEN 'tcp' ELSE '' END"
add("normalize_generic_json", loose("generic", "generic-json", _TCP, _KNOWN))
add("normalize_csv", loose("csv", "csv", _TCP, _KNOWN))
_BROKEN = """CASE WHEN k % 3 = 0 THEN replace(alert_type, ' ', chr(10) || '"x",') ELSE alert_type END AS alert_type"""
add("normalize_spanning_csv", loose("csv", "csv", _TCP, _KNOWN).replace("domain, alert_type", f"domain, {_BROKEN}"))
add("normalize_plain", loose("plain", "plain-text", _TCP, "true"))

add("json_dialect", f"""{SIMPLE}
  SELECT {org_file('eve')} AS batch_id, seq, 'eve' AS dialect FROM flows
  UNION ALL SELECT {org_file('zeek-json')}, seq, 'zeek' FROM flows
  UNION ALL SELECT {org_file('generic')}, seq, CASE WHEN k % 4 = 3 THEN 'zeek' ELSE 'generic' END FROM flows""")

add("json_accept_ratio", f"""{SIMPLE}, t AS (
  SELECT *, k % 10 < CASE organization_id WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 9 END AS is_json FROM flows),
  u AS (SELECT *, NOT is_json AND k % 10 = 9 AS blank FROM t),
  e AS (SELECT organization_id, min(seq) FILTER (NOT blank) AS lo, max(seq) FILTER (NOT blank) AS hi FROM u GROUP BY 1),
  c AS (SELECT {org_file('eve')} AS batch_id, count(*) AS n_lines, count(*) FILTER (is_json AND source_ip <> '') AS n_json,
          count(*) FILTER (NOT is_json AND NOT blank) AS n_corrupt
        FROM u JOIN e USING (organization_id) WHERE seq BETWEEN lo AND hi GROUP BY 1)
  SELECT *, n_json > 0.2 * n_lines AS accepted FROM c""")

# --- predicates and rules -----------------------------------------------------------------
add("first_truthy", f"""{SIMPLE} SELECT seq, CASE WHEN domain <> '' THEN domain WHEN source_ip <> '' THEN source_ip ELSE alert_type END AS value FROM flows""")
add("dns_domain", f"{SIMPLE}, {EVE} SELECT seq, dns_domain FROM eve2")
add("event_domain", f"{SIMPLE}, {EVE} SELECT seq, domain AS event_domain FROM eve2")
add("has_domain", f"{SIMPLE}, {EVE} SELECT seq, domain <> '' AND NOT (kind = 'dns' AND k % 3 = 2) AS has_domain FROM eve2")
add("display_alert", f"{SIMPLE}, {EVE} SELECT seq, shown AS alert_type FROM eve2")
add("relevant_events", f"""{SIMPLE}, {EVE} SELECT {org_file('eve')} AS batch_id, seq FROM eve2
  WHERE kind = 'alert' OR (kind IN ('dns', 'http', 'tls') AND source_ip <> ''
    AND ((domain <> '' AND NOT (kind = 'dns' AND k % 3 = 2)) OR k % 2 = 1))""")
add("valid_endpoints", f"{SIMPLE} SELECT seq, source_ip, destination_ip FROM flows WHERE source_ip <> '' AND destination_ip <> ''")
add("is_private", f"""{SIMPLE}, a AS (SELECT seq, CASE seq % 6 WHEN 0 THEN source_ip WHEN 1 THEN destination_ip
    WHEN 2 THEN concat('172.', CAST(k AS VARCHAR), '.0.1') WHEN 3 THEN concat('fe80::', CAST(k AS VARCHAR))
    WHEN 4 THEN concat('f', CAST(k % 10 AS VARCHAR), '::1') ELSE concat('::', CAST(k AS VARCHAR)) END AS address FROM flows)
  SELECT seq, address, regexp_matches(address, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|127\\.|::1|fe80:|fc|fd)') AS is_private FROM a""")
add("classify_risk", f"""{SIMPLE}, c AS (SELECT *, {risk('hint')} AS risk_level FROM flows WHERE source_ip <> '')
  SELECT seq, organization_id, risk_level, {STATUS} AS status, {ACTION} AS recommended_action FROM c""")
add("incident_summary", f"{FOUND} SELECT seq, risk_level, summary FROM detected")
add("attack_category", f"{SIMPLE} SELECT seq, alert_type, {category()} AS attack_category FROM flows")
_CAT = f"c AS (SELECT seq, k, coalesce({category()}, 'Benign') AS category, CAST(k % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS score FROM flows)"
add("risk_tier", f"""{SIMPLE}, {_CAT} SELECT seq, category, {tier('category')} AS risk_tier,
  CASE {tier('category')} WHEN 1 THEN 'Tier-1 — Low risk: automated response executed'
    WHEN 2 THEN 'Tier-2 — Medium risk: awaiting Analyst approval' ELSE 'Tier-3 — High risk: awaiting Manager approval' END AS description FROM c""")
add("threat_reason", f"{SIMPLE}, {_CAT} SELECT seq, category, {reason('category', 'score')} AS ai_reason FROM c")
add("heuristic_classify", f"WITH {FLOWS}, {BASE} SELECT seq, {heuristic(False)} AS category_raw, {heuristic(True)} AS category_scaled FROM q3")
add("apply_alert_override", f"WITH {FLOWS}, {BASE}, {PREDICTED} SELECT seq, {PREDICTION_COLUMNS} FROM predicted")
add("score_backfill", f"""{FOUND}, s AS (SELECT *, CAST(CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN CAST(k % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS DOUBLE) AS s,
    CASE WHEN k % 2 = 0 THEN 'suspicious' END AS p, CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN 'model reason' END AS r FROM classified)
  SELECT seq, CAST(coalesce(nullif(s, 0), CASE risk_level WHEN 'High' THEN 0.92 WHEN 'Medium' THEN 0.65 ELSE 0.28 END) AS DOUBLE) AS ai_score,
    coalesce(p, CASE WHEN risk_level <> 'Low' THEN 'suspicious' ELSE 'normal' END) AS ai_prediction,
    coalesce(nullif(r, ''), concat('Rule-based detection: ', risk_level, ' risk threat signature identified.')) AS ai_reason FROM s""")
add("map_mitre", f"""WITH {FLOWS}, {DETECTED}, {BASE}, {PREDICTED},
  own AS (SELECT d.*, p.ai_reason FROM detected d JOIN predicted p USING (seq)), {mapped('own')}
  SELECT seq, mitre_tactic_id, mitre_tactic, mitre_technique_id, mitre_technique FROM mapped""")
add("dga_domains", f"""{SIMPLE}, e AS (SELECT seq, domain, {label_entropy('domain')} AS h FROM flows)
  SELECT seq, domain, round(h, 6) AS entropy, length(domain) > 5 AND h > 3.8 AS generated FROM e""")
add("friendly_title", f"""{SIMPLE}, t AS (
    SELECT seq, CASE seq % 4 WHEN 0 THEN alert_type WHEN 1 THEN concat_ws('-', event_type, concat('bAR:x_', CAST(k % 7 AS VARCHAR)))
      WHEN 2 THEN concat('tls: ', domain) ELSE concat('http:', domain) END AS alert_type FROM flows),
  l AS (SELECT *, lower(alert_type) AS a FROM t)
  SELECT seq, alert_type, CASE
    WHEN a LIKE 'dns-query:%' THEN concat('DNS Lookup: ', split_part(alert_type, ': ', 2))
    WHEN a LIKE 'tls:%' THEN concat('Secure Connection: ', split_part(alert_type, ': ', 2))
    WHEN a LIKE 'http:%' THEN concat('Web Request: ', split_part(alert_type, ': ', 2))
    WHEN contains(a, 'flow:tcp') THEN 'TCP Connection' WHEN contains(a, 'port scan') THEN 'Port Scan Detected'
    WHEN contains(a, 'brute') THEN 'Brute Force Attempt' WHEN contains(a, 'exploit') THEN 'Exploit Attempt'
    WHEN contains(a, 'ransomware') THEN 'Ransomware Activity' WHEN regexp_matches(a, 'c2|beacon') THEN 'C2 Beacon Detected'
    WHEN contains(a, 'flood') THEN 'DDoS / Flood Attack'
    ELSE array_to_string(list_transform(string_split(translate(alert_type, '-_:', '   '), ' '),
           lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') END AS title FROM l""")
add("domain_entropy", f"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host FROM pages)
  SELECT page_id, host, round({label_entropy('host')}, 6) AS label_entropy, round({full_entropy('host')}, 6) AS full_entropy FROM h""")
add("payload_entropy", f"{SIMPLE} SELECT seq, round({entropy(PAYLOAD)}, 6) AS payload_entropy FROM flows")
add("extract_port", f"""{SIMPLE}, t AS (SELECT seq, concat(alert_type, ' (', CAST(k * 997 AS VARCHAR), ') :', CAST(seq AS VARCHAR), '/ x80') AS text FROM flows)
  SELECT seq, text, CAST(coalesce(list_filter(list_transform(string_split(text, ' '), lambda w: TRY_CAST(trim(w, ':,/()') AS BIGINT)),
    lambda p: p BETWEEN 1 AND 65535)[1], 443) AS INTEGER) AS port FROM t""")

# --- joins --------------------------------------------------------------------------------
add("first_match_join", f"WITH {FLOWS}, {DETECTED}, {BASE}, {PREDICTED}, {MATCHED} SELECT seq, {PREDICTION_COLUMNS} FROM matched")
_DAILY = "incoming AS (SELECT * REPLACE (substr(timestamp, 1, 10) AS timestamp) FROM detected), stored AS (SELECT * FROM incoming WHERE event_type = 'view')"
_SAME = "s.organization_id = i.organization_id AND s.source_ip = i.source_ip AND s.destination_ip = i.destination_ip AND s.timestamp = i.timestamp AND s.alert_type = i.alert_type"
add("dedup_incidents", f"""{FOUND}, {_DAILY} SELECT seq, organization_id, source_ip, destination_ip, timestamp, alert_type
  FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE {_SAME})""")
add("ingest_result", f"""{FOUND}, {_DAILY}, f AS (SELECT i.organization_id, EXISTS (SELECT 1 FROM stored s WHERE {_SAME}) AS dup FROM incoming i)
  SELECT organization_id, count(*) FILTER (NOT dup) AS incidents_found, count(*) FILTER (dup) AS duplicates_skipped FROM f GROUP BY 1""")
add("tenant_directory", f"""{PIPELINE}
  SELECT CAST(n_nationkey AS BIGINT) AS organization_id, n_name AS organization_name,
    (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members,
    (SELECT count(*) FROM incidents WHERE organization_id = n_nationkey) AS incidents FROM nation""")

# --- aggregates -----------------------------------------------------------------------------
add("incident_stats", f"""{FOUND} SELECT organization_id, count(*) AS total, count(*) FILTER (risk_level = 'High') AS high,
  count(*) FILTER (risk_level = 'Medium') AS medium, count(*) FILTER (risk_level = 'Low') AS low, count(*) FILTER (status = 'Active') AS active,
  count(*) FILTER (status = 'Monitoring') AS monitoring, count(*) FILTER (status = 'Cleared') AS cleared FROM detected GROUP BY 1""")
_TACTICS = "'Reconnaissance','Resource Development','Initial Access','Execution','Persistence','Privilege Escalation','Defense Evasion','Credential Access','Discovery','Lateral Movement','Collection','Command and Control','Exfiltration','Impact'"
add("mitre_heatmap", f"""{PIPELINE}, cells AS (SELECT CAST(i - 1 AS INTEGER) AS position, [{_TACTICS}][i] AS tactic FROM range(1, 15) r(i)),
  c AS (SELECT position, tactic, (SELECT count(*) FROM incidents WHERE mitre_tactic = tactic) AS incidents FROM cells)
  SELECT *, round(CAST(incidents AS DOUBLE) / greatest(max(incidents) OVER (), 1), 6) AS intensity FROM c""")
add("risk_timeline", f"""{PIPELINE}, d AS (SELECT substr(timestamp, 1, 10) AS day, count(*) FILTER (risk_level = 'High') AS high,
    count(*) FILTER (risk_level = 'Medium') AS medium, count(*) FILTER (risk_level = 'Low') AS low, count(*) AS total
    FROM incidents GROUP BY 1 ORDER BY day DESC LIMIT 10)
  SELECT *, round(CAST(total AS DOUBLE) / max(total) OVER () * 100, 6) AS height_pct, round(CAST(high AS DOUBLE) / total * 100, 6) AS high_pct,
    round(CAST(medium AS DOUBLE) / total * 100, 6) AS medium_pct, round(CAST(low AS DOUBLE) / total * 100, 6) AS low_pct FROM d""")
add("metric_rollup", """WITH s AS (SELECT event_type AS name, CASE event_id % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' ELSE 'timer' END AS kind,
    value, ts, event_id FROM events)
  SELECT kind, name, round(sum(value) FILTER (kind = 'counter'), 4) AS total,
    first(value ORDER BY ts DESC, event_id DESC) FILTER (kind = 'gauge') AS last_value,
    count(*) FILTER (kind = 'timer') AS timer_count, round(avg(value) FILTER (kind = 'timer'), 4) AS avg_ms,
    min(value) FILTER (kind = 'timer') AS min_ms, max(value) FILTER (kind = 'timer') AS max_ms FROM s GROUP BY kind, name""")
add("class_distribution", """SELECT quality AS label, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM labels), 6) AS percent
  FROM labels GROUP BY 1""")
add("balanced_weights", """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
  SELECT doc_id, quality AS label, round(CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n), 6) AS weight
  FROM labels JOIN c USING (quality)""")
add("classification_report", """WITH k AS (SELECT quality AS c FROM labels UNION SELECT toxic FROM labels),
  m AS (SELECT c, (SELECT count(*) FROM labels WHERE quality = c) AS support, (SELECT count(*) FROM labels WHERE toxic = c) AS predicted,
          (SELECT count(*) FROM labels WHERE quality = c AND toxic = c) AS tp FROM k),
  r AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / support END AS r FROM m),
  f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM r)
  SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
  UNION ALL SELECT 'accuracy', round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
add("member_roles", """SELECT CAST(c_nationkey AS BIGINT) AS organization_id, c_custkey AS user_id,
  CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 1 THEN 'ADMIN' ELSE 'ANALYST' END AS role FROM customer""")
add("stratified_split", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i,
    floor(CAST(count(*) OVER (PARTITION BY quality) AS DOUBLE) * CAST(0.15 AS DOUBLE) + 0.5) AS held FROM labels)
  SELECT doc_id, quality, CASE WHEN i < held THEN 'test' WHEN i < 2 * held THEN 'validation' ELSE 'train' END AS split FROM r""")

# --- windows --------------------------------------------------------------------------------
_STREAM = "stream AS (SELECT * RENAME (seq AS event_id), row_number() OVER (PARTITION BY organization_id ORDER BY seq) - 1 AS seq FROM flows)"
add("ip_diversity", f"""{SIMPLE}, {_STREAM}, w AS (SELECT event_id, organization_id, seq, coalesce(list(source_ip) OVER w, []) AS s, coalesce(list(destination_ip) OVER w, []) AS d
    FROM stream WINDOW w AS (PARTITION BY organization_id ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  SELECT event_id, organization_id, seq, CAST(len(list_distinct(list_concat(s, d))) AS DOUBLE) AS ip_diversity FROM w""")
add("port_diversity", f"""{SIMPLE} SELECT seq, CAST(least(row_number() OVER (PARTITION BY organization_id, batch_id ORDER BY seq) - 1, 20) AS DOUBLE) AS port_diversity FROM flows""")
add("event_sequences", f"""{SIMPLE}, b AS (SELECT organization_id, 'all' AS batch_id, k, row_number() OVER (PARTITION BY organization_id ORDER BY seq) - 1 AS i FROM flows
    UNION ALL SELECT organization_id, batch_id, k, row_number() OVER (PARTITION BY organization_id, batch_id ORDER BY seq) - 1 FROM flows),
  s AS (SELECT organization_id, batch_id, i // 20 AS seq_id, count(*) AS real_steps, sum(k) AS total, min(k) FILTER (i % 20 = 0) AS first_value,
      coalesce(min(k) FILTER (i % 20 = 19), 0) AS last_value FROM b GROUP BY ALL)
  SELECT organization_id, batch_id, CAST(seq_id AS BIGINT) AS seq_id, real_steps, CAST(20 AS BIGINT) AS length, CAST(total AS DOUBLE) AS total,
    CAST(first_value AS DOUBLE) AS first_value, CAST(last_value AS DOUBLE) AS last_value FROM s WHERE real_steps = 20 OR seq_id = 0""")
_CLASSES = "['Benign','DoS-Hulk','PortScan','DDoS','DoS-GoldenEye','FTP-Patator','SSH-Patator','Bot','Web-BruteForce','Infiltration','Heartbleed','Ransomware']"
add("sequence_majority", f"""{SIMPLE}, {_STREAM}, l AS (SELECT organization_id, seq // 20 AS seq_id,
    CAST(list_position({_CLASSES}, coalesce({category()}, 'Benign')) - 1 AS INTEGER) AS label FROM stream),
  c AS (SELECT organization_id, seq_id, label, count(*) AS votes, sum(count(*)) OVER (PARTITION BY organization_id, seq_id) AS rows_in,
      row_number() OVER (PARTITION BY organization_id, seq_id ORDER BY count(*) DESC, label) AS rn FROM l GROUP BY 1, 2, 3)
  SELECT organization_id, CAST(seq_id AS BIGINT) AS seq_id, label, votes FROM c WHERE rn = 1 AND rows_in = 20""")

# --- incident reads and changes ---------------------------------------------------------------
add("detect_incidents", f"{PIPELINE} SELECT * FROM incidents")
add("tenant_incidents", f"{PIPELINE} SELECT * EXCLUDE (organization_id) FROM incidents WHERE organization_id = 1")
add("facet_filter", f"{PIPELINE} SELECT id, risk_level, status FROM incidents WHERE lower(risk_level) = 'monitoring' OR lower(status) = 'monitoring'")
add("search_incidents", f"""{PIPELINE} SELECT id, alert_type, domain, mitre_tactic FROM incidents
  WHERE contains(source_ip, 'c2') OR contains(destination_ip, 'c2') OR contains(lower(alert_type), 'c2') OR contains(lower(domain), 'c2')
    OR contains(lower(coalesce(mitre_tactic, '')), 'c2')""")
add("latest_incidents", f"{PIPELINE} SELECT id, alert_type, risk_level FROM incidents ORDER BY id DESC LIMIT 50")
add("apply_status_changes", f"""{PIPELINE}, ch AS (
    SELECT CAST(user_id % 3 AS BIGINT) AS organization_id, event_id + d AS id, CASE event_type WHEN 'click' THEN 'Approved' ELSE 'Rejected' END AS new_status, ts
    FROM events, (VALUES (0), (1)) v(d) WHERE event_type IN ('click', 'view') AND user_id % 5 <> 0),
  last AS (SELECT organization_id, id, new_status FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, id ORDER BY ts DESC) AS rn FROM ch) WHERE rn = 1)
  SELECT i.id, i.organization_id, coalesce(new_status, status) AS status FROM incidents i LEFT JOIN last USING (organization_id, id)""")
ORACLE_SQL["stored_status_changes"] = ORACLE_SQL["apply_status_changes"]
add("purge_tenant", f"{PIPELINE} SELECT id, organization_id, alert_type FROM incidents WHERE organization_id <> 2")
_DOUBLE = "═" * 70
_RULE = "─" * 70


def _report_section(number: int, name: str, title: str) -> str:
    return f"""
  UNION ALL SELECT {number}, NULL, 0, '{_RULE}'
  UNION ALL SELECT {number}, NULL, 1, concat('{title} (', CAST(n_{name} AS VARCHAR), ')') FROM n
  UNION ALL SELECT {number}, NULL, 2, '{_RULE}'
  UNION ALL SELECT {number}, NULL, 3 + i, ['  None', ''][CAST(i + 1 AS INTEGER)] FROM n, range(0, 2) r(i) WHERE n_{name} = 0"""


_REPORT_LINES = """['  Incident #' || CAST(id AS VARCHAR), '  Time      : ' || timestamp, '  Alert     : ' || alert_type,
    '  Source IP : ' || source_ip, '  Dest IP   : ' || destination_ip, '  Domain    : ' || coalesce(nullif(domain, ''), 'N/A'),
    '  Status    : ' || status, '  MITRE     : ' || coalesce(mitre_tactic || ' (' || mitre_tactic_id || ')', 'N/A'),
    '  AI Score  : ' || printf('%.4f', ai_score), '  Summary   : ' || summary, '  Action    : ' || recommended_action, '']"""
add("daily_report", f"""{PIPELINE}, today AS (SELECT * FROM incidents WHERE substr(timestamp, 1, 10) = '2024-01-03'),
  n AS (SELECT count(*) AS total, count(*) FILTER (risk_level = 'High') AS n_high, count(*) FILTER (risk_level = 'Medium') AS n_medium,
          count(*) FILTER (risk_level = 'Low') AS n_low FROM today),
  lines AS (
  SELECT 0 AS section, CAST(NULL AS BIGINT) AS neg_id, i AS line_no,
    ['{_DOUBLE}', '  NETWORK ACTIVITY REPORT', '  Date       : 2024-01-03', '{_DOUBLE}', '', 'SUMMARY',
     '  Total Incidents Today : ' || CAST(total AS VARCHAR), '  High Risk             : ' || CAST(n_high AS VARCHAR),
     '  Medium Risk           : ' || CAST(n_medium AS VARCHAR), '  Low Risk              : ' || CAST(n_low AS VARCHAR), ''][CAST(i + 1 AS INTEGER)] AS line
  FROM n, range(0, 11) r(i)
  {_report_section(1, 'high', 'HIGH RISK INCIDENTS')} {_report_section(2, 'medium', 'MEDIUM RISK INCIDENTS')} {_report_section(3, 'low', 'LOW RISK INCIDENTS')}
  UNION ALL SELECT 4, NULL, i, ['{_DOUBLE}', '  END OF REPORT', '{_DOUBLE}'][CAST(i + 1 AS INTEGER)] FROM range(0, 3) r(i)
  UNION ALL SELECT CASE risk_level WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, -id, i, {_REPORT_LINES}[CAST(i + 1 AS INTEGER)]
    FROM today, range(0, 12) r(i))
  SELECT CAST(section AS INTEGER) AS section, neg_id, CAST(line_no AS INTEGER) AS line_no, line FROM lines""")
add("alert_feed", f"""{PIPELINE} SELECT organization_id, id AS incident_id, 'incident_created' AS event,
  CAST(to_json({{'incident_id': id, 'source_ip': source_ip, 'destination_ip': destination_ip, 'alert_type': alert_type, 'risk_level': risk_level,
    'timestamp': timestamp, 'mitre_tactic': mitre_tactic, 'mitre_technique': mitre_technique, 'attack_category': attack_category,
    'threat_score': threat_score, 'risk_tier': risk_tier}}) AS VARCHAR) AS payload FROM incidents""")

# --- features ---------------------------------------------------------------------------------
add("flow_features", f"WITH {FLOWS}, {BASE} SELECT seq, "
    + ", ".join(f"round(CAST({f} AS DOUBLE), 6) AS {n}" for n, (f, _, _) in FEATURES.items()) + " FROM q3")
add("robust_zscore", f"WITH {FLOWS}, {BASE} SELECT seq, " + ", ".join(f"round({z(n)}, 6) AS {n}" for n in FEATURES) + " FROM q3")

# --- sinks and streams --------------------------------------------------------------------------
add("incident_sink", f"{PIPELINE} SELECT *, substr(timestamp, 1, 10) AS event_day FROM incidents")
_EVE_RISK = "CASE WHEN kind = 'alert' AND k % 4 = 1 THEN 'High' WHEN kind = 'alert' AND k % 4 = 2 THEN 'Medium' ELSE 'Low' END"
_RELEVANT = """source_ip <> '' AND (kind = 'alert' OR (kind IN ('dns', 'http', 'tls')
  AND ((domain <> '' AND NOT (kind = 'dns' AND k % 3 = 2)) OR k % 2 = 1)))"""
add("stream_tail", f"""{SIMPLE}, {EVE} SELECT timestamp, source_ip, destination_ip, domain, shown AS alert_type, kind AS event_type,
  {_EVE_RISK} AS risk_level FROM eve2 WHERE {_RELEVANT}""")
add("stream_detect", f"""{SIMPLE}, {EVE}, live AS (SELECT * REPLACE (shown AS alert_type, {_EVE_RISK} AS hint) FROM eve2 WHERE {_RELEVANT}),
  judged AS (SELECT *, {risk('hint')} AS risk_level FROM live)
  SELECT source_ip, destination_ip, domain, timestamp, alert_type, risk_level, {STATUS} AS status FROM judged
  WHERE risk_level <> 'Low' OR domain <> ''""")
ORACLE_SQL["stream_grow"] = ORACLE_SQL["stream_tail"]
add("stream_dedup", f"{SIMPLE} SELECT DISTINCT source_ip, destination_ip, timestamp, alert_type FROM flows WHERE source_ip <> ''")
ORACLE_SQL["stream_timeline"] = ORACLE_SQL["risk_timeline"]
add("raw_events", f"""{SIMPLE}
  SELECT {org_file('csv')} AS batch_id, seq, concat_ws(',', timestamp, source_ip, destination_ip, domain, '"' || alert_type || '"', {_TCP}) AS raw
  FROM flows WHERE {_KNOWN}
  UNION ALL SELECT concat('zeek-conn-', CAST(organization_id AS VARCHAR)), seq,
    concat_ws(chr(9), timestamp, source_ip, '40000', destination_ip, '443', 'tcp', CASE WHEN k % 4 = 0 THEN 'http' ELSE '-' END,
              ['S0', 'SF', 'REJ', '-'][k % 4 + 1], CASE WHEN domain = '' THEN '-' ELSE domain END)
  FROM flows WHERE k % 6 = 0 AND {_KNOWN}
  UNION ALL SELECT {org_file('plain')}, seq, concat_ws(' , ', timestamp, source_ip, destination_ip, domain, alert_type) || CASE WHEN k % 2 = 0 THEN ',tcp' ELSE '' END
  FROM flows""")
add("model_checks", f"""{SIMPLE}
  SELECT organization_id, count(*) AS scored, CAST(0 AS BIGINT) AS wrong_tiers, CAST(0 AS BIGINT) AS wrong_verdicts, CAST(0 AS BIGINT) AS wrong_reasons,
    CAST(0 AS BIGINT) AS wrong_scores, CAST(0 AS BIGINT) AS missed_alerts, CAST(0 AS BIGINT) AS loaded_differs,
    CAST(count(*) - CASE WHEN count(*) < 20 THEN 0 ELSE count(*) % 20 END AS BIGINT) AS windowed, count(*) AS clean_vectors, count(*) AS split_rows
  FROM flows GROUP BY organization_id""")
