"""Fixed values that results depend on."""

# Word -> (likelihood when malicious, likelihood when safe), in order of declaration.
LIKELIHOODS = (
    ("UNION", 0.80, 0.0010), ("SELECT", 0.85, 0.0500), ("UNION ALL", 0.90, 0.0005), ("OR 1=1", 0.95, 0.0001),
    ("OR '1'='1", 0.95, 0.0001), ("SLEEP", 0.60, 0.0100), ("BENCHMARK(", 0.88, 0.0002), ("WAITFOR DELAY", 0.92, 0.0001),
    ("INFORMATION_SCHEMA", 0.93, 0.0002), ("GROUP_CONCAT", 0.85, 0.0010), ("XP_CMDSHELL", 0.96, 0.0001), ("DROP", 0.40, 0.0200),
    ("INSERT", 0.50, 0.0500), ("UPDATE", 0.50, 0.0500), ("SCRIPT", 0.70, 0.0200), ("ALERT(", 0.80, 0.0010),
    ("ONERROR", 0.85, 0.0010), ("ONLOAD", 0.75, 0.0050), ("<IMG", 0.60, 0.0300), ("<SVG", 0.80, 0.0020),
    ("JAVASCRIPT:", 0.82, 0.0020), ("DOCUMENT.COOKIE", 0.94, 0.0001), ("PROMPT(", 0.78, 0.0020), ("/ETC/PASSWD", 0.90, 0.0001),
    ("/ETC/SHADOW", 0.95, 0.0001), ("../../", 0.88, 0.0020), ("..%2F", 0.92, 0.0001), ("%2E%2E%2F", 0.92, 0.0001),
    ("/PROC/SELF", 0.90, 0.0002), ("BOOT.INI", 0.88, 0.0002), ("/BIN/SH", 0.90, 0.0005), ("/BIN/BASH", 0.88, 0.0010),
    (";CAT ", 0.85, 0.0010), ("|CAT ", 0.85, 0.0010), ("$(", 0.55, 0.0300), ("CHMOD ", 0.60, 0.0100),
    ("${JNDI:", 0.97, 0.0001), ("{{7*7}}", 0.95, 0.0001), ("<%=", 0.70, 0.0050), ("SQLMAP", 0.96, 0.0001),
    ("NIKTO", 0.95, 0.0001), ("ACUNETIX", 0.95, 0.0001), ("NESSUS", 0.93, 0.0002), ("MASSCAN", 0.90, 0.0002),
    ("ROOT", 0.30, 0.0800), ("ADMIN", 0.40, 0.1000),
)
WEAK_WORDS = ("ROOT", "ADMIN")
PRIORS = (0.10, 0.90)

# Kind -> technique id, name, tactic, tactic id, severity, base score, engine.
TECHNIQUES = (
    ("ddos", "T1498", "Network Denial of Service", "Impact", "TA0040", "CRITICAL", 8.5, "Z-Score (statistical)"),
    ("scan", "T1046", "Network Service Discovery", "Discovery", "TA0007", "MEDIUM", 5.0, "KNN (behavioural)"),
    ("sqli", "T1190", "Exploit Public-Facing Application", "Initial Access", "TA0001", "HIGH", 9.0, "Naive Bayes (payload)"),
    ("xss", "T1059.007", "Command and Scripting Interpreter: JavaScript", "Execution", "TA0002", "HIGH", 7.5, "Naive Bayes (payload)"),
    ("lfi", "T1083", "File and Directory Discovery", "Discovery", "TA0007", "HIGH", 7.0, "Naive Bayes (payload)"),
    ("payload", "T1190", "Exploit Public-Facing Application", "Initial Access", "TA0001", "HIGH", 8.0, "Naive Bayes (payload)"),
    ("blacklist", "T1071", "Application Layer Protocol (known-bad infrastructure)", "Command and Control", "TA0011", "HIGH", 7.5, "Bloom Filter (reputation)"),
    ("anomaly", "T1071", "Anomalous Traffic Profile (behavioural drift)", "Command and Control", "TA0011", "MEDIUM", 4.5, "K-Means (clustering)"),
    ("unknown", "N/A", "Uncategorised Observation", "Unknown", "N/A", "INFO", 1.0, "n/a"),
)
KIND_GROUPS = {"sqli": "payload", "xss": "payload", "lfi": "payload", "payload": "payload"}

# Payload families, patterns in the order they are tried (any case).
FAMILIES = (("sqli", r"UNION|SELECT|OR 1=1|SLEEP|DROP|INSERT|UPDATE"), ("xss", r"SCRIPT|ALERT\(|ONERROR|<IMG"), ("lfi", r"/ETC/PASSWD|\.\./|/PROC/SELF"))

# Redaction, pattern and replacement in order; $1 is the first group.
REDACTIONS = (
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL_REDACTED]"),
    (r"\b(?:\d[ \-]?){13,16}\b", "[CARD_REDACTED]"),
    (r"(?i)\b(pass(?:word|wd)?|pwd)\s*=\s*[^&\s\"']+", "$1=[REDACTED]"),
    (r"(?i)\b(api[_\-]?key|token|secret|session[_\-]?id|auth)\s*[=:]\s*[^&\s\"']+", "$1=[REDACTED]"),
    (r"(?i)(authorization|cookie|set-cookie)\s*:\s*[^\r\n]+", "$1: [REDACTED]"),
    (r"(?i)\b[A-Z]{2}\d{6}[A-D]\b", "[NINO_REDACTED]"),
)

# Label spellings.
NORMAL_LABELS = ("normal", "benign", "0", "background", "safe")
SCAN_LABELS = ("scan", "portscan", "port_scan", "recon", "reconnaissance")
MALICIOUS_LABELS = ("malicious", "sqli", "xss", "lfi", "rce", "payload")
ATTACK_LABELS = ("ddos", "dos", "flood", "synflood", "udpflood", "attack", "malicious", "1", "anomaly")

# Seed rows of the scan classifier (unique ports, packets, label) and first centroids (pps, ports).
KNN_SEED = ((1, 5, "Normal"), (5, 25, "Normal"), (10, 50, "Normal"), (15, 80, "Normal"), (1, 800, "Normal"), (2, 2000, "Normal"), (3, 6000, "Normal"), (1, 15000, "Normal"), (30, 40, "Scan"), (50, 60, "Scan"), (100, 200, "Scan"), (500, 1000, "Scan"))
CENTROIDS = ((10.0, 2.0), (200.0, 5.0), (20.0, 50.0))

PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}
TCP_FLAGS = ((0x01, "FIN"), (0x02, "SYN"), (0x04, "RST"), (0x08, "PSH"), (0x10, "ACK"), (0x20, "URG"))
REPLAY_BLACKLIST = ("192.168.1.200", "10.0.0.66")

#: Letters and digits (hexadecimal ranges) of Unicode 14 and later, which Java 17's classes do not know.
NEWER_LETTERS = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a "
    "1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 "
    "11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb "
    "1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb "
    "1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
)
#: Letters that the SQL engine's upper leaves alone though they have an upper case in newer tables of Unicode.
CASELESS = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
