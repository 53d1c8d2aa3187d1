"""Lookup tables, word lists, weights and formats that decide results. Data only, no logic."""

# Platforms and required fields of an event.
PLATFORMS = ["windows", "linux", "network", "file", "unknown"]
REQUIRED_FIELDS = ["event_id", "timestamp", "platform", "source"]

# Field lengths kept by sanitising.
MAX_SOURCE, MAX_PAYLOAD, MAX_ACTOR, MAX_DESCRIPTION = 256, 4096, 256, 512

# Windows event id -> (description, severity, technique, tactic).
WINDOWS_EVENTS = {
    1102: ("Security audit log cleared", 10, "T1070", "defense-evasion"),
    4624: ("Successful logon", 2, "T1078", "defense-evasion"),
    4625: ("Failed logon attempt", 6, "T1110", "credential-access"),
    4688: ("New process created", 4, "T1059", "execution"),
    4697: ("Service installed in system", 9, "T1543", "persistence"),
    4698: ("Scheduled task created", 8, "T1053", "persistence"),
    4720: ("User account created", 7, "T1136", "persistence"),
    4726: ("User account deleted", 7, "T1531", "impact"),
    4728: ("User added to global security group", 8, "T1098", "persistence"),
    4732: ("User added to local security group", 7, "T1098", "persistence"),
    4740: ("User account locked out", 7, "T1110", "credential-access"),
    4756: ("Member added to universal security group", 8, "T1098", "persistence"),
    4767: ("User account unlocked", 5, "T1531", "impact"),
    4776: ("Credential validation attempt", 5, "T1110", "credential-access"),
    4800: ("Workstation locked", 2, "T1078", "defense-evasion"),
    4801: ("Workstation unlocked", 2, "T1078", "defense-evasion"),
    5140: ("Network share object accessed", 5, "T1039", "collection"),
    5145: ("Network share object access checked", 4, "T1039", "collection"),
    7045: ("New service installed on system", 9, "T1543", "persistence"),
}

# Windows event ids worth collecting.
MONITORED_IDS = [
    1102, 4624, 4625, 4634, 4647, 4648, 4672, 4688, 4697, 4698, 4702, 4719, 4720, 4722, 4723, 4724, 4725, 4726, 4728,
    4732, 4740, 4756, 4767, 4776, 5140, 5145, 7045,
]

# Windows event id ranges -> event type, first match wins.
WINDOWS_TYPES = [
    (4624, 4634, "auth"), (4688, 4699, "process"), (7045, 7045, "config"), (1102, 1102, "config"),
    (5140, 5145, "network"), (4720, 4767, "config"),
]

# Linux keywords -> (type, severity, description, technique, tactic), first match wins.
LINUX_PATTERNS = [
    (["failed password", "authentication failure", "invalid user"],
     "auth", 6, "Failed SSH authentication attempt", "T1110", "credential-access"),
    (["accepted password", "accepted publickey", "session opened for user"],
     "auth", 2, "Successful SSH authentication", "T1078", "defense-evasion"),
    (["sudo:", "sudo "], "process", 5, "Sudo command executed", "T1548", "privilege-escalation"),
    (["useradd", "adduser", "new user"], "config", 8, "New user account created", "T1136", "persistence"),
    (["userdel", "deluser"], "config", 7, "User account deleted", "T1531", "impact"),
    (["cron", "crond"], "process", 4, "Cron job executed", "T1053", "persistence"),
    (["connection refused", "port scan", "nmap"],
     "network", 7, "Potential port scan or connection probe detected", "T1046", "discovery"),
    (["kernel", "segfault", "oom-killer"], "system", 6, "Kernel or system-level event", "", ""),
    (["passwd", "chpasswd", "password changed"], "config", 6, "Password change event", "T1098", "persistence"),
]

# Linux lines that carry no security value.
NOISE_PATTERNS = [
    "last message repeated", "cron[", "systemd-logind", "pam_unix(cron", "session opened for user root by (uid=0)",
    "session closed for user root", "ntpd[", "rsyslogd", "dbus-daemon",
]

# Linux log files read by default.
LINUX_LOG_FILES = ["auth.log", "secure", "syslog", "messages", "kern.log", "audit.log", "cron", "faillog"]

# Syslog severity 0..7 -> event severity; anything else 2.
SYSLOG_SEVERITY = [10, 9, 8, 7, 5, 3, 2, 1]
SYSLOG_SEVERITY_DEFAULT = 2

# Cisco mnemonic parts -> (type, severity), first match wins; else network, 5.
CISCO_MNEMONICS = [
    (["SEC-LOGIN", "AAA"], "auth", 7), (["OSPF", "BGP"], "network", 4), (["ACL", "DENY"], "network", 6),
    (["CONFIG"], "config", 7), (["LINK", "LINEPROTO"], "network", 5),
]

# Actors that are service accounts (regular expressions, any case).
SERVICE_ACTORS = [
    "^svc_", "^service_", "^_", "^\\$", "SYSTEM$", "LOCAL SERVICE$", "NETWORK SERVICE$", "^NT AUTHORITY",
]

# Event ids with a role in detection.
FAILED_LOGON, LOGON, LOG_CLEARED, ACCOUNT_CREATED, TASK_CREATED = 4625, 4624, 1102, 4720, 4698
SERVICE_INSTALLED = [7045, 4697]
GROUP_ADD = [4728, 4732, 4756]
CRITICAL_IDS = [1102, 7045, 4697, 4720, 4728, 4732, 4698]

# Severity name -> score.
SEVERITY_SCORE = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 5, "LOW": 3, "INFO": 1}
# Lower bounds of severity names in reports, and of risk labels.
SEVERITY_BANDS = [(9, "CRITICAL"), (7, "HIGH"), (5, "MEDIUM"), (3, "LOW")]
RISK_BANDS = [(80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM"), (20, "LOW")]

# Risk added per observation, ceiling, and decay per idle hour.
RISK = {
    "auth_failure": 3.0, "new_host_access": 5.0, "audit_log_cleared": 40.0, "new_service": 15.0,
    "new_account_created": 20.0, "group_membership_change": 15.0, "scheduled_task_created": 10.0,
    "high_severity": 5.0, "after_hours_access": 8.0, "stale_account_active": 20.0, "lateral_movement": 30.0,
}
RISK_CEILING, RISK_DECAY_PER_HOUR = 100.0, 2.0

# Rule level -> (severity, score); unknown levels count as medium.
SIGMA_LEVELS = {
    "critical": ("CRITICAL", 10), "high": ("HIGH", 7), "medium": ("MEDIUM", 5), "low": ("LOW", 3),
    "informational": ("INFO", 1),
}

# Rule field name -> event column.
SIGMA_FIELDS = {
    "EventID": "raw_event_id", "EventId": "raw_event_id", "event_id": "raw_event_id", "Severity": "severity",
    "SubjectUserName": "actor", "TargetUserName": "actor", "IpAddress": "actor", "SourceIp": "actor",
    "WorkstationName": "source", "ComputerName": "source", "Computer": "source", "Hostname": "source",
    "DestinationIp": "target", "Description": "description", "Platform": "platform",
    "CommandLine": "raw_payload", "NewProcessName": "raw_payload", "ParentProcessName": "raw_payload",
    "Image": "raw_payload", "ServiceName": "raw_payload", "ServiceFileName": "raw_payload",
    "DestinationPort": "raw_payload", "Channel": "raw_payload", "Provider_Name": "raw_payload",
    "LogonType": "raw_payload", "FailureReason": "raw_payload", "Message": "raw_payload", "Facility": "raw_payload",
}
