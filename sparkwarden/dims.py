"""Static dimensions: rules, chains and texts.

All of these are fixed values: they have to be equal to the documented rule set for results to be right.
They are plain Python lists here and become small DataFrames or literals where they are used; callers may pass
their own rule or chain tables instead.
"""

from __future__ import annotations

# Severities, highest rank first.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}

# rule_id, position in the order of checks, name, severity, MITRE technique, description, recommendation.
RULES = [
    ("R001", 1, "SSH Brute Force", "HIGH", "T1110",
     "Multiple failed SSH login attempts from the same source IP.",
     "Temporarily block the source IP and review authentication logs."),
    ("R002", 2, "Successful Login After Failures", "CRITICAL", "T1110.001",
     "A successful login occurred shortly after multiple failed attempts, indicating potential credential compromise.",
     "Reset affected credentials immediately. Block source IP. Enable MFA. Review subsequent activity."),
    ("R003", 3, "Invalid User Login Attempt", "MEDIUM", "T1078",
     "Authentication attempt for a user account that does not exist on the system.",
     "Monitor for repeated attempts. Consider blocking source IP if persistent."),
    ("R004", 4, "Root Login Attempt", "HIGH", "T1078.003",
     "Direct login attempt to the root account detected.",
     "Disable direct root login. Review SSH configuration. Investigate source IP."),
    ("R005", 5, "Privilege Escalation", "HIGH", "T1548",
     "A user escalated privileges via sudo or su command.",
     "Verify the user is authorized for privilege escalation. Review executed commands."),
    ("R006", 6, "SQL Injection Attempt", "CRITICAL", "T1190",
     "SQL injection patterns detected in HTTP request path or parameters.",
     "Block source IP. Review web application firewall rules. Audit application input validation."),
    ("R007", 7, "Directory Traversal", "HIGH", "T1083",
     "Path traversal sequences detected in HTTP request, attempting to access files outside the web root.",
     "Block source IP. Validate and sanitize all file path inputs in the application."),
    ("R008", 8, "Suspicious User Agent", "HIGH", "T1595",
     "HTTP request from a known security scanning tool or attack framework.",
     "Block source IP. Review all requests from this user agent for further indicators."),
    ("R009", 14, "Port Scan Detected", "HIGH", "T1046",
     "Multiple connection attempts to different ports from the same source IP.",
     "Block source IP at the firewall. Review network logs for additional reconnaissance."),
    ("R010", 9, "Firewall Block", "INFO", None,
     "Firewall blocked an incoming connection attempt.",
     "Monitor for persistent blocked attempts from the same source."),
    ("R011", 10, "Kernel Panic", "CRITICAL", None,
     "Critical kernel error or panic detected. System stability may be compromised.",
     "Investigate system logs immediately. Check for hardware issues or kernel exploits."),
    ("R012", 11, "Disk Full", "HIGH", None,
     "Disk space exhaustion detected. Services may fail or become unavailable.",
     "Free disk space immediately. Investigate potential log-flooding attacks."),
    ("R013", 12, "Service Crash", "MEDIUM", None,
     "A system service terminated unexpectedly or failed to start.",
     "Restart the affected service. Review service logs for root cause."),
    ("R014", 1, "Multiple Authentication Failures", "MEDIUM", "T1110",
     "Repeated authentication failures detected across the system.",
     "Review source IPs and usernames involved. Consider temporary lockout policies."),
    ("R015", 13, "Excessive 404 Errors", "MEDIUM", "T1595.002",
     "High volume of HTTP 404 responses from the same source IP, indicating directory enumeration.",
     "Block source IP. Review web server access logs for enumeration patterns."),
]
RULE_COLUMNS = "rule_id string, rule_ord int, name string, severity string, mitre string, description string, recommendation string"
RULE_ORD = {r[0]: r[1] for r in RULES}
RULE_MITRE = {r[0]: r[4] for r in RULES}

# Rules decided by one line alone: rule_id, pattern of the message (case-insensitive), and words of which all
# of at least one group must be in the message for the pattern to match. The words spare most lines the pattern.
LINE_RULES = [
    ("R003", r"invalid user", [["invalid user"]]),
    ("R004", r"failed password for root", [["failed password for root"]]),
    ("R005", r"(sudo|su).*?(COMMAND|session opened)", [["su", "command"], ["su", "session opened"]]),
    ("R006", r"(union\s+select|or\s+1\s*=\s*1|drop\s+table|select\s+.*from|insert\s+into|delete\s+from|update\s+.*set|;\s*--|'--)",
     [["union", "select"], ["or", "1", "="], ["drop", "table"], ["select", "from"], ["insert", "into"], ["delete", "from"],
      ["update", "set"], [";", "--"], ["'--"]]),
    ("R007", r"\.\./|\.\.\\|etc/passwd|etc/shadow", [["../"], ["..\\"], ["etc/passwd"], ["etc/shadow"]]),
    ("R008", r"(sqlmap|nikto|nmap|masscan|dirbuster|gobuster|wfuzz|hydra|medusa)",
     [["sqlmap"], ["nikto"], ["nmap"], ["masscan"], ["dirbuster"], ["gobuster"], ["wfuzz"], ["hydra"], ["medusa"]]),
    ("R010", r"(UFW\s+BLOCK|iptables.*DROP|DENIED|firewall.*block)",
     [["ufw", "block"], ["iptables", "drop"], ["denied"], ["firewall", "block"]]),
    ("R011", r"kernel:?.*(panic|oops|BUG|segfault|critical)", [["kernel"]]),
    ("R012", r"(no space left|disk full|filesystem.*full)", [["no space left"], ["disk full"], ["filesystem", "full"]]),
    ("R013", r"(segfault|core dump|failed.*start|exited.*error|terminated|abort)",
     [["segfault"], ["core dump"], ["failed", "start"], ["exited", "error"], ["terminated"], ["abort"]]),
]
FAILED_PASSWORD = r"failed password"
ACCEPTED_PASSWORD = r"accepted password"
NOT_FOUND = r"→\s*404\b"

# Incident types by scenario: scenario, position, type, severity.
SCENARIOS = [
    ("brute_force", 1, "Brute Force Attack", "HIGH"),
    ("account_compromise", 2, "Account Compromise", "CRITICAL"),
    ("web_recon", 3, "Web Reconnaissance", "HIGH"),
    ("priv_esc", 4, "Privilege Escalation Sequence", "HIGH"),
    ("service_fail", 5, "Repeated Service Failure", "MEDIUM"),
]

# Attack chains: id, name, stages in order, objective.
CHAINS = [
    ("credential_compromise", "Credential Compromise Campaign",
     ["recon", "brute_force", "credential_success", "privilege_escalation", "persistence"],
     "Gain persistent privileged access via credential compromise"),
    ("web_attack", "Web Application Attack Campaign",
     ["recon", "enumeration", "exploitation", "data_access", "exfiltration"],
     "Exploit web application vulnerabilities for data access"),
    ("service_disruption", "Service Disruption Campaign",
     ["probing", "resource_exhaustion", "service_crash", "denial_of_service"],
     "Disrupt service availability"),
]
# Chain and stage by incident type, and by rule.
CHAIN_OF_TYPE = {
    "Brute Force Attack": ("credential_compromise", "brute_force"),
    "Account Compromise": ("credential_compromise", "credential_success"),
    "Privilege Escalation Sequence": ("credential_compromise", "privilege_escalation"),
    "Web Reconnaissance": ("web_attack", "enumeration"),
    "Repeated Service Failure": ("service_disruption", "service_crash"),
}
CHAIN_OF_RULE = {
    "R001": ("credential_compromise", "brute_force"),
    "R014": ("credential_compromise", "brute_force"),
    "R002": ("credential_compromise", "credential_success"),
    "R003": ("credential_compromise", "recon"),
    "R004": ("credential_compromise", "brute_force"),
    "R005": ("credential_compromise", "privilege_escalation"),
    "R008": ("web_attack", "recon"),
    "R015": ("web_attack", "enumeration"),
    "R007": ("web_attack", "enumeration"),
    "R006": ("web_attack", "exploitation"),
    "R010": ("service_disruption", "probing"),
    "R013": ("service_disruption", "service_crash"),
}
# Score of a chain stage; any other stage scores 30.
STAGE_SCORE = {
    "recon": 20, "brute_force": 40, "enumeration": 35, "credential_success": 70, "exploitation": 75,
    "privilege_escalation": 85, "data_access": 90, "persistence": 95, "exfiltration": 100,
    "probing": 15, "resource_exhaustion": 50, "service_crash": 60, "denial_of_service": 70,
}

# Recommendations by incident type.
RECOMMENDATIONS = {
    "Brute Force Attack": [
        "Block the source IP address at the firewall.",
        "Review authentication logs for the affected system.",
        "Enforce account lockout policies after repeated failures.",
        "Enable multi-factor authentication (MFA) for all user accounts.",
        "Consider deploying an intrusion prevention system (IPS).",
    ],
    "Account Compromise": [
        "Disable the compromised account immediately.",
        "Reset credentials for the affected user.",
        "Block the source IP address.",
        "Enable MFA on the affected account.",
        "Review all activity from the source IP and affected user.",
        "Check for lateral movement or data exfiltration.",
        "Notify the account owner through a secure channel.",
    ],
    "Web Reconnaissance": [
        "Block the source IP at the web application firewall.",
        "Review all HTTP requests from the source IP.",
        "Ensure directory listing is disabled on the web server.",
        "Verify no sensitive files are publicly accessible.",
        "Update web application firewall rules to detect enumeration patterns.",
    ],
    "Privilege Escalation Sequence": [
        "Verify the user is authorized for the executed commands.",
        "Review all commands executed under elevated privileges.",
        "Check for unauthorized changes to system configuration.",
        "Audit sudoers configuration for overly permissive rules.",
        "Investigate the timeline leading to the escalation.",
    ],
    "Repeated Service Failure": [
        "Restart the affected service and monitor stability.",
        "Review service logs for the root cause of crashes.",
        "Check for resource exhaustion (memory, CPU, disk).",
        "Investigate whether the failures are caused by malicious input.",
        "Consider enabling automatic crash recovery.",
    ],
}
DEFAULT_RECOMMENDATIONS = [
    "Investigate the source of the activity.",
    "Review related logs for additional context.",
    "Monitor the affected system for further anomalies.",
    "Document findings and escalate if necessary.",
]
URGENT = {
    "CRITICAL": "URGENT: Escalate to senior analyst immediately.",
    "HIGH": "Prioritize investigation of this incident.",
}

# Structured recommendations by incident type: action, priority, reason, impact.
SMART_RECOMMENDATIONS = {
    "Brute Force Attack": [
        ("Block source IP at perimeter firewall", "CRITICAL", "Stop ongoing brute-force attempts immediately",
         "Eliminates current attack vector; attacker must change source"),
        ("Enable account lockout after 5 failed attempts", "HIGH",
         "Prevent credential guessing by rate-limiting authentication",
         "Reduces brute-force success probability by 95%+"),
        ("Deploy multi-factor authentication (MFA)", "HIGH",
         "Even compromised passwords become insufficient for access",
         "Neutralizes brute-force as an attack vector entirely"),
        ("Review SSH configuration for key-only authentication", "MEDIUM",
         "Disable password authentication to eliminate attack surface",
         "Removes password guessing as a viable attack method"),
        ("Deploy fail2ban or equivalent IPS", "MEDIUM", "Automate IP blocking after repeated failures",
         "Reduces analyst workload and speeds response time"),
    ],
    "Account Compromise": [
        ("Disable compromised account immediately", "CRITICAL",
         "Prevent further unauthorized access with stolen credentials",
         "Stops active exploitation; attacker loses access"),
        ("Reset password and revoke all active sessions", "CRITICAL",
         "Invalidate compromised credentials across all services",
         "Forces attacker re-authentication which will fail"),
        ("Block attacker IP at network perimeter", "HIGH",
         "Prevent the attacker from attempting other accounts",
         "Disrupts attacker infrastructure targeting this network"),
        ("Audit all activity from compromised account", "HIGH",
         "Determine scope of compromise and data exposure",
         "Identifies lateral movement and data exfiltration"),
        ("Check for lateral movement to other systems", "HIGH",
         "Compromised credentials may have been used on other hosts",
         "Detects broader compromise before damage escalates"),
        ("Notify account owner via secure channel", "MEDIUM",
         "User may have additional context about unauthorized access",
         "Enables user-side investigation and password hygiene"),
    ],
    "Web Reconnaissance": [
        ("Block scanner IP at WAF/firewall", "HIGH", "Stop active enumeration before exploitation phase",
         "Prevents attacker from completing attack surface mapping"),
        ("Review all HTTP requests from scanner IP", "HIGH",
         "Identify if any probed paths returned sensitive data",
         "Determines if any information was already exposed"),
        ("Disable directory listing on web server", "MEDIUM",
         "Reduce information leakage from automated scanning",
         "Limits attacker's ability to discover hidden endpoints"),
        ("Update WAF rules to detect enumeration patterns", "MEDIUM",
         "Automate blocking of directory scanning tools",
         "Reduces future reconnaissance success rate"),
    ],
    "Privilege Escalation Sequence": [
        ("Verify user authorization for executed commands", "CRITICAL",
         "Determine if escalation was legitimate or malicious", "Confirms or rules out active compromise"),
        ("Review complete sudo history for the user", "HIGH",
         "Identify all commands executed with elevated privileges",
         "Reveals scope of potential system modification"),
        ("Audit sudoers configuration", "HIGH", "Check for overly permissive privilege grants",
         "Hardens privilege boundaries to prevent future abuse"),
        ("Search for signs of lateral movement", "MEDIUM",
         "Privilege escalation often precedes lateral movement", "Detects broader compromise early"),
    ],
    "Repeated Service Failure": [
        ("Restart affected service and monitor stability", "HIGH",
         "Restore service availability while investigating root cause",
         "Minimizes service downtime for legitimate users"),
        ("Analyze service logs for crash root cause", "HIGH",
         "Determine if crashes are due to malicious input or bug",
         "Enables targeted fix instead of repeated restarts"),
        ("Check for resource exhaustion (CPU, memory, disk)", "MEDIUM",
         "Resource starvation is a common DoS technique", "Identifies infrastructure-level countermeasures"),
        ("Enable automatic crash recovery with rate limiting", "MEDIUM",
         "Reduce manual intervention for service recovery",
         "Improves service resilience and reduces downtime"),
    ],
}
DEFAULT_SMART_RECOMMENDATIONS = [
    ("Investigate the source of activity", "HIGH", "Determine if activity is malicious or legitimate",
     "Enables appropriate response action"),
    ("Review related logs for additional context", "MEDIUM", "Single events may miss broader attack patterns",
     "Provides complete picture for accurate assessment"),
    ("Document findings and escalate if necessary", "MEDIUM",
     "Maintain audit trail for compliance and future reference", "Supports incident response process"),
]
SMART_URGENT = ("URGENT: Escalate to senior analyst and incident commander", "CRITICAL",
                "Critical severity requires immediate senior oversight",
                "Ensures fastest possible containment with expert guidance")
SMART_CHAIN_IMPACT = "Stopping the chain now prevents objective completion"

# Names of techniques.
TECHNIQUES = {
    "T1110": "Brute Force (Credential Access)",
    "T1110.001": "Password Guessing",
    "T1110.003": "Password Spraying",
    "T1078": "Valid Accounts (Defense Evasion)",
    "T1548": "Abuse Elevation Control Mechanism",
    "T1548.003": "Sudo and Sudo Caching",
    "T1595": "Active Scanning (Reconnaissance)",
    "T1190": "Exploit Public-Facing Application",
    "T1059": "Command and Scripting Interpreter",
    "T1046": "Network Service Scanning",
    "T1498": "Network Denial of Service",
    "T1499": "Endpoint Denial of Service",
}
UNKNOWN_TECHNIQUE = "Unknown Technique"

# Services looked for in timeline texts.
TIMELINE_SERVICES = ["apache", "httpd", "mysql", "nginx", "sshd", "sudo"]

# File names that count as logs besides the suffix .log.
LOG_NAMES = ["syslog", "auth.log", "kern.log", "messages", "nginx_access.log", "apache_access.log"]
