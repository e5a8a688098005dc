"""SQL for DuckDB, one statement per named query, over the same given tables.

Common table expressions build the chain independently of the Spark code: the order-dependent rules by a recursive query
per source, windows by integer ranges, merging by a recursive query over the list of pairs.
"""

from __future__ import annotations

from sparkwarden import dims


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else _q(v) for v in r) + ")" for r in rows)


WS = r"[\s\x0b]"
BSD = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
ACCESS = (r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"(\w+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(?:\d+|-)'
          r'(?:\s+"[^"]*"\s+"([^"]*)")?')
IP = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _user(text: str) -> str:
    a = f"regexp_extract({text}, '(?:for|user)\\s+(?:invalid\\s+user\\s+)?(\\S+)', 1)"
    return (f"CASE WHEN {a} <> '' AND {a} NOT IN ('port','from','on','to') THEN {a} "
            f"ELSE nullif(regexp_extract({text}, 'by\\s+(\\S+)', 1), '') END")


def _type(service: str, message: str) -> str:
    s, m = f"lower({service})", f"lower({message})"
    return f"""CASE WHEN {_any(s, ['sshd', 'pam', 'login', 'su', 'sudo'])} THEN 'Authentication'
      WHEN {_any(s, ['ufw', 'iptables', 'firewalld'])} THEN 'Firewall' WHEN {_any(s, ['kernel'])} THEN 'Kernel'
      WHEN {_any(s, ['systemd', 'cron', 'anacron'])} THEN 'System' WHEN {_any(s, ['apache', 'nginx', 'httpd'])} THEN 'Web Server'
      WHEN {_any(m, ['network', 'interface'])} THEN 'Network'
      WHEN {_any(m, ['password', 'authentication', 'login', 'session'])} THEN 'Authentication'
      WHEN {_any(m, ['blocked', 'denied', 'drop', 'reject'])} THEN 'Firewall' ELSE 'System' END"""


def _severity(message: str) -> str:
    m = f"lower({message})"
    return f"""CASE WHEN {_any(m, ['panic', 'oops', 'critical', 'emergency'])} THEN 'CRITICAL'
      WHEN {_any(m, ['failed password', 'authentication failure', 'invalid user', 'error', 'not allowed'])} THEN 'MEDIUM'
      WHEN {_any(m, ['warning', 'disk full', 'no space'])} THEN 'HIGH'
      WHEN {_any(m, ['accepted', 'session opened', 'started', 'loaded'])} THEN 'INFO' ELSE 'LOW' END"""


def _http(status: str, path: str, agent: str) -> str:
    p, a = f"lower({path})", f"lower({agent})"
    return f"""CASE WHEN {_any(a, ['sqlmap', 'nikto', 'nmap', 'masscan', 'dirbuster'])} THEN 'HIGH'
      WHEN contains({path}, '../') OR contains({p}, 'etc/passwd') THEN 'HIGH'
      WHEN {_any(p, ['union', 'select', 'drop', '1=1', 'or+1'])} THEN 'CRITICAL'
      WHEN {status} >= 500 THEN 'HIGH' WHEN {status} IN (401, 403) THEN 'MEDIUM' WHEN {status} = 404 THEN 'LOW' ELSE 'INFO' END"""


CTES: dict[str, str] = {}

CTES["lines"] = r"""
 SELECT event_id AS seq, CASE
  WHEN event_id % 997 = 0 THEN bsd || ' prod-01 kernel: [452.1] Kernel panic - not syncing'
  WHEN event_id % 991 = 0 THEN bsd || ' prod-01 app[9]: write failed: No space left on device'
  ELSE CASE event_type
  WHEN 'error' THEN bsd || ' prod-01 sshd[' || pid || ']: Failed password for ' || CASE WHEN event_id % 11 = 0 THEN 'root'
     WHEN user_id % 7 = 0 THEN 'invalid user ' || acct ELSE acct END || ' from ' || CASE WHEN event_id % 7 = 3 THEN 'gateway' ELSE ip END || ' port 22 ssh2'
  WHEN 'purchase' THEN bsd || ' prod-01 sshd[' || pid || ']: Accepted password for ' || acct || ' from ' || ip || ' port 22 ssh2'
  WHEN 'view' THEN ip || ' - - [' || strftime(t, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET ' ||
     CASE WHEN event_id % 17 = 0 THEN '/../../etc/passwd' WHEN event_id % 19 = 0 THEN '/login?x=admin''--'
          ELSE '/p' || (event_id % 40) END || ' HTTP/1.1" 404 200 "-" "' ||
     CASE WHEN event_id % 13 = 0 THEN 'sqlmap/1.7.10' ELSE 'Mozilla/5.0' END || '"'
  WHEN 'click' THEN bsd || ' prod-01 kernel: [UFW BLOCK] IN=eth0 OUT= SRC=' || CASE WHEN event_id % 2000 < 200 THEN '10.2.0.9' ELSE ip END || ' DST=192.168.1.10 PROTO=TCP SPT=40000 DPT='
     || (20 + event_id % 60)
  ELSE CASE WHEN event_id % 2 = 0
     THEN bsd || ' prod-01 su[' || pid || ']: pam_unix(su:session): session opened for user root by ' || acct
     ELSE bsd || ' prod-01 svc' || (user_id % 3) || '[77]: worker segfault at 0' END END END AS value
 FROM (SELECT *, CASE WHEN event_id // 1000 % 4 = 3 THEN '10.1.' || (event_id // 1000 % 250) || '.' || (user_id % 2 + 1) ELSE '10.0.0.' || (user_id % 5 + 1) END AS ip, (1000 + event_id % 9000) AS pid, 'acct' || CASE WHEN event_id // 1000 % 4 = 3 THEN event_id // 1000 % 20 ELSE user_id % 20 END AS acct,
         strftime(t, '%b %d %H:%M:%S') AS bsd
       FROM (SELECT event_id, user_id, event_type, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id // 5) AS t FROM events))"""

CTES["matched"] = f"""
 SELECT seq, value, CASE WHEN regexp_matches(value, {_q(BSD)}) THEN 'auth' WHEN regexp_matches(value, {_q(ACCESS)}) THEN 'apache_access'
   ELSE 'unknown' END AS log_format FROM lines"""


def _g(pattern: str, i: int) -> str:
    return f"regexp_extract(value, {_q(pattern)}, {i})"


CTES["fields"] = f"""
 SELECT seq, value, log_format,
   CASE WHEN log_format = 'auth' THEN strptime('2024 ' || regexp_replace({_g(BSD, 1)}, '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S')
        ELSE strptime(split_part({_g(ACCESS, 3)}, ' ', 1), '%d/%b/%Y:%H:%M:%S') END AS ts,
   CASE WHEN log_format = 'auth' THEN {_g(BSD, 2)} ELSE 'webserver' END AS hostname,
   CASE WHEN log_format = 'auth' THEN {_g(BSD, 3)} ELSE 'apache' END AS service,
   CASE WHEN log_format = 'auth' THEN {_g(BSD, 4)} ELSE 'httpd' END AS process,
   CASE WHEN log_format = 'auth' THEN {_g(BSD, 5)}
        ELSE {_g(ACCESS, 4)} || ' ' || {_g(ACCESS, 5)} || ' → ' || {_g(ACCESS, 6)} || ' [' || substr({_g(ACCESS, 7)}, 1, 60) || ']' END AS message,
   {_g(ACCESS, 1)} AS web_ip, {_g(ACCESS, 2)} AS web_user, {_g(ACCESS, 5)} AS path, {_g(ACCESS, 6)} AS status, {_g(ACCESS, 7)} AS agent
 FROM matched"""

CTES["entries"] = f"""
 SELECT seq, md5('events#' || seq) AS event_id, ts, epoch(ts)::BIGINT AS t, hostname,
   CASE WHEN log_format = 'auth' THEN nullif(regexp_extract(message, {_q(IP)}, 1), '') ELSE web_ip END AS source_ip,
   CASE WHEN log_format = 'auth' THEN {_user('message')} WHEN web_user <> '-' THEN web_user END AS username,
   service, process,
   CASE WHEN log_format = 'auth' THEN {_type('service', 'message')} ELSE 'Web Server' END AS event_type,
   message, value AS raw_log,
   CASE WHEN log_format = 'auth' THEN {_severity('message')} ELSE {_http("try_cast(status AS INT)", 'path', 'agent')} END AS severity,
   log_format, path
 FROM fields"""

CTES["rules"] = f"SELECT * FROM ({_values(dims.RULES)}) r(rule_id, ord, name, severity, mitre, description, recommendation)"

CTES["line_hits"] = " UNION ALL ".join(
    f"SELECT seq, '{rule}' AS rule_id, 1::BIGINT AS n FROM entries WHERE regexp_matches(message, {_q('(?i)' + pattern)})"
    for rule, pattern, _ in dims.LINE_RULES)

CTES["auth"] = """
 SELECT *, row_number() OVER (PARTITION BY ip ORDER BY t, seq) AS rn FROM (
  SELECT seq, t, coalesce(source_ip, 'unknown') AS ip, regexp_matches(message, '(?i)failed password') AS failed,
         regexp_matches(message, '(?i)accepted password') AS login FROM entries) WHERE failed OR login"""

CTES["fold"] = """
 SELECT ip, 0::BIGINT AS rn, -1::BIGINT AS seq, [0::BIGINT][2:] AS kept, NULL::VARCHAR AS rule_id, 0::BIGINT AS n
 FROM (SELECT DISTINCT ip FROM auth)
 UNION ALL
 SELECT ip, rn, seq, CASE WHEN failed THEN grown WHEN len(kept) >= 3 THEN [0::BIGINT][2:] ELSE kept END,
   CASE WHEN failed THEN CASE WHEN len(grown) >= 5 THEN 'R001' WHEN len(grown) >= 3 THEN 'R014' END
        WHEN len(kept) >= 3 THEN 'R002' END,
   CASE WHEN failed THEN len(grown) ELSE len(kept) + 1 END::BIGINT
 FROM (SELECT f.ip, a.rn, a.seq, a.failed, f.kept, list_append(list_filter(f.kept, lambda x: x > a.t - 60), a.t) AS grown
       FROM fold f JOIN auth a ON a.ip = f.ip AND a.rn = f.rn + 1)"""

CTES["misses"] = """
 SELECT seq, 'R015' AS rule_id, n FROM (
  SELECT seq, row_number() OVER (PARTITION BY ip ORDER BY t, seq)
    - count(*) OVER (PARTITION BY ip ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 30 PRECEDING) AS n
  FROM (SELECT seq, t, coalesce(source_ip, 'unknown') AS ip FROM entries WHERE regexp_matches(message, '→\\s*404\\b')))
 WHERE n >= 10"""

CTES["hits"] = """
 SELECT h.seq, h.rule_id, r.ord, h.n FROM (SELECT * FROM line_hits UNION ALL SELECT seq, rule_id, n FROM fold WHERE rule_id IS NOT NULL
   UNION ALL SELECT * FROM misses) h JOIN rules r USING (rule_id)"""

CTES["alerts"] = """
 SELECT e.event_id || '-' || h.rule_id AS alert_id, h.seq, e.t, e.ts, h.rule_id, h.ord, r.name AS rule_name, r.severity, e.source_ip,
   e.username, e.event_id, r.mitre, h.n AS event_count, e.severity AS entry_severity, e.log_format,
   CASE h.rule_id WHEN 'R001' THEN 'SSH brute force: ' || h.n || ' failed login attempts from ' || coalesce(e.source_ip, 'unknown') || ' in 60 seconds.'
     WHEN 'R014' THEN 'Multiple authentication failures: ' || h.n || ' from ' || coalesce(e.source_ip, 'unknown') || '.'
     WHEN 'R002' THEN 'Successful login from ' || coalesce(e.source_ip, 'unknown') || ' after ' || (h.n - 1) || ' failed attempts. Possible credential compromise.'
     WHEN 'R015' THEN 'Excessive 404 errors: ' || h.n || ' from ' || coalesce(e.source_ip, 'unknown') || ' in 30 seconds. Possible directory enumeration.'
     ELSE r.description END AS description, r.recommendation
 FROM hits h JOIN entries e USING (seq) JOIN rules r USING (rule_id)"""

CTES["per_entry"] = """
 SELECT seq, list(rule_id ORDER BY ord) AS rules, list(n ORDER BY ord) AS counts, count(*) AS alert_n,
   count(DISTINCT mitre) AS mitre_n FROM (SELECT h.*, r.mitre FROM hits h JOIN rules r USING (rule_id)) GROUP BY seq"""

CTES["bf"] = """
 SELECT seq, t, ip, row_number() OVER (PARTITION BY ip ORDER BY t, seq)
   - count(*) OVER (PARTITION BY ip ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 61 PRECEDING) AS n
 FROM (SELECT DISTINCT a.seq, a.t, coalesce(a.source_ip, 'unknown') AS ip FROM alerts a WHERE rule_id IN ('R001', 'R014'))"""

CTES["web"] = """
 SELECT seq, t, ip, sum(is_first) OVER (PARTITION BY ip ORDER BY t, seq)::BIGINT AS n FROM (
  SELECT seq, t, ip, (row_number() OVER (PARTITION BY ip, word ORDER BY t, seq) = 1)::INT AS is_first FROM (
   SELECT e.seq, e.t, coalesce(e.source_ip, 'unknown') AS ip,
     CASE WHEN len(w) < 2 THEN '' WHEN w[1] IN ('GET','POST','PUT','DELETE','HEAD') THEN w[2] ELSE w[1] END AS word
   FROM (SELECT *, string_split_regex(trim(message), '\\s+') AS w FROM entries) e LEFT JOIN per_entry p USING (seq)
   WHERE e.event_type = 'Web Server' OR list_has_any(p.rules, ['R006','R007','R008','R015'])))"""

CTES["crash"] = """
 SELECT seq, service, row_number() OVER (PARTITION BY service ORDER BY t, seq)
   - count(*) OVER (PARTITION BY service ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 61 PRECEDING) AS n
 FROM (SELECT h.seq, e.t, coalesce(nullif(e.service, ''), 'unknown') AS service FROM hits h JOIN entries e USING (seq) WHERE rule_id = 'R013')"""

CTES["raw_updates"] = """
 SELECT 'brute_force' AS scenario, 1 AS ord, 'Brute Force Attack' AS incident_type, 'HIGH' AS severity, ip AS subject, seq, n FROM bf WHERE n >= 5
 UNION ALL
 SELECT 'account_compromise', 2, 'Account Compromise', 'CRITICAL', coalesce(a.source_ip, 'unknown'), a.seq, coalesce(b.n, 0)
 FROM alerts a ASOF LEFT JOIN bf b ON coalesce(a.source_ip, 'unknown') = b.ip AND a.seq >= b.seq WHERE a.rule_id = 'R002'
 UNION ALL SELECT 'web_recon', 3, 'Web Reconnaissance', 'HIGH', ip, seq, n FROM web WHERE n >= 20
 UNION ALL SELECT 'priv_esc', 4, 'Privilege Escalation Sequence', 'HIGH', coalesce(username, 'unknown'), seq, 1 FROM alerts WHERE rule_id = 'R005'
 UNION ALL SELECT 'service_fail', 5, 'Repeated Service Failure', 'MEDIUM', service, seq, n FROM crash WHERE n >= 3"""

CTES["updates"] = """
 SELECT u.scenario || ':' || u.subject AS incident_key, u.incident_type, u.severity, u.ord, u.subject, u.n::BIGINT AS n, u.seq, e.t, e.ts, e.event_id,
   e.source_ip, e.username, e.hostname, e.service, e.process, e.event_type, e.severity AS entry_severity, e.message, e.raw_log,
   e.log_format, coalesce(p.rules, []) AS rules, coalesce(p.counts, []) AS counts, coalesce(p.alert_n, 0) AS alert_n, coalesce(p.mitre_n, 0) AS mitre_n,
   CASE u.ord WHEN 1 THEN 'Failed login attempt #' || u.n || ' from ' || u.subject
     WHEN 2 THEN 'Successful login from ' || u.subject || ' after ' || u.n || ' failed attempts'
     WHEN 3 THEN 'Web enumeration: ' || u.n || ' unique paths probed by ' || u.subject
     WHEN 4 THEN 'Privilege escalation by user ' || u.subject
     ELSE 'Service ''' || u.subject || ''' crashed ' || u.n || ' times in 60s' END AS description
 FROM raw_updates u JOIN entries e USING (seq) LEFT JOIN per_entry p USING (seq)"""

CTES["inc_rules"] = """
 SELECT incident_key, list(rule_id ORDER BY pos1, ord) AS rules FROM (
  SELECT incident_key, rule_id, min(seq) AS pos1, any_value(r.ord) AS ord
  FROM (SELECT incident_key, seq, unnest(rules) AS rule_id FROM updates) u JOIN rules r USING (rule_id) GROUP BY ALL) GROUP BY ALL"""

CTES["inc_mitre"] = """
 SELECT incident_key, list(mitre ORDER BY pos1, ord) AS mitre FROM (
  SELECT incident_key, mitre, min(pos1) AS pos1, arg_min(ord, pos1 * 100 + ord) AS ord FROM (
   SELECT incident_key, rule_id, min(seq) AS pos1 FROM (SELECT incident_key, seq, unnest(rules) AS rule_id FROM updates) GROUP BY ALL)
  JOIN rules USING (rule_id) WHERE mitre IS NOT NULL GROUP BY incident_key, mitre) GROUP BY ALL"""

CTES["sources"] = """
 SELECT incident_key, source_ip, min(seq) AS first_seq FROM updates WHERE source_ip <> '' GROUP BY ALL"""

CTES["timeline"] = """
 SELECT incident_key, incident_type, seq, ts, 0 AS sub, event_type, description, entry_severity AS severity FROM updates
 UNION ALL SELECT incident_key, incident_type, seq, ts, 1, 'Critical', 'Critical Incident Created — Possible Account Compromise', 'CRITICAL'
 FROM updates WHERE incident_type = 'Account Compromise'"""

CTES["inc"] = """
 SELECT b.*, coalesce(r.rules, []) AS rules, coalesce(m.mitre, []) AS mitre, coalesce(s.ips, []) AS ips, len(coalesce(s.ips, [])) AS ip_count,
   date_diff('second', first_seen, last_seen) AS d,
   CASE ord WHEN 1 THEN 'Detected ' || n || ' failed authentication attempts from ' || subject || ' within a 60-second window, exceeding the threshold of 5.'
     WHEN 2 THEN 'Source IP ' || subject || ' made ' || n || ' failed login attempts before successfully authenticating. This pattern strongly indicates a brute-force credential compromise.'
     WHEN 3 THEN 'Source IP ' || subject || ' probed ' || n || ' unique paths within 30 seconds, indicating systematic web reconnaissance.'
     WHEN 4 THEN 'User ''' || subject || ''' performed privilege escalation. Investigating whether this follows a recent login or is part of a lateral movement.'
     ELSE 'Service ''' || subject || ''' failed ' || n || ' times within 60 seconds. This may indicate a denial-of-service condition or a persistent bug.' END AS why
 FROM (SELECT incident_key, incident_type, severity, ord, subject, count(*) AS events, sum(alert_n)::BIGINT AS alerts, min(ts) AS first_seen,
         max(ts) AS last_seen, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(n, seq) AS n,
         arg_max(username, seq) FILTER (username <> '') AS target_user
       FROM updates GROUP BY ALL) b
 LEFT JOIN inc_rules r USING (incident_key) LEFT JOIN inc_mitre m USING (incident_key)
 LEFT JOIN (SELECT incident_key, list(source_ip ORDER BY first_seq) AS ips FROM sources GROUP BY ALL) s USING (incident_key)"""


def _confidence(events: str, delta: str, severity: str, signals: str) -> str:
    """In hundredths, rounded half to even at one decimal."""
    h = f"""((CASE WHEN {events} <= 1 THEN 10 WHEN {events} <= 3 THEN 30 WHEN {events} <= 5 THEN 50 WHEN {events} <= 10 THEN 70
        WHEN {events} <= 20 THEN 85 ELSE 100 END) * 30
      + (CASE WHEN {events} < 2 THEN 20 WHEN {delta} <= 0 THEN 100 WHEN {events} >= {delta} THEN 100 WHEN {events} * 2 >= {delta} THEN 85
        WHEN {events} * 10 >= {delta} THEN 60 WHEN {events} * 100 >= {delta} THEN 40 ELSE 20 END) * 25
      + (CASE {severity} WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 80 WHEN 'MEDIUM' THEN 55 WHEN 'LOW' THEN 30 ELSE 15 END) * 25
      + (CASE WHEN {signals} >= 6 THEN 100 WHEN {signals} >= 4 THEN 80 WHEN {signals} >= 2 THEN 55 ELSE 25 END) * 20)"""
    return f"""(({h} // 10) + CASE WHEN {h} % 10 > 5 OR ({h} % 10 = 5 AND ({h} // 10) % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE"""


CTES["first_updates"] = f"""
 SELECT incident_key, min(seq) AS admitted_seq FROM (
  SELECT *, {_confidence('1', '0', 'severity', 'len(rules) + mitre_n + (CASE WHEN source_ip IS NOT NULL THEN 1 ELSE 0 END)')} AS conf FROM (
   SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY seq) AS rn
   FROM updates))
 WHERE CASE WHEN incident_type = 'Repeated Service Failure' THEN rn >= 3 WHEN rn = 1 THEN conf >= 40 AND len(rules) > 1 ELSE TRUE END
 GROUP BY ALL"""

# Written out here, apart from the tables that the Spark code reads.
CTES["chain_defs"] = """
 SELECT * FROM (VALUES
  ('credential_compromise', 'Credential Compromise Campaign', ['recon', 'brute_force', 'credential_success', 'privilege_escalation', 'persistence'],
   'Gain persistent privileged access via credential compromise'),
  ('web_attack', 'Web Application Attack Campaign', ['recon', 'enumeration', 'exploitation', 'data_access', 'exfiltration'],
   'Exploit web application vulnerabilities for data access'),
  ('service_disruption', 'Service Disruption Campaign', ['probing', 'resource_exhaustion', 'service_crash', 'denial_of_service'],
   'Disrupt service availability')) d(chain, chain_name, stages, objective)"""

# The attacker key, the chain and the stage of an incident after each of its updates, by plain running windows. A chain takes
# an incident by its type or by a rule triggered so far; the first such chain counts, and there the type before the rule.
CTES["keyed"] = """
 SELECT incident_key, incident_type, seq, ord, attacker, chain, CASE chain
   WHEN 'credential_compromise' THEN CASE incident_type WHEN 'Brute Force Attack' THEN 'brute_force' WHEN 'Account Compromise' THEN 'credential_success'
     WHEN 'Privilege Escalation Sequence' THEN 'privilege_escalation' ELSE CASE r1 WHEN 'R002' THEN 'credential_success' WHEN 'R003' THEN 'recon'
     WHEN 'R005' THEN 'privilege_escalation' ELSE 'brute_force' END END
   WHEN 'web_attack' THEN CASE WHEN incident_type = 'Web Reconnaissance' THEN 'enumeration' ELSE CASE r2 WHEN 'R008' THEN 'recon' WHEN 'R006' THEN 'exploitation'
     ELSE 'enumeration' END END
   WHEN 'service_disruption' THEN CASE WHEN incident_type = 'Repeated Service Failure' OR r3 = 'R013' THEN 'service_crash' ELSE 'probing' END END AS stage
 FROM (SELECT *, CASE WHEN incident_type IN ('Brute Force Attack', 'Account Compromise', 'Privilege Escalation Sequence') OR r1 IS NOT NULL THEN 'credential_compromise'
   WHEN incident_type = 'Web Reconnaissance' OR r2 IS NOT NULL THEN 'web_attack' WHEN incident_type = 'Repeated Service Failure' OR r3 IS NOT NULL THEN 'service_disruption' END AS chain
  FROM (SELECT incident_key, incident_type, seq, ord,
    concat_ws(':', first_value(source_ip IGNORE NULLS) OVER w, last_value(username IGNORE NULLS) OVER w) AS attacker,
    first_value(list_filter(rules, lambda r: r IN ('R001', 'R014', 'R002', 'R003', 'R004', 'R005'))[1] IGNORE NULLS) OVER w AS r1,
    first_value(list_filter(rules, lambda r: r IN ('R008', 'R015', 'R007', 'R006'))[1] IGNORE NULLS) OVER w AS r2,
    first_value(list_filter(rules, lambda r: r IN ('R010', 'R013'))[1] IGNORE NULLS) OVER w AS r3
   FROM updates WINDOW w AS (PARTITION BY incident_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""

CTES["seen_stages"] = """
 SELECT chain, attacker, stage, min(seq * 10 + ord) AS pos1, arg_min(incident_key, seq * 10 + ord) AS opener
 FROM keyed WHERE attacker <> '' GROUP BY ALL"""

CTES["last_keyed"] = "SELECT incident_key, arg_max(chain, seq) AS chain, arg_max(stage, seq) AS stage FROM keyed GROUP BY ALL"

CTES["chained"] = """
 SELECT i.*, CASE WHEN seen IS NOT NULL THEN 'CHAIN-' || k.chain || ':' || attacker END AS chain_id,
   CASE WHEN seen IS NOT NULL THEN k.stage ELSE '' END AS chain_stage,
   CASE WHEN seen IS NOT NULL THEN len(seen) * 100.0 / len(stages) ELSE 0.0 END::DOUBLE AS progress,
   CASE WHEN seen IS NOT NULL THEN list_filter(stages, lambda s: list_contains(seen, s)) ELSE [] END AS done,
   CASE WHEN seen IS NOT NULL THEN list_filter(stages, lambda s: NOT list_contains(seen, s)) ELSE [] END AS todo,
   CASE WHEN seen IS NOT NULL THEN objective ELSE '' END AS objective
 FROM (SELECT *, concat_ws(':', ips[1], target_user) AS attacker FROM inc) i JOIN last_keyed k USING (incident_key) JOIN chain_defs c ON c.chain = k.chain
 LEFT JOIN (SELECT a.incident_key, list(s.stage) AS seen
            FROM (SELECT incident_key, last_seq, ord, concat_ws(':', ips[1], target_user) AS attacker FROM inc) a
            JOIN last_keyed k USING (incident_key) JOIN seen_stages s ON s.chain = k.chain AND s.attacker = a.attacker
              AND s.pos1 <= a.last_seq * 10 + a.ord GROUP BY ALL) r USING (incident_key)"""

_STAGE = "CASE chain_stage " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in dims.STAGE_SCORE.items()) + " ELSE 30 END"
CTES["factors"] = f"""
 SELECT *, {_confidence('events', 'd', 'severity', '(len(rules) + len(mitre) + ip_count)')} AS confidence,
   (CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 80 WHEN 'MEDIUM' THEN 55 WHEN 'LOW' THEN 30 ELSE 10 END)::DOUBLE AS rule_severity,
   least(events * 8, 100)::DOUBLE AS evidence_quality, least((ip_count + len(mitre)) * 15, 100)::DOUBLE AS ioc_quality,
   least((len(rules) + len(mitre) + ip_count) * 12, 100)::DOUBLE AS correlation_strength, ({_STAGE})::DOUBLE AS attack_stage,
   least(progress, 100)::DOUBLE AS attack_progress,
   (CASE WHEN d <= 0 THEN CASE WHEN events > 1 THEN 100 ELSE 20 END WHEN events >= d THEN 100 WHEN events * 2 >= d THEN 85
         WHEN events * 10 >= d THEN 60 ELSE 30 END)::DOUBLE AS time_density,
   least(ip_count * 25, 100)::DOUBLE AS source_diversity, least(len(rules) * 20, 100)::DOUBLE AS rule_diversity,
   least(events * 5, 100)::DOUBLE AS event_volume
 FROM chained"""

_W = [("rule_severity", "0.15"), ("evidence_quality", "0.12"), ("ioc_quality", "0.08"), ("correlation_strength", "0.12"),
      ("attack_stage", "0.10"), ("attack_progress", "0.08"), ("time_density", "0.10"), ("source_diversity", "0.08"),
      ("rule_diversity", "0.10"), ("event_volume", "0.07")]
CTES["scored"] = f"""
 SELECT *, format('{{:.1f}}', {' + '.join(f'{n} * {w}::DOUBLE' for n, w in _W)})::DOUBLE AS threat_score,
   CASE WHEN risk_n >= 86 THEN 'CRITICAL' WHEN risk_n >= 61 THEN 'HIGH' WHEN risk_n >= 31 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
   coalesce(target_user, 'unknown user') AS usr, strftime(first_seen, '%H:%M:%S') AS t1, strftime(last_seen, '%H:%M:%S') AS t2,
   admitted_seq IS NOT NULL AS listed
 FROM (SELECT *, (CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) * 20
         + least(events * 3, 30) + confidence * 0.5::DOUBLE AS risk_n FROM factors)
 LEFT JOIN first_updates USING (incident_key)"""

# Merging: the list of open incidents is folded pair by pair, in list order.
CTES["ranked_list"] = """
 SELECT *, row_number() OVER (ORDER BY admitted_seq, ord) AS pos FROM scored WHERE listed"""
CTES["pairs"] = """
 SELECT row_number() OVER (ORDER BY a.pos, b.pos) AS k, a.pos AS i, b.pos AS j FROM ranked_list a JOIN ranked_list b ON a.pos < b.pos"""
CTES["merge_fold"] = """
 SELECT 0::BIGINT AS k, (SELECT list({'key': incident_key, 'type': incident_type, 'usr': target_user, 'chain': chain_id,
     'f': epoch(first_seen)::BIGINT, 'l': epoch(last_seen)::BIGINT, 'ips': ips, 'owner': NULL::BIGINT, 'm': 0::BIGINT} ORDER BY pos)
   FROM ranked_list) AS s
 UNION ALL
 SELECT k, CASE WHEN a.owner IS NULL AND b.owner IS NULL AND abs(a.l - b.f) <= 300
     AND ((list_has_any(a.ips, b.ips) AND (coalesce(a.usr = b.usr, FALSE) OR a.type = b.type)) OR coalesce(a.chain = b.chain, FALSE))
   THEN list_transform(s, lambda x, p: CASE
     WHEN p = i THEN {'key': x.key, 'type': x.type, 'usr': coalesce(x.usr, b.usr), 'chain': x.chain, 'f': least(x.f, b.f), 'l': greatest(x.l, b.l),
                      'ips': list_distinct(list_concat(x.ips, b.ips)), 'owner': x.owner, 'm': x.m + 1}
     WHEN p = j THEN {'key': x.key, 'type': x.type, 'usr': x.usr, 'chain': x.chain, 'f': x.f, 'l': x.l, 'ips': x.ips, 'owner': i, 'm': a.m + 1}
     ELSE x END) ELSE s END
 FROM (SELECT p.k, p.i, p.j, m.s, m.s[p.i] AS a, m.s[p.j] AS b FROM merge_fold m JOIN pairs p ON p.k = m.k + 1)"""
CTES["absorbed"] = """
 SELECT x.key AS incident_key, s[x.owner].key AS primary_key, x.m AS merge_ord
 FROM (SELECT s, unnest(s) AS x FROM merge_fold ORDER BY k DESC LIMIT (SELECT count(*) FROM ranked_list)) WHERE x.owner IS NOT NULL"""
CTES["members"] = """
 SELECT r.*, a.primary_key, coalesce(a.merge_ord, 0) AS merge_ord, coalesce(a.primary_key, r.incident_key) AS owner
 FROM ranked_list r LEFT JOIN absorbed a USING (incident_key)"""
CTES["owners"] = """
 SELECT owner, sum(events)::BIGINT AS events, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
   arg_max(severity, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END * 10000 - merge_ord) AS severity,
   arg_min(target_user, merge_ord) FILTER (target_user <> '') AS target_user, count(*) - 1 AS merged_count,
   flatten(list(rules ORDER BY merge_ord)) AS rules, flatten(list(mitre ORDER BY merge_ord)) AS mitre, flatten(list(ips ORDER BY merge_ord)) AS ips
 FROM members GROUP BY owner"""


def _in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


CTES["listed"] = f"""
 SELECT m.incident_key, m.incident_type, m.primary_key, m.merge_ord > 0 AS is_merged, CASE WHEN m.merge_ord > 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status,
   CASE WHEN g THEN o.severity ELSE m.severity END AS severity, CASE WHEN g THEN o.events ELSE m.events END AS events,
   CASE WHEN g THEN o.first_seen ELSE m.first_seen END AS first_seen, CASE WHEN g THEN o.last_seen ELSE m.last_seen END AS last_seen,
   CASE WHEN g THEN o.target_user ELSE m.target_user END AS target_user,
   CASE WHEN g THEN {_in_order('o.rules')} ELSE m.rules END AS rules, CASE WHEN g THEN {_in_order('o.mitre')} ELSE m.mitre END AS mitre,
   CASE WHEN g THEN {_in_order('o.ips')} ELSE m.ips END AS ips, CASE WHEN g THEN o.merged_count ELSE 0 END AS merged_count, m.alerts AS own_alerts,
   m.threat_score, m.confidence, m.pos, m.last_seq, m.ord
 FROM (SELECT *, merge_ord = 0 AS g FROM members) m JOIN owners o USING (owner)"""
CTES["queue"] = "SELECT *, row_number() OVER (ORDER BY threat_score DESC, pos) AS priority FROM listed WHERE NOT is_merged"

CTES["ev_rows"] = "SELECT incident_key AS k, * FROM updates"
CTES["obs_rows"] = """
 SELECT p.rules[1] || ':' || coalesce(e.source_ip, 'unknown') AS k, e.*, e.severity AS entry_severity, p.rules, p.counts, p.alert_n
 FROM entries e JOIN per_entry p USING (seq) WHERE e.seq NOT IN (SELECT seq FROM updates)"""
for _n in ("ev", "obs"):
    CTES[f"{_n}_records"] = f"""
 SELECT b.*, f.rule_id, r.name AS rule_name, r.severity AS rule_severity, f.counts[1] AS hit_n, f.source_ip, f.username, f.message, f.raw_log, f.service,
   (least(least(events * 5, 40) + least(unique_sources * 10, 20) + least(alerts * 10, 30) + 10, 100))::DOUBLE AS conf
 FROM (SELECT k, count(*) AS events, sum(alert_n)::BIGINT AS alerts, count(DISTINCT source_ip) AS unique_sources, min(ts) AS first_seen,
         max(ts) AS last_seen, min(seq) AS first_seq, arg_min(source_ip, seq) FILTER (source_ip <> '') AS any_ip,
         arg_min(username, seq) FILTER (username <> '') AS any_user FROM {_n}_rows GROUP BY k) b
 JOIN (SELECT k, seq AS first_seq, rules[1] AS rule_id, counts, source_ip, username, message, raw_log, service FROM {_n}_rows) f USING (k, first_seq)
 LEFT JOIN rules r ON r.rule_id = f.rule_id"""


def _conditions() -> str:
    def cond(name, matched, value):
        return f"{{'condition': {name}, 'matched': {matched}, 'value': {value}}}"
    ip, user = "coalesce(source_ip, '')", "coalesce(username, '')"
    req = "substr(message, 1, 80)"
    port = r"regexp_extract(raw_log, 'DPT=(\d+)', 1)"
    cmd = "regexp_extract(raw_log, 'COMMAND=(.+?)$', 1)"
    tool = "regexp_extract(message, '(?i)(sqlmap|nikto|nmap|dirbuster|gobuster|wfuzz|hydra|medusa)', 1)"
    src, ext = cond("'Source IP'", f"{ip} <> ''", ip), cond("'External source'", f"{ip} <> ''", ip)
    same = cond("'Same source IP'", f"{ip} <> ''", ip)
    att = cond("'Login attempt'", "TRUE", "'Failed password'")
    cases = {
        "IN ('R001','R014')": [same, cond("'Same username'", f"{user} <> ''", user),
                               cond("hit_n || ' failures'", "hit_n >= 3", "hit_n::VARCHAR"),
                               cond("'Within 60 seconds'", "TRUE", "'60s window'"), cond("'Authentication success'", "FALSE", "'No'")],
        "= 'R002'": [cond("'Prior failed logins'", "TRUE", "(hit_n - 1) || ' failures'"),
                     cond("'Successful login'", "TRUE", "'Accepted password'"), same, cond("'Within 120 seconds'", "TRUE", "'120s window'")],
        "= 'R003'": [cond("'User does not exist'", "TRUE", "coalesce(username, 'unknown')"), att, ext],
        "= 'R004'": [cond("'Target user is root'", "TRUE", "'root'"), att, ext],
        "= 'R005'": [cond("'Privilege escalation command'", "TRUE", "'sudo/su'"), cond("'User identified'", f"{user} <> ''", user),
                     cond("'Command executed'", f"{cmd} <> ''", f"trim({cmd})")],
        "= 'R006'": [cond("'SQL keyword detected'", "TRUE", "'UNION/SELECT/OR 1=1'"), cond("'Web request'", "TRUE", req), src],
        "= 'R007'": [cond("'Path traversal pattern'", "TRUE", "'../ or %2f'"), cond("'Target path'", "TRUE", req), src],
        "= 'R008'": [cond("'Known attack tool UA'", f"{tool} <> ''", tool), cond("'Web request'", "TRUE", "'HTTP request'"), src],
        "= 'R010'": [cond("'Firewall action'", "TRUE", "'BLOCK'"), src, cond("'Destination port'", f"{port} <> ''", port),
                     cond("'Protocol'", "TRUE", "'TCP'")],
    }
    generic = (f"list_filter([CASE WHEN {ip} <> '' THEN {cond(chr(39) + 'Source IP' + chr(39), 'TRUE', ip)} END, "
               f"CASE WHEN {user} <> '' THEN {cond(chr(39) + 'Username' + chr(39), 'TRUE', user)} END, "
               f"CASE WHEN service <> '' THEN {cond(chr(39) + 'Service' + chr(39), 'TRUE', 'service')} END, "
               f"{cond(chr(39) + 'Pattern match' + chr(39), 'TRUE', req)}], lambda x: x IS NOT NULL)")
    return "CASE " + " ".join(f"WHEN rule_id {k} THEN [{', '.join(v)}]" for k, v in cases.items()) + f" ELSE {generic} END"


CTES["conditions"] = (f"SELECT 'EV-' || k AS evidence_id, {_conditions()} AS m FROM ev_records UNION ALL "
                      f"SELECT 'OBS-' || k, {_conditions()} FROM obs_records")

TEXT_IOCS = [
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b", 0),
    ("url", r"(?i)https?://[^\s\"'<>]+", 0),
    ("email", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0),
    ("domain", r"(?i)\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+(?:com|net|org|io|dev|xyz|ru|cn|info|biz|me|co|uk|de|fr|example)\b", 0),
    ("filepath", r"(?:/(?:etc|var|tmp|usr|home|opt|bin|sbin|root|www|proc|dev)(?:/[^\s\"'<>;|&]+)+)", 0),
    ("command", r"(?m)COMMAND=(.+?)$", 1), ("port", r"\bDPT=(\d+)\b", 1),
    ("hash", r"\b[0-9a-fA-F]{64}\b", 0), ("hash", r"\b[0-9a-fA-F]{32}\b", 0)]


def _text_iocs(text: str) -> str:
    parts = [f"list_transform(regexp_extract_all({text}, {_q(p)}, {g}), lambda v: {{'ioc_type': '{k}', 'value': trim(v)}})" for k, p, g in TEXT_IOCS]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_FIELDS = ("[{'ioc_type': 'ipv4', 'value': source_ip}, {'ioc_type': 'username', 'value': username}, {'ioc_type': 'hostname', 'value': hostname}, "
           "{'ioc_type': 'service', 'value': service}, {'ioc_type': 'process', 'value': process}]")
CTES["entry_iocs"] = f"""
 SELECT seq, event_id, i - 1 AS i, x.ioc_type, x.value FROM (
  SELECT seq, event_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
   SELECT seq, event_id, {_in_order('l')} AS l FROM (
    SELECT seq, event_id, list_filter(list_concat({_FIELDS}, {_text_iocs('raw_log')}), lambda x: coalesce(x.value, '') <> '') AS l FROM entries)))"""

_KINDS = [("ipv4", "source_ip"), ("username", "username"), ("hostname", "hostname"), ("service", "service")]
CTES["tick_rows"] = """
 SELECT seq, ts, 0 AS ord, source_ip, username, hostname, service FROM entries
 UNION ALL SELECT seq, ts, ord, source_ip, username, hostname, service FROM updates"""
CTES["ticks"] = " UNION ALL ".join(
    f"SELECT seq, ts, ord, '{k}' AS ioc_type, {f} AS value, source_ip, username, hostname, service FROM tick_rows WHERE {f} <> ''"
    for k, f in _KINDS)
CTES["links"] = " UNION ALL ".join(
    f"SELECT ioc_type, value, '{k}' AS link_type, {f} AS linked, min(seq * 10) AS pos1 FROM ticks "
    f"WHERE ord = 0 AND ioc_type <> '{k}' AND {f} <> '' GROUP BY ALL" for k, f in _KINDS) + """
 UNION ALL SELECT ioc_type, value, 'rule', rule_id, min(seq * 10) FROM ticks JOIN hits USING (seq) WHERE ticks.ord = 0 GROUP BY ALL
 UNION ALL SELECT t.ioc_type, t.value, 'incident', u.incident_key, min(t.seq * 10 + t.ord) FROM ticks t JOIN updates u ON u.seq = t.seq AND u.ord = t.ord GROUP BY ALL"""
CTES["relationships"] = """
 SELECT b.ioc_type, b.value, b.first_seen, b.last_seen, b.occurrences, coalesce(a.alerts, 0)::BIGINT AS related_alerts,
   coalesce(incidents, 0) AS related_incidents, coalesce(users, 0) AS related_users, coalesce(services, 0) AS related_services,
   coalesce(hosts, 0) AS related_hosts, coalesce(rules, 0) AS related_rules, coalesce(ips, 0) AS related_ips,
   least(least(occurrences * 3, 30) + least(coalesce(early_incidents, 0) * 15, 30) + least(coalesce(early_rules, 0) * 10, 20)
     + least(coalesce(a.early_alerts, 0) * 2, 10) + 10, 100)::DOUBLE AS confidence
 FROM (SELECT ioc_type, value, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrences, max(seq * 10 + ord) AS last_at FROM ticks GROUP BY ALL) b
 LEFT JOIN (SELECT t.ioc_type, t.value, count(*) AS alerts, count(*) FILTER (h.seq * 10 < m.last_at) AS early_alerts
            FROM ticks t JOIN hits h USING (seq) JOIN (SELECT ioc_type, value, max(seq * 10 + ord) AS last_at FROM ticks GROUP BY ALL) m USING (ioc_type, value)
            WHERE t.ord = 0 GROUP BY ALL) a USING (ioc_type, value)
 LEFT JOIN (SELECT l.ioc_type, l.value, count(*) FILTER (link_type = 'incident') AS incidents, count(*) FILTER (link_type = 'username') AS users,
     count(*) FILTER (link_type = 'service') AS services, count(*) FILTER (link_type = 'hostname') AS hosts, count(*) FILTER (link_type = 'rule') AS rules,
     count(*) FILTER (link_type = 'ipv4') AS ips, count(*) FILTER (link_type = 'incident' AND pos1 < last_at) AS early_incidents,
     count(*) FILTER (link_type = 'rule' AND pos1 < last_at) AS early_rules
   FROM links l JOIN (SELECT ioc_type, value, max(seq * 10 + ord) AS last_at FROM ticks GROUP BY ALL) m USING (ioc_type, value) GROUP BY ALL) k USING (ioc_type, value)"""

CTES["registrations"] = """
 SELECT event_id, hostname, source_ip, username, service, rules, incident_key FROM updates
 UNION ALL SELECT event_id, hostname, source_ip, username, service, rules, NULL FROM obs_rows"""
CTES["edges"] = """
 SELECT event_id AS source, 'host:' || hostname AS target, 'originated' AS type FROM registrations WHERE hostname <> ''
 UNION ALL SELECT event_id, 'ip:' || source_ip, 'originated' FROM registrations WHERE source_ip <> ''
 UNION ALL SELECT event_id, 'user:' || username, 'targeted' FROM registrations WHERE username <> ''
 UNION ALL SELECT event_id, 'svc:' || service, 'related' FROM registrations WHERE service <> ''
 UNION ALL SELECT event_id, event_id || '-' || r, 'generated' FROM (SELECT event_id, unnest(rules) AS r FROM registrations)
 UNION ALL SELECT event_id || '-' || r, incident_key, 'triggered' FROM (SELECT event_id, incident_key, unnest(rules) AS r FROM registrations WHERE incident_key IS NOT NULL)
 UNION ALL SELECT event_id, incident_key, 'related' FROM registrations WHERE incident_key IS NOT NULL"""
CTES["nodes"] = """
 SELECT DISTINCT id, type, label FROM (
  SELECT event_id AS id, 'event' AS type, event_id AS label FROM registrations
  UNION ALL SELECT 'host:' || hostname, 'host', hostname FROM registrations WHERE hostname <> ''
  UNION ALL SELECT 'ip:' || source_ip, 'ip', source_ip FROM registrations WHERE source_ip <> ''
  UNION ALL SELECT 'user:' || username, 'user', username FROM registrations WHERE username <> ''
  UNION ALL SELECT 'svc:' || service, 'service', service FROM registrations WHERE service <> ''
  UNION ALL SELECT event_id || '-' || r, 'alert', event_id || '-' || r FROM (SELECT event_id, unnest(rules) AS r FROM registrations)
  UNION ALL SELECT incident_key, 'incident', incident_key FROM registrations WHERE incident_key IS NOT NULL)"""
CTES["reach"] = """
 SELECT DISTINCT id FROM (
  WITH s AS (SELECT arg_min(event_id, seq) AS id FROM updates), h1 AS (SELECT target AS id FROM edges JOIN s ON source = s.id),
       h2 AS (SELECT target AS id FROM edges JOIN h1 ON source = h1.id)
  SELECT * FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""

CTES["notices"] = """
 SELECT ts, CASE WHEN severity = 'CRITICAL' THEN 'critical' ELSE 'warning' END AS type, 'detection' AS category, severity || ' Alert: ' || rule_name AS title
 FROM alerts WHERE severity IN ('CRITICAL', 'HIGH')
 UNION ALL SELECT ts, CASE severity WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'warning' ELSE 'info' END, 'incidents',
   CASE WHEN severity = 'CRITICAL' THEN 'Critical Incident: ' ELSE 'Incident: ' END || incident_type FROM updates JOIN first_updates USING (incident_key) WHERE seq >= admitted_seq
 UNION ALL SELECT ts, 'info', 'evidence', 'Evidence Collected' FROM updates JOIN first_updates USING (incident_key) WHERE seq >= admitted_seq
 UNION ALL SELECT (SELECT max(ts) FROM entries), 'success', 'detection', 'Observation Promoted' FROM obs_records WHERE events >= 3 OR alerts >= 2"""
CTES["rolled"] = """
 SELECT type, category, title, min(ts) AS first, max(ts) AS last, sum(n)::BIGINT AS count FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR date_diff('second', prev, ts) >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY type, category, title ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY type, category, title ORDER BY ts) AS prev
        FROM (SELECT type, category, title, ts, count(*) AS n FROM notices GROUP BY ALL))) GROUP BY type, category, title, session"""

# As-of counters for findings, by correlated counting.
CTES["ip_points"] = "SELECT s.incident_key, s.source_ip, i.last_seq FROM sources s JOIN inc i USING (incident_key)"
CTES["auth_seq"] = """
 SELECT source_ip, seq, t, t - lag(t) OVER (PARTITION BY source_ip ORDER BY t, seq) AS gap FROM (
  SELECT DISTINCT source_ip, seq, t FROM alerts WHERE rule_id IN ('R001','R002','R003','R004','R014') AND source_ip <> '')"""

ORDERED = list(CTES)
SHARED = {"entries", "hits", "updates", "obs_rows", "ticks", "links", "registrations", "edges", "reach"}


def _needs(sql: str) -> list[str]:
    """Names of the expressions a statement uses, with theirs, in order of definition."""
    import re
    words = set(re.findall(r"[a-z_]+", sql))
    todo, found = [n for n in ORDERED if n in words], set()
    while todo:
        n = todo.pop()
        if n not in found:
            found.add(n)
            words = set(re.findall(r"[a-z_]+", CTES[n]))
            todo += [m for m in ORDERED if m in words and m != n]
    return [n for n in ORDERED if n in found]


def sql(select: str) -> str:
    names = _needs(select)
    more = ",\n" + select[5:] if select.startswith("WITH ") else "\n" + select
    # Shared expressions are computed once, not once for each use.
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({CTES[n]})" for n in names) + more


def _first_batch(select: str) -> str:
    """The statement over the first of two batches of lines."""
    whole, bound = CTES["lines"], "(SELECT min(event_id) + (max(event_id) - min(event_id)) // 2 + 1 FROM events)"
    CTES["lines"] = f"SELECT * FROM ({whole}) WHERE seq < {bound}"
    try:
        return sql(select)
    finally:
        CTES["lines"] = whole


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def bar(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


ORACLE: dict[str, str] = {}


def add(name: str, select: str) -> None:
    ORACLE[name] = sql(select)


add("scan_lines", "SELECT value FROM lines")
add("ingest_batch", "SELECT 'events' AS source_file, (SELECT count(*) FROM entries) AS events, (SELECT count(*) FROM alerts) AS alerts, "
    "(SELECT count(*) FROM scored WHERE listed) AS incidents")
add("export_csv", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, hostname, coalesce(source_ip, '') AS source_ip, "
    "coalesce(username, '') AS username, service, event_type, severity, substr(message, 1, 300) AS message, log_format FROM entries")
_ISO = lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def _object(fields: dict[str, str]) -> str:
    return "to_json({" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "})::VARCHAR"


_ALERT = {x: x for x in ("alert_id", "rule_id", "rule_name", "severity", "source_ip", "username", "description")} | {
    "matched_event_id": "event_id", "timestamp": _ISO("ts"), "status": "'ACTIVE'", "mitre": "mitre", "event_count": "event_count"}
_INCIDENT = {x: x for x in ("incident_key", "incident_type", "severity")} | {
    "status": "'ACTIVE'", "target_user": "target_user", "first_seen": _ISO("first_seen"), "last_seen": _ISO("last_seen"), "total_events": "events",
    "alert_count": "alerts", "ip_count": "ip_count", "triggered_rules": "rules", "mitre_techniques": "mitre", "correlation_explanation": "why",
    "confidence": "confidence", "risk": "risk", "threat_score": "threat_score"}
_STATS = ("total_logs", "info_events", "warning_events", "high_events", "critical_events", "total_alerts", "active_alerts", "total_incidents", "active_incidents")
add("latest_updates", "SELECT incident_key, arg_max(event_id, seq) AS event_id, arg_max(n, seq) AS n FROM updates GROUP BY ALL")
add("newest_entries", "SELECT seq, event_id FROM entries ORDER BY seq DESC LIMIT 50")
# Lines arrive in two batches of equal ranges of seq.
_BATCH = "((seq - (SELECT min(event_id) FROM events)) // (SELECT (max(event_id) - min(event_id)) // 2 + 1 FROM events))::BIGINT"
add("upsert_incidents", f"""SELECT incident_key, max({_BATCH}) AS batch_id, arg_max(event_id, seq) AS event_id, arg_max(n, seq) AS n, count(*) AS total_events,
 sum(alert_n)::BIGINT AS alert_count, {ts('min(ts)')} AS first_seen, {ts('max(ts)')} AS last_seen, arg_max(username, seq) FILTER (username <> '') AS target_user,
 count(DISTINCT nullif(source_ip, '')) AS ip_count FROM updates GROUP BY incident_key""")
_OBS = f"""SELECT k AS evidence_key, batch, sum(n) OVER w AS e, sum(a) OVER w AS a FROM (SELECT k, {_BATCH} AS batch, count(*) AS n, sum(alert_n) AS a FROM obs_rows GROUP BY ALL)
 WINDOW w AS (PARTITION BY k ORDER BY batch)"""
_PROMOTED = "min(batch) FILTER (e >= 3 OR a >= 2)"
add("stream_promotions", f"SELECT evidence_key, max(e)::BIGINT AS event_count, max(a)::BIGINT AS alert_count, {_PROMOTED} AS promoted_in FROM ({_OBS}) GROUP BY ALL")
add("publish_updates", f"""SELECT batch_id, 'new_logs' AS slice, event_id AS id FROM (
  SELECT event_id, {_BATCH} AS batch_id, row_number() OVER (PARTITION BY {_BATCH} ORDER BY seq DESC) AS r FROM entries) WHERE r <= 50
 UNION ALL SELECT {_BATCH}, 'new_alert', alert_id FROM alerts
 UNION ALL SELECT DISTINCT {_BATCH} AS b, unnest(['new_incident', 'evidence_created']), unnest([incident_key, 'EV-' || incident_key]) FROM updates u
  WHERE {_BATCH} >= (SELECT {_BATCH.replace('(seq -', '(admitted_seq -')} FROM first_updates f WHERE f.incident_key = u.incident_key)
 UNION ALL SELECT promoted_in, 'observation_promoted', 'OBS-' || evidence_key FROM (SELECT evidence_key, {_PROMOTED} AS promoted_in FROM ({_OBS}) GROUP BY ALL)
  WHERE promoted_in IS NOT NULL
 UNION ALL SELECT b, 'stats_update', '{{"lines":' || l || ',"alerts":' || coalesce(a, 0) || ',"updates":' || coalesce(u, 0) || '}}'
  FROM (SELECT {_BATCH} AS b, count(*) AS l FROM entries GROUP BY ALL) LEFT JOIN (SELECT {_BATCH} AS b, count(*) AS a FROM hits GROUP BY ALL) USING (b)
  LEFT JOIN (SELECT {_BATCH} AS b, count(*) AS u FROM updates GROUP BY ALL) USING (b)""")
add("stream_merges", f"SELECT 1::BIGINT AS batch_id, incident_key, primary_key, merge_ord FROM absorbed UNION ALL SELECT * FROM ({_first_batch('SELECT 0::BIGINT, incident_key, primary_key, merge_ord FROM absorbed')})")
add("stream_priorities", f"SELECT 1::BIGINT AS batch_id, incident_key, priority FROM queue UNION ALL SELECT * FROM ({_first_batch('SELECT 0::BIGINT, incident_key, priority FROM queue')})")
add("detect_format", "SELECT seq, value, log_format FROM matched")
ENTRY = f"seq, event_id, {ts('ts')} AS timestamp, hostname, source_ip, username, service, process, event_type, message, severity"
add("parse_lines", f"SELECT {ENTRY}, log_format FROM entries")
add("parse_syslog", f"SELECT {ENTRY}, 'syslog' AS log_format FROM entries WHERE log_format = 'auth'")
add("parse_apache_access", f"SELECT {ENTRY}, log_format FROM entries WHERE log_format = 'apache_access'")
add("parse_apache_error", f"""SELECT seq, event_id, {ts('ts')} AS timestamp, 'webserver' AS hostname, source_ip, NULL::VARCHAR AS username, 'apache' AS service,
 'httpd' AS process, 'Web Server' AS event_type, message, CASE seq % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'CRITICAL' ELSE 'INFO' END AS severity,
 'apache_error' AS log_format FROM entries WHERE log_format = 'apache_access'""")
ORACLE["parse_fallback"] = f"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 v AS (SELECT doc_id * 4294967296 + i AS seq, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS value FROM d)
SELECT seq, substr(value, 1, 500) AS message, nullif(regexp_extract(value, {_q(IP)}, 1), '') AS source_ip, 'Unknown' AS event_type, 'INFO' AS severity,
 '2024-01-01 00:00:00' AS timestamp FROM v WHERE value <> '' AND NOT regexp_matches(value, {_q(BSD)}) AND NOT regexp_matches(value, {_q(ACCESS)})
 AND NOT regexp_matches(value, '^\\[([^\\]]+)\\]\\s+\\[(?:\\w+:)?(\\w+)\\]\\s+(.+)$')"""
add("parse_bsd_ts", f"SELECT seq, {ts('ts')} AS ts FROM fields WHERE log_format = 'auth'")
add("parse_apache_ts", f"SELECT seq, {ts('ts')} AS ts FROM fields WHERE log_format = 'apache_access'")
add("extract_first_ip", f"SELECT seq, nullif(regexp_extract(value, {_q(IP)}, 1), '') AS ip FROM lines")
add("extract_username", f"SELECT seq, {_user('value')} AS username FROM lines")
add("classify_event", "SELECT service, event_type, count(*) AS n FROM entries WHERE log_format = 'auth' GROUP BY ALL")
add("syslog_severity", "SELECT severity, count(*) AS n FROM entries WHERE log_format = 'auth' GROUP BY ALL")
add("http_severity", "SELECT severity, message, count(*) AS n FROM entries WHERE log_format = 'apache_access' GROUP BY ALL")

_hay = "contains(lower(message || chr(10) || coalesce(source_ip, '') || chr(10) || coalesce(username, '') || chr(10) || service || chr(10) || raw_log), {})"
add("search_entries", f"SELECT seq, event_id, {ts('ts')} AS timestamp, source_ip, username, service, severity FROM entries WHERE "
    + _hay.format("'failed password'") + " AND severity = 'MEDIUM' AND contains(lower(username), 'acct1') ORDER BY ts DESC, seq LIMIT 200 OFFSET 50")
add("search_entries_total", "SELECT count(*) AS total FROM entries WHERE " + _hay.format("'10.0.0.3'")
    + " AND event_type = 'Web Server' AND contains(lower(service), 'apache')")
add("filter_alerts", f"SELECT alert_id, rule_id, {ts('ts')} AS timestamp FROM alerts ORDER BY ts DESC, seq, ord LIMIT 500")
add("active_alerts", "SELECT rule_id, count(*) AS n FROM alerts GROUP BY ALL")
add("active_incidents", "SELECT incident_key, incident_type FROM inc")
add("search_evidence", """SELECT 'EV-' || k AS evidence_id, rule_id, ev_records.events AS event_count FROM ev_records JOIN inc i ON i.incident_key = k
 WHERE i.severity = 'HIGH' AND k IN (SELECT incident_key FROM updates WHERE source_ip = '10.0.0.2') AND k IN (SELECT incident_key FROM updates WHERE service = 'sshd')
 AND k IN (SELECT u.incident_key FROM updates u JOIN entry_iocs x USING (seq) WHERE x.value = 'acct1')""")
add("search_evidence_keyword", """SELECT 'EV-' || k AS evidence_id FROM ev_records LEFT JOIN (SELECT incident_key AS k, string_agg(source_ip, ' ' ORDER BY first_seq) AS ips FROM sources GROUP BY ALL) USING (k)
 LEFT JOIN (SELECT incident_key AS k, string_agg(username, ' ' ORDER BY pos1) AS users FROM (SELECT incident_key, username, min(seq) AS pos1 FROM updates WHERE username <> '' GROUP BY ALL) GROUP BY ALL) USING (k)
 WHERE contains(lower(rule_name || ' ' || coalesce(ips, '') || ' ' || coalesce(users, '')), 'failures 10.0.0')""")
add("evidence_by_incident", "SELECT 'EV-' || k AS evidence_id, rule_id, rule_name, events AS event_count FROM ev_records WHERE k = 'brute_force:10.0.0.1'")
add("list_observations", f"""SELECT 'OBS-' || k AS observation_id, rule_id, rule_name, rule_severity AS severity, events AS event_count, alerts AS alert_count,
 {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, unique_sources AS unique_source_count, conf AS collection_confidence FROM obs_records""")
add("incident_list_view", f"""SELECT incident_key, any_value(i.events) AS total_events, {bar('list(description ORDER BY seq, sub)')} AS timeline FROM (
 SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY seq, sub) AS rn FROM timeline) JOIN scored i USING (incident_key) WHERE rn <= 5 AND listed GROUP BY incident_key""")
add("fp_filter", "SELECT incident_key, listed, admitted_seq FROM scored")
add("recent_incident_view", "SELECT incident_key FROM ranked_list ORDER BY pos LIMIT 8")

ALERT = f"alert_id, seq, rule_id, severity, source_ip, username, description, {ts('ts')} AS timestamp, mitre, event_count"
from contract.rule_names import RULE_QUERIES  # noqa: E402

for _n, _r in RULE_QUERIES.items():
    add(_n, f"SELECT {ALERT} FROM alerts WHERE rule_id IN ({', '.join(map(_q, _r))})")
add("rule_port_scan", r"""SELECT event_id || '-R009' AS alert_id, seq, source_ip, n AS event_count FROM (
 SELECT a.seq, a.event_id, a.source_ip, count(DISTINCT b.port) AS n FROM (SELECT *, regexp_extract(message, 'DPT=(\d+)', 1) AS port FROM entries) a
 JOIN (SELECT seq, t, source_ip, regexp_extract(message, 'DPT=(\d+)', 1) AS port FROM entries) b
   ON a.source_ip = b.source_ip AND b.port <> '' AND b.t > a.t - 30 AND b.t <= a.t AND b.seq <= a.seq WHERE a.port <> '' GROUP BY ALL) WHERE n >= 20""")
add("alerts", f"SELECT alert_id, rule_id, rule_name, severity, source_ip, username, description, event_id AS matched_event_id, {ts('ts')} AS timestamp, "
    "'ACTIVE' AS status, mitre, event_count FROM alerts")
for _n, _s in (("incident_brute_force", 1), ("incident_account_compromise", 2), ("incident_web_recon", 3), ("incident_priv_esc", 4), ("incident_service_failure", 5)):
    add(_n, f"SELECT incident_key, seq, event_id, n FROM updates WHERE ord = {_s}")
add("incident_updates", f"SELECT incident_key, incident_type, severity, seq, description, {bar('rules')} AS rules FROM updates")
add("build_incidents", f"""SELECT incident_key, incident_type, severity, target_user, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, events AS total_events,
 alerts AS alert_count, ip_count, {bar('rules')} AS triggered_rules, {bar('mitre')} AS mitre_techniques, why AS correlation_explanation FROM inc""")
add("incident_timeline", f"SELECT incident_key, seq, sub::BIGINT AS sub, {ts('ts')} AS timestamp, event_type, description, severity FROM timeline")
add("rank_priority", "SELECT incident_key, threat_score, priority FROM queue")
add("auth_gap", "SELECT source_ip, count(*) AS auth_alerts, min(gap)::DOUBLE AS min_gap_s FROM auth_seq GROUP BY ALL HAVING min(gap) IS NOT NULL")
add("timeline_gaps", """SELECT incident_key, seq, sub::BIGINT AS sub, CASE WHEN g IS NULL THEN NULL WHEN g < 60 THEN g || 's' WHEN g < 3600 THEN (g // 60) || 'm ' || (g % 60) || 's'
 ELSE (g // 3600) || 'h ' || (g // 60 % 60) || 'm' END AS gap FROM (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY incident_key ORDER BY seq, sub), ts) AS g FROM timeline)""")
add("notification_rollup", f"SELECT type, category, title, {ts('first')} AS first, {ts('last')} AS last, count FROM rolled")
add("notification_center", "SELECT category, title, sum(count)::BIGINT AS count, count(*) AS groups FROM (SELECT * FROM rolled ORDER BY first DESC, type, category, title LIMIT 200) GROUP BY ALL")
add("alerts_with_rules", "SELECT alert_id, rule_name, recommendation FROM alerts")
add("entry_detail", "SELECT e.event_id, e.message, a.alert_id, a.rule_name, a.event_count, a.recommendation FROM entries e LEFT JOIN alerts a USING (seq) WHERE e.username = 'root'")
add("incident_related_logs", "SELECT incident_key, seq, message FROM updates WHERE incident_type = 'Account Compromise'")
add("alerts_without_incident", f"SELECT seq, event_id, {bar('rules')} AS rules FROM obs_rows")
add("related_iocs", """WITH asked AS (SELECT * FROM (VALUES ('username', 'acct3'), ('ipv4', '10.0.0.4')) v(asked_type, asked_value))
 SELECT DISTINCT asked_type, asked_value, b.ioc_type, b.value FROM asked JOIN links a ON a.ioc_type = asked_type AND a.value = asked_value
 JOIN links b ON a.link_type = b.link_type AND a.linked = b.linked WHERE a.link_type IN ('incident', 'rule', 'ipv4') AND NOT (b.ioc_type = asked_type AND b.value = asked_value)""")
add("merge_candidates", """SELECT a.incident_key AS primary_key, b.incident_key AS secondary_key FROM ranked_list a JOIN ranked_list b ON a.pos < b.pos
 AND abs(epoch(a.last_seen) - epoch(b.first_seen)) <= 300 AND ((list_has_any(a.ips, b.ips) AND (coalesce(a.target_user = b.target_user, FALSE) OR a.incident_type = b.incident_type))
 OR coalesce(a.chain_id = b.chain_id, FALSE))""")
add("merge_incidents", f"""SELECT incident_key, primary_key, is_merged, status, severity, events AS total_events, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, target_user,
 {bar('rules')} AS triggered_rules, {bar('mitre')} AS mitre_techniques, {bar('ips[1:5]')} AS first_sources, merged_count,
 CASE WHEN l.merged_count > 0 AND NOT l.is_merged THEN (SELECT count(DISTINCT (u.seq, r)) FROM (SELECT seq, incident_key, unnest(rules) AS r FROM updates) u JOIN members m ON m.incident_key = u.incident_key
   WHERE m.owner = l.incident_key) ELSE l.own_alerts END AS alert_count FROM listed l""")
add("incident_sources", "SELECT incident_key, source_ip FROM sources")
add("merged_timeline", """SELECT owner AS incident_key, CASE WHEN owner <> t.incident_key THEN t.incident_key END AS merged_from, seq, sub::BIGINT AS sub, event_type, description
 FROM timeline t JOIN members m ON m.incident_key = t.incident_key""")
add("merged_alerts", "SELECT DISTINCT owner AS incident_key, seq, unnest(u.rules) AS rule_id FROM updates u JOIN members m ON m.incident_key = u.incident_key")
add("merged_events", "SELECT DISTINCT owner AS incident_key, seq FROM updates u JOIN members m ON m.incident_key = u.incident_key")
add("merged_sources", "SELECT DISTINCT incident_key, unnest(ips) AS source_ip FROM listed WHERE NOT is_merged")
add("merge_map", "SELECT incident_key, primary_key, merge_ord FROM absorbed")
add("evidence_for_incident", "SELECT incident_key, 'EV-' || incident_key AS evidence_id, coalesce(e.rule_name, '') AS rule_name, risk FROM scored JOIN ev_records e ON e.k = incident_key WHERE listed")
add("dashboard_stats", """SELECT (SELECT count(*) FROM entries) AS total_logs, (SELECT count(*) FROM entries WHERE severity = 'INFO') AS info_events,
 (SELECT count(*) FROM entries WHERE severity IN ('MEDIUM', 'LOW')) AS warning_events, (SELECT count(*) FROM entries WHERE severity = 'HIGH') AS high_events,
 (SELECT count(*) FROM entries WHERE severity = 'CRITICAL') AS critical_events, (SELECT count(*) FROM alerts) AS total_alerts, (SELECT count(*) FROM alerts) AS active_alerts,
 (SELECT count(*) FROM listed) AS total_incidents, (SELECT count(*) FROM inc) - (SELECT count(*) FROM listed WHERE is_merged) AS active_incidents""")
add("export_json", f"""SELECT 'report_metadata' AS part, {_object({'total_entries_analyzed': 'count(*)'})} AS json FROM entries
 UNION ALL SELECT 'statistics', {_object({x: x for x in _STATS})} FROM ({ORACLE['dashboard_stats'].split(chr(10) + 'SELECT', 1)[1].join(['SELECT', ''])})
 UNION ALL SELECT 'incidents', {_object(_INCIDENT)} FROM scored
 UNION ALL SELECT 'alerts', {_object(_ALERT)} FROM (SELECT * FROM alerts ORDER BY seq DESC, ord DESC LIMIT 500)""")
_FILES = "(VALUES (0, 'auth.log'), (1, 'syslog'), (2, 'messages'), (3, 'app.log'), (4, 'notes'), (5, 'old.txt'), (6, 'kern.log.1'), (7, 'data')) f(k, name)"
for _n, _kept in (("discover_files", "k < 4"), ("list_log_files", "k < 5 OR k = 7")):
    add(_n, f"SELECT name, sum(strlen(value) + 1)::BIGINT AS size_bytes FROM lines JOIN {_FILES} ON seq % 8 = k WHERE {_kept} GROUP BY name")
add("top_source_ips", "SELECT source_ip AS ip, count(*) AS count FROM entries WHERE source_ip <> '' GROUP BY ALL ORDER BY count(*) DESC, min(seq) LIMIT 10")
add("top_event_types", "SELECT event_type AS type, count(*) AS count FROM entries GROUP BY ALL ORDER BY count(*) DESC, min(seq) LIMIT 10")
add("severity_distribution", "SELECT s AS severity, count(e.seq) AS count FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO']) AS s) LEFT JOIN entries e ON e.severity = s GROUP BY ALL")
add("logs_over_time", "SELECT strftime(ts, '%H:%M') AS time, count(*) AS count FROM entries GROUP BY ALL")
add("logs_per_minute", f"SELECT {ts(chr(100) + 'ate_trunc(' + _q('minute') + ', ts)')} AS minute, count(*) AS count FROM entries GROUP BY ALL")
add("rule_frequency", "SELECT rule_id, rule_name, count(*) AS count FROM alerts GROUP BY ALL ORDER BY count(*) DESC, min(seq * 100 + ord) LIMIT 10")
add("threat_trend", "SELECT strftime(ts, '%H:%M') AS time, count(*) AS count FROM alerts GROUP BY ALL")
add("threat_summary", """SELECT (SELECT count(*) FROM listed WHERE status = 'ACTIVE') AS active_threats, (SELECT count(*) FROM listed WHERE severity = 'CRITICAL') AS critical_incidents,
 (SELECT count(*) FROM alerts) AS extracted_iocs, (SELECT count(*) FROM listed) AS evidence_items,
 (SELECT count(*) FROM listed) AS investigations, (SELECT count(*) FROM alerts) AS open_alerts, 0::BIGINT AS resolved_alerts,
 (SELECT count(DISTINCT x) FROM (SELECT unnest(ips) AS x FROM listed)) AS suspicious_ips, (SELECT count(DISTINCT target_user) FROM listed) AS tracked_users,
 (SELECT count(DISTINCT x) FROM (SELECT unnest(mitre) AS x FROM listed)) AS mitre_techniques""")
add("most_dangerous", "SELECT incident_key, incident_type, threat_score, severity, confidence FROM queue ORDER BY threat_score DESC, pos LIMIT 1")
add("most_active_attacker", "SELECT source_ip, sum(events)::BIGINT AS event_count FROM (SELECT unnest(ips) AS source_ip, events, pos FROM queue) GROUP BY ALL ORDER BY sum(events) DESC, min(pos) LIMIT 1")
add("most_targeted_user", "SELECT target_user AS user, sum(events)::BIGINT AS event_count FROM queue WHERE target_user <> '' GROUP BY ALL ORDER BY sum(events) DESC, min(pos) LIMIT 1")
add("most_targeted_service", """SELECT CASE WHEN rule_id IN ('R001','R002','R003','R004','R014') THEN 'sshd' WHEN rule_id IN ('R006','R007','R008','R015') THEN 'web'
 WHEN rule_id = 'R005' THEN 'sudo' WHEN rule_id = 'R010' THEN 'firewall' END AS service, count(*) AS event_count FROM alerts WHERE rule_id NOT IN ('R011','R012','R013') GROUP BY 1 ORDER BY count(*) DESC LIMIT 1""")
add("soc_queue", "SELECT incident_key, incident_type, severity, threat_score, priority, confidence FROM queue ORDER BY priority LIMIT 10")
add("merged_count", "SELECT count(*) FILTER (NOT is_merged) AS total_incidents, count(*) FILTER (is_merged) AS merged_incidents FROM listed")
_COUNTERS = """SELECT source_ip, events, coalesce(users, 0) AS users, coalesce(auth_alerts, 0) AS auth_alerts, coalesce(firewall_blocks, 0) AS firewall_blocks FROM
 (SELECT source_ip, count(*) AS events, count(DISTINCT username) AS users, min(seq) AS pos1 FROM entries WHERE source_ip <> '' GROUP BY ALL)
 LEFT JOIN (SELECT source_ip, count(*) AS auth_alerts FROM auth_seq GROUP BY ALL) USING (source_ip)
 LEFT JOIN (SELECT source_ip, count(*) AS firewall_blocks FROM alerts WHERE rule_id = 'R010' GROUP BY ALL) USING (source_ip)"""
add("behaviour_counters", _COUNTERS)
add("behaviour_user_counters", "SELECT username, count(DISTINCT source_ip) AS sources FROM entries WHERE username <> '' AND source_ip <> '' GROUP BY ALL")
add("behaviour_service_counters", "SELECT service, count(*) AS crashes FROM hits JOIN entries USING (seq) WHERE rule_id = 'R013' GROUP BY ALL")
add("behaviour_global", """SELECT 'active_attacker' AS type, source_ip AS subject, n AS event_count, users AS related, 'IP ' || source_ip || ': ' || n || ' events targeting ' || users || ' users' AS description FROM (
 SELECT source_ip, count(*) AS n, count(DISTINCT username) AS users FROM entries WHERE source_ip <> '' GROUP BY ALL ORDER BY n DESC, min(seq) LIMIT 5) WHERE n >= 10
 UNION ALL SELECT 'targeted_user', username, 0, n, 'User ''' || username || ''': targeted from ' || n || ' IPs' FROM (
 SELECT username, count(DISTINCT source_ip) AS n FROM entries WHERE username <> '' AND source_ip <> '' GROUP BY ALL ORDER BY n DESC, min(seq) LIMIT 5) WHERE n >= 2""")
_REL = f"ioc_type, value, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, occurrences, related_alerts, related_incidents, related_users, related_services, related_hosts, related_rules, related_ips, confidence"
add("ioc_relationships", f"SELECT {_REL} FROM relationships")
add("ioc_confidence", "SELECT ioc_type, value, confidence FROM relationships")
add("ioc_links", "SELECT ioc_type, value, link_type, linked FROM links")
add("incident_iocs", "SELECT DISTINCT r.ioc_type, r.value, r.occurrences FROM relationships r JOIN links l ON l.ioc_type = r.ioc_type AND l.value = r.value AND l.link_type = 'incident' AND l.linked = 'web_recon:10.0.0.2'")
add("evidence", f"""SELECT 'EV-' || k AS evidence_id, k AS incident_key, coalesce(rule_id, '') AS rule_id, coalesce(rule_name, '') AS rule_name, i.severity, {ts('e.first_seen')} AS first_seen, {ts('e.last_seen')} AS last_seen,
 e.events AS event_count, e.alerts AS alert_count, unique_sources AS unique_source_count, conf AS collection_confidence, len(list_filter({_conditions().replace('rule_id', 'e.rule_id')}, lambda c: c.matched)) AS met
 FROM ev_records e JOIN inc i ON i.incident_key = e.k""")
add("evidence_context", r"""SELECT k AS evidence_key, kind, value, min(seq) AS first_seq FROM (
 SELECT k, seq, unnest(['source_ip', 'hostname', 'username', 'process', 'service', 'port']) AS kind, unnest([source_ip, hostname, username, process, service, regexp_extract(raw_log, 'DPT=(\d+)', 1)]) AS value FROM ev_rows)
 WHERE value <> '' GROUP BY ALL""")
for _n, _t in (("evidence_iocs", "ev_rows"), ("observation_iocs", "obs_rows")):
    add(_n, f"SELECT r.k AS evidence_key, x.ioc_type, x.value, arg_min(x.event_id, x.seq) AS source_event_id FROM {_t} r JOIN entry_iocs x USING (seq) GROUP BY ALL")
add("evidence_raw_refs", f"""SELECT k AS evidence_key, rn, event_id, raw_log, entry_severity AS severity, {bar('rules')} AS detection_rule_ids FROM (
 SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM ev_rows) WHERE rn <= 50""")
add("observations", "SELECT 'OBS-' || k AS observation_id, 'OPEN' AS status, events AS event_count, conf AS collection_confidence FROM obs_records")
add("collection_confidence", "SELECT k AS incident_key, conf AS collection_confidence FROM ev_records")
add("promote_observations", """SELECT 'OBS-' || k AS observation_id, CASE WHEN p THEN 'PROMOTED' ELSE 'OPEN' END AS status, p AS promoted, CASE WHEN rule_id = 'R013' THEN 'by-hand' END AS promoted_to_incident_id
 FROM (SELECT *, events >= 3 OR alerts >= 2 OR rule_id = 'R013' AS p FROM obs_records)""")
add("ioc_panel", """SELECT ioc_type, value, 1::BIGINT AS occurrences FROM (SELECT x.ioc_type, x.value, min(x.seq * 1000 + x.i) AS pos1 FROM ev_rows r JOIN entry_iocs x USING (seq)
 WHERE k = 'brute_force:10.0.0.1' GROUP BY ALL) ORDER BY pos1 LIMIT 25""")
add("investigation_queue", f"""SELECT id, type, rule_name, severity, source_ip, username, event_count, len(list_filter(m, lambda c: c.matched)) AS conditions_met, len(m) AS conditions_total, time_window, confidence FROM (
 SELECT 'EV-' || k AS id, 'evidence' AS type, coalesce(rule_name, '') AS rule_name, i.severity, coalesce(any_ip, '-') AS source_ip, coalesce(any_user, '-') AS username, e.events AS event_count,
  strftime(e.first_seen, '%H:%M:%S') || ' - ' || strftime(e.last_seen, '%H:%M:%S') AS time_window, conf AS confidence FROM ev_records e JOIN inc i ON i.incident_key = k
 UNION ALL SELECT 'OBS-' || k, 'observation', rule_name, rule_severity, coalesce(any_ip, '-'), coalesce(any_user, '-'), events, strftime(first_seen, '%H:%M:%S') || ' - ' || strftime(last_seen, '%H:%M:%S'), conf
 FROM obs_records WHERE NOT (events >= 3 OR alerts >= 2)) JOIN conditions c ON c.evidence_id = id ORDER BY event_count DESC, type, id LIMIT 8""")
add("session_stats", """SELECT source_file, events, coalesce(alerts, 0) AS alerts, coalesce(incidents, 0) AS incidents FROM (SELECT log_format AS source_file, count(*) AS events FROM entries GROUP BY ALL)
 LEFT JOIN (SELECT log_format AS source_file, count(*) AS alerts FROM alerts GROUP BY ALL) USING (source_file)
 LEFT JOIN (SELECT e.log_format AS source_file, count(*) AS incidents FROM scored JOIN entries e ON e.seq = admitted_seq GROUP BY ALL) USING (source_file)""")
add("pipeline_health", """SELECT ord::BIGINT AS ord, stage, CASE WHEN active THEN 'active' ELSE 'idle' END AS status, processed, total FROM (
 SELECT 0 AS ord, 'monitoring' AS stage, FALSE AS active, (SELECT count(*) FROM entries) AS processed, NULL::BIGINT AS total
 UNION ALL SELECT 1, 'parser', (SELECT count(*) FROM entries) > 0, (SELECT count(*) FROM entries), NULL
 UNION ALL SELECT 2, 'detection', (SELECT count(*) FROM alerts) > 0, (SELECT count(*) FROM alerts), NULL
 UNION ALL SELECT 3, 'correlation', (SELECT count(*) FROM listed) > 0, (SELECT count(*) FROM listed), NULL
 UNION ALL SELECT 4, 'analysis', (SELECT count(*) FROM queue) > 0, (SELECT count(*) FROM queue), NULL
 UNION ALL SELECT 5, 'investigation', (SELECT count(*) FROM queue) > 0, (SELECT count(*) FROM queue WHERE status = 'INVESTIGATING'), (SELECT count(*) FROM queue))""")
add("latest_critical", "SELECT incident_key, incident_type, threat_score, events AS total_events FROM listed WHERE severity = 'CRITICAL' AND status = 'ACTIVE' ORDER BY last_seq DESC, ord DESC LIMIT 1")
add("confidence", "SELECT incident_key, confidence FROM scored")
add("risk", "SELECT incident_key, risk FROM scored")
add("threat_score", "SELECT incident_key, threat_score, " + ", ".join(n for n, _ in _W) + " FROM scored")
add("attack_chain", f"""SELECT incident_key, chain_id AS attack_chain_id, chain_stage AS attack_chain_stage, progress AS attack_chain_progress, {bar('done')} AS attack_chain_stages_completed,
 {bar('todo')} AS attack_chain_stages_missing, objective AS estimated_objective FROM chained""")
add("chain_list", f"""SELECT 'CHAIN-' || chain || ':' || attacker AS chain_id, chain_name, chain AS chain_type, {bar('list_filter(stages, lambda s: list_contains(seen, s))')} AS stages_completed,
 {bar('list_filter(stages, lambda s: NOT list_contains(seen, s))')} AS stages_missing, (len(seen) * 100.0 / len(stages))::DOUBLE AS progress, objective, incident_count, {ts('i.first_seen')} AS first_seen FROM (
 SELECT chain, attacker, list(DISTINCT stage) AS seen, any_value(stages) AS stages, any_value(chain_name) AS chain_name, any_value(objective) AS objective, count(DISTINCT incident_key) AS incident_count,
   arg_min(incident_key, seq * 10 + ord) AS opener FROM keyed JOIN chain_defs USING (chain) WHERE attacker <> '' GROUP BY ALL) JOIN inc i ON i.incident_key = opener""")
_TOP5 = "array_to_string((list_sort(list_distinct({})))[1:5], ', ')"
add("behaviour_findings", f"""WITH f AS (SELECT p.incident_key, p.source_ip AS ip, (SELECT count(*) FROM entries e WHERE e.source_ip = p.source_ip AND e.seq <= p.last_seq) AS events,
  (SELECT list(DISTINCT username) FROM entries e WHERE e.source_ip = p.source_ip AND e.seq <= p.last_seq AND username <> '') AS users,
  (SELECT count(*) FROM auth_seq a WHERE a.source_ip = p.source_ip AND a.seq <= p.last_seq) AS auths,
  (SELECT min(gap) FROM auth_seq a WHERE a.source_ip = p.source_ip AND a.seq <= p.last_seq) AS gap,
  (SELECT count(*) FROM alerts a WHERE a.source_ip = p.source_ip AND a.rule_id = 'R010' AND a.seq <= p.last_seq) AS blocks FROM ip_points p),
 u AS (SELECT i.incident_key, target_user, (SELECT list(DISTINCT source_ip) FROM entries e WHERE e.username = i.target_user AND e.seq <= i.last_seq AND source_ip <> '') AS ips FROM inc i WHERE target_user <> ''),
 s AS (SELECT i.incident_key, e.service, count(*) AS n FROM inc i JOIN hits h ON h.rule_id = 'R013' AND h.seq <= i.last_seq JOIN entries e ON e.seq = h.seq WHERE list_contains(i.rules, 'R013') GROUP BY ALL)
 SELECT incident_key, 1::BIGINT AS part, 'IP ' || ip || ' targeted ' || len(users) || ' different users (' || {_TOP5.format('users')} || '), indicating automated credential scanning.' AS finding FROM f WHERE len(users) >= 3
 UNION ALL SELECT incident_key, 1, 'IP ' || ip || ' generated ' || events || ' events total, indicating sustained malicious activity.' FROM f WHERE events >= 20
 UNION ALL SELECT incident_key, 1, 'IP ' || ip || ' made authentication attempts with ' || format('{{:.2f}}', gap::DOUBLE) || 's intervals, impossible for human interaction — confirms automated tooling.' FROM f WHERE auths >= 3 AND gap < 0.5
 UNION ALL SELECT incident_key, 1, 'IP ' || ip || ' was blocked by the firewall ' || blocks || ' times, indicating persistent probing despite being blocked.' FROM f WHERE blocks >= 5
 UNION ALL SELECT incident_key, 2, 'User ''' || target_user || ''' was targeted from ' || len(ips) || ' different IPs (' || {_TOP5.format('ips')} || '), suggesting a coordinated or distributed attack.' FROM u WHERE len(ips) >= 3
 UNION ALL SELECT incident_key, 3, 'Service ''' || service || ''' restarted ' || n || ' times, abnormal frequency indicating possible DoS or instability.' FROM s WHERE n >= 5
 UNION ALL SELECT incident_key, 4, 'Attack generated ' || events || ' events in ' || d || 's (' || format('{{:.1f}}', events / greatest(d, 0.1::DOUBLE)) || ' events/sec), indicating high-speed automated attack.' FROM inc WHERE events >= 10 AND d < 60""")
_ips5 = "CASE WHEN len(ips) > 0 THEN array_to_string(ips[1:5], ', ') ELSE 'unknown source' END"
_ips3 = _ips5.replace("1:5", "1:3")
_rate = "format('{:.1f}', events / greatest(d, 0.1::DOUBLE))"
add("reasoning", f"""SELECT incident_key, CASE ord
 WHEN 1 THEN 'The source IP ' || {_ips5} || ' generated ' || events || ' failed SSH login attempts between ' || t1 || ' and ' || t2 || ' (' || d || ' seconds). This volume and frequency of authentication failures from a single source strongly indicates an automated brute-force attack.'
 WHEN 2 THEN 'The source IP ' || {_ips5} || ' made multiple failed authentication attempts targeting user ''' || usr || ''', followed by a successful login at ' || t2 || '. The pattern of repeated failures immediately preceding a success indicates a high probability of credential compromise through brute-force.'
 WHEN 3 THEN 'The source IP ' || {_ips5} || ' probed multiple unique paths on the web server within a short time window (' || t1 || ' to ' || t2 || '). This systematic enumeration pattern is consistent with automated directory scanning or vulnerability assessment tooling.'
 WHEN 4 THEN 'User ''' || usr || ''' executed privilege escalation commands between ' || t1 || ' and ' || t2 || '. ' || events || ' escalation events were recorded. This activity should be verified as authorized.'
 ELSE 'A system service experienced ' || events || ' failures between ' || t1 || ' and ' || t2 || ' (' || d || ' seconds). Repeated crashes within a short window may indicate resource exhaustion, malicious input, or a denial-of-service condition.' END
 || chr(10) || chr(10) || 'Detection was triggered by rules: ' || coalesce(nullif(array_to_string(rules, ', '), ''), 'none') || '. MITRE ATT&CK techniques: ' || coalesce(nullif(array_to_string(mitre, ', '), ''), 'N/A') || '.'
 || chr(10) || chr(10) || why AS reasoning FROM scored""")


def _case(d: dict) -> str:
    return "CASE incident_type " + " ".join(f"WHEN {_q(k)} THEN [{', '.join(map(_q, v))}]" for k, v in d.items()) + " END"


add("recommendations", f"""SELECT incident_key, array_to_string(list_concat(CASE severity WHEN 'CRITICAL' THEN [{_q(dims.URGENT['CRITICAL'])}] WHEN 'HIGH' THEN [{_q(dims.URGENT['HIGH'])}] ELSE [] END,
 {_case(dims.RECOMMENDATIONS)}), '|') AS recommendations FROM scored""")
add("root_cause", f"""SELECT incident_key, CASE ord
 WHEN 1 THEN 'Repeated authentication failures (' || events || ' attempts) from ' || {_ips3} || ' over ' || d || ' seconds indicate an automated brute-force tool systematically guessing credentials. The attack density (' || {_rate} || ' attempts/sec) confirms non-human origin. Root cause: externally-facing SSH service without rate limiting or account lockout policy.'
 WHEN 2 THEN 'Successful authentication from ' || {_ips3} || ' immediately following multiple failed attempts targeting user ''' || usr || ''' indicates credential compromise through brute-force. The attacker gained valid credentials after sustained password guessing. Root cause: weak or reused password on account ''' || usr || ''' combined with absence of multi-factor authentication.'
 WHEN 3 THEN 'Systematic probing of ' || events || ' web paths from ' || {_ips3} || ' within ' || d || ' seconds indicates automated directory enumeration. The attacker is mapping the application''s attack surface before attempting exploitation. Root cause: web server exposes enumerable endpoints without WAF-level rate limiting or path-based access controls.'
 WHEN 4 THEN 'User ''' || usr || ''' executed ' || events || ' privilege escalation commands between ' || t1 || ' and ' || t2 || '. This may indicate a compromised account being used to escalate from standard to administrative access. Root cause: overly permissive sudo configuration or compromised credentials for a user with escalation rights.'
 ELSE 'Service experienced ' || events || ' failures in ' || d || ' seconds. Repeated crashes in rapid succession may indicate resource exhaustion, malicious input causing segfaults, or a deliberate denial-of-service attack. Root cause: service lacks input validation or resource limits, or is under active DoS attack.' END AS root_cause FROM scored""")
_EXEC = """'A ' || severity || '-severity ' || incident_type || ' incident was detected with ' || format('{:.1f}', confidence) || '% confidence. The attack originated from '
 || CASE WHEN len(ips) > 0 THEN array_to_string(ips[1:2], ', ') ELSE 'unknown' END || ' targeting ' || coalesce(target_user, 'N/A') || '. ' || events || ' events were correlated across ' || len(rules)
 || ' detection rules. Immediate investigation and response are ' || CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'required' ELSE 'recommended' END || '.'"""
add("executive_summary", f"SELECT incident_key, {_EXEC} AS executive_summary FROM scored")
_TECH = """'Incident ' || incident_key || ': ' || incident_type || ' | Severity: ' || severity || ' | Confidence: ' || format('{:.1f}', confidence) || '% | Risk: ' || risk || ' | Events: ' || events || ' | Duration: ' || d
 || 's | Rules: ' || coalesce(array_to_string(rules[1:5], ', '), '') || ' | MITRE ATT&CK: ' || coalesce(nullif(array_to_string(mitre[1:5], ', '), ''), 'None mapped') || ' | Sources: ' || coalesce(array_to_string(ips[1:5], ', '), '')
 || ' | Target: ' || coalesce(target_user, 'N/A')"""
add("technical_summary", f"SELECT incident_key, {_TECH} AS technical_summary FROM scored")
_NAMES = "CASE x " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in dims.TECHNIQUES.items()) + " ELSE 'Unknown Technique' END"
add("mitre_summary", f"""SELECT incident_key, CASE WHEN len(mitre) = 0 THEN 'No MITRE ATT&CK techniques mapped for this incident.' ELSE 'MITRE ATT&CK Techniques:' || chr(10)
 || array_to_string(list_transform(mitre, lambda x: '  • ' || x || ': ' || {_NAMES}), chr(10)) END AS mitre_summary FROM scored""")
_SMART = ("CASE incident_type " + " ".join(
    f"WHEN {_q(k)} THEN [" + ", ".join("{'action': %s, 'priority': %s, 'reason': %s, 'impact': %s}" % tuple(map(_q, r)) for r in v) + "]"
    for k, v in dims.SMART_RECOMMENDATIONS.items()) + " END")
_URG = "{'action': %s, 'priority': %s, 'reason': %s, 'impact': %s}" % tuple(map(_q, dims.SMART_URGENT))
add("smart_recommendations", f"""SELECT incident_key, i - 1 AS i, r.action, r.priority, r.reason, r.impact FROM (SELECT incident_key, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM (
 SELECT incident_key, CASE WHEN progress > 50 THEN list_concat(list_append(l[1:1], {{'action': 'Attack chain ' || format('{{:.0f}}', progress) || '% complete — prioritize containment', 'priority': 'CRITICAL',
  'reason': 'Attacker has progressed through ' || len(done) || ' stages', 'impact': {_q(dims.SMART_CHAIN_IMPACT)}}}), l[2:]) ELSE l END AS l FROM (
 SELECT *, CASE WHEN severity = 'CRITICAL' THEN list_concat([{_URG}], {_SMART}) ELSE {_SMART} END AS l FROM scored)))""")
_NARR = """SELECT incident_key, 'Attack narrative for ' || any_value(incident_type) || ':' || chr(10) || string_agg('  [' || strftime(ts, '%H:%M:%S') || '] ' || description, chr(10) ORDER BY seq, sub) FILTER (rn <= 15)
 || CASE WHEN count(*) > 15 THEN chr(10) || '  ... and ' || (count(*) - 15) || ' additional events.' ELSE '' END AS attack_narrative
 FROM (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY seq, sub) AS rn FROM timeline) GROUP BY incident_key"""
add("attack_narrative", _NARR)
add("affected_assets", """SELECT incident_key, 1::BIGINT AS part, 'IP: ' || source_ip || ' (attacker)' AS asset FROM sources UNION ALL SELECT incident_key, 2, 'User: ' || target_user || ' (target)' FROM inc WHERE target_user <> ''
 UNION ALL SELECT DISTINCT incident_key, 3, 'Service: ' || s FROM timeline JOIN (SELECT unnest(['sshd', 'apache', 'nginx', 'httpd', 'mysql', 'sudo']) AS s) ON contains(lower(description), s)""")
add("matched_conditions", "SELECT evidence_id, i - 1 AS i, x.condition, x.matched, x.value FROM (SELECT evidence_id, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM conditions)")
add("insights", f"""SELECT incident_key, executive_summary, technical_summary, attack_narrative, root_cause, mitre_summary, attack_chain_id, attack_chain_stage, attack_chain_progress, attack_chain_stages_completed,
 attack_chain_stages_missing, estimated_objective, s.threat_score, q.priority FROM (SELECT incident_key, {_EXEC} AS executive_summary, {_TECH} AS technical_summary, chain_id AS attack_chain_id, chain_stage AS attack_chain_stage,
 progress AS attack_chain_progress, {bar('done')} AS attack_chain_stages_completed, {bar('todo')} AS attack_chain_stages_missing, objective AS estimated_objective, threat_score FROM scored) s
 JOIN ({_NARR}) n USING (incident_key) JOIN ({ORACLE['root_cause'].split(chr(10) + 'SELECT incident_key', 1)[1].join(['SELECT incident_key', ''])}) r USING (incident_key)
 JOIN ({ORACLE['mitre_summary'].split(chr(10) + 'SELECT incident_key', 1)[1].join(['SELECT incident_key', ''])}) m USING (incident_key) LEFT JOIN (SELECT incident_key, priority FROM queue) q USING (incident_key)""")
add("extract_iocs", "SELECT seq, i, ioc_type, value FROM entry_iocs")
for _n, _t, _k, _c in (("extract_iocs_documents", "documents", "doc_id", "text"), ("extract_iocs_pages", "pages", "page_id", "html")):
    ORACLE[_n] = (f"SELECT {_k}, x.ioc_type, x.value FROM (SELECT {_k}, unnest(list_distinct(list_filter({_text_iocs(_c)}, lambda x: x.value <> ''))) AS x FROM {_t})")
add("top_iocs", "SELECT ioc_type, value, confidence, occurrences FROM relationships ORDER BY confidence DESC, occurrences DESC, ioc_type, value LIMIT 20")
add("ioc_lookup", f"SELECT {_REL} FROM relationships WHERE ioc_type = 'ipv4' AND value = '10.0.0.3'")
add("incidents_sorted", f"SELECT incident_key, severity, {ts('last_seen')} AS last_seen FROM scored WHERE listed")
add("latest_n", "SELECT seq, event_id FROM entries ORDER BY seq DESC LIMIT 1000")
add("session_history", f"""SELECT 'monitor' AS session_id, 'live_folder' AS source_type, {ts('min(ts)')} AS start_time, count(*) AS events_processed, NULL::BIGINT AS events FROM entries
 UNION ALL SELECT 'upload-' || log_format, 'upload', {ts('min(ts)')}, NULL, count(*) FROM entries GROUP BY log_format""")
add("graph_nodes_edges", "SELECT source, target, type FROM edges")
add("graph_nodes", "SELECT id, type, label FROM nodes")
add("graph_neighbors", "SELECT source, target, type FROM edges WHERE source = (SELECT arg_min(event_id, seq) FROM alerts)")
add("graph_subgraph_nodes", "SELECT id, type, label FROM nodes WHERE id IN (SELECT id FROM reach)")
add("graph_subgraph_edges", "SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM reach)")
add("graph_counts", "SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL")
add("apply_alert_actions", "SELECT alert_id, CASE WHEN rule_id = 'R004' AND seq % 2 = 0 THEN 'RESOLVED' WHEN rule_id = 'R004' THEN 'ACKNOWLEDGED' ELSE 'ACTIVE' END AS status FROM alerts")
add("rejected_alert_actions", """SELECT alert_id, 'hide' AS action, 'unknown action' AS reason FROM alerts WHERE rule_id = 'R007'
 UNION ALL SELECT alert_id || '-x', 'resolve', 'unknown alert' FROM alerts WHERE rule_id = 'R008'""")
add("apply_incident_actions", "SELECT incident_key, CASE ord WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'CLOSED' ELSE 'ACTIVE' END AS status FROM inc")
add("rejected_incident_actions", """SELECT incident_key AS incident_id, 'close' AS action, 'not allowed in status INVESTIGATING' AS reason FROM inc WHERE ord = 1
 UNION ALL SELECT incident_key, 'dismiss', 'unknown action' FROM inc WHERE ord = 5""")
add("read_lines", "SELECT value FROM lines")
add("stream_lines", "SELECT value, 1::BIGINT AS n FROM lines")
add("start_from", "SELECT '2000' AS since, count(*) AS n FROM lines UNION ALL SELECT '2999', 0")
add("stream_detect", "SELECT seq, rule_id, n AS event_count FROM hits")
add("stream_correlate", "SELECT incident_key, seq, n FROM updates")
add("stream_counts", f"""SELECT {ts('m')} AS window_start, '1 minute' AS size, count(*) AS n FROM (SELECT date_trunc('minute', ts) AS m FROM entries) GROUP BY ALL
 UNION ALL SELECT {ts('m - to_minutes(b)')}, '5 minutes', count(*) FROM (SELECT date_trunc('minute', ts) AS m, unnest([0, 1, 2, 3, 4]) AS b FROM entries) GROUP BY ALL""")
add("stream_rate", f"""SELECT k AS batch_id, sum(count(*)) OVER (ORDER BY k)::BIGINT AS lines, {ts('max(max(ts)) OVER (ORDER BY k)')} AS last_event_time, TRUE AS measured FROM (
 SELECT e.ts, ((e.seq - lo) // step)::BIGINT AS k FROM entries e, (SELECT min(seq) AS lo, (max(seq) - min(seq)) // 2 + 1 AS step FROM lines)) GROUP BY k""")
