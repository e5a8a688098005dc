"""Query name of each rule, shared by the queries and their SQL."""

RULE_QUERIES = {
    "rule_invalid_user": ["R003"], "rule_root_login": ["R004"], "rule_priv_esc": ["R005"], "rule_sql_injection": ["R006"],
    "rule_dir_traversal": ["R007"], "rule_suspicious_ua": ["R008"], "rule_firewall_block": ["R010"],
    "rule_kernel_panic": ["R011"], "rule_disk_full": ["R012"], "rule_service_crash": ["R013"],
    "rule_failed_login_burst": ["R001", "R014"], "rule_login_after_failures": ["R002"], "rule_excessive_404": ["R015"],
}
