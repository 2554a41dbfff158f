"""Scanner rules: personal data, secrets, harmful content.

Rows: source, category, name, severity, flags, compliance, pattern. Patterns are in the syntax of ECMAScript.
"""

# Results depend on them, character by character.
RULES = (
    ("pii_scanner", "pii_bank_account", "pii_scanner_pii_bank_account_v1", "critical", "gi", ('SOC2', 'PCI-DSS'), '\\b(?:account|acct|acct#|savings|checking|accountnum|acctno):?\\s*\\d{8,17}\\b'),
    ("pii_scanner", "pii_credit_card", "pii_scanner_pii_credit_card_v1", "critical", "g", ('PCI-DSS',), '\\b(?:4[0-9]{3}[-\\s]?[0-9]{4}[-\\s]?[0-9]{4}[-\\s]?[0-9]{4}|5[1-5][0-9]{2}[-\\s]?[0-9]{4}[-\\s]?[0-9]{4}[-\\s]?[0-9]{4}|3[47][0-9]{2}[-\\s]?[0-9]{6}[-\\s]?[0-9]{5}|6(?:011|5[0-9]{2})[-\\s]?[0-9]{4}[-\\s]?[0-9]{4}[-\\s]?[0-9]{4})\\b'),
    ("pii_scanner", "pii_date_of_birth", "pii_scanner_pii_date_of_birth_v1", "medium", "gi", ('GDPR', 'SOC2'), '\\b(?:DOB|Date of Birth|Birth Date|Birthday|Born):?\\s*(?:\\d{1,2}[-/]\\d{1,2}[-/]\\d{2,4}|\\d{4}[-/]\\d{1,2}[-/]\\d{1,2})\\b'),
    ("pii_scanner", "pii_driver_license", "pii_scanner_pii_driver_license_v1", "medium", "gi", ('SOC2',), '\\b(?:dl|dl#|driverlic|driverlicno|driverlicense|driverlicensenum|licenseno):?\\s*[A-Z0-9]{5,20}\\b'),
    ("pii_scanner", "pii_email", "pii_scanner_pii_email_v1", "medium", "g", ('GDPR', 'SOC2'), '\\b[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}\\b'),
    ("pii_scanner", "pii_health", "pii_scanner_pii_health_v1", "critical", "gi", ('HIPAA',), '\\b(?:mrn|patient|health|medical|hipaa)\\b[^\\d]*\\d{5,12}'),
    ("pii_scanner", "pii_ip_address", "pii_scanner_pii_ip_address_v1", "low", "g", ('GDPR',), '\\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\b'),
    ("pii_scanner", "pii_phone", "pii_scanner_pii_phone_v1", "high", "g", ('GDPR', 'SOC2'), '(?<![\\d\\w])\\+?1?[-.\\s]?\\(?\\d{3}\\)?[-.\\s]\\d{3}[-.\\s]\\d{4}(?![\\d])'),
    ("pii_scanner", "pii_ssn", "pii_scanner_pii_ssn_v1", "critical", "g", ('SOC2', 'HIPAA', 'PCI-DSS'), '\\b(?:\\d{3}[-.\\s]?\\d{2}[-.\\s]?\\d{4}|\\d{9})\\b'),
    ("secret_detector", "secret_api_key", "secret_detector_secret_api_key_v1", "high", "gi", ('SOC2',), '(?:(?:sk_live_|sk_test_|rk_live_|rk_test_|FAKE_SK_)[a-zA-Z0-9]{20,}|ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{22,}|xox[baprs]-[0-9]{10,}-[0-9]{10,}-[a-zA-Z0-9]{24,})'),
    ("secret_detector", "secret_generic_api_key", "secret_detector_secret_generic_api_key_v1", "high", "gi", ('SOC2',), '(?:api[_-]?key|apikey)\\s*[=:]\\s*["\']?[a-zA-Z0-9_-]{20,}'),
    ("secret_detector", "secret_generic_token", "secret_detector_secret_generic_token_v1", "high", "gi", ('SOC2',), '(?:token|auth)\\s*[=:]\\s*["\']?[a-zA-Z0-9_-]{32,}'),
    ("secret_detector", "secret_openai_key", "secret_detector_secret_openai_key_v1", "high", "gi", ('SOC2',), '(?:sk-[a-zA-Z0-9]{48}|sk-proj-[a-zA-Z0-9_-]{48,})'),
    ("secret_detector", "secret_anthropic_key", "secret_detector_secret_anthropic_key_v1", "high", "gi", ('SOC2',), '(?:sk-ant-[a-zA-Z0-9]{48,})'),
    ("secret_detector", "secret_google_api_key", "secret_detector_secret_google_api_key_v1", "high", "gi", ('SOC2',), '(?:AIza[a-zA-Z0-9_-]{35})'),
    ("secret_detector", "secret_twilio_key", "secret_detector_secret_twilio_key_v1", "high", "gi", ('SOC2',), '(?:SK[0-9a-fA-F]{32})'),
    ("secret_detector", "secret_sendgrid_key", "secret_detector_secret_sendgrid_key_v1", "high", "gi", ('SOC2',), '(?:SG\\.[a-zA-Z0-9_-]{22}\\.[a-zA-Z0-9_-]{43})'),
    ("secret_detector", "secret_aws_key", "secret_detector_secret_aws_key_v1", "critical", "gi", ('SOC2', 'PCI-DSS'), '(?:AKIA[A-Z0-9]{16})'),
    ("secret_detector", "secret_bearer_token", "secret_detector_secret_bearer_token_v1", "high", "gi", ('SOC2',), 'Bearer\\s+[A-Za-z0-9_-]{20,}'),
    ("secret_detector", "secret_database_url", "secret_detector_secret_database_url_v1", "critical", "gi", ('SOC2', 'PCI-DSS', 'HIPAA'), '(?:postgres|mysql|mongodb|redis):\\/\\/[a-zA-Z0-9]+:[^@]+@'),
    ("secret_detector", "secret_encryption_key", "secret_detector_secret_encryption_key_v1", "low", "gi", (), '(?:encryption[_-]?key|enc_key)\\s*[=:]\\s*["\']?[a-zA-Z0-9+/=]{32,}'),
    ("secret_detector", "secret_jwt", "secret_detector_secret_jwt_v1", "low", "gi", (), '(?:eyJ[a-zA-Z0-9_-]*\\.eyJ[a-zA-Z0-9_-]*\\.[a-zA-Z0-9_-]*)'),
    ("secret_detector", "secret_oauth_token", "secret_detector_secret_oauth_token_v1", "high", "gi", ('SOC2',), '(?:oauth_token|access_token|refresh_token)\\s*[=:]\\s*["\']?[A-Za-z0-9_-]{20,}'),
    ("secret_detector", "secret_password", "secret_detector_secret_password_v1", "low", "gi", (), '(?:password|passwd|pwd)\\s*[=:]\\s*[^"\'\\s]{8,}'),
    ("secret_detector", "secret_private_key", "secret_detector_secret_private_key_v1", "critical", "gi", ('SOC2', 'PCI-DSS'), '-----BEGIN\\s+(?:RSA\\s+|EC\\s+|DSA\\s+|OPENSSH\\s+|PGP\\s+)?PRIVATE\\s+KEY-----'),
    ("secret_detector", "secret_webhook_secret", "secret_detector_secret_webhook_secret_v1", "medium", "gi", ('SOC2',), '(?:whsec_[a-zA-Z0-9]{32,})'),
    ("toxicity_filter", "toxicity_custom", "toxicity_filter_toxicity_custom_v1", "low", "g", (), '\\b\\d+%?\\s+(people|users|users?|percent|%)'),
    ("toxicity_filter", "harassment", "toxicity_filter_harassment_v1", "critical", "gi", (), '\\b(you\\s+are\\s+(stupid|dumb|ugly|worthless|inferior))\\b'),
    ("toxicity_filter", "illegal", "toxicity_filter_illegal_v1", "critical", "gi", (), '\\b(crack\\s*cocaine|heroin|meth|manufacture\\s*drug|illegal\\s*weapon)\\b'),
    ("toxicity_filter", "self_harm", "toxicity_filter_self_harm_v1", "critical", "gi", (), '\\b(suicide|self-harm|cut\\s*myself|kill\\s*myself|end\\s*my\\s*life)\\b'),
    ("toxicity_filter", "violence", "toxicity_filter_violence_v1", "critical", "gi", (), '\\b(kill|murder|assassinate|strangle|poison|shoot|stab|slit|dismember|butcher|slay)\\b'),
    ("toxicity_filter", "weapons", "toxicity_filter_weapons_v1", "critical", "gi", (), '\\b(bomb|explosive|grenade|machine\\s*gun|ak-47|ar-15|ricin|anthrax)\\b'),
)
