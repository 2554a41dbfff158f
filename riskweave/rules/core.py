"""The first rules: personal data, keys and markup.

Rows: source, category, name, severity, flags, compliance, pattern. Patterns are in the syntax of ECMAScript.
"""

# Results depend on them, character by character.
RULES = (
    ("core", "pii_email", "email_v1", "high", "gi", (), '[a-zA-Z0-9](?:[a-zA-Z0-9._%+-]{0,62}[a-zA-Z0-9])?@[a-zA-Z0-9](?:[a-zA-Z0-9.-]{0,253}[a-zA-Z0-9])?\\.[a-zA-Z]{2,}'),
    ("core", "pii_phone", "phone_na_v1", "high", "gi", (), '(?<![\\d\\w])\\+?1?[-.\\s]?\\(?[2-9][0-9]{2}\\)?[-.\\s]?[2-9][0-9]{2}[-.\\s]?[0-9]{4}(?![\\d])'),
    ("core", "pii_ssn", "ssn_v1", "critical", "gi", (), '(?!000|666|9\\d{2})\\d{3}[-\\s](?!00)\\d{2}[-\\s](?!0000)\\d{4}'),
    ("core", "pii_credit_card", "credit_card_visa_v1", "critical", "gi", (), '\\b4[0-9]{12}(?:[0-9]{3})?(?:[0-9]{3})?\\b'),
    ("core", "pii_credit_card", "credit_card_mastercard_v1", "critical", "gi", (), '\\b(?:5[1-5][0-9]{14}|2(?:2(?:2[1-9]|[3-9][0-9])|[3-6][0-9][0-9]|7(?:[01][0-9]|20))[0-9]{12})\\b'),
    ("core", "pii_credit_card", "credit_card_amex_v1", "critical", "gi", (), '\\b3[47][0-9]{13}\\b'),
    ("core", "secret_api_key", "aws_access_key_v1", "critical", "gi", (), 'AKIA[0-9A-Z]{16}'),
    ("core", "secret_api_key", "github_pat_v1", "critical", "gi", (), 'ghp_[a-zA-Z0-9]{36}'),
    ("core", "secret_api_key", "github_oauth_v1", "critical", "gi", (), 'gho_[a-zA-Z0-9]{36}'),
    ("core", "secret_api_key", "stripe_live_key_v1", "critical", "gi", (), 'sk_live_[a-zA-Z0-9]{24,}'),
    ("core", "secret_google_api_key", "google_api_key_v1", "critical", "gi", (), 'AIza[0-9A-Za-z\\-_]{35}'),
    ("core", "secret_private_key", "rsa_private_key_v1", "critical", "gi", (), '-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----'),
    ("core", "xss_payload", "xss_universal_v1", "critical", "gi", (), '<[a-z][a-z0-9-]{0,20}[\\s/>][^>]{0,300}\\bon[a-z]+\\s*=\\s*["\']?[a-z(]'),
    ("core", "xss_payload", "xss_anchor_href_v1", "critical", "gi", (), '<a\\s+[^>]{0,200}\\bhref\\s*=\\s*["\']?\\s*javascript\\s*:'),
    ("core", "xss_payload", "xss_css_import_v1", "critical", "gi", (), '<style\\b[^>]*>[^<]{0,500}@import\\s*["\']?\\s*javascript\\s*:'),
    ("core", "xss_payload", "xss_markdown_v1", "critical", "gi", (), '\\[[^\\]]*\\]\\([^)]*\\bon[a-z]+\\s*=\\s*["\']?[a-z(]'),
    ("core", "xss_payload", "xss_nested_tag_v1", "critical", "gi", (), '<(script|iframe|object|embed)\\b'),
    ("core", "xss_payload", "xss_js_url_v1", "critical", "gi", (), 'j\\W*a\\W*v\\W*a\\W*s\\W*c\\W*r\\W*i\\W*p\\W*t\\W*:[^<>]{0,500}(?:(?:alert|eval|prompt|confirm|Function|setTimeout|setInterval)\\s*\\(|(?:document|window|location)\\s*\\.|\\bon[a-z]+\\s*=)'),
    ("core", "source_code", "private_key_pem_v1", "critical", "gi", (), 'BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----(?:-----)?'),
)
