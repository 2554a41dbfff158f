"""Later rules: more personal data, vendor secrets, injection.

Rows: source, category, name, severity, flags, compliance, pattern. Patterns are in the syntax of ECMAScript.
"""

# Results depend on them, character by character.
RULES = (
    ("extended", "pii_passport", "pii_passport_v2", "high", "gi", (), '\\b(?:passport(?:\\s*(?:no|number|num|#))?|passportno|pass\\s*no)\\b[\\s,:#\\-]*(?:is[\\s,:#\\-]+)?([A-Z]{1,2}\\d{6,9}|\\d{9}|[A-Z]\\d{7,8})\\b'),
    ("extended", "pii_mrn", "pii_mrn_v2", "high", "gi", (), '\\b(?:mrn|med(?:ical)?\\s*rec(?:ord)?(?:\\s*(?:no|number|#))?)\\s*[:#]?\\s*\\d{6,10}\\b'),
    ("extended", "pii_full_name", "pii_full_name_v2", "medium", "gi", (), '(?:my\\s+name\\s+is\\s+|patient\\s*[:\\-]\\s*|dr\\.?\\s+|mr\\.?\\s+|mrs\\.?\\s+|ms\\.?\\s+)([A-Z][a-z]+\\s+[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)\\b'),
    ("extended", "pii_address", "pii_address_v2", "medium", "gi", (), '\\b\\d{1,5}\\s+([A-Z][a-z]+\\s+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Plaza|Square|Sq|Way|Terrace|Ter)\\.?(?:,?\\s*(?:Apt|Apartment|Unit|Suite|Ste)\\.?\\s*\\d+[A-Z]?)?,\\s*[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?,?\\s*[A-Z]{2}\\s*\\d{5}(?:-\\d{4})?\\b'),
    ("extended", "pii_routing", "pii_routing_v2", "medium", "gi", (), '\\b(?:aba(?:\\s*routing)?|routing(?:\\s*(?:no|number|#))?|rtg(?:\\s*#)?|ach\\s*routing)\\s*[:#]?\\s*(\\d{9})\\b'),
    ("extended", "pii_health_v2", "pii_health_v2", "high", "gi", (), '\\b(?:icd(?:-?10)?\\s*[:#]?\\s*[A-TV-Z][0-9][0-9AB](\\.[0-9A-Z]{1,4})?|diagnosis\\s*[:\\-]?\\s*(?:type\\s+[12]\\s+)?diabetes|(?:type\\s+[12]\\s+)?diabetes|cancer(?:\\s+(?:of|stage))?|hypertension|asthma|hiv|covid(?:-\\d+)?|tuberculosis|TB|depression|anxiety)\\b'),
    ("extended", "pii_ipv6", "pii_ipv6_v2", "low", "g", (), '\\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\\b|\\b(?:[0-9a-fA-F]{1,4}:){1,7}:\\b|\\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\\b'),
    ("extended", "pii_bank_account_v2", "pii_bank_account_v2", "critical", "gi", (), '\\b(?:bank|account|acct|savings|checking|routing)\\s*(?:#|no|num|number)?\\s*[:#]?\\s*\\d{8,17}\\b'),
    ("extended", "pii_health_v3", "pii_health_v3", "critical", "gi", (), '\\b(?:diagnosis|dx|condition|hx|history|medical\\s*history|health\\s*record)\\s*[:\\-]?\\s*(?=[A-Z][A-Za-z0-9.\\-]*(?:\\s+[A-Za-z0-9.\\-]+){0,10})'),
    ("extended", "pii_health_disease", "pii_health_disease", "high", "gi", (), '\\b(?:type\\s+[12]\\s+diabetes|hypertension|asthma|cancer\\s+(?:of|stage)|hiv|covid(?:-\\d+)?|tuberculosis|TB|depression|anxiety|cardiac\\s+arrest|stroke|seizure)\\b'),
    ("extended", "pii_full_name_v3", "pii_full_name_v3", "medium", "gi", (), '(?:^|[:\\s])(?:my\\s+name\\s+is\\s+|patient\\s*[:\\-]\\s*|dr\\.?\\s+|mr\\.?\\s+|mrs\\.?\\s+|ms\\.?\\s+|name\\s*[:\\-]\\s*|hello[,.]?\\s+my\\s+name\\s+is\\s+)([A-Z][a-z]+\\s+[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)(?:[,;\\n]|$)'),
    ("extended", "pii_health_plan_id", "pii_health_plan_id", "high", "g", (), '\\b[A-Z]\\d{7}\\b'),
    ("extended", "pii_zip_plus_four", "pii_zip_plus_four", "medium", "g", (), '\\b\\d{5}[-\\s]\\d{4}\\b'),
    ("extended", "pii_npi", "pii_npi", "high", "gi", (), '\\b(?:npi[\\s:#-]*|national\\s*provider\\s*identifier[\\s:#-]*)(\\d{10})\\b'),
    ("extended", "pii_hipaa_term", "pii_hipaa_term", "medium", "gi", (), '\\b(?:hipaa|protected\\s+health\\s+information|\\bphi\\b|covered\\s+entity|business\\s+associate|breach\\s+notification|ePHI)\\b'),
    ("extended", "pii_card_cvv", "pii_card_cvv", "critical", "gi", (), '\\bcvv2?[\\s:#-]*\\d{3,4}\\b|\\bcvc2?[\\s:#-]*\\d{3,4}\\b'),
    ("extended", "pii_card_expiry", "pii_card_expiry", "high", "gi", (), '\\b(?:exp(?:ir(?:y|ation|ed))?\\s*(?:date)?|expir(?:y|ation|ed|es|ing)?\\s*(?:date|on)?|valid\\s*(?:thru|through|until))\\s*[:\\-]?\\s*(?:0[1-9]|1[0-2])[\\-\\/](\\d{2}|\\d{4})\\b'),
    ("extended", "secret_github_pat", "secret_github_pat_v2", "critical", "g", (), '\\bghp_[A-Za-z0-9]{36}\\b'),
    ("extended", "secret_gitlab_pat", "secret_gitlab_pat_v2", "critical", "g", (), '\\bglpat-[A-Za-z0-9_\\-]{20,}\\b'),
    ("extended", "secret_slack_token", "secret_slack_token_v2", "critical", "g", (), '\\bxox[bpars]-[A-Za-z0-9-]{10,}\\b'),
    ("extended", "secret_slack_webhook", "secret_slack_webhook_v2", "high", "g", (), 'https:\\/\\/hooks\\.slack\\.com\\/services\\/T[A-Z0-9]+\\/B[A-Z0-9]+\\/[A-Za-z0-9]+'),
    ("extended", "secret_notion", "secret_notion_v2", "critical", "g", (), '\\b(?:ntn_[A-Za-z0-9]{43}|secret_[A-Za-z0-9]{43})\\b'),
    ("extended", "secret_figma", "secret_figma_v2", "high", "g", (), '\\bfig[dp]_[A-Za-z0-9_-]{20,}\\b'),
    ("extended", "secret_discord", "secret_discord_v2", "critical", "g", (), '\\b[MN][A-Za-z\\d]{23,}\\.[A-Za-z\\d-_]{6,7}\\.[A-Za-z\\d-_]{27,}\\b'),
    ("extended", "secret_mailgun", "secret_mailgun_v2", "high", "g", (), '\\bkey-[a-fA-F0-9]{24,32}\\b'),
    ("extended", "secret_github_oauth", "secret_github_oauth_v2", "critical", "g", (), '\\bgho_[A-Za-z0-9]{36}\\b'),
    ("extended", "secret_github_app", "secret_github_app_v2", "critical", "g", (), '\\b(?:ghu|ghs)_[A-Za-z0-9]{36,251}\\b'),
    ("extended", "secret_google_api_v2", "secret_google_api_v2", "critical", "g", (), '\\bAIza[0-9A-Za-z_-]{35}\\b'),
    ("extended", "secret_aws_secret_key", "secret_aws_secret_key", "critical", "gi", (), '(?:aws[_-]?secret[_-]?access[_-]?key|aws[_-]?sk)[\\s=:]+\\s*([A-Za-z0-9/+=]{40})\\b'),
    ("extended", "secret_anthropic_v2", "secret_anthropic_v2", "critical", "g", (), '\\bsk-ant-api03-[A-Za-z0-9_-]{32,}\\b'),
    ("extended", "secret_slack_tokens", "secret_slack_tokens", "critical", "g", (), '\\bxox[bpars]-[A-Za-z0-9-]{10,}\\b'),
    ("extended", "secret_stripe_live", "secret_stripe_live", "critical", "g", (), '\\bsk_live_[A-Za-z0-9]{20,}\\b'),
    ("extended", "secret_twilio_sid", "secret_twilio_sid", "high", "g", (), '\\bAC[a-f0-9]{32}\\b'),
    ("extended", "owasp_sensitive_disclosure", "owasp_sensitive_disclosure_v1", "high", "gi", (), '\\b(?:social\\s+security|ssn|passport\\s+number|credit\\s+card\\s+number|bank\\s+account\\s+number)\\b'),
    ("extended", "owasp_credential_request", "owasp_credential_request_v1", "critical", "gi", (), '\\b(?:password|secret|api\\s+key|token|credential|auth)\\s+(?:for|of|to)\\b'),
    ("extended", "secret_aws_session_token", "secret_aws_session_token_v1", "critical", "g", (), '\\bASIA[A-Z0-9]{16}\\b'),
    ("extended", "secret_cloudflare_api", "secret_cloudflare_api_v1", "critical", "g", (), '\\b[a-f0-9]{37}\\b'),
    ("extended", "secret_digitalocean_pat", "secret_digitalocean_pat_v1", "critical", "g", (), '\\bdop_v1_[a-f0-9]{60,80}\\b'),
    ("extended", "secret_heroku_api", "secret_heroku_api_v1", "critical", "gi", (), '(?:heroku[\\s_-]?api[\\s_-]?key[\\s:#=]+|HRKU[\\s_-]?)[A-Za-z0-9\\-]{32,}'),
    ("extended", "secret_npm_token", "secret_npm_token_v1", "critical", "g", (), '\\bnpm_[A-Za-z0-9]{36}\\b'),
    ("extended", "secret_pypi_token", "secret_pypi_token_v1", "critical", "g", (), '\\bpypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}\\b'),
    ("extended", "secret_supabase_key", "secret_supabase_key_v1", "critical", "g", (), '\\bsb_(?:secret|publishable)_[A-Za-z0-9_-]{20,}\\b'),
    ("extended", "secret_telegram_bot", "secret_telegram_bot_v1", "critical", "g", (), '\\b[0-9]{6,12}:AA[A-Za-z0-9_-]{30,}\\b'),
    ("extended", "secret_vault_token", "secret_vault_token_v1", "critical", "g", (), '\\bs\\.[A-Za-z0-9]{24,}\\b'),
    ("extended", "secret_bitcoin_address", "secret_bitcoin_address_v1", "medium", "g", (), '\\b(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[ac-hj-np-z02-9]{11,71})\\b'),
    ("extended", "secret_ethereum_address", "secret_ethereum_address_v1", "medium", "g", (), '\\b0x[a-fA-F0-9]{40}\\b'),
    ("extended", "secret_docker_auth", "secret_docker_auth_v1", "high", "g", (), '"auths":\\s*\\{\\s*"[^"]+":\\s*\\{\\s*"auth":\\s*"[A-Za-z0-9+/=]{40,}"'),
    ("extended", "xss_script", "xss_script_v2", "critical", "is", (), '<\\s*script[^>]*>(?:(?!<\\/\\s*script\\s*>).)*?(?:alert|eval|prompt|confirm|document\\.write|window\\.location|fetch\\s*\\(|new\\s+Function|atob\\s*\\()'),
    ("extended", "xss_event_handler", "xss_event_handler_v2", "critical", "gi", (), '\\bon(?:error|load|click|mouseover|focus|blur|submit|change|keydown|keypress|keyup)\\s*=\\s*(?:["\'][^"\']*(?:alert|eval|prompt|document\\.|window\\.|fetch\\s*\\()[^"\']*["\']|[^\\s>]+)'),
    ("extended", "xss_javascript_url", "xss_javascript_url_v2", "critical", "gi", (), '(?:href|src|action|formaction)\\s*=\\s*["\']?\\s*javascript\\s*:'),
    ("extended", "xss_data_uri", "xss_data_uri_v2", "critical", "gi", (), '(?:href|src|iframe\\s+src)\\s*=\\s*["\']?\\s*data\\s*:\\s*(?:text\\/html|application\\/javascript|application\\/xhtml\\+xml)\\s*,'),
    ("extended", "xss_svg", "xss_svg_v2", "critical", "is", (), '<\\s*svg[^>]*>[\\s\\S]*?<script[\\s>]|<\\s*svg[^>]*>[\\s\\S]*?on\\w+\\s*=\\s*["\'][^"\']*(?:alert|eval|prompt)'),
    ("extended", "xss_markdown_image", "xss_markdown_image_v2", "high", "gi", (), '!\\[[^\\]]*\\]\\s*\\(\\s*(?:javascript|vbscript|data)\\s*:'),
    ("extended", "xss_css_injection", "xss_css_injection_v2", "high", "gi", (), '(?:style\\s*=\\s*["\'][^"\']*expression\\s*\\(|style\\s*=\\s*[^>]*(?:behavior\\s*:|-moz-binding)\\s*:)'),
    ("extended", "sqli_union", "sqli_union_v1", "critical", "gi", (), '\\bunion\\s+(?:all\\s+)?select\\b'),
    ("extended", "sqli_or_true", "sqli_or_true_v1", "critical", "gi", (), '\\b(?:or|and)\\s+["\\\']?\\d+["\\\']?\\s*=\\s*["\\\']?\\d+["\\\']?'),
    ("extended", "sqli_stacked", "sqli_stacked_v1", "critical", "gi", (), ';\\s*(?:drop|delete|truncate|update|insert|alter)\\s+(?:table|database|schema)\\b'),
    ("extended", "sqli_comment", "sqli_comment_v1", "high", "gi", (), '(?:[\'"](?:\\s|--|\\/\\*))\\s*(?:or|and|union|select|drop|insert|update|delete)\\b'),
    ("extended", "sqli_time_based", "sqli_time_based_v1", "critical", "gi", (), '\\bwaitfor\\s+delay\\s+[\'"][\\d:]+[\'"]'),
    ("extended", "cmdi_metachar", "cmdi_metachar_v1", "critical", "gi", (), '[;&|`]\\s*(?:rm|cat|wget|curl|nc|bash|sh|cmd|powershell)\\s+-?[a-z]'),
    ("extended", "cmdi_substitution", "cmdi_substitution_v1", "critical", "g", (), '\\$\\([^)]*\\)|`[^`]+`'),
    ("extended", "path_traversal", "path_traversal_v1", "high", "g", (), '(?:\\.\\.[\\\\/]){2,}'),
    ("extended", "path_traversal_encoded", "path_traversal_encoded_v1", "high", "gi", (), '%2e%2e[\\/%5c]|\\.\\.%2f|%2e%2e%2f'),
    ("extended", "xxe", "xxe_v1", "critical", "gi", (), '<!\\s*DOCTYPE[^>]*<!\\s*ENTITY'),
    ("extended", "ssrf_scheme", "ssrf_scheme_v1", "high", "gi", (), '(?:file|gopher|dict|ldap|jar|netdoc|tftp):\\/\\/[a-zA-Z0-9._-]+'),
    ("extended", "header_injection", "header_injection_v1", "high", "gi", (), '%0d%0a|%0a%0d|%0d%0d|\\\\r\\\\n'),
    ("extended", "ldapi", "ldapi_v1", "high", "gi", (), '\\)\\s*\\(\\s*(?:cn|uid|sn|mail|userPassword)=[*)](?:\\||$)'),
    ("extended", "nosqli", "nosqli_v1", "high", "gi", (), '\\$(?:ne|gt|lt|gte|lte|in|nin|eq|where|regex|exists|or|and)\\b'),
    ("extended", "ssti", "ssti_v1", "high", "g", (), '\\{\\{[^}]*(?:config|self|request|application)|\\$\\{[^}]*(?:env|java\\.runtime|JAVA_HOME)'),
    ("extended", "xss_iframe", "xss_iframe_v1", "high", "gi", (), '<\\s*iframe[^>]*(?:src|height|width)\\s*='),
    ("extended", "xss_object_embed", "xss_object_embed_v1", "high", "gi", (), '<\\s*(?:object|embed)[^>]*\\b(?:data|src|codebase)\\s*='),
    ("extended", "xss_meta_refresh", "xss_meta_refresh_v1", "medium", "gi", (), '<\\s*meta[^>]*http-equiv\\s*=\\s*["\']?refresh'),
    ("extended", "open_redirect", "open_redirect_v1", "high", "gi", (), '(?:location\\.href|window\\.location)\\s*=\\s*["\']?https?:\\/\\/[^"\']+'),
    ("extended", "encoded_payload", "encoded_payload_v1", "medium", "g", (), '[A-Za-z0-9+/]{40,}={0,2}'),
    ("extended", "proto_pollution", "proto_pollution_v1", "high", "gi", (), '(?:__proto__|constructor\\s*\\.\\s*prototype|prototype\\s*\\[\\s*[\'"]\\s*__proto__)'),
    ("extended", "insecure_deser", "insecure_deser_v1", "critical", "gi", (), '(?:yaml\\.load\\b[^;]*|pickle\\.loads?\\b[^;]*|marshal\\.loads?\\b)'),
    ("extended", "jwt_none", "jwt_none_alg_none_header_v1", "critical", "g", (), 'eyJhbGciOiJub25lIn0\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]*'),
    ("extended", "jwt_none", "jwt_none_empty_signature_v1", "critical", "g", (), 'eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.(?![A-Za-z0-9_-])'),
    ("extended", "jwt_none", "jwt_none_literal_none_signature_v1", "critical", "g", (), 'eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.none\\b'),
    ("extended", "ldap_inject", "ldap_inject_v1", "high", "gi", (), '[\\*\\\\)\\(\\|&]\\s*(?:uid|cn|userPassword|objectClass|member)\\s*=\\s*[\\*\\w]+'),
    ("extended", "hash_length_ext", "hash_length_ext_v1", "medium", "g", (), '&[a-zA-Z_]+=?(?:[a-f0-9]{32,64})&[a-zA-Z_]+=?(?:[a-f0-9]{32,64})'),
    ("extended", "xml_bomb", "xml_bomb_v1", "high", "gi", (), '<!\\s*ENTITY\\s+[a-zA-Z]+\\s+SYSTEM\\s+["\']?file:\\/\\/'),
)
