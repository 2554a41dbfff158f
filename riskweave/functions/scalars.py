"""Scalar expressions over findings, events, licenses, URLs and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

# Fixed values.
LABELS = {
    "pii_email": "Email address", "pii_phone": "Phone number", "prompt_injection_ml": "Prompt injection (ML detected)", "pii_ssn": "Social Security number", "pii_credit_card": "Credit card number", "pii_bank_account": "Bank account number",
    "pii_date_of_birth": "Date of birth", "pii_driver_license": "Driver license number", "pii_health": "Health / medical record", "pii_ip_address": "IP address",
    "secret_api_key": "API key or token", "source_code": "Source code (private key)", "xss_payload": "XSS payload (HTML/JavaScript injection)", "secret_aws_key": "AWS access key",
    "secret_bearer_token": "Bearer token", "secret_jwt": "JSON Web Token (JWT)", "secret_private_key": "Private cryptographic key", "secret_oauth_token": "OAuth access token",
    "secret_password": "Password", "secret_database_url": "Database connection string", "secret_encryption_key": "Encryption key", "secret_webhook_secret": "Webhook signing secret",
    "secret_openai_key": "OpenAI API key", "secret_anthropic_key": "Anthropic API key", "secret_google_api_key": "Google API key", "secret_twilio_key": "Twilio API key",
    "secret_sendgrid_key": "SendGrid API key", "secret_generic_api_key": "Generic API key", "secret_generic_token": "Generic authentication token", "violence": "Violent content",
    "weapons": "Weapons content", "illegal": "Illegal activity", "self_harm": "Self-harm content", "harassment": "Harassment", "hate_speech": "Hate speech", "sexual": "Sexual content",
    "atlas_promptinjection": "Atlas: Prompt injection", "atlas_llmjailbreak": "Atlas: LLM jailbreak attempt", "atlas_promptextraction": "Atlas: Prompt extraction",
    "atlas_indirectinjection": "Atlas: Indirect prompt injection", "atlas_dataextraction": "Atlas: Data extraction attempt", "atlas_configexfiltration": "Atlas: Config exfiltration",
    "atlas_contentinjection": "Atlas: Content injection", "atlas_credentialforgery": "Atlas: Credential forgery", "atlas_defenseevasion": "Atlas: Defense evasion",
    "atlas_denialofservice": "Atlas: Denial of service", "atlas_elevationabuse": "Atlas: Privilege elevation", "atlas_endpointdenial": "Atlas: Endpoint denial",
    "atlas_inhibitrecovery": "Atlas: Recovery inhibition", "atlas_mfabypass": "Atlas: MFA bypass", "atlas_pluginexploitation": "Atlas: Plugin exploitation",
    "atlas_resourceexhaustion": "Atlas: Resource exhaustion", "atlas_vectordbpoisoning": "Atlas: Vector DB poisoning", "owasp_prompt_injection": "OWASP LLM01: Prompt injection",
    "owasp_insecure_output": "OWASP LLM02: Insecure output", "owasp_training_poisoning": "OWASP LLM03: Training poisoning", "owasp_model_dos": "OWASP LLM04: Model DoS",
    "owasp_supply_chain": "OWASP LLM05: Supply chain", "owasp_sensitive_disclosure": "OWASP LLM06: Sensitive disclosure", "owasp_insecure_plugin": "OWASP LLM07: Insecure plugin",
    "owasp_excessive_agency": "OWASP LLM08: Excessive agency", "owasp_overreliance": "OWASP LLM09: Overreliance", "owasp_model_theft": "OWASP LLM10: Model theft",
    "eu_ai_act_subliminal": "EU AI Act: Subliminal manipulation", "eu_ai_act_manipulation": "EU AI Act: Manipulation of vulnerabilities", "eu_ai_act_biometric": "EU AI Act: Biometric identification",
    "eu_ai_act_promptinject": "EU AI Act: Prompt injection (Art 15)", "eu_ai_act_datapoison": "EU AI Act: Data poisoning", "eu_ai_act_adversarial": "EU AI Act: Adversarial example",
}
SHORT_LABELS = {
    "pii_ssn": "Social Security Number", "pii_email": "Email address", "pii_phone": "Phone number", "pii_credit_card": "Credit card number", "pii_ip_address": "IP address", "pii_full_name": "Person's name",
    "pii_health": "Health information", "pii_health_v3": "Health information", "secret_jwt": "JWT (JSON Web Token)", "secret_bearer_token": "Bearer token", "secret_api_key": "API key",
    "secret_aws_access_key": "AWS access key", "secret_github_pat": "GitHub personal access token", "secret_private_key": "Private cryptographic key",
    "jwt_none": 'JWT with "none" algorithm (security vulnerability)', "xss_payload": "Cross-site scripting payload", "source_code": "Source code in prompt", "sqli_or_true": "SQL injection pattern",
    "owasp_sensitive_disclosure": "OWASP sensitive data disclosure", "prompt_injection_ml": "Prompt injection (ML-detected)", "prompt_injection_ml_long": "Prompt injection (long-content advisory)",
}
LABEL_PREFIXES = (("atlas_", "Atlas: "), ("owasp_", "OWASP: "), ("eu_ai_act_", "EU AI Act: "), ("anp_guard_", "ANP: "), ("computeruse_guard_", "Computer Use: "))
ALLOWED_LICENSES = ("apache-2.0", "apache2", "apache-2.0-with-llvm-exceptions", "mit", "bsd-2-clause", "bsd-3-clause", "openrail", "openrail++", "bigscience-rail-1.0", "cc0-1.0")
REJECTED_LICENSES = ("elastic-2.0", "elastic-1.0", "cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc", "gpl-3.0", "agpl-3.0", "cc-by-nd-4.0", "sspl")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "[::1]")
EMAIL_MARKERS = (r"(?m)^From: ", r"(?m)^Subject: ", r"@[^\n\r  ]* wrote:", r"(?m)^> ", r"(?m)^---\s*Original Message")


def facet(category: Column) -> Column:
    by_name = reduce(lambda w, kv: w.when(category == kv[0], kv[1]), rules.FACET_NAMES.items(), F.when(F.coalesce(category, F.lit("")) == "", 1))
    return reduce(lambda w, pf: w.when(category.startswith(pf[0]), pf[1]), rules.FACET_PREFIXES, by_name).otherwise(1)


def severity_rank(severity: Column) -> Column:
    """info 1 to critical 5; anything else, null too, 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, rules.SEVERITIES)), severity), F.lit(0)).cast("int")


def label(category: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    prefixed = reduce(lambda w, p: w.when(category.startswith(p[0]), F.concat(F.lit(p[1]), F.substring(category, len(p[0]) + 1, 1 << 30))), LABEL_PREFIXES, F.when(F.coalesce(category, F.lit("")) == "", "Unknown"))
    return F.coalesce(F.try_element_at(known, category), prefixed.otherwise(category))


def short_label(category: Column) -> Column:
    """The label of the banner; of others the category itself."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SHORT_LABELS.items() for x in kv)), category), category)


def describe(category: Column, severity: Column) -> Column:
    return F.concat(label(category), F.lit(" (severity: "), severity, F.lit(")"))


def mask(match: Column) -> Column:
    """First and last four characters of what is longer than eight."""
    return F.when(F.length(match) > 8, F.concat(F.substring(match, 1, 4), F.lit("…"), F.substring(match, -4, 4))).otherwise(match)


def host_hash(host: Column) -> Column:
    """16 hex digits of the SHA-256 of the lower-case host; null for a null or empty host."""
    return F.when(F.length(host) > 0, F.substring(F.sha2(F.lower(host), 256), 1, 16))


def dismiss_key(hashed: Column, category: Column, match: Column) -> Column:
    return F.concat(hashed, F.lit("::"), F.coalesce(category, F.lit("null")), F.lit("|"), F.coalesce(match, F.lit("null")))


def luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (F.length(digits) >= 2) & F.call_function("luhn_check", digits)


def approximate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def email_like(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(m) for m in EMAIL_MARKERS))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(p.lower()) for p in phrases))


def license_verdict(license_id: Column) -> Column:
    x = F.lower(F.trim(license_id))
    return F.when(F.coalesce(x, F.lit("")) == "", "missing").when(x.isin(*REJECTED_LICENSES), "rejected").when(x.isin(*ALLOWED_LICENSES), "allowed").otherwise("unknown")


def bundle_license_ok(license_id: Column) -> Column:
    return license_id.isNull() | license_id.isin("Apache-2.0", "MIT")


def required_files_ok(names: Column) -> Column:
    has = lambda n: F.array_contains(names, n)
    return has("tokenizer.json") & has("tokenizer_config.json") & (has("model.onnx") | has("model.int8.onnx"))


def url_allowed(url: Column) -> Column:
    """https anywhere, http on the local hosts only; what is no URL is not allowed."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.coalesce((scheme == "https") | ((scheme == "http") & host.isin(*LOCAL_HOSTS)), F.lit(False))


def url_encoded(text: Column) -> Column:
    """Percent-encoding of a part of a URL: all but letters, digits and ``-_.!~*'()`` in UTF-8, a blank as %20."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for mark in "!~'()":
        out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return out


def check_url(base: str, host: Column) -> Column:
    """Where a host is asked for."""
    return F.concat(F.lit(f"{base.rstrip('/')}/check?domain="), url_encoded(host))


def base64_bytes(text: Column) -> Column:
    """The bytes of standard base64; null where it is none."""
    return F.try_to_binary(text, F.lit("base64"))


def softmax2(logits: Column) -> Column:
    """Probability of the second of two logits."""
    a, b = F.get(logits, F.lit(0)), F.get(logits, F.lit(1))
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 700, 1.0).when(x <= -700, 0.0).when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def half_up4(p: Column) -> Column:
    return F.round(p, 4)


def length_bucket(text: Column, boundaries: tuple[int, ...] = (128, 256, 512, 1024)) -> Column:
    """The smallest boundary that a quarter of the characters fits in, else the largest."""
    n = approximate_tokens(text)
    return reduce(lambda w, b: w.when(n <= b, b), boundaries, F.when(n.isNull(), None)).otherwise(boundaries[-1])


def ml_finding(text: Column, score: Column, threshold: float = 0.05, long_at: int = 2000) -> Column:
    """Struct of a model's finding; null below the threshold or without a score."""
    long_ = F.length(text) >= long_at
    return F.when(
        score >= threshold,
        F.struct(
            F.when(long_, "prompt_injection_ml_long").otherwise("prompt_injection_ml").alias("category"), F.when(long_, "medium").otherwise("high").alias("severity"),
            F.substring(text, 1, 80).alias("match"), F.lit(6).alias("facet"), score.alias("ml_score"), F.lit(threshold).alias("ml_threshold"),
        ),
    )
