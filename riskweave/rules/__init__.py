"""The rule catalog: what is looked for, how bad it is, and the patterns in Java's and RE2's syntax."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from . import compliance, core, extended, scanners

# The enumerations and maps that findings and events are held to.
SEVERITIES = ("info", "low", "medium", "high", "critical")
ACTIONS = ("send_anyway", "edit", "cancel", "dismiss", "dismiss_false_positive")
WIRE_CATEGORIES = tuple(
    "pii_email pii_phone pii_ssn pii_credit_card pii_bank_account pii_date_of_birth pii_driver_license pii_health pii_ip_address pii_passport pii_tax_id "
    "secret_api_key secret_aws_key secret_google_api_key secret_anthropic_key secret_openai_key secret_sendgrid_key secret_twilio_key secret_bearer_token "
    "secret_database_url secret_encryption_key secret_generic_api_key secret_generic_token secret_jwt secret_oauth_token secret_password secret_private_key "
    "secret_webhook_secret source_code xss_payload health_check "
    "owasp_prompt_injection owasp_insecure_output owasp_insecure_plugin owasp_excessive_agency owasp_model_dos owasp_model_theft owasp_overreliance "
    "owasp_supply_chain owasp_training_poisoning owasp_sensitive_disclosure "
    "atlas_promptinjection atlas_llmjailbreak atlas_indirectinjection atlas_promptextraction atlas_dataextraction atlas_configexfiltration "
    "atlas_contentinjection atlas_credentialforgery atlas_defenseevasion atlas_denialofservice atlas_elevationabuse atlas_endpointdenial "
    "atlas_inhibitrecovery atlas_mfabypass atlas_pluginexploitation atlas_resourceexhaustion atlas_vectordbpoisoning "
    "eu_ai_act_subliminal eu_ai_act_manipulation eu_ai_act_biometric eu_ai_act_promptinject eu_ai_act_datapoison eu_ai_act_adversarial "
    "anp_guard_injection computeruse_guard_sensitive toxicity_custom violence weapons illegal harassment self_harm "
    "prompt_injection_ml prompt_injection_ml_long".split()
)
FACET_PREFIXES = (("pii_", 1), ("secret_", 2), ("owasp_", 4), ("atlas_", 4), ("eu_ai_act_", 4), ("anp_", 4), ("computeruse_", 4))
FACET_NAMES = {"source_code": 3, "xss_payload": 3, "toxicity_custom": 5, "violence": 5, "weapons": 5, "illegal": 5, "harassment": 5, "self_harm": 5, "prompt_injection_ml": 6, "prompt_injection_ml_long": 6}

SPACE = r"\t-\r\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_JAVA = {"b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}


def facet_of(category: str | None) -> int:
    if not category:
        return 1
    return FACET_NAMES.get(category) or next((f for p, f in FACET_PREFIXES if category.startswith(p)), 1)


def _rewritten(pattern: str, flags: str, java: bool) -> str:
    """ECMAScript's meaning of classes, ends and word bounds in the syntax of Java or RE2."""
    space = SPACE if java else re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", SPACE)
    line = r"\n\r\u2028\u2029" if java else r"\n\r\x{2028}\x{2029}"
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            d = pattern[k + 1]
            k += 2
            if d == "s":
                out.append(space if inside else f"[{space}]")
            elif d == "S":
                if inside:
                    # the only use inside a class is beside \s: any character
                    out.append(r"\x00-\x{10FFFF}")
                else:
                    out.append(f"[^{space}]")
            elif d in "bB" and not inside:
                out.append(_JAVA[d] if java else "\\" + d)
            elif d == "/" or (not java and d in "\"'<>`@!#%&,:;=~ -_" and not (inside and d == "-")):
                out.append(d)
            else:
                out.append("\\" + d)
            continue
        if inside and c == "-" and pattern[k - 2 : k - 1] == "\\" and pattern[k - 1] in "dDwWsS":
            out.append(r"\-")  # a class is no end of a range
        elif inside:
            inside = c != "]"
            # Java reads [ and && inside a class as class algebra
            out.append("\\" + c if c in "[&" and java else c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[k + 1 : k + 2] == "^":
                out.append("^")
                k += 1
        elif c == ".":
            out.append(r"[\x00-\x{10FFFF}]" if "s" in flags else f"[^{line}]")
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
        k += 1
    return ("(?i)" if "i" in flags else "") + "".join(out)


@dataclass(frozen=True)
class Rule:
    ord: int
    source: str
    category: str
    name: str
    severity: str
    flags: str
    compliance: tuple[str, ...]
    pattern: str

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity) + 1 if self.severity in SEVERITIES else 0

    @property
    def facet(self) -> int:
        return facet_of(self.category)

    @property
    def wire_valid(self) -> bool:
        return self.category in WIRE_CATEGORIES

    @cached_property
    def java(self) -> str:
        return _rewritten(self.pattern, self.flags, True)

    @cached_property
    def python(self) -> re.Pattern:
        """The compiled pattern for Python's ``re``, ASCII classes and folding."""
        return re.compile(_rewritten(self.pattern, self.flags, True).replace(_JAVA["b"], r"\b").replace(_JAVA["B"], r"\B").replace(r"\z", r"\Z").replace(r"\x{10FFFF}", r"\U0010ffff"), re.ASCII)

    @property
    def re2(self) -> str | None:
        """The pattern for RE2; None where it looks around."""
        return None if re.search(r"\(\?<?[=!]", self.pattern) else _rewritten(self.pattern, self.flags, False)

    @cached_property
    def required(self) -> tuple[frozenset[str], ...]:
        """Sets of lower-case literals; every match has one of each set at least. The most telling set comes first."""
        return required_literals(self.python.pattern)

    @cached_property
    def formula(self) -> tuple:
        """What a match must hold, as literals that all must be there and tuples of alternatives, each such a formula."""
        return literal_formula(self.python.pattern)

    @property
    def needles(self) -> tuple[str, ...]:
        """The most telling of the required sets; empty if none is known."""
        return tuple(sorted(self.required[0])) if self.required else ()

    @cached_property
    def least_digits(self) -> int:
        """Every match has so many ASCII digits in a row at least."""
        return required_run(self.python.pattern, frozenset("0123456789"))

    @cached_property
    def least_run(self) -> int:
        """Every match has so many ASCII letters, digits and ``+/_-`` in a row at least."""
        return required_run(self.python.pattern, RUN)


RUN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")


def _parsed(pattern: str):
    import re._parser as parser

    try:
        return parser.parse(pattern)
    except (re.error, IndexError):
        return []


def required_literals(pattern: str, most: int = 40) -> tuple[frozenset[str], ...]:
    import re._constants as c

    def of(items) -> list[set[str]]:
        """Sets of which each must be met by some literal of the parts."""
        found: list[set[str]] = []
        run = ""
        for op, arg in [*items, (None, None)]:
            if op is c.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if run:
                found.append({run})
            run = ""
            if op is c.SUBPATTERN:
                found += of(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                found += of(arg[2])
            elif op is c.BRANCH:
                parts = [best(of(x)) for x in arg[1]]
                if all(parts):
                    found.append(set().union(*parts))
        return found

    def best(sets: list[set[str]]) -> set[str] | None:
        return max((x for x in sets if len(x) <= most), key=lambda x: (min(map(len, x)), -len(x)), default=None)

    telling = [x for x in of(_parsed(pattern)) if len(x) <= most and all(len(w) > 1 or not w.isalnum() and not w.isspace() for w in x)]
    return tuple(dict.fromkeys(map(frozenset, sorted(telling, key=lambda x: (min(map(len, x)), -len(x), sorted(x)), reverse=True))))


def literal_formula(pattern: str) -> tuple:
    import re._constants as c

    def of(items) -> tuple:
        out: list = []
        run = ""
        for op, arg in [*items, (None, None)]:
            if op is c.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if len(run) > 1:
                out.append(run)
            run = ""
            if op is c.SUBPATTERN:
                out += of(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                out += of(arg[2])
            elif op is c.BRANCH:
                parts = tuple(map(of, arg[1]))
                if all(parts):
                    out.append(parts)
        return tuple(out)

    return of(_parsed(pattern))


def literals_of(formula: tuple) -> set[str]:
    return {w for x in formula for w in ([x] if isinstance(x, str) else set().union(*map(literals_of, x)))}


def holds(formula: tuple, there: set[str]) -> bool:
    return all(x in there if isinstance(x, str) else any(holds(part, there) for part in x) for x in formula)


def required_run(pattern: str, within: frozenset[str]) -> int:
    """The length of a run of characters ``within`` that every match has."""
    import re._constants as c

    def stays(op, arg) -> bool:
        if op is c.LITERAL:
            return chr(arg) in within
        if op is c.IN:
            return all((k is c.LITERAL and chr(v) in within) or (k is c.RANGE and v[1] < 128 and all(chr(x) in within for x in range(v[0], v[1] + 1))) or (k is c.CATEGORY and v is c.CATEGORY_DIGIT) for k, v in arg)
        return False

    def of(items) -> int:
        found = run = 0
        for op, arg in items:
            if op in (c.MAX_REPEAT, c.MIN_REPEAT) and len(arg[2]) == 1 and stays(*arg[2][0]):
                run += arg[0]
            elif stays(op, arg):
                run += 1
            else:
                run = 0
                if op is c.SUBPATTERN:
                    found = max(found, of(arg[3]))
                elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                    found = max(found, of(arg[2]))
                elif op is c.BRANCH:
                    found = max(found, min(map(of, arg[1])))
                elif op is c.AT:
                    continue
            found = max(found, run)
        return found

    return of(_parsed(pattern))


def catalog() -> tuple[Rule, ...]:
    """All rules in their order, which decides ties and caps."""
    rows = (*core.RULES, *compliance.RULES, *scanners.RULES, *extended.RULES)
    return tuple(Rule(k, *row) for k, row in enumerate(rows))


def by_name(rules: tuple[Rule, ...], name: str) -> tuple[Rule, ...]:
    """Every rule of a name; names are not unique."""
    return tuple(r for r in rules if r.name == name)


def by_category(rules: tuple[Rule, ...]) -> dict[str, tuple[Rule, ...]]:
    return {c: tuple(r for r in rules if r.category == c) for c in dict.fromkeys(r.category for r in rules)}
