"""Rule tables as data.

Everything under the FIXED VALUES markers must equal the analysed tool's
tables for results to agree; it is stated plainly and in its natural order.
Regular expressions are written in the dialect shared by Spark (Java regex)
and DuckDB (RE2): a JS ``/x/gi`` becomes ``(?i)x``, ``/x/gm`` becomes ``(?m)x``
and ``/x/g`` stays ``x``.  Counting all matches is what ``/g`` did.
"""

from __future__ import annotations

# ----------------------------------------------------------------------------
# FIXED VALUES: refactoring types, levels and rules (in rule order).
# Each rule is (node_type, text, condition); a text rule is a case-insensitive
# substring test.  Condition is what a node-level rule requires.
# ----------------------------------------------------------------------------
REFACTOR_TYPES = [
    ("Extract Method", 2, [
        ("function_declaration", None, "isNew"),
        ("method_declaration", None, "isNew"),
        ("function_definition", None, "isNew"),
    ]),
    ("Inline Method", 2, [
        ("function_declaration", None, "removed"),
        ("method_declaration", None, "removed"),
        ("function_definition", None, "removed"),
    ]),
    ("Rename Symbol", 1, [
        (None, None, "nameChanged"),
    ]),
    ("Move/Modularize", 2, [
        ("import_statement", None, "isNew"),
        ("import_declaration", None, "isNew"),
        ("using_directive", None, "isNew"),
    ]),
    ("Service Extraction", 4, [
        (None, t, "isNew") for t in [
            "restcontroller", "controller", "service", "@restcontroller", "@controller",
            "@service", "express", "fastify", "flask", "django"]
    ]),
    ("Layering", 3, [
        (None, t, "isNew") for t in [
            "repository", "dao", "datalayer", "repository", "@repository", "@dao"]
    ]),
    ("Event-driven", 4, [
        (None, t, "isNew") for t in [
            "kafka", "rabbitmq", "sqs", "eventbus", "pubsub", "messaging"]
    ]),
    ("Cloud Migration", 3, [
        (None, t, "isNew") for t in [
            "aws-sdk", "s3", "dynamodb", "lambda", "ec2", "rds", "sns", "sqs",
            "azure", "blob", "cosmosdb", "functions",
            "google-cloud", "gcs", "firestore", "cloud-functions"]
    ]),
    ("Error Handling", 2, [
        (None, t, "isNew") for t in [
            "try", "catch", "exception", "error", "retry", "fallback"]
    ]),
    ("Logging/Observability", 2, [
        (None, t, "isNew") for t in [
            "log4j", "slf4j", "winston", "bunyan", "logging", "logger", "metrics",
            "monitoring", "tracing"]
    ]),
    ("Testing", 2, [
        (None, t, "isNew") for t in [
            "junit", "testng", "jest", "mocha", "pytest", "unittest", "mockito", "sinon",
            "@test", "describe", "it(", "test("]
    ]),
    ("Containerization", 4, [
        (None, t, "isNew") for t in [
            "dockerfile", "docker-compose", "kubernetes", "k8s", "helm", "container"]
    ]),
    ("Infrastructure as Code", 4, [
        (None, t, "isNew") for t in [
            "terraform", "cloudformation", "arm", "pulumi", "cdk", "serverless"]
    ]),
    ("Database Migration", 3, [
        (None, t, "isNew") for t in [
            "jpa", "hibernate", "mybatis", "sequelize", "typeorm", "sqlalchemy", "mongoose",
            "prisma", "migration", "schema"]
    ]),
]

# Summary-text rule of the file path: a diff summary mentioning these words.
SUMMARY_RULE = ("Move/Modularize", 2, ["import", "dependency"],
                "Import/dependency changes detected", 0.7)
FILE_RULE_CONFIDENCE = 0.8

# Scorer type sets.
INFRASTRUCTURE_TYPES = ["Service Extraction", "Cloud Migration", "Containerization",
                        "Infrastructure as Code", "Event-driven"]
COMPLEX_TYPES = ["Service Extraction", "Cloud Migration", "Event-driven", "Infrastructure as Code"]
SIMPLIFYING_TYPES = ["Extract Method", "Inline Method", "Rename Symbol"]

# Impact score weights, level thresholds and level words.
SCORE_WEIGHTS = {"lines": 0.30, "nodes": 0.25, "infra": 0.20, "coverage": 0.15, "complexity": 0.10}
LEVEL_THRESHOLDS = [(4, 80), (3, 60), (2, 40), (1, 20)]
LEVEL_WORDS = ["trivial", "minor", "moderate", "significant", "architectural"]
IMPACT_DESCRIPTIONS = [
    "No significant changes detected",
    "Minor code improvements and refactoring",
    "Moderate restructuring with some architectural changes",
    "Significant modernization with new patterns and infrastructure",
    "Major architectural transformation with cloud-native adoption",
]
# Element-level impact weights (added, removed, modified), capped at 100.
ELEMENT_IMPACT_WEIGHTS = (2, 3, 1)

# Language multipliers: language -> (complexity multiplier, infrastructure weight).
LANGUAGE_ADJUSTMENTS = {
    "java": (1.1, 1.2),
    "javascript": (0.9, 1.0),
    "python": (0.95, 1.0),
    "c": (1.3, 0.8),
    "cpp": (1.2, 0.9),
    "csharp": (1.05, 1.1),
}

# ----------------------------------------------------------------------------
# FIXED VALUES: risk patterns.  (pack, category, severity, [regex, ...]).
# ----------------------------------------------------------------------------
SECURITY_PATTERNS = [
    ("secrets", "high", [
        r"""(?i)password\s*=\s*["'][^"']+["']""",
        r"""(?i)api[_-]?key\s*=\s*["'][^"']+["']""",
        r"""(?i)secret\s*=\s*["'][^"']+["']""",
        r"""(?i)token\s*=\s*["'][^"']+["']""",
        r"""(?i)access[_-]?key\s*=\s*["'][^"']+["']""",
        r"""(?i)private[_-]?key\s*=\s*["'][^"']+["']""",
        r"(?i)aws[_-]?access[_-]?key",
        r"(?i)aws[_-]?secret[_-]?key",
        r"(?i)github[_-]?token",
        r"(?i)database[_-]?password",
    ]),
    ("deprecatedCrypto", "medium", [
        r"(?i)md5\s*\(",
        r"(?i)sha1\s*\(",
        r"(?i)des\s*\(",
        r"(?i)rc4\s*\(",
        r"""(?i)crypto\.createHash\s*\(\s*['"]md5['"]""",
        r"""(?i)crypto\.createHash\s*\(\s*['"]sha1['"]""",
        r"""(?i)MessageDigest\.getInstance\s*\(\s*['"]MD5['"]""",
        r"""(?i)MessageDigest\.getInstance\s*\(\s*['"]SHA1['"]""",
    ]),
    ("sqlInjection", "high", [
        r"""(?i)executeQuery\s*\(\s*["'][^"']*\+""",
        r"""(?i)query\s*\(\s*["'][^"']*\+""",
        r"""(?i)Statement\.execute\s*\(\s*["'][^"']*\+""",
        r"""(?i)cursor\.execute\s*\(\s*["'][^"']*\+""",
    ]),
    ("xss", "medium", [
        r"(?m)innerHTML\s*=\s*[^;]+$",
        r"(?i)document\.write\s*\(",
        r"(?i)eval\s*\(",
        r"(?i)Function\s*\(",
        r"(?i)setTimeout\s*\([^,]+,\s*0\)",
    ]),
    ("pathTraversal", "high", [
        r"\.\./\.\./",
        r"\.\.\\\.\.\\",
        r"(?i)\.\.%2f\.\.%2f",
        r"(?i)\.\.%5c\.\.%5c",
        r"(?i)readFile\s*\(\s*[^)]*\.\.",
        r"(?i)open\s*\(\s*[^)]*\.\.",
    ]),
]

SECURITY_DESCRIPTIONS = {
    "secrets": "Potential secret exposure detected ({n} occurrences)",
    "deprecatedCrypto": "Deprecated cryptographic functions found ({n} occurrences)",
    "sqlInjection": "Potential SQL injection vulnerability ({n} occurrences)",
    "xss": "Potential XSS vulnerability ({n} occurrences)",
    "pathTraversal": "Potential path traversal vulnerability ({n} occurrences)",
}
SECURITY_SUGGESTIONS = {
    "secrets": "Use environment variables or secure configuration management for secrets",
    "deprecatedCrypto": "Replace with modern cryptographic functions (SHA-256, AES-256)",
    "sqlInjection": "Use parameterized queries or prepared statements",
    "xss": "Sanitize user input and use Content Security Policy",
    "pathTraversal": "Validate and sanitize file paths, use path.join() or equivalent",
}

LICENSE_PATTERNS = [
    ("gpl", "high", [
        r"(?i)gpl[_-]?v?[0-9]?",
        r"(?i)gnu[_-]?general[_-]?public[_-]?license",
    ]),
    ("agpl", "critical", [
        r"(?i)agpl[_-]?v?[0-9]?",
        r"(?i)gnu[_-]?affero[_-]?general[_-]?public[_-]?license",
    ]),
    ("copyleft", "high", [
        r"(?i)copyleft",
        r"(?i)copyleft[_-]?left",
    ]),
    ("proprietary", "medium", [
        r"(?i)proprietary",
        r"(?i)commercial[_-]?license",
        r"(?i)closed[_-]?source",
    ]),
]
LICENSE_DESCRIPTIONS = {
    "gpl": "GPL license may require source code disclosure",
    "agpl": "AGPL license requires source code disclosure for network services",
    "copyleft": "Copyleft license may impose restrictions",
    "proprietary": "Proprietary license may require commercial agreement",
}
LICENSE_SUGGESTION = "Review license compatibility with your project requirements"

COMPATIBILITY_PATTERNS = [
    ("deprecatedAPIs", "medium", [
        r"new\s+Date\s*\([^)]*\)",
        r"\.call\s*\(\s*null\s*,",
        r"arguments\.callee",
        r"with\s*\(",
        r"eval\s*\(",
    ]),
    ("browserCompatibility", "low", [
        r"document\.all",
        r"window\.event",
        r"attachEvent",
        r"detachEvent",
        r"createStyleSheet",
    ]),
    ("nodeVersion", "low", [
        r"process\.version",
        r"node[_-]?version",
        r"v8[_-]?version",
    ]),
]
COMPATIBILITY_DESCRIPTIONS = {
    "deprecatedAPIs": "Deprecated API usage found ({n} occurrences)",
    "browserCompatibility": "Browser compatibility issues ({n} occurrences)",
    "nodeVersion": "Node.js version dependencies ({n} occurrences)",
}
COMPATIBILITY_SUGGESTIONS = {
    "deprecatedAPIs": "Update to modern APIs and remove deprecated usage",
    "browserCompatibility": "Test across target browsers and update polyfills",
    "nodeVersion": "Specify minimum Node.js version in package.json",
}

# Performance pack: flag only when a pattern hits more than 3 times.
PERFORMANCE_MIN_HITS = 4
PERFORMANCE_PATTERNS = [
    (r"for\s*\(\s*var\s+\w+\s*=\s*0;\s*\w+\s*<\s*\.length\s*;\s*\w+\+\+\)",
     "Inefficient loop with repeated .length access", "Cache array length before loop"),
    (r"document\.getElementById\s*\(",
     "Multiple DOM queries without caching", "Cache DOM elements for reuse"),
    (r"new\s+RegExp\s*\(",
     "Dynamic regex creation in loops", "Create regex patterns outside loops"),
]

MAINTAINABILITY_PATTERNS = [
    (r"function\s+\w+\s*\([^)]{50,}\)",
     "Functions with many parameters", "Consider using parameter objects or builder pattern"),
    (r"\{[^}]{200,}\}",
     "Very long functions or blocks", "Break down into smaller, focused functions"),
    (r"//\s*TODO|//\s*FIXME|//\s*HACK",
     "Code with TODO/FIXME/HACK comments", "Address technical debt before production deployment"),
]

# Dependency-name license check.
DEPENDENCY_LICENSE_WORDS = ["gpl", "copyleft"]
DEPENDENCY_LICENSE_DESCRIPTION = "Dependency {dep} may have restrictive license"
DEPENDENCY_LICENSE_SUGGESTION = "Review dependency license before including in production"

# Dependency extraction regexes (capture group 1 is the dependency).
DEPENDENCY_PATTERNS = [
    r"import\s+([a-zA-Z0-9.-]+)",
    r"""require\(['"]([^'"]+)['"]\)""",
    r"""from\s+['"]([^'"]+)['"]""",
    r"using\s+([a-zA-Z0-9.]+);",
    r"#include\s+<([^>]+)>",
    r'#include\s+"([^"]+)"',
]

# ----------------------------------------------------------------------------
# FIXED VALUES: next steps per refactoring type and per risk flag.
# ----------------------------------------------------------------------------
TYPE_NEXT_STEPS = [
    ("Service Extraction", ["Run integration tests for the new service endpoints",
                            "Update API documentation and client SDKs"]),
    ("Cloud Migration", ["Test with cloud emulators in development environment",
                         "Implement proper retry/backoff for cloud API calls"]),
    ("Database Migration", ["Run database migration scripts in staging environment",
                            "Validate data integrity after migration"]),
    ("Containerization", ["Test container builds and deployment pipeline",
                          "Update CI/CD configurations for containerized deployment"]),
]
HIGH_SECURITY_STEP = "Review and address security vulnerabilities before deployment"
LICENSE_STEP = "Review new dependency licenses for compliance"
NO_REFACTORING_SUMMARY = "No significant refactoring detected"

# ----------------------------------------------------------------------------
# FIXED VALUES: KPI dimensions (key, name, description, default weight).
# ----------------------------------------------------------------------------
KPIS = [
    ("K1", "Language Compatibility", "Ability to handle legacy and modern languages", 0.1),
    ("K2", "IDE/CI-CD Integration", "Support for modern development pipelines", 0.1),
    ("K3", "Safe Refactoring & Auto Testing", "Confidence in maintaining logic and auto testing", 0.2),
    ("K4", "Security & Compliance", "Suitability for regulated environments", 0.2),
    ("K5", "Scalability", "Performance in large-scale or distributed systems", 0.15),
    ("K6", "Cost & Documentation", "Licensing, time, training costs, documentation", 0.1),
    ("K7", "AI Automation & Debugging", "Level of intelligent transformation and debugging", 0.15),
]

# ----------------------------------------------------------------------------
# FIXED VALUES: request domains.
# ----------------------------------------------------------------------------
ACCEPTED_LANGUAGES = ["java", "javascript", "python", "c", "cpp", "csharp", "cobol", "pli"]
PARSED_LANGUAGES = ["javascript", "java", "python", "c", "cpp"]
SOURCE_TYPES = ["paste", "file", "repo"]
STATUSES = ["pending", "processing", "completed", "failed"]
UPLOAD_EXTENSIONS = ["java", "js", "ts", "py", "c", "cpp", "cs", "cob", "pli", "jcl"]
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_FILES = 10
RATE_LIMIT_WINDOW = "15 minutes"
RATE_LIMIT_MAX = 100
DEFAULT_PAGE_SIZE = 10
FUZZY_MIN_SIMILARITY = 0.7
PATCH_CONTEXT_LINES = 4
OUTBOX_SUBJECT = "Analysis Complete: {id}"


# ----------------------------------------------------------------------------
# Derived views of the tables above (plain Python, no Spark).
# ----------------------------------------------------------------------------
def text_rules():
    """Rows (ordinal, type, level, rule_ord, text) for every text rule, rule order."""
    out = []
    seq = 0
    for ordinal, (rtype, level, rules) in enumerate(REFACTOR_TYPES, start=1):
        for node_type, text, _cond in rules:
            seq += 1
            if text is not None:
                out.append((ordinal, rtype, level, seq, text))
    return out


def node_rules():
    """Rows (ordinal, type, level, rule_ord, node_type, text, condition) for all rules."""
    out = []
    seq = 0
    for ordinal, (rtype, level, rules) in enumerate(REFACTOR_TYPES, start=1):
        for node_type, text, cond in rules:
            seq += 1
            out.append((ordinal, rtype, level, seq, node_type, text, cond))
    return out


def risk_pattern_rows():
    """Rows (pack, category, pattern_ord, regex, severity, min_hits, description, suggestion).

    ``description`` keeps ``{n}`` where the hit count goes.
    """
    rows = []
    ordn = 0
    for cat, sev, pats in SECURITY_PATTERNS:
        for p in pats:
            ordn += 1
            rows.append(("security", cat, ordn, p, sev, 1,
                         SECURITY_DESCRIPTIONS[cat], SECURITY_SUGGESTIONS[cat]))
    for cat, sev, pats in LICENSE_PATTERNS:
        for p in pats:
            ordn += 1
            rows.append(("license", cat, ordn, p, sev, 1,
                         LICENSE_DESCRIPTIONS[cat], LICENSE_SUGGESTION))
    for cat, sev, pats in COMPATIBILITY_PATTERNS:
        for p in pats:
            ordn += 1
            rows.append(("compatibility", cat, ordn, p, sev, 1,
                         COMPATIBILITY_DESCRIPTIONS[cat], COMPATIBILITY_SUGGESTIONS[cat]))
    for p, desc, sugg in PERFORMANCE_PATTERNS:
        ordn += 1
        rows.append(("performance", "performance", ordn, p, "medium", PERFORMANCE_MIN_HITS,
                     desc + " ({n} occurrences)", sugg))
    for p, desc, sugg in MAINTAINABILITY_PATTERNS:
        ordn += 1
        rows.append(("maintainability", "maintainability", ordn, p, "low", 1,
                     desc + " ({n} occurrences)", sugg))
    return rows
