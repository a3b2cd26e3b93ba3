"""Schemas of the stored tables, and fixed scales."""

from __future__ import annotations

FINDINGS = (
    "id bigint, scan_id string, file string, line int, code string, scanner string, rule_id string, title string, severity string, "
    "severity_score int, cwe string, owasp string, description string, raw string"
)
SCANS = (
    "id string, project_id string, started_at timestamp, finished_at timestamp, files_scanned int, findings_count int, security_score int, "
    "ai_enabled boolean, status string, summary string, ai_summary string"
)
PROJECTS = "id string, name string, language string, source_path string, created_at timestamp"
RECOMMENDATIONS = (
    "id bigint, finding_id bigint, explanation string, impact string, attack_scenario string, root_cause string, recommended_fix string, "
    "secure_code string, owasp string, cwe string, model string, created_at timestamp"
)

SEVERITIES = ("Critical", "High", "Medium", "Low", "Informational")
PENALTY = {"Critical": 30, "High": 15, "Medium": 6, "Low": 2}

# Weakness catalog (id -> name, category).
CWE_CATALOG = {
    "CWE-89": ("SQL Injection", "Injection"),
    "CWE-79": ("Cross-Site Scripting (XSS)", "Injection"),
    "CWE-78": ("OS Command Injection", "Injection"),
    "CWE-94": ("Code Injection", "Injection"),
    "CWE-95": ("Eval-based Code Injection", "Injection"),
    "CWE-798": ("Hardcoded Credentials", "Identification and Authentication Failures"),
    "CWE-521": ("Weak Password Requirements", "Identification and Authentication Failures"),
    "CWE-287": ("Improper Authentication", "Identification and Authentication Failures"),
    "CWE-306": ("Missing Authentication for Critical Function", "Broken Access Control"),
    "CWE-862": ("Missing Authorization", "Broken Access Control"),
    "CWE-352": ("Cross-Site Request Forgery (CSRF)", "Broken Access Control"),
    "CWE-22": ("Path Traversal", "Broken Access Control"),
    "CWE-434": ("Unrestricted File Upload", "Security Misconfiguration"),
    "CWE-502": ("Deserialization of Untrusted Data", "Injection"),
    "CWE-120": ("Buffer Overflow", "Memory Safety"),
    "CWE-121": ("Stack-based Buffer Overflow", "Memory Safety"),
    "CWE-122": ("Heap-based Buffer Overflow", "Memory Safety"),
    "CWE-787": ("Out-of-bounds Write", "Memory Safety"),
    "CWE-119": ("Improper Restriction of Operations in Memory", "Memory Safety"),
    "CWE-476": ("NULL Pointer Dereference", "Memory Safety"),
    "CWE-416": ("Use After Free", "Memory Safety"),
    "CWE-311": ("Missing Encryption of Sensitive Data", "Sensitive Data Exposure"),
    "CWE-312": ("Cleartext Storage of Sensitive Data", "Sensitive Data Exposure"),
    "CWE-319": ("Cleartext Transmission of Sensitive Data", "Sensitive Data Exposure"),
    "CWE-295": ("Improper Certificate Validation", "Cryptographic Failures"),
    "CWE-326": ("Inadequate Encryption Strength", "Cryptographic Failures"),
    "CWE-327": ("Broken or Risky Crypto Algorithm", "Cryptographic Failures"),
    "CWE-614": ("Sensitive Cookie Without HttpOnly", "Identification and Authentication Failures"),
    "CWE-79:DOM": ("DOM-based XSS", "Injection"),
    "CWE-400": ("Uncontrolled Resource Consumption", "Security Misconfiguration"),
    "CWE-259": ("Hardcoded Password", "Identification and Authentication Failures"),
    "CWE-20": ("Improper Input Validation", "Injection"),
    "CWE-749": ("Exposed Dangerous Method", "Security Misconfiguration"),
    "CWE-98": ("Include Injection", "Injection"),
    "CWE-918": ("Server-Side Request Forgery (SSRF)", "Security Misconfiguration"),
}
CWE_DEFAULT = ("Security Issue", "Security Misconfiguration")

# File suffixes of each language.
LANGUAGES = {
    "python": (".py", ".pyw", ".pyi"),
    "java": (".java",),
    "cpp": (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp"),
    "web": (".php", ".phtml", ".js", ".jsx", ".ts", ".mjs", ".html", ".htm", ".xhtml", ".css"),
    "go": (".go",),
    "ruby": (".rb", ".erb", ".rake", ".gemspec"),
    "rust": (".rs",),
    "csharp": (".cs",),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
    "shell": (".sh", ".bash", ".zsh"),
    "sql": (".sql",),
}
# Rule group of a web file's suffix; others of that language fall to html.
WEB_GROUPS = {
    "php": (".php", ".phtml"),
    "js": (".js", ".jsx", ".ts", ".mjs"),
    "html": (".html", ".htm", ".xhtml"),
    "css": (".css",),
}
# Directories that are never read.
SKIP_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", "node_modules", "bower_components", ".venv", "venv", "env",
    "site-packages", "dist", "build", "target", ".gradle", ".idea", ".vscode", ".next", ".nuxt", "coverage", "htmlcov", ".tox", ".nox", "vendor",
)
MAX_FILE_BYTES = 2 * 1024 * 1024
