"""The built-in detection rules as data: one row per rule, keyed by (group, rule_id).

A rule id alone is not unique: some groups share ids.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    group: str
    rule_id: str
    pattern: str
    flags: str
    title: str
    cwe: str
    score: int


# Ids, patterns, titles, weakness ids and scores that results must agree on.
RULES = [
    Rule("python", "S-HARDCODE-1", r"\bpassword\s*=\s*['\"][^'\"]{3,}['\"]", "i", "Hardcoded password in source", "CWE-259", 8),
    Rule("python", "S-HARDCODE-2", r"\bsecret\s*=\s*['\"][^'\"]{8,}['\"]", "i", "Hardcoded secret in source", "CWE-798", 8),
    Rule("python", "S-HARDCODE-3", r"\bapi[_-]?key\s*=\s*['\"][^'\"]{8,}['\"]", "i", "Hardcoded API key", "CWE-798", 8),
    Rule("python", "S-HARDCODE-4", r"\btoken\s*=\s*['\"][A-Za-z0-9_\-\.]{16,}['\"]", "i", "Hardcoded token", "CWE-798", 7),
    Rule("python", "S-SQLI-1", r"\bexecute\s*\(\s*f?['\"][^'\"]*?(?:['\"]\s*\+|\{)(?!\s*#)", "", "Possible SQL injection (string concatenation in execute)", "CWE-89", 9),
    Rule("python", "S-SQLI-2", r"\bcursor\.execute\s*\([^)]*%\s+[A-Za-z(]", "", "SQL query built with unsafe % formatting", "CWE-89", 8),
    Rule("python", "S-SQLI-3", r"\.format\s*\([^)]*\).*SELECT|SELECT.*\.format\s*\(", "", "SQL query built with .format()", "CWE-89", 8),
    Rule("python", "S-CMDI-1", r"\bsubprocess\.(?:run|Popen|call|check_output|check_call)\s*\([^)]*\bshell\s*=\s*True", "", "Shell=True allows command injection", "CWE-78", 9),
    Rule("python", "S-CMDI-2", r"\bos\.system\s*\(", "", "os.system() with untrusted input risk", "CWE-78", 7),
    Rule("python", "S-CMDI-3", r"\beval\s*\(", "", "Use of eval() - code injection risk", "CWE-95", 9),
    Rule("python", "S-CMDI-4", r"\bexec\s*\(", "", "Use of exec() - code injection risk", "CWE-95", 9),
    Rule("python", "S-DESER-1", r"\bpickle\.(?:loads|load)\s*\(", "", "Unsafe pickle deserialization", "CWE-502", 9),
    Rule("python", "S-DESER-2", r"\byaml\.load\s*\([^)]*(?!Loader)", "", "yaml.load without safe Loader", "CWE-502", 8),
    Rule("python", "S-CLEAR-1", r"\b(?:paramiko|ftp|ftplib|smtplib|poplib|imaplib)\b", "", "Possible cleartext network usage", "CWE-319", 4),
    Rule("python", "S-CLEAR-2", r"\brequests\.get\s*\(\s*['\"]http://", "", "HTTP (not HTTPS) request", "CWE-319", 4),
    Rule("python", "S-CLEAR-3", r"\burlopen\s*\(\s*['\"]http://", "", "HTTP (not HTTPS) urlopen", "CWE-319", 4),
    Rule("python", "S-CRYPTO-1", r"\bmd5\s*\(", "", "Insecure MD5 hashing", "CWE-327", 5),
    Rule("python", "S-CRYPTO-2", r"\bsha1\s*\(", "", "Weak SHA-1 hashing", "CWE-327", 4),
    Rule("python", "S-CRYPTO-3", r"\brandom\.(?:random|randint|choice|uniform)\s*\(", "", "Non-cryptographic random for security", "CWE-330", 6),
    Rule("python", "S-AUTH-1", r"\bassert\s+.*\b(?:is_admin|is_authenticated|is_superuser|is_staff|has_permission|has_role|logged_in|authenticated)\b", "", "assert used for authorization (disabled with -O)", "CWE-287", 8),
    Rule("python", "S-DELETE-1", r"\bexec\s*\(\s*['\"]rm\s+-rf|\bos\.remove|\bshutil\.rmtree\b", "", "Destructive file operation", "CWE-20", 6),
    Rule("java", "J-SQLI-1", r"Statement\s+\w+\s*=|createStatement\s*\(\s*\)", "", "Raw JDBC Statement (use PreparedStatement)", "CWE-89", 9),
    Rule("java", "J-SQLI-2", r"\.executeQuery\s*\(\s*[^)]*\+[^)]*\)", "", "SQL query concatenation", "CWE-89", 9),
    Rule("java", "J-SQLI-3", r"\.execute\s*\(\s*[^)]*\+[^)]*\)", "", "SQL statement concatenation", "CWE-89", 9),
    Rule("java", "J-SQLI-4", r"['\"][^'\"]*SELECT[^'\"]*['\"]\s*\+\s*\w+", "i", "SQL query string concatenation with variable", "CWE-89", 9),
    Rule("java", "J-CMDI-1", r"Runtime\.getRuntime\(\)\.exec\s*\(", "", "Runtime.exec() command injection risk", "CWE-78", 8),
    Rule("java", "J-CMDI-2", r"ProcessBuilder\s*\([^)]*\)\s*\.\s*command\s*\(\s*[^)]*\+", "", "ProcessBuilder with concatenated command", "CWE-78", 8),
    Rule("java", "J-XSS-1", r"getParameter\s*\(\s*['\"][^'\"]+['\"]\s*\)\s*.*\bout\.println\b|out\.println\s*\([^)]*getParameter", "", "Reflected XSS: request parameter written to response", "CWE-79", 8),
    Rule("java", "J-XSS-2", r"printWriter\s*\([^)]*\)\s*;\s*.*\.println\s*\([^)]*getParameter|\.println\s*\(\s*[^)]*request\.getParameter", "", "Unescaped request data written to output", "CWE-79", 7),
    Rule("java", "J-HARDCODE-1", r"password\s*=\s*['\"][^'\"]{3,}['\"]|secret\s*=\s*['\"][^'\"]{8,}['\"]|apiKey\s*=\s*['\"][^'\"]{8,}['\"]", "i", "Hardcoded credential in source", "CWE-798", 8),
    Rule("java", "J-AUTH-1", r"@RequestMapping\s*\([^)]*\)\s*[^{]*\{|@GetMapping|@PostMapping", "i", "Endpoint without visible authorization annotation", "CWE-862", 6),
    Rule("java", "J-DESER-1", r"ObjectInputStream\s*\(|\.readObject\s*\(", "", "Unsafe Java deserialization", "CWE-502", 9),
    Rule("java", "J-CRYPTO-1", r"MessageDigest\.getInstance\s*\(\s*['\"]MD5|['\"]SHA-1", "", "Weak hash algorithm", "CWE-327", 5),
    Rule("java", "J-CRYPTO-2", r"DESKeySpec|DESedeKeySpec|[\"']DES[\"']\s*[,)]", "", "Weak DES encryption", "CWE-327", 7),
    Rule("java", "J-CRYPTO-3", r"getBytes\s*\(\s*\)\s*[^\"]*Cipher|cipher\.doFinal\s*\(\s*\w+\.getBytes\s*\(\s*\)", "", "Incorrect charset in crypto operations", "CWE-327", 4),
    Rule("java", "J-CRYPTO-4", r"Math\.random\s*\(\s*\)", "", "Math.random() not cryptographically secure", "CWE-330", 5),
    Rule("java", "J-CRYPTO-4b", r"\bnew\s+java\.util\.Random\s*\(|\bnew\s+Random\s*\(\s*\)", "", "java.util.Random is not cryptographically secure (use SecureRandom)", "CWE-330", 5),
    Rule("java", "J-INFO-1", r"System\.getenv\s*\([^)]*\)\s*\+|getenv\s*\([^)]*\)\s*.*print|\.println\s*\([^)]*getenv", "", "Environment variable in output (info leak)", "CWE-200", 4),
    Rule("java", "J-INJECT-1", r"Class\.forName\s*\([^)]*getParameter|URLClassLoader", "", "Reflection / dynamic class loading from input", "CWE-470", 7),
    Rule("cpp", "C-OVERFLOW-1", r"\bgets\s*\(", "", "gets() - unbounded buffer read", "CWE-242", 10),
    Rule("cpp", "C-OVERFLOW-2", r"\bstrcpy\s*\(", "", "strcpy() - no bounds checking", "CWE-120", 8),
    Rule("cpp", "C-OVERFLOW-3", r"\bstrcat\s*\(", "", "strcat() - no bounds checking", "CWE-120", 8),
    Rule("cpp", "C-OVERFLOW-4", r"\bsprintf\s*\(", "", "sprintf() - potential buffer overflow", "CWE-120", 8),
    Rule("cpp", "C-OVERFLOW-5", r"\bvsprintf\s*\(", "", "vsprintf() - potential buffer overflow", "CWE-120", 8),
    Rule("cpp", "C-OVERFLOW-6", r"\bscanf\s*\(\s*['\"][^'\"]*%s", "", "scanf with %s - no length limit", "CWE-120", 8),
    Rule("cpp", "C-MEM-1", r"\bstrncpy\s*\([^,]+,[^,]+,\s*sizeof\s*\([^)]*\)", "", "strncpy with sizeof(pointer) - truncation/overflow", "CWE-121", 6),
    Rule("cpp", "C-MEM-2", r"\bmemcpy\s*\([^,]+,[^,]+,\s*sizeof\s*\([^)]*\)", "", "memcpy with sizeof(pointer) instead of array size", "CWE-121", 6),
    Rule("cpp", "C-MEM-3", r"malloc\s*\([^)]*\)\s*\)\s*;", "", "malloc() result not checked for NULL", "CWE-476", 5),
    Rule("cpp", "C-MEM-4", r"new\s+\w+\s*(\[\d+\])?\s*;", "", "new allocation without null/exception handling", "CWE-476", 4),
    Rule("cpp", "C-UAF-1", r"delete\s+\w+;\s*.*\b\w+\b\s*->|\buse\s+after\s+delete", "", "Possible use-after-free pattern", "CWE-416", 9),
    Rule("cpp", "C-UAF-2", r"free\s*\(\s*(\w+)\s*\)\s*;", "", "free() call - verify no later dereference", "CWE-416", 6),
    Rule("cpp", "C-BUF-1", r"char\s+\w+\s*\[\s*\d+\s*\]\s*;\s*(?!.*strncpy|.*snprintf|.*memcpy_s|.*strcpy_s)", "i", "Fixed-size stack buffer", "CWE-787", 5),
    Rule("cpp", "C-INPUT-1", r"\bstrlen\s*\(\s*[^)]*input|strlen\s*\(\s*argv", "", "Untrusted input length used without bounds", "CWE-20", 6),
    Rule("cpp", "C-NUM-1", r"atof\s*\(|atoi\s*\(|atol\s*\(", "", "Unsafe numeric conversion (no error check)", "CWE-20", 4),
    Rule("cpp", "C-CMDI-1", r"system\s*\(", "", "system() call - command injection risk", "CWE-78", 9),
    Rule("cpp", "C-AUTH-1", r"strcmp\s*\(\s*[^,]+,\s*[^)]*password|strcmp\s*\(\s*[^,]+,\s*[^)]*passwd", "i", "Password comparison with strcmp (timing attack)", "CWE-287", 6),
    Rule("cpp", "C-OFF-1", r"\balloc\s*\([^)]*\*\s*\w+\s*\+|alloc\s*\([^)]*\+\s*\w+", "", "Integer overflow in allocation size", "CWE-190", 7),
    Rule("cpp", "C-INPUT-2", r"\batoi\s*\([^)]*argv", "", "argv parsed without validation", "CWE-20", 5),
    Rule("php", "W-XSS-1", r"\$_GET\s*\[[^\]]*\]\s*[^\n;]*echo|\becho\s+\$_GET|\$\w+\s*=\s*\$_GET\s*\[[^\]]*\]\s*;.*echo", "s", "Reflected XSS: unsanitized GET param echoed", "CWE-79", 9),
    Rule("php", "W-XSS-2", r"\$_REQUEST\s*\[[^\]]*\]\s*[^\n;]*\becho|echo\s+\$_REQUEST", "", "Reflected XSS via _REQUEST", "CWE-79", 8),
    Rule("php", "W-XSS-3", r"\becho\b[^;]*\$_GET\b", "i", "Reflected XSS: unsanitized GET input echoed", "CWE-79", 9),
    Rule("php", "W-SQLI-1", r"mysql_query\s*\(\s*['\"][^'\"]*\$|mysqli_query\s*\(\s*[^,]+,\s*['\"][^'\"]*\$", "", "SQL query with interpolated variable", "CWE-89", 9),
    Rule("php", "W-SQLI-2", r"SELECT\s+.*?\.\s*\$|query\s*\(\s*[\"'][^\"']*\$", "", "SQL string concatenation with variable", "CWE-89", 9),
    Rule("php", "W-SQLI-3", r"\$pdo\s*->\s*query\s*\([^)]*\$|->query\s*\(\s*[\"'][^\"']*\$", "", "PDO query without prepared statement", "CWE-89", 8),
    Rule("php", "W-CMDI-1", r"shell_exec\s*\([^)]*\$|system\s*\([^)]*\$|exec\s*\([^)]*\$|passthru\s*\([^)]*\$|`[^`]*\$", "", "Command execution with variable input", "CWE-78", 9),
    Rule("php", "W-LFI-1", r"include\s*\(\s*\$_GET|require\s*\(\s*\$_GET|include\s*\(\s*\$_POST|require\s*\(\s*\$_POST", "", "Local file inclusion via user input", "CWE-98", 9),
    Rule("php", "W-SSRF-1", r"file_get_contents\s*\(\s*['\"]https?://[^'\"]*\$|curl_exec\s*\(\s*[^)]*\$", "", "Possible SSRF: URL from user input fetched", "CWE-918", 7),
    Rule("php", "W-UPLOAD-1", r"move_uploaded_file\s*\([^)]*\$", "", "File upload without extension/type validation", "CWE-434", 9),
    Rule("php", "W-UPLOAD-2", r"\$_FILES\s*\[[^\]]*\]\s*\[['\"]name", "", "Uploaded file name used unsafely", "CWE-434", 7),
    Rule("php", "W-CRYPTO-1", r"password_hash\s*\([^)]*PASSWORD_DEFAULT|password_verify", "", "Password hashing - verify algorithm is modern", "CWE-521", 4),
    Rule("php", "W-CRYPTO-2", r"md5\s*\([^)]*password|sha1\s*\([^)]*password", "", "Weak hash for password", "CWE-327", 8),
    Rule("php", "W-DESER-1", r"unserialize\s*\(\s*\$_COOKIE|unserialize\s*\(\s*['\"][^'\"]*base64", "", "Unsafe unserialize of user data", "CWE-502", 9),
    Rule("php", "W-AUTH-1", r"session_start\s*\(\s*\)\s*;\s*[^;]*\$_SESSION\s*\[['\"]user['\"]\]\s*=\s*['\"]?1", "", "Weak session auth flag", "CWE-287", 6),
    Rule("php", "W-CSRF-1", r"\$_SERVER\['HTTP_REFERER'\][^\n;]*check|referer\s*==\s*", "", "CSRF protection relying on Referer header only", "CWE-352", 7),
    Rule("php", "W-IDOR-1", r"\$_POST\s*\[['\"]user_id|GET.*id.*=.*\$_GET.*update", "", "Insecure Direct Object Reference: ID from user input", "CWE-639", 8),
    Rule("php", "W-CSRF-2", r"<form.*POST[^>]*>\s*(?!.*csrf|.*token|.*nonce)", "", "Form POST without CSRF token", "CWE-352", 8),
    Rule("php", "W-HARDCODE-1", r"\$(?:password|passwd|secret|api[_-]?key|token|access_key)\w*\s*=\s*['\"][^'\"]{3,}['\"]", "i", "Hardcoded credential in PHP source", "CWE-798", 8),
    Rule("js", "W-XSS-DOM-1", r"innerHTML\s*=\s*[^;]*\b(location\.search|location\.hash|document\.URL|window\.name|document\.referrer)\b", "", "DOM XSS: taint source into innerHTML", "CWE-79", 9),
    Rule("js", "W-XSS-DOM-2", r"document\.write\s*\([^)]*(location|URL|search|referrer|hash|name)", "", "DOM XSS: document.write with tainted source", "CWE-79", 9),
    Rule("js", "W-XSS-JQ-1", r"\.html\s*\(\s*[^)]*(location\.search|location\.hash|document\.URL)", "", "jQuery .html() with tainted source", "CWE-79", 8),
    Rule("js", "W-JSEVAL-1", r"\beval\s*\([^)]*(location|document\.|window\.|req|res|data)", "", "eval() of potentially tainted data", "CWE-95", 9),
    Rule("js", "W-JSEVAL-3", r"\beval\s*\(", "", "Use of eval() - code injection risk", "CWE-95", 8),
    Rule("js", "W-JSEVAL-2", r"new\s+Function\s*\([^)]*(location|document\.|window\.)", "", "Function constructor with tainted data", "CWE-95", 8),
    Rule("js", "W-OPEN-1", r"window\.open\s*\(\s*[^)'\"]+[^)]*\)", "", "window.open with computed URL (open redirect risk)", "CWE-601", 5),
    Rule("js", "W-POSTMSG-1", r"postMessage\s*\([^)]*\*\s*\)", "", "postMessage to '*' - target origin not validated", "CWE-345", 7),
    Rule("js", "W-POSTMSG-2", r"addEventListener\s*\(\s*['\"]message['\"]\s*,[^)]*\{?\s*data\b", "", "message listener without origin check", "CWE-345", 6),
    Rule("js", "W-STORE-1", r"localStorage\.(setItem|getItem)\s*\([^)]*(token|password|secret|credential)", "", "Sensitive data in localStorage", "CWE-312", 7),
    Rule("js", "W-MIXED-1", r"http://", "", "Hardcoded HTTP (mixed content) URL", "CWE-319", 4),
    Rule("js", "W-RANDOM-1", r"Math\.random\s*\(\s*\)\s*[^;]*(password|token|key|secret)", "", "Math.random used for security token", "CWE-330", 8),
    Rule("html", "W-HTML-EVAL-1", r"<script[^>]*>\s*eval\s*\(", "i", "Inline script using eval()", "CWE-95", 8),
    Rule("html", "W-HTML-JS-1", r"<a\s+[^>]*href\s*=\s*['\"]javascript:", "i", "javascript: URI in href", "CWE-79", 7),
    Rule("html", "W-HTML-JS-2", r"<iframe[^>]*src\s*=\s*['\"]\s*javascript:", "i", "javascript: URI in iframe", "CWE-79", 7),
    Rule("html", "W-HTML-EH-1", r"onerror\s*=|onload\s*=.*(alert|document\.|fetch)", "i", "Inline event handler executing code", "CWE-79", 6),
    Rule("html", "W-HTML-FORM-1", r"<form\b(?:(?!action\s*=)[^>])*>", "i", "Form without action attribute", "CWE-20", 3),
    Rule("html", "W-HTML-AUTO-1", r"<input[^>]*type\s*=\s*['\"]password['\"][^>]*(?!.*autocomplete)", "i", "Password field without autocomplete handling", "CWE-521", 3),
    Rule("css", "W-CSS-EXPR-1", r"expression\s*\(", "i", "CSS expression() - legacy code execution vector", "CWE-79", 7),
    Rule("css", "W-CSS-URL-1", r"url\s*\(\s*['\"]?\s*javascript:", "i", "javascript: URL in CSS", "CWE-79", 8),
    Rule("css", "W-CSS-BEH-1", r"behavior\s*:\s*url", "i", "IE behavior URL (remote script execution)", "CWE-79", 8),
    Rule("go", "G-CMDI-1", r"\bexec\.Command\s*\(\s*['\"]?(?:/bin/)?(?:ba)?sh['\"]", "", "Shell invocation via exec.Command allows command injection", "CWE-78", 8),
    Rule("go", "G-CMDI-2", r"\bos/exec\.[A-Za-z]*Command\s*\([^)]*\.\.\.", "", "exec.Command built from variable arguments", "CWE-78", 7),
    Rule("go", "G-HARDCODE-1", r"(?i)\b(?:password|passwd|secret|apikey|api[_-]key|token)\b\s*[:=]\s*[\"'][^\"']{6,}[\"']", "", "Hardcoded credential in Go source", "CWE-798", 8),
    Rule("go", "G-CRYPTO-1", r"\bcrypto/(?:md5|sha1)\b", "", "Weak hash algorithm (MD5/SHA-1) imported", "CWE-327", 6),
    Rule("go", "G-CLEAR-1", r"(?i)\bhttp://(?!localhost|127\.0\.0\.1)", "", "Cleartext HTTP URL in Go code", "CWE-319", 4),
    Rule("go", "G-TLS-1", r"\btls\.Config\s*\{[^}]*InsecureSkipVerify\s*:\s*true", "", "TLS certificate verification disabled", "CWE-295", 8),
    Rule("go", "G-SQLI-1", r"\bfmt\.Sprintf\s*\(\s*['\"](?:SELECT|INSERT|UPDATE)", "", "SQL query built with fmt.Sprintf", "CWE-89", 8),
    Rule("go", "G-XSS-1", r"\btemplate\.HTML\s*\(", "", "template.HTML bypasses auto-escaping", "CWE-79", 7),
    Rule("ruby", "R-CMDI-1", r"\beval\s*\(|instance_eval\b|class_eval\b", "", "eval() usage enables code injection", "CWE-95", 9),
    Rule("ruby", "R-CMDI-2", r"`[^`]*#\{|\bsystem\s*\(|%x\(|\bexec\s*\(|IO\.popen\b", "", "Shell command with interpolated input", "CWE-78", 9),
    Rule("ruby", "R-HARDCODE-1", r"(?i)\b(?:password|secret|api[_-]key|token)\b\s*[:=]\s*['\"][^'\"]{6,}['\"]", "", "Hardcoded credential in Ruby source", "CWE-798", 8),
    Rule("ruby", "R-SQLI-1", r"\bActiveRecord::Base\.connection\.execute\b|\bfind_by_sql\s*\(", "", "Raw SQL with interpolation", "CWE-89", 9),
    Rule("ruby", "R-XSS-1", r"\brender\s+text\s*=>|\brender\s+:text\s*=>", "", "render :text may output unsanitized data", "CWE-79", 6),
    Rule("ruby", "R-TLS-1", r"\bverify_mode\s*=\s*OpenSSL::SSL::VERIFY_NONE\b", "", "SSL certificate verification disabled", "CWE-295", 8),
    Rule("ruby", "R-CRYPTO-1", r"\bDigest::(?:MD5|SHA1)\b", "", "Weak hash (MD5/SHA-1)", "CWE-327", 6),
    Rule("ruby", "R-DESER-1", r"\bYAML\.load\s*\((?!.*safe)", "", "Unsafe YAML.load deserialization", "CWE-502", 8),
    Rule("rust", "RS-UNSAFE-1", r"\bunsafe\s*\{", "", "unsafe block disables memory safety guarantees", "CWE-120", 6),
    Rule("rust", "RS-CMDI-1", r"\bstd::process::Command::new\s*\(\s*[\"']?(?:sh|bash|cmd)[\"']", "", "Spawning a shell via Command::new", "CWE-78", 8),
    Rule("rust", "RS-HARDCODE-1", r"(?i)\b(?:password|secret|api[_-]key|token)\b\s*[:=]\s*[\"'][^\"']{6,}[\"']", "", "Hardcoded credential in Rust source", "CWE-798", 8),
    Rule("rust", "RS-ERR-1", r"\bunwrap\s*\(\s*\)\s*;?\s*$", "", "unwrap() can panic on untrusted input (DoS)", "CWE-20", 3),
    Rule("rust", "RS-CRYPTO-1", r"\b(?:md5|sha1)::", "", "Weak hash crate (md5/sha1)", "CWE-327", 6),
    Rule("csharp", "C-CMDI-1", r"\bProcess\.Start\s*\([^)]*(?:cmd|powershell)|\bUseShellExecute\s*=\s*true", "", "Process.Start via shell allows command injection", "CWE-78", 8),
    Rule("csharp", "C-SQLI-1", r"\b(?:new\s+)?(?:Sql(?:Client\.)?)?Sql(?:Client\.)?Command(?:Builder)?\s*\([^)]*\+\s*\w+|\b(?:new\s+)?SqlCommand\s*\([^)]*\+\s*\w+", "", "SqlCommand built with string concatenation", "CWE-89", 9),
    Rule("csharp", "C-HARDCODE-1", r"(?i)\b(?:string\s+)?(?:password|passwd|pwd|secret|apikey|api[_-]key|access[_-]?key|token)\w*\s*=\s*\"[^\"]{6,}\"", "", "Hardcoded credential in C# source", "CWE-798", 8),
    Rule("csharp", "C-CRYPTO-1", r"\b(?:MD5|SHA1)\.Create\b|\bnew\s+MD5CryptoServiceProvider\b", "", "Weak hash algorithm (MD5/SHA-1)", "CWE-327", 6),
    Rule("csharp", "C-XSS-1", r"\bResponse\.Write\s*\(\s*Request[.\[]|<%=\s*Request\[", "i", "Reflected request value written to response", "CWE-79", 9),
    Rule("csharp", "C-SSRF-1", r"\bDns\.GetHostAddresses\b|\bWebRequest\.Create\s*\(\s*\w+\s*\)", "", "Possible SSRF: URL taken from variable", "CWE-918", 6),
    Rule("csharp", "C-RANDOM-1", r"\bRandom\s+\w+\s*=\s*new\s+Random\s*\(\s*\)", "", "System.Random is not cryptographically secure", "CWE-330", 6),
    Rule("csharp", "C-VALID-1", r"\bValidateRequest\s*=\s*false\b|\bvalidateIntegratedModeConfiguration\b", "", "ASP.NET request validation disabled", "CWE-20", 6),
    Rule("kotlin", "K-CMDI-1", r"\bRuntime\.getRuntime\(\)\.exec\s*\(", "", "Runtime.exec with dynamic command", "CWE-78", 8),
    Rule("kotlin", "K-HARDCODE-1", r"(?i)\b(?:password|secret|api[_-]key|apikey|token)\b\s*=\s*\"[^\"]{6,}\"", "", "Hardcoded credential in Kotlin source", "CWE-798", 8),
    Rule("kotlin", "K-SQLI-1", r"\brawQuery\s*\(|\bexecSQL\s*\([^)]*\$", "", "SQLite raw query with interpolated value", "CWE-89", 8),
    Rule("kotlin", "K-ANDROID-1", r"\ballowBackup\s*=\s*true\b|\bexported\s*=\s*true\b", "", "Android component exported/backup enabled - review exposure", "CWE-926", 4),
    Rule("kotlin", "K-CRYPTO-1", r"\bMessageDigest\.getInstance\s*\(\s*\"(?:MD5|SHA-?1)\"", "", "Weak hash algorithm (MD5/SHA-1)", "CWE-327", 6),
    Rule("kotlin", "K-WEBVIEW-1", r"\bWebView[a-zA-Z]*\.setJavaScriptEnabled\s*\(\s*true", "", "JavaScript enabled in WebView", "CWE-79", 6),
    Rule("swift", "S-HARDCODE-1", r"(?i)\b(?:password|secret|api[_-]key|apikey|token)\b\s*[:=]\s*\"[^\"]{6,}\"", "", "Hardcoded credential in Swift source", "CWE-798", 8),
    Rule("swift", "S-CMDI-1", r"\bProcess\s*\(\s*\)|\bposix_spawn\b", "", "Process spawned from Swift code", "CWE-78", 7),
    Rule("swift", "S-TLS-1", r"\bkSecTrustSettings\b|\bURLSession\.shared\.delegate\b|\ballowsArbitraryLoads\b", "", "ATS/TLS restrictions relaxed", "CWE-295", 7),
    Rule("swift", "S-CRYPTO-1", r"\bInsecure\.(?:MD5|SHA1)\b", "", "Weak hash algorithm (MD5/SHA-1)", "CWE-327", 6),
    Rule("swift", "S-JSINJ-1", r"\bevaluateJavaScript\s*\(\s*(?!.*static)", "", "WKWebView evaluateJavaScript with dynamic content", "CWE-95", 6),
    Rule("shell", "SH-EVAL-1", r"\beval\s+[\$\"]", "", "eval on expanded variables enables code injection", "CWE-95", 9),
    Rule("shell", "SH-DL-1", r"\bcurl[^|]*\|\s*(?:ba)?sh\b|\bwget[^|]*\|\s*(?:ba)?sh\b", "", "Remote script piped directly into shell", "CWE-494", 9),
    Rule("shell", "SH-HARDCODE-1", r"(?i)\b(?:password|passwd|secret|token)\b\s*=\s*['\"][^'\"]{4,}['\"]", "", "Hardcoded credential in shell script", "CWE-798", 8),
    Rule("shell", "SH-DESTR-1", r"\brm\s+-rf?\s+[\"\$]", "", "rm -rf with variable path is dangerous", "CWE-78", 7),
    Rule("shell", "SH-PERM-1", r"\bchmod\s+(?:777|666)\b", "", "World-writable permissions set", "CWE-732", 6),
    Rule("shell", "SH-REV-1", r"\bnc\s+-[el]\b|\bmkfifo\b.*\bnc\b", "", "Possible reverse-shell primitive (nc listener)", "CWE-78", 8),
    Rule("shell", "SH-SSH-1", r"\bsshpass\b|\bssh\b[^\n]*-oStrictHostKeyChecking=no\b", "", "SSH host-key checking disabled or cleartext password tool", "CWE-322", 7),
    Rule("sql", "Q-GRANT-1", r"(?i)\bGRANT\s+ALL\s+PRIVILEGES\b", "", "GRANT ALL PRIVILEGES - excessive permissions", "CWE-250", 7),
    Rule("sql", "Q-PASS-1", r"(?i)\bCREATE\s+(?:USER|LOGIN)\s+\w+\s+WITH\s+PASSWORD\s*=\s*'[^']{1,7}'", "", "Weak password in CREATE USER", "CWE-521", 7),
    Rule("sql", "Q-PASS-2", r"(?i)\bIDENTIFIED\s+BY\s+'[^']{1,7}'", "", "Short password in IDENTIFIED BY clause", "CWE-521", 7),
    Rule("sql", "Q-DYN-1", r"(?i)\bEXECUTE\s+IMMEDIATE\s*\|\||\bsp_executesql\s*@sql\b", "", "Dynamic SQL execution", "CWE-89", 6),
    Rule("sql", "Q-TLS-1", r"(?i)\bENCRYPTION\s*=\s*NO\b|\bsslmode\s*=\s*disable\b", "", "Connection encryption disabled", "CWE-319", 6),
]

#: Scanner name of a rule group.
SCANNERS = {g: f"{'web' if g in ('php', 'js', 'html', 'css') else g}-heuristic" for g in dict.fromkeys(r.group for r in RULES)}


def java_pattern(rule: Rule) -> str:
    """The pattern with the meaning it has in Python: Unicode classes, and only \\n ends a line."""
    return f"(?Ud{rule.flags})" + rule.pattern


def rules_named(group: str, *rule_ids: str) -> list[Rule]:
    """The built-in rules of a group with these ids."""
    return [r for r in RULES if r.group == group and r.rule_id in rule_ids]
