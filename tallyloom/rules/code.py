"""Line rules for source text.

Columns: id, severity, type, CWE, a literal every match must contain (tested
first because it is cheap; empty = none), pattern. Patterns ignore case unless
the type is ``style``.
"""

# Ids, grades, CWE numbers and patterns (braces escaped).
RULES = [
    ("JAVA-SEC-001", "critical", "security", "CWE-89", "(",
     r"(?:Statement|createStatement|executeQuery|executeUpdate)\s*\([^)]*\+[^)]*\)"),
    ("JAVA-SEC-002", "critical", "security", "CWE-78", "(",
     r"(?:Runtime\.getRuntime|ProcessBuilder)\s*\([^)]*\+[^)]*\)"),
    ("JAVA-SEC-003", "high", "security", "CWE-22", "(",
     r"(?:FileInputStream|FileOutputStream|Files\.(?:read|write)|Path\.of)\s*\([^)]*\+[^)]*\)"),
    ("JAVA-SEC-004", "high", "security", "CWE-798", "=",
     r"(?:password|passwd|pwd|secret|api[_-]?key|token|auth)\s*=\s*\"[^\"]+\""),
    ("JAVA-SEC-005", "medium", "security", "CWE-330", "(",
     r"\bRandom\s+\w+\s*=\s*new\s+Random\s*\(\s*\)"),
    ("JAVA-SEC-006", "high", "security", "CWE-79", "(",
     r"(?:setInnerHTML|document\.write|appendChild\s*\([^)]*innerHTML)\s*\("),
    ("JAVA-SEC-007", "high", "security", "CWE-295", "(",
     r"(?:setHostnameVerifier|TrustManager|SSLContext)\s*\([^)]*(?:ALLOW_ALL|TRUST_ALL|NO_VERIFY)"),
    ("JAVA-STYLE-001", "low", "style", "", "class", r"^public\s+class\s+[a-z][a-zA-Z0-9]*"),
    ("JAVA-STYLE-002", "low", "style", "", "(",
     r"^\s*(?:public|private|protected)?\s*(?:static)?\s*\w+\s+[a-z][a-zA-Z0-9]*\s*\("),
    ("JAVA-STYLE-003", "low", "style", "", "=", r"public\s+static\s+final\s+[a-z_]+\s+="),
    ("JAVA-STYLE-004", "medium", "maintainability", "", "{",
     r"^\s*(?:public|private|protected)?\s*(?:static)?\s*\w+\s+\w+\s*\([^)]*\)\s*\{"),
    ("JAVA-STYLE-005", "medium", "maintainability", "", "", r"^public\s+class\s+\w+"),
    ("JAVA-STYLE-006", "info", "maintainability", "", "", r"^public\s+class\s+\w+"),
    ("JAVA-STYLE-007", "low", "maintainability", "", "(",
     r"(?:if|while|switch)\s*\([^)]*\b(?:[0-9]{2,}|\"[^\"]+\")\b[^)]*\)"),
    ("JAVA-PERF-001", "medium", "performance", "", "+",
     r"\+\s*\"[^\"]*\"\s*\+\s*\"[^\"]*\"\s*\+"),
    ("JAVA-PERF-002", "high", "bug", "CWE-404", "=",
     r"(?:FileInputStream|FileOutputStream|BufferedReader|Connection)\s+\w+\s*=\s*new"),
    ("JAVA-PERF-003", "low", "performance", "", "(",
     r"(?:ArrayList|LinkedList|HashMap)\s*\([^)]*\)\s*\.(?:get|contains)\s*\("),
    ("JAVA-PERF-004", "high", "bug", "", "{", r"\}\s*catch\s*\([^)]*\)\s*\{\s*\}"),
    ("JAVA-PERF-005", "medium", "performance", "", "{", r"(?:for|while)\s*\([^)]*\)\s*\{[^\}]*executeQuery"),
    ("PY-SEC-001", "critical", "security", "CWE-89", "(",
     r"(?:execute|cursor\.execute)\s*\([^)]*(?:\%|\.format|f['\"]|\+)[^)]*(?:SELECT|INSERT|UPDATE|DELETE)"),
    ("PY-SEC-002", "critical", "security", "CWE-78", "(",
     r"(?:os\.system|subprocess\.(?:call|run|Popen)|os\.popen)\s*\([^)]*(?:\%|\.format|f['\"]|\+)"),
    ("PY-SEC-003", "high", "security", "CWE-22", "(",
     r"(?:open|Path|os\.path\.join)\s*\([^)]*(?:\.\./|\.\.\\\\|\$|\{)"),
    ("PY-SEC-004", "high", "security", "CWE-798", "=",
     r"(?:password|passwd|pwd|secret|api[_-]?key|token|auth)\s*=\s*['\"][^'\"]+['\"]"),
    ("PY-SEC-005", "high", "security", "CWE-502", "(", r"\bpickle\.(?:load|loads)\s*\("),
    ("PY-SEC-006", "high", "security", "CWE-95", "(", r"\b(?:eval|exec)\s*\("),
    ("PY-SEC-007", "medium", "security", "CWE-330", "(", r"\brandom\.(?:random|randint|choice|shuffle)\s*\("),
    ("PY-SEC-008", "high", "security", "CWE-295", "(",
     r"(?:requests\.(?:get|post)|urlopen)\s*\([^)]*verify\s*=\s*False"),
    ("PY-STYLE-001", "low", "style", "", "\t", r"^(    )*\t"),
    ("PY-STYLE-002", "low", "style", "", "", r"^.{120,}$"),
    ("PY-STYLE-003", "medium", "maintainability", "", "(", r"^def\s+\w+\s*\("),
    ("PY-STYLE-004", "info", "maintainability", "", "(", r"^def\s+\w+\s*\([^)]*\)\s*:"),
    ("PY-STYLE-005", "low", "style", "", "\n", r"^import\s+\w+.*\nfrom\s+\w+"),
    ("PY-STYLE-006", "low", "style", "", "=", r"^\s*(?:[A-Z]{2,}|[a-z][A-Z])\s*="),
    ("PY-PERF-001", "medium", "performance", "", "\n", r"(?:for|while)\s+.*:\s*\n\s+.*\+=\s*\["),
    ("PY-PERF-002", "high", "bug", "", "(", r"(?:open|io\.open)\s*\([^)]*\)(?!\s*with)"),
    ("PY-PERF-003", "low", "performance", "", "[", r"(?:if|while).*in\s+\["),
    ("PY-PERF-004", "high", "bug", "", ":", r"except\s*:"),
    ("PY-PERF-005", "medium", "maintainability", "", "", r"^\s*global\s+\w+"),
]
# What a finding means and what to do about it, by rule; own wording.
MESSAGES = {
    "JAVA-SEC-001": ("SQL text is put together from variables", "bind the values as parameters"),
    "JAVA-SEC-002": ("a command line is put together from variables", "pass a fixed program and a list of arguments"),
    "JAVA-SEC-003": ("a file path is put together from variables", "resolve the path and compare it with an allowed folder"),
    "JAVA-SEC-004": ("a secret is written in the source", "read it from the environment or a vault"),
    "JAVA-SEC-005": ("the random numbers can be guessed", "take SecureRandom where secrecy matters"),
    "JAVA-SEC-006": ("text goes into a page unescaped", "escape it or set it as plain text"),
    "JAVA-SEC-007": ("certificate checks are switched off", "keep the default checks and add the needed certificate"),
    "JAVA-STYLE-001": ("a class name starts with a small letter", "start class names with a capital"),
    "JAVA-STYLE-002": ("check the name of this method", "name methods by a verb in camel case"),
    "JAVA-STYLE-003": ("a constant is written in small letters", "write constants in capitals with underscores"),
    "JAVA-STYLE-004": ("check the length of this method", "split methods that do several things"),
    "JAVA-STYLE-005": ("check the size of this class", "move separate duties to classes of their own"),
    "JAVA-STYLE-006": ("a public class without a description nearby", "say in a comment what the class is for"),
    "JAVA-STYLE-007": ("a bare number or text decides a branch", "give the value a name"),
    "JAVA-PERF-001": ("strings are added one by one", "use a StringBuilder"),
    "JAVA-PERF-002": ("a resource may stay open", "open it in a try-with-resources"),
    "JAVA-PERF-003": ("a collection is made only to look something up", "keep the collection or take a fitting one"),
    "JAVA-PERF-004": ("an exception is swallowed", "handle it or pass it on"),
    "JAVA-PERF-005": ("a query runs in a loop", "fetch all rows with one query"),
    "PY-SEC-001": ("SQL text is put together from variables", "bind the values as parameters"),
    "PY-SEC-002": ("a shell command is put together from variables", "pass a list of arguments without a shell"),
    "PY-SEC-003": ("a file path may leave its folder", "resolve the path and compare it with an allowed folder"),
    "PY-SEC-004": ("a secret is written in the source", "read it from the environment or a vault"),
    "PY-SEC-005": ("unpickling runs code from the data", "use JSON or another plain format"),
    "PY-SEC-006": ("text is run as code", "parse the value instead"),
    "PY-SEC-007": ("the random numbers can be guessed", "take the secrets module where secrecy matters"),
    "PY-SEC-008": ("certificate checks are switched off", "keep the checks and name a certificate file"),
    "PY-STYLE-001": ("tabs and spaces are mixed", "indent by four spaces"),
    "PY-STYLE-002": ("the line is very long", "break it at a bracket"),
    "PY-STYLE-003": ("check the name and size of this function", "name functions in small letters and keep them short"),
    "PY-STYLE-004": ("a function without a result type", "add type hints"),
    "PY-STYLE-005": ("imports are not in groups", "group imports by origin and sort them"),
    "PY-STYLE-006": ("check the case of this name", "use capitals for constants only"),
    "PY-PERF-001": ("a list grows by concatenation in a loop", "append or use a comprehension"),
    "PY-PERF-002": ("a file may stay open", "open it in a with block"),
    "PY-PERF-003": ("membership is tested in a list", "use a set"),
    "PY-PERF-004": ("every exception is caught", "name the exceptions that are expected"),
    "PY-PERF-005": ("a global variable is written", "pass the value in and return it"),
}
# Grades from worst to mildest.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
# Severity, priority, deadline.
DEADLINES = [
    ("critical", "P0", "now"),
    ("high", "P1", "24 hours"),
    ("medium", "P2", "1 week"),
    ("low", "P3", "next iteration"),
    ("info", "P4", "optional"),
]
# Line starts that make a line a comment.
COMMENT_STARTS = {"java": ["//", "*", "/*"], "python": ["#"]}
# Folders left out of a scan, as parts of the path.
EXCLUDED = ["node_modules", ".git", "build", "dist", "venv", "__pycache__", ".idea", "target"]
EXTENSIONS = {"java": ".java", "python": ".py"}
# Fixed value: marker in front of disable= and enable= switches.
SWITCH = "scan-rules: "
SCENARIOS = ["normal", "boundary", "exception"]
