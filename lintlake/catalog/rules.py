"""The rule catalog.

Fixed values: ids, patterns, severities, confidences, languages and messages are
part of every result and keep these exact texts. ``{0}`` .. ``{2}`` in a text
stand for values found in the line.
"""

from __future__ import annotations

from dataclasses import dataclass

from lintlake.catalog.dims import label

JS_TS = ("javascript", "typescript")
# comment_mode: which line beginnings (after trimming) a rule does not look at
SKIP = {
    "none": (),
    "hash": ("//", "#", "*"),
    "hash_blank": ("//", "#", "*"),
    "html": ("//", "#", "*", "<!--"),
}


@dataclass(frozen=True)
class Rule:
    uid: str
    analyzer: int          # order in which analyzers report
    step: int              # loop order inside the analyzer
    rule_id: str
    category: str
    severity: str
    confidence: float
    langs: tuple[str, ...] | None
    pattern: str | None
    message: str
    explanation: str
    fix: str
    ignore_case: bool = False
    comment_mode: str = "none"
    needs: tuple[str, ...] = ()     # the line holds one of these whenever the pattern matches
    needs_lower: tuple[str, ...] = ()   # the same for the line in lower case
    also: str | None = None         # a simpler pattern that then matches too (keeps long lines linear)
    unless: str | None = None       # and this does not match
    families: tuple[str, ...] | None = None


SECURITY, PERFORMANCE, COMPLEXITY, RUNTIME, STRUCTURE, USER, CONTEXT = 1, 2, 3, 4, 5, 6, 7


_VERBS = ("select", "insert", "update", "delete", "drop", "alter", "create", "exec")
NEEDS_LOWER = {"S01": _VERBS, "S02": ("execute",), "S08": ("passw", "secret", "key", "token"), "S12": ("md5", "sha1"),
               "P08": ("select",), "P09": ("select",)}
ALSO = {"P01": r"\+\s*=\s*['\"`]", "P07": r"\{\s*\.\.\."}


def _catalog(prefix: str, analyzer: int, mode: str, rows: list[tuple]) -> list[Rule]:
    rules = []
    for uid, cat, sev, conf, langs, pattern, icase, needs, msg, why, fix in rows:
        rules.append(Rule(uid, analyzer, 0, f"{prefix}/{label(cat)}", cat, sev, conf, langs, pattern,
                          msg, why, fix, ignore_case=icase, comment_mode=mode, needs=needs,
                          needs_lower=NEEDS_LOWER.get(uid, ()), also=ALSO.get(uid)))
    return rules


SECURITY_RULES = _catalog("security", SECURITY, "html", [
    ("S01", "SQLInjection", "Critical", 0.85, None,
     r"(\+\s*['\"`]?\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|EXEC)\b|\bquery\s*\(\s*['\"`]\s*(?:SELECT|INSERT|UPDATE|DELETE).*\$\{|\.format\s*\(\s*['\"`].*(?:SELECT|INSERT|UPDATE|DELETE))", True, (),
     "Potential SQL injection via string concatenation",
     "SQL text is glued together from pieces; a value from outside can change the statement.",
     "Bind values as statement parameters."),
    ("S02", "SQLInjection", "Critical", 0.9, ("python", "ruby", "php"),
     r"\bexecute\s*\(\s*f?['\"`].*(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b", True, (),
     "SQL query built with string interpolation",
     "The statement handed to execute holds interpolated values.",
     "Pass the values separately and use placeholders in the statement."),
    ("S03", "CommandInjection", "Critical", 0.85, JS_TS,
     r"\b(?:exec|execSync|spawn|spawnSync|execFile)\s*\([^)]*\+", False, ("exec", "spawn"),
     "Potential command injection via string concatenation in process execution",
     "A command line joined from strings lets input add commands of its own.",
     "Give the arguments as a list, and check them first."),
    ("S04", "CommandInjection", "Critical", 0.85, ("python",),
     r"\bos\.system\s*\(|subprocess\.call\s*\(\s*[^[\]]*\+|subprocess\.Popen\s*\(\s*[^[\]]*\+", False, ("os.system", "subprocess."),
     "Potential command injection in process execution",
     "The shell parses the joined string, so input can add commands.",
     "Call subprocess.run with a list of arguments and without a shell."),
    ("S05", "CommandInjection", "Critical", 0.85, ("java",),
     r"Runtime\.getRuntime\(\)\.exec\s*\([^)]*\+", False, ("Runtime.getRuntime()",),
     "Potential command injection in Runtime.exec",
     "The command is joined from strings before it is run.",
     "Start the program through ProcessBuilder, one argument per element."),
    ("S06", "XSSRisk", "Critical", 0.8, JS_TS,
     r"\.innerHTML\s*=(?!=)|\.outerHTML\s*=(?!=)|document\.write\s*\(", False, (".innerHTML", ".outerHTML", "document.write"),
     "Potential XSS vulnerability via unsafe DOM manipulation",
     "Markup written straight into the page runs whatever script it holds.",
     "Write text nodes, or clean the markup with a sanitizer first."),
    ("S07", "XSSRisk", "High", 0.75, JS_TS,
     r"\bdangerouslySetInnerHTML\b", False, ("dangerouslySetInnerHTML",),
     "dangerouslySetInnerHTML used — XSS risk",
     "This property switches off the escaping that protects the page.",
     "Sanitize the markup before it is set, or render it another way."),
    ("S08", "HardcodedSecret", "Critical", 0.8, None,
     r"(?:password|passwd|secret|api_?key|access_?key|auth_?token|private_?key)\s*[:=]\s*['\"`][^'\"`]{4,}", True, (),
     "Potential hardcoded secret or credential",
     "Whoever can read the source or its history can read this credential.",
     "Load it from the environment or a secret store."),
    ("S09", "HardcodedSecret", "Critical", 0.95, None,
     r"(?:AKIA[0-9A-Z]{16}|(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}|sk-[A-Za-z0-9]{32,})", False, ("AKIA", "gh", "sk-"),
     "Potential hardcoded API key or token detected",
     "The text has the shape of a live service token.",
     "Revoke the token and keep its successor in a secret store."),
    ("S10", "SecurityVulnerability", "Critical", 0.9, ("javascript", "typescript", "python", "php", "ruby"),
     r"\beval\s*\(", False, ("eval",),
     "Use of eval() is a security risk",
     "Text that reaches eval is run as code.",
     "Parse the data with a proper parser."),
    ("S11", "SecurityVulnerability", "High", 0.85, JS_TS,
     r"new\s+Function\s*\(", False, ("Function",),
     "Dynamic Function constructor used — similar risk to eval()",
     "Code is compiled from text at run time.",
     "Write the function out in the source."),
    ("S12", "SecurityVulnerability", "High", 0.85, None,
     r"\b(?:md5|sha1)\s*\(|createHash\s*\(\s*['\"`](?:md5|sha1)['\"`]\)", True, (),
     "Weak cryptographic hash function used",
     "Collisions for MD5 and SHA-1 can be made to order.",
     "Move to SHA-256 or a newer hash."),
    ("S13", "ImproperInputValidation", "Medium", 0.4, None,
     r"\.\./", False, ("../",),
     "Path traversal pattern detected",
     "A parent-folder step in a path may lead outside the intended folder.",
     "Resolve the path and check that it stays below the allowed root."),
    ("S14", "SecurityVulnerability", "Critical", 0.8, ("python",),
     r"\bpickle\.loads?\s*\(|yaml\.load\s*\([^)]*(?:Loader\s*=\s*yaml\.(?:Unsafe|Full)Loader)?[^)]*\)", False, ("pickle.load", "yaml.load"),
     "Potentially unsafe deserialization",
     "Loading such data can run code that its sender chose.",
     "Read it with json or yaml.safe_load."),
    ("S15", "ImproperInputValidation", "High", 0.75, JS_TS,
     r"res\.redirect\s*\([^)]*(?:req\.|params|query)", False, ("res.redirect",),
     "Potential open redirect vulnerability",
     "The request decides where the visitor is sent.",
     "Compare the target with a list of known places."),
    ("S16", "SecurityVulnerability", "Critical", 0.85, None,
     r"verify\s*[:=]\s*(?:false|False|FALSE)|rejectUnauthorized\s*[:=]\s*(?:false|False)", False, ("verify", "rejectUnauthorized"),
     "SSL/TLS certificate verification disabled",
     "Without the check anyone on the path can pose as the server.",
     "Leave verification on and install the right certificate authority."),
    ("S17", "SecurityVulnerability", "Medium", 0.7, None,
     r"Access-Control-Allow-Origin['\":\s]*\*", False, ("Access-Control-Allow-Origin",),
     "Wildcard CORS policy detected",
     "Every site may read answers from this service.",
     "Name the origins that need access."),
    ("S18", "CommandInjection", "High", 0.6, ("shellscript",),
     r"\$\{?\w+\}?\s*(?:;|&&|\|)", False, ("$",),
     "Potential shell injection via unquoted variable",
     "The shell splits and expands an unquoted value.",
     "Put double quotes around the variable."),
])

PERFORMANCE_RULES = _catalog("performance", PERFORMANCE, "hash", [
    ("P01", "PerformanceBottleneck", "Medium", 0.7, None,
     r"(?:for|while|do)\s*[\s\S]*?\+\s*=\s*['\"`]", False, ("for", "while", "do"),
     "String concatenation inside a loop",
     "Each round copies the string built so far.",
     "Collect the parts and join them once."),
    ("P02", "InefficientLoop", "Medium", 0.75, JS_TS,
     r"\.(?:find|filter|some|every|indexOf|includes)\s*\([\s\S]*?\.(?:find|filter|some|every|indexOf|includes)\s*\(", False, (),
     "Nested array search operations (O(n²) complexity)",
     "One search runs inside another, so the work grows with the square of the size.",
     "Build a Set or Map of one side and look values up in it."),
    ("P03", "UnnecessaryObjectCreation", "Medium", 0.85, None,
     r"(?:for|while)\s*\([\s\S]*?new\s+RegExp\s*\(", False, ("RegExp",),
     "RegExp created inside a loop",
     "The expression is compiled again in every round.",
     "Compile it once before the loop."),
    ("P04", "BlockingIO", "Medium", 0.7, JS_TS,
     r"\b(?:readFileSync|writeFileSync|appendFileSync|existsSync|mkdirSync|readdirSync|statSync)\s*\(", False, ("Sync",),
     "Synchronous file I/O operation detected",
     "Nothing else runs while the call waits for the disk.",
     "Await the asynchronous form."),
    ("P05", "PerformanceBottleneck", "Low", 0.5, JS_TS,
     r"\bconsole\.(log|debug|info|warn|error|trace)\s*\(", False, ("console.",),
     "Console output statement found",
     "Console output costs time and may show internals.",
     "Send it through a logger whose level can be set."),
    ("P06", "PerformanceBottleneck", "High", 0.7, None,
     r"(?:for|while|\.forEach|\.map)\s*[\s\S]*?(?:\.query\s*\(|\.execute\s*\(|\.find\s*\(|\.findOne\s*\(|await\s+fetch\s*\()", False, (".query", ".execute", ".find", "fetch"),
     "Potential N+1 query pattern detected",
     "A query or request is sent once per element.",
     "Fetch all elements with one query."),
    ("P07", "UnnecessaryObjectCreation", "Low", 0.5, JS_TS,
     r"(?:for|while|\.forEach|\.map)\s*[\s\S]*?\{\s*\.\.\.", False, ("...",),
     "Object spread inside a loop",
     "Each round copies the whole object.",
     "Gather the changes and merge them after the loop."),
    ("P08", "PerformanceBottleneck", "Medium", 0.6, None,
     r"SELECT\s+\*\s+FROM", True, ("*",),
     "SELECT * query detected",
     "Columns nobody uses are read and sent.",
     "List the columns that are needed."),
    ("P09", "PerformanceBottleneck", "Low", 0.4, ("sql",),
     r"SELECT\s+[\s\S]*?FROM\s+\w+\s*(?:;|$)(?!\s*WHERE)", True, (),
     "Query without WHERE clause — full table scan likely",
     "The query reads the table from end to end.",
     "Restrict the rows with a WHERE clause."),
    ("P10", "PerformanceBottleneck", "Low", 0.6, ("java",),
     r"System\.(?:out|err)\.print(?:ln)?\s*\(", False, ("System.",),
     "System.out/err print statement found",
     "Printing blocks the caller and cannot be switched off.",
     "Use a logging library."),
    ("P11", "BadPractice", "Low", 0.4, ("python",),
     r"^\s*print\s*\(", False, ("print",),
     "Print statement found — consider using logging",
     "Printed lines carry no level and no origin.",
     "Write through the logging module."),
    ("P12", "PerformanceBottleneck", "Low", 0.3, ("python",),
     r"(?:for|while)\s+[\s\S]*?(?:len|range|type|str|int|float|list|dict|set|tuple)\s*\(", False, ("for", "while"),
     "Global function called inside loop — consider local reference",
     "A built-in is looked up again in every round.",
     "Bind it to a local name ahead of the loop."),
])

RUNTIME_RULES = _catalog("runtime", RUNTIME, "hash_blank", [
    ("R01", "RuntimeRisk", "High", 0.3, JS_TS,
     r"(\w+)\.(\w+)(?!\s*[!=<>])(?!\s*\?\.)(?:(?!\bif\b|\bwhile\b|\?\.).)*$", False, (".",),
     "Potential null/undefined dereference",
     "The object before the dot may be missing.",
     "Test it first, or use optional chaining."),
    ("R02", "RuntimeRisk", "High", 0.4, None,
     r"\/\s*(\w+)(?!\s*[=!])(?:\s*[;,)\]])", False, ("/",),
     "Potential division by zero",
     "The divisor is not known to differ from zero.",
     "Test the divisor before dividing."),
    ("R03", "RuntimeRisk", "Medium", 0.3, None,
     r"\[(\w+)\](?!\s*=)(?!\s*\?)(?:(?!\blength\b|\bsize\b).)*$", False, ("[",),
     "Array access without bounds check",
     "The index may lie outside the array.",
     "Compare the index with the length first."),
    ("R04", "RuntimeRisk", "High", 0.6, JS_TS,
     r"(?:new\s+Promise|\.then\s*\()(?:(?!\.catch|\.finally).)*$", False, ("Promise", ".then"),
     "Promise without catch/error handler",
     "A rejection here goes unseen or ends the process.",
     "Attach .catch(), or await it inside try/catch."),
    ("R05", "RuntimeRisk", "Medium", 0.3, ("javascript", "typescript", "python"),
     r"(?:^|\s)(?!await\s)(\w+)\s*\(\s*\)(?:\s*;)?\s*(?:\/\/.*)?$", False, ("(",),
     "Possibly missing await on async function call",
     "If the callee is asynchronous, its result is not waited for.",
     "Put await before the call where it is asynchronous."),
    ("R06", "ResourceLeak", "High", 0.5, None,
     r"(?:fs\.open|fopen|open)\s*\((?:(?!\.close|with\s|using\s|try\s).)*$", False, ("open",),
     "File handle opened without visible close",
     "Nothing on the line closes the handle again.",
     "Open it in a with/using/try block that closes it."),
    ("R07", "MemoryLeak", "High", 0.5, ("c", "cpp"),
     r"\b(?:malloc|calloc|realloc|new\s+\w+\[)\s*\(", False, ("alloc", "new"),
     "Dynamic memory allocation — verify corresponding free/delete",
     "Memory taken by hand must be given back by hand.",
     "Release it on every way out, or let an owner object do so."),
    ("R08", "NullReference", "Medium", 0.3, ("java", "csharp", "kotlin"),
     r"(\w+)\.(\w+)\s*\((?:(?!\bnull\b|\bif\b).)*$", False, (".",),
     "Method call on potentially null object",
     "The receiver may be null at this point.",
     "Check it, or use the null-safe call."),
    ("R09", "ResourceLeak", "Medium", 0.4, ("go",),
     r"go\s+func\s*\(|go\s+\w+\s*\(", False, ("go",),
     "Goroutine launched — verify it terminates properly",
     "A goroutine that never ends keeps its memory.",
     "Give it a context or a done channel."),
    ("R10", "RuntimeRisk", "High", 0.8, ("rust",),
     r"\.unwrap\s*\(\s*\)", False, (".unwrap",),
     "Unsafe .unwrap() call — will panic on None/Err",
     "An empty or failed value ends the program here.",
     "Match on the value, or return the error with ?."),
    ("R11", "RuntimeRisk", "Low", 0.2, ("python",),
     r"\[\s*-?\d+\s*\]", False, ("[",),
     "Hard-coded index access — verify bounds",
     "The collection may hold fewer elements.",
     "Check its length, or fall back to a default."),
    ("R12", "RuntimeRisk", "Medium", 0.4, ("typescript",),
     r"\bas\s+\w+(?!\s*\|)", False, ("as",),
     "Type assertion without runtime validation",
     "The assertion vanishes at run time and checks nothing.",
     "Check the value with a type guard."),
    ("R13", "RaceCondition", "High", 0.3, ("go",),
     r"(?:^|\s)(\w+)\[", False, ("[",),
     "Map access without sync — potential data race in concurrent context",
     "Go maps do not allow a write next to other accesses.",
     "Hold a mutex, or use sync.Map."),
])

DEFAULT_USER_RULES = [
    {"id": "no-console-log", "pattern": r"\bconsole\.log\s*\(", "severity": "Low",
     "message": "console.log statement found — remove before production",
     "explanation": "Debug output should not ship.",
     "suggestedFix": "Drop the call, or log through a library.", "languages": ["javascript", "typescript"]},
    {"id": "no-debugger", "pattern": r"\bdebugger\b", "severity": "High",
     "message": "debugger statement found",
     "explanation": "Browsers stop at this statement.",
     "suggestedFix": "Delete the statement.", "languages": ["javascript", "typescript"]},
    {"id": "no-alert", "pattern": r"\balert\s*\(", "severity": "Medium",
     "message": "alert() call found",
     "explanation": "The page freezes until the box is closed.",
     "suggestedFix": "Show a message inside the page.", "languages": ["javascript", "typescript"]},
    {"id": "no-fixme", "pattern": r"(?:\/\/|#)\s*FIXME\b", "severity": "Medium",
     "message": "FIXME comment found — requires attention",
     "languages": ["javascript", "typescript", "python", "java", "go", "rust", "ruby", "php"]},
]
DEFAULT_USER_FIX = "Review and fix this code according to project rules."

# Structural single-line rules, in reporting order.
STYLE_RULES = [
    Rule("A01", STRUCTURE, 2, "ast/strict-equality", "LogicalBug", "Medium", 0.75, JS_TS,
         r"[^!=<>]==[^=]", "Loose equality (==) used instead of strict equality (===)",
         "== converts its operands before it compares them.", "Compare with ===.",
         needs=("==",), unless=r"==="),
    Rule("A02", STRUCTURE, 2, "ast/no-var", "BadPractice", "Low", 0.85, JS_TS,
         r"^\s*var\s+", '"var" used instead of "let" or "const"',
         "var is visible in the whole function and is hoisted.",
         "Declare it with const, or with let if it changes.", needs=("var",)),
    Rule("A03", STRUCTURE, 2, "ast/no-wildcard-import", "BadPractice", "Medium", 0.9, ("python",),
         r"^\s*from\s+\w+\s+import\s+\*", "Wildcard import (import *) used",
         "Nobody can tell which names the module brings in.", "Import the names that are used.",
         needs=("import",)),
    Rule("A04", STRUCTURE, 2, "ast/mutable-default", "LogicalBug", "High", 0.85, ("python",),
         r"def\s+\w+\s*\([^)]*(?:\[\]|\{\}|dict\(\)|list\(\)|set\(\))\s*[,)]",
         "Mutable default argument in function definition",
         "All calls share the one default object.", "Default to None and create the object inside.",
         needs=("def",)),
    Rule("A05", STRUCTURE, 2, "ast/bare-except", "PoorErrorHandling", "Medium", 0.9, ("python",),
         r"^\s*except\s*:", "Bare except clause — catches all exceptions including KeyboardInterrupt",
         "Even an interrupt from the keyboard is swallowed.", "Name the exceptions to catch.",
         needs=("except",)),
    Rule("A06", STRUCTURE, 2, "ast/unchecked-error", "PoorErrorHandling", "High", 0.7, ("go",),
         r"\w+,\s*_\s*:?=\s*\w+", "Error return value discarded with blank identifier",
         "The failure leaves no trace.", "Keep the error and act on it.",
         needs=("_",), comment_mode="slashes"),
    Rule("A07", STRUCTURE, 2, "ast/magic-number", "BadPractice", "Low", 0.4, None,
         r"(?:if|while|for|return|case)\s*[\s(].*\b(\d{2,})\b",
         "Magic number {0} found — consider using a named constant",
         "The bare number does not say what it means.", "Give {0} a name.",
         families=("c-style", "scripting")),
]
SKIP["slashes"] = ("//",)
MAGIC_ALLOWED = ["100", "200", "300", "400", "404", "500", "1000", "1024"]

TODO_PATTERN = r"(?:\/\/|#|\/\*|\*)\s*(TODO|FIXME|HACK|BUG|XXX)\b[:\s]*(.*)"
TODO_TAGS = ("todo", "fixme", "hack", "bug", "xxx")     # lower-case
SINGLE_LETTER_PYTHON = r"^\s*([a-zA-Z])\s*="
SINGLE_LETTER_C = r"(?:const|let|var|int|long|float|double|string|auto)\s+([a-zA-Z])\s*[=;]"
SINGLE_LETTER_ALLOWED = ["i", "j", "k", "x", "y", "z", "_", "e"]

# Findings whose condition needs more than one line, or values in the message.
STRUCTURAL_RULES = [
    Rule("A10", STRUCTURE, 0, "ast/unused-variable", "UnusedVariable", "Low", 0.6, None, None,
         'Variable "{0}" is declared but appears to be unused',
         "The name occurs nowhere else in the file.", 'Delete "{0}", or start its name with an underscore.'),
    Rule("A11", STRUCTURE, 1, "ast/unreachable-code", "UnreachableCode", "Medium", 0.7, None, None,
         "Unreachable code after return/break/throw statement",
         "Line {0} follows the exit at line {1} and is never run.", "Remove the line, or change the flow before it."),
    Rule("A12", STRUCTURE, 1, "ast/todo-comment", "DeadCode", "Low", 0.9, None, None,
         "{0} comment found: {1}",
         "The comment marks work that is not finished.", "Finish it, or track it as an issue."),
    Rule("A13", STRUCTURE, 3, "ast/empty-catch", "PoorErrorHandling", "Medium", 0.9, None, None,
         "Empty catch/except block — errors are silently swallowed",
         "The error disappears without a trace.", "Log it, pass it on, or deal with it."),
    Rule("A14", STRUCTURE, 4, "ast/forbidden-function", "BadPractice", "High", 0.95, None, None,
         'Forbidden function "{0}" used',
         'The settings do not allow "{0}".', 'Use something safer than "{0}".'),
    Rule("A15", STRUCTURE, 5, "ast/naming-single-letter", "InconsistentNaming", "Low", 0.5, None, None,
         'Single-letter variable name "{0}" — use a descriptive name',
         "One letter does not tell a reader what the value is.", "Choose a name that says what it holds."),
    Rule("C01", COMPLEXITY, 0, "complexity/function-length", "HighComplexity", "Medium", 0.9, None, None,
         'Function "{0}" is {1} lines long (max: {2})',
         "Long functions are hard to follow and to test; the limit is {2} lines.", "Move parts into functions of their own."),
    Rule("C01H", COMPLEXITY, 0, "complexity/function-length", "HighComplexity", "High", 0.9, None, None,
         'Function "{0}" is {1} lines long (max: {2})',
         "Long functions are hard to follow and to test; the limit is {2} lines.", "Move parts into functions of their own."),
    Rule("C02", COMPLEXITY, 0, "complexity/cyclomatic", "HighComplexity", "Medium", 0.85, None, None,
         'Function "{0}" has cyclomatic complexity {1} (max: {2})',
         "Every decision doubles the ways through the code.", "Flatten the conditions, or split the function."),
    Rule("C02H", COMPLEXITY, 0, "complexity/cyclomatic", "HighComplexity", "High", 0.85, None, None,
         'Function "{0}" has cyclomatic complexity {1} (max: {2})',
         "Every decision doubles the ways through the code.", "Flatten the conditions, or split the function."),
    Rule("P20", PERFORMANCE, 1, "performance/nested-loops", "PerformanceBottleneck", "High", 0.8, None, None,
         "Deeply nested loop detected (3+ levels)",
         "The loop at line {0} is at least the third level inside the loop at line {1}.",
         "Flatten the loops, or replace one by a lookup."),
    Rule("R20", RUNTIME, 1, "runtime/event-listener-leak", "MemoryLeak", "Medium", 0.5, None, None,
         "Event listener '{0}' added but never removed",
         "The listener keeps what it refers to alive.", "Remove it when its owner goes away."),
    Rule("X01", CONTEXT, 0, "ai/json-parse-no-try", "PoorErrorHandling", "Medium", 0.75, JS_TS, None,
         "JSON.parse() without try-catch — will throw on invalid JSON",
         "Bad input raises an error nobody catches.", "Parse inside try/catch."),
    Rule("X02", CONTEXT, 1, "ai/parseint-radix", "MissingEdgeCase", "Low", 0.8, JS_TS,
         r"parseInt\s*\(\s*\w+\s*\)", "parseInt() called without radix parameter",
         "Without a radix, leading characters decide the base.", "Pass 10 as the second argument.",
         needs=("parseInt",), unless=r"parseInt\s*\(\s*\w+\s*,"),
    Rule("X03", CONTEXT, 2, "ai/async-no-error-handling", "PoorErrorHandling", "Medium", 0.65, JS_TS, None,
         'Async function "{0}" uses await but has no error handling',
         "A rejected promise leaves the function unhandled.", "Await inside try/catch."),
    Rule("X04", CONTEXT, 3, "ai/code-duplication", "BadPractice", "Low", 0.65, None, None,
         "Duplicate code block (structurally similar to line {0})",
         "The same block stands twice, so each change must be made twice.", "Share the block as one function."),
    Rule("X05", CONTEXT, 4, "ai/switch-no-default", "MissingEdgeCase", "Medium", 0.7, None, None,
         "Switch statement without default case",
         "Values without a case pass in silence.", "Add a default branch."),
    Rule("X06", CONTEXT, 4, "ai/destructure-no-check", "MissingEdgeCase", "Low", 0.4, JS_TS, None,
         "Array destructuring without length validation",
         "Missing elements come out as undefined.", "Check the length, or set defaults."),
    Rule("X07", CONTEXT, 5, "ai/sequential-awaits", "PerformanceBottleneck", "Medium", 0.5, JS_TS, None,
         "Sequential awaits that may be parallelizable",
         "The second wait starts only after the first has ended.", "Start both and await them with Promise.all."),
    Rule("X08", CONTEXT, 6, "ai/goroutine-shared-state", "ConcurrencyProblem", "Medium", 0.4, ("go",),
         r"\bgo\s+(?:func|(\w+))\s*\(", "Goroutine launched — verify no shared state mutation",
         "Variables shared between goroutines need protection.", "Use channels or a mutex.", needs=("go",)),
    Rule("X09", CONTEXT, 7, "ai/interval-leak", "ResourceLeak", "Medium", 0.6, JS_TS, None,
         "setInterval() without corresponding clearInterval()",
         "The timer runs until the page ends.", "Keep its id and clear it."),
    Rule("X10", CONTEXT, 8, "ai/timeout-in-loop", "PerformanceBottleneck", "Medium", 0.5, JS_TS, None,
         "setTimeout() inside a loop — may create many pending timers",
         "Each round leaves a timer waiting.", "Space the work out with a queue."),
    Rule("X11", CONTEXT, 9, "ai/file-no-with", "ResourceLeak", "High", 0.8, ("python",),
         r"^\s*\w+\s*=\s*open\s*\(", 'File opened without "with" statement — may not be closed properly',
         "An exception leaves the file open.", "Open it in a with block.", needs=("open",)),
]

BY_UID = {r.uid: r for r in SECURITY_RULES + PERFORMANCE_RULES + RUNTIME_RULES + STYLE_RULES + STRUCTURAL_RULES}

# Declarations whose names are checked for use (whole text, one group holds the name).
DECLARATIONS = {
    "javascript": r"(?:const|let|var)\s+(\w+)\s*=",
    "typescript": r"(?:const|let|var)\s+(\w+)\s*(?::\s*\S+\s*)?=",
    "python": r"(?m)^(\w+)\s*=(?!=)",
    "go": r"(?:var\s+(\w+)|(\w+)\s*:=)",
    "rust": r"let\s+(?:mut\s+)?(\w+)\s*(?::\s*\S+\s*)?=",
    "java": r"(?:int|long|float|double|String|boolean|char|byte|short|var|final)\s+(\w+)\s*[=;]",
    "csharp": r"(?:int|long|float|double|string|bool|char|var|readonly)\s+(\w+)\s*[=;]",
    "php": r"\$(\w+)\s*=",
    "ruby": r"(\w+)\s*=(?!=)",
}

# Function starts: the first pattern that matches names the function (groups 1, 2, 3).
FUNCTION_STARTS = {
    "javascript": [
        r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?|(\w+)\s*\(.*\)\s*\{)",
        r"(?:(\w+)\s*:\s*(?:async\s*)?function|\b(\w+)\s*=\s*(?:async\s*)?\()",
    ],
    "typescript": [
        r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?|(\w+)\s*\(.*\)\s*(?::\s*\w+\s*)?\{)",
        r"(?:(?:public|private|protected|static|async)\s+)?(\w+)\s*\(.*\)\s*(?::\s*\S+\s*)?\{",
    ],
    "python": [r"^\s*(?:async\s+)?def\s+(\w+)\s*\("],
    "java": [r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+(?:,\s*\w+)*)?\s*\{"],
    "csharp": [r"(?:public|private|protected|internal|static|async|virtual|override|\s)+[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*\{"],
    "go": [r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\("],
    "rust": [r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[<(]"],
    "php": [r"(?:public|private|protected|static|\s)*function\s+(\w+)\s*\("],
    "ruby": [r"^\s*def\s+(\w+)"],
    "swift": [r"(?:public|private|internal|open|static|\s)*func\s+(\w+)"],
    "kotlin": [r"(?:public|private|protected|internal|override|suspend|\s)*fun\s+(\w+)"],
    "dart": [r"(?:static\s+)?[\w<>]+\s+(\w+)\s*\([^)]*\)\s*(?:async\s*)?\{"],
    "c": [r"^[\w\s\*]+\s+(\w+)\s*\([^)]*\)\s*\{"],
    "cpp": [r"^[\w\s\*:&<>]+\s+(\w+)\s*\([^)]*\)\s*(?:const)?\s*\{"],
    "powershell": [r"(?i)function\s+(\w[\w-]*)\s*(?:\([^)]*\))?\s*\{"],
    "shellscript": [r"(?:function\s+)?(\w+)\s*\(\)\s*\{"],
}

# Decision words: (whole words, operators that count only between word characters).
DECISIONS = {
    "default": (r"if|else\s+if|elif|elsif|while|for|foreach|case|catch|except|switch", r"&&|\|\||\?"),
    "python": (r"if|elif|while|for|except|and|or|assert", None),
    "ruby": (r"if|elsif|unless|while|until|for|when|rescue|and|or", None),
    "go": (r"if|else\s+if|for|switch|case|select", r"\|\||&&"),
}

# Words that keep their spelling when a line is reduced to its structure.
STRUCTURE_WORDS = (
    "if else for while do switch case default break continue return function class const let var import export "
    "from async await try catch finally throw new typeof instanceof void delete in of true false null undefined "
    "this super yield static get set public private protected readonly interface type enum extends implements "
    "abstract declare namespace def elif except pass raise with as lambda global nonlocal assert None True False "
    "self print struct impl fn pub mod use crate match loop mut ref move trait where dyn unsafe extern"
).split()
