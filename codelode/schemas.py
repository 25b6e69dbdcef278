"""Tables of the engine, and the fixed values that its questions depend on.

Fact tables are partitioned by (repo_id, branch), which every key begins with.
"""

from __future__ import annotations

# --- tables -------------------------------------------------------------------------------------

REPOSITORIES = "repo_id long, uuid string, path string, name string, created_at timestamp, last_scanned timestamp, git_remote string, active_branch string"
FILES = "repo_id long, branch string, relative_path string, partition_name string, language string, line_count long, size long, last_modified timestamp, blob_hash string, chunk_count long"
BLOBS = "repo_id long, branch string, blob_hash string, content string"
NODES = (
    "repo_id long, branch string, relative_path string, node_id string, node_type string, name string, signature string, docstring string, "
    "start_line int, start_column int, end_line int, end_column int, start_char int, end_char int, parent_id string, depth int, complexity int"
)
CALLS = "repo_id long, branch string, caller string, called_name string"
EDGES = "repo_id long, branch string, caller string, callee string"
CHUNKS = (
    "repo_id long, branch string, chunk_id string, relative_path string, blob_hash string, start_char int, end_char int, start_line int, end_line int, "
    "language string, token_count int, embedding array<float>, parent_chunk_id string, ast_node_ids array<string>, importance double, metadata map<string,string>"
)
TASKS = "task_id long, repo_id long, parent_id long, name string, created_by string, status string, progress double, message string, started_at timestamp, completed_at timestamp, result string, error string, details map<string,string>"
BILLING = "model_name string, provider string, api_key_hash string, ts timestamp, prompt_tokens long, completion_tokens long, total_tokens long, cost double"
PRICES = "model_name string, provider string, input_per_million double, output_per_million double"
RATE_LIMITS = "model_name string, max_requests int, period_seconds double"
REQUESTS = "api_key string, model_name string, ts timestamp"
TEXT_BLOCKS = "page int, block_id long, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, color int, flags int"

# --- fixed values: languages --------------------------------------------------------------------

LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".sh": "bash", ".bash": "bash",
    ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".css": "css",
}
LANGUAGE_NAMES = {
    "javascript": "JavaScript", "typescript": "TypeScript", "html": "HTML", "css": "CSS", "json": "JSON", "xml": "XML",
    "markdown": "Markdown", "python": "Python", "java": "Java", "csharp": "C#", "cpp": "C++", "c": "C", "go": "Go", "rust": "Rust",
    "ruby": "Ruby", "php": "PHP", "swift": "Swift", "kotlin": "Kotlin", "scala": "Scala", "shell": "Shell", "powershell": "PowerShell",
}
IGNORED_DIRS = (".git", "__pycache__", "node_modules", "dist", "build", ".venv", "venv", ".idea", ".vscode", "target", "docs")
TEXT_SUFFIXES = (
    ".md", ".rst", ".txt", ".json", ".xml", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".log", ".csv", ".tsv", ".html", ".htm",
    ".css", ".sh", ".bat", ".ps1", ".sql", ".properties", ".tex", ".svg", ".py", ".js", ".ts", ".java", ".bash", ".markdown",
)
TEXT_NAMES = ("README", "LICENSE", "Dockerfile", ".gitignore", ".gitattributes")

# --- fixed values: kinds of syntax nodes ----------------------------------------------------------

#: Nodes that count for complexity, by language. Python's operators are left out: they say how long an expression is, not how code branches.
COMPLEXITY_TYPES = {
    "python": ("if_statement", "for_statement", "while_statement", "with_statement", "except_clause", "assert_statement", "raise_statement", "await"),
    "java": ("if_statement", "for_statement", "while_statement", "do_statement", "switch_expression", "catch_clause", "throw_statement", "assert_statement", "synchronized_statement", "conditional_expression"),
    "javascript": ("if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_statement", "catch_clause", "throw_statement", "await_expression", "ternary_expression"),
    "typescript": ("if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_statement", "catch_clause", "throw_statement", "await_expression", "ternary_expression"),
    "bash": ("if_statement", "for_statement", "while_statement", "case_statement", "pipeline"),
}
#: Nodes that become chunks of their own, by language.
CHUNK_TYPES = {
    "python": ("function_definition", "class_definition"),
    "java": ("class_declaration", "method_declaration", "constructor_declaration"),
    "javascript": ("function_declaration", "class_declaration", "method_definition", "lexical_declaration"),
    "typescript": ("function_declaration", "class_declaration", "method_definition", "lexical_declaration", "interface_declaration"),
    "bash": ("function_definition",),
}
#: Sets that single questions use. DEFINITION_TYPES is their union, and the default everywhere.
#: Methods and bound functions of JavaScript and TypeScript count as definitions that calls lead to.
EDGE_TARGET_TYPES = ("function_definition", "class_definition", "method_declaration", "function_declaration", "method_definition", "lexical_declaration")
CALL_TYPES = ("call", "call_expression", "method_invocation")
FIND_DEFINITION_TYPES = ("function_definition", "class_definition", "method_declaration", "constructor_declaration")
OUTLINE_TYPES = ("function_definition", "class_definition", "method_declaration")
DEFINITION_TYPES = ("function_definition", "class_definition", "method_declaration", "function_declaration", "constructor_declaration", "class_declaration", "interface_declaration", "method_definition", "lexical_declaration")

# --- fixed values: weights and limits -------------------------------------------------------------

IMPORTANCE = {
    "base": 0.5, "split": 0.4, "remainder": 0.2, "class": 0.2, "function": 0.1, "docstring": 0.3, "complex": 0.15, "short": -0.1, "long": 0.1,
    "complex_above": 5, "short_below": 20, "long_above": 200,
}
MAX_CHUNK_TOKENS, CHUNK_OVERLAP = 1024, 102
TARGET_FILES, LEAST_FILES, LEAST_FILES_RATIO, DEPTH_FACTOR, MOST_DEPTH = 500, 20, 0.002, 1.5, 7
OVER_TARGET_COST = 1.5
DUPLICATE_SIMILARITY, DUPLICATE_TOP_K, SEARCH_TOP_K = 0.98, 5, 5
MAX_OUTPUT_CHARS = 16_000
TRUNCATED = "\n\n... (Output truncated due to excessive length)"
TOKENS_PER_WORD = 1.3
EMBEDDING_DIM, EMBEDDING_PRICE_PER_MILLION = 1024, 0.02
NO_DATA = "// Content not available (incomplete data)"
TASK_NAMES = {"find_dead_code": "Find Unused Code", "find_duplicate_code": "Find Duplicate Code", "analyze_branch": "Analyze Branch Content"}
FONTS = (
    ("Times", "Times New Roman, serif"), ("TimesNewRoman", "Times New Roman, serif"), ("Helvetica", "Arial, sans-serif"),
    ("Arial", "Arial, sans-serif"), ("Courier", "Courier New, monospace"), ("Symbol", "Symbol, sans-serif"),
)
