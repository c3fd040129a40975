"""Fixed values the results depend on."""

# Trust in an edge, for ranking.
CONFIDENCE_RANK = {"exact": 3, "likely": 2, "heuristic": 1}

# How far a change travels along each edge kind.
PROPAGATION = {
    "implements": 1.0,
    "tests": 0.8,
    "contains": 0.6,
    "imports": 0.5,
    "calls": 0.4,
    "references": 0.25,
}

# Discount of the propagation by confidence.
CONFIDENCE_FACTOR = {"exact": 1.0, "likely": 0.7, "heuristic": 0.4}

# Order of node kinds in ranked answers.
KIND_PRIORITY = {
    "function": 6,
    "method": 6,
    "test": 5,
    "type": 4,
    "interface": 4,
    "const": 2,
    "file": 1,
    "package": 0,
}

# Limits and budgets.
MAX_AMBIGUOUS_FANOUT = 3
MAX_FILE_BYTES = 1_500_000
PPR_RESTART = 0.15
PPR_SWEEPS = 12
PPR_EPSILON = 1e-6
RRF_K0 = 60
EVAL_KS = (5, 10, 20)
MAX_FRESH_TOKENS = 400_000
CONTEXT_CEILING_TOKENS = 250_000
MAX_GREP_RESULTS = 40
MAX_FOOTER_LINES = 12
RELATED_SHOWN = 5
MAX_GLOB_SHOWN = 100

# Directories a repository walk never enters.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "dist", "build", "out",
    "target", "vendor", "coverage", ".next", ".venv", "venv", "__pycache__",
    ".pytest_cache", ".gradle", ".idea", ".vscode",
)

# TypeScript/JavaScript extensions, in resolution order.
TS_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")

# File extension -> language.
LANG_BY_EXTENSION = {
    ".go": "go",
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
}

# Paths that hold tests, for patch filtering.
TEST_PATH_PATTERN = r"(^|/)(tests?|__tests__|testdata|spec)/|(_test\.\w+$)|(\.(test|spec)\.[cm]?[jt]sx?$)|(Test[A-Z]\w*\.java$)|(\w+Test\.java$)"

# The ranking strategies that are scored, and what each fuses.
BASE_STRATEGIES = ("graph", "graph-bfs", "dependents", "directory", "cochange", "packages")
FUSED_STRATEGIES = {
    "combined": ("graph", "packages", "cochange", "directory"),
    "lean": ("graph", "cochange"),
    "no-graph": ("packages", "cochange", "directory"),
    "no-directory": ("graph", "packages", "cochange"),
    "no-cochange": ("graph", "packages", "directory"),
    "no-packages": ("graph", "cochange", "directory"),
}
STRATEGIES = (*BASE_STRATEGIES, *FUSED_STRATEGIES)


def lookup_sql(column: str, table: dict, default: str = "NULL") -> str:
    """A CASE expression over a fixed table, kept inside whole-stage codegen."""
    def literal(value):
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return f"{value!r}e0" if isinstance(value, float) else repr(value)

    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"
