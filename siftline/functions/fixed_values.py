"""Word lists, patterns and limits that results depend on. They are interface, not logic."""

# --- Fixed values: limits ---------------------------------------------------------------------------------------------
PAGE_DEFAULT, PAGE_MAX = 30, 50
MATCH_CAP = 20_000
FILE_BYTES = 2 * 1024 * 1024
READ_BYTES = 4 * 1024 * 1024
PROBE_BYTES = 8192
TREE_DEPTH = 25
ROW_CHARS = 500
CONTEXT_MAX = 5
HALF_LIFE_MS = 7 * 24 * 3600 * 1000
CAPSULE_MENTIONS, CAPSULE_CANDIDATES, DOC_LINES = 30, 60, 6
CANDIDATES, NAME_BATCH, READ_FILES, WINDOWS, WINDOW_BYTES = 128, 64, 20, 24, 8192
SKETCH_BYTES, FULL_LIMIT, CUTOFF, THRESHOLD = 384, 40, 0.45, 0.2
SKETCH_CARDS, PASSAGES_A_REQUEST, FAILURES_KEPT = 46, 3, 5
SKETCH_OVERHEAD, SKETCH_LEAST, SKETCH_MOST = 12, 24, 180
IDF_LEAST, IDF_MOST = 0.5, 6.0
MAP_CHARS, MAX_CHARS, SUMMARY_TOP = 8000, 1_000_000, 10
METAVARIABLES = 9
#: Turns of a repeated group that Java's engine may take on its stack; seconds that the other matcher may take for one text.
GROUP_TURNS, MATCH_SECONDS = 64, 3.0

# --- Fixed values: words of queries that carry no meaning ----------------------------------------------------------------
STOPWORDS = frozenset(
    """the a an or and to is are be when where how that this of in on at for with by its it as from into like gets get up
    which what does do code file files over all user using then than there their they them you your we our has have had was
    were been being will would should can could not but if so such via per any some each every also just only more most
    other out off about after before between through during without within one two new used use make makes made run runs
    way thing things something actually really still yet""".split()
)
SUFFIXES = ("ing", "ed", "es", "s")

# --- Fixed values: files that searches by meaning leave out ----------------------------------------------------------------
DENIED_DIRS = tuple(
    """.git node_modules target dist build out .next .nuxt .turbo .cache __pycache__ .venv venv .tox coverage .idea .vscode
    .gradle .mypy_cache .pytest_cache .ruff_cache .parcel-cache""".split()
)
DENIED_FILES = tuple(
    """Cargo.lock package-lock.json yarn.lock pnpm-lock.yaml bun.lock bun.lockb poetry.lock Pipfile.lock composer.lock
    Gemfile.lock go.sum flake.lock .DS_Store Thumbs.db""".split()
)
SECRET_FILES = tuple(
    """.env .envrc .netrc .npmrc .pypirc .pgpass .boto .s3cfg .dockercfg .git-credentials .htpasswd htpasswd credentials
    credentials.json client_secret.json service-account.json id_rsa id_dsa id_ecdsa id_ed25519""".split()
)
ENV_TEMPLATES = (".env.example", ".env.sample", ".env.template", ".env.dist")
SECRET_EXTENSIONS = tuple(
    """pem key p12 pfx jks keystore bks ppk kdbx gpg pgp asc der crt cer tfvars tfvars.json tfstate tfstate.backup""".split()
)
BINARY_EXTENSIONS = tuple(
    """png jpg jpeg gif webp avif ico bmp tiff psd svg woff woff2 ttf otf eot zip gz tgz tar bz2 xz zst 7z rar pdf mp3 mp4
    mov avi mkv wav ogg flac wasm so dylib dll exe o a class jar pyc pyo bin dat db sqlite sqlite3 lock map min.js min.css
    snap pb onnx safetensors parquet arrow ipynb""".split()
)

# --- Fixed values: source file extensions, for definitions -----------------------------------------------------------------
CODE_EXTENSIONS = tuple(
    """ts tsx mts cts js jsx mjs cjs py go rs java cs c h cc cpp cxx hpp rb php swift kt kts scala lua sh bash zsh pl ex exs
    erl hs ml fs clj dart vue svelte""".split()
)
EXTENSION_FAMILY = {
    "script": ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"),
    "python": ("py",),
    "go": ("go",),
    "rust": ("rs",),
    "java": ("java", "cs"),
    "c": ("c", "h", "cc", "cpp", "cxx", "hpp"),
    "markdown": ("md",),
}

# --- Fixed values: shapes of symbol lines: (expression, kind or the group that names it, group of the name, members only, by shape)
_ID, _WORD = r"[A-Za-z_$][\w$]*", r"[A-Za-z_]\w*"
_GENERIC = (
    (rf"^(?:(?:public|private|protected|internal|sealed|open|data|abstract|final|static|export|async)\s++)*+(class|function|def|fn|func|interface|enum|struct|type)\s+({_WORD})", 1, 2, False, False),
)
SYMBOL_SHAPES = {
    "script": (
        (rf"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})", "class", 1, False, False),
        (rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})", "function", 1, False, False),
        (rf"^(?:export\s+)?interface\s+({_ID})", "interface", 1, False, False),
        (rf"^(?:export\s+)?(?:const\s+)?enum\s+({_ID})", "enum", 1, False, False),
        (rf"^(?:export\s+)?type\s+({_ID})", "type", 1, False, False),
        (rf"^(?:export\s+)?const\s+({_ID})\s*=.*=>", "const", 1, False, False),
        (rf"^(?:(?:public|private|protected|static|async|abstract|override|readonly)\s++(?!\()|\*\s*+)*+(?:get\s+|set\s+)?({_ID})\s*\([^;]*\)\s*(?::\s*[^{{}};]+)?\s*(?:\{{[^\n]*)?,?\s*$", "method", 1, True, True),
    ),
    "python": ((rf"^(?:async\s+)?def\s+({_WORD})", "def", 1, False, False), (rf"^class\s+({_WORD})", "class", 1, False, False)),
    "go": ((rf"^func\s+(?:\([^)]*\)\s*)?({_WORD})", "func", 1, False, False), (rf"^type\s+({_WORD})", "type", 1, False, False)),
    "rust": (
        (rf"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait|mod)\s+({_WORD})", 1, 2, False, False),
        (r"^impl\s+(?:<[^>]*>\s*)?([A-Za-z_][\w:]*)", "impl", 1, False, False),
    ),
    "java": (
        (rf"^(?:(?:public|private|protected|static|final|abstract|sealed|partial|internal|synchronized)\s++)*+(class|interface|enum|record|struct)\s+({_WORD})", 1, 2, False, False),
        (rf"^(?:(?:public|private|protected)\s++(?!\())*+({_WORD})\s*\([^;]*\)\s*(?:throws\s+[\w,\s.]+)?\s*(?:\{{[^\n]*)?,?\s*$", "ctor", 1, True, True),
        (rf"^(?:(?:public|private|protected|static|final|async|override|virtual|synchronized)\s++(?!(?:\w+\s*)?\())*+[\w<>.\[\],? ]+\s+({_WORD})\s*\([^;]*\)\s*(?:throws\s+[\w,\s.]+)?\s*(?:\{{[^\n]*)?,?\s*$", "method", 1, True, True),
    ),
    "c": (
        (rf"^(?:template\s*<[^>]*>\s*)?(class|struct|enum(?:\s+class)?)\s+({_WORD})", 1, 2, False, False),
        (r"^(?:[A-Za-z_][\w:<>*&]*\s+)?([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{?\s*$", "function", 1, False, True),
    ),
    "markdown": ((rf"^#{{1,6}}\s+({_WORD})", "heading", 1, False, False), (rf"^(?:[-*]|\d+\.)\s+({_WORD})", "list", 1, False, True), *_GENERIC),
    "other": _GENERIC,
}
NOT_A_METHOD = ("if", "for", "while", "switch", "catch", "return", "new", "super", "this", "typeof", "sizeof", "assert", "print", "println")
GENERATOR_LINE = r"^\*\s*[A-Za-z_$][\w$]*\s*\("
COMMENT_LINE = r"^(?://|#|/\*|\*|<!--|--)"
DOC_LINE = r"^(?://|#|\*|/\*|--|\"\"\"|'''|;)"

# --- Fixed values: what shows that a literal was meant as an expression ---------------------------------------------------------
REGEX_SYNTAX = r"\\[.^$*+?(){}\[\]\/wWsSdDbB]|(?<![|\s])\|(?![|\s])|\.\*|\.\+|\(\?|\{\d+,?\d*\}"
QUESTION_WORDS = 3

# --- Fixed values: import statements, definitions, calls -------------------------------------------------------------------------
IMPORT_SPECS = (
    r"(?:import|from)\s+['\"]([^'\"]+)['\"]",
    r"require\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"from\s+(\S+)\s+import\s",
    r"import\s+([\w.]+)",
    r"#include\s+[<\"]([^>\"]+)[\">]",
    r"\buse\s+([\w:]+)",
)
IMPORT_WORDS = r"(?:import|from|require|use|include)\b"
DEFINING = r"^\s*+(?:export\s++|default\s++|async\s++|public\s++|private\s++|protected\s++|static\s++|pub\s++)*+(?:function|def|fn|func|class)\b"
DEFINING_SHAPE = r"^\s*+(?:(?:public|private|protected|static|async|abstract|override|readonly|get|set)\s++(?!\())*+"
DEFINITION_HEAD = r"^\s*+(?:export\s++|default\s++|async\s++|public\s++|private\s++|protected\s++|static\s++|pub\s++|abstract\s++|final\s++|sealed\s++)*+(?:function|def|fn|func|class|struct|enum|interface|trait|type|const|let|var)\s+"
MENTION_OF_DEFINITION = r"(?:function|class|const|let|var|def|fn|func|interface|type|struct|enum|impl)\b[^\n]*"
CALL_DEFINITION_SHAPE = r"^\s*+(?:(?:public|private|protected|static|async|abstract|override|readonly|final|sealed|get|set)\s++(?!\())*+"
CALLED_NAME = r"\b([A-Za-z_$][\w$]*)\s*\("
CALL_DEFINITION_BODY = r"[A-Za-z_$][\w$]*\s*\([^;]*\)\s*[:{]"
CONSTRUCTOR_LINE = r"^\s*+(?:(?:public|private|protected)\s++)*+constructor\s*\("
CONSTRUCTOR_BODY = r"\bconstructor\s*\([^)]*\)\s*\{"
KINDS = {
    "call": r"\b[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+\s*+\(",
    "function": r"^\s*+(?:export\s++|default\s++|async\s++|public\s++|private\s++|protected\s++|static\s++|pub\s++)*+(?:function|def|fn|func)\b",
    "class": r"^\s*+(?:export\s++|default\s++|abstract\s++|public\s++|private\s++|protected\s++|final\s++|sealed\s++|static\s++)*+(?:class|struct|enum|interface|trait)\b",
    "import": r"^\s*(?:import|from|require|use|include)\b",
    "return": r"^\s*return\b",
}
ATOM = r"""((?:"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`|[A-Za-z_$][\w$]*))"""
MULTI = r"(.*?)"
LANGUAGES = {
    "ts": ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "typescript", "javascript"),
    "py": ("py", "python"),
    "go": ("go", "golang"),
    "rust": ("rs", "rust"),
    "java": ("java",),
    "cs": ("cs", "csharp", "c#"),
    "cpp": ("c", "h", "cc", "cpp", "cxx", "hpp", "c++"),
}
