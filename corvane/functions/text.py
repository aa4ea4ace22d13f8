"""Column expressions on text, paths and identifiers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no retrieval signal.
STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "when", "then", "into", "does", "not", "are", "was", "were", "have", "has", "should", "error", "issue", "bug", "fix", "using", "use", "return", "python",
)

# Path extension to language.
LANGUAGE_BY_EXTENSION = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sh": "shell", "bash": "shell", "md": "markdown",
    "rst": "rst", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "html": "html", "css": "css", "sql": "sql",
}

# Parts of paths, file names without extension and extensions that tell a path's category.
FIXTURE_PARTS = ("/fixtures/", "/fixture/", "/test_data/", "/testdata/", "/data/fixtures/")
TEST_PARTS = ("/tests/", "/test/", "/testing/")
DOC_PARTS = ("/docs/", "/doc/", "/documentation/", "/whatsnew/", "/changelog/", "/changes/")
DOC_EXTENSIONS = ("md", "markdown", "rst", "txt")
LOW_VALUE_NAMES = ("readme", "contributing", "changelog", "changes", "authors", "license")
LOW_VALUE_PARTS = ("/whatsnew/", "/changelog/", "/changes/")
RESOURCE_EXTENSIONS = (
    "csv", "tsv", "json", "yaml", "yml", "xml", "npy", "npz", "pkl", "pickle", "parquet", "h5", "hdf5", "mat", "dat", "bin", "geojson", "png", "jpg", "jpeg", "gif", "svg", "webp",
)

# Extensions of paths that a text may name; names that are no symbols.
MENTIONED_EXTENSIONS = ("pyi", "py", "tsx", "ts", "jsx", "js", "java", "go", "rst", "rs", "cpp", "cc", "c", "hpp", "h", "rb", "php", "cs", "scala", "kts", "kt", "toml", "yaml", "yml", "json", "ini", "cfg", "md")
SYMBOL_STOPWORDS = (
    "true", "false", "none", "null", "self", "cls", "str", "int", "float", "bool", "bytes", "list", "dict", "tuple", "set", "len", "range", "isinstance", "issubclass", "super", "print", "path", "file", "error", "exception",
    "traceback", "assertionerror", "typeerror", "valueerror", "keyerror", "indexerror", "attributeerror", "python", "pytest", "test", "tests", "github",
)
NONCODE_ENDS = ("com", "org", "net", "io", "dev", "html", "htm", "rst", "md", "txt", "sql", "py", "json", "yaml", "yml", "xml", "csv", "tsv")


def retrieval_terms(text: Column) -> Column:
    """Terms of a text, in order: camel case and underscores split, ASCII words of two characters or more that begin
    with a letter, lower case, without stopwords. Null gives an empty array."""
    split = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"), "_", " ")
    words = F.transform(F.regexp_extract_all(split, F.lit(r"([A-Za-z][A-Za-z0-9]+)")), F.lower)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def light_terms(text: Column) -> Column:
    """Distinct lower-case identifiers of three characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})")), F.lower)))


def distinct_terms(text: Column) -> Column:
    """The distinct terms of a text, in order of first use."""
    return F.array_distinct(retrieval_terms(text))


def query_terms(text: Column, limit: int = 12) -> Column:
    """The `limit` longest distinct terms, longest first, then in alphabetical order."""
    keyed = F.array_sort(F.transform(distinct_terms(text), lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w"))))
    return F.transform(F.slice(keyed, 1, limit), lambda x: x["w"])


def normal_path(path: Column) -> Column:
    """Forward slashes, no space around, no leading ./ or /; null gives an empty path."""
    return F.regexp_replace(F.translate(F.trim(F.coalesce(path, F.lit(""))), "\\", "/"), r"^(?:\./)*/*", "")


def extension(path: Column) -> Column:
    """The lower-case end of the file name after its last dot; none for a name that only begins with one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension, `text` if it is not known."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv))
    return F.coalesce(F.element_at(table, F.nullif(extension(path), F.lit(""))), F.lit("text"))


def path_category(path: Column) -> Column:
    """low_value, test, doc, resource or source, the first that holds."""
    p = F.lower(F.concat(F.lit("/"), normal_path(path)))
    name = F.element_at(F.split(p, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    among = lambda parts: F.exists(F.array(*(F.lit(x) for x in parts)), lambda x: F.contains(p, x))
    low = stem.isin(*LOW_VALUE_NAMES)
    return (
        F.when(among(FIXTURE_PARTS), "low_value")
        .when(among(TEST_PARTS) | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py"), "test")
        .when(low | among(LOW_VALUE_PARTS), "low_value")
        .when(among(DOC_PARTS) | extension(p).isin(*DOC_EXTENSIONS), "doc")
        .when(extension(p).isin(*RESOURCE_EXTENSIONS), "resource")
        .otherwise("source")
    )


_MENTION = r"(?<![A-Za-z0-9_])([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.(?:" + "|".join(MENTIONED_EXTENSIONS) + "))"


def path_mentions(text: Column) -> Column:
    """Distinct paths with a slash and a known extension that a text mentions, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_MENTION)), normal_path))


def code_spans(text: Column) -> Column:
    """Distinct names between backticks, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"`([A-Za-z_][A-Za-z0-9_.]*)(?:\(.*?\))?`"))))


def symbol_leaf(symbol: Column) -> Column:
    """What follows the last dot of a symbol, without quotes and call brackets."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(symbol, F.lit(""))), "^[`'\"]+|[`'\"]+$", ""), r"[()]+$", "")
    return F.element_at(F.split(F.trim(plain), r"\."), -1)


_NAME = r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"


def issue_symbols(text: Column, limit: int = 16) -> Column:
    """At most `limit` symbols that a text names as code: between backticks, as calls, in the frames of tracebacks, or
    after the words function, method and class; in this order, one for each last part whatever its case. Short parts,
    stopwords, upper-case words and names of sites and files are none."""
    t = F.coalesce(text, F.lit(""))
    forms = ("`+" + _NAME + "`+", r"(?<![A-Za-z0-9_])" + _NAME + r"\s*\(", r"(?m)^\s*File\s+[\"'][^\"']+[\"'],\s*line\s+\d+,\s*in\s+([A-Za-z_][A-Za-z0-9_]*)\s*$", r"(?i)\b(?:function|method|class)\s+" + _NAME)
    found = F.concat(*(F.regexp_extract_all(t, F.lit(f)) for f in forms))
    leaf = lambda v: F.element_at(F.split(v, r"\."), -1)
    loud = lambda v: (F.upper(leaf(v)) == leaf(v)) & leaf(v).rlike("[A-Z]")
    site = lambda v: (F.size(F.split(v, r"\.")) >= 2) & F.lower(leaf(v)).isin(*NONCODE_ENDS)
    web = lambda v: F.lower(v).contains("http") | F.lower(v).contains("www.")
    kept = F.filter(found, lambda v: (F.length(leaf(v)) >= 3) & ~F.lower(leaf(v)).isin(*SYMBOL_STOPWORDS) & ~loud(v) & ~site(v) & ~web(v))
    keys = F.transform(kept, lambda v: F.lower(leaf(v)))
    return F.slice(F.filter(kept, lambda v, i: F.array_position(keys, F.lower(leaf(v))) == i + 1), 1, limit)


def question(problem: Column, hints: Column) -> Column:
    """Problem statement and non-blank hints, joined by line feeds."""
    given = F.filter(F.coalesce(hints, F.array().cast("array<string>")), lambda h: F.trim(h) != "")
    return F.array_join(F.concat(F.array(F.coalesce(problem, F.lit(""))), given), "\n")


def head_tail(text: Column, limit: int, head_share: float = 0.75, marker: str = "\n...\n") -> Column:
    """A text over `limit` code points keeps its head and its tail around the marker."""
    head = int(limit * head_share)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.substring(text, -(limit - head), limit - head)))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the parts, joined by NUL; null counts as empty."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 24))


def stage_name(progress: Column) -> Column:
    return F.when(progress < 0.35, "early").when(progress < 0.70, "mid").when(progress < 0.90, "late").when(progress.isNotNull(), "near_complete")


def lines(text: Column) -> Column:
    """Lines as Python's str.splitlines cuts them."""
    cut = F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end, 1-based and closed, joined by line feeds; null where the range isn't in the text."""
    ls = F.split(text, "\n")
    return F.when((start >= 1) & (end >= start) & (end <= F.size(ls)), F.array_join(F.slice(ls, start, end - start + 1), "\n"))
