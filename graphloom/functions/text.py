"""Column functions: ids, token estimates, paths, service names, redaction. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the reference's for equal results.
SECRETS = (
    r"(?i)(api[_-]?key|secret|token|password|passwd)\s*[:=]\s*\S+",
    r"(?i)authorization\s*:\s*bearer\s+\S+",
    r"(?i)bearer\s+\S+",
    r"\bsk-[A-Za-z0-9]{16,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+ PRIVATE KEY-----",
)
SKIPPED_SEGMENTS = ("src", "lib", "bin", "app", "tests", "test", "spec", "crates", "pkg", "internal", "cmd", "main", "mod", "common", "utils", "util", "core")
EXTENSIONS = {"rs": "rust", "py": "python", "pyi": "python", "go": "go", "java": "java", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
CHARS_PER_TOKEN, TOKENS_PER_ITEM, OVERHEAD_TOKENS = 4, 20, 150
CLAIM = r"<!--\s*[\w-]+:claim\s+(\w+)\s+(\S+)"


def stable_id(*parts: Column | str) -> Column:
    """First 16 bytes, as hex, of the SHA-256 of the parts, each followed by NUL."""
    nul = F.expr("decode(unhex('00'), 'UTF-8')")
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.substring(F.sha2(F.concat(*(x for c in columns for x in (c, nul))), 256), 1, 32)


def estimate_tokens(text: Column) -> Column:
    return (F.ceil(F.octet_length(text) / CHARS_PER_TOKEN) + TOKENS_PER_ITEM).cast("long")


def snippet_tokens(name: Column, path: Column, start: Column, end: Column, language: Column, content: Column) -> Column:
    return estimate_tokens(F.format_string("### %s (`%s:%s-%s`)\n\n```%s\n%s\n```\n\n", name, path, start.cast("string"), end.cast("string"), language, content))


def impact_line_tokens(name: Column, path: Column, start: Column, end: Column) -> Column:
    return estimate_tokens(F.concat(F.lit("- **"), name, F.lit("** — `"), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("`\n")))


def slugify(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", "_"))


def service_page_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("wiki_service_"), slugify(path), F.lit("_"), slugify(name))


def short_id(value: Column) -> Column:
    return F.when(F.octet_length(value) <= 12, value).otherwise(F.concat(F.substring(value, 1, 8), F.lit("…")))


def redact(text: Column) -> Column:
    return reduce(lambda t, pattern: F.regexp_replace(t, pattern, "[REDACTED]"), SECRETS, text)


def url_to_path(url: Column) -> Column:
    """Scheme and host go, query and fragment stay; without a path it is `/`."""
    rest = F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.when(~url.contains("://"), url).otherwise(F.when(rest == "", "/").otherwise(rest))


def normalize_path(path: Column) -> Column:
    trimmed = F.trim(path)
    return F.when(trimmed == "", "/").when(trimmed.startswith("/"), trimmed).otherwise(F.concat(F.lit("/"), trimmed))


def service_name(raw: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(raw), "Servicer$", ""), "Impl$", "")
    return F.when(plain.endswith("Service"), plain).otherwise(F.concat(plain, F.lit("Service")))


def parent_dir(path: Column) -> Column:
    """Null for files at the root."""
    return F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit(""))


def language_of(path: Column, extensions: dict[str, str] = EXTENSIONS) -> Column:
    """By extension; null where unknown."""
    table = F.create_map(*(F.lit(x) for pair in extensions.items() for x in pair))
    return F.try_element_at(table, F.regexp_extract(path, r"\.([^./]+)$", 1))


def in_domain(path: Column, domain: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.lower(s) == F.lower(domain))


def matches_glob(path: Column, pattern: Column) -> Column:
    prefix = F.regexp_replace(pattern, r"/\*\*$", "")
    return (
        F.when(pattern.endswith("/**"), (path == prefix) | path.startswith(F.concat(prefix, F.lit("/"))))
        .when(pattern.contains("*"), path.startswith(F.substring_index(pattern, "*", 1)))
        .otherwise((path == pattern) | path.startswith(F.concat(pattern, F.lit("/"))))
    )


def lines_of(text: Column) -> Column:
    """Lines without carriage returns; a final line break makes no empty line."""
    return F.transform(F.split(F.regexp_replace(text, "\n$", ""), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))


def claims(body: Column) -> Column:
    """array<struct<kind, target>> of the claim comments."""
    return F.arrays_zip(F.regexp_extract_all(body, F.lit(CLAIM), F.lit(1)).alias("kind"), F.regexp_extract_all(body, F.lit(CLAIM), F.lit(2)).alias("target"))
