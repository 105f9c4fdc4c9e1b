"""Which files are left out of an index, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symbolith.functions.text import basename, extension, glob_to_regex, language

#: Entries that are never walked into, and file names that are left out.
SKIPPED_ENTRIES = (
    "node_modules vendor .git dist build __pycache__ .cache .tox .mypy_cache .pytest_cache .ruff_cache target out .gradle .idea .vscode .DS_Store coverage .nyc_output .next .nuxt venv .venv env .env eggs *.egg-info"
).split()
SKIPPED_FILES = "*.min.js *.min.css package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock poetry.lock Pipfile.lock *.lock *.snap".split()
PRIORITY_FOLDERS = "src lib pkg cmd app core api internal".split()
#: Names of files that hold secrets.
SECRET_FILES = (
    ".env .env.* *.pem *.key *.p12 *.pfx *.rsa *.ecdsa *.ed25519 *.ppk *.der .npmrc .pypirc .netrc .htpasswd credentials secrets.json service-account.json id_rsa id_ed25519 id_ecdsa id_dsa"
).split()
#: Extensions of binary files.
BINARY_EXTENSIONS = (
    "exe dll so dylib a lib obj o class jar war ear zip tar gz bz2 xz 7z rar png jpg jpeg gif bmp ico webp svg mp3 mp4 wav avi mov mkv flac pdf doc docx xls xlsx ppt pptx "
    "pyc pyo pyd wasm bin dat ttf otf woff woff2 eot sqlite db mdb sqlite3 iso img dmg vmdk"
).split()
MAX_FILES, MAX_FILE_BYTES = 500, 512_000
SKIP_REASONS = ("no_language", "excluded", "gitignore", "skip_pattern")


def any_glob(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{glob_to_regex(p, True)})" for p in patterns))


def skipped_entry(path: Column) -> Column:
    """Whether a part of the path is on the list, or hidden (``.github`` aside)."""
    return F.exists(F.split(path, "/"), lambda part: part.isin(*SKIPPED_ENTRIES) | (part.startswith(".") & (part != ".github")))


def secret_file(path: Column) -> Column:
    return any_glob(basename(path), SECRET_FILES) | any_glob(path, SECRET_FILES)


def binary_extension(path: Column) -> Column:
    return F.substring(extension(path), 2, 100).isin(*BINARY_EXTENSIONS)


def binary_content(content: Column) -> Column:
    """A NUL byte among the first 8192."""
    return F.coalesce(F.contains(F.substring(content, 1, 8192), F.lit(b"\x00")), F.lit(False))


def outside_root(path: Column) -> Column:
    """Whether a relative path leaves its root."""
    return F.trim(path).rlike(r"^([/\\]|[A-Za-z]:)") | F.exists(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda part: part == "..")


def exclude_reason(path: Column, symlink: Column, size: Column, content: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The first reason that applies, or null."""
    return (
        F.when(outside_root(path), "path_traversal")
        .when(F.coalesce(symlink, F.lit(False)), "symlink_escape")
        .when(size > max_bytes, "file_too_large")
        .when(content.isNull(), "unreadable")
        .when(secret_file(path), "secret_file")
        .when(binary_extension(path), "binary_extension")
    )


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore-file patterns, the last match deciding, leave the path out."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        folder, rooted = line.endswith("/"), "/" in line.rstrip("/")
        body = line.strip("/").replace("**/", "\x01").replace("**", "\x02")
        regex = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "(?:.*/)?" if c == "\x01" else ".*" if c == "\x02" else "\\" + c if not (c.isalnum() or c in "/_") else c for c in body)
        regex = ("^" if rooted else "(?:^|/)") + regex + ("/" if folder else "(?:/|$)")
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def skip_reason(path: Column, symlink: Column, size: Column, content: Column, patterns: list[str], max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Why discovery passes a file over, the first test that fails deciding; null if it doesn't."""
    return (
        F.when(skipped_entry(path), "skip_pattern")
        .when(ignored(path, patterns), "gitignore")
        .when(any_glob(basename(path), SKIPPED_FILES), "skip_pattern")
        .when(language(path).isNull(), "no_language")
        .when(exclude_reason(path, symlink, size, content, max_bytes).isNotNull(), "excluded")
    )


def priority(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1)).isin(*PRIORITY_FOLDERS) & F.contains(path, F.lit("/"))
