"""Path predicates and classifiers as Column expressions; patterns are compiled on the driver."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of files by extension.
KINDS = {
    "text": "txt log csv tsv ini cfg conf config properties yaml yml toml json json5 jsonl ndjson xml xsl xslt xsd html htm xhtml css scss sass less styl svg rtf rst adoc asciidoc textile org wiki latex avsc doc docx odt tex bib env sh bash zsh diff patch plist xlsx xls pptx ppt numbers pages key lock bat cmd",
    "code": "c h cpp cxx cc hpp hxx hh ipp inl cjs vue svelte csx fsx fsi vb kts sc cljs cljc edn d v pyw rbw t phps tcl rmd hrl lhs mli sml scm rkt cl gql erb hbs handlebars mustache jinja jinja2 ejs liquid m mm swift rs go py pyi js jsx mjs ts tsx java kt scala groovy gradle cs fs rb php pl pm lua r jl hs ex exs erl clj ml dart zig nim asm s sql graphql proto thrift glsl tf nix el lisp f90 pas vhd",
    "markdown": "md mdx markdown mdown mkd mkdn",
    "pdf": "pdf",
    "image": "png jpg jpeg webp bmp tiff tif gif heif heic ico icns psd ai eps raw",
    "archive": "zip tar gz bz2 xz zst rar 7z dmg iso img cab msi deb rpm pkg jar war whl apk",
    "binary": "exe dll so dylib a lib o obj class pyc pyo wasm bin dat db sqlite sqlite3",
}
# Paths that are never indexed, by glob; sensitive places; marks of cloud folders and of their artifacts.
EXCLUDED = (
    ".git/objects/**", ".git/hooks/**", ".git/refs/**", ".git/logs/**", ".git/info/**", ".git/packed-refs", ".git/COMMIT_EDITMSG", ".git/MERGE_MSG", ".git/index",
    "node_modules/**", ".yarn/cache/**", ".next/**", ".nuxt/**", "bower_components/**", "dist/**", "build/**", "DerivedData/**", "cmake-build-*/**",
    "__pycache__/**", ".tox/**", "*.pyc", "*.pyo", ".eggs/**", "*.egg-info/**", ".cargo/**", "target/release/**", "target/debug/**", "venv/**", ".venv/**", "vendor/**",
    "Library/Caches/**", "Library/Containers/**", "Library/Group Containers/**", "Library/Developer/**", "Library/Logs/**", "Library/Mail/**", "Library/Messages/**",
    "Library/Saved Application State/**", "Library/Application Support/AddressBook/**", "Library/Application Support/CallHistoryDB/**",
    "Library/Application Support/MobileSync/**", "Library/Application Support/com.apple.*/**", ".DS_Store", ".localized", "._*", ".TemporaryItems/**", ".Trashes/**", ".fseventsd/**", ".Spotlight-V100/**", "Thumbs.db",
    ".dropbox.cache/**", ".dropbox/", "Icon\r", ".gdoc.tmp", ".gsheet.tmp", ".idea/**", ".vscode/**", "*.swp", "*.swo", "*~",
)
SENSITIVE = (".ssh/", ".gnupg/", ".gpg/", ".aws/", "Library/Preferences/", "Library/Keychains/")
CLOUD_FOLDERS = ("Dropbox/", "Google Drive/", "GoogleDrive/", "My Drive/", "OneDrive/", "OneDrive -", "iCloud Drive/", "Mobile Documents/")
CLOUD_PARTS = (".dropbox.cache/", ".~google-drive-root", "OneDrive_folder_placeholder.ini", ".icloud_folder_attributes.plist")
CLOUD_NAMES = (".dropbox", ".dropbox-dist", ".gdoc.tmp", ".gsheet.tmp")
MOST_BYTES = 5 << 30


def glob_regex(pattern: str) -> str:
    """A regular expression (same in Java and Python) for a glob: `*` and `?` stop at '/', `**` doesn't.

    Without a slash the pattern may match any component; with one it may match the path or
    whatever follows a '/'. A slash at the end is dropped.
    """
    pattern = pattern.rstrip("/")
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.sub(r"([^\w/ ])", r"\\\1", x)) for x in parts)
    return f"(?s)(?:^|/){body}(?:/|$)" if "/" not in pattern else f"(?s)(?:^|/){body}$"


def matches_any(path: Column, globs) -> Column:
    """One predicate for many globs."""
    globs = tuple(globs)
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def parse_ignore(text: str) -> list[str]:
    """Patterns of an ignore file in order: comments, blank lines and negations are skipped."""
    lines = (x.strip() for x in text.splitlines())
    return [x for x in lines if x and x[0] not in "#!"]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def contains_any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in parts))


def kind_of(extension: Column, executable: Column | None = None) -> Column:
    """The kind of a file by its extension without dot; an executable without a known one is binary."""
    out = F.when(F.lit(False), "")
    for kind, names in KINDS.items():
        out = out.when(F.lower(extension).isin(*names.split()), kind)
    if executable is not None:
        out = out.when(executable, "binary")
    return out.otherwise("unknown")


def is_hidden(path: Column) -> Column:
    """A folder of the path (not the last component) begins with a dot."""
    return path.rlike(r"(?:^|/)\.[^/]+/")


def is_sensitive(path: Column) -> Column:
    return contains_any(path, SENSITIVE)


def sensitivity(path: Column) -> Column:
    return F.when(is_sensitive(path), "sensitive").when(is_hidden(path), "hidden").otherwise("normal")


def is_cloud_folder(path: Column) -> Column:
    return contains_any(path, CLOUD_FOLDERS)


def is_cloud_artifact(path: Column) -> Column:
    placeholder = path.endswith(".icloud") & path.contains("Mobile Documents/")
    return contains_any(path, CLOUD_PARTS) | base_name(path).isin(*CLOUD_NAMES) | placeholder


def under(path: Column, root: str) -> Column:
    """The path is `root` or below it."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def validate(path: Column, size: Column, ignored=(), roots=()) -> Column:
    """include, exclude or metadata_only; the first rule that holds decides."""
    explicit = reduce(lambda a, b: a | b, (under(path, r) for r in roots), F.lit(False))
    return (
        F.when(matches_any(path, ignored) | matches_any(path, EXCLUDED) | is_cloud_artifact(path), "exclude")
        .when(is_sensitive(path), "metadata_only")
        .when(is_hidden(path) & ~explicit, "exclude")
        .when(size > MOST_BYTES, "exclude")
        .otherwise("include")
    )


def search_filter(extensions=(), include=(), exclude=(), after: Column | None = None, before: Column | None = None, least: int | None = None, most: int | None = None) -> Column:
    """The predicate of a search's options over (extension, path, modified_at, size); it reaches the scan."""
    rules = [F.lit(True)]
    if extensions:
        rules.append(F.lower("extension").isin(*(x.lower().lstrip(".") for x in extensions)))
    if include:
        rules.append(reduce(lambda a, b: a | b, (under(F.col("path"), p) for p in include)))
    rules.extend(~under(F.col("path"), p) for p in exclude)
    for limit, rule in ((after, lambda x: F.col("modified_at") >= x), (before, lambda x: F.col("modified_at") <= x), (least, lambda x: F.col("size") >= x), (most, lambda x: F.col("size") <= x)):
        if limit is not None:
            rules.append(rule(limit))
    return reduce(lambda a, b: a & b, rules)
