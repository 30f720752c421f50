"""Path classification: exclusion, language, role, bulk routes, tests; column expressions over repository-relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "applescript": "applescript", "awk": "awk", "bash": "bash", "bats": "bats", "css": "css", "csv": "csv", "eml": "eml", "mbox": "mbox", "htm": "html", "html": "html",
    "cjs": "javascript", "json": "json", "jsonc": "jsonc", "jsonl": "jsonl", "js": "javascript", "jsx": "javascript", "markdown": "markdown", "md": "markdown",
    "mjs": "javascript", "mts": "javascript", "nix": "nix", "ods": "odf", "odt": "odf", "ots": "odf", "ott": "odf", "plist": "plist", "ps1": "powershell",
    "psd1": "powershell", "psm1": "powershell", "py": "python", "rake": "ruby", "rb": "ruby", "gemspec": "ruby", "go": "go", "sh": "shell", "sql": "sql",
    "latex": "latex", "tex": "latex", "tsv": "tsv", "txt": "text", "tf": "terraform", "tfvars": "terraform", "toml": "toml", "cts": "javascript",
    "ts": "javascript", "tsx": "javascript", "xml": "xml", "yaml": "yaml", "yml": "yaml", "zunit": "zunit", "zsh": "zsh",
}
# Languages by file name.
NAMES = {
    "go.mod": "go-module", "go.sum": "go-checksum", "go.work": "go-workspace", "Gemfile": "ruby", "Rakefile": "ruby", "Vagrantfile": "ruby", ".bashrc": "bash",
    ".bash_profile": "bash", ".bash_login": "bash", ".bash_logout": "bash", ".bash_aliases": "bash", ".zshrc": "zsh", ".zshenv": "zsh", ".zprofile": "zsh", ".zlogin": "zsh", ".zlogout": "zsh",
}
# Routes of bulk sources by extension.
ROUTES = {
    "eml": "eml", "mbox": "mbox", "md": "markdown", "markdown": "markdown", "json": "config", "jsonl": "config", "jsonc": "config", "toml": "config", "yaml": "config",
    "yml": "config", "xml": "config", "plist": "config", "txt": "document", "csv": "document", "tsv": "document", "tex": "document", "latex": "document", "odt": "document",
    "ods": "document", "ott": "document", "ots": "document", "html": "html", "htm": "html", "css": "css", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "javascript", "ts": "javascript", "mts": "javascript", "cts": "javascript", "tsx": "javascript", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "py": "python",
    "nix": "nix", "ps1": "powershell", "psd1": "powershell", "psm1": "powershell", "awk": "awk", "sh": "shell", "bash": "bash", "bats": "bats", "zunit": "zunit",
    "zsh": "zsh", "rss": "feed", "atom": "feed", "warc": "warc", "zip": "archive", "tar": "archive", "gz": "archive", "tgz": "archive", "7z": "archive", "rar": "archive",
    "bz2": "archive", "xz": "archive",
}
IGNORED_DIRS = (".git", ".hg", ".svn", "__pycache__", ".venv", "venv", "node_modules", ".mypy_cache", ".pytest_cache", ".tox", ".direnv", ".idea", ".vscode", "result")
GENERATED_DIRS = ("coverage", "generated", "reports")
CONFIG_NAMES = (".gitignore", "flake.lock", "flake.nix", "pyproject.toml", "go.mod", "go.sum", "go.work", ".bashrc", ".bash_profile", ".bash_login", ".bash_logout", ".bash_aliases", ".zshrc", ".zshenv", ".zprofile", ".zlogin", ".zlogout")
REQUIREMENTS = r"^(?:requirements(?:-[0-9A-Za-z_.-]+)?|dev-requirements|test-requirements)\.txt$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix without its point, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def excluded(path: Column, excludes: tuple[str, ...] = ()) -> Column:
    """Under an ignored directory, or matched by an exclude: a glob on the path or an ancestor, a bare name on any segment, else a prefix."""
    parts = F.split(path, "/")
    out = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in IGNORED_DIRS]))
    for e in excludes:
        e = e.strip("/")
        if any(c in e for c in "*?["):
            regex = "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]-" or c.isalnum() else "\\" + c for c in e) + "(/.*)?$"
            out = out | path.rlike(regex)
        elif "/" not in e:
            out = out | F.array_contains(parts, e)
        else:
            out = out | under(path, e)
    return out


def under(path: Column, prefix: str) -> Column:
    """Equal to the prefix, or below it as a directory; an empty prefix and `.` hold everything."""
    p = prefix.strip("/")
    return F.lit(True) if p in ("", ".") else (path == p) | path.startswith(p + "/")


def checked_prefix(prefix: str) -> str:
    """A path prefix without traversal, globs or a root; raises ValueError otherwise."""
    if prefix.startswith("/") or "\\" in prefix or "\x00" in prefix or any(c in prefix for c in "*?[") or any(s in ("..",) for s in prefix.split("/")):
        raise ValueError(f"not a plain relative prefix: {prefix!r}")
    return "/".join(s for s in prefix.split("/") if s not in ("", "."))


def language(path: Column, first_line: Column | None = None) -> Column:
    """By name, then dialect of .sh files, then extension, then the first line; else `unknown`."""
    name, ext = basename(path), extension(path)
    bang = F.coalesce(first_line, F.lit("")) if first_line is not None else F.lit("")
    by_bang = (
        F.when(~bang.startswith("#!"), None).when(bang.rlike(r"\bzsh\b"), "zsh").when(bang.rlike(r"\b[gmn]?awk\b"), "awk").when(bang.contains("python"), "python")
        .when(bang.contains("sh"), "shell").when(bang.contains("ruby"), "ruby")
    )
    return (
        F.when(_lookup(NAMES, name).isNotNull(), _lookup(NAMES, name))
        .when(path.rlike(r"(^|/)vendor/modules\.txt$"), "go-vendor-manifest")
        .when(name.rlike(REQUIREMENTS), "python")
        .when((ext == "sh") & bang.rlike(r"^#!.*\bzsh\b"), "zsh")
        .when((ext == "sh") & bang.rlike(r"^#!.*\bbash\b"), "bash")
        .otherwise(F.coalesce(_lookup(LANGUAGES, ext), by_bang, F.when(name.startswith("_") & bang.startswith("#compdef"), "zsh"), F.lit("unknown")))
    )


def generated(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in GENERATED_DIRS]))


def role(path: Column, executable: Column, is_generated: Column) -> Column:
    """The first that holds of generated, test, documentation, config, source, entrypoint; else `unknown`."""
    name, parts = basename(path), F.split(path, "/")
    ends = lambda *xs: name.rlike("(?:" + "|".join(x.replace(".", "\\.") for x in xs) + ")$")
    return (
        F.when(is_generated, "generated")
        .when(ends("_test.go", ".bats", ".zunit") | F.array_contains(parts, "test") | F.array_contains(parts, "tests") | name.contains(".test."), "test")
        .when(path.startswith("docs/") | name.endswith(".md"), "documentation")
        .when(name.isin(*CONFIG_NAMES) | path.rlike(r"(^|/)vendor/(.*/)?modules\.txt$") | name.rlike(REQUIREMENTS) | ends(".psd1", ".plist", ".tf", ".tfvars") | path.startswith(".github/"), "config")
        .when(ends(".awk", ".go", ".zsh"), "source")
        .when(executable | path.startswith("bin/"), "entrypoint")
        .when(path.startswith("src/"), "source")
        .otherwise("unknown")
    )


def profiled_role(path: Column, detected: Column, exact: dict[str, str] | None = None, generated_dirs=(), command_dirs=(), script_dirs=()) -> Column:
    """A profile's role: that of the exact path, else by directory (generated, entrypoint, script), else the detected one."""
    out = detected
    for dirs, value in ((script_dirs, "script"), (command_dirs, "entrypoint"), (generated_dirs, "generated")):
        for d in dirs:
            out = F.when(under(path, d), value).otherwise(out)
    for p, value in (exact or {}).items():
        out = F.when(path == p, value).otherwise(out)
    return out


def bulk_route(path: Column) -> Column:
    """The route of a bulk source's file, or null."""
    name = basename(path)
    return F.when(name.isin("Rakefile", "Gemfile", "Vagrantfile"), "ruby").when(F.lower(name).endswith(".warc.gz"), "warc").otherwise(_lookup(ROUTES, extension(path)))


def test_path(path: Column) -> Column:
    """In a directory test or tests, or named test_*, *_test.py or *.test.py."""
    name = basename(path)
    return path.rlike(r"(^|/)tests?/") | name.startswith("test_") | name.endswith("_test.py") | name.endswith(".test.py")


def go_constraints(path: Column) -> Column:
    """GOOS and GOARCH suffixes of a Go file's name: an array of at most two."""
    systems = "aix|android|darwin|dragonfly|freebsd|illumos|ios|js|linux|netbsd|openbsd|plan9|solaris|wasip1|windows"
    machines = "386|amd64|arm|arm64|loong64|mips|mips64|mips64le|mipsle|ppc64|ppc64le|riscv64|s390x|wasm"
    stem = F.regexp_replace(F.regexp_replace(basename(path), r"\.go$", ""), r"_test$", "")
    both = F.regexp_extract(stem, f"_({systems})_({machines})$", 1), F.regexp_extract(stem, f"_({systems})_({machines})$", 2)
    one = F.regexp_extract(stem, f"_({systems}|{machines})$", 1)
    return F.when(both[0] != "", F.array(*both)).when(one != "", F.array(one)).otherwise(F.array().cast("array<string>"))
