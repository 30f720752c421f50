"""Code: Python by its syntax tree, other languages by rules over lines."""

from __future__ import annotations

import ast
import re

from .common import obs, safe_value, secret_reason

HTTP = ("get", "post", "put", "patch", "delete", "head", "options", "route", "websocket")


def module_name(path: str) -> str:
    """The importable name of a file, from below src or lib where there is one."""
    parts = path.removesuffix(".py").split("/")
    for root in ("src", "lib", "python"):
        if root in parts[:-1]:
            parts = parts[parts.index(root) + 1 :]
            break
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts) or "__init__"


def relative_base(module: str, base: str | None, level: int, is_package: bool) -> str:
    """The module that a relative import starts from: one package up for each dot after the first."""
    if not level:
        return base or ""
    parts = module.split(".")
    keep = parts if is_package else parts[:-1]
    keep = keep[: len(keep) - (level - 1)] if level > 1 else keep
    return ".".join([*keep, *([base] if base else [])])


def python(path: str, text: str) -> list[dict]:
    module, package = module_name(path), path.endswith("__init__.py")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [obs("python.parse_error", path, getattr(e, "lineno", None) or 1, reason="syntax")]
    out = [obs("python.module", path, 1, module, end=max(1, text.count("\n") + (not text.endswith("\n"))), documented=ast.get_docstring(tree) is not None)]

    def walk(body, scope: list[str], in_class: bool):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = ".".join([module, *scope, node.name])
                if isinstance(node, ast.ClassDef):
                    bases = [ast.unparse(b) for b in node.bases]
                    out.append(obs("python.class", path, node.lineno, name, end=node.end_lineno, bases=bases))
                    if any(b.endswith(("models.Model", "Model")) for b in bases):
                        out.append(obs("python.django_model", path, node.lineno, name, end=node.end_lineno))
                    if any(b.endswith("View") for b in bases):
                        out.append(obs("python.django_view", path, node.lineno, name, end=node.end_lineno))
                    if node.name.startswith("Test"):
                        out.append(obs("python.test_class", path, node.lineno, name, end=node.end_lineno))
                else:
                    out.append(obs("python.method" if in_class else "python.function", path, node.lineno, name, end=node.end_lineno, is_async=isinstance(node, ast.AsyncFunctionDef)))
                    if node.name.startswith("test_"):
                        out.append(obs("python.test_function", path, node.lineno, name, end=node.end_lineno))
                    for d in node.decorator_list:
                        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in HTTP and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                            kind = "python.flask_route" if d.func.attr == "route" else "python.fastapi_route"
                            out.append(obs(kind, path, node.lineno, f"{d.func.attr.upper()} {d.args[0].value}", end=node.end_lineno, handler=name))
                walk(node.body, [*scope, node.name], isinstance(node, ast.ClassDef))
            elif isinstance(node, ast.Import):
                out.extend(obs("python.import", path, node.lineno, a.asname or a.name, a.name) for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                base = relative_base(module, node.module, node.level, package)
                out.extend(obs("python.import", path, node.lineno, a.asname or a.name, f"{base}.{a.name}" if a.name != "*" else base) for a in node.names)
            elif isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                walk([*node.body, *getattr(node, "orelse", []), *getattr(node, "finalbody", []), *[s for h in getattr(node, "handlers", []) for s in h.body]], scope, in_class)
            elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
                for t in node.targets:
                    if isinstance(t, ast.Name) and (reason := secret_reason(t.id, node.value.value)):
                        out.append(obs("secret.marker", path, node.lineno, t.id, redaction_reason=reason))
    walk(tree.body, [], False)
    for call in (n for n in ast.walk(tree) if isinstance(n, ast.Call)):
        f = call.func
        if isinstance(f, ast.Name) and f.id in ("path", "re_path", "url") and len(call.args) >= 2 and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str):
            out.append(obs("python.django_urlpattern", path, call.lineno, call.args[0].value, ast.unparse(call.args[1])))
    return out


def requirements(path: str, text: str) -> list[dict]:
    family = path.rsplit("/", 1)[-1].removesuffix(".txt")
    out = [obs("python.package_file", path, 1, family, file_family=family)]
    for n, line in enumerate(text.split("\n"), 1):
        line = line.split(" #")[0].strip()
        if m := re.match(r"([A-Za-z0-9][A-Za-z0-9._-]*)(\[[^\]]*\])?\s*([=<>!~]=?[^;\s]*)?", line):
            out.append(obs("python.requirement", path, n, m[1].lower().replace("_", "-"), version_constraint=m[3] or None))
    return out


# Rules: language -> (kind, pattern); the groups `name` and `target` go to the observation, all others to its metadata.
RULES: dict[str, list[tuple[str, str]]] = {
    "go": [
        ("go.package", r"^package (?P<name>\w+)"), ("go.import", r'^(?:import|\t)\s*(?:\w+ |\. |_ )?"(?P<target>[^"]+)"\s*$'), ("go.method", r"^func \((?:\w+ )?(?P<receiver>\*?\w+)[^)]*\) (?P<name>\w+)"),
        ("go.function", r"^func (?P<name>\w+)"), ("go.type", r"^type (?P<name>\w+) (?P<shape>\w+)"),
    ],
    "go-module": [("go.module", r"^module (?P<name>\S+)"), ("go.require", r"^(?:require )?\s*(?P<target>[\w.\-/~]+\.[\w.\-/~]+) (?P<version>v\S+)"), ("go.replace", r"^(?:replace )?\s*(?P<name>\S+)(?: v\S+)? => (?P<target>\S+)"), ("go.exclude", r"^exclude (?P<target>\S+) (?P<version>v\S+)"), ("go.retract", r"^retract (?P<name>.+)")],
    "go-workspace": [("go.use", r"^(?:use )?\s*(?P<target>\./\S*)")],
    "javascript": [
        ("js.import", r"""^\s*import\b[^'"]*['"](?P<target>[^'"]+)['"]"""), ("js.import", r"""\brequire\(\s*['"](?P<target>[^'"]+)['"]\s*\)"""), ("js.export", r"^\s*export (?:default )?(?:async )?(?:function|class|const|let|var)\*? (?P<name>\w+)"),
        ("js.function", r"^\s*(?:export )?(?:default )?(?:async )?function\*? (?P<name>\w+)"), ("js.function", r"^\s*(?:export )?const (?P<name>\w+)\s*=\s*(?:async )?(?:\([^)]*\)|\w+)\s*=>"), ("js.class", r"^\s*(?:export )?(?:default )?(?:abstract )?class (?P<name>\w+)"),
        ("js.component", r"^\s*(?:export )?(?:default )?function (?P<name>[A-Z]\w*)"), ("js.route", r"""\b(?:app|router)\.(?P<method>get|post|put|patch|delete)\(\s*['"](?P<name>[^'"]+)['"]"""), ("js.test_suite", r"""^\s*describe(?:\.\w+)?\(\s*['"`](?P<name>[^'"`]+)"""),
        ("js.test_case", r"""^\s*(?:it|test)(?:\.\w+)?\(\s*['"`](?P<name>[^'"`]+)"""), ("js.hook", r"\b(?P<name>use[A-Z]\w*)\("), ("js.test_expectation", r"\b(?P<name>expect)\("),
    ],
    "ruby": [
        ("ruby.require", r"""^\s*require(?:_relative)? ['"](?P<target>[^'"]+)"""), ("ruby.module", r"^\s*module (?P<name>[A-Z][\w:]*)"), ("ruby.class", r"^\s*class (?P<name>[A-Z][\w:]*)(?: < (?P<base>[\w:]+))?"), ("ruby.singleton_method", r"^\s*def self\.(?P<name>\w+[?!=]?)"),
        ("ruby.method", r"^\s*def (?P<name>\w+[?!=]?)"), ("ruby.constant", r"^\s*(?P<name>[A-Z][A-Z0-9_]+)\s*="), ("ruby.gem_dependency", r"""^\s*(?:gem|\w+\.add_(?:development_)?dependency) ['"](?P<name>[^'"]+)"""), ("ruby.route", r"""^\s*(?P<method>get|post|put|patch|delete) ['"](?P<name>[^'"]+)"""),
        ("ruby.rake_task", r"^\s*task :?(?P<name>\w+)"), ("ruby.test_case", r"""^\s*(?:it|test|describe) ['"](?P<name>[^'"]+)"""),
    ],
    "rust": [("rust.item", r"^\s*(?:pub(?:\([^)]*\))? )?(?:async )?(?:unsafe )?(?P<shape>fn|struct|enum|trait|mod|type|const|static|impl) (?P<name>\w+)")],
    "nix": [("nix.flake_input", r"^\s*(?:inputs\.)?(?P<name>[\w-]+)\.url\s*=\s*\"(?P<target>[^\"]+)\""), ("nix.input_ref", r"\binputs\.(?P<target>[\w-]+)"), ("nix.module_export", r"\b(?:nixosModules|homeModules|darwinModules)\.(?P<name>[\w-]+)\s*="), ("nix.package", r"\bpackages\.[^\s=]*?\.?(?P<name>[\w-]+)\s*="),
        ("nix.app", r"\bapps\.[^\s=]*?\.?(?P<name>[\w-]+)\s*="), ("nix.check", r"\bchecks\.[^\s=]*?\.?(?P<name>[\w-]+)\s*="), ("nix.import", r"\bimport (?P<target>\.{0,2}/[\w./-]+)")],
    "terraform": [("terraform.resource", r'^\s*resource "(?P<type>[^"]+)" "(?P<name>[^"]+)"'), ("terraform.data", r'^\s*data "(?P<type>[^"]+)" "(?P<name>[^"]+)"'), ("terraform.module", r'^\s*module "(?P<name>[^"]+)"'), ("terraform.variable", r'^\s*variable "(?P<name>[^"]+)"'), ("terraform.output", r'^\s*output "(?P<name>[^"]+)"'),
        ("terraform.provider", r'^\s*provider "(?P<name>[^"]+)"'), ("terraform.reference", r"\b(?P<target>(?:var|local|module|data)\.[A-Za-z_][\w.]*)")],
    "awk": [("awk.function", r"^\s*function (?P<name>\w+)"), ("awk.include", r'^@include "(?P<target>[^"]+)"'), ("awk.builtin_call", r"\b(?P<name>gsub|sub|match|split|substr|sprintf|printf|getline|system|tolower|toupper|index|length)\s*\(")],
    "powershell": [("powershell.function", r"(?i)^\s*function (?P<name>[\w-]+)"), ("powershell.alias", r"(?i)^\s*(?:set|new)-alias (?:-name )?(?P<name>[\w-]+) (?:-value )?(?P<target>[\w-]+)"), ("powershell.import", r"(?i)^\s*import-module (?P<target>\S+)"), ("powershell.splat", r"\s@(?P<name>[a-z]\w*)\b")],
    "bats": [("bats.test_case", r'^\s*@test ["\'](?P<name>[^"\']+)'), ("bats.hook", r"^\s*(?P<name>setup|teardown|setup_file|teardown_file)\s*\(\)"), ("bats.load", r"^\s*load ['\"]?(?P<target>[\w./-]+)"), ("bats.assertion", r"^\s*(?P<name>assert\w*|refute\w*)\b"), ("bats.command", r"^\s*run (?P<name>\S+)")],
    "zunit": [("zunit.test_case", r"^\s*@test ['\"](?P<name>[^'\"]+)"), ("zunit.hook", r"^\s*@(?P<name>setup|teardown)"), ("zunit.assertion", r"^\s*(?P<name>assert)\b"), ("zunit.mock", r"^\s*(?P<name>mock|stub) (?P<target>\S+)")],
}
_COMPILED = {lang: [(k, re.compile(p)) for k, p in rules] for lang, rules in RULES.items()}
_HEADS = {"javascript": "js.module", "bats": "bats.file", "zunit": "zunit.file", "nix": "nix.file", "ruby": "ruby.file", "terraform": "terraform.file"}


def by_rules(language: str):
    def extract(path: str, text: str) -> list[dict]:
        out = [obs(_HEADS[language], path, 1, path)] if language in _HEADS else []
        for n, line in enumerate(text.split("\n"), 1):
            for kind, pattern in _COMPILED[language]:
                for m in pattern.finditer(line):
                    g = m.groupdict()
                    name, target = g.pop("name", None), g.pop("target", None)
                    out.append(obs(kind, path, n, name, target, **g))
        return out

    return extract


# Shell. Commands by what they do.
FAMILIES = {
    "package": ("apt", "apt-get", "brew", "dnf", "yum", "pacman", "apk", "pip", "pip3", "npm", "yarn", "gem", "cargo", "nix-env"), "service": ("systemctl", "service", "launchctl", "rc-service"), "network": ("curl", "wget", "ssh", "scp", "rsync", "nc", "ftp"),
    "permission": ("chmod", "chgrp", "setfacl"), "ownership": ("chown",), "container": ("docker", "podman", "kubectl", "helm", "docker-compose"), "archive": ("tar", "zip", "unzip", "gzip", "gunzip"), "write": ("tee", "mv", "cp", "rm", "mkdir", "ln", "touch", "dd", "install"),
    "infra": ("terraform", "ansible", "ansible-playbook", "pulumi"), "security": ("gpg", "openssl", "ssh-keygen", "sudoedit", "visudo"), "read": ("cat", "less", "head", "tail", "grep", "find", "ls"),
}
_FAMILY = {c: f for f, cs in FAMILIES.items() for c in cs}
MUTATING = ("package", "service", "permission", "ownership", "infra")
WRAPPERS = ("sudo", "doas", "env", "nohup", "time", "exec", "command", "builtin", "xargs")
OPERATIONS = ("install", "remove", "uninstall", "upgrade", "update", "add", "purge", "start", "stop", "restart", "enable", "disable", "reload", "apply", "destroy")


def shell_words(line: str) -> list[str]:
    """Words and operators of a line, quotes kept together; comments dropped."""
    out, word, quote, k = [], "", "", 0
    while k < len(line):
        c = line[k]
        if quote:
            word += c
            if c == "\\" and quote == '"' and k + 1 < len(line):
                k += 1
                word += line[k]
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
            word += c
        elif c == "\\" and k + 1 < len(line):
            word += line[k : k + 2]
            k += 1
        elif c == "#" and not word:
            break
        elif c.isspace() or c in ";|&<>":
            if word:
                out.append(word)
                word = ""
            if not c.isspace():
                op = c
                while k + 1 < len(line) and line[k + 1] in ";|&<>" and len(op) < 2:
                    k += 1
                    op += line[k]
                out.append(op)
        else:
            word += c
        k += 1
    return out + ([word] if word else [])


def segments(words: list[str]) -> list[list[str]]:
    """Commands between ; && || | and &."""
    out: list[list[str]] = [[]]
    for w in words:
        if w in (";", "&&", "||", "|", "&", "|&", ";;"):
            out.append([])
        else:
            out[-1].append(w)
    return [s for s in out if s]


def shell(dialect: str):
    def extract(path: str, text: str) -> list[dict]:
        out = [obs(f"{dialect}.script", path, 1, path)]
        for n, line in enumerate(text.split("\n"), 1):
            if m := re.match(r"^\s*(?:function\s+)?([A-Za-z_][\w:-]*)\s*\(\)", line):
                out.append(obs(f"{dialect}.function", path, n, m[1]))
                continue
            for m in re.finditer(r"\$\{?([A-Za-z_]\w*)", line):
                out.append(obs("shell.env_read", path, n, m[1], f"env:{m[1]}"))
            for words in segments(shell_words(line)):
                if m := re.match(r"^(?:(export|local|readonly|declare)$)?([A-Za-z_]\w*)=(.*)$", words[0] if words[0] not in ("export", "local", "readonly", "declare") else (words[1] if len(words) > 1 else "")):
                    value, reason = safe_value(m[2], m[3].strip("'\""))
                    out.append(obs("shell.env_write", path, n, m[2], f"env:{m[2]}", value_kind="secret" if reason else "literal", redaction_reason=reason))
                    continue
                privileged = words[0] in ("sudo", "doas")
                while len(words) > 1 and (words[0] in WRAPPERS or (privileged and words[0].startswith("-"))):
                    words = words[1:]
                head, args = words[0], words[1:]
                if head in ("source", "."):
                    out.append(obs("shell.source", path, n, head, args[0].strip("'\"") if args else None))
                    continue
                for k, w in enumerate(args[:-1]):
                    if w in (">", ">>", "<", "<<", ">&", "&>"):
                        out.append(obs("shell.redirect", path, n, w, args[k + 1], direction="in" if "<" in w else "out"))
                if not re.match(r"^[A-Za-z_./][\w./+-]*$", head) or head in ("if", "then", "else", "elif", "fi", "for", "do", "done", "while", "case", "esac", "in", "function"):
                    continue
                family = _FAMILY.get(head.rsplit("/", 1)[-1], "other")
                operation = next((a for a in args if a in OPERATIONS), None)
                plain = [a for a in args if not a.startswith("-") and a != operation]
                out.append(obs("shell.command", path, n, head, f"command:{head}", family=family, operation=operation, n_args=len(args)))
                if family == "network" and (url := next((a for a in args if "://" in a), None)):
                    out.append(obs("shell.network", path, n, head, safe_value(None, url.strip("'\""))[0]))
                if family in MUTATING:
                    out.append(obs("shell.host_mutation", path, n, head, f"host:{family}", category=family, tool=head, privileged=privileged, operation=operation, subject=plain[0] if plain else None))
        return out

    return extract
