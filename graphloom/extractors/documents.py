"""Documents: Markdown, HTML, CSS, feeds, mail, tables, LaTeX and structured configuration."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import plistlib
import re
import tomllib
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

from .common import obs, safe_value


def anchor(text: str) -> str:
    t = re.sub(r"[`*_\[\]()]", "", text).strip().lower()
    return re.sub(r"-+", "-", re.sub(r"[^a-z0-9_-]", "", re.sub(r"\s+", "-", t))).strip("-") or "section"


def markdown(path: str, text: str) -> list[dict]:
    lines, out, seen = text.split("\n"), [obs("markdown.document", path, 1, path)], {}
    k = 0
    if lines and lines[0].strip() == "---" and "---" in [x.strip() for x in lines[1:]]:
        end = [x.strip() for x in lines[1:]].index("---") + 1
        fields = dict(m.groups() for x in lines[1:end] if (m := re.match(r"^(\w[\w-]*):\s*(.*)$", x)))
        out.append(obs("markdown.frontmatter", path, 1, path, end=end + 1, keys=sorted(fields)))
        if "status" in fields and "/adr/" in f"/{path}":
            out.append(obs("markdown.adr_metadata", path, 1, fields.get("title", path), end=end + 1, status=fields["status"]))
        if path.endswith("SKILL.md") and "name" in fields:
            out.append(obs("markdown.skill_metadata", path, 1, fields["name"], end=end + 1))
        k = end + 1
    fence = None
    for n in range(k, len(lines)):
        line = lines[n]
        if m := re.match(r"^\s{0,3}(```+|~~~+)\s*(\S*)", line):
            if fence is None:
                fence = m[1]
                out.append(obs("markdown.code_fence", path, n + 1, m[2] or "text"))
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = None
            continue
        if fence:
            continue
        if m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line):
            a = anchor(m[2])
            seen[a] = seen.get(a, -1) + 1
            out.append(obs("markdown.heading", path, n + 1, a if not seen[a] else f"{a}-{seen[a]}", level=len(m[1]), title=m[2]))
        for m in re.finditer(r"\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)", line):
            out.append(obs("markdown.link", path, n + 1, m[1] or None, m[2]))
    return out


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, path: str):
        super().__init__(convert_charrefs=True)
        self.path, self.stack, self.count, self.out = path, [], {}, [obs("html.document", path, 1, path)]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        base = "".join(f"/{x}" for x in self.stack)
        place = self.count[(base, tag)] = self.count.get((base, tag), -1) + 1
        pointer, line = f"{base}/{tag}[{place}]", self.getpos()[0]
        if "id" in a or "class" in a or tag in ("h1", "h2", "h3", "form", "nav", "article", "section"):
            self.out.append(obs("html.element", self.path, line, pointer, tag=tag, id=a.get("id"), classes=sorted(set(a["class"].split())) if "class" in a else None))
        if tag == "a" and a.get("href"):
            self.out.append(obs("html.link", self.path, line, None, a["href"]))
        if asset := a.get("src") if tag in ("script", "img", "iframe", "source") else a.get("href") if tag == "link" else None:
            self.out.append(obs("html.asset", self.path, line, tag, asset, rel=a.get("rel")))
        if tag not in self.VOID:
            self.stack.append(f"{tag}[{place}]")

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].startswith(tag + "["):
                del self.stack[k:]
                break


def html(path: str, text: str) -> list[dict]:
    p = _Html(path)
    p.feed(text)
    p.close()
    return p.out


def css(path: str, text: str) -> list[dict]:
    out = [obs("css.stylesheet", path, 1, path)]
    body = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for m in re.finditer(r"@import\s+(?:url\()?['\"]?([^'\")\s;]+)", body):
        out.append(obs("css.import", path, body.count("\n", 0, m.start()) + 1, None, m[1]))
    for m in re.finditer(r"url\(\s*['\"]?([^'\")]+)", body):
        out.append(obs("css.asset", path, body.count("\n", 0, m.start()) + 1, None, m[1]))
    for m in re.finditer(r"([^{};@]+)\{", body):
        line = body.count("\n", 0, m.start() + len(m[1]) - len(m[1].lstrip())) + 1
        for s in m[1].split(","):
            if s := " ".join(s.split()):
                last = re.split(r"[\s>+~]+", s)[-1]
                out.append(obs("css.selector", path, line, s, tag=(re.match(r"^[a-zA-Z][\w-]*", last) or [None])[0], classes=sorted(re.findall(r"\.([\w-]+)", last)), id=next(iter(re.findall(r"#([\w-]+)", last)), None), depth=len(re.split(r"[\s>+~]+", s))))
    return out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def feed(path: str, text: str) -> list[dict]:
    if text.lstrip().startswith("{"):
        return _json_feed(path, json.loads(text))
    root = ET.fromstring(text)
    out = [obs("feed.document", path, 1, path, format=_local(root.tag).lower())]
    child = lambda e, *names: next((c for c in e if _local(c.tag) in names), None)
    words = lambda e, *names: (child(e, *names).text or "").strip() if child(e, *names) is not None else None
    channel = child(root, "channel") if _local(root.tag).lower() in ("rss", "rdf") else root
    if channel is None:
        return [obs("feed.parse_error", path, 1, reason="no_channel")]
    out.append(obs("feed.channel", path, 1, words(channel, "title") or path))
    items = [e for e in root.iter() if _local(e.tag) in ("item", "entry")]
    for n, item in enumerate(items):
        key = words(item, "guid", "id") or words(item, "link") or f"item-{n}"
        out.append(obs("feed.item", path, 1, key, title=words(item, "title"), published_at=words(item, "pubDate", "published", "updated"), ordinal=n))
        for c in item:
            tag, value = _local(c.tag), (c.text or "").strip()
            if tag == "link":
                out.append(obs("feed.link", path, 1, key, c.get("href") or value))
            elif tag in ("author", "creator"):
                out.append(obs("feed.author", path, 1, key, (words(c, "name") or value)))
            elif tag == "category":
                out.append(obs("feed.category", path, 1, key, c.get("term") or value))
            elif tag == "enclosure":
                out.append(obs("feed.enclosure", path, 1, key, c.get("url")))
    return out


def _json_feed(path: str, value: dict) -> list[dict]:
    out = [obs("feed.document", path, 1, path, format="json"), obs("feed.channel", path, 1, value.get("title") or path)]
    for n, item in enumerate(value.get("items", [])):
        key = str(item.get("id") or item.get("url") or f"item-{n}")
        out.append(obs("feed.item", path, 1, key, title=item.get("title"), published_at=item.get("date_published"), ordinal=n))
        out += [obs("feed.link", path, 1, key, item["url"])] if item.get("url") else []
        out += [obs("feed.author", path, 1, key, a.get("name")) for a in item.get("authors", [])]
        out += [obs("feed.category", path, 1, key, t) for t in item.get("tags", [])]
    return out


def mail(path: str, text: str) -> list[dict]:
    if path.endswith(".mbox"):
        parts = re.split(r"(?m)^From .*\n", text)[1:]
        return [obs("email.mailbox", path, 1, path, messages=len(parts))] + [o for k, p in enumerate(parts) for o in _message(path, p, f"{path}#{k}")]
    return _message(path, text, path)


def _message(path: str, text: str, fallback: str) -> list[dict]:
    m = email.message_from_string(text, policy=email.policy.compat32)
    key = (m["Message-ID"] or fallback).strip()
    out = [obs("email.message", path, 1, key, subject=bool(m["Subject"]), date=m["Date"])]
    for role in ("From", "To", "Cc"):
        for _, address in email.utils.getaddresses(m.get_all(role, [])):
            if address:
                out.append(obs("email.address", path, 1, key, address.lower(), role=role.lower()))
    for role in ("In-Reply-To", "References"):
        out += [obs("email.thread_hint", path, 1, f"{key}>{t}", t, role=role.lower()) for t in (m[role] or "").split()]
    for k, part in enumerate(m.walk()):
        if part.is_multipart():
            continue
        kind = "email.attachment_stub" if part.get_filename() else "email.part"
        out.append(obs(kind, path, 1, f"{key}/{k}", content_type=part.get_content_type(), filename=part.get_filename()))
    return out


def table(path: str, text: str) -> list[dict]:
    rows = list(csv.reader(io.StringIO(text), delimiter="\t" if path.endswith(".tsv") else ","))
    return [obs("document.page", path, 1, path), obs("document.table", path, 1, path, columns=rows[0] if rows else [], rows=max(0, len(rows) - 1))]


def latex(path: str, text: str) -> list[dict]:
    out = [obs("document.page", path, 1, path)]
    for n, line in enumerate(text.split("\n"), 1):
        for m in re.finditer(r"\\(section|subsection|chapter|subsubsection)\*?\{([^}]*)\}", line):
            out.append(obs("document.section", path, n, anchor(m[2]), level=m[1]))
        for m in re.finditer(r"\\(?:input|include|includegraphics)(?:\[[^\]]*\])?\{([^}]*)\}", line):
            out.append(obs("document.reference", path, n, None, m[1]))
    return out


def plain(path: str, text: str) -> list[dict]:
    return [obs("document.page", path, 1, path, lines=text.count("\n") + (not text.endswith("\n") and text != ""))]


def without_comments(text: str) -> str:
    """JSON text from JSON with comments and trailing commas; strings stay."""
    out, k, n = [], 0, len(text)
    while k < n:
        if text[k] == '"':
            end = k + 1
            while end < n and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            out.append(text[k : end + 1])
            k = end + 1
        elif text.startswith("//", k):
            k = n if (e := text.find("\n", k)) < 0 else e
        elif text.startswith("/*", k):
            end = text.find("*/", k)
            out.append("\n" * text.count("\n", k, end if end >= 0 else n))
            k = n if end < 0 else end + 2
        else:
            out.append(text[k])
            k += 1
    return re.sub(r",(\s*[}\]])", r"\1", "".join(out))


def pointer(segments: list) -> str:
    return "".join("/" + str(s).replace("~", "~0").replace("/", "~1") for s in segments)


def _paths(path: str, value, out: list[dict]) -> None:
    """config.path and config.reference of every nested value, in the file's order; a walk without recursion, whatever the depth or number."""
    items = lambda v: iter(v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ())
    stack = [("", items(value))]
    while stack:
        at, rest = stack[-1]
        k, v = next(rest, (None, rest))
        if v is rest:
            stack.pop()
            continue
        where = at + pointer([k])
        if isinstance(v, (dict, list)):
            out.append(obs("config.path", path, None, where, value_type="object" if isinstance(v, dict) else "array"))
            stack.append((where, items(v)))
            continue
        shown, reason = safe_value(str(k), str(v)) if isinstance(v, str) else (None, None)
        out.append(obs("config.path", path, None, where, value_type=type(v).__name__, redaction_reason=reason))
        if k == "$ref" and isinstance(v, str):
            out.append(obs("config.reference", path, None, where, shown))
        elif shown and not reason and re.match(r"^(?:\.{1,2}/|https?://)", shown):
            out.append(obs("config.reference", path, None, where, shown))


def _yaml(text: str):
    """A subset: nested mappings, lists of scalars or mappings, plain and quoted scalars, inline lists."""
    rows = [(len(x) - len(x.lstrip()), x.strip(), n) for n, x in enumerate(text.split("\n"), 1) if x.strip() and not x.strip().startswith("#") and x.strip() not in ("---", "...")]

    def scalar(s: str):
        s = re.sub(r"\s+#.*$", "", s).strip()
        if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s[:1] == "[" and s[-1:] == "]":
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if s in ("true", "false"):
            return s == "true"
        if s in ("", "~", "null"):
            return None
        return int(s) if re.fullmatch(r"-?\d+", s) else s

    def block(k: int, indent: int):
        out = None
        while k < len(rows) and rows[k][0] >= indent:
            pad, line, _ = rows[k]
            if pad > indent:
                raise ValueError(f"indentation at line {rows[k][2]}")
            if line.startswith("- ") or line == "-":
                out = [] if out is None else out
                rest = line[1:].strip()
                if re.match(r"^[\w.\"'$/-]+:(\s|$)", rest):
                    rows[k] = (pad + 2, rest, rows[k][2])
                    value, k = block(k, pad + 2)
                elif rest:
                    value, k = scalar(rest), k + 1
                else:
                    value, k = block(k + 1, rows[k + 1][0]) if k + 1 < len(rows) and rows[k + 1][0] > pad else (None, k + 1)
                out.append(value)
                continue
            m = re.match(r"^(\"[^\"]*\"|'[^']*'|[^:\s][^:]*):(?:\s+(.*))?$", line)
            if not m or isinstance(out, list):
                raise ValueError(f"not a mapping at line {rows[k][2]}")
            out = {} if out is None else out
            key = m[1].strip("\"'")
            if m[2] and m[2].strip() not in ("|", ">", "|-", ">-"):
                out[key], k = scalar(m[2]), k + 1
            elif m[2]:
                k += 1
                held = []
                while k < len(rows) and rows[k][0] > pad:
                    held.append(rows[k][1])
                    k += 1
                out[key] = "\n".join(held)
            elif k + 1 < len(rows) and (rows[k + 1][0] > pad or (rows[k + 1][0] == pad and rows[k + 1][1].startswith("- "))):
                out[key], k = block(k + 1, rows[k + 1][0])
            else:
                out[key], k = None, k + 1
        return out, k

    return block(0, rows[0][0])[0] if rows else None


def config(kind: str):
    parse = {"json": json.loads, "jsonc": lambda t: json.loads(without_comments(t)), "toml": tomllib.loads, "yaml": _yaml, "jsonl": lambda t: [json.loads(x) for x in t.split("\n") if x.strip()], "plist": lambda t: plistlib.loads(t.encode())}[kind]

    def extract(path: str, text: str) -> list[dict]:
        value = parse(text)
        out = [obs("config.document", path, 1, path, format=kind)]
        _paths(path, value, out)
        name = path.rsplit("/", 1)[-1]
        if isinstance(value, dict):
            if "openapi" in value or "swagger" in value:
                out += openapi(path, value)
            if name == "pyproject.toml":
                out.append(obs("python.package_file", path, 1, "pyproject", file_family="pyproject"))
                for d in (value.get("project") or {}).get("dependencies", []):
                    if m := re.match(r"([A-Za-z0-9][\w.-]*)\s*(\[[^\]]*\])?\s*([=<>!~]=?.*)?", d):
                        out.append(obs("python.requirement", path, None, m[1].lower().replace("_", "-"), version_constraint=m[3] or None))
            if name == "package.json":
                out += [obs("js.dependency", path, None, k, f"npm:{k}", version=v if isinstance(v, str) else None) for d in ("dependencies", "devDependencies") for k, v in (value.get(d) or {}).items()]
            if "apiVersion" in value and "kind" in value:
                out.append(obs("k8s.resource", path, 1, f"{value['kind']}/{(value.get('metadata') or {}).get('name')}", api_version=str(value["apiVersion"])))
            if "jobs" in value and "/workflows/" in path:
                out += [obs("ci.job", path, None, j) for j in (value["jobs"] or {})]
            if "services" in value and "compose" in name:
                out += [obs("docker.service", path, None, s, (v or {}).get("image")) for s, v in (value["services"] or {}).items()]
        return out

    return extract


def openapi(path: str, value: dict) -> list[dict]:
    out = [obs("openapi.document", path, 1, path, version=str(value.get("openapi") or value.get("swagger")))]
    for p, methods in (value.get("paths") or {}).items():
        out.append(obs("openapi.path", path, None, p))
        for m, op in (methods or {}).items():
            if m in ("get", "post", "put", "patch", "delete", "head", "options", "trace"):
                op = op or {}
                out.append(obs("openapi.operation", path, None, f"{m.upper()} {p}", operation_id=op.get("operationId")))
                out += [obs("openapi.parameter", path, None, f"{m.upper()} {p} {x.get('name')}") for x in op.get("parameters", []) if isinstance(x, dict)]
                out += [obs("openapi.response", path, None, f"{m.upper()} {p} {code}") for code in op.get("responses") or {}]
    for group, items in (value.get("components") or {}).items():
        kind = {"schemas": "openapi.schema", "securitySchemes": "openapi.security_scheme"}.get(group, "openapi.component")
        out += [obs(kind, path, None, f"{group}/{k}") for k in items or {}]
    out += [obs("openapi.schema", path, None, f"definitions/{k}") for k in value.get("definitions") or {}]
    return out


def xml(path: str, text: str) -> list[dict]:
    root = ET.fromstring(text)
    if _local(root.tag).lower() in ("rss", "feed", "rdf"):
        return feed(path, text)
    out = [obs("xml.document", path, 1, path, root=_local(root.tag))]
    for e in root.iter():
        tag = _local(e.tag)
        if tag == "dependency":
            part = {_local(c.tag): (c.text or "").strip() for c in e}
            out.append(obs("xml.reference", path, None, "maven", f"maven:{part.get('groupId')}/{part.get('artifactId')}", version=part.get("version")))
        if tag == "bean" and e.get("class"):
            out.append(obs("xml.reference", path, None, e.get("id"), f"class:{e.get('class')}"))
        for k in ("href", "src", "ref", "schemaLocation"):
            if e.get(k):
                out.append(obs("xml.reference", path, None, k, e.get(k)))
    return out
