"""Ranking functions: match class, subject family, affinity, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import test_path

# Fixed values of the intents.
PYTHON_CODE = ("python.module", "python.class", "python.function", "python.method")
DOC_KINDS = ("doc.page", "doc.section", "doc.adr", "doc.skill")
MESSAGE_KINDS = ("email.mailbox", "email.message", "email.part", "email.attachment_stub", "email.thread_hint", "email.address", "feed.document", "feed.channel", "feed.item", "feed.author", "feed.category")
TEST_KINDS = (
    "bats.file", "bats.test_case", "bats.expectation", "zunit.file", "zunit.suite", "zunit.test_case", "zunit.hook", "zunit.assertion", "zunit.expectation", "zunit.command_under_test",
    "zunit.mock", "zunit.stub", "js.test_suite", "js.test_case", "ruby.test_case", "ruby.test_method", "nix.check",
)
CODE_KINDS = (
    "python.module", "python.class", "python.function", "python.method", "js.file", "js.module", "js.function", "js.class", "js.method", "js.component", "js.route",
    "ruby.file", "ruby.module", "ruby.class", "ruby.method", "ruby.singleton_method", "ruby.constant", "ruby.route", "nix.app", "nix.package", "nix.devShell",
)
CODE_FAMILIES = ("go.", "bash.", "zsh.", "awk.", "powershell.", "config.", "css.", "html.", "xml.")
INTENTS = ("definition", "implementation", "tests", "docs", "messages", "general")
MATCH_CLASSES = ("display_exact", "display_casefold_exact", "key_terminal_exact", "display_prefix", "display_substring", "key_substring", "kind_only")


def _ends_at_boundary(text: Column, q: Column, n: Column) -> Column:
    before = F.substr(text, F.length(text) - n, F.lit(1))
    return text.endswith(q) & ((F.length(text) == n) | ~before.rlike(r"^[\p{L}\p{N}_]$"))


def match_class(query: str | None, key: Column, display: Column) -> Column:
    """0 to 6: how a candidate matches the query; the first that holds of MATCH_CLASSES."""
    q = (query or "").strip()
    if not q:
        return F.lit(6)
    exact, low, n = F.lit(q), F.lower(F.lit(q)), F.lit(len(q))
    d, dl, kl = F.nullif(display, F.lit("")), F.lower(F.nullif(display, F.lit(""))), F.lower(key)
    return (
        F.when(d == exact, 0).when(dl == low, 1).when(_ends_at_boundary(key, exact, n) | _ends_at_boundary(kl, low, n), 2)
        .when(F.startswith(dl, low), 3).when(F.contains(dl, low), 4).when(F.contains(kl, low), 5).otherwise(6)
    )


def _code(kind: Column) -> Column:
    families = F.lit(False)
    for family in CODE_FAMILIES:
        families = families | kind.startswith(family)
    return kind.isin(*CODE_KINDS) | families


def subject_family(kind: Column, key: Column, display: Column, path: Column) -> Column:
    tail = F.regexp_extract(key, r"([^:#/.]*)$", 1)
    symbol = F.coalesce(F.nullif(display, F.lit("")), tail)
    python_test = test_path(F.coalesce(path, F.lit(""))) | (kind.isin("python.function", "python.method") & symbol.startswith("test_")) | ((kind == "python.class") & symbol.startswith("Test"))
    return (
        F.when(kind.isin(*PYTHON_CODE), F.when(python_test, "python_test_subject").otherwise("code_definition")).when(kind.isin(*DOC_KINDS), "doc_artifact")
        .when(kind.isin(*MESSAGE_KINDS), "message_artifact").when(kind.isin(*TEST_KINDS), "test_subject").when(_code(kind), "code_definition").otherwise("other")
    )


def affinity_tier(intent: str | None, kind: Column, family: Column) -> Column:
    """0 for kinds that the intent asks for, 1 for others and for no or a general intent."""
    if intent not in INTENTS and intent is not None:
        raise ValueError(f"unknown intent {intent!r}")
    affine = {
        "definition": (family != "python_test_subject") & _code(kind), "implementation": (family != "python_test_subject") & _code(kind),
        "tests": (family == "python_test_subject") | kind.isin(*TEST_KINDS), "docs": kind.isin(*DOC_KINDS), "messages": kind.isin(*MESSAGE_KINDS),
    }.get(intent)
    return F.lit(1) if affine is None else F.when(affine, 0).otherwise(1)


def evidence_tier(withheld: Column, verified: Column, direct: Column) -> Column:
    return F.when(withheld, 3).when(verified, 0).when(direct, 1).otherwise(2)


# Which evidence speaks of its subject directly: (link kinds, subject kinds, raw kinds, or None for the subject's own kind).
DIRECT_EVIDENCE = (
    (("observed",), PYTHON_CODE, None),
    (("observed",), ("doc.page",), ("markdown.document",)),
    (("observed",), ("doc.section",), ("markdown.heading",)),
    (("observed",), ("doc.adr",), ("markdown.adr_metadata",)),
    (("observed",), ("doc.skill",), ("markdown.skill_metadata",)),
    (("observed",), MESSAGE_KINDS, None),
    (("observed",), ("js.test_suite", "js.test_case", "ruby.test_case", "ruby.test_method", "bats.file", "zunit.file", "zunit.command_under_test", "nix.check"), None),
    (("observed", "inferred_from_edge"), ("bats.test_case", "zunit.suite", "zunit.test_case", "zunit.assertion", "zunit.expectation", "zunit.mock", "zunit.stub", "zunit.command_under_test", "nix.check"), None),
    (("observed", "inferred_from_edge"), ("bats.expectation",), ("bats.assertion", "bats.refutation")),
    (("observed", "inferred_from_edge"), ("zunit.hook",), ("zunit.setup", "zunit.teardown", "zunit.before_each", "zunit.after_each", "zunit.hook")),
)


def evidence_role(link_kind: Column, subject_kind: Column, raw_kind: Column) -> Column:
    """direct, reference or unknown: what a piece of evidence says of its subject."""
    direct = F.lit(False)
    for links, subjects, raws in DIRECT_EVIDENCE:
        direct = direct | (link_kind.isin(*links) & subject_kind.isin(*subjects) & (raw_kind == subject_kind if raws is None else raw_kind.isin(*raws)))
    return F.when(direct, "direct").when(link_kind == "inferred_from_edge", "reference").otherwise("unknown")
