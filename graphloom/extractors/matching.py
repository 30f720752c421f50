"""Matches across files: CSS selectors with HTML elements, Nix inputs with bindings, Go imports with packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _meta(name: str, kind: str = "string"):
    return F.get_json_object("metadata", f"$.{name}").cast(kind) if kind == "string" else F.from_json(F.get_json_object("metadata", f"$.{name}"), kind)


def css_matches(observations: DataFrame) -> DataFrame:
    """Selectors with the elements they style: of pages that link the stylesheet; the last compound's tag, classes and id must all hold.

    Joined on (page, stylesheet); an id matches only where it is unique in the page. Descendant selectors are marked, not resolved.
    """
    base = F.regexp_extract("path", "^(.*/)", 1)
    linked = observations.where("kind = 'html.asset'").select(F.col("path").alias("page"), F.regexp_replace(F.concat(base, F.regexp_replace("target", r"[?#].*$", "")), r"(^|/)\./", "$1").alias("sheet")).distinct()
    selectors = observations.where("kind = 'css.selector'").select(F.col("path").alias("sheet"), F.col("name").alias("selector"), _meta("tag").alias("tag"), F.coalesce(_meta("classes", "array<string>"), F.array().cast("array<string>")).alias("classes"), _meta("id").alias("id"), F.col("start_line").alias("selector_line"), _meta("depth").cast("int").alias("depth"))
    elements = observations.where("kind = 'html.element'").select(F.col("path").alias("page"), F.col("name").alias("pointer"), _meta("tag").alias("e_tag"), F.coalesce(_meta("classes", "array<string>"), F.array().cast("array<string>")).alias("e_classes"), _meta("id").alias("e_id"))
    ids = elements.where("e_id is not null").groupBy("page", "e_id").agg(F.count(F.lit(1)).alias("same_id"))
    elements = elements.join(ids, ["page", "e_id"], "left")
    both = linked.join(selectors, "sheet").join(elements, "page")
    fits = (F.col("tag").isNull() | (F.col("tag") == F.col("e_tag"))) & (F.size(F.array_except("classes", "e_classes")) == 0) & (F.col("id").isNull() | ((F.col("id") == F.col("e_id")) & (F.col("same_id") == 1)))
    some = F.col("tag").isNotNull() | (F.size("classes") > 0) | F.col("id").isNotNull()
    return both.where(fits & some).select("page", "sheet", "selector", "selector_line", "pointer", F.when(F.col("depth") > 1, "partial").otherwise("exact").alias("match"))


def nix_relations(observations: DataFrame, bindings: DataFrame) -> DataFrame:
    """Nix input references resolved to bindings (alias, binding_id): unsupported, exact, ambiguous, or evaluation_dependent for interpolations."""
    refs = observations.where("kind = 'nix.input_ref'").select("path", "start_line", "target")
    n = bindings.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("binding_id").alias("binding_id"))
    status = F.when(F.col("target").contains("${"), "evaluation_dependent").when(F.col("n").isNull(), "unsupported").when(F.col("n") == 1, "exact").otherwise("ambiguous")
    return refs.join(n, F.col("target") == F.col("alias"), "left").select("path", "start_line", "target", status.alias("status"), F.when(status == "exact", F.col("binding_id")).alias("binding_id"))


def go_imports(observations: DataFrame) -> DataFrame:
    """Go imports with packages of the repository: resolved, collision or unresolved. A package belongs to the deepest module around it."""
    folder = F.regexp_replace(F.regexp_extract("path", "^(.*)/", 1), "^$", ".")
    modules = observations.where("kind = 'go.module'").select(folder.alias("root"), F.col("name").alias("module"))
    packages = observations.where("kind = 'go.package'").select(folder.alias("dir"), F.col("name").alias("package")).distinct()
    above = packages.withColumn("root", F.explode(F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/")))))
    owner = above.join(modules, "root").groupBy("dir", "package").agg(F.max_by(F.struct("root", "module"), F.length("root")).alias("o"))
    path = F.when(F.col("dir") == F.col("o.root"), F.col("o.module")).otherwise(F.concat("o.module", F.lit("/"), F.when(F.col("o.root") == ".", F.col("dir")).otherwise(F.substr("dir", F.length("o.root") + 2))))
    known = owner.where(~F.col("package").endswith("_test")).select(path.alias("import_path"), "dir").groupBy("import_path").agg(F.count(F.lit(1)).alias("n"), F.min("dir").alias("dir"))
    imports = observations.where("kind = 'go.import'").select("path", "start_line", "target")
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("collision")
    return imports.join(known, F.col("target") == F.col("import_path"), "left").select("path", "start_line", "target", status.alias("status"), F.when(F.col("n") == 1, F.col("dir")).alias("package_dir"))


def go_assembly(files: DataFrame, observations: DataFrame) -> DataFrame:
    """Assembly files with the package of their folder: one, or a conflict where the folder has several, or none."""
    folder = F.regexp_extract("path", "^(.*/)?", 0)
    packages = observations.where("kind = 'go.package'").select(folder.alias("dir"), F.col("name").alias("package")).where(~F.col("name").endswith("_test")).groupBy("dir").agg(F.countDistinct("package").alias("n"), F.min("package").alias("package"))
    own = files.where(F.col("path").endswith(".s")).select("path", folder.alias("dir"))
    status = F.when(F.col("n").isNull(), "no_package").when(F.col("n") == 1, "companion").otherwise("conflict")
    return own.join(packages, "dir", "left").select("path", status.alias("status"), F.when(F.col("n") == 1, F.col("package")).alias("package"))
