"""Modules, lines and configuration metadata from files; change sets from git or from two snapshots."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
import subprocess
import tomllib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

#: Folder of a configuration and the kind of the objects in it (fixed values of the platform).
COLLECTIONS = {
    "Catalogs": "Catalog", "Documents": "Document", "Enums": "Enum", "Constants": "Constant", "Reports": "Report", "DataProcessors": "DataProcessor",
    "InformationRegisters": "InformationRegister", "AccumulationRegisters": "AccumulationRegister", "AccountingRegisters": "AccountingRegister",
    "ChartsOfAccounts": "ChartOfAccounts", "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes", "BusinessProcesses": "BusinessProcess", "Tasks": "Task",
    "ExchangePlans": "ExchangePlan", "CommonModules": "CommonModule", "Roles": "Role", "Subsystems": "Subsystem", "WebServices": "WebService", "HTTPServices": "HTTPService",
    "DocumentJournals": "DocumentJournal", "ChartsOfCalculationTypes": "ChartOfCalculationTypes", "CalculationRegisters": "CalculationRegister", "ExternalDataSources": "ExternalDataSource", "SessionParameters": "SessionParameter",
    "FilterCriteria": "FilterCriterion", "ScheduledJobs": "ScheduledJob", "FunctionalOptions": "FunctionalOption", "FunctionalOptionsParameters": "FunctionalOptionsParameter", "SettingsStorages": "SettingsStorage",
    "EventSubscriptions": "EventSubscription", "CommandGroups": "CommandGroup", "Interfaces": "Interface", "Styles": "Style", "WSReferences": "WSReference", "IntegrationServices": "IntegrationService", "Sequences": "Sequence",
    "DefinedTypes": "DefinedType", "CommonForms": "CommonForm", "CommonTemplates": "CommonTemplate", "CommonPictures": "CommonPicture",
}


def read_modules(spark: SparkSession, root: str | Sequence[str], excludes: Sequence[str] = ()) -> DataFrame:
    """path, text, n_bytes of every ``.bsl`` or ``.os`` file (any case) below ``root`` (one or several; files count too), without excluded ones.

    Roots that overlap give a file once.

    Bytes are decoded as UTF-8 with replacement; a leading byte-order mark goes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root if isinstance(root, str) else list(root))
    if not isinstance(root, str):
        files = files.dropDuplicates(["path"])
    kept = files.where(F.lower("path").rlike(r"\.(bsl|os)$"))
    if excludes:
        kept = kept.where(~is_excluded(F.col("path"), excludes))
    text = F.regexp_replace(F.expr("try_validate_utf8(cast(content AS string))"), "^\ufeff", "")
    lossy = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    return kept.select("path", F.coalesce(text, lossy).alias("text"), F.col("length").alias("n_bytes"))


def is_excluded(path: Column, globs: Sequence[str]) -> Column:
    """Whether a glob fits the whole path or any of its components."""
    tests = [F.lit(False)]
    for glob in globs:
        pattern = fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")
        tests += [path.rlike(f"^{pattern}"), _any_part(path, f"^{pattern}")]
    return F.array_contains(F.array(*tests), True)


def _any_part(path: Column, pattern: str) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.rlike(pattern))


def lines_of(modules: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line (from 1), text: one row per line; CRLF and CR end lines too, a final newline adds none."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n$", "")
    return modules.select(path, F.posexplode(F.split(plain, "\n", -1)).alias("at", "text")).select(path, (F.col("at") + 1).alias("line"), "text")


def line_range(lines: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """path and the text of lines ``first`` to ``last`` of one module, clamped."""
    some = lines.where((F.col("path") == path) & F.col("line").between(max(1, first), last))
    return some.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def _git(root: str, timeout: int, *args: str) -> list[str] | None:
    try:
        done = subprocess.run(["git", "-c", "core.quotePath=false", *args], cwd=root, capture_output=True, text=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.splitlines()


def _modules_of(names: Sequence[str], top: str, suffixes: Sequence[str]) -> list[str]:
    paths = [os.path.join(top, n) for n in dict.fromkeys(names) if n.lower().endswith(tuple(suffixes))]
    return [p for p in paths if os.path.isfile(p)]


def git_changes(root: str, since: str, suffixes: Sequence[str] = (".bsl", ".os"), timeout: int = 30) -> list[str] | None:
    """Files that differ between ``since`` and HEAD and still exist, each once, in order; None (take all files) if git can't tell."""
    names = _git(root, timeout, "diff", "--name-only", since, "HEAD")
    top = _git(root, timeout, "rev-parse", "--show-toplevel")
    return None if names is None or not top else _modules_of(names, top[0], suffixes)


def lint_scope(root: str, since: str | None = None, suffixes: Sequence[str] = (".bsl", ".os"), timeout: int = 30) -> list[str]:
    """Files that were added, copied or modified since ``since`` (none: since HEAD, untracked ones too); empty outside a repository."""
    top = _git(root, timeout, "rev-parse", "--show-toplevel")
    if not top:
        return []
    names = _git(top[0], timeout, "diff", "--name-only", "--diff-filter=ACM", *([since, "HEAD"] if since else ["HEAD"])) or []
    if since is None:
        names += _git(top[0], timeout, "ls-files", "--others", "--exclude-standard") or []
    return _modules_of(names, top[0], suffixes)


def changed_modules(spark: SparkSession, root: str, since: str, excludes: Sequence[str] = ()) -> DataFrame:
    """The modules that changed since ``since``; all below ``root`` where git can't tell."""
    changed = git_changes(root, since)
    if changed is None:
        return read_modules(spark, root, excludes)
    return read_modules(spark, changed, excludes) if changed else read_modules(spark, root, excludes).limit(0)


def save_commit(spark: SparkSession, index: str, commit: str) -> None:
    """Note the commit that an index was built from: a table of one row beside it."""
    spark.createDataFrame([(commit,)], "commit string").coalesce(1).write.mode("overwrite").parquet(f"{index}/last_commit")


def last_commit(spark: SparkSession, index: str) -> str | None:
    try:
        row = spark.read.schema("commit string").parquet(f"{index}/last_commit").first()
    except AnalysisException:
        return None
    return row["commit"] if row else None


def index_folder(workspace: str, home: str) -> str:
    """Where the index of a workspace lies below ``home``: its last name, and a digest of its whole path."""
    path = os.path.abspath(workspace)
    return f"{home}/{os.path.basename(path)}-{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def read_config(folder: str, tool: str = "codeprism") -> dict:
    """Settings of the nearest ``<tool>.toml``, or ``pyproject.toml`` with a section for it, at or above ``folder``.

    In one folder the tool's own file wins; files that do not parse are passed over.
    """
    at = os.path.abspath(folder)
    while True:
        for name, pick in ((f"{tool}.toml", lambda d: d.get(tool, d)), ("pyproject.toml", lambda d: d.get("tool", {}).get(tool))):
            try:
                with open(os.path.join(at, name), "rb") as f:
                    found = pick(tomllib.load(f))
            except (OSError, tomllib.TOMLDecodeError):
                continue
            if found is not None:
                return found
        if os.path.dirname(at) == at:
            return {}
        at = os.path.dirname(at)


def config_root(spark: SparkSession, root: str, marker: str = "Configuration.xml", depth: int = 12) -> str | None:
    """The folder nearest to ``root`` that holds ``marker``, at most ``depth`` levels below; the first by name among equals."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(root).select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"))
    levels = F.size(F.split("folder", "/"))
    base = len(os.path.abspath(root).split("/"))
    near = found.withColumn("n", levels).orderBy("n", "folder").first()
    if near is None:
        return None
    path = re.sub(r"^file:/+", "/", near["folder"])
    return path if len(path.split("/")) - base <= depth else None


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (added, changed, removed) between two snapshots of path, text."""
    sides = [d.select("path", F.xxhash64("text").alias(h)) for d, h in ((old, "a"), (new, "b"))]
    both = sides[0].join(sides[1], "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where(F.col("change").isNotNull())


def read_metadata(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Objects (name, kind, synonym_ru, file_path) and members (object, kind, name) of a configuration's XML files.

    Namespaces are cut from the tags before XPath; folders name the kind.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(root)
    kinds = F.create_map(*[F.lit(x) for kv in COLLECTIONS.items() for x in kv])
    folder = F.regexp_extract("path", r"/([^/]+)/[^/]+\.xml$", 1)
    xml = F.regexp_replace(F.regexp_replace(F.col("content").cast("string"), r"(</?)[A-Za-z0-9_]+:", "$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"|\s\w+:\w+=\"[^\"]*\"", "")
    objects = files.where(F.col("path").isNotNull()).select("path", F.element_at(kinds, folder).alias("kind"), xml.alias("xml")).where(F.col("kind").isNotNull())
    named = objects.select(F.expr("xpath_string(xml, '//Properties/Name')").alias("name"), "kind", F.expr("xpath_string(xml, \"//Synonym/item[lang='ru']/content\")").alias("synonym_ru"), F.col("path").alias("file_path"))
    parts = {"attribute": "//ChildObjects/Attribute/Properties/Name/text()", "tabular_section": "//ChildObjects/TabularSection/Properties/Name/text()", "form_attribute": "//Attributes/Attribute/@name", "form_command": "//Commands/Command/@name"}
    members = None
    for kind, query in parts.items():
        one = objects.select(F.expr("xpath_string(xml, '//Properties/Name')").alias("object"), F.lit(kind).alias("kind"), F.explode(F.expr(f"xpath(xml, '{query}')")).alias("name"))
        members = one if members is None else members.unionByName(one)
    return named, members


def read_forms(spark: SparkSession, root: str) -> DataFrame:
    """object, object_kind, form, kind (form_attribute, form_command) and name of what the form files of a configuration declare.

    A form lies in ``<folder of a kind>/<object>/Forms/<form>/Ext/Form.xml``; one that does not parse declares nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Form.xml").load(root)
    place = r"/([^/]+)/([^/]+)/Forms/([^/]+)/Ext/Form\.xml$"
    kinds = F.create_map(*[F.lit(x) for kv in COLLECTIONS.items() for x in kv])
    text = F.coalesce(F.expr("try_validate_utf8(cast(content AS string))"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, r"(</?)[A-Za-z0-9_]+:", "$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"|\s\w+:\w+=\"[^\"]*\"", "")
    part = lambda tag: F.regexp_extract(bare, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    told = files.select(F.regexp_extract("path", place, 2).alias("object"), F.try_element_at(kinds, F.regexp_extract("path", place, 1)).alias("object_kind"), F.regexp_extract("path", place, 3).alias("form"), part("Attributes").alias("a"), part("Commands").alias("c")).where(F.col("object_kind").isNotNull())
    names = lambda column, tag: F.regexp_extract_all(column, F.lit(rf"<{tag}\s[^>]*?\bname=\"([^\"]*)\""), F.lit(1))
    each = lambda a, kind: F.transform(a, lambda n: F.struct(F.lit(kind).alias("kind"), F.btrim(n).alias("name")))
    rows = told.select("object", "object_kind", "form", F.inline(F.concat(each(names("a", "Attribute"), "form_attribute"), each(names("c", "Command"), "form_command"))))
    return rows.where("name <> ''")
