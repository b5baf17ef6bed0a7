"""Workspaces: several roots, lint scope from git, forms, configuration roots and settings, the noted commit."""

import json
import subprocess

from codeprism.operators import reporting
from codeprism.sources import files


def write(path, text=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def git(folder, *args):
    subprocess.run(["git", "-c", "user.email=a@b.c", "-c", "user.name=n", *args], cwd=folder, check=True, capture_output=True)


def test_several_roots(spark, tmp_path):
    write(tmp_path / "a/x.bsl", "X")
    write(tmp_path / "a/sub/y.os", "Y")
    one = write(tmp_path / "b/z.bsl", "Z")
    got = files.read_modules(spark, [str(tmp_path / "a"), str(tmp_path / "a/sub"), str(one)])
    assert sorted(r["text"] for r in got.collect()) == ["X", "Y", "Z"]


def test_scope_from_git(spark, tmp_path):
    assert files.lint_scope(str(tmp_path)) == []
    git(tmp_path, "init", "-q")
    for n in ("a", "b", "c"):
        write(tmp_path / f"{n}.bsl", n)
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "one")
    write(tmp_path / "b.bsl", "new")
    (tmp_path / "c.bsl").unlink()
    git(tmp_path, "commit", "-qam", "two")
    write(tmp_path / "a.bsl", "changed")
    write(tmp_path / "имя.os", "untracked")
    names = lambda paths: [p.rsplit("/", 1)[1] for p in paths]
    assert names(files.git_changes(str(tmp_path), "HEAD~1")) == ["b.bsl"]
    assert names(files.lint_scope(str(tmp_path))) == ["a.bsl", "имя.os"] and names(files.lint_scope(str(tmp_path), "HEAD~1")) == ["b.bsl"]
    assert [r["text"] for r in files.changed_modules(spark, str(tmp_path), "HEAD~1").collect()] == ["new"]
    assert files.changed_modules(spark, str(tmp_path), "HEAD").count() == 0 and files.changed_modules(spark, str(tmp_path), "no-such-ref").count() == 3


def test_noted_commit(spark, tmp_path):
    place = files.index_folder("/work/space", str(tmp_path))
    assert place == files.index_folder("/work/space/", str(tmp_path)) != files.index_folder("/other/space", str(tmp_path))
    assert files.last_commit(spark, place) is None
    files.save_commit(spark, place, "abc")
    files.save_commit(spark, place, "def")
    assert files.last_commit(spark, place) == "def"


def test_forms(spark, tmp_path):
    write(tmp_path / "Catalogs/Goods/Forms/Item/Ext/Form.xml", '<Form xmlns="u" xmlns:v8="w"><Attributes><Attribute name="Object" id="1"><Type><v8:Type>x</v8:Type></Type></Attribute><Attribute id="2" name=" List "/><Attribute name=""/></Attributes><Commands><Command name="Save"/></Commands></Form>')
    write(tmp_path / "Other/Goods/Forms/Item/Ext/Form.xml", '<Form><Attributes><Attribute name="No"/></Attributes></Form>')
    write(tmp_path / "DocumentJournals/J/Forms/F/Ext/Form.xml", "not xml")
    got = sorted(map(tuple, files.read_forms(spark, str(tmp_path)).collect()))
    assert got == [("Goods", "Catalog", "Item", "form_attribute", "List"), ("Goods", "Catalog", "Item", "form_attribute", "Object"), ("Goods", "Catalog", "Item", "form_command", "Save")]


def test_roots_and_settings(spark, tmp_path):
    write(tmp_path / "deep/er/cf/Configuration.xml", "<Configuration/>")
    write(tmp_path / "b/Configuration.xml", "<Configuration/>")
    assert files.config_root(spark, str(tmp_path)) == str(tmp_path / "b") and files.config_root(spark, str(tmp_path / "deep"), depth=1) is None
    assert files.config_root(spark, str(tmp_path), "Configuration.mdo") is None
    write(tmp_path / "pyproject.toml", "[tool.codeprism]\nselect = ['A']\n")
    write(tmp_path / "b/codeprism.toml", "broken = [")
    assert files.read_config(str(tmp_path / "b")) == {"select": ["A"]}
    write(tmp_path / "b/pyproject.toml", "[tool.other]\nx = 1\n")
    write(tmp_path / "b/codeprism.toml", "[codeprism]\nignore = ['B']\n")
    assert files.read_config(str(tmp_path / "b/c")) == {"ignore": ["B"]}


def test_messages_and_arrays(spark, tmp_path):
    found = spark.createDataFrame([("a", 2, "BSL007", "Variable 'x' is never read"), ("a", 1, "BSL120", "Trailing blanks"), ("a", 3, "BSL001", "odd"), ("a", 4, "BSL007", "other")], "file_path string, line int, code string, message string")
    messages = spark.createDataFrame([("BSL007", "'([^']*)'", "Переменная {0} не читается"), ("BSL120", None, "Пробелы в конце")], "code string, pattern string, template string")
    got = {r["line"]: r["message_local"] for r in reporting.localised(found, messages).collect()}
    assert got == {1: "Пробелы в конце", 2: "Переменная x не читается", 3: "odd", 4: "other"}
    array = json.loads(reporting.json_array(found).first()["document"])
    assert [d["line"] for d in array] == [1, 2, 3, 4] and array[0]["file_path"] == "a"
    texts = spark.createDataFrame([("a", "x", True), ("b", "y", False)], "path string, text string, changed boolean")
    reporting.write_changed(texts, str(tmp_path / "out"))
    assert [r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
