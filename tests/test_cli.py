import json

from test_sources import CORE, PAGE

from styleloom.cli import main


def test_project(spark, tmp_path, capsys):
    web = tmp_path / "lib" / "my_web"
    web.mkdir(parents=True)
    (web / "core.ex").write_text(CORE)
    (web / "page.ex").write_text(PAGE)
    css = tmp_path / "app.css"
    text = '@import "./more.css";\n.page .btn { color: red }\n.gone, .small { color: red }\n.page .big + .small { }\n@keyframes never { from { top: 0 } }\n'
    css.write_text(text)
    (tmp_path / "more.css").write_text(".lost { }\n.from-script { }")
    (tmp_path / "js").mkdir()
    (tmp_path / "js" / "a.js").write_text("el.classList.add('from-script')")
    root = ["--root", str(tmp_path)]
    assert main([*root, "coverage", "--css", "app.css"]) == 1
    assert main([*root, "graph"]) == 0
    assert main([*root, "coverage", "--css", "app.css", "--js", "js", "--list-unmatched", "--invalidate-unmatched"]) == 0
    report = json.loads((tmp_path / "coverage.json").read_text())
    assert {r["selector"] for r in report["matched_selectors"]} == {".page .btn", ".small", ".page .big + .small"}
    assert {(r["selector"], r["file"]) for r in report["unmatched_selectors"]} == {(".gone", "app.css"), (".lost", "more.css")}
    assert [r["selector"] for r in report["runtime_matched_selectors"]] == [".from-script"]
    assert [r["name"] for r in report["unused_keyframes"]] == ["never"]
    marked = css.read_text()
    assert ".____unmatched___ .gone" in marked and "@keyframes ____unmatched___never" in marked
    assert main([*root, "coverage", "--css", "app.css", "--restore-unmatched"]) == 0
    assert css.read_text().replace(" .gone", ".gone") == text
    assert "app.css:3 .gone" in capsys.readouterr().out
