"""The parser's rules, discovery, settings and the command line."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

from fernlight.plans import config as settings
from fernlight.sources import markdown as M
from fernlight.sources.discover import Ignore, discover
from fernlight.sources.embeddings import CUT_MARK, batches, cut

SETTINGS = {"cjk_char_per_token": 1.6, "target_tokens": 10, "max_tokens": 20, "tier_boost": {"concepts/": 1.3, "concepts/deep/": 1.7}, "exclude_flags": ["hide"]}


def parse(text, path="concepts/sample.md"):
    data = text if isinstance(text, bytes) else text.encode()
    return M.parse(path, data, len(data), 0.0, SETTINGS)


def test_sample():
    d = parse("---\ntitle: Sample\ntype: note\ntags: solo\nsafe: 'true'\nwhen: 2024-01-02\nanswer: yes\n---\n# Sample\nSee [[a/b#part|name]] and ^[raw/x.md#y].\n```\n[[no]]\n```\n")
    assert d["tags"] == ["solo"] and json.loads(d["facets"]) == {"safe": True, "when": "2024-01-02", "answer": "yes"}
    assert [(x["kind"], x["normalized_target"], x["anchor"], x["alias"]) for x in d["links"]] == [("wikilink", "a/b", "part", "name"), ("footnote_source", "raw/x.md", "y", None)]
    assert d["tier"] == 1.3 and not d["excluded"] and d["chunks"][0]["flags"] == ["summary"] and d["chunks"][0]["body"] == "Sample solo"


@pytest.mark.parametrize(
    ("text", "body", "errors"),
    [("---\n---\nx", "---\n---\nx", 1), ("---\na: 1\n---", "---\na: 1\n---", 1), ("---\na: [\n---\nx\n", "---\na: [\n---\nx\n", 1), ("---\n- 1\n---\nx\n", "x\n", 0), ("x", "x", 0), ("---\na: 1\n--- \nx\n", "x\n", 0)],
)
def test_front_matter(text, body, errors):
    _, _, got, problems = M.front_matter(text)
    assert got == body and len(problems) == errors


def test_titles_exclusion_and_guards():
    assert parse("```\n# Inside\n```\n")["title"] == "Inside"
    assert parse("words", "a/my-page_x.md")["title"] == "My page x"
    assert parse("---\nhide: 'TRUE'\n---\nx\n")["excluded"]
    assert parse(b"a\0b")["excluded"] and M.parse("a.md", None, 9, 0.0, SETTINGS)["diagnostics"][0]["kind"] == "file_too_large"
    assert parse("\ufeff# T\r\nx\ry")["content_hash"] == M.sha("# T\nx\ny")
    assert M.iso("2024-01-02T03:04:05+02:00") == "2024-01-02T01:04:05.000Z" and M.iso("soon") == "soon" and M.iso(5) is None
    assert M.tier_of("concepts/deep/x.md", SETTINGS["tier_boost"]) == 1.7


def test_sections():
    got = [(p, a) for p, a, _ in M.sections("pre\n# A\n### B\nx\n### C\n~~~\n# no\n```\n## D ##x\n")]
    assert got == [(["Document"], "document"), (["A"], "a"), (["A", "B"], "b"), (["A", "B", "C"], "c"), (["A", "D ##x"], "d-x")]
    blocks = "\n\n".join(f"block {i} of words here" for i in range(8))
    parts = M.split_large(blocks, 10, 20, 1.6)
    assert len(parts) > 1 and "\n\n".join(parts) == blocks
    assert M.split_large("w " * 100, 10, 20, 1.6) == ["w " * 100]
    assert "oversize" in parse("# H\n" + "w " * 100)["chunks"][1]["flags"]


def test_links():
    problems: list[str] = []
    got = M.links('![i](x.md) [a](y%20z.md) [b](/r/q.md#s) [c](../up.md "t") [d](z.MD) [e](HTTPS://x.y) [f](bad%zz.md) [[#only]] ![[emb]] [[a|b|c]]', "p/q/r.md", problems)
    assert [(x["kind"], x["normalized_target"]) for x in got] == [
        ("wikilink", ""), ("wikilink", "emb"), ("wikilink", "a"), ("mdlink_relative", "p/q/y z.md"), ("mdlink_absolute", "r/q.md"), ("mdlink_relative", "p/up.md"), ("external", "HTTPS://x.y"), ("mdlink_relative", "p/q/bad%zz.md"),
    ]
    assert len(problems) == 1 and got[2]["alias"] == "b"


def test_discovery(tmp_path):
    for p in ("a.md", "_meta/m.md", ".hid/h.md", "node_modules/x.md", "tmp/t.md", "sub/ignored.md", "sub/kept.md", "b.txt", "deep/er/c.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".gitignore").write_text("sub/*\n!sub/kept.md\n# note\n")
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    assert discover(str(tmp_path), ["**/*.md"], ["tmp/**"]) == [".hid/h.md", "_meta/m.md", "a.md", "deep/er/c.md", "sub/kept.md"]
    assert "link.md" in discover(str(tmp_path), ["*.md"], [], follow_symlinks=True)
    assert Ignore("build/\n").ignores("x/build/y.md") and not Ignore("build/\n").ignores("x/build")


def test_settings(tmp_path):
    (tmp_path / "fernlight.toml").write_text('[search]\nrank_fusion = "weighted_rrf"\nrrf_k = 20\n[search.rrf_weights]\nkeyword = 0.5\nvector = 2.0\n[search.tier_boost]\n"new/" = 2.0\n')
    env = {"FERNLIGHT_SEARCH__MODE": "keyword", "FERNLIGHT_NO__SUCH": "x", "FERNLIGHT_DISCOVERY__INCLUDE": "a/*.md, b/*.md"}
    c = settings.load(str(tmp_path), overrides={"storage.url": "jdbc:x://me:pw@host/db", "embedding.model": ""}, env=env)
    assert (c["search.rrf_k"], c["search.rrf_weights.vector"], c["search.mode"], c["discovery.include"]) == (20, 2.0, "keyword", ["a/*.md", "b/*.md"])
    assert c.sources["search.rrf_k"] == "toml" and c.sources["search.mode"] == "env:FERNLIGHT_SEARCH__MODE" and c.sources["storage.url"] == "flag" and c.sources["embedding.model"] == "default"
    assert c["search.tier_boost"]["new/"] == 2.0 and c["search.tier_boost"]["raw/"] == 0.5
    assert "pw" not in json.dumps(settings.display(c)) and "pw" in c["storage.url"]
    for bad in ({"search.mode": "x"}, {"chunking.max_tokens": 1}, {"search.rrf_k": -1}, {"storage.backend": "jdbc"}):
        with pytest.raises(settings.ConfigError):
            settings.load(str(tmp_path / "none"), overrides=bad, env={})
    with pytest.raises(settings.ConfigError):
        settings.load(str(tmp_path), "missing.toml", env={})
    written = settings.write_initial(str(tmp_path), "init.toml", {"search.mode": "vector"})
    assert settings.load(str(tmp_path), "init.toml", env={})["search.mode"] == "vector" and written.endswith("init.toml")


def test_batches():
    rows = [{"chunk_uid": str(i), "body": "w" * 10, "token_est": t} for i, t in enumerate((5, 5, 50, 3))]
    assert [[r["chunk_uid"] for r in b] for b in batches(rows, 2, 20, 100)] == [["0", "1"], ["2"], ["3"]]
    short = cut("w" * 5000, 100, 50)
    assert short.endswith(CUT_MARK) and len(short) < 3000 and cut("w", 1, 5) == "w"


def test_command_line(tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", "fernlight", *a], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert run("search", "x", "-k", "1abc").returncode == 3 and run("search", "x", "-k", "0").returncode == 3
    assert run("--config", "none.toml", "config", "show").returncode == 2
    assert json.loads(run("init").stdout)["config_path"].endswith("fernlight.toml")
    assert json.loads(run("config", "show").stdout)["config"]["search"]["rrf_k"] == 60
