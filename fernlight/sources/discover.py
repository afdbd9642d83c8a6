"""Finding Markdown files under a root.

The driver walks the tree, since Spark's own listing leaves out names that begin with a dot or an underscore, which are
ordinary folders here. Only paths are listed; executors read the files.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

HARD_EXCLUDES = (".git/**", "node_modules/**", ".fernlight/**")


@lru_cache(maxsize=512)
def glob_pattern(glob: str) -> re.Pattern:
    """A glob over whole posix paths: ** crosses folders, * and ? don't, {a,b} and [..] as usual."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out += "[" + glob[i + 1 : end].replace("!", "^", 1) + "]"
            i = end
        elif c == "{":
            out += "(?:"
            depth += 1
        elif c == "}" and depth:
            out += ")"
            depth -= 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return re.compile(out)


def matches(path: str, globs) -> bool:
    return any(glob_pattern(g).fullmatch(path) for g in globs)


class Ignore:
    """The rules of one .gitignore; the last that matches a path or a folder above it decides."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            rule = line.rstrip()
            if not rule or rule.startswith("#"):
                continue
            keep = rule.startswith("!")
            rule = rule[1:] if keep else rule
            only_folder = rule.endswith("/")
            rule = rule.rstrip("/")
            rooted = "/" in rule
            rule = rule.lstrip("/")
            self.rules.append((glob_pattern(rule if rooted else f"**/{rule}"), only_folder, keep))

    def ignores(self, path: str) -> bool:
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            verdict = False
            for pattern, only_folder, keep in self.rules:
                if (k < len(parts) or not only_folder) and pattern.fullmatch("/".join(parts[:k])):
                    verdict = not keep
            if verdict:
                return True  # nothing below an ignored folder comes back
        return False


def discover(root: str, include, exclude, respect_gitignore: bool = True, follow_symlinks: bool = False) -> list[str]:
    """Relative posix paths, sorted."""
    ignore = None
    if respect_gitignore:
        try:
            with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
                ignore = Ignore(f.read())
        except FileNotFoundError:
            pass
    barred = (*HARD_EXCLUDES, *exclude)
    out = []
    for folder, names, files in os.walk(root, followlinks=follow_symlinks):
        above = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if above == "." else f"{above}/"
        names[:] = [n for n in names if not matches(f"{prefix}{n}/", [g[:-1] if g.endswith("/**") else g for g in barred if g.endswith("/**")]) and not matches(f"{prefix}{n}/x", [g for g in barred if g.endswith("/**")])]
        for name in files:
            path = prefix + name
            if not follow_symlinks and os.path.islink(os.path.join(folder, name)):
                continue
            if matches(path, include) and not matches(path, barred) and not (ignore and ignore.ignores(path)):
                out.append(path)
    return sorted(set(out))
