"""Markdown files as documents, chunks and links.

One pass of Python over each file, in Arrow batches on the executors; the result is one row per file with nested chunks,
links and diagnostics. Front matter is YAML by the core schema of version 1.2: yes, no and dates stay texts.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import posixpath
import re
from collections.abc import Iterator
from datetime import date, datetime, timezone
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
import regex
import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import BLANK

# Fixed values.
CORE_KEYS = ("title", "type", "description", "tags", "timestamp", "updated", "created", "resource")
RESERVED = ("index.md", "log.md")
_WS = f"[{BLANK}]"
_HEADING = re.compile(rf"(#{{1,6}}){_WS}+(.+?){_WS}*")
_FENCE = re.compile(rf"{_WS}*(?:```|~~~)")
_CLOSE = re.compile(r"\n---[ \t]*\n")
_WIKI = re.compile(r"\[\[([^\]]+)\]\]")
_LINK = re.compile(rf"""(?<!!)\[([^\]]+)\]\(([^){BLANK}]+)(?:{_WS}+["'][^"']*["'])?\)""")
_NOTE = re.compile(r"\^\[([^\]\n]+?\.md(?:#[^\]\n]+)?)\]")
_RUNS, _HAN = re.compile(r"[A-Za-z0-9_./+-]+"), regex.compile(r"\p{Han}")


class CoreLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML 1.2's core schema, on libyaml where it is there."""


CoreLoader.yaml_implicit_resolvers = {}
for _tag, _pattern, _starts in (
    ("null", r"~|null|Null|NULL|", "~nN\0"),
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+.0123456789"),
):
    CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(rf"(?:{_pattern})\Z"), list(_starts) if _tag != "null" else ["~", "n", "N", ""])


def _whole(loader: CoreLoader, node: yaml.ScalarNode) -> int:
    text = node.value
    return int(text[2:], 8) if text.startswith("0o") else int(text, 16) if text.startswith("0x") else int(text)


CoreLoader.add_constructor("tag:yaml.org,2002:int", _whole)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def stable_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


_BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(_WS, c))


def trim(text: str) -> str:
    return text.strip(_BLANKS)


def as_bool(value: Any) -> bool | None:
    if isinstance(value, bool):
        return value
    return {"true": True, "false": False}.get(value.strip().lower()) if isinstance(value, str) else None


def scalar(value: Any) -> Any:
    """Texts that read true or false become booleans, dates texts; within lists and objects too."""
    if isinstance(value, str):
        found = as_bool(value)
        return value if found is None else found
    if isinstance(value, (datetime, date)):
        return iso(value)
    if isinstance(value, list):
        return [scalar(v) for v in value]
    if isinstance(value, dict):
        return {str(k): scalar(v) for k, v in value.items()}
    return None if isinstance(value, float) and not math.isfinite(value) else value


def iso(value: Any) -> str | None:
    """ISO 8601 in UTC; texts of another form stay as they are; other values give nothing."""
    if isinstance(value, str):
        text = trim(value)
        if not text:
            return None
        try:
            value = datetime.fromisoformat(text)
        except ValueError:
            return text
    elif isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if not isinstance(value, datetime):
        return None
    value = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)
    return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"


def estimate_tokens(text: str, per_token: float) -> int:
    runs, han, rest = _parts_of(text)
    return max(1, math.ceil(runs + han / per_token + rest / 8))


def anchor_of(heading: str) -> str:
    kept = "".join(c for c in trim(heading).lower() if c.isalpha() or c.isnumeric() or c == "-" or re.match(_WS, c))
    return re.sub(r"\A-|-\Z", "", re.sub("-+", "-", re.sub(rf"{_WS}+", "-", kept)))


def slug_of(path: str) -> str:
    name = posixpath.basename(path)
    stem, dot, _ = name.rpartition(".")
    return stem if dot and stem else name


def humanize(slug: str) -> str:
    flat = trim(re.sub(rf"{_WS}+", " ", re.sub("[-_]+", " ", slug)))
    return flat[:1].upper() + flat[1:]


def tier_of(path: str, boosts: dict[str, float]) -> float:
    found = max((p for p in boosts if path.startswith(p)), key=len, default=None)
    return float(boosts[found]) if found is not None else 1.0


def front_matter(content: str) -> tuple[dict, str, str, list[str]]:
    """Raw values, their hash, the body, and what went wrong."""
    if not content.startswith("---\n"):
        return {}, sha(""), content, []
    close = _CLOSE.search(content, 4)
    if not close:
        return {}, sha(""), content, ["The front matter is opened but not closed."]
    text = content[4 : close.start()]
    try:
        raw = yaml.load(text, CoreLoader)
    except yaml.YAMLError as e:
        return {}, sha(text), content, [str(e)]
    raw = {str(k): v for k, v in raw.items()} if isinstance(raw, dict) else {}
    return raw, sha(stable_json(raw)), content[close.end() :], []


def lines_outside_fences(body: str) -> Iterator[tuple[str, bool]]:
    """Lines, and whether they lie outside fenced code; either fence closes the other."""
    inside = False
    for line in body.split("\n"):
        if _FENCE.match(line):
            inside = not inside
            yield line, False
        else:
            yield line, not inside


def sections(body: str) -> list[tuple[list[str], str, str]]:
    """Heading path, anchor and text of each section. A heading replaces what stands at its level's place in the path."""
    out, path, anchor, held = [], ["Document"], "document", []
    stack: list[str] = []

    def close() -> None:
        text = trim("\n".join(held))
        if text:
            out.append((list(path), anchor, text))
        held.clear()

    for line, plain in lines_outside_fences(body):
        m = _HEADING.fullmatch(line) if plain else None
        if m:
            close()
            title = m[2]
            stack = [*stack[: len(m[1]) - 1], title]
            path, anchor = stack, anchor_of(title)
        held.append(line)
    close()
    return out


def _parts_of(text: str) -> tuple[int, int, int]:
    """What an estimate adds up, runs of ASCII words, Han characters and other UTF-16 units: those of blocks, with the two
    line ends between them, are those of the joined text."""
    if text.isascii():
        return len(_RUNS.findall(text)), 0, len(text)
    han = len(_HAN.findall(text))
    return len(_RUNS.findall(text)), han, len(_HAN.sub("", text).encode("utf-16-le", "surrogatepass")) // 2


def split_large(text: str, target: int, most: int, per_token: float) -> list[str]:
    """A text beyond `most` tokens in parts of whole blocks that hold `target` tokens, unless one block is larger.

    Each block is estimated once; what is held is the sum of its blocks.
    """
    if estimate_tokens(text, per_token) <= most:
        return [text]
    out, held, sums = [], [], (0, 0, 0)
    for block in re.split(r"\n{2,}", text):
        own = _parts_of(block)
        some = bool(held) and (len(held) > 1 or held[0] != "")
        runs, han, rest = (a + b for a, b in zip(sums, own, strict=True)) if some else own
        rest += 2 * some
        if some and max(1, math.ceil(runs + han / per_token + rest / 8)) > target:
            out.append("\n\n".join(held))
            held, sums = [block], own
        else:
            held, sums = [*held, block] if some else [block], (runs, han, rest)
    last = "\n\n".join(held)
    return [*out, last] if trim(last) else out


def split_texts(rows: DataFrame, settings: dict, key: str, text_col: str = "text") -> DataFrame:
    """key (long), part, text and tokens of the parts of each text. A null text has none."""
    schema = pa.schema([(key, pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("tokens", pa.int64())])
    per_token = settings["cjk_char_per_token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [] if text is None else split_large(text, settings["target_tokens"], settings["max_tokens"], per_token)
                out += [(k, i, p, estimate_tokens(p, per_token)) for i, p in enumerate(parts)]
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(schema.names)}, schema=schema)

    return rows.select(key, text_col).mapInArrow(run, f"{key} long, part int, text string, tokens long")


def _decoded(target: str, problems: list[str]) -> str:
    try:
        return unquote(target, errors="strict") if not re.search(r"%(?![0-9A-Fa-f]{2})", target) else _bad(target, problems)
    except UnicodeDecodeError:
        return _bad(target, problems)


def _bad(target: str, problems: list[str]) -> str:
    problems.append(f"A link's target can't be decoded: {target}")
    return target


def _from(path: str, target: str) -> str:
    if target.startswith("/"):
        return re.sub(r"\A\./", "", target[1:])
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), target))


def links(body: str, path: str, problems: list[str]) -> list[dict]:
    out: list[dict] = []

    def add(kind: str, raw: str, target: str, anchor: str | None, alias: str | None) -> None:
        out.append({"ordinal": len(out), "kind": kind, "raw_target": raw, "normalized_target": target, "anchor": anchor or None, "alias": alias or None})

    for line, plain in lines_outside_fences(body):
        if not plain:
            continue
        for m in _WIKI.finditer(line):
            left, *alias = m[1].split("|")
            target, *anchor = left.split("#")
            add("wikilink", m[1], trim(target), trim(anchor[0]) if anchor else None, trim(alias[0]) if alias else None)
        for m in _LINK.finditer(line):
            if re.match("https?://", m[2], re.I):
                add("external", m[2], m[2], None, m[1])
                continue
            target, *anchor = m[2].split("#")
            if target.endswith(".md"):
                kind = "mdlink_absolute" if target.startswith("/") else "mdlink_relative"
                add(kind, m[2], _from(path, _decoded(target, problems)), anchor[0] if anchor else None, m[1])
        for m in _NOTE.finditer(line):
            raw = trim(m[1])
            target, *anchor = raw.split("#")
            target = _decoded(target, problems)
            rooted = target.startswith("/") or re.match("[A-Za-z0-9_-]+/", target)
            add("footnote_source", raw, target.removeprefix("/") if rooted else _from(path, target), anchor[0] if anchor else None, None)
    return out


def parse(path: str, data: bytes | None, size: int, mtime: float, settings: dict) -> dict:
    """One document. data is None where the file is larger than the settings allow."""
    slug, doc_id = slug_of(path), sha(path)
    out = {
        "doc_id": doc_id, "path": path, "slug": slug, "concept_id": re.sub(r"(?i)\.md\Z", "", path), "title": humanize(slug), "type": None, "description": None, "tags": [], "created_ts": None,
        "updated_ts": None, "facets": "{}", "frontmatter_raw": "{}", "content_hash": sha(""), "frontmatter_hash": sha(""), "size_bytes": size, "file_mtime": mtime, "tier": 1.0,
        "reserved": posixpath.basename(path) in RESERVED, "excluded": True, "chunks": [], "links": [], "diagnostics": [],
    }
    note = lambda kind, text: out["diagnostics"].append({"kind": kind, "message": text})
    if data is None:
        note("file_too_large", f"{size} bytes are more than discovery.max_file_bytes.")
        return out
    if b"\0" in data:
        note("binary_file", "The file has NUL bytes.")
        return out
    content = data.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    raw, front_hash, body, problems = front_matter(content)
    for p in problems:
        note("frontmatter_parse_error", p)
    tags = raw.get("tags")
    tags = tags if isinstance(tags, list) else [] if tags is None else [tags]
    tags = list(dict.fromkeys(t for t in (trim(_text(t)) for t in tags) if t))
    created, updated = (iso(raw[k] if raw.get(k) is not None else raw.get("timestamp")) for k in ("created", "updated"))
    if (raw.get("created") or raw.get("timestamp")) and not created:
        note("frontmatter_normalization_warning", "created or timestamp is no time.")
    body = re.sub(r"<!--.*?-->", "", body, flags=re.S)
    own = {k: raw[k] if isinstance(raw.get(k), str) else None for k in ("title", "type", "description")}
    first = next((m[2] for m in map(_HEADING.fullmatch, body.split("\n")) if m and len(m[1]) == 1), None)
    title = trim(own["title"] or "") or first or humanize(slug)
    undecodable: list[str] = []
    found = links(body, path, undecodable)
    for p in undecodable:
        note("link_decode_error", p)
    per_token, target, most = settings["cjk_char_per_token"], settings["target_tokens"], settings["max_tokens"]
    chunks: list[dict] = []

    def add(heading: list[str], anchor: str, text: str, flags: list[str]) -> None:
        if not trim(text):
            return
        n, h = estimate_tokens(text, per_token), sha(text)
        seq = len(chunks)
        chunks.append({"chunk_uid": sha(f"{doc_id}:{anchor}:{seq}:{h}"), "seq": seq, "heading_path": heading, "anchor": anchor, "body": text, "token_est": n, "content_hash": h, "flags": flags + ["oversize"] * (n > most)})

    add(["Document Summary"], "summary", " ".join(x for x in (title, own["description"], *tags) if x), ["summary"])
    for heading, anchor, text in sections(body):
        for part in split_large(text, target, most, per_token):
            add(heading, anchor, part, [])
    return out | {
        **own, "title": title, "tags": tags, "created_ts": created, "updated_ts": updated, "facets": stable_json({k: scalar(v) for k, v in raw.items() if k not in CORE_KEYS}), "frontmatter_raw": stable_json(raw),
        "content_hash": sha(content), "frontmatter_hash": front_hash, "tier": tier_of(path, settings["tier_boost"]), "excluded": any(as_bool(raw.get(k)) for k in settings["exclude_flags"]), "chunks": chunks, "links": found,
    }


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else "null" if value is None else str(value)


CHUNK = "chunk_uid string, seq int, heading_path array<string>, anchor string, body string, token_est long, content_hash string, flags array<string>"
LINK = "ordinal int, kind string, raw_target string, normalized_target string, anchor string, alias string"
DOCUMENT = "doc_id string, path string, slug string, concept_id string, title string, type string, description string, tags array<string>, created_ts string, updated_ts string, facets string, frontmatter_raw string, content_hash string, frontmatter_hash string, size_bytes long, file_mtime double, tier double, reserved boolean"


def _struct(ddl: str) -> str:
    return "array<struct<" + re.sub(r"(\w+) (\w[\w<>]*)", r"\1: \2", ddl) + ">>"


PARSED = f"{DOCUMENT}, excluded boolean, chunks {_struct(CHUNK)}, links {_struct(LINK)}, diagnostics array<struct<kind: string, message: string>>"


def read(spark: SparkSession, root: str, paths: list[str], settings: dict, max_bytes: int) -> DataFrame:
    """Parsed documents of files under a root that the executors can read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for path in batch.column(0).slice(at, 64).to_pylist():
                    full = os.path.join(root, path)
                    stat = os.stat(full)
                    data = None
                    if stat.st_size <= max_bytes:
                        with open(full, "rb") as f:
                            data = f.read()
                    rows.append(parse(path, data, stat.st_size, stat.st_mtime * 1000, settings))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, min(len(paths) // 32 + 1, 8 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(n).mapInArrow(run, PARSED)


def parse_texts(rows: DataFrame, settings: dict, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Parsed documents of texts that are already in a table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pairs = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                yield pa.RecordBatch.from_pylist([parse(p, (t or "").encode(), len((t or "").encode()), 0.0, settings) for p, t in pairs], schema=schema)

    return rows.select(path_col, text_col).mapInArrow(run, PARSED)
