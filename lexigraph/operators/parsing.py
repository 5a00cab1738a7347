"""Markdown and reStructuredText to sections (heading, depth, content, code blocks).

No built-in expression parses blocks, so this is the engine's one pass of texts through Python; it works on Arrow batches.

Markdown: a document's top-level headings (# and underlined), paragraphs and code blocks count; lists, quotes, tables and
HTML blocks are recognised and left out. Inline code, images and tags contribute nothing, links their text.
reStructuredText: a line over a run of one of UNDERLINES is a heading, whose depth is the character's place; code
directives are code; notes and warnings are text; other directives' first lines go. fix_overlines drops titles' upper lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import SECTIONS

#: Bytes of texts, or so many texts, that are parsed before their sections leave Python.
SLICE, MOST = 1 << 19, 256

#: Heading characters by depth.
UNDERLINES = '=-~^"#*+'

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)[^`]*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_HTML = re.compile(r"^ {0,3}<(?:!--|[?!]|/?(?:address|article|aside|base|blockquote|body|center|col|dd|details|dialog|dir|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$))", re.I)
_HTML_ALONE = re.compile(r"^ {0,3}</?[A-Za-z][^<>]*>\s*$")
_DELIMITER_ROW = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


_TICKS = re.compile("`+")
#: Marks of emphasis: what opens and what closes a stretch.
_MARKS = [(re.compile(rf"(?<!\\){m}(?=\S)"), re.compile(rf"(?<=[^\s\\]){m}")) for m in (r"\*\*", "__", "~~", r"\*")]
_UNDERSCORE = re.compile(r"(?<![\w\\])_(?=\S)"), re.compile(r"(?<=\S)_(?!\w)")


def _without_code(text: str) -> str:
    """Without code spans: from a run of ticks to the next run as long. Each run is looked at once."""
    runs, waiting, partner = [m.span() for m in _TICKS.finditer(text)], {}, {}
    for i in range(len(runs) - 1, -1, -1):
        size = runs[i][1] - runs[i][0]
        partner[i] = waiting.get(size)
        waiting[size] = i
    out, at, i = [], 0, 0
    while i < len(runs):
        if partner[i] is None:
            i += 1
            continue
        out.append(text[at : runs[i][0]])
        at = runs[partner[i]][1]
        i = partner[i] + 1
    return "".join(out) + text[at:]


def _unmarked(text: str, opens: re.Pattern, closes: re.Pattern) -> str:
    """Without pairs of marks. A mark that nothing closes ends the search, for nothing closes those after it either."""
    out, at = [], 0
    while (m := opens.search(text, at)) and (c := closes.search(text, m.end() + 1)):
        out += [text[at : m.start()], text[m.end() : c.start()]]
        at = c.end()
    return "".join(out) + text[at:]


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (i := text.find("<!--", at)) >= 0 and (j := text.find("-->", i + 4)) >= 0:
        out.append(text[at:i])
        at = j + 3
    return "".join(out) + text[at:]


def inline_text(text: str) -> str:
    """Text of a paragraph or heading without marks, code, images and tags."""
    if "`" in text:
        text = _without_code(text)
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)|!\[[^\]]*\]\[[^\]]*\]", "", text)
    text = re.sub(r"\[([^\]]*)\]\((?:[^()]|\([^)]*\))*\)|\[([^\]]+)\]\[[^\]]*\]", lambda m: m[1] or m[2] or "", text)
    text = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", text)
    text = re.sub(r"</?[A-Za-z][^<>]*>", "", _without_comments(text))
    for opens, closes in (*_MARKS, _UNDERSCORE):
        text = _unmarked(text, opens, closes)
    text = re.sub(r"(?: {2,}|\\)\n", "", text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)
    import html

    return html.unescape(text)


class _Sections:
    def __init__(self) -> None:
        self.done: list[dict] = []

    def open(self, heading: str | None, depth: int) -> None:
        self.done.append({"heading": heading, "depth": depth, "content": "", "code_blocks": []})

    def _now(self) -> dict:
        if not self.done:
            self.open(None, 0)
        return self.done[-1]

    def text(self, text: str) -> None:
        s = self._now()
        s["content"] = f"{s['content']}\n\n{text}" if s["content"] else text

    def code(self, language: str | None, value: str) -> None:
        self._now()["code_blocks"].append({"language": language or None, "value": value})


def markdown(text: str) -> list[dict]:
    text = re.sub(r"\A---\n[\s\S]*?\n---\n", "", text.replace("\r\n", "\n"))
    out, lines, i = _Sections(), text.split("\n"), 0
    para: list[str] = []

    def flush() -> None:
        if para:
            out.text(inline_text("\n".join(x.strip() if k else x.lstrip() for k, x in enumerate(para)).rstrip()))
            para.clear()

    while i < len(lines):
        line = lines[i].expandtabs(4)
        if not line.strip():
            flush()
            i += 1
        elif m := _FENCE.match(line):
            flush()
            close, body, indent = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$"), [], len(line) - len(line.lstrip())
            i += 1
            while i < len(lines) and not close.match(lines[i]):
                body.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
                i += 1
            i += 1
            out.code(m[2], "\n".join(body))
        elif m := _ATX.match(line):
            flush()
            out.open(inline_text((m[2] or "").strip().rstrip("#").rstrip() if (m[2] or "").strip("# ") == "" else (m[2] or "").strip()), len(m[1]))
            i += 1
        elif para and re.match(r"^ {0,3}(=+|-+)\s*$", line):
            title = inline_text(" ".join(x.strip() for x in para))
            para.clear()
            out.open(title, 1 if "=" in line else 2)
            i += 1
        elif _RULE.match(line):
            flush()
            i += 1
        elif not para and line.startswith("    "):
            body = []
            while i < len(lines) and (lines[i].expandtabs(4).startswith("    ") or not lines[i].strip()):
                body.append(lines[i].expandtabs(4)[4:])
                i += 1
            out.code(None, "\n".join(body).strip("\n"))
        elif line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4:
            flush()
            while i < len(lines) and lines[i].strip() and not (_FENCE.match(lines[i]) or _ATX.match(lines[i])):
                i += 1
        elif (m := _ITEM.match(line)) and (not para or (m[3].strip(" \t") == "" and line[m.end() :].strip() and (not m[2][0].isdigit() or m[2][:-1] == "1"))):
            flush()
            width = m.end() if line[m.end() :].strip() else len(m[1]) + len(m[2]) + 1
            i += 1
            blank = False
            while i < len(lines):
                now = lines[i].expandtabs(4)
                if not now.strip():
                    blank = True
                elif len(now) - len(now.lstrip()) >= width or _ITEM.match(now):
                    blank = False
                elif blank or _ATX.match(now) or _FENCE.match(now) or _RULE.match(now):
                    break
                i += 1
        elif "|" in line and not para and i + 1 < len(lines) and _DELIMITER_ROW.match(lines[i + 1]) and "-" in lines[i + 1]:
            while i < len(lines) and lines[i].strip():
                i += 1
        elif _HTML.match(line) or (not para and _HTML_ALONE.match(line)):
            flush()
            end = "-->" if line.lstrip().startswith("<!--") else None
            while i < len(lines) and (end or lines[i].strip()):
                i += 1
                if end and end in lines[i - 1]:
                    break
        elif not para and (m := re.match(r"^ {0,3}\[[^\]]+\]:\s*\S+", line)):
            i += 1
        else:
            para.append(line)
            i += 1
    flush()
    return out.done


def clean_roles(text: str) -> str:
    for pattern, group in T.rst_rules():
        text = re.sub(pattern, rf"\{group}", text)
    return text


def _underline(line: str) -> str:
    t = line.strip()
    return t[0] if t and t[0] in UNDERLINES and t == t[0] * len(t) else ""


def _indented(lines: list[str], i: int) -> tuple[list[str], int]:
    """The block from line i on that is indented like its first line; blank lines stay in it."""
    depth = len(lines[i]) - len(lines[i].lstrip()) if i < len(lines) else 0
    body: list[str] = []
    while i < len(lines):
        line = lines[i]
        if line.strip() and len(line) - len(line.lstrip()) < depth:
            break
        body.append(line[depth:] if line.strip() else "")
        i += 1
    return body, i


def rst(text: str, fix_overlines: bool = False) -> list[dict]:
    out, lines, i = _Sections(), text.replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        line = lines[i].strip()
        mark = _underline(lines[i + 1]) if i + 1 < len(lines) else ""
        if fix_overlines and i + 2 < len(lines) and _underline(line) and line == lines[i + 2].strip() and lines[i + 1].strip():
            i += 1
            continue
        if mark:
            out.open(clean_roles(line), UNDERLINES.index(mark) + 1)
            i += 2
        elif m := re.match(r"\.\. (code-block|console|parsed-literal)::(.*)", line):
            language = m[2].strip() if m[1] == "code-block" else "bash" if m[1] == "console" else "text"
            i += 1
            while i < len(lines) and not lines[i].strip():
                i += 1
            body, i = _indented(lines, i)
            out.code(language, "\n".join(body).rstrip())
        elif re.match(r"\.\. (note|admonition|warning)::", line):
            i += 1
            while i < len(lines) and not lines[i].strip():
                i += 1
            body, i = _indented(lines, i)
            if said := "\n".join(body).strip():
                out.text(clean_roles(said))
        elif line and not line.startswith(".."):
            para = [lines[i]]
            i += 1
            while i < len(lines) and (now := lines[i].strip()) and not now.startswith("..") and not (i + 1 < len(lines) and _underline(lines[i + 1])):
                para.append(lines[i])
                i += 1
            if said := " ".join(para).strip():
                out.text(clean_roles(said))
        else:
            i += 1
    return out.done


def _slices(sizes: list[int | None]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbours of about SLICE bytes together, MOST of them at most. A longer text is alone, or the last."""
    at = total = 0
    for i, size in enumerate(sizes, 1):
        total += size or 0
        if total >= SLICE or i - at == MOST or i == len(sizes):
            yield at, i
            at, total = i, 0


def parsed(files: DataFrame, text: str = "text", path: str = "path", fix_overlines: bool = False) -> DataFrame:
    """files with a column sections; the parser follows the path's extension. A pass over Arrow batches; other columns as they are.

    A batch is parsed in slices, so that a worker's objects are those of a slice, however many rows a batch has.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    kind = to_arrow_schema(StructType.fromDDL(f"sections {SECTIONS}")).field(0)
    names = files.columns
    # Texts that are strings already aren't sent twice.
    own = names.count(text) == 1 and isinstance(files.schema[text].dataType, StringType)
    source = names.index(text) if own else len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in _slices(pc.binary_length(batch.column(source)).to_pylist()):
                part = batch.slice(start, end - start)
                texts, parsers = part.column(source).to_pylist(), part.column(len(names)).to_pylist()
                found = [rst(t or "", fix_overlines) if k == "rst" else markdown(t or "") for t, k in zip(texts, parsers, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(found, kind.type)], names=[*names, "sections"])

    given = files.select("*", T.parser_of(F.col(path)).alias("_parser"), *([] if own else [F.col(text).cast("string").alias("_text")]))
    return given.mapInArrow(run, StructType([*files.schema.fields, *StructType.fromDDL(f"sections {SECTIONS}").fields]))
