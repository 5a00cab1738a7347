"""Text expressions: tokenizer profiles, identifiers, labels, inline cleanup. All are Catalyst expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_TOKEN = r"[^\p{L}\p{N}]+"


@functools.cache
def fold_map() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    pairs = [(chr(c), d[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), *fold_map())


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased, without diacritics: the plain profile."""
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), NOT_TOKEN), lambda t: t != "")


def token_count(content: Column) -> Column:
    """Estimate of model tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(content) / 4).cast("int")


def reputation(score: Column) -> Column:
    return F.when(score.isNull() | (score < 0), "Unknown").when(score >= 7, "High").when(score >= 4, "Medium").otherwise("Low")


def library_id(url: Column) -> Column:
    """'/org/repo' of a GitHub address, https or ssh; other addresses raise."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^git@github\.com:", "https://github.com/"), r"/+$", ""), r"\.git$", "")
    found = F.regexp_extract(clean, r"github\.com/([^/]+/[^/]+)", 1)
    return F.when(found != "", F.concat(F.lit("/"), found)).otherwise(F.raise_error(F.concat(F.lit("Invalid GitHub URL: "), url)))


def source_url(library: Column, path: Column, version: Column | None = None) -> Column:
    v = F.lit("main") if version is None else F.when(version == "latest", "main").otherwise(version)
    return F.concat(F.lit("https://github.com"), library, F.lit("/blob/"), v, F.lit("/"), F.regexp_replace(path, "^/", ""))


def posix_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def parser_of(path: Column) -> Column:
    """Which parser reads a file: .rst and .txt are reStructuredText, everything else Markdown."""
    return F.when(extension(path).isin(".rst", ".txt"), "rst").otherwise("markdown")


def is_glob(path: Column) -> Column:
    return path.rlike(r"[*?\[\]{}!]")


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"\A---\n(?s:.*?)\n---\n", "")


#: Roles of reStructuredText whose text stays; "<target>" goes where a role may have one.
_ROLES = [(r, True) for r in ("doc", "ref", "term")] + [(r, False) for r in ("file", "djadmin")]


def rst_rules() -> list[tuple[str, str]]:
    """Ordered replacements (pattern, group) that leave a role's or literal's text."""
    rules = []
    for role, target in _ROLES:
        if target:
            rules.append((f":{role}:`([^`<]+)<[^>]+>`", "1"))
        rules.append((f":{role}:`([^`]+)`", "1"))
    rules += [(":func:`([^~`]+)`", "1"), (r":func:`~(?:[^`]*\.)?([^.`]+)`", "1"), ("``([^`]+)``", "1"), ("`([^`]+)`", "1"), (r"\|([^|]+)\|", "1")]
    return rules


def clean_rst(text: Column) -> Column:
    for pattern, group in rst_rules():
        text = F.regexp_replace(text, pattern, "$" + group)
    return text


def embedding_text(text: Column, limit: int = 1024) -> Column:
    """What an embedder reads: trimmed and cut; blank is null."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t != "", F.substring(t, 1, limit))


def eta(snippets: Column, local: bool = True) -> Column:
    """Expected time of embedding so many snippets: 30 ms each, or 15 ms by a remote service."""
    seconds = F.floor(snippets * (30 if local else 15) / 1000)
    hours, minutes = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))).when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"))).otherwise("< 1m")


def format_bytes(n: Column) -> Column:
    at = F.when(n > 0, F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0))), F.lit(4))).otherwise(0).cast("int")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), at + 1)
    return F.concat(F.regexp_replace(F.round(n / F.pow(F.lit(1024.0), at), 2).cast("string"), r"\.0$", ""), F.lit(" "), unit)


def pad_end(text: Column, width: int) -> Column:
    """Pads and never cuts."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def domain_of(library: Column, domains: dict[str, list[str]]) -> Column:
    """The first domain, in the table's order, of which a keyword stands in the lower-cased id; null if none does."""
    import re

    out = None
    for name, words in domains.items():
        hit = F.lower(library).rlike("|".join(re.escape(w) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")
