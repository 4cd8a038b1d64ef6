"""Scalar functions as column expressions, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The folder of each canonical kind, and slug limits.
FOLDERS = {"concept": "concepts", "entity": "entities", "source": "sources", "synthesis": "synthesis"}
SLUG_LENGTH = 64
SLUG_LEAST_CUT = 8
#: Fixed value: what a link destination percent-encodes; ``%`` first, so that nothing is encoded twice.
ENCODED = {"%": "%25", " ": "%20", "#": "%23", "(": "%28", ")": "%29", "<": "%3C", ">": "%3E"}
#: The formats of a page ref, of a frontmatter block and of a date.
PAGE_REF = r"^wiki/[^/]*/[^/]*\.md\z"
FRONTMATTER = r"(?s)\A---[ \t]*\r?\n(?:(.*?\n)?)---[ \t]*(?:\r?\n|\z)"
DATE = r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[Zz]|[+-]\d{2}:?\d{2})?)?$"
WORDS = r"[\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Runs of letters and numbers, in lower case."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(WORDS), F.lit(0))


def discovery_terms(*texts: Column | str) -> Column:
    """S-08: the distinct ``[a-z0-9]+`` runs of several texts, first seen first."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("[a-z0-9]+"), F.lit(0)))


def is_page_ref(ref: Column | str) -> Column:
    """R-02: ``wiki/<folder>/<file>.md``, three segments."""
    return (F.col(ref) if isinstance(ref, str) else ref).rlike(PAGE_REF)


def kind_of(ref: Column | str) -> Column:
    """P-09: the kind that the folder stands for; one trailing s off for other folders."""
    folder = F.element_at(F.split(ref, "/"), 2)
    known = F.create_map(*[F.lit(x) for k, f in FOLDERS.items() for x in (f, k)])
    return F.coalesce(known[folder], F.regexp_replace(folder, "s$", ""))


def slugify(title: Column | str, longest: int = SLUG_LENGTH) -> Column:
    """S-01, S-02: lower-case kebab; apostrophes go, other runs become one hyphen."""
    t = F.lower(title)
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "['’]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(slug, 1, longest)
    # The place of the last hyphen within the head, from 0; -1 if there is none.
    at = F.when(F.instr(head, "-") > 0, longest - F.instr(F.reverse(head), "-")).otherwise(-1)
    short = F.when(at >= SLUG_LEAST_CUT, F.substring(slug, F.lit(1), at.cast("int"))).otherwise(head)
    return F.when(F.length(slug) <= longest, slug).otherwise(F.regexp_replace(short, "-+$", ""))


def place(kind: Column | str, title: Column | str) -> Column:
    """S-13: the page ref of a new page; an unknown kind raises an error."""
    folders = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    folder = F.coalesce(folders[F.col(kind) if isinstance(kind, str) else kind], F.raise_error(F.concat(F.lit("unknown kind: "), kind if isinstance(kind, Column) else F.col(kind))))
    return F.concat(F.lit("wiki/"), folder, F.lit("/"), slugify(title), F.lit(".md"))


def canonical_date(value: Column | str) -> Column:
    """S-14: ``YYYY-MM-DD`` of a date with or without a clock; null if it is none."""
    v = F.trim(value)
    day = F.regexp_extract(v, DATE, 1)
    parsed = F.try_to_date(F.when(day != "", day), "yyyy-MM-dd")
    return F.when(parsed.isNotNull(), day)


def tolerant_date(value: Column | str) -> Column:
    """The read posture of dates: canonical where valid, else the text as it is, "" for null."""
    return F.coalesce(canonical_date(value), F.col(value) if isinstance(value, str) else value, F.lit(""))


def percent_encode(path: Column | str) -> Column:
    """S-03: encode what a link destination can't hold."""
    out = F.col(path) if isinstance(path, str) else path
    for raw, encoded in ENCODED.items():
        out = F.replace(out, F.lit(raw), F.lit(encoded))
    return out


def relative_path(target: Column | str, base: Column | str) -> Column:
    """S-05: the route from folder ``base`` to ``target``, both normalised already."""
    t = F.filter(F.split(target, "/"), lambda x: (x != "") & (x != "."))
    b = F.filter(F.split(base, "/"), lambda x: (x != "") & (x != "."))
    n = F.least(F.size(t), F.size(b))
    # How many leading segments agree.
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.get(t, i - 1) == F.get(b, i - 1)), i).otherwise(acc))
    up = F.array_repeat(F.lit(".."), F.size(b) - same)
    parts = F.concat(up, F.slice(t, same + 1, F.greatest(F.size(t) - same, F.lit(0))))
    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))


def resolve_path(dest: Column | str, folder: Column | str) -> Column:
    """P-08: a destination joined to its page's folder, with ``.`` and ``..`` resolved."""
    dest = F.col(dest) if isinstance(dest, str) else dest
    parts = F.filter(F.split(F.concat_ws("/", folder, dest), "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.array_join(folded, "/")
    return F.when(joined == "", F.when(dest.endswith("/"), "./").otherwise(".")).otherwise(F.concat(joined, F.when(dest.endswith("/"), "/").otherwise("")))


def compose_link(title: Column | str, target: Column | str, folder: Column | str) -> Column:
    """S-04: ``[title](encoded relative path)``."""
    return F.concat(F.lit("["), F.col(title) if isinstance(title, str) else title, F.lit("]("), percent_encode(relative_path(target, folder)), F.lit(")"))


def strictly_newer(raw_date: Column, page_date: Column) -> Column:
    """F-12: whether the raw file is newer than the page that came of it."""
    return F.when(page_date == "", True).when(raw_date == "", False).otherwise(raw_date > page_date)


def frontmatter(text: Column | str) -> Column:
    """P-01: the block between the fences, "" where there is none."""
    return F.regexp_extract(text, FRONTMATTER, 1)


def body(text: Column | str) -> Column:
    """P-01: what follows the block; all of a text without one."""
    t = F.col(text) if isinstance(text, str) else text
    return F.substring(t, F.length(F.regexp_extract(t, FRONTMATTER, 0)) + 1, F.length(t))


def glob_pattern(pattern: Column | str) -> Column:
    """F-09: the regular expression of a glob; ``*`` and ``?`` stay within a folder."""
    escaped = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit(r"\z"))


def ignore_pattern(line: Column | str) -> Column:
    """F-10: a policy line without its comment; null if nothing is left; ``/``, ``!`` and
    ``**`` are errors."""
    p = F.rtrim(F.regexp_replace(line, "#.*", ""))
    bad = p.contains("/") | p.contains("!") | p.contains("**")
    return F.when(p == "", F.lit(None).cast("string")).when(bad, F.raise_error(F.concat(F.lit("unsupported pattern: "), p))).otherwise(p)


def comma_list(text: Column | str) -> Column:
    """S-22: the trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def merge_ordered(existing: Column, new: Column) -> Column:
    """O-05: the existing list as it is, then new values that it lacks, each once."""
    return F.concat(existing, F.array_except(new, existing))


def short_id(session: Column | str) -> Column:
    """S-21: what stands before the first hyphen."""
    return F.substring_index(session, "-", 1)


def commit_message(manifest: str = "manifest") -> Column:
    """S-18: the message of a manifest struct (title, action, created, updated, superseded, source_date)."""
    m = F.col(manifest)
    heads = lambda name: F.transform(m[name], lambda x: F.concat(F.lit(f"{name}: "), x))
    pairs = F.transform(m["superseded"], lambda s: F.concat(F.lit("superseded: "), s["old"], F.lit(" -> "), s["new"]))
    date = F.when(F.coalesce(m["source_date"], F.lit("")) != "", F.array(F.concat(F.lit("source-date: "), m["source_date"]))).otherwise(F.array().cast("array<string>"))
    first = F.array(F.concat(m["action"], F.lit(": "), m["title"]), F.lit(""))
    return F.array_join(F.concat(first, heads("created"), heads("updated"), pairs, date), "\n")


def manifest_paths(manifest: str = "manifest") -> Column:
    """O-06: created, updated, superseded and raw paths, first seen first."""
    m = F.col(manifest)
    pairs = F.flatten(F.transform(m["superseded"], lambda s: F.array(s["old"], s["new"])))
    raw = F.when(F.coalesce(m["raw_source"], F.lit("")) != "", F.array(m["raw_source"])).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(m["created"], m["updated"], pairs, raw))
