"""Path expressions: parts, lexical cleaning, containment, prefixes and globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """Last component."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Text after the last dot of the name, or '' (a leading dot is not an extension)."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    """Name without its extension."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def parent_name(path: Column) -> Column:
    """Name of the last directory, or ''."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def parent_dir(path: Column) -> Column:
    """Everything before the last '/', or ''."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def lexical_clean(path: Column) -> Column:
    """Resolve '.', '..' and doubled separators textually, never touching storage."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        popped = F.slice(acc, F.lit(1), F.size(acc) - 1)
        pushed = F.concat(acc, F.array(part))
        return (F.when(part.isin("", "."), acc)
                .when((part == "..") & (F.coalesce(last, F.lit("..")) != ".."), popped)
                .otherwise(pushed))

    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    rooted = F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(rooted == "", F.lit(".")).otherwise(rooted)


def under(path: Column, root: Column | str) -> Column:
    """Component-wise prefix: equal to ``root`` or inside it ('dist' holds no 'distortion')."""
    root = F.lit(root) if isinstance(root, str) else root
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def prefix_matches(prefix: Column | str, rule_id: Column | str) -> Column:
    """Rule selectors match an id exactly or as a leading path."""
    rule_id = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    return under(rule_id, prefix)


def glob_to_regex(pattern: str, crosses_slash: bool) -> str:
    """Translate a literal glob at plan time into an anchored regex.

    ``crosses_slash`` is True for lint globs, where ``*``, ``?`` and classes may match
    '/', and False for file globs. ``**`` spans directories and must stand alone
    between separators; an unclosed class is malformed.
    """
    one = "." if crosses_slash else "[^/]"
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*" and pattern.startswith("**", i):
            end = i + 2
            if (i and pattern[i - 1] != "/") or pattern[end:end + 1] not in ("", "/"):
                raise ValueError(f"malformed glob '{pattern}'")
            out.append("(?:.*/)?" if pattern[end:end + 1] == "/" else ".*")
            i = end + 1
        elif c == "[":
            end = pattern.find("]", i + 3 if pattern.startswith("[!", i) else i + 2)
            if end < 0:
                raise ValueError(f"malformed glob '{pattern}'")
            body = pattern[i + 1:end]
            negated = body.startswith("!")
            body = "".join("\\" + ch if ch in "\\[]^&" else ch for ch in (body[1:] if negated else body))
            out.append(("" if crosses_slash else "(?!/)") + f"[{'^' if negated else ''}{body}]")
            i = end + 1
        else:
            out.append(one + "*" if c == "*" else one if c == "?" else "\\" + c if c in r"\.+^$(){}|]" else c)
            i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_matches(path: Column, pattern: str, crosses_slash: bool = True) -> Column:
    """Literal-pattern glob test, compiled once per task; a malformed lint glob matches nothing."""
    try:
        return path.rlike(glob_to_regex(pattern, crosses_slash))
    except ValueError:
        if crosses_slash:
            return F.lit(False)
        raise


def literal_root(source: Column) -> Column:
    """Directory to watch for a source entry: the literal prefix before any wildcard."""
    literal = F.regexp_extract(source, r"^([^*?\[]*)", 1)
    trimmed = F.regexp_replace(literal, r"[/\\]+$", "")
    own = F.when(trimmed == "", F.lit(".")).otherwise(lexical_clean(trimmed))
    return F.when(literal.rlike(r"[/\\]$"), own).otherwise(containing_dir(literal))


def containing_dir(path: Column) -> Column:
    """Cleaned parent directory, '.' when there is none."""
    parent = parent_dir(path)
    return F.when(parent == "", F.lit(".")).otherwise(lexical_clean(parent))


def expand_template(template: Column | str, path: Column, ext: Column | str) -> Column:
    """Replace {stem} {ext} {name} {parent} in that order; unknown tokens stay literal."""
    out = F.lit(template) if isinstance(template, str) else template
    ext = F.lit(ext) if isinstance(ext, str) else ext
    for token, value in (("{stem}", stem(path)), ("{ext}", ext), ("{name}", file_name(path)),
                         ("{parent}", parent_name(path))):
        out = F.replace(out, F.lit(token), value)
    return out
