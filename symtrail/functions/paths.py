"""Column builders for paths, module names and import specifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from symtrail import constants as K


def normalize(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./|/)+", "")


def is_unsafe(path: Column) -> Column:
    """Empty, absolute (either platform) or climbing paths."""
    slashed = F.translate(path, "\\", "/")
    return (path == "") | slashed.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")


def checked(path: Column) -> Column:
    """The normalised path; an unsafe one fails the job."""
    return F.when(is_unsafe(path), F.raise_error(F.concat(F.lit("unsafe path: "), path)))\
        .otherwise(normalize(path))


def py_module(path: Column) -> Column:
    stem = F.regexp_replace(normalize(path), r"\.pyi?$", "")
    return F.translate(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/", ".")


def py_package(path: Column) -> Column:
    module = py_module(path)
    is_init = normalize(path).rlike(r"(^|/)__init__\.pyi?$")
    parent = F.when(module.contains("."), F.regexp_replace(module, r"\.[^.]*$", "")).otherwise("")
    return F.when(is_init, module).otherwise(parent)


def absolutize(dotted: Column, package: Column) -> Column:
    """A relative import against the importing package; one leading dot is the package itself."""
    level = F.length(F.regexp_extract(dotted, r"^\.+", 0))
    rest = F.regexp_replace(dotted, r"^\.+", "")
    parts = F.filter(F.split(package, r"\."), lambda p: p != "")
    kept = F.greatest(F.lit(0), F.size(parts) - (level - 1))
    base = F.array_join(F.slice(parts, 1, kept), ".")
    joined = F.when(rest == "", base).when(base == "", rest).otherwise(F.concat_ws(".", base, rest))
    return F.when(level == 0, dotted).otherwise(joined)


def ts_module(path: Column) -> Column:
    stem = F.regexp_replace(normalize(path), K.TS_STEM_SUFFIX, "")
    return F.array_join(F.filter(F.split(stem, "/"), lambda p: p != ""), ".")


def fold_dots(path: Column) -> Column:
    """POSIX normalisation of `a/./b/../c`; a path that climbs out keeps its leading `..`."""
    def step(acc, part):
        climbs = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (F.when((part == "") | (part == "."), acc)
                .when(climbs, F.slice(acc, 1, F.size(acc) - 1))
                .otherwise(F.concat(acc, F.array(part))))

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def ts_specifier(spec: Column, path: Column) -> Column:
    """The module an import specifier names, or the specifier itself when that is not knowable."""
    directory = F.when(normalize(path).contains("/"),
                       F.regexp_replace(normalize(path), r"/[^/]*$", "")).otherwise("")
    raw = (F.when(spec.startswith(K.TS_ALIAS), F.regexp_replace(spec, "^" + K.TS_ALIAS, ""))
           .when(spec.rlike(r"^\.\.?/"),
                 fold_dots(F.when(directory == "", spec).otherwise(F.concat_ws("/", directory, spec)))))
    unusable = spec.rlike(r"/$|^\.\.?$") | raw.isNull() | raw.isin("", ".", "..") | raw.startswith("../")
    return F.when(unusable, spec).otherwise(ts_module(raw))


def module_name(path: Column) -> Column:
    return F.when(path.rlike(K.TS_LIKE_PATH), ts_module(path)).otherwise(py_module(path))


def leaf(qname: Column) -> Column:
    return F.element_at(F.split(qname, r"\."), -1)


def owner(qname: Column) -> Column:
    """Everything before the last dot; a name without a dot is its own owner."""
    return F.regexp_replace(qname, r"\.[^.]*$", "")


def dotted_suffixes(qname: Column) -> Column:
    """`a.b.c` to `[a.b.c, b.c, c]`: every written name the qualified name answers to."""
    parts = F.split(qname, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_library(path: Column) -> Column:
    return F.coalesce(F.lower(F.translate(path, "\\", "/")).rlike(K.LIBRARY_PATH), F.lit(False))


def repo_id(folder: Column) -> Column:
    safe = F.regexp_replace(folder, "[^A-Za-z0-9_.-]", "_")
    return F.when(safe == "", "project").otherwise(safe)


def suffixes(path: Column, start: int) -> Column:
    """Trailing component runs of a path, longest first, from component `start` (0-based)."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    picks = F.when(F.size(parts) > start, F.sequence(F.lit(start + 1), F.size(parts)))\
        .otherwise(F.array().cast("array<int>"))
    return F.transform(picks, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


_ESCAPES = {"a": "07", "b": "08", "f": "0C", "n": "0A", "r": "0D", "t": "09", "v": "0B",
            "\\": "5C", '"': "22"}


def git_unquote(path: Column) -> Column:
    """Undo C-style quoting: octal bytes and letter escapes, decoded as UTF-8."""
    body = F.regexp_extract(path, r'(?s)^"(.*)"\z', 1)
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    escapes = F.create_map(*[F.lit(x) for kv in _ESCAPES.items() for x in kv])

    def as_hex(piece):
        plain = F.hex(piece.cast("binary"))
        octal = F.lpad(F.conv(F.substring(piece, 2, 3), 8, 16), 2, "0")
        letter = F.coalesce(F.try_element_at(escapes, F.substring(piece, 2, 1)), plain)
        return F.when(piece.rlike(r"^\\[0-7]{3}$"), octal)\
            .when(piece.startswith("\\"), letter).otherwise(plain)

    raw = F.unhex(F.array_join(F.transform(pieces, as_hex), ""))
    quoted = path.rlike(r'(?s)^".*"\z') & (F.length(path) >= 2)
    return F.when(quoted, F.decode(raw, "UTF-8")).otherwise(path)


def git_rename(line: Column) -> Column:
    """`struct(old, new)` for a porcelain rename line, else null; a path onto itself is no move."""
    shape = r"^R.\s+(.*?) -> (.*)$"
    old = git_unquote(F.regexp_extract(line, shape, 1))
    new = git_unquote(F.regexp_extract(line, shape, 2))
    return F.when(line.rlike(shape) & (old != new), F.struct(old.alias("old"), new.alias("new")))
