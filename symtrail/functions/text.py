"""Column builders for identifiers, tokens, hashes, redaction and chunk headers (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from symtrail import constants as K

NUL = "\x00"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, also where `body` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Remove Unicode white space on both sides (`trim` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def text_of(content: Column) -> Column:
    """Bytes to text with CRLF folded; invalid UTF-8 is replaced, never an error."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n", "\n")


# -- hashes ------------------------------------------------------------------------------------

def content_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, "\r\n", "\n").cast("binary"), 256)


def symbol_uid(repo, path, qname, arity, ordinal) -> Column:
    parts = [repo, path, qname, arity.cast("string"), ordinal.cast("string")]
    return F.substring(F.sha1(F.concat_ws(NUL, *parts).cast("binary")), 1, 20)


def normalized_body(source: Column) -> Column:
    folded = F.regexp_replace(source, "\r\n", "\n")
    return strip(F.regexp_replace(folded, r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""))


def body_hash(source: Column) -> Column:
    return F.substring(F.sha2(normalized_body(source).cast("binary"), 256), 1, 20)


def header_hash(path: Column, enclosing: Column, signature: Column, imports: Column) -> Column:
    parts = F.concat_ws(NUL, path, F.coalesce(enclosing, F.lit("")), signature,
                        F.array_sort(imports), F.lit(K.SCRUB_RULES_VERSION))
    return F.substring(F.sha2(parts.cast("binary"), 256), 1, 12)


def cache_key(header: Column, body: Column) -> Column:
    return F.concat_ws(":", header, body)


# -- identifiers and search text -----------------------------------------------------------------

def split_identifier(c: Column) -> Column:
    """Separators, camel humps and digit borders; case kept, empties dropped."""
    return F.filter(F.split(c, K.IDENTIFIER_BORDER), lambda x: x != "")


def tokenize_query(c: Column) -> Column:
    """Whole lower-cased terms first, then their identifier parts; distinct, order kept."""
    raw = F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")
    return F.array_distinct(F.flatten(F.transform(
        raw, lambda t: F.concat(F.array(F.lower(t)),
                                F.transform(split_identifier(t), lambda p: F.lower(p))))))


def query_terms(c: Column) -> Column:
    """What reaches the inverted index: all terms, analysed like the documents are.

    The same word may come from several terms (`erin,` and `erin`), and then counts that often."""
    return F.flatten(F.transform(tokenize_query(c), analyzed_words))


def analyzed_words(c: Column) -> Column:
    """Lower-cased word tokens; no stemming and no stop words."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def search_text(name: Column, qname: Column, docstring: Column) -> Column:
    parts = F.transform(split_identifier(name), lambda p: F.lower(p))
    pieces = [name, qname, F.lower(name), F.array_join(parts, " "), F.array_join(parts, ""),
              F.array_join(parts, "_"), docstring]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in pieces])


# -- tokens ----------------------------------------------------------------------------------------

def token_count(c: Column) -> Column:
    """White-space runs cost 1 + newlines; any other lexeme costs ceil(chars / 4)."""
    def cost(lex):
        blank = lex.rlike(r"(?U)^\s+\z")
        return F.when(blank, F.lit(1) + F.char_length(lex) - F.char_length(F.replace(lex, F.lit("\n"))))\
            .otherwise(F.floor((F.char_length(lex) + 3) / 4).cast("int"))

    return F.aggregate(F.regexp_extract_all(c, F.lit(K.LEXEME), F.lit(0)), F.lit(0),
                       lambda acc, lex: acc + cost(lex))


# -- redaction ---------------------------------------------------------------------------------------

def scrub(c: Column) -> Column:
    """Every redaction rule, in order; rules with a surrounding group keep it."""
    for name, pattern, before, after in K.REDACTION_RULES:
        c = F.regexp_replace(c, pattern, f"{before}{K.REDACTED}:{name}{after}")
    return c


# -- chunk header and rendering --------------------------------------------------------------------

def _no_colon(c: Column) -> Column:
    return F.regexp_replace(c, r":+\z", "")


def context_header(path: Column, enclosing: Column, signature: Column, imports: Column) -> Column:
    first = F.concat(F.lit("# "), F.concat_ws(
        " :: ", path, F.nullif(_no_colon(enclosing), F.lit("")), _no_colon(signature)))
    used = F.when(F.size(F.coalesce(imports, F.array().cast("array<string>"))) > 0,
                  F.concat(F.lit("# imports used: "), F.array_join(F.array_sort(imports), ", ")))
    return F.concat_ws("\n", first, used)


def stub(header: Column, signature: Column, docstring: Column) -> Column:
    line = strip(F.split(strip(docstring), "\r\n|\n|\r")[0])
    quoted = F.when(line != "", F.concat(F.lit('    """'), line, F.lit('"""')))
    return F.concat_ws("\n", header, signature, quoted)


def language_of(path: Column) -> Column:
    return F.when(path.rlike(K.TS_LIKE_PATH), "typescript").otherwise("python")
