"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over `host + path` with the literal tokens that every match must hold.
Tokens of the rules are counted over all URLs, each rule is filed under its rarest one, and a URL runs
only the rules filed under its own tokens.  Rules are configuration, so their number is bounded and
checked; URLs are judged where they are read, without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rules travel to every task; more than this is refused.
MAX_RULES = 100_000

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`text` names the rule and its length decides between rules; `pattern` is searched in host + path."""

    text: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    named: bool = True          # whether results state the rule


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with all its subdomains, and paths that begin with `path`.

    The last token of the path may go on in a URL (`/en/1` fits `/en/12`), so it is no literal token."""
    whole = re.findall(TOKEN, host) + re.findall(TOKEN, re.sub(TOKEN + r"\Z", "", path.lower()))
    return Rule(host + path, r"\A(?:[^/]*\.)?" + re.escape(host) + r"(?=/|\Z)" + re.escape(path), verdict, tuple(whole))


#: The stated rules (fixed values).
PAGE_RULES = (
    prefix_rule("org", "/", "allow"),
    prefix_rule("example.org", "/es/", "block"),
    prefix_rule("example.org", "/en/1", "block"),
    prefix_rule("com", "/fr/", "allow"),
    prefix_rule("com", "/de/", "block"),
)

#: Words in a host name that mark advertising farms: what the method blocks where no stated rule fits.
SPAM_WORDS = ("casino", "pills", "spam", "viagra", "porn", "xxx", "lottery", "payday")

METHOD_RULES = tuple(
    Rule(word, rf"\A[^/]*(?<![a-z0-9]){word}(?![a-z0-9])", "block", (word,), named=False) for word in SPAM_WORDS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    found = F.coalesce(url, F.lit("")).contains("://")
    rest = F.when(found, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _tokens(key: Column) -> Column:
    """Distinct tokens of host + path, A-Z folded."""
    return F.array_distinct(F.regexp_extract_all(F.translate(key, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({TOKEN})"), 1))


def token_counts(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each token of the rules (at most as many numbers as the rules have tokens)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    host, path = host_and_path(F.col("url"))
    held = pages.select(_tokens(F.concat(host, path)).alias("tokens"))
    counts = held.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("token")).groupBy("token").count()
    return {row["token"]: row["count"] for row in counts.collect()}


def judge(pages: DataFrame, rules: tuple[Rule, ...] = PAGE_RULES, method: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_tried), one row per row of `pages` (page_id, url).

    The longest stated rule that fits decides, of equally long ones the first by text.  Where none fits,
    `rule` is null and the method's own rules decide: block if one fits, else allow.  A URL that is null
    or has no `://` has an empty host and path and is allowed.  `n_tried` counts the regular expressions
    that were run.  A rule without a literal token is tried on every URL.  An empty table gives no rows;
    other columns are not read."""
    every = (*rules, *method)
    if len(every) > MAX_RULES:
        raise ValueError(f"{len(every)} rules; at most {MAX_RULES} are sent to the tasks")
    counts = token_counts(pages, every)
    index: dict[str, list[int]] = defaultdict(list)
    for k, rule in enumerate(every):
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(k)
    index = dict(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, re.DOTALL) for r in every]
        for batch in batches:
            named, verdicts, tried = [], [], []
            for host, path, tokens in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "tokens"))):
                key = host + path
                candidates = [k for t in ("", *tokens) for k in index.get(t, ())]
                fits = [every[k] for k in candidates if compiled[k].search(key)]
                best = min((r for r in fits if r.named), key=lambda r: (-len(r.text), r.text), default=None)
                named.append(best and best.text)
                verdicts.append(best.verdict if best else "block" if any(r.verdict == "block" for r in fits) else "allow")
                tried.append(len(candidates))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(named, pa.string()), pa.array(verdicts, pa.string()), pa.array(tried, pa.int64())],
                ["page_id", "host", "path", "rule", "verdict", "n_tried"])

    host, path = host_and_path(F.col("url"))
    keys = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("tokens", _tokens(F.concat("host", "path")))
    kind = pages.schema["page_id"].dataType.simpleString()
    return keys.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, n_tried long")


SQL = r"""
with cut as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut),
rules(h, p, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits as (
  select page_id, host, path, first(h || p order by length(h || p) desc, h || p) filter (h is not null) as rule,
         first(verdict order by length(h || p) desc, h || p) filter (h is not null) as verdict
  from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all)
select page_id, host, path, rule,
       coalesce(verdict, case when regexp_matches(host, '(^|[^a-z0-9])(casino|pills|spam|viagra|porn|xxx|lottery|payday)($|[^a-z0-9])')
                              then 'block' else 'allow' end) verdict
from fits
"""
