"""URL rules found by their rarest literal token.

A rule is a regular expression over host and path, with the literal tokens it
cannot match without. Each rule is filed under one of them, the one that the
fewest URLs hold; a URL's tokens fetch the rules filed under them, and only
those expressions run. A rule without a literal is filed under the empty token,
which every URL has, so it is never lost.

DataFrame functions only. Each URL row keeps an id of its own, so repeated rows
stay apart, and a page's candidates are reduced to one row before the shuffle.
Other columns travel with their row: pass only those that are wanted.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ascii_lower

# The rule table goes to every executor up to this many rules; beyond, it is joined by shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for each URL whose host and path match ``pattern``.

    ``literals`` are lower-case runs of letters and digits, each bounded by other
    characters in every URL that matches. ``rank``: the greatest wins, ties go to
    the smaller name.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int


def host_path_rule(rule: str, verdict: str) -> UrlRule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's.

    The last token of the path may go on in the URL, so it is no literal unless
    the rule ends in a separator. Longer rules rank higher.
    """
    host, slash, rest = rule.partition("/")
    path = slash + rest
    pattern = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path)
    if not path:
        pattern += r"(?:/|$)"
    whole = path if not path or not path[-1].isalnum() else path[: re.search(r"\w*$", path).start()]
    literals = tuple(re.findall(r"[a-z0-9]+", host + "/" + whole.lower()))
    return UrlRule(rule, verdict, pattern, literals, len(rule))


def _tokens(host, path):
    return F.array_distinct(
        F.concat(F.split(ascii_lower(F.concat_ws("/", host, path)), "[^a-z0-9]+"), F.array(F.lit("")))
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    patterns: Sequence[UrlRule] = (),
    *,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and pattern.

    ``rule`` is the best of ``rules`` that fits (null if none does) and decides;
    else the best of ``patterns`` decides and is named in ``pattern``; else the
    verdict is ``default``. The host is what follows the first ``://`` up to
    ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes on up to ``?``,
    ``#`` or the end. A null URL, or one without ``://``, has both empty and gets
    the default unless a rule matches the empty text. Rows are kept one for one,
    repeated ones too; columns of ``pages`` called like a result are replaced, and
    an empty table gives an empty table.
    """
    names = ["host", "path", "rule", "verdict", "pattern"]
    kept = [c for c in pages.columns if c not in names or c == url]
    link = F.col(f"`{url}`")
    rest = F.coalesce(F.regexp_extract(link, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    rows = pages.select(
        *[F.col(f"`{c}`") for c in kept],
        F.monotonically_increasing_id().alias("_row"),
        ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)).alias("_host"),
        F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("_path"),
    )
    # The later in this order, the stronger.
    ordered = sorted(
        [(False, r) for r in patterns] + [(True, r) for r in rules], key=lambda x: x[1].name
    )[::-1]
    ordered.sort(key=lambda x: x[1].rank)
    index = _index(rows, ordered)
    text = F.concat("_host", "_path")
    fits = F.rlike(text, F.col("_regex"))
    best = (
        rows.withColumn("_token", F.explode(_tokens(F.col("_host"), F.col("_path"))))
        .join(index, "_token", "left")
        .groupBy(*[F.col(f"`{c}`") for c in kept], "_row", "_host", "_path")
        .agg(
            F.max(F.when(F.col("_decides") & fits, F.col("_at"))).alias("_rule_at"),
            F.max(F.when(~F.col("_decides") & fits, F.col("_at"))).alias("_pattern_at"),
        )
        .withColumn("_at", F.coalesce("_rule_at", "_pattern_at"))
    )
    return best.join(index.select("_at", "_decides", "_name", "_verdict"), "_at", "left").select(
        *[F.col(f"`{c}`") for c in kept if c not in names],
        *([link.alias(url)] if url in names else []),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_decides"), F.col("_name")).alias("rule"),
        F.coalesce("_verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("_decides"), F.col("_name")).alias("pattern"),
    )


def _index(rows: DataFrame, ordered: list[tuple[bool, UrlRule]]) -> DataFrame:
    """The rules, each with its rarest literal and its place in the order of strength."""
    literals = sorted({t for _, r in ordered for t in r.literals})
    counts: dict[str, int] = {}
    if literals:
        # One row for each literal of the rules comes back, however many pages there are.
        seen = (
            rows.select(F.explode(_tokens(F.col("_host"), F.col("_path"))).alias("token"))
            .filter(F.col("token").isin(literals))
            .groupBy("token")
            .count()
        )
        counts = {r["token"]: r["count"] for r in seen.collect()}
    rarest = lambda r: min(r.literals, key=lambda t: (counts.get(t, 0), t), default="")
    index = rows.sparkSession.createDataFrame(
        [
            (rarest(r), at, decides, r.name, r.verdict, r.pattern)
            for at, (decides, r) in enumerate(ordered)
        ],
        "_token string, _at int, _decides boolean, _name string, _verdict string, _regex string",
    )
    return F.broadcast(index) if len(ordered) <= BROADCAST_RULES else index
