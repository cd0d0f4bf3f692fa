"""URL filtering with pattern rules that are indexed by their rarest literal token.

Two layers of rules decide about a url:

* Path rules (host and path prefix, ``example.net/en/``). One fits its host and
  all subdomains, if the path of the url starts with the rule's; the longest wins.
* Pattern rules, asked where no path rule fits: ``||`` anchors at a host or a
  subdomain, ``|`` at either end, ``*`` is any text, ``^`` a separator or the end,
  ``/.../`` a regular expression; a leading ``@@`` makes an exception, which wins
  over all blocking patterns.

A literal token of a pattern is a run of ``[a-z0-9]`` that any matching url must
hold as a whole run. Every pattern is filed under the one of its tokens that the
fewest urls hold, counted over all urls; patterns without such a token are filed
under the empty token, which every url has. A url fetches the patterns filed under
its tokens, and only those run as regular expressions. Both the lookup and the
counting are joins and aggregations, so that neither the list of rules nor the
urls need to fit anywhere; Spark broadcasts the rules while they are small. Work
is done once per different url, so a url that a third of all rows share costs one.

Results for odd rows: a null url, or one without ``://``, has an empty host and
path; no path rule fits it, patterns see a null url as empty text. Repeated rows and null ids
are kept, one output row per input row. An empty table gives an empty result.
Input columns other than the id and the url are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeseries.llm.columns import ascii_lower

TOKEN = "[a-z0-9]+"
SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"
HOST_START = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Decide first; the longest fitting one wins.
PATH_RULES = (
    PathRule("block", "net", "/"),
    PathRule("allow", "example.net", "/en/"),
    PathRule("block", "example.com", "/de/"),
    PathRule("allow", "org", "/fr/"),
)

#: Patterns of the query: ad and tracking hosts, spam and betting sites, session links.
PATTERN_RULES = (
    "||spam-farm.",
    "||ads-track.",
    "||free-bets.",
    "||doubleclick.*^",
    "||adserver.",
    "-casino.",
    "/casino/",
    "/adult/",
    "/wp-login.php",
    "/cgi-bin/*.cgi|",
    "^sessionid=",
    "^phpsessid=",
    "/banner*/ads^",
    r"/\.(?:exe|apk|torrent)(?:[?#]|$)/",
    "@@||help.*/casino/",
    "@@/ads.txt|",
)


def _anchored(pattern: str) -> tuple[str, str, bool]:
    """Regular expression of the left anchor, the rest, and whether the right end is anchored."""
    start, body = "", pattern
    if body.startswith("||"):
        start, body = HOST_START, body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    ended = body.endswith("|")
    return start, body[: len(body) - ended], ended


def compile_pattern(rule: str) -> tuple[str, bool, list[str]]:
    """Regular expression over the lower-cased url, whether it is an exception, its literal tokens."""
    exception = rule.startswith("@@")
    pattern = rule[2:] if exception else rule
    if len(pattern) > 2 and pattern.startswith("/") and pattern.endswith("/"):
        inner = pattern[1:-1]
        if re.search(r"[\\\[\](){}+?$]", inner):
            return inner, exception, []
    start, body, ended = _anchored(pattern.lower())
    parts = {"*": ".*", "^": SEPARATOR}
    regex = start + "".join(parts.get(c) or re.escape(c) for c in body) + ("$" if ended else "")
    tokens = []
    for found in re.finditer(TOKEN, body):
        before = body[found.start() - 1] if found.start() else ("" if start else "*")
        after = body[found.end()] if found.end() < len(body) else ("" if ended else "*")
        if "*" not in (before, after):
            tokens.append(found.group())
    return regex, exception, sorted(set(tokens))


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after_scheme(url), "/", 1))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def url_path(url: Column) -> Column:
    address = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.instr(address, "/")
    path = F.when((F.instr(url, "://") > 0) & (at > 0), F.substring(address, at, F.length(address)))
    return F.coalesce(path, F.lit(""))


def fitting_path_rule(host: Column, path: Column, rules: tuple[PathRule, ...]) -> Column:
    """The longest fitting rule as a struct of its text and verdict, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def pattern_table(urls: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Columns ``pattern, regex, exception``: the rules as a table."""
    rows = [(rule, *compile_pattern(rule)) for rule in dict.fromkeys(rules)]
    return urls.sparkSession.createDataFrame(rows, "pattern string, regex string, exception boolean, tokens array<string>")


def url_tokens(url: Column) -> Column:
    """The different tokens of a lower-cased url, with the empty one."""
    return F.array_union(F.array(F.lit("")), F.array_distinct(F.regexp_extract_all(url, F.lit(TOKEN), F.lit(0))))


def rarest_tokens(tokens: DataFrame, patterns: DataFrame) -> DataFrame:
    """File each pattern under its token that the fewest urls hold; ties go to the longer, then the first."""
    wanted = patterns.select("pattern", "regex", "exception", F.explode_outer("tokens").alias("token"))
    needed = wanted.select("token").where("token IS NOT NULL").distinct()
    counts = tokens.join(needed, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("pattern").orderBy("n", F.desc(F.length("token")), "token")
    return (
        wanted.join(counts, "token", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("rank", F.row_number().over(rank))
        .where("rank = 1")
        .select("pattern", "regex", "exception", F.coalesce("token", F.lit("")).alias("token"))
    )


def matched_patterns(urls: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """For each different url that a pattern matches: ``url, exception, pattern`` of the deciding one."""
    tokens = urls.select("url", F.explode(url_tokens(ascii_lower(F.col("url")))).alias("token"))
    index = rarest_tokens(tokens, pattern_table(urls, rules))
    return (
        tokens.join(index, "token")
        .where(F.expr("translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') RLIKE regex"))
        .groupBy("url")
        .agg(F.max("exception").alias("exception"), F.min("pattern").alias("any"), F.min(F.when(F.col("exception"), F.col("pattern"))).alias("allowing"))
        .select("url", "exception", F.coalesce("allowing", "any").alias("pattern"))
    )


def filter_urls(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    path_rules: tuple[PathRule, ...] = PATH_RULES,
    pattern_rules: tuple[str, ...] = PATTERN_RULES,
) -> DataFrame:
    """``id, host, path, rule, verdict, pattern`` for every row; see the module for odd rows.

    ``rule`` is the path rule that decided, ``pattern`` the pattern rule that decided.
    """
    rows = pages.select(F.col(id_column), F.col(url_column).alias("url"))
    judged = rows.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    matched = matched_patterns(judged, pattern_rules).withColumnRenamed("url", "matched_url")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    return (
        rows.join(matched, F.coalesce("url", F.lit("")) == F.col("matched_url"), "left")
        .select(id_column, "url", host.alias("host"), path.alias("path"), "exception", "pattern")
        .withColumn("fit", fitting_path_rule(F.col("host"), F.col("path"), path_rules))
        .select(
            id_column,
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce(
                F.col("fit.verdict"),
                F.when(F.col("pattern").isNull() | F.col("exception"), "allow").otherwise("block"),
            ).alias("verdict"),
            F.when(F.col("fit").isNull(), F.col("pattern")).alias("pattern"),
        )
    )
