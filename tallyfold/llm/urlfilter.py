"""URL filtering by pattern rules indexed by their rarest literal token. DataFrame functions only.

A rule is a regular expression over host and path together with the literal tokens that any match contains. Its key is the
token that fewest rules share (ties: the longer, then the first in order). The tokens of a URL fetch the candidate rules from
the index, and only their expressions run. Rules without a literal token are candidates of every URL.

Up to MOST_RULES the index is part of the plan and pages are not shuffled. With more of them it is a table: the tokens of each
distinct host and path meet it in a join, by broadcast while the table's text has at most BROADCAST characters, else dealt over SALTS
parts, as a token may stand in most URLs; what fits is joined back the same way, as a URL may be that of most rows.

A null URL or one without :// has an empty host and path, which no token rule fits. Rows that repeat are judged each. An
empty table gives no rows. Other columns are kept, whatever their names, but for those that judge() adds.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES, BROADCAST, SALTS = 500, 32 << 20, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with the given one."""
    return Rule(host + path, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(re.findall(r"[a-z0-9]+", host.lower())) + tuple(path_tokens(path)), verdict)


def path_tokens(path: str) -> list[str]:
    """Tokens that stand whole in any path that starts with this one: the last counts only if something ends it."""
    parts = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return [p.lower() for p in parts]


#: Fixed rules: (host, path, verdict).
BASE = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Kinds of hosts and paths that a crawl leaves out: name, words, and where a word stands as a token of its own.
KINDS = [
    ("ads", "host", ("ads", "adserver", "doubleclick", "banners", "sponsored", "track", "tracker", "tracking", "pixel", "beacon")),
    ("adult", "host", ("porn", "xxx", "sex", "escort", "nude", "camgirl")),
    ("gambling", "host", ("casino", "poker", "betting", "slots", "jackpot")),
    ("spam", "host", ("viagra", "pills", "payday", "replica", "warez", "torrent")),
    ("account", "path", ("login", "signin", "signup", "register", "logout", "password", "checkout", "basket", "cart")),
    ("machine", "path", ("wp-login", "cgi-bin", "xmlrpc", "phpmyadmin", "sitemap", "robots")),
]

#: Kinds of paths told by several words that stand one after another, each a token: name, phrases.
PHRASES = [
    ("account", ("my account", "account login", "user login", "user register", "user profile edit", "reset password", "forgot password", "change password", "create account", "member login")),
    ("shop", ("add to cart", "cart add", "cart update", "add to wishlist", "add to basket", "checkout payment", "product compare")),
    ("machine", ("wp admin", "wp content plugins", "wp content themes", "wp json", "wp includes", "admin login", "admin ajax", "feed rss", "rss xml", "api v1", "api v2", "server status", "cgi bin env")),
    ("calendar", ("calendar day", "calendar week", "calendar month", "events day", "archive day")),
    ("listing", ("tag page", "search results", "search page", "author page", "category page", "index of", "sort by price", "filter by price")),
    ("copy", ("print version", "printer friendly", "send to friend", "email this page", "share this page", "download pdf version")),
    ("legal", ("terms of use", "terms of service", "privacy policy", "cookie policy", "copyright notice")),
    ("forum", ("reply to post", "report this post", "quote reply", "members list", "who is online", "private message")),
]


def default_rules() -> list[Rule]:
    out = []
    for name, where, words in KINDS:
        for w in words:
            before = r"^([^/]*[^A-Za-z0-9/])?" if where == "host" else r"/([^\n]*[/._-])?"
            out.append(Rule(f"{name}:{w}", f"(?i){before}{re.escape(w)}([^A-Za-z0-9]|$)", tuple(re.findall("[a-z0-9]+", w)), "block"))
    for name, phrases in PHRASES:
        for p in phrases:
            words = p.split()
            out.append(Rule(f"{name}:{p}", r"(?i)/([^\n]*[/._-])?" + "[/._-]".join(words) + "([^A-Za-z0-9]|$)", tuple(words), "block"))
    return out


def base_rules() -> list[Rule]:
    return [host_rule(*x) for x in BASE]


def index(rules: list[Rule]) -> dict[str, list[int]]:
    """Rules by key token; those without one under the empty token."""
    often = Counter(t for r in rules for t in set(r.tokens))
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        key = min(r.tokens, key=lambda t: (often[t], -len(t)), default="")
        out.setdefault(key, []).append(i)
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://((?s).*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(subject: Column) -> Column:
    return F.array_distinct(F.split(F.translate(subject, UPPER, LOWER), "[^a-z0-9]+"))


def matches(subject: Column, rules: list[Rule]) -> Column:
    """Numbers of the rules that fit, ascending. The rules are part of the plan."""
    if not rules:
        return F.array().cast("array<int>")
    by = index(rules)
    always = F.array(*[F.lit(i) for i in by.pop("", [])]).cast("array<int>")
    keys = F.create_map(*[x for t, ids in by.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))]) if by else F.create_map().cast("map<string,array<int>>")
    fetched = F.flatten(F.transform(tokens_of(subject), lambda t: F.coalesce(F.element_at(keys, t), F.array().cast("array<int>"))))
    patterns = F.array(*[F.lit(r.pattern) for r in rules])
    return F.array_sort(F.filter(F.concat(always, fetched), lambda i: F.regexp_like(subject, F.get(patterns, i))))


def first_fit(pages: DataFrame, subject: Column, rules: list[Rule], to: list[str], most: int = MOST_RULES, broadcast: int = BROADCAST) -> DataFrame:
    """pages with the name and verdict (nulls: none) of the first rule that fits, in columns of the names in `to`."""
    if len(rules) <= most:
        at = F.get(matches(subject, rules), F.lit(0))
        of = lambda value: F.get(F.array(*[F.lit(getattr(r, value)) for r in rules]), F.col("_at")) if rules else F.lit(None).cast("string")
        return pages.withColumn("_at", at).withColumns({to[0]: of("name"), to[1]: of("verdict")}).drop("_at")
    rows = [(t, i, rules[i].pattern, rules[i].name, rules[i].verdict) for t, ids in index(rules).items() for i in ids]
    table = pages.sparkSession.createDataFrame(rows, "_token string, _at int, _pattern string, _name string, _verdict string")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    subjects = pages.select(subject.alias("_subject")).distinct()
    keyed = subjects.select("_subject", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), tokens_of(F.col("_subject"))))).alias("_token"))
    if sum(len(x) for r in rows for x in r if isinstance(x, str)) <= broadcast:
        fetched = keyed.join(F.broadcast(table), "_token")
    else:
        fetched = keyed.withColumn("_salt", F.pmod(F.xxhash64("_subject"), F.lit(SALTS)).cast("int")).join(table.select("*", salts), ["_token", "_salt"])
    first = F.min(F.struct("_at", "_name", "_verdict")).alias("_first")
    fits = fetched.filter(F.regexp_like("_subject", F.col("_pattern"))).groupBy("_subject").agg(first)
    fits = fits.select("_subject", F.col("_first._name").alias(to[0]), F.col("_first._verdict").alias(to[1]), salts)
    # Any salt gives the same rows, so a task that runs again may number its rows otherwise.
    dealt = pages.withColumns({"_subject": subject, "_salt": (F.monotonically_increasing_id() % SALTS).cast("int")})
    return dealt.join(fits, ["_subject", "_salt"], "left").drop("_subject", "_salt")


def judge(pages: DataFrame, rules: list[Rule] | None = None, extra: list[Rule] | None = None, otherwise: str = "allow", most: int = MOST_RULES, broadcast: int = BROADCAST) -> DataFrame:
    """pages with host, path, rule, verdict and reason; columns of these names are replaced.

    rules: of host_rule, the longest that fits decides. extra: the method's further rules, which decide (in order) where none
    of these fits; reason names the one that did. otherwise: the verdict where nothing fits.
    """
    rules = base_rules() if rules is None else rules
    extra = default_rules() if extra is None else extra
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    host, path = host_and_path(F.col("url"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "reason")]
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host.alias("host"), path.alias("path"))
    subject = F.concat("host", "path")
    out = first_fit(out, subject, ranked, ["rule", "_own"], most, broadcast)
    out = first_fit(out, subject, extra, ["_reason", "_more"], most, broadcast)
    free = F.col("rule").isNull()
    verdict = F.coalesce("_own", "_more", F.lit(otherwise)).alias("verdict")
    return out.select(*[F.col(f"row.`{c}`") for c in own], "host", "path", "rule", verdict, F.when(free, F.col("_reason")).alias("reason"))
