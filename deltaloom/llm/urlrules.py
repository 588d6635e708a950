"""URL filter rules, indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import ship

#: Rules that go out with the code; a larger set is applied in several passes of this size.
RULES_AT_ONCE = 100_000


@dataclass(frozen=True)
class Rule:
    """A rule on host + path. pattern: regular expression; literals: tokens without which it cannot match."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int
    listed: bool = True


def host_path_rule(name: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains if the path starts with the rule's; rank: length, so the longest wins."""
    host, slash, path = name.partition("/")
    literals = tuple(t for t in re.split(r"\W+", host) if t)
    # The last token of the path may go on in the url, so it is no literal unless a separator follows it.
    literals += tuple(t for t in re.findall(r"(?<!\w)\w+(?=\W)", slash + path) if t)
    return Rule(name, verdict, rf"(?s)\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", literals, len(name))


#: Fixed rules of the contract.
RULES = (
    host_path_rule("com/", "allow"),
    host_path_rule("example.com/en/", "block"),
    host_path_rule("www.example.com/en/", "allow"),
    host_path_rule("net/es/", "block"),
    host_path_rule("net/fr/", "block"),
)


# Fixed values of the method's own patterns: what a host has as a part between dots and hyphens, what a path has as a whole
# step (an ending may follow), and how a path ends. They block where no rule decides.
HOST_PARTS = ("ads", "adult", "bets", "bonus", "casino", "malware", "phishing", "pills", "poker", "porn", "spam", "torrents", "tracker", "viagra", "warez", "xxx")
PATH_STEPS = ("adserver", "banner", "cart", "cgi-bin", "checkout", "login", "logout", "register", "signin", "signup", "unsubscribe", "wp-admin", "wp-login", "xmlrpc")
PATH_ENDS = ("apk", "dmg", "exe", "iso", "msi", "torrent")
LOWEST = -(1 << 30)


def pattern(name: str, expression: str, verdict: str = "block") -> Rule:
    """A pattern rule on host and path; it ranks below every host/path rule, the longest name first."""
    return Rule(name, verdict, expression, tuple(re.findall(r"\w+", name)), LOWEST + len(name), False)


def host_part(word: str) -> Rule:
    return pattern(word, rf"(?s)\A(?:[^/]*[.\-])?{re.escape(word)}(?:[.\-][^/]*)?(?:/|\Z)")


def path_step(word: str) -> Rule:
    return pattern(f"/{word}", rf"(?s)\A[^/]*/(?:.*/)?{re.escape(word)}(?:[/.]|\Z)")


def path_end(word: str) -> Rule:
    return pattern(f".{word}", rf"(?s)\A[^/]*/.*\.{re.escape(word)}\Z")


PATTERNS = (*map(host_part, HOST_PARTS), *map(path_step, PATH_STEPS), *map(path_end, PATH_ENDS))


def index_rules(rules) -> dict[str, list[Rule]]:
    """Rules by their literal that fewest rules share (ties: the longer, then the first in order); key '' has those without one."""
    shared: dict[str, int] = {}
    for r in rules:
        for t in set(r.literals):
            shared[t] = shared.get(t, 0) + 1
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.literals, key=lambda t: (shared[t], -len(t), t), default=""), []).append(r)
    return index


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules=RULES, patterns=PATTERNS, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of pages.

    The tokens of host and path fetch candidate rules from the index, and only those run their expressions; the rule of the
    highest rank that matches decides (ties: the smaller name). Patterns go through the same index and decide where no rule
    fits; rule is null then, and pattern names the one that matched. Where neither matches the verdict is `otherwise`. A null
    url or one without `://` has empty host and path, and no rule fits. Null or repeated page_ids are kept. Other columns
    are ignored. Rules beyond RULES_AT_ONCE are applied in passes, each with an index of its own.
    """
    ship(pages.sparkSession)
    rules = [*rules, *patterns]
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(2 * LOWEST).cast("long").alias("rank"), F.lit(None).cast("string").alias("pattern"))
    for k in range(0, len(rules), RULES_AT_ONCE):
        out = out.mapInArrow(_one_pass(rules[k : k + RULES_AT_ONCE]), "page_id long, host string, path string, rule string, verdict string, rank long, pattern string")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"), "pattern")


def _one_pass(rules):
    def run(batches):
        import pyarrow as pa

        index = {t: [(re.compile(r.pattern).match, r) for r in rs] for t, rs in index_rules(rules).items()}
        always, tokens, known = index.pop("", []), re.compile(r"\w+").findall, index.keys()
        for batch in batches:
            cols = batch.to_pydict()
            for i, (host, path) in enumerate(zip(cols["host"], cols["path"])):
                url = host + path
                best = (-cols["rank"][i], cols["rule"][i] or cols["pattern"][i] or "")
                for t in [None, *(known & set(tokens(url)))]:
                    for fits, r in always if t is None else index[t]:
                        if (-r.rank, r.name) < best and fits(url):
                            best = (-r.rank, r.name)
                            cols["rule"][i], cols["pattern"][i] = (r.name, None) if r.listed else (None, r.name)
                            cols["verdict"][i], cols["rank"][i] = r.verdict, r.rank
            yield pa.RecordBatch.from_pydict(cols, schema=batch.schema)

    return run
