"""URL filter: pattern rules indexed by their rarest literal token; URL tokens fetch candidate rules, and only those run regular expressions.

The literals come from the pattern itself: tokens that every match holds whole. Token frequencies are counted over all
URLs, so a rule hangs on the token that fewest of them hold. Rules go to the tasks in blocks of `block_rules`, one pass
over the URLs each, so what is sent has a fixed size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as codes
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.shared import slices, without

TOKEN = re.compile(r"[a-z0-9]+")
EDGE, ANY = "\x00", "\x01"  # in a pattern's outline: no letter or digit can stand here; anything can


def _may_be_alnum(members: list) -> bool:
    """Whether a character set can match an ASCII letter or digit."""
    negated = members[0][0] is codes.NEGATE
    for c in map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        held = any(arg == c if op is codes.LITERAL else arg[0] <= c <= arg[1] if op is codes.RANGE else op is codes.CATEGORY for op, arg in members if op is not codes.NEGATE)
        if held != negated or any(op is codes.CATEGORY for op, _ in members):
            return True
    return False


def _solid(outline: str, at: int) -> bool:
    """Whether what stands there is no letter or digit."""
    return bool(outline) and outline[at] != ANY and not outline[at].isalnum()


def outline(pattern: list) -> str:
    """A parsed pattern as the characters every match has, EDGE and ANY."""
    out = ""
    for op, arg in pattern:
        if op is codes.LITERAL:
            out += chr(arg).lower() if chr(arg) not in (EDGE, ANY) else ANY
        elif op is codes.AT:
            out += EDGE
        elif op is codes.IN:
            out += ANY if _may_be_alnum(arg) else EDGE
        elif op is codes.SUBPATTERN:
            out += outline(arg[3])
        elif op is codes.BRANCH:
            ways = [outline(p) for p in arg[1]]
            out += EDGE if all(len(w) == 1 and _solid(w, 0) for w in ways) else ANY
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT):
            low, high, inner = arg
            own = outline(inner)
            if low == high == 1:
                out += own
            elif low:
                out += (EDGE if _solid(own, 0) and _solid(own, -1) and len(own) == 1 else ANY)
            else:  # may be absent: then what came before it stands here
                out += ANY + (EDGE if _solid(own, -1) and _solid(out, -1) else ANY)
        else:
            out += ANY
    return out


def _ignores_case(pattern: list) -> bool:
    """Whether a group of the parsed pattern sets the flag for itself."""
    for op, arg in pattern:
        parts = [arg[3]] if op is codes.SUBPATTERN else arg[1] if op is codes.BRANCH else [arg[2]] if op in (codes.MAX_REPEAT, codes.MIN_REPEAT) else []
        if (op is codes.SUBPATTERN and arg[1] & re.IGNORECASE) or any(_ignores_case(list(p)) for p in parts):
            return True
    return False


def literals(pattern: str) -> tuple[str, ...]:
    """Tokens that every match holds whole. A pattern without any is refused: no token could fetch it."""
    parsed = parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE or _ignores_case(list(parsed)):
        raise ValueError(f"{pattern!r} ignores case, so letters beyond ASCII could match it and no token would fetch it")
    found = outline(list(parsed))
    tokens = tuple(m.group() for m in TOKEN.finditer(found) if m.start() and m.end() < len(found) and found[m.start() - 1] != ANY and found[m.end()] != ANY and not found[m.start() - 1].isalnum() and not found[m.end()].isalnum())
    if not tokens:
        raise ValueError(f"no token stands whole in every match of {pattern!r}")
    return tokens


@dataclass(frozen=True)
class Rule:
    """A verdict for URLs whose host and path, joined, match `pattern`. Among matching rules the one of greatest weight wins, ties by name."""

    name: str
    verdict: str
    pattern: str
    weight: int

    @cached_property
    def literals(self) -> tuple[str, ...]:
        return literals(self.pattern)


def host_path_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`; the longer rule wins."""
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host + path)}", 1000 + len(host + path))


RULES = (
    host_path_rule("block", "com", "/en/"),
    host_path_rule("allow", "example.com", "/en/7"),
    host_path_rule("allow", "net", "/de/"),
    host_path_rule("block", "example.net", "/de/8"),
    host_path_rule("block", "org", "/es/"),
)
#: Words that block a URL in which they stand between marks, where no host rule fits
WORDS = (
    "adult-x", "betting", "bets", "camgirls", "casino", "cialis", "escorts", "gambling", "hentai", "jackpots", "levitra", "lottery", "malware", "nudes", "payday-loans", "phishing", "pills", "poker", "porn",
    "porno", "replica-watches", "roulette", "sexcam", "slots", "sportsbet", "torrents", "viagra", "warez", "xxx",
)
#: What the method itself says where no host rule fits: weights under those of host rules, no name in the result.
PATTERNS = (Rule("", "block", r"^(?:[^/]*\.)?spam-[a-z0-9-]+\.", 9),) + tuple(Rule("", "block", rf"(?:^|[./_-]){re.escape(word)}(?:[./_-]|$)", 8) for word in WORDS)


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ? or # or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rare_token(rules: list[Rule], counts: dict[str, int]) -> list[tuple[str, Rule]]:
    """Each rule with the literal that fewest URLs hold."""
    return [(min(r.literals, key=lambda t: (counts.get(t, 0), t)), r) for r in rules]


def _blocks(rules: tuple[Rule, ...] | DataFrame, block_rules: int) -> Iterator[list[Rule]]:
    if not isinstance(rules, DataFrame):
        yield from (list(rules[at : at + block_rules]) for at in range(0, len(rules), block_rules))
        return
    n = slices(rules.count(), block_rules)
    for k in range(n):
        own = rules.filter(F.pmod(F.xxhash64("name", "pattern"), F.lit(n)) == k)
        yield [Rule(r["name"] or "", r["verdict"], r["pattern"], r["weight"]) for r in own.select("name", "verdict", "pattern", "weight").collect()]  # about block_rules


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES + PATTERNS, default: str = "allow", block_rules: int = 100_000) -> DataFrame:
    """All rows and columns of pages, plus host, path, rule and verdict; these replace columns of the same names.

    rules may be a table (name, verdict, pattern, weight); a pattern must hold a literal token. Null URLs and those without
    :// have empty host and path and get the default verdict. The rule is null where the verdict came from an unnamed
    pattern or the default. Repeated rows are judged alike, URLs of any length whole; no rows, no result.
    """
    weight = "_weight"
    while weight in (c.lower() for c in pages.columns):
        weight += "_"
    keep = [pages[c] for c in without(pages, "host", "path", "rule", "verdict")]
    url = pages["url"].cast("string")
    rows = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    tokens = rows.select(F.explode(F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))).alias("token"))
    rows = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), weight: F.lit(-1)})
    for block in _blocks(rules, block_rules):
        wanted = pages.sparkSession.createDataFrame([(t,) for t in sorted({t for r in block for t in r.literals})], "token string")
        held = tokens.join(F.broadcast(wanted), "token", "left_semi")  # the literals of one block, before anything is shuffled
        counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = _judged(rows, rare_token(block, counts), weight)
    return rows.drop(weight)


def _judged(rows: DataFrame, indexed: list[tuple[str, Rule]], weight_column: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(indexed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token = defaultdict(list)
        for token, r in shared.value:
            by_token[token].append((r.weight, r.name, r.verdict, re.compile(r.pattern, re.DOTALL).search))
        for batch in batches:
            names = batch.schema.names
            columns = list(batch.columns)
            at = {n: names.index(n) for n in ("host", "path", "rule", "verdict", weight_column)}
            rule, verdict, weight = (columns[at[n]].to_pylist() for n in ("rule", "verdict", weight_column))
            for i, (host, path) in enumerate(zip(columns[at["host"]].to_pylist(), columns[at["path"]].to_pylist(), strict=True)):
                key = host + path
                candidates = [r for t in set(TOKEN.findall(key.lower())) if t in by_token for r in by_token[t]]
                for own, name, says, search in sorted(candidates, key=lambda r: (-r[0], r[1])):
                    if own <= weight[i]:
                        break
                    if search(key):
                        rule[i], verdict[i], weight[i] = name or None, says, own
                        break
            for n, values in (("rule", rule), ("verdict", verdict), (weight_column, weight)):
                columns[at[n]] = pa.array(values, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)
