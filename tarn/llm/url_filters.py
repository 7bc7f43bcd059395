"""URL filters: pattern rules indexed by their rarest literal token.

A url is split into alphanumeric tokens. Each rule is filed under one token that
every url it fits must contain: the one that the fewest urls have. A url looks
its own tokens up in that index and runs regular expressions only for the rules
it finds there. Up to ``IN_PLAN`` rules the index is one literal (a hash table of
nested arrays keyed by CRC-32), so judging is a projection: no join, no shuffle.
More rules are a table that distinct urls meet by token, and the verdicts go back to
their rows by url. No Python runs on executors.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that travel to the executors inside the plan; more are joined.
IN_PLAN = 2000
#: A rule without any whole token is filed here; every url looks this up.
ANY = "*"

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The method's own verdict where no listed rule fits: block hosts that have one of these words as a token.
SPAM_WORDS = ("casino", "poker", "viagra", "xxx", "porn", "jackpot", "payday")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path. ``weight``: of several that fit, the heaviest wins, then the greatest name."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def prefix_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and all its subdomains where the path begins as given."""
    host, slash, path = rule.partition("/")
    host, path = host.lower(), slash + path
    # a run of letters and digits counts as a token only where the rule itself shows that it ends
    whole = re.findall(r"[A-Za-z0-9]+", host) if path else re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", host)
    whole += re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{_quote(host + path)}", tuple(dict.fromkeys(whole)), len(rule))


def word_rule(verdict: str, word: str) -> Rule:
    """Fits hosts of which ``word`` is a token; lighter than every prefix rule."""
    return Rule(f"~{word}", verdict, rf"(?s)^(?:[^/]*[^A-Za-z0-9/])?{_quote(word)}(?:[^A-Za-z0-9].*)?$", (word,), 0)


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", s)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(target, "[^A-Za-z0-9]+"))


def token_counts(df: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """Urls that hold each literal token of the rules; at most as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    host, path = split_url(F.col(url))
    every = F.explode(_tokens(F.concat(host, path)))
    if len(wanted) <= IN_PLAN:
        found = df.select(F.explode(F.array_intersect(_tokens(F.concat(host, path)), F.array(*map(F.lit, wanted)))).alias("t"))
    else:
        found = df.select(every.alias("t")).join(_table(df.sparkSession, [(t,) for t in wanted], "t string"), "t")
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table from the driver's rows; Spark decides by its size whether to broadcast it."""
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema)


_RULE = "token string, rule string, verdict string, pattern string, weight int"


def judge(df: DataFrame, url: str = "url", rules: list[Rule] | None = None, default: str = "allow", counts: dict[str, int] | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``candidates`` (rules whose expression ran).

    Null and malformed urls have an empty host and path, no rule and the default
    verdict. Columns of ``df`` with those names are replaced, others kept. Repeated
    rows are judged alike; urls of any length are judged whole; an empty table gives
    no row. Of several fitting rules the heaviest wins, then the greatest name.
    """
    rules = default_rules() if rules is None else rules
    counts = token_counts(df, url, rules) if counts is None else counts
    filed = [{"token": min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=ANY), "rule": r.name, "verdict": r.verdict, "pattern": r.pattern, "weight": r.weight} for r in rules]
    host, path = split_url(F.col(url))
    out = df.withColumns({"host": host, "path": path})
    out = _in_plan(out, filed) if len(rules) <= IN_PLAN else _joined(out, filed)
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))}).drop("_best")


def _in_plan(df: DataFrame, filed: list[dict]) -> DataFrame:
    """Add ``candidates`` and ``_best``, by an index in the plan."""
    size = 1 << max(1, len(filed).bit_length())
    table: list[list[dict]] = [[] for _ in range(size)]
    for r in filed:
        table[zlib.crc32(r["token"].encode()) % size].append(r)
    index = F.from_json(F.lit(json.dumps(table)), "array<array<struct<" + _RULE.replace(" ", ":").replace(",:", ",") + ">>>")
    target = F.concat("host", "path")
    slot = lambda t: F.get(index, (F.crc32(t.cast("binary")) % size).cast("int"))
    found = F.flatten(F.transform(F.array_append(_tokens(target), F.lit(ANY)), lambda t: F.filter(slot(t), lambda e: e["token"] == t)))
    fits = F.filter(found, lambda e: F.regexp_like(target, e["pattern"]))
    best = F.array_max(F.transform(fits, lambda e: F.struct(e["weight"].alias("weight"), e["rule"].alias("rule"), e["verdict"].alias("verdict"))))
    return df.withColumns({"candidates": F.size(found), "_best": best})


def _joined(df: DataFrame, filed: list[dict]) -> DataFrame:
    """As ``_in_plan``, by joins: distinct urls meet the rules of their tokens, with partial combination before verdicts are gathered by url."""
    table = _table(df.sparkSession, [tuple(r[c.split()[0]] for c in _RULE.split(", ")) for r in filed], _RULE)
    target = F.concat("host", "path")
    urls = df.select(target.alias("_u")).distinct()
    met = urls.select("_u", F.explode(F.array_append(_tokens(F.col("_u")), F.lit(ANY))).alias("token")).join(table, "token")
    best = F.max(F.when(F.expr("regexp_like(_u, pattern)"), F.struct("weight", "rule", "verdict")))
    found = met.groupBy("_u").agg(F.count(F.lit(1)).cast("int").alias("_n"), best.alias("_best"))
    out = df.withColumn("_t", target).join(found, F.col("_t") == F.col("_u"), "left")
    return out.withColumn("candidates", F.coalesce("_n", F.lit(0))).drop("_t", "_u", "_n")


def default_rules() -> list[Rule]:
    return [*(prefix_rule(v, r) for v, r in RULES), *(word_rule("block", w) for w in SPAM_WORDS)]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` with its host, path, rule and verdict."""
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", F.when(~F.col("rule").startswith("~"), F.col("rule")).alias("rule"), "verdict")


SQL = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host, '(^|[^A-Za-z0-9])(casino|poker|viagra|xxx|porn|jackpot|payday)([^A-Za-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM d
"""
