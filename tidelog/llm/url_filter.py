"""URL filtering by pattern rules that are indexed by their rarest literal token. DataFrame functions only.

Every rule carries the literal tokens that any url it matches must hold. A rule is filed under the one of its
tokens that the fewest urls of the table hold; a url looks up the rules of its own tokens, and only those run
their regular expressions. A rule without literal tokens is a candidate of every url.

Defined results: a null url, or one without "://", has host and path '' and the default verdict; equal urls get
equal verdicts; host, path, rule and verdict of the result take the place of columns of these names, and other columns
are returned as they are; without rules every url has the default verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Up to this many rules the index travels as a literal inside the plan; a longer list is joined as a table.
INLINE_RULES = 256
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`regex` runs on host + path; `tokens` are literals that every match holds as whole tokens; `label` is what
    the result's `rule` shows (None: a pattern of the method itself). The rule with the highest rank wins."""

    regex: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int = 0
    label: str | None = None


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with all its subdomains, and the start of the path; longer rules outrank shorter ones."""
    whole = re.findall(TOKEN, host.lower())
    # the path's last token may be cut off by the end of the rule, so only tokens that end inside it are literal
    whole += re.findall(r"(?<![A-Za-z0-9])[a-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}", verdict, tuple(dict.fromkeys(whole)), 1000 + len(host + path), host + path)


#: Rules of the contract.
CONTRACT_RULES = [
    host_rule("net", "/", "block"),
    host_rule("example.net", "/en/", "allow"),
    host_rule("example.com", "/de/", "block"),
    host_rule("org", "/fr/", "allow"),
]
#: Unwanted kinds of site, by words that stand as whole tokens in a host.
UNWANTED = ["porn", "xxx", "casino", "doubleclick", "adserver", "malware", "warez", "phishing"]
OWN_RULES = [Rule(rf"^(?:[^/]*[^/a-z0-9])?{w}(?:[^a-z0-9/][^/]*)?(?:/|$)", "block", (w,)) for w in UNWANTED]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first '://' up to '/', '?', '#' or the end; A-Z lower-cased) and path (then up to '?' or '#')."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return lower_ascii(host), path


def _tokens(df: DataFrame) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "host", lower_ascii(F.col("path"))), F.lit(f"({TOKEN})"), F.lit(1)))


def _filed(df: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; counts come from all urls. At most one number a token of the rules reaches the driver."""
    known = sorted({t for r in rules for t in r.tokens})
    held = F.filter(_tokens(df), lambda t: t.isin(known))
    counts = {r["t"]: r["n"] for r in df.select(F.explode(held).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()} if known else {}
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return filed


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """`df` with host, path, rule and verdict. Up to `inline` rules nothing is shuffled."""
    own = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    df = df.withColumn("__llm_url", F.col(url)).select(*own, "__llm_url")
    host, path = split_url(F.col("__llm_url"))
    df = df.select(*own, host.alias("host"), path.alias("path"))
    filed = _filed(df, rules)
    if len(rules) > inline:
        return _judge_joined(df, filed, default)
    everywhere = filed.pop("", [])
    at = F.concat("host", "path")

    def hit(r: Rule) -> Column:
        return F.when(at.rlike(r.regex), F.struct(F.lit(r.rank).alias("rank"), F.lit(r.verdict).alias("verdict"), F.lit(r.label).cast("string").alias("label")))

    # `when` is lazy: a rule's expression runs only on urls that hold its token
    hits = [F.when(F.array_contains("__llm_tokens", t), hit(r)) for t, rs in sorted(filed.items()) for r in rs] + [hit(r) for r in everywhere]
    none = F.lit(None).cast("struct<rank:int,verdict:string,label:string>")
    out = df.withColumn("__llm_tokens", _tokens(df)).withColumn("__llm_best", F.array_max(F.array_compact(F.array(*hits))) if hits else none)
    return out.select(*df.columns, F.col("__llm_best.label").alias("rule"), F.coalesce("__llm_best.verdict", F.lit(default)).alias("verdict"))


def _judge_joined(df: DataFrame, filed: dict[str, list[Rule]], default: str) -> DataFrame:
    """As many rules as memory on the driver holds: urls' distinct tokens meet the filed rules in a join that the
    optimiser broadcasts or shuffles by size; hot tokens are split by adaptive execution. Rules without tokens run as
    expressions of the scan: every url is their candidate, and none of them moves a row."""
    spark = df.sparkSession
    everywhere = filed.pop("", [])
    best_of = "struct<rank:int,verdict:string,label:string>"
    plain = [F.when(F.concat("host", "path").rlike(r.regex), F.struct(F.lit(r.rank).alias("rank"), F.lit(r.verdict).alias("verdict"), F.lit(r.label).cast("string").alias("label"))) for r in everywhere]
    found = F.array_max(F.array_compact(F.array(*plain))) if plain else F.lit(None).cast(best_of)
    index = spark.createDataFrame([(t, r.rank, r.verdict, r.label, r.regex) for t, rs in filed.items() for r in rs], "_token string, rank int, verdict string, label string, regex string")
    # equal urls share a row here, so repeated rows and any row identity cost nothing
    urls = df.select("host", "path").distinct()
    held = urls.select("host", "path", F.explode(_tokens(urls)).alias("_token"))
    best = (
        held.join(index, "_token")
        .where(F.expr("concat(host, path) rlike regex"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("rank", "verdict", "label")).alias("__llm_best"))
    )
    # null structs are passed over by greatest
    out = df.join(best, ["host", "path"], "left").withColumn("__llm_best", F.greatest(F.col("__llm_best").cast(best_of), found))
    return out.select(*df.columns, F.col("__llm_best.label").alias("rule"), F.coalesce("__llm_best.verdict", F.lit(default)).alias("verdict"))


#: Rules that are read from a table to the driver, which files them.
MOST_RULES = 1_000_000


def table_rules(rules: DataFrame, most: int = MOST_RULES) -> list[Rule]:
    """Host rules from a table of host, path and verdict, such as a block list; rows without a host or verdict are left out,
    repeats count once (of verdicts that differ, the greater text), and a null path counts as empty. A longer table raises."""
    rows = rules.where("host is not null and host <> '' and verdict is not null").groupBy(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"over {most} rules")
    return [host_rule(r["host"], r["path"], r["verdict"]) for r in sorted(got)]
