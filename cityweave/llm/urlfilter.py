"""URL filters: rules of hosts and paths, then a list of canonical URLs behind a blocked Bloom filter.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with its path; the longest
fitting rule decides. URLs that no rule fits are blocked if their canonical form is listed. The list's canonical URLs set
bits in blocks of 512 (eight words, a bit in each); the blocks, a table of `BLOCKS` rows at most whatever the length of
the list, are broadcast. Only URLs whose eight bits are all set go on to the exact hash join with the list, which takes out
the false positives. A longer list makes those more frequent, never wrong. All of it is column functions and joins.

The canonical form is the host (lower case, without `www.` and a default port), the path without slashes at its end, and
the query's parameters in order, without those that only track; scheme and fragment don't count.

One URL may hold any share of the rows: the rows that reach the exact join are dealt over `SALTS` copies of the list, and
the list is made distinct within tasks before it is shuffled.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and is never listed, so it is
allowed; it is no entry of a list either. Of rules of one length that of the longer host decides, then the ASCII-least, and
block before allow. Repeated rows come back as often as they occur; an empty list blocks nothing; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the filter at most: 2^18 blocks of 64 bytes are 16 MB of bits, about 40 MB as a broadcast relation.
BLOCKS = 1 << 18
WORDS = 8
#: Copies of the list in the exact join.
SALTS = 8
#: Rules are literals of the plan; longer lists belong into the table of listed URLs.
MOST_RULES = 1000
#: The rules of the registered query, (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Parameters that only say where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The form that lists and pages share; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)?$", ""), r"^www\.", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), rest))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the rule that decides; null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules, {MOST_RULES} at most: a longer list belongs into the listed URLs")
    if any(v not in ("allow", "block") for _, _, v in rules):
        raise ValueError("a rule's verdict is allow or block")
    ordered = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0], r[1], r[2] != "block"))
    kind = "array<struct<host:string,path:string,verdict:string>>"
    table = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in ordered)).cast(kind)
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("rule"), first["verdict"].alias("verdict")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """The one bit of a word that the key sets: six bits of a second hash say which."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64(key, F.lit(word // 4)), 6 * (word % 4) + 3).bitwiseAND(63).cast("int"))


def bloom_blocks(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """block, w0 .. w7: the words of each block that has a key; at most `blocks` rows."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*(F.bit_or(_bit(F.col(key), w)).alias(f"w{w}") for w in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", blocks: int = BLOCKS, salts: int = SALTS) -> DataFrame:
    """id, host, path, rule, verdict, and listed: whether the canonical URL is on the list, null where a rule decided."""
    keys = listed.select(canonical(F.col(listed_col)).alias("key")).where("key is not null").distinct()
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("key", F.when(F.col("found").isNull(), F.col("key"))).withColumn("block", _block(F.col("key"), blocks))
    rows = rows.join(F.broadcast(bloom_blocks(keys, "key", blocks)), "block", "left")
    every = F.lit(True)
    for w in range(WORDS):
        every &= F.col(f"w{w}").bitwiseAND(_bit(F.col("key"), w)) != 0
    rows = rows.withColumn("possible", F.coalesce(every & F.col("key").isNotNull(), F.lit(False))).select(id_col, "host", "path", "key", "found", "possible")
    passed = rows.where(~F.col("possible")).withColumn("listed", F.when(F.col("found").isNull(), F.lit(False)))
    salted = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("hit")).hint("shuffle_hash")
    maybe = rows.where("possible").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    exact = maybe.join(salted, ["key", "salt"], "left").withColumn("listed", F.coalesce("hit", F.lit(False)))
    out = passed.select(id_col, "host", "path", "found", "listed").unionByName(exact.select(id_col, "host", "path", "found", "listed"))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(id_col, "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "listed")
