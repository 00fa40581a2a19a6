"""URL filter: host rules first, else trust and distrust spread over links.

Trust starts at the hosts of pages that a rule allows and follows links by
personalised PageRank; distrust starts at the hosts of blocked pages and
follows links backwards, to the hosts that link there.  A host is blocked
where distrust exceeds ``bias`` times trust.  All of it is DataFrame
operations; vectors hold only the hosts that mass has reached.  Mass is passed
on until a round reaches no new host and moves less than ``TOLERANCE``.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.session import discard, store

DAMPING = 0.85
#: Of a total of 1: mass that a round moves at most when spreading ends; what would still come is 1 / (1 - DAMPING) times that.
TOLERANCE = 1e-6
BIAS = 1.0


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(found > 0, url.substr(found + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (name, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                   F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
            for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    none = F.lit(None).cast("struct<name:string,verdict:string>")
    return F.coalesce(*fits, none)


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, links): links in ``html`` from a page's ``host`` to other hosts."""
    targets = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"'\s<>/?#]+)"""), F.lit(1))
    return pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst")) \
        .withColumn("dst", ascii_lower(F.col("dst"))).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(seeds: DataFrame, links: DataFrame, source: str, target: str, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, mass): personalised PageRank of ``seeds`` (host, weight summing to 1) along ``links``.

    A host passes ``damping`` of its mass on by its links' shares; what has no
    link to follow is lost.  Every host that links lead to from a seed gets
    mass, however many links away (until a double can't hold it).
    """
    total = links.groupBy(source).agg(F.sum("links").alias("total"))
    flow = store(links.join(total, source).select(F.col(source).alias("host"), F.col(target).alias("to"),
                                                  (F.lit(damping) * F.col("links") / F.col("total")).alias("share")))
    start = seeds.select("host", ((1 - damping) * F.col("weight")).alias("mass"))
    now = store(start.withColumn("moving", F.col("mass")))  # moving: what came in the last round
    hosts, more = now.count(), not flow.isEmpty()
    while more:
        moved = now.where("moving > 0").join(flow, "host").groupBy("to").agg(F.sum(F.col("moving") * F.col("share")).alias("moving"))
        after = store(now.select("host", "mass", F.lit(0.0).alias("moving")).union(moved.select("to", "moving", "moving"))
                      .groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("moving").alias("moving")))
        discard(now)
        now = after
        moving, reached = now.agg(F.coalesce(F.sum("moving"), F.lit(0.0)), F.count("*")).first()
        more, hosts = reached > hosts or moving >= tolerance, reached
    return now.select("host", "mass")


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str = "html", id_col: str = "page_id",
          damping: float = DAMPING, tolerance: float = TOLERANCE, bias: float = BIAS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page.

    Pages without host (null url or none with ``://``) have empty host and
    path; like hosts that neither trust nor distrust reaches, they are
    allowed.  Null html has no links.  Repeated rows stay, and count as
    pages of their own in seeds and links; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")) \
        .select("page_id", host.alias("host"), path.alias("path"), "html")
    own = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    links = store(host_links(own))
    ruled = store(own.where("fit is not null").groupBy("host").agg(
        F.count_if(F.col("fit.verdict") == "allow").alias("allow"), F.count_if(F.col("fit.verdict") == "block").alias("block")))
    sums = ruled.agg(F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0)).alias("block")).first()

    def mass(kind, source, target):
        seeds = ruled.where(F.col(kind) > 0).select("host", (F.col(kind) / F.lit(max(sums[kind], 1))).alias("weight"))
        return spread(seeds, links, source, target, damping, tolerance)

    trust = mass("allow", "src", "dst").withColumnRenamed("mass", "trust")
    distrust = mass("block", "dst", "src").withColumnRenamed("mass", "distrust")
    bad = distrust.join(trust, "host", "left").where(F.col("distrust") > bias * F.coalesce("trust", F.lit(0.0))) \
        .select("host", F.lit(True).alias("bad"))
    return own.select("page_id", "host", "path", "fit").join(bad, "host", "left").select(
        "page_id", "host", "path", F.col("fit.name").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
