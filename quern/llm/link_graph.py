"""URL filters: rules by host and path, and for the rest trust and distrust spread over the graph of hosts.

Trust is a personalised PageRank from trusted hosts along links, distrust one from blocked hosts against them (who links
to a blocked host is suspect). Both run in one pass a round over the aggregated host edges, and every host is judged by
the share of distrust in all that is known of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, tidy
from quern.plans.models import sized

_UPPER = {c: c + 32 for c in range(65, 91)}
_LINK = re.compile(r"""(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Rules that one run holds in every task, at most.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def of(verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return Rule(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def parse(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? # or the end."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def _table(rules: list[Rule]) -> dict[str, list[Rule]]:
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    out: dict[str, list[Rule]] = {}
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict)):
        out.setdefault(r.host, []).append(r)
    return out


def longest(table: dict[str, list[Rule]], host: str, path: str) -> Rule | None:
    """The longest rule that fits; none fits an empty host."""
    best, name = None, host
    while name:
        for r in table.get(name, ()):
            if path.startswith(r.path):
                if best is None or len(r.text) > len(best.text):
                    best = r
                break
        name = name.partition(".")[2]
    return best


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, ruled) of every page; rule and ruled are null where no rule fits."""
    table = pages.sparkSession.sparkContext.broadcast(_table(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [parse(x.as_py()) for x in b.column(1)]
            hit = [longest(table.value, h, p) for h, p in at]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[i] for x in at], pa.string()) for i in (0, 1)), pa.array([r and r.text for r in hit], pa.string()), pa.array([r and r.verdict for r in hit], pa.string())],
                ["page_id", "host", "path", "rule", "ruled"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(tidy(run), "page_id long, host string, path string, rule string, ruled string")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from one host to another, over whole pages. Links within a host and those without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[tuple, int] = {}
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                src = parse(u)[0]
                if not src or not h:
                    continue
                for m in _LINK.finditer(h):
                    link = next(x for x in m.groups("") if x or x is m.groups("")[-1]).strip()
                    dst = parse(link if "://" in link else "x:" + link if link.startswith("//") else None)[0]
                    if dst and dst != src:
                        count[src, dst] = count.get((src, dst), 0) + 1
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([count[k] for k in keys], pa.int64())], ["src", "dst", "n"])

    found = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(tidy(run), "src string, dst string, n long")
    return found.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust): hosts has (host, good, bad), the seeds' weights, null as 0; edges (src, dst, n).

    Both are personalised PageRanks over the mass that restarts: trust = good + damping * what links bring, each host
    handing its trust to those it links to by n; distrust goes against the links, from a host to those that link to it.
    Neither is ever less than its seed. Mass at hosts without a way on ends there. The loop ends when no score moves by
    more than ``tolerance`` (for which log(tolerance) / log(damping) rounds are enough of unit seeds), or after ``rounds``
    if given. Links within a host, null hosts and those without n > 0 are left out; hosts that only edges name take part
    without seeds; hosts and edges that are repeated add up.
    """
    edges = edges.where("src <> dst and n > 0").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    edges = cut(edges)
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = cut(edges.join(out, "src").join(into, "dst").select("src", "dst", (damping * F.col("n") / F.col("out")).alias("on"), (damping * F.col("n") / F.col("into")).alias("back")))
    named = shares.select(F.col("src").alias("host")).unionAll(shares.select(F.col("dst").alias("host"))).distinct()
    seeds = hosts.where("host is not null").groupBy("host").agg(F.sum(F.coalesce("good", F.lit(0.0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0.0))).alias("bad"))
    nodes = cut(seeds.join(named, "host", "full").na.fill(0))
    state, done = nodes.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")), 0
    while rounds is None or done < rounds:
        given = shares.join(state, shares.src == state.host).select(F.col("dst").alias("host"), (F.col("trust") * F.col("on")).alias("t"), F.lit(0.0).alias("d"))
        given = given.unionAll(shares.join(state, shares.dst == state.host).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d")))
        got = given.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = nodes.join(got, "host", "left").join(state, "host")
        trust, distrust = (F.col(seed) + F.coalesce(brought, F.lit(0.0)) for seed, brought in (("good", "t"), ("bad", "d")))
        moved = F.greatest(F.abs(trust - F.col("trust")), F.abs(distrust - F.col("distrust")))
        new = cut(new.select("host", trust.alias("trust"), distrust.alias("distrust"), moved.alias("moved")))
        state, done = new.select("host", "trust", "distrust"), done + 1
        if (new.agg(F.max("moved")).first()[0] or 0) <= tolerance:
            break
    return state


def suspicion(trust, distrust, unknown):
    """The share of distrust in all that is known of a host: its trust, its distrust, and the share of its pages that no
    rule fits. A host without links gets the share of its pages that rules block."""
    return distrust / F.greatest(trust + distrust + unknown, F.lit(1e-300))


def filter_urls(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, edges: DataFrame | None = None, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page.

    A host's seeds are the shares of its pages that rules allow (trusted) and block. Pages that no rule fits are blocked
    where their host's ``suspicion`` is above ``threshold``. A host's distrust is its own seed at least, however many link
    to it, so that links can clear it only by the trust that they bring. ``edges`` (src, dst, n) stand in place of the
    pages' own links between hosts (see ``host_edges``). Pages without a host (null urls too) are allowed; repeated rows
    count and are answered one by one; an empty table gives no rows.
    """
    found = cut(judged(pages, rules))
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    seeds = cut(found.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    scores = propagate(seeds, host_edges(pages) if edges is None else edges, **how).join(seeds, "host")
    scores = scores.select("host", "trust", "distrust", suspicion(F.col("trust"), F.col("distrust"), 1 - F.col("good") - F.col("bad")).alias("suspicion"))
    scores = cut(scores)
    method = F.when(F.col("suspicion") > threshold, "block").otherwise("allow")
    return found.join(sized(scores), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
