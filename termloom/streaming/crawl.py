"""Crawling an offline page store level by level.

A page store has (url, status, content_type, body, final_url) and may have ``location``, where a
redirect leads. Each level of the breadth-first order is one set of joins: the frontier against
the rules of its origins and the store, extraction, links against the addresses already known.
Requests to a host are a delay apart, that of its robots.txt or the option's, in the crawl's own
time, which goes on from level to level; a page budget takes what is due first. State is tables
like those of a crawler's database: urls, documents, links, requests and counts.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.analysis import AnalysisConfig
from termloom.functions.web import content_hash, extracted, host_allowed, host_of, normalized_url, robots_for, rule_regex
from termloom.operators.index import build_index
from termloom.plans.storage import cut
from termloom.sources.files import indexed_text

URLS = "url string, depth int, place long, status string, reason string"
DOCUMENTS = "url string, depth int, place long, title string, text string, content_hash string"
LINKS = "from_url string, to_url string, position int, anchor string"
REQUESTS = "url string, host string, at double"
HTML_TYPES = ("text/html", "application/xhtml+xml")
#: Statuses that send on to another address.
REDIRECTS = (301, 302, 303, 307, 308)


@dataclass(frozen=True)
class CrawlOptions:
    seeds: tuple[str, ...]
    allowlist: tuple[str, ...]
    max_pages: int = 100
    max_depth: int = 3
    user_agent: str = "termloom"
    delay: float = 0.0
    max_redirects: int = 5
    max_bytes: int = 1 << 20

    def __post_init__(self) -> None:
        if not self.seeds or not self.allowlist:
            raise ValueError("a crawl needs seeds and an allowlist")
        if self.max_pages < 1 or self.max_depth < 0:
            raise ValueError("max_pages or max_depth is out of range")
        if self.delay < 0 or self.max_redirects < 0 or self.max_bytes < 1:
            raise ValueError("delay, max_redirects or max_bytes is out of range")


@dataclass
class CrawlState:
    urls: DataFrame
    documents: DataFrame
    links: DataFrame
    requests: DataFrame  # url, host, and when it was asked for, in seconds of the crawl
    counts: dict[str, int] = field(default_factory=dict)


    def save(self, path: str) -> None:
        """Write the state under ``path``, to be gone on with in another session."""
        for name in ("urls", "documents", "links", "requests"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.urls.sparkSession
        spark.createDataFrame([(json.dumps(self.counts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/counts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CrawlState:
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("urls", "documents", "links", "requests")]
        return CrawlState(*tables, json.loads(spark.read.text(f"{path}/counts").first()["value"]))


def upsert(known: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` with the rows of ``fresh`` in the place of those with the same keys; of rows of
    ``fresh`` with the same keys the greatest stays."""
    last = fresh.groupBy(*keys).agg(F.max(F.struct(*[c for c in fresh.columns if c not in keys])).alias("__row"))
    last = last.select(*keys, "__row.*").select(*known.columns)
    return known.join(last.select(*keys), keys, "left_anti").select(*known.columns).unionByName(last)


def enqueue(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of ``fresh`` whose url is not known; the first by place stays."""
    first = Window.partitionBy("url").orderBy("place")
    once = fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return once.join(known.select("url"), "url", "left_anti")


def pending(urls: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending addresses in breadth-first order."""
    out = urls.where("status = 'pending'").orderBy("depth", "place")
    return out.limit(limit) if limit is not None else out


def status_counts(urls: DataFrame) -> DataFrame:
    return urls.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def link_stats(links: DataFrame) -> DataFrame:
    return links.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("from_url").alias("sources"), F.countDistinct("to_url").alias("targets"))


def insert_links(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """New (from_url, to_url, position), once each."""
    keys = ["from_url", "to_url", "position"]
    return fresh.where("to_url is not null").dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


def mark_duplicates(documents: DataFrame) -> DataFrame:
    """Adds ``duplicate_of``: the first arrival (depth, place) of a content hash owns it."""
    first = documents.groupBy("content_hash").agg(F.min(F.struct("depth", "place", "url")).alias("o")).select("content_hash", F.col("o.url").alias("owner"))
    joined = documents.join(first, "content_hash")
    return joined.withColumn("duplicate_of", F.when(F.col("owner") != F.col("url"), F.col("owner"))).drop("owner")


def indexable(documents: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Owners of their content in url order."""
    out = documents.where("duplicate_of is null").orderBy("url").offset(offset)
    return out.limit(limit) if limit is not None else out


def due_times(frontier: DataFrame, delay: float | Column, since: Column | float = 0.0) -> DataFrame:
    """Adds ``ready_at``: each host's requests are ``delay`` seconds apart, the first at ``since``."""
    per_host = Window.partitionBy("host").orderBy("depth", "place")
    hosts = frontier.withColumn("host", host_of(F.col("url")))
    gap, first = (x if isinstance(x, Column) else F.lit(float(x)) for x in (delay, since))
    return hosts.withColumn("ready_at", first + (F.row_number().over(per_host) - 1) * gap)


RULES_TYPE = "struct<rules:array<struct<allow:boolean,size:int,regex:string>>,delay:double>"


def _origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/]+)", 1)


def origin_rules(store: DataFrame, agent: str, origins: DataFrame) -> DataFrame:
    """(origin, r): what each origin's robots.txt means for an agent, read once per origin."""

    @F.pandas_udf(RULES_TYPE)
    def read(status: pd.Series, body: pd.Series) -> pd.DataFrame:
        out = []
        for code, text in zip(status, body, strict=True):
            group = robots_for(None if pd.isna(code) else int(code), text).group_for(agent)
            rules = [{"allow": allow, "size": len(p), "regex": rule_regex(p)} for allow, p in group.rules] if group else []
            out.append((rules, group.delay if group else None))
        return pd.DataFrame(out, columns=["rules", "delay"])

    texts = store.select(F.col("url").alias("robots_url"), "status", "body")
    joined = origins.withColumn("robots_url", F.concat("origin", F.lit("/robots.txt"))).join(texts, "robots_url", "left")
    return joined.select("origin", read("status", "body").alias("r"))


def path_allowed(rules: Column, path: Column) -> Column:
    """The longest rule that matches decides; allowing wins among equals."""
    met = F.filter(rules, lambda r: F.regexp(path, r["regex"]))
    return F.coalesce(F.array_max(F.transform(met, lambda r: F.struct(r["size"], r["allow"])))["allow"], F.lit(True))


def _with_rules(store: DataFrame, agent: str, urls: DataFrame) -> DataFrame:
    """urls with ``allowed`` and the ``wait`` that their origin asks for."""
    urls = urls.withColumn("origin", _origin(F.col("url")))
    rules = origin_rules(store, agent, urls.select("origin").distinct())
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1), r"^(?=\?|$)", "/")
    return urls.join(rules, "origin").withColumns({"allowed": path_allowed(F.col("r.rules"), path), "wait": F.col("r.delay")}).drop("origin", "r")


def fetched(store: DataFrame, urls: DataFrame, max_redirects: int) -> DataFrame:
    """urls with the store's answer (code, content_type, body, final_url), redirects followed;
    ``problem`` says why there is none."""
    columns = ["status", "content_type", "body", "final_url"] + (["location"] if "location" in store.columns else [])
    answers = store.select(F.col("url").alias("asked"), *columns).withColumnRenamed("status", "code")
    if "location" not in columns:
        answers = answers.withColumn("location", F.lit(None).cast("string"))
    met = urls.withColumn("asked", F.col("url")).join(answers, "asked", "left")
    moved = F.col("code").isin(*REDIRECTS) & F.col("location").isNotNull()
    for _ in range(max_redirects if "location" in columns else 0):
        met = cut(met)
        going = met.where(moved)
        if going.isEmpty():
            break
        on = going.withColumn("asked", normalized_url(F.col("location"), F.col("asked"))).select(*urls.columns, "asked").join(answers, "asked", "left")
        met = met.where(~F.coalesce(moved, F.lit(False))).unionByName(on)
    problem = F.when(F.col("asked").isNull(), "redirect to no page").when(moved, "too many redirects").when(F.col("code").isNull(), "no answer")
    return met.withColumns({"problem": problem, "final_url": F.coalesce("final_url", "asked")}).drop("asked", "location")


def crawl(spark: SparkSession, store: DataFrame, options: CrawlOptions, resume: CrawlState | None = None) -> CrawlState:
    """Breadth-first crawl of the store within the budgets; failures and pages of other types use up
    the page budget, addresses that robots.txt forbids don't."""
    counts = dict.fromkeys("fetched failed type_skipped robots_skipped duplicates off_allowlist too_deep new_urls".split(), 0)
    if resume:
        urls, documents, links, requests = resume.urls, resume.documents.drop("duplicate_of"), resume.links, resume.requests
        counts |= resume.counts
    else:
        seeds = spark.createDataFrame([(s, i) for i, s in enumerate(options.seeds)], "raw string, place long")
        seeds = seeds.select(normalized_url(F.col("raw"), F.lit(None).cast("string")).alias("url"), "place").where("url is not null")
        seeds = seeds.where(host_allowed(host_of(F.col("url")), list(options.allowlist)))
        empty = spark.createDataFrame([], URLS)
        urls = cut(enqueue(empty, seeds.select("url", F.lit(0).alias("depth"), "place", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reason"))))
        documents, links, requests = (spark.createDataFrame([], shape) for shape in (DOCUMENTS, LINKS, REQUESTS))
        counts["new_urls"] = urls.count()
    tried = 0
    while tried < options.max_pages:
        level = urls.where("status = 'pending'").agg(F.min("depth")).first()[0]
        if level is None:
            break
        now = cut(_with_rules(store, options.user_agent, urls.where((F.col("status") == "pending") & (F.col("depth") == level))))
        # a host that was asked before is due a delay after its last request
        last = requests.groupBy("host").agg(F.max("at").alias("last"))
        open_now = now.where("allowed").withColumn("host", host_of(F.col("url"))).join(last, "host", "left")
        gap = F.coalesce("wait", F.lit(float(options.delay)))
        open_now = due_times(open_now, gap, F.coalesce(F.col("last") + gap, F.lit(0.0)))
        open_now = cut(open_now.orderBy("ready_at", "place").limit(options.max_pages - tried).select("url", "depth", "place", "host", "ready_at"))
        requests = cut(requests.unionByName(open_now.select("url", "host", F.col("ready_at").alias("at"))))
        met = fetched(store, open_now.select("url", "depth", "place"), options.max_redirects)
        kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
        failure = F.coalesce(
            "problem",
            F.when(~F.col("code").between(200, 299), F.concat(F.lit("status "), F.col("code").cast("string"))),
            F.when(F.octet_length("body") > options.max_bytes, F.lit("body too long")),
        )
        other = F.when(~kind.isin(*HTML_TYPES), F.concat(F.lit("content-type "), F.when(kind == "", "unknown").otherwise(kind)))
        met = met.withColumn("new_status", F.when(failure.isNotNull(), "failed").when(other.isNotNull(), "skipped").otherwise("fetched"))
        met = met.withColumn("new_reason", F.coalesce(failure, other))
        good = F.col("new_status") == "fetched"
        met = cut(met.select("url", "depth", "place", "new_status", "new_reason", F.when(good, extracted(F.coalesce("body", F.lit("")), F.col("final_url"))).alias("page")))
        shut = now.where("not allowed")
        result = met.select("url", "new_status", "new_reason")
        result = result.unionByName(shut.select("url", F.lit("skipped").alias("new_status"), F.lit("robots").alias("new_reason")))
        pages = met.where(good)
        text = F.col("page.text")
        documents = cut(documents.unionByName(pages.select("url", "depth", "place", F.col("page.title").alias("title"), text.alias("text"), content_hash(text).alias("content_hash"))))
        out = pages.select(F.col("url").alias("from_url"), "place", "depth", F.explode("page.links").alias("l"))
        out = out.select("from_url", "place", "depth", normalized_url(F.col("l.href"), F.lit(None).cast("string")).alias("to_url"), F.col("l.position").alias("position"), F.col("l.anchor").alias("anchor"))
        out = cut(out.where("to_url is not null"))
        links = cut(links.unionByName(insert_links(links, out.select("from_url", "to_url", "position", "anchor"))))
        inside = host_allowed(host_of(F.col("to_url")), list(options.allowlist))
        counts["off_allowlist"] += out.where(~inside).count()
        fit = out.where(inside)
        if level + 1 > options.max_depth:
            counts["too_deep"] += fit.count()
            fit = fit.limit(0)
        order = F.row_number().over(Window.orderBy("place", "position")).cast("long")  # links of one level of a budgeted crawl
        # pages of the same depth that an earlier run found come first
        known = urls.where(F.col("depth") == level + 1).agg(F.coalesce(F.max("place"), F.lit(-1)).alias("p")).first()[0]
        fresh = fit.select(F.col("to_url").alias("url"), (F.col("depth") + 1).alias("depth"), (order + F.lit(known)).alias("place"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reason"))
        done = urls.join(result, "url", "left").select("url", "depth", "place", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_reason", "reason").alias("reason"))
        fresh = cut(enqueue(urls, fresh))
        urls = cut(done.unionByName(fresh))
        n = {r["new_status"]: r["n"] for r in met.groupBy("new_status").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts["fetched"] += n.get("fetched", 0)
        counts["failed"] += n.get("failed", 0)
        counts["type_skipped"] += n.get("skipped", 0)
        counts["robots_skipped"] += shut.count()
        counts["new_urls"] += fresh.count()
        tried += sum(n.values())
    marked = cut(mark_duplicates(documents))
    counts["duplicates"] = marked.where("duplicate_of is not null").count()
    return CrawlState(urls, marked, links, requests, counts)


def corpus_hash(documents: DataFrame) -> str:
    """SHA-256 of the lines "url, title, text" of the owners, tab-separated, in url order. The lines
    pass through the driver one by one, as one digest asks for."""
    digest = hashlib.sha256()
    rows = documents.where("duplicate_of is null").select("url", "title", "text").orderBy("url")
    for r in rows.toLocalIterator(prefetchPartitions=False):
        digest.update(f"{r['url']}\t{r['title'] or ''}\t{r['text'] or ''}\n".encode())
    return digest.hexdigest()


def build_crawl_index(state: CrawlState, folder: str, name: str = "crawled", config: AnalysisConfig | None = None) -> dict:
    """Index the owners of their content under ``folder``: the index, its id map, the link graph and
    a manifest, which is returned."""
    spark = state.urls.sparkSession
    number = F.row_number().over(Window.orderBy("url")).cast("long") - 1  # pages of a budgeted crawl
    owners = state.documents.where("duplicate_of is null").select(number.alias("doc_id"), "url", "title", "text")
    owners = cut(owners)
    index = build_index(owners.withColumn("text", indexed_text(F.col("title"), F.col("text"))), config)
    index.save(f"{folder}/{name}.index", owners.select("doc_id", F.col("url").alias("corpus_id")))
    state.links.orderBy("from_url", "position").write.mode("overwrite").json(f"{folder}/{name}.graph")
    stats = link_stats(state.links).first().asDict()
    documents = state.documents.count()
    manifest = {
        "name": name,
        "corpusHash": corpus_hash(state.documents),
        "counts": {
            "documents": documents,
            "indexable": index.n_docs,
            "duplicates": documents - index.n_docs,
            "urls": {r["status"]: r["n"] for r in status_counts(state.urls).collect()},
            "links": stats,
        },
        "index": index.stats().first().asDict(),
    }
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.manifest")
    return manifest


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Fold newly arriving page files into a documents table as they come: each micro-batch is
    extracted and appended once."""
    pages = spark.readStream.schema(schema).parquet(source)

    def store(batch: DataFrame, batch_id: int) -> None:
        page = batch.withColumn("page", extracted(F.col("html"), F.col("url")))
        text = F.col("page.text")
        page.select("url", F.col("page.title").alias("title"), text.alias("text"), content_hash(text).alias("content_hash"), F.lit(batch_id).alias("batch")).write.mode("append").parquet(target)

    return pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
