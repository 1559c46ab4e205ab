"""Readers and writers: collections, judgments, pages, graphs, run files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, seq, value) of one text file: the 1-based number of each line, and its 0-based place
    among those that are not blank.

    A large file is read by blocks; lines are counted within their block, and the blocks' totals,
    one row each, are added up before it."""
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("value"))
    full = (F.trim("value") != "").cast("long")
    here = Window.partitionBy("block").orderBy("id")
    rows = rows.select("block", "value", F.row_number().over(here).cast("long").alias("line"), (F.sum(full).over(here) - full).alias("seq"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(full).alias("k"))
    sizes = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"))
    return rows.join(sizes, "block").select((F.col("line") + F.col("n")).alias("line"), (F.col("seq") + F.col("k")).alias("seq"), "value")


def _fail(path_line: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit("line "), path_line.cast("string"), F.lit(f": {what}"))).cast("string")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, corpus_id, title, text) of a JSON-lines collection; doc_id is the line order.

    Blank lines are skipped; a line without a string ``_id`` fails with its number."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", "_id string, title string, text string")
    kind = F.expr("schema_of_variant(try_variant_get(try_parse_json(value), '$._id', 'variant'))")
    good = F.expr("is_variant_null(try_parse_json(value))").isNotNull() & kind.startswith("STRING")
    ident = F.when(good, parsed["_id"]).otherwise(_fail(F.col("line"), "_id is not a string"))
    return rows.select(F.col("seq").alias("doc_id"), ident.alias("corpus_id"), F.coalesce(parsed["title"], F.lit("")).alias("title"), F.coalesce(parsed["text"], F.lit("")).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of a JSON-lines query file; the last of equal ids wins."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", "_id string, text string")
    ident = F.when(parsed["_id"].isNotNull() & parsed["text"].isNotNull(), parsed["_id"]).otherwise(_fail(F.col("line"), "_id and text must be strings"))
    rows = rows.select("line", ident.alias("query_id"), parsed["text"].alias("text"))
    return rows.groupBy("query_id").agg(F.max_by("text", "line").alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, corpus_id, grade) of tab-separated judgments with an optional header.

    Another header, a wrong number of columns, a grade that is no number from 0 up, or a
    repeated pair fails with its line number."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    parts = F.split("value", "\t")
    head = (F.col("line") == 1) & F.col("value").startswith("query-id")
    rows = rows.where(~(head & (F.trim("value") == "query-id\tcorpus-id\tscore")))
    grade = F.expr("try_cast(split(value, '\\t')[2] AS DOUBLE)")
    good = ~head & (F.size(parts) == 3) & grade.isNotNull() & ~F.isnan(grade) & (grade >= 0) & (grade < float("inf"))
    query = F.when(good, parts[0]).otherwise(_fail(F.col("line"), "not a judgment"))
    rows = rows.select("line", query.alias("query_id"), parts[1].alias("corpus_id"), grade.alias("grade"))
    per = rows.groupBy("query_id", "corpus_id").agg(F.max("grade").alias("grade"), F.count(F.lit(1)).alias("n"), F.max("line").alias("line"))
    once = F.when(F.col("n") == 1, F.col("query_id")).otherwise(_fail(F.col("line"), "the pair is judged twice"))
    return per.select(once.alias("query_id"), "corpus_id", "grade")


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def indexed_text(title: Column, text: Column) -> Column:
    """title + ". " + text, or the text alone without a title."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "), F.coalesce(text, F.lit("")))).otherwise(F.coalesce(text, F.lit("")))


def page_title(html: Column) -> Column:
    """Text of the first title element with five entities decoded."""
    return _entities(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_text(html: Column) -> Column:
    """Text without the first head element and tags, entities decoded, white space folded."""
    body = F.regexp_replace(html, r"(?is)^(.*?)<head.*?</head>", "$1")
    return F.trim(F.regexp_replace(_entities(F.regexp_replace(body, r"<[^>]+>", " ")), r"\s+", " "))


def _entities(col: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        col = F.replace(col, F.lit(name), F.lit(char))
    return col


def read_static_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, corpus_id, title, url, text) of a folder of pages listed in documents.jsonl
    with their SHA-256; a page that is missing or has another hash fails, and so does a list that
    has another hash or number of documents than manifest.json says, if there is one."""
    listed = spark.read.schema("id string, file string, title string, url string, sha256 string").json(f"{folder}/documents.jsonl")
    said = spark.read.schema("documentsSha256 string, numDocuments long").json(f"{folder}/manifest.json", multiLine=True).first() if _exists(spark, f"{folder}/manifest.json") else None
    if said is not None:
        if said["documentsSha256"] != file_hash(spark, f"{folder}/documents.jsonl"):
            raise ValueError(f"{folder}/documents.jsonl has another hash than the manifest says")
        if said["numDocuments"] != listed.count():
            raise ValueError(f"{folder} lists another number of documents than the manifest says")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("html"))
    joined = listed.withColumn("name", F.regexp_extract("file", r"([^/]+)$", 1)).join(files, "name", "left")
    ok = F.when(F.col("hash").eqNullSafe(F.col("sha256")), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("wrong or missing file "), "file")).cast("string"))
    title = F.when(page_title(F.col("html")) != "", page_title(F.col("html"))).otherwise(F.col("title"))
    order = F.row_number().over(Window.orderBy("id")) - 1  # a manifest is small
    return joined.select(order.cast("long").alias("doc_id"), ok.alias("corpus_id"), title.alias("title"), "url", page_text(F.col("html")).alias("text"))


def read_citations(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Edges (src, dst) of a graph file and its hash."""
    kind = "edges array<array<long>>, graphHash string, stats struct<graphHash: string>"
    row = spark.read.schema(kind).json(path, multiLine=True)
    found = row.select(F.coalesce("graphHash", "stats.graphHash")).first()[0]
    if not found:
        raise ValueError(f"{path} has no graph hash")
    return row.select(F.explode("edges").alias("e")).select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")), found


def write_links(links: DataFrame, path: str) -> None:
    """Export edges in the order from, position, to."""
    links.select("from_url", "position", "to_url").orderBy("from_url", "position", "to_url").write.mode("overwrite").json(path)


def merge_collections(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Collections as one, ids rewritten to "name:id"."""
    out = None
    for name in sorted(parts):
        one = parts[name].withColumn(key, F.concat_ws(":", F.lit(name), F.col(key)))
        out = one if out is None else out.unionByName(one)
    return out


def news_parts(raw: Column) -> tuple[Column, Column]:
    """Subject and body of a news message: the header block ends at the first blank line, and a
    folded subject goes on with lines that begin with white space."""
    text = F.regexp_replace(raw, "\r\n", "\n")
    cut = F.instr(text, "\n\n")
    header = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
    subject = F.regexp_extract(F.regexp_replace(header, r"[ \t]*\n[ \t]+", " "), r"(?im)^Subject:[ \t]*(.*)$", 1)
    return F.trim(subject), F.when(cut > 0, F.regexp_replace(F.substring(text, cut + 2, F.length(text)), r"^\s+|\s+$", "")).otherwise(F.lit(""))


def read_news(spark: SparkSession, folder: str) -> DataFrame:
    """(corpus_id, title, text) of a tree split/group/file of news messages; messages with neither
    subject nor body are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    title, body = news_parts(F.decode("content", "UTF-8"))
    rows = raw.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("corpus_id"), title.alias("title"), body.alias("text"))
    return rows.where((F.col("title") != "") | (F.col("text") != ""))


#: Lines between a contents list's headings at most.
CONTENTS_GAP = 5


def split_books(lines: DataFrame, heading: str, isolated: bool = True) -> DataFrame:
    """(book, part, heading, text) of books given as (book, line, value).

    A book is what stands between its licence's START and END lines, or all of it. A part begins
    with a line that matches ``heading``; with ``isolated``, not one that has another heading within
    CONTENTS_GAP lines, as in a list of contents. Paragraphs are folded and apart by newlines;
    illustrations are left out. One book is one task's window."""
    per = Window.partitionBy("book").orderBy("line")
    upto, rest = per.rowsBetween(Window.unboundedPreceding, 0), per.rowsBetween(Window.unboundedPreceding, -1)
    mark = lambda word: F.col("value").rlike(rf"^\*\*\* {word} OF (THE|THIS) PROJECT GUTENBERG EBOOK").cast("int")
    whole = Window.partitionBy("book")
    rows = lines.withColumns({"begun": F.coalesce(F.sum(mark("START")).over(rest), F.lit(0)), "any": F.max(mark("START")).over(whole)})
    rows = rows.where((F.col("begun") > 0) | (F.col("any") == 0)).withColumn("ended", F.sum(mark("END")).over(upto)).where("ended = 0")
    rows = rows.select("book", "line", "value", F.col("value").rlike(heading).alias("is_heading"))
    found = rows.where("is_heading")
    if isolated:
        near = lambda other: F.coalesce(F.abs(F.col("line") - other) <= CONTENTS_GAP, F.lit(False))
        found = found.withColumns({"a": F.lag("line").over(per), "b": F.lead("line").over(per)}).where(~near(F.col("a")) & ~near(F.col("b")))
    found = found.select("book", "line", F.lit(1).alias("begins"))
    rows = rows.join(found, ["book", "line"], "left").withColumn("part", F.sum(F.coalesce("begins", F.lit(0))).over(upto))
    inside = F.when(F.col("begins").isNull(), F.struct("line", "value"))
    parts = rows.where("part > 0").groupBy("book", "part").agg(F.max(F.when(F.col("begins") == 1, F.trim("value"))).alias("heading"), F.array_sort(F.collect_list(inside)).alias("held"))
    text = F.regexp_replace(F.array_join(F.transform("held", lambda r: r["value"]), "\n"), r"(?s)\[Illustration.*?\]", "")
    folded = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return parts.select("book", F.col("part").cast("int").alias("part"), "heading", F.array_join(folded, "\n").alias("text"))


def check_coverage(qrels: DataFrame, corpus: DataFrame, queries: DataFrame) -> None:
    """Every judged document and query must exist."""
    for key, other in (("corpus_id", corpus), ("query_id", queries)):
        missing = qrels.select(key).distinct().join(other.select(key), key, "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"judged {key} {missing[0][0]} is missing")


def read_artifacts(spark: SparkSession, paths: str) -> DataFrame:
    """(file, kind, created, config, metrics) of run files, newest name first; unreadable ones are skipped."""
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parsed = F.from_json("value", "kind string, createdAt string, config map<string,string>, metrics map<string,string>", {"mode": "PERMISSIVE"})
    rows = raw.withColumn("r", parsed).where(F.expr("try_parse_json(value)").isNotNull())
    return rows.select("file", F.col("r.kind").alias("kind"), F.col("r.createdAt").alias("created"), F.col("r.config").alias("config"), F.col("r.metrics").alias("metrics")).orderBy(F.desc("file"))


#: Where the recorded experiments of each kind hold what a service shows, by file
#: name ending; "kind" has a default where a file does not say it.
ARTIFACTS = {
    "run": {
        "experiment_id": ("$.experiment_id", "string"), "timestamp": ("$.timestamp", "string"), "git_sha": ("$.git.sha", "string"),
        "corpus": ("$.corpus.name", "string"), "strategy": ("$.strategy.id", "string"), "mode": ("$.strategy.mode", "string"),
        "params": ("$.strategy.params", "json"), "evaluated_queries": ("$.query_set.evaluated_queries", "double"), "map": ("$.metrics.map", "double"),
        "ndcg10": ("$.metrics.ndcg['10']", "double"), "recall100": ("$.metrics.recall['100']", "double"), "latency_avg_ms": ("$.latency_ms.avg", "double"),
        "fuzzy": ("$.fuzzy.enabled", "boolean"),
    },
    "-fuzzy-benchmark.json": {
        "kind": ("$.kind", "string"), "timestamp": ("$.timestamp", "string"), "git_sha": ("$.git.sha", "string"), "strategy": ("$.config.strategy", "string"),
        "max_edits": ("$.config.fuzzy.maxEdits", "double"), "judged_queries": ("$.query_set.judged_queries", "double"), "arms": ("$.arms", "json"),
        "corrections": ("$.corrections", "json"),
    },
    "-query-benchmark.json": {
        "kind": ("$.kind", "string"), "timestamp": ("$.timestamp", "string"), "git_sha": ("$.git.sha", "string"), "corpus": ("$.config.corpus", "string"),
        "queries": ("$.config.queries", "double"), "topk": ("$.config.topk", "double"), "parse_failures": ("$.parse_failures.candidates", "double"),
        "stages": ("$.stages", "json"), "results": ("$.results", "json"), "fuzzy_expansion": ("$.fuzzy_expansion", "json"), "link_graph": ("$.link_graph", "json"),
    },
    "-pagerank.json": {
        "kind": ("$.kind", "string"), "timestamp": ("$.timestamp", "string"), "git_sha": ("$.git.sha", "string"), "run_id": ("$.runId", "double"),
        "graph": ("$.graph", "json"), "convergence": ("$.convergence", "json"), "sum": ("$.scores.sum", "double"), "top": ("$.scores.top", "json"),
    },
}
_DEFAULT_KIND = {"-fuzzy-benchmark.json": "fuzzy-typo-benchmark", "-query-benchmark.json": "query-latency", "-pagerank.json": "pagerank"}


def artifacts_of(spark: SparkSession, paths: str, ending: str = "run") -> DataFrame:
    """Recorded experiments of a kind, one row a readable file, newest name first; what a file does
    not hold, or holds in another type, is null. Parts of no fixed form are JSON text. Runs without
    a mean average precision are left out."""
    raw = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.expr("try_parse_json(value)").alias("v"))
    quoted = lambda path: path.replace("'", "\\'")

    def column(name: str, path: str, kind: str) -> Column:
        part = f"try_variant_get(v, '{quoted(path)}', 'variant')"
        if kind == "json":
            return F.expr(f"to_json({part})").alias(name)
        # numbers and texts are not turned into each other
        types = {"string": ("STRING",), "double": ("BIGINT", "DOUBLE", "DECIMAL", "INT", "TINYINT", "SMALLINT"), "boolean": ("BOOLEAN",)}[kind]
        of_type = " OR ".join(f"startswith(schema_of_variant({part}), '{t}')" for t in types)
        return F.expr(f"CASE WHEN {of_type} THEN try_variant_get(v, '{quoted(path)}', '{kind}') END").alias(name)

    rows = raw.where("v IS NOT NULL")
    if ending != "run":
        rows = rows.where(F.col("file").endswith(ending))
    rows = rows.select("file", *(column(n, *f) for n, f in ARTIFACTS[ending].items()))
    if ending == "run":
        rows = rows.where("map IS NOT NULL").withColumn("fuzzy", F.coalesce("fuzzy", F.lit(False)))
    else:
        rows = rows.withColumn("kind", F.coalesce("kind", F.lit(_DEFAULT_KIND[ending])))
    return rows.orderBy(F.desc("file"))


def write_experiment(spark: SparkSession, path: str, artifact: dict) -> None:
    spark.createDataFrame([(json.dumps(artifact, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def synthetic_corpus(spark: SparkSession, n_docs: int, seed: int = 42, vocabulary: int = 50_000) -> DataFrame:
    """(doc_id, text): words with Zipf frequencies, lengths of 50 to 600; for benches."""
    draw = lambda i: (F.abs(F.xxhash64(F.col("id"), i, F.lit(seed))) % 1_000_003) / F.lit(1_000_003.0)
    size = F.least(F.greatest(F.lit(50) + F.floor((draw(F.lit(-1)) + draw(F.lit(-2)) + draw(F.lit(-3))) * 100), F.lit(50)), F.lit(600)).cast("int")
    word = lambda i: F.concat(F.lit("w"), F.floor(F.exp(draw(i) * F.log(F.lit(float(vocabulary))))).cast("string"))
    return spark.range(n_docs).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), size), word), " ").alias("text"))
