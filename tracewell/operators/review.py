"""Design items, their relations, evaluation, validation issues and the markdown report."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import collapsed, excerpt


def evidence_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line: the non-blank lines of each text, white space collapsed."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))
    return rows.withColumn("line", collapsed(F.col("line"))).where("line <> ''")


def design_items(lines: DataFrame, keywords: DataFrame, key: str, keep: int = 3) -> DataFrame:
    """item, n, key, line_no, keyword, excerpt: the first ``keep`` distinct pieces of evidence of each item.

    keywords: item, keyword, place; the first keyword of an item by place that a line contains counts.
    The keyword list is a small fixed dimension, so every line is tested against it in place.
    """
    table = keywords.orderBy("item", "place").collect()
    by: dict[str, list[str]] = {}
    for r in table:
        by.setdefault(r["item"], []).append(r["keyword"])
    # One alternation leaves the lines that hold any keyword; each item's first keyword is then looked up once.
    low = lines.withColumn("_low", F.lower("line"))
    low = low.where(F.col("_low").rlike("|".join(re.escape(k) for ks in by.values() for k in ks) or "$^"))
    table = F.array(*[F.struct(F.lit(i).alias("item"), F.array(*map(F.lit, ks)).alias("ks")) for i, ks in by.items()])
    rows = low.withColumn("h", F.explode(table)).withColumn("keyword", F.try_element_at(F.filter("h.ks", lambda k: F.contains(F.col("_low"), k)), F.lit(1)))
    rows = rows.where("keyword is not null").select(key, "line_no", "line", "h.item", "keyword")
    rows = rows.withColumn("excerpt", excerpt(F.col("line"), F.col("keyword")))
    first_seen = rows.groupBy("item", "excerpt").agg(F.min(F.struct(key, "line_no", "keyword")).alias("e"))
    w = Window.partitionBy("item").orderBy("e")
    return first_seen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).select("item", "n", f"e.{key}", "e.line_no", "e.keyword", "excerpt")


def design_relations(items: DataFrame, rules: list[tuple[str, str]], keywords: dict[str, list[str]]) -> DataFrame:
    """left_item, right_item, proximity: same-excerpt if one kept excerpt names both, else project-level."""
    spark = items.sparkSession
    pairs = spark.createDataFrame(rules, "left_item string, right_item string")
    present = items.select("item").distinct()
    live = pairs.join(present.withColumnRenamed("item", "left_item"), "left_item").join(present.withColumnRenamed("item", "right_item"), "right_item")
    names = lambda ks: F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(F.lower("excerpt"), k))
    both = [F.when(names(keywords[a]) & names(keywords[b]), F.struct(F.lit(a).alias("left_item"), F.lit(b).alias("right_item"))) for a, b in rules]
    close = items.select("item", F.explode(F.array_compact(F.array(*both))).alias("p")).where("item = p.left_item or item = p.right_item").select("p.*").distinct()
    return live.join(close.withColumn("_c", F.lit(True)), ["left_item", "right_item"], "left").select(
        "left_item", "right_item", F.when(F.col("_c"), "same-excerpt").otherwise("project-level").alias("proximity")
    )


def evaluate_sets(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall; an empty denominator counts as 1 when nothing was expected or found."""
    e, a = expected.select(*key).distinct().withColumn("e", F.lit(1)), actual.select(*key).distinct().withColumn("a", F.lit(1))
    both = e.join(a, key, "full_outer").agg(F.count_if(F.expr("e is not null and a is not null")).alias("tp"), F.count_if(F.expr("e is null")).alias("fp"), F.count_if(F.expr("a is null")).alias("fn"))
    share = lambda n: F.when(F.col("tp") + F.col(n) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(n)))
    return both.withColumn("precision", share("fp")).withColumn("recall", share("fn"))


def issues(rules: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """code, entity_id, message: one row for each row that breaks a rule (code, message, ids of offenders)."""
    frames = [df.select(F.lit(code).alias("code"), F.col(df.columns[0]).cast("string").alias("entity_id"), F.lit(message).alias("message")) for code, message, df in rules]
    return reduce(DataFrame.unionByName, frames)


def markdown_report(title: str, sections: list[tuple[str, DataFrame, list[str], list[str]]], spark) -> DataFrame:
    """One row of markdown: a heading a section, one line a row in the given order. Sections are bounded tops."""
    parts = None
    for n, (name, df, order, columns) in enumerate(sections):
        line = F.concat(F.lit("- "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]))
        rows = df.select(F.lit(n).alias("s"), F.row_number().over(Window.orderBy(*order)).alias("n"), line.alias("line"))
        head = spark.createDataFrame([(n, 0, f"## {name}")], "s int, n int, line string")
        parts = head.unionByName(rows) if parts is None else parts.unionByName(head).unionByName(rows)
    body = parts.agg(F.array_sort(F.collect_list(F.struct("s", "n", "line"))).alias("all"))
    return body.select(F.concat(F.lit(f"# {title}\n"), F.array_join(F.col("all.line"), "\n")).alias("markdown"))


# Words of a request that command and name nothing.
REQUEST_WORDS = [
    "관련", "kec", "기준", "기준으로", "기준에", "도면", "도면을", "도면를", "도면이", "도면가", "도면은", "도면는", "찾아", "찾아서", "찾아줘", "찾아주세요", "검색", "검색해줘",
    "검색해주세요", "검토", "검토해", "검토해줘", "검토해주세요",
]


def request_query(request: str) -> str:
    """What a request asks for, without its commands; refused where nothing is left."""
    text = regex.sub(r"[^\p{L}\p{N}.㎡/()~-]+", " ", unicodedata.normalize("NFKC", request))
    query = " ".join(t for t in text.split() if t.lower() not in REQUEST_WORDS)
    if not query:
        raise ValueError("a request must name what to search for")
    return query


def select_top(results: DataFrame, request: list[str], score: str, name: str) -> DataFrame:
    """request.., selection (selected, ambiguous), n_tied, name (null when several tie): the best result of each request."""
    top = results.groupBy(*request).agg(F.max(score).alias("_top"))
    tied = results.join(top, request).where(F.col(score) == F.col("_top")).groupBy(*request).agg(F.count("*").alias("n_tied"), F.min(name).alias(name))
    return tied.select(*request, F.when(F.col("n_tied") == 1, "selected").otherwise("ambiguous").alias("selection"), "n_tied", F.when(F.col("n_tied") == 1, F.col(name)).alias(name))


def review_requests(requests: DataFrame, results: DataFrame, request: str, score: str, name: str) -> DataFrame:
    """One row a request: the selection, or not-found where the search gave nothing."""
    best = select_top(results, [request], score, name)
    return requests.select(request).distinct().join(best, request, "left").select(request, F.coalesce("selection", F.lit("not-found")).alias("selection"), F.coalesce("n_tied", F.lit(0)).alias("n_tied"), name)


def evidence_relations(evidence: DataFrame, rules: list[tuple[str, str]], keywords: dict[str, list[str]]) -> DataFrame:
    """left_item, right_item, proximity, confidence over kept evidence of pages and spreadsheet rows.

    evidence: item, excerpt, source_type (pdf or excel), source_path, sheet_name, row_index. One excerpt that
    names both items is the same excerpt or row; so are two pieces of one spreadsheet row.
    """
    spark = evidence.sparkSession
    pairs = spark.createDataFrame(rules, "left_item string, right_item string")
    present = evidence.select("item").distinct()
    live = pairs.join(present.toDF("left_item"), "left_item").join(present.toDF("right_item"), "right_item")
    names = lambda ks: F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(F.lower("excerpt"), k))
    both = [F.when(F.col("item").isin(a, b) & names(keywords[a]) & names(keywords[b]), F.struct(F.lit(a).alias("left_item"), F.lit(b).alias("right_item"))) for a, b in rules]
    near = evidence.select("source_type", F.explode(F.array_compact(F.array(*both))).alias("p")).select("p.*", F.when(F.col("source_type") == "pdf", 2).otherwise(1).alias("near"))
    place = ["source_path", "sheet_name", "row_index"]
    rows = evidence.where("source_type = 'excel' and row_index is not null").select("item", *place).distinct()
    shared = F.broadcast(pairs).join(rows.withColumnRenamed("item", "left_item"), "left_item").join(rows.withColumnRenamed("item", "right_item"), ["right_item", *place])
    best = near.unionByName(shared.select("left_item", "right_item", F.lit(1).alias("near"))).groupBy("left_item", "right_item").agg(F.max("near").alias("near"))
    out = live.join(best, ["left_item", "right_item"], "left")
    proximity = F.when(F.col("near") == 2, "same-excerpt").when(F.col("near") == 1, "same-row").otherwise("project-level")
    return out.select("left_item", "right_item", proximity.alias("proximity"), F.when(F.col("near") > 0, "high").otherwise("medium").alias("confidence"))


def review_prompt(request: str, drawing: str, page_text: str, citations: DataFrame, order: list[str], label: str, excerpt: str, most: int = 20) -> DataFrame:
    """One row, prompt: the request, the drawing with its text, and at most ``most`` citations in the given order."""
    top = citations.orderBy(*order).limit(most)
    n = F.row_number().over(Window.orderBy(*order))
    lines = top.select(n.alias("n"), F.concat(F.lit("- ["), F.col(label).cast("string"), F.lit("] "), collapsed(F.col(excerpt))).alias("line"))
    body = lines.agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], "\n").alias("body"))
    head = "\n".join(["# Request", request, "# Drawing", drawing, page_text, "# Sources", ""])
    return body.select(F.concat(F.lit(head), "body").alias("prompt"))


def managed_path(path):
    """A relative path below the managed folder to a PDF: no empty, dot or parent segment, no backslash or NUL."""
    base = F.element_at(F.split(path, "/"), -1)
    clean = ~path.rlike(r"[\\\x00]") & ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce(clean & (F.length(base) > 4) & F.lower(base).endswith(".pdf"), F.lit(False))


def parent_directory(path):
    at = F.length(path) - F.locate("/", F.reverse(path))
    return F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), at)).otherwise(F.lit("."))


def item_knowledge(items: DataFrame, chunks: DataFrame, keywords: dict[str, list[str]], key: str, text: str, keep: int = 3) -> DataFrame:
    """item, rank, key, n_keywords: for each item of a project the chunks that hold most of its keywords, then the smaller key.

    ``keywords`` is a small fixed table; ranks are cut inside each partition before they meet.
    """
    present = items.select("item").distinct()
    table = F.array(*[F.struct(F.lit(i).alias("item"), F.array(*map(F.lit, ks)).alias("ks")) for i, ks in keywords.items()])
    rows = chunks.select(key, F.lower(text).alias("_low"), F.explode(table).alias("k"))
    rows = rows.select(F.col("k.item").alias("item"), key, F.size(F.filter("k.ks", lambda w: F.contains(F.col("_low"), w))).alias("n_keywords")).where("n_keywords > 0")
    w = Window.partitionBy("item").orderBy(F.desc("n_keywords"), key)
    return rows.join(F.broadcast(present), "item").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("item", "rank", key, "n_keywords")


def project_review(items: DataFrame, chunks: DataFrame, keywords: dict[str, list[str]], key: str, text: str, keep: int = 3) -> DataFrame:
    """item, n_evidence, n_sources, finding: every keyword group of a project with what the knowledge says of it."""
    known = item_knowledge(items, chunks, keywords, key, text, keep).groupBy("item").agg(F.count("*").alias("n_sources"))
    seen = items.groupBy("item").agg(F.count("*").alias("n_evidence"))
    every = items.sparkSession.createDataFrame([(i,) for i in keywords], "item string")
    rows = every.join(seen, "item", "left").join(known, "item", "left").na.fill(0, ["n_evidence", "n_sources"])
    return rows.withColumn("finding", F.when(F.col("n_evidence") == 0, "not-mentioned").when(F.col("n_sources") == 0, "no-source").otherwise("supported"))


def hit_issues(hits: DataFrame, key: str, score: str, text: str) -> DataFrame:
    """Search results that an adapter must refuse: a key twice or missing, a score outside 0 (excluded) to 1, a text that is blank."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("?"))
    return issues([
        ("HIT_KEY_MISSING", "a hit has no key", hits.where(F.col(key).isNull()).select(name)),
        ("HIT_KEY_DUPLICATE", "a key occurs twice", hits.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(name)),
        ("HIT_SCORE_RANGE", "a score lies outside 0 to 1", hits.where(~F.coalesce((F.col(score) > 0) & (F.col(score) <= 1), F.lit(False))).select(name)),
        ("HIT_TEXT_BLANK", "a hit has no text", hits.where(F.coalesce(F.trim(text), F.lit("")) == "").select(name)),
    ])
