"""Queries: drawing search, page mapping, layout, painted paths and requirement extraction over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import drawings, requirements
from tracewell.sources import table

WORDS = "cable tray"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as a drawing index: one drawing a listing, its category and its sheet row."""
    m = table(spark, sf_dir, "material_knowledge_metadata").where("name is not null").dropDuplicates(["listing_id"])
    none = F.lit(None).cast("string")
    return m.select(
        F.concat(F.lit("E-"), F.col("listing_id").cast("string")).alias("drawing_no"), F.col("name").alias("title"), F.col("category"), none.alias("complex"),
        none.alias("building"), none.alias("floor"), F.col("row_index").alias("source_list_page"), F.lit(0.9).alias("confidence"),
    )


def drawing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawings.search_drawings(_index(spark, sf_dir), WORDS, 25).select("drawing_no", "score")


def title_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    category, several = drawings.title_category(F.col("name"))
    m = table(spark, sf_dir, "material_knowledge_metadata").where("name is not null").dropDuplicates(["listing_id"])
    return m.select("listing_id", category.alias("title_category"), several.alias("is_conflict"))


def page_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of a catalogue as a page whose candidates are its listings, judged by the last listed name."""
    m = table(spark, sf_dir, "material_knowledge_metadata").where("name is not null").dropDuplicates(["listing_id"])
    last = m.groupBy("catalog_id", "item_code").agg(F.max_by("name", "listing_id").alias("detected_title"), F.min("listing_id").cast("int").alias("page"))
    number = F.concat(F.lit("E-"), F.col("listing_id").cast("string"))
    candidates = m.join(last, ["catalog_id", "item_code"]).select(F.col("catalog_id").alias("source"), "page", number.alias("drawing_no"), "detected_title", F.lit(1.0).alias("zone"))
    return drawings.map_pages(candidates, _index(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as text items down a page, 20 points apart."""
    docs = table(spark, sf_dir, "documents").where("text is not null").dropDuplicates(["doc_id"])
    rows = docs.select(F.coalesce("source", F.lit("none")).alias("source"), F.col("doc_id").cast("int").alias("page"), F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("source_order", "str"))
    return rows.where("trim(str) <> ''").select(
        "source", "page", "source_order", "str", F.lit(50.0).alias("x"), (-20.0 * F.col("source_order")).alias("y"), F.length("str").cast("double").alias("width"), F.lit(10.0).alias("height")
    )


def normative_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "kec_requirement_snapshot_members").select("snapshot_id", "population_index", "statement").distinct()
    return m.select("snapshot_id", "population_index", requirements.is_normative(F.col("statement")).alias("is_normative"))


CONTEXT = "다음의 경우에는"


def _member_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each snapshot member: its statement, for some below a context, close to it or too far, or below a plain line."""
    i = F.col("population_index")
    m = table(spark, sf_dir, "kec_requirement_snapshot_members").groupBy(F.col("snapshot_id").cast("string").alias("source"), i.cast("int").alias("page")).agg(F.min("statement").alias("statement"))
    i = F.col("page")
    item = lambda text, y, when=F.lit(True): F.when(when, F.struct(text.alias("str"), F.lit(y).alias("y")))
    texts = [item(F.lit(CONTEXT), 130.0, i % 4 == 0), item(F.lit(CONTEXT), 160.0, i % 4 == 1), item(F.lit("Plain line above."), 130.0, i % 4 == 2), item(F.col("statement"), 100.0)]
    rows = m.select("source", "page", F.posexplode(F.array_compact(F.array(*texts))).alias("source_order", "o")).select("source", "page", "source_order", "o.*")
    return rows.select("source", "page", "source_order", "str", F.lit(50.0).alias("x"), "y", F.lit(200.0).alias("width"), F.lit(10.0).alias("height"))


def requirement_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requirements.requirements(requirements.text_lines(_member_items(spark, sf_dir)))
    return found.select("source", "page", "statement", "n_fragments")


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``_items``, with a second text far to the right on three of five lines of every third document."""
    items = _items(spark, sf_dir)
    second = items.where((F.col("page") % 3 == 0) & (F.col("source_order") % 5 < 3)).withColumn("x", F.col("x") + F.col("width") + 90).withColumn("str", F.lit("12.5"))
    return items.unionByName(second)


def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = requirements.mark_tables(requirements.text_lines(_columns(spark, sf_dir)))
    return lines.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if("in_table").alias("n_table_lines"))


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of document words: the first words of a line side by side, a far one, one turned by a right angle."""
    words = F.split("str", " ", 7)  # six are used; what follows them stays one text
    rows = _items(spark, sf_dir).select("source", "page", "source_order", words.alias("w"), (-F.col("y")).alias("y"))
    word = lambda n, x, dy, turn, end, k: F.when(
        F.size("w") > n, F.struct(F.lit(k).alias("k"), F.col("w")[n].alias("text"), F.lit(x).alias("x"), (F.col("y") + dy).alias("y"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"), F.lit(turn).alias("rotation"), F.lit(end).alias("eol"))
    )
    made = F.array_compact(F.array(word(0, 50.0, 0.0, 0.0, False, 0), word(1, 95.0, 1.0, 0.5, False, 1), word(2, 140.0, 0.0, 0.0, True, 2), word(3, 185.0, 0.0, 0.0, False, 3), word(4, 400.0, 0.0, 0.0, False, 4), word(5, 600.0, 0.0, 90.0, False, 5)))
    items = rows.select("source", "page", "source_order", F.explode(made).alias("o")).select("source", "page", F.col("source_order").alias("at"), "o.*")
    items = items.where("trim(text) <> ''").select(
        "source", "page", F.concat(F.lit("i"), F.lpad((F.col("at") * 8 + F.col("k")).cast("string"), 6, "0")).alias("item_id"), "text", "x", "y", "width", "height", "rotation", F.lit(10.0).alias("font_size"), "eol",
        (F.col("at") * 8 + F.col("k")).cast("int").alias("source_order"),
    )
    # Each document is one row of the step that drops duplicates, so its words lie together.
    return drawings.layout_lines(items, together=True).select("source", "page", "line_id", "text", F.round("rotation", 3).alias("rotation"), F.size("item_ids").alias("n_items"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path a vector, its label the page, of one of nine forms by turns."""
    v, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    step = lambda c, *ps: F.struct(F.lit(c).alias("command"), F.array(*ps).alias("points") if ps else F.array().cast("array<struct<x:double,y:double>>").alias("points"))
    line, square = [step("M", p(0, 0)), step("L", p(10, 0))], [step("M", p(0, 0)), step("L", p(10, 0)), step("L", p(10, 8)), step("L", p(0, 8)), step("Z")]
    forms = [
        line, square, [*line, step("L", p(10, 5))], [*line, step("L", p(5, 9)), step("Z")], [step("M", p(0, 0)), step("C", p(1, 1), p(2, 2), p(9, 3))], [*line, *square], line, line,
        [*line, step("L", p(12, 8)), step("L", p(0, 8)), step("Z")],
    ]
    size = lambda a, b: F.element_at(F.array(*[F.lit(x) for x in (10.0, 10.0, 10.0, 10.0, 9.0, 10.0, a, b, 12.0)]), (i % 9 + 1).cast("int"))
    commands = F.element_at(F.array(*[F.array(*f) for f in forms]), (i % 9 + 1).cast("int"))
    return v.select(F.lit("v").alias("source"), F.col("label").alias("page"), "vec_id", commands.alias("commands"), size(0.0, 0.5).alias("width"), size(0.0, 0.25).alias("height"), F.col("embedding")[0].cast("double").alias("shift"))


def primitive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by kind and page, and how many of each repeat another's geometry."""
    rows = _paths(spark, sf_dir).select("source", "page", F.col("vec_id").cast("string").alias("primitive_id"), F.col("vec_id").cast("int").alias("source_order"), "commands", "width", "height")
    return drawings.classify_primitives(rows).groupBy("page", "kind").agg(F.count("*").alias("n"), F.count("duplicate_group").alias("n_repeated"))


def painted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path painted inside two nested states, its first line again after one restore, and once outside."""
    rows = _paths(spark, sf_dir)
    op = lambda at, name, numbers=None, paint=None, path=False: F.struct(
        (F.col("vec_id") * 16 + at).cast("int").alias("position"), F.lit(name).alias("op"), (numbers if numbers is not None else F.lit(None)).cast("array<double>").alias("numbers"),
        (F.col("commands") if path else F.lit(None).cast("array<struct<command:string,points:array<struct<x:double,y:double>>>>")).alias("commands"), F.lit(paint).cast("string").alias("paint"),
    )
    lit = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    ops = F.array(
        op(0, "save"), op(1, "transform", lit(1, 0, 0, 1, 300, 200)), op(2, "lineWidth", lit(2)), op(3, "save"), op(4, "transform", lit(0, 2, -2, 0, 10, 20)), op(5, "lineWidth", F.array(F.col("shift"))), op(6, "path", path=True),
        op(7, "paint", paint="fill"), op(8, "paint", paint="lost"), op(9, "restore"), op(10, "path", path=True), op(11, "paint", paint="stroke"), op(12, "restore"), op(13, "path", path=True), op(14, "paint", paint="both"),
    )
    made = drawings.decode_operators(rows.select("source", "page", F.explode(ops).alias("o")).select("source", "page", "o.*"))
    last = F.col("commands")[1]["points"][0]
    return made.select("page", "primitive_id", "paint", F.round("line_width", 6).alias("line_width"), F.round(last["x"], 6).alias("x"), F.round(last["y"], 6).alias("y"), F.size("commands").alias("n_commands"))


QUERIES = {
    f.__name__: f
    for f in (drawing_search, title_categories, page_mapping, normative_statements, requirement_extraction, table_regions, layout_lines, primitive_kinds, painted_paths)
}

_M = "m AS (SELECT DISTINCT listing_id, name, category, row_index FROM material_knowledge_metadata WHERE name IS NOT NULL)"
_M0 = "m AS (SELECT DISTINCT listing_id, catalog_id, item_code, name FROM material_knowledge_metadata WHERE name IS NOT NULL)"
_PATTERNS = [(c, p.replace("(?i)", "")) for c, p in drawings.CATEGORIES]
_HITS = [f"regexp_matches(name, '{p}'{', ' + chr(39) + 'i' + chr(39) if c == 'MCC' else ''})" for c, p in _PATTERNS]
_W1, _W2 = WORDS.split()
_UNIT = "CASE WHEN lower(category) = '{0}' THEN 0.88 WHEN contains(t, '{0}') THEN 0.78 END"

SQL = {
    "title_categories": f"WITH {_M} SELECT listing_id, CASE " + " ".join(f"WHEN {h} THEN '{c}'" for (c, _), h in zip(_PATTERNS, _HITS)) + " ELSE '기타' END AS title_category, "
    + " + ".join(f"CAST({h} AS INTEGER)" for h in _HITS) + " > 1 AS is_conflict FROM m",
    "drawing_search": f"""WITH {_M}, n AS (SELECT *, trim(regexp_replace(lower(name), '[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g')) AS t FROM m),
u AS (SELECT *, {_UNIT.format(_W1)} AS a, {_UNIT.format(_W2)} AS b FROM n),
s AS (SELECT *, floor(CASE WHEN t = '{WORDS}' THEN greatest((a + b) / 2, 0.96) ELSE (a + b) / 2 END * 10000.0 + 0.5) / 10000.0 AS score,
CAST(a >= 0.78 AS INTEGER) + CAST(b >= 0.78 AS INTEGER) AS direct, 'E-' || listing_id AS drawing_no FROM u WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT drawing_no, score FROM s ORDER BY score DESC, direct DESC, row_index, CASE WHEN regexp_full_match(drawing_no, 'E-\\d{2,4}') THEN 'E' ELSE '' END, CASE WHEN regexp_full_match(drawing_no, 'E-\\d{2,4}') THEN listing_id END NULLS FIRST, drawing_no LIMIT 25""",
    "normative_statements": f"SELECT DISTINCT snapshot_id, population_index, regexp_matches(statement, '{requirements.NORMATIVE}') AS is_normative FROM kec_requirement_snapshot_members",
    "table_regions": """WITH d AS (SELECT DISTINCT doc_id, coalesce(source, 'none') AS source, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, source, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS parts FROM d),
l AS (SELECT doc_id, source, k, doc_id % 3 = 0 AND k % 5 < 3 AS sep FROM (SELECT doc_id, source, parts, unnest(range(0, len(parts))) AS k FROM p) WHERE trim(parts[k + 1]) <> ''),
n AS (SELECT *, coalesce(sep AND lag(sep) OVER w AND k - lag(k) OVER w = 1, false) AS joins FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM n),
t AS (SELECT *, sep AND count(*) OVER (PARTITION BY doc_id, run) >= 2 AS in_table FROM r) SELECT source, count(*) AS n_lines, count(*) FILTER (in_table) AS n_table_lines FROM t GROUP BY 1""",
    "requirement_extraction": f"""WITH m AS (SELECT CAST(snapshot_id AS VARCHAR) AS source, population_index AS page, min(statement) AS s FROM kec_requirement_snapshot_members GROUP BY 1, 2),
t AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> ''), ' ') AS c FROM m)
SELECT source, CAST(page AS INTEGER) AS page, CASE WHEN page % 4 = 0 THEN '{CONTEXT} ' ELSE '' END || c AS statement, CASE WHEN page % 4 = 0 THEN 2 ELSE 1 END AS n_fragments FROM t WHERE page % 4 <> 1 AND regexp_matches(c, '{requirements.NORMATIVE}')""",
    "primitive_kinds": """WITH k AS (SELECT label AS page, vec_id % 9 AS f, (['line', 'rectangleCandidate', 'polyline', 'closedPolygon', 'curve', 'compoundPath', 'zeroLength', 'tiny', 'closedPolygon'])[vec_id % 9 + 1] AS kind,
CASE WHEN vec_id % 9 IN (6, 7) THEN 0 ELSE vec_id % 9 END AS g FROM embeddings), c AS (SELECT *, count(*) OVER (PARTITION BY page, g) AS same FROM k)
SELECT page, kind, count(*) AS n, count(*) FILTER (same > 1) AS n_repeated FROM c GROUP BY 1, 2""",
    "painted_paths": """WITH v AS (SELECT label AS page, vec_id AS i, CAST(embedding[1] AS DOUBLE) AS w, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings),
q AS (SELECT v.*, k, CASE i % 9 WHEN 4 THEN 1 ELSE 10 END AS px, CASE i % 9 WHEN 4 THEN 1 ELSE 0 END AS py FROM v, (VALUES (0), (1), (2)) t(k))
SELECT page, 'primitive-' || lpad(CAST(n * 3 + k + 1 AS VARCHAR), 6, '0') AS primitive_id, (['fill', 'stroke', 'both'])[k + 1] AS paint, CASE k WHEN 0 THEN round(w, 6) WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS line_width,
CASE k WHEN 0 THEN 310 - 2 * py WHEN 1 THEN px + 300 ELSE px END::DOUBLE AS x, CASE k WHEN 0 THEN 220 + 2 * px WHEN 1 THEN py + 200 ELSE py END::DOUBLE AS y, (([2, 5, 3, 4, 2, 7, 2, 2, 5])[i % 9 + 1])::INTEGER AS n_commands FROM q""",
    "page_mapping": f"""WITH {_M0}, la AS (SELECT catalog_id, item_code, arg_max(name, listing_id) AS found, min(listing_id) AS page FROM m GROUP BY 1, 2),
cl AS (SELECT m.catalog_id AS source, page, 'E-' || listing_id AS drawing_no, regexp_replace(lower(found), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS a, regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS b FROM m JOIN la USING (catalog_id, item_code)),
gr AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda k: substr(a, k, 2))) AS ga, list_distinct(list_transform(range(1, length(b)), lambda k: substr(b, k, 2))) AS gb FROM cl),
sm AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) WHEN greatest(len(ga), len(gb)) = 0 THEN 0.0 ELSE len(list_intersect(ga, gb)) / greatest(len(ga), len(gb)) END AS sim FROM gr),
od AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY source, page) AS cnt, lead(sim) OVER w AS second FROM sm WINDOW w AS (PARTITION BY source, page ORDER BY sim DESC, drawing_no)),
fi AS (SELECT *, cnt = 1 OR (sim > 0 AND sim - second >= 0.15) AS clear, a = b AND a <> '' AS same FROM od WHERE n = 1)
SELECT source, CAST(page AS INTEGER) AS page, CASE WHEN clear THEN drawing_no END AS drawing_no,
CASE WHEN clear THEN floor(least(1.0, 0.76 + 0.08 + CASE WHEN same THEN 0.15 ELSE least(0.08, sim * 0.08) END + CASE WHEN NOT same AND sim > 0 THEN 0.01 ELSE 0.0 END - CASE WHEN cnt > 1 THEN 0.02 ELSE 0.0 END) * 1000 + 0.5) / 1000 END::DOUBLE AS confidence,
CASE WHEN clear THEN 'MAPPED' ELSE 'AMBIGUOUS' END AS status FROM fi""",
}
