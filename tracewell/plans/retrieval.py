"""Queries: search, chunking, citations and reports over chunks, documents and the catalogue."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators import chunking, retrieval
from tracewell.sources import table

QUERY = "surge arrester lead"
KO_QUERY = "접지저항기 보호도체"
LIMIT = 25
# The keyword groups of the placeholder embedding.
GROUPS = [["grounding", "earth", "접지"], ["cable", "wire", "케이블"], ["breaker", "load", "부하"]]
CONTEXT = "Earthing: the ground rod and the buried copper mesh, KEC 140.2, 접지봉"
STOP = ["the", "and", "of", "for", "kec", "기준", "shall", "be", "a", "in", "to", "at", "is"]
ALIASES = {"earthing": "ground", "earth": "ground", "접지봉": "ground", "rod": "electrode"}


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each chunk once: repeats are equal in every column, so any one of a sequence number will do."""
    return table(spark, sf_dir, "kec_chunks").select("chunk_seq", *columns).dropDuplicates(["chunk_seq"])


def _lexical(spark, sf_dir, query=QUERY):
    return retrieval.lexical_search(_chunks(spark, sf_dir, "text", "clause"), query, LIMIT, "chunk_seq", "text", "clause")


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)


def lexical_search_ko(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, KO_QUERY)


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir, "collection", "embedding").where("collection = 'kec'")
    query = chunks.where("embedding is not null").orderBy("chunk_seq").limit(1).collect()[0]["embedding"]
    return retrieval.semantic_search(chunks, list(query), LIMIT, "chunk_seq", "embedding")


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir)


def semantic_topk_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    return retrieval.semantic_search(vectors, list(query), LIMIT, "vec_id", "embedding")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_rank(_semantic(spark, sf_dir), _lexical(spark, sf_dir), LIMIT, "chunk_seq", 0.6, 0.4)


def placeholder_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", retrieval.placeholder_embedding(F.col("text"), GROUPS).alias("v")).select(
        "doc_id", *[F.col("v")[i].alias(f"v{i}") for i in range(len(GROUPS) + 1)]
    )


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.lexical_tokens(F.col("text")).alias("t"), X.words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"), F.size("w").alias("words"))


def bigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", X.round_half_up(X.title_similarity(F.lower("p_name"), F.lower("p_type"))).alias("similarity"))


def citation_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir, "collection", "source_path", "page", "clause", "text", "embedding").where("collection = 'kec' and embedding is not null")
    query = chunks.orderBy("chunk_seq").limit(1).collect()[0]["embedding"]
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = chunks.withColumn("similarity", X.round_half_up(retrieval.cosine(F.col("embedding"), q)))
    kept = retrieval.select_citations(rows, CONTEXT, "text", "similarity", 0.5, ALIASES, STOP, "clause")
    return kept.select("chunk_seq", "similarity", "overlap", X.round_half_up(F.col("relative")).alias("relative"))


def company_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company chunks that share a word with the context: similarity, overlap, path, page, chunk."""
    chunks = _chunks(spark, sf_dir, "collection", "source_path", "page", "text", "embedding").where("collection = 'company' and embedding is not null")
    query = chunks.orderBy("chunk_seq").limit(1).collect()[0]["embedding"]
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = chunks.withColumn("similarity", X.round_half_up(retrieval.cosine(F.col("embedding"), q)))
    rows = retrieval.select_citations(rows, CONTEXT, "text", "similarity", 0.0, stop=STOP)
    top = rows.where("overlap > 0").orderBy(F.desc("similarity"), F.desc("overlap"), "source_path", "page", "chunk_seq").limit(5)
    return top.select("chunk_seq", "similarity", "overlap")


def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(X.fixed_windows(F.col("text"), 1200)).alias("window", "piece"))


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(X.split_paragraphs(F.col("text"))).alias("paragraph", "content"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").dropDuplicates(["doc_id"])
    return docs.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string")).alias("source_path"), F.lit(1).alias("page"), "text")


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_chunks(_pages(spark, sf_dir), "source_path", "page", "text")


def company_chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_chunks(_pages(spark, sf_dir), "source_path", "page", "text", chunking.pack_with_windows)


def clause_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "text").select("chunk_seq", X.clause_of(F.col("text")).alias("clause"))


def clause_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir, "source_path", "page", "chunk_index", "text").where("page is not null").withColumn("clause", X.clause_of(F.col("text")))
    rows = rows.withColumn("place", F.struct("chunk_index", "chunk_seq"))
    return chunking.carry_forward(rows, ["source_path", "page"], "place", "clause").select("chunk_seq", "clause")


def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir, "source_path", "page", "chunk_index", "text").where("text <> ''")
    kept = chunking.char_budget(rows, ["source_path"], [F.col("page").asc_nulls_first(), F.col("chunk_index"), F.col("chunk_seq")], "text", 12000)
    return kept.select("chunk_seq", "used", F.length("kept").alias("n_kept"), "truncated")


def source_text_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "text").select("chunk_seq", X.collapsed(F.col("text")).alias("flat"))


def keyword_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir, "text").where(F.contains(F.lower("text"), F.lit("ground")))
    return rows.select("chunk_seq", X.excerpt(F.col("text"), F.lit("ground")).alias("excerpt"))


def identity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir, "source_path", "chunk_id")
    return rows.select(
        "chunk_seq", F.concat(F.lit("src_"), F.sha2("source_path", 256)).alias("source_id"), F.sha2("chunk_id", 256).alias("chunk_hash")
    )


def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.fnv1a(F.col("p_name")).alias("fnv"))


def sheet_source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "material_knowledge_metadata").select("source_path", "sheet_name").distinct()
    return rows.select("source_path", "sheet_name", F.concat(F.col("source_path"), F.lit("#sheet="), X.url_component(F.col("sheet_name"))).alias("source_key"))


def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "material_knowledge_metadata").dropDuplicates(["listing_id"])
    line = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    fields = ["name", "manufacturer", "model", "category", "specification", "unit", "currency", "revision", "effective_date"]
    return rows.select("listing_id", F.concat_ws("\n", *[line(c) for c in fields]).alias("chunk_text"))


def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written amount with thousands separators back to a number; errors by row."""
    k = F.col("p_partkey")
    spoilt = F.when(k % 7 == 0, "#REF!").when(k % 11 == 0, "").when(k % 13 == 0, "1.2.3").when(k % 17 == 0, F.concat(F.lit(" -"), F.format_number("p_retailprice", 2))).otherwise(F.format_number("p_retailprice", 2))
    parts = table(spark, sf_dir, "part").select("p_partkey", spoilt.alias("written"))
    clean = F.regexp_replace(F.trim("written"), ",", "")
    price = F.when(clean.rlike(r"^-?\d+(\.\d+)?$"), clean.try_cast("double"))
    return parts.select("p_partkey", price.alias("price"), price.isNull().alias("is_error"))


def header_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "material_knowledge_metadata").select(F.col("sheet_name").alias("header")).where("header is not null").distinct()
    key = F.lower(F.regexp_replace(X.collapsed(F.col("header")), " ", "_"))
    return names.select("header", key.alias("key"), (F.count("*").over(Window.partitionBy(key)) > 1).alias("is_duplicate"))


def drawing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawing numbers in item codes and model fields as they are written."""
    m = table(spark, sf_dir, "material_knowledge_metadata").dropDuplicates(["listing_id"]).select("listing_id", F.explode(F.array("item_code", "model", "sheet_name")).alias("written")).where("written is not null")
    return m.select("listing_id", "written", X.drawing_number(F.col("written")).alias("drawing_no")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        lexical_search, lexical_search_ko, semantic_topk, semantic_topk_embeddings, hybrid_search, placeholder_embed, tokenize_stats, bigram_similarity,
        citation_select, company_select, fixed_window_chunks, paragraph_split, chunk_pack, company_chunk_pack, clause_extract, clause_carry_forward,
        char_budget, source_text_collapse, keyword_excerpt, identity_hashes, fnv_hashes, sheet_source_key, row_text, price_parse, header_normalize,
        drawing_numbers,
    )
}

_CH = "ch AS (SELECT DISTINCT * FROM kec_chunks)"
# Compatibility decompositions, character by character, from the Unicode rule; composing them gives NFKC.
_COMPAT = ", ".join(
    f"(chr({c}), '{unicodedata.normalize('NFKD', chr(c)).replace(chr(39), chr(39) * 2)}')"
    for c in range(0x80, 0x20000) if unicodedata.decomposition(chr(c)).startswith("<")
)


def _nfkc_sql(name: str, table: str, key: str, *columns: str) -> str:
    """CTEs that end in ``name``: the columns of ``table`` by ``key`` in form NFKC."""
    parts = [f"{name}_m(c, k) AS (VALUES {_COMPAT})"]
    for col in columns:
        parts.append(
            f"{name}_{col} AS (SELECT {key}, nfc_normalize(string_agg(coalesce(k, x.c), '' ORDER BY i)) AS {col} FROM (SELECT {key}, unnest(string_split({col}, '')) AS c, generate_subscripts(string_split({col}, ''), 1) AS i "
            f"FROM (SELECT DISTINCT {key}, {col} FROM {table} WHERE NOT regexp_full_match({col}, '[\\x00-\\x7f가-힣]*'))) x LEFT JOIN {name}_m m ON m.c = x.c GROUP BY 1)"
        )
    joins = " ".join(f"LEFT JOIN {name}_{col} USING ({key})" for col in columns)
    form = ", ".join(f"coalesce({name}_{col}.{col}, t.{col}) AS {col}" for col in columns)
    return ", ".join(parts) + f", {name} AS (SELECT DISTINCT t.{key}, {form} FROM {table} t {joins})"


_TOK = "list_filter(regexp_extract_all(lower({0}), '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?|\\p{{L}}+'), lambda t: t NOT IN ('and', 'near', 'not', 'or'))"
_SP = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
_R6 = "(floor(({0}) * 1000000.0 + 0.5) / 1000000.0 + 0.0)"


def _lexical_sql(tokens: list[str]) -> str:
    q = "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
    n = len(tokens)
    seq = lambda c: f"(len({c}) >= {n} AND len(list_filter(range(1, len({c}) - {n} + 2), lambda i: {c}[i:i + {n - 1}] = {q})) > 0)"
    score = (
        f"len(list_filter({q}, lambda x: list_contains(t, x) OR list_contains(c, x))) / {float(n)} * 0.55 + CASE WHEN {seq('t')} OR {seq('c')} THEN 0.25 ELSE 0.0 END"
        f" + list_sum(list_transform({q}, lambda x: least(len(list_filter(t, lambda y: y = x)), 3))) / {float(3 * n)} * 0.10 + CASE WHEN c = {q} THEN 0.10 ELSE 0.0 END"
    )
    return f"""{_nfkc_sql('norm', 'kec_chunks', 'chunk_seq', 'text', 'clause')}, lexical AS (SELECT chunk_seq, {_R6.format(score)} AS score
FROM (SELECT DISTINCT chunk_seq, {_TOK.format('text')} AS t, coalesce({_TOK.format('clause')}, CAST([] AS VARCHAR[])) AS c FROM norm)
WHERE len(list_filter({q}, lambda x: list_contains(t, x) OR list_contains(c, x))) > 0 ORDER BY score DESC, chunk_seq LIMIT {LIMIT})"""


def _cos(a: str, b: str) -> str:
    d = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    norm = lambda x: f"list_sum(list_transform({x}, lambda v: v * v))"
    return _R6.format(f"CASE WHEN {norm(d[0])} = 0 OR {norm(d[1])} = 0 THEN 0.0 ELSE list_cosine_similarity({d[0]}, {d[1]}) END")


_SEM = f"""qv AS (SELECT embedding AS q FROM kec_chunks WHERE collection = 'kec' AND embedding IS NOT NULL ORDER BY chunk_seq LIMIT 1),
semantic AS (SELECT chunk_seq, {_cos('embedding', 'q')} AS similarity FROM (SELECT DISTINCT chunk_seq, embedding FROM kec_chunks WHERE collection = 'kec' AND embedding IS NOT NULL), qv
ORDER BY similarity DESC, chunk_seq LIMIT {LIMIT})"""
_CLAUSE = """coalesce('KEC ' || nullif(regexp_extract(text, '(?i)\\bKEC\\s*(\\d+(?:\\.\\d+)*)', 1), ''), '제' || nullif(regexp_extract(text, '제\\s*(\\d+)\\s*조', 1), '') || '조',
nullif(regexp_extract(text, '\\b(\\d{2,4}(?:\\.\\d+)+)\\b', 1), ''))"""
_STOPS = ", ".join(f"'{s}'" for s in STOP)


def _context(aliases: dict[str, str]) -> str:
    import re

    told = sorted({aliases.get(t, t) for t in re.findall(r"[^\W_]+", CONTEXT.lower()) if t not in STOP and not t.isdigit()})
    return "[" + ", ".join(f"'{t}'" for t in told) + "]"


def _mine(aliases: dict[str, str]) -> str:
    base = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: t NOT IN ({_STOPS}) AND NOT regexp_full_match(t, '\\p{{N}}+'))"
    if not aliases:
        return base
    return f"list_transform({base}, lambda t: CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in aliases.items()) + " ELSE t END)"


def _cited(collection: str, aliases: dict[str, str], named: str) -> str:
    return f"""WITH qv AS (SELECT embedding AS q FROM kec_chunks WHERE collection = '{collection}' AND embedding IS NOT NULL ORDER BY chunk_seq LIMIT 1),
r AS (SELECT chunk_seq, source_path, page, {_cos('embedding', 'q')} AS similarity, len(list_distinct(list_intersect({_mine(aliases)}, {_context(aliases)}))) AS overlap, coalesce({named}, false) AS named
FROM (SELECT DISTINCT chunk_seq, source_path, page, clause, text, embedding FROM kec_chunks WHERE collection = '{collection}' AND embedding IS NOT NULL), qv),
s AS (SELECT *, max(similarity) FILTER ((overlap > 0 OR named) AND similarity > 0) OVER () AS top FROM r)"""


_PARTS = f"""d AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\\n{{2,}}'), lambda p: trim(regexp_replace(p, '{_SP}+', ' ', 'g'))), lambda p: p <> '') AS blank,
list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '([.!?。]){_SP}+', '\\1' || chr(1), 'g'), '[\\x01\\n]+'), lambda p: trim(regexp_replace(p, '{_SP}+', ' ', 'g'))), lambda p: p <> '') AS fine FROM d),
p AS (SELECT doc_id, CASE WHEN len(blank) > 1 THEN blank ELSE fine END AS parts FROM b)"""
_FIELDS = ["name", "manufacturer", "model", "category", "specification", "unit", "currency", "revision", "effective_date"]
_ENC = "list_transform(string_split(sheet_name, ''), lambda c: c)"

SQL = {
    "lexical_search": f"WITH {_lexical_sql(['surge', 'arrester', 'lead'])} SELECT * FROM lexical",
    "lexical_search_ko": f"WITH {_lexical_sql(['접지저항기', '보호도체'])} SELECT * FROM lexical",
    "semantic_topk": f"WITH {_SEM} SELECT * FROM semantic",
    "semantic_topk_embeddings": f"""WITH qv AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, {_cos('embedding', 'q')} AS similarity FROM embeddings, qv ORDER BY similarity DESC, vec_id LIMIT {LIMIT}""",
    "hybrid_search": f"""WITH {_SEM}, {_lexical_sql(['surge', 'arrester', 'lead'])}
SELECT coalesce(s.chunk_seq, l.chunk_seq) AS chunk_seq, s.similarity AS semantic_score, l.score AS lexical_score,
{_R6.format('coalesce(s.similarity, 0.0) * 0.6 + coalesce(l.score, 0.0) * 0.4')} AS score FROM semantic s FULL OUTER JOIN lexical l ON s.chunk_seq = l.chunk_seq
ORDER BY score DESC, s.similarity IS NULL, s.similarity DESC, l.score IS NULL, l.score DESC, 1 LIMIT {LIMIT}""",
    "placeholder_embed": "SELECT doc_id, "
    + ", ".join(f"CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in g)} THEN 1.0 ELSE 0.0 END::DOUBLE AS v{i}" for i, g in enumerate(GROUPS))
    + ", CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS v3 FROM documents WHERE text IS NOT NULL",
    "tokenize_stats": f"""WITH {_nfkc_sql('norm', 'documents', 'doc_id', 'text')}
SELECT doc_id, len({_TOK.format('n.text')}) AS tokens, len(list_distinct({_TOK.format('n.text')})) AS distinct_tokens,
len(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}]+')) AS words FROM documents d JOIN norm n USING (doc_id) WHERE d.text IS NOT NULL""",
    "bigram_similarity": f"""WITH g AS (SELECT p_partkey, lower(p_name) a, lower(p_type) b,
list_distinct(list_transform(range(1, length(lower(p_name))), lambda i: substr(lower(p_name), i, 2))) ga, list_distinct(list_transform(range(1, length(lower(p_type))), lambda i: substr(lower(p_type), i, 2))) gb FROM part)
SELECT p_partkey, {_R6.format("CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) WHEN greatest(len(ga), len(gb)) = 0 THEN 0.0 ELSE len(list_intersect(ga, gb)) / greatest(len(ga), len(gb)) END")} AS similarity FROM g""",
    "citation_select": f"""{_cited('kec', ALIASES, f"contains('{CONTEXT}', clause)")}
SELECT chunk_seq, similarity, overlap, {_R6.format('similarity / top')} AS relative FROM s WHERE (overlap > 0 OR named) AND similarity > 0 AND similarity / top >= 0.5""",
    "company_select": f"""{_cited('company', {}, 'false')}
SELECT chunk_seq, similarity, overlap FROM s WHERE overlap > 0 AND similarity > 0 ORDER BY similarity DESC, overlap DESC, source_path, page, chunk_seq LIMIT 5""",
    "fixed_window_chunks": """SELECT doc_id, CAST(i / 660 AS INTEGER) AS "window", rtrim(substr(text, i + 1, 1200)) AS piece
FROM (SELECT doc_id, text, unnest(range(0, CAST(CASE WHEN length(text) > 1200 THEN ceil((length(text) - 1200) / 660.0) * 660 ELSE 0 END AS BIGINT) + 1, 660)) AS i FROM documents WHERE text IS NOT NULL)""",
    "paragraph_split": f"WITH {_PARTS} SELECT doc_id, CAST(i - 1 AS INTEGER) AS paragraph, parts[i] AS content FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)",
    "clause_extract": f"SELECT DISTINCT chunk_seq, {_CLAUSE} AS clause FROM kec_chunks",
    "clause_carry_forward": f"""WITH c AS (SELECT DISTINCT chunk_seq, source_path, page, chunk_index, {_CLAUSE} AS clause FROM kec_chunks WHERE page IS NOT NULL)
SELECT chunk_seq, last_value(clause IGNORE NULLS) OVER (PARTITION BY source_path, page ORDER BY chunk_index, chunk_seq ROWS UNBOUNDED PRECEDING) AS clause FROM c""",
    "char_budget": """WITH c AS (SELECT DISTINCT chunk_seq, source_path, page, chunk_index, text FROM kec_chunks WHERE text <> ''),
u AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY source_path ORDER BY page NULLS FIRST, chunk_index, chunk_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
SELECT chunk_seq, CAST(used AS BIGINT) AS used, CAST(least(length(text), 12000 - used) AS INTEGER) AS n_kept, length(text) > 12000 - used AS truncated FROM u WHERE used < 12000""",
    "source_text_collapse": f"SELECT DISTINCT chunk_seq, trim(regexp_replace(text, '{_SP}+', ' ', 'g')) AS flat FROM kec_chunks",
    "keyword_excerpt": """SELECT DISTINCT chunk_seq, trim(substr(text, greatest(a - 60, 1), a - greatest(a - 60, 1) + 6 + 80)) AS excerpt
FROM (SELECT chunk_seq, text, instr(lower(text), 'ground') AS a FROM kec_chunks) WHERE a > 0""",
    "identity_hashes": "SELECT DISTINCT chunk_seq, 'src_' || sha256(source_path) AS source_id, sha256(chunk_id) AS chunk_hash FROM kec_chunks",
    "fnv_hashes": """SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
lambda h, c: ((xor(h, c)) * 16777619) % 4294967296)::BIGINT AS fnv FROM part""",
    "row_text": "SELECT DISTINCT listing_id, concat_ws(chr(10), " + ", ".join(f"'{c}: ' || {c}" for c in _FIELDS) + ") AS chunk_text FROM material_knowledge_metadata",
    "price_parse": """SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN CAST(format('{:.2f}', p_retailprice) AS DOUBLE) * CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE 1 END END AS price,
p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 AS is_error FROM part""",
    "header_normalize": f"""WITH h AS (SELECT DISTINCT sheet_name AS header FROM material_knowledge_metadata WHERE sheet_name IS NOT NULL),
k AS (SELECT header, lower(replace(trim(regexp_replace(header, '{_SP}+', ' ', 'g')), ' ', '_')) AS key FROM h) SELECT header, key, count(*) OVER (PARTITION BY key) > 1 AS is_duplicate FROM k""",
    "drawing_numbers": r"""WITH m AS (SELECT DISTINCT listing_id, item_code, model, sheet_name FROM material_knowledge_metadata), w AS (SELECT DISTINCT listing_id, unnest([item_code, model, sheet_name]) AS written FROM m),
f AS (SELECT *, upper(regexp_replace(written, '[\s_]+', '-', 'g')) AS flat FROM w WHERE written IS NOT NULL),
h AS (SELECT *, regexp_extract(flat, '(?:^|[^A-Z0-9])([A-Z]{1,4})-?(\d{2,4})-?([A-Z]?)(?:$|[^A-Z0-9])', ['a', 'b', 'c']) AS g FROM f)
SELECT listing_id, written, CASE WHEN g.a <> '' THEN g.a || '-' || g.b || g.c END AS drawing_no FROM h""",
    "sheet_source_key": "SELECT DISTINCT source_path, sheet_name, source_path || '#sheet=' || replace(replace(replace(replace(replace(url_encode(sheet_name), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS source_key FROM material_knowledge_metadata",
}
