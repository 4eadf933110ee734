"""Lexical, semantic and hybrid search with total orders on every result."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import OPERATOR_WORDS, TOKEN, lexical_score, lexical_tokens, nfkc, round_half_up, words

MAX_LIMIT, MAX_QUERY, MAX_TOKENS = 100, 4096, 64


def query_tokens(query: str) -> list[str]:
    """The distinct tokens of a query in order; refuses queries beyond the documented sizes."""
    import regex

    if len(query) > MAX_QUERY:
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    raw = regex.findall(TOKEN, unicodedata.normalize("NFKC", query).lower())
    if len(raw) > MAX_TOKENS:
        raise ValueError(f"a query has at most {MAX_TOKENS} tokens")
    return list(dict.fromkeys(t for t in raw if t not in OPERATOR_WORDS))


def lexical_search(chunks: DataFrame, query: str, limit: int, key: str, text: str, clause: str | None = None) -> DataFrame:
    """key, score: the best chunks by score, then key; a limit of 0 or an empty query finds none."""
    if not 0 <= limit <= MAX_LIMIT:
        raise ValueError(f"a limit lies between 0 and {MAX_LIMIT}")
    tokens = query_tokens(query)
    clause_tokens = F.coalesce(lexical_tokens(F.col(clause)), F.array().cast("array<string>")) if clause else F.array().cast("array<string>")
    # Only chunks that hold some token of the query are cut into tokens and scored.
    held = [F.contains(F.lower(nfkc(F.col(c))), F.lit(t)) for t in tokens for c in ([text, clause] if clause else [text])]
    chunks = chunks.where(reduce(lambda a, b: a | b, held, F.lit(False)))
    rows = chunks.select(key, lexical_tokens(F.col(text)).alias("_t"), clause_tokens.alias("_c"))
    scored = rows.select(key, lexical_score(tokens, F.col("_t"), F.col("_c")).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), key).limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common prefix in double precision; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, 1, n), F.slice(b, 1, n)
    dot = F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when((norm(left) == 0) | (norm(right) == 0), 0.0).otherwise(dot / (norm(left) * norm(right)))


def semantic_search(chunks: DataFrame, query: list[float], limit: int, key: str, vector: str) -> DataFrame:
    """key, similarity: ties go to the smaller key; null vectors take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = chunks.where(F.col(vector).isNotNull()).select(key, round_half_up(cosine(F.col(vector), q)).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), key).limit(limit)


def guard_index(metadata: DataFrame, collection: str, provider: str, model: str, dimensions: int) -> None:
    """Refuse a search whose provider, model or dimensions differ from those of the index."""
    row = metadata.where(F.col("collection") == collection).limit(1).collect()
    if not row:
        raise ValueError(f"collection {collection} has no index metadata")
    if (row[0]["provider"], row[0]["model"], row[0]["dimensions"]) != (provider, model, dimensions):
        raise ValueError("the index was written with another embedding")


def hybrid_rank(semantic: DataFrame, lexical: DataFrame, limit: int, key: str, semantic_weight: float = 0.5, lexical_weight: float = 0.5) -> DataFrame:
    """Full outer merge of both sides on the key, then score, presence and scores of each side, key."""
    if min(semantic_weight, lexical_weight) < 0 or not semantic_weight + lexical_weight:
        raise ValueError("weights are not negative and not both zero")
    both = semantic.select(key, F.col("similarity").alias("semantic_score")).join(lexical.select(key, F.col("score").alias("lexical_score")), key, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = round_half_up(zero("semantic_score") * semantic_weight + zero("lexical_score") * lexical_weight)
    ranked = both.withColumn("score", score).orderBy(
        F.desc("score"), F.col("semantic_score").isNull(), F.desc("semantic_score"), F.col("lexical_score").isNull(), F.desc("lexical_score"), key
    )
    return ranked.limit(limit)


def placeholder_embedding(text: Column, groups: list[list[str]]) -> Column:
    """One indicator for each keyword group, and one for a text that is not blank."""
    low = F.lower(text)
    hits = [F.when(F.exists(F.array(*[F.lit(w) for w in g]), lambda w: F.contains(low, w)), 1.0).otherwise(0.0) for g in groups]
    return F.array(*hits, F.when(F.trim(text) != "", 1.0).otherwise(0.0))


def select_citations(results: DataFrame, context: str, text: str, similarity: str, least: float = 0.5, aliases: dict[str, str] | None = None, stop: list[str] | None = None, clause: str | None = None) -> DataFrame:
    """Results supported by the context: a shared word or the clause named there, and a similarity near the best.

    Adds overlap, supported, relative (to the best supported similarity) and keeps relative >= ``least``.
    """
    import regex

    aliases, stop = aliases or {}, stop or []
    told = {aliases.get(t, t) for t in regex.findall(r"[\p{L}\p{N}]+", context.lower()) if t not in stop and not t.isdigit()}
    mine = F.filter(words(F.col(text)), lambda t: ~t.isin(*stop) & ~t.rlike(r"^\p{N}+$") if stop else ~t.rlike(r"^\p{N}+$"))
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        mine = F.transform(mine, lambda t: F.coalesce(F.try_element_at(table, t), t))
    context_set = F.array(*[F.lit(t) for t in sorted(told)]) if told else F.array().cast("array<string>")
    rows = results.withColumn("overlap", F.size(F.array_intersect(mine, context_set)))
    named = F.contains(F.lit(context), F.col(clause)) if clause else F.lit(False)
    rows = rows.withColumn("supported", F.coalesce((F.col("overlap") > 0) | named, F.lit(False)))
    best = rows.where(F.col("supported") & (F.col(similarity) > 0)).agg(F.max(similarity).alias("_top"))
    rows = rows.join(F.broadcast(best))
    relative = F.when(F.col("supported") & (F.col(similarity) > 0) & (F.col("_top") > 0), F.col(similarity) / F.col("_top")).otherwise(0.0)
    rows = rows.withColumn("relative", relative).drop("_top")
    return rows.where(F.col("supported") & (F.col(similarity) > 0) & (F.col("relative") >= least))
