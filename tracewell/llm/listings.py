"""Product listings describing the same item.

1. Every listing is folded and read once: maker, model, free words, all attribute values.
2. A reference dictionary is built up from trusted listings, those whose model field mixes letters and
   digits. Where a model code falls into product line and variant is mined from where sellers put separators:
   for each shape of code (letters and digits by place) the commonest place, the last of equals. Lines told in
   names, in the shape of the lines mined, and the series names that occur with one line only are added.
   Spellings of a maker are tied together where they sell the same lines.
3. Aho-Corasick automata find the dictionary's phrases in every listing; the longest match consistent with
   the listing's maker is taken, from the model field, the name, then the specification. A variant that
   follows a line and makes up a mined shape completes the code. Codes in the specification are those of
   other products (what it replaces or fits) and give no more than a line.
4. The attributes left decide the variant. Those a line is rated by are the ones on which the listings of one
   code agree; prices, packages and remarks state numbers too, but do not agree. Within a line equal
   rated attributes mean one product, unless several codes share them; a listing without a code whose attributes are incomplete or stated
   with others joins the only variant it can be.

Products are keyed (line, attributes) or, where a code's attributes are incomplete, by the code.

The dictionary grows with the number of product lines. Up to ``SHARD`` phrases are broadcast. Beyond that,
phrases are sharded by their first letters, and a listing goes only to the shards of the letters its words
begin with, so no shard meets all listings.

Defined cases: null fields count as empty; a listing without line or with undecided variant is a product
of its own; repeated rows count once; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.folding import fold_key
from tracewell.llm.attributes import read_attributes
from tracewell.session import cut

SHARD, SHARD_ROWS, MOST_SHAPES = 200_000, 100_000, 100_000
AGREE, STATED = 0.8, 0.1
_FIRM = re.compile(r"\(주\)|㈜|주식회사|\bco\., ?ltd\.?|\binc\.?(?!\w)|\bcorp\.?(?!\w)|\bltd\.?(?!\w)")
_TOKEN = re.compile(r"[a-z]{4,}|[가-힣]{3,}")
# A word of letters and digits that begins with a letter, its parts joined by single signs; models also by blanks.
_MIXED = re.compile(r"(?<![^\W_])[a-z][a-z\d]*(?:[-_/][a-z\d]+)*(?![^\W_])")
_MODEL = re.compile(r"[^\W_]+(?:[-_/ .][^\W_]+)*")
_LONGEST = 24
FIELDS = ["name", "manufacturer", "model", "specification"]
_BREAKS = "-_/ ."

_READ = "maker string, model_flat string, breaks array<int>, mixed array<string>, words array<string>, attrs map<string,array<string>>, model_text string, name_text string, spec_text string"


# Revised Romanisation of initial consonants and vowels, in Unicode order.
_INITIALS = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")


def romanised(word: str) -> str | None:
    """A Hangul word of open syllables in Latin letters; a name is often given in either script."""
    out = []
    for ch in word:
        at = ord(ch) - 0xAC00
        if not 0 <= at < 11172 or at % 28:
            return None
        out.append(_INITIALS[at // 588] + _VOWELS[at % 588 // 28])
    return "".join(out)


def flattened(text: str) -> tuple[str, list[int]]:
    """(text without separators, places of the separators in it)."""
    out, breaks = [], []
    for ch in text:
        if ch in _BREAKS:
            breaks.append(len(out))
        else:
            out.append(ch)
    return "".join(out), breaks


def shape(code: str) -> str:
    """Letters and digits by place."""
    return "".join("9" if ch.isdigit() else "a" for ch in code)


def _coded(flat: str) -> bool:
    return 3 < len(flat) <= _LONGEST and any(ch.isdigit() for ch in flat) and any(ch.isalpha() for ch in flat)


def read_listing(name: str | None, maker: str | None, model: str | None, spec: str | None) -> tuple:
    name, maker, model, spec = ((fold_key(x) or "") for x in (name, maker, model, spec))
    maker = " ".join(_FIRM.sub(" ", maker).split())
    flat, breaks = flattened(model) if _MODEL.fullmatch(model) else ("", [])
    mixed = {f for m in _MIXED.findall(name) if _coded(f := flattened(m)[0])}
    attrs = read_attributes(name + " | " + spec)
    words = {romanised(w) or w for w in _TOKEN.findall(name)}
    name += "".join(f" | {r}" for w in _TOKEN.findall(name) if (r := romanised(w)))
    known = any(ch.isalnum() for ch in maker)
    return (maker if known else None, flat if _coded(flat) else None, breaks, sorted(mixed), sorted(words), attrs, model, name, spec)


def read_listings(df: DataFrame) -> DataFrame:
    rows = df.select("listing_id", *[F.col(c).cast("string").alias(c) for c in FIELDS]).where("listing_id is not null").dropDuplicates(["listing_id"])
    columns = [c.split()[0] for c in _READ.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in _READ.split(', '))}>")
    def run(name: pd.Series, maker: pd.Series, model: pd.Series, spec: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_listing(*x) for x in zip(name, maker, model, spec)], columns=columns)

    return rows.select("listing_id", run(*FIELDS).alias("r")).select("listing_id", "r.*")


def _shape(code: str) -> Column:
    return F.regexp_replace(F.regexp_replace(code, r"\p{Nd}", "9"), r"[^9]", "a")


def code_shapes(read: DataFrame) -> dict[str, int]:
    """Shape of model codes to the place where the line ends; a shape that no seller separates is all line."""
    models = read.where("model_flat is not null").withColumn("shape", _shape("model_flat"))
    inner = F.filter("breaks", lambda b: (b > 0) & (b < F.length("model_flat")))
    places = models.select("shape", F.explode(F.array_distinct(inner)).alias("place")).groupBy("shape", "place").agg(F.count("*").alias("n"))
    best = places.groupBy("shape").agg(F.max_by("place", F.struct("n", "place")).alias("place"))
    whole = models.groupBy("shape").agg(F.length("shape").alias("all")).join(best, "shape", "left")
    rows = whole.select("shape", F.coalesce("place", "all").alias("place")).limit(MOST_SHAPES + 1).collect()
    if len(rows) > MOST_SHAPES:
        raise ValueError(f"more than {MOST_SHAPES} shapes of model codes")
    return dict(map(tuple, rows))


def maker_spellings(trusted: DataFrame) -> DataFrame:
    """spelling, brand: each spelling goes to the commonest one it shares at least half of its lines with.

    Lines sold under one spelling only say nothing and are left out of the shares.
    """
    pairs = trusted.select("line", "maker").distinct()
    sizes = pairs.groupBy("maker").agg(F.count("*").alias("n"))
    shared = pairs.join(pairs.groupBy("line").agg(F.count("*").alias("k")).where("k > 1").select("line"), "line")
    base = shared.groupBy("maker").agg(F.count("*").alias("lines"))
    both = shared.alias("a").join(shared.alias("b"), "line").where("a.maker <> b.maker")
    both = both.groupBy(F.col("a.maker").alias("maker"), F.col("b.maker").alias("other")).agg(F.count("*").alias("c"))
    both = both.join(base, "maker").join(sizes.withColumnRenamed("maker", "other").withColumnRenamed("n", "size"), "other").join(sizes, "maker")
    best = both.where("2 * c >= lines and (size > n or (size = n and other < maker))").groupBy("maker").agg(F.max_by("other", F.struct("size", "other")).alias("other"))
    return sizes.select("maker").join(best, "maker", "left").select(F.col("maker").alias("spelling"), F.coalesce("other", "maker").alias("brand"))


def reference_dictionary(read: DataFrame, shapes: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(phrase, line, brand; spelling, brand): phrases written without separators, and the makers' spellings."""
    spark = read.sparkSession
    codes = spark.createDataFrame([*shapes.items()] or [("", 0)], "shape string, place int")
    lines_ = spark.createDataFrame([(x,) for x in sorted({s[:p] for s, p in shapes.items()})] or [("",)], "shape string")
    models = read.where("model_flat is not null").withColumn("shape", _shape("model_flat")).join(F.broadcast(codes), "shape")
    models = models.select("maker", "words", F.substring(F.col("model_flat"), F.lit(1), F.col("place")).alias("line"))
    trusted = models.where("maker is not null")
    brands = cut(maker_spellings(trusted))
    counted = trusted.groupBy("line", "maker").agg(F.count("*").alias("n")).join(brands, F.col("maker") == F.col("spelling"))
    counted = counted.groupBy("line", "brand").agg(F.sum("n").alias("n")).groupBy("line").agg(F.max_by("brand", F.struct("n", "brand")).alias("brand"))
    told = read.select("words", F.explode("mixed").alias("token")).withColumn("shape", _shape("token"))
    told = told.join(F.broadcast(codes), "shape", "left").join(F.broadcast(lines_.withColumn("whole", F.lit(True))), "shape", "left")
    told = told.select("words", F.when(F.col("place").isNotNull(), F.substring(F.col("token"), F.lit(1), F.col("place"))).when(F.col("whole"), F.col("token")).alias("line")).where("line is not null")
    every = models.select("words", "line").unionByName(told)
    lines = every.select("line").distinct().join(counted, "line", "left")
    words = every.select("line", F.explode("words").alias("phrase")).groupBy("phrase").agg(F.min("line").alias("line"), F.max("line").alias("last"))
    words = words.where("line = last").drop("last").join(brands, F.col("phrase") == F.col("spelling"), "left_anti")
    names = words.join(counted, "line", "left")
    return lines.select(F.col("line").alias("phrase"), "line", "brand").unionByName(names.select("phrase", "line", "brand")), brands


_BUILT: dict[int, tuple] = {}


def _automaton(phrases: list):
    """The automaton of a broadcast list, built once a worker; the list is kept so its id stays its own."""
    if id(phrases) not in _BUILT:
        _BUILT.clear()
        _BUILT[id(phrases)] = (phrases, _build(phrases))
    return _BUILT[id(phrases)][1]


def _build(phrases):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, line, brand in phrases:
        found.add_word(phrase, (len(phrase), line, brand))
    if len(found):
        found.make_automaton()
    return found


def _matches(automaton, text: str, shapes: dict[str, int]):
    """(has code, unbroken, length, -start, line, code), brand of the phrases standing free in a text, separators ignored."""
    kept = [i for i, ch in enumerate(text) if ch not in _BREAKS]
    flat = "".join(text[i] for i in kept)
    word = lambda i: 0 <= i < len(text) and text[i].isalnum()
    for end, (length, line, brand) in automaton.iter(flat):
        first, last = kept[end - length + 1], kept[end]
        if word(first - 1):
            continue
        code = None
        if length == len(line) and flat[end - length + 1 : end + 1] == line:
            # A variant may follow a line at once or after one separator.
            at = last + 1 + (last + 2 < len(text) and text[last + 1] in _BREAKS and word(last + 2))
            stop = at
            while word(stop):
                stop += 1
            rest = text[at:stop]
            if rest and rest.isalnum() and shapes.get(shape(line + rest)) == len(line):
                code = line + rest
        if code or not word(last + 1):
            yield (code is not None, " " not in text[first : last + 1], length, -first, line, code), brand


_HIT = "struct<rank:int,coded:boolean,unbroken:boolean,length:int,start:int,line:string,code:string>"


def _find(automaton, shapes: dict[str, int], brand, fields) -> tuple:
    """The best match of the first field that has one; codes told in the specification are other products'."""
    best = None
    for rank, text in enumerate(fields):
        if best is None and text and len(automaton):
            for (coded, *at, line, code), owner in _matches(automaton, text, shapes):
                if rank == 2:
                    coded, code = False, None
                if (brand is None or owner is None or brand == owner) and (best is None or (-rank, coded, *at, line, code or "") > best):
                    best = (-rank, coded, *at, line, code or "")
    return best or (None,) * 7


def find_lines(read: DataFrame, dictionary: DataFrame, shapes: dict[str, int], shard: int = SHARD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """listing_id, line, code (null: none told): the longest dictionary phrase consistent with the maker, by field order."""
    spark, total = read.sparkSession, dictionary.count()
    texts = read.select("listing_id", "brand", "model_text", "name_text", "spec_text")
    columns = ["rank", "coded", "unbroken", "length", "start", "line", "code"]
    if total <= shard:
        held = spark.sparkContext.broadcast([tuple(r) for r in dictionary.select("phrase", "line", "brand").collect()])

        @F.pandas_udf(_HIT)
        def run(brand: pd.Series, model: pd.Series, name: pd.Series, spec: pd.Series) -> pd.DataFrame:
            automaton = _automaton(held.value)
            return pd.DataFrame([_find(automaton, shapes, b, fields) for b, *fields in zip(brand, model, name, spec)], columns=columns)

        hits = texts.select("listing_id", run("brand", "model_text", "name_text", "spec_text").alias("hit"))
    else:
        shards = -(-total // shard)
        key = lambda letters: zlib.crc32(letters.encode()) % shards

        @F.pandas_udf("array<int>")
        def goes(model: pd.Series, name: pd.Series, spec: pd.Series) -> pd.Series:
            def of(fields) -> list[int]:
                out = set()
                for text in fields:
                    flat, starts, inside = [], [], False
                    for ch in text or "":
                        if ch not in _BREAKS:
                            if not inside and ch.isalnum():
                                starts.append(len(flat))
                            flat.append(ch)
                        inside = ch.isalnum()
                    out |= {key("".join(flat[s : s + 3])) for s in starts}
                return sorted(out)

            return pd.Series([of(x) for x in zip(model, name, spec)])

        @F.pandas_udf("int")
        def owner(phrase: pd.Series) -> pd.Series:
            return phrase.map(lambda p: key(p[:3])).astype("int32")

        salts = max(1, -(-texts.count() // (shards * shard_rows)))
        spread = texts.withColumn("shard", F.explode(goes("model_text", "name_text", "spec_text"))).withColumn("salt", F.pmod(F.xxhash64("listing_id"), F.lit(salts)).cast("int"))
        phrases = dictionary.select("phrase", "line", "brand", owner("phrase").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

        def within(rows: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
            clean = mine[["phrase", "line", "brand"]].astype(object)
            automaton = _build(list(clean.where(clean.notna(), None).itertuples(index=False, name=None)))
            fields = rows[["brand", "model_text", "name_text", "spec_text"]].astype(object)
            found = [_find(automaton, shapes, b, f) for b, *f in fields.where(fields.notna(), None).itertuples(index=False, name=None)]
            return pd.DataFrame([(i, *h) for i, h in zip(rows["listing_id"], found) if h[0] is not None], columns=["listing_id", *columns])

        flat = spread.groupBy("shard", "salt").cogroup(phrases.groupBy("shard", "salt")).applyInPandas(within, "listing_id long, " + _HIT[7:-1].replace(":", " "))
        hits = flat.groupBy("listing_id").agg(F.max(F.struct(*columns)).alias("hit"))
    return hits.where("hit.line is not null").select("listing_id", "hit.line", F.nullif("hit.code", F.lit("")).alias("code"))


def product_keys(listings: DataFrame, shard: int = SHARD) -> DataFrame:
    """listing_id, product: a null product is a listing that no dictionary phrase or variant decides."""
    read = cut(read_listings(listings))
    shapes = code_shapes(read)
    dictionary, brands = reference_dictionary(read, shapes)
    read = read.join(brands, F.col("maker") == F.col("spelling"), "left").drop("spelling")
    lines = cut(find_lines(read, cut(dictionary), shapes, shard))
    # Series known from no trusted listing: words that no listing with a line has stand for a line of their own.
    loose = read.join(lines, "listing_id", "left_anti").where("model_flat is null").select("listing_id", F.explode("words").alias("word"))
    taken = read.join(lines, "listing_id", "left_semi").select(F.explode("words").alias("word")).distinct()
    spelled = brands.select(F.regexp_replace("spelling", " ", "").alias("word")).distinct()
    loose = loose.join(taken, "word", "left_anti").join(spelled, "word", "left_anti").groupBy("listing_id").agg(F.max(F.struct(F.length("word"), "word"))["word"].alias("line"))
    lines = lines.unionByName(loose.withColumn("code", F.lit(None).cast("string")))
    lined = cut(read.select("listing_id", "attrs").join(lines, "listing_id"))

    # What each code says by majority, and on which attributes the listings of one code agree.
    votes = lined.where("code is not null").select("listing_id", "line", "code", F.explode("attrs").alias("kind", "values"))
    stated = votes.groupBy("line", "code", "kind").agg(F.count("*").alias("stated"))
    modes = votes.select("line", "code", "kind", F.explode("values").alias("value")).groupBy("line", "code", "kind", "value").agg(F.count("*").alias("n"))
    modes = modes.groupBy("line", "code", "kind").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n")).join(stated, ["line", "code", "kind"])
    agreed = modes.groupBy("line", "kind").agg((F.sum("n") / F.sum("stated")).alias("agreed"))
    counts = lined.select("line", F.explode(F.map_keys("attrs")).alias("kind")).groupBy("line", "kind").agg(F.count("*").alias("n"))
    sizes = lined.groupBy("line").agg(F.count("*").alias("size"))
    rated = counts.join(sizes, "line").join(agreed, ["line", "kind"], "left").where((F.col("n") >= F.col("size") * STATED) & (F.coalesce("agreed", F.lit(1.0)) >= AGREE))
    # A kind on which all codes of a line agree tells no variants apart: it may contradict, and need not be stated.
    kinds = modes.groupBy("line", "kind").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    rated = rated.join(kinds, ["line", "kind"], "left").select("line", "kind", F.when(F.col("least") == F.col("most"), F.col("least")).alias("fixed"))
    rated = cut(rated)
    by_line = rated.groupBy("line").agg(
        F.sort_array(F.collect_set(F.when(F.col("fixed").isNull(), F.col("kind")))).alias("rated"), F.array_compact(F.collect_list(F.when(F.col("fixed").isNotNull(), F.struct("kind", "fixed")))).alias("fixed")
    )
    modes = modes.join(rated, ["line", "kind"], "left_semi")
    said = modes.groupBy("line", "code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "value")))).alias("said"))

    def with_kinds(rows: DataFrame) -> DataFrame:
        rows = rows.join(by_line, "line", "left").withColumn("rated", F.coalesce("rated", F.array().cast("array<string>")))
        return rows.withColumn("fixed", F.coalesce("fixed", F.array().cast("array<struct<kind:string,fixed:string>>")))

    def tuple_key(value):
        """A key of line and rated attributes where each of these has one value."""
        values = F.transform("rated", value)
        full = (F.size("rated") > 0) & F.forall(values, lambda v: v.isNotNull())
        return F.when(full, F.concat_ws("|", F.col("line"), F.array_join(F.zip_with("rated", values, lambda k, v: F.concat_ws("=", k, v)), "|")))

    codes = lined.where("code is not null").select("line", "code").distinct()
    variants = with_kinds(codes.join(said, ["line", "code"], "left")).withColumn("said", F.coalesce("said", F.create_map().cast("map<string,string>")))
    variants = variants.withColumn("tuple", tuple_key(lambda k: F.try_element_at(F.col("said"), k)))
    # A maker gives each variant one code: attributes that several codes share do not tell these apart.
    shared = cut(variants.where("tuple is not null").groupBy("tuple").agg(F.count("*").alias("n")).where("n > 1").select("tuple", F.lit(True).alias("several")))
    variants = variants.join(shared, "tuple", "left").withColumn("key", F.when(F.col("several"), F.col("code")).otherwise(F.coalesce("tuple", "code")))
    variants = cut(variants.select("line", "code", "said", "key"))
    coded = lined.where("code is not null").join(variants.select("code", F.col("key").alias("product")), "code").select("listing_id", "product")
    bare = with_kinds(lined.where("code is null"))
    one = lambda k: F.when(F.size(F.try_element_at(F.col("attrs"), k)) == 1, F.try_element_at(F.col("attrs"), k)[0])
    usual = F.forall("fixed", lambda f: F.coalesce(F.array_contains(F.try_element_at(F.col("attrs"), f["kind"]), f["fixed"]), F.lit(True)))
    bare = bare.withColumn("tuple", F.when(usual, tuple_key(one))).join(shared, "tuple", "left")
    bare = cut(bare.withColumn("key", F.when(F.col("several").isNull(), F.col("tuple"))).drop("tuple", "several"))
    whole = bare.where("key is not null").select("listing_id", F.col("key").alias("product"))
    # Incomplete or stated with other numbers: of the variants it contradicts in nothing, the one it shares most with.
    part = bare.where("key is null").select("listing_id", "line", "attrs", F.concat("rated", F.transform("fixed", lambda f: f["kind"])).alias("rated")).join(variants, "line")
    same = lambda k: F.array_contains(F.try_element_at(F.col("attrs"), k), F.try_element_at(F.col("said"), k))
    part = part.where(F.forall("rated", lambda k: F.coalesce(same(k), F.lit(True)))).withColumn("shared", F.size(F.filter("rated", lambda k: F.coalesce(same(k), F.lit(False)))))
    part = part.groupBy("listing_id", "key").agg(F.max("shared").alias("shared")).groupBy("listing_id").agg(
        F.max_by("key", F.struct("shared", "key")).alias("product"), F.max("shared").alias("most"), F.sort_array(F.collect_list("shared"), False).alias("all")
    )
    part = part.where((F.size("all") == 1) | (F.col("all")[0] > F.col("all")[1])).select("listing_id", "product")
    return coded.unionByName(whole).unionByName(part)


def same_product_pairs(keys: DataFrame) -> DataFrame:
    """listing_id_a < listing_id_b of one product."""
    a = keys.select("product", F.col("listing_id").alias("listing_id_a"))
    b = keys.select("product", F.col("listing_id").alias("listing_id_b"))
    return a.join(b, "product").where("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")
