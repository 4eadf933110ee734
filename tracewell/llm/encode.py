"""Encoding of the whole corpus with a public tokenizer, and back.

Texts pass the ``tokenizers`` library in Arrow batches; the vocabulary's path is a parameter and the
tokenizer is loaded once per Python worker. Beside the ids, ``encode`` can give the character offsets of
each token. Decoding maps each token's symbols back through the byte table; a character split over
several tokens comes back whole because bytes are joined before they are read as UTF-8.

Defined cases: null and empty texts give an empty list of ids; the strings of special tokens in a text
are ordinary text; very long texts are encoded whole; ids outside the vocabulary raise.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
_BATCH_CHARS = 1 << 20


@lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def vocabulary(directory: str = TOKENIZER_DIR, file: str = BYTE_BPE) -> str:
    return os.path.join(directory, file)


def byte_table() -> dict[str, int]:
    """Symbol to byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {chr(b): b for b in own}, 0x100
    for b in range(256):
        if b not in own:
            table[chr(spare)] = b
            spare += 1
    return table


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> dict[int, bytes]:
    back = byte_table()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in vocab.items()}


def slices(texts: list[str]):
    """Runs of texts of bounded total length, so that a batch of long texts is encoded bit by bit."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _BATCH_CHARS:
            yield texts[begin:i]
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield texts[begin:]


def encode_ids(text: str | Column, path: str | None = None) -> Column:
    """array<int> of token ids."""
    path = path or vocabulary()

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        tokenizer, out = load(path), []
        for part in slices([t or "" for t in texts]):
            out += [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return pd.Series(out, dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)


BYTE_RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this kind cut a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def load_ranks(path: str):
    """The same vocabulary as ranks, for counting: pieces of text that occur again are not merged again."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | Column, path: str | None = None) -> Column:
    """Tokens of each text, without special tokens; null and empty texts have none."""
    path = path or vocabulary(file=BYTE_RANKS)

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        encoding = load_ranks(path)
        return pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return run(F.col(text) if isinstance(text, str) else text)


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None, offsets: bool = False) -> DataFrame:
    """key, ids (and starts, ends: character offsets of each token), one row per distinct document."""
    path = path or vocabulary()
    # Repeats go before their texts are encoded; of different texts under one key the greatest stays.
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("body")).groupBy("doc").agg(F.max("body").alias("body"))
    if not offsets:
        return rows.select(F.col("doc").alias(key), encode_ids("body", path).alias("ids"))

    def run(batches):
        tokenizer = load(path)
        for batch in batches:
            ids, starts, ends = [], [], []
            for part in slices([t or "" for t in batch.column("body").to_pylist()]):
                for e in tokenizer.encode_batch(part, add_special_tokens=False):
                    ids.append(e.ids)
                    starts.append([a for a, _ in e.offsets])
                    ends.append([b for _, b in e.offsets])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(ids, kind), pa.array(starts, kind), pa.array(ends, kind)], ["doc", "ids", "starts", "ends"]
            )

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc", key)


def decode_ids(ids: str | Column, path: str | None = None) -> Column:
    """The text of token ids; null stays null."""
    path = path or vocabulary()

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        table = _token_bytes(path)
        return lists.map(lambda x: None if x is None else b"".join([table[int(i)] for i in x]).decode("utf-8", "replace"))

    return run(F.col(ids) if isinstance(ids, str) else ids)
