"""Token ids of a public byte-level BPE vocabulary (problem 7)."""
import base64
import functools

import pandas as pd
import regex
from pyspark.sql import functions as F

from .common import spread

#: Split pattern of the vocabulary, as its description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts longer than this are cut at safe places before they are encoded.
CHUNK = 200_000


@functools.lru_cache(maxsize=4)
def encoder(path=VOCABULARY):
    """The tiktoken encoding of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Places at which the split pattern always begins a new piece: after a letter or digit, before one of the other kind, a sign, or a single
#: blank and another letter or digit. No piece holds a letter or digit and anything after it, and the pattern looks ahead over blanks only.
_SAFE = regex.compile(r"(?<=\p{L})(?=\p{N}|[^\s\p{L}\p{N}])|(?<=\p{N})(?=\p{L}|[^\s\p{L}\p{N}])|(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])")


def pieces(text, size=CHUNK):
    """Cuts of a long text whose encodings, put together, are the encoding of the whole. A run without a safe place stays whole."""
    at, n = 0, len(text)
    while n - at > size:
        m = _SAFE.search(text, at + size)
        if not m or m.start() >= n - 1:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text, path=VOCABULARY):
    """Ids of a text; null and empty texts give []. Strings that look like special tokens are ordinary text."""
    if not text:
        return []
    enc = encoder(path)
    if len(text) <= CHUNK:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def decode(ids, path=VOCABULARY):
    """The text of ids, by raw bytes, so that ids that cut a character do no harm; bytes that are no UTF-8 are replaced."""
    return encoder(path).decode_bytes(list(ids)).decode("utf-8", errors="replace")


def ids_of(df, key="doc_id", text="text", path=VOCABULARY):
    """(key, ids array<int>) of every row. Null and empty texts give the empty list; ties, repeats and other columns do not matter."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": [encode(t, path) for t in b[text]]})

    kind = dict(df.dtypes)[key]
    return spread(df.select(key, text), key).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def with_counts(df, text="text", name="n_tokens", path=VOCABULARY):
    """`df` with the token count of each text, 0 for null and empty ones; only the counts come back from Python."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(t, path)) for t in texts], dtype="int64")

    return df.withColumn(name, count(F.col(text)))
