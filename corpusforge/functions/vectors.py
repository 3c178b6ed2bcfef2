"""Vector and n-gram similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.text import col, tokens


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def is_valid(a, dimension: int) -> Column:
    """Right length, all finite, not zero."""
    finite = F.forall(col(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(col(a)) == dimension) & finite & (norm(a) > 0), F.lit(False))


def normalise(a) -> Column:
    return F.transform(col(a), lambda x: x.cast("double") / norm(a))


def hashing_embedding(text, dimension: int = 64) -> Column:
    """Offline embedding: each token's SHA-256 names a cell and a sign; the sum is scaled to length one."""
    hashed = F.transform(tokens(text), lambda t: F.sha2(t, 256))
    cell = F.transform(hashed, lambda h: F.struct((F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dimension).alias("i"), F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("s")))

    def let(value, use):  # a value that is used many times is computed once
        return F.transform(F.array(value), use)[0]

    def summed(cells):
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(cells, lambda c: c["i"] == i), F.lit(0.0), lambda acc, c: acc + c["s"]))

    def scaled(raw):
        return let(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x)), lambda n: F.when(n > 0, F.transform(raw, lambda x: x / n)).otherwise(raw))

    return let(let(cell, summed), scaled)


def trigrams(text) -> Column:
    """Distinct three-letter pieces of the words of a text, two blanks ahead of a word and one behind."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def trigram_similarity(a, b) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def word_similarity(query, text) -> Column:
    """The best share of the query's trigrams in one word of the text, or in all of it if that is less."""
    q = trigrams(query)
    return F.coalesce(F.size(F.array_intersect(q, trigrams(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def packer():
    """A function of an array column: its values as little-endian 32-bit floats in base64."""
    import base64

    import numpy as np

    def pack(v):
        return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())

    return F.pandas_udf(pack, "string", F.PandasUDFType.SCALAR)


def unpacker():
    """The way back, to an array of floats."""
    import base64

    import numpy as np

    def unpack(v):
        return v.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))

    return F.pandas_udf(unpack, "array<float>", F.PandasUDFType.SCALAR)
