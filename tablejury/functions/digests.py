"""Keyed digests: the only source of randomness, equal on every run and engine."""

from pyspark.sql import functions as F


def digest(seed, *columns):
    """md5 of the seed and the key columns joined by ``|``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)) if not hasattr(seed, "cast") else seed.cast("string"),
                             *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                               for c in columns]))


def unit(digest_column):
    """Uniform number in [0,1) from the first 13 hex digits (52 bits, exact in a double)."""
    return F.conv(F.substring(digest_column, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def seed_int(*parts, digits=8):
    """First hex digits (8, at most 15) of SHA-256 over the parts joined by two bars, as an integer."""
    joined = F.concat_ws("||", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string")
                                 for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, digits), 16, 10).cast("bigint")
