"""Stable hashes: digests, their residues, hashed splits and anonymised keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import _c, token_line
from tesserae.functions.vectors import let


def digest(c) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(_c(c), 256)


def text_digest(c) -> Column:
    """SHA-256 of the tokens of a text; null where it has none."""
    line = token_line(c)
    return F.when(line != "", F.sha2(line, 256))


def digest_mod(c, n) -> Column:
    """The 256-bit digest, read as a number, modulo ``n`` (up to 2**30), eight hexadecimal digits at a time."""
    n = F.lit(n).cast("long") if isinstance(n, int) else _c(n).cast("long")

    def fold(hexed: Column) -> Column:
        parts = F.array(*[F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)])
        return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: (acc * 4294967296 + x) % n)

    return let(digest(c), fold)


def hash_split(c, train: float = 0.7, val: float = 0.15) -> Column:
    """train, val or test by the digest's residue over 10,000 against the cumulative shares."""
    return let(digest_mod(c, 10_000) / F.lit(10_000.0), lambda v: F.when(v < train, "train").when(v < train + val, "val").otherwise("test"))


def anonymous_id(c, prefix: str = "id_") -> Column:
    """A prefix and the first eight digits of an MD5; null stays null."""
    return F.concat(F.lit(prefix), F.substring(F.md5(_c(c)), 1, 8))


def fingerprint_id(prefix: str, *cols) -> Column:
    """A prefix and twelve digits of the SHA-256 of the columns as JSON, keys in order; null columns are left out."""
    names = sorted(cols)
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*names)), 256), 1, 12))


def pseudo_identity(vec, dims: int = 32) -> Column:
    """A key for a vector without identity: its first components to four decimals, joined and hashed to 16 digits."""
    head = F.transform(F.slice(_c(vec), 1, dims), lambda x: F.format_string("%.4f", x.cast("double")))
    return F.substring(F.sha2(F.array_join(head, "|"), 256), 1, 16)


def word_id(c, vocabulary: int) -> Column:
    """A stable id from 1 to vocabulary - 1 for a word: its MD5 modulo (vocabulary - 1), plus 1."""
    hexed = F.md5(_c(c))
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(hexed, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    n = F.lit(vocabulary - 1).cast("long")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: (acc * 4294967296 + x) % n) + 1


def token_ids(c, vocabulary: int = 32768, length: int = 32) -> Column:
    """Ids of the words between white space, cut or filled with 0 to ``length``."""
    parts = F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"\s+"), lambda w: w != "")
    ids = F.transform(F.slice(parts, 1, length), lambda w: word_id(w, vocabulary))
    return F.concat(ids, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(ids)))
