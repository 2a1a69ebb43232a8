"""Names, path keys, group keys and seeded hashes as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNKNOWN = "unknown"


def _or_unknown(c: Column) -> Column:
    return F.when(c == "", UNKNOWN).otherwise(c)


def sanitize_class(name: Column) -> Column:
    """ASCII word characters, white space and hyphens only; white space to single underscores; case is kept."""
    c = F.regexp_replace(name, r"[^A-Za-z0-9_\s-]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", "_"), "_+", "_")
    return _or_unknown(F.btrim(c, F.lit("_")))


def stem(path: Column) -> Column:
    """File name without folders and last suffix; a name that only has a leading dot keeps it."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def sanitize_file(name: Column) -> Column:
    """Lower-case stem with the characters of ``sanitize_class``; white space and hyphens to underscores."""
    c = F.regexp_replace(F.lower(stem(name)), r"[^a-z0-9_\s-]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[\s-]+", "_"), "_+", "_")
    return _or_unknown(F.btrim(c, F.lit("_")))


#: White space of all of Unicode, with the separators U+001C to U+001F.
SPACE = r"(?U:[\s\x1c-\x1f])"


@F.pandas_udf(StringType())
def _nfc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x).casefold())


def path_key(path: Column) -> Column:
    """A path in the form that sidecar rows are matched by. Names beyond ASCII leave the JVM; the others send a null."""
    c = F.replace(F.regexp_replace(path, rf"^{SPACE}+|{SPACE}+$", ""), F.lit("\\"), F.lit("/"))
    c = F.regexp_replace(F.regexp_replace(c, r"^(\./)+", ""), "^/+", "")
    beyond = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.when(beyond.isNotNull(), _nfc_casefold(beyond)).otherwise(F.lower(c))


def clean_text(text: Column) -> Column:
    """White space (of all of Unicode) collapsed; null unless a letter or digit is left."""
    c = F.btrim(F.regexp_replace(text, SPACE + "+", " "))
    return F.when(c.rlike(r"[\p{L}\p{N}]"), c)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def source_id(rel_path: Column) -> Column:
    return F.substring(F.sha1(rel_path), 1, 8)


def _under(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def group_key(rel_path: Column) -> Column:
    """The unit of splitting: folder, sanitised stem and source id."""
    return _under(parent(rel_path), F.concat(sanitize_file(rel_path), F.lit("_"), source_id(rel_path)))


def chunk_name(rel_path: Column, idx: Column, channel: Column | None = None) -> Column:
    ch = F.lit("") if channel is None else F.coalesce(F.concat(F.lit("__ch"), channel.cast("string")), F.lit(""))
    return F.concat(group_key(rel_path), ch, F.lit("__c"), F.format_string("%04d", idx))


def chunk_group(chunk: Column) -> Column:
    """The group key of a chunk name."""
    return _under(parent(chunk), F.split(F.substring_index(chunk, "/", -1), "__").getItem(0))


def seed_hash(seed: int, key: Column) -> Column:
    """sha1 of "seed:key" modulo 2**32."""
    return F.conv(F.right(F.sha1(F.concat(F.lit(f"{seed}:"), key)), F.lit(8)), 16, 10).cast("long")


def hash_decile_split(name: Column) -> Column:
    """Eight tenths train, one val, one test, by the name alone."""
    d = F.conv(F.substring(F.sha1(name), 1, 8), 16, 10).cast("long") % 10
    return F.when(d < 8, "train").when(d == 8, "val").otherwise("test")
