"""Normalised keys out of the spellings that lists and registries use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: file endings of structure and feature files
FILE_ENDINGS = "pdb|ent|cif|mmcif|bcif|pqr|pdbqt|xml|fasta|fa|txt|csv|tsv|h5|hdf5|parquet|pt|gz|bz2|xz|zst|zip"

BASE_NAME = r"^.*[/\\]"
ENDING = rf"(\.({FILE_ENDINGS}))+$"
PREFIX = r"^(?:(?:pdb|ent)[_-]?)?"
PLAIN_CODE = PREFIX + r"([a-z0-9]{8}|[a-z0-9]{4})(?:[^a-z0-9]|$)"
CLASSIFIED_CODE = PREFIX + r"[a-z]\.[0-9]+\.[0-9]+\.[0-9]+[_-]([a-z0-9]{8}|[a-z0-9]{4})[a-z0-9]?(?:[^a-z0-9]|$)"
PADDED_CODE = r"^0000([a-z0-9]{4})$"


def entry_code(name: Column) -> Column:
    """The entry that a protein id or key names, null where it names none.

    Case, padding, folders (either slash), file endings and marks before the
    code don't count, nor does a chain behind the code, parted from it by any
    sign that is no letter or digit. After a classification (``a.1.2.3_``) the
    chain letter follows the code directly. Eight characters of which the
    first four are ``0000`` name the entry of the last four.
    """
    text = F.lower(F.trim(F.regexp_replace(name, r"[\s\x00]+", " ")))
    text = F.regexp_replace(F.regexp_replace(text, BASE_NAME, ""), ENDING, "")
    code = F.coalesce(
        F.nullif(F.regexp_extract(text, CLASSIFIED_CODE, 1), F.lit("")),
        F.nullif(F.regexp_extract(text, PLAIN_CODE, 1), F.lit("")),
    )
    return F.coalesce(F.nullif(F.regexp_extract(code, PADDED_CODE, 1), F.lit("")), code)


def entry_code_sql(name: str) -> str:
    """The same in DuckDB's SQL."""
    text = rf"lower(trim(regexp_replace({name}, '[\s\x00]+', ' ', 'g')))"
    text = rf"regexp_replace(regexp_replace({text}, '{BASE_NAME}', ''), '{ENDING}', '')"
    code = f"coalesce(nullif(regexp_extract({text}, '{CLASSIFIED_CODE}', 1), ''), nullif(regexp_extract({text}, '{PLAIN_CODE}', 1), ''))"
    return f"coalesce(nullif(regexp_extract({code}, '{PADDED_CODE}', 1), ''), {code})"


def bare_name(name: Column) -> Column:
    """Letters and digits of a name, lower-case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def tidy(name: Column) -> Column:
    """A source name: lower-case, trimmed, runs of white space and ``_`` as one ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^[\s_]+|[\s_]+$", ""), r"[\s_]+", "_")
