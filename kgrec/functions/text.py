"""String column builders: title cleaning (B6), completion parsing (B10), entity ids from paths (B16),
run-name build/parse (B19).  All native Catalyst expressions (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgrec.functions.keymaps import FAVOURITE_PREFIX

BRACKETS = r"[\(\[].*?[\)\]]"   # bracketed spans, non-greedy, as the cleaner removes them
EDGE_SPACE = r"(?U)^\s+|\s+$"   # white space of any script (Spark's trim only strips spaces)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def drop_brackets(c: Column) -> Column:
    return F.regexp_replace(c, BRACKETS, "")


def clean_title(name: Column, variant: str) -> Column:
    """Four cleaning variants of a catalogue name.

    book_item  : part before ';', brackets removed, stripped (underscores kept)
    book_user  : part before ';', '_' -> ' ', brackets removed, stripped
    movie_item : last '/' segment, '_' -> ' ', brackets removed, stripped
    movie_user : whole name, '_' -> ' ', brackets removed, stripped
    """
    if variant == "book_item":
        return strip(drop_brackets(F.split(name, ";").getItem(0)))
    if variant == "book_user":
        return strip(drop_brackets(F.replace(F.split(name, ";").getItem(0), F.lit("_"), F.lit(" "))))
    if variant == "movie_item":
        return strip(drop_brackets(F.replace(F.element_at(F.split(name, "/"), -1), F.lit("_"), F.lit(" "))))
    if variant == "movie_user":
        return strip(drop_brackets(F.replace(name, F.lit("_"), F.lit(" "))))
    raise ValueError(f"unknown title variant {variant!r}")


def completion_lines(plain: Column) -> Column:
    """Angle brackets removed, split on every '.' (empty pieces kept)."""
    return F.split(F.translate(plain, "<>", ""), r"\.", -1)


def line_parts(line: Column) -> Column:
    return F.split(strip(line), ": ", -1)


def line_feature(line: Column) -> Column:
    """Feature name: 'Favourite ' removed anywhere, stripped, text before the first ': ', lower-case."""
    return F.lower(F.split(strip(F.replace(line, F.lit(FAVOURITE_PREFIX), F.lit(""))), ": ", -1).getItem(0))


def line_values(line: Column) -> Column:
    """Values: only the text between the first and second ': ', lower-case, split on ', ' (no trim)."""
    return F.split(F.lower(line_parts(line).getItem(1)), ", ", -1)


def entity_from_path(path: Column) -> Column:
    """``.../item<ID>.json`` -> ``<ID>``; ``.../user<ID>_anything.json`` or ``user<ID>.json`` -> ``user<ID>``."""
    fname = F.element_at(F.split(path, "/"), -1)
    return F.when(fname.startswith("item"), F.regexp_extract(fname, r"^item(\d+)\.json$", 1)) \
            .otherwise(F.regexp_extract(fname, r"^(user\d+)(?:_[^.]*)?\.json$", 1))


RUN_NAME_PATTERN = r"^drop([0-9.]+)_uni_([A-Za-z0-9]+)_([A-Za-z0-9-]+)_s=(\d+)_CompGCN_k=(\d+)_l=(\d+)$"


def run_name(dropout: Column, klass: Column, dataset: Column, setting: Column, dim: Column,
             layers: Column) -> Column:
    """``drop{p}_uni_{class}_{ds}_s={s}_CompGCN_k={dim}_l={l}``."""
    return F.concat(F.lit("drop"), dropout.cast("string"), F.lit("_uni_"), klass, F.lit("_"), dataset,
                    F.lit("_s="), setting.cast("string"), F.lit("_CompGCN_k="), dim.cast("string"),
                    F.lit("_l="), layers.cast("string"))


def parse_run_name(name: Column) -> list[Column]:
    fields = [("dropout", "double"), ("model_class", "string"), ("dataset", "string"),
              ("setting", "bigint"), ("dim", "bigint"), ("layers", "bigint")]
    return [F.regexp_extract(name, RUN_NAME_PATTERN, i + 1).cast(t).alias(n) for i, (n, t) in enumerate(fields)]
