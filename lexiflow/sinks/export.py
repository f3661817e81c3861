"""Sinks: token table and corpus tables as Parquet / CSV, tagged text files.

Writes are distributed (one file per task, no driver-side zip).  The token
table is clustered by document and ordered by position inside each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.corpus import Corpus, clustered


def export_tokens(corpus: DataFrame | Corpus, path: str, mode: str = "overwrite") -> str:
    """``corpus``: a token table, or a corpus, whose tokens need no shuffle where a document is one row."""
    tokens = corpus.clustered_tokens() if isinstance(corpus, Corpus) else clustered(corpus)
    tokens.write.mode(mode).parquet(path)
    return path


def export_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    out = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        w = df.write.mode(mode)
        if fmt == "csv":
            w.option("header", True).csv(target)
        elif fmt == "parquet":
            w.parquet(target)
        else:
            raise ValueError("fmt must be 'parquet' or 'csv'")
        out[name] = target
    return out


def write_tagged_text(tagged: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One line per document (``file_name<TAB>text``) in text part-files."""
    tagged.select(F.concat_ws("\t", "file_name", "text")).write.mode(mode).text(path)
    return path
