"""Ingest: raw documents -> (doc_id, text); token parquet import; bundles
(SURVEY §2.1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_ws
from ..storage import materialize, table_exists

# Fixed values (ours): ASCII folding of Latin letters, then multi-letter
# replacements; anything else outside ASCII is dropped.
FOLD_FROM = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿ"
FOLD_TO = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyy"
FOLD_MULTI = [("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"),
              ("[‘’]", "'"), ("[“”]", '"'), ("[–—]", "-")]

TOKEN_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("token", T.StringType()),
    T.StructField("pos_tag", T.StringType()), T.StructField("ds_tag", T.StringType()),
    T.StructField("pos_id", T.LongType()), T.StructField("ds_id", T.LongType()),
])
BUNDLE_TABLES = ["ds_tokens", "ft_pos", "ft_ds", "tt_pos", "tt_ds", "dtm_pos", "dtm_ds"]


def fold_ascii(text: Column) -> Column:
    out = F.translate(text, FOLD_FROM, FOLD_TO)
    for pattern, repl in FOLD_MULTI:
        out = F.regexp_replace(out, pattern, repl)
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def doc_id_from_file(file_name: Column) -> Column:
    """File name without spaces and without its extension."""
    return F.regexp_replace(F.regexp_replace(file_name, " ", ""), r"\.[^.]*$", "")


def clean_documents(raw: DataFrame, fold: bool = False) -> DataFrame:
    """(file_name, text) -> (doc_id, text): id from the file name, text
    optionally folded to ASCII, then trimmed."""
    text = fold_ascii(F.col("text")) if fold else F.col("text")
    return raw.select(doc_id_from_file(F.col("file_name")).alias("doc_id"), strip_ws(text).alias("text"))


def decode_check(raw_bytes: DataFrame) -> DataFrame:
    """(doc_id, content BINARY) -> (doc_id, valid, text): UTF-8 validity per
    file; invalid files are reported, never silently repaired."""
    s = F.col("content").cast("string")
    return raw_bytes.select("doc_id", F.is_valid_utf8(s).alias("valid"),
                            F.when(F.is_valid_utf8(s), s).alias("text"))


def read_binary_documents(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))   # paths are URIs
    return raw.select(doc_id_from_file(name).alias("doc_id"), "content")


def check_token_schema(df: DataFrame) -> bool:
    """Ordered name-and-type equality with the six-column token schema."""
    got = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in TOKEN_SCHEMA.fields]
    return got == want


def load_token_parquet(spark: SparkSession, path: str, block: int = 1 << 16) -> DataFrame:
    """Read a pre-tagged token table and recover ``token_idx`` from the file
    order: rows of a document are ranked by (file path, row index).

    A document whose rows stand together is numbered by its first row's index,
    in file order and without a shuffle.  One that comes in several runs (cut by
    a split, or scattered) is ranked by a blocked ordinal: rows are numbered
    inside blocks of (document, file, row_index div block) and the counts of
    earlier blocks of the document are added from a small per-block table, so a
    document spread over many rows never lands in one task."""
    df = spark.read.parquet(path)
    if not check_token_schema(df):
        raise ValueError(f"not a token table: {df.schema.simpleString()}")
    d = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    d = d.withColumn("_s", F.arrow_udf(run_starts, "bigint")("doc_id", "_f", "_r"))
    names = ["doc_id", "token_idx", "token", "pos_tag", "ds_tag", "pos_id", "ds_id"]
    whole = d.withColumn("token_idx", F.col("_r") - F.col("_s"))
    cut = d.groupBy("doc_id", "_f", "_s").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").count().filter("count > 1")
    cut = materialize(cut.select("doc_id"), "cut-documents")
    if cut.isEmpty():
        return whole.select(*names)
    same = d["doc_id"].eqNullSafe(cut["doc_id"])
    return whole.join(cut, same, "left_anti").select(*names).unionByName(
        _ranked_by_block(d.join(cut, same, "left_semi"), block).select(*names))


def run_starts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(document, file, row index) in the order of the file -> the row index at
    which each row's run of rows of one document begins; a run may span batches."""
    last = None         # document, file, row index and start of the row before
    for doc, file, row in batches:
        r = row.to_numpy(zero_copy_only=False)
        if not len(r):
            yield pa.array([], pa.int64())
            continue
        new = np.ones(len(r), bool)
        code = [x.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for x in (doc, file)]
        new[1:] = (np.diff(code[0]) != 0) | (np.diff(code[1]) != 0) | (np.diff(r) != 1)
        start = r[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]
        if last is not None and (doc[0].as_py(), file[0].as_py(), r[0] - 1) == last[:3]:
            end = np.flatnonzero(new[1:])
            start[:end[0] + 1 if len(end) else len(r)] = last[3]
        last = doc[-1].as_py(), file[-1].as_py(), r[-1], start[-1]
        yield pa.array(start)


def _ranked_by_block(d: DataFrame, block: int) -> DataFrame:
    d = d.withColumn("_b", F.expr(f"_r div {int(block)}"))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy("doc_id", "_f", "_b").orderBy("_r")) - 1)
    totals = d.groupBy("doc_id", "_f", "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("doc_id").orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("doc_id", "_f", "_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_o"))
    return d.join(offsets, ["doc_id", "_f", "_b"]).withColumn("token_idx", (F.col("_o") + F.col("_in")).cast("long"))


def save_bundle(tables: dict[str, DataFrame], path: str, skip: tuple[str, ...] = ()) -> str:
    """Write all seven tables (``skip``: names already written there)."""
    missing = set(BUNDLE_TABLES) - set(tables)
    if missing:
        raise ValueError(f"bundle needs all of {BUNDLE_TABLES}; missing {sorted(missing)}")
    for name in BUNDLE_TABLES:
        if name not in skip:
            tables[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    return path


def load_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Accepted only when all seven tables are present."""
    present = {n for n in BUNDLE_TABLES if table_exists(spark, f"{path.rstrip('/')}/{n}")}
    if present != set(BUNDLE_TABLES):
        raise ValueError(f"incomplete bundle: missing {sorted(set(BUNDLE_TABLES) - present)}")
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in BUNDLE_TABLES}




def load_optional(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A further table of a bundle, if it is there."""
    table = f"{path.rstrip('/')}/{name}"
    return spark.read.parquet(table) if table_exists(spark, table) else None
