"""A corpus: document rows, a token table, or a stored bundle of both.

Built from documents, a corpus is one row per document with the arrays of its
tokens, tags and units (``operators.tagging.document_rows``); analyses that
concern one document at a time work inside the row.  A stored bundle holds the
same rows, so analyses that start from it read no text, tokenize and tag
nothing.  An imported token table, or a corpus with documents larger than a
row, goes through unit rows and blocked windows (``operators.sequence``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import PUNCT_TAG, simplify_tag
from ..operators import colloc, docrows, docview, ingest, keyness, kwic, meta, ngrams, sequence
from ..operators import freq as fq
from ..operators.tagging import (Tagger, document_rows, ds_units_from_documents, rule_tagger, tokens_from_rows,
                                 tokens_from_units, with_ds_units)
from ..operators.units import analytic_units, is_punct_unit, units
from ..storage import materialize

DOC_ROWS = "doc_rows"       # the table that a bundle has besides the seven of SURVEY §2.1
ROW_GROUP = 1 << 25         # bytes of a row group of document rows
BATCH_SIZE = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside read Parquet 256 rows at a time; what the session sets itself stays."""
    own = spark.conf.get(BATCH_SIZE) == "4096"
    if own:
        spark.conf.set(BATCH_SIZE, "256")
    try:
        yield
    finally:
        if own:
            spark.conf.unset(BATCH_SIZE)


def clustered(tokens: DataFrame) -> DataFrame:
    """A token table with each document's rows in one partition, in order."""
    return tokens.repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "token_idx")


@dataclass
class Corpus:
    tokens: DataFrame
    single_token_pos: bool = False
    pos_tokens: DataFrame | None = None   # same rows without the DS columns, cheaper to build
    docs: DataFrame | None = None         # (doc_id, text) when built from documents
    rows: DataFrame | None = None         # document (segment) rows with units
    whole_rows: bool = False              # every document is one row
    tables: dict[str, DataFrame] = field(default_factory=dict)   # stored tables of the whole corpus
    texts: docrows.text_counting.Texts | None = None             # whole documents that the default taggers tag
    counted: DataFrame | None = None                             # what these texts count, stored (text_counting.tabulated)

    @classmethod
    def from_documents(cls, docs: DataFrame, pos_lexicon: dict | None = None, ds_lexicon: dict | None = None,
                       partitions: int | None = None, tagger: Tagger | None = None) -> "Corpus":
        """From (doc_id, text), one row per document, or from segment rows
        (``sources.documents.with_segment_offsets``).  ``partitions``: deal the
        documents to so many tasks by id before they are tagged, for a table
        whose files have fewer splits than the cluster has cores."""
        if partitions:
            docs = docs.repartition(partitions, "doc_id")
        rows = document_rows(docs, tagger or rule_tagger(pos_lexicon))
        whole = tagger is None and "_ahead" not in docs.columns
        texts = docrows.text_counting.Texts(docs, "pos", pos_lexicon, ds_lexicon) if whole else None
        return replace(cls.from_rows(with_ds_units(rows, ds_lexicon)), docs=docs, texts=texts)

    @classmethod
    def from_rows(cls, rows: DataFrame) -> "Corpus":
        return cls(tokens_from_units(rows), True, tokens_from_rows(rows), rows=rows, whole_rows="_seg" not in rows.columns)

    @classmethod
    def from_bundle(cls, spark: SparkSession, path: str) -> "Corpus":
        """A stored corpus.  The whole corpus's tables are read as stored;
        other analyses start from the stored document rows, or, where the
        bundle was made from a token table, from that."""
        tables = ingest.load_bundle(spark, path)
        rows = ingest.load_optional(spark, path, DOC_ROWS)
        if rows is None:
            return cls(tables["ds_tokens"], False, tables=tables)
        return replace(cls.from_rows(rows), tokens=tables["ds_tokens"], tables=tables)

    def subset(self, condition: Column) -> "Corpus":
        """The documents whose id meets the condition."""
        part = lambda df: None if df is None else df.filter(condition)
        return replace(self, tokens=part(self.tokens), pos_tokens=part(self.pos_tokens), docs=part(self.docs),
                       rows=part(self.rows), tables={}, counted=None, texts=self.texts and replace(self.texts, docs=part(self.texts.docs)))

    # --- units and counting rows ---------------------------------------------

    def _for(self, kind: str) -> DataFrame:
        return self.pos_tokens if (kind == "pos" and self.pos_tokens is not None) else self.tokens

    def units(self, kind: str = "pos") -> DataFrame:
        if kind == "ds" and self.rows is not None:
            return ds_units_from_documents(self.rows)      # no grouping shuffle
        return units(self._for(kind), kind, single_token=(kind == "pos" and self.single_token_pos))

    def analytic(self, kind: str = "pos") -> DataFrame:
        if kind == "ds":
            return self.units("ds")
        return analytic_units(self._for(kind), kind, single_token=(kind == "pos" and self.single_token_pos))

    def counts(self, kind: str = "pos", tags_only: bool = False) -> DataFrame:
        """Counting rows (see ``operators.freq``) by Token and Tag, or by Tag."""
        if self.counted is not None:
            return docrows.text_counting.counts_in(self.counted, kind, tags_only)
        if self.texts:
            return docrows.text_counting.counted(self._texts(kind), tags_only)
        if self.whole_rows:
            return (docrows.counted_tags if tags_only else docrows.counted_units)(self.rows, kind)
        keys = ["Tag"] if tags_only else ["Token", "Tag"]
        return fq.unit_counts(self.analytic(kind), keys).unionByName(fq.document_marks(self._for("pos"), keys))

    def ndocs(self) -> Column:
        """Documents with at least one token, as a scalar subquery."""
        if self.whole_rows:
            return self.rows.filter("n > 0").select(F.count(F.lit(1))).scalar()
        return fq.n_docs(self._for("pos"))

    def analytic_count(self, kind: str = "pos") -> Column:
        """Number of units that count (N of the frequency tables), as a scalar subquery."""
        if self.whole_rows:
            n = F.size("units") if kind == "ds" else F.size(F.filter("tags", lambda t: t != PUNCT_TAG))
            return self.rows.select(F.coalesce(F.sum(n), F.lit(0)).cast("long")).scalar()
        return self.analytic(kind).select(F.count(F.lit(1))).scalar()

    def _texts(self, kind: str) -> docrows.text_counting.Texts:
        return replace(self.texts, kind=kind)

    def words(self, kind: str = "pos") -> DataFrame | docrows.text_counting.Texts:
        """Word sequences (see ``operators.docrows``), or the texts that have them."""
        if self.texts:
            return self._texts(kind)
        if self.whole_rows:
            return docrows.words(self.rows, kind)
        ordered = ngrams.ordered_units(self.units(kind), dense=(kind == "pos" and self.single_token_pos))
        return docrows.words_of_units(ordered, kind, sequence.BLOCK)

    def unit_kinds(self) -> DataFrame:
        """(kind, Tag, punct, n): units by kind, tag and whether they are punctuation; documents as kind ``doc``."""
        if self.whole_rows:
            pos = F.transform("tags", lambda t: F.struct(F.lit("pos").alias("kind"), t.alias("Tag"), (t == PUNCT_TAG).alias("punct")))
            ds = F.transform("units", lambda u: F.struct(F.lit("ds").alias("kind"), u["tag"].alias("Tag"),
                                                         u["punct"].alias("punct")))
            doc = F.array(F.struct(F.lit("doc").alias("kind"), F.lit(None).cast("string").alias("Tag"), F.lit(False).alias("punct")))
            some = F.when(F.col("n") > 0, F.concat(doc, pos, ds))
            found = self.rows.select(F.explode_outer(some).alias("x")).filter("x IS NOT NULL").select("x.*")
        else:
            of = lambda kind: self.units(kind).select(F.lit(kind).alias("kind"), "Tag", is_punct_unit(kind).alias("punct"))
            docs = self._for("pos").select("doc_id").distinct().select(
                F.lit("doc").alias("kind"), F.lit(None).cast("string").alias("Tag"), F.lit(False).alias("punct"))
            found = of("pos").unionByName(of("ds")).unionByName(docs)
        return found.groupBy("kind", "Tag", "punct").agg(F.count(F.lit(1)).alias("n"))

    # --- analyses ------------------------------------------------------------

    def _stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.tables[name] if name in self.tables else make()

    def summary(self) -> DataFrame:
        return meta.corpus_summary(self.unit_kinds())

    def frequency(self, kind: str = "pos") -> DataFrame:
        return self._stored(f"ft_{kind}", lambda: fq.frequency_table(self.counts(kind)))

    def tags(self, kind: str = "pos") -> DataFrame:
        return self._stored(f"tt_{kind}", lambda: fq.tags_table(self.counts(kind, tags_only=True)))

    def dtm(self, kind: str = "pos") -> DataFrame:
        if self.counted is not None:
            return self._stored(f"dtm_{kind}", lambda: docrows.text_counting.matrix_in(self.counted, kind))
        if self.whole_rows:
            return self._stored(f"dtm_{kind}", lambda: docrows.tag_matrix(self.rows, kind))
        return self._stored(f"dtm_{kind}", lambda: fq.dtm_long(self.analytic(kind)))

    def simplified_frequency(self) -> DataFrame:
        """Frequencies by simplified tag, the document counts made anew."""
        if self.whole_rows:
            simple = F.transform("tags", lambda t: F.when(t != PUNCT_TAG, simplify_tag(t)))     # (null does not count)
            return fq.frequency_table(docrows.counted(self.rows, {"Token": F.col("low"), "Tag": simple}, PUNCT_TAG))
        u = self.analytic("pos").withColumn("Tag", simplify_tag("Tag"))
        return fq.frequency_table(fq.unit_counts(u).unionByName(fq.document_marks(self._for("pos"))))

    def keyness(self, reference: "Corpus", kind: str = "pos", tags_only: bool = False, **how) -> DataFrame:
        return keyness.keyness(self.counts(kind, tags_only), reference.counts(kind, tags_only), tags_only, **how)

    def _totals(self, kind: str) -> dict[str, Column]:
        """Word sequences of whole documents carry their totals."""
        return {} if self.whole_rows else {"n_units": self.analytic_count(kind), "ndocs": self.ndocs()}

    def ngrams(self, kind: str = "pos", span: int = 2, min_rf: float | None = 10.0) -> DataFrame:
        return ngrams.ngrams(self.words(kind), span, min_rf, **self._totals(kind))

    def clusters_by_token(self, node_word: str, node_position: int = 1, span: int = 2, mode: str = "fixed",
                          kind: str = "pos") -> DataFrame:
        return ngrams.clusters_by_token(self.words(kind), node_word, node_position, span, mode, **self._totals(kind))

    def clusters_by_tag(self, tag: str, tag_position: int = 1, span: int = 2, kind: str = "pos") -> DataFrame:
        return ngrams.clusters_by_tag(self.words(kind), tag, tag_position, span, **self._totals(kind))

    def collocates(self, node_word: str, node_tag: str | None = None, preceding: int = 4, following: int = 4,
                   statistic: str = "npmi", kind: str = "pos") -> DataFrame:
        return colloc.coll_table(self.words(kind), node_word, node_tag, preceding, following, statistic)

    def kwic(self, node_word: str, search_type: str = "fixed", ignore_case: bool = True, reach: int = 10) -> DataFrame:
        """Inside document rows where they are whole; else bounded frames over
        (document, block), which cross the edges of segments."""
        if self.whole_rows:
            return kwic.kwic_in_documents(self.rows, node_word, search_type, ignore_case, reach)
        return kwic.kwic(self._for("pos"), node_word, search_type, ignore_case, reach)

    # --- views ---------------------------------------------------------------

    def spans(self, view: str = "pos") -> DataFrame:
        if self.whole_rows:
            return docview.doc_spans_in_rows(self.rows, view)
        return docview.doc_spans(self.units("ds" if view == "ds" else "pos"), view)

    def html(self, view: str = "ds") -> DataFrame:
        return docview.doc_html_in_rows(self.rows, view) if self.whole_rows else docview.doc_html(self.spans(view))

    def tag_positions(self, tags, view: str = "ds") -> DataFrame:
        if self.whole_rows:
            return docview.doc_tag_positions_in_rows(self.rows, tags, view)
        return docview.doc_tag_positions(self.units(view), tags, dense=(view == "pos" and self.single_token_pos))

    def tagged_text(self, kind: str = "pos") -> DataFrame:
        return docview.tagged_text_in_rows(self.rows, kind) if self.whole_rows else docview.tagged_text(self.units(kind), kind)

    # --- storage -------------------------------------------------------------

    def clustered_tokens(self) -> DataFrame:
        """The token table, each document's rows together and in order.  A row
        holds its whole document, so only documents whose id comes more than
        once are brought together by a shuffle."""
        if not self.whole_rows or self.rows is None:
            return clustered(self.tokens)
        again = materialize(self.rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
        if again.isEmpty():
            return self.tokens
        same = self.rows["doc_id"].eqNullSafe(again["doc_id"])
        return tokens_from_units(self.rows.join(again, same, "left_anti")).unionByName(
            clustered(tokens_from_units(self.rows.join(again, same, "left_semi"))))

    def save_bundle(self, path: str) -> str:
        """Write the corpus.  Document rows are written first and the tokens
        are computed from the written copy (the lineage is cut there); the tokens of a row are in order,
        so the token table needs no shuffle.  The other tables come from the counts of
        one more reading of the texts, where the default taggers tag them, else
        from the written copy.  A corpus from a token table is
        clustered by document and ordered first.  Arrays are written in small
        row groups and read a few rows at a time, as a row holds its whole document."""
        base, spark = path.rstrip("/"), self.tokens.sparkSession
        if self.rows is not None:
            rows = docrows.text_counting.document_rows(self.texts) if self.texts else self.rows
            rows.write.option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(f"{base}/{DOC_ROWS}")
            saved = Corpus.from_rows(spark.read.parquet(f"{base}/{DOC_ROWS}"))
            with few_rows(spark):
                saved.tokens.write.mode("overwrite").parquet(f"{base}/ds_tokens")
            if self.texts:
                saved = replace(saved, counted=materialize(docrows.text_counting.tabulated(self.texts), "bundle-counts"))
        else:
            (clustered(self.tokens).write.mode("overwrite").parquet(f"{base}/ds_tokens"))
            saved = Corpus(spark.read.parquet(f"{base}/ds_tokens"), self.single_token_pos)
        derived = {f"{t}_{k}": make(k) for k in ("pos", "ds")
                   for t, make in (("ft", saved.frequency), ("tt", saved.tags), ("dtm", saved.dtm))}
        return ingest.save_bundle({"ds_tokens": saved.tokens, **derived}, base, skip=("ds_tokens",))
