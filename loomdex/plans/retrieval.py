"""Search over a corpus of chunks: vector, full-text and hybrid modes.

``queries`` is a batch (query_id, query_text, query_vec); one row is one search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators.block_max import block_leg
from loomdex.operators.fulltext import fulltext_leg, stored_leg, vocabulary
from loomdex.operators.fusion import attach_cosine, fuse_legs, fused_top_k
from loomdex.operators.nearest import vector_leg
from loomdex.operators.query_batch import QueryBlock, per_block
from loomdex.operators.vector_cells import VectorCells, cell_leg
from loomdex.settings import DEFAULTS, Settings, threshold_or_default, top_k_or_default

DocIds = DataFrame | list | None


@dataclass(frozen=True)
class Corpus:
    """What a search reads.

    ``chunks``     chunk_id, doc_id, text [, ordinal, metadata STRUCT<...>]
    ``vectors``    chunk_id, doc_id, embedding; a chunk without a row is pending
    ``documents``  doc_id, filename, status
    ``index``      optional stored postings: lexeme, chunk_id, doc_id, tf
    ``blocks``     optional block-maximum postings (``block_max``), read before ``index``
    ``cells``      optional cell index of the vectors (``vector_cells``)
    ``vocabulary`` optional stored (word, lexeme) of the chunks (``fulltext.vocabulary``);
                   without it the stemming analyzer derives it for each batch

    Texts, vectors and postings are separate tables because each leg reads only
    its own. Rows whose document is not in ``documents`` are not searchable. Stored
    tables that carry ``status`` beside doc_id are filtered without a join.
    """

    chunks: DataFrame
    vectors: DataFrame
    documents: DataFrame
    index: DataFrame | None = None
    analyzer: str = "russian"
    blocks: DataFrame | None = None
    cells: VectorCells | None = None
    vocabulary: DataFrame | None = None

    @classmethod
    def from_chunk_table(cls, chunks: DataFrame, documents: DataFrame, **rest) -> Corpus:
        """Corpus over one chunk table with a nullable ``embedding`` column."""
        vectors = chunks.select("chunk_id", "doc_id", "embedding").filter("embedding IS NOT NULL")
        return cls(chunks.drop("embedding"), vectors, documents, **rest)


def searchable(table: DataFrame, corpus: Corpus, doc_ids: DocIds) -> DataFrame:
    """Rows whose document exists and is indexed; rows without a document (deleted,
    not yet committed) are never found. A table that carries ``status`` (stored
    corpora) is filtered in place; else the ids of the indexed documents are joined."""
    if "status" in table.columns:
        table = table.filter(F.col("status") == "indexed")
    else:
        indexed = corpus.documents.filter(F.col("status") == "indexed").select("doc_id")
        table = table.join(indexed, "doc_id", "left_semi")
    if isinstance(doc_ids, DataFrame):
        return table.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return table.filter(F.col("doc_id").isin(list(doc_ids))) if doc_ids else table


def _vector_leg(block: QueryBlock, corpus: Corpus, k: int, doc_ids: DocIds) -> DataFrame:
    if corpus.cells is not None:
        return cell_leg(block, corpus.cells, lambda rows: searchable(rows, corpus, doc_ids), k)[0]
    return vector_leg(block, searchable(corpus.vectors, corpus, doc_ids), k)


def _fts_leg(block: QueryBlock, corpus: Corpus, k: int, doc_ids: DocIds) -> DataFrame:
    if corpus.blocks is not None:
        return block_leg(block, corpus.blocks, lambda rows: searchable(rows, corpus, doc_ids), k, corpus.analyzer)[0]
    if corpus.index is not None:
        return stored_leg(block, searchable(corpus.index, corpus, doc_ids), k, corpus.analyzer)
    known = corpus.vocabulary
    if known is None and corpus.analyzer != "simple":
        known = vocabulary(corpus.chunks, corpus.analyzer)
    return fulltext_leg(block, searchable(corpus.chunks, corpus, doc_ids), k, corpus.analyzer, known)


def index_use(queries: DataFrame, corpus: Corpus, *, top_k: int | None = None, doc_ids: DocIds = None, settings: Settings = DEFAULTS) -> DataFrame:
    """``(query_id, cells_read, cells, blocks_read, blocks)``: what a search of each leg
    opens of the corpus's indexes; NULL for an index that the corpus does not have."""
    k = top_k_or_default(top_k, settings)

    def run(block: QueryBlock) -> DataFrame:
        used = block.frame.select("query_id")
        live = lambda rows: searchable(rows, corpus, doc_ids)
        cells = cell_leg(block, corpus.cells, live, k)[1] if corpus.cells is not None else None
        blocks = block_leg(block, corpus.blocks, live, k, corpus.analyzer)[1] if corpus.blocks is not None else None
        for name, visited in (("cells", cells), ("blocks", blocks)):
            if visited is None:
                used = used.withColumns({f"{name}_read": F.lit(None).cast("long"), name: F.lit(None).cast("long")})
            else:
                used = used.join(visited, "query_id", "left").fillna(0, [f"{name}_read", name])
        return used

    return per_block(queries, run)


def search_vector(
    queries: DataFrame,
    corpus: Corpus,
    *,
    top_k: int | None = None,
    threshold: float | None = None,
    doc_ids: DocIds = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``: cosine at or above the threshold."""
    k = top_k_or_default(top_k, settings)
    cut = threshold_or_default(threshold, settings)
    leg = per_block(queries, lambda block: _vector_leg(block, corpus, k, doc_ids))
    return leg.filter(F.col("cosine") >= cut).select(
        "query_id", "rank", "chunk_id", F.col("cosine").alias("score")
    )


def search_fts(
    queries: DataFrame,
    corpus: Corpus,
    *,
    top_k: int | None = None,
    doc_ids: DocIds = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``: any word of the query may match."""
    k = top_k_or_default(top_k, settings)
    leg = per_block(queries, lambda block: _fts_leg(block, corpus, k, doc_ids))
    return leg.select("query_id", "rank", "chunk_id", "score")


def _block_legs(block: QueryBlock, corpus: Corpus, depth: int, doc_ids: DocIds) -> DataFrame:
    return fuse_legs(
        _vector_leg(block, corpus, depth, doc_ids), _fts_leg(block, corpus, depth, doc_ids)
    )


def hybrid_legs(
    queries: DataFrame,
    corpus: Corpus,
    *,
    top_k: int | None = None,
    doc_ids: DocIds = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Both legs, each cut to twice the result size, joined per query and chunk."""
    depth = top_k_or_default(top_k, settings) * settings.leg_factor
    return per_block(queries, lambda block: _block_legs(block, corpus, depth, doc_ids))


def search_hybrid(
    queries: DataFrame,
    corpus: Corpus,
    *,
    top_k: int | None = None,
    threshold: float | None = None,
    doc_ids: DocIds = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``(query_id, rank, chunk_id, rrf_score, score)``; score is the cosine or NULL."""
    k = top_k_or_default(top_k, settings)
    cut = threshold_or_default(threshold, settings)

    def run(block: QueryBlock) -> DataFrame:
        legs = _block_legs(block, corpus, k * settings.leg_factor, doc_ids)
        top = fused_top_k(legs, k, F.lit(cut))
        return attach_cosine(top, block, corpus.vectors)

    return per_block(queries, run).select(
        "query_id", "rank", "chunk_id", "rrf_score", F.col("vec_score").alias("score")
    )


SEARCHERS = {"vector": search_vector, "fts": search_fts, "hybrid": search_hybrid}


def search(
    queries: DataFrame,
    corpus: Corpus,
    *,
    mode: str = "hybrid",
    brand: str | None = None,
    top_k: int | None = None,
    settings: Settings = DEFAULTS,
    **options,
) -> DataFrame:
    """One entry point for the three modes, with the chunk payload attached.

    ``brand`` filters the finished top-k, so it may leave fewer than k rows.
    """
    if mode not in SEARCHERS:
        raise ValueError(f"unknown search mode: {mode}")
    hits = SEARCHERS[mode](queries, corpus, top_k=top_k, settings=settings, **options)
    found = with_payload(hits, corpus)
    if brand:
        found = found.filter(F.col("metadata.brand") == brand)
    return found


def with_payload(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """Text, metadata and file name of the final few rows per query."""
    payload = [c for c in ("chunk_id", "doc_id", "text", "metadata") if c in corpus.chunks.columns]
    found = corpus.chunks.select(*payload).join(hits, "chunk_id")
    return found.join(corpus.documents.select("doc_id", "filename"), "doc_id")


def chunks_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of an id list; unknown ids find nothing."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def chunks_of_documents(corpus: Corpus, doc_ids: DataFrame | list) -> DataFrame:
    """Every chunk of the given documents, whatever their status, no threshold.

    An empty list finds nothing here (unlike the search filter).
    """
    if isinstance(doc_ids, DataFrame):
        ids = doc_ids.select("doc_id").distinct()
        wanted = corpus.documents.join(ids, "doc_id", "left_semi")
    else:
        wanted = corpus.documents.filter(F.col("doc_id").isin(list(doc_ids)))
    return corpus.chunks.join(wanted.select("doc_id", "filename"), "doc_id")
