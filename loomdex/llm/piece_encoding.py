"""SentencePiece encoding and decoding over a table of distinct marked words.

A text is marked (a marker before it, spaces become markers) and cut before every
run of markers. Where no piece of the model has a marker after another character,
no merge crosses such a cut, so a chunk's ids depend on the chunk alone: the
library segments each distinct chunk once, and the ids are joined back by the
chunks' positions. The table of distinct chunks belongs to a task and is emptied at
``TABLE_CHUNKS``; a table for the whole corpus would need every position of every
word in a shuffle.

The model must be one to which this applies (checked when it is loaded): no
normalisation but marking, with a marker before the text, and no piece across a
marker. Its file is read by the driver and sent with the tasks.

Cases: null and empty texts have no ids and decode to the empty text. Ids, nulls and
repeated rows pass through: one row for every row. An empty table gives an empty
result. ``keep`` names the columns that are returned beside ids and decoded.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import free_names, pieces

MARK = "▁"
TABLE_CHUNKS = 60_000


def load(model: bytes):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = " a  bÅﬁ\t"
    if processor.normalize(plain) != MARK + plain.replace(" ", MARK):
        raise ValueError("the model normalises texts, so words cannot be segmented one by one")
    if any(MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size())):
        raise ValueError("a piece of the model crosses a whitespace marker")
    return processor


class ChunkTable:
    """Ids of distinct chunks, each named by what follows its first marker."""

    def __init__(self, processor, limit: int = TABLE_CHUNKS) -> None:
        self.processor, self.limit = processor, limit
        self.single = array("i", [processor.piece_to_id(MARK)])
        self.ids: dict[str, array] = {}
        self.inner = re.compile(f"{MARK}({MARK}*[^{MARK}]+|{MARK}*$)")

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        parts = marked.split(MARK)
        return self.inner.findall(MARK + marked) if "" in parts else parts

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.ids) > self.limit:
            self.ids.clear()
        new = list({c for chunks in texts for c in chunks} - self.ids.keys())
        # The library marks the text's start by itself; a lone marker has no text.
        self.ids.update(zip(new, (array("i", x) for x in self.processor.encode(new, num_threads=1)), strict=True))
        if "" in self.ids:
            self.ids[""] = self.single


def encoder(model: bytes, text: str, decode: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        table = ChunkTable(processor)
        for batch in pieces(batches, text):
            cut = [table.chunks(x) for x in pc.fill_null(batch.column(text), "").to_pylist()]
            table.learn(cut)
            flat, ends, decoded = array("i"), [0], []
            for chunks in cut:
                for ids in map(table.ids.__getitem__, chunks):
                    flat.extend(ids)
                if decode:
                    decoded.append(processor.decode(flat[ends[-1] :].tolist()))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            columns = [batch.column(c) for c in batch.schema.names if c != text] + [ids]
            names = [c for c in batch.schema.names if c != text] + ["ids"]
            if decode:
                columns, names = [*columns, pa.array(decoded, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_pieces(documents: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """The ``keep`` columns, ids array<int> and, on demand, decoded string."""
    with open(model_path, "rb") as file:
        model = file.read()
    load(model)
    (text,) = free_names(documents.select(*keep), "text")
    source = documents.select(*keep, F.col(text_col).alias(text))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decode:
        schema = schema.add("decoded", T.StringType())
    return source.mapInArrow(encoder(model, text, decode), schema)
