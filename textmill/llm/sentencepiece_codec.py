"""SentencePiece encoding and decoding of documents of any length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT_CHARS = 1 << 20  # longer texts are split and encoded by several tasks
MAX_CACHED_UNITS = 200_000
SPACE = "▁"
#: A unit is a run of blanks with the run of other characters after it.
UNIT = re.compile(r" *[^ ]+| +")

#: Put before a part that begins inside a unit, so that the model's own blank stays apart from it.
GUARD = "\n"

PROBES = ("a  b", " a", "a ", "   ", "a\tb\n c \r\n", "ﬁ Å\u00a0x\u3000y", "a" + " " * 40 + "b")

_codecs: dict[bytes, Codec] = {}


class Codec:
    """One model in one process.

    Merges never cross a place between two characters that no piece holds side
    by side, nor one between a non-blank and a blank when no piece holds a
    blank after a non-blank; both are checked against the whole vocabulary.
    Seen as a scan over boundary states, every such place has a single state,
    so the transfer between units is the identity: units are encoded apart,
    remembered, and their pieces joined.  With other models whole texts go to
    the library.
    """

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cache: dict[str, list[int]] = {"": [self.processor.piece_to_id(SPACE)]}
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.separable = all(SPACE not in p.lstrip(SPACE) for p in pieces)
        # a model that rewrites its input is not separable
        self.separable = self.separable and all(self.encode(p) == self.processor.encode(p) for p in PROBES)
        self.guard = self.processor.encode(GUARD)
        self.guarded = not any(GUARD in pair for pair in self.pairs)

    def unit(self, key: str) -> list[int]:
        """Ids of a unit that begins with a blank, which the model adds by itself."""
        ids = self.cache.get(key)
        if ids is None:
            ids = self.processor.encode(key)
            if len(key) <= 32 and len(self.cache) < MAX_CACHED_UNITS:
                self.cache[key] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return self.encode_part(" " + text) if self.separable else self.processor.encode(text)

    def encode_part(self, part: str) -> list[int]:
        """Ids of a text with a blank before it, which the model adds by itself, or of a later part, cut at one of ``cuts``."""
        if not self.separable:
            return self.processor.encode(part[1:])
        out: list[int] = []
        for unit in UNIT.findall(part.replace(SPACE, " ")):
            out += self.unit(unit[1:]) if unit[0] == " " else self.processor.encode(GUARD + unit)[len(self.guard) :]
        return out

    def joins(self, before: str, after: str) -> bool:
        """Whether a piece can cross the place between two characters."""
        before, after = before.replace(" ", SPACE), after.replace(" ", SPACE)
        return before == SPACE if after == SPACE else not self.guarded or before + after in self.pairs

    def cuts(self, text: str, size: int) -> list[int]:
        """Places, at least ``size`` apart, where the text can be split without changing its ids."""
        found, at = [], size
        while self.separable and at < len(text):
            if self.joins(text[at - 1], text[at]):
                at += 1
            else:
                found.append(at)
                at += size
        return found


def codec(model: bytes) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def _encode(batches: Iterator[pa.RecordBatch], model, check: bool, parts: bool = False) -> Iterator[pa.RecordBatch]:
    """The last column is the text, or a part of one with the blank before it; the others are kept."""
    own = codec(model.value)
    encode = own.encode_part if parts else own.encode
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            texts = part.column(part.num_columns - 1).to_pylist()
            ids = [None if t is None else encode(t) for t in texts]
            columns = [*part.columns[:-1], pa.array(ids, pa.list_(pa.int32()))]
            names = [*part.schema.names[:-1], "ids"]
            if check:
                same = [None if i is None else own.processor.decode(i) == t[parts and t[:1] in (" ", SPACE) :].replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "round_trip"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _split(batches: Iterator[pa.RecordBatch], model, size: int) -> Iterator[pa.RecordBatch]:
    own = codec(model.value)
    for batch in batches:
        rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, text in zip(rows, texts, strict=True):
            places = [0, *own.cuts(text, size), len(text)]
            parts = [text[a:b] if a else " " + text[:b] for a, b in zip(places, places[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())],
                names=["row", "part", "text"],
            )


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str = MODEL,
    giant_chars: int = GIANT_CHARS,
    check: bool = False,
) -> DataFrame:
    """``doc_id, ids, n_tokens`` per row, and ``round_trip`` if ``check``: whether decoding gives the text back.

    The ids equal the library's for the whole text.  A null text has null ids
    and no count; an empty one has none.  The model reads U+2581 as a blank,
    so it decodes as one; everything else returns unchanged.  Texts over
    ``giant_chars`` are cut where no piece can cross, written to the shared
    folder, encoded by as many tasks as there are parts and joined in order.
    Repeated rows are encoded alike; extra columns are ignored.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", round_trip boolean" * check
    usual = base.where(F.coalesce(F.length("text"), F.lit(0)) <= giant_chars)
    out = usual.mapInArrow(lambda it: _encode(it, model, check), schema)
    giants = base.where(F.length("text") > giant_chars)
    if giants.limit(1).count():
        numbered = materialize(giants.withColumn("row", F.monotonically_increasing_id()), "giants")
        parts = materialize(numbered.select("row", "text").mapInArrow(lambda it: _split(it, model, giant_chars // 4), "row long, part int, text string"), "parts")
        done = parts.repartition("row", "part").mapInArrow(
            lambda it: _encode(it, model, check, parts=True), "row long, part int, ids array<int>" + ", round_trip boolean" * check
        )
        joined = [F.flatten(F.expr("transform(array_sort(collect_list(struct(part, ids))), x -> x.ids)")).alias("ids")]
        joined += [F.bool_and("round_trip").alias("round_trip")] * check
        whole = done.groupBy("row").agg(*joined)
        out = out.unionByName(numbered.select("row", "doc_id").join(whole, "row").select("doc_id", "ids", *["round_trip"] * check))
    return out.withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")))


def _decode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = codec(model.value)
    for batch in batches:
        texts = [None if ids is None else own.processor.decode(ids) for ids in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def decode_documents(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """``doc_id, text`` per row of ids; null ids give a null text, none an empty one."""
    with open(model_path, "rb") as f:
        model = tokens.sparkSession.sparkContext.broadcast(f.read())
    base = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(lambda it: _decode(it, model), f"doc_id {kind}, text string")
