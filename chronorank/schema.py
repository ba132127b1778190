"""Record types of the stream corpus.

Every field carries its wire number as metadata, so the same definition drives
the chunk decoder and the DataFrame schema.  All columns are nullable.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

FIELD_ID = "id"
DEFAULT = "default"


def _record(**fields: tuple) -> StructType:
    """Record type from ``name=(wire number, type[, value if absent])``."""
    out = []
    for name, (number, kind, *default) in fields.items():
        metadata = {FIELD_ID: number, **({DEFAULT: default[0]} if default else {})}
        out.append(StructField(name, kind, True, metadata))
    return StructType(out)


_S, _B, _I16, _I32, _I64 = StringType(), BinaryType(), ShortType(), IntegerType(), LongType()

STREAM_TIME = _record(epoch_ticks=(1, DoubleType()), zulu_timestamp=(2, _S))
LANGUAGE = _record(code=(1, _S), name=(2, _S))
ANNOTATOR = _record(annotator_id=(1, _S), annotation_time=(2, STREAM_TIME))
TARGET = _record(target_id=(1, _S), kb_id=(2, _S), kb_snapshot_time=(3, STREAM_TIME))
OFFSET = _record(
    type=(1, _I32), first=(2, _I64), length=(3, _I32), xpath=(4, _S), content_form=(5, _S, "clean_visible"), value=(6, _B)
)
LABEL = _record(annotator=(1, ANNOTATOR), target=(2, TARGET), offsets=(3, MapType(_I32, OFFSET)))
RATING = _record(
    annotator=(1, ANNOTATOR),
    target=(2, TARGET),
    relevance=(3, _I16),
    contains_mention=(4, BooleanType()),
    comments=(5, _S),
    mentions=(6, ArrayType(_S)),
)
RELATION = _record(
    relation_name=(1, _S),
    sentence_id_1=(2, _I32),
    mention_id_1=(3, _I16),
    sentence_id_2=(4, _I32),
    mention_id_2=(5, _I16),
)
TAGGING = _record(
    tagger_id=(1, _S),
    raw_tagging=(2, _B),
    tagger_config=(3, _S),
    tagger_version=(4, _S),
    generation_time=(5, STREAM_TIME),
)
TOKEN = _record(
    token_num=(1, _I32),
    token=(2, _S),
    offsets=(3, MapType(_I32, OFFSET)),
    sentence_pos=(4, _I32, -1),
    lemma=(5, _S),
    pos=(6, _S),
    entity_type=(7, _I32),
    mention_id=(8, _I16, -1),
    equiv_id=(9, _I32, -1),
    parent_id=(10, _I32, -1),
    dependency_path=(11, _S),
    labels=(12, MapType(_S, ArrayType(LABEL))),
)
SENTENCE = _record(tokens=(1, ArrayType(TOKEN)), labels=(2, MapType(_S, ArrayType(LABEL))))
CONTENT_ITEM = _record(
    raw=(1, _B),
    encoding=(2, _S),
    media_type=(3, _S),
    clean_html=(4, _S),
    clean_visible=(5, _S),
    logs=(6, ArrayType(_S)),
    taggings=(7, MapType(_S, TAGGING)),
    labels=(8, MapType(_S, ArrayType(LABEL))),
    sentences=(9, MapType(_S, ArrayType(SENTENCE))),
    sentence_blobs=(10, MapType(_S, _B)),
    language=(11, LANGUAGE),
    relations=(12, MapType(_S, ArrayType(RELATION))),
)
STREAM_ITEM = _record(
    version=(1, _I32),
    doc_id=(2, _S),
    abs_url=(3, _B),
    schost=(4, _S),
    original_url=(5, _B),
    source=(6, _S),
    body=(7, CONTENT_ITEM),
    source_metadata=(8, MapType(_S, _B)),
    stream_id=(9, _S),
    stream_time=(10, STREAM_TIME),
    other_content=(11, MapType(_S, CONTENT_ITEM)),
    ratings=(12, MapType(_S, ArrayType(RATING))),
)

# Entity and offset type codes.
ENTITY_TYPES = {
    0: "PER",
    1: "ORG",
    2: "LOC",
    3: "MALE_PRONOUN",
    4: "FEMALE_PRONOUN",
    5: "TIME",
    6: "DATE",
    7: "MONEY",
    8: "PERCENT",
    9: "MISC",
    10: "GPE",
    11: "FAC",
    12: "VEH",
    13: "WEA",
    14: "phone",
    15: "email",
    16: "URL",
}
OFFSET_TYPES = {0: "LINES", 1: "BYTES", 2: "CHARS"}

def _only(record: StructType, *names: str, **replaced: DataType) -> StructType:
    """``record`` cut to some of its fields, types replaced by smaller ones."""
    return StructType(
        [
            StructField(f.name, replaced.get(f.name, f.dataType), True, f.metadata)
            for f in record.fields
            if f.name in names or f.name in replaced
        ]
    )


_BARE_SENTENCES = MapType(_S, ArrayType(_only(SENTENCE, tokens=ArrayType(_only(TOKEN, "token")))))

#: The part of a stream item that the jobs read.
ROUTABLE = _only(
    STREAM_ITEM,
    "abs_url",
    "source",
    "stream_id",
    "stream_time",
    body=_only(CONTENT_ITEM, "clean_visible", sentences=_BARE_SENTENCES),
)
