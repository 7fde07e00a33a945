"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _table(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


CHUNKS = _table(id=_S, source=_S, chunk_index=_I, text=_S, vector=T.ArrayType(T.FloatType()))
DOCUMENTS = _table(doc_id=_S, doc_name=_S, digest=_S, markdown=_S, chapters=_S)
CHAPTERS = T.ArrayType(_table(level=_I, title=_S))
MANIFEST = _table(source=_S, mtime=_D, size=_L, content_hash=_S, chunk_count=_I)
POSTINGS = _table(term=_S, id=_S, source=_S, tf=_L, dl=_L)
LENGTHS = _table(source=_S, n=_L, dl=_L)
FILES = _table(source=_S, mtime=_D, size=_L)
ENTITIES = _table(key=_S, name=_S, type=_S, created_at=_S)
OBSERVATIONS = _table(key=_S, ord=_L, text=_S)
RELATIONS = _table(source=_S, target=_S, label=_S)
SKILLS = _table(name=_S, description=_S, keywords=T.ArrayType(_S), tags=T.ArrayType(_S), path=_S, entry=_S)
KV = _table(key=_S, value=_S, updated_at=_S)
SKILL_INDEX = _table(dir=_S, name=_S, description=_S, tags=T.ArrayType(_S), text=_S, fingerprint=_S, desc_vec=T.ArrayType(T.FloatType()), examples_vec=T.ArrayType(T.FloatType()))
EMBEDDED = _table(id=_S, entity=_S, text=_S, vector=T.ArrayType(T.FloatType()))
EXTRACTION = _table(
    entities=T.ArrayType(_table(name=_S, type=_S, observations=T.ArrayType(_S))),
    relations=T.ArrayType(_table(source=_S, target=_S, label=_S)),
)
