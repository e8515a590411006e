"""Explicit schemas of everything that is stored or exchanged. Offsets are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CHUNKS = _of(id=STRING, file_path=STRING, text=STRING, start=INT, end=INT, kind=STRING, ordinal=LONG)
POSTINGS = _of(term=STRING, chunk_id=STRING, ordinal=LONG, tf=LONG)
TERM_STATS = _of(term=STRING, df=LONG, idf=DOUBLE)
DOC_STATS = _of(chunk_id=STRING, ordinal=LONG, dl=LONG)
CORPUS_STATS = _of(n_docs=LONG, avgdl=DOUBLE)
SEGMENTS = _of(
    chunk_ids=T.ArrayType(STRING), ordinals=T.ArrayType(LONG), dls=T.ArrayType(LONG), terms=T.ArrayType(STRING), counts=T.ArrayType(INT), places=T.ArrayType(INT), tfs=T.ArrayType(INT)
)
#: Terms as lines of one value; counts, places and tfs as bytes: four to a number, all lowest bytes first.
STORED_SEGMENTS = T.StructType([*SEGMENTS.fields[:3], *[T.StructField(name, T.BinaryType()) for name in SEGMENTS.names[3:]]])
EMBEDDINGS = _of(chunk_id=STRING, embedding=T.ArrayType(T.FloatType()))
MANIFEST = _of(path=STRING, hash=STRING, max_chunk_size=INT, chunk_ids=T.ArrayType(STRING))
QUERY_CACHE = _of(key=STRING, mode=STRING, index_version=STRING, rank=INT, chunk_id=STRING)

SPAN = "struct<file_path:string, first_character_index:int, last_character_index:int>"
_SPANS = T.ArrayType(_of(file_path=STRING, first_character_index=INT, last_character_index=INT))
DATASET = _of(rag_questions=T.ArrayType(_of(question_id=STRING, question=STRING, sources=_SPANS, answer=STRING)), _corrupt=STRING)
SEARCH_RESULTS = _of(search_results=T.ArrayType(_of(question_id=STRING, question=STRING, retrieved_sources=_SPANS, answer=STRING)), k=INT, _corrupt=STRING)
