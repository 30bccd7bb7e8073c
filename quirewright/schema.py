"""The data model as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


SECTION = _struct(name=_S, content=_S, start_pos=_I, end_pos=_I)
PAPER = _struct(path=_S, title=_S, text=_S, page_count=_I, metadata=T.MapType(_S, _S), abstract=_S, sections=T.ArrayType(SECTION))
CHUNK = _struct(text=_S, start_pos=_I, end_pos=_I, token_count=_I, source_section=_S, chunk_index=_I, total_chunks=_I)
STORED = _struct(
    id=_S, text=_S, vector=T.ArrayType(T.FloatType()), paper_title=_S, paper_path=_S, section=_S, chunk_index=_I, total_chunks=_I, token_count=_I, start_pos=_I, end_pos=_I
)
HIT = _struct(text=_S, score=_D, paper_title=_S, section=_S, chunk_index=_I, metadata=_struct(paper_path=_S, token_count=_I, total_chunks=_I))
RESPONSE = _struct(content=_S, model=_S, prompt_tokens=_I, completion_tokens=_I, total_tokens=_I)
MESSAGES = T.ArrayType(_struct(role=_S, content=_S))
ANALYSIS = _struct(paper_path=_S, paper_title=_S, analysis_type=_S, content=_S, sections_analyzed=T.ArrayType(_S), chunks_processed=_I, n_chunks=_I, context_empty=T.BooleanType(), model_used=_S)
SCORE = _struct(overall=_D, methodology=_D, statistics=_D, claims=_D, transparency=_D, red_flags=T.ArrayType(_S), summary=_S, raw=_S, rating=_S, severity=_S, parse_ok=T.BooleanType())
