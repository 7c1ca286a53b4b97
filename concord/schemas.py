"""Schemas of the tables that pass between operators."""

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


VERDICT = _struct(ts=_S, model1_label=_S, model2_label=_S, gpt_choice=_S, gpt_output=_S, repetition=T.IntegerType())
RANKING = _struct(model=_S, games=_L, wins=_L, losses=_L, ties=_L, points=_D, win_rate=_D)
REPLY = _struct(final_keep_ids=T.ArrayType(_S), per_model_notes=T.MapType(_S, _S))
AUDIT = _struct(
    final_keep_ids=T.ArrayType(_S), final_model_ids=T.ArrayType(_S), per_model_notes_generic=T.MapType(_S, _S),
    per_model_notes=T.MapType(_S, _S), dataset_name=_S, raw_response=_S,
)
PART = _struct(type=_S, text=_S, url=_S)
MESSAGE = _struct(role=_S, content=T.ArrayType(PART))
