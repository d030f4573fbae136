"""Spark types of the entities the library reads and writes."""

from pyspark.sql import types as T

from pairloom.values import RUBRICS

_texts = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType | str) -> T.StructType:
    names = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType(
        [T.StructField(n, names.get(t, t) if isinstance(t, str) else t) for n, t in fields.items()]
    )


SOURCE_ITEM = _struct(
    korean_topic="string",
    korean_context="string",
    foreign_topic="string",
    foreign_context="string",
    problem_types=_texts,
    eval_goals=_texts,
)

BENCHMARK = _struct(
    id="int",
    problem_types=_texts,
    eval_goals=_texts,
    items=T.ArrayType(
        _struct(
            korean_topic="string",
            korean_context="string",
            foreign_topic="string",
            foreign_context="string",
        )
    ),
)

PASSAGE = _struct(source_item=SOURCE_ITEM, generated_passage="string", text="string")

QUALITY_SAMPLE = _struct(name="string", quality="string", text="string")

EVALUATION = _struct(
    source_item=SOURCE_ITEM,
    generated_passage="string",
    evaluation=T.StructType(
        [T.StructField(f"{r}_score", T.IntegerType()) for r in RUBRICS]
        + [
            T.StructField("scores", T.MapType(T.StringType(), T.StringType())),
            T.StructField("feedback", T.StringType()),
            T.StructField("evaluation_timestamp", T.StringType()),
        ]
    ),
)

PAIR = _struct(
    pair_id="string",
    rubric="string",
    source_item=SOURCE_ITEM,
    chosen="string",
    rejected="string",
    dataset_type="string",
    created_at=T.TimestampType(),
)

_message = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])

RECORD = _struct(conversations=T.ArrayType(_message), chosen=_message, rejected=_message)

TRAIN_RECORD = _struct(prompt="string", chosen="string", rejected="string")

RANKED = T.StructType(
    [T.StructField("passage", T.StringType())]
    + [T.StructField(f"r{i}_score", T.DoubleType()) for i in range(1, 7)]
    + [T.StructField(f"{who}_ranking", T.IntegerType()) for who in ("rm", "human", "gemini")]
)

CHAT_RESPONSE = _struct(
    custom_id="string",
    error=_struct(code="string", message="string"),
    response=_struct(
        status_code="int",
        body=_struct(
            choices=T.ArrayType(_struct(message=_struct(content="string"))),
        )
    ),
)
