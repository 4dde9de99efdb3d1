"""Result documents: JSON records by teacher, replaced key by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillhouse.config import TeacherConfig, TrainingConfig
from stillhouse.functions import metrics as M
from stillhouse.operators.upsert import upsert
from stillhouse.sources.shared import child_names, exists, remove


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _WHOLE, _REAL = T.StringType(), T.LongType(), T.DoubleType()

SAMPLE_PREDICTION = _struct(
    question=_TEXT,
    ground_truth=_TEXT,
    predicted_answer=_TEXT,
    full_response=_TEXT,
    correct=T.BooleanType(),
)
EVALUATION_RESULT = _struct(
    teacher=_TEXT,
    accuracy=_REAL,
    correct=_WHOLE,
    total=_WHOLE,
    sample_predictions=T.ArrayType(SAMPLE_PREDICTION),
)

TRAINING_RECORD = _struct(
    teacher=_TEXT,
    timestamp=_TEXT,
    dataset=_struct(source=_TEXT, train_size=_WHOLE),
    model=_struct(student=_TEXT, teacher=_TEXT),
    hyperparameters=_struct(
        learning_rate=_REAL,
        batch_size=_WHOLE,
        gradient_accumulation_steps=_WHOLE,
        effective_batch_size=_WHOLE,
        num_epochs=_WHOLE,
        max_seq_length=_WHOLE,
        lora_r=_WHOLE,
        lora_alpha=_WHOLE,
        lora_dropout=_REAL,
    ),
    training=_struct(
        total_steps=_WHOLE,
        time_minutes=_REAL,
        final_loss=_REAL,
        trainable_params=_WHOLE,
        total_params=_WHOLE,
        trainable_percent=_REAL,
    ),
    output_path=_TEXT,
)

#: Complete versions of a document that are kept.
KEPT_VERSIONS = 5


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON object keyed by teacher."""
    return _rows(spark.read.text(path, wholetext=True), schema)


def _rows(texts: DataFrame, schema: T.StructType) -> DataFrame:
    as_map = F.from_json("value", T.MapType(T.StringType(), schema), {"mode": "FAILFAST"})
    return texts.select(F.explode(as_map).alias("key", "record")).select("record.*")


class ConflictError(RuntimeError):
    """Another writer changed the document in between."""


class ResultsDocument:
    """A results document with replacement by key: one JSON record per key, whatever their number.

    Each change is written beside its predecessor as ``version=n``. A version counts once Spark
    has marked it complete, so what a failed or killed write leaves behind is never read, and the
    next write takes a number above it. A writer that finds, once it is done, that another one
    completed a version since it read the document takes its own back and fails, instead of
    losing what the other wrote. The last ``KEPT_VERSIONS`` complete versions are kept.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "teacher"):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    def _versions(self) -> dict[int, bool]:
        """Numbers present, each with whether it is complete; only names are listed."""
        names = child_names(self.spark, self.root)
        numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
        return {n: exists(self.spark, f"{self._path(n)}/_SUCCESS") for n in numbers}

    def version(self) -> int:
        """Number of the current version, 0 before the first."""
        return max((n for n, complete in self._versions().items() if complete), default=0)

    def read(self) -> DataFrame:
        return self._read(self.version())

    def _read(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        lines = self.spark.read.text(self._path(version))
        record = F.from_json("value", self.schema, {"mode": "FAILFAST"})
        return lines.select(record.alias("record")).select("record.*")

    def upsert(self, new: DataFrame, seq: str | None = None) -> None:
        """Add rows, replacing those of equal key."""
        base = self.version()
        rows = upsert(self._read(base), new, self.key, seq)
        own = max(self._versions(), default=0) + 1
        text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        rows.select(text.alias("value")).write.text(self._path(own))
        present = self._versions()
        others = [n for n, complete in present.items() if complete and n not in (base, own)]
        if any(n > base for n in others):
            remove(self.spark, self._path(own))
            raise ConflictError(f"{self.root} was changed by another writer")
        old = sorted(n for n, complete in present.items() if complete)[:-KEPT_VERSIONS]
        for n in [n for n, complete in present.items() if n in old or not complete and n < base]:
            remove(self.spark, self._path(n))

    def _path(self, version: int) -> str:
        return f"{self.root}/version={version}"


def training_records(
    runs: DataFrame,
    data_root: str,
    model_root: str,
    training: TrainingConfig = TrainingConfig(),
    teachers: TeacherConfig = TeacherConfig(),
) -> DataFrame:
    """Nested training records from flat run facts.

    ``runs`` has ``teacher, started_at (timestamp_ntz), ended_at, train_size, total_steps,
    final_loss, trainable_params, total_params``.
    """
    t = training
    original = F.col("teacher") == teachers.original
    names = [F.lit(x) for pair in teachers.model_names().items() for x in pair]

    def big(value: int):
        return F.lit(value).cast("bigint")

    batch, accumulation = big(t.batch_size), big(t.gradient_accumulation_steps)
    share = F.col("trainable_params") / F.col("total_params")
    return runs.select(
        "teacher",
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.struct(
            F.when(original, F.lit(teachers.original))
            .otherwise(F.concat(F.lit(data_root + "/teacher="), "teacher"))
            .alias("source"),
            "train_size",
        ).alias("dataset"),
        F.struct(
            F.lit(t.student_model).alias("student"),
            F.create_map(*names)[F.col("teacher")].alias("teacher"),
        ).alias("model"),
        F.struct(
            F.lit(t.learning_rate).alias("learning_rate"),
            batch.alias("batch_size"),
            accumulation.alias("gradient_accumulation_steps"),
            M.effective_batch(batch, accumulation).alias("effective_batch_size"),
            big(t.num_epochs).alias("num_epochs"),
            big(t.max_seq_length).alias("max_seq_length"),
            big(t.lora_r).alias("lora_r"),
            big(t.lora_alpha).alias("lora_alpha"),
            F.lit(t.lora_dropout).alias("lora_dropout"),
        ).alias("hyperparameters"),
        F.struct(
            F.col("total_steps").cast("bigint").alias("total_steps"),
            M.rounded(M.elapsed_minutes(F.col("started_at"), F.col("ended_at")), 2).alias(
                "time_minutes"
            ),
            M.rounded(F.col("final_loss"), 4).alias("final_loss"),
            "trainable_params",
            "total_params",
            M.rounded(100 * share, 2).alias("trainable_percent"),
        ).alias("training"),
        F.concat(F.lit(model_root + "/"), "teacher", F.lit("/adapter")).alias("output_path"),
    )


def flat_training_records(records: DataFrame) -> DataFrame:
    """Training records as one flat row each, the start as a timestamp."""
    return records.select(
        "teacher",
        F.to_timestamp_ntz("timestamp").alias("started_at"),
        F.col("dataset.source").alias("source"),
        F.col("dataset.train_size").alias("train_size"),
        F.col("model.student").alias("student_model"),
        F.col("model.teacher").alias("teacher_model"),
        "hyperparameters.*",
        "training.*",
        "output_path",
    )
