"""Plain settings objects. They are small by nature (price list, route table, quotas) and turn
into DataFrames only where a join needs them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from meterline import schemas
from meterline.tables import small_table

LOG_MODES = ("metadata_only", "redacted", "full_encrypted", "disabled")
MISSING_TASK_BEHAVIORS = ("reject", "teacher_fallback", "unknown_task")
ROUTE_MODES = ("teacher_only", "student_only", "shadow", "canary", "bandit")
ACTIVE_MODES = ("shadow", "canary", "student_only", "bandit")
STUDENT_MODES = ("canary", "student_only", "bandit")


@dataclass(frozen=True)
class Backend:
    name: str
    input_price: float
    output_price: float


@dataclass(frozen=True)
class Route:
    mode: str
    student_model: str | None = None
    student_traffic_percentage: int | None = None
    teacher_probe_percentage: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in ROUTE_MODES:
            raise ValueError(f"unknown route mode: {self.mode!r}")


@dataclass(frozen=True)
class Gateway:
    """Prices of the teacher and the students, and the two log settings."""

    teacher: Backend
    students: tuple[Backend, ...] = ()
    log_mode: str = "redacted"
    missing_task: str = "teacher_fallback"
    max_capture_bytes: int | None = None

    def __post_init__(self) -> None:
        if self.log_mode not in LOG_MODES:
            raise ValueError(f"unknown log mode: {self.log_mode!r}")
        if self.missing_task not in MISSING_TASK_BEHAVIORS:
            raise ValueError(f"unknown missing-task behaviour: {self.missing_task!r}")

    def students_df(self, spark: SparkSession) -> DataFrame:
        rows = [(b.name, False, float(b.input_price), float(b.output_price)) for b in self.students]
        return small_table(spark, rows, schemas.BACKEND)


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    default_mode: str = "teacher_only"
    tasks: dict[str, Route] = field(default_factory=dict)

    def routes_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (task, r.mode, r.student_model, r.student_traffic_percentage,
             r.teacher_probe_percentage)
            for task, r in self.tasks.items()
        ]
        return small_table(spark, rows, schemas.ROUTE_ROW)


@dataclass(frozen=True)
class Limits:
    enabled: bool = True
    window_ms: int = 60_000
    default_per_window: int | None = None
    clients: dict[str, int] = field(default_factory=dict)
    tasks: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class DriftThresholds:
    min_requests: int = 20
    max_error_rate: float = 0.05
    max_p95_latency_ms: int = 0
    min_feedback: int = 5
    max_negative_feedback_rate: float = 0.20
