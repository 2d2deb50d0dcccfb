"""Links into the history server."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_BASE_URL = "http://localhost:18080/history"


def execution_link(app_id: Column, attempt_id: Column, execution_id: Column, base_url: str = DEFAULT_BASE_URL) -> Column:
    """``base/app[/attempt]/SQL/execution/?id=N``; NULL when the application is unknown."""
    attempt = F.nullif(attempt_id, F.lit(""))
    tail = F.concat(F.lit("SQL/execution/?id="), execution_id.cast("string"))
    return F.when(app_id.isNotNull(), F.concat_ws("/", F.lit(base_url), app_id, attempt, tail))


def stage_link(app_id: Column, stage_id: Column, stage_attempt: Column, base_url: str = DEFAULT_BASE_URL) -> Column:
    """``base/app/stages/stage/?id=N&attempt=M``."""
    return F.concat(
        F.lit(base_url + "/"), app_id, F.lit("/stages/stage/?id="), stage_id.cast("string"),
        F.lit("&attempt="), stage_attempt.cast("string"),
    )
