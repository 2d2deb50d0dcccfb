"""JSON lines to typed event tables, parsed once and saved by event type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansieve.events import COMMON_EVENT_TYPES, KINDS
from plansieve.plans.flatten import BROKEN_JSON, BROKEN_PLAN, flatten_plan
from plansieve.session import scratch_path
from plansieve.sources.lines import event_type_of, filter_event_types, has_event_type

# Rows in a page of a saved table: the unit that a question about marks passes over.
PAGE_ROWS = 500
BAD_LINE = "_bad_line"
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}


PLAN_KINDS = ("plan", "sql_start")
NO_TAG = "no event tag"
OTHER = "other"


def _shallow(value: Column, is_plan: Column) -> Column:
    """A plan's line without what lies below its root: the JSON reader refuses values of 1,000 levels and more.

    A node lists its children before its metadata, so the text from the first list of children to the last such place is
    what lies below the root. Quotes inside strings are escaped and match neither end.
    """
    cut = F.regexp_replace(value, r'(?s)"children":\[.*\],"metadata":', '"children":[],"metadata":')
    return F.when(is_plan, cut).otherwise(value)


def _fields(kinds: tuple[str, ...]) -> dict[str, str]:
    return {field: ddl for kind in kinds for field, ddl in KINDS[kind][1].items()}


def _schema(*kinds: str) -> str:
    return ", ".join(f"`{field}` {ddl}" for field, ddl in _fields(kinds).items()) + f", {BAD_LINE} STRING"


def _kind(tag: Column, kinds: tuple[str, ...]) -> Column:
    known = F.lit(None).cast("string")
    for kind in kinds:
        known = F.when(tag == KINDS[kind][0], F.lit(kind)).otherwise(known)
    return known


def decode(lines: DataFrame, *kinds: str) -> DataFrame:
    """(log_id, ord, kind, fields of the kinds) of one or several event types in one scan.

    The tag test runs on the text before any JSON is parsed. Lines whose JSON is broken are left out
    here and listed by :func:`corrupt_lines`.
    """
    is_plan = F.col("event_type").isin([KINDS[k][0] for k in kinds if k in PLAN_KINDS])
    event = F.from_json(_shallow(F.col("value"), is_plan), _schema(*kinds), JSON_OPTIONS)
    # A plain filter on the parsed event would be pushed below the projection and parse every line twice;
    # unfolding a list that is empty for a bad line parses once.
    good = F.filter(F.array(event), lambda e: e[BAD_LINE].isNull())
    return (
        filter_event_types(lines, [KINDS[k][0] for k in kinds])
        .select("log_id", "ord", _kind(F.col("event_type"), kinds).alias("kind"), F.inline(good))
        .drop(BAD_LINE)
    )


def _has_all(value: Column, words: tuple[str, ...]) -> Column:
    return reduce(and_, [value.contains(word) for word in words])


def decode_all(lines: DataFrame, kinds: list[str] | None = None, words: tuple[str, ...] = ()) -> DataFrame:
    """One row per event with one typed column per kind, so a single pass over the text feeds a save.

    ``nodes`` is the unfolded tree of events that carry a plan, ``names`` and ``marks`` tell what is in it. The line itself is
    kept, with the reason, only where it is not a tagged event, its JSON is broken or its plan is malformed. The start of an execution
    counts although its initial plan is malformed. With ``words`` only plan updates whose line contains them all are kept, and of the
    start of an execution without them the initial plan is not unfolded.
    """
    kinds = kinds or list(KINDS)
    value = F.col("value")
    # NULL for a line without a tag; a tag that nobody asked for is no kind.
    kind = F.when(event_type_of(value).isNull(), None).otherwise(F.lit(OTHER))
    for k in reversed(kinds):
        kind = F.when(has_event_type(value, KINDS[k][0]), F.lit(k)).otherwise(kind)
    if "plan" in kinds and words:
        # A plan update without a word is passed over here, where its text is searched once.
        lines = lines.filter(F.coalesce(~has_event_type(value, KINDS["plan"][0]) | _has_all(value, words), F.lit(True)))
    tagged = lines.select("log_id", "ord", "value", kind.alias("found")).filter(F.col("found").isNull() | (F.col("found") != OTHER))
    is_kind = {k: F.col("found") == k for k in kinds}

    def parsed(k: str) -> Column:
        text = _shallow(value, F.lit(True)) if k in PLAN_KINDS else value
        return F.when(is_kind[k], F.from_json(text, _schema(k), JSON_OPTIONS)).alias(k)

    # A plan update is parsed once, by the unfolding; its own two fields come out of that.
    has_plan = F.col("found").isin(*PLAN_KINDS)
    wanted = has_plan & ((F.col("found") == "plan") | _has_all(value, words)) if words else has_plan
    flat = flatten_plan(F.when(has_plan, value), wanted) if words else flatten_plan(F.when(has_plan, value))
    typed = tagged.select(
        "log_id", "ord", "found", "value", wanted.alias("wanted"), *[parsed(k) for k in kinds if k != "plan"], flat.alias("flat")
    )
    bad = F.coalesce(F.col("flat.problem") == BROKEN_JSON, F.lit(False))
    for k in kinds:
        if k != "plan":
            bad = bad | F.coalesce(F.col(f"{k}.{BAD_LINE}").isNotNull(), F.lit(False))
    reason = F.when(F.col("found").isNull(), NO_TAG).when(bad, BROKEN_JSON).when(F.col("flat.problem") == BROKEN_PLAN, BROKEN_PLAN)
    starts = is_kind["sql_start"] if "sql_start" in kinds else F.lit(False)
    is_corrupt = reason.isNotNull() & ~F.coalesce((reason == BROKEN_PLAN) & starts, F.lit(False))
    root = F.get("flat.nodes", F.lit(0))
    update = F.struct(
        F.col("flat.execution_id").alias("executionId"),
        F.when(root.isNotNull(), F.struct(root["node_name"].alias("nodeName"), root["simple_string"].alias("simpleString"))).alias("sparkPlanInfo"),
    )
    columns = [F.when(is_kind[k], update).alias(k) if k == "plan" else F.col(k).dropFields(BAD_LINE).alias(k) for k in kinds]
    return typed.select(
        "log_id",
        "ord",
        F.when(reason.isNotNull(), value).alias("value"),
        reason.alias("reason"),
        *[F.when(reason.isNull() & F.col("wanted"), F.col(f"flat.{c}")).alias(c) for c in ("nodes", "names", "marks")],
        *columns,
        F.when(is_corrupt, F.lit("corrupt")).otherwise(F.col("found")).alias("kind"),
    )


def corrupt_lines(lines: DataFrame) -> DataFrame:
    """(log_id, ord, value, reason) of lines that are not a tagged event, or whose JSON or plan cannot be decoded."""
    found = decode_all(lines).filter(F.col("reason").isNotNull())
    return found.select("log_id", "ord", "value", "reason")


class EventTables:
    """The typed event tables of a set of logs.

    Built straight from lines (each table is then a filtered scan of the text) or opened from a saved
    folder, where the JSON has been parsed once and each table reads only its own partition and columns.
    """

    def __init__(self, lines: DataFrame | None = None, saved: DataFrame | None = None):
        if lines is None and saved is None:
            raise ValueError("give lines or a saved table")
        self._lines = lines
        self._saved = saved
        self._once: dict[tuple, EventTables] = {}
        self._kept: dict[str, DataFrame] = {}

    @classmethod
    def from_lines(cls, lines: DataFrame) -> EventTables:
        return cls(lines=lines)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> EventTables:
        try:
            return cls(saved=spark.read.parquet(path))
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
        # No log had a line: the folder holds no file, and every table is empty.
        nothing = spark.createDataFrame([], "log_id STRING, ord DECIMAL(38,0), value STRING")
        return cls(saved=spark.createDataFrame([], decode_all(nothing).schema))

    def save(self, path: str, kinds: list[str] | None = None, words: tuple[str, ...] = ()) -> EventTables:
        """Parse every line once, write the events partitioned by kind, and return the saved tables.

        Nothing is shuffled: each task writes its own lines, plans with the same marks side by side in short pages, so that
        a question that asks for a mark passes over the pages, and the nodes in them, that do not have it. ``words`` as in
        :func:`decode_all`; they have chosen the plans already, whose marks are then not sorted for.
        """
        if self._lines is None or self._saved is not None:
            raise ValueError("these tables are saved already")
        rows = decode_all(self._lines, kinds, words)
        rows = rows if words else rows.sortWithinPartitions("kind", "marks")
        rows.write.partitionBy("kind").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
        return EventTables.open(self._lines.sparkSession, path)

    def once(self, words: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> EventTables:
        """These tables in a form that any number of questions can share without reading the text again.

        Text is parsed into the shared scratch folder the first time; the default event types are kept,
        which leaves out the many task events; those are still read from the text when asked for. Who asks only for plans
        that contain certain ``words`` gets tables that hold, and have unfolded, no other plans. Kinds ``without`` which the questions
        can be answered need not be parsed.
        """
        if self._saved is not None:
            return self
        if () in self._once:
            return self._once[()]
        # Tables with all kinds answer those who can do without some.
        chosen = words if words in self._once else (words, without) if without else words
        if chosen not in self._once:
            kinds = [kind for kind, (tag, _) in KINDS.items() if tag in COMMON_EVENT_TYPES and kind not in without]
            saved = self.save(scratch_path(self._lines.sparkSession, "events"), kinds, words)
            self._once[chosen] = EventTables(self._lines, saved._saved)
        return self._once[chosen]

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from these, made by the first who asks for it."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def kept(self, name: str) -> DataFrame | None:
        return self._kept.get(name)

    def _is_saved(self, kinds: tuple[str, ...]) -> bool:
        if self._saved is None:
            return False
        absent = [k for k in kinds if k not in self._saved.columns]
        if absent and self._lines is None:
            raise ValueError(f"events of kind {', '.join(absent)} were not saved here")
        return not absent

    def has_saved(self, *kinds: str) -> bool:
        return self._is_saved(kinds)

    def of(self, *kinds: str) -> DataFrame:
        """(log_id, ord, kind, fields) of one or several kinds of event, in one scan."""
        if not self._is_saved(kinds):
            return decode(self._lines, *kinds)
        # A saved row has a value in its own kind's column only.
        fields = [
            F.coalesce(*[F.col(k)[field] for k in kinds if field in KINDS[k][1]]).alias(field)
            for field in _fields(kinds)
        ]
        return self._saved.filter(F.col("kind").isin(*kinds)).select("log_id", "ord", "kind", *fields)

    def plans(self, *kinds: str, words: tuple[str, ...] = ()) -> DataFrame:
        """(log_id, ord, executionId, nodes, names, marks): events with a plan, unfolded. Malformed plans are left out.

        ``words`` are texts that every plan asked for contains: on text, other lines are then not parsed.
        """
        if not self._is_saved(kinds):
            lines = filter_event_types(self._lines, [KINDS[k][0] for k in kinds])
            for word in words:
                lines = lines.filter(F.col("value").contains(word))
            flat = lines.select("log_id", "ord", flatten_plan("value").alias("flat")).filter(F.col("flat.problem").isNull())
            return flat.select("log_id", "ord", F.col("flat.execution_id").alias("executionId"), "flat.nodes", "flat.names", "flat.marks")
        execution = F.coalesce(*[F.col(k)["executionId"] for k in kinds]).alias("executionId")
        rows = self._saved.filter(F.col("kind").isin(*kinds) & F.col("reason").isNull())
        return rows.select("log_id", "ord", execution, "nodes", "names", "marks")

    def corrupt(self) -> DataFrame:
        """(log_id, ord, value, reason) of bad lines; of saved tables, those of the kinds saved and those without a tag."""
        if self._saved is None:
            return corrupt_lines(self._lines)
        listed = self._saved.filter(F.col("kind").isin("corrupt", *PLAN_KINDS) & F.col("reason").isNotNull())
        return listed.select("log_id", "ord", "value", "reason")
