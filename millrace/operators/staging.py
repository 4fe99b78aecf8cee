"""Staging tables, slowly changing history, and models built from tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.names import INTERNAL_PREFIXES, first_line, normalize_name, quoted, user_columns
from millrace.operators.dedup import first_row
from millrace.operators.monitor import moment
from millrace.operators.timeline import next_time
from millrace.session import materialize

# Fixed value: the word that marks a date column.
DATE_WORD = re.compile(r"\bdate\b", re.IGNORECASE)


# --- staging projection -----------------------------------------------------------------


def staging_date_cast(df: DataFrame) -> DataFrame:
    """Timestamps whose name has the word *date* become dates (``start_date`` is one word)."""
    stamps = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and DATE_WORD.search(f.name)
    }
    if not stamps:
        return df
    return df.withColumns({c: F.col(quoted(c)).cast("date") for c in stamps})


def staging_projection(df: DataFrame, prefixes: Sequence[str] = INTERNAL_PREFIXES) -> DataFrame:
    """User columns under normalised names; dates cast as above."""
    cast = staging_date_cast(df)
    names = [f.name for f in user_columns(df, prefixes)]
    new = [normalize_name(n) for n in names]
    twice = sorted({n for n in new if new.count(n) > 1})
    if twice:
        raise ValueError(f"columns share a normalised name: {twice}")
    return cast.select(*[F.col(quoted(n)).alias(m) for n, m in zip(names, new, strict=True)])


# --- slowly changing history ------------------------------------------------------------


def scd2_history(df: DataFrame, keys: Sequence[str], updated_at: str) -> DataFrame:
    """Versions of every key from its whole change log: valid from one change to the next."""
    once = first_row(df, [*keys, updated_at], [])
    return (
        next_time(once, keys, updated_at, "valid_to")
        .withColumn("valid_from", F.col(quoted(updated_at)))
        .select(*df.columns, "valid_from", "valid_to")
    )


def scd2_timestamp(snapshot: DataFrame | None, incoming: DataFrame, keys: Sequence[str], updated_at: str) -> DataFrame:
    """Apply a load: a newer ``updated_at`` closes the open version and opens another.

    Loading the same rows again changes nothing.
    """
    batch = first_row(incoming, keys, [F.col(quoted(updated_at)).desc_nulls_last()])
    fresh = batch.withColumn("valid_from", F.col(quoted(updated_at)))
    return _apply(snapshot, fresh, keys, lambda old, new: new[updated_at] > old[updated_at])


def scd2_check(
    snapshot: DataFrame | None, incoming: DataFrame, keys: Sequence[str], now: datetime | Column, columns: Sequence[str] | None = None
) -> DataFrame:
    """The same when any of ``columns`` (all by default) differs; versions start at ``now``."""
    batch = first_row(incoming, keys, [])
    watched = [c for c in (columns or incoming.columns) if c not in keys]

    def differs(old: Column, new: Column) -> Column:
        same = [old[c].eqNullSafe(new[c]) for c in watched]
        out = F.lit(False)
        for one in same:
            out = out | ~one
        return out

    return _apply(snapshot, batch.withColumn("valid_from", moment(now)), keys, differs)


def _apply(snapshot: DataFrame | None, fresh: DataFrame, keys: Sequence[str], changed) -> DataFrame:
    """Pair the open version and the new row of a key (two rows at most) in one shuffle.

    Closed versions take no part and are passed on as they are.
    """
    columns = fresh.columns
    if snapshot is None:
        return fresh.withColumn("valid_to", F.lit(None).cast(fresh.schema["valid_from"].dataType))
    closed = snapshot.where(F.col("valid_to").isNotNull())
    open_rows = snapshot.where(F.col("valid_to").isNull()).drop("valid_to")
    whole = F.struct(*[F.col(quoted(c)).alias(c) for c in columns])
    pair = Window.partitionBy(*[quoted(k) for k in keys]).orderBy("_new")
    both = (
        open_rows.select(*[quoted(c) for c in columns])
        .withColumn("_new", F.lit(0))
        .unionByName(fresh.withColumn("_new", F.lit(1)))
        .withColumn("_row", whole)
        .withColumn("_next", F.lead("_row").over(pair))
        .withColumn("_prior", F.lag("_row").over(pair))
    )
    opens = F.col("_prior").isNull() | changed(F.col("_prior"), F.col("_row"))
    closes = F.col("_next").isNotNull() & changed(F.col("_row"), F.col("_next"))
    current = both.where((F.col("_new") == 0) | opens).select(
        *[quoted(c) for c in columns], F.when((F.col("_new") == 0) & closes, F.col("_next.valid_from")).alias("valid_to")
    )
    return closed.select(*current.columns).unionByName(current)


def stale_record_flag(table: DataFrame, latest: DataFrame, keys: Sequence[str], flag: str = "is_stale") -> DataFrame:
    """Mark rows whose key is missing from the latest load."""
    seen = latest.select(*[quoted(k) for k in keys]).distinct().withColumn("_seen", F.lit(True))
    joined = table.join(seen, list(keys), "left")
    return joined.select(*table.columns, F.col("_seen").isNull().alias(flag))


# --- models -----------------------------------------------------------------------------


def geo_enrich(fact: DataFrame, seed: DataFrame, fact_key: str, seed_key: str, columns: Mapping[str, str]) -> DataFrame:
    """Names from a seed file for the ids of a fact table; an unknown id gives NULL.

    The seed is broadcast when its size allows, which Spark checks.
    """
    small = seed.select(F.col(quoted(seed_key)).alias("_seed_key"), *[F.col(quoted(c)).alias(out) for c, out in columns.items()])
    return fact.join(small, fact[quoted(fact_key)] == F.col("_seed_key"), "left").drop("_seed_key")


def mart_rollup(dim: DataFrame, fact: DataFrame, dim_key: str, fact_key: str, group: Column, group_name: str, measure: str) -> DataFrame:
    """Count and sum of a fact table per (upper-cased) group of its dimension.

    The fact table is summed per key before the join, so what the join sees of a hot key is
    one row, and decimals keep the sum exact.
    """
    per_key = fact.groupBy(F.col(quoted(fact_key)).alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(quoted(measure)).cast("decimal(28,4)")).alias("_sum")
    )
    joined = dim.select(F.col(quoted(dim_key)).alias("_k"), F.upper(group).alias(group_name)).join(per_key, "_k", "left")
    return joined.groupBy(group_name).agg(
        F.count(F.lit(1)).alias("members"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("facts"),
        F.coalesce(F.sum("_sum").cast("double"), F.lit(0.0)).alias("total"),
    )


@dataclass(frozen=True)
class Model:
    """A SELECT over tables and other models, each named ``{name}`` in the text."""

    name: str
    sql: str
    depends_on: Sequence[str] = field(default_factory=tuple)


def model_order(models: Sequence[Model], tables: Sequence[str], select: str | None = None) -> list[Model]:
    """Models in dependency order; ``select`` as ``name+`` keeps the descendants of one table."""
    waiting = {m.name: m for m in models}
    done, order = set(tables), []
    while waiting:
        ready = sorted(n for n, m in waiting.items() if set(m.depends_on) <= done)
        if not ready:
            raise ValueError(f"models in a cycle or with unknown inputs: {sorted(waiting)}")
        order += [waiting.pop(n) for n in ready]
        done.update(ready)
    if select is None:
        return order
    kept = {select.removesuffix("+")}
    for m in order:
        if select.endswith("+") and kept & set(m.depends_on):
            kept.add(m.name)
    return [m for m in order if m.name in kept]


def run_models(
    spark: SparkSession, models: Sequence[Model], tables: Mapping[str, DataFrame], select: str | None = None, store: bool = True
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Run the models; returns their tables and, per model that failed, the reason.

    Each model is written once and read by those that depend on it. A model whose input
    failed is skipped.
    """
    chosen = model_order(models, list(tables), select)
    built: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    outside = [m for m in model_order(models, list(tables)) if m not in chosen]
    for m in outside:
        # Not selected, but a selected model may read it: it stays a plain view.
        if any(m.name in c.depends_on for c in chosen):
            built[m.name] = spark.sql(m.sql, **{d: {**tables, **built}[d] for d in m.depends_on})
    for m in chosen:
        broken = [d for d in m.depends_on if d in errors]
        if broken:
            errors[m.name] = f"skipped: {broken[0]} failed"
            continue
        try:
            df = spark.sql(m.sql, **{d: {**tables, **built}[d] for d in m.depends_on})
            built[m.name] = materialize(df, f"model-{m.name}") if store else df
        except PySparkException as error:
            errors[m.name] = first_line(error)
    return {m.name: built[m.name] for m in chosen if m.name in built}, errors


class QueryRejectedError(ValueError):
    """An ad-hoc query that is not a single SELECT."""


# Top nodes of a parsed SELECT (with its ORDER BY, LIMIT, DISTINCT, HAVING or WITH around it).
SELECT_NODES = (
    "Project", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Filter", "UnresolvedHaving",
    "UnresolvedWith", "WithWindowDefinition", "Offset", "Window",
)
WRAPPERS = ("Sort", "GlobalLimit", "LocalLimit", "Distinct", "UnresolvedWith", "WithWindowDefinition", "Offset", "UnresolvedHint")
# Functions that run code by name or look outside the given tables.
BARRED_FUNCTIONS = ("reflect", "java_method", "try_reflect", "read_files", "python_worker_logs", "session_user_agent")
SUBQUERIES = ("ScalarSubquery", "ListQuery", "Exists", "UnresolvedScalarSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")
BARRED_NODES = ("ScriptTransformation", "UnresolvedTableValuedFunction", "UnresolvedInlineTableFunction")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_node(node, known: set[str]) -> None:
    """Walk a parsed plan: its nodes, their expressions and the plans inside those."""
    kind = node.getClass().getSimpleName()
    if kind in BARRED_NODES:
        raise QueryRejectedError(f"{kind} is not allowed")
    if kind == "UnresolvedWith":
        named = [pair._1() for pair in _items(node.cteRelations())]
        inner = known | {name.lower() for name in named}
        for pair in _items(node.cteRelations()):
            _check_node(pair._2(), inner)
        _check_node(node.child(), inner)
        return
    if kind == "UnresolvedRelation":
        name = _items(node.multipartIdentifier())
        if len(name) != 1 or name[0].lower() not in known:
            raise QueryRejectedError(f"{'.'.join(name)} is not one of the tables")
    for child in _items(node.children()):
        _check_node(child, known)
    for expression in _items(node.expressions()):
        _check_expression(expression, known)


def _check_expression(expression, known: set[str]) -> None:
    kind = expression.getClass().getSimpleName()
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        name = _items(expression.nameParts()) if kind == "UnresolvedFunction" else [expression.name().funcName()]
        if name[-1].lower() in BARRED_FUNCTIONS:
            raise QueryRejectedError(f"function {name[-1]} is not allowed")
    if kind in SUBQUERIES:
        _check_node(expression.plan(), known)
    for child in _items(expression.children()):
        _check_expression(child, known)


def check_select(spark: SparkSession, sql: str, tables: Iterable[str] = ()) -> None:
    """Refuse all but one SELECT over ``tables``, by Spark's own parser.

    Subqueries and common table expressions are checked too: no script, no function that runs code by name, no relation
    besides the tables (a path is one).
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as error:  # py4j wraps the parser's error
        raise QueryRejectedError(f"not a single statement: {first_line(error)}") from error
    top, name = plan, plan.getClass().getSimpleName()
    while name in WRAPPERS:
        plan = plan.children().head() if plan.children().nonEmpty() else plan.innerChildren().head()
        name = plan.getClass().getSimpleName()
    if name not in SELECT_NODES:
        raise QueryRejectedError(f"only SELECT is allowed, not {name}")
    _check_node(top, {t.lower() for t in tables})


def query_select(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], max_rows: int) -> tuple[DataFrame, DataFrame]:
    """Run one SELECT over named tables, once; returns at most ``max_rows`` rows and a one-row table that says whether
    there were more.

    The tables are common table expressions around the query, over views of names that nobody else has, so views of the
    caller with the same names stay. ``max_rows`` + 1 rows are written to the shared folder.
    """
    check_select(spark, sql, tables)
    views = {name: f"q_{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(views[name])
    try:
        around = ", ".join(f"{quoted(name)} AS (SELECT * FROM {view})" for name, view in views.items())
        inner = sql.strip().rstrip(";")
        result = spark.sql(f"WITH {around} SELECT * FROM ({inner}\n)" if tables else inner)
        found = materialize(result.limit(max_rows + 1), "query")
    except ParseException as error:
        raise QueryRejectedError(first_line(error)) from error
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    more = found.agg((F.count(F.lit(1)) > max_rows).alias("truncated"))
    return found.limit(max_rows), more
