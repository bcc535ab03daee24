"""Request intake, validation, listing, lookup, deletion, settings upsert and
status events — the data side of the analysed service, as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codedelta.rules import ACCEPTED_LANGUAGES, MAX_FILE_BYTES, MAX_FILES, SOURCE_TYPES, UPLOAD_EXTENSIONS

INVALID_TYPE_MESSAGE = "Invalid file type. Only source code files are allowed."
LANGUAGE_MESSAGE = '"language" must be one of [' + ", ".join(ACCEPTED_LANGUAGES) + "]"


def uri_pattern(possessive: bool = False) -> str:
    """A URI: scheme, authority or path, query and fragment of the characters that RFC 3986 allows.  Possessive for Java, whose matcher
    calls itself for every repeat of a plain group."""
    many, some = ("*+", "++") if possessive else ("*", "+")
    char = r"(?:[A-Za-z0-9._~!$&'()*+,;=:@-]|%[0-9A-Fa-f][0-9A-Fa-f])"
    host = r"(?:[A-Za-z0-9._~!$&'()*+,;=:@-]|%[0-9A-Fa-f][0-9A-Fa-f]|\[[0-9A-Fa-f:.]+\])"
    path = f"(?:/{char}{many}){many}"
    rest = f"(?:{char}|[/?]){many}"
    return (f"^[A-Za-z][A-Za-z0-9+.-]{many}:(?://{host}{many}{path}|/(?:{char}{some}{path})?|{char}{some}{path})"
            rf"(?:\?{rest})?(?:#{rest})?$")


def is_uri(c: Column) -> Column:
    return c.rlike(uri_pattern(possessive=True))


def request_errors(language: Column, sides: list[tuple[str, Column, Column, Column]]) -> Column:
    """array<string> of validation messages (empty when valid).

    ``sides`` holds (side name, type, content, url); content is required when
    the type is paste, url when it is repo."""
    checks = [F.when(language.isNull() | ~language.isin(ACCEPTED_LANGUAGES), F.lit(LANGUAGE_MESSAGE))]
    for name, typ, content, url in sides:
        checks += [
            F.when(typ.isNull() | ~typ.isin(SOURCE_TYPES),
                   F.lit(f'"{name}.type" must be one of [' + ", ".join(SOURCE_TYPES) + "]")),
            F.when((typ == "paste") & (content.isNull() | (content == "")), F.lit(f'"{name}.content" is required')),
            F.when((typ == "repo") & (url.isNull() | (url == "")), F.lit(f'"{name}.url" is required'))
             .when((typ == "repo") & ~is_uri(url), F.lit(f'"{name}.url" must be a valid uri')),
        ]
    return F.array_compact(F.array(*checks))


def validate(requests: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Split requests into (accepted, quarantine with ``message``)."""
    r = requests.withColumn("_errors", errors)
    ok = r.filter(F.size("_errors") == 0).drop("_errors")
    bad = r.filter(F.size("_errors") > 0).withColumn("message", F.array_join("_errors", ", ")).drop("_errors")
    return ok, bad


def domain_violations(df: DataFrame, key: str, enums: dict[str, list[str]] | None = None,
                      ranges: dict[str, tuple[float, float]] | None = None,
                      required: list[str] | None = None, unique: list[str] | None = None) -> DataFrame:
    """(key, column, rule) rows for every enum / range / required / unique violation; null keys and tied rows each for themselves.

    Enum, range and required rules are tested in the row, in one scan whatever their number.  All unique columns are counted in
    one aggregation over (column, 128-bit value key), and only the repeated values are joined back."""
    checks = [(c, "enum", F.col(c).isNotNull() & ~F.col(c).isin(allowed)) for c, allowed in (enums or {}).items()]
    checks += [(c, "range", ~F.col(c).between(lo, hi)) for c, (lo, hi) in (ranges or {}).items()]
    checks += [(c, "required", F.col(c).isNull()) for c in required or []]
    broken = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"))) for c, rule, cond in checks]))
    found = df.select(F.col(key).alias(key), F.inline(broken)) if checks else None
    if unique:
        values = df.select(F.col(key).alias(key), F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.md5(F.col(c).cast("string")).alias("value")) for c in unique]))).filter("value is not null")
        repeated = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        again = values.join(repeated, ["column", "value"], "left_semi").select(key, "column", F.lit("unique").alias("rule"))
        found = again if found is None else found.unionByName(again)
    if found is None:
        raise ValueError("no rules")
    return found


def violation_counts(violations: DataFrame, key: str) -> DataFrame:
    """(column, rule, n): violations per rule."""
    return violations.groupBy("column", "rule").agg(F.count(F.lit(1)).alias("n"))


def normalise_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def accept_uploads(files: DataFrame, request_col: str = "request_id", name_col: str = "path",
                   size_col: str = "length") -> tuple[DataFrame, DataFrame]:
    """(accepted files, rejected files with ``reasons``) of upload requests: a request with a file of another
    extension, a file above the size limit or too many files is rejected as a whole; no file is dropped."""
    ext = r"(?i)\.(" + "|".join(UPLOAD_EXTENSIONS) + r")$"
    why = files.groupBy(F.col(request_col).alias("_request")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col(name_col).rlike(ext), F.lit(False))).alias("bad"),
        F.count_if(F.col(size_col) > MAX_FILE_BYTES).alias("large"))
    why = why.select("_request", F.array_compact(F.array(
        F.when(F.col("bad") > 0, F.lit(INVALID_TYPE_MESSAGE)),
        F.when(F.col("large") > 0, F.lit("File too large")),
        F.when(F.col("n") > MAX_FILES, F.lit("Too many files")))).alias("reasons"))
    j = files.join(why, F.col(request_col).eqNullSafe(F.col("_request"))).drop("_request")
    return j.filter(F.size("reasons") == 0).drop("reasons"), j.filter(F.size("reasons") > 0)


def page(df: DataFrame, order: list[Column], page_no: int, limit: int) -> DataFrame:
    """One page of a sorted listing (top-k: sort, skip, limit)."""
    return df.orderBy(*order).offset((page_no - 1) * limit).limit(limit)


def seek_page(df: DataFrame, order: list[tuple[str, bool]], last: tuple | None, limit: int) -> DataFrame:
    """The page that follows the row with the key ``last`` (None: the first page), without touching the pages before it.

    ``order`` holds (column, descending); the columns are not null and their values together unique.  The plan is a filter and a
    top-k, so its cost does not grow with the page number, and rows that arrive on earlier pages shift nothing."""
    if last is not None:
        after = F.lit(False)
        for i, (name, desc) in enumerate(order):
            here = F.col(name) < F.lit(last[i]) if desc else F.col(name) > F.lit(last[i])
            for (before, _), value in zip(order[:i], last):
                here = (F.col(before) == F.lit(value)) & here
            after = after | here
        df = df.filter(after)
    return df.orderBy(*[F.desc(c) if desc else F.asc(c) for c, desc in order]).limit(limit)


def page_bounds(df: DataFrame, ts: str, key: str, limit: int, width: str = "HOUR") -> DataFrame:
    """(page, first_ts, first_key, last_ts, last_key, n) of every page of the listing by (ts descending, key): the keys that
    ``seek_page`` continues from.

    Two levels instead of one sort of all rows: rows are counted by time bucket (``width``: a unit of ``timestampdiff``), the
    counts of the later buckets are summed over the few buckets, and only the rows of a bucket are ranked together."""
    bucket = F.expr(f"timestampdiff({width}, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    rows = df.select(F.col(ts).alias("ts"), F.col(key).alias("key"), bucket.alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("bucket").alias("b"), F.coalesce(F.sum("rows").over(later), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("ts"), "key"))
    ranked = rows.withColumn("in_bucket", rank).join(counts, F.col("bucket") == F.col("b"))
    place = F.col("before") + F.col("in_bucket")
    ranked = ranked.select("ts", "key", place.alias("place"), (F.floor((place - 1) / limit) + 1).cast("long").alias("page"))
    row = F.struct("ts", "key")
    return ranked.groupBy("page").agg(F.min_by(row, "place").alias("f"), F.max_by(row, "place").alias("l"), F.count(F.lit(1)).alias("n")).select(
        "page", F.col("f.ts").alias("first_ts"), F.col("f.key").alias("first_key"), F.col("l.ts").alias("last_ts"), F.col("l.key").alias("last_key"), "n")


def write_results(results: DataFrame, path: str, batch_id: int, completed_at: Column | None = None, started: str = "submitted_at") -> None:
    """Write a batch of results at ``path``, partitioned by language and batch.

    Rows gain completed_at (null unless completed; default: now) and processing_ms since ``started``.  Overwriting is dynamic: a
    batch that runs again replaces its own partitions and leaves all others.  Rows are rebalanced by language, which adaptive execution
    splits where one language holds most of them."""
    done = F.col("status") == "completed"
    when = F.localtimestamp() if completed_at is None else completed_at
    out = results.withColumn("completed_at", F.when(done, when)).withColumn(
        "processing_ms", F.expr(f"timestampdiff(MICROSECOND, `{started}`, completed_at)") / 1000.0).withColumn("batch_id", F.lit(batch_id).cast("long"))
    (out.hint("rebalance", "language").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("language", "batch_id").parquet(path))


def read_results(spark, path: str, schema) -> DataFrame:
    """The results at ``path`` (``schema``: that of the results before they were written); a language or batch prunes partitions."""
    extra = T.StructType([T.StructField("completed_at", T.TimestampNTZType()), T.StructField("processing_ms", T.DoubleType()),
                          T.StructField("batch_id", T.LongType())])
    return spark.read.schema(T.StructType(schema.fields + extra.fields)).parquet(path)


def page_envelope(df: DataFrame, limit: int) -> DataFrame:
    """total and pages = ceil(total / limit)."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(limit)).cast("long").alias("pages"))


def lookup(report: DataFrame, ids: DataFrame, key: str = "pair_id") -> DataFrame:
    """Rows for the given ids; results only when completed, error only when failed."""
    r = report.join(ids, key, "left_semi")
    return r.select(key, "status", "language",
                    F.when(F.col("status") == "completed", F.col("overall_score")).alias("overall_score"),
                    F.when(F.col("status") == "completed", F.col("summary")).alias("summary"),
                    F.when(F.col("status") == "failed", F.col("error_message")).alias("error_message"))


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """(remaining rows, ids not found) — a snapshot rewrite keeps ``remaining``."""
    remaining = table.join(ids, key, "left_anti")
    not_found = ids.join(table.select(key), key, "left_anti")
    return remaining, not_found


def upsert_latest(current: DataFrame, updates: DataFrame, key: str, ts: str) -> DataFrame:
    """Latest row per key from a snapshot plus updates (insert or replace)."""
    allr = current.unionByName(updates)
    best = allr.groupBy(key).agg(F.max_by(F.struct(*allr.columns), F.col(ts)).alias("r"))
    return best.select("r.*")


def status_events_from(events: DataFrame) -> DataFrame:
    """Status events derived from an event table: signup and view -> pending, click ->
    processing, purchase -> completed, error -> failed; an unknown type is no status event."""
    m = {"signup": "pending", "view": "pending", "click": "processing", "purchase": "completed", "error": "failed"}
    status = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    languages = F.array(*[F.lit(x) for x in ACCEPTED_LANGUAGES])
    language = F.element_at(languages, (F.pmod("user_id", F.lit(len(ACCEPTED_LANGUAGES))) + 1).cast("int"))
    return events.withColumn("language", language).select(F.col("user_id").alias("analysis_id"), status.alias("status"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "language") \
        .filter(F.col("status").isNotNull())


#: What may follow a status; a finished analysis may be submitted again.
NEXT_STATUS = {"pending": ["processing", "failed"], "processing": ["completed", "failed"], "completed": ["pending"], "failed": ["pending"]}


def illegal_transitions(status_events: DataFrame) -> DataFrame:
    """(analysis_id, seq, ts, previous, status): events whose status may not follow the one before them, in (ts, seq) order.

    A status that repeats is no transition; the first event of an analysis must be pending (previous is null)."""
    own = Window.partitionBy("analysis_id").orderBy("ts", "seq")
    legal = [(F.col("previous") == a) & F.col("status").isin(*b) for a, b in NEXT_STATUS.items()]
    ok = F.col("previous").isNull() & (F.col("status") == "pending")
    for c in legal:
        ok = ok | F.coalesce(c, F.lit(False))
    return (status_events.withColumn("previous", F.lag("status").over(own))
            .filter(~ok & ~F.col("previous").eqNullSafe(F.col("status")))
            .select("analysis_id", "seq", "ts", "previous", "status"))


def latest_status(status_events: DataFrame) -> DataFrame:
    """Latest status per analysis by (ts, seq) — a partial aggregation (max_by)."""
    return status_events.groupBy("analysis_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("last_ts"))


def analysis_times(status_events: DataFrame) -> DataFrame:
    """Per analysis: latest status, its time, its language if the events have one, and the milliseconds from the first
    pending to the last terminal event, all in one partial aggregation."""
    last = F.struct("ts", "seq")
    language = F.max_by("language", last) if "language" in status_events.columns else F.lit(None).cast("string")
    g = status_events.groupBy("analysis_id").agg(
        F.max_by("status", last).alias("status"), F.max("ts").alias("last_ts"), language.alias("language"),
        F.min(F.when(F.col("status") == "pending", F.col("ts"))).alias("started"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col("ts"))).alias("finished"))
    ms = (F.unix_micros("finished") - F.unix_micros("started")) / 1000.0
    return g.select("analysis_id", "status", "last_ts", "language", ms.alias("processing_ms"))


def status_rollup(status_events: DataFrame) -> DataFrame:
    """Count and mean processing time per latest status and language."""
    return analysis_times(status_events).groupBy("status", "language").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("processing_ms"), 3).alias("avg_processing_ms"))


def over_limit(requests: DataFrame, key: str, ts: str, window: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` requests in a fixed (tumbling) window."""
    g = requests.groupBy(F.col(key), F.window(F.col(ts), window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") > limit).select(key, F.col("w.start").alias("window_start"), "n")

