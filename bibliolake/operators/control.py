"""Control rules as data: limits over batches, attempts, statuses, gates, caches, page states."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from bibliolake.functions.clean import JOURNAL_CHARS, TITLE_CHARS, verifiable_year
from bibliolake.functions.text import casefold, nfkc, strip

# Statuses, retries, intervals in seconds, words of pages.
DONE = ["success", "no_results"]
MOST_RETRIES = 3
GATE_SECONDS, CACHE_SECONDS, CACHE_ENTRIES = 6, 86_400, 1_024
THROTTLE_SECONDS, BACK_OFF_SECONDS = 30, 180
NOTHING_FOUND = "未检索到相关文献"
NO_DATA = ["暂无数据", "稍后重试"]
FORBIDDEN_WORDS = ["401 unauthorized", "403 forbidden", "无权访问", "拒绝访问"]
LIMITED_WORDS = ["429 too many requests", "访问过于频繁", "操作频繁"]
LOGIN_WORDS = ["用户登录", "统一身份认证"]
CHALLENGE_WORDS = ["验证码", "安全验证", "拼图验证"]
# The kind of document and the database of a record that a checkpoint may hold.
WANTED_KIND, WANTED_DATABASE = "期刊", "CNKI"
# What a stored text may not contain, and what a path begins with.
NEVER_STORED = ["su %=", "ly=", "ye between", "http://", "https://", "://", "cookie"]
PATH_SIGNS, PATH_NAMES = ["/", "\\", "~"], ["$home", "${home}", "%userprofile%"]


def batches_until_limit(items: DataFrame, run: list[str], batch: str, item: str, qualified: str, limit: int) -> DataFrame:
    """(run, batch, new_items, total): the batches that a run needs, up to the first with which the
    distinct qualified items reach limit. An item counts in the first batch that has it."""
    batches = items.select(*run, batch).distinct()
    first = items.filter(F.col(qualified)).groupBy(*run, item).agg(F.min(batch).alias(batch))
    new = first.groupBy(*run, batch).agg(F.count(F.lit(1)).alias("new_items"))
    w = W.partitionBy(*run).orderBy(batch)
    rows = batches.join(new, [*run, batch], "left").na.fill(0, ["new_items"])
    rows = rows.withColumn("total", F.sum("new_items").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter(F.col("total") - F.col("new_items") < limit)


def run_outcomes(attempts: DataFrame, run: list[str], resumed: DataFrame | None = None, stops: DataFrame | None = None) -> DataFrame:
    """(run, completed, batches, stopped_at, terminal_status, limit_reached, intervention) from a log
    (run, batch, attempt, status).

    A batch is done at its first success or empty result, or if a checkpoint has it (resumed: run,
    batch; its attempts then do not count); a challenge may be retried MOST_RETRIES times and a
    network error once, anything else stops. stops (run, batch) says after which batches the limit is
    reached: a run ends with the first such batch that a checkpoint has or that succeeded, without a
    terminal status; else before its first batch that is not done. intervention: a challenge was met.
    """
    keys = [*run, "batch"]
    if resumed is not None:
        resumed = resumed.select(*keys).distinct()
        attempts = attempts.join(resumed, keys, "left_anti")
    w = W.partitionBy(*keys).orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    before = {s: F.coalesce(F.count_if(F.col("status") == s).over(w), F.lit(0)) for s in ("challenge", "network_error")}
    over = F.coalesce(F.max(F.col("status").isin(DONE) | ~F.col("status").isin("challenge", "network_error")).over(w), F.lit(False))
    valid = attempts.withColumn("_c", before["challenge"]).withColumn("_e", before["network_error"]).withColumn("_over", over)
    valid = valid.filter(~F.col("_over") & (F.col("_c") <= MOST_RETRIES) & (F.col("_e") <= 1))
    per = valid.groupBy(*keys).agg(F.max(F.col("status").isin(DONE)).alias("done"), F.max_by("status", "attempt").alias("last"), F.max(F.col("status") == "challenge").alias("_met"))
    if resumed is not None:
        per = per.unionByName(resumed.select(*keys, F.lit(True).alias("done"), F.lit("success").alias("last"), F.lit(False).alias("_met")))
    if stops is None:
        per = per.withColumn("_stop", F.lit(False))
    else:
        per = per.join(stops.select(*keys).distinct().withColumn("_stop", F.lit(True)), keys, "left").withColumn("_stop", F.coalesce("_stop", F.lit(False)) & (F.col("last") == "success"))
    # a run ends where a batch fails or the limit is reached, whichever comes first
    fails, limits = F.when(~F.col("done"), F.col("batch")), F.when(F.col("_stop"), F.col("batch"))
    ends = per.groupBy(*run).agg(F.min(fails).alias("_fail"), F.min(limits).alias("_limit"), F.count(F.lit(1)).alias("batches"), F.min_by("last", fails).alias("_last"))
    limited = F.coalesce(F.col("_limit") < F.col("_fail"), F.col("_limit").isNotNull())
    ends = ends.withColumn("limit_reached", limited).withColumn("stopped_at", F.when(~limited, F.col("_fail"))).withColumn("terminal_status", F.when(~limited, F.col("_last")))
    seen = per.join(ends.select(*run, "limit_reached", "_limit", "_fail"), run)
    within = F.when(F.col("limit_reached"), F.col("batch") <= F.col("_limit")).otherwise(F.col("_fail").isNull() | (F.col("batch") <= F.col("_fail")))
    n = seen.groupBy(*run).agg(F.count_if(within & F.col("done")).alias("completed"), F.coalesce(F.max(within & F.col("_met")), F.lit(False)).alias("intervention"))
    return ends.join(n, run).select(*run, "completed", "batches", "stopped_at", "terminal_status", "limit_reached", "intervention")


def batch_totals(results: DataFrame, run: list[str]) -> DataFrame:
    """(run, records, facet_applied, category_total) over a run's results (batch, records, applied,
    category_total): sums; whether the facet held in all, false without results; the first total."""
    return results.groupBy(*run).agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.bool_and("applied"), F.lit(False)).alias("facet_applied"),
        F.min_by("category_total", F.when(F.col("category_total").isNotNull(), F.col("batch"))).alias("category_total"),
    )


def derived_status(terminal: Column, answered: Column, complete: Column, incomplete: Column) -> Column:
    """The status of a merged search from its parts."""
    return (
        F.when(terminal.isNotNull() & ~answered, terminal)
        .when(terminal.isNotNull(), "partial")
        .when(incomplete > 0, "partial")
        .when(complete > 0, "success")
        .otherwise("no_results")
    )


#: Requests of a gate are put in order within spans of this length, and the spans among themselves.
SPAN_SECONDS = 3_600


def _starts(requests: DataFrame, gate: list[str], arrival: str, order: list[str], wait: Column) -> tuple[DataFrame, WindowSpec]:
    """requests with _t and start, when each must wait for so long after the start of the one before it,
    and the window of their order within a span. With S_i the sum of the waits before i, start_i is S_i + max over
    j <= i of (t_j - S_j). Sums and maxima of spans of time are found first, then carried from span
    to span, so that a gate of very many requests is never put in order as a whole."""
    t = F.unix_micros(F.col(arrival))
    rows = requests.withColumn("_t", t).withColumn("_w", wait).withColumn("_span", F.floor(t / (SPAN_SECONDS * 1_000_000)))
    w = W.partitionBy(*gate, "_span").orderBy(arrival, *order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    up_to = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    rows = rows.withColumn("_m", F.max(F.col("_t") - F.col("_s")).over(up_to))
    spans = rows.groupBy(*gate, "_span").agg(F.sum("_w").alias("_sum"), F.max("_m").alias("_most"))
    earlier = W.partitionBy(*gate).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    spans = spans.withColumn("_carried", F.max(F.col("_most") - F.col("_offset")).over(earlier))
    keys = [*gate, "_span"]
    known = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_offset", "_carried")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = rows.join(known, same).drop(*[f"_k{i}" for i in range(len(keys))])
    most = F.greatest("_carried", F.col("_m") - F.col("_offset"))
    return both.withColumn("start", F.col("_offset") + F.col("_s") + most), w


def gate_starts(requests: DataFrame, gate: list[str], arrival: str, order: list[str], seconds: int = GATE_SECONDS) -> DataFrame:
    """requests with start and delay, in whole microseconds, when a gate lets one through every so many
    seconds."""
    step = F.lit(seconds * 1_000_000).cast("long")
    rows, w = _starts(requests, gate, arrival, order, step)
    previous = F.coalesce(F.lag("start").over(w), F.col("_offset") - step + F.col("_carried"))
    rows = rows.withColumn("delay", F.col("start") - F.greatest("_t", F.coalesce(previous, F.col("_t"))))
    return rows.select(*requests.columns, "start", "delay")


def throttled_starts(
    requests: DataFrame, gate: list[str], arrival: str, order: list[str], challenged: str, seconds: int = THROTTLE_SECONDS, back_off: int = BACK_OFF_SECONDS
) -> DataFrame:
    """requests with start and delay in microseconds, when each waits for the one before it by so many
    seconds, and longer after a challenge."""
    wait = (F.lit(seconds) + F.when(F.col(challenged), back_off).otherwise(0)).cast("long") * 1_000_000
    rows, _ = _starts(requests, gate, arrival, order, wait)
    return rows.withColumn("delay", F.col("start") - F.col("_t")).select(*requests.columns, "start", "delay")


def cache_key(c: Column) -> Column:
    """Words of a query, case folded, one space between."""
    return F.trim(F.regexp_replace(casefold(nfkc(c)), r"(?U)\s+", " "))


def cache_hits(requests: DataFrame, keys: list[str], ident: str, at: str, seconds: int = CACHE_SECONDS, storable: str | None = None) -> DataFrame:
    """(ident, hit): whether a result stored at an earlier miss of the same key is still alive; a hit
    does not prolong it. storable says of a request whether its result may be stored (all may if none
    is given): a miss without that stores nothing.

    Where no request of a key comes for as long as a result lives, the next one is a miss whatever
    came before, so a key's requests fall apart there and the parts are placed on their own. The gaps
    come from the first and last time of each span of that length: at least one span's border lies in
    every gap. A task streams over its parts in order of time and remembers one time only. A part
    without such a gap, however long, stays one stream.
    """
    life = seconds * 1_000_000
    may = F.lit(True) if storable is None else F.coalesce(F.col(storable), F.lit(False))
    rows = requests.select(F.sha2(F.concat_ws("\x1f", *keys), 256).alias("_k"), F.unix_micros(F.col(at)).alias("_t"), F.col(ident).cast("long").alias("_i"), may.alias("_may"))
    rows = rows.withColumn("_span", F.floor(F.col("_t") / life))
    spans = rows.groupBy("_k", "_span").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    w = W.partitionBy("_k").orderBy("_span")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(w) >= life, F.lit(False))
    # a gap inside two spans that both have requests lies between the first's last and the second's first
    parts = spans.withColumn("_part", F.sum(fresh.cast("int")).over(w)).select("_k", "_span", "_part")
    placed = rows.join(parts, ["_k", "_span"]).drop("_span")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stored = None, 0
        for b in batches:
            hits = []
            for k, p, t, may in zip(b["_k"], b["_part"], b["_t"], b["_may"]):
                alive = (k, p) == key and t < stored + life
                hits.append(alive)
                if not alive:
                    key, stored = (k, p), t if may else t - life
            yield pd.DataFrame({"ident": b["_i"], "hit": hits})

    return placed.repartition("_k", "_part").sortWithinPartitions("_k", "_part", "_t", "_i").select("_k", "_part", "_t", "_i", "_may").mapInPandas(stream, "ident long, hit boolean")


def bounded_cache_hits(requests: DataFrame, keys: list[str], ident: str, at: str, seconds: int = CACHE_SECONDS, entries: int = CACHE_ENTRIES) -> DataFrame:
    """(ident, hit) as cache_hits for one cache of so many entries, which drops the one used longest
    ago. That is one order over all requests, so one task streams them and holds the entries only;
    split a log by cache before."""
    key = F.sha2(F.concat_ws("\x1f", *keys), 256)
    rows = requests.select(key.alias("_k"), F.unix_micros(F.col(at)).alias("_t"), F.col(ident).cast("long").alias("_i"))
    life = seconds * 1_000_000

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stored: OrderedDict[str, int] = OrderedDict()
        for b in batches:
            hits = []
            for k, t in zip(b["_k"], b["_t"]):
                alive = k in stored and t < stored[k] + life
                hits.append(alive)
                if not alive:
                    # an entry that has expired gives way before one that has not
                    for other in [x for x, s in stored.items() if t >= s + life] if len(stored) >= entries else []:
                        del stored[other]
                    stored[k] = t
                stored.move_to_end(k)
                while len(stored) > entries:
                    stored.popitem(last=False)
            yield pd.DataFrame({"ident": b["_i"], "hit": hits})

    return rows.repartition(1).sortWithinPartitions("_t", "_i").mapInPandas(stream, "ident long, hit boolean")


def page_state(
    status: Column, host: Column, path: Column, title: Column, text: Column, has_table: Column, *, result_host: str, result_path: str, login_host: str
) -> Column:
    """What a fetched page is, by codes, address, title and text in this order."""

    def any_of(c: Column, words: list[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | c.contains(w)
        return F.coalesce(hit, F.lit(False))

    host, path, low = F.coalesce(F.lower(host), F.lit("")), F.coalesce(F.lower(path), F.lit("")), casefold(F.coalesce(text, F.lit("")))
    head = casefold(F.coalesce(title, F.lit("")))
    return (
        F.when(status.isin(401, 403), "forbidden")
        .when(status == 429, "rate_limited")
        .when(status.between(500, 599), "network_error")
        .when(path.contains("/verify/") | path.contains("captcha") | any_of(head, CHALLENGE_WORDS), "challenge_detected")
        .when((host == login_host) | path.contains("authserver"), "login_required")
        .when((host == result_host) & path.startswith(result_path) & has_table, "success")
        .when(~has_table & F.coalesce(text, F.lit("")).contains(NOTHING_FOUND), "no_results")
        .when(~has_table & any_of(low, FORBIDDEN_WORDS), "forbidden")
        .when(~has_table & any_of(low, LIMITED_WORDS), "rate_limited")
        .when(~has_table & any_of(low, LOGIN_WORDS), "login_required")
        .otherwise("page_contract_changed")
    )


def outcome_state(has_table: Column, text: Column, challenge_visible: Column) -> Column:
    """What a submitted page came to: a table, nothing found, no data for now, a challenge, or unknown."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    no_data = F.lit(True)
    for w in NO_DATA:
        no_data = no_data & flat.contains(w)
    return (
        F.when(has_table, "success")
        .when(flat.contains(NOTHING_FOUND), "no_results")
        .when(no_data, "no_data_retry_later")
        .when(challenge_visible, "challenge_detected")
        .otherwise("page_contract_changed")
    )


def storable_text(c: Column, most: int) -> Column:
    """A text that a checkpoint may keep, in compatibility form without control characters, cut to
    most characters; null if it has a search expression, an address, a cookie, markup, or begins
    like a path. Null stays null, an empty text empty."""
    text = strip(F.regexp_replace(nfkc(c), r"[\p{Cc}\p{Cf}]", ""))
    low = casefold(text)

    def drive(x: Column) -> Column:
        return x.rlike(r"^\p{L}:[\\/]")

    bad = (text.contains("<") & text.contains(">")) | drive(text)
    for words in NEVER_STORED:
        bad = bad | low.contains(words)
    for sign in PATH_SIGNS:
        bad = bad | text.startswith(sign)
    for name in PATH_NAMES:
        bad = bad | low.startswith(name)
    # the scheme of a local file, even with spaces in it
    target = strip(F.substring(low, F.instr(low, F.lit(":")) + 1, F.length(low)))
    is_file = F.regexp_replace(F.substring_index(low, ":", 1), r"(?U)\s", "") == "file"
    bad = bad | (low.contains(":") & is_file & (target.startswith("/") | target.startswith("\\") | drive(target)))
    return F.when(~bad, strip(F.substring(text, 1, most)))


def keep_whole_batches(rows: DataFrame, batch: list[str], valid: Column) -> DataFrame:
    """The batches of which every row is valid; one bad row drops its batch."""
    good = rows.groupBy(*batch).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("_ok")).filter("_ok").drop("_ok")
    return rows.join(good, batch, "left_semi")


def valid_record(formal: Column, as_of_year: int) -> Column:
    """Whether a checkpoint may hold a record (title, journal_raw, publication_date, document_type,
    source_database, authors, publication_year, citations, downloads, result_rank, is_online_first):
    texts there and storable, of the wanted kind and database, counts and rank not negative, and
    complete exactly if it is formal. Never null."""
    c = F.col
    texts = F.lit(True)
    for name, most in (("title", TITLE_CHARS), ("journal_raw", JOURNAL_CHARS), ("publication_date", 10_000)):
        texts = texts & storable_text(c(name), most).isNotNull()
    # the names of a list go through one text, so one bad name spoils all; a path begins a name, not the list
    names = F.transform("authors", lambda x: F.coalesce(x, F.lit("<>")))
    listed = c("authors").isNotNull() & storable_text(F.array_join(names, " "), 1_000_000).isNotNull() & ~F.exists("authors", lambda x: x.rlike(r"(?i)^\s*(?:[/\\~]|\$home|\$\{home\}|%userprofile%|\p{L}:[\\/])"))
    counts = F.coalesce(c("citations") >= 0, F.lit(True)) & F.coalesce(c("downloads") >= 0, F.lit(True)) & (c("result_rank") >= 0) & c("is_online_first").isNotNull()
    complete = (strip(c("title")) != "") & (strip(c("journal_raw")) != "") & verifiable_year(c("publication_year"), as_of_year)
    ok = texts & listed & (c("document_type") == WANTED_KIND) & (c("source_database") == WANTED_DATABASE) & counts & complete.eqNullSafe(formal)
    return F.coalesce(ok, F.lit(False))


def valid_batches(results: DataFrame, records: DataFrame, batch: list[str], *, as_of_year: int) -> DataFrame:
    """The batches (batch, status, total_rows, excluded) of a checkpoint that may be resumed. Of records
    (batch, formal, and the fields of valid_record) none may be invalid; a batch must be a success
    or an empty result, with counts that are not negative and hold what they count; an empty result
    has no rows at all. One bad record drops its whole batch."""
    per = records.groupBy(*batch).agg(F.count(F.lit(1)).alias("_n"), F.bool_and(valid_record(F.col("formal"), as_of_year)).alias("_ok"))
    both = results.join(per, batch, "left").na.fill(0, ["_n"]).withColumn("_ok", F.coalesce("_ok", F.lit(True)))
    c = F.col
    sums = (c("total_rows") >= 0) & (c("excluded") >= 0) & (c("excluded") + c("_n") <= c("total_rows"))
    empty = (c("status") != "no_results") | ((c("total_rows") == 0) & (c("excluded") == 0) & (c("_n") == 0))
    return both.filter(F.coalesce(c("_ok") & c("status").isin(DONE) & sums & empty, F.lit(False))).select(*results.columns)
