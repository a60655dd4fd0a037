"""Work that moves through states: queues, batches, budgets and the logs that tell what was done."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: The states of a job that is under way, and the moves that are allowed.
OPEN = ("uploaded", "validated", "submitted", "rejected", "confirmed", "running", "failed")
MOVES = {
    "validate": (("uploaded",), "validated"),
    "reject": (("uploaded",), "rejected"),
    "submit": (("validated",), "submitted"),
    "confirm": (("validated", "submitted"), "confirmed"),
    "start": (("confirmed",), "running"),
    "finish": (("running",), "done"),
    "fail": (("running",), "failed"),
    "retry": (("failed",), "confirmed"),
    "decline": (("submitted",), "declined"),
    "discard": (("uploaded", "validated", "submitted", "rejected", "failed"), "discarded"),
    "roll_back": (("done",), "rolled_back"),
}


def queue_status(flagged: Column, kind: Column, status: Column) -> Column:
    """accepted > in_progress > done or still_flagged > flagged."""
    done = F.when(flagged, "still_flagged").otherwise("done")
    return F.when(kind.eqNullSafe(F.lit("accept")), "accepted").when(F.coalesce(status.isin(*OPEN), F.lit(False)), "in_progress").when(status.eqNullSafe(F.lit("done")), done).otherwise("flagged")


def moved(jobs: DataFrame, move: Column) -> DataFrame:
    """Applies a move to each job: the new status, or an error where the move is not allowed from the old one."""
    allowed = F.lit(False)
    to = F.lit(None).cast("string")
    for name, (sources, target) in MOVES.items():
        fits = move.eqNullSafe(F.lit(name)) & F.coalesce(F.col("status").isin(*sources), F.lit(False))
        allowed, to = allowed | fits, F.when(fits, target).otherwise(to)
    error = F.when(~allowed, F.concat(F.lit("cannot "), F.coalesce(move, F.lit("?")), F.lit(" from "), F.coalesce("status", F.lit("?"))))
    return jobs.withColumn("error", error).withColumn("status", F.when(allowed, to).otherwise(F.col("status")))


def folded_status(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The status of each key after its moves in order, moves that are not allowed left out; starts at uploaded.

    A job has a handful of moves, folded as one array.
    """
    entry = F.struct(*order, "move")
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("m"))

    def step(s: Column, x: Column) -> Column:
        out = s
        for name, (sources, target) in MOVES.items():
            out = F.when((x["move"] == name) & s.isin(*sources), F.lit(target)).otherwise(out)
        return out

    return listed.select(key, F.aggregate("m", F.lit("uploaded"), step).alias("status"))


def units(jobs: DataFrame) -> DataFrame:
    """Confirmed jobs as units of work: a rollback alone, a retried transaction, a batch of a book, a single job."""
    key = F.when(F.col("kind") == "rollback", F.concat(F.lit("rb:"), "id")).when(F.col("txn").isNotNull(), F.concat(F.lit("txn:"), "txn")).when(F.col("batch").isNotNull(), F.concat(F.lit("b:"), "book", F.lit(":"), "batch")).otherwise(F.concat(F.lit("j:"), "id"))
    grouped = jobs.groupBy(key.alias("unit"), "book").agg(F.count("*").alias("jobs"), F.round(F.sum(F.coalesce("estimate", F.lit(0.0))), 4).alias("estimate"), F.min(F.struct("created", "id")).alias("first"), F.array_sort(F.collect_list("page")).alias("pages"))
    return grouped.withColumn("created", F.col("first.created")).drop("first")


def undone(log: DataFrame) -> DataFrame:
    """page, version of retakes that a rollback restored the page from."""
    back = log.filter("action = 'rollback'").select("page", F.col("restored").alias("version"))
    return log.filter("action = 'retake'").join(back, ["page", "version"], "left_semi").select("page", "version").distinct()


def replaced_pages(log: DataFrame, since: str | None = None) -> DataFrame:
    """Distinct pages with a retake after a time that no rollback has undone."""
    after = F.lit(True) if since is None else F.col("at") > F.lit(since).cast("timestamp")
    live = log.filter("action = 'retake'").filter(after).join(undone(log), ["page", "version"], "left_anti")
    return live.agg(F.countDistinct("page").alias("pages"))


def rollback_targets(log: DataFrame) -> DataFrame:
    """The latest retake of each page that no rollback has undone."""
    live = log.filter("action = 'retake'").join(undone(log), ["page", "version"], "left_anti")
    w = Window.partitionBy("page").orderBy(F.desc("seq"))
    return live.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def parsed_lines(lines: DataFrame, marker: str = "::retake::", column: str = "line") -> DataFrame:
    """Output lines of a subprocess: events (JSON behind the marker) and log lines; blank lines go, broken events are log."""
    body = F.trim(F.substring(F.col(column), F.lit(len(marker) + 1), F.length(column)))
    event = F.when(F.col(column).startswith(marker), F.try_parse_json(body))
    return lines.filter(F.length(F.trim(column)) > 0).withColumn("kind", F.when(event.isNotNull(), "event").otherwise("log")).withColumn("body", F.when(event.isNotNull(), body).otherwise(F.col(column)))


def guarded_admins(users: DataFrame) -> DataFrame:
    """Marks the users (id, team, role, disabled, actor) that cannot be demoted, disabled or deleted: the only active
    administrator of a team, and the one who acts."""
    active = (F.col("role") == "admin") & ~F.col("disabled")
    n = F.sum(active.cast("int")).over(Window.partitionBy("team"))
    return users.withColumn("guarded", (active & (n <= 1)) | F.coalesce(F.col("id") == F.col("actor"), F.lit(False)))


#: What counts as open in the view of a queue.
OPEN_STATUS = ("flagged", "still_flagged", "in_progress")


def shown(items: DataFrame, books: list | None, issue: str | None, status: str | None, page: str, descending: bool = False) -> DataFrame:
    """The items (book, status, issues, and a page column) that a view with these filters shows, with their place in each book."""
    if books:
        items = items.filter(F.col("book").isin(*books))
    if issue:
        items = items.filter(F.array_contains("issues", issue))
    if status:
        items = items.filter(F.col("status").isin(*OPEN_STATUS) if status == "open" else F.col("status") == status)
    order = F.desc(page) if descending else F.asc(page)
    return items.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy(order)).cast("long"))


#: What a worker looks for, in this order; it does the first kind of work that there is.
STEPS = ("requeue", "abandon", "validate", "run")


def next_work(jobs: DataFrame, locked: DataFrame, claimed: DataFrame, by: list[str]) -> DataFrame:
    """The jobs that the next tick of each worker takes up, and the step it takes: by, id, step.

    jobs: id, kind, status, txn, stage, book, created and the columns ``by`` that deal them to workers. First come jobs of
    stopped workers (running, with a transaction, their book not in ``locked``), then discarded transactions that are not
    yet abandoned and hold no other job, then the oldest upload of a retake, then the jobs of ``claimed`` (id), those the
    budget admits. Ties of created go to the smallest id; jobs without a book belong to no lock.
    """
    jobs = jobs.select(*dict.fromkeys([*by, "id", "kind", "status", "txn", "stage", "book", "created"]))
    status, txn = F.col("status"), F.col("txn")
    at = lambda df, step: df.withColumn("step", F.lit(step))
    # Each step asks only for its own jobs, so that those without a book or a transaction, which may be most, meet in no task.
    stopped = jobs.filter((status == "running") & txn.isNotNull())
    requeue = stopped.filter("book is null").unionByName(stopped.filter("book is not null").join(locked.select("book").distinct(), "book", "left_anti").select(*jobs.columns))
    open_ = jobs.filter(txn.isNotNull() & ~status.eqNullSafe(F.lit("discarded"))).select("txn").distinct()
    dropped = jobs.filter((status == "discarded") & txn.isNotNull() & ~F.col("stage").eqNullSafe(F.lit("abandoned")))
    abandon = dropped.join(open_, "txn", "left_anti").select(*jobs.columns)
    validate = jobs.filter((status == "uploaded") & (F.col("kind") == "retake"))
    run = jobs.filter((status == "confirmed") & F.col("id").isNotNull()).join(claimed.select("id").distinct(), "id", "left_semi").select(*jobs.columns)
    rows = at(requeue, 0).unionByName(at(abandon, 1)).unionByName(at(validate, 2)).unionByName(at(run, 3))
    oldest = F.min(F.when(F.col("step") == 2, F.struct("created", "id")))
    names = {f"__worker{i}": c for i, c in enumerate(by)}
    first = rows.groupBy(*(F.col(c).alias(n) for n, c in names.items())).agg(F.min("step").alias("due"), oldest.alias("oldest"))
    same = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(c)) for n, c in names.items()))
    due = rows.join(first, same).filter((F.col("step") == F.col("due")) & ((F.col("step") != 2) | (F.col("id") == F.col("oldest.id"))))
    return due.select(*by, "id", F.element_at(F.array(*map(F.lit, STEPS)), F.col("step") + 1).alias("step"))


def answer_events(events: DataFrame) -> DataFrame:
    """The events (answer, seq, kind) of answers in the order in which a reader gets them: answer, place, seq, kind.

    kind is text, cite, stop (the end of a block), done or fail. Citations arrive before the text that they support, so
    they wait for the end of their block; those of a block that does not end come before done, and are lost where the
    answer fails. Ends of blocks are not shown, and no failure before any text: see to_ask_again. seq has no ties.
    """
    w = Window.partitionBy("answer").orderBy("seq")
    whole = Window.partitionBy("answer")
    kind = F.col("kind")
    rows = events.select("answer", "seq", "kind").withColumn("block", F.count_if(kind == "stop").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.when(kind == "stop", 1).otherwise(0))
    rows = rows.withColumn("blocks", F.count_if(kind == "stop").over(whole)).withColumn("failed", F.bool_or(kind == "fail").over(whole)).withColumn("texts", F.count_if(kind == "text").over(whole))
    lost = (kind == "cite") & F.col("failed") & (F.col("block") >= F.col("blocks"))
    rows = rows.filter(~lost & (kind != "stop") & ~((kind == "fail") & (F.col("texts") == 0)))
    rank = F.when(kind == "text", 0).when(kind == "cite", 1).otherwise(2)
    order = Window.partitionBy("answer").orderBy(F.col("kind").isin("done", "fail"), "block", rank, "seq")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select("answer", "place", "seq", "kind")


def to_ask_again(events: DataFrame, mode: str = "mode") -> DataFrame:
    """Answers with citations that failed before any text: they are asked once more, with markers in the text."""
    text = F.col("kind") == "text"
    ends = events.filter(F.col(mode) == "citations").groupBy("answer").agg(F.bool_or(F.col("kind") == "fail").alias("failed"), F.bool_or(text).alias("spoke"))
    return ends.filter("failed AND NOT spoke").select("answer")


def rebuild_suggestions(log: DataFrame, books: DataFrame, share: float = 0.2) -> DataFrame:
    """book, replaced, pages, suggested: whether so many of a book's pages were replaced since its last full build that it should
    be built anew (more than ``share`` of them).

    log: book, seq, page, version, action (retake or rollback), restored, at; books: book, pages (how many), built (when). A
    retake that a later rollback has undone does not count.
    """
    back = log.filter("action = 'rollback'").select("book", "page", F.col("restored").alias("version")).distinct()
    retakes = log.filter("action = 'retake'").join(back, ["book", "page", "version"], "left_anti")
    since = retakes.join(books.select("book", "built"), "book").filter(F.col("built").isNull() | (F.col("at") > F.col("built")))
    n = since.groupBy("book").agg(F.countDistinct("page").alias("replaced"))
    rows = books.join(n, "book", "left").withColumn("replaced", F.coalesce("replaced", F.lit(0)))
    return rows.select("book", "replaced", "pages", (F.col("replaced") > F.col("pages") * share).alias("suggested"))
