"""Jobs and logs: transitions, the serial queue, task cards, the log ring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each status may become.
ALLOWED = {"queued": ("running", "cancelled"), "running": ("completed", "failed", "cancelled")}
FINAL = ("completed", "failed", "cancelled")


def allowed(before: Column, after: Column) -> Column:
    return reduce(lambda a, b: a | b, [(before == k) & after.isin(*v) for k, v in ALLOWED.items()])


def transitions(log: DataFrame, job: str = "job_id", by: tuple = ("ts", "event_id")) -> DataFrame:
    """Adds before (the previous status in the log; queued at first) and valid."""
    before = F.lag("status", 1, "queued").over(Window.partitionBy(job).orderBy(*by))
    return log.withColumn("before", before).withColumn("valid", allowed(F.col("before"), F.col("status")))


def states(log: DataFrame, job: str = "job_id", by: tuple = ("ts", "event_id")) -> DataFrame:
    """The state machine itself: per job the final status and the number of rejected events; rejected events leave the state."""
    events = F.transform(F.array_sort(F.collect_list(F.struct(*by, "status"))), lambda e: e["status"])
    start = F.struct(F.lit("queued").alias("s"), F.lit(0).alias("bad"))

    def step(s, e):
        ok = allowed(s["s"], e)
        return F.struct(F.when(ok, e).otherwise(s["s"]).alias("s"), F.when(ok, s["bad"]).otherwise(s["bad"] + 1).alias("bad"))

    return log.groupBy(job).agg(F.aggregate(events, start, step).alias("_s")).select(job, F.col("_s.s").alias("status"), F.col("_s.bad").alias("rejected"))


def serial_queue(jobs: DataFrame, queue: str = "queue", by: tuple = ("arrival", "job_id")) -> DataFrame:
    """Adds start and finish when each queue runs one job at a time, first come first served.

    finish(i) = max over j <= i of (arrival(j) + durations j..i), a running maximum over running sums.
    """
    w = Window.partitionBy(queue).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    total = jobs.withColumn("_sum", F.sum("duration").over(w))
    finish = F.max(F.col("arrival") - F.col("_sum") + F.col("duration")).over(w) + F.col("_sum")
    return total.withColumn("finish", finish).withColumn("start", F.col("finish") - F.col("duration")).drop("_sum")


#: Kinds of requests to a managed queue.
ENQUEUE, CANCEL, CANCEL_CURRENT, CANCEL_REMAINING, SHUTDOWN = "enqueue", "cancel", "cancel_current", "cancel_remaining", "shutdown"
EVENTS = "queue {kind}, job_id long, event string, at long"


class _Queue:
    """One serial queue under requests in order of time; note() takes what happens."""

    def __init__(self, note):
        self.note, self.waiting, self.busy, self.now, self.silent = note, {}, {}, None, False

    def say(self, job, event, at):
        if not self.silent:
            self.note(job, event, at)

    def advance(self, until):
        """Lets jobs end and start up to a time, that time included; None: to the end."""
        while True:
            if self.now is None:
                if not self.waiting:
                    return
                job = next(iter(self.waiting))
                target, length, good, since = self.waiting.pop(job)
                start = max(since, self.free)
                self.now = (job, target, start + length, good)
                self.say(job, "started", start)
            job, target, end, good = self.now
            if until is not None and end > until:
                return
            self.end("completed" if good else "failed", end)

    free = 0

    def end(self, event, at):
        job, target, _, _ = self.now
        self.say(job, event, at)
        self.now, self.free = None, at
        self.busy.pop(target, None)

    def request(self, kind, at, job, target, length, good):
        self.advance(at)
        if kind == ENQUEUE:
            if target in self.busy:
                self.say(job, "rejected", at)
                return
            self.busy[target] = job
            self.waiting[job] = (target, length, good, at)
        if kind in (CANCEL_CURRENT, SHUTDOWN) or (kind == CANCEL and self.now and self.now[0] == job):
            if self.now:
                self.end("cancelled", at)
        if kind in (CANCEL_REMAINING, SHUTDOWN):
            for each in list(self.waiting):
                self.drop(each, at)
        if kind == CANCEL and job in self.waiting:
            self.drop(job, at)
        if kind == SHUTDOWN:
            self.silent = True
        self.advance(at)

    def drop(self, job, at):
        self.busy.pop(self.waiting.pop(job)[0], None)
        self.say(job, "cancelled", at)


def managed_queue(requests: DataFrame, queue: str = "queue") -> DataFrame:
    """queue, job_id, event (started, completed, failed, cancelled, rejected), at: what happens to the jobs of serial queues.

    requests: queue, seq, at, kind, job_id, target, duration, good. Each queue runs one job at a time, first come first
    served; a failing job (good is false) does not block. ENQUEUE is rejected while a job of the same target waits or runs;
    CANCEL takes one job, running or waiting; CANCEL_CURRENT the running one; CANCEL_REMAINING all that wait; SHUTDOWN
    both, and nothing of the queue is told after it. At one moment jobs end before requests, which go by seq. A queue is
    sequential by nature: its requests stream through one task in order, and only its waiting jobs are held there.
    """
    kind = requests.schema[queue].dataType.simpleString()
    columns = [queue, "at", "seq", "kind", "job_id", "target", "duration", "good"]

    def run(batches):
        import pandas as pd

        rows: list[tuple] = []
        name, state = None, None

        def drained():
            out = pd.DataFrame(rows, columns=["queue", "job_id", "event", "at"])
            rows.clear()
            return out

        for pdf in batches:
            for q, at, _, what, job, target, length, good in pdf[columns].itertuples(index=False, name=None):
                if state is None or q != name:
                    if state is not None:
                        state.advance(None)
                    name = q
                    state = _Queue(lambda j, e, t, q=q: rows.append((q, j, e, t)))
                state.request(what, at, job, target, length, good)
            yield drained()
        if state is not None:
            state.advance(None)
            yield drained()

    ordered = requests.select(*columns).repartition(queue).sortWithinPartitions(queue, "at", "seq")
    return ordered.mapInPandas(run, EVENTS.format(kind=kind))


def listed(events: DataFrame, enqueued: DataFrame, order: str = "seq") -> DataFrame:
    """Jobs as they stand after events of managed_queue(), in the order they were enqueued: enqueued's columns and status; rejected ones are not listed."""
    rank = F.when(F.col("event") == "started", 1).otherwise(2)
    last = events.groupBy("job_id").agg(F.max_by("event", F.struct("at", rank)).alias("_e"))
    status = F.coalesce(F.when(F.col("_e") == "started", "running").otherwise(F.col("_e")), F.lit("queued"))
    return enqueued.join(last, "job_id", "left").withColumn("status", status).where("status <> 'rejected'").drop("_e").orderBy(order)


def insert_if_absent(tasks: DataFrame, new: DataFrame, key: str = "task_id", order: str = "seq") -> DataFrame:
    """tasks and the first row of each new key that they lack."""
    fresh = new.join(tasks.select(key), key, "left_anti")
    first = fresh.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")
    return tasks.unionByName(first.select(*tasks.columns))


def any_active(tasks: DataFrame) -> DataFrame:
    """One row: whether any task waits or runs."""
    return tasks.agg(F.coalesce(F.bool_or(F.col("status").isin("queued", "running")), F.lit(False)).alias("active"))


def task_cards(events: DataFrame, task: str = "task_id", by: tuple = ("ts", "event_id")) -> DataFrame:
    """Per task: the percent of the last event that sets one (clamped), the last message that is not blank, and the first time of the stage alloc. Events after the first final one do not count."""
    w = Window.partitionBy(task).orderBy(*by)
    done = F.coalesce(F.max(F.col("status").isin(*FINAL).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = events.withColumn("_done", done).where("_done = 0")
    at = F.struct(*by)
    return live.groupBy(task).agg(
        F.max_by(F.least(F.lit(100), F.col("percent")), F.when(F.col("percent") >= 0, at)).alias("percent"),
        F.max_by("message", F.when(F.trim("message") != "", at)).alias("message"),
        F.min(F.when(F.col("stage") == "alloc", F.col("ts"))).alias("started"),
        F.max(F.when(F.col("status").isin(*FINAL), F.col("status"))).alias("final"),
    )


def log_ring(log: DataFrame, most: int = 2000, by: str = "seq") -> DataFrame:
    """The newest lines; a top-k that each task takes first."""
    return log.orderBy(F.desc(by)).limit(most)


def dropped(log: DataFrame, most: int = 2000) -> DataFrame:
    """One row: how many lines the ring no longer holds."""
    return log.agg(F.greatest(F.lit(0), F.count("*") - most).alias("dropped"))


def accepted(requests: DataFrame, active: DataFrame, target: str = "attachment_id", by: tuple = ("job_id",)) -> DataFrame:
    """Requests for targets without an active job, the first for each target."""
    free = requests.join(active.where(F.col("status").isin("queued", "running")).select(target).distinct(), target, "left_anti")
    return free.withColumn("_k", F.row_number().over(Window.partitionBy(target).orderBy(*by))).where("_k = 1").drop("_k")
