"""What a stream keeps of one source of one monitor, and how it changes.

The processor runs inside tasks. Everything that lines alone can tell (detection,
timestamps, kernel stamps, message texts) comes as columns; what is left is the order of
lines and the clock. This module is shipped by value and imports nothing from the package.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

#: State variables and their types; each is one value a key, but for the lines of the open batch.
STATES = {
    "batch": "first_line_no long, last_line_no long, batch_id long, start_ts double, ts_str string, n_bytes long, touched long",
    "kernel": "last_ts double, last_header string",
    "limiter": "opened long, used long, clock long",
    "activity": "seen long, alerted boolean",
    "progress": "issues long",
    "timers": "idle long, silence long",
}
LINES = "line string"
#: One row a finished batch or alert.
RESULT = (
    "monitor string, source string, batch_id long, first_line_no long, last_line_no long, start_ts double, ts_str string, "
    "first_line string, n_lines long, n_bytes long, message string, passed boolean, alert string, at double"
)
FIELDS = [f.split()[0] for f in RESULT.split(", ")]
WARNING, INFO = "warning", "info"
NEVER = -1


class KernelContext:
    """Which kernel lines belong to the last error."""

    def __init__(self, state: tuple | None, seconds: float):
        self.last_ts, self.last_header = state or (None, None)
        self.seconds = seconds

    def takes(self, error: bool, stamped: bool, at: float, header: str | None) -> bool:
        """Is the line an error or part of the last one? An error becomes the last one."""
        last, near = self.last_header, at - (self.last_ts or 0.0) <= self.seconds
        related = bool(header and last) and (header.startswith(last) or last.startswith(header))
        found = error or last is not None and (not stamped or at > 0 and near and related)
        if error:
            self.last_ts = at if at > 0 else self.last_ts
            self.last_header = header if header is not None else last
        return found


class Limiter:
    """The first events of each window pass; a window opens at the first event after the last one has ended."""

    def __init__(self, state: tuple | None, burst: int, window_us: int):
        self.opened, self.used, self.clock = state or (0, 0, 0)
        self.burst, self.window_us = burst, window_us
        self.known = state is not None

    def passes(self, clock_us: int) -> bool:
        if self.burst <= 0:
            return True
        self.clock = max(self.clock, clock_us) if self.known else clock_us
        if not self.known or self.clock - self.opened > self.window_us:
            self.opened, self.used, self.known = self.clock, 0, True
        self.used = min(self.used + 1, self.burst + 1)
        return self.used <= self.burst


class SourceProcessor(StatefulProcessor):
    """Batches, limits and silence of one source; see ``MonitorStream`` for the settings."""

    def __init__(self, rules: dict[str, dict], settings: dict):
        self.rules, self.settings = rules, settings

    def init(self, handle) -> None:
        self.handle, ttl = handle, self.settings["ttl_ms"]
        self.states = {name: handle.getValueState(name, schema, ttl) for name, schema in STATES.items()}
        self.lines = handle.getListState("lines", LINES, ttl)

    # --- one key in one micro-batch ---

    def _open(self, key, now: int) -> None:
        self.key, self.now, self.out = key, now, []
        self.rule = self.rules.get(key[0], {})
        self.batch = self.states["batch"].get()
        self.batch = list(self.batch) if self.batch else None
        self.held: list[str] | None = None  # lines of the open batch, once they were read
        self.fresh: list[str] = []          # and those that came since
        self.limiter = Limiter(self.states["limiter"].get(), self.rule.get("burst", 0), self.rule.get("window_us", 0))
        self.timers = list(self.states["timers"].get() or (NEVER, NEVER))
        self.cleared = False

    def _texts(self) -> list[str]:
        if self.held is None:
            self.held = [] if self.cleared or not self.batch else [x[0] for x in self.lines.get()]
        return self.held + self.fresh

    def _flush(self, closing: bool) -> None:
        """End the open batch. Only a closing flush sends an empty text."""
        texts = self._texts()
        message = "\n".join(texts)
        if message or closing:
            first, last, number, start, stamp, _, _ = self.batch
            clock = round(start * 1e6) if self.settings["line_clock"] else self.now * 1000
            self.out.append((*self.key, number, first, last, start, stamp, texts[0], len(texts), len(message.encode()), message, self.limiter.passes(clock), None, None))
        self.batch, self.held, self.fresh, self.cleared = None, [], [], True

    def _take(self, line_no: int, line: str, ts: float, stamp: str, size: int, issues: int) -> None:
        s, b = self.settings, self.batch
        if b is not None:
            n = len(self.fresh) + self.counted
            late = ts != 0 and ts - b[3] > s["window"]
            if n >= s["max_lines"] or b[5] + size >= s["max_bytes"] or late:
                self._flush(closing=False)
                b = None
        if b is None:
            self.batch, self.counted, self.fresh = [line_no, line_no, issues, ts, stamp, size, self.now], 0, [line]
            return
        b[1], b[5], b[6] = line_no, b[5] + 1 + size, self.now
        self.fresh.append(line)

    def _timer(self, which: int, at: int) -> None:
        if self.timers[which] != at:
            if self.timers[which] != NEVER:
                self.handle.deleteTimer(self.timers[which])
            if at != NEVER:
                self.handle.registerTimer(at)
            self.timers[which] = at

    def _alert(self, level: str) -> None:
        self.out.append((*self.key, *[None] * 9, None, level, self.now / 1000))

    def _close(self):
        """Write back what changed, set the timers and hand on the rows."""
        if self.cleared:
            self.lines.clear()
        if self.fresh:
            self.lines.appendList([(x,) for x in self.fresh])
        if self.batch is None:
            self.states["batch"].clear()
        else:
            self.states["batch"].update(tuple(self.batch))
        if self.limiter.known:
            self.states["limiter"].update((self.limiter.opened, self.limiter.used, self.limiter.clock))
        idle = self.settings["idle_ms"]
        self._timer(0, NEVER if self.batch is None or idle is None else self.batch[6] + idle)
        self.states["timers"].update(tuple(self.timers))
        if self.out:
            yield pd.DataFrame(self.out, columns=FIELDS).astype(object)

    def _watch(self, since: int) -> None:
        silence = self.rule.get("silence_ms", 0)
        if silence > 0:
            self._timer(1, since + silence)

    # --- what Spark calls ---

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A source that is expected: its silence counts from now on."""
        self._open(key, timerValues.getCurrentProcessingTimeInMs())
        self.states["activity"].update((self.now, False))
        self._watch(self.now)
        for _ in self._close():
            pass

    def handleInputRows(self, key, rows, timerValues):
        self._open(key, timerValues.getCurrentProcessingTimeInMs())
        seen = self.states["activity"].get()
        if seen and seen[1]:
            self._alert(INFO)
        self.states["activity"].update((self.now, False))
        self._watch(self.now)
        taken = []
        for frame in rows:
            frame = frame[frame["issue"]]
            taken += zip(*(frame[c].tolist() for c in ("line_no", "line", "ts", "ts_str", "n_bytes", "kernel", "error", "excluded", "stamped", "at", "header")), strict=True)
        if taken:
            idle = self.settings["idle_ms"]
            if self.batch and idle is not None and self.now - self.batch[6] >= idle:
                self._flush(closing=True)
            self.counted = len(self._texts()) if self.batch else 0
            known = self.states["progress"].get()
            issues = known[0] if known else 0
            context = KernelContext(self.states["kernel"].get(), self.settings["related"])
            kernel = False
            for line_no, line, ts, stamp, size, of_kernel, error, excluded, stamped, at, header in sorted(taken, key=lambda x: x[0]):
                if of_kernel:
                    kernel = True
                    if not context.takes(error, stamped, at, header) or excluded:
                        continue
                self._take(line_no, line, ts, stamp, size, issues)
                issues += 1
            self.states["progress"].update((issues,))
            if kernel and (context.last_ts, context.last_header) != (None, None):
                self.states["kernel"].update((context.last_ts, context.last_header))
        yield from self._close()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._open(key, timerValues.getCurrentProcessingTimeInMs())
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at == self.timers[0]:
            self.timers[0] = NEVER
            if self.batch:
                self._flush(closing=True)
        if at == self.timers[1]:
            self.timers[1] = NEVER
            seen = self.states["activity"].get()
            if seen and not seen[1]:
                self._alert(WARNING)
                self.states["activity"].update((seen[0], True))
        yield from self._close()


def activity_once(batches):
    """Issue rows pass; of the other lines one row a source and task is enough to tell that it speaks."""
    import pyarrow as pa
    import pyarrow.compute as pc

    known: set = set()
    for batch in batches:
        names = batch.schema.names
        issue = batch.column(names.index("issue"))
        rest = batch.filter(pc.invert(issue))
        fresh = []
        for k, pair in enumerate(zip(*(rest.column(names.index(c)).to_pylist() for c in ("monitor", "source")), strict=True)):
            if pair not in known:
                known.add(pair)
                fresh.append(k)
        yield batch.filter(issue)
        if fresh:
            yield rest.take(pa.array(fresh, pa.int64()))
