"""The round loop of a mutation run as a stream: keyed state, deadlines, and each target settled once.

A target's mutants and running tests are keyed states in the RocksDB store: few of them are one value with
the target's own, more are an entry each, so a batch reads and writes what its rows name and nothing
else. Within a batch an entry is read once and written once, because a call to the store costs far more
than a row. Deadlines are timers, of a target with few tests the next one only. A target that doesn't finish in time
is settled as timed out, once, and none of its mutants counts as live; a test that doesn't end in
time is reported once and the target goes on.

Times are those of the rows (``eventTime``, with a watermark) or the clock's (``processingTime``).
With row times a report doesn't depend on how rows fall into batches, nor on their order within one: every row
says when its target's run and its test began, and kills count by their own time. A settled
target is remembered for ``keep``, so that rows that come later don't open it again.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mutagrid.streaming.streams import by_key_state

#: What a row says: a mutant exists; a test starts, kills a mutant, or ends without; the target is done.
MUTANT, STARTED, KILLED, ENDED, FINISHED = "mutant", "started", "killed", "ended", "finished"
#: What the stream says of a target, a test, or a mutant.
ROUND, TIMED_OUT, DONE, TEST_TIMED_OUT, LIVE, EXCLUDED = "ROUND", "TIMED_OUT", "DONE", "TEST_TIMED_OUT", "LIVE", "EXCLUDED"

#: ``opened`` is when the target's run began, ``since`` when the row's test did.
EVENTS = "target string, opened timestamp, kind string, mutant string, test string, since timestamp, round long, at timestamp"
REPORTS = "target string, report string, mutant string, test string, round long, new_kills long, known_kills long"


@dataclass(frozen=True)
class Deadlines:
    """Milliseconds that a target and a test have, and that a settled target is remembered; rounds beyond the last don't count."""

    target: int = 60_000
    test: int = 4_000
    keep: int = 3_600_000
    rounds: int = 4


#: So many mutants or tests of a target are kept in one value, and so many of any target in memory.
FEW, HELD = 28, 10_000


def said(target: str, report: str, mutant: str | None = None, test: str | None = None, round_: int | None = None, new: int | None = None, known: int | None = None) -> Row:
    return Row(target=target, report=report, mutant=mutant, test=test, round=round_, new_kills=new, known_kills=known)


class Said(NamedTuple):
    """A row as the processor reads it; nulls are left out on the way."""

    kind: str | None = None
    mutant: str | None = None
    test: str | None = None
    round: int | None = None
    at_ms: int | None = None
    opened_ms: int | None = None
    since_ms: int | None = None


class Held:
    """A target's mutants or tests in one call: ``all`` there are, or None where the map ``state`` has them, an entry each."""

    def __init__(self, state, all: dict | None, stored=None):
        self.state, self.whole, self.seen, self.changed, self.stored = state, all is not None, all or {}, set(), stored

    def get(self, name) -> tuple | None:
        if name not in self.seen and not self.whole:
            self.seen[name] = self.state.getValue((name,))
        return self.seen.get(name)

    def put(self, name, value: tuple) -> None:
        self.seen[name] = value
        self.changed.add(name)
        if len(self.seen) > HELD:
            self.store()

    def store(self) -> None:
        """To an entry each."""
        for name in self.seen if self.whole else self.changed:
            self.state.updateValue((name,), self.seen[name])
            if self.stored:
                self.stored(self.seen[name])
        self.whole, self.seen, self.changed = False, {}, set()

    def kept(self) -> dict | None:
        """What goes into the target's own value: all if they are few, else nothing."""
        if not self.whole or len(self.seen) > FEW:
            self.store()
        return self.seen if self.whole else None

    def items(self) -> Iterator[tuple]:
        if self.whole:
            yield from self.seen.items()
        else:
            self.store()
            yield from ((name, value) for (name,), value in self.state.iterator())

    def clear(self) -> None:
        if not self.whole:
            self.state.clear()


class RoundLoop(StatefulProcessor):
    def __init__(self, limits: Deadlines, row_times: bool):
        self.limits, self.row_times = limits, row_times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: when each mutant was killed first; null while it isn't
        self.many_mutants = handle.getMapState("mutants", "mutant string", "at long")
        #: until when each test may run (null once it ended), and whether it was reported
        self.many_tests = handle.getMapState("tests", "test string", "deadline long, reported boolean")
        #: when it was ``settled``, by row times; ``timer`` is the next one; tests that had to end before ``swept`` were looked for. Few mutants and tests come in lists, null if the maps have them
        self.run = handle.getValueState("run", "settled long, deadline long, known long, timer long, swept long, mutants array<string>, at array<long>, tests array<string>, until array<long>, reported array<boolean>")
        # by the clock, the store itself forgets; by row times a timer does
        self.settled = None if self.row_times else handle.getValueState("settled", "at long", self.limits.keep)

    def opened(self) -> tuple:
        """When the target was settled, its deadline, known kills, timer and sweep; its mutants and tests are held from now on."""
        settled, deadline, known, timer, swept, mutants, at, tests, until, reported = self.run.get() or (None, None, 0, None, None, [], [], [], [], [])
        if self.settled is not None:
            settled = (self.settled.get() or (None,))[0]
        self.mutants = Held(self.many_mutants, None if mutants is None else {m: (x,) for m, x in zip(mutants, at)})
        self.tests = Held(self.many_tests, None if tests is None else {t: (u, r) for t, u, r in zip(tests, until, reported)}, self.watched)
        return settled, deadline, known, timer, swept

    def watched(self, test: tuple) -> None:
        """Each of many tests that run has a timer."""
        if test[0] is not None:
            self.handle.registerTimer(test[0] + 1)

    def close_up(self, deadline: int, known: int, timer: int | None, swept: int | None) -> None:
        mutants, tests = self.mutants.kept(), self.tests.kept()
        due = min([deadline, *[until for until, _ in (tests or {}).values() if until is not None]]) + 1
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            timer = due
        lists = [None, None] if mutants is None else [list(mutants), [x for (x,) in mutants.values()]]
        lists += [None, None, None] if tests is None else [list(tests), [u for u, _ in tests.values()], [r for _, r in tests.values()]]
        self.run.update((None, deadline, known, timer, swept, *lists))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (target,) = key
        now = timerValues.getCurrentProcessingTimeInMs()
        settled, deadline, known, timer, swept = self.opened()
        if settled is not None:
            return
        finished, fresh, late = None, [], []
        for row in (Said(**json.loads(r.said)) for r in rows):
            at = row.at_ms if self.row_times else now
            if deadline is None or self.row_times:
                due = (row.opened_ms if self.row_times else now) + self.limits.target
                deadline = due if deadline is None else min(deadline, due)
            if row.kind == FINISHED:
                finished = at if finished is None else min(finished, at)
            elif at > deadline:
                continue
            elif row.kind == MUTANT and self.mutants.get(row.mutant) is None:
                self.mutants.put(row.mutant, (None,))
            elif row.kind == STARTED and self.tests.get(row.test) is None:
                self.tests.put(row.test, (at + self.limits.test, False))
            elif row.kind in (KILLED, ENDED):
                in_time, report = self.ended(row, at)
                if report:
                    late.append(row.test)
                if in_time and row.kind == KILLED and row.round <= self.limits.rounds and self.killed(row.mutant, at):
                    fresh.append((row.round, at))
        for round_, n in sorted(Counter(r for r, at in fresh if finished is None or at <= finished).items()):
            known += n
            yield said(target, ROUND, round_=round_, new=n, known=known)
        for test in late:
            yield said(target, TEST_TIMED_OUT, test=test)
        if finished is not None:
            yield from self.settle(target, min(finished, deadline), finished <= deadline)
        elif deadline is not None:
            self.close_up(deadline, known, timer, swept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (target,) = key
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        # all that is due by now is done at once
        now = max(expiry, timerValues.getCurrentWatermarkInMs() if self.row_times else timerValues.getCurrentProcessingTimeInMs())
        settled, deadline, known, _, swept = self.opened()
        if settled is not None:
            if self.row_times and settled + self.limits.keep <= now:
                self.run.clear()
            return
        if deadline is None or deadline >= now and swept is not None and now <= swept:
            return
        if deadline < now:
            yield from self.settle(target, deadline, False)
        else:
            yield from self.overdue(target, now)
            self.close_up(deadline, known, None, now)

    def overdue(self, target: str, now: int) -> Iterator[Row]:
        """The tests that should have ended before ``now``."""
        for test in sorted(test for test, (deadline, _) in self.tests.items() if deadline is not None and deadline < now):
            self.tests.put(test, (None, True))
            yield said(target, TEST_TIMED_OUT, test=test)

    def ended(self, row: Row, at: int) -> tuple[bool, bool]:
        """Whether the row's test ended in time, and whether it must be reported because it didn't."""
        if row.test is None:
            return True, False
        deadline, reported = self.tests.get(row.test) or (None, False)
        in_time = at - row.since_ms <= self.limits.test if self.row_times else not reported and (deadline is None or at <= deadline)
        self.tests.put(row.test, (None, reported or not in_time))
        return in_time, not in_time and not reported

    def killed(self, mutant: str, at: int) -> bool:
        """Whether the mutant was not known as killed; of repeated kills the earliest stays."""
        before = self.mutants.get(mutant)
        new = before is None or before[0] is None
        if new or at < before[0]:
            self.mutants.put(mutant, (at,))
        return new

    def settle(self, target: str, at: int, in_time: bool) -> Iterator[Row]:
        """The target's outcome and that of its mutants without a kill in time; what it held goes."""
        yield from self.overdue(target, at)
        kills = 0
        for mutant, (killed_at,) in self.mutants.items():
            if killed_at is not None and killed_at <= at:
                kills += 1
            else:
                yield said(target, LIVE if in_time else EXCLUDED, mutant)
        yield said(target, DONE if in_time else TIMED_OUT, known=kills)
        self.mutants.clear(), self.tests.clear()
        if self.row_times:
            self.run.update((at, None, 0, None, None, [], [], [], [], []))
            self.handle.registerTimer(at + self.limits.keep)
        else:
            self.run.clear()
            self.settled.update((at,))


def round_loop(events: DataFrame, limits: Deadlines = Deadlines(), late: str | None = "0 seconds") -> DataFrame:
    """The stream of reports on a stream of ``EVENTS``; ``late`` is the watermark's delay, None takes the clock's time instead."""
    by_key_state(events.sparkSession, sys.modules[__name__])
    # one text a row: Python takes each cell of a row by itself
    row = F.struct("kind", "mutant", "test", "round", *[F.unix_millis(c).alias(f"{c}_ms") for c in ("at", "opened", "since")])
    rows = events.select("target", "at", F.to_json(row, {"ignoreNullFields": "true"}).alias("said"))
    if late is not None:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("target").transformWithState(RoundLoop(limits, late is not None), REPORTS, "append", "eventTime" if late is not None else "processingTime")
