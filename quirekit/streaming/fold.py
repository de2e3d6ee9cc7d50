"""Page events folded into documents, as a stateful stream.

State is kept for each document: texts and methods by page. The last event for
a page wins, in whatever order they come. A document is emitted when all its
pages are there or its done event has come, whose text, parted at blank lines,
fills the pages that had no event of their own; one that never completes is
emitted, as far as it got, after ``patience`` of processing time. That timeout
is an addition: without it an abandoned document would hold state for ever.
"""

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "page int, total int, method string, dpi int, psm int, text string, error string, done boolean, methods array<string>"
STATE = "total int, pages string"
OUT = "doc_id long, total int, received int, complete boolean, text string, methods array<string>, status array<string>"


def parsed(lines: DataFrame, key="doc_id", event="event") -> DataFrame:
    """Events of JSON lines; a line that is no event is dropped."""
    return lines.select(key, F.from_json(event, EVENT).alias("e")).where("e IS NOT NULL").select(key, "e.*")


def merged(state, rows):
    """State after events: state is (total, {page: [method, text or None]})."""
    total, pages = state
    done = False
    for e in rows:
        if e.get("total") is not None and e["total"] == e["total"]:
            total = int(e["total"])
        page = e.get("page")
        page = int(page) if page is not None and page == page else 0
        if e.get("done"):
            done = True
            # Pages without an event take their part of the whole text by place, or none.
            parts = re.split(r"\n\n+", e.get("text") or "")
            for p in range(1, max(total, 1) + 1):
                if pages.get(p, ["", None])[1] is None:
                    pages[p] = ["", parts[p - 1] if p <= len(parts) else ""]
        elif page > 0 and e.get("method") == "started":
            pages.setdefault(page, ["started", None])
        elif page > 0:
            pages[page] = [e.get("method") or "", e.get("text") or ""]
    return (total, pages), done


def shown(total, pages):
    """The document row of a state, without its key."""
    numbers = range(1, max([total, *pages]) + 1) if pages or total else []
    got = {p: v for p, v in pages.items() if v[1] is not None}
    kind = lambda p: {"direct": "done-direct", "error": "error"}.get(got[p][0], "done") if p in got else "working" if p in pages else "waiting"
    return {
        "total": total,
        "received": len(got),
        "complete": total > 0 and len(got) >= total,
        "text": "\n\n".join(got[p][1] if p in got else "" for p in numbers),
        "methods": [f"p{p}:{got[p][0]}" for p in sorted(got) if got[p][0]],
        "status": [kind(p) for p in numbers],
    }


def fold(events: DataFrame, key="doc_id", patience="10 minutes") -> DataFrame:
    """A stream of events (key and EVENT's columns) to a stream of documents."""
    amount, unit = patience.split()
    wait = int(float(amount) * {"second": 1e3, "minute": 6e4, "hour": 3.6e6}[unit.rstrip("s")])

    def step(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = (0, {})
        if state.exists:
            total, pages = state.get
            now = (total, {int(k): v for k, v in json.loads(pages).items()})
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([{"doc_id": group[0], **shown(*now)}])
            return
        done = False
        for b in batches:
            now, last = merged(now, b.to_dict("records"))
            done |= last
        row = shown(*now)
        if done or row["complete"]:
            state.remove()
            yield pd.DataFrame([{"doc_id": group[0], **row}])
        else:
            state.update((now[0], json.dumps(now[1])))
            state.setTimeoutDuration(wait)

    grouped = events.withColumnRenamed(key, "doc_id").groupBy("doc_id")
    return grouped.applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
