"""The stream of request events against a plain fold, for several splits into batches and with a restart between."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest

from webweft.streaming import rest

EPOCH = datetime(2024, 1, 1)


def plain(events, idle, patience, most):
    """page: (rest in ms, requests, urls), from all events in order."""
    out = {}
    for page in {e[0] for e in events}:
        own = sorted(e[1:] for e in events if e[0] == page)
        flying, streams, found, loaded, last, n = set(), set(), [], False, None, 0
        for ms, _, request, method, url, kind, mime in [*own, (10**9, 0, "", "end", "", "", "")]:
            if last is not None and not flying:
                at = max(last + idle, 0 if loaded else own[0][0] + patience)
                if at <= ms:
                    out[page] = (at, n, sorted(found))
                    break
            last = ms
            loaded |= method == "loaded"
            n += method == "requested"
            if method in ("requested", "response") and url and url not in found and len(found) < most:
                found.append(url)
            if method == "requested" and request and request not in streams:
                flying.add(request)
            if method == "response" and (kind.lower() in ("websocket", "eventsource") or "event-stream" in mime.lower()):
                streams.add(request)
                flying.discard(request)
            if method in ("finished", "failed"):
                flying.discard(request)
                streams.discard(request)
    return out


def made(rng):
    events = []
    for page in range(12):
        ms, seq, opened = rng.randint(0, 500), 0, []
        if page == 5:  # which never comes to rest
            events.append(("p5", ms, seq, "open", "requested", "/open", "", ""))
        for _ in range(rng.randint(3, 30)):
            ms += rng.choice((0, 5, 40, 200, 450, 700, 701)) if page != 3 else 10
            seq += 1
            kind = rng.random()
            if kind < 0.45 or not opened:
                request = f"r{seq}"
                opened.append(request)
                events.append((f"p{page}", ms, seq, request, "requested", f"/u{rng.randint(0, 9)}", "", ""))
            elif kind < 0.6:
                events.append((f"p{page}", ms, seq, rng.choice(opened), "response", f"/v{seq % 4}", rng.choice(("XHR", "WebSocket")), rng.choice(("", "text/Event-Stream"))))
            elif kind < 0.9:
                events.append((f"p{page}", ms, seq, opened.pop(rng.randrange(len(opened))), rng.choice(("finished", "failed")), "", "", ""))
            else:
                events.append((f"p{page}", ms, seq, "", rng.choice(("loaded", "other")), "", "", ""))
        for request in opened:
            ms, seq = ms + 3, seq + 1
            events.append((f"p{page}", ms, seq, request, "finished", "", "", ""))
    return events


@pytest.mark.parametrize("parts, restart", [(1, False), (4, True)])
def test_stream_equals_plain_fold(spark, parts, restart):
    rng = random.Random(8)
    events = made(rng)
    want = plain([e for e in events], 700, 1200, 6)
    assert len(want) == 11 and "p5" not in want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out, checkpoint = (tempfile.mkdtemp(prefix="spark-rest-") for _ in range(3))
    # Batches by time, out of order within; the last event lets the watermark pass all others.
    events.sort(key=lambda e: e[1])
    cuts = [events[len(events) * k // parts : len(events) * (k + 1) // parts] for k in range(parts)] + [[("last", 3_600_000, 1, "", "other", "", "", "")]]

    def put(some):
        rng.shuffle(some)
        rows = [(p, EPOCH + timedelta(milliseconds=ms), *more) for p, ms, *more in some]
        spark.createDataFrame(rows, rest.EVENT).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(rest.EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
        query = rest.rested(stream, "5 seconds", idle_ms=700, patience_ms=1200, discovered_most=6).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(200)

    for some in cuts:
        put(some)
        if restart:
            run()
    run()
    got = {r["page"]: (int((r["rest_at"] - EPOCH).total_seconds() * 1000 + 0.5), r["requests"], r["urls"]) for r in spark.read.schema(rest.RESTED).parquet(out).collect()}
    got.pop("last", None)
    assert got == want
