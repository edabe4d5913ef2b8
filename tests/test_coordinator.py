"""The coordinator by path: bursts, one dispatch in flight, any order of arrival."""

import itertools
import random
import time

import pytest

from trovesift.operators.indexing import CHANGES
from trovesift.streaming import attribution as A
from trovesift.streaming import coordinator as C
from trovesift.streaming import pipelines


def brute(events, now, quiet=C.QUIET_MS):
    """Tick by tick, for one path."""
    out, burst, last, flying, pending, generation = [], [], None, False, [], 0
    changes, done = sorted((t, k) for k, t in events if k != C.DONE), sorted(t for k, t in events if k == C.DONE)
    for t in range(now + 1):
        if burst and t == last + quiet:
            generation += 1
            if flying:
                pending += burst
            else:
                flying = True
                out.append((generation, min(burst, key=CHANGES.index), t, len(burst)))
            burst = []
        for _ in range(done.count(t) if t < now else 0):
            if flying and pending:
                out.append((generation, min(pending, key=CHANGES.index), t, len(pending)))
                pending = []
            else:
                flying = False
        for at, kind in changes:
            if at == t:
                burst, last = [*burst, kind], t
    return out


def test_path_state_by_brute_force_in_any_order():
    rnd = random.Random(2)
    for _ in range(60):
        events = [(rnd.choice([*CHANGES, C.DONE]), rnd.randrange(60)) for _ in range(rnd.randint(1, 12))]
        want = brute(events, 70, quiet=7)
        for _ in range(4):
            rnd.shuffle(events)
            state = C.PathState(7)
            for kind, at in events:
                state.add(kind, at)
                state = C.PathState(7, state.saved())
            got = [x for now in (20, 20, 45, 70) for x in state.advance(now)]
            assert got == want


def test_every_permutation_of_arrivals():
    events = [("new", 0), ("modified", 300), ("delete", 2000), (C.DONE, 900), (C.DONE, 5000), ("modified", 4000)]
    found = {tuple(C.replay([("a", k, t) for k, t in order], 10_000)) for order in itertools.permutations(events)}
    assert found == {(("a", 1, "modified", 800, 2), ("a", 2, "delete", 2500, 1), ("a", 3, "modified", 5000, 1))}


@pytest.fixture
def rocks(spark):
    with pipelines.keyed_state(spark):
        yield spark


def test_stream_equals_replay(rocks, tmp_path):
    """Events out of order by less than the watermark allows, in one batch and in several: what is dispatched is the same."""
    spark, rnd = rocks, random.Random(6)
    events = [(f"p{rnd.randrange(8)}", rnd.choice([*CHANGES, C.DONE, C.DONE]), rnd.randrange(100_000)) for _ in range(400)] + [("z", "new", 400_000)]
    want = C.replay(events, 400_000 - 100_000)
    found = []
    for parts in (1, 3):
        order = [events[:-1], events[:-1]][parts == 3]
        rnd.shuffle(order)
        source, out = str(tmp_path / f"in{parts}"), str(tmp_path / f"out{parts}")
        for k in range(parts):
            own = order[k::parts] + (events[-1:] if k == parts - 1 else [])
            rows = spark.createDataFrame([(p, kind, at) for p, kind, at in own], "path string, kind string, ms long").selectExpr("path", "kind", "timestamp_millis(ms) AS at")
            rows.coalesce(1).write.parquet(f"{source}/{k}")
            stream = spark.readStream.schema(C.EVENTS).option("recursiveFileLookup", True)
            pipelines.run_now(C.dispatches(stream.option("maxFilesPerTrigger", 1).parquet(source), late="100 seconds"), out, f"{out}-c")
        found.append(sorted((r.path, r.generation, r.kind, r.ms, r.changes) for r in spark.read.parquet(out).selectExpr("*", "unix_millis(due) AS ms").collect()))
    assert found[0] == want and found[1] == want and len(want) > 50


def taken_by_brute_force(events, before=30_000, after=1_000):
    """Clicks in order of time; every exposure is free until a click takes it."""
    out, free = [], sorted(e for e in events if e[0] == "exposure")
    for _, click, item, at, context, digest, query in sorted((e for e in events if e[0] == "click"), key=lambda e: (e[3], e[1])):
        near = [e for e in free if e[2] == item and -before <= e[3] - at <= after]
        ties = ([e for e in near if context and e[4] == context], [e for e in near if digest and query and e[5:] == (digest, query)], [e for e in near if query and e[6] == query])
        tier = next((k for k, x in enumerate(ties) if x), None)
        if tier is None:
            out.append((item, click, None, None, 1.0 if context else 0.85 if digest else 0.7, at))
        for e in ties[tier] if tier is not None else []:
            free.remove(e)
            out.append((item, click, e[1], tier, A.TIERS[tier], at))
    return sorted(out, key=str)


def some_events(rnd, n, span):
    pick = lambda *x: rnd.choice(x)
    return [(pick("click", "exposure", "exposure"), k, rnd.randrange(4), rnd.randrange(span), pick(None, "", "a", "b", "c"), pick(None, "d", "e"), pick("q", "r", "", None)) for k in range(n)]


def test_each_exposure_is_taken_once():
    rnd = random.Random(8)
    for _ in range(40):
        events = some_events(rnd, 40, 200_000)
        want = taken_by_brute_force(events)
        rnd.shuffle(events)
        assert A.replay(events, 10**9) == want
        exposures = [x[2] for x in want if x[2] is not None]
        assert len(exposures) == len(set(exposures))


def test_state_of_an_item_is_bounded():
    state = A.ItemState(30_000, 1_000)
    for k in range(1000):
        state.add("exposure", [k * 1000, k, "a", "d", "q"])
        state.advance(k * 1000)
    assert len(state.exposures) <= 32
    state.advance(10**9)
    assert state.next_due() is None


def test_attribution_as_a_stream(rocks, tmp_path):
    spark, rnd = rocks, random.Random(9)
    events = some_events(rnd, 200, 90_000)
    want = taken_by_brute_force(events)
    rows = spark.createDataFrame([*events, ("exposure", 999, 77, 1_000_000, "x", "x", "x")], "side string, event_id long, item_id long, ms long, context string, digest string, query string").selectExpr("side", "event_id", "item_id", "timestamp_millis(ms) AS at", "context", "digest", "query")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        rows.where(f"event_id % 3 = {k} OR event_id = 999 AND {k} = 2").where(f"event_id <> 999 OR {k} = 2").coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema(A.EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source)
    pipelines.run_now(A.attribute_stream(stream, late="95 seconds"), out, f"{out}-c")
    got = spark.read.parquet(out).selectExpr("item_id", "click_id", "exposure_id", "tier", "confidence", "unix_millis(at) AS ms").collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_a_click_looks_at_what_may_tie_only():
    """Of a hot item: 40,000 clicks among 80,000 exposures of one interval, which once were all looked at by each click."""
    rnd = random.Random(3)
    state = A.ItemState(7_200_000, 60_000)
    events = [("click" if k % 3 == 0 else "exposure", [rnd.randrange(7_000_000), k, f"u{rnd.randrange(30_000)}", f"d{rnd.randrange(100)}", f"q{rnd.randrange(5)}"]) for k in range(120_000)]
    for side, event in events:
        state.add(side, event)
    began = time.process_time()
    found = state.advance(10**9)
    assert time.process_time() - began < 20 and len({x[0] for x in found}) == 40_000
    taken = [x[1] for x in found if x[1] is not None]
    assert len(taken) == len(set(taken)) > 70_000


def test_attribution_in_parts_of_time(rocks, tmp_path, monkeypatch):
    """Events over hours, so that the state is of many parts, added in several batches."""
    spark, rnd = rocks, random.Random(19)
    events = some_events(rnd, 600, 4 * 3_600_000)
    events += [(side, 1000 + k, item, ms + rnd.randrange(40_000), *ties) for k, (side, _, item, ms, *ties) in enumerate(events)]
    want = taken_by_brute_force(events)
    rows = spark.createDataFrame([*events, ("exposure", 9999, 77, 10**8, "x", "x", "x")], "side string, event_id long, item_id long, ms long, context string, digest string, query string").selectExpr("side", "event_id", "item_id", "timestamp_millis(ms) AS at", "context", "digest", "query")
    for k in range(3):
        rows.where(f"event_id % 3 = {k} AND event_id <> 9999").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rows.where("event_id = 9999").coalesce(1).write.parquet(f"{tmp_path}/in/3")
    monkeypatch.setattr(A, "HELD", 50)
    stream = spark.readStream.schema(A.EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    pipelines.run_now(A.attribute_stream(stream, late="5 hours"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/out").selectExpr("item_id", "click_id", "exposure_id", "tier", "confidence", "unix_millis(at) AS ms").collect()
    assert sorted((tuple(r) for r in got), key=str) == want and len({r.ms // 600_000 for r in got}) > 20


@pytest.mark.parametrize("name", ["path_dispatches", "stream_attribution"])
def test_times_between_milliseconds_are_rounded_as_in_the_sql(spark, tmp_path, name):
    """Compared digit by digit: `assert_same` takes six digits of a number, which hides milliseconds."""
    import datetime as dt

    from compare import TABLES, oracle

    from trovesift import catalog

    rnd, folder = random.Random(8), tmp_path / "tables"
    folder.mkdir()
    for t in TABLES:
        (folder / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (folder / "events.parquet").unlink()
    start, kinds = dt.datetime(2024, 1, 1), ["view", "click", "signup", "error", "purchase"]
    rows = [(k, start + dt.timedelta(microseconds=rnd.randrange(86_400 * 1_000_000)), k % 7, rnd.choice(kinds), 1.0, f'{{"k": {k % 3}}}') for k in range(400)]
    made = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    made.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")
    found = catalog.queries()[name](spark, str(folder))
    names, want = oracle(catalog.oracle_sql()[name], str(folder))
    got = [tuple(r[c] for c in names) for r in found.collect()]
    assert sorted(got, key=str) == sorted(map(tuple, want), key=str) and len(got) > 20
