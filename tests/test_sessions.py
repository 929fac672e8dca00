"""Sessions of all users against the same steps in plain Python, one user after the other."""

import random
from datetime import datetime, timedelta

import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.operators import retrieval as r
from millrace.operators import sessions as se
from millrace.plans.keep import kept

NOW = datetime(2024, 3, 1, 12)
LIMITS = se.Limits(onboarding=4, behavior=4, breaking=3, popular=4, page=3, page_most=6)
ARMS = ("onboarding", "behavior", "breaking", "popular")
USERS = 60


@pytest.fixture(scope="module")
def world():
    draw = random.Random(4)
    news = {i: NOW - timedelta(hours=draw.choice([1, 2, 5, 20, 23, 25, 40, 70, 71, 90, 200]), minutes=draw.randrange(3)) for i in range(1, 61)}
    entities = sorted({(n, draw.choice(["stock", "keyword"]), str(draw.randrange(8))) for n in news for _ in range(3)})
    vectors = {(t, str(i)): [draw.uniform(-1, 1) for _ in range(3)] for t in ("stock", "keyword") for i in range(6)}
    snapshots = draw.sample(range(1, 61), 14)
    fallback = sorted(((draw.randrange(4) / 10, t, n) for n, t in news.items() if t >= NOW - timedelta(hours=72)), reverse=True)
    users = []
    for u in range(USERS):
        exclude = {n for n in news if draw.random() < draw.choice([0, 0.1, 0.5, 0.97, 1.0] if u % 3 else [0.1])}
        profile = [(t, str(draw.randrange(8)), 1.0) for t in draw.sample(["stock", "keyword"], draw.randrange(3))] if u % 4 else []
        if u % 11 == 3:
            profile = [("stock", "7", 1.0)]
        query = sorted({(t, str(draw.randrange(7))) for t in ("stock", "keyword") for _ in range(2)}) if u % 3 == 0 else []
        users.append({
            "id": u, "exclude": exclude, "profile": profile, "query": [(t, i, draw.uniform(0.2, 2), draw.randrange(1, 3)) for t, i in query],
            "seen": draw.sample(range(1, 61), 2) if u % 3 == 0 or u % 5 == 0 else [],
            "variant": draw.choice(["recommend"] * 4 + ["latest", "popular", "random"]), "state": draw.choice(["warm", "cold"]),
            "multipliers": {n: draw.choice([0.2, 0.5, 0.75]) for n in news if draw.random() < 0.2},
            "failed": {f for f in se.FAILURES if draw.random() < (0.15 if u % 2 else 0)} if u != 9 else set(se.FAILURES),
            "params": {p: (draw.uniform(0.3, 4), draw.uniform(0.5, 9)) for p in ARMS},
        })
    old = {n for n, t in news.items() if t < NOW - timedelta(hours=80)} - {*snapshots}
    users[12] |= {"exclude": {*news} - old, "variant": "recommend", "failed": set()}
    return news, entities, vectors, snapshots, fallback, users


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)


def ranked(pool, query, boosted, boost, limit, world):
    """Candidates by score, time and id; as they come where no entity has a vector."""
    news, entities, vectors, *_ = world
    if not pool or not query:
        return [(n, None) for n in pool[:limit]]
    held = {n: [(t, i) for m, t, i in entities if m == n] for n in pool}
    if not any((t, i) in vectors for t, i, *_ in query) and not any(e in vectors for n in pool for e in held[n]):
        return [(n, None) for n in pool[:limit]]
    out = []
    for n in pool:
        known, score = [e for e in held[n] if e in vectors], 0.0
        for t, i, weight, *_ in query:
            if (t, i) in vectors:
                sims = [cosine(vectors[t, i], vectors[e]) * (0.9 if e[0] != t else 1.15 if t == "stock" else 1.0) for e in known]
                score += weight * max([0.0, *sims])
        out.append((score + boost * sum(t == "stock" and i in boosted for t, i in known), news[n], n))
    return [(n, s) for s, _, n in sorted(out, reverse=True)[:limit]]


def latest_of(limit, blocked, newest):
    return [n for n in newest[: 4 * limit] if n not in blocked][:limit]


def popular_of(limit, blocked, world):
    shown = [n for n in world[3] if n not in blocked][: 4 * limit]
    if len(shown) < limit // 2:
        shown += [n for _, _, n in world[4] if n not in blocked and n not in shown][: 4 * limit - len(shown)]
    return shown[:limit]


def plain(user, world, limits, mix):
    """(source, fallback_used, reason, [(news, path)])."""
    news = world[0]
    newest = sorted(news, key=lambda n: (news[n], n), reverse=True)
    within = lambda hours: [n for n in newest if news[n] >= NOW - timedelta(hours=hours)]
    fetch = lambda limit, hours, blocked: [n for n in within(hours)[: 4 * limit] if n not in blocked][:limit]
    x, failed = user["exclude"], user["failed"]
    if user["variant"] != "recommend":
        v, path, reason = user["variant"], user["variant"], None
        if v == "latest":
            items = latest_of(limits.page_most, x, newest)
        elif v == "popular":
            items = popular_of(max(limits.popular, limits.page), x, world)
        else:
            items = {*fetch(max(limits.page_most, 4 * limits.page), 72, x)}
        if not items and v != "latest":
            items, path, reason = latest_of(limits.page, x, newest), "latest", f"{v}_pool_empty"
        return f"ab_{v}_{user['state']}", reason is not None, reason, [(n, path) for n in items]
    has_actions, onboarding_failed, behavior_failed = bool(user["seen"]), "onboarding_failed" in failed, "behavior_failed" in failed and bool(user["seen"])
    base, onboarding, behavior, insufficient = [], [], [], False
    if "base_failed" in failed:
        onboarding_failed, behavior_failed = True, behavior_failed or has_actions
    else:
        base = fetch(4 * max(limits.onboarding, limits.behavior), 72, x)
    if not onboarding_failed and user["profile"]:
        onboarding = ranked(base, user["profile"], {i for t, i, _ in user["profile"] if t == "stock"}, 0.35, limits.onboarding, world)
    if has_actions and not behavior_failed:
        pool = [n for n in base if n not in dict(onboarding) and n not in user["seen"]]
        if not user["query"]:
            behavior, insufficient = [(n, None) for n in pool[: limits.behavior]], True
        else:
            repeated = {i for t, i, _, k in user["query"] if t == "stock" and k > 1}
            behavior = [(n, s) for n, s in ranked(pool, user["query"], repeated, 0.2, limits.behavior, world) if (s or 0) >= limits.least]
    taken = x | {n for n, _ in onboarding + behavior}
    breaking = [] if "breaking_failed" in failed else [(n, None) for n in fetch(limits.breaking, 24, taken)]
    taken |= {n for n, _ in breaking}
    popular = [] if "popular_failed" in failed else [(n, None) for n in popular_of(limits.popular, taken, world)]
    if limits.replenish > len(breaking):
        more = fetch(limits.breaking, 24, x | {n for n, _ in behavior + breaking})
        added = more[::-1][: min(limits.replenish, limits.breaking) - len(breaking)]
        onboarding = [e for e in onboarding if e[0] not in added]
        breaking = (breaking + [(n, None) for n in more if n in added])[: limits.breaking]
    flags = [(onboarding_failed, "onboarding_failed"), (behavior_failed, "behavior_failed"), ("breaking_failed" in failed, "breaking_failed"), ("popular_failed" in failed, "popular_failed"), (insufficient, "behavior_insufficient")]
    if onboarding or behavior:
        used, reason = any(f for f, _ in flags[:4]), next((w for f, w in flags if f), None)
    elif breaking or popular:
        cold = not user["profile"] and not has_actions and not any(f for f, _ in flags[:4])
        used, reason = not cold, None if cold else "primary_failed_use_exploration"
    elif "latest_failed" in failed:
        used, reason = True, "db_failed"
    else:
        used, reason = True, "retrieval_failed"
        onboarding = [(n, None) for n in latest_of(limits.onboarding + limits.behavior + limits.breaking, x, newest)]
    lists = {}
    for path, entries in zip(ARMS, (onboarding, behavior, breaking, popular)):
        keyed = [((len(entries) - i if s is None else s) * user["multipliers"].get(n, 1.0), -i, n) for i, (n, s) in enumerate(entries)]
        lists[path] = [n for *_, n in sorted(keyed, reverse=True)]
    timeline = mix(lists, user)
    reason = reason or ("user_signal_lookup_failed" if "lookup_failed" in failed else None if user["profile"] else "profile_missing")
    if timeline:
        return f"multipath_{user['state']}", used, reason, timeline
    return "latest_fallback", True, reason or "empty_result", [(n, "latest") for n in latest_of(limits.page, x, newest)]


def fixed(lists, _user):
    out, seen, at = [], set(), dict.fromkeys(ARMS, 0)
    while any(at[p] < len(lists[p]) for p in ARMS):
        for p, weight in zip(ARMS, (2, 2, 1, 1)):
            for n in lists[p][at[p] : at[p] + weight]:
                if n not in seen:
                    out.append((n, p))
                    seen.add(n)
            at[p] += weight
    inside = [i for i in range(min(10, len(out))) if out[i][1] == "breaking"]
    late = [i for i in range(10, len(out)) if out[i][1] == "breaking"]
    if not inside and late:
        i = max(i for i in range(10) if out[i][1] != "breaking")
        out[i], out[late[0]] = out[late[0]], out[i]
    return out


def by_draw(draw, batch=20, least=2):
    def mix(lists, user):
        out, at = [], dict.fromkeys(ARMS, 0)
        while any(at[p] < len(lists[p]) for p in ARMS):
            if len(out) % batch == 0:
                counts = dict.fromkeys(ARMS, 0)
            scores = [(draw(user, len(out), i) + (1e6 if counts[p] < least else 0), -i) for i, p in enumerate(ARMS) if at[p] < len(lists[p])]
            p = ARMS[-max(scores)[1]]
            out.append((lists[p][at[p]], p))
            at[p] += 1
            counts[p] += 1
        return out

    return mix


def built(spark, world, limits, allocator):
    news, entities, vectors, snapshots, fallback, users = world
    articles = spark.createDataFrame(list(news.items()), "news_id long, pub_date timestamp_ntz")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = se.pools(articles, frame([(n, i) for i, n in enumerate(snapshots)], "news_id long, rank int"), frame([(n, c, t) for c, t, n in fallback], "news_id long, ctr double, pub_date timestamp_ntz"), str(NOW), limits, kept)
    signals = se.Signals(
        frame([(u["id"],) for u in users if u["profile"]], "user_id long"), frame([(u["id"], *e) for u in users for e in u["profile"]], "user_id long, type string, id string, weight double"),
        frame([(u["id"], *e) for u in users for e in u["query"]], "user_id long, type string, id string, weight double, frequency long"), frame([(u["id"], n) for u in users for n in u["seen"]], "user_id long, news_id long"),
    )
    failures = frame([(u["id"], *[f in u["failed"] for f in se.FAILURES]) for u in users if u["failed"]], "user_id long, " + ", ".join(f"{f} boolean" for f in se.FAILURES))
    return se.sessions(
        frame([(u["id"], u["variant"], u["state"]) for u in users], "user_id long, variant string, state string"), frame([(u["id"], n) for u in users for n in u["exclude"]], "user_id long, news_id long"),
        frame([(u["id"], n, m) for u in users for n, m in u["multipliers"].items()], "user_id long, news_id long, multiplier double"), signals,
        frame(entities, "news_id long, type string, id string"), frame([(t, i, v) for (t, i), v in vectors.items()], "type string, id string, vector array<double>"), found, kept,
        frame([(u["id"], p, *ab) for u in users for p, ab in u["params"].items()], "user_id long, path string, alpha double, beta double"), failures, limits, allocator,
    )


def mean(user, _slot, arm):
    a, b = user["params"][ARMS[arm]]
    return a / (a + b)


@pytest.mark.parametrize("allocator, mix, limits", [("fixed", fixed, LIMITS), ("mean", by_draw(mean), LIMITS._replace(replenish=3))])
def test_sessions_equal_those_of_each_user_alone(spark, world, allocator, mix, limits):
    sessions, timelines = built(spark, world, limits, allocator)
    rows = {}
    for t in timelines.orderBy("user_id", "pos").collect():
        rows.setdefault(t.user_id, []).append((t.news_id, t.path))
    outcomes = {x.user_id: x for x in sessions.collect()}
    assert len(outcomes) == USERS
    reasons = set()
    for user in world[5]:
        source, used, reason, timeline = plain(user, world, limits, mix)
        got = outcomes[user["id"]]
        own = rows.get(user["id"], [])
        if user["variant"] == "random":
            own, timeline = sorted(own), sorted(timeline)
        assert (got.source, got.fallback_used, got.fallback_reason, own) == (source, used, reason, timeline), user
        assert got.items == len(timeline)
        reasons.add(reason)
    assert {"onboarding_failed", "behavior_insufficient", "primary_failed_use_exploration", "retrieval_failed", "profile_missing", None} <= reasons
    assert "db_failed" in reasons or limits.replenish


def uniform(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64((int(p) & (1 << 64) - 1).to_bytes(8, "little"), seed=h).intdigest()
    return ((h >> 11) + 0.5) / 2**53


def gamma(shape, *parts):
    from math import cos, log, pi, sqrt

    raised = shape + 1 if shape < 1 else shape
    d = raised - 1 / 3
    c, out = 1 / sqrt(9 * d), d
    for i in range(r.TRIES):
        u, v, w = (uniform(*parts, i, k) for k in range(3))
        x = sqrt(-2 * log(u)) * cos(2 * pi * v)
        cube = (1 + c * x) ** 3
        if cube > 0 and log(w) < 0.5 * x * x + d - d * cube + d * log(cube):
            out = d * cube
            break
    return out * uniform(*parts, r.TRIES, 0) ** (1 / shape) if shape < 1 else out


def sampled(user, slot, arm):
    a, b = (gamma(v, 7, user["id"], slot, arm, k) for k, v in enumerate(user["params"][ARMS[arm]]))
    return a / (a + b)


def test_thompson_draws_equal_plain_python(spark, world):
    draw = random.Random(1)
    lists = {u["id"]: {p: draw.sample(range(1000), draw.randrange(0, 25)) for p in ARMS} for u in world[5][:12]}
    rows = [(u, p, i, n) for u, of in lists.items() for p, ns in of.items() for i, n in enumerate(ns)]
    params = spark.createDataFrame([(u["id"], p, *ab) for u in world[5][:12] for p, ab in u["params"].items()], "user_id long, path string, alpha double, beta double")
    mixed = r.thompson_mix(spark.createDataFrame(rows, "user_id long, path string, pos long, news_id long"), params)
    assert "Python" not in mixed._jdf.queryExecution().executedPlan().toString()
    got = {}
    for x in mixed.orderBy("user_id", "pos").collect():
        got.setdefault(x.user_id, []).append((x.news_id, x.path))
    assert got == {u["id"]: by_draw(sampled)(lists[u["id"]], u) for u in world[5][:12] if any(lists[u["id"]].values())}


def test_gamma_draws_have_the_distribution(spark):
    frame = spark.range(20000).select(*[r.gamma_draw(F.lit(a), 3, F.col("id"), i).alias(f"g{i}") for i, a in enumerate((0.4, 1.0, 5.0, 200.0))])
    told = frame.agg(*[f(f"g{i}") for i in range(4) for f in (F.avg, F.variance)]).first()
    for i, a in enumerate((0.4, 1.0, 5.0, 200.0)):
        assert abs(told[2 * i] - a) < 5 * (a / 20000) ** 0.5 and 0.9 < told[2 * i + 1] / a < 1.1


def test_pools_make_no_rows_of_users_times_news(spark):
    users = spark.range(1000).withColumnRenamed("id", "user_id")
    articles = spark.range(500).select(F.col("id").alias("news_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("pub_date"))
    exclude = spark.createDataFrame([(1, 499), (1, 480), (2, 3)], "user_id long, news_id long")
    found = r.recent_candidates(articles, users, exclude, str(NOW), 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "LeftAnti" not in plan
    got = {u: [x.news_id for x in found.filter(F.col("user_id") == u).orderBy("rank").collect()] for u in (0, 1, 2)}
    assert got[0] == got[2] == list(range(499, 479, -1)) and got[1] == [n for n in range(498, 477, -1) if n != 480]


def test_latest_ids_takes_the_offset_before_exclusions(spark):
    articles = spark.range(30).select(F.col("id").alias("news_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("pub_date"))
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    exclude = spark.createDataFrame([(1, n) for n in range(16, 30)] + [(2, 26)], "user_id long, news_id long")
    rows = r.latest_ids(articles, users, exclude, 2, 3).orderBy("user_id", "pos").collect()
    assert [(x.user_id, x.news_id, x.pos) for x in rows] == [(2, 25, 0), (2, 24, 1)]  # of user 1 the eight that are fetched are all excluded


def test_nothing_kept_has_rows_of_users_times_news(spark, world, monkeypatch):
    """Frames that are written hold a user's exclusions and scored lists, not the pools' lists nor a row for each candidate."""
    written = []
    monkeypatch.setitem(globals(), "kept", lambda frame: written.append(kept_(frame)) or written[-1])
    built(spark, world, LIMITS, "mean")
    assert written and not any({"newest", "base"} & {*x.columns} or {"user_id", "news_id", "rank"} <= {*x.columns} for x in written)


kept_ = kept
