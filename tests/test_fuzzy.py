"""Fuzzy hashes and what is built on them, against plain Python written from the definitions."""

import random
import uuid
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlark.functions.fuzzy import PIECE_PRIME, PIECE_START, ALPHABET, compare_hashes, compare_many, hash_bytes
from flowlark.operators import fuzzy_clusters as C
from flowlark.operators import trends as T
from flowlark.plans import fuzzy_queries as Q

DIR = "/root/testdata/sf0.001"


def slow_hash(data: bytes) -> str:
    """Byte by byte with full 32-bit states."""
    full = 0xFFFFFFFF

    def run(block, longest):
        out, state, count, last, since = [], PIECE_START, 0, None, []
        window, h1, h2, h3 = [0] * 7, 0, 0, 0
        for n, c in enumerate(data):
            h2 = h2 - h1 + 7 * c & full
            h1 = h1 + c - window[n % 7] & full
            window[n % 7] = c
            h3 = (h3 << 5 & full) ^ c
            state = (state * PIECE_PRIME & full) ^ c
            if (h1 + h2 + h3 & full) % block == block - 1:
                last = ALPHABET[state & 63]
                if len(out) < longest - 1:
                    out.append(last)
                    state, last = PIECE_START, None
                    count += 1
        tail = ALPHABET[state & 63] if h1 + h2 + h3 & full else (last or "")
        return "".join(out) + tail, count

    block = 3
    while block * 64 < len(data):
        block *= 2
    while True:
        first, count = run(block, 64)
        if block > 3 and count < 32:
            block //= 2
        else:
            return f"{block}:{first}:{run(2 * block, 32)[0]}"


@pytest.mark.parametrize("seed", range(30))
def test_hash_equals_byte_by_byte(seed):
    r = random.Random(seed)
    data = bytes(r.choice(b"0123456789abcdef:") for _ in range(r.choice([1, 6, 7, 50, 300, 4000, 9000])))
    data += bytes(r.choice([0, 9]))
    assert hash_bytes(data) == slow_hash(data)


def test_hash_of_nothing_and_likeness():
    assert hash_bytes(b"") == "3::"
    r = random.Random(1)
    text = " ".join(str(r.random()) for _ in range(400))
    a, b, c = hash_bytes(text.encode()), hash_bytes((text[:3000] + "changed" + text[3000:]).encode()), hash_bytes(" ".join(str(r.random()) for _ in range(400)).encode())
    assert compare_hashes(a, a) == 100 and 50 < compare_hashes(a, b) < 100 and compare_hashes(a, c) == 0
    assert compare_hashes("3:aaaaaaaaab:x", "3:aaab:x") == 100 and compare_hashes("3:abc:x", "12:abc:x") == 0


def test_pairs_side_by_side_are_those_one_by_one():
    r = random.Random(9)
    base = [bytes(r.choices(b"abcdefgh \n", k=r.choice([0, 5, 40, 300, 2000, 7000]))) for _ in range(12)]
    hashes = [hash_bytes(b[: r.randrange(len(b) + 1)] + bytes(r.choices(b"xyz", k=r.choice([0, 3, 200]))) + b[r.randrange(len(b) + 1) :]) for b in base for _ in range(12)]
    hashes += ["3:AAAA:B", "3:AAAAA:B", "3::", "6:abcdefg:abcdefgh", "12:abcdefgh:x", "3:äöüäöüäöü:x", "3:" + "Ab" * 50 + ":x", "96:" + "aB" * 32 + ":" + "aB" * 32, "96:" + "aB" * 31 + "cc:" + "aB" * 32]
    pairs = [(x, y) for x in hashes for y in r.sample(hashes, 30)]
    got = compare_many(*map(list, zip(*pairs)))
    assert got == [compare_hashes(x, y) for x, y in pairs] and 50 < sum(g > 0 for g in got)
    assert compare_many([], []) == []


def rows(n, seed):
    """Payloads of a few families, in two parts."""
    r = random.Random(seed)
    words = [str(r.random()) for _ in range(5000)]
    base = [[r.choice(words) for _ in range(120)] for _ in range(8)]
    out = []
    for part in ("p", "q"):
        for idx in range(n):
            for pos in range(r.choice([1, 1, 2, 3, 5, 6])):
                text = list(r.choice(base))
                for _ in range(r.choice([0, 5, 25, 80])):
                    text[r.randrange(120)] = r.choice(words)
                out.append((part, idx, pos, hash_bytes(" ".join(text).encode())))
    return out


def brute_clusters(payloads, threshold):
    by = defaultdict(lambda: defaultdict(list))
    for part, idx, pos, h in sorted(payloads):
        by[part][idx].append(h)
    found = {}
    for part, sessions in by.items():
        used = {}
        for idx in sorted(sessions):
            if idx in used:
                continue
            own = sessions[idx]
            n = len(own)
            q = [int(n * 0.25), int(n * 0.5), int(n * 0.75)]
            places = [q[0]] if q[1] == q[0] else q[:2] if q[2] == q[1] else q if n <= 4 else [*q, n - 1]
            members = [c for c in sessions if c != idx and c not in used and any(sum(compare_hashes(own[i], h) for i in places) / len(places) > threshold for h in sessions[c])]
            if members:
                used |= dict.fromkeys([idx, *members], idx)
        found |= {(part, idx): used.get(idx) for idx in sessions}
    return found


@pytest.mark.parametrize(("threshold", "few", "one"), [(0.0, 4, 100_000), (0.0, 0, 0), (30.0, 10**9, 20), (30.0, 0, 0)])
def test_clusters_equal_the_sequential_ones(spark, monkeypatch, threshold, few, one):
    """As links in one task, as a graph of nodes, as rows of links that shrink until they fit a task."""
    monkeypatch.setattr(C, "FEW_LINKS", few)
    monkeypatch.setattr(C, "ONE_TASK", one)
    payloads = rows(25, int(threshold))
    df = spark.createDataFrame(payloads, "part string, idx long, pos int, hash string")
    got = {(r.part, r.idx): r.leader for r in C.leader_clusters(df, threshold).collect()}
    assert got == brute_clusters(payloads, threshold)
    assert any(v is not None for v in got.values())


def test_no_payloads(spark):
    none = spark.createDataFrame([], "part string, idx long, pos int, hash string")
    assert C.leader_clusters(none).count() == 0 and C.average_linkage(none.select("part", "idx", "hash")).count() == 0
    lone = spark.createDataFrame([("p", 1, 0, "3:abc:x"), ("p", 2, 0, None)], "part string, idx long, pos int, hash string")
    assert [tuple(r) for r in C.leader_clusters(lone).collect()] == [("p", 1, None)]


def test_tree_equals_one_merge_after_the_other(spark):
    hashes = sorted({h: (part, idx, h) for part, idx, pos, h in rows(20, 5) if part == "p"}.values())
    hashes = [("p", i, h) for i, (_, _, h) in enumerate(hashes)]
    got = sorted((round(r.distance, 9), r.size) for r in C.average_linkage(spark.createDataFrame(hashes, "part string, idx long, hash string")).collect())
    groups, want = {i: [h] for _, i, h in hashes}, []
    while True:
        best = min((100 - sum(compare_hashes(x, y) for x in groups[a] for y in groups[b]) / len(groups[a]) / len(groups[b]), a, b) for a in groups for b in groups if a < b)
        if best[0] == 100:
            break
        groups[best[1]] += groups.pop(best[2])
        want.append((round(best[0], 9), len(groups[best[1]])))
    assert got == sorted(want) and got


def test_trends_equal_a_fold_over_days(spark):
    payloads = [(("x", Q.DAYS[idx % 3]), idx, pos, h) for part, idx, pos, h in rows(40, 9) if part == "p"]
    df = spark.createDataFrame(payloads, "part struct<proto: string, date: string>, idx long, pos int, hash string")
    got = {(r.date, r.leader): r.trend for r in T.trends(C.leader_clusters(df), df, Q.DAYS).collect()}
    sessions = defaultdict(list)
    for part, idx, pos, h in sorted(payloads):
        sessions[idx].append(h)
    members = defaultdict(list)
    for (part, idx), leader in brute_clusters(payloads, 0.0).items():
        if leader is not None and leader != idx:
            members[part[1], leader].append(idx)
    middle = {idx: hs[int(len(hs) * 0.5)] for idx, hs in sessions.items()}
    want, known = {}, []
    for day in Q.DAYS:
        new = []
        for date, leader in sorted(members):
            if date == day:
                best = max(((max(compare_hashes(middle[leader], h) for h in hs), -i, t) for i, (t, hs) in enumerate(known)), default=(0, 0, None))
                want[day, leader] = best[2] if best[0] >= 1 else f"{day}_{leader}"
                if best[0] < 1:
                    new.append((f"{day}_{leader}", [middle[leader], middle[max(members[day, leader])]]))
        known += new
    assert got == want and len(set(want.values())) < len(want)


def test_a_trend_goes_on_by_clusters_that_joined(spark):
    r = random.Random(2)
    words = [str(r.random()) for _ in range(300)]
    hashes = [hash_bytes(" ".join(words[i : i + 120]).encode()) for i in (0, 60, 120)]
    assert compare_hashes(hashes[0], hashes[1]) > 0 and compare_hashes(hashes[1], hashes[2]) > 0 and compare_hashes(hashes[0], hashes[2]) == 0
    payloads = spark.createDataFrame([(("x", Q.DAYS[n]), 10 * n + i, 0, h) for n, h in enumerate(hashes) for i in (1, 2, 3)], "part struct<proto: string, date: string>, idx long, pos int, hash string")
    clusters = C.leader_clusters(payloads)
    found = T.trends(clusters, payloads, Q.DAYS)
    first = f"{Q.DAYS[0]}_1"
    assert {(x.date, x.leader, x.trend) for x in found.collect()} == {(day, 10 * n + 1, first) for n, day in enumerate(Q.DAYS)}
    sessions = payloads.selectExpr("part", "idx", "idx * 7 as session_time", "'c' as country", "concat('10.0.0.', idx) as ip_src")
    events = {tuple(x) for x in T.trend_events(found, clusters, sessions).collect()}
    assert events == {("x", first, day, 10 * n + 1, 10 * n + i, 7 * (10 * n + i), "c", f"10.0.0.{10 * n + i}") for n, day in enumerate(Q.DAYS) for i in (1, 2, 3)}
    assert sorted((x.date, x.hash) for x in T.trend_hashes(found, clusters, payloads).collect()) == sorted(zip(Q.DAYS, hashes, strict=True))


def test_representatives_of_documents(spark):
    heads = Q.rep_hash(spark, DIR).collect()
    found = Q.clusters(spark, DIR).collect()
    want = {(r.proto, r.date, r.idx) for r in found if r.leader is None or r.leader == r.idx}
    assert {(r.proto, r.date, r.idx) for r in heads} == want and len(heads) == len(want)
    assert all(("_L_" in r.name) == (r.kind == "L") for r in heads)


def test_xml_file_round_trip(spark, tmp_path):
    from flowlark.operators import report

    rows = spark.createDataFrame([("g", 2, "B & C", "x_1_http"), ("g", 1, None, "x_1_http"), ("h", 3, "D", "y")], "group_id string, ip long, country string, cluster string").selectExpr("*", "cluster as protocol")
    report.write_group_xml(rows.coalesce(1), str(tmp_path / "out"))
    got = {r.group_id: r for r in report.read_group_xml(spark, str(tmp_path / "out")).collect()}
    assert got["g"].src_ip == ["1", "2"] and got["g"].group_country == ["B & C"] and got["h"].cluster_id == ["y"] and got["g"].number_of_clusters == 1


def test_places_are_counted_without_rows_that_have_no_hash(spark):
    """A session whose only hash stands behind rows without one leads, and is a named loner where it finds nobody."""
    r = random.Random(8)
    h, other = (hash_bytes(bytes(r.choices(b"abcdefgh ", k=3000))) for _ in range(2))
    rows = [("p", 1, 0, None), ("p", 1, 1, None), ("p", 1, 2, h), ("p", 2, 0, h), ("p", 3, 0, None), ("p", 3, 5, other)]
    payloads = spark.createDataFrame(rows, "part string, idx long, pos int, hash string")
    found = C.leader_clusters(payloads)
    assert {x.idx: x.leader for x in found.collect()} == {1: 1, 2: 1, 3: None}
    sessions = payloads.selectExpr("part", "idx", "'x' as proto", "'d' as date", "'c' as country", "'m' as domain", "'1.1.1.1' as ip_src").distinct()
    heads = C.representatives(found, payloads, sessions, spark.createDataFrame([], "part string, limit long")).collect()
    assert {(x.idx, x.kind, x.hash) for x in heads} == {(1, "", h), (3, "L", other)}


def test_very_many_sessions_of_one_payload(spark):
    """Rows of every table grow with the payloads, not with their pairs."""
    from pyspark.sql import functions as F

    r = random.Random(3)
    hot, near, far = bytes(r.choices(b"abcdefgh ", k=3000)), None, bytes(r.choices(b"xyz12345 ", k=3000))
    near = hot[:2500] + b"something else"
    n = 100_000
    hashes = {0: hash_bytes(hot), 1: hash_bytes(near), 2: hash_bytes(far)}
    of = F.when(F.col("id") % 1000 == 999, hashes[2]).when(F.col("id") % 100 == 1, hashes[1]).otherwise(hashes[0])
    payloads = spark.range(n).select(F.lit("p").alias("part"), F.col("id").alias("idx"), F.lit(0).alias("pos"), of.alias("hash"))
    got = {(x.leader, x["count"]) for x in C.leader_clusters(payloads).groupBy("leader").count().collect()}
    assert got == {(0, n - n // 1000), (999, n // 1000)}
    tree = C.average_linkage(payloads.select("part", "idx", "hash"))
    assert tree.where("distance = 0").count() == n - 3 and tree.where("distance > 0").count() == 1


def test_hashes_that_share_one_run_of_characters(spark):
    """Thousands of unlike hashes with seven characters in common find each other through these."""
    r = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hashes = ["96:" + "".join(r.choices(letters, k=20)) + "hotgram" + "".join(r.choices(letters, k=20)) + ":" + "".join(r.choices(letters, k=10)) for _ in range(5000)]
    assert compare_hashes(hashes[0], hashes[1]) > 0
    payloads = spark.createDataFrame([("p", i, 0, h) for i, h in enumerate(hashes)], "part string, idx long, pos int, hash string")
    assert {x.leader for x in C.leader_clusters(payloads).collect()} == {0}


@pytest.mark.parametrize("threshold", [0.0, 30.0])
def test_sessions_with_the_same_payloads(spark, threshold):
    """Several sessions of each list of payloads, also of lists that don't find themselves above the threshold."""
    r = random.Random(int(threshold) + 11)
    lists = [[h for _, i, _, h in sorted(rows(12, 21)) if i == n] for n in range(12)]
    lists += [[hash_bytes(bytes(r.choices(range(256), k=2500))) for _ in range(4)] for _ in range(3)]
    payloads = [("p", idx, pos, h) for idx in range(50) for pos, h in enumerate(r.choice(lists))]
    got = {(x.part, x.idx): x.leader for x in C.leader_clusters(spark.createDataFrame(payloads, "part string, idx long, pos int, hash string"), threshold).collect()}
    assert got == brute_clusters(payloads, threshold)


def fold_days(clusters, middle, order):
    """Trends of one protocol as the definition tells them: a dictionary of hash lists, brought on day by day."""
    hashes, placed = {}, {}
    for day in sorted({d for d, _ in clusters}):
        before, new = {k: list(v) for k, v in hashes.items()}, {}
        todays = sorted(((leader, members) for (d, leader), members in clusters.items() if d == day), key=lambda x: (-len(x[1]), x[0]))
        for leader, members in todays:
            own = [middle[leader], middle[order(members)[-1]], middle[max(members)]]
            score = {k: max(compare_hashes(middle[leader], h) for h in v) for k, v in before.items()}
            best = max(score.values(), default=0)
            if best < 1:
                new[f"{day}_{leader}"] = own
                placed[day, leader] = f"{day}_{leader}"
            else:
                first = next(k for k in score if score[k] == best)
                hashes[first] = hashes[first] + own
                placed[day, leader] = first
        hashes.update(new)
    return placed


def trend_rows(seed, days=("20200106", "20200107", "20200108", "20200109")):
    """Clusters of sessions over days, made so that trends drift, part and tie; ``place`` is an order of members other than idx."""
    r = random.Random(seed)
    words = [str(r.random()) for _ in range(400)]
    payloads, members = [], []
    for day in days:
        for c in range(7):
            leader = 1000 * int(day[-1]) + 20 * c
            begin = r.choice([0, 40, 80, 120, 160, 200])
            size = r.choice([1, 2, 2, 4])
            places = r.sample(range(50), size)
            for i in range(size + 1):
                text = " ".join(words[begin + r.choice([0, 0, 30]) :][:120])
                payloads.append((("x", day), leader + i, 0, hash_bytes(text.encode())))
                members.append((("x", day), leader + i, leader, None if i == 0 else places[i - 1]))
    return payloads, members


PART = "part struct<proto: string, date: string>"


@pytest.mark.parametrize("seed", range(3))
def test_trends_as_a_dictionary_of_lists(spark, seed):
    payloads, members = trend_rows(seed)
    middle = {idx: h for _, idx, _, h in payloads}
    clusters, place = defaultdict(list), {}
    for (_, day), idx, leader, p in members:
        if idx != leader:
            clusters[day, leader].append(idx)
            place[idx] = p
    p = spark.createDataFrame(payloads, f"{PART}, idx long, pos int, hash string")
    c = spark.createDataFrame(members, f"{PART}, idx long, leader long, place int")
    days = sorted({d for d, _ in clusters})
    got = {(x.date, x.leader): x.trend for x in T.trends(c, p, days).collect()}
    assert got == fold_days(clusters, middle, lambda m: sorted(m, key=place.get)) and len(set(got.values())) < len(got)
    assert {(x.date, x.leader): x.trend for x in T.trends(c.drop("place"), p, days).collect()} == fold_days(clusters, middle, sorted)


def test_trends_as_a_stream_of_days(spark, tmp_path):
    """Stopped between days, days that come again, a day in two parts and late ones end like all days at once."""
    payloads, members = trend_rows(7)
    p, c = spark.createDataFrame(payloads, f"{PART}, idx long, pos int, hash string"), spark.createDataFrame(members, f"{PART}, idx long, leader long, place int")
    heads = T.trend_heads(c, p).cache()
    days = sorted(r.date for r in heads.select("date").distinct().collect())
    want = {tuple(x) for x in T.trends(c, p, days).collect()}
    got = lambda: {tuple(x) for x in T.stored_trends(spark, f"{tmp_path}/state").collect()}

    def arrive(df):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/heads")
        source = spark.readStream.schema(heads.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/heads")
        T.follow(source, f"{tmp_path}/state", f"{tmp_path}/checkpoint").awaitTermination()

    arrive(heads.where(f"date = '{days[0]}'"))
    assert got() == {x for x in want if x[1] == days[0]}
    arrive(heads.where(f"date = '{days[2]}' and leader % 40 = 0"))
    arrive(heads.where(f"date = '{days[2]}' and leader % 40 <> 0"))
    arrive(heads.where(f"date = '{days[1]}'"))  # late: the third day is placed anew
    assert got() == {x for x in want if x[1] < days[3]}
    arrive(heads.where(f"date = '{days[3]}'"))
    arrive(heads.where(f"date = '{days[1]}'"))  # again
    assert got() == want
    last = spark.read.parquet(f"{tmp_path}/state/heads").selectExpr("max(version)").first()[0]
    T.fold(heads.where(f"date = '{days[1]}'"), last, f"{tmp_path}/state")  # the last batch once more, as after a failure
    T.fold(heads.limit(0), last + 1, f"{tmp_path}/state")
    assert got() == want


def test_sevens_of_hashes_are_never_broadcast(spark):
    rows = [("p", f"3:{a}CDEFGHIJKLMNO{b}:") for a in "ABX" for b in "PQ"] + [("q", "3:ACDEFGHIJKLMNOP:"), ("p", None)]
    df = spark.createDataFrame(rows, "part string, hash string")
    found = C.alike(df, df)
    met = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "gram" in line]
    assert met and all("SortMergeJoin" in line for line in met)
    known = sorted({r for r in rows if r[1]})
    wanted = {(p, a, b): s for p, a in known for q, b in known if p == q and (s := compare_hashes(a, b)) > 0}
    assert {(r.part, r.a, r.b): r.score for r in found.collect()} == wanted


def test_hashes_of_other_addresses_are_not_scored(spark, monkeypatch, tmp_path):
    """Each pair of one address is scored once, whichever way it links."""

    @F.pandas_udf("int")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        (tmp_path / uuid.uuid4().hex).write_text(str(len(a)))
        return pd.Series([compare_hashes(x, y) for x, y in zip(a, b, strict=True)])

    monkeypatch.setattr(C, "fuzzy_compare", counted)
    r = random.Random(8)
    body = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=40))
    hashes = [f"96:{body[:i]}{i % 10}{body[i:]}:{body[i:]}" for i in range(40)]
    payloads = spark.createDataFrame([("p", i, 0, h) for i, h in enumerate(hashes)] + [("p", 40, 0, hashes[0]), (None, 41, 0, hashes[0])], "part string, idx int, pos int, hash string")
    sessions = spark.createDataFrame([("p", i, f"10.0.0.{i % 8}") for i in range(41)] + [(None, 41, "10.0.0.0")], "part string, idx int, ip_src string")
    got = {(x.part, x.a, x.b, x.ip_src) for x in C.same_address_links(payloads, sessions).collect()}
    all_ = [*hashes, hashes[0]]
    assert got == {("p", a, b, f"10.0.0.{a % 8}") for a in range(41) for b in range(41) if a != b and a % 8 == b % 8 and compare_hashes(all_[a], all_[b]) > 0}
    assert len(got) == 8 * 5 * 4 + 10
    assert sum(int(x.read_text()) for x in tmp_path.iterdir()) == 8 * 10


@pytest.mark.parametrize(("chunk", "seed"), [(40, 1), (150, 2), (1, 3), (1 << 20, 4)])
def test_turns_taken_in_chunks(spark, monkeypatch, chunk, seed):
    """Dense and sparse links, in chunks so small that those outside a chunk are taken within it."""
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
    r = random.Random(seed)
    payloads = []
    for part, letters, longest in (("p", "ABC", 11), ("q", "ABCD", 10), ("r", "ABCDEFGHIJ", 9)):
        for idx in r.sample(range(1000), 45 if chunk > 1 else 12):
            payloads += [(part, idx, pos, f"96:{''.join(r.choices(letters, k=r.randrange(7, longest)))}:") for pos in range(r.choice([1, 2, 2, 3, 5]))]
    got = {(x.part, x.idx): x.leader for x in C.leader_clusters(spark.createDataFrame(payloads, "part string, idx long, pos int, hash string")).collect()}
    assert got == brute_clusters(payloads, 0.0)


def test_a_chain_of_sessions_takes_no_round_each(spark, monkeypatch):
    """Each session shares characters with ten before and after it, so each leader waits for the one before."""
    monkeypatch.setattr(C, "FEW_LINKS", 0)
    written, write = [], C.kept
    monkeypatch.setattr(C, "kept", lambda df: written.append(1) or write(df))
    r = random.Random(6)
    long = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=1700))
    payloads = spark.createDataFrame([("p", i, 0, f"96:{long[5 * i : 5 * i + 60]}:") for i in range(319)], "part string, idx long, pos int, hash string")
    got = {x.idx: x.leader for x in C.leader_clusters(payloads).collect()}
    assert got == {i: i // 11 * 11 for i in range(319)}
    assert len(written) <= 30
