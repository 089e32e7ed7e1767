"""The training-data operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import bitsliced, bpe_trie, common, components, dartminhash, mixing, mpegts, quality_gbt, registry, secrets_ledger, substring, textkernel, toxicity, warc_merkle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WORDS = [f"w{i}" for i in range(400)]


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    base = text(rnd, 300)
    near = base.split()
    near[150] = "changed"
    shared = text(rnd, 60)
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", None, 0), (2, "   \n\t ", None, "a", 6), (3, base, "en", "a", 1), (4, base, "en", "b", 1), (5, " ".join(near), "en", "a", 1),
        (6, text(rnd, 80) + " " + shared + " " + text(rnd, 30), "en", "a", 1), (7, text(rnd, 20) + "\n" + shared.replace(" ", "\n") + " end", "en", "c", 1), (7, "another text of the same id", "en", "c", 1),
        (8, "short", "en", "a", 5), (9, "short", "en", "a", 5), (10, text(rnd, 20000), "en", "a", 1), (11, "é ß 漢字 \U0001f600 Σίσυφος password: hunter2hunter2 " + "ab" * 20, "en", "a", 1), (None, "no id", "en", "a", 5),
        (12, " ".join(["same"] * 400), "en", "b", 1), (12, " ".join(["same"] * 400), "en", "b", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("blob_note", F.lit("x"))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_with_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(c.execute(registry.ORACLE_SQL[name]).fetchdf())


# 1
def test_transport_stream_round_trip_and_damage():
    rnd = random.Random(1)
    for n in [0, 1, 63, 64, 65, 170, 175, 176, 184, 4095, 4096, 4097, 40000]:
        p = mpegts.padded(rnd.randbytes(n))
        media = mpegts.mux(p)
        s = mpegts.parse(media)
        assert b"".join(x.data for x in s.pes) == p and len(p) % 64 == 0 and len(p) >= 64
        assert not s.continuity_errors and not s.duplicates and s.programs == {1: 0x1000} and all(x.complete for x in s.pes)
    cut = bytearray(media)
    del cut[188 * 10 : 188 * 11]  # a packet is lost
    assert mpegts.parse(bytes(cut)).continuity_errors == 1
    twice = media[: 188 * 11] + media[188 * 10 : 188 * 11] + media[188 * 11 :]
    got = mpegts.parse(twice)
    assert got.duplicates == 1 and not got.continuity_errors and b"".join(x.data for x in got.pes) == p
    noise = mpegts.parse(b"\0" * 7 + media)
    assert noise.resyncs and b"".join(x.data for x in noise.pes) == p
    assert mpegts.parse(b"").packets == 0 and [x.pts for x in got.pes[:3]] == [0, 3600, 7200] and got.pes[8].random_access and not got.pes[7].random_access


def test_transport_stream_columns(spark, docs):
    got = mpegts.index_streams(mpegts.store(docs)).select("doc_id", "text", "media", "ts.*").collect()
    assert len(got) == docs.count()
    for r in got:
        raw = mpegts.padded((r["text"] or "").encode())
        assert b"".join(x.data for x in mpegts.parse(bytes(r["media"])).pes) == raw and sum(p["bytes"] for p in r["pes"]) == len(raw)
    assert mpegts.index_streams(docs.select(F.lit(None).cast("binary").alias("media"))).where("ts is null").count() == docs.count()


def plain_stream(media):
    """A parser of its own: one packet after another, by the bits of the standard."""
    units, counters, tables = [], {}, set()
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80 and not p[3] & 0xC0
        pid, start, control, counter = (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] >> 4 & 3, p[3] & 15
        assert control & 1 and counter == (counters.get(pid, counter - 1) + 1) % 16
        counters[pid] = counter
        body, access = p[4:], False
        if control & 2:
            access = body[0] > 0 and bool(body[1] & 0x40)
            body = body[1 + body[0] :]
        if pid != 0x100:
            section = body[1 + body[0] :]
            section = section[: 3 + ((section[1] & 15) << 8 | section[2])]
            crc = 0xFFFFFFFF
            for x in section[:-4]:
                for bit in range(7, -1, -1):
                    crc = (crc << 1 ^ (0x04C11DB7 if (crc >> 31) ^ (x >> bit & 1) else 0)) & 0xFFFFFFFF
            assert crc == int.from_bytes(section[-4:], "big")
            tables.add((pid, section[0], section[8:-4].hex()))
        elif start:
            assert body[:4] == b"\0\0\1\xbd" and body[7] == 0x80
            stamp = int.from_bytes(body[9:14], "big")
            units.append([(stamp >> 33 & 7) << 30 | (stamp >> 17 & 0x7FFF) << 15 | stamp >> 1 & 0x7FFF, access, body[4] << 8 | body[5], body[6:]])
        else:
            units[-1][3] += body
    for pts, access, length, body in units:
        assert len(body) == length
    return [(pts, access, body[3 + body[2] :]) for pts, access, _, body in units], tables


def test_transport_stream_query_against_a_parser_of_its_own(spark, sf):
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_transport_stream"](spark, sf).collect()}
    docs = common.table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        media = mpegts.mux(payload)
        units, tables = plain_stream(media)
        assert b"".join(u[2] for u in units) == payload and {t[:2] for t in tables} == {(0, 0), (0x1000, 2)}
        x = got[r["doc_id"]]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"], x["media_bytes"], x["media_sha256"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media))
        assert (x["packets"], x["continuity_errors"], x["units"], x["last_pts"], x["random_access_pts"]) == (len(media) // 188, 0, len(units), units[-1][0], [p for p, a, _ in units if a])
        assert [p for p, _, _ in units] == [3600 * i for i in range(len(units))] and [a for _, a, _ in units] == [i % 8 == 0 for i in range(len(units))]


def test_transport_stream_columns_of_an_empty_table(spark, docs):
    none = mpegts.index_streams(mpegts.store(docs.limit(0).withColumn("media", F.lit(1)).withColumn("ts", F.lit(1))))
    assert none.count() == 0 and none.columns.count("ts") == none.columns.count("media") == 1


# 2
def found(t):
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    out = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in out)


def test_secrets_against_brute_force(spark):
    rnd = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGHIJKL01", "0123456789abcdef", "é", "\U0001f600", "x" * 9, "--", "\n", "ſecret", "toKen"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + [None, "", "token=secret=longvalue12", "password=token:abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    got = {r["path"]: r["s"] for r in secrets_ledger.scan(df, common.shared_path(spark, "t")).select("path", secrets_ledger.joined(F.col("findings")).alias("s")).collect()}
    assert got == {i: found(t or "") for i, t in enumerate(texts)}


def test_ledger_scans_only_what_is_new(spark, docs):
    where = common.shared_path(spark, "t")
    paths = docs.withColumnRenamed("doc_id", "path")
    assert secrets_ledger.scan(paths, where).count() == docs.count()
    first = spark.read.parquet(where).count()
    assert first == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    more = paths.unionByName(paths.limit(1).withColumn("text", F.lit("token: abcdefghij")))
    assert secrets_ledger.scan(more, where).count() == docs.count() + 1 and spark.read.parquet(where).count() == first + 1
    secrets_ledger.scan(more, where, version="base-2")
    assert spark.read.parquet(where).count() == 2 * first + 2
    assert secrets_ledger.scan(paths.limit(0), where).count() == 0
    cut = secrets_ledger.scan(docs.where("doc_id = 11").withColumn("t", F.col("text")), where).select(secrets_ledger.redacted(F.col("t"), F.col("findings")).alias("t")).first()["t"]
    assert cut == "é ß 漢字 \U0001f600 Σίσυφος [SECRET] [SECRET]"


def test_history_of_versions(spark):
    root = common.shared_path(spark, "t")
    schema = "path string, version int, text string"
    first = spark.createDataFrame([("a", 1, "token: abcdefghij"), ("b", 1, "nothing"), ("c", 1, None)], schema).withColumn("findings", F.lit(1))
    assert secrets_ledger.commit(first, root) == 3 and secrets_ledger.commit(first, root) == 0
    blobs = lambda: spark.read.parquet(f"{root}/blobs").count()
    assert blobs() == 3
    second = spark.createDataFrame([("a", 2, "nothing"), ("d", 1, "token: abcdefghij"), ("b", 2, "secret=0123456789"), ("b", 1, "changed later"), (None, None, "nothing")], schema)
    assert secrets_ledger.commit(second, root) == 4 and secrets_ledger.commit(second, root) == 0 and blobs() == 4
    got = {(r["path"], r["version"]): r["s"] for r in secrets_ledger.report(spark, root).select("path", "version", secrets_ledger.joined(F.col("findings")).alias("s")).collect()}
    assert got == {("a", 1): "assign:0:17", ("a", 2): "", ("b", 1): "", ("b", 2): "assign:0:17", ("c", 1): "", ("d", 1): "assign:0:17", (None, None): ""}
    assert secrets_ledger.commit(first.limit(0), root) == 0
    assert secrets_ledger.report(spark, root, "another").where("findings is not null").count() == 0


def plain_redacted(t):
    out, at = [], 0
    for x in found(t).split(",") if found(t) else []:
        start, end = map(int, x.split(":")[1:])
        if start >= at:
            out += [t[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + t[at:]


def test_redaction_of_long_texts(spark):
    rnd = random.Random(31)
    parts = ["token: abcdefgh\U0001f600", "é" * 700, "AKIA" + "Z" * 20, "0123456789abcdef" * 70, "plain text\n", "secret=short ", "password='" + "ab12" * 9 + "' "]
    texts = ["".join(rnd.choice(parts) for _ in range(n)) for n in (1, 2, 3, 7, 50, 400, 6000)] + ["x" * 1024 + "token: abcdefgh", "token: " + "a" * 1017, "token: " + "a" * 1018]
    df = spark.createDataFrame(list(enumerate(texts)), "path long, text string").withColumn("t", F.col("text"))
    got = secrets_ledger.scan(df, common.shared_path(spark, "t")).select("path", secrets_ledger.joined(F.col("findings")).alias("s"), secrets_ledger.redacted(F.col("t"), F.col("findings")).alias("r")).collect()
    assert {r["path"]: r["s"] for r in got} == {i: found(t) for i, t in enumerate(texts)}
    assert {r["path"]: r["r"] for r in got} == {i: plain_redacted(t) for i, t in enumerate(texts)}


# 3
def test_top_k_against_brute_force(spark):
    rnd = np.random.default_rng(2)
    v = rnd.normal(0, 0.3, (300, 8)).astype(np.float32)
    v[10:40] = v[10]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1004, [0.5, 0.5]), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    q = bitsliced.quantised(df, "vec_id", "embedding")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in bitsliced.top_k(q, q.where("id % 50 = 0"), block_rows=70, chunk_rows=2).collect())
    z = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 300, 50):
        best = sorted((-int(s), j) for j, s in enumerate(z @ z[i]) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want
    assert bitsliced.top_k(q.limit(0), q).count() == 0 and bitsliced.top_k(q, q.limit(0)).count() == 0
    few = q.where("id < 3")
    assert bitsliced.top_k(few, few.where("id = 0")).count() == 2


def test_top_k_over_many_blocks_sends_nothing_through_the_driver(spark):
    q = spark.range(1200).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(9)) - F.when(j == 1, 40000).otherwise(4)).alias("q"))
    got = bitsliced.top_k(q, q.where("id % 40 = 0"), block_rows=20, chunk_rows=10)
    z = np.array([r["q"] for r in q.orderBy("id").collect()])
    want = [(i, k + 1, j, -s) for i in range(0, 1200, 40) for k, (s, j) in enumerate(sorted((-int(s), j) for j, s in enumerate(z @ z[i]) if j != i)[:5])]
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect()) == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # small tables, which a join would else broadcast
    assert bitsliced.grid(10**6, 10**5, 24) == (24, 1) and bitsliced.grid(4, 5, 24) == (4, 5) and bitsliced.grid(1, 1, 24) == (1, 1)


# 4
def jaccard(a, b):
    s = [({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()) for w in (x.split() for x in (a, b))]
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] | s[1] else 1.0


def test_dart_signatures_estimate_weighted_jaccard():
    rnd = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        u, w = rnd.integers(0, 2**63, 300).astype(np.uint64), rnd.random(300) * 6
        a, b = w.copy(), w.copy()
        a[:40], b[-60:] = 0, rnd.random(60) * 3
        keys, rows, weights = np.concatenate([u[a > 0], u[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([a[a > 0], b[b > 0]])
        s = dartminhash.signatures(keys, weights, rows, 2, 120)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_near_duplicates_against_brute_force(spark, docs):
    rnd = random.Random(9)
    texts = {}
    for g in range(12):
        base = text(rnd, rnd.randint(5, 200)).split()
        for _ in range(rnd.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 60))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.random()}"
            texts[len(texts)] = " ".join(copy)
    for t in ("", " ", "one", "one", "two words"):
        texts[len(texts)] = t
    want = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and max(jaccard(texts[i], texts[j]), tilted_jaccard(texts[i], texts[j])) >= 0.8 and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = {k: lo if v == hi else v for k, v in want.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.classes(df).collect()} == want
    got = dartminhash.classes(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[3] == by[4] == by[5] == 3 and by[0] == by[1] == by[2] == 0 and by[9] == 8 and by[6] == 6
    assert dartminhash.classes(docs.limit(0)).count() == 0


def test_near_duplicates_go_by_text_not_by_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (9, a + " end"), (9, b), (None, b + " end"), (None, c), (None, c + " end")]
    got = dartminhash.grouped(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n long")).collect()
    by = {r["n"]: r for r in got}
    assert [by[n]["class_id"] for n in range(6)] == [3, 3, 9, 9, None, None]
    assert by[0]["group"] == by[1]["group"] and by[2]["group"] == by[3]["group"] and by[4]["group"] == by[5]["group"] and len({r["group"] for r in got}) == 3


def tilted_jaccard(a, b):
    s = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in (x.split() for x in (a, b))]
    weight = lambda c: sum(1 + 0.25 * (1 - 1 / n) for n in c.values())
    return weight(s[0] & s[1]) / weight(s[0] | s[1]) if s[0] | s[1] else 1.0


def test_repeated_shingles_weigh_more(spark):
    rnd = random.Random(2)
    line = lambda: text(rnd, 30)
    shared = [line(), line()]
    rows = ["p q r s t " * 10, "p q r s t " * 20]  # alike as sets, not by raw counts
    rows += [" ".join([*shared * 8, text(rnd, 9)]) for _ in "xy"]  # alike by the weights only
    rows += [" ".join([*[shared[0]] * 90, text(rnd, 200)]) for _ in "xy"]  # one line, very often, and else nothing in common
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    of = lambda **kw: [r["class_id"] for r in dartminhash.classes(df, **kw).orderBy("doc_id").collect()]
    assert jaccard(*rows[2:4]) < 0.8 <= tilted_jaccard(*rows[2:4]) and tilted_jaccard(*rows[4:6]) < 0.5
    assert of() == [0, 0, 2, 2, 4, 5] and of(tilt=0.0) == [0, 0, 2, 3, 4, 5]


def test_large_buckets_lose_no_link(spark):
    """A chain: neighbours are near duplicates, ends are not, and all share bands; small blocks are forced."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts, chain = {}, list(words)
    for i in range(60):
        texts[i] = " ".join(chain)
        for _ in range(3):
            chain[rnd.randrange(400)] = f"x{rnd.random()}"
    want = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and max(jaccard(texts[i], texts[j]), tilted_jaccard(texts[i], texts[j])) >= 0.8 and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = {k: lo if v == hi else v for k, v in want.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.classes(df, block=4).collect()} == want


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(200, 200)] + [(300 + rnd.randrange(20), 300 + rnd.randrange(20)) for _ in range(12)]
    want: dict = {}
    for a, b in edges:
        if a != b:
            lo, hi = sorted((want.setdefault(a, a), want.setdefault(b, b)))
            want = {k: lo if v == hi else v for k, v in want.items()}
    assert {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


# 5
def test_trie_encodes_as_the_library_does(spark, docs):
    from tokenizers import Tokenizer

    path = bpe_trie.default_path()
    library = Tokenizer.from_file(path)
    rnd = random.Random(6)
    pieces = ["the", "’s", "'s", "'LL", "Σ", "ÉÀ", "é", "12", "!?", "<|endoftext|>", "</w>", "漢字", "\U0001f600", " ", "\x1c", "\n", "unbelievable", "a" * 300]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    texts += [r["text"] or "" for r in docs.collect()]
    own = bpe_trie.Bpe(open(path, encoding="utf-8").read())
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe_trie.encode(docs.where("doc_id <> 7 and doc_id <> 12").drop("lang")).collect()}
    dig = {r["doc_id"]: r for r in bpe_trie.digests(docs.where("doc_id <> 7 and doc_id <> 12").select("doc_id", "text")).collect()}
    for r in docs.where("doc_id <> 7 and doc_id <> 12").collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["ids"] == want and got[r["doc_id"]]["blob_note"] == "x"
        assert dig[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert dig[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_trie.encode(docs.limit(0)).count() == 0


def test_decoding_goes_by_the_emitted_ids(spark):
    own = bpe_trie.Bpe(open(bpe_trie.default_path(), encoding="utf-8").read())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lists = [own.encode("an unbelievable text"), [], None, [5, 300, 7]]
    got = bpe_trie.decode(spark.createDataFrame(list(enumerate(lists)), "n long, ids array<int>")).orderBy("n").collect()
    assert [r["decoded"] for r in got] == [None if x is None else own.decode(x) for x in lists]
    (_, _, ids), = bpe_trie._encoded(own, pa.array(["hello world", None]))
    faulty = pa.ListArray.from_arrays(ids.offsets, pa.array([*ids.values.to_pylist()[:-1], 300], pa.int32()))
    n, digest, decoded = (c.to_pylist() for c in bpe_trie._digests(own, faulty))
    want = [*own.encode("hello"), 300]
    assert n == [len(want), 0] and digest == [sha(" ".join(map(str, want))), sha("")] and decoded == [sha(own.decode(want)), sha("")]
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode_lists(pa.array([[1 << 30]], pa.list_(pa.int32())))


def test_trie_equals_plain_merging():
    own = bpe_trie.Bpe(open(bpe_trie.default_path(), encoding="utf-8").read())
    rnd = random.Random(8)
    words = {"".join(rnd.choice("abcdeinorstth") for _ in range(rnd.randint(1, 14))) for _ in range(2000)}
    assert own.encode_words(words) == {w: own.merge(w) for w in words}


# 6, 9
def auc(score, y):
    order = np.argsort(np.argsort(score))
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("name", "label", "of", "rest", "least"), [("op6_toxicity", "toxic", 4, 2, 0.9), ("op9_quality_trees", "quality", 5, 0, 0.97)])
def test_held_out_accuracy(spark, name, label, of, rest, least):
    sf = "/root/testdata/sf0.1"
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert len(got) == 10000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % of == rest) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    y = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id").query("held_out")
    assert auc(y["score"].to_numpy(), y[label].to_numpy()) > least


def test_classifiers_without_labels_and_on_odd_texts(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, None), (3, 0, 1), (8, 0, 0), (None, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    d = common.text_of(docs)
    for labels in (none, some):
        for got in (quality_gbt.classify(d, labels).collect(), toxicity.classify(d, labels).collect()):
            assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    for classify in (quality_gbt.classify, toxicity.classify):
        assert classify(d.limit(0), none).count() == 0
        clash = classify(d.withColumn("score", F.lit("own")).withColumn("Y", F.lit(1)), some)
        assert clash.columns.count("score") == 1 and clash.count() == docs.count() and dict(clash.dtypes)["score"] == "double"


def plain_buckets(t):
    low = [ord(" ") if c.isspace() else ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in t]
    out = set()
    for i in range(len(low)):
        h = 0
        for n in range(1, min(5, len(low) - i) + 1):
            h = (h * 0x100000001B3 + low[i + n - 1] + 1) % 2**64
            if n >= 3:
                out.add((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 44)
    return out


def test_toxicity_against_plain_python(spark, monkeypatch):
    rnd = random.Random(17)
    bad, good = ["idiot", "trash", "ÜBEL"], ["Süden", "river", "stone", "Ⅷ"]
    rows = [(i, " ".join(rnd.choice(good + bad if i % 3 == 0 else good) for _ in range(rnd.randint(1, 12)))) for i in range(150)] + [(150, None), (151, "")]
    labels = [(i, int(any(w in (t or "") for w in bad))) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(toxicity, "SPAN_BYTES", 40)  # most texts are cut into spans
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    train = [(plain_buckets(t or ""), y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [sum(y == k for _, y in train) for k in (0, 1)]
    ratio = {}
    for k in set().union(*(b for b, _ in train)):
        seen = [sum(k in b for b, y in train if y == c) for c in (0, 1)]
        g, share = 0.0, sum(seen) / len(train)
        for c in (0, 1):
            for o, e in ((seen[c], n[c] * share), (n[c] - seen[c], n[c] * (1 - share))):
                g += 2 * o * np.log(o / e) if o else 0
        if g >= 10.83:
            ratio[k] = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    kept = sorted(ratio)
    assert len(kept) > 10
    # The same loss, minimised by plain gradient steps over dense features.
    x = np.array([[ratio[k] * (k in b) for k in kept] for b, _ in train])
    y = np.array([y for _, y in train], float)
    prior = y.mean()
    weight = np.where(y == 1, prior / n[1], (1 - prior) / n[0])
    w, bias, m, s = np.zeros(len(kept)), np.log(prior / (1 - prior)), 0, 0
    for t in range(1, toxicity.STEPS + 1):
        d = weight * (1 / (1 + np.exp(-(x @ w + bias))) - y)
        grad = np.append(x.T @ d + toxicity.RIDGE * w / len(w), d.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    for i, t in rows:
        b = plain_buckets(t or "")
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(bias + sum(w[j] * ratio[k] for j, k in enumerate(kept) if k in b)))), abs=2e-3)


def plain_statistics(t):
    raw = t.encode()
    words = raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ")
    words = [w for w in words if w]
    n, size = max(len(words), 1), max(len(raw), 1)
    classes = {k: sum(c in set(v) for c in raw) for k, v in quality_gbt._CLASSES.items()}
    count = Counter(words)
    return [classes[k] / size for k in quality_gbt._CLASSES] + [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, np.log1p(max(map(len, words), default=0)), len(count) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(count.values(), default=0) / n,
        sum(65 <= w[0] <= 90 for w in words) / n, sum(w[-1:] in b"#$%&*+<=>@\\^_`{|}~" for w in words) / n, np.log1p(len(words) / (classes["stop"] + 1)), np.log1p(len(words) / (classes["newline"] + 1)), classes["upper"] / max(classes["upper"] + classes["lower"], 1),
    ]


def test_quality_against_plain_python(spark, sf):
    rows = [(r["doc_id"], r["text"] or "") for r in common.table(spark, sf, "documents").collect()] + [(10**6, ""), (10**6 + 1, " \t"), (10**6 + 2, "A A a!\n\x0bé #x")]
    x = quality_gbt.statistics(pa.array([t for _, t in rows]))
    assert np.allclose(x, [plain_statistics(t) for _, t in rows])
    y = np.array([r["quality"] if r["quality"] is not None else -1 for r in [*common.table(spark, sf, "labels").collect()]])
    label = dict(zip([r["doc_id"] for r in common.table(spark, sf, "labels").collect()], y.tolist(), strict=True))
    on = [k for k, (i, _) in enumerate(rows) if label.get(i, -1) >= 0 and zlib.crc32(str(i).encode()) % 5]
    forest = quality_gbt.fit(x[on], np.array([label[rows[k][0]] for k in on], float))
    got = {r["doc_id"]: r["score"] for r in quality_gbt.classify(common.text_of(common.table(spark, sf, "documents")), common.table(spark, sf, "labels")).collect()}
    for (i, _), v in zip(rows, x, strict=True):
        margin = forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):  # one node after another
            at = 0
            while at < len(f):
                at = 2 * at + (2 if v[f[at]] > c[at] else 1)
            margin += leaf[at - len(f)]
        assert i >= 10**6 or got[i] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_the_first_split_is_the_best_one():
    rnd = np.random.default_rng(3)
    x, y = rnd.integers(0, 12, (300, 3)).astype(float), rnd.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 6] = 1
    f = quality_gbt.fit(x, y, trees=1, depth=1, rate=1.0)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    gain = {}
    for j in range(3):
        for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
            left = x[:, j] <= c
            if min(h[left].sum(), h[~left].sum()) >= quality_gbt.LEAST_WEIGHT:
                gain[j, c] = sum(g[m].sum() ** 2 / (h[m].sum() + quality_gbt.RIDGE) for m in (left, ~left))
    assert (f.feature[0, 0], f.cut[0, 0]) == max(gain, key=gain.get)
    left = x[:, f.feature[0, 0]] <= f.cut[0, 0]
    assert f.leaf[0] == pytest.approx([-g[m].sum() / (h[m].sum() + quality_gbt.RIDGE) for m in (left, ~left)])


def test_forest_fits_and_flattens():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality_gbt.fit(x, y)
    assert f.leaf.shape == (quality_gbt.TREES, 2**quality_gbt.DEPTH) and ((f.scores(x) > 0.5) == y).mean() > 0.97


# 7
def plain_dedup(rows, window):
    rows = [(i, (t or "").split()) for i, t in rows]
    first: dict = {}
    for i, w in rows:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in rows:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("window", [3, 50])
def test_substrings_against_brute_force(spark, docs, window):
    rnd = random.Random(window)
    passages = [text(rnd, 55) for _ in range(3)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(20 + i, " ".join([text(rnd, rnd.randint(0, 30)), rnd.choice(passages), text(rnd, 10), rnd.choice(passages)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("starts", F.lit(1))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring.dedup(df, window).collect())
    assert got == plain_dedup(rows, window)
    assert substring.dedup(df.limit(0), window).count() == 0


# 8
def test_merkle_audit_finds_exactly_the_damage(spark):
    rows = [(i, f"http://h/{i}" if i % 7 else None, f"<p>{i}</p>" * (i % 5) if i % 11 else None) for i in range(700)] + [(None, "u", "h"), (None, "u", "h"), (None, "u\r\nX: y", ""), (5, "http://h/5", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit(1)).withColumn("KEY", F.lit("k"))
    shards = warc_merkle.archive(pages, 30_000)
    assert shards.count() == len(rows) and shards.select("shard").distinct().count() > 3
    for r in shards.collect():
        head = bytes(r["record"]).split(b"\r\n\r\n")[0].split(b"\r\n")
        assert len(head) == 8 and head[2].startswith(b"WARC-Record-ID: <urn:uuid:") and r["length"] == len(r["record"])
    ours = warc_merkle.tree(shards)
    again = lambda d: warc_merkle.tree(d, depth=len(ours) - 1)
    named = shards.select("page_id", "shard", F.col("key").alias("node"), "nth")
    found = lambda theirs: sorted((r["page_id"] or -1, r["status"]) for r in warc_merkle.audit(ours, theirs).join(named, ["shard", "node", "nth"], "left").collect())
    assert found(again(shards)) == []
    broken = shards.withColumn("record", F.when(F.col("page_id").isin(3, 77, 500), F.lit(b"rot")).otherwise(F.col("record")))
    assert found(again(broken)) == [(3, "changed"), (77, "changed"), (500, "changed")]
    # Records lost in the middle and at the end of shards: what follows has moved, and is intact.
    lost = shards.where(~F.col("page_id").isin(4, 90, 600) | F.col("page_id").isNull())
    moved = lost.withColumn("offset", F.col("offset") - 7)
    assert found(again(lost)) == found(again(moved)) == [(4, "missing"), (90, "missing"), (600, "missing")]
    back = warc_merkle.audit(again(lost), ours).collect()
    assert len(back) == 3 and {r["status"] for r in back} == {"extra"}
    # Only branches with damage are read: the nodes that differ are those above the damage.
    for a, b in zip(ours[1:], again(lost)[1:], strict=True):
        assert a.join(b, ["shard", "node", "hash"], "left_anti").count() <= 3
    # The tree, by hand.
    root = {}
    for shard, group in groupby(sorted(((r["shard"], r["key"], r["nth"], r["length"], hashlib.sha256(r["record"]).hexdigest()) for r in shards.collect())), key=lambda x: x[0]):
        level = [(k, n, size, h) for _, k, n, size, h in group]
        for up in range(len(ours) - 2, -1, -1):
            level = [(p, 0, sum(x[2] for x in xs), hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in xs).encode()).hexdigest()) for p, xs in ((p, list(g)) for p, g in groupby(level, key=lambda x: x[0][:up]))]
        root[shard] = level[0][3]
    assert {r["shard"]: r["hash"] for r in ours[-1].collect()} == root
    empty = warc_merkle.tree(warc_merkle.archive(pages.limit(0)))
    assert warc_merkle.audit(empty, empty).count() == 0


# 10
def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert mixing.mix(docs.limit(0)).count() == 0 and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))


def test_mix_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "abcd"[i % 4] if i % 3 else "a") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, slice_rows=50).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    assert sum(r["t"] for r in got) == pytest.approx(1.5 * sum(r["s"] for r in got))
    assert all(abs(r["n"] - r["t"]) <= 20 and r["t"] <= 2 * r["s"] for r in got)


def test_words_of_a_block():
    texts = ["", "a  b\n", " é x", None, "one"]
    b = next(textkernel.blocks(pa.array(texts)))
    w = textkernel.Words(b)
    assert np.diff(w.first).tolist() == [0, 2, 2, 0, 1]
    h = w.hashes()
    assert len(set(h.tolist())) == 5 and textkernel.Words(next(textkernel.blocks(pa.array(["x", "a b"])))).hashes()[1] == h[0]


def test_components_too_large_for_exact_scores_are_an_error(spark):
    fine = spark.createDataFrame([(0, [65536.0, -65536.0]), (50, [65535.9, 1e-9])], "vec_id long, embedding array<double>")
    q = bitsliced.quantised(fine, "vec_id", "embedding")
    assert [(r["query_id"], r["id"], r["score"]) for r in bitsliced.top_k(q, q).orderBy("query_id").collect()] == [(0, 50, (1 << 24) * 16777190), (50, 0, (1 << 24) * 16777190)]
    with pytest.raises(Exception, match="too large"):
        bitsliced.quantised(spark.createDataFrame([(0, [1e18])], "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()


def test_kinds_of_word_hashes_are_independent():
    w = textkernel.Words(next(textkernel.blocks(pa.array([" ".join(f"w{i}" for i in range(1000)) + " w1"]))))
    a, b = w.hashes(), w.hashes(1)
    assert len(set(a.tolist())) == len(set(b.tolist())) == 1000 and not set(a.tolist()) & set(b.tolist()) and b[1] == b[-1]


def test_near_duplicate_recall_of_every_twentieth_document(spark):
    sf = "/root/testdata/sf0.1"
    of = {r["doc_id"]: r["class_id"] for r in registry.QUERIES["op4_dart_minhash"](spark, sf).collect()}
    texts = {r["doc_id"]: (r["text"] or "").split() for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    queries = {i: grams(w) for i, w in texts.items() if i % 20 == 0}
    holders: dict = {}
    for i, s in queries.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = found = 0
    for j, w in texts.items():
        s = grams(w)
        common_ = Counter(i for g in s if g in holders for i in holders[g])
        for i, n in common_.items():
            if i != j and n / (len(s) + len(queries[i]) - n) >= 0.8:
                pairs += 1
                found += of[i] == of[j]
    print("pairs of 0.8 and more:", pairs, "in one class:", found)
    assert pairs > 50 and found == pairs
