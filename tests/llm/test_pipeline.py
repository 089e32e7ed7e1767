"""Each stage on what its predecessor kept, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import bpe_trie, common, dartminhash, mixing, quality_gbt


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    out = [common.table(spark, sf, "documents")]
    for i, (_, f) in enumerate(P.STAGES):
        out.append(common.stored(f(spark, out[-1], sf), f"t{i}"))
    return sf, out


def test_shape(stages):
    _, out = stages
    assert 4 <= len(P.STAGES) <= 5 and all(d.columns == out[0].columns for d in out[:-1])


def test_quality_drops_what_it_rejects(spark, stages):
    sf, out = stages
    got = quality_gbt.classify(common.text_of(out[0]), common.table(spark, sf, "labels")).toPandas()
    assert sorted(got[got["score"] >= 0.3]["doc_id"]) == sorted(r["doc_id"] for r in out[1].select("doc_id").collect())
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    kept = {r["doc_id"] for r in out[1].select("doc_id").collect()}
    assert sum(q == 1 and i not in kept for i, q in labels.items()) <= 0.02 * len(labels)


def test_one_document_of_each_class_stays(stages):
    _, out = stages
    classes = {r["class_id"] for r in dartminhash.classes(out[1]).collect()}
    assert Counter(r["doc_id"] for r in out[2].select("doc_id").collect()) == Counter(classes)


def test_secrets_are_gone(spark, stages):
    from .test_operators import found

    _, out = stages
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in out[2:4])
    assert before.keys() == after.keys()
    for i, r in before.items():
        assert found(after[i]["text"]) == "" and (found(r["text"]) != "" or after[i] == r)


def test_copies_follow_the_mix(stages):
    _, out = stages
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(out[3]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in out[4].select("doc_id").collect()) == Counter(want)
    assert out[5].count() == out[4].count() and out[5].where("n_tokens <> size(ids)").count() == 0


def test_nulls_and_repeated_rows_pass_the_stages(spark):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, words(i, 40), "en", "ab"[i % 2], 0) for i in range(30)]
    rows += [(None, words(100, 40), "en", "a", 0), (None, words(101, 40), None, None, None), (None, None, None, None, None), (40, None, "en", "a", None), (41, "", "en", "b", 0), (42, words(42, 30000), "en", "a", 0)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES[1:4]:
        got = common.stored(stage(spark, docs, ""), "odd")
        assert got.columns == docs.columns, name
        if name != P.STAGES[3][0]:
            assert got.where("doc_id is null").count() == 3 and got.where("doc_id = 0").count() == 1
        docs = got
    nameless = [r["text"] for r in docs.where("doc_id is null").collect()]
    assert words(101, 40) in nameless and max(Counter(nameless).values()) <= 2  # alone in its source, so it is read twice
    tokens = P.STAGES[4][1](spark, docs, "")
    assert tokens.count() == docs.count()
    assert P.mix(spark, docs.limit(0), "").count() == 0


def test_near_dedup_goes_by_text_not_by_id(spark):
    words = lambda i: [f"w{i}x{j}" for j in range(60)]
    near = lambda i, k: " ".join([*words(i)[:-1], f"other{k}"])
    same = lambda i: " ".join(words(i))
    rows = [
        (1, same(1)), (None, same(1)), (None, near(1, 0)),  # copies without an id of a document with one
        (None, same(2)), (None, same(2)), (None, near(2, 0)),  # copies without an id of each other
        (5, same(3)), (5, same(4)),  # two texts of one id
        (6, same(5)), (7, near(5, 0)), (7, same(6)),  # one of an id's two texts is near another document
        (8, same(7)), (8, same(7)), (None, None), (None, same(8)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "ab"[n % 2], n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [sorted(map(repr, P.near_dedup(spark, d, "").collect())) for d in (docs, docs.repartition(3).orderBy(F.desc("n_chars")))]
    assert got[0] == got[1]
    left = Counter((r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, "").collect())
    of_two = [x for x in left if x in {(None, same(2)), (None, near(2, 0))}]
    assert len(of_two) == 1
    assert left - Counter(of_two) == Counter([(1, same(1)), (5, same(3)), (5, same(4)), (6, same(5)), (7, same(6)), (8, same(7)), (None, None), (None, same(8))])


def test_mix_tells_texts_of_one_id_apart(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "en", "a", 0) for i in range(4)]  # few: read twice
    rows += [(i, " ".join(f"v{i}x{j}" for j in range(20)), "en", "b", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sum(r["copies"] for r in mixing.mix(docs).collect())
    assert P.mix(spark, docs, "").count() == want


def test_tokens_decode(spark, stages):
    _, out = stages
    own = bpe_trie.Bpe(open(bpe_trie.default_path(), encoding="utf-8").read())
    for r in out[5].limit(200).collect():
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(r["ids"]).encode()).hexdigest()


# All stages against plain Python that shares nothing with the library but its parameters and, for quality, the fitted trees.
def plain_quality(rows, labels):
    from .test_operators import plain_statistics

    known = {i: q for i, q in labels if zlib.crc32(str(i).encode()) % 5}
    on = [r for r in rows if r["doc_id"] in known]
    x = np.array([plain_statistics(r["text"] or "") for r in on])
    forest = quality_gbt.fit(x[np.argsort([r["doc_id"] for r in on], kind="stable")], np.array(sorted_labels(on, known), float))
    out = []
    for r in rows:
        v, margin = plain_statistics(r["text"] or ""), forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if v[f[at]] > c[at] else 1)
            margin += leaf[at - len(f)]
        if 1 / (1 + np.exp(-margin)) >= 0.3:
            out.append(r)
    return out


def sorted_labels(on, known):
    return [known[r["doc_id"]] for r in sorted(on, key=lambda r: r["doc_id"])]


def plain_classes(rows):
    """Lists of rows, by links of 0.8 and what they connect."""
    from .test_operators import jaccard, tilted_jaccard

    group = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            x, y = a["text"] or "", rows[j]["text"] or ""
            if group[i] != group[j] and max(jaccard(x, y), tilted_jaccard(x, y)) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    out = {}
    for g, r in zip(group, rows, strict=True):
        out.setdefault(g, []).append(r)
    return list(out.values())


def plain_mix(rows):
    """Counter of rows, by queues of single copies, sorted by finish time."""
    size = lambda r: len([w for w in re.split("[\\x20\\x09-\\x0d]+", r["text"] or "") if w])
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in rows if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    budget, target, open_ = 1.5 * sum(total.values()), {}, list(sources)
    while True:
        rest = budget - sum(target.values())
        over = [s for s in open_ if weight[s] * rest / sum(weight[t] for t in open_) > 2 * total[s]]
        if not over:
            target |= {s: weight[s] * rest / sum(weight[t] for t in open_) for s in open_}
            break
        target |= {s: 2 * total[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    copies = []
    key = lambda r: hashlib.sha256(f"{mixing.SEED}:{r['doc_id'] if r['doc_id'] is not None else 'null:' + hashlib.sha256((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()
    for n, s in enumerate(sources):
        queue = sorted((r for r in rows if r["source"] == s), key=lambda r: (key(r), r["doc_id"] is not None, r["doc_id"] or 0, size(r)))
        at = 0
        for nth in (0, 1):
            for r in queue:
                at += size(r)
                if target[s]:
                    copies.append((at / target[s], n, key(r), nth, r))
    out, through = Counter(), 0
    for *_, r in sorted(copies, key=lambda c: c[:4]):
        through += size(r)
        if through > budget:
            break
        out[tuple(r)] += 1
    return out, target, total


def test_all_stages_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    from .test_operators import found, plain_redacted

    rnd = random.Random(41)
    words = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(90):
        good = i % 4 != 0
        t = text(rnd.randint(20, 90)) if good else " ".join(rnd.choice(["$$$", "###!!", "zz", "%%%"]) for _ in range(rnd.randint(5, 40)))
        if good and i % 9 == 2:
            t += f" password: hunter{i}hunter{i} end"
        rows.append((i, t, "en", rnd.choice(["a", "b", "c", None]), len(t)))
        labels.append((i, int(good), 0))
    base = [r for r in rows if r[0] % 4][:12]
    for n, (i, t, lang, source, _) in enumerate(base):  # near and exact copies, some without an id
        near = t.split()
        near[0] = f"other{n}"
        rows.append((None if n % 3 == 0 else 200 + n, t if n % 2 else " ".join(near), lang, source, len(t)))
    lonely = text(70)
    rows += [(None, lonely, "en", "d", len(lonely)), (None, None, None, None, None), (300, None, "en", "a", None), (301, "", "en", "a", 0), (302, text(4000), "en", "b", 9), (5, text(60), "en", "a", 7)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, columns).withColumn("score", F.lit("own")).withColumn("R1", F.lit(1)).withColumn("blob", F.lit("b")).withColumn("copies", F.lit(9))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = [docs]
    for name, stage in P.STAGES:
        step.append(common.stored(stage(spark, step[-1], str(tmp_path)), "plain"))
    got = [d.collect() for d in step]
    assert all(d.columns == docs.columns for d in step[:-1])

    assert Counter(map(tuple, got[1])) == Counter(map(tuple, plain_quality(got[0], [(i, q) for i, q, _ in labels])))
    assert 40 < len(got[1]) < len(got[0])

    blank = [r for r in got[1] if r["doc_id"] is None and r["text"] is None]
    kept = Counter(map(tuple, got[2])) - Counter(map(tuple, blank))
    classes = plain_classes([r for r in got[1] if not (r["doc_id"] is None and r["text"] is None)])
    assert len(classes) == sum(kept.values()) and any(len(c) > 1 for c in classes)
    for c in classes:
        mine = [r for r in c if kept[tuple(r)]]
        least = min((r["doc_id"] is None, r["doc_id"] or 0) for r in c)
        assert len(mine) == 1 and (mine[0]["doc_id"] is None, mine[0]["doc_id"] or 0) == least

    after = []
    for r in got[2]:
        d = r.asDict()
        if found(r["text"] or ""):
            d["text"] = plain_redacted(r["text"])
            d["n_chars"] = len(d["text"])
        after.append(tuple(d.values()))
    assert Counter(map(tuple, got[3])) == Counter(after) and Counter(after) != Counter(map(tuple, got[2]))

    want, target, total = plain_mix(got[3])
    empty = lambda c: Counter({k: n for k, n in c.items() if (k[1] or "").split()})  # noqa: E731  texts without words weigh nothing, and may come or not
    assert empty(Counter(map(tuple, got[4]))) == empty(want)
    for s in target:
        assert abs(sum(len((r["text"] or "").split()) for r in got[4] if r["source"] == s) - target[s]) <= 4100

    library = Tokenizer.from_file(bpe_trie.default_path())
    ids = {t: library.encode(t, add_special_tokens=False).ids for t in {r["text"] or "" for r in got[4]}}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expect = Counter((r["doc_id"], r["source"], len(ids[r["text"] or ""]), tuple(ids[r["text"] or ""]), sha(library.decode(ids[r["text"] or ""], skip_special_tokens=False))) for r in got[4])
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in got[5]) == expect


def test_alike_rows_meet_the_target(spark):
    rows = [(None, " ".join(["w"] * 20), "en", "a", 1)] * 6 + [(i, " ".join(["v"] * 20), "en", "b", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r["source"] for r in P.mix(spark, docs, "").collect())
    assert got == Counter({k[3]: 0 for k in rows}) + sum((Counter({r[3]: n}) for r, n in plain_mix(docs.collect())[0].items()), Counter())


@pytest.mark.parametrize("n", range(5))
def test_stages_on_an_empty_table(spark, tmp_path, n):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert P.STAGES[n][1](spark, docs, str(tmp_path)).count() == 0
