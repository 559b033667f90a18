"""Operators 3, 4 and 6 and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weft.llm import common, components, jaccard, shards, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(fold(text))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def classes(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def near_copies(rng, n_groups, n_members, length):
    rows = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(n_members):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words))
                kind = rng.randrange(3)
                if kind == 0:
                    words[at] = f"x{rng.randrange(10**6)}"
                elif kind == 1:
                    del words[at]
                else:
                    words.insert(at, f"x{rng.randrange(10**6)}")
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("percent", "length"), [(90, 90), (90, 30), (80, 40)])
def test_jaccard(spark, docs, percent, length):
    rng = random.Random(length)
    texts = near_copies(rng, 4, 45, length) + ["a b", "A b", "a", "a b c", "", None, " \n", "a b c d e f g h i j k l", "b c d e f g h i j k l"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0])]
    out = jaccard.join(docs(rows), percent).collect()
    assert len(out) == len(rows)
    want = classes(rows, percent)
    for r in out:
        assert r["component_id"] == want.get(r["doc_id"])
    assert {r["doc_id"]: r["n_shingles"] for r in out if r["doc_id"] is not None} == {i: len(shingles(t)) for i, t in rows if i is not None}
    kept = jaccard.keep_first(docs(rows), percent)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}


def test_pipeline_near_copies(spark, docs):
    """The pipeline's stage links at five words and 0.8."""
    import corpus_pipeline

    rng = random.Random(21)
    rows = list(enumerate(near_copies(rng, 6, 30, 60) + near_copies(rng, 6, 30, 110) + ["a b c d", "A b c d", "a b c d e", "", None]))
    sets = [(i, w, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}) for i, t in rows for w in [WORD.findall(fold(t))]]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, _, s) in enumerate(sets):
        for b, _, t in sets[:n]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = {i for i, _ in rows if root(i) == i}
    assert want != {i for i, c in classes(rows, 90).items() if i == c}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs(rows), "").collect()} == want


def test_large_near_copy_group(spark, docs):
    """One hub with many members: sampled order, prefixes and position filter."""
    rows = list(enumerate(near_copies(random.Random(9), 1, 260, 140)))
    out = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(rows)).collect()}
    assert out == classes(rows, 90)


def test_jaccard_empty(spark, docs):
    assert jaccard.join(docs([(1, "x")]).where("false")).count() == 0


@pytest.mark.parametrize("percent", [90, 80])
def test_links_around_a_hub(spark, docs, percent):
    """Members that differ from their hub in the same few ways: pairs that only
    their differences bring together, at every distance from the hub."""
    rng = random.Random(percent)
    base = [f"w{i}" for i in range(70)]
    changes = [(at, f"x{at}_{v}") for at in (5, 14, 23, 32, 41, 50, 59) for v in range(2)]
    rows = []
    for _ in range(220):
        words = list(base)
        for at, word in rng.sample(changes, rng.choice([0, 1, 2, 3, 4, 5, 6])):
            words[at] = word
        rows.append(" ".join(words[rng.choice([0, 0, 0, 1, 3]) :]))
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(rows), percent).collect()}
    assert got == classes(rows, percent)


def test_signatures_come_in_slices(spark, docs, monkeypatch):
    rng, sizes, twice = random.Random(3), [], jaccard._twice

    def counted(rows):
        sizes.append(rows.count())
        return twice(rows)

    monkeypatch.setattr(jaccard, "_twice", counted)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(120)) for _ in range(40)]
    rows = [(i, texts[i % 40] + " end" * (i // 40)) for i in range(80)]
    found = {r[0]: r[2] for r in jaccard.join(docs(rows)).collect()}
    assert found == classes(rows, 90)
    first = sizes[:4]
    assert max(first) < sum(first) / 2


def test_sets_without_enough_left_are_not_compared_further(spark, docs, monkeypatch):
    """Each shares one passage with each of its group: too little for a link."""
    rng, left, across = random.Random(4), [], jaccard._across

    def seen(stars, still, *more):
        left.append(still.count())
        return across(stars, still, *more)

    monkeypatch.setattr(jaccard, "_across", seen)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(60)] for _ in range(6)]
    rows = [(i, " ".join(w for k in rng.sample(range(6), 3) for w in [*passages[k], *(word() for _ in range(20))])) for i in range(60)]
    found = {r[0]: r[2] for r in jaccard.join(docs(rows), percent=80).collect()}
    assert found == classes(rows, 80)
    assert left[0] == 0


@pytest.mark.parametrize("percent", [90, 80])
def test_fragments_meet(percent):
    """Any two linked sets share as many signatures as both need, at one level."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in [*range(4, 40), 100, 333]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            gone = rng.integers(0, jaccard.budget(2 * len(a), percent) + 1)
            b = np.unique(np.concatenate((rng.permutation(a)[gone // 2 :], rng.integers(0, 2**63, gone - gone // 2).astype(np.uint64))))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
                met = [(len(np.intersect1d(x, y)), p, q) for x, p in jaccard.signatures(a, percent) for y, q in jaccard.signatures(b, percent)]
                assert any(m >= max(p, q) for m, p, q in met)


def test_components(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 6 ---------------------------------------------------------------------------


def removed(rows, width):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize(("width", "gram"), [(50, 12), (6, 3), (3, 3)])
def test_substring(spark, docs, width, gram):
    rng = random.Random(width)
    passages = [[f"p{k}_{i}" for i in range(rng.randint(width, 3 * width))] for k in range(6)]
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 2 * width))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(words) + 1), rng.choice(passages)
            a = rng.randrange(len(p))
            words[at:at] = p[a:] if rng.random() < 0.5 else p
        texts.append("  ".join(words) + ("\n" if rng.random() < 0.5 else ""))
    texts += [texts[3], texts[3], texts[7], "", None, "same " * (4 * width), "same " * (4 * width), "same " * (width - 1)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(2, texts[2]), (None, texts[3])]
    out = substring.remove_repeats(docs(rows), width=width, gram=gram).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out) == Counter(removed(rows, width))
    for r in out:
        assert sum(x["end"] - x["first"] for x in r["removed"]) == r["n_removed"]
    assert substring.remove_repeats(docs(rows).where("false")).count() == 0


def test_joins_without_broadcasts(spark, docs, monkeypatch):
    """Beyond the size of a broadcast, the same joins are shuffled."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = list(enumerate(near_copies(random.Random(29), 2, 40, 60) + ["same text of five words"] * 30))
    out = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(rows), 80).collect()}
    assert out == classes(rows, 80)


def test_salted_join_spreads_a_hot_key(spark):
    """A key that nine tenths of the rows have is dealt over many tasks."""
    left = common.written(spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1).alias("k"), "id"))
    right = common.written(spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(before, ("-1", "false", "16"), strict=True):
            spark.conf.set(c, v)
        joined = common.salted(left, right, ["k"], "left", common.hot_keys(left, ["k"]))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 0.25 * 20_000
        assert joined.where("v = 2 * k").count() == 20_000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://elsewhere:7077"})()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="checkpoint"):
            common.shared_dir(Elsewhere())


# --- 4 ---------------------------------------------------------------------------


def naive_shards(rows, depth):
    """A k-d tree in plain lists: rows are (id, size, coordinates, ties)."""
    out = {}

    def split(part, path):
        if len(path) == depth or len(part) < 2:
            for r in part:
                out[r[0]] = int(path.ljust(depth, "0"), 2)
            return
        spread = [max(r[2][d] for r in part) - min(r[2][d] for r in part) for d in range(len(part[0][2]))]
        dim = spread.index(max(spread))
        key = lambda r: (r[2][dim], *r[3])
        order, total, before = sorted(part, key=key), sum(r[1] for r in part), 0
        for r in order:
            if before + r[1] >= total / 2:
                inside = total / 2 - before > before + r[1] - total / 2
                cut = key(r)
                split([x for x in part if key(x) < cut or (inside and key(x) == cut)], path + "0")
                split([x for x in part if not (key(x) < cut or (inside and key(x) == cut))], path + "1")
                return
            before += r[1]

    split(rows, "")
    return out


def test_shards_by_brute_force(spark, docs):
    rng = random.Random(27)
    rows = [(i, "t" * rng.randint(1, 60) + f" é{i}") for i in range(150)] + [(200, None), (201, "")]
    langs = F.when(F.col("doc_id") % 3 == 0, "de").when(F.col("doc_id") % 7 == 0, None).otherwise("en")
    df = docs(rows).withColumn("lang", langs)
    text = F.coalesce("text", F.lit(""))
    plain = df.select("doc_id", (F.octet_length(text) + 1).alias("s"), F.array(*dims().values()).alias("c"), F.array(*shards._digits(F.xxhash64(text)), *shards._digits(F.xxhash64("doc_id", F.lit(1)))).alias("t"))
    want = naive_shards([(r["doc_id"], r["s"], r["c"], r["t"]) for r in plain.collect()], 3)
    got = shards.shards(df, dims(), leaves=8, tolerance=0.0, group_tolerance=0.0).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == want and set(want.values()) == set(range(8))


def dims():
    return {"n_chars": shards.log_scale(F.col("n_chars")), "lang": shards.category(F.col("lang"))}


def test_shards(spark, docs):
    rng = random.Random(12)
    copies = ["copy " * 40] * 300
    texts = copies + ["t" + "x" * rng.randint(1, 400) + str(i) for i in range(900)] + [None, "", ""]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "no id")]
    out = shards.shards(docs(rows), dims(), leaves=8).collect()
    assert len(out) == len(rows) and {r["shard"] for r in out} == set(range(8))
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in s) == list(range(len(s))) for s in by.values())
    sizes = [sum(x["size"] for x in s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 0.08 * sum(sizes) / 8
    text = {i: t for i, t in rows}
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 for r in out)


def test_shards_keep_copies_together(spark, docs):
    rows = [(i, f"text {i // 3} " * 9) for i in range(1200)]
    where = defaultdict(set)
    for r in shards.shards(docs(rows), dims(), leaves=8).collect():
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_shards_keep_a_large_group_together(spark, docs):
    """A cut that falls inside a group of copies goes elsewhere, and sizes stay near equal."""
    rows = [(i, "copy " * 20 if i < 60 else "x" * ((34 if i % 3 < 2 else 98) + i % 50) + f" {i:05}") for i in range(1200)]
    where, sizes = defaultdict(set), Counter()
    for r in shards.shards(docs(rows), dims(), leaves=8).collect():
        where[r["text_crc32"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in where.values()) and len(sizes) == 8
    assert max(sizes.values()) - min(sizes.values()) <= 4 * max(len(t) + 1 for _, t in rows)


def test_shards_by_bytes(spark, docs):
    rows = [(i, "x" * (i % 50)) for i in range(500)]
    out = shards.shards(docs(rows), dims(), target_bytes=2000).collect()
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert sorted(sizes) == list(range(len(sizes))) and max(sizes.values()) <= 2000 and sum(sizes.values()) == sum(len(t) + 1 for _, t in rows)
    assert shards.shards(docs(rows).where("false"), dims(), leaves=8).count() == 0
    assert shards.shards(docs([(1, "a")]), dims(), leaves=8).count() == 1


# --- pipeline --------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(80))
    item = "a benchmark question that nobody should find in the training data at all, ever, in any way"
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        rows.append((i, text() + (" vile scum moron vile" if toxic else ""), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, rows[1][1], "en", "s", 0), (1001, rows[2][1] + " " + item, "en", "s", 0), (1002, "mail me at a.b@example.com " + text(), "en", "s", 0), (1003, None, None, None, None), (1004, "", "en", "s", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not set(out) & {i for i in range(300) if i % 6 == 0} and not set(out) & {1000, 1001}
    assert {1002, 1003, 1004} <= set(out) and len(out) > 240
    assert out[1002]["text"].startswith("mail me at [email] w") and len(out[1002]["ids"]) == out[1002]["n_tokens"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, columns whose names ours
    could clash with, and an empty table, through every stage."""
    import corpus_pipeline

    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, "plain text that stays where it is", "en", "s", 0), (1, "plain text that stays where it is", "en", "s", 0), (2, None, None, None, None), (None, "no id but some text here", "en", "s", 0), (3, "", "en", "s", 0), (4, long, "en", "s", 0), (5, "write to a.b@example.com", "en", "s", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind).withColumns({"ids": F.lit(7), "gone": F.lit("g"), "found": F.lit("f"), "c1": F.lit(1), "a.b": F.lit("dot")})
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage_docs in (docs, docs.where("false")):
        now = stage_docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "byte_bpe":
                assert now.columns == docs.columns, name
        out = now.collect()
        assert len(out) == stage_docs.count()
        if out:
            assert next(r["text"] for r in out if r["doc_id"] == 5) == "write to [email]"
            assert {r["a.b"] for r in out} == {"dot"} and next(r["n_tokens"] for r in out if r["doc_id"] == 3) == 0


def test_stages_free_the_heap_before_python_workers(spark, docs, tmp_path):
    """What a stage leaves in the executors' heaps is collected before the next
    stage's Python workers need the memory."""
    import corpus_pipeline

    def collections():
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    before = collections()
    out = corpus_pipeline.encode(spark, docs([(1, "some text")]), str(tmp_path))
    assert collections() > before
    assert [r["text"] for r in out.collect()] == ["some text"]
