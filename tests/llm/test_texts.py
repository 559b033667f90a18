"""Operators 2, 5, 7, 9 and 10 against brute force on small documents."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from weft.llm import bpe, decontaminate, quality, suffix_tree, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [(None, "null id"), (1, None), (2, ""), (3, "Same text, twice."), (3, "Same text, twice."), (4, "é😀 漢字\x85  x  \n\n y'll DON'T 12345 \t"), (5, "word " * 20_000), (6, "\n \t "), (7, "a" * 3000)]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 5 ---------------------------------------------------------------------------


def coder():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs):
    exact = coder()
    texts = dict(AWKWARD)
    rows = bpe.decode(bpe.encode(docs(AWKWARD), RANKS, public_tokenizers.PATTERN, extra=("id",)), RANKS, extra=("id",)).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == exact.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["id"] == "clash"
    once = bpe.round_trip(docs(AWKWARD), RANKS, public_tokenizers.PATTERN, extra=("id",)).collect()
    assert sorted(map(str, once)) == sorted(map(str, rows))
    first = bpe.digests(bpe.decode(bpe.encode(docs([(3, "ab c")]), RANKS, public_tokenizers.PATTERN), RANKS)).first()
    ids = exact.encode_ordinary("ab c")
    assert first["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert first["decoded_sha256"] == hashlib.sha256(b"ab c").hexdigest() and first["n_tokens"] == len(ids)
    assert bpe.encode(docs([(1, "x")]).where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_random(spark):
    with open(RANKS, "rb") as f:
        pieces = bpe.pieces_of(f.read(), public_tokenizers.PATTERN)
    exact, rng = coder(), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aaabbc'sllre  \n\t1²é٣漢😀　ß") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(pieces.encode([text])[0], np.int32).tolist() == exact.encode_ordinary(text)


def test_bpe_library_follows_the_ranks():
    """The library's own ids, on strings of vocabulary tokens: only pieces that
    hold a tie of merges may need the ranks."""
    with open(RANKS, "rb") as f:
        data = f.read()
    pieces, rng = bpe.pieces_of(data, public_tokenizers.PATTERN), random.Random(3)
    tokens = [t.decode() for t in bpe.read_ranks(data) if bpe.np.frombuffer(t, np.uint8).max() < 128 or t.decode(errors="ignore").encode() == t]
    drawn = ["".join(rng.choice(tokens) for _ in range(rng.choice([2, 2, 3]))) for _ in range(120_000)] + [x * k for x in ("a", " ", "=", "-", "ha", "ab") for k in range(2, 60)]
    got = pieces.tokenizer.encode_batch(drawn, add_special_tokens=False)
    exact = pieces.exact
    other = [p for p, g in zip(drawn, got, strict=True) if len(g.ids) > 1 and g.ids != exact._encode_single_piece(p)]
    assert all(pieces.has_tie(p) for p in other) and sum(map(pieces.has_tie, drawn)) < 0.1 * len(drawn)


def test_bpe_offsets(spark, docs):
    for text in ("é😀 漢字 abc", "x" * 40 + "   \n     y'll 漢", ""):
        r = bpe.encode(docs([(1, text)]), RANKS, public_tokenizers.PATTERN, offsets=True).first()
        spans = coder().decode_with_offsets(r["ids"])[1]
        assert r["starts"] == spans and all(a < b <= len(text) for a, b in zip(r["starts"], r["ends"], strict=True)) and (r["ends"] or [0])[-1] == len(text)


def test_bpe_columns_of_any_name(spark, docs):
    df = docs([(1, "ab c"), (2, None)]).withColumnsRenamed({"doc_id": "d.i", "text": "t.x", "id": "decoded.x"})
    r = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN, "d.i", "t.x", extra=("decoded.x", "a.b"))
    assert r.columns == ["d.i", "decoded.x", "a.b", "ids", "decoded"] and r.count() == 2


def test_bpe_rejects_unknown_ids(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>"), RANKS).collect()
    none = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), RANKS).collect()
    assert [bytes(r["decoded"]) for r in none] == [b"", b""]


# --- 9 ---------------------------------------------------------------------------


def rules(text):
    text = text or ""
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_quality_rules(spark, docs):
    rng = random.Random(2)
    rows = [(i + 10, "".join(rng.choice(["a ", "b ", "#é ", "c\n", "\n", "d d d d d d d d "]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [*AWKWARD, (90, "x\ny\nx\n \n \nx")]
    texts = dict(rows)
    got = quality.quality(docs(rows), RANKS, public_tokenizers.PATTERN, PIECES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == rules(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def naive_quality(rows):
    """Operator 9's verdict over, text by text: {place: kept}."""
    import sentencepiece

    exact, cutter = coder(), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = []
    for lang, text in rows:
        text = text or ""
        ids, own = exact.encode(text, disallowed_special=()), cutter.encode(text)
        shares = [n / len(ids) for n in Counter(ids).values()]
        entropy = -sum(p * math.log(p) for p in shares) / math.log(min(len(ids), 4096)) if len(ids) > 1 else len(ids)
        high = [c for c in text if ord(c) > 0x7F]
        wide = sum(ord(c) > 0x7FF for c in high)
        script = "wide" if 2 * wide > len(text) else "two-byte" if 2 * len(high) > len(text) else "latin"
        facts = [len(text) / max(1, len(ids)), len(text) / max(1, len(own)), sum(map(cutter.is_byte, own)) / max(1, len(own)), entropy]
        found.append((lang, script, rules(text)[-1], len(ids), tuple(facts)))
    bands = {}
    for by in (0, 1):
        for name in {f[by] for f in found if f[by] is not None}:
            figures = {f[4] for f in found if f[by] == name and not f[2] and f[3] >= 32}
            if len(figures) >= quality.LEAST_TEXTS:
                ends = []
                for k in range(4):
                    values = sorted(math.floor(x[k] * 1000 + 0.5) for x in figures)
                    q1, q3 = (values[math.ceil(len(values) * q) - 1] for q in (0.25, 0.75))
                    spread = (6 if k == 2 else 3) * max(1, q3 - q1)
                    ends.append(((q1 - spread) / 1000, (q3 + spread) / 1000))
                bands[by, name] = ends
    kept = []
    for lang, script, failed, n, facts in found:
        d = quality.DEFAULT[script]
        ends = bands.get((0, lang)) or bands.get((1, script)) or [(d.least, d.most), (d.piece_least, d.piece_most), (0, d.fallback), (d.entropy, 9)]
        rounded = [math.floor(x * 1000 + 0.5) / 1000 for x in facts]
        fits = all(low <= x for x, (low, _), k in zip(rounded, ends, range(4), strict=True) if k != 2) and all(x <= high for x, (_, high), k in zip(rounded, ends, range(4), strict=True) if k != 3)
        kept.append(not failed and (fits or n < 32))
    return kept


def test_quality_by_brute_force(spark):
    rng = random.Random(22)
    vocabulary = {"en": "the of and committee report public library people there house water young little found great".split(), "de": "der die das und nicht haus wasser straße über größe menschen bücher jahr viele".split()}
    rows = []
    for i in range(330):
        lang = ["en", "de", None, "xx"][0 if i < 150 else 1 if i < 290 else 2 if i < 310 else 3]
        words = vocabulary[lang or "en"] if lang != "xx" else vocabulary["de"]
        own = [rng.choice(words) + (f"{rng.randrange(10**6)}" if i % 19 == 0 else "") for _ in range(rng.randint(20, 90))]
        text = " ".join(own) if i % 23 else "".join(rng.choice("漢字仮名交文章語言") for _ in range(60)) + " a" * 25
        rows.append((i, lang, text.upper() if i % 17 == 0 else text))
    rows += [(400, "en", None), (401, "en", ""), (3, *rows[3][1:]), (None, "en", rows[4][2])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = naive_quality([r[1:] for r in rows])
    got = quality.quality(df, RANKS, public_tokenizers.PATTERN, PIECES).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == Counter((r[0], k) for r, k in zip(rows, want, strict=True))
    assert 150 < sum(want) < len(rows) - 20 and {r["band"] for r in got} == {"en", "de", "latin", "wide"} or {r["band"] for r in got} >= {"en", "de", "latin"}
    assert quality.quality(df.where("false"), RANKS, public_tokenizers.PATTERN, PIECES).count() == 0


# --- 7 ---------------------------------------------------------------------------


def naive_tree(texts):
    """P(word | words before) by operator 7's definition, on plain counters."""
    tokens = [[*WORD.findall(fold(t)), "\0end"] for t in texts]
    ones, twos, threes = Counter(), Counter(), Counter()
    for t in tokens:
        ones.update(t)
        twos.update(zip(t, t[1:], strict=False))
        threes.update(zip(t, t[1:], t[2:], strict=False))
    total, distinct = sum(ones.values()), len(ones)
    root = lambda w: (ones[w] + 1) / (total + distinct + 1)

    def states(events, whole, before):
        by = {}
        for e, n in events.items():
            if n >= suffix_tree.LEAST:
                by.setdefault(e[:-1], {})[e[-1]] = n
        out = {}
        for context, own in by.items():
            gain = sum(n * math.log(n / whole(context) / before(context, w)) for w, n in own.items())
            if gain > len(own) * math.log(distinct + 1):
                out[context] = (own, whole(context), 1 - sum(n - 0.75 for n in own.values()) / whole(context))
        return out

    def mixed(state, w, before):
        own, whole, freed = state
        return (max(own.get(w, 0) - 0.75, 0) / whole if w in own else 0) + freed * before

    first = states(twos, lambda c: ones[c[0]], lambda c, w: root(w))
    one = lambda p, w: mixed(first[p,], w, root(w)) if (p,) in first else root(w)
    kept = {e: n for e, n in threes.items() if (e[1],) in first and min(twos[e[:2]], twos[e[1:]]) >= suffix_tree.EXTEND}
    second = states(kept, lambda c: twos[c], lambda c, w: one(c[1], w))

    def probability(before, w):
        if tuple(before[-2:]) in second:
            return mixed(second[tuple(before[-2:])], w, one(before[-1], w))
        return one(before[-1], w) if before else root(w)

    return ones, total, distinct, root, first, second, probability


def test_language_model(spark, docs):
    rng = random.Random(3)
    phrases = ["the cat sat on the mat", "a dog ran", "on the mat a dog sat", "the end of the day"]
    rows = []
    for i in range(100, 180):
        parts = [rng.choice(phrases) if rng.random() < 0.6 else rng.choice(["The", "cat", f"w{i}", "day", "of"]) for _ in range(rng.randint(0, 14))]
        rows.append((i, " ".join(parts)))
    rows += [*AWKWARD, (300, rows[5][1] + " unheard words here")]
    df = docs(rows)
    train = (df.doc_id % 4 != 0) | df.doc_id.isNull()
    texts = dict(rows)
    ones, total, distinct, root, first, second, probability = naive_tree([t for i, t in rows if i is None or i % 4])
    assert len(first) > 3 and len(second) > 3
    for context in [*first, *second]:
        assert sum(probability(context, w) for w in ones) + probability(context, "unheard") == pytest.approx(1)
    for top in (suffix_tree.TOP, 20, 0):  # all terms at hand, some, or all joined
        out = suffix_tree.score(df, train, top=top).collect()
        assert len(out) == len(rows)
        for r in out:
            tokens = [*WORD.findall(fold(texts[r["doc_id"]])), "\0end"]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(ones[t] > 0 for t in tokens), total)
            assert r["base_score"] == pytest.approx(sum(math.log10(root(t)) for t in tokens))
            assert r["score"] == pytest.approx(sum(math.log10(probability(tokens[:k], t)) for k, t in enumerate(tokens)))
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] % 4 == 0 and r["n_tokens"] > 20]
    assert held and all(r["score"] > r["base_score"] for r in held)


def test_language_model_grows_with_the_corpus(spark, docs):
    """More text, more states: nothing is kept by its share."""
    rng = random.Random(31)
    words = [f"v{i}" for i in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(200)]
    size = []
    for n in (50, 200):
        tree, *_ = suffix_tree.grow(docs([(i, t) for i, t in enumerate(lines[:n] * 3)]).select("text"))
        size.append(tree.where("base is null").count())
    assert size[1] > 3 * size[0] > 0


def test_language_model_without_training(spark, docs):
    df = docs([(1, "ab"), (2, None)])
    rows = suffix_tree.score(df, df.doc_id > 5).collect()
    assert {r["train_tokens"] for r in rows} == {0} and {r["score"] for r in rows} == {0.0}
    assert suffix_tree.score(df.where("false"), df.doc_id > 0).count() == 0


# --- 2 ---------------------------------------------------------------------------


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-1, rng.uniform(-20, 0), rng.uniform(0, 30)]) for _ in range(rng.randint(0, 14))]
        at = [i for i, s in enumerate(scores) if s != -1]
        got = toxicity.maximal(at, [scores[i] for i in at], 1)

        def split(a, b):  # the definition: best segment first (shortest on ties), then both sides
            best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = best[3], best[4]
            return [*split(a, i), (i, j, best[0]), *split(j, b)]

        want = split(0, len(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_karlin():
    x = toxicity.karlin([(0.1, 2.0), (0.9, -1.0)])
    assert 0.1 * math.exp(2 * x) + 0.9 * math.exp(-x) == pytest.approx(1) and x > 0


def test_toxicity_held_out(spark, docs):
    rng = random.Random(5)
    words, bad = [f"w{i}" for i in range(200)], ["vile", "scum", "moron"]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    rows += [(None, "scum moron vile"), (900, None), (901, ""), (5, rows[5][1])]
    df = docs(rows)
    labels = spark.createDataFrame([*marks, (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels.where("doc_id % 3 <> 0 or doc_id is null"))
    out = toxicity.score(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    truth = dict(marks)
    held = [(truth[r["doc_id"]], r["score"] >= 0.5) for r in out if r["doc_id"] in truth and r["doc_id"] % 3 == 0]
    assert sum(y == p for y, p in held) > 0.97 * len(held)
    passages = next(r for r in out if r["doc_id"] is None)["passages"]
    assert passages and passages[0]["first_token"] == 0 and passages[0]["end_token"] == 3
    kept = toxicity.keep(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {900, 901}
    assert kept.where("doc_id is null").count() == 0


def test_toxicity_is_the_same_for_any_partitioning(spark, docs):
    """Copies whose ids carry different labels, over 1, 3 and 8 partitions."""
    rng = random.Random(15)
    texts = [" ".join(rng.choice(["vile", "scum", *(f"w{i}" for i in range(60))]) for _ in range(40)) for _ in range(150)]
    rows = [(i, rng.choice(texts)) for i in range(500)]
    labels = spark.createDataFrame([(i, int("vile" in t) if rng.random() < 0.8 else rng.randrange(2)) for i, t in rows], "doc_id long, toxic int")
    models, scores = [], []
    for n in (1, 3, 8):
        df = docs(rows).repartition(n)
        models.append(toxicity.learn(df, labels.repartition(n), prior=10.0))
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score(df, models[-1]).collect()})
    assert models[0].lexicon and models[0] == models[1] == models[2] and scores[0] == scores[1] == scores[2]


def naive_toxicity(rows, labels, key, half, prior):
    """Operator 2 over, in plain lists: scores by text."""
    marks, texts = {}, {}
    for i, y in labels:
        if i is not None and y is not None:
            marks.setdefault(i, []).append(y)
    for i, t in rows:
        if i in marks:
            texts.setdefault(t, []).append(int(2 * sum(marks[i]) >= len(marks[i])))
    groups = {}
    for t, ys in texts.items():
        groups.setdefault(key[t], []).append((t or "", t, int(2 * sum(ys) >= len(ys))))
    texts = {min(g)[1]: int(2 * sum(y for *_, y in g) >= len(g)) for g in groups.values()}
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    forms = lambda w: [w] + [w[:4] + "*"] * (len(w) > 4)
    seen = {0: Counter(), 1: Counter()}
    n = Counter()
    for t, y in texts.items():
        if half[t] == 0:
            n[y] += 1
            seen[y].update({f for w in cut(t) for f in forms(w)})
    lexicon = {}
    for token in seen[0] | seen[1]:
        y1, y0 = seen[1][token], seen[0][token]
        a = prior * (y1 + y0) / (n[1] + n[0])
        d = math.log(((y1 + a) / (n[1] + prior - y1 - a + 1)) / ((y0 + a) / (n[0] + prior - y0 - a + 1)))
        if y1 + y0 >= 5 and abs(d) > max(math.log(2), 3 * math.sqrt(1 / (y1 + a) + 1 / (y0 + a))):
            lexicon[token] = d

    def segments(text):
        s = [max((lexicon[f] for f in forms(w) if f in lexicon), default=-0.1) for w in cut(text)]

        def split(a, b):
            best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return [*split(a, best[2]), best[0], *split(best[3], b)] if best[0] > 1e-12 else []

        return split(0, len(s))

    clean = [t for t, y in texts.items() if half[t] == 1 and y == 0]
    crowd = lambda t: math.fsum(s for w in cut(t) if (s := max((lexicon[f] for f in forms(w) if f in lexicon), default=-1)) > 0) / max(1, len(cut(t)))
    most = sorted(map(crowd, clean))[math.ceil(0.95 * len(clean)) - 1]
    clean = [t for t in clean if crowd(t) <= most]
    words = [w for t in clean for w in cut(t)]
    drawn = Counter(max((lexicon[f] for f in forms(w) if f in lexicon), default=None) for w in words)
    total, cost = len(words), drawn.pop(None, 0)
    p = [(c / total, s) for s, c in drawn.items()] + [(0.5 / total, s) for s in {v for v in lexicon.values() if v > 0} - set(drawn)]
    p.append((max(0, 1 - sum(q for q, _ in p)), -0.1))
    low, high = 1e-9, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(q * math.exp(mid * s) for q, s in p) < 1 else (low, mid)
    least = min(s for s in lexicon.values() if s > 0)
    k = (sum(s >= least for t in clean for s in segments(t)) + 0.5) / (total * math.exp(-low * least))
    fact = {t: math.log1p(sum(max(0.0, low * s - math.log(k * max(len(cut(t)), 1))) for s in segments(t))) for t in {t for _, t in rows}}
    points = [(fact[t], y) for t, y in texts.items() if half[t] == 1]
    bias = slope = 0.0
    for _ in range(20_000):  # plain ascent, instead of Newton's steps
        e = [(y - 1 / (1 + math.exp(-bias - slope * x)), x) for x, y in points]
        bias, slope = bias + 0.01 * (sum(d for d, _ in e) - 0.01 * bias), slope + 0.01 * (sum(d * x for d, x in e) - 0.01 * slope)
    return {t: 1 / (1 + math.exp(-bias - max(0, slope) * x)) for t, x in fact.items()}


def test_toxicity_by_brute_force(spark, docs):
    from pyspark.sql import functions as F

    rng = random.Random(25)
    words = ["vile", "viler", "scummy", "scumbag", "moron", *(f"w{i}" for i in range(40))]
    texts = []
    for i in range(700):
        own = [rng.choice(words[5:]) for _ in range(rng.randint(3, 18))]
        if i % 3 == 0:
            own[rng.randrange(len(own))] = rng.choice(words[:5])
            own[0] = rng.choice(words[:5])
        texts.append(" ".join(own))
    rows = [*enumerate(texts), (900, None), (901, ""), (3, texts[8])]
    labels = [(i, int(i % 3 == 0) if rng.random() < 0.93 else 1 - int(i % 3 == 0)) for i in range(650)]
    df = docs(rows)
    import pyarrow as pa

    distinct = list({t for _, t in rows})
    key = dict(zip(distinct, toxicity.sketch(pa.array(distinct, pa.string())).tolist(), strict=True))
    by_key = {r["k"]: r["h"] for r in spark.createDataFrame([(k,) for k in key.values()], "k long").select("k", toxicity.half_of(F.col("k")).alias("h")).collect()}
    want = naive_toxicity(rows, labels, key, {t: by_key[k] for t, k in key.items()}, 20.0)
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"), prior=20.0)
    got = toxicity.score(df, model).collect()
    texts_of = {}
    for i, t in rows:
        texts_of.setdefault(i, []).append(t)
    assert len(got) == len(rows) and len(model.lexicon) >= 4
    for r in got:
        assert min(abs(r["score"] - want[t]) for t in texts_of[r["doc_id"]]) < 2e-3


def test_toxicity_without_labels(spark, docs):
    df = docs([(1, "a"), (2, None)])
    model = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 1e-9 for r in toxicity.score(df, model).collect())


# --- 10 --------------------------------------------------------------------------


def edit(text, n, rng):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("xyz")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rng.choice("xyz"))
    return "".join(out)


def test_decontamination(spark, docs):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefgh      é") for _ in range(n))
    items = [make(rng.randint(90, 300)) for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "tiny"), (52, items[0])], "item_id long, text string")
    rows, want = [], {}
    for i in range(120):
        text = make(rng.randint(50, 900))
        if i % 3 == 0:
            k = rng.randrange(1, 20)
            found = edit(items[k], rng.randint(0, int(0.03 * len(items[k]))), rng)
            at = rng.randrange(len(text))
            text = text[:at] + (re.sub("[a-z]", lambda m: m[0].upper(), found) if i % 2 else found) + text[at:]
            want[i] = k
        rows.append((i, text))
    rows += [(None, "x" + items[3]), (200, None), (201, ""), (5, items[4]), (202, items[0])]
    df = docs(rows)
    for size in (decontaminate.BLOCK_BYTES, 700):
        out = decontaminate.by_document(df, decontaminate.find(df, bench, block_bytes=size)).collect()
        assert len(out) == len(rows)
        for r in out:
            if r["doc_id"] in want:
                assert want[r["doc_id"]] in {h["item_id"] for h in r["hits"]}
            elif r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] != 5:
                assert not r["contaminated"]
        assert {h["item_id"] for r in out if r["doc_id"] == 202 for h in r["hits"]} == {0, 52}
        assert [r["contaminated"] for r in out if r["doc_id"] is None] == [True]
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == df.columns and {200, 201} <= {r["doc_id"] for r in clean.collect()}
    assert clean.where("doc_id is null or doc_id = 5").count() == 0
    assert decontaminate.find(df, bench.where("false")).count() == 0


def test_bands_overlap():
    """The full 5 % of edits, spread as insertions or deletions, at every
    diagonal residue: no band border loses an occurrence."""
    import pyarrow as pa

    rng = random.Random(8)
    for length in (100, 199, 390):
        item = "".join(rng.choice("abcdefgh") for _ in range(length))
        ix = decontaminate.index([item.encode()], decontaminate.RATE)
        edits = int(0.05 * length)
        assert ix.edits.tolist() == [edits]
        cuts = [round((j + 1) * length / (edits + 1)) for j in range(edits)]
        more = "".join(c + "!" * (i + 1 in cuts) for i, c in enumerate(item))
        less = "".join(c for i, c in enumerate(item) if i + 1 not in cuts)
        for shift in range(2 * edits + 2):
            texts = ["." * (100 + shift) + t + "." * 50 for t in (more, less)]
            assert {r for r, *_ in decontaminate.occurrences(pa.array(texts), ix)} == {0, 1}, (length, shift)


def test_repetitive_texts_in_bounded_memory():
    """One letter 200,000 times against an item that repeats itself."""
    import tracemalloc

    import pyarrow as pa

    items = [b"a" * 1000, b"the quick brown fox jumps over the lazy dog and runs"]
    ix = decontaminate.index(items, decontaminate.RATE)
    texts = pa.array(["a" * 200_000, "a" * 900 + " none", "x" + items[1].decode() + "y"])
    tracemalloc.start()
    found = {(r, i) for r, i, *_ in decontaminate.occurrences(texts, ix)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(0, 0), (2, 1)} and peak < 500 << 20


def test_decontamination_names_and_types(spark, docs):
    item = "a question about rivers that has more than thirty letters"
    df = docs([(1, "so: " + item), (2, "clean text"), (None, None)]).withColumnsRenamed({"id": "gone", "doc_id": "d.i", "text": "t.x"})
    bench = spark.createDataFrame([(1.5, item), (2.5, "tiny"), (3.5, None)], "item_id double, text string")
    out = decontaminate.keep_clean(df, bench, "d.i", "t.x")
    assert out.columns == df.columns and sorted(str(r["d.i"]) for r in out.collect()) == ["2", "None"]
    found = decontaminate.find(df, bench, "d.i", "t.x").collect()
    assert [(r["d.i"], r["item_id"], r["start"]) for r in found] == [(1, 1.5, 4)]
    assert decontaminate.by_document(df.where("false"), decontaminate.find(df, bench, "d.i", "t.x"), "d.i").count() == 0


def test_alignment():
    def best(item, text):
        row = [0] * (len(text) + 1)
        for c in item:
            new = [row[0] + 1]
            for j, t in enumerate(text):
                new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    rng = random.Random(7)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(5, 40)))
        around = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 10))) for _ in range(2)]
        text = around[0] + edit(item, rng.randint(0, 3), rng) + around[1]
        a, t = np.frombuffer(item.encode(), np.uint8), np.frombuffer(text.encode(), np.uint8)
        edits, start, end = decontaminate.align(a, t, -len(item), len(text))
        assert edits == best(item, text)
        assert best(item, text[start:end]) == edits and 0 <= start <= end <= len(text)
