"""The training-data operators against brute force, round trips and held-out rows."""

import base64
import collections
import hashlib
import random
import re
import uuid
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidelog.llm import blockmax, bpe, chat, langid, mih, mixing, neardup, pii, rollup, toxicity
from tidelog.llm.common import shared_dir, unit_hash

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.tiktoken")
#: Nulls, empty, long, repeated rows, and columns whose names clash with those the operators make.
ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, __row string"
ROWS = [
    (1, None, None, None, 0, 1, "x", "y"), (2, "", "en", "a", 0, 1, "x", "y"), (3, "word " * 30000, "en", "a", 0, 1, "x", "y"),
    (4, "one two three four five six", "en", "b", 0, 1, "x", "y"), (4, "one two three four five six", "en", "b", 0, 1, "x", "y"),
    (None, "one two three four five six", "en", "b", 0, 1, "x", "y"), (5, "ONE two, three four five six!", None, None, 0, 1, "x", "y"), (6, "123 456", "en", None, 0, 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Byte-level BPE


def test_bpe_is_tiktoken(coder):
    r = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", "x", " ", "  ", "\n", "\t", "　", "\x1c", "\x85", "1", "²", "é", "中", "!", "-", "'s", "'re", " '", "́", "😀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["", " ", "\n\n", "a" * 3000]
    for text, (ids, begins, pieces) in zip(texts, bpe.encode_texts(texts, PATH), strict=True):
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == coder.encode_ordinary(text)
        assert bpe.decode_ids(got, PATH) == text.encode()
        assert [bpe.decode_ids(np.frombuffer(p, "<u4").tolist(), PATH).decode() for p in pieces] == [text[a:b] for a, b in zip(begins, [*begins[1:], len(text)], strict=False)]


def test_long_slices_and_texts(coder):
    r = random.Random(11)
    ranks = bpe.merged(PATH).ranks
    for n in (1, 2, 3, 50, 400, 5000):
        for alphabet in ("ab", "abcdefghij", "0123456789abcdef", "aé中😀"):
            t = "".join(r.choice(alphabet) for _ in range(n))
            assert bpe.merge(t.encode(), ranks) == coder._core_bpe.encode_single_piece(t.encode())
    parts = ["'", "s", "re", "ll", "word", " ", "  ", "\n", "\t", "1", "²", "é", "中", "!", "'s", " '", "x" * 90, " " * 70]
    for size in (8, 64, 500):
        t = "".join(r.choice(parts) for _ in range(400))
        assert bpe.long_boundaries(t, size).tolist() == bpe.boundaries([t])[0].tolist()
    long = "".join(r.choice(parts) for _ in range(120000))
    ((ids, begins, pieces),) = bpe.encode_texts([long], PATH)
    assert len(long) > bpe.STEP_CHARS and np.frombuffer(ids, "<u4").tolist() == coder.encode_ordinary(long)


def test_bpe_query(spark, coder):
    want = {}
    for d, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False):
        ids = coder.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, SF).collect()} == want


def test_bpe_odd_rows(odd):
    got = bpe.encode(odd, PATH).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert bpe.encode(odd.limit(0), PATH).count() == 0
    clash = bpe.encode(odd.withColumns({c: F.lit("x") for c in ("ids", "n_tokens", "slice_starts")}), PATH).collect()
    assert collections.Counter(map(str, clash)) == collections.Counter(map(str, got))


# Language


def test_kneser_ney_is_a_distribution():
    model = langid.fit({"x": ["abab abba baab aabb"] * 12, "y": ["cdcd dccd cddc"] * 12})
    context, total = "ab a", {0: 0.0, 1: 0.0}
    letters = [chr(c) for c in range(97, 123)] + [" "]
    for c in letters:
        h, _ = model.entropy([context + c])
        h0, _ = model.entropy([context])
        n1, n0 = (len(langid.normal([context + c])[0]), len(langid.normal([context])[0]))
        if c != " ":
            for k in total:
                total[k] += float(np.exp(-(h[0, k] * n1 - h0[0, k] * n0)))
    assert all(0 < t <= 1.001 for t in total.values())
    langs, share, _, rejected = model.predict(["abba", "cddc", "", "12 ?", "日本語の文章です" * 5])
    assert langs[:4] == ["x", "y", "und", "und"] and list(rejected[2:]) == [True] * 3 and not rejected[:2].any()
    assert ((share >= 0) & (share <= 1)).all()


def test_language_query_holds_out(spark, docs):
    got = langid.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9


def test_language_odd_rows(spark, odd, docs):
    model = langid.learn(docs)
    got = langid.identify(odd, model).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (1, 2, 6)} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.rejected)
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_no_language_is_left_out_silently(docs):
    n = docs.select("lang").distinct().count()
    assert len(langid.learn(docs, max_langs=n).langs) == n
    with pytest.raises(ValueError, match="languages"):
        langid.learn(docs, max_langs=n - 1)


def test_an_unlearned_language_of_the_same_letters_is_rejected():
    rows = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).sort_values("doc_id")
    texts = {x: g.text.tolist() for x, g in rows.groupby("lang")}
    for hidden in texts:
        model = langid.fit({x: t[:400] for x, t in texts.items() if x != hidden})
        assert np.mean(model.predict(texts[hidden][400:600])[3]) > 0.8
        kept = [t for x in texts if x != hidden for t in texts[x][400:600]]
        assert np.mean(model.predict(kept)[3]) < 0.003
    model = langid.fit({x: t[:400] for x, t in texts.items()})
    mixed = [" ".join(t) for t in zip(*(t[400:420] for t in texts.values()), strict=True)]
    assert not any(model.predict([*mixed, *(f"{t[7].split()[0]} " * 300 for t in texts.values())])[3])
    for n in (10, 20, 40, 80):  # short texts of learned languages stay, where they hold a letter
        short = [t[100 : 100 + n] for x in texts for t in texts[x][400:800]]
        short = [t for t in short if any(c.isalpha() for c in t)]
        assert np.mean(model.predict(short)[3]) < 0.003
    r = random.Random(3)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(300)) for _ in range(100)]
    assert np.mean(model.predict(junk)[3]) == 1


def test_a_long_text_is_read_in_parts():
    model = langid.fit({"x": ["abab abba baab aabb"] * 12, "y": ["cdcd dccd cddc"] * 12})
    r = random.Random(8)
    text = "".join(r.choice("abcdABCD  .,\né中") for _ in range(20000))
    points, _, n = langid.normal([text])
    for size in (7, 100, 4096, 20000, 30000):
        got = list(langid.normal_parts(text, size))
        assert np.concatenate([p[len(p) - own :] for p, own, _ in got]).tolist() == points.tolist() and sum(x[2] for x in got) == n[0]
    long = text * 40
    assert len(long) > langid.STEP_CHARS
    h, n = model.entropy(["abba", long, ""])
    points, _, letters = langid.normal([long])
    assert n.tolist() == [4, letters[0], 0] and h[1] == pytest.approx(-model.logs(points).mean(axis=0, dtype=float), rel=1e-5)
    assert model.predict([long])[0][0] in ("x", "y")


def plain_kneser_ney(samples, texts):
    """Cross-entropies by the definition: counts in dictionaries, one character after another."""
    def characters(t):
        return " " + "".join(" " if not c.isalpha() else c for c in re.sub(r"[^\w]|[\d_]", " ", t.lower()))

    def squeezed(t):
        return re.sub(" +", " ", characters(t))

    out = []
    for lang in sorted(samples):
        stream = "".join(map(squeezed, samples[lang])) + " " * langid.ORDER
        raw = [collections.Counter(stream[i : i + n] for i in range(len(stream) - n + 1)) for n in range(1, langid.ORDER + 1)]
        counts = [collections.Counter(g[1:] for g in raw[n]) for n in range(1, langid.ORDER)] + [raw[-1]]  # by continuation, but for the longest
        for n in range(langid.ORDER - 1):
            for g in raw[n]:
                counts[n][g] = max(counts[n][g], 1)
        tables = []
        for c in counts:
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            total, kinds = collections.Counter(), collections.Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            tables.append((c, min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95), total, kinds))

        def p(context, ch, n):
            if n == 0:
                return 1 / langid.ALPHABET
            c, d, total, kinds = tables[n - 1]
            context = context[len(context) - n + 1 :]
            if not total[context]:
                return p(context, ch, n - 1)
            return max(c[context + ch] - d, 0) / total[context] + d * kinds[context] / total[context] * p(context, ch, n - 1)

        out.append([])
        for t in texts:
            s = squeezed(t)
            out[-1].append(-sum(np.log(p(s[max(0, i - langid.ORDER + 1) : i], s[i], min(i + 1, langid.ORDER))) for i in range(len(s))) / len(s))
    return np.array(out).T


def test_language_query_is_kneser_ney(spark, docs):
    """op5's predictions and cross-entropies against the definition, on every fifth document of the smallest size."""
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    learned = [(d, t, x) for d, t, x in rows if zlib.crc32(str(d).encode()) % 4 != 2 and t and x]
    sample = langid.bounded(spark.createDataFrame([(d, x, t) for d, t, x in learned], "k long, y string, t string"), 400, 4_000_000)
    assert collections.Counter(sample) == collections.Counter((x, t) for _, t, x in learned)
    samples = collections.defaultdict(list)
    for x, t in sample:
        samples[x].append(t)
    kept = {x: [t for i, t in enumerate(ts) if i % 5] if len(ts) >= 10 else ts for x, ts in samples.items()}
    some = [(d, t[:1500]) for d, t, _ in rows[::5] if t]
    want = plain_kneser_ney(kept, [t for _, t in some])
    model = langid.fit(dict(samples))
    got, _ = model.entropy([t for _, t in some])
    assert got == pytest.approx(want, rel=1e-3)
    by = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    assert len(by) == len(rows) and all(by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in rows)
    h, n = model.entropy([t or "" for _, t, _ in rows])
    for (d, _, _), x, m in zip(rows, h, n, strict=True):
        assert by[d].lang_pred == (model.langs[x.argmin()] if m else "und") and (not m or by[d].cross_entropy == pytest.approx(x.min(), rel=1e-4))


# Toxicity


def segments_by_definition(s):
    out = []

    def go(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += s[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12 or (abs(total - best[0]) <= 1e-12 and j + 1 - i < best[2] - best[1])):
                    best = (total, i, j + 1)
        if best:
            go(a, best[1])
            out.append(best[1:])
            go(best[2], b)

    go(0, len(s))
    return out


def test_segments_are_maximal():
    r = random.Random(0)
    for _ in range(500):
        s = np.array([r.choice([-3, -2.1, -1, -0.5, 0.7, 1.3, 2, 4.1]) for _ in range(r.randint(0, 14))]) + r.random() * 0.01
        assert [x[:2] for x in toxicity.segments(s)] == segments_by_definition(s)


def test_toxicity_learns(spark, odd):
    r = random.Random(2)
    plain = [f"w{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(60)]
    make = lambda bad: " ".join([r.choice(plain) for _ in range(40)] + ["vileword dreadful"] * bad)
    texts, marks = [make(i % 2) for i in range(300)], [i % 2 for i in range(300)]
    model = toxicity.fit(texts, marks)
    data = spark.createDataFrame([(i, make(i % 2)) for i in range(100)], "doc_id long, text string")
    got = toxicity.score(data, model).collect()
    assert all(x.predicted == x.doc_id % 2 for x in got)
    hot = next(x for x in got if x.doc_id == 1)
    text = data.where("doc_id = 1").first().text
    assert "vileword" in text[hot.passages[0].start : hot.passages[0].end]
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ROWS) and all(0 <= x.score <= 1 for x in out)
    assert all(x.score == 0 for x in toxicity.score(odd, toxicity.Model()).collect())


def test_toxicity_query(spark, docs):
    """op1's rows against the segments' definition, word by word; its accuracy on held-out rows of both classes."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.query(spark, SF).collect()}
    model = toxicity.learn(docs, labels, F.crc32(labels["doc_id"].cast("string")) % 5 != 0)
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d, t in rows:
        scores = []
        for w in toxicity.WORD.findall((t or "").lower()):
            known = [x for x in [w + "$", *(w[:k] for k in range(9, 2, -1) if len(w) >= k)] if x in model.odds]
            scores.append((model.odds[known[0]] if known else 0.0) - model.drift)
        total = 0.0
        for a, b in plain_segments(scores):
            total += max(0.0, model.rate * sum(scores[a:b]) - np.log(max(model.share * len(scores), 1.0)))
        x = model.bias + model.weight * np.log1p(total)
        assert got[d].score == pytest.approx(1 / (1 + np.exp(-x)), rel=1e-6) and got[d].predicted == (got[d].score >= 0.5)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
    # Held-out rows alone, of a larger table: how many of either class are told.
    big = toxicity.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(big) > 100 and big.toxic.sum() > 10
    assert big.predicted[big.toxic == 1].mean() > 0.9 and big.predicted[big.toxic == 0].mean() < 0.05


def plain_segments(scores):
    """Maximal scoring segments, by the merging rule on a list that is searched anew each time."""
    out, total = [], 0.0
    for i, x in enumerate(scores):
        low, total = total, total + x
        if x <= 0:
            continue
        now = [i, i + 1, low, total]
        while True:
            j = next((j for j in range(len(out) - 1, -1, -1) if out[j][2] < now[2]), None)
            if j is None or out[j][3] >= now[3]:
                break
            now = [out[j][0], now[1], out[j][2], now[3]]
            del out[j:]
        out.append(now)
    return [(a, b) for a, b, _, _ in out]


def test_toxicity_odd_rows(spark, odd, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    empty = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.0} and toxicity.score(odd.limit(0), empty).count() == 0
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (1, 0, None), (2, 0, 7)], labels.schema))
    model = toxicity.learn(docs.unionByName(docs), twice, docs_per_class=50)
    clash = odd.withColumns({c: F.lit(1) for c in ("score", "predicted", "n_passages", "y")})
    out = toxicity.score(clash, model, passages=False).collect()
    assert len(out) == len(ROWS) and len({r.score for r in out if r.doc_id in (4, None)}) == 1


def test_a_bounded_sample_is_bounded(spark):
    rows = [(i % 7, "a", "x" * 10) for i in range(50)] + [(None, "a", f"t{i}") for i in range(30)] + [(i, "b", "y" * 100) for i in range(40)] + [(1, "c", None), (1, None, "z"), (5, "c", "w" * 1000)]
    df = spark.createDataFrame(rows, "k long, y string, t string")
    got = toxicity.bounded(df, 20, 500)
    n = collections.Counter(y for y, _ in got)
    assert n["a"] == 20 and n["b"] == 5 and n["c"] == 0 and got == toxicity.bounded(df.repartition(5), 20, 500)
    assert toxicity.bounded(df.limit(0), 20, 500) == []


def test_a_bounded_sample_is_that_of_lowest_hashes(spark):
    rows = [(i, "a", f"t{i}") for i in range(3000)] + [(7, "a", f"u{i}") for i in range(3000)] + [(8, "b", "same")] * 3000 + [(i, "b", "v") for i in range(9, 40)] + [(None, "b", f"w{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "k long, y string, t string")
    u = F.when(F.col("k").isNull(), unit_hash(F.col("t"))).otherwise(unit_hash(F.col("k")))
    every = sorted({(r.y, r.u, r.d, r.t) for r in df.select("y", u.alias("u"), F.xxhash64("t").alias("d"), "t").collect()})
    for n in (1, 30, 70):  # repeated rows leave too few under the first edge
        assert toxicity.bounded(df, n, 10**6) == [(y, t) for x in "ab" for y, _, _, t in [e for e in every if e[0] == x][:n]]


# Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(t):
    good = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(pii.digits_of(s)) <= 19 and pii.luhn(pii.digits_of(s)), "phone": lambda s: 8 <= len(pii.digits_of(s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, t) if good[k](m[0])] for k, p in PLAIN.items()}


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    parts = ["a", "b@", "@", "@c.d", "x.y", ".", "-", "1", "23", "255.", "4.5", "9807915762804490", " ", "+1", "(", "555-1234567", "é", "٣"]
    field = pii.trained()
    for _ in range(8000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        own, every = pii.find(t, field)
        assert own == plain_base(t)
        assert all(s in every[k] for k in pii.KINDS for s in own[k])


def test_field_adds_what_patterns_miss():
    found = lambda t: {k: [t[a:b] for a, b in v] for k, v in pii.find(t, pii.trained())[1].items() if v}
    assert found("call (555) 123-4567 now") == {"phone": ["(555) 123-4567"]}
    assert found("mail joe @ example.com ok") == {"email": ["joe @ example.com"]}
    assert found("x +1 (269) 555-3296 4524132264652876 y") == {"phone": ["+1 (269) 555-3296"], "card": ["4524132264652876"]}
    assert found("on 2024-01-12, ids 123456789012 and 12-34-56-78") == {}
    t = "call (555) 123-4567 or a@b.co"
    assert pii.redact(t, pii.find(t, pii.trained())[1]) == "call [PHONE] or [EMAIL]"


def test_segmentations_sum_to_one():
    field = pii.trained()
    for text in ("ab 4111 1111 1111 1111 cd", "ab 555-123-4567 / 555-987-6543 cd", "x joe.b @ c.org y"):
        (a, b), *_ = pii.regions(text)
        tokens, segs = pii.lattice(text, a, b)
        w = field.weigh(segs)
        z, p, turns = field.marginals(len(tokens), segs, w)

        def total(t, before, turn=None):  # every segmentation, one by one; of those with a turn, if one is named, how often they have it
            if t == len(tokens):
                return 1.0, 0.0
            every, have = total(t + 1, before, turn)
            for (i, j, _), ws in zip(segs, w, strict=True):
                if i == t:
                    for k, x in enumerate(ws):
                        own = np.exp(x + field.turn[before][k])
                        e, h = total(j, k, turn)
                        every += own * e
                        have += own * (h + e * ((before, k) == turn))
            return every, have

        assert np.log(total(0, pii.NONE)[0]) == pytest.approx(z)
        assert all(0 <= x <= 1 for ps in p for x in ps) and len(segs) > 0
        for turn in ((pii.NONE, 2), (3, 3)):
            every, have = total(0, pii.NONE, turn)
            assert have / every == pytest.approx(turns[turn[0]][turn[1]], abs=1e-9)


def test_long_regions_are_one_programme():
    field = pii.trained()
    text = "555-123-4567 " * 100
    _, every = pii.find(text, field)
    assert every["phone"] == [(13 * i, 13 * i + 12) for i in range(100)]
    assert pii.redact(text, every) == "[PHONE] " * 100
    r = random.Random(5)
    for _ in range(4):  # numbers of many shapes, against the programme as marginals() has it
        text = "".join("".join(r.choice("0123456789") for _ in range(r.choice((1, 3, 3, 4, 4, 7, 16)))) + r.choice((" ", "-", ".", "/", " / ")) for _ in range(300)) + "1"
        ((a, b),) = pii.regions(text)
        tokens, segs = pii.lattice(text, a, b)
        weights = field.weigh(segs)
        z, p, _ = field.marginals(len(tokens), segs, weights)
        top = [{pii.NONE: (0.0, ())}]  # the best segmentation up to each token and state, in full
        ends = collections.defaultdict(list)
        for x, (_, j, _) in enumerate(segs):
            ends[j].append(x)
        for t in range(1, len(tokens) + 1):
            top.append(dict(top[-1]))
            for x in ends[t]:
                for k in range(pii.NONE):
                    score, path = max((v + field.turn[l][k] + weights[x][k], (*path, (x, k))) for l, (v, path) in top[segs[x][0]].items())
                    if k not in top[t] or score > top[t][k][0]:
                        top[t][k] = (score, path)
        want = [(segs[x][0], segs[x][1], k, p[x][k]) for x, k in max(top[-1].values())[1] if p[x][k] >= 0.9]
        got = field.spans(len(tokens), segs, 0.9)
        assert [g[:3] for g in got] == [w[:3] for w in want] and len(tokens) > 512
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
        taken = [s for spans in pii.base(text).values() for s in spans]
        found = {(pii.KINDS[k], tokens[i][0], tokens[j - 1][1]) for i, j, k, _ in got}
        own, every = pii.find(text, field)
        assert {(k, *s) for k in pii.KINDS for s in every[k]} - {(k, *s) for k in pii.KINDS for s in own[k]} == {(k, a, b) for k, a, b in found if not any(s < b and a < e for s, e in taken)}


def test_nothing_is_cut_to_a_length():
    field = pii.trained()
    found = lambda t: {k: [t[a:b] for a, b in v] for k, v in pii.find(t, field)[1].items() if v}
    for n in (1, 12, 13, 40, 400):
        assert found("mail " + "ab." * n + "ab @ example.com. Bye") == {"email": ["ab." * n + "ab @ example.com"]}
        assert found("mail joe @ " + "ab." * n + "org ok") == {"email": ["joe @ " + "ab." * n + "org"]}
    for n in (1, 10, 85, 124, 125, 126, 127, 128, 300, 2000):
        assert found("1/" * n + "(555) 123-4567").get("phone", [])[-1:] == ["(555) 123-4567"]
    assert found("x 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 y") == {"card": ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]}
    spans = sorted((a, a + r) for a, r in ((random.Random(i).randint(0, 300), random.Random(-i).randint(1, 90)) for i in range(60)))
    reach = [max(e for _, e in spans[: i + 1]) for i in range(len(spans))]
    assert all(pii.overlaps(spans, reach, a, a + n) == any(p < a + n and a < q for p, q in spans) for a in range(400) for n in (1, 5))


def test_recall_of_planted_entities():
    """Of entities planted in texts that weren't learned from, the share that is found, whole."""
    held, hit, false = collections.Counter(), collections.Counter(), 0
    for text, marks in pii.generated(1500, seed=99):
        _, spans = pii.find(text, pii.trained())
        every = {(a, b, k) for k, n in enumerate(pii.KINDS) for a, b in spans[n]}
        held.update(k for *_, k in marks)
        hit.update(m[2] for m in marks if m in every)
        false += sum(not any(p < b and a < q for a, b, _ in marks) for p, q, _ in every)
    assert all(hit[k] / held[k] > 0.95 for k in range(pii.NONE)) and false < 0.03 * sum(held.values())


def test_long_local_parts_are_whole():
    for local in ("a" * 64, "abcdefghij" * 12, "first.last+" + "x" * 90, "n" * 5000):
        text = f"mail {local} @ example.com ok"
        _, every = pii.find(text, pii.trained())
        assert [text[a:b] for a, b in every["email"]] == [f"{local} @ example.com"]
        assert pii.redact(text, every) == "mail [EMAIL] ok"


def test_personal_data_query_and_odd_rows(spark, odd):
    want = {}
    for d, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False):
        own = plain_base(t or "")
        want[d] = (*(len(own[k]) for k in pii.KINDS), hashlib.sha256(pii.listed(own).encode()).hexdigest())
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.query(spark, SF).collect()} == want
    assert pii.scan(odd).count() == len(ROWS) and pii.redacted(odd).columns == odd.columns
    clash = odd.withColumns({c: F.lit(1) for c in ("n_ip", "base_sha256", "spans")})
    got = collections.Counter(tuple(r) for r in pii.scan(clash).collect())
    assert got == collections.Counter(tuple(r) for r in pii.scan(odd).collect()) and len({r[1:] for r in got if r[0] in (4, None)}) == 1
    assert pii.scan(odd.limit(0)).count() == 0 and pii.redacted(odd.limit(0)).count() == 0 and pii.redacted(clash).count() == len(ROWS)
    for long in ("+4 " * 2000, "1" * 50000, "a" * 100000 + "@", "a@b" * 20000):
        pii.find(long, pii.trained())


# Chat


CONTROL = ["\\", "#", "###", "</turn>", "</turn>\n", "### user: ", ": ", "/", "<", "a", "\n", "\u0001", "é😀"]


def chat_by_grammar(s):
    """The turns of a formatted text, read character by character."""
    out, i = [], 0

    def upto(end):
        nonlocal i
        got = []
        while not s.startswith(end, i):
            assert i < len(s) and not s.startswith("###", i) and not s.startswith("</turn>", i)
            i += s[i] == "\\"
            got.append(s[i])
            i += 1
        i += len(end)
        return "".join(got)

    while i < len(s):
        assert s.startswith("### ", i)
        i += 4
        out.append((upto(": "), upto("</turn>\n")))
    return out


def test_chat_reads_back(spark):
    r = random.Random(6)
    rows = [
        (1, 0, "us: er\\", r"a\### x </turn>"), (1, 1, None, None), (1, 1, "assistant", "####\\</turn></turn>\\"), (None, 3, "assistant", "plain\n### "),
        (5, 0, "user", "abc\\"), (5, 1, "assistant", "d\\"), (6, 0, "assistant", "\\\\"), (7, 0, "x\\", "\\n</turn>\n### x: y"), (8, 0, "assistant", "a\\/b</turn"), (9, 0, "", ""),
        (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, None, "a:", " : b\\/ \\"), (3, 2, "assistant", "<</turn>#"), (4, 1, "user", "x" * 200000),
    ]
    rows += [(10, i, r.choice(("user", "assistant")), "".join(r.choice(CONTROL) for _ in range(r.randint(0, 3)))) for i in range(1500)]
    rows += [(100 + i, i % 3, "assistant", "".join(r.choice(CONTROL) for _ in range(r.randint(0, 9)))) for i in range(300)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("formatted", "turns", "level", "__source", "loss_spans")})
    out = chat.format_chats(data)
    got = out.select("conv_id", "turns", "formatted", "level", "loss_spans", chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    for r in got:
        assert [tuple(t) for t in r.turns] == by[r.conv_id] == chat_by_grammar(r.formatted)
        assert r.level == any("\\" in x or "###" in x or "</turn>" in x for t in by[r.conv_id] for x in t) or r.conv_id in (1, 3)
        assert r.loss == "".join(x for role, x in by[r.conv_id] if role == "assistant")
        assert [r.formatted[a:b].count("</turn>") for a, b in r.loss_spans] == [0] * sum(role == "assistant" for role, _ in by[r.conv_id])
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_sql_on_hard_rows(spark, tmp_path):
    """The query and its SQL on tables of final backslashes, control strings and 10,000 turns."""
    r = random.Random(7)
    rows = [(i % 400, i // 400, r.choice(("user", "assistant", "a: b", "x\\", None)), "".join(r.choice(CONTROL) for _ in range(r.randint(0, 8))) if r.random() < 0.95 else None) for i in range(2400)]
    rows += [(1000, i, "assistant" if i % 2 else "user", "word \\" if i % 7 == 0 else "plain text") for i in range(10000)] + [(None, 1, "assistant", "abc\\")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = chat.query(spark, str(tmp_path)), c.sql(chat.SQL)
    assert sql_rows(got.columns, got.collect()) == sql_rows(want.columns, want.fetchall())


def sql_rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize(("run", "sql", "tables"), [(chat.query, chat.SQL, ["conversations"]), (blockmax.query, blockmax.SQL, ["embeddings"])])
def test_sql(spark, run, sql, tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = run(spark, SF), c.sql(sql)
    assert sql_rows(got.columns, got.collect()) == sql_rows(want.columns, want.fetchall())


# Mixing


def inclusion(rows, left):
    """Of (id, weight, size): pi proportional to weight, 1 at most, so that the expected words are those left."""
    sure = set()
    while True:
        c = (left - sum(n for d, _, n in rows if d in sure)) / max(sum(w * n for d, w, n in rows if d not in sure), 1e-9)
        more = {d for d, w, n in rows if d not in sure and n and c * w >= 1}
        if not more:
            return {d: 1.0 if d in sure else c * w * (n > 0) for d, w, n in rows}
        sure |= more


def test_mix(spark, docs, odd):
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert g.source_size.iat[0] == g["size"].sum() and g.target.iat[0] <= 2 * g["size"].sum() + 1e-9
        assert abs(g.taken.sum() - g.target.iat[0]) <= g["size"].max()
    assert got.groupby("source").target.first().sum() == pytest.approx(1.5 * got["size"].sum())
    # The sample is the certain documents and the lowest ranks, as a plain sort has them.
    us = {r.doc_id: r.u for r in docs.select("doc_id", mixing.unit_hash(F.col("doc_id"), F.xxhash64("text"), F.lit(11)).alias("u")).collect()}
    for _, g in got.groupby("source"):
        whole = int(g.target.iat[0] / g.source_size.iat[0])
        pi = dict(zip(g.doc_id, g.expected - whole, strict=True))
        n = dict(zip(g.doc_id, g["size"], strict=True))
        want = inclusion([(d, np.log1p(n[d]), n[d]) for d in n], g.target.iat[0] - whole * g.source_size.iat[0])
        assert all(abs(pi[d] - want[d]) < 0.02 for d in pi)
        upto, drawn = sum(n[d] for d in pi if pi[d] >= 1), {d for d in pi if pi[d] >= 1}
        rest = g.target.iat[0] - whole * g.source_size.iat[0]
        for d in sorted((d for d in pi if 0 < pi[d] < 1), key=lambda d: us[d] / (1 - us[d]) / (pi[d] / (1 - pi[d]))):
            upto += n[d]
            if upto - n[d] / 2 > rest:
                break
            drawn.add(d)
        assert {d for d, c in zip(g.doc_id, g.copies, strict=True) if c > whole} == drawn
    assert mixing.mix(odd).count() == len(ROWS)
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns and rows.count() == mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_rows(odd.limit(0)).count() == 0


def test_mix_draws_by_inclusion_probability(spark):
    # 500 sources alike, of the same 24 sizes: how often a size is drawn is its pi.
    sizes = [1, 2, 3, 5, 8, 13, 21, 34] * 3
    rows = [(1000 * s + i, "w " * n, f"s{s:03}", float(1 + i % 4)) for s in range(500) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    for weight, w in ((None, [np.log1p(n) for n in sizes]), (F.col("w"), [1 + i % 4 for i in range(24)])):
        got = mixing.mix(df, weights=(1,), factor=0.45, weight=weight).toPandas()
        pi = inclusion([(i, w[i], n) for i, n in enumerate(sizes)], 0.45 * sum(sizes))
        drawn = got.assign(i=got.doc_id % 1000).groupby("i").copies.mean()
        assert got.copies.isin([0, 1]).all() and max(abs(drawn[i] - pi[i]) for i in pi) < 0.09
        assert np.mean([abs(drawn[i] - pi[i]) for i in pi]) < 0.03 and np.ptp([drawn[i] for i in pi]) > 0.3
        by = got.groupby("source")
        assert (abs(by.taken.sum() - by.target.first()) <= 34).all()


def test_mix_takes_certain_documents_whole(spark):
    rows = [(i, "a b", "x", 1.0) for i in range(100)] + [(1000 + i, "a b c d", "x", 1e6) for i in range(5)] + [(2000 + i, "a", "x", w) for i, w in enumerate((0.0, -1.0, None))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, w double"), weights=(1,), factor=0.5, weight=F.col("w")).toPandas()
    assert (got[got.doc_id.between(1000, 1999)].copies == 1).all() and (got[got.doc_id >= 2000].copies == 0).all()
    assert abs(got.taken.sum() - 0.5 * (200 + 20 + 3)) <= 2


def test_mix_of_repeated_rows(spark):
    for seed in range(2):  # 100 rows alike among 300, 90 without an id
        rows = [(1, "a b c d e", "a", i) for i in range(100)] + [(10 + i, "a b c d e", "a", i) for i in range(200)] + [(1000 + i, "x y", "b", i) for i in range(500)]
        rows += [(None, f"w{i % 30} b c", "c", i) for i in range(90)] + [(None, "q r s", None, i) for i in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
        got = mixing.mix(df, weights=(1, 1), factor=0.6, seed=seed).toPandas()
        assert len(got) == len(rows) and (got[got.doc_id == 1]["size"] == 5).all()
        for _, g in got.groupby("source", dropna=False):
            assert abs(g.taken.sum() - g.target.iat[0]) <= 5
        again = mixing.mixed_rows(df, weights=(1, 1), factor=0.6, seed=seed).collect()
        taken = collections.Counter((r.doc_id, r.source) for r in again)
        assert taken == collections.Counter({(None if d != d else int(d), s if isinstance(s, str) else None): int(c) for (d, s), c in got.groupby(["doc_id", "source"], dropna=False).copies.sum().items() if c})
        assert collections.Counter(again) == collections.Counter(mixing.mixed_rows(df.repartition(7), weights=(1, 1), factor=0.6, seed=seed).collect())


def test_shares(spark):
    of = lambda rows, *a: {r["__s"]: r["__target"] for r in mixing.shares(spark.createDataFrame(rows, "__s string, __n long"), *a).collect()}
    assert of([(None, 10), ("b", 100), ("a", 10)], (5, 2, 1), 1.5, 2.0) == pytest.approx({"a": 20, "b": 140, None: 20})
    assert of([("a", 0)], (5, 2, 1), 1.5, 2.0) == {"a": 0} and of([], (5, 2, 1), 1.5, 2.0) == {}
    # Many sources, in the order of code points, against the rule in plain Python.
    r = random.Random(1)
    rows = [(f"{r.choice('aZé中😀')}{i}", r.randint(0, 50) ** 3) for i in range(300)] + [(None, 70)]
    order, weights = sorted(rows, key=lambda x: (x[0] is None, x[0] or "")), (5.0, 2.0, 1.0)
    budget, capped = 1.5 * sum(n for _, n in rows), {}
    while True:
        free = [i for i in range(len(order)) if i not in capped]
        level = (budget - sum(capped.values())) / sum(weights[i % 3] for i in free)
        above = {i: 2.0 * order[i][1] for i in free if level * weights[i % 3] > 2.0 * order[i][1]}
        if not above:
            break
        capped |= above
    assert of(rows, weights, 1.5, 2.0) == pytest.approx({s: capped.get(i, level * weights[i % 3]) for i, (s, _) in enumerate(order)})


# Vectors


def test_exact_top_k(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(v) for v in np.float32(r.standard_normal(8))]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, []), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = blockmax.exact_top_k(df, df.where("vec_id % 50 = 0 or vec_id > 899"), shard_rows=100).collect()
    good = {i: np.floor(256 * np.array((v + [0.0] * 8)[:8])) for i, v in rows if i is not None and v is not None and not any(x is None or x != x for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0 or i > 899):
        s = sorted(((-int(good[q] @ good[d]), d) for d in good if d != q))[:5]
        want += [(q, n + 1, d, -x) for n, (x, d) in enumerate(s)]
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted(want)
    assert blockmax.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_leaves_are_skipped_where_rows_cluster(spark):
    """The share of (query, leaf) pairs that are searched falls as clustered rows grow, and the result stays that of brute force."""
    r = np.random.default_rng(3)
    shares = []
    for n in (1000, 8000):
        centre = r.standard_normal((n // 125, 16)) * 4
        v = np.floor(256 * (np.repeat(centre, 125, axis=0) + 0.05 * r.standard_normal((n, 16))))
        df = spark.createDataFrame([(i, x) for i, x in enumerate((v / 256).tolist())], "vec_id long, embedding array<double>")
        spent = {}
        got = blockmax.exact_top_k(df, df.where("vec_id % 50 = 0"), shard_rows=125, spent=spent).toPandas().sort_values(["query_id", "rank"])
        shares.append(spent["searched"] / spent["pairs"])
        for q, g in got.groupby("query_id"):
            s = v @ v[q]
            s[q] = -np.inf
            assert g.vec_id.tolist() == np.lexsort((np.arange(n), -s))[:5].tolist() and g.score.tolist() == sorted(s, reverse=True)[:5]
    assert shares[1] < shares[0] <= 0.2


def test_blocks_are_skipped_where_bounds_tell():
    x = np.vstack([np.full((64, 4), v) + np.arange(64)[:, None] % 3 for v in (0.0, 100.0, 200.0, 300.0)])
    *_, scored = blockmax.block_search(np.ones((1, 4)), np.array([-1]), x, np.arange(len(x)), 5)
    assert scored == 1


def test_index_finds_every_code_within_a_radius():
    r = np.random.default_rng(1)
    code = r.integers(0, 256, (3000, mih.PIECES)).astype(np.uint8)
    code[1:200] = code[0] ^ (np.uint8(1) << r.integers(0, 8, (199, mih.PIECES)).astype(np.uint8)) * (r.random((199, mih.PIECES)) < 0.5)
    index = mih.Index(code)
    apart = np.bitwise_count(code ^ code[0]).sum(axis=1)
    for radius in (0, 1, 7, 8, 13, 24, 31, 64):
        assert index.within(code[0], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_nearest(spark):
    r = np.random.default_rng(2)
    v = r.standard_normal((1500, 32)) * r.uniform(0.5, 2, (1500, 1))
    v[20:60] = v[20]
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)] + [(5000, None), (5001, [0.0] * 32), (5020, [float("inf")] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mih.nearest(df, df.where("vec_id % 20 = 0"), k=10, shard_rows=400).toPandas()
    assert set(got.query_id) == {i for i in range(1500) if i % 20 == 0} and (got.groupby("query_id").size() == 10).all()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        assert np.allclose(g.sort_values("rank").score, s[g.sort_values("rank").vec_id], rtol=1e-12)
        hits += (g.score >= np.sort(s)[-10] - 1e-9).sum()
    assert hits / len(got) >= 0.9
    assert mih.nearest(df.limit(0), df.limit(0)).count() == 0


# Near duplicates


def classes_by_definition(rows):
    words = [re.findall(r"\w+", t.lower()) if t is not None else None for _, t in rows]
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] == rows[b][0]
            if bags[a] is not None and bags[b] is not None:
                both = sum((bags[a] & bags[b]).values())
                same |= both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both)
            elif rows[a][1] is not None and rows[b][1] is not None and not words[a] and not words[b]:
                same |= rows[a][1] == rows[b][1]
            if same:
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_near_duplicates(spark):
    r = random.Random(4)
    vocab = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiouxyzwv"]
    base = [[r.choice(vocab) for _ in range(n)] for n in (60, 120, 300)]
    rows = []
    for n in range(120):  # chains of copies, each some words away from the one before
        w = base[n % 3]
        at = r.randrange(len(w))
        w = w[:at] + [r.choice(vocab)] + w[at + 1 :]
        base[n % 3] = w
        rows.append((n, " ".join(w)))
    rows += [(200 + i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 80)))) for i in range(60)]
    rows += [(300, None), (301, None), (302, ""), (303, ""), (304, "##"), (305, "a b"), (306, "A, b!"), (307, rows[5][1].upper()), (308, "x " * 20000), (308, "x " * 20000), (309, rows[0][1]), (309, "y z w v u t s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    got = neardup.near_duplicates(df).collect()
    assert {x.doc_id: x.class_id for x in got} == classes_by_definition(rows) and len(got) == len({d for d, _ in rows})
    nameless = spark.createDataFrame([(None, rows[0][1]), (None, None), (7, "a b c")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, neardup.near_duplicates(nameless).collect()))) == ["(7, 7, 1)", "(None, None, 1)", "(None, None, 1)"]
    differing = spark.createDataFrame([(7, "a b c", i) for i in range(20)], "doc_id long, text string, n int")
    assert neardup.keep_one(differing).collect() == neardup.keep_one(differing.repartition(4)).collect()
    kept = neardup.keep_one(df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.columns == df.columns
    ids = [x.doc_id for x in kept.collect()]
    assert collections.Counter(ids) == collections.Counter([*set(classes_by_definition(rows).values()), None])
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_wide_buckets(spark, monkeypatch):
    """Texts with a passage in common, in buckets of far more components than a cell holds."""
    monkeypatch.setattr(neardup, "CELL", 4)
    r = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in "aeiou" for c in "nrst"]
    passage = [r.choice(vocab) for _ in range(100)]
    rows = []
    for n in range(150):
        own = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        rows.append((n, " ".join(passage + own)))
        if n % 10 == 0:
            rows.append((1000 + n, " ".join(passage + own[:-4] + [r.choice(vocab)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    widths = []
    kept = neardup.rarest
    monkeypatch.setattr(neardup, "rarest", lambda nodes, bags: widths.append(nodes.count()) or kept(nodes, bags))
    assert {x.doc_id: x.class_id for x in neardup.near_duplicates(df).collect()} == classes_by_definition(rows)
    assert widths and widths[0] > 50


def test_rarest_elements(spark):
    r = np.random.default_rng(4)
    shared = r.integers(0, 2**62, 60)
    bags = [np.unique(np.concatenate([shared, r.integers(0, 2**62, 40)])) for _ in range(300)]  # a passage in common: none can be linked
    bags += [np.unique(np.concatenate([b[:n], r.integers(0, 2**62, 100 - n)])) for b in bags[:40] for n in (86, 88, 90, 92)]
    bags += [r.choice(400, n, replace=False) for n in r.integers(1, 400, 80)] + [np.arange(400)] * 2
    df = spark.createDataFrame([(i.to_bytes(4, "big"), [int(x) for x in b]) for i, b in enumerate(bags)], "node binary, bag array<bigint>")
    keys = collections.defaultdict(set)
    for x in neardup.rarest(df.select("node"), df).collect():
        keys[int.from_bytes(x.node, "big")].add(x.h)
    for a in range(len(bags)):
        for b in range(a):
            both = len(np.intersect1d(bags[a], bags[b], assume_unique=True))
            assert 5 * both < 4 * (len(bags[a]) + len(bags[b]) - both) or keys[a] & keys[b]
    assert not any(keys[i] for i in range(40, 300))


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    off = []
    for _ in range(150):
        base = r.integers(0, 2**63, 300).astype(np.uint64)
        a = r.choice([1, 1, 1, 2, 3, 7], 300)
        b = np.where(r.random(300) < 0.8, a, r.choice([0, 1, 5], 300))
        s = neardup.signatures([np.repeat(base, a), np.repeat(base, b)])
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 4 * np.std(off) / np.sqrt(len(off))


def test_near_duplicate_query(spark):
    rows = list(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None))
    assert {x.doc_id: x.class_id for x in neardup.query(spark, SF).collect()} == classes_by_definition(rows)


# Token counts


def test_rollup(spark, odd):
    store = rollup.Rollup(spark, f"{shared_dir(spark)}/test-{uuid.uuid4().hex}")
    first = rollup.counts(odd, "words", rollup.word_count)
    assert store.totals().count() == 0
    assert store.commit("1", first) and not store.commit("1", first)
    want = collections.Counter()
    for d in ROWS:
        want[d[3], d[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    assert {(r.source, r.lang): r.n_tokens for r in store.totals().collect()} == dict(want)
    store.compact("all")
    assert not store.commit("1", first) and {(r.source, r.lang): r.n_tokens for r in store.totals().collect()} == dict(want)
    assert store.commit("2", rollup.counts(odd, "words", rollup.word_count, -1)) and store.totals().count() == 0
    assert store.commit("3", first.limit(0)) and store.totals().count() == 0


def test_rollup_compaction_loses_nothing(spark, odd):
    rows = rollup.counts(odd, "words", rollup.word_count)
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    store = rollup.Rollup(spark, path)
    n = lambda: store.totals().agg(F.sum("n_docs")).first()[0]
    for k, batch in enumerate(("b1", "b2", "b3")):  # a compaction retried with its own id, and with a batch's
        assert store.commit(batch, rows)
        assert store.compact("all") == (k == 0) and not store.compact("all") and not store.compact("b1")
        assert n() == len(ROWS) * (k + 1)
    assert store.compact("again") and not store.compact("all") and n() == 3 * len(ROWS)
    assert store.covered() == {"b1", "b2", "b3", "all", "again"} and store.committed() == ["again"]
    # A batch between a compaction's listing and its marker stays in force.
    late = rollup.Rollup(spark, path)
    mark = late._mark
    late._mark = lambda *a: (store.commit("between", rows), mark(*a))[1]
    assert late.compact("third") and n() == 4 * len(ROWS) and store.committed() == ["between", "third"]
    # Two writers of one batch: one marker. A compaction that dies before it deletes changes nothing.
    slow = rollup.Rollup(spark, path)
    mark_slow = slow._mark
    slow._mark = lambda *a: (store.commit("twice", rows), mark_slow(*a))[1]
    assert not slow.commit("twice", rows) and n() == 5 * len(ROWS)
    dying = rollup.Rollup(spark, path)
    dying._sweep = lambda markers: None
    assert dying.compact("fourth") and n() == 5 * len(ROWS) and store.committed() == ["fourth"]
    assert not store.commit("twice", rows) and not store.compact("fourth") and n() == 5 * len(ROWS)
    clash = odd.withColumns({c: F.lit(1) for c in ("sign", "tokenizer", "n_tokens", "n_docs")})
    assert store.commit("clash", rollup.counts(clash, "words", rollup.word_count, -1)) and n() == 4 * len(ROWS)


def test_rollup_query(spark, coder):
    want = collections.defaultdict(lambda: [0, 0, 0])
    for d, t, lang, s in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text", "lang", "source"]].itertuples(index=False):
        if d % 2 == 0:
            name, n = "byte_bpe_50k", len(coder.encode_ordinary(t))
        elif "n" not in lang:
            name, n = "words-2", len(re.findall("[A-Za-z]+", t))
        else:
            name, n = "words-1", len(re.findall(r"[^\x20\x09-\x0D]+", t))
        for i, x in enumerate((1, n, len(t))):
            want[s, lang, name][i] += x
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in rollup.query(spark, SF).collect()} == dict(want)
