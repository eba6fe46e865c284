"""Line dedup, quality rules, secrets, language ID, sharding: against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulex.llm import language_id, line_dedup, quality_rules, secret_scan
from tabulex.llm import external_shuffle as sharding
from tabulex.llm.external_shuffle import external_shuffle, write_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


AWKWARD = [None, "", " ", "\n", "\n\n", "a", "a", "x " * 30000, "é" * 10, "Ａ\tb\x0bc\r\nD", "word " * 25, None]


# -- sharding


def test_sharding_law(spark):
    df = table(spark, [f"t{i % 7}" * (i % 50) for i in range(403)] + AWKWARD)
    out = external_shuffle(df, shards=8).select("doc_id", "shard", "slot").toPandas()
    sizes = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["nunique"] == sizes["count"]).all()
    again = external_shuffle(df.repartition(5), shards=8).select("doc_id", "shard", "slot").toPandas()
    assert sorted(map(tuple, out.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    order = out.sort_values(["slot", "shard"]).doc_id.tolist()
    assert order != sorted(order) and order != sorted(order, reverse=True)


def test_sharding_awkward(spark):
    df = table(spark, ["same"] * 40, ids=[1] * 40)
    assert external_shuffle(df, shards=3).count() == 40
    assert external_shuffle(df.limit(0), shards=3).count() == 0
    clash = df.withColumn("shard", F.lit("mine")).withColumn("c0", F.lit(1))
    out = external_shuffle(clash, shards=2)
    assert out.columns == [*clash.columns, "shard", "slot"] and out.count() == 40


def test_buckets_fit_the_executors():
    class Session:
        def __init__(self, **conf):
            self.conf = {f"spark.executor.{k}": v for k, v in conf.items()}

    assert sharding.bucket_size(Session()) == sharding.bucket_size(Session(memory="1800m", cores="2")) >> 25 << 25 == 32 << 20
    assert sharding.bucket_size(Session(memory="28g", cores="4")) == 256 << 20 and sharding.bucket_size(Session(memory="900GB", cores="1")) == 1 << 30
    assert sharding.bucket_size(Session(memory=str(56 << 30), cores="2")) == 1 << 30


def test_sharding_moves_the_texts(spark, tmp_path, monkeypatch):
    docs = table(spark, [f"t{i} é" * (i % 40) for i in range(150)] + AWKWARD)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    real, given = sharding.external_shuffle, []
    monkeypatch.setattr(sharding, "external_shuffle", lambda df, **options: given.append(df.columns) or real(df, **options))
    got = sharding.op6_sharding(spark, str(tmp_path)).collect()
    assert given == [["doc_id", "text"]]
    want = {(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == want and len(got) == len(want)
    write_shards(docs, f"{tmp_path}/shards", shards=3)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(r[0] for r in back.groupBy("shard").count().select("count").collect()) == sorted(len(range(i, len(want), 3)) for i in range(3))
    assert back.select(*docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()


def test_sharding_spreads_equal_rows(spark, monkeypatch):
    df = table(spark, ["same " * 40] * 600 + [f"t{i}" for i in range(100)], ids=[1] * 600 + list(range(100)))
    held, real = {}, sharding.keep
    monkeypatch.setattr(sharding, "keep", lambda d, name: held.setdefault(name, real(d, name)))
    first = external_shuffle(df, shards=4, bucket_bytes=16000).collect()
    most = held["buckets"].groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert most < 200 and len(first) == 700 and len({(r["shard"], r["slot"]) for r in first}) == 700
    held.clear()
    again = external_shuffle(df.repartition(5), shards=4, bucket_bytes=16000).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again)) and sum(r["text"] == "same " * 40 for r in first) == 600


# -- line dedup


def dedup(texts, least, first):
    """texts in order of id."""
    lower = {i: i + 32 for i in range(65, 91)}
    split = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(lower) for x in s] for s in split]
    docs = Counter(k for ks in keys for k in set(ks) if k)
    out, seen = [], set()
    for s, ks in zip(split, keys, strict=True):
        kept = []
        for line, k in zip(s, ks, strict=True):
            if k and docs[k] >= least:
                if not first or k in seen:
                    continue
                seen.add(k)
            kept.append(line)
        out.append(("\n".join(kept), len(s), len(s) - len(kept)))
    return out


@pytest.mark.parametrize("least,first,keys", [(2, True, 1000), (2, True, 0), (3, False, 1000), (3, False, 0)])
def test_line_dedup(spark, least, first, keys):
    r = random.Random(least)
    lines = [f"Line {i}" + " " * (i % 3) for i in range(40)] + ["", "ÀB", "àb"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 12))) for _ in range(60)] + AWKWARD
    got = line_dedup.line_dedup(table(spark, texts), min_docs=least, keep_first=first, broadcast_keys=keys).toPandas().sort_values("doc_id")
    assert list(zip(got.text, got.n_lines, got.n_dropped, strict=True)) == dedup(texts, least, first)


def test_line_dedup_awkward(spark):
    empty = table(spark, []).withColumn("n_lines", F.lit(1))
    assert line_dedup.line_dedup(empty).count() == 0
    same = table(spark, ["a\nb"] * 12, ids=[None] * 12)
    out = line_dedup.line_dedup(same, min_docs=10, keep_first=False).toPandas()
    assert (out.text == "").all() and (out.n_dropped == 2).all()


def test_filters_miss_nothing():
    f = line_dedup.Filters(1 << 18)
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 62, 500, dtype=np.uint64), r.integers(0, 1 << 62, 500, dtype=np.uint64)
    f.see(a)
    f.see(np.concatenate([a[:100], b]))
    assert f.has(f.twice, a[:100]).all()
    assert f.has(f.twice, np.concatenate([a[100:], b])).mean() < 0.05


# -- quality rules


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    r = random.Random(4)
    passage = [f"p{i}" for i in range(11)]
    texts = list(AWKWARD)
    for _ in range(60):
        words = [r.choice(["a", "b", "c#", "d|e", "long" * 3]) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(0, len(words) + 1)
            words[at:at] = passage[: r.randrange(7, 12)]
        texts.append("".join(w + r.choice([" ", "\n", "  ", "\n\n", "\t"]) for w in words))
    got = quality_rules.with_statistics(table(spark, texts)).toPandas().sort_values("doc_id")
    own = list(zip(got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, strict=True))
    assert own == [statistics(t) for t in texts]


def test_cascade(spark):
    texts = [*AWKWARD, " ".join(f"word{i}" for i in range(40)), "x | " * 30, " ".join(f"WORD{chr(65 + i)}" for i in range(26)), " ".join(str(i * 37) for i in range(40))]
    df = quality_rules.with_statistics(table(spark, texts))
    kept = quality_rules.cascade(df, quality_rules.RULES, df)
    columns = {x: F.col(x) for x in df.columns} | quality_rules.made("text", quality_rules.VALUES)
    rejected = F.lit(False)
    for rule in quality_rules.RULES:
        rejected = rejected | F.coalesce(rule.reject(columns), F.lit(False))
    want = {tuple(r) for r in df.select("doc_id", (~rejected).alias("kept")).collect()}
    assert {tuple(r) for r in kept.select("doc_id", "kept").collect()} == want and sum(k for _, k in want) == 1
    clash = table(spark, ["a b"]).withColumn("n_words", F.lit("mine")).withColumn("t", F.lit(1))
    assert quality_rules.with_statistics(clash).columns == [*clash.columns, *quality_rules.STATISTICS]
    empty = quality_rules.with_statistics(table(spark, []))
    assert quality_rules.cascade(empty, quality_rules.RULES, empty).count() == 0


def test_rules_go_by_rejection_per_cost():
    a, b, c = (quality_rules.Rule(x, None, n) for x, n in (("a", ()), ("b", ("v",)), ("c", ("v",))))
    cost = {"a": 1.0, "b": 1.0, "c": 1.0, "v": 9.0}
    # a rejects 10 rows, b 200, c 150 of which 140 are b's too
    rejected = {0b001: 10, 0b010: 60, 0b110: 140, 0b100: 10, 0: 1000}
    assert [(r.name, n, p) for r, n, p in quality_rules.arranged(rejected, (a, b, c), cost)] == [("b", 200, 10.0), ("a", 10, 1.0), ("c", 10, 1.0)]
    assert [r.name for r, _, _ in quality_rules.arranged({0: 5}, (b, a, c), cost)] == ["a", "b", "c"]


def test_rejected_rows_skip_the_rest(spark):
    """A value that fails when it is made isn't made for rows that an earlier rule rejects."""
    docs = table(spark, ["bad", "good text", "bad", "better"]).withColumn("n", F.length("text"))
    rules = (quality_rules.Rule("costly", lambda c: c["v"] > 100, ("v",)), quality_rules.Rule("short", lambda c: c["n"] < 4))
    values = {"v": lambda t: F.when(t == "bad", F.raise_error(F.lit("made for a rejected row")).cast("int")).otherwise(F.length(F.regexp_replace(t, "[aeiou]", "")))}
    # in the sample the costly rule rejects nothing, so it goes last
    out = quality_rules.cascade(docs, rules, docs.where("n > 4"), values=values)
    assert sorted(tuple(r) for r in out.select("doc_id", "kept").collect()) == [(0, False), (1, True), (2, False), (3, True)]
    with pytest.raises(Exception, match="made for a rejected row"):
        quality_rules.cascade(docs, rules[:1], docs.where("n > 4"), values=values).collect()


# -- secrets


def naive_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(out)


HEX = "0123456789abcdef" * 3


def test_secret_patterns(spark):
    r = random.Random(8)
    bits = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", " = ", ":", '"', "'", "abcd1234", "x", "AKIA", "ABCDEF123456", HEX[:31], HEX[:33], "é", "\n", "ſecret", "token=secret:abcdefgh", "-"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 14))) for _ in range(300)]
    assert [secret_scan.patterns(t) for t in texts] == [naive_spans(t) for t in texts]
    docs = table(spark, texts + AWKWARD)
    got = secret_scan.scan(docs, secret_scan.Field()).toPandas().sort_values("doc_id")
    for t, row in zip([*texts, *AWKWARD], got.itertuples(), strict=True):
        spans = naive_spans(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in row.spans.split(",") if x and not x.startswith("crf")] == [x for x in text.split(",") if x]


def value_of(f, s, tags):
    return sum(s[i][x] for i, x in enumerate(tags)) + sum(f.t[a, b] for a, b in zip((secret_scan.OUTSIDE, *tags), (*tags, secret_scan.OUTSIDE), strict=True))


def test_viterbi_is_the_best_tagging():
    r = np.random.default_rng(3)
    for trial in range(60):
        f = secret_scan.Field()
        f.t[:2] = r.normal(size=(2, 3))
        f.t[2, [0, 2]] = r.normal(size=2)
        s = r.normal(size=(5, 3)) * 2
        s[:, 2] += r.choice([0, 2, 6], size=5)  # some tokens lead by much, others by little
        best = max(product(range(3), repeat=5), key=lambda tags: value_of(f, s, tags))
        assert tuple(f.viterbi(s)) == best
        assert tuple(f.best(s, np.zeros(5, int))) == best
        line = np.array([0, 0, 1, 1, 1])
        assert f.best(s, line).tolist() == f.viterbi(s[:2]) + f.viterbi(s[2:])


def test_field_finds_secrets_without_a_keyword(spark):
    r = random.Random(5)

    def hexed(n):
        return "".join(r.choice("0123456789abcdef") for _ in range(n))

    words = [f"word{c}" for c in "abcdefgh"]
    texts = []
    for i in range(400):
        line = [r.choice(words) for _ in range(20)]
        line.insert(5, f'token = "{hexed(40)}"' if i % 2 else f"{r.randrange(10**15, 10**16)}")
        line.insert(9, f"{r.randrange(256)}.{r.randrange(256)}.123.{r.randrange(100, 256)}")
        texts.append(" ".join(line))
    field = secret_scan.learn(table(spark, texts))
    hidden = ["see " + hexed(28) + " there", "call 4785380592391139 now", "at 152.143.123.131 port", "plain words only"]
    got = secret_scan.scan(table(spark, hidden), field).toPandas().sort_values("doc_id").spans.tolist()
    assert got[0] == "crf:4:32" and got[1:] == ["", "", ""]
    assert secret_scan.scan(table(spark, []), secret_scan.learn(table(spark, []))).count() == 0


def test_gradient_by_all_taggings():
    """Chains of several lengths side by side, each against the sum over all its taggings."""
    r = np.random.default_rng(8)
    f = secret_scan.Field()
    f.t[:2] = r.normal(size=(2, 3))
    f.t[2, [0, 2]] = r.normal(size=2)
    size = np.array([1, 4, 3, 4])
    s, tags = r.normal(size=(4, 4, 3)), np.array([[2, 2, 2, 2], [0, 1, 2, 0], [2, 0, 1, 2], [2, 2, 2, 2]])
    own, pair = f.gradient(s, tags, size)
    want_pair = np.zeros((3, 3))
    for c, n in enumerate(size):
        every = list(product(range(3), repeat=n))
        p = np.exp([value_of(f, s[c], x) for x in every])
        p /= p.sum()
        want = np.zeros((4, 3))
        for x, q in [*zip(every, p, strict=True), (tuple(tags[c, :n]), -1.0)]:
            for i, k in enumerate(x):
                want[i, k] += q
            for a, b in zip((secret_scan.OUTSIDE, *x), (*x, secret_scan.OUTSIDE), strict=True):
                want_pair[a, b] += q
        assert np.allclose(own[c], want, atol=1e-9)
    assert np.allclose(pair, want_pair, atol=1e-9)


def naive_tokens(text):
    """Tokens of a text's bytes with the rows of their features, one at a time and by definition."""
    raw = text.encode()
    tokens = [m.span() for m in re.finditer(rb"[A-Za-z0-9+/_.=-]+", raw)]
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(rb"[A-Za-z]+", raw)]

    def spot(name, value):
        return int(secret_scan.spot(name, np.array([value], np.uint64))[0])

    def hashed(w):
        return int(secret_scan.run_hashes(np.frombuffer(w, np.uint8), np.array([len(w)]))[0])

    def kind(c):
        return 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4

    out = []
    for s, e in tokens:
        w, n = raw[s:e], e - s
        kinds = [kind(c) for c in w]
        squeezed = [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k]
        count = {k: kinds.count(k) for k in (1, 2, 3, 4)}
        values = [
            ("bias", 0),
            ("length", min(12, n // 4)),
            ("shape", sum(k * 5**i for i, k in enumerate(squeezed[:6]))),
            ("set", sum(1 << k for k in set(kinds))),
            ("digits", (5 * count[3] + n // 2) // n),
            ("upper", (5 * count[2] + n // 2) // n),
            ("signs", min(4, count[4])),
            ("distinct", min(31, len(set(w)))),
            ("varied", 8 * len(set(w)) // n),
            ("switches", (8 * (len(squeezed) - 1) + n // 2) // n),
            ("hex", 2 * all(c in b"0123456789abcdef" for c in w) + (n >= 32)),
            ("start", sum(c << 8 * i for i, c in enumerate(w[:4])) + (1 << 40) if count[2] else sum(k << 3 * i for i, k in enumerate(kinds[:4]))),
            ("number", 2 * all(c in b"0123456789.-+" for c in w) + (count[3] == n)),
        ]
        rows = [spot(*v) for v in values]
        left = [x for x in words if x[1] <= s][::-1]
        rows += [spot(name, hashed(x[2])) for name, x in zip(("left", "left but one"), left, strict=False) if s - x[1] <= 40]
        right = [x for x in words if x[0] >= e][:1]
        rows += [spot("right", hashed(x[2])) for x in right if x[0] - e < 20]
        code = 0
        for c in raw[max(0, s - 4) : s]:
            if chr(c) in "=:\"'@$ ":
                code = code * 8 + 1 + "=:\"'@$ ".index(chr(c))
        rows += [spot("sign", code), spot("after", min(raw[e], 128) if e < len(raw) else 129)]
        rows += [spot("file signs", min(5, 200 * (raw.count(b"=") + raw.count(b"{")) // len(raw))), spot("file length", min(8, (len(raw).bit_length() - 1) // 2))]
        out.append((s, e, raw[:s].count(b"\n"), rows))
    return out


def test_every_token_is_a_state_of_its_line(spark, monkeypatch):
    r = np.random.default_rng(4)
    f = secret_scan.Field()
    f.w[:-1] = r.normal(size=(secret_scan.DIM, 3))
    f.t[:2] = r.normal(size=(2, 3))
    bits = ["pwd", "Xy7kq2Lm9", "CorrectHorseBattery", "a.b-c", "12", "é", ":", " = ", "\n", " ", " ", "x" * 30, " " * 25, "\n\n", "f00d" * 9, "{", '"']
    texts = ["".join(r.choice(bits) for _ in range(r.integers(0, 40))) for _ in range(60)] + ["", "\n", "end"]
    for block in (secret_scan.BLOCK, 50):  # tokens made block by block are the same
        monkeypatch.setattr(secret_scan, "BLOCK", block)
        got = f.decode([t.encode() for t in texts])
        for t, tagged in zip(texts, got, strict=True):
            want, tokens = [], naive_tokens(t)
            for line in {x[2]: None for x in tokens}:
                own = [x for x in tokens if x[2] == line]
                tags = f.viterbi(np.array([f.w[x[3]].sum(axis=0) for x in own]))
                want += [(s, e, k) for (s, e, _, _), k in zip(own, tags, strict=True) if k != secret_scan.OUTSIDE]
            assert tagged == want, (block, t)


def test_spans_beside_the_patterns(spark):
    """A tagged token that a pattern's span touches goes alone; offsets are code points; clashing columns stay."""
    f = secret_scan.Field()
    f.w[secret_scan.spot("bias", np.zeros(1)), secret_scan.OUTSIDE] = 1
    for word in (b"pwd", b"see"):
        f.w[secret_scan.spot("left", secret_scan.run_hashes(np.frombuffer(word, np.uint8), np.array([3]))), secret_scan.BEGIN] = 9
    f.w[secret_scan.spot("number", np.array([3])), secret_scan.INSIDE] = 4  # digits alone go on
    texts = ["é pwd: Xy7kq2Lm9", f"pwd {HEX[:40]} 12345 plain", "plain words only", None, "see Ab 88 99 é" + " far" * 100000]
    docs = table(spark, texts).withColumn("spans", F.lit("mine")).withColumn("n_hex", F.lit(True))
    out = secret_scan.scan(docs, f)
    assert out.columns == [*docs.columns, *secret_scan.OUT]
    got = {x[0]: x for x in out.collect()}
    assert [got[i][-1] for i in range(5)] == ["crf:7:16", "hex:4:44,crf:45:50", "", "", "crf:4:12"] and all(x[5] == "mine" and x[6] is True for x in got.values())


def test_planted_secrets_without_a_pattern(spark):
    """The field learns from patterned secrets and finds others that have no pattern's form."""
    r = random.Random(15)
    letters, words = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", [a + b + c for a in ("ta", "mo", "si") for b in ("ren", "lo", "ka") for c in ("", "t", "me")]

    def key(n):
        return "".join(r.choice(letters) for _ in range(n))

    def line(*more):
        out = [r.choice(words) for _ in range(15)]
        return " ".join([*out[:7], *more, *out[7:]])

    texts = [line(r.choice([f'password = "{key(20)}"', f"api_key: {key(24)}", f"AKIA{key(16).upper()}", f"secret={key(18)}"])) if i % 2 else line(str(r.randrange(10**12)), f"{r.randrange(2000)}-03-04T10:00:00", r.choice(words).upper() + "12") for i in range(600)]
    field = secret_scan.learn(table(spark, texts * 3))
    planted = [f"ghp_{key(24)}" for _ in range(30)] + [f"xoxb-{key(22)}" for _ in range(30)] + [key(40) for _ in range(10)] + [f"pwd: {key(12)}" for _ in range(10)]
    clean = [line(str(r.randrange(10**12)), f"{r.randrange(2000)}-07-09T11:30:00") for _ in range(80)]
    got = {x["doc_id"]: x["spans"] for x in secret_scan.scan(table(spark, [line("see", p) for p in planted] + clean), field).collect()}
    assert sum("crf" in got[i] for i in range(80)) >= 76
    assert sum("crf" in got[i] for i in range(80, 160)) <= 2


# -- language


def spoken(r, kind, n):
    parts = {"aa": ["ba", "da", "ga", "la"], "ee": ["bré", "né", "té", "sé"], "oo": ["würo", "moß", "kro", "to"]}[kind]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_language_held_out(spark):
    r = random.Random(6)
    kinds = [r.choice(["aa", "ee", "oo"]) for _ in range(300)]
    rows = [(i, spoken(r, k, r.randrange(3, 40)), k, "s", 0) for i, k in enumerate(kinds)]
    odd = [(1000 + i, t, None, "s", 0) for i, t in enumerate([None, "", "123 !!", "\n", "é" * 300000])]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("score", F.lit("mine"))
    out = language_id.predict(docs, language_id.learn(docs))
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    got = {x[0]: (x[-2], x[-1]) for x in out.collect()}
    assert np.mean([got[i][0] == k for i, k in enumerate(kinds)]) > 0.97
    assert [got[1000 + i][0] for i in range(4)] == ["und"] * 4 and got[1004][0] in ("aa", "ee", "oo")
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = language_id.language_filter(docs)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.select("doc_id").collect()} & {1000, 1001, 1002, 1003}


def test_language_without_labels(spark):
    docs = table(spark, ["some words", None]).withColumn("lang", F.lit(None).cast("string"))
    out = language_id.predict(docs, language_id.learn(docs)).select("lang_pred", "score").collect()
    assert {tuple(r) for r in out} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), language_id.learn(docs.limit(0))).count() == 0


def features_of(texts):
    """All features of each text, in order of n-gram length and place."""
    own = [[[], [], []] for _ in texts]
    for segment in language_id.segments(texts):
        out, begins, ends = language_id.grams(segment)
        for n in range(3):
            for k, i in enumerate(segment.numbers):
                own[i][n] += out[n][begins[n][k] : ends[n][k]].tolist()
    return own


def test_features_do_not_depend_on_company_or_seams(monkeypatch):
    r = random.Random(9)
    texts = ["Abc dé", "x", "", None, "gh 12 ij", "".join(r.choice("abc dé1") for _ in range(97)), "z"]
    whole = features_of(texts)
    assert [features_of([t])[0] for t in texts] == whole
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language_id, "SEGMENT", size)
        assert features_of(texts) == whole, size


def test_a_text_over_many_segments(spark):
    """A language of one letter pair, which stands on the seam of a text of 300,000 characters and nowhere else."""
    seam = language_id.SEGMENT
    long = " " * (seam - 1) + "qx" + " " * (300_000 - seam - 1)
    assert sum(map(len, features_of([long])[0])) == sum(map(len, features_of([" qx "])[0])) == sum(map(len, features_of(["qx"])[0]))
    assert sorted(features_of([long])[0][2]) == sorted(features_of(["qx"])[0][2])


def test_copies_do_not_grow_the_sample(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, "the same text again" if i % 3 else spoken(r, "aa", 12), "l1" if i % 2 else "l2", "s", 0) for i in range(900)]
    seen = []
    monkeypatch.setattr(language_id, "train", lambda rows, idf: seen.append(len(rows)))
    docs = spark.createDataFrame(rows, SCHEMA)
    language_id.fit(docs.select("lang", "text"))
    assert 200 <= seen[0] <= 302 + 2  # each different text once for each language
    monkeypatch.setattr(language_id, "TOTAL", 60)
    language_id.fit(docs.select("lang", "text"))
    assert seen[1] <= 120


def test_filter_without_labels_keeps_texts_with_letters(spark):
    docs = table(spark, ["some words", None, "12 !", "é", ""]).withColumn("lang", F.lit(None).cast("string")).withColumn("C0", F.lit(1))
    kept = language_id.language_filter(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 3}


def test_letters_of_all_planes():
    table = language_id.letters()
    assert table[[0x41, 0xE9, 0x4E00, 0x20000, 0x30000, 0x3134A, 0x31350, 0x323AF]].all()
    assert not table[[0x20, 0x31, 0xD800, 0x1F600, 0xE0041, 0x10FFFF]].any()


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    rows = []
    for i in range(500):
        y = i % 2
        f = np.sort(r.choice(np.arange(50) + 30 * y, 8, replace=False))
        rows.append((f"l{y}", f, np.ones(8, np.uint32)))
    m = language_id.train(rows, np.ones(language_id.DIM))
    p = []
    for y, f, n in rows:
        x = n / n.sum()
        q = language_id.softmax(x @ m.weights[f] + m.bias)
        p.append((q.max(), m.languages[q.argmax()] == y))
    assert abs(np.mean([a for a, _ in p]) - np.mean([b for _, b in p])) < 0.1
    assert math.isfinite(float(m.weights.sum())) and (m.weights == 0).mean() > 0.9

