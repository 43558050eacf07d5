"""The training-data queries against brute force, DuckDB or an exact round trip."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kvlens.llm import chat, fingerprint, jaccard, media, mixing, pieces, queries, secrets, tokens, toxicity
from kvlens.llm.common import Scratch

DATA, LARGER, LARGEST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, key string, class string, bucket int"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    root = str(tmp_path_factory.mktemp("odd"))
    extra = (1, "x", "y", "z", 2)
    long = " ".join(f"wort{i % 977}" for i in range(30_000))
    data = [(1, "a b c d e f", "en", "s0", 11), (1, "a b c d e f", "en", "s0", 11), (2, "", "en", "s0", 0), (3, None, None, None, None), (None, "a b c d e f", None, "s1", None), (None, None, None, None, None), (4, long, "de", "s1", None), (5, long + " ende", "de", "s1", None), (6, 'token = "aZ81kQ0pXw7Lr2Vt" 😀 ﬁne ▁', "en", "s2", 4), (7, " \t\n", "en", "s2", 3), (8, "b" * 50_000, "en", "s2", 9)]
    spark.createDataFrame([d + extra for d in data], DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (4, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    html = "<p>" + "x" * 2000
    spark.createDataFrame([(1, "u", html, 1), (2, None, html, 2), (2, None, html, 2), (None, "v w", html, 3), (4, "u", None, 4), (None, None, None, 5), (5, "u", "", 6)], "page_id long, url string, html string, shards int").write.parquet(f"{root}/pages.parquet")
    turns = [(1, 0, "system", "s"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", None), (1, 2, "bob b", None), (1, None, "ann", "last"), (None, 0, None, "x"), (2, 0, "system", "alone")] + [(3, 5, "c", f"t{i}") for i in range(200)]
    spark.createDataFrame([t + (0, "p") for t in turns], "conv_id long, turn long, role string, text string, block int, perspective string").write.parquet(f"{root}/conversations.parquet")
    return root


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "conversations"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty(spark, odd, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []
    got = queries.QUERIES[name](spark, odd).collect()
    if name == "op4_chat":
        assert got
    else:
        assert len(got) == spark.read.parquet(f"{odd}/{'pages' if name == 'op1_warc' else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{LARGER}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in cols]
    got = queries.QUERIES[name](spark, LARGER)
    assert sorted(got.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_op2(spark, docs):
    got = rows(fingerprint.op2_fingerprints(spark, DATA))
    ids = sorted(docs)
    for i, d in enumerate(ids):
        text, following, half = docs[d], docs[ids[(i + 1) % len(ids)]], len(docs[d]) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(text)
    by_text = defaultdict(set)
    for d in ids:
        by_text[docs[d]].add(got[d].fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_op2_equal_buckets_are_compared(spark, docs):
    """With 8 bits nearly all texts share buckets; fingerprints still part exactly the canonical texts."""
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    forms = rows(df.select("doc_id", fingerprint.canonical(F.coalesce("text", F.lit(""))).alias("c")))
    got = rows(fingerprint.fingerprints(df, Scratch(spark, "t"), bits=8))
    pairs = {(got[d].fingerprint, forms[d].c) for d in got}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_op3(spark, docs):
    sets = {}
    for d, text in docs.items():
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text)]
        sets[d] = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = rows(jaccard.op3_ngram_jaccard(spark, DATA))
    for d in ids:
        assert (got[d].n_shingles, got[d].component_id) == (len(sets[d]), find(d))


@pytest.mark.parametrize("hot", [2, 8])
def test_op3_large_buckets(spark, hot, monkeypatch):
    """A large group of near copies at the rule's edge and many texts that share most of a passage, against brute force."""
    import random

    monkeypatch.setattr(jaccard, "HOT", hot)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    base, passage, texts = [word() for _ in range(120)], [word() for _ in range(90)], []
    for _ in range(150):
        copy = list(base)
        for _ in range(r.randrange(1, 4)):
            copy[r.randrange(len(copy))] = word()
        texts.append(copy)
    texts += [passage + [word() for _ in range(r.randrange(8, 60))] for _ in range(120)]
    texts += [[word() for _ in range(r.randrange(1, 9))] for _ in range(40)] + [["a", "b", "c", "d", x] for x in "efefgh"]
    rule = jaccard.Rule(3, 80, 100)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))} for t in texts]
    least = list(range(len(texts)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    got = rows(jaccard.join_documents(df, Scratch(spark, "t"), rule))
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_one_of_each(spark):
    base = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(5, base, "x"), (3, base + " end", "x"), (None, base, "x"), (9, "other text of its own here", "x"), (9, "other text of its own here", "a"), (7, None, "x"), (8, None, "x")], "doc_id long, text string, class string")
    kept = [(r.doc_id, r["class"]) for r in jaccard.one_of_each(df, Scratch(spark, "t")).collect()]
    assert sorted(kept) == [(3, "x"), (7, "x"), (8, "x"), (9, "a")]


def test_op4_hot_turns_are_in_order(spark, odd):
    """Turn numbers with very many rows, between other turns: the parts of a side in order are the brute-force render."""
    turns = [(3, 4, "a", "before")] + [(3, 5, "c" if i % 3 else "b", f"t{i % 150}") for i in range(300)] + [(3, 6, "b", "after"), (3, 700, "c", "later")]
    turns += [(4, None, "x", f"n{i}") for i in range(100)] + [(None, 1, "y", f"m{i}") for i in range(70)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.rotate(df, Scratch(spark, "t")).orderBy("block", "part").collect()
    assert max(r.n_turns for r in got) <= 64
    for conv in (3, 4, None):
        own = sorted({(t[1] is None, t[1] or 0, t[2], t[3]) for t in turns if t[0] == conv})
        for side in {t[2] for t in own}:
            parts = [r for r in got if r.conv_id == conv and r.perspective == side]
            want = "".join(f"<|im_start|>{'assistant' if s == side else 'user name=' + s}\n{text}<|im_end|>\n" for _, _, s, text in own)
            assert "".join(r.rendered for r in parts) == want
            learnt = [r.rendered[m.start : m.end] for r in parts for m in r["mask"]]
            assert learnt == [f"{text}<|im_end|>" for _, _, s, text in own if s == side]


def test_op4_oracle_on_odd_rows(spark, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{odd}/conversations.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op4_chat"])
    cols = [d[0] for d in want.description]
    got = chat.op4_chat(spark, odd)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_op5_held_out(spark):
    got = rows(toxicity.op5_toxicity(spark, LARGEST))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGEST}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    test = [(r.predicted, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    hits = sum(p and t for p, t in test)
    assert hits >= 0.8 * sum(t for _, t in test) and hits >= 0.9 * sum(p for p, _ in test)


def test_op5_cut_is_chosen_on_folds(spark):
    evil = [(i, 1, ["=evil"]) for i in range(40)]
    rare = [(100 + i, int(i < 6), ["=rare"]) for i in range(12)]  # as often in clean texts: no evidence
    clean = [(1000 + i, 0, ["=calm"]) for i in range(400)]
    sample = spark.createDataFrame(evil + rare + clean, "family long, toxic int, evidence array<string>")
    assert toxicity.least_log_odds(sample) == max(toxicity.CUTS)
    assert set(toxicity.weights(sample)) == {"=evil"}
    assert toxicity.weights(sample.where("toxic = 0")) == {} == toxicity.weights(sample.limit(0))
    assert toxicity.weights(sample.where("family = 1")) == {}


def test_op5_restores():
    import numpy as np

    lm = np.full((28, 28, 28), -3.0).tolist()
    assert toxicity.restore("b4d", lm) == "bad" and toxicity.restore("baaaaad", lm) == "bad"


def test_op6(spark, docs):
    got = rows(media.op6_media(spark, DATA))
    for d, text in docs.items():
        data = text.encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = b"P5\n576 %d\n255\n" % (len(payload) // 576) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_op6_chunks_follow_content():
    import random

    data = random.Random(1).randbytes(60_000)
    assert b"".join(media.chunks(data)) == data
    assert len(set(media.chunks(data)) & set(media.chunks(b"inserted" + data))) >= len(media.chunks(data)) - 3


def library_counts(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    return [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def test_op7(spark, docs):
    got, ids = rows(tokens.op7_token_counts(spark, DATA)), sorted(docs)
    for d, n in zip(ids, library_counts([docs[d] for d in ids]), strict=True):
        assert (got[d].n_tokens, got[d].over_limit, got[d].n_bytes) == (n, n > 1024, len(docs[d].encode()))


ODD_TEXTS = ["Hello  world, it's we're 1234 o'clock!\n\n  <|endoftext|> ok", "überschöne 日本語  x 'll", "", " ", "   ", " \t a", "x  \n", "a\u3000 b", "!'re we'", "<|endoftext|><|endoftext|>", "  <|endoftext|>  end  ", "they'll've'", "😀 é \u0301", "a" * 40, "12345 67"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_op7_every_prefix(text):
    own = tokens.counter(tokens.vocabulary("byte_bpe_50k.json"))
    want = [0, *library_counts([text[:i] for i in range(1, len(text) + 1)])] if text else [0]
    assert own.all_prefixes(text) == want
    for budget in (0, 1, 2, 5, 1000):
        assert own.longest(text, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_op7_table_and_cut(spark, docs, odd):
    """The stored table answers what the query says, in linear time also for a piece of 50,000 letters."""
    for root, limit in ((DATA, 1024), (odd, 1024)):
        df = spark.read.parquet(f"{root}/documents.parquet")
        got = sorted((r.doc_id or -1, r.n_tokens, r.kept_chars) for r in tokens.token_counts(df, limit).collect())
        table = tokens.prefix_counts(df).select("doc_id", tokens.tokens_at(1 << 30).alias("n"), tokens.longest_within(limit).cast("long").alias("kept"))
        assert got == sorted((r.doc_id or -1, r.n, r.kept) for r in table.collect())
    some = [t for t in docs.values() if t][:40]
    own = tokens.counter(tokens.vocabulary("byte_bpe_50k.json"))
    for t in some:
        cut = own.longest(t, 20)
        assert library_counts([t[:cut]])[0] <= 20 and (cut == len(t) or library_counts([t[: cut + 1]])[0] > 20)


def test_op8(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = rows(secrets.op8_secrets(spark, DATA))
    for d, text in docs.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        written = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)]
        assert got[d].base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(got[d].spans.split(",")) | {""}


def mean_ratio(ratios, token):
    codes = secrets.CODE[[ord(c) for c in token]]
    return ratios[codes[:-1], codes[1:]].mean()


def test_op8_ordinary_identifiers_at_two_sizes(spark):
    ordinary = "report_2019_quarter_3 summer-sale-2022-07-01 photos/2015/11/wedding-party-88 invoice_2023_00457 backup-20231104-final products/category-17/item-2041 news/2020/06/local-weather-week-23 max_open_connections getDefaultLocaleName"
    for root in (LARGER, LARGEST):
        ratios = secrets.log_ratios(secrets.train(spark.read.parquet(f"{root}/documents.parquet")))
        assert all(mean_ratio(ratios, t) < secrets.THRESHOLD for t in ordinary.split())
        assert mean_ratio(ratios, "aZ81kQ0pXw7Lr2Vt") > 2 * secrets.THRESHOLD


def test_op8_smoothing_is_free_of_scale(spark):
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    counts = secrets.train(df).cache()
    one, many = (secrets.log_ratios(counts.withColumn("n", F.col("n") * k)) for k in (1, 1000))
    assert abs(mean_ratio(one, "summer-sale-2022-07-01") - mean_ratio(many, "summer-sale-2022-07-01")) < 0.3


def test_op8_random_spans(spark):
    """Planted tokens of few digits and of letters only are found, ordinary text isn't, against a brute-force sum."""
    import random
    import string

    r = random.Random(3)
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    ratios = secrets.log_ratios(secrets.train(df))
    texts = [t for t in ((t.text or "")[:300] for t in df.select("text").limit(400).collect()) if not secrets.base_spans(t)][:200]
    for alphabet, n, least in ((string.ascii_letters + string.digits, 16, 0.97), (string.ascii_letters + "7", 20, 0.97), (string.ascii_letters, 16, 0.97), (string.ascii_letters, 12, 0.9), (string.ascii_letters + string.digits, 8, 0.85)):
        planted = ["".join(r.choices(alphabet, k=n)) for _ in range(200)]
        hits = 0
        for text, token in zip(texts, planted, strict=True):
            whole = f"😀 {text} {token} ordinary words"
            want = []
            for m in re.finditer("[A-Za-z0-9+/_=-]+", whole):
                k = m.group()
                total = sum(ratios[secrets.CODE[ord(a)], secrets.CODE[ord(b)]] for a, b in zip(k, k[1:]))
                if len(k) >= 8 and total >= 8 and total >= 0.7 * (len(k) - 1):
                    want.append(m.span())
            got = secrets.model_spans(whole, ratios, secrets.base_spans(whole))
            assert got == want and {whole[s:e] for s, e in got} <= {token}
            hits += len(got)
        assert hits >= least * 200


def test_op8_overlapping_spans_are_cut(spark):
    ratios = secrets.log_ratios(secrets.train(spark.read.parquet(f"{LARGER}/documents.parquet")))
    head, tail = "0123456789abcdef" * 2, "XqZ81kQ0pXw7Lr2VtR9m"
    text = f"a key {tail[::-1]}-{head}-{tail} there"
    base = secrets.base_spans(text)
    at = text.index(head)
    assert base == [(at, 2, at + 32)]
    assert secrets.model_spans(text, ratios, base) == [(6, at), (at + 32, text.index(" there"))]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.text for r in secrets.redact(df, ratios).collect()] == ["a key [secret][secret][secret] there"]
    assert [r.n_random for r in secrets.scan(df, ratios).collect()] == [2]


def test_op9(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    own, plain = pieces.encoder(tokens.vocabulary("piece_bpe_32k.model")), 0
    for text in list(docs.values())[:60]:
        if text and text[0] != " ":
            assert own.encode(text, 1, 0, 1, 0.0) == model.encode(text)
            plain += 1
    assert plain > 20
    for r in pieces.op9_sentencepiece(spark, DATA).collect():
        assert r.lossless or "▁" in docs[r.doc_id]
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()} == docs
    one, two = (rows(pieces.encode(df, seed=s)) for s in (1, 2))
    assert any(one[d].piece_ids != two[d].piece_ids for d in docs)


def test_op9_draws_each_occurrence(spark):
    text = " ".join(["international"] * 400)
    own = pieces.encoder(tokens.vocabulary("piece_bpe_32k.model"))
    starts = [own.encode(text, 1, doc, 0, 0.1) for doc in (1, 2)]
    assert starts[0] != starts[1] and starts[0] == own.encode(text, 1, 1, 0, 0.1)
    found, word = defaultdict(int), []
    for i in starts[0]:
        if own.pieces[i].startswith("▁") and word:
            found["|".join(word)] += 1
            word = []
        word.append(own.pieces[i])
    assert len(found) > 4
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    assert len({tuple(r.piece_ids) for r in pieces.encode(df, copies=True).collect()}) == 4
    assert len({tuple(r.piece_ids) for r in pieces.encode(df).collect()}) == 3


def test_op9_draws_are_independent():
    """Cached segmentations are those of one run with a draw a candidate, and skips come as often as asked."""
    own = pieces.encoder(tokens.vocabulary("piece_bpe_32k.model"))
    text, dropout, seed = "▁internationalisation", 0.1, 1
    turns, n_skipped = 0, 0
    for doc in range(4000):
        h = int(pieces.place_hashes(pieces.mixed(pieces.mixed(pieces.mixed(seed) ^ doc)), 1)[0])
        first = int(pieces.first_gaps(pieces.np.array([h], pieces.np.uint64), dropout)[0])
        made, n, skipped = own.segment(text, pieces.skipped_turns(first, h, dropout))
        assert own.encode(text[1:], seed, doc, 0, dropout) == own.piece_ids(made) and "".join(made) == text
        turns, n_skipped = turns + n, n_skipped + len(skipped)
    assert abs(n_skipped / turns - dropout) < 0.01


def test_op10(spark):
    got = mixing.op10_mixing(spark, LARGER).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    again = {(r.doc_id, r.taken) for r in mixing.op10_mixing(spark, LARGER).collect()}
    assert again == {(r.doc_id, r.taken) for r in got} and all(0 <= r.taken <= 2 * r["size"] for r in got)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, want = 1.5 * sum(size.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            want[s] = 2.0 * size[s]
            left -= want[s]
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    for s in names:
        assert abs(target[s] - want[s]) < 1e-3 and abs(taken[s] - want[s]) <= 0.05 * want[s] + 100


def test_op10_small_sources_in_a_large_corpus(spark):
    """Sources of one or two blocks come to their targets whatever the total, and the large ones still do."""
    small = {"s1": 300, "s2": 40, "s3": 20, "s4": 33, "s5": 2000}
    large = spark.range(2500).select((F.col("id") + 100).alias("doc_id"), F.when(F.col("id") % 4 == 0, "l1").otherwise("l0").alias("source"), F.lit(20_000).cast("long").alias("size"))
    parts = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(small.items())], "doc_id long, source string, size long")
    mixed = mixing.mix(large.unionByName(parts), Scratch(spark, "t")).collect()
    taken, target, names = defaultdict(int), {}, {i: s for i, s in enumerate(small)}
    for r in mixed:
        s = names.get(r.doc_id) or ("l1" if (r.doc_id - 100) % 4 == 0 else "l0")
        taken[s] += r.taken
        target[s] = r.target
    for s, n in small.items():
        assert (target[s], taken[s]) == (2 * n, 2 * n)
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in ("l0", "l1"))


def test_pipeline(spark, odd, empty):
    import corpus_pipeline

    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    df, before = spark.read.parquet(f"{DATA}/documents.parquet"), None
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, df, DATA), name)
        if name != "sentencepiece":
            assert out.columns == columns
        if name == "secrets":
            ratios = secrets.log_ratios(secrets.train(df))
            assert out.count() == df.count() and not any(secrets.base_spans(r.text or "") for r in out.collect() if "[secret]" not in (r.text or ""))
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None) and ratios.shape == (secrets.SIDE, secrets.SIDE)
        if name == "ngram_jaccard":
            again = jaccard.join_documents(out, scratch, jaccard.Rule())
            assert again.where("component_id <> doc_id").count() == 0
        before, df = df, out
    assert df.count() == before.count() and df.where("NOT lossless").count() == 0
    for root in (odd, empty):
        corpus_pipeline.run(spark, root).collect()


def canonical_form(text):
    import unicodedata

    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"[^\S\x1c-\x1f]+", " ", folded).strip(" ")


def test_op2_likeness(spark, docs):
    """Equal canonical texts, and only those, have equal fingerprints; near_edited and near_next follow from them."""
    got, ids = rows(fingerprint.op2_fingerprints(spark, DATA)), sorted(docs)
    forms, seen = {}, set()
    for i, d in enumerate(ids):
        text, after, half = docs[d], docs[ids[(i + 1) % len(ids)]], len(docs[d]) // 2
        own, edited, following = (canonical_form(t) for t in (text, text[: len(text) - half] + after[:half], after))
        assert (got[d].near_edited, got[d].near_next) == (float(own == edited), float(own == following))
        for form, mark in ((own, got[d].fingerprint), (edited, got[d].edited_fingerprint)):
            assert forms.setdefault(form, mark) == mark
    seen = set(forms.values())
    assert len(seen) == len(forms)


@pytest.mark.parametrize("ids", [[5], [0, 1023, 1024, 5000, 5001], [-3, -1, 7, 7, 10_000_000, 1 << 40]])
def test_op2_sparse_and_repeated_ids(spark, ids):
    texts = [f"text {i} of {k} " * (k + 1) for k, i in enumerate(ids)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)) + [(None, "unnamed text")], "doc_id long, text string")
    got = fingerprint.compare(df, Scratch(spark, "t")).collect()
    assert len(got) == len(ids) + 1
    order = sorted(set(ids))
    least = {i: min(t for j, t in zip(ids, texts, strict=True) if i == j) for i in order}
    want = {hashlib.sha256(b"unnamed text").hexdigest()}
    for i, text in zip(ids, texts, strict=True):
        after = least[order[(order.index(i) + 1) % len(order)]]
        want.add(hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest())
    assert {r.edited_sha256 for r in got} == want


def plain_agenda(own, word, h, dropout):
    """Merge-dropout from its definition: scan for the best candidate, skip by the next draw."""
    parts, skipped, turn = [(i, i + 1) for i in range(len(word))], set(), 0
    turns = pieces.skipped_turns(int(pieces.first_gaps(pieces.np.array([h], pieces.np.uint64), dropout)[0]), h, dropout)
    skip = next(turns)
    while True:
        best = None
        for k in range(len(parts) - 1):
            (a, b), (_, e) = parts[k], parts[k + 1]
            score = own.score.get(word[a:e])
            if score is not None and (a, b, e) not in skipped and (best is None or score > best[0]):
                best = (score, k, (a, b, e))
        if best is None:
            return own.piece_ids([word[a:b] for a, b in parts])
        if turn == skip:
            skipped.add(best[2])
            skip = next(turns)
        else:
            parts[best[1] : best[1] + 2] = [(best[2][0], best[2][2])]
        turn += 1


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_op9_equals_a_plain_agenda(docs, dropout):
    own = pieces.encoder(tokens.vocabulary("piece_bpe_32k.model"))
    texts = [t[:1500] for t in list(docs.values())[:25]] + ["", " ", "😀 日本 aé", "a" * 70 + " b", "ab" * 24 + " " + "ab" * 25]
    flat, ends = own.encode_all(texts, 3, list(range(len(texts))), [1] * len(texts), dropout)
    for i, text in enumerate(texts):
        words = own.words("▁" + text.replace(" ", "▁")) if text else []
        hashes = pieces.place_hashes(pieces.mixed(pieces.mixed(pieces.mixed(3) ^ i) + 1), len(words)).tolist()
        want = [x for w, h in zip(words, hashes, strict=True) for x in plain_agenda(own, w, h, dropout)]
        assert flat[ends[i] : ends[i + 1]].tolist() == want
        assert own.decode(want) == text


def test_values_on_odd_rows(spark, odd):
    """What each operator returns for nulls, empty and long texts, repeated rows and rows without id."""
    data = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    key = lambda rows_: sorted(rows_, key=repr)

    def got(name, *columns):
        return key(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, odd).collect())

    sha = lambda b: hashlib.sha256(b).hexdigest()
    pad = lambda b: b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
    assert got("op6_media", "doc_id", "n_bytes", "payload_sha256") == key((d, len(t.encode()), sha(pad(t.encode()))) for d, t, _ in data)
    assert got("op7_token_counts", "doc_id", "n_tokens") == key((d, n) for (d, _, _), n in zip(data, library_counts([t for _, t, _ in data]), strict=True))
    ids = sorted({d for d, _, _ in data if d is not None})
    least = {i: min(t for d, t, _ in data if d == i) for i in ids}
    after = {i: least[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    edited = lambda d, t: t if d is None else t[: len(t) - len(t) // 2] + after[d][: len(t) // 2]
    assert got("op2_fingerprints", "doc_id", "n_chars", "edited_sha256") == key((d, len(t), sha(edited(d, t).encode())) for d, t, _ in data)
    words = [WORD.findall(t) for _, t, _ in data]
    n_shingles = [len({tuple(w[i : i + 4]) for i in range(len(w) - 3)}) if len(w) >= 4 else int(bool(w)) for w in words]
    assert got("op3_ngram_jaccard", "doc_id", "n_shingles") == key((d, n) for (d, _, _), n in zip(data, n_shingles, strict=True))
    classes = {(r.doc_id, r.component_id) for r in queries.QUERIES["op3_ngram_jaccard"](spark, odd).collect()}
    assert {(4, 4), (5, 4), (1, 1), (2, 2), (3, 3)} <= classes and (None, 1) in classes
    assert got("op10_mixing", "doc_id", "size") == key((d, len(w)) for (d, _, _), w in zip(data, words, strict=True))
    assert all(0 <= r.taken <= 2 * r["size"] for r in queries.QUERIES["op10_mixing"](spark, odd).collect())
    found = got("op8_secrets", "doc_id", "n_assign", "n_access", "n_hex")
    assert (6, 1, 0, 0) in found and (1, 0, 0, 0) in found and (3, 0, 0, 0) in found
    pieces_of = {r.doc_id: r for r in queries.QUERIES["op9_sentencepiece"](spark, odd).collect()}
    assert pieces_of[2].n_pieces == pieces_of[3].n_pieces == 0 and not pieces_of[6].lossless and all(pieces_of[d].lossless for d in (1, 2, 3, 4, 5, 7, 8))
    scores = defaultdict(set)
    for r in queries.QUERIES["op5_toxicity"](spark, odd).collect():
        scores[r.doc_id].add(r.score)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len(scores[1]) == 1 and scores[2] == scores[3]
    pages = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{odd}/pages.parquet").collect()]
    assert got("op1_warc", "page_id", "payload_bytes", "payload_digest") == key((p, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for p, h in pages)


def test_stages_on_odd_rows(spark, odd):
    """What each stage keeps of odd rows, each judged on its own input."""
    import corpus_pipeline

    df = spark.read.parquet(f"{odd}/documents.parquet")
    texts = lambda out: sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert texts(stages["toxicity"](spark, df, odd)) == texts(df)
    kept = texts(stages["ngram_jaccard"](spark, df, odd))
    assert [d for d, _ in kept] == [-1, 1, 2, 3, 4, 6, 7, 8]
    clean = dict(texts(stages["secrets"](spark, df.where("doc_id IN (4, 6, 8)"), odd)))
    assert clean[6].startswith("[secret]") and "aZ81" not in clean[6] and len(clean) == 3
    mixed = texts(stages["mixing"](spark, df, odd))
    assert {d for d, _ in mixed} <= {-1, 1, 4, 5, 6, 8} and all(t for _, t in mixed)
    encoded = stages["sentencepiece"](spark, df, odd)
    assert encoded.count() == df.count() and encoded.where("doc_id IN (2, 3) AND n_pieces > 0").count() == 0
