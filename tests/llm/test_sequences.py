"""Runs, the prefix trie and token counts against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticelake.llm import periodic, prefix_trie, queries, token_counts

SF = "/root/testdata/sf0.001"
WORDS = "[^\x20\x09-\x0d]+"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# ---- 11


def brute_runs(w, shortest=24):
    """Every stretch that keeps a period and cannot grow, by comparing words; equal stretches keep the smallest period."""
    out = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(shortest, 3 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, z - a, p) for (a, z), p in out.items()), key=lambda x: (x[0], x[2]))


def left(w, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rnd):
    """Words of a small alphabet, often with a repetition, sometimes a broken one."""
    n, letters = rnd.choice([0, 1, 5, 24, 30, 100, 200]), "abcdefg"[: rnd.choice([1, 2, 3, 5])]
    w = [rnd.choice(letters) for _ in range(n)]
    if n and rnd.random() < 0.7:
        a = rnd.randrange(n)
        p = 1 + (n - a) // (3 + rnd.randrange(8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    if n and rnd.random() < 0.3:
        w[rnd.randrange(n)] = "z"
    return w


@pytest.mark.parametrize("shortest", [24, 3])
@pytest.mark.parametrize("dense", [1 << 22, 8])
def test_runs_equal_brute_force(monkeypatch, shortest, dense):
    monkeypatch.setattr(periodic, "_DENSE", dense)  # also with two of three levels left out
    rnd = random.Random(shortest)
    for _ in range(100):
        rows = [some_words(rnd) for _ in range(rnd.randint(1, 6))]
        for w, got in zip(rows, periodic._of(pa.array([" ".join(w) for w in rows]), shortest).to_pylist(), strict=True):
            want = brute_runs(w, shortest)
            assert [(x["start"], x["length"], x["period"]) for x in got["runs"]] == want, w
            assert got["text"] == left(w, want) and got["n_words"] == len(w)


def test_equal_names_of_different_words_are_found_out(monkeypatch):
    real = periodic._names
    monkeypatch.setattr(periodic, "_names", lambda ids, seed: real(ids % 2 if seed == 0 else ids, seed))
    w = [str(i) for i in range(200)]  # named like two words that alternate, at the first attempt
    assert periodic._of(pa.array([" ".join(w)]), 24).to_pylist()[0]["runs"] == []


def test_a_long_text_of_one_word_takes_no_square_time():
    got = periodic._of(pa.array(["a " * 200_000]), 24).to_pylist()[0]
    assert got == {"n_words": 200_000, "runs": [{"start": 0, "length": 200_000, "period": 1}], "text": "a"}


def wanted_runs(key, text):
    w = re.findall(WORDS, text or "")
    h, n = zlib.crc32(str(key).encode()), len(w)
    if key is not None and h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None, None, None)
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(left(w, runs)))


def test_run_query_equals_brute_force(spark, texts):
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        if len(text or "") < 6000:
            assert got[key] == wanted_runs(key, text)
    assert sum(x[1] for x in got.values()) > 30


def test_run_query_on_odd_rows(spark, monkeypatch):
    rows = [(k, x) for k in (None, 0, 1, 6, 29, 29, 10**6) for x in (None, "", " \n", "a", "a b", "a b c " * 30)]
    monkeypatch.setattr(queries, "_documents", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, queries.op11_periodic_runs(spark, SF).collect()))) == sorted(str(wanted_runs(*r)) for r in rows)
    monkeypatch.setattr(queries, "_documents", lambda *_: spark.createDataFrame([], "doc_id long, text string"))
    assert queries.op11_periodic_runs(spark, SF).collect() == []


def test_runs_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "x y " * 20, 5, 6)], "doc_id long, text string, runs int, n_words int")
    row = periodic.with_runs(df).collect()[0]
    assert (row["runs"], row["n_words"], row["periodic"]["text"], row["periodic"]["n_words"]) == (5, 6, "x y", 40)


# ---- 12


def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in conv.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(int)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = {k: ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))) for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], sha(ends[k])) for k, m in nodes.items())


def trie_rows(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def rebuilt(df):
    found = prefix_trie.sequences(df)
    return prefix_trie.rebased(found, F.col("c") - F.col("c") % 100, (F.crc32(F.col("c").cast("string").cast("binary")) % 6).cast("int"), 5)


def test_trie_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op12_prefix_trie(spark, SF)) == brute_trie(rows)


@pytest.mark.parametrize("shard", [4, 12, 60])
def test_trie_over_many_shards(spark, monkeypatch, shard):
    """Few turns a shard, many equal conversations and lists of ids in many pieces: most nodes are boundary nodes."""
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rnd, rows = random.Random(shard), [(None, 0, "user", "nobody's")]
    for c in rnd.sample(range(-150, 400), 60):
        same = rnd.random() < 0.5
        for t in range(2 if same else rnd.choice([1, 2, 5, 9])):
            rows.append((c, None if t == 0 and c % 2 else t, "user" if same else rnd.choice(["user", None]), "again" if same else rnd.choice(["", None, "hi", "hello é there"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS c", "2 AS path", "3 AS turns", "4 AS shard")
    assert trie_rows(prefix_trie.trie(rebuilt(df))) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(rebuilt(spark.createDataFrame([], schema))).collect() == []
    rows = [(7, 1, "user", "x"), (7, 1, "user", "x"), (8, None, None, None), (9, 1, "user", "x"), (9, 1, "user", "x")]
    got = trie_rows(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(rows, schema))))
    none = sha("")
    assert got == [(7, 0, -1, 3, 2, 2, 2, none), (7, 1, 7, 2, 1, 1, 2, none), (7, 2, 7, 2, 0, 1, 1, sha("7,9")), (8, 1, 7, 1, 0, 1, 0, sha("8"))]


def test_a_turn_of_another_role_is_another_turn(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "", "abc")]
    assert len(trie_rows(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))) == 4


def test_median_insertion_balances_the_tree():
    tree = prefix_trie._Tree()
    for k in prefix_trie._medians(1000):
        tree.insert([k])

    def height(at):
        return 1 + max(height(tree.low[at]), height(tree.high[at])) if at else 0

    assert height(tree.down[0]) == 10


# ---- 13


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.MODEL)


def wanted_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_query_equals_the_library(spark, library, texts):
    rows = queries.op13_token_counts(spark, SF).collect()
    want = dict(zip(texts, wanted_counts(library, texts.values()), strict=True))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def test_counts_of_odd_texts(library):
    parts = [*"abcdeklmrstv'''!.,0123  ABDST<>|", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "é", "İ", "ß", "́", "Σ", "🤗", "\x01", "\x00", "\x1c", "\x85", " ", "ǅ", "٣", "Ⅷ", "'re", "'LL", "don't", "\n", "\t"]
    rnd = random.Random(13)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 2, 3, 5, 10, 60]))) for _ in range(5000)]
    texts += [None, "", " ", "x" * 5000, "ab" * 3000, "<|endoftext|>" * 3, "ends with <", "|>", "\x01", "é\x01 a", "'", "a'", "'s's", "ein Wort " * 2000]
    assert token_counts.counts(pa.array(texts)).tolist() == wanted_counts(library, texts)
    assert token_counts.counts(pa.array([], pa.string())).tolist() == []


def test_proven_strings_are_one_token_among_others(library):
    proven = [x.decode() for x in token_counts.prove().to_pylist()]
    assert len(proven) > 30_000
    for a, b in zip(proven, proven[7:] + proven[:7], strict=True):
        assert len(library.encode(f"{a} {b}", add_special_tokens=False).ids) == 2


def test_merges_alone_count_like_the_library(library):
    rnd = random.Random(3)
    strings = list({"".join(rnd.choice("abcdeinrst'!") for _ in range(rnd.randint(1, 40))) for _ in range(3000)})
    letters = [s for s in strings if s.isalpha()]
    assert token_counts._merged(pa.array([s.encode() for s in letters], pa.large_binary()), token_counts.MODEL).tolist() == wanted_counts(library, letters)


def test_other_vocabularies_are_refused(spark):
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.with_counts(spark.createDataFrame([("a",)], "text string"), model=public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_keep_other_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "Hello, don't", 6)], "n_bytes int, text string, counts int")
    assert [(r["counts"], r["n_tokens"]) for r in token_counts.with_counts(df).orderBy("n_bytes").collect()] == [(5, 0), (6, 4)]
