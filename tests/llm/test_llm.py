"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import math
import pathlib
import random
import re
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from noticelake.llm import decontaminate, html_text, langid, media, near_copies, pieces, pii, preferences, queries, sharding, simhash, substrings
from tests.compare import connect, rows_of, sql_rows

SF = "/root/testdata/sf0.001"
WORDS = "[^\x20\x09-\x0d]+"
#: Nulls, empty and blank texts, repeated rows, ties, a long text, and columns with clashing names.
ODD = [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "One two three.", "en"), (4, "One two three.", "en"), (5, "one TWO three.", "fr"), (None, "no key here at all", "en"), (6, "x" * 5000 + " " + "word " * 3000, "en")]
CLASH = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, CLASH)
    return rows.selectExpr("*", "1 AS key", "2 AS id", "3 AS fp", "4 AS part", "5 AS count", "6 AS n", "7 AS base", "8 AS seed")


# ---- 1


def test_languages_held_out(spark):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and not any(r["rejected"] for r in rows)


def brute_kneser_ney(counts, size):
    """Probabilities by the textbook recursion over dictionaries: tuples of symbols to counts."""
    levels = [counts]
    for _ in range(langid.ORDER - 1):
        lower = {}
        for g in levels[0]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.insert(0, lower)

    def p(g):
        if not g:
            return 1 / size
        level = levels[len(g) - 1]
        once, twice = (sum(c == k for c in level.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        beside = {k: c for k, c in level.items() if k[:-1] == g[:-1]}
        if not beside:
            return p(g[1:])
        total = sum(beside.values())
        return max(beside.get(g, 0) - d, 0) / total + d * len(beside) / total * p(g[1:])

    return p


def test_language_models_equal_brute_force():
    table = langid.symbol_table(list("abcdefghijklmnopqrstuvwxyz"))
    code, _ = langid.ngrams(*langid.symbols(pa.array(["the cat sat on the mat", "der hund und die katze", "ein haus", "the the hat"]), table)[:2])
    gram, n = np.unique(code, return_counts=True)
    size = 28
    model = langid.kneser_ney(gram, n, size)
    split = lambda g: tuple(int(g) >> langid.BITS * i & langid.OTHER for i in range(langid.ORDER - 1, -1, -1))
    join = lambda x: sum(int(v) << langid.BITS * i for i, v in enumerate(reversed(x)))
    p = brute_kneser_ney({split(g): int(c) for g, c in zip(gram, n, strict=True)}, size)
    symbols = [*range(27), langid.OTHER]
    asked = np.concatenate((gram, np.array([join(x) for x in np.random.default_rng(0).choice(symbols, (200, langid.ORDER))], np.uint64)))
    assert np.allclose(np.exp(model.score(asked)), [p(split(g)) for g in asked], atol=1e-6)
    for context in (split(gram[3])[:-1], (3, 2, 1)):
        assert abs(np.exp(model.score(np.array([join((*context, x)) for x in symbols], np.uint64))).sum() - 1) < 1e-4


def test_languages_of_large_alphabets(spark):
    """Two scripts of 600 letters each beside English and German: no letter is shared, so no text is taken for another's."""
    rnd = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang in ('en', 'de')").select("doc_id", "text", "lang")
    scripts = {"xa": [chr(0x4E00 + i) for i in range(600)], "xb": [chr(0x5E00 + i) for i in range(600)]}
    made = [(100_000 + i, "".join(rnd.choice(scripts[k]) for _ in range(rnd.randint(20, 60))), k) for i, k in enumerate(["xa", "xb"] * 200)]
    rows = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    got = langid.identify(rows).where("doc_id >= 100000").select("lang", "language.lang").toDF("lang", "found").collect()
    assert len(got) == 400 and all(r["lang"] == r["found"] for r in got)


def test_a_language_that_was_not_taught_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 200")
    model = langid.train(docs.where("lang <> 'fr'"))
    found = docs.withColumn("l", langid.predictor(docs, model)(F.col("text"))).groupBy((F.col("lang") == "fr").alias("foreign")).agg(F.avg(F.col("l.rejected").cast("int")).alias("share")).collect()
    shares = {r["foreign"]: r["share"] for r in found}
    assert shares[True] > 0.8 and shares[False] < 0.02  # 0.85 measured


def test_models_keep_their_most_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_GRAMS", 4000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    assert model.langs and all(len(m.grams[-1]) <= 4000 // len(model.langs) for m in model.models)
    got = docs.withColumn("l", langid.predictor(docs, model)(F.col("text"))).where("lang is not null and length(text) > 200").collect()
    assert sum(r["l"]["lang"] == r["lang"] for r in got) > 0.95 * len(got)


def test_languages_reject_texts_with_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rnd = random.Random(2)
    odd = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(200)]
    made = [(1, " ".join(odd)), (2, "Съешь ещё этих мягких французских булок, да выпей чаю. " * 9), (3, "我们在这里学习中文并且每天都读书写字和听音乐。" * 9), (4, "zzzz qqqq xxxx " * 20)]
    halves = [r["text"] for r in docs.where("lang = 'en'").limit(20).collect()], [r["text"] for r in docs.where("lang = 'de'").limit(20).collect()]
    made += [(100 + i, f"{a[:1000]} {b[:1000]}") for i, (a, b) in enumerate(zip(*halves, strict=True)) if min(len(a), len(b)) >= 1000]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r["l"] for r in df.withColumn("l", langid.predictor(df, model)(F.col("text"))).collect()}
    assert all(got[i]["rejected"] and got[i]["score"] < 0.5 for i in (1, 2, 3, 4))
    assert len(got) > 8 and not any(x["rejected"] for i, x in got.items() if i >= 100)
    with pytest.raises(ValueError):
        langid.train(docs.withColumn("lang", F.col("doc_id").cast("string")), max_langs=5)


def test_languages_odd_rows(odd):
    got = {(r["doc_id"], r["text"]): r["language"] for r in langid.identify(odd).collect()}
    assert got[(1, None)]["lang"] == got[(2, "")]["lang"] == "und" and got[(2, "")]["rejected"] and got[(4, "One two three.")]["lang"] in ("en", "fr")
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r["language"]["lang"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- 2


def test_preferences_equal_sql(spark):
    df = queries.op2_preferences(spark, SF)
    want, columns = sql_rows(connect(SF), queries.ORACLE_SQL["op2_preferences"])
    assert sorted(df.columns) == columns and rows_of(df) == want


def test_preferences_prefix_and_masks(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "b<|im_end|>"), (1, 2, None, None), (None, 0, "user", "x"), (2, 0, "user", "same"), (3, 0, "user", "same"), (8, None, "user", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS c", "2 AS side", "3 AS pair_id")
    got = {r["pair_id"]: r for r in preferences.format_pairs(df, preferences.adjacent_pairs(df)).collect()}
    assert set(got) == {0, 2} and got[0]["n_common"] == 1 and got[2]["chosen"]["text"] == got[2]["rejected"]["text"] == ""
    for side in ("chosen", "rejected"):
        learnt = [got[0][side]["text"][m["start"] : m["end"]] for m in got[0][side]["mask"]]
        assert learnt == {"chosen": ["a<|im_end|>"], "rejected": ["b<\\|im_end\\|><|im_end|>"]}[side]
    assert preferences.format_pairs(df.limit(0), preferences.adjacent_pairs(df.limit(0))).count() == 0


# ---- 3

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def _keeps(kind, m):
    d = re.sub("[^0-9]", "", m)
    return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.split("."))) or (kind == "card" and 16 <= len(d) <= 19 and _luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)


def brute_spans(t):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if _keeps(k, m[0])]


def test_base_spans_fuzz(spark):
    rnd = random.Random(1)
    parts = ["a", "b", ".", "@", "1", "4", "5", "+", "-", " ", "(", ")", "é", "😀", "\n", "_", "x.y", "4111111111111111", "10.0.0.1", "+1 (555) 123-4567"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + [None, ""]
    for r in pii.with_base(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == brute_spans(r["text"])


def test_base_spans_of_documents(spark, texts):
    for r in queries.op3_pii(spark, SF).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)


def test_long_runs_end(spark):
    made = ["1" * 300_000, "a@b" + ".c" * 50_000, "a" * 200_000, "+1" + "(" * 100_000, " 10.0.0.1" * 5000]
    got = {r["doc_id"]: len(r["base"]) for r in pii.with_base(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 5000}


def test_disclosing_terms_go(spark):
    rows = [(i, f"filler{i} call Zorblax about it joe@acme.com the and of number{i * 7} thing{i}") for i in range(6)] + [(100 + i, f"the and of about it call other{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["key"]: [s["value"] for s in r["terms"]] for r in pii.spans(df).collect()}
    assert found[0] == ["Zorblax"] and found[100] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == "filler0 call  about it [EMAIL] the and of number0 thing0" and clean[100] == rows[6][1]
    # copies of one document prove nothing about its words
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(9)] + rows[6:], "doc_id long, text string")
    assert all(not r["terms"] for r in pii.spans(copies).collect())


def test_disclosing_terms_far_from_the_mention(spark):
    rows = []
    for i in range(12):
        body = " ".join(f"w{i}x{j}" for j in range(30))
        name = "Zorblax Qz" if i % 2 else "Qz Zorblax"  # the name far away, in one half near as well
        rows.append((i, f"From {name} hello{i} {body} " + (f"Vurmik call{i} " if i % 2 else f"other{i} ") + "write to me any day at joe@acme.com and I will answer as soon as" + ("" if i % 2 else " Vurmik") + f" day{i} {body}"))
    rows += [(100 + i, f"From the desk of other{i} write to me any day at the office and I will answer as soon as day{i}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["key"]: {s["value"] for s in r["terms"]} for r in pii.spans(df).collect()}
    assert all(found[i] == {"Zorblax", "Qz", "Vurmik"} for i in range(12)) and not any(found[100 + i] for i in range(240))
    # near copies of one document prove nothing but for what stands beside the edit
    made = [(i, " ".join(f"w{j}" for j in range(200)) + f" joe@acme.com b c d e f g h i k edit{i}") for i in range(5)] + rows[12:]
    terms = {s["value"] for r in pii.spans(spark.createDataFrame(made, "doc_id long, text string")).collect() for s in r["terms"]}
    assert terms <= set("bcdefghik")


def test_disclosure_counts_equal_brute_force(spark):
    rnd = random.Random(3)
    names = [f"n{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(160):
        who = rnd.choice(names)
        w = [rnd.choice([f"{a}{b}w" for a in "abcdefgh" for b in "vwxyz"]) for _ in range(rnd.randint(5, 30))]
        if rnd.random() < 0.5:
            w.insert(rnd.randrange(len(w)), f"{who}@mail.org")
            w.insert(rnd.randrange(len(w)), f"alias-{who}" if rnd.random() < 0.8 else "x")
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosures(df, support=1, threshold=0.5).collect()}
    holds, mentioned = {}, {}
    for i, t in rows:
        for w in set(re.findall(WORDS, t)):
            holds.setdefault(w, set()).add(i)
        for m in re.finditer(PLAIN["email"], t):
            mentioned.setdefault(f"email:{m[0].lower()}", set()).add(i)
    want = {}
    for e, ids in mentioned.items():
        for w, of in holds.items():
            both = len(ids & of)
            if both and "@" not in w:
                info = math.log(len(rows) * both / (len(ids) * len(of))) / math.log(len(rows) / len(ids))
                if info >= 0.5:
                    want[(e, w)] = info
    assert want and {k: round(v, 9) for k, v in got.items() if "@" not in k[1]} == {k: round(v, 9) for k, v in want.items()}


def test_entities_of_the_same_documents_are_one_class(spark):
    """Copies of a list of addresses and a text of its own: rows grow with the words, not with words times addresses."""
    listed = lambda n: " ".join(f"word{i} user{i}@mail.org" for i in range(n))
    rows = [(i, listed(400)) for i in range(4)] + [(10 + i, f"plain text number{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    entities, members, told = pii._disclosing(df, 8, 3, 0.8)
    assert entities.count() == 400 and entities.select("class").distinct().count() == 1 and members.count() == 4
    assert told.count() == 0  # their contexts are equal
    apart = spark.createDataFrame([(i, " ".join(f"{i}x{j} word{j} user{j}@mail.org" for j in range(300))) for i in range(4)] + rows[4:], "id long, text string")
    _, _, told = pii._disclosing(apart, 8, 3, 0.8)
    words = {f"word{j}" for j in range(300)} | {f"user{j}@mail.org" for j in range(300)}
    assert {r["term"] for r in told.collect()} - {"word"} == words  # what is left of a word without its digits is no word of a text


def brute_masked(text, spans):
    out, at, last = [], 0, None
    for a, b, kind in sorted(spans):
        if last is not None and a < at:
            at = max(at, b)
        else:
            out += [text[at:a], "" if kind == "removed" else f"[{kind.upper()}]"]
            at, last = b, kind
    return "".join(out) + text[at:]


def test_masks_equal_brute_force(spark):
    rnd = random.Random(9)
    rows = [(0, None, [(1, 2, "email")]), (1, "abc", []), (2, "abc", None)]
    for i in range(3, 200):
        text = "".join(rnd.choice("abé😀 ") for _ in range(rnd.randint(1, 80)))
        some = [(a, rnd.randint(a + 1, len(text)), rnd.choice(["email", "term", "removed"])) for a in (rnd.randrange(len(text)) for _ in range(rnd.choice([0, 1, 2, 5, 30])))]
        rows.append((i, text, some))
    df = spark.createDataFrame(rows, "id long, text string, found array<struct<start:int,end:int,kind:string>>")
    got = {r["id"]: r["text"] for r in pii.masked(df, "text", "found").collect()}
    assert got == {i: brute_masked(t, s) if t is not None and s else t for i, t, s in rows}


def test_masks_take_no_square_time(spark):
    import time

    took = []
    for n in (4000, 32_000):
        df = spark.createDataFrame([(1, "user@mail.org some words " * n)], "doc_id long, text string")
        began = time.time()
        assert pii.redact(df).first()["text"] == "[EMAIL] some words " * n
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 10


def test_terms_at_base_spans_are_left_to_them(spark):
    rows = [(i, f"q{i} joe@acme.com,Zorblax b{i} Zorblax c{i} Vurmik:joe@acme.com d{i}") for i in range(6)] + [(100 + i, f"the and of about it call other{i}") for i in range(60)]
    for broadcast in (1_000_000, 0):
        pii.BROADCAST_SPANS, was = broadcast, pii.BROADCAST_SPANS
        df = spark.createDataFrame(rows, "doc_id long, text string")
        clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
        pii.BROADCAST_SPANS = was
        assert clean[0] == "q0 [EMAIL],Zorblax b0  c0 Vurmik:[EMAIL] d0" and clean[100] == rows[6][1] and len(clean) == 66


def test_pii_odd_rows(odd):
    assert pii.spans(odd).count() == len(ODD) and pii.spans(odd.limit(0)).count() == 0
    assert sorted(map(str, (r["text"] for r in pii.redact(odd).collect()))) == sorted(str(t) for _, t, _ in ODD)


# ---- 4


def test_main_text(spark):
    import html

    def plain(h):
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", h, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        return "\n\n".join(b for b in blocks if b)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op4_html_text(spark, SF).collect():
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_main_text_templates(spark):
    assert html_text.extract('<body class="with-sidebar"><div id="menu"><a>x</a></div><div class="content"><h1>T</h1><p>Long long text that goes on.<p>Short.<div class="cookie notice">We</div><form><input>Name</form></div><div class="sidebar">Side</div><div id="comments"><p>nice</p></div><footer>f</footer>') == "T\n\nLong long text that goes on.\n\nShort."
    assert html_text.extract("<header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>a&nbsp;&amp; b<br>c<ul><li>x<li>y</ul><section class='comments'><p>c1</section><aside>q</aside></article></main>") == "Title\n\na & b c\n\nx\n\ny"
    for none in (None, "", "  ", "<script>x</script>", "<![foo[x]]>"):
        assert html_text.extract(none) == ""
    assert html_text.smoothed([4.0, 4.0, 4.0]) == [4.0, 4.0, 4.0]
    df = spark.createDataFrame([(1, None), (1, None), (2, "<p>a" * 3000)], "page_id long, html string").withColumn("tag", F.lit(1))
    assert sorted(len(r["text"]) for r in html_text.with_text(df).collect()) == [0, 0, 3 * 3000 - 2]


def test_ratios_choose_the_text(spark):
    long = "This is a sentence of the article that goes on for quite a while and says a lot of things to whoever reads it. "
    links = "".join(f"<a href=x>l{i}</a> " for i in range(30))
    # two articles and no article: the dense containers, not a tag, are the text
    two = f"<body><div>{links}</div><article><p>{long * 2}</article><article><p>{long * 3}</article><div>{links}</div>"
    assert html_text.extract(two) == f"{(long * 2).strip()}\n\n{(long * 3).strip()}"
    none = f"<body><div><div>{links}</div></div><div><h2>Head</h2><p>{long * 2}<p>Short.<p>{long * 2}</div><div>{links}</div>"
    assert html_text.extract(none) == f"Head\n\n{(long * 2).strip()}\n\nShort.\n\n{(long * 2).strip()}"
    # a page whose only article is a teaser
    teaser = f"<body><main><div><p>{long * 4}<p>{long * 4}</div><div><article><p>More <a>x</a> <a>y</a> <a>z</a></article></div></main>"
    assert html_text.extract(teaser) == f"{(long * 4).strip()}\n\n{(long * 4).strip()}"
    # without ratios every line is content, and lists of links that no mark names stay
    equal = lambda r: [1.0] * len(r)
    for page in (two, none, teaser):
        assert "l7" in html_text.extract(page, equal) or "More" in html_text.extract(page, equal)
        assert html_text.extract(page, equal) != html_text.extract(page)
    # a page of no words but links is all content: there is nothing to tell its lines apart
    assert html_text.extract(f"<body><div>{links}</div>").startswith("l0 l1")


def test_nothing_of_the_article_is_dropped():
    long = " ".join(["This is a sentence of the article that goes on for quite a while and says a lot of things."] * 3)
    got = lambda page: html_text.extract(page).replace(long, "LONG").split("\n\n")
    assert got(f"<article><p>{long}<p>{long}<table><tr><td>Cell one</td><td>Cell two</td></tr></table></article>") == ["LONG", "LONG", "Cell one", "Cell two"]
    assert got(f"<body><section><p>{long}</section><section><h2>Short head</h2><p>Brief note.</p></section><section><p>{long}</section>") == ["LONG", "Short head", "Brief note.", "LONG"]
    assert got(f"<body><div><h1>Head</h1></div><div><p>{long}<p>{long}</div>") == ["Head", "LONG", "LONG"]
    assert got(f"<body><div>Site</div><div><h1>Head</h1></div><div>By me</div><div><p>{long}<p>End.</div><div>Imprint</div>") == ["Head", "By me", "LONG", "End."]
    assert got(f"<body><div><h3>Part</h3></div><div><p>{long}</div>") == ["Part", "LONG"]
    assert got(f"<main><article><p>{long}</article><article><p>Small Part two</p></article></main>") == ["LONG", "Small Part two"]
    # links within the text, one link alone, and a list of links
    assert got(f"<div><p>{long}<p>{long}<ul><li><a href=x>a b</a><li><a href=x>c d</a> e<li><a href=x>f</a></ul><p>See <a href=x>this</a> too.<p><a href=x>One link</a></div>") == ["LONG", "LONG", "See this too.", "One link"]
    assert got(f"<div class='content-with-sidebar'><p>{long}<p>{long}</div>") == ["LONG", "LONG"]


def test_comments_of_readers_go():
    long = " ".join(["This is a sentence of the article that goes on for quite a while and says a lot of things."] * 3)
    got = lambda page: html_text.extract(page).replace(long, "LONG").split("\n\n")
    assert got(f"<main><article><h1>T</h1><p>{long}</article><section class='discussion'><article><p>{long}</article><article><p>Nice</article></section></main>") == ["T", "LONG"]
    # they may write more than the article has
    assert got(f"<div><div><p>{long}</p></div><div class='post-comments'><div><p>{long} {long} {long}</p></div></div></div>") == ["LONG"]
    assert got(f"<article><p>{long}</article><div id=replies><article><p>{long}</article></div>") == ["LONG"]
    assert got(f"<article><p>{long}</article><div class=ad><p>{long} {long}</div>") == ["LONG"]


def test_html_depth_is_linear():
    import time

    assert html_text.extract("<p>Hello <button><i><b><u><s>Buy</s></u></b></i></button> world</p>") == "Hello world"
    assert html_text.extract("<p>a <svg><g><g><g><g><text>x</text></g></g></g></g></svg> b") == "a b"
    for page in ("<div>" * 100_000 + "text", "<li><div>" * 30_000 + "text", "<b>" * 50_000 + "</i></p>" * 50_000 + "text", "<p>x " * 100_000):
        began = time.time()
        assert html_text.extract(page).strip()
        assert time.time() - began < 5


# ---- 5


def fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_groups(rows):
    fps = [(k, fingerprint(t)) for k, t in rows]
    group = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 2 and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for (k, _), g in zip(fps, group, strict=True):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    return sorted((str(k), format(f, "016x"), str(least.get(g))) for (k, f), g in zip(fps, group, strict=True))


def test_near_duplicates(docs, texts, odd):
    got = sorted((str(r[0]), r[1], str(r[2])) for r in simhash.near_duplicates(docs).collect())
    assert got == brute_groups(texts.items())
    got = sorted((str(r[0]), r[1], str(r[2])) for r in simhash.near_duplicates(odd).collect())
    assert got == brute_groups([(k, t) for k, t, _ in ODD])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**64, 500, dtype=np.uint64)
    assert (simhash.codewords(np.arange(4096)) >= 0).sum(1).max() == 6
    for bits in (0, 1, 2):
        g = f.copy()
        for i in range(len(g)):
            for b in rng.choice(64, bits, replace=False):
                g[i] ^= np.uint64(1) << np.uint64(b)
        a, b = (set(zip(*(x.tolist() for x in simhash.fuzzy_keys(v)), strict=True)) for v in (f, g))
        assert {r for r, _ in a & b} == set(range(len(f)))


@pytest.mark.parametrize("full", [1, 64])
def test_crowded_keys_link_alike(spark, full):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(40, int(rng.integers(0, 4)), replace=False)) for _ in range(150)})
    near = spark.createDataFrame([(x,) for x in fps], "fp long")
    par = {x: x for x in fps}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            par[max(root(a), root(b))] = min(root(a), root(b))
    from noticelake.operators.components import components

    got = {r["node"]: r["component"] for r in components(simhash.links(near, full=full)).collect()}
    assert all(got.get(x, x) == root(x) for x in fps)


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, _, c in brute_groups((r["doc_id"], r["text"]) for r in docs.collect())})


def brute_shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("full", [64, 1])
def test_stage_drops_edited_copies(spark, texts, full):
    import corpus_pipeline

    rnd = random.Random(5)
    rows, want = [], set()
    for i, t in sorted(texts.items()):
        rows.append((i, t))
        w = t.split()
        for edits in (1, 2, 4, 8):
            made = list(w)
            for at in rnd.sample(range(len(w)), min(edits, len(w))):
                made[at] = f"edit{rnd.randint(0, 10**9)}"
            a, b = brute_shingles(t), brute_shingles(" ".join(made))
            rows.append((10_000 * edits + i, " ".join(made)))
            if len(a & b) / len(a | b) >= 0.8:
                want.add(10_000 * edits + i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in (corpus_pipeline.deduplicate(spark, df, SF) if full == 64 else near_copies.keep_one(df, full=full)).collect()}
    assert len(want) > 200
    sets = {i: brute_shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)) and root[i] != root[j]:
            x, y = sorted((root[i], root[j]))
            root = {k: x if v == y else v for k, v in root.items()}
    assert kept == {i for i in root if root[i] == i} and not want & kept  # with crowded keys as well


def test_near_copies_odd_rows(odd):
    got = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in near_copies.groups(odd).collect())))
    assert got == sorted(map(str, [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (None, None), (6, 6)]))
    assert near_copies.keep_one(odd).columns == odd.columns and near_copies.keep_one(odd.limit(0)).count() == 0


# ---- 6


def test_samples_round_trip(docs, odd):
    rows = pieces.with_samples(docs, k=2).withColumn("back", pieces.decoder()(F.col("samples")[1]["ids"])).collect()
    again = {r["doc_id"]: r["samples"] for r in pieces.with_samples(docs.repartition(3), k=2).collect()}
    for r in rows:
        assert len({tuple(s["ids"]) for s in r["samples"]}) == len(r["samples"]) and again[r["doc_id"]] == r["samples"]
        assert len(r["samples"]) < 2 or r["back"] == r["text"].replace("▁", " ")
    got = {(r["doc_id"], r["text"]): r["samples"] for r in pieces.with_samples(odd).collect()}
    assert got[(1, None)] == got[(2, "")] and got[(1, None)][0]["ids"] == [] and len(got) == len(set(ODD))
    assert pieces.with_samples(odd.limit(0)).count() == 0


def test_samples_without_replacement():
    v, n = pieces.vocabulary(pieces.MODEL), 6000
    rows = pieces.sample_texts(v, pa.array(["ab cd"] * n), pieces.mix(np.arange(n, dtype=np.uint64)), 2)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}

    def every(u):
        return [(known[u[:m]], *r) for m in range(1, len(u) + 1) if u[:m] in known for r in every(u[m:])] if u else [()]

    logs = {x + y: sum(float(v.logp[i]) for i in x + y) for x in every("▁ab") for y in every("▁cd")}
    total = np.logaddexp.reduce(list(logs.values()))
    p = {s: math.exp(w - total) for s, w in logs.items()}
    for s, q in sorted(p.items(), key=lambda x: -x[1])[:4]:
        first = sum(tuple(r[0][0].tolist()) == s for r in rows) / n
        second = sum(tuple(r[1][0].tolist()) == s for r in rows) / n
        want = sum(p[o] * q / (1 - p[o]) for o in p if o != s)
        assert abs(first - q) < 0.03 and abs(second - want) < 0.03
        weighed = sum(math.exp(x[1] - x[2]) for r in rows for x in r if tuple(x[0].tolist()) == s) / n
        assert abs(weighed - q) < 0.05


def test_long_units(spark):
    import time

    v = pieces.vocabulary(pieces.MODEL)
    rnd = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for text in ("".join(rnd.choice(letters) for _ in range(300_000)), "a" * 100_000, "学习中文" * 20_000, "-" * 5000 + " word"):
        began = time.time()
        (rows,) = pieces.sample_texts(v, pa.array([text]), np.array([7], np.uint64), 2)
        assert len(rows) in (1, 2) and all(v.decode(r[0].tolist()) == text for r in rows) and time.time() - began < 20
    # seams are where no piece of the vocabulary runs across
    text = "▁" + "".join(rnd.choice(letters) for _ in range(300))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    seam = pieces._seams(v, points, np.array([0]), np.array([len(text)]))
    known = {b.decode("utf-8", "replace").replace(" ", "▁") for b in v.bytes_of if len(b) > 1}
    over = {p for a in range(len(text)) for n in range(2, 17) if text[a : a + n] in known and a + n <= len(text) for p in range(a + 1, a + n)}
    assert set(np.flatnonzero(seam).tolist()) == set(range(1, len(text))) - over
    # swept alone or beside others, the sums are the same
    several = pieces._Lattice(v, points, np.array([0]), np.array([len(text)]))
    held, pieces.ALONE = pieces.ALONE, 10
    try:
        single = pieces._Lattice(v, points, np.array([0]), np.array([len(text)]))
    finally:
        pieces.ALONE = held
    assert np.allclose(several.alpha, single.alpha, atol=1e-3) and np.allclose(several.cdf[1:], single.cdf[1:], atol=1e-3)


# ---- 7


def brute_repeats(rows, size=13):
    words = [(k, re.findall(WORDS, t or "")) for k, t in rows]
    least = {}
    for k, w in words:
        for j in range(len(w) - size + 1):
            s = tuple(w[j : j + size])
            least[s] = min(least.get(s, math.inf), math.inf if k is None else k)
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if least[tuple(w[j : j + size])] < (math.inf if k is None else k):
                gone[j : j + size] = [True] * size
        out.append((str(k), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_repeats(spark, docs, texts, odd):
    got = substrings.remove_repeats(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(texts.items())
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in itertools.pairwise(r["removed"]))
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(k, t) for k, t, _ in ODD] + [(9, long), (7, "a b " + long + " c"), (8, long), (None, long), (7, long)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1))).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in found) == brute_repeats(rows)
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


def test_repeats_hot_passage_and_key(spark):
    rnd = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(600):
        own = [f"x{rnd.randint(0, 10**9)}" for _ in range(rnd.randint(0, 40))]
        own.insert(rnd.randrange(len(own) + 1), passage)
        rows.append((i if i % 3 else 7, " ".join(own)))  # a third of the rows have one key
    rows += [(7, rows[0][1])] * 200  # and many are wholly equal
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), group_bytes=2000).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(rows)


# ---- 8


def test_shards(spark, texts):
    rows = queries.op8_sharding(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] in (r["shard"], 16)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def brute_shard(key, weights):
    seed = xxhash.xxh64_intdigest(("\0null" if key is None else str(key)).encode(), 42)
    waits = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed)
            waits.append((-math.log(((h >> 12) + 0.5) / 2**52) / weight, shard))
    return min(waits)[1]


def test_shards_equal_brute_force(spark, odd):
    for r in queries.op8_sharding(spark, SF).collect():
        assert r["shard"] == brute_shard(r["doc_id"], [1.0] * 16) and r["grown_shard"] == brute_shard(r["doc_id"], [1.0] * 17)
    for r in sharding.assign(odd, "doc_id", [1.0, 0.0, 2.5, 4.0]).collect():
        assert r["shard"] == brute_shard(r["doc_id"], [1.0, 0.0, 2.5, 4.0])


def test_slots_of_equal_keys_are_stable(spark):
    df = spark.createDataFrame([(1, 5, f"t{i}") for i in range(300)], "shard int, doc_id long, text string")
    runs = [sorted((r["text"], r["slot"]) for r in sharding.slots(df.repartition(n), "shard", "doc_id", slot_rows=1).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and sorted(x for _, x in runs[0]) == list(range(300))


def test_shards_weights_and_odd_rows(spark, odd):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    got = {r["shard"]: r["count"] for r in sharding.assign(df, "doc_id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(got) == {0, 1} and 0.22 < got[0] / 20000 < 0.28
    placed = sharding.slots(sharding.assign(odd, "doc_id", [1.0] * 4), "shard", "doc_id").collect()
    assert len(placed) == len(ODD) and len({(r["shard"], r["slot"]) for r in placed}) == len(ODD)
    assert sharding.slots(sharding.assign(odd.limit(0), "doc_id", [1.0]), "shard", "doc_id").count() == 0


# ---- 9


def test_contamination(spark, odd):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(14, 40)))) for i in range(30)] + [(99, "..."), (None, "no id " * 9), (98, None)]
    rows, want = [], {}
    for n in range(200):
        filler = [rnd.choice(words) for _ in range(60)]
        item, text = items[n % 30]
        copy = text.split()
        if n % 4 < 3:
            for at in rnd.sample(range(len(copy)), [0, len(copy) // 12, 1][n % 4]):
                copy[at] = "changed"
            filler[30:30] = copy
        rows.append((n, " ".join(filler).upper().replace(" ", ", ", 5)))
        want[n] = item if n % 4 < 3 else None
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in decontaminate.with_matches(df, bench, broadcast_words=limit).collect()}
        assert got == {n: [] if i is None else [i] for n, i in want.items()}
        assert all(r["matches"] == [] for r in decontaminate.with_matches(odd, bench, broadcast_words=limit).collect())
        assert decontaminate.with_matches(odd, bench.limit(0), broadcast_words=limit).count() == len(ODD)


def test_inner_names_in_the_input(spark):
    """Columns named as the operators name their own come back untouched and change nothing."""
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{body} mail a@b.org"), (2, f"{body} mail a@b.org x"), (3, "nothing here"), (4, None), (5, f"c@d.net {body[:20]}")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["__id", "__ID2", "__matches", "__spans", "__base", "__kept", "__part", "__within", "__text", "__held", "__m", "other_0", "id", "item"]
    clash = plain.select("doc_id", *[F.lit(n).alias(n) for n in names], "text", F.lit(7).alias("fp"))
    bench = spark.createDataFrame([(9, body)], "item_id long, text string")
    split = lambda d: sharding.slots(sharding.assign(d, "doc_id", [1.0] * 3), "shard", "doc_id", slot_rows=1)
    runs = [
        lambda d: decontaminate.with_matches(d, bench, broadcast_words=0), lambda d: decontaminate.with_matches(d, bench), pii.redact,
        simhash.keep_one, near_copies.keep_one, split,
    ]
    for run in runs:
        want, got = run(plain), run(clash)
        assert got.columns[: len(clash.columns)] == clash.columns and got.columns[len(clash.columns) :] == want.columns[2:]
        table = got.collect()
        assert all(r[n] == n for r in table for n in names) and all(r["fp"] == 7 for r in table)
        told = [c for c in want.columns if c != "slot"]  # rows of one shard are numbered by a hash of the whole row
        assert sorted(map(repr, got.select(*told).collect())) == sorted(map(repr, want.select(*told).collect()))
    assert {(r["doc_id"], len(r["matches"])) for r in runs[0](clash).collect()} == {(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)}


def brute_matches(text, items, window=13, similarity=0.8):
    t = re.findall("[0-9a-z]+", (text or "").lower())
    out = set()
    for name, item in items:
        w = item.split()
        size = min(window, len(w))
        for shift in range(-len(w), len(t) + 1):
            same = [0 <= i + shift < len(t) and t[i + shift] == x for i, x in enumerate(w)]
            if any(sum(same[a : a + size]) >= math.ceil(similarity * size - 1e-9) for a in range(len(w) - size + 1)):
                out.add(name)
                break
    return sorted(out)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_contamination_equals_brute_force(spark, limit):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(n * 10 + j, " ".join(f"i{n}x{j}x{m}" for m in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 17, 25) for j in range(2)]
    rows = []
    for name, item in items:
        for edits in range(4):
            for _ in range(3):
                copy = item.split()
                for at in rnd.sample(range(len(copy)), min(edits, len(copy))):
                    copy[at] = "changed"
                filler = [rnd.choice(words) for _ in range(rnd.randint(0, 12))]
                filler[len(filler) // 2 : len(filler) // 2] = copy
                rows.append((len(rows), " ".join(filler)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in decontaminate.with_matches(df, bench, broadcast_words=limit).collect()}
    want = {n: brute_matches(t, items) for n, t in rows}
    # seven to thirteen words and every shorter item: all that brute force finds; longer windows as well on these rows
    assert got == want and sum(map(len, want.values())) > 150


def test_contaminated_documents(spark, texts):
    norm = lambda t: f" {' '.join(re.findall('[0-9a-z\x80-\U0010ffff]+', re.sub('[A-Z]', lambda m: m[0].lower(), t or '')))} "
    bench = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {k for k, t in texts.items() if any(b in norm(t) for b in bench)}
    got = {r["doc_id"]: list(r["item_ids"]) for r in queries.op9_decontamination(spark, SF).collect()}
    assert whole <= {k for k, found in got.items() if found}
    # brute force over every diagonal that shares a word, of every document and item
    items = [(r["item_id"], norm(r["text"]).split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, t in texts.items():
        w = norm(t).split()
        at = {}
        for i, x in enumerate(w):
            at.setdefault(x, []).append(i)
        want = []
        for name, item in items:
            size, diagonals = min(13, len(item)), {}
            for i, x in enumerate(item):
                for j in at.get(x, ()):
                    diagonals.setdefault(j - i, [0] * len(item))[i] = 1
            if any(sum(same) >= math.ceil(0.8 * size) and max(sum(same[a : a + size]) for a in range(len(item) - size + 1)) >= math.ceil(0.8 * size) for same in diagonals.values()):
                want.append(name)
        assert got[k] == sorted(want)


# ---- 10


def test_media(spark, docs, texts, odd):
    manifest = media.pack(docs)
    filled = media.headers(manifest)
    for r in media.read_back(filled).collect():
        payload = media.padded((texts[r["key"]] or "").encode())
        assert len(payload) % 64 == 0 and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert media.from_png(media.to_png(payload)) == payload and r["media_sha256"] == r["digest"]
    row = filled.first()
    assert (row["width"], row["depth"]) == (64, 8) and row["height"] * 64 == row["payload_bytes"]
    with tarfile.open(row["shard"].removeprefix("file://")) as shard:
        assert all(hashlib.sha256(shard.extractfile(m).read()).hexdigest() in m.name for m in shard)
    # a shard that no attempt owns up to goes, the others stay
    root = row["shard"].rsplit("/", 1)[0].removeprefix("file://")
    pathlib.Path(f"{root}/lost.tar").write_bytes(b"cut off")
    assert media._sweep(manifest, f"file://{root}") == 1 and media.read_back(filled).count() == len(texts)
    clash = odd.selectExpr("*", "1 AS digest", "2 AS shard", "3 AS offset", "4 AS length", "5 AS n_bytes")
    got = media.read_back(media.headers(media.pack(clash))).collect()
    assert len(got) == len(ODD) and {r["payload_bytes"] for r in got if r["n_bytes"] == 0} == {64}
    assert media.read_back(media.headers(media.pack(odd.limit(0)))).count() == 0
    long = spark.createDataFrame([(1, "long text é " * 200_000)], "doc_id long, text string")
    assert media.read_back(media.headers(media.pack(long))).first()["n_bytes"] == 200_000 * 13


# ---- pipeline


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    done, before = docs, None
    for name, stage in corpus_pipeline.STAGES:
        before, done = done, stage(spark, done, SF)
        if name != "sentencepiece":
            assert done.columns == docs.columns
        done = done.cache()
        assert 0 < done.count() <= before.count()
    kept = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"] for r in done.collect()} == set(kept)
    assert not any(k in ("email", "ip", "phone") for t in kept.values() for k, _, _ in brute_spans(t))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, SF).count() == len(kept)


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    rows = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for df in (rows, rows.limit(0)):
            got = stage(spark, df, SF)
            assert got.count() <= df.count()
            assert name == "sentencepiece" or got.columns == df.columns
