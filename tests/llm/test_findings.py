"""Faults of the training-data operators that a review found, each on a small case that failed before."""

import itertools
import random

import pyarrow as pa
from pyspark.sql import functions as F

from noticelake.llm import near_copies, simhash

SF = "/root/testdata/sf0.001"


def test_sets_that_share_their_common_text_are_not_paired(spark, monkeypatch):
    draw = random.Random(3)
    common = [f"w{i}" for i in range(100)]
    # a fifth of the shingles is a text's own: 0.68 between any two, and most band values are crowded
    rows = [(i, " ".join([*common, *(f"x{draw.random()}" for _ in range(22))])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)]
    compared = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), full=16)
    assert {r["doc_id"] for r in kept.collect()} == set(range(300))
    assert sum(compared) < 20 * len(rows)  # all pairs are 46,360


def test_the_stage_comes_through_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(near_copies, "fingerprint_links", lambda marks: asked.append(marks.count()) or simhash.links(marks))
    monkeypatch.setattr(near_copies, "_first", lambda apart: apart.selectExpr("fp AS src", "fp AS dst").limit(0))
    monkeypatch.setattr(near_copies, "_paired", near_copies._first)
    text = " ".join(f"word{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "another text of few words")], "doc_id long, text string")
    # copies of one changed shingle are found by their fingerprints alone
    assert {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, "").collect()} == {1, 3} and asked


def test_every_sample_is_decoded(spark, monkeypatch):
    from noticelake.llm import pieces, queries

    good = {r["doc_id"]: (len(r["n_pieces"]), r["round_trip"]) for r in queries.op6_pieces(spark, SF).collect()}
    assert all(told for _, told in good.values())
    whole = pieces.with_samples
    last = lambda s: F.transform(s, lambda x, i: F.when((i > 0) & (F.size(x["ids"]) > 2), x.withField("ids", F.slice(x["ids"], 1, F.size(x["ids"]) - 1))).otherwise(x))
    monkeypatch.setattr(pieces, "with_samples", lambda docs: whole(docs).withColumn("samples", last(F.col("samples"))))
    bad = {r["doc_id"]: r["round_trip"] for r in queries.op6_pieces(spark, SF).collect()}
    assert sum(not told for told in bad.values()) > 0.9 * sum(n > 1 for n, _ in good.values()) > 0


def test_one_uniform_number_is_that_of_many():
    import numpy as np

    from noticelake.llm.pieces import _one_uniform, _uniform

    seeds = [0, 1, 2**53 + 1, 2**64 - 1, 0x9E3779B97F4A7C15]
    assert _uniform(np.array(seeds, np.uint64)).tolist() == [_one_uniform(s) for s in seeds]


def test_a_group_of_near_copies_is_connected_before_it_is_paired(spark, monkeypatch):
    draw = random.Random(5)
    text, rows = [f"w{i}" for i in range(150)], []
    for i in range(300):
        words = list(text)
        for _ in range(draw.randrange(1, 7)):
            words[draw.randrange(150)] = f"x{draw.random()}"
        rows.append((i, " ".join(words)))
    compared = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    found = {r["doc_id"]: r["component_id"] for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, least = near_copies.shingle_sets(pa.array([t for _, t in rows])), list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if least[i] != least[j] and near_copies._alike(sets[i], sets[j]):
            least = [min(least[i], least[j]) if x in (least[i], least[j]) else x for x in least]
    assert found == dict(enumerate(least))
    assert sum(compared) < 8000, compared  # all pairs are 44,850


def test_the_nodes_of_a_place_are_one_slice():
    import numpy as np

    from noticelake.llm import pieces

    v = pieces.vocabulary(pieces.MODEL)
    words = ["▁the", "▁notices", "▁a", "▁recalled"]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) for w in words])
    lattice = pieces._Lattice(v, points, np.cumsum(length) - length, length)
    assert lattice.at.tolist() == [0, *np.cumsum([(length >= p).sum() for p in range(length.max())]).tolist()]
    number = {p.decode().replace(" ", "▁"): i for i, p in enumerate(v.bytes_of) if len(p) > 1 and p.isascii()}
    for w, u in zip(words, lattice.rank.tolist(), strict=True):
        forward = [1.0] + [0.0] * len(w)
        for end in range(1, len(w) + 1):
            for piece in lattice.ids[:, lattice.at[end] + u]:
                if piece >= 0:
                    forward[end] += float(np.exp(v.logp[piece])) * forward[end - int(v.size_of[piece])]
        assert np.allclose(lattice.alpha[lattice.at[: len(w) + 1] + u], np.log(forward), atol=1e-4)
        if w in number:  # a word that is a piece is one of its decisions
            assert number[w] in lattice.ids[:, lattice.at[len(w)] + u].tolist()


def test_models_keep_every_gram_of_many_languages(spark):
    from noticelake.llm import langid

    draw = random.Random(7)
    # 64 languages, one of them with more n-grams than a 64th of 8 million, all rare
    rows = [(f"l{i:02}", f"words of language {chr(0x3B1 + i % 24)} number {i} {n}") for i in range(63) for n in range(3)]
    rows += [("zh", "".join(chr(0x4E00 + draw.randrange(20_000)) for _ in range(3000))) for _ in range(60)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.langs) == 64 and len(model.models[model.langs.index("zh")].grams[-1]) > 8_000_000 // 64
