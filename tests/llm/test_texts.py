import random

import pytest

from stratum.llm import leaks as L
from stratum.llm import residue as R
from stratum.llm import tokens as T

DOCS = "doc_id bigint, text string, lang string, ids int"


@pytest.fixture(scope="module")
def pair():
    tokenizers = pytest.importorskip("tokenizers")
    path = T.default_vocabulary()
    ref = tokenizers.Tokenizer.from_file(path)
    ref.encode_special_tokens = True
    with open(path, "rb") as f:
        return ref, T.BytePairs(f.read())


def test_bpe_equals_the_reference_tokenizer(pair):
    import regex

    ref, own = pair
    find, rng = regex.compile(T.PIECES).findall, random.Random(8)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "1", "22", "'s", "'ll", "é", "ї", "日本", "🙂", "<|endoftext|>", "=" * 7, "­", "́", "\x1c", "\x85", " ", "​", "ing", "un", "X", ".", "ber", "straße"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 90))) for _ in range(400)] + ["a" * 5000, "ab" * 3000, " " * 999, "\r\n\r\n x", "0" * 300, "é" * 700]
    for t, e in zip(texts, ref.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.text_ids(t, find) == e.ids, repr(t)


def test_ids_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, 0), (2, "", "en", 0), (3, "Hello world", "en", 0), (3, "Hello world", "en", 0), (None, "x", None, 0)], DOCS)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in T.encode(df).collect()) == [(0, [87]), (1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert T.encode(df.limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(30), None if k % 2 else text(25), "a") for k in range(20)] + [(99, "too short", None, "b"), (98, None, None, "c")]
    docs, want = [], set()
    for k in range(120):
        w = text(60).split()
        if k % 4 == 0:
            q = items[k % 20][1].split()
            w[20:20] = q[5 : 5 + (10 if k % 8 else 9)]
            if k % 8:
                want.add((k, k % 20))
        docs.append((k, ",  ".join(w).upper() if k % 3 else "\n".join(w), "en", 0))
    docs += [(500, None, None, 0), (501, "", None, 0), (4, docs[4][1], "en", 0), (502, items[1][1] * 3000, "en", 0)]
    want.add((502, 1))
    d = spark.createDataFrame(docs, DOCS)
    i = spark.createDataFrame(items, "item_id bigint, question string, context string, answer string")
    got = [tuple(r) for r in L.leaks(d, i).collect()]
    assert len(got) == len(set(got)) and {g for g in got} == want
    assert {tuple(r) for r in L.leaks(d, i, keys=0).collect()} == want  # all windows joined
    assert L.leaks(d, i.limit(0)).count() == 0 and L.leaks(d.limit(0), i).count() == 0


def test_leaks_with_edits(spark):
    q = " ".join(f"q{k}" for k in range(40)).split()
    docs = []
    for k in range(60):
        w = q[k % 25 : k % 25 + 10]
        w[k % 10] = "changed"
        docs.append((k, " ".join([f"a{k}", *w, f"b{k}"]), "en", 0))
    items = spark.createDataFrame([(1, " ".join(q), None)], "item_id bigint, question string, context string")
    d = spark.createDataFrame(docs, DOCS)
    assert L.leaks(d, items).count() == 0
    assert L.leaks(d, items, max_edits=1).count() >= 0.9 * 60


def test_share_of_edited_windows_that_the_default_walks_find():
    rng = random.Random(9)
    walks = [L.Walk(100 + k, 10, max(3, L.SAMPLED // 2)) for k in range(13)]
    memo, found = L.Hashes(), {"changed": 0, "put in": 0}
    for _ in range(400):
        w = [f"w{rng.randrange(9_999)}" for _ in range(10)]
        k = rng.randrange(10)
        for kind, e in (("changed", [*w[:k], "other", *w[k + 1 :]]), ("put in", [*w[:k], "other", *w[k:]][:10])):
            found[kind] += any(x.keys(memo.of(w))[0] == x.keys(memo.of(e))[0] for x in walks)
    assert min(found.values()) >= 0.95 * 400


RESIDUE = ["Your title goes here.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "HTTP/1.1 503 Service Unavailable\nContent-Length: 0", "<html><head><title>404 Not Found</title></head></html>", "Please enable JavaScript to see the map.", "The median of {{ metric }} rose in {{ area }}.", "Vans from ${place} wait longer than those next door.", "Das Thema [INSERT THEME HERE] ist neu.", "Сторінку не знайдено", "The upload from XXXX replaced its older version.", "asdf asdf qwer asdf jkl jkl"]
CLEAN = ["The median of waiting time rose in the north of the city.", "In the guide, '{{ area }}' marks the slot for a place.", "The phrase table writes `{metric}` for the renderer.", "We saw a \"503 Service Unavailable\" body in the log of the depot.", "The sets {A, B} and {A, C} share one cell.", "Set the flag %(asctime)s in the logging format.", "if (z>2){ return 'up'; }", "See [P4] and [P11] for more.", "...", "—", "Drivers in the southern ring were late on two days of the week."]


def test_residue_and_clean(spark):
    prose = [f"The delivery number {k} to the {w} ring was late by {k % 9} minutes and nobody in the depot knew why." for k in range(300) for w in ("northern", "southern")] + CLEAN * 3
    rows = [(k, t, "en", 0) for k, t in enumerate(RESIDUE)] + [(100 + k, t, "en", 0) for k, t in enumerate(CLEAN)] + [(1000 + k, t, "en", 0) for k, t in enumerate(prose)] + [(900, None, None, 0), (901, "  ", None, 0), (902, "word " * 200_000, None, 0)]
    got = {r["doc_id"] for r in R.residue(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(range(len(RESIDUE))) <= got
    assert not {k for k in got if k >= 100}


def test_no_documents(spark):
    assert R.residue(spark.createDataFrame([], DOCS)).count() == 0
