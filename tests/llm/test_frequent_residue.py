import random

import pytest

from stratum.llm import residue as R

DOCS = "doc_id bigint, text string"
NOTICES = ["Aquí va el texto de la ficha.", "Your title goes here.", "Please enable JavaScript to see the map."]


def prose(k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice(["dep", "ri", "van", "lo", "mor", "tes", "ku", "ing", "er", "al"]) for _ in range(rng.randrange(1, 4)))
    return " ".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(5))


@pytest.mark.parametrize("notice", NOTICES)
def test_frequent_residue_is_no_prose(spark, notice):
    """One text in a third of the documents, alone and after real sentences."""
    rows = [(k, prose(k)) for k in range(400)] + [(1000 + k, notice if k % 2 else f"{prose(k + 400)} {notice}") for k in range(200)]
    got = {r["doc_id"] for r in R.residue(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1000 + k for k in range(200)}


def test_frequent_prose_stays_prose(spark):
    """A sentence of every second document that begins like residue."""
    rows = [(k, prose(k) + " The evidence lists are read line by line in the depot." * (k % 2)) for k in range(400)]
    assert R.residue(spark.createDataFrame(rows, DOCS)).count() == 0


def test_heavy_segments(spark):
    d = spark.createDataFrame([(k, f"The ring was  late by {k % 10} minutes. word{'abcdefghij'[k % 10] * (1 + k // 10)}.") for k in range(50)] + [(99, None), (98, " ")], DOCS)
    digest, weight, n = R.heavy_segments(d.repartition(7))
    page = R.Page(["THE RING WAS\tlate by 3 minutes."])
    a, b = page.segments()
    assert n.tolist() == [50] and weight.tolist() == [int(3 / 50 * 1024) / 1024]
    spaced = R.Page(["THE RING WAS  late by 3 minutes."])
    assert spaced.digests(*spaced.segments()).tolist() == digest.tolist()
    assert page.digests(a, b).tolist() != digest.tolist()  # one blank less


def test_segments_and_spans_keep_their_places(spark):
    texts = ["- Note: One thing.\n> [P12] Two <b>bold</b> words! (Three)", "", "x" * 10, "Four\r\nfive… six"]
    p = R.Page(texts)
    a, b = p.segments()
    assert [p.text[x:y] for x, y in zip(a, b)] == ["One thing.", "Two", "<b>", "bold", "</b>", "words!", "(Three)", "x" * 10, "Four", "five…", "six"]


def test_forms_of_slots_that_the_model_has_not_seen():
    """Forms held out from the slot model, in sentences; sentences with emphasis, sets and code stay clean."""
    from stratum.llm import residue_seeds as seeds

    text, shape, _ = R._counted([prose(k) + f" The **{k}** _old_ set {{a, b}} and f(x[{k}]) <b>were</b> [P{k}]." for k in range(500)])
    wraps = seeds.wraps()
    for held in (["~~", "~~~"], ["@@", "@@@"], ["{{", "{{{"], ["%%", "%%%"]):
        model = R.Model(text, shape, [w for w in wraps if w[0].strip() not in held])
        a, b = next(w for w in wraps if w[0] == held[0])
        found = [R.residue_spans(f"Kudep ering the {a}{n}{b} moring allo vanmor.", model) for n in ("customer", "ORDER_ID", "zone.label", "link")]
        assert sum(map(bool, found)) >= 3, (held, found)
        for clean in ("Kudep **ering** moring _allo_ vanmor.", "The set {a, b} and {c, d} are one.", "See [P4] and f(x[3]) in <b>bold</b>."):
            assert not R.residue_spans(clean, model), (held, clean)
