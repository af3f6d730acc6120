"""Ids that are given twice: each text is judged by itself, and no text goes that has no copy."""

from lodestack.llm import exact_dedup, minhash

from .test_llm_operators import clashing, frame, words


def test_exact_dedup_judges_the_texts_of_an_id_apart(spark):
    # 1: two different texts; 7: a copy of 1's and one of its own; 9 repeats id and text
    df = clashing(frame(spark, ["a", "b", "a", "c", "d e", "d  e", "d  e"], [1, 1, 7, 7, 9, 9, 9]))
    for n in (1, 5):
        out = exact_dedup.exact_dedup(df.repartition(n))
        assert out.columns == df.columns
        assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a"), (1, "b"), (7, "c"), (9, "d  e")]


def test_near_dedup_judges_the_texts_of_an_id_apart(spark):
    a, b, c, d = (words(k, 60) for k in range(4))
    near = [" ".join([*w[:-1], "other"]) for w in (a, b, c, d)]
    a, b, c, d = (" ".join(w) for w in (a, b, c, d))
    df = clashing(frame(spark, [a, near[0], b, c, near[2], d, near[3], "", "", None], [3, 5, 5, 5, 8, 9, 9, 11, 11, 11]))
    for n in (1, 5):
        out = minhash.near_dedup(df.repartition(n))
        assert out.columns == df.columns
        got = sorted((r.doc_id, r.text or "") for r in out.collect())
        assert got == sorted([(3, a), (5, b), (5, c), (9, min(d, near[3])), (11, "")])
